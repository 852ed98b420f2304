"""License scans by diagonal voting.

Every rolling 3-word hash of every text is joined with the positions of the same hash in the license templates. A hit
at word ``pos`` of a text and word ``tpos`` of a template votes for the diagonal ``pos - tpos``; a template that stands
in the text word for word puts all its votes on one diagonal. Short phrases must have them all. For longer templates,
neighbouring diagonals are merged, since words put in or left out shift what follows. Merged spans are bounded: hits are
dealt to overlapping windows of three template lengths, and diagonals are merged within one. A span is a candidate if it
holds enough different positions of the template, however often one is hit, and it is verified by the words that the
longest chain of hits covers whose positions rise in the text and in the template. The template table is a fixed list, so
its broadcast is bounded; nothing else is broadcast, and texts are never shuffled.

Defined cases: a null text is an empty one, without words; a text of one or two words has no hashes; very long texts are
scanned whole; phrases that overlap or repeat count at every place; labels that tie are listed once each, in order; null and
repeated doc_ids are rows of their own; an empty table gives an empty result; further columns, whatever their names, are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm.common import materialize, slices, texts
from lectern.llm.textops import lower_ascii, prefix_sums, runs, shingles, span_hash, views

#: Words in a rolling hash.
K = 3
#: Diagonals that differ by no more than this, or than this part of a template's hashes, are merged.
NEAR, NEAR_PART = 4, 8
#: Share of a template's hashes that a merged span must hold.
ENOUGH = 0.6
#: Phrases that are found word for word, and their labels.
BASE = [
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
]
#: Longer notices, as the licenses word them, and further phrases, with labels of the method's own.
TEMPLATES = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability", "mit"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache-2"),
    ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "apache-2"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("you should have received a copy of the gnu general public license along with this program", "gpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products", "bsd-3"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("this work is licensed under a creative commons attribution noncommercial license", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution sharealike license", "cc-by-sa"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("all rights reserved", "all-rights-reserved"),
]
#: Whole texts of short licenses, word for word, without the lines for names and years.
WHOLE = [
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
        "subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with "
        "the software or the use or other dealings in the software",
        "mit",
    ),
    (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for "
        "any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or "
        "in connection with the use or performance of this software",
        "isc",
    ),
    (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice "
        "this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or "
        "other materials provided with the distribution",
        "bsd",
    ),
    (
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use "
        "this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions the origin of this software must not be misrepresented you must "
        "not claim that you wrote the original software",
        "zlib",
    ),
    (
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute "
        "execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so",
        "bsl-1.0",
    ),
    (
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any "
        "purpose commercial or non commercial and by any means",
        "unlicense",
    ),
]
#: The hash that stands for "this text exists", with its number of words as position.
HEADER = 0


def word_spans(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of every word, of many texts at once."""
    raw, off = views(col)
    raw = lower_ascii(raw)
    starts, ends, docs = runs((raw >= 128) | (raw >= 97) & (raw <= 122) | (raw >= 48) & (raw <= 57), off)
    return span_hash(prefix_sums(raw), starts, ends), docs


def grams(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rolling hashes with document and first word, and how many words each document has."""
    words, docs = word_spans(col)
    counts = np.bincount(docs, minlength=len(col)).astype(np.int64)
    long_enough = counts[docs] >= K if len(docs) else np.zeros(0, bool)
    h, d = shingles(words[long_enough], docs[long_enough], K, len(col))
    per = np.bincount(d, minlength=len(col)) if len(d) else np.zeros(len(col), np.int64)
    pos = np.arange(len(h)) - np.repeat(np.cumsum(per) - per, per)
    return h, d, pos, counts


def template_table(spark: SparkSession, base: list, more: list) -> DataFrame:
    """(hash, template, tpos, n_grams, is_base, label): a fixed, small table."""
    phrases = [(p, label, True) for p, label in base] + [(p, label, False) for p, label in more]
    h, d, pos, counts = grams(pa.array([p for p, _, _ in phrases]))
    rows = [(int(x), int(i), int(p), int(counts[i]) - K + 1, phrases[i][2], phrases[i][1]) for x, i, p in zip(h.view(np.int64), d, pos, strict=True)]
    rows.append((HEADER, -1, 0, 0, False, ""))
    return spark.createDataFrame(rows, "hash long, template int, tpos long, n_grams int, is_base boolean, label string")


def hits(docs: DataFrame, base: list, more: list) -> DataFrame:
    """(row, doc_id, template, label, is_base, n_grams, pos, tpos, diagonal): all hits, and a header for each row."""

    def rolling(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            h, d, pos, counts = grams(part.column("text"))
            who = np.concatenate([np.arange(len(counts)), d])
            yield pa.RecordBatch.from_arrays(
                [part.column("row").take(pa.array(who)), part.column("doc_id").take(pa.array(who)), pa.array(np.concatenate([counts, pos])), pa.array(np.concatenate([np.full(len(counts), HEADER), h.view(np.int64)]))],
                ["row", "doc_id", "pos", "hash"],
            )

    named = texts(docs).withColumn("row", F.monotonically_increasing_id())
    hashes = named.mapInArrow(rolling, "row long, doc_id long, pos long, hash long")
    met = hashes.join(F.broadcast(template_table(docs.sparkSession, base, more)), "hash").drop("hash")
    return met.withColumn("diagonal", F.col("pos") - F.col("tpos"))


def exact_phrases(hits: DataFrame) -> DataFrame:
    """(row, doc_id, label, is_base, start, last, share): base phrases by diagonal, and the header of each row (start: its words)."""
    keys = ["row", "doc_id", "template", "label", "is_base", "n_grams", "diagonal"]
    counted = hits.where(F.col("is_base") | (F.col("template") < 0)).groupBy(*keys).agg(F.count(F.lit(1)).alias("votes"))
    return counted.select("row", "doc_id", "template", "label", "is_base", F.col("diagonal").alias("start"), (F.col("diagonal") + F.col("n_grams") + K - 2).alias("last"), F.when(F.col("template") >= 0, F.col("votes") / F.col("n_grams")).otherwise(0.0).alias("share"))


def chained(spots: list[tuple[int, int]], k: int = K) -> tuple[int, int, int]:
    """Words of the template that the longest chain of (pos, tpos) with both rising covers, each word once, and its first and last word.

    Of chains that cover as many words, the one that starts last counts, then the one that ends first.
    """
    best: dict[int, tuple[int, int, int]] = {}  # by last tpos: words covered so far, first word, last word (negative)
    for pos, tpos in sorted(spots, key=lambda s: (s[0], -s[1])):
        here = max(((n + min(k, tpos - at), first, 1 - pos - k) for at, (n, first, _) in best.items() if at < tpos), default=(0, 0, 0))
        best[tpos] = max(best.get(tpos, (0, 0, 0)), here, (k, pos, 1 - pos - k))
    n, first, last = max(best.values(), default=(0, 0, 0))
    return n, first, -last


def spans(hits: DataFrame, near: int = NEAR, enough: float = ENOUGH) -> DataFrame:
    """(row, doc_id, template, label, is_base, start, last, share): spans of longer templates, first to last word, with their verified share.

    Each window holds at most as many hits as it has words times the places of a word in its template, so what a task
    collects is bounded by the templates. Windows overlap, so verified spans of one template that overlap are one.
    """
    longer = hits.where(~F.col("is_base") & (F.col("template") >= 0))
    size = F.col("n_grams") + K - 1
    window = F.floor(F.col("pos") / size)
    dealt = longer.withColumn("window", F.explode(F.array(window, window - 1, window - 2)))
    keys = ["row", "doc_id", "template", "label", "n_grams", "window"]
    by_diagonal = dealt.groupBy(*keys, "diagonal").agg(F.collect_list(F.struct("pos", "tpos")).alias("spots"))
    order = Window.partitionBy("row", "template", "window").orderBy("diagonal")
    most = F.greatest(F.lit(near), F.floor(F.col("n_grams") / NEAR_PART))
    step = F.when(F.col("diagonal") - F.lag("diagonal", 1, -(1 << 40)).over(order) > most, 1).otherwise(0)
    merged = by_diagonal.withColumn("step", step).withColumn("span", F.sum("step").over(order)).groupBy(*keys, "span")
    merged = merged.agg(F.flatten(F.collect_list("spots")).alias("spots"))
    places = F.size(F.array_distinct(F.transform("spots", lambda x: x["tpos"])))
    candidates = merged.withColumn("distinct", places / F.col("n_grams"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            share, first, last = [], [], []
            for found, n, d in zip(*(batch.column(c).to_pylist() for c in ("spots", "n_grams", "distinct")), strict=True):
                covered, a, b = chained([(x["pos"], x["tpos"]) for x in found]) if d >= enough else (0, 0, 0)
                share.append(covered / (n + K - 1) if d >= enough else min(d, 0.5) * 0.5)
                first.append(a)
                last.append(b)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "doc_id", "template", "label")), pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(share, pa.float64())], ["row", "doc_id", "template", "label", "start", "last", "share"])

    checked = candidates.select("row", "doc_id", "template", "label", "spots", "n_grams", "distinct").mapInArrow(verify, "row long, doc_id long, template int, label string, start long, last long, share double")
    sure = F.col("share") >= enough
    by = Window.partitionBy("row", "template", sure).orderBy("start", "last")
    apart = F.coalesce(F.col("start") > F.max("last").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    islands = checked.withColumn("island", F.sum(F.when(sure & apart, 1).otherwise(0)).over(by))
    whole = islands.groupBy("row", "doc_id", "template", "label", "island").agg(F.min("start").alias("start"), F.max("last").alias("last"), F.max("share").alias("share"))
    return whole.select("row", "doc_id", "template", "label", F.lit(False).alias("is_base"), "start", "last", "share")


def scan_licenses(docs: DataFrame, base: list | None = None, more: list | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and spans for each row of ``docs``.

    ``spans`` lists label:first:last (words from 0, the last one included) of everything found, by first, then last word, then label.
    """
    found = materialize(hits(docs, BASE if base is None else base, TEMPLATES + WHOLE if more is None else more), "license-hits")
    every = exact_phrases(found).unionByName(spans(found))
    header = F.col("template") < 0
    exact = F.col("is_base") & (F.col("share") >= 1)
    more_found = ~header & ~F.col("is_base") & (F.col("share") >= ENOUGH)
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("label")))), ",")
    return (
        every.groupBy("row")
        .agg(
            F.max("doc_id").alias("doc_id"),
            F.max(F.when(header, F.col("start"))).alias("n_words"),
            F.count_if(exact).alias("n_base"),
            F.min(F.when(exact, F.col("start"))).alias("first_word"),
            F.max(F.when(exact, F.col("start"))).alias("last_word"),
            listed(exact).alias("base_labels"),
            listed(exact | more_found).alias("labels"),
            F.coalesce(F.max(F.when(F.col("is_base") & ~exact, 0.5 * F.col("share")).otherwise(F.least(F.lit(1.0), "share"))), F.lit(0.0)).alias("score"),
            F.array_join(F.transform(F.array_sort(F.collect_set(F.when(exact | more_found, F.struct("start", "last", "label")))), lambda x: F.concat_ws(":", x["label"], x["start"], x["last"])), ",").alias("spans"),
        )
        .drop("row")
    )
