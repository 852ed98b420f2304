"""Spelling variants by permuterm rotations.

A word is marked with a terminator and all its rotations are listed. In the sorted rotations, words that differ in one code
point stand together: the rotation that ends with the edited character starts, before it, with everything else, and the
rotation of a word without that character is that very prefix. So each word lists its rotations twice: whole, and without
their last character (the edited one, which is skipped). Rows are dealt and sorted by these keys; a scan over the sorted rows
meets each group once. A group holds words that differ at one place, so it has at most one row for each letter of the alphabet
and one for the word without it, however large the table is. Each member gets the number of its neighbours in the group and
the best one, from the group's two best; no pairs are listed.

Words are known by their place in code-point order, so that long words are not copied with each of their rotations, and ties
go to the smallest number. Keys of words of over ``LONG`` code points are two 61-bit fingerprints of the rotation (equal keys
of different rotations have a chance of about 1 in 10**36 a pair).

Defined cases: a null or empty text has no words; a null doc_id is an empty string before the colon of the edit's checksum; texts
and words of any length are taken whole; rows repeated in the table count again; among near words with equal counts the smallest
in code-point order is the form; an empty table gives an empty result; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import materialize, texts

#: Letters of a word; one run in this many loses a letter; least code points and occurrences of a word.
LETTERS = "A-Za-zÀ-ÿ"
EDITED = 97
LEAST_LENGTH = 5
LEAST_COUNT = 3
#: Code points from which rotations are fingerprinted.
LONG = 64
#: A form has at least this many times the occurrences of its variant.
TIMES = 2
#: Not a letter, so no word holds it.
TERMINATOR = "$"
#: A Mersenne prime and two bases for fingerprints of rotations.
PRIME = (1 << 61) - 1
BASES = (1_000_003, 998_244_353)
#: What a row of the rotation table is: a whole rotation, one without its last character, and one whose last character equals
#: the character before it in the word (leaving either out gives the same shorter word, so only one of them counts as an indel).
WHOLE, CUT, CUT_AGAIN = 0, 1, 2
ROTATION = "key string, place long, n long, role int"


def upper_to_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    capitals = "".join(map(chr, range(65, 91)))
    return F.translate(text, capitals, capitals.lower())


def edited(doc_id: Column, run: Column) -> Column:
    """The run as the contract edits it: where EDITED divides its checksum, it loses one code point."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run))
    at = (h % F.char_length(run)).cast("int")
    return F.when(h % EDITED == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))).otherwise(run)


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): the edited words of all texts with their occurrences. Counts are summed before the shuffle."""
    runs = texts(docs).select("doc_id", F.explode(F.regexp_extract_all(upper_to_lower(F.col("text")), F.lit(f"[{LETTERS}]+"), F.lit(0))).alias("run"))
    # a run loses one code point at most
    words = runs.where(F.char_length("run") >= least_length).select(edited(F.col("doc_id"), F.col("run")).alias("word"))
    counted = words.where(F.char_length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= least_count)


def numbered(counts: DataFrame) -> DataFrame:
    """(place, word, n) with places in code-point order of the words, written once so that they stay what they are."""
    return materialize(counts.sort("word").select(F.monotonically_increasing_id().alias("place"), "word", "n"), "spelling-words")


def fingerprints(word: str) -> tuple[list[str], list[str]]:
    """Keys of the whole and of the cut rotations of a long word, in time and space linear in its length."""
    doubled, n = word + TERMINATOR + word, len(word)
    sums, powers = [], []
    for base in BASES:
        total, power, s, p = 0, 1, [0], [1]
        for c in doubled:
            total = (total * base + ord(c)) % PRIME
            power = power * base % PRIME
            s.append(total)
            p.append(power)
        sums.append(s)
        powers.append(p)

    def key(start: int, length: int) -> str:
        return f"{length}" + "".join(f":{(s[start + length] - s[start] * p[length]) % PRIME:x}" for s, p in zip(sums, powers, strict=True))

    return [key(i, n + 1) for i in range(n + 1)], [key(i, n) for i in range(1, n + 1)]


def keys_of(word: str) -> tuple[list[str], list[str]]:
    """Keys of the whole rotations, and of those without their last character by the place of that character in the word.

    Whole rotations of a word have the length of the cut ones of words with a letter more, so keys of one length are
    always made in one way.
    """
    n = len(word)
    doubled = word + TERMINATOR + word
    if n < LONG:
        return [doubled[i : i + n + 1] for i in range(n + 1)], [doubled[i : i + n] for i in range(1, n + 1)]
    whole, cut = fingerprints(word)
    return whole, cut if n > LONG else [doubled[i : i + n] for i in range(1, n + 1)]


def rotations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rotations of the words of (place, word, n), as rows of ROTATION, in parts of bounded size."""
    for batch in batches:
        keys: list[str] = []
        roles: list[int] = []
        places: list[int] = []
        counts: list[int] = []
        for place, word, n in zip(batch.column("place").to_pylist(), batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
            whole, cut = keys_of(word)
            keys += whole
            keys += cut
            roles += [WHOLE] * len(whole)
            roles += [CUT_AGAIN if i and word[i] == word[i - 1] else CUT for i in range(len(word))]
            places += [place] * (2 * len(word) + 1)
            counts += [n] * (2 * len(word) + 1)
            if len(keys) > 50_000:
                yield rotation_batch(keys, places, counts, roles)
                keys, roles, places, counts = [], [], [], []
        if keys:
            yield rotation_batch(keys, places, counts, roles)


def rotation_batch(keys: list, places: list, counts: list, roles: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(places, pa.int64()), pa.array(counts, pa.int64()), pa.array(roles, pa.int32())], ["key", "place", "n", "role"])


def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbours within each group of rows sorted by key: (place, near, best_n, best) for rows that have any."""
    kept = None
    for batch in batches:
        table = batch if kept is None else pa.concat_batches([kept, batch])
        if not len(table):
            continue
        key = table.column("key")
        new = np.concatenate([[True], pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)])
        last = int(np.flatnonzero(new)[-1])  # the last group may go on in the next batch
        if last:
            yield neighbours(table.slice(0, last), new[:last])
        kept = table.slice(last)
    if kept is not None and len(kept) > 1:
        yield neighbours(kept, np.concatenate([[True], np.zeros(len(kept) - 1, bool)]))


def neighbours(table: pa.RecordBatch, new: np.ndarray) -> pa.RecordBatch:
    """One row for each member of a group that has a near word in it: how many, and the best of them."""
    group = np.cumsum(new) - 1
    size = np.bincount(group)
    more = size[group] > 1
    group = group[more]
    place, n, role = (table.column(c).to_numpy()[more] for c in ("place", "n", "role"))
    order = np.lexsort((place, -n, group))  # best first within a group
    group, place, n, role = group[order], place[order], n[order], role[order]
    groups = len(size)
    cut, indel, whole = role != WHOLE, role == CUT, role == WHOLE
    none = len(place)

    def nth(mask: np.ndarray, skip: int) -> np.ndarray:
        """Row of the first member with the mask in each group, or the one after ``skip`` of them; none if there is no such row."""
        rows = np.flatnonzero(mask)
        begin = np.searchsorted(group[rows], np.arange(groups)) + skip
        ok = begin < len(rows)
        ok[ok] &= group[rows[begin[ok]]] == np.flatnonzero(ok)
        out = np.full(groups, none)
        out[ok] = rows[begin[ok]]
        return out

    n_cut, n_indel, n_whole = (np.bincount(group[m], minlength=groups) for m in (cut, indel, whole))
    row = np.arange(len(place))
    first, second = nth(cut, 0)[group], nth(cut, 1)[group]
    other = np.where(first == row, second, first)  # rows are in order of rank, so the smaller row number is the better word
    best = np.where(whole, nth(indel, 0)[group], np.where(indel, np.minimum(other, nth(whole, 0)[group]), other))
    near = np.where(whole, n_indel[group], n_cut[group] - 1 + np.where(indel, n_whole[group], 0))
    has = near > 0
    return pa.RecordBatch.from_arrays([pa.array(place[has]), pa.array(near[has]), pa.array(n[best[has]]), pa.array(place[best[has]])], ["place", "near", "best_n", "best"])


def nearest(words: DataFrame) -> DataFrame:
    """(place, n_near, best_n, best) for each word of (place, word, n) that has near words."""
    every = words.mapInArrow(rotations, ROTATION)
    ordered = every.repartition("key").sortWithinPartitions("key")
    found = ordered.mapInArrow(scanned, "place long, near long, best_n long, best long")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), "best"))
    return found.groupBy("place").agg(F.sum("near").alias("n_near"), best.alias("x")).select("place", "n_near", (-F.col("x.n")).alias("best_n"), F.col("x.best").alias("best"))


def roots(links: DataFrame) -> DataFrame:
    """(place, root) for links (place, form) that form a forest: pointers are doubled until none moves.

    A form has at least TIMES the count of its variant, so a chain is no longer than the logarithm of the largest count.
    """
    now = materialize(links.select("place", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = now.select(F.col("place").alias("root"), F.col("root").alias("next"))
        then = materialize(now.join(ahead, "root", "left").select("place", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        if then.where("moved").isEmpty():
            return then.select("place", "root")
        now = then.select("place", "root")


def variants(counts: DataFrame, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near and form_n for each row of (word, n), whose words are distinct."""
    words = numbered(counts)
    met = words.join(nearest(words), "place", "left")
    is_form = F.col("best_n") >= times * F.col("n")
    met = materialize(met.select("place", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best")).alias("to"), F.when(is_form, F.col("best_n")).alias("form_n")), "spelling-near")
    links = met.where(F.col("to").isNotNull()).select("place", F.col("to").alias("form"))
    ends = roots(links).withColumnRenamed("root", "end")
    named = words.select(F.col("place").alias("to"), F.col("word").alias("form"))
    last = words.select(F.col("place").alias("end"), F.col("word").alias("root"))
    out = met.join(ends, "place", "left").join(named, "to", "left").join(last, "end", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """The words of all texts with their near words, the form each one is a variant of, and the root of its group."""
    return variants(word_counts(docs))


def groups(found: DataFrame) -> DataFrame:
    """(root, words, n): how many spellings each group has and how often they occur, from the result of ``variants``."""
    return found.groupBy("root").agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("n"))
