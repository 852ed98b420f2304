"""Personal data by bootstrapped contextual extraction.

Four kinds have forms of their own (e-mail addresses, IP addresses, card and phone numbers); what matches them is a seed. The words
before a seed, and the last of them with the seed's shape, are lexical patterns. Every other identifier-like token (letters and
digits, some of them digits) that stands behind a pattern is an instance of it. Patterns and instances form a graph, which is
scored in rounds: a pattern is as good as the share of its instances that are good, an instance as good as its patterns make
likely. Patterns of high confidence then mark the tokens behind them, also those that no form describes.

Texts are read once. Each document gives its seeds and tokens with hashes of their patterns and instances; the graph has one row
for each pattern and instance that ever meet, counted before the shuffle. Joins on patterns are plain joins of narrow rows, which
the adaptive skew join splits for patterns that stand before a large part of the instances.

Scans are linear in a text: runs of characters that can't match again are taken whole (possessive), and the contract's leftmost,
non-overlapping matches follow from where such runs begin.

Defined cases: a null or empty text has no findings; texts of any length, with any number of findings, are scanned whole; repeated
rows and null or repeated ids are rows of their own; patterns that tie are all taken; an empty table gives an empty result; further
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import materialize, slices, texts

#: The kinds in their order; the method's own kind comes last.
KINDS = ["email", "ip", "card", "phone"]
CONTEXT = "context"
#: The forms of the contract. The first takes whole runs, with an address behind them or not.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]++(@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++)?")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
#: A token that may be an identifier, its least digits, and its code points.
TOKEN = re.compile(r"[0-9A-Za-z][0-9A-Za-z._@/+-]*+")
LEAST_DIGITS, LEAST_SIZE, MOST_SIZE = 4, 6, 64
#: Code points before a token in which its words are looked for.
REACH = 48
WORD = re.compile(r"[^\W\d_]+")
#: Rounds of scoring; different seeds that a pattern needs; what counts against a pattern beside its instances; the least
#: confidence of a pattern whose instances are marked.
ROUNDS = 3
LEAST_SEEDS = 3
DOUBT = 1.0
SURE = 0.7

SPAN = "struct<kind_no:int,start:bigint,stop:bigint>"
ITEM = "struct<start:bigint,stop:bigint,instance:bigint,seed:boolean,patterns:array<bigint>>"


def luhn(digits: str) -> bool:
    """The check digit of card numbers: every second digit from the right is doubled."""
    backwards = [int(c) for c in reversed(digits)]
    doubled = sum(sum(divmod(2 * d, 10)) for d in backwards[1::2])
    return (sum(backwards[::2]) + doubled) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in EMAIL.finditer(text) if m.group(1)] if "@" in text else []


def addresses(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.group().split("."))]


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in CARD.finditer(text):
        if 16 <= len(m.group()) <= 37:  # a separator between any two digits at most
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in PHONE.finditer(text) if 8 <= len(DIGIT.findall(m.group())) <= 15]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the contract's kinds, by kind and then start."""
    out = [(0, a, b) for a, b in emails(text)]
    if DIGIT.search(text):
        out += [(1, a, b) for a, b in addresses(text)] + [(2, a, b) for a, b in cards(text)]
        out += [(3, a, b) for a, b in phones(text)] if "+" in text else []
    return out


def hashed(x: str) -> int:
    return int.from_bytes(blake2b(x.encode(), digest_size=8).digest(), "little", signed=True)


def shape(x: str) -> str:
    """Runs of digits as 9 and of letters as a, other characters as they are."""
    return re.sub(r"[^\W\d_]+", "a", re.sub(r"\d+", "9", x))


def patterns(text: str, start: int, stop: int) -> list[int]:
    """Hashes of the two words before a token, and of the last one with the token's shape; none at the start of a text."""
    begin = max(0, start - REACH)
    words = [m.group().lower() for m in WORD.finditer(text, begin, start) if m.start() > begin or not begin]
    if not words:
        return []
    return [hashed(f"{words[-1]}|{shape(text[start:stop])}"), *([hashed(f"{words[-2]} {words[-1]}")] if len(words) > 1 else [])]


def items(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, bool, list[int]]]:
    """(start, end, instance, seed, patterns) of the seeds and of the tokens that meet none of them."""
    seeds, upto = [], 0
    for a, b in sorted({(a, b) for _, a, b in base}):
        if a >= upto:  # of seeds that overlap, the first
            seeds.append((a, b))
            upto = b
    found = [(a, b, True) for a, b in seeds if b - a <= MOST_SIZE]
    if DIGIT.search(text):
        at = 0
        for m in TOKEN.finditer(text):
            a, b = m.start(), m.start() + len(m.group().rstrip("._@/+-"))
            if not LEAST_SIZE <= b - a <= MOST_SIZE or len(DIGIT.findall(text, a, b)) < LEAST_DIGITS:
                continue
            while at < len(seeds) and seeds[at][1] <= a:
                at += 1
            if at == len(seeds) or seeds[at][0] >= b:
                found.append((a, b, False))
    out = []
    for a, b, seed in found:
        own = patterns(text, a, b)
        if own:
            out.append((a, b, hashed("".join(c for c in text[a:b].lower() if c.isalnum())), seed, own))
    return out


def read(docs: DataFrame) -> DataFrame:
    """(row, doc_id, base, items) for each row of ``docs``: all that is kept of the texts."""
    kinds = [pa.list_(pa.struct([("kind_no", pa.int32()), ("start", pa.int64()), ("stop", pa.int64())])), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("instance", pa.int64()), ("seed", pa.bool_()), ("patterns", pa.list_(pa.int64()))]))]
    names = [[kinds[0].value_type[i].name for i in range(3)], [kinds[1].value_type[i].name for i in range(5)]]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            base, found = [], []
            for text in part.column("text").to_pylist():
                spans = base_spans(text)
                base.append([dict(zip(names[0], x, strict=True)) for x in spans])
                found.append([dict(zip(names[1], x, strict=True)) for x in items(text, spans)])
            yield pa.RecordBatch.from_arrays([part.column("row"), part.column("doc_id"), pa.array(base, kinds[0]), pa.array(found, kinds[1])], ["row", "doc_id", "base", "items"])

    named = texts(docs).withColumn("row", F.monotonically_increasing_id())
    return named.mapInArrow(scan, f"row long, doc_id long, base array<{SPAN}>, items array<{ITEM}>")


def edges(found: DataFrame) -> DataFrame:
    """(pattern, instance, seed): who meets whom, once."""
    each = found.select(F.explode("items").alias("x")).select("x.instance", "x.seed", F.explode("x.patterns").alias("pattern"))
    return each.groupBy("pattern", "instance").agg(F.max("seed").alias("seed"))


def confidence(scored: DataFrame) -> DataFrame:
    """(pattern, sure): the share of a pattern's instances that are good, for those with seeds enough; ``score`` is in millionths."""
    per = scored.groupBy("pattern").agg(F.sum("score").alias("good"), F.count(F.lit(1)).alias("n"), F.count_if("seed").alias("seeds"))
    return per.where(F.col("seeds") >= LEAST_SEEDS).select("pattern", (F.col("good") / 1e6 / (F.col("n") + DOUBT)).alias("sure"))


def judged(graph: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, sure) after some rounds over the graph (pattern, instance, seed).

    Seeds are certain. Another instance is wrong only if all of its patterns are: one less the product of their doubts. Sums
    are of whole millionths, so they don't depend on the order of rows.
    """
    seed_score = F.when(F.col("seed"), 1_000_000).otherwise(0)
    sure = materialize(confidence(graph.withColumn("score", seed_score)), "pii-patterns")
    for _ in range(rounds - 1):
        doubt = F.sum(F.round(F.log1p(-F.col("sure")) * 1e6).cast("long"))
        likely = graph.where(~F.col("seed")).join(sure, "pattern").groupBy("instance").agg(F.round((1 - F.exp(doubt / 1e6)) * 1e6).cast("long").alias("likely"))
        both = graph.join(likely, "instance", "left").withColumn("score", F.when(F.col("seed"), 1_000_000).otherwise(F.coalesce("likely", F.lit(0))))
        sure = materialize(confidence(both), "pii-patterns")
    return sure


def discovered(found: DataFrame, sure: DataFrame) -> DataFrame:
    """(row, spans): tokens behind a pattern of high confidence, in order."""
    tokens = found.select("row", F.explode("items").alias("x")).where(~F.col("x.seed")).select("row", "x.start", "x.stop", F.explode("x.patterns").alias("pattern"))
    marked = tokens.join(sure.where(F.col("sure") >= SURE).select("pattern"), "pattern", "left_semi").select("row", "start", "stop").distinct()
    span = F.struct(F.lit(len(KINDS)).alias("kind_no"), "start", "stop")
    return marked.groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("more"))


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, found): for each row of ``docs`` its spans (kind_no, start, stop), by kind and then start."""
    found = materialize(read(docs), "pii-found")
    graph = materialize(edges(found), "pii-graph")
    more = discovered(found, judged(graph))
    out = found.select("row", "doc_id", "base").join(more, "row", "left")
    return out.select("doc_id", F.concat("base", F.coalesce("more", F.array().cast(f"array<{SPAN}>"))).alias("found"))


def joined(found: Column) -> Column:
    names = F.array(*[F.lit(k) for k in [*KINDS, CONTEXT]])
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", names[x["kind_no"]], x["start"], x["stop"])), ",")


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans for each row of ``docs``."""

    def of_kind(no: int) -> Column:
        return F.size(F.filter("found", lambda x: x["kind_no"] == no)).cast("long")

    base = F.filter("found", lambda x: x["kind_no"] < len(KINDS))
    counts = [of_kind(no).alias(f"n_{kind}") for no, kind in enumerate(KINDS)]
    return personal_data(docs).select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))
