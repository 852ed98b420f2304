"""Toxicity by maximum-scoring segments of token log-odds.

Units are whole words and their first four to eight bytes, so that inflected forms share evidence. Unit counts of
labelled documents (of those with one MinHash, the ones that are verified near copies of one of them count once) give log-odds under
an informative Dirichlet prior (the prior is the pooled corpus); units that are
surely more frequent in toxic documents keep their log-odds as weight, every other word has a small negative one. The
linear-time scan of Ruzzo and Tompa then finds all maximal scoring segments of a text. Karlin-Altschul statistics turn
a segment's score into the number of such segments expected by chance in a clean text of that length (lambda is the
root of the background's moment generating function, K is set from the clean training documents), and the document's
evidence, the sum over its significant segments, becomes a probability by a logistic fit on training documents. Scattered
evidence counts too: how far the sum of all weights lies above what a clean text of that length has, in deviations.

The model learns from at most ``max_labelled`` labelled rows (chosen by a hash of their id; the bound keeps the
broadcast of labels, and the units that such a sample can single out, bounded). All texts are scored whole.

Defined cases: very long texts are scored whole, in slices of their own; texts with the same evidence tie in score, whatever
their ids; a null or empty text has no segment and gets the score of no evidence; rows of labels without a doc_id
or toxic value are left out, and of contradicting labels for one id the higher counts; null and repeated doc_ids are
rows like others (a null id is never held out); without labels of both classes every score is 0; an empty table gives
an empty result; further columns are ignored, and lang, source and doc_id are never looked at for a score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import materialize, slices, texts
from lectern.llm.minhash import PERCENT, shingle_sets
from lectern.llm.textops import distinct_per_doc, lower_ascii, mix, prefix_sums, runs, span_hash, views

#: Labelled rows that a model learns from at most.
MAX_LABELLED = 20_000
#: Least z-score and log-odds of a unit.
MIN_Z, MIN_LOG_ODDS = 3.5, 1.5
#: Bytes of the prefixes that are units.
PREFIXES = (4, 5, 6, 7, 8)
#: Weight of every other word: a toxic passage is taken to have about one toxic word in five.
BACKGROUND = math.log(0.8)
#: Strength of the prior, in documents.
PRIOR = 50.0


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def unit_hashes(col: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of each word and of its prefixes (0 where the word is no longer than the prefix), and the word's document."""
    raw, off = views(col)
    raw = lower_ascii(raw)
    if len(raw) > 1:  # capital letters of Latin-1, whose first byte is C3
        upper = (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97) & (raw[:-1] == 0xC3)
        raw[1:][upper] += 32
    starts, ends, docs = runs((raw >= 128) | (raw >= 97) & (raw <= 122), off)
    sums = prefix_sums(raw)
    out = [span_hash(sums, starts, ends)]
    for n in PREFIXES:
        h = span_hash(sums, starts, np.minimum(starts + n, ends)) ^ np.uint64(n)
        out.append(np.where(ends - starts > n, h, np.uint64(0)))
    return out, docs


def maximal_segments(positions: np.ndarray, weights: np.ndarray, background: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first word, last word, score), in one pass over the words with positive weight.

    Words between them weigh ``background`` each. A candidate is kept with the totals before it (l) and up to its end
    (r); a new one is joined with the latest candidate of smaller l if that makes it larger, as long as it does.
    """
    kept: list[list[float]] = []  # first, last, l, r
    total, at = 0.0, -1
    for p, w in zip(positions.tolist(), weights.tolist(), strict=True):
        total += background * (p - at - 1)
        new, at = [p, p, total, total + w], p
        total += w
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= new[2]:
                j -= 1
            if j < 0 or kept[j][3] >= new[3]:
                break
            new = [kept[j][0], new[1], kept[j][2], new[3]]
            del kept[j:]
        kept.append(new)
    return [(int(a), int(b), r - left) for a, b, left, r in kept]


@dataclass
class Model:
    units: np.ndarray
    weights: np.ndarray
    decay: float  # lambda
    log_k: float
    mean: float  # of the weights of a clean text's words, and their variance
    variance: float
    fit: tuple[float, float, float]  # intercept, and slopes of both kinds of evidence

    def segments(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray, list[list[tuple[int, int, float]]]]:
        """How many words each text has, the sum of their positive weights, and its maximal segments."""
        hashes, docs = unit_hashes(col)
        n_words = np.bincount(docs, minlength=len(col)) if len(docs) else np.zeros(len(col), np.int64)
        out: list[list[tuple[int, int, float]]] = [[] for _ in range(len(col))]
        best = np.zeros(len(docs))
        for h in hashes if len(self.units) else []:
            at = np.minimum(np.searchsorted(self.units, h), len(self.units) - 1)
            best = np.maximum(best, np.where(self.units[at] == h, self.weights[at], 0.0))
        hits = np.flatnonzero(best)
        first = np.cumsum(n_words) - n_words
        for group in np.split(hits, np.flatnonzero(np.diff(docs[hits])) + 1) if len(hits) else []:
            d = int(docs[group[0]])
            out[d] = maximal_segments(group - first[d], best[group], BACKGROUND)
        return n_words, np.bincount(docs, best, len(col)) if len(docs) else np.zeros(len(col)), out

    def evidence(self, n_words: int, found: list[tuple[int, int, float]]) -> tuple[float, int]:
        """Sum of -log(expected number by chance) over significant segments, and how many there are."""
        excess = [self.decay * s - self.log_k - math.log(max(1, n_words)) for _, _, s in found]
        return sum(x for x in excess if x > 0), sum(x > 0 for x in excess)

    def features(self, n_words: np.ndarray, total: np.ndarray, found: list) -> np.ndarray:
        """Two columns: segment evidence and total evidence."""
        first = np.sqrt([self.evidence(int(n), f)[0] for n, f in zip(n_words, found, strict=True)]) if len(found) else np.zeros(0)
        return np.stack([first, (total - n_words * self.mean) / np.sqrt(n_words * self.variance + 1)], 1)

    def binned(self, n_words: np.ndarray, total: np.ndarray, found: list) -> np.ndarray:
        """The features in sixths between -5 and 20: for the fit alone, so that it reads a histogram of bounded size."""
        return np.rint(np.clip(self.features(n_words, total, found), -5, 20) * 6) / 6

    def probability(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.fit[0] + features @ np.array(self.fit[1:]), -30, 30)))

    def scores(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray, list]:
        n_words, total, found = self.segments(col)
        return self.probability(self.features(n_words, total, found)), n_words, found


EMPTY = Model(np.zeros(0, np.uint64), np.zeros(0), 1.0, 0.0, 0.0, 0.0, (-30.0, 0.0, 0.0))


def sample_of(labels: DataFrame, max_labelled: int) -> DataFrame:
    """(label_id, toxic): training rows, at most ``max_labelled``, by the hash of their ids."""
    known = labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col("toxic").cast("int").alias("toxic")).dropna()
    known = known.where(~held_out("label_id")).groupBy("label_id").agg(F.max("toxic").alias("toxic"))
    return known.orderBy(F.xxhash64("label_id"), "label_id").limit(max_labelled)


def unit_counts(train: DataFrame) -> DataFrame:
    """(unit, toxic_docs, clean_docs), summed within each slice first; unit 0 counts the documents, unit 1 clean words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            toxic = part.column("toxic").to_numpy(zero_copy_only=False).astype(bool)
            hashes, docs = unit_hashes(part.column("text"))
            h, d = distinct_per_doc(np.concatenate(hashes), np.tile(docs, len(hashes)))
            h, d = h[h > 1], d[h > 1]
            units, number = np.unique(h, return_inverse=True)
            ones = np.bincount(number, toxic[d], len(units)).astype(np.int64)
            zeros = np.bincount(number, ~toxic[d], len(units)).astype(np.int64)
            words = np.array([int(toxic[docs].sum()), int((~toxic[docs]).sum())]) if len(docs) else np.zeros(2, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([[0, 1], units.view(np.int64)])), pa.array(np.concatenate([[int(toxic.sum()), words[0]], ones])), pa.array(np.concatenate([[int((~toxic).sum()), words[1]], zeros]))],
                ["unit", "toxic_docs", "clean_docs"],
            )

    rows = train.select("text", "toxic").mapInArrow(count, "unit long, toxic_docs long, clean_docs long")
    return rows.groupBy("unit").agg(F.sum("toxic_docs").alias("toxic_docs"), F.sum("clean_docs").alias("clean_docs"))


def root(weights: np.ndarray, share: np.ndarray, background: float) -> float:
    """lambda > 0 with sum of share * exp(lambda * weight) = 1 over toxic units and the background."""
    rest = max(1e-9, 1 - share.sum())
    value = lambda x: float((share * np.exp(np.minimum(700, x * weights))).sum() + rest * math.exp(x * background) - 1)
    low, high = 1e-6, 1.0
    while value(high) < 0 and high < 64:
        high *= 2
    if value(low) >= 0:
        return 0.1
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if value(mid) < 0 else (low, mid)
    return low


def training(docs: DataFrame, labels: DataFrame, max_labelled: int) -> DataFrame:
    """(text, toxic) of the training rows; verified near copies of one text with the same MinHash and label count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            values, owner = shingle_sets(part.column("text"))
            n = np.bincount(owner, minlength=part.num_rows) if len(owner) else np.zeros(part.num_rows, np.int64)
            keys = np.zeros(part.num_rows, np.uint64)
            full = np.flatnonzero(n)
            if len(full):
                keys[full] = np.minimum.reduceat(mix(values), (np.cumsum(n) - n)[full])
            yield pa.RecordBatch.from_arrays([part.column("text"), part.column("toxic"), pa.array(keys.view(np.int64))], ["text", "toxic", "key"])

    sample = sample_of(labels, max_labelled)
    rows = texts(docs).join(F.broadcast(sample), F.col("doc_id") == F.col("label_id")).select("text", "toxic")
    keyed = materialize(rows.mapInArrow(run, "text string, toxic int, key long"), "labelled")
    leaders = keyed.groupBy("key", "toxic").agg(F.min("text").alias("lead"))

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            (va, da), (vb, db) = shingle_sets(part.column("text")), shingle_sets(part.column("lead"))
            v, d = np.concatenate([va, vb]), np.concatenate([da, db])
            order = np.lexsort((v, d))
            v, d = v[order], d[order]
            shared = np.bincount(d[1:][(v[1:] == v[:-1]) & (d[1:] == d[:-1])], minlength=part.num_rows)
            union = np.bincount(d, minlength=part.num_rows) - shared
            yield part.select(["text", "toxic"]).filter(pa.array(100 * shared < PERCENT * union))

    others = keyed.join(leaders, ["key", "toxic"]).where("text <> lead").select("text", "toxic", "lead").mapInArrow(apart, "text string, toxic int")
    return materialize(leaders.select(F.col("lead").alias("text"), "toxic").unionByName(others), "training")


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """Learn from the training rows of ``labels``.

    The driver holds the units that stand out in the bounded sample, and two histograms.
    """
    train = training(docs, labels, max_labelled)
    counts = materialize(unit_counts(train), "unit-counts")
    totals = {r["unit"]: (int(r["toxic_docs"]), int(r["clean_docs"])) for r in counts.where("unit in (0, 1)").collect()}
    (n1, n0), (_, clean_words) = totals.get(0, (0, 0)), totals.get(1, (0, 0))
    if not n1 or not n0:
        return EMPTY
    a1 = F.col("toxic_docs") + PRIOR * (F.col("toxic_docs") + F.col("clean_docs")) / (n1 + n0)
    a0 = F.col("clean_docs") + PRIOR * (F.col("toxic_docs") + F.col("clean_docs")) / (n1 + n0)
    odds = lambda a, n: F.log(a / F.greatest(F.lit(n + PRIOR) - a, F.lit(0.5)))
    scored = counts.where("unit not in (0, 1) and toxic_docs > 1").withColumn("log_odds", odds(a1, n1) - odds(a0, n0)).withColumn("z", F.col("log_odds") / F.sqrt(1 / a1 + 1 / a0))
    top = scored.where((F.col("z") >= MIN_Z) & (F.col("log_odds") >= MIN_LOG_ODDS)).select("unit", "log_odds", "clean_docs").collect()
    if not top:
        return EMPTY
    units = np.array([r["unit"] for r in top], np.int64).view(np.uint64)
    order = np.argsort(units)
    weights = np.array([r["log_odds"] for r in top])[order]
    share = np.array([r["clean_docs"] for r in top])[order] / max(1, clean_words) + 1e-9
    model = Model(units[order], weights, root(weights, share, BACKGROUND), 0.0, 0.0, 0.0, (0.0, 0.0, 0.0))
    clean = histogram(train.where("toxic = 0"), model, best_and_sum)
    n_docs = max(1, sum(clean.values()))
    # K: so that a clean training text has one chance segment in expectation where its best excess is on average
    model.log_k = math.log(max(1e-6, sum(math.exp(min(b, 20.0)) * n for (_, b, _), n in clean.items()) / n_docs))
    model.mean = sum(x * n for (_, _, x), n in clean.items()) / n_docs
    model.variance = sum((x - model.mean) ** 2 * n for (_, _, x), n in clean.items()) / n_docs * max(1.0, clean_words / n_docs)
    model.fit = logistic(histogram(train, model, Model.binned))
    return model


def best_and_sum(model: Model, n_words: np.ndarray, total: np.ndarray, found: list) -> np.ndarray:
    """Excess of the best segment, and mean weight of the words (to 1/120)."""
    best = np.array([max((model.decay * s for _, _, s in f), default=0.0) - math.log(max(1, n)) for n, f in zip(n_words, found, strict=True)])
    return np.stack([np.rint(np.clip(best, -20, 20) * 6) / 6, np.rint(np.minimum(total / np.maximum(n_words, 1), 4) * 120) / 120], 1)


def histogram(train: DataFrame, model: Model, measure) -> dict[tuple[int, float, float], int]:
    """How many training documents of each label have each pair of rounded values: as many rows as bins at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            values = measure(model, *model.segments(part.column("text")))
            yield pa.RecordBatch.from_arrays([part.column("toxic"), pa.array(values[:, 0]), pa.array(values[:, 1])], ["toxic", "x", "y"])

    rows = train.select("text", "toxic").mapInArrow(run, "toxic int, x double, y double").groupBy("toxic", "x", "y").count().collect()
    return {(int(r["toxic"]), r["x"], r["y"]): int(r["count"]) for r in rows}


def logistic(seen: dict[tuple[int, float, float], int]) -> tuple[float, float, float]:
    """Intercept and slopes (not negative) of a lightly regularised logistic fit of the label on both measures."""
    y, a, b, n = (np.array(c, float) for c in zip(*((t, x, z, k) for (t, x, z), k in seen.items()), strict=True))
    used = [True, True]
    while True:
        x = np.stack([np.ones(len(a)), a * used[0], b * used[1]], 1)
        beta, ridge = np.zeros(3), np.array([0.01, 0.1, 0.1])
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            w = n * np.maximum(p * (1 - p), 1e-9)
            step = np.clip(np.linalg.solve((x * w[:, None]).T @ x + np.diag(ridge), x.T @ (n * (y - p)) - ridge * beta), -2, 2)
            beta = beta + step
            if abs(step).max() < 1e-6:
                break
        bad = [k for k in (0, 1) if used[k] and beta[k + 1] < 0]
        if not bad:
            return tuple(float(v) for v in beta)
        used[bad[0]] = False


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, n_segments and the best segment's first and last word (null without one), for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            p, n_words, found = shared.value.scores(part.column("text"))
            both = [shared.value.evidence(int(n), f) for n, f in zip(n_words, found, strict=True)]
            best = [max(f, key=lambda s: s[2], default=(None, None, 0.0)) for f in found]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(p), pa.array([k for _, k in both], pa.int64()), pa.array([b[0] for b in best], pa.int64()), pa.array([b[1] for b in best], pa.int64())],
                ["doc_id", "score", "n_segments", "best_first", "best_last"],
            )

    return texts(docs).mapInArrow(run, "doc_id long, score double, n_segments long, best_first long, best_last long")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted and the segments' figures for each document."""
    out = score(docs, fit(docs, labels))
    return out.withColumn("held_out", held_out()).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose text scores below the threshold, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield part.filter(pa.array(shared.value.scores(part.column("text"))[0] < threshold))

    return docs.mapInArrow(run, docs.schema)
