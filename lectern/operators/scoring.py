"""Document scorers: readability, tone, clarity, structure and an overall quality level for each text.

Sums over words are taken by word numbers on Arrow batches (see ``functions.words``), other counts by patterns over the whole text.
"""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import academic, words
from lectern.functions import citations as C
from lectern.functions import text as X

#: Weights of the overall score.
WEIGHTS = {"readability": 0.15, "coherence": 0.2, "completeness": 0.15, "tone": 0.15, "citations": 0.1, "structure": 0.1, "clarity": 0.1, "conciseness": 0.05}


def counted(df: DataFrame, column: str = "text") -> DataFrame:
    """Adds the counts that most scorers need, and the sums over words (``sums``) that some take theirs from."""
    t = X.text_of(column)
    count = lambda c, p: F.regexp_count(c, F.lit(p)).cast("long")
    out = df.withColumn("sums", words.sums(F.lower(t)))
    return out.withColumns({
        "n_words": F.col("sums.n_words"), "n_sentences": count(t, r"[^.!?]*[^\s.!?][^.!?]*"), "n_spoken": F.col("sums.n_spoken"), "n_tokens": F.col("sums.n_tokens"),
        "n_syllables": F.col("sums.n_syllables"), "n_long": count(t, r"\S{7,}"), "n_points": F.char_length(t), "n_trimmed": F.char_length(F.trim(t)),
    })


def readability(df: DataFrame) -> DataFrame:
    """Adds ease, grade and the academic readability score to a counted table."""
    ease = X.flesch(F.col("n_words"), F.col("n_sentences"), F.col("n_syllables"))
    return df.withColumns({"ease": ease, "grade": X.grade(F.col("n_words"), F.col("n_sentences"), F.col("n_syllables")), "readability": X.academic_readability(ease, F.col("n_points"))})


def languages() -> Column:
    """(score, rank, lang) of each language in a counted table, the highest first; ties go to the listed order.

    0.4 for the share of common words, 0.3 for that of the first five of them (at most 1), 0.3 for that of stop words.
    """
    share = lambda listed: X.ratio(F.col(f"sums.{listed}"), F.col("n_tokens"))
    scores = []
    for i, name in enumerate(X.COMMON_WORDS):
        score = 0.4 * share(f"{name}_common") + 0.3 * F.least(F.lit(1.0), share(f"{name}_first")) + 0.3 * share(f"{name}_stop")
        scores.append(F.struct(score.alias("score"), F.lit(-i).alias("rank"), F.lit(name).alias("lang")))
    return F.sort_array(F.array(*scores), asc=False)


def tone(column: str = "text") -> Column:
    """Connectors, hedges and nominalisations for, weak words and contractions against, each by word."""
    t, of = X.text_of(column), lambda name: F.col(f"sums.{name}")
    good = of("connectors") + X.phrase_count(t, X.CONNECTOR_PHRASES) + of("hedges") + of("nominal")
    bad = of("weak") + X.phrase_count(t, X.WEAK_PHRASES) + of("contractions")
    return X.clamp(100 * X.ratio(good, F.col("n_words")) - 50 * X.ratio(bad, F.col("n_words")))


def clarity() -> Column:
    """0.6 by the mean length of sentences (best 15 to 25 words), 0.4 by the share of words longer than six characters (best 30 to 50 %)."""
    mean, share = X.ratio(F.col("n_spoken"), F.col("n_sentences")), X.ratio(F.col("n_long"), F.col("n_words"))
    length = F.when(mean.between(15, 25), 100.0).when(mean.between(10, 35), 80.0).otherwise(F.greatest(F.lit(0.0), 100 - 2 * F.abs(mean - 20)))
    hard = F.when(share.between(0.3, 0.5), 100.0).otherwise(F.greatest(F.lit(0.0), 100 - 200 * F.abs(share - 0.4)))
    return F.when(F.col("n_sentences") == 0, 0.0).otherwise(0.6 * length + 0.4 * hard)


def conciseness(column: str = "text") -> Column:
    """100 less ten for each wordy phrase in a hundred words; 0 for an empty text."""
    found = sum((X.phrase_count(X.text_of(column), [p]) for p in X.WORDY), F.lit(0))
    return F.when(F.col("n_points") == 0, 0.0).otherwise(F.greatest(F.lit(0.0), 100 - 10 * found / F.greatest(F.col("n_words") / 100, F.lit(1.0))))


def coherence(text: Column, separator: str = "\n") -> Column:
    """0.4 for the share of paragraphs with a linking phrase, 0.6 for the mean share of the text's twenty most frequent words
    (ASCII letters, four or more, repeated; the earlier one on ties) that a paragraph contains; 50 for fewer than two paragraphs.

    Words are counted and looked up within the row, on Arrow batches: nothing is shuffled, and the text is read once.
    """

    def score(low: str) -> float:
        parts = [p for p in (x.strip(" ") for x in low.split(separator)) if p]
        if len(parts) < 2:
            return 50.0
        counts = Counter(w for w in re.findall(r"\w+", " ".join(parts)) if len(w) >= 4 and w.isascii() and w.isalpha())
        # equal counts stay in the order in which words first stand
        top = sorted((w for w, n in counts.items() if n > 1), key=lambda w: -counts[w])[:20]
        linked = sum(any(x in p for x in X.TRANSITION_PARTS) for p in parts)
        topic = sum(w in p for p in parts for w in top) / len(top) / len(parts) if top else 0.0
        return max(0.0, min(100.0, 100 * (0.4 * linked / len(parts) + 0.6 * topic)))

    @F.pandas_udf("double")
    def scores(low: pd.Series) -> pd.Series:
        return low.map(score).astype(float)

    return scores(F.lower(X.text_of(text)))


def head_coverage(low: Column) -> Column:
    """How many percent of a text's frequent academic words stand in its first line; 50 without such words.

    Of the fifty most frequent words (ASCII letters, four or more; the earlier one on ties), the first twenty that have five letters
    or more, stand more than three times and have an academic ending. Words are counted within the row, as in ``coherence``.
    """

    def score(text: str | None) -> float:
        found = lambda x: [w for w in re.findall(r"\w+", x or "") if len(w) >= 4 and w.isascii() and w.isalpha()]
        top = Counter(found(text)).most_common(50)  # equal counts stay in the order in which words first stand
        keys = [w for w, n in top if n > 3 and len(w) > 4 and w.endswith(("tion", "ment", "ness", "ity", "ism"))][:20]
        head = set(found(text.split("\n", 1)[0])) if keys else set()
        return 100.0 * sum(w in head for w in keys) / len(keys) if keys else 50.0

    @F.pandas_udf("double")
    def scores(texts: pd.Series) -> pd.Series:
        return texts.map(score).astype(float)

    return scores(low)


def vocabulary(column: str = "text") -> Column:
    """40 for long words (7 letters or more), 30 for variety, 30 for academic endings."""
    of = lambda name: X.ratio(v[name], v["n"])
    v = words.variety(F.lower(X.text_of(column)))
    return 40 * of("n_long") + 30 * of("n_different") + 30 * of("n_academic")


def overall(df: DataFrame, column: str = "text") -> DataFrame:
    """Adds the eight single scores, their weighted sum and its level to each row of a table.

    A text is one section whose title is its first line; without a known title it has the score of an untitled one.
    """
    t = X.text_of(column)
    title = academic.section_type(F.substring_index(t, "\n", 1))
    cited = sum((F.regexp_count(t, F.lit(p)) for p in C.STYLES.values()), F.lit(0))
    counts = readability(counted(df, column).withColumn("coherence", coherence(F.col(column))))
    scored = counts.withColumns({
        "tone": tone(column), "clarity": clarity(), "conciseness": conciseness(column), "completeness": academic.completeness(F.array(title)),
        "citations": academic.citation_quality(cited, F.col("n_words")), "structure": F.when(title == "unknown", 0.0).otherwise(70.0) + 30.0,
    })
    mean = sum((F.col(c) * w for c, w in WEIGHTS.items()), F.lit(0.0))
    return scored.withColumn("overall", mean).withColumn("level", X.level(F.col("overall"), X.QUALITY_LEVELS, "critical"))


def keywords(df: DataFrame, keys: list[str], column: str, top: int) -> DataFrame:
    """The most frequent tokens (four letters or more, no stop words) of each group; ties by the alphabet.

    Counts are combined before the shuffle, and the rank is cut in the window, so no group is gathered.
    """
    tok = df.select(*keys, F.explode(X.tokens(X.text_of(column))).alias("term"))
    tok = tok.where((F.char_length("term") >= 4) & ~F.col("term").isin(X.STOP_WORDS))
    counts = tok.groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), "term")
    return counts.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= top)


def entropy(df: DataFrame, key: str, column: str = "text") -> DataFrame:
    """Shannon entropy of the bytes of each text, in bits, counted within the row: nothing is shuffled."""
    import numpy as np
    import pyarrow as pa

    from lectern.functions.arrow import byte_views

    def run(batches):
        for batch in batches:
            raw, ends = byte_views(batch.column("text"))
            out = []
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                n = np.bincount(raw[a:b], minlength=256)
                n = n[n > 0] / max(1, b - a)
                out.append(float(-(n * np.log2(n)).sum()) if len(n) else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(out, pa.float64())], [key, "entropy"])

    named = df.select(key, X.text_of(column).alias("text"))
    return named.mapInArrow(run, named.drop("text").schema.add("entropy", "double"))


def chunks(column: str, separator: str, most: int) -> Column:
    """Paragraphs packed greedily, in order, while a chunk stays within ``most`` estimated tokens."""
    paragraphs = X.lines(X.text_of(column), separator)
    none = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc: Column, p: Column) -> Column:
        joined = F.when(acc["open"] == "", p).otherwise(F.concat(acc["open"], F.lit("\n\n"), p))
        fits = (acc["open"] == "") | (X.estimated_tokens(joined) <= most)
        return F.struct(F.when(fits, acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))).alias("done"), F.when(fits, joined).otherwise(p).alias("open"))

    return F.aggregate(paragraphs, none, step, lambda acc: F.when(acc["open"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))))
