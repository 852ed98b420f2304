"""Measures that are sums over the words of a text, or that tell how many of its words differ.

Arrow splits a batch of texts into words and numbers them; what a word adds is found out once for each different word and summed
up for the rows by arrays. Words end at ASCII white space, so no run of letters, digits and underscores lies in two of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.functions.arrow import slices

#: Bytes of texts that are split at a time (a longer text is alone).
SLICE = 1 << 24

_LISTS = {"connectors": X.CONNECTORS, "hedges": X.HEDGES, "weak": X.WEAK}
for _lang, _listed in X.COMMON_WORDS.items():
    _LISTS |= {f"{_lang}_common": _listed, f"{_lang}_first": _listed[:5], f"{_lang}_stop": X.LANGUAGE_STOP_WORDS.get(_lang, _listed)}
#: The sums, in the order in which ``measured`` gives them.
SUMS = ["n_words", "n_syllables", "n_spoken", "contractions", "n_tokens", "nominal", *_LISTS]


def runs(words: pa.Array, kind: str) -> tuple[np.ndarray, pa.Array]:
    """The runs of a kind of characters (of a pattern's class) in some words, and the number of the word of each."""
    lists = pc.ascii_split_whitespace(pc.replace_substring_regex(words, f"[^{kind}]+", " "))
    found, word = lists.flatten(), pc.list_parent_indices(lists)
    some = pc.greater(pc.binary_length(found), 0)
    return word.filter(some).to_numpy(), found.filter(some)


def measured(words: pa.Array) -> np.ndarray:
    """What each of some words in lower case adds to the SUMS, by column."""
    count = lambda x, p: pc.count_substring_regex(x, p).to_numpy(zero_copy_only=False)
    told = lambda x: x.to_numpy(zero_copy_only=False)
    bare = pc.replace_substring_regex(words, X.PUNCTUATION, "")
    spoken = np.maximum(1, count(bare, "[aeiouy]+") - told(pc.ends_with(bare, "e")))
    own = [told(pc.not_equal(words, "")), np.where(told(pc.equal(bare, "")), 0, spoken), count(words, "[^.!?]+"), count(words, r"[\p{L}\p{N}_]+'[\p{L}\p{N}_]+")]
    word, tokens = runs(words, r"\p{L}\p{N}_")
    is_ = [np.ones(len(word)), told(pc.match_substring_regex(tokens, f".(?:{'|'.join(X.NOMINAL_ENDINGS)})$")), *(told(pc.is_in(tokens, pa.array(x))) for x in _LISTS.values())]
    return np.stack([*(x.astype(np.float64) for x in own), *(np.bincount(word, x, len(words)) for x in is_)])


def split(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The row and the number of each word of some texts, and the different words by number; an empty one may be among them."""
    lists = pc.ascii_split_whitespace(texts)
    coded = lists.flatten().dictionary_encode()
    return pc.list_parent_indices(lists).to_numpy(), coded.indices.to_numpy(), coded.dictionary


def _in_slices(texts: pa.Array, f, names: list[str]) -> pa.Array:
    parts = [f(part.column(0)) for part in slices(pa.RecordBatch.from_arrays([texts], ["text"]), "text", SLICE)]
    whole = np.concatenate(parts) if parts else np.zeros((0, len(names)), np.int64)
    return pa.StructArray.from_arrays([pa.array(whole[:, k]) for k in range(len(names))], names)


def sums(low: Column) -> Column:
    """A struct of the SUMS of a text in lower case that is not null."""
    def one(texts: pa.Array) -> np.ndarray:
        row, code, words = split(texts)
        return np.stack([np.bincount(row, x[code], len(texts)) for x in measured(words)], 1).astype(np.int64)

    @F.arrow_udf(", ".join(f"{n} long" for n in SUMS))
    def run(texts: pa.Array) -> pa.Array:
        return _in_slices(texts, one, SUMS)

    return run(low)


VARIETY = ["n", "n_different", "n_long", "n_academic"]


def variety(low: Column) -> Column:
    """A struct (VARIETY) of a text in lower case that is not null: its runs of letters, how many differ, have seven letters or more,
    and have an academic ending."""
    def one(texts: pa.Array) -> np.ndarray:
        row, code, words = split(texts)
        word, found = runs(words, r"\p{L}")
        size = np.bincount(word, minlength=len(words))
        add = lambda is_: np.bincount(word, is_.to_numpy(zero_copy_only=False), len(words))
        per = [size.astype(np.float64), add(pc.greater_equal(pc.utf8_length(found), 7)), add(pc.match_substring_regex(found, "(?:tion|ment|ness|ity|ism|ance|ence)$"))]
        coded = found.dictionary_encode()
        ids, kinds = coded.indices.to_numpy(), max(1, len(coded.dictionary))
        n, long_, academic = (np.bincount(row, x[code], len(texts)) for x in per)
        # different words of each row, then their runs
        pairs = np.unique(row.astype(np.int64) * max(1, len(words)) + code)
        r, c = pairs // max(1, len(words)), pairs % max(1, len(words))
        begin = np.cumsum(size) - size
        at = np.repeat(begin[c] - (np.cumsum(size[c]) - size[c]), size[c]) + np.arange(int(size[c].sum()))
        different = np.unique(np.repeat(r, size[c]) * kinds + ids[at]) // kinds
        return np.stack([n, np.bincount(different, minlength=len(texts)), long_, academic], 1).astype(np.int64)

    @F.arrow_udf(", ".join(f"{n} long" for n in VARIETY))
    def run(texts: pa.Array) -> pa.Array:
        return _in_slices(texts, one, VARIETY)

    return run(low)
