"""Whole-text encoding by a public tokenizer that encodes each distinct unit once.

A text is cut where an ASCII white-space character follows a character that is not white space, and between ASCII letters
and punctuation. Both vocabularies split there whatever stands around it, so the units (white space and the word after it, or a run of punctuation) can be encoded one by one, and
Arrow's dictionary encoding finds the distinct ones. A bounded cache keeps units between batches. Texts with special
token strings or with white space outside ASCII are passed to the library as they are.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lectern.llm.textops import gather, lower_ascii, views

#: Units that a worker keeps; when there are more it starts anew (the cache only saves work).
CACHE_UNITS = 500_000
#: White space outside ASCII, next to which a cut could be wrong.
ODD_SPACE = r"[\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[b for b in range(33, 127) if not chr(b).isalnum() and b != 39]] = True


def units(col: pa.Array, words_only: bool) -> tuple[pa.Array, np.ndarray]:
    """All units of the texts one after another, and how many units each text has.

    A unit starts where white space follows something else, and between an ASCII letter and ASCII punctuation other
    than the apostrophe. ``words_only`` leaves the white space out and turns A-Z to lower case.
    """
    raw, off = views(col)
    n = len(raw)
    if not n:
        return pa.array([], pa.string()), np.zeros(len(col), np.int64)
    space, letter, mark = _SPACE[raw], _LETTER[raw], _PUNCTUATION[raw]
    cut = np.zeros(n, bool)
    cut[1:] = space[1:] & ~space[:-1] | letter[1:] & mark[:-1] | mark[1:] & letter[:-1]
    cut[off[:-1][off[:-1] < n]] = True
    starts = np.flatnonzero(cut)
    counts = np.diff(np.searchsorted(starts, off))
    offsets = np.append(starts, n)
    if words_only:
        raw = lower_ascii(raw)[~space]
        offsets = np.concatenate([[0], np.cumsum(~space)])[offsets]
    return pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw))]), counts


#: The last bytes of white space outside ASCII, with what stands before them.
_ODD_ENDS = [(0xC2, 0x85), (0xC2, 0xA0), (0x9A, 0x80), *((0x80, x) for x in (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)), (0x81, 0x9F)]


def safe_cuts(raw: np.ndarray) -> np.ndarray:
    """Whether a text of these bytes may be cut before each one: at ASCII white space after what may be no white space at all."""
    space = _SPACE[raw]
    cut = np.zeros(len(raw), bool)
    cut[1:] = space[1:] & ~space[:-1]
    for a, b in _ODD_ENDS:
        cut[2:] &= ~((raw[:-2] == a) & (raw[1:-1] == b))
    return cut


class UnitEncoder:
    """Token ids of whole texts, from a function that encodes many distinct units at once.

    ``whole`` encodes texts that must not be cut: those with a special token's string or white space outside ASCII.
    """

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], whole: Callable[[list[str]], list[list[int]]], special: list[str], words_only: bool):
        self.encode, self.whole, self.words_only = encode, whole, words_only
        self.odd = "(?i)" + "|".join([ODD_SPACE, *(re.escape(s) for s in special)])
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.begin, self.ids = np.zeros(1, np.int64), np.zeros(0, np.int32)

    def _add(self, words: list[str]) -> None:
        lists = self.encode(words)
        lengths = np.fromiter(map(len, lists), np.int64, len(lists))
        self.known.update(zip(words, range(len(self.begin) - 1, len(self.begin) - 1 + len(words)), strict=True))
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(lengths)])
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(lists), np.int32, int(lengths.sum()))])

    def numbers(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The number of each unit in the cache, for all texts one after another, and how many units each text has."""
        parts, counts = units(col, self.words_only)
        coded = parts.dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        number = list(map(self.known.get, words))
        missing = [w for w, k in zip(words, number, strict=True) if k is None]
        if missing:
            if len(self.known) + len(missing) > CACHE_UNITS:
                self.clear()
                missing = words
            self._add(missing)
            number = list(map(self.known.__getitem__, words))
        return np.array(number, np.int64)[coded.indices.to_numpy()], counts

    def _plain(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        number, counts = self.numbers(col)
        length = np.diff(self.begin)[number]
        sums = np.concatenate([[0], np.cumsum(length)])
        return gather(self.ids, self.begin[number], length), np.diff(sums[np.concatenate([[0], np.cumsum(counts)])])

    def odd_texts(self, col: pa.Array) -> np.ndarray:
        return pc.fill_null(pc.match_substring_regex(col, self.odd), False).to_numpy(zero_copy_only=False)

    def __call__(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each text has."""
        odd = self.odd_texts(col)
        if not odd.any():
            return self._plain(col)
        ids, lengths = self._plain(col.filter(pa.array(~odd)))
        lists = self.whole(col.filter(pa.array(odd)).to_pylist())
        counts = np.zeros(len(col), np.int64)
        counts[~odd], counts[odd] = lengths, [len(x) for x in lists]
        out = np.zeros(int(counts.sum()), np.int32)
        mine = np.repeat(odd, counts)
        out[~mine] = ids
        out[mine] = np.fromiter(chain.from_iterable(lists), np.int32, int(mine.sum()))
        return out, counts


_encoders: dict[str, UnitEncoder] = {}


def word_encoder(path: str) -> UnitEncoder:
    """Encoder for the lower-casing word vocabulary: pieces of plain units go to the library's BPE model, others to it whole."""
    if path in _encoders:
        return _encoders[path]
    import regex
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    tokenize, special = tok.model.tokenize, [t.content for t in tok.get_added_tokens_decoder().values()]
    #: Fixed value: the vocabulary's own split pattern.
    pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    #: Characters below U+0250 are composed and have one lower-case character each, but for one; separators go to the library.
    plain = regex.compile(r"[\x00-\x1b\x20-įı-ɏ]*")
    shown = byte_characters()

    def whole(texts: list[str]) -> list[list[int]]:
        return [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]

    def one(piece: str) -> list[int]:
        return [t.id for t in tokenize(piece.encode().decode("latin-1").translate(shown))]

    def encode(words: list[str]) -> list[list[int]]:
        out, rest = [], []
        for i, w in enumerate(words):
            if w.isalpha() and w.isascii():
                out.append([t.id for t in tokenize(w)])
            elif plain.fullmatch(w):
                out.append([t for p in pieces.findall(w.lower()) for t in one(p)])
            else:
                rest.append(i)
                out.append([])
        for i, ids in zip(rest, whole([words[i] for i in rest]) if rest else [], strict=True):
            out[i] = ids
        return out

    return _encoders.setdefault(path, UnitEncoder(encode, whole, special, words_only=True))


def byte_characters() -> dict[int, int]:
    """The printable character that byte-level vocabularies use for each byte."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in own]
    return {b: b for b in own} | {b: 256 + i for i, b in enumerate(rest)}


def encoded(batches: Iterator[pa.RecordBatch], path: str, slice_bytes: int = 1 << 22) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of (doc_id, text) batches with their ids and the number of ids of each text."""
    from lectern.llm.common import slices

    encoder = word_encoder(path)
    for part in slices(batches, slice_bytes):
        yield (part, *encoder(part.column("text")))
