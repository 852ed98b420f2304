"""Vectorised text scans over Arrow buffers: words, 64-bit span hashes and ragged gathers.

Everything works on the UTF-8 bytes of many documents at once; documents are told apart by their byte offsets, and no
word, shingle or unit ever crosses from one document into the next.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: An odd base, so that its powers have inverses modulo 2**64.
BASE = np.uint64(0x9E3779B97F4A7C15)
_inverse = np.uint64(pow(int(BASE), -1, 2**64))
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _mix_int(x: int) -> int:
    x = (x + 0x9E3779B97F4A7C15) % 2**64
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
    x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
    return x ^ x >> 31


#: A random-looking value for each byte.
BYTE_VALUES = np.array([_mix_int(i + 1) for i in range(256)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values (the splitmix64 finaliser)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i below n."""
    if len(_powers["up"]) < n:
        for name, base in (("up", BASE), ("down", _inverse)):
            _powers[name] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 1 << 16), base, np.uint64)]))
    return _powers["up"][:n], _powers["down"][:n]


def views(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, and the offsets of its values within them; nulls count as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()[-3:]
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    return np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of each maximal run of True within a document."""
    n = len(mask)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    first = np.zeros(n, bool)
    first[offsets[:-1][offsets[:-1] < n]] = True
    begins = mask.copy()
    begins[1:] &= ~mask[:-1] | first[1:]
    starts = np.flatnonzero(begins)
    ends_at = mask.copy()
    ends_at[:-1] &= ~mask[1:] | first[1:]
    ends = np.flatnonzero(ends_at) + 1
    docs = np.searchsorted(offsets, starts, "right") - 1
    return starts, ends, docs


def prefix_sums(raw: np.ndarray) -> np.ndarray:
    """Sums of BYTE_VALUES[b] * BASE**i, from which any span's hash follows by ``span_hash``."""
    up, _ = powers(len(raw))
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[raw] * up, out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, equal for equal bytes wherever they stand."""
    _, down = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingles(word_hash: np.ndarray, word_doc: np.ndarray, k: int, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles and their documents; a document of fewer words has one, of its whole sequence."""
    counts = np.bincount(word_doc, minlength=n_docs) if len(word_doc) else np.zeros(n_docs, np.int64)
    n = len(word_hash)
    parts, docs = [], []
    if n >= k:
        h = np.zeros(n - k + 1, np.uint64)
        for i in range(k):
            h = mix(h * np.uint64(0xD6E8FEB86659FD93) + word_hash[i : n - k + 1 + i])
        whole = word_doc[: n - k + 1] == word_doc[k - 1 :]
        parts.append(h[whole])
        docs.append(word_doc[: n - k + 1][whole])
    begin = np.concatenate([[0], np.cumsum(counts)[:-1]])
    short = np.flatnonzero((counts > 0) & (counts < k))
    for size in range(1, k):
        at = begin[short[counts[short] == size]]
        if len(at):
            h = np.full(len(at), _mix_int(size), np.uint64)
            for i in range(size):
                h = mix(h * np.uint64(0xD6E8FEB86659FD93) + word_hash[at + i])
            parts.append(h)
            docs.append(word_doc[at])
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h, d = np.concatenate(parts), np.concatenate(docs)
    order = np.argsort(d, kind="stable")
    return h[order], d[order]


def distinct_per_doc(values: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, value) pairs, by document and value."""
    order = np.lexsort((values, docs))
    v, d = values[order], docs[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (d[1:] != d[:-1])
    return v[new], d[new]


def gather(table: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Concatenate table[begin[i] : begin[i] + length[i]] over all i."""
    total = int(length.sum())
    if not total:
        return table[:0]
    ends = np.cumsum(length)
    return table[np.repeat(begin - (ends - length), length) + np.arange(total)]
