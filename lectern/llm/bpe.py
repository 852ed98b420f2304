"""Byte-pair encoding as a streaming transducer with bounded lookahead, and incremental decoding.

How far ahead must the encoder see before a token is final? A boundary moves only if a merge on its right turns out
otherwise; that merge of rank r can change what its left operand (or its product) does in a merge of a later rank, that
one again its own left operand, and so on to the left. ``lookahead`` finds the longest such chain of merges of rising
rank by one pass over the merge list from its end, in bytes. Tokens that end further than this from the end of the
bytes read so far are stable: they are emitted, and only the bytes behind them are kept. The end of a piece makes all of its
tokens stable.

Memory is constant, however long a text is: texts are read in portions of at most PORTION bytes. A portion ends where the
vocabulary's split pattern always cuts (white space after something else, so one character of lookahead is enough), or, in
a longer run without such a place, anywhere: the state of the open piece is then carried on. Every piece goes through the
transducer; what it gave for a piece (or for a unit of some, see ``wordcache``) is kept in a bounded cache. Digests and the
decoder are fed portion by portion.

Decoding is a two-step state machine: ids to bytes by table, bytes to text by an incremental UTF-8 decoder that holds
at most three bytes between calls and replaces what is no UTF-8.

Defined cases: a null text is an empty one (no ids); very long texts are encoded in portions, also those of one piece; ids
are as the library gives them, special token strings in a text included (a text with such a string in a run longer than a
portion without white space is encoded at once); null and repeated doc_ids are rows like others; an empty table gives an
empty result; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame

from lectern.llm.common import slices, texts
from lectern.llm.textops import gather, views
from lectern.llm.wordcache import UnitEncoder, byte_characters, safe_cuts

#: Bytes of text that are encoded at a time.
PORTION = 1 << 20
#: Fixed value: the split pattern of byte-level vocabularies of this kind.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """Bytes that must follow a token before it is final, for merges by rank."""
    reach: dict[bytes, int] = {}  # by right operand: the longest chain to the left from a merge of a later rank
    most = longest = 1
    for left, right in reversed(merges):
        here = len(left) + max(reach.get(left, 0), reach.get(left + right, 0))
        reach[right] = max(reach.get(right, 0), here)
        most, longest = max(most, here), max(longest, len(left) + len(right))
    return most + longest


class Vocabulary:
    """Merges and tokens of a byte-level vocabulary file, as bytes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        back = {c: b for b, c in byte_characters().items()}
        raw = lambda s: bytes(back[ord(c)] for c in s)
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.ids = {raw(t): i for t, i in data["model"]["vocab"].items() if t not in self.special}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in data["model"]["merges"]]
        self.merges = [(raw(a), raw(b)) for a, b in pairs]
        self.rank = {m: i for i, m in enumerate(self.merges)}
        self.tokens = {i: t for t, i in self.ids.items()} | {i: s.encode() for s, i in self.special.items()}
        self.lookahead = lookahead(self.merges)
        #: Bytes of one piece that are held at a time; at least twice the lookahead, so that each step emits something.
        self.buffer = max(4096, 2 * self.lookahead)

    def merge(self, piece: bytes) -> list[bytes]:
        """The tokens of a whole piece: the merge of lowest rank first, the leftmost of equal ones."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        if len(parts) < 40:
            rank = self.rank
            while len(parts) > 1:
                ranks = [rank.get(p, 1 << 30) for p in zip(parts, parts[1:], strict=False)]
                if (low := min(ranks)) == 1 << 30:
                    break
                i = ranks.index(low)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            return parts
        after, before = [*range(1, len(parts)), -1], [-1, *range(len(parts) - 1)]
        heap = [(r, i, p[0], p[1]) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if (r := self.rank.get(p)) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            if parts[i] != a or (j := after[i]) < 0 or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, b""
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for k, m in ((before[i], i), (i, after[i])):
                if k >= 0 and m >= 0 and (r := self.rank.get((parts[k], parts[m]))) is not None:
                    heapq.heappush(heap, (r, k, parts[k], parts[m]))
        return [p for p in parts if p]

    def stream(self, chunks: Iterable[bytes]) -> Iterator[int]:
        """Ids of one piece that comes in chunks, each emitted as soon as it is stable."""
        transducer = Transducer(self)
        for chunk in chunks:
            yield from transducer.feed(chunk)
        yield from transducer.end()

    def piece(self, piece: bytes) -> list[int]:
        transducer = Transducer(self)
        return [*transducer.feed(piece), *transducer.end()]


class Transducer:
    """The state of one open piece: the bytes whose tokens are not stable yet, never more than a buffer of them."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.held = vocabulary, b""

    def feed(self, data: bytes) -> list[int]:
        v, out = self.vocabulary, []
        for at in range(0, len(data), v.buffer):
            self.held += data[at : at + v.buffer]
            if len(self.held) < v.buffer:
                continue
            stable, end = len(self.held) - v.lookahead, 0
            for token in v.merge(self.held):
                if end + len(token) > stable:
                    break
                end += len(token)
                out.append(v.ids[token])
            self.held = self.held[end:]
        return out

    def end(self) -> list[int]:
        """The piece ends here: all that is held is stable."""
        v, held, self.held = self.vocabulary, self.held, b""
        if not held:
            return []
        whole = v.ids.get(held) if len(held) == 1 else None
        return [whole] if whole is not None else [v.ids[t] for t in v.merge(held)]


_encoders: dict[str, tuple[Vocabulary, UnitEncoder, ByteTable]] = {}


class ByteTable:
    """The bytes of every id, one after another, for decoding many ids at once."""

    def __init__(self, tokens: dict[int, bytes]):
        size = max(tokens) + 1
        self.length = np.array([len(tokens.get(i, b"")) for i in range(size)], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.length)[:-1]])
        self.data = np.frombuffer(b"".join(tokens.get(i, b"") for i in range(size)), np.uint8)

    def bytes_of(self, ids: np.ndarray) -> bytes:
        return gather(self.data, self.begin[ids], self.length[ids]).tobytes()


class Decoder:
    """Ids in, text out, in any portions; ``end`` gives what is left."""

    def __init__(self, table: ByteTable):
        self.table, self.state = table, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: np.ndarray) -> str:
        return self.state.decode(self.table.bytes_of(ids))

    def end(self) -> str:
        return self.state.decode(b"", True)


def open_run(vocabulary: Vocabulary, chunks: Iterable[str]) -> Iterator[list[int]]:
    """Ids of a run of text that comes in chunks, cut anywhere: pieces that are complete, and what is stable of an open one.

    The last piece of a chunk may go on. A short one is kept as text; a long one is fed to a transducer and goes on as long
    as characters of its kind follow, but for the last character of white space, which may belong to what comes next.
    """
    import regex

    pieces = regex.compile(PIECES)
    kinds = {"space": regex.compile(r"\s+"), "letter": regex.compile(r"\p{L}+"), "number": regex.compile(r"\p{N}+"), "mark": regex.compile(r"[^\s\p{L}\p{N}]+")}
    kind_of = lambda c: next(k for k, p in kinds.items() if p.match(c))
    kept, kind, transducer = "", None, Transducer(vocabulary)
    for chunk in chunks:
        text, out = kept + chunk, []
        kept = ""
        if kind:
            more = kinds[kind].match(text)
            end = more.end() if more else 0
            if kind == "space":
                end = max(0, end - 1)
            out += transducer.feed(text[:end].encode())
            if end == len(text) or kind == "space" and more and more.end() == len(text):
                kept = text[end:]
                yield out
                continue
            out += transducer.end()
            text, kind = text[end:], None
        found = [m.span() for m in pieces.finditer(text)]
        # the last two pieces may look different with more text behind them
        open_from = found[-2][0] if len(found) > 1 else 0
        if found and found[-1][1] - found[-1][0] > 4096:
            open_from = found[-1][0]
        for a, b in found:
            if b <= open_from:
                out += vocabulary.piece(text[a:b].encode())
        rest = text[open_from:]
        if found and len(rest) > 4096:
            kind = kind_of(rest[-1])
            cut = len(rest) - 1 if kind == "space" else len(rest)
            out += transducer.feed(rest[:cut].encode())
            rest = rest[cut:]
        kept = rest
        yield out
    out = []
    if kind:
        out += transducer.feed(kept.encode()) + transducer.end()
    else:
        for p in pieces.findall(kept):
            out += vocabulary.piece(p.encode())
    yield out


def portions(raw: np.ndarray, start: int, end: int) -> Iterator[tuple[int, int, bool]]:
    """(start, end, whether a piece ends there) of the portions of one text of more than PORTION bytes."""
    while start < end:
        stop = min(end, start + PORTION)
        if stop < end:
            cuts = np.flatnonzero(safe_cuts(raw[start:stop]))
            if len(cuts):
                stop = start + int(cuts[-1])
            else:  # cut between characters at least
                while raw[stop] & 0xC0 == 0x80:
                    stop -= 1
                yield start, stop, False
                start = stop
                continue
        yield start, stop, True
        start = stop


def byte_encoder(path: str) -> tuple[Vocabulary, UnitEncoder, ByteTable]:
    if path in _encoders:
        return _encoders[path]
    import regex

    vocabulary, pieces = Vocabulary(path), regex.compile(PIECES)
    split = regex.compile("(" + "|".join(map(regex.escape, vocabulary.special)) + ")") if vocabulary.special else None
    simple = regex.compile(r" ?[A-Za-z]+")

    def encode(words: list[str]) -> list[list[int]]:
        piece = vocabulary.piece
        return [piece(w.encode()) if simple.fullmatch(w) else [i for p in pieces.findall(w) for i in piece(p.encode())] for w in words]

    def whole(many: list[str]) -> list[list[int]]:
        out = []
        for text in many:
            ids: list[int] = []
            for part in split.split(text) if split else [text]:
                ids += [vocabulary.special[part]] if part in vocabulary.special else encode([part])[0]
            out.append(ids)
        return out

    return _encoders.setdefault(path, (vocabulary, UnitEncoder(encode, whole, list(vocabulary.special), words_only=False), ByteTable(vocabulary.tokens)))


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids): the token ids of every whole text."""
    path = path or public_tokenizers.path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, encoder, _ = byte_encoder(path)
        for part in slices(batches):
            ids, counts = encoder(part.column("text"))
            ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(ends, pa.array(ids, pa.int32()))], ["doc_id", "ids"])

    return texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(coded: DataFrame, path: str | None = None, portion: int = 1 << 16) -> DataFrame:
    """(doc_id, text) from (doc_id, ids)."""
    path = path or public_tokenizers.path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = byte_encoder(path)[2]
        for batch in batches:
            out = [text_of(table, np.asarray(ids.values), portion) for ids in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])

    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def text_of(table: ByteTable, ids: np.ndarray, portion: int = 1 << 16) -> str:
    decoder = Decoder(table)
    return "".join([*(decoder.feed(ids[at : at + portion]) for at in range(0, len(ids), portion)), decoder.end()])


class Digests:
    """Number of ids, digest of the ids and digest of the decoded text of one document, fed portion by portion."""

    def __init__(self, table: ByteTable, decimals: ByteTable):
        self.decimals, self.decoder = decimals, Decoder(table)
        self.n, self.ids, self.text = 0, hashlib.sha256(), hashlib.sha256()

    def feed(self, ids: np.ndarray) -> None:
        if not len(ids):
            return
        self.ids.update(b"," * (self.n > 0) + self.decimals.bytes_of(ids)[:-1])
        self.text.update(self.decoder.feed(ids).encode())
        self.n += len(ids)

    def end(self) -> tuple[int, str, str]:
        self.text.update(self.decoder.end().encode())
        return self.n, self.ids.hexdigest(), self.text.hexdigest()


def encoded_portions(encoder: UnitEncoder, vocabulary: Vocabulary, text: str, raw: np.ndarray) -> Iterator[np.ndarray]:
    """Ids of one text of more than PORTION bytes, portion by portion."""
    special = any(s in text for s in vocabulary.special)
    run: list[tuple[int, int]] = []
    for a, b, whole in portions(raw, 0, len(raw)):
        run.append((a, b))
        if not whole:
            continue
        parts = (raw[x:y].tobytes().decode() for x, y in run)
        if len(run) == 1 or special:
            yield encoder(pa.array(["".join(parts)]))[0]
        else:
            for ids in open_run(vocabulary, parts):
                yield np.array(ids, np.int32)
        run = []


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every whole text, encoded and decoded again."""
    path = path or public_tokenizers.path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, encoder, table = byte_encoder(path)
        decimals = ByteTable({i: b"%d," % i for i in range(len(table.length))})
        for part in slices(batches, PORTION):
            col, out = part.column("text"), []
            raw, off = views(col)
            if len(raw) > PORTION:  # one long text, read in portions
                seen = Digests(table, decimals)
                for ids in encoded_portions(encoder, vocabulary, col[0].as_py(), raw):
                    seen.feed(ids)
                out.append(seen.end())
            else:
                ids, counts = encoder(col)
                ends = np.concatenate([[0], np.cumsum(counts)]).tolist()
                for a, b in zip(ends[:-1], ends[1:], strict=True):
                    seen = Digests(table, decimals)
                    seen.feed(ids[a:b])
                    out.append(seen.end())
            columns = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
