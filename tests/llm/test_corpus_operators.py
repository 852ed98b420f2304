"""Each operator against brute force on a small table with every awkward row."""

import collections
import hashlib
import random
import re
import time
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from lectern.llm import bpe, exact_dedup, license_scan, media, minhash, packing, secret_scan, suffix_dedup, textops, token_ids, toxicity
from lectern.llm.common import hot_threshold, join_by_key
from lectern.llm.components import components
from lectern.llm.wordcache import word_encoder

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SCHEMA = "doc_id long, text string, digest string, row long, labels string, score double, hash string, toxic int"


def texts():
    rng = random.Random(7)
    words = ["alpha", "Beta", "gamma,", "delta.", "é", "Straße", "\U0001f600", "x", "under the MIT License", "CC BY-NC", "token = abcdef12", "loser", "'ll"]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 90))) for _ in range(12)]
    out = [None, "", " \n\t", "one", "Two words", "\x1c\x85\xa0 odd　space", "<|endoftext|> and <|startoftext|>", "a" * 9000, "Apache License, Version 2.0 apache license version 2"]
    out += ['password="abc123" passwd: xyz SECRET=" tooo', "AKIA" + "A" * 16 + " AKIAB", "deadbeef" * 4 + "\U0001f600" + "0" * 24, "token=token:abcdefgh api_key:'k=k=k=k'"]
    for b in base:
        out += [b, b, b.replace(" ", "\n"), b[: len(b) // 2] + " changed " + b[len(b) // 2 :]]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3 - 20, t) for i, t in enumerate(texts())] + [(None, "no id"), (None, None), (None, "no id")]
    return spark.createDataFrame([(i, t, "x", 1, "y", 0.5, "z", 1) for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df):
    return df.collect()


def by_id(df):
    return {r["doc_id"]: r for r in df.collect() if r["doc_id"] is not None}


def given():
    return {i * 3 - 20: t or "" for i, t in enumerate(texts())}


def test_exact_duplicates(docs, none):
    got = by_id(exact_dedup.exact_duplicates(docs))
    groups = collections.defaultdict(list)
    for i, t in given().items():
        groups[re.sub(r"[\x20\x09-\x0D]", "", t)].append((-len(t), i))
    for t, members in groups.items():
        n = len(members) + (t == "")  # a null text without an id
        for _, i in members:
            assert (got[i]["keep_id"], got[i]["kept"], got[i]["text_sha256"]) == (min(members)[1], i == min(members)[1], hashlib.sha256(t.encode()).hexdigest())
            assert got[i]["group_size"] == n
    assert rows_of(exact_dedup.exact_duplicates(none)) == []
    assert set(exact_dedup.drop_duplicates(docs).columns) == set(docs.columns)


def test_digest_index_takes_new_digests_only(spark):
    index = exact_dedup.DigestIndex(spark, buckets=3)
    first = spark.createDataFrame([(1, "a b"), (2, "ab"), (3, "c")], "doc_id long, text string")
    second = spark.createDataFrame([(9, "a  b"), (10, "new")], "doc_id long, text string")
    index.ingest(first)
    got = by_id(exact_dedup.exact_duplicates(second, index))
    assert (got[9]["keep_id"], got[9]["kept"], got[10]["keep_id"], got[10]["kept"]) == (1, False, 10, True)
    assert index.read().count() == 3


def secrets_by_hand(text):
    found = []
    for no, (kind, pattern, group, least) in enumerate(secret_scan.BASE_RULES):
        found += [(m.start(), no, kind, m.end()) for m in re.finditer(pattern, text, re.ASCII) if len(m.group(group)) >= least]
    return sorted(found)


def test_secret_scan(docs, none):
    got = by_id(secret_scan.scan_secrets(docs))
    hits = 0
    for i, t in given().items():
        found = secrets_by_hand(t)
        hits += len(found)
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b in found).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(f[2] == k for f in found) for k in ("assign", "access", "hex")]
    assert hits > 8 and len(rows_of(secret_scan.scan_secrets(docs))) == docs.count()
    assert rows_of(secret_scan.scan_secrets(none)) == []


def test_ledger_scans_unseen_pairs_only(spark):
    ledger = secret_scan.BlobLedger(spark)
    docs = spark.createDataFrame([(1, "password=abcdef"), (2, "password=abcdef"), (3, "clean")], "doc_id long, text string")
    ledger.scan(docs)
    before = ledger.read().count()
    assert before == 2 * len(secret_scan.RULES)
    ledger.scan(docs)
    assert ledger.read().count() == before
    more = spark.createDataFrame([(1, "password=abcdef now changed"), (2, "password=abcdef")], "doc_id long, text string")
    got = {r["doc_id"]: r["found"] for r in ledger.scan(more).collect()}
    assert len(got[1]) == len(got[2]) == 1 and ledger.read().count() == before + len(secret_scan.RULES)
    ledger.scan(docs, version=2)
    assert ledger.read().where("version = 2").count() == before


def test_scan_and_redaction_are_linear_in_the_findings(spark):
    took = []
    for n in (1000, 10_000, 40_000):  # the first one compiles
        text = " ".join(f"{i * 2654435761:032x}" for i in range(n))
        df = spark.createDataFrame([(1, text)], "doc_id long, text string")
        began = time.time()
        assert rows_of(secret_scan.scan_secrets(df))[0]["n_hex"] == n
        assert rows_of(secret_scan.redact(df))[0]["text"] == " ".join(["[SECRET]"] * n)
        took.append(time.time() - began)
    assert took[2] < 2 * took[1] + 3


def test_redaction(spark, docs):
    got = by_id(secret_scan.redact(spark.createDataFrame([(1, "x password=abcdef12 y", 7), (2, "clean", 5), (3, None, None)], "doc_id long, text string, n_chars long")))
    assert (got[1]["text"], got[1]["n_chars"], got[2]["text"], got[3]["text"]) == ("x [SECRET] y", 12, "clean", None)
    assert secret_scan.redact(docs).count() == docs.count()


def test_near_duplicates(docs, none):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate(LOWER))
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets = {i: shingles(t) for i, t in given().items()}
    parent = {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    got = by_id(minhash.near_duplicates(docs))
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in got.items()} == {i: (len(s), top(i), top(i) == i) for i, s in sets.items()}
    assert sum(top(i) != i for i in sets) > 10
    assert rows_of(minhash.near_duplicates(none)) == []


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 7), (200, 201)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100, 200: 200, 201: 200}


def repeats_by_hand(table):
    seen, out = set(), {}
    for i in sorted(table):
        b = table[i].encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if b[p : p + 50] in seen:
                gone[p : p + 50] = b"\x01" * 50
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
        seen |= {b[p : p + 50] for p in range(len(b) - 49)}
    return out


def test_repeated_strings(spark, docs, none):
    rng = random.Random(3)
    base = ["".join(rng.choice("ab ") for _ in range(rng.randint(0, 300))) for _ in range(20)]
    table = {i * 3 - 50: "".join(rng.choice(base)[rng.randint(0, 60) :][: rng.randint(20, 200)] for _ in range(rng.randint(0, 5))) + "é" * rng.randint(0, 60) for i in range(150)}
    for df, t in ((spark.createDataFrame(list(table.items()), "doc_id long, text string"), table), (docs, given())):
        got = by_id(suffix_dedup.repeats(df))
        assert {i: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for i, r in got.items()} == repeats_by_hand(t)
    assert rows_of(suffix_dedup.repeats(none)) == []
    assert all(r["n_removed"] == 0 for r in suffix_dedup.repeats(docs).where("doc_id is null").collect())
    assert suffix_dedup.remove_repeats(docs).columns == docs.columns


def test_long_runs_are_read_as_streams(monkeypatch):
    rng = np.random.default_rng(1)
    rows = sorted({(int(t) << 16 | int(s), int(p), int(d)) for t, s, p, d in zip(rng.integers(0, 4, 900), rng.integers(0, 3, 900), rng.integers(0, 3, 900), rng.integers(0, 60, 900), strict=True)})
    batches = lambda n: [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[i : i + n], strict=True)], ["trigger", "phrase", "doc_id"]) for i in range(0, len(rows), n)]
    told = lambda: {(r["doc_id"], r["phrase"], r["covered"]) for b in suffix_dedup.read_runs(iter(batches(13))) for r in b.to_pylist()}
    whole = told()
    monkeypatch.setattr(suffix_dedup, "MOST_HELD", 20)
    cut = told()
    assert whole <= cut and {x for x in cut if x[2]} == {x for x in whole if x[2]}


def test_hot_keys_are_dealt_to_several_tasks(spark, monkeypatch):
    rng = random.Random(8)
    header = "this header stands in front of a third of all documents, and it is long enough. "
    varied = [header[:40] + "".join(rng.choice("xyz ") for _ in range(60)) for _ in range(6)]
    table = {i * 2: (header if i % 3 == 0 else "") + (rng.choice(varied) if i % 2 else "") + "".join(rng.choice("abcdef ") for _ in range(rng.randint(0, 150))) for i in range(400)}
    rows = [*table.items(), (0, table[0]), (None, header)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = repeats_by_hand(table)
    for share, least, sample in ((0.02, 2, 0.5), (0.0001, 0, 1.0), (0.25, 64, 1 / 64)):
        for name, value in (("HOT", share), ("LEAST_ROWS", least), ("SAMPLE", sample)):
            monkeypatch.setattr(suffix_dedup, name, value)
        got = [r for r in suffix_dedup.repeats(df).collect() if r["doc_id"] is not None]
        assert len(got) == len(table) + 1 and {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == want
    monkeypatch.setattr(suffix_dedup, "HOT", 0.02)
    monkeypatch.setattr(suffix_dedup, "LEAST_ROWS", 2)
    parsed = suffix_dedup.parse(df)
    hot = {r["phrase"]: r["salts"] for r in suffix_dedup.hot_keys(parsed, "phrase", 4).collect()}
    n = {r["phrase"]: r["count"] for r in parsed.groupBy("phrase").count().collect()}
    most = parsed.count() * 0.02 / 4
    assert set(hot) == {p for p, c in n.items() if c > max(most, 2)} and all(s >= n[p] / most for p, s in hot.items() if most >= 2)


def test_token_ids(docs, none):
    tok = Tokenizer.from_file(WORD)
    got, at = by_id(token_ids.round_trip(docs)), sum(len(tok.encode(t, add_special_tokens=False).ids) + 1 for t in ("no id", "", "no id"))
    for i, t in sorted(given().items()):
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 1], "<u4")
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert rows_of(token_ids.round_trip(none)) == []


def test_elias_fano():
    rng = np.random.default_rng(0)
    for n, top in ((1, 0), (5, 100), (1000, 10**6), (3000, 5000)):
        x = np.sort(rng.integers(0, top + 1, n))
        y, _ = token_ids.EliasFano.from_bytes(b"zz" + token_ids.EliasFano.encode(x, top).to_bytes(), 2)
        assert (y.decode() == x).all() and [y.get(i) for i in range(n)] == x.tolist()
    block = token_ids.Block(token_ids.write_block([3, None, 5], np.array([2, 0, 1]), np.array([7, 8, 70000]), 11))
    assert (block.doc_ids, block.before, block.document(0).tolist(), block.document(1).tolist(), block.document(2).tolist()) == ([3, None, 5], 11, [7, 8], [], [70000])


def test_encoders_agree_with_the_library():
    rng = random.Random(2)
    parts = [*"aAbé ÉßİıΣσς'sdll  \n\t\r\x0b\x0c\x1c\x1f\x85\xa0  ́ 09٣.,!?<\U0001f600漢字tŁǅ", "<|endoftext|>", "<|startoftext|>", "'ll", "'re", "the", "ing"]
    many = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    table = bpe.byte_encoder(BYTE)[2]
    for encoder, path in ((word_encoder(WORD), WORD), (bpe.byte_encoder(BYTE)[1], BYTE)):
        tok = Tokenizer.from_file(path)
        ids, counts = encoder(pa.array(many))
        want = [e.ids for e in tok.encode_batch(many, add_special_tokens=False)]
        ends = np.cumsum(counts)
        assert [ids[e - c : e].tolist() for e, c in zip(ends, counts, strict=True)] == want
        if path == BYTE:
            assert [bpe.text_of(table, np.array(w, np.int64), 7) for w in want] == [tok.decode(w, skip_special_tokens=False) for w in want]


def test_streaming_needs_its_lookahead_only():
    v = bpe.Vocabulary(BYTE)
    v.buffer = 2 * v.lookahead
    rng = random.Random(4)
    for _ in range(15):
        s = "".join(rng.choice(["a", "aa", "b", "ab", "the", "ing", "tion", "er", "x", "ZZ"]) for _ in range(1500)).encode()
        assert list(v.stream([s[i : i + 37] for i in range(0, len(s), 37)])) == [v.ids[t] for t in v.merge(s)]


def test_bpe_digests(docs, none):
    tok, got = Tokenizer.from_file(BYTE), by_id(bpe.digests(docs))
    for i, t in given().items():
        ids = tok.encode(t, add_special_tokens=False).ids
        assert (got[i]["n_tokens"], got[i]["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert got[i]["decoded_sha256"] == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert rows_of(bpe.digests(none)) == []
    back = by_id(bpe.decode_documents(bpe.encode_documents(docs)))
    assert {i: r["text"] for i, r in back.items()} == given()


def test_packing(docs, none):
    tok, rows = Tokenizer.from_file(WORD), rows_of(packing.pack_documents(docs))
    got = {(r["doc_id"], r["piece"]): r for r in rows if r["doc_id"] is not None}
    for i, t in given().items():
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 0], "<u4")
        for k in range(0, len(ids), 2048):
            r = got.pop((i, k // 2048))
            assert (r["start"], r["length"], r["ids_crc32"]) == (k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes()))
    assert not got and len({r["sequence_id"] for r in rows}) == -(-sum(r["length"] for r in rows) // 2048)
    places = collections.defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 2048
    assert rows_of(packing.pack_documents(none)) == []


def test_packing_plan_is_close_to_the_bound():
    rng = np.random.default_rng(0)
    for lengths in (rng.integers(1, 2049, 5000), np.minimum(2048, rng.lognormal(5, 1, 9000).astype(int) + 1)):
        counts = {int(k): int(n) for k, n in zip(*np.unique(lengths, return_counts=True), strict=True)}
        used = {s + k for _, a, b, s, _ in packing.plan(counts) for k in range(b - a)}
        assert len(used) <= 1.01 * -(-int(lengths.sum()) // 2048)


def test_licenses(docs, none):
    got = by_id(license_scan.scan_licenses(docs))
    places = 0
    for i, t in given().items():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(LOWER))
        found = sorted((k, label) for p, label in license_scan.BASE for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
        places += len(found)
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(found), found[0][0] if found else None, found[-1][0] if found else None)
        assert r["base_labels"] == ",".join(sorted({x for _, x in found})) and set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) | {""}
        assert 0 <= r["score"] <= 1
    assert places > 5 and rows_of(license_scan.scan_licenses(none)) == []


def test_license_with_words_left_out(spark):
    notice = "Permission is hereby granted, free of charge, to any person obtaining really a copy of this software and associated documentation files"
    got = by_id(license_scan.scan_licenses(spark.createDataFrame([(1, "x y z " + notice), (2, "permission is granted")], "doc_id long, text string")))
    assert (got[1]["labels"], got[1]["base_labels"], got[2]["labels"]) == ("mit", "", "") and got[1]["score"] > 0.6 > got[2]["score"]


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def best_chain(spots, k):
    """The definition, by trying every earlier hit: (words covered, first, -last)."""
    spots = sorted(set(spots))
    ends = []
    for i, (pos, tpos) in enumerate(spots):
        chains = [(n + min(k, tpos - spots[j][1]), first) for j, (n, first) in enumerate(ends[:i]) if spots[j][0] < pos and spots[j][1] < tpos]
        ends.append(max([*chains, (k, pos)]))
    return max(((n, first, -(pos + k - 1)) for (n, first), (pos, _) in zip(ends, spots, strict=True)), default=(0, 0, 0))


def plain_licenses(text):
    """All verified spans (first, last, label) of a text, in plain Python."""
    w, k, out = words_of(text), license_scan.K, set()
    for phrase, label in license_scan.BASE:
        p = phrase.split()
        out |= {(i, i + len(p) - 1, label) for i in range(len(w)) if w[i : i + len(p)] == p}
    for phrase, label in license_scan.TEMPLATES + license_scan.WHOLE:
        p = phrase.split()
        n = len(p) - k + 1
        spots = [(i, j) for i in range(len(w) - k + 1) for j in range(n) if w[i : i + k] == p[j : j + k]]
        found = []
        for begin in range(-2, len(w) // len(p) + 1):  # windows of three template lengths
            groups = {}
            for i, j in spots:
                if begin <= i // len(p) <= begin + 2:
                    groups.setdefault(i - j, []).append((i, j))
            merged, last = [], None
            for d in sorted(groups):
                if last is None or d - last > max(license_scan.NEAR, n // license_scan.NEAR_PART):
                    merged.append([])
                merged[-1] += groups[d]
                last = d
            for m in merged:
                covered, first, end = best_chain(m, k)
                if len({j for _, j in m}) / n >= license_scan.ENOUGH and covered / len(p) >= license_scan.ENOUGH:
                    found.append((first, -end))
        for first, end in sorted(found):
            if held := [x for x in out if x[2:] == (label, phrase) and x[1] >= first]:
                out -= set(held)
                first, end = min(first, *(x[0] for x in held)), max(end, *(x[1] for x in held))
            out.add((first, end, label, phrase))
    return sorted({x[:3] for x in out})


def license_texts():
    rng = random.Random(13)
    every = [p for p, _ in license_scan.BASE + license_scan.TEMPLATES + license_scan.WHOLE]
    out = [None, "", "mit", *every, " ".join(every), " x ".join(every[3:9]).upper()]
    for _ in range(60):
        parts = []
        for phrase in rng.sample(every, rng.randint(1, 3)):
            w = [x for x in phrase.split() if rng.random() > rng.choice([0, 0.05, 0.2])]
            for _ in range(rng.choice([0, 1, 3])):
                at = rng.randint(0, len(w))
                w[at:at] = ["word"] * rng.choice([1, 3, 6, 30])
            parts += w if rng.random() < 0.8 else w + w[: len(w) // 2]
            parts += ["filler"] * rng.randint(0, 12)
        out.append(" ".join(parts))
    return out


def test_license_labels_and_spans(spark):
    made = list(enumerate(license_texts()))
    got = by_id(license_scan.scan_licenses(spark.createDataFrame(made, "doc_id long, text string")))
    several = 0
    for i, t in made:
        want = plain_licenses(t)
        assert got[i]["spans"] == ",".join(f"{label}:{a}:{b}" for a, b, label in want)
        assert got[i]["labels"] == ",".join(sorted({label for _, _, label in want}))
        several += len(want) > 1
    assert several > 20 and "isc" in got[made[-1][0] - 61]["labels"]


def test_segments_are_maximal():
    rng = random.Random(1)
    for _ in range(200):
        n = rng.randint(1, 14)
        w = [rng.choice([0, 0, 1.5, 3.0]) for _ in range(n)]
        score = [x or -0.7 for x in w]
        pos = np.flatnonzero(w)
        got = toxicity.maximal_segments(pos, np.array(w)[pos], -0.7)

        def split(a, b):  # the definition: the best segment, then what is left on both sides
            best = max(((sum(score[i:j]), -(j - i), i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0, 0, 0, 0))
            return split(a, best[2]) + [(best[2], best[3] - 1)] + split(best[3], b) if best[0] > 1e-9 else []

        assert abs(sum(s for _, _, s in got) - sum(sum(score[a : b + 1]) for a, b in split(0, n))) < 1e-6


def test_toxicity(spark, sf, docs, none):
    labels = spark.createDataFrame([(i, int("loser" in t)) for i, t in given().items()] + [(None, 1), (5, None)], "doc_id long, toxic int")
    got = rows_of(toxicity.toxicity(docs, labels))
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got if r["doc_id"] is not None)
    assert rows_of(toxicity.toxicity(none, labels)) == [] and {r["score"] for r in rows_of(toxicity.toxicity(docs, labels.limit(0)))} <= {toxicity.EMPTY.probability(np.zeros((1, 2)))[0]}
    words = ["calm", "river", "stone", "paper", "green", "window", "table", "bright"]
    rng = random.Random(0)
    rows = [(i, " ".join(rng.choice(words) for _ in range(60)) + (" you loserling " if i % 5 == 0 else "")) for i in range(600)]
    made = spark.createDataFrame(rows, "doc_id long, text string")
    r = rows_of(toxicity.toxicity(made, spark.createDataFrame([(i, int(i % 5 == 0)) for i, _ in rows], "doc_id long, toxic int")))
    assert all(x["predicted"] == int(x["doc_id"] % 5 == 0) for x in r)


def page(lines):
    return "<article>" + "".join(f"<p>{' '.join(w)}</p>" for w in lines) + "</article>"


def groups_of(sketched):
    return {r["image_id"]: r["component_id"] for r in media.copies(sketched).collect()}


def test_media(spark, sf):
    rng = random.Random(0)
    lines = [[f"word{rng.randint(0, 900)}" for _ in range(20)] for _ in range(18)]
    edited = [list(x) for x in lines]
    edited[4][3:9] = ["new"] * 6
    pages = [(0, page(lines)), (1, page(lines)), (7, page(edited)), (8, page(lines[5:])), (9, page([[f"other{rng.randint(0, 900)}" for _ in range(20)] for _ in range(18)])), (11, None), (12, ""), (None, "x"), (13, "y" * 300_000)]
    table = spark.createDataFrame([(i, h, 1, 2) for i, h in pages], "page_id long, html string, part long, node long")
    got = {r["image_id"]: r for r in media.copies(media.page_sketches(table)).collect()}
    assert len(got) == len(pages) and (got[1]["class_id"], got[0]["class_size"]) == (0, 2)
    assert [got[i]["component_id"] for i in (0, 1, 7, 8, 9, 11, 12, None, 13)] == [0, 0, 0, 0, 9, 11, 11, None, 13] and got[0]["kept"] and not got[1]["kept"] and got[8]["n_links"] > 0
    assert {r["image_id"]: r["component_id"] for r in media.copies(media.sketches(media.page_images(table))).collect()} == {i: r["component_id"] for i, r in got.items()}
    assert media.copies(media.page_sketches(table.limit(0))).collect() == []
    image = media.draw(lines)
    a, b = media.describe(image), media.describe(image[8:120, 12:130])
    assert media.consensus(*b, *a)[1:] == (8, 12)


def test_hot_keys_are_joined_apart(spark):
    left = spark.createDataFrame([(i, "hot" if i % 3 == 0 else str(i % 50)) for i in range(3000)], "doc_id long, key string")
    right = left.groupBy("key").count().withColumnRenamed("count", "n")
    got = join_by_key(left, right, "key", "n", 3000)
    assert got.count() == 3000 and got.where("key = 'hot' and n >= 1000").count() == 1000 and hot_threshold(10**9) == 10**6


def test_word_hashes_do_not_depend_on_place():
    col = pa.array(["ab cd", None, "", "cd ab cd"])
    words, docs = license_scan.word_spans(col)
    assert docs.tolist() == [0, 0, 3, 3, 3] and words[0] == words[3] and words[1] == words[2] == words[4]
    assert textops.views(pa.array(["x", "yz"]).slice(1))[1].tolist() == [0, 2]


def reachable(ids, linked):
    top = {i: i for i in ids}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and linked(a, b):
                top[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i in ids}


def test_media_recall_against_brute_force(spark):
    rng = random.Random(5)
    line = lambda n: [f"word{rng.randint(0, 3000)}" for _ in range(n)]
    rows = []
    for i in range(60):
        base = [line(18) for _ in range(15)]
        rows += [(4 * i, page(base)), (4 * i + 1, page(base[3:])), (4 * i + 2, page([w if rng.random() > 0.1 else line(18) for w in base])), (4 * i + 3, page([line(18) for _ in range(14)]))]
    table = spark.createDataFrame(rows, "page_id long, html string")
    drawn = {r["image_id"]: media.describe(np.frombuffer(r["pixels"], np.uint8).reshape(r["height"], r["width"])) for r in media.page_images(table).collect()}
    inliers = {(a, b): media.consensus(*drawn[a], *drawn[b])[0] for a in drawn for b in drawn if a < b}
    found = groups_of(media.page_sketches(table))
    want = [k for k, n in inliers.items() if n >= max(6, 0.2 * min(len(drawn[k[0]][1]), len(drawn[k[1]][1])))]
    most = reachable(sorted(drawn), lambda a, b: inliers[a, b] >= media.LEAST)
    assert len(want) >= 100 and all(most[i] <= g for i, g in found.items())
    assert sum(found[a] == found[b] for a, b in want) >= 0.9 * len(want)


def test_media_common_region_makes_no_pairs(spark):
    """A header that all pages share is one component by leaders, whatever the number of pages."""
    rng = random.Random(12)
    line = lambda: [f"word{rng.randint(0, 3000)}" for _ in range(20)]
    head = [line() for _ in range(10)]
    table = spark.createDataFrame([(i, page(head + [line() for _ in range(8)])) for i in range(120)] + [(200, page([line() for _ in range(18)]))], "page_id long, html string")
    rows = media.copies(media.page_sketches(table)).collect()
    assert {r["component_id"] for r in rows if r["image_id"] < 200} == {0} and [r["component_id"] for r in rows if r["image_id"] == 200] == [200]
    assert sum(r["n_links"] for r in rows) <= 2 * media.ROUNDS * 120


def test_media_draws_every_row(spark):
    rng = random.Random(6)
    lines = lambda n: [[f"word{rng.randint(0, 3000)}" for _ in range(20)] for _ in range(n)]
    head, tail = lines(16), lines(300)
    pages = [(0, page(head + tail)), (1, page(head[:2] + lines(24))), (20, page(tail[-24:])), (3, page(lines(18) + tail[100:140])), (4, page(lines(40)))]
    assert media.draw(head + tail).shape == (316 * media.TILE[0], 20 * media.TILE[1])
    assert groups_of(media.page_sketches(spark.createDataFrame(pages, "page_id long, html string"))) == {0: 0, 1: 1, 20: 0, 3: 0, 4: 4}
    tall = np.full((33_000, 120), 255, np.uint8)
    tall[-128:] = media.draw(lines(16))
    points, _ = media.describe(tall)
    assert len(points) and points[:, 0].min() > 32_767


def test_media_recall_of_planted_crops(spark):
    rng = random.Random(8)
    draw = lambda n: media.draw([[f"word{rng.randint(0, 3000)}" for _ in range(20)] for _ in range(n)])
    images, want = [], []
    for i in range(40):
        tall, at = draw(60 + 3 * i), rng.randint(0, 52)
        crop = tall[8 * at : 8 * at + 64]
        images += [(40 * i, tall), (40 * i + 20, crop), (40 * i + 1, np.concatenate([draw(20), crop, draw(20)])), (40 * i + 2, draw(40))]
        want += [(40 * i, 40 * i + 1), (40 * i, 40 * i + 20), (40 * i + 1, 40 * i + 20)]
    rows = [(i, *x.shape, bytearray(x.tobytes())) for i, x in images]
    found = groups_of(media.sketches(spark.createDataFrame(rows, "image_id long, height int, width int, pixels binary")))
    assert all(found[i] == i or (found[i], i) in want for i, _ in images) and sum(found[a] == found[b] for a, b in want) >= 0.95 * len(want)


def test_media_small_regions_are_found(spark):
    """Four rows in common give a dozen equal descriptors: every pair is found, as every part of them is in the tables."""
    rng = random.Random(14)
    lines = lambda n: [[f"word{rng.randint(0, 3000)}" for _ in range(20)] for _ in range(n)]
    rows = []
    for i in range(30):
        common = lines(4)
        rows += [(2 * i, page(lines(9) + common + lines(6))), (2 * i + 1, page(lines(3) + common + lines(11)))]
    table = spark.createDataFrame(rows, "page_id long, html string")
    drawn = {i: media.describe(media.draw(media.article_lines(h))) for i, h in rows}
    want = reachable(sorted(drawn), lambda a, b: media.consensus(*drawn[a], *drawn[b])[0] >= media.LEAST)
    assert groups_of(media.page_sketches(table)) == want and sum(i != c for i, c in want.items()) == 30


def test_media_matches_are_near_in_all_bits(spark):
    """Parts meet in the tables, but a link needs descriptors that differ in few of all their bits."""
    rng = np.random.default_rng(15)
    code = rng.integers(0, 256, (6, 16), np.uint8)
    far, near = code.copy(), code.copy()
    far[:, 4:] = rng.integers(0, 256, (6, 12), np.uint8)  # one equal part of four
    near[:, [4, 8, 12]] ^= 7  # as well, nine bits differ
    spot = [20 * k << 24 | 30 << 8 for k in range(1, 7)]
    classes = spark.createDataFrame([(n, spot, bytearray(c.tobytes())) for n, c in ((1, code), (2, far), (3, near))], "node long, spots array<long>, codes binary")
    assert media.keys_of(classes).count() == 3 * 6 * 4
    found, nodes = media.links_of(media.keys_of(classes), classes)
    assert [(r.a, r.b, r.inliers, r.dy, r.dx) for r in found.collect()] == [(1, 3, 6, 0, 0)] and {r.node: r.component for r in nodes.collect()} == {1: 1, 3: 1}


def test_media_crops_keep_the_corners_of_their_original():
    rng = random.Random(9)
    image = media.draw([[f"word{rng.randint(0, 99)}" for _ in range(20)] for _ in range(70)])
    points, codes = media.describe(image)
    y, x, h, w = 136, 10, 200, 90
    inner = [(p[0] - y, p[1] - x, *p[2:], c.tobytes()) for p, c in zip(points.tolist(), codes, strict=True) if all((a - o) >> p[2] in range(media.PATCH + 1, (n >> p[2]) - media.PATCH - 1) for a, o, n in ((p[0], y, h), (p[1], x, w)))]
    kept = [(*p, c.tobytes()) for p, c in zip(*(v.tolist() if v.shape[1] == 4 else v for v in media.describe(image[y : y + h, x : x + w])), strict=True)]
    assert len(inner) > 50 and set(inner) <= set(kept) and len(kept) <= 1.3 * len(inner)
    # strips and stacks change nothing
    alone = [media.describe(v) for v in (image, image[:90], image[40:])]
    stacked = list(media.describe_many([image, image[:90], image[40:]]))
    for k, (p, c) in enumerate(alone):
        assert sorted((*q, d.tobytes()) for q, d in zip(p.tolist(), c, strict=True)) == sorted((*q, d.tobytes()) for o, ps, cs in stacked for n, q, d in zip(o.tolist(), ps.tolist(), cs, strict=True) if n == k)


def test_media_stacks_use_memory_again():
    """Describing more stacks asks for no fresh arrays of the size of a stack, and portions change nothing."""
    rng = random.Random(10)
    images = [media.draw([[f"word{rng.randint(0, 99)}" for _ in range(20)] for _ in range(130)]) for _ in range(6)]
    room = media.Room()
    first = list(media.describe_many(images, room))
    tracemalloc.start()
    again = [sum(len(o) for o, _, _ in media.describe_many(images, room)), tracemalloc.get_traced_memory()[1]]
    tracemalloc.stop()
    assert again[0] == sum(len(o) for o, _, _ in first) > 500 and again[1] < 2 * images[0].size
    alone = [media.describe(v) for v in images]
    assert sum(len(p) for p, _ in alone) == again[0]
    for k, (p, c) in enumerate(alone):
        assert sorted((*q, d.tobytes()) for q, d in zip(p.tolist(), c, strict=True)) == sorted((*q, d.tobytes()) for o, ps, cs in first for n, q, d in zip(o.tolist(), ps.tolist(), cs, strict=True) if n == k)


def test_media_corners_against_all_places():
    """Corners by running maxima are those of a plain comparison with every place around, ties and portions included."""
    rng = np.random.default_rng(11)
    for h, w, reach in ((300, 90, 5), (260, 70, 3), (40, 700, 5)):
        response = rng.integers(0, 60, (h, w)).astype(np.float32)
        want = []
        for y in range(media.PATCH, h - media.PATCH):
            for x in range(media.PATCH, w - media.PATCH):
                v, near = response[y, x], response[y - reach : y + reach + 1, x - reach : x + reach + 1]
                if v > 20 and v == near.max() and divmod(int(near.argmax()), 2 * reach + 1) == (reach, reach):
                    want.append((y, x))
        y, x = media.corners(response, reach, 20, media.Room())
        assert len(want) > 20 and list(zip(y.tolist(), x.tolist(), strict=True)) == want


def test_media_links_do_not_depend_on_the_order_of_rows(spark):
    """Several shifts of a pair have equally many matches: the same one is told whatever order the keys come in."""
    spot = lambda y, x: y << 24 | x << 8
    keys = [(p, n, spot(20 * p, 10 if n == 1 else 10 + 7 * (p % 3))) for p in range(1, 13) for n in (1, 2)]
    got = set()
    for seed in range(4):
        rows = random.Random(seed).sample(keys, len(keys))
        found, _ = media.links_of(spark.createDataFrame(rows, "part long, node long, spot long").coalesce(1))
        got.add(tuple(sorted((min(r.a, r.b), max(r.a, r.b), r.inliers, r.dx if r.a < r.b else -r.dx) for r in found.collect())))
    assert len(got) == 1 and next(iter(got))[0][:3] == (1, 2, 4)


def test_long_texts_are_encoded_in_portions(spark, monkeypatch):
    tok, (vocabulary, encoder, _) = Tokenizer.from_file(BYTE), bpe.byte_encoder(BYTE)
    rng = random.Random(1)
    monkeypatch.setattr(bpe, "PORTION", 997)
    parts = ["a" * 300, "the ", "  \n", "!!!", "'s", "'ll", "é", "漢字", " " * 70, "x", "12", "  ", "don't ", "."]
    many = ["".join(rng.choice(parts) for _ in range(150)) for _ in range(12)]
    many += ["".join(rng.choice("abé漢!1'") for _ in range(6000)), " " * 6000 + "x" + " " * 3000, "a" * 9000 + "!" * 5000 + "7" * 4000 + " " * 6000 + "the end"]
    many += ["".join(rng.choice(["ab" * 2000, "　", " ", "<|endoftext|>", "\n"]) for _ in range(12)) for _ in range(5)]
    for text in many:
        got = np.concatenate(list(bpe.encoded_portions(encoder, vocabulary, text, np.frombuffer(text.encode(), np.uint8))))
        assert got.tolist() == tok.encode(text, add_special_tokens=False).ids


def test_very_long_texts_and_clashing_columns(spark):
    """A text of 3 MB and one of a single letter 2 MB long, beside columns that are named as helpers are."""
    rng = random.Random(4)
    prose = " ".join(rng.choice(["alpha", "Beta,", "é", "gamma", "delta."]) + str(rng.randint(0, 99999)) for _ in range(250_000))
    rows = [(1, prose), (2, "a" * 2_000_000), (2, "a" * 2_000_000), (3, "under the mit license"), (None, None)]
    docs = spark.createDataFrame([(i, t, 1, "c", 2, 3) for i, t in rows], "doc_id long, text string, covered int, windows string, row int, blob int")
    bpe_rows, word = by_id(bpe.digests(docs)), Tokenizer.from_file(BYTE)
    for i, t in rows[:4]:
        ids = word.encode(t, add_special_tokens=False).ids
        assert (bpe_rows[i]["n_tokens"], bpe_rows[i]["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
    assert license_scan.scan_licenses(docs).count() == secret_scan.scan_secrets(docs).count() == token_ids.round_trip(docs).count() == 5
    near = by_id(minhash.near_duplicates(docs))
    assert near[1]["kept"] and near[2]["component_id"] == 2 and minhash.drop_near_duplicates(docs).count() == 4
    assert suffix_dedup.remove_repeats(docs).columns == docs.columns and suffix_dedup.repeats(docs).agg({"n_removed": "sum"}).first()[0] == 0
    assert {r["length"] for r in packing.pack_documents(docs).collect()} >= {2048}
