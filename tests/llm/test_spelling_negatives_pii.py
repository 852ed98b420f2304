"""Spelling variants, hard negatives and personal data against brute force, on tables with every awkward row."""

import collections
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pytest

from lectern.llm import hard_negatives, pii, spelling

CLASH = "doc_id long, text string, word string, n long, place long, key string, row long, base string, items string, pattern string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2, "k", 3, "b", "i", "p") for i, t in rows], CLASH).repartition(3)


# spelling


def spelled():
    rng = random.Random(3)
    words = ["abcdef", "abcdeg", "abcdefg", "aabbcc", "aabcc", "aaabbcc", "abbcc", "Straße", "straßen", "étéßà", "etéßà", "zzzzz", "zzzzzz", "word", "x" * 70, "x" * 71, "x" * 69 + "y", "y" * 64, "y" * 65, "y" * 63, "y" * 63 + "z"]
    texts = [" ".join(rng.choice(words) * 1 for _ in range(rng.randint(0, 60))) for _ in range(40)]
    texts += [" ".join(["y" * 64] * 200 + ["x" * 70] * 200)]
    texts += [None, "", "×÷ ÿÿÿÿÿ1abcdef_abcdef-ABCDEF", "É" * 9, "ab" * 50_000, "ab" * 50_000 + "c", "ab" * 50_000, "ab" * 50_000]
    return [(i * 5 - 9, t) for i, t in enumerate(texts)] + [(None, "abcdef abcdef"), (None, "abcdef abcdef"), (4, "zzzzz zzzzz"), (4, "zzzzz zzzzz")]


def brute_counts(rows, least=3):
    n = collections.Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= least}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    if len(b) - len(a) != 1:
        return False
    same = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[same:] == b[same + 1 :]


def brute_variants(n):
    near = {w: [v for v in n if v != w and abs(len(v) - len(w)) < 2 and one_edit(v, w)] for w in n}
    best = {w: min(vs, key=lambda v: (-n[v], v)) for w, vs in near.items() if vs}
    form = {w: v for w, v in best.items() if n[v] >= 2 * n[w]}
    out = {}
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n[w], len(near[w]), n.get(form.get(w)))
    return out


def by_word(df):
    rows = df.collect()
    assert len(rows) == len({r["word"] for r in rows})
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}


def test_spelling_variants(spark):
    rows = spelled()
    want = brute_variants(brute_counts(rows))
    got = by_word(spelling.spelling_variants(table(spark, rows)))
    assert got == want
    assert any(len(w) > 99_000 for w in want) and any(f and len(w) > spelling.LONG for w, (f, *_) in want.items())


def test_spelling_variants_of_random_words(spark):
    rng = random.Random(5)
    n = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 7))): rng.randint(1, 40) for _ in range(900)}
    counts = spark.createDataFrame(list(n.items()), "word string, n long").repartition(5)
    found = spelling.variants(counts)
    want = brute_variants(n)
    assert by_word(found) == want
    sizes = collections.Counter(x[1] for x in want.values())
    assert {r["root"]: r["words"] for r in spelling.groups(found).collect()} == sizes


def test_edit_drops_a_code_point(spark):
    rows = [(i, "wordlike ßßßßßßé") for i in range(600)]
    got = {r["word"]: r["n"] for r in spelling.word_counts(table(spark, rows), least_count=1).collect()}
    assert got == brute_counts(rows, 1) and len(got) > 3


def test_spelling_of_nothing(spark):
    assert spelling.spelling_variants(table(spark, [])).collect() == []
    assert spelling.spelling_variants(table(spark, [(1, None), (None, "")])).collect() == []


# hard negatives


def vectors(rng, n=400, width=6, clusters=0):
    centres = rng.normal(size=(clusters, width)) * 2 if clusters else None
    for i in range(n):
        v = rng.normal(size=width) * 0.2 if not clusters else centres[i % clusters] + rng.normal(size=width) * 0.05
        yield i, [float(np.float32(x)) for x in v], int(rng.integers(0, 4))


MOST = (1 << 63) - 1


def brute_negatives(rows):
    kept = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((i, [math.floor(256 * x) for x in v], (label + 1) % 10 if i is not None and i % 7 == 0 else label))
    out = []
    for at, (i, a, label) in enumerate(kept):
        if i is None or i % 100:
            continue
        scores = [(-max(-MOST, min(MOST, sum(x * y for x, y in zip(a, b, strict=False)))), math.inf if j is None else j, other) for k, (j, b, other) in enumerate(kept) if k != at]
        for p, pid, _ in sorted(s for s in scores if s[2] == label)[:5]:
            inside = sorted(s for s in scores if s[2] != label and 30 * -p <= 100 * -s[0] <= 90 * -p)[:10]
            out += [(i, None if pid == math.inf else pid, r + 1, None if j == math.inf else j, -p, -s) for r, (s, j, _) in enumerate(inside)]
    return sorted(out, key=repr)


def mined(spark, rows, found=hard_negatives.hard_negatives):
    df = spark.createDataFrame([(*r, "x", 5, [1]) for r in rows], "vec_id long, embedding array<float>, label int, no string, block int, v array<int>").repartition(3)
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted((tuple(r[c] for c in names) for r in found(df).collect()), key=repr)


def awkward(rng):
    rows = list(vectors(rng))
    rows += [(100, rows[100][1], rows[100][2]), (100, rows[100][1], 9), (None, rows[3][1], 1), (None, rows[3][1], 2), (700, None, 1), (800, [0.5] * 6, None), (900, [0.5, None], 1), (1000, [math.nan] * 6, 1)]
    rows += [(1100, [math.inf] + [0.1] * 5, 1), (1200, [], 1), (1300, [0.5], 2), (1400, [1.0] * 9, 3), (-100, [0.1] * 6, 3)]
    return rows + [(2000 + i, rows[0][1], i % 3) for i in range(150)]


@pytest.mark.parametrize("bits", [10, 4])
def test_hard_negatives(spark, monkeypatch, bits):
    monkeypatch.setattr(hard_negatives, "BLOCK_BITS", bits)
    monkeypatch.setattr(hard_negatives, "SLICE", 3)
    monkeypatch.setattr(hard_negatives, "PASSING", 2)
    rows = awkward(np.random.default_rng(1))
    assert mined(spark, rows) == brute_negatives(rows)


def test_hard_negatives_of_huge_components(spark):
    rows = [(i, [v * 3e7 for v in vec], label) for i, vec, label in vectors(np.random.default_rng(2), 120, 3)]
    rows = [(i, [float(np.float32(x)) for x in v], label) for i, v, label in rows]
    want = brute_negatives(rows)
    assert mined(spark, rows) == want and any(r[4] > 1 << 60 for r in want)
    small = [(i, [float(np.float32(x * 1e5)) for x in v], label) for i, v, label in vectors(np.random.default_rng(2), 120, 3)]
    assert mined(spark, small) == brute_negatives(small)


def test_hard_negatives_of_nothing(spark):
    assert mined(spark, []) == [] and mined(spark, [(100, None, 1), (200, [1.0], None)]) == []
    assert mined(spark, [(100, [1.0, 2.0], 1)]) == []


def test_zone_maps_leave_blocks_out(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK_BITS", 6)
    met, whole = [], hard_negatives.wanted

    def counted(blocks, anchors, same):
        out = whole(blocks, anchors, same)
        met.append((out.count(), blocks.n_blocks * anchors.count()))
        return out

    monkeypatch.setattr(hard_negatives, "wanted", counted)
    rows = list(vectors(np.random.default_rng(4), 3000, 5, clusters=25))
    assert mined(spark, rows) == brute_negatives(rows)
    assert met[0][0] < met[0][1] / 2 and met[1][0] < met[1][1]


@pytest.mark.parametrize("dims,bits", [(2, 4), (3, 3), (5, 2)])
def test_hilbert_curve_visits_neighbours(dims, bits):
    cells = np.array(np.meshgrid(*[range(1 << bits)] * dims)).reshape(dims, -1).T
    place = hard_negatives.hilbert(cells, bits)
    assert sorted(place) == list(range(len(cells)))
    walk = cells[np.argsort(place)].astype(int)
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


# personal data

PLAIN = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(digits):
    return sum(int(c) if k % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for k, c in enumerate(reversed(digits))) % 10 == 0


def plain_base(text):
    out = []
    for kind, pattern in PLAIN:
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": kind == "ip" and all(len(x.lstrip("0")) < 4 and int(x) <= 255 for x in m.group().split(".")), "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, *m.span()))
    return out


def personal():
    rng = random.Random(11)
    parts = ["a@b.c", "a@b.c_d@e.f", "x.y+z@host-1.example.org.", "@", "a@b", "a@b@c.d", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "001.2.3.4", "4539578763621486", "4539 5787 6362 1486", "4539-5787-6362-1487", "+1 (599) 123-4567", "+49 30 1234567890123456", "+1-", "5", "  ", "é", "\U0001f600", "word", "12", "-", "+", "."]
    texts = [rng.choice(["", " "]).join(rng.choice(parts) for _ in range(rng.randint(1, 25))) for _ in range(120)]
    for i in range(12):
        texts.append(f"my card number {4539578763621486 if i % 2 else '4539 5787 6362 1486'} and the passport id 10.0.{i}.7 end")
    texts += ["the passport id X99-123-77, he said; the version 2024-11-05", "passport ID 123456789 and card number 1234567890123456", "version 2024-11-06 version 2024-11-07"]
    texts += [None, "", "a" * 20_000 + "@" + "b" * 20_000, "9" * 5000 + ".1.2.3", "1 " * 5000]
    return [(i * 3 - 7, t) for i, t in enumerate(texts)] + [(None, "a@b.c"), (None, "a@b.c"), (5, None), (5, None)]


def plain_context(rows):
    """What the method adds, by dictionaries."""
    seen = []
    for at, (_, text) in enumerate(rows):
        text = text or ""
        spans = sorted({(a, b) for _, a, b in plain_base(text)})
        seeds = []
        for s in spans:
            if not seeds or s[0] >= seeds[-1][1]:
                seeds.append(s)
        tokens = [(m.start(), m.start() + len(m.group().rstrip("._@/+-"))) for m in re.finditer("[0-9A-Za-z][0-9A-Za-z._@/+-]*", text)]
        tokens = [(a, b) for a, b in tokens if 6 <= b - a <= 64 and len(re.findall("[0-9]", text[a:b])) >= 4 and all(b <= x or a >= y for x, y in seeds)]
        for seed, found in ((True, seeds), (False, tokens)):
            for a, b in found:
                begin = max(0, a - 48)
                words = [m.group().lower() for m in re.finditer(r"[^\W\d_]+", text[begin:a]) if m.start() or not begin]
                if words and b - a <= 64:
                    form = re.sub(r"[^\W\d_]+", "a", re.sub(r"\d+", "9", text[a:b]))
                    names = [("shape", words[-1], form)] + ([("words", words[-2], words[-1])] if len(words) > 1 else [])
                    seen.append((at, a, b, seed, "".join(c for c in text[a:b].lower() if c.isalnum()), names))
    graph = {}
    for *_, seed, instance, names in seen:
        for p in names:
            graph[p, instance] = graph.get((p, instance), False) or seed
    likely = {}
    for _ in range(pii.ROUNDS):
        sure = {}
        for p in {p for p, _ in graph}:
            mine = {i: s for (q, i), s in graph.items() if q == p}
            if sum(mine.values()) >= pii.LEAST_SEEDS:
                sure[p] = sum(1 if s else likely.get(i, 0) for i, s in mine.items()) / (len(mine) + pii.DOUBT)
        likely = {i: 1 - math.prod(1 - sure[p] for (p, j), s in graph.items() if j == i and not s and p in sure) for i in {i for (_, i) in graph}}
    out = collections.defaultdict(set)
    for at, a, b, seed, _, names in seen:
        if not seed and any(sure.get(p, 0) >= pii.SURE for p in names):
            out[at].add(("context", a, b))
    return out


def test_personal_data(spark):
    rows = personal()
    more = plain_context(rows)
    assert sum(map(len, more.values())) >= 2
    want = []
    for at, (i, t) in enumerate(rows):
        base = plain_base(t or "") if len(t or "") < 30_000 else []
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        spans = ",".join(f"{k}:{a}:{b}" for k, a, b in [*base, *sorted(more.get(at, ()))])
        counts = [sum(k == kind for k, *_ in base) for kind, _ in PLAIN]
        want.append((i, *counts, hashlib.sha256(text.encode()).hexdigest(), spans))
    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    got = [tuple(r[c] for c in names) for r in pii.find_personal_data(table(spark, rows)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_context_finds_what_no_form_describes(spark):
    rows = personal()
    spans = {r["doc_id"]: r["spans"] for r in pii.find_personal_data(table(spark, rows)).collect()}
    text = {i: t for i, t in rows}
    for i, t in text.items():
        found = [t[int(a) : int(b)] for kind, a, b in (x.split(":") for x in spans[i].split(",") if x) if kind == "context"] if t else []
        if t and t.startswith("the passport"):
            assert found == ["X99-123-77"]
        if t and t.startswith("version"):
            assert not found


def test_scan_is_linear():
    took = []
    for n in (100_000, 400_000):
        text = "a" * n + " 1." * n + "+1(" * n + "@" + "b." * n + "7-" * n
        began = time.time()
        pii.items(text, pii.base_spans(text))
        took.append(time.time() - began)
    assert took[1] < 12 * took[0] + 1


def test_personal_data_of_nothing(spark):
    assert pii.find_personal_data(table(spark, [])).collect() == []
