"""Each stage of the pipeline and the whole of it on a small table, against plain Python."""

import random
import re

import pytest

from lectern.llm import secret_scan

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table():
    rng = random.Random(11)
    words = [f"word{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows, labels = [], []
    for i in range(240):
        toxic = i % 6 == 0
        rows.append((i, text(rng.randint(20, 60)) + (" you vile loserling vile scum loserling " if toxic else "")))
        labels.append((i, 1, int(toxic)))
    base = [t for i, t in rows if i % 6][:5]
    rows += [(1000, base[0]), (1001, base[0].replace(" ", "  ")), (1002, base[1] + " " + text(2)), (1003, text(30) + " password=abcdef12 " + text(5)), (1004, None), (1005, ""), (1005, ""), (None, "alone without a name here"), (None, "alone without a name here"), (1006, text(9000)), (1, dict(rows)[1])]
    return rows, labels


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    where, (rows, labels) = tmp_path_factory.mktemp("tables"), table()
    spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in rows], SCHEMA).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return str(where)


def pairs(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def test_stages_and_the_whole(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "exact_dedup", "near_dedup", "secret_scan", "packing"]
    clean = stages["toxicity"](spark, docs, folder)
    assert clean.columns == docs.columns
    assert pairs(clean) == sorted([(i, t) for i, t in table()[0] if "loserling" not in (t or "")], key=str)

    exact = stages["exact_dedup"](spark, clean, folder)
    groups: dict = {}
    for i, t in pairs(clean):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i or 0, i, t))
    want = sorted(((min(g)[3], min(g)[4]) for g in groups.values()), key=lambda x: str((x[0], x[1] or "")))
    assert sorted(((i, t or "") for i, t in pairs(exact)), key=str) == [(i, t or "") for i, t in want] and exact.columns == docs.columns

    near = stages["near_dedup"](spark, exact, folder)
    left = pairs(exact)
    sets, parent = [shingles(t) for _, t in left], list(range(len(left)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(left)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                parent[top(a)] = top(b)
    heads: dict = {}
    for k, (i, t) in enumerate(left):
        heads.setdefault(top(k), []).append((i is None, i or 0, i, t))
    assert pairs(near) == sorted([min(h)[2:] for h in heads.values()], key=str) and len(heads) < len(left)

    redacted = stages["secret_scan"](spark, near, folder)
    assert redacted.columns == docs.columns and redacted.count() == near.count()
    assert pairs(redacted) == sorted([(i, t and re.sub(r"password=abcdef12", "[SECRET]", t)) for i, t in pairs(near)], key=str)
    assert all(r["n_chars"] == len(r["text"] or "") for r in redacted.collect())

    packed = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in redacted.select("doc_id").collect()}
    assert sum(r["piece"] == 0 for r in packed) == redacted.count() and max(r["length"] for r in packed) <= 2048
    places: dict = {}
    for r in packed:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for p in places.values():
        assert [o for o, _ in sorted(p)] == [sum(n for _, n in sorted(p)[:k]) for k in range(len(p))]


def test_stages_take_empty_tables(spark, folder):
    none = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, folder).collect() == []
    assert secret_scan.redact(none).columns == none.columns
