"""Best matches by shared terms against brute force; state of a token bucket that goes when the bucket is full."""

import json
import random
from datetime import datetime, timedelta

import pandas as pd
import pytest

from lectern.operators import matching
from lectern.operators.matching import best_overlap
from lectern.streaming import events as E


def best(items, docs):
    out = []
    for i, terms in items:
        a = set(terms or []) - {None}
        found = [(-len(a & (set(t or []) - {None})), d) for d, t in docs if d is not None]
        if a and found and min(found)[0] < 0:
            out.append((i, len(a), min(found)[1], -min(found)[0]))
    return sorted(out)


@pytest.mark.parametrize("small", [0, matching.SMALL])
def test_best_overlap(spark, monkeypatch, small):
    monkeypatch.setattr(matching, "SMALL", small)
    rng = random.Random(2)
    common, rare = [f"c{i}" for i in range(6)], [f"r{i}" for i in range(200)]
    some = lambda n: [rng.choice(common if rng.random() < 0.7 else rare) for _ in range(n)]
    docs = [(i, some(rng.randint(0, 30))) for i in range(150)] + [(900, None), (None, ["c1"]), (901, [None, "c1", "c1"])]
    items = [(i, some(rng.randint(0, 12))) for i in range(50)] + [(70, None), (71, ["nowhere"]), (72, ["nowhere", "c1", None]), (73, list(common)), (74, docs[3][1]), (75, docs[3][1])]
    a = spark.createDataFrame(items, "item long, terms array<string>")
    b = spark.createDataFrame(docs, "id long, terms array<string>").repartition(5)
    assert sorted(tuple(r) for r in best_overlap(a, b).select("item", "k", "id", "n").collect()) == best(items, docs)
    assert best_overlap(a, b.limit(0)).collect() == [] and best_overlap(a.limit(0), b).collect() == []


def test_token_bucket_state_goes_when_it_is_full(spark, tmp_path):
    start, source = datetime(2024, 1, 1), str(tmp_path / "in")
    schema = "event_id long, ts timestamp, user_id long"

    def put(number, rows):
        frame = pd.DataFrame([(i, start + timedelta(seconds=s), u) for i, s, u in rows], columns=["event_id", "ts", "user_id"])
        spark.createDataFrame(frame, schema).coalesce(1).write.mode("append").parquet(f"{source}/{number}")

    def run():
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(source)
        query = E.token_bucket(stream, "user_id", 2, 10, "0 seconds").writeStream.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True)
        query = query.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).start()
        query.awaitTermination()
        progress = [json.loads(p.json) for p in query.recentProgress]
        return [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]]

    put(0, [(1, 0, 1), (2, 0, 1), (3, 1, 1), (4, 0, 2)])
    run()
    put(1, [(5, 100, 3)])
    counts = run()
    assert counts[-1] == 1  # those of accounts 1 and 2 are gone
    put(2, [(6, 101, 1), (7, 101, 1), (8, 101, 1)])
    run()
    got = {r["event_id"]: r["allowed"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: True, 2: True, 3: False, 4: True, 5: True, 6: True, 7: True, 8: False}
