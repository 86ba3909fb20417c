import random
from collections import defaultdict

import pyarrow as pa
import pytest

from lexshift.llm import pack


def filled(rows):
    by = defaultdict(int)
    for r in rows:
        by[r["container"]] += r["size"]
    return by


@pytest.mark.parametrize("kind", ["mixed", "small", "one size", "large"])
def test_pack(spark, kind):
    r = random.Random(6)
    size = {"mixed": lambda: min(100, int(r.expovariate(1 / 25)) + 1), "small": lambda: r.randint(1, 6), "one size": lambda: 34, "large": lambda: r.randint(51, 100)}[kind]
    items = [(f"i{n}", size()) for n in range(3000)]
    df = spark.createDataFrame(items, "id string, size int")
    rows = pack.pack(df, 100, 400).collect()
    assert sorted((x["id"], x["size"]) for x in rows) == sorted(items)
    by = filled(rows)
    assert max(by.values()) <= 100
    need = {"mixed": -(-sum(s for _, s in items) // 100), "small": -(-sum(s for _, s in items) // 100), "one size": 1500, "large": 3000}[kind]
    assert len(by) <= need * 1.01 + 8
    again = pack.pack(df.repartition(5), 100, 400).collect()
    assert {(x["id"], x["container"]) for x in rows} == {(x["id"], x["container"]) for x in again}


def test_pack_edges(spark):
    schema = "id string, size int"
    assert pack.pack(spark.createDataFrame([], schema), 100).count() == 0
    rows = pack.pack(spark.createDataFrame([("a", 100), ("b", 50), ("c", 50), ("d", 1)], schema), 100).collect()
    assert sorted(filled(rows).values()) == [1, 100, 100]


def test_sweep_takes_the_smallest_gap():
    rows = pa.table({"kind": [1, 1, 0, 0], "id": ["big", "small", "x", "y"], "size": pa.array([90, 40, 40, 45], pa.int32())})
    out = {r["id"]: r["container"] for r in pack.sweep(rows, 100, False).to_pylist() if r["kind"] == 2}
    assert out == {"x": "small", "y": "big"}


def test_documents(spark):
    texts = [None, "", " ", "one word", "one word", "many words here " * 2000, "x" * 30_000]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(3, "one word", 1)], "doc_id bigint, text string, container int")
    rows = pack.packed_documents(df, capacity=512).collect()
    enc = pack._encoding(f"{pack.TOKENIZERS}/{pack.VOCABULARY}")
    by, spans = defaultdict(list), defaultdict(list)
    for r in rows:
        spans[r["doc_id"]].append((r["first_token"], r["n_tokens"]))
        if r["container"]:
            by[r["container"]].append((r["position"], r["n_tokens"]))
    for i, t in enumerate(texts):
        n = len(enc.encode_ordinary(t or ""))
        assert sum(k for _, k in spans[i]) == n and len(spans[i]) == max(1, -(-n // 512))
        at = 0
        for a, k in sorted(spans[i]):
            assert a == at
            at += k
    for parts in by.values():
        at = 0
        for a, k in sorted(parts):
            assert a == at
            at += k
        assert at <= 512
    assert sum(r["container"] is None for r in rows) == 2


def test_settings_of_the_session_change_nothing(spark):
    r = random.Random(22)
    df = spark.createDataFrame([(f"i{n}", min(100, int(r.expovariate(1 / 25)) + 1)) for n in range(5000)], "id string, size int")
    before, got = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in (1, 4, 64):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got.append(sorted(map(tuple, pack.pack(df.repartition(n % 7 + 1), 100, 700).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0] == got[1] == got[2]


def test_faults_are_seen(spark):
    schema = "doc_id int, piece_no int, first_token bigint, n_tokens int, container string, position int"
    good = [(1, 0, 0, 60, "a", 0), (2, 0, 0, 40, "a", 60), (3, 0, 0, 0, None, None), (4, 0, 0, 100, "b", 0), (4, 1, 100, 5, "c", 0)]
    bad = [(1, 0, 0, 60, "a", 0), (2, 0, 0, 50, "a", 60), (4, 0, 0, 50, "b", 0), (4, 1, 50, 5, "c", 1)] + [(n, 0, 0, 1, f"x{n}", 0) for n in range(10, 20)]
    assert [tuple(pack.faults(spark.createDataFrame(rows, schema), 100).first()) for rows in (good, bad)] == [(4, 0, 0, 0, False), (13, 1, 1, 1, True)]
