import math
import random

import numpy as np
import pytest

from lexshift.operators import cluster, evaluate, replacements, score
from lexshift.plans import queries
from lexshift.operators import substitutes as S
from lexshift.operators.align import aligned, distance
from pyspark.sql import functions as F


def hist(spark, a, b):
    rows = [("t", "A", s, n) for s, n in a.items()] + [("t", "B", s, n) for s, n in b.items()]
    return spark.createDataFrame(rows, "term string, corpus string, sub string, n bigint")


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [({"x": 1, "y": 1}, {"x": 1, "y": 1}, 0.0), ({"x": 1}, {"y": 1}, 1.0), ({"x": 3, "y": 1}, {"x": 1, "y": 3}, 0.434421311), ({"x": 2, "y": 1}, {"y": 1, "z": 1}, 0.771645808)],
)
def test_jsd(spark, a, b, want):
    assert score.jensen_shannon(hist(spark, a, b), ("A", "B")).first()["jsd"] == want
    assert score.jensen_shannon(hist(spark, b, a), ("A", "B")).first()["jsd"] == want


def test_jsd_empty_side(spark):
    h = hist(spark, {"x": 1}, {})
    assert score.jensen_shannon(h, ("A", "B")).count() == 0
    assert score.jensen_shannon(h, ("A", "B"), require_both=False).first()["jsd"] is None


def test_band(spark):
    rows = [("a", 10, 0.5), ("b", 20, 0.5), ("c", 40, 0.9), ("d", 5, 0.1), ("e", 100, 0.3), ("f", 10, None)]
    got = {r["term"]: (r["neighbours"], r["scaled_jsd"]) for r in score.scaled(spark.createDataFrame(rows, "term string, n bigint, jsd double")).collect()}
    assert got == {"a": (2, 1.0), "b": (2, 0.5), "c": (1, 1.0), "d": (1, 0.0), "e": (0, None), "f": (None, None)}
    empty = score.scaled(spark.createDataFrame([], "term string, n bigint, jsd double"))
    assert empty.count() == 0


@pytest.mark.parametrize("chunk", [7, 1_000_000])
def test_band_like_brute_force(spark, chunk):
    r = random.Random(1)
    rows = [(f"t{i}", r.choice([3, 3, 5, 8, 17, 40, 90]) + r.randint(0, 9), round(r.random(), 1)) for i in range(150)]
    got = {x["term"]: (x["neighbours"], x["scaled_jsd"]) for x in score.scaled(spark.createDataFrame(rows, "term string, n bigint, jsd double"), 2.0, chunk).collect()}
    for t, n, j in rows:
        near = [v for u, m, v in rows if u != t and n / 2 <= m <= n * 2]
        assert got[t] == (len(near), round(sum(j >= v for v in near) / len(near), 9) if near else None)


def test_count_below():
    g = np.random.default_rng(0)
    v, a = g.integers(0, 50, 200), g.integers(0, 100, 40)
    b, limit = a + g.integers(0, 100, 40), g.integers(0, 60, 40)
    assert score.count_below(v, a, b, limit).tolist() == [int((v[x:y] < z).sum()) for x, y, z in zip(a, b, limit, strict=True)]


def test_histogram_and_filter(spark):
    df = spark.createDataFrame([("t", "A", ["x", None, "x", "y"]), ("t", "A", None), ("t", "B", [])], "term string, corpus string, top_terms array<string>")
    assert {(r["sub"], r["n"]) for r in score.histogram(df, 3).collect()} == {("x", 2)}
    ranked = spark.createDataFrame([(["a", "the", "##ing", "...", "[UNK]", "cat", "dog", "cow"],)], "w array<string>")
    assert ranked.select(S.filtered(F.col("w"), 2, ["the"])).first()[0] == ["cat", "dog"]


def test_native_model(spark):
    beside = spark.createDataFrame([("b", "a", "c"), ("b", "a", "c"), ("d", "a", "c"), ("c", "b", None), ("c", "b", None), ("c", "d", None), ("a", None, "b")], "term string, l string, r string")
    beside = beside.withColumn("term", F.concat("term", "term")).withColumn("l", F.concat("l", "l")).withColumn("r", F.concat("r", "r"))
    counts = beside.groupBy("term").agg(F.count("*").alias("n"))
    model = S.BigramModel.fit(S.adjacent(beside.withColumn("corpus", F.lit("A")), ("A", "B")), counts, spark.createDataFrame([], "word string"))
    got = model.substitutes(spark.createDataFrame([("aa", "cc"), (None, "cc"), ("zz", None)], "l string, r string"), 5)
    by = {(r["l"], r["r"]): r["top_terms"] for r in got.collect()}
    assert by == {("aa", "cc"): ["bb", "dd"], (None, "cc"): ["dd", "bb"], ("zz", None): []}  # 9/2 and 4/1; 3/2 and 2/1


def test_replacements(spark):
    rows = [("t", "A", "x", 3), ("t", "A", "y", 1), ("t", "B", "z", 2), ("u", "A", "x", 1)]
    df = spark.createDataFrame(rows, "term string, corpus string, sub string, n bigint")
    got = sorted(map(tuple, replacements.side_by_side(df, ("A", "B")).collect()))
    assert got == [("t", 1, "x", 3, "z", 2), ("t", 2, "y", 1, None, None)]


def test_correlation(spark):
    pairs = spark.createDataFrame([(str(i), float(x), float(y)) for i, (x, y) in enumerate(zip([1, 2, 2, 4, 5], [2, 1, 3, 3, 9], strict=True))], "term string, x double, y double")
    r = evaluate.correlations(pairs).first()
    assert (r["pairs"], r["pearson"], r["spearman"]) == (5, 0.806776384, 0.763157895)
    assert evaluate.correlations(pairs.limit(0)).first()["pearson"] is None
    assert evaluate.correlations(pairs.limit(1)).first()["spearman"] is None
    fit = evaluate.least_squares(pairs)
    line = evaluate.band(fit, pairs.select("x")).collect()
    assert all(p["low"] < p["y"] < p["high"] for p in line)
    slope, intercept = np.polyfit([1, 2, 2, 4, 5], [2, 1, 3, 3, 9], 1)
    assert math.isclose(fit.first()["slope"], slope, abs_tol=1e-8) and math.isclose(fit.first()["intercept"], intercept, abs_tol=1e-8)


def test_rater_mean(spark):
    df = spark.createDataFrame([("w", 0.0, 1.0, 2.0, 3.0, 0.0)], "word string, p1 double, p2 double, p3 double, p4 double, p5 double")
    assert evaluate.rater_mean(df, [f"p{i}" for i in range(1, 6)]).first()["score"] == 1.2


def test_alignment():
    assert aligned("the cats ran .".split(), "the cat run".split()) == [(0, 0), (1, 1), (2, 2), (3, -1)]
    assert aligned([], []) == [] and aligned(["a"], []) == [(0, -1)] and aligned([], ["a"]) == [(-1, 0)]
    assert distance("über", "uber") == 1 and distance("", "abc") == 3
    r = random.Random(2)
    for _ in range(200):
        t = [r.choice(["a", "bb", "ccc", ",", "dd", "e"]) for _ in range(r.randint(0, 12))]
        m = [r.choice(["a", "bb", "ccc", ",", "dx", "e"]) for _ in range(r.randint(0, 12))]
        got = aligned(t, m)
        assert sorted(i for i, _ in got if i >= 0) == list(range(len(t))) and sorted(j for _, j in got if j >= 0) == list(range(len(m)))


def test_clusters(spark):
    triangles = {("a", "b"): 3, ("b", "c"): 3, ("a", "c"): 3, ("c", "d"): 1, ("d", "e"): 3, ("e", "f"): 3, ("d", "f"): 3}
    assert cluster.communities(triangles) == [["a", "b", "c"], ["d", "e", "f"]]
    assert cluster.communities({}) == []
    subs = spark.createDataFrame([("t", "1", 0, ["x", "y", "z"]), ("t", "2", 0, ["y", "x"]), ("t", "3", 0, None)], "term string, id string, pos int, top_terms array<string>")
    got = {(r["a"], r["b"]): r["n"] for r in cluster.edges(subs).collect()}
    assert got == {("x", "y"): 2, ("x", "z"): 1, ("y", "z"): 1}
    members = spark.createDataFrame([("t", 0, s) for s in "xyz"] + [("t", 1, s) for s in "yzw"], "term string, cluster int, sub string")
    best = {r["id"]: (r["cluster"], r["similarity"]) for r in cluster.assignments(subs, members).collect()}
    assert best == {"1": (0, 1.0), "2": (0, round(2 / 3, 9))}
    self_ = spark.createDataFrame([("t", ["x", "t", "y", "z"]), ("t", ["x", "y", "z", "t"])], "term string, w array<string>")
    assert [r[0] for r in self_.select(cluster.without_self(F.col("w"), F.col("term"), 2)).collect()] == [["x", "y"], ["x", "y"]]


def test_clusters_of_all_mentions(spark, tmp_path):
    """A term of more mentions than the index keeps: each mention counts in edges, members and assignments."""
    n = 4100
    rows = spark.range(n).selectExpr("'t' AS term", "concat('d', id) AS line_id", "CAST(id AS int) AS token_index", f"CASE WHEN id < {n - 5} THEN array('a', 'b') ELSE array(concat('x', id), concat('y', id)) END AS top_terms")
    rows.union(rows.where("token_index < 50")).write.parquet(f"{tmp_path}/substitutes.parquet")
    spark.range(n).selectExpr("concat('d', id) AS id", "IF(id % 2 = 0, 'post1970s', 'pre1980s') AS corpus_group").write.parquet(f"{tmp_path}/coha_tokens.parquet")
    assert queries.QUERIES["louvain_clusters"](spark, str(tmp_path)).count() == 12
    got = [(r["n"], r["members"]) for r in queries.QUERIES["cluster_summary"](spark, str(tmp_path)).collect()]
    assert sorted(k for k, _ in got) == [1, 1, 1, 1, 1, n - 5] and any(f'"n":{n - 5}' in m for _, m in got)
