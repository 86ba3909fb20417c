from pyspark.sql import functions as F

from lexshift.operators import index

SCHEMA = "id string, corpus string, tokens array<string>"


def docs(spark):
    return spark.createDataFrame([("1", "a", ["x##y", "b", None, "x##y"]), ("2", "b", ["xy", "b"]), ("3", "b", None), ("4", "a", [])], SCHEMA)


def test_counts(spark):
    terms = index.positions(docs(spark))
    got = {r["term"]: (r["n"], r["n_a"], r["n_b"]) for r in index.term_counts_by_corpus(terms, ("a", "b")).collect()}
    assert got == {"xy": (3, 2, 1), "b": (2, 1, 1)}
    assert index.term_counts(index.positions(docs(spark).limit(0))).count() == 0


def test_valid(spark):
    rows = [("run_VERB", 30, 15, 15), ("a_VERB", 30, 15, 15), ("a/b", 30, 15, 15), ("éé", 30, 15, 15), ("ok", 30, 28, 2), ("ok2", 19, 10, 9), ("fine", 20, 17, 3)]
    df = spark.createDataFrame(rows, "term string, n bigint, n_a bigint, n_b bigint")
    assert {r["term"] for r in index.valid_terms(df).collect()} == {"run_VERB", "fine"}


def test_cap_and_partitions(spark):
    rows = spark.range(500).select(F.when(F.col("id") < 400, "hot").otherwise("cold").alias("term"), F.col("id").cast("string").alias("id"), F.lit(0).alias("pos"))
    a = {tuple(r) for r in index.capped(rows, 150).collect()}
    b = {tuple(r) for r in index.capped(rows.repartition(9), 150).collect()}
    assert a == b and sum(r[0] == "hot" for r in a) == 150 and sum(r[0] == "cold" for r in a) == 100


def test_cap_with_known_counts_is_the_same(spark):
    rows = spark.range(9000).select(F.when(F.col("id") < 8000, "hot").when(F.col("id") < 8990, "warm").otherwise("cold").alias("term"), F.col("id").cast("string").alias("id"), F.lit(0).alias("pos"))
    n = rows.groupBy("term").agg(F.count("*").alias("n"))
    want = {tuple(r) for r in index.capped(rows, 100).collect()}
    assert {tuple(r) for r in index.capped(rows, 100, counts=n).collect()} == want and len(want) == 210
    # counts that promise far more rows than there are: too few rows stay below the bound, so all are ranked
    wrong = n.withColumn("n", F.lit(10_000_000).cast("bigint"))
    assert {tuple(r) for r in index.capped(rows, 100, counts=wrong).collect()} == want


def test_stratified(spark):
    df = spark.createDataFrame([(f"t{i}", 1 if i < 50 else i) for i in range(60)], "term string, n bigint")
    got = index.stratified(df, 11).collect()
    assert len(got) == 11 and len({r["n"] for r in got}) == 11


def test_background(spark):
    df = spark.createDataFrame([(f"t{i}", 5) for i in range(20)], "term string, n bigint")
    targets = spark.createDataFrame([("t1",), ("t1",)], "term string")
    got = {r["term"] for r in index.background(df, targets, 100).collect()}
    assert got == {f"t{i}" for i in range(20)} - {"t1"}
    assert index.background(df, targets, 3).count() == 3


def test_reports(spark):
    counts = spark.createDataFrame([("x", 5, 4, 1)], "term string, n bigint, n_a bigint, n_b bigint")
    targets = spark.createDataFrame([("x",), ("y",), ("x",)], "term string")
    got = {r["term"]: (r["n"], r["least"], r["too_few"]) for r in index.target_report(targets, counts).collect()}
    assert got == {"x": (5, 1, True), "y": (0, 0, True)}
    assert index.index_summary(docs(spark).limit(0).select(F.col("id").alias("term")), 5).first()["mentions"] == 0
