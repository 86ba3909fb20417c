"""Streams of files that arrive in two pieces, each picked up by a run of its own."""

from datetime import datetime, timedelta

import pytest

from lexshift.streaming import counts

SCHEMA = "term string, line_id string, token_index int, written_at timestamp"
START = datetime(2020, 1, 1)


@pytest.fixture
def arriving(spark, tmp_path):
    """Writes rows as a further file of the folder; gives the stream over it."""

    def add(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        return counts.stream(spark, str(tmp_path / "in"), spark.createDataFrame([], SCHEMA))

    return add


def run(spark, df, tmp_path):
    counts.run_once(df, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    return spark.read.parquet(str(tmp_path / "out"))


def test_distinct_mentions_over_two_runs(spark, tmp_path, arriving):
    rows = [("t", "a", 1, START), ("t", "a", 1, START + timedelta(days=1)), ("t", "b", 1, START), ("u", "a", 1, START)]
    assert run(spark, counts.distinct_mentions(arriving(rows)), tmp_path).count() == 3
    later = [("t", "b", 1, START + timedelta(days=20)), ("u", "c", 2, START + timedelta(days=20))]
    got = run(spark, counts.distinct_mentions(arriving(later)), tmp_path)
    assert sorted(map(tuple, got.select("term", "line_id", "token_index").collect())) == [("t", "a", 1), ("t", "b", 1), ("u", "a", 1), ("u", "c", 2)]


def test_windowed_mentions_come_out_when_their_window_is_over(spark, tmp_path, arriving):
    rows = [("t", str(i), 0, START + timedelta(minutes=i)) for i in range(25)] + [("u", "x", 0, START)]
    df = counts.windowed_mentions(arriving(rows), "10 minutes", "1 minute")
    run(spark, df, tmp_path)
    got = run(spark, counts.windowed_mentions(arriving([("t", "end", 0, START + timedelta(days=1))]), "10 minutes", "1 minute"), tmp_path)
    found = sorted((r["start"] - START, r["term"], r["n"]) for r in got.collect())
    assert found == [(timedelta(0), "t", 10), (timedelta(0), "u", 1), (timedelta(minutes=10), "t", 10), (timedelta(minutes=20), "t", 5)]


def test_running_counts(spark, tmp_path):
    docs = spark.createDataFrame([("1", "a", ["x", "y##s", "x"]), ("2", "b", ["x", None])], "id string, corpus string, tokens array<string>")
    docs.write.parquet(str(tmp_path / "docs"))
    query = counts.running_counts(counts.stream(spark, str(tmp_path / "docs"), docs)).writeStream.outputMode("complete").format("memory").queryName("running").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(map(tuple, spark.table("running").collect())) == [("x", 3), ("ys", 1)]
