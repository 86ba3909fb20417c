import random
from collections import Counter
from itertools import combinations

import pyarrow as pa
import pyarrow.fs
import pytest
from pyspark.sql import functions as F

from lexshift.llm import pairs, sample, terms


def brute_terms(lists):
    n, r = Counter(), Counter()
    for ws in lists:
        clean = [w.replace("##", "") for w in ws or [] if w is not None]
        n.update(clean)
        r.update(set(clean))
    return {t: (n[t], r[t]) for t in n}


@pytest.mark.parametrize("part_rows", [3, 1_000_000])
def test_term_counts(spark, part_rows):
    r = random.Random(3)
    lists = [[r.choice(["hot", "a##b", "ab", "", None, f"w{r.randint(0, 99)}"]) for _ in range(r.randint(0, 60))] for _ in range(200)] + [None, [], ["hot"] * 5000]
    df = spark.createDataFrame([(t, "x") for t in lists], "tokens array<string>, term string").repartition(3)
    got = {x["term"]: (x["occurrences"], x["records"]) for x in terms.term_counts(df, part_rows=part_rows).collect()}
    assert got == brute_terms(lists)
    assert terms.term_counts(df.limit(0)).count() == 0


def test_compaction():
    lists = pa.array([[f"w{i % 7}", "x"] for i in range(50)])
    batches = [pa.RecordBatch.from_arrays([lists.slice(i, 10)], names=["t"]) for i in range(0, 50, 10)]
    total = Counter()
    for b in terms.partial_counts(iter(batches), compact=5):
        for row in b.to_pylist():
            total[row["term"]] += row["n"]
    assert total["x"] == 50 and sum(total.values()) == 100


def partial(terms_, rows):
    """Batches of partial counts, hashes spread over 64 bits by term."""
    r = random.Random(5)
    of = {t: r.getrandbits(63) for t in terms_}
    for _ in range(rows // 100):
        ts = [r.choice(terms_) for _ in range(100)]
        yield pa.RecordBatch.from_pydict({"h": pa.array([of[t] for t in ts], pa.int64()), "term": ts, "n": pa.array([2] * 100, pa.int64()), "r": pa.array([1] * 100, pa.int64())})


@pytest.mark.parametrize(("kinds", "spills"), [(1, False), (20, False), (3000, True)])
def test_parts_over_their_bound(tmp_path, monkeypatch, kinds, spills):
    """One term, however many partial rows it has, is summed and never split; many terms go to disk and nothing stays there."""
    made = []
    monkeypatch.setattr(terms, "file_system", lambda path: (Watched(made), path.removeprefix("file://")))
    names = [f"t{i}" for i in range(kinds)]
    got = Counter()
    for b in terms.radix_aggregate(partial(names, 20_000), f"file://{tmp_path}/x", 0, part_rows=500):
        for row in b.to_pylist():
            assert row["term"] not in got
            got[row["term"]] += row["n"]
    want = Counter(t for b in partial(names, 20_000) for t in b.column(1).to_pylist())
    assert got == Counter({t: 2 * n for t, n in want.items()})
    assert bool(made) == spills and not list(tmp_path.iterdir())


class Watched:
    """A local file system that notes the folders made."""

    def __init__(self, made):
        self.made, self.fs = made, pa.fs.LocalFileSystem()

    def create_dir(self, path, **more):
        self.made.append(path)
        self.fs.create_dir(path, **more)

    def __getattr__(self, name):
        return getattr(self.fs, name)


def test_parts_are_bounded_in_bytes(tmp_path):
    long = [f"{i}-" + "x" * 2000 for i in range(400)]
    got = [row for b in terms.radix_aggregate(partial(long, 4000), f"file://{tmp_path}/x", 0, part_bytes=100_000) for row in b.to_pylist()]
    assert len(got) == 400 and sum(x["r"] for x in got) == 4000 and not list(tmp_path.iterdir())


def test_file_systems(tmp_path):
    assert terms.file_system("dbfs:/a/b")[1] == "/dbfs/a/b" and terms.file_system(f"file://{tmp_path}/x")[1] == f"{tmp_path}/x"
    assert type(terms.file_system("s3a://bucket/x?region=us-east-1")[0]).__name__ == "S3FileSystem"


def test_marks(spark):
    rows = [("rare1", 19, 19), ("rare2", 99, 4), ("mid", 20, 5), ("edge", 60, 30), ("common", 60, 31)]
    got = {r["term"]: r["mark"] for r in terms.marked(spark.createDataFrame(rows, "term string, occurrences bigint, records bigint"), 100).collect()}
    assert got == {"rare1": "rare", "rare2": "rare", "mid": None, "edge": None, "common": "common"}


def test_corpus_terms_count_ids_once(spark):
    df = spark.createDataFrame([("1", ["a", "a"]), ("1", ["a", "a"]), ("2", None), ("3", [])], "id string, tokens array<string>")
    assert [tuple(r) for r in terms.corpus_terms(df).collect()] == [("a", 2, 1, "rare")]


@pytest.mark.parametrize(("least", "lift", "block"), [(1, 0, 1000), (2, 2, 1000), (3, 4, 1000), (1, 0, 3), (1, 0, 1), (2, 2, 2)])
def test_pairs(spark, least, lift, block):
    r = random.Random(4)
    baskets = [[r.choice(["a", "b", "c", "d", None, f"i{r.randint(0, 30)}"]) for _ in range(r.randint(0, 9))] for _ in range(150)] + [None, [], [None], ["a"], ["a", "a"]]
    sets = [set(b or []) - {None} for b in baskets]
    n = sum(map(bool, sets))
    one, two = Counter(x for s in sets for x in s), Counter(p for s in sets for p in combinations(sorted(s), 2))
    want = {(a, b, k) for (a, b), k in two.items() if k >= least and k * n >= lift * one[a] * one[b]}
    df = spark.createDataFrame([(b, 1) for b in baskets], "k array<string>, items int")
    rows = pairs.item_pairs(df, "k", least, lift, block).collect()
    assert {(r["item_a"], r["item_b"], r["n_ab"]) for r in rows} == want and len(rows) == len(want)
    assert all(abs(r["lift"] - r["n_ab"] * n / (one[r["item_a"]] * one[r["item_b"]])) < 1e-9 and r["n"] == n for r in rows)
    assert pairs.item_pairs(df.limit(0), "k").count() == 0


def test_pairs_of_a_long_basket(spark):
    df = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(700)), lambda i: i.cast("string")).alias("k"))
    assert pairs.item_pairs(df, "k", 1, 0).count() == 700 * 699 // 2
    tasks = pairs._across(df.select(F.col("k").cast("array<bigint>").alias("nums")), 50, 6)
    assert tasks.groupBy("num_a", "num_b").count().where("count = 1 AND num_a < num_b").count() == 700 * 699 // 2
    assert tasks.select(F.spark_partition_id().alias("p")).distinct().count() > 2


def test_found_counts_mentions_once(spark):
    rows = [("t", str(i // 2), 0, ["x", "y"]) for i in range(12)] + [("t", f"z{i}", 0, ["q"]) for i in range(60)]
    df = spark.createDataFrame(rows, "term string, line_id string, token_index int, top_terms array<string>")
    assert [tuple(r) for r in pairs.found(df).collect()] == [("x", "y")]


def test_sample(spark):
    rows = [(None if i == 7 else str(i), i) for i in range(3000)]
    df = spark.createDataFrame(rows + rows[:1500], "id string, v int")
    one = {tuple(r) for r in sample.uniform_sample(df.repartition(50), ["id"], 100, fan_in=4).collect()}
    two = {tuple(r) for r in sample.uniform_sample(df.repartition(3), ["id"], 100).collect()}
    assert one == two and len(one) == 100 and len({r[1] for r in one}) == 100
    assert sample.uniform_sample(df, ["id"], 5000).count() == 3000
    assert sample.uniform_sample(df.limit(0), ["id"], 5).count() == 0
    other = {tuple(r)[1:] for r in sample.uniform_sample(df, ["id"], 100, seed=1).collect()}
    assert other != {r[1:] for r in one}
    with pytest.raises(ValueError):
        sample.uniform_sample(df, ["id"], 0)
    clash = sample.uniform_sample(df.withColumnRenamed("v", "Sample_Key"), ["id"], 5)
    assert clash.columns == ["sample_key", "id"] and clash.count() == 5


def test_sample_of_pieces_is_the_sample_of_all(spark):
    df = spark.createDataFrame([(str(i),) for i in range(1000)], "id string")
    parts = [sample.uniform_sample(df.where(F.col("id").cast("int") % 3 == k), ["id"], 50) for k in range(3)]
    merged = sample.merge_samples(parts[0].union(parts[1]).union(parts[2]), 50)
    assert {r["id"] for r in merged.collect()} == {r["id"] for r in sample.uniform_sample(df, ["id"], 50).collect()}


def test_sample_is_uniform(spark):
    """Every record is drawn equally often over many seeds (chi-square far below its 0.999 quantile)."""
    df = spark.createDataFrame([(str(i),) for i in range(20)] * 3, "id string").coalesce(2).cache()
    hits = Counter(r["id"] for s in range(60) for r in sample.uniform_sample(df, ["id"], 5, seed=s).collect())
    assert sum((hits[str(i)] - 15) ** 2 / 15 for i in range(20)) < 43.8
