import os
from types import SimpleNamespace

import pytest

from lexshift import workdir
from lexshift.tables import one_per_key, parted, spread_join


def session(**conf):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: conf.get(k, d), set=conf.__setitem__))


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        workdir.shared_base(session(**{"spark.master": "spark://host:7077"}))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        workdir.shared_base(session(**{"spark.master": "local-cluster[3,4,6000]"}))


def test_tables_are_deleted_with_their_scope(spark):
    with workdir.scope(spark):
        made = workdir.cut(spark.range(10))
        assert made.count() == 10 and workdir.bytes_of(made) > 0
        folder = os.path.dirname(made.inputFiles()[0].removeprefix("file://"))
        assert os.path.isdir(folder)
        kept = workdir.shared_base(spark)
    assert not os.path.exists(folder) and workdir.shared_base(spark) == kept


def test_tables_are_deleted_after_an_error(spark):
    with pytest.raises(ZeroDivisionError), workdir.scope(spark):
        folder = os.path.dirname(workdir.cut(spark.range(1)).inputFiles()[0].removeprefix("file://"))
        1 / 0
    assert not os.path.exists(folder)


@pytest.mark.parametrize("limit", [0, 100])
def test_one_row_a_key(spark, limit):
    rows = [("a", 1), ("a", 1), ("b", 2), (None, 3), (None, 3), ("", 4)] + [(f"k{i}", i) for i in range(50)]
    df = spark.createDataFrame(rows, "id string, `x y` int").repartition(3)
    assert sorted(map(str, one_per_key(df, "id", limit=limit).collect())) == sorted({str(x) for x in df.collect()})
    assert one_per_key(df, "id", "x y", limit=limit).count() == 54
    assert sorted(map(str, one_per_key(df, "id", small=10**30).collect())) == sorted({str(x) for x in df.collect()})
    assert one_per_key(df.limit(0), "id", limit=limit).count() == 0
    apart, again = parted(df, "id", limit=limit)
    assert (apart is None and again.count() == 56) if not limit else (apart.count() == 52 and again.count() == 4)


@pytest.mark.parametrize(("broadcast", "hot"), [(10**7, 10**6), (-1, 10**6), (-1, 20)])
def test_spread_join(spark, broadcast, hot):
    many = spark.createDataFrame([("hot", i) for i in range(300)] + [(f"k{i % 7}", i) for i in range(50)] + [(None, 1)], "key string, x int")
    few = workdir.cut(spark.createDataFrame([("hot", 1), ("hot", 2), ("k1", 3), ("none", 4), (None, 5)], "key string, y int"))
    got = spread_join(many, few, "key", broadcast, hot)
    assert got.columns == ["key", "x", "y"] and sorted(map(tuple, got.collect())) == sorted(map(tuple, many.join(few, "key").collect()))
    assert spread_join(many.limit(0), few, "key", broadcast, hot).count() == 0
