"""Access to the parquet tables of one data folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexshift.workdir import bytes_of, cut

#: Keys that occur more than once, up to which they are sent to every task as 64-bit hashes; bytes of a table up to which a pass over its keys is not worth the shuffle it saves.
REPEATED_KEYS, SMALL_BYTES = 1_000_000, 8_000_000
#: Bytes of a written table up to which it is broadcast to be joined; rows of one key from which on they are spread over tasks, and how many such keys there are at most.
BROADCAST_BYTES, HOT_ROWS, HOT_KEYS = 4_000_000, 100_000, 10_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def one_per_key(df: DataFrame, *keys: str, limit: int = REPEATED_KEYS, small: int = SMALL_BYTES) -> DataFrame:
    """One row per key, for tables whose repeated rows agree in the columns kept here.

    Spark keeps one row per key on the map side already, so a key that holds a third of all rows arrives as one row
    per input partition. NULL is a key like any other. In a table of over ``small`` bytes only rows of repeated keys are
    shuffled (``parted``); the rows that come out are the same.
    """
    if bytes_of(df) <= small:
        return df.dropDuplicates(list(keys))
    apart, again = parted(df, *keys, limit=limit)
    return again.dropDuplicates(list(keys)) if apart is None else apart.unionByName(again.dropDuplicates(list(keys)))


def parted(df: DataFrame, *keys: str, limit: int = REPEATED_KEYS) -> tuple[DataFrame | None, DataFrame]:
    """The rows whose key is certainly met once, and all others, so that only those need be shuffled to find repeats.

    Only the keys are read and shuffled to find those that repeat. If these are at most ``limit`` (measured), their
    hashes are broadcast, 8 bytes each; two keys with one hash merely go with the others. Beyond the limit no row is known to
    be met once (None): all of them take the long way.
    """
    hashed: Column = F.xxhash64(*(F.col(quoted(k)) for k in keys))
    again = cut(df.select(hashed.alias("key")).groupBy("key").count().where("count > 1").select("key"))
    if again.count() > limit:
        return None, df
    known = F.broadcast(again.select(F.col("key").alias("_again")))
    return df.join(known, hashed == F.col("_again"), "left_anti"), df.join(known, hashed == F.col("_again"), "left_semi")


def spread_join(many: DataFrame, few: DataFrame, key: str, broadcast_bytes: int = BROADCAST_BYTES, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``many`` joined with the written table ``few`` on ``key``.

    A table of at most ``broadcast_bytes`` is broadcast. Otherwise keys with more than ``hot_rows`` rows in ``many`` are
    spread over as many tasks as their rows need, ``few`` being repeated for these keys only. There are at most HOT_KEYS
    of them, as the bound rises with the number of all rows.
    """
    if bytes_of(few) <= broadcast_bytes:
        return many.join(F.broadcast(few), key)
    most = max(hot_rows, many.count() // HOT_KEYS)
    hot = cut(many.groupBy(key).count().where(F.col("count") > most).select(key, F.ceil(F.col("count") / most).cast("int").alias("shares")))
    if hot.isEmpty():
        return many.join(few, key)
    hot = F.broadcast(hot)
    plain = [c for c in many.columns if c != key and not isinstance(many.schema[c].dataType, T.ArrayType)]
    share = F.coalesce(F.pmod(F.xxhash64(*plain), F.col("shares")), F.lit(0)).cast("int")  # by hash, so the same when a task is repeated
    left = many.join(hot, key, "left").withColumn("share", share).drop("shares")
    right = few.join(hot, key, "left").withColumn("share", F.explode(F.sequence(F.lit(0), F.coalesce("shares", F.lit(1)) - 1))).drop("shares")
    return left.join(right, [key, "share"]).drop("share")


def quoted(name: str) -> str:
    """A column's name as SQL takes it, whatever signs it holds."""
    return "`" + name.replace("`", "``") + "`"
