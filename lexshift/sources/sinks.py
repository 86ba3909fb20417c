"""Writers. Tables that grow are written in parallel; single files are for reports of bounded size."""

from __future__ import annotations

import dataclasses
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def index_maps(found: DataFrame) -> DataFrame:
    """``value``: a JSON object per term, ``{"term": .., "mentions": [[id, pos], ..]}``, mentions in order; the index is capped by term."""
    pair = F.array(F.col("id"), F.col("pos").cast("string"))
    return found.groupBy("term").agg(F.array_sort(F.collect_list(pair)).alias("mentions")).select(F.to_json(F.struct("term", "mentions")).alias("value"))


def by_term(df: DataFrame, path: str) -> None:
    """A folder per term, for tables with a column ``term``; rows are brought together by term and slice, so hot terms have several files."""
    df.repartition(F.col("term"), F.pmod(F.xxhash64(*df.columns), F.lit(8))).write.mode("overwrite").partitionBy("term").json(path)


def score_table(scores: DataFrame, path: str) -> None:
    """One CSV file in falling order of the scaled value."""
    scores.orderBy(F.desc_nulls_last("scaled_jsd"), "term").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def score_map(scores: DataFrame) -> DataFrame:
    """``value``: one JSON object from term to scaled value; NULL stays NULL."""
    entries = F.array_sort(F.collect_list(F.struct("term", "scaled_jsd")))
    return scores.agg(F.to_json(F.map_from_entries(entries), {"ignoreNullFields": "false"}).alias("value"))


def tsv(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").option("sep", "\t").csv(path)


def training_text(docs: DataFrame, path: str, seed: int = 42) -> None:
    """A document a line, train and validation apart, in shuffled order; docs: ``id, text, part``."""
    flat = docs.select("part", F.regexp_replace("text", r"\s+", " ").alias("value"), F.md5(F.concat_ws("|", F.lit(str(seed)), "id")).alias("turn"))
    for part in ("train", "val"):
        flat.where(F.col("part") == part).orderBy("turn").select("value").write.mode("overwrite").text(f"{path}/{part}")


def config_sidecar(spark: SparkSession, config: object, path: str) -> None:
    """The settings of a run, a frozen dataclass or dict, as JSON."""
    values = dataclasses.asdict(config) if dataclasses.is_dataclass(config) else dict(config)
    spark.createDataFrame([(json.dumps(values, indent=2, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)
