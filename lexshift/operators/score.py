"""From substitutes to scaled change: histograms, Jensen-Shannon distance, percentile among terms of like frequency."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexshift.workdir import cut

#: Terms that one task of the percentile compares with each other at most.
CHUNK = 1_000_000


def histogram(subs: DataFrame, top_k: int = 5) -> DataFrame:
    """``term, corpus, sub, n`` of the first ``top_k`` substitutes of each mention; NULL entries count nothing."""
    return subs.select("term", "corpus", F.explode(F.slice("top_terms", 1, top_k)).alias("sub")).where("sub IS NOT NULL").groupBy("term", "corpus", "sub").agg(F.count("*").alias("n"))


def jensen_shannon(hist: DataFrame, halves: tuple[str, str], require_both: bool = True) -> DataFrame:
    """``term, jsd``: the distance, base 2, rounded to 9 digits, of a term's two histograms.

    Terms with an empty side are left out, or get NULL if ``require_both`` is off.
    """
    a, b = halves
    side = lambda c: F.sum(F.when(F.col("corpus") == c, F.col("n")).otherwise(0))
    both = hist.groupBy("term", "sub").agg(side(a).alias("x"), side(b).alias("y"))
    total = hist.groupBy("term").agg(side(a).alias("sx"), side(b).alias("sy"))
    rows = both.join(total, "term").withColumn("p", F.col("x") / F.nullif(F.col("sx"), F.lit(0))).withColumn("q", F.col("y") / F.nullif(F.col("sy"), F.lit(0)))
    mean = (F.col("p") + F.col("q")) / 2
    part = lambda c: F.when(F.col(c) > 0, F.col(c) * F.log2(F.col(c) / mean)).otherwise(F.lit(0.0))
    out = rows.groupBy("term").agg(F.first("sx").alias("sx"), F.first("sy").alias("sy"), (F.sum(part("p")) / 2 + F.sum(part("q")) / 2).alias("d"))
    there = (F.col("sx") > 0) & (F.col("sy") > 0)
    jsd = F.round(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("d")))), 9)
    return out.where(there).select("term", jsd.alias("jsd")) if require_both else out.select("term", F.when(there, jsd).alias("jsd"))


def count_below(values: np.ndarray, left: np.ndarray, right: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """For each query, how many of ``values[left:right]`` are below ``limit`` (whole numbers, not negative): a wavelet matrix."""
    bits = max(1, int(values.max(initial=0)).bit_length(), int(limit.max(initial=0)).bit_length())
    row, a, b, out = values, left.copy(), right.copy(), np.zeros(len(left), np.int64)
    for k in range(bits - 1, -1, -1):
        one = (row >> k) & 1
        zeros = np.concatenate([[0], np.cumsum(1 - one)])
        up = ((limit >> k) & 1).astype(bool)
        za, zb = zeros[a], zeros[b]
        out += np.where(up, zb - za, 0)
        a, b = np.where(up, zeros[-1] + a - za, za), np.where(up, zeros[-1] + b - zb, zb)
        row = np.concatenate([row[one == 0], row[one == 1]])
    return out


def _in_band(asked: pd.DataFrame, others: pd.DataFrame, factor: float) -> pd.DataFrame:
    """Neighbours of each asked term among the others, and those whose jsd is not larger."""
    o = others.sort_values("u_n", kind="stable")
    n, jsd = o["u_n"].to_numpy(float), o["u_jsd"].to_numpy(float)
    levels = np.unique(jsd)
    at, own = asked["n"].to_numpy(float), asked["jsd"].to_numpy(float)
    left, right = np.searchsorted(n, at / factor, "left"), np.searchsorted(n, at * factor, "right")
    right = np.maximum(left, right)
    not_above = count_below(np.searchsorted(levels, jsd), left, right, np.searchsorted(levels, own, "right"))
    return pd.DataFrame({"term": asked["term"].to_numpy(), "near": right - left, "lower": not_above})


def scaled(scores: DataFrame, factor: float = 2.0, chunk: int = CHUNK) -> DataFrame:
    """``scores`` (``term, n, jsd``) with ``neighbours`` and ``scaled_jsd``.

    Neighbours are the other terms whose count is within the factor, both ends included; the scaled value is the share
    of them whose jsd is not larger, NULL without neighbours. A NULL jsd is scaled to NULL and is no neighbour.

    Terms are bucketed by the logarithm of their count, so that a band lies in three buckets. Both sides of a bucket are
    cut into chunks and each pair of chunks is counted by one task in n log n, as counts of chunks add up: no join of all
    pairs in a band is made, and no task gets more than two chunks.
    """
    scores = cut(scores)  # a row a term, used three times
    rows = scores.where("jsd IS NOT NULL AND n > 0").select("term", F.col("n").cast("double").alias("n"), "jsd", F.floor(F.log("n") / math.log(factor)).cast("int").alias("bucket"))
    sizes = {r["bucket"]: -(-r["count"] // chunk) for r in rows.groupBy("bucket").count().collect()}  # a row for each power of the factor
    if not sizes:
        return scores.withColumn("neighbours", F.lit(0).cast("bigint")).withColumn("scaled_jsd", F.lit(None).cast("double"))
    parts = lambda b: F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in sizes.items() for x in kv)), b), F.lit(0))
    count = lambda b: F.sequence(F.lit(0), parts(b) - 1)
    part = lambda b: F.pmod(F.xxhash64("term"), parts(b)).cast("int")
    near = F.filter(F.array(*(F.col("bucket") + d for d in (-1, 0, 1))), lambda b: b.isin(list(sizes)))
    asked = rows.select("term", "n", "jsd", "bucket", F.explode(near).alias("of")).select("term", "n", "jsd", "bucket", "of", F.explode(count(F.col("of"))).alias("theirs"), part(F.col("bucket")).alias("ours"))
    others = rows.select(F.col("n").alias("u_n"), F.col("jsd").alias("u_jsd"), F.col("bucket").alias("u_of"), part(F.col("bucket")).alias("u_theirs"), F.explode(near).alias("u_bucket")).select("*", F.explode(count(F.col("u_bucket"))).alias("u_ours"))
    keys = ["bucket", "ours", "of", "theirs"]
    counted = asked.groupBy(*keys).cogroup(others.groupBy(*(f"u_{k}" for k in keys))).applyInPandas(lambda a, b: _in_band(a, b, factor), "term string, near bigint, lower bigint")
    total = counted.groupBy("term").agg(F.sum("near").alias("near"), F.sum("lower").alias("lower"))
    out = scores.join(total, "term", "left")  # a term finds itself once in its band
    others_n = F.greatest(F.coalesce(F.col("near"), F.lit(1)) - 1, F.lit(0))
    return out.select(*scores.columns, F.when(F.col("jsd").isNotNull(), others_n).alias("neighbours"), F.when(F.col("jsd").isNotNull(), F.round((F.col("lower") - 1) / F.nullif(others_n, F.lit(0)), 9)).alias("scaled_jsd"))


def only_targets(scores: DataFrame, targets: DataFrame) -> DataFrame:
    return scores.join(targets.select("term").distinct(), "term", "left_semi")


def missing_targets(scores: DataFrame, targets: DataFrame) -> DataFrame:
    return targets.select("term").distinct().join(scores, "term", "left_anti")


def mention_counts(subs: DataFrame, halves: tuple[str, str]) -> DataFrame:
    """``term, count_a, count_b``: the mentions behind a score."""
    a, b = halves
    return subs.groupBy("term").agg(F.count_if(F.col("corpus") == a).alias("count_a"), F.count_if(F.col("corpus") == b).alias("count_b"))


def diagnostics(scores: DataFrame, most: int = 15) -> DataFrame:
    """``kind, rank, term, n, neighbours``: the rarest terms, and those with the fewest and the most neighbours."""
    known = scores.where("neighbours IS NOT NULL").select("term", "n", "neighbours")
    kinds = [("rarest", F.asc("n")), ("fewest_neighbours", F.asc("neighbours")), ("most_neighbours", F.desc("neighbours"))]
    parts = [known.orderBy(order, "term").limit(most).select(F.lit(kind).alias("kind"), F.row_number().over(Window.orderBy(order, "term")).alias("rank"), "term", "n", "neighbours") for kind, order in kinds]
    return parts[0].union(parts[1]).union(parts[2])
