"""Scores against human judgements."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexshift.functions import stats

#: Words that evaluations of the decade corpus leave out, first and then.
EXCLUDED, EXCLUDED_THEN = ["extracellular"], ["extracellular", "assay", "mediaeval", "sulphate"]


def scored_pairs(scores: DataFrame, gold: DataFrame, column: str = "scaled_jsd", excluded: list[str] | None = None) -> DataFrame:
    """``term, x, y`` of the words that have both values; repeated gold rows count once."""
    wanted = gold.where(F.col("score").isNotNull() & ~F.col("term").isin(excluded or [])).select("term", F.col("score").alias("y")).distinct()
    return scores.select("term", F.col(column).alias("x")).where("x IS NOT NULL").join(wanted, "term")


def without_excluded(scores: DataFrame, gold: DataFrame, column: str = "scaled_jsd") -> DataFrame:
    """The correlations without EXCLUDED, and without EXCLUDED_THEN; ``without`` says which."""
    a, b = (correlations(scored_pairs(scores, gold, column, words)).select(F.lit(name).alias("without"), "*") for name, words in (("excluded", EXCLUDED), ("excluded_then", EXCLUDED_THEN)))
    return a.union(b)


def unscored(scores: DataFrame, gold: DataFrame) -> DataFrame:
    return gold.select("term").distinct().join(scores, "term", "left_anti")


def average_rank(column: str) -> Column:
    """Ranks with ties at their mean. The window is over the judged words, a set that people rated one by one."""
    w = Window.orderBy(column)
    return F.rank().over(w) + (F.count("*").over(Window.partitionBy(column)) - 1) / F.lit(2.0)


def correlations(pairs: DataFrame) -> DataFrame:
    """One row: pairs, Pearson's r and Spearman's rho with p-values; NULL where they are undefined."""
    ranked = pairs.withColumn("rx", average_rank("x")).withColumn("ry", average_rank("y"))
    rows = ranked.agg(F.count("*").alias("pairs"), _corr("x", "y").alias("pearson"), _corr("rx", "ry").alias("spearman"))
    p = F.udf(lambda r, n: stats.two_sided_p(r, n), T.DoubleType())  # one row
    return rows.select("pairs", F.round("pearson", 9).alias("pearson"), F.round(p("pearson", "pairs"), 9).alias("pearson_p"), F.round("spearman", 9).alias("spearman"), F.round(p("spearman", "pairs"), 9).alias("spearman_p"))


def _corr(x: str, y: str) -> Column:
    return F.when((F.count("*") > 1) & (F.stddev_pop(x) > 0) & (F.stddev_pop(y) > 0), F.corr(x, y))


def least_squares(pairs: DataFrame) -> DataFrame:
    """One row: slope, intercept, and what the band around the line needs."""
    b, a = F.regr_slope("y", "x"), F.regr_intercept("y", "x")
    n = F.count("*")
    rest = F.regr_syy("y", "x") - b * F.regr_sxy("y", "x")
    error = F.sqrt(F.greatest(rest, F.lit(0.0)) / F.nullif(n - 2, F.lit(0)))
    return pairs.agg(n.alias("pairs"), F.round(b, 9).alias("slope"), F.round(a, 9).alias("intercept"), F.round(F.avg("x"), 9).alias("mean_x"), F.round(F.regr_sxx("y", "x"), 9).alias("sxx"), F.round(error, 9).alias("error"))


def band(fit: DataFrame, at: DataFrame, level: float = 0.95) -> DataFrame:
    """The line and its confidence band at the points ``x``, of a fit of one row."""
    f = fit.first()
    n = f["pairs"]
    t = stats.t_quantile(0.5 + level / 2, n - 2) if n > 2 else math.nan
    y = F.lit(f["intercept"]) + F.lit(f["slope"]) * F.col("x")
    half = F.lit(t) * F.lit(f["error"]) * F.sqrt(F.lit(1.0 / n) + F.pow(F.col("x") - F.lit(f["mean_x"]), 2) / F.lit(f["sxx"]))
    return at.select("x", y.alias("y"), (y - half).alias("low"), (y + half).alias("high"))


def rater_mean(ratings: DataFrame, raters: list[str]) -> DataFrame:
    """``word, score``: the mean of the raters; NULL if one has not rated."""
    return ratings.select("word", (sum((F.col(r) for r in raters[1:]), F.col(raters[0])) / len(raters)).alias("score"))


def coverage(indexed: DataFrame, original: DataFrame) -> DataFrame:
    """``term, indexed, original, share`` of each term's mentions."""
    n = lambda d, c: d.groupBy("term").agg(F.count("*").alias(c))
    return n(original, "original").join(n(indexed, "indexed"), "term", "left").select("term", F.coalesce("indexed", F.lit(0)).alias("indexed"), "original", F.round(F.coalesce("indexed", F.lit(0)) / F.col("original"), 9).alias("share"))


def index_sizes(by_corpus: DataFrame) -> DataFrame:
    """One row: mean and median of ``n``, and of the smaller of ``n_a`` and ``n_b``."""
    small = F.least("n_a", "n_b")
    return by_corpus.agg(F.round(F.avg("n"), 9).alias("mean_n"), F.median("n").alias("median_n"), F.round(F.avg(small), 9).alias("mean_least"), F.median(small).alias("median_least"))
