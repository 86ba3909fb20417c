"""Which substitutes stand for a term in each corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexshift.operators.index import top


def most_common(hist: DataFrame, most: int = 15) -> DataFrame:
    """``term, corpus, sub, n, rank``: ties by substitute."""
    return top(hist, ["term", "corpus"], "sub", most)


def most_common_overall(hist: DataFrame, most: int = 10) -> DataFrame:
    """``sub, n, rank`` of the substitutes of all terms together."""
    few = hist.groupBy("sub").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "sub").limit(most)
    return few.select("sub", "n", F.row_number().over(Window.orderBy(F.desc("n"), "sub")).alias("rank"))


def side_by_side(hist: DataFrame, halves: tuple[str, str], most: int | None = None) -> DataFrame:
    """``term, rank, sub_a, count_a, sub_b, count_b`` of terms that both corpora have, joined by rank."""
    both = hist.groupBy("term").agg(F.count_distinct("corpus").alias("k")).where("k = 2").select("term")
    ranked = top(hist.join(both, "term", "left_semi"), ["term", "corpus"], "sub", most or 2**31 - 1)
    a, b = (ranked.where(F.col("corpus") == c).select("term", "rank", F.col("sub").alias(f"sub_{x}"), F.col("n").alias(f"count_{x}")) for c, x in zip(halves, "ab", strict=True))
    return a.join(b, ["term", "rank"], "full_outer")
