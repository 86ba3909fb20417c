"""Ranked substitutes of mentions, from a pluggable model; the built-in one needs counts only.

The count-based model is a stand-in for a masked language model, not a reproduction of one: a substitute is a frequent
successor of the left or predecessor of the right neighbour, scored by how well it fits both.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexshift.operators import index
from lexshift.workdir import cut


class SubstituteModel(Protocol):
    """Anything that ranks substitutes for contexts."""

    def substitutes(self, contexts: DataFrame, top_k: int) -> DataFrame:
        """``contexts`` (with columns ``l, r``) and ``top_terms``, at most ``top_k`` terms, best first."""
        ...


def acceptable(term: Column) -> Column:
    """What can be a substitute, stopwords aside."""
    return (F.length(term) > 1) & ~F.contains(term, F.lit("##")) & ~F.contains(term, F.lit("...")) & ~F.contains(term, F.lit("["))


def filtered(top_terms: Column, top_k: int, stopwords: list[str]) -> Column:
    """The first ``top_k`` acceptable terms of ranked ones that are no stopwords."""
    return F.slice(F.filter(top_terms, lambda t: acceptable(t) & ~t.isin(stopwords)), 1, top_k)


@dataclass(frozen=True)
class BigramModel:
    """Neighbour counts: ``after`` and ``before`` hold for each word its ``width`` most frequent neighbours as one map.

    The tables have a row per word, so looking up a context is two equi-joins on words; scoring happens inside the row.
    """

    after: DataFrame
    before: DataFrame

    @classmethod
    def fit(cls, adjacent: DataFrame, counts: DataFrame, stopwords: DataFrame, width: int = 30) -> BigramModel:
        """From written counts of adjacent words (``l, term, n``) and counts of words (``term, n``)."""
        pairs = adjacent.where("l IS NOT NULL").select("l", F.col("term").alias("r"), "n")
        fit = counts.where(acceptable(F.col("term"))).join(stopwords.select(F.col("word").alias("term")).distinct(), "term", "left_anti").select(F.col("term").alias("c"), F.col("n").alias("n_c"))

        def side(given: str, other: str) -> DataFrame:
            rows = pairs.select(F.col(given).alias("given"), F.col(other).alias("c"), "n").join(fit, "c")
            turn = F.row_number().over(Window.partitionBy("given").orderBy(F.desc("n"), "c"))
            few = rows.withColumn("turn", turn).where(F.col("turn") <= width)
            return few.groupBy(F.col("given").alias(given)).agg(F.map_from_entries(F.collect_list(F.struct("c", F.struct("n", "n_c")))).alias("near"))

        return cls(side("l", "r").withColumnRenamed("near", "after"), side("r", "l").withColumnRenamed("near", "before"))

    def substitutes(self, contexts: DataFrame, top_k: int = 5) -> DataFrame:
        none = F.create_map().cast("map<string,struct<n:bigint,n_c:bigint>>")
        both = contexts.join(self.after, "l", "left").join(self.before, "r", "left").select(*contexts.columns, F.coalesce("after", none).alias("after"), F.coalesce("before", none).alias("before"))
        n = lambda e: F.coalesce(e["n"], F.lit(0).cast("bigint")) + 1
        costs = F.map_zip_with("after", "before", lambda c, a, b: -(n(a) * n(b) / F.coalesce(a["n_c"], b["n_c"])))
        # sort_array orders the structs natively; a comparator would be interpreted
        ranked = F.slice(F.sort_array(F.transform(F.map_entries(costs), lambda e: F.struct(e["value"].alias("cost"), e["key"].alias("c")))), 1, top_k)
        return both.select(*contexts.columns, F.transform(ranked, lambda x: x["c"]).alias("top_terms"))


def adjacent(beside: DataFrame, halves: tuple[str, str]) -> DataFrame:
    """``l, term, n, n_a, n_b``: how often a word stands after another, in all and by corpus; ``l`` is NULL at the beginning.

    Counts of words add up from those of pairs, so the tokens are read once for both.
    """
    return index.term_counts_by_corpus(beside, halves, "l")


def bigrams(beside: DataFrame) -> DataFrame:
    """``l, r, n``: how often two words stand side by side."""
    return beside.where("l IS NOT NULL").groupBy("l", F.col("term").alias("r")).agg(F.count("*").alias("n"))


def substitutes(found: DataFrame, model: SubstituteModel, top_k: int = 5) -> DataFrame:
    """``term, id, corpus, pos, top_terms`` of mentions with neighbours. Each different context is scored once."""
    scored = model.substitutes(found.select("l", "r").distinct(), top_k)
    same = found["l"].eqNullSafe(scored["l"]) & found["r"].eqNullSafe(scored["r"])
    return found.join(scored, same).select(found["term"], found["id"], found["corpus"], found["pos"], scored["top_terms"])


def context_histogram(found: DataFrame, model: SubstituteModel, top_k: int = 5) -> DataFrame:
    """``term, corpus, sub, n`` without a row per mention: mentions are counted by context before their substitutes are looked up."""
    n = cut(found.groupBy("term", "corpus", "l", "r").agg(F.count("*").alias("k")))
    scored = model.substitutes(n.select("l", "r").distinct(), top_k).select(F.col("l").alias("l2"), F.col("r").alias("r2"), "top_terms")
    rows = n.join(scored, F.col("l").eqNullSafe(F.col("l2")) & F.col("r").eqNullSafe(F.col("r2")))
    return rows.select("term", "corpus", F.explode("top_terms").alias("sub"), "k").groupBy("term", "corpus", "sub").agg(F.sum("k").alias("n"))


def perplexity(train: DataFrame, validation: DataFrame) -> DataFrame:
    """One row: tokens and perplexity of the validation tokens under add-one bigram counts of the training tokens."""
    pairs = bigrams(train).withColumnRenamed("n", "n_lr")
    left = train.where("l IS NOT NULL").groupBy("l").agg(F.count("*").alias("n_l"))
    words = train.agg(F.count_distinct("term").alias("v"))
    seen = bigrams(validation).join(pairs, ["l", "r"], "left").join(left, "l", "left")
    p = (F.coalesce("n_lr", F.lit(0)) + 1) / (F.coalesce("n_l", F.lit(0)) + F.col("v") + 1)
    loss = seen.join(F.broadcast(words)).select("n", F.log(p).alias("log_p"))  # one row
    return loss.agg(F.sum("n").alias("tokens"), F.round(F.exp(-F.sum(F.col("n") * F.col("log_p")) / F.sum("n")), 6).alias("perplexity"))
