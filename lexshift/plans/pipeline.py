"""The whole way from a tokenized corpus to scaled change.

Tables that are read several times are written on the way (``cut``), so jobs run while the plan is built; what comes back is
lazy.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexshift.operators import context, index, score
from lexshift.operators.substitutes import BigramModel, SubstituteModel, adjacent, context_histogram
from lexshift.workdir import cut


@dataclass(frozen=True)
class Config:
    """Settings that define a run."""

    halves: tuple[str, str]
    min_count: int = 20
    min_per_corpus: int = 3
    cap: int = 4000
    top_k: int = 5
    factor: float = 2.0
    seed: int = 42
    require_both: bool = True


def lexical_change(docs: DataFrame, stopwords: DataFrame, config: Config, targets: DataFrame | None = None, model: SubstituteModel | None = None) -> DataFrame:
    """``term, n, jsd, neighbours, scaled_jsd`` of the valid terms, and of the targets if given, of ``id, corpus, tokens``."""
    beside = context.neighbours(docs)
    pairs = cut(adjacent(beside, config.halves))  # one pass over the tokens for all counts of words and of pairs
    counts = cut(index.summed(pairs))  # a row a term, read several times
    valid = index.valid_terms(counts, config.min_count, config.min_per_corpus)
    wanted = counts.join(index.union_terms(valid, targets), "term", "left_semi") if targets is not None else valid
    found = index.capped(beside, config.cap, config.seed, wanted)
    ranked = model or BigramModel.fit(pairs, counts, stopwords)
    hist = cut(context_histogram(found, ranked, config.top_k))  # read twice; made once
    jsd = score.jensen_shannon(hist, config.halves, config.require_both)
    return score.scaled(counts.join(jsd, "term").select("term", "n", "jsd"), config.factor)


def change_of(subs: DataFrame, counts: DataFrame, config: Config) -> DataFrame:
    """The same of substitutes that were made before: ``term, corpus, top_terms``; counts: ``term, n``."""
    jsd = score.jensen_shannon(score.histogram(subs, config.top_k), config.halves, config.require_both)
    rows = jsd.join(counts, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n"), "jsd")
    return score.scaled(rows, config.factor)
