"""What stands around a mention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexshift.functions import text as X

MASK = "[MASK]"


def window(tokens: Column, pos: Column, words: Column | int = 1, radius: int = 50) -> Column:
    """Word pieces: the last ``radius`` before the mention, one mask for its ``words``, the first ``radius`` after it."""
    n = F.lit(words) if isinstance(words, int) else words
    # a token has a piece at least, so no more than radius tokens on a side are split
    near = F.least(pos, F.lit(radius))
    left = X.pieces(F.slice(tokens, pos - near + 1, near))
    right = X.pieces(F.slice(tokens, pos + n + 1, F.lit(radius)))
    kept = F.slice(left, F.greatest(F.size(left) - radius, F.lit(0)) + 1, F.lit(radius))
    return F.concat(kept, F.array(F.lit(MASK)), F.slice(right, 1, radius))


def windows(docs: DataFrame, found: DataFrame, radius: int = 50) -> DataFrame:
    """``term, id, pos, context`` of mentions ``term, id, pos``, or with ``words`` of phrases.

    The mentions of a document are brought together first, so a document is sent once, not once a mention.
    """
    more = ["words"] if "words" in found.columns else []
    by_doc = found.groupBy("id").agg(F.collect_list(F.struct("term", "pos", *more)).alias("found"))
    joined = by_doc.join(docs.select("id", "tokens"), "id")
    made = F.transform("found", lambda m: F.struct(m["term"].alias("term"), m["pos"].alias("pos"), window(F.col("tokens"), m["pos"], m["words"] if more else 1, radius).alias("context")))
    return joined.select("id", F.inline(made)).select("term", "id", "pos", "context")


def neighbours(docs: DataFrame) -> DataFrame:
    """``id, corpus, pos, term, l, r``: every token with the ones beside it, NULL at the ends. No shuffle: the list is read beside itself."""
    t = docs.select("id", "corpus", X.unmarked(F.col("tokens")).alias("t"))
    none, n = F.array(F.lit(None).cast("string")), F.size("t")
    before, after = F.concat(none, F.slice("t", 1, F.greatest(n - 1, F.lit(0)))), F.concat(F.slice("t", 2, F.greatest(n - 1, F.lit(0))), none)
    # the shifted lists lie beside the list, so that no lambda is interpreted; where there are no tokens they are longer than it
    beside = F.slice(F.arrays_zip(F.col("t").alias("term"), before.alias("l"), after.alias("r")), 1, n)
    return t.where(n > 0).select("id", "corpus", F.posexplode(beside).alias("pos", "x")).select("id", "corpus", "pos", "x.term", "x.l", "x.r").where("term IS NOT NULL")
