"""Lemmas and parts of speech of tokenized documents, from a lexicon or any other provider that fills the same columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexshift.functions import text as X


def lexicon(words: DataFrame) -> DataFrame:
    """``token, lemma, pos`` from observed pairs ``token, lemma`` (and ``pos`` if there): the commonest lemma of each token, ties by lemma."""
    pos = F.col("pos") if "pos" in words.columns else F.lit(None).cast("string")
    n = words.where("token IS NOT NULL AND lemma IS NOT NULL").select("token", "lemma", pos.alias("pos")).groupBy("token", "lemma", "pos").agg(F.count("*").alias("n"))
    turn = F.row_number().over(Window.partitionBy("token").orderBy(F.desc("n"), "lemma", "pos"))
    return n.withColumn("turn", turn).where("turn = 1").select("token", "lemma", "pos")


def lemmatized(docs: DataFrame, known: DataFrame) -> DataFrame:
    """``id, corpus, tokens, lemmas, pos``, lists of one length; a token that the lexicon lacks is its own lemma, with part X.

    The lexicon is joined by token and the lists are put together again by position, so it can have any size. Documents
    without tokens keep empty lists.
    """
    rows = docs.select("id", F.posexplode(X.unmarked(F.col("tokens"))).alias("at", "token"))
    found = rows.join(known, "token", "left").select("id", F.struct("at", F.coalesce("lemma", "token").alias("lemma"), F.coalesce("pos", F.lit("X")).alias("pos")).alias("x"))
    lists = found.groupBy("id").agg(F.array_sort(F.collect_list("x")).alias("x"))
    none = F.array().cast("array<string>")
    out = docs.select("id", "corpus", "tokens").join(lists, "id", "left")
    return out.select("id", "corpus", "tokens", F.coalesce(F.transform("x", lambda e: e["lemma"]), none).alias("lemmas"), F.coalesce(F.transform("x", lambda e: e["pos"]), none).alias("pos"))


def merged(parts: Column) -> Column:
    """Sub-tokens that touch in the text become one: text and lemma are joined, the first part's tag stays.

    parts: an array of structs ``text, lemma, pos, touches`` in order; ``touches`` says that nothing stands before it.
    """
    first = F.filter(F.transform(parts, lambda p, i: F.when((i == 0) | ~p["touches"], i)), lambda i: i.isNotNull())
    joined = lambda xs, field: F.array_join(F.transform(xs, lambda p: p[field]), "")

    def one(i: Column, k: Column) -> Column:
        own = F.slice(parts, i + 1, F.coalesce(F.get(first, k + 1), F.size(parts)) - i)
        return F.struct(joined(own, "text").alias("text"), joined(own, "lemma").alias("lemma"), F.get(parts, i)["pos"].alias("pos"))

    return F.transform(first, one)


def parsed(docs: DataFrame, parts: DataFrame) -> DataFrame:
    """``id, corpus, tokens, lemmas, pos`` with what another lemmatizer has found: ``id, parts``, sub-tokens that touch merged.

    Documents that it lacks have empty lists; ``uneven`` tells where lengths differ.
    """
    found = parts.select("id", merged(F.col("parts")).alias("m"))
    none = F.array().cast("array<string>")
    lists = (F.coalesce(F.col(f"m.{c}"), none).alias(to) for c, to in (("lemma", "lemmas"), ("pos", "pos")))
    return docs.select("id", "corpus", "tokens").join(found, "id", "left").select("id", "corpus", "tokens", *lists)


def uneven(docs: DataFrame) -> DataFrame:
    """The documents whose lists differ in length; none are dropped silently."""
    return docs.where((F.size("tokens") != F.size("lemmas")) | (F.size("tokens") != F.size("pos"))).select("id", F.size("tokens").alias("tokens"), F.size("lemmas").alias("lemmas"))


def as_units(docs: DataFrame, unit: str = "token") -> DataFrame:
    """``id, corpus, tokens`` with the unit of analysis in place of the tokens: token, token_pos, lemma or lemma_pos."""
    words = F.col("lemmas") if unit.startswith("lemma") else X.unmarked(F.col("tokens"))
    if unit not in ("token", "token_pos", "lemma", "lemma_pos"):
        raise ValueError("unit must be token, token_pos, lemma or lemma_pos")
    return docs.select("id", "corpus", (X.keyed_by_pos(words, F.col("pos")) if unit.endswith("_pos") else words).alias("tokens"))
