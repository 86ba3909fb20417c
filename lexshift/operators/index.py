"""Terms: counting, validity, choice, phrases, and the index of their mentions."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexshift.functions import text as X
from lexshift.operators.corpus import unit
from lexshift.workdir import cut


def positions(docs: DataFrame, surface: bool = False) -> DataFrame:
    """``id, corpus, pos, term`` of every token of ``id, corpus, tokens``; marks are removed. surface: the token with its marks besides."""
    more = [F.col("token").alias("surface")] if surface else []
    return docs.select("id", "corpus", F.posexplode("tokens").alias("pos", "token")).select("id", "corpus", "pos", X.unmark(F.col("token")).alias("term"), *more).where("term IS NOT NULL")


def term_counts(terms: DataFrame) -> DataFrame:
    """``term, n``."""
    return terms.groupBy("term").agg(F.count("*").alias("n"))


def term_counts_by_corpus(terms: DataFrame, halves: tuple[str, str], *before: str) -> DataFrame:
    """``term, n, n_a, n_b``, grouped by the columns ``before`` as well; the corpora are named, so no pass is needed to find them."""
    a, b = halves
    return terms.groupBy(*before, "term").agg(F.count("*").alias("n"), F.count_if(F.col("corpus") == a).alias("n_a"), F.count_if(F.col("corpus") == b).alias("n_b"))


def summed(counts: DataFrame) -> DataFrame:
    """The same from rows ``term, n, n_a, n_b`` that are counts already."""
    return counts.groupBy("term").agg(*(F.sum(c).alias(c) for c in ("n", "n_a", "n_b")))


def documents_per_corpus(docs: DataFrame) -> DataFrame:
    return docs.groupBy("corpus").agg(F.count("*").alias("documents"))


def looks_valid(term: Column) -> Column:
    """Two characters at least and an ASCII letter or digit before the part of speech, no slash."""
    word = X.before_underscore(term)
    return (F.length(word) >= 2) & ~F.contains(term, F.lit("/")) & F.rlike(word, F.lit("[a-zA-Z0-9]"))


def valid_terms(counts: DataFrame, min_count: int = 20, min_per_corpus: int = 3) -> DataFrame:
    """Rows of ``term, n, n_a, n_b`` that can be background terms."""
    return counts.where((F.col("n") >= min_count) & (F.least("n_a", "n_b") >= min_per_corpus) & looks_valid(F.col("term")))


def min_background_count() -> Column:
    """Half the rarest target's count, rounded down, as an aggregate."""
    return F.floor(F.min("n") / 2)


def _hash(seed: int, *columns: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *columns))


def background(valid: DataFrame, targets: DataFrame, most: int, seed: int = 42) -> DataFrame:
    """At most ``most`` valid terms that are no targets, in hash order: a seeded choice that does not depend on partitions."""
    return valid.join(targets.select("term").distinct(), "term", "left_anti").orderBy(_hash(seed, "term"), "term").limit(most)


def background_beside(valid: DataFrame, targets: DataFrame, most: int, seed: int = 42) -> DataFrame:
    """So many background terms that with the targets, which are counted, there are ``most`` at the most."""
    return background(valid, targets, max(0, most - targets.select("term").distinct().count()), seed)


def valid_beside(counts: DataFrame, targets: DataFrame) -> DataFrame:
    """Rows of ``term, n, ..`` that look valid and are at least half as frequent as the rarest target; without targets none."""
    least = counts.join(targets.select("term").distinct(), "term", "left_semi").agg(min_background_count().alias("k")).first()["k"]
    return counts.where((F.col("n") >= F.lit(least)) & looks_valid(F.col("term")))


def from_offset(terms: DataFrame, start: int) -> DataFrame:
    """``term``: all but the first ``start`` in order, to go on with what an earlier run has left."""
    return terms.select("term").distinct().orderBy("term").offset(start)


def stratified(counts: DataFrame, most: int, seed: int = 42) -> DataFrame:
    """At most ``most`` terms, spread over counts: in each round one term of every count, counts and terms in hash order."""
    turn = F.row_number().over(Window.partitionBy("n").orderBy(_hash(seed, "term"), "term"))
    ranked = counts.select("term", "n", turn.alias("round")).where(F.col("round") <= most)  # later rounds are out of reach; lets Spark limit each group early
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("round").cast("string"), F.col("n").cast("string")))
    return ranked.orderBy("round", order, "n").limit(most)


def mentions(terms: DataFrame, wanted: DataFrame) -> DataFrame:
    """The positions of the wanted terms."""
    return terms.join(wanted.select("term").distinct(), "term", "left_semi")


def capped(found: DataFrame, most: int = 4000, seed: int = 42, counts: DataFrame | None = None) -> DataFrame:
    """At most ``most`` mentions of each term, a uniform choice: those whose hashes are smallest.

    counts: ``term, n`` of the terms wanted and the number of their mentions, if known. Then one pass ranks only rows
    whose hash is below a bound under which ten standard deviations more than ``most`` are expected, so hot terms are
    not sorted. Should a term have fewer there than it must, all its rows are ranked after all: the choice is the same.
    """
    if counts is None:
        return _smallest(found, most, seed)
    known = counts.select("term", F.col("n").alias("_n"))
    share = (most + 10 * math.sqrt(most) + 20) / F.col("_n")
    low = found.join(known, "term").where((F.col("_n") <= most) | (unit(seed, "term", "id", "pos") <= share)).drop("_n")
    ranked = cut(_smallest(low, most, seed))
    short = known.join(ranked.groupBy("term").agg(F.count("*").alias("k")), "term", "left").where(F.coalesce("k", F.lit(0)) < F.least("_n", F.lit(most))).select("term")
    if short.isEmpty():
        return ranked
    return ranked.join(short, "term", "left_anti").unionByName(_smallest(found.join(short, "term", "left_semi"), most, seed))


def _smallest(found: DataFrame, most: int, seed: int) -> DataFrame:
    """Spark limits each group on the map side first."""
    order = Window.partitionBy("term").orderBy(_hash(seed, "term", "id", "pos"), "id", "pos")
    return found.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= most).drop("turn")


def index_summary(found: DataFrame, cap: int) -> DataFrame:
    """One row: terms, mentions, terms at the cap, fewest and most mentions."""
    n = term_counts(found)
    return n.agg(F.count("*").alias("terms"), F.coalesce(F.sum("n"), F.lit(0)).alias("mentions"), F.count_if(F.col("n") >= cap).alias("capped"), F.min("n").alias("fewest"), F.max("n").alias("most"))


def target_report(targets: DataFrame, counts: DataFrame, min_per_corpus: int = 3) -> DataFrame:
    """Each target's counts, 0 where it does not occur, and whether a corpus has too few."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    rows = targets.select("term").distinct().join(counts, "term", "left").select("term", zero("n"), zero("n_a"), zero("n_b"))
    return rows.withColumn("least", F.least("n_a", "n_b")).withColumn("too_few", F.col("least") < min_per_corpus)


def surface_forms(found: DataFrame, most: int = 100) -> DataFrame:
    """``term, surface, n, rank``: the commonest forms of each term, ties by form."""
    n = found.groupBy("term", "surface").agg(F.count("*").alias("n"))
    return top(n, ["term"], "surface", most)


def top(counts: DataFrame, by: list[str], item: str, most: int) -> DataFrame:
    """The ``most`` items of largest ``n`` in each group, with ``rank`` from 1, ties by item."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), item))
    return counts.withColumn("rank", rank).where(F.col("rank") <= most)


def phrase_tokens(tokens: Column, phrases: list[str]) -> Column:
    """``tokens`` with each phrase joined by blanks to one token, the longest match first, from left to right.

    The tokens are joined by a sign that none holds, and one expression with the phrases as alternatives, longest
    first, marks the matches, so that the whole list is scanned once.
    """
    wanted = sorted({tuple(p.split()) for p in phrases if len(p.split()) > 1}, key=lambda p: (-len(p), p))
    if not wanted:
        return tokens
    quoted = "|".join("\x1f".join(r"\Q" + w + r"\E" for w in p) for p in wanted)
    flat = F.concat(F.lit("\x1f"), F.array_join(tokens, "\x1f\x1f"), F.lit("\x1f"))
    doubled = quoted.replace("\x1f", "\x1f\x1f")
    marked = F.regexp_replace(flat, f"\x1f({doubled})\x1f", "\x1f\x02$1\x02\x1f")
    inside = F.split(marked, "\x02")
    joined = F.array_join(F.transform(inside, lambda p, i: F.when(i % 2 == 1, F.replace(p, F.lit("\x1f\x1f"), F.lit(" "))).otherwise(p)), "")
    return F.split(F.regexp_replace(joined, "^\x1f|\x1f$", ""), "\x1f\x1f")


def phrase_mentions(docs: DataFrame, phrases: list[str]) -> DataFrame:
    """``id, corpus, pos, words, term``: phrases and the words outside them; ``pos`` counts single tokens."""
    parts = docs.select("id", "corpus", phrase_tokens(X.unmarked(F.col("tokens")), phrases).alias("parts"))
    # a phrase takes as many places as it has words, those after its first being empty, so positions follow inside the row
    none = F.lit(None).cast("string")
    places = F.flatten(F.transform("parts", lambda p: F.when(F.contains(p, F.lit(" ")), F.concat(F.array(p), F.array_repeat(none, F.size(F.split(p, " ")) - 1))).otherwise(F.array(p))))
    rows = parts.select("id", "corpus", F.posexplode(places).alias("pos", "term")).where("term IS NOT NULL")
    return rows.select("id", "corpus", "pos", (F.length("term") - F.length(F.replace("term", F.lit(" "), F.lit(""))) + 1).alias("words"), "term")


def enough_mentions(found: DataFrame, least: int = 2) -> DataFrame:
    """The mentions of terms that have ``least`` of them; 1 keeps single ones too."""
    return found.join(term_counts(found).where(F.col("n") >= least).select("term"), "term", "left_semi") if least > 1 else found


def lemma_positions(lines: DataFrame, targets: DataFrame, lemmas: str = "lemmas", without_pos: bool = False) -> DataFrame:
    """``term, id, pos``: where targets stand in blank-separated lemma lines, after addresses are dropped.

    without_pos: words are compared without their part of speech, as the second English index does.
    """
    words = X.without_prefix(X.blank_tokens(F.col(lemmas)), "http")
    words = F.transform(words, X.before_underscore) if without_pos else words
    rows = lines.select("id", F.posexplode(words).alias("pos", "term"))
    return rows.join(targets.select("term").distinct(), "term", "left_semi")


def union_terms(*tables: DataFrame) -> DataFrame:
    """Distinct terms of several tables."""
    return reduce(lambda a, b: a.unionByName(b), (t.select("term") for t in tables)).distinct()
