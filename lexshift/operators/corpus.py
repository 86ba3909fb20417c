"""Corpora: from raw files or documents to tokenized, two-valued collections."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexshift.functions import text as X


def file_text(value: Column) -> Column:
    """The text of a decade file: the third of three lines after a mark and a blank one, or one line without its first token; else NULL."""
    lines = F.split(F.regexp_replace(value, r"\n\z", ""), "\n")
    three = (F.size(lines) == 3) & F.startswith(F.get(lines, F.lit(0)), F.lit("@@")) & (F.trim(F.get(lines, F.lit(1))) == "")
    return F.when(three, F.get(lines, F.lit(2))).when(F.size(lines) == 1, F.regexp_replace(F.get(lines, F.lit(0)), r"^\s*\S+\s*", ""))


def half_of_decade(decade: Column, border: int = 1980) -> Column:
    return F.when(decade < border, F.lit(f"pre{border}s")).otherwise(F.lit(f"post{border - 10}s"))


def threshold_label(value: Column, name: str, threshold: float) -> Column:
    """The half of a numeric source field: ``name<t`` or ``name>=t``."""
    t = float(threshold)
    return F.when(value.cast("double") < t, F.lit(f"{name}<{t}")).when(value.cast("double") >= t, F.lit(f"{name}>={t}"))


def decade_clean(text: Column) -> Column:
    """Cleaning of decade files: markup tokens dropped, hashes and underscores to blanks."""
    return X.underscores_to_blank(X.hashes_to_blank(F.array_join(X.without_prefix(X.blank_tokens(text), "<"), " ")))


def markup_counts(df: DataFrame, text: str) -> DataFrame:
    """``token, n``: how often each markup token is dropped."""
    return df.select(F.explode(F.filter(X.blank_tokens(F.col(text)), lambda t: F.startswith(t, F.lit("<")))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def redaction_chunks(df: DataFrame, key: str, text: str, least: int = 8, keep: tuple[str, ...] = ()) -> DataFrame:
    """``id, text`` and the columns ``keep`` of the parts between removed words that are longer than ``least``; ids keep the parts' ordinals, so they have gaps."""
    parts = df.select(F.col(key).alias("key"), *keep, F.posexplode(F.split(F.col(text), X.REDACTED)).alias("part", "chunk"))
    return parts.select(F.concat("key", F.lit("_"), F.lpad(F.col("part").cast("string"), 5, "0")).alias("id"), *keep, X.strip(F.col("chunk")).alias("text")).where(F.length("text") > least)


def chunk_lengths(chunks: DataFrame) -> DataFrame:
    """``words, n``: how many chunks have so many words."""
    return chunks.groupBy(F.size(X.blank_tokens(F.col("text"))).alias("words")).agg(F.count("*").alias("n"))


def checked_halves(df: DataFrame, corpus: str = "corpus") -> tuple[str, str]:
    """The two values of the corpus column in order; ValueError for another number."""
    values = sorted(r[0] for r in df.select(corpus).where(F.col(corpus).isNotNull()).distinct().limit(3).collect())
    if len(values) != 2:
        raise ValueError(f"two corpora are needed; there are {len(values)} at least")
    return values[0], values[1]


def tokenized(df: DataFrame, key: str, text: str, corpus: Column, split: Callable[[Column], Column] = X.regex_tokens) -> DataFrame:
    """``id, corpus, tokens`` of the documents that have tokens after cleaning, by the tokenizer ``split``."""
    rows = df.select(F.col(key).cast("string").alias("id"), corpus.alias("corpus"), split(X.clean(F.col(text))).alias("tokens"))
    return rows.where(F.size("tokens") > 0)


def tokenizer_report(df: DataFrame, text: str) -> DataFrame:
    """One row: documents in all, without text, empty after cleaning, without tokens, kept, and the most tokens."""
    cleaned = df.select(F.col(text).alias("text"), X.clean(F.col(text)).alias("cleaned"))
    n = cleaned.select("text", "cleaned", F.size(X.regex_tokens(F.col("cleaned"))).alias("n"))
    return n.agg(
        F.count("*").alias("documents"),
        F.count_if(F.col("text").isNull()).alias("without_text"),
        F.count_if(F.col("cleaned") == "").alias("empty"),
        F.count_if((F.col("cleaned") != "") & (F.col("n") == 0)).alias("without_tokens"),
        F.count_if(F.col("n") > 0).alias("kept"),
        F.coalesce(F.max(F.when(F.col("n") > 0, F.col("n"))), F.lit(0)).cast("bigint").alias("most_tokens"),
    )


def unit(seed: int, *columns: str) -> Column:
    """A number from 0 to below 1 that depends on the seed and the columns only: the leading 32 bits of an md5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *columns)), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def train_val(df: DataFrame, key: str, share: float = 0.05, seed: int = 42) -> DataFrame:
    """``df`` with ``part``: val for about ``share`` of the rows, else train."""
    return df.withColumn("part", F.when(unit(seed, key) <= share, "val").otherwise("train"))


def mlm_chunks(df: DataFrame, key: str, tokens: str, length: int = 256, batch: int = 1000) -> DataFrame:
    """``batch, chunk, tokens``: token lists joined in batches and cut into chunks of ``length``, the rest of a batch dropped.

    Rows are put in batches of about ``batch`` rows by a hash of the key, so that no global order is needed; within a
    batch they are ordered by key. A batch is bounded by its rows and joined in one task.
    """
    groups = max(1, -(-df.count() // batch))
    b = df.select(F.floor(unit(0, key) * groups).cast("int").alias("batch"), F.struct(F.col(key).alias("k"), F.col(tokens).alias("t")).alias("row"))
    joined = b.groupBy("batch").agg(F.flatten(F.transform(F.array_sort(F.collect_list("row")), lambda r: r["t"])).alias("all"))
    full = (F.size("all") / F.lit(length)).cast("int")
    return joined.where(full > 0).select("batch", F.posexplode(F.transform(F.sequence(F.lit(0), full - 1), lambda i: F.slice("all", i * length + 1, length))).alias("chunk", "tokens"))


def masked_chunks(chunks: DataFrame, share: float = 0.15, seed: int = 42) -> DataFrame:
    """``batch, chunk, masked, labels`` of ``batch, chunk, tokens`` for masked training.

    About ``share`` of the tokens are to be guessed: of these eight in ten are masked, one is another token of the chunk
    and one stays; ``labels`` has the token there and NULL elsewhere. Another seed, such as one an epoch, chooses others.
    """
    part = lambda h, at: F.conv(F.substring(h, at, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)
    # three numbers from 0 to below 1 of each place: whether, how, and by which token
    hashes = F.transform("tokens", lambda t, i: F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("batch"), F.col("chunk"), i)))
    number = lambda h: F.struct(*(part(h, at).alias(n) for n, at in (("whether", 1), ("how", 9), ("which", 17))))
    rows = chunks.select("batch", "chunk", "tokens", F.transform(hashes, number).alias("u"))
    other = lambda u: F.get("tokens", F.floor(u["which"] * F.size("tokens")).cast("int"))
    masked = F.zip_with("tokens", "u", lambda t, u: F.when(u["whether"] >= share, t).when(u["how"] < 0.8, F.lit("[MASK]")).when(u["how"] < 0.9, other(u)).otherwise(t))
    return rows.select("batch", "chunk", masked.alias("masked"), F.zip_with("tokens", "u", lambda t, u: F.when(u["whether"] < share, t)).alias("labels"))
