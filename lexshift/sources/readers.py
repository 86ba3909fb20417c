"""Readers: every input becomes a DataFrame with a declared schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexshift.functions import stopwords as stopword_lists
from lexshift.functions import text as X
from lexshift.operators import corpus as C
from lexshift.workdir import cut

#: Languages that have stopword lists.
STOPWORD_LANGUAGES = ("eng", "ger", "lat", "swe")


def json_documents(spark: SparkSession, path: str, key: str = "id", text: str = "text", source: str | None = None) -> DataFrame:
    """``id, text, source`` of JSON lines, whatever the fields are called; rows without the text field have NULL."""
    fields = [T.StructField(f, T.StringType()) for f in dict.fromkeys([key, text, *([source] if source else [])])]
    rows = spark.read.schema(T.StructType(fields)).json(path)
    return rows.select(F.col(key).alias("id"), F.col(text).alias("text"), (F.col(source) if source else F.lit(None).cast("string")).alias("source"))


def decade_files(spark: SparkSession, folder: str, decades: list[int]) -> DataFrame:
    """``id, decade, year, subset, group, text`` of a tree ``<decade>s/<subset>_<year>_<document>.txt``.

    A file name that has not three parts raises when read. Each row is a part of a file between removed words.
    """
    files = spark.read.option("recursiveFileLookup", True).text([f"{folder}/{d}s" for d in decades], wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.txt$", "")
    parts = F.split(name, "_")
    checked = F.when(F.size(parts) == 3, parts).otherwise(F.raise_error(F.concat(F.lit("a file name needs three parts: "), name)))
    rows = files.select(C.decade_clean(C.file_text(F.col("value"))).alias("text"), name.alias("name"), checked.alias("p"), F.element_at(F.split("path", "/"), -2).alias("d")).where("text IS NOT NULL")
    keyed = rows.select("name", "text", F.regexp_replace("d", "s$", "").cast("int").alias("decade"), F.get("p", F.lit(1)).cast("int").alias("year"), F.get("p", F.lit(0)).alias("subset"))
    return C.redaction_chunks(keyed, "name", "text", keep=("decade", "year", "subset")).select("id", "decade", "year", "subset", C.half_of_decade(F.col("decade")).alias("group"), "text")


def numbered_lines(spark: SparkSession, path: str, name: str) -> DataFrame:
    """``id, text, source`` of one plain or gzipped text file; ids hold the line's number, eight digits from 0. Another number of files raises.

    Lines are read one by one, a plain file by several tasks. Those of a block keep their order in it, and the blocks before
    it, which are counted, say with what number it begins. A gzipped file is one block.
    """
    place = F.col("_metadata.file_block_start").alias("block")
    raw = spark.read.option("lineSep", "\n").text(path)
    if len(raw.inputFiles()) != 1:
        raise ValueError(f"one file is needed at {path}; there are {len(raw.inputFiles())}")
    lines = cut(raw.select("value", place, F.monotonically_increasing_id().alias("turn")))  # written, so that a turn stays a line's
    blocks = lines.groupBy("block").agg(F.min("turn").alias("first"), F.count("*").alias("lines"))  # a row a block of the file
    before = F.sum("lines").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    known = blocks.select("block", "first", F.coalesce(before, F.lit(0)).alias("before"))
    rows = lines.join(F.broadcast(known), "block").select((F.col("before") + F.col("turn") - F.col("first")).alias("n"), F.col("value").alias("text"))
    return rows.select(F.concat(F.lit(name + "_"), F.lpad(F.col("n").cast("string"), 8, "0")).alias("id"), X.collapse_hashes(X.strip(F.col("text"))).alias("text"), F.lit(name).alias("source"))


def lemma_lines(lines: DataFrame, lang: str) -> DataFrame:
    """Lemma lines cleaned by language: modern German letters; English without parts of speech, others without underscores."""
    text = X.german(F.col("text")) if lang == "ger" else F.col("text")
    if lang == "eng":
        return lines.withColumn("text", F.array_join(F.transform(X.blank_tokens(text), X.before_underscore), " "))
    return lines.withColumn("text", X.underscores_to_blank(text))


def token_lines(lines: DataFrame, lang: str) -> DataFrame:
    """Token lines cleaned: modern German letters, underscores to blanks, addresses dropped."""
    text = X.german(F.col("text")) if lang == "ger" else F.col("text")
    return lines.withColumn("text", F.array_join(X.without_prefix(X.blank_tokens(X.underscores_to_blank(text)), "http"), " "))


def targets(spark: SparkSession, path: str) -> DataFrame:
    """Distinct first fields of a TSV without a header."""
    return spark.read.option("sep", "\t").schema("term string, score double").csv(path).select("term").where("term IS NOT NULL").distinct()


def gold(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    return spark.read.option("sep", "\t").option("header", header).schema("term string, score double").csv(path)


def ratings(spark: SparkSession, path: str) -> DataFrame:
    """``word, p1..p5`` of a CSV with a header."""
    return spark.read.option("header", True).schema("word string, p1 double, p2 double, p3 double, p4 double, p5 double").csv(path)


def stopwords(spark: SparkSession, path: str) -> DataFrame:
    """``word`` of a file with one word a line."""
    return spark.read.text(path).select(X.strip(F.col("value")).alias("word")).where("word <> ''").distinct()


def package_stopwords(spark: SparkSession, lang: str | None) -> DataFrame:
    """``word`` of a list that comes with the package."""
    return spark.createDataFrame([(w,) for w in stopword_lists.stopwords(lang)], "word string")


def stopwords_of(table: DataFrame, lang: str | None) -> DataFrame:
    """The words of one language of ``lang, word``; None gives none, an unknown language raises."""
    if lang is not None and lang not in STOPWORD_LANGUAGES:
        raise ValueError(f"no stopwords for {lang}; there are {', '.join(STOPWORD_LANGUAGES)}")
    return table.where(F.col("lang") == lang if lang else F.lit(False)).select("word").distinct()


def term_index(spark: SparkSession, path: str) -> DataFrame:
    """``term, id, pos`` of a JSON map from term to [id, position] pairs, in one file."""
    raw = spark.read.text(path, wholetext=True)
    entries = F.explode(F.from_json("value", "map<string,array<string>>")).alias("term", "pairs")
    pair = F.from_json("p", "array<string>")
    return raw.select(entries).select("term", F.explode("pairs").alias("p")).select("term", F.get(pair, F.lit(0)).alias("id"), F.get(pair, F.lit(1)).cast("int").alias("pos"))


def term_index_lines(spark: SparkSession, path: str) -> DataFrame:
    """The same of lines ``{"term": .., "mentions": [[id, pos], ..]}``, as ``sinks.index_maps`` makes them, read in parallel."""
    rows = spark.read.schema("term string, mentions array<array<string>>").json(path).select("term", F.explode("mentions").alias("m"))
    return rows.select("term", F.get("m", F.lit(0)).alias("id"), F.get("m", F.lit(1)).cast("int").alias("pos"))


def substitutes(spark: SparkSession, path: str) -> DataFrame:
    """``term, line_id, token_index, top_terms, top_term_probs`` of JSON lines or of a folder partitioned by term."""
    return spark.read.schema("term string, line_id string, token_index int, top_terms array<string>, top_term_probs array<double>").json(path)
