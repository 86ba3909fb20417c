"""Command line: ``python -m lexshift COMMAND --help``. Tables are parquet folders unless a command says otherwise."""

from __future__ import annotations

import argparse
import shlex
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexshift.functions import text as X
from lexshift.operators import align, cluster, context, corpus, evaluate, index, lemmas, replacements, score
from lexshift.operators import substitutes as model
from lexshift.plans.pipeline import Config, change_of
from lexshift.plans.training import Training
from lexshift.sources import readers, sinks
from lexshift.workdir import cut

Args = argparse.Namespace
COMMANDS: dict[str, tuple[Callable[[SparkSession, Args], DataFrame | None], list[tuple[str, dict]]]] = {}


def command(*options: tuple[str, dict]) -> Callable:
    def register(f: Callable) -> Callable:
        COMMANDS[f.__name__.replace("_", "-")] = f, list(options)
        return f

    return register


def opt(name: str, **settings: object) -> tuple[str, dict]:
    return f"--{name}", settings


TEXT = opt("infile", required=True, help="JSON lines")
DOCS, INDEX, SUBS, SCORES = (opt(x, required=True, help="parquet") for x in ("docs", "index", "substitutes", "scores"))
TARGETS = opt("targets", help="TSV, terms in the first column")
SEED, TOP_K = opt("seed", type=int, default=42), opt("top-k", type=int, default=5)


def _halves(df: DataFrame) -> tuple[str, str]:
    return corpus.checked_halves(df)


def _stopwords(spark: SparkSession, given: str) -> DataFrame:
    return readers.package_stopwords(spark, given) if given in readers.STOPWORD_LANGUAGES else readers.stopwords(spark, given)


@command(opt("folder", required=True), opt("decades", default="1960,1990"))
def import_decades(spark: SparkSession, a: Args) -> DataFrame:
    return readers.decade_files(spark, a.folder, [int(d) for d in a.decades.split(",")])


@command(opt("infile", required=True, help="text, may be gzipped"), opt("name", required=True), opt("lang", default="eng"), opt("kind", choices=["tokens", "lemmas"], default="tokens"))
def import_lines(spark: SparkSession, a: Args) -> DataFrame:
    lines = readers.numbered_lines(spark, a.infile, a.name)
    return (readers.token_lines if a.kind == "tokens" else readers.lemma_lines)(lines, a.lang)


@command(TEXT, opt("id-field", default="id"), opt("text-field", default="text"), opt("source-field", default="source"), opt("source-field-threshold", type=float), opt("vocabulary", help="a word piece a line; without it, words and signs"))
def tokenize(spark: SparkSession, a: Args) -> DataFrame:
    rows = readers.json_documents(spark, a.infile, a.id_field, a.text_field, a.source_field)
    label = F.col("source") if a.source_field_threshold is None else corpus.threshold_label(F.col("source"), a.source_field, a.source_field_threshold)
    split = (lambda c: X.rejoined(X.wordpiece(c, a.vocabulary))) if a.vocabulary else X.regex_tokens
    return corpus.tokenized(rows, "id", "text", label, split)


@command(DOCS, opt("lexicon", help="parquet with token, lemma, pos"), opt("parsed", help="parquet with id and parts (text, lemma, pos, touches) of another lemmatizer"))
def lemmatize(spark: SparkSession, a: Args) -> DataFrame:
    docs = spark.read.parquet(a.docs)
    if a.parsed:
        out = cut(lemmas.parsed(docs, spark.read.parquet(a.parsed)))
        lemmas.uneven(out).show(truncate=False)
        return out
    if not a.lexicon:
        raise SystemExit("either --lexicon or --parsed is needed")
    return lemmas.lemmatized(docs, spark.read.parquet(a.lexicon))


@command(DOCS, opt("text-out", required=True), opt("val-frac", type=float, default=0.05), SEED)
def export_for_pretraining(spark: SparkSession, a: Args) -> None:
    docs = corpus.train_val(spark.read.parquet(a.docs), "id", a.val_frac, a.seed)
    sinks.training_text(docs.select("id", "part", F.array_join(X.unmarked(F.col("tokens")), " ").alias("text")), a.text_out, a.seed)


@command(opt("text", required=True, help="folder of export-for-pretraining"), opt("model", required=True), opt("model-out", required=True), opt("program", required=True, help="the trainer and its own arguments, with blanks between"), opt("epochs", type=int, default=5), opt("batch-size", type=int, default=32), opt("max-length", type=int, default=256), opt("mask-probability", type=float, default=0.15), SEED)
def train(spark: SparkSession, a: Args) -> None:
    Training(a.epochs, a.batch_size, a.max_length, a.mask_probability, a.seed).run(shlex.split(a.program), a.text, a.model, a.model_out)


@command(DOCS, opt("unit", default="token"), TARGETS, opt("min-count", type=int, default=20), opt("min-count-per-corpus", type=int, default=3), opt("max-terms", type=int), opt("max-tokens", type=int, default=4000), opt("stratified", action="store_true"), opt("beside-targets", action="store_true", help="the threshold is half the count of the rarest target"), opt("maps", help="text to write, a JSON object a term with its mentions"), SEED)
def index_terms(spark: SparkSession, a: Args) -> DataFrame:
    docs = spark.read.parquet(a.docs)
    docs = docs if a.unit == "token" else lemmas.as_units(docs, a.unit)
    targets = readers.targets(spark, a.targets) if a.targets else spark.createDataFrame([], "term string")
    phrases = [r["term"] for r in targets.where(F.contains("term", F.lit(" "))).collect()]  # a list that people judged
    terms = index.phrase_mentions(docs, phrases) if phrases else index.positions(docs)
    counts = index.term_counts_by_corpus(terms, _halves(docs))
    counts = cut(counts)
    valid = index.valid_beside(counts, targets) if a.beside_targets else index.valid_terms(counts, a.min_count, a.min_count_per_corpus)
    if a.max_terms:
        valid = index.stratified(valid.join(targets, "term", "left_anti"), a.max_terms, a.seed) if a.stratified else index.background_beside(valid, targets, a.max_terms, a.seed)
    wanted = counts.join(index.union_terms(valid, targets), "term", "left_semi").select("term", "n")
    found = cut(index.capped(terms, a.max_tokens, a.seed, wanted).join(wanted, "term"))
    if a.maps:
        sinks.index_maps(found).write.mode("overwrite").text(a.maps)
    return found


@command(DOCS, INDEX, opt("stopwords", required=True, help="a word a line, or the code of a language whose list comes with the package"), TOP_K, opt("allow-single", action="store_true", help="keep terms with one mention, and show every mention's token as it stands"), opt("start", type=int, default=0, help="leave out so many terms, in order"), opt("by-term", help="JSON lines to write, a folder a term"))
def get_substitutes(spark: SparkSession, a: Args) -> DataFrame:
    docs = spark.read.parquet(a.docs)
    beside = context.neighbours(docs)
    found = spark.read.parquet(a.index).select("term", "id", "pos")
    found = index.mentions(found, index.from_offset(found, a.start)) if a.start else found
    found = index.enough_mentions(found, 1 if a.allow_single else 2)
    placed = found.join(beside.drop("term"), ["id", "pos"])
    pairs = cut(model.adjacent(beside, ("", "")))  # no counts by corpus are needed
    fitted = model.BigramModel.fit(pairs, index.summed(pairs), _stopwords(spark, a.stopwords))
    out = model.substitutes(placed, fitted, a.top_k)
    out = out.join(index.positions(docs, surface=True).select("id", "pos", "surface"), ["id", "pos"]) if a.allow_single else out
    if a.by_term:
        out = cut(out)
        sinks.by_term(out, a.by_term)
    return out


@command(SUBS, INDEX, TOP_K, opt("window-factor", type=float, default=2.0), TARGETS, opt("csv"))
def compute_jsds(spark: SparkSession, a: Args) -> DataFrame:
    subs = spark.read.parquet(a.substitutes)
    halves = _halves(subs)
    counts = spark.read.parquet(a.index).select("term", "n").distinct()
    out = change_of(subs, counts, Config(halves, top_k=a.top_k, factor=a.window_factor)).join(score.mention_counts(subs, halves), "term")
    if a.targets:
        targets = readers.targets(spark, a.targets)
        score.missing_targets(out, targets).show(truncate=False)
        out = score.only_targets(out, targets)
    if a.csv:
        sinks.score_table(out, a.csv)
    return out


@command(SCORES, opt("gold", required=True, help="TSV with term and score"), opt("header", action="store_true"), opt("exclude", default="", help="words, with commas between; decades: those of the decade corpus, in two steps"))
def evaluate_scores(spark: SparkSession, a: Args) -> DataFrame:
    scores, gold = spark.read.parquet(a.scores), readers.gold(spark, a.gold, a.header)
    evaluate.unscored(scores, gold).show(truncate=False)
    if a.exclude == "decades":
        parts = [evaluate.without_excluded(scores, gold, c).select(F.lit(c).alias("of"), "*") for c in ("jsd", "scaled_jsd")]
        return parts[0].union(parts[1])
    parts = [evaluate.correlations(evaluate.scored_pairs(scores, gold, c, a.exclude.split(","))).select(F.lit(c).alias("of"), "*") for c in ("jsd", "scaled_jsd")]
    return parts[0].union(parts[1])


@command(SUBS, TOP_K)
def gather_top_replacements(spark: SparkSession, a: Args) -> DataFrame:
    subs = spark.read.parquet(a.substitutes)
    return replacements.side_by_side(score.histogram(subs, a.top_k), _halves(subs))


@command(opt("ratings", required=True, help="CSV with word and p1 to p5"))
def average_ratings(spark: SparkSession, a: Args) -> DataFrame:
    return evaluate.rater_mean(readers.ratings(spark, a.ratings), [f"p{i}" for i in range(1, 6)])


@command(DOCS, opt("lemmas", required=True, help="parquet with id and text"))
def do_alignment(spark: SparkSession, a: Args) -> DataFrame:
    lines = spark.read.parquet(a.lemmas).select("id", X.blank_tokens(F.lower("text")).alias("l"))
    rows = spark.read.parquet(a.docs).select("id", F.transform(X.unmarked(F.col("tokens")), F.lower).alias("t")).join(lines, "id")
    done = rows.select("id", "t", "l", align.align(F.col("t"), F.col("l")).alias("alignment"))
    return done.select("id", F.array_join("t", " ").alias("tokens"), F.array_join("l", " ").alias("lemmas"), "alignment").join(align.scores(done), "id")


@command(opt("matching", required=True, help="parquet with id, tokens, lemmas, alignment"), opt("lang", required=True), TARGETS)
def index_aligned(spark: SparkSession, a: Args) -> DataFrame:
    words = align.aligned_words(spark.read.parquet(a.matching).withColumn("lang", F.lit(a.lang)))
    if not a.targets:
        return align.indexed_tokens(words, align.valid_tokens(words, align.BACKGROUND_EXCEPTIONS, False))
    wanted = words.join(readers.targets(spark, a.targets).withColumnRenamed("term", "lemma"), "lemma", "left_semi")
    return align.indexed_tokens(wanted, align.valid_tokens(wanted, align.TARGET_EXCEPTIONS, True))


@command(SUBS, TOP_K, opt("resolution", type=float, default=1.0), opt("min-count", type=int, default=1), opt("assignments", help="parquet to write, the cluster of every mention"), SEED)
def do_clustering(spark: SparkSession, a: Args) -> DataFrame:
    subs = spark.read.parquet(a.substitutes)
    members = cut(cluster.clusters(cluster.edges(subs, a.top_k, a.min_count), a.resolution, a.seed))
    assigned = cut(cluster.assignments(subs, members, a.top_k))
    if a.assignments:
        assigned.write.mode("overwrite").parquet(a.assignments)
    return cluster.cluster_table(members, score.histogram(subs, a.top_k), assigned)


@command(SCORES, opt("gold", required=True))
def fit_line(spark: SparkSession, a: Args) -> DataFrame:
    pairs = evaluate.scored_pairs(spark.read.parquet(a.scores), readers.gold(spark, a.gold))
    return evaluate.band(evaluate.least_squares(pairs), pairs.select("x").distinct())


@command(INDEX, opt("original", required=True, help="parquet, the mentions before filtering"))
def check_index(spark: SparkSession, a: Args) -> DataFrame:
    return evaluate.coverage(spark.read.parquet(a.index), spark.read.parquet(a.original))


@command(opt("targets", required=True))
def convert_targets(spark: SparkSession, a: Args) -> DataFrame:
    return readers.targets(spark, a.targets).select("term", X.rename_pos(F.col("term")).alias("renamed"), X.drop_pos(F.col("term")).alias("dropped"))


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="lexshift", description=__doc__)
    subs = parser.add_subparsers(dest="command", required=True)
    for name, (_, options) in COMMANDS.items():
        sub = subs.add_parser(name)
        for flag, settings in options:
            sub.add_argument(flag, **settings)
        sub.add_argument("--out", required=name not in ("export-for-pretraining", "train"), help="parquet, or JSON lines if it ends in .jsonlist")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("lexshift").getOrCreate()
    result = COMMANDS[args.command][0](spark, args)
    if result is not None:
        if args.out.endswith(".jsonlist"):
            sinks.json_lines(result, args.out)
        else:
            result.write.mode("overwrite").parquet(args.out)
        sinks.config_sidecar(spark, vars(args), args.out.rstrip("/") + ".config")


if __name__ == "__main__":
    main()
