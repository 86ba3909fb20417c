"""The registered queries, each over its whole tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexshift.functions import text as X
from lexshift.operators import align, cluster, context, corpus, evaluate, index, lemmas, replacements, score
from lexshift.operators import substitutes as model
from lexshift.plans.pipeline import Config, change_of, lexical_change
from lexshift.sources import readers, sinks
from lexshift.tables import one_per_key, table
from lexshift.workdir import cut

Query = Callable[[SparkSession, str], DataFrame]
HALVES = ("post1970s", "pre1980s")
CONFIG = Config(HALVES)
#: Phrases for the query on phrases.
PHRASES = ["of the", "of the old", "that signal", "his old wire", "a record", "had once"]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# Common tables of the SQL; a query names the last ones it needs.
TABLES = {
    "docs": "SELECT id, any_value(corpus_group) AS corpus, any_value(tokens) AS tokens FROM coha_tokens WHERE tokens IS NOT NULL GROUP BY id",
    "texts": "SELECT id, any_value(text) AS text, any_value(decade) AS decade, any_value(pub_year) AS pub_year FROM coha_tokens GROUP BY id",
    "words": "SELECT id, corpus, pos::INTEGER AS pos, replace(token, '##', '') AS term FROM (SELECT id, corpus, unnest(range(len(tokens))) AS pos, unnest(tokens) AS token FROM docs) WHERE token IS NOT NULL",
    "counts": "SELECT term, count(*)::BIGINT AS n, count(*) FILTER (corpus = 'post1970s')::BIGINT AS n_a, count(*) FILTER (corpus = 'pre1980s')::BIGINT AS n_b FROM words GROUP BY term",
    "valid": "SELECT * FROM counts WHERE n >= 20 AND least(n_a, n_b) >= 3 AND length(split_part(term, '_', 1)) >= 2 AND NOT contains(term, '/') AND regexp_matches(split_part(term, '_', 1), '[a-zA-Z0-9]')",
    "targets": "SELECT DISTINCT term FROM gold WHERE term IS NOT NULL",
    "beside": "SELECT *, lag(term) OVER w AS l, lead(term) OVER w AS r FROM words WINDOW w AS (PARTITION BY id ORDER BY pos)",
    "mentions": "SELECT * EXCLUDE (turn) FROM (SELECT b.*, row_number() OVER (PARTITION BY term ORDER BY md5(concat_ws('|', '42', term, id, pos)), id, pos) AS turn FROM beside b SEMI JOIN valid USING (term)) WHERE turn <= 4000",
    "bigrams": "SELECT l, term AS r, count(*)::BIGINT AS n FROM beside WHERE l IS NOT NULL GROUP BY ALL",
    "fit": "SELECT term AS c, n AS n_c FROM counts WHERE length(term) > 1 AND NOT contains(term, '##') AND NOT contains(term, '...') AND NOT contains(term, '[') AND term NOT IN (SELECT word FROM stopwords WHERE lang = 'eng')",
    "after_": "SELECT * FROM (SELECT l, c, n, n_c, row_number() OVER (PARTITION BY l ORDER BY n DESC, c) AS t FROM bigrams JOIN fit ON c = r) WHERE t <= 30",
    "before_": "SELECT * FROM (SELECT r, c, n, n_c, row_number() OVER (PARTITION BY r ORDER BY n DESC, c) AS t FROM bigrams JOIN fit ON c = l) WHERE t <= 30",
    "contexts": "SELECT DISTINCT l, r FROM mentions",
    "candidates": "SELECT l, r, c, max(la) AS la, max(be) AS be, any_value(n_c) AS n_c FROM (SELECT x.l, x.r, c, n AS la, 0 AS be, n_c FROM contexts x JOIN after_ a ON a.l = x.l UNION ALL SELECT x.l, x.r, c, 0, n, n_c FROM contexts x JOIN before_ b ON b.r = x.r) GROUP BY l, r, c",
    "ranked": "SELECT l, r, c AS sub, rank FROM (SELECT *, row_number() OVER (PARTITION BY l, r ORDER BY (la + 1) * (be + 1) / n_c DESC, c) AS rank FROM candidates) WHERE rank <= 5",
    "made": "SELECT m.term, m.corpus, s.sub, count(*)::BIGINT AS n FROM mentions m JOIN ranked s ON s.l IS NOT DISTINCT FROM m.l AND s.r IS NOT DISTINCT FROM m.r GROUP BY ALL",
    "given": "SELECT term, line_id, token_index, any_value(top_terms) AS top_terms FROM substitutes GROUP BY ALL",
    "subs": "SELECT g.term, g.line_id AS id, g.token_index AS pos, d.corpus, g.top_terms FROM given g JOIN (SELECT id, any_value(corpus_group) AS corpus FROM coha_tokens GROUP BY id) d ON d.id = g.line_id",
    "hist": "SELECT term, corpus, sub, count(*)::BIGINT AS n FROM (SELECT term, corpus, unnest(top_terms[1:5]) AS sub FROM subs) WHERE sub IS NOT NULL GROUP BY ALL",
}
_JSD = """SELECT term, round(sqrt(least(1, greatest(0, d))), 9) AS jsd FROM (
SELECT term, sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END) / 2 + sum(CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2 AS d
FROM (SELECT h.term, x / sx AS p, y / sy AS q FROM
(SELECT term, sub, coalesce(sum(n) FILTER (corpus = 'post1970s'), 0) AS x, coalesce(sum(n) FILTER (corpus = 'pre1980s'), 0) AS y FROM {h} GROUP BY ALL) h
JOIN (SELECT term, sum(n) FILTER (corpus = 'post1970s') AS sx, sum(n) FILTER (corpus = 'pre1980s') AS sy FROM {h} GROUP BY term) t ON t.term = h.term WHERE sx > 0 AND sy > 0) GROUP BY term)"""
_SCALED = """SELECT a.term, a.n, a.jsd, count(b.term)::BIGINT AS neighbours, round(avg(CASE WHEN b.term IS NULL THEN NULL WHEN a.jsd >= b.jsd THEN 1.0 ELSE 0.0 END), 9) AS scaled_jsd
FROM {s} a LEFT JOIN {s} b ON b.term <> a.term AND b.n >= a.n / 2.0 AND b.n <= a.n * 2.0 GROUP BY a.term, a.n, a.jsd"""
TABLES |= {
    "raw": _JSD.format(h="hist"),
    "scored": "SELECT r.term, coalesce(c.n, 0) AS n, r.jsd FROM raw r LEFT JOIN counts c ON c.term = r.term",
    "scaled": _SCALED.format(s="scored"),
    "judged": "SELECT s.term, s.scaled_jsd AS x, g.y FROM scaled s JOIN (SELECT DISTINCT term, score AS y FROM gold WHERE score IS NOT NULL) g ON g.term = s.term WHERE s.scaled_jsd IS NOT NULL",
    "made_raw": _JSD.format(h="made"),
    "made_scored": "SELECT r.term, c.n, r.jsd FROM made_raw r JOIN counts c ON c.term = r.term",
    "lines": "SELECT id, any_value(left(id, 3)) AS lang, any_value(tokens) AS tokens, any_value(lemmas) AS lemmas, any_value(alignment) AS alignment FROM matching WHERE lemmas IS NOT NULL GROUP BY id",
    "aligned": r"SELECT id, lang, x.lemma_idx AS lemma_idx, l[x.lemma_idx + 1] AS lemma, x.token_idx AS token_idx, CASE WHEN x.token_idx >= 0 THEN t[x.token_idx + 1] END AS token FROM (SELECT id, lang, list_filter(string_split_regex(tokens, '\s+'), lambda w: w <> '') AS t, list_filter(string_split_regex(lemmas, '\s+'), lambda w: w <> '') AS l, unnest(alignment) AS x FROM lines WHERE alignment IS NOT NULL) WHERE x.lemma_idx >= 0 AND l[x.lemma_idx + 1] IS NOT NULL",
    "few": "SELECT term, id, pos, list_filter((CASE WHEN list_contains(top_terms[1:6], term) THEN list_filter(top_terms[1:6], lambda s: s IS DISTINCT FROM term) ELSE top_terms[1:6] END)[1:5], lambda s: s IS NOT NULL) AS s FROM subs WHERE top_terms IS NOT NULL",
}


def _with(*names: str) -> str:
    """The common tables up to the last named one, in an order in which each comes after those it reads."""
    needed: list[str] = []

    def add(name: str) -> None:
        if name in needed:
            return
        for other in TABLES:
            if other != name and f" {other} " in f" {TABLES[name].replace('(', ' ').replace(')', ' ')} ":
                add(other)
        needed.append(name)

    for n in names:
        add(n)
    return "WITH " + ",\n".join(f"{n} AS ({TABLES[n]})" for n in needed) + "\n"


def query(sql: str | None = None, *names: str) -> Callable[[Query], Query]:
    """Register a query and its SQL; names: the common tables that the SQL reads."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = (_with(*names) if names else "") + sql
        return f

    return register


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "coha_tokens").where("tokens IS NOT NULL").select("id", F.col("corpus_group").alias("corpus"), "tokens")
    return one_per_key(rows, "id")


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    return one_per_key(table(spark, folder, "coha_tokens").select("id", "text", "decade", "pub_year"), "id")


def _words(spark: SparkSession, folder: str) -> DataFrame:
    return index.positions(_docs(spark, folder))


def _counts(spark: SparkSession, folder: str) -> DataFrame:
    return index.term_counts_by_corpus(_words(spark, folder), HALVES)


def _targets(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "gold").select("term").where("term IS NOT NULL").distinct()


def _stopwords(spark: SparkSession, folder: str, lang: str | None = "eng") -> DataFrame:
    return readers.stopwords_of(table(spark, folder, "stopwords"), lang)


def _subs(spark: SparkSession, folder: str) -> DataFrame:
    given = one_per_key(table(spark, folder, "substitutes").select("term", "line_id", "token_index", "top_terms"), "term", "line_id", "token_index")
    labels = table(spark, folder, "coha_tokens").select(F.col("id").alias("line_id"), F.col("corpus_group").alias("corpus")).dropDuplicates(["line_id"])
    return given.join(labels, "line_id").select("term", F.col("line_id").alias("id"), F.col("token_index").alias("pos"), "corpus", "top_terms")


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "matching").where("lemmas IS NOT NULL").select("id", F.left("id", F.lit(3)).alias("lang"), "tokens", "lemmas", "alignment")
    return one_per_key(rows, "id")


def _scaled(spark: SparkSession, folder: str) -> DataFrame:
    return change_of(_subs(spark, folder), _counts(spark, folder), CONFIG)


def _judged(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.scored_pairs(_scaled(spark, folder), table(spark, folder, "gold"))


# Text and corpora

_STRIP = r"regexp_replace(regexp_replace(text, '^[\s\p{Z}\x0b\x1c-\x1f\x{85}]+', ''), '[\s\p{Z}\x0b\x1c-\x1f\x{85}]+\z', '')"
_CLEAN = f"replace(regexp_replace({_STRIP}, '#+', '#', 'g'), '_', ' ')"
_REGEX = rf"regexp_extract_all(lower({_CLEAN}), '{X.TOKEN_PATTERN}')"


@query(f"SELECT doc_id, {_CLEAN} AS cleaned FROM documents")
def clean_text(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", X.clean(F.col("text")).alias("cleaned"))


@query(r"SELECT id, replace(regexp_replace(array_to_string(list_filter(string_split_regex(text, '\s+'), lambda t: t <> '' AND NOT starts_with(t, '<')), ' '), '##+', ' ', 'g'), '_', ' ') AS cleaned FROM texts", "texts")
def decade_text(spark: SparkSession, folder: str) -> DataFrame:
    return _texts(spark, folder).select("id", corpus.decade_clean(F.col("text")).alias("cleaned"))


@query("SELECT id, replace(replace(replace(replace(lemmas, 'ſ', 's'), 'uͤ', 'u'), 'oͤ', 'o'), 'aͤ', 'a') AS lemmas FROM lines", "lines")
def german_letters(spark: SparkSession, folder: str) -> DataFrame:
    return _lines(spark, folder).select("id", X.german(F.col("lemmas")).alias("lemmas"))


@query("SELECT id, strip_accents(lemmas) AS lemmas FROM lines", "lines")
def accents_stripped(spark: SparkSession, folder: str) -> DataFrame:
    return _lines(spark, folder).select("id", X.strip_accents(F.col("lemmas")).alias("lemmas"))


@query(r"SELECT token, count(*)::BIGINT AS n FROM (SELECT unnest(string_split_regex(text, '\s+')) AS token FROM documents) WHERE starts_with(token, '<') GROUP BY token")
def html_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.markup_counts(table(spark, folder, "documents"), "text")


@query("SELECT * FROM (SELECT id || '_' || lpad((part - 1)::VARCHAR, 5, '0') AS id, " + _STRIP + " AS text FROM (SELECT id, unnest(range(1, len(p) + 1)) AS part, unnest(p) AS text FROM (SELECT id, string_split(text, '@ @ @ @ @ @ @ @ @ @') AS p FROM texts WHERE text IS NOT NULL))) WHERE length(text) > 8", "texts")
def redaction_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.redaction_chunks(_texts(spark, folder), "id", "text")


@query(
    "SELECT words::INTEGER AS words, count(*)::BIGINT AS n FROM (SELECT len(list_filter(string_split_regex(text, '\\s+'), lambda t: t <> '')) AS words FROM (SELECT " + _STRIP + " AS text FROM (SELECT unnest(string_split(text, '@ @ @ @ @ @ @ @ @ @')) AS text FROM texts WHERE text IS NOT NULL)) WHERE length(text) > 8) GROUP BY words",
    "texts",
)
def chunk_lengths(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.chunk_lengths(redaction_chunks(spark, folder))


@query("SELECT id, CASE WHEN pub_year < 1980 THEN 'year<1980.0' WHEN pub_year >= 1980 THEN 'year>=1980.0' END AS by_year, CASE WHEN decade < 1980 THEN 'pre1980s' ELSE 'post1970s' END AS by_decade FROM texts", "texts")
def corpus_split_threshold(spark: SparkSession, folder: str) -> DataFrame:
    return _texts(spark, folder).select("id", corpus.threshold_label(F.col("pub_year"), "year", 1980).alias("by_year"), corpus.half_of_decade(F.col("decade")).alias("by_decade"))


@query(f"SELECT doc_id, len({_REGEX})::INTEGER AS n_tokens, array_to_string({_REGEX}, ' ') AS tokens FROM documents WHERE len({_REGEX}) > 0")
def tokenize(spark: SparkSession, folder: str) -> DataFrame:
    rows = corpus.tokenized(table(spark, folder, "documents"), "doc_id", "text", F.col("lang"))
    return rows.select(F.col("id").cast("bigint").alias("doc_id"), F.size("tokens").alias("n_tokens"), F.array_join("tokens", " ").alias("tokens"))


@query(f"SELECT count(*)::BIGINT AS documents, count(*) FILTER (text IS NULL)::BIGINT AS without_text, count(*) FILTER (c = '')::BIGINT AS empty, count(*) FILTER (c <> '' AND n = 0)::BIGINT AS without_tokens, count(*) FILTER (n > 0)::BIGINT AS kept, coalesce(max(n) FILTER (n > 0), 0)::BIGINT AS most_tokens FROM (SELECT text, {_CLEAN} AS c, len({_REGEX}) AS n FROM documents)")
def doc_counters(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.tokenizer_report(table(spark, folder, "documents"), "text")


@query("SELECT id, array_to_string(list_transform(tokens, lambda t: replace(t, '##', ' ##')), ' ') AS pieces FROM docs", "docs")
def word_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return _docs(spark, folder).select("id", F.array_join(X.pieces(F.col("tokens")), " ").alias("pieces"))


@query("SELECT id, array_to_string(tokens, ' ') AS words FROM docs WHERE len(tokens) > 0", "docs")
def rejoined_pieces(spark: SparkSession, folder: str) -> DataFrame:
    rows = _docs(spark, folder).where(F.size("tokens") > 0)
    return rows.select("id", F.array_join(X.rejoined(X.pieces(F.col("tokens"))), " ").alias("words"))


@query(r"""SELECT id, array_to_string(list_filter(string_split_regex(tokens, '\s+'), lambda t: t <> '' AND NOT contains(',.;?!:()"', t)), ' ') AS words FROM lines""", "lines")
def punctuation_removed(spark: SparkSession, folder: str) -> DataFrame:
    return _lines(spark, folder).select("id", F.array_join(X.without_punctuation(X.blank_tokens(F.col("tokens"))), " ").alias("words"))


@query("SELECT doc_id, CASE WHEN ('0x' || substr(md5(concat_ws('|', '42', doc_id)), 1, 8))::BIGINT / 4294967296.0 <= 0.05 THEN 'val' ELSE 'train' END AS part FROM documents")
def train_val_split(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.train_val(table(spark, folder, "documents").select("doc_id"), "doc_id")


@query(
    """, b AS (SELECT floor(('0x' || substr(md5(concat_ws('|', '0', id)), 1, 8))::BIGINT / 4294967296.0 * (SELECT ceil(count(*) / 1000) FROM docs))::INTEGER AS batch, flatten(list(tokens ORDER BY id)) AS k FROM docs GROUP BY batch)
SELECT batch, chunk::INTEGER AS chunk, array_to_string(k[chunk * 256 + 1 : chunk * 256 + 256], ' ') AS tokens FROM (SELECT batch, k, unnest(range(len(k) // 256)) AS chunk FROM b)""",
    "docs",
)
def mlm_chunking(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.mlm_chunks(_docs(spark, folder), "id", "tokens").select("batch", "chunk", F.array_join("tokens", " ").alias("tokens"))


_PLACE = "('0x' || substr(md5(concat_ws('|', '42', batch, chunk, i - 1)), {}, 8))::BIGINT / 4294967296.0"


@query(
    ORACLES["mlm_chunking"].replace("array_to_string(k[chunk * 256 + 1 : chunk * 256 + 256], ' ') AS tokens", "k[chunk * 256 + 1 : chunk * 256 + 256] AS k").replace("SELECT batch, chunk::", ", m AS (SELECT batch, chunk::").rstrip()
    + f"), t AS (SELECT batch, chunk, i, k, k[i] AS t, {_PLACE.format(1)} AS w, {_PLACE.format(9)} AS h, {_PLACE.format(17)} AS o FROM (SELECT batch, chunk, k, unnest(range(1, len(k) + 1)) AS i FROM m))\n"
    "SELECT batch, chunk, string_agg(CASE WHEN w >= 0.15 THEN t WHEN h < 0.8 THEN '[MASK]' WHEN h < 0.9 THEN k[floor(o * len(k))::INTEGER + 1] ELSE t END, ' ' ORDER BY i) AS masked, string_agg(CASE WHEN w < 0.15 THEN t END, ' ' ORDER BY i) AS labels FROM t GROUP BY batch, chunk"
)
def mlm_masked(spark: SparkSession, folder: str) -> DataFrame:
    rows = corpus.masked_chunks(corpus.mlm_chunks(_docs(spark, folder), "id", "tokens"))
    return rows.select("batch", "chunk", F.array_join("masked", " ").alias("masked"), F.nullif(F.array_join("labels", " "), F.lit("")).alias("labels"))


# Terms


@query("SELECT term, count(*)::BIGINT AS n FROM words GROUP BY term", "words")
def term_counts(spark: SparkSession, folder: str) -> DataFrame:
    return index.term_counts(_words(spark, folder))


@query("SELECT * FROM counts", "counts")
def term_counts_by_corpus(spark: SparkSession, folder: str) -> DataFrame:
    return _counts(spark, folder)


@query("SELECT corpus, count(*)::BIGINT AS documents FROM docs GROUP BY corpus", "docs")
def docs_per_corpus(spark: SparkSession, folder: str) -> DataFrame:
    return corpus_documents(_docs(spark, folder))


corpus_documents = index.documents_per_corpus


@query("SELECT * FROM valid", "valid")
def valid_terms(spark: SparkSession, folder: str) -> DataFrame:
    return index.valid_terms(_counts(spark, folder))


@query("SELECT * FROM valid ANTI JOIN targets USING (term) ORDER BY md5(concat_ws('|', '42', term)), term LIMIT 10000", "valid", "targets")
def background_terms_anti(spark: SparkSession, folder: str) -> DataFrame:
    return index.background(index.valid_terms(_counts(spark, folder)), _targets(spark, folder), 10_000)


@query("SELECT * FROM valid ANTI JOIN targets USING (term) ORDER BY md5(concat_ws('|', '42', term)), term LIMIT greatest(0, 400 - (SELECT count(*) FROM targets))", "valid", "targets")
def background_beside_targets(spark: SparkSession, folder: str) -> DataFrame:
    """So many background terms that there are 400 with the targets."""
    return index.background_beside(index.valid_terms(_counts(spark, folder)), _targets(spark, folder), 400)


@query(
    ", least_ AS (SELECT floor(min(n) / 2) AS k FROM counts SEMI JOIN targets USING (term))\nSELECT c.* FROM counts c, least_ WHERE n >= k AND length(split_part(term, '_', 1)) >= 2 AND NOT contains(term, '/') AND regexp_matches(split_part(term, '_', 1), '[a-zA-Z0-9]')",
    "counts",
    "targets",
)
def valid_lemmas(spark: SparkSession, folder: str) -> DataFrame:
    """Background terms that are at least half as frequent as the rarest target."""
    counts = cut(_counts(spark, folder))
    return index.valid_beside(counts, _targets(spark, folder))


@query("SELECT term FROM valid ORDER BY term OFFSET 100", "valid")
def terms_from_offset(spark: SparkSession, folder: str) -> DataFrame:
    return index.from_offset(index.valid_terms(_counts(spark, folder)), 100)


@query("SELECT id, corpus, pos, replace(token, '##', '') AS term, token AS surface FROM (SELECT id, corpus, unnest(range(len(tokens)))::INTEGER AS pos, unnest(tokens) AS token FROM docs) WHERE replace(token, '##', '') IN (SELECT term FROM targets)", "docs", "targets")
def mention_surfaces(spark: SparkSession, folder: str) -> DataFrame:
    """The mentions of targets, single ones too, with their tokens as they stand."""
    return index.mentions(index.positions(_docs(spark, folder), surface=True), _targets(spark, folder)).select("id", "corpus", "pos", "term", "surface")


@query("SELECT w.* FROM words w SEMI JOIN targets USING (term)", "words", "targets")
def target_mentions_semi(spark: SparkSession, folder: str) -> DataFrame:
    return index.mentions(_words(spark, folder), _targets(spark, folder)).select("id", "corpus", "pos", "term")


@query("SELECT term, id, corpus, pos FROM mentions", "mentions")
def mention_sample_cap(spark: SparkSession, folder: str) -> DataFrame:
    valid = cut(index.valid_terms(_counts(spark, folder)))
    return index.capped(_words(spark, folder), counts=valid).select("term", "id", "corpus", "pos")


@query("SELECT term, n, round::INTEGER AS round FROM (SELECT term, n, row_number() OVER (PARTITION BY n ORDER BY md5(concat_ws('|', '42', term)), term) AS round FROM valid) ORDER BY round, md5(concat_ws('|', '42', round, n)), n LIMIT 1000", "valid")
def stratified_terms(spark: SparkSession, folder: str) -> DataFrame:
    return index.stratified(index.valid_terms(_counts(spark, folder)), 1000)


_FLAT = "chr(31) || array_to_string(list_transform(tokens, lambda t: replace(t, '##', '')), chr(31) || chr(31)) || chr(31)"
_SORTED = sorted((p.split() for p in PHRASES), key=lambda p: (-len(p), p))
_ALTERNATIVES = "|".join(r"\x1f\x1f".join(p) for p in _SORTED)
_INNER = ["chr(31) || '" + "' || chr(31) || chr(31) || '".join(p) + "' || chr(31)" for p in _SORTED]


@query(
    f", m AS (SELECT id, regexp_replace({_FLAT}, '\\x1f({_ALTERNATIVES})\\x1f', chr(31) || chr(2) || '\\1' || chr(2) || chr(31), 'g') AS s FROM docs),\n"
    "p AS (SELECT id, unnest(string_split(s, chr(2))) AS part, unnest(range(len(string_split(s, chr(2))))) AS i FROM m),\n"
    "j AS (SELECT id, string_agg(CASE WHEN i % 2 = 1 THEN replace(part, chr(31) || chr(31), ' ') ELSE part END, '' ORDER BY i) AS s FROM p GROUP BY id),\n"
    "t AS (SELECT unnest(string_split(s[2:-2], chr(31) || chr(31))) AS term FROM j)\n"
    "SELECT term, count(*)::BIGINT AS n FROM t GROUP BY term",
    "docs",
)
def phrase_counts(spark: SparkSession, folder: str) -> DataFrame:
    return index.term_counts(index.phrase_mentions(_docs(spark, folder), PHRASES))


@query("SELECT t.term, coalesce(n, 0)::BIGINT AS n, coalesce(n_a, 0)::BIGINT AS n_a, coalesce(n_b, 0)::BIGINT AS n_b, least(coalesce(n_a, 0), coalesce(n_b, 0))::BIGINT AS least, least(coalesce(n_a, 0), coalesce(n_b, 0)) < 3 AS too_few FROM targets t LEFT JOIN counts c ON c.term = t.term", "targets", "counts")
def target_report(spark: SparkSession, folder: str) -> DataFrame:
    return index.target_report(_targets(spark, folder), _counts(spark, folder))


@query("SELECT count(*)::BIGINT AS terms, coalesce(sum(n), 0)::BIGINT AS mentions, count(*) FILTER (n >= 4000)::BIGINT AS capped, min(n)::BIGINT AS fewest, max(n)::BIGINT AS most FROM (SELECT term, count(*) AS n FROM mentions GROUP BY term)", "mentions")
def index_summary(spark: SparkSession, folder: str) -> DataFrame:
    return index.index_summary(mention_sample_cap(spark, folder), 4000)


@query("SELECT term, surface, n::BIGINT AS n, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY n DESC, surface) AS rank FROM (SELECT replace(token, '##', '') AS term, token AS surface, count(*) AS n FROM (SELECT unnest(tokens) AS token FROM docs) GROUP BY ALL)) WHERE rank <= 100 AND term IN (SELECT term FROM targets)", "docs", "targets")
def surface_forms(spark: SparkSession, folder: str) -> DataFrame:
    rows = _docs(spark, folder).select(F.explode("tokens").alias("surface")).select(X.unmark(F.col("surface")).alias("term"), "surface")
    return index.surface_forms(index.mentions(rows, _targets(spark, folder)))


@query(r"SELECT term, id, pos::INTEGER AS pos FROM (SELECT id, unnest(k) AS term, unnest(range(len(k))) AS pos FROM (SELECT id, list_filter(string_split_regex(lemmas, '\s+'), lambda t: t <> '' AND NOT starts_with(t, 'http')) AS k FROM lines)) SEMI JOIN targets USING (term)", "lines", "targets")
def lemma_target_positions(spark: SparkSession, folder: str) -> DataFrame:
    return index.lemma_positions(_lines(spark, folder), _targets(spark, folder)).select("term", "id", "pos")


@query(
    """, pieces AS (SELECT id, list_transform(tokens, lambda t: string_split(replace(t, '##', ' ##'), ' ')) AS p FROM docs)
SELECT w.term, w.id, w.pos, array_to_string(list_concat(list_concat(list_reverse(list_reverse(flatten(p[1:w.pos]))[1:50]), ['[MASK]']), flatten(p[w.pos + 2:])[1:50]), ' ') AS context
FROM words w SEMI JOIN targets USING (term) JOIN pieces ON pieces.id = w.id""",
    "words",
    "targets",
)
def context_windows(spark: SparkSession, folder: str) -> DataFrame:
    docs = _docs(spark, folder)
    found = index.mentions(index.positions(docs), _targets(spark, folder))
    return context.windows(docs, found).select("term", "id", "pos", F.array_join("context", " ").alias("context"))


@query("SELECT x.term, y.word IS NOT NULL AS stopword FROM (SELECT DISTINCT term FROM counts) x LEFT JOIN (SELECT DISTINCT word FROM stopwords WHERE lang = 'eng') y ON y.word = x.term", "counts")
def stopword_terms(spark: SparkSession, folder: str) -> DataFrame:
    stop = _stopwords(spark, folder).withColumnRenamed("word", "term").withColumn("stopword", F.lit(True))
    return _counts(spark, folder).select("term").join(stop, "term", "left").select("term", F.coalesce("stopword", F.lit(False)).alias("stopword"))


# Substitutes and scores


@query("SELECT * FROM bigrams", "bigrams")
def bigram_model(spark: SparkSession, folder: str) -> DataFrame:
    return model.bigrams(context.neighbours(_docs(spark, folder)))


@query("SELECT m.term, m.id, m.corpus, m.pos, string_agg(s.sub, ' ' ORDER BY s.rank) AS top_terms FROM mentions m LEFT JOIN ranked s ON s.l IS NOT DISTINCT FROM m.l AND s.r IS NOT DISTINCT FROM m.r GROUP BY ALL", "mentions", "ranked")
def substitutes_topk(spark: SparkSession, folder: str) -> DataFrame:
    beside = context.neighbours(_docs(spark, folder))
    pairs = cut(model.adjacent(beside, HALVES))
    counts = cut(index.summed(pairs))
    found = index.capped(beside, counts=index.valid_terms(counts))
    rows = model.substitutes(found, model.BigramModel.fit(pairs, counts, _stopwords(spark, folder)))
    return rows.select("term", "id", "corpus", "pos", F.when(F.size("top_terms") > 0, F.array_join("top_terms", " ")).alias("top_terms"))


@query("SELECT term, id, pos, array_to_string(list_filter(top_terms, lambda s: s IS NOT NULL AND length(s) > 1 AND NOT contains(s, '##') AND NOT contains(s, '...') AND NOT contains(s, '[') AND NOT list_contains(w, s))[1:5], ' ') AS kept FROM subs, (SELECT list(word) AS w FROM stopwords WHERE lang = 'eng')", "subs")
def filtered_substitutes(spark: SparkSession, folder: str) -> DataFrame:
    stop = sorted(r[0] for r in _stopwords(spark, folder).collect())  # one language's list, a few hundred words
    return _subs(spark, folder).select("term", "id", "pos", F.array_join(model.filtered(F.col("top_terms"), 5, stop), " ").alias("kept"))


@query("SELECT * FROM hist", "hist")
def substitute_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return score.histogram(_subs(spark, folder))


@query("SELECT * FROM raw", "raw")
def jsd_raw(spark: SparkSession, folder: str) -> DataFrame:
    return score.jensen_shannon(score.histogram(_subs(spark, folder)), HALVES)


@query("SELECT * FROM scaled", "scaled")
def jsd_scaled(spark: SparkSession, folder: str) -> DataFrame:
    return _scaled(spark, folder)


@query(_SCALED.format(s="made_scored"), "made_scored")
def lexical_change_all(spark: SparkSession, folder: str) -> DataFrame:
    return lexical_change(_docs(spark, folder), _stopwords(spark, folder), CONFIG)


QUERIES["lexical_change"] = QUERIES.pop("lexical_change_all")
ORACLES["lexical_change"] = ORACLES.pop("lexical_change_all")


@query("SELECT a.term, count(b.term)::BIGINT AS neighbours FROM valid a LEFT JOIN valid b ON b.term <> a.term AND b.n >= a.n / 2.0 AND b.n <= a.n * 2.0 GROUP BY a.term", "valid")
def neighbour_counts(spark: SparkSession, folder: str) -> DataFrame:
    valid = index.valid_terms(_counts(spark, folder)).select("term", "n", F.lit(0.0).alias("jsd"))
    return score.scaled(valid).select("term", "neighbours")


@query("SELECT s.* FROM scaled s SEMI JOIN targets USING (term)", "scaled", "targets")
def targets_subset(spark: SparkSession, folder: str) -> DataFrame:
    return score.only_targets(_scaled(spark, folder), _targets(spark, folder))


@query("SELECT term FROM targets ANTI JOIN raw USING (term)", "targets", "raw")
def missing_targets(spark: SparkSession, folder: str) -> DataFrame:
    return score.missing_targets(jsd_raw(spark, folder), _targets(spark, folder))


@query("SELECT term, count(*) FILTER (corpus = 'post1970s')::BIGINT AS count_a, count(*) FILTER (corpus = 'pre1980s')::BIGINT AS count_b FROM subs GROUP BY term", "subs")
def mention_counts(spark: SparkSession, folder: str) -> DataFrame:
    return score.mention_counts(_subs(spark, folder), HALVES)


_RANKED = "SELECT *, row_number() OVER (PARTITION BY term, corpus ORDER BY n DESC, sub)::INTEGER AS rank FROM hist"


@query(f"SELECT * FROM ({_RANKED}) WHERE rank <= 15", "hist")
def replacements_top15(spark: SparkSession, folder: str) -> DataFrame:
    return replacements.most_common(score.histogram(_subs(spark, folder)))


@query(
    f", r AS ({_RANKED}), both_ AS (SELECT term FROM hist GROUP BY term HAVING count(DISTINCT corpus) = 2),\na AS (SELECT term, rank, sub, n FROM r SEMI JOIN both_ USING (term) WHERE corpus = 'post1970s'), b AS (SELECT term, rank, sub, n FROM r SEMI JOIN both_ USING (term) WHERE corpus = 'pre1980s')\n"
    "SELECT term, rank, a.sub AS sub_a, a.n AS count_a, b.sub AS sub_b, b.n AS count_b FROM a FULL JOIN b USING (term, rank)",
    "hist",
)
def top_replacements_side_by_side(spark: SparkSession, folder: str) -> DataFrame:
    return replacements.side_by_side(score.histogram(_subs(spark, folder)), HALVES)


@query("SELECT '{' || string_agg(to_json(term) || ':' || coalesce(to_json(scaled_jsd)::VARCHAR, 'null'), ',' ORDER BY term) || '}' AS value FROM scaled", "scaled")
def score_map(spark: SparkSession, folder: str) -> DataFrame:
    return sinks.score_map(_scaled(spark, folder))


@query(
    """, part AS (SELECT id, ('0x' || substr(md5(concat_ws('|', '42', id)), 1, 8))::BIGINT / 4294967296.0 <= 0.05 AS val, list_transform(tokens, lambda t: replace(t, '##', '')) AS t FROM docs),
b AS (SELECT val, t[i - 1] AS l, t[i] AS r FROM (SELECT val, t, unnest(range(1, len(t) + 1)) AS i FROM part) WHERE t[i] IS NOT NULL),
tr AS (SELECT l, r, count(*) AS n FROM b WHERE NOT val AND l IS NOT NULL GROUP BY ALL), lefts AS (SELECT l, sum(n) AS n FROM tr GROUP BY l), v AS (SELECT count(DISTINCT r) AS v FROM b WHERE NOT val),
s AS (SELECT x.n, ln((coalesce(tr.n, 0) + 1) / (coalesce(lefts.n, 0) + v + 1)) AS p FROM (SELECT l, r, count(*) AS n FROM b WHERE val AND l IS NOT NULL GROUP BY ALL) x LEFT JOIN tr ON tr.l = x.l AND tr.r = x.r LEFT JOIN lefts ON lefts.l = x.l, v)
SELECT sum(n)::BIGINT AS tokens, round(exp(-sum(n * p) / sum(n)), 6) AS perplexity FROM s""",
    "docs",
)
def perplexity(spark: SparkSession, folder: str) -> DataFrame:
    rows = corpus.train_val(_docs(spark, folder), "id")
    train, val = (context.neighbours(rows.where(F.col("part") == p).drop("part")) for p in ("train", "val"))
    return model.perplexity(train, val)


@query("SELECT sub, n::BIGINT AS n, row_number() OVER (ORDER BY n DESC, sub)::INTEGER AS rank FROM (SELECT sub, sum(n) AS n FROM hist GROUP BY sub) ORDER BY n DESC, sub LIMIT 10", "hist")
def top_substitutes(spark: SparkSession, folder: str) -> DataFrame:
    return replacements.most_common_overall(score.histogram(_subs(spark, folder)))


# Evaluation

_RANKS = ", r AS (SELECT *, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM judged)\n"


@query(_RANKS + "SELECT count(*)::BIGINT AS pairs, round(corr(x, y), 9) AS pearson, round(corr(rx, ry), 9) AS spearman FROM r", "judged")
def gold_pearson_spearman(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.correlations(_judged(spark, folder)).select("pairs", "pearson", "spearman")


@query()
def gold_p_values(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.correlations(_judged(spark, folder))


_WITHOUT = {"excluded": evaluate.EXCLUDED, "excluded_then": evaluate.EXCLUDED_THEN}


@query(
    ",\n"
    + ",\n".join(f"{k} AS (SELECT *, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM judged WHERE term NOT IN ({', '.join(map(repr, ws))}))" for k, ws in _WITHOUT.items())
    + "\n"
    + " UNION ALL ".join(f"SELECT '{k}' AS without, count(*)::BIGINT AS pairs, round(corr(x, y), 9) AS pearson, round(corr(rx, ry), 9) AS spearman FROM {k}" for k in _WITHOUT),
    "judged",
)
def gold_without_excluded(spark: SparkSession, folder: str) -> DataFrame:
    """The correlations without the words that are left out first, and without those left out then."""
    scores, gold = cut(_scaled(spark, folder)), table(spark, folder, "gold")
    return evaluate.without_excluded(scores, gold).select("without", "pairs", "pearson", "spearman")


@query("SELECT term, x, y FROM judged", "judged")
def gold_scatter(spark: SparkSession, folder: str) -> DataFrame:
    """The points of the figure whose line is ``ols_fit``."""
    return _judged(spark, folder).select("term", "x", "y")


@query("SELECT count(*)::BIGINT AS pairs, round(regr_slope(y, x), 9) AS slope, round(regr_intercept(y, x), 9) AS intercept, round(avg(x), 9) AS mean_x, round(regr_sxx(y, x), 9) AS sxx, round(sqrt(greatest(regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x), 0) / (count(*) - 2)), 9) AS error FROM judged", "judged")
def ols_fit(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.least_squares(_judged(spark, folder))


_RATERS = ", ".join(f"ascii(substr(md5(term), {i}, 1)) % 5 * 1.0::DOUBLE AS p{i}" for i in range(1, 6))


@query(f"SELECT word, (p1 + p2 + p3 + p4 + p5) / 5 AS score FROM (SELECT term AS word, {_RATERS} FROM targets)", "targets")
def rater_mean(spark: SparkSession, folder: str) -> DataFrame:
    """The data have no ratings; five are derived from a hash, for the arithmetic only."""
    raters = [f"p{i}" for i in range(1, 6)]
    rows = _targets(spark, folder).select(F.col("term").alias("word"), *((F.ascii(F.substring(F.md5("term"), i, 1)) % 5 * F.lit(1.0)).alias(f"p{i}") for i in range(1, 6)))
    return evaluate.rater_mean(rows, raters)


@query("SELECT term FROM gold WHERE term IS NOT NULL GROUP BY term EXCEPT SELECT term FROM raw", "raw")
def unscored_gold(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.unscored(jsd_raw(spark, folder), table(spark, folder, "gold").where("term IS NOT NULL"))


@query("SELECT o.term, coalesce(i.n, 0)::BIGINT AS indexed, o.n::BIGINT AS original, round(coalesce(i.n, 0) / o.n, 9) AS share FROM (SELECT term, count(*) AS n FROM words SEMI JOIN valid USING (term) GROUP BY term) o LEFT JOIN (SELECT term, count(*) AS n FROM mentions GROUP BY term) i ON i.term = o.term", "mentions")
def index_coverage(spark: SparkSession, folder: str) -> DataFrame:
    valid = cut(index.valid_terms(_counts(spark, folder)))
    return evaluate.coverage(index.capped(_words(spark, folder), counts=valid), index.mentions(_words(spark, folder), valid))


@query("SELECT round(avg(n), 9) AS mean_n, median(n)::DOUBLE AS median_n, round(avg(least(n_a, n_b)), 9) AS mean_least, median(least(n_a, n_b))::DOUBLE AS median_least FROM valid", "valid")
def index_mean_median(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.index_sizes(index.valid_terms(_counts(spark, folder)))


# Alignment and clusters

_LETTER = "lower(substr(token, 1, 1))"
_VALID_TOKENS = "SELECT lang, lemma, token, n::BIGINT AS n, total::BIGINT AS total, n / total AS share FROM (SELECT *, sum(n) OVER (PARTITION BY lang, lemma) AS total FROM (SELECT lang, lemma, token, count(*) AS n FROM {t} GROUP BY ALL)) WHERE token IS NOT NULL AND n / total >= 0.0002 AND length(token) > 1 AND ({l} = lower(substr(lemma, 1, 1)) {e})"


def _exceptions(rules: list[tuple[str, str, bool, str]]) -> str:
    return " ".join(f"OR (lang = '{lang}' AND " + (f"lemma = '{start}'" if whole else f"starts_with(lower(lemma), '{start}')") + f" AND {_LETTER} = '{letter}')" for lang, start, whole, letter in rules)


@query(_VALID_TOKENS.format(t="aligned WHERE token IS NOT NULL", l=_LETTER, e=_exceptions(align.BACKGROUND_EXCEPTIONS)), "aligned")
def valid_surface_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return align.valid_tokens(align.aligned_words(_lines(spark, folder)), align.BACKGROUND_EXCEPTIONS, False)


@query(_VALID_TOKENS.format(t="aligned", l=_LETTER, e=_exceptions(align.TARGET_EXCEPTIONS)), "aligned")
def target_surface_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return align.valid_tokens(align.aligned_words(_lines(spark, folder)), align.TARGET_EXCEPTIONS, True)


@query(", v AS (" + _VALID_TOKENS.format(t="aligned", l=_LETTER, e=_exceptions(align.TARGET_EXCEPTIONS)) + ")\nSELECT a.lang, a.lemma AS term, a.id, a.token_idx AS pos, a.token AS surface FROM aligned a SEMI JOIN v ON v.lang = a.lang AND v.lemma = a.lemma AND v.token = a.token", "aligned")
def indexed_target_tokens(spark: SparkSession, folder: str) -> DataFrame:
    words = align.aligned_words(_lines(spark, folder))
    return align.indexed_tokens(words, align.valid_tokens(words, align.TARGET_EXCEPTIONS, True))


def _word_lines(spark: SparkSession, folder: str) -> DataFrame:
    return _lines(spark, folder).select("id", X.blank_tokens(F.col("tokens")).alias("t"), X.blank_tokens(F.col("lemmas")).alias("l"), "alignment")


@query(
    r""", x AS (SELECT id, list_filter(string_split_regex(tokens, '\s+'), lambda w: w <> '') AS t, list_filter(string_split_regex(lemmas, '\s+'), lambda w: w <> '') AS l, alignment FROM lines WHERE alignment IS NOT NULL)
SELECT id, coalesce(list_sum(list_transform(alignment, lambda p: CASE WHEN p.token_idx >= 0 AND p.lemma_idx >= 0 AND t[p.token_idx + 1] = l[p.lemma_idx + 1] THEN 0 ELSE 1 END)), 0)::INTEGER AS word_match_score FROM x""",
    "lines",
)
def alignment_word_scores(spark: SparkSession, folder: str) -> DataFrame:
    return align.scores(_word_lines(spark, folder)).select("id", "word_match_score")


# DuckDB's distance counts bytes, so words with other letters are compared by code points, row by row of the edit matrix.
_DISTANCE = """CASE WHEN length(t) = strlen(t) AND length(w) = strlen(w) THEN levenshtein(t, w) ELSE list_last(list_reduce(range(1, length(t) + 1), lambda r, i:
  list_reduce(range(1, length(w) + 1), lambda acc, j: list_append(acc, least(list_last(acc) + 1, r[j + 1] + 1, r[j] + CASE WHEN substr(t, i, 1) = substr(w, j, 1) THEN 0 ELSE 1 END)), [i]), range(0, length(w) + 1))) END"""


@query(
    r""", x AS (SELECT id, list_filter(string_split_regex(tokens, '\s+'), lambda w: w <> '') AS t, list_filter(string_split_regex(lemmas, '\s+'), lambda w: w <> '') AS l, alignment FROM lines WHERE alignment IS NOT NULL),
p AS (SELECT id, a.token_idx < 0 AS no_t, a.lemma_idx < 0 AS no_l, CASE WHEN a.token_idx >= 0 THEN t[a.token_idx + 1] END AS t, CASE WHEN a.lemma_idx >= 0 THEN l[a.lemma_idx + 1] END AS w FROM (SELECT id, t, l, unnest(alignment) AS a FROM x)),
d AS (SELECT t, w, """
    + _DISTANCE
    + """ AS d FROM (SELECT DISTINCT t, w FROM p WHERE t <> w)),
s AS (SELECT p.id, coalesce(CASE WHEN no_t THEN length(p.w) WHEN no_l THEN length(p.t) WHEN p.t = p.w THEN 0 ELSE d + 1 END, 0) AS cost, CASE WHEN p.t = p.w THEN 0 ELSE 1 END AS unequal FROM p LEFT JOIN d ON d.t = p.t AND d.w = p.w)
SELECT x.id, coalesce(sum(cost), 0)::INTEGER AS score, coalesce(sum(unequal), 0)::INTEGER AS word_match_score FROM x LEFT JOIN s ON s.id = x.id GROUP BY x.id""",
    "lines",
)
def alignment_scores(spark: SparkSession, folder: str) -> DataFrame:
    return align.scores(_word_lines(spark, folder))


@query()
def align_documents(spark: SparkSession, folder: str) -> DataFrame:
    rows = cut(_word_lines(spark, folder).select("id", "t", "l", align.align(F.col("t"), F.col("l")).alias("alignment")))  # aligned once
    return align.scores(rows).join(rows.select("id", F.to_json("alignment").alias("alignment")), "id")


@query(
    r"SELECT id, len(list_filter(string_split_regex(tokens, '\s+'), lambda w: w <> ''))::INTEGER AS tokens, len(list_filter(string_split_regex(lemmas, '\s+'), lambda w: w <> ''))::INTEGER AS lemmas, true AS each_once FROM lines WHERE tokens IS NOT NULL",
    "lines",
)
def alignment_covers(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the alignment of each line has every token and every lemma once."""
    rows = _word_lines(spark, folder).select("id", F.size("t").alias("tokens"), F.size("l").alias("lemmas"), align.align(F.col("t"), F.col("l")).alias("a"))
    once = lambda c, n: F.array_sort(F.filter(F.col(f"a.{c}"), lambda i: i >= 0)) == F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    return rows.where("a IS NOT NULL").select("id", "tokens", "lemmas", (once("token_idx", "tokens") & once("lemma_idx", "lemmas")).alias("each_once"))


@query("SELECT term, least(x, y) AS a, greatest(x, y) AS b, count(*)::BIGINT AS n FROM (SELECT term, s[i] AS x, unnest(s[i + 1:]) AS y FROM (SELECT term, s, unnest(range(1, len(s) + 1)) AS i FROM few)) WHERE x <> y GROUP BY ALL", "few")
def cooccurrence_edges(spark: SparkSession, folder: str) -> DataFrame:
    return cluster.edges(_subs(spark, folder))


def _given_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Clusters for the arithmetic of assignment: a term's substitutes by the rank of their counts, modulo three."""
    n = score.histogram(_subs(spark, folder)).groupBy("term", "sub").agg(F.sum("n").alias("n"))
    return index.top(n, ["term"], "sub", 2**31 - 1).select("term", ((F.col("rank") - 1) % 3).alias("cluster"), "sub")


@query(
    """, c AS (SELECT term, ((row_number() OVER (PARTITION BY term ORDER BY n DESC, sub) - 1) % 3)::INTEGER AS cluster, sub FROM (SELECT term, sub, sum(n) AS n FROM hist GROUP BY ALL)),
k AS (SELECT term, cluster, list(sub) AS subs FROM c GROUP BY ALL), f AS (SELECT term, id, pos, list_distinct(s) AS s FROM few WHERE len(s) > 0),
j AS (SELECT f.term, f.id, f.pos, k.cluster, len(list_intersect(f.s, k.subs)) AS both_, len(f.s) + len(k.subs) AS sizes FROM f JOIN k ON k.term = f.term),
r AS (SELECT *, both_ / (sizes - both_) AS similarity, row_number() OVER (PARTITION BY term, id, pos ORDER BY both_ / (sizes - both_) DESC, cluster) AS turn FROM j)
SELECT term, id, pos, cluster, round(similarity, 9) AS similarity FROM r WHERE turn = 1""",
    "hist",
    "few",
)
def jaccard_assignments(spark: SparkSession, folder: str) -> DataFrame:
    return cluster.assignments(_subs(spark, folder), _given_clusters(spark, folder))


@query()
def louvain_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return cluster.clusters(cluster.edges(_subs(spark, folder)))


@query()
def cluster_summary(spark: SparkSession, folder: str) -> DataFrame:
    found = cut(_subs(spark, folder))  # read three times
    members = cut(cluster.clusters(cluster.edges(found)))  # made once
    rows = cluster.cluster_table(members, score.histogram(found), cluster.assignments(found, members))
    return rows.select("term", "cluster", "n", F.to_json("members").alias("members"))


@query(
    """, e AS (SELECT term, x FROM (SELECT term, s[i] AS x, unnest(s[i + 1:]) AS y FROM (SELECT term, s, unnest(range(1, len(s) + 1)) AS i FROM few)) WHERE x <> y UNION SELECT term, y FROM (SELECT term, s[i] AS x, unnest(s[i + 1:]) AS y FROM (SELECT term, s, unnest(range(1, len(s) + 1)) AS i FROM few)) WHERE x <> y)
SELECT term, (SELECT count(*) FROM e WHERE e.term = k.term)::BIGINT AS subs, (SELECT count(*) FROM few WHERE few.term = k.term AND len(s) > 0)::BIGINT AS mentions, true AS apart FROM (SELECT DISTINCT term FROM e) k""",
    "few",
)
def cluster_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Of each term's clusters the substitutes and mentions in all: every substitute with an edge is in one of them, and every mention."""
    rows = cut(cluster_summary(spark, folder).select("term", "n", F.from_json("members", "array<struct<sub:string>>")["sub"].alias("subs")))
    of = rows.groupBy("term").agg(F.sum("n").alias("mentions"), F.sum(F.size("subs")).alias("all"))
    once = rows.select("term", F.explode("subs").alias("sub")).groupBy("term").agg(F.count_distinct("sub").alias("subs"))
    return of.join(once, "term").select("term", "subs", "mentions", (F.col("all") == F.col("subs")).alias("apart"))


@query("SELECT lang, word FROM stopwords GROUP BY ALL")
def stopword_lists(spark: SparkSession, folder: str) -> DataFrame:
    rows = [readers.stopwords_of(table(spark, folder, "stopwords"), lang).select(F.lit(lang).alias("lang"), "word") for lang in readers.STOPWORD_LANGUAGES]
    return rows[0].union(rows[1]).union(rows[2]).union(rows[3])


@query("SELECT term, replace(replace(term || '_nn', '_nn', '_NOUN'), '_vb', '_VERB') AS renamed, replace(replace(term || '_nn', '_nn', ''), '_vb', '') AS dropped, split_part(term || '_nn', '_', 1) AS word FROM targets", "targets")
def rewritten_targets(spark: SparkSession, folder: str) -> DataFrame:
    tagged = F.concat("term", F.lit("_nn"))
    return _targets(spark, folder).select("term", X.rename_pos(tagged).alias("renamed"), X.drop_pos(tagged).alias("dropped"), X.before_underscore(tagged).alias("word"))


TABLES |= {
    "lexicon": "SELECT token, lemma FROM (SELECT token, lemma, row_number() OVER (PARTITION BY token ORDER BY count(*) DESC, lemma) AS t FROM aligned WHERE lang = 'eng' AND token IS NOT NULL GROUP BY token, lemma) WHERE t = 1",
}


def _lexicon(spark: SparkSession, folder: str) -> DataFrame:
    return lemmas.lexicon(align.aligned_words(_lines(spark, folder)).where("lang = 'eng'"))


@query("SELECT token, lemma FROM lexicon", "lexicon")
def lemma_lexicon(spark: SparkSession, folder: str) -> DataFrame:
    return _lexicon(spark, folder).select("token", "lemma")


@query("SELECT w.id, string_agg(coalesce(x.lemma, w.term), ' ' ORDER BY w.pos) AS lemmas FROM words w LEFT JOIN lexicon x ON x.token = w.term GROUP BY w.id", "words", "lexicon")
def lemmatize(spark: SparkSession, folder: str) -> DataFrame:
    rows = lemmas.lemmatized(_docs(spark, folder), _lexicon(spark, folder)).where(F.size("lemmas") > 0)
    return rows.select("id", F.array_join("lemmas", " ").alias("lemmas"))


@query("SELECT coalesce(x.lemma, w.term) || '_X' AS term, count(*)::BIGINT AS n FROM words w LEFT JOIN lexicon x ON x.token = w.term GROUP BY 1", "words", "lexicon")
def lemma_pos_counts(spark: SparkSession, folder: str) -> DataFrame:
    rows = lemmas.as_units(lemmas.lemmatized(_docs(spark, folder), _lexicon(spark, folder)), "lemma_pos")
    return index.term_counts(index.positions(rows))


@query("SELECT w.id, w.corpus, w.pos, w.term FROM words w SEMI JOIN targets USING (term) WHERE term IN (SELECT term FROM words GROUP BY term HAVING count(*) >= 2)", "words", "targets")
def repeated_mentions(spark: SparkSession, folder: str) -> DataFrame:
    return index.enough_mentions(index.mentions(_words(spark, folder), _targets(spark, folder))).select("id", "corpus", "pos", "term")


@query(
    " UNION ALL ".join(f"(SELECT '{kind}' AS kind, row_number() OVER (ORDER BY {order}, term)::INTEGER AS rank, term, n::BIGINT AS n, neighbours FROM scaled ORDER BY {order}, term LIMIT 15)" for kind, order in (("rarest", "n"), ("fewest_neighbours", "neighbours"), ("most_neighbours", "neighbours DESC"))),
    "scaled",
)
def score_diagnostics(spark: SparkSession, folder: str) -> DataFrame:
    return score.diagnostics(cut(_scaled(spark, folder)))


@query("SELECT term, id, pos::INTEGER AS pos FROM (SELECT id, split_part(unnest(k), '_', 1) AS term, unnest(range(len(k))) AS pos FROM (SELECT id, list_filter(string_split_regex(lemmas, '\\s+'), lambda t: t <> '' AND NOT starts_with(t, 'http')) AS k FROM lines)) SEMI JOIN targets USING (term)", "lines", "targets")
def lemma_target_positions_nopos(spark: SparkSession, folder: str) -> DataFrame:
    return index.lemma_positions(_lines(spark, folder), _targets(spark, folder), without_pos=True).select("term", "id", "pos")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
