from pyspark.sql import functions as F

from lexshift.functions import stats
from lexshift.functions import text as X
from lexshift.operators import context, corpus, index


def value(spark, column, **row):
    names = ", ".join(f"{k} {t}" for k, (t, _) in row.items())
    return spark.createDataFrame([tuple(v for _, v in row.values())], names).select(column.alias("x")).first()[0]


def text(spark, f, s):
    return value(spark, f(F.col("s")), s=("string", s))


def words(spark, f, ws):
    return value(spark, f(F.col("w")), w=("array<string>", ws))


def test_cleaning(spark):
    assert text(spark, X.clean, " a ### b_c ") == "a # b c"
    assert text(spark, X.hashes_to_blank, "a##b#c") == "a b#c"
    assert text(spark, X.german, "ſuͤß oͤ aͤ") == "suß o a"
    assert text(spark, X.strip, None) is None
    assert text(spark, X.strip, " \n ") == ""
    assert text(spark, X.rename_pos, "run_vb old_nn") == "run_VERB old_NOUN"
    assert text(spark, X.drop_pos, "run_vb") == "run"
    assert text(spark, X.before_underscore, "run_VERB_x") == "run"
    assert text(spark, X.strip_accents, "über déjà") == "uber deja"
    assert text(spark, lambda c: X.without_prefix(X.blank_tokens(c), "http"), " a http://b  c") == ["a", "c"]


def test_tokens(spark):
    assert text(spark, X.regex_tokens, "Ein Über Haus, don't!") == ["ein", "über", "haus", ",", "don", "'", "t", "!"]
    assert text(spark, X.regex_tokens, "") == []
    assert words(spark, X.pieces, ["a", "b##c##d"]) == ["a", "b", "##c", "##d"]
    assert words(spark, X.rejoined, ["##a", "##b", "c", "##d"]) == ["##a##b", "c##d"]
    assert words(spark, X.without_punctuation, [",", "?!", "hello", "."]) == ["hello"]
    keyed = value(spark, X.keyed_by_pos(F.col("a"), F.col("b")), a=("array<string>", ["run"]), b=("array<string>", ["VERB"]))
    assert keyed == ["run_VERB"]
    assert X.model_folder("d", "tokenized", "x/bert-large/", True) == "d/tokenized_bert-large_SA"


def test_corpus(spark):
    raw = "abcdefghij @ @ @ @ @ @ @ @ @ @ short @ @ @ @ @ @ @ @ @ @ klmnopqrst"
    rows = corpus.redaction_chunks(spark.createDataFrame([("d", raw)], "k string, t string"), "k", "t").collect()
    assert sorted(map(tuple, rows)) == [("d_00000", "abcdefghij"), ("d_00002", "klmnopqrst")]
    assert text(spark, corpus.file_text, "@@1\n\nthe text\n") == "the text"
    assert text(spark, corpus.file_text, "@@1 the text") == "the text"
    assert text(spark, corpus.file_text, "a\nb") is None
    assert value(spark, corpus.threshold_label(F.col("y"), "year", 1980), y=("int", 1960)) == "year<1980.0"
    assert value(spark, corpus.threshold_label(F.col("y"), "year", 1980), y=("int", 1980)) == "year>=1980.0"
    assert value(spark, corpus.half_of_decade(F.col("y")), y=("int", 1970)) == "pre1980s"
    docs = spark.range(2000).select(F.col("id").cast("string").alias("id"))
    n = {r["part"]: r["count"] for r in corpus.train_val(docs, "id").groupBy("part").count().collect()}
    assert n["train"] + n["val"] == 2000 and 60 < n["val"] < 150
    again = corpus.train_val(docs.repartition(7), "id").where("part = 'val'").count()
    assert again == n["val"]


def test_report(spark):
    df = spark.createDataFrame([(None,), (" ",), ("a b",), ("​",)], "t string")
    r = corpus.tokenizer_report(df, "t").first().asDict()
    assert r == {"documents": 4, "without_text": 1, "empty": 1, "without_tokens": 1, "kept": 1, "most_tokens": 2}
    assert corpus.tokenizer_report(df.limit(0), "t").first()["documents"] == 0


def test_mlm_chunks_lose_only_the_rest(spark):
    docs = spark.createDataFrame([(str(i), [f"{i}_{j}" for j in range(7)]) for i in range(30)], "id string, tokens array<string>")
    got = [t for r in corpus.mlm_chunks(docs, "id", "tokens", 16, 1000).orderBy("batch", "chunk").collect() for t in r["tokens"]]
    assert len(got) == 30 * 7 // 16 * 16 and len(set(got)) == len(got)


def test_context(spark):
    t = list("abcdefg")
    at = lambda pos, n: value(spark, context.window(F.col("t"), F.lit(pos), n, 2), t=("array<string>", t))
    assert at(3, 1) == ["b", "c", "[MASK]", "e", "f"]
    assert at(0, 1) == ["[MASK]", "b", "c"]
    assert at(2, 2) == ["a", "b", "[MASK]", "e", "f"]
    none = value(spark, context.window(F.col("t"), F.lit(3), 1, 0), t=("array<string>", t))
    assert none == ["[MASK]"]


def test_phrases(spark):
    docs = spark.createDataFrame([("d", "a", "new york city new car new york".split()), ("e", "b", [])], "id string, corpus string, tokens array<string>")
    rows = index.phrase_mentions(docs, ["new york", "new york city"]).where("term <> ''").orderBy("pos").collect()
    assert [(r["term"], r["pos"], r["words"]) for r in rows] == [("new york city", 0, 3), ("new", 3, 1), ("car", 4, 1), ("new york", 5, 2)]


def test_stats():
    assert abs(stats.t_quantile(0.975, 10) - 2.2281388520) < 1e-8
    assert abs(stats.two_sided_p(0.5, 20) - 0.0247688) < 1e-6
    assert stats.two_sided_p(1.0, 5) == 0.0 and stats.two_sided_p(None, 5) is None and stats.two_sided_p(0.1, 2) is None
