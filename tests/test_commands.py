import json
import random
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from lexshift.__main__ import main
from lexshift.functions import text as X
from lexshift.operators import corpus, index, lemmas
from lexshift.plans.training import Training
from lexshift.sources import readers


def test_pipeline_by_commands(spark, tmp_path):
    r = random.Random(1)
    words = ["old", "new", "house", "river", "mill", "stone", "green", "field"]
    with open(tmp_path / "d.jsonlist", "w") as f:
        for i in range(300):
            f.write(json.dumps({"id": i, "text": " ".join(r.choice(words) for _ in range(12)) + ".", "year": 1960 + i % 40}) + "\n")
    p = lambda x: str(tmp_path / x)
    (tmp_path / "stop.txt").write_text("the\n")
    (tmp_path / "gold.tsv").write_text("house\t0.5\nmill\t0.1\nriver\t0.9\nold house\t0.2\nnowhere\t1\n")
    main(["tokenize", "--infile", p("d.jsonlist"), "--source-field", "year", "--source-field-threshold", "1980", "--out", p("docs")])
    docs = spark.read.parquet(p("docs"))
    assert {x[0] for x in docs.select("corpus").distinct().collect()} == {"year<1980.0", "year>=1980.0"}
    main(["index-terms", "--docs", p("docs"), "--targets", p("gold.tsv"), "--maps", p("maps"), "--out", p("index")])
    made = spark.read.parquet(p("index")).select("term", F.col("id").cast("string"), "pos")
    assert sorted(map(tuple, readers.term_index_lines(spark, p("maps")).collect())) == sorted(map(tuple, made.collect()))
    main(["get-substitutes", "--docs", p("docs"), "--index", p("index"), "--stopwords", p("stop.txt"), "--out", p("subs")])
    main(["compute-jsds", "--substitutes", p("subs"), "--index", p("index"), "--csv", p("csv"), "--out", p("scores")])
    scores = {x["term"]: x for x in spark.read.parquet(p("scores")).collect()}
    assert set(words) <= set(scores) and all(0 <= x["jsd"] <= 1 for x in scores.values())
    main(["evaluate-scores", "--scores", p("scores"), "--gold", p("gold.tsv"), "--out", p("eval.jsonlist")])
    assert spark.read.json(p("eval.jsonlist")).count() == 2
    main(["gather-top-replacements", "--substitutes", p("subs"), "--out", p("side")])
    main(["do-clustering", "--substitutes", p("subs"), "--assignments", p("assigned"), "--out", p("clusters")])
    assigned = spark.read.parquet(p("assigned"))
    summed = spark.read.parquet(p("clusters")).agg(F.sum("n")).first()[0]
    assert set(assigned.columns) == {"term", "id", "pos", "cluster", "similarity"} and assigned.count() == summed
    main(["evaluate-scores", "--scores", p("scores"), "--gold", p("gold.tsv"), "--exclude", "decades", "--out", p("without")])
    assert sorted(map(tuple, spark.read.parquet(p("without")).select("of", "without").collect())) == [(c, w) for c in ("jsd", "scaled_jsd") for w in ("excluded", "excluded_then")]
    terms = sorted(r[0] for r in spark.read.parquet(p("index")).select("term").distinct().collect())
    main(["get-substitutes", "--docs", p("docs"), "--index", p("index"), "--stopwords", p("stop.txt"), "--start", "2", "--allow-single", "--by-term", p("folders"), "--out", p("rest")])
    assert spark.read.json(p("folders")).count() == spark.read.parquet(p("rest")).count()
    rest = spark.read.parquet(p("rest"))
    assert sorted(r[0] for r in rest.select("term").distinct().collect()) == terms[2:] and rest.where("term <> surface AND term NOT LIKE '% %'").count() == 0
    main(["index-terms", "--docs", p("docs"), "--targets", p("gold.tsv"), "--beside-targets", "--max-terms", "6", "--out", p("few")])
    few = {r[0] for r in spark.read.parquet(p("few")).select("term").distinct().collect()}
    assert len(few) <= 6 and {"house", "mill", "river"} <= few
    main(["export-for-pretraining", "--docs", p("docs"), "--text-out", p("text")])
    n = [spark.read.text(p(f"text/{x}")).count() for x in ("train", "val")]
    assert sum(n) == 300 and spark.read.parquet(p("clusters")).count() > 0


def test_lemmas(spark):
    words = spark.createDataFrame([("ran", "run"), ("ran", "run"), ("ran", "rin"), ("mice", "mouse"), (None, "x")], "token string, lemma string")
    known = lemmas.lexicon(words)
    docs = spark.createDataFrame([("1", "a", ["the", "mice", "ra##n"]), ("2", "b", [])], "id string, corpus string, tokens array<string>")
    got = {r["id"]: r for r in lemmas.lemmatized(docs, known).collect()}
    assert got["1"]["lemmas"] == ["the", "mouse", "run"] and got["2"]["lemmas"] == [] and got["1"]["pos"] == ["X"] * 3
    assert lemmas.uneven(lemmas.lemmatized(docs, known)).count() == 0
    units = lemmas.as_units(lemmas.lemmatized(docs, known), "lemma_pos").where("id = '1'").first()["tokens"]
    assert units == ["the_X", "mouse_X", "run_X"]
    parts = spark.createDataFrame([([("do", "do", "V", False), ("n't", "not", "P", True), ("go", "go", "V", False)],)], "p array<struct<text:string,lemma:string,pos:string,touches:boolean>>")
    assert [tuple(x) for x in parts.select(lemmas.merged(F.col("p"))).first()[0]] == [("don't", "donot", "V"), ("go", "go", "V")]


def test_train_calls_the_program(spark, tmp_path):
    program = tmp_path / "trainer.py"
    program.write_text("import sys, json; json.dump(sys.argv[1:], open(sys.argv[sys.argv.index('--out') + 1], 'w'))")
    main(["train", "--text", "t", "--model", "m", "--model-out", str(tmp_path / "o"), "--program", f"{sys.executable} {program}"])
    got = json.loads((tmp_path / "o").read_text())
    given = dict(zip(got[::2], got[1::2], strict=True))
    assert given["--train"] == "t/train" and given["--epochs"] == "5" and given["--batch-size"] == "32" and given["--max-length"] == "256" and given["--mask-probability"] == "0.15"
    with pytest.raises(subprocess.CalledProcessError):
        Training().run([sys.executable, "-c", "raise SystemExit(3)"], "t", "m", "o")


def test_masked_chunks(spark):
    df = spark.createDataFrame([(0, k, [f"w{i}" for i in range(256)]) for k in range(40)], "batch int, chunk int, tokens array<string>")
    rows = corpus.masked_chunks(df).collect()
    places = [(f"w{i}", m, x) for r in rows for i, (m, x) in enumerate(zip(r["masked"], r["labels"], strict=True))]
    chosen = [(t, m) for t, m, x in places if x is not None]
    assert all(x in (None, t) and (x or m == t) for t, m, x in places) and 0.13 < len(chosen) / len(places) < 0.17
    assert 0.75 < sum(m == "[MASK]" for _, m in chosen) / len(chosen) < 0.85 and 0.07 < sum(m == t for t, m in chosen) / len(chosen) < 0.14
    assert rows != corpus.masked_chunks(df, seed=43).collect()


def test_lemmatize_from_a_parser(spark, tmp_path):
    docs = spark.createDataFrame([("1", "a", ["don't", "go"]), ("2", "b", ["x", "y"]), ("3", "b", ["z"])], "id string, corpus string, tokens array<string>")
    parts = spark.createDataFrame([("1", [("do", "do", "V", False), ("n't", "not", "P", True), ("go", "go", "V", False)]), ("2", [("x", "x", "N", False)])], "id string, parts array<struct<text:string,lemma:string,pos:string,touches:boolean>>")
    docs.write.parquet(str(tmp_path / "docs"))
    parts.write.parquet(str(tmp_path / "parts"))
    main(["lemmatize", "--docs", str(tmp_path / "docs"), "--parsed", str(tmp_path / "parts"), "--out", str(tmp_path / "out")])
    got = {r["id"]: (r["lemmas"], r["pos"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"1": (["donot", "go"], ["V", "V"]), "2": (["x"], ["N"]), "3": ([], [])}
    assert [r[0] for r in lemmas.uneven(spark.read.parquet(str(tmp_path / "out"))).orderBy("id").collect()] == ["2", "3"]


def test_tokenize_with_a_vocabulary(spark, tmp_path):
    (tmp_path / "v.txt").write_text("un\n##known\nword\n")
    (tmp_path / "d.jsonlist").write_text(json.dumps({"id": "1", "text": "Unknown word", "source": "a"}) + "\n")
    main(["tokenize", "--infile", str(tmp_path / "d.jsonlist"), "--vocabulary", str(tmp_path / "v.txt"), "--out", str(tmp_path / "out")])
    assert [list(r["tokens"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [["un##known", "word"]]


def test_wordpiece_and_singles(spark, tmp_path):
    (tmp_path / "v.txt").write_text("un\n##known\n##k\nword\n,\n")
    df = spark.createDataFrame([("Unknown, word zz",), (None,)], "t string")
    assert [r[0] for r in df.select(X.wordpiece(F.col("t"), str(tmp_path / "v.txt"))).collect()] == [["un", "##known", ",", "word", "[UNK]"], None]
    found = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "term string, pos int")
    assert index.enough_mentions(found).count() == 2 and index.enough_mentions(found, 1).count() == 3
