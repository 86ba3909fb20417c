import gzip
import json

import pytest
from pyspark.sql import functions as F

from lexshift.sources import readers, sinks
from lexshift.streaming import counts


def test_json_and_lists(spark, tmp_path):
    (tmp_path / "d.jsonlist").write_text('{"key": 1, "body": "a", "year": 1960}\n{"key": "b"}\n')
    rows = readers.json_documents(spark, str(tmp_path / "d.jsonlist"), "key", "body", "year").collect()
    assert sorted(map(tuple, rows)) == [("1", "a", "1960"), ("b", None, None)]
    (tmp_path / "g.tsv").write_text("run\t1.5\nold\nrun\t1.5\n")
    assert {r[0] for r in readers.targets(spark, str(tmp_path / "g.tsv")).collect()} == {"run", "old"}
    assert readers.gold(spark, str(tmp_path / "g.tsv")).where("score IS NULL").count() == 1
    (tmp_path / "r.csv").write_text("w,p1,p2,p3,p4,p5\na,1,2,3,4,5\n")
    assert tuple(readers.ratings(spark, str(tmp_path / "r.csv")).first()) == ("a", 1, 2, 3, 4, 5)
    (tmp_path / "s.txt").write_text("the \n\nof\n")
    assert {r[0] for r in readers.stopwords(spark, str(tmp_path / "s.txt")).collect()} == {"the", "of"}


def test_stopwords_of(spark):
    t = spark.createDataFrame([("eng", "the"), ("ger", "der")], "lang string, word string")
    assert [r[0] for r in readers.stopwords_of(t, "ger").collect()] == ["der"]
    assert readers.stopwords_of(t, None).count() == 0
    with pytest.raises(ValueError):
        readers.stopwords_of(t, "fra")


def test_decade_files(spark, tmp_path):
    (tmp_path / "1960s").mkdir()
    (tmp_path / "1960s/fic_1961_7.txt").write_text("@@7\n\nA text <p> of ##words_here @ @ @ @ @ @ @ @ @ @ and the second part\n")
    (tmp_path / "1990s").mkdir()
    (tmp_path / "1990s/mag_1991_8.txt").write_text("@@8 one line only here")
    rows = {tuple(r) for r in readers.decade_files(spark, str(tmp_path), [1960, 1990]).collect()}
    assert rows == {("fic_1961_7_00000", 1960, 1961, "fic", "pre1980s", "A text of  words here"), ("fic_1961_7_00001", 1960, 1961, "fic", "pre1980s", "and the second part"), ("mag_1991_8_00000", 1990, 1991, "mag", "post1970s", "one line only here")}
    (tmp_path / "1990s/bad.txt").write_text("x y z and more")
    with pytest.raises(Exception, match="three parts"):
        readers.decade_files(spark, str(tmp_path), [1990]).collect()


def test_numbered_lines(spark, tmp_path):
    with gzip.open(tmp_path / "c.txt.gz", "wt") as f:
        f.write("a_nn  ##b\nſuͤ http://x\n")
    rows = readers.numbered_lines(spark, str(tmp_path / "c.txt.gz"), "c").orderBy("id")
    assert [tuple(r) for r in rows.collect()] == [("c_00000000", "a_nn  #b", "c"), ("c_00000001", "ſuͤ http://x", "c")]
    assert [r["text"] for r in readers.lemma_lines(rows, "eng").collect()] == ["a #b", "ſuͤ http://x"]
    assert [r["text"] for r in readers.token_lines(rows, "ger").collect()] == ["a nn #b", "su"]


def test_numbered_lines_of_several_blocks(spark, tmp_path):
    (tmp_path / "c.txt").write_text("".join(f"line {i} {'x' * (i % 50)}\n" for i in range(2000)) + "the end")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4000b")
        rows = readers.numbered_lines(spark, str(tmp_path / "c.txt"), "c")
        got = {r["id"]: r["text"] for r in rows.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(got) == 2001 and got["c_00002000"] == "the end" and all(got[f"c_{i:08}"].split()[1] == str(i) for i in range(2000))
    (tmp_path / "e.txt").write_text("")
    assert readers.numbered_lines(spark, str(tmp_path / "e.txt"), "e").count() == 0
    with pytest.raises(ValueError, match="one file"):
        readers.numbered_lines(spark, str(tmp_path / "*.txt"), "c")


def test_sinks(spark, tmp_path):
    found = spark.createDataFrame([("t", "d1", 3), ("t", "d0", 1), ("u", "d2", 0)], "term string, id string, pos int")
    maps = {json.loads(r[0])["term"]: json.loads(r[0])["mentions"] for r in sinks.index_maps(found).collect()}
    assert maps == {"t": [["d0", "1"], ["d1", "3"]], "u": [["d2", "0"]]}
    sinks.index_maps(found).write.text(str(tmp_path / "maps"))
    assert sorted(map(tuple, readers.term_index_lines(spark, str(tmp_path / "maps")).collect())) == sorted(map(tuple, found.collect()))
    (tmp_path / "i.json").write_text(json.dumps({"t": [["d0", 1], ["d1", 3]], "u": [["d2", 0]]}))
    assert sorted(map(tuple, readers.term_index(spark, str(tmp_path / "i.json")).collect())) == sorted(map(tuple, found.collect()))
    scores = spark.createDataFrame([("a", 0.5), ("b", None)], "term string, scaled_jsd double")
    assert json.loads(sinks.score_map(scores).first()[0]) == {"a": 0.5, "b": None}
    sinks.score_table(scores, str(tmp_path / "s"))
    assert spark.read.option("header", True).csv(str(tmp_path / "s")).count() == 2
    sinks.by_term(found, str(tmp_path / "t"))
    assert spark.read.json(str(tmp_path / "t")).count() == 3
    sinks.training_text(found.select("id", F.col("term").alias("text"), F.lit("train").alias("part")), str(tmp_path / "x"))
    assert spark.read.text(str(tmp_path / "x/train")).count() == 3
    sinks.config_sidecar(spark, {"k": 5}, str(tmp_path / "c"))
    assert spark.read.option("multiline", True).json(str(tmp_path / "c")).first()["k"] == 5


def test_stream_counts(spark, tmp_path):
    docs = spark.createDataFrame([("1", "a", ["x", "y##z"]), ("2", "b", ["x"])], "id string, corpus string, tokens array<string>")
    docs.write.parquet(str(tmp_path / "in"))
    q = counts.running_counts(counts.stream(spark, str(tmp_path / "in"), docs)).writeStream.outputMode("complete").format("memory").queryName("running").start()
    q.processAllAvailable()
    docs.write.mode("append").parquet(str(tmp_path / "in"))
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("running").collect()} == {("x", 4), ("yz", 2)}


def test_package_stopwords(spark):
    got = {x: {r[0] for r in readers.package_stopwords(spark, x).collect()} for x in ("eng", "lat", "swe")}
    assert "ourselves" in got["eng"] and "quisquis" in got["lat"] and "någon" in got["swe"] and all(len(v) > 80 for v in got.values())
    assert readers.package_stopwords(spark, None).count() == 0
    with pytest.raises(ValueError, match="table or file"):
        readers.package_stopwords(spark, "ger")
    with pytest.raises(ValueError, match="fra"):
        readers.package_stopwords(spark, "fra")
