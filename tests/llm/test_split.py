import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexshift.llm import split

SCHEMA = "id string, tokens array<string>, text string, start_ string"


def cut(spark, rows, **limits):
    df = spark.createDataFrame([(str(i), t, x, "e") for i, (t, x) in enumerate(rows)], SCHEMA)
    out: dict[int, list] = {}
    for r in split.split_oversized(df, **limits).collect():
        out.setdefault(int(r["id"]), []).append(r)
    return {i: sorted(ps, key=lambda r: r["piece_no"]) for i, ps in out.items()}


def words_of(pieces):
    words = []
    for p in pieces:
        if p is not None and p.startswith("##"):
            words[-1] += p
        else:
            words.append(p)
    return words


def whole(ps, tokens, text, limit, overlap):
    key = "piece_tokens" if tokens is not None else "piece_text"
    joined = [] if tokens is not None else ""
    for i, r in enumerate(ps):
        part = r[key]
        assert r["piece_no"] == i and r["n_pieces"] == len(ps) and len(part) == r["size"] <= limit and r["start"] == len(joined) - r["shared"]
        if i:
            assert r["shared"] == overlap and part[:overlap] == joined[-overlap:]
        joined += part[r["shared"] :]
    assert (words_of(joined) if tokens is not None else joined) == (tokens if tokens is not None else text)


def test_cases(spark):
    long_token = "a" + "##b" * 700
    sentences = ["w"] * 150 + ["."] + ["w"] * 300 + ["x##y", "?", '"']
    rows = [(None, None), ([], "x"), (None, ""), (["a", None, "##", ""], None), ([long_token], None), (sentences, None), (None, "x" * 5000), (None, ("Ein Satz. " * 40 + "\n\n") * 9), (None, "é" * 1200), (None, "𝒳" * 1201), (["w"] * 256, None), (["w"] * 257, None)]
    got = cut(spark, rows)
    assert 0 not in got and set(got) == set(range(1, len(rows)))
    for i, ps in got.items():
        t, x = rows[i]
        if i == 3:
            assert ps[0]["piece_tokens"] == ["a", None, "", "##", ""]
            continue
        whole(ps, t, x, 256 if t is not None else 1200, 32 if t is not None else 150)
    assert [len(got[i]) for i in (8, 9, 10, 11)] == [1, 2, 1, 2]
    assert got[5][0]["piece_tokens"][-1] == "."
    assert got[7][0]["piece_text"].endswith("\n\n")


def test_random(spark):
    r = random.Random(5)
    rows = []
    for _ in range(60):
        rows.append(([r.choice(["a", "b##c", ".", '"', "d##e##f##g"]) for _ in range(r.randint(0, 900))], None))
        rows.append((None, "".join(r.choice(["a", "word", " ", ". ", "\n", "\n\n", "! \"", "é", "́"]) for _ in range(r.randint(0, 2500)))))
    for i, ps in cut(spark, rows, max_pieces=64, piece_overlap=8, max_chars=200, char_overlap=30).items():
        whole(ps, *rows[i], 64 if rows[i][0] is not None else 200, 8 if rows[i][0] is not None else 30)


def test_found_and_errors(spark):
    df = spark.createDataFrame([("a", ["w"] * 257, "x"), ("a", ["w"] * 257, "x"), ("b", ["w"] * 256, "x" * 9999), ("c", None, "y" * 1201)], "id string, tokens array<string>, text string")
    assert sorted({r["id"] for r in split.split_oversized(df).where("n_pieces > 1").collect()}) == ["a", "c"]
    assert split.split_oversized(df.limit(0)).count() == 0
    clash = df.selectExpr("id AS Size", "tokens", "text", "1 AS row", "2 AS p", "3 AS cores", "4 AS `a.b`", "5 AS `from`")
    got = split.split_oversized(clash)
    assert got.columns == ["row", "p", "cores", "a.b", "from", *split.MADE] and got.where("size <= 256").count() >= 4
    assert tuple(got.first())[:5] == (1, 2, 3, 4, 5)
    with pytest.raises(ValueError):
        split.text_pattern(100, 50)


@settings(max_examples=20)
@given(st.integers(20, 400))
def test_pattern_bounds(limit):
    assert f"{{1,{limit}}}" in split.text_pattern(limit, limit // 5)


def test_rejoined_sees_what_is_wrong(spark):
    words = [f"w{i}" + ("##s" if i % 3 else "") for i in range(40)]
    df = spark.createDataFrame([("a", words, None), ("b", None, "some words here. " * 20), ("c", [], "x"), ("d", [None, "a##b"], None), ("e", None, "")], "id string, tokens array<string>, text string")
    limits = (16, 4, 60, 10)
    made = split.split_oversized(df, "tokens", "text", *limits)
    good = {r["id"]: r for r in split.rejoined(made, "id", limits).collect()}
    whole = {"a": " ".join(words).replace("##", " ##"), "b": "some words here. " * 20, "c": "", "d": "<null> a ##b", "e": ""}
    assert {k: (r["fits"], r["follows"], r["whole"]) for k, r in good.items()} == {k: (True, True, hashlib.md5(w.encode()).hexdigest()) for k, w in whole.items()}
    for wrong in (made.where("NOT (id = 'a' AND piece_no = 1)"), made.withColumn("piece_tokens", F.expr("CASE WHEN piece_no = 1 THEN reverse(piece_tokens) ELSE piece_tokens END"))):
        bad = {r["id"]: r for r in split.rejoined(wrong, "id", limits).collect()}
        assert not bad["a"]["follows"] and bad["b"]["follows"] and bad["a"]["whole"] != good["a"]["whole"]
    assert not any(r["fits"] for r in split.rejoined(made, "id", (3, 4, 9, 10)).where("id IN ('a', 'b')").collect())
