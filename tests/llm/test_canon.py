import unicodedata

import pytest
from hypothesis import given
from hypothesis import strategies as st

from lexshift.llm import canon
from lexshift.llm.canon import canonical


@pytest.mark.parametrize(
    ("a", "b"),
    [
        ("ｓｈｅ　ｉｓ", "she is"), ("é", "é"), ("е́", "é"), ("a​b­c͏", "abc"), ("ﬁn ﬂuck ﬃ", "fin fluck ffi"),
        ("соѕі", "cosi"), ("a b   c", "a b c"), ("ạ̈", "ạ̈"), ("x y ", "x y"), ("﻿a", "a"),
        ("e‍́", "é"), ("ї", "ï"), ("a\r\nb", "a\nb"), ("a \n b", "a\nb"), ("Å", "Å"), ("Å", "Å"),
    ],
)
def test_same(a, b):
    assert canonical(a) == canonical(b)


@pytest.mark.parametrize(("a", "b"), [("A", "a"), ("é", "e"), ("x²", "x2"), ("x¹", "x1"), ("a.", "a"), ("ä", "ae"), ("ſ", "s"), ("a\n\nb", "a b"), ("œ", "oe"), ("ı", "i"), ("–", "-")])
def test_different(a, b):
    assert canonical(a) != canonical(b)


@given(st.text(max_size=60))
def test_stable(s):
    once = canonical(s)
    assert canonical(once) == once
    assert canonical(unicodedata.normalize("NFD", s)) == canonical(unicodedata.normalize("NFC", s))


@given(st.text(st.characters(max_codepoint=126, min_codepoint=33), max_size=40))
def test_plain_text_stays(s):
    assert canonical(s) == s


def test_column(spark):
    df = spark.createDataFrame([(None, 1), ("", 2), ("  ", 3), ("ａ" * 100_000, 4), ("b", 5), ("b", 5)], "t string, k int")
    got = [r["canonical"] for r in canon.with_canonical(df, "t").orderBy("k").collect()]
    assert got == [None, "", "", "a" * 100_000, "b", "b"]
    over = canon.with_canonical(df.where("k = 4 OR k = 5").selectExpr("t AS `a.t`", "k AS Canonical"), "a.t")
    assert len(over.columns) == 2 and {r["canonical"] for r in over.collect()} == {"a" * 100_000, "b"}


def test_pairs(spark):
    rows = [("1", "she"), ("2", "ｓhe"), ("3", "she"), ("3", "she"), ("4", "SHE"), ("5", None), (None, "ｓhe"), ("6", " "), ("7", ""), ("8", "ѕhe")]
    df = spark.createDataFrame(rows, "id string, t string").withColumnRenamed("t", "key")
    got = sorted(map(tuple, canon.same_looking_pairs(df, "id", "key").collect()))
    assert got == [("1", "2"), ("1", "8"), ("2", "3"), ("2", "8"), ("3", "8")]
    assert canon.same_looking_pairs(df.limit(0), "id", "key").count() == 0


@pytest.mark.parametrize(("small", "hot"), [(10**7, 10**6), (-1, 10**6), (-1, 5)])
def test_classes_and_their_pairs(spark, small, hot):
    """A class with most of the rows in two spellings: memberships say what the pairs do."""
    rows = [(f"{i:03}", "she" if i % 3 else "ѕhe") for i in range(60)] + [("a", "x"), ("b", "ｘ"), ("c", "y"), ("c", "y"), ("d", None), ("e", "x")]
    df = spark.createDataFrame(rows, "id string, t string").repartition(3)
    found = {r["id"]: (r["members"], r["strings"], r["links"]) for r in canon.same_looking(df, "id", "t", small, hot).collect()}
    pairs = [tuple(r) for r in canon.same_looking_pairs(df, "id", "t", small, hot).collect()]
    assert len(pairs) == len(set(pairs)) == 40 * 20 + 2 and {i for p in pairs for i in p} == set(found)
    assert found["000"] == (60, 2, 40) and found["001"] == (60, 2, 20) and found["b"] == (3, 2, 2) and found["a"] == (3, 2, 1)
    assert sum(x[2] for x in found.values()) == 2 * len(pairs)
    assert canon.same_looking(df.limit(0), "id", "t", small, hot).count() == 0


@pytest.mark.parametrize(("a", "b"), [("ӏ", "l"), ("ԍ", "ɢ"), ("ⅼ", "l"), ("ⅽ", "c"), ("Ⅰ", "I"), ("ⅷ", "viii"), ("Ⅻ", "XII"), ("Ꭰ", "D"), ("ꮯ", "c"), ("ꮪ", "s"), ("ꮃ", "w"), ("ᴄ", "c"), ("ᴏ", "o"), ("ᴠ", "v"), ("ꜱ", "s"), ("Ѵ", "V")])
def test_more_look_alikes(a, b):
    assert canonical(f"x{a}y") == canonical(f"x{b}y") == f"x{b}y"


@pytest.mark.parametrize("c", ["²", "①", "ʰ", "½", "ı", "ʀ"])
def test_what_can_be_seen_stays(c):
    assert canonical(c) == c
