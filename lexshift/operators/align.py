"""Alignment of tokens with lemmas, and what follows from an alignment.

The alignment itself is sequential within a line, so it runs in Python over Arrow batches, line by line; all that is
counted afterwards are joins and aggregates.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexshift.functions.text import PUNCTUATION, blank_tokens

PAIRS = "array<struct<token_idx:int,lemma_idx:int>>"
#: First letters that count as the same besides equal ones, for targets: language, lemma or its beginning, first letter of the token.
TARGET_EXCEPTIONS = [("lat", "jus", True, "i"), ("lat", "v", False, "u"), ("ger", "packen", True, "g"), ("ger", "Kubikmeter", True, "c"), ("ger", "überspannen", True, "u"), ("swe", "kokärt", True, "ä")]
#: The same for background lemmas, all by their beginning.
BACKGROUND_EXCEPTIONS = [("lat", "j", False, "i"), ("lat", "v", False, "u"), ("ger", "ü", False, "u"), ("ger", "u", False, "ü")]


@lru_cache(maxsize=200_000)
def distance(a: str, b: str) -> int:
    """Edit distance by code points."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], diagonal if x == y else 1 + min(diagonal, row[j], row[j - 1])
    return row[-1]


def pair_cost(a: str, b: str) -> int:
    return 0 if a == b else distance(a, b) + 1


def anchors(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of equal words that occur once in each list, walked in order; a word out of step may cost one look ahead on either side."""
    once_a, once_b = Counter(a), Counter(b)
    both = {w for w, n in once_a.items() if n == 1 and once_b[w] == 1}
    left = [(i, w) for i, w in enumerate(a) if w in both]
    right = [(j, w) for j, w in enumerate(b) if w in both]
    out, at = [], 0
    for k, (i, w) in enumerate(left):
        if at >= len(right):
            break
        if right[at][1] != w:
            if at + 1 < len(right) and right[at + 1][1] == w:
                at += 1
            elif k + 1 < len(left) and left[k + 1][1] == right[at][1]:
                continue  # the same word of b is tried with the next of a
        if right[at][1] == w:
            out.append((i, right[at][0]))
        at += 1
    return out


def fill(long: list[str], short: list[str]) -> list[int]:
    """For each word of ``long`` the index in ``short`` or -1: gaps are put into ``short`` one by one, each where the whole costs least, the first place in ties."""
    held: list[int] = list(range(len(short)))
    for _ in range(len(long) - len(short)):

        def cost(i: int, j: int) -> int:
            return len(long[i]) if j >= len(held) or held[j] < 0 else pair_cost(long[i], short[held[j]])

        after = [0] * (len(long) + 1)  # cost of all from i on, each with the place before its own
        for i in range(len(long) - 1, 0, -1):
            after[i] = after[i + 1] + cost(i, i - 1)
        best, place, before = None, 0, 0
        for p in range(len(held) + 1):
            total = before + len(long[p]) + after[p + 1]
            if best is None or total < best:
                best, place = total, p
            before += cost(p, p)
        held.insert(place, -1)
    return held[: len(long)]


def aligned(tokens: list[str], lemmas: list[str]) -> list[tuple[int, int]]:
    """Sorted pairs that hold every token and every lemma once; -1 is unaligned. Punctuation is set aside and comes back unaligned."""
    keep_t = [i for i, t in enumerate(tokens) if t not in PUNCTUATION]
    keep_l = [i for i, t in enumerate(lemmas) if t not in PUNCTUATION]
    a, b = [tokens[i] for i in keep_t], [lemmas[i] for i in keep_l]
    ends = [(-1, -1), (len(a), len(b))]
    found: list[tuple[int, int]] = []
    while True:
        marks = sorted(ends + found)
        new = [(i + x + 1, j + y + 1) for (i, j), (i2, j2) in zip(marks, marks[1:]) if i2 - i > 1 and j2 - j > 1 for x, y in anchors(a[i + 1 : i2], b[j + 1 : j2])]
        if not new:
            break
        found += new
    for (i, j), (i2, j2) in zip(marks, marks[1:]):
        left, right = a[i + 1 : i2], b[j + 1 : j2]
        if len(left) >= len(right):
            found += [(i + 1 + x, j + 1 + y if y >= 0 else -1) for x, y in enumerate(fill(left, right))]
        else:
            found += [(i + 1 + x if x >= 0 else -1, j + 1 + y) for y, x in enumerate(fill(right, left))]
    out = [(keep_t[x] if x >= 0 else -1, keep_l[y] if y >= 0 else -1) for x, y in found]
    out += [(i, -1) for i in sorted(set(range(len(tokens))) - set(keep_t))] + [(-1, j) for j in sorted(set(range(len(lemmas))) - set(keep_l))]
    return sorted(out)


def align(tokens: Column, lemmas: Column) -> Column:
    """The alignment of two lists of words (compared in lower case) as an array of pairs; NULL where a list is NULL."""

    @F.pandas_udf(PAIRS)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for ts, ls in batches:
            yield pd.Series([None if t is None or x is None else [{"token_idx": i, "lemma_idx": j} for i, j in aligned([w.lower() for w in t], [w.lower() for w in x])] for t, x in zip(ts, ls, strict=True)], dtype=object)

    return run(tokens, lemmas)


def scores(lines: DataFrame) -> DataFrame:
    """``id, score, word_match_score`` of lines with word lists ``t, l`` and ``alignment``: edit costs and unequal pairs."""
    p = lambda x: (F.get("t", F.when(x["token_idx"] >= 0, x["token_idx"])), F.get("l", F.when(x["lemma_idx"] >= 0, x["lemma_idx"])))

    def cost(x: Column) -> Column:
        t, w = p(x)
        return F.when(x["token_idx"] < 0, F.length(w)).when(x["lemma_idx"] < 0, F.length(t)).when(t == w, 0).otherwise(F.levenshtein(t, w) + 1)

    def unequal(x: Column) -> Column:
        t, w = p(x)
        return F.when((x["token_idx"] >= 0) & (x["lemma_idx"] >= 0) & (t == w), 0).otherwise(1)

    total = lambda f: F.aggregate(F.transform("alignment", f), F.lit(0), lambda a, b: a + F.coalesce(b, F.lit(0)))
    return lines.where("alignment IS NOT NULL").select("id", total(cost).alias("score"), total(unequal).alias("word_match_score"))


def aligned_words(lines: DataFrame) -> DataFrame:
    """``id, lang, lemma_idx, lemma, token_idx, token`` of the lemmas of ``id, lang, tokens, lemmas, alignment``; token is NULL where unaligned."""
    rows = lines.where("alignment IS NOT NULL").select("id", "lang", blank_tokens(F.col("tokens")).alias("t"), blank_tokens(F.col("lemmas")).alias("l"), F.explode("alignment").alias("x"))
    rows = rows.where("x.lemma_idx >= 0").select("id", "lang", F.col("x.lemma_idx").alias("lemma_idx"), F.get("l", F.col("x.lemma_idx")).alias("lemma"), F.col("x.token_idx").alias("token_idx"), F.get("t", F.when(F.col("x.token_idx") >= 0, F.col("x.token_idx"))).alias("token"))
    return rows.where("lemma IS NOT NULL")


def valid_tokens(words: DataFrame, exceptions: list[tuple[str, str, bool, str]], count_unaligned: bool, least: float = 0.0002) -> DataFrame:
    """``lang, lemma, token, n, total, share`` of the surface tokens that stand for a lemma.

    A token needs a share of the lemma's tokens, two characters, and the lemma's first letter or an exception.
    """
    seen = words if count_unaligned else words.where("token IS NOT NULL")
    n = seen.groupBy("lang", "lemma", "token").agg(F.count("*").alias("n"))
    total = n.groupBy("lang", "lemma").agg(F.sum("n").alias("total"))
    rows = n.where("token IS NOT NULL").join(total, ["lang", "lemma"]).withColumn("share", F.col("n") / F.col("total"))
    first = F.lower(F.substring("token", 1, 1))
    fits = first == F.lower(F.substring("lemma", 1, 1))
    for lang, start, whole, letter in exceptions:
        lemma = F.col("lemma") if whole else F.lower("lemma")
        fits = fits | ((F.col("lang") == lang) & (lemma == start if whole else F.startswith(lemma, F.lit(start))) & (first == letter))
    return rows.where((F.col("share") >= least) & (F.length("token") > 1) & fits)


def indexed_tokens(words: DataFrame, valid: DataFrame) -> DataFrame:
    """``lang, term, id, pos, surface``: lemma mentions whose surface token is valid, at the token's place."""
    return words.where("token IS NOT NULL").join(valid.select("lang", "lemma", "token"), ["lang", "lemma", "token"]).select("lang", F.col("lemma").alias("term"), "id", F.col("token_idx").alias("pos"), F.col("token").alias("surface"))
