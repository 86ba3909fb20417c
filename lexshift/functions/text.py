"""Scalar text functions, as column expressions; Python only where Spark has no built-in (accents)."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the default tokens, words or single signs. Blanks and control signs of any kind separate.
TOKEN_PATTERN = r"[\p{L}\p{M}\p{N}]+|[^\s\p{Z}\p{C}\p{L}\p{M}\p{N}]"
#: Fixed value: punctuation of the alignment; a token is punctuation where it occurs in this string.
PUNCTUATION = ',.;?!:()"'
#: Fixed value: the mark of removed words, ten signs.
REDACTED = "@ @ @ @ @ @ @ @ @ @"
_BLANK = r"[\s\p{Z}\x0b\x1c-\x1f\x85]+"


def strip(c: Column) -> Column:
    """Without blanks of any kind at both ends."""
    return F.regexp_replace(F.regexp_replace(c, "^" + _BLANK, ""), _BLANK + r"\z", "")


def collapse_hashes(c: Column) -> Column:
    """Runs of # become one, so that no literal text looks like a continuation mark."""
    return F.regexp_replace(c, "#+", "#")


def hashes_to_blank(c: Column) -> Column:
    """Two or more # become a blank (decade corpus)."""
    return F.regexp_replace(c, "##+", " ")


def underscores_to_blank(c: Column) -> Column:
    return F.translate(c, "_", " ")


def german(c: Column) -> Column:
    """Long s, and vowels with a small e above, in their modern form."""
    for old, new in (("ſ", "s"), ("uͤ", "u"), ("oͤ", "o"), ("aͤ", "a")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def clean(c: Column) -> Column:
    """Cleaning before tokenization."""
    return underscores_to_blank(collapse_hashes(strip(c)))


def blank_tokens(c: Column) -> Column:
    """The parts between blanks; none for blank text."""
    return F.filter(F.split(c, r"\s+"), lambda t: t != "")


def without_prefix(tokens: Column, prefix: str) -> Column:
    """Tokens that do not begin so: ``<`` drops markup, ``http`` addresses."""
    return F.filter(tokens, lambda t: ~F.startswith(t, F.lit(prefix)))


def before_underscore(c: Column) -> Column:
    """A term without its part of speech."""
    return F.substring_index(c, "_", 1)


def rename_pos(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("_nn"), F.lit("_NOUN")), F.lit("_vb"), F.lit("_VERB"))


def drop_pos(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("_nn"), F.lit("")), F.lit("_vb"), F.lit(""))


def unmark(c: Column) -> Column:
    """A token without continuation marks."""
    return F.replace(c, F.lit("##"), F.lit(""))


def unmarked(tokens: Column) -> Column:
    return F.transform(tokens, unmark)


def keyed_by_pos(words: Column, pos: Column) -> Column:
    """Keys word_POS of two lists of one length."""
    return F.zip_with(words, pos, lambda w, p: F.concat_ws("_", w, p))


def strip_accents(c: Column) -> Column:
    """Decomposed, without nonspacing marks."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: "".join(x for x in unicodedata.normalize("NFD", t) if unicodedata.category(x) != "Mn"), na_action="ignore")

    return run(c)


def regex_tokens(c: Column) -> Column:
    """The default tokenizer: lower-cased words and single signs."""
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN_PATTERN), F.lit(0))


def wordpiece(c: Column, vocabulary: str, unknown: str = "[UNK]", longest: int = 100) -> Column:
    """Word pieces of the default tokens, from a file with one piece a line: at each place the longest piece known.

    A word that cannot be covered, or is longer than ``longest``, is one unknown piece. The file must be readable by
    all executors; it is read once a process.
    """

    @F.pandas_udf("array<string>")
    def run(lists: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = _vocabulary(vocabulary)

        def cover(word: str) -> list[str]:
            out, at = [], 0
            while at < len(word) <= longest:
                end = next((e for e in range(len(word), at, -1) if ("##" if at else "") + word[at:e] in known), None)
                if end is None:
                    return [unknown]
                out.append(("##" if at else "") + word[at:end])
                at = end
            return out or [unknown]

        for s in lists:
            yield s.map(lambda ws: [p for w in ws for p in cover(w)], na_action="ignore")

    return run(regex_tokens(c))


@lru_cache(maxsize=4)
def _vocabulary(path: str) -> frozenset[str]:
    with open(path, encoding="utf-8") as f:
        return frozenset(line.rstrip("\n") for line in f)


def pieces(tokens: Column) -> Column:
    """Word pieces of marked tokens, each continuation with its mark."""
    return F.flatten(F.transform(tokens, lambda t: F.split(F.replace(t, F.lit("##"), F.lit(" ##")), " ")))


def rejoined(parts: Column) -> Column:
    """Words of word pieces: a piece with a mark is appended, marks kept, unless it comes first."""
    glued = F.array_join(F.transform(parts, lambda p, i: F.when((i > 0) & F.startswith(p, F.lit("##")), p).otherwise(F.concat(F.lit("\x00"), p))), "")
    return F.filter(F.split(glued, "\x00"), lambda t: t != "")


def without_punctuation(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: ~F.contains(F.lit(PUNCTUATION), t))


def model_name(path: str) -> str:
    """The last part of a model's path that is not empty."""
    return next((p for p in reversed(path.split("/")) if p), "")


def model_folder(base: str, prefix: str, model: str, without_accents: bool = False) -> str:
    return f"{base}/{prefix}_{model_name(model)}{'_SA' if without_accents else ''}"
