"""Problem 4: one consistent form for text that looks the same.

``canonical`` isolates the unstable segments of a string by quick-check properties (a class of code points derived from
the Unicode database), normalises only those, each with the character before it as boundary context, and splices them
back into the unchanged rest.

What a reader does not see is levelled: zero-width and other ignorable characters, order and composition of accents,
width and kind of blanks, full-width and joined letter shapes, font variants, and letters of other scripts that look
like Latin ones. What a reader does see stays: case, accents, raised figures, punctuation, line breaks.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexshift.tables import BROADCAST_BYTES, HOT_ROWS, quoted, spread_join
from lexshift.workdir import cut

# Letters of other scripts and the Latin letters they look like, in order of code points.
LOOK_ALIKES = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "ν": "v", "ο": "o", "ρ": "p", "ϲ": "c", "ϳ": "j", "Ϲ": "C", "Ϳ": "J",
    "Ѕ": "S", "І": "I", "Ј": "J", "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P",
    "С": "C", "Т": "T", "Х": "X", "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s",
    "і": "i", "ј": "j", "ѵ": "v", "Ү": "Y", "Һ": "H", "һ": "h", "Ӏ": "I", "ԁ": "d", "Ԍ": "G", "ԛ": "q", "Ԛ": "Q",
    "ԝ": "w", "Ԝ": "W", "Օ": "O", "Տ": "S", "Ս": "U", "հ": "h", "ո": "n", "ս": "u", "օ": "o", "ց": "g", "ℎ": "h",
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮐ": "G", "Ꮓ": "Z",
    "Ꮩ": "V", "Ꮪ": "S", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ᏼ": "B", "ꮃ": "w", "ꮓ": "z", "ꮩ": "v", "ꮪ": "s", "ꮯ": "c",
    "ᴄ": "c", "ᴏ": "o", "ᴜ": "u", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "ꜱ": "s", "ӏ": "l", "ԍ": "ɢ", "Ѵ": "V",
    "ɑ": "a", "ɡ": "g", "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z",
    "ꓝ": "F", "ꓟ": "M", "ꓠ": "N", "ꓡ": "L", "ꓢ": "S", "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y",
    "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U", "‐": "-", "‑": "-", "…": "...",
}
#: Kinds of compatibility mapping that change no visible shape; raised, lowered, circled forms stay.
SHAPES = {"<wide>", "<narrow>", "<font>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>"}
#: Ignorable characters outside category Cf, as ranges.
IGNORABLE = [(0x34F, 0x34F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFFA0, 0xFFA0), (0xE0100, 0xE01EF)]
#: Signs of category Cf that are visible.
VISIBLE_CF = {*range(0x600, 0x606), 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD}


def _class(points: list[int]) -> str:
    """A character class of the code points, as ranges."""
    runs: list[list[int]] = []
    for p in points:
        if runs and runs[-1][1] == p - 1:
            runs[-1][1] = p
        else:
            runs.append([p, p])
    return "".join(f"\\U{a:08x}" if a == b else f"\\U{a:08x}-\\U{b:08x}" for a, b in runs)


class _Tables:
    """Derived once a process from the Unicode database."""

    def __init__(self) -> None:
        self.to: dict[str, str] = {}
        unstable = []
        ignorable = {p for a, b in IGNORABLE for p in range(a, b + 1)}
        for p in (*range(0x80, 0xD800), *range(0xF900, 0x11900), *range(0x1D100, 0x1F200), *range(0x2F800, 0x2FA20), *range(0xE0000, 0xE0200)):
            c = chr(p)
            kind, made = unicodedata.category(c), unicodedata.decomposition(c)
            if p in ignorable or (kind == "Cf" and p not in VISIBLE_CF):
                self.to[c] = ""
            elif kind == "Zs":
                self.to[c] = " "
            elif kind in ("Zl", "Zp") or p == 0x85:
                self.to[c] = "\n"
            elif c in LOOK_ALIKES:
                self.to[c] = LOOK_ALIKES[c]
            elif made.startswith("<"):
                tag = made.split(" ")[0]
                if tag in SHAPES or (tag == "<compat>" and (re.search("LIGATURE|ROMAN NUMERAL", unicodedata.name(c, "")) or kind == "Lt" or re.search(r"LETTER (DZ|LJ|NJ)$", unicodedata.name(c, "")))):
                    self.to[c] = unicodedata.normalize("NFKC", c)
            # quick check: marks may combine with what stands before; the rest is unstable where it decomposes to a look-alike or composes otherwise
            if c in self.to or unicodedata.combining(c) or kind == "Mn" or 0x1161 <= p <= 0x11FF:
                unstable.append(p)
            elif made and not made.startswith("<") and (unicodedata.normalize("NFC", c) != c or any(x in LOOK_ALIKES for x in unicodedata.normalize("NFD", c))):
                unstable.append(p)
        self.to["\t"] = " "
        self.table = str.maketrans(self.to)
        # beyond the basic plane every character is looked at: one range there keeps the test of a character fast
        self.unstable = re.compile(f"[{_class([p for p in unstable if p < 0x10000])}\\U00010000-\\U0010ffff]+")
        self.uneven = re.compile(r"[\t\v\f\r]| [ \n]|\n |\A\s|\s\Z")
        self.breaks, self.blanks = re.compile(r"\r\n?|\v|\f"), re.compile(r"[ \t]+")
        self.around = re.compile(r" ?\n ?")


@lru_cache(maxsize=1)
def tables() -> _Tables:
    return _Tables()


def _spliced(text: str) -> str:
    """``text`` with its unstable segments normalised, each with the character before it."""
    t = tables()
    out, last = [], 0
    for m in t.unstable.finditer(text):
        start = max(last, m.start() - 1)
        segment = unicodedata.normalize("NFD", text[start : m.end()].translate(t.table)).translate(t.table)
        out += [text[last:start], unicodedata.normalize("NFC", segment)]
        last = m.end()
    return "".join([*out, text[last:]]) if out else text


def canonical(text: str | None) -> str | None:
    """The form that all strings share which a reader takes for ``text``. NULL stays NULL, blank text becomes empty."""
    if text is None:
        return None
    t = tables()
    if not text.isascii():
        text = _spliced(text)
    if t.uneven.search(text):
        text = t.around.sub("\n", t.blanks.sub(" ", t.breaks.sub("\n", text))).strip()
    return text


def canonical_column(column: Column) -> Column:
    """``canonical`` over Arrow batches."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(canonical, na_action="ignore")

    return run(column)


def with_canonical(df: DataFrame, field: str, to: str = "canonical") -> DataFrame:
    """``df`` with the canonical form of the string column ``field`` in the new column ``to``.

    NULL stays NULL, an empty or blank text becomes empty, long texts are treated whole, repeated rows are kept, an
    empty table gives an empty table. A column that is named ``to`` gives way; all others pass through.
    """
    return df.withColumn(to, canonical_column(F.col(quoted(field))))


def _mixed(df: DataFrame, id_field: str, field: str, limits: tuple[int, int]) -> DataFrame:
    """``key, form, id, exact`` of the rows in classes that hold two different strings, written; each row once."""
    rows = df.select(F.col(quoted(id_field)).alias("id"), F.col(quoted(field)).alias("stored")).where("id IS NOT NULL AND stored IS NOT NULL")
    some = with_canonical(rows, "stored").select("id", F.xxhash64("canonical").alias("key"), F.md5("canonical").alias("form"), F.xxhash64("stored").alias("exact"))
    forms = cut(some).where(F.col("form") != F.md5(F.lit("")))  # after writing: a filter before it would normalise twice
    mixed = cut(forms.groupBy("key").agg(F.min("exact").alias("low"), F.max("exact").alias("high")).where("low <> high").select("key"))
    return cut(spread_join(forms, mixed, "key", *limits).dropDuplicates(["key", "form", "id", "exact"]))


def same_looking(df: DataFrame, id_field: str, field: str, broadcast_bytes: int = BROADCAST_BYTES, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``id, class, string, members, strings, links``: a row for each id whose string looks like another, different one.

    ``class`` is the md5 of the common form, ``string`` a hash of the stored string, ``members`` and ``strings`` are those
    of the class, ``links`` the members with another string. Nothing is paired, so a class costs what it has rows, however
    many. Rows whose id or string is NULL, or whose canonical form is empty, are in no class; repeated rows of one id and
    string count once; an empty table gives no rows. Every string is normalised once and goes on as hashes only (64 bits to
    group by, 128 more to be sure), written to the shared folder.
    """
    limits = broadcast_bytes, hot_rows
    few = _mixed(df, id_field, field, limits)
    by = few.groupBy("form", "exact").agg(F.count("*").alias("same"))
    total = cut(by.groupBy("form").agg(F.sum("same").alias("members"), F.count("*").alias("strings")).where("strings > 1"))
    sizes = cut(spread_join(by, total, "form", *limits).select(F.xxhash64("form", "exact").alias("both"), "members", "strings", (F.col("members") - F.col("same")).alias("links")))
    out = spread_join(few.select("id", "form", "exact", F.xxhash64("form", "exact").alias("both")), sizes, "both", *limits)
    return out.select("id", F.col("form").alias("class"), F.col("exact").alias("string"), "members", "strings", "links")


def same_looking_pairs(df: DataFrame, id_field: str, field: str, broadcast_bytes: int = BROADCAST_BYTES, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Pairs of different ids whose strings differ but look the same: ``id_a < id_b``; all pairs of every class.

    Rows are taken as by ``same_looking``. A class with very many rows is spread over tasks on one side of the join.
    """
    few = _mixed(df, id_field, field, (broadcast_bytes, hot_rows))
    a, b = (few.select("key", *(F.col(c).alias(f"{c}_{x}") for c in ("id", "exact", "form"))) for x in "ab")
    pairs = spread_join(a, b, "key", broadcast_bytes, hot_rows)
    return pairs.where("id_a < id_b AND exact_a <> exact_b AND form_a = form_b").select("id_a", "id_b").distinct()
