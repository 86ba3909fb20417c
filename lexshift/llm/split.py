"""Problem 1: splitting oversized items at natural boundaries.

A text is cut by one regular expression with bounded quantifiers. Its alternatives are ordered by the strength of the
boundary (all that is left, paragraph, sentence, line, word, character) and each takes as much as the bound allows. A
match is the part of a piece that is new; the piece gets its overlap by looking back into the match before it, which is
never shorter than the overlap. So the new parts joined give the text again, and a piece is never over the limit.

Token lists go the same way: every word piece becomes one letter of a code string that tells where words and sentences
end, the expression cuts the code string, and the cuts are carried over to the word pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexshift.tables import quoted

#: Columns that a split adds.
MADE = ("piece_no", "n_pieces", "unit", "start", "size", "shared", "piece_tokens", "piece_text")
#: Production limits: characters, word pieces, and what consecutive pieces share.
MAX_CHARS, CHAR_OVERLAP, MAX_PIECES, PIECE_OVERLAP = 1200, 150, 256, 32
#: Tokens that end a sentence, and that may follow such an end.
ENDS, CLOSERS = [".", "!", "?", "…", "。", "！", "？"], ['"', "'", "”", "’", "»", ")", "]"]


def pattern(limit: int, overlap: int, boundaries: list[tuple[bool, str]], loose: str) -> str:
    """The expression for pieces of at most ``limit`` with ``overlap``.

    boundaries: look-arounds by strength, each with whether it needs at least half a piece before it. loose: the
    look-around that the character fallback avoids to break if it can.
    """
    if not 0 < overlap <= limit // 4:
        raise ValueError("the overlap must be positive and at most a quarter of the limit")
    most = limit - overlap
    ways = [rf"\A.{{1,{limit}}}\z", rf".{{1,{most}}}\z"]
    ways += [f".{{{max(overlap, most // 2) if half else overlap},{most}}}{at}" for half, at in boundaries]
    return "(?s)(?:" + "|".join([*ways, f".{{{overlap},{most}}}{loose}", f".{{{most}}}"]) + ")"


def text_pattern(limit: int = MAX_CHARS, overlap: int = CHAR_OVERLAP) -> str:
    sentence = r"(?:(?<=[.!?…][\"'”’»)\]\s]{0,3}\s)(?![\"”’»)\]])|(?<=[。！？]))"
    paragraph = r"(?<=\n[ \t]{0,8}\n)(?!\s)"
    return pattern(limit, overlap, [(True, paragraph), (True, sentence), (False, paragraph), (False, sentence), (False, r"(?<=\n)"), (False, r"(?<=\s)(?!\s)"), (False, r"(?<=\s)")], r"(?![\p{M}‍])")


def code_pattern(limit: int = MAX_PIECES, overlap: int = PIECE_OVERLAP) -> str:
    return pattern(limit, overlap, [(True, r"(?<=eq?)(?!q)"), (False, r"(?<=eq?)(?!q)"), (False, r"(?<=[eqw])")], "")


def word_pieces(tokens: Column) -> Column:
    """The word pieces of a token list; a piece that goes on a word keeps its ``##``. A NULL entry is one NULL piece."""
    return F.flatten(F.transform(tokens, lambda t: F.coalesce(F.transform(F.split(t, "##", -1), lambda p, i: F.when(i > 0, F.concat(F.lit("##"), p)).otherwise(p)), F.array(F.lit(None).cast("string")))))


def code_of(tokens: Column) -> Column:
    """One letter a word piece: ``-`` inside a word, else ``e`` at a sentence end, ``q`` for a closing sign, ``w``."""

    def one(t: Column) -> Column:
        marks = F.coalesce(((F.length(t) - F.length(F.replace(t, F.lit("##"), F.lit("")))) / 2).cast("int"), F.lit(0))
        return F.concat(F.repeat(F.lit("-"), marks), F.when(t.isin(ENDS), "e").when(t.isin(CLOSERS), "q").otherwise("w"))

    return F.array_join(F.transform(tokens, one), "")


def _held(df: DataFrame, keep: list[str] | list[Column], **columns: Column) -> DataFrame:
    """``keep`` and ``columns``, made once a row: what a generator puts out is not evaluated again wherever it is used."""
    return df.select(*keep, F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def _kept(df: DataFrame, tokens: str, text: str) -> list[str]:
    given_up = {c.lower() for c in (tokens, text, *MADE)}
    return [c for c in df.columns if c.lower() not in given_up]


def _matches(df: DataFrame, tokens: str, text: str, limits: tuple[int, int, int, int]) -> DataFrame:
    """The kept columns as ``c0, c1, ..``, ``has`` (tokens), ``tokens``, and ``cores``: the matches that cut each row that has something to cut."""
    max_pieces, piece_overlap, max_chars, char_overlap = limits
    toks, txt = F.col(quoted(tokens)), F.col(quoted(text))
    has = toks.isNotNull()
    cores = F.when(has, F.regexp_extract_all(code_of(toks), F.lit(code_pattern(max_pieces, piece_overlap)), F.lit(0))).otherwise(F.regexp_extract_all(txt, F.lit(text_pattern(max_chars, char_overlap)), F.lit(0)))
    # the kept columns travel under numbers, so that no name in use here can clash with theirs
    keep = [F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(_kept(df, tokens, text))]
    found = _held(df.where(has | txt.isNotNull()), keep, has=has, tokens=toks, cores=cores)
    return found.select(*_numbers(found), "has", "tokens", F.when(F.size("cores") > 0, F.col("cores")).otherwise(F.array(F.lit(""))).alias("cores"))


def _numbers(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith("c") and c[1:].isdigit()]


def split_oversized(df: DataFrame, tokens: str = "tokens", text: str = "text", max_pieces: int = MAX_PIECES, piece_overlap: int = PIECE_OVERLAP, max_chars: int = MAX_CHARS, char_overlap: int = CHAR_OVERLAP) -> DataFrame:
    """One row per piece, with the columns of ``df`` but the two split ones, and these:

    ``piece_no`` from 0, ``n_pieces``, ``unit`` (tokens or text), ``start`` and ``size`` in word pieces or characters
    with the overlap, ``shared`` with the piece before, ``piece_tokens`` (word pieces) or ``piece_text``.

    The tokens are split; where they are NULL, the text. Rows that fit come out as one piece, as do empty lists and
    texts; rows with neither give no piece. A single token over the limit is cut between its word pieces, text without
    blanks between characters. Repeated rows are kept; a column of ``df`` named like a new one gives way to it. Every
    row is treated by itself, without a shuffle.
    """
    found = _matches(df, tokens, text, (max_pieces, piece_overlap, max_chars, char_overlap))
    at = F.aggregate("cores", F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")), lambda a, c: F.struct((a["at"] + F.length(c)).alias("at"), F.concat(a["all"], F.array(a["at"])).alias("all")), lambda a: a["all"])
    held = _held(found, _numbers(found), has=F.col("has"), cores=F.col("cores"), pieces=F.when(F.col("has"), word_pieces(F.col("tokens"))), at=at)

    def piece(core: Column, i: Column) -> Column:
        back = F.when(i == 0, 0).when(F.col("has"), piece_overlap).otherwise(char_overlap)
        start, size = F.get("at", i) - back, F.length(core) + back
        before = F.when(i > 0, F.right(F.get("cores", i - 1), F.lit(char_overlap))).otherwise("")
        return F.struct(start.alias("start"), size.alias("size"), back.alias("shared"), F.when(F.col("has"), F.slice("pieces", start + 1, size)).alias("piece_tokens"), F.when(~F.col("has"), F.concat(before, core)).alias("piece_text"))

    rows = held.select(*_numbers(held), "has", F.size("cores").alias("n_pieces"), F.posexplode(F.transform("cores", piece)).alias("piece_no", "p"))
    return rows.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(_kept(df, tokens, text))), "piece_no", "n_pieces", F.when(F.col("has"), "tokens").otherwise("text").alias("unit"), "p.*")


def rejoined(pieces: DataFrame, key: str = "id", limits: tuple[int, int, int, int] = (MAX_PIECES, PIECE_OVERLAP, MAX_CHARS, CHAR_OVERLAP)) -> DataFrame:
    """What the pieces of each ``key`` (unique before the split) say about the split: ``key, unit, fits, follows, whole``.

    ``fits``: no piece is over its limit; ``follows``: each begins with the overlap, the same as the end of the one before;
    ``whole``: md5 of all of them joined without the overlaps, word pieces with blanks between, a NULL one as ``<null>``.
    """
    max_pieces, piece_overlap, max_chars, char_overlap = limits
    by = pieces.groupBy(quoted(key), "unit").agg(F.array_sort(F.collect_list(F.struct("piece_no", "size", "shared", "piece_tokens", "piece_text"))).alias("p"))
    tokens = F.col("unit") == "tokens"
    new_tokens = F.flatten(F.transform("p", lambda x: F.slice(x["piece_tokens"], x["shared"] + 1, F.greatest(x["size"], F.lit(1)))))
    new_text = F.array_join(F.transform("p", lambda x: F.substr(x["piece_text"], x["shared"] + 1)), "")

    def follows(x: Column, i: Column) -> Column:
        before = F.get("p", i - 1)
        same = F.when(tokens, F.slice(x["piece_tokens"], 1, piece_overlap).eqNullSafe(F.slice(before["piece_tokens"], -piece_overlap, piece_overlap))).otherwise(F.left(x["piece_text"], F.lit(char_overlap)) == F.right(before["piece_text"], F.lit(char_overlap)))
        held = F.when(tokens, F.size(x["piece_tokens"])).otherwise(F.length(x["piece_text"])) == x["size"]
        return held & (x["piece_no"] == i) & F.when(i == 0, x["shared"] == 0).otherwise((x["shared"] == F.when(tokens, piece_overlap).otherwise(char_overlap)) & same)

    fits = F.forall("p", lambda x: x["size"] <= F.when(tokens, max_pieces).otherwise(max_chars))
    return by.select(
        quoted(key), "unit", fits.alias("fits"), F.forall(F.transform("p", follows), lambda ok: ok).alias("follows"),
        F.md5(F.when(tokens, F.array_join(new_tokens, " ", "<null>")).otherwise(new_text)).alias("whole"),
    )
