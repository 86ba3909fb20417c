"""Problem 6: filling containers of fixed capacity with whole items, by bulk-synchronous best fit.

Items go in by classes of halving size, largest first. A class takes two supersteps. In the first, items and the gaps
of open containers are range-sorted along one axis into blocks, and every block is swept on its own: each item, from
the largest, takes its successor, the smallest gap that holds it. In the second, the items and gaps left over are cut
into blocks by their ranks, so that conflicts at the bounds of the first blocks are resolved, and swept again; what
finds no gap there opens containers. After each superstep the gaps are updated, and the next class begins.

Block bounds come from a histogram of sizes, which has at most as many rows as the capacity; a size that many items
share is spread over several blocks. How many blocks there are depends on the rows only, never on settings of the session.
What fits one block takes one superstep. The state between supersteps is written to the shared folder.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexshift.workdir import cut

#: Tokens of a container; items of a block at most; where the public tokenizers' files are, and the one that measures.
CAPACITY, BLOCK_ITEMS = 2048, 10_000
TOKENIZERS, VOCABULARY = "/opt/tokenizers", "byte_bpe_50k.tiktoken"
#: Fixed value: the pattern by which that public vocabulary's text is cut before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Below this size all items are one class.
LEAST_CLASS = 32


@lru_cache(maxsize=2)
def _encoding(path: str):  # noqa: ANN202
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, path: str = f"{TOKENIZERS}/{VOCABULARY}") -> Column:
    """Tokens of a public tokenizer; NULL for NULL."""

    @F.pandas_udf("bigint")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = _encoding(path).encode_ordinary
        for s in texts:
            yield s.map(lambda t: None if t is None else len(encode(t))).astype("Int64")

    return run(text)


class Gaps:
    """Open containers by the size of their gap; finds the smallest that holds a size."""

    def __init__(self) -> None:
        self.by: dict[int, list[str]] = {}
        self.there = 0

    def add(self, gap: int, container: str) -> None:
        if gap > 0:
            self.by.setdefault(gap, []).append(container)
            self.there |= 1 << gap

    def take(self, size: int) -> tuple[int, str] | None:
        large = self.there >> size
        if not large:
            return None
        gap = size + (large & -large).bit_length() - 1
        container = self.by[gap].pop()
        if not self.by[gap]:
            self.there ^= 1 << gap
        return gap, container


def sweep(rows: pa.Table, capacity: int, may_open: bool) -> pa.Table:
    """Best fit over one block. rows: kind (0 item, 1 gap), id, size; the result also has kind 2, items in a container."""
    order = rows.sort_by([("size", "descending"), ("id", "ascending")])
    kinds, ids, sizes = (order.column(c).to_pylist() for c in ("kind", "id", "size"))
    gaps = Gaps()
    for k, i, s in zip(kinds, ids, sizes, strict=True):
        if k == 1:
            gaps.add(s, i)
    out: list[tuple[int, str, int, str | None]] = []
    for k, i, s in zip(kinds, ids, sizes, strict=True):
        if k:
            continue
        if (found := gaps.take(s)) is None:
            if not may_open:
                out.append((0, i, s, None))
                continue
            found = capacity, i
        out.append((2, i, s, found[1]))
        gaps.add(found[0] - s, found[1])
    out += [(1, c, g, None) for g, cs in gaps.by.items() for c in cs]
    k, i, s, c = zip(*out, strict=True) if out else ((), (), (), ())
    return pa.table({"kind": pa.array(k, pa.int32()), "id": pa.array(i, pa.string()), "size": pa.array(s, pa.int32()), "container": pa.array(c, pa.string())})


def _blocks(histogram: dict[int, int], count: int, spread_from: int | None = None) -> Column:
    """The block of a row by its size: equal shares of the histogram, the largest sizes first; a size that fills several is spread."""
    total = max(1, sum(histogram.values()))
    first, width, seen = [], [], 0
    low, high = min(histogram, default=0), max(histogram, default=0)
    for s in range(high, low - 1, -1):
        a = min(count - 1, seen * count // total)
        seen += histogram.get(s, 0)
        first.append(a)
        width.append(max(1, min(count - 1, (seen - 1) * count // total) - a + 1 if histogram.get(s) else 1))
    at = F.lit(high) - F.least(F.greatest(F.col("size"), F.lit(low)), F.lit(high))
    of = lambda values: F.element_at(F.lit(values), at + 1)
    block = of(first) + F.pmod(F.xxhash64("id"), of(width)).cast("int")
    if spread_from is not None:  # gaps that hold any item of the class
        block = F.when((F.col("kind") == 1) & (F.col("size") >= spread_from), F.pmod(F.xxhash64("id"), F.lit(count)).cast("int")).otherwise(block)
    return block


def _swept(rows: DataFrame, block: Column, capacity: int, may_open: bool) -> DataFrame:
    grouped = rows.select(block.alias("block"), "kind", "id", "size").groupBy("block")
    return cut(grouped.applyInArrow(lambda t: sweep(t, capacity, may_open), "kind int, id string, size int, container string"))


def _histogram(rows: DataFrame) -> dict[int, dict[int, int]]:
    """Rows by kind and size: for each kind at most as many entries as the capacity."""
    out: dict[int, dict[int, int]] = {0: {}, 1: {}}
    for r in rows.groupBy("kind", "size").count().collect():
        out.setdefault(r["kind"], {})[r["size"]] = r["count"]
    return out


def pack(items: DataFrame, capacity: int = CAPACITY, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """``id, size, container``: each item (``id`` string, unique; ``size`` from 1 to ``capacity``) in one container.

    Rows of another size raise, as they fit no container. The sizes of a container sum up to the capacity at most. A container has the id of the item that opened it.
    An empty table gives no rows. The result does not depend on the order or partitions of the rows, nor on settings.
    """
    todo = items.select(F.lit(0).alias("kind"), F.col("id").cast("string").alias("id"), F.col("size").cast("int").alias("size"))
    sizes = _histogram(todo)[0]
    if sizes and not (0 < min(sizes) and max(sizes) <= capacity):
        raise ValueError(f"sizes must be from 1 to {capacity}")
    placed = [todo.where(F.col("size") * 2 > capacity).select("id", "size", F.col("id").alias("container"))]
    opened = todo.where((F.col("size") * 2 > capacity) & (F.col("size") < capacity)).select(F.lit(1).alias("kind"), "id", (F.lit(capacity) - F.col("size")).alias("size"))
    gaps = {capacity - s: n for s, n in sizes.items() if s * 2 > capacity and s < capacity}

    def rows(items: dict[int, int], held: dict[int, int], low: int) -> int:
        return sum(items.values()) + sum(n for s, n in held.items() if s > low)

    high = capacity // 2
    while high > 0:
        low = 0 if high <= LEAST_CLASS else high // 2
        if rows({s: n for s, n in sizes.items() if s <= high}, gaps, 0) <= block_items:
            low = 0  # all that is left fits one block, and so takes one sweep
        own = {s: n for s, n in sizes.items() if low < s <= high}
        if own:
            count = -(-rows(own, gaps, low) // block_items)
            out = _swept(todo.where((F.col("size") > low) & (F.col("size") <= high)).unionByName(opened.where(F.col("size") > low)), _blocks(own, count, high), capacity, count == 1)
            states = [out]
            waiting = opened.where(F.col("size") <= low)
            if count > 1:
                left = _histogram(out)
                if left[0]:
                    wide = {s: n for s, n in left[1].items() if s > low}
                    rest = out.where("kind = 0").unionByName(out.where((F.col("kind") == 1) & (F.col("size") > low)))
                    count = -(-rows(left[0], wide, low) // block_items)
                    block = F.when(F.col("kind") == 0, _blocks(left[0], count)).otherwise(_blocks(wide, count) if wide else F.lit(0))
                    waiting = waiting.unionByName(out.where((F.col("kind") == 1) & (F.col("size") <= low)).select("kind", "id", "size"))
                    states.append(_swept(rest.select("kind", "id", "size"), block, capacity, True))
            placed += [s.where("kind = 2").select("id", "size", "container") for s in states]
            if low:
                opened = cut(waiting.unionByName(states[-1].where("kind = 1").select("kind", "id", "size")))
                gaps = _histogram(opened)[1]
        high = low
    result = placed[0]
    for p in placed[1:]:
        result = result.unionByName(p)
    return result


def packed_documents(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, tokenizer: str = f"{TOKENIZERS}/{VOCABULARY}") -> DataFrame:
    """``doc_id, piece_no, first_token, n_tokens, container, position``: where the tokens of each document go.

    A document stays whole unless it alone is over the capacity; then it is cut into full containers and a rest, which
    is packed like other items. Rows repeated under one id count once, the one with most tokens. NULL and empty texts have no tokens: they come
    out with ``n_tokens`` 0 and no container. An empty table gives no rows; only the named columns are read.
    """
    rows = documents.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    measured = cut(rows.select("doc_id", F.coalesce(token_count(F.col("text"), tokenizer), F.lit(0)).alias("n")).groupBy("doc_id").agg(F.max("n").alias("n")))
    pieces = measured.select("doc_id", F.explode(F.expr(f"sequence(0, cast(greatest(n - 1, 0) div {capacity} as int))")).alias("piece_no"), "n").select("doc_id", "piece_no", (F.col("piece_no") * F.lit(capacity).cast("bigint")).alias("first_token"), F.least(F.lit(capacity), F.col("n") - F.col("piece_no") * capacity).cast("int").alias("n_tokens"), F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "piece_no").alias("id"))
    inside = pack(pieces.where("n_tokens > 0").select("id", F.col("n_tokens").alias("size")), capacity).select("id", "container")
    before = F.sum("n_tokens").over(Window.partitionBy("container").orderBy(F.desc("n_tokens"), "id").rowsBetween(Window.unboundedPreceding, -1))
    full = pieces.where("n_tokens > 0").join(inside, "id").withColumn("position", F.coalesce(before, F.lit(0)).cast("int"))
    names = ["doc_id", "piece_no", "first_token", "n_tokens", "container", "position"]
    none = pieces.where("n_tokens = 0").select(*names[:4], F.lit(None).cast("string").alias("container"), F.lit(None).cast("int").alias("position"))
    return full.select(*names).unionByName(none)


def faults(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row about the result of ``packed_documents``: ``documents``, and counts of what must not be.

    ``overfull`` containers; ``untiled`` ones, where positions leave holes or overlap; ``cut_needlessly``, documents in more
    pieces than their size asks for; ``wasteful``, whether the containers are over 1 % more (and one) than full ones would be.
    """
    packed = cut(packed)
    boxes = packed.where("container IS NOT NULL").groupBy("container").agg(F.sum("n_tokens").alias("size"), F.max(F.col("position") + F.col("n_tokens")).alias("end"))
    docs = packed.groupBy("doc_id").agg(F.sum("n_tokens").alias("size"), F.count("*").alias("pieces"), F.max(F.col("first_token") + F.col("n_tokens")).alias("end"))
    of_boxes = boxes.agg(F.count_if(F.col("size") > capacity).alias("overfull"), F.count_if(F.col("size") != F.col("end")).alias("untiled"), (F.count("*") > F.ceil(F.coalesce(F.sum("size"), F.lit(0)) / capacity) * 1.01 + 1).alias("wasteful"))
    of_docs = docs.agg(F.count("*").alias("documents"), F.count_if((F.col("pieces") > F.greatest(F.ceil(F.col("size") / capacity), F.lit(1))) | (F.col("size") != F.col("end"))).alias("cut_needlessly"))
    both = of_docs.unionByName(of_boxes, allowMissingColumns=True)  # one row each
    return both.agg(*(F.max(c).alias(c) for c in ("documents", "overfull", "untiled", "cut_needlessly", "wasteful")))
