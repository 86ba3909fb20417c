"""Problem 5: a uniform sample of fixed size from data of unknown length that arrives in pieces.

Every record gets an independent uniform key, a seeded hash of what identifies it. Each partition keeps the k smallest
keys in a heap; heaps are merged in rounds, many into few, each keeping its k smallest, until one is left. Since a
repeated record has the same key, it counts once, and the sample does not depend on order, pieces or partitions.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexshift.tables import quoted
from lexshift.workdir import cut

#: Records in a production sample; seed; heaps that one task merges; chosen keys up to which they are broadcast to fetch their rows.
SIZE, SEED, FAN_IN, BROADCAST_KEYS = 1000, 17, 32, 100_000


def smallest(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The rows with the k smallest different values of the first column, one row each; at most k rows are held."""
    heap: list[_Down] = []
    kept: dict[str, pa.RecordBatch] = {}
    for b in batches:
        new: dict[str, int] = {}
        bound = heap[0].key if len(heap) >= k else None
        if bound is not None:
            b = b.filter(pc.less(b.column(0), bound))  # all but few rows end here
        for i, key in enumerate(b.column(0).to_pylist()):
            if (bound is not None and key >= bound) or key in kept or key in new:
                continue
            new[key] = i
            heapq.heappush(heap, _Down(key))
            if len(heap) > k:
                out = heapq.heappop(heap).key
                (new if out in new else kept).pop(out)
            if len(heap) >= k:
                bound = heap[0].key
        own = b.take(pa.array(list(new.values()), pa.int64()))  # a copy, so that the batch can be freed
        kept |= {key: own.slice(j, 1) for j, key in enumerate(new)}
    if kept:
        yield from pa.Table.from_batches(list(kept.values())).combine_chunks().to_batches()


class _Down:
    """Orders keys downwards, for a heap whose top is the largest."""

    __slots__ = ("key",)

    def __init__(self, key: str) -> None:
        self.key = key

    def __lt__(self, other: _Down) -> bool:
        return other.key < self.key


def uniform_sample(df: DataFrame, identity: list[str], k: int = SIZE, seed: int = SEED, fan_in: int = FAN_IN) -> DataFrame:
    """Exactly k different records of ``df`` (all, if there are fewer), with all its columns and ``sample_key``.

    A record is what the columns ``identity`` say: rows that agree in them are one record, whatever row comes out.
    Records with a NULL in ``identity`` are records too; NULL differs from the empty string. An empty table gives an
    empty sample. A column ``sample_key`` of ``df`` gives way to the new one.
    """
    if k < 1 or fan_in < 2:
        raise ValueError("k must be 1 and fan_in 2 at least")
    parts = [F.coalesce(F.concat(F.lit("="), F.col(quoted(c)).cast("string")), F.lit("!")) for c in identity]
    rest = [quoted(c) for c in df.columns if c.lower() != "sample_key"]
    keyed = df.select(F.md5(F.concat_ws("|", F.lit(str(seed)), *parts)).alias("sample_key"), *rest)
    chosen = merge_samples(keyed.select("sample_key"), k, fan_in)  # only keys go through the heaps
    chosen = F.broadcast(chosen) if k <= BROADCAST_KEYS else chosen  # k rows at most
    return keyed.join(chosen, "sample_key", "left_semi").dropDuplicates(["sample_key"])


def merge_samples(keyed: DataFrame, k: int = SIZE, fan_in: int = FAN_IN) -> DataFrame:
    """The k smallest ``sample_key`` (the first column) of rows keyed before, such as the samples of earlier pieces."""
    shape = keyed.schema

    def heaps(df: DataFrame) -> DataFrame:
        return df.mapInArrow(lambda b: smallest(b, k), shape)

    kept, parts = heaps(keyed), keyed.rdd.getNumPartitions()
    while parts > fan_in:
        parts = -(-parts // fan_in)
        kept = heaps(cut(kept).repartition(parts, F.col("sample_key")))
    return heaps(kept.repartition(1))
