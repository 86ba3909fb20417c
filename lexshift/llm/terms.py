"""Problem 2: frequency of every distinct term, by recursive radix spilling.

Every map task counts the terms of its records first. The partial counts go to disk partitioned by the leading bits of
the terms' hash. The task of a partition sums what it gets, spills it by the next bits into the shared folder where it
exceeds its memory, splits parts that are still too large by further bits, and aggregates each part with DuckDB. A part is
bounded in rows and bytes, so DuckDB's memory suffices; what is out of core are the parts. A part of one hash is summed as
it is read and never split.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.ipc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexshift.tables import one_per_key
from lexshift.workdir import shared_base

#: Rows and bytes of partial counts that a part may hold to be aggregated at once; bits of each further split; rows counted before a map task compacts.
PART_ROWS, PART_BYTES, SPLIT_BITS, COMPACT_ROWS = 1_000_000, 64_000_000, 4, 500_000
#: Schemes of file systems as Spark writes them and as Arrow does.
SCHEMES = {"s3a": "s3", "s3n": "s3", "wasbs": "abfss", "wasb": "abfs"}
#: Marks: fewer occurrences or records are rare; a larger share of records, in percent, is common.
MIN_COUNT, MIN_RECORDS, COMMON_PERCENT = 20, 5, 30


def counted(batch: pa.Array) -> pa.Table:
    """Occurrences and records of every term in a batch of token lists, each list being a record of its own."""
    flat = pc.replace_substring(batch.flatten().cast(pa.string()), "##", "")
    row = pc.list_parent_indices(batch).to_numpy(zero_copy_only=False)
    known = pc.is_valid(flat).to_numpy(zero_copy_only=False)
    coded = flat.dictionary_encode()
    code = coded.indices.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)[known]
    size = max(1, len(coded.dictionary))
    once = np.unique(row[known].astype(np.int64) * size + code) % size
    return pa.table({"term": coded.dictionary, "n": np.bincount(code, minlength=len(coded.dictionary)).astype(np.int64), "r": np.bincount(once, minlength=len(coded.dictionary)).astype(np.int64)})


def _summed(tables: list[pa.Table]) -> pa.Table:
    t = pa.concat_tables(tables).group_by("term").aggregate([("n", "sum"), ("r", "sum")])
    return t.select(["term", "n_sum", "r_sum"]).rename_columns(["term", "n", "r"])


def partial_counts(batches: Iterator[pa.RecordBatch], compact: int = COMPACT_ROWS) -> Iterator[pa.RecordBatch]:
    """Counts of one map task; compacted as it goes, and passed on early where compacting does not help."""
    held: list[pa.Table] = []
    rows = 0
    for b in batches:
        if b.num_rows:
            held.append(counted(b.column(0)))
            rows += held[-1].num_rows
        if rows > compact:
            held = [_summed(held)]
            if (rows := held[0].num_rows) > compact:
                yield from held[0].combine_chunks().to_batches()
                held, rows = [], 0
    if held:
        yield from _summed(held).combine_chunks().to_batches()


def _duck(part: pa.Table, scratch: str) -> Iterator[pa.RecordBatch]:
    """Sums by term of a part of bounded size; where ``scratch`` is a mounted folder, DuckDB can spill there too."""
    import duckdb

    con = duckdb.connect(config={"memory_limit": "400MB", "threads": "1", "temp_directory": scratch, "preserve_insertion_order": "false"})
    try:
        yield from con.sql("SELECT term, sum(n)::BIGINT AS n, sum(r)::BIGINT AS r FROM part GROUP BY term").to_arrow_reader(100_000)
    finally:
        con.close()


def file_system(path: str) -> tuple[pa.fs.FileSystem, str]:
    """Arrow's file system for a path as Spark writes it, and the path within."""
    scheme, mark, rest = path.partition("://")
    if scheme.startswith("dbfs:"):
        return pa.fs.LocalFileSystem(), "/dbfs" + path.removeprefix("dbfs:")
    return pa.fs.FileSystem.from_uri(SCHEMES.get(scheme, scheme) + mark + rest)


def radix_aggregate(batches: Iterator[pa.RecordBatch], scratch: str, used_bits: int, part_rows: int = PART_ROWS, bits: int = SPLIT_BITS, part_bytes: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """Sum partial counts (h, term, n, r) whose hashes ``h`` agree in the first ``used_bits``; output term, n, r.

    scratch: a path in the shared folder, made when needed and removed at the end; a repeated task uses another.
    """
    fs, base = file_system(scratch)
    base = f"{base}-{uuid.uuid4().hex}"
    try:
        yield from _level(batches, fs, base, used_bits, part_rows, bits, part_bytes)
    finally:
        if fs.get_file_info(base).type != pa.fs.FileType.NotFound:
            fs.delete_dir(base)


def _compact(held: list[pa.RecordBatch]) -> pa.Table:
    """One row a term."""
    t = pa.Table.from_batches(held).group_by(["h", "term"]).aggregate([("n", "sum"), ("r", "sum")])
    return t.select(["h", "term", "n_sum", "r_sum"]).rename_columns(["h", "term", "n", "r"])


def _level(batches: Iterator[pa.RecordBatch], fs: pa.fs.FileSystem, base: str, used: int, most: int, bits: int, most_bytes: int) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    rows = size = 0
    writers: dict[int, pa.ipc.RecordBatchFileWriter] = {}

    def spill(t: pa.Table) -> None:
        fs.create_dir(base, recursive=True)
        part = (t.column("h").to_numpy().astype(np.uint64) << np.uint64(used)) >> np.uint64(64 - bits)
        order = np.argsort(part, kind="stable")
        t, part = t.take(order), part[order]
        for p in np.unique(part):
            a, b = np.searchsorted(part, [p, p + np.uint64(1)])
            if int(p) not in writers:
                writers[int(p)] = pa.ipc.new_stream(fs.open_output_stream(f"{base}/{int(p)}"), t.schema)
            writers[int(p)].write_table(t.slice(a, b - a))

    for b in batches:
        held.append(b)
        rows, size = rows + b.num_rows, size + b.nbytes
        if rows > most or size > most_bytes:
            t = _compact(held)
            # what summing has halved stays; so do rows of one hash, and those whose bits are used up
            if (t.num_rows > most // 2 or t.nbytes > most_bytes // 2) and used + bits <= 64 and pc.count_distinct(t.column("h")).as_py() > 1:
                spill(t)
                t = t.slice(0, 0)
            held = t.combine_chunks().to_batches()
            rows, size = t.num_rows, sum(x.nbytes for x in held)
    if not writers:
        if rows:
            mounted = isinstance(fs, pa.fs.LocalFileSystem)
            yield from _duck(pa.Table.from_batches(held).select(["term", "n", "r"]), f"{base}/duck" if mounted else "")
        return
    if rows:
        spill(_compact(held))
    for w in writers.values():
        w.close()
    for p in writers:
        with pa.ipc.open_stream(fs.open_input_stream(f"{base}/{p}")) as part:
            yield from _level(iter(part), fs, f"{base}/{p}-", used + bits, most, bits, most_bytes)
        fs.delete_file(f"{base}/{p}")


def term_counts(df: DataFrame, tokens: str = "tokens", part_rows: int = PART_ROWS) -> DataFrame:
    """``term, occurrences, records`` of every distinct entry of the list column ``tokens`` without ``##``.

    Each row is a record. NULL lists and NULL entries count nothing, an empty string is a term like any other, very
    long lists are counted whole; an empty table gives no rows. Other columns are not read.
    """
    spark = df.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    used = min(32, math.ceil(math.log2(max(2, partitions))) + 4)
    scratch = f"{shared_base(spark)}/radix"
    lists = df.select(F.col(f"`{tokens}`").alias("tokens")).where("tokens IS NOT NULL")
    partial = lists.mapInArrow(partial_counts, "term string, n bigint, r bigint").select(F.xxhash64("term").alias("h"), "term", "n", "r")
    radix = partial.repartition(partitions, F.shiftrightunsigned("h", 64 - used))
    return radix.mapInArrow(lambda b: radix_aggregate(b, scratch, used, part_rows), "term string, occurrences bigint, records bigint")


def marked(counts: DataFrame, records: int, min_count: int = MIN_COUNT, min_records: int = MIN_RECORDS, common_percent: int = COMMON_PERCENT) -> DataFrame:
    """``counts`` with ``mark``: rare, common, or NULL for terms that can be scored."""
    rare = (F.col("occurrences") < min_count) | (F.col("records") < min_records)
    return counts.withColumn("mark", F.when(rare, "rare").when(F.col("records") * 100 > common_percent * records, "common"))


def corpus_terms(df: DataFrame) -> DataFrame:
    """Marked counts of coha_tokens; repeated rows of one id count once."""
    rows = df.select("id", "tokens").where("tokens IS NOT NULL")
    return marked(term_counts(one_per_key(rows, "id")), rows.select("id").distinct().count())
