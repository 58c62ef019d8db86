"""Shared folders, file access and small helpers of the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.folders import hadoop, release, shared_folder, work_folder  # noqa: F401
from tessera.plans.spread import BATCH_BYTES, BATCH_ROWS, small_batches  # noqa: F401

#: The six characters of ``[\x20\x09-\x0D]``, the only white space of the text contracts.
SPACES = " \t\n\x0b\x0c\r"

def written(df: DataFrame, folder: str, codec: str = "zstd") -> DataFrame:
    """df written as Parquet and read back: lineage ends in files that outlive executors."""
    df.write.option("compression", codec).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def planned_bytes(df: DataFrame, column: str) -> int:
    """Bytes of what a table is made from, by the planner's sizes of its sources; where one is unknown, those of the column, counted."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    total = sum(int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()))
    if total < 1 << 60:
        return total
    return df.agg(F.sum(F.octet_length(text_of(column)).cast("long"))).first()[0] or 0


def files_at(uri: str):
    """(Arrow file system, path) for an executor's range reads and writes below the shared folder."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


_CACHES: list[dict] = []


def claim(cache: dict) -> dict:
    """The cache, now this worker's only one: Spark reuses workers, so what earlier operators cached would stay beside it."""
    if not any(c is cache for c in _CACHES):
        _CACHES.append(cache)
    others = [c for c in _CACHES if c is not cache and c]
    for other in others:
        other.clear()
    if others:
        give_back()
    return cache


def give_back() -> None:
    """Returns freed memory to the system, where the C library can: a worker's heap would keep what an earlier operator has used."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def text_of(column: str = "text"):
    """The column with null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


#: Rows of 20 bytes or so up to which a table is sent to every task; beyond, it is joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Bits of a map() at most: 128 MB when sent.
MAP_BITS = 1 << 30


def sieved(df: DataFrame, key: str, wanted: DataFrame, n: int) -> DataFrame:
    """df with `maybe`, false only where its key (null among them) isn't one of the n rows of `wanted` (one column).

    A bit map that every task gets, with 16 bits or more a wanted key, which lets one other key in 16 pass; beyond
    MAP_BITS bits it doesn't grow and lets more pass, so what follows must tell them apart.
    """
    bits = min(MAP_BITS, 1 << max(20, (16 * n - 1).bit_length()))
    place = F.pmod(F.xxhash64(key), F.lit(bits)) + 1
    parts = wanted.select((F.pmod(F.xxhash64(wanted.columns[0]), F.lit(bits)) + 1).alias("bit"))
    parts = parts.groupBy(F.bitmap_bucket_number("bit").alias("_part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("_map"))
    found = df.withColumn("_bit", place).join(F.broadcast(parts), F.bitmap_bucket_number("_bit") == F.col("_part"), "left")
    byte = F.conv(F.hex(F.expr("substring(_map, cast(bitmap_bit_position(_bit) div 8 as int) + 1, 1)")), 16, 10).cast("int")
    hit = F.getbit(byte, (F.bitmap_bit_position("_bit") % 8).cast("int")) == 1
    return found.select(*df.columns, F.coalesce(hit, F.lit(False)).alias("maybe"))


def least_hashed(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """The n rows with the least hashes of their keys, which must be distinct.

    Rows are counted first, and only those below the hash that some more than n are expected below are sorted, so that
    what meets in one task doesn't grow with the number of tasks. (Fewer than n are left with a probability of 1e-9 or less.)
    """
    own = F.xxhash64(key, F.lit(seed))
    total = rows.count()
    some = n + 6 * n**0.5 + 100
    if some < total:
        rows = rows.where(own <= F.lit(int(-(2**63) + some / total * 2**64)))
    return rows.orderBy(own, key).limit(n)


def _looked_up(df: DataFrame, told: DataFrame, n: int, id_column: str, own_hash) -> DataFrame:
    """df's rows as one struct `whole`, with own_id and own_hash, and the columns of the n rows of told (told_id, told_hash, ...) that have both; null where none has.

    told goes to every task if it is few, counted rows, so that texts stay where they are; else texts are shuffled once, by id
    and hash, which no hot text shares.
    """
    whole = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("whole"), F.col(id_column).cast("long").alias("own_id"), own_hash.alias("own_hash"))
    told = F.broadcast(told) if n <= BROADCAST_ROWS else told.hint("merge")
    return whole.join(told, F.col("own_id").eqNullSafe(F.col("told_id")) & (F.col("own_hash") == F.col("told_hash")), "left")


def keep_staying(df: DataFrame, decisions: DataFrame, folder: str, *, id_column: str, text_column: str) -> DataFrame:
    """The rows of df that decisions (doc_id, text_hash, stays; a row for each of df's) let stay, with all their columns.

    text_hash is xxhash64 of the text, null counting as empty. Rows that repeat an id and a text are one row. Only
    what goes or repeats is looked up.
    """
    told = decisions.groupBy("doc_id", "text_hash").agg(F.bool_or("stays").alias("stays"), F.count("*").alias("n")).where("not stays or n > 1")
    told = written(told.select(F.col("doc_id").alias("told_id"), F.col("text_hash").alias("told_hash"), "stays"), folder)
    n, repeats = told.agg(F.count("*"), F.count_if("stays")).first()
    marked = _looked_up(df, told, n, id_column, F.xxhash64(text_of(text_column)))
    out = marked.where("stays is null").select("whole.*")
    return out.unionAll(marked.where("stays").dropDuplicates(["own_id", "own_hash"]).select("whole.*")) if repeats else out


def leave_out(df: DataFrame, gone: DataFrame, folder: str, *, id_column: str, own_hash) -> DataFrame:
    """The rows of df but those of gone (an id, and a hash that own_hash, a column of df, gives too), with all their columns; repeats go or stay together."""
    told = written(gone.toDF("told_id", "told_hash").distinct().withColumn("gone", F.lit(True)), folder)
    return _looked_up(df, told, told.count(), id_column, own_hash).where("gone is null").select("whole.*")


def in_batches(rows: Iterator[tuple], schema, most_rows: int = 4096, most_bytes: int = 8 << 20, weigh=None) -> Iterator:
    """Arrow batches of a schema from tuples, ended by rows or by bytes (weigh(row))."""
    import pyarrow as pa

    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += weigh(row) if weigh else 0
        if len(held) >= most_rows or size >= most_bytes:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], schema=schema)
