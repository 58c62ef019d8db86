"""Exact dedup against a persistent digest index, with DataFrame operations only.

The index is a folder of Parquet files bucketed and sorted by digest. A batch's digests are pre-aggregated,
meet the index in a sort-merge anti-join that leaves the index where it is, and what is new is appended. An append
counts only once its batch is committed, so a batch that failed on the way can be run again and keeps the same rows.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, hadoop, keep_staying, partitions, text_of, work_folder, written

#: Files a bucket from which on ingest() compacts the index.
COMPACT_AT = 8


def digest_of(column: str = "text"):
    """SHA-256 of the text without the six white-space characters, 32 bytes; null text counts as empty."""
    return F.unhex(F.sha2(F.encode(F.translate(text_of(column), SPACES, ""), "UTF-8"), 256))


@contextmanager
def _sorted_buckets(spark: SparkSession):
    """While plans are made here, buckets of one file count as sorted, so that the index isn't sorted again."""
    key = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    was = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, was) if was is not None else spark.conf.unset(key)


class DigestIndex:
    """An index in a folder: digest, keep_id and length of the text that stays, and the number of its batch. One writer at a time.

    The folder keeps the number of buckets, fixed when it is made, so a later session opens the index by its folder
    alone. `commits` holds a name for each batch that counts, `generations` one for each compaction, whose files are
    in `files-<generation>`; `batches` holds the results of batches that were given a name.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int | None = None):
        self.spark, self.folder, self.table = spark, folder, ""
        held = self._names("buckets")
        self.buckets = int(held[0]) if held else buckets or partitions(spark)
        if not held:
            self._mark(f"buckets/{self.buckets}")
        self._open()

    def _names(self, place: str) -> list[str]:
        fs, path = hadoop(self.spark, f"{self.folder}/{place}")
        return sorted(f.getPath().getName() for f in fs.listStatus(path)) if fs.exists(path) else []

    def _mark(self, name: str) -> None:
        """Makes an empty file; fails if it exists."""
        fs, path = hadoop(self.spark, f"{self.folder}/{name}")
        fs.create(path, False).close()

    def _open(self) -> None:
        self.close()
        self.generation = max(map(int, self._names("generations")), default=0)
        self.table = self._table(self.generation)

    def _table(self, generation: int) -> str:
        name, place = f"digest_index_{uuid.uuid4().hex}", f"{self.folder}/files-{generation}"
        fs, path = hadoop(self.spark, place)
        fs.mkdirs(path)
        self.spark.sql(f"CREATE TABLE {name} (digest BINARY, keep_id BIGINT, length INT, batch BIGINT) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{place}'")
        return name

    def committed(self) -> dict[str, int]:
        """Names of the batches that count, with their numbers."""
        return {name: int(number) for number, _, name in (n.partition(".") for n in self._names("commits"))}

    def rows(self) -> DataFrame:
        """digest, keep_id, length and batch of all committed batches."""
        return self.spark.table(self.table).where(F.col("batch") <= max(self.committed().values(), default=0))

    def purge(self) -> int:
        """Deletes the files of an append that was never committed; their number."""
        self.spark.catalog.refreshTable(self.table)
        last = max(self.committed().values(), default=0)
        gone = [r[0] for r in self.spark.table(self.table).where(F.col("batch") > last).select(F.input_file_name()).distinct().collect()]  # files of one append
        for path in gone:
            fs, at = hadoop(self.spark, path)
            fs.delete(at, False)
        self.spark.catalog.refreshTable(self.table)
        return len(gone)

    def append(self, fresh: DataFrame, batch: int) -> None:
        """Adds rows (digest, keep_id, length) whose digests the index doesn't hold, one file a bucket. They count from commit() on."""
        fresh.select("digest", "keep_id", "length", F.lit(batch).cast("long").alias("batch")).repartition(self.buckets, "digest").write.insertInto(self.table)
        self.spark.catalog.refreshTable(self.table)

    def commit(self, batch: int, name: str) -> None:
        self._mark(f"commits/{batch:012d}.{name}")

    def files(self) -> int:
        """The most files that a bucket has."""
        counts: dict[str, int] = {}
        for name in self._names(f"files-{self.generation}"):
            if name.startswith("part-"):
                bucket = name.rsplit("_", 1)[-1].split(".")[0]
                counts[bucket] = counts.get(bucket, 0) + 1
        return max(counts.values(), default=0)

    def compact(self) -> None:
        """Writes all committed rows anew, one sorted file a bucket, without a shuffle; the new files count at once, the old ones go."""
        self.purge()
        old = f"{self.folder}/files-{self.generation}"
        fs, place = hadoop(self.spark, f"{self.folder}/files-{self.generation + 1}")
        fs.delete(place, True)  # of a compaction that failed
        table = self._table(self.generation + 1)
        each = self.rows().groupBy("digest").agg(F.first("keep_id").alias("keep_id"), F.first("length").alias("length"), F.first("batch").alias("batch"))
        each.write.insertInto(table)
        self.spark.sql(f"DROP TABLE {table}")
        self._mark(f"generations/{self.generation + 1}")
        self._open()
        fs.delete(hadoop(self.spark, old)[1], True)

    def close(self) -> None:
        """Forgets the table's name in this session; the files stay."""
        if self.table:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        self.table = ""


def ingest(df: DataFrame, index: DigestIndex, *, batch: str | None = None, id_column: str = "doc_id", text_column: str = "text") -> tuple[DataFrame, DataFrame]:
    """Deduplicates a batch against the index and within itself, and appends its new digests.

    Returns (rows, groups). rows has one row per row of df: doc_id, digest, text_hash (xxhash64 of the text), keep_id,
    group_size (rows of the batch with this text), kept, stays. groups has one row per digest of the batch: digest,
    keep_id, group_size, fresh (not in the index before), text_hash of the row that stays. Of equal new texts the one
    with the most code points stays, then the smallest id; a text that the index holds keeps the index's row, and none
    of the batch. Of rows that are kept under one id, those with the smallest text_hash stay.

    The index counts a batch only when groups is written and its digests are appended. A batch that failed before
    that can be run again. A `batch` name makes it so afterwards too: its results are stored beside the index, and a
    batch whose name is committed gets them, whatever df holds.

    Texts are equal when they are after deleting `[\\x20\\x09-\\x0D]`. Null text counts as empty, and all
    empty texts are equal. A null id counts as the smallest. Rows that repeat an id and text share their
    decision. Other columns are ignored; an empty table gives empty results. Texts are read once and never
    shuffled: only ids, digests, hashes and lengths are. The join of rows to groups has files on both sides, so that
    Spark splits the partition of a hot digest. Where a bucket has COMPACT_AT files, the index is compacted first.
    """
    spark = df.sparkSession
    folder = f"{index.folder}/batches/{batch}" if batch else work_folder(spark, "exact")
    if batch is None or batch not in index.committed():
        index.purge()
        if index.files() >= COMPACT_AT:
            index.compact()
        fs, place = hadoop(spark, folder)
        fs.delete(place, True)  # of an attempt that failed
        number, text = max(index.committed().values(), default=0) + 1, text_of(text_column)
        staged = written(df.select(F.col(id_column).cast("long").alias("doc_id"), digest_of(text_column).alias("digest"), F.length(text).alias("length"), F.xxhash64(text).alias("text_hash")), f"{folder}/rows")
        best = staged.groupBy("digest").agg(F.min(F.struct((-F.col("length")).alias("less"), "doc_id", "text_hash")).alias("best"), F.count("*").alias("group_size"))
        own = written(best.select("digest", F.col("best.doc_id").alias("keep_id"), (-F.col("best.less")).alias("length"), F.col("best.text_hash").alias("text_hash"), "group_size"), f"{folder}/batch")
        with _sorted_buckets(spark):
            fresh = written(new_digests(own, index), f"{folder}/fresh")
            held = own.drop("keep_id").join(index.rows().select("digest", "keep_id").hint("merge"), "digest")
            columns = "digest", "keep_id", "group_size", "text_hash"
            groups = fresh.select(*columns, F.lit(True).alias("fresh")).unionAll(held.select(*columns, F.lit(False)))
            written(groups, f"{folder}/groups")
        index.append(fresh, number)
        index.commit(number, batch or uuid.uuid4().hex)
    staged, groups = (spark.read.schema(schema).parquet(f"{folder}/{name}") for name, schema in (("rows", ROWS), ("groups", GROUPS)))
    one = groups.withColumnRenamed("text_hash", "own_hash")
    kept = F.col("fresh") & F.col("doc_id").eqNullSafe(F.col("keep_id"))
    rows = staged.join(one, "digest").select("doc_id", "digest", "text_hash", "keep_id", "group_size", kept.alias("kept"), (kept & (F.col("text_hash") == F.col("own_hash"))).alias("stays"))
    return rows, groups


ROWS = "doc_id long, digest binary, length int, text_hash long"
GROUPS = "digest binary, keep_id long, group_size long, text_hash long, fresh boolean"


def new_digests(batch: DataFrame, index: DigestIndex) -> DataFrame:
    """The rows of batch whose digests the index doesn't hold: a sort-merge anti-join that neither moves nor, compacted, sorts the index."""
    return batch.join(index.rows().select("digest").hint("merge"), "digest", "left_anti")


def keep_first(df: DataFrame, rows: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", folder: str | None = None) -> DataFrame:
    """The rows of df that stay by ingest()'s rows, with all their columns, whatever their names: one of each group of equal texts.

    Null text counts as empty, and of all empty texts one row stays. Rows that repeat an id and text are one row; null
    ids are ids like others. A table without rows gives none.
    """
    return keep_staying(df, rows, folder or work_folder(df.sparkSession, "exact-stay"), id_column=id_column, text_column=text_column)
