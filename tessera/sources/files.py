"""Whole files as rows, by Spark's own readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_files(spark: SparkSession, path: str, recursive: bool = False, glob: str | None = None) -> DataFrame:
    """path, modificationTime, length and content of the files at a path."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def sample_files(files: DataFrame, most: int | None = None, single: str | None = None) -> DataFrame:
    """The first files by name, or one by its name."""
    name = F.substring_index("path", "/", -1)
    if single:
        return files.where(name == single)
    ordered = files.orderBy("path")
    return ordered.limit(most) if most else ordered


def dictionary_of(spark: SparkSession, path: str) -> bytes:
    """The last 64 KB of a dictionary file; a bounded value, so it goes along with the functions that use it."""
    row = read_files(spark, path).select(F.expr("substring(content, greatest(1, length - 65535), 65536)").alias("d")).first()
    return bytes(row["d"]) if row else b""


def dictionary_from(df: DataFrame, column: str, order: str) -> bytes:
    """The last 64 KB of a column's texts joined by line feeds in an order. The driver reads rows from the end until they are full."""
    cell = F.encode(F.coalesce(F.col(column), F.lit("")), "UTF-8")
    held: list[bytes] = []
    size = 0
    for row in df.orderBy(F.desc(order)).limit(65536).select(cell.alias("c")).toLocalIterator():  # a text takes a line feed at least
        held.append(bytes(row["c"])[-65536:])
        size += len(held[-1]) + 1
        if size > 65536:
            break
    return b"\n".join(reversed(held))[-65536:]


def read_results(spark: SparkSession, path: str, numeric: list[str]) -> DataFrame:
    """A CSV of results: NA, N/A and empty cells are null, numbers that can't be read too."""
    df = spark.read.option("header", True).csv(path)
    for c in df.columns:
        blank = F.col(c).isin("NA", "N/A", "")
        df = df.withColumn(c, F.when(blank, None).otherwise(F.col(c)) if c not in numeric else F.when(~blank, F.col(c)).try_cast("double"))
    return df


def write_results(df: DataFrame, path: str, fields: list[str] | None = None) -> None:
    """Writes rows as CSV with a header, the named fields in order; a field that df lacks, and nulls, are empty cells. read_results reads them back."""
    named = [F.col(f"`{c}`") if c in df.columns else F.lit(None).cast("string").alias(c) for c in fields or df.columns]
    df.select(*named).write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def generated(spark: SparkSession, rows: int, size: int, matches: float = 0.5, seed: int = 0, kind: str = "noise") -> DataFrame:
    """row_id and data of seeded compressible noise, or of words; each row's seed is seed + row_id, so any partitioning gives the same rows."""
    from tessera.kernels import generators

    def run(batches):
        for batch in batches:
            make = (lambda s: generators.noise(size, s, matches)) if kind == "noise" else (lambda s: generators.words(size, s).encode())
            yield batch.assign(data=[make(seed + int(i)) for i in batch["row_id"]])

    return spark.range(rows).withColumnRenamed("id", "row_id").mapInPandas(run, "row_id long, data binary")
