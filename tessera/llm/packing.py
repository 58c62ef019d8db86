"""Packing by power-of-two decomposition.

Each document's ids, its end id among them, are cut into whole pieces of `longest` ids and then the
binary digits of the rest, longest first. A piece is a sequence by itself: pieces of equal length fill a
bucket from which equal batches are drawn, no sequence crosses documents, and as each length is a power of
two, no position is padding.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import in_batches, small_batches, text_of, work_folder, written
from .tokens import CACHE_ENTRIES, word_ids

LONGEST = 4096
#: Rows (a bucket of a part, 16 bytes) up to which the table of bases is sent to every task; beyond it is joined by shuffles.
BROADCAST_ROWS = 200_000
PIECES = "doc_id long, start long, length long, doc_tokens long, bucket int, part int, nth long, ids binary"


def piece_lengths(n: int, longest: int = LONGEST) -> list[int]:
    """Descending powers of two that sum to n."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << k for k in range(longest.bit_length() - 2, -1, -1) if rest >> k & 1]


def pack(df: DataFrame, tokenizer: str, *, id_column: str = "doc_id", text_column: str = "text", end_id: int = 2, longest: int = LONGEST, cache: int = CACHE_ENTRIES, folder: str | None = None) -> DataFrame:
    """One row per piece of every document: doc_id, start, length, doc_tokens, bucket, ids, sequence_id, offset.

    ids holds the piece's ids as little-endian unsigned 32-bit integers, bucket the base-2 logarithm of its
    length. sequence_id numbers all sequences without gaps, bucket after bucket from the longest, so a
    bucket's sequences are one range; offset is 0, as a sequence is one piece. The pieces are a table in
    `folder`, a new one in the shared folder if none is given.

    Null text counts as empty; an empty document is its end id alone. A null id stays null; repeated rows
    are packed as often as they occur. Other columns are ignored, whatever their names. An empty table
    gives no rows. Documents are read in one pass without a shuffle; a task holds one batch of texts, and a worker the ids of
    `cache` chunks (200 bytes each): fewer take less memory and more time.
    """
    if longest & (longest - 1) or longest < 1:
        raise ValueError("the longest piece must be a power of two")
    spark = df.sparkSession
    small_batches(spark)
    folder = folder or work_folder(spark, "packing")

    def cut(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, counts, ids = TaskContext.get().partitionId(), {}, word_ids(tokenizer, cache)
        end = end_id.to_bytes(4, "little")
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("bucket", pa.int32()), ("part", pa.int32()), ("nth", pa.int64()), ("ids", pa.binary())])

        def rows():
            for batch in batches:
                for doc, own in zip(batch.column(0).to_pylist(), ids.encode_batch(batch.column(1))):
                    own += end
                    n, start = len(own) // 4, 0
                    for length in piece_lengths(n, longest):
                        nth = counts[length] = counts.get(length, -1) + 1
                        yield doc, start, length, n, length.bit_length() - 1, part, nth, own[4 * start : 4 * (start + length)]
                        start += length

        yield from in_batches(rows(), schema, weigh=lambda r: 4 * r[2] + 60)

    pieces = written(df.select(F.col(id_column).cast("long").alias("doc_id"), text_of(text_column).alias("text")).mapInArrow(cut, PIECES), folder)
    # A row for each bucket and part: their running totals place the parts within a bucket, and the buckets.
    sizes = pieces.groupBy("bucket", "part").agg(F.count("*").alias("n"))
    buckets = sizes.groupBy("bucket").agg(F.sum("n").alias("n"))
    before = buckets.select("bucket", (F.sum("n").over(W.orderBy(F.desc("bucket"))) - F.col("n")).alias("bucket_base"))
    inside = sizes.select("bucket", "part", (F.sum("n").over(W.partitionBy("bucket").orderBy("part")) - F.col("n")).alias("part_base"))
    bases = written(inside.join(before, "bucket").select("bucket", "part", (F.col("bucket_base") + F.col("part_base")).alias("base")), f"{folder}-bases")
    if bases.count() <= BROADCAST_ROWS:
        bases = F.broadcast(bases)
    return pieces.join(bases, ["bucket", "part"]).select("doc_id", "start", "length", "doc_tokens", "bucket", "ids", (F.col("base") + F.col("nth")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
