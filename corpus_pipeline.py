"""The corpus pipeline: quality, toxicity, exact dedup, near dedup, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and returns a
DataFrame, which is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import exact_dedup, near_dedup, packing, quality, toxicity
from tessera.llm.common import work_folder, written


#: Chunks that a worker of the last stage caches: its executors' memory is what the stages before have grown it to.
CACHE = 400_000


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained views find good enough.

    A row is decided by its own text and metadata: null and empty texts by a feature of their own, very long ones as a
    whole, equal rows alike. Null labels and ids are no labels; without labels all rows stay. Further columns stay as
    they are, whatever their names. No rows give none.
    """
    return quality.keep_good(docs, _labels(spark, sf_dir))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain doesn't find toxic.

    A row is decided by its whole text: null and empty ones have no features and get the prior, equal ones the same
    verdict. Null labels and ids are no labels; without labels all rows stay. Further columns stay as they are, whatever
    their names. No rows give none.
    """
    return toxicity.keep_clean(docs, _labels(spark, sf_dir))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal without white space.

    The one with the most code points stays, then the smallest id, a null one before others. Null, empty and blank texts
    are one group. Rows that repeat an id and a text are one row. Further columns stay as they are, whatever their names.
    No rows give none.
    """
    index = exact_dedup.DigestIndex(spark, work_folder(spark, "index"))
    rows, _ = exact_dedup.ingest(docs, index)
    index.close()
    return exact_dedup.keep_first(docs, rows)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of documents that share 80 percent of their 5-word shingles.

    The one with the smallest id stays, null only where a component has no other. Texts without words are near nothing and
    stay. Rows that repeat an id and a text are one row. Very long texts count as a whole. Further columns stay as they
    are, whatever their names. No rows give none.
    """
    return near_dedup.keep_first(docs, near_dedup.near_duplicates(docs, words=5, percent=80))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Power-of-two pieces of all documents that are left, with digests of their ids.

    Null text counts as empty, a piece of the end id alone. Null ids stay null, repeated rows are packed as often as they
    occur, further columns are ignored, and no rows give none.
    """
    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), cache=CACHE)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


STAGES = [("quality", keep_good), ("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("packing", pack)]

#: Two stages are fitted models, so SQL can't express run()'s rows; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = work_folder(spark, "pipeline")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"{folder}/{name}")
    return docs
