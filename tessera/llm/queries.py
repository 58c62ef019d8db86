"""The registered queries of the corpus operators, thin over the operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, exact_dedup, media, near_dedup, packing, quality, sharding, token_files, toxicity, warc
from .common import text_of, work_folder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Power-of-two pieces of all documents, with a digest of each piece's ids."""
    pieces = packing.pack(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's position and digest, read back from the token files."""
    back = token_files.token_files(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))
    return back.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities of the chain's categories for all documents, and the verdict."""
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities of both views and of their combination for all documents, and the verdict."""
    return quality.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, read back from the packages."""
    return warc.archive(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every text's ids and of their decoding."""
    options = _tokenizer("byte_bpe_multi_50k.tiktoken"), _pattern()
    back = byte_bpe.decode(byte_bpe.encode(_table(spark, sf_dir, "documents"), *options), *options)
    return back.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's group of equal texts, by a digest index that starts empty."""
    index = exact_dedup.DigestIndex(spark, work_folder(spark, "index"))
    rows, _ = exact_dedup.ingest(_table(spark, sf_dir, "documents"), index)
    index.close()
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP7_SQL = """
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS len,
         sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256
  FROM documents),
k AS (
  SELECT *, row_number() OVER (PARTITION BY text_sha256 ORDER BY len DESC, doc_id) AS place,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM n),
f AS (SELECT text_sha256, doc_id AS keep_id FROM k WHERE place = 1)
SELECT k.doc_id, f.keep_id, k.group_size, k.doc_id = f.keep_id AS kept, k.text_sha256
FROM k JOIN f USING (text_sha256)
"""


#: Arrivals that the sharding query deals documents to.
ARRIVALS = 8


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, read through the manifest after their arrivals were appended and compacted."""
    store = sharding.ShardStore(spark, work_folder(spark, "shards"))
    store.append(_table(spark, sf_dir, "documents"), arrival=F.pmod(F.xxhash64("doc_id"), F.lit(ARRIVALS)))
    store.compact()
    store.vacuum()
    return store.read().select("doc_id", "lang", "source", "n_chars", F.sha2(F.encode(text_of(), "UTF-8"), 256).alias("text_sha256"))


OP8_SQL = "SELECT doc_id, lang, source, n_chars, sha256(coalesce(text, '')) AS text_sha256 FROM documents"


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share 85 percent of their 3-word shingles."""
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), words=3, percent=85).select("doc_id", "n_shingles", "component_id", "kept")


def op10_avi_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as motion JPEG and read back: digests, and its shots in seconds."""
    back = media.read_media(media.to_media(_table(spark, sf_dir, "documents")))
    cuts = F.concat_ws(",", F.transform(media.timed(), lambda clip: F.format_string("%.2f", clip["start_s"])))
    return back.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -32, 32)")).alias("tail_crc32"), "media_bytes", "media_sha256",
        F.concat(F.lit("frames="), F.col("frames").cast("string"), F.lit(";shots_s="), cuts).alias("feature"),
    )


def queries() -> dict:
    return {f.__name__: f for f in (op1_packing, op2_token_files, op3_toxicity, op4_quality, op5_warc_zip, op6_byte_bpe, op7_exact_dedup, op8_sharding, op9_near_dedup, op10_avi_clips)}


def oracle_sql() -> dict[str, str]:
    return {"op7_exact_dedup": OP7_SQL, "op8_sharding": OP8_SQL}
