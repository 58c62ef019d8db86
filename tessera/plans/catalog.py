"""The engine's registered queries over the driver's tables, and their SQL.

Each query applies operators to a whole table. Floating results are rounded, as sums depend on order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera import functions as X
from tessera.kernels import frames
from tessera.operators import bench, blocks, stats, sweeps, telemetry
from tessera.operators import frames as files_of
from tessera.plans.folders import work_folder
from tessera.plans.spread import small_batches, spread
from tessera.sources import dictionary_from, generated, read_files, read_results, write_results
from tessera.sources import register as register_source

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (table) -> DataFrame under its name, with its SQL where there is one."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            small_batches(spark)

            def table(name: str) -> DataFrame:
                df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
                return spread(df) if name == "documents" else df  # the byte kernels' table

            return f(table)

        run.__doc__, run.__name__ = f.__doc__, f.__name__
        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _bytes(column: str = "text"):
    return F.encode(F.coalesce(F.col(column), F.lit("")), "UTF-8")


def _rounded(df: DataFrame, places: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n).cast("double"), places) for n in names})


@query("""
SELECT lang, count(*) AS docs, CAST(sum(octet_length(encode(coalesce(text, '')))) AS BIGINT) AS raw_bytes, true AS ok
FROM documents GROUP BY lang""")
def codec_roundtrip_by_lang(table):
    """64 KB blocks of all documents packed and unpacked, by language."""
    whole = blocks.decode(blocks.encode(blocks.split(table("documents").select("doc_id", "lang", _bytes().alias("data")), "data", keep=("doc_id", "lang"))))
    return whole.groupBy("lang").agg(F.count_if(F.col("block_no") == 0).alias("docs"), F.sum(F.octet_length("back")).alias("raw_bytes"), F.bool_and("ok").alias("ok"))


@query("""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
n AS (SELECT doc_id, b, octet_length(b) AS size, unnest(range(0, greatest(1, (octet_length(b) + 999) // 1000))) AS block_no FROM d)
SELECT doc_id, CAST(block_no AS INTEGER) AS block_no, block_no * 1000 AS block_offset, least(1000, size - block_no * 1000) AS raw_size FROM n""")
def block_table(table):
    """Blocks of 1000 bytes with their offsets."""
    each = blocks.split(table("documents").select("doc_id", _bytes().alias("data")), "data", 1000, ("doc_id",))
    return each.select("doc_id", "block_no", "block_offset", F.octet_length("raw").cast("long").alias("raw_size"))


@query("""
WITH d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n FROM documents)
SELECT doc_id, n AS n_bytes, n + n // 255 + 16 AS block_bound,
  CASE WHEN n <= 65536 THEN 4 WHEN n <= 262144 THEN 5 WHEN n <= 1048576 THEN 6 ELSE 7 END AS block_id,
  'B' || CASE WHEN n <= 65536 THEN '4' WHEN n <= 262144 THEN '5' WHEN n <= 1048576 THEN '6' ELSE '7' END || 'I' AS label,
  65550 + greatest(16, n) AS ring_bytes, (n >> 8) + 32 AS in_place
FROM d""")
def codec_bounds(table):
    """Worst-case sizes, block ids and buffer sizes."""
    n = F.octet_length(_bytes()).cast("long")
    return table("documents").select(
        "doc_id", n.alias("n_bytes"), X.compress_bound(n).alias("block_bound"), X.fitting_block_id(n).alias("block_id"),
        X.block_label(X.fitting_block_id(n), F.lit(True)).alias("label"), X.ring_buffer_size(n).alias("ring_bytes"), X.in_place_margin(n).alias("in_place"),
    )


@query("SELECT doc_id, md5(coalesce(text, '')) AS back_md5 FROM documents")
def frame_roundtrip(table):
    """Every document as a frame with all checksums and sizes, and back."""
    options = frames.Options(4, True, True, True, True)
    return table("documents").select("doc_id", F.md5(X.frame_decode(X.frame_encode(_bytes(), options), strict=True)).alias("back_md5"))


@query("""
WITH d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n FROM documents)
SELECT CAST(doc_id AS VARCHAR) AS path, CAST(3 AS BIGINT) AS frames, '-' AS type, '-' AS block, CAST(NULL AS BIGINT) AS uncompressed, CAST(NULL AS VARCHAR) AS error FROM d""")
def list_mixed_files(table):
    """Files of a standard, a skippable and a legacy frame, listed from headers."""
    data = _bytes()
    content = F.concat(X.frame_encode(data), X.skippable_frame(data, 3), X.legacy_encode(data))
    listed = files_of.list_frames(table("documents").select(F.col("doc_id").cast("string").alias("path"), content.alias("content")))
    return files_of.list_files(listed).select("path", "frames", "type", "block", "uncompressed", "error")


@query("""
WITH d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n FROM documents)
SELECT CAST(doc_id AS VARCHAR) AS path, CAST(2 AS BIGINT) AS frames, 'StandardFrame' AS type, 'B4I' AS block, nullif(2 * n, 0) AS uncompressed FROM d WHERE n <= 65536
UNION ALL
SELECT CAST(doc_id AS VARCHAR), CAST(2 AS BIGINT), 'StandardFrame', 'B5I', 2 * n FROM d WHERE n > 65536 AND n <= 262144""")
def list_concatenated_files(table):
    """Files of two frames with content sizes: bag union keeps order, sizes add up."""
    each = table("documents").select(F.col("doc_id").cast("string").alias("path"), X.frame_encode(_bytes(), frames.Options(content_size=True)).alias("one"))
    listed = files_of.list_frames(each.select("path", F.concat("one", "one").alias("content")))
    return files_of.list_files(listed).select("path", "frames", "type", "block", "uncompressed")


@query("""
SELECT CAST(doc_id AS VARCHAR) AS path, doc_id % 10 <> 0 AS ok,
  CASE WHEN doc_id % 10 = 0 THEN 'content_checksum_invalid' END AS error FROM documents""")
def test_damaged_files(table):
    """Integrity of files of which every tenth has a wrong content checksum."""
    whole = X.frame_encode(_bytes())
    size = F.octet_length("whole")
    last = F.expr("substring(whole, -1, 1)")
    other = F.when(last == F.lit(b"\x00"), F.lit(b"\x01")).otherwise(F.lit(b"\x00"))
    packed = table("documents").select("doc_id", whole.alias("whole"))
    damaged = F.concat(F.substring("whole", F.lit(1), size - 1), other)
    content = F.when(F.col("doc_id") % 10 == 0, damaged).otherwise(F.col("whole"))
    return files_of.test_files(packed.select(F.col("doc_id").cast("string").alias("path"), content.alias("content")))


@query("""
SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n_bytes FROM documents""")
def sequence_lengths(table):
    """Literals and matches of the sequences of every document add up to its bytes."""
    df = table("documents").select("doc_id", X.block_encode(_bytes()).alias("packed"))
    return blocks.sequence_rows(df, "doc_id", "packed").groupBy("doc_id").agg((F.sum("lit_len") + F.sum(F.coalesce("match_len", F.lit(0)))).cast("long").alias("n_bytes"))


@query("SELECT doc_id, md5(coalesce(text, '')) AS back_md5, least(100, octet_length(encode(coalesce(text, '')))) AS part_bytes, true AS part_ok FROM documents")
def levels_and_partial_decoding(table):
    """Level 9 blocks decoded whole and for their first 100 bytes."""
    df = table("documents").select("doc_id", _bytes().alias("data"), X.block_encode(_bytes(), level=9).alias("packed"))
    part = X.block_decode_partial("packed", 100)
    return df.select("doc_id", F.md5(X.block_decode("packed", strict=True)).alias("back_md5"), F.octet_length(part).cast("long").alias("part_bytes"), (part == F.substring("data", F.lit(1), F.lit(100))).alias("part_ok"))


#: A level of each parse: greedy, by two distances, lazy with few and with many tries, optimal.
PARSES = (-8, 1, 4, 9, 12)


@query("SELECT lang, count(*) AS docs, true AS ok, true AS bounded FROM documents GROUP BY lang")
def level_roundtrips(table):
    """Greedy, lazy and optimal parses decode to the same bytes and stay within the bound."""
    df = table("documents").select("lang", _bytes().alias("data"))
    df = df.withColumns({f"l{k}": X.block_encode("data", level=k) for k in PARSES})
    names = [f"`l{k}`" for k in PARSES]
    same = [X.block_decode(F.col(n)) == F.col("data") for n in names]
    within = [F.octet_length(F.col(n)) <= X.compress_bound(F.octet_length("data")) for n in names]
    ok, bounded = same[0], within[0]
    for a, b in zip(same[1:], within[1:]):
        ok, bounded = ok & a, bounded & b
    return df.groupBy("lang").agg(F.count("*").alias("docs"), F.bool_and(ok).alias("ok"), F.bool_and(bounded).alias("bounded"))


@query("SELECT doc_id, md5(coalesce(text, '')) AS back_md5, (octet_length(encode(text)) + 4095) // 4096 AS blocks FROM documents WHERE text <> ''")
def container_roundtrip(table):
    """The sized container with blocks of 4 KB."""
    df = table("documents").where("text <> ''").select("doc_id", X.container_encode(_bytes(), 4096).alias("packed"))
    words = F.concat(*[F.hex(F.substring("packed", F.lit(k), F.lit(1))) for k in (8, 7, 6, 5)])
    return df.select("doc_id", F.md5(X.container_decode("packed", strict=True)).alias("back_md5"), F.conv(words, 16, 10).cast("long").alias("blocks"))


@query("SELECT doc_id, md5(coalesce(text, '')) AS back_md5 FROM documents")
def legacy_roundtrip(table):
    return table("documents").select("doc_id", F.md5(X.frame_decode(X.legacy_encode(_bytes()), strict=True)).alias("back_md5"))


@query("SELECT doc_id, coalesce(text, '') AS back FROM documents")
def passed_through(table):
    """Files of another format, as they are."""
    return table("documents").select("doc_id", F.decode(X.frame_decode(_bytes(), pass_through=True), "UTF-8").alias("back"))


@query("SELECT item_id, md5(text) AS back_md5, true AS smaller FROM benchmark")
def dictionary_roundtrip(table):
    """Items packed with the last 64 KB of all items as dictionary are no larger than without."""
    rows = table("benchmark")
    words = dictionary_from(rows, "text", "item_id")
    data = F.encode("text", "UTF-8")
    packed = rows.select("item_id", X.block_encode(data, dictionary=words).alias("with"), X.block_encode(data).alias("without"))
    return packed.select("item_id", F.md5(X.block_decode("with", dictionary=words, strict=True)).alias("back_md5"), (F.octet_length("with") <= F.octet_length("without")).alias("smaller"))


@query("SELECT item_id, md5(text) AS back_md5, CAST(77 AS BIGINT) AS dict_id FROM benchmark")
def dictionary_frames(table):
    """Items as linked frames that name their dictionary."""
    rows = table("benchmark")
    words = dictionary_from(rows, "text", "item_id")
    packed = rows.select("item_id", X.frame_encode(F.encode("text", "UTF-8"), frames.Options(4, False, True, True, True, 77), words).alias("packed"))
    return packed.select("item_id", F.md5(X.frame_decode("packed", words, strict=True)).alias("back_md5"), X.header_fields("packed")["dict_id"].alias("dict_id"))


@query("SELECT item_id, octet_length(encode(text)) AS n_bytes, true AS ok, true AS no_larger FROM benchmark")
def optimal_levels(table):
    """Levels 10 to 12 give the same bytes back, and no more of them than level 9 does."""
    df = table("benchmark").select("item_id", F.encode("text", "UTF-8").alias("data"))
    df = df.withColumns({f"l{k}": X.block_encode("data", level=k) for k in (9, 10, 11, 12)})
    ok = reduce(lambda a, b: a & b, [X.block_decode(f"l{k}") == F.col("data") for k in (10, 11, 12)])
    no_larger = reduce(lambda a, b: a & b, [F.octet_length(f"l{k}") <= F.octet_length("l9") for k in (10, 11, 12)])
    return df.select("item_id", F.octet_length("data").alias("n_bytes"), ok.alias("ok"), no_larger.alias("no_larger"))


@query("SELECT lang, count(*) AS docs, true AS ok, true AS in_order FROM documents GROUP BY lang")
def strategies_by_size(table):
    """The greedy, two-distance and overlapping parses, from the largest result by language to the smallest."""
    df = table("documents").select("lang", _bytes().alias("data"))
    df = df.withColumns({f"l{k}": X.block_encode("data", level=k) for k in (0, 2, 5)})
    ok = reduce(lambda a, b: a & b, [X.block_decode(f"l{k}") == F.col("data") for k in (0, 2, 5)])
    out = df.groupBy("lang").agg(F.count("*").alias("docs"), F.bool_and(ok).alias("ok"), *[F.sum(F.octet_length(f"l{k}")).alias(f"s{k}") for k in (0, 2, 5)])
    return out.select("lang", "docs", "ok", ((F.col("s0") >= F.col("s2")) & (F.col("s2") >= F.col("s5"))).alias("in_order"))


@query("SELECT doc_id, true AS fits, true AS same, octet_length(encode(coalesce(text, ''))) <= 300 AS whole FROM documents WHERE octet_length(encode(coalesce(text, ''))) <= 300 OR octet_length(encode(coalesce(text, ''))) > 20000")
def filled_rooms(table):
    """As much of a text as fits 310 bytes, of short texts, which do, and of long ones, which don't."""
    n = F.octet_length(_bytes())
    df = table("documents").where((n <= 300) | (n > 20000)).select("doc_id", _bytes().alias("data"))
    df = df.withColumn("own", X.block_encode_into("data", 310))
    back = X.block_decode("own.block", strict=True)
    return df.select("doc_id", (F.octet_length("own.block") <= 310).alias("fits"), (back == F.substring("data", F.lit(1), F.col("own.consumed").cast("int"))).alias("same"), (F.col("own.consumed") == F.octet_length("data")).alias("whole"))


@query("""
SELECT doc_id, md5(coalesce(text, '')) AS back_md5, CAST((octet_length(encode(coalesce(text, ''))) + 999) // 1000 AS INTEGER) AS blocks FROM documents""")
def custom_block_frames(table):
    """Linked frames with blocks of 1000 bytes, and their blocks by the headers alone."""
    packed = table("documents").select(F.col("doc_id").cast("string").alias("path"), X.frame_encode(_bytes(), frames.Options(independent=False, block_size=1000)).alias("content"))
    listed = files_of.list_frames(packed.withColumn("back_md5", F.md5(X.frame_decode("content", strict=True))), keep=("back_md5",))
    return listed.select(F.col("path").cast("long").alias("doc_id"), "back_md5", "blocks")


@query("SELECT doc_id, md5(coalesce(text, '')) AS back_md5 FROM documents")
def written_frames(table):
    """Linked frames whose chunks of 64 KB are packed in parallel and joined."""
    df = table("documents").select("doc_id", _bytes().alias("data"))
    packed = files_of.write_files(df, "doc_id", "data", frames.Options(4, False, True, True, True), 65536)
    return packed.select("doc_id", F.md5(X.frame_decode("content", strict=True)).alias("back_md5"))


@query("""
WITH d AS (SELECT doc_id, md5(coalesce(text, '')) AS m, greatest(1, (octet_length(encode(coalesce(text, ''))) + 499) // 500) AS n FROM documents)
SELECT doc_id, CASE WHEN doc_id % 4 = 1 AND n > 2 OR doc_id % 4 IN (2, 3) THEN NULL ELSE m END AS back_md5,
  CASE WHEN doc_id % 4 = 1 AND n > 2 THEN 'a missing block' WHEN doc_id % 4 = 2 THEN 'a repeated block' WHEN doc_id % 4 = 3 THEN 'a null block' END AS error FROM d""")
def blocks_in_order(table):
    """Blocks joined by number; missing, repeated and null ones are errors."""
    each = blocks.split(table("documents").select("doc_id", _bytes().alias("data")), "data", 500, ("doc_id",))
    kind = F.col("doc_id") % 4
    n = F.count("*").over(W.partitionBy("doc_id"))
    left = each.withColumn("n", n).where((kind != 1) | (F.col("block_no") != 1) | (F.col("n") <= 2)).drop("n")
    again = each.where((kind == 2) & (F.col("block_no") == 0))
    rows = left.unionAll(again).withColumn("raw", F.when((kind == 3) & (F.col("block_no") == 0), F.lit(None)).otherwise(F.col("raw")))
    return blocks.assemble(rows.repartition("doc_id", "block_no"), ["doc_id"]).select("doc_id", F.md5("raw").alias("back_md5"), "error")


@query("SELECT count(*) AS docs, CAST(sum(octet_length(encode(coalesce(text, '')))) AS BIGINT) AS raw_bytes, true AS bounded FROM documents WHERE text <> ''")
def frame_files(table):
    """Texts written as frame files, a task's as one linked frame block by block, and read back block by block."""
    df = table("documents").where("text <> ''")
    spark = df.sparkSession
    register_source(spark)
    folder = work_folder(spark, "frame-files")
    rows = df.select(F.lit("").alias("path"), F.lit(0).alias("frame_no"), F.lit("").alias("kind"), F.lit(0).cast("long").alias("content_size"), _bytes().alias("data"))
    rows.write.format("tessera_frames").mode("append").option("blockSize", 65536).option("independent", "false").save(folder)
    back = spark.read.format("tessera_frames").option("rows", "blocks").load(folder)
    found = back.agg(F.sum(F.octet_length("data")).alias("raw_bytes"), (F.max(F.octet_length("data")) <= 65536).alias("bounded"))
    return df.agg(F.count("*").alias("docs")).crossJoin(found)


@query("""
SELECT conv_id, count(*) AS messages, CAST(sum(octet_length(encode(coalesce(text, '')))) AS BIGINT) AS raw_bytes, true AS ok FROM conversations GROUP BY conv_id""")
def linked_conversations(table):
    """Conversations as linked streams: each message packed with those before as history, and back."""
    rows = table("conversations").select("conv_id", "turn", "text")
    back = blocks.unlinked_streams(blocks.linked_streams(rows, "conv_id", "turn", "text"), "conv_id", "turn")
    told = rows.groupBy("conv_id").agg(F.expr("bit_xor(xxhash64(turn, coalesce(text, '')))").alias("told"))
    found = back.groupBy("conv_id").agg(F.count("*").alias("messages"), F.sum(F.octet_length("message")).alias("raw_bytes"), F.expr("bit_xor(xxhash64(turn, cast(message as string)))").alias("found"))
    return found.join(told, "conv_id").select("conv_id", "messages", "raw_bytes", (F.col("told") == F.col("found")).alias("ok"))


@query("""
SELECT conv_id, count(*) AS messages, CAST(sum(octet_length(encode(coalesce(text, '')))) AS BIGINT) AS raw_bytes, true AS ok FROM conversations GROUP BY conv_id""")
def linked_with_dictionary(table):
    """Linked streams at level 2 behind a shared dictionary, all of equal order, written and read back."""
    rows = table("conversations").select("conv_id", F.lit(0).alias("turn"), "text")
    words = dictionary_from(table("benchmark"), "text", "item_id")
    packed = blocks.linked_streams(rows, "conv_id", "turn", "text", level=2, dictionary=words)
    folder = work_folder(rows.sparkSession, "linked")
    packed.repartition(F.rand(1)).write.parquet(folder)  # in any order
    back = blocks.unlinked_streams(rows.sparkSession.read.schema(packed.schema).parquet(folder), "conv_id", "turn", dictionary=words)
    told = rows.groupBy("conv_id").agg(F.expr("bit_xor(xxhash64(cast(coalesce(text, '') as binary)))").alias("told"))
    found = back.groupBy("conv_id").agg(F.count("*").alias("messages"), F.sum(F.octet_length("message")).alias("raw_bytes"), F.expr("bit_xor(xxhash64(message))").alias("found"))
    return found.join(told, "conv_id").select("conv_id", "messages", "raw_bytes", (F.col("told") == F.col("found")).alias("ok"))


@query("SELECT doc_id, md5(encode(coalesce(text, ''))[1501:1700]) AS slice_md5 FROM documents WHERE octet_length(encode(coalesce(text, ''))) > 1500")
def random_access(table):
    """Bytes 1500 to 1700 by decoding only the 1 KB blocks that hold them."""
    packed = blocks.encode(blocks.split(table("documents").select("doc_id", _bytes().alias("data")), "data", 1024, ("doc_id",)))
    few = blocks.read_range(packed.select("doc_id", "block_no", "packed"), ["doc_id"], 1500, 200, 1024)
    return few.where(F.octet_length("slice") > 0).select("doc_id", F.md5("slice").alias("slice_md5"))


@query("""
SELECT doc_id, 1 AS runs, octet_length(encode(coalesce(text, ''))) AS first_start, 100 + doc_id % 7 AS zeros FROM documents""")
def zero_run_map(table):
    """Runs of zeros that a sparse file could leave out."""
    data = F.concat(_bytes(), F.expr("unhex(repeat('00', 100 + cast(doc_id % 7 as int)))"), F.lit(b"x"))
    df = table("documents").select("doc_id", X.zero_runs(data, 32).alias("found"))
    return df.select("doc_id", F.size("found").alias("runs"), F.col("found")[0]["start"].alias("first_start"), F.aggregate("found", F.lit(0).cast("long"), lambda a, r: a + r["length"]).alias("zeros"))


_XXH32_SQL = """
WITH b AS (SELECT n_name, encode(n_name) AS d, octet_length(encode(n_name)) AS n FROM nation),
w AS (SELECT n_name, n, d, (374761393 + n) % 4294967296 AS h FROM b),
q1 AS (SELECT n_name, n, d, CASE WHEN n >= 4 THEN (h + (ascii(n_name[1]) + ascii(n_name[2]) * 256 + ascii(n_name[3]) * 65536 + ascii(n_name[4]) * 16777216)::HUGEINT * 3266489917) % 4294967296 END AS x, h FROM w),
r1 AS (SELECT n_name, n, d, CASE WHEN n >= 4 THEN ((x * 131072) % 4294967296 + x // 32768)::HUGEINT * 668265263 % 4294967296 ELSE h END AS h FROM q1),
q2 AS (SELECT n_name, n, d, h, CASE WHEN n >= 8 THEN (h + (ascii(n_name[5]) + ascii(n_name[6]) * 256 + ascii(n_name[7]) * 65536 + ascii(n_name[8]) * 16777216)::HUGEINT * 3266489917) % 4294967296 END AS x FROM r1),
r2 AS (SELECT n_name, n, d, CASE WHEN n >= 8 THEN ((x * 131072) % 4294967296 + x // 32768)::HUGEINT * 668265263 % 4294967296 ELSE h END AS h FROM q2),
q3 AS (SELECT n_name, n, d, h, CASE WHEN n >= 12 THEN (h + (ascii(n_name[9]) + ascii(n_name[10]) * 256 + ascii(n_name[11]) * 65536 + ascii(n_name[12]) * 16777216)::HUGEINT * 3266489917) % 4294967296 END AS x FROM r2),
r3 AS (SELECT n_name, n, CASE WHEN n >= 12 THEN ((x * 131072) % 4294967296 + x // 32768)::HUGEINT * 668265263 % 4294967296 ELSE h END AS h FROM q3),
s1 AS (SELECT n_name, n, h, CASE WHEN n % 4 >= 1 THEN (h + ascii(n_name[n - n % 4 + 1])::HUGEINT * 374761393) % 4294967296 END AS x FROM r3),
t1 AS (SELECT n_name, n, CASE WHEN n % 4 >= 1 THEN ((x * 2048) % 4294967296 + x // 2097152)::HUGEINT * 2654435761 % 4294967296 ELSE h END AS h FROM s1),
s2 AS (SELECT n_name, n, h, CASE WHEN n % 4 >= 2 THEN (h + ascii(n_name[n - n % 4 + 2])::HUGEINT * 374761393) % 4294967296 END AS x FROM t1),
t2 AS (SELECT n_name, n, CASE WHEN n % 4 >= 2 THEN ((x * 2048) % 4294967296 + x // 2097152)::HUGEINT * 2654435761 % 4294967296 ELSE h END AS h FROM s2),
s3 AS (SELECT n_name, n, h, CASE WHEN n % 4 >= 3 THEN (h + ascii(n_name[n - n % 4 + 3])::HUGEINT * 374761393) % 4294967296 END AS x FROM t2),
t3 AS (SELECT n_name, CASE WHEN n % 4 >= 3 THEN ((x * 2048) % 4294967296 + x // 2097152)::HUGEINT * 2654435761 % 4294967296 ELSE h END AS h FROM s3),
a1 AS (SELECT n_name, xor(h::BIGINT, (h // 32768)::BIGINT)::HUGEINT * 2246822519 % 4294967296 AS h FROM t3),
a2 AS (SELECT n_name, xor(h::BIGINT, (h // 8192)::BIGINT)::HUGEINT * 3266489917 % 4294967296 AS h FROM a1)
SELECT n_name, xor(h::BIGINT, (h // 65536)::BIGINT) AS hash FROM a2"""


@query(_XXH32_SQL)
def hash32_of_names(table):
    """32-bit hashes of names of fewer than 16 bytes."""
    return table("nation").select("n_name", X.xxh32("n_name").alias("hash"))


def _xxh64_sql() -> str:
    """64-bit hashes of names of fewer than 32 bytes, in numbers of 128 bits; a step for each part of a name that is there."""
    # Fixed values of the 64-bit hash.
    p1, p2, p3, p4, p5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
    most = "18446744073709551616::UHUGEINT"

    def turned(x: str, by: int) -> str:
        return f"(({x}) * {1 << by}::UHUGEINT % {most} + ({x}) // {1 << (64 - by)}::UHUGEINT)"

    def mixed(a: str, b: str) -> str:
        return f"xor(({a})::UBIGINT, ({b})::UBIGINT)::UHUGEINT"

    def number(first: str, size: int) -> str:
        return "(" + " + ".join(f"ascii(n_name[{first} + {k}])::UHUGEINT * {1 << (8 * k)}::UHUGEINT" for k in range(size)) + ")"

    steps = [("s0", f"SELECT n_name, octet_length(encode(n_name)) AS n, 1 AS pos, ({p5}::UHUGEINT + octet_length(encode(n_name))::UHUGEINT) % {most} AS h FROM nation")]

    def step(columns: str) -> None:
        steps.append((f"s{len(steps)}", f"SELECT {columns} FROM s{len(steps) - 1}"))

    for _ in range(3):
        there = "n - pos + 1 >= 8"
        step(f"n_name, n, pos, h, CASE WHEN {there} THEN {number('pos', 8)} * {p2}::UHUGEINT % {most} END AS x")
        step(f"n_name, n, pos, h, {turned('x', 31)} * {p1}::UHUGEINT % {most} AS x")
        step(f"n_name, n, pos, h, CASE WHEN x IS NOT NULL THEN {mixed('h', 'x')} END AS x")
        step(f"n_name, n, CASE WHEN x IS NULL THEN pos ELSE pos + 8 END AS pos, CASE WHEN x IS NULL THEN h ELSE ({turned('x', 27)} * {p1}::UHUGEINT + {p4}::UHUGEINT) % {most} END AS h")
    step(f"n_name, n, pos, h, CASE WHEN n - pos + 1 >= 4 THEN {mixed('h', number('pos', 4) + f' * {p1}::UHUGEINT % {most}')} END AS x")
    step(f"n_name, n, CASE WHEN x IS NULL THEN pos ELSE pos + 4 END AS pos, CASE WHEN x IS NULL THEN h ELSE ({turned('x', 23)} * {p2}::UHUGEINT + {p3}::UHUGEINT) % {most} END AS h")
    for _ in range(3):
        step(f"n_name, n, pos, h, CASE WHEN pos <= n THEN {mixed('h', number('pos', 1) + f' * {p5}::UHUGEINT % {most}')} END AS x")
        step(f"n_name, n, CASE WHEN x IS NULL THEN pos ELSE pos + 1 END AS pos, CASE WHEN x IS NULL THEN h ELSE {turned('x', 11)} * {p1}::UHUGEINT % {most} END AS h")
    step(f"n_name, {mixed('h', f'h // {1 << 33}::UHUGEINT')} * {p2}::UHUGEINT % {most} AS h")
    step(f"n_name, {mixed('h', f'h // {1 << 29}::UHUGEINT')} * {p3}::UHUGEINT % {most} AS h")
    step(f"n_name, {mixed('h', f'h // {1 << 32}::UHUGEINT')} AS h")
    return "WITH " + ", ".join(f"{name} AS ({sql})" for name, sql in steps) + f" SELECT n_name, CAST(h AS VARCHAR) AS hash FROM s{len(steps) - 1}"


_XXH64_SQL = _xxh64_sql()


@query(_XXH64_SQL)
def hash64_of_names(table):
    """64-bit hashes of names, as unsigned numbers."""
    signed = X.xxh64("n_name").cast("decimal(20,0)")
    return table("nation").select("n_name", F.when(signed < 0, signed + F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(signed).cast("decimal(20,0)").cast("string").alias("hash"))


@query(_XXH64_SQL)
def hash64_of_pieces(table):
    """The same hashes folded over ordered pieces of 3 bytes."""
    pieces = blocks.split(table("nation").select("n_name", F.encode("n_name", "UTF-8").alias("data")), "data", 3, ("n_name",))
    return blocks.fold_hash(pieces, ["n_name"], bits=64).select("n_name", F.col("hash").cast("string").alias("hash"))


@query("SELECT doc_id, true AS same FROM documents")
def hash64_of_documents(table):
    """With seed 42 the 64-bit hash is the built-in one, which runs in the JVM; held against it, folded over pieces of a document."""
    rows = table("documents").select("doc_id", _bytes().alias("data"))
    folded = blocks.fold_hash(blocks.split(rows, "data", 1000, ("doc_id",)), ["doc_id"], bits=64, seed=42)
    built_in = X.xxh64("data", 42).cast("decimal(20,0)")
    unsigned = F.when(built_in < 0, built_in + F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(built_in)
    return rows.join(folded, "doc_id").select("doc_id", (unsigned == F.col("hash")).alias("same"))


@query("SELECT lang, source, CAST(sum(octet_length(encode(coalesce(text, '')))) AS BIGINT) AS raw, true AS smaller, true AS bounded FROM documents GROUP BY lang, source")
def compressed_sizes(table):
    """Compressed bytes by language and source: fewer than raw ones, and no block beyond its bound."""
    df = table("documents").select("lang", "source", _bytes().alias("data"), X.block_encode(_bytes()).alias("packed"))
    bounded = F.bool_and(F.octet_length("packed") <= X.compress_bound(F.octet_length("data")))
    out = df.groupBy("lang", "source").agg(F.sum(F.octet_length("data")).alias("raw"), F.sum(F.octet_length("packed")).alias("packed"), bounded.alias("bounded"))
    return out.select("lang", "source", "raw", (X.ratio_pct("packed", "raw") < 100).alias("smaller"), "bounded")


_MEASURES = ("n", "mean", "median", "stdev", "cv_pct", "ci95_half")


def _measures_sql(value: str, prefix: str) -> str:
    s = f"CASE WHEN count({value}) = 1 THEN 0 ELSE stddev_samp({value}) END"
    return f"""count({value}) AS {prefix}_n, round(avg({value}), 6) AS {prefix}_mean, round(median({value}), 6) AS {prefix}_median,
  round({s}, 6) AS {prefix}_stdev, round(CASE WHEN avg({value}) = 0 THEN 0 ELSE 100.0 * ({s}) / avg({value}) END, 6) AS {prefix}_cv_pct,
  round(1.96 * ({s}) / sqrt(count({value})), 6) AS {prefix}_ci95_half"""


@query(f"""SELECT l_returnflag, l_linestatus, {_measures_sql('l_quantity', 'quantity')}, {_measures_sql('l_discount', 'discount')}
FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def measures_by_group(table):
    """n, mean, median, deviation, CV and confidence half-width."""
    out = table("lineitem").groupBy("l_returnflag", "l_linestatus").agg(*stats.measures(F.col("l_quantity"), "quantity"), *stats.measures(F.col("l_discount"), "discount"))
    return _rounded(out, 6, *[f"{p}_{m}" for p in ("quantity", "discount") for m in _MEASURES[1:]])


@query("""
WITH f AS (SELECT l_suppkey, l_returnflag, median(l_extendedprice) AS m, count(*) AS rounds, bool_and(l_quantity > 0) AS ok FROM lineitem GROUP BY ALL)
SELECT l_returnflag, count(*) AS samples, bool_and(ok) AS verify_all, round(median(m), 6) AS price_median_of_files, round(avg(m), 6) AS price_mean_of_files
FROM f GROUP BY l_returnflag""")
def medians_of_medians(table):
    """Two levels: medians by supplier and flag, then their median and mean by flag."""
    each = table("lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.median("l_extendedprice").alias("price_median"), F.bool_and(F.col("l_quantity") > 0).alias("ok"))
    out = stats.aggregate_summary(each, ("l_returnflag",), ("price",))
    return _rounded(out, 6, "price_median_of_files", "price_mean_of_files")


_RAW_SQL = """
SELECT 's' || (l_suppkey % 20) AS sample, CASE l_linestatus WHEN 'O' THEN 'gpu' ELSE 'native_cpu' END AS engine, l_linenumber AS accel,
  CASE WHEN l_returnflag = 'R' THEN 'bench' ELSE 'manual' END AS phase, CASE WHEN l_quantity < 2 THEN 'failed' ELSE 'ok' END AS status,
  CAST(round(l_extendedprice * 100) AS BIGINT) AS bench_mbs, CASE WHEN l_suppkey % 20 < 5 THEN NULL ELSE l_quantity END AS manual_mbs FROM lineitem"""


@query(f"""
WITH r AS ({_RAW_SQL}),
v AS (SELECT *, CASE WHEN status = 'ok' AND phase = 'manual' THEN manual_mbs END AS p, CASE WHEN status = 'ok' AND phase = 'bench' THEN bench_mbs END AS f FROM r)
SELECT sample, engine, accel, CASE WHEN count(p) > 0 THEN count(p) ELSE count(f) END AS mbs_n,
  CASE WHEN count(p) > 0 THEN avg(p) ELSE avg(f) END AS mbs_mean, CASE WHEN count(p) > 0 THEN median(p) ELSE median(f) END AS mbs_median
FROM v GROUP BY ALL""")
def primary_or_fallback(table):
    """A group's manual values, or its bench values where it has no manual one."""
    rows = table("lineitem").select(
        F.concat(F.lit("s"), (F.col("l_suppkey") % 20).cast("string")).alias("sample"), F.when(F.col("l_linestatus") == "O", "gpu").otherwise("native_cpu").alias("engine"), F.col("l_linenumber").alias("accel"),
        F.when((F.col("l_quantity") >= 2) & (F.col("l_returnflag") != "R") & (F.col("l_suppkey") % 20 >= 5), F.col("l_quantity")).alias("p"),
        F.when((F.col("l_quantity") >= 2) & (F.col("l_returnflag") == "R"), F.round(F.col("l_extendedprice") * 100).cast("long").cast("double")).alias("f"),
    )
    return rows.groupBy("sample", "engine", "accel").agg(*stats.chosen(F.col("p"), F.col("f"), "mbs")).select("sample", "engine", "accel", "mbs_n", "mbs_mean", "mbs_median")


_RUNS_SQL = """
SELECT 's' || (l_suppkey % 20) AS sample, CASE l_linestatus WHEN 'O' THEN 'gpu' ELSE 'native_cpu' END AS engine, l_linenumber AS accel,
  CASE WHEN l_returnflag = 'R' OR l_suppkey % 20 = 7 THEN 'bench' ELSE 'manual' END AS phase, CASE WHEN l_quantity < 2 THEN 'failed' ELSE 'ok' END AS status,
  l_quantity > 3 OR l_suppkey % 20 > 10 AS verify_ok, l_discount * 100 / 7.0 AS ratio_pct, l_extendedprice / 7.0 AS bench_comp, l_tax / 7.0 AS bench_dec,
  CASE WHEN l_suppkey % 20 < 5 THEN NULL ELSE l_quantity / 7.0 END AS manual_comp, (l_tax + 1) / 7.0 AS manual_dec, l_quantity / 7.0 AS comp_all, NULL::DOUBLE AS dec_all, l_orderkey AS input_bytes, l_partkey AS compressed_bytes
FROM lineitem"""


def _picked_sql(first: str, second: str | None, use_first: str, prefix: str) -> str:
    def measured(v: str) -> list[str]:
        s = f"CASE WHEN count({v}) = 1 THEN 0 ELSE stddev_samp({v}) END"
        return [f"count({v})", f"avg({v})", f"median({v})", s, f"CASE WHEN avg({v}) = 0 THEN 0 ELSE 100.0 * ({s}) / avg({v}) END", f"1.96 * ({s}) / sqrt(count({v}))"]

    pairs = zip(measured(first), measured(second or first))
    chosen = [f"CASE WHEN {use_first} THEN {a} ELSE {b} END" for a, b in pairs]
    return ", ".join(f"{c if name == 'n' else f'round({c}, 6)'} AS {prefix}_{name}" for name, c in zip(_MEASURES, chosen))


@query(f"""
WITH r AS ({_RUNS_SQL}),
v AS (SELECT *, status = 'ok' AND phase = 'manual' AS m, status = 'ok' AND phase = 'bench' AS b FROM r),
x AS (SELECT *, CASE WHEN m THEN ratio_pct END AS rm, CASE WHEN b THEN ratio_pct END AS rb, CASE WHEN m THEN manual_comp END AS cm, CASE WHEN b THEN bench_comp END AS cb,
  CASE WHEN m THEN manual_dec END AS dm, CASE WHEN b THEN bench_dec END AS db, CASE WHEN m THEN comp_all END AS ea, CASE WHEN m THEN dec_all END AS da FROM v)
SELECT sample, engine, accel, min(input_bytes) AS input_bytes, min(compressed_bytes) AS compressed_bytes, count_if(b)::BIGINT AS bench_rounds, count_if(m)::BIGINT AS manual_rounds,
  coalesce(bool_and(verify_ok) FILTER (WHERE m), false) AS ok, {_picked_sql('rm', 'rb', 'count_if(m) > 0', 'ratio_pct')}, {_picked_sql('cm', 'cb', 'count(cm) > 0', 'comp_mbs')},
  {_picked_sql('dm', 'db', 'count(dm) > 0', 'dec_mbs')}, {_picked_sql('ea', None, 'true', 'e2e_comp_mbs')}, {_picked_sql('da', None, 'true', 'e2e_dec_mbs')}
FROM x GROUP BY sample, engine, accel""")
def runs_by_file(table):
    """The summary of raw runs by file and configuration: rounds by phase, verification, and measures that prefer manual rounds."""
    n = F.col("l_suppkey") % 20
    raw = table("lineitem").select(
        F.concat(F.lit("s"), n.cast("string")).alias("sample"), F.when(F.col("l_linestatus") == "O", "gpu").otherwise("native_cpu").alias("engine"), F.col("l_linenumber").alias("accel"),
        F.when((F.col("l_returnflag") == "R") | (n == 7), "bench").otherwise("manual").alias("phase"), F.when(F.col("l_quantity") < 2, "failed").otherwise("ok").alias("status"),
        F.when((F.col("l_quantity") > 3) | (n > 10), "True").otherwise("no").alias("verify_ok"), (F.col("l_discount") * 100 / 7.0).alias("ratio_pct"), (F.col("l_extendedprice") / 7.0).alias("bench_comp_kernel_mbs"),
        (F.col("l_tax") / 7.0).alias("bench_dec_kernel_mbs"), F.when(n >= 5, F.col("l_quantity") / 7.0).alias("manual_comp_kernel_mbs"), ((F.col("l_tax") + 1) / 7.0).alias("manual_dec_kernel_mbs"),
        (F.col("l_quantity") / 7.0).alias("manual_comp_no_ocl_mbs"), F.lit("NA").alias("manual_dec_no_ocl_mbs"), F.col("l_orderkey").alias("input_bytes"), F.col("l_partkey").alias("compressed_bytes"),
    )
    out = stats.per_file_summary(raw, ("sample", "engine", "accel"))
    return _rounded(out, 6, *[f"{p}_{m}" for p in ("ratio_pct", "comp_mbs", "dec_mbs", "e2e_comp_mbs", "e2e_dec_mbs") for m in _MEASURES[1:]])


@query("""
WITH g AS (SELECT l_suppkey % 50 AS sample, l_linestatus AS mode, count(*) AS runs, min(l_orderkey * 1048576) AS input_bytes, avg(l_extendedprice) AS total, avg(l_quantity) AS kernel, avg(l_tax) AS h2d, avg(l_discount) AS d2h
  FROM lineitem WHERE l_returnflag <> 'R' GROUP BY ALL)
SELECT CAST(sample AS BIGINT) AS sample, mode, runs, round(CASE WHEN total > 0 THEN input_bytes / 1048576.0 / (total / 1000.0) END, 6) AS comp_throughput_total, round(CASE WHEN kernel > 0 THEN input_bytes / 1048576.0 / (kernel / 1000.0) END, 6) AS decomp_throughput_kernel,
  round(100 - 100.0 * kernel / total - 100.0 * h2d / total - 100.0 * d2h / total, 6) AS comp_overhead_pct FROM g""")
def throughput_by_run(table):
    """Runs averaged by configuration, and their throughput and shares."""
    ms = {"comp_total_ms": "l_extendedprice", "comp_kernel_ms": "l_quantity", "comp_h2d_ms": "l_tax", "comp_d2h_ms": "l_discount", "dec_total_ms": "l_extendedprice", "dec_kernel_ms": "l_quantity", "dec_h2d_ms": "l_tax", "dec_d2h_ms": "l_discount"}
    raw = table("lineitem").select(
        (F.col("l_suppkey") % 50).alias("sample"), F.col("l_linestatus").alias("mode"), F.when(F.col("l_returnflag") != "R", "OK").otherwise("FAIL").alias("ok"), F.lit(1).alias("run"),
        (F.col("l_orderkey") * 1048576).alias("input_bytes"), F.lit(1.0).alias("compressed_bytes"), F.lit(1.0).alias("compression_ratio"), *[F.col(c).alias(name) for name, c in ms.items()],
    )
    out = stats.throughput(stats.average_runs(raw, ("sample", "mode")))
    return _rounded(out, 6, "comp_throughput_total", "decomp_throughput_kernel", "comp_overhead_pct").select("sample", "mode", "runs", "comp_throughput_total", "decomp_throughput_kernel", "comp_overhead_pct")


@query("""
WITH g AS (SELECT l_linestatus AS mode, l_suppkey, round(avg(l_extendedprice), 4) AS mbs FROM lineitem GROUP BY ALL),
b AS (SELECT *, 'best' AS side, row_number() OVER (PARTITION BY mode ORDER BY mbs DESC, l_suppkey) AS place FROM g),
w AS (SELECT *, 'worst' AS side, row_number() OVER (PARTITION BY mode ORDER BY mbs, l_suppkey) AS place FROM g)
SELECT mode, side, CAST(place AS INTEGER) AS place, l_suppkey, mbs FROM b WHERE place <= 10 UNION ALL SELECT mode, side, CAST(place AS INTEGER), l_suppkey, mbs FROM w WHERE place <= 10""")
def top_ten_by_mode(table):
    """The ten best and the ten worst of each mode."""
    each = table("lineitem").groupBy(F.col("l_linestatus").alias("mode"), "l_suppkey").agg(F.round(F.avg("l_extendedprice"), 4).alias("mbs"))
    sides = [stats.top_by(each, ["mode"], "mbs", 10, ["l_suppkey"], worst).withColumn("side", F.lit("worst" if worst else "best")) for worst in (False, True)]
    return sides[0].unionByName(sides[1]).select("mode", "side", "place", "l_suppkey", "mbs")


@query("SELECT l_returnflag, l_linestatus, count(l_extendedprice) AS n, round(median(l_extendedprice), 6) AS median FROM lineitem GROUP BY ALL")
def medians_of_large_groups(table):
    """Exact medians of few large groups, by ranges: no task holds a group."""
    rows = table("lineitem")
    out = stats.exact_medians(rows, ["l_returnflag", "l_linestatus"], "l_extendedprice", work_folder(rows.sparkSession, "medians"))
    return _rounded(out, 6, "median")


@query("SELECT l_linenumber, round(stddev_pop(l_quantity), 6) AS spread FROM lineitem GROUP BY 1")
def population_spread(table):
    """Deviations of whole groups."""
    return _rounded(table("lineitem").groupBy("l_linenumber").agg(stats.population_stdev(F.col("l_quantity")).alias("spread")), 6, "spread")


@query("""
WITH g AS (SELECT l_partkey, round(sum(l_extendedprice), 2) AS price FROM lineitem GROUP BY 1),
t AS (SELECT *, 'top' AS side, row_number() OVER (ORDER BY price DESC, l_partkey) AS place FROM g),
b AS (SELECT *, 'bottom' AS side, row_number() OVER (ORDER BY price, l_partkey) AS place FROM g)
SELECT l_partkey, price, CAST(place AS INTEGER) AS place, side FROM t WHERE place <= 10 UNION ALL SELECT l_partkey, price, CAST(place AS INTEGER), side FROM b WHERE place <= 10""")
def top_and_bottom(table):
    """The ten best and the ten worst, equal ones by key."""
    each = table("lineitem").groupBy("l_partkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("price"))
    return stats.top(each, "price", 10, ["l_partkey"]).withColumn("side", F.lit("top")).unionByName(stats.top(each, "price", 10, ["l_partkey"], True).withColumn("side", F.lit("bottom")))


@query("""
WITH m AS (SELECT l_suppkey, count(*) AS configs, max(l_extendedprice) AS best_l_extendedprice FROM lineitem GROUP BY 1)
SELECT m.l_suppkey, m.configs, m.best_l_extendedprice, min(l.l_orderkey * 100 + l.l_linenumber) // 100 AS best_l_orderkey, CAST(min(l.l_orderkey * 100 + l.l_linenumber) % 100 AS INTEGER) AS best_l_linenumber
FROM m JOIN lineitem l ON l.l_suppkey = m.l_suppkey AND l.l_extendedprice = m.best_l_extendedprice GROUP BY 1, 2, 3""")
def best_configuration(table):
    """Each supplier's largest price and the line that has it."""
    return stats.best_by(table("lineitem"), ["l_suppkey"], "l_extendedprice", ["l_orderkey", "l_linenumber"])


@query("""
WITH g AS (SELECT l_suppkey, l_linenumber, l_linestatus, avg(l_quantity) AS q, avg(l_extendedprice) AS p FROM lineitem GROUP BY ALL),
j AS (SELECT a.q / b.q AS q, a.p / b.p AS p FROM g a JOIN g b USING (l_suppkey, l_linenumber) WHERE a.l_linestatus = 'F' AND b.l_linestatus = 'O')
SELECT count(*) AS matched, round(avg(q), 6) AS q_speedup_mean, round(median(q), 6) AS q_speedup_median, CAST(count_if(q < 1) AS BIGINT) AS q_below_one,
  round(avg(p), 6) AS p_speedup_mean, round(median(p), 6) AS p_speedup_median, CAST(count_if(p < 1) AS BIGINT) AS p_below_one FROM j""")
def compare_two_modes(table):
    """Configurations that both modes have, joined on their keys."""
    each = table("lineitem").groupBy("l_suppkey", "l_linenumber", "l_linestatus").agg(F.avg("l_quantity").alias("q"), F.avg("l_extendedprice").alias("p"))
    out = stats.compare_modes(each, ["l_suppkey", "l_linenumber"], "l_linestatus", "F", "O", ["q", "p"])
    return _rounded(out, 6, "q_speedup_mean", "q_speedup_median", "p_speedup_mean", "p_speedup_median")


@query("""
WITH x AS (SELECT CASE WHEN l_tax >= greatest(l_discount, l_quantity / 500, l_tax) THEN 'd2h' WHEN l_discount >= greatest(l_discount, l_quantity / 500, l_tax) THEN 'h2d' ELSE 'kernel' END AS bottleneck FROM lineitem)
SELECT bottleneck, count(*) AS configs, round(100.0 * count(*) / (SELECT count(*) FROM x), 6) AS share_pct FROM x GROUP BY 1""")
def bottleneck_shares(table):
    """Which of three times dominates, the last named winning ties."""
    rows = table("lineitem").select((F.col("l_quantity") / 500).alias("kernel_ms"), F.col("l_discount").alias("h2d_ms"), F.col("l_tax").alias("d2h_ms"))
    return _rounded(stats.bottlenecks(rows, {"kernel": "kernel_ms", "h2d": "h2d_ms", "d2h": "d2h_ms"}), 6, "share_pct")


@query("""
SELECT 'l_linenumber' AS parameter, CAST(l_linenumber AS VARCHAR) AS value, count(*) AS configs, round(avg(l_quantity), 6) AS avg_l_quantity FROM lineitem GROUP BY 2
UNION ALL SELECT 'l_returnflag', l_returnflag, count(*), round(avg(l_quantity), 6) FROM lineitem GROUP BY 2
UNION ALL SELECT 'l_linestatus', l_linestatus, count(*), round(avg(l_quantity), 6) FROM lineitem GROUP BY 2""")
def parameter_impact(table):
    """Means by each value of each parameter, in one pass."""
    return _rounded(stats.by_parameter(table("lineitem"), ["l_linenumber", "l_returnflag", "l_linestatus"], ["l_quantity"]), 6, "avg_l_quantity")


@query("""
WITH e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS t, value, lag(value) OVER w AS v0, lag(epoch_us(ts) / 1e6) OVER w AS t0, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
d AS (SELECT user_id, greatest(t - t0, 1e-9) AS dt, CASE WHEN v0 IS NULL OR value IS NULL THEN 0.0 WHEN value >= v0 THEN value - v0 ELSE 1000.0 - v0 + value END AS de,
  CASE WHEN v0 IS NOT NULL AND value IS NOT NULL THEN greatest((v0 + value) * 0.5, 0) * greatest(t - t0, 1e-9) END AS area FROM e WHERE n > 1)
SELECT user_id, count(*) AS intervals, round(sum(de), 4) AS energy, round(sum(area), 2) AS area FROM d GROUP BY user_id""")
def counter_intervals(table):
    """Growth of a counter that wraps at 1000, and the trapezoid integral, between a user's events."""
    rows = table("events").select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("t"), "value", F.col("value").alias("power"))
    each = telemetry.intervals(rows, "user_id", "t", ["event_id"], {"value": 1000.0}, ["power"])
    return each.groupBy("user_id").agg(F.count("*").alias("intervals"), F.round(F.sum("value_delta"), 4).alias("energy"), F.round(F.sum("power_area"), 2).alias("area"))


@query("""
WITH s AS (SELECT user_id, count(*) AS samples, max(epoch_us(ts) / 1e6) - min(epoch_us(ts) / 1e6) AS span, avg(CASE WHEN value > 0 THEN value END) AS level FROM events GROUP BY 1),
e AS (SELECT user_id, epoch_us(ts) / 1e6 AS t, value, lag(value) OVER w AS v0, lag(epoch_us(ts) / 1e6) OVER w AS t0, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
d AS (SELECT user_id, sum(greatest((v0 + value) * 0.5, 0) * greatest(t - t0, 1e-9)) AS area, max(greatest((v0 + value) * 0.5, 0)) AS peak FROM e WHERE n > 1 GROUP BY 1)
SELECT s.user_id, s.samples, round(CASE WHEN s.samples = 1 THEN 0 ELSE greatest(s.span, 1e-9) END, 3) AS elapsed_s,
  round(CASE WHEN s.samples = 1 THEN coalesce(level, 0) WHEN peak > 0 THEN peak ELSE 0 END, 4) AS pkg_peak_w,
  round(CASE WHEN s.samples = 1 THEN coalesce(level, 0) WHEN area > 0 THEN area / greatest(s.span, 1e-9) ELSE coalesce(level, 0) END, 4) AS pkg_avg_w
FROM s LEFT JOIN d USING (user_id)""")
def power_summary(table):
    """Peak and average power of each run of samples."""
    rows = table("events").select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("t"), F.lit(None).cast("double").alias("energy"), F.col("value").alias("power"))
    out = telemetry.summary(rows, "user_id", "t", ["event_id"], {"pkg": ("energy", "power", 0.0)})
    return _rounded(_rounded(out, 4, "pkg_peak_w", "pkg_avg_w"), 3, "elapsed_s").select("user_id", "samples", "elapsed_s", "pkg_peak_w", "pkg_avg_w")


@query("""
WITH e AS (SELECT user_id, epoch_us(ts) / 1e6 AS t, value, first_value(value) OVER w AS v0, last_value(value) OVER w AS v1, first_value(epoch_us(ts) / 1e6) OVER w AS t0, last_value(epoch_us(ts) / 1e6) OVER w AS t1,
  row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT user_id, round(greatest(t1 - t0, 1e-9), 3) AS elapsed_s, round(CASE WHEN v1 >= v0 THEN v1 - v0 ELSE 1000.0 - v0 + v1 END, 4) AS cpu_energy_j,
  round((v0 + v1 - 100) * 0.5 * greatest(t1 - t0, 1e-9), 2) AS gpu_energy_j FROM e WHERE n = 1""")
def snapshot_difference(table):
    """Energy between a run's first and last snapshot: by a counter that wraps, and by power as it is, below 0 too."""
    rows = table("events").select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("t"), "value", (F.col("value") - 50).alias("power"), F.lit(None).cast("double").alias("none"))
    out = telemetry.difference(rows, "user_id", "t", ["event_id"], {"cpu": ("value", "none", 1000.0), "gpu": ("none", "power", 0.0)})
    return _rounded(_rounded(_rounded(out, 3, "elapsed_s"), 4, "cpu_energy_j"), 2, "gpu_energy_j")


@query("SELECT user_id, coalesce(min(CASE WHEN value > 0 THEN value END), 0.0) AS idle_w FROM events GROUP BY user_id")
def idle_power(table):
    return telemetry.idle_power(table("events"), "user_id", "value")


@query("""
SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS size, CAST(coalesce(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset"
FROM lineitem""")
def running_offsets(table):
    """Offsets of blocks from the sizes before them."""
    rows = table("lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("size"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("at"))
    return blocks.offsets(rows, ["l_orderkey"], "size", "at").drop("at")


@query("""
WITH c AS (SELECT DISTINCT CAST(p_size * 100 AS VARCHAR) || 'mhz' AS cpu FROM part WHERE p_size <= 5), g AS (SELECT r_name AS gpu FROM region), r AS (SELECT unnest(['0', '0.3', '1', 'adaptive']) AS ratio)
SELECT 'cpu' AS label, cpu, 'NA' AS gpu FROM c UNION SELECT 'gpu', 'NA', gpu FROM g
UNION SELECT 'hybrid_ratio_' || ratio, CASE WHEN ratio = '1' THEN 'NA' ELSE cpu END, CASE WHEN ratio = '0' THEN 'NA' ELSE gpu END FROM r, c, g""")
def sweep_items(table):
    """Engines by frequency points, without repeats."""
    cpu = table("part").where("p_size <= 5").select(X.frequency_point(F.concat((F.col("p_size") * 100).cast("string"), F.lit("MHz")))["label"].alias("label")).distinct()
    gpu = table("region").select(F.col("r_name").alias("label"))
    ratios = table("region").sparkSession.createDataFrame([("0",), ("0.3",), ("1",), ("adaptive",)], "ratio string")
    return sweeps.work_items(ratios, cpu, gpu)


@query("""
SELECT p_partkey, CAST(p_size * 1000 AS BIGINT) AS n,
  CASE WHEN p_size * 1000 < 1024 THEN printf('%.2f', p_size * 1000.0) ELSE printf('%.2fK', p_size * 1000.0 / 1024) END AS human,
  CAST(p_size * 1024 AS BIGINT) AS parsed, CAST(greatest(1, p_size - 1 - p_size // 8) AS BIGINT) AS workers,
  CAST(p_size + CASE WHEN p_size >= 15 THEN 1 + (p_size - 15) // 255 ELSE 0 END AS BIGINT) AS literals,
  CAST(3 + p_size + CASE WHEN p_size >= 15 THEN 1 + (p_size - 15) // 255 ELSE 0 END + CASE WHEN p_size * 10 >= 19 THEN 1 + (p_size * 10 - 19) // 255 ELSE 0 END AS BIGINT) AS sequence,
  CASE WHEN p_size % 2 = 0 THEN 'decompress' ELSE 'compress' END AS mode
FROM part""")
def scalar_arithmetic(table):
    """Sizes for people, parsed sizes, workers, prices and modes."""
    n = F.col("p_size").cast("long") * 1000
    name = F.concat(F.lit("a/b"), F.when(F.col("p_size") % 2 == 0, ".lz").otherwise(""))
    return table("part").select(
        "p_partkey", n.alias("n"), X.human_size(n).alias("human"), X.parse_size(F.concat(F.col("p_size").cast("string"), F.lit("KiB"))).alias("parsed"), X.workers_of("p_size").cast("long").alias("workers"),
        X.literals_price("p_size").alias("literals"), X.sequence_price("p_size", F.col("p_size") * 10).alias("sequence"), X.mode_of_name(name).alias("mode"),
    )


@query("""
WITH n AS (SELECT l_orderkey, count(*) AS blocks FROM lineitem GROUP BY 1),
f AS (SELECT l_orderkey, CASE WHEN blocks < 2 THEN blocks - CAST(floor(blocks * 0.7 + 0.5) AS BIGINT) ELSE least(greatest(blocks - CAST(floor(blocks * 0.7 + 0.5) AS BIGINT), 1), blocks - 1) END AS first, blocks FROM n)
SELECT l_orderkey, first AS gpu_blocks, blocks - first AS cpu_blocks FROM f""")
def device_split(table):
    """Blocks between two devices at a ratio of 0.3, each device getting one at least."""
    return sweeps.split_counts(table("lineitem"), ["l_orderkey"], 0.3)


@query("""
WITH n AS (SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_orderkey) AS blocks, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS block_no FROM lineitem),
f AS (SELECT *, CASE WHEN blocks < 2 THEN blocks - CAST(floor(blocks * 0.4 + 0.5) AS BIGINT) ELSE least(greatest(blocks - CAST(floor(blocks * 0.4 + 0.5) AS BIGINT), 1), blocks - 1) END AS first FROM n)
SELECT l_orderkey, CAST(block_no AS INTEGER) AS block_no, l_linenumber, CASE WHEN block_no < first THEN 'gpu' ELSE 'cpu' END AS device FROM f""")
def device_plan(table):
    """Which device gets which block at a ratio of 0.6."""
    place = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")) - 1
    rows = table("lineitem").select("l_orderkey", "l_linenumber", place.alias("block_no"))
    return sweeps.split_plan(rows, ["l_orderkey"], 0.6).select("l_orderkey", "block_no", "l_linenumber", "device")


@query("SELECT CAST(item_id AS VARCHAR) AS sample, engine, CAST(accel AS INTEGER) AS accel, CAST(2 AS BIGINT) AS rounds, true AS verify_all, octet_length(encode(text)) AS input_bytes, true AS bounded FROM benchmark, (SELECT unnest(['block', 'frame', 'linked', 'legacy', 'container', 'dictionary']) AS engine), (SELECT unnest([-3, 2, 9]) AS accel)")
def level_sweep(table):
    """Each item by each strategy and level, warmed up, twice timed and verified; of the speeds only that there are any."""
    rows = table("benchmark")
    raw = bench.sweep(rows, "item_id", "text", bench.strategies(dictionary_from(rows, "text", "item_id")), [-3, 2, 9], rounds=2)
    bounded = (F.col("compressed_bytes") <= F.col("input_bytes") + F.col("input_bytes") / 255 + 64) & (F.col("comp_mbs_median") > 0) & (F.col("dec_mbs_best") >= F.col("dec_mbs_median"))
    return bench.summarize(raw).select("sample", "engine", "accel", "rounds", "verify_all", "input_bytes", bounded.alias("bounded"))


@query("""
SELECT engine, accel, count(*) AS samples, true AS verify_all, CAST(sum(octet_length(encode(text))) AS BIGINT) AS input_bytes, true AS rounds, true AS timed
FROM benchmark, (SELECT unnest(['block', 'frame']) AS engine), (SELECT unnest(['0', '3']) AS accel) GROUP BY ALL""")
def cases_by_engine(table):
    """One bench and six manual rounds of each item, engine and level, summed up by file and then by configuration; of the speeds only that there are any."""
    own = bench.strategies()
    raw = bench.run_cases(table("benchmark"), "item_id", "text", {k: own[k] for k in ("block", "frame")}, [0, 3])
    files = stats.per_file_summary(raw)
    whole = stats.aggregate_summary(files)
    timed = F.least(*[F.col(f"{m}_{k}_of_files") for m in ("comp_mbs", "dec_mbs", "e2e_comp_mbs", "e2e_dec_mbs") for k in ("median", "mean")]) > 0
    counted = files.groupBy("engine", "accel").agg(F.sum("input_bytes").alias("input_bytes"), F.bool_and((F.col("bench_rounds") == 1) & (F.col("manual_rounds") == 6) & (F.col("comp_mbs_n") == 6)).alias("rounds"))
    return whole.select("engine", "accel", "samples", "verify_all", timed.alias("timed")).join(counted, ["engine", "accel"])


@query("SELECT CAST(item_id AS VARCHAR) AS sample, function, true AS ok FROM benchmark, (SELECT unnest(['encode_fast', 'encode_fast_accelerated', 'encode_mid', 'encode_high', 'encode_with_history', 'encode_into', 'encode_frame', 'decode', 'decode_partial', 'decode_frame', 'list_frame', 'hash32', 'hash64']) AS function)")
def function_times(table):
    """Single functions of the kernels on each item: right, and in measurable time."""
    timed = bench.time_functions(table("benchmark"), "item_id", "text")
    return timed.select("sample", "function", (F.col("ok") & (F.col("mbs") > 0)).alias("ok"))


@query("""
SELECT p_partkey, CAST(23 + p_size * 1000 + greatest(ceil(p_size * 1000 / 65536.0), 0) * 8 + 4 AS BIGINT) AS bound, CAST(floor(3 * p_size / 8) AS BIGINT) AS first, CAST(floor(4 * p_size / 8) AS BIGINT) AS last,
  CASE WHEN p_size % 3 = 0 THEN 'c.bin' ELSE 'b' END AS name, [1, p_size] AS items, round(p_size * 1000 / 1048576.0, 6) AS mb,
  CAST(least(greatest(p_size, 32), 4194304) AS INTEGER) AS clamped, 11000 AS version, '1.10.0' AS version_name FROM part""")
def bounds_and_names(table):
    """Frame bounds, ranges of blocks, base names, lists, megabytes, clamped sizes and versions."""
    n = F.col("p_size") * 1000
    path = F.when(F.col("p_size") % 3 == 0, "x\\y\\c.bin").otherwise("a\\x/b")
    both = X.range_bounds(F.lit(3), F.lit(8), F.col("p_size"))
    return table("part").select(
        "p_partkey", X.frame_bound(n, 4, True, True).alias("bound"), both["first"].alias("first"), both["last"].alias("last"), X.base_name(path).alias("name"),
        X.parse_list(F.concat(F.lit(" 1,, "), F.col("p_size").cast("string"), F.lit(" ,")), "int").alias("items"), F.round(X.megabytes(n), 6).alias("mb"), X.clamp_block_size("p_size").alias("clamped"),
        X.version_number().alias("version"), X.version_string().alias("version_name"),
    )


@query("SELECT n_nationkey, n_name, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE n_nationkey / 4.0 END AS ms FROM nation")
def results_as_csv(table):
    """Results written as CSV and read back: missing numbers stay missing."""
    rows = table("nation").select("n_nationkey", "n_name", F.when(F.col("n_nationkey") % 3 != 0, F.col("n_nationkey") / 4.0).alias("ms"))
    folder = work_folder(rows.sparkSession, "results")
    write_results(rows, folder, ["n_nationkey", "n_name", "ms", "lacking"])
    back = read_results(rows.sparkSession, folder, ["n_nationkey", "ms"])
    return back.where("lacking is null").select(F.col("n_nationkey").cast(rows.schema["n_nationkey"].dataType).alias("n_nationkey"), "n_name", "ms")


@query("SELECT event_id, CAST(value AS DOUBLE) AS last_value, greatest(value - least(10, value * 0.95), 0) AS net_w FROM events WHERE value > 0")
def log_numbers(table):
    """The last number of a log line, and power net of idle power."""
    log = F.concat(F.lit("throughput: 1.5 MB/s; throughput: "), F.col("value").cast("decimal(20,6)").cast("string"))
    value = X.last_number(log, "throughput")
    return table("events").where("value > 0").select("event_id", value.alias("last_value"), X.net_power("value", F.lit(10.0)).alias("net_w"))


@query("""
WITH d AS (SELECT doc_id, encode(text) AS b FROM documents WHERE octet_length(encode(coalesce(text, ''))) >= 4),
g AS (SELECT doc_id, b[i:i+3] AS gram FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - 2)) AS i FROM d)),
c AS (SELECT doc_id, gram, count(*) AS n FROM g GROUP BY ALL)
SELECT doc_id, CAST(sum(n) AS BIGINT) AS places, CAST(sum(n - 1) AS BIGINT) AS repeats FROM c GROUP BY doc_id""")
def repeated_grams(table):
    """Places whose four bytes occurred before in the document."""
    return blocks.match_candidates(table("documents").select("doc_id", _bytes().alias("data")), "doc_id", "data")


@query("""
WITH i AS (SELECT item_id, md5(text) AS m, octet_length(encode(text)) AS n FROM benchmark)
SELECT item_id, n AS n_bytes, 'B4I' AS label, 1 AS blocks FROM i""")
def frames_in_sql(table):
    """Frames made and listed by the registered SQL functions."""
    df = table("benchmark")
    X.register(df.sparkSession)
    df.selectExpr("item_id", "frame_encode(encode(text, 'UTF-8')) AS packed").createOrReplaceTempView("_packed_items")
    return df.sparkSession.sql("SELECT item_id, cast(octet_length(frame_decode(packed)) AS bigint) AS n_bytes, f.label, f.blocks FROM _packed_items, LATERAL frame_list(packed) f")


@query("""
WITH d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n FROM documents)
SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'header_checksum_invalid' WHEN doc_id % 5 = 1 THEN 'truncated' END AS error, 4 AS block_id, n <= 1000 AS independent, true AS block_checksum, false AS content_checksum,
  n AS content_size, CASE WHEN doc_id % 5 <> 1 THEN CAST(77 AS BIGINT) END AS dict_id FROM d""")
def header_predicates(table):
    """Header fields and checks of frames, some with a damaged or cut header, by built-in functions."""
    options = frames.Options(7, False, True, False, True, 77, block_size=1000)
    packed = table("documents").select("doc_id", X.frame_encode(_bytes(), options).alias("packed"))
    kind, wrong = F.col("doc_id") % 5, F.when(F.expr("substring(packed, 19, 1)") == F.lit(b"\0"), F.lit(b"\1")).otherwise(F.lit(b"\0"))
    damaged = F.concat(F.substring("packed", F.lit(1), F.lit(18)), wrong, F.expr("substring(packed, 20)"))
    content = F.when(kind == 0, damaged).when(kind == 1, F.substring("packed", F.lit(1), F.lit(15))).otherwise(F.col("packed"))
    h = packed.select("doc_id", content.alias("content")).select("doc_id", X.header_fields("content").alias("h"))
    return h.select("doc_id", "h.error", "h.block_id", "h.independent", "h.block_checksum", "h.content_checksum", F.col("h.content_size").cast("long").alias("content_size"), "h.dict_id")


@query(_XXH32_SQL)
def hash32_of_pieces(table):
    """The same hashes folded over ordered pieces of 5 bytes."""
    pieces = blocks.split(table("nation").select("n_name", F.encode("n_name", "UTF-8").alias("data")), "data", 5, ("n_name",))
    return blocks.fold_hash(pieces, ["n_name"])


@query("""
SELECT conv_id, CAST(count(*) AS BIGINT) AS messages, CAST(sum(octet_length(encode(coalesce(text, '')))) AS BIGINT) AS raw_bytes FROM conversations GROUP BY conv_id""")
def streamed_frames(table):
    """Conversations as a stream into one frame for each key and micro-batch, read back."""
    from tessera.streaming import frame_sink

    rows = table("conversations")
    spark = rows.sparkSession
    folder = work_folder(spark, "stream")
    rows.select("conv_id", "turn", "text").write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{folder}/in").schema).parquet(f"{folder}/in")
    frame_sink(stream, "conv_id", "turn", "text", f"{folder}/out", f"{folder}/checkpoint", once=True).awaitTermination()
    back = spark.read.parquet(f"{folder}/out").select("conv_id", "messages", F.octet_length(X.frame_decode("content", strict=True)).alias("n"))
    return back.groupBy("conv_id").agg(F.sum("messages").alias("messages"), F.sum("n").cast("long").alias("raw_bytes"))


@query("SELECT CAST(sum(octet_length(encode(coalesce(text, '')))) AS BIGINT) AS raw_bytes, CAST(sum(octet_length(encode(coalesce(text, '')))) AS BIGINT) AS listed_bytes, true AS ok FROM documents WHERE text <> ''")
def whole_files(table):
    """Files of frames with content sizes on disk, read whole: tested, decoded and listed."""
    df = table("documents").where("text <> ''")
    spark = df.sparkSession
    register_source(spark)
    folder = work_folder(spark, "whole-files")
    rows = df.select(F.lit("").alias("path"), F.lit(0).alias("frame_no"), F.lit("").alias("kind"), F.lit(0).cast("long").alias("content_size"), _bytes().alias("data"))
    rows.write.format("tessera_frames").mode("append").option("contentSize", "true").save(folder)
    files = read_files(spark, folder, glob="part-*")
    listed = files_of.list_files(files_of.list_frames(files)).agg(F.sum("uncompressed").alias("listed_bytes"))
    tested = files_of.test_files(files).agg(F.bool_and("ok").alias("ok"))
    decoded = files.select(X.frame_decode("content").alias("back")).agg(F.sum(F.octet_length("back")).alias("raw_bytes"))
    return decoded.crossJoin(listed).crossJoin(tested)


@query("SELECT range AS row_id, 2000 AS n_bytes, true AS ok, true AS shorter FROM range(50)")
def generated_words(table):
    """Seeded words, packed and unpacked, smaller by higher levels."""
    made = generated(table("region").sparkSession, 50, 2000, kind="words").withColumns({"low": X.block_encode("data"), "high": X.block_encode("data", level=9)})
    ok = (X.block_decode("low") == F.col("data")) & (X.block_decode("high") == F.col("data"))
    return made.select("row_id", F.octet_length("data").alias("n_bytes"), ok.alias("ok"), (F.octet_length("high") <= F.octet_length("low")).alias("shorter"))


@query("""
SELECT conv_id, count(*) AS messages, CAST(sum(octet_length(encode(coalesce(text, '')))) AS BIGINT) AS raw_bytes, count(*) AS numbers FROM conversations GROUP BY conv_id""")
def streamed_links(table):
    """Conversations as a stream of linked messages behind a dictionary, its state kept by key, read back."""
    from tessera.streaming import linked_stream

    rows, words = table("conversations").select("conv_id", "turn", "text"), dictionary_from(table("benchmark"), "text", "item_id")
    spark = rows.sparkSession
    folder = work_folder(spark, "links")
    rows.write.parquet(f"{folder}/in")
    out = linked_stream(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"), "conv_id", "turn", "text", dictionary=words)
    out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    back = blocks.unlinked_streams(spark.read.schema(out.schema).parquet(f"{folder}/out"), "conv_id", "turn", dictionary=words)
    return back.groupBy("conv_id").agg(F.count("*").alias("messages"), F.sum(F.octet_length("message")).alias("raw_bytes"), (F.max("seq") + 1).alias("numbers"))


@query("SELECT range AS row_id, 3000 AS n_bytes, true AS ok FROM range(100)")
def generated_noise(table):
    """Seeded noise, packed and unpacked."""
    made = generated(table("region").sparkSession, 100, 3000, 0.6)
    ok = X.block_decode(X.block_encode("data")) == F.col("data")
    return made.select("row_id", F.octet_length("data").alias("n_bytes"), ok.alias("ok"))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
