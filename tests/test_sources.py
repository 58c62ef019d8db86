import pytest
from pyspark.sql import functions as F

from tessera import functions as X
from tessera import sources
from tessera.kernels import block, frames, generators
from tessera.streaming import frame_sink, linked_stream


def test_frame_source(spark, tmp_path):
    sources.register(spark)
    folder = f"file://{tmp_path}/frames"
    df = spark.createDataFrame([(bytearray(f"row {i} ".encode() * 20),) for i in range(20)], "data binary").repartition(3)
    df.selectExpr("'x' AS path", "0 AS frame_no", "'k' AS kind", "0L AS content_size", "data").write.format("tessera_frames").mode("append").save(folder)
    (tmp_path / "frames" / "more").write_bytes(frames.encode(b"one") + frames.skippable(b"..") + frames.encode(b"two", frames.Options(content_size=True)))
    got = spark.read.format("tessera_frames").load(folder)
    assert got.where("kind = 'skippable'").count() == 1
    assert got.select(F.sum(F.octet_length("data"))).first()[0] == sum(len(f"row {i} " * 20) for i in range(20)) + 6
    heads = spark.read.format("tessera_frames").option("payload", "false").load(folder)
    assert heads.where("data is not null").count() == 0 and heads.count() == got.count()
    df.selectExpr("'x' AS path", "0 AS frame_no", "'k' AS kind", "0L AS content_size", "data").limit(1).write.format("tessera_frames").mode("overwrite").save(folder)
    assert spark.read.format("tessera_frames").load(folder).count() == 1


def test_frames_stream_block_by_block(spark, tmp_path):
    sources.register(spark)
    folder, raw = f"file://{tmp_path}/frames", [generators.words(70_000, k).encode() for k in range(4)]
    df = spark.createDataFrame([(k, bytearray(d)) for k, d in enumerate(raw)], "id int, data binary").coalesce(1).sortWithinPartitions("id")
    columns = "'x' AS path", "0 AS frame_no", "'k' AS kind", "0L AS content_size", "data"
    df.selectExpr(*columns).write.format("tessera_frames").mode("append").option("blockSize", 10_000).option("independent", "false").save(folder)
    df.selectExpr(*columns).write.format("tessera_frames").mode("append").option("contentSize", "true").save(folder)
    whole = spark.read.format("tessera_frames").load(folder).collect()
    assert [bytes(r["data"]) for r in whole] == [b"".join(raw)] * 2 and sorted(r["content_size"] or 0 for r in whole) == [0, 280_000]
    each = spark.read.format("tessera_frames").option("rows", "blocks").load(folder).where("content_size is null").orderBy("block_no").collect()
    assert b"".join(bytes(r["data"]) for r in each) == b"".join(raw) and max(len(r["data"]) for r in each) == 10_000 and [r["block_no"] for r in each] == list(range(28))
    heads = spark.read.format("tessera_frames").option("rows", "blocks").option("payload", "false").load(folder)
    assert heads.where("data is null").count() == heads.count() == 28 + 1


def test_results_come_back(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5, None), ("b, c", None, "x")], "sample string, ms double, note string")
    sources.write_results(df, f"{tmp_path}/r", ["sample", "ms", "lacking", "note"])
    assert [line for f in (tmp_path / "r").glob("*.csv") for line in f.read_text().splitlines()][0] == "sample,ms,lacking,note"
    back = sources.read_results(spark, f"{tmp_path}/r", ["ms"]).orderBy("sample").collect()
    assert [(r["sample"], r["ms"], r["lacking"], r["note"]) for r in back] == [("a", 1.5, None, None), ("b, c", None, None, "x")]


def test_dictionaries_of_columns(spark):
    df = spark.createDataFrame([(k, "w%d " % k * 2000) for k in range(20)] + [(99, None)], "id int, text string").repartition(3)
    whole = "\n".join([("w%d " % k * 2000) for k in range(20)] + [""]).encode()
    assert sources.dictionary_from(df, "text", "id") == whole[-65536:]
    assert sources.dictionary_from(df.limit(0), "text", "id") == b""


def test_a_bad_file_is_an_error(spark, tmp_path):
    sources.register(spark)
    (tmp_path / "bad").write_bytes(frames.encode(b"abc")[:-2])
    with pytest.raises(Exception, match="truncated"):
        spark.read.format("tessera_frames").load(f"file://{tmp_path}/bad").collect()


def test_whole_files(spark, tmp_path):
    for name, data in (("b.lz", frames.encode(b"bbb")), ("a.txt", b"plain"), ("dict", b"w" * 70_000)):
        (tmp_path / name).write_bytes(data)
    files = sources.read_files(spark, str(tmp_path))
    assert [r["path"].split("/")[-1] for r in sources.sample_files(files, 2).collect()] == ["a.txt", "b.lz"]
    assert sources.sample_files(files, single="b.lz").select(X.frame_decode("content")).first()[0] == b"bbb"
    assert sources.dictionary_of(spark, str(tmp_path / "dict")) == b"w" * 65536
    (tmp_path / "r.csv").write_text("sample,ms\na,1.5\nb,NA\nc,oops\n")
    rows = sources.read_results(spark, str(tmp_path / "r.csv"), ["ms"]).orderBy("sample").collect()
    assert [r["ms"] for r in rows] == [1.5, None, None]


def test_generated_rows_do_not_depend_on_partitions(spark):
    one = sources.generated(spark, 6, 500, seed=3).orderBy("row_id").collect()
    assert [bytes(r["data"]) for r in one] == [generators.noise(500, 3 + i) for i in range(6)]
    assert sources.generated(spark, 2, 300, kind="words").first()["data"] is not None


@pytest.fixture()
def stream(spark, tmp_path):
    rows = [(k, t, f"turn {t} of {k} " * 10) for k in range(3) for t in range(8)]
    for part in (0, 1):
        spark.createDataFrame([r for r in rows if r[1] // 4 == part], "k long, t long, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return rows, spark.readStream.schema("k long, t long, text string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


def test_a_frame_for_each_batch_and_key(spark, tmp_path, stream):
    rows, source = stream
    frame_sink(source, "k", "t", "text", f"{tmp_path}/out", f"{tmp_path}/check", once=True).awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").orderBy("k", "batch_id").collect()
    assert len(got) == 6 and sum(r["messages"] for r in got) == 24
    texts = {}
    for r in got:
        texts[r["k"]] = texts.get(r["k"], b"") + frames.decode(bytes(r["content"]))
    assert all(sorted(texts[k].decode().split("turn ")[1:]) == sorted("".join(x for i, _, x in rows if i == k).split("turn ")[1:]) for k in texts)


def test_linked_streams_keep_state_between_batches(spark, tmp_path, stream):
    rows, source = stream
    out = linked_stream(source, "k", "t", "text")
    query = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(r["k"], r["t"]): bytes(r["packed"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert len(got) == len(rows)
    from tessera.operators import blocks

    back = blocks.unlinked_streams(spark.read.parquet(f"{tmp_path}/out"), "k", "t").collect()
    assert {(r["k"], r["t"]): bytes(r["message"]).decode() for r in back} == {(k, t): x for k, t, x in rows}
    assert sorted((r["k"], r["seq"]) for r in back) == [(k, i) for k in range(3) for i in range(8)]
    text = {(k, t): x.encode() for k, t, x in rows}
    for k in range(3):
        for halves in ((range(4), range(4, 8)), (range(4, 8), range(4))):  # either file may have come first
            history, ok = b"", True
            for t in (*halves[0], *halves[1]):
                try:
                    ok = ok and block.decode(got[k, t], history=history) == text[k, t]
                except block.BlockError:
                    ok = False
                history = (history + text[k, t])[-65536:]
            if ok:
                break
        assert ok


@pytest.mark.parametrize("sized", ["true", "false"])
def test_written_files_are_bounded(spark, tmp_path, sized):
    """A task's rows go to files of so many bytes, and blocks are read by batches of bounded bytes."""
    from tessera.sources import frame_source, register

    register(spark)
    texts = [(f"{k} " * 400).encode() for k in range(200)]
    df = spark.createDataFrame([("", 0, "", 0, bytearray(t)) for t in texts], "path string, frame_no int, kind string, content_size long, data binary").coalesce(1)
    df.write.format("tessera_frames").mode("append").option("contentSize", sized).option("fileBytes", "50000").option("blockSize", "1000").save(str(tmp_path / "out"))
    back = spark.read.format("tessera_frames").load(str(tmp_path / "out")).collect()
    assert len(back) > 4 and max(len(r["data"]) for r in back) <= 50_000 + max(map(len, texts))
    assert sorted(b"".join(bytes(r["data"]) for r in back)) == sorted(b"".join(texts))
    reader = frame_source.FrameReader({"path": str(tmp_path / "out"), "rows": "blocks"})
    held, frame_source.READ_BYTES = frame_source.READ_BYTES, 10_000
    try:
        sizes = [b.nbytes for p in reader.partitions() for b in reader.read(p)]
    finally:
        frame_source.READ_BYTES = held
    assert len(sizes) > 10 and max(sizes) < 12_000
