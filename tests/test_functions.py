import pytest
from pyspark.sql import functions as F

from tessera import functions as X
from tessera.kernels import block, frames, generators

RAW = [b"", b"a", b"hello " * 500, bytes(1000), generators.noise(5000, 1, 0.5), None]


@pytest.fixture(scope="module")
def cells(spark):
    return spark.createDataFrame([(i, None if r is None else bytearray(r)) for i, r in enumerate(RAW)], "id int, data binary").cache()


def _column(df, c):
    return [r[0] if r[0] is None else bytes(r[0]) if isinstance(r[0], (bytes, bytearray)) else r[0] for r in df.orderBy("id").select(c).collect()]


def test_codecs_keep_cells(cells):
    assert _column(cells, X.block_decode(X.block_encode("data", level=4))) == RAW
    assert _column(cells, X.block_decode(X.block_encode("data", dictionary=b"hello " * 9), dictionary=b"hello " * 9)) == RAW
    assert _column(cells, X.frame_decode(X.frame_encode("data", frames.Options(4, False, True, True, True)))) == RAW
    assert _column(cells, X.frame_decode(X.legacy_encode("data"))) == RAW
    assert _column(cells, X.container_decode(X.container_encode("data", 700))) == [r or None for r in RAW]
    assert _column(cells, X.frame_decode(F.concat(X.frame_encode("data"), X.skippable_frame("data", 2)))) == RAW
    assert _column(cells, X.block_decode_partial(X.block_encode("data"), 7)) == [None if r is None else r[:7] for r in RAW]


def test_errors_are_data(spark):
    df = spark.createDataFrame([(1, bytearray(b"\x10a\x02\0")), (2, bytearray(b"\0")), (3, None)], "id int, data binary")
    assert _column(df, X.block_decode("data")) == [None, b"", None]
    assert _column(df, X.block_error("data")) == ["an offset outside the window at byte 2", None, None]
    assert _column(df, X.frame_error("data")) == ["unknown_format", "unknown_format", None]
    with pytest.raises(Exception, match="an offset outside the window"):
        df.select(X.block_decode("data", strict=True)).collect()


def test_rooms_and_hashes(cells):
    rows = cells.where("id = 2").select(X.block_encode_into("data", 20).alias("r")).first()["r"]
    assert len(rows["block"]) <= 20 and block.decode(bytes(rows["block"])) == RAW[2][: rows["consumed"]]
    import xxhash

    assert _column(cells, X.xxh32("data", 5)) == [None if r is None else xxhash.xxh32_intdigest(r, 5) for r in RAW]
    both = cells.where("data is not null")
    assert _column(both, X.xxh64("data", 42)) == [int.from_bytes(xxhash.xxh64_digest(r, 42), "big", signed=True) for r in RAW[:-1]]
    assert _column(cells, X.canonical(X.xxh32("data"))) == [None if r is None else xxhash.xxh32_hexdigest(r) for r in RAW]
    assert cells.where("id = 3").select(X.zero_runs("data")).first()[0][0].asDict() == {"start": 0, "length": 1000}


def test_header_fields(spark):
    cases = [frames.encode(b"abc", frames.Options(4, True, True, False, True, 7)), frames.encode(b""), b"plain text", b"", frames.encode(b"x")[:4] + b"\x80\x40\0"]
    df = spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(cases)], "id int, data binary")
    rows = [r[0].asDict() for r in df.orderBy("id").select(X.header_fields("data")).collect()]
    assert (rows[0]["block_id"], rows[0]["block_checksum"], rows[0]["content_size"], rows[0]["dict_id"], rows[0]["error"]) == (4, True, 3, 7, None)
    assert [r["error"] for r in rows] == [None, None, "wrong_magic", "truncated", "version_wrong"]


def test_sql_names(spark, cells):
    X.register(spark)
    cells.where("id < 3").createOrReplaceTempView("cells")
    rows = spark.sql("SELECT id, sum(lit_len) + sum(coalesce(match_len, 0)) n FROM cells, LATERAL block_sequences(block_encode(data)) GROUP BY id ORDER BY id").collect()
    assert [r["n"] for r in rows] == [0, 1, 3000]
    assert spark.sql("SELECT count(*) FROM cells, LATERAL frame_blocks(frame_encode(data))").first()[0] == 2
    assert spark.sql("SELECT bool_and(frame_decode(frame_encode(data)) = data AND frame_error(frame_encode(data)) IS NULL) FROM cells").first()[0]


@pytest.mark.parametrize(("column", "want"), [
    (lambda: X.compress_bound(F.lit(1000)), 1019), (lambda: X.compress_bound(F.lit(0x7E000001)), 0), (lambda: X.block_size_of(F.lit(6)), 1 << 20), (lambda: X.block_size_of(F.lit(3)), None),
    (lambda: X.fitting_block_id(F.lit(70000)), 5), (lambda: X.fitting_block_id(F.lit(10**9), 6), 6), (lambda: X.frame_bound(F.lit(0)), 27), (lambda: X.human_size(F.lit(500)), "500.00"), (lambda: X.human_size(F.lit(1536)), "1.50K"),
    (lambda: X.human_size(F.lit(5 << 30)), "5.00G"), (lambda: X.base_name(F.lit("a/b/c.x")), "c.x"), (lambda: X.base_name(F.lit("a\\b")), "b"), (lambda: X.parse_size(F.lit("4MiB")), 4 << 20), (lambda: X.parse_size(F.lit("12")), 12),
    (lambda: X.parse_size(F.lit("x")), None), (lambda: X.clamp_block_size(F.lit(5)), 32), (lambda: X.mode_of_name(F.lit("a.lz")), "decompress"), (lambda: X.container_member(F.lit("a.lz")), "a"), (lambda: X.container_member(F.lit("a")), "a.lz"),
    (lambda: X.is_skippable_magic(F.lit(0x184D2A5A)), True), (lambda: X.is_skippable_magic(F.lit(0x184D2204)), False), (lambda: X.ring_buffer_size(F.lit(5)), 65566), (lambda: X.acceleration_of_level(F.lit(-4)), 5),
    (lambda: X.ratio_pct(F.lit(5), F.lit(0)), None), (lambda: X.parse_list(F.lit(" 1, 2,,3"), "int"), [1, 2, 3]), (lambda: X.workers_of(F.lit(1)), 1), (lambda: X.workers_of(F.lit(64)), 55),
    (lambda: X.range_bounds(F.lit(1), F.lit(3), F.lit(10)), (3, 6)), (lambda: X.split_share(F.lit(10), F.lit(0.0)), 0), (lambda: X.split_share(F.lit(10), F.lit(1.0)), 10), (lambda: X.split_share(F.lit(10), F.lit(0.01)), 1),
    (lambda: X.split_share(F.lit(10), F.lit(0.99)), 9), (lambda: X.net_power(F.lit(10.0), F.lit(100.0)), 0.5), (lambda: X.net_power(F.lit(None), F.lit(1.0)), 0.0), (lambda: X.frequency_point(F.lit("50%")), ("percent", 50, "50pct")),
    (lambda: X.frequency_point(F.lit("NA")), ("none", None, "NA")), (lambda: X.frequency_point(F.lit("1900 MHz")), ("mhz", 1900, "1900mhz")), (lambda: X.last_number(F.lit("t: 1.5 t=2.5"), "t"), 2.5), (lambda: X.in_place_margin(F.lit(512)), 34),
])
def test_scalars(spark, column, want):
    got = spark.range(1).select(column()).first()[0]
    assert got == pytest.approx(want) if isinstance(want, float) else (tuple(got) if isinstance(want, tuple) else got) == want


def test_header_checks_are_those_of_the_decoder(spark):
    """Every header field and check by expressions, against the kernel."""
    import itertools

    rows = [(b"abc",), (b"abcdefghij",), (b"",)]
    for sized, name, independent, blocks, content in itertools.product((True, False), (None, 77, 0xFFFFFFF0), (True, False), (True, False), (True, False)):
        one = frames.encode(b"abc" * 30_000, frames.Options(4, independent, blocks, content, sized, name))
        size = next(frames.frames(one)).header_size
        damaged = bytearray(one)
        damaged[size - 1] ^= 1
        rows += [(one,), (bytes(damaged),), (one[: size - 1],), (one[:4] + b"\x44" + one[5:],), (one[:5] + b"\x30" + one[6:],), (one[:4] + bytes([one[4] ^ 2]) + one[5:],)]
    got = spark.createDataFrame([(bytearray(x),) for x, in rows], "c binary").select("c", X.header_fields("c").alias("h")).collect()
    for r in got:
        data, told = bytes(r["c"]), r["h"]["error"]
        try:
            f = next(frames.frames(data, decode=False))
            assert told is None and (r["h"]["block_id"], r["h"]["independent"], r["h"]["block_checksum"], r["h"]["content_checksum"], r["h"]["content_size"], r["h"]["dict_id"]) == (f.block_id, f.independent, f.block_checksum, f.content_checksum, f.content_size, f.dict_id)
        except (frames.FrameError, StopIteration) as e:
            assert told == ("truncated" if len(data) < 7 else "wrong_magic" if data[:1] == b"a" else e.code)
