import statistics

import pytest
from pyspark.sql import functions as F

from tessera.kernels import block, frames, generators
from tessera.operators import blocks, stats, sweeps, telemetry
from tessera.operators import frames as files_of


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, b""), (2, b"x" * 2500), (3, generators.noise(10_000, 2, 0.6)), (4, None), (5, bytes(1000))]
    return spark.createDataFrame([(i, None if d is None else bytearray(d)) for i, d in rows], "id int, data binary")


def test_blocks_split_pack_and_come_back(docs):
    each = blocks.encode(blocks.split(docs, "data", 1000, ("id",)))
    assert {r["id"]: r["n"] for r in each.groupBy("id").agg(F.count("*").alias("n")).collect()} == {1: 1, 2: 3, 3: 10, 5: 1}
    back = blocks.decode(each)
    assert back.where("not ok").count() == 0
    whole = {r["id"]: bytes(r["back"]) for r in blocks.assemble(back, ["id"], "back").collect()}
    assert whole == {r["id"]: bytes(r["data"]) for r in docs.collect() if r["data"] is not None}
    assert blocks.assemble(back, ["id"], "back").where("error is not null").count() == 0
    placed = blocks.offsets(each, ["id"], "packed_size").where("id = 3").orderBy("block_no").collect()
    assert [r["offset"] for r in placed] == [sum(p["packed_size"] for p in placed[:k]) for k in range(len(placed))]


def test_ranges_read_only_their_blocks(docs):
    packed = blocks.encode(blocks.split(docs, "data", 1000, ("id",))).select("id", "block_no", "packed")
    raw = {r["id"]: bytes(r["data"]) for r in docs.collect() if r["data"] is not None}
    for start, n in ((0, 10), (995, 10), (1500, 2000), (2400, 500)):
        got = {r["id"]: bytes(r["slice"]) for r in blocks.read_range(packed, ["id"], start, n, 1000).collect()}
        assert all(got.get(i, b"") == raw[i][start : start + n] for i in raw)
    assert blocks.covering(packed, 1500, 600, 1000).select("block_no").distinct().count() == 2


def test_blocks_out_of_order_are_errors(spark):
    rows = [("whole", 1, b"b"), ("whole", 0, b"a"), ("gap", 0, b"a"), ("gap", 2, b"c"), ("late", 1, b"b"), ("twice", 0, b"a"), ("twice", 0, b"a"), ("null", 0, None), ("null", 1, b"b"), ("empty", 0, b"")]
    df = spark.createDataFrame([(k, n, None if d is None else bytearray(d)) for k, n, d in rows], "k string, block_no int, raw binary")
    got = {r["k"]: (None if r["raw"] is None else bytes(r["raw"]), r["blocks"], r["error"]) for r in blocks.assemble(df, ["k"]).collect()}
    assert got == {
        "whole": (b"ab", 2, None), "gap": (None, 2, "a missing block"), "late": (None, 1, "a missing block"), "twice": (None, 2, "a repeated block"), "null": (None, 2, "a null block"), "empty": (b"", 1, None)
    }
    assert {r["k"]: r["error"] for r in blocks.assemble(df, ["k"], whole=False).collect()}["late"] is None


def test_streams_of_equal_order_survive_files(spark, tmp_path):
    """With one order for all messages, what was written and read again decodes to the same messages; a dictionary helps."""
    words = generators.words(3000, 1).encode()
    rows = [(k, 0, f"{i} {words[50 * i : 50 * i + 300].decode()}") for k in range(3) for i in range(9)]
    df = spark.createDataFrame(rows, "k int, t int, text string").repartition(4)
    for level in (0, 2, 9):
        packed = blocks.linked_streams(df, "k", "t", "text", level=level, dictionary=words)
        packed.orderBy(F.rand(3)).write.mode("overwrite").parquet(f"{tmp_path}/p{level}")
        back = blocks.unlinked_streams(spark.read.parquet(f"{tmp_path}/p{level}"), "k", "t", dictionary=words).collect()
        assert sorted((r["k"], bytes(r["message"]).decode()) for r in back) == sorted((k, x) for k, _, x in rows)
        plain = blocks.linked_streams(df, "k", "t", "text", level=level)
        assert packed.agg(F.sum(F.octet_length("packed"))).first()[0] < plain.agg(F.sum(F.octet_length("packed"))).first()[0]


def test_linked_streams(spark):
    rows = [(k, t, f"message {t} of {k}: " + "the same words again " * 5) for k in range(4) for t in range(6)] + [(9, 0, None), (9, 1, "")]
    df = spark.createDataFrame(rows, "k int, t int, text string").repartition(5)
    packed = blocks.linked_streams(df, "k", "t", "text")
    back = {(r["k"], r["t"]): bytes(r["message"]).decode() for r in blocks.unlinked_streams(packed, "k", "t").collect()}
    assert back == {(k, t): x or "" for k, t, x in rows}
    sizes = {r["t"]: len(r["packed"]) for r in packed.where("k = 1").collect()}
    assert sizes[5] < sizes[0]


def test_hash_over_pieces(docs):
    import xxhash

    pieces = blocks.split(docs, "data", 700, ("id",))
    raw = {r["id"]: bytes(r["data"]) for r in docs.collect() if r["data"] is not None}
    assert {r["id"]: r["hash"] for r in blocks.fold_hash(pieces, ["id"]).collect()} == {i: xxhash.xxh32_intdigest(d) for i, d in raw.items()}
    assert {r["id"]: int(r["hash"]) for r in blocks.fold_hash(pieces, ["id"], bits=64, seed=3).collect()} == {i: xxhash.xxh64_intdigest(d, 3) for i, d in raw.items()}


def test_sequences_and_candidates(docs):
    from tessera.functions import block_encode

    rows = blocks.sequence_rows(docs.select("id", block_encode("data").alias("packed")), "id", "packed").groupBy("id").agg((F.sum("lit_len") + F.coalesce(F.sum("match_len"), F.lit(0))).alias("n")).collect()
    assert {r["id"]: r["n"] for r in rows} == {1: 0, 2: 2500, 3: 10_000, 5: 1000}
    assert {r["id"]: (r["places"], r["repeats"]) for r in blocks.match_candidates(docs, "id", "data").collect()}[2] == (2497, 2496)


def test_listing_and_testing_files(spark):
    a = frames.encode(b"abc" * 1000, frames.Options(content_size=True))
    files = {"plain": a, "two": a + a, "mixed": a + frames.skippable(b"12345") + frames.legacy(b"x" * 100), "no_size": frames.encode(b"abc"), "bad": a[:-1], "text": b"hello", "skip": frames.skippable(b"123"), "linked": frames.encode(generators.words(100_000).encode(), frames.Options(4, False, content_size=True))}
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()], "path string, content binary")
    rows = {r["path"]: r for r in files_of.list_files(files_of.list_frames(df)).collect()}
    assert (rows["plain"]["frames"], rows["plain"]["type"], rows["plain"]["block"], rows["plain"]["uncompressed"]) == (1, "StandardFrame", "B4I", 3000)
    assert rows["two"]["uncompressed"] == 6000 and rows["two"]["ratio_pct"] == pytest.approx(100 * 2 * len(a) / 6000)
    assert (rows["mixed"]["type"], rows["mixed"]["block"], rows["mixed"]["uncompressed"]) == ("-", "-", None)
    assert rows["no_size"]["ratio_pct"] is None and rows["skip"]["type"] == "SkippableFrame" and rows["linked"]["block"] == "B4D"
    assert rows["bad"]["error"] == "truncated" and rows["text"]["error"] == "unknown_format"
    assert {r["path"]: r["size"] for r in files_of.list_frames(df).where("path = 'skip'").select("path", F.col("frame_size").alias("size")).collect()} == {"skip": 11}
    sizes = files_of.list_frames(df).where("error is null").groupBy("path").agg(F.sum("frame_size").alias("n"), F.max("file_size").alias("size")).collect()
    assert all(r["n"] == r["size"] for r in sizes)
    tested = {r["path"]: r["error"] for r in files_of.test_files(df).collect()}
    assert {k for k, v in tested.items() if v is None} == {"plain", "two", "mixed", "no_size", "skip", "linked"}


@pytest.mark.parametrize("options", [frames.Options(4, True, True, True, True), frames.Options(4, False, False, True, False)])
def test_frames_written_in_parallel(spark, options):
    raw = {1: generators.words(400_000, 1).encode(), 2: b"", 3: b"short"}
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in raw.items()], "id int, data binary")
    got = {r["id"]: bytes(r["content"]) for r in files_of.write_files(df, "id", "data", options, 65536).collect()}
    assert {k: frames.decode(v) for k, v in got.items()} == raw
    if not options.independent:
        assert len(got[1]) < len(frames.encode(raw[1], frames.Options(4, True, content_checksum=True)))


def test_measures_of_few_values(spark):
    df = spark.createDataFrame([("none", None), ("one", 5.0), ("two", 1.0), ("two", 3.0), ("zero", -1.0), ("zero", 1.0)], "k string, v double")
    rows = {r["k"]: r for r in df.groupBy("k").agg(*stats.measures(F.col("v"), "v")).collect()}
    assert rows["none"]["v_n"] == 0 and rows["none"]["v_mean"] is None and rows["none"]["v_stdev"] is None
    assert (rows["one"]["v_stdev"], rows["one"]["v_cv_pct"], rows["one"]["v_ci95_half"]) == (0.0, 0.0, 0.0)
    assert rows["two"]["v_median"] == 2 and rows["two"]["v_stdev"] == pytest.approx(statistics.stdev([1, 3])) and rows["two"]["v_ci95_half"] == pytest.approx(1.96)
    assert rows["zero"]["v_cv_pct"] == 0


def test_two_level_summary(spark):
    base = {c: "x" for c in stats.CASE} | {"input_bytes": 100, "compressed_bytes": 50, "status": "ok", "verify_ok": "True", "ratio_pct": "50", "bench_comp_kernel_mbs": "10", "bench_dec_kernel_mbs": "20", "manual_comp_kernel_mbs": None, "manual_dec_kernel_mbs": "", "manual_comp_no_ocl_mbs": None, "manual_dec_no_ocl_mbs": None}
    rows = [
        base | {"phase": "bench"}, base | {"phase": "manual", "manual_comp_kernel_mbs": "30"}, base | {"phase": "manual", "manual_comp_kernel_mbs": "40", "verify_ok": "no"},
        base | {"phase": "manual", "status": "failed", "manual_comp_kernel_mbs": "999"}, base | {"sample": "y", "phase": "bench"},
    ]
    files = stats.per_file_summary(spark.createDataFrame(rows, ", ".join(f"{k} {'long' if 'bytes' in k else 'string'}" for k in rows[0])))
    got = {r["sample"]: r for r in files.collect()}
    assert (got["x"]["bench_rounds"], got["x"]["manual_rounds"], got["x"]["ok"], got["x"]["comp_mbs_median"], got["x"]["dec_mbs_median"]) == (1, 2, False, 35.0, 20.0)
    assert (got["y"]["manual_rounds"], got["y"]["ok"], got["y"]["comp_mbs_mean"], got["y"]["e2e_comp_mbs_n"]) == (0, False, 10.0, 0)
    whole = stats.aggregate_summary(files).first()
    assert (whole["samples"], whole["verify_all"], whole["comp_mbs_median_of_files"], whole["e2e_dec_mbs_mean_of_files"]) == (2, False, 22.5, None)


def test_sweep_analysis(spark):
    raw = spark.createDataFrame([("s", 1, 64, 1, "p", m, r, "OK" if r < 3 else "FAIL", 1048576.0, 524288.0, 100.0 * r, 50.0, 20.0, 10.0, 80.0, 40.0, 5.0, 5.0, 2.0) for m in ("local", "daemon") for r in (1, 2, 3)], "sample string, accel int, block_size int, local int, pinned string, mode string, run int, ok string, input_bytes double, compressed_bytes double, comp_total_ms double, comp_kernel_ms double, comp_h2d_ms double, comp_d2h_ms double, dec_total_ms double, dec_kernel_ms double, dec_h2d_ms double, dec_d2h_ms double, compression_ratio double")
    df = stats.throughput(stats.average_runs(raw))
    row = df.where("mode = 'local'").first()
    assert row["runs"] == 2 and row["comp_throughput_total"] == pytest.approx(1 / 0.15) and row["comp_overhead_pct"] == pytest.approx(100 - 100 / 3 - 40 / 3 - 20 / 3)
    both = stats.compare_modes(df, ["sample", "accel", "block_size", "local", "pinned"], "mode", "local", "daemon", ["avg_comp_total_ms"]).first()
    assert both["matched"] == 1 and both["avg_comp_total_ms_speedup_mean"] == 1
    assert stats.top_by(df, ["mode"], "comp_throughput_total", 1, ["accel"]).count() == 2


def test_ties(spark):
    df = spark.createDataFrame([(1, 5.0, 5.0, 5.0), (2, 7.0, 7.0, 1.0), (3, 9.0, 1.0, 1.0), (4, None, None, None)], "id int, k double, h double, d double")
    got = {r["bottleneck"]: r["configs"] for r in stats.bottlenecks(df, {"kernel": "k", "h2d": "h", "d2h": "d"}).collect()}
    assert got == {"d2h": 1, "h2d": 1, "kernel": 1, "other": 1}
    same = spark.createDataFrame([("a", 2, 1.0), ("a", 1, 1.0), ("b", 3, None)], "k string, c int, m double")
    assert {r["k"]: r["best_c"] for r in stats.best_by(same, ["k"], "m", ["c"]).collect()} == {"a": 1, "b": None}
    assert [r["c"] for r in stats.top(same, "m", 5, ["c"]).orderBy("place").collect()] == [1, 2]


def test_exact_medians(spark, tmp_path):
    import random

    draw = random.Random(2)
    rows = [(k, draw.choice([None, 1.5, draw.random(), float(draw.randrange(5))])) for k in (1, 1, 1, 2, None) for _ in range(draw.randrange(1, 120))] + [(3, None), (4, 7.0), (5, 1.0), (5, 2.0)]
    df = spark.createDataFrame(rows, "k int, v double").repartition(6)
    got = {r["k"]: (r["n"], r["median"]) for r in stats.exact_medians(df, ["k"], "v", f"{tmp_path}/m").collect()}
    for key in (None, 1, 2, 3, 4, 5):
        values = [v for k, v in rows if k == key and v is not None]
        assert got[key] == (len(values), pytest.approx(statistics.median(values)) if values else None)
    assert stats.exact_medians(df.limit(0), ["k"], "v", f"{tmp_path}/none").count() == 0


def test_population_deviation(spark):
    df = spark.createDataFrame([("one", 4.0), ("two", 1.0), ("two", 3.0), ("none", None)], "k string, v double")
    assert {r["k"]: r["s"] for r in df.groupBy("k").agg(stats.population_stdev(F.col("v")).alias("s")).collect()} == {"one": 0.0, "two": 1.0, "none": None}


def test_differences_of_snapshots(spark):
    rows = [("wrap", 0.0, 90.0, -2.0), ("wrap", 2.0, 10.0, -4.0), ("by_power", 0.0, None, -2.0), ("by_power", 4.0, None, -4.0), ("one", 1.0, 5.0, 3.0), ("none", 0.0, None, None), ("none", 1.0, 2.0, 1.0)]
    df = spark.createDataFrame(rows, "run string, ts double, e double, p double")
    got = {r["run"]: (r["elapsed_s"], r["cpu_energy_j"]) for r in telemetry.difference(df, "run", "ts", [], {"cpu": ("e", "p", 100.0)}).collect()}
    assert got["wrap"] == (2.0, 20.0) and got["by_power"] == (4.0, -12.0) and got["none"] == (1.0, 0.0) and got["one"] == (telemetry.LEAST_SECONDS, 0.0)
    steps = telemetry.intervals(df.where("run = 'wrap'"), "run", "ts", [], {}, ["p"], clamped=False).first()
    assert (steps["p_mean"], steps["p_area"]) == (-3.0, -6.0)


def test_sweeps_time_and_verify(spark):
    from tessera.operators import bench

    own = bench.strategies(b"hello hello " * 50)
    own["wrong"] = bench.Strategy("wrong", own["block"].encode, lambda p, n: b"other")
    own["fails"] = bench.Strategy("fails", own["block"].encode, lambda p, n: block.decode(b""))
    df = spark.createDataFrame([("a", bytearray(b"hello hello hello " * 100)), ("empty", bytearray()), ("null", None)], "name string, data binary")
    raw = bench.sweep(df, "name", "data", own, [0, 9], rounds=2)
    rows = {(r["sample"], r["engine"], r["accel"]): r for r in bench.summarize(raw).collect()}
    assert len(rows) == 3 * len(own) * 2
    good = [r for r in rows.values() if r["engine"] not in ("wrong", "fails")]
    assert all(r["rounds"] == 2 and r["verify_all"] and r["comp_mbs_best"] >= r["comp_mbs_median"] >= 0 for r in good)
    assert all(not r["verify_all"] and r["rounds"] == 0 for r in rows.values() if r["engine"] in ("wrong", "fails"))
    assert rows["a", "dictionary", 9]["compressed_bytes"] <= rows["a", "block", 9]["compressed_bytes"]
    files = stats.per_file_summary(raw.withColumnsRenamed({"comp_mbs": "bench_comp_kernel_mbs", "dec_mbs": "bench_dec_kernel_mbs"}).withColumns({c: F.lit(None).cast("double") for c in ("manual_comp_kernel_mbs", "manual_dec_kernel_mbs", "manual_comp_no_ocl_mbs", "manual_dec_no_ocl_mbs")}), ("sample", "engine", "accel"))
    assert files.where("sample = 'a' and engine = 'frame' and accel = 0").first()["bench_rounds"] == 2
    timed = bench.time_functions(df, "name", "data").collect()
    assert len(timed) == 3 * len(bench.functions(b"x")) and all(r["ok"] for r in timed)


def test_telemetry(spark):
    rows = [("w", 0.0, 990.0, 10.0), ("w", 1.0, 5.0, None), ("w", 3.0, 25.0, 30.0), ("one", 5.0, 1.0, 7.0), ("gap", 0.0, None, None), ("gap", 0.0, 3.0, 4.0)]
    df = spark.createDataFrame(rows, "run string, ts double, e double, p double")
    got = {r["run"]: r for r in telemetry.summary(df, "run", "ts", ["p"], {"cpu": ("e", "p", 1000.0)}).collect()}
    assert (got["w"]["cpu_energy_j"], got["w"]["elapsed_s"], got["w"]["cpu_peak_w"]) == (35.0, 3.0, 15.0)
    assert got["w"]["cpu_avg_w"] == pytest.approx(35 / 3)
    assert (got["one"]["elapsed_s"], got["one"]["cpu_energy_j"], got["one"]["cpu_avg_w"]) == (0.0, 0.0, 7.0)
    assert got["gap"]["cpu_energy_j"] == 0 and got["gap"]["cpu_avg_w"] == 4.0 and got["gap"]["elapsed_s"] == telemetry.LEAST_SECONDS
    assert {r["run"]: r["idle_w"] for r in telemetry.idle_power(df, "run", "p").collect()} == {"w": 10.0, "one": 7.0, "gap": 4.0}


def test_work_items(spark):
    cpu, gpu = (spark.createDataFrame([(x,) for x in v], "label string") for v in (["1900mhz", "NA", "NA"], ["1000mhz", "NA"]))
    ratios = spark.createDataFrame([("0",), ("0.5",), ("1",), ("adaptive",)], "ratio string")
    got = sorted(tuple(r) for r in sweeps.work_items(ratios, cpu, gpu).collect())
    assert len(got) == len(set(got)) == 2 + 2 + 2 + 4 + 2 + 4
    assert ("hybrid_ratio_0", "1900mhz", "NA") in got and ("hybrid_ratio_0", "1900mhz", "1000mhz") not in got
    assert sweeps.work_items(ratios, cpu, gpu, ("gpu",)).count() == 2


def test_device_split_covers_both(spark):
    df = spark.range(10).selectExpr("id % 1 AS k", "cast(id AS int) AS block_no")
    for ratio, first in ((0.0, 0), (0.01, 1), (0.5, 5), (0.99, 9), (1.0, 10)):
        assert sweeps.split_plan(df, ["k"], ratio).where("device = 'gpu'").count() == first


def test_history_window():
    long = generators.words(80_000, 1).encode()
    assert block.decode(block.encode(b"x" * 50, history=long), history=long[-65536:]) == b"x" * 50


def test_candidates_of_keys_that_repeat(spark):
    """A key's cells count together, null keys too, and grams aren't shuffled."""
    df = spark.createDataFrame([(1, "abcdabcd"), (1, "abcd"), (None, "xyzw"), (None, "xyzw"), (2, "abc"), (3, None), (4, "aaaaaaaa")], "id int, text string")
    out = blocks.match_candidates(df, "id", "text")
    assert {r["id"]: (r["places"], r["repeats"]) for r in out.collect()} == {1: (6, 2), None: (2, 1), 4: (5, 4)}
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()
