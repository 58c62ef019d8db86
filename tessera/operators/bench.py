"""Benchmarks of the codec as tables: strategies by levels by inputs, warmed up, repeated, timed and verified where the rows are."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.kernels import block, frames, hashing

MB = 1_048_576.0


@dataclass(frozen=True)
class Strategy:
    """A named way to pack and unpack: encode(data, level) and decode(packed, size)."""

    name: str
    encode: Callable[[bytes, int], bytes]
    decode: Callable[[bytes, int], bytes]


def strategies(dictionary: bytes = b"", block_size: int | None = None) -> dict[str, Strategy]:
    """Blocks, blocks with a dictionary, frames and linked frames, legacy frames and the sized container, by name."""
    own, linked = (frames.Options(4, independent, content_size=True, block_size=block_size) for independent in (True, False))
    found = [
        Strategy("block", lambda d, level: block.encode(d, level=level), lambda p, n: block.decode(p, n)),
        Strategy("dictionary", lambda d, level: block.encode(d, level=level, history=dictionary), lambda p, n: block.decode(p, n, dictionary)),
        Strategy("frame", lambda d, level: frames.encode(d, replace(own, level=level)), lambda p, n: frames.decode(p)),
        Strategy("linked", lambda d, level: frames.encode(d, replace(linked, level=level)), lambda p, n: frames.decode(p)),
        Strategy("legacy", lambda d, level: frames.legacy(d, level), lambda p, n: frames.decode(p)),
        Strategy("container", lambda d, level: frames.sized_container(d, acceleration=max(1, -level)) if d else b"", lambda p, n: frames.decode_sized_container(p) if p else b""),
    ]
    return {s.name: s for s in found}


def functions(sample: bytes) -> dict[str, Callable[[], bool]]:
    """Single functions of the kernels on a sample, by name; each says whether its result is right."""
    packed, frame = block.encode(sample), frames.encode(sample)
    half = len(sample) // 2
    return {
        "encode_fast": lambda: len(block.encode(sample)) <= block.compress_bound(len(sample)),
        "encode_fast_accelerated": lambda: len(block.encode(sample, 17)) <= block.compress_bound(len(sample)),
        "encode_mid": lambda: len(block.encode(sample, level=2)) <= block.compress_bound(len(sample)),
        "encode_high": lambda: len(block.encode(sample, level=9)) <= block.compress_bound(len(sample)),
        "encode_with_history": lambda: len(block.encode(sample[half:], history=sample[:half])) <= block.compress_bound(len(sample)),
        "encode_into": lambda: len(block.encode_into(sample, max(1, half))[0]) <= max(1, half),
        "encode_frame": lambda: frames.encode(sample) == frame,
        "decode": lambda: block.decode(packed, len(sample)) == sample,
        "decode_partial": lambda: block.decode(packed, target=half) == sample[:half],
        "decode_frame": lambda: frames.decode(frame) == sample,
        "list_frame": lambda: next(frames.frames(frame, decode=False)).end == len(frame),
        "hash32": lambda: hashing.xxh32(sample) == hashing.fold([sample[:half], sample[half:]]),
        "hash64": lambda: hashing.xxh64(sample) == hashing.fold([sample[:half], sample[half:]], 64),
    }


def _timed(call: Callable, seconds: float):
    """(result, seconds of one call) of at least one call, and of as many as the time allows."""
    done, began = 0, time.perf_counter()
    while True:
        result, done = call(), done + 1
        took = time.perf_counter() - began
        if took >= seconds:
            return result, took / done


RAW = "sample string, engine string, block int, accel int, phase string, round int, status string, verify_ok boolean, input_bytes long, compressed_bytes long, ratio_pct double, comp_mbs double, dec_mbs double"


def sweep(df: DataFrame, sample: str, data: str, engines: dict[str, Strategy], levels: list[int], rounds: int = 3, seconds: float = 0.0, block_size: int = 0) -> DataFrame:
    """A row for each sample, engine, level and round: sizes, ratio, MB/s both ways, and whether the hash of what came back is that of the input.

    Settings are crossed with samples before the data move, and dealt to tasks, so a sweep is as parallel as it has
    cells. The first pass of a cell is a warm-up that isn't reported. A cell that fails has status `failed` and nothing else. An empty sample has no ratio;
    null data count as empty.
    """
    spark = df.sparkSession
    settings = spark.createDataFrame([(name, int(level)) for name in engines for level in levels], "engine string, level int")

    def run(batches):
        for batch in batches:
            out = []
            for name, raw, engine, level in zip(batch["sample"], batch["raw"], batch["engine"], batch["level"]):
                raw, own = bytes(raw), engines[engine]
                told = hashing.xxh64(raw)
                for k in range(rounds + 1):
                    try:
                        packed, to = _timed(lambda: own.encode(raw, level), seconds if k else 0.0)
                        back, fro = _timed(lambda: own.decode(packed, len(raw)), seconds if k else 0.0)
                    except (block.BlockError, frames.FrameError, ValueError):
                        out.append((name, engine, block_size, level, "bench", k, "failed", False, len(raw), None, None, None, None))
                        continue
                    if k:
                        ok = hashing.xxh64(back) == told
                        ratio = 100.0 * len(packed) / len(raw) if raw else None
                        out.append((name, engine, block_size, level, "bench", k, "ok" if ok else "failed", ok, len(raw), len(packed), ratio, len(raw) / MB / to, len(raw) / MB / fro))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in RAW.split(", ")]).astype({"compressed_bytes": "Int64"})

    rows = df.select(F.col(sample).cast("string").alias("sample"), F.coalesce(F.col(data).cast("binary"), F.lit(b"")).alias("raw"))
    cells = rows.crossJoin(F.broadcast(settings))  # a few settings
    return cells.repartition("sample", "engine", "level").mapInPandas(run, RAW)


def run_cases(df: DataFrame, sample: str, data: str, engines: dict[str, Strategy], levels: list[int], manual: int = 6, seconds: float = 0.0, block_size: int = 0) -> DataFrame:
    """Raw rows of cases, one bench round and `manual` rounds each, with the columns that stats.per_file_summary reads.

    Kernel speeds are those of the codec alone; here nothing is transferred, so that end-to-end speeds are the same.
    """
    rows = sweep(df, sample, data, engines, levels, 1 + manual, seconds, block_size)
    first = F.col("round") == 1
    na = F.lit("NA")
    return rows.select(
        "sample", "engine", F.col("block").cast("string").alias("block"), na.alias("local_size"), F.col("accel").cast("string").alias("accel"),
        *[na.alias(c) for c in ("hashlog", "gpu_dict_pool_mb", "gpu_dict_slots", "gpu_dict_slot_factor", "gpu_ratio", "cpu_threads")],
        F.when(first, "bench").otherwise("manual").alias("phase"), "round", "status", "verify_ok", "input_bytes", "compressed_bytes", "ratio_pct",
        *[F.when(first, F.col(f"{way}_mbs")).alias(f"bench_{way}_kernel_mbs") for way in ("comp", "dec")],
        *[F.when(~first, F.col(f"{way}_mbs")).alias(f"manual_{way}_{kind}_mbs") for way in ("comp", "dec") for kind in ("kernel", "no_ocl")],
    )


def summarize(raw: DataFrame) -> DataFrame:
    """A row for each sample, engine and level: rounds, verification, size, and median and best MB/s of the rounds that are ok."""
    ok = F.col("status") == "ok"
    return raw.groupBy("sample", "engine", "block", "accel").agg(
        F.count_if(ok).alias("rounds"), F.bool_and(ok).alias("verify_all"), F.max("input_bytes").alias("input_bytes"), F.min("compressed_bytes").alias("compressed_bytes"),
        *[f(F.when(ok, F.col(f"{way}_mbs"))).alias(f"{way}_mbs_{name}") for way in ("comp", "dec") for name, f in (("median", F.median), ("best", F.max))],
    )


def time_functions(df: DataFrame, sample: str, data: str, seconds: float = 0.0) -> DataFrame:
    """sample, function, ok and mbs: each of functions() on each sample. Null data count as empty."""

    def run(batches):
        for batch in batches:
            out = []
            for name, raw in zip(batch["sample"], batch["raw"]):
                for function, call in functions(bytes(raw)).items():
                    ok, took = _timed(call, seconds)
                    out.append((name, function, bool(ok), len(raw) / MB / took))
            yield pd.DataFrame(out, columns=["sample", "function", "ok", "mbs"])

    rows = df.select(F.col(sample).cast("string").alias("sample"), F.coalesce(F.col(data).cast("binary"), F.lit(b"")).alias("raw"))
    return rows.mapInPandas(run, "sample string, function string, ok boolean, mbs double")
