"""Parameter sweeps: which engine runs at which frequencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def work_items(ratios: DataFrame, cpu_points: DataFrame, gpu_points: DataFrame, engines: tuple[str, ...] = ("native_cpu", "gpu", "hybrid")) -> DataFrame:
    """label, cpu and gpu of every item to run, without repeats.

    The CPU engine takes the CPU points, the GPU engine the GPU points, and the hybrid engine both for each
    ratio, but CPU points alone for ratios of 0 or less and GPU points alone from 1. Points are (label), ratios
    (ratio) as text, `adaptive` among them. All inputs are settings, a few rows each.
    """
    none, parts = F.lit("NA"), []
    cpu, gpu = cpu_points.select(F.col("label").alias("cpu")), gpu_points.select(F.col("label").alias("gpu"))
    if "native_cpu" in engines:
        parts.append(cpu.select(F.lit("cpu").alias("label"), "cpu", none.alias("gpu")))
    if "gpu" in engines:
        parts.append(gpu.select(F.lit("gpu").alias("label"), none.alias("cpu"), "gpu"))
    if "hybrid" in engines:
        share = F.col("ratio").try_cast("double")
        both = ratios.crossJoin(cpu).crossJoin(gpu)
        label = F.concat(F.lit("hybrid_ratio_"), F.col("ratio"))
        parts.append(both.select(label.alias("label"), F.when(share >= 1, none).otherwise(F.col("cpu")).alias("cpu"), F.when(share <= 0, none).otherwise(F.col("gpu")).alias("gpu")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.dropDuplicates()


def split_plan(blocks: DataFrame, keys: list[str], ratio: float, order: str = "block_no") -> DataFrame:
    """Adds `device`: the first blocks of each key go to the gpu, by the ratio, the others to the cpu. One shuffle by key."""
    from pyspark.sql import Window as W

    from tessera.functions.scalars import split_share

    counted = blocks.withColumn("_n", F.count("*").over(W.partitionBy(*keys)))
    return counted.withColumn("device", F.when(F.col(order) < split_share("_n", ratio), "gpu").otherwise("cpu")).drop("_n")


def split_counts(items: DataFrame, keys: list[str], ratio: float) -> DataFrame:
    """keys, gpu_blocks and cpu_blocks of split_plan, by arithmetic on the number of rows of each key: no block is made or looked at."""
    from tessera.functions.scalars import split_share

    counts = items.groupBy(*keys).agg(F.count("*").alias("_n"))
    first = split_share("_n", ratio)
    return counts.select(*keys, first.alias("gpu_blocks"), (F.col("_n") - first).alias("cpu_blocks"))
