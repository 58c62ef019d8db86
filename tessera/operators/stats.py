"""Statistics of benchmark runs: grouped measures, two levels of medians, comparisons, best and worst."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def measures(values: Column, prefix: str) -> list[Column]:
    """Aggregates n, mean, median, stdev, cv_pct and ci95_half of the values that aren't null.

    One value has deviation, CV and half-width 0; a mean of 0 has CV 0; no value gives null but n = 0.
    """
    n, mean = F.count(values), F.avg(values)
    spread = F.when(n == 1, F.lit(0.0)).otherwise(F.stddev_samp(values))
    return [
        n.alias(f"{prefix}_n"),
        mean.alias(f"{prefix}_mean"),
        F.median(values).alias(f"{prefix}_median"),
        spread.alias(f"{prefix}_stdev"),
        F.when(mean == 0, F.lit(0.0)).otherwise(100.0 * spread / mean).alias(f"{prefix}_cv_pct"),
        (1.96 * spread / F.sqrt(n.cast("double"))).alias(f"{prefix}_ci95_half"),
    ]


MEASURES = ("n", "mean", "median", "stdev", "cv_pct", "ci95_half")


def population_stdev(values: Column) -> Column:
    """The deviation of all values, 0 of one, null of none."""
    return F.stddev_pop(values)


def chosen(primary: Column, fallback: Column, prefix: str) -> list[Column]:
    """measures() of the primary values of a group, or of the fallback's where the group has no primary one."""
    return [F.when(F.count(primary) > 0, a).otherwise(b).alias(f"{prefix}_{name}") for name, a, b in zip(MEASURES, measures(primary, ""), measures(fallback, ""))]


#: Columns that make a case of a raw benchmark row.
CASE = ("sample", "engine", "block", "local_size", "accel", "hashlog", "gpu_dict_pool_mb", "gpu_dict_slots", "gpu_dict_slot_factor", "gpu_ratio", "cpu_threads")


def per_file_summary(raw: DataFrame, case: tuple[str, ...] = CASE) -> DataFrame:
    """A row for each case of raw rows: rounds by phase, verification, and measures of ratio and four speeds.

    Only rows with status ok count. Ratios come from the manual phase if it has rows; kernel speeds from manual
    values if there are any, else from the bench phase. ok is false without manual rows.
    """
    ok = F.col("status") == "ok"
    bench, manual = ok & (F.col("phase") == "bench"), ok & (F.col("phase") == "manual")

    def of(rows: Column, name: str) -> Column:
        return F.when(rows, F.col(name).try_cast("double"))

    verified = F.lower(F.col("verify_ok").cast("string")).isin("true", "yes", "1")
    # Each phase is aggregated once, and what counts is chosen behind the aggregate.
    aggregated = {
        "_manual_ratio": of(manual, "ratio_pct"), "_bench_ratio": of(bench, "ratio_pct"),
        "_manual_comp": of(manual, "manual_comp_kernel_mbs"), "_bench_comp": of(bench, "bench_comp_kernel_mbs"),
        "_manual_dec": of(manual, "manual_dec_kernel_mbs"), "_bench_dec": of(bench, "bench_dec_kernel_mbs"),
        "e2e_comp_mbs": of(manual, "manual_comp_no_ocl_mbs"), "e2e_dec_mbs": of(manual, "manual_dec_no_ocl_mbs"),
    }
    named = raw.select(*case, "input_bytes", "compressed_bytes", bench.alias("_bench"), manual.alias("_manual"), verified.alias("_verified"), *[c.alias(name) for name, c in aggregated.items()])
    each = named.groupBy(*case).agg(
        F.min("input_bytes").alias("input_bytes"),
        F.min("compressed_bytes").alias("compressed_bytes"),
        F.count_if("_bench").alias("bench_rounds"),
        F.count_if("_manual").alias("manual_rounds"),
        F.coalesce(F.bool_and(F.when(F.col("_manual"), F.coalesce("_verified", F.lit(False)))), F.lit(False)).alias("ok"),
        *[x for name in aggregated for x in (F.count(name).alias(f"{name}_n"), F.avg(name).alias(f"{name}_mean"), F.median(name).alias(f"{name}_median"), F.stddev_samp(name).alias(f"{name}_spread"))],
    )

    def picked(first: str, second: str | None, use_first: Column, prefix: str) -> list[Column]:
        def value(name: str) -> Column:
            return F.when(use_first, F.col(f"{first}_{name}")).otherwise(F.col(f"{second}_{name}")) if second else F.col(f"{first}_{name}")

        n, mean = value("n"), value("mean")
        spread = F.when(n == 1, F.lit(0.0)).otherwise(value("spread"))
        cv = F.when(mean == 0, F.lit(0.0)).otherwise(100.0 * spread / mean)
        return [c.alias(f"{prefix}_{name}") for name, c in zip(MEASURES, (n, mean, value("median"), spread, cv, 1.96 * spread / F.sqrt(n.cast("double"))))]

    return each.select(
        *case, "input_bytes", "compressed_bytes", "bench_rounds", "manual_rounds", "ok",
        *picked("_manual_ratio", "_bench_ratio", F.col("manual_rounds") > 0, "ratio_pct"),
        *picked("_manual_comp", "_bench_comp", F.col("_manual_comp_n") > 0, "comp_mbs"),
        *picked("_manual_dec", "_bench_dec", F.col("_manual_dec_n") > 0, "dec_mbs"),
        *picked("e2e_comp_mbs", None, F.lit(True), "e2e_comp_mbs"),
        *picked("e2e_dec_mbs", None, F.lit(True), "e2e_dec_mbs"),
    )


def aggregate_summary(per_file: DataFrame, case: tuple[str, ...] = CASE[1:], metrics: tuple[str, ...] = ("ratio_pct", "comp_mbs", "dec_mbs", "e2e_comp_mbs", "e2e_dec_mbs")) -> DataFrame:
    """A row for each configuration over its files: samples, verify_all, and median and mean of the files' medians."""
    each = [c for m in metrics for c in (F.median(f"{m}_median").alias(f"{m}_median_of_files"), F.avg(f"{m}_median").alias(f"{m}_mean_of_files"))]
    return per_file.groupBy(*case).agg(F.count("*").alias("samples"), F.bool_and("ok").alias("verify_all"), *each)


def throughput(df: DataFrame, raw_bytes: str = "input_bytes") -> DataFrame:
    """Adds MB/s of both directions, total and kernel, and the shares of the total that kernel and transfers take."""
    mb = F.col(raw_bytes) / F.lit(1048576.0)

    def per_second(ms: str) -> Column:
        return F.when(F.col(ms) > 0, mb / (F.col(ms) / 1000.0))

    def share(part: str, whole: str) -> Column:
        return F.when(F.col(whole) > 0, 100.0 * F.col(part) / F.col(whole))

    out = df
    for short, way in (("comp", "comp"), ("decomp", "decomp")):
        total = f"avg_{way}_total_ms"
        out = out.withColumns({f"{short}_throughput_total": per_second(total), f"{short}_throughput_kernel": per_second(f"avg_{way}_kernel_ms")})
        out = out.withColumns({f"{short}_{p}_pct": share(f"avg_{way}_{p}_ms", total) for p in ("h2d", "d2h", "kernel")})
    return out.withColumn("comp_overhead_pct", 100 - F.col("comp_kernel_pct") - F.col("comp_h2d_pct") - F.col("comp_d2h_pct"))


def average_runs(raw: DataFrame, keys: tuple[str, ...] = ("sample", "accel", "block_size", "local", "pinned", "mode")) -> DataFrame:
    """Rows with ok = OK averaged by configuration, with the number of runs."""
    ms = [(f"{a}_{p}_ms", f"avg_{b}_{p}_ms") for a, b in (("comp", "comp"), ("dec", "decomp")) for p in ("total", "kernel", "h2d", "d2h")]
    return (
        raw.where("ok = 'OK'").groupBy(*keys)
        .agg(F.min("input_bytes").alias("input_bytes"), F.avg("compressed_bytes").alias("avg_compressed_bytes"), *[F.avg(a).alias(b) for a, b in ms], F.avg("compression_ratio").alias("avg_compression_ratio"), F.count("run").alias("runs"))
    )


def compare_modes(df: DataFrame, keys: list[str], mode: str, first: str, second: str, values: list[str]) -> DataFrame:
    """One row on the configurations that both modes have: matched, and for each value mean and median of first / second and the share below 1."""
    a = df.where(F.col(mode) == first).select(*keys, *[F.col(v).alias(f"a_{v}") for v in values])
    b = df.where(F.col(mode) == second).select(*keys, *[F.col(v).alias(f"b_{v}") for v in values])
    both = a.join(b, keys)
    ratio = {v: F.when(F.col(f"b_{v}") != 0, F.col(f"a_{v}") / F.col(f"b_{v}")) for v in values}
    out = [x for v in values for x in (F.avg(ratio[v]).alias(f"{v}_speedup_mean"), F.median(ratio[v]).alias(f"{v}_speedup_median"), F.count_if(ratio[v] < 1).alias(f"{v}_below_one"))]
    return both.agg(F.count("*").alias("matched"), *out)


def best_by(df: DataFrame, keys: list[str], metric: str, config: list[str]) -> DataFrame:
    """A row for each key: its number of rows, the best value of the metric, and the configuration that has it (the least one of equals).

    One aggregate and one shuffle, combined before it: the least of (worse value, configuration). Null metrics are the worst, and
    name no configuration.
    """
    known = F.col(metric).isNotNull()
    least = F.min(F.when(known, F.struct((-F.col(metric)).alias("_less"), *[F.col(c) for c in config])))
    best = df.groupBy(*keys).agg(F.count("*").alias("configs"), F.max(metric).alias(f"best_{metric}"), least.alias("own"))
    return best.select(*keys, "configs", f"best_{metric}", *[F.col(f"own.{c}").alias(f"best_{c}") for c in config])


def top(df: DataFrame, metric: str, n: int, ties: list[str], ascending: bool = False) -> DataFrame:
    """The n rows with the largest (or smallest) metric, equal ones by the ties' order, with their place; nulls don't count."""
    order = F.col(metric).asc() if ascending else F.col(metric).desc()
    few = df.where(F.col(metric).isNotNull()).orderBy(order, *ties).limit(n)
    return few.withColumn("place", F.row_number().over(W.orderBy(order, *ties)))


def top_by(df: DataFrame, keys: list[str], metric: str, n: int, ties: list[str], ascending: bool = False) -> DataFrame:
    """top() within each key."""
    order = F.col(metric).asc() if ascending else F.col(metric).desc()
    place = F.row_number().over(W.partitionBy(*keys).orderBy(order, *ties))
    return df.where(F.col(metric).isNotNull()).withColumn("place", place).where(F.col("place") <= n)


def exact_medians(df: DataFrame, keys: list[str], value: str, folder: str) -> DataFrame:
    """keys, n and the exact median of the values that aren't null, for groups of any size.

    F.median holds a map of all distinct values of a group in one task. Here distinct values are counted before they are shuffled, dealt
    by ranges of (key, value) and written to `folder`; totals of the ranges say which of them hold a key's middle ranks,
    and only those are looked into. Null keys are a group like others; keys without a value have n 0 and no median.
    """
    spark = df.sparkSession
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    ranged = counted.repartitionByRange(*keys, "_v").withColumn("_part", F.spark_partition_id())
    ranged.write.parquet(f"{folder}/values")
    ranged = spark.read.schema(ranged.schema).parquet(f"{folder}/values")
    parts = ranged.groupBy(*keys, "_part").agg(F.sum("_n").alias("_in"))  # a row for each key and range
    w = W.partitionBy(*keys)
    parts = parts.select(*keys, "_part", "_in", (F.sum("_in").over(w.orderBy("_part")) - F.col("_in")).alias("_before"), F.sum("_in").over(w).alias("n"))
    low, high = F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1
    middle = parts.where((F.col("_before") < high) & (F.col("_before") + F.col("_in") >= low)).withColumns({"_low": low, "_high": high})
    joined = ranged.alias("r").join(middle.alias("m"), [F.col(f"r.{k}").eqNullSafe(F.col(f"m.{k}")) for k in keys] + [F.col("r._part") == F.col("m._part")])
    few = joined.select(*[F.col(f"r.{k}") for k in keys], F.col("m._part").alias("_part"), "_v", "_n", "_before", "_low", "_high", "n")
    upto = few.withColumn("_upto", F.col("_before") + F.sum("_n").over(W.partitionBy(*keys, "_part").orderBy("_v")))
    at = upto.where((F.col("_upto") >= F.col("_low")) & (F.col("_upto") - F.col("_n") < F.col("_high")))
    found = at.groupBy(*keys).agg(F.max("n").alias("n"), ((F.min("_v") + F.max("_v")) / 2).alias("median"))
    everyone = df.select(*keys).distinct()
    both = everyone.alias("e").join(found.alias("f"), [F.col(f"e.{k}").eqNullSafe(F.col(f"f.{k}")) for k in keys], "left")
    return both.select(*[F.col(f"e.{k}") for k in keys], F.coalesce("n", F.lit(0)).cast("long").alias("n"), "median")


def dominant(parts: dict[str, str]) -> Column:
    """The name of the largest of the columns {name: column}; of equals the last named; 'other' where none is known."""
    largest = F.greatest(*[F.col(c) for c in parts.values()])
    return reduce(lambda otherwise, name: F.when(F.col(parts[name]) >= largest, name).otherwise(otherwise), parts, F.lit("other"))


def bottlenecks(df: DataFrame, parts: dict[str, str]) -> DataFrame:
    """How many rows each part dominates, and their share."""
    counted = df.groupBy(dominant(parts).alias("bottleneck")).agg(F.count("*").alias("configs"))
    whole = df.agg(F.count("*").alias("whole"))
    return counted.crossJoin(F.broadcast(whole)).select("bottleneck", "configs", (100.0 * F.col("configs") / F.col("whole")).alias("share_pct"))


def by_parameter(df: DataFrame, parameters: list[str], metrics: list[str]) -> DataFrame:
    """Mean metrics by each value of each parameter, in one pass: parameter, value, configs, means."""
    grouped = df.groupingSets([[p] for p in parameters], *parameters).agg(F.count("*").alias("configs"), *[F.avg(m).alias(f"avg_{m}") for m in metrics], *[F.grouping(p).alias(f"_g_{p}") for p in parameters])
    name = F.coalesce(*[F.when(F.col(f"_g_{p}") == 0, F.lit(p)) for p in parameters])
    value = F.coalesce(*[F.when(F.col(f"_g_{p}") == 0, F.col(p).cast("string")) for p in parameters])
    return grouped.select(name.alias("parameter"), value.alias("value"), "configs", *[f"avg_{m}" for m in metrics])
