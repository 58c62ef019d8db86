"""Time series of energy counters and power sensors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

LEAST_SECONDS = 1e-9


def wrapped_delta(start: Column, end: Column, most: float) -> Column:
    """What a counter that starts anew behind `most` has grown by; 0 where a reading is missing, or it fell and `most` isn't known."""
    fell = F.lit(float(most)) - start + end if most > 0 else F.lit(0.0)
    return F.when(start.isNull() | end.isNull(), F.lit(0.0)).when(end >= start, end - start).otherwise(fell)


def intervals(samples: DataFrame, run: str, ts: str, ties: list[str], counters: dict[str, float], powers: list[str], clamped: bool = True) -> DataFrame:
    """A row for each sample but a run's first: run, ts, dt, <counter>_delta and <power>_mean, <power>_area between it and the one before.

    Mean power is 0 at least if clamped, as in summaries; the difference of two snapshots takes it as it is.
    """
    w = W.partitionBy(run).orderBy(ts, *ties)
    named = samples.withColumns({f"_{c}": F.lag(c).over(w) for c in [ts, *counters, *powers]} | {"_n": F.row_number().over(w)})
    dt = F.greatest(F.col(ts) - F.col(f"_{ts}"), F.lit(LEAST_SECONDS))
    out = [wrapped_delta(F.col(f"_{c}"), F.col(c), most).alias(f"{c}_delta") for c, most in counters.items()]
    for p in powers:
        mean = (F.col(f"_{p}") + F.col(p)) * 0.5
        mean = F.greatest(mean, F.lit(0.0)) if clamped else mean
        mean = F.when(F.col(f"_{p}").isNotNull() & F.col(p).isNotNull(), mean)
        out += [mean.alias(f"{p}_mean"), (mean * dt).alias(f"{p}_area")]
    return named.where("_n > 1").select(run, ts, dt.alias("dt"), *out)


def difference(samples: DataFrame, run: str, ts: str, ties: list[str], domains: dict[str, tuple[str, str, float]]) -> DataFrame:
    """A row for each run: elapsed_s between its first and its last snapshot, and <name>_energy_j of each domain (as in summary()).

    The energy is what the counter has grown by, past its `most` once, else the unclamped mean of both powers over the time; 0 where neither is known
    at both ends.
    """
    at = F.struct(ts, *ties)
    named = [c for energy, power, _ in domains.values() for c in (energy, power)]
    ends = samples.groupBy(run).agg(*[f(F.struct(at.alias("at"), ts, *dict.fromkeys(named))).alias(side) for side, f in (("a", F.min), ("b", F.max))])
    elapsed = F.greatest(F.col(f"b.{ts}") - F.col(f"a.{ts}"), F.lit(LEAST_SECONDS))
    out = [elapsed.alias("elapsed_s")]
    for name, (energy, power, most) in domains.items():
        by_power = (F.col(f"a.{power}") + F.col(f"b.{power}")) * 0.5 * elapsed
        a, b = F.col(f"a.{energy}"), F.col(f"b.{energy}")
        out.append(F.when(a.isNotNull() & b.isNotNull(), wrapped_delta(a, b, most)).otherwise(F.coalesce(by_power, F.lit(0.0))).alias(f"{name}_energy_j"))
    return ends.select(run, *out)


def summary(samples: DataFrame, run: str, ts: str, ties: list[str], domains: dict[str, tuple[str, str, float]]) -> DataFrame:
    """A row for each run: samples, elapsed_s, and for each domain {name: (energy, power, counter's most)} energy_j, peak_w and avg_w.

    The average is the power's integral over time if there is any, else energy over time, else the mean of positive
    power readings, else 0. The peak is the largest interval's, by energy or power, else energy over time. One
    sample has no time and no energy; peak and average are its power.
    """
    counters = {energy: most for energy, _, most in domains.values()}
    powers = [power for _, power, _ in domains.values()]
    steps = intervals(samples, run, ts, ties, counters, powers)
    rates = [x for energy, power, _ in domains.values() for x in (
        F.sum(f"{energy}_delta").alias(f"{energy}_sum"),
        F.max(F.when(F.col(f"{energy}_delta") > 0, F.col(f"{energy}_delta") / F.col("dt"))).alias(f"{energy}_peak"),
        F.max(f"{power}_mean").alias(f"{power}_peak"),
        F.sum(f"{power}_area").alias(f"{power}_sum"),
    )]
    joined = steps.groupBy(run).agg(*rates)
    whole = samples.groupBy(run).agg(
        F.count("*").alias("samples"), (F.max(ts) - F.min(ts)).alias("span"),
        *[F.avg(F.when(F.col(p) > 0, F.col(p))).alias(f"{p}_level") for p in powers],
    ).join(joined, run, "left")
    one = F.col("samples") == 1
    elapsed = F.when(one, 0.0).otherwise(F.greatest(F.col("span"), F.lit(LEAST_SECONDS)))
    out = [F.col("samples"), elapsed.alias("elapsed_s")]
    for name, (energy, power, _) in domains.items():
        level = F.coalesce(F.col(f"{power}_level"), F.lit(0.0))
        total = F.coalesce(F.col(f"{energy}_sum"), F.lit(0.0))
        over_time = F.when(total > 0, total / elapsed)
        peak = F.greatest(F.coalesce(F.col(f"{energy}_peak"), F.lit(0.0)), F.coalesce(F.col(f"{power}_peak"), F.lit(0.0)))
        peak = F.when(peak > 0, peak).otherwise(F.coalesce(over_time, F.lit(0.0)))
        area = F.col(f"{power}_sum")
        average = F.coalesce(F.when(area > 0, area / elapsed), over_time, level)
        out += [total.alias(f"{name}_energy_j"), F.when(one, level).otherwise(peak).alias(f"{name}_peak_w"), F.when(one, level).otherwise(average).alias(f"{name}_avg_w")]
    return whole.select(run, *out)


def idle_power(samples: DataFrame, run: str, power: str) -> DataFrame:
    """The least positive reading of each run, 0 where there is none."""
    return samples.groupBy(run).agg(F.coalesce(F.min(F.when(F.col(power) > 0, F.col(power))), F.lit(0.0)).alias("idle_w"))
