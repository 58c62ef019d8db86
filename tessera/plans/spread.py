"""Spreading small inputs over idle cores before work that is bound by CPU, and bounds of what goes to a Python worker at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Bytes a core below which an input is spread; larger ones have splits enough of their own.
SMALL_BYTES = 8 << 20


def spread(df: DataFrame) -> DataFrame:
    """df dealt evenly over all cores if the planner's estimate of its size is small, else df.

    A file of a few row groups is read by as many tasks however many cores wait. The estimate comes from the
    plan: nothing is read or run for it, and inputs that could make the shuffle matter are left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SMALL_BYTES else df


#: Rows, and bytes, that go to a Python worker at once at most; one row may be larger.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches where it has no bounds of its own; Spark's defaults send 10,000 texts or 64 MB at once.

    Spark reads these settings when a query runs, so they are the session's, not one operator's.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, str(most))
