"""Hourly totals kept current while logs arrive.

The totals of an hour are those of the stored rows, so replays, rejected logs and logs that
arrive late count as they do in the event table.  Each micro-batch first appends its logs
and then computes the days it touched anew from the table, however old they are.  There is
no state and no horizon, and a batch that runs again writes the same hours again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from chainloom.functions import u256
from chainloom.operators import storage
from chainloom.sources.specs import EventSpec
from chainloom.streaming import ingest

HOURS = T.StructType([
    T.StructField("swap_count", T.LongType()), T.StructField("total_amount0", u256.U256), T.StructField("total_amount1", u256.U256),
    T.StructField("hour", T.LongType()), T.StructField("day", T.LongType()),
])
DAY = 86_400


def hour_of_row():
    return (F.col("block_timestamp") - F.pmod("block_timestamp", F.lit(3600))).alias("hour")


def hourly_totals(events: DataFrame, amounts: tuple[str, str]) -> DataFrame:
    """Count and exact totals per hour of an event table."""
    totals = u256.sums(events.groupBy(hour_of_row()), total_amount0=amounts[0], total_amount1=amounts[1])
    return totals.select(F.col("n").alias("swap_count"), "total_amount0", "total_amount1", "hour")


def refresh_hours(stored: DataFrame, changed: DataFrame, amounts: tuple[str, str], path: str) -> None:
    """Write the hours of the days of ``changed`` rows anew from the stored table: one file
    for each day.  The time range reaches the scan; within it, only those days are summed."""
    day = lambda c: F.call_function("div", F.col(c), F.lit(DAY)).alias("day")
    days = changed.select(day("block_timestamp")).distinct()
    span = days.agg(F.min("day").alias("lo"), F.max("day").alias("hi")).first()
    if span["lo"] is None:
        return
    near = stored.filter(F.col("block_timestamp").between(span["lo"] * DAY, span["hi"] * DAY + DAY - 1))
    touched = near.withColumn("day", day("block_timestamp")).join(days, "day", "left_semi")
    totals = hourly_totals(touched, amounts).withColumn("day", day("hour"))
    totals.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def start_hourly(
    spark: SparkSession, landed: str, specs: list[EventSpec], root: str, spec: EventSpec, amounts: tuple[str, str], **options
) -> StreamingQuery:
    """Ingest ``specs`` and keep ``root/hours`` of the table of ``spec`` current."""
    table = spec.table or spec.name

    def refresh(name: str, batch: DataFrame) -> None:
        if name == table:
            refresh_hours(ingest.stored(batch.sparkSession, root, spec), batch, amounts, hours_path(root))

    return ingest.start(spark, landed, specs, root, after=refresh, **options)


def hours_path(root: str) -> str:
    return f"{root}/hours"


def current_hours(spark: SparkSession, root: str) -> DataFrame:
    """hour, swap_count, total_amount0, total_amount1; no rows before the first batch."""
    found = storage.read_if_exists(spark, hours_path(root), HOURS)
    rows = spark.createDataFrame([], HOURS) if found is None else found
    return rows.select("hour", "swap_count", "total_amount0", "total_amount1")
