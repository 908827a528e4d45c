"""Rejected logs, kept whole until a corrected spec settles them.

A reject keeps its raw log.  It is told apart by its key; where that is not complete, by the
name it got when it landed; and a log that never landed by its content and its number among
equal ones of its batch.  So no two logs merge, and a repeated batch repeats its names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql import types as T

from chainloom.operators import storage
from chainloom.sources.schemas import LANDED_LOG, LOG_KEY

RAW_COLUMNS = (*LANDED_LOG.fieldNames(), "table_name", "spec", "reject_reason")
REJECT = T.StructType([*LANDED_LOG.fields, *[T.StructField(c, T.StringType()) for c in ("table_name", "spec", "reject_reason", "log_id")]])
SETTLED = T.StructType([T.StructField("log_id", T.StringType()), T.StructField("spec", T.StringType())])


def key_id() -> Column:
    """Name of a log whose key is complete, else NULL."""
    return F.when(F.expr(" AND ".join(f"{c} IS NOT NULL" for c in LOG_KEY)), F.concat_ws(":", F.lit("key"), *LOG_KEY))


def named(rejects: DataFrame) -> DataFrame:
    """Rejects with ``log_id``.  Only rejects without key and landing are hashed and numbered."""
    landed = F.when(F.col("landed_as").isNotNull(), F.concat_ws(":", F.lit("landed"), "landed_as"))
    known = rejects.withColumn("log_id", F.coalesce(key_id(), landed))
    content = F.sha2(F.to_json(F.struct(*RAW_COLUMNS)), 256)
    nameless = known.filter("log_id IS NULL").withColumn("log_id", content)
    number = F.row_number().over(Window.partitionBy("log_id").orderBy(F.lit(1)))
    nameless = nameless.withColumn("log_id", F.concat_ws(":", F.lit("content"), "log_id", number.cast("string")))
    return known.filter("log_id IS NOT NULL").unionByName(nameless)


def put(rejects: DataFrame, root: str, batch_id: int | str) -> None:
    """Write a batch's rejects, in place of those of an earlier run of it."""
    named(rejects.select(*RAW_COLUMNS)).write.mode("overwrite").parquet(f"{root}/quarantine/batch_id={batch_id}")


def open_rejects(spark: SparkSession, root: str) -> DataFrame:
    """Raw logs with reason, each once, that no replay has settled."""
    rows = storage.read_if_exists(spark, f"{root}/quarantine", REJECT)
    if rows is None:
        return spark.createDataFrame([], REJECT)
    rows = rows.select(*REJECT.names).dropDuplicates(["log_id"])
    settled = storage.read_if_exists(spark, f"{root}/settled", SETTLED)
    return rows if settled is None else rows.join(settled.select("log_id").distinct(), "log_id", "left_anti").select(*REJECT.names)


def settle(stored: DataFrame, root: str, replay_id: str) -> None:
    """Mark rejects as stored, by the keys of the stored rows."""
    stored.select(key_id().alias("log_id"), "spec").write.mode("overwrite").parquet(f"{root}/settled/replay_id={replay_id}")
