"""What the operators share: session settings, inputs, folds, and checked broadcasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from chainloom import session

# Texts may be long, so few go into one Arrow batch.
SETTINGS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}

# A side may be broadcast up to this many estimated bytes; the size is measured first.
BROADCAST_BYTES = 16_000_000


def prepare(spark: SparkSession) -> SparkSession:
    session.prepare(spark)
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id") -> Column:
    """The fold that no label may be learned from: crc32 of the id's text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder, so that they outlive lost executors and
    are not computed again."""
    spark = df.sparkSession
    path = session.scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def join_sized(left: DataFrame, right: DataFrame, on: list[str], how: str, right_bytes: int) -> DataFrame:
    """Join that broadcasts the right side only where its measured size allows it; beyond
    that both sides are shuffled and adaptive execution splits hot keys."""
    return left.join(F.broadcast(right) if right_bytes <= BROADCAST_BYTES else right, on, how)
