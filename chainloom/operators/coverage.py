"""Which block ranges are landed, ingested and missing: sets of intervals by key.

A landing records the range it asked for, since a range without logs is covered too.  An
ingest records, per spec, the ranges it took in.  What is pending is the difference, so that
a range that lands late is found wherever it lies, below the newest block too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from chainloom.operators import storage
from chainloom.sources import logs as log_files
from chainloom.sources.schemas import BUCKET_BLOCKS
from chainloom.sources.specs import EventSpec, spec_rows

RANGES = "from_block bigint, to_block bigint"


def swept(keys: list[str], keep: str, **sets: DataFrame) -> DataFrame:
    """The maximal ranges of blocks, by key, for which ``keep`` holds: a condition on how many
    ranges of each set (keys, from_block, to_block) contain a block.

    Borders of all sets are brought into one order per key; running sums count the open
    ranges, and neighbouring stretches that are kept become one.
    """
    borders = None
    for name, rows in sets.items():
        steps = F.inline(F.array(*[
            F.struct(at.alias("block"), *[F.lit(step * (n == name)).alias(n) for n in sets])
            for at, step in ((F.col("from_block"), 1), (F.col("to_block") + 1, -1))
        ]))
        part = rows.where("from_block <= to_block").select(*keys, steps)
        borders = part if borders is None else borders.unionByName(part)
    # One row per border, however many ranges share it.
    borders = borders.groupBy(*keys, "block").agg(*[F.sum(n).alias(n) for n in sets])
    order = Window.partitionBy(*keys).orderBy("block")
    counted = borders.withColumns({n: F.sum(n).over(order) for n in sets})
    counted = counted.withColumn("kept", F.coalesce(F.expr(keep), F.lit(False)))
    # A change of the condition begins or ends a range; behind the last border nothing is open.
    changes = counted.withColumn("was", F.coalesce(F.lag("kept").over(order), F.lit(False))).where("kept <> was")
    found = changes.withColumn("until", F.lead("block").over(order)).where("kept")
    return found.select(*keys, F.col("block").alias("from_block"), (F.col("until") - 1).alias("to_block"))


def merged(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Overlapping and adjacent ranges as one."""
    return swept(keys, "ranges > 0", ranges=ranges)


def difference(ranges: DataFrame, without: DataFrame, keys: list[str]) -> DataFrame:
    return swept(keys, "ranges > 0 AND without = 0", ranges=ranges, without=without)


def within(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """Rows of a spec inside one of its ranges, which don't overlap; a row without a block
    passes, to be rejected.  Ranges are cut at buckets, so that the join is by (spec, bucket)
    and a row meets the few ranges of its bucket."""
    bucket = lambda c: F.call_function("div", F.col(c), F.lit(BUCKET_BLOCKS))
    cut = ranges.withColumn("__bucket", F.explode(F.sequence(bucket("from_block"), bucket("to_block"))))
    cut = cut.select(F.col("spec").alias("__spec"), "__bucket", "from_block", "to_block")
    numbered, nameless = rows.where("block_number IS NOT NULL"), rows.where("block_number IS NULL")
    inside = (F.col("spec") == F.col("__spec")) & (bucket("block_number") == F.col("__bucket"))
    inside = inside & F.col("block_number").between(F.col("from_block"), F.col("to_block"))
    return numbered.join(cut, inside, "left_semi").unionByName(nameless)


# --- records ---------------------------------------------------------------------------------


def land_chunk(logs: DataFrame, path: str, chain: str, from_block: int, to_block: int) -> None:
    """Land the logs of a fetched range, then record the range."""
    log_files.land_logs(logs, path)
    row = logs.sparkSession.range(1).select(F.lit(chain).alias("chain"), F.lit(from_block).cast("bigint").alias("from_block"), F.lit(to_block).cast("bigint").alias("to_block"))
    row.write.mode("append").parquet(f"{path}_ranges")


def landed_ranges(spark: SparkSession, path: str) -> DataFrame:
    """(chain, from_block, to_block): what has landed, merged."""
    schema = spark.createDataFrame([], "chain string, " + RANGES).schema
    rows = storage.read_if_exists(spark, f"{path}_ranges", schema)
    return spark.createDataFrame([], schema) if rows is None else merged(rows, ["chain"])


def record(ranges: DataFrame, root: str, batch_id: int | str) -> None:
    """Record ranges (spec, from_block, to_block) as covered."""
    ranges.select("spec", "from_block", "to_block").write.mode("overwrite").parquet(f"{root}/coverage/batch_id={batch_id}")


def covered_ranges(spark: SparkSession, root: str) -> DataFrame:
    """(spec, from_block, to_block): what has been ingested, merged."""
    schema = spark.createDataFrame([], "spec string, " + RANGES).schema
    rows = storage.read_if_exists(spark, f"{root}/coverage", schema)
    return spark.createDataFrame([], schema) if rows is None else merged(rows.select(*schema.names), ["spec"])


def pending(spark: SparkSession, path: str, root: str, specs: list[EventSpec]) -> DataFrame:
    """(spec, from_block, to_block): landed and not covered, from the spec's start block on."""
    table = spec_rows(spark, specs).select("spec", "chain", "start_block").dropDuplicates(["spec"])
    wanted = table.join(landed_ranges(spark, path), "chain").select("spec", F.greatest("from_block", "start_block").alias("from_block"), "to_block")
    return difference(wanted, covered_ranges(spark, root), ["spec"])


def gaps(covered: DataFrame, heads: DataFrame, specs: DataFrame) -> DataFrame:
    """(spec, from_block, to_block): what is missing of [start block, head of the chain]."""
    wanted = specs.select("spec", "chain", "start_block").join(heads.select("chain", "head"), "chain")
    wanted = wanted.select("spec", F.col("start_block").alias("from_block"), F.col("head").alias("to_block"))
    return difference(wanted, covered, ["spec"])
