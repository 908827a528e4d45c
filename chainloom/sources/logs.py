"""Raw logs on storage: landing and scanning."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from chainloom.sources.schemas import BUCKET_BLOCKS, CHUNK_BLOCKS, LANDED_LOG, RAW_LOG


def bucket_of(block: Column, size: int = BUCKET_BLOCKS) -> Column:
    return F.call_function("div", block, F.lit(size))


def normalised(logs: DataFrame) -> DataFrame:
    """Hex digits in lower case, as all later comparisons expect them."""
    lower = {c: F.lower(c) for c in ("address", "topic0", "data", "transaction_hash")}
    return logs.withColumns({**lower, "topics": F.transform("topics", F.lower)})


def land_logs(logs: DataFrame, path: str, mode: str = "append") -> None:
    """Write raw logs as Parquet, partitioned by chain and block bucket, with their hex
    digits in lower case.

    The rebalance hint gathers a bucket's rows into few files and lets AQE split a bucket
    that holds far more than the others.  Sorting by topic and contract makes row-group
    statistics selective for both.  Each row gets a name of its own, ``landed_as``, so that
    logs without a complete key can be told apart later.
    """
    landing = uuid.uuid4().hex
    named = F.concat_ws(":", F.lit(landing), F.monotonically_increasing_id().cast("string")).alias("landed_as")
    (
        normalised(logs.withColumn("block_bucket", bucket_of(F.col("block_number"))).select(*RAW_LOG.fieldNames(), named))
        .hint("rebalance", "chain", "block_bucket")
        .sortWithinPartitions("chain", "block_bucket", "topic0", "address", "block_number")
        .write.mode(mode)
        .partitionBy("chain", "block_bucket")
        .parquet(path)
    )


def scan_logs(
    spark: SparkSession,
    path: str,
    addresses: list[str] | None = None,
    from_block: int | None = None,
    to_block: int | None = None,
    topic0: str | None = None,
    source: str = "parquet",
) -> DataFrame:
    """Logs of some contracts in a block range.  All conditions reach the scan: bucket
    as partition filter, the rest as pushed filters."""
    logs = spark.read.schema(LANDED_LOG).format(source).load(path)
    if from_block is not None:
        logs = logs.filter((F.col("block_bucket") >= from_block // BUCKET_BLOCKS) & (F.col("block_number") >= from_block))
    if to_block is not None:
        logs = logs.filter((F.col("block_bucket") <= to_block // BUCKET_BLOCKS) & (F.col("block_number") <= to_block))
    if addresses is not None:
        logs = logs.filter(F.col("address").isin([a.lower() for a in addresses]))
    if topic0 is not None:
        logs = logs.filter(F.col("topic0") == topic0)
    return logs


def chunk_coverage(logs: DataFrame, start_block: int, chunk: int = CHUNK_BLOCKS) -> DataFrame:
    """Per chain: [start, head] cut into chunks, the last one short, with the logs in each (0
    when empty).  Counts are partial per task; only one row per chunk is shuffled."""
    counts = (
        logs.filter(F.col("block_number") >= start_block)
        .groupBy("chain", F.call_function("div", F.col("block_number") - start_block, F.lit(chunk)).alias("chunk"))
        .agg(F.count("*").alias("n"), F.max("block_number").alias("last"))
    )
    head = counts.groupBy("chain").agg(F.max("last").alias("head")).filter("head is not null")
    chunks = head.select(
        "chain", "head", F.explode(F.sequence(F.lit(start_block).cast("bigint"), F.col("head"), F.lit(chunk).cast("bigint"))).alias("from_block")
    ).withColumn("chunk", F.call_function("div", F.col("from_block") - start_block, F.lit(chunk)))
    return chunks.join(counts, ["chain", "chunk"], "left").select(
        "chain", "from_block",
        F.least(F.col("from_block") + (chunk - 1), F.col("head")).alias("to_block"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("log_count"),
    )
