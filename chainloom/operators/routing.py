"""Which spec a log belongs to, and whether it is complete enough to store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from chainloom.sources.schemas import META

BROADCAST_SPECS = 20_000
SALTS = 64


def bounded(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows, reading no more than that."""
    return df.limit(rows + 1).count() <= rows


def first_specs(specs: DataFrame) -> DataFrame:
    """One spec per (chain, address, topic0): the first in spec order wins."""
    keys = ["chain", "address", "topic0"]
    w = Window.partitionBy(*keys).orderBy("spec_order")
    return specs.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def route_logs(logs: DataFrame, specs: DataFrame, broadcast_rows: int = BROADCAST_SPECS) -> DataFrame:
    """Attach ``spec``, ``start_block`` and ``table_name`` to each log that has a spec.

    Duplicate specs are settled on the spec side, so no log is ever ranked.  The spec
    table is broadcast only after its size was checked.  A larger one is joined by
    shuffle, with both sides salted because a busy contract may hold a large share of
    all logs.
    """
    keys = ["chain", "address", "topic0"]
    routing = first_specs(specs).select(*keys, "spec", "start_block", "table_name")
    if bounded(specs, broadcast_rows):
        return logs.join(F.broadcast(routing), keys)
    salted = routing.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64("transaction_hash", "log_index"), F.lit(SALTS)).cast("int")
    return logs.withColumn("__salt", salt).join(salted, [*keys, "__salt"]).drop("__salt")


def start_block_gate(routed: DataFrame, start: str = "start_block") -> DataFrame:
    """Drop logs below their spec's start or resume block.  A log without a block number
    passes: it is rejected, with a reason, by :func:`reject_reason`."""
    return routed.filter(F.col("block_number").isNull() | (F.col("block_number") >= F.col(start)))


# Why a log is rejected.
MISSING = "Log missing {label}"
UNDECODABLE = "Undecodable value for {name}"


def reject_reason() -> Column:
    """Why a log cannot be stored; NULL when it can."""
    labels = ("block number", "block timestamp", "transaction hash", "log index")
    reason = F.lit(None).cast("string")
    for name, label in reversed(list(zip(META, labels))):
        reason = F.when(F.col(name).isNull(), F.lit(MISSING.format(label=label))).otherwise(reason)
    return reason


def require_metadata(logs: DataFrame) -> DataFrame:
    """Add ``reject_reason``; split with a filter on it."""
    return logs.withColumn("reject_reason", reject_reason())


def reject_undecoded(decoded: DataFrame, required: list[str]) -> DataFrame:
    """Set ``reject_reason`` where a required column could not be decoded."""
    reason = F.col("reject_reason")
    for name in required:
        reason = F.coalesce(reason, F.when(F.col(name).isNull(), F.lit(UNDECODABLE.format(name=name))))
    return decoded.withColumn("reject_reason", reason)


def chain_groups(routed: DataFrame, specs: DataFrame) -> DataFrame:
    """Per chain: specs, earliest start block, and the logs routed so far.  Both sides are
    aggregated before they meet, one row per chain."""
    wanted = specs.groupBy("chain").agg(
        F.count("*").alias("specs"), F.min("start_block").alias("min_start_block")
    )
    seen = routed.groupBy("chain").agg(
        F.count("*").alias("logs"), F.max("block_number").alias("last_block")
    )
    return wanted.join(seen, "chain", "left").select(
        "chain", "specs", "min_start_block", F.coalesce("logs", F.lit(0)).alias("logs"), "last_block"
    )


def high_water_mark(events: DataFrame, specs: DataFrame) -> DataFrame:
    """COALESCE(MAX(block_number), 0) per spec, specs without rows included."""
    marks = events.groupBy("spec").agg(F.max("block_number").alias("m"))
    return specs.select("spec").join(marks, "spec", "left").select(
        "spec", F.coalesce("m", F.lit(0)).cast("bigint").alias("max_block")
    )


def resume_points(specs: DataFrame, marks: DataFrame) -> DataFrame:
    """Where each spec continues: its high-water block again (a block may have been left
    half written; the key removes what is stored already), or its start block."""
    resume = F.when(F.col("max_block") > 0, F.greatest("max_block", "start_block")).otherwise(F.col("start_block"))
    return specs.join(marks, "spec", "left").withColumn("resume_block", resume)
