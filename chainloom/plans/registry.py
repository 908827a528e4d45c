"""Registered queries and, next to each, the SQL that must give the same rows.

The SQL reads the source tables; the query decodes the logs derived from them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from chainloom import session
from chainloom.operators import decode
from chainloom.sources import feed

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# The event tables, in terms of the source tables.
SOURCES = {
    "transfers": f"""
        SELECT 'mainnet' AS chain, event_id, event_type, user_id,
               CASE WHEN event_type IN ('view','click') THEN '{feed.TOKEN_A}' ELSE '{feed.TOKEN_B}' END AS address,
               event_id // 4 AS block_number, epoch_us(ts) // 1000000 AS block_timestamp,
               '0x' || printf('%064x', event_id) AS transaction_hash,
               CAST(event_id % 4 AS INTEGER) AS log_index,
               '0x' || printf('%040x', user_id) AS src, '0x' || printf('%040x', event_id % 97) AS dst,
               CAST(round(value * 100) AS HUGEINT) * 10000000000000000 AS wad
        FROM events""",
    "a": "SELECT * FROM transfers WHERE event_type IN ('view','click')",
    "b": """SELECT * EXCLUDE (src, dst, wad), src AS from_addr, dst AS to_addr, wad AS value
            FROM transfers WHERE event_type NOT IN ('view','click')""",
    "swaps_raw": """
        SELECT *, epoch_us(l_shipdate) // 1000000 + (l_orderkey * 37 + l_linenumber) % 86400 AS block_timestamp FROM lineitem""",
    "swaps": f"""
        SELECT 'mainnet' AS chain, '{feed.POOL_PREFIX}' || l_linenumber AS address,
               block_timestamp // 12 AS block_number, block_timestamp,
               '0x' || printf('%024x', l_orderkey) || printf('%020x', l_partkey) || printf('%020x', l_suppkey) AS transaction_hash,
               CAST(l_linenumber AS INTEGER) AS log_index,
               '0x' || printf('%040x', l_suppkey) AS sender, '0x' || printf('%040x', l_partkey) AS recipient,
               CAST(round(l_extendedprice * 100) AS HUGEINT) AS amount0, -CAST(l_quantity AS HUGEINT) AS amount1,
               CAST(l_orderkey AS HUGEINT) * 79228162514264337593543950336 AS sqrt_price_x96,
               CAST(l_linenumber AS HUGEINT) * 18446744073709551616 AS liquidity,
               CAST(l_linenumber - 4 AS INTEGER) AS tick
        FROM swaps_raw""",
    "fees": f"""
        SELECT 'sonic' AS chain, '{feed.FEE_MANAGER}' AS address, '0x' || printf('%040x', o_custkey) AS pool,
               CAST(round(o_totalprice * 100) AS HUGEINT) * 10000000000 AS fee,
               (epoch_us(o_orderdate) // 1000000) // 12 AS block_number, epoch_us(o_orderdate) // 1000000 AS block_timestamp,
               '0x' || printf('%064x', o_orderkey) AS transaction_hash, CAST(o_orderkey % 1000 AS INTEGER) AS log_index
        FROM orders""",
}
NEWEST = "block_timestamp DESC, block_number DESC, log_index DESC, transaction_hash"
IN_ORDER = "block_timestamp, block_number, log_index, transaction_hash"


def with_sources(sql: str, **extra: str) -> str:
    ctes = {**SOURCES, **extra}
    return "WITH " + ", ".join(f"{name} AS ({body})" for name, body in ctes.items()) + " " + sql


def e18(column: str) -> str:
    """SQL text of a non-negative integer divided by 10^18."""
    one = "1000000000000000000::HUGEINT"
    return f"CAST({column} // {one} AS VARCHAR) || '.' || lpad(CAST({column} % {one} AS VARCHAR), 18, '0')"


def query(sql: str | None = None, **extra: str):
    """Register a function under its name, with its oracle where SQL can express it."""

    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(session.prepare(spark), sf_dir)

        QUERIES[fn.__name__] = run
        if sql is not None:
            ORACLES[fn.__name__] = with_sources(sql, **extra)
        return fn

    return register


# --- decoded event tables ----------------------------------------------------------


def transfers_a(spark: SparkSession, d: str) -> DataFrame:
    return decode.event_table(feed.transfer_logs(spark, d), feed.TRANSFERS_A)


def transfers_b(spark: SparkSession, d: str) -> DataFrame:
    return decode.event_table(feed.transfer_logs(spark, d), feed.TRANSFERS_B)


def swaps(spark: SparkSession, d: str) -> DataFrame:
    """All pools: one event, several contracts, ``address`` names the pool."""
    return decode.decode_events(feed.swap_logs(spark, d), feed.SWAPS[0])


def fees(spark: SparkSession, d: str) -> DataFrame:
    return decode.event_table(feed.fee_logs(spark, d), feed.FEE_UPDATES)


def messages(spark: SparkSession, d: str) -> DataFrame:
    return decode.event_table(feed.message_logs(spark, d), feed.MESSAGES)


def damaged_transfers(spark: SparkSession, d: str) -> DataFrame:
    """The transfer feed with faults by event number: missing metadata, cut data, no topics."""
    logs = feed.transfer_logs(spark, d)
    fault = F.pmod(F.conv(F.substring("transaction_hash", 52, 15), 16, 10).cast("bigint"), F.lit(50))
    lose = lambda c, n: F.when(F.col("fault") != n, F.col(c)).alias(c)
    logs = logs.withColumn("fault", fault)
    return logs.select(
        "chain", "address",
        F.when(F.col("fault") == 9, F.array().cast("array<string>")).otherwise(F.col("topics")).alias("topics"),
        lose("topic0", 9),
        F.when(F.col("fault") == 5, F.substring("data", 1, 34)).otherwise(F.col("data")).alias("data"),
        lose("block_number", 37), lose("block_timestamp", 7), lose("transaction_hash", 17), lose("log_index", 27),
        "block_bucket",
    )
