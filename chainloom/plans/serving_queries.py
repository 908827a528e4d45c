"""Requests: checked, bound, answered in bulk and delivered as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from chainloom import session
from chainloom.operators import requests as req
from chainloom.operators import positions, storage
from chainloom.operators.requests import Param
from chainloom.plans.endpoints import with_texts
from chainloom.plans.registry import NEWEST, fees, query, swaps
from chainloom.sources import feed

META_SQL = "block_number, block_timestamp, transaction_hash, log_index"
META = META_SQL.split(", ")

FEE_PARAMS = [
    Param("pool", "String", path=True),
    Param("limit", "u32", default=50),
    Param("startBlockTimestamp", "Option<u64>", default="null"),
    Param("endBlockTimestamp", "Option<u64>", default="null"),
    Param("step", "i64", default=-1),
    Param("exact", "Option<bool>", default=False),
    Param("note", "Option<String>", default="null"),
]

# Raw request texts by customer number; the same text is valid in both engines.
RAW = {
    "pool": """CASE c_custkey % 11 WHEN 3 THEN NULL WHEN 5 THEN concat('0x', repeat('G', 40)) WHEN 6 THEN 'short'
               ELSE concat('0x', lpad({hex}, 40, '0')) END""",
    "limit": "CASE c_custkey % 17 WHEN 0 THEN NULL WHEN 1 THEN '10' WHEN 2 THEN '200' WHEN 3 THEN '201' WHEN 4 THEN 'abc' WHEN 5 THEN '-5' WHEN 6 THEN '+7' WHEN 7 THEN '4294967296' WHEN 8 THEN '' ELSE '5' END",
    "startBlockTimestamp": "CASE c_custkey % 19 WHEN 1 THEN '800000000' WHEN 2 THEN 'null' WHEN 3 THEN '18446744073709551615' WHEN 4 THEN '18446744073709551616' WHEN 5 THEN '000000000000000000000000830000000' ELSE NULL END",
    "endBlockTimestamp": "CASE c_custkey % 3 WHEN 0 THEN '960000000' ELSE NULL END",
    "step": "CASE c_custkey % 23 WHEN 1 THEN '-9223372036854775808' WHEN 2 THEN '9223372036854775808' WHEN 3 THEN '+4' WHEN 4 THEN '1.5' ELSE NULL END",
    "exact": "CASE c_custkey % 29 WHEN 1 THEN 'true' WHEN 2 THEN 'false' WHEN 3 THEN 'True' WHEN 4 THEN 'null' ELSE NULL END",
    "note": "CASE c_custkey % 31 WHEN 1 THEN 'null' WHEN 2 THEN repeat('x', 1000) WHEN 3 THEN repeat('x', 1001) WHEN 4 THEN 'hello' WHEN 5 THEN repeat('é', 501) ELSE NULL END",
}


def fee_requests(spark: SparkSession, d: str) -> DataFrame:
    """One request per customer for the fees of its pool, with every kind of fault."""
    query_names = [n for n in RAW if n != "pool"]
    entries = ", ".join(f"'{n}', {RAW[n]}" for n in query_names)
    return feed.table(spark, d, "customer", "c_custkey").selectExpr(
        "c_custkey AS request_id",
        f"map('pool', {RAW['pool'].format(hex='lower(hex(c_custkey))')}, 'extra', 'ignored') AS path",
        f"map_filter(map({entries}, 'unlisted', 'x'' OR pool IS NOT NULL --'), (k, v) -> v IS NOT NULL) AS query",
    )


HEX_SQL = "printf('%x', c_custkey)"
_RAW_SQL = "SELECT c_custkey AS request_id, " + ", ".join(
    f"{sql.format(hex=HEX_SQL)} AS {name}_text" for name, sql in RAW.items()
) + " FROM customer"
_U64 = "regexp_full_match({0}, '[+]?[0-9]+') AND TRY_CAST(ltrim({0}, '+') AS UHUGEINT) <= 18446744073709551615::UHUGEINT"


def _not_u64(name: str) -> str:
    return f"{name}_text IS NOT NULL AND NOT coalesce({_U64.format(name + '_text')}, false)"


_CHECKED_SQL = f"""
    SELECT *, CASE
        WHEN pool_text IS NULL THEN 'Missing path parameter: pool'
        WHEN starts_with(pool_text, '0x') AND strlen(pool_text) = 42 AND NOT regexp_full_match(pool_text, '0x[0-9a-fA-F]{{40}}')
            THEN 'Parameter ''pool'' is not a valid Ethereum address'
        WHEN {_not_u64('limit')} THEN 'Parameter ''limit'' must be a positive integer'
        WHEN TRY_CAST(ltrim(limit_text, '+') AS UHUGEINT) > 4294967295 THEN 'Invalid limit parameter'
        WHEN TRY_CAST(ltrim(limit_text, '+') AS UHUGEINT) > 200 THEN 'Limit cannot exceed 200'
        WHEN {_not_u64('startBlockTimestamp')} THEN 'Parameter ''startBlockTimestamp'' must be a positive integer'
        WHEN {_not_u64('endBlockTimestamp')} THEN 'Parameter ''endBlockTimestamp'' must be a positive integer'
        WHEN step_text IS NOT NULL AND NOT (regexp_full_match(step_text, '[+-]?[0-9]+') AND TRY_CAST(ltrim(step_text, '+') AS BIGINT) IS NOT NULL)
            THEN 'Parameter ''step'' must be an integer'
        WHEN exact_text NOT IN ('true', 'false') THEN 'Parameter ''exact'' must be true or false'
        WHEN strlen(note_text) > 1000 THEN 'Parameter ''note'' exceeds maximum length' END AS error
    FROM raw_requests"""
_BOUND_SQL = """
    SELECT request_id, pool_text AS pool, CAST(coalesce(limit_text, '50') AS DECIMAL(20,0)) AS "limit",
           CAST(startBlockTimestamp_text AS DECIMAL(20,0)) AS startBlockTimestamp, CAST(endBlockTimestamp_text AS DECIMAL(20,0)) AS endBlockTimestamp,
           CAST(coalesce(step_text, '-1') AS BIGINT) AS step, coalesce(exact_text, 'false') = 'true' AS exact,
           CASE WHEN note_text <> 'null' THEN note_text END AS note
    FROM checked WHERE error IS NULL"""
_ANSWER_SQL = f"""
    SELECT * FROM (SELECT r.request_id, f.pool, f.block_number, f.block_timestamp, f.transaction_hash, f.log_index, f.fee,
                          row_number() OVER (PARTITION BY r.request_id ORDER BY {NEWEST}) AS rank, r."limit" AS lim
                   FROM bound r JOIN fees f ON f.pool = r.pool AND (r.startBlockTimestamp IS NULL OR f.block_timestamp >= r.startBlockTimestamp)
                        AND (r.endBlockTimestamp IS NULL OR f.block_timestamp <= r.endBlockTimestamp)) WHERE rank <= lim"""
SERVING = {"raw_requests": _RAW_SQL, "checked": _CHECKED_SQL, "bound": _BOUND_SQL, "answers": _ANSWER_SQL}


@query("SELECT request_id, error FROM checked", **SERVING)
def validate_requests(spark: SparkSession, d: str) -> DataFrame:
    return req.validate_requests(fee_requests(spark, d), FEE_PARAMS).select("request_id", "error")


def bound_requests(spark: SparkSession, d: str) -> DataFrame:
    accepted = req.validate_requests(fee_requests(spark, d), FEE_PARAMS).filter("error is null")
    return req.bind_defaults(accepted, FEE_PARAMS)


@query("SELECT * FROM bound", **SERVING)
def bind_defaults(spark: SparkSession, d: str) -> DataFrame:
    return bound_requests(spark, d)


def _shaped(bound: DataFrame) -> DataFrame:
    return bound.select(
        "request_id", F.lower("pool").alias("pool"), F.col("startBlockTimestamp").alias("start"),
        F.col("endBlockTimestamp").alias("end"), F.col("limit").alias("lim"),
    )


FEE_COLUMNS = ["chain", "pool", *META, "fee"]


def fee_store(spark: SparkSession, d: str) -> tuple[str, T.StructType]:
    """The fees, laid out by pool with their position index."""
    root, rows = session.scratch(spark, "fee-store"), fees(spark, d).select(*FEE_COLUMNS)
    positions.append(rows, root, "pool")
    return root, rows.schema


def answered(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Accepted requests are stored once, since answering reads them several times."""
    path = session.scratch(spark, "accepted")
    _shaped(bound_requests(spark, d)).write.parquet(path)
    requests = spark.read.schema("request_id bigint, pool string, start decimal(20,0), end decimal(20,0), lim decimal(20,0)").parquet(path)
    root, schema = fee_store(spark, d)
    return requests, positions.answer(spark, root, schema, requests, "pool", ["pool", *META, "fee"])


@query("SELECT pool, block_timestamp // 12000 AS slice, count(*) AS n FROM fees GROUP BY ALL")
def position_index(spark: SparkSession, d: str) -> DataFrame:
    """The index after three appends: two thirds, then the rest with a replay of a part, then
    that batch once more."""
    rows, root = fees(spark, d).select(*FEE_COLUMNS), session.scratch(spark, "positions")
    third = F.pmod(F.xxhash64("transaction_hash"), F.lit(3))
    positions.append(rows.where(third < 2), root, "pool")
    for _ in range(2):
        positions.append(rows.where(third > 0), root, "pool")
    return positions.index(spark, root, "pool")


@query(f"SELECT request_id, pool, {META_SQL}, CAST(fee AS VARCHAR) AS fee, CAST(rank AS INTEGER) AS rank FROM answers", **SERVING)
def answer_requests(spark: SparkSession, d: str) -> DataFrame:
    return with_texts(answered(spark, d)[1])


FEE_RESPONSE = {
    "pool": "String",
    "block_number": "i64",
    "block_timestamp": "i64",
    "transaction_hash": "String",
    "log_index": "i32",
    "fee": "String",
}


@query("""SELECT r.request_id, '{"data":[' || coalesce(string_agg(to_json({'pool': a.pool, 'block_number': a.block_number, 'block_timestamp': a.block_timestamp,
                 'transaction_hash': a.transaction_hash, 'log_index': a.log_index, 'fee': CAST(a.fee AS VARCHAR)})::VARCHAR, ',' ORDER BY a.rank) FILTER (a.rank IS NOT NULL), '')
                 || '],"count":' || count(a.rank) || '}' AS json
          FROM bound r LEFT JOIN answers a ON r.request_id = a.request_id GROUP BY r.request_id""", **SERVING)
def json_envelope(spark: SparkSession, d: str) -> DataFrame:
    requests, answers = answered(spark, d)
    newest_first = with_texts(answers).withColumn("order", -F.col("rank"))
    return storage.json_envelope(newest_first, requests, FEE_RESPONSE, ["order"])


@query("""SELECT transaction_hash, to_json({'sender': sender, 'block_number': block_number, 'tick': tick, 'amount0': CAST(amount0 AS VARCHAR),
                 'as_number': NULL, 'positive': tick > 0, 'maybe': CASE WHEN tick <> 0 THEN tick END})::VARCHAR AS json FROM swaps""")
def rows_to_json(spark: SparkSession, d: str) -> DataFrame:
    """Response fields with declared types; what does not convert is null."""
    t = with_texts(swaps(spark, d).select("transaction_hash", "sender", "block_number", "tick", "amount0"))
    t = t.select(
        "*", F.concat(F.lit("n"), "sender").alias("as_number"), (F.col("tick") > 0).alias("positive"),
        F.expr("nullif(tick, 0)").alias("maybe"),
    )
    fields = {
        "sender": "String", "block_number": "i64", "tick": "i32", "amount0": "String",
        "as_number": "i64", "positive": "bool", "maybe": "Option<u32>",
    }
    return storage.rows_to_json(t, fields, ("transaction_hash",))
