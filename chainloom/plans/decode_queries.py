"""Decoding, one query per kind of value."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from chainloom.functions import u256
from chainloom.operators import decode
from chainloom.plans.endpoints import with_texts
from chainloom.plans.registry import (
    damaged_transfers, e18, messages, query, swaps, transfers_a,
)
from chainloom.sources import feed
from chainloom.sources.specs import EventField as Field, EventSpec


@query("SELECT transaction_hash, log_index, sender, recipient FROM swaps")
def decode_address(spark: SparkSession, d: str) -> DataFrame:
    return swaps(spark, d).select("transaction_hash", "log_index", "sender", "recipient")


@query("SELECT transaction_hash, l_quantity >= 25 AS large, false AS never FROM lineitem_tx",
       lineitem_tx="""SELECT '0x' || printf('%024x', l_orderkey) || printf('%020x', l_partkey) || printf('%020x', l_suppkey) AS transaction_hash,
                      l_quantity FROM lineitem""")
def decode_bool(spark: SparkSession, d: str) -> DataFrame:
    """bool words: the upper half of the quantity range as true."""
    logs = feed.swap_logs(spark, d)
    quantity = F.conv(F.substring("data", 3 + 64 + 62, 2), 16, 10).cast("int")  # low byte of -quantity
    word = F.when(256 - quantity >= 25, feed.hex_of(F.lit(1))).otherwise(feed.hex_of(F.lit(0)))
    logs = logs.withColumn("data", F.concat(F.lit("0x"), word, feed.hex_of(F.lit(0))))
    spec = EventSpec("flags", feed.MAINNET, "", "Flags", (Field("large", "bool"), Field("never", "bool")))
    return decode.decode_events(logs, spec, ("transaction_hash",))


@query("""SELECT transaction_hash, CAST(l_linenumber AS SMALLINT) AS line8, CAST(l_suppkey % 65536 AS INTEGER) AS supp16,
                 CAST(l_partkey % 16777216 AS INTEGER) AS part24, l_partkey AS part32,
                 CAST(l_orderkey AS DECIMAL(20,0)) AS order64 FROM t""",
       t="""SELECT *, '0x' || printf('%024x', l_orderkey) || printf('%020x', l_partkey) || printf('%020x', l_suppkey) AS transaction_hash FROM lineitem""")
def decode_uint_small(spark: SparkSession, d: str) -> DataFrame:
    logs = feed.swap_logs(spark, d)
    word = lambda c: F.lpad(c, 64, "0")
    tx = F.col("transaction_hash")
    part, supp, order = F.substring(tx, 27, 20), F.substring(tx, 47, 20), F.substring(tx, 3, 24)
    logs = logs.withColumn("data", F.concat(
        F.lit("0x"), feed.hex_of(F.col("log_index")), word(F.substring(supp, 17, 4)), word(F.substring(part, 15, 6)), word(part), word(order)))
    fields = [("line8", "uint8"), ("supp16", "uint16"), ("part24", "uint24"), ("part32", "uint32"), ("order64", "uint64")]
    spec = EventSpec("small", feed.MAINNET, "", "Small", tuple(Field(n, k) for n, k in fields))
    return decode.decode_events(logs, spec, ("transaction_hash",))


@query("""SELECT transaction_hash, log_index, CAST(sqrt_price_x96 AS VARCHAR) AS sqrt_price_x96,
                 CAST(liquidity AS VARCHAR) AS liquidity FROM swaps""")
def decode_uint256(spark: SparkSession, d: str) -> DataFrame:
    return with_texts(swaps(spark, d).select("transaction_hash", "log_index", "sqrt_price_x96", "liquidity"))


@query("""SELECT transaction_hash, log_index, CAST(amount0 AS VARCHAR) AS amount0, CAST(amount1 AS VARCHAR) AS amount1, tick FROM swaps""")
def decode_int(spark: SparkSession, d: str) -> DataFrame:
    return with_texts(swaps(spark, d).select("transaction_hash", "log_index", "amount0", "amount1", "tick"))


@query("""SELECT transaction_hash, '0x' || printf('%08x', user_id) AS b4, '0x' || printf('%064x', event_id) AS b32 FROM transfers""")
def decode_bytes_n(spark: SparkSession, d: str) -> DataFrame:
    """bytesN is left-aligned; the same form from a topic and from data."""
    logs = feed.transfer_logs(spark, d)
    user = F.substring(F.get("topics", F.lit(1)), 59, 8)
    tx = F.col("transaction_hash")
    logs = logs.withColumns({
        "data": F.concat(F.lit("0x"), user, F.lit("0" * 56)),
        "topics": F.array(F.col("topic0"), tx),
    })
    spec = EventSpec("bytes", feed.MAINNET, "", "Bytes", (Field("b4", "bytes4"), Field("b32", "bytes32", True)))
    return decode.decode_events(logs, spec, ("transaction_hash",))


@query("SELECT '0x' || printf('%064x', doc_id) AS transaction_hash, text FROM documents")
def decode_dynamic(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts through offset, length and bytes."""
    return messages(spark, d).select("transaction_hash", "text")


@query("""SELECT '0x' || printf('%064x', doc_id) AS transaction_hash,
                 '[' || array_to_string(list_transform(string_split(lang, ''), lambda x: CAST(ascii(x) AS VARCHAR)), ',') || ']' AS codes
          FROM documents""")
def decode_array(spark: SparkSession, d: str) -> DataFrame:
    return messages(spark, d).select("transaction_hash", F.to_json("codes").alias("codes"))


@query("""SELECT '0x' || printf('%064x', doc_id) AS transaction_hash, '0x' || printf('%040x', doc_id % 1000) AS owner, CAST(doc_id * 1000 AS VARCHAR) AS amount,
                 '[' || doc_id % 3 || ',' || doc_id % 1000 || ',' || doc_id || ']' AS trio, '["' || lang || '","' || source || '"]' AS names,
                 '[[' || doc_id % 100 || ',' || doc_id % 7 || '],[],[' || doc_id % 50000 || ']]' AS grid, CAST(doc_id * 2 AS DECIMAL(20,0)) AS behind,
                 '[{"c1":"' || source || '","c2":[true,' || CASE WHEN doc_id % 2 = 0 THEN 'false' ELSE 'true' END || ']}]' AS pairs FROM documents""")
def decode_nested(spark: SparkSession, d: str) -> DataFrame:
    """A tuple, a fixed array, an array of strings, an array of arrays and an array of tuples
    that hold a string and a fixed array, with a plain field behind them."""
    t = with_texts(decode.event_table(feed.nested_logs(spark, d), feed.NESTED).select("transaction_hash", "pair.*", "trio", "names", "grid", "behind", "pairs"))
    json = [F.to_json(c).alias(c) for c in ("trio", "names", "grid", "pairs")]
    return t.select("transaction_hash", F.col("c1").alias("owner"), F.col("c2").alias("amount"), "behind", *json)


@query("""SELECT event_id // 4 AS block_number, src, dst, CASE WHEN event_id % 50 <> 5 THEN CAST(wad AS VARCHAR) END AS wad
          FROM transfers WHERE event_id % 50 NOT IN (9, 37)""")
def decode_short_data(spark: SparkSession, d: str) -> DataFrame:
    """A word past the end of the data is NULL; the rest of the row stays."""
    logs = damaged_transfers(spark, d).filter("topic0 is not null and block_number is not null")
    return with_texts(decode.decode_events(logs, feed.TRANSFERS_A, ("block_number",)))


@query("SELECT transaction_hash, '0x' || printf('%064x', wad) AS other, '0x' || printf('%064x', user_id) AS topic FROM transfers")
def decode_default_hex(spark: SparkSession, d: str) -> DataFrame:
    """A type the decoder does not know keeps its word as hex, from data and from a topic."""
    spec = EventSpec("odd", feed.MAINNET, "", "Odd", (Field("topic", "function", True), Field("other", "ufixed128x18")))
    return decode.decode_events(feed.transfer_logs(spark, d), spec, ("transaction_hash",))


@query("""SELECT transaction_hash, CASE event_id % 3 WHEN 0 THEN src WHEN 1 THEN src ELSE '0x' || printf('%040x', event_id % 97) END AS src,
                 CASE event_id % 3 WHEN 0 THEN dst WHEN 1 THEN '0x' || printf('%040x', event_id % 97) ELSE src END AS dst,
                 CAST(wad AS VARCHAR) AS wad FROM transfers""")
def split_topics_data(spark: SparkSession, d: str) -> DataFrame:
    """Indexed fields use up topics, then read data words: three log shapes of one event.

    A third of the logs has both topics; a third lacks the second, whose value leads the
    data; a third lacks both (with the two values in swapped order)."""
    logs = feed.transfer_logs(spark, d)
    shape = F.pmod(F.conv(F.substring("transaction_hash", 52, 15), 16, 10).cast("bigint"), F.lit(3))
    topics = F.col("topics")
    word = lambda k: F.substring(F.get(topics, F.lit(k)), 3, 64)
    amount = F.substring("data", 3, 64)
    logs = logs.withColumns({
        "topics": F.when(shape == 0, topics).when(shape == 1, F.slice(topics, 1, 2)).otherwise(F.slice(topics, 1, 1)),
        "data": F.when(shape == 0, F.col("data"))
        .when(shape == 1, F.concat(F.lit("0x"), word(2), amount))
        .otherwise(F.concat(F.lit("0x"), word(2), word(1), amount)),
    })
    return with_texts(decode.decode_events(logs, feed.TRANSFERS_A, ("transaction_hash",)))


@query("""SELECT block_number, block_timestamp, transaction_hash, log_index, sender, recipient, CAST(amount0 AS VARCHAR) AS amount0,
                 CAST(amount1 AS VARCHAR) AS amount1, CAST(sqrt_price_x96 AS VARCHAR) AS sqrt_price_x96,
                 CAST(liquidity AS VARCHAR) AS liquidity, tick FROM swaps""")
def typed_columns(spark: SparkSession, d: str) -> DataFrame:
    """The decoded table has exactly the declared column types."""
    table = swaps(spark, d)
    for f in feed.SWAPS[0].schema.fields:
        if table.schema[f.name].dataType != f.dataType:
            raise TypeError(f"{f.name} decodes to {table.schema[f.name].dataType}")
    return with_texts(table.drop("chain", "address"))


# --- 256-bit arithmetic ----------------------------------------------------------------


@query("""SELECT address, CAST(min(amount1) AS VARCHAR) AS low, CAST(max(sqrt_price_x96) AS VARCHAR) AS high,
                 count(*) FILTER (amount0 > 5000000) AS above, count(*) FILTER (amount1 = -25) AS equal FROM swaps GROUP BY address""")
def u256_compare_minmax(spark: SparkSession, d: str) -> DataFrame:
    return with_texts(swaps(spark, d).groupBy("address").agg(
        F.min("amount1").alias("low"),
        F.max("sqrt_price_x96").alias("high"),
        F.count_if(F.expr(f"amount0 > {u256.literal(5_000_000)}")).alias("above"),
        F.count_if(F.expr(f"amount1 = {u256.literal(-25)}")).alias("equal"),
    ))


@query("""SELECT address, CAST(sum(amount0) AS VARCHAR) AS total0, CAST(sum(amount1) AS VARCHAR) AS total1,
                 CAST(sum(liquidity) AS VARCHAR) AS total_liquidity FROM swaps GROUP BY address""")
def u256_sum(spark: SparkSession, d: str) -> DataFrame:
    totals = u256.sums(swaps(spark, d).groupBy("address"), total0="amount0", total1="amount1", total_liquidity="liquidity")
    return with_texts(totals.drop("n"))


@query("""SELECT address, CAST((2 * s0 + n) // (2 * n) AS VARCHAR) AS avg0,
                 CAST(sl // n AS VARCHAR) AS avg_liquidity,
                 '-' || CAST((-s1) // n AS VARCHAR) || '.' || lpad(CAST(((-s1) % n * 200 + n) // (2 * n) AS VARCHAR), 2, '0') AS avg1
          FROM (SELECT address, sum(amount0) AS s0, sum(amount1) AS s1, sum(liquidity) AS sl, count(*)::HUGEINT AS n FROM swaps GROUP BY address)""")
def u256_avg(spark: SparkSession, d: str) -> DataFrame:
    out = u256.sums(swaps(spark, d).groupBy("address"), s0="amount0", s1="amount1", sl="liquidity")
    average = lambda c, scale=0: F.expr(u256.average_text(c, "n", scale))
    return out.select("address", average("s0").alias("avg0"), average("sl").alias("avg_liquidity"), average("s1", 2).alias("avg1"))


@query("SELECT transaction_hash, log_index, CAST(amount1 - amount0 AS VARCHAR) AS change, CAST(liquidity - sqrt_price_x96 AS VARCHAR) AS wide_change FROM swaps")
def u256_diff(spark: SparkSession, d: str) -> DataFrame:
    return with_texts(swaps(spark, d).select(
        "transaction_hash", "log_index",
        F.expr(u256.subtract("amount1", "amount0")).alias("change"),
        F.expr(u256.subtract("liquidity", "sqrt_price_x96")).alias("wide_change"),
    ))


@query(f"SELECT transaction_hash, {e18('wad')} AS amount, CAST(wad AS DOUBLE) / 1e18 > 1 AS above_one FROM a")
def scale_1e18(spark: SparkSession, d: str) -> DataFrame:
    table = with_texts(transfers_a(spark, d).select("transaction_hash", "wad", F.expr(f"wad > {u256.literal(10**18)}").alias("above_one")))
    return table.select("transaction_hash", F.expr(u256.shift_text("wad")).alias("amount"), "above_one")
