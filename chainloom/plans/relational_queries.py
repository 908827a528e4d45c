"""Filters, joins, aggregates, windows, top-k and set operations over event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from chainloom.functions import u256
from chainloom.operators import topk
from chainloom.operators.topk import page, time_range
from chainloom.operators.windows import latest_per, over_rows, with_position
from chainloom.plans import endpoints
from chainloom.plans.endpoints import hour_of, with_texts
from chainloom.plans.registry import (
    IN_ORDER, NEWEST, e18, fees, query, swaps, transfers_a, transfers_b,
)
from chainloom.sources import feed

KEY = ["transaction_hash", "log_index"]
META_SQL = "block_number, block_timestamp, transaction_hash, log_index"
META = META_SQL.split(", ")
SWAP_SQL = f"""{META_SQL}, sender, recipient, CAST(amount0 AS VARCHAR) AS amount0, CAST(amount1 AS VARCHAR) AS amount1,
    CAST(sqrt_price_x96 AS VARCHAR) AS sqrt_price_x96, CAST(liquidity AS VARCHAR) AS liquidity, tick"""


# --- projection, filter, scalar functions ------------------------------------------------


@query("SELECT transaction_hash AS tx, block_number AS block, src AS sender, CAST(wad AS VARCHAR) AS amount FROM a")
def project_alias(spark: SparkSession, d: str) -> DataFrame:
    t = transfers_a(spark, d)
    return with_texts(t.select(
        F.col("transaction_hash").alias("tx"), F.col("block_number").alias("block"),
        F.col("src").alias("sender"), F.col("wad").alias("amount"),
    ))


@query(f"""SELECT {META_SQL}, src, CAST(wad AS VARCHAR) AS wad FROM a
           WHERE (wad > 500000000000000000 AND log_index <> 2) OR src = '0x' || printf('%040x', 7)""")
def filter_where(spark: SparkSession, d: str) -> DataFrame:
    seven = "0x" + format(7, "040x")
    kept = transfers_a(spark, d).filter(
        F.expr(f"(wad > {u256.literal(5 * 10**17)} and log_index <> 2) or src = '{seven}'")
    )
    return with_texts(kept.select(*META, "src", "wad"))


@query(f"""SELECT 'open' AS bounds, transaction_hash, log_index, tick FROM swaps
           UNION ALL SELECT 'start', transaction_hash, log_index, tick FROM swaps WHERE block_timestamp >= 900000000
           UNION ALL SELECT 'both', transaction_hash, log_index, tick FROM swaps WHERE block_timestamp BETWEEN 900000000 AND 930000000""")
def optional_filter(spark: SparkSession, d: str) -> DataFrame:
    """All branches of the optional bounds: none, start only, both."""
    def branch(name, start, end):
        return time_range(swaps(spark, d), start, end).select(F.lit(name).alias("bounds"), *KEY, "tick")

    return (
        branch("open", None, None)
        .unionAll(branch("start", 900_000_000, None))
        .unionAll(branch("both", 900_000_000, 930_000_000))
    )


@query(f"""SELECT {META_SQL}, src, dst, CAST(wad AS VARCHAR) AS wad FROM a
           WHERE src = '0x' || printf('%040x', 5) OR dst = '0x' || printf('%040x', 5) ORDER BY {NEWEST} LIMIT 200""")
def either_party_filter(spark: SparkSession, d: str) -> DataFrame:
    return endpoints.transfers(transfers_a(spark, d), "0x" + format(5, "040X"), 200)


@query("""SELECT transaction_hash, CASE WHEN wad >= 1000000000000000000 THEN 'large' WHEN wad >= 100000000000000000 THEN 'medium'
          ELSE 'small' END AS size FROM a""")
def case_when(spark: SparkSession, d: str) -> DataFrame:
    at_least = lambda n: F.expr(f"wad >= {u256.literal(n)}")
    size = F.when(at_least(10**18), "large").when(at_least(10**17), "medium").otherwise("small")
    return transfers_a(spark, d).select("transaction_hash", size.alias("size"))


@query("""SELECT transaction_hash, block_timestamp // 3600 * 3600 AS hour,
                 CAST(extract('hour' FROM to_timestamp(block_timestamp) AT TIME ZONE 'UTC') AS INTEGER) AS hour_of_day,
                 CAST(extract('day' FROM to_timestamp(block_timestamp) AT TIME ZONE 'UTC') AS INTEGER) AS day_of_month,
                 CAST(extract('month' FROM to_timestamp(block_timestamp) AT TIME ZONE 'UTC') AS INTEGER) AS month FROM swaps""")
def fn_time(spark: SparkSession, d: str) -> DataFrame:
    at = F.timestamp_seconds("block_timestamp")
    part = lambda p: F.extract(F.lit(p), at).cast("int")
    return swaps(spark, d).select(
        "transaction_hash", F.unix_timestamp(F.date_trunc("hour", at)).alias("hour"),
        part("HOUR").alias("hour_of_day"), part("DAY").alias("day_of_month"), part("MONTH").alias("month"),
    )


def whole_number(text: Column) -> Column:
    """Text as an int, NULL where it is none.  A cast that fails raises and catches an error in
    each row; no number has a letter, so that text with one is not tried."""
    return F.when(~text.rlike("[A-Za-z]"), text.try_cast("int"))


@query("""SELECT transaction_hash, CAST(block_number AS VARCHAR) AS block_text, CAST(block_timestamp AS DOUBLE) AS ts_double,
                 CAST(tick AS BIGINT) AS tick_long, CAST(amount1 AS BIGINT) AS amount1_long,
                 CAST(CAST(liquidity AS VARCHAR) AS DECIMAL(38,0)) AS liquidity_decimal, TRY_CAST('n' || sender AS INTEGER) AS not_a_number FROM swaps""")
def fn_cast(spark: SparkSession, d: str) -> DataFrame:
    table = swaps(spark, d).withColumn("a1", F.col("amount1"))
    table = u256.to_text(table, "a1")
    spelled = F.concat(F.lit("n"), "sender")
    return table.select(
        "transaction_hash",
        F.col("block_number").cast("string").alias("block_text"),
        F.col("block_timestamp").cast("double").alias("ts_double"),
        F.col("tick").cast("bigint").alias("tick_long"),
        F.col("a1").cast("bigint").alias("amount1_long"),
        F.expr(u256.narrow_decimal("liquidity")).alias("liquidity_decimal"),
        whole_number(spelled).alias("not_a_number"),
    )


@query("""SELECT coalesce(s.address, r.address) AS address, coalesce(s.n, 0) AS sent, coalesce(r.n, 0) AS received,
                 s.n IS NULL AS never_sent FROM (SELECT src AS address, count(*) AS n FROM a GROUP BY 1) s
          FULL JOIN (SELECT dst AS address, count(*) AS n FROM a GROUP BY 1) r ON s.address = r.address""")
def fn_null(spark: SparkSession, d: str) -> DataFrame:
    t = transfers_a(spark, d)
    s = t.groupBy(F.col("src").alias("address")).agg(F.count("*").alias("s"))
    r = t.groupBy(F.col("dst").alias("address")).agg(F.count("*").alias("r"))
    return s.join(r, "address", "full").select(
        "address", F.coalesce("s", F.lit(0)).alias("sent"), F.coalesce("r", F.lit(0)).alias("received"),
        F.col("s").isNull().alias("never_sent"),
    )


@query("""SELECT transaction_hash, log_index, tick + 1 AS plus, tick - 1 AS minus, greatest(tick, 0) AS top,
                 CASE WHEN tick <> 0 THEN 12.0::DOUBLE / tick END AS ratio FROM swaps""")
def fn_math(spark: SparkSession, d: str) -> DataFrame:
    tick = F.col("tick")
    return swaps(spark, d).select(
        *KEY, (tick + 1).alias("plus"), (tick - 1).alias("minus"), F.greatest(tick, F.lit(0)).alias("top"),
        F.try_divide(F.lit(12.0), tick).alias("ratio"),
    )


@query("""SELECT transaction_hash, to_json({'from': src, 'to': dst, 'wad': CAST(wad AS VARCHAR), 'block': block_number, 'note': NULL}) ::VARCHAR AS doc FROM a""")
def fn_json(spark: SparkSession, d: str) -> DataFrame:
    doc = F.struct(
        F.col("src").alias("from"), F.col("dst").alias("to"), "wad", F.col("block_number").alias("block"),
        F.lit(None).cast("string").alias("note"),
    )
    t = with_texts(transfers_a(spark, d))
    return t.select("transaction_hash", F.to_json(doc, {"ignoreNullFields": "false"}).alias("doc"))


@query("""SELECT t.src, t.transfers, t.latest FROM (SELECT src, count(*) AS transfers, max(block_number) AS latest FROM a GROUP BY src) t
          WHERE t.transfers > (SELECT count(*) / count(DISTINCT src) FROM a)""")
def subquery_cte(spark: SparkSession, d: str) -> DataFrame:
    """WITH, a derived table and a scalar subquery, through Spark SQL."""
    return spark.sql(
        """WITH t AS (SELECT src, count(*) AS transfers, max(block_number) AS latest FROM {a} GROUP BY src)
           SELECT src, transfers, latest FROM t
           WHERE transfers > (SELECT sum(transfers) / count(*) FROM t)""",
        a=transfers_a(spark, d),
    )


# --- joins ----------------------------------------------------------------------------------


@query("""SELECT s.transaction_hash, s.log_index, s.address AS pool, v.swaps, CAST(v.total AS VARCHAR) AS total_volume
          FROM swaps s INNER JOIN (SELECT address, block_number, count(*) AS swaps, sum(amount0) AS total FROM swaps GROUP BY 1, 2) v
          ON s.address = v.address AND s.block_number = v.block_number""")
def join_inner_composite(spark: SparkSession, d: str) -> DataFrame:
    """Every swap with the volume of its pool in its block.  The block in the key spreads
    a busy pool over all partitions."""
    t = swaps(spark, d)
    on = ["address", "block_number"]
    volume = u256.sums(t.groupBy(*on), total_volume="amount0").withColumnRenamed("n", "swaps")
    joined = t.select(*KEY, *on).join(volume, on)
    return with_texts(joined.select(*KEY, F.col("address").alias("pool"), "swaps", "total_volume"))


SENT = "(SELECT src AS address, count(*) AS sent, max(block_number) AS last_sent FROM a GROUP BY 1)"
GOT = "(SELECT to_addr AS address, count(*) AS received, max(block_number) AS last_received FROM b GROUP BY 1)"


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """One row per address on each side, so no join here can fan out."""
    sent = transfers_a(spark, d).groupBy(F.col("src").alias("address")).agg(
        F.count("*").alias("sent"), F.max("block_number").alias("last_sent"))
    got = transfers_b(spark, d).groupBy(F.col("to_addr").alias("address")).agg(
        F.count("*").alias("received"), F.max("block_number").alias("last_received"))
    return sent, got


@query(f"SELECT s.address, sent, last_sent, received, last_received FROM {SENT} s LEFT JOIN {GOT} g ON s.address = g.address")
def join_left(spark: SparkSession, d: str) -> DataFrame:
    sent, got = _sides(spark, d)
    return sent.join(got, "address", "left")


@query(f"SELECT g.address, sent, last_sent, received, last_received FROM {GOT} g LEFT JOIN {SENT} s ON s.address = g.address")
def join_right(spark: SparkSession, d: str) -> DataFrame:
    sent, got = _sides(spark, d)
    return sent.join(got, "address", "right")


@query(f"""SELECT coalesce(s.address, g.address) AS address, sent, last_sent, received, last_received
           FROM {SENT} s FULL JOIN {GOT} g ON s.address = g.address""")
def join_full(spark: SparkSession, d: str) -> DataFrame:
    sent, got = _sides(spark, d)
    return sent.join(got, "address", "full")


@query("""SELECT x.address, greatest(coalesce(max(a.block_number), 0), coalesce(max(b.block_number), 0)) AS latest_block_number,
                 greatest(coalesce(max(a.block_timestamp), 0), coalesce(max(b.block_timestamp), 0)) AS latest_block_timestamp
          FROM (SELECT src AS address FROM a UNION SELECT to_addr FROM b) x LEFT JOIN a ON x.address = a.src LEFT JOIN b ON x.address = b.to_addr
          WHERE a.block_timestamp >= 1706000000 OR b.block_timestamp >= 1706000000
          GROUP BY x.address ORDER BY 3 DESC, 1 LIMIT 200""")
def active_either(spark: SparkSession, d: str) -> DataFrame:
    found = endpoints.active_either(transfers_a(spark, d), transfers_b(spark, d), 1_706_000_000)
    return endpoints.whales(found, 200)


@query("""SELECT s.address, greatest(s.b, g.b) AS latest_block_number, greatest(s.t, g.t) AS latest_block_timestamp
          FROM (SELECT src AS address, max(block_number) AS b, max(block_timestamp) AS t FROM a GROUP BY 1) s
          JOIN (SELECT to_addr AS address, max(block_number) AS b, max(block_timestamp) AS t FROM b GROUP BY 1) g ON s.address = g.address""")
def active_both(spark: SparkSession, d: str) -> DataFrame:
    return endpoints.active_both(transfers_a(spark, d), transfers_b(spark, d))


@query("""SELECT coalesce(s.address, g.address) AS address, greatest(coalesce(s.b, 0), coalesce(g.b, 0)) AS latest_block_number,
                 greatest(coalesce(s.t, 0), coalesce(g.t, 0)) AS latest_block_timestamp
          FROM (SELECT src AS address, max(block_number) AS b, max(block_timestamp) AS t FROM a GROUP BY 1) s
          FULL JOIN (SELECT to_addr AS address, max(block_number) AS b, max(block_timestamp) AS t FROM b GROUP BY 1) g ON s.address = g.address""")
def greatest_coalesce(spark: SparkSession, d: str) -> DataFrame:
    return endpoints.active_either(transfers_a(spark, d), transfers_b(spark, d))


# --- aggregates -------------------------------------------------------------------------------


@query("""SELECT address AS pool, count(*) AS swaps, CAST(sum(amount0) AS VARCHAR) AS total, CAST((2 * sum(amount0) + count(*)) // (2 * count(*)) AS VARCHAR) AS average,
                 CAST(min(amount0) AS VARCHAR) AS low, CAST(max(amount0) AS VARCHAR) AS high, CAST(sum(tick) AS BIGINT) AS ticks FROM swaps GROUP BY address""")
def agg_basic(spark: SparkSession, d: str) -> DataFrame:
    out = swaps(spark, d).groupBy(F.col("address").alias("pool")).agg(
        F.count("*").alias("swaps"), F.expr(u256.sum_parts("amount0")).alias("total"),
        F.min("amount0").alias("low"), F.max("amount0").alias("high"), F.sum("tick").alias("ticks"),
    )
    out = out.withColumn("total", F.expr(u256.from_sum_parts("total")))
    return with_texts(out.withColumn("average", F.expr(u256.average_text("total", "swaps"))))


@query("""SELECT block_timestamp // 3600 * 3600 AS hour, CAST((2 * sum(wad) + count(*)) // (2 * count(*)) AS VARCHAR) AS avg_value,
                 CAST(max(wad) AS VARCHAR) AS max_value, CAST(min(wad) AS VARCHAR) AS min_value, count(*) AS event_count FROM a GROUP BY 1""")
def hourly_stats(spark: SparkSession, d: str) -> DataFrame:
    out = transfers_a(spark, d).groupBy(hour_of(F.col("block_timestamp")).alias("hour")).agg(
        F.expr(u256.sum_parts("wad")).alias("total"), F.max("wad").alias("max_value"), F.min("wad").alias("min_value"),
        F.count("*").alias("event_count"),
    )
    out = out.withColumn("total", F.expr(u256.from_sum_parts("total")))
    out = out.withColumn("avg_value", F.expr(u256.average_text("total", "event_count")))
    return with_texts(out.drop("total"))


@query("""SELECT block_timestamp // 3600 * 3600 AS hour, count(*) AS swap_count, CAST(sum(amount0) AS VARCHAR) AS total_amount0,
                 CAST(sum(amount1) AS VARCHAR) AS total_amount1 FROM swaps WHERE block_timestamp BETWEEN 850000000 AND 980000000
          GROUP BY 1 ORDER BY hour DESC LIMIT 200""")
def hourly_volume(spark: SparkSession, d: str) -> DataFrame:
    return endpoints.hourly_volume(swaps(spark, d), 850_000_000, 980_000_000, 200)


@query("""SELECT block_number, count(*) AS transfers, '[' || string_agg(to_json({'log_index': log_index, 'src': src, 'wad': CAST(wad AS VARCHAR)})::VARCHAR, ',' ORDER BY log_index) || ']' AS items
          FROM a GROUP BY block_number""")
def json_aggregate(spark: SparkSession, d: str) -> DataFrame:
    """The transfers of each block as nested JSON.  A block bounds its list by the gas limit."""
    t = with_texts(transfers_a(spark, d).select("block_number", "log_index", "src", "wad"))
    items = F.sort_array(F.collect_list(F.struct("log_index", "src", "wad")))
    return t.groupBy("block_number").agg(F.count("*").alias("transfers"), F.to_json(items).alias("items"))


@query(f"""SELECT pool, {META_SQL}, {e18('fee')} AS fee FROM (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY {NEWEST.replace('transaction_hash', 'transaction_hash DESC')}) AS n FROM fees) WHERE n = 1""")
def distinct_on_latest(spark: SparkSession, d: str) -> DataFrame:
    newest = with_texts(latest_per(fees(spark, d), ["pool"], [*META, "fee"]))
    return newest.withColumn("fee", F.expr(u256.shift_text("fee")))


# --- windows ------------------------------------------------------------------------------------


@query(f"SELECT pool, transaction_hash, row_number() OVER (PARTITION BY pool ORDER BY {IN_ORDER}) AS position FROM fees")
def win_row_number(spark: SparkSession, d: str) -> DataFrame:
    return with_position(fees(spark, d).select("pool", *META), ["pool"]).select("pool", "transaction_hash", "position")


@query(f"""SELECT transaction_hash, log_index, lag(tick) OVER w AS tick_before, lead(tick, 2) OVER w AS tick_two_on
           FROM swaps WINDOW w AS (PARTITION BY address ORDER BY {IN_ORDER})""")
def win_lag_lead(spark: SparkSession, d: str) -> DataFrame:
    """Seven pools share all swaps, so every pool is a hot key."""
    rows = swaps(spark, d).select("address", *META, "sender", "tick")
    columns = {"tick_before": lambda w: F.lag("tick").over(w), "tick_two_on": lambda w: F.lead("tick", 2).over(w)}
    return over_rows(rows, ["address"], columns, before=1, after=2).select(*KEY, "tick_before", "tick_two_on")


@query(f"""SELECT transaction_hash, log_index, first_value(sender) OVER w AS first_sender, last_value(sender) OVER w AS last_sender,
                  last_value(sender) OVER (PARTITION BY address ORDER BY {IN_ORDER}) AS current_sender
           FROM swaps WINDOW w AS (PARTITION BY address ORDER BY {IN_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def win_first_last(spark: SparkSession, d: str) -> DataFrame:
    """Over the whole entity, and LAST_VALUE under the default frame: that is the current
    row's own value, since the order has no ties."""
    rows = swaps(spark, d).select("address", *META, "sender")
    found = with_position(rows, ["address"], first_last=("sender",))
    return found.select(*KEY, "first_sender", "last_sender", F.col("sender").alias("current_sender"))


@query(f"""SELECT pool, {META_SQL}, CAST(fee AS VARCHAR) AS fee, CAST(previous AS VARCHAR) AS previous_fee, CAST(fee - previous AS VARCHAR) AS change
           FROM (SELECT *, lag(fee) OVER (PARTITION BY pool ORDER BY {IN_ORDER}) AS previous FROM fees) ORDER BY {NEWEST} LIMIT 200""")
def change_vs_previous(spark: SparkSession, d: str) -> DataFrame:
    rows = fees(spark, d).select("pool", *META, "fee")
    rows = over_rows(rows, ["pool"], {"previous_fee": lambda w: F.lag("fee").over(w)}, before=1).drop("position")
    newest = topk.recent_first(rows.withColumn("change", F.expr(u256.subtract("fee", "previous_fee"))), 200)
    return with_texts(newest)


FEE_SERIES = f"""SELECT pool, {META_SQL}, {e18('fee')} AS fee, {e18('(area // span)')} AS twa_fee, true AS in_range FROM (
             SELECT *, sum(held * dt) OVER r AS area, CASE WHEN sum(dt) OVER r > 0 THEN sum(dt) OVER r END AS span FROM (
               SELECT *, lag(fee) OVER q AS held, (block_timestamp - lag(block_timestamp) OVER q)::HUGEINT AS dt FROM fees
               WINDOW q AS (PARTITION BY pool ORDER BY {IN_ORDER}))
             WINDOW r AS (PARTITION BY pool ORDER BY {IN_ORDER} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))"""


@query(FEE_SERIES)
def twa_last_10(spark: SparkSession, d: str) -> DataFrame:
    return endpoints.fee_texts(endpoints.fee_series(fees(spark, d)))


FEE_POOL = "0x" + f"{7:040x}"


@query(f"SELECT * FROM ({FEE_SERIES}) WHERE pool = '{FEE_POOL}' AND block_timestamp >= 800000000 ORDER BY {NEWEST} LIMIT 200")
def fee_change(spark: SparkSession, d: str) -> DataFrame:
    """The fee endpoint of one pool with all its parameters."""
    return endpoints.fee_change(fees(spark, d), FEE_POOL, 800_000_000, 200)


# --- sort and limit -------------------------------------------------------------------------------


@query(f"SELECT {META_SQL}, src, dst, CAST(wad AS VARCHAR) AS wad FROM a ORDER BY {NEWEST} LIMIT 50")
def recent_first(spark: SparkSession, d: str) -> DataFrame:
    return endpoints.transfers(transfers_a(spark, d))


@query(f"SELECT {SWAP_SQL} FROM swaps WHERE address = '{feed.SWAPS[2].address}' AND block_timestamp BETWEEN 850000000 AND 980000000 ORDER BY {NEWEST} LIMIT 200")
def swaps_by_pool(spark: SparkSession, d: str) -> DataFrame:
    return endpoints.swaps_by_pool(swaps(spark, d), feed.SWAPS[2].address, 850_000_000, 980_000_000, 200)


@query(f"SELECT {SWAP_SQL} FROM swaps WHERE sender = '0x' || printf('%040x', 3) AND block_timestamp >= 850000000 ORDER BY {NEWEST} LIMIT 200")
def swaps_by_sender(spark: SparkSession, d: str) -> DataFrame:
    return endpoints.swaps_by_sender(swaps(spark, d), "0x" + format(3, "040x"), 850_000_000, None, 200)


@query(f"SELECT {META_SQL}, src, CAST(wad AS VARCHAR) AS wad FROM a ORDER BY {NEWEST} LIMIT 200 OFFSET 120")
def page_offset(spark: SparkSession, d: str) -> DataFrame:
    return with_texts(page(transfers_a(spark, d).select(*META, "src", "wad"), 200, 120))


# --- sets -------------------------------------------------------------------------------------------


@query("SELECT src AS address FROM a UNION SELECT to_addr FROM b")
def union_distinct(spark: SparkSession, d: str) -> DataFrame:
    a = transfers_a(spark, d).select(F.col("src").alias("address"))
    return a.union(transfers_b(spark, d).select("to_addr")).distinct()


@query("SELECT src AS address FROM a INTERSECT SELECT to_addr FROM b")
def intersect_addresses(spark: SparkSession, d: str) -> DataFrame:
    """Duplicates are removed before the sides meet, so a busy address is one row."""
    a = transfers_a(spark, d).select(F.col("src").alias("address")).distinct()
    return a.intersect(transfers_b(spark, d).select("to_addr").distinct())
