"""The analytic questions, as functions of event tables with named parameters.

256-bit columns stay numbers through every operator and become decimal text last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from chainloom.functions import u256
from chainloom.operators.topk import recent_first, time_range
from chainloom.operators.windows import over_rows
from chainloom.sources.schemas import META


def hour_of(ts: Column) -> Column:
    """Start of the UTC hour, as epoch seconds."""
    return ts - F.pmod(ts, F.lit(3600))


def with_texts(df: DataFrame) -> DataFrame:
    """All 256-bit columns as decimal text."""
    names = [
        f.name
        for f in df.schema.fields
        if getattr(f.dataType, "names", None) == list(u256.LIMBS)
    ]
    return u256.to_text(df, *names) if names else df


def transfers(table: DataFrame, address: str | None = None, limit: int | None = None) -> DataFrame:
    """Recent transfers, optionally of one party on either side."""
    if address is not None:
        table = table.filter((F.col("src") == address.lower()) | (F.col("dst") == address.lower()))
    return with_texts(recent_first(table.select(*META, "src", "dst", "wad"), limit))


def swap_columns(table: DataFrame) -> DataFrame:
    return table.select(
        *META, "sender", "recipient", "amount0", "amount1", "sqrt_price_x96", "liquidity", "tick"
    )


def swaps_by_pool(table: DataFrame, pool: str, start: int | None = None, end: int | None = None, limit: int | None = None) -> DataFrame:
    found = time_range(table.filter(F.col("address") == pool.lower()), start, end)
    return with_texts(recent_first(swap_columns(found), limit))


def swaps_by_sender(table: DataFrame, sender: str, start: int | None = None, end: int | None = None, limit: int | None = None) -> DataFrame:
    found = time_range(table.filter(F.col("sender") == sender.lower()), start, end)
    return with_texts(recent_first(swap_columns(found), limit))


def hourly_totals(table: DataFrame) -> DataFrame:
    """Swaps and exact totals per hour.  Hours are partially summed in every task, so only
    one row per task and hour is shuffled."""
    hours = table.groupBy(hour_of(F.col("block_timestamp")).alias("hour"))
    totals = u256.sums(hours, total_amount0="amount0", total_amount1="amount1")
    return totals.withColumnRenamed("n", "swap_count")


def hourly_volume(table: DataFrame, start: int | None = None, end: int | None = None, limit: int | None = None) -> DataFrame:
    hours = hourly_totals(time_range(table, start, end))
    return with_texts(recent_first(hours, limit, [F.col("hour").desc()]))


def last_seen(table: DataFrame, address: str) -> DataFrame:
    """Latest block and time per address, one row each: what whales queries need of a side."""
    return table.groupBy(F.col(address).alias("address")).agg(
        F.max("block_number").alias("b"), F.max("block_timestamp").alias("t")
    )


def _latest(joined: DataFrame, start: int | None) -> DataFrame:
    if start is not None:
        joined = joined.filter((F.col("a.t") >= start) | (F.col("u.t") >= start))
    zero = F.lit(0).cast("bigint")
    latest = lambda c: F.greatest(F.coalesce(f"a.{c}", zero), F.coalesce(f"u.{c}", zero))
    return joined.select(
        F.coalesce("a.address", "u.address").alias("address"),
        latest("b").alias("latest_block_number"),
        latest("t").alias("latest_block_timestamp"),
    )


WHALE_ORDER = ("latest_block_timestamp", "address")


def active_either(senders: DataFrame, receivers: DataFrame, start: int | None = None) -> DataFrame:
    """Addresses that sent in one table or received in the other, with their latest
    activity.  Both sides are aggregated before they meet, so the join is one row to one
    and never fans out by transfers times transfers."""
    a, u = last_seen(senders, "src").alias("a"), last_seen(receivers, "to_addr").alias("u")
    return _latest(a.join(u, F.col("a.address") == F.col("u.address"), "full"), start)


def active_both(senders: DataFrame, receivers: DataFrame, start: int | None = None) -> DataFrame:
    """Addresses that did both."""
    a, u = last_seen(senders, "src").alias("a"), last_seen(receivers, "to_addr").alias("u")
    return _latest(a.join(u, F.col("a.address") == F.col("u.address")), start)


def whales(table: DataFrame, limit: int | None = None) -> DataFrame:
    return recent_first(table, limit, [F.col("latest_block_timestamp").desc(), F.col("address")])


PERIODS = 10


def fee_series(table: DataFrame, **tuning) -> DataFrame:
    """Per pool: each fee and the time-weighted average of the last ten periods.

    A period is the interval that ends at a row, valued at the fee in force during it,
    the previous row's.  Ten periods plus the row before them make the look-back ten rows.
    A sensible fee is at most 1e18, and decimal(38,0) holds every product sum of such ones.
    Any contract may emit more: where a product or sum doesn't fit, ``twa`` is NULL and
    ``in_range`` false.  Fees themselves stay exact.
    """
    rows = table.select("pool", *META, "fee", F.expr(u256.narrow_decimal("fee")).alias("small"))
    frame = lambda w: w.rowsBetween(-(PERIODS - 1), 0)
    area = F.try_multiply("held", F.col("dt").cast("decimal(19,0)")).try_cast("decimal(38,0)")
    return over_rows(
        rows,
        ["pool"],
        {
            "held": lambda w: F.lag("small").over(w),
            "dt": lambda w: F.col("block_timestamp") - F.lag("block_timestamp").over(w),
        },
        then={
            "area": lambda w: F.try_sum(area).over(frame(w)),
            "span": lambda w: F.sum("dt").over(frame(w)),
            "beyond": lambda w: F.count(F.when(F.col("dt").isNotNull() & area.isNull(), 1)).over(frame(w)),
        },
        before=PERIODS,
        **tuning,
    ).withColumn("in_range", (F.col("beyond") == 0) & (F.col("area").isNotNull() | F.col("span").isNull())).withColumn(
        "twa", F.when(F.col("in_range"), _whole_quotient(F.col("area"), F.col("span")))
    )


def _whole_quotient(area: Column, span: Column) -> Column:
    """area / span without the fraction; NULL over an empty span."""
    n = F.when(span > 0, span).cast("decimal(19,0)")
    return ((area - area % n) / n).cast("decimal(38,0)")


def fee_texts(series: DataFrame) -> DataFrame:
    """Fees divided by 1e18 (100% is 1), as exact text."""
    series = with_texts(series)
    human = lambda c: F.expr(u256.shift_text(f"cast({c} as string)"))
    return series.select("pool", *META, human("fee").alias("fee"), human("twa").alias("twa_fee"), "in_range")


def fee_change(table: DataFrame, pool: str, start: int | None = None, limit: int | None = None) -> DataFrame:
    """Fee series of one pool.  The time filter comes after the window, so that the average
    at its edge still sees the periods before it."""
    found = time_range(fee_series(table.filter(F.col("pool") == pool.lower())), start)
    return fee_texts(recent_first(found, limit))
