"""Newest-first results: LIMIT, OFFSET and the newest rows of many requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from chainloom.operators.windows import SLICE_SECONDS, time_slice

DEFAULT_LIMIT = 50
MAX_LIMIT = 200


def newest_order(timestamp: str = "block_timestamp") -> list[Column]:
    """Newest first, with ties settled so that a LIMIT has one answer."""
    return [
        F.col(timestamp).desc_nulls_first(),
        F.col("block_number").desc(),
        F.col("log_index").desc(),
        F.col("transaction_hash").asc(),
    ]


def checked_limit(limit: int | None) -> int:
    limit = DEFAULT_LIMIT if limit is None else limit
    if not 0 <= limit <= MAX_LIMIT:
        raise ValueError(f"Limit cannot exceed {MAX_LIMIT}")
    return limit


def recent_first(df: DataFrame, limit: int | None = None, order: list[Column] | None = None) -> DataFrame:
    return df.orderBy(*(order or newest_order())).limit(checked_limit(limit))


def page(df: DataFrame, limit: int | None = None, offset: int = 0, order: list[Column] | None = None) -> DataFrame:
    return df.orderBy(*(order or newest_order())).offset(offset).limit(checked_limit(limit))


def time_range(df: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """Optional bounds: an absent bound adds no predicate, a present one is pushed down."""
    if start is not None:
        df = df.filter(F.col("block_timestamp") >= start)
    if end is not None:
        df = df.filter(F.col("block_timestamp") <= end)
    return df


# Answer rows wanted in all, up to which they are broadcast to the table's rows.
BROADCAST_WANTED = 100_000
FOREVER = 2**62


def slice_or_last() -> Column:
    """Rows without a timestamp count as newest."""
    return F.coalesce(time_slice(), F.lit(FOREVER))


def numbered_from_newest(rows: DataFrame, ends: DataFrame, entity: str, counts: DataFrame | None = None) -> DataFrame:
    """Rows with ``place``, their number from the newest of their entity, and ``mark`` false;
    and for each (entity, end) one row with ``mark`` true, the end as its timestamp and as
    ``place`` how many rows are newer.

    Rows and ends stand in one order within (entity, time slice), so an end costs one row
    and never meets all rows of its slice; what lies in later slices is added from counts.
    Given the ``counts`` of all slices, the rows may be those of some slices only.
    """
    marks = ends.select(entity, F.col("end").alias("block_timestamp"), F.call_function("div", F.col("end"), F.lit(SLICE_SECONDS)).alias("slice"))
    rows = rows.withColumn("slice", slice_or_last())
    if counts is None:
        counts = rows.groupBy(entity, "slice").agg(F.count("*").alias("n"))
    counts = counts.unionByName(marks.select(entity, "slice", F.lit(0).cast("bigint").alias("n"))).groupBy(entity, "slice").agg(F.sum("n").alias("n"))
    newer_slices = Window.partitionBy(entity).orderBy(F.desc("slice")).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(entity, "slice", F.coalesce(F.sum("n").over(newer_slices), F.lit(0)).alias("__newer"))
    both = rows.withColumn("mark", F.lit(False)).unionByName(marks.withColumn("mark", F.lit(True)), allowMissingColumns=True)
    first, *rest = newest_order()
    within = Window.partitionBy(entity, "slice").orderBy(first, F.desc("mark"), *rest).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("place", F.sum(F.when(F.col("mark"), 0).otherwise(1)).over(within))
    return both.join(counts, [entity, "slice"]).withColumn("place", F.col("place") + F.col("__newer")).drop("slice", "__newer")


def bounded_requests(requests: DataFrame) -> DataFrame:
    """Requests with ends and limits in range.  No row is later than FOREVER, so a larger end is
    the same as that; and a request with a start can't get rows without a time, which an
    end keeps out."""
    end = F.when(F.col("start").isNotNull(), F.coalesce("end", F.lit(FOREVER))).otherwise(F.col("end"))
    # LEAST skips NULL, which has to stay.
    capped = lambda c, most: F.when(c.isNotNull(), F.least(c, F.lit(most))).cast("bigint")
    return requests.withColumns({"start": capped(F.col("start"), FOREVER), "end": capped(end, FOREVER), "lim": capped(F.col("lim"), MAX_LIMIT)})


def answer_requests(events: DataFrame, requests: DataFrame, entity: str, columns: list[str], counts: DataFrame | None = None) -> DataFrame:
    """Newest <= limit rows for every request (request_id, <entity>, start, end, lim).

    Rows are numbered from the newest, and a request wants the ``lim`` numbers after those
    newer than its end.  So each request meets the rows it returns and no others, however
    busy its entity is and however many ends are asked for; a start only cuts the tail off.
    With the ``counts`` of a position index, ``events`` are the rows of the touched slices.
    """
    requests = bounded_requests(requests)
    ends = requests.select(entity, "end").where(F.col("end").isNotNull()).distinct()
    rows = events.select(*dict.fromkeys([entity, "block_timestamp", "block_number", "log_index", "transaction_hash", *columns]))
    numbered = numbered_from_newest(rows, ends, entity, counts)
    skipped = numbered.where("mark").select(entity, F.col("block_timestamp").alias("end"), F.col("place").alias("skip"))
    asked = requests.select("request_id", entity, "start", "end", "lim").where("lim > 0")
    asked = asked.join(skipped, [entity, "end"], "left").withColumn("skip", F.coalesce("skip", F.lit(0)))
    wanted = asked.withColumn("place", F.explode(F.sequence(F.col("skip") + 1, F.col("skip") + F.col("lim"))))
    wanted = wanted.select("request_id", F.col(entity).alias("__entity"), F.col("place").alias("__place"), "start", (F.col("place") - F.col("skip")).cast("int").alias("rank"))
    total = requests.agg(F.coalesce(F.sum("lim"), F.lit(0))).first()[0]
    if total <= BROADCAST_WANTED:
        wanted = F.broadcast(wanted)
    found = numbered.where(~F.col("mark")).join(wanted, F.expr(f"{entity} = __entity AND place = __place"))
    return found.where("start IS NULL OR block_timestamp >= start").select("request_id", *columns, "rank")
