"""Window functions per entity that do not depend on any entity being small.

A plain window hands one entity's rows to one task, which fails when one pool holds a
third of all logs.  Here a pass over the keys alone counts the rows of each entity and time
slice.  An entity with more rows than a block holds is cut into blocks of whole slices; the
counts say which slices lie so near a block's edge that a frame of a neighbouring block
reaches them, and those slices are copied to it.  Then all rows are shuffled once, by entity
and block, and each window runs inside a block.  Entities of one block need no entry in the
table of blocks, so it is small, and it is broadcast after its size was checked.

A slice is bounded by the chain: it spans about as many blocks as one block bucket,
and the gas limit bounds the logs of a block.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from chainloom import session

SLICE_SECONDS = 12_000  # 1000 blocks of 12 s
BLOCK_ROWS = 500_000
BROADCAST_SLICES = 200_000  # rows of the table of blocks up to which it is broadcast
ORDER = ("block_timestamp", "block_number", "log_index", "transaction_hash")


def time_slice(seconds: int = SLICE_SECONDS) -> Column:
    """A slice number that never falls as ``ORDER`` rises."""
    return F.call_function("div", F.col("block_timestamp"), F.lit(seconds))


def table_of_blocks(
    df: DataFrame, keys: list[str], order: tuple[str, ...], before: int, after: int, block_rows: int, first_last: tuple[str, ...]
) -> DataFrame:
    """(keys, __slice, __cut): for entities longer than a block, where each slice belongs.

    ``__cut`` holds the slice's block, the number of rows before that block, the other blocks
    whose frames reach the slice, and the entity's first and last values."""
    aggs = [F.count("*").alias("n")]
    if first_last:
        at, picked = F.struct(*order), F.struct(*first_last)
        aggs += [F.min(at).alias("min"), F.max(at).alias("max"), F.min_by(picked, at).alias("first"), F.max_by(picked, at).alias("last")]
    slices = df.groupBy(*keys, "__slice").agg(*aggs)
    entity = Window.partitionBy(*keys)
    in_order = entity.orderBy("__slice")
    slices = slices.withColumn("total", F.sum("n").over(entity)).where(F.col("total") > block_rows)
    slices = slices.withColumn("end", F.sum("n").over(in_order)).withColumn("start", F.col("end") - F.col("n"))
    slices = slices.withColumn("block", F.call_function("div", F.col("start"), F.lit(block_rows)))
    reached = [F.array().cast("array<bigint>")]
    # A slice has a row at least, so that ``before`` slices on, no frame reaches back here.
    if before:
        following = F.collect_list(F.struct("start", "block")).over(in_order.rowsBetween(1, before))
        reached.append(F.filter(following, lambda x: (x.block > F.col("block")) & (x.start < F.col("end") + before)).block)
    if after:
        preceding = F.collect_list(F.struct("end", "block")).over(in_order.rowsBetween(-after, -1))
        reached.append(F.filter(preceding, lambda x: (x.block < F.col("block")) & (x.end > F.col("start") - after)).block)
    cut = [
        F.col("block"), F.min("start").over(Window.partitionBy(*keys, "block")).alias("before"),
        F.array_distinct(F.concat(*reached)).alias("reached"),
    ]
    for c in first_last:
        cut += [F.min_by(F.col("first")[c], F.col("min")).over(entity).alias(f"first_{c}"), F.max_by(F.col("last")[c], F.col("max")).over(entity).alias(f"last_{c}")]
    slices = slices.select(*keys, "__slice", *cut)
    return slices.select(*keys, "__slice", F.struct(*slices.columns[len(keys) + 1 :]).alias("__cut"))


def over_rows(
    df: DataFrame,
    keys: list[str],
    columns: dict[str, Callable[[WindowSpec], Column]],
    then: dict[str, Callable[[WindowSpec], Column]] | None = None,
    before: int = 0,
    after: int = 0,
    order: tuple[str, ...] = ORDER,
    slice_col: Column | None = None,
    block_rows: int = BLOCK_ROWS,
    first_last: tuple[str, ...] = (),
) -> DataFrame:
    """Add window columns that look at most ``before`` rows back and ``after`` ahead, and
    ``position``, the row number within the entity (from 1).

    Each function in ``columns`` receives the ordered window of a block; those in
    ``then`` may use the columns made first.  ``first_last`` columns also get ``first_<c>``
    and ``last_<c>`` over the whole entity.  Keys must not be NULL.
    """
    df = df.withColumn("__slice", time_slice() if slice_col is None else slice_col)
    spark, path = df.sparkSession, session.scratch(df.sparkSession, "blocks")
    cuts = table_of_blocks(df, keys, order, before, after, block_rows, first_last)
    cuts.write.parquet(path)
    cuts = spark.read.schema(cuts.schema).parquet(path)
    rows = cuts.count()
    if rows:
        df = df.join(F.broadcast(cuts) if rows <= BROADCAST_SLICES else cuts, [*keys, "__slice"], "left")
        own = F.struct(F.coalesce("__cut.block", F.lit(0)).cast("bigint").alias("block"), F.lit(True).alias("own"))
        others = F.transform(F.coalesce("__cut.reached", F.array().cast("array<bigint>")), lambda b: F.struct(b.alias("block"), F.lit(False).alias("own")))
        df = df.withColumn("__copy", F.explode(F.concat(F.array(own), others)))
        df = df.withColumns({"__block": F.col("__copy.block"), "__own": F.col("__copy.own")}).drop("__copy")
        w = Window.partitionBy(*keys, "__block").orderBy(*order)
        # Copies lie before or behind all own rows of a block.
        number = F.sum(F.when(F.col("__own"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
        df = df.withColumn("position", number + F.coalesce("__cut.before", F.lit(0)))
    else:
        w = Window.partitionBy(*keys).orderBy(*order)
        df = df.withColumn("position", F.row_number().over(w).cast("bigint"))
    for stage in (columns, then or {}):
        df = df.withColumns({name: build(w) for name, build in stage.items()})
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    for c in first_last:
        ends = {f"first_{c}": F.first_value(c).over(whole), f"last_{c}": F.last_value(c).over(whole)}
        df = df.withColumns({name: F.when(F.col("__cut").isNotNull(), F.col("__cut")[name]).otherwise(end) if rows else end for name, end in ends.items()})
    if rows:
        df = df.where("__own").drop("__own", "__block", "__cut")
    return df.drop("__slice")


def with_position(
    df: DataFrame, keys: list[str], order: tuple[str, ...] = ORDER, slice_col: Column | None = None,
    first_last: tuple[str, ...] = (), block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add ``position``, and the ``first_last`` columns of :func:`over_rows`."""
    return over_rows(df, keys, {}, order=order, slice_col=slice_col, first_last=first_last, block_rows=block_rows)


def latest_per(df: DataFrame, keys: list[str], columns: list[str], order: tuple[str, ...] = ORDER) -> DataFrame:
    """DISTINCT ON (keys), newest row.  One aggregated row per task and key is shuffled."""
    newest = F.max_by(F.struct(*columns), F.struct(*order)).alias("__row")
    return df.groupBy(*keys).agg(newest).select(*keys, "__row.*")
