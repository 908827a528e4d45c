"""Event tables laid out for requests: rows by entity, and an index of positions.

The rows lie in a folder per hash bucket of the entity, sorted by entity and time.  Next to
them the index holds how many rows each entity has in each time slice.  A request for the
newest rows of an entity is planned on the index alone: which slices its answer can come
from, and how many rows are newer than each of them.  Only those slices are then read, by
buckets and values that reach the scan and by a join of (entity, slice).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql import types as T

from chainloom import session
from chainloom.operators import storage, topk
from chainloom.operators.windows import SLICE_SECONDS
from chainloom.sources.schemas import LOG_KEY

BUCKETS = 32
# Up to so many entities are filtered on in the scan; beyond, buckets and the join do it.
SCAN_VALUES = 2_000
# Up to so many touched slices the list of them is broadcast.
BROADCAST_SLICES = 200_000


def bucket_of(entity: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(entity), F.lit(buckets)).cast("int")


def index_schema(entity: str) -> T.StructType:
    return T.StructType([T.StructField(entity, T.StringType()), T.StructField("slice", T.LongType()), T.StructField("n", T.LongType())])


def rows_schema(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("entity_bucket", T.IntegerType())])


def within_slices(lo: int, hi: int | None, timeless: bool) -> Column:
    """A filter that reaches the scan and passes at least the rows of slices lo..hi, and those
    without a time.  Slices of times before 1970 count towards zero."""
    timed = F.lit(False) if hi is None else F.col("block_timestamp").between((lo - 1) * SLICE_SECONDS, (hi + 1) * SLICE_SECONDS - 1)
    return timed | F.col("block_timestamp").isNull() if timeless else timed


def counted(rows: DataFrame, entity: str) -> DataFrame:
    return rows.groupBy(entity, topk.slice_or_last().alias("slice")).agg(F.count("*").alias("n"))


def append(batch: DataFrame, root: str, entity: str, key: tuple[str, ...] = LOG_KEY, buckets: int = BUCKETS) -> None:
    """Store rows whose key is not stored yet, and count anew the slices that the batch has
    rows in.  Doing it again, also after a failure at any point, changes nothing: counts are
    of stored rows, and they only grow, so that the largest count of a slice holds."""
    spark = batch.sparkSession
    schema = batch.schema
    batch = batch.withColumn("entity_bucket", bucket_of(entity, buckets)).dropDuplicates(list(key)).persist()
    try:
        stored = storage.read_if_exists(spark, f"{root}/rows", rows_schema(schema))
        fresh = batch
        if stored is not None:
            span = batch.agg(F.min("block_timestamp").alias("lo"), F.max("block_timestamp").alias("hi"), F.max(F.col("block_timestamp").isNull()).alias("odd")).first()
            near = F.lit(False) if span["lo"] is None else F.col("block_timestamp").between(span["lo"], span["hi"])
            if span["odd"]:
                near = near | F.col("block_timestamp").isNull()
            fresh = storage.new_rows(batch, stored.where(near), key)
        (
            fresh.hint("rebalance", "entity_bucket").sortWithinPartitions("entity_bucket", entity, "block_timestamp")
            .write.mode("append").partitionBy("entity_bucket").parquet(f"{root}/rows")
        )
        if stored is None:
            counts = counted(batch, entity)
        else:
            slices = batch.select(entity, topk.slice_or_last().alias("slice")).distinct()
            ends = slices.agg(F.min("slice").alias("lo"), F.max(F.when(F.col("slice") < topk.FOREVER, F.col("slice"))).alias("hi")).first()
            if ends["lo"] is None:
                return
            now = spark.read.schema(rows_schema(schema)).parquet(f"{root}/rows").where(within_slices(ends["lo"], ends["hi"], True))
            counts = counted(now, entity).join(slices, [entity, "slice"], "left_semi")
        counts.write.mode("append").parquet(f"{root}/index")
    finally:
        batch.unpersist()


def index(spark: SparkSession, root: str, entity: str) -> DataFrame:
    """(entity, slice, n): rows of each entity in each time slice; rows without a time are in
    the last one."""
    parts = storage.read_if_exists(spark, f"{root}/index", index_schema(entity))
    if parts is None:
        return spark.createDataFrame([], index_schema(entity))
    return parts.groupBy(entity, "slice").agg(F.max("n").alias("n"))


def touched_slices(counts: DataFrame, requests: DataFrame, entity: str) -> DataFrame:
    """(entity, slice) that an answer can come from, given the counts of all slices.

    An end lies in some slice; the ``lim`` rows up to it stand behind the rows of newer slices
    and no further than the rows of that slice and ``lim`` more.  So each request covers a
    range of places, and the slices are those that begin in a range.  Slices and ends of an
    entity stand in one order, then slices and ranges do: a running sum of beginnings and
    endings says whether a slice is covered, however many requests there are.
    """
    last = F.coalesce(F.call_function("div", F.col("end"), F.lit(SLICE_SECONDS)), F.lit(topk.FOREVER))
    asked = requests.where("lim > 0").groupBy(entity, last.alias("slice")).agg(F.max("lim").alias("lim"))
    both = counts.select(entity, "slice", "n", F.lit(None).cast("bigint").alias("lim")).unionByName(asked.withColumn("n", F.lit(0).cast("bigint")))
    newest_first = Window.partitionBy(entity).orderBy(-F.col("slice"))
    both = both.withColumns({
        "newer": F.coalesce(F.sum("n").over(newest_first.rangeBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "upto": F.sum("n").over(newest_first.rangeBetween(Window.unboundedPreceding, 0)),
    })
    at = lambda place, step, slice_: F.struct(place.alias("place"), F.lit(step).alias("step"), slice_.cast("bigint").alias("slice"))
    none = F.lit(None)
    ends = F.array(at(F.col("newer"), 1, none), at(F.col("upto") + F.col("lim"), -1, none))
    line = both.select(entity, F.inline(F.when(F.col("lim").isNull(), F.array(at(F.col("newer"), 0, F.col("slice")))).otherwise(ends)))
    # At one place, ranges that end or begin there count before the slice that begins there.
    order = Window.partitionBy(entity).orderBy("place", F.col("slice").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    return line.withColumn("open", F.sum("step").over(order)).where("slice IS NOT NULL AND open > 0").select(entity, "slice")


def kept(rows: DataFrame, path: str) -> DataFrame:
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def answer(
    spark: SparkSession, root: str, schema: T.StructType, requests: DataFrame, entity: str, columns: list[str], buckets: int = BUCKETS
) -> DataFrame:
    """Newest <= limit rows for every request, read from the slices they can come from."""
    requests = topk.bounded_requests(requests)
    entities = requests.select(entity).distinct()
    path = session.scratch(spark, "touched")
    counts = kept(index(spark, root, entity).join(entities, entity, "left_semi"), f"{path}/counts")
    touched = kept(touched_slices(counts, requests, entity), f"{path}/slices")
    rows = storage.read_if_exists(spark, f"{root}/rows", rows_schema(schema))
    if rows is None:
        rows = spark.createDataFrame([], rows_schema(schema))
    return topk.answer_requests(pruned(rows, touched, entity, buckets), requests, entity, columns, counts)


def pruned(rows: DataFrame, touched: DataFrame, entity: str, buckets: int = BUCKETS) -> DataFrame:
    """The rows of the touched slices.  Buckets prune folders, entities (if not too many) and
    the span of time prune row groups, the join does the rest."""
    span = touched.agg(
        F.count("*").alias("n"), F.min("slice").alias("lo"), F.max(F.when(F.col("slice") < topk.FOREVER, F.col("slice"))).alias("hi"),
        F.max(F.col("slice") == topk.FOREVER).alias("timeless"), F.collect_set(bucket_of(entity, buckets)).alias("buckets"),
    ).first()
    rows = rows.where(F.col("entity_bucket").isin(sorted(span["buckets"])))
    values = [r[0] for r in touched.select(entity).distinct().limit(SCAN_VALUES + 1).collect()]
    if len(values) <= SCAN_VALUES:
        rows = rows.where(F.col(entity).isin(sorted(values)))
    if span["n"]:
        rows = rows.where(within_slices(span["lo"], span["hi"], span["timeless"]))
    wanted = F.broadcast(touched) if span["n"] <= BROADCAST_SLICES else touched
    return rows.withColumn("slice", topk.slice_or_last()).join(wanted, [entity, "slice"], "left_semi").drop("slice", "entity_bucket")
