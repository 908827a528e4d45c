"""Event tables on storage: idempotent append, schema change, JSON results."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from chainloom.functions import u256
from chainloom.sources.logs import bucket_of
from chainloom.sources.schemas import EVENT_BUCKET_BLOCKS, LOG_KEY


def new_rows(batch: DataFrame, stored: DataFrame, key: tuple[str, ...] = LOG_KEY) -> DataFrame:
    """Rows of ``batch`` whose key is not stored yet."""
    return batch.join(stored.select(*key), list(key), "left_anti")


def read_if_exists(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def write_events(rows: DataFrame, path: str, mode: str = "append") -> None:
    """One directory per block bucket.  The rebalance hint gathers a bucket's rows into
    few files and lets AQE split a bucket that holds far more than the others."""
    (
        rows.hint("rebalance", "block_bucket")
        .sortWithinPartitions("block_bucket", "block_number")
        .write.mode(mode)
        .partitionBy("block_bucket")
        .parquet(path)
    )


def append_dedup(batch: DataFrame, path: str, key: tuple[str, ...] = LOG_KEY) -> None:
    """Append rows not stored yet, each key once.

    The stored side of the anti join is cut to the batch's block span: by bucket, which
    prunes directories, and by block number, which prunes row groups since files are
    sorted by it.  A tail or a replay so reads what it overlaps and never the whole
    table.  Keys are unique per log, so the shuffles cannot skew.  Running it again
    after a lost driver or a replayed batch changes nothing.
    """
    spark = batch.sparkSession
    batch = batch.withColumn("block_bucket", bucket_of(F.col("block_number"), EVENT_BUCKET_BLOCKS))
    rows = batch.dropDuplicates(list(key))
    stored = read_if_exists(spark, path, batch.schema)
    if stored is not None:
        span = batch.agg(F.min("block_number").alias("lo"), F.max("block_number").alias("hi")).first()
        if span["lo"] is None:
            return
        buckets = [n // EVENT_BUCKET_BLOCKS for n in (span["lo"], span["hi"])]
        overlap = stored.filter(
            F.col("block_bucket").between(*buckets) & F.col("block_number").between(span["lo"], span["hi"])
        )
        rows = new_rows(rows, overlap, key)
    write_events(rows, path)


def wide_groups(schemas: list[T.StructType], columns: int = 400) -> list[list[int]]:
    """Frames that can share files: no column name has two types in a group, and a group has
    no more than so many columns."""
    groups: list[tuple[dict[str, T.DataType], list[int]]] = []
    for i, schema in enumerate(schemas):
        kinds = {f.name: f.dataType for f in schema.fields}
        for held, members in groups:
            if all(held.get(c, kind) == kind for c, kind in kinds.items()) and len(held | kinds) <= max(columns, len(kinds)):
                held.update(kinds)
                members.append(i)
                break
        else:
            groups.append((dict(kinds), [i]))
    return [members for _, members in groups]


def append_tables(frames: list[DataFrame], root: str, spanned: DataFrame | None = None, key: tuple[str, ...] = LOG_KEY) -> None:
    """Append rows with ``table_name`` below ``root/table_name=…``, not stored yet and each key
    once per table, with one write for all frames that can share files.

    Stored keys of all tables are read by one scan, cut to the tables, buckets and blocks of
    the batch as in :func:`append_dedup`.  The number of jobs so depends on the number of
    layouts and contradicting column types, and not on the number of tables.  ``spanned``
    are rows whose blocks span those of the frames, if they are at hand.
    """
    for members in wide_groups([f.schema for f in frames]):
        batch = None
        for i in members:
            batch = frames[i] if batch is None else batch.unionByName(frames[i], allowMissingColumns=True)
        batch = batch.withColumn("block_bucket", bucket_of(F.col("block_number"), EVENT_BUCKET_BLOCKS))
        fields = [f for f in batch.schema.fields if f.name in {"table_name", "block_bucket", "block_number", *key}]
        stored = read_if_exists(batch.sparkSession, root, T.StructType(fields))
        rows = batch.dropDuplicates(["table_name", *key])
        if stored is not None:
            of = batch if spanned is None else spanned
            span = of.agg(F.min("block_number").alias("lo"), F.max("block_number").alias("hi")).first()
            if span["lo"] is None:
                continue
            buckets = [n // EVENT_BUCKET_BLOCKS for n in (span["lo"], span["hi"])]
            near = F.col("block_bucket").between(*buckets) & F.col("block_number").between(span["lo"], span["hi"])
            rows = new_rows(rows, stored.filter(near), ("table_name", *key))
        (
            rows.hint("rebalance", "table_name", "block_bucket")
            .sortWithinPartitions("table_name", "block_bucket", "block_number")
            .write.mode("append").partitionBy("table_name", "block_bucket").parquet(root)
        )


def read_events(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def evolve_table(
    table: DataFrame, schema: T.StructType, defaults: dict[str, object] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Bring rows to a new declared schema in one pass.

    New columns are NULL, or their default (a NOT NULL column must have one); columns
    no longer declared are dropped; changed types are converted.  Returns the new rows
    and the rows that are refused: a conversion fails or loses something (the new value does
    not convert back), or a value that must not be NULL is.  Write the former only when the
    latter is empty.
    """
    defaults = defaults or {}
    old = {f.name: f.dataType for f in table.schema.fields}
    columns, failures = [], []
    for f in schema.fields:
        if f.name not in old:
            if not f.nullable and f.name not in defaults:
                raise ValueError(f"new column {f.name} is NOT NULL and has no default")
            columns.append(F.lit(defaults.get(f.name)).cast(f.dataType).alias(f.name))
        else:
            given = F.col(f.name)
            if old[f.name] == f.dataType:
                columns.append(given)
            else:
                plain, kind = (F.expr(u256.text_of(f"`{f.name}`")), T.StringType()) if is_u256(old[f.name]) else (given, old[f.name])
                if is_u256(f.dataType):
                    raise ValueError(f"column {f.name} can't become a 256-bit number")
                converted = plain.try_cast(f.dataType)
                if isinstance(kind, T.StringType) and isinstance(f.dataType, T.IntegralType):
                    # "7.00" is a whole number too.
                    converted = F.coalesce(converted, plain.try_cast("decimal(38,18)").try_cast(f.dataType))
                lost = given.isNotNull() & (converted.isNull() | (~same_value(plain, converted, kind, f.dataType)))
                failures.append(lost)
                columns.append(converted.alias(f.name))
            if not f.nullable:
                failures.append(given.isNull())
    bad = F.lit(False)
    for failed in failures:
        bad = bad | failed
    return table.filter(~bad).select(*columns), table.filter(bad)


def is_u256(kind: T.DataType) -> bool:
    return getattr(kind, "names", None) == list(u256.LIMBS)


def same_value(before: Column, after: Column, old: T.DataType, new: T.DataType) -> Column:
    """Whether a converted value still says what it said.  Text counts by the number it
    spells, so that "07" may become 7 and "5.75" may not become 5."""
    if isinstance(old, T.StringType) and isinstance(new, T.NumericType):
        back = before.try_cast("decimal(38,18)")
        return F.coalesce(back == after.try_cast("decimal(38,18)"), F.trim(before) == after.cast("string"), F.lit(False))
    return F.coalesce(after.try_cast(old) == before, F.lit(False))


# --- JSON at the result edge ---------------------------------------------------------

# Response type names and the types they are delivered as.
RESPONSE_TYPES = {
    "i64": "bigint",
    "i32": "int",
    "u32": "bigint",
    "u64": "decimal(20,0)",
    "String": "string",
    "bool": "boolean",
}


def response_value(name: str, declared: str, kind: T.DataType | None = None) -> Column:
    """A result cell as its declared type; NULL where it does not convert.  ``Vec<T>``
    columns pass as they are; a 256-bit number is its decimal text."""
    inner = declared.removeprefix("Option<").removesuffix(">") if declared.startswith("Option<") else declared
    if inner.startswith("Vec<"):
        return F.col(name)
    cell = F.expr(u256.text_of(f"`{name}`")) if is_u256(kind) else F.col(name)
    return cell.try_cast(RESPONSE_TYPES.get(inner, "string"))


def response_struct(fields: dict[str, str], schema: T.StructType) -> Column:
    kinds = {f.name: f.dataType for f in schema.fields}
    return F.struct(*[response_value(n, t, kinds.get(n)).alias(n) for n, t in fields.items()])


def rows_to_json(rows: DataFrame, fields: dict[str, str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Each row as a JSON object of exactly the response fields, in their order."""
    text = F.to_json(response_struct(fields, rows.schema), {"ignoreNullFields": "false"})
    return rows.select(*keep, text.alias("json"))


def json_envelope(answers: DataFrame, requests: DataFrame, fields: dict[str, str], order: list[str]) -> DataFrame:
    """One ``{"data":[...],"count":n}`` per request, empty answers included.

    ``answers`` holds at most 200 rows per request (the limit every request is checked
    against), so the collected list is bounded.  ``order`` columns sort it, descending.
    """
    item = F.struct(*[F.col(o).alias(f"o{i}") for i, o in enumerate(order)], response_struct(fields, answers.schema).alias("row"))
    grouped = answers.groupBy("request_id").agg(F.sort_array(F.collect_list(item), asc=False).alias("items"))
    joined = requests.select("request_id").join(grouped, "request_id", "left")
    empty = F.array().cast(T.ArrayType(grouped.schema["items"].dataType.elementType["row"].dataType))
    data = F.coalesce(F.col("items.row"), empty)
    return joined.select(
        "request_id",
        F.to_json(
            F.struct(data.alias("data"), F.size(data).alias("count")), {"ignoreNullFields": "false"}
        ).alias("json"),
    )
