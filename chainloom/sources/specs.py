"""Event specifications: what to decode and where it goes."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql import types as T

from chainloom.functions import abi, nested
from chainloom.functions.keccak import topic0, topic0_catalog
from chainloom.sources.schemas import ABI_DOCUMENT, SPEC_DOCUMENT, TUPLE_DEPTH


@dataclass(frozen=True)
class EventField:
    name: str
    kind: str
    indexed: bool = False


@dataclass(frozen=True)
class EventSpec:
    """One event of one contract.  ``columns`` names the stored columns by position;
    by default they are the field names in snake case."""

    name: str
    chain: str
    address: str
    event: str
    fields: tuple[EventField, ...]
    start_block: int = 0
    table: str = ""
    columns: tuple[str, ...] = field(default=())

    def __post_init__(self) -> None:
        for f in self.fields:
            nested.layout(f.kind)  # refuses what is no type

    @property
    def signature(self) -> str:
        return f"{self.event}({','.join(f.kind for f in self.fields)})"

    @property
    def topic0(self) -> str:
        return topic0(self.signature)

    @property
    def column_names(self) -> tuple[str, ...]:
        return self.columns or tuple(snake_case(f.name) for f in self.fields)

    @property
    def schema(self) -> T.StructType:
        return T.StructType(
            [T.StructField(c, column_type(f)) for f, c in zip(self.fields, self.column_names)]
        )


def column_type(f: EventField) -> T.DataType:
    """Of an indexed string, array or tuple there is only a hash."""
    if f.indexed and (abi.is_dynamic(f.kind) or nested.is_nested(f.kind)):
        return T.StringType()
    return nested.spark_type(nested.layout(f.kind))


def snake_case(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower()


SPEC_ROW = T.StructType(
    [
        T.StructField("spec_order", T.IntegerType()),
        T.StructField("spec", T.StringType()),
        T.StructField("chain", T.StringType()),
        T.StructField("address", T.StringType()),
        T.StructField("topic0", T.StringType()),
        T.StructField("start_block", T.LongType()),
        T.StructField("table_name", T.StringType()),
    ]
)


def spec_rows(spark: SparkSession, specs: list[EventSpec]) -> DataFrame:
    """Specs as the routing table, in their given order."""
    return spark.createDataFrame(
        [
            (i, s.name, s.chain, s.address.lower(), s.topic0, s.start_block, s.table or s.name)
            for i, s in enumerate(specs)
        ],
        SPEC_ROW,
    )


def load_specs(spark: SparkSession, path: str, one_per_line: bool = False) -> DataFrame:
    """Spec documents as rows: one JSON document per file, or one per line."""
    docs = spark.read.schema(SPEC_DOCUMENT).json(path, multiLine=not one_per_line)
    return docs.select(
        "event_name",
        "event_signature",
        "start_block",
        F.lower("contract_address").alias("address"),
        "chain",
        F.col("indexed_fields").alias("fields"),
        F.col("table_schema.table_name").alias("table_name"),
        F.expr("transform(table_schema.columns, c -> c.name)").alias("columns"),
    )


def routing_table(loaded: DataFrame) -> DataFrame:
    """Loaded spec rows as the table that logs are routed by, in the order of address, event
    and table.  Each distinct signature is hashed once."""
    order = Window.orderBy("address", "event_signature", "table_name")  # specs are few
    ranked = loaded.withColumn("spec_order", F.row_number().over(order) - 1)
    hashed = ranked.join(topic0_catalog(loaded), "event_signature")
    return hashed.select(
        F.col("spec_order").cast("int").alias("spec_order"), F.col("table_name").alias("spec"), "chain", "address", "topic0", "start_block", "table_name"
    )


def spec_from_row(row) -> EventSpec:
    """One loaded spec row as an :class:`EventSpec` (for a job that serves that spec)."""
    standard = {"id", "block_number", "block_timestamp", "transaction_hash", "log_index"}
    columns = tuple(c for c in row["columns"] or () if c not in standard)
    fields = tuple(EventField(f["name"], f["solidity_type"], f["indexed"]) for f in row["fields"])
    return EventSpec(
        row["table_name"], row["chain"], row["address"], row["event_name"], fields,
        row["start_block"], row["table_name"], columns,
    )


def read_abi_corpus(spark: SparkSession, path: str) -> DataFrame:
    """ABI files as (source, abi) rows, one whole file each."""
    return spark.read.text(path, wholetext=True).select(
        F.input_file_name().alias("source"), F.col("value").alias("abi")
    )


def canonical_types(inputs: str, depth: int = TUPLE_DEPTH) -> str:
    """SQL of the array of canonical types of ABI inputs, with tuples spelled out."""
    i = f"i{depth}"
    if not depth:
        return f"transform({inputs}, {i} -> {i}.type)"
    inner = canonical_types(f"{i}.components", depth - 1)
    spelled = f"concat('(', concat_ws(',', {inner}), ')', substring({i}.type, 6))"
    return f"transform({inputs}, {i} -> if(startswith({i}.type, 'tuple'), {spelled}, {i}.type))"


def abi_event_catalog(documents: DataFrame, source: str = "source", text: str = "abi") -> DataFrame:
    """Every event of every ABI document with its canonical signature and ordered inputs.
    A tuple counts as the list of its components' types.  Anonymous events are left out:
    they have no topic to be found by."""
    entries = documents.select(source, F.explode(F.from_json(text, ABI_DOCUMENT)).alias("e"))
    return entries.filter("e.type = 'event' AND NOT coalesce(e.anonymous, false)").select(
        source,
        F.col("e.name").alias("event_name"),
        F.concat(
            F.col("e.name"),
            F.lit("("),
            F.concat_ws(",", F.expr(canonical_types("e.inputs"))),
            F.lit(")"),
        ).alias("event_signature"),
        F.col("e.inputs").alias("inputs"),
    )
