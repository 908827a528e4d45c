"""Continuous ingest: follow landed logs, decode them, append each once.

One micro-batch is routed, gated, decoded and written by the same operators as a batch
job.  ``foreachBatch`` may run a batch again after a failure; the key of every log and
the batch number of every reject file make that harmless.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from chainloom import session
from chainloom.operators import coverage, decode, routing, storage
from chainloom.sources.schemas import BUCKET_BLOCKS, LANDED_LOG, META, RAW_LOG
from chainloom.sources.specs import EventSpec, spec_rows
from chainloom.streaming import quarantine

POLL = "12 seconds"
# Files that one micro-batch takes at most, so that a backlog comes in many batches.
FILES_PER_TRIGGER = 64
# Up to so many addresses or topics are filtered on in the scan; beyond, the join does it.
SCAN_VALUES = 2_000
RAW = "__raw"  # what the decoded rows leave behind, for rejects
STORED = ("chain", "address", *META, "spec")


def by_layout(specs: list[EventSpec]) -> list[list[EventSpec]]:
    """Specs in groups of equal fields and columns.  Specs of one table are in one group."""
    layouts: dict[tuple, list[EventSpec]] = {}
    tables: dict[str, tuple] = {}
    for s in specs:
        layout = (s.fields, s.column_names)
        if tables.setdefault(table_of(s), layout) != layout:
            raise ValueError(f"specs of table {table_of(s)} differ in their fields")
        layouts.setdefault(layout, []).append(s)
    return list(layouts.values())


def table_of(spec: EventSpec) -> str:
    return spec.table or spec.name


def decoded_layouts(checked: DataFrame, specs: list[EventSpec]) -> list[DataFrame]:
    """Per layout: decoded rows of its tables, with ``reject_reason`` set where a value is
    missing.  Only such rows keep what they were decoded from, so that the others stay small."""
    out = []
    raw = F.struct("topics", "topic0", "data", "block_bucket", "landed_as").alias(RAW)
    for group in by_layout(specs):
        tables = sorted({table_of(s) for s in group})
        rows = checked.filter(F.col("table_name").isin(tables) & F.col("reject_reason").isNull())
        decoded = decode.decode_events(rows.select("*", raw), group[0], (*STORED, "table_name", "reject_reason", RAW))
        told = routing.reject_undecoded(decoded, list(group[0].column_names))
        out.append(told.withColumn(RAW, F.when(F.col("reject_reason").isNotNull(), F.col(RAW))))
    return out


def good_rows(layouts: list[DataFrame]) -> list[DataFrame]:
    return [rows.filter("reject_reason is null").drop("reject_reason", RAW) for rows in layouts]


def relevant(logs: DataFrame, specs: list[EventSpec], least_block: int) -> DataFrame:
    """Logs that can belong to a spec, by literals that reach the scan: chain and bucket as
    partition filters, address and topic as pushed filters.  Routing decides exactly.  A log
    without a block number passes, to be rejected with a reason."""
    wanted = {"chain": {s.chain for s in specs}, "address": {s.address.lower() for s in specs}, "topic0": {s.topic0 for s in specs}}
    for name, values in wanted.items():
        if len(values) <= SCAN_VALUES:
            logs = logs.filter(F.col(name).isin(sorted(values)))
    if least_block > 0:
        logs = logs.filter(F.col("block_bucket").isNull() | (F.col("block_bucket") >= least_block // BUCKET_BLOCKS))
    return logs


def routed_logs(logs: DataFrame, specs: list[EventSpec], start: DataFrame | None = None, ranges: DataFrame | None = None) -> DataFrame:
    """Logs with their spec, gated and with ``reject_reason`` where they lack something.

    ``start`` (spec, start_block) replaces the specs' start blocks; with ``ranges`` (spec,
    from_block, to_block) only logs within a range of their spec pass.
    """
    table = spec_rows(logs.sparkSession, specs)
    least = min((s.start_block for s in specs), default=0)
    if start is not None:
        table = table.drop("start_block").join(start, "spec")
        least = start.agg(F.min("start_block")).first()[0] or 0
    if "landed_as" not in logs.columns:
        logs = logs.withColumn("landed_as", F.lit(None).cast("string"))
    routed = routing.start_block_gate(routing.route_logs(relevant(logs, specs, least), table))
    if ranges is not None:
        routed = coverage.within(routed, ranges)
    return routing.require_metadata(routed)


def ingest(
    logs: DataFrame,
    specs: list[EventSpec],
    root: str,
    batch_id: int | str | None = None,
    resume: DataFrame | None = None,
    after: Callable[[str, DataFrame], None] | None = None,
    ranges: DataFrame | None = None,
) -> None:
    """Route, gate, decode and append ``logs`` below ``root``; bad logs go to the quarantine
    with a reason and the rest goes on.

    ``resume`` (from ``resume_points``) replaces the specs' start blocks, and ``ranges`` limits
    each spec to some block ranges.  Rejects of one ``batch_id`` replace those of an earlier
    run of that batch; without one, a call has its own.  ``after`` is called with each table's
    name and the batch's good rows once they are stored.
    """
    batch_id = uuid.uuid4().hex if batch_id is None else batch_id
    start = None if resume is None else resume.select("spec", F.col("resume_block").alias("start_block"))
    checked = routed_logs(logs, specs, start, ranges).persist()
    # Decoded once: rejects, stored keys' span and rows to store are all taken from this.
    layouts = [rows.persist() for rows in decoded_layouts(checked, specs)]
    try:
        rejects = checked.filter("reject_reason is not null").select(*quarantine.RAW_COLUMNS)
        for rows in layouts:
            bad = rows.filter("reject_reason is not null").select("*", f"{RAW}.*")
            rejects = rejects.unionByName(bad.select(*quarantine.RAW_COLUMNS))
        quarantine.put(rejects, root, batch_id)
        good = good_rows(layouts)
        storage.append_tables(good, f"{root}/events")
        if after is not None:
            for group, rows in zip(by_layout(specs), good):
                for name in dict.fromkeys(map(table_of, group)):
                    after(name, rows.filter(F.col("table_name") == name).drop("table_name"))
    finally:
        for rows in (*layouts, checked):
            rows.unpersist()


def replay_rejects(spark: SparkSession, root: str, specs: list[EventSpec], replay_id: str | None = None) -> None:
    """Try the open rejects again under corrected specs.  What can be stored now is stored and
    marked as settled; the rest stays open.  A replay that fails half way may be repeated:
    storing goes by the log's key, and marks only say what is stored."""
    replay_id = uuid.uuid4().hex if replay_id is None else replay_id
    open_ = quarantine.open_rejects(spark, root).select(*LANDED_LOG.fieldNames())
    checked = routed_logs(open_, specs).persist()
    layouts = [rows.persist() for rows in decoded_layouts(checked, specs)]
    try:
        good = good_rows(layouts)
        storage.append_tables(good, f"{root}/events")
        settled = None
        for rows in good:
            rows = rows.select("chain", "transaction_hash", "log_index", "spec")
            settled = rows if settled is None else settled.unionByName(rows)
        if settled is not None:
            quarantine.settle(settled, root, replay_id)
    finally:
        for rows in (*layouts, checked):
            rows.unpersist()


def ingest_missing(spark: SparkSession, landed: str, specs: list[EventSpec], root: str, batch_id: int | str | None = None) -> DataFrame:
    """Ingest, per spec, the landed block ranges that it has not covered yet, wherever they
    lie, and record them as covered.  Returns those ranges (spec, from_block, to_block).

    The record is written last, so that a failure only makes a range be read again."""
    batch_id = uuid.uuid4().hex if batch_id is None else batch_id
    # Written, since the records it comes from grow in the next step.
    path, pending = session.scratch(spark, "pending"), coverage.pending(spark, landed, root, specs)
    pending.write.parquet(path)
    pending = spark.read.schema(pending.schema).parquet(path)
    span = pending.agg(F.min("from_block").alias("lo"), F.max("to_block").alias("hi")).first()
    if span["lo"] is not None:
        logs = spark.read.schema(LANDED_LOG).parquet(landed)
        near = F.col("block_bucket").between(span["lo"] // BUCKET_BLOCKS, span["hi"] // BUCKET_BLOCKS) & F.col("block_number").between(span["lo"], span["hi"])
        ingest(logs.filter(near | F.col("block_number").isNull()), specs, root, batch_id, ranges=pending)
        coverage.record(pending, root, batch_id)
    return pending


def read_stream(spark: SparkSession, landed: str, files_per_trigger: int | None = FILES_PER_TRIGGER) -> DataFrame:
    reader = spark.readStream.schema(LANDED_LOG)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(landed)


def start(
    spark: SparkSession,
    landed: str,
    specs: list[EventSpec],
    root: str,
    follow: bool = True,
    chain: str | None = None,
    files_per_trigger: int | None = FILES_PER_TRIGGER,
    poll: str = POLL,
    after: Callable[[str, DataFrame], None] | None = None,
) -> StreamingQuery:
    """Start ingest: ``follow`` polls for ever, otherwise it catches up with what has
    landed and stops.  With ``chain``, only that chain, apart from failures elsewhere."""
    logs = read_stream(spark, landed, files_per_trigger)
    if chain is not None:
        logs = logs.filter(F.col("chain") == chain)
        specs = [s for s in specs if s.chain == chain]
    trigger = {"processingTime": poll} if follow else {"availableNow": True}

    def run(batch: DataFrame, n: int) -> None:
        # The query's id is kept in its checkpoint: a stream started anew has another.
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        ingest(batch, specs, root, f"{query}-{n}", after=after)

    return (
        logs.writeStream.foreachBatch(run)
        .option("checkpointLocation", f"{root}/_checkpoint")
        .trigger(**trigger)
        .start()
    )


def start_per_chain(spark: SparkSession, landed: str, specs: list[EventSpec], root: str, **options) -> dict[str, StreamingQuery]:
    """One independent stream per chain, each with its own checkpoint and tables."""
    chains = dict.fromkeys(s.chain for s in specs)
    return {c: start(spark, landed, specs, f"{root}/{c}", chain=c, **options) for c in chains}


def event_schema(spec: EventSpec) -> T.StructType:
    """Schema of a stored event table."""
    meta = [RAW_LOG[c] for c in ("chain", "address", *META)]
    return T.StructType([*meta, T.StructField("spec", T.StringType()), *spec.schema.fields, T.StructField("block_bucket", T.LongType())])


def stored(spark: SparkSession, root: str, spec: EventSpec) -> DataFrame:
    return storage.read_events(spark, f"{root}/events/table_name={table_of(spec)}", event_schema(spec))


def rejected(spark: SparkSession, root: str) -> DataFrame:
    """Rejected logs of all batches that are not settled; a log rejected twice counts once."""
    return quarantine.open_rejects(spark, root).select("chain", "address", *META, "table_name", "reject_reason", "log_id")
