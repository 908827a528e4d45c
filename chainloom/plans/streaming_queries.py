"""Streams over landed logs, run to their end; each must equal its batch answer."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, SparkSession, functions as F

from chainloom import session
from chainloom.operators import coverage, routing
from chainloom.plans.endpoints import with_texts
from chainloom.plans.registry import damaged_transfers, query
from chainloom.sources import feed, logs as log_files
from chainloom.sources.specs import spec_rows
from chainloom.streaming import ingest, live, supervise

META_SQL = "block_number, block_timestamp, transaction_hash, log_index"
META = META_SQL.split(", ")
TRANSFER_SPECS = [feed.TRANSFERS_A, feed.TRANSFERS_B]
A_SQL = f"SELECT {META_SQL}, src, dst, CAST(wad AS VARCHAR) AS wad FROM a"


def landed(spark: SparkSession, logs: DataFrame) -> str:
    path = session.scratch(spark, "landed")
    log_files.land_logs(logs, path)
    return path


def finish(*streams) -> None:
    """Wait until everything landed is processed, then stop."""
    try:
        for s in streams:
            s.processAllAvailable()
    finally:
        for s in streams:
            s.stop()


@query(A_SQL)
def stream_tail(spark: SparkSession, d: str) -> DataFrame:
    """A following stream that sees a first landing, then a second one."""
    logs = feed.transfer_logs(spark, d)
    path, root = landed(spark, logs.filter("log_index < 2")), session.scratch(spark, "tail")
    stream = ingest.start(spark, path, TRANSFER_SPECS, root, poll="1 second")
    try:
        stream.processAllAvailable()
        log_files.land_logs(logs.filter("log_index >= 2"), path)
    finally:
        finish(stream)
    return with_texts(ingest.stored(spark, root, feed.TRANSFERS_A).select(*META, "src", "dst", "wad"))


@query(f"SELECT {META_SQL}, from_addr, to_addr, CAST(value AS VARCHAR) AS value FROM b")
def stream_catch_up(spark: SparkSession, d: str) -> DataFrame:
    """One pass over what has landed, then the stream ends by itself."""
    path, root = landed(spark, feed.transfer_logs(spark, d)), session.scratch(spark, "caught-up")
    ingest.start(spark, path, TRANSFER_SPECS, root, follow=False).awaitTermination()
    return with_texts(ingest.stored(spark, root, feed.TRANSFERS_B).select(*META, "from_addr", "to_addr", "value"))


@query(f"SELECT {META_SQL}, 'transfers_a' AS spec FROM a UNION ALL SELECT {META_SQL}, 'transfers_b' FROM b")
def resume_per_spec(spark: SparkSession, d: str) -> DataFrame:
    """Two ingests with a cut inside a block; the second resumes each spec at its own
    high-water block, inclusive, and completes it."""
    logs, root = feed.transfer_logs(spark, d), session.scratch(spark, "resumed")
    half = logs.agg(F.max("block_number")).first()[0] // 2
    first = logs.filter((F.col("block_number") < half) | ((F.col("block_number") == half) & (F.col("log_index") < 2)))
    ingest.ingest(first, TRANSFER_SPECS, root, 0)
    tables = [ingest.stored(spark, root, s).select(*META, "spec") for s in TRANSFER_SPECS]
    table = spec_rows(spark, TRANSFER_SPECS)
    resume = routing.resume_points(table, routing.high_water_mark(tables[0].unionAll(tables[1]), table))
    # The points are written, since the tables they come from change in the next step.
    points = session.scratch(spark, "points")
    resume.select("spec", "resume_block").write.parquet(points)
    path = landed(spark, logs)
    ingest.ingest(log_files.scan_logs(spark, path), TRANSFER_SPECS, root, 1, spark.read.schema("spec string, resume_block bigint").parquet(points))
    tables = [ingest.stored(spark, root, s).select(*META, "spec") for s in TRANSFER_SPECS]
    return tables[0].unionAll(tables[1])


@query(f"SELECT {META_SQL}, src, CAST(1 AS BIGINT) AS copies FROM a")
def dedup_stream(spark: SparkSession, d: str) -> DataFrame:
    """Every log lands twice: within a batch and again in a later one."""
    logs = feed.transfer_logs(spark, d)
    path, root = landed(spark, logs.unionAll(logs)), session.scratch(spark, "dedup")
    ingest.start(spark, path, TRANSFER_SPECS, root, follow=False).awaitTermination()
    log_files.land_logs(logs, path)
    ingest.start(spark, path, TRANSFER_SPECS, root, follow=False).awaitTermination()
    stored = ingest.stored(spark, root, feed.TRANSFERS_A)
    return stored.groupBy(*META, "src").agg(F.count("*").alias("copies"))


@query("""SELECT CASE event_id % 50 WHEN 37 THEN 'Log missing block number' WHEN 7 THEN 'Log missing block timestamp'
                      WHEN 17 THEN 'Log missing transaction hash' WHEN 27 THEN 'Log missing log index'
                      WHEN 5 THEN CASE WHEN event_type IN ('view','click') THEN 'Undecodable value for wad' ELSE 'Undecodable value for value' END
                      ELSE 'stored' END AS outcome, count(*) AS logs
          FROM transfers WHERE event_id % 50 <> 9 GROUP BY 1""")
def reject_and_continue(spark: SparkSession, d: str) -> DataFrame:
    """Bad logs end in the quarantine with a reason; all others are stored.  The first half
    comes by stream, the rest by two batches of which the last repeats the first."""
    logs, root = damaged_transfers(spark, d), session.scratch(spark, "rejects")
    half = F.pmod(F.xxhash64("topics", "data", "log_index"), F.lit(2)) == 0
    ingest.start(spark, landed(spark, logs.filter(half)), TRANSFER_SPECS, root, follow=False).awaitTermination()
    rest = log_files.scan_logs(spark, landed(spark, logs.filter(~half)))
    for _ in range(2):
        ingest.ingest(rest, TRANSFER_SPECS, root)
    outcomes = ingest.rejected(spark, root).select(F.col("reject_reason").alias("outcome"))
    for s in TRANSFER_SPECS:
        outcomes = outcomes.unionAll(ingest.stored(spark, root, s).select(F.lit("stored").alias("outcome")))
    return outcomes.groupBy("outcome").agg(F.count("*").alias("logs"))


# The second field is not indexed in the log of this spec, so that its data is too short.
WRONG_A = dataclasses.replace(feed.TRANSFERS_A, fields=tuple(dataclasses.replace(f, indexed=f.name == "src") for f in feed.TRANSFER_FIELDS))


@query("""SELECT CASE event_id % 50 WHEN 37 THEN 'Log missing block number' WHEN 7 THEN 'Log missing block timestamp'
                      WHEN 17 THEN 'Log missing transaction hash' WHEN 27 THEN 'Log missing log index'
                      WHEN 5 THEN 'Undecodable value for dst' ELSE 'stored' END AS outcome, count(*) AS logs
          FROM a WHERE event_id % 50 <> 9 GROUP BY 1""")
def replay_rejects(spark: SparkSession, d: str) -> DataFrame:
    """All logs are rejected under a wrong spec; the corrected one settles those that are
    whole, and a second replay finds nothing to add."""
    logs, root = damaged_transfers(spark, d), session.scratch(spark, "replayed")
    ingest.ingest(log_files.scan_logs(spark, landed(spark, logs)), [WRONG_A], root)
    for _ in range(2):
        ingest.replay_rejects(spark, root, [feed.TRANSFERS_A])
    outcomes = ingest.rejected(spark, root).select(F.col("reject_reason").alias("outcome"))
    outcomes = outcomes.unionAll(ingest.stored(spark, root, feed.TRANSFERS_A).select(F.lit("stored").alias("outcome")))
    return outcomes.groupBy("outcome").agg(F.count("*").alias("logs"))


def thirds(logs: DataFrame) -> list[tuple[DataFrame, int, int]]:
    """The logs of three block ranges that cover all of them."""
    last = logs.agg(F.max("block_number")).first()[0]
    third = (last + 1) // 3
    ends = [(0, third - 1), (third, 2 * third - 1), (2 * third, last)]
    return [(logs.filter(F.col("block_number").between(*e)), *e) for e in ends]


@query(f"""SELECT {META_SQL}, 'transfers_a' AS spec FROM a UNION ALL
           SELECT {META_SQL}, 'transfers_b' FROM b WHERE block_number >= (SELECT (max(block_number) + 1) // 3 + 10 FROM transfers)""")
def late_chunk(spark: SparkSession, d: str) -> DataFrame:
    """The middle range lands after the newest was ingested, and the first one lands again; each
    spec takes in what it has not covered, from its start block on."""
    chunks = thirds(feed.transfer_logs(spark, d))
    path, root = session.scratch(spark, "chunks"), session.scratch(spark, "late")
    specs = [feed.TRANSFERS_A, dataclasses.replace(feed.TRANSFERS_B, start_block=chunks[1][1] + 10)]
    for landing in ((0, 2), (1, 0)):
        for i in landing:
            logs, first, last = chunks[i]
            coverage.land_chunk(logs, path, feed.MAINNET, first, last)
        ingest.ingest_missing(spark, path, specs, root)
    tables = [ingest.stored(spark, root, s).select(*META, "spec") for s in specs]
    return tables[0].unionAll(tables[1])


@query(
    """SELECT 'transfers_a' AS spec, third AS from_block, 2 * third - 1 AS to_block FROM cuts UNION ALL
       SELECT 'transfers_b', third + 10, 2 * third - 1 FROM cuts UNION ALL SELECT 'quiet', 0, head FROM cuts""",
    cuts="SELECT max(block_number) AS head, (max(block_number) + 1) // 3 AS third FROM transfers",
)
def missing_ranges(spark: SparkSession, d: str) -> DataFrame:
    """What each spec lacks of its start block to the head, while the middle range is missing;
    one spec was not ingested at all."""
    logs = feed.transfer_logs(spark, d)
    chunks = thirds(logs)
    path, root = session.scratch(spark, "chunks"), session.scratch(spark, "missing")
    specs = [feed.TRANSFERS_A, dataclasses.replace(feed.TRANSFERS_B, start_block=chunks[1][1] + 10)]
    for i in (2, 0):
        coverage.land_chunk(*chunks[i][:1], path, feed.MAINNET, *chunks[i][1:])
        ingest.ingest_missing(spark, path, specs, root)
    heads = logs.groupBy("chain").agg(F.max("block_number").alias("head"))
    table = spec_rows(spark, [*specs, dataclasses.replace(feed.QUIET, chain=feed.MAINNET)])
    return coverage.gaps(coverage.covered_ranges(spark, root), heads, table)


@query("""SELECT chain, count(*) AS events, max(block_number) AS last_block FROM (
            SELECT chain, block_number FROM transfers UNION ALL SELECT chain, block_number FROM fees) GROUP BY chain""")
def multi_chain(spark: SparkSession, d: str) -> DataFrame:
    """One stream per chain, side by side, over one landing folder."""
    logs = feed.transfer_logs(spark, d).unionAll(feed.fee_logs(spark, d))
    path, root = landed(spark, logs), session.scratch(spark, "chains")
    specs = [*TRANSFER_SPECS, feed.FEE_UPDATES]
    supervise.run_chains(spark, path, specs, root, follow=False)
    rows = None
    for s in specs:
        part = ingest.stored(spark, f"{root}/{s.chain}", s).select("chain", "block_number")
        rows = part if rows is None else rows.unionAll(part)
    return rows.groupBy("chain").agg(F.count("*").alias("events"), F.max("block_number").alias("last_block"))


@query("""SELECT block_timestamp // 3600 * 3600 AS hour, count(*) AS swap_count, CAST(sum(wad) AS VARCHAR) AS total_amount0,
                 CAST(sum(wad) AS VARCHAR) AS total_amount1 FROM a WHERE event_id % 50 NOT IN (5, 7, 9, 17, 27, 37) GROUP BY 1""")
def live_hourly_volume(spark: SparkSession, d: str) -> DataFrame:
    """Hourly totals with shipped defaults: the newest logs land first, the older ones after
    them with replays of some, and damaged logs among all."""
    logs, root = damaged_transfers(spark, d), session.scratch(spark, "live")
    late = F.pmod(F.xxhash64("topics", "data", "log_index"), F.lit(3)) == 0
    path = landed(spark, logs.filter(~late))
    amounts = ("wad", "wad")
    live.start_hourly(spark, path, TRANSFER_SPECS, root, feed.TRANSFERS_A, amounts, follow=False).awaitTermination()
    log_files.land_logs(logs.filter(late).unionAll(logs.filter("log_index = 1")), path)
    live.start_hourly(spark, path, TRANSFER_SPECS, root, feed.TRANSFERS_A, amounts, follow=False).awaitTermination()
    return with_texts(live.current_hours(spark, root))


@query(A_SQL)
def mixed_case_logs(spark: SparkSession, d: str) -> DataFrame:
    """Addresses, topics and data in any case are landed in lower case and lose no log."""
    upper = lambda c: F.concat(F.lit("0x"), F.upper(F.substring(c, 3, 1_000_000)))
    logs = feed.transfer_logs(spark, d)
    mixed = logs.withColumns({"address": upper("address"), "topic0": upper("topic0"), "data": upper("data"), "topics": F.transform("topics", upper)})
    path, root = landed(spark, mixed), session.scratch(spark, "mixed")
    ingest.start(spark, path, TRANSFER_SPECS, root, follow=False).awaitTermination()
    return with_texts(ingest.stored(spark, root, feed.TRANSFERS_A).select(*META, "src", "dst", "wad"))
