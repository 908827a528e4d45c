"""Scans, specs, routing, storage and schema change."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from chainloom import session
from chainloom.functions import keccak, u256
from chainloom.operators import decode, routing, storage
from chainloom.plans.endpoints import with_texts
from chainloom.plans.registry import damaged_transfers, query, swaps, transfers_a
from chainloom.sources import feed, logs as log_files, specs as spec_files
from chainloom.sources.schemas import LOG_KEY
from chainloom.sources.specs import EventSpec

META_SQL = "block_number, block_timestamp, transaction_hash, log_index"
META = META_SQL.split(", ")


@query(f"SELECT chain, address, {META_SQL}, '0x' || printf('%064x', wad) AS data FROM a")
def scan_logs(spark: SparkSession, d: str) -> DataFrame:
    """Landed logs of one contract over the whole block range."""
    path = session.scratch(spark, "logs")
    log_files.land_logs(feed.transfer_logs(spark, d), path)
    found = log_files.scan_logs(spark, path, [feed.TOKEN_A.upper().replace("0X", "0x")], 0, 10**12)
    return found.select("chain", "address", *META, "data")


@query("""SELECT c.chain, f AS from_block, least(f + 999, head) AS to_block, count(b) AS log_count
          FROM chunks c LEFT JOIN logs l ON l.chain = c.chain AND b BETWEEN f AND f + 999 GROUP BY ALL""",
       logs="SELECT chain, block_number AS b FROM transfers UNION ALL SELECT 'sonic', doc_id FROM documents",
       heads="SELECT chain, max(b) AS head FROM logs GROUP BY chain",
       chunks="SELECT chain, head, unnest(range(0, head + 1, 1000)) AS f FROM heads")
def chunk_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Each chain has its own head and chunks."""
    return log_files.chunk_coverage(feed.transfer_logs(spark, d).unionAll(feed.message_logs(spark, d)), 0)


@query(f"SELECT address, {META_SQL}, tick FROM swaps WHERE tick >= 0")
def scan_events(spark: SparkSession, d: str) -> DataFrame:
    """A stored event table, read with its declared schema."""
    path = session.scratch(spark, "swaps")
    rows = swaps(spark, d)
    storage.write_events(rows.withColumn("block_bucket", F.call_function("div", F.col("block_number"), F.lit(100_000))), path)
    return storage.read_events(spark, path, rows.schema).filter("tick >= 0").select("address", *META, "tick")


ABI_KINDS = ("address", "uint256", "bool", "bytes32", "int24")


@query(f"""SELECT s_suppkey AS source, 'Paid' || s_nationkey AS event_name,
                  'Paid' || s_nationkey || '(address,' || list_extract({list(ABI_KINDS)}, CAST(s_suppkey % 5 + 1 AS INTEGER)) || ')' AS event_signature,
                  'amount' || s_suppkey AS last_input FROM supplier
           UNION ALL SELECT s_suppkey, 'Closed', 'Closed()', NULL FROM supplier WHERE s_acctbal > 5000""")
def abi_event_catalog(spark: SparkSession, d: str) -> DataFrame:
    """One ABI document per supplier, as text; functions are passed over."""
    kinds = ", ".join(f"'{k}'" for k in ABI_KINDS)
    docs = feed.table(spark, d, "supplier", "s_suppkey", "s_nationkey", "s_acctbal").selectExpr(
        "s_suppkey AS source",
        f"""concat('[{{"type":"function","name":"pay","inputs":[]}},{{"type":"event","name":"Paid', s_nationkey,
            '","inputs":[{{"indexed":true,"name":"to","type":"address"}},{{"indexed":false,"name":"amount', s_suppkey,
            '","type":"', element_at(array({kinds}), cast(s_suppkey % 5 + 1 as int)), '"}}]}}',
            if(s_acctbal > 5000, ',{{"type":"event","name":"Closed","inputs":[]}}', ''), ']') AS abi""",
    )
    events = spec_files.abi_event_catalog(docs)
    return events.select("source", "event_name", "event_signature", F.expr("try_element_at(inputs, -1).name").alias("last_input"))


# Published topics of well-known events.
KNOWN_TOPICS = {
    "Transfer(address,address,uint256)": "0xddf252ad1be2c89b69c2b068fc378daa952ba7f163c4a11628f55a4df523b3ef",
    "Approval(address,address,uint256)": "0x8c5be1e5ebec7d5bd14f71427d1e84f3dd0314c0f7b2291e5b200ac8c7c3b925",
    "Deposit(address,uint256)": "0xe1fffcc4923d04b559f4d29a8bfc6cda04eb5b0d3c460751c2402c5c5cc9109c",
    "Withdrawal(address,uint256)": "0x7fcf532c15f0a6db0bd6d0e038bea71d30d808c7d98cb3bf7268a95bf5081b65",
    "Swap(address,address,int256,int256,uint160,uint128,int24)": "0xc42079f94a6350d7e6235f29174924f928cc2ac818eb64fed8004e115fbcca67",
}
_EVENT_SIGNATURES = dict(zip(("view", "click", "purchase", "signup", "error"), KNOWN_TOPICS))
_SIGNATURE_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{s}'" for k, s in _EVENT_SIGNATURES.items()) + " END"
_TOPIC_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{KNOWN_TOPICS[s]}'" for k, s in _EVENT_SIGNATURES.items()) + " END"


@query(f"SELECT {_SIGNATURE_SQL} AS event_signature, {_TOPIC_SQL} AS topic0, count(*) AS logs FROM events GROUP BY 1, 2")
def topic0_catalog(spark: SparkSession, d: str) -> DataFrame:
    """Signatures seen in a log table, hashed once each and joined back to their counts."""
    named = feed.table(spark, d, "events", "event_id", "event_type").selectExpr(f"{_SIGNATURE_SQL} AS event_signature")
    counts = named.groupBy("event_signature").agg(F.count("*").alias("logs"))
    return keccak.topic0_catalog(counts).join(counts, "event_signature")


@query("""SELECT 'Paid' AS event_name, 'Paid(address,uint256)' AS event_signature, s_nationkey * 100::BIGINT AS start_block,
                 '0x' || printf('%040x', s_suppkey + 10) AS address, CASE WHEN s_acctbal < 0 THEN 'sonic' ELSE 'mainnet' END AS chain,
                 2 AS field_count, 'paid_' || s_suppkey AS table_name, 'paid_to' AS first_column FROM supplier""")
def load_specs(spark: SparkSession, d: str) -> DataFrame:
    """Spec documents, one per supplier, written as JSON and read with the declared schema."""
    path = session.scratch(spark, "specs")
    spec_documents(spark, d).drop("s_suppkey").write.text(path)
    loaded = spec_files.load_specs(spark, path, one_per_line=True)
    return loaded.select(
        "event_name", "event_signature", "start_block", "address", "chain", F.size("fields").alias("field_count"), "table_name",
        F.get("columns", F.lit(0)).alias("first_column"),
    )


@query(f"""SELECT CAST(row_number() OVER (ORDER BY s_suppkey) - 1 AS INTEGER) AS spec_order, 'paid_' || s_suppkey AS spec,
                  CASE WHEN s_acctbal < 0 THEN 'sonic' ELSE 'mainnet' END AS chain, '0x' || printf('%040x', s_suppkey + 10) AS address,
                  '{keccak.topic0("Paid(address,uint256)")}' AS topic0, s_nationkey * 100::BIGINT AS start_block, 'paid_' || s_suppkey AS table_name FROM supplier""")
def load_specs_routing(spark: SparkSession, d: str) -> DataFrame:
    """The same documents, one in each file, as the table that logs are routed by."""
    path = session.scratch(spark, "spec-files")
    spec_documents(spark, d).write.partitionBy("s_suppkey").text(path)
    return spec_files.routing_table(spec_files.load_specs(spark, f"{path}/*"))


def spec_documents(spark: SparkSession, d: str) -> DataFrame:
    return feed.table(spark, d, "supplier", "s_suppkey", "s_nationkey", "s_acctbal").select("s_suppkey", F.to_json(F.struct(
        F.lit("Paid").alias("event_name"), F.lit("Paid(address,uint256)").alias("event_signature"),
        (F.col("s_nationkey") * 100).alias("start_block"),
        F.concat(F.lit("0x"), F.upper(feed.hex_of(F.col("s_suppkey") + 10, 40))).alias("contract_address"),
        F.when(F.col("s_acctbal") < 0, "sonic").otherwise("mainnet").alias("chain"),
        F.expr("""array(named_struct('name', 'paidTo', 'solidity_type', 'address', 'rust_type', 'String', 'indexed', true),
                        named_struct('name', 'amount', 'solidity_type', 'uint256', 'rust_type', 'String', 'indexed', false))""").alias("indexed_fields"),
        F.expr("""named_struct('table_name', concat('paid_', s_suppkey), 'columns', array(named_struct('name', 'paid_to', 'type', 'VARCHAR(42)'),
                        named_struct('name', 'amount', 'type', 'NUMERIC(78, 0)')), 'indexes', array('block_number'))""").alias("table_schema"),
        F.lit("payments").alias("description"),
    )).alias("value"))


@query(f"SELECT chain, address, {META_SQL}, src, dst, CAST(wad AS VARCHAR) AS wad FROM a")
def sink_append_dedup(spark: SparkSession, d: str) -> DataFrame:
    """All logs landed twice in one batch, then once more in a second: stored once."""
    path = session.scratch(spark, "appended")
    rows = transfers_a(spark, d)
    storage.append_dedup(rows.unionAll(rows), path)
    storage.append_dedup(rows, path)
    return with_texts(storage.read_events(spark, path, rows.schema).drop("block_bucket"))


_DAMAGED = ", ".join(
    f"CASE WHEN event_id % 50 <> {n} THEN {c} END AS {c}"
    for n, c in ((37, "block_number"), (7, "block_timestamp"), (17, "transaction_hash"), (27, "log_index"))
)


@query(f"SELECT {_DAMAGED}, CASE address WHEN '{feed.TOKEN_A}' THEN 'transfers_a' ELSE 'transfers_b' END AS spec FROM transfers WHERE event_id % 50 <> 9")
def route_logs(spark: SparkSession, d: str) -> DataFrame:
    """Logs without topics match nothing; of two specs for one event the first wins."""
    double = EventSpec("late_copy", feed.MAINNET, feed.TOKEN_A, "Transfer", feed.TRANSFER_FIELDS, 10)
    table = spec_files.spec_rows(spark, [*feed.ALL_SPECS, double])
    return routing.route_logs(damaged_transfers(spark, d), table).select(*META, "spec")


@query("""SELECT address, count(*) AS logs, min(block_number) AS first_block FROM transfers
          WHERE block_number >= CASE WHEN event_type IN ('view','click') THEN 100 ELSE 700 END GROUP BY address""")
def start_block_gate(spark: SparkSession, d: str) -> DataFrame:
    early = EventSpec("a", feed.MAINNET, feed.TOKEN_A, "Transfer", feed.TRANSFER_FIELDS, 100)
    late = EventSpec("b", feed.MAINNET, feed.TOKEN_B, "Transfer", feed.TRANSFER_FIELDS, 700)
    routed = routing.route_logs(feed.transfer_logs(spark, d), spec_files.spec_rows(spark, [early, late]))
    return routing.start_block_gate(routed).groupBy("address").agg(
        F.count("*").alias("logs"), F.min("block_number").alias("first_block"))


@query("""SELECT CASE event_id % 50 WHEN 37 THEN 'Log missing block number' WHEN 7 THEN 'Log missing block timestamp'
                      WHEN 17 THEN 'Log missing transaction hash' WHEN 27 THEN 'Log missing log index' END AS reject_reason,
                 address, count(*) AS logs FROM transfers GROUP BY 1, 2""")
def require_metadata(spark: SparkSession, d: str) -> DataFrame:
    return routing.require_metadata(damaged_transfers(spark, d)).groupBy("reject_reason", "address").agg(F.count("*").alias("logs"))


@query(f"SELECT {META_SQL}, from_addr AS payer, to_addr AS payee FROM b")
def positional_columns(spark: SparkSession, d: str) -> DataFrame:
    """Decoded values take the stored columns by position; a value beyond them is dropped."""
    spec = EventSpec("b", feed.MAINNET, feed.TOKEN_B, "Transfer", feed.TRANSFER_FIELDS, columns=("payer", "payee"))
    return decode.event_table(feed.transfer_logs(spark, d), spec).select(*META, "payer", "payee")


@query(f"SELECT {META_SQL} FROM b")
def anti_new_rows(spark: SparkSession, d: str) -> DataFrame:
    """Of a full replay, the rows not stored yet, where token A is stored."""
    batch = decode.decode_events(feed.transfer_logs(spark, d), feed.TRANSFERS_A)
    return storage.new_rows(batch, transfers_a(spark, d), LOG_KEY).select(*META)


ALL_SPECS_SQL = " UNION ALL ".join(f"SELECT '{s.name}' AS spec, '{s.address}' AS address, '{s.chain}' AS chain" for s in feed.ALL_SPECS)


@query("""SELECT s.spec, coalesce(max(l.block_number), 0) AS max_block FROM all_specs s
          LEFT JOIN (SELECT address, block_number FROM transfers UNION ALL SELECT address, block_number FROM swaps
                     UNION ALL SELECT address, block_number FROM fees
                     UNION ALL SELECT '0xeeeeeeeeeeeeeeeeeeeeeeeeeeeeeeeeeeeeeeee', doc_id FROM documents) l ON s.address = l.address GROUP BY s.spec""", all_specs=ALL_SPECS_SQL)
def high_water_mark(spark: SparkSession, d: str) -> DataFrame:
    """Highest block per spec; the spec without any logs has 0."""
    table = spec_files.spec_rows(spark, feed.ALL_SPECS)
    return routing.high_water_mark(routing.route_logs(feed.all_logs(spark, d), table), table)


@query("""SELECT s.chain, s.specs, 0::BIGINT AS min_start_block, coalesce(l.logs, 0) AS logs, l.last_block
          FROM (SELECT chain, count(*) AS specs FROM all_specs GROUP BY chain) s LEFT JOIN
               (SELECT chain, count(*) AS logs, max(block_number) AS last_block FROM (
                  SELECT chain, block_number FROM transfers UNION ALL SELECT chain, block_number FROM swaps
                  UNION ALL SELECT chain, block_number FROM fees UNION ALL SELECT 'sonic', doc_id FROM documents) GROUP BY chain) l ON s.chain = l.chain""", all_specs=ALL_SPECS_SQL)
def chain_groups(spark: SparkSession, d: str) -> DataFrame:
    table = spec_files.spec_rows(spark, feed.ALL_SPECS)
    return routing.chain_groups(routing.route_logs(feed.all_logs(spark, d), table), table)


@query(f"""SELECT transaction_hash, log_index, CAST(CAST(amount1 AS VARCHAR) AS INTEGER) AS amount1, CAST(tick AS BIGINT) AS tick,
                  'none' AS venue, CAST(NULL AS BOOLEAN) AS checked, CAST(0 AS BIGINT) AS refused FROM swaps""")
def evolve_table(spark: SparkSession, d: str) -> DataFrame:
    """Columns added (with and without a default), dropped, widened and converted; the rows
    that would not convert are counted and there are none."""
    path = session.scratch(spark, "old_swaps")
    with_texts(swaps(spark, d).select("transaction_hash", "log_index", "sender", "amount1", "tick")).write.parquet(path)
    table = spark.read.schema("transaction_hash string, log_index int, sender string, amount1 string, tick int").parquet(path)
    target = T.StructType([
        T.StructField("transaction_hash", T.StringType()), T.StructField("log_index", T.IntegerType()),
        T.StructField("amount1", T.IntegerType()), T.StructField("tick", T.LongType()),
        T.StructField("venue", T.StringType(), False), T.StructField("checked", T.BooleanType()),
    ])
    rows, refused = storage.evolve_table(table, target, {"venue": "none"})
    return rows.select("*", F.lit(refused.count()).cast("bigint").alias("refused"))


@query("""SELECT transaction_hash, src IS NULL OR wad % 100000000000000000000 <> 0 OR wad // 100000000000000000000 > 1000000 AS refused,
                 CASE WHEN NOT (wad % 100000000000000000000 <> 0) THEN CAST(wad // 100000000000000000000 AS VARCHAR) END AS units FROM a""")
def evolve_refused(spark: SparkSession, d: str) -> DataFrame:
    """256-bit amounts as text, amounts in hundreds that must be whole, a sender that must be
    there: rows that would lose something are told apart."""
    path = session.scratch(spark, "old_transfers")
    with_texts(transfers_a(spark, d).select("transaction_hash", "src", "wad", F.col("wad").alias("text"))).write.parquet(path)
    rows = spark.read.schema("transaction_hash string, src string, wad string, text string").parquet(path)
    rows = rows.withColumn("hundreds", F.expr(u256.shift_text("text", 20)))
    target = T.StructType([
        T.StructField("transaction_hash", T.StringType()), T.StructField("src", T.StringType(), False),
        T.StructField("wad", T.StringType()), T.StructField("hundreds", T.IntegerType()),
    ])
    good, refused = storage.evolve_table(rows.select("transaction_hash", "src", "wad", "hundreds"), target)
    told = good.select("transaction_hash", F.lit(False).alias("refused"), F.col("hundreds").cast("string").alias("units"))
    return told.unionAll(refused.select("transaction_hash", F.lit(True).alias("refused"), F.lit(None).cast("string").alias("units")))
