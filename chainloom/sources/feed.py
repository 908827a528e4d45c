"""Raw logs derived from ordinary tables, encoded as a chain would emit them.

The engine decodes what this encodes; the word layout is pinned by hand-written words
in the tests.  Encoding is one narrow select per table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from chainloom.functions.keccak import topic0
from chainloom.sources.logs import bucket_of
from chainloom.sources.schemas import RAW_LOG
from chainloom.sources.specs import EventField as Field, EventSpec

MAINNET, SONIC = "mainnet", "sonic"
TOKEN_A, TOKEN_B = "0x" + "a" * 40, "0x" + "b" * 40
POOL_PREFIX = "0x" + "c" * 39
FEE_MANAGER, MESSENGER = "0x" + "d" * 40, "0x" + "e" * 40
POOLS = range(1, 8)

TRANSFER_FIELDS = (Field("src", "address", True), Field("dst", "address", True), Field("wad", "uint256"))
SWAP_FIELDS = (
    Field("sender", "address", True),
    Field("recipient", "address", True),
    Field("amount0", "int256"),
    Field("amount1", "int256"),
    Field("sqrtPriceX96", "uint160"),
    Field("liquidity", "uint128"),
    Field("tick", "int24"),
)

TRANSFERS_A = EventSpec("transfers_a", MAINNET, TOKEN_A, "Transfer", TRANSFER_FIELDS)
TRANSFERS_B = EventSpec(
    "transfers_b", MAINNET, TOKEN_B, "Transfer", TRANSFER_FIELDS, columns=("from_addr", "to_addr", "value")
)
SWAPS = [EventSpec(f"swaps_{n}", MAINNET, f"{POOL_PREFIX}{n}", "Swap", SWAP_FIELDS, table="swaps") for n in POOLS]
FEE_UPDATES = EventSpec(
    "fee_updates", SONIC, FEE_MANAGER, "PoolUpdated",
    (Field("pool", "address", True), Field("swapFeePercentage", "uint256")), columns=("pool", "fee"),
)
MESSAGES = EventSpec(
    "messages", SONIC, MESSENGER, "Message",
    (Field("id", "uint64", True), Field("text", "string"), Field("codes", "uint16[]")),
)
NESTED = EventSpec(
    "nested", SONIC, "0x" + "9" * 40, "Nested",
    (Field("pair", "(address,uint256)"), Field("trio", "uint32[3]"), Field("names", "string[]"), Field("grid", "uint16[][]"),
     Field("behind", "uint64"), Field("pairs", "(string,bool[2])[]")),
)
QUIET = EventSpec("quiet", SONIC, "0x" + "f" * 40, "Quiet", (Field("id", "uint64", True),))  # a contract without logs
ALL_SPECS = [TRANSFERS_A, TRANSFERS_B, *SWAPS, FEE_UPDATES, MESSAGES, QUIET]


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The needed columns of a table, its key first.  A table with fewer splits than cores is
    spread over them by that key, since decoding is CPU work; a large one has splits enough
    and is left alone."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet").select(*columns)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores, columns[0]) if df.rdd.getNumPartitions() < cores else df


def filled(digits: Column, fill: str, size: int) -> Column:
    """Hex digits, no more than ``size``, filled up at the left.  Cut by bytes: padding a text
    copies the fill digit by digit."""
    return F.substring(F.concat(F.lit(fill * size), digits).cast("binary"), -size, size).cast("string")


def hex_of(n: Column, digits: int = 64) -> Column:
    return filled(F.lower(F.hex(n.cast("bigint"))), "0", digits)


def signed_word(n: Column) -> Column:
    n = n.cast("bigint")
    return F.when(n < 0, filled(F.lower(F.hex(n)), "f", 64)).otherwise(hex_of(n))


def shifted_word(n: Column, nibbles: int) -> Column:
    """n * 16^nibbles as a word."""
    return filled(F.concat(F.lower(F.hex(n.cast("bigint"))), F.lit("0" * nibbles)), "0", 64)


def address_of(n: Column) -> Column:
    return F.concat(F.lit("0x"), hex_of(n, 40))


def cents(x: Column) -> Column:
    return F.round(x * 100).cast("bigint")


def seconds(ts: Column) -> Column:
    micros = F.unix_micros(ts.cast("timestamp"))
    return F.call_function("div", micros - F.pmod(micros, F.lit(1_000_000)), F.lit(1_000_000))


def _log(df: DataFrame, chain, address, topics, words, block, ts, tx, index) -> DataFrame:
    topics = [F.lit(topics[0]), *[F.concat(F.lit("0x"), t) for t in topics[1:]]]
    return df.select(
        F.lit(chain).alias("chain"),
        address.alias("address"),
        F.array(*topics).alias("topics"),
        topics[0].alias("topic0"),
        F.concat(F.lit("0x"), *words).alias("data"),
        block.alias("block_number"),
        ts.alias("block_timestamp"),
        F.concat(F.lit("0x"), *tx).alias("transaction_hash"),
        index.cast("int").alias("log_index"),
        bucket_of(block).alias("block_bucket"),
    )


def transfer_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events``: views and clicks as transfers of token A, the rest of token B."""
    e = table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value")
    n = F.col("event_id")
    # cents * 10^16 = cents * 5^16 shifted by 16 bits
    wad = shifted_word(cents(F.col("value")) * F.lit(5**16), 4)
    token = F.when(F.col("event_type").isin("view", "click"), F.lit(TOKEN_A)).otherwise(F.lit(TOKEN_B))
    return _log(
        e, MAINNET, token,
        [topic0(TRANSFERS_A.signature), hex_of(F.col("user_id")), hex_of(n % 97)],
        [wad], F.call_function("div", n, F.lit(4)), seconds(F.col("ts")), [hex_of(n)], n % 4,
    )


def swap_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as swaps in seven pools, one per line number."""
    cols = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate"]
    df = table(spark, sf_dir, "lineitem", *cols)
    order, part, supp, line, quantity, price, shipped = (F.col(c) for c in cols)
    line = line.cast("bigint")
    ts = seconds(shipped) + F.pmod(order * 37 + line, F.lit(86_400))
    return _log(
        df, MAINNET, F.concat(F.lit(POOL_PREFIX), line.cast("string")),
        [topic0(SWAPS[0].signature), hex_of(supp), hex_of(part)],
        [
            signed_word(cents(price)),
            signed_word(-quantity.cast("bigint")),
            shifted_word(order, 24),
            shifted_word(line, 16),
            signed_word(line - 4),
        ],
        F.call_function("div", ts, F.lit(12)), ts,
        [hex_of(order, 24), hex_of(part, 20), hex_of(supp, 20)], line,
    )


def fee_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as fee updates of one pool per customer."""
    df = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    ts, n = seconds(F.col("o_orderdate")), F.col("o_orderkey")
    return _log(
        df, SONIC, F.lit(FEE_MANAGER),
        [topic0(FEE_UPDATES.signature), hex_of(F.col("o_custkey"))],
        [hex_of(cents(F.col("o_totalprice")) * F.lit(10**10))],
        F.call_function("div", ts, F.lit(12)), ts, [hex_of(n)], F.pmod(n, F.lit(1000)),
    )


def message_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as messages: a dynamic text and a dynamic array of character codes."""
    df = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    n = F.col("doc_id")
    body = F.lower(F.hex(F.encode(F.col("text"), "UTF-8")))
    df = df.withColumns({"body": body, "codes": F.transform(F.split("lang", ""), lambda ch: hex_of(F.ascii(ch)))})
    pad = F.repeat(F.lit("0"), F.pmod(-F.length("body"), F.lit(64)))
    return _log(
        df, SONIC, F.lit(MESSENGER),
        [topic0(MESSAGES.signature), hex_of(n)],
        [
            hex_of(F.lit(64)),
            hex_of(F.lit(96) + F.call_function("div", F.length(F.concat("body", pad)), F.lit(2))),
            hex_of(F.call_function("div", F.length("body"), F.lit(2))),
            F.col("body"), pad,
            hex_of(F.size("codes")),
            F.concat_ws("", "codes"),
        ],
        n, F.lit(1_700_000_000) + n * 12, [hex_of(n)], F.lit(0),
    )


def nested_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as logs of one event with nested fields: nine head words, then the tails."""
    df = table(spark, sf_dir, "documents", "doc_id", "lang", "source")
    n, number = F.col("doc_id"), lambda k: hex_of(F.lit(k))
    text = lambda c: [hex_of(F.length(c)), F.rpad(F.lower(F.hex(F.encode(F.col(c), "UTF-8"))), 64, "0")]  # of 32 bytes at most
    head = [hex_of(n % 1000), hex_of(n * 1000), hex_of(n % 3), hex_of(n % 1000), hex_of(n)]
    names = [number(2), number(64), number(128), *text("lang"), *text("source")]
    grid = [number(3), number(96), number(192), number(224), number(2), hex_of(n % 100), hex_of(n % 7), number(0), number(1), hex_of(n % 50_000)]
    pairs = [number(1), number(32), number(96), number(1), hex_of((n % 2).cast("bigint")), *text("source")]
    starts = [32 * k for k in (9, 9 + len(names), 9 + len(names) + len(grid))]
    words = [*head, number(starts[0]), number(starts[1]), hex_of(n * 2), number(starts[2]), *names, *grid, *pairs]
    return _log(df, SONIC, F.lit(NESTED.address), [topic0(NESTED.signature)], words, n, F.lit(1_700_000_000) + n, [hex_of(n)], F.lit(0))


def all_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    feeds = [f(spark, sf_dir).select(RAW_LOG.fieldNames()) for f in (transfer_logs, swap_logs, fee_logs, message_logs)]
    out = feeds[0]
    for feed in feeds[1:]:
        out = out.unionAll(feed)
    return out
