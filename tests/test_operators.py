"""Routing, windows, top-k, storage and requests on small cases with known answers."""

import random

import pytest
from pyspark.sql import Window, functions as F
from pyspark.sql import types as T

from chainloom import session
from chainloom.functions import u256
from chainloom.operators import requests as req
from chainloom.operators import routing, storage, topk
from chainloom.operators.requests import Param
from chainloom.operators.windows import ORDER, over_rows, with_position
from chainloom.plans import endpoints, relational_queries
from chainloom.sources import feed, logs as log_files
from chainloom.sources.schemas import RAW_LOG
from chainloom.sources.specs import EventSpec, spec_rows
from chainloom.streaming import ingest, live


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


# --- windows ---------------------------------------------------------------------------


def skewed(spark, n=600):
    rng = random.Random(3)
    rows = [
        ("hot" if rng.random() < 0.7 else f"k{rng.randint(0, 5)}", rng.randint(0, 40), i // 3, i % 3, f"t{i}", rng.randint(0, 99))
        for i in range(n)
    ]
    return spark.createDataFrame(rows, "key string, block_timestamp bigint, block_number bigint, log_index int, transaction_hash string, v int")


@pytest.mark.parametrize("block_rows,seconds", [(3, 5), (7, 1), (50, 100), (10_000, 7)])
def test_windows_equal_plain_windows(spark, block_rows, seconds):
    df = skewed(spark).repartition(5)
    at = F.call_function("div", F.col("block_timestamp"), F.lit(seconds))
    frame = lambda w: w.rowsBetween(-2, 1)
    columns = {
        "lag": lambda w: F.lag("v", 3).over(w), "lead": lambda w: F.lead("v").over(w), "total": lambda w: F.sum("v").over(frame(w)),
    }
    got = over_rows(df, ["key"], columns, before=3, after=1, slice_col=at, block_rows=block_rows, first_last=("v",))
    w = Window.partitionBy("key").orderBy(*ORDER)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    want = df.withColumns({
        "position": F.row_number().over(w).cast("bigint"), **{n: f(w) for n, f in columns.items()},
        "first_v": F.first_value("v").over(whole), "last_v": F.last_value("v").over(whole),
    })
    names = sorted(want.columns)
    assert sorted(got.select(names).collect()) == sorted(want.select(names).collect())


def exchanges_of(df) -> int:
    """Shuffles in the plan before it runs."""
    text = df._jdf.queryExecution().executedPlan().toString()
    return sum("Exchange hashpartitioning" in line for line in text.splitlines())


@pytest.mark.parametrize("block_rows", [20, 10_000])
def test_windows_shuffle_full_rows_once(spark, block_rows):
    at = F.call_function("div", F.col("block_timestamp"), F.lit(2))
    columns = {"lag": lambda w: F.lag("v").over(w), "total": lambda w: F.sum("v").over(w.rowsBetween(-3, 0))}
    got = over_rows(skewed(spark), ["key"], columns, before=3, slice_col=at, block_rows=block_rows, first_last=("v",))
    assert exchanges_of(got) == 1
    assert ("__block" in plan_of(got)) == (block_rows == 20)  # a long entity is shuffled by block too


def test_windows_with_sparse_slices(spark):
    """Frames that reach over several short blocks, and slices far longer than a block."""
    sizes = [19, 1, 20, 1, 1, 30, 2, 1, 1, 1, 18, 5]
    rows = [("hot", s, i, 0, f"t{s}-{i}", s * i) for s, n in enumerate(sizes) for i in range(n)] + [("cold", 3, 1, 0, "t", 5)]
    df = spark.createDataFrame(rows, skewed(spark).schema)
    columns = {"lag": lambda w: F.lag("v", 9).over(w), "lead": lambda w: F.lead("v", 7).over(w)}
    w = Window.partitionBy("key").orderBy(*ORDER)
    want = df.withColumns({"position": F.row_number().over(w).cast("bigint"), **{n: f(w) for n, f in columns.items()}})
    for block_rows in (1, 3, 10, 25):
        got = over_rows(df, ["key"], columns, before=9, after=7, slice_col=F.col("block_timestamp"), block_rows=block_rows)
        assert sorted(got.select(want.columns).collect()) == sorted(want.collect())


# --- routing ------------------------------------------------------------------------------


def test_first_spec_wins_and_large_spec_tables_are_not_broadcast(spark, sf):
    copy = EventSpec("copy", feed.MAINNET, feed.TOKEN_A, "Transfer", feed.TRANSFER_FIELDS)
    table = spec_rows(spark, [feed.TRANSFERS_A, copy, feed.TRANSFERS_B])
    logs = feed.transfer_logs(spark, sf)
    small = routing.route_logs(logs, table)
    large = routing.route_logs(logs, table, broadcast_rows=1)
    count = lambda df: {r["spec"]: r["count"] for r in df.groupBy("spec").count().collect()}
    assert count(small) == count(large) and set(count(small)) == {"transfers_a", "transfers_b"}
    assert small.count() == logs.count()
    assert "BroadcastHashJoin" in plan_of(small)


def test_gate_and_metadata(spark, sf):
    spec = EventSpec("late", feed.MAINNET, feed.TOKEN_A, "Transfer", feed.TRANSFER_FIELDS, 100)
    routed = routing.route_logs(feed.transfer_logs(spark, sf), spec_rows(spark, [spec]))
    assert routing.start_block_gate(routed).agg(F.min("block_number")).first()[0] >= 100
    bad = routed.withColumn("log_index", F.lit(None).cast("int")).withColumn("block_timestamp", F.lit(None).cast("bigint"))
    assert routing.require_metadata(bad).select("reject_reason").distinct().collect()[0][0] == "Log missing block timestamp"


# --- scans ------------------------------------------------------------------------------------


def test_scan_pushes_filters_and_prunes(spark, sf, tmp_path):
    path = str(tmp_path / "logs")
    log_files.land_logs(feed.transfer_logs(spark, sf).withColumn("block_bucket", F.expr("block_number div 50")), path)
    found = log_files.scan_logs(spark, path, [feed.TOKEN_A], 0, 10**6, feed.TRANSFERS_A.topic0).select("block_number", "data")
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    text = plan_of(found)
    assert "PartitionFilters: [isnotnull(block_bucket" in text
    for needle in ("IsNotNull(topic0)", "EqualTo(topic0,", "EqualTo(address,", "LessThanOrEqual(block_number,1000000)"):
        assert needle in text
    assert "transaction_hash" not in text.split("ReadSchema")[1]
    assert found.count() > 0


def test_chunks_cover_gaps(spark):
    logs = spark.createDataFrame([("m", 5), ("m", 999), ("m", 1000), ("m", 4321), ("s", 12)], "chain string, block_number bigint")
    got = [tuple(r) for r in log_files.chunk_coverage(logs, 0).orderBy("chain", "from_block").collect()]
    assert got == [("m", 0, 999, 2), ("m", 1000, 1999, 1), ("m", 2000, 2999, 0), ("m", 3000, 3999, 0), ("m", 4000, 4321, 1), ("s", 0, 12, 1)]
    parts = log_files.chunk_coverage(logs, 990, 20).orderBy("from_block").limit(2).collect()
    assert [tuple(r) for r in parts] == [("m", 990, 1009, 2), ("m", 1010, 1029, 0)]
    assert log_files.chunk_coverage(logs.limit(0), 0).count() == 0


# --- storage --------------------------------------------------------------------------------------


def test_append_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([("m", f"t{i}", i % 3, i * 40_000) for i in range(40)], "chain string, transaction_hash string, log_index int, block_number bigint")
    storage.append_dedup(rows.limit(10).unionAll(rows.limit(10)), path)
    storage.append_dedup(rows.unionAll(rows), path)
    storage.append_dedup(rows.limit(0), path)
    storage.append_dedup(rows, path)
    stored = spark.read.parquet(path)
    assert stored.count() == 40 == stored.select("transaction_hash").distinct().count()


def test_evolve_reports_what_does_not_convert(spark):
    from pyspark.sql import types as T

    table = spark.createDataFrame([("1", "x"), ("oops", "y"), (None, "z")], "n string, gone string")
    target = T.StructType([T.StructField("n", T.IntegerType()), T.StructField("new", T.StringType())])
    rows, bad = storage.evolve_table(table, target)
    assert [tuple(r) for r in rows.collect()] == [(1, None), (None, None)]
    assert [r["n"] for r in bad.collect()] == ["oops"]
    with pytest.raises(ValueError):
        storage.evolve_table(table, T.StructType([T.StructField("must", T.StringType(), False)]))


# --- top-k and requests -----------------------------------------------------------------------------


def test_limits():
    assert topk.checked_limit(None) == 50 and topk.checked_limit(200) == 200
    for bad in (201, -1):
        with pytest.raises(ValueError):
            topk.checked_limit(bad)


def test_top_k_plans(spark):
    assert "TakeOrderedAndProject" in plan_of(topk.recent_first(skewed(spark), 20))


POOL = "0x" + "9f" * 20
PARAMS = [Param("pool", "String", path=True), Param("limit", "u32", default=50), Param("since", "Option<u64>", default="null")]


def checked(spark, params, path, given):
    df = spark.createDataFrame([(1, path, given)], "request_id int, path map<string,string>, query map<string,string>")
    return req.validate_requests(df, params)


# Of each type: values that are taken, and values that aren't with a part of the answer.
TAKEN = {
    "u64": ["0", "77", str(2**64 - 1)], "i64": ["-9", "8", str(-(2**63))], "bool": ["true", "false"], "String": ["plain words", POOL, "0x99", "y" * 1000],
    "Option<u64>": ["3"], "Option<String>": ["null", "z"],
}
REFUSED = {
    "u64": (["seven", "-1", "", "1.5", str(2**64)], "positive integer"), "i64": (["eight", "1e3", str(2**63)], "must be an integer"),
    "bool": (["yes", "TRUE?"], "must be true or false"), "String": (["y" * 1001], "exceeds maximum length"), "Vec<u8>": (["y" * 1001], "exceeds maximum length"),
    "Option<u64>": (["none"], "positive integer"),
}


@pytest.mark.parametrize("kind", sorted({*TAKEN, *REFUSED}))
def test_parameter_values(spark, kind):
    refused, part = REFUSED.get(kind, ([], ""))
    rows = [(i, {}, {"v": v}) for i, v in enumerate([*TAKEN.get(kind, []), *refused])]
    df = spark.createDataFrame(rows, "request_id int, path map<string,string>, query map<string,string>")
    errors = {r["request_id"]: r["error"] for r in req.validate_requests(df, [Param("v", kind)]).collect()}
    n = len(TAKEN.get(kind, []))
    assert all(errors[i] is None for i in range(n)), errors
    assert all(part in errors[i] for i in range(n, len(rows))), errors


def test_addresses_are_checked_by_their_digits(spark):
    assert "not a valid Ethereum address" in checked(spark, [Param("v", "String")], {}, {"v": "0x" + "zz" * 20}).first()["error"]


@pytest.mark.parametrize(
    "path,given,part",
    [
        ({"pool": POOL}, {"limit": "3", "since": "42"}, None), ({"pool": POOL}, {}, None), ({"pool": POOL}, {"limit": "200"}, None),
        ({}, {"limit": "3"}, "Missing path parameter: pool"), ({"pool": POOL}, {"limit": "three"}, "positive integer"),
        ({"pool": POOL}, {"limit": "999"}, "Limit cannot exceed 200"), ({"pool": POOL}, {"limit": str(2**32 + 5)}, "Invalid limit parameter"),
    ],
)
def test_requests(spark, path, given, part):
    error = checked(spark, PARAMS, path, given).first()["error"]
    assert error is None if part is None else part in error


def test_binding(spark):
    bind = lambda path, given, params=PARAMS: req.bind_defaults(checked(spark, params, path, given), params).first().asDict()
    odd = "x' OR pool IS NOT NULL --"
    assert bind({"pool": POOL, "more": "1"}, {"limit": "+9", "unlisted": odd}) == {"request_id": 1, "pool": POOL, "limit": 9, "since": None}
    assert bind({"pool": POOL}, {})["limit"] == 50
    assert bind({"pool": POOL}, {}, [PARAMS[0], Param("limit", "u32", default=700)])["limit"] == 200
    text = [Param("note", "Option<String>", default="dflt")]
    assert bind({}, {"note": "null"}, text)["note"] is None and bind({}, {}, text)["note"] == "dflt"
    assert checked(spark, [Param("must", "u64")], {}, {}).first()["error"] == "Missing required query parameter: must"
    assert "positive integer" in checked(spark, [Param("pool", "u64", path=True)], {"pool": "seven"}, {}).first()["error"]


def test_answers_equal_brute_force(spark):
    events = skewed(spark, 900).select(F.col("key").alias("pool"), *ORDER, "v")
    asked = [(i, "hot" if i % 2 else f"k{i % 6}", None if i % 3 else 10, None if i % 5 else 20 + i % 11, 1 + i % 200) for i in range(60)]
    requests = spark.createDataFrame(asked, "request_id int, pool string, start bigint, end bigint, lim int")
    got = topk.answer_requests(events, requests, "pool", ["pool", *ORDER, "v"])
    rows = sorted(events.collect(), key=lambda r: (-r["block_timestamp"], -r["block_number"], -r["log_index"], r["transaction_hash"]))
    want = set()
    for i, pool, start, end, lim in asked:
        hits = [r for r in rows if r["pool"] == pool and (start is None or r["block_timestamp"] >= start) and (end is None or r["block_timestamp"] <= end)]
        want |= {(i, r["transaction_hash"], n + 1) for n, r in enumerate(hits[:lim])}
    assert {(r["request_id"], r["transaction_hash"], r["rank"]) for r in got.collect()} == want


def test_answers_meet_only_the_rows_they_return(spark):
    """Thousands of ends on one busy entity: the join gives what is returned, not all pairs."""
    events = spark.range(3000).selectExpr("'p' AS pool", "id div 3 AS block_timestamp", "id AS block_number", "0 AS log_index", "cast(id AS string) AS transaction_hash")
    requests = spark.range(900).selectExpr("id AS request_id", "'p' AS pool", "cast(null AS bigint) AS start", "id AS end", "5 AS lim")
    got = topk.answer_requests(events, requests, "pool", [*ORDER])
    assert got.count() == sum(min(5, 3 * (e + 1)) for e in range(900))
    rows = [n for n in got._jdf.queryExecution().executedPlan().toString().splitlines() if "CartesianProduct" in n or "BroadcastNestedLoop" in n]
    assert not rows


# --- stored tables and streams ------------------------------------------------------------------------


def u256_rows(spark, *values):
    df = spark.createDataFrame([(i, f"{v % 2**256:064x}") for i, v in enumerate(values)], "i int, w string")
    return df.select("i", F.expr(u256.from_word("w", False)).alias("n"))


def test_wide_numbers_convert_to_their_text(spark):
    values = [5, 2**200 + 1]
    good, refused = storage.evolve_table(u256_rows(spark, *values), T.StructType([T.StructField("n", T.StringType())]))
    assert sorted(r["n"] for r in good.collect()) == sorted(map(str, values)) and refused.count() == 0
    good, refused = storage.evolve_table(u256_rows(spark, *values), T.StructType([T.StructField("n", T.LongType())]))
    assert [r["n"] for r in good.collect()] == [5] and refused.count() == 1
    json = storage.rows_to_json(u256_rows(spark, 7), {"i": "i32", "n": "String"}).first()["json"]
    assert json == '{"i":0,"n":"7"}'


def test_lossy_changes_are_refused(spark):
    rows = spark.createDataFrame([("5.75", 1.9, "a"), ("07", 2.0, None), ("x", 3.0, "b"), ("12", 4.0, "c")], "t string, d double, s string")
    change = lambda **kinds: storage.evolve_table(rows, T.StructType([T.StructField(n, k, nullable) for n, (k, nullable) in kinds.items()]))
    good, refused = change(t=(T.IntegerType(), True))
    assert sorted(r["t"] for r in good.collect()) == [7, 12] and refused.count() == 2
    good, refused = change(d=(T.IntegerType(), True))
    assert sorted(r["d"] for r in good.collect()) == [2, 3, 4] and refused.count() == 1
    good, refused = change(s=(T.StringType(), False))
    assert sorted(r["s"] for r in good.collect()) == ["a", "b", "c"] and refused.count() == 1


def test_a_huge_fee_neither_fails_nor_vanishes(spark):
    fees = [10**17, 10**35, 2**255, 3 * 10**17, *[10**17] * 14]
    rows = u256_rows(spark, *fees).select(
        F.lit("p").alias("pool"), F.col("i").cast("bigint").alias("block_number"), (F.col("i") * 10_000).cast("bigint").alias("block_timestamp"),
        F.col("i").cast("string").alias("transaction_hash"), F.lit(0).alias("log_index"), F.col("n").alias("fee"),
    )
    got = sorted(endpoints.fee_texts(endpoints.fee_series(rows)).collect(), key=lambda r: r["block_number"])
    assert [r["fee"] for r in got][2] == f"{2**255 // 10**18}.{2**255 % 10**18:018d}"
    assert [r["in_range"] for r in got] == [i < 2 or i > 12 for i in range(len(fees))]
    assert got[-1]["twa_fee"] == "0.100000000000000000" and got[5]["twa_fee"] is None


def landed_transfers(spark, days):
    """One log of token A for each day, in the order they land."""
    word = lambda n: f"{n:064x}"
    rows = [(feed.MAINNET, feed.TOKEN_A, [feed.TRANSFERS_A.topic0, "0x" + word(1), "0x" + word(2)], feed.TRANSFERS_A.topic0, "0x" + word(5), d * 7200, d * 86_400 + 60, f"0x{d}", 0, 0) for d in days]
    return spark.createDataFrame(rows, RAW_LOG)


def test_old_logs_after_new_ones_count(spark, tmp_path):
    path, root = str(tmp_path / "landed"), str(tmp_path / "root")
    for days in ([100], [50, 51, 50], [100, 50]):  # a backlog, and replays
        log_files.land_logs(landed_transfers(spark, days), path)
        live.start_hourly(spark, path, [feed.TRANSFERS_A], root, feed.TRANSFERS_A, ("wad", "wad"), follow=False).awaitTermination()
    got = live.current_hours(spark, root).collect()
    assert sorted((r["hour"] // 86_400, r["swap_count"], r["total_amount0"]["w0"]) for r in got) == [(50, 1, 5), (51, 1, 5), (100, 1, 5)]


def test_a_backlog_comes_in_many_batches_and_rejects_stay(spark, tmp_path):
    path, root = str(tmp_path / "landed"), str(tmp_path / "root")
    for d in range(6):
        log_files.land_logs(landed_transfers(spark, [d]), path)
    stream = ingest.start(spark, path, [feed.TRANSFERS_A], root, follow=False, files_per_trigger=2)
    stream.awaitTermination()
    assert len(stream.recentProgress) >= 3 and ingest.stored(spark, root, feed.TRANSFERS_A).count() == 6
    for d in (7, 8):
        ingest.ingest(landed_transfers(spark, [d]).withColumn("block_timestamp", F.lit(None).cast("bigint")), [feed.TRANSFERS_A], root)
    assert sorted(r["block_number"] for r in ingest.rejected(spark, root).collect()) == [7 * 7200, 8 * 7200]


def test_ingest_reads_only_what_specs_can_match(spark, tmp_path):
    log_files.land_logs(landed_transfers(spark, [1, 30]), str(tmp_path))
    logs = ingest.relevant(log_files.scan_logs(spark, str(tmp_path)), [feed.TRANSFERS_A], 200_000)
    text = logs._jdf.queryExecution().executedPlan().toString()
    scan = text[text.index("PartitionFilters"):]
    assert "chain" in scan[:400] and "block_bucket" in scan[:400]
    pushed = scan[scan.index("PushedFilters"):]
    assert "address" in pushed and "topic0" in pushed and logs.count() == 1


def test_scratch_needs_a_shared_folder_on_a_cluster(spark):
    class Context:
        master = "spark://host:7077"

    class Session:
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})
        sparkContext = Context

    with pytest.raises(RuntimeError):
        session.scratch(Session, "x")


def test_rejects_without_a_complete_key_stay_apart(spark, tmp_path):
    spec = feed.TRANSFERS_A
    topics = lambda n: [spec.topic0, "0x" + f"{n:064x}", "0x" + f"{n + 1:064x}"]
    log = lambda n, tx, data: (spec.chain, spec.address.lower(), topics(n), spec.topic0, data, 9_000_000_000, 1, tx, None, 9_000_000)
    rows = [log(1, "0xa", "0x" + "1" * 64), log(2, "0xa", "0x" + "1" * 64), log(1, "0xa", "0x" + "2" * 64), log(3, None, "0x"), log(4, None, "0x"), log(4, None, "0x")]
    logs = spark.createDataFrame(rows, RAW_LOG)
    for _ in range(2):
        ingest.ingest(logs, [spec], str(tmp_path))
    assert ingest.rejected(spark, str(tmp_path)).count() == len(rows)


def test_text_with_a_letter_is_not_cast(spark):
    texts = ["n0x12", "12", " -7 ", "+3", "1e3", "0x1F", "", "2147483648", None, "4.0", "٣"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(relational_queries.whole_number(F.col("t")).alias("n"), F.col("t").try_cast("int").alias("want")).collect()
    assert [r["n"] for r in got] == [r["want"] for r in got]
    assert [r["n"] for r in got][:5] == [None, 12, -7, 3, None]
