"""Coverage, quarantine, writes of many tables, and supervised streams."""

import dataclasses
import random

import pytest
from pyspark.sql import functions as F

from chainloom.operators import coverage, storage
from chainloom.plans.streaming_queries import WRONG_A
from chainloom.sources import feed, logs as log_files
from chainloom.sources.schemas import RAW_LOG
from chainloom.streaming import ingest, quarantine, supervise

RANGES = "key string, from_block bigint, to_block bigint"


def log(n, block, tx="0xa", index=0, spec=feed.TRANSFERS_A, data=None):
    topics = [spec.topic0, "0x" + f"{n:064x}", "0x" + f"{n + 1:064x}"]
    return (spec.chain, spec.address.lower(), topics, spec.topic0, data or "0x" + f"{n:064x}", block, 1_000 + n, tx, index, None if block is None else block // 100_000)


def logs_of(spark, rows):
    return spark.createDataFrame(rows, RAW_LOG)


# --- intervals ----------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(4))
def test_interval_sets_equal_sets_of_blocks(spark, seed):
    rng = random.Random(seed)
    pick = lambda n: [(rng.choice("ab"), a := rng.randint(0, 60), a + rng.randint(-2, 9)) for _ in range(n)]
    left, right = pick(12), pick(8) + pick(1) * 3
    blocks = lambda rows: {(k, b) for k, lo, hi in rows for b in range(lo, hi + 1)}
    a, b = (spark.createDataFrame(rows, RANGES) for rows in (left, right))

    def check(got, want):
        found = [tuple(r) for r in got.collect()]
        assert blocks(found) == want and sum(hi - lo + 1 for _, lo, hi in found) == len(want)
        assert all((k, lo - 1) not in want and (k, hi + 1) not in want for k, lo, hi in found)  # maximal

    check(coverage.merged(a, ["key"]), blocks(left))
    check(coverage.difference(a, b, ["key"]), blocks(left) - blocks(right))
    assert coverage.difference(a.where("false"), b, ["key"]).count() == 0


def test_rows_within_ranges_cross_buckets(spark):
    rows = spark.createDataFrame([("s", b) for b in (0, 99_999, 100_000, 250_000, 300_001, None)] + [("t", 5)], "spec string, block_number bigint")
    ranges = spark.createDataFrame([("s", 99_999, 300_000), ("s", 0, 0), ("t", 6, 9)], "spec string, from_block bigint, to_block bigint")
    got = sorted((r[1] is None, r[1] or 0) for r in coverage.within(rows, ranges).collect())
    assert got == [(False, 0), (False, 99_999), (False, 100_000), (False, 250_000), (True, 0)]


def test_a_range_landed_late_is_ingested_and_a_failed_ingest_repeats(spark, tmp_path, monkeypatch):
    path, root = f"{tmp_path}/landed", f"{tmp_path}/root"
    specs = [feed.TRANSFERS_A, dataclasses.replace(feed.TRANSFERS_B, start_block=150)]
    rows = {lo: [log(lo + i, lo + i * 10, f"0x{lo}", i, feed.TRANSFERS_A if i % 2 else feed.TRANSFERS_B) for i in range(10)] for lo in (0, 100, 200)}
    land = lambda lo: coverage.land_chunk(logs_of(spark, rows[lo]), path, feed.MAINNET, lo, lo + 99)
    pending = lambda: sorted(map(tuple, coverage.pending(spark, path, root, specs).collect()))
    land(200)
    ingest.ingest_missing(spark, path, specs, root)
    assert pending() == []
    land(0)
    coverage.land_chunk(logs_of(spark, []), path, feed.MAINNET, 300, 399)  # nothing happened there
    assert pending() == [("transfers_a", 0, 99), ("transfers_a", 300, 399), ("transfers_b", 300, 399)]
    with monkeypatch.context() as m:
        m.setattr(coverage, "record", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            ingest.ingest_missing(spark, path, specs, root)
    ingest.ingest_missing(spark, path, specs, root)
    land(100)
    ingest.ingest_missing(spark, path, specs, root)
    assert pending() == [] and ingest.ingest_missing(spark, path, specs, root).count() == 0
    blocks = lambda spec: sorted(r.block_number for r in ingest.stored(spark, root, spec).collect())
    assert blocks(specs[0]) == [lo + i * 10 for lo in (0, 100, 200) for i in range(1, 10, 2)]
    assert blocks(specs[1]) == [160, 180] + [200 + i * 10 for i in range(0, 10, 2)]
    assert sorted(map(tuple, coverage.covered_ranges(spark, root).collect())) == [("transfers_a", 0, 399), ("transfers_b", 150, 399)]


# --- quarantine ---------------------------------------------------------------------------


def test_no_two_rejects_merge(spark, tmp_path):
    """Equal logs without a key that landed twice are two, and a repeated batch adds none."""
    path, root = f"{tmp_path}/landed", f"{tmp_path}/root"
    same = log(4, 7, tx=None, index=None)
    log_files.land_logs(logs_of(spark, [same, same]), path)
    log_files.land_logs(logs_of(spark, [same]), path)
    for _ in range(2):
        ingest.ingest(log_files.scan_logs(spark, path), [feed.TRANSFERS_A], root)
    rejects = quarantine.open_rejects(spark, root).collect()
    assert len(rejects) == 3 and len({r.log_id for r in rejects}) == 3
    assert {(tuple(r.topics), r.data, r.block_number) for r in rejects} == {(tuple(same[2]), same[4], 7)}


def test_only_rejects_are_hashed(spark, tmp_path):
    routed = ingest.routed_logs(logs_of(spark, [log(1, 5)]), [feed.TRANSFERS_A])
    text = routed._jdf.queryExecution().optimizedPlan().toString()
    assert "sha2" not in text and "to_json" not in text


def test_replay_stores_once_and_settles(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    rows = [log(i, i, f"0x{i}") for i in range(6)] + [log(7, 7, None, None)]
    ingest.ingest(logs_of(spark, rows), [WRONG_A], root)
    opened = lambda: sorted(r.reject_reason for r in ingest.rejected(spark, root).collect())
    assert opened() == ["Log missing transaction hash"] + ["Undecodable value for wad"] * 6
    ingest.replay_rejects(spark, root, [WRONG_A])  # still wrong
    assert len(opened()) == 7
    with monkeypatch.context() as m:
        m.setattr(quarantine, "settle", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            ingest.replay_rejects(spark, root, [feed.TRANSFERS_A])
    for _ in range(2):
        ingest.replay_rejects(spark, root, [feed.TRANSFERS_A])
        assert opened() == ["Log missing transaction hash"]
        assert sorted(r.block_number for r in ingest.stored(spark, root, feed.TRANSFERS_A).collect()) == list(range(6))
    assert ingest.rejected(spark, f"{root}/none").count() == 0


# --- many tables ---------------------------------------------------------------------------


def many_specs(n):
    kinds = ["uint256", "bool", "uint32"]
    return [
        dataclasses.replace(feed.TRANSFERS_A, name=f"t{i}", address="0x" + f"{i:040x}", event=f"E{i % 15}",
                            fields=(feed.Field("who", "address", True), feed.Field("v", kinds[i % 3]), feed.Field(f"only{i % 5}", "uint64")))
        for i in range(n)
    ]


def test_jobs_do_not_grow_with_tables(spark, tmp_path):
    def jobs(n):
        specs = many_specs(n)
        rows = [(s.chain, s.address, [s.topic0, "0x" + f"{i:064x}"], s.topic0, "0x" + f"{1:064x}" + f"{i:064x}", i, 5, f"0x{i}", 0, 0) for i, s in enumerate(specs * 2)]
        logs = logs_of(spark, rows)
        spark.sparkContext.setJobGroup(f"tables-{n}", "ingest")
        ingest.ingest(logs, specs, f"{tmp_path}/{n}")
        spark.sparkContext.setJobGroup("rest", "rest")
        for i, s in enumerate(specs):
            got = sorted((r.who[-1], r[f"only{i % 5}"]) for r in ingest.stored(spark, f"{tmp_path}/{n}", s).collect())
            assert got == sorted((f"{k:x}"[-1], k) for k in (i, i + n))
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"tables-{n}"))

    assert jobs(60) <= jobs(15) + 3  # of as many layouts; adaptive execution varies by a job or two


def test_tables_share_files_unless_types_contradict(spark):
    kinds = lambda ddl: spark.createDataFrame([], ddl).schema
    groups = storage.wide_groups([kinds("x int, y string"), kinds("x string"), kinds("y string, z int"), kinds("x int")])
    assert groups == [[0, 2, 3], [1]]
    assert storage.wide_groups([kinds("x int"), kinds("y int")], columns=1) == [[0], [1]]


# --- supervised streams -----------------------------------------------------------------------


def test_a_poisoned_chain_is_restarted_while_the_other_goes_on(spark, tmp_path):
    path, root = f"{tmp_path}/landed", f"{tmp_path}/root"
    log_files.land_logs(feed.transfer_logs(spark, "/root/testdata/sf0.001").limit(200).unionAll(feed.fee_logs(spark, "/root/testdata/sf0.001").limit(150)), path)
    specs = [feed.TRANSFERS_A, feed.TRANSFERS_B, feed.FEE_UPDATES]
    left = {feed.SONIC: 2}

    def poisoned(name, rows):
        if name == "fee_updates" and left[feed.SONIC]:
            left[feed.SONIC] -= 1
            raise ValueError("no more disk")

    starts = {c: (lambda c=c: ingest.start(spark, path, specs, f"{root}/{c}", follow=False, chain=c, after=poisoned)) for c in (feed.MAINNET, feed.SONIC)}
    ended = supervise.supervise(spark, starts, give_up=5, first_wait=0.1)
    assert all(w.done for w in ended.values()) and len(ended[feed.SONIC].errors) == 2 and not ended[feed.MAINNET].errors
    count = lambda s: ingest.stored(spark, f"{root}/{s.chain}", s).count()
    assert count(feed.TRANSFERS_A) + count(feed.TRANSFERS_B) == 200 and count(feed.FEE_UPDATES) == 150


def test_a_chain_that_always_fails_is_given_up(spark, tmp_path):
    def broken():
        raise OSError("unreachable")

    started = []

    def fine():
        started.append(1)
        return spark.readStream.format("rate").load().writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()

    ended = supervise.supervise(spark, {"bad": broken, "good": fine}, give_up=3, first_wait=0.01)
    assert len(ended["bad"].errors) == 3 and ended["good"].done and not ended["good"].errors and len(started) == 1


def test_a_batch_is_decoded_once(spark, tmp_path, monkeypatch):
    """Rejects and stored rows come from one decoding, which is kept until the batch is done."""
    layouts, kept, decode, append = [], [], ingest.decoded_layouts, storage.append_tables

    def decoded(*args):
        layouts[:] = decode(*args)
        return layouts

    def appended(frames, *args, **options):
        kept[:] = [rows.storageLevel.useMemory for rows in layouts]
        append(frames, *args, **options)

    monkeypatch.setattr(ingest, "decoded_layouts", decoded)
    monkeypatch.setattr(storage, "append_tables", appended)
    rows = [log(1, 5), log(2, 6, "0xb", 1, feed.TRANSFERS_B), log(3, 7, "0xc", 2, data="0x12")]
    ingest.ingest(logs_of(spark, rows), [feed.TRANSFERS_A, feed.TRANSFERS_B], str(tmp_path))
    assert kept == [True, True]
    assert not any(rows.storageLevel.useMemory for rows in layouts)
    assert [ingest.stored(spark, str(tmp_path), s).count() for s in (feed.TRANSFERS_A, feed.TRANSFERS_B)] == [1, 1]
    assert [(r["topics"], r["data"]) for r in quarantine.open_rejects(spark, str(tmp_path)).collect()] == [(rows[2][2], "0x12")]
