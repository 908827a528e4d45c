"""The position index against plain answers, what it prunes, and appends that fail half way."""

import random

import pytest
from pyspark.sql import functions as F

from chainloom.operators import positions, topk
from chainloom.operators.windows import ORDER

SCHEMA = "chain string, pool string, block_timestamp bigint, block_number bigint, log_index int, transaction_hash string, v int"
REQUESTS = "request_id int, pool string, start bigint, end bigint, lim int"


def event_rows(seed, n=1500, hours=400):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        pool = "hot" if rng.random() < 0.4 else f"p{rng.randint(0, 60)}"
        at = None if rng.random() < 0.02 else rng.randint(-20, hours) * 3600 + rng.randint(0, 3)
        rows.append(("c", pool, at, i // 5, i % 5, f"t{i}", rng.randint(0, 9)))
    return rows


def request_rows(seed, n=120, hours=400):
    rng = random.Random(seed)
    at = lambda: None if rng.random() < 0.4 else rng.choice([rng.randint(-30, hours + 30) * 3600, rng.randint(0, 40) * 12_000, 2**63 - 1])
    return [(i, rng.choice(["hot", f"p{rng.randint(0, 70)}"]), at(), at(), rng.choice([0, 1, 3, 50, 200, 500])) for i in range(n)]


def plain(rows, requests):
    newest = sorted(rows, key=lambda r: (r[2] is not None, -(r[2] or 0), -r[3], -r[4], r[5]))
    out = set()
    for i, pool, start, end, lim in requests:
        hits = [r for r in newest if r[1] == pool and (start is None or (r[2] is not None and r[2] >= start)) and (end is None or (r[2] is not None and r[2] <= end))]
        out |= {(i, r[5], n) for n, r in enumerate(hits[: min(lim, topk.MAX_LIMIT)], 1)}
    return out


def ask(spark, root, schema, requests):
    df = spark.createDataFrame(requests, REQUESTS)
    return positions.answer(spark, root, schema, df, "pool", ["transaction_hash"])


@pytest.mark.parametrize("seed", [1, 2])
def test_answers_equal_plain_ones_after_late_rows_and_replays(spark, tmp_path, seed):
    rows, requests, root = event_rows(seed), request_rows(seed), str(tmp_path)
    df = spark.createDataFrame(rows, SCHEMA)
    part = F.pmod(F.xxhash64("transaction_hash"), F.lit(3))
    for batch in (df.where(part < 2), df.where(part > 0), df.where("false"), df.where(part > 0).unionAll(df.where(part == 2))):
        positions.append(batch, root, "pool")
    assert spark.read.parquet(f"{root}/rows").count() == len(rows)
    counts = {(r.pool, r.slice): r.n for r in positions.index(spark, root, "pool").collect()}
    want = {(r["pool"], r["slice"]): r["n"] for r in positions.counted(df, "pool").collect()}
    assert counts == want
    got = ask(spark, root, df.schema, requests).collect()
    assert len(got) == len(set(got)) and {(r["request_id"], r["transaction_hash"], r["rank"]) for r in got} == plain(rows, requests)


def test_only_touched_slices_are_read(spark, tmp_path):
    rows, root = event_rows(5), str(tmp_path)
    df = spark.createDataFrame(rows, SCHEMA)
    positions.append(df, root, "pool")
    requests = topk.bounded_requests(spark.createDataFrame([(1, "hot", None, 900_000, 7), (2, "p3", None, None, 2), (3, "hot", None, 100, 0)], REQUESTS))
    counts = positions.index(spark, root, "pool")
    touched = positions.touched_slices(counts, requests, "pool").cache()
    n = {(r.pool, r.slice): r.n for r in counts.collect()}
    found = sorted((r.pool, r.slice) for r in touched.collect())
    ends = {"hot": 900_000 // 12_000, "p3": topk.FOREVER}
    for pool, lim in (("hot", 7), ("p3", 2)):
        # The end's slice, and older ones until they hold the limit.
        older, took = sorted((s for p, s in n if p == pool and s <= ends[pool]), reverse=True), 0
        expected = []
        for s in older:
            if took >= lim:
                break
            expected.append(s)
            took += n[pool, s] if s < ends[pool] else 0
        assert [s for p, s in found if p == pool] == sorted(expected)
    read = positions.pruned(spark.read.schema(positions.rows_schema(df.schema)).parquet(f"{root}/rows"), touched, "pool")
    assert read.count() == sum(n[key] for key in found) < len(rows) / 10
    text = read._jdf.queryExecution().executedPlan().toString()
    assert "entity_bucket" in text.split("PartitionFilters")[1].split("]")[0]
    assert "In(pool" in text and "GreaterThanOrEqual(block_timestamp" in text


def test_an_append_that_fails_before_counting_is_mended_by_its_replay(spark, tmp_path, monkeypatch):
    rows, root = event_rows(9, 200), str(tmp_path)
    df = spark.createDataFrame(rows, SCHEMA)
    positions.append(df.where("block_number < 10"), root, "pool")
    with monkeypatch.context() as m:
        m.setattr(positions, "counted", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            positions.append(df.where("block_number >= 10"), root, "pool")
    positions.append(df.where("block_number >= 10"), root, "pool")
    assert {(r.pool, r.slice, r.n) for r in positions.index(spark, root, "pool").collect()} == {tuple(r) for r in positions.counted(df, "pool").collect()}
    requests = request_rows(9, 40)
    got = ask(spark, root, df.schema, requests).collect()
    assert {(r["request_id"], r["transaction_hash"], r["rank"]) for r in got} == plain(rows, requests)


def test_nothing_stored_and_nothing_asked(spark, tmp_path):
    schema = spark.createDataFrame([], SCHEMA).schema
    assert ask(spark, f"{tmp_path}/none", schema, [(1, "p", None, None, 5)]).collect() == []
    positions.append(spark.createDataFrame(event_rows(1, 20), SCHEMA), str(tmp_path), "pool")
    assert ask(spark, str(tmp_path), schema, []).collect() == []


def test_many_requests_on_one_entity_do_not_multiply(spark, tmp_path):
    """The plan has no row for each pair of request and slice."""
    events = spark.range(3000).selectExpr("'c' AS chain", "'p' AS pool", "id * 4000 AS block_timestamp", "id AS block_number", "0 AS log_index", "cast(id AS string) AS transaction_hash", "1 AS v")
    positions.append(events, str(tmp_path), "pool")
    requests = spark.range(900).selectExpr("cast(id AS int) AS request_id", "'p' AS pool", "cast(null AS bigint) AS start", "id * 4000 AS end", "5 AS lim")
    got = positions.answer(spark, str(tmp_path), events.schema, requests, "pool", [*ORDER])
    assert got.count() == sum(min(5, e + 1) for e in range(900))
    text = positions.touched_slices(positions.index(spark, str(tmp_path), "pool"), topk.bounded_requests(requests), "pool")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in text
