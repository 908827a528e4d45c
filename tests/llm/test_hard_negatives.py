import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chainloom.llm import common, hard_negatives

SCHEMA = "vec_id bigint, label int, embedding array<double>, rank int, score string, vector string"


def brute(rows, every):
    """The contract read literally, over all rows."""
    held = [(i, l, [math.floor(256 * x) for x in v]) for i, l, v in rows if None not in (i, l, v) and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for a, label, v in {(i, l, tuple(v)) for i, l, v in held if i % every == 0}:
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, l) for i, l, w in held if i != a and len(w) == len(v))
        for p_score, p, _ in [x for x in scored if x[2] == label][:5]:
            inside = [(s, i) for s, i, l in scored if l != label and 80 * -p_score <= 100 * -s <= 100 * -p_score]
            out |= {(a, p, rank, i, -p_score, -s) for rank, (s, i) in enumerate(inside[:5], 1)}
    return sorted(out)


def mined(spark, rows, every, parts=3):
    common.prepare(spark)
    df = spark.createDataFrame([(*r, 9, "clash", None) for r in rows], SCHEMA).repartition(parts)
    got = hard_negatives.mined(df, F.col("vec_id") % every == 0).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return sorted(set(map(tuple, got.collect())))


def random_rows(seed, n, width, labels):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=width)
    return [(i, int(rng.integers(labels)), (rng.normal(size=width) * 0.1 + centre * rng.choice([0, 0.1])).tolist()) for i in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    rows = random_rows(seed, 400, 24, 3)
    want = brute(rows, 20)
    assert want and mined(spark, rows, 20) == want


def test_small_blocks_and_groups(spark, monkeypatch):
    """Many blocks in a task and several groups of anchors give the same rows."""
    rows = random_rows(7, 300, 17, 4)
    monkeypatch.setattr(hard_negatives, "BLOCK_VALUES", 300)
    monkeypatch.setattr(hard_negatives, "GROUP_VALUES", 200)
    assert mined(spark, rows, 25) == brute(rows, 25)


def test_ties_nulls_and_odd_vectors(spark):
    same = [0.5, 0.25, -0.125]
    rows = [(i, i % 2, same) for i in range(40)]  # all scores tie
    rows += [(40, None, same), (None, 1, same), (41, 1, None), (42, 1, [0.5, None, 0.1]), (43, 1, [math.nan, 0.1, 0.1]), (44, 0, [math.inf, 0.0, 0.0])]
    rows += [(45, 1, []), (50, 0, []), (46, 0, [0.1]), (60, 1, [0.3]), (47, 0, [0.0, 0.0, 0.0]), (70, 1, [-1.0, -1.0, -1.0])]
    rows += [(0, 0, same), (3, 1, same)]  # repeated rows
    rows += [(20, 1, [0.5, 0.5, 0.5])]  # another vector of an anchor's id
    want = brute(rows, 10)
    assert mined(spark, rows, 10) == [r for r in want]
    assert {r[2] for r in want} == {1, 2, 3, 4, 5}


def test_large_components_are_exact(spark):
    rows = [(i, i % 2, [float(2**20 + 3 * i), float(2**21 - i), 1.5]) for i in range(30)]
    want = brute(rows, 10)
    assert want and mined(spark, rows, 10) == want
    huge = [(i, i % 2, [1e30, 1.0]) for i in range(4)]
    assert {r[5] for r in mined(spark, huge, 2)} == {2**63 - 1}


def test_empty_table(spark):
    assert mined(spark, [], 10) == []
    assert mined(spark, [(1, 1, [0.1]), (3, 1, [0.2])], 10) == []


def test_rows_leave_before_all_dimensions_are_read():
    rng = np.random.default_rng(1)
    vectors = np.floor(256 * rng.normal(size=(2000, 64)) * np.linspace(2, 0.01, 64))
    block = hard_negatives.Block(np.arange(2000), np.zeros(2000, int), vectors)
    alive = []
    search = hard_negatives.Nearest()
    scan = block.scan

    def watched(anchor, candidates, keep):
        def counted(lower, upper):
            alive.append(len(lower))
            return keep(lower, upper)
        return scan(anchor, candidates, counted)

    block.scan = watched
    search.read(block, 5, 0, vectors[5])
    assert alive[0] == 1999 and alive[-1] < 300
    exact = sorted(((-int(s), i) for i, s in enumerate(vectors @ vectors[5]) if i != 5))[:5]
    assert list(zip(search.scores, search.ids)) == [(-s, i) for s, i in exact]
