"""256-bit columns against Python integers."""

import random
from decimal import ROUND_HALF_UP, Decimal, getcontext

import pytest
from pyspark.sql import functions as F

from chainloom.functions import u256

getcontext().prec = 120
RNG = random.Random(7)
EDGES = [0, 1, 10**26 - 1, 10**26, 2**60 - 1, 2**60, 2**64, 2**120 - 1, 2**120, 2**127, 2**128, 10**52 - 1, 10**52, 2**255 - 1]
UNSIGNED = EDGES + [2**255, 2**256 - 1] + [RNG.getrandbits(RNG.randint(1, 256)) for _ in range(200)]
SIGNED = EDGES + [-v for v in EDGES] + [-(2**255)] + [RNG.choice((1, -1)) * RNG.getrandbits(RNG.randint(1, 255)) for _ in range(200)]


def frame(spark, values, signed):
    df = spark.createDataFrame([(str(v), format(v % 2**256, "064x")) for v in values], "want string, x string")
    return df.withColumn("x", F.expr(u256.from_word("x", signed)))


@pytest.mark.parametrize("values,signed", [(UNSIGNED, False), (SIGNED, True)])
def test_words_to_text(spark, values, signed):
    rows = u256.to_text(frame(spark, values, signed), "x").collect()
    assert [r["x"] for r in rows] == [r["want"] for r in rows]


def test_order_and_equality(spark):
    ordered = frame(spark, SIGNED, True).orderBy("x").collect()
    assert [int(r["want"]) for r in ordered] == sorted(SIGNED)
    for n in (0, -1, 2**120, -(2**255)):
        assert frame(spark, SIGNED, True).filter(F.expr(f"x = {u256.literal(n)}")).count() == SIGNED.count(n)
        assert frame(spark, SIGNED, True).filter(F.expr(f"x < {u256.literal(n)}")).count() == sum(v < n for v in SIGNED)


def test_sum_and_average(spark):
    groups = [RNG.sample(SIGNED, RNG.randint(1, 9)) for _ in range(60)] + [[2**255 - 1] * 40, [-(2**255)] * 40]
    rows = [(k, format(v % 2**256, "064x")) for k, g in enumerate(groups) for v in g]
    df = spark.createDataFrame(rows, "k int, w string").withColumn("x", F.expr(u256.from_word("w", True)))
    totals = u256.sums(df.groupBy("k"), total="x")
    totals = totals.withColumns({"whole": F.expr(u256.average_text("total", "n")), "fine": F.expr(u256.average_text("total", "n", 6))})
    totals = u256.to_text(totals, "total")
    for r in totals.collect():
        exact = Decimal(sum(groups[r["k"]])) / len(groups[r["k"]])
        assert r["total"] == str(sum(groups[r["k"]]))
        sign_lost = lambda s: s.lstrip("-0.") == ""
        for got, unit in ((r["whole"], "1"), (r["fine"], "0.000001")):
            want = str(exact.quantize(Decimal(unit), rounding=ROUND_HALF_UP))
            assert got == want or (sign_lost(got) and sign_lost(want))


def test_sum_of_nothing_is_null(spark):
    df = spark.createDataFrame([(1, None)], "k int, w string").withColumn("x", F.expr(u256.from_word("w", True)))
    assert u256.to_text(u256.sums(df.groupBy("k"), total="x"), "total").first()["total"] is None


def test_subtract_and_shift(spark):
    pairs = [(RNG.choice(SIGNED), RNG.choice(SIGNED)) for _ in range(200)]
    df = spark.createDataFrame([(str(a - b), format(a % 2**256, "064x"), format(b % 2**256, "064x")) for a, b in pairs], "want string, a string, b string")
    df = df.withColumns({c: F.expr(u256.from_word(c, True)) for c in "ab"}).withColumn("d", F.expr(u256.subtract("a", "b")))
    rows = u256.to_text(df, "d").withColumn("shifted", F.expr(u256.shift_text("d"))).collect()
    for r in rows:
        assert r["d"] == r["want"]
        assert Decimal(r["shifted"]) * 10**18 == int(r["want"])
        assert len(r["shifted"].split(".")[1]) == 18


def test_from_long(spark):
    values = [0, 1, -1, 2**63 - 1, -(2**63), 2**60, -(2**60)]
    df = spark.createDataFrame([(v,) for v in values], "n bigint").withColumn("x", F.expr(u256.from_long("n")))
    assert [r["x"] for r in u256.to_text(df, "x").collect()] == [str(v) for v in values]


def test_middle_text_needs_no_wide_totals(spark):
    values = [2**120, 2**120 + 1, 10**37, 10**54, 2**160 - 1, 2**179, 2**180 - 1, 54_000_000 * 2**96] + [RNG.randrange(2**120, 2**180) for _ in range(100)]
    got = frame(spark, values, False).select("want", F.expr(u256.middle_text("x")).alias("x")).collect()
    assert [r["x"] for r in got] == [r["want"] for r in got]
    near = [-1, -25, -(2**59), -(2**60), -(2**60) - 1, -(2**119), 1 - 2**120, -(2**120), -(2**120) - 1]
    got = u256.to_text(frame(spark, near, True), "x").collect()
    assert [r["x"] for r in got] == [r["want"] for r in got]
