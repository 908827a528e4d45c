import hashlib
import random
import re
import zlib

import pytest

from chainloom.llm import common, prefix_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth string, weight int"


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    members = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20 * (1 if c >= 0 else -1))
        path = own.get(base, [])[:h] + own[c][h:]
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append((c, len(path) == d))
    out = {}
    for key, of in members.items():
        saved = (len(of) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", key[-1][1])) if key else 0)
        ends = ",".join(str(c) for c, end in sorted(of) if end)
        parent = min(members[key[:-1]])[0] if key else None
        children = sum(1 for other in members if len(other) == len(key) + 1 and other[:-1] == key)
        out[key] = [min(of)[0], len(key), parent, len(of), children, int(not children), saved, hashlib.sha256(ends.encode()).hexdigest()]
    totals = {key: [sum(out[k][i] for k in out if k[: len(key)] == key) for i in (5, 6)] for key in out}
    return sorted([*(row[:5]), *totals[key], row[7]] for key, row in out.items())


def trie(spark, rows, weight=prefix_trie.COMPONENT_WEIGHT):
    common.prepare(spark)
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(3)
    return sorted((list(r) for r in prefix_trie.trie(df, weight).collect()), key=lambda r: r[:2])


def random_rows(seed, n, words=2, turns=6):
    rng = random.Random(seed)
    said = lambda: " ".join(rng.choice("ab") * rng.randint(1, 2) for _ in range(rng.randint(0, words)))
    return [(c, t, rng.choice(["user", "assistant"][: 1 + t % 2]), said()) for c in range(n) for t in range(rng.randint(1, turns))]


def same(got, want):
    assert got == sorted(want, key=lambda r: r[:2])


@pytest.mark.parametrize("seed,weight", [(0, 20_000), (1, 60), (2, 7)])
def test_equals_brute_force(spark, seed, weight):
    rows = random_rows(seed, 70)
    same(trie(spark, rows, weight), brute(rows))


def test_long_chain_and_hot_prefix_need_few_rounds(spark, tmp_path):
    """A conversation with most turns, and many that share its beginning."""
    chain = [(5, t, "user", f"turn {t}") for t in range(120)]
    rows = chain + [(c, t, "user", f"turn {t}") for c in range(100, 130) for t in range(3)] + [(c, 0, "user", "bye") for c in range(200, 220)]
    same(trie(spark, rows, 20), brute(rows))


def test_nulls_ties_and_empty_conversations(spark):
    rows = [
        (None, 0, "user", "lost"), (0, None, None, None), (0, None, "a", "x y"), (0, 1, "user", "p  q\tr"), (0, 1, "user", "p  q\tr"),
        (3, 0, None, ""), (3, 1, "", None), (23, 0, "user", "alone"), (-5, 0, "user", "z"), (-5, 2, "user", "é   w"), (-20, 0, "s", "t"),
        (7, 0, "user:", "b"), (7, 1, "user", "b" * 100_000), (9, 0, "use", "r:b"),
    ]
    rows += [(c, 0, "user", "only") for c in range(40, 60)]  # some lose their only turn, some take another's
    rows = [r for r in rows if r[0] != 40]
    same(trie(spark, rows), brute(rows))


def test_many_ends_at_one_node(spark):
    rows = [(c, 0, "user", "same words") for c in range(0, 5000)]
    want = hashlib.sha256(",".join(str(c) for c in range(5000)).encode()).hexdigest()
    got = trie(spark, rows, 500)
    ended = {r[1]: r for r in got}
    assert ended[1][-1] == want and ended[1][3] == 5000 and ended[0][5:7] == [1, 2 * 4999]


def test_no_conversation(spark):
    assert trie(spark, []) == [] and trie(spark, [(None, 0, "user", "x")]) == []


@pytest.mark.parametrize("seed", range(20))
def test_local_totals(seed):
    rng = random.Random(seed)
    n = rng.randint(1, 60)
    parents = [-1] + [rng.randint(max(0, i - rng.choice([1, 3, 60])), i - 1) for i in range(1, n)]
    values = [(rng.randint(0, 9), rng.randint(0, 9)) for _ in range(n)]
    want = [list(v) for v in values]
    for i in range(n - 1, 0, -1):
        want[parents[i]] = [a + b for a, b in zip(want[parents[i]], want[i])]
    assert prefix_trie.local_totals(parents, values) == want
