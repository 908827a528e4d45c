"""Nested ABI values against an encoder and a decoder of whole words."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from chainloom.functions import nested
from chainloom.operators import decode
from chainloom.sources.schemas import RAW_LOG
from chainloom.sources.specs import EventField as Field, EventSpec

LEAVES = ["uint16", "uint64", "int32", "bool", "address", "bytes4", "string", "bytes"]


def random_type(rng, depth):
    roll = rng.random()
    if depth == 0 or roll < 0.3:
        return rng.choice(LEAVES)
    inner = random_type(rng, depth - 1)
    if roll < 0.5:
        return inner + "[]"
    if roll < 0.7:
        return f"{inner}[{rng.randint(1, 3)}]"
    return f"({','.join([inner, *(random_type(rng, depth - 1) for _ in range(rng.randint(0, 2)))])})"


def random_value(rng, tree):
    if tree.leaf:
        return {
            "uint16": lambda: rng.randint(0, 2**16 - 1), "uint64": lambda: rng.randint(0, 2**60), "int32": lambda: rng.randint(-(2**31), 2**31 - 1),
            "bool": lambda: rng.random() < 0.5, "address": lambda: "0x" + f"{rng.getrandbits(160):040x}", "bytes4": lambda: "0x" + f"{rng.getrandbits(32):08x}",
            "string": lambda: "".join(rng.choice("aé🙂 ") for _ in range(rng.choice([0, 3, 40]))), "bytes": lambda: "0x" + "ab" * rng.choice([0, 1, 32, 33]),
        }[tree.leaf]()
    if tree.size is None:
        return {f"c{i}": random_value(rng, p) for i, p in enumerate(tree.parts, 1)}
    return [random_value(rng, tree.parts[0]) for _ in range(rng.choice([0, 1, 3]) if tree.size < 0 else tree.size)]


def word(n):
    return (n % 2**256).to_bytes(32, "big")


def encode(tree, value):
    if tree.leaf in ("string", "bytes"):
        raw = value.encode() if tree.leaf == "string" else bytes.fromhex(value[2:])
        return word(len(raw)) + raw + bytes(-len(raw) % 32)
    if tree.leaf == "bytes4":
        return bytes.fromhex(value[2:]).ljust(32, b"\0")
    if tree.leaf:
        return word(int(value, 16) if tree.leaf == "address" else int(value))
    if tree.size is None:
        return sequence(tree.parts, list(value.values()))
    return (word(len(value)) if tree.size < 0 else b"") + sequence(tree.parts * len(value), value)


def sequence(trees, values):
    heads, tails = [], b""
    size = 32 * sum(t.words for t in trees)
    for t, v in zip(trees, values):
        made = encode(t, v)
        heads.append(word(size + len(tails)) if t.dynamic else made)
        tails += made if t.dynamic else b""
    return b"".join(heads) + tails


class Bad(Exception):
    pass


def read(tree, data, at):
    """The value at a byte place; Bad where the data doesn't hold it."""
    def number(p):
        n = int.from_bytes(cut(p, 32), "big")
        if n > len(data):
            raise Bad
        return n

    def cut(p, n):
        if p + n > len(data):
            raise Bad
        return data[p : p + n]

    def items(trees, area):
        out = []
        for t in trees:
            head = area + 32 * sum(x.words for x in trees[: len(out)])
            out.append(read(t, data, area + number(head) if t.dynamic else head))
        return out

    if tree.leaf in ("string", "bytes"):
        raw = cut(at + 32, number(at))
        try:
            return raw.decode() if tree.leaf == "string" else "0x" + raw.hex()
        except UnicodeDecodeError:
            raise Bad from None
    if tree.leaf:
        w = cut(at, 32)
        n = int.from_bytes(w, "big")
        if tree.leaf == "bool":
            return n != 0
        if tree.leaf == "address":
            return "0x" + w[12:].hex()
        if tree.leaf == "bytes4":
            return "0x" + w[:4].hex()
        bits = int(tree.leaf.lstrip("uint"))
        n = n - 2**256 if tree.leaf[0] == "i" and n >= 2**255 else n
        low, high = (0, 2**bits) if tree.leaf[0] == "u" else (-(2 ** (bits - 1)), 2 ** (bits - 1))
        if not low <= n < high:
            raise Bad
        return n
    if tree.size is None:
        return {f"c{i}": v for i, v in enumerate(items(tree.parts, at), 1)}
    n, area = (number(at), at + 32) if tree.size < 0 else (tree.size, at)
    if area + n * 32 * tree.parts[0].words > len(data):
        raise Bad
    return items(tree.parts * n, area)


def decoded(spark, kind, datas):
    spec = EventSpec("e", "mainnet", "0x1", "E", (Field("before", "uint64"), Field("v", kind), Field("behind", "uint64")))
    rows = [("mainnet", "0x1", [spec.topic0], spec.topic0, "0x" + d.hex(), i, 0, "0x", 0, 0) for i, d in enumerate(datas)]
    # Spread out, so that nothing is folded before it runs.
    df = decode.decode_events(spark.createDataFrame(rows, RAW_LOG).repartition(2), spec, ("block_number",))
    assert df.schema["v"].dataType == spec.schema["v"].dataType
    got = {r.block_number: r for r in df.withColumn("v", F.to_json(F.struct("v"), {"ignoreNullFields": "false"})).collect()}
    return [(got[i].before, json.loads(got[i].v)["v"], got[i].behind) for i in range(len(datas))]


@pytest.mark.parametrize("seed", range(12))
def test_random_values_and_damage(spark, seed):
    rng = random.Random(seed)
    kind = random_type(rng, 3)
    while not nested.is_nested(kind):
        kind = random_type(rng, 3)
    tree = nested.layout(kind)
    fields = nested.Layout(parts=(nested.layout("uint64"), tree, nested.layout("uint64")))
    values = [{"c1": 7, "c2": random_value(rng, tree), "c3": 2**40 + i} for i in range(8)]
    whole = [encode(fields, v) for v in values]
    assert decoded(spark, kind, whole) == [(7, v["c2"], v["c3"]) for v in values]
    damaged = []
    for data in whole:
        cut = bytearray(data[: rng.randint(0, len(data))])
        damaged.append(bytes(cut))
        spoilt = bytearray(data)
        for _ in range(3):
            spoilt[32 * rng.randrange(max(1, len(data) // 32)) + rng.choice([0, 24, 30, 31])] = rng.choice([1, 32, 64, 255])
        damaged.append(bytes(spoilt))
    want = []
    for data in damaged:
        try:
            value = read(nested.Layout(parts=(tree,)), data[:0] + data, 32)["c1"] if not tree.dynamic else read(tree, data, offset(data))
        except Bad:
            value = None
        want.append(value)
    assert [v for _, v, _ in decoded(spark, kind, damaged)] == want


def offset(data):
    if len(data) < 64 or int.from_bytes(data[32:64], "big") > len(data):
        raise Bad
    return int.from_bytes(data[32:64], "big")


def test_hostile_lengths_and_long_values(spark):
    huge = word(1) + word(96) + word(2) + word(2**31) + word(5)
    assert decoded(spark, "uint16[][]", [huge, b"", word(1) + word(2**255) + word(2)])[0][1] is None
    seconds = []
    for n in (2_000, 16_000):
        tree = nested.layout("(uint16,string)[]")
        data = encode(nested.Layout(parts=(nested.layout("uint64"), tree, nested.layout("uint64"))), {"a": 1, "b": [{"c1": i % 9, "c2": "x" * (i % 40)} for i in range(n)], "c": 2})
        start = time.perf_counter()
        assert len(decoded(spark, "(uint16,string)[]", [data])[0][1]) == n
        seconds.append(time.perf_counter() - start)
    assert seconds[1] < 24 * max(seconds[0], 0.5)


def test_indexed_nested_fields_are_hashes(spark):
    spec = EventSpec("e", "m", "0x1", "E", (Field("v", "uint8[2]", True), Field("w", "uint8[2]")))
    row = ("m", "0x1", [spec.topic0, "0x" + "ab" * 32], spec.topic0, "0x" + (word(3) + word(4)).hex(), 1, 0, "0x", 0, 0)
    got = decode.decode_events(spark.createDataFrame([row], RAW_LOG), spec, ()).first()
    assert (got.v, got.w) == ("0x" + "ab" * 32, [3, 4]) and spec.schema["v"].dataType.simpleString() == "string"
