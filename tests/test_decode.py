"""Decoding of hand-written words, damaged and hostile logs."""

import json
import time
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from chainloom.functions import u256
from chainloom.functions.keccak import topic0
from chainloom.operators import decode
from chainloom.plans.ingest_queries import KNOWN_TOPICS
from chainloom.sources import specs as spec_files
from chainloom.sources.schemas import RAW_LOG
from chainloom.sources.specs import EventField as Field, EventSpec

W = lambda digits: digits.rjust(64, "0")
L = lambda digits: digits.ljust(64, "0")
SIG = "0x" + "11" * 32


def logs(spark, *items):
    rows = [("mainnet", "0x" + "ab" * 20, t, t[0] if t else None, d, 5, 6, "0x01", 0, 0) for t, d in items]
    return spark.createDataFrame(rows, RAW_LOG)


def decoded(spark, fields, *items):
    spec = EventSpec("e", "mainnet", "", "E", tuple(fields))
    return decode.decode_events(logs(spark, *items), spec, ())


def test_topics():
    for signature, topic in KNOWN_TOPICS.items():
        assert topic0(signature) == topic
    assert topic0("") == "0xc5d2460186f7233c927e7db2dcc703c0e500b653ca82273b7bfad8045d85a470"


def test_topic_catalog_on_spark(spark):
    from chainloom.functions.keccak import topic0_catalog

    df = spark.createDataFrame([(s,) for s in KNOWN_TOPICS] * 2, "event_signature string")
    assert {r[0]: r[1] for r in topic0_catalog(df).collect()} == KNOWN_TOPICS


def test_golden_swap(spark):
    """Written by hand: negative amount, wide price, tick -123."""
    fields = [
        Field("sender", "address", True), Field("amount0", "int256"), Field("amount1", "int256"),
        Field("price", "uint160"), Field("tick", "int24"), Field("ok", "bool"), Field("id", "bytes4"),
    ]
    data = "0x" + "f" * 63 + "e" + W("de0b6b3a7640000") + W("1000000000000000000000000") + "f" * 62 + "85" + W("1") + L("deadbeef")
    df = decoded(spark, fields, ([SIG, "0x" + W("AbCdef0123456789abcdef0123456789abcdef01")], data))
    row = u256.to_text(df, "amount0", "amount1", "price").first()
    assert row.asDict() == {
        "sender": "0xabcdef0123456789abcdef0123456789abcdef01", "amount0": "-2", "amount1": "1000000000000000000",
        "price": "79228162514264337593543950336", "tick": -123, "ok": True, "id": "0xdeadbeef",
    }


@pytest.mark.parametrize(
    "kind,word,want",
    [
        ("uint8", W("ff"), 255), ("uint8", W("100"), None), ("uint16", W("ffff"), 65535), ("uint24", W("ffffff"), 2**24 - 1),
        ("uint32", W("ffffffff"), 2**32 - 1), ("uint56", W("f" * 14), 2**56 - 1), ("uint64", W("f" * 16), Decimal(2**64 - 1)),
        ("int8", "f" * 62 + "80", -128), ("int8", W("7f"), 127), ("int8", W("80"), None), ("int16", "f" * 64, -1),
        ("int24", "f" * 58 + "800000", -(2**23)), ("int32", W("7fffffff"), 2**31 - 1), ("int64", "f" * 48 + "8" + "0" * 15, -(2**63)),
        ("int64", W("7" + "f" * 15), 2**63 - 1), ("bool", W("0"), False), ("bool", "8" + "0" * 63, True), ("bytes1", L("7f"), "0x7f"),
    ],
)
def test_small_values(spark, kind, word, want):
    df = decoded(spark, [Field("v", kind)], ([SIG], "0x" + word))
    assert df.first()["v"] == want
    assert df.schema["v"].dataType == spec_files.abi.spark_type(kind)


def test_cursor_by_topic_count(spark):
    """a and c are indexed; with fewer topics they read data and push b and d back."""
    fields = [Field("a", "uint8", True), Field("b", "uint8"), Field("c", "uint8", True), Field("d", "uint8")]
    t = lambda n: "0x" + W(n)
    df = decoded(
        spark, fields,
        ([SIG, t("1"), t("3")], "0x" + W("2") + W("4")),
        ([SIG, t("1")], "0x" + W("2") + W("3") + W("4")),
        ([SIG], "0x" + W("1") + W("2") + W("3") + W("4")),
        ([SIG, t("1"), t("3"), t("9")], "0x" + W("2") + W("4")),
        ([SIG, t("1"), t("3")], "0x" + W("2") + "00"),
    )
    assert [tuple(r) for r in df.collect()] == [(1, 2, 3, 4)] * 4 + [(1, 2, 3, None)]


def dynamic(text: bytes, offset=32, size=None):
    body = text.hex()
    return "0x" + W(format(offset, "x")) + W(format(len(text) if size is None else size, "x")) + body + "0" * (-len(body) % 64)


def test_dynamic_values(spark):
    good = ["", "plain", "é" * 40, "x" * 5000]
    df = decoded(spark, [Field("s", "string")], *[([SIG], dynamic(s.encode())) for s in good])
    assert [r["s"] for r in df.collect()] == good
    df = decoded(spark, [Field("b", "bytes")], ([SIG], dynamic(b"\x00\xff")), ([SIG], dynamic(b"")))
    assert [r["b"] for r in df.collect()] == ["0x00ff", "0x"]


def test_hostile_dynamic_values_are_null(spark):
    huge = "f" * 64
    items = [
        ([SIG], dynamic(b"\xff\xfe")), ([SIG], dynamic(b"abc", offset=64000)), ([SIG], dynamic(b"abc", size=10**6)),
        ([SIG], "0x" + huge + W("3")), ([SIG], "0x" + W("20") + huge), ([SIG], "0x"), ([SIG], "0x" + W("20")),
        ([SIG], "0x" + W("20") + W("7fffffff")),
    ]
    assert [r["s"] for r in decoded(spark, [Field("s", "string")], *items).collect()] == [None] * len(items)
    assert [r["s"] for r in decoded(spark, [Field("s", "uint256[]")], *items[1:]).collect()] == [None] * (len(items) - 1)


def test_arrays(spark):
    array = lambda *words: "0x" + W("20") + W(format(len(words), "x")) + "".join(words)
    df = decoded(spark, [Field("v", "int16[]")], ([SIG], array()), ([SIG], array(W("5"), "f" * 64)))
    assert [r["v"] for r in df.collect()] == [[], [5, -1]]
    df = decoded(spark, [Field("v", "address[]")], ([SIG], array(W("ab" * 20))))
    assert df.first()["v"] == ["0x" + "ab" * 20]
    df = decoded(spark, [Field("v", "string", True)], ([SIG, "0x" + "7" * 64], "0x"))
    assert df.first()["v"] == "0x" + "7" * 64


def test_long_arrays_take_time_in_proportion(spark):
    array = lambda n: "0x" + W("20") + W(format(n, "x")) + "".join(W(format(i % 200, "x")) for i in range(n))

    def seconds(n):
        df = decoded(spark, [Field("v", "uint16[]")], ([SIG], array(n)))
        start = time.perf_counter()
        assert df.first()["v"] == [i % 200 for i in range(n)]
        return time.perf_counter() - start

    seconds(2000)
    short, long = min(seconds(4000) for _ in range(2)), min(seconds(32_000) for _ in range(2))
    assert long < 30 * max(short, 0.2)


@pytest.mark.parametrize("kind", ["tuple", "tuple[]", "(uint8", "uint8)", "(uint8))", "uint8[0]", "", "(,)"])
def test_what_is_no_type_is_refused(kind):
    with pytest.raises(ValueError):
        EventSpec("e", "mainnet", "", "E", (Field("v", kind),))


def test_event_without_parameters(spark):
    spec = EventSpec("p", "mainnet", "0x" + "ab" * 20, "Paused", ())
    assert spec.signature == "Paused()"
    assert decode.decode_events(logs(spark, ([SIG], "0x")), spec, ("block_number",)).first()[0] == 5


def test_abi_catalog_and_spec_file(spark, tmp_path):
    abi = [
        {"type": "constructor", "inputs": []}, {"type": "function", "name": "f", "inputs": [{"name": "a", "type": "bool"}]},
        {"type": "event", "name": "PoolUpdated", "inputs": [{"indexed": True, "name": "pool", "type": "address"}, {"indexed": False, "name": "fee", "type": "uint256"}]},
        {"type": "event", "name": "Closed", "inputs": []},
    ]
    (tmp_path / "abi").mkdir()
    (tmp_path / "abi" / "one.json").write_text(json.dumps(abi, indent=1))
    found = spec_files.abi_event_catalog(spec_files.read_abi_corpus(spark, str(tmp_path / "abi")))
    assert sorted(r["event_signature"] for r in found.collect()) == ["Closed()", "PoolUpdated(address,uint256)"]

    document = {
        "event_name": "PoolUpdated", "event_signature": "PoolUpdated(address,uint256)", "start_block": 19_000_000, "contract_address": "0xABCD",
        "chain": "sonic", "indexed_fields": [
            {"name": "pool", "solidity_type": "address", "rust_type": "String", "indexed": True},
            {"name": "swapFee", "solidity_type": "uint256", "rust_type": "String", "indexed": False}],
        "table_schema": {"table_name": "fees", "columns": [{"name": "id", "type": "BIGSERIAL"}, {"name": "block_number", "type": "BIGINT"},
            {"name": "pool", "type": "VARCHAR(42)"}, {"name": "swap_fee", "type": "NUMERIC(78, 0)"}], "indexes": []}, "description": "fees",
    }
    (tmp_path / "spec").mkdir()
    (tmp_path / "spec" / "a.json").write_text(json.dumps(document, indent=2))
    spec = spec_files.spec_from_row(spec_files.load_specs(spark, str(tmp_path / "spec")).first())
    assert spec.signature == "PoolUpdated(address,uint256)" and spec.address == "0xabcd" and spec.start_block == 19_000_000
    assert spec.column_names == ("pool", "swap_fee") and spec.fields[0].indexed


# Event shapes of public contracts, a contract a line; * marks an indexed input.
EVENTS = """
Approval(address* address* uint256) Transfer(address* address* uint256) Deposit(address* uint256) Withdrawal(address* uint256)
Approval(address* address* uint256) DelegateChanged(address* address* address*) DelegateVotesChanged(address* uint256 uint256) MinterChanged(address address) Transfer(address* address* uint256)
AdminChanged(address address) Upgraded(address)
FeeAmountEnabled(uint24* int24*) OwnerChanged(address* address*) PoolCreated(address* address* uint24* int24 address)
Burn(address* int24* int24* uint128 uint256 uint256) Collect(address* address int24* int24* uint128 uint128) CollectProtocol(address* address* uint128 uint128) Flash(address* address* uint256 uint256 uint256 uint256) IncreaseObservationCardinalityNext(uint16 uint16) Initialize(uint160 int24) Mint(address address* int24* int24* uint128 uint256 uint256) SetFeeProtocol(uint8 uint8 uint8 uint8) Swap(address* address* int256 int256 uint160 uint128 int24)
FeeUpdated(uint256) OwnershipHandoverCanceled(address*) OwnershipHandoverRequested(address*) OwnershipTransferred(address* address*) PoolUpdated(address* uint256)
"""


def test_catalog_of_whole_contracts(spark, tmp_path):
    want = []
    for n, line in enumerate(EVENTS.strip().split("\n")):
        abi = [{"type": "function", "name": "f", "inputs": []}]
        for event in line.split(") "):
            name, _, kinds = event.rstrip(")").partition("(")
            inputs = [{"name": f"a{i}", "type": k.rstrip("*"), "indexed": k.endswith("*")} for i, k in enumerate(kinds.split(" "))]
            abi.append({"type": "event", "name": name, "anonymous": False, "inputs": inputs})
            want.append((f"{name}({','.join(i['type'] for i in inputs)})", [i["indexed"] for i in inputs]))
        (tmp_path / f"{n}.json").write_text(json.dumps(abi))
    pair = [{"name": "x", "type": "uint8"}, {"name": "y", "type": "tuple[2]", "components": [{"name": "z", "type": "bool"}]}]
    (tmp_path / "odd.json").write_text(json.dumps([
        {"type": "event", "name": "Odd", "inputs": [{"name": "p", "type": "tuple[]", "indexed": False, "components": pair}]},
        {"type": "event", "name": "Hidden", "anonymous": True, "inputs": []},
    ]))
    found = spec_files.abi_event_catalog(spec_files.read_abi_corpus(spark, str(tmp_path))).collect()
    got = [(r["event_signature"], [bool(i["indexed"]) for i in r["inputs"]]) for r in found]
    assert len(want) == 28 and sorted(got) == sorted([*want, ("Odd((uint8,(bool)[2])[])", [False])])
    assert all(topic0(s) == t for s, t in KNOWN_TOPICS.items() if s in dict(want))


def test_data_is_cut_by_bytes(spark):
    """A substring of a text walks over all characters before it, which made each word cost more
    than the one before."""
    spec = EventSpec("t", "mainnet", "0x" + "1" * 40, "T", (Field("a", "uint256"), Field("b", "int24"), Field("c", "address")))
    word = lambda n: format(n, "064x")
    df = decode.decode_events(logs(spark, ([SIG], "0x" + word(5) + word(7) + word(9)), ([SIG], "0x" + word(5)[:-2] + "é0" + word(7) + word(9))), spec, ())
    assert "substring(data" not in df._jdf.queryExecution().optimizedPlan().toString()
    # A character of two bytes, which is no digit, spoils its own word only.
    assert [(r["b"], r["c"]) for r in df.collect()] == [(7, "0x" + format(9, "040x"))] * 2
