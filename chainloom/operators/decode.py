"""Raw logs -> decoded event rows, as one narrow job without a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from chainloom.functions import abi, nested
from chainloom.sources.schemas import META
from chainloom.sources.specs import EventSpec

KEEP = ("chain", "address", *META)


def select_logs(logs: DataFrame, spec: EventSpec) -> DataFrame:
    """The logs of one spec, by literals that reach the scan."""
    return logs.filter(
        (F.col("topic0") == spec.topic0)
        & (F.col("address") == spec.address.lower())
        & (F.col("chain") == spec.chain)
        & (F.col("block_number") >= spec.start_block)
    )


def decode_events(logs: DataFrame, spec: EventSpec, keep: tuple[str, ...] = KEEP) -> DataFrame:
    """Decode logs that carry ``spec``'s event (any number of contracts).

    A few selects, each cheap in code size: make the data one byte a character, cut the head words, find the tails of
    dynamic fields, turn words into typed values.  Fields beyond the stored columns
    are dropped and missing ones omitted, by position.
    """
    fields = list(zip(spec.fields, spec.column_names))
    # Of an indexed field of several words there is only a hash.
    deep = {c for f, c in fields if not f.indexed and nested.is_nested(f.kind)}
    kinds = [(f.kind, f.indexed, 1 if f.indexed else nested.layout(f.kind).words) for f in spec.fields]
    words, heads = abi.field_words(kinds), [index for _, index in abi.head_indexes(kinds)]
    firsts = [f"({head}) * 32" if c in deep else w for w, head, (_, c) in zip(words, heads, fields)]
    tails = [c for f, c in fields if abi.is_dynamic(f.kind) and not f.indexed and c not in deep]
    carried = ["data"] if tails or deep else []
    out = logs.withColumn("data", F.expr(abi.one_byte("data"))).select(*keep, *carried, *[F.expr(w).alias(c) for w, (_, c) in zip(firsts, fields)])
    if tails:
        out = out.withColumns({f"__{c}_at": F.expr(abi.tail_start(f"`{c}`")) for c in tails})
        out = out.withColumns({f"__{c}_n": F.expr(abi.tail_length(f"__{c}_at")) for c in tails})

    def value(kind: str, c: str) -> str:
        if c in deep:
            return nested.value(kind, f"`{c}`")
        if c not in tails:
            word = f"`{c}`"
            return abi.whole_word(word) if abi.is_dynamic(kind) or nested.is_nested(kind) else abi.static_value(word, kind)
        start, size = f"__{c}_at", f"__{c}_n"
        if kind.endswith("[]"):
            return abi.array_values(start, size, kind[:-2])
        content = abi.dynamic_hex(start, size)
        return abi.utf8(content) if kind == "string" else abi.whole_word(content)

    return out.select(*keep, *[F.expr(value(f.kind, c)).alias(c) for f, c in fields])


def event_table(logs: DataFrame, spec: EventSpec) -> DataFrame:
    """Select and decode one spec."""
    return decode_events(select_logs(logs, spec), spec)


