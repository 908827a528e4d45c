"""Nested ABI values (tuples, ``T[n]``, ``T[][]``, ``string[]``) as native expressions.

A type is read once into a tree; every part of it knows how many head words it takes and
whether its content lies in a tail.  From the tree comes one expression over the binary data:
a part's place is the place of what contains it plus a constant or an offset word, bound to
a name by a lambda so that nothing is written twice.  Lengths and offsets are checked against
the data before anything is cut or counted, so the work is linear in the length; depth is
that of the type.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass

from pyspark.sql import types as T

from chainloom.functions import abi

BYTES = 32  # of a word


@dataclass(frozen=True)
class Layout:
    """A type: ``leaf`` for a plain one, else ``parts`` (a tuple, or an array's element) and
    ``size``: None for a tuple, -1 for ``T[]``, n for ``T[n]``."""

    leaf: str = ""
    parts: tuple[Layout, ...] = ()
    size: int | None = None

    @property
    def dynamic(self) -> bool:
        """Whether the value lies in a tail that its head word points to."""
        if self.leaf:
            return self.leaf in ("string", "bytes")
        return self.size == -1 or any(p.dynamic for p in self.parts)

    @property
    def words(self) -> int:
        """Head words."""
        if self.leaf or self.dynamic:
            return 1
        return sum(p.words for p in self.parts) * (1 if self.size is None else self.size)


def layout(kind: str) -> Layout:
    """The tree of a canonical type such as ``(uint8,string[2])[]``."""
    kind = kind.strip()
    array = re.fullmatch(r"(.+)\[(\d*)\]", kind, re.S)
    if array:
        if array[2] == "0":
            raise ValueError(f"type {kind} has no length")
        return Layout(parts=(layout(array[1]),), size=int(array[2] or -1))
    if kind.startswith("("):
        if not kind.endswith(")"):
            raise ValueError(f"type {kind} is not closed")
        depth, parts = 0, [""]
        for c in kind[1:-1]:
            depth += (c == "(") - (c == ")")
            if depth < 0:
                raise ValueError(f"type {kind} is not closed")
            if c == "," and not depth:
                parts.append("")
            else:
                parts[-1] += c
        if depth:
            raise ValueError(f"type {kind} is not closed")
        return Layout(parts=tuple(map(layout, parts)))
    if not re.fullmatch(r"[a-z][a-z0-9]*", kind) or kind.startswith("tuple"):
        raise ValueError(f"type {kind!r} can't be decoded from event data")
    return Layout(leaf=kind)


def is_nested(kind: str) -> bool:
    """Whether a type takes this module: all but plain types and arrays of static plain ones."""
    tree = layout(kind)
    return not tree.leaf and not (tree.size == -1 and tree.parts[0].leaf and not tree.parts[0].dynamic)


def spark_type(tree: Layout) -> T.DataType:
    """Arrays are arrays, tuples are structs with fields c1, c2, …"""
    if tree.leaf:
        return abi.spark_type(tree.leaf)
    if tree.size is not None:
        return T.ArrayType(spark_type(tree.parts[0]))
    return T.StructType([T.StructField(f"c{i}", spark_type(p)) for i, p in enumerate(tree.parts, 1)])


class Writer:
    """Writes expressions over ``b``, the binary data, with names of its own."""

    def __init__(self):
        self.names = (f"n{i}" for i in itertools.count())

    def bound(self, value: str, body) -> str:
        """``body`` of a name that stands for the value; NULL if the value is."""
        name = next(self.names)
        return f"transform(array({value}), {name} -> if({name} is null, null, {body(name)}))[0]"

    def word(self, at: str) -> str:
        return f"if({at} + {BYTES} <= length(b), lower(hex(substring(b, cast({at} + 1 as int), {BYTES}))), null)"

    def number(self, at: str) -> str:
        """A length or offset word; NULL beyond the data."""
        return self.bound(self.word(at), lambda w: f"if(({abi._position(w)}) <= length(b), {abi._position(w)}, null)")

    def value(self, tree: Layout, at: str) -> str:
        """The value whose own encoding begins at byte ``at``.  A value with a part that
        can't be decoded is NULL as a whole."""
        if tree.leaf in ("string", "bytes"):
            return self.bound(self.number(at), lambda n: self.content(tree.leaf, at, n))
        if tree.leaf:
            return self.bound(self.word(at), lambda w: abi.static_value(w, tree.leaf))
        if tree.size == -1:
            return self.bound(self.number(at), lambda n: self.bound(f"{at} + {BYTES}", lambda area: self.elements(tree.parts[0], area, n)))
        if tree.size is not None:
            return self.elements(tree.parts[0], at, str(tree.size))
        parts, offset = [], 0
        for part in tree.parts:
            parts.append(self.part(part, at, f"{at} + {offset}"))
            offset += part.words * BYTES
        made = f"named_struct({', '.join(f"'c{i}', {p}" for i, p in enumerate(parts, 1))})"
        return self.bound(made, lambda s: f"if({' or '.join(f'{s}.c{i} is null' for i in range(1, len(parts) + 1))}, null, {s})")

    def part(self, tree: Layout, area: str, head: str) -> str:
        """A part of a tuple or array that begins at ``area``, by its head."""
        if not tree.dynamic:
            return self.bound(head, lambda at: self.value(tree, at))
        return self.bound(self.number(head), lambda n: self.bound(f"{area} + {n}", lambda at: self.value(tree, at)))

    def elements(self, tree: Layout, area: str, n: str) -> str:
        step, i = tree.words * BYTES, next(self.names)
        values = f"transform(sequence(0, cast({n} as int) - 1), {i} -> {self.part(tree, area, f'{area} + {i} * {step}')})"
        whole = self.bound(values, lambda v: f"if(exists({v}, x -> x is null), null, {v})")
        empty = f"cast(array() as {T.ArrayType(spark_type(tree)).simpleString()})"
        return f"case when {area} + {n} * {step} > length(b) then null when {n} > 0 then {whole} else {empty} end"

    def content(self, kind: str, at: str, n: str) -> str:
        cut = f"substring(b, cast({at} + {BYTES} + 1 as int), cast({n} as int))"
        told = f"try_validate_utf8(cast({cut} as string))" if kind == "string" else f"concat('0x', lower(hex({cut})))"
        return f"if({at} + {BYTES} + {n} <= length(b), {told}, null)"


def value(kind: str, head: str) -> str:
    """The value of a field of the data whose head begins at byte ``head``."""
    tree, writer = layout(kind), Writer()
    body = writer.bound(f"cast({head} as bigint)", lambda at: writer.part(tree, "0L", at))
    return f"transform(array(unhex(substring(data, 3))), b -> {body})[0]"
