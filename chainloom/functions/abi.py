"""ABI words as native expressions, written as SQL text (see ``u256``)."""

from __future__ import annotations

import re

from pyspark.sql import types as T

from chainloom.functions import u256
from chainloom.functions.u256 import cut

WORD = 64  # hex digits


def solidity_bits(kind: str) -> int:
    return int(re.sub(r"\D", "", kind) or 256)


def is_integer(kind: str) -> bool:
    return re.fullmatch(r"u?int\d*", kind) is not None


def is_signed(kind: str) -> bool:
    return kind.startswith("int")


def is_wide(kind: str) -> bool:
    return is_integer(kind) and solidity_bits(kind) > 64


def is_dynamic(kind: str) -> bool:
    return kind in ("string", "bytes") or kind.endswith("[]")


def spark_type(kind: str) -> T.DataType:
    """Declared column type of a Solidity type."""
    if kind.endswith("[]"):
        return T.ArrayType(spark_type(kind[:-2]))
    if kind == "bool":
        return T.BooleanType()
    if not is_integer(kind):
        return T.StringType()
    bits, signed = solidity_bits(kind), is_signed(kind)
    if bits > 64:
        return u256.U256
    if bits <= (16 if signed else 8):
        return T.ShortType()
    if bits <= (32 if signed else 24):
        return T.IntegerType()
    return T.LongType() if signed or bits < 64 else T.DecimalType(20, 0)


# --- where a word lies -----------------------------------------------------------


def one_byte(text: str) -> str:
    """A text with one byte for each character, so that it can be cut by bytes: a character
    that is none of ASCII, and so no digit either, becomes a question mark."""
    return f"if(octet_length({text}) = length({text}), {text}, regexp_replace({text}, '[^\\\\x00-\\\\x7F]', '?'))"


def data_word(index: int | str) -> str:
    """Word ``index`` of the data part, NULL past its end.  The data has one-byte characters."""
    start = index * WORD if isinstance(index, int) else f"({index}) * {WORD}"
    return f"if(octet_length(data) >= {start} + {2 + WORD}, {cut('data', f'{start} + 3', WORD)}, null)"


def head_indexes(kinds: list[tuple[str, bool, int]]) -> list[tuple[str | None, str]]:
    """For every field (type, indexed, head words) of an event, in declared order: its topic if
    it may have one, and the number of its first data word.

    Indexed fields take topics 1, 2, ...; the others take consecutive data words.  An
    indexed field for which the log has no topic left takes a data word as well, which
    moves every later field back by one word.
    """
    spare = "(size(topics) - 1)"  # topics that can hold fields
    found, indexed_before, plain_before = [], 0, 0
    for _, indexed, words in kinds:
        if indexed:
            topic = f"if({spare} > {indexed_before}, {cut(one_byte(f'get(topics, {indexed_before + 1})'), 3, WORD)}, {{}})"
            found.append((topic, f"{plain_before + indexed_before} - {spare}"))
            indexed_before += 1
        else:
            found.append((None, f"{plain_before} + greatest({indexed_before} - {spare}, 0)" if indexed_before else str(plain_before)))
            plain_before += words
    return found


def field_words(kinds: list[tuple[str, bool, int]]) -> list[str]:
    """The head word of every field, see :func:`head_indexes`."""
    words = []
    for topic, index in head_indexes(kinds):
        word = data_word(int(index) if index.isdigit() else index)
        words.append(topic.format(word) if topic else word)
    return words


# --- what a word means -----------------------------------------------------------


def small_uint(word: str, bits: int) -> str:
    """uintN for N <= 64; NULL when the word does not fit."""
    digits = (bits + 3) // 4
    kind = spark_type(f"uint{bits}").simpleString()
    value = f"try_cast(conv({cut(word, WORD + 1 - digits, digits)}, 16, 10) as {kind})"
    return f"if(startswith({word}, '{'0' * (WORD - digits)}'), {value}, null)"


def small_int(word: str, bits: int) -> str:
    """intN for N <= 64, two's complement; NULL when the word does not fit."""
    digits = bits // 4
    fill = WORD - digits
    kind = spark_type(f"int{bits}").simpleString()
    low = f"cast(conv({cut(word, fill + 1, digits)}, 16, 10) as decimal(20,0))"
    negative = f"{cut(word, fill + 1, 1)} >= '8'"
    return f"""case
        when startswith({word}, '{'f' * fill}') and {negative} then cast({low} - {2**bits}BD as {kind})
        when startswith({word}, '{'0' * fill}') and not {negative} then cast({low} as {kind}) end"""


def whole_word(word: str) -> str:
    return f"concat('0x', {word})"


def static_value(word: str, kind: str) -> str:
    if kind == "address":
        return f"concat('0x', lower({cut(word, 25, 40)}))"
    if kind == "bool":
        return f"{word} <> '{'0' * WORD}'"
    if is_wide(kind):
        return u256.from_word(word, is_signed(kind))
    if is_integer(kind):
        bits = solidity_bits(kind)
        return small_int(word, bits) if is_signed(kind) else small_uint(word, bits)
    if re.fullmatch(r"bytes\d+", kind):
        return f"concat('0x', {cut(word, 1, 2 * solidity_bits(kind))})"
    return whole_word(word)


def _position(word: str) -> str:
    """An offset or length word as a number; NULL beyond 2^31, which no log reaches."""
    return (
        f"if(startswith({word}, '{'0' * 56}') and {cut(word, 57, 1)} < '8', "
        f"cast(conv({cut(word, 57, 8)}, 16, 10) as bigint), null)"
    )


def tail_start(head: str) -> str:
    """Hex position (1-based, of the length word) a dynamic field's head word points to."""
    at = _position(head)
    return f"if({at} * 2 + {2 + WORD} <= octet_length(data), cast({at} * 2 + 3 as int), null)"


def tail_length(start: str) -> str:
    return _position(cut("data", start, WORD))


def dynamic_hex(start: str, size: str) -> str:
    """``size`` bytes after the length word at ``start``; NULL when they run past the end."""
    return (
        f"if({start} + {WORD - 1} + ({size}) * 2 <= octet_length(data), "
        f"{cut('data', f'{start} + {WORD}', f'cast(({size}) * 2 as int)')}, null)"
    )


def utf8(hex_digits: str) -> str:
    """Bytes as text; NULL, not an error, when they are no UTF-8."""
    return f"try_validate_utf8(cast(unhex({hex_digits}) as string))"


def array_values(start: str, size: str, kind: str) -> str:
    """T[] of a static T.  The content is made binary once and bound to a name; words are cut
    from that, where a slice costs its own length only."""
    content = f"unhex({dynamic_hex(start, f'{size} * 32')})"
    words = f"transform(sequence(0, cast({size} as int) - 1), i -> lower(hex(substring(b, i * 32 + 1, 32))))"
    values = f"transform(array({content}), b -> transform({words}, w -> {static_value('w', kind)}))[0]"
    empty = f"cast(array() as {T.ArrayType(spark_type(kind)).simpleString()})"
    return f"case when {dynamic_hex(start, f'{size} * 32')} is null then null when {size} > 0 then {values} else {empty} end"
