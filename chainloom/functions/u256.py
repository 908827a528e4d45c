"""Exact 256-bit integers as native Spark columns.

Spark decimals stop at 38 digits, so a 256-bit number is kept as five bigint
limbs of its binary form: ``w0`` to ``w3`` hold 60 bits each and ``w4`` the top
16, sign included.  Decoding a hex word is then only slicing.  The form is
canonical and structs compare field by field, so equality, ordering, MIN and MAX
need nothing extra, for signed values too.  SUM is a set of plain bigint sums and
one carry.  Decimal text is made only at the result edge.

The functions take and return SQL expression text (for ``expr`` and
``selectExpr``): native expressions, no UDF, and one parse instead of hundreds of
driver calls per expression.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

LIMBS = ("w4", "w3", "w2", "w1", "w0")
BITS = 60
MASK = 2**BITS - 1

U256 = T.StructType([T.StructField(n, T.LongType()) for n in LIMBS])


def limbs(*parts: str) -> str:
    """Five bigint expressions, most significant first, as one U256."""
    return "named_struct(" + ", ".join(f"'{n}', {p}" for n, p in zip(LIMBS, parts)) + ")"


def literal(n: int) -> str:
    """A Python integer as a U256 literal, for comparisons."""
    return limbs(f"{n >> 4 * BITS}L", *[f"{n >> i * BITS & MASK}L" for i in (3, 2, 1, 0)])


# --- hex word -> U256 ----------------------------------------------------------


def cut(text: str, start: int | str, count: int | str) -> str:
    """A piece of a text of hex digits, cut by bytes: it costs its own length, where a substring
    of text walks over all characters before it."""
    return f"cast(substring(cast({text} as binary), {start}, {count}) as string)"


def _digits(word: str, start: int, count: int) -> str:
    """At most 15 hex digits of a word as a bigint (conv overflows past 16 under ANSI)."""
    return f"cast(conv({cut(word, start, count)}, 16, 10) as bigint)"


def from_word(word: str, signed: bool) -> str:
    """64 lower-case hex digits -> U256.  Values of up to 120 bits, nearly all that
    occur, skip the upper limbs."""
    low = (_digits(word, 35, 15), _digits(word, 50, 15))
    top = _digits(word, 1, 4)
    negative = ""
    if signed:
        top = f"if({word} >= '8', {top} - 65536L, {top})"
        negative = f"when startswith({word}, '{'f' * 34}') then {limbs('-1L', f'{MASK}L', f'{MASK}L', *low)}"
    return f"""case
        when startswith({word}, '{'0' * 49}') then {limbs('0L', '0L', '0L', '0L', low[1])}
        when startswith({word}, '{'0' * 34}') then {limbs('0L', '0L', '0L', *low)}
        {negative}
        when {word} is not null then {limbs(top, _digits(word, 5, 15), _digits(word, 20, 15), *low)} end"""


def from_long(n: str) -> str:
    """bigint -> U256."""
    fill = f"shiftright({n}, 63)"
    upper = f"{fill} & {MASK}L"
    return f"if({n} is not null, {limbs(fill, upper, upper, f'shiftright({n}, {BITS}) & {MASK}L', f'{n} & {MASK}L')}, null)"


# --- arithmetic ------------------------------------------------------------------

_PIECE = 20  # a limb is summed as three 20-bit pieces: 2^43 rows fit a bigint
_PIECE_MASK = f"{2**_PIECE - 1}L"


def sum_parts(x: str) -> str:
    """Aggregate expression for SUM; finish with :func:`from_sum_parts`."""
    pieces = []
    for i, limb in enumerate(("w0", "w1", "w2", "w3")):
        at = f"{x}.{limb}"
        pieces += [f"{at} & {_PIECE_MASK}", f"shiftright({at}, {_PIECE}) & {_PIECE_MASK}", f"shiftright({at}, {2 * _PIECE})"]
    pieces.append(f"{x}.w4")
    return "named_struct(" + ", ".join(f"'p{k}', sum({p})" for k, p in enumerate(pieces)) + ")"


def from_sum_parts(total: str) -> str:
    """Carry the piece sums into limbs.  ``w4`` keeps a full bigint, so a sum may
    pass 256 bits."""
    running, out = f"{total}.p0", []
    for i in range(4):
        digits = []
        for j in range(3):
            digits.append(f"shiftleft({running} & {_PIECE_MASK}, {_PIECE * j})")
            running = f"({total}.p{3 * i + j + 1} + shiftright({running}, {_PIECE}))"
        out.append(" + ".join(digits))
    return f"if({total}.p0 is not null, {limbs(running, *reversed(out))}, null)"


def sums(grouped, **columns: str) -> DataFrame:
    """``groupBy(...)`` -> exact totals; keyword = output name, value = U256 column.
    A leading ``count`` of rows comes along as ``n``."""
    out = grouped.agg(
        F.count("*").alias("n"), *[F.expr(sum_parts(c)).alias(name) for name, c in columns.items()]
    )
    return out.withColumns({name: F.expr(from_sum_parts(name)) for name in columns})


def _ripple(parts: list[str]) -> str:
    """Least significant first, each within one borrow or carry of its range."""
    running, out = f"({parts[0]})", []
    for upper in parts[1:]:
        out.append(f"{running} & {MASK}L")
        running = f"({upper} + shiftright({running}, {BITS}))"
    return limbs(running, *reversed(out))


def subtract(a: str, b: str) -> str:
    """a - b, signed; NULL when either is NULL."""
    parts = [f"{a}.{n} - {b}.{n}" for n in reversed(LIMBS)]
    return f"if({a} is not null and {b} is not null, {_ripple(parts)}, null)"


def magnitude(x: str) -> str:
    return f"if({x}.w4 < 0, {_ripple([f'-{x}.{n}' for n in reversed(LIMBS)])}, {x})"


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, which is evaluated once and stays a single
    node even when a filter on the result is pushed below."""
    return f"transform(array({value}), {name} -> {body})[0]"


def average_text(total: str, count: str, scale: int = 0) -> str:
    """``total / count`` as exact decimal text, rounded half away from zero.

    Long division limb by limb; dividends stay below count * 2^60, so counts up to
    10^12 are exact.  ``scale`` fraction digits, at most 18.
    """
    wide = lambda e: f"cast({e} as decimal(38,0))"
    exact = lambda e: f"cast(({e} - {e} % u_n) / u_n as bigint)"
    unit = 10**scale
    fraction = f", '.', lpad(cast(u_f % {unit}L as string), {scale}, '0')" if scale else ""
    whole = _ripple([f"u_s0.q + if(u_f >= {unit}L, 1L, 0L)", *[f"u_s{i}.q" for i in range(1, 5)]])
    body = f"concat(if(u_total.w4 < 0, '-', ''), {text_of(whole)}{fraction})"
    body = _let(f"{exact('u_z')} + if((u_z % u_n) * 2 >= u_n, 1L, 0L)", "u_f", body)
    body = _let(wide(f"u_s0.r * {unit}BD"), "u_z", body)
    for i in range(5):
        above = f"u_s{i + 1}.r * {2**BITS}BD + " if i < 4 else ""
        step = f"named_struct('q', {exact('u_d')}, 'r', cast(u_d % u_n as decimal(20,0)))"
        body = _let(_let(wide(f"{above}cast(u_m.w{i} as decimal(20,0))"), "u_d", step), f"u_s{i}", body)
    body = _let(f"cast({count} as decimal(20,0))", "u_n", _let(magnitude("u_total"), "u_m", body))
    return f"if({total} is not null, {_let(total, 'u_total', body)}, null)"


# --- decimal text, at the result edge ----------------------------------------------

_GROUP = 26  # decimal digits per group: 3 groups hold 78 digits


def _group_total(m: str, k: int) -> str:
    """Decimal group ``k`` before carrying: 30-bit chunks times that group of their weight."""
    terms = []
    for i in range(10):
        weight = 2 ** (30 * i) // 10 ** (_GROUP * k)
        if k < 2:
            weight %= 10**_GROUP
        if not weight:
            continue
        limb = f"{m}.w{i // 2}"
        chunk = f"shiftright({limb}, 30)" if i % 2 else f"({limb} & {2**30 - 1}L)"
        size = max(len(str(weight)), 28)
        terms.append(f"cast(cast({chunk} as decimal({38 - size},0)) * cast({weight}BD as decimal({size},0)) as decimal(38,0))")
    total = terms[0]
    for term in terms[1:]:
        total = f"cast({total} + {term} as decimal(38,0))"
    return total


def narrow_value(x: str) -> str:
    """The value of a U256 that has only ``w1`` and ``w0``, as decimal(38,0)."""
    return f"cast(cast({x}.w1 as decimal(19,0)) * {2**BITS}BD + cast({x}.w0 as decimal(19,0)) as decimal(38,0))"


def narrow_decimal(x: str) -> str:
    """U256 -> decimal(38,0) for values of up to 120 bits unsigned; NULL beyond."""
    return f"if({x}.w4 = 0 and {x}.w3 = 0 and {x}.w2 = 0, {narrow_value(x)}, null)"


_LOW = 18  # decimal digits behind the cut of a value of up to 180 bits


def middle_text(x: str) -> str:
    """Decimal string of a U256 of more than 120 and up to 180 bits.  ``w2`` times 2^120 is split
    at 10^18; both products fit 38 digits, and digit strings are sliced for the carry."""
    upper, lower = divmod(2 ** (2 * BITS), 10**_LOW)
    w2 = f"cast({x}.w2 as decimal(19,0))"
    low = f"lpad(cast(cast({w2} * {lower}BD + {narrow_value(x)} as decimal(38,0)) as string), 38, '0')"
    carry = f"cast(cast(left({low}, {38 - _LOW}) as bigint) as decimal(19,0))"
    return f"concat(cast(cast({w2} * {upper}BD + {carry} as decimal(38,0)) as string), right({low}, {_LOW}))"


def text_of(x: str) -> str:
    """Decimal string of a U256.

    Values of up to 120 bits go through one decimal; wider ones through three decimal
    group totals, whose carries slice digit strings, which is cheaper than dividing
    38-digit decimals.  For a plain column, values of up to 180 bits go through two decimals.
    """
    padded = lambda g: f"lpad(cast({g} as string), 38, '0')"
    over = lambda t: f"cast(left({t}, {38 - _GROUP}) as decimal(38,0))"
    tail = f"ltrim('0', concat(cast(cast({_group_total('v', 2)} + {over('u')} as decimal(38,0)) as string), right(u, {_GROUP}), right(t, {_GROUP})))"
    middle = padded(f"cast({_group_total('v', 1)} + {over('t')} as decimal(38,0))")
    wide = _let(padded(_group_total("v", 0)), "t", _let(middle, "u", tail))
    digits = f"""case when v.w4 = 0 and v.w3 = 0 and v.w2 = 0
        then if(v.w1 = 0, cast(v.w0 as string), cast({narrow_value('v')} as string)) else {wide} end"""
    signed = f"concat(if(x.w4 < 0, '-', ''), {_let(magnitude('x'), 'v', digits)})"
    general = f"if({x} is not null, {_let(x, 'x', signed)}, null)"
    if not re.fullmatch(r"`?\w+`?", x):
        return general
    # A plain column can be named often: most values then need no binding of names.
    return f"""case when {x}.w4 = 0 and {x}.w3 = 0 and {x}.w2 = 0
        then if({x}.w1 = 0, cast({x}.w0 as string), cast({narrow_value(x)} as string))
        when {x}.w4 = -1 and {x}.w3 = {MASK}L and {x}.w2 = {MASK}L
        then if({x}.w1 = {MASK}L, cast({x}.w0 - {2**BITS}L as string), cast(cast({narrow_value(x)} - {2 ** (2 * BITS)}BD as decimal(38,0)) as string))
        when {x}.w4 = 0 and {x}.w3 = 0 then {middle_text(x)}
        else {general} end"""


def to_text(df: DataFrame, *names: str) -> DataFrame:
    """Replace U256 columns by their decimal strings."""
    return df.withColumns({n: F.expr(text_of(f"`{n}`")) for n in names})


def shift_text(text: str, places: int = 18) -> str:
    """Integer text divided by 10^places, exactly: insert the decimal point."""
    digits = f"ltrim('-', {text})"
    padded = f"lpad({digits}, greatest(length({digits}), {places + 1}), '0')"
    return f"concat(if(startswith({text}, '-'), '-', ''), left({padded}, length({padded}) - {places}), '.', right({padded}, {places}))"
