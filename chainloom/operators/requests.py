"""Request parameters: checked, defaulted and typed as columns of a requests table.

A requests table has ``request_id``, ``path`` and ``query``: two maps of strings.
Only declared parameters are ever read, so anything else in a request is ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F

from chainloom.operators.topk import MAX_LIMIT

REQUIRED = object()
MAX_STRING_BYTES = 1000


@dataclass(frozen=True)
class Param:
    """``kind`` is u32, u64, i32, i64, bool or String, or Option<...> of one.
    A query parameter without a default is required."""

    name: str
    kind: str
    path: bool = False
    default: object = REQUIRED

    @property
    def base(self) -> str:
        return self.kind.removeprefix("Option<").removesuffix(">") if self.optional else self.kind

    @property
    def optional(self) -> bool:
        return self.kind.startswith("Option<")

    @property
    def raw(self) -> Column:
        return F.col("path" if self.path else "query")[self.name]


# Bound types.
BOUND_TYPES = {
    "u32": "decimal(20,0)",
    "u64": "decimal(20,0)",
    "i32": "bigint",
    "i64": "bigint",
    "bool": "boolean",
}


def _unsigned(value: Column, largest: int) -> Column:
    """Digits with an optional plus sign, up to ``largest``.  Leading zeros are allowed,
    so the value and not the digit count decides."""
    digits = F.regexp_extract(value, r"^\+?0*([0-9]+)$", 1)
    fits = F.when(F.length(digits) <= 20, digits.try_cast("decimal(20,0)") <= F.lit(Decimal(largest)))
    return (digits != "") & F.coalesce(fits, F.lit(False))


def _signed(value: Column) -> Column:
    return value.rlike(r"^[+-]?[0-9]+$") & F.regexp_replace(value, r"^\+", "").try_cast("bigint").isNotNull()


# The texts of an answer that refuses a request.
TOO_LONG = "Parameter '{name}' exceeds maximum length"
NOT_UNSIGNED = "Parameter '{name}' must be a positive integer"
NOT_INTEGER = "Parameter '{name}' must be an integer"
NOT_BOOLEAN = "Parameter '{name}' must be true or false"
NOT_ADDRESS = "Parameter '{name}' is not a valid Ethereum address"
BAD_LIMIT = "Invalid limit parameter"
LARGE_LIMIT = "Limit cannot exceed {most}"
NO_PATH = "Missing path parameter: {name}"
NO_QUERY = "Missing required query parameter: {name}"


def _complaint(p: Param, value: Column) -> Column:
    """Error text for a given value, NULL when it is fine."""
    say = lambda text: F.lit(text.format(name=p.name, most=MAX_LIMIT))
    too_long = F.when(F.octet_length(value) > MAX_STRING_BYTES, say(TOO_LONG))
    if p.base in ("u32", "u64"):
        error = F.when(~_unsigned(value, 2**64 - 1), say(NOT_UNSIGNED))
    elif p.base in ("i32", "i64"):
        error = F.when(~_signed(value), say(NOT_INTEGER))
    elif p.base == "bool":
        error = F.when(~value.isin("true", "false"), say(NOT_BOOLEAN))
    elif p.base == "String":
        shaped = value.startswith("0x") & (F.octet_length(value) == 42)
        error = F.coalesce(
            too_long,
            F.when(
                shaped & ~value.rlike("^0x[0-9a-fA-F]{40}$"), say(NOT_ADDRESS)
            ),
        )
    else:
        error = too_long
    if p.name == "limit" and not p.path:
        error = F.coalesce(
            error,
            F.when(~_unsigned(value, 2**32 - 1), say(BAD_LIMIT)),
            F.when(value.try_cast("bigint") > MAX_LIMIT, say(LARGE_LIMIT)),
        )
    return error


def validate_requests(requests: DataFrame, params: list[Param]) -> DataFrame:
    """Add ``error``: the first complaint in declaration order, path parameters first."""
    checks = []
    for p in sorted(params, key=lambda p: not p.path):
        if p.path:
            checks.append(F.when(p.raw.isNull(), F.lit(NO_PATH.format(name=p.name))))
        elif p.default is REQUIRED:
            checks.append(F.when(p.raw.isNull(), F.lit(NO_QUERY.format(name=p.name))))
        checks.append(F.when(p.raw.isNotNull(), _complaint(p, p.raw)))
    return requests.withColumn("error", F.coalesce(*checks))


def _default_text(p: Param) -> str | None:
    if p.default is REQUIRED or p.default is None or p.default == "null":
        return None
    if isinstance(p.default, bool):
        return str(p.default).lower()
    if p.name == "limit":
        return str(min(int(p.default), MAX_LIMIT))
    return str(p.default)


def bound_value(p: Param) -> Column:
    """The parameter's typed value: given, else default.  The text "null" means NULL for
    an optional string."""
    given = p.raw
    if p.optional and p.base not in BOUND_TYPES:
        given = F.when(given != "null", given)
        value = F.when(p.raw.isNotNull(), given).otherwise(F.lit(_default_text(p)))
    else:
        value = F.coalesce(given, F.lit(_default_text(p)))
    value = F.regexp_replace(value, r"^\+", "") if p.base[0] in "ui" else value
    return value.try_cast(BOUND_TYPES.get(p.base, "string"))


def bind_defaults(accepted: DataFrame, params: list[Param]) -> DataFrame:
    """Accepted requests with one typed column per parameter."""
    return accepted.select("request_id", *[bound_value(p).alias(p.name) for p in params])
