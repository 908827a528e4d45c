"""Keccak-256 of event signatures, written from the public Keccak specification.

Spark has no Keccak function.  This runs over the *distinct* signatures of a
catalogue, never over logs; the result is stored and joined.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

_LANES = 25
_RATE = 136
_M64 = (1 << 64) - 1


def _round_constants() -> list[int]:
    constants, lfsr = [], 1
    for _ in range(24):
        value = 0
        for j in range(7):
            if lfsr & 1:
                value |= 1 << ((1 << j) - 1)
            lfsr = (lfsr << 1) ^ (0x171 if lfsr & 0x80 else 0)
        constants.append(value)
    return constants


def _rho_pi() -> list[tuple[int, int]]:
    """(destination lane, rotation) along the pi cycle that starts at lane 1."""
    steps, x, y = [], 1, 0
    for t in range(24):
        x, y = y, (2 * x + 3 * y) % 5
        steps.append((x + 5 * y, (t + 1) * (t + 2) // 2 % 64))
    return steps


_RC = _round_constants()
_STEPS = _rho_pi()


def _rotl(v: int, n: int) -> int:
    return ((v << n) | (v >> (64 - n))) & _M64


def _permute(a: list[int]) -> None:
    for rc in _RC:
        parity = [a[x] ^ a[x + 5] ^ a[x + 10] ^ a[x + 15] ^ a[x + 20] for x in range(5)]
        for i in range(_LANES):
            a[i] ^= parity[(i + 4) % 5] ^ _rotl(parity[(i + 1) % 5], 1)
        moving = a[1]
        for lane, turn in _STEPS:
            a[lane], moving = _rotl(moving, turn), a[lane]
        for row in range(0, _LANES, 5):
            old = a[row : row + 5]
            for x in range(5):
                a[row + x] = old[x] ^ (~old[(x + 1) % 5] & _M64 & old[(x + 2) % 5])
        a[0] ^= rc


def keccak256(message: bytes) -> bytes:
    padded = bytearray(message) + b"\x01" + b"\x00" * (-(len(message) + 1) % _RATE)
    padded[-1] |= 0x80
    state = [0] * _LANES
    for start in range(0, len(padded), _RATE):
        for i in range(_RATE // 8):
            state[i] ^= int.from_bytes(padded[start + 8 * i : start + 8 * i + 8], "little")
        _permute(state)
    return b"".join(lane.to_bytes(8, "little") for lane in state[:4])


def topic0(signature: str) -> str:
    """The first topic of an event, for one signature known on the driver."""
    return "0x" + keccak256(signature.encode()).hex()


@F.pandas_udf(StringType())
def _topic0_column(signatures: pd.Series) -> pd.Series:
    return signatures.map(lambda s: None if s is None else topic0(s))


def topic0_column(signature: Column) -> Column:
    return _topic0_column(signature)


def topic0_catalog(df: DataFrame, signature: str = "event_signature") -> DataFrame:
    """distinct signature -> topic0."""
    return df.select(signature).distinct().withColumn("topic0", topic0_column(F.col(signature)))
