"""Similarity of decoded acoustic fingerprints."""

from __future__ import annotations

import base64

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Differing bits that still match, and the furthest shift.
MAX_BITS = 2
MAX_SHIFT = 120


def alignment_score(left: Column, right: Column) -> Column:
    """Matches at the best shift over the shorter length; 0 where either is null or empty.

    Shifts go from -120 to 119 places. All work is within the row.
    """
    n, m = F.size(left), F.size(right)

    def matches(shift: Column) -> Column:
        begin, end = F.greatest(F.lit(0), -shift), F.least(n, m - shift)
        same = F.filter(F.sequence(begin, end - 1), lambda i: F.bit_count(F.get(left, i).bitwiseXOR(F.get(right, i + shift))) <= MAX_BITS)
        return F.when(begin < end, F.size(same)).otherwise(0)

    best = F.array_max(F.transform(F.sequence(F.lit(-MAX_SHIFT), F.lit(MAX_SHIFT - 1)), matches))
    return F.when((n > 0) & (m > 0), best / F.least(n, m)).otherwise(0.0)


def _bits(data: bytes, width: int):
    """Numbers of ``width`` bits, lowest first."""
    have = value = 0
    for byte in data:
        value |= byte << have
        have += 8
        while have >= width:
            yield value & ((1 << width) - 1)
            value >>= width
            have -= width


def decode_text(text: str) -> list[int]:
    """The numbers of a compressed fingerprint.

    After a byte for the algorithm and three for the count come steps of three
    bits; a step of 0 ends a number, and 7 is raised by five more bits behind all
    steps. Steps lead from one set bit to the next, and each number is held as its
    difference, by exclusive or, from the one before.
    """
    data = base64.urlsafe_b64decode(text + "=" * (-len(text) % 4))
    count, body = int.from_bytes(data[1:4], "big"), data[4:]
    steps, ended = [], 0
    for step in _bits(body, 3):
        if ended == count:
            break
        steps.append(step)
        ended += step == 0
    if ended < count:
        raise ValueError("the fingerprint is cut off")
    more = _bits(body[-(-3 * len(steps) // 8) :], 5)
    out: list[int] = []
    place = value = 0
    for step in steps:
        if step == 0:
            out.append(value ^ (out[-1] if out else 0))
            place = value = 0
        else:
            place += step if step < 7 else 7 + next(more)
            value |= 1 << (place - 1)
    return [x - (1 << 32) if x >> 31 else x for x in out]


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def decode(text: pd.Series) -> pd.Series:
    """Numbers of compressed fingerprints; empty, and so like nothing, where one cannot be read."""

    def one(x: str | None) -> list[int]:
        try:
            return decode_text(x) if x else []
        except (ValueError, StopIteration, IndexError):
            return []

    return text.map(one)


def with_similarity(pairs: DataFrame, left: str, right: str, name: str = "sound") -> DataFrame:
    """``pairs`` with the similarity, 0 to 1, of two columns of compressed fingerprints. These are decoded first, as a lambda cannot hold Python."""
    decoded = pairs.withColumns({"_left": decode(left), "_right": decode(right)})
    return decoded.withColumn(name, alignment_score(F.col("_left"), F.col("_right"))).drop("_left", "_right")
