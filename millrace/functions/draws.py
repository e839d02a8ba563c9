"""Deterministic scalar functions, all plain column expressions.

A draw is a pure function of (seed, stream, id), so a generated table is the
same under any partitioning, retry or speculative task.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def padded_key(prefix: str, n: Column, width: int) -> Column:
    """``prefix`` and ``n`` zero-padded to ``width``; longer numbers are never cut."""
    return F.format_string(f"{prefix}%0{width}d", n)


def draw(seed: int, stream: str, key: Column, method: str = "md5") -> Column:
    """Uniform bigint in [0, 2^32).

    ``md5`` can be repeated in other SQL engines; ``xxhash64`` is about nine
    times cheaper and meant for bulk generation.
    """
    if method == "md5":
        text = F.concat_ws(":", F.lit(str(seed)), F.lit(stream), key.cast("string"))
        return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")
    if method == "xxhash64":
        return F.xxhash64(F.lit(seed), F.lit(stream), key.cast("bigint")).bitwiseAND(F.lit(0xFFFFFFFF))
    raise ValueError(f"unknown draw method: {method}")


def pick(values: Sequence[str], u: Column) -> Column:
    """One of ``values``, uniformly."""
    return F.element_at(F.array(*map(F.lit, values)), (1 + u % len(values)).cast("int"))


def int_between(lo: int, hi: int | Column, u: Column) -> Column:
    """Integer in [lo, hi], both ends included."""
    hi = hi if isinstance(hi, Column) else F.lit(hi)
    return F.lit(lo) + u % (hi - F.lit(lo) + F.lit(1))


def real_between(lo: float, hi: float, u: Column) -> Column:
    """Double in [lo, hi)."""
    return F.lit(float(lo)) + F.lit(float(hi) - float(lo)) * u.cast("double") / F.lit(4294967296.0)


def round_even(x: Column) -> Column:
    """Whole number nearest to ``x``, halves to the even one."""
    return F.bround(x, 0)


def date_between(start: dt.date, end: dt.date, u: Column) -> Column:
    """Date in [start, end], both ends included."""
    days = (end - start).days + 1
    return F.date_add(F.lit(start), (u % days).cast("int"))


def typed_null(kind: str) -> Column:
    return F.lit(None).cast(kind)


def grouped(n: Column) -> Column:
    """Integer text with thousands separators."""
    return F.format_number(n, 0)


def grouped_right(n: Column, width: int = 6) -> Column:
    """``grouped`` right-aligned to ``width``; longer text is never cut."""
    text = grouped(n)
    return F.lpad(text, F.greatest(F.lit(width), F.length(text)), F.lit(" "))
