"""Aggregates by name: SUM, MIN, MAX, COUNT, and those that users register.

The built-in ones give a value on no rows too: 0.0, the greatest double, the least double, 0.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerbrook.errors import InvalidOperation, ParseError
from ledgerbrook.functions.types import REGISTRY, LogType

DOUBLE_MAX = 1.7976931348623157e308


@dataclass(frozen=True)
class Aggregate:
    """``whole`` makes the aggregate of a column; or ``zero``, ``step`` and ``join`` fold it (rows first, then partial results)."""

    name: str
    result: LogType
    whole: Callable[[Column], Column] | None = None
    zero: Callable[[], Column] | None = None
    step: Callable[[Column, Column], Column] | None = None
    join: Callable[[Column, Column], Column] | None = None


_DOUBLE, _ULONG = REGISTRY.get("DOUBLE"), REGISTRY.get("ULONG")


class AggregateRegistry:
    def __init__(self):
        self._known: dict[str, Aggregate] = {}
        for made in (
            Aggregate("SUM", _DOUBLE, lambda c: F.coalesce(F.sum(c.cast("double")), F.lit(0.0))),
            Aggregate("MIN", _DOUBLE, lambda c: F.coalesce(F.min(c.cast("double")), F.lit(DOUBLE_MAX))),
            Aggregate("MAX", _DOUBLE, lambda c: F.coalesce(F.max(c.cast("double")), F.lit(-DOUBLE_MAX))),
            Aggregate("COUNT", _ULONG, lambda c: F.count(F.lit(1))),
        ):
            self._known[made.name] = made

    def register(self, made: Aggregate) -> None:
        if made.name.upper() in self._known:
            raise InvalidOperation(f"Aggregate {made.name} already exists.")
        if made.whole is None and None in (made.zero, made.step, made.join):
            raise InvalidOperation("an aggregate needs an expression, or zero, step and join")
        self._known[made.name.upper()] = made

    def get(self, name: str) -> Aggregate:
        if name.upper() not in self._known:
            raise InvalidOperation(f"Unknown aggregate {name}")
        return self._known[name.upper()]


AGGREGATES = AggregateRegistry()


def parse_aggregate(text: str) -> tuple[str, str]:
    """``NAME(column)`` as its two parts."""
    m = re.fullmatch(r"\s*([A-Za-z_]\w*)\s*\(\s*([A-Za-z_][\w.]*)\s*\)\s*", text)
    if not m:
        raise ParseError(f"Parse failed at {text!r}")
    return m[1].upper(), m[2]


#: Values that a fold gathers in one list, at most, while they are in one partition.
FOLDED = 8192


def aggregate(df: DataFrame, made: Aggregate, column: Column, out: str, by: list[str] | None = None, spread: int = 1024) -> DataFrame:
    """``df`` aggregated, by columns or as a whole.

    A fold goes up in three steps: runs of ``FOLDED`` rows of a partition, whose lists Spark makes before it shuffles; then
    ``spread`` parts of those runs' results; then the whole. ``join`` must not care for the order of its arguments.
    """
    by = by or []
    if made.whole is not None:
        value = made.whole(column).alias(out)
        return df.groupBy(*by).agg(value) if by else df.agg(value)
    at = F.monotonically_increasing_id()  # the partition's number, then the row's place in it
    run = F.floor(at / FOLDED).alias("fold_run")
    rows = df.select(*by, run, column.alias("fold_value"))
    once = rows.groupBy(*by, "fold_run").agg(F.aggregate(F.collect_list("fold_value"), made.zero(), made.step).alias("fold_value"))
    parted = once.groupBy(*by, F.pmod(F.xxhash64("fold_run"), F.lit(spread)).alias("fold_part"))
    twice = parted.agg(F.aggregate(F.collect_list("fold_value"), made.zero(), made.join).alias("fold_value"))
    whole = F.aggregate(F.collect_list("fold_value"), made.zero(), made.join).alias(out)
    return twice.groupBy(*by).agg(whole) if by else twice.agg(whole)
