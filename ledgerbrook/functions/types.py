"""Types of log columns: names, numbers, widths, literal parsing, text form, and a registry for user-defined types.

A column's type is fixed when its schema is declared. Literals in predicates are parsed in Python into exactly that type,
so Spark never coerces a comparison.
"""

from __future__ import annotations

import math
import re
import struct
from collections.abc import Callable
from dataclasses import dataclass, field
from decimal import Decimal
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerbrook.errors import InvalidOperation, ParseError


def _boolean(text: str) -> bool:
    low = text.lower()
    if low not in ("true", "false"):
        raise InvalidOperation(f"Cannot parse {text!r} as BOOL")
    return low == "true"


def _character(text: str) -> int:
    raw = text.encode("utf-8")
    if len(raw) != 1:
        raise InvalidOperation(f"Cannot parse {text!r} as CHAR")
    return raw[0]


def _signed_character(text: str) -> int:
    v = _character(text)
    return v - 256 if v > 127 else v


def _integer(low: int, high: int) -> Callable[[str], int]:
    def parse(text: str) -> int:
        if not re.fullmatch(r"[+-]?\d+", text) or not low <= int(text) <= high:
            raise InvalidOperation(f"Cannot parse {text!r} as an integer in [{low}, {high}]")
        return int(text)

    return parse


def _real(text: str) -> float:
    try:
        return float(text)
    except ValueError:
        raise InvalidOperation(f"Cannot parse {text!r} as a number") from None


@dataclass(frozen=True)
class LogType:
    """``number`` orders types for promotion; ``width`` is bytes in a record; ``show`` gives the text form of a column."""

    name: str
    number: int
    width: int
    spark: T.DataType
    parse: Callable[[str], Any]
    show: Callable[[Column], Column] = field(default=lambda c: c.cast("string"))
    numeric: bool = True
    integral: bool = False
    least: Any = None
    greatest: Any = None

    def literal(self, text: str) -> Column:
        return self.lit(self.parse(text))

    def lit(self, value: Any) -> Column:
        return F.lit(Decimal(value) if isinstance(self.spark, T.DecimalType) else value).cast(self.spark)

    def pack(self, value: Any) -> bytes:
        """A value as the bytes of a record."""
        if isinstance(value, bool) or self.integral or isinstance(self.spark, T.DecimalType):
            return int(value).to_bytes(self.width, "little", signed=int(value) < 0)
        if isinstance(value, float):
            return struct.pack("<f" if self.width == 4 else "<d", value)
        return str(value).encode("utf-8")[: self.width].ljust(self.width, b"\0")

    def spelled(self) -> str:
        return f"{self.name}({self.width})" if self.name == "STRING" else self.name


def _int_type(name: str, number: int, width: int, spark: T.DataType, signed: bool) -> LogType:
    bits = 8 * width
    low, high = (-(1 << bits - 1), (1 << bits - 1) - 1) if signed else (0, (1 << bits) - 1)
    return LogType(name, number, width, spark, _integer(low, high), integral=True, least=low, greatest=high)


_DOUBLE_MAX, _FLOAT_MAX = 1.7976931348623157e308, 3.4028234663852886e38
_BASE = [
    LogType("BOOL", 1, 1, T.BooleanType(), _boolean, integral=True, least=False, greatest=True),
    LogType("CHAR", 2, 1, T.ByteType(), _signed_character, lambda c: F.char(c.cast("int")), integral=True, least=-128, greatest=127),
    LogType("UCHAR", 3, 1, T.ShortType(), _character, integral=True, least=0, greatest=255),
    _int_type("SHORT", 4, 2, T.ShortType(), True),
    _int_type("USHORT", 5, 2, T.IntegerType(), False),
    _int_type("INT", 6, 4, T.IntegerType(), True),
    _int_type("UINT", 7, 4, T.LongType(), False),
    _int_type("LONG", 8, 8, T.LongType(), True),
    _int_type("ULONG", 9, 8, T.DecimalType(20, 0), False),
    LogType("FLOAT", 10, 4, T.FloatType(), _real, least=-_FLOAT_MAX, greatest=_FLOAT_MAX),
    LogType("DOUBLE", 11, 8, T.DoubleType(), _real, least=-_DOUBLE_MAX, greatest=_DOUBLE_MAX),
]
#: The time column: nanoseconds since 1970, a signed 64-bit number here.
TIMESTAMP = LogType("ULONG", 9, 8, T.LongType(), _integer(0, (1 << 63) - 1), integral=True, least=0, greatest=(1 << 63) - 1)


class TypeRegistry:
    """Primitive types and those that users add. User types get numbers from 13 on."""

    def __init__(self):
        self._types = {t.name: t for t in _BASE}

    def register(self, name: str, width: int, spark: T.DataType, parse: Callable[[str], Any], show: Callable[[Column], Column] | None = None, numeric: bool = True) -> LogType:
        """A type whose values are stored as ``spark``; comparisons work on the stored values."""
        key = name.upper()
        if key in self._types or key in ("STRING", "NONE"):
            raise InvalidOperation(f"Type {name} already exists.")
        number = 13 + sum(t.number >= 13 for t in self._types.values())
        made = LogType(key, number, width, spark, parse, show or (lambda c: c.cast("string")), numeric)
        self._types[key] = made
        return made

    def get(self, text: str) -> LogType:
        """A type by its name, ``NAME`` or ``STRING(width)``, whatever the case."""
        m = re.fullmatch(r"\s*([A-Za-z_]\w*)\s*(?:\(\s*(\d+)\s*\))?\s*", text)
        name = m[1].upper() if m else ""
        if name == "STRING":
            if not m[2] or int(m[2]) == 0:
                raise ParseError("STRING needs a width")
            return string_type(int(m[2]))
        if name not in self._types:
            raise ParseError(f"Unknown type {text!r}")
        return self._types[name]



def string_type(width: int) -> LogType:
    def parse(text: str) -> str:
        if len(text.encode("utf-8")) > width:
            raise InvalidOperation(f"{text!r} is longer than {width} bytes")
        return text

    return LogType("STRING", 12, width, T.StringType(), parse, numeric=False, least="", greatest="\U0010ffff" * max(1, width // 4))


REGISTRY = TypeRegistry()


def type_of(spark: T.DataType) -> LogType:
    """The log type that stores a Spark column as it is."""
    found = {T.BooleanType: "BOOL", T.ByteType: "CHAR", T.ShortType: "SHORT", T.IntegerType: "INT", T.LongType: "LONG", T.FloatType: "FLOAT", T.DoubleType: "DOUBLE"}.get(type(spark))
    if found == "CHAR":  # a byte column of another table is a number, not a character
        return LogType("CHAR", 2, 1, spark, _integer(-128, 127), integral=True)
    if found:
        return REGISTRY.get(found)
    if isinstance(spark, T.DecimalType):
        return LogType("ULONG", 9, 8, spark, lambda s: Decimal(_integer(-(10**38), 10**38)(s)))
    if isinstance(spark, T.StringType):
        return string_type(1 << 20)
    raise InvalidOperation(f"no log type stores {spark.simpleString()}")


def promoted(a: LogType, b: LogType) -> LogType:
    """The type of an operation on two numbers: that of the greater number of type."""
    if not (a.numeric and b.numeric):
        raise InvalidOperation("strings are not numbers")
    return a if a.number >= b.number else b


def typed_text(type_: LogType, value: Any) -> str:
    """``type(value)``, as alerts and triggers spell a number."""
    if isinstance(value, bool):
        text = str(value).lower()
    elif isinstance(value, float):
        text = ("inf" if value > 0 else "-inf") if math.isinf(value) else "nan" if math.isnan(value) else f"{value:.6f}"
    else:
        text = str(value)
    return f"{type_.name.lower()}({text})"
