"""Arithmetic on typed values as column expressions. Operands are cast to the promoted type explicitly."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerbrook.errors import InvalidOperation
from ledgerbrook.functions.types import LogType, promoted

_REAL = ("FLOAT", "DOUBLE")
_WHOLE = ("%", "&", "|", "^", "<<", ">>")
_TOP = 1 << 63


def _unsupported(op: str, *types: LogType) -> InvalidOperation:
    return InvalidOperation(f"{op} is not supported for {', '.join(t.name for t in types)}")


def _unsigned(type_: LogType) -> bool:
    """Whether values are unsigned 64-bit numbers, which Spark stores as decimals."""
    return isinstance(type_.spark, T.DecimalType)


def to_bits(value: Column) -> Column:
    """An unsigned 64-bit number as the signed one of the same bits."""
    return F.when(value > F.lit(Decimal(_TOP - 1)), value - F.lit(Decimal(2 * _TOP))).otherwise(value).cast("long")


def from_bits(bits: Column) -> Column:
    wide = bits.cast("decimal(20,0)")
    return F.when(bits < 0, wide + F.lit(Decimal(2 * _TOP))).otherwise(wide).cast("decimal(20,0)")


def _checked(value: Column, op: str) -> Column:
    """A result of unsigned arithmetic; beyond 64 bits it is an error, as overflow of signed numbers is."""
    fits = value.isNull() | ((value >= F.lit(Decimal(0))) & (value < F.lit(Decimal(2 * _TOP))))
    return F.when(fits, value).otherwise(F.raise_error(F.lit(f"ULONG overflow in {op}")).cast("decimal(38,0)")).cast("decimal(20,0)")


def unary(op: str, value: Column, type_: LogType) -> Column:
    """``-``, ``+`` and ``~``. The negative of an unsigned number other than 0 is an error."""
    if op not in ("-", "+", "~") or not type_.numeric or (op == "~" and type_.name in _REAL):
        raise _unsupported(op, type_)
    if type_.name == "BOOL":
        return value if op in "+-" else ~value
    if op == "+":
        return value
    if _unsigned(type_):
        return _checked(-value, "-") if op == "-" else from_bits(F.bitwise_not(to_bits(value)))
    return (-value if op == "-" else F.bitwise_not(value)).cast(type_.spark)


def _shift(op: str, a: Column, ta: LogType, by: Column) -> Column:
    by = by.cast("int")
    if _unsigned(ta):
        return from_bits(F.call_function("shiftleft" if op == "<<" else "shiftrightunsigned", to_bits(a), by))
    wide = a if isinstance(ta.spark, (T.IntegerType, T.LongType)) else a.cast("long")
    moved = F.call_function("shiftleft" if op == "<<" else "shiftright", wide, by)
    return moved if wide is a else moved.cast(ta.spark)


def binary(op: str, a: Column, ta: LogType, b: Column, tb: LogType) -> tuple[Column, LogType]:
    """The result of ``a op b`` and its type. Whole-number division cuts toward zero, as ``%`` does."""
    if op not in ("+", "-", "*", "/", *_WHOLE):
        raise InvalidOperation(f"unknown operator {op}")
    if not (ta.numeric and tb.numeric) or (op in _WHOLE and (ta.name in _REAL or tb.name in _REAL)):
        raise _unsupported(op, ta, tb)
    if op in ("<<", ">>"):
        if ta.name == "BOOL":
            raise _unsupported(op, ta)
        return _shift(op, a, ta, b), ta
    out = promoted(ta, tb)
    if out.name == "BOOL":
        table = {"*": a & b, "&": a & b, "+": a | b, "|": a | b, "^": a != b, "-": a != b}
        if op not in table:
            raise _unsupported(op, ta, tb)
        return table[op], out
    x, y = ((c.cast("int") if t.name == "BOOL" else c).cast(out.spark) for c, t in ((a, ta), (b, tb)))
    if op in ("&", "|", "^"):
        if _unsigned(out):
            x, y = to_bits(x), to_bits(y)
        found = {"&": x.bitwiseAND, "|": x.bitwiseOR, "^": x.bitwiseXOR}[op](y)
        return (from_bits(found) if _unsigned(out) else found.cast(out.spark)), out
    if op == "/" and out.name not in _REAL:
        if not _unsigned(out):
            return F.call_function("div", x.cast("long"), y.cast("long")).cast(out.spark), out
        return _checked((x - x % y) / y, op), out  # the quotient is whole, so the decimal division is exact
    found = {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "%": lambda: x % y, "/": lambda: x / y}[op]()
    return (_checked(found, op) if _unsigned(out) else found.cast(out.spark)), out


def compare(op: str, a: Column, b: Column, real: bool = False) -> Column:
    """Comparison where NaN is unequal to and unordered with everything, which Spark's own isn't."""
    table = {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b, "==": a == b, "!=": a != b}
    if op not in table:
        raise InvalidOperation(f"unknown comparison {op}")
    out = table[op]
    if real:
        nan = F.isnan(a) | F.isnan(b)
        out = (out | nan) if op == "!=" else (out & ~nan)
    return out


def cast(value: Column, source: LogType, target: LogType) -> Column:
    """A number as another type of number."""
    if not (source.numeric and target.numeric):
        raise _unsupported("cast", source, target)
    if target.name == "BOOL":
        return value if source.name == "BOOL" else value != F.lit(0)
    return value.cast(target.spark)


def bucket(value: Column, type_: LogType, size: float = 1.0) -> Column:
    """Index key: the value over the bucket size, cut toward zero; strings are their own keys.

    Keys of FLOAT end at the limits of 32-bit numbers, those of DOUBLE at the limits of 64-bit ones.
    """
    if not type_.numeric:
        return value
    if type_.integral or _unsigned(type_):
        by = int(size)
        if by < 1:
            raise InvalidOperation("a whole-number column needs a bucket size of 1 at least")
        if _unsigned(type_):
            return ((value - value % F.lit(Decimal(by))) / F.lit(Decimal(by))).cast("decimal(20,0)")
        whole = value.cast("int").cast("long") if type_.name == "BOOL" else value.cast("long")
        return F.call_function("div", whole, F.lit(by).cast("long"))
    key = value.cast("double") / F.lit(float(size))
    low, high = (-(1 << 31), (1 << 31) - 1) if type_.name == "FLOAT" else (-_TOP, _TOP - 1)
    inside = F.when((key > float(low)) & (key < float(high)), key).otherwise(0.0).cast("long")
    return F.when(key.isNull(), F.lit(None)).when(key >= float(high), F.lit(high)).when(key <= float(low), F.lit(low)).otherwise(inside).cast("long")


def bucket_bounds(value: Column, type_: LogType, begin, end, size: float = 1.0) -> Column:
    """A condition on the stored value that holds wherever the index key is in [begin, end], for scans to skip files by.

    It may hold for a few values more, where division rounds; the key decides those.
    """
    if not type_.numeric:
        return value.between(F.lit(begin), F.lit(end))
    if type_.name == "BOOL":
        return F.lit(True)
    whole = type_.integral or _unsigned(type_)
    by = int(size) if whole else float(size)
    low = (begin - 1) * by + 1 if begin <= 0 and whole else (begin - 1) * by if begin <= 0 else begin * by
    high = end * by if end < 0 else (end + 1) * by - 1 if whole else (end + 1) * by
    if whole:
        low, high = (max(type_.least if type_.least is not None else -(10**20) + 1, low), min(type_.greatest if type_.greatest is not None else 10**20 - 1, high))
        if low > high:
            return F.lit(False)
        return (value >= type_.lit(low)) & (value <= type_.lit(high))
    slack = 1e-6 if type_.name == "FLOAT" else 1e-12
    low, high = low - abs(low) * slack, high + abs(high) * slack
    most = (1 << 31) - 2 if type_.name == "FLOAT" else 1 << 62  # keys at the ends stand for all beyond
    out = F.lit(True)
    if begin > -most:
        out = out & (value >= F.lit(low).cast(type_.spark))
    return out & (value <= F.lit(high).cast(type_.spark)) if end < most else out
