"""Arithmetic, index keys and their bounds against plain Python, over random values and the ends of each type."""

import math
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerbrook.errors import InvalidOperation
from ledgerbrook.functions import aggregates, arith
from ledgerbrook.functions.types import REGISTRY

TOP = 1 << 64
ULONG = REGISTRY.get("ULONG")


def cut(a, b):
    return abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1)


def test_unsigned_numbers(spark):
    rng = random.Random(1)
    edge = [0, 1, 2, (1 << 63) - 1, 1 << 63, (1 << 63) + 5, TOP - 1]
    pairs = [(a, b) for a in edge for b in edge] + [(rng.randrange(TOP), rng.randrange(1 << rng.randrange(1, 65))) for _ in range(300)]
    df = spark.createDataFrame([(k, Decimal(a), Decimal(b), rng.randrange(64)) for k, (a, b) in enumerate(pairs)], "k int, a decimal(20,0), b decimal(20,0), s int")
    a, b = F.col("a"), F.col("b")
    two = lambda op: arith.binary(op, a, ULONG, b, ULONG)[0]
    shift = lambda op: arith.binary(op, a, ULONG, F.col("s"), REGISTRY.get("INT"))[0]
    out = df.select("k", "s", two("&").alias("and"), two("|").alias("or"), two("^").alias("xor"), arith.unary("~", a, ULONG).alias("not"), shift("<<").alias("left"), shift(">>").alias("right"), arith.bucket(a, ULONG, 7).alias("key"))
    for r in out.collect():
        x, y = pairs[r.k]
        want = (x & y, x | y, x ^ y, TOP - 1 - x, (x << r.s) % TOP, x >> r.s, x // 7)
        assert tuple(int(v) for v in r[2:]) == want, (x, y, r.s)
    whole = df.where("b > 0").select("k", two("/").alias("q"), two("%").alias("m"))
    assert all((int(r.q), int(r.m)) == divmod(*pairs[r.k]) for r in whole.collect())
    for op, f in (("+", lambda x, y: x + y), ("-", lambda x, y: x - y), ("*", lambda x, y: x * y)):
        fits = [k for k, (x, y) in enumerate(pairs) if 0 <= f(x, y) < TOP]
        got = df.where(F.col("k").isin(fits)).select("k", two(op).alias("v")).collect()
        assert all(int(r.v) == f(*pairs[r.k]) for r in got) and len(got) == len(fits)
    row = spark.range(1)
    big = F.lit(Decimal(1 << 63))
    for wrong in (arith.binary("*", big, ULONG, F.lit(Decimal(3)), ULONG)[0], arith.binary("-", F.lit(Decimal(1)), ULONG, F.lit(Decimal(2)), ULONG)[0], arith.unary("-", F.lit(Decimal(5)), ULONG)):
        with pytest.raises(Exception, match="ULONG overflow"):
            row.select(wrong).collect()
    assert row.select(arith.unary("-", F.lit(Decimal(0)), ULONG)).first()[0] == 0
    with pytest.raises(InvalidOperation):
        arith.binary("&", a, ULONG, F.lit(1.0), REGISTRY.get("DOUBLE"))


def test_signed_numbers(spark):
    rng = random.Random(2)
    long = REGISTRY.get("LONG")
    pairs = [(rng.randrange(-(1 << 40), 1 << 40), rng.choice([-7, -1, 1, 3, 1000])) for _ in range(200)]
    df = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "k int, a long, b long")
    two = lambda op: arith.binary(op, F.col("a"), long, F.col("b"), long)[0]
    for r in df.select("k", two("/").alias("q"), two("%").alias("m"), two("&").alias("n"), arith.binary(">>", F.col("a"), long, F.lit(3), long)[0].alias("s"), arith.bucket(F.col("a"), long, 10).alias("key")).collect():
        a, b = pairs[r.k]
        assert (r.q, r.m, r.n, r.s, r.key) == (cut(a, b), a - b * cut(a, b), a & b, a >> 3, cut(a, 10))


def test_index_keys_end_at_their_limits(spark):
    values = [0.0, -0.5, 1.5, -1.5, 1e300, -1e300, math.inf, -math.inf, 9.3e18, -3e9, 3e9, None]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double")
    rows = df.select("k", arith.bucket(F.col("v"), REGISTRY.get("DOUBLE")).alias("d"), arith.bucket(F.col("v").cast("float"), REGISTRY.get("FLOAT")).alias("f")).orderBy("k").collect()
    low, high = -(1 << 63), (1 << 63) - 1
    assert [r.d for r in rows] == [0, 0, 1, -1, high, low, high, low, high, -3_000_000_000, 3_000_000_000, None]
    low, high = -(1 << 31), (1 << 31) - 1
    assert [r.f for r in rows] == [0, 0, 1, -1, high, low, high, low, high, low, high, None]


@pytest.mark.parametrize("name, values", [
    ("INT", list(range(-60, 61)) + [-(1 << 31), (1 << 31) - 1]), ("LONG", list(range(-60, 61)) + [-(1 << 63), (1 << 63) - 1]), ("ULONG", [Decimal(x) for x in [*range(60), TOP - 1, 1 << 63]]),
    ("DOUBLE", [x / 8 for x in range(-400, 400)] + [0.1 * k for k in range(-99, 99)] + [math.inf, -math.inf]), ("FLOAT", [x / 8 for x in range(-400, 400)] + [0.1 * k for k in range(-99, 99)]),
])
def test_bounds_keep_all_keys(spark, name, values):
    """No row of an index range is lost to the bounds on its column, and few others pass them."""
    kind = REGISTRY.get(name)
    df = spark.createDataFrame([(v,) for v in values], "v " + ("decimal(20,0)" if name == "ULONG" else "double" if name in ("FLOAT", "DOUBLE") else "long")).select(F.col("v").cast(kind.spark).alias("v"))
    cases = [(s, b, e) for s in ((1, 3, 10) if kind.integral or name == "ULONG" else (0.1, 0.3, 1.0, 2.5)) for b, e in ((0, 0), (-3, 2), (1, 4), (-5, -2), (-(1 << 63), 3), (2, (1 << 63) - 1), (4, 1))]
    count = lambda c: F.sum(c.cast("long"))
    sums = []
    for size, begin, end in cases:
        inside, bounds = arith.bucket(F.col("v"), kind, size).between(begin, end), arith.bucket_bounds(F.col("v"), kind, begin, end, size)
        sums += [count(inside), count(inside & bounds), count(bounds)]
    found = df.agg(*[c.alias(f"c{i}") for i, c in enumerate(sums)]).first()
    for k, (size, begin, end) in enumerate(cases):
        inside, both, bounds = found[3 * k : 3 * k + 3]
        assert both == inside, (size, begin, end)
        if abs(begin) < 100 and abs(end) < 100:
            assert bounds <= inside + 6, (size, begin, end)


def test_folds_in_three_steps(spark, monkeypatch):
    monkeypatch.setattr(aggregates, "FOLDED", 10)
    longest = aggregates.Aggregate("LONGEST", REGISTRY.get("LONG"), zero=lambda: F.lit(0).cast("long"), step=lambda a, v: F.greatest(a, v), join=lambda a, b: F.greatest(a, b))
    df = spark.range(0, 1000, 1, 3).select("id", (F.col("id") % 3).alias("g"))
    assert aggregates.aggregate(df, longest, F.col("id"), "m", spread=4).first().m == 999
    assert sorted(map(tuple, aggregates.aggregate(df, longest, F.col("id"), "m", ["g"], spread=4).collect())) == [(0, 999), (1, 997), (2, 998)]
    assert aggregates.aggregate(df.limit(0), longest, F.col("id"), "m").first().m == 0
