import math
import random

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerbrook.functions.types import REGISTRY
from ledgerbrook.operators import lazy_stream, sketch
from ledgerbrook.operators.lazy_stream import LazyStream
from ledgerbrook.operators.schema import parse_schema
from ledgerbrook.sources.store import Store
from ledgerbrook.streaming import continuous
from ledgerbrook.streaming.pubsub import Consumer, Producer


def test_lazy_stream(spark):
    s = LazyStream.of(spark, [3, 1, 2, 2], T.IntegerType())
    assert [r.value for r in s.take(2).to_list()] == [3, 1]
    assert [r.value for r in s.map(value=F.col("value") * 2).to_list()] == [6, 2, 4, 4]
    assert [r.value for r in s.filter(F.col("value") > 1).to_list()] == [3, 2, 2]
    assert [r.x for r in s.flat_map(F.sequence(F.lit(1), F.col("value")), "x").to_list()] == [1, 2, 3, 1, 1, 2, 1, 2]
    assert sorted(r.value for r in s.distinct("value").to_list()) == [1, 2, 3]
    assert s.concat(s).size() == 8 and s.head().value == 3 and [r.value for r in s.tail().to_list()] == [1, 2, 2]
    assert s.fold_left(F.lit(0), lambda acc, v: acc * 10 + v, "value") == 3122
    seen = []
    s.for_each(lambda r: seen.append(r.value))
    assert seen == [3, 1, 2, 2]
    none = LazyStream.of(spark, [], T.IntegerType())
    assert none.empty()
    with pytest.raises(IndexError):
        none.head()


@pytest.fixture(scope="module")
def keys(spark):
    rng = random.Random(2)
    values = [round(rng.gauss(0, 30)) for _ in range(20_000)]
    exact = {}
    for v in values:
        exact[v] = exact.get(v, 0) + 1
    return spark.createDataFrame([(v,) for v in values], "k int"), exact


def test_frequency_sketches(keys):
    df, exact = keys
    made = sketch.CountMin(eps=0.01, gamma=0.01)
    built = made.build(df, "k")
    assert built.count() <= made.width * made.depth
    for r in made.estimate(built, df, "k").collect():
        assert exact[r.k] <= r.estimate <= exact[r.k] + 0.02 * 20_000
    halves = [made.build(df.where(F.col("k") % 2 == 0), "k"), made.build(df.where(F.col("k") % 2 != 0), "k")]
    assert sorted(map(tuple, made.merge(*halves).collect())) == sorted(map(tuple, built.collect()))
    signed = sketch.CountSketch(eps=0.05, gamma=0.01)
    top = sorted(exact, key=lambda v: (-exact[v], v))[:10]
    for r in signed.estimate(signed.build(df, "k"), df, "k").collect():
        if r.k in top:
            assert abs(r.estimate - exact[r.k]) <= 0.02 * 20_000
    assert [r.k for r in sketch.heavy_hitters(df, "k", 10).collect()] == top
    found = {r.k for r in sketch.approx_heavy_hitters(df, "k", 10).collect()}
    assert len(found & set(top)) >= 4


def test_universal_sketch(keys):
    df, exact = keys
    made = sketch.UniversalSketch(k=400)
    built = made.build(df, "k")
    want = {"l2": sum(f * f for f in exact.values()), "entropy": sum(f * math.log(f) for f in exact.values()), "cardinality": len(exact)}
    for name, value in want.items():
        assert made.evaluate(built, name) == pytest.approx(value, rel=1e-9)  # every layer holds all its keys
    small = sketch.UniversalSketch(k=60)
    assert small.evaluate(small.build(df, "k"), "l2") == pytest.approx(want["l2"], rel=0.2)
    row = sketch.g_sums(df, "k").first()
    assert row.l2 == want["l2"] and row.cardinality == want["cardinality"] and row.entropy == pytest.approx(want["entropy"])


def test_streaming_buckets_and_alerts(spark, tmp_path):
    schema = parse_schema("{ v: DOUBLE, k: INT }")
    folder = f"{tmp_path}/in"
    for part in range(3):
        rows = [((part * 10 + i) * 1_000_000, float(i), part) for i in range(10)]
        spark.createDataFrame(rows, schema.struct()).coalesce(1).write.mode("append").parquet(folder)
    stream = continuous.read_stream(spark, folder, schema, files_per_batch=1)
    buckets = continuous.bucket_aggregates(stream, schema, "v >= 5", "MAX(v)", 10_000_000, late="0 seconds")
    out = continuous.alerts(buckets, "high", "m >= 9", REGISTRY.get("DOUBLE"))
    continuous.write_alerts(out, f"{tmp_path}/alerts", f"{tmp_path}/ck").awaitTermination()
    found = continuous.read_alerts(spark, f"{tmp_path}/alerts").collect()
    assert sorted(r.time_bucket for r in found) == [0, 1, 2] and {r.trigger_expr for r in found} == {"m >= double(9.000000)"}
    assert continuous.read_alerts(spark, f"{tmp_path}/alerts", 1, 1, "high").count() == 1
    passed = continuous.filtered(stream, schema, "k == 1").writeStream.format("memory").queryName("passed").trigger(availableNow=True).start()
    passed.awaitTermination()
    assert spark.table("passed").count() == 10


def test_publish_and_subscribe(spark, tmp_path):
    log = Store(spark, f"file://{tmp_path}/s").create("topic", "{ msg: STRING(64), n: INT }")
    producer, consumer = Producer(log, batch_size=20, timeout_s=60), Consumer(log, prefetch=16)
    for k in range(50):
        producer.send([str(k), f"m{k}", k])
    producer.flush()
    got = []
    while (row := consumer.consume()) is not None:
        got.append(row.N)
    assert got == list(range(50)) and consumer.consume() is None
    producer.send(["51", "later", 99])
    producer.flush()
    assert consumer.consume().N == 99


def test_ordered_fold_leaves_its_values_on_the_executors(spark, monkeypatch):
    """Runs of several partitions in order; the driver takes no rows."""
    monkeypatch.setattr(lazy_stream, "FOLDED", 64)
    monkeypatch.setattr(lazy_stream, "CHAINED", 3, raising=False)
    monkeypatch.setattr(DataFrame, "toLocalIterator", None)
    rng = random.Random(4)
    values = [rng.randrange(1000) for _ in range(3000)]
    want = 7
    for v in values:
        want = (want * 31 + v) % 1_000_003
    rows = list(enumerate(values))
    rng.shuffle(rows)
    s = LazyStream(spark.createDataFrame(rows, "at long, v long").repartition(5), ["at"])
    held = spark.sparkContext._jsc.getPersistentRDDs().size()
    assert s.fold_left(F.lit(7).cast("long"), lambda a, v: (a * 31 + v) % 1_000_003, "v") == want
    texts = s.map(v=F.create_map(F.lit("x"), F.col("v").cast("string")))
    assert texts.filter(F.col("at") < 200).fold_left(F.lit(""), lambda a, m: F.concat(a, m["x"]), "v") == "".join(map(str, values[:200]))
    assert s.filter(F.col("at") < 0).fold_left(F.lit(5), lambda a, v: a + v.cast("int"), "v") == 5
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == held
