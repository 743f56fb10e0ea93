"""The eight-row table of all types, with its known results, in a log and in a store."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerbrook.errors import InvalidOperation, ManagementError
from ledgerbrook.functions import arith
from ledgerbrook.functions.aggregates import AGGREGATES, Aggregate, aggregate
from ledgerbrook.functions.types import REGISTRY, TypeRegistry
from ledgerbrook.operators.schema import SchemaBuilder
from ledgerbrook.operators.timeseries import TimeSeries
from ledgerbrook.sources.multilog import Multilog
from ledgerbrook.sources.store import Client, Store

SCHEMA = "{ a: BOOL, b: CHAR, c: SHORT, d: INT, e: LONG, f: FLOAT, g: DOUBLE, h: STRING(16) }"
WORDS = ["abc", "defg", "hijkl", "mnopqr", "stuvwx", "yyy", "zzz", "zzz"]
TS = 1_000_000
ROWS = [[str(TS), str(i % 2 == 1), str(i), str(10 * i), str(2 * i), str(10 ** (i - 1) if i else 0), str(i / 10), f"0.0{i + 1}", WORDS[i]] for i in range(8)]
AD_HOC = {
    "a == true": 4, "b > 4": 3, "c <= 30": 4, "d == 0": 1, "e <= 100": 4, "e >= 100": 5, "f > 0.1": 6, "g < 0.06": 5, "h == zzz": 2,
    "a == true && b > 4": 2, "a == true && (b > 4 || c <= 30)": 4, "a == true && (b > 4 || f > 0.1)": 3,
}
REGISTERED = {"a == true": (4, 32), "b > 4": (3, 36), "c <= 30": (4, 12), "d == 0": (1, 0), "e <= 100": (4, 12), "f > 0.1": (6, 54), "g < 0.06": (5, 20), "h == zzz": (2, 26)}


@pytest.fixture()
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store")


@pytest.fixture()
def log(store):
    log = store.create("all", SCHEMA)
    for i, expression in enumerate(REGISTERED, 1):
        log.add_filter(f"filter{i}", expression)
        log.add_aggregate(f"agg{i}", f"filter{i}", "SUM(d)")
        log.install_trigger(f"trigger{i}", f"agg{i} >= 10")
    log.append(ROWS[:3])
    log.append(ROWS[3:])
    return log


def test_golden_results(log, store):
    for expression, n in AD_HOC.items():
        assert log.execute_filter(expression).count() == n, expression
    bucket = TS // log.time_resolution_ns
    for i, (n, total) in enumerate(REGISTERED.values(), 1):
        assert log.query_filter(f"filter{i}", bucket, bucket).count() == n
        assert log.query_filter(f"filter{i}", bucket + 1).count() == 0
        assert log.get_aggregate(f"agg{i}", bucket, bucket).first().value == total
    assert log.query_filter("filter1", bucket, bucket, "b > 4").count() == 2
    assert log.query_filter("filter1", bucket, bucket, "b > 4 || c <= 30").count() == 4
    assert log.query_filter("filter1", bucket, bucket, "b > 4 || f > 0.1").count() == 3
    assert log.get_alerts(bucket, bucket).count() == 7
    assert {r.trigger_name for r in log.get_alerts().collect()} == {f"trigger{i}" for i in (1, 2, 3, 5, 6, 7, 8)}
    again = store.get("all")  # all of it is on disk
    assert again.get_alerts().count() == 7 and again.num_records() == 8
    assert [r.value for r in again.execute_aggregate("SUM(d)", "h == zzz").collect()] == [26.0]
    assert again.execute_aggregate("MIN(d)", "h == nope").first().value == 1.7976931348623157e308


def test_places_and_versions(log):
    assert log.record_size == 52 and log.version() == 8 * 52
    assert [r.log_offset for r in log.scan().collect()] == [52 * i for i in range(8)]
    assert log.read(52 * 3).first().H == "mnopqr" and log.read(8 * 52).isEmpty()
    assert [r.D for r in log.read_batch(52 * 5, 10).orderBy("log_offset").collect()] == [10, 12, 14]
    assert log.snapshot(3 * 52).count() == 3
    series = TimeSeries(log)
    assert series.compute_diff(52, 8 * 52).count() == 7 and series.get_version() == 8 * 52
    assert log.as_of(4 * 52).execute_aggregate("SUM(d)", "").first().value == 12.0
    assert log.rows.orderBy("log_offset").select(log.schema.texts().alias("t")).first().t[1:5] == ["false", "0", "0", "0"]


def test_registry_errors(log, store):
    for call in (
        lambda: log.remove_filter("nope"), lambda: log.remove_trigger("nope"), lambda: log.remove_index("a"), lambda: log.add_filter("filter1", "a == true"),
        lambda: log.add_aggregate("x", "nope", "SUM(d)"), lambda: log.add_aggregate("x", "filter1", "CNT(d)"), lambda: log.install_trigger("t", "nope > 1"), lambda: log.query_filter("nope"),
        lambda: log.append([["1", "true"]]), lambda: log.install_trigger("t", "agg1 > 1", 0),
    ):
        with pytest.raises(InvalidOperation):
            call()
    log.add_index("c", 10)
    with pytest.raises(InvalidOperation):
        log.add_index("C", 10)
    assert log.is_indexed("c") and {r.bucket: r.n for r in log.index_histogram("c").collect()} == {i: 1 for i in range(8)}
    assert log.approx_count("c", 2, 4).first().n == 3
    log.remove_index("c")
    log.remove_filter("filter1")
    log.add_filter("filter1", "b > 4")  # counts later rows only
    assert log.query_filter("filter1").count() == 0 and log.backfilled().query_filter("filter1").count() == 3
    with pytest.raises(ManagementError):
        store.create("all", SCHEMA)
    with pytest.raises(ManagementError):
        store.get("none")
    stale = store.get("all")
    log.append(ROWS[:1])
    with pytest.raises(ManagementError):
        stale.append(ROWS[:1])
    assert stale.refresh().append(ROWS[:1]) == 9 * 52
    assert store.list() == ["all"] and store.get_by_id(store.id_of("all")).num_records() == 10
    store.remove("all")
    assert store.list() == []


def test_archive_changes_no_result(log):
    log.add_index("d", 2)
    log.archive(upto=4 * 52)
    log.vacuum()
    for expression, n in AD_HOC.items():
        assert log.execute_filter(expression).count() == n
    assert log.append(ROWS[:2]) == 8 * 52 and log.num_records() == 10


def test_batches_go_in_by_time_block(store):
    log = store.create("blocks", "{ x: INT, y: INT }", mode="IN_MEMORY")
    batch = log.batch()
    for k, ts in enumerate([2_000_000, 0, 1_000_000, 0, 2_000_000, 1_000_000, 0]):
        batch.add_record([ts, k, 0])
    assert batch.num_records == 7 and batch.blocks() == {0: 3, 1: 2, 2: 2}
    assert batch.append() == 0
    assert [r.X for r in log.scan().collect()] == [1, 3, 6, 2, 5, 0, 4]


def test_client_needs_a_log(store):
    client = Client(store)
    with pytest.raises(InvalidOperation):
        client.execute_filter("a == true")
    client.create_atomic_multilog("c", "{ x: INT, y: INT }")
    client.append([[k, k, 0] for k in range(45)])
    assert [len(p) for p in client.pages(client.execute_filter("x >= 0"))] == [20, 20, 5]
    client.remove_atomic_multilog()


def test_user_types(spark):
    registry = TypeRegistry()
    units = {"b": 1, "kb": 1 << 10, "mb": 1 << 20, "gb": 1 << 30, "tb": 1 << 40, "pb": 1 << 50}

    def size(text):
        digits = text.rstrip("bkmgtp")
        return int(digits) * units[text[len(digits) :]]

    def address(text):
        a, b, c, d = map(int, text.split("."))
        return (a << 24) + (b << 16) + (c << 8) + d

    show = lambda v: F.concat_ws(".", *[F.shiftright(v, s).bitwiseAND(255).cast("string") for s in (24, 16, 8, 0)])
    registry.register("ip_address", 4, T.LongType(), address, show)
    registry.register("size_type", 8, T.LongType(), size)
    with pytest.raises(InvalidOperation):
        registry.register("IP_ADDRESS", 4, T.LongType(), address)
    schema = SchemaBuilder(registry).add("a", "ip_address").add("c", "size_type").build()
    rows = [schema.parse_record([str(k), f"0.0.0.{k}", s]) for k, s in ((1, "1kb"), (3, "2mb"), (4, "1024b"), (5, "15pb"))]
    df = spark.createDataFrame([tuple(r) for r in rows], schema.struct())
    log = Multilog(df.withColumn("log_offset", F.lit(0).cast("long")), schema)
    assert log.execute_filter("a > 0.0.0.3").count() == 2
    assert log.execute_filter("c == 1kb").count() == 2
    assert log.rows.select(schema.texts().alias("t")).first().t[1] == "0.0.0.1"


def test_user_aggregate(spark):
    made = Aggregate("SUM_SQUARES_T", REGISTRY.get("DOUBLE"), zero=lambda: F.lit(0.0), step=lambda acc, v: acc + v * v, join=lambda acc, v: acc + v)
    AGGREGATES.register(made)
    with pytest.raises(InvalidOperation):
        AGGREGATES.register(made)
    df = spark.range(10).select(F.col("id").cast("double").alias("v"), (F.col("id") % 2).alias("k"))
    assert aggregate(df, AGGREGATES.get("sum_squares_t"), F.col("v"), "s").first().s == 285.0
    assert {r.k: r.s for r in aggregate(df, made, F.col("v"), "s", ["k"]).collect()} == {0: 120.0, 1: 165.0}
    assert aggregate(df.where("v < 0"), made, F.col("v"), "s").first().s == 0.0


def test_arithmetic_types(spark):
    t = REGISTRY.get
    row = spark.createDataFrame([(-7, 2, 7.5, True)], "i int, j int, x double, b boolean")
    i, j, x, b = (F.col(c) for c in "ijxb")
    at = lambda op, p, tp, q, tq: row.select(arith.binary(op, p, t(tp), q, t(tq))[0].alias("v")).first().v
    assert at("/", i, "INT", j, "INT") == -3 and at("%", i, "INT", j, "INT") == -1 and at("/", x, "DOUBLE", j, "INT") == 3.75
    assert at("*", b, "BOOL", b, "BOOL") is True and at("^", b, "BOOL", b, "BOOL") is False
    assert at("<<", i, "INT", j, "INT") == -28 and at(">>", i, "INT", j, "INT") == -2
    for op, tp in (("%", "DOUBLE"), ("&", "FLOAT"), ("<<", "DOUBLE"), ("<<", "BOOL"), ("/", "BOOL")):
        with pytest.raises(InvalidOperation):
            arith.binary(op, i, t(tp), j, t(tp))
    keys = row.select(arith.bucket(F.lit(-15), t("INT"), 10).alias("a"), arith.bucket(F.lit(-1.5), t("DOUBLE"), 1.0).alias("c"), arith.bucket(F.lit("s"), t("STRING(4)")).alias("s"))
    assert keys.first() == (-1, -1, "s")


def test_filter_series(spark):
    """100,000 rows a microsecond apart, in millisecond buckets."""
    df = spark.range(100_000).select((F.col("id") * 1000).alias("ts"), F.col("id").alias("value"), (F.col("id") * 16).alias("log_offset"))
    log = Multilog.from_dataframe(df, "ts", F.col("log_offset"), 16)
    log.add_filter("tens", function=lambda rows: rows["ts"] % 10_000 == 0)
    log.add_aggregate("most", "tens", "MAX(ts)")
    counts = log.query_filter("tens").groupBy(log.time_bucket().alias("b")).count().collect()
    assert len(counts) == 100 and {r["count"] for r in counts} == {100}
    log.add_filter("high", "value >= 50000")
    log.add_aggregate("top", "high", "MAX(ts)")
    assert log.query_filter("high", 0, 49).count() == 0 and log.query_filter("high", 48, 52).count() == 3000
    assert all(r.value == ((r.time_bucket + 1) * 1000 - 1) * 1000 for r in log.aggregate_buckets("top").collect())


def test_documentation_example(store):
    log = store.create("perf", "{ timestamp: ULONG, op_latency_ms: DOUBLE, cpu_util: DOUBLE, mem_avail: DOUBLE, log_msg: STRING(100) }")
    log.add_filter("low_resources", "cpu_util>0.8 || mem_avail<0.1")
    log.add_aggregate("max_latency_ms", "low_resources", "MAX(op_latency_ms)")
    log.install_trigger("high_latency_trigger", "max_latency_ms > 1000")
    log.append([["100.0", "0.5", "0.9", "INFO: Launched 1 tasks"], ["500.0", "0.9", "0.05", "WARN: Server 2 down"], ["1001.0", "0.9", "0.03", "WARN: Server 2, 4, 5 down"]])
    assert log.query_filter("low_resources").count() == 2
    assert log.get_aggregate("max_latency_ms").first().value == 1001.0
    alert = log.alert_texts(log.get_alerts()).first()
    assert alert.trigger_expr == "max_latency_ms > double(1000.000000)" and 'trigger-value: "double(1001.000000)"' in alert.alert


def test_bounds_reach_the_scan(spark, sf_dir):
    from ledgerbrook.plans.catalogue import FROM, TO, events

    log = events(spark, sf_dir)
    log.add_filter("high", "value > 50")
    plan = log.query_filter("high", FROM, TO).select("event_id")._jdf.queryExecution().executedPlan().toString()
    pushed = plan.split("PushedFilters: [")[1].split("]")[0]
    assert "GreaterThanOrEqual(ts" in pushed and "LessThan(ts" in pushed and "GreaterThan(value" in pushed
    assert "props" not in plan.split("ReadSchema")[1]


def test_bounds_reach_the_scan(spark, sf_dir):
    """Index ranges, versions and places become bounds on stored columns."""
    from ledgerbrook.plans.catalogue import events

    log = events(spark, sf_dir)
    pushed = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(value" in pushed(log.index_scan("value", 2, 5, 10.0)) and "LessThanOrEqual(value" in pushed(log.approx_count("value", 2, 5, 10.0))
    assert "LessThan(event_id,10)" in pushed(log.snapshot(480)) and "In(event_id" in pushed(log.read_many([0, 48, 96]))
    assert "GreaterThanOrEqual(event_id,5)" in pushed(log.read_batch(240, 3))


def test_archive_rewrites_a_prefix_only(spark, tmp_path):
    log = Store(spark, str(tmp_path)).create("a", "{ x: LONG, y: LONG }")
    for k in range(4):
        log.append([[str(k * 10 + i), str(k * 10 + i), "0"] for i in range(10)])
    before = list(log._manifest["parts"])
    log.archive(15 * log.record_size)
    after = log._manifest["parts"]
    assert before[2] in after and before[3] in after and before[0] not in after and log._manifest["archived"] == 15 * log.record_size
    archived = [p for p in after if log._manifest["ranges"][p] == [0, 15 * log.record_size]]
    log.archive(25 * log.record_size)
    assert archived[0] in log._manifest["parts"] and before[3] in log._manifest["parts"]
    log.vacuum()
    assert sorted(r.X for r in Store(spark, str(tmp_path)).load("a").rows.collect()) == list(range(40))
    assert [r.X for r in log.scan().collect()] == list(range(40))


def test_memory_logs_keep_one_copy(spark, tmp_path):
    log = Store(spark, str(tmp_path)).create("m", "{ x: LONG, y: LONG }", "IN_MEMORY")
    held = lambda: spark.sparkContext._jsc.getPersistentRDDs().size()
    start = held()
    for k in range(3):
        log.append([[str(k), str(k), "0"]])
        assert log.rows.count() == k + 1
    assert held() <= start + 1
    log.close()
    assert held() == start
