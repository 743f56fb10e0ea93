"""A log: an append-only table with named filters, aggregates, triggers and indexes, read at versions.

All reads are lazy DataFrames. A row's ``log_offset`` is its place in bytes; a version is an end of the log in bytes, and
a snapshot at it holds the rows that end there at the latest. Filters, aggregates and triggers are definitions: results
are computed from the rows when asked for, grouped by time bucket (TIMESTAMP over the time resolution, cut).
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, replace
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerbrook.errors import InvalidOperation, ParseError
from ledgerbrook.functions.aggregates import AGGREGATES, Aggregate, aggregate, parse_aggregate
from ledgerbrook.functions.arith import bucket, bucket_bounds, compare
from ledgerbrook.functions.types import typed_text
from ledgerbrook.operators.predicate import compiled
from ledgerbrook.operators.schema import LogSchema, schema_of

OFFSET = "log_offset"
MILLISECOND = 1_000_000


@dataclass(frozen=True)
class NamedFilter:
    name: str
    expression: str
    since: int = 0
    function: Callable[[DataFrame], Column] | None = None


@dataclass(frozen=True)
class NamedAggregate:
    name: str
    filter: str
    expression: str
    since: int = 0


@dataclass(frozen=True)
class Trigger:
    name: str
    aggregate: str
    op: str
    threshold: str
    periodicity_ms: int = 1


def parse_trigger(text: str) -> tuple[str, str, str]:
    """``aggregate op number`` as its three parts."""
    m = re.fullmatch(r"\s*([A-Za-z_]\w*)\s*(<=|>=|==|!=|<|>)\s*([+-]?[\w.+-]+)\s*", text)
    if not m:
        raise ParseError(f"Parse failed at {text!r}")
    return m[1], m[2], m[3]


def nanoseconds(column: Column, kind: str) -> Column:
    """A time column as nanoseconds since 1970: a number of them, an instant, or a wall time taken as UTC."""
    if kind == "long":
        return column
    instant = column.cast("timestamp")
    if kind == "timestamp_ntz":  # the cast reads it in the session's zone
        instant = F.from_utc_timestamp(instant, F.current_timezone())
    return F.unix_micros(instant) * 1000


def time_literal(ns: int, kind: str, up: bool) -> Column:
    """A constant to compare a time column with, rounded up or down to what the column can hold."""
    if kind == "long":
        return F.lit(ns)
    micros = -(-ns // 1000) if up else ns // 1000
    if kind == "timestamp_ntz":
        wall = datetime(1970, 1, 1) + timedelta(microseconds=micros)
        return F.expr(f"TIMESTAMP_NTZ '{wall:%Y-%m-%d %H:%M:%S.%f}'")
    return F.timestamp_micros(F.lit(micros))


class Multilog:
    """``rows`` must hold the schema's columns and ``log_offset``; other columns pass through."""

    def __init__(self, rows: DataFrame, schema: LogSchema, name: str = "log", time_resolution_ns: int = MILLISECOND, monitor_window_ms: int = 10, monitor_period_ms: int = 1):
        self.rows, self.schema, self.name = rows, schema, name
        self.time_resolution_ns, self.monitor_window_ms, self.monitor_period_ms = time_resolution_ns, monitor_window_ms, monitor_period_ms
        self.filters: dict[str, NamedFilter] = {}
        self.aggregates: dict[str, NamedAggregate] = {}
        self.triggers: dict[str, Trigger] = {}
        self.indexes: dict[str, float] = {}
        self.numbered_by: str | None = None

    @classmethod
    def from_dataframe(cls, rows: DataFrame, time_column: str, offset: Column | str | None = None, record_size: int | None = None, **options) -> Multilog:
        """A log over a table that exists. ``offset`` gives each row's place in bytes; without one only version-free reads work.

        The name of a column that numbers the rows from 0 is best: versions and places become bounds of that column, which
        scans skip files by.
        """
        schema = schema_of(rows.schema, time_column, record_size)
        if isinstance(offset, str):
            log = cls(rows.withColumn(OFFSET, F.col(f"`{offset}`").cast("long") * schema.record_size), schema, **options)
            log.numbered_by = offset
            return log
        if offset is not None:
            rows = rows.withColumn(OFFSET, offset.cast("long"))
        return cls(rows, schema, **options)

    # --- reads by place -------------------------------------------------------------------------------------------

    @property
    def record_size(self) -> int:
        return self.schema.record_size

    def version(self) -> int:
        """The end of the log."""
        return self.rows.agg(F.max(OFFSET)).first()[0] + self.record_size if not self.rows.isEmpty() else 0

    def num_records(self) -> int:
        return self.rows.count()

    def placed(self, rows: DataFrame, low: int | None = None, high: int | None = None) -> DataFrame:
        """Rows from place ``low`` on and before place ``high``."""
        column, size = (F.col(OFFSET), 1) if self.numbered_by is None else (F.col(f"`{self.numbered_by}`"), self.record_size)
        if low is not None:
            rows = rows.where(column >= F.lit(-(-low // size)))
        return rows if high is None else rows.where(column < F.lit(-(-high // size)))

    def snapshot(self, version: int) -> DataFrame:
        """Rows visible at a version."""
        return self.placed(self.rows, high=version - self.record_size + 1)

    def read(self, offset: int, version: int | None = None) -> DataFrame:
        """The row at a place, if there is one and it is visible at ``version``."""
        if version is not None and offset + self.record_size > version:
            return self.rows.limit(0)
        return self.read_many([offset])

    def read_raw(self, offset: int, version: int | None = None) -> bytes | None:
        """The record at a place as its packed bytes (little-endian, strings padded with zeros); None if there is none."""
        row = self.read(offset, version).first()
        return None if row is None else b"".join(c.type.pack(row[c.name]) for c in self.schema.columns)

    def read_many(self, offsets: list[int]) -> DataFrame:
        if self.numbered_by is None:
            return self.rows.where(F.col(OFFSET).isin(offsets))
        return self.rows.where(F.col(f"`{self.numbered_by}`").isin([o // self.record_size for o in offsets if o % self.record_size == 0]))

    def read_batch(self, offset: int, count: int) -> DataFrame:
        """``count`` rows from a place on, fewer at the end of the log."""
        return self.placed(self.rows, offset, offset + (count - 1) * self.record_size + 1)

    def scan(self) -> DataFrame:
        """All rows in the order they were appended."""
        return self.rows.orderBy(OFFSET)

    # --- time -----------------------------------------------------------------------------------------------------

    def time_ns(self) -> Column:
        """The row's time in nanoseconds, from a nanosecond number or a Spark timestamp."""
        return nanoseconds(F.col(f"`{self.schema.time_column}`"), self.time_kind())

    def time_kind(self) -> str:
        return self.rows.schema[self.schema.time_column].dataType.typeName()

    def time_bucket(self) -> Column:
        return F.call_function("div", self.time_ns(), F.lit(self.time_resolution_ns).cast("long"))

    def in_buckets(self, rows: DataFrame, begin: int | None, end: int | None) -> DataFrame:
        """Rows of time buckets ``begin`` to ``end``, both included. Bounds go to the stored column, so scans skip files."""
        if begin is None and end is None:
            return rows
        column = F.col(f"`{self.schema.time_column}`")
        kind, res = self.time_kind(), self.time_resolution_ns
        if begin is not None:
            rows = rows.where(column >= time_literal(begin * res, kind, up=True))
        if end is not None:
            rows = rows.where(column < time_literal((end + 1) * res, kind, up=True))
        return rows

    # --- ad hoc ---------------------------------------------------------------------------------------------------

    def execute_filter(self, expression: str, version: int | None = None) -> DataFrame:
        return (self.rows if version is None else self.snapshot(version)).where(compiled(expression, self.schema))

    def _aggregate_parts(self, expression: str) -> tuple[Aggregate, Column]:
        name, column = parse_aggregate(expression)
        return AGGREGATES.get(name), F.col(f"`{self.schema[column].name}`")

    def execute_aggregate(self, expression: str, filter_expression: str = "", out: str = "value", version: int | None = None) -> DataFrame:
        made, column = self._aggregate_parts(expression)
        return aggregate(self.execute_filter(filter_expression, version), made, column, out)

    def execute_aggregates(self, expressions: dict[str, str], filter_expression: str = "") -> DataFrame:
        """Several aggregates of one scan, by output name; expressions only, not folds."""
        columns = []
        for out, text in expressions.items():
            made, column = self._aggregate_parts(text)
            columns.append(made.whole(column).alias(out))
        return self.execute_filter(filter_expression).agg(*columns)

    # --- registry -------------------------------------------------------------------------------------------------

    def add_index(self, column: str, bucket_size: float = 1.0) -> None:
        """Indexes say how a column is bucketed. Results never depend on them; compaction sorts files by them."""
        key = self.schema[column].name
        if key in self.indexes:
            raise InvalidOperation(f"Could not index {column}: already indexed")
        self.indexes[key] = bucket_size

    def remove_index(self, column: str) -> None:
        if self.indexes.pop(self.schema[column].name, None) is None:
            raise InvalidOperation(f"Could not remove index for {column}: No index exists")

    def is_indexed(self, column: str) -> bool:
        return self.schema[column].name in self.indexes

    def add_filter(self, name: str, expression: str = "", function: Callable[[DataFrame], Column] | None = None, since: int = 0) -> None:
        """``since``: rows before that place don't count. ``function`` gives a further condition from the DataFrame."""
        if name in self.filters:
            raise InvalidOperation(f"Filter {name} already exists.")
        compiled(expression, self.schema)
        self.filters[name] = NamedFilter(name, expression, since, function)

    def remove_filter(self, name: str) -> None:
        self._known(self.filters, "Filter", name)
        del self.filters[name]

    def add_aggregate(self, name: str, filter_name: str, expression: str, since: int = 0) -> None:
        if name in self.aggregates:
            raise InvalidOperation(f"Aggregate {name} already exists.")
        self._known(self.filters, "Filter", filter_name)
        self._aggregate_parts(expression)
        self.aggregates[name] = NamedAggregate(name, filter_name, expression, since)

    def remove_aggregate(self, name: str) -> None:
        self._known(self.aggregates, "Aggregate", name)
        del self.aggregates[name]

    def install_trigger(self, name: str, expression: str, periodicity_ms: int = 1) -> None:
        if name in self.triggers:
            raise InvalidOperation(f"Trigger {name} already exists.")
        if periodicity_ms < self.monitor_period_ms or periodicity_ms % self.monitor_period_ms:
            raise InvalidOperation("Trigger periodicity must be a multiple of the monitor's")
        source, op, number = parse_trigger(expression)
        self._known(self.aggregates, "Aggregate", source)
        self._threshold(source, number)
        self.triggers[name] = Trigger(name, source, op, number, periodicity_ms)

    def remove_trigger(self, name: str) -> None:
        self._known(self.triggers, "Trigger", name)
        del self.triggers[name]

    @staticmethod
    def _known(registry: dict, what: str, name: str):
        if name not in registry:
            raise InvalidOperation(f"{what} {name} does not exist.")
        return registry[name]

    def _threshold(self, aggregate_name: str, number: str):
        made, _ = self._aggregate_parts(self.aggregates[aggregate_name].expression)
        return made.result, made.result.parse(number)

    # --- registered objects ---------------------------------------------------------------------------------------

    def query_filter(self, name: str, begin: int | None = None, end: int | None = None, expression: str = "", since: int = 0) -> DataFrame:
        """Rows of a named filter in time buckets ``begin`` to ``end``, both included, that satisfy ``expression`` too."""
        named = self._known(self.filters, "Filter", name)
        rows = self.in_buckets(self.rows, begin, end)
        since = max(since, named.since)
        if since:
            rows = self.placed(rows, since)
        rows = rows.where(compiled(named.expression, self.schema))
        if named.function is not None:
            rows = rows.where(named.function(rows))
        return rows.where(compiled(expression, self.schema)) if expression else rows

    def lookup(self, name: str, time_bucket: int) -> DataFrame:
        return self.query_filter(name, time_bucket, time_bucket)

    def aggregate_buckets(self, name: str, begin: int | None = None, end: int | None = None, out: str = "value") -> DataFrame:
        """A named aggregate's value in each time bucket that has rows."""
        named = self._known(self.aggregates, "Aggregate", name)
        made, column = self._aggregate_parts(named.expression)
        rows = self.query_filter(named.filter, begin, end, since=named.since).withColumn("time_bucket", self.time_bucket())
        return aggregate(rows, made, column, out, ["time_bucket"])

    def get_aggregate(self, name: str, begin: int | None = None, end: int | None = None, out: str = "value") -> DataFrame:
        named = self._known(self.aggregates, "Aggregate", name)
        made, column = self._aggregate_parts(named.expression)
        return aggregate(self.query_filter(named.filter, begin, end, since=named.since), made, column, out)

    def trigger_text(self, name: str) -> str:
        t = self._known(self.triggers, "Trigger", name)
        type_, value = self._threshold(t.aggregate, t.threshold)
        return f"{t.aggregate} {t.op} {typed_text(type_, value)}"

    def checked_at(self, time_bucket: Column, periodicity_ms: int) -> Column:
        """When a bucket is checked, in milliseconds: at the first multiple of the periodicity that its end doesn't pass."""
        ms = lambda ns: F.call_function("div", ns, F.lit(MILLISECOND).cast("long"))
        last, by = ms((time_bucket + 1) * self.time_resolution_ns - 1), F.lit(periodicity_ms).cast("long")
        return F.call_function("div", last + by - 1, by) * by

    def get_alerts(self, begin: int | None = None, end: int | None = None, trigger: str = "", arrival: Column | None = None) -> DataFrame:
        """(time_bucket, trigger_name, trigger_expr, value): buckets whose aggregate satisfies a trigger, once each.

        Each bucket is checked as it is now. With ``arrival`` (nanoseconds) it is checked as the monitor saw it: by the
        trigger's periodicity, and again for the monitor's window; rows that arrived later raise no alert. Triggers on
        aggregates of one filter share one scan and one grouping.
        """
        chosen = [self._known(self.triggers, "Trigger", trigger)] if trigger else [self.triggers[n] for n in sorted(self.triggers)]
        if not chosen:
            raise InvalidOperation("No trigger is installed.")
        shared: dict[tuple, list[Trigger]] = {}
        for t in chosen:
            named = self.aggregates[t.aggregate]
            fold = self._aggregate_parts(named.expression)[0].whole is None
            shared.setdefault((named.filter, named.since, t.aggregate if fold else "", t.periodicity_ms if arrival is not None else 0), []).append(t)
        found = []
        for (filter_name, since, fold, period), triggers in shared.items():
            rows = self.query_filter(filter_name, begin, end, since=since).withColumn("time_bucket", self.time_bucket())
            if arrival is not None:
                rows = rows.where(arrival < (self.checked_at(F.col("time_bucket"), period) + self.monitor_window_ms + 1) * MILLISECOND)
            if fold:
                made, column = self._aggregate_parts(self.aggregates[fold].expression)
                buckets = aggregate(rows, made, column, f"agg_{fold}", ["time_bucket"])
            else:
                values = {}
                for t in triggers:
                    made, column = self._aggregate_parts(self.aggregates[t.aggregate].expression)
                    values[t.aggregate] = made.whole(column).alias(f"agg_{t.aggregate}")
                buckets = rows.groupBy("time_bucket").agg(*values.values())
            hits = []
            for t in triggers:
                type_, bound = self._threshold(t.aggregate, t.threshold)
                value = F.col(f"agg_{t.aggregate}")
                hit = compare(t.op, value, type_.lit(bound) if type_.name != "ULONG" else F.lit(int(bound)), type_.name == "DOUBLE")
                fields = F.struct(F.lit(t.name).alias("trigger_name"), F.lit(self.trigger_text(t.name)).alias("trigger_expr"), value.cast("double").alias("value"))
                hits.append(F.when(hit, fields))
            each = buckets.select("time_bucket", F.explode(F.array_compact(F.array(*hits))).alias("a"))
            found.append(each.select("time_bucket", "a.trigger_name", "a.trigger_expr", "a.value"))
        return reduce(DataFrame.unionByName, found)

    def alert_texts(self, alerts: DataFrame) -> DataFrame:
        """Alerts with their text form."""
        text = F.format_string(
            '{ timestamp: %s, trigger-name: "%s", trigger-expression: "%s", trigger-value: "%s" }',
            F.col("time_bucket").cast("string"), "trigger_name", "trigger_expr", F.format_string("double(%s)", F.format_string("%.6f", "value")),
        )
        return alerts.withColumn("alert", text)

    # --- indexes --------------------------------------------------------------------------------------------------

    def index_bucket(self, column: str, bucket_size: float | None = None) -> Column:
        c = self.schema[column]
        return bucket(F.col(f"`{c.name}`"), c.type, self.indexes.get(c.name, 1.0) if bucket_size is None else bucket_size)

    def index_histogram(self, column: str, bucket_size: float | None = None) -> DataFrame:
        """(bucket, n): how many rows each key of an index has."""
        return self.rows.groupBy(self.index_bucket(column, bucket_size).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))

    def in_index(self, column: str, begin, end, bucket_size: float | None = None) -> DataFrame:
        """Rows whose index key is in a range. Its bounds go to the stored column too, so scans skip files."""
        c = self.schema[column]
        size = self.indexes.get(c.name, 1.0) if bucket_size is None else bucket_size
        rows = self.rows.where(bucket_bounds(F.col(f"`{c.name}`"), c.type, begin, end, size))
        return rows.where(self.index_bucket(column, size).between(begin, end)) if c.type.numeric else rows

    def approx_count(self, column: str, begin: int, end: int, bucket_size: float | None = None) -> DataFrame:
        return self.in_index(column, begin, end, bucket_size).agg(F.count(F.lit(1)).alias("n"))

    def index_scan(self, column: str, begin: int, end: int, bucket_size: float | None = None) -> DataFrame:
        """Rows of an index range in index order, then in append order."""
        return self.in_index(column, begin, end, bucket_size).orderBy(self.index_bucket(column, bucket_size), OFFSET)

    def at(self, rows: DataFrame) -> Multilog:
        """The same definitions over other rows (a snapshot, say)."""
        other = Multilog(rows, self.schema, self.name, self.time_resolution_ns, self.monitor_window_ms, self.monitor_period_ms)
        other.numbered_by = self.numbered_by
        other.filters, other.aggregates, other.triggers, other.indexes = dict(self.filters), dict(self.aggregates), dict(self.triggers), dict(self.indexes)
        return other

    def as_of(self, version: int) -> Multilog:
        return self.at(self.snapshot(version))

    def backfilled(self) -> Multilog:
        """The same log with every filter and aggregate counting from the log's start."""
        other = self.at(self.rows)
        other.filters = {k: replace(v, since=0) for k, v in self.filters.items()}
        other.aggregates = {k: replace(v, since=0) for k, v in self.aggregates.items()}
        return other
