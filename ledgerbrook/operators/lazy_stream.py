"""Functional operators over a lazy sequence of rows, a thin layer on DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.storagelevel import StorageLevel

from ledgerbrook.functions.aggregates import FOLDED

#: Runs of ``FOLDED`` rows that an ordered fold takes in one step.
CHAINED = 32


class LazyStream:
    """``order``: columns that put the rows in sequence, for take, head and tail."""

    def __init__(self, df: DataFrame, order: list[str] | None = None):
        self.df, self.order = df, order or []

    @classmethod
    def of(cls, spark: SparkSession, values, kind: T.DataType) -> LazyStream:
        """A stream of plain values in a column ``value``, in their order."""
        schema = T.StructType([T.StructField("at", T.LongType(), False), T.StructField("value", kind)])
        return cls(spark.createDataFrame(list(enumerate(values)), schema), ["at"])

    def _ordered(self) -> DataFrame:
        return self.df.orderBy(*self.order) if self.order else self.df

    def map(self, **columns: Column) -> LazyStream:
        """New columns, computed from the old ones, instead of them."""
        hidden = [c for c in self.order if c not in columns]
        return LazyStream(self.df.select(*hidden, *[v.alias(k) for k, v in columns.items()]), self.order)

    def map_rows(self, function: Callable[[Iterator], Iterator], schema) -> LazyStream:
        """For functions that no expression states: batches of pandas rows in, batches out."""
        return LazyStream(self.df.mapInPandas(function, schema))

    def filter(self, condition: Column) -> LazyStream:
        return LazyStream(self.df.where(condition), self.order)

    def flat_map(self, items: Column, out: str, keep: list[str] | None = None) -> LazyStream:
        """A row for each item of an array, with the columns of ``keep``."""
        keep = list(dict.fromkeys([*(keep or []), *self.order]))
        return LazyStream(self.df.select(*keep, F.explode(items).alias(out)), self.order)

    def flatten(self, column: str) -> LazyStream:
        return self.flat_map(F.col(column), column)

    def distinct(self, *columns: str) -> LazyStream:
        return LazyStream(self.df.select(*(columns or [c for c in self.df.columns if c not in self.order])).distinct())

    def concat(self, other: LazyStream) -> LazyStream:
        return LazyStream(self.df.unionByName(other.df))

    def take(self, n: int) -> LazyStream:
        return LazyStream(self._ordered().limit(n), self.order)

    def fold_left(self, start: Column, step: Callable[[Column, Column], Column], column: str) -> Column | object:
        """Fold values in sequence.

        An ordered fold can't be split, so a state goes from run to run. The rows are sorted and gathered in runs of at most
        ``FOLDED`` rows on the executors, staged; each step folds at most ``CHAINED`` of them in one task, and only their
        values are in memory. The driver sees the states alone.
        """
        spark = self.df.sparkSession
        first = spark.range(1).select(start.alias("state"))
        state, held = first.first()[0], first.schema[0].dataType
        at = F.monotonically_increasing_id()  # of sorted rows: the partition's number, then the row's place in it
        values = self._ordered().select(F.col(column).alias("value")).select(at.alias("at"), "value")
        listed = F.collect_list(F.struct("at", "value"))
        plain = "map<" not in values.schema["value"].dataType.simpleString()  # maps have no order
        placed = F.sort_array(listed) if plain else F.array_sort(listed, lambda x, y: (x["at"] - y["at"]).cast("int"))
        each = values.groupBy(F.floor(F.col("at") / FOLDED).alias("run")).agg(placed.alias("items"))
        runs = each.select("run", F.col("items.value").alias("items")).persist(StorageLevel.DISK_ONLY)
        try:
            numbers = sorted(r.run for r in runs.select("run").collect())
            for k in range(0, len(numbers), CHAINED):
                some = runs.where(F.col("run").between(numbers[k], numbers[min(k + CHAINED, len(numbers)) - 1]))
                listed = F.collect_list(F.struct("run", "items"))
                part = some.agg((F.sort_array(listed) if plain else F.array_sort(listed, lambda x, y: F.signum(x["run"] - y["run"]).cast("int"))).alias("runs"))
                before = spark.createDataFrame([(state,)], T.StructType([T.StructField("state", held)]))
                chain = F.aggregate("runs", F.col("state"), lambda a, r: F.aggregate(r["items"], a, step))
                state = before.crossJoin(part).select(chain.alias("state")).first()[0]
        finally:
            runs.unpersist()
        return state

    def for_each(self, function: Callable[[Row], None]) -> None:
        for row in self._ordered().toLocalIterator():
            function(row)

    def size(self) -> int:
        return self.df.count()

    def empty(self) -> bool:
        return self.df.isEmpty()

    def head(self) -> Row:
        first = self._ordered().first()
        if first is None:
            raise IndexError("the stream is empty")
        return first

    def tail(self) -> LazyStream:
        """All but the first row, by the order columns (which must tell rows apart)."""
        first = self.head()
        key = F.struct(*[F.col(c) for c in self.order])
        least = F.struct(*[F.lit(first[c]).cast(self.df.schema[c].dataType).alias(c) for c in self.order])
        return LazyStream(self.df.where(key > least), self.order)

    def to_list(self) -> list[Row]:
        return self._ordered().collect()
