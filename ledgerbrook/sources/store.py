"""A store: named logs under one folder, each parquet parts and numbered JSON manifests.

A manifest is one version of a log: its schema, its end in bytes (the read tail), its parts and its named objects. A write
puts parts first and then creates the next manifest; readers see all of a batch or nothing, and of two writers that race
one fails and retries. Parts are written sorted by time, so scans skip files by their statistics.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.storagelevel import StorageLevel

from ledgerbrook.errors import InvalidOperation, ManagementError
from ledgerbrook.functions.types import REGISTRY, TypeRegistry
from ledgerbrook.operators.schema import LogSchema, SchemaBuilder, parse_schema
from ledgerbrook.sources.files import Files
from ledgerbrook.sources.multilog import MILLISECOND, OFFSET, Multilog, NamedAggregate, NamedFilter, Trigger

MODES = ("IN_MEMORY", "DURABLE_RELAXED", "DURABLE")
#: Codecs for compaction, by name.
CODECS = {"NONE": "none", "LZ4": "lz4_raw", "ZSTD": "zstd", "SNAPPY": "snappy"}


class StoredLog(Multilog):
    """A log in a store. Definitions made here count rows appended later only, as ``since`` records; they are kept too."""

    def __init__(self, store: Store, name: str, manifest: dict, number: int):
        self._store, self._folder = store, f"{store.path}/{name}"
        self._files = Files(store.spark, self._folder)
        self._manifest, self._number, self._cached = manifest, number, None
        builder = SchemaBuilder(store.registry)
        for c in manifest["schema"]:
            builder.add(c["name"], c["type"])
        super().__init__(self._read(builder.build(), manifest), builder.build(), name, manifest["time_resolution_ns"], manifest.get("monitor_window_ms", 10))
        self.filters = {k: NamedFilter(**v) for k, v in manifest["filters"].items()}
        self.aggregates = {k: NamedAggregate(**v) for k, v in manifest["aggregates"].items()}
        self.triggers = {k: Trigger(**v) for k, v in manifest["triggers"].items()}
        self.indexes = dict(manifest["indexes"])

    def _read(self, schema: LogSchema, manifest: dict) -> DataFrame:
        struct = schema.struct().add(OFFSET, T.LongType(), False)
        if not manifest["parts"]:
            return self._store.spark.createDataFrame([], struct)
        rows = self._store.spark.read.schema(struct).parquet(*[f"{self._folder}/{p}" for p in manifest["parts"]])
        if manifest["mode"] == "IN_MEMORY":
            if self._cached is not None:
                self._cached.unpersist()
            self._cached = rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
        return rows

    def close(self) -> None:
        """Give up what an IN_MEMORY log keeps in memory."""
        if self._cached is not None:
            self._cached.unpersist()
            self._cached = None

    @property
    def tail(self) -> int:
        """The end of the log as of this handle; ``refresh`` moves it on."""
        return self._manifest["tail"]

    def version(self) -> int:
        return self.tail

    def num_records(self) -> int:
        return self.tail // self.record_size

    def refresh(self) -> StoredLog:
        fresh = self._store.get(self.name)
        if fresh._number == self._number:
            fresh.close()
            return self
        self.close()
        self.__dict__.update(fresh.__dict__)
        return self

    def _commit(self, **changes) -> None:
        changed = self._manifest | changes
        named = {k: {n: {f: v for f, v in asdict(o).items() if f != "function"} for n, o in getattr(self, k).items()} for k in ("filters", "aggregates", "triggers")}
        changed |= named | {"indexes": self.indexes}
        if not self._files.create(f"manifest-{self._number + 1:012d}.json", json.dumps(changed)):
            raise ManagementError(f"{self.name} was changed by another writer; refresh and try again.")
        self._manifest, self._number = changed, self._number + 1

    # --- appends --------------------------------------------------------------------------------------------------

    def append(self, rows: DataFrame | list) -> int:
        """Append a DataFrame with the schema's columns, or records (lists of texts). Returns the first row's offset.

        Rows go in by time block, in the order they came within a block. Nulls are refused.
        """
        if not isinstance(rows, DataFrame):
            values = [tuple(self.schema.parse_record([str(v) for v in r])) for r in rows]
            rows = self._store.spark.createDataFrame(values, self.schema.struct())
        missing = [c.name for c in self.schema.columns if c.name.upper() not in {x.upper() for x in rows.columns}]
        if missing:
            raise InvalidOperation(f"Record does not match schema: no {', '.join(missing)}")
        rows = rows.select([F.col(f"`{c.name}`").cast(c.type.spark).alias(c.name) for c in self.schema.columns])
        block = F.call_function("div", F.col(self.schema.time_column), F.lit(self.time_resolution_ns).cast("long"))
        # Sorted by block and arrival, and written. Places follow from what was written, so a task that runs again can't
        # disagree with them.
        rows = rows.withColumn("arrival", F.monotonically_increasing_id()).withColumn("block", block).sort("block", "arrival")
        rows = rows.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
        staged, name = f"staged-{uuid.uuid4().hex}", f"part-{uuid.uuid4().hex}"
        try:
            rows.drop("arrival", "block").write.parquet(f"{self._folder}/{staged}")
            rows = self._store.spark.read.parquet(f"{self._folder}/{staged}")
            bad = F.sum(F.when(F.greatest(*[F.col(f"`{c.name}`").isNull().cast("int") for c in self.schema.columns]) > 0, 1).otherwise(0))
            counts = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"), bad.alias("bad")).orderBy("part").collect()  # a row per partition
            if any(r.bad for r in counts):
                raise InvalidOperation("a record holds a null")
            before, starts = 0, []
            for r in counts:
                starts.append((r.part, before))
                before += r["n"]
            if not before:
                return self.tail
            first = self.tail
            start = self._store.spark.createDataFrame(starts, "part int, start long")
            placed = rows.join(F.broadcast(start), "part").withColumn(OFFSET, F.lit(first) + (F.col("start") + F.col("at")) * self.record_size)
            placed.select(*[c.name for c in self.schema.columns], OFFSET).write.option("compression", "snappy").parquet(f"{self._folder}/{name}")
        finally:
            self._files.delete(staged)
        tail = first + before * self.record_size
        self._commit(tail=tail, parts=[*self._manifest["parts"], name], ranges=self._manifest.get("ranges", {}) | {name: [first, tail]})
        self.rows = self._read(self.schema, self._manifest)
        every = self._manifest.get("archive_every")
        if every and tail - self._manifest["archived"] >= every:
            self.archive()
        return first

    append_batch = append

    def batch(self) -> BatchBuilder:
        return BatchBuilder(self)

    # --- definitions are kept ---------------------------------------------------------------------------------------

    def add_index(self, column: str, bucket_size: float = 1.0) -> None:
        super().add_index(column, bucket_size)
        self._commit()

    def remove_index(self, column: str) -> None:
        super().remove_index(column)
        self._commit()

    def add_filter(self, name: str, expression: str = "", function=None, since: int | None = None) -> None:
        super().add_filter(name, expression, function, self.tail if since is None else since)
        self._commit()

    def remove_filter(self, name: str) -> None:
        super().remove_filter(name)
        self._commit()

    def add_aggregate(self, name: str, filter_name: str, expression: str, since: int | None = None) -> None:
        super().add_aggregate(name, filter_name, expression, self.tail if since is None else since)
        self._commit()

    def remove_aggregate(self, name: str) -> None:
        super().remove_aggregate(name)
        self._commit()

    def install_trigger(self, name: str, expression: str, periodicity_ms: int = 1) -> None:
        super().install_trigger(name, expression, periodicity_ms)
        self._commit()

    def remove_trigger(self, name: str) -> None:
        super().remove_trigger(name)
        self._commit()

    # --- archival -------------------------------------------------------------------------------------------------

    def archive(self, upto: int | None = None, codec: str = "ZSTD", files: int | None = None) -> None:
        """Rewrite the rows before ``upto`` (default: all) compactly, sorted by the first indexed column or by time.

        What was archived before stays as it is, and so do parts from ``upto`` on; a part across ``upto`` is split. A log
        created with ``archive_every`` does this by itself whenever so many bytes aren't archived.
        """
        upto = self.tail if upto is None else min(upto, self.tail)
        done, ranges = self._manifest["archived"], self._manifest.get("ranges", {})
        if upto <= done:
            return
        key = self.index_bucket(next(iter(self.indexes))) if self.indexes else F.col(self.schema.time_column)
        struct, kept, touched = self.schema.struct().add(OFFSET, T.LongType(), False), [], []
        for p in self._manifest["parts"]:
            low, high = ranges.get(p, [0, self.tail])
            (touched if high > done and low < upto else kept).append(p)
        rows = self._store.spark.read.schema(struct).parquet(*[f"{self._folder}/{p}" for p in touched])
        parts, ends = [], [ranges.get(p, [0, self.tail]) for p in touched]
        for low, high, compression in ((min(a for a, _ in ends), upto, CODECS[codec]), (upto, max(b for _, b in ends), "snappy")):
            if low >= high:
                continue
            own = rows.where((F.col(OFFSET) >= low) & (F.col(OFFSET) < high))
            own = own.repartitionByRange(files, key) if files else own.repartitionByRange(key)
            name = f"part-{uuid.uuid4().hex}"
            own.sortWithinPartitions(key, OFFSET).write.option("compression", compression).parquet(f"{self._folder}/{name}")
            parts.append((name, [low, high]))
        names = [*kept, *(n for n, _ in parts)]
        self._commit(parts=names, archived=upto, ranges={p: r for p, r in (ranges | dict(parts)).items() if p in names})
        self.rows = self._read(self.schema, self._manifest)

    def vacuum(self) -> None:
        """Delete parts that the newest manifest doesn't name."""
        for name in self._files.names():
            if name.startswith(("part-", "staged-")) and name not in self._manifest["parts"]:
                self._files.delete(name)


class BatchBuilder:
    """Collects records and appends them at once."""

    def __init__(self, log: StoredLog):
        self._log, self._records = log, []

    def add_record(self, values: list) -> BatchBuilder:
        self._records.append(values)
        return self

    @property
    def num_records(self) -> int:
        return len(self._records)

    def blocks(self) -> dict[int, int]:
        """Records per time block."""
        out: dict[int, int] = {}
        for r in self._records:
            b = self._log.schema.parse_record([str(v) for v in r])[0] // self._log.time_resolution_ns
            out[b] = out.get(b, 0) + 1
        return dict(sorted(out.items()))

    def append(self) -> int:
        records, self._records = self._records, []
        return self._log.append(records)


class Store:
    def __init__(self, spark: SparkSession, path: str, registry: TypeRegistry = REGISTRY):
        self.spark, self.path, self.registry = spark, path.rstrip("/"), registry
        self._files = Files(spark, self.path)

    def create(self, name: str, schema: LogSchema | str, mode: str = "DURABLE", time_resolution_ns: int = MILLISECOND, monitor_window_ms: int = 10, archive_every: int | None = None) -> StoredLog:
        """A new log. IN_MEMORY logs keep their rows in executors' memory too; both durable modes write before an append returns."""
        if mode not in MODES:
            raise InvalidOperation(f"unknown storage mode {mode}")
        if self.exists(name):
            raise ManagementError(f"Table {name} already exists.")
        schema = parse_schema(schema, self.registry) if isinstance(schema, str) else schema
        manifest = {
            "id": uuid.uuid4().hex, "mode": mode, "tail": 0, "archived": 0, "parts": [], "time_resolution_ns": time_resolution_ns,
            "monitor_window_ms": monitor_window_ms, "archive_every": archive_every, "ranges": {},
            "schema": [{"name": c.name, "type": c.type.spelled()} for c in schema.columns], "filters": {}, "aggregates": {}, "triggers": {}, "indexes": {},
        }
        if not Files(self.spark, f"{self.path}/{name}").create("manifest-000000000000.json", json.dumps(manifest)):
            raise ManagementError(f"Table {name} already exists.")
        return self.get(name)

    def exists(self, name: str) -> bool:
        return any(n.startswith("manifest-") for n in self._files.names(name))

    def get(self, name: str) -> StoredLog:
        """A log as its newest manifest has it."""
        found = [n for n in self._files.names(name) if n.startswith("manifest-")]
        if not found:
            raise ManagementError(f"No such atomic multilog {name}")
        return StoredLog(self, name, json.loads(self._files.read(f"{name}/{found[-1]}")), int(found[-1][9:-5]))

    load = get

    def get_by_id(self, identity: str) -> StoredLog:
        for name in self.list():
            log = self.get(name)
            if log._manifest["id"] == identity:
                return log
        raise ManagementError(f"No such atomic multilog {identity}")

    def id_of(self, name: str) -> str:
        return self.get(name)._manifest["id"]

    def list(self) -> list[str]:
        return [n for n in self._files.names() if self.exists(n)]

    def remove(self, name: str) -> None:
        if not self.exists(name):
            raise ManagementError(f"No such atomic multilog {name}")
        self._files.delete(name)

    def archive(self) -> None:
        for name in self.list():
            self.get(name).archive()


class Client:
    """The verbs of a remote client over a store, with a current log; rows come in pages."""

    PAGE = 20

    def __init__(self, store: Store):
        self._store, self._log = store, None

    def create_atomic_multilog(self, name: str, schema: str, mode: str = "IN_MEMORY") -> None:
        self._log = self._store.create(name, schema, mode)

    def set_current_atomic_multilog(self, name: str) -> None:
        self._log = self._store.get(name)

    def remove_atomic_multilog(self) -> None:
        self._store.remove(self.log.name)
        self._log = None

    @property
    def log(self) -> StoredLog:
        if self._log is None:
            raise InvalidOperation("Must set atomic multilog first")
        return self._log

    def __getattr__(self, name: str):
        return getattr(self.log, name)

    def pages(self, rows: DataFrame):
        """Rows a page at a time, in append order."""
        page = []
        for row in rows.orderBy(OFFSET).toLocalIterator():
            page.append(row)
            if len(page) == self.PAGE:
                yield page
                page = []
        if page:
            yield page
