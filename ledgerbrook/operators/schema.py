"""Schemas of logs: a declared, fixed list of typed columns whose first is always TIMESTAMP (nanoseconds)."""

from __future__ import annotations

import re
import time
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerbrook.errors import InvalidOperation, ParseError
from ledgerbrook.functions.types import REGISTRY, TIMESTAMP, LogType, TypeRegistry, type_of


@dataclass(frozen=True)
class LogColumn:
    name: str
    type: LogType
    least: object = None
    greatest: object = None


class LogSchema:
    """Columns by name, whatever the case. ``record_size`` is the bytes of a packed record."""

    def __init__(self, columns: list[LogColumn], time_column: str = "TIMESTAMP"):
        self.columns, self.time_column = columns, time_column
        self._at = {c.name.upper(): c for c in columns}
        if len(self._at) != len(columns):
            raise InvalidOperation("two columns have the same name")
        self.record_size = sum(c.type.width for c in columns)

    def __getitem__(self, name: str) -> LogColumn:
        if name.upper() not in self._at:
            raise InvalidOperation(f"No such attribute {name}")
        return self._at[name.upper()]

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, c.type.spark, False, {"log_type": c.type.name, "width": c.type.width}) for c in self.columns])

    def spelled(self) -> str:
        return "{ " + ", ".join(f"{c.name}: {c.type.spelled()}" for c in self.columns) + " }"

    def parse_record(self, values: list[str], now: int | None = None) -> list:
        """A record's values from their texts; without a time it gets the present one."""
        if len(values) == len(self.columns) - 1:
            values = [str(time.time_ns() if now is None else now), *values]
        if len(values) != len(self.columns):
            raise InvalidOperation("Record does not match schema")
        return [c.type.parse(v) for c, v in zip(self.columns, values, strict=True)]

    def texts(self) -> Column:
        """The columns of a row as an array of their text forms."""
        return F.array(*[c.type.show(F.col(f"`{c.name}`")) for c in self.columns])


class SchemaBuilder:
    """Collects columns; names are upper-cased and TIMESTAMP is put in front if it isn't declared."""

    def __init__(self, registry: TypeRegistry = REGISTRY):
        self._columns: list[LogColumn] = []
        self._registry = registry

    def add(self, name: str, type_: LogType | str, least=None, greatest=None) -> SchemaBuilder:
        if isinstance(type_, str):
            type_ = self._registry.get(type_)
        name = name.upper()
        if name == "TIMESTAMP":
            if type_.name != "ULONG":
                raise InvalidOperation("TIMESTAMP must be of ULONG type")
            type_ = TIMESTAMP
        self._columns.append(LogColumn(name, type_, type_.least if least is None else least, type_.greatest if greatest is None else greatest))
        return self

    def build(self) -> LogSchema:
        own = [c for c in self._columns if c.name == "TIMESTAMP"]
        first = own[0] if own else LogColumn("TIMESTAMP", TIMESTAMP, TIMESTAMP.least, TIMESTAMP.greatest)
        return LogSchema([first, *(c for c in self._columns if c.name != "TIMESTAMP")])


def parse_schema(text: str, registry: TypeRegistry = REGISTRY) -> LogSchema:
    """``{ name: TYPE, name: TYPE(width), ... }`` with two columns at least."""
    m = re.fullmatch(r"\s*\{(.*)\}\s*", text, re.S)
    items = [x.strip() for x in m[1].split(",")] if m else []
    if len(items) < 2:
        raise ParseError(f"Parse failed at {text!r}: a schema lists two columns at least")
    builder = SchemaBuilder(registry)
    for item in items:
        found = re.fullmatch(r"([A-Za-z_]\w*)\s*:\s*([A-Za-z0-9()]+)", item)
        if not found:
            raise ParseError(f"Parse failed at {item!r}")
        builder.add(found[1], found[2])
    return builder.build()


def schema_of(struct: T.StructType, time_column: str, record_size: int | None = None) -> LogSchema:
    """The schema of a table that exists already: column names stay, other types than a log's are left out."""
    columns = []
    for f in struct.fields:
        try:
            columns.append(LogColumn(f.name, type_of(f.dataType)))
        except InvalidOperation:
            continue
    schema = LogSchema(columns, time_column)
    if record_size is not None:
        schema.record_size = record_size
    return schema
