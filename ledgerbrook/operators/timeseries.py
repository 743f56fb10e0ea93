"""Time-series reads of a log: range, nearest record, rows between two versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerbrook.sources.multilog import OFFSET, Multilog, time_literal


class TimeSeries:
    def __init__(self, log: Multilog):
        self.log = log

    def _bounded(self, low: int | None, high: int | None) -> DataFrame:
        """Rows of nanoseconds ``low`` to ``high``, both included; bounds go to the stored column."""
        name = self.log.schema.time_column
        column, rows = F.col(f"`{name}`"), self.log.rows
        if low is not None:
            rows = rows.where(column >= time_literal(low, self.log.time_kind(), up=True))
        if high is not None:
            rows = rows.where(column <= time_literal(high, self.log.time_kind(), up=False))
        return rows

    def get_range(self, begin: int, end: int) -> DataFrame:
        return self._bounded(begin, end)

    def get_nearest(self, ts: int, forward: bool = True) -> DataFrame:
        """The first record strictly after ``ts``, or the last one strictly before it; of equal times the first, or last, appended."""
        if forward:
            return self._bounded(ts + 1, None).orderBy(F.col(f"`{self.log.schema.time_column}`"), OFFSET).limit(1)
        return self._bounded(None, ts - 1).orderBy(F.desc(self.log.schema.time_column), F.desc(OFFSET)).limit(1)

    def compute_diff(self, begin: int, end: int) -> DataFrame:
        """Rows appended from version ``begin`` up to version ``end``."""
        return self.log.placed(self.log.rows, begin, end)

    def get_version(self) -> int:
        return self.log.version()
