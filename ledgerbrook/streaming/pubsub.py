"""Publish and subscribe over a stored log: a producer that buffers, and a consumer that reads on from its place."""

from __future__ import annotations

import time

from pyspark.sql import Row

from ledgerbrook.sources.multilog import OFFSET
from ledgerbrook.sources.store import StoredLog


class Producer:
    """Buffers records and appends them when there are ``batch_size``, or ``timeout_s`` after the first."""

    def __init__(self, log: StoredLog, batch_size: int = 8192, timeout_s: float = 1.0):
        self._log, self._size, self._timeout, self._held, self._since = log, batch_size, timeout_s, [], 0.0

    def send(self, values: list) -> None:
        if not self._held:
            self._since = time.monotonic()
        self._held.append(values)
        if len(self._held) >= self._size or time.monotonic() - self._since >= self._timeout:
            self.flush()

    def flush(self) -> None:
        if self._held:
            held, self._held = self._held, []
            self._log.append(held)


class Consumer:
    """Reads records in append order, ``prefetch`` at a time, from a place on."""

    def __init__(self, log: StoredLog, offset: int = 0, prefetch: int = 8192):
        self._log, self.offset, self._prefetch, self._ready = log, offset, prefetch, []

    def consume(self) -> Row | None:
        """The next record, or None if there is none yet."""
        if not self._ready:
            self._log.refresh()
            self._ready = self._log.read_batch(self.offset, self._prefetch).orderBy(OFFSET).collect()[::-1]  # prefetch rows at most
        if not self._ready:
            return None
        row = self._ready.pop()
        self.offset = row[OFFSET] + self._log.record_size
        return row
