"""What several corpus operators share: shared storage, fold numbers, and n-gram hashing of whole texts."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import time
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space in the contracts of these operators: \x20 and \x09 to \x0D.
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows in one batch of whole texts handed to Python are processed in slices of about this many characters.
SLICE_CHARS = 1 << 18


def on_one_machine(master: str) -> bool:
    return master.startswith("local") and not master.startswith("local-cluster")


def ensure_shared_dir(session: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Only where that is unset and one machine does all (as in tests) a temporary folder is set; on a cluster it is an error.
    """
    context = session.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not on_one_machine(context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def shared(df: DataFrame) -> DataFrame:
    """Cut lineage: write ``df`` to the shared folder and read it from there.

    Files go when nothing refers to the result any more, if the session cleans checkpoints.
    """
    ensure_shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def freed(session: SparkSession) -> None:
    """Have the files of shuffles go whose results are staged, and of staged results that nothing refers to any more.

    Spark deletes them when the driver's heap is collected; left to itself that may be after the whole job, so that all of a
    job's shuffles lie on disk together. The executors' heaps are collected too: grown in one step they'd stay as large in
    the next, beside its Python workers.
    """
    gc.collect()
    waiting = getattr(session.sparkContext._gateway._gateway_client, "finalizer_deque", None) or ()
    with contextlib.suppress(IndexError):  # Py4J tells the JVM once a second which objects Python has let go
        while waiting:
            task = waiting.pop()
            if not isinstance(task, tuple):  # the mark at its end
                waiting.append(task)
                break
            task[0].garbage_collect_object(task[1], False)
    for pause in (0.2, 0):  # one collection alone leaves the shuffles of the query before it, and most of a heap (measured)
        session.sparkContext._jvm.System.gc()
        time.sleep(pause)
        collect_executors(session)


def collect_executors(session: SparkSession) -> None:
    """Collect the heap of every executor that has room for a task now; on one machine the driver's heap is theirs."""
    context = session.sparkContext
    if not on_one_machine(context.master):
        slots = max(1, context.defaultParallelism)
        session.range(0, slots, 1, slots).select(F.expr("java_method('java.lang.System', 'gc')")).collect()


def bounded_batches(session: SparkSession, rows: int = 1000, octets: int = 4 << 20) -> None:
    """Let the session hand whole texts to Python in small batches: by default 10,000 rows go at once, whatever their size.

    The settings stay with the session, since results are lazy and read them when they run; smaller ones are left as they are.
    """
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", octets)):
        key = f"spark.sql.execution.arrow.{name}"
        now = session.conf.get(key, None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most:  # not set, unlimited, larger, or spelt with a unit
            session.conf.set(key, str(most))


def fold(id_col: Column, folds: int = 4) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lean(function):
    """Wrap a function over Arrow batches: at its end the worker returns free memory to the system.

    Workers live on from stage to stage, and what their allocators keep counts against the executor.
    """

    def run(batches):
        try:
            yield from function(batches)
        finally:
            trimmed()

    return run


def trimmed() -> None:
    """Return this process's free memory to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


@cache
def letter_table(digits: bool = False) -> np.ndarray:
    """Which code points are letters, or digits too."""
    out = np.zeros(0x110000, dtype=bool)
    out[[i for i in range(0x110000) if chr(i).isalpha() or (digits and chr(i).isdigit())]] = True
    return out


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def points(text: str) -> np.ndarray:
    """Code points; lone surrogates count as themselves."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def slices(texts, limit: int = SLICE_CHARS):
    """(index range) runs of consecutive texts of about ``limit`` characters; a longer text stands alone."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if size and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def ngram_buckets(texts, sizes: tuple[int, ...], bits: int, seed: int = 0, piece: int = 2 * SLICE_CHARS, digits: bool = False):
    """Yield (row, buckets) arrays: each character n-gram of each whole lower-cased text, hashed to ``bits`` bits.

    Everything that is no letter (nor digit, if ``digits``) is a boundary, and runs of boundaries count as one. An n-gram lies within one word;
    its first or last character may be the boundary. Long texts come in several overlapping pieces, so memory is bound.
    ``row`` is an index into ``texts``; null texts give nothing.
    """
    letters = letter_table(digits)
    widest = max(sizes)
    for lo, hi in slices(texts):
        parts, owners = [], []
        for i in range(lo, hi):
            t = texts[i]
            if t:
                c = points(t.lower())
                parts.append(c)
                owners.append((i, c.size))
        if not parts:
            continue
        pad = np.zeros(1, dtype=np.uint32)
        code = np.concatenate([x for c in parts for x in (pad, c, pad)])
        row = np.repeat(np.array([i for i, _ in owners], dtype=np.int64), [n + 2 for _, n in owners])
        word = letters[np.minimum(code, 0x10FFFF)]
        keep = word.copy()
        keep[0] = True
        keep[1:] |= word[:-1] | (row[1:] != row[:-1])  # of a run of boundaries, the first
        code, row, word = np.where(word, code, 32)[keep].astype(np.uint64), row[keep], word[keep]
        for at in range(0, code.size, piece):
            c, r, w = code[at : at + piece + widest], row[at : at + piece + widest], word[at : at + piece + widest]
            inside = np.concatenate([[0], np.cumsum(~w)])
            h = np.full(c.size, np.uint64(0x9E3779B97F4A7C15 + seed))
            for n in range(1, widest + 1):
                m = min(piece, c.size - n + 1)
                if m <= 0:
                    break
                h = (h[: c.size - n + 1] ^ c[n - 1 :]) * np.uint64(0x100000001B3)
                if n not in sizes:
                    continue
                if n == 1:
                    good = w[:m]
                else:
                    good = (inside[n - 1 : n - 1 + m] - inside[1 : 1 + m] == 0) & (r[:m] == r[n - 1 : n - 1 + m])
                    if n == 2:
                        good &= w[:m] | w[1 : 1 + m]
                g = h[:m][good]
                g ^= g >> np.uint64(29)
                g *= np.uint64(0xBF58476D1CE4E5B9)
                yield r[:m][good], (g >> np.uint64(64 - bits)).astype(np.int64)


def row_sums(row: np.ndarray, values: np.ndarray, out: np.ndarray) -> None:
    """Add ``values`` to ``out`` by ``row``, which never falls."""
    if row.size:
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        out[row[first]] += np.add.reduceat(values, first, axis=0)


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """Drop columns that an operator is about to add itself (names compare without case, as in Spark)."""
    taken = {n.lower() for n in names}
    return df.select([F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def join_checked(left: DataFrame, right: DataFrame, on, how: str, row_bytes: int, limit: int = 32 << 20) -> DataFrame:
    """Join a staged ``right``: broadcast if its counted rows take at most ``limit`` bytes, else shuffled on both sides."""
    small = right.count() * row_bytes <= limit
    return left.join(F.broadcast(right) if small else right.hint("merge"), on, how)
