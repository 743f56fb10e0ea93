"""Exact self-join of documents on the Jaccard similarity of their word n-grams, by token-combination prefixes.

A document's set holds its distinct shingles of ``width`` words as 64-bit numbers. Two sets of similarity t share at
least ceil(t * n) shingles, n being either size. So, in one global order of shingles, their prefixes of
n - ceil(t * n) + 2 shingles share two at least. The order puts rare shingles first, then frequent ones, each by number.
Of those two shared shingles either one is rare, or both are frequent. Hence the index:

* every rare shingle of the prefix on its own;
* every pair of frequent shingles of the prefix, for documents with few of them (at most ``FEW``);
* every frequent shingle alone for documents with many of them (near copies in large groups), which the others also
  carry so that the two kinds meet.

Which shingles count as frequent changes the cost only, never the result: they are those that recur often within blocks
of documents, over all documents, the most frequent ``MOST_FREQUENT`` at most.

Copies (equal sets) are one class from the start. Documents under one key are paired if they are at most ``PAIR_ALL``;
in a longer run all meet the first one, and the run is kept. The entries of a very frequent shingle are dealt to several
tasks; each makes such a run of its part. Candidates are verified against whole sets, recomputed from the texts. First
each class meets the partner it shares most keys with; what these links join needs no more pairs. Then come the other
candidates and the kept runs that several components share. The members of such runs form families, a family is cut into
blocks by size and hash, and every two blocks that may hold similar sets of different components meet in a task of their
own: once with the keys only, which tells the members that may have a partner, then those with their whole sets. No pair
leaves a task but the links that join components, fewer than there are members. So no similar pair is dropped, and the
components are exact, but for collisions of 64-bit numbers.

Defined results: null and empty texts, and texts of white space, have no shingle and link with nothing; fewer words than
``width`` make one shingle; repeated rows are copies; a null id is allowed and its text links like any other (a
component's id is its smallest known one); an empty table gives an empty table. Columns beside id and text are ignored.
"""

from __future__ import annotations

import itertools
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerbrook.llm.common import bounded_batches, freed, join_checked, lean, shared, slices
from ledgerbrook.llm.components import components

FEW, PAIR_ALL = 8, 32
#: A shingle is frequent if blocks of ``BLOCK`` shingles in which it recurs (``RECURS`` times) count it ``FREQUENT`` times.
BLOCK, RECURS, FREQUENT, MOST_FREQUENT = 1 << 21, 3, 48, 100_000
#: Index entries that one task sorts.
ENTRIES = 300_000
ENTRY = np.dtype([("key", "<u8"), ("cls", "<i8"), ("n", "<u4"), ("flag", "<u4")])
#: Flags: the key's entries are dealt to several tasks. Above it stands the number of rare shingles in the prefix: in a
#: group of near copies it is least in the text the others come from.
PARTED, RANK = 1, 2
#: Entries of one key that may meet in a task, about; members of a block, and bytes of their sets.
PART_ROWS, BLOCK_CLASSES, BLOCK_BYTES = 200_000, 768, 12 << 20
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 250_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


WORDS = WordHashes()


def mix(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * M2 + x * M1
    return h ^ (h >> np.uint64(29))


def shingle_sets(texts: list[str | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of all texts one after another, and where each text's begin (one more at the end)."""
    words = [t.encode("utf-8", "surrogatepass").lower().split() if t else [] for t in texts]
    count = np.array([len(w) for w in words], dtype=np.int64)
    flat = np.fromiter(map(WORDS.__getitem__, itertools.chain.from_iterable(words)), dtype=np.uint64, count=int(count.sum()))
    owner = np.repeat(np.arange(len(texts)), count)
    if len(flat) >= width:
        h = np.full(len(flat) - width + 1, np.uint64(width))
        for k in range(width):
            h = mix(h, flat[k : len(flat) - width + 1 + k])
        whole = owner[: len(h)] == owner[width - 1 :]
        h, of = h[whole], owner[: len(whole)][whole]
    else:
        h, of = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    begin = np.concatenate([[0], np.cumsum(count)])
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        one = np.array([np.uint64(xxhash.xxh3_64_intdigest(flat[begin[i] : begin[i + 1]].tobytes(), seed=int(count[i]))) for i in short], dtype=np.uint64)
        at = np.searchsorted(of, short)
        h, of = np.insert(h, at, one), np.insert(of, at, short)
    ends = np.searchsorted(of, np.arange(len(texts) + 1))
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        h[a:b].sort()
    first = np.ones(len(h), dtype=bool)
    first[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    return h[first], np.concatenate([[0], np.cumsum(first)])[ends]


def forgetful(function):
    """``lean``, and the words that the task remembered go too."""

    def run(batches):
        try:
            yield from function(batches)
        finally:
            WORDS.clear()

    return lean(run)


def class_of(tokens: np.ndarray) -> int:
    """One number for equal sets."""
    return xxhash.xxh3_64_intdigest(tokens.tobytes(), seed=len(tokens)) - (1 << 63)


def least_shared(n, percent: int):
    """ceil(percent * n / 100): what a set of n shares at least with any similar one."""
    return -(-n * percent // 100)


def least_common(n, m, percent: int):
    """What two similar sets of n and m share at least in their prefixes.

    The prefix that ends first in the order holds all of its set's shared shingles up to there, and its set has only so
    many shingles that the other lacks.
    """
    most = np.maximum(n, m)
    return 2 + -(-(n + m) * percent // (100 + percent)) - least_shared(most, percent)


def _profile(width: int, id_type, names):
    """Per document (id, n, cls); per block the shingles that recur in it, with their counts (kind 1)."""

    def run(batches):
        block, held, seen = [], 0, set()

        def recurring():
            t, n = np.unique(np.concatenate(block), return_counts=True) if block else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            t, n = t[n >= RECURS], n[n >= RECURS]
            return pa.RecordBatch.from_arrays([pa.array([1] * len(t), pa.int32()), pa.nulls(len(t), id_type), pa.array(n, pa.int64()), pa.array(t.view(np.int64), pa.int64())], names=names)

        for batch in batches:
            column = batch.column(1)
            for lo in range(0, batch.num_rows, 256):
                texts = column.slice(lo, 256).to_pylist()
                for a, b in slices(texts):
                    tokens, ptr = shingle_sets(texts[a:b], width)
                    size = np.diff(ptr)
                    cls = [class_of(tokens[x:y]) if y > x else None for x, y in zip(ptr[:-1], ptr[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array([0] * (b - a), pa.int32()), batch.column(0).slice(lo + a, b - a), pa.array(size, pa.int64()), pa.array(cls, pa.int64())], names=names)
                    for c, x, y in zip(cls, ptr[:-1], ptr[1:], strict=True):
                        if c is not None and c not in seen:
                            seen.add(c)
                            block.append(tokens[x:y])
                            held += y - x
                    if held >= BLOCK:
                        yield recurring()
                        block, held, seen = [], 0, set()
        yield recurring()

    return run


def entries_of(texts: list[str | None], width: int, percent: int, frequent: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index entries of the distinct sets among ``texts``, and to which part of its key's entries each belongs.

    ``counts`` says how often each frequent shingle occurs.
    """
    tokens, ptr = shingle_sets(texts, width)
    size, kept = np.diff(ptr), {}
    for i in np.flatnonzero(size > 1):  # a set of one links with its copies only
        kept.setdefault(class_of(tokens[ptr[i] : ptr[i + 1]]), i)
    if not kept:
        return np.zeros(0, ENTRY), np.zeros(0, np.uint64)
    cls, own = np.array(list(kept), dtype=np.int64), np.array(list(kept.values()))
    size = size[own]
    take = np.concatenate([tokens[ptr[i] : ptr[i + 1]] for i in own])
    doc = np.repeat(np.arange(len(own)), size)
    begin = np.concatenate([[0], np.cumsum(size)])
    hot, often = np.zeros(len(take), dtype=np.int64), np.zeros(len(take), dtype=np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, take), len(frequent) - 1)
        hot = (frequent[at] == take).astype(np.int64)
        if counts is not None:
            often = counts[at] * hot
    hot_before = np.cumsum(hot) - hot
    hot_before -= hot_before[begin[:-1]][doc]
    rare_total = size - np.add.reduceat(hot, begin[:-1])
    rank = np.arange(len(take)) - begin[:-1][doc]
    place = np.where(hot == 1, rare_total[doc] + hot_before, rank - hot_before)
    length = np.minimum(size - least_shared(size, percent) + 2, size)
    inside = place < length[doc]
    n_hot = np.bincount(doc[inside & (hot == 1)], minlength=len(own))
    base = (RANK * np.bincount(doc[inside & (hot == 0)], minlength=len(own))).astype(np.uint32)
    pick = np.flatnonzero(inside)
    out = np.zeros(len(pick), ENTRY)
    out["key"], out["cls"], out["n"], out["flag"] = take[pick], cls[doc[pick]], size[doc[pick]], base[doc[pick]]
    more, held = [], [often[pick]]
    for d in np.flatnonzero((n_hot > 1) & (n_hot <= FEW)):
        mine = np.flatnonzero((inside & (hot == 1))[begin[d] : begin[d + 1]]) + begin[d]
        i, j = np.triu_indices(len(mine), 1)
        pair = np.zeros(len(i), ENTRY)
        pair["key"], pair["cls"], pair["n"], pair["flag"] = mix(take[mine[i]], take[mine[j]]), cls[d], size[d], base[d]
        more.append(pair)
        held.append(np.minimum(often[mine[i]], often[mine[j]]))
    out = np.concatenate([out, *more])
    parts = (1 + np.concatenate(held) // PART_ROWS).astype(np.uint64)
    out["flag"] |= np.where(parts > 1, PARTED, 0).astype(np.uint32)
    return out, mix(out["cls"].view(np.uint64), np.full(1, 7, np.uint64)) % parts


def _index(width: int, percent: int, frequent, buckets: int):
    """Index entries in parcels, one for each bucket of keys."""

    def run(batches):
        held, count = [], 0

        def parcels():
            all_of, part = np.concatenate([e for e, _ in held]), np.concatenate([p for _, p in held])
            bucket = (((all_of["key"] >> np.uint64(20)) + part * M1) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            all_of, bucket = all_of[order], bucket[order]
            ids, at = np.unique(bucket, return_index=True)
            blobs = [all_of[a:b].tobytes() for a, b in zip(at, [*at[1:], len(all_of)], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(blobs, pa.binary())], names=["bucket", "entries"])

        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                texts = batch.column(0).slice(lo, 256).to_pylist()
                for a, b in slices(texts):
                    held.append(entries_of(texts[a:b], width, percent, *frequent.value))
                    count += len(held[-1][0])
                if count >= 250_000:
                    yield parcels()
                    held, count = [], 0
        if count:
            yield parcels()

    return run


def pairs_of_runs(e: np.ndarray, percent: int) -> tuple[np.ndarray, ...]:
    """Candidates (a, b, shared keys, least_common) and kept runs (key, cls, n, flag) among entries of whole keys or parts.

    ``a`` has the lower rank, or at equal ranks the lower number; so a longer run meets its least edited text.
    """
    e = e[np.lexsort((e["cls"], e["flag"] // RANK, e["key"]))]
    new = np.ones(len(e), dtype=bool)
    new[1:] = (e["key"][1:] != e["key"][:-1]) | (e["cls"][1:] != e["cls"][:-1])
    e = e[new]  # copies came from several tasks
    start = np.flatnonzero(np.concatenate([[True], e["key"][1:] != e["key"][:-1]])) if len(e) else np.zeros(0, np.int64)
    length = np.diff([*start, len(e)])
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for size in np.unique(length[(length > 1) & (length <= PAIR_ALL)]):
        at = start[length == size]
        i, j = np.triu_indices(size, 1)
        left.append((at[:, None] + i).ravel())
        right.append((at[:, None] + j).ravel())
    long = length > PAIR_ALL
    for a, n in zip(start[long], length[long], strict=True):
        left.append(np.full(n - 1, a))
        right.append(np.arange(a + 1, a + n))
    runs = np.repeat(long | ((e["flag"][start] & PARTED) > 0), length)
    i, j = np.concatenate(left), np.concatenate(right)
    a, b = e[i], e[j]
    low, high = np.minimum(a["n"], b["n"]).astype(np.int64), np.maximum(a["n"], b["n"]).astype(np.int64)
    ok = low * 100 >= high * percent
    need = least_common(low[ok], high[ok], percent)
    both = np.stack([a["cls"][ok], b["cls"][ok]], axis=1)
    order = np.lexsort((both[:, 1], both[:, 0]))
    both, need = both[order], need[order]
    first = np.flatnonzero(np.concatenate([[True], (both[1:] != both[:-1]).any(axis=1)])) if len(both) else np.zeros(0, np.int64)
    return both[first, 0], both[first, 1], np.diff([*first, len(both)]), need[first], e[runs]


def _pairs(percent: int):
    def run(key, rows):
        e = np.concatenate([np.frombuffer(x, ENTRY) for x in rows["entries"].to_pylist()])
        a, b, count, need, runs = pairs_of_runs(e, percent)
        cols = [np.repeat([0, 1], [len(a), len(runs)]).astype(np.int32), np.concatenate([a, runs["key"].view(np.int64)]), np.concatenate([b, runs["cls"]]), np.concatenate([count, runs["n"].astype(np.int64)]), np.concatenate([need, np.zeros(len(runs), np.int64)])]
        return pa.table([pa.array(c) for c in cols], names=["kind", "a", "b", "n", "need"])

    return run


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """(left, right): how many numbers each two sets share."""
    n, m = len(left), len(right)
    x, y = np.concatenate([*left, np.zeros(0, np.int64)]), np.concatenate([*right, np.zeros(0, np.int64)])
    of_x, of_y = np.repeat(np.arange(n), [len(v) for v in left]), np.repeat(np.arange(m), [len(v) for v in right])
    columns = np.intersect1d(x, y)  # sorted and distinct
    out = np.zeros((n, m), dtype=np.float32)
    if not len(columns):
        return out

    def place(v, of):
        at = np.minimum(np.searchsorted(columns, v), len(columns) - 1)
        hit = columns[at] == v
        at, of = at[hit], of[hit]
        order = np.argsort(at, kind="stable")
        return at[order], of[order], np.bincount(at, minlength=len(columns))

    (at_x, of_x, in_x), (at_y, of_y, in_y) = place(x, of_x), place(y, of_y)
    heavy = in_x * in_y > 256
    number = np.cumsum(heavy) - 1
    for lo in range(0, int(heavy.sum()), 2048):  # columns that many sets hold: products of dense strips
        strips = []
        for at, of, rows in ((at_x, of_x, n), (at_y, of_y, m)):
            own = heavy[at] & (number[at] >= lo) & (number[at] < lo + 2048)
            strip = np.zeros((rows, 2048), dtype=np.float32)
            strip[of[own], number[at[own]] - lo] = 1
            strips.append(strip)
        out += strips[0] @ strips[1].T
    begin_y = np.cumsum(in_y) - in_y
    light = np.flatnonzero(~heavy[at_x])
    for lo in range(0, len(light), 8192):  # the others: each entry with its partners, at most 256 a column
        own = light[lo : lo + 8192]
        k = in_y[at_x[own]]
        partner = np.repeat(begin_y[at_x[own]] - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))
        cell, times = np.unique(np.repeat(of_x[own], k) * m + of_y[partner], return_counts=True)
        out.reshape(-1)[cell] += times
    return out


def forest(a: np.ndarray, b: np.ndarray, root_a: np.ndarray, root_b: np.ndarray) -> list[int]:
    """Which links (a, b) of components are enough to join whatever all of them join."""
    _, first = np.unique(np.stack([np.minimum(root_a, root_b), np.maximum(root_a, root_b)]), axis=1, return_index=True)
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while above.setdefault(x, x) != x:
            above[x] = x = above[above[x]]
        return x

    out = []
    for k in first.tolist():
        p, q = top(int(root_a[k])), top(int(root_b[k]))
        if p != q:
            above[p] = q
            out.append(k)
    return out


def _sides(rows: pa.Table):
    """The two sides of a meeting: (cls, n, root, more, sets) each; a block that meets itself stands on both."""
    side = rows["side"].to_numpy()
    sets = np.empty(len(side), dtype=object)
    sets[:] = [np.frombuffer(x.as_buffer(), np.int64) for x in rows["data"]]
    cols = [rows[c].to_numpy() for c in ("cls", "n", "root", "more")]
    for k in (0, 1):
        own = np.flatnonzero((side == k) | (side == 2))
        own = own[np.unique(cols[0][own], return_index=True)[1]]
        yield *(c[own] for c in cols), list(sets[own])


def promising(rows: pa.Table, percent: int) -> np.ndarray:
    """The classes of a meeting that may be similar to one of another component, by their sizes and the kept runs they share.

    Of the keys that a pair has in runs of other families it shares as many as the one of the two with fewer has, at most.
    """
    (a, n, root_a, more_a, keys_a), (b, m, root_b, more_b, keys_b) = _sides(rows)
    common = shared_counts(keys_a, keys_b)
    i, j = np.nonzero((common > 0) & (root_a[:, None] != root_b[None]) & (np.minimum(n[:, None], m[None]) * 100 >= np.maximum(n[:, None], m[None]) * percent))
    elsewhere = np.minimum((more_a - [len(k) for k in keys_a])[i], (more_b - [len(k) for k in keys_b])[j])
    ok = common[i, j] + elsewhere >= least_common(n[i], m[j], percent)
    return np.union1d(a[i[ok]], b[j[ok]])


def joining(rows: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between a meeting's similar sets, no more than it takes to join their components."""
    (a, n, root_a, _, sets_a), (b, m, root_b, _, sets_b) = _sides(rows)
    common = shared_counts(sets_a, sets_b).astype(np.int64)
    i, j = np.nonzero((root_a[:, None] != root_b[None]) & (100 * common >= percent * (n[:, None] + m[None] - common)))
    k = forest(a[i], b[j], root_a[i], root_b[j])
    return a[i[k]], b[j[k]]


def meetings(members: DataFrame, percent: int) -> DataFrame:
    """``members`` (family, cls, n, root, more, data) once for each meeting of their block, with ``meet`` and ``side``.

    A family's members of about one size that lie in its main component make blocks, and those outside it make others.
    Blocks meet if their sizes may fit, but not two of the main component.
    """
    grade = F.floor(F.log("n") / F.lit(float(np.log(100 / percent) * 1.0001))).cast("int")
    members = members.withColumn("grade", grade).withColumn("out", F.col("root") != F.col("family"))
    at = ["family", "grade", "out"]
    room = F.greatest(F.count(F.lit(1)) / BLOCK_CLASSES, F.sum(F.octet_length("data")) / BLOCK_BYTES)
    blocks = shared(members.groupBy(*at).agg(F.greatest(F.lit(1), F.ceil(room)).cast("int").alias("blocks")))
    one, two = (blocks.select(F.col("family").alias(f"{k}_family"), F.col("grade").alias(f"{k}_grade"), F.col("out").alias(f"{k}_out"), F.col("blocks").alias(f"{k}_blocks")) for k in "ab")
    met = one.join(two, F.col("a_family") == F.col("b_family")).where("(b_grade = a_grade + 1 and (a_out or b_out)) or (b_grade = a_grade and b_out)")
    met = met.where("a_grade <> b_grade or not a_out or b_out")
    met = met.withColumn("a_part", F.explode(F.sequence(F.lit(0), F.col("a_blocks") - 1))).withColumn("b_part", F.explode(F.sequence(F.lit(0), F.col("b_blocks") - 1)))
    same = (F.col("a_grade") == F.col("b_grade")) & (F.col("a_out") == F.col("b_out"))
    met = met.where(~same | (F.col("a_part") <= F.col("b_part"))).withColumn("same", same & (F.col("a_part") == F.col("b_part")))
    met = met.withColumn("meet", F.xxhash64("a_family", "a_grade", "a_out", "a_part", "b_grade", "b_out", "b_part"))
    side = lambda k: F.struct(F.col(f"{k}_family").alias("family"), F.col(f"{k}_grade").alias("grade"), F.col(f"{k}_out").alias("out"), F.col(f"{k}_part").alias("part"))
    ends = F.when(F.col("same"), F.array(F.struct(side("a").alias("at"), F.lit(2).alias("side")))).otherwise(F.array(F.struct(side("a").alias("at"), F.lit(0).alias("side")), F.struct(side("b").alias("at"), F.lit(1).alias("side"))))
    met = met.select("meet", F.explode(ends).alias("end")).select("meet", "end.at.*", "end.side")
    dealt = members.join(blocks, at).withColumn("part", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    return dealt.join(met, [*at, "part"]).select("meet", "side", "family", "cls", "n", "root", "more", "data")


def _promising(percent: int):
    def run(key, rows):
        cls = promising(rows, percent)
        return pa.table([pa.array(np.full(len(cls), rows["family"][0].as_py()), pa.int64()), pa.array(cls, pa.int64())], names=["family", "cls"])

    return run


def _joining(percent: int):
    def run(key, rows):
        a, b = joining(rows, percent)
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["u", "v"])

    return run


def _sets(width: int):
    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                texts = batch.column(0).slice(lo, 256).to_pylist()
                for a, b in slices(texts):
                    tokens, ptr = shingle_sets(texts[a:b], width)
                    made = {class_of(tokens[x:y]): tokens[x:y] for x, y in zip(ptr[:-1], ptr[1:], strict=True) if y > x}
                    new = [c for c in made if c not in seen]
                    if len(seen) > 100_000:
                        seen.clear()
                    seen.update(new)
                    yield pa.RecordBatch.from_arrays([pa.array(new, pa.int64()), pa.array([made[c].tobytes() for c in new], pa.binary())], names=["cls", "tokens"])

    return run


def _verify(percent: int):
    def run(batches):
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                good.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(good, pa.bool_()))

    return run


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75) -> DataFrame:
    """Per document: its id, n_shingles, and component_id (the smallest id reachable by links of ``percent`` or more)."""
    bounded_batches(docs.sparkSession)
    source = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    kind = source.schema[0].dataType
    profile_schema = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("id", kind), T.StructField("n", T.LongType()), T.StructField("cls", T.LongType())])
    arrow_id = pa.int64() if isinstance(kind, T.LongType) else pa.int32() if isinstance(kind, T.IntegerType) else pa.string()
    profile = shared(source.mapInArrow(forgetful(_profile(width, arrow_id, profile_schema.names)), profile_schema))
    listed = profile.where("kind = 0").select("id", "n", "cls")
    often = shared(profile.where("kind = 1").groupBy("cls").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT))
    grade = F.floor(F.log2("n") * 16).alias("grade")  # some hundred grades; the upper ones are taken as far as there is room
    room, least = MOST_FREQUENT, None
    for r in sorted(often.groupBy(grade).agg(F.count(F.lit(1)).alias("k")).collect(), reverse=True):
        if r.k > room:
            break
        room, least = room - r.k, r.grade
    kept = [] if least is None else often.where(F.floor(F.log2("n") * 16) >= least).select("cls", "n").collect()
    frequent, counts = np.array([r.cls for r in kept], dtype=np.int64).view(np.uint64), np.array([r["n"] for r in kept], dtype=np.int64)
    order = np.argsort(frequent)
    frequent, counts = frequent[order], counts[order]
    total = listed.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = max(1, total * (100 - percent) // 100 // ENTRIES)
    sent = docs.sparkSession.sparkContext.broadcast((frequent, counts))
    parcels = source.select(text_col).mapInArrow(forgetful(_index(width, percent, sent, buckets)), "bucket long, entries binary")
    found = shared(parcels.groupBy("bucket").applyInArrow(_pairs(percent), "kind int, a long, b long, n long, need long"))
    freed(docs.sparkSession)  # the index
    pairs = found.where("kind = 0").groupBy("a", "b").agg(F.sum("n").alias("n"), F.max("need").alias("need"))
    runs = shared(found.where("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("cls"), "n"))
    heads = listed.where("cls is not null").groupBy("cls").agg(F.min("id").alias("head"))

    def sets_of(needed: DataFrame) -> DataFrame:
        """The whole sets of the classes ``needed`` (cls), from a text of each."""
        ids = shared(needed.distinct().join(heads, "cls").select("head").distinct())
        texts = join_checked(source, ids, F.col(f"`{id_col}`").eqNullSafe(F.col("head")), "left_semi", 32)  # only null ids: null
        return texts.select(text_col).mapInArrow(forgetful(_sets(width)), "cls long, tokens binary").dropDuplicates(["cls"])

    def verified(chosen: DataFrame) -> DataFrame:
        sets = sets_of(chosen.select(F.col("a").alias("cls")).union(chosen.select(F.col("b").alias("cls"))))
        one, two = sets.select(F.col("cls").alias("b"), F.col("tokens").alias("tb")), sets.select(F.col("cls").alias("a"), F.col("tokens").alias("ta"))
        good = shared(chosen.select("a", "b").join(one, "b").join(two, "a").select("a", "b", "ta", "tb").mapInArrow(lean(_verify(percent)), "u long, v long").distinct())
        del sets, one, two
        freed(docs.sparkSession)  # whole sets
        return good

    in_runs = shared(runs.groupBy("cls").agg(F.count(F.lit(1)).alias("more")))  # keys that pairs don't count
    more_of = lambda side: in_runs.select(F.col("cls").alias(side), F.col("more").alias(f"{side}_more"))
    pairs = pairs.join(more_of("a"), "a", "left").join(more_of("b"), "b", "left")
    more = F.least(F.coalesce("a_more", F.lit(0)), F.coalesce("b_more", F.lit(0)))
    pairs = shared(pairs.where(F.col("n") + more >= F.col("need")).select("a", "b", "n"))  # a pair shares the keys counted, and kept runs beside
    del found
    freed(docs.sparkSession)  # single keys that pairs share
    best = F.max_by(F.struct("a", "b"), F.struct("n", F.col("a") * -1)).alias("best")
    first = shared(pairs.groupBy("b").agg(best).select("best.*"))
    links = verified(first)
    roots = shared(components(links))
    here = roots.select(F.col("node").alias("cls"), "root")
    of = lambda side: here.select(F.col("cls").alias(side), F.col("root").alias(f"{side}_root"))
    rest = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").where(F.coalesce("a_root", "a") != F.coalesce("b_root", "b"))
    rest = rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    tried = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = shared(rest.distinct().join(tried, ["a", "b"], "left_anti"))
    placed = runs.join(here, "cls", "left").select("key", "cls", "n", F.coalesce("root", "cls").alias("root"))
    # runs of one group of near copies mostly hold members of one component: those are one family
    held = placed.groupBy("key", "root").agg(F.count(F.lit(1)).alias("k")).groupBy("key").agg(F.max_by("root", F.struct("k", "root")).alias("family"), F.count(F.lit(1)).alias("roots"))
    split = held.where("roots > 1").select("key", "family")
    inside = shared(placed.join(split, "key").groupBy("family", "cls").agg(F.first("n").alias("n"), F.first("root").alias("root"), F.collect_set("key").alias("keys")))
    del runs, placed, held, split
    freed(docs.sparkSession)  # the kept runs
    own = inside.groupBy("cls").agg(F.sum(F.size("keys")).alias("more"))  # different components share none but these runs
    packed = F.unhex(F.array_join(F.transform("keys", lambda k: F.lpad(F.hex(k), 16, "0")), ""))
    chances = meetings(inside.join(own, "cls").withColumn("data", packed), percent)
    chances = shared(chances.groupBy("meet").applyInArrow(_promising(percent), "family long, cls long").distinct())
    freed(docs.sparkSession)  # meetings with keys
    later = [verified(rest)] if not rest.isEmpty() else []
    if not chances.isEmpty():
        whole = inside.select("family", "cls", "n", "root").join(chances, ["family", "cls"]).join(sets_of(chances.select("cls")), "cls")
        met = meetings(whole.select("family", "cls", "n", "root", F.lit(0).cast("long").alias("more"), F.col("tokens").alias("data")), percent)
        later.append(shared(met.groupBy("meet").applyInArrow(_joining(percent), "u long, v long").distinct()))
        del whole, met
        freed(docs.sparkSession)  # meetings with whole sets
    if later:
        links = reduce(DataFrame.union, [links, *later])
        roots = shared(components(links))
    joined = heads.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = joined.groupBy("root").agg(F.min("head").alias("component_id"))
    by_class = joined.select("cls", "root").join(least, "root").select("cls", "component_id")
    out = listed.join(by_class, "cls", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
