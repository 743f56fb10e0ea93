"""Approximate nearest neighbours by cosine with balanced posting lists.

Centroids come from balanced k-means on a bounded sample, one per ``list_size`` vectors: in each round a centroid that
draws too many sample vectors gets a handicap. A k-nearest-neighbour graph links the centroids; it is held in memory
and searched greedily with a beam, by all vectors of a batch at once. Every vector is posted to its nearest centroid,
and a boundary vector also to others whose distance is within ``spread`` times the nearest (``copies`` lists at most).
A query searches the graph with a beam that widens until it holds every centroid whose distance is within a ratio of the
nearest, and scans those lists, however many these are. The ratio is ``prune`` or what ``trials`` of the queries need, whichever is more: their nearest are found by a
scan of the whole table, and the ratio is such that a share ``recall`` of these stands in lists within it. So recall
doesn't fall as lists become more. Lists longer than ``part_rows`` are cut into parts, so no task gets an unbounded list,
and its queries go to every part. Parts are dealt to groups, and a query goes once to each group that holds some of its
lists. With many queries each group is scanned several times, for ``ask_rows`` of them at once, about.

Equal vectors are one entry: its smallest ids are all that a result of k can need, so thousands of copies cost no more
than one. Candidates are scored in double precision on the original vectors, ties to the smaller id.

Defined results: vectors that are null, empty, zero, or hold a null or a number that isn't finite take no part, nor do
those of another length than most have; null ids take no part; rows of one id count each as a candidate if their vectors
differ, and such a query is answered for the smallest vector in sort order; fewer candidates than k give fewer rows; an
empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerbrook.llm.common import shared

#: Posts of one group, about; parts of following lists go to groups so far apart.
GROUP_ROWS, STEP = 8192, 7919
#: Ratios are taken to this distance where a centroid is nearer.
LEAST_FAR = 1e-3


class Centroids:
    """Unit centroids and their neighbour graph."""

    def __init__(self, sample: np.ndarray, count: int, degree: int = 16, rounds: int = 8, seed: int = 5):
        rng = np.random.default_rng(seed)
        count = max(1, min(count, len(sample)))
        center = sample[np.sort(rng.permutation(len(sample))[:count])].copy()
        handicap = np.zeros(count)
        fair = len(sample) / count
        for _ in range(rounds):
            own = np.concatenate([np.argmax(sample[i : i + 4096] @ center.T - handicap, axis=1) for i in range(0, len(sample), 4096)])
            load = np.bincount(own, minlength=count)
            total = np.zeros_like(center)
            np.add.at(total, own, sample)
            moved = load > 0
            center[moved] = total[moved] / np.maximum(np.linalg.norm(total[moved], axis=1, keepdims=True), 1e-12)
            handicap += 0.02 * np.clip((load - fair) / fair, -1, 2)
            handicap -= handicap.min()
        self.center = center.astype(np.float32)
        degree = min(degree, count - 1)
        self.links = np.zeros((count, max(degree, 1)), dtype=np.int64)
        for i in range(0, count, 1024):
            near = self.center[i : i + 1024] @ self.center.T
            near[np.arange(len(near)), np.arange(i, i + len(near))] = -np.inf
            if degree:
                self.links[i : i + 1024] = np.argsort(-near, axis=1, kind="stable")[:, :degree]
        self.entries = np.union1d(rng.permutation(count)[: min(count, 24)], self.parts())

    def parts(self) -> list[int]:
        """A centroid of each connected part of the graph, links taken both ways."""
        above = list(range(len(self.center)))

        def top(x: int) -> int:
            while above[x] != x:
                above[x] = x = above[above[x]]
            return x

        for i, row in enumerate(self.links.tolist()):
            for j in row:
                above[top(j)] = top(i)
        return [i for i in above if above[i] == i]

    def within(self, x: np.ndarray, ratio: float, beam: int = 64) -> tuple[np.ndarray, np.ndarray]:
        """(row, centroid) of all centroids found whose distance is within ``ratio`` times the nearest.

        The beam is widened for those rows whose whole beam is within.
        """
        rows, out = np.arange(len(x)), []
        while len(rows):
            found, far = self.search(x[rows], beam)
            far = np.where(np.isfinite(far), np.sqrt(np.maximum(far, 0)), np.inf)
            ok = far <= ratio * np.maximum(far[:, :1], LEAST_FAR)
            more = ok.all(axis=1) & (found.shape[1] < len(self.center)) & (beam < len(self.center))
            r, slot = np.nonzero(ok & ~more[:, None])
            out.append(np.stack([rows[r], found[r, slot]]))
            rows, beam = rows[more], 2 * beam
        pairs = np.concatenate([np.zeros((2, 0), np.int64), *out], axis=1)
        return pairs[0], pairs[1]

    def distances(self, x: np.ndarray) -> np.ndarray:
        """The distance of each row to every centroid."""
        return np.sqrt(np.maximum(2 - 2 * (x.astype(np.float32) @ self.center.T), 0))

    def search(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``beam`` nearest centroids found of each row, and their squared distances, nearest first."""
        n, count = len(x), len(self.center)
        x = x.astype(np.float32)
        if count <= beam:  # the beam would hold the whole graph
            sims = x @ self.center.T
            order = np.argsort(-sims, axis=1, kind="stable")[:, :beam]
            return order, np.maximum(2 - 2 * np.take_along_axis(sims, order, 1), 0)
        rows = np.arange(n)
        seen = np.zeros((n, count), dtype=bool)
        seen[:, self.entries] = True
        ids = np.broadcast_to(self.entries, (n, len(self.entries))).copy()
        sims = x @ self.center[self.entries].T
        done = np.zeros(ids.shape, dtype=bool)
        while True:
            order = np.argsort(-sims, axis=1, kind="stable")[:, :beam]
            ids, sims, done = (np.take_along_axis(a, order, 1) for a in (ids, sims, done))
            todo = ~done & np.isfinite(sims)
            active = todo.any(axis=1)
            if not active.any():
                return ids, np.maximum(2 - 2 * sims, 0)
            at = todo.argmax(axis=1)  # the nearest that isn't expanded
            done[rows[active], at[active]] = True
            fresh = self.links[ids[rows, at]]
            known = seen[rows[:, None], fresh] | ~active[:, None]
            seen[rows[:, None], fresh] |= active[:, None]
            near = np.einsum("nd,nkd->nk", x, self.center[fresh])
            near[known] = -np.inf
            ids, sims = np.concatenate([ids, fresh], axis=1), np.concatenate([sims, near], axis=1)
            done = np.concatenate([done, np.zeros(near.shape, dtype=bool)], axis=1)


def cosine(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Cosine of row pairs in double precision; equal pairs give equal numbers wherever they stand."""
    return (q * v).sum(axis=1) / (np.sqrt((q * q).sum(axis=1)) * np.sqrt((v * v).sum(axis=1)))


def valid(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return vector.isNotNull() & (F.size(vector) > 0) & fine & F.exists(vector, lambda x: x != 0)


def _matrix(column, width: int) -> np.ndarray:
    return np.asarray(column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten(), dtype=np.float64).reshape(-1, width)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _needed(posts: DataFrame, trial: np.ndarray, centroids: Centroids, k: int, recall: float) -> float:
    """The ratio within which a share ``recall`` of the trial vectors' ``k`` nearest stand, by a scan of all posts."""
    width, most = trial.shape[1], 3 * (k + 1)

    def run(batches):
        q, held = _unit(trial), None
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                own = batch.slice(lo, 2048)
                v = _matrix(own.column(2), width)
                sims = q @ _unit(v).T
                top = np.argpartition(-sims, min(most, len(v) - 1), axis=1)[:, : most + 1]
                found = np.take_along_axis(sims, top, 1)
                found[(v[top] == trial[:, None]).all(axis=2)] = -np.inf  # the vector itself
                new = [found, own.column(0).to_numpy()[top], own.column(1).to_numpy()[top]]
                held = new if held is None else [np.concatenate(x, axis=1) for x in zip(held, new, strict=True)]
                best = np.argsort(-held[0], axis=1, kind="stable")[:, :most]
                held = [np.take_along_axis(x, best, 1) for x in held]
        if held is not None:
            at, slot = np.nonzero(np.isfinite(held[0]))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), *(pa.array(x[at, slot]) for x in held)], names=["q", "sim", "list", "entry"])

    tops = posts.select("list", "entry", "v").mapInArrow(run, "q long, sim double, list long, entry long")
    tops = tops.groupBy("q", "entry").agg(F.max("sim").alias("sim"), F.collect_set("list").alias("lists"))
    best = tops.groupBy("q").agg(F.slice(F.sort_array(F.collect_list(F.struct("sim", "entry", "lists")), asc=False), 1, k).alias("best")).collect()
    far = centroids.distances(_unit(trial))
    far /= np.maximum(far.min(axis=1, keepdims=True), LEAST_FAR)
    ratios = [far[r.q, e.lists].min() for r in best for e in r.best]
    return float(np.quantile(ratios, recall, method="higher")) if ratios else 1.0


def nearest(
    vectors: DataFrame,
    queries: Column,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    list_size: int = 256,
    max_lists: int = 16384,
    sample_rows: int = 40_000,
    copies: int = 3,
    spread: float = 1.15,
    prune: float = 1.22,
    recall: float = 0.97,
    trials: int = 256,
    part_rows: int = 2048,
    ask_rows: int = 20_000,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest of every row that ``queries`` marks, itself left out.

    ``sample_rows`` bounds the vectors that centroids are fitted on, ``max_lists`` the centroids in memory; every vector
    is indexed.
    """
    vec = F.col(f"`{vector_col}`")
    rows = vectors.where(F.col(f"`{id_col}`").isNotNull() & valid(vec)).select(
        F.col(f"`{id_col}`").cast("long").alias("id"), vec.cast("array<double>").alias("v"), queries.alias("asks")
    )
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    common = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    if common is None:
        return empty
    width = common.d
    rows = rows.where(F.size("v") == width)
    # an entry for each distinct vector with its k + 1 smallest ids; a first step by part keeps hot vectors from one task
    part = F.pmod(F.xxhash64("id"), F.lit(64))
    least = F.slice(F.array_sort(F.collect_set("id")), 1, k + 1)
    ids = rows.groupBy("v", part.alias("p"), F.floor(F.col("id") / 100_000).alias("q")).agg(least.alias("ids"))
    merged = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1)
    entries = shared(ids.groupBy("v", "p").agg(merged.alias("ids")).groupBy("v").agg(merged.alias("ids")).withColumn("entry", F.xxhash64("v", F.col("ids")[0])))
    total = entries.count()
    spread_of = F.pmod(F.xxhash64(F.lit(17), "entry"), F.lit(1 << 40)) / float(1 << 40)
    drawn = entries.where(spread_of < min(1.0, sample_rows / total)).select("entry", "v").limit(2 * sample_rows).toArrow()
    if not drawn.num_rows:
        drawn = entries.select("entry", "v").limit(100).toArrow()
    drawn = drawn.sort_by("entry")
    sample = _matrix(drawn["v"], width)
    sample = sample / np.sqrt((sample * sample).sum(axis=1, keepdims=True))
    model = spark.sparkContext.broadcast(Centroids(sample, int(min(max_lists, max(1, total // list_size), max(1, len(sample) // 4)))))
    lists = len(model.value.center)

    def post(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                own = batch.slice(lo, 512)
                found, far = model.value.search(_unit(_matrix(own.column(1), width)), 8)
                ok = np.sqrt(far) <= spread * np.sqrt(far[:, :1]) + 1e-6
                ok[:, copies:] = False
                row, slot = np.nonzero(ok)
                yield pa.RecordBatch.from_arrays([pa.array(found[row, slot], pa.int64()), *own.take(pa.array(row)).columns], names=["list", *own.schema.names])

    posts = shared(entries.select("entry", "v", "ids").mapInArrow(post, "list long, entry long, v array<double>, ids array<long>"))
    lengths = np.zeros(lists, dtype=np.int64)
    for r in posts.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect():  # a row per list
        lengths[r.list] = r["n"]
    parts = -(-lengths // part_rows)
    groups = int(max(min(lists, 64), lengths.sum() // GROUP_ROWS))
    asked = rows.where("asks").groupBy("v").agg(F.min("id").alias("any"))  # distinct query vectors, joined to their ids below
    drawn = asked.select("v", F.xxhash64(F.lit(29), "v").alias("h")).orderBy("h").limit(trials).toArrow()
    if not drawn.num_rows:
        return empty
    ratio = max(prune, _needed(posts, _matrix(drawn["v"], width), model.value, k, recall))

    def ask(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                own = batch.slice(lo, 64)
                row, at = model.value.within(_unit(_matrix(own.column(1), width)), ratio)
                row, at = row[parts[at] > 0], at[parts[at] > 0]
                n = parts[at]
                row, at, first = np.repeat(row, n), np.repeat(at, n), np.repeat(np.cumsum(n) - n, n)
                group = (at * STEP + np.arange(len(at)) - first) % groups
                code = np.unique((row * groups + group) * lists + at)  # several parts of a list in a group are one
                near, at = code // lists, code % lists
                start = np.flatnonzero(np.concatenate([[True], near[1:] != near[:-1]])) if len(near) else np.zeros(0, np.int64)
                wanted = pa.ListArray.from_arrays(pa.array([*start, len(at)], pa.int32()), pa.array(at, pa.int64()))
                taken = own.take(pa.array(near[start] // groups))
                yield pa.RecordBatch.from_arrays([pa.array(near[start] % groups, pa.int64()), *taken.columns, wanted], names=["grp", "ask", "v", "lists"])

    scans = asked.select(F.xxhash64("v", "any").alias("ask"), "v").mapInArrow(ask, "grp long, ask long, v array<double>, lists array<long>")
    several = spark.createDataFrame([(int(i), int(parts[i])) for i in np.flatnonzero(parts > 1)], "long_list long, parts int")  # at most max_lists rows
    posts = posts.join(F.broadcast(several), F.col("list") == F.col("long_list"), "left")
    posts = posts.withColumn("grp", F.pmod(F.col("list") * STEP + F.pmod(F.xxhash64("entry"), F.coalesce("parts", F.lit(1))), F.lit(groups)))
    posts = posts.select("grp", "list", "entry", "v", "ids")

    def scan(key, left, right):
        out_ask, out_entry = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if left.num_rows and right.num_rows:
            q, v = _unit(_matrix(left["v"], width)), _unit(_matrix(right["v"], width))
            wanted = left["lists"].combine_chunks()
            asker = np.repeat(np.arange(len(q)), np.diff(wanted.offsets.to_numpy()))
            asks_for, stands_in = wanted.flatten().to_numpy(), right["list"].to_numpy()
            by_ask, by_list = np.argsort(asks_for, kind="stable"), np.argsort(stands_in, kind="stable")
            for own in np.unique(stands_in):
                who = asker[by_ask[np.searchsorted(asks_for, own, "left", by_ask) : np.searchsorted(asks_for, own, "right", by_ask)]]
                what = by_list[np.searchsorted(stands_in, own, "left", by_list) : np.searchsorted(stands_in, own, "right", by_list)]
                for lo in range(0, len(who), 256):
                    sims = q[who[lo : lo + 256]] @ v[what].T
                    # entries as near as the (k + 1)th nearest, but for rounding: the query's own may be one of them
                    top = np.partition(-sims, min(k, len(what) - 1), axis=1)[:, min(k, len(what) - 1)]
                    r, c = np.nonzero(-sims <= top[:, None] + 1e-12)
                    out_ask.append(who[lo + r])
                    out_entry.append(what[c])
        r, c = np.concatenate(out_ask), np.concatenate(out_entry)
        score = np.zeros(0)
        if len(r):  # an entry of several lists once, and of a query's the k + 1 nearest; of equals those with the smallest ids
            _, once = np.unique(np.stack([r, right["entry"].to_numpy()[c]]), axis=1, return_index=True)
            r, c = r[once], c[once]
            every_q, every_v = _matrix(left["v"], width), _matrix(right["v"], width)
            score = np.concatenate([cosine(every_q[r[lo : lo + 65_536]], every_v[c[lo : lo + 65_536]]) for lo in range(0, len(r), 65_536)])
            ids = right["ids"].combine_chunks()
            first_id = ids.flatten().to_numpy()[ids.offsets.to_numpy()[:-1] - ids.offsets[0].as_py()]
            order = np.lexsort((first_id[c], -score, r))
            r, c, score = r[order], c[order], score[order]
            start = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
            keep = np.arange(len(r)) - np.repeat(start, np.diff([*start, len(r)])) <= k
            r, c, score = r[keep], c[keep], score[keep]
        return pa.table([left["ask"].take(pa.array(r)), right["ids"].take(pa.array(c)), pa.array(score, pa.float64())], names=["ask", "ids", "score"])

    turns = max(1, asked.count() // ask_rows)
    scans = scans.withColumn("turn", F.pmod("ask", F.lit(turns)))
    posts = posts.withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(turns - 1).cast("long"))))
    near = scans.groupBy("grp", "turn").cogroup(posts.groupBy("grp", "turn")).applyInArrow(scan, "ask long, ids array<long>, score double")
    near = near.distinct()  # a boundary vector stands in several lists
    # of each query vector the nearest entries; each holds k + 1 ids, so k + 1 entries are enough whatever a query leaves out
    listed = near.groupBy("ask").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("far"), "ids"))), 1, 4 * k + 8).alias("found"))
    flat = F.flatten(F.transform("found", lambda e: F.transform(e["ids"], lambda i: F.struct(e["far"].alias("far"), i.alias("vec_id")))))
    listed = listed.select("ask", F.array_sort(F.array_distinct(flat)).alias("found"))
    asks = rows.where("asks").join(asked, "v").groupBy("id").agg(F.min(F.xxhash64("v", "any")).alias("ask"))
    best = asks.join(listed, "ask").select("id", F.slice(F.filter("found", lambda e: e["vec_id"] != F.col("id")), 1, k).alias("found"))
    return best.select(F.col("id").alias("query_id"), F.posexplode("found").alias("rank", "hit")).select(
        "query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.far")).alias("score")
    )
