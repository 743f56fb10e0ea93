"""Mix sources to target weights: a multivariate-hypergeometric splitting tree deals blocks of sources to output shards.

Every source's documents fall into blocks by a hash of their id. A source whose target is q times its size and a rest
gives all its blocks q times, and of one more pass so many blocks, in hash order, that the words come near the target;
the last few documents are picked one by one. The tree starts with each source's number of block turns (its quota) and
halves the shards again and again: the left half's quotas are drawn from a multivariate hypergeometric law, so each
shard gets its exact share of all turns, in proportions that vary only by chance. Each source's turns are permuted and
dealt out to the shards by those quotas, so no turn falls to two shards. Within a shard documents are in random order:
``mixed_rows`` shuffles each copy to its shard, cut into parts by order, and sorts there. All draws come from ``seed``, so
reruns agree.

Only counts and sums per source and block reach the driver: at most ``max_sources`` sources, else it is an error.

Defined results: a null text has size 0; a null source is a source of its own, the last; rows of one id are taken or
left together, each by its own text; null ids are allowed; sources without a word get target 0; an empty table gives an
empty table. Other columns pass; columns named as the new ones are replaced.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerbrook.llm.common import without

ADDED = ["mix_size", "mix_source_size", "mix_target", "mix_copies", "mix_shards", "mix_order"]
#: Bits of a document's hash, and blocks in a pass of a source.
HASH_BITS, BLOCK_BITS = 60, 10


def word_count(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ runs: a letter for each word, then nothing else."""
    spaced = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.size(F.array_remove(F.split(spaced, " ", -1), "")).cast("long")


def targets(sizes: list[int], weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: float = 3.0) -> list[float]:
    """Shares of all words by weight; none above ``most`` times its source, the excess reshared by weight."""
    total = float(sum(sizes))
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    out, free = [0.0] * len(sizes), set(range(len(sizes)))
    while free:
        left = total - sum(out[i] for i in range(len(sizes)) if i not in free)
        scale = left / sum(weight[i] for i in free)
        over = [i for i in free if scale * weight[i] > most * sizes[i]]
        if not over:
            for i in free:
                out[i] = scale * weight[i]
            break
        for i in over:
            out[i] = most * sizes[i]
        free -= set(over)
    return out


def split_tree(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """(shards, sources): how many turns of each source every shard gets; shards differ by one turn at most."""
    out = np.zeros((shards, len(quotas)), dtype=np.int64)
    todo = [(0, shards, quotas.astype(np.int64))]
    while todo:
        at, n, q = todo.pop()
        if n == 1:
            out[at] = q
            continue
        half = n // 2
        total = int(q.sum())
        each, more = divmod(total, n)
        take = each * half + min(more, half)
        left = rng.multivariate_hypergeometric(q, take, method="marginals") if total else q
        todo += [(at, half, left), (at + half, n - half, q - left)]
    return out


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (1.0, 2.0, 3.0),
    most: float = 3.0,
    shards: int = 64,
    seed: int = 11,
    window: int = 256,
    max_sources: int = 4096,
) -> DataFrame:
    """``docs`` with the plan of the mix.

    mix_size (words), mix_source_size and mix_target (of the row's source), mix_copies (how often it is taken),
    mix_shards (the output shard of each copy) and mix_order (one number per copy to sort a shard by).
    """
    docs = without(docs, ADDED)
    ident, text, source = (F.col(f"`{c}`") for c in (id_col, text_col, source_col))
    place = F.shiftrightunsigned(F.xxhash64(F.lit(seed), ident), 64 - HASH_BITS)
    slim = docs.select(source.cast("string").alias("s"), place.alias("h"), word_count(text).alias("w"))
    block = F.shiftright(F.col("h"), HASH_BITS - BLOCK_BITS).alias("block")
    names = slim.groupBy("s").agg(F.sum("w").alias("w")).limit(max_sources + 1).collect()
    if len(names) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    names.sort(key=lambda r: (r.s is None, r.s or ""))  # str sorts by code point
    sizes = [r.w for r in names]
    goal = targets(sizes, weights, most)
    passes = [int(t // n) if n else 0 for t, n in zip(goal, sizes, strict=True)]
    rest = [t - q * n for t, q, n in zip(goal, passes, sizes, strict=True)]
    order = {r.s: i for i, r in enumerate(names)}
    low, turns, picks = _cut(slim, block, order, rest, window)
    rng = np.random.default_rng(seed)
    blocks = 1 << BLOCK_BITS
    quotas = np.array([q * blocks + k for q, k in zip(passes, turns, strict=True)], dtype=np.int64)
    dealt = split_tree(quotas, shards, rng)
    rows = []
    for i, r in enumerate(names):
        given = np.empty(quotas[i], dtype=np.int64)
        given[rng.permutation(quotas[i])] = np.repeat(np.arange(shards), dealt[:, i])
        rows.append((r.s, int(sizes[i]), float(goal[i]), passes[i], low[i], picks[i], given.tolist()))
    plan = docs.sparkSession.createDataFrame(
        rows, "`__mix_name` string, mix_source_size long, mix_target double, `__mix_passes` int, `__mix_low` long, `__mix_picks` array<long>, `__mix_given` array<int>"
    )
    h = F.col("__mix_h")
    again = (h < F.col("__mix_low")) | F.array_contains("__mix_picks", h)
    out = docs.withColumn("__mix_h", place).withColumn("mix_size", word_count(text))
    out = out.join(F.broadcast(plan), source.cast("string").eqNullSafe(F.col("__mix_name")))  # a row per source, at most max_sources
    out = out.withColumn("mix_copies", F.when(F.col("mix_size") == 0, 0).otherwise(F.col("__mix_passes") + again.cast("int")))
    turn = lambda k: F.element_at("__mix_given", (k * blocks + F.shiftright(h, HASH_BITS - BLOCK_BITS) + 1).cast("int"))
    copies = F.sequence(F.lit(0), F.col("mix_copies") - 1)
    none = F.array().cast("array<int>")
    out = out.withColumn("mix_shards", F.when(F.col("mix_copies") > 0, F.transform(copies, turn)).otherwise(none))
    key = F.transform(copies, lambda k: F.xxhash64(F.lit(seed + 1), ident, k))
    out = out.withColumn("mix_order", F.when(F.col("mix_copies") > 0, key).otherwise(none.cast("array<long>")))
    return out.select([F.col(f"`{c}`") for c in docs.columns] + ADDED)


def _cut(slim: DataFrame, block: Column, order: dict, rest: list[float], window: int) -> tuple[list[int], list[int], list[list[int]]]:
    """Where each source's last pass ends: all hashes below ``low``, the blocks it touches, and single hashes picked.

    Sums per range of hashes find the range where the words reach the rest; it is cut finer as long as it holds more
    documents than the window. Then single documents are picked in hash order, each that still has room.
    """
    n = len(rest)
    low, done, span, width = [0] * n, [0.0] * n, [1 << HASH_BITS] * n, [1 << (HASH_BITS - BLOCK_BITS)] * n
    open_ = [i for i in range(n) if rest[i] > 0]
    names = {i: s for s, i in order.items()}
    final = []
    while open_:
        limits = slim.sparkSession.createDataFrame([(names[i], low[i], low[i] + span[i], width[i]) for i in open_], "s string, lo long, hi long, step long")
        cells = (
            slim.join(F.broadcast(limits), slim["s"].eqNullSafe(limits["s"])).where("h >= lo and h < hi")
            .groupBy(limits["s"], ((F.col("h") - F.col("lo")) / F.col("step")).cast("long").alias("cell")).agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("n"))
        )
        found: dict[int, list] = {}
        for r in cells.collect():
            found.setdefault(order[r.s], []).append((r.cell, r.w, r["n"]))
        still = []
        for i in open_:
            got, docs, first = sorted(found.get(i, [])), 0, None
            for cell, w, count in got:
                if first is None:
                    if done[i] + w <= rest[i]:
                        done[i] += w
                        continue
                    first = cell
                docs += count
                last, top = cell, count
                if docs >= window:
                    break
            if first is None:  # the words end before the rest is reached
                low[i] += span[i]
                continue
            start = low[i] + first * width[i]
            fine = docs <= 4 * window or width[i] == 1
            end = low[i] + (last + 1) * width[i]
            if not fine:  # only the first cell may hold so many
                end = start + width[i] if last == first or top > window else end
            low[i], span[i], width[i] = start, end - start, max(1, -(-(end - start) >> BLOCK_BITS))
            (final if fine else still).append(i)
        open_ = still
    picks: list[list[int]] = [[] for _ in range(n)]
    if final:
        limits = slim.sparkSession.createDataFrame([(names[i], low[i], low[i] + span[i]) for i in final], "s string, lo long, hi long")
        rows = slim.join(F.broadcast(limits), slim["s"].eqNullSafe(limits["s"])).where("h >= lo and h < hi")
        by: dict[int, list] = {}
        for r in rows.groupBy(limits["s"], "h").agg(F.sum("w").alias("w")).collect():  # a window of documents per source
            by.setdefault(order[r.s], []).append((r.h, r.w))
        for i, got in by.items():
            for h, w in sorted(got):
                if done[i] + w <= rest[i]:
                    done[i] += w
                    picks[i].append(h)
            best = min(((abs(rest[i] - done[i] - w), h, w) for h, w in got if h not in set(picks[i])), default=None)
            if best and best[0] < rest[i] - done[i]:  # one that overshoots may still come nearer
                picks[i].append(best[1])
    shift = HASH_BITS - BLOCK_BITS
    turns = [max([-(-low[i] >> shift) if rest[i] > 0 else 0, *((h >> shift) + 1 for h in picks[i])]) for i in range(n)]
    return low, turns, picks


def mixed_rows(plan: DataFrame, parts: int = 1) -> DataFrame:
    """One row per copy, where its shard is: columns mix_shard, mix_part and mix_order are added and sorted by.

    Each shard is cut into ``parts`` ranges of the order, a task each, so that a shard may exceed what a task can hold;
    its parts one after another are the shard in random order.
    """
    copy = F.explode(F.arrays_zip("mix_shards", "mix_order")).alias("__mix_copy")
    rows = plan.select([F.col(f"`{c}`") for c in plan.columns if c not in ADDED] + [copy])
    rows = without(rows, ["mix_shard", "mix_part", "mix_order"])
    order = F.col("__mix_copy.mix_order")
    part = F.least(F.floor((order / float(1 << 64) + 0.5) * parts), F.lit(parts - 1)).cast("int")  # the order is a signed 64-bit hash
    rows = rows.withColumn("mix_shard", F.col("__mix_copy.mix_shards")).withColumn("mix_part", part).withColumn("mix_order", order).drop("__mix_copy")
    return rows.repartition("mix_shard", "mix_part").sortWithinPartitions("mix_shard", "mix_part", "mix_order")
