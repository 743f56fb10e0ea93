"""Toxicity: subword-bag embeddings averaged into a linear softmax, embeddings and softmax trained jointly in numpy.

A text is the bag of its words' character n-grams (3 to 5, word boundaries included), hashed to buckets. Every bucket
has an embedding and a fixed weight (its inverse document frequency); the weighted embeddings of all n-grams of the
whole text are averaged and go through a linear softmax over the two classes; its log-odds are then calibrated. Misspelt and inflected words share n-grams
with those seen in training. Since all is linear before the softmax, scoring needs only one number per bucket.

Every training text also comes as a copy with misspelt words, so that weight spreads over n-grams that survive a slip.

Training reads a bounded sample of labelled rows (``max_rows`` of either class, by hash, whole texts of any length), a fifth
of it held out to calibrate at the classes' true shares. Everything else covers all rows and whole texts. Beside the
sampled texts the driver holds the n-grams of one text at a time, some tables of one row a bucket, and ``SPOOL`` bytes of
n-grams; more of them lie in a temporary file of its own.

Defined results: null and empty texts, and texts without a word, get the share of toxic rows among the labelled; repeated rows get
equal results; null ids are allowed in the scored table; labels that are null or not 0/1 don't count; an empty table
gives an empty table, and without labels of both classes every score is 0. Other columns pass; columns named as the new
ones are replaced.
"""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerbrook.llm.common import SLICE_CHARS, bounded_batches, join_checked, lean, ngram_buckets, row_sums, shared, slices, trimmed, without

SIZES, BITS = (3, 4, 5), 18
#: An average counts so many n-grams without meaning besides its own, so that a short text needs more than one hint.
EMPTY = 60
#: Buckets that fewer training texts hold are not learnt.
LEAST_TEXTS = 6
#: Training takes so many steps at least, however small the sample.
STEPS = 200
#: Bytes of training texts' n-grams kept in memory, and of those of one batch.
SPOOL = 32 << 20

#: Digits that stand for letters, fixed values.
LOOKALIKES = {"o": "0", "i": "1", "s": "5", "a": "4", "e": "3", "t": "7"}


def misspelt(text: str, rng: np.random.Generator, share: float = 0.5) -> str:
    """A copy with about ``share`` of the longer words changed in one letter: swapped, doubled, dropped, a digit or a vowel."""
    words = text.split(" ")
    draws, ways, spots = rng.random(len(words)), rng.integers(0, 5, len(words)), rng.random(len(words))
    vowels = rng.integers(0, 5, len(words))
    for k, w in enumerate(words):
        if len(w) >= 4 and draws[k] < share:
            i = 1 + int(spots[k] * (len(w) - 3))
            words[k] = w[:i] + (w[i + 1] + w[i] + w[i + 2 :], w[i] + w[i:], w[i + 1 :], LOOKALIKES.get(w[i], "x") + w[i + 1 :], "aeiou"[vowels[k]] + w[i + 1 :])[ways[k]]
    return " ".join(words)


def parts(text: str):
    """A long text cut at spaces, so that no n-gram is cut: about ``SLICE_CHARS`` characters each."""
    at = 0
    while len(text) - at > SLICE_CHARS and (end := text.find(" ", at + SLICE_CHARS)) >= 0:
        yield text[at:end]
        at = end + 1
    yield text[at:]


class Bags:
    """Distinct buckets and their counts, text by text, beyond ``SPOOL`` bytes in a temporary file."""

    def __init__(self):
        self.file = tempfile.SpooledTemporaryFile(max_size=SPOOL)
        self.places: list[tuple[int, int, type]] = []

    def __len__(self) -> int:
        return len(self.places)

    def add(self, bucket: np.ndarray, count: np.ndarray) -> None:
        kind, shift = (np.uint32, 14) if count.max(initial=0) < 1 << 14 else (np.uint64, 32)
        data = (bucket.astype(kind) << kind(shift) | count.astype(kind)).tobytes()
        self.places.append((self.file.seek(0, 2), len(data), kind))
        self.file.write(data)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        at, size, kind = self.places[i]
        self.file.seek(at)
        data, shift = np.frombuffer(self.file.read(size), dtype=kind), 14 if kind is np.uint32 else 32
        return (data >> kind(shift)).astype(np.int32), (data & kind((1 << shift) - 1)).astype(np.int32)


class Model:
    def __init__(self, texts: list[str], toxic: list[int], shares: tuple[float, float], width: int = 8, epochs: int = 8, batch: int = 128, rate: float = 0.08, heat: float = 60.0, decay: float = 4e-3, seed: int = 7):
        """``shares``: of clean and toxic rows among all labelled rows."""
        self.slope, self.bias, self.stretch = np.zeros(1 << BITS, dtype=np.float32), -np.inf, 1.0
        self.share = float(shares[1] / sum(shares))
        y = np.array(toxic, dtype=np.int64)
        if not (0 < y.sum() < len(y)):
            return
        rng = np.random.default_rng(seed)
        y = np.concatenate([y, y])  # each text and its misspelt copy
        bags, seen = Bags(), np.zeros(1 << BITS, dtype=np.int64)
        for change in (None, rng):
            for b, n in self.bags(texts, change):
                seen[b] += 1
                bags.add(b, n)
        held = np.zeros(len(toxic), dtype=bool)
        held[rng.permutation(len(toxic))[: len(toxic) // 5]] = True
        held = np.concatenate([held, held])  # with their misspelt copies
        known = np.flatnonzero(seen >= LEAST_TEXTS)
        place = np.full(1 << BITS, -1, dtype=np.int32)
        place[known] = np.arange(len(known))
        idf = np.log(len(bags) / np.maximum(seen[known], 1)).astype(np.float32) + 0.1
        sub = rng.normal(0, 1 / width, (len(known), width)).astype(np.float32)
        soft = rng.normal(0, 1, (width, 2)).astype(np.float32)
        off = np.zeros(2, dtype=np.float32)
        g_sub, g_soft, g_off = (np.full(a.shape, 1e-8, dtype=np.float32) for a in (sub, soft, off))
        even = 0.5 / np.array([1 - y.mean(), y.mean()], dtype=np.float32)  # both classes weigh the same
        order = rng.permutation(np.flatnonzero(~held))
        groups = [order[at : at + batch] for at in range(0, len(order), batch)]  # fixed batches
        step, touched = np.zeros_like(sub), np.zeros(len(known), dtype=bool)

        def features(d):
            b, n = bags[d]
            f = place[b]
            ok = f >= 0
            f = f[ok]
            return f, (heat * n[ok] / (n.sum() + EMPTY) * idf[f]).astype(np.float32)

        for _ in range(max(epochs, -(-STEPS // len(groups)))):
            for k in rng.permutation(len(groups)):
                docs = groups[k]
                mean, kept, room = np.zeros((len(docs), width), dtype=np.float32), [], SPOOL
                for i, d in enumerate(docs):
                    f, w = features(d)
                    mean[i] = np.add.reduce(sub[f] * w[:, None], axis=0)
                    room -= 8 * len(f)
                    kept.append((f, w) if room > 0 else None)
                logit = mean @ soft + off
                p = np.exp(logit - logit.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(docs)), y[docs]] -= 1
                p *= even[y[docs]][:, None] / len(docs)
                back = p @ soft.T
                for i, d in enumerate(docs):
                    f, w = kept[i] or features(d)
                    step[f] += back[i] * w[:, None]  # a text's buckets are distinct
                    touched[f] = True
                own = np.flatnonzero(touched)
                slope = step[own] + decay * sub[own]
                g_sub[own] += slope * slope
                sub[own] -= rate * slope / np.sqrt(g_sub[own])
                step[own], touched[own] = 0, False
                for value, grad, memory in ((soft, mean.T @ p, g_soft), (off, p.sum(axis=0), g_off)):
                    memory += grad * grad
                    value -= rate * grad / np.sqrt(memory)
        self.slope[known] = heat * idf * (sub @ (soft[:, 1] - soft[:, 0]))
        self.bias, self.stretch = float(off[1] - off[0]), 1.0
        sums = np.array([(self.slope[b].astype(np.float64) @ n, n.sum()) for b, n in map(bags.__getitem__, np.flatnonzero(held))]).reshape(-1, 2)
        self.calibrate(self.chance(sums[:, 0], sums[:, 1]), y[held], shares)

    def calibrate(self, found: np.ndarray, y: np.ndarray, shares: tuple[float, float]) -> None:
        """Stretch and shift the softmax's log-odds by scores of rows it wasn't trained on, weighted to the classes' true shares."""
        if not (0 < y.sum() < len(y)):
            return
        p = np.clip(found, 1e-9, 1 - 1e-9)
        x = np.stack([np.log(p / (1 - p)), np.ones(len(y))], axis=1)
        weight = np.where(y == 1, shares[1] / y.mean(), shares[0] / (1 - y.mean()))
        at = np.array([1.0, 0.0])
        for _ in range(40):
            q = 1 / (1 + np.exp(-np.clip(x @ at, -500, 500)))
            slope = x.T @ (weight * (q - y)) / len(y) + 1e-3 * (at - [1, 0])
            bend = (x * (weight * q * (1 - q))[:, None]).T @ x / len(y) + 1e-3 * np.eye(2)
            at = at - np.clip(np.linalg.solve(bend, slope), -1, 1)
        self.stretch, self.bias = float(at[0]), self.bias + float(at[1] / max(at[0], 1e-6))

    @staticmethod
    def bags(texts: list[str], rng: np.random.Generator | None = None):
        """Distinct buckets and their counts of each text, one after another, or of its misspelt copy if there is a ``rng``."""
        for lo, hi in slices(texts):
            if max(map(len, texts[lo:hi])) > SLICE_CHARS:  # one text, and maybe empty ones before it
                for text in texts[lo:hi]:
                    count = np.zeros(1 << BITS, dtype=np.int64)
                    for part in parts(text):
                        for _, bucket in ngram_buckets([part if rng is None else misspelt(part, rng)], SIZES, BITS, digits=True):
                            count += np.bincount(bucket, minlength=1 << BITS)
                    own = np.flatnonzero(count)
                    yield own.astype(np.int32), count[own]
                continue
            found = [[] for _ in range(lo, hi)]
            some = texts[lo:hi] if rng is None else [misspelt(t, rng) for t in texts[lo:hi]]
            for row, bucket in ngram_buckets(some, SIZES, BITS, digits=True):
                first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else []
                for a, b in zip(first, [*first[1:], len(row)], strict=True):
                    found[row[a]].append(bucket[a:b].astype(np.int32))
            for x in found:
                yield np.unique(np.concatenate(x) if x else np.zeros(0, np.int32), return_counts=True)

    def chance(self, total: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Scores from the sums of weights and the numbers of n-grams."""
        found = 1 / (1 + np.exp(-np.clip(self.stretch * (total / (count + EMPTY) + self.bias), -700, 700)))
        return np.where(count > 0, found, self.share)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        total, count = np.zeros(len(texts)), np.zeros(len(texts))
        if not np.isfinite(self.bias):  # never trained
            return total
        for row, bucket in ngram_buckets(texts, SIZES, BITS, digits=True):
            row_sums(row, self.slope[bucket].astype(np.float64), total)
            row_sums(row, np.ones(len(row)), count)
        return self.chance(total, count)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = 2000, max_chars: int = 24_000_000) -> Model:
    """Train on a sample of the labelled texts; ``labels`` has the rows to learn from only.

    Of either class about ``max_rows`` texts are drawn, by a hash of id and text, fewer if they would hold more than
    about ``max_chars`` characters together. Whole texts of any length are drawn alike.
    """
    marks = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y")).where("id is not null and y in (0, 1)")
    marks = shared(marks.groupBy("id").agg(F.max("y").alias("y")))
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("t")).where("t is not null")
    found = join_checked(texts, marks, "id", "inner", 32)
    counts = {r.y: r for r in found.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("t")).alias("chars")).collect()}
    if len(counts) < 2:
        return Model([], [], (1.0, 1.0))
    rate = {y: min(1.0, max_rows / r["n"], max_chars / max(r.chars, 1)) for y, r in counts.items()}
    spread = F.pmod(F.xxhash64("id", "t", F.lit(3)), F.lit(1 << 40)) / float(1 << 40)
    drawn = found.where(spread < F.when(F.col("y") == 1, rate[1]).otherwise(rate[0]))
    got = sorted((r.id, r.y, r.t) for r in drawn.collect())  # max_rows of either class, about
    model = Model([t for _, _, t in got], [y for _, y, _ in got], (counts[0]["n"], counts[1]["n"]))
    del got
    trimmed()
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 from ``threshold`` on)."""
    bounded_batches(docs.sparkSession)
    docs = without(docs, ["score", "predicted"])
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                s = sent.value.scores(part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32), pa.int32())], names=schema.names)

    return docs.mapInArrow(lean(predict), schema)
