"""Masked pseudo-likelihood: a bidirectional window network predicts every word from both sides.

A document's score is the sum over its words of log P(word | the words around it). Outputs are the most frequent words of
the corpus, each its own, and rests: all other words that end alike. P(word | rest) follows the words' counts in the whole
corpus: exact for the ``KNOWN`` most frequent, for others the mean of the cell that they fall to by hash. Outputs that end
alike form a group, and the network gives P(group | around) * P(output | group, around).

The network (numpy): an embedding for each neighbour and offset, summed, a tanh layer, two softmaxes. It starts from the
corpus' own frequencies. Documents are dealt to shards by their content, a shard for each ``SHARD_WORDS`` words, and to
``rounds``; in each round every shard trains a copy of the network on every word of its documents of that round, and the
copies are averaged, weighted by the words they saw. So each word of the corpus is a training target once, the work of a
task is bounded, and the result doesn't depend on how the table is partitioned.

Defined results: a null or empty text has no word and log_prob 0; repeated rows get equal results; null ids are allowed;
an empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerbrook.llm.common import bounded_batches, lean, shared, slices

#: Words with outputs of their own, rests and groups of outputs; neighbours on either side; width of the hidden layer.
OWN, RESTS, GROUPS, SIDE, WIDTH = 512, 256, 16, 2, 16
#: Words whose counts are known one by one, and cells for the counts of all others.
KNOWN, CELLS = 1 << 17, 1 << 18
#: What a word never seen counts.
UNSEEN = 0.5
#: Words that one task trains on in all rounds, about, and in one step; words counted at once in a task.
SHARD_WORDS, STEP, BLOCK = 2_000_000, 4096, 1 << 20
#: Copies of the network averaged in one task.
FAN = 16


class WordNumbers(dict):
    """64-bit numbers of words; the upper 8 bits tell the last three bytes."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 250_000:
            self.clear()
        self[word] = h = (xxhash.xxh3_64_intdigest(word[-3:]) % RESTS) << 56 | xxhash.xxh3_64_intdigest(word) >> 8
        return h


NUMBERS = WordNumbers()


def numbered(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all lower-cased words, and the number of words of each text."""
    words = [t.encode("utf-8", "surrogatepass").lower().split() if t else [] for t in texts]
    count = np.array([len(w) for w in words], dtype=np.int64)
    return np.fromiter(map(NUMBERS.__getitem__, itertools.chain.from_iterable(words)), dtype=np.uint64, count=int(count.sum())), count


def prepared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, words) of all documents, written once: the texts as word numbers."""
    bounded_batches(docs.sparkSession)
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`"))
    schema = T.StructType([source.schema[0], T.StructField("n_words", T.LongType()), T.StructField("words", T.BinaryType())])

    def run(batches):
        try:
            for batch in batches:
                for lo in range(0, batch.num_rows, 256):
                    part = batch.slice(lo, 256)
                    texts = part.column(1).to_pylist()
                    for a, b in slices(texts):
                        w, n = numbered(texts[a:b])
                        ends = np.concatenate([[0], np.cumsum(n)])
                        blobs = [w[x:y].tobytes() for x, y in itertools.pairwise(ends)]
                        yield pa.RecordBatch.from_arrays([part.column(0).slice(a, b - a), pa.array(n, pa.int64()), pa.array(blobs, pa.binary())], names=schema.names)
        finally:
            NUMBERS.clear()

    return shared(source.mapInArrow(lean(run), schema))


def count_words(ready: DataFrame) -> DataFrame:
    """(word, n) of all documents; blocks are counted where they are."""

    def run(batches):
        held, size = [], 0

        def counted():
            w, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(w.view(np.int64), pa.int64()), pa.array(n, pa.int64())], names=["word", "n"])

        for batch in batches:
            for blob in batch.column(0):
                held.append(np.frombuffer(blob.as_buffer(), np.uint64))
                size += len(held[-1])
            if size >= BLOCK:
                yield counted()
                held, size = [], 0
        if size:
            yield counted()

    return ready.where("n_words > 0").select("words").mapInArrow(lean(run), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Vocabulary:
    """Output numbers of words, their groups, and log P(word | output)."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, cells: np.ndarray, types: np.ndarray):
        """``words`` (sorted) with their counts; sums of counts and numbers of words in the cells of all others.

        ``cells`` and ``types`` are (RESTS, CELLS / RESTS): a word's cell is within its rest.
        """
        self.words = words
        top = np.lexsort((words, -counts))[:OWN]
        rest = (words >> np.uint64(56)).astype(np.int64)
        member = np.concatenate([np.arange(RESTS), rest[top]])  # rests first, then own words
        order = np.argsort(member % GROUPS, kind="stable")
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        self.rest_output = place[:RESTS]
        self.output = self.rest_output[rest]
        self.output[top] = place[RESTS:]
        self.group = (member % GROUPS)[order].astype(np.uint8)
        self.start = np.searchsorted(self.group, np.arange(GROUPS + 1))
        apart = np.ones(len(words), dtype=bool)
        apart[top] = False
        total = np.bincount(rest[apart], weights=counts[apart] + UNSEEN, minlength=RESTS) + (cells + UNSEEN * types).sum(axis=1) + UNSEEN
        self.within = np.log(counts + UNSEEN) - np.log(total)[rest]
        self.within[top] = 0
        mean = np.where(types > 0, cells / np.maximum(types, 1), 0) + UNSEEN
        self.cell = (np.log(mean) - np.log(total)[:, None]).astype(np.float32)
        self.count = np.bincount(self.output, weights=counts, minlength=len(order)).astype(np.float64)
        self.count[self.rest_output] += cells.sum(axis=1)

    def __len__(self) -> int:
        return len(self.group)

    def ids(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each word's output, and log P(word | output)."""
        rest = (words >> np.uint64(56)).astype(np.int64)
        out, within = self.rest_output[rest], self.cell[rest, (words % np.uint64(CELLS // RESTS)).astype(np.int64)].astype(np.float64)
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
            hit = self.words[at] == words
            out[hit], within[hit] = self.output[at[hit]], self.within[at[hit]]
        return out, within


class Network:
    def __init__(self, vocabulary: Vocabulary, seed: int = 3):
        self.start, self.group = vocabulary.start, vocabulary.group
        n, rng = len(vocabulary), np.random.default_rng(seed)
        self.near = rng.normal(0, 0.1, (2 * SIDE, n + 1, WIDTH)).astype(np.float32)  # the last row: beyond a text's end
        self.bend = np.zeros(WIDTH, dtype=np.float32)
        self.top = np.zeros((WIDTH, GROUPS), dtype=np.float32)
        self.out = np.zeros((n, WIDTH), dtype=np.float32)
        count = vocabulary.count + 1.0
        in_group = np.bincount(self.group, weights=count, minlength=GROUPS)
        self.top_base = np.log(np.maximum(in_group, 1e-9) / count.sum()).astype(np.float32)
        self.out_base = np.log(count / in_group[self.group]).astype(np.float32)

    def parts(self) -> list[np.ndarray]:
        return [self.near, self.bend, self.top, self.out, self.top_base, self.out_base]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()])

    def load(self, flat: np.ndarray) -> Network:
        at = 0
        for p in self.parts():
            p[...] = flat[at : at + p.size].reshape(p.shape)
            at += p.size
        return self

    def hidden(self, around: np.ndarray) -> np.ndarray:
        h = self.near[0].take(around[0], axis=0)
        for k in range(1, 2 * SIDE):
            h += self.near[k].take(around[k], axis=0)
        h += self.bend
        return np.tanh(h, out=h)

    def _members(self, h: np.ndarray, group: np.ndarray):
        """For each group of targets, which stand together: its rows, its outputs and their shares."""
        ends = np.searchsorted(group, np.arange(GROUPS + 1))
        for g in np.flatnonzero(ends[1:] > ends[:-1]):
            rows, own = slice(ends[g], ends[g + 1]), slice(self.start[g], self.start[g + 1])
            x = h[rows] @ self.out[own].T
            x += self.out_base[own]
            yield rows, own, softmax(x)

    def by_group(self, around: np.ndarray, target: np.ndarray):
        """The order in which targets of a group stand together, and all in that order."""
        order = np.argsort(self.group[target], kind="stable")
        return order, around[:, order], target[order]

    def log_probs(self, around: np.ndarray, target: np.ndarray) -> np.ndarray:
        order, around, target = self.by_group(around, target)
        h, group = self.hidden(around), self.group[target]
        found = np.log(softmax(h @ self.top + self.top_base)[np.arange(len(target)), group])
        for rows, own, p in self._members(h, group):
            found[rows] += np.log(p[np.arange(len(p)), target[rows] - own.start])
        out = np.empty_like(found)
        out[order] = found
        return out

    def train(self, around: np.ndarray, target: np.ndarray, memory: list[np.ndarray], rate: float) -> None:
        """A step over all of ``target``."""
        n = len(target)
        _, around, target = self.by_group(around, target)
        h, group = self.hidden(around), self.group[target]
        p = softmax(h @ self.top + self.top_base)
        p[np.arange(n), group] -= 1
        p /= n
        back = p @ self.top.T

        def step(value, grad, mem):
            mem += grad * grad
            grad *= rate
            grad /= np.sqrt(mem)
            value -= grad

        for rows, own, q in self._members(h, group):
            q[np.arange(len(q)), target[rows] - own.start] -= 1
            q /= n
            back[rows] += q @ self.out[own]
            step(self.out[own], q.T @ h[rows], memory[3][own])
            step(self.out_base[own], q.sum(axis=0), memory[5][own])
        step(self.top, h.T @ p, memory[2])
        step(self.top_base, p.sum(axis=0), memory[4])
        h *= h
        np.subtract(1, h, out=h)
        back *= h
        step(self.bend, back.sum(axis=0), memory[1])
        for k in range(2 * SIDE):  # of the embeddings only the rows in use
            order = np.argsort(around[k], kind="stable")
            ids = around[k].take(order)
            first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
            grad, own = np.add.reduceat(back.take(order, axis=0), first, axis=0), ids[first]
            mem = memory[0][k].take(own, axis=0)
            mem += grad * grad
            memory[0][k][own] = mem
            grad *= rate
            grad /= np.sqrt(mem)
            self.near[k][own] -= grad

    def blank_memory(self) -> list[np.ndarray]:
        return [np.full(p.shape, 1e-6, dtype=np.float32) for p in self.parts()]


def softmax(x: np.ndarray) -> np.ndarray:
    x -= x.max(axis=1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(axis=1, keepdims=True)
    return x


def surroundings(ids: np.ndarray, count: np.ndarray, edge: int) -> np.ndarray:
    """(2 * SIDE, words): each word's neighbours, ``edge`` beyond a text's ends."""
    owner = np.repeat(np.arange(len(count)), count)
    out = np.full((2 * SIDE, len(ids)), edge, dtype=np.uint16)  # small numbers sort fastest
    for k in range(1, SIDE + 1):
        if len(ids) > k:
            same = owner[k:] == owner[:-k]
            out[SIDE - k, k:][same] = ids[:-k][same]
            out[SIDE + k - 1, :-k][same] = ids[k:][same]
    return out


def learn_words(ready: DataFrame) -> Vocabulary:
    counts = shared(count_words(ready))
    grade = F.floor(F.log2("n") * 16)  # counts in some hundred grades; the upper ones are known as far as there is room
    room, least = KNOWN, None
    for r in sorted(counts.groupBy(grade.alias("grade")).agg(F.count(F.lit(1)).alias("k")).collect(), reverse=True):
        if r.k > room:
            break
        room, least = room - r.k, r.grade
    known = counts.where(grade >= least) if least is not None else counts.limit(0)
    got = known.toArrow().sort_by("word")  # at most KNOWN rows
    words = got["word"].to_numpy().view(np.uint64)
    order = np.argsort(words)
    rest = F.shiftrightunsigned("word", 56).cast("int")
    cell = F.pmod("word", F.lit(CELLS // RESTS)).cast("int")  # a power of two: the same for signed numbers
    others = counts.where(grade < least) if least is not None else counts
    summed = others.groupBy(rest.alias("rest"), cell.alias("cell")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("types")).toArrow()  # at most CELLS rows
    cells, types = np.zeros((RESTS, CELLS // RESTS)), np.zeros((RESTS, CELLS // RESTS))
    at = summed["rest"].to_numpy(), summed["cell"].to_numpy()
    cells[at], types[at] = summed["n"].to_numpy(), summed["types"].to_numpy()
    return Vocabulary(words[order], got["n"].to_numpy()[order].astype(np.float64), cells, types)


def fit(ready: DataFrame, rate: float = 0.4, rounds: int = 2) -> tuple[Vocabulary, Network]:
    """Count and train on all words of ``ready`` (see ``prepared``)."""
    vocabulary = learn_words(ready)
    network = Network(vocabulary)
    total = int(vocabulary.count.sum())
    if not total:
        return vocabulary, network
    context = ready.sparkSession.sparkContext
    shards = -(-total // SHARD_WORDS)
    vocab_sent = context.broadcast(vocabulary)

    def as_outputs(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(0).slice(lo, 256)]
                out, _ = vocab_sent.value.ids(np.concatenate(part))
                ends = np.concatenate([[0], np.cumsum([len(x) for x in part])])
                mark = np.array([xxhash.xxh3_64_intdigest(x.tobytes()) for x in part], dtype=np.uint64)
                blobs = [out[a:b].astype(np.uint16).tobytes() for a, b in itertools.pairwise(ends)]
                cols = [mark % np.uint64(shards), mark // np.uint64(shards) % np.uint64(rounds), mark]
                yield pa.RecordBatch.from_arrays([*(pa.array(c.view(np.int64), pa.int64()) for c in cols), pa.array(blobs, pa.binary())], names=["shard", "round", "mark", "outputs"])

    dealt = shared(ready.where("n_words > 0").select("words").mapInArrow(lean(as_outputs), "shard long, round long, mark long, outputs binary"))
    schema = "shard long, seen long, flat binary"

    def average(key, rows):
        rows = rows.sort_by("shard")
        seen = rows["seen"].to_numpy()
        flat = np.zeros(len(rows["flat"][0].as_buffer()) // 4)
        for n, x in zip(seen, rows["flat"], strict=True):
            flat += n * np.frombuffer(x.as_buffer(), np.float32)
        return pa.table([pa.array([int(rows["shard"][0].as_py()) // FAN], pa.int64()), pa.array([int(seen.sum())], pa.int64()), pa.array([(flat / seen.sum()).astype(np.float32).tobytes()], pa.binary())], names=["shard", "seen", "flat"])

    for at in range(rounds):
        flat_sent = context.broadcast(network.flat())

        def train(key, rows, flat_sent=flat_sent):
            own, edge = Network(vocab_sent.value).load(flat_sent.value), len(vocab_sent.value)
            memory, seen = [m + 1e-4 for m in own.blank_memory()], 0
            order = np.argsort(rows["mark"].to_numpy(), kind="stable")
            blobs = rows["outputs"].combine_chunks() if rows["outputs"].num_chunks != 1 else rows["outputs"].chunk(0)
            held, size = [], 0
            for k, i in enumerate(order):
                held.append(np.frombuffer(blobs[int(i)].as_buffer(), np.uint16))
                size += len(held[-1])
                if size >= 32 * STEP or k + 1 == len(order):
                    ids = np.concatenate(held)
                    around = surroundings(ids, np.array([len(x) for x in held]), edge)
                    mixed = np.random.default_rng(k).permutation(len(ids))  # neighbours in a step are alike
                    for lo in range(0, len(ids), STEP):
                        pick = mixed[lo : lo + STEP]
                        own.train(around[:, pick], ids[pick], memory, rate)
                    seen += len(ids)
                    held, size = [], 0
            return pa.table([pa.array([int(key[0].as_py())], pa.int64()), pa.array([seen], pa.int64()), pa.array([own.flat().tobytes()], pa.binary())], names=["shard", "seen", "flat"])

        copies = dealt.where(F.col("round") == at).select("shard", "mark", "outputs").groupBy("shard").applyInArrow(lean_group(train), schema)
        left = shards
        while left > 1:  # FAN copies meet in a task, again and again
            copies = copies.groupBy(F.floor(F.col("shard") / FAN)).applyInArrow(average, schema)
            left = -(-left // FAN)
        found = copies.collect()
        if found:
            network.load(np.frombuffer(found[0].flat, np.float32))
        flat_sent.unpersist()
    return vocabulary, network


def lean_group(function):
    """``lean`` for a function over groups."""

    def run(key, rows):
        return next(lean(lambda _: iter([function(key, rows)]))(None))

    return run


def score(ready: DataFrame, vocabulary: Vocabulary, network: Network, id_name: str = "doc_id") -> DataFrame:
    """Per document: its id, n_words, log_prob (the sum) and mean_log_prob (null without words)."""
    schema = T.StructType([T.StructField(id_name, ready.schema["id"].dataType), T.StructField("n_words", T.LongType()), T.StructField("log_prob", T.DoubleType()), T.StructField("mean_log_prob", T.DoubleType())])
    sent = ready.sparkSession.sparkContext.broadcast((vocabulary, network))

    def run(batches):
        vocab, net = sent.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                n = part.column(1).to_numpy()
                begin, total = 0, np.zeros(len(n))
                while begin < len(n):  # some documents at once
                    end = begin + max(1, int(np.searchsorted(np.cumsum(n[begin:]), 1 << 16)))
                    words = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in part.column(2).slice(begin, end - begin)])
                    ids, each = vocab.ids(words)
                    own = n[begin:end]
                    around = surroundings(ids, own, len(vocab))
                    for i in range(0, len(ids), 8192):
                        each[i : i + 8192] += net.log_probs(around[:, i : i + 8192], ids[i : i + 8192])
                    ends = np.concatenate([[0], np.cumsum(own)])
                    total[begin:end] = [each[a:b].sum() for a, b in itertools.pairwise(ends)]  # each text's own sum, whatever stands beside it
                    begin = end
                mean = pa.array(total / np.maximum(n, 1), pa.float64(), mask=n == 0)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(total, pa.float64()), mean], names=schema.names)

    return ready.select("id", "n_words", "words").mapInArrow(lean(run), schema)
