"""Language identification in two steps: the family first, then one-versus-one linear SVMs within the family.

A text is the mean of its hashed character n-grams (1 to 3, within words), over the whole text. Linear support vector
machines (squared hinge, trained here in numpy) score families one versus rest, and each pair of languages of one
family. All their weights lie in one table with a row per n-gram bucket, so a text takes one pass. Within the family the
language with most pair votes wins; equal votes go to the larger sum of margins, then to the name that sorts first.

Training reads a bounded sample of labelled rows: about ``rows_per_lang`` of each language, taken by hash, whole texts of any
length. Everything else covers all rows and whole texts.

Defined results: ``und`` with score 0 for a text that is null, empty or without a letter; repeated rows get equal
results; null ids are allowed; an empty table gives an empty table, and with no labelled row every text is ``und``.
Other columns pass; columns named as the new ones are replaced.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerbrook.llm.common import SLICE_CHARS, bounded_batches, has_letter, lean, ngram_buckets, row_sums, slices, without

SIZES, BITS = (1, 2, 3), 13
UNKNOWN = "und"
#: Families of common languages, fixed values; any other language is a family of its own.
FAMILIES = {
    "germanic": "af da de en is lb nl nn no sv".split(),
    "romance": "ca es fr gl it oc pt ro".split(),
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk".split(),
    "uralic": "et fi hu".split(),
    "turkic": "az kk ky tr tt uz".split(),
    "indic": "bn gu hi mr ne pa si ur".split(),
    "baltic": "lt lv".split(),
    "celtic": "br cy ga gd".split(),
    "semitic": "am ar he mt".split(),
}


def family(lang: str) -> str:
    stem = lang.lower().split("-")[0].split("_")[0]
    return next((f for f, members in FAMILIES.items() if stem in members), lang)


class Rows:
    """Sparse rows: buckets and values one after another, and where each row begins (one more at the end)."""

    def __init__(self, bucket: np.ndarray, value: np.ndarray, begin: np.ndarray):
        self.bucket, self.value, self.begin = bucket, value, begin
        self.size = np.diff(begin)

    def times(self, w: np.ndarray) -> np.ndarray:
        """The rows' products with a vector."""
        run = np.concatenate([[0.0], np.cumsum(self.value * w[self.bucket], dtype=np.float64)])
        return run[self.begin[1:]] - run[self.begin[:-1]]

    def back(self, p: np.ndarray) -> np.ndarray:
        """The sum of the rows, each times its number."""
        return np.bincount(self.bucket, weights=self.value * np.repeat(p, self.size), minlength=1 << BITS)

    def pick(self, own: np.ndarray) -> Rows:
        inside = np.repeat(own, self.size)
        return Rows(self.bucket[inside], self.value[inside], np.concatenate([[0], np.cumsum(self.size[own])]))


def features(texts: list[str | None]) -> Rows:
    """The share of each n-gram bucket in each text."""
    bucket, value, size = [], [], []
    for at in range(0, len(texts), 64):
        part = texts[at : at + 64]
        count = np.zeros((len(part), 1 << BITS), dtype=np.float32)
        for row, b in ngram_buckets(part, SIZES, BITS):
            for r in np.unique(row):
                count[r] += np.bincount(b[row == r], minlength=1 << BITS)
        count /= np.maximum(count.sum(axis=1, keepdims=True), 1)
        r, b = np.nonzero(count)
        bucket.append(b.astype(np.int32))
        value.append(count[r, b])
        size.append(np.bincount(r, minlength=len(part)))
    whole = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    return Rows(whole(bucket, np.int32), whole(value, np.float32), np.concatenate([[0], np.cumsum(whole(size, np.int64))]))


def linear_svm(x: Rows, y: np.ndarray, c: float = 50.0, steps: int = 60) -> tuple[np.ndarray, float]:
    """Weights and bias minimising |w|^2/2 + c * mean(class-weighted squared hinge), by accelerated gradient steps."""
    share = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1))
    v = np.ones(1 << BITS)
    for _ in range(8):  # the largest eigenvalue bounds the step
        v = x.back(share * x.times(v))
        v /= max(np.linalg.norm(v), 1e-12)
    rate = 1 / (1 + 2 * c * (float(v @ x.back(share * x.times(v))) + 1))
    w = np.zeros((1 << BITS) + 1)
    last, ahead = w.copy(), w.copy()
    for k in range(1, steps + 1):
        slack = np.maximum(0, 1 - y * (x.times(ahead[:-1]) + ahead[-1]))
        push = share * slack * y
        grad = np.append(ahead[:-1] - 2 * c * x.back(push), -2 * c * push.sum())
        last, w = w, ahead - rate * grad
        ahead = w + (k - 1) / (k + 2) * (w - last)
    return w[:-1].astype(np.float32), float(w[-1])


class Model:
    """``weights`` (buckets, machines) and ``bias`` hold the family machines first, then each family's pairs."""

    def __init__(self, texts: list[str], langs: list[str]):
        self.langs = sorted(set(langs))
        self.families = sorted({family(x) for x in self.langs})
        self.members = [[i for i, x in enumerate(self.langs) if family(x) == f] for f in self.families]
        x = features(texts)
        scale = (1 / np.sqrt(x.back(np.full(len(texts), 1 / max(len(texts), 1))) + 1e-5)).astype(np.float32)
        x.value *= scale[x.bucket]
        lang = np.array([self.langs.index(v) for v in langs])
        kin = np.array([self.families.index(family(v)) for v in langs])
        found = [linear_svm(x, np.where(kin == f, 1.0, -1.0).astype(np.float32)) for f in range(len(self.families))]
        self.pairs = [list(itertools.combinations(m, 2)) for m in self.members]
        for a, b in itertools.chain(*self.pairs):
            own = (lang == a) | (lang == b)
            found.append(linear_svm(x.pick(own), np.where(lang[own] == a, 1.0, -1.0).astype(np.float32)))
        self.weights = np.stack([w * scale for w, _ in found], axis=1).astype(np.float32) if found else np.zeros((1 << BITS, 0), np.float32)
        self.bias = np.array([b for _, b in found])

    def margins(self, texts: list[str | None]) -> np.ndarray:
        total, count = np.zeros((len(texts), len(self.bias))), np.zeros(len(texts))
        piece = 2 * SLICE_CHARS // max(1, len(self.bias) // 16)  # with many machines fewer n-grams at once
        for row, bucket in ngram_buckets(texts, SIZES, BITS, piece=piece):
            row_sums(row, self.weights[bucket].astype(np.float64), total)
            row_sums(row, np.ones(len(row)), count)
        return total / np.maximum(count, 1)[:, None] + self.bias

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        if not self.langs:
            return [(UNKNOWN, 0.0) for _ in texts]
        sure = lambda m: 1 / (1 + np.exp(-3 * m))
        out, at = [], np.cumsum([len(self.families), *map(len, self.pairs)])
        for text, m in zip(texts, self.margins(texts), strict=True):
            if not text or not has_letter(text):
                out.append((UNKNOWN, 0.0))
                continue
            kin = int(m[: at[0]].argmax())
            votes = {i: [0, 0.0] for i in self.members[kin]}
            score = float(sure(m[kin])) if len(self.families) > 1 else 1.0
            own = dict(zip(self.pairs[kin], m[at[kin] : at[kin + 1]], strict=True))
            for (a, b), v in own.items():
                votes[a if v >= 0 else b][0] += 1
                votes[a][1] += v
                votes[b][1] -= v
            best = max(votes, key=lambda i: (*votes[i], -i))
            if own:
                score *= float(min(sure(v if a == best else -v) for (a, b), v in own.items() if best in (a, b)))
            out.append((self.langs[best], score))
        return out


def fit(labelled: DataFrame, text: Column, lang: Column, key: Column, rows_per_lang: int = 400, max_rows: int = 20_000, max_chars: int = 48_000_000) -> Model:
    """Train on a sample of ``labelled``, drawn by a hash of ``key`` and text.

    About ``rows_per_lang`` texts of each language, fewer if all languages together would take more than ``max_rows`` texts or
    about ``max_chars`` characters. Whole texts of any length are drawn alike.
    """
    rows = labelled.select(text.alias("t"), lang.cast("string").alias("l"), F.xxhash64(F.lit(5), key, text).alias("h")).where("l is not null and t is not null")
    counts = {r.l: r for r in rows.groupBy("l").agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("t")).alias("chars")).collect()}  # a row per language
    if not counts:
        return Model([], [])
    share = 1 / len(counts)
    rates = {k: min(1.0, rows_per_lang / r["n"], share * max_rows / r["n"], share * max_chars / max(r.chars, 1)) for k, r in counts.items()}
    rate = F.create_map([F.lit(x) for kv in rates.items() for x in kv])[F.col("l")]
    spread = F.pmod("h", F.lit(1 << 40)) / float(1 << 40)
    got = rows.where(spread < rate).collect()
    got.sort(key=lambda r: (r.l, r.t))
    return Model([r.t for r in got], [r.l for r in got])


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score."""
    bounded_batches(docs.sparkSession)
    docs = without(docs, ["lang_pred", "score"])
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                texts = part.column(at).to_pylist()
                found = [x for a, b in slices(texts) for x in sent.value.predict(texts[a:b])]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=schema.names
                )

    return docs.mapInArrow(lean(predict), schema)
