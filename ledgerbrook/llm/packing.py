"""Tokenise documents with a public vocabulary and pack them into sequences by vector best fit.

Every document's ids end with one separator id. Only documents longer than a sequence are cut. Pieces go to groups by a
hash of their id, their content and the partition they are made in, so that no repeated row makes a group large; each group is packed on its own, so no task holds more than a group, and the loss is at most a part of
one sequence per group. In a group the pieces come longest first. Each goes to the open sequence where, under every
capacity (tokens, documents, attention cost), the weighted norm of what stays free is least (``rule="norm"``) or the
weighted dot product of need and free capacity is greatest (``rule="dot"``); if none has room a new one opens.

Defined results: a null text is empty, so its piece is the separator alone; repeated rows are packed each on its own;
null ids are allowed; an empty table gives no pieces. Columns beside id and text are ignored.
"""

from __future__ import annotations

import codecs
import math
import os
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerbrook.llm.common import bounded_batches, lean

#: Texts in which a capital can't be put in lower case by itself: a mark after it may join it, or it's in a special token.
ODD = "[^\\x00-\\x{2ff}]|<\\|"


@cache
def tokenizer(path: str):
    """The vocabulary as it is; without all that plain words don't need; which ids end a word; and ids known so far."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer, pre_tokenizers

    whole, plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
    plain.normalizer = None  # plain words need no normalisation, and only spaces separate them
    plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    named = whole.get_vocab()
    ends = np.zeros(max(named.values()) + 1, dtype=bool)
    ends[[i for name, i in named.items() if name.endswith("</w>")]] = True
    return whole, plain, ends, {}


@cache
def byte_letters() -> str:
    """The letter that stands for each byte in a byte-level vocabulary; a space stays one."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in own]
    return "".join(" " if b == 32 else chr(b) if b in own else chr(256 + rest.index(b)) for b in range(256))


def stem(word: str) -> tuple[str, str, bool]:
    """A word as a part that many words share and one mark after it, which encoded apart give the ids of the word; and
    whether that part is plain: letters in lower case that no normalisation changes.
    """
    if word.isascii() or (max(word) < "\u0300" and "\u0130" not in word):
        if "<|" not in word:
            word = word.lower()
            if word.isalpha():
                return word, "", True
            if word[-1] in ".,;:!?" and len(word) > 1 and word[-2].isalpha():
                return word[:-1], word[-1], word[:-1].isalpha()
    return word, "", False


def encode_into(known: dict[str, bytes], words: list[str], model) -> None:
    for at in range(0, len(words), 500):
        part = words[at : at + 500]
        found = model.encode(" ".join(part), add_special_tokens=False)
        data = np.array(found.ids, dtype="<u4").tobytes()
        begins = np.cumsum([0, *(len(w) + 1 for w in part)])
        cuts = (4 * np.searchsorted(np.array([a for a, _ in found.offsets] or [0]), begins)).tolist()
        known.update((w, data[a:b]) for w, a, b in zip(part, cuts[:-1], cuts[1:], strict=True))


def encode_plain(known: dict[str, bytes], words: list[str], model, ends: np.ndarray) -> None:
    """As ``encode_into``, for plain words: each ends with the first id that ends a word, so no offsets are needed."""
    for at in range(0, len(words), 200):
        part = words[at : at + 200]
        letters = codecs.charmap_decode(" ".join(part).encode(), "strict", byte_letters())[0]
        ids = np.array(model.encode_batch_fast([letters], add_special_tokens=False)[0].ids, dtype="<u4")
        data, cuts = ids.tobytes(), (4 * np.flatnonzero(ends[ids]) + 4).tolist()
        known.update((w, data[a:b]) for w, a, b in zip(part, [0, *cuts[:-1]], cuts, strict=True))


def ids_of(texts: pa.Array, path: str, words_kept: int = 900_000) -> list[bytes]:
    """Ids of each text as little-endian unsigned 32-bit numbers.

    The vocabulary drops white space and never joins across it, so each word is encoded once and remembered; new words
    are encoded many at a time. Arrow splits the texts and finds their distinct words, so Python sees each only once.
    """
    whole, plain, ends, known = tokenizer(path)
    texts = pc.fill_null(texts, "")
    texts = pc.if_else(pc.match_substring_regex(texts, ODD), texts, pc.ascii_lower(texts))
    split = pc.ascii_split_whitespace(texts)
    coded = split.values.dictionary_encode()
    n = len(coded.dictionary)
    words = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), coded.dictionary), " ")[0].as_py().split(" ")
    if len(known) > words_kept:
        known.clear()
    known[""] = b""
    found = list(map(known.get, words))
    new = [i for i, data in enumerate(found) if data is None]
    easy, hard, made = set(), set(), []
    for w in map(words.__getitem__, new):
        s, mark, is_plain = stem(w)
        if s not in known:
            (easy if is_plain else hard).add(s)
        if mark and mark not in known:
            hard.add(mark)
        if mark or s != w:
            made.append((w, s, mark))
    encode_plain(known, list(easy), plain, ends)
    encode_into(known, list(hard), whole)
    known.update((w, known[s] + known[mark]) for w, s, mark in made)
    for i in new:
        found[i] = known[words[i]]
    sizes = np.fromiter(map(len, found), dtype=np.int64, count=n)
    begins = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(begins), pa.py_buffer(b"".join(found))]).take(coded.indices)
    cuts = np.concatenate([[0], np.cumsum(sizes[coded.indices.to_numpy()])])[split.offsets.to_numpy()].tolist()
    data = memoryview(ids.buffers()[2] or b"")
    return [bytes(data[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def best_fit(needs: np.ndarray, capacity: np.ndarray, weights: np.ndarray, rule: str = "norm") -> tuple[np.ndarray, int]:
    """Bin of each item and the number of bins; items in the order given, ``needs`` is (items, dimensions)."""
    where, bins = np.empty(len(needs), dtype=np.int64), 0
    free = np.empty((max(16, len(needs) // 4), needs.shape[1]))
    scaled = weights / capacity**2
    open_ids = np.empty(len(free), dtype=np.int64)
    n_open = 0
    least = np.minimum.accumulate(needs[::-1], axis=0)[::-1] if len(needs) else needs
    for i, x in enumerate(needs):
        left = free[:n_open] - x
        fits = (left >= 0).all(axis=1)
        if fits.any():
            score = -(left * left) @ scaled if rule == "norm" else free[:n_open] @ (scaled * x)
            score[~fits] = -np.inf
            at = int(score.argmax())
            free[at] -= x
            where[i] = open_ids[at]
        else:
            if (x > capacity).any():
                raise ValueError("an item exceeds the capacity")
            if n_open == len(free):
                free, open_ids = np.concatenate([free, np.empty_like(free)]), np.concatenate([open_ids, np.empty_like(open_ids)])
            at, n_open = n_open, n_open + 1
            free[at], open_ids[at], where[i] = capacity - x, bins, bins
            bins += 1
        if i + 1 < len(needs) and (free[at] < least[i + 1]).any():  # nothing to come fits here
            n_open -= 1
            free[at], open_ids[at] = free[n_open], open_ids[n_open]
    return where, bins


def pieces(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", size: int = 4096, end_id: int = 1, with_ids: bool = True, words_kept: int = 900_000, forget: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32, ids): each document's ids, cut only where it is longer than ``size``.

    ``ids`` (little-endian unsigned 32-bit numbers) is null unless asked for. With ``forget`` a worker keeps no words from
    task to task.
    """
    bounded_batches(docs.sparkSession)
    kind = T._parse_datatype_string("struct<piece:int,start:long,length:long,ids_crc32:long,ids:binary>")
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *kind.fields])
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for k, data in enumerate(ids_of(batch.column(1), vocabulary, words_kept)):
                data += end
                for j, b in enumerate(range(0, len(data), 4 * size)):
                    part = data[b : b + 4 * size]
                    row.append(k)
                    piece.append(j)
                    start.append(b // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    ids.append(part if with_ids else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(ids, pa.binary())],
                names=schema.names,
            )

    def cut_and_forget(batches):
        try:
            yield from cut(batches)
        finally:
            tokenizer(vocabulary)[-1].clear()

    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(lean(cut_and_forget if forget else cut), schema)


def pack(
    docs: DataFrame,
    vocabulary: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 4096,
    max_docs: int | None = None,
    max_attention: int | None = None,
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01),
    rule: str = "norm",
    group_pieces: int = 8192,
    end_id: int = 1,
    with_ids: bool = False,
    words_kept: int = 900_000,
    forget: bool = False,
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset (and ids if asked for).

    ``max_docs`` bounds the pieces in a sequence and ``max_attention`` the sum of squared lengths; None: as many as fit.
    A single piece may always stand alone, whatever it costs. ``group_pieces`` is the number of pieces packed together, ``words_kept``
    the words whose ids each worker remembers, some 300 bytes each, from task to task unless told to ``forget``.
    """
    docs = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    count, octets = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.col(f"`{text_col}`"))), F.lit(0))).first()
    groups = max(1, math.ceil((count + octets / (4 * size)) / group_pieces))
    cut = pieces(docs, vocabulary, id_col, text_col, size, end_id, with_ids, words_kept, forget)
    light = cut.select(
        F.pmod(F.xxhash64(F.col(f"`{id_col}`"), "piece", "length", "ids_crc32", F.spark_partition_id()), F.lit(groups)).alias("pack_group"), F.col(f"`{id_col}`"), "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])
    )
    capacity = np.array([size, max_docs or size, max_attention or size * size], dtype=float)
    schema = T.StructType([f for f in light.schema.fields if f.name != "pack_group"] + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def fill(key, rows):
        rows = rows.drop_columns(["pack_group"]).sort_by([("length", "descending"), (id_col, "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        n = rows["length"].to_numpy().astype(float)
        needs = np.minimum(np.stack([n, np.ones(len(n)), n * n], axis=1), capacity)  # a costlier piece leaves no room beside it
        where, bins = best_fit(needs, capacity, np.array(weights), rule)
        order = np.argsort(where, kind="stable")
        before = np.cumsum(n[order]) - n[order]
        first = np.searchsorted(where[order], np.arange(bins))
        offset = np.empty(len(n), dtype=np.int64)
        offset[order] = before - before[first][where[order]]
        sequence = (key[0].as_py() << 32) + where
        return rows.append_column("sequence_id", pa.array(sequence, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    return light.groupBy("pack_group").applyInArrow(fill, schema)
