"""Each corpus operator against a brute-force version, an exact round trip, or held-out rows."""

import hashlib
import itertools
import random
import re
import struct
import time
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerbrook.llm import components, html_text, image_match, jaccard_join, langid, line_dedup, masked_lm, mixing, packing, posting_ann, toxicity
from ledgerbrook.llm.common import freed, shared
from ledgerbrook.llm.queries import QUERIES, vocabulary

SPACES = " \t\n\x0b\x0c\r"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def prose(rng, n, stock=None):
    stock = stock or ["".join(rng.choice("abcdeilnorst") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    return " ".join(rng.choice(stock) for _ in range(n))


def key_of(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(SPACES))


def brute_lines(rows):
    held = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key_of(line)) >= 40:
                held[key_of(line)].add(i)
    common = {k: max(v) for k, v in held.items() if len(v) >= 5}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if common.get(key_of(x), i) == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def test_line_dedup(spark):
    rng = random.Random(1)
    shared = ["This line stands in Many documents, word for WORD it does.", "  Überall steht diese Zeile, ganz gleich wie ÄÖÜ sie sind.\t", "short"]
    rows = []
    for i in range(40):
        lines = [prose(rng, rng.randint(1, 14)) for _ in range(rng.randint(0, 5))]
        lines += rng.sample(shared, rng.randint(0, 3)) + ([shared[0].upper()] if i % 7 == 0 else [])
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines)))
    rows += [(40, None), (41, ""), (42, "\n\n"), (43, shared[1] + "\n" + shared[1])]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    got = [(r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in out.collect()]
    assert sorted(got) == brute_lines(rows)
    assert any(g[2] for g in got)


def brute_components(rows, percent=75):
    sets = {}
    for i, t in rows:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words_of(t)]
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            p, q = sorted((find(a), find(b)))
            root[q] = p
    return sorted((i, len(s), find(i)) for i, s in sets.items())


def near_copies(rng, base, n, edits):
    out = []
    for _ in range(n):
        w = base.split()
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = "x" + str(rng.random())[2:7]
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_join(spark, seed):
    rng = random.Random(seed)
    texts = [prose(rng, rng.randint(1, 60)) for _ in range(40)]
    texts += near_copies(rng, prose(rng, 120), 90, 9)  # a long run of near copies, some not linked
    texts += near_copies(rng, prose(rng, 30), 12, 3) + [texts[3]] * 4 + [texts[3].upper()]
    passage = prose(rng, 40)
    texts += [f"{prose(rng, 20)} {passage} {prose(rng, 20)}" for _ in range(50)]
    texts += [None, "", "  \n ", "one two", "One  TWO", "one two three", "a b c d e", "a b c d e f"]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    out = jaccard_join.similar_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted(map(tuple, out.collect())) == brute_components(rows)


def test_jaccard_join_links_through_a_text_without_id(spark):
    """Two documents whose only link is a near copy with a null id."""
    rng = random.Random(11)
    w = prose(rng, 60).split()
    one, two = [*w], [*w]
    for k in range(2):
        one[20 + k] = f"one{k}"
        two[40 + k] = f"two{k}"
    rows = [(1, " ".join(one)), (2, " ".join(two)), (4, None), (5, " ".join(w[:30]))]
    apart = jaccard_join.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    joined = jaccard_join.similar_documents(spark.createDataFrame([*rows, (None, " ".join(w)), (None, " ".join(w))], "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in apart.collect()} == {1: 1, 2: 2, 4: 4, 5: 5}
    assert sorted((str(r.doc_id), r.component_id) for r in joined.collect()) == [("1", 1), ("2", 1), ("4", 4), ("5", 5), ("None", 1), ("None", 1)]


def shuffle_octets(spark):
    """Bytes of shuffled data on this machine's disk now."""
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return sum(p.stat().st_size for d in folders for p in Path(d).rglob("shuffle_*.data"))


def settled(now, most, seconds=20):
    """Whether ``now()`` falls to ``most``: Spark deletes files in a thread of its own."""
    end = time.monotonic() + seconds
    while now() > most and time.monotonic() < end:
        time.sleep(0.1)
    return now() <= most


def test_files_of_finished_shuffles_go_at_once(spark):
    freed(spark)
    before = shuffle_octets(spark)
    kept = shared(spark.range(200_000).select(F.xxhash64("id").alias("x")).repartition(4, "x"))
    written = shuffle_octets(spark) - before
    assert written > 1_000_000
    freed(spark)
    assert settled(lambda: shuffle_octets(spark), before + written // 10)
    assert kept.count() == 200_000


def test_jaccard_join_keeps_no_index_on_disk(spark, monkeypatch):
    """The index has gone when its candidates are verified."""
    rng = random.Random(5)
    texts = [prose(rng, 400, [f"w{i}" for i in range(5000)]) for _ in range(1500)]
    docs = spark.createDataFrame(list(enumerate([*texts, texts[0] + " more"])), "doc_id long, text string")
    sizes, pairs, sets = [], jaccard_join._pairs, jaccard_join._sets

    def paired(percent):
        sizes.append(shuffle_octets(spark))
        return pairs(percent)

    def whole(width):
        sizes.append(settled(lambda: shuffle_octets(spark), sizes[0] + 1_000_000))  # of an index of 3 MB
        return sets(width)

    freed(spark)
    monkeypatch.setattr(jaccard_join, "_pairs", paired)
    monkeypatch.setattr(jaccard_join, "_sets", whole)
    out = {r.doc_id: r.component_id for r in jaccard_join.similar_documents(docs).collect()}
    assert out[1500] == 0 and len(sizes) > 1 and all(sizes[1:])


def test_jaccard_join_of_a_large_family_in_small_blocks(spark, monkeypatch):
    """5,000 near copies, their sizes too, with blocks and parts so small that many of them meet."""
    for name, value in (("BLOCK_CLASSES", 300), ("PART_ROWS", 400), ("BLOCK", 1 << 16), ("ENTRIES", 20_000)):
        monkeypatch.setattr(jaccard_join, name, value)
    rng = random.Random(13)
    base = prose(rng, 60)
    texts = near_copies(rng, base, 3600, 6) + near_copies(rng, " ".join(base.split()[:40]), 900, 5) + near_copies(rng, base + " " + prose(rng, 40), 500, 7)
    rows = list(enumerate(texts))
    out = jaccard_join.similar_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    got = sorted(map(tuple, out.collect()))
    vocab, sets = {}, []
    for t in texts:
        w = t.split()
        sets.append(np.array([vocab.setdefault(tuple(w[k : k + 5]), len(vocab)) for k in range(len(w) - 4)]))
    held = Counter(x for s in sets for x in set(s.tolist()))
    column = {x: k for k, x in enumerate(x for x, n in held.items() if n > 1)}
    matrix = np.zeros((len(sets), len(column)), dtype=np.float32)
    size = np.array([len(set(s.tolist())) for s in sets])
    for i, s in enumerate(sets):
        matrix[i, [column[x] for x in set(s.tolist()) if x in column]] = 1
    common = matrix @ matrix.T
    near = 100 * common >= 75 * (size[:, None] + size[None] - common)
    np.fill_diagonal(near, True)
    label = np.arange(len(sets))
    while True:
        least = np.array([label[row].min() for row in near])
        least = np.minimum(least, least[least])
        if (least == label).all():
            break
        label = least
    assert got == [(i, int(size[i]), int(label[i])) for i in range(len(sets))]
    assert 10 < len(set(label.tolist())) < 4000


def test_prefix_pairs_lose_nothing():
    """Index entries with every shingle rare, frequent or mixed: all similar pairs meet and pass the count."""
    rng = random.Random(5)
    texts = near_copies(rng, prose(rng, 50), 20, 3) + near_copies(rng, prose(rng, 50), 20, 6)
    tokens, ptr = jaccard_join.shingle_sets(texts, 5)
    sets = [tokens[a:b] for a, b in itertools.pairwise(ptr)]
    every = np.unique(tokens)
    want = set()
    for x, y in itertools.combinations(sets, 2):
        common = len(np.intersect1d(x, y))
        a, b = sorted((jaccard_join.class_of(x), jaccard_join.class_of(y)))
        if a != b and 100 * common >= 75 * (len(x) + len(y) - common):
            want.add((a, b))
    assert want
    for frequent in (every[:0], every, every[::2], every[::9]):
        a, b, n, need, runs = jaccard_join.pairs_of_runs(jaccard_join.entries_of(texts, 5, 75, frequent)[0], 75)
        more = Counter(runs["cls"].tolist())
        got = set()
        for p, q, k, least in zip(a.tolist(), b.tolist(), n, need, strict=True):
            if k + min(more[p], more[q]) >= least:
                got.add((min(p, q), max(p, q)))
        in_run = {tuple(sorted(x)) for key in np.unique(runs["key"]) for x in itertools.combinations(runs["cls"][runs["key"] == key].tolist(), 2)}
        assert want <= got | in_run


def test_components(spark):
    rng = random.Random(3)
    edges = [(k, k + 1) for k in range(200)] + [(1000, k) for k in range(1001, 1050)] + [(rng.randrange(3000, 3400), rng.randrange(3000, 3400)) for _ in range(300)] + [(5, 5)]
    rng.shuffle(edges)
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "u long, v long").repartition(7)).collect()))
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in edges:
        p, q = sorted((find(u), find(v)))
        root[q] = p
    assert got == {x: find(x) for u, v in edges for x in (u, v) if u != v}


def test_packing_round_trip(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, rng.randint(0, 60))) for i in range(200)] + [(200, prose(rng, 3000)), (201, None), (202, ""), (203, "Ünï <|endoftext|> don't İΣ\x1c é . a.b,c! 12")]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), vocabulary(), size=256, group_pieces=50, with_ids=True)
    got = out.collect()
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(vocabulary())
    places, docs = defaultdict(list), defaultdict(list)
    for r in got:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length <= 256 and zlib.crc32(r.ids) == r.ids_crc32
        places[r.sequence_id].append((r.offset, r.length))
        docs[r.doc_id].append((r.piece, r.start, ids))
    for i, t in rows:
        parts = sorted(docs[i], key=lambda p: p[0])
        assert [p[0] for p in parts] == list(range(len(parts))) and all(len(p[2]) == 256 for p in parts[:-1])
        assert np.concatenate([p[2] for p in parts]).tolist() == [*model.encode(t or "", add_special_tokens=False).ids, 1]
        assert [p[1] for p in parts] == [256 * k for k in range(len(parts))]
    for where in places.values():
        at = 0
        for offset, length in sorted(where):
            assert offset == at
            at += length
        assert at <= 256
    assert len(places) <= sum(r.length for r in got) / 256 + 7


def test_packing_looks_at_each_word_once(monkeypatch):
    """A word in whatever case is taken apart once, and plain words are encoded without offsets; the ids stay the same."""
    from tokenizers import Tokenizer

    rng = random.Random(12)
    stock = ["".join(rng.choice("abcdeilnorsté") for _ in range(9)) for _ in range(2000)]
    cased = ["".join(rng.choice((c, c.upper() if c.isascii() else c)) for c in w) for w in stock for _ in range(8)]
    rng.shuffle(cased)
    texts = [" ".join(cased[k : k + 80]) for k in range(0, len(cased), 80)]
    taken, slow = [], []
    stem, encode_into = packing.stem, packing.encode_into

    def counted(known, words, model):
        slow.extend(words)
        encode_into(known, words, model)

    monkeypatch.setattr(packing, "stem", lambda w: (taken.append(w), stem(w))[1])
    monkeypatch.setattr(packing, "encode_into", counted)
    packing.tokenizer.cache_clear()  # no words are known yet
    ids = packing.ids_of(pa.array(texts), vocabulary())
    model = Tokenizer.from_file(vocabulary())
    assert [np.frombuffer(x, "<u4").tolist() for x in ids] == [model.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(taken) <= len(set(stock)) and not slow


def test_packing_ids_are_the_tokenizers():
    """Odd letters, marks, white space and special tokens, with words forgotten now and then."""
    from tokenizers import Tokenizer

    rng = random.Random(5)
    pool = [*"abAJTWYİIiıſßÉéÅåøÑ.,;:!?'\"-_/019@\t\n\x0b\x0c\r\x1c\x1f\x85\xa0\u2003\u3000\xad\x00\u0331\u030c\u0301\u0307ΣςKǰ中😀²ª<|>", "<|endoftext|>", "<|ENDOFTEXT|>", "don't", "THE", *"   "]
    model = Tokenizer.from_file(vocabulary())
    for words_kept in (0, 50, 900_000) * 10:
        texts = [None, "", " \n", *("".join(rng.choices(pool, k=rng.randint(0, 60))) for _ in range(100))]
        got = packing.ids_of(pa.array(texts, pa.string()), vocabulary(), words_kept)
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == [model.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_packing_keeps_an_attention_capacity(spark):
    """The sum of squared lengths binds; a piece that exceeds it alone stands alone."""
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.randint(1, 40))) for i in range(200)] + [(k, "word") for k in (500, None) for _ in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    loose, tight = (packing.pack(df, vocabulary(), size=256, max_attention=m).collect() for m in (None, 4000))
    assert len(loose) == len(tight) == 800
    packed = defaultdict(list)
    for r in tight:
        packed[r.sequence_id].append(r.length)
    assert all(sum(n * n for n in lengths) <= 4000 or len(lengths) == 1 for lengths in packed.values())
    assert any(n * n > 4000 for lengths in packed.values() for n in lengths)
    assert len(packed) > len({r.sequence_id for r in loose})


def test_packing_splits_repeated_rows(spark):
    """Copies of one row go to several groups."""
    rows = spark.range(0, 4000, 1, 8).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a b c").alias("text"))
    got = packing.pack(rows, vocabulary(), size=64, group_pieces=500).collect()
    assert len(got) == 4000 and max(Counter(r.sequence_id >> 32 for r in got).values()) <= 2000


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_keeps_every_capacity(rule):
    rng = np.random.default_rng(1)
    n = np.sort(rng.integers(1, 100, 500))[::-1].astype(float)
    needs = np.stack([n, np.ones(500), n * n], axis=1)
    capacity = np.array([100.0, 4.0, 6000.0 + 100 * 100])
    where, bins = packing.best_fit(needs, capacity, np.array([1.0, 0.2, 0.2]), rule)
    total = np.zeros((bins, 3))
    np.add.at(total, where, needs)
    assert (total <= capacity).all() and (total.sum(axis=1) > 0).all() and bins < 1.25 * max(n.sum() / 100, 500 / 4)
    with pytest.raises(ValueError):
        packing.best_fit(np.array([[101.0, 1, 1]]), capacity, np.ones(3))


def test_mixing_contract(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.choice([0, 1, 5, 20, 90])), rng.choice(["a", "a", "a", "a", "b", "c", None, "Ä", "tiny"] if i > 3 else ["tiny"])) for i in range(3000)]
    rows += [(3000, None, "b"), (3001, "  ", "none"), (3002, "x y", "one")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = mixing.mix(df, shards=8)
    got = plan.collect()
    size = defaultdict(int)
    for _, t, s in rows:
        size[s] += len(words_of(t))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight, total = {s: 1 + k % 3 for k, s in enumerate(names)}, sum(size.values())
    target, capped = {}, set()
    while True:
        left = total - sum(3 * size[s] for s in capped)
        free = [s for s in names if s not in capped]
        target = {s: 3.0 * size[s] if s in capped else left * weight[s] / sum(weight[x] for x in free) for s in names}
        over = {s for s in free if target[s] > 3 * size[s]}
        if not over:
            break
        capped |= over
    taken = defaultdict(int)
    for r in got:
        assert r.mix_size == len(words_of(r.text)) and r.mix_source_size == size[r.source] and r.mix_target == pytest.approx(target[r.source])
        assert len(r.mix_shards) == len(r.mix_order) == r.mix_copies <= 3 and all(0 <= x < 8 for x in r.mix_shards)
        taken[r.source] += r.mix_size * r.mix_copies
    for s in names:
        assert abs(taken[s] - target[s]) <= max(45, 0.01 * target[s]), s
    key = lambda r: (r.doc_id, r.mix_copies, tuple(r.mix_shards), tuple(r.mix_order))
    assert sorted(map(key, mixing.mix(df.repartition(5), shards=8).collect())) == sorted(map(key, got))
    turns = Counter((r.source, s) for r in got for s in r.mix_shards)
    for parts in (1, 3):
        dealt = mixing.mixed_rows(plan, parts)
        assert dealt.columns == ["doc_id", "text", "source", "mix_shard", "mix_part", "mix_order"]
        rows = dealt.withColumn("at", F.spark_partition_id()).collect()
        assert Counter((r.source, r.mix_shard) for r in rows) == turns  # shards hold what the tree deals them
        where = defaultdict(set)
        for r in rows:
            where[r.mix_shard, r.mix_part].add(r.at)
        assert len(where) == 8 * parts and all(len(x) == 1 for x in where.values())
        for x, y in itertools.pairwise(rows):  # each part in order, and parts are ranges of it
            if x.at == y.at:
                assert (x.mix_shard, x.mix_part, x.mix_order) <= (y.mix_shard, y.mix_part, y.mix_order)
        assert all(r.mix_part == min(parts - 1, int((r.mix_order / 2**64 + 0.5) * parts)) for r in rows)
    share = {s: n / sum(r.mix_copies for r in got) for s, n in Counter(r.source for r in got for _ in r.mix_shards).items()}
    for shard in range(8):  # every shard mixes the sources as the whole does
        whole = sum(n for (_, k), n in turns.items() if k == shard)
        assert abs(turns["a", shard] / whole - share["a"]) < 0.12
    other = {r.doc_id: r for r in mixing.mix(df, shards=1).collect()}
    assert all(set(r.mix_shards) <= {0} for r in other.values()) and len({s for _, s in turns}) == 8


def test_split_tree_is_exact():
    quotas = np.array([1000, 10, 0, 357])
    dealt = mixing.split_tree(quotas, 12, np.random.default_rng(1))
    assert (dealt.sum(axis=0) == quotas).all() and np.ptp(dealt.sum(axis=1)) <= 1


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>if (a<b && "x) {}</script><style>p{}</style></head><body class="home">
<header><a href="/">Site</a><nav><ul><li><a href=x>One</a><li><a>Two</a></ul></nav></header>
<div id="cookie-banner">We use cookies on this site to improve things <button>OK</button></div><main><article><header><h1>Big &amp; news</h1></header>
<p>First <b>bold</b> par <a href="#">link</a> goes on  with words and more words.<p>Second&nbsp;par &eacute;&#33;<ul><li>item one<li>item two</ul>
<!-- a comment > here --><div class="advertisement">Buy now and save a lot of money on this</div>
<aside class="sidebar">Side stuff that is long enough to be text</aside><form>Name <input> <label>Mail</label></form><blockquote>Quote me</blockquote></article>
<section class="comments"><h2>Comments</h2><p>User says this is a long reader comment text with many words</p></section></main><footer>&copy; 2020</footer></body></html>"""


def test_html_extraction(spark):
    want = "Big & news First bold par link goes on with words and more words. Second par é! item one item two Quote me"
    pages = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<p>only text, and the page is cut &am"), (5, "u", "<nav><a href=x>Home</a></nav>"), (None, "u", "x" * 50)]
    out = {r.page_id: r for r in html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert out[1].text == want and out[1].n_chars == len(want)
    assert out[2].text == out[3].text == out[5].text == "" and out[2].n_chars == 0
    assert out[4].text == "only text, and the page is cut &am"
    assert out[None].n_chars == 50


def test_vector_search_finds_what_brute_force_finds(spark):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(30, 16))
    x = (centers[rng.integers(0, 30, 3000)] + 0.4 * rng.normal(size=(3000, 16))).astype(np.float32)
    x[500:900] = x[500]  # many copies
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(3000, None), (3001, [0.0] * 16), (3002, [float("nan")] * 16), (3003, [None] * 16), (3004, [1.0] * 5), (3005, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = posting_ann.nearest(df, F.col("vec_id") % 50 == 0, list_size=64).collect()
    d = x.astype(np.float64)
    d /= np.linalg.norm(d, axis=1, keepdims=True)
    hits = total = 0
    by = defaultdict(dict)
    for r in got:
        by[r.query_id][r.rank] = (r.vec_id, r.score)
    assert sorted(by) == list(range(0, 3000, 50))
    for q, found in by.items():
        sims = d @ d[q]
        sims[q] = -2
        best = sorted(range(3000), key=lambda i: (-round(sims[i], 10), i))[:5]
        assert sorted(found) == [1, 2, 3, 4, 5] and q not in {v for v, _ in found.values()}
        hits += len({v for v, _ in found.values()} & set(best))
        total += 5
        assert all(abs(s - sims[v]) < 1e-9 for v, s in found.values())
        if 500 <= q < 900:
            assert [found[k][0] for k in range(1, 6)] == best
    assert hits / total >= 0.9


def test_vector_search_keeps_its_recall_with_many_lists(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(24_000, 64)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = defaultdict(set)
    for r in posting_ann.nearest(df, F.col("vec_id") % 240 == 0, list_size=32).collect():  # 750 lists
        got[r.query_id].add(r.vec_id)
    d = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 24_000, 240):
        sims = d @ d[q]
        sims[q] = -2
        hits += len(got[q] & set(np.argsort(-sims)[:5].tolist()))
    assert hits / 500 >= 0.93, hits / 500


@pytest.mark.parametrize("kind", ["clusters", "none"])
def test_vector_search_with_thousands_of_lists(spark, kind):
    """Over a thousand lists, searched by the graph; queries are dealt to several turns."""
    rng = np.random.default_rng(6)
    n = 30_000
    x = rng.normal(size=(n, 32))
    if kind == "clusters":
        x = rng.normal(size=(400, 32))[rng.integers(0, 400, n)] + 0.35 * x
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))], "vec_id long, embedding array<float>").repartition(4)
    got = defaultdict(set)
    for r in posting_ann.nearest(df, F.col("vec_id") % 100 == 0, list_size=24, ask_rows=100).collect():  # 1,250 lists
        got[r.query_id].add(r.vec_id)
    d = x.astype(np.float32).astype(np.float64)
    d /= np.linalg.norm(d, axis=1, keepdims=True)
    sims = d[::100] @ d.T
    sims[np.arange(len(sims)), np.arange(0, n, 100)] = -2
    hits = sum(len(got[100 * q] & set(np.argsort(-row)[:5].tolist())) for q, row in enumerate(sims))
    assert hits / (5 * len(sims)) >= 0.93, hits / (5 * len(sims))


def test_vectors_of_one_direction_tie_by_id(spark):
    """Thousands of scaled copies are as near as each other but for rounding; equal scores go to the smaller id."""
    rows = [(k, [float(1 + k), float(2 + 2 * k)]) for k in range(3000)] + [(50, [5.0, -1.0])] + [(7, [1.0, 2.0])] * 300
    got = posting_ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 100, list_size=64).orderBy("rank").collect()
    vectors = np.array([v for _, v in rows])
    scores = posting_ann.cosine(np.repeat(vectors[100][None], len(rows), axis=0), vectors)  # scaled copies differ by rounding
    best = sorted({(-s, i) for (i, _), s in zip(rows, scores.tolist(), strict=True) if i != 100})[:5]
    assert [(r.vec_id, r.score) for r in got] == [(i, -s) for s, i in best]


def test_few_vectors(spark):
    df = spark.createDataFrame([(50, [1.0, 0.0]), (51, [2.0, 0.0]), (52, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r)[:3] for r in posting_ann.nearest(df, F.col("vec_id") % 50 == 0).orderBy("rank").collect()] == [(50, 1, 51), (50, 2, 52)]


LANGS = {"en": "the and of with this that house water", "de": "der und die mit nicht haus wasser zeit", "fr": "le et les avec dans maison eau temps", "es": "el y los con para casa agua tiempo"}


def test_language_id(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(LANGS[k].split()) for _ in range(rng.randint(3, 30))), k) for i, k in enumerate(rng.choices(list(LANGS), k=400))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df.where("doc_id % 4 <> 2"), F.col("text"), F.col("lang"), F.col("doc_id"))
    out = {r.doc_id: r for r in langid.identify(df, model).collect()}
    held = [i for i, _, _ in rows if i % 4 == 2]
    assert np.mean([out[i].lang_pred == rows[i][2] for i in held]) > 0.97 and all(0 <= r.score <= 1 for r in out.values())
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !?"), (None, "der und die")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in langid.identify(odd, model).collect()} == {1: "und", 2: "und", 3: "und", None: "de"}


def test_toxicity_catches_unseen_misspellings(spark):
    rng = random.Random(7)
    stock = ["".join(rng.choice("abcdeilnorst") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    stems = ["grozzle", "vukmar", "plimth"]
    ends = ["", "s", "er", "ing", "ed", "y", "ish", "o"]
    rows, labels = [], []
    for i in range(800):
        bad = i % 4 == 0
        w = [rng.choice(stock) for _ in range(rng.randint(10, 80))]
        if bad:
            for _ in range(2):
                w.insert(rng.randrange(len(w)), rng.choice(stems) + rng.choice(ends[:5] if i < 600 else ends))
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, marks.where("doc_id < 600"))
    out = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    right = [out[i].predicted == y for i, y in labels if i >= 600]
    assert np.mean(right) > 0.93
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "...")], "doc_id long, text string")
    assert all(0 <= r.score < 0.3 and r.predicted == 0 for r in toxicity.score(odd, model).collect())
    assert all(r.score == 0 for r in toxicity.score(docs, toxicity.fit(docs, marks.where("toxic = 0"))).limit(5).collect())


def fit_model(df):
    ready = masked_lm.prepared(df)
    return ready, *masked_lm.fit(ready)


def test_training_takes_long_texts_and_repeated_ids(spark):
    """Labelled texts of any length are learnt from, and a hot id doesn't crowd the others out."""
    rng = random.Random(17)
    long = lambda w: " ".join(rng.choice([w, *"abcdefg"]) + "ora" for _ in range(8000))
    rows = [(i, long("vile" if i % 2 else "mild"), "de" if i % 2 else "fr") for i in range(40)] + [(1, long("vile"), "de")] * 30
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(3, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r.predicted for r in toxicity.score(docs.where("doc_id > 1"), model).collect()}
    assert all(got[i] == i % 2 for i in range(2, 40))
    few = toxicity.fit(docs, labels, max_rows=10, max_chars=400_000)
    assert np.isfinite(few.bias)
    found = langid.identify(docs, langid.fit(docs, F.col("text"), F.col("lang"), F.col("doc_id"))).collect()
    assert all(r.lang_pred == r.lang for r in found)


def test_many_languages(spark):
    """More languages than a dense table of training rows would hold."""
    rng = random.Random(23)
    stems = {f"x{k:03d}": ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=4)) for _ in range(6)] for k in range(300)}
    rows = [(i, " ".join(rng.choices(stems[lang], k=20)), lang) for i, lang in enumerate(sorted(stems) * 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs.where("doc_id < 900"), F.col("text"), F.col("lang"), F.col("doc_id"))
    found = langid.identify(docs.where("doc_id >= 900"), model).collect()
    assert np.mean([r.lang_pred == r.lang for r in found]) > 0.95


def test_masked_model_is_a_distribution_and_learns(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(["red fox runs fast", "blue bird sings well", "old man walks home"][rng.randrange(3)] for _ in range(rng.randint(5, 30)))) for i in range(300)]
    rows += [(300, None), (301, ""), (302, "fox home red well man blue fast bird walks runs")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    ready, vocab, net = fit_model(df)
    n = len(vocab)
    for row in ([1, 2, 3, 4], [n] * 4):
        p = net.log_probs(np.repeat(np.array(row)[:, None], n, axis=1), np.arange(n))
        assert np.exp(p).sum() == pytest.approx(1, abs=1e-3)
    out = {r.doc_id: r for r in masked_lm.score(ready, vocab, net).collect()}
    assert out[300].n_words == out[301].n_words == 0 and out[300].log_prob == 0 and out[300].mean_log_prob is None
    usual = np.mean([out[i].mean_log_prob for i in range(300)])
    assert usual > -1.5 and out[302].mean_log_prob < usual - 1


def test_masked_model_against_a_plain_scorer(spark, monkeypatch):
    """Word by word, with rare words in rests and cells; P(word | around) sums to one over the corpus' words and an unseen one."""
    for name, value in (("OWN", 12), ("KNOWN", 40), ("SHARD_WORDS", 2000)):
        monkeypatch.setattr(masked_lm, name, value)
    rng = random.Random(18)
    stock = [w + end for w in ("ba", "co", "di", "fu", "ge", "ho", "ju", "ka") for end in ("", "s", "ring", "tion", "lich", "mente")]
    rows = [(i, " ".join(rng.choices(stock, [1 / (k + 1) for k in range(len(stock))], k=rng.randint(0, 60)))) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    ready, vocab, net = fit_model(df)
    got = {r.doc_id: r.log_prob for r in masked_lm.score(ready, vocab, net).collect()}
    counts = Counter(w for _, t in rows for w in t.split())
    numbers = {w: masked_lm.numbered([w])[0] for w in counts}
    top = set(sorted(counts, key=lambda w: (-counts[w], int(numbers[w][0])))[:12])

    def softmax(x):
        e = np.exp(np.float64(x) - max(x))
        return e / e.sum()

    def log_p(around, word):
        out, within = (x[0] for x in vocab.ids(numbers[word]))
        h = np.tanh(sum(net.near[k][a] for k, a in enumerate(around)) + net.bend)
        g = vocab.group[out]
        own = [o for o in range(len(vocab)) if vocab.group[o] == g]
        p = softmax(h @ net.top + net.top_base)[g] * softmax([h @ net.out[o] + net.out_base[o] for o in own])[own.index(out)]
        assert (within == 0) == (word in top)
        return np.log(p) + within

    for i, t in rows[:40]:
        w = t.split()
        ids = [len(vocab)] * 2 + [int(vocab.ids(numbers[x])[0][0]) for x in w] + [len(vocab)] * 2
        want = sum(log_p([ids[k], ids[k + 1], ids[k + 3], ids[k + 4]], x) for k, x in enumerate(w))
        assert got[i] == pytest.approx(want, rel=1e-3)
    whole = sum(np.exp(log_p([len(vocab)] * 4, w)) for w in counts)
    assert 0.6 < whole <= 1.001  # the rest of one is for words never seen: each of the few rests here keeps a share


def test_masked_model_beats_word_frequencies_on_unseen_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    ready, vocab, net = fit_model(docs.where("doc_id % 5 <> 0"))
    held = masked_lm.prepared(docs.where("doc_id % 5 = 0"))
    total = masked_lm.score(held, vocab, net).agg(F.sum("log_prob"), F.sum("n_words")).first()
    seen = {r.word: r["n"] for r in masked_lm.count_words(ready).collect()}
    whole = sum(seen.values()) + 0.5 * (len(seen) + 1)
    plain = sum(r["n"] * np.log((seen.get(r.word, 0) + 0.5) / whole) for r in masked_lm.count_words(held).collect())
    assert total[0] > plain + 0.3 * total[1]


def test_masked_model_does_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(masked_lm, "SHARD_WORDS", 1500)  # some shards, so copies are averaged
    monkeypatch.setattr(masked_lm, "FAN", 2)
    rng = random.Random(19)
    rows = [(i, prose(rng, rng.randint(1, 80))) for i in range(200)] + [(500, "the same words again")] * 9
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = []
    for parts in (1, 2, 9):
        ready, vocab, net = fit_model(df.repartition(parts))
        got.append(sorted(tuple(r) for r in masked_lm.score(ready, vocab, net).select("doc_id", "log_prob").collect()))
    for other in got[1:]:
        assert [i for i, _ in other] == [i for i, _ in got[0]] and np.allclose([x for _, x in other], [x for _, x in got[0]], rtol=1e-5)


def test_masked_model_learns_from_context_at_every_size(spark, monkeypatch):
    monkeypatch.setattr(masked_lm, "SHARD_WORDS", 100_000)
    rng = random.Random(21)
    chains = [rng.sample([f"w{k}" for k in range(60)], 60) for _ in range(2)]
    follow = [dict(zip(c, c[1:] + c[:1], strict=True)) for c in chains]

    def text():
        word, out = f"w{rng.randrange(60)}", []
        for _ in range(40):
            out.append(word)
            word = follow[rng.random() < 0.1][word]
        return " ".join(out)

    held = masked_lm.prepared(spark.createDataFrame([(i, text()) for i in range(200)], "doc_id long, text string"))
    likely = []
    for n in (1000, 10_000):
        _, vocab, net = fit_model(spark.createDataFrame([(i, text()) for i in range(n)], "doc_id long, text string"))
        likely.append(np.mean([r.mean_log_prob for r in masked_lm.score(held, vocab, net).collect()]))
    assert likely[1] >= likely[0], likely
    assert likely[1] > -np.log(60) + 0.5  # the words around a token tell more than its frequency


def test_image_copies(spark):
    rng = np.random.default_rng(9)
    pictures = [image_match.paint(rng.normal(size=64)) for _ in range(12)]
    rows = []
    for i, p in enumerate(pictures):
        rows += [(4 * i, image_match.encode_png(p)), (4 * i + 1, image_match.encode_png(image_match.edit(p, 1))), (4 * i + 2, image_match.encode_png(image_match.edit(p, 2))), (4 * i + 3, image_match.encode_png(p))]
    rows += [(100, None), (101, b"no image"), (102, b"no image"), (103, image_match.encode_png(np.zeros((40, 40)))), (104, b"P5 2 2 255\n\x00\x01\x02\x03")]
    out = {r.id: r for r in image_match.similar_images(spark.createDataFrame(rows, "id long, data binary")).collect()}
    assert len(out) == len(rows)
    assert all(out[4 * i + 3].class_id == 4 * i and out[4 * i + 3].group_id == 4 * i for i in range(12))
    copies = [out[4 * i + k].group_id == 4 * i for i in range(12) for k in (1, 2)]
    assert np.mean(copies) >= 0.9
    assert all(out[k].group_id == (k if k != 102 else 101) for k in (100, 101, 102, 103, 104))
    assert {r.group_id // 4 * 4 for k, r in out.items() if k < 48} == {4 * i for i in range(12)}  # no two pictures merge


def brute_groups(data):
    """Smallest index reachable by pairs that all-pairs matching of descriptors links."""
    points = [image_match.describe(image_match.decode(d)[0]) for d in data]
    label = list(range(len(data)))
    for a, b in itertools.combinations(range(len(data)), 2):
        if label[a] != label[b] and image_match.agreeing(points[a], points[b], 24) >= 5:
            low, high = sorted((label[a], label[b]))
            label = [low if x == high else x for x in label]
    return label


@pytest.mark.parametrize("pair_all", [2, 128])
def test_families_of_images_are_whole(spark, monkeypatch, pair_all):
    """60 pictures with the same content, edits of edits, and strangers; with short runs kept, so blocks meet."""
    monkeypatch.setattr(image_match, "PAIR_ALL", pair_all)
    monkeypatch.setattr(jaccard_join, "BLOCK_CLASSES", 16)
    rng = np.random.default_rng(12)
    base, pictures = image_match.paint(rng.normal(size=64)), []
    for k in range(60):
        p = base.copy()
        p[5 + k : 9 + k, 40:44] = 255 * (k % 2)
        pictures.append(p)
    for _ in range(6):
        p = image_match.paint(rng.normal(size=64))
        pictures += [p, np.clip(p * 0.8 + 20 + rng.normal(0, 6, p.shape), 0, 255), p[24:-24, 24:-24], p[:60, :60], p[36:, 36:]]
    data = [image_match.encode_png(p) for p in pictures]
    out = image_match.similar_images(spark.createDataFrame(list(enumerate(data)), "id long, data binary").repartition(3))
    got = {r.id: r.group_id for r in out.collect()}
    assert [got[i] for i in range(len(data))] == brute_groups(data)
    assert {got[i] for i in range(60)} == {0}


@pytest.mark.parametrize("strangers", [40, 400])
def test_recall_of_crops_at_two_sizes(spark, strangers):
    """Crops of several sizes, turned, scaled and noisy copies are found as often among many pictures as among few."""
    rng = np.random.default_rng(5)
    ways = {
        "three quarters": lambda p: p[4:80, 10:84], "middle half": lambda p: p[24:-24, 24:-24], "corner": lambda p: p[:56, :56], "turned": lambda p: p.T[::-1],
        "scaled": lambda p: image_match.resize(image_match.blur(p), 144, 144), "noisy": lambda p: np.clip(p * 0.85 + 14 + rng.normal(0, 4, p.shape), 0, 255),
    }
    pictures = [image_match.paint(rng.normal(size=64)) for _ in range(20)]
    rows = [(i * 100, image_match.encode_png(p)) for i, p in enumerate(pictures)]
    rows += [(i * 100 + k, image_match.encode_png(way(p))) for i, p in enumerate(pictures) for k, way in enumerate(ways.values(), 1)]
    rows += [(10_000 + i, image_match.encode_png(image_match.paint(rng.normal(size=64)))) for i in range(strangers)]
    got = {r.id: r.group_id for r in image_match.similar_images(spark.createDataFrame(rows, "id long, data binary")).collect()}
    for k, name in enumerate(ways, 1):
        assert np.mean([got[i * 100 + k] == i * 100 for i in range(20)]) >= 0.9, name
    assert all(got[10_000 + i] == 10_000 + i for i in range(strangers))


def filtered_png(grey, kind, depth=8, lace=False):
    """A PNG whose rows all have one filter, written by the format's own rules, byte by byte."""

    def lines(rows):
        up, out = None, []
        for row in rows:
            v = [int(x) for x in row]
            if depth == 16:
                v = [y for x in v for y in (x, 7)]
            elif depth == 1:
                v = np.packbits([x > 127 for x in v]).tolist()
            step, up = 2 if depth == 16 else 1, up or [0] * len(v)
            a = [0] * step + v[:-step]
            c = [0] * step + up[:-step]
            near = lambda p, q, r: min((abs(q - r), 0, p), (abs(p - r), 1, q), (abs(p + q - 2 * r), 2, r))[2]
            guess = [[0, x, y, (x + y) // 2, near(x, y, z)][kind] for x, y, z in zip(a, up, c, strict=True)]
            out.append(bytes([kind, *((x - g) % 256 for x, g in zip(v, guess, strict=True))]))
            up = v
        return b"".join(out)

    passes = [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)] if lace else [(0, 0, 1, 1)]
    raw = b"".join(lines(grey[y::dy, x::dx]) for x, y, dx, dy in passes if grey[y::dy, x::dx].size)
    chunk = lambda n, body: struct.pack(">I", len(body)) + n + body + struct.pack(">I", zlib.crc32(n + body))
    head = struct.pack(">IIBBBBB", grey.shape[1], grey.shape[0], depth, 0, 0, 0, int(lace))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_png_filters_depths_and_interlacing(monkeypatch):
    grey = np.random.default_rng(1).integers(0, 256, (13, 19)).astype(np.float32)
    for kind, depth, lace in [(k, d, x) for k in range(5) for d in (8, 16) for x in (False, True)]:
        assert (image_match.decode(filtered_png(grey, kind, depth, lace))[0] == grey).all(), (kind, depth, lace)
    assert (image_match.decode(filtered_png(grey, 4, 1))[0] == 255 * (grey > 127)).all()
    one, two = filtered_png(grey, 0), filtered_png(grey, 4)
    assert one != two and image_match.decode(one)[1] == image_match.decode(two)[1]
    with pytest.raises((ValueError, zlib.error)):
        image_match.decode(one[:60])
    monkeypatch.setattr(image_match, "PIXELS", 60)  # 13 x 19 is over four times that
    assert image_match.decode(one)[0].shape == (4, 6)


def test_png_round_trip():
    grey = np.random.default_rng(1).integers(0, 256, (13, 7)).astype(np.float32)
    assert (image_match.decode(image_match.encode_png(grey))[0] == grey).all()


def test_registered_names():
    assert {q.split("_")[0] for q in QUERIES} == {f"op{k}" for k in range(1, 11)}


def test_contraction_in_parts_keeps_what_is_joined(monkeypatch):
    monkeypatch.setattr(components, "NODES", 300)
    u, v = np.random.default_rng(1).integers(0, 5000, (2, 6000))
    batches = [pa.RecordBatch.from_arrays([pa.array(u[i : i + 100]), pa.array(v[i : i + 100])], names=["u", "v"]) for i in range(0, 6000, 100)]

    def roots(edges):
        above = {}

        def top(x):
            while above.setdefault(x, x) != x:
                x = above[x]
            return x

        for a, b in edges:
            a, b = top(a), top(b)
            above[max(a, b)] = min(a, b)
        return {x: top(x) for x in above}

    got = roots([(a, b) for out in components._contract(batches) for a, b in zip(*(c.to_pylist() for c in out.columns), strict=True)])
    assert all(got.get(x, x) == r for x, r in roots(zip(u.tolist(), v.tolist(), strict=True)).items())
