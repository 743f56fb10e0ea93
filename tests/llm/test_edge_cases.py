"""Odd inputs: nulls in every column, empty tables, repeated rows, and extra columns whose names clash."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerbrook.llm import html_text, image_match, jaccard_join, langid, line_dedup, masked_lm, mixing, packing, posting_ann, toxicity
from ledgerbrook.llm.queries import vocabulary

ROWS = [
    (1, "Hello there, this is a line of text that is long enough to count.\nsecond", "en", "a"), (1, "Hello there, this is a line of text that is long enough to count.\nsecond", "en", "a"),
    (2, None, "en", None), (3, "", None, "b"), (None, "Ein Text ohne Nummer", "de", "a"), (4, " \n\t ", "de", None), (5, "wort " * 30_000, "de", "b"), (6, "\U0001f600 \x00 é", "fr", "b"), (7, None, None, None),
]
PLAIN = "doc_id long, text string, lang string, source string"
CLASH = ["score", "predicted", "n_lines", "n_dropped", "id", "cls", "n", "a", "b", "key", "lang_pred", "mix_size", "mix_h", "line", "h1", "gone_keys", "pack_group", "sequence_id", "offset", "piece", "component_id", "root", "w", "s", "h", "block"]


def models(spark):
    docs = spark.createDataFrame(ROWS, PLAIN)
    labels = spark.createDataFrame([(1, 0), (5, 1), (6, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    return langid.fit(docs, F.col("text"), F.col("lang"), F.col("doc_id")), toxicity.fit(docs, labels)


def scored(docs):
    ready = masked_lm.prepared(docs)
    return masked_lm.score(ready, *masked_lm.fit(ready))


OPERATORS = {
    "toxicity": lambda d, m: toxicity.score(d, m[1]),
    "packing": lambda d, m: packing.pack(d, vocabulary()),
    "mixing": lambda d, m: mixing.mix(d),
    "lines": lambda d, m: line_dedup.dedup_lines(d),
    "language": lambda d, m: langid.identify(d, m[0]),
    "jaccard": lambda d, m: jaccard_join.similar_documents(d),
    "model": lambda d, m: scored(d),
}


@pytest.fixture(scope="module")
def fitted(spark):
    return models(spark)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_documents(spark, fitted, name):
    run = OPERATORS[name]
    plain = spark.createDataFrame(ROWS, PLAIN)
    once = run(plain, fitted)
    rows = once.collect()
    ids = sorted(str(r.doc_id) for r in rows)
    if name == "packing":
        assert set(ids) == {"1", "2", "3", "4", "5", "6", "7", "None"} and sum(r.doc_id == 1 for r in rows) == 2
    else:
        assert ids == sorted(str(r[0]) for r in ROWS)
    clash = plain
    for c in CLASH:
        clash = clash.withColumn(c, F.lit("other"))
    again = run(clash, fitted)
    if name in ("toxicity", "mixing", "lines", "language"):  # these pass other columns on as they are
        own = {"toxicity": CLASH[:2], "mixing": ["mix_size"], "lines": CLASH[2:4], "language": ["score", "lang_pred"]}[name]
        assert all(r[c] == "other" for r in again.collect() for c in CLASH if c not in own)
    common = [c for c in once.columns if c not in ("text", "mix_order", "mix_shards")]
    as_set = lambda df: sorted(str(tuple(r[c] for c in common)) for r in df.select(*common).collect())
    assert as_set(again) == as_set(once)
    assert run(plain.limit(0), fitted).count() == 0


def test_all_null_documents(spark, fitted):
    rows = [(None, None, None, None)] * 3
    for name, run in OPERATORS.items():
        assert run(spark.createDataFrame(rows, PLAIN), fitted).count() == 3, name


def test_defined_results(spark, fitted):
    docs = spark.createDataFrame(ROWS, PLAIN)
    joined = {str(r.doc_id): r for r in jaccard_join.similar_documents(docs).collect()}
    assert joined["2"].n_shingles == 0 and joined["2"].component_id == 2 and joined["None"].component_id is None and joined["5"].n_shingles == 1
    lines = {str(r.doc_id): r for r in line_dedup.dedup_lines(docs).collect()}
    assert lines["2"].text is None and lines["2"].n_lines == 1 and lines["1"].n_dropped == 0
    mixed = {str(r.doc_id): r for r in mixing.mix(docs).collect()}
    assert mixed["7"].mix_size == 0 and mixed["7"].mix_target == 0 and mixed["7"].mix_copies == 0


def test_pages(spark):
    clash = "page_id long, url string, html string, text string, n_chars string"
    rows = [(1, None, "<p>words and more words that make a text</p>", "old", "x"), (None, "u", None, None, None)]
    out = html_text.extract(spark.createDataFrame(rows, clash))
    assert out.columns == ["page_id", "url", "text", "n_chars"] and {r.n_chars for r in out.collect()} == {0, 37}
    assert html_text.extract(spark.createDataFrame([], clash)).count() == 0


def test_vectors(spark):
    kind = "vec_id long, embedding array<float>, id string, v string"
    ask = F.col("vec_id") % 50 == 0
    assert posting_ann.nearest(spark.createDataFrame([], kind), ask).count() == 0
    assert posting_ann.nearest(spark.createDataFrame([(50, None, "x", "y"), (None, [1.0], "x", "y")], kind), ask).count() == 0
    rows = [(50, [1.0, 0.0], "x", "y")] * 2 + [(k, [1.0, 0.0], "x", "y") for k in range(60, 70)]
    out = posting_ann.nearest(spark.createDataFrame(rows, kind), ask).orderBy("rank").collect()
    assert [r.vec_id for r in out] == [60, 61, 62, 63, 64] and all(r.score == pytest.approx(1) for r in out)


def test_images(spark):
    kind = "id long, data binary, cls string"
    assert image_match.similar_images(spark.createDataFrame([], kind)).count() == 0
    data = image_match.encode_png(image_match.paint(np.arange(8.0)))
    rows = [(1, data, "x"), (2, data, "x"), (2, data, "x"), (None, data, "x"), (3, None, "x"), (4, b"", "x")]
    out = sorted(map(tuple, image_match.similar_images(spark.createDataFrame(rows, kind)).select("id", "class_id", "group_id").collect()))
    assert out == [(1, 1, 1), (2, 1, 1), (2, 1, 1), (3, 3, 3), (4, 4, 4)]
