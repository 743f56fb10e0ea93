"""One query per corpus operator, over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerbrook.llm import html_text, image_match, jaccard_join, langid, line_dedup, masked_lm, mixing, packing, posting_ann, toxicity
from ledgerbrook.llm.common import fold, table

#: Rows of this remainder (of four) are never learnt from.
HELD_OUT = 2


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(fold(F.col("doc_id")) != HELD_OUT)
    out = toxicity.score(docs, toxicity.fit(docs, labels))
    return out.select("doc_id", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), "score", "predicted")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary())


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select(
        "doc_id",
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        (F.col("mix_size") * F.size("mix_shards")).alias("taken"),
        F.col("source"),
        F.col("mix_shards").alias("shards"),
        F.col("mix_order").alias("orders"),
    )


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def fit_langid(docs: DataFrame) -> langid.Model:
    return langid.fit(docs.where(fold(F.col("doc_id")) != HELD_OUT), F.col("text"), F.col("lang"), F.col("doc_id"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = langid.identify(docs.select("doc_id", "text"), fit_langid(docs))
    return out.select("doc_id", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), "lang_pred", "score")


def op6_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No table holds images, so each row of embeddings is drawn as one; of every eight, two are edited copies."""
    return image_match.similar_images(image_match.render(table(spark, sf_dir, "embeddings")), "id", "data").withColumnRenamed("id", "vec_id")


def op7_posting_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posting_ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op10_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready = masked_lm.prepared(table(spark, sf_dir, "documents"))
    return masked_lm.score(ready, *masked_lm.fit(ready))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op6_image_copies": op6_image_copies, "op7_posting_ann": op7_posting_ann, "op10_masked_lm": op10_masked_lm, "op3_html_extraction": op3_html_extraction, "op9_ngram_jaccard_join": op9_ngram_jaccard_join, "op4_source_mixing": op4_source_mixing, "op1_toxicity": op1_toxicity, "op8_language_id": op8_language_id, "op2_best_fit_packing": op2_best_fit_packing, "op5_line_dedup": op5_line_dedup}

ORACLES = {
    "op5_line_dedup": """
        WITH lines AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                   generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
            FROM documents),
        keyed AS (
            SELECT doc_id, pos, line,
                   translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line_key
            FROM lines),
        common AS (
            SELECT line_key, max(doc_id) AS keeper FROM keyed WHERE length(line_key) >= 40
            GROUP BY line_key HAVING count(DISTINCT doc_id) >= 5)
        SELECT k.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE c.keeper <> k.doc_id) AS n_dropped,
               sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.pos)
                               FILTER (WHERE c.keeper IS NULL OR c.keeper = k.doc_id), '')) AS kept_sha256
        FROM keyed k LEFT JOIN common c USING (line_key) GROUP BY k.doc_id""",
    "op9_ngram_jaccard_join": """
        WITH RECURSIVE words AS (
            SELECT doc_id, list_filter(regexp_split_to_array(
                       translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[ \\x09-\\x0D]+'), lambda x: x <> '') AS ws
            FROM documents),
        shingles AS (
            SELECT DISTINCT doc_id, unnest(
                CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
                     ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS s
            FROM words),
        sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
        shared AS (
            SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
            GROUP BY a.doc_id, b.doc_id),
        links AS (
            SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
        reach AS (
            SELECT doc_id, doc_id AS root FROM documents
            UNION SELECT l.y, r.root FROM reach r JOIN links l ON l.x = r.doc_id)
        SELECT d.doc_id, coalesce(z.n, 0)::bigint AS n_shingles, d.component_id
        FROM (SELECT doc_id, min(root) AS component_id FROM reach GROUP BY doc_id) d LEFT JOIN sizes z USING (doc_id)""",
}
