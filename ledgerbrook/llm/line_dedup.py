"""Drop lines that many documents share: explode, hash, count documents per hash, reassemble by position.

DataFrame functions only. A line's key is the line without white space at both ends, A-Z lower-cased, hashed to two
64-bit numbers. Texts stay where they are unless the list of documents that lose lines is too long to broadcast.

Defined results: a null or empty text is one empty line and stays; rows of one id count as one document, and each of
them loses the lines that this id loses; a row whose id is null neither counts nor loses lines; an empty table gives an
empty table. Extra columns pass; columns named n_lines and n_dropped are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerbrook.llm.common import LOWER, SPACES, UPPER, join_checked, shared, without

#: Bytes of a row of the joined tables, headers included, for the check before a broadcast.
KEY_ROW_BYTES, DOC_ROW_BYTES = 64, 128


def line_key(line: Column) -> Column:
    bare = F.trim(line, F.lit(SPACES))
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``docs`` with the shared lines gone from the text, and n_lines (before) and n_dropped.

    A key of at least ``min_chars`` code points that at least ``min_docs`` documents hold loses its lines everywhere
    but in the document with the largest id.
    """
    docs = without(docs, ["n_lines", "n_dropped"])
    ident, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    keyed = (
        docs.where(ident.isNotNull() & (F.char_length(text) >= min_chars))
        .select(ident.alias("id"), F.explode(lines_of(text)).alias("line"))
        .where(F.char_length("line") >= min_chars)
        .select("id", line_key(F.col("line")).alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select("id", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    )
    common = shared(
        keyed.groupBy("h1", "h2").agg(F.count_distinct("id").alias("n"), F.max("id").alias("keeper")).where(F.col("n") >= min_docs).select("h1", "h2", "keeper")
    )
    lost = join_checked(keyed, common, ["h1", "h2"], "inner", KEY_ROW_BYTES).where(F.col("id") != F.col("keeper"))
    gone = shared(lost.groupBy(F.col("id").alias("__gone_id")).agg(F.collect_set("h1").alias("__gone_keys")))
    joined = join_checked(docs.withColumn("__gone_of", ident), gone, F.col("__gone_of") == F.col("__gone_id"), "left", DOC_ROW_BYTES)
    lines = lines_of(text)
    kept = F.filter(lines, lambda x: (F.char_length(x) < min_chars) | ~F.array_contains(F.col("__gone_keys"), F.xxhash64(line_key(x))))
    out = joined.withColumn("n_lines", F.size(lines).cast("long"))
    out = out.withColumn("__kept_lines", F.when(F.col("__gone_keys").isNotNull(), kept))
    out = out.withColumn("n_dropped", F.coalesce(F.col("n_lines") - F.size("__kept_lines"), F.lit(0)).cast("long"))
    new_text = F.when(F.col("__kept_lines").isNotNull(), F.array_join("__kept_lines", "\n")).otherwise(text)
    return out.withColumn(text_col, new_text).select(*[F.col(f"`{c}`") for c in docs.columns], "n_lines", "n_dropped")
