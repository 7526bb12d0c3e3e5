"""Dropping lines that many documents share, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, ascii_lower


def line_key(line: Column) -> Column:
    """A line's key: ASCII white space stripped at both ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(ASCII_SPACE)))


def line_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """Drop lines found in at least ``min_docs`` documents from all but the largest id that holds them.

    Lines are split at \\n. Those whose key has at least ``min_chars`` code points are exploded as 128-bit hashes,
    once for each document; a first count per (line, document) and a second per line give the number of distinct
    documents, so that a line in every document is summed before it is shuffled. Frequent lines join back to the
    documents that hold them (a line of many documents is a skewed key of an inner join, which adaptive execution
    splits), are gathered per document, and the text is put together again from its lines in order.

    Returns the input's columns with ``text_col`` replaced, and n_lines, n_dropped (long). These two replace input
    columns of the same names. A null or empty text is one empty line and stays as it is. A row without id holds no
    vote and loses nothing. Very long texts are split whole. Rows with equal ids count as one document, and each loses the same lines. An empty table
    gives no rows.
    """
    text, doc = F.coalesce(F.col(text_col), F.lit("")), F.col(id_col)
    lines = F.split(text, "\n", -1)

    def hashed(line: Column) -> Column:
        key = line_key(line)
        return F.when(F.length(key) >= min_chars, F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(17), key).alias("b")))

    held = (
        docs.where(doc.isNotNull() & (F.length(F.col(text_col)) >= min_chars))
        .select(doc.alias("doc"), F.explode(F.array_distinct(F.transform(lines, hashed))).alias("h"))
        .where("h is not null")
        .select("h.a", "h.b", "doc")
        .groupBy("a", "b", "doc")
        .agg(F.lit(1).alias("one"))
    )
    frequent = held.groupBy("a", "b").agg(F.count("*").alias("n"), F.max("doc").alias("keeper")).where(F.col("n") >= min_docs).drop("n")
    dropped = held.join(frequent, ["a", "b"]).where(F.col("doc") < F.col("keeper")).groupBy("doc").agg(F.collect_list(F.struct("a", "b")).alias("drop"))
    marked = docs.select(F.struct("*").alias("row"), doc.alias("key")).join(dropped, F.col("key") == F.col("doc"), "left").select("row", "drop")
    whole = F.split(F.coalesce(F.col(f"row.{text_col}"), F.lit("")), "\n", -1)
    parts = marked.select("row", whole.alias("lines"), "drop").select(
        "row", "lines",
        F.when(F.col("drop").isNull(), F.col("lines")).otherwise(F.filter(
            "lines", lambda x: ~F.coalesce(F.array_contains(F.col("drop"), hashed(x)), F.lit(False)),
        )).alias("stay"),
    )
    n_lines, n_stay = F.size("lines").cast("long"), F.size("stay").cast("long")
    same = n_lines == n_stay
    keep = [F.col(f"row.`{c}`").alias(c) if c != text_col else F.when(same, F.col(f"row.`{c}`")).otherwise(F.array_join("stay", "\n")).alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return parts.select(*keep, n_lines.alias("n_lines"), (n_lines - n_stay).alias("n_dropped"))
