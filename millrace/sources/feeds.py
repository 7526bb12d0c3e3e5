"""Landed feeds and files, and ancestors of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import document_kind, title_of
from ..operators.convert import html_text
from ..tables import materialize


def landed(spark: SparkSession, path: str, schema: str, *, array: bool = False) -> DataFrame:
    """Records of landed JSON, a line each or (``array``) whole files of arrays; what doesn't parse is in ``_bad``."""
    reader = spark.read.schema(f"{schema}, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad")
    return reader.option("multiLine", array).json(path)


def allowed_prefixes(records: DataFrame, prefixes: list[str], key_col: str = "key") -> DataFrame:
    """Records whose key's part before the first hyphen is allowed."""
    return records.where(F.split_part(key_col, F.lit("-"), F.lit(1)).isin(*prefixes))


def uploaded(spark: SparkSession, path: str) -> DataFrame:
    """Files as documents: name, kind, hash, title and text; kinds without an extractor here (pdf) have null text."""
    raw = spark.read.format("binaryFile").load(path)
    name = F.regexp_extract("path", "([^/]*)$", 1)
    kind = document_kind(F.lit(""), name)
    text = F.decode("content", "UTF-8")
    body = F.when(kind == "html", html_text(text)).when(kind.isin("markdown", "text"), text)
    return raw.select(
        name.alias("filename"), F.col("length").alias("size_bytes"), kind.alias("kind"), F.sha2("content", 256).alias("sha"),
        body.alias("body"),
    ).withColumn("title", title_of(F.col("body"), F.col("filename"), F.col("kind")))


def ancestors(pages: DataFrame) -> DataFrame:
    """(id, path, complete): the ids of each page's ancestors, root first, from parent_id.

    Chains are followed by doubling, one join for each power of two, until every page has reached the top, so a chain may
    be of any length. A page in a cycle or below one is not complete, and its path is empty. A parent that isn't among the
    pages ends a chain and is its first member.
    """
    kind = dict(pages.dtypes)["id"]
    none = F.array().cast(f"array<{kind}>")
    parent = F.col("parent_id").cast(kind)
    up = pages.select("id", parent.alias("top"), F.when(parent.isNotNull(), F.array(parent)).otherwise(none).alias("path"), F.lit(False).alias("round"))
    while up.where("top is not null").limit(1).count():
        above = up.select(F.col("id").alias("top"), F.col("top").alias("next"), F.col("path").alias("more"), F.col("round").alias("above_round"))
        path = F.concat(F.coalesce("more", none), "path")
        joined = up.join(above, "top", "left").select("id", "next", path.alias("path"), "round", "above_round")
        again = F.array_contains("path", F.col("id")) | (F.size(F.array_distinct("path")) < F.size("path"))
        stuck = F.col("round") | F.coalesce("above_round", F.lit(False)) | again
        ended = joined.select(
            "id", F.when(~stuck, F.col("next")).alias("top"), F.when(stuck, none).otherwise(F.col("path")).alias("path"),
            stuck.alias("round"),
        )
        up = materialize(ended, "ancestors")
    return up.select("id", "path", (~F.col("round")).alias("complete"))
