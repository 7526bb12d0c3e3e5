"""Idempotent loads over plain tables: each returns the next version of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The next version of ``stored``: of each key the incoming row that is last by ``order``, else the stored one.

    Stored rows whose key comes in are left out by an anti join, so only keys and incoming rows are compared.
    """
    w = Window.partitionBy(*keys).orderBy(*[c.desc() for c in order])
    last = incoming.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return stored.join(last.select(*keys), keys, "left_anti").unionByName(last)


def replace_children(stored: DataFrame, incoming: DataFrame, parent: list[str], touched: DataFrame | None = None) -> DataFrame:
    """Drop every stored child of a touched parent and add the incoming ones; a parent may come in without any."""
    parents = (incoming if touched is None else touched).select(*parent).distinct()
    return stored.join(parents, parent, "left_anti").unionByName(incoming)


def replace_edges(stored: DataFrame, incoming: DataFrame, touched: DataFrame | None = None) -> DataFrame:
    """Edges (source_id, target_type, target_key, kind): trimmed, without blanks and loops, each once."""
    names = ["target_type", "target_key", "kind"]
    clean = incoming.select("source_id", *[F.trim(c).alias(c) for c in names]).where(" and ".join(f"{c} != ''" for c in names) + " and target_key != source_id").distinct()
    return replace_children(stored, clean, ["source_id"], incoming if touched is None else touched)


def cascade(children: DataFrame, parents: DataFrame, key: list[str]) -> DataFrame:
    """Children whose parent still exists."""
    return children.join(parents.select(*key), key, "left_semi")


def known_and_new(incoming: DataFrame, stored: DataFrame, hash_col: str = "sha") -> tuple[DataFrame, DataFrame]:
    """Incoming rows whose hash is stored already, and one row for each of the other hashes (the smallest by all columns).

    A hash that comes in twice is new once: what is loaded first makes the others known.
    """
    have = stored.select(hash_col).distinct()
    rest = [c for c in incoming.columns if c != hash_col]
    least = F.min(F.struct(*[F.col(f"`{c}`") for c in rest])).alias("_least")
    new = incoming.join(have, hash_col, "left_anti").groupBy(hash_col).agg(least)
    new = new.select(*[F.col(hash_col) if c == hash_col else F.col(f"_least.`{c}`").alias(c) for c in incoming.columns])
    return incoming.join(have, hash_col, "left_semi"), new


def next_watermark(rows: DataFrame, started: Column, time_col: str = "updated_at", failed: Column | None = None) -> DataFrame:
    """The mark after a run: the latest time processed, not before ``started``; null (keep the old one) if a row
    failed or none came."""
    bad = F.count_if(F.coalesce(failed, F.lit(False))) if failed is not None else F.lit(0)
    return rows.agg(F.when((bad == 0) & (F.count("*") > 0), F.greatest(F.max(time_col), started)).alias("next_mark"))


def since(rows: DataFrame, mark: Column, slack_seconds: int = 60, time_col: str = "updated_at") -> DataFrame:
    """Rows from the mark on, less the slack that the next load absorbs."""
    return rows.where(F.col(time_col) >= mark - F.expr(f"interval {slack_seconds} seconds"))


def keyset_page(rows: DataFrame, key: str, after: int, size: int = 500) -> DataFrame:
    """The next ``size`` rows by key; the bound reaches the scan."""
    return rows.where(F.col(key) > after).orderBy(key).limit(size)
