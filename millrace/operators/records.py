"""Small writes on stored records: conversations with their messages, and access tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A piece of a streamed answer.
CHUNK = "choices array<struct<delta:struct<content:string>>>, error struct<message:string>"


def append_messages(conversations: DataFrame, messages: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The next versions of (conversations, messages): incoming messages (conv_id, role, text, created_at) are added where
    their conversation exists, whose updated_at moves to the latest of them and never back."""
    known = incoming.join(conversations.select("conv_id"), "conv_id", "left_semi")
    latest = known.groupBy("conv_id").agg(F.max("created_at").alias("_latest"))
    moved = conversations.join(latest, "conv_id", "left").withColumn("updated_at", F.greatest("updated_at", "_latest")).drop("_latest")
    return moved, messages.unionByName(known.select(*messages.columns))


def renamed(rows: DataFrame, changes: DataFrame, *, key: str = "id", owner: str = "owner", title: str = "title") -> DataFrame:
    """Rows with the titles that their owners give them: a change (key, owner, title) of anyone else, or a blank one, does
    nothing. Of several changes of one row the last title by name holds."""
    wanted = changes.where(F.trim(title) != "").groupBy(key, owner).agg(F.max(F.trim(title)).alias("_title"))
    return rows.join(wanted, [key, owner], "left").withColumn(title, F.coalesce("_title", title)).drop("_title").select(*rows.columns)


def owned(rows: DataFrame, who: Column, owner: str = "owner") -> DataFrame:
    """Rows of one owner; none for a null one."""
    return rows.where(F.col(owner) == who)


def by_unique_prefix(rows: DataFrame, prefixes: DataFrame, *, key: str, prefix: str = "prefix") -> DataFrame:
    """For each prefix, not blank, the one row whose key starts with it; none where there are several or none.

    Keys meet prefixes of each length that occurs, by equality; the lengths are few whatever the number of prefixes.
    """
    asked = prefixes.select(F.trim(prefix).alias(prefix)).where(F.col(prefix) != "").distinct()
    lengths = sorted(r[0] for r in asked.select(F.length(prefix)).distinct().collect())
    starts = F.array(*[F.when(F.length(key) >= n, F.substring(key, 1, n)) for n in lengths]).cast("array<string>")
    met = rows.select(key, F.explode(starts).alias(prefix)).join(asked, prefix)
    found = met.groupBy(prefix).agg(F.count("*").alias("_n"), F.min(key).alias(key)).where("_n = 1")
    return found.select(prefix, key)


def folded(lines: DataFrame, *, key: str, order: str, line: str = "line") -> DataFrame:
    """(key, text, error): streamed answers put together from the lines of each, in order. Lines that aren't data, the end mark and what
    isn't JSON are passed over; an error object ends an answer, and what came before stays. An answer is one text of one row,
    which bounds what is gathered."""
    payload = F.trim(F.regexp_extract(F.trim(line), r"(?s)\Adata:(.*)", 1))
    pieces = lines.select(key, F.col(order).alias("_at"), F.from_json(F.when(~payload.isin("", "[DONE]"), payload), CHUNK).alias("_c")).where("_c is not null")
    said = F.transform(F.coalesce("_c.choices", F.array().cast("array<struct<delta:struct<content:string>>>")), lambda c: F.coalesce(c["delta"]["content"], F.lit("")))
    each = F.array_sort(F.collect_list(F.struct("_at", F.array_join(said, "").alias("text"), F.col("_c.error.message").alias("error"))))
    lists = pieces.groupBy(key).agg(each.alias("_each"))
    failed = F.get(F.filter("_each", lambda e: e["error"].isNotNull()), 0)
    kept = F.filter("_each", lambda e: F.col("_failed").isNull() | (e["_at"] < F.col("_failed._at")))
    return lists.withColumn("_failed", failed).select(key, F.array_join(F.transform(kept, lambda e: e["text"]), "").alias("text"), F.col("_failed.error").alias("error"))


def revoked(tokens: DataFrame, gone: DataFrame, now: Column, *, key: str = "id") -> DataFrame:
    """Tokens with those of ``gone`` revoked as of now; a token that was revoked before keeps its time."""
    marked = gone.select(key).distinct().withColumn("_gone", F.lit(True))
    at = F.when(F.col("_gone"), F.coalesce("revoked_at", now)).otherwise(F.col("revoked_at"))
    return tokens.join(marked, key, "left").withColumn("revoked_at", at).drop("_gone").select(*tokens.columns)


def touched(tokens: DataFrame, uses: DataFrame, *, key: str = "id") -> DataFrame:
    """Tokens with the time of their last use (key, used_at)."""
    last = uses.groupBy(key).agg(F.max("used_at").alias("_used"))
    return tokens.join(last, key, "left").withColumn("last_used_at", F.greatest("last_used_at", "_used")).drop("_used").select(*tokens.columns)
