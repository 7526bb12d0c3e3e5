"""Queries that run as streams over what the tables hold now."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.embed import hash_batch
from ..streaming import cache, rate_limit, sync
from ..tables import new_folder
from .registry import register

QUERIES: dict = {}
SQL: dict = {}
query = register(QUERIES, SQL)

EVENTS = "{}/events.parque[t]"  # as a pattern, since a stream's path has to be a folder or a pattern


@query("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def stream_sync(spark: SparkSession, folder: str) -> DataFrame:
    """Events streamed into a table with the last one of each user."""
    return sync.synced(
        spark, EVENTS.format(folder), "user_id", [F.col("ts"), F.col("event_id")],
    ).select("user_id", "event_id", "event_type", "value")


@query("SELECT user_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS bucket, count(*) AS n, greatest(count(*) - 3, 0) AS refused FROM events GROUP BY ALL")
def stream_admission(spark: SparkSession, folder: str) -> DataFrame:
    """Requests of each user by day from a stream, with those over three; windows still open at its end included."""
    path = EVENTS.format(folder)
    events = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    counts = rate_limit.window_counts(events, limit=3, window="1 day", late="365 days")
    return sync.drained(spark, counts, ["user_id", "bucket"]).withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


@query("SELECT event_type || ' of ' || user_id AS text, count(*) - 1 AS hits, 1 AS misses, 8 AS dimension FROM events GROUP BY 1")
def cached_questions(spark: SparkSession, folder: str) -> DataFrame:
    """Questions of a stream, a text for each user and kind of event: the first one of a text is embedded, the others find its vector."""
    path = EVENTS.format(folder)
    events = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    asked = events.select(F.concat("event_type", F.lit(" of "), "user_id").alias("text"), F.col("ts").alias("asked_at"))
    stream = cache.cached_vectors(asked, partial(hash_batch, dimension=8), model="m", dimension=8, seconds=86400)
    found = cache.answered(spark, stream, new_folder(spark, "questions"))
    return found.groupBy("text").agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).cast("int").alias("misses"), F.max(F.size("vector")).alias("dimension"))
