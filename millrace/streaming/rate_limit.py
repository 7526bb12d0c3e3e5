"""Fixed-window admission, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def admitted(
    requests: DataFrame, *, limit: int = 30, window: str = "10 seconds", user_col: str = "user_id", time_col: str = "ts",
    tie: str = "event_id",
) -> DataFrame:
    """Add ``admitted``: whether a request is among the first ``limit`` of its user's window. No user, no admission.

    Requests of one user in one window are sorted together; windows are short, which bounds them.
    """
    bucket = F.date_trunc(window, F.col(time_col)) if " " not in window else F.window(F.col(time_col).cast("timestamp"), window)["start"]
    w = Window.partitionBy(user_col, bucket).orderBy(time_col, tie)
    return requests.withColumn("admitted", F.col(user_col).isNotNull() & (F.row_number().over(w) <= limit))


def window_counts(
    requests: DataFrame, *, limit: int = 30, window: str = "10 seconds", late: str = "1 minute", user_col: str = "user_id",
    time_col: str = "ts",
) -> DataFrame:
    """Counts of a stream by user and window, with how many were over the limit. The watermark bounds the state."""
    timed = requests.withColumn("_at", F.col(time_col).cast("timestamp")).withWatermark("_at", late)
    counts = timed.groupBy(user_col, F.window("_at", window)).agg(F.count("*").alias("n"))
    return counts.select(user_col, F.col("window.start").alias("bucket"), "n", F.greatest(F.col("n") - limit, F.lit(0)).alias("refused"))
