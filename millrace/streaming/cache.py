"""State with expiry: vectors of questions, embedded once and kept for a while."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.vectors import cache_key

SECONDS = 300
ANSWERS = "key string, text string, asked_at timestamp, hit boolean, vector array<float>"


class _Kept(StatefulProcessor):
    """One key's vector, with its time to live. The first row without one embeds the text; those after it find it."""

    def __init__(self, embedder: Callable[[list[str]], list], dimension: int, seconds: float):
        self.embedder, self.dimension, self.milliseconds = embedder, dimension, int(1000 * seconds)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.vector = handle.getValueState("vector", "vector array<float>", ttlDurationMs=self.milliseconds)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        kept = list(self.vector.get()[0]) if self.vector.exists() else None
        if kept is not None and len(kept) != self.dimension:  # of another model: evicted
            self.vector.clear()
            kept = None
        for f in rows:
            hit = [True] * len(f)
            if kept is None and len(f):
                kept = [float(x) for x in self.embedder([f["text"].iloc[0]])[0]]
                if len(kept) != self.dimension:
                    raise ValueError("the embedder gave a vector of another length")
                self.vector.update((kept,))
                hit[0] = False
            yield pd.DataFrame({"key": key[0], "text": f["text"], "asked_at": f["asked_at"], "hit": hit, "vector": [kept or []] * len(f)})

    def close(self) -> None:
        pass


def cached_vectors(questions: DataFrame, embedder: Callable[[list[str]], list], *, model: str, dimension: int, seconds: float = SECONDS) -> DataFrame:
    """A stream of questions (text, asked_at) with their vectors, and whether these were kept from before.

    A vector lives for ``seconds`` after it was written, by the clock of the tasks, then goes from the state by itself; one of another
    dimension counts as none. Keys are dealt over tasks by hash, and a key's vector is all that is kept of it.
    """
    spark = questions.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    keyed = questions.select(cache_key("", model, F.col("text")).alias("key"), "text", F.col("asked_at").cast("timestamp").alias("asked_at")).where("text is not null")
    return keyed.groupBy("key").transformWithStateInPandas(_Kept(embedder, dimension, seconds), ANSWERS, "Update", "ProcessingTime")


def answered(spark: SparkSession, stream: DataFrame, folder: str) -> DataFrame:
    """All that a stream of answers gives for what its source has now, and gave before, as a table in ``folder``. It ends with the
    source's rows: batches without any, which only let state expire, are left out."""
    name = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        writer = stream.writeStream.outputMode("update").foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/answers/batch={n}"))
        writer.option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(name, before)
    return spark.read.schema(f"{ANSWERS}, batch int").parquet(f"{folder}/answers")
