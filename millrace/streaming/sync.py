"""Incremental sync: a stream of records into the versions of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.loads import upsert
from ..sources.store import Change, Store, Table
from ..tables import materialize, new_folder


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``."""
    return new_folder(spark, "sync")


def stream_store(spark: SparkSession, folder: str, schema: T.StructType, key: str) -> Store:
    """The store of one table, by the name ``rows``, that a stream of this schema is taken into."""
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields)
    return Store(spark, f"{folder}/table", {"rows": Table(columns, key)})


def sync(stream: DataFrame, folder: str, key: str, order: list[Column]) -> Store:
    """Take what a stream has now into the table in ``folder``: of each key the last row of the latest batch with one.

    A batch rewrites the buckets that its keys fall into and commits them with its number. One that is replayed after a
    failure finds its number committed, or nothing of it. The stream's checkpoint is the high-water mark; it moves only
    when a batch is committed. Rows without a key are added, as no other row is theirs.
    """
    store = stream_store(stream.sparkSession, folder, stream.schema, key)

    def load(batch: DataFrame, number: int) -> None:
        base = store.snapshot()
        if base.report.get("batch", -1) < number:
            none = F.col(key).isNull()
            last = upsert(batch.limit(0), batch.where(~none), [key], order).unionByName(batch.where(none))
            store.commit(base, {"rows": Change(materialize(last, "batch"))}, {"batch": number})
            store.vacuum()

    writer = stream.writeStream.foreachBatch(load).option("checkpointLocation", f"{folder}/progress")
    writer.trigger(availableNow=True).start().awaitTermination()
    return store


def synced(spark: SparkSession, path: str, key: str, order: list[Column], files_per_batch: int = 4, folder: str | None = None) -> DataFrame:
    """The table after all files of ``path`` came in as a stream. A later run with the same ``folder`` goes on from the mark
    kept there and takes new files only."""
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return sync(stream, folder or shared_folder(spark), key, order).read("rows")


def drained(spark: SparkSession, result: DataFrame, keys: list[str]) -> DataFrame:
    """The state of a streaming aggregate after all that its source holds now, open windows included.

    Each batch writes the rows it has changed under its number; of a key the last batch's row holds.
    """
    folder = shared_folder(spark)

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/rows/b={number}")

    writer = result.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/progress")
    writer.trigger(availableNow=True).start().awaitTermination()
    columns = result.columns
    kept = T.StructType([*result.schema.fields, T.StructField("_batch", T.IntegerType())])
    rows = spark.read.schema(kept).parquet(f"{folder}/rows")
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in columns if c not in keys]), "_batch").alias("_last"))
    return last.select(*[F.col(c) if c in keys else F.col(f"_last.{c}").alias(c) for c in columns])
