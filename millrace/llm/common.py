"""What the corpus operators share: tables in the shared folder, text columns, tokenizer files."""

from __future__ import annotations

import os
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The white space that separates words and is stripped from lines: space and U+0009 to U+000D.
ASCII_SPACE = " \t\n\x0b\x0c\r"
#: Bytes of a row group of the tables written: a task that writes or reads one holds its columns.
ROW_GROUP_BYTES = 16 << 20

_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where that is unset, a new one on a single
    machine; on a cluster an error, as executors would not see each other's files."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        import tempfile

        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")

        found = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str = "table", by: str | None = None) -> DataFrame:
    """Write ``df`` once as a Parquet table in the shared folder, a folder for each value of ``by``, and read it back.

    This cuts lineage, survives lost executors, and pins down whatever depends on how rows were dealt (partition
    ids, sampled range bounds). The tables of an application lie under one folder; ``drop_tables`` removes them, or those
    written since a ``mark``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/millrace-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    tidy = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(tidy, "false")
    spark.conf.set(tidy, "true")  # the shuffles behind a written table aren't read again
    try:
        written = df.write.options(**{"compression": "zstd", "parquet.block.size": ROW_GROUP_BYTES})
        (written.partitionBy(by) if by else written).parquet(path)
    finally:
        spark.conf.set(tidy, before)
    _written.append(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that nothing reads any more."""
    for t in tables:
        _delete(t.sparkSession, t.written_at)
        if t.written_at in _written:
            _written.remove(t.written_at)


def mark() -> int:
    """How many tables have been written so far."""
    return len(_written)


def _delete(spark: SparkSession, p: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_part(spark: SparkSession, table: str, part: str) -> None:
    """Delete a part such as ``kind=1`` of the table of this name that was written last."""
    found = [p for p in _written if p.rpartition("/")[2].startswith(f"{table}-")]
    _delete(spark, f"{found[-1]}/{part}")


def drop_tables(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Delete the tables written since a mark but for the last ``keep``, when their readers are done."""
    gone = _written[since : len(_written) - keep]
    for p in gone:
        _delete(spark, p)
    del _written[since : len(_written) - keep]


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only. Texts without other letters take the fast built-in."""
    plain = F.octet_length(c) == F.length(c)
    return F.when(plain, F.lower(c)).otherwise(F.translate(c, ASCII_UPPER, ASCII_UPPER.lower()))


def tokenizer_file(name: str) -> str:
    """Place of a public tokenizer's file; the folder can be given by MILLRACE_TOKENIZERS."""
    if folder := os.environ.get("MILLRACE_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def input_bytes(df: DataFrame) -> int:
    """Size of what ``df`` reads, as Spark estimates it; it picks partition counts, never which rows count."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
