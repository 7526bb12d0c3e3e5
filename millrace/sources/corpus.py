"""The corpus (sources, chunks, vectors) as views of the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.english import lexemes
from ..functions.text import first_line, tokens
from ..tables import tidy

EPOCH = "2024-01-01 00:00:00"
#: Parts of a stored lexeme table.
PARTS = 64


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def sources(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as sources: the id is the key, the site the project, an hour per id the time of update."""
    d = table(spark, folder, "documents")
    return d.select(
        F.lit("document").alias("source_type"), F.col("doc_id").cast("string").alias("source_key"), F.nullif("source", F.lit("")).alias("project"), F.substring(first_line(F.col("text")), 1, 200).alias("title"),
        F.col("text").alias("body"), "lang", "doc_id", F.expr(f"timestamp_ntz'{EPOCH}' + make_dt_interval(0, cast(doc_id as int))").alias("updated_at"),
    )


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors joined to the text of the document with their number; four numbers in a row belong to one source."""
    e, d = table(spark, folder, "embeddings"), table(spark, folder, "documents")
    return e.join(d, e.vec_id == d.doc_id).select(
        F.col("vec_id").alias("chunk_id"), F.expr("vec_id div 4 * 4").alias("source_id"), "label", "embedding", "text", "source", "lang",
    )


def postings(chunks: DataFrame, terms: list[str], *, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """(id, term, position, nth) of the query's terms: positions among all tokens, and the count among the terms'.

    Other tokens are dropped before anything is exploded.
    """
    numbered = F.transform(tokens(F.col(text_col)), lambda t, i: F.struct(t.alias("term"), i.alias("position")))
    hits = F.filter(numbered, lambda p: p["term"].isin(*terms))
    return chunks.select(F.col(id_col), F.posexplode(hits).alias("nth", "p")).select(id_col, "p.term", "p.position", "nth")


def lexeme_table(chunks: DataFrame, *, id_col: str = "chunk_id", text_col: str = "text", terms: list[str] | None = None) -> DataFrame:
    """(id, term, position) of every word that isn't a stop word: its lexeme and its place among all tokens.

    Each distinct word is stemmed once and joined to its places; with ``terms``, only words of those lexemes are.
    """
    words = lexemes(chunks.select(F.explode(F.array_distinct(tokens(F.col(text_col)))).alias("word")))
    if terms is not None:
        words = words.where(F.col("lexeme").isin(*terms))
    places = chunks.select(F.col(id_col), F.posexplode(tokens(F.col(text_col))).alias("position", "word"))
    return places.join(words, "word").select(id_col, F.col("lexeme").alias("term"), "position")


def _part(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(PARTS)).cast("int")


def write_postings(chunks: DataFrame, path: str) -> None:
    """Store the lexeme table of a corpus in parts by lexeme, so that a question reads those of its words only."""
    table = lexeme_table(chunks).withColumn("part", _part(F.col("term")))
    table.hint("rebalance", "part", "term").sortWithinPartitions("part", "term").write.mode("overwrite").partitionBy("part").parquet(path)


def stored_postings(spark: SparkSession, path: str, terms: list[str]) -> DataFrame:
    """The stored postings of some lexemes; the hash of each is a constant, so only its part of the table is listed."""
    keep = F.lit(False)
    for t in terms:
        keep = keep | ((F.col("part") == _part(F.lit(t))) & (F.col("term") == t))
    return spark.read.parquet(path).where(keep).select("chunk_id", "term", "position")


def write_counted_postings(chunks: DataFrame, path: str) -> None:
    """Store a row for each lexeme and chunk, with its count and positions, in parts by lexeme and within them the largest counts first: the
    statistics of a file's row groups then bound the counts, and a filter on them skips groups."""
    places = F.array_sort(F.collect_list("position")).alias("positions")
    rows = lexeme_table(chunks).groupBy("term", "chunk_id").agg(places).withColumns({"count": F.size("positions"), "part": _part(F.col("term"))})
    dealt = rows.hint("rebalance", "part", "term").sortWithinPartitions("part", "term", F.desc("count"), "chunk_id")  # a frequent lexeme is split
    with tidy(chunks.sparkSession):
        dealt.write.mode("overwrite").partitionBy("part").option("parquet.block.size", 1 << 20).option("compression", "zstd").parquet(path)


def counted_postings(spark: SparkSession, path: str, terms: list[str], least: int = 1) -> DataFrame:
    """(chunk_id, term, count, positions) of some lexemes in chunks that have them ``least`` times."""
    keep = F.lit(False)
    for t in terms:
        keep = keep | ((F.col("part") == _part(F.lit(t))) & (F.col("term") == t))
    schema = "term string, chunk_id long, positions array<int>, count int, part int"
    return spark.read.schema(schema).parquet(path).where(keep & (F.col("count") >= least)).drop("part")


def ordered(found: DataFrame, *, id_col: str = "chunk_id") -> DataFrame:
    """Postings with ``nth``, their number among those of a question in their chunk."""
    return found.withColumn("nth", F.row_number().over(Window.partitionBy(id_col).orderBy("position")) - 1)
