"""From raw documents to packed training sequences: five stages over whole tables, each written before the next."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import documents, drop_tables, mark, materialize, tokenizer_file
from millrace.llm.language_id import identify, learn
from millrace.llm.line_dedup import line_dedup
from millrace.llm.mixing import mix
from millrace.llm.ngram_join import near_duplicates
from millrace.llm.packing import pack

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents with a language: one that is undetermined, or is less than half of any language, goes."""
    model = learn(docs)
    return identify(docs, model).where((F.col("lang_pred") != "und") & (F.col("score") >= 0.5)).select(*COLUMNS)


def shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines found in five documents or more from all but one; a document left without text goes."""
    kept = line_dedup(docs, min_chars=40, min_docs=5)
    some = kept.where((F.col("n_dropped") == 0) | (F.length(F.btrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r"))) > 0))
    return some.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, that with the smallest doc_id, of each group linked by a similarity of 0.8 or more.

    Rows are decided on, not ids: of rows with one id, which count as linked, one stays, by the hash of its shingles; rows
    without id go where one with an id is in their group. Documents without words stay.
    """
    found = near_duplicates(docs, k=5, threshold=Fraction(4, 5), carry=COLUMNS)
    return found.where("first").select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put all documents in the order of the mixture.

    Reading the files back doesn't keep an order; it follows from the rows alone, so ``packed`` finds it again.
    """
    return mix(docs).orderBy("mix_slot", "mix_start", "doc_id").select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens in the order of the mixture: a row for each piece of a document, with its token
    ids and its document's mix_slot.

    The mixture depends on ids, sources and sizes only and is computed again here, whatever files the rows come from.
    Documents are dealt by ranges of (mix_slot, mix_start), so that sequence ids, which rise with the partition, follow
    the mixture: from one group of packed fragments to the next exactly, within a group as the differencing deals them.
    """
    order = ["mix_slot", "mix_start", "doc_id"]
    ranged = mix(docs).select("doc_id", "text", "mix_slot", "mix_start").repartitionByRange(*order).sortWithinPartitions(*order)
    return pack(ranged, "doc_id", "text", tokenizer_file("byte_bpe_50k.json"), capacity=1024, carry="mix_slot")


STAGES = [("language", language), ("shared_lines", shared_lines), ("near_copies", near_copies), ("mixed", mixed), ("packed", packed)]
#: Language models, tokenizers and the packing itself are beyond SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written to the shared folder and read again, and all tables written
    before are deleted then."""
    docs, before = documents(spark, sf_dir), mark()
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        drop_tables(spark, before, keep=1)
    return STAGES[-1][1](spark, docs, sf_dir)
