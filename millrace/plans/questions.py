"""Hybrid search for a table of questions at once."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..options import SearchOptions
from ..sources.corpus import postings
from .search import PLACES, allowed, recency

#: Questions that meet the vectors in one scan, vectors in a step of it, and distinct terms that are looked for before texts are exploded.
BLOCK, STEP, TERMS = 512, 2_048, 10_000


def vector_hits(chunks: DataFrame, questions: DataFrame, k: int = 50) -> DataFrame:
    """(question_id, chunk_id, v_score): the ``k`` nearest chunks of every question (question_id, vector), ties to the smaller chunk.

    Vectors are scanned once for each block of questions; a task keeps ``k`` rows for each question, and hands on no more. Questions
    and chunks without a vector, with a zero one, or of different dimensions have no hits of each other.
    """
    asked = questions.select(F.col("question_id").cast("long"), F.col("vector").cast("array<double>").alias("vector")).where("vector is not null and exists(vector, x -> x != 0)")
    found = None
    for block in batched(asked.orderBy("question_id").toLocalIterator(), BLOCK):
        by_size: dict[int, list] = {}
        for r in block:
            by_size.setdefault(len(r.vector), []).append(r)
        for size, rows in by_size.items():
            q = np.array([r.vector for r in rows])
            kept = _nearest(np.array([r.question_id for r in rows]), q / np.linalg.norm(q, axis=1)[:, None], k)
            fit = chunks.where(F.size("embedding") == size).select(F.col("chunk_id").cast("long"), F.col("embedding").cast("array<double>"))
            part = fit.mapInArrow(kept, "question_id long, chunk_id long, v_score double")
            found = part if found is None else found.unionByName(part)
    if found is None:
        return chunks.sparkSession.createDataFrame([], "question_id long, chunk_id long, v_score double")
    return _top(found, k, F.desc("v_score"), F.col("chunk_id"))


def _top(rows: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first ``k`` rows of every question; Spark cuts each task's rows before the exchange."""
    n = F.row_number().over(Window.partitionBy("question_id").orderBy(*order))
    return rows.withColumn("_n", n).where(F.col("_n") <= k).drop("_n")


def _nearest(ids: np.ndarray, questions: np.ndarray, k: int):
    """A task's top-k of every question, merged step by step."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores, chunk = np.full((len(ids), 0), 0.0), np.full((len(ids), 0), 0, np.int64)
        for b in batches:
            for a in range(0, b.num_rows, STEP):
                part = b.slice(a, STEP)
                v = np.array(part.column(1).to_pylist(), np.float64)
                length = np.linalg.norm(v, axis=1)
                fine = np.isfinite(length) & (length > 0)
                new = np.round(questions @ (v[fine] / length[fine, None]).T, PLACES)
                new_ids = np.broadcast_to(part.column(0).to_numpy(zero_copy_only=False)[fine], new.shape)
                scores, chunk = np.hstack((scores, new)), np.hstack((chunk, new_ids))
                first = np.lexsort((chunk, -scores), axis=1)[:, :k]
                scores, chunk = np.take_along_axis(scores, first, 1), np.take_along_axis(chunk, first, 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, scores.shape[1])), pa.array(chunk.ravel()), pa.array(scores.ravel())], names=["question_id", "chunk_id", "v_score"])

    return run


def text_hits(chunks: DataFrame, questions: DataFrame, k: int = 50) -> DataFrame:
    """(question_id, chunk_id, f_score): for every question (question_id, terms) the ``k`` chunks with the highest cover density of all its
    terms, which are lower-cased words; none for a question without terms.

    Texts are read once for all questions. A chunk's postings are sorted within the question and the chunk alone.
    """
    asked = questions.select(F.col("question_id").cast("long"), F.filter(F.array_distinct("terms"), lambda t: t.isNotNull()).alias("terms"))
    each = asked.select("question_id", F.size("terms").alias("m"), F.posexplode("terms").alias("t", "term"))
    words = [r.term for r in each.select("term").distinct().limit(TERMS + 1).collect()]
    most = each.agg(F.max("m")).first()[0]
    if most is None:
        return chunks.sparkSession.createDataFrame([], "question_id long, chunk_id long, f_score double")
    if len(words) <= TERMS:
        found = postings(chunks, words).select("chunk_id", "term", "position")
    else:
        from ..functions.text import tokens

        found = chunks.select("chunk_id", F.posexplode(tokens(F.col("text"))).alias("position", "term"))
    met = found.join(each, "term")
    w = Window.partitionBy("question_id", "chunk_id").orderBy("position")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    numbered = met.withColumn("nth", F.row_number().over(w))
    lasts = F.array(*[F.max(F.when(F.col("t") == i, F.struct("position", "nth"))).over(so_far) for i in range(most)])
    ends = numbered.select("question_id", "chunk_id", F.struct("position", "nth").alias("end"), F.slice(lasts, 1, F.col("m")).alias("lasts"))
    full = ends.where(F.forall("lasts", lambda x: x.isNotNull()))
    covers = full.select("question_id", "chunk_id", F.array_min("lasts").alias("start"), "end").groupBy("question_id", "chunk_id", "start").agg(F.min("end").alias("end"))
    noise = (F.col("end.position") - F.col("start.position")) - (F.col("end.nth") - F.col("start.nth"))
    scored = covers.groupBy("question_id", "chunk_id").agg(F.round(F.sum(F.lit(0.1) / (1 + noise)), PLACES).alias("f_score"))
    return _top(scored, k, F.desc("f_score"), F.col("chunk_id"))


def hybrid(chunks: DataFrame, sources: DataFrame, questions: DataFrame, options: SearchOptions, *, as_of: Column | None = None) -> DataFrame:
    """Ranked hits of every question (question_id, vector, terms), at most ``options.candidates`` of each, a source once:
    (question_id, rank, source_id, chunk_id, v_score, f_score, score), as ``search.hybrid`` ranks them for one."""
    v, f = vector_hits(chunks, questions, options.candidates), text_hits(chunks, questions, options.candidates)
    none = F.lit(None).cast("double")
    both = v.withColumn("f_score", none).unionByName(f.withColumn("v_score", none))
    one = both.groupBy("question_id", "chunk_id").agg(F.max("v_score").alias("v_score"), F.max("f_score").alias("f_score"))
    top, weights = F.max("f_score").over(Window.partitionBy("question_id")), options.weights()
    share = F.coalesce(F.col("f_score") / F.nullif(top, F.lit(0.0)), F.lit(0.0))
    score = F.round(F.coalesce("v_score", F.lit(0.0)) * weights[0] + share * weights[1], PLACES)
    fused = one.select("question_id", "chunk_id", F.coalesce("v_score", F.lit(0.0)).alias("v_score"), F.coalesce("f_score", F.lit(0.0)).alias("f_score"), score.alias("score"))
    of = fused.join(chunks.select("chunk_id", "source_id"), "chunk_id").join(sources, "source_id").where(allowed(options))
    w = Window.partitionBy("question_id", "source_id").orderBy(F.desc("score"), "chunk_id")
    best = _top(of.withColumn("_best", F.row_number().over(w)).where("_best = 1"), options.candidates, F.desc("score"), F.col("source_id"))
    now = F.current_timestamp() if as_of is None else as_of
    raised = best.withColumn("score", recency(F.col("score"), F.col("updated_at"), now, options.decay_days))
    rank = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("score"), "source_id"))
    return raised.select("question_id", rank.alias("rank"), "source_id", "chunk_id", "v_score", "f_score", "score")
