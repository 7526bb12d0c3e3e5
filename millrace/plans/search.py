"""Hybrid search: two candidate lists, fused, filtered, best per source, boosted by recency, after named records."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import cut_bytes
from ..functions.vectors import cosine
from ..options import SearchOptions
from ..sources.corpus import counted_postings, lexeme_table, ordered, postings

PLACES = 9  # scores are rounded before they are compared, so that ties don't hang on the order of a sum


def vector_hits(chunks: DataFrame, query: list[float], k: int = 50) -> DataFrame:
    """The ``k`` chunks nearest to the query vector: a scan and a top-k for each partition, merged."""
    score = F.round(cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in query])), PLACES)
    return chunks.select("chunk_id", score.alias("v_score")).where("v_score is not null").orderBy(F.desc("v_score"), "chunk_id").limit(k)


def cover_density(found: DataFrame, terms: list[str], *, id_col: str = "chunk_id") -> DataFrame:
    """Rank of every chunk that holds all terms: over minimal covers, 0.1 / (1 + other tokens inside).

    A cover ends at a posting and starts at the earliest of the terms' last postings up to there; of covers with one
    start the shortest is minimal. Windows run within a chunk.
    """
    terms = sorted(set(terms))
    so_far = Window.partitionBy(id_col).orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    last = [F.max(F.when(F.col("term") == t, F.struct("position", "nth"))).over(so_far) for t in terms]
    ends = found.select(id_col, "position", "nth", *[c.alias(f"last_{i}") for i, c in enumerate(last)])
    full = ends.where(" and ".join(f"last_{i} is not null" for i in range(len(terms))))
    start = F.least(*[F.col(f"last_{i}") for i in range(len(terms))]) if len(terms) > 1 else F.col("last_0")
    covers = full.select(
        id_col, start.alias("start"), F.struct("position", "nth").alias("end"),
    ).groupBy(id_col, "start").agg(F.min("end").alias("end"))
    noise = (F.col("end.position") - F.col("start.position")) - (F.col("end.nth") - F.col("start.nth"))
    return covers.groupBy(id_col).agg(F.round(F.sum(F.lit(0.1) / (1 + noise)), PLACES).alias("f_score"))


def text_hits(chunks: DataFrame, terms: list[str], k: int = 50, *, stemmed: bool = False, stored: DataFrame | None = None) -> DataFrame:
    """The ``k`` chunks with the highest cover density of all terms, which are lexemes if ``stemmed``; none for an empty
    query. ``stored`` gives the terms' postings (chunk_id, term, position) where they are kept; else texts are read."""
    if not terms:
        return chunks.select("chunk_id", F.lit(0.0).alias("f_score")).where(F.lit(False))
    if stored is not None:
        found = ordered(stored)
    else:
        found = ordered(lexeme_table(chunks, terms=terms)) if stemmed else postings(chunks, terms)
    return cover_density(found, terms).orderBy(F.desc("f_score"), "chunk_id").limit(k)


def bounded_text_hits(spark: SparkSession, path: str, terms: list[str], k: int = 50) -> DataFrame:
    """What ``text_hits`` gives for lexemes, from counted postings (``sources.corpus.write_counted_postings``), without decoding the positions of
    chunks that cannot be among the ``k``.

    A minimal cover holds the rarest term of its chunk, and at most as many covers as there are terms share one occurrence; so the score is at most
    0.1 x terms x the least count. The chunks with the largest bounds are scored first; of the others only those are read whose counts let
    them reach the k-th score: a filter on counts, which the scan takes.
    """
    terms = sorted(set(terms))
    if not terms:
        return spark.createDataFrame([], "chunk_id long, f_score double")
    most = F.min("count").alias("least")

    def all_terms(least: int) -> DataFrame:
        rows = counted_postings(spark, path, terms, least).select("chunk_id", "term", "count")
        return rows.groupBy("chunk_id").agg(F.count("*").alias("n"), most).where(F.col("n") == len(terms))

    def best(of: DataFrame, least: int) -> DataFrame:
        rows = counted_postings(spark, path, terms, least).join(of.select("chunk_id"), "chunk_id", "left_semi")
        found = ordered(rows.select("chunk_id", "term", F.explode("positions").alias("position")))
        return cover_density(found, terms).orderBy(F.desc("f_score"), "chunk_id").limit(k)

    first = all_terms(1).orderBy(F.desc("least"), "chunk_id").limit(2 * k)
    reached = best(first, 1).agg(F.count("*").alias("n"), F.min("f_score").alias("score")).first()
    least = math.ceil(reached.score / (0.1 * len(terms)) - 1e-6) if reached.n == k else 1
    return best(all_terms(max(1, least)), max(1, least))


def fuse(vector: DataFrame, text: DataFrame, weights: tuple[float, float]) -> DataFrame:
    """Weighted sum over both lists; a chunk missing from one counts 0 there. Text scores are over their maximum.

    The lists have at most ``candidates`` rows, so union and group is all it takes.
    """
    none = F.lit(None).cast("double")
    both = vector.select("chunk_id", "v_score", none.alias("f_score")).unionByName(text.select("chunk_id", none.alias("v_score"), "f_score"))
    one = both.groupBy("chunk_id").agg(F.max("v_score").alias("v_score"), F.max("f_score").alias("f_score"))
    top = F.max("f_score").over(Window.partitionBy())
    score = F.coalesce("v_score", F.lit(0.0)) * weights[0] + F.coalesce(F.col("f_score") / F.nullif(top, F.lit(0.0)), F.lit(0.0)) * weights[1]
    return one.select(
        "chunk_id", F.coalesce("v_score", F.lit(0.0)).alias("v_score"), F.coalesce("f_score", F.lit(0.0)).alias("f_score"),
        F.round(score, PLACES).alias("score"),
    )


def allowed(options: SearchOptions) -> Column:
    """Filters on the joined sources; an empty list filters nothing. They hold after the candidates were cut."""
    keep = F.lit(True)
    if options.source_types:
        keep &= F.col("source_type").isin(*options.source_types)
    if options.projects:
        keep &= F.col("project").isin(*options.projects)
    if options.updated_after:
        keep &= F.col("updated_at") > F.lit(options.updated_after).cast("timestamp_ntz")
    return keep


def best_per_source(scored: DataFrame, key: str = "source_id") -> DataFrame:
    """The row with the highest score of each source, the smaller chunk on ties."""
    w = Window.partitionBy(key).orderBy(F.desc("score"), "chunk_id")
    return scored.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def recency(score: Column, updated: Column, as_of: Column, decay_days: float) -> Column:
    """Up to 5 % for the newest, fading by e in ``decay_days``; a negative score gets more negative."""
    if decay_days <= 0:
        return score
    age = F.greatest(F.lit(0.0), F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(updated.cast("timestamp"))) / F.lit(86400e6)
    return F.round(score * (1 + 0.05 * F.exp(-age / F.lit(float(decay_days)))), PLACES)


def hybrid(
    chunks: DataFrame, sources: DataFrame, query: list[float], terms: list[str], options: SearchOptions, *,
    as_of: Column | None = None, stemmed: bool = False, stored: DataFrame | None = None, vector: DataFrame | None = None,
) -> DataFrame:
    """Ranked hits, one for each source. ``vector`` gives the nearest chunks where an index has them (``sources.vector_index``). ``chunks`` has chunk_id, source_id, embedding, text; ``sources`` source_id,
    updated_at and what the filters name. Only the candidates are joined to chunks and sources. Newer sources are raised,
    as of now unless ``as_of`` says otherwise."""
    text = text_hits(chunks, terms, options.candidates, stemmed=stemmed, stored=stored)
    fused = fuse(vector_hits(chunks, query, options.candidates) if vector is None else vector, text, options.weights())
    of = fused.join(chunks.select("chunk_id", "source_id"), "chunk_id").join(sources, "source_id").where(allowed(options))
    best = best_per_source(of).orderBy(F.desc("score"), "source_id").limit(options.candidates)
    now = F.current_timestamp() if as_of is None else as_of
    raised = best.withColumn("score", recency(F.col("score"), F.col("updated_at"), now, options.decay_days))
    return raised.orderBy(F.desc("score"), "source_id")


def merged(named: DataFrame, ranked: DataFrame, limit: int, key: str = "source_id") -> DataFrame:
    """Named records first in their order, then ranked hits not among them, ``limit`` in all. ``named`` has ``ord``.

    What else ``ranked`` has is null for named records; part is 0 for those and 1 for the rest.
    """
    rest = ranked.join(named.select(key), key, "left_anti").withColumns({"part": F.lit(1), "ord": F.lit(0)})
    first = named.select(key, F.lit(1.0).alias("score"), F.lit(0).alias("part"), "ord")
    return first.unionByName(rest, allowMissingColumns=True).orderBy("part", "ord", F.desc("score"), key).limit(limit)


def context(hits: DataFrame, max_bytes: int = 12000, max_body: int = 4000) -> DataFrame:
    """Entries of a prompt for each ``query_id``, in ``rank`` order while they fit the budget in bytes, numbered from 1.

    An entry is head and snippet, or head and body where there is a body, cut at a whole character, and it still fits. The first entry that
    doesn't fit ends the context. The fold runs inside a row over the at most 50 hits of a query.
    """
    cut = F.when(F.octet_length("body") <= max_body, F.col("body")).otherwise(F.concat(cut_bytes(F.col("body"), max_body), F.lit("\n[truncated]")))
    hit = F.struct("rank", "head", "snippet", F.nullif("body", F.lit("")).alias("body"))
    lists = hits.withColumn("body", cut).groupBy("query_id").agg(F.array_sort(F.collect_list(hit)).alias("hits"))
    start = F.struct(F.lit(0).alias("used"), F.lit(False).alias("full"), F.array().cast("array<string>").alias("entries"))

    def step(state: Column, h: Column) -> Column:
        head = F.concat(F.lit("["), h["rank"].cast("string"), F.lit("] "), h["head"])
        short = F.concat(head, h["snippet"], F.lit("\n\n"))
        long = F.concat(head, h["body"], F.lit("\n\n"))
        entry = F.when(h["body"].isNotNull() & (state["used"] + F.octet_length(long) <= max_bytes), long).otherwise(short)
        full = state["full"] | (state["used"] + F.octet_length(entry) > max_bytes)
        return F.struct(
            F.when(full, state["used"]).otherwise(state["used"] + F.octet_length(entry)).alias("used"), full.alias("full"),
            F.when(full, state["entries"]).otherwise(F.concat(state["entries"], F.array(entry))).alias("entries"),
        )

    folded = lists.select("query_id", F.aggregate("hits", start, step).alias("s"))
    return folded.select("query_id", F.size("s.entries").alias("entries"), F.col("s.used").alias("used"), F.array_join("s.entries", "").alias("context"))
