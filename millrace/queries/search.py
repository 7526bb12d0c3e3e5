"""Hybrid retrieval over the vectors and the texts of the documents with their numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.english import query_lexemes
from ..functions.text import ticket_keys, tokens
from ..functions.vectors import cosine
from ..options import SearchOptions
from ..plans import questions as many
from ..plans import search as plans
from ..sources.corpus import chunks, postings, sources, stored_postings, table, write_counted_postings, write_postings
from ..sources.vector_index import VectorIndex, write_index
from ..tables import new_folder
from .registry import register

QUERIES: dict = {}
SQL: dict = {}
query = register(QUERIES, SQL)

TERMS = ["the", "of"]
PROJECTS = ("src1", "src2", "src3", "src4", "src5", "src6")
AFTER, AS_OF = "2024-01-03 00:00:00", "2024-06-01 00:00:00"

# The shared beginning of the SQL: sources, chunks, vector list and text list.
CORPUS_SQL = """
src AS (
  SELECT doc_id, 'document' AS source_type, CAST(doc_id AS VARCHAR) AS source_key, nullif(source, '') AS project, lang,
         TIMESTAMP '2024-01-01 00:00:00' + to_hours(doc_id) AS updated_at, text
  FROM documents
), chunk AS (
  SELECT vec_id AS chunk_id, vec_id // 4 * 4 AS source_id, CAST(embedding AS DOUBLE[]) AS e, d.text, d.doc_id
  FROM embeddings JOIN documents d ON vec_id = d.doc_id
), vec AS (
  SELECT chunk_id, round(list_cosine_similarity(e, (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)), 9) AS v_score FROM chunk
), vector_hits AS (
  SELECT * FROM vec ORDER BY v_score DESC, chunk_id LIMIT 50
)"""
TEXT_SQL = """
tok AS (
  SELECT {id}, {term} AS term, position FROM (
    SELECT {id}, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS word,
           unnest(range(len(regexp_extract_all(lower(text), '[a-z0-9]+')))) AS position
    FROM {rows})
), post AS (
  SELECT *, row_number() OVER (PARTITION BY {id} ORDER BY position) AS nth FROM tok WHERE term IN ('the', 'of')
), lasts AS (
  SELECT *, max(CASE WHEN term = 'the' THEN position END) OVER w AS p0, max(CASE WHEN term = 'the' THEN nth END) OVER w AS n0,
         max(CASE WHEN term = 'of' THEN position END) OVER w AS p1, max(CASE WHEN term = 'of' THEN nth END) OVER w AS n1
  FROM post WINDOW w AS (PARTITION BY {id} ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), covers AS (
  SELECT {id}, least(p0, p1) AS ps, least(n0, n1) AS ns, min(position) AS pe, min(nth) AS ne
  FROM lasts WHERE p0 IS NOT NULL AND p1 IS NOT NULL GROUP BY ALL
), fts AS (
  SELECT {id}, round(sum(0.1::DOUBLE / (1 + (pe - ps) - (ne - ns))), 9) AS f_score FROM covers GROUP BY {id}
), fts_hits AS (
  SELECT * FROM fts ORDER BY f_score DESC, {id} LIMIT 50
)"""
HYBRID_SQL = f"""WITH {CORPUS_SQL}, {TEXT_SQL.format(id="chunk_id", rows="chunk", term="word")}, fused AS (
  SELECT coalesce(v.chunk_id, f.chunk_id) AS chunk_id, coalesce(v_score, 0) AS v_score, coalesce(f_score, 0) AS f_score,
         round(coalesce(v_score, 0) * 0.6::DOUBLE + coalesce(f_score / (SELECT max(f_score) FROM fts_hits), 0) * 0.4::DOUBLE, 9) AS score
  FROM vector_hits v FULL JOIN fts_hits f ON v.chunk_id = f.chunk_id
), joined AS (
  SELECT c.source_id, f.*, s.project, s.updated_at
  FROM fused f JOIN chunk c USING (chunk_id) JOIN src s ON s.doc_id = c.source_id
  WHERE {{where}}
), best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, chunk_id) AS n FROM joined)
  WHERE n = 1 ORDER BY score DESC, source_id LIMIT 50
)
"""
OUT_SQL = "SELECT source_id, chunk_id, round(v_score, 6) AS v_score, round(f_score, 6) AS f_score, round(score, 6) AS score FROM best"


def query_vector(spark: SparkSession, folder: str) -> list[float]:
    """The vector with number 0 stands for an embedded question: one row, read by key."""
    return list(table(spark, folder, "embeddings").where("vec_id = 0").first()["embedding"])


def _hits(spark: SparkSession, folder: str, options: SearchOptions, as_of=None) -> DataFrame:
    of = sources(spark, folder).select(F.col("doc_id").alias("source_id"), "source_type", "project", "updated_at")
    return plans.hybrid(chunks(spark, folder), of, query_vector(spark, folder), TERMS, options, as_of=as_of)


def _out(df: DataFrame) -> DataFrame:
    return df.select("source_id", "chunk_id", *[F.round(c, 6).alias(c) for c in ("v_score", "f_score", "score")])


@query(HYBRID_SQL.format(where="true") + OUT_SQL)
def hybrid_search(spark: SparkSession, folder: str) -> DataFrame:
    """The flagship: vector and text candidates fused, the best chunk of each source."""
    return _out(_hits(spark, folder, SearchOptions(decay_days=0)))


@query(HYBRID_SQL.format(where=f"project IN {PROJECTS} AND updated_at > TIMESTAMP '{AFTER}' AND source_type IN ('document')") + OUT_SQL)
def hybrid_filtered(spark: SparkSession, folder: str) -> DataFrame:
    """Filters on source type, project and time, after the candidates are cut."""
    return _out(_hits(spark, folder, SearchOptions(decay_days=0, projects=PROJECTS, updated_after=AFTER, source_types=("document",))))


@query(HYBRID_SQL.format(where="true") + f"SELECT source_id, chunk_id, round(round(score * (1 + 0.05::DOUBLE * exp(-greatest(0, epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(updated_at)) / 86400e6 / 180::DOUBLE)), 9), 6) AS score FROM best")
def hybrid_recency(spark: SparkSession, folder: str) -> DataFrame:
    """The same with newer sources raised by up to 5 %, as of a fixed time."""
    hits = _hits(spark, folder, SearchOptions(), F.lit(AS_OF).cast("timestamp_ntz"))
    return hits.select("source_id", "chunk_id", F.round("score", 6).alias("score"))


@query(f"WITH {CORPUS_SQL} SELECT chunk_id, round(v_score, 6) AS v_score FROM vector_hits")
def vector_top50(spark: SparkSession, folder: str) -> DataFrame:
    """The 50 chunks nearest to a query vector."""
    return plans.vector_hits(chunks(spark, folder), query_vector(spark, folder)).select("chunk_id", F.round("v_score", 6).alias("v_score"))


@query(f"WITH {CORPUS_SQL} SELECT chunk_id, round(v_score, 6) AS v_score FROM vector_hits")
def indexed_top50(spark: SparkSession, folder: str) -> DataFrame:
    """The same from an index, of the lists alone that can hold one of the 50."""
    path = new_folder(spark, "index")
    write_index(chunks(spark, folder), path, lists=16)
    found = VectorIndex.open(spark, path).hits(query_vector(spark, folder))
    return found.select("chunk_id", F.round("v_score", 6).alias("v_score"))


# Vectors that stand for embedded questions: 100 of them, whatever the tables' size. Their terms are two words of seven letters or more.
QUESTIONS_SQL = """WITH chunk AS (
  SELECT vec_id AS chunk_id, vec_id // 4 * 4 AS source_id, CAST(embedding AS DOUBLE[]) AS e, d.text, regexp_extract_all(lower(d.text), '[a-z0-9]+') AS w
  FROM embeddings JOIN documents d ON vec_id = d.doc_id
), q AS (
  SELECT chunk_id AS question_id, e, list_distinct(list_filter(w, lambda x: length(x) >= 7)[1:2]) AS terms FROM chunk WHERE chunk_id % 5 = 0 AND chunk_id < 500
), v AS (
  SELECT question_id, chunk_id, round(list_cosine_similarity(q.e, c.e), 9) AS v_score FROM q CROSS JOIN chunk c
), vtop AS (
  SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY v_score DESC, chunk_id) <= 50
), asked AS (SELECT question_id, unnest(terms) AS term, len(terms) AS m FROM q),
tok AS (SELECT chunk_id, unnest(w) AS term, unnest(range(len(w))) AS position FROM chunk),
post AS (
  SELECT question_id, chunk_id, m, term, position, row_number() OVER (PARTITION BY question_id, chunk_id ORDER BY position) AS nth,
         term = min(term) OVER (PARTITION BY question_id, chunk_id) AS is_a
  FROM tok JOIN asked USING (term)
), lasts AS (
  SELECT *, max(CASE WHEN is_a THEN position END) OVER w AS p0, max(CASE WHEN is_a THEN nth END) OVER w AS n0,
         max(CASE WHEN NOT is_a THEN position END) OVER w AS p1, max(CASE WHEN NOT is_a THEN nth END) OVER w AS n1
  FROM post WINDOW w AS (PARTITION BY question_id, chunk_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), covers AS (
  SELECT question_id, chunk_id, least(p0, p1) AS ps, least(n0, n1) AS ns, min(position) AS pe, min(nth) AS ne
  FROM lasts WHERE p0 IS NOT NULL AND (m = 1 OR p1 IS NOT NULL) GROUP BY ALL
), f AS (
  SELECT question_id, chunk_id, round(sum(0.1::DOUBLE / (1 + (pe - ps) - (ne - ns))), 9) AS f_score FROM covers GROUP BY ALL
), ftop AS (
  SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY f_score DESC, chunk_id) <= 50
), fused AS (
  SELECT question_id, chunk_id, coalesce(v_score, 0) AS v_score, coalesce(f_score, 0) AS f_score,
         round(coalesce(v_score, 0) * 0.6::DOUBLE + coalesce(f_score / max(f_score) OVER (PARTITION BY question_id), 0) * 0.4::DOUBLE, 9) AS score
  FROM vtop FULL JOIN ftop USING (question_id, chunk_id)
), best AS (
  SELECT f.*, c.source_id FROM fused f JOIN chunk c USING (chunk_id) JOIN documents d ON d.doc_id = c.source_id
  QUALIFY row_number() OVER (PARTITION BY question_id, c.source_id ORDER BY score DESC, chunk_id) = 1
)
SELECT question_id, (row_number() OVER (PARTITION BY question_id ORDER BY score DESC, source_id))::INT AS rank, source_id, chunk_id, round(v_score, 6) AS v_score,
  round(f_score, 6) AS f_score, round(score, 6) AS score FROM best QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY score DESC, source_id) <= 50"""


@query(QUESTIONS_SQL)
def hybrid_questions(spark: SparkSession, folder: str) -> DataFrame:
    """Hybrid search for a hundred questions at once."""
    c = chunks(spark, folder)
    long = F.slice(F.filter(tokens(F.col("text")), lambda w: F.length(w) >= 7), 1, 2)
    questions = c.where("chunk_id % 5 = 0 and chunk_id < 500").select(F.col("chunk_id").alias("question_id"), F.col("embedding").alias("vector"), F.array_distinct(long).alias("terms"))
    of = sources(spark, folder).select(F.col("doc_id").alias("source_id"), "source_type", "project", "updated_at")
    hits = many.hybrid(c, of, questions, SearchOptions(decay_days=0))
    return hits.select("question_id", "rank", "source_id", "chunk_id", *[F.round(x, 6).alias(x) for x in ("v_score", "f_score", "score")])


@query(f"WITH {TEXT_SQL.format(id='doc_id', rows='documents', term='word')} SELECT doc_id, round(f_score, 6) AS f_score FROM fts_hits")
def fts_top50(spark: SparkSession, folder: str) -> DataFrame:
    """The 50 documents with the highest cover density of two words."""
    found = plans.cover_density(postings(table(spark, folder, "documents"), TERMS, id_col="doc_id"), TERMS, id_col="doc_id")
    return found.orderBy(F.desc("f_score"), "doc_id").limit(50).select("doc_id", F.round("f_score", 6).alias("f_score"))


#: The words of the tables that have these two lexemes (fixed values).
ERST = ('erst', 'ersted', 'erstedly', 'erstes', 'ersting', 'erstingly', 'erstly', 'erstlyed', 'erstlying')
ERIN = (
    'erin', 'erinated', 'erinates', 'erinating', 'erinator', 'erineable', 'erineant', 'erineation', 'erined', 'erinedly', 'eriner',
    'erinered', 'erinering', 'erinerly', 'erines', 'erining', 'eriningly', 'erinly', 'erinlyed', 'erinlying',
)
LEXEME_SQL = TEXT_SQL.format(id="doc_id", rows="documents", term=f"CASE WHEN word IN {ERST} THEN 'the' WHEN word IN {ERIN} THEN 'of' END")


@query(f"WITH {LEXEME_SQL} SELECT doc_id, round(f_score, 6) AS f_score FROM fts_hits")
def fts_lexemes(spark: SparkSession, folder: str) -> DataFrame:
    """The 50 documents with the highest cover density of two lexemes, from postings stored by lexeme."""
    path = new_folder(spark, "postings")
    d = table(spark, folder, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    write_postings(d, path)
    terms = query_lexemes("the ersted and the erines of erst")
    found = plans.text_hits(d, terms, stemmed=True, stored=stored_postings(spark, path, terms))
    return found.select(F.col("chunk_id").alias("doc_id"), F.round("f_score", 6).alias("f_score"))


@query(f"WITH {LEXEME_SQL} SELECT doc_id, round(f_score, 6) AS f_score FROM fts_hits")
def fts_bounded(spark: SparkSession, folder: str) -> DataFrame:
    """The same from postings with counts, whose bounds leave most chunks unread."""
    path = new_folder(spark, "postings")
    write_counted_postings(table(spark, folder, "documents").select(F.col("doc_id").alias("chunk_id"), "text"), path)
    found = plans.bounded_text_hits(spark, path, query_lexemes("the ersted and the erines of erst"))
    return found.select(F.col("chunk_id").alias("doc_id"), F.round("f_score", 6).alias("f_score"))


@query("WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents) SELECT doc_id FROM t WHERE list_has_all(w, ['the', 'of'])")
def fts_match_all(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold all words of a query."""
    d = table(spark, folder, "documents").select("doc_id", tokens(F.col("text")).alias("w"))
    return d.where(F.forall(F.array(*map(F.lit, TERMS)), lambda t: F.array_contains(F.col("w"), t))).select("doc_id")


@query(f"WITH {TEXT_SQL.format(id='doc_id', rows='documents', term='word')} SELECT doc_id, round(f_score / (SELECT max(f_score) FROM fts), 6) AS share FROM fts")
def score_normalize(spark: SparkSession, folder: str) -> DataFrame:
    """Text scores of all matching documents over the largest, which is a scalar subquery."""
    found = plans.cover_density(postings(table(spark, folder, "documents"), TERMS, id_col="doc_id"), TERMS, id_col="doc_id")
    top = found.agg(F.max("f_score")).scalar()
    return found.select("doc_id", F.round(F.col("f_score") / top, 6).alias("share"))


@query("""WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0), s AS (
  SELECT label AS source_id, vec_id AS chunk_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), q), 9) AS score FROM embeddings, q)
SELECT source_id, chunk_id, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY score DESC, chunk_id) = 1""")
def best_chunk_per_source(spark: SparkSession, folder: str) -> DataFrame:
    """The chunk of each source nearest to a query vector."""
    v = F.array(*[F.lit(float(x)) for x in query_vector(spark, folder)])
    scored = table(spark, folder, "embeddings").select(
        F.col("label").alias("source_id"), F.col("vec_id").alias("chunk_id"),
        F.round(cosine(F.col("embedding"), v), plans.PLACES).alias("score"),
    )
    return plans.best_per_source(scored).select("source_id", "chunk_id", F.round("score", 6).alias("score"))


@query("""WITH f AS (SELECT vec_id AS chunk_id, 1.0::DOUBLE * list_inner_product(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 1)) AS s FROM embeddings)
SELECT chunk_id, round(s, 6) AS score FROM f""")
def vector_only_weights(spark: SparkSession, folder: str) -> DataFrame:
    """Scores with all weight on the vectors (1, 0)."""
    w = SearchOptions(vector_weight=1.0).weights()
    v = table(spark, folder, "embeddings")
    q = F.array(*[F.lit(float(x)) for x in v.where("vec_id = 1").first()["embedding"]])
    from ..functions.vectors import dot

    return v.select(F.col("vec_id").alias("chunk_id"), F.round(dot(F.col("embedding"), q) * w[0], 6).alias("score"))


KEYED_SQL = "SELECT doc_id, 'See ' || upper(source) || '-' || doc_id || ', (' || upper(lang) || '_X-' || n_chars || ') and ' || upper(source) || '-' || doc_id || '; ' || text AS t FROM documents"


def _keyed(spark: SparkSession, folder: str) -> DataFrame:
    s, n, lang = F.upper("source"), F.col("n_chars").cast("string"), F.upper("lang")
    key = F.concat(s, F.lit("-"), F.col("doc_id").cast("string"))
    return table(spark, folder, "documents").select(
        "doc_id",
        F.concat(F.lit("See "), key, F.lit(", ("), lang, F.lit("_X-"), n, F.lit(") and "), key, F.lit("; "), F.col("text")).alias("t"),
    )


@query(f"""WITH d AS ({KEYED_SQL}), k AS (SELECT doc_id, unnest(regexp_extract_all(t, '\\b[A-Z][A-Z0-9_]+-[0-9]+\\b')) AS key, unnest(range(len(regexp_extract_all(t, '\\b[A-Z][A-Z0-9_]+-[0-9]+\\b')))) AS pos FROM d),
u AS (SELECT doc_id, key, min(pos) AS pos FROM k GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM u)
SELECT doc_id, string_agg(key, ',' ORDER BY n) AS keys FROM r WHERE n <= 5 GROUP BY doc_id""")
def named_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Record keys in texts, in order, each once, at most five."""
    return _keyed(spark, folder).select("doc_id", F.array_join(ticket_keys(F.col("t")), ",").alias("keys"))


@query("""WITH q AS (SELECT text FROM documents WHERE doc_id = 3), named AS (
  SELECT doc_id AS source_id, row_number() OVER (ORDER BY doc_id DESC) AS ord FROM documents WHERE doc_id IN (12, 5, 7)),
v AS (SELECT vec_id AS source_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)), 9) AS score FROM embeddings),
r AS (SELECT source_id, score, 1 AS part, 0 AS ord FROM (SELECT * FROM v ORDER BY score DESC, source_id LIMIT 50) WHERE source_id NOT IN (SELECT source_id FROM named)),
a AS (SELECT source_id, 1.0::DOUBLE AS score, 0 AS part, ord FROM named UNION ALL SELECT * FROM r)
SELECT source_id, round(score, 6) AS score FROM a ORDER BY part, ord, score DESC, source_id LIMIT 10""")
def shortcut_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Records named by key first with score 1, then vector hits not among them, ten in all."""
    d = table(spark, folder, "documents")
    named = d.where(F.col("doc_id").isin(12, 5, 7)).select(
        F.col("doc_id").alias("source_id"), F.row_number().over(Window.orderBy(F.desc("doc_id"))).alias("ord"),
    )
    e = table(spark, folder, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    ranked = plans.vector_hits(e, query_vector(spark, folder)).select(F.col("chunk_id").alias("source_id"), F.col("v_score").alias("score"))
    return plans.merged(named, ranked, 10).select("source_id", F.round("score", 6).alias("score"))


@query("SELECT DISTINCT source AS project FROM documents WHERE source IS NOT NULL AND source <> ''")
def autocomplete_projects(spark: SparkSession, folder: str) -> DataFrame:
    """Projects to choose from."""
    return sources(spark, folder).where("project is not null").select("project").distinct().orderBy("project")
