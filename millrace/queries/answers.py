"""Contexts, conversations, chunks and conversions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import meta_line, titled
from ..operators import chunking, records
from ..operators.convert import html_text
from ..options import ChunkOptions
from ..plans.search import context
from ..sources.corpus import sources, table
from .registry import register

QUERIES: dict = {}
SQL: dict = {}
query = register(QUERIES, SQL)


@query("SELECT conv_id, max(turn) AS last_turn, count(*) AS messages, arg_min(substr(text, 1, 80), turn) FILTER (role = 'user') AS title FROM conversations WHERE role IN ('user', 'assistant') GROUP BY conv_id")
def conversation_list(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations with their title, the beginning of the first question."""
    m = table(spark, folder, "conversations").where(F.col("role").isin("user", "assistant"))
    first = F.min_by(F.substring("text", 1, 80), F.when(F.col("role") == "user", F.col("turn")))
    asked = F.count_if(F.col("role") == "user") > 0
    return m.groupBy("conv_id").agg(F.max("turn").alias("last_turn"), F.count("*").alias("messages"), F.when(asked, first).alias("title"))


@query("SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS position FROM conversations WHERE role IN ('user', 'assistant')")
def conversation_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Messages of each conversation, oldest first."""
    m = table(spark, folder, "conversations").where(F.col("role").isin("user", "assistant"))
    return m.select("conv_id", "turn", "role", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role")).alias("position"))


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS thread FROM events GROUP BY user_id")
def active_thread(spark: SparkSession, folder: str) -> DataFrame:
    """The newest thread of each user."""
    return table(spark, folder, "events").groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("thread"))


@query("SELECT o_orderkey, CASE WHEN o_custkey = 7 THEN 'renamed' ELSE o_orderpriority END AS title FROM orders")
def guarded_rename(spark: SparkSession, folder: str) -> DataFrame:
    """A new title only for rows of one owner."""
    o = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("owner"), F.col("o_orderpriority").alias("title"),
    )
    blank = records.owned(o, F.lit(8)).withColumn("title", F.lit(" "))
    changes = o.withColumn("owner", F.lit(7).cast(o.schema["owner"].dataType)).withColumn("title", F.lit(" renamed ")).unionByName(blank)
    return records.renamed(o, changes).select(F.col("id").alias("o_orderkey"), "title")


@query("""WITH m AS (SELECT conv_id, turn, TIMESTAMP '2024-01-01' + to_hours(turn) AS told FROM conversations),
c AS (SELECT conv_id, max(told) AS last FROM m WHERE turn < 2 GROUP BY 1)
SELECT c.conv_id, greatest(c.last, max(m.told)) AS updated_at, count(*) AS messages FROM c JOIN m USING (conv_id) GROUP BY c.conv_id, c.last""")
def conversation_append(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations after more messages came in: their time moves to that of the last."""
    at = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(turn as int))")
    m = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text", at.alias("created_at"))
    stored = m.where("turn < 2")
    known = stored.groupBy("conv_id").agg(F.max("created_at").alias("updated_at"))
    moved, messages = records.append_messages(known, stored, m.where("turn >= 2"))
    return moved.join(messages.groupBy("conv_id").agg(F.count("*").alias("messages")), "conv_id")


CONTEXT_SQL = r"""WITH RECURSIVE h AS (
  SELECT source AS query_id, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS rank, text, doc_id, lang FROM documents
), l AS (SELECT query_id, CAST(rank AS INTEGER) AS rank, '[' || rank || '] ' || CASE WHEN lang = 'fr' THEN '(untitled)' ELSE 'Doc ' || doc_id END || ' — u/' || doc_id || chr(10) || 'Status: ' || lang || chr(10) AS head, substr(text, 1, 300) AS snippet, CASE WHEN lang = 'de' THEN text ELSE '' END AS body FROM h WHERE rank <= 50
), e AS (SELECT query_id, rank, head || snippet || chr(10) || chr(10) AS short, CASE WHEN body <> '' THEN head || CASE WHEN strlen(body) <= 500 THEN body ELSE left(body, list_max(list_filter(range(497 // 4, 501), lambda n: strlen(left(body, n)) <= 500))) || chr(10) || '[truncated]' END || chr(10) || chr(10) END AS long FROM l
), f AS (
  SELECT query_id, 0 AS rank, 0::BIGINT AS used, 0::BIGINT AS entries, '' AS context FROM (SELECT DISTINCT query_id FROM e)
  UNION ALL
  SELECT f.query_id, e.rank, f.used + strlen(x.entry), f.entries + 1, f.context || x.entry
  FROM f JOIN e ON e.query_id = f.query_id AND e.rank = f.rank + 1,
       LATERAL (SELECT CASE WHEN e.long IS NOT NULL AND f.used + strlen(e.long) <= 3000 THEN e.long ELSE e.short END AS entry) x
  WHERE f.used + strlen(x.entry) <= 3000
)
SELECT query_id, max(entries)::INTEGER AS entries, max(used)::INTEGER AS used, md5(arg_max(context, rank)) AS context_md5 FROM f GROUP BY query_id"""


@query(CONTEXT_SQL)
def context_assembly(spark: SparkSession, folder: str) -> DataFrame:
    """A prompt's context for each site: the shortest documents in rank order while they fit 3000 bytes."""
    s = sources(spark, folder).join(table(spark, folder, "documents").select("doc_id", "n_chars", F.col("source").alias("query_id")), "doc_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("n_chars", "doc_id"))
    number = F.col("doc_id").cast("string")
    title = F.when(F.col("lang") == "fr", " ").otherwise(F.concat(F.lit("Doc "), number))
    head = F.concat(
        titled(title), F.lit(" — u/"), number, F.lit("\n"),
        meta_line(F.col("lang"), F.lit(None).cast("string"), F.lit(""), F.lit(None).cast("timestamp_ntz")),
    )
    hits = s.select(
        "query_id", rank.alias("rank"), head.alias("head"), F.substring("body", 1, 300).alias("snippet"),
        F.when(F.col("lang") == "de", F.col("body")).otherwise("").alias("body"),
    ).where("rank <= 50")
    return context(hits, 3000, 500).select("query_id", "entries", "used", F.md5("context").alias("context_md5"))


def _marked_up(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as pages: each line a paragraph, a heading before the second."""
    d = table(spark, folder, "documents")
    body = F.concat(F.regexp_replace("text", "\n", "\n\n"), F.lit("\n\n## End of "), F.col("doc_id").cast("string"), F.lit("\nlast words"))
    return d.select("doc_id", F.concat(F.lit("Doc "), F.col("doc_id").cast("string")).alias("title"), body.alias("body"))


@query("""WITH d AS (SELECT doc_id, regexp_replace(text, chr(10), chr(10) || chr(10), 'g') AS a, '## End of ' || doc_id || chr(10) || 'last words' AS b FROM documents),
s AS (SELECT doc_id, 0 AS n, regexp_replace(a, '\\n+$', '') AS section FROM d WHERE regexp_replace(a, '\\s', '', 'g') <> '' UNION ALL SELECT doc_id, 1, b FROM d)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS section_index, md5(section) AS section_md5 FROM s""")
def heading_sections(spark: SparkSession, folder: str) -> DataFrame:
    """Sections of pages at their headings."""
    s = _marked_up(spark, folder).select("doc_id", F.posexplode(chunking.sections(F.col("body"))).alias("section_index", "section"))
    return s.select("doc_id", "section_index", F.md5("section").alias("section_md5"))


@query("""WITH p AS (SELECT doc_id, unnest(string_split_regex(text, '\\n\\s*\\n|\\n')) AS x FROM documents)
SELECT doc_id, count(*) AS paragraphs, sum(length(x))::BIGINT AS chars FROM (SELECT doc_id, regexp_replace(x, '^\\s+|\\s+$', '', 'g') AS x FROM p) WHERE x <> '' GROUP BY doc_id""")
def paragraph_split(spark: SparkSession, folder: str) -> DataFrame:
    """Paragraphs of texts whose lines stand apart."""
    p = table(spark, folder, "documents").select("doc_id", F.explode(chunking.paragraphs(F.regexp_replace("text", "\n", "\n\n"))).alias("x"))
    return p.groupBy("doc_id").agg(F.count("*").alias("paragraphs"), F.sum(F.length("x")).alias("chars"))


WORDS_SQL = "regexp_extract_all({}, '[^ \\t\\n\\x0B\\f\\r]+')"
STRIP_SQL = "trim({}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
#: Texts (id, part, text): paragraphs, of those over 200 words the sentences, of those over it runs of 200; packed one by one, a chunk that is full
#: giving its last 20 words to the next. A text that fits is one chunk.
PACKED_SQL = f"""para AS (
  SELECT id, part, text, {STRIP_SQL.format("unnest(string_split_regex(text, '\\n[ \\t\\n\\r\\x0B\\f]*\\n'))")} AS p, generate_subscripts(string_split_regex(text, '\\n[ \\t\\n\\r\\x0B\\f]*\\n'), 1) AS i FROM texts
), sentence AS (
  SELECT id, part, i, 0 AS j, p AS s FROM para WHERE len({WORDS_SQL.format("p")}) <= 200
  UNION ALL SELECT id, part, i, generate_subscripts(x, 1), {STRIP_SQL.format("unnest(x)")} FROM (
    SELECT id, part, i, string_split(regexp_replace(p, '([.?!][)\\]"'']*)[ \\n\\t]', '\\1' || chr(1), 'g'), chr(1)) AS x FROM para WHERE len({WORDS_SQL.format("p")}) > 200)
), run AS (
  SELECT id, part, i, j, 0 AS k, s FROM sentence WHERE s <> '' AND len({WORDS_SQL.format("s")}) <= 200
  UNION ALL SELECT id, part, i, j, k, array_to_string(w[k * 200 + 1 : k * 200 + 200], ' ') FROM (
    SELECT id, part, i, j, w, unnest(range((len(w) + 199) // 200)) AS k FROM (SELECT *, {WORDS_SQL.format("s")} AS w FROM sentence) WHERE len(w) > 200)
), unit AS (
  SELECT id, part, s, len({WORDS_SQL.format("s")}) AS n, row_number() OVER (PARTITION BY id, part ORDER BY i, j, k) AS u FROM run
), fold AS (
  SELECT id, part, u, s AS held, n AS size, NULL::VARCHAR AS done FROM unit WHERE u = 1
  UNION ALL
  SELECT f.id, f.part, x.u, CASE WHEN f.size + x.n + 2 > 200 THEN array_to_string(({WORDS_SQL.format("f.held")})[-20:], ' ') || chr(10) || chr(10) || x.s ELSE f.held || chr(10) || chr(10) || x.s END,
         CASE WHEN f.size + x.n + 2 > 200 THEN least(20, len({WORDS_SQL.format("f.held")})) + x.n ELSE f.size + x.n END, CASE WHEN f.size + x.n + 2 > 200 THEN f.held END
  FROM fold f JOIN unit x ON x.id = f.id AND x.part = f.part AND x.u = f.u + 1
), packed AS (
  SELECT id, part, u, done AS content FROM fold WHERE done IS NOT NULL
  UNION ALL SELECT id, part, u + 1, held FROM fold QUALIFY u = max(u) OVER (PARTITION BY id, part)
), chunk AS (
  SELECT id, part, 0 AS u, text AS content FROM texts WHERE len({WORDS_SQL.format("text")}) <= 200 AND {STRIP_SQL.format("text")} <> ''
  UNION ALL SELECT packed.* FROM packed JOIN texts USING (id, part) WHERE len({WORDS_SQL.format("text")}) > 200
)
SELECT id AS doc_id, (row_number() OVER (PARTITION BY id ORDER BY part, u) - 1)::INT AS chunk_index, content, len({WORDS_SQL.format("content")})::INT AS token_count, 'section' AS chunk_kind FROM chunk"""
MARKED_UP_SQL = "replace(text, chr(10), chr(10) || chr(10)) || chr(10) || chr(10) || '## End of ' || doc_id || chr(10) || 'last words'"


@query(f"""WITH RECURSIVE texts AS (SELECT doc_id AS id, 0 AS part, '# Doc ' || doc_id || chr(10) || chr(10) || {STRIP_SQL.format(MARKED_UP_SQL)} AS text FROM documents WHERE text IS NOT NULL), {PACKED_SQL}""")
def chunk_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of all documents within 200 tokens, 20 of overlap."""
    return chunking.document_chunks(_marked_up(spark, folder), ChunkOptions(200, 20))


@query(f"""WITH RECURSIVE cut AS (
  SELECT doc_id, string_split(regexp_replace({MARKED_UP_SQL}, '(?m)^(#{{1,3}}[ \\t\\n\\r\\x0B\\f]+.)', chr(1) || '\\1', 'g'), chr(1)) AS x FROM documents WHERE text IS NOT NULL
), texts AS (
  SELECT doc_id AS id, generate_subscripts(x, 1) AS part, rtrim(unnest(x), chr(10)) AS text FROM cut
), {PACKED_SQL}""")
def chunk_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of all documents as pages, by section."""
    return chunking.page_chunks(_marked_up(spark, folder), ChunkOptions(200, 20))


#: Units (head, then comments) fill a chunk of 120 words whole or, where one doesn't fit, word by word in new chunks that begin with the last 15 words of the one before.
ISSUE_CHUNKS_SQL = f"""WITH RECURSIVE m AS (SELECT conv_id AS id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS u FROM conversations),
unit AS (
  SELECT id, u, CASE WHEN u = 1 THEN 'body' ELSE 'comment' END AS kind, t, {WORDS_SQL.format("t")} AS w FROM (
    SELECT id, u, CASE WHEN u = 1 THEN '# Conversation (C-' || id || ')' || chr(10) || chr(10) || CASE WHEN text <> '' THEN rtrim(text, chr(10)) || chr(10) ELSE '' END
      ELSE chr(10) || chr(10) || '## Comment by ' || role || chr(10) || chr(10) || rtrim(text, chr(10)) END AS t FROM m)
), fold AS (
  SELECT id, 1::BIGINT AS u, 0::BIGINT AS off, false AS cutting, '' AS cur, 0::BIGINT AS size, 'body' AS kind, NULL::VARCHAR AS done, NULL::VARCHAR AS done_kind, 0::BIGINT AS step FROM (SELECT DISTINCT id FROM m)
  UNION ALL
  SELECT id, CASE WHEN fits OR (cutting AND NOT turns AND take = n) THEN u + 1 ELSE u END, CASE WHEN cutting AND NOT turns AND take < n THEN off + take WHEN turns THEN off ELSE 0 END,
    CASE WHEN fits THEN false WHEN turns THEN true ELSE take < n END,
    CASE WHEN fits THEN cur || t WHEN turns THEN array_to_string(last, ' ') WHEN cur = '' THEN array_to_string(rem[1:take], ' ') ELSE cur || ' ' || array_to_string(rem[1:take], ' ') END,
    CASE WHEN fits THEN size + n WHEN turns THEN len(last) ELSE size + take END, CASE WHEN turns THEN unit_kind ELSE kind END,
    CASE WHEN turns AND cur <> '' THEN ltrim(cur, chr(10)) END, CASE WHEN turns AND cur <> '' THEN kind END, step + 1
  FROM (
    SELECT *, NOT cutting AND size + n <= 120 AS fits, (NOT cutting AND size + n > 120) OR (cutting AND size >= 120) AS turns, least(120 - size, n) AS take FROM (
      SELECT f.*, x.kind AS unit_kind, x.t, x.w[f.off + 1 :] AS rem, len(x.w) - f.off AS n, ({WORDS_SQL.format("f.cur")})[-15:] AS last FROM fold f JOIN unit x ON x.id = f.id AND x.u = f.u))
), made AS (
  SELECT id, step, done AS content, done_kind AS chunk_kind FROM fold WHERE done IS NOT NULL
  UNION ALL SELECT id, step + 1, ltrim(cur, chr(10)), kind FROM fold WHERE cur <> '' QUALIFY step = max(step) OVER (PARTITION BY id)
)
SELECT 'C-' || id AS key, (row_number() OVER (PARTITION BY id ORDER BY step) - 1)::INT AS chunk_index, content, len({WORDS_SQL.format("content")})::INT AS token_count, chunk_kind FROM made"""


@query(ISSUE_CHUNKS_SQL)
def chunk_issues(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of conversations as issues: the first message is the description, the others comments; an issue is one row with
    all of its comments, as in a feed."""
    m = table(spark, folder, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    said = F.transform(
        F.slice("m", 2, F.size("m")),
        lambda x: F.struct(x["role"].alias("author"), F.lit(None).cast("string").alias("created_at"), x["text"].alias("body")),
    )
    issues = m.select(
        F.concat(F.lit("C-"), F.col("conv_id").cast("string")).alias("key"), F.lit("Conversation").alias("title"),
        F.col("m")[0]["text"].alias("description"), F.when(F.size("m") > 1, said).alias("comments"),
    )
    return chunking.issue_chunks(issues, ChunkOptions(120, 15))


#: The given pages have one body with list items, a heading, paragraphs (some open until the next) and loose text in other elements.
HTML_SQL = r"""WITH b AS (
  SELECT page_id, trim(regexp_extract(html, '<title>(.*?)</title>', 1, 's')) AS title,
    regexp_replace(regexp_replace(regexp_extract(html, '<body>(.*?)(</body>|$)', 1, 's'), '<!--.*?-->', '', 'gs'), '</?(a|b|br)( [^>]*)?>', '', 'g') AS body FROM pages
), parts AS (
  SELECT page_id, title, unnest(string_split(body, '<p>')) AS part, generate_subscripts(string_split(body, '<p>'), 1) AS n FROM b
), cut AS (
  SELECT *, CASE WHEN n = 1 THEN '' ELSE regexp_extract(part, '^([^<]*)', 1) END AS para, CASE WHEN n = 1 THEN part ELSE regexp_replace(part, '^[^<]*', '') END AS rest FROM parts
), pieces AS (
  SELECT page_id, title, n, para, unnest(regexp_extract_all(rest, '<(?:h1|li)>[^<]*|<[^>]*>[^<]*')) AS piece, generate_subscripts(regexp_extract_all(rest, '<(?:h1|li)>[^<]*|<[^>]*>[^<]*'), 1) AS k FROM cut
), told AS (
  SELECT page_id, n, string_agg(CASE WHEN piece LIKE '<h1>%' THEN chr(10) || chr(10) || '# ' || trim(substr(piece, 5)) || chr(10) || chr(10)
    WHEN piece LIKE '<li>%' THEN '- ' || trim(substr(piece, 5)) || chr(10)
    WHEN trim(regexp_replace(piece, '^<[^>]*>', ''), ' ' || chr(10)) <> '' THEN trim(regexp_replace(piece, '^<[^>]*>', ''), ' ' || chr(10)) || ' ' ELSE '' END, '' ORDER BY k) AS said
  FROM pieces GROUP BY page_id, n
), whole AS (
  SELECT c.page_id, any_value(c.title) AS title, string_agg(CASE WHEN c.n > 1 THEN chr(10) || chr(10) || trim(c.para, ' ' || chr(10)) || chr(10) || chr(10) ELSE '' END || coalesce(said, ''), '' ORDER BY c.n) AS text
  FROM cut c LEFT JOIN told USING (page_id, n) GROUP BY c.page_id
)
SELECT page_id, trim(replace(replace(replace(replace(CASE WHEN title <> '' THEN '# ' || title || chr(10) || chr(10) ELSE '' END || text, '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), ' ' || chr(10)) || chr(10) AS text FROM whole"""


@query(HTML_SQL)
def html_to_text(spark: SparkSession, folder: str) -> DataFrame:
    """Readable text of all pages."""
    return table(spark, folder, "pages").select("page_id", html_text(F.col("html")).alias("text"))
