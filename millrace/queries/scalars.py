"""Scalar functions over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as fn
from ..functions import vectors
from ..operators import records
from ..sources.corpus import table
from .registry import register

QUERIES: dict = {}
SQL: dict = {}
query = register(QUERIES, SQL)

AS_OF = "2024-01-31 00:00:00"


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, json_extract_string(props, '$.none') AS missing FROM events")
def json_path(spark: SparkSession, folder: str) -> DataFrame:
    """Fields of JSON objects."""
    return table(spark, folder, "events").select(
        "event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.get_json_object("props", "$.none").alias("missing"),
    )


@query("""SELECT event_id, date_trunc('second', ts) AS a, date_trunc('millisecond', ts) AS b, date_trunc('second', ts) - INTERVAL 2 HOURS AS c, CAST(NULL AS TIMESTAMP) AS d FROM events""")
def parse_time(spark: SparkSession, folder: str) -> DataFrame:
    """Timestamps in four layouts, and one in none."""
    e = table(spark, folder, "events").withColumn("t", F.col("ts").cast("timestamp"))
    of = lambda pattern, tail: fn.parsed_time(F.concat(F.date_format("t", pattern), F.lit(tail))).cast("timestamp_ntz")
    return e.select(
        "event_id", of("yyyy-MM-dd'T'HH:mm:ss", "+0000").alias("a"), of("yyyy-MM-dd'T'HH:mm:ss.SSS", "+0000").alias("b"),
        of("yyyy-MM-dd'T'HH:mm:ss", "+02:00").alias("c"), of("dd/MM/yyyy", "").alias("d"),
    )


@query("SELECT doc_id, md5('m|' || text) AS embedding_key, sha256(text) AS sha, substr(sha256(text), 1, 8) AS short FROM documents")
def hash_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Cache keys and content hashes."""
    key = F.substring_index(vectors.cache_key("", "m", F.col("text")), ":", -1)
    return table(spark, folder, "documents").select(
        "doc_id", key.alias("embedding_key"), F.sha2("text", 256).alias("sha"), F.substring(F.sha2("text", 256), 1, 8).alias("short"),
    )


@query(f"""WITH s AS (SELECT event_id, ts, epoch(TIMESTAMP '{AS_OF}')::BIGINT - floor(epoch(ts))::BIGINT AS s FROM events)
SELECT event_id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN (s // 60) || 'm ago' WHEN s < 86400 THEN (s // 3600) || 'h ago' WHEN s < 2592000 THEN (s // 86400) || 'd ago'
  ELSE strftime(ts, '%b %-d, %Y') END AS age FROM s""")
def relative_age(spark: SparkSession, folder: str) -> DataFrame:
    """How long ago, in words."""
    return table(spark, folder, "events").select("event_id", fn.relative_age(F.col("ts"), F.lit(AS_OF).cast("timestamp_ntz")).alias("age"))


@query("""WITH d AS (SELECT doc_id, (n_chars * n_chars)::BIGINT AS n FROM documents)
SELECT doc_id, CASE WHEN n = 0 THEN '-' WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KB', n / 1024.0::DOUBLE) WHEN n < 1073741824 THEN printf('%.1f MB', n / 1048576.0::DOUBLE) ELSE printf('%.1f GB', n / 1073741824.0::DOUBLE) END AS size FROM d""")
def human_bytes(spark: SparkSession, folder: str) -> DataFrame:
    """Sizes with units."""
    return table(spark, folder, "documents").select("doc_id", fn.human_bytes(F.col("n_chars") * F.col("n_chars")).alias("size"))


@query("SELECT o_orderkey, regexp_replace(lower(trim('  ' || o_orderpriority || '  by  X ')), '\\s+', '_', 'g') AS kind FROM orders")
def link_kind(spark: SparkSession, folder: str) -> DataFrame:
    """Canonical link kinds."""
    return table(spark, folder, "orders").select(
        "o_orderkey", fn.link_kind(F.concat(F.lit("  "), F.col("o_orderpriority"), F.lit("  by  X "))).alias("kind"),
    )


@query("""SELECT doc_id, CASE WHEN strlen(t) <= 80 THEN t ELSE left(t, list_max(list_filter(range(81), lambda n: strlen(left(t, n)) <= 80))) || '…' END AS short
FROM (SELECT doc_id, trim(text) AS t FROM documents)""")
def truncate_text(spark: SparkSession, folder: str) -> DataFrame:
    """Texts cut with an ellipsis."""
    return table(spark, folder, "documents").select("doc_id", fn.truncated(F.col("text"), 80).alias("short"))


@query("""SELECT page_id, replace(replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&#34;'), '''', '&#39;') AS escaped,
  regexp_replace('a <mark>' || url || '</mark>', '</?mark>', '', 'g') AS plain, replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '<mark>x</mark>&lt;b&gt;' AS marked FROM pages""")
def escape_and_marks(spark: SparkSession, folder: str) -> DataFrame:
    """Escaped text, text without highlight tags, and text with only those."""
    url = F.col("url")
    return table(spark, folder, "pages").select(
        "page_id", fn.html_escaped(url).alias("escaped"), fn.strip_marks(F.concat(F.lit("a <mark>"), url, F.lit("</mark>"))).alias("plain"),
        fn.only_marks(F.concat(url, F.lit("<mark>x</mark><b>"))).alias("marked"),
    )


@query("""SELECT page_id, CAST(page_id AS VARCHAR) AS number, CASE WHEN page_id % 2 = 0 THEN 'https://h/wiki/pages/' || page_id || '/t' ELSE 'https://h/x' END AS link FROM pages WHERE page_id % 2 = 0
UNION ALL SELECT page_id, NULL, 'https://h/x' FROM pages WHERE page_id % 2 <> 0""")
def url_page_id(spark: SparkSession, folder: str) -> DataFrame:
    """Links built, and the page number read back."""
    p = table(spark, folder, "pages").select(
        "page_id",
        F.when(
            F.col("page_id") % 2 == 0, F.concat(F.lit("https://h/wiki/pages/"), F.col("page_id").cast("string"), F.lit("/t")),
        ).otherwise("https://h/x").alias("link"),
    )
    return p.select("page_id", fn.page_number(F.col("link")).alias("number"), "link")


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'text/html; charset=utf-8' WHEN 'O' THEN '' ELSE 'image/png' END AS content_type,
  CASE o_orderstatus WHEN 'F' THEN 'html' WHEN 'O' THEN (CASE WHEN o_orderpriority LIKE '1%' THEN 'pdf' WHEN o_orderpriority LIKE '2%' THEN 'markdown' ELSE NULL END) END AS kind FROM orders""")
def sniff_kind(spark: SparkSession, folder: str) -> DataFrame:
    """Document kinds from type or extension."""
    o = table(spark, folder, "orders")
    ct = F.when(F.col("o_orderstatus") == "F", "text/html; charset=utf-8").when(F.col("o_orderstatus") == "O", "").otherwise("image/png")
    name = F.when(F.col("o_orderpriority").startswith("1"), "a/b.PDF").when(F.col("o_orderpriority").startswith("2"), "x.y.md").otherwise("noext")
    return o.select("o_orderkey", ct.alias("content_type"), fn.document_kind(ct, name).alias("kind"))


@query("SELECT doc_id, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS letters, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) < 10 * 20 AS scanned FROM documents")
def scanned_test(spark: SparkSession, folder: str) -> DataFrame:
    """Texts of twenty pages that look scanned."""
    return table(spark, folder, "documents").select(
        "doc_id", F.length(F.regexp_replace("text", "[^A-Za-z]", "")).alias("letters"),
        fn.looks_scanned(F.col("text"), F.lit(20)).alias("scanned"),
    )


@query("""WITH l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
f AS (SELECT doc_id, arg_min(trim(line), n) AS line FROM l WHERE trim(line) <> '' GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.lang = 'de' THEN 'T' || d.doc_id ELSE coalesce(left(f.line, list_max(list_filter(range(201), lambda n: strlen(left(f.line, n)) <= 200))), 'file ' || d.doc_id) END AS title FROM documents d LEFT JOIN f USING (doc_id)""")
def derive_title(spark: SparkSession, folder: str) -> DataFrame:
    """Titles of documents: a heading where the kind has headings, else the first line, else the file's stem."""
    d, number = table(spark, folder, "documents"), F.col("doc_id").cast("string")
    kind = F.when(F.col("lang") == "de", "markdown").otherwise("text")
    body = F.when(kind == "markdown", F.concat(F.col("text"), F.lit("\n#   T"), number, F.lit("  \n## no"))).otherwise(F.col("text"))
    return d.select("doc_id", fn.title_of(body, F.concat(F.lit("up/file "), number, F.lit(".txt")), kind).alias("title"))


@query("SELECT user_id, event_id, CASE WHEN event_type = 'click' THEN NULL ELSE 't' || user_id END AS token, CASE WHEN event_type = 'view' THEN NULL ELSE 'k/' || event_id END AS key, 'a__' || event_id AS name FROM events")
def tokens_and_names(spark: SparkSession, folder: str) -> DataFrame:
    """Bearer tokens of headers, object keys, and file names made safe."""
    e = table(spark, folder, "events")
    user, number = F.col("user_id").cast("string"), F.col("event_id").cast("string")
    header = F.when(F.col("event_type") == "click", F.concat(F.lit("Basic t"), user)).otherwise(F.concat(F.lit(" bearer  t"), user))
    key = F.when(F.col("event_type") == "view", F.concat(F.lit("../k/"), number)).otherwise(F.concat(F.lit(" /k/"), number))
    return e.select(
        "user_id", "event_id", fn.bearer_token(header).alias("token"), fn.blob_key(key).alias("key"),
        fn.safe_filename(F.concat(F.lit('a"\n'), number)).alias("name"),
    )


@query("""SELECT c_custkey, sha256('tok_' || c_name) AS hash, substr(sha256('tok_' || c_name), 1, 8) AS prefix,
  CASE WHEN c_custkey % 5 = 0 THEN TIMESTAMP '2024-01-01' WHEN c_acctbal < 0 THEN TIMESTAMP '2024-06-01' END AS revoked_at, u.used AS last_used_at
FROM customer LEFT JOIN (SELECT o_custkey, max(CAST(o_orderdate AS TIMESTAMP)) AS used FROM orders GROUP BY 1) u ON u.o_custkey = c_custkey""")
def access_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Stored tokens: only hashes; revoked once, an earlier time stays; the time of the last use."""
    none = F.lit(None).cast("timestamp_ntz")
    before = F.when(F.col("c_custkey") % 5 == 0, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    c = table(spark, folder, "customer").withColumn("id", F.col("c_custkey"))
    tokens = c.select("id", F.sha2(F.concat(F.lit("tok_"), F.col("c_name")), 256).alias("hash"), before.alias("revoked_at"), none.alias("last_used_at"))
    done = records.revoked(tokens, c.where("c_acctbal < 0"), F.lit("2024-06-01 00:00:00").cast("timestamp_ntz"))
    uses = table(spark, folder, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderdate").cast("timestamp_ntz").alias("used_at"))
    done = records.touched(done, uses)
    return done.select(F.col("id").alias("c_custkey"), "hash", F.substring("hash", 1, 8).alias("prefix"), "revoked_at", "last_used_at")


@query("""WITH h AS (SELECT sha256('tok_' || c_name) AS hash FROM customer), p AS (SELECT DISTINCT substr(sha256(n_name), 1, 2) AS prefix FROM nation)
SELECT prefix, min(hash) AS hash FROM p JOIN h ON starts_with(hash, prefix) GROUP BY prefix HAVING count(*) = 1
UNION ALL SELECT substr(hash, 1, 12), hash FROM h""")
def unique_prefix(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens found by the beginning of their hash, where only one has it."""
    h = table(spark, folder, "customer").select(F.sha2(F.concat(F.lit("tok_"), F.col("c_name")), 256).alias("hash"))
    asked = table(spark, folder, "nation").select(F.substring(F.sha2("n_name", 256), 1, 2).alias("prefix"))
    return records.by_unique_prefix(h, asked.unionByName(h.select(F.substring("hash", 1, 12).alias("prefix"))), key="hash")


@query("""SELECT doc_id, '<p>' || lang || ' &lt;b&gt; <strong>bold</strong> and <em>thin</em><br><code>x</code> <sup><a href="#cite-1">[1]</a></sup> [^9]</p>'
  || chr(10) || '<pre><code>a &lt; ' || doc_id || '</code></pre>' || chr(10) AS html FROM documents""")
def light_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """Answers as HTML: escaped, with code, bold, italics and links to the citations there are."""
    text = F.concat(F.col("lang"), F.lit(" <b> **bold** and *thin*\n`x` [^1] [^9]\n\n```py\na < "), F.col("doc_id").cast("string"), F.lit("\n```\n"))
    return table(spark, folder, "documents").select("doc_id", fn.light_html(text, 3).alias("html"))


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE sha256('tok_' || c_name) IN (SELECT sha256('tok_' || c_name) FROM customer WHERE c_acctbal >= 0 AND c_mktsegment = 'BUILDING')")
def token_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Owners of presented tokens that aren't revoked: an equi join on hashes."""
    c = table(spark, folder, "customer").select(
        "c_custkey", "c_mktsegment", "c_acctbal", F.sha2(F.concat(F.lit("tok_"), F.col("c_name")), 256).alias("hash"),
    )
    return c.join(c.where("c_acctbal >= 0 and c_mktsegment = 'BUILDING'").select("hash"), "hash", "left_semi").select("c_custkey", "c_mktsegment")


@query("SELECT vec_id, len(embedding) = 64 AS usable, round(sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 5) AS norm FROM embeddings")
def vector_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Dimension and norm of stored vectors."""
    e = table(spark, folder, "embeddings")
    return e.select(
        "vec_id", vectors.right_dimension(F.col("embedding"), 64).alias("usable"),
        F.round(F.sqrt(vectors.dot(F.col("embedding"), F.col("embedding"))), 5).alias("norm"),
    )


@query("SELECT doc_id, 'Status: ' || lang || CASE WHEN source <> '' THEN ' | Type: ' || source ELSE '' END || ' | Updated: ' || strftime(TIMESTAMP '2024-01-01 00:00:00' + to_hours(doc_id), '%Y-%m-%d') || chr(10) AS meta FROM documents")
def metadata_line(spark: SparkSession, folder: str) -> DataFrame:
    """The line of facts below a title."""
    from ..sources.corpus import sources

    s = sources(spark, folder)
    return s.select("doc_id", fn.meta_line(F.col("lang"), F.col("project"), F.lit(""), F.col("updated_at")).alias("meta"))
