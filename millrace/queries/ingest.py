"""Loads, feeds, links, deduplication and run bookkeeping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import key_prefix, source_id, split_source_id
from ..operators import feed, loads
from ..sources.corpus import sources, table
from .registry import register

QUERIES: dict = {}
SQL: dict = {}
query = register(QUERIES, SQL)

SPLIT = "2024-01-20 00:00:00"  # events before are stored, later ones come in


@query("SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 2) AS o_totalprice FROM orders WHERE o_orderkey > 1000 ORDER BY o_orderkey LIMIT 500")
def keyset_page(spark: SparkSession, folder: str) -> DataFrame:
    """One page of a keyset walk."""
    page = loads.keyset_page(table(spark, folder, "orders"), "o_orderkey", 1000, 500)
    return page.select("o_orderkey", "o_custkey", "o_orderstatus", F.round("o_totalprice", 2).alias("o_totalprice"))


@query("SELECT doc_id, 'document:' || doc_id || ':' || lang AS id, 'document' AS type, doc_id || ':' || lang AS key FROM documents")
def id_split(spark: SparkSession, folder: str) -> DataFrame:
    """Result ids made and taken apart at the first colon."""
    made = table(spark, folder, "documents").select(
        "doc_id", source_id(F.lit("document"), F.concat_ws(":", F.col("doc_id").cast("string"), "lang")).alias("id"),
    )
    kind, key = split_source_id(F.col("id"))
    return made.select("doc_id", "id", kind.alias("type"), key.alias("key"))


@query("SELECT doc_id AS id, nullif(source, '') AS project, length(text) AS chars, TIMESTAMP '2024-01-01 00:00:00' + to_hours(doc_id) AS updated_at FROM documents WHERE CAST(doc_id AS VARCHAR) = '42'")
def source_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """One source by its natural key."""
    return sources(spark, folder).where("source_key = '42'").select(
        F.col("doc_id").alias("id"), "project", F.length("body").alias("chars"), "updated_at",
    )


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS sha, count(*) AS copies FROM documents GROUP BY sha256(text)")
def sha_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """One document for each content hash."""
    return table(spark, folder, "documents").groupBy(F.sha2("text", 256).alias("sha")).agg(
        F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"),
    ).select("doc_id", "sha", "copies")


def _uploads(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    d = table(spark, folder, "documents").select("doc_id", "source", F.sha2("text", 256).alias("sha"))
    return d.where("source >= 'src5'"), d.where("source < 'src5'")


UPLOADS_SQL = "WITH d AS (SELECT doc_id, source, sha256(text) AS sha FROM documents), n AS (SELECT * FROM d WHERE source >= 'src5'), s AS (SELECT * FROM d WHERE source < 'src5') "


@query(UPLOADS_SQL + "SELECT doc_id, sha FROM n WHERE sha IN (SELECT sha FROM s)")
def sha_existing(spark: SparkSession, folder: str) -> DataFrame:
    """Incoming documents whose content is stored already."""
    return loads.known_and_new(*_uploads(spark, folder))[0].select("doc_id", "sha")


@query(UPLOADS_SQL + "SELECT min(doc_id) AS doc_id, sha FROM n WHERE sha NOT IN (SELECT sha FROM s) GROUP BY sha")
def sha_new(spark: SparkSession, folder: str) -> DataFrame:
    """Incoming documents to process, one of each content."""
    return loads.known_and_new(*_uploads(spark, folder))[1].select("doc_id", "sha")


@query("SELECT o_orderkey, count(l_orderkey) AS children FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def child_count(spark: SparkSession, folder: str) -> DataFrame:
    """Children of each parent, counted before they are joined."""
    n = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return table(spark, folder, "orders").join(n, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.coalesce("n", F.lit(0)).alias("children"))


def _stored_and_incoming(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, folder, "events").select("user_id", "event_id", "ts", "event_type", "value")
    cut = F.lit(SPLIT).cast("timestamp_ntz")
    stored = e.where(F.col("ts") < cut).groupBy("user_id").agg(F.max_by(
        F.struct("event_id", "ts", "event_type", "value"), F.struct("ts", "event_id"),
    ).alias("r")).select("user_id", "r.*")
    return stored, e.where(F.col("ts") >= cut)


@query("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def upsert_sources(spark: SparkSession, folder: str) -> DataFrame:
    """The next version of a table after later records came in: the last one of each key."""
    stored, incoming = _stored_and_incoming(spark, folder)
    return loads.upsert(stored, incoming, ["user_id"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_id", "event_type", "value")


@query("""WITH inc AS (SELECT l_orderkey, l_linenumber, 'new' AS state FROM lineitem WHERE l_returnflag = 'R'), touched AS (SELECT DISTINCT l_orderkey FROM inc)
SELECT l_orderkey, l_linenumber, 'old' AS state FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM touched) UNION ALL SELECT * FROM inc""")
def replace_children(spark: SparkSession, folder: str) -> DataFrame:
    """All children of touched parents replaced by those that came in."""
    li = table(spark, folder, "lineitem")
    new = li.where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", F.lit("new").alias("state"))
    return loads.replace_children(li.select("l_orderkey", "l_linenumber", F.lit("old").alias("state")), new, ["l_orderkey"])


EDGES_SQL = "SELECT 'O-' || l_orderkey AS source_id, ' part ' AS target_type, 'P-' || l_partkey AS target_key, CASE WHEN l_linestatus = 'O' THEN ' needs' ELSE '' END AS kind FROM lineitem"


@query(f"WITH e AS ({EDGES_SQL}) SELECT DISTINCT source_id, trim(target_type) AS target_type, target_key, trim(kind) AS kind FROM e WHERE trim(kind) <> ''")
def replace_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Edges of records: trimmed, blanks dropped, each once."""
    li = table(spark, folder, "lineitem")
    kind = F.when(F.col("l_linestatus") == "O", " needs").otherwise("")
    e = li.select(
        F.concat(F.lit("O-"), F.col("l_orderkey").cast("string")).alias("source_id"), F.lit(" part ").alias("target_type"),
        F.concat(F.lit("P-"), F.col("l_partkey").cast("string")).alias("target_key"), kind.alias("kind"),
    )
    return loads.replace_edges(e.where(F.lit(False)), e)


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F')")
def cascade_delete(spark: SparkSession, folder: str) -> DataFrame:
    """Children that stay when finished parents are deleted."""
    parents = table(spark, folder, "orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return loads.cascade(table(spark, folder, "lineitem"), parents, ["l_orderkey"]).select("l_orderkey", "l_linenumber")


@query(f"SELECT event_id, user_id FROM events WHERE ts >= TIMESTAMP '{SPLIT}' - INTERVAL 60 SECONDS")
def watermark_delta(spark: SparkSession, folder: str) -> DataFrame:
    """Records since the mark, with a minute of slack."""
    return loads.since(table(spark, folder, "events"), F.lit(SPLIT).cast("timestamp_ntz"), time_col="ts").select("event_id", "user_id")


@query(f"SELECT CASE WHEN count(*) FILTER (event_type = 'nope') = 0 AND count(*) > 0 THEN greatest(max(ts), TIMESTAMP '{SPLIT}') END AS next_mark FROM events")
def watermark_next(spark: SparkSession, folder: str) -> DataFrame:
    """The mark after a run without failures."""
    return loads.next_watermark(table(spark, folder, "events"), F.lit(SPLIT).cast("timestamp_ntz"), "ts", F.col("event_type") == "nope")


@query("""SELECT coalesce(event_type, '') AS source, count(*) AS seen, count(*) FILTER (value > 30) AS failed, count(DISTINCT user_id) AS keys, round(sum(value), 2) AS total, max(event_id) AS last_id FROM events GROUP BY 1""")
def run_counters(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of a run, by source."""
    return table(spark, folder, "events").groupBy(F.coalesce("event_type", F.lit("")).alias("source")).agg(
        F.count("*").alias("seen"), F.count_if(F.col("value") > 30).alias("failed"), F.countDistinct("user_id").alias("keys"),
        F.round(F.sum("value"), 2).alias("total"), F.max("event_id").alias("last_id"),
    )


def _feed(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as records of an issue feed; those without title, key or time as they come (short texts, a language)."""
    d = table(spark, folder, "documents")
    key = F.when(F.col("lang") != "es", F.concat(F.upper("source"), F.lit("-"), F.col("doc_id").cast("string"))).otherwise("")
    title = F.when(F.col("n_chars") >= 200, F.concat(F.lit(" T "), F.col("doc_id").cast("string"))).otherwise(" ")
    at = F.when(F.col("source") != "src3", F.lit("2024-03-01T10:00:00Z"))
    item = F.struct(
        key.alias("key"), title.alias("title"), at.alias("updated_at"), F.lit("open").alias("status"),
        F.array(F.struct(
            F.lit("").alias("target_type"), F.concat(F.upper("lang"), F.lit("-1")).alias("target_key"), F.lit(" blocks ").alias("kind"),
        )).alias("links"),
    )
    return d.select("doc_id", F.when(F.col("source") == "src7", F.lit("{broken")).otherwise(F.to_json(item)).alias("json"))


FEED_SQL = """WITH f AS (SELECT doc_id, source = 'src7' AS broken, CASE WHEN lang <> 'es' THEN upper(source) || '-' || doc_id ELSE '' END AS key,
  CASE WHEN n_chars >= 200 THEN 'T ' || doc_id ELSE '' END AS title, source <> 'src3' AS timed, lang FROM documents),
c AS (SELECT *, CASE WHEN broken OR key = '' THEN 'key is required' WHEN title = '' THEN 'title is required' WHEN NOT timed THEN 'updated_at is required' END AS error FROM f) """


@query(FEED_SQL + "SELECT doc_id, key, title, regexp_extract(key, '^(.+)-[^-]*$', 1) AS project, 'jira' AS target_type, upper(lang) || '-1' AS target_key, 'blocks' AS kind, 'open' AS status, '0' AS comment_count FROM c WHERE error IS NULL")
def feed_good(spark: SparkSession, folder: str) -> DataFrame:
    """Normalised records of a feed."""
    good = feed.parsed_issues(_feed(spark, folder)).where("error is null")
    return good.select(
        "doc_id", "key", "title", "project", F.col("links")[0]["target_type"].alias("target_type"),
        F.col("links")[0]["target_key"].alias("target_key"), F.col("links")[0]["kind"].alias("kind"),
        F.col("extra")["status"].alias("status"), F.col("extra")["comment_count"].alias("comment_count"),
    )


@query(FEED_SQL + "SELECT doc_id, error FROM c WHERE error IS NOT NULL")
def feed_bad(spark: SparkSession, folder: str) -> DataFrame:
    """Records of a feed that were refused, with the reason."""
    return feed.parsed_issues(_feed(spark, folder)).where("error is not null").select("doc_id", "error")


@query("""WITH e AS (
  SELECT 'O-' || o_orderkey AS source_id, 'C-' || o_custkey AS target_key, CASE WHEN o_orderstatus = 'F' THEN 'epic' ELSE 'parent' END AS kind FROM orders
  UNION ALL SELECT 'O-' || l_orderkey, 'P-' || l_partkey, 'subtask' FROM lineitem
  UNION ALL SELECT 'O-' || l_orderkey, 'S-' || l_suppkey, 'is_sent_by' FROM lineitem)
SELECT DISTINCT source_id, 'jira' AS target_type, target_key, kind FROM e""")
def link_extract(spark: SparkSession, folder: str) -> DataFrame:
    """Edges of nested records: parent or epic, subtasks, named links."""
    text = lambda p, c: F.concat(F.lit(f"{p}-"), F.col(c).cast("string"))
    li = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(
        F.collect_list(text("P", "l_partkey")).alias("subtasks"),
        F.collect_list(F.struct(
            text("S", "l_suppkey").alias("outward_key"), F.lit(" Is  sent BY ").alias("outward"),
            text("O", "l_orderkey").alias("inward_key"), F.lit("is sent by").alias("inward"),
        )).alias("links"),
    )
    o = table(spark, folder, "orders").join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    issues = o.select(
        text("O", "o_orderkey").alias("key"),
        F.struct(
            text("C", "o_custkey").alias("key"), F.when(F.col("o_orderstatus") == "F", "EPIC").otherwise("Task").alias("issue_type"),
        ).alias("parent"),
        "subtasks", "links",
    )
    return feed.extracted_links(issues)


@query("SELECT o_orderkey, o_custkey, coalesce(c_name, 'customer ' || o_custkey) AS label, c_custkey IS NULL AS dangling FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON o_custkey = c_custkey")
def link_resolve_dangling(spark: SparkSession, folder: str) -> DataFrame:
    """Links resolved to the name of their target, or to a label where it is missing."""
    c = table(spark, folder, "customer").where("c_acctbal > 0").select("c_custkey", "c_name")
    o = table(spark, folder, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left")
    return o.select(
        "o_orderkey", "o_custkey", F.coalesce("c_name", F.concat(F.lit("customer "), F.col("o_custkey").cast("string"))).alias("label"),
        F.col("c_custkey").isNull().alias("dangling"),
    )


@query("SELECT c_custkey, r_name || ' / ' || n_name AS breadcrumb FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def ancestor_breadcrumb(spark: SparkSession, folder: str) -> DataFrame:
    """Titles of a row's ancestors, root first: positions exploded, looked up, gathered in order; missing ones drop out."""
    n = table(spark, folder, "nation")
    region, nation = (lambda k: F.concat(F.lit("r"), k.cast("string"))), (lambda k: F.concat(F.lit("n"), k.cast("string")))
    titles = table(spark, folder, "region").select(
        region(F.col("r_regionkey")).alias("id"), F.col("r_name").alias("title"),
    ).unionByName(n.select(nation(F.col("n_nationkey")).alias("id"), F.col("n_name").alias("title")))
    c = table(spark, folder, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    each = c.select(
        "c_custkey", F.posexplode(F.array(region(F.col("n_regionkey")), nation(F.col("n_nationkey")))).alias("pos", "id"),
    ).join(titles, "id")
    path = F.transform(F.array_sort(F.collect_list(F.struct("pos", "title"))), lambda x: x["title"])
    return each.groupBy("c_custkey").agg(F.array_join(path, " / ").alias("breadcrumb"))


@query("SELECT split_part(o_orderpriority, '-', 1) AS prefix, count(*) AS n FROM orders WHERE split_part(o_orderpriority, '-', 1) IN ('1', '2', '5') GROUP BY 1")
def prefix_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Records of allowed key prefixes, counted by prefix."""
    p = F.split_part("o_orderpriority", F.lit("-"), F.lit(1))
    return table(spark, folder, "orders").where(p.isin("1", "2", "5")).groupBy(p.alias("prefix")).agg(F.count("*").alias("n"))


@query("SELECT user_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS bucket, count(*) AS n FROM events GROUP BY ALL")
def rate_limit_buckets(spark: SparkSession, folder: str) -> DataFrame:
    """Requests of each user in fixed windows."""
    return table(spark, folder, "events").groupBy(
        "user_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("bucket"),
    ).agg(F.count("*").alias("n"))


@query("SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id) <= 3 AS admitted FROM events")
def rate_limit_verdict(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each request is within its user's limit of three a window."""
    from ..streaming.rate_limit import admitted

    return admitted(table(spark, folder, "events"), limit=3, window="day").select("event_id", "user_id", "admitted")


@query("SELECT doc_id, upper(source) || '-' || lang || '-' || doc_id AS key, upper(source) || '-' || lang AS project FROM documents")
def project_of_key(spark: SparkSession, folder: str) -> DataFrame:
    """The project of a key: all before the last hyphen."""
    d = table(spark, folder, "documents").select("doc_id", F.concat_ws("-", F.upper("source"), "lang", F.col("doc_id").cast("string")).alias("key"))
    return d.select("doc_id", "key", key_prefix(F.col("key")).alias("project"))
