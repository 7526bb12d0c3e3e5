"""Loads as a whole: records of a feed become sources, chunks, edges and a new mark.

Every function takes what came in and what is stored and returns the next version of each table, as plans over both;
nothing is gathered. A caller writes them, in batch or for each batch of a stream (``streaming.sync``).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import key_prefix, parsed_time, source_id, title_of
from ..options import ChunkOptions
from ..sources.feeds import ancestors
from ..tables import materialize
from . import chunking, loads
from .embed import embed
from .feed import extracted_links, issue_body
from .markup import storage_markdown, tree_markdown, trees_markdown
from .page_links import resolved

SOURCES = "source_id string, source_type string, source_key string, project string, title string, url string, body string, updated_at timestamp, extra variant"
CHUNKS = "source_id string, chunk_index int, text string, token_count int, chunk_kind string, embedding array<float>"
EDGES = "source_id string, target_type string, target_key string, kind string"
STATE = "source_type string, mark timestamp"
#: The fields of a tracker's issue that are read; rich text stays JSON.
TRACKER = """key string, fields struct<summary:string, description:string, updated:string, status:struct<name:string>,
issuetype:struct<name:string>, project:struct<key:string>, labels:array<string>, assignee:struct<displayName:string>,
comment:struct<comments:array<struct<id:string, author:struct<displayName:string>, created:string, body:string>>>,
parent:struct<key:string, fields:struct<issuetype:struct<name:string>>>, subtasks:array<struct<key:string>>,
issuelinks:array<struct<type:struct<inward:string, outward:string>, inwardIssue:struct<key:string>, outwardIssue:struct<key:string>>>>"""
UPLOAD = "id string, title string, filename string, project string, url string, text string, updated_at string"
DOCUMENT = "key string, title string, content string, url string, updated_at string, extra variant"
ATTRIBUTES = "map<string,variant>"


@dataclass(frozen=True)
class Tables:
    """The stored tables of a corpus."""

    sources: DataFrame
    chunks: DataFrame
    edges: DataFrame
    state: DataFrame

    @staticmethod
    def empty(spark) -> Tables:
        return Tables(*(spark.createDataFrame([], s) for s in (SOURCES, CHUNKS, EDGES, STATE)))


@dataclass(frozen=True)
class Increment:
    """What a load adds: whole sources, and the chunks and edges that take the place of all those of these sources."""

    sources: DataFrame
    chunks: DataFrame
    edges: DataFrame

    def over(self, stored: Tables, state: DataFrame | None = None) -> Tables:
        """The next version of each table."""
        return Tables(
            loads.upsert(stored.sources, self.sources, ["source_id"], [F.col("updated_at"), F.col("title")]),
            loads.replace_children(stored.chunks, self.chunks, ["source_id"], self.sources),
            loads.replace_edges(stored.edges, self.edges, self.sources),
            stored.state if state is None else state,
        )


@dataclass(frozen=True)
class Chunker:
    """How texts are cut and embedded."""

    embedder: Callable[[list[str]], list]
    dimension: int
    options: ChunkOptions = ChunkOptions()
    encoder: chunking.Encoder = chunking.WORDS

    def rows(self, chunks: DataFrame) -> DataFrame:
        with_vectors = embed(chunks.withColumnRenamed("content", "text"), self.embedder, dimension=self.dimension)
        return with_vectors.select("source_id", "chunk_index", "text", "token_count", "chunk_kind", "embedding")


def attributes(given: Column | None, defaults: dict[str, Column]) -> Column:
    """Open attributes as one variant: what is given, and defaults for the rest, without null ones."""
    have = F.coalesce(given.cast(ATTRIBUTES), F.create_map().cast(ATTRIBUTES)) if given is not None else F.create_map().cast(ATTRIBUTES)
    more = F.create_map(*[x for k, v in defaults.items() for x in (F.lit(k), v.cast("variant"))])
    return F.to_variant_object(F.map_concat(have, F.map_filter(more, lambda k, v: v.isNotNull() & ~F.map_contains_key(have, k))))


def attribute(name: str, extra: str = "extra") -> Column:
    """A text among open attributes; null where there is none of this name."""
    return F.try_variant_get(extra, f"$.{name}", "string")


def normalized_issues(raw: DataFrame, base_url: str, json_col: str = "json") -> DataFrame:
    """Issues as a tracker gives them, normalised: rich text as markdown, comments without an author by ``unknown`` and
    without a time that can't be read, status, type, number of comments, labels and assignee in extra. ``error`` is null for
    good rows."""
    i = raw.withColumn("_i", F.from_json(json_col, TRACKER, {"mode": "PERMISSIVE"}))
    f = lambda name: F.col(f"_i.fields.{name}")
    trimmed = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"\n+\z", "")
    key, title, at = F.coalesce(F.trim("_i.key"), F.lit("")), F.coalesce(F.trim(f("summary")), F.lit("")), parsed_time(f("updated"))
    said = F.coalesce(f("comment.comments"), F.array().cast("array<struct<id:string,author:struct<displayName:string>,created:string,body:string>>"))
    i = i.withColumns({"_said": said, "_bodies": trees_markdown(F.transform(said, lambda c: c["body"])), "_text": tree_markdown(f("description"))})

    def comment(c: Column, n: Column) -> Column:
        author = F.coalesce(F.nullif(c["author"]["displayName"], F.lit("")), F.lit("unknown"))
        return F.struct(author.alias("author"), c["created"].alias("created_at"), trimmed(F.get("_bodies", n)).alias("body"))

    labels = F.filter(f("labels"), lambda x: x.isNotNull())
    extra = attributes(None, {
        "status": F.coalesce(f("status.name"), F.lit("")), "issue_type": F.coalesce(f("issuetype.name"), F.lit("")),
        "comment_count": F.size("_said"), "labels": F.when(F.size(labels) > 0, labels), "assignee": f("assignee.displayName"),
    })
    error = F.when(key == "", "key is required").when(title == "", "title is required").when(at.isNull(), "updated is required")
    parent = F.struct(f("parent.key").alias("key"), f("parent.fields.issuetype.name").alias("issue_type"))
    links = F.transform(f("issuelinks"), lambda x: F.struct(
        x["outwardIssue"]["key"].alias("outward_key"), x["type"]["outward"].alias("outward"),
        x["inwardIssue"]["key"].alias("inward_key"), x["type"]["inward"].alias("inward")))
    return i.select(
        *raw.columns, key.alias("key"), title.alias("title"), F.coalesce(f("project.key"), key_prefix(key)).alias("project"),
        F.concat(F.lit(base_url.rstrip("/") + "/browse/"), key).alias("url"), at.alias("updated_at"), extra.alias("extra"),
        trimmed(F.col("_text")).alias("description"), F.transform("_said", comment).alias("comments"),
        parent.alias("parent"), F.transform(f("subtasks"), lambda s: s["key"]).alias("subtasks"), links.alias("links"), error.alias("error"),
    )


def _next_state(stored: DataFrame, kind: str, rows: DataFrame, started: Column, failed: Column | None = None) -> DataFrame:
    """The marks after a run: that of ``kind`` moves to the latest time processed, and stays if the run failed or was empty."""
    new = loads.next_watermark(rows, started, failed=failed).where("next_mark is not null").select(
        F.lit(kind).alias("source_type"), F.col("next_mark").alias("mark"),
    )
    return loads.upsert(stored, new, ["source_type"], [F.col("mark")])


def _latest(rows: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    return loads.upsert(rows.limit(0), rows, keys, [F.col("updated_at"), *more, F.col("title")])


def issue_increment(issues: DataFrame, chunker: Chunker) -> Increment:
    """Good issues of ``normalized_issues``, the last of each key: chunked by head and comments, relations as edges.

    They are written once in between, as all three tables read them.
    """
    good = _latest(issues.where("error is null"), ["key"]).withColumn("source_id", source_id(F.lit("jira"), F.col("key")))
    good = materialize(good.select("source_id", "key", "project", "title", "url", "description", "comments", "parent", "subtasks", "links", "updated_at", "extra"), "issues")
    sources = good.select(
        "source_id", F.lit("jira").alias("source_type"), F.col("key").alias("source_key"), "project", "title", "url",
        issue_body(F.col("description"), F.col("comments")).alias("body"), "updated_at", "extra",
    )
    cut = chunking.issue_chunks(good, chunker.options, encoder=chunker.encoder)
    chunks = chunker.rows(cut.withColumn("source_id", source_id(F.lit("jira"), F.col("key"))).drop("key"))
    return Increment(sources, chunks, extracted_links(good).withColumn("source_id", source_id(F.lit("jira"), F.col("source_id"))))


def ingest_issues(issues: DataFrame, stored: Tables, chunker: Chunker, *, started: Column) -> Tables:
    """The tables after a load of issues. A bad row stops the mark, not the load."""
    state = _next_state(stored.state, "jira", issues, started, F.col("error").isNotNull())
    return issue_increment(issues, chunker).over(stored, state)


def normalized_pages(pages: DataFrame, base_url: str, stored: DataFrame | None = None) -> DataFrame:
    """Pages (id, title, space, parent_id, storage, version, updated_at) with their markdown under a heading of the title and
    the titles of their ancestors; marks of links to pages are still open.

    Ancestors are looked for among these pages and those of ``stored`` (sources) that didn't come in: ids and parents alone are joined.
    """
    tree = pages.select("id", "title", "parent_id")
    if stored is not None:
        old = stored.where("source_type = 'confluence'").select(F.col("source_key").alias("id"), "title", attribute("parent_id").alias("parent_id"))
        tree = materialize(tree.unionByName(old.join(pages.select("id"), "id", "left_anti")), "tree")
    chain = ancestors(tree).join(pages.select("id"), "id", "left_semi").select("id", F.posexplode("path").alias("pos", "above"))
    titles = tree.select(F.col("id").alias("above"), F.col("title").alias("above_title"))
    path = F.transform(F.array_sort(F.collect_list(F.struct("pos", "above_title"))), lambda x: x["above_title"])
    crumbs = chain.join(titles, "above").groupBy("id").agg(path.alias("breadcrumb"))
    text = F.regexp_replace(F.coalesce(storage_markdown(F.col("storage")), F.lit("")), r"\n+\z", "")
    head = F.concat(
        F.lit("# "), "title", F.lit("\n\n"),
        F.when(F.col("breadcrumb").isNotNull(), F.concat(F.lit("_"), F.array_join("breadcrumb", " / "), F.lit("_\n\n"))).otherwise(""),
    )
    url = F.concat(F.lit(base_url.rstrip("/") + "/spaces/"), "space", F.lit("/pages/"), F.col("id").cast("string"))
    extra = attributes(None, {"parent_id": F.coalesce(F.col("parent_id").cast("string"), F.lit("")), "version": F.col("version"), "breadcrumb": F.col("breadcrumb")})
    return pages.join(crumbs, "id", "left").select(
        "id", "title", "space", url.alias("url"), "updated_at", F.concat(head, text, F.lit("\n")).alias("body"), extra.alias("extra"),
    )


def page_increment(pages: DataFrame, sources: DataFrame, chunker: Chunker, *, base_url: str) -> Increment:
    """Pages in two passes: all are normalised, their ancestors found among them and the stored sources, and written; then their marks
    are resolved against both. A page without a time of update has that of its load."""
    text = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    last = _latest(pages.withColumns({"id": text("id"), "parent_id": text("parent_id")}).where("id is not null"), ["id"], F.col("version"))
    last = last.withColumn("updated_at", F.coalesce("updated_at", F.current_timestamp()))
    fresh = materialize(normalized_pages(last, base_url, sources), "pages")
    known = fresh.select(F.col("id").alias("number"), "space", "title", "url")
    old = sources.where("source_type = 'confluence'").select(
        F.col("source_key").alias("number"), F.col("project").alias("space"), "title", "url",
    )
    links = known.unionByName(old.join(known.select("number"), "number", "left_anti"))
    done = materialize(resolved(fresh, links, id_col="id"), "resolved")
    new = done.select(
        source_id(F.lit("confluence"), F.col("id")).alias("source_id"), F.lit("confluence").alias("source_type"), F.col("id").alias("source_key"),
        F.col("space").alias("project"), "title", "url", "body", "updated_at", "extra",
    )
    chunks = chunker.rows(chunking.page_chunks(new, chunker.options, encoder=chunker.encoder, id_col="source_id"))
    return Increment(new, chunks, new.sparkSession.createDataFrame([], EDGES))


def ingest_pages(pages: DataFrame, stored: Tables, chunker: Chunker, *, base_url: str, started: Column) -> Tables:
    """The tables after a load of pages."""
    state = _next_state(stored.state, "confluence", pages, started)
    return page_increment(pages, stored.sources, chunker, base_url=base_url).over(stored, state)


def document_feed(feed: DataFrame, json_col: str = "json") -> DataFrame:
    """Documents that callers keep under keys of their own, and ``error``, null for good rows: key, title, content and time of
    update are required. Open attributes are kept, with the way of extraction, the origin and the content's hash where they lack them."""
    d = feed.withColumn("_d", F.from_json(json_col, DOCUMENT, {"mode": "PERMISSIVE"}))
    blank = lambda c: F.coalesce(F.regexp_replace(c, r"\A\s+|\s+\z", ""), F.lit(""))
    at = parsed_time(F.col("_d.updated_at"))
    error = F.when(blank("_d.key") == "", "key is required").when(blank("_d.title") == "", "title is required").when(
        blank("_d.content") == "", "content is required").when(at.isNull(), "updated_at is required")
    extra = attributes(F.col("_d.extra"), {"extraction_method": F.lit("markdown"), "source": F.lit("ingest_api"), "content_sha256": F.sha2("_d.content", 256)})
    return d.select(
        *feed.columns, blank("_d.key").alias("key"), blank("_d.title").alias("title"), F.col("_d.content").alias("text"), F.coalesce("_d.url", F.lit("")).alias("url"),
        at.alias("updated_at"), extra.alias("extra"), error.alias("error"),
    )


def document_increment(documents: DataFrame, chunker: Chunker) -> Increment:
    """Good documents of ``document_feed``, the last of each key."""
    last = materialize(_latest(documents.where("error is null"), ["key"]), "documents")
    sources = last.select(
        source_id(F.lit("document"), F.col("key")).alias("source_id"), F.lit("document").alias("source_type"), F.col("key").alias("source_key"),
        F.lit(None).cast("string").alias("project"), "title", "url", F.col("text").alias("body"), "updated_at", "extra",
    )
    chunks = chunker.rows(chunking.document_chunks(sources, chunker.options, encoder=chunker.encoder, id_col="source_id"))
    return Increment(sources, chunks, sources.sparkSession.createDataFrame([], EDGES))


def ingest_documents(documents: DataFrame, stored: Tables, chunker: Chunker) -> Tables:
    """The tables after a load of documents: each takes the place of what is stored under its key."""
    return document_increment(documents, chunker).over(stored)


def upload_feed(feed: DataFrame, json_col: str = "json") -> DataFrame:
    """Uploaded texts with their hash, and ``error``, null for good rows: an id and a text are required; a title is
    derived where none is given."""
    d = feed.withColumn("_d", F.from_json(json_col, UPLOAD, {"mode": "PERMISSIVE"}))
    blank = lambda c: F.coalesce(F.trim(c), F.lit(""))
    error = F.when(blank("_d.id") == "", "id is required").when(blank("_d.text") == "", "text is required")
    title = F.when(blank("_d.title") != "", F.trim("_d.title")).otherwise(title_of(
        F.col("_d.text"), F.coalesce("_d.filename", "_d.id"), F.lit("text"),
    ))
    return d.select(
        *feed.columns, F.trim("_d.id").alias("id"), title.alias("title"), F.nullif(blank("_d.project"), F.lit("")).alias("project"),
        F.col("_d.url").alias("url"), F.col("_d.text").alias("text"), parsed_time(F.col("_d.updated_at")).alias("updated_at"),
        F.sha2("_d.text", 256).alias("sha"), error.alias("error"),
    )


def upload_increment(uploads: DataFrame, sources: DataFrame, chunker: Chunker, *, now: Column) -> Increment:
    """Good texts of ``upload_feed``: of each content that isn't stored yet one, under its hash as key."""
    have = sources.where("source_type = 'document'").select(F.col("source_key").alias("sha"))
    new = materialize(loads.known_and_new(uploads.where("error is null").select("sha", "id", "title", "project", "url", "text", "updated_at"), have)[1], "uploads")
    key = F.substring("sha", 1, 32)
    rows = new.select(
        source_id(F.lit("document"), F.col("sha")).alias("source_id"), F.lit("document").alias("source_type"), F.col("sha").alias("source_key"),
        "project", "title", F.coalesce("url", F.concat(F.lit("document/"), key)).alias("url"), F.col("text").alias("body"), F.coalesce("updated_at", now).alias("updated_at"),
        attributes(None, {"extraction_method": F.lit("text"), "source": F.lit("upload"), "content_sha256": F.col("sha")}).alias("extra"),
    )
    chunks = chunker.rows(chunking.document_chunks(rows, chunker.options, encoder=chunker.encoder, id_col="source_id"))
    return Increment(rows, chunks, rows.sparkSession.createDataFrame([], EDGES))


def ingest_uploads(uploads: DataFrame, stored: Tables, chunker: Chunker, *, now: Column) -> Tables:
    """The tables after a load of uploaded texts."""
    return upload_increment(uploads, stored.sources, chunker, now=now).over(stored)


def rechunked(stored: Tables, chunker: Chunker, source_types: tuple[str, ...] = ("document",)) -> Tables:
    """The chunks of documents, and of pages if asked for, cut and embedded anew from the stored bodies, with other options or a
    new model. Issues are cut by their comments, which bodies don't tell apart: they have to be loaded again."""
    if not set(source_types) <= {"document", "confluence"}:
        raise ValueError("documents and pages can be cut anew from their bodies")
    sources = stored.sources.where(F.col("source_type").isin(*source_types))
    paged = chunking.page_chunks(sources.where("source_type = 'confluence'"), chunker.options, encoder=chunker.encoder, id_col="source_id")
    whole = chunking.document_chunks(sources.where("source_type = 'document'"), chunker.options, encoder=chunker.encoder, id_col="source_id")
    chunks = chunker.rows(paged.unionByName(whole))
    return Tables(stored.sources, loads.replace_children(stored.chunks, chunks, ["source_id"], sources), stored.edges, stored.state)
