"""Runs of a load against a stored corpus: read the mark, take what is since, store four tables and what failed, move the mark."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import asdict, dataclass
from datetime import UTC, datetime, timedelta

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.text import source_id
from ..sources.remote import refetched
from ..sources.store import Change, Snapshot, Store, Table
from ..tables import materialize, scratch
from . import ingest, loads
from .feed import extracted_links

REJECTED = "source_id string, source_type string, error string, record string, run long"
TABLES = {
    "sources": Table(ingest.SOURCES, "source_id"), "chunks": Table(ingest.CHUNKS, "source_id"), "edges": Table(ingest.EDGES, "source_id"),
    "state": Table(ingest.STATE, "source_type"), "rejected": Table(REJECTED, "source_id"),
}
#: What a scan takes again before its mark, for clocks that differ, and the age from which an empty run's mark is called stale.
SLACK, STALE = timedelta(minutes=1), timedelta(hours=6)


@dataclass(frozen=True)
class Report:
    """What a run has done. ``mark`` holds after it; ``stale``: nothing came, and the mark is old. ``number`` is the snapshot."""

    fetched: int = 0
    sources: int = 0
    chunks: int = 0
    embeddings: int = 0
    links: int = 0
    failed: int = 0
    skipped: int = 0
    notes: tuple[str, ...] = ()
    mark: datetime | None = None
    stale: bool = False
    number: int = 0


def open_store(spark: SparkSession, folder: str, buckets: int = 64) -> Store:
    return Store(spark, folder, TABLES, buckets)


def tables(store: Store, at: Snapshot | None = None) -> ingest.Tables:
    """The four tables of one snapshot."""
    at = at or store.snapshot()
    return ingest.Tables(*(store.read(n, at) for n in ("sources", "chunks", "edges", "state")))


def mark_of(store: Store, kind: str, at: Snapshot) -> datetime | None:
    row = store.lookup("state", kind, at).select(F.unix_micros("mark").alias("us")).first()
    return row and datetime.fromtimestamp(0, UTC) + timedelta(microseconds=row.us)


def counted(df: DataFrame, name: str, **counts: Column) -> tuple[DataFrame, dict]:
    """A frame written once, and counts of its rows taken while they are written."""
    rows, observation = seen(df, name, **counts)
    return materialize(rows, name), observation.get


def _micros(at: datetime | None) -> datetime | None:
    return at and datetime.fromtimestamp(0, UTC) + timedelta(microseconds=at)


def seen(df: DataFrame, name: str, **counts: Column) -> tuple[DataFrame, Observation]:
    """A frame whose rows are counted when it is written."""
    observation = Observation(name)
    return df.observe(observation, F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in counts.items()]), observation


def _taken(observation: Observation) -> dict:
    """What was counted; nothing where the frame is empty by its plan, which then leaves out the counts as well."""
    try:
        return observation.get
    except Py4JJavaError:
        return Counter()


def _run(
    store: Store, kind: str, now: datetime, scan: Callable[[datetime | None], DataFrame], normalized: Callable[[DataFrame], DataFrame],
    increment: Callable[[DataFrame, DataFrame], ingest.Increment],
) -> Report:
    """``normalized`` gives key, updated_at, note, ``error`` and, where that isn't null, the ``record``."""
    base = store.snapshot()
    mark = mark_of(store, kind, base)
    at, noted = F.unix_micros("updated_at"), F.col("note").isNotNull()
    with scratch(store.spark):
        came, n = counted(
            normalized(scan(mark - SLACK if mark else None)), "came", failed=F.count_if(~noted & F.col("error").isNotNull()), noted=F.count("note"),
            last=F.max(F.when(~noted, at)), bound=F.min(F.when(noted, at)),
        )
        notes = tuple(sorted(r.note for r in came.where(noted).select("note").distinct().limit(20).collect()))
        fetched = n["n"] - n["noted"]
        if not fetched:  # an empty run moves nothing
            return Report(notes=notes, mark=mark, stale=mark is not None and now - mark > STALE, number=base.number)
        good, bad = came.where(~noted & F.col("error").isNull()), came.where(~noted & F.col("error").isNotNull())
        new = increment(good.drop("error", "note", "record"), store.read("sources", base))
        rejected = bad.select(
            F.concat(F.lit(f"{kind}:"), F.coalesce(F.nullif("key", F.lit("")), F.sha2("record", 256))).alias("source_id"), F.lit(kind).alias("source_type"), "error",
            "record", F.lit(base.number + 1).cast("long").alias("run"),
        ).dropDuplicates(["source_id"])
        ids = new.sources.select("source_id")
        sources, of_sources = seen(new.sources, "sources")
        chunks, of_chunks = seen(new.chunks, "chunks", embeddings=F.count("embedding"))
        edges, of_edges = seen(loads.replace_edges(new.edges.limit(0), new.edges), "edges")
        changes = {
            "sources": Change(sources, ids), "chunks": Change(chunks, ids), "edges": Change(edges, ids),
            "rejected": Change(rejected, ids.unionByName(rejected.select("source_id"))),
        }
        last, bound = _micros(n["last"]), _micros(n["bound"])
        moved = mark if n["failed"] else max(filter(None, (bound, mark)), default=None) if n["noted"] else max(filter(None, (last, now)))
        if moved != mark:
            changes["state"] = Change(store.spark.createDataFrame([(kind, moved)], "source_type string, mark timestamp"))

        def report() -> dict:
            s, c, e = _taken(of_sources)["n"], _taken(of_chunks), _taken(of_edges)["n"]
            return asdict(Report(fetched, s, c["n"], c["embeddings"], e, n["failed"], fetched - n["failed"] - s, notes, moved, False, base.number + 1))

        if ids.limit(1).count() == 0:  # nothing was good: only what was rejected is kept
            store.commit(base, {"rejected": changes["rejected"]}, asdict(Report(fetched, failed=n["failed"], notes=notes, mark=mark, number=base.number + 1)))
            return Report(fetched, failed=n["failed"], notes=notes, mark=mark, number=base.number + 1)
        return Report(**store.commit(base, changes, report).report)


def sync_issues(store: Store, scan: Callable[[datetime | None], DataFrame], chunker: ingest.Chunker, *, base_url: str, now: datetime) -> Report:
    """One run over a tracker's issues. ``scan`` gives the records (json, note) from a time on (``sources.remote``), or all for None.

    Four tables, rejected records and the mark change together or not at all, so a run that dies can be run again; so can one that
    didn't, to the same end. The mark moves to the latest time taken, or to the run's start if that is later; rejected records
    keep it, a note (a cap or a stale token ended the scan) moves it as far as that scan came. A record that is loaded leaves the rejected ones.
    """
    def normalized(raw: DataFrame) -> DataFrame:
        rows = ingest.normalized_issues(raw.select("json", "note", F.col("updated_at").alias("read_to")), base_url)
        at = F.when(F.col("note").isNotNull(), F.col("read_to")).otherwise(F.col("updated_at"))
        return rows.withColumns({"updated_at": at, "record": F.when(F.col("error").isNotNull(), F.col("json"))}).drop("json", "read_to")

    return _run(store, "jira", now, scan, normalized, lambda rows, _: ingest.issue_increment(rows.withColumn("error", F.lit(None).cast("string")), chunker))


def sync_pages(store: Store, scan: Callable[[datetime | None], DataFrame], chunker: ingest.Chunker, *, base_url: str, now: datetime) -> Report:
    """One run over a wiki's pages, as ``sync_issues``; a page without id or title is rejected."""
    def normalized(raw: DataFrame) -> DataFrame:
        blank = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""
        error = F.when(blank("id"), "id is required").when(blank("title"), "title is required")
        record = F.to_json(F.struct("id", "title", "space", "parent_id", "storage", "version", "updated_at"))
        return raw.withColumns({"key": F.col("id").cast("string"), "error": error, "record": F.when(error.isNotNull(), record)})

    return _run(store, "confluence", now, scan, normalized, lambda rows, sources: ingest.page_increment(rows.drop("key"), sources, chunker, base_url=base_url))


def load_documents(store: Store, feed: DataFrame, chunker: ingest.Chunker, *, now: datetime) -> Report:
    """One run over a feed of documents (json) that callers keep under their own keys; the mark doesn't matter here."""
    def normalized(raw: DataFrame) -> DataFrame:
        rows = ingest.document_feed(raw.select("json"))
        return rows.withColumns({"note": F.lit(None).cast("string"), "record": F.when(F.col("error").isNotNull(), F.col("json"))}).drop("json")

    return _run(store, "document", now, lambda _: feed, normalized, lambda rows, _: ingest.document_increment(rows.withColumn("error", F.lit(None).cast("string")), chunker))


def rebuild_links(store: Store, options: dict[str, str]) -> Report:
    """The edges of all stored issues from their records as they are now; nothing is cut or embedded again. Records that are gone are
    skipped and keep their edges, as do those that fail."""
    base = store.snapshot()
    keys = store.read("sources", base).where("source_type = 'jira'").select(F.col("source_key").alias("key"))
    own = lambda c: source_id(F.lit("jira"), F.col(c))
    with scratch(store.spark):
        got, n = counted(refetched(keys, options), "refetched", missing=F.count_if(F.col("state") == "missing"))
        whole = ingest.normalized_issues(got.where("state = 'found'").select("json"), "").where("error is null")
        touched, of_touched = counted(whole.select(own("key").alias("source_id")), "touched")
        counts = {"fetched": n["n"], "sources": of_touched["n"], "skipped": n["missing"], "failed": n["n"] - n["missing"] - of_touched["n"]}
        if not of_touched["n"]:
            return Report(**counts, number=base.number)
        found = extracted_links(whole).withColumn("source_id", own("source_id"))
        edges, of_edges = seen(loads.replace_edges(found.limit(0), found), "edges")
        done = store.commit(base, {"edges": Change(edges, touched)}, lambda: asdict(Report(**counts, links=_taken(of_edges)["n"], number=base.number + 1)))
        return Report(**done.report)
