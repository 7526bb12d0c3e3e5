"""The stored corpus and the runs that load it."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from millrace.operators import ingest, runs
from millrace.operators.embed import hash_batch
from millrace.options import ChunkOptions
from millrace.sources.store import Change, Conflict, Store, Table, Version

UTC = dt.UTC
NOW = dt.datetime(2024, 5, 1, tzinfo=UTC)
CHUNKER = ingest.Chunker(lambda texts: hash_batch(texts, 4), 4, ChunkOptions(50, 5))
ISSUE = "key string, project string, updated_at timestamp, json string, note string"


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store", {"t": Table("k string, v int, extra variant", "k")}, buckets=8)


def rows(spark, values):
    return spark.createDataFrame([(k, v) for k, v in values], "k string, v int").withColumn("extra", F.parse_json(F.concat(F.lit('{"v":'), F.col("v"), F.lit("}"))))


def held(store, at=None):
    return {r.k: r.v for r in store.read("t", at).collect()}


def test_only_touched_buckets_are_rewritten(spark, store):
    first = store.commit(store.snapshot(), {"t": Change(rows(spark, [(f"k{i}", i) for i in range(100)]))})
    assert first.number == 1 and set(first.tables["t"]) == set(range(8)) and len(set(first.tables["t"].values())) == 1
    second = store.commit(first, {"t": Change(rows(spark, [("k7", 70), ("new", 1)]))})
    moved = {b for b in range(8) if first.tables["t"][b] != second.tables["t"][b]}
    assert 1 <= len(moved) <= 2 and held(store) == {f"k{i}": i for i in range(100)} | {"k7": 70, "new": 1}
    assert held(store, first) == {f"k{i}": i for i in range(100)}
    written = [f for f in store.read("t", second).inputFiles() if second.tables["t"][int(f.split("_bucket=")[1].split("/")[0])] != next(iter(first.tables["t"].values()))]
    assert len(written) == len(moved)


def test_lookup_reads_one_bucket(spark, store):
    at = store.commit(store.snapshot(), {"t": Change(rows(spark, [(f"k{i}", i) for i in range(100)]))})
    found = store.lookup("t", "k42", at)
    assert [(r.k, r.v) for r in found.collect()] == [("k42", 42)] and len(found.inputFiles()) == 1
    assert "PushedFilters: [IsNotNull(k), EqualTo(k,k42)]" in found._jdf.queryExecution().executedPlan().toString()
    assert store.lookup("t", "none", at).count() == 0


def test_rows_go_with_their_keys(spark, store):
    first = store.commit(store.snapshot(), {"t": Change(rows(spark, [("a", 1), ("a", 2), ("b", 3)]))})
    gone = spark.createDataFrame([("a",)], "k string")
    second = store.commit(first, {"t": Change(rows(spark, []), gone)})
    assert held(store) == {"b": 3} and len(second.tables["t"]) == 1
    third = store.commit(second, {"t": Change(rows(spark, []))})
    assert third.tables == second.tables and store.lookup("t", "a").count() == 0


def test_a_load_that_dies_leaves_the_snapshot_before(spark, store, monkeypatch):
    first = store.commit(store.snapshot(), {"t": Change(rows(spark, [("a", 1)]))})
    monkeypatch.setattr(Store, "publish", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        store.commit(first, {"t": Change(rows(spark, [("a", 2)]))})
    monkeypatch.undo()
    assert store.snapshot().number == 1 and held(store) == {"a": 1} and len(store.folder.names("t")) == 2
    store.commit(store.snapshot(), {"t": Change(rows(spark, [("a", 3)]))})
    assert held(store) == {"a": 3} and len(store.folder.names("t")) == 3
    store.vacuum(keep=1)
    assert held(store) == {"a": 3} and len(store.folder.names("t")) == 1 and store.numbers() == [2]


def test_of_two_loads_from_one_snapshot_one_wins(spark, store):
    base = store.commit(store.snapshot(), {"t": Change(rows(spark, [("a", 1)]))})
    store.commit(base, {"t": Change(rows(spark, [("a", 2)]))})
    with pytest.raises(Conflict):
        store.commit(base, {"t": Change(rows(spark, [("a", 3)]))})
    assert held(store) == {"a": 2} and not [n for n in store.folder.names("manifests") if n.startswith(".")]


def test_columns_that_older_files_lack_are_null(spark, store, tmp_path):
    store.commit(store.snapshot(), {"t": Change(rows(spark, [("a", 1), ("b", 2)]))})
    wider = Store(spark, f"file://{tmp_path}/store", {"t": Table("k string, v int, extra variant, added string", "k")}, buckets=8)
    assert [r.added for r in wider.read("t").collect()] == [None, None]
    wider.commit(wider.snapshot(), {"t": Change(rows(spark, [("c", 3)]).withColumn("added", F.lit("x")))})
    assert {r.k: r.added for r in wider.read("t").collect()} == {"a": None, "b": None, "c": "x"}
    with pytest.raises(ValueError):
        Store(spark, f"file://{tmp_path}/store", {}, buckets=9).snapshot()


def test_older_files_are_taken_up_to_the_present_schema(spark, tmp_path):
    one = Version("k string, name string", lambda d: d.withColumnRenamed("name", "title"), lambda d: d.withColumnRenamed("title", "name"))
    two = Version("k string, title string", lambda d: d.withColumn("n", F.length("title")), lambda d: d)
    three = Version("k string, title string, n int", lambda d: d.withColumn("n", F.col("n").cast("long") * 10), lambda d: d.withColumn("n", (F.col("n") / 10).cast("int")))
    at = lambda schema, *before: Store(spark, f"file://{tmp_path}/v", {"t": Table(schema, "k", before)}, 4)
    first = at("k string, name string")
    first.commit(first.snapshot(), {"t": Change(spark.createDataFrame([(f"k{i}", "x" * i) for i in range(12)], "k string, name string"))})
    now = at("k string, title string, n long", one, two, three)
    assert sorted(map(tuple, now.read("t").collect())) == sorted((f"k{i}", "x" * i, 10 * i) for i in range(12))
    done = now.commit(now.snapshot(), {"t": Change(spark.createDataFrame([("k3", "new", 7)], "k string, title string, n long"))})
    assert sorted(done.versions["t"].values()) == [1, 4]  # one bucket is written back, the others stay as they are
    assert {r.k: (r.title, r.n) for r in now.read("t").collect()} == {f"k{i}": ("x" * i, 10 * i) for i in range(12)} | {"k3": ("new", 7)}
    assert now.lookup("t", "k5").first().n == 50
    assert now.read("t", version=1).columns == ["k", "name"] and {r.k: r.name for r in now.read("t", version=1).collect()}["k3"] == "new"
    assert {r.k: r.n for r in now.read("t", version=3).collect()}["k5"] == 5


def issue(n, at, title="t", body="text"):
    doc = {"type": "doc", "content": [{"type": "paragraph", "content": [{"type": "text", "text": body}]}]}
    fields = {"summary": title, "updated": at.isoformat(), "description": doc, "status": {"name": "Open"}, "assignee": {"displayName": "ann"}, "subtasks": [{"key": f"A-{n + 1}"}]}
    return (f"A-{n}", "A", at, json.dumps({"key": f"A-{n}", "fields": fields}), None)


def scan(spark, records):
    """A source that filters by time as the remote one does."""
    def since(mark):
        df = spark.createDataFrame(records, ISSUE)
        return df if mark is None else df.where((F.col("updated_at") >= F.lit(mark)) | F.col("note").isNotNull())

    return since


def corpus(store):
    t = runs.tables(store)
    return (
        {r.source_id: (r.title, r.status) for r in t.sources.select("source_id", "title", ingest.attribute("status").alias("status")).collect()},
        sorted((r.source_id, r.chunk_index) for r in t.chunks.collect()), sorted((r.source_id, r.target_key) for r in t.edges.collect()),
    )


def test_runs_go_on_from_the_mark(spark, tmp_path):
    store = runs.open_store(spark, f"file://{tmp_path}/c", 4)
    day = lambda n: dt.datetime(2024, 4, n, tzinfo=UTC)
    sync = lambda records, now: runs.sync_issues(store, scan(spark, records), CHUNKER, base_url="https://t", now=now)
    records = [issue(n, day(n)) for n in range(1, 6)]
    first = sync(records, day(20))
    assert (first.fetched, first.sources, first.links, first.failed, first.mark, first.number) == (5, 5, 5, 0, day(20), 1)
    assert first.chunks == first.embeddings == len(corpus(store)[1])
    before = corpus(store)
    empty = sync(records, day(21))
    assert (empty.fetched, empty.mark, empty.number, empty.stale) == (0, day(20), 1, True) and not sync(records, day(20) + dt.timedelta(hours=6)).stale
    again = sync([*records, issue(3, day(22), "new"), issue(9, day(19), "late"), issue(2, day(20) - dt.timedelta(seconds=30), "slack")], day(22))
    assert (again.fetched, again.sources) == (2, 2) and {k: v[0] for k, v in corpus(store)[0].items()}["jira:A-3"] == "new"
    assert len(corpus(store)[1]) == len(before[1]) and again.mark == day(22)


def test_bad_records_hold_the_mark_and_are_kept_until_they_load(spark, tmp_path):
    store = runs.open_store(spark, f"file://{tmp_path}/c", 4)
    day = dt.datetime(2024, 4, 1, tzinfo=UTC)
    broken = ("A-3", "A", day, "{", None)
    bad = runs.sync_issues(store, scan(spark, [issue(1, day), issue(2, day, " "), broken]), CHUNKER, base_url="u", now=NOW)
    assert (bad.fetched, bad.sources, bad.failed, bad.skipped, bad.mark, bad.number) == (3, 1, 2, 0, None, 1)
    kept = {r.source_id: r for r in store.read("rejected").collect()}
    assert kept["jira:A-2"].error == "title is required" and json.loads(kept["jira:A-2"].record)["key"] == "A-2" and len(kept) == 2
    good = runs.sync_issues(store, scan(spark, [issue(1, day), issue(2, day, "now")]), CHUNKER, base_url="u", now=NOW)
    assert good.mark == NOW and [r.source_id for r in store.read("rejected").collect()] == [k for k in kept if k != "jira:A-2"]


def test_a_scan_that_was_cut_short_moves_the_mark_as_far_as_it_came(spark, tmp_path):
    store = runs.open_store(spark, f"file://{tmp_path}/c", 4)
    day = dt.datetime(2024, 4, 1, tzinfo=UTC)
    cut = runs.sync_issues(store, scan(spark, [issue(1, day), (None, "", day, None, "stopped at 1 records")]), CHUNKER, base_url="u", now=NOW)
    assert (cut.fetched, cut.sources, cut.failed, cut.notes, cut.mark) == (1, 1, 0, ("stopped at 1 records",), day)


def test_a_run_that_dies_changes_nothing_and_can_be_run_again(spark, tmp_path, monkeypatch):
    store = runs.open_store(spark, f"file://{tmp_path}/c", 4)
    day = dt.datetime(2024, 4, 1, tzinfo=UTC)
    runs.sync_issues(store, scan(spark, [issue(1, day)]), CHUNKER, base_url="u", now=NOW)
    before, written = corpus(store), Store._written
    for fatal in ("sources", "chunks", "edges", "state"):
        def dying(self, name, *a):
            if name == fatal:
                raise RuntimeError("lost")
            return written(self, name, *a)

        monkeypatch.setattr(Store, "_written", dying)
        with pytest.raises(RuntimeError):
            runs.sync_issues(store, scan(spark, [issue(1, NOW, "v2"), issue(2, NOW)]), CHUNKER, base_url="u", now=NOW + dt.timedelta(days=1))
        assert corpus(store) == before and store.snapshot().number == 1
    monkeypatch.undo()
    done = runs.sync_issues(store, scan(spark, [issue(1, NOW, "v2"), issue(2, NOW)]), CHUNKER, base_url="u", now=NOW + dt.timedelta(days=1))
    assert done.number == 2 and {v[0] for v in corpus(store)[0].values()} == {"v2", "t"}


PAGES = "id string, title string, space string, parent_id string, storage string, version long, updated_at timestamp, note string"


def test_pages_keep_their_breadcrumbs_when_only_they_come_again(spark, tmp_path):
    store = runs.open_store(spark, f"file://{tmp_path}/c", 4)
    day = dt.datetime(2024, 4, 1, tzinfo=UTC)
    page = lambda i, up, title, body="x": (i, title, "S", up, f"<p>{body}</p>", 1, day, None)
    sync = lambda rows: runs.sync_pages(store, lambda mark: spark.createDataFrame(rows, PAGES), CHUNKER, base_url="w", now=NOW)
    link = '<ac:link><ri:page ri:content-id="1"/></ac:link>'
    first = sync([page("1", None, "Root"), page("2", "1", "Mid"), page("3", "2", "Leaf"), page(" ", None, "none"), page("4", None, " ")])
    assert (first.sources, first.failed, first.mark) == (3, 2, None)
    sync([page("3", "2", "Leaf", f"changed {link}")])
    body = {r.source_key: r.body for r in runs.tables(store).sources.collect()}
    assert body["3"] == "# Leaf\n\n_Root / Mid_\n\nchanged [page 1](w/spaces/S/pages/1)\n"
    sync([page("2", "1", "Middle"), page("3", "2", "Leaf")])
    assert {r.source_key: r.body for r in runs.tables(store).sources.collect()}["3"].startswith("# Leaf\n\n_Root / Middle_")
    extra = {r.source_key: r.path for r in runs.tables(store).sources.select("source_key", ingest.attribute("breadcrumb").alias("path")).collect()}
    assert extra["3"] == '["Root","Middle"]' and extra["1"] is None


def test_documents_are_replaced_by_key(spark, tmp_path):
    store = runs.open_store(spark, f"file://{tmp_path}/c", 4)
    feed = lambda *r: spark.createDataFrame([(json.dumps(x),) for x in r], "json string")
    doc = lambda **k: {"key": "d1", "title": "T", "content": "old text", "updated_at": "2024-01-01T00:00:00Z"} | k
    runs.load_documents(store, feed(doc(extra={"tags": ["x"], "source": "mail"})), CHUNKER, now=NOW)
    done = runs.load_documents(store, feed(doc(content="new text", updated_at="2024-01-02T00:00:00Z"), doc(key="d2", title=" "), doc(key="d3", updated_at="soon"), doc(key="d4", content=" \n")), CHUNKER, now=NOW)
    assert (done.sources, done.failed) == (1, 3)
    assert sorted(r.error for r in store.read("rejected").collect()) == ["content is required", "title is required", "updated_at is required"]
    t = runs.tables(store)
    assert [(r.source_id, r.body) for r in t.sources.collect()] == [("document:d1", "new text")] and [r.text for r in t.chunks.collect()] == ["# T\n\nnew text"]
    again = ingest.rechunked(t, CHUNKER)
    assert [r.text for r in again.chunks.collect()] == ["# T\n\nnew text"]
    with pytest.raises(ValueError):
        ingest.rechunked(t, CHUNKER, ("jira",))


def test_links_are_rebuilt_from_the_records_as_they_are_now(spark, tmp_path, monkeypatch):
    store = runs.open_store(spark, f"file://{tmp_path}/c", 4)
    runs.sync_issues(store, scan(spark, [issue(n, NOW) for n in (1, 2, 3)]), CHUNKER, base_url="u", now=NOW)
    now = [("A-1", issue(7, NOW)[3].replace('"A-7"', '"A-1"'), "found"), ("A-2", None, "missing"), ("A-3", None, "failed")]
    monkeypatch.setattr(runs, "refetched", lambda keys, options: spark.createDataFrame(now, "key string, json string, state string"))
    done = runs.rebuild_links(store, {})
    assert (done.fetched, done.sources, done.links, done.skipped, done.failed) == (3, 1, 1, 1, 1)
    assert sorted((r.source_id, r.target_key) for r in runs.tables(store).edges.collect()) == [("jira:A-1", "A-8"), ("jira:A-2", "A-3"), ("jira:A-3", "A-4")]
    assert runs.tables(store).sources.count() == 3
