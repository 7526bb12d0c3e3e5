"""Scans of a tracker and a wiki that answer over HTTP, and of landed pages."""

import datetime as dt
import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

import pytest
from pyspark.sql import functions as F

from millrace.sources import remote

UTC = dt.UTC
START = dt.datetime(2024, 1, 1, tzinfo=UTC)


def issue(n, project="A", said=1, total=None):
    comments = [{"id": str(i), "body": None, "created": "x"} for i in range(said)]
    at = (START + dt.timedelta(hours=n)).strftime("%Y-%m-%dT%H:%M:%S.000+0000")
    return {"key": f"{project}-{n}", "fields": {"summary": f"s{n}", "updated": at, "project": {"key": project}, "comment": {"comments": comments, "total": said if total is None else total}}}


class Service(BaseHTTPRequestHandler):
    """Answers as the services do: pages by token, spaces, lists by cursor, records by key."""

    issues = [issue(n, "AB"[n % 2]) for n in range(40)] + [issue(99, "A", 1, 60)]
    asked: list = []
    stale = False

    def answer(self, body, code=200):
        self.send_response(code)
        self.end_headers()
        self.wfile.write(json.dumps(body).encode())

    def do_POST(self):
        q = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        self.asked.append(q)
        if self.stale and q.get("nextPageToken"):
            return self.answer({"errorMessages": ["The nextPageToken is expired"]}, 400)
        rows = [i for i in self.issues if f'"{i["fields"]["project"]["key"]}"' in q["jql"] or "project" not in q["jql"]]
        at = int(q.get("nextPageToken") or 0)
        page = {"issues": rows[at : at + q["maxResults"]], "isLast": at + q["maxResults"] >= len(rows)}
        return self.answer(page | ({} if page["isLast"] else {"nextPageToken": str(at + q["maxResults"])}))

    def do_GET(self):
        self.asked.append(self.path)
        url = urlsplit(self.path)
        if url.path.startswith("/rest/api/3/issue/"):
            key = url.path.rpartition("/")[2]
            return self.answer(issue(99, "A", 60) if key == "A-99" else {}, 200 if key == "A-99" else 404)
        if url.path == "/wiki/api/v2/spaces":
            keys = parse_qs(url.query).get("keys")
            return self.answer({"results": [{"key": k, "id": i} for i, k in enumerate("XY") if not keys or k in keys]})
        if url.path.endswith("/pages"):
            cursor = int(parse_qs(url.query).get("cursor", ["9"])[0])
            at = lambda n: (START + dt.timedelta(days=n)).isoformat().replace("+00:00", "Z")
            page = {"results": [{"id": str(n), "version": {"createdAt": at(n)}} for n in range(cursor, max(cursor - 3, -1), -1)]}
            return self.answer(page | {"_links": {"next": f"{url.path}?cursor={cursor - 3}"} if cursor > 2 else {}})
        n = url.path.rpartition("/")[2]
        return self.answer({"id": n, "title": f"T{n}", "parentId": "0", "body": {"storage": {"value": f"<p>{n}</p>"}}, "version": {"number": 2, "createdAt": f"2024-01-{int(n) + 1:02d}T00:00:00Z"}})

    def log_message(self, *a):
        pass


@pytest.fixture
def service():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    Service.asked.clear()
    Service.stale = False
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_remote_query():
    at = START + dt.timedelta(hours=2)
    assert remote.remote_predicate([], None, at) == 'updated >= "1970-01-01 00:00" ORDER BY updated ASC'
    assert remote.remote_predicate(["P", 'Q"'], START, at) == 'project in ("P", "Q\\"") AND updated >= -121m ORDER BY updated ASC'
    zone = dt.timezone(dt.timedelta(hours=-7))
    for mark, minutes in ((START.astimezone(zone), 121), (START + dt.timedelta(seconds=38), 121), (START - dt.timedelta(days=161), 231961), (at + dt.timedelta(minutes=10), 1)):
        assert remote.remote_predicate([], mark, at).startswith(f"updated >= -{minutes}m ")


def test_filters_become_the_remote_query(spark, service):
    rows = remote.scan(spark, remote.Tracker, {"url": service, "page": "7"}, ["A"], START + dt.timedelta(hours=30))
    rows = rows.where(F.col("updated_at") < F.lit(START + dt.timedelta(hours=36))).where("length(key) > 1")
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    plan = rows._jdf.queryExecution().explainString(mode)
    pushed, kept = (next(x for x in plan.split("\n") if x.startswith(k)) for k in ("PushedFilters", "Condition"))
    assert all(x in pushed for x in ("GreaterThanOrEqual(updated_at", "LessThan(updated_at", "project")) and "<" not in kept and "2024" not in kept
    assert [r.key for r in rows.orderBy("updated_at").collect()] == ["A-30", "A-32", "A-34"]
    queries = {q["jql"] for q in Service.asked if isinstance(q, dict)}
    assert all(q.startswith('project in ("A") AND updated >= -') and " AND updated <= -" in q for q in queries)


def test_all_pages_are_read_once_and_cut_comments_fetched(spark, service):
    rows = remote.scan(spark, remote.Tracker, {"url": service, "page": "7"}).collect()
    assert sorted(r.key for r in rows) == sorted(i["key"] for i in Service.issues) and all(r.note is None for r in rows)
    assert len([q for q in Service.asked if isinstance(q, dict)]) == 6
    whole = next(r for r in rows if r.key == "A-99")
    assert len(json.loads(whole.json)["fields"]["comment"]["comments"]) == 60
    assert [q for q in Service.asked if isinstance(q, str)] == ["/rest/api/3/issue/A-99?expand=renderedFields,comments"]


def test_caps_and_stale_tokens_are_told(spark, service):
    capped = remote.scan(spark, remote.Tracker, {"url": service, "page": "7", "cap": "10"}).collect()
    notes = [r for r in capped if r.note]
    assert len(capped) == 11 and [r.note for r in notes] == ["stopped at 10 records"]
    assert notes[0].updated_at == dt.datetime(2024, 1, 1, 9) and notes[0].key is None
    Service.stale = True
    stale = remote.scan(spark, remote.Tracker, {"url": service, "page": "7"}, ["B"]).collect()
    assert len(stale) == 8 and [r.note for r in stale if r.note] == ["stale page token 7"]


def test_windows_of_time_cover_the_range():
    now = START + dt.timedelta(days=10)
    q = remote.Question(("A", "B"), START)
    parts = remote.HttpTracker(remote.Http("x")).splits(q, 4, now)
    assert len(parts) == 8 and {p.groups for p in parts} == {("A",), ("B",)}
    one = [p for p in parts if p.groups == ("A",)]
    assert one[0].since == START and one[-1].until == remote.MOST
    assert all(b.since - a.until == dt.timedelta(microseconds=1) for a, b in zip(one, one[1:]))


def test_landed_pages(spark, tmp_path):
    rows = spark.range(300).select(
        F.concat(F.lit("K-"), "id").alias("key"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("P /"), (F.col("id") % 3).cast("string"))).alias("project"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 3600).alias("updated_at"), F.lit('{"fields": {}}').alias("json"),
    )
    path = f"file://{tmp_path}/pages"
    remote.land_pages(rows, path, 10)
    got = remote.scan(spark, remote.Tracker, {"path": path, "splits": "3"}, ["P /1"], START + dt.timedelta(hours=200))
    assert sorted(r.key for r in got.collect()) == sorted(f"K-{n}" for n in range(200, 300) if n % 3 == 1)
    assert remote.scan(spark, remote.Tracker, {"path": path}).count() == 300
    files = remote.PageFiles(path)
    question = remote.Question(("P /1",), START + dt.timedelta(hours=200))
    read = [len(p) for s in files.splits(question, 3, START) for p in files.pages(s, START)]
    assert max(read) <= 10 and sum(read) < 45  # pages of other projects and earlier times are not read
    assert remote.scan(spark, remote.Tracker, {"path": path}, ["none"]).count() == 0


def test_wiki_lists_end_at_the_first_older_page(spark, service):
    rows = remote.scan(spark, remote.Wiki, {"url": f"{service}/wiki"}, ["X"], START + dt.timedelta(days=6)).collect()
    assert sorted((r.id, r.title, r.space, r.parent_id, r.storage, r.version) for r in rows) == [(str(n), f"T{n}", "X", "0", f"<p>{n}</p>", 2) for n in (6, 7, 8, 9)]
    lists = [p for p in Service.asked if "/pages?" in p]
    assert len(lists) == 2 and all("/spaces/0/" in p and "/wiki/wiki" not in p for p in lists)
    assert remote.scan(spark, remote.Wiki, {"url": f"{service}/wiki"}).where("note is null").count() == 20
    capped = remote.scan(spark, remote.Wiki, {"url": f"{service}/wiki", "spaces": "Y", "cap": "4"}).collect()
    assert len(capped) == 5 and [r.note for r in capped if r.note] == ["stopped at 4 pages"]
    with pytest.raises(Exception, match="is a space"):
        remote.scan(spark, remote.Wiki, {"url": f"{service}/wiki"}, ["Z"]).collect()


def test_records_by_key(spark, service):
    keys = spark.createDataFrame([("A-99",), ("A-1",), (None,)], "key string")
    assert {r.key: r.state for r in remote.refetched(keys.where("key is not null"), {"url": service}).collect()} == {"A-99": "found", "A-1": "missing"}
    assert [r.state for r in remote.refetched(keys, {"url": "http://127.0.0.1:9"}).where("key = 'A-1'").collect()] == ["failed"]
