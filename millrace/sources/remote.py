"""Remote trackers and wikis as Spark data sources: filters become the remote query, ranges of pages the partitions."""

from __future__ import annotations

import json
import math
import re
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace
from datetime import UTC, datetime, timedelta
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from ..tables import tidy

ISSUES = "key string, project string, updated_at timestamp, json string, note string"
PAGES = "id string, title string, space string, parent_id string, storage string, version long, updated_at timestamp, note string"
#: Records that one split reads at most, a page of a search, and pages of a list, as the remote services' clients have it.
CAP, PAGE, LISTS = 10_000, 100, 200
#: Fields of an issue that are asked for.
FIELDS = ["summary", "description", "status", "issuetype", "project", "updated", "comment", "labels", "assignee", "parent", "subtasks", "issuelinks"]
LEAST, EPOCH, MOST = datetime.min.replace(tzinfo=UTC), datetime(1970, 1, 1, tzinfo=UTC), datetime.max.replace(tzinfo=UTC)


class StaleToken(Exception):
    """A page token that the service no longer takes."""


def remote_predicate(projects: Iterable[str], mark: datetime | None, now: datetime, *, slack: timedelta = timedelta(minutes=1), until: datetime | None = None) -> str:
    """The query a remote tracker gets: its projects, and what changed since ``slack`` before the mark (and before ``until``), in
    whole minutes back from now, which no time zone of an account can shift. Never without a bound."""
    parts = [f"project in ({', '.join(json.dumps(p) for p in projects)})"] if projects else []
    if mark is not None:
        parts.append(f"updated >= -{max(1, math.ceil((now - (mark - slack)) / timedelta(minutes=1)))}m")
    elif not projects:
        parts.append('updated >= "1970-01-01 00:00"')
    if until is not None and until < now:
        parts.append(f"updated <= -{math.floor((now - until) / timedelta(minutes=1))}m")
    return " AND ".join(parts) + " ORDER BY updated ASC"


@dataclass(frozen=True)
class Question:
    """What is asked for: groups (projects or spaces; None: all) and a range of times, which both ends belong to. Filters
    narrow it; ``unbound`` as long as none has."""

    groups: tuple[str, ...] | None = None
    since: datetime = LEAST
    until: datetime = MOST

    def taken(self, f: Filter, group: str) -> Question | None:
        """The question with a filter, or None if it has no place for it."""
        column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
        if column == group and isinstance(f, (EqualTo, In)):
            named = set(f.value if isinstance(f, In) else [f.value])
            return replace(self, groups=tuple(sorted(named if self.groups is None else named & set(self.groups))))
        if column != "updated_at" or not isinstance(getattr(f, "value", None), datetime):
            return None
        at = f.value.astimezone(UTC)
        if isinstance(f, (GreaterThanOrEqual, GreaterThan)):
            return replace(self, since=max(self.since, at + timedelta(microseconds=isinstance(f, GreaterThan))))
        if isinstance(f, (LessThanOrEqual, LessThan)):
            return replace(self, until=min(self.until, at - timedelta(microseconds=isinstance(f, LessThan))))
        return None

    def holds(self, group: str | None, at: datetime | None) -> bool:
        return (self.groups is None or group in self.groups) and (self.since <= at <= self.until if at else self.since == LEAST and self.until == MOST)


def moment(text: Any) -> datetime | None:
    """An ISO time as the services write it; None if it is none. Without an offset it is UTC."""
    try:
        at = datetime.fromisoformat(str(text))
    except ValueError:
        return None
    return at.astimezone(UTC) if at.tzinfo else at.replace(tzinfo=UTC)


@dataclass(frozen=True)
class Http:
    """JSON over HTTP; Spark repeats a task that fails."""

    base: str
    authorization: str = ""
    seconds: float = 30.0

    def call(self, path: str, body: dict | None = None) -> dict:
        headers = {"Accept": "application/json", "Content-Type": "application/json"} | ({"Authorization": self.authorization} if self.authorization else {})
        asked = urllib.request.Request(self.base.rstrip("/") + path, None if body is None else json.dumps(body).encode(), headers)
        with urllib.request.urlopen(asked, timeout=self.seconds) as answer:
            return json.load(answer)


@dataclass(frozen=True)
class Issue:
    key: str | None
    project: str | None
    updated: datetime | None
    json: str

    @staticmethod
    def of(raw: dict) -> Issue:
        f = raw.get("fields") or {}
        key = raw.get("key")
        project = (f.get("project") or {}).get("key") or (key.rpartition("-")[0] if key else None) or None
        return Issue(key, project, moment(f.get("updated")), json.dumps(raw, ensure_ascii=False))

    def cut(self) -> bool:
        """Whether the service left comments out, as it does beyond some fifty."""
        said = (json.loads(self.json).get("fields") or {}).get("comment") or {} if '"total"' in self.json else {}
        return (said.get("total") or 0) > len(said.get("comments") or [])


@dataclass(frozen=True)
class HttpTracker:
    """A tracker's search by query text and page tokens, and its records by key."""

    http: Http
    size: int = PAGE

    def splits(self, q: Question, windows: int, now: datetime) -> list[Question]:
        """One search for each project asked for and each of equally long windows of time; what is newer than now is in the last."""
        start = q.since if q.since > LEAST else None
        step = (min(q.until, now) - start) / windows if start and min(q.until, now) > start else None
        ends = [start + step * i for i in range(1, windows)] if step else []
        times = list(zip([q.since, *ends], [*(e - timedelta(microseconds=1) for e in ends), q.until]))
        groups = [(g,) for g in q.groups] if q.groups is not None else [None]
        return [Question(g, a, b) for g in groups for a, b in times if a <= b]

    def pages(self, q: Question, now: datetime) -> Iterator[list[Issue]]:
        query = remote_predicate(q.groups or (), q.since if q.since > LEAST else None, now, slack=timedelta(0), until=q.until if q.until < MOST else None)
        token = None
        while True:
            asked = {"jql": query, "fields": FIELDS, "maxResults": self.size} | ({"nextPageToken": token} if token else {})
            try:
                got = self.http.call("/rest/api/3/search/jql", asked)
            except urllib.error.HTTPError as e:
                if token and e.code == 400 and "token" in e.read().decode(errors="replace").lower():
                    raise StaleToken(f"stale page token {token}") from e
                raise
            yield [Issue.of(i) for i in got.get("issues") or []]
            token = got.get("nextPageToken")
            if not token or got.get("isLast"):
                return

    def record(self, key: str) -> Issue | None:
        """One whole record; None if it is gone or not to be seen."""
        try:
            return Issue.of(self.http.call(f"/rest/api/3/issue/{urllib.parse.quote(key, safe='')}?expand=renderedFields,comments"))
        except urllib.error.HTTPError as e:
            if e.code in (403, 404):
                return None
            raise


@dataclass(frozen=True)
class FileRange:
    question: Question
    files: tuple[str, ...]


@dataclass(frozen=True)
class PageFiles:
    """Pages that were landed as Parquet files (key, updated_us, json) in a folder for each project (``land_pages``)."""

    path: str

    def _store(self) -> tuple[Any, str]:
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def splits(self, q: Question, windows: int, now: datetime) -> list[FileRange]:
        """The page files of each project asked for in ``windows`` runs, in order of time; other folders are not looked into."""
        from pyarrow import fs

        store, root = self._store()
        found = []
        for folder in store.get_file_info(fs.FileSelector(root)):
            project = self._project(folder.base_name)
            if folder.is_file or project is False or (q.groups is not None and project not in q.groups):
                continue
            files = sorted(f.path for f in store.get_file_info(fs.FileSelector(folder.path)) if f.base_name.endswith(".parquet"))
            run = max(1, -(-len(files) // windows))
            found += [FileRange(q, tuple(files[a : a + run])) for a in range(0, len(files), run)]
        return found

    @staticmethod
    def _project(folder: str) -> str | None | bool:
        name, _, value = folder.partition("=")
        return False if name != "project" else None if value == "__HIVE_DEFAULT_PARTITION__" else urllib.parse.unquote(value)

    def pages(self, split: FileRange, now: datetime) -> Iterator[list[Issue]]:
        """Only files whose times meet the question are read beyond their footer."""
        import pyarrow.parquet as pq

        store, _ = self._store()
        for path in split.files:
            project = self._project(path.split("/")[-2])
            with store.open_input_file(path) as f:
                file = pq.ParquetFile(f)
                at = file.schema_arrow.get_field_index("updated_us")
                ranges = [file.metadata.row_group(i).column(at).statistics for i in range(file.num_row_groups)]
                met = [i for i, s in enumerate(ranges) if s is None or not s.has_min_max or s.null_count or (_at(s.max) >= split.question.since and _at(s.min) <= split.question.until)]
                if met:
                    rows = file.read_row_groups(met, columns=["key", "updated_us", "json"]).to_pylist()
                    yield [Issue(r["key"], project, _at(r["updated_us"]), r["json"]) for r in rows]

    def record(self, key: str) -> None:
        return None


def _at(micros: int | None) -> datetime | None:
    return None if micros is None else EPOCH + timedelta(microseconds=micros)


@dataclass(frozen=True)
class Split(InputPartition):
    """A part of a scan. (The base class has a value; here it is the part itself.)"""

    value: Any = field(default=None)


class _Reader(DataSourceReader):
    """Takes what filters it can into the question; the others stay with Spark."""

    group = ""

    def __init__(self, options: dict[str, str]):
        self.options, self.question, self.now = options, Question(), datetime.now(UTC)

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            narrowed = self.question.taken(f, self.group)
            if narrowed is None:
                yield f
            else:
                self.question = narrowed


def tracker(options: dict[str, str]) -> HttpTracker | PageFiles:
    if options.get("path"):
        return PageFiles(options["path"])
    return HttpTracker(Http(options["url"], options.get("authorization", "")), int(options.get("page", PAGE)))


class TrackerReader(_Reader):
    group = "project"

    def partitions(self) -> list[InputPartition]:
        return [Split(s) for s in tracker(self.options).splits(self.question, int(self.options.get("splits", 1)), self.now)] or [Split(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value is None:
            return
        remote, question, cap = tracker(self.options), self.question, int(self.options.get("cap", CAP))
        read, last, note = 0, None, None
        try:
            for page in remote.pages(partition.value, self.now):
                for issue in page:
                    if read == cap:
                        note = f"stopped at {cap} records"
                        break
                    last, read = max(filter(None, (last, issue.updated)), default=None), read + 1
                    if question.holds(issue.project, issue.updated):
                        whole = remote.record(issue.key) if issue.key and issue.cut() else None
                        yield issue.key, issue.project, issue.updated, (whole or issue).json, None
                if note:
                    break
        except StaleToken as e:
            note = str(e)
        if note:
            yield None, "", last or question.since, None, note


class Tracker(DataSource):
    """``spark.read.format("tracker")``: issues (key, project, updated_at, json) of a remote tracker.

    Options: ``url`` (and ``authorization``) of the service, or ``path`` of landed pages; ``splits``, into how many searches by time
    each project's is dealt, or how many runs of landed pages there are; ``page`` and ``cap``, records of a page and of a split. Comparisons of
    updated_at and equality of project (or a list of them) go to the remote query. Records whose comments were cut are
    fetched whole. A split that its cap or a stale token ends adds a row with ``note``, whose updated_at is the latest that
    was read: splits read in order of time, so the next scan goes on from there.
    """

    @classmethod
    def name(cls) -> str:
        return "tracker"

    def schema(self) -> str:
        return ISSUES

    def reader(self, schema) -> DataSourceReader:
        return TrackerReader(dict(self.options))


class WikiReader(_Reader):
    group = "space"

    def _http(self) -> Http:
        return Http(self.options["url"], self.options.get("authorization", ""))

    def partitions(self) -> list[InputPartition]:
        """A split for each space that the keys asked for resolve to; without keys, for each there is."""
        asked = self.question.groups
        if asked is None:
            asked = tuple(filter(None, self.options.get("spaces", "").split(",")))
        query = urllib.parse.urlencode([("limit", "100"), *(("keys", k) for k in asked)])
        path, found = f"/api/v2/spaces?{query}", []
        while path:
            got = self._http().call(path)
            found += [(s["key"], str(s["id"])) for s in got.get("results") or []]
            path = relative((got.get("_links") or {}).get("next"))
        if asked and not found:
            raise ValueError(f"none of {', '.join(asked)} is a space")
        return [Split(s) for s in sorted(set(found))] or [Split(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value is None:
            return
        (space, number), http, cap = partition.value, self._http(), int(self.options.get("cap", CAP))
        path, read, lists, note = f"/api/v2/spaces/{number}/pages?limit={self.options.get('page', PAGE)}&sort=-modified-date", 0, 0, None
        while path and not note:
            got = http.call(path)
            lists += 1
            for item in got.get("results") or []:
                at = moment((item.get("version") or {}).get("createdAt"))
                if at and at < self.question.since:
                    return  # newest first: the rest is older still
                if not self.question.holds(space, at):
                    continue
                if read == cap:
                    note = f"stopped at {cap} pages"
                    break
                read += 1
                page = http.call(f"/api/v2/pages/{item['id']}?body-format=storage&include-version=true")
                body, version = ((page.get("body") or {}).get("storage") or {}).get("value"), page.get("version") or {}
                above = page.get("parentId")
                yield str(page["id"]), page.get("title"), space, str(above) if above else None, body, version.get("number"), moment(version.get("createdAt")) or at, None
            path = relative((got.get("_links") or {}).get("next"))
            if path and lists > LISTS:
                note = f"stopped after {lists} lists"
        if note:  # what is left is older: the next scan has to begin where this one did
            yield None, None, "", None, None, None, self.question.since if self.question.since > LEAST else EPOCH, note


def relative(link: str | None) -> str:
    """A link to the next list, without the context path that the base address ends with already."""
    return re.sub(r"^/wiki(?=/)", "", link or "")


class Wiki(DataSource):
    """``spark.read.format("wiki")``: pages of a remote wiki with their bodies, a split for each space.

    Options: ``url`` (with its /wiki), ``authorization``, ``spaces`` (keys, comma-separated), ``page`` and ``cap``. Pages are listed newest first;
    a lower bound of updated_at, which filters give, ends a list at the first older one. A list that its cap ends adds a
    row with ``note`` and the bound it began with.
    """

    @classmethod
    def name(cls) -> str:
        return "wiki"

    def schema(self) -> str:
        return PAGES

    def reader(self, schema) -> DataSourceReader:
        return WikiReader(dict(self.options))


def scan(spark: SparkSession, source: type[DataSource], options: dict[str, str], groups: list[str] | None = None, since: datetime | None = None) -> DataFrame:
    """Records of a source, of some projects or spaces, and from a time on."""
    spark.dataSource.register(source)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    rows = spark.read.format(source.name()).options(**options).load()
    if groups:
        rows = rows.where(F.col("space" if source is Wiki else "project").isin(*groups))
    return rows if since is None else rows.where(F.col("updated_at") >= F.lit(since))


def land_pages(records: DataFrame, path: str, size: int = PAGE) -> None:
    """Write (key, project, updated_at, json) as pages of at most ``size`` records, each of one project and a range of times."""
    order = ["project", "updated_us", "key"]
    rows = records.select("key", "project", F.unix_micros("updated_at").alias("updated_us"), "json").repartitionByRange(*order).sortWithinPartitions(*order)
    with tidy(records.sparkSession):
        rows.write.option("maxRecordsPerFile", size).option("compression", "zstd").partitionBy("project").parquet(path)


def refetched(keys: DataFrame, options: dict[str, str], key_col: str = "key") -> DataFrame:
    """(key, json, state): records by key, whole; ``state`` is found, missing (gone or not to be seen) or failed, and json null
    but for what is found. Null keys are left out."""
    def fetch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        remote = tracker(options)
        for f in frames:
            rows = []
            for key in f["key"]:
                try:
                    issue = remote.record(key)
                    rows.append((key, issue.json if issue else None, "found" if issue else "missing"))
                except (OSError, ValueError):
                    rows.append((key, None, "failed"))
            yield pd.DataFrame(rows, columns=["key", "json", "state"])

    named = keys.select(F.col(key_col).alias("key")).where("key is not null")
    return named.mapInPandas(fetch, "key string, json string, state string")
