"""The search and answer API on a small corpus."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from millrace.corpus import Corpus
from millrace.filters import parsed
from millrace.functions.english import query_lexemes
from millrace.operators.embed import hash_vector
from millrace.operators.feed import extracted_links, issue_body, parsed_issues
from millrace.options import SearchOptions
from millrace.plans import search as plans
from millrace.sources.corpus import stored_postings, write_postings

T = dt.datetime(2024, 1, 1)
ROWS = [
    ("jira:ZOO-1", "jira", "ZOO-1", "ZOO", "Login broken", "u1", "The login page is broken since the release", T),
    ("jira:ZOO-2", "jira", "ZOO-2", "ZOO", "Slow search", "u2", "Search takes ten seconds on the large index", T),
    ("page:7", "confluence", "7", "DOCS", "Runbook", "u3", "Restart the search index when it is slow", dt.datetime(2024, 6, 1)),
]


@pytest.fixture(scope="module")
def corpus(spark):
    embedder = lambda t: [float(x) for x in hash_vector(t, 16)]
    sources = spark.createDataFrame(
        ROWS,
        "source_id string, source_type string, source_key string, project string, title string, url string, body string, updated_at timestamp_ntz",
    )
    chunks = spark.createDataFrame(
        [(i, r[0], embedder(r[6]), r[6]) for i, r in enumerate(ROWS)],
        "chunk_id long, source_id string, embedding array<float>, text string",
    )
    return Corpus(sources, chunks, embedder)


def test_named_first(corpus):
    rows = corpus.search("what about ZOO-2 and ZOO-1?").orderBy("rank").collect()
    assert [r.source_key for r in rows[:2]] == ["ZOO-2", "ZOO-1"] and rows[0].score == rows[1].score == 1.0
    assert len({r.source_id for r in rows}) == len(rows) and rows[0].body


def test_own_content_wins_and_is_marked(corpus):
    row = corpus.search(ROWS[2][6], SearchOptions(decay_days=0)).orderBy("rank").first()
    assert row.source_id == "page:7" and "<mark>search</mark>" in row.snippet and row.score == pytest.approx(1.0)


def test_questions_match_by_lexemes(corpus):
    row = corpus.search("how do I restart the searches when they are slow").orderBy("rank").first()
    assert row.source_id == "page:7" and "<mark>search</mark>" in row.snippet and "<mark>the</mark>" not in row.snippet
    hits = plans.text_hits(corpus.chunks, query_lexemes("how do I restart the searches"), stemmed=True).collect()
    assert [r.chunk_id for r in hits] == [2] and not plans.text_hits(corpus.chunks, ["restart", "searches"]).count()


def test_filters_do_not_leak(corpus):
    only = corpus.search("search index", SearchOptions(source_types=("confluence",))).collect()
    assert {r.source_type for r in only} == {"confluence"}
    late = corpus.search("search index", SearchOptions(updated_after="2024-03-01 00:00:00")).collect()
    assert {r.source_id for r in late} == {"page:7"}
    assert corpus.search("search", SearchOptions(limit=1)).count() == 1


def test_ask_and_lists(corpus):
    answer, cited = corpus.ask("slow search ZOO-2", lambda prompt: prompt.upper())
    assert answer.startswith("CONTEXT:\n[1] SLOW SEARCH — U2\nUPDATED: 2024-01-01") and "body" not in cited.columns
    assert [r.project for r in corpus.projects().collect()] == ["DOCS", "ZOO"]
    assert corpus.source("jira:ZOO-1").first().title == "Login broken" and not corpus.source("nothing").count()


def test_filter_text():
    p = parsed("Project:ZOO  broken source:jira after:2024-05-01 login space:X after:soon after:20240501 after:2024-W18")
    assert (p.text, p.projects, p.sources, p.spaces, p.after) == (
        "broken login after:soon after:20240501 after:2024-W18", ["ZOO"], ["jira"], ["X"], "2024-05-01 00:00:00",
    )
    assert parsed("after:2024-05-01T10:00:00+02:00 x").after == "2024-05-01 08:00:00" and parsed("after:2024-05-01T10:00:00.5Z").after == "2024-05-01 10:00:00.500000"


def test_feed(spark):
    rows = spark.createDataFrame(
        [
            (1, '{"key": " A-B-1 ", "title": "T", "updated_at": "2024-01-01T00:00:00Z", "status": "open", "extra": {"status": "kept"}, "comments": [{"author": "ann"}]}'),
            (2, "{"), (3, '{"key": "", "title": "T"}'), (4, '{"key": "A-1", "title": "T", "updated_at": "soon"}'),
        ],
        ["n", "json"],
    )
    got = {r.n: r for r in parsed_issues(rows).collect()}
    assert got[1].project == "A-B" and got[1].extra == {"status": "kept", "comment_count": "1"} and got[1].error is None
    assert [got[n].error for n in (2, 3, 4)] == ["key is required", "key is required", "updated_at is required"] or got[2].error == "not JSON"


def test_issue_body(spark):
    comments = F.array(*[F.struct(F.lit(a).cast("string").alias("author"), F.lit(t).cast("string").alias("created_at"), F.lit(b).alias("body")) for a, t, b in (("ann", "2024-01-02T03:04:05Z", "x\n"), (None, None, "y"), ("bob", None, "z"))])
    text = spark.range(1).select(issue_body(F.lit("desc\n\n"), comments)).first()[0]
    assert text == "desc\n\n\n## Comment by ann on 2024-01-02\n\nx\n\n\n## Comment\n\ny\n\n\n## Comment by bob\n\nz\n"


def test_links(spark):
    schema = "key string, parent struct<key:string,issue_type:string>, subtasks array<string>, links array<struct<outward_key:string,outward:string,inward_key:string,inward:string>>"
    issues = spark.createDataFrame(
        [
            (
                "A-1", ("E-1", "Epic"), ["A-2", "A-1", " "],
                [("A-3", "Relates To", None, None), ("A-3", "relates  to", "A-4", ""), (None, "x", "A-5", "is blocked by")],
            ),
            ("A-6", None, None, None),
        ],
        schema,
    )
    got = sorted((r.target_key, r.kind) for r in extracted_links(issues).collect())
    assert got == [("A-2", "subtask"), ("A-3", "relates_to"), ("A-5", "is_blocked_by"), ("E-1", "epic")]


def test_filters_in_the_question(corpus):
    rows = corpus.search("search index source:confluence after:2024-03-01").collect()
    assert {r.source_id for r in rows} == {"page:7"}
    with pytest.raises(ValueError):
        corpus.search("source:confluence")


def test_named_records_that_fill_the_limit_are_all(corpus, monkeypatch):
    monkeypatch.setattr(plans, "hybrid", lambda *a, **k: pytest.fail("no other lookup is needed"))
    rows = corpus.search("ZOO-2 then ZOO-1", SearchOptions(limit=2)).orderBy("rank").collect()
    assert [r.source_key for r in rows] == ["ZOO-2", "ZOO-1"] and rows[0].body == ROWS[1][6]


def test_newer_sources_are_raised_unless_switched_off(corpus):
    q, at = "search index slow", F.lit("2024-06-01 00:00:00").cast("timestamp_ntz")
    plain = {r.source_id: r.score for r in corpus.search(q, SearchOptions(decay_days=0)).collect()}
    raised = {r.source_id: r.score for r in corpus.search(q, as_of=at).collect()}
    assert raised["page:7"] == pytest.approx(plain["page:7"] * 1.05, abs=1e-6)
    assert abs(raised["jira:ZOO-2"] / plain["jira:ZOO-2"]) < 1.05


def test_stored_postings_give_the_same_hits(corpus, tmp_path):
    path = f"file://{tmp_path}/postings"
    write_postings(corpus.chunks, path)
    stored = Corpus(corpus.sources, corpus.chunks, corpus.embedder, path)
    q = "restart the slow searches"
    want, got = ([tuple(r) for r in c.search(q, SearchOptions(decay_days=0)).orderBy("rank").collect()] for c in (corpus, stored))
    assert want == got
    spark = corpus.chunks.sparkSession
    plan = stored_postings(spark, path, ["index"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan
