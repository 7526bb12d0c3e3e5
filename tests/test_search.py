"""The vector index, many questions at once, and what hits and prompts show."""

import datetime as dt
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.corpus import Corpus
from millrace.functions.text import cut_bytes, title_of, truncated
from millrace.options import SearchOptions
from millrace.plans import questions as many
from millrace.plans import search as plans
from millrace.sources.corpus import counted_postings, write_counted_postings
from millrace.sources.vector_index import VectorIndex, write_index

ROWS = "chunk_id long, source_id string, embedding array<float>, text string"
AS_OF = "2024-06-01 00:00:00"


@pytest.fixture(scope="module")
def clustered(spark):
    """Twenty clusters of directions, with repeated, null, zero and short vectors."""
    rng = np.random.default_rng(7)
    centers = rng.normal(size=(20, 12))
    words = ["alpha", "beta", "gamma", "delta", "epsilon"]
    rows = [(i, f"s{i // 3}", (centers[i % 20] + 0.15 * rng.normal(size=12)).astype("float32").tolist(), " ".join(rng.choice(words, 9))) for i in range(600)]
    rows += [(600 + i, f"s{i}", rows[i][2], rows[i][3]) for i in range(20)] + [(700, "s1", None, "alpha"), (701, "s1", [0.0] * 12, None), (702, "s1", [1.0], "beta gamma alpha")]
    return spark.createDataFrame(rows, ROWS), rows


@pytest.fixture(scope="module")
def index(spark, clustered, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('index')}/i"
    write_index(clustered[0].where("chunk_id < 700"), path, lists=20)
    return VectorIndex.open(spark, path)


def test_all_vectors_are_indexed_once(index):
    assert sorted(r.chunk_id for r in index.rows.select("chunk_id").collect()) == list(range(620))
    assert len(index.lists) == 20 and (index.angles < 1.6).all()


def test_the_exact_way_gives_the_same_hits_and_reads_less(clustered, index):
    df, rows = clustered
    for i in (0, 7, 333):
        want = [tuple(r) for r in plans.vector_hits(df.where("chunk_id < 700"), rows[i][2], 20).collect()]
        got = index.hits(rows[i][2], 20)
        assert [tuple(r) for r in got.collect()] == want
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [list#" in plan and len(got.inputFiles()) <= len(index.rows.inputFiles())
        read = re.search(r"PartitionFilters: \[list#\d+ (?:IN \(([^)]*)\)|= )", plan)
        assert read and len((read[1] or "").split(",")) < 20
    assert index.hits([0.0] * 12).count() == 0
    assert len(index.hits(rows[0][2], 1000).collect()) == 620


def test_probes_reach_the_recall_they_were_measured_for(spark, tmp_path):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("chunk_id"), "embedding")
    write_index(df, f"file://{tmp_path}/i", lists=16)
    index = VectorIndex.open(spark, f"file://{tmp_path}/i")
    asked = [list(r.embedding) for r in df.where("chunk_id % 97 = 5").orderBy("chunk_id").collect()]
    probes = index.probes_for(asked[:10], 20, 0.93)
    assert probes < 16
    found = total = 0
    for q in asked[10:18]:
        true = {r.chunk_id for r in plans.vector_hits(df, q, 20).collect()}
        found += len(true & {r.chunk_id for r in index.hits(q, 20, probes).collect()})
        total += 20
    assert found / total >= 0.9


def test_an_index_of_nothing(spark, clustered, tmp_path):
    write_index(clustered[0].where("chunk_id in (700, 701)"), f"file://{tmp_path}/none")
    assert VectorIndex.open(spark, f"file://{tmp_path}/none").hits([1.0, 2.0]).count() == 0


def test_many_questions_have_the_hits_of_each(spark, clustered, monkeypatch):
    df, rows = clustered
    monkeypatch.setattr(many, "BLOCK", 3)
    monkeypatch.setattr(many, "STEP", 50)
    df = df.repartition(3)
    asked = [(i, rows[17 * i][2], t) for i, t in enumerate((["alpha"], ["beta", "alpha", "beta"], ["alpha", "gamma", "delta"], [], ["none"]))]
    asked += [(5, [0.0] * 12, ["delta"]), (6, None, None), (7, rows[3][2], ["beta", None])]
    questions = spark.createDataFrame(asked, "question_id long, vector array<float>, terms array<string>")
    sources = spark.createDataFrame([(f"s{i}", "document", f"p{i % 3}", dt.datetime(2024, 1, 1 + i % 28)) for i in range(190)], "source_id string, source_type string, project string, updated_at timestamp_ntz")
    options = SearchOptions(candidates=15, projects=("p1", "p2"))
    got = many.hybrid(df, sources, questions, options, as_of=F.lit(AS_OF).cast("timestamp_ntz")).orderBy("question_id", "rank").collect()
    for i, vector, terms in asked:
        mine = [(r.source_id, r.chunk_id, round(r.score, 6)) for r in got if r.question_id == i]
        if vector and any(vector):
            one = plans.hybrid(df.where("chunk_id < 702"), sources, vector, sorted({t for t in terms if t}), options, as_of=F.lit(AS_OF).cast("timestamp_ntz"))
            assert mine == [(r.source_id, r.chunk_id, round(r.score, 6)) for r in one.collect()]
        else:
            assert bool(mine) == (i == 5) and all(r.v_score == 0 for r in got if r.question_id == i)
    assert [r.rank for r in got if r.question_id == 0] == list(range(1, sum(r.question_id == 0 for r in got) + 1))
    assert many.hybrid(df, sources, questions.limit(0), options).count() == 0


def test_terms_beyond_the_list_are_joined(spark, clustered, monkeypatch):
    questions = spark.createDataFrame([(1, ["alpha", "beta"]), (2, ["gamma"])], "question_id long, terms array<string>")
    want = sorted(map(tuple, many.text_hits(clustered[0], questions).collect()))
    monkeypatch.setattr(many, "TERMS", 1)
    assert sorted(map(tuple, many.text_hits(clustered[0], questions).collect())) == want and want


def test_bounds_leave_postings_unread(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(400):  # one word everywhere, another in few texts and mostly once
        words = list(rng.choice(["apple", "stone", "river"], 60)) + ["zebra"] * (int(rng.integers(3, 9)) if i % 40 == 0 else i % 4 == 0)
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame([*rows, (900, None), (901, "zebra")], "chunk_id long, text string")
    path = f"file://{tmp_path}/p"
    write_counted_postings(df, path)
    for terms in (["appl", "zebra"], ["zebra"], ["river", "stone", "appl"], ["none", "appl"], []):
        want = [tuple(r) for r in plans.text_hits(df, terms, 10, stemmed=True).collect()]
        assert [tuple(r) for r in plans.bounded_text_hits(spark, path, terms, 10).collect()] == want
    got = plans.bounded_text_hits(spark, path, ["appl", "zebra"], 10)
    plan = got._jdf.queryExecution().executedPlan().toString()
    least = int(re.search(r"GreaterThanOrEqual\(count,(\d+)\)", plan)[1])
    assert least > 1 and counted_postings(spark, path, ["zebra"], least).count() < 0.2 * counted_postings(spark, path, ["zebra"]).count()


def test_an_index_and_attributes_in_a_corpus(spark, clustered, index):
    df, rows = clustered
    sources = spark.createDataFrame([(f"s{i}", "jira", f"ZZ-{i}", "ZZ", f"title {i}", "u", "body é" if i == 2 else "b", dt.datetime(2024, 1, 1)) for i in range(200)], "source_id string, source_type string, source_key string, project string, title string, url string, body string, updated_at timestamp_ntz")
    sources = sources.withColumn("extra", F.when(F.col("source_id") == "s2", F.parse_json(F.lit('{"status": "Open", "issue_type": "Bug", "assignee": "ann"}'))))
    embed = lambda q: rows[40][2]
    plain, indexed = (Corpus(sources, df.where("chunk_id < 700"), embed, index=i) for i in (None, index))
    want = [(r.source_id, r.score) for r in plain.search("alpha beta", as_of=F.lit(AS_OF).cast("timestamp_ntz")).orderBy("rank").collect()]
    assert [(r.source_id, r.score) for r in indexed.search("alpha beta", as_of=F.lit(AS_OF).cast("timestamp_ntz")).orderBy("rank").collect()] == want
    rules, asked = indexed.messages("what of ZZ-2")
    assert rules["role"] == "system" and "[^1]" in rules["content"]
    prompt = asked["content"]
    assert "[1] title 2 — u\nStatus: Open | Type: Bug | Assignee: ann | Updated: 2024-01-01\nbody é" in prompt


def test_budgets_count_bytes(spark):
    def one(c):
        return spark.range(1).select(c).first()[0]

    text = "aé日😀" * 3
    for n in range(32):
        assert one(cut_bytes(F.lit(text), n)) == text.encode()[:n].decode(errors="ignore")
    assert one(truncated(F.lit("  éé  "), 3)) == "é…" and one(truncated(F.lit("éé"), 4)) == "éé"
    assert len(one(title_of(F.lit("日" * 100), F.lit("f"), F.lit("text"))).encode()) == 198
    hits = spark.createDataFrame([(1, 1, "h\n", "é" * 20, None), (1, 2, "h\n", "s", "é" * 30)], "query_id int, rank int, head string, snippet string, body string")
    row = plans.context(hits, 100, 21).first()
    assert row.context == "[1] h\n" + "é" * 20 + "\n\n[2] h\n" + "é" * 10 + "\n[truncated]\n\n" and row.used == len(row.context.encode())
    assert plans.context(hits, 60, 21).first().context.endswith("[2] h\ns\n\n") and plans.context(hits, 50, 21).first().entries == 1
