"""Operators on small fixtures."""

import datetime as dt
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import text as fn
from millrace.functions.english import query_lexemes, stem
from millrace.functions import vectors
from millrace.functions.headline import snippet
from millrace.operators import chunking, convert, embed, loads, markup, page_links
from millrace.options import ChunkOptions, SearchOptions, checked_query
from millrace.plans import search
from millrace.sources import feeds, remote
from millrace.streaming import sync


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text,keys",
    [
        ("see ZX-731 now", ["ZX-731"]), ("A-1 AB-1 AB_C-22, AB-1", ["AB-1", "AB_C-22"]), ("zx-731", []), ("xZX-731 ZX-731x", []),
        ("éZX-731", ["ZX-731"]), ("", []), (" ".join(f"K{i}A-{i}" for i in range(9)), [f"K{i}A-{i}" for i in range(5)]),
    ],
)
def test_keys(spark, text, keys):
    assert one(spark, fn.ticket_keys(F.col("t")), t=text) == keys


def test_labels(spark):
    assert [one(spark, fn.human_bytes(F.col("n")), n=n) for n in (0, 5, 1023, 1024, 1536, 5 * 1024**2, 3 * 1024**4)] == [
        "-", "5 B", "1023 B", "1.0 KB", "1.5 KB", "5.0 MB", "3.0 TB",
    ]
    assert one(spark, fn.link_kind(F.col("k")), k="  Is Blocked   By ") == "is_blocked_by"
    assert one(spark, fn.titled(F.col("k")), k="  ") == "(untitled)"
    assert one(spark, fn.only_marks(F.col("k")), k="<b><mark>x</mark>") == "&lt;b&gt;<mark>x</mark>"
    assert [one(spark, fn.document_kind(F.col("a"), F.col("b")), a=a, b=b) for a, b in (("text/markdown", ""), ("TEXT/HTML; x", ""), ("", "a.md"), ("application/octet-stream", "a.PDF"), ("image/png", "a.md"), ("", "a"))] == ["markdown", "html", "markdown", "pdf", None, None]


def test_stems():
    for w, s in {
        "consistency": "consist", "running": "run", "relational": "relat", "hopping": "hop", "happy": "happi", "flies": "fli",
        "controlling": "control", "dying": "die", "hoping": "hope", "adjustable": "adjust",
    }.items():
        assert stem(w) == s
    assert query_lexemes("The runners are running and RUNNING") == ["runner", "run"]


def test_cover_density(spark):
    rows = [(1, "cat x dog y cat", 0), (2, "dog dog", 0), (3, "cat cat dog", 0)]
    c = spark.createDataFrame(rows, ["chunk_id", "text", "z"])
    got = {r.chunk_id: r.f_score for r in search.text_hits(c, ["cat", "dog"]).collect()}
    assert got == {1: pytest.approx(0.1), 3: pytest.approx(0.1)}
    assert {r.chunk_id: r.f_score for r in search.text_hits(c, ["cat"]).collect()} == {1: pytest.approx(0.2), 3: pytest.approx(0.2)}
    assert search.text_hits(c, []).count() == 0


def corpus(spark):
    v = lambda *x: [float(i) for i in x]
    chunks = spark.createDataFrame(
        [(1, "a", v(1, 0), "alpha beta"), (2, "a", v(0.9, 0.1), "beta"), (3, "b", v(0, 1), "alpha alpha"), (4, "c", v(-1, 0), "gamma")],
        "chunk_id long, source_id string, embedding array<float>, text string",
    )
    t = lambda d: dt.datetime(2024, 1, d)
    sources = spark.createDataFrame(
        [("a", "jira", "P", t(1)), ("b", "document", "Q", t(2)), ("c", "jira", None, t(3))],
        "source_id string, source_type string, project string, updated_at timestamp_ntz",
    )
    return chunks, sources


def test_hybrid(spark):
    chunks, sources = corpus(spark)
    rows = search.hybrid(chunks, sources, [1.0, 0.0], ["alpha"], SearchOptions(decay_days=0)).collect()
    assert [r.source_id for r in rows] == ["a", "b", "c"]
    assert rows[0].chunk_id == 1 and rows[0].score == pytest.approx(0.6 + 0.4 * 0.5)
    assert rows[1].score == pytest.approx(0.4) and rows[2].score == pytest.approx(-0.6)
    only = search.hybrid(
        chunks, sources, [1.0, 0.0], ["alpha"], SearchOptions(source_types=("document",), updated_after="2024-01-01 12:00:00"),
    ).collect()
    assert [r.source_id for r in only] == ["b"]
    aged = search.hybrid(chunks, sources, [1.0, 0.0], [], SearchOptions(), as_of=F.lit("2024-01-03 00:00:00").cast("timestamp_ntz")).collect()
    assert {r.source_id: r.score for r in aged}["c"] == pytest.approx(-0.6 * 1.05)
    assert SearchOptions(vector_weight=0.3).weights() == (0.3, 0.0) and SearchOptions().weights() == (0.6, 0.4)


def test_merged(spark):
    named = spark.createDataFrame([("n", 1), ("m", 2)], ["source_id", "ord"])
    ranked = spark.createDataFrame([("m", 0.9), ("x", 0.8), ("y", 0.7)], ["source_id", "score"])
    assert [r.source_id for r in search.merged(named, ranked, 3).collect()] == ["n", "m", "x"]


def test_context(spark):
    hits = spark.createDataFrame(
        [(1, 1, "h\n", "s" * 10, ""), (1, 2, "h\n", "t", "b" * 30), (1, 3, "h\n", "u" * 100, ""), (1, 4, "h\n", "v", "")],
        ["query_id", "rank", "head", "snippet", "body"],
    )
    row = search.context(hits, 50, 20).first()
    assert row.context.startswith("[1] h\nssssssssss\n\n[2] h\n" + "t") and row.entries == 2
    assert "[truncated]" in search.context(hits, 90, 20).first().context


def test_options():
    with pytest.raises(ValueError):
        ChunkOptions(10, 10)
    with pytest.raises(ValueError):
        checked_query(" ")
    with pytest.raises(ValueError):
        checked_query("é" * 257)
    with pytest.raises(ValueError):
        SearchOptions(limit=51)


def test_chunks(spark):
    body = "one two three.\n\n" + " ".join(f"w{i}." for i in range(25)) + "\n\nlast words here"
    docs = spark.createDataFrame([(1, "T", body), (2, "T", "  "), (3, "T", "short")], ["doc_id", "title", "body"])
    rows = chunking.document_chunks(docs, ChunkOptions(10, 2)).orderBy("doc_id", "chunk_index").collect()
    assert [r.content for r in rows if r.doc_id == 3] == ["# T\n\nshort"] and not [r for r in rows if r.doc_id == 2]
    mine = [r for r in rows if r.doc_id == 1]
    assert [r.chunk_index for r in mine] == list(range(len(mine))) and len(mine) > 2
    assert all(r.token_count == len(r.content.split()) for r in mine)
    text = " ".join(r.content for r in mine)
    assert all(f"w{i}." in text for i in range(25)) and "last words here" in text
    for a, b in zip(mine, mine[1:]):
        assert b.content.split()[:2] == a.content.split()[-2:]
    pages = spark.createDataFrame([(1, "intro\n# A\ntext\n\n## B\nmore\n#### deep\n")], ["doc_id", "body"])
    assert [r.content for r in chunking.page_chunks(pages).orderBy("chunk_index").collect()] == ["intro", "# A\ntext", "## B\nmore\n#### deep"]


def test_issue_chunks(spark):
    schema = "key string, title string, description string, comments array<struct<author:string,created_at:string,body:string>>"
    said = [("ann", "2024-03-01T10:00:00Z", "a b c\n"), (None, None, "d " * 9)]
    issues = [("K-1", "T", "desc\n\n", said), ("K-2", "T", "x " * 30, None), ("K-3", "T", None, [])]
    rows = chunking.issue_chunks(spark.createDataFrame(issues, schema), ChunkOptions(15, 2)).orderBy("key", "chunk_index").collect()
    got = {k: [(r.chunk_kind, r.content) for r in rows if r.key == k] for k in ("K-1", "K-2", "K-3")}
    first = "# T (K-1)\n\ndesc\n\n\n## Comment by ann on 2024-03-01\n\na b c"
    assert got["K-1"] == [("body", first), ("comment", "b c ## Comment" + " d" * 9)]
    # an overflowing description stays body, and what overflows is cut where the budget ends
    assert [k for k, _ in got["K-2"]] == ["body"] * 3 and all(r.token_count <= 15 for r in rows)
    assert got["K-2"][0][1] == "# T (K-2)" + " x" * 12 and got["K-3"] == [("body", "# T (K-3)\n\n")]


def test_chunks_by_a_tokenizer_file(spark):
    path = os.path.join(os.environ.get("MILLRACE_TOKENIZERS", "/opt/tokenizers"), "byte_bpe_50k.json")
    if not os.path.exists(path):
        pytest.skip("no tokenizer file")
    from tokenizers import Tokenizer

    docs = spark.createDataFrame([(1, "T", "Unbelievably long words " * 20)], ["doc_id", "title", "body"])
    rows = chunking.document_chunks(docs, ChunkOptions(30, 4), encoder=chunking.file_encoder(path)).collect()
    t = Tokenizer.from_file(path)
    assert len(rows) > 3 and all(r.token_count == len(t.encode(r.content, add_special_tokens=False).ids) for r in rows)


def test_markup():
    tree = {"type": "doc", "content": [
        {"type": "heading", "attrs": {"level": 9}, "content": [{"type": "text", "text": "H"}]},
        {
            "type": "bulletList",
            "content": [{"type": "listItem", "content": [{"type": "paragraph", "content": [{"type": "text", "text": "a", "marks": [{"type": "strong"}, {"type": "link", "attrs": {"href": "u"}}]}]}, {"type": "orderedList", "content": [{"type": "listItem", "content": [{"type": "paragraph", "content": [{"type": "text", "text": "b"}]}]}]}]}],
        },
        {"type": "panel", "attrs": {"panelType": "warning"}, "content": [{"type": "paragraph", "content": [{"type": "text", "text": "w"}]}]},
        {"type": "rule"}, {"type": "media"},
    ]}
    assert markup.markdown(markup.from_json(tree)) == "###### H\n\n- [**a**](u)\n  1. b\n\n> **Warning:** w\n\n---\n"
    page = '<p>x&nbsp;<b>y</b></p><p>&nbsp;</p><ac:structured-macro ac:name="code"><ac:parameter ac:name="language">py</ac:parameter><ac:plain-text-body><![CDATA[a < b]]></ac:plain-text-body></ac:structured-macro><p><ac:link><ri:page ri:content-title="T" ri:space-key="S"/></ac:link></p><table><tr><th>a|b</th><th>c</th></tr><tr><td>1</td></tr></table><ac:structured-macro ac:name="toc"/>'
    assert markup.markdown(markup.from_storage(page)) == "x **y**\n\n```py\na < b\n```\n\n⟦pg-title:S|T|T⟧\n\n| a\\|b | c |\n| --- | --- |\n| 1 |  |\n"


def test_page_links(spark):
    bodies = spark.createDataFrame([(1, "a ⟦pg-id:7|x⟧ b ⟦pg-title:|T|y⟧⟦pg-title:S|no|z⟧ c"), (2, "plain")], ["doc_id", "body"])
    pages = spark.createDataFrame([(7, "S", "T", "u7"), (8, "R", "T", "u8")], ["number", "space", "title", "url"])
    got = {r.doc_id: r.body for r in page_links.resolved(bodies, pages).collect()}
    assert got == {1: "a [x](u7) b [y](u7)z c", 2: "plain"}


def test_loads(spark):
    stored = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], ["k", "v", "t"])
    incoming = spark.createDataFrame([(2, "c", 2), (2, "d", 3), (3, "e", 1)], ["k", "v", "t"])
    assert sorted(map(tuple, loads.upsert(stored, incoming, "k", [F.col("t")]).collect())) == [(1, "a", 1), (2, "d", 3), (3, "e", 1)]
    assert loads.next_watermark(stored.where("k > 9"), F.lit(0), "t").first()[0] is None
    assert loads.next_watermark(stored, F.lit(5), "t").first()[0] == 5
    edges = spark.createDataFrame(
        [("a", "jira", " b ", "x"), ("a", "jira", "b", "x"), ("a", "jira", "a", "x"), ("a", "", "c", "x")],
        ["source_id", "target_type", "target_key", "kind"],
    )
    assert [tuple(r) for r in loads.replace_edges(edges.where("false"), edges).collect()] == [("a", "jira", "b", "x")]


def test_feeds(spark):
    now = dt.datetime(2026, 1, 1, 12)
    assert remote.remote_predicate(["A", "B"], now - dt.timedelta(minutes=5), now) == 'project in ("A", "B") AND updated >= -6m ORDER BY updated ASC'
    assert "1970" in remote.remote_predicate([], None, now)


def test_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("# Head\nbody")
    (tmp_path / "b.html").write_text("<title>T</title><script>x</script><h1>H</h1><p>p &amp; q<li>i")
    (tmp_path / "c.pdf").write_bytes(b"%PDF")
    got = {r.filename: r for r in feeds.uploaded(spark, str(tmp_path)).collect()}
    assert got["a.md"].title == "Head" and got["b.html"].title == "T" and got["c.pdf"].body is None
    assert got["b.html"].body == "# T\n\n\n\n# H\n\n\n\np & q\n\n- i\n"


def test_embedding(spark):
    v = embed.hash_vector("x", 50)
    assert abs(np.linalg.norm(v) - 1) < 1e-5 and (v == embed.hash_vector("x", 50)).all() and (v != embed.hash_vector("y", 50)).any()
    rows = spark.createDataFrame([("a",), ("b",)], ["text"])
    with pytest.raises(Exception, match="another number"):
        embed.embed(rows, lambda t: [[0.0]] * len(t), dimension=2).collect()


def test_snippet():
    both = frozenset({"cat", "dog"})
    words = [f"word{i}" for i in range(60)]
    words[30], words[33], words[50], words[51], words[52] = "Cat,", "dog's", "cat", "dog", "cat"
    best = snippet(" ".join(words), both, 5, 10)
    assert best == "<mark>cat</mark> <mark>dog</mark> <mark>cat</mark> word53 word54"
    assert snippet(" ".join(words[:40]), both, 5, 10) == "<mark>Cat,</mark> word31 word32 <mark>dog's</mark> word34"
    assert snippet(" ".join(words[:34]), both, 6, 10) == "word28 word29 <mark>Cat,</mark> word31 word32 <mark>dog's</mark>"  # stretched to the left where the text ends
    far = ["cat", *["x"] * 6, "long", "y", "z", "y", "dog"]
    assert snippet(" ".join(far), both, 4, 10) == "<mark>cat</mark> x x x x x x long"  # cut after ten words, and back over short ones
    assert snippet("cat dog to be or not to think of", both, 3, 9) == "<mark>cat</mark> <mark>dog</mark> to be or not to think"  # on to a longer word
    assert snippet("only the cat is here", both, 3, 9) == "only the <mark>cat</mark>" and snippet("", both) == ""  # no cover: the first words
    assert snippet("a b", frozenset(), 1, 2) == "a"


def test_stream_replay(spark, tmp_path):
    schema = "k long, v string, t long"
    spark.createDataFrame([(1, "a", 1), (2, "b", 1)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    out = f"file://{tmp_path}/out"
    sync.sync(read(), out, "k", [F.col("t")])
    spark.createDataFrame([(2, "c", 2)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    sync.sync(read(), out, "k", [F.col("t")])
    sync.sync(read(), out, "k", [F.col("t")])
    store = sync.stream_store(spark, out, read().schema, "k")
    assert sorted(map(tuple, store.read("rows").collect())) == [(1, "a", 1), (2, "c", 2)] and store.snapshot().report == {"batch": 1}


def test_ancestors_of_any_depth_and_cycles(spark):
    chain = [(i, i - 1 if i else None) for i in range(70)]
    rows = spark.createDataFrame([*chain, (100, 101), (101, 100), (102, 101), (103, 103), (104, 999)], "id long, parent_id long")
    got = {r.id: r for r in feeds.ancestors(rows).collect()}
    assert all(got[i].path == list(range(i)) and got[i].complete for i in range(70))
    assert all(not got[i].complete and got[i].path == [] for i in (100, 101, 102, 103)) and got[104].path == [999]


def test_new_hashes_come_once(spark):
    stored = spark.createDataFrame([("a", 1)], "sha string, id int")
    incoming = spark.createDataFrame([("a", 2), ("b", 4), ("b", 3), ("c", 5)], "sha string, id int")
    known, new = loads.known_and_new(incoming, stored)
    assert [tuple(r) for r in known.collect()] == [("a", 2)] and sorted(map(tuple, new.collect())) == [("b", 3), ("c", 5)]


def test_vector_bytes(spark):
    rows = spark.createDataFrame([(1, [1.0, -2.5]), (2, []), (3, None)], "k int, v array<float>")
    got = {r.k: r for r in rows.select("k", vectors.vector_bytes(F.col("v")).alias("b")).withColumn("v", vectors.vector_of_bytes(F.col("b"))).collect()}
    assert bytes(got[1].b) == np.array([1.0, -2.5], "<f4").tobytes() and got[1].v == [1.0, -2.5] and got[2].b is None and got[3].v is None
    assert one(spark, vectors.vector_of_bytes(F.col("b")), b=b"abcde") is None


def test_a_later_run_goes_on_from_the_kept_mark(spark, tmp_path):
    schema = "k long, v string, t long"
    spark.createDataFrame([(1, "a", 1)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    out = f"file://{tmp_path}/out"
    assert [tuple(r) for r in sync.synced(spark, str(tmp_path / "in"), "k", [F.col("t")], folder=out).collect()] == [(1, "a", 1)]
    for n in (2, 3):
        spark.createDataFrame([(n, "b", n)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        got = sync.synced(spark, str(tmp_path / "in"), "k", [F.col("t")], folder=out)
        assert got.count() == n
    assert len([p for p in os.listdir(tmp_path / "out" / "table" / "manifests") if p.endswith(".json")]) == 2  # older versions are gone


def test_page_text():
    assert convert.page_text("1 < 2 and <code>k</code>") == "1 < 2 and \n```\nk\n```\n"
    html = "<title> A &amp; B </title><style>p{}</style><body><h1>H&eacute;<h2>I</h2><p>a<b>b</b><br>c<p>d &#8217;&mdash;</div>loose<!-- no --><br><ul><li>one<ul><li>in</ul><li>two</ul><pre>\nx\n  y</pre>"
    assert convert.page_text(html) == (
        "# A & B\n\n\n\n# Hé\n\n\n\n## I\n\n\n\nabc\n\n\n\nd ’—\n\nloose   \n- onein\n- two\n\n```\nx\n  y\n```\n"
    )
    assert convert.page_text("") == "\n" and convert.page_text("<script>if (a<b) {}</script><template><p>no</template>x") == "x\n"


def test_vectors_go_through_the_cache(spark):
    cached = spark.createDataFrame([(vectors_key(t), v) for t, v in (("a", [1.0, 2.0]), ("b", [1.0]))], "key string, vector array<float>")
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "c"), (5, None)], "k int, text string")
    whole, after = embed.through_cache(rows, cached, lambda texts: [[float(ord(t)), 0.0] for t in texts], model="m", dimension=2)
    got = {r.k: (r.hit, r.embedding) for r in whole.collect()}
    assert got == {1: (True, [1.0, 2.0]), 2: (False, [98.0, 0.0]), 3: (False, [99.0, 0.0]), 4: (False, [99.0, 0.0]), 5: (False, None)}
    assert sorted(r.key for r in after.collect()) == sorted(map(vectors_key, "abc")) and all(len(r.vector) == 2 for r in after.collect())
    again, _ = embed.through_cache(rows, after, lambda t: 1 / 0, model="m", dimension=2)
    assert all(r.hit for r in again.where("text is not null").collect())


def vectors_key(text):
    import hashlib

    return "emb:v1:" + hashlib.md5(f"m|{text}".encode()).hexdigest()


def test_kept_vectors_expire(spark, tmp_path):
    import time

    from millrace.streaming import cache

    source = f"{tmp_path}/in"

    def ask(*texts):
        spark.createDataFrame([(t,) for t in texts], "text string").withColumn("asked_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("text string, asked_at timestamp").parquet(source)
        found = cache.answered(spark, cache.cached_vectors(stream, lambda t: embed.hash_batch(t, 4), model="m", dimension=4, seconds=30), f"file://{tmp_path}/out")
        last = found.agg(F.max("batch")).first()[0]
        return sorted((r.text, r.hit) for r in found.where(F.col("batch") == last).collect())

    begun = time.time()
    assert ask("a", "a", "b", None) == [("a", False), ("a", True), ("b", False)]
    again = ask("a", "c")
    assert again == [("a", time.time() - begun < 30 or again[0][1]), ("c", False)]
    time.sleep(31)
    assert ask("a", "a") == [("a", False), ("a", True)]
