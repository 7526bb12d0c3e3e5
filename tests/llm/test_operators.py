"""Every operator on awkward rows, empty tables, and against plain versions."""

import functools
import glob
import hashlib
import math
import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import ann, katz, language_id, line_dedup, mixing, ngram_join, packing, pii, quality, queries, token_counts
from millrace.llm.common import documents, materialize, tokenizer_file

from . import helpers as H

RUNS = {
    "lines": lambda d: line_dedup.line_dedup(d, min_chars=10, min_docs=2),
    "pii": pii.find_personal_data,
    "tokens": lambda d: token_counts.token_counts(d, tokenizer_file("word_bpe_49k.json")),
    "nearest": lambda d: ann.search(d.select(F.col("doc_id").alias("vec_id"), F.array(F.col("n_chars").cast("float"), F.lit(1.0)).alias("embedding")), F.lit(True), k=3),
    "join": lambda d: ngram_join.near_duplicates(d),
    "quality": quality.quality_rules,
    "language": lambda d: language_id.identify(d, language_id.learn(d)),
    "katz": lambda d: katz.katz_scores(d, F.col("doc_id") % 2 == 0),
    "mix": lambda d: mixing.mix(d, {"s": 0.7}),
    "pack": lambda d: packing.pack(d, "doc_id", "text", tokenizer_file("byte_bpe_50k.json"), capacity=128, fragment=32, group=16),
}


@pytest.mark.parametrize("name", sorted(RUNS))
def test_awkward_rows(spark, name):
    n = RUNS[name](H.awkward(spark)).count()
    if name not in ("nearest", "pack"):
        assert n == len(H.AWKWARD)


@pytest.mark.parametrize("name", sorted(RUNS))
def test_empty_table(spark, name):
    assert RUNS[name](H.empty(spark)).count() == 0


def test_lines(spark):
    line = "A shared line that is long enough to be counted"
    rows = [(
        i, f"{line.upper() if i == 2 else line}\nown {i}\n{line}", "en", "s", 1,
    ) for i in range(1, 6)] + [(9, line[:20], "en", "s", 1), (10, None, "en", "s", 1)]
    got = {r.doc_id: r for r in line_dedup.line_dedup(spark.createDataFrame(rows, H.DOCS), min_chars=40, min_docs=5).collect()}
    assert got[1].text == "own 1" and got[1].n_dropped == 2 and got[1].n_lines == 3
    assert got[5].n_dropped == 0 and got[5].text == f"{line}\nown 5\n{line}"
    assert got[9].n_lines == 1 and got[10].text is None and got[10].n_lines == 1


def test_lines_null_and_repeated_ids(spark):
    rows = H.awkward(spark)
    got = line_dedup.line_dedup(rows, min_chars=10, min_docs=1).where("doc_id = 5 or doc_id is null").collect()
    assert all(r.n_dropped == 0 for r in got)


def test_personal_data(spark):
    random.seed(5)
    pool = list("1234567890" * 3 + "..@@+-  ()ab:é")
    rows = [(i, "".join(random.choice(pool) for _ in range(random.randint(0, 80))), "en", "s", 1) for i in range(2000)]
    rows += [(5000, "a@b.c@d.e x@y 1.2.3.4.5.6.7.8 999.1.1.1 " + "1" * 30_000 + " tel +1 (222) 333-4444 card 4111 1111 1111 1111", "en", "s", 1)]
    got = {r.doc_id: r for r in pii.find_personal_data(spark.createDataFrame(rows, H.DOCS)).collect()}
    for i, text, *_ in rows:
        if i < 5000:
            assert [tuple(s) for s in got[i].base] == H.base_spans(text)
            assert set(map(tuple, got[i].base)) <= set(map(tuple, got[i].spans))
    assert [s.kind for s in got[5000].base] == ["email", "ip", "ip", "card", "phone"]


def test_personal_data_bootstraps(spark):
    named = [(i, f"you can call my number {'+1 (555) 010-%04d' % i} tonight", "en", "s", 1) for i in range(30)]
    unseen = [(100, "you can call my number 555 010 7777 tonight", "en", "s", 1), (101, "they scored 555 010 7777 points", "en", "s", 1)]
    got = {r.doc_id: r for r in pii.find_personal_data(spark.createDataFrame(named + unseen, H.DOCS)).collect()}
    assert got[100].n_phone == 0 and [s.kind for s in got[100].spans] == ["phone"]
    assert not pii.find_personal_data(spark.createDataFrame(unseen, H.DOCS)).where(F.size("spans") > 0).count()


def test_personal_data_found_in_one_round_induces_the_next(spark):
    rows = [(i, f"you can call my number {'+1 (555) 010-%04d' % i} tonight", "en", "s", 1) for i in range(30)]
    for i in range(100, 112):  # twelve unseen numbers in the seeds' context and, once more each, in one without any seed
        rows += [
            (i, f"you can call my number 555 010 7{i} tonight", "en", "s", 1),
            (i + 100, f"please fax paper to 555 010 7{i} before noon", "en", "s", 1),
        ]
    rows += [(300, "please fax paper to 555 010 9999 before noon", "en", "s", 1), (301, "please bring 555 010 9998 stones", "en", "s", 1)]
    got = {r.doc_id: r for r in pii.find_personal_data(spark.createDataFrame(rows, H.DOCS)).collect()}
    assert [s.kind for s in got[300].spans] == ["phone"] and not got[301].spans


def test_personal_data_kinds_by_context(spark):
    rows = [(i, f"you can call my number {'+1 (555) 010-%04d' % i} tonight", "en", "s", 1) for i in range(30)]
    rows += [(100, "you can call my number 0049 170 5550 1077 tonight", "en", "s", 1)]  # 15 digits: a card's count too
    got = {r.doc_id: r for r in pii.find_personal_data(spark.createDataFrame(rows, H.DOCS)).collect()}
    assert [s.kind for s in got[100].spans] == ["phone"]
    assert pii.loose_spans("0049 170 5550 1077", []) == [(2, 0, 18), (3, 0, 18)]


def test_token_counts(spark, folder):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    odd = [
        "", "  ", "<|endoftext|>Hello’s world's 12345 <|startoftext|><|endoftext|>", "Ａｂｃ İstanbul é ﬁ", "\x00\x1c a b　c", "日本語テキスト१२३",
        "don'T we'LL", "a" * 3000, "😀👍🏽",
    ]
    rows = [(i, x, "en", "s", 1) for i, x in enumerate(odd)]
    got = {r.doc_id: r for r in token_counts.token_counts(spark.createDataFrame(rows, H.DOCS), tokenizer_file("word_bpe_49k.json")).collect()}
    assert all(got[i].n_tokens == len(t.encode(x, add_special_tokens=False).ids) and got[i].n_bytes == len(x.encode()) for i, x in enumerate(odd))
    for r in queries.op3_token_counts(spark, folder).join(documents(spark, folder), "doc_id").collect():
        assert r.n_tokens == len(t.encode(r.text, add_special_tokens=False).ids) and r.over_limit == (r.n_tokens > 2048)


def test_nearest_recall_and_scores(spark, folder):
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").toPandas()
    x, ids = np.stack(rows["embedding"]).astype(float), rows["vec_id"].to_numpy()
    got = queries.op4_nearest(spark, folder).toPandas()
    hit = total = 0
    for i in np.flatnonzero(ids % 20 == 0):
        s = x @ x[i]
        s[i] = -np.inf
        best = set(ids[np.lexsort((ids, -s))[:20]])
        mine = got[got["query_id"] == ids[i]].sort_values("rank")
        assert list(mine["rank"]) == list(range(1, 21)) and np.allclose(mine["score"], [x[ids == v][0] @ x[i] for v in mine["vec_id"]])
        hit, total = hit + len(best & set(mine["vec_id"])), total + 20
    assert hit / total >= 0.9


def recall(x, ids, got, queries, k=20):
    hit = 0
    for i in queries:
        s = x @ x[i]
        s[i] = -np.inf
        mine = got[got["query_id"] == ids[i]].sort_values("rank")
        assert list(mine["rank"]) == list(range(1, k + 1)) and np.allclose(mine["score"], s[np.searchsorted(ids, mine["vec_id"])])
        hit += len(set(ids[np.lexsort((ids, -s))[:k]]) & set(mine["vec_id"]))
    return hit / (k * len(queries))


def clustered(seed=3, clusters=120, each=30, d=32):
    rng = np.random.default_rng(seed)
    centers = rng.standard_normal((clusters, d))
    x = (centers[:, None] + 0.3 * rng.standard_normal((clusters, each, d))).reshape(-1, d)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_nearest_over_several_blocks(spark, monkeypatch):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").toPandas()
    x, ids = np.stack(rows["embedding"]).astype(float), rows["vec_id"].to_numpy()
    monkeypatch.setattr(ann, "BLOCK_ROWS", 300)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 40)
    got = queries.op4_nearest(spark, "/root/testdata/sf0.1").toPandas()
    assert recall(x, ids, got, np.flatnonzero(ids % 20 == 0)) >= 0.9


def test_nearest_probes_few_of_clustered_vectors(spark, monkeypatch):
    x = clustered()
    ids = np.arange(len(x))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    seen = []
    plain = ann.probed
    monkeypatch.setattr(ann, "probed", lambda *a: seen.append(plain(*a)) or seen[-1])
    got = ann.search(df, F.col("vec_id") % 20 == 0, k=20).toPandas()
    asked = np.flatnonzero(ids % 20 == 0)
    assert recall(x, ids, got, asked) >= 0.9
    assert len(seen) == 1 and seen[0].count() < 0.1 * len(x) * len(asked)
    codes = ann.fit(x, float(np.linalg.norm(x, axis=1).max()), 20, len(x))
    near = ann.hamming(ann.words(codes.bits(x[asked], True)), ann.words(codes.bits(x))) <= codes.radius
    assert seen[0].count() == near.sum()  # every code within the radius, and no other


def test_nearest_equal_vectors(spark):
    x = np.concatenate((clustered(clusters=10), np.repeat(clustered(9, 1, 1), 300, axis=0)))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.search(df, F.col("vec_id").isin(300, 301, 599), k=20).toPandas()
    for q, want in ((300, range(301, 321)), (301, [300, *range(302, 321)]), (599, range(300, 320))):
        assert list(got[got["query_id"] == q].sort_values("rank")["vec_id"]) == list(want)


def test_nearest_few_and_bad_vectors(spark):
    rows = [
        (0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.5, 0.5]), (3, [2.0, 0.0]), (4, None), (5, [0.0, 0.0]), (6, [None, 1.0]),
        (7, [float("nan"), 1.0]), (8, [1.0]), (9, [float("inf"), 0.0]),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.search(df, F.col("vec_id") == 0, k=20).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(1, 2.0), (3, 2.0), (2, 0.5)]


def test_join_against_brute_force(spark):
    random.seed(11)
    vocab = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(60):
        base = [random.choice(vocab) for _ in range(random.choice([3, 6, 12, 40, 150, 400]))]
        for _ in range(random.randint(1, 6)):
            w = list(base)
            for _ in range(random.choice([0, 0, 1, 1, 2, 5])):
                w[random.randrange(len(w))] = random.choice(vocab)
            texts.append(" ".join(w))
    texts += [None, "", "the same words", "The  SAME words"]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    random.shuffle(rows)
    for k, bound in ((4, Fraction(85, 100)), (5, Fraction(4, 5)), (2, Fraction(1, 2))):
        want = H.components({i: H.shingles(t, k) for i, t, *_ in rows}, bound.numerator, bound.denominator)
        got = {r.doc_id: r for r in ngram_join.near_duplicates(spark.createDataFrame(rows, H.DOCS), k=k, threshold=bound).collect()}
        assert {i: r.component_id for i, r in got.items()} == want
        assert all(got[i].n_shingles == len(H.shingles(t, k)) for i, t, *_ in rows)


def test_join_repeated_ids(spark):
    t = [" ".join(f"{p}{i}" for i in range(30)) for p in "abc"]
    rows = [(1, t[0], "", "", 1), (2, t[0], "", "", 1), (2, t[1], "", "", 1), (3, t[1], "", "", 1), (4, t[2], "", "", 1), (None, t[2], "", "", 1)]
    got = [(r.doc_id, r.component_id) for r in ngram_join.near_duplicates(spark.createDataFrame(rows, H.DOCS)).collect()]
    assert sorted(got, key=str) == sorted([(1, 1), (2, 1), (2, 1), (3, 1), (4, 4), (None, 4)], key=str)


def test_regions_never_miss(spark):
    """Two sets within the distance share a key, whatever their sizes."""
    rng = np.random.default_rng(3)
    for bound in (Fraction(85, 100), Fraction(4, 5)):
        r = ngram_join.Regions(bound)
        for _ in range(400):
            n = int(rng.integers(4, 300))
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
            most = int((1 - bound) * len(a) / 2)
            drop = int(rng.integers(0, most + 1))
            b = np.unique(np.concatenate((a[drop:], rng.integers(0, 1 << 63, int(rng.integers(0, most + 1)), dtype=np.uint64))))
            both = len(np.intersect1d(a, b))
            if 0 < both and Fraction(both, len(a) + len(b) - both) >= bound and len(np.setxor1d(a, b)):
                mine, theirs = ({c: (need, k) for c, need, k in r.keys(x)} for x in (a, b))
                shared = {c: len(np.intersect1d(mine[c][1], theirs[c][1])) for c in mine.keys() & theirs.keys()}
                assert any(n >= max(mine[c][0], theirs[c][0]) for c, n in shared.items())


def edited(words, rng, edits, vocab):
    """The words after some of them have been replaced, dropped or doubled."""
    w = list(words)
    for _ in range(edits):
        at, kind = rng.randrange(len(w)), rng.random()
        w[at : at + 1] = [rng.choice(vocab)] if kind < 0.6 else [] if kind < 0.8 else [w[at], w[at]]
    return w


def test_join_of_many_variants(spark, monkeypatch):
    """Variants of one text about as far from each other as the threshold, in regions that have to be split again."""
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(3000)]
    texts = []
    for size in (40, 90, 160):
        base = rng.choices(vocab, k=size)
        families = [edited(base, rng, n, vocab) for n in (0, size // 20, size // 12, size // 8)]
        for f in families:  # sub-families share edits, so that differences from the pivot are alike, too
            texts += [" ".join(edited(f, rng, rng.choice([0, 1, 2, size // 25, size // 12]), vocab)) for _ in range(30)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for small, k, bound in ((2, 4, Fraction(85, 100)), (1024, 5, Fraction(4, 5))):
        monkeypatch.setattr(ngram_join, "SMALL", small)
        want = H.components({i: H.shingles(t, k) for i, t in rows}, bound.numerator, bound.denominator)
        assert len(set(want.values())) > 20
        got = ngram_join.near_duplicates(df.repartition(6), k=k, threshold=bound).collect()
        assert {r.doc_id: r.component_id for r in got} == want


def test_join_of_variants_takes_few_levels(spark, monkeypatch):
    """What a pivot alone has changed, all others have more: shown first, it would keep a region together at every level."""
    rng = random.Random(9)
    vocab, base = [f"n{i}" for i in range(9000)], [f"w{i}" for i in range(120)]
    rows = []
    for i in range(120):
        w = list(base)
        for at in rng.sample(range(120), rng.choice([1, 2, 3, 4])):
            w[at] = rng.choice(vocab)
        rows.append((i, " ".join(w)))
    written, write = [], ngram_join.materialize
    monkeypatch.setattr(ngram_join, "materialize", lambda df, name="table", by=None: written.append(name) or write(df, name, by))
    monkeypatch.setattr(ngram_join, "SMALL", 60)
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=5, threshold=Fraction(4, 5)).collect()
    assert {r.doc_id: r.component_id for r in got} == H.components({i: H.shingles(t, 5) for i, t in rows}, 4, 5)
    assert written.count("balls") <= 2


def test_join_keeps_one_row_of_each_component(spark):
    t = [" ".join(f"{p}{i}" for i in range(30)) for p in "abc"]
    rows = [(2, t[0], 1), (1, t[0], 2), (1, t[1], 3), (None, t[1], 4), (None, t[2], 5), (None, t[2], 6), (7, None, 7), (7, "", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int")
    got = ngram_join.near_duplicates(df, carry=["doc_id", "text", "n"]).where("first").collect()
    assert sum(r.n in (2, 3) for r in got) == 1 and sum(r.n in (5, 6) for r in got) == 1 and {7, 8} <= {r.n for r in got} and len(got) == 4


def test_quality_counts(spark):
    texts = ["a b c a b c d", "x\nx\n\n y\nx", "# $ a|b <c>", None, " ".join(f"u{i}" for i in range(60))]
    got = {r.doc_id: r for r in quality.quality_rules(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], H.DOCS)).collect()}
    assert (got[0].n_words, got[0].word_chars, got[0].n_repeat_words) == (7, 7, 6)
    assert got[1].n_dup_lines == 2 and got[2].n_symbols == 5 and got[3].n_words == 0
    assert got[4].base_failed is False and got[0].base_failed and not got[0].kept

    for t in [r.text for r in documents(spark, "/root/testdata/sf0.001").limit(40).collect()]:
        w = t.encode().split()
        seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        cover = {i + j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in range(3)}
        base = quality.statistics(t)[0]
        lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        assert base == [len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover)]


def test_quality_keeps_good_and_drops_outliers(spark):
    found = queries.op6_quality_rules(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    r = found.where("not base_failed").agg(
        F.avg(F.when(F.col("quality") == 1, F.col("kept").cast("int"))).alias("good"),
        F.avg(F.when(F.col("quality") == 0, F.col("kept").cast("int"))).alias("bad"),
    ).first()
    assert r.good > 0.97 and r.bad < 0.5


def plain_mcd(x, share, start):
    """Concentration steps on rows in memory, until nothing moves."""
    center, inverse = np.median(x, axis=0), np.diag(1 / quality.FLOORS) if start is None else start
    last = None
    while True:
        d = np.einsum("ni,ij,nj->n", x - center, inverse, x - center)
        inner = np.argsort(d, kind="stable")[: int(np.ceil(share * len(x)))]
        if last is not None and set(inner) == last:
            return center, np.cov(x[inner].T, bias=True) + np.diag(quality.FLOORS)
        last = set(inner)
        center = x[inner].mean(axis=0)
        inverse = np.linalg.inv(np.cov(x[inner].T, bias=True) + np.diag(quality.FLOORS))


def test_quality_fits_against_plain_estimate(spark):
    rng = np.random.default_rng(11)
    turn = rng.normal(size=(quality.P, quality.P)) * 0.3
    x = rng.normal(size=(1200, quality.P)) @ turn
    x[:150] = rng.normal(3, 0.1, size=(150, quality.P))
    df = spark.createDataFrame([("all", [float(c) for c in r]) for r in x], "k0 string, v array<double>")
    got = quality.fits(df, "k0", share=0.75).first()
    q = np.quantile(x, [0.25, 0.75], axis=0)
    both = [plain_mcd(x, 0.75, s) for s in (None, np.diag(1 / (quality.FLOORS + (q[1] - q[0]) ** 2 / 1.82)))]
    center, cov = min(both, key=lambda f: np.linalg.slogdet(f[1])[1])
    assert np.allclose(got.center, center, atol=0.02) and np.allclose(np.reshape(got["cov"], cov.shape), cov, atol=0.02)


def test_written_tables_have_small_row_groups(spark):
    """A task holds the columns of the row group that it writes or reads."""
    import pyarrow.parquet as pq

    df = spark.range(0, 600, 1, 1).select("id", F.expr("transform(sequence(1, 2500), i -> uuid())").alias("x"))
    path = materialize(df, "groups").written_at.removeprefix("file:")
    files = [pq.ParquetFile(f).metadata for f in glob.glob(f"{path}/part-*")]
    sizes = [m.row_group(i).total_byte_size for m in files for i in range(m.num_row_groups)]
    assert len(sizes) > 1 and max(sizes) < 40 << 20
    assert spark.read.parquet(path).count() == 600


def test_quality_fits_far_from_zero(spark):
    """Sums are taken around the last center, so that a spread far from zero keeps its digits."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(500, quality.P))
    fit = lambda off: quality.fits(spark.createDataFrame([("all", r.tolist()) for r in x + off], "k0 string, v array<double>"), "k0").first()
    near, far = fit(0.0), fit(1e6)
    assert np.allclose(np.array(far.center) - 1e6, near.center, atol=1e-3) and np.allclose(far.cov, near.cov, atol=1e-3)


def test_quality_steps_have_small_plans(spark, monkeypatch):
    """Every step writes one table, without a job for its end; the plan is a few sums."""
    plans, write = [], quality.materialize
    monkeypatch.setattr(quality, "materialize", lambda df, *a: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or write(df, *a))
    x = np.random.default_rng(7).normal(size=(200, quality.P))
    quality.fits(spark.createDataFrame([("all", r.tolist()) for r in x], "k0 string, v array<double>"), "k0").collect()
    assert len(plans) > 2 and all("covar_pop" not in p and "CollectMetrics" in p for p in plans[1:-1])


def test_quality_small_groups_are_drawn_to_their_language(spark):
    rng = np.random.default_rng(2)
    rows = [("all", "en", "big", x) for x in rng.normal(size=(2000, quality.P))] + [("all", "en", "small", x) for x in rng.normal(0.5, 1, size=(12, quality.P))]
    rows.append(("all", "en", "small", np.full(quality.P, 9.0)))
    df = spark.createDataFrame([(*k, [float(c) for c in x]) for *k, x in rows], "k0 string, k1 string, k2 string, v array<double>")
    got = quality.robust_distance(df, ["k0", "k1", "k2"]).toPandas()
    out, small = got["d2"] > got["cut"], got["k2"] == "small"
    far = got["v"].map(lambda v: v[0] == 9.0)
    assert out[far].all() and out[small & ~far].sum() <= 1 and out[~small].mean() < 0.03


def test_quality_cut_follows_the_distances(spark):
    """Outliers some ten spreads out go, which a cut for all data at 207 kept; regular rows stay, also of heavier tails."""
    rng = np.random.default_rng(7)
    p = len(quality.FEATURES)
    rows = [("normal", i, x) for i, x in enumerate(rng.normal(size=(3000, p)))] + [("heavy", i, x) for i, x in enumerate(rng.standard_t(5, size=(3000, p)))]
    rows += [("normal", 10_000 + i, x * 11 / np.linalg.norm(x)) for i, x in enumerate(rng.normal(size=(60, p)))]
    df = spark.createDataFrame([("all", g, i, [float(c) for c in x]) for g, i, x in rows], "k0 string, g string, i long, v array<double>")
    got = quality.robust_distance(df, ["k0", "g"], tail=0.01).toPandas()
    out, far = got["d2"] > got["cut"], got["i"] >= 10_000
    assert got["d2"][far].median() < 207 and out[far].all()
    assert out[(got["g"] == "normal") & ~far].mean() < 0.02 and out[got["g"] == "heavy"].mean() < 0.04


def test_quality_rejects_every_labelled_bad_document(spark):
    found = queries.op6_quality_rules(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    assert found.where("quality = 0 and kept").count() == 0


def test_language(spark):
    docs = documents(spark, "/root/testdata/sf0.01")
    found = queries.op7_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id")
    r = found.where("held_out").agg(
        F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("right"), F.min("score").alias("low"), F.max("score").alias("high"),
    ).first()
    assert r.right > 0.98 and 0 <= r.low and r.high <= 1
    one = spark.createDataFrame([(1, "123 !"), (2, None), (3, "")], "doc_id long, text string")
    model = language_id.learn(docs)
    assert {(r.lang_pred, r.score) for r in language_id.identify(one, model).collect()} == {("und", 0.0)}
    de, en = (docs.where((F.col("lang") == x) & (F.col("n_chars") > 2000)).orderBy("doc_id").first().text for x in ("de", "en"))
    both = spark.createDataFrame([(1, en[:1500] + " " + de[:1000])], "doc_id long, text string")
    row = language_id.identify(both, model).first()
    assert row.lang_set == ["en", "de"] and 0.4 < row.score < 0.8


def test_mixture_against_plain_search():
    """Expectation-maximisation finds the likeliest proportions, which a fine grid finds by trying all."""
    rng = np.random.default_rng(5)
    p = rng.dirichlet(np.full(60, 0.3), 3).T.astype(np.float32) + 1e-6
    for true in ((1, 0, 0), (0.7, 0.3, 0), (0.4, 0.35, 0.25)):
        w = rng.multinomial(4000, (p @ np.array(true)) / (p @ np.array(true)).sum()).astype(np.float32)
        mix, value = language_id.proportions(p, w, np.full(3, 1 / 3, np.float32), steps=500)
        grid = [(i / 50, j / 50, (50 - i - j) / 50) for i in range(51) for j in range(51 - i)]
        best = max(grid, key=lambda m: float(w @ np.log(p @ np.array(m) + 1e-30)))
        assert np.abs(mix - best).max() < 0.04 and value >= float(w @ np.log(p @ np.array(best) + 1e-30)) - 10.0


def test_trigrams_over_chunks(monkeypatch):
    text = "Straße und Haus, été 😀 " * 40
    whole = language_id.trigram_counts(text, 12)
    monkeypatch.setattr(language_id, "CHUNK", 7)
    assert abs(language_id.trigram_counts(text, 12) - whole).sum() <= 0.01 * whole.sum()
    assert language_id.trigram_counts("12 !", 12) is None


def plain_katz(rows, order):
    """Katz backoff word by word, from counts in memory."""
    tok = lambda t: [*H.words(t), katz.END_WORD]
    counts = [Counter() for _ in range(order + 1)]

    def grams(w, k):
        padded = [None] * (k - 1) + w
        return [tuple(padded[i : i + k]) for i in range(len(w))]

    for _, t, train in rows:
        if train:
            for k in range(1, order + 1):
                counts[k].update(grams(tok(t), k))
    n, v = sum(counts[1].values()), len(counts[1])
    types = lambda c: [0, *(sum(x == r for x in c.values()) for r in range(1, 8))]
    words = katz.Unigrams(n, types(counts[1]))
    factor = [None, None, *(katz.discounts(types(counts[k])) for k in range(2, order + 1))]
    texts = counts[1][(katz.END_WORD,)]
    after = [None, None, *({} for _ in range(2, order + 1))]
    for k in range(2, order + 1):
        for g in counts[k]:
            after[k].setdefault(g[:-1], []).append(g[-1])

    def met(h):
        return texts if h[-1] is None else counts[len(h)][h]

    @functools.cache
    def alpha(h):
        k = len(h) + 1
        lower = sum(p((*h[1:], w)) for w in after[k][h])
        return (1 - sum(p((*h, w)) for w in after[k][h])) / (1 - lower)

    @functools.cache
    def p(g):
        k = len(g)
        if k == 1:
            return float(words(np.array([counts[1][g]]))[0])
        c = counts[k][g]
        if c:
            return c * (factor[k][c] if c <= katz.DISCOUNTED else 1) / (met(g[:-1]) + katz.RESERVE)
        return (alpha(g[:-1]) if met(g[:-1]) else 1.0) * p(g[1:])

    for k in range(2, order + 1):
        for h in list(after[k])[:5]:
            unseen = words.unknown * (1.0 if k == 2 else 0.0)
            whole = sum(p((*h, *w)) for w in counts[1])
            if k == 2:
                whole += alpha(h) * unseen
                assert abs(whole - 1) < 1e-9
            else:
                unknown = ("no such word",)
                assert abs(whole + p((*h, *unknown)) - 1) < 1e-9
    out = {}
    for i, t, _ in rows:
        w = tok(t)
        score = sum(math.log10(p(g)) for g in grams(w, order))
        base = sum(math.log10((counts[1][(x,)] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        out[i] = (len(w), sum(counts[1][(x,)] > 0 for x in w), n, base, score)
    return out


def test_katz(spark, folder):
    rows = [(r.doc_id, r.text, zlib.crc32(str(r.doc_id).encode()) % 5 != 1) for r in documents(spark, folder).collect()]
    want = plain_katz(rows, queries.KATZ_ORDER)
    for r in queries.op8_lm_scoring(spark, folder).collect():
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:3]
        assert r.base_score == pytest.approx(want[r.doc_id][3], rel=1e-9) and r.score == pytest.approx(want[r.doc_id][4], rel=1e-9)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1)


@pytest.mark.parametrize("order,levels", [(1, 1), (2, 1), (3, 1), (3, 3), (4, 2)])
def test_katz_small_blocks(spark, monkeypatch, order, levels):
    from millrace.llm import blocks

    rows = [(i, " ".join(random.Random(i).choices("a b c d e f g".split(), k=12)), i % 3 != 0) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, train boolean").repartition(3)
    monkeypatch.setattr(blocks, "BLOCK_CHARS", 200)
    monkeypatch.setattr(blocks, "FAN", 4)
    monkeypatch.setattr(blocks, "levels_for", lambda df: levels)
    got = {r.doc_id: r.score for r in katz.katz_scores(df, F.col("train"), order=order).collect()}
    want = plain_katz(rows, order)
    assert len(got) == 60 and all(got[i] == pytest.approx(want[i][4], rel=1e-9) for i in got)
    alone = katz.katz_scores(df, F.lit(False), order=order).first()
    assert alone.score == 0 and alone.train_tokens == 0


def test_levels_follow_the_input(spark, monkeypatch):
    from millrace.llm import blocks

    for size, levels in ((1 << 20, 1), (1 << 29, 1), (40 << 30, 2), (100 << 40, 4), (1 << 60, 1)):
        monkeypatch.setattr(blocks, "input_bytes", lambda df: size)
        assert blocks.levels_for(None) == levels


def flat(segments):
    out = []
    for at, pattern, repeats in segments:
        assert at == len(out)
        out += pattern * repeats
    return out


def flow(share, blocks, t):
    """Blocks of each source after t slots of the ideal mixture, source by source used up."""
    had, left = dict.fromkeys(blocks, Fraction(0)), Fraction(t)
    active = [s for s in blocks if blocks[s]]
    while active and left:
        rate = sum(share[s] for s in active)
        step = min(left, *((blocks[s] - had[s]) * rate / share[s] for s in active))
        for s in active:
            had[s] += step * share[s] / rate
        left -= step
        active = [s for s in active if had[s] < blocks[s]]
    return had


@pytest.mark.parametrize(
    "blocks", [{"a": 100, "b": 60, "c": 30, "d": 10}, {"a": 7, "b": 150, "c": 33, "d": 9}, {"a": 900, "b": 20, "c": 400, "d": 1}],
)
def test_schedule(blocks):
    share = {"a": 50, "b": 30, "c": 15, "d": 5}
    segments = mixing.schedule(blocks, share)
    out = flat(segments)
    assert Counter(out) == Counter(blocks)
    done = Counter()
    for t, s in enumerate(out, 1):
        done[s] += 1
        assert all(abs(done[x] - n) < 1 for x, n in flow(share, blocks, t).items())
    if blocks["a"] == 900:
        assert any(x.repeats > 1 for x in segments)  # periods that recur are not run through


def test_schedule_of_few_and_many():
    assert flat(mixing.schedule({"a": 2, "b": 40}, {"a": 1, "b": 1}))[4:] == ["b"] * 38
    assert mixing.schedule({}, {}) == []
    long = mixing.schedule({"a": 10**9, "b": 10**9 // 2}, {"a": 3, "b": 2})
    assert sum(len(x.pattern) * x.repeats for x in long) == 10**9 * 3 // 2 and sum(len(x.pattern) for x in long) < 200
    assert mixing.shares({"a": 1.0, "b": 3.0}) == {"a": 4096, "b": 12288} and mixing.shares({"a": 1e-12, "b": 1.0})["a"] == 1


def test_slots():
    segments = mixing.schedule({"a": 900, "b": 20, "c": 400}, {"a": 5, "b": 3, "c": 2})
    got = {s: slots(np.arange(n)).tolist() for (s, slots), n in zip(sorted(mixing.places(segments).items()), (900, 20, 400))}
    seen = Counter()
    for t, s in enumerate(flat(segments)):
        assert got[s][seen[s]] == t
        seen[s] += 1
    assert seen == {"a": 900, "b": 20, "c": 400}


def test_mixing(spark, folder):
    block = 1 << 12
    weights = {f"src{i}": 1.0 + (i == 3) for i in range(20)}
    docs = documents(spark, folder)
    rows = mixing.mix(docs, weights, block=block).orderBy("mix_slot", "mix_start").collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.collect())
    size = Counter()
    for r in sorted(rows, key=lambda r: (r.source, r.mix_block, r.mix_start)):
        assert r.mix_block == size[r.source] // block and r.mix_start == size[r.source] % block
        size[r.source] += len(r.text.encode())
    share = mixing.shares({s: weights.get(s, 1.0) for s in size})
    numbered, seen = {}, Counter()
    for t, s in enumerate(flat(mixing.schedule({s: -(-n // block) for s, n in size.items()}, share))):
        numbered[(s, seen[s])] = t
        seen[s] += 1
    assert all(numbered[(r.source, r.mix_block)] == r.mix_slot for r in rows)


def test_packing(spark, folder):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    got = queries.op10_packing(spark, folder).toPandas()
    for r in documents(spark, folder).collect():
        ids = np.array([*t.encode(r.text, add_special_tokens=False).ids, 0], "<u4")
        mine, at = got[got["doc_id"] == r.doc_id].sort_values("start"), 0
        for p in mine.itertuples():
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for _, w in got.sort_values("offset").groupby("sequence_id"):
        assert (w["length"].cumsum() - w["length"] == w["offset"]).all() and w["length"].sum() <= 1024
    assert got["length"].sum() / (1024 * got["sequence_id"].nunique()) > 0.9


def test_encoder():
    e = packing.encoder(tokenizer_file("byte_bpe_50k.json"))
    random.seed(2)
    pool = "aZ é\n\t 's'S't9²½_ __-!..\x1c\x85\xa0　日本語١٢Ⅳİʰ́€​😀|<|endoftext|>"
    for x in ["".join(random.choice(pool) for _ in range(random.randint(0, 40))) for _ in range(2000)] + ["<|endoftext|> x", " " * 999 + "b"]:
        assert e.encode(x) == e.library(x)


def test_differencing():
    assert sorted(np.bincount(packing.difference(np.array([8, 7, 6, 5, 4]), 2), [8, 7, 6, 5, 4])) == [14, 16]
    rng = np.random.default_rng(1)
    for m in (1, 2, 7, 40):
        sizes = rng.integers(1, 257, 300)
        sums = np.bincount(packing.difference(sizes, m), sizes, m)
        assert len(sums) == m and sums.sum() == sizes.sum() and sums.max() - sums.min() <= 40
    dealt, n = packing.windows_of(np.array([100, 100, 100]), 128)
    assert n == 3 and len(set(dealt)) == 3


def test_line_query_is_stable(spark, folder):
    for r in queries.op1_line_dedup(spark, folder).join(documents(spark, folder), "doc_id").where("n_dropped = 0").collect():
        assert r.kept_sha256 == hashlib.sha256(r.text.encode()).hexdigest()


def test_personal_data_graph_against_plain_scores(spark):
    """Rounds of scoring by joins and sums, held against the same rounds over dictionaries."""
    rng = random.Random(8)
    lefts = [f"{a} {b}" for a in ("call", "ring", "fax", "bring", "count") for b in ("to", "number", "line")]
    rows = []
    for i in range(400):
        number = f"+1 (555) 01{rng.randint(0, 9)}-{rng.randint(1000, 1400)}" if rng.random() < 0.4 else f"555 01{rng.randint(0, 9)} {rng.randint(1000, 1400)}"
        rows.append((i, f"x {rng.choice(lefts)} {number} {rng.choice(('now', 'then', 'stones'))} y", "en", "s", 1))
    got = {r.doc_id: {tuple(s) for s in r.spans} for r in pii.find_personal_data(spark.createDataFrame(rows, H.DOCS)).collect()}

    found, edges = {}, {}
    for i, text, *_ in rows:
        base = pii.base_spans(text)
        for s, seed in [(s, True) for s in base] + [(s, False) for s in pii.loose_spans(text, base)]:
            instance = (s[0], "".join(text[s[1] : s[2]].lower().split()))
            found.setdefault(i, []).append((s, seed, instance))
            for c in pii.contexts(text, s[1], s[2]):
                edges[(s[0], c, instance)] = edges.get((s[0], c, instance), False) or seed
    trust = {}
    for _ in range(3):
        level = lambda e: 1.0 if edges[e] else trust.get(e[2], 0.0)
        by_pattern = {}
        for e in edges:
            by_pattern.setdefault(e[:2], []).append(level(e))
        good = {p: sum(v) / (len(v) + 1) for p, v in by_pattern.items() if sum(x >= 0.8 for x in v) >= 3}
        doubt = {}
        for e in edges:
            if not edges[e] and e[:2] in good:
                doubt[e[2]] = doubt.get(e[2], 1.0) * max(1 - good[e[:2]], 1e-9)
        trust = {x: 1 - d for x, d in doubt.items()}
    added = 0
    for i, spans in found.items():
        want = {(pii.KINDS[s[0]], *s[1:]) for s, seed, _ in spans if seed}
        places = {}
        for s, seed, x in spans:
            if not seed and trust.get(x, 0.0) >= 0.8:
                places.setdefault(s[1:], []).append((trust[x], -s[0]))
        want |= {(pii.KINDS[-max(v)[1]], *at) for at, v in places.items()}
        added += len(places)
        assert got[i] == want
    assert added > 20
