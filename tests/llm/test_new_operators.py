"""Vector codes, spelling variants and decontamination on awkward rows and against plain versions."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import decontaminate, queries, spelling, vector_codes
from millrace.llm.common import documents

from . import helpers as H

VECTORS = "vec_id long, embedding array<float>, label int, code int, error int"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 7, 8) for r in rows], VECTORS)


def plain_codes(rows, parts, entries, rounds):
    """Codes and errors by exhaustive search, in Python's integers."""
    kept = sorted((r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])), key=lambda r: (r[0] is None, r[0], r[1]))
    longest = max((len(r[1]) for r in kept), default=0)
    w = -(-longest // parts)
    whole = [[int(np.floor(256 * float(np.float32(x)))) for x in r[1]] + [0] * (parts * w - len(r[1])) for r in kept]
    cut = [[v[p * w : p * w + w] for p in range(parts)] for v in whole]
    books = [[v[p] for v in cut[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p, book in enumerate(books):
            held = defaultdict(list)
            for v in cut:
                held[nearest(v[p], book)[1]].append(v[p])
            for i, xs in held.items():
                book[i] = [sum(c) // len(xs) for c in zip(*xs)]
    found = [[nearest(v[p], books[p]) for p in range(parts)] for v in cut]
    return sorted((str(r[0]), "".join("%02x" % i for _, i in f), sum(d for d, _ in f)) for r, f in zip(kept, found)), books


def test_codes_same_as_exhaustive_search(spark):
    random.seed(3)
    rows = [(i, [random.choice((-1.5, -0.01, 0.0, 0.3, 2.0)) + random.randint(0, 2) / 9 for _ in range(10)], i % 3 or None) for i in range(300)]
    rows += [(4, rows[4][1], 1), (4, rows[9][1], 1), (None, rows[7][1], None), (None, [1.0] * 9, 2), (900, None, 1), (901, [1.0, None] * 5, 1), (902, [float("inf")] * 10, 1), (903, [float("nan")] * 10, 1), (904, [], 1)]
    df = vectors(spark, rows).repartition(3)
    for parts, entries, rounds in ((4, 64, 2), (10, 5, 3), (3, 1, 1)):
        books = vector_codes.fit(df, parts=parts, entries=entries, rounds=rounds)
        got = sorted((str(r.vec_id), r.code, r.error) for r in vector_codes.encode(df, books).collect())
        want, plain = plain_codes(rows, parts, entries, rounds)
        assert got == want and [b.entries.tolist() for b in books.books] == plain
        assert books.sha256 == vector_codes.hashlib.sha256(",".join(str(x) for b in plain for e in b for x in e).encode()).hexdigest()


def test_search_reads_less_than_all_entries():
    rng = np.random.default_rng(1)
    book = vector_codes.Book(rng.integers(-500, 500, (64, 4)))
    x = rng.integers(-500, 500, (20_000, 4))
    index, near, taken = book.nearest(x)
    d = vector_codes.squares(x[:, None], book.entries[None])
    assert (index == d.argmin(1)).all() and (near == d.min(1)).all()
    assert taken < 0.6 * d.size
    order, quarters = book.lists
    assert (np.diff(quarters, axis=1) >= 0).all() and all(set(o[:-1]) == set(range(64)) - {i} for i, o in enumerate(order))


def test_codes_approximate_vectors(spark, folder):
    df = spark.read.parquet(f"{folder}/embeddings.parquet")
    books = vector_codes.fit(df)
    rows = vector_codes.decode(vector_codes.encode(df, books), books).collect()
    x, y = np.array([r.embedding for r in rows]), np.array([r.approximate for r in rows])
    assert ((x - y) ** 2).sum() < 0.5 * ((x - x.mean(0)) ** 2).sum()
    for r, a, b in zip(rows, x, y):  # the error is the distance in units of the scale, but for rounding
        assert abs(np.linalg.norm(a - b) * 256 - r.error**0.5) <= 8


def test_codes_of_no_vectors(spark):
    none = vectors(spark, [(1, None, 1), (2, [None], None)])
    for df in (none, none.limit(0)):
        assert vector_codes.encode(df, vector_codes.fit(df)).count() == 0
    with pytest.raises(ValueError):
        vector_codes.fit(vectors(spark, [(1, [1e30], 1)])).books


def plain_variants(texts, min_chars=6, min_count=5, slip=None, ratio=5):
    """The words with their forms and roots by comparing all pairs of equal deletions."""
    n = Counter()
    for i, text in texts:
        run = ""
        for c in ("".join(x.lower() if x.isascii() else x for x in text or "")) + " ":
            if "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c
                continue
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if run and slip and h % slip == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
            run = ""
    n = {w: k for w, k in n.items() if len(w) >= min_chars and k >= min_count}

    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    out, form = {}, {}
    for w in n:
        found = [v for v in n if near(w, v)]
        best = min(found, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= ratio * n[w] else None
        out[w] = (len(found), form[w])
    for w, (k, f) in out.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (f, root, n[w], k, n[f] if f else None)
    return out


def got_variants(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


@pytest.mark.parametrize("symbols", [1, 2, 6])
def test_variants_same_as_all_pairs(spark, symbols):
    random.seed(symbols)
    texts, letters = [], "abÀé÷"
    for i in range(300):
        words = ["".join(random.choice(letters) for _ in range(random.choice((4, 5, 5, 6)))) for _ in range(20)]
        texts.append((i if i % 50 else None, " ".join(w.upper() if i % 3 else w for w in words)))
    rows = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts], H.DOCS).repartition(3)
    for slip in (None, 3):
        counts = spelling.word_counts(rows, min_chars=4, min_count=3, slip=slip)
        assert got_variants(spelling.variants(counts, ratio=2, symbols=symbols)) == plain_variants(texts, 4, 3, slip, 2)


def test_chains_of_forms(spark):
    words = [("aaaaaa" + "b" * i, 10**i) for i in range(9)] + [("zzzzzz", 5), ("zzzzzy", 25), ("zzzzzx", 25), (None, 9)]
    got = got_variants(spelling.variants(spark.createDataFrame(words, "word string, n long")))
    assert {got["aaaaaa" + "b" * i][1] for i in range(9)} == {"aaaaaa" + "b" * 8}
    assert got["zzzzzz"] == ("zzzzzx", "zzzzzx", 5, 2, 25) and got["zzzzzx"][0] is None and len(got) == 12


def test_neighbourhoods_are_whole_and_without_repeats(monkeypatch):
    monkeypatch.setattr(spelling, "BATCH", 6)
    rng = np.random.default_rng(2)
    for size in (0, 1, 2, 7, 12):
        c = rng.integers(1, 4, size).astype(np.uint64)
        got = np.concatenate(list(spelling.neighbourhood(c, 3)))
        w = c.tolist()
        want = {tuple(w)} | {(*w[:i], *w[i + 1 :]) for i in range(size)}
        want |= {(*w[:i], s, *w[i + 1 :]) for i in range(size) for s in (1, 2, 3)} | {(*w[:i], s, *w[i:]) for i in range(size + 1) for s in (1, 2, 3)}
        assert len(got) == len(want) and set(got.tolist()) == {int(spelling.reduced_hash(np.array(x, np.uint64))) for x in want}


def test_variants_of_very_long_words_and_no_words(spark):
    long = "ab" * 20_000
    words = [(long, 9), (long + "a", 50), (long[1:], 2), (long[:-1] + "c", 1)]
    got = got_variants(spelling.variants(spark.createDataFrame(words, "word string, n long")))
    assert got[long] == (long + "a", long + "a", 9, 3, 50)
    assert spelling.variants(spelling.word_counts(H.empty(spark))).count() == 0
    counts = spelling.word_counts(H.awkward(spark), min_chars=4, min_count=1, slip=2)
    assert got_variants(spelling.variants(counts)) == plain_variants([r[:2] for r in H.AWKWARD], 4, 1, 2)


def plain_contamination(texts, items, n):
    """(words, hit words, items) of each text."""
    def words(t):
        return decontaminate.re.findall(r"[0-9a-z\u0080-\U0010ffff]+", "".join(x.lower() if x.isascii() else x for x in t or ""))

    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        for a in range(max(1, len(w) - n + 1) if w else 0):
            windows[tuple(w[a : a + n])].add("" if i is None else str(i))
    sizes, out = {len(w) for w in windows}, []
    for t in texts:
        w, hit, found = words(t), set(), set()
        for k in sizes:
            for a in range(len(w) - k + 1):
                if tuple(w[a : a + k]) in windows:
                    hit |= set(range(a, a + k))
                    found |= windows[tuple(w[a : a + k])]
        out.append((len(w), len(hit), sorted(found)))
    return out


@pytest.mark.parametrize("most", [decontaminate.MAX_WINDOWS, 0])
def test_contamination_same_as_plain_windows(spark, most):
    random.seed(4)
    say = lambda k: "".join(random.choice(["Aa", "b", "É", "7", "日本", "x_y"]) + random.choice([" ", ", ", "\n", " -- "]) for _ in range(k))
    items = [(i if i else None, say(random.choice((0, 1, 2, 3, 6, 9)))) for i in range(30)] + [(3, "again under one id b b"), (77, None), (78, " ... ")]
    texts = [say(random.choice((0, 2, 5, 40))) for _ in range(200)] + [None, "", "...", items[9][1], "b " * 3000]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], H.DOCS).withColumns({c: F.lit(9) for c in ("items", "spans", "n_hit", "row", "hits", "window")})
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.contamination(docs, bench, n=4, max_windows=most).collect()}
    for i, (n, hit, ids) in enumerate(plain_contamination(texts, items, 4)):
        assert (got[i].n_words, got[i].n_hit, got[i]["items"]) == (n, hit, ids) and got[i].window == 9


@pytest.mark.parametrize("most", [decontaminate.MAX_WINDOWS, 0])
def test_contamination_of_awkward_rows(spark, most):
    bench = spark.createDataFrame([(1, "same text in two rows, long enough"), (None, "日本語")], "item_id long, text string")
    got = decontaminate.contamination(H.awkward(spark), bench, n=5, max_windows=most)
    assert sorted((r.doc_id, r.n_hit, r["items"]) for r in got.where("n_hit > 0").collect()) == [(5, 7, ["1"]), (5, 7, ["1"]), (9, 9, [""])]
    assert got.count() == len(H.AWKWARD)
    assert decontaminate.contamination(H.empty(spark), bench, max_windows=most).count() == 0
    assert decontaminate.contamination(H.awkward(spark), bench.limit(0), max_windows=most).where("n_hit > 0 or size(items) > 0").count() == 0


def test_spans_are_cut(spark):
    bench = spark.createDataFrame([(1, "one two three four"), (2, "two three four five")], "item_id long, text string")
    texts = ["😀 Zero ONE, two three: four five six! One two three four.", "one two three", "One-two-three-four"]
    found = decontaminate.contamination(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], H.DOCS), bench, n=4)
    cut = {r.doc_id: r.text for r in decontaminate.decontaminate(found, "spans").collect()}
    assert cut == {0: "😀 Zero  six! .", 1: "one two three", 2: ""}
    assert [r.doc_id for r in decontaminate.decontaminate(found).collect()] == [1]
    assert {r.doc_id for r in decontaminate.decontaminate(found, share=0.95).collect()} == {0, 1}


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_spelling_variants", "op13_decontamination"])
def test_same_as_sql(spark, folder, name):
    import duckdb

    db = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    want = db.sql(queries.ORACLES[name])
    columns = want.columns
    got = queries.QUERIES[name](spark, folder).select(*columns).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.fetchall())) and got


def test_benchmark_passages_in_documents_are_found(spark, folder):
    bench = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    docs = documents(spark, folder).limit(50).withColumn("text", F.concat("text", F.lit("\n" + bench[3] + "\n")))
    found = decontaminate.contamination(docs, spark.read.parquet(f"{folder}/benchmark.parquet"))
    assert found.where("n_hit = 0").count() == 0
