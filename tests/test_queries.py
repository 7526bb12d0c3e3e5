"""Every registered base query against its SQL, over the smallest tables."""

import math
import os

import duckdb
import pytest

import millrace.queries as base

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(rows, names):
    def value(x):
        if isinstance(x, float):
            return "nan" if math.isnan(x) else repr(round(x, 6))
        return str(x)

    return sorted(tuple(value(r[i]) for i in names) for r in rows)


@pytest.mark.parametrize("name", sorted(base.oracle_sql()))
def test_same_as_sql(spark, folder, name):
    db = duckdb.connect()
    db.sql("SET TimeZone='UTC'")
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(folder, t)}.parquet'")
    got = base.queries()[name](spark, folder)
    want = db.sql(base.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    rows = [r.asDict() for r in got.collect()]
    theirs = [dict(zip(want.columns, r)) for r in want.fetchall()]
    assert plain(rows, columns) == plain(theirs, columns)


@pytest.mark.parametrize("name", sorted(set(base.queries()) - set(base.oracle_sql())))
def test_runs(spark, folder, name):
    assert base.queries()[name](spark, folder).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


#: Lines that begin or end in their number, or in spaces of several kinds; and a text without any.
NUMBERED = ["0 first 100", "00", "  a\n1 b 1\n2\n  c 22", "\n1\n \u00a0d\u3000 ", "0" * 30 + "\nx", "one\n\n\n3 three 3", " \n\n "]


def same_as_sql(spark, name, folder, **tables):
    """A query against its SQL over small tables, which are written to ``folder``."""
    db = duckdb.connect()
    db.sql("SET TimeZone='UTC'")
    for t, rows in tables.items():
        rows.coalesce(1).write.parquet(f"{folder}/{t}.parquet")
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    got, want = base.queries()[name](spark, str(folder)), db.sql(base.oracle_sql()[name])
    theirs = [dict(zip(want.columns, r)) for r in want.fetchall()]
    assert plain([r.asDict() for r in got.collect()], want.columns) == plain(theirs, want.columns)


def numbered(spark):
    rows = [(i, t, lang, "src1", len(t)) for i, (t, lang) in enumerate((t, lang) for t in NUMBERED for lang in ("en", "de"))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_titles_keep_digits_at_their_ends(spark, tmp_path):
    same_as_sql(spark, "derive_title", tmp_path, documents=numbered(spark))


def test_storage_keeps_digits_at_ends_of_lines(spark, tmp_path):
    same_as_sql(spark, "storage_to_markdown", tmp_path, documents=numbered(spark))


def test_trees_keep_digits_at_ends_of_lines(spark, tmp_path):
    same_as_sql(spark, "tree_to_markdown", tmp_path, documents=numbered(spark))


def test_a_vector_of_another_length_under_the_same_key_hides_none(spark, tmp_path):
    rows = [(2 * i + j, f"text {i}", lang, "src1", 6) for i in range(40) for j, lang in enumerate(("en", "fr") if i % 2 else ("fr", "en"))]
    rows += [(100, "only", "fr", "src1", 4), (101, "other", "de", "src1", 5)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    same_as_sql(spark, "embedding_cache", tmp_path, documents=documents)


def test_pages_of_empty_texts_have_no_block(spark, tmp_path):
    texts = ["some  words", "", None, " \n\t ", "x < y", "0"]
    rows = [(i, t, "en", "src1", 0) for i, t in enumerate(texts * 4)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    same_as_sql(spark, "page_load", tmp_path, documents=documents)
