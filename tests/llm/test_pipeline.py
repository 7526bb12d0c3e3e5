"""The pipeline's stages, each on its own input and all together."""

import functools
from fractions import Fraction

import pytest

import corpus_pipeline as P
from millrace.llm.common import documents

from . import helpers as H


def test_stages_have_the_columns_of_documents(spark):
    for rows in (H.awkward(spark).select(*P.COLUMNS), H.empty(spark)):
        for _, stage in P.STAGES[:-1]:
            assert stage(spark, rows, "").columns == P.COLUMNS
    assert P.STAGES[-1][1](spark, H.empty(spark), "").count() == 0


@pytest.mark.parametrize("name,stage", P.STAGES)
def test_awkward_rows(spark, name, stage):
    n = stage(spark, H.awkward(spark).select(*P.COLUMNS), "").count()
    assert n > 0
    if name == "mixed":
        assert n == len(H.AWKWARD)


def test_near_copies_against_brute_force(spark, folder):
    docs = documents(spark, folder)
    comp = H.components({r.doc_id: H.shingles(r.text, 5) for r in docs.collect()}, *Fraction(4, 5).as_integer_ratio())
    got = sorted(r.doc_id for r in P.near_copies(spark, docs, folder).collect())
    assert got == sorted(i for i, c in comp.items() if i == c)


def test_near_copies_of_repeated_and_missing_ids(spark):
    t = [" ".join(f"{p}{i}" for i in range(30)) for p in "abc"]
    rows = [(1, t[0]), (1, t[1]), (None, t[1]), (None, t[2]), (None, t[2]), (5, t[2] + " x"), (7, None), (8, "")]
    df = spark.createDataFrame([(*r, "en", "s", n) for n, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(r.n_chars for r in P.near_copies(spark, df, "").collect())
    assert len(got) == 4 and got[0] in (0, 1) and got[1:] == [5, 6, 7]


def test_language_keeps_clean_documents(spark, folder):
    docs = documents(spark, folder)
    assert P.language(spark, docs, folder).count() >= 0.99 * docs.count()


def test_lines_take_effect(spark, folder):
    docs = {r.doc_id: r.text for r in documents(spark, folder).collect()}
    for r in P.shared_lines(spark, documents(spark, folder), folder).collect():
        assert set(r.text.split("\n")) <= set(docs[r.doc_id].split("\n")) and r.n_chars == len(r.text)


def test_all_stages(spark, folder):
    pieces = P.run(spark, folder).toPandas()
    assert set(pieces["doc_id"]) <= {r.doc_id for r in documents(spark, folder).collect()}
    assert (pieces.groupby("doc_id")["length"].sum() == pieces.groupby("doc_id")["doc_tokens"].first()).all()
    assert pieces.groupby("sequence_id")["length"].sum().max() <= 1024


def test_sequences_follow_the_mixture_over_several_files(spark, folder, tmp_path, monkeypatch):
    from millrace.llm import mixing

    monkeypatch.setattr(P, "mix", functools.partial(mixing.mix, block=1 << 12))
    docs = documents(spark, folder)
    path = str(tmp_path / "mixed")
    P.mixed(spark, docs, folder).repartition(7, "doc_id").write.parquet(path)  # files in another order
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")  # the table is too small for several partitions otherwise
    try:
        got = P.packed(spark, spark.read.parquet(path), folder).toPandas()
    finally:
        spark.conf.unset(coalesce)
    slots = {r.doc_id: r.mix_slot for r in P.mix(docs).collect()}
    assert (got["mix_slot"] == got["doc_id"].map(slots)).all() and got["mix_slot"].nunique() > 20
    ranges = got.groupby(got["sequence_id"] // 2**40)["mix_slot"].agg(["min", "max"])
    assert len(ranges) > 1 and (ranges["max"].to_numpy()[:-1] <= ranges["min"].to_numpy()[1:]).all()
