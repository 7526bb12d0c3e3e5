"""Nearest neighbours by multi-index hashing of learned rotated binary codes."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: The codes are fitted on at most SAMPLE vectors; every vector is indexed.
SAMPLE, ROTATIONS = 20_000, 4
#: Largest Hamming ball of one substring that is probed value by value.
BALL = 256
#: Codes and queries in a cell where balls are larger and codes are read through.
BLOCK_ROWS, BLOCK_QUERIES = 16_384, 8_192


@dataclass
class Codes:
    """Rotations (each orthogonal, of all dimensions), the largest norm, the substrings' bounds and the Hamming radius."""

    rotations: np.ndarray
    norm: float
    cuts: np.ndarray
    radius: int

    def lifted(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Vectors on a sphere of one more dimension, where the order by angle is that by inner product."""
        n = np.linalg.norm(x, axis=1)
        if query:
            return np.column_stack((x / n[:, None], np.zeros(len(x))))
        y = x / self.norm
        return np.column_stack((y, np.sqrt(np.maximum(0, 1 - (n / self.norm) ** 2))))

    def bits(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        y = self.lifted(x, query)
        return np.concatenate([y @ r > 0 for r in self.rotations], axis=1)

    def substrings(self, bits: np.ndarray) -> np.ndarray:
        """The value of each substring; together they hold every bit once."""
        ends = [*self.cuts[1:], bits.shape[1]]
        return np.stack([bits[:, a:b] @ (1 << np.arange(b - a)) for a, b in zip(self.cuts, ends)], axis=1)

    def probes(self) -> list[tuple[int, int]]:
        """For each substring its width and how many of its bits may differ, by the pigeonhole principle.

        Of a code within the radius, one of the first radius mod m + 1 of m substrings differs by at most radius div m
        bits, or one of the others by fewer.
        """
        width = np.diff([*self.cuts, len(self.rotations) * self.rotations.shape[1]])
        a, b = divmod(self.radius, len(width))
        return [(int(w), a if j <= b else a - 1) for j, w in enumerate(width)]


def words(bits: np.ndarray) -> np.ndarray:
    """Codes as 64-bit words; bits beyond the last are zero in all."""
    return np.packbits(np.pad(bits, ((0, 0), (0, -bits.shape[1] % 64))), axis=1).view(np.uint64)


def ball(width: int, radius: int) -> list[int]:
    """All words of ``width`` bits with at most ``radius`` ones."""
    found = [0] if radius >= 0 else []
    last = found
    for _ in range(radius):
        last = [x | 1 << b for x in last for b in range(x.bit_length(), width)]
        found = found + last
    return found


def size_of_ball(width: int, radius: int) -> int:
    return sum(math.comb(width, i) for i in range(radius + 1))


def rotation(x: np.ndarray, rng: np.random.Generator, steps: int = 15) -> np.ndarray:
    """Iterative quantisation: from a random rotation on, turn the sample so that signs lose least."""
    d = x.shape[1]
    r = np.linalg.qr(rng.standard_normal((d, d)))[0]
    for _ in range(steps):
        u, _, v = np.linalg.svd(np.sign(x @ r).T @ x, full_matrices=False)
        r = (u @ v).T
    return r


def fit(sample: np.ndarray, norm: float, k: int, rows: int, target: float = 0.99, seed: int = 7) -> Codes:
    """Learn rotations on a sample of ``rows`` vectors, and the radius within which ``target`` of the k nearest lie.

    The k nearest of all rows are as near as so many fewer of the sample, one at least, so the radius keeps that share at
    any size. Substrings have about as many bits as numbers of rows.
    """
    rng = np.random.default_rng(seed)
    codes = Codes(np.zeros((0, 0, 0)), norm, np.zeros(1, int), 0)
    y = codes.lifted(sample, False)
    codes.rotations = np.stack([rotation(y - y.mean(axis=0), rng) for _ in range(ROTATIONS)])
    total = ROTATIONS * y.shape[1]
    m = max(1, round(total / min(24, max(4, math.log2(max(rows, 2))))))
    codes.cuts = np.arange(m) * total // m
    near = min(len(sample) - 1, max(1, math.ceil(k * len(sample) / rows)))
    if near < 1:
        codes.radius = total
        return codes
    probe = sample[rng.permutation(len(sample))[:500]]
    score = probe @ sample.T
    distance = hamming(words(codes.bits(probe, True)), words(codes.bits(sample)))
    score[score >= (probe * probe).sum(axis=1)[:, None] - 1e-12] = -np.inf  # not itself or a copy
    top = np.argpartition(-score, near, axis=1)[:, :near]
    valid = np.isfinite(np.take_along_axis(score, top, axis=1))
    found = np.take_along_axis(distance, top, axis=1)[valid]
    codes.radius = int(np.quantile(found, target)) if len(found) else total
    return codes


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(a), len(b)), dtype=np.uint16)
    for j in range(a.shape[1]):
        out += np.bitwise_count(a[:, j, None] ^ b[None, :, j])
    return out


def scanned(x: np.ndarray, ids: np.ndarray, q: np.ndarray, codes: Codes, keep: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query of ``q`` the rows of ``x`` within the radius, or the ``keep`` nearest codes if those are more, cut to
    the ``keep`` of the largest inner products: its number, their places and scores."""
    xc, qc = words(codes.bits(x)), words(codes.bits(q, True))
    for at in range(0, len(q), 512):
        distance = hamming(qc[at : at + 512], xc)
        reach = np.full(len(distance), codes.radius)
        if len(x) > keep:
            reach = np.maximum(reach, np.partition(distance, keep - 1, axis=1)[:, keep - 1])
        else:
            reach[:] = distance.max(initial=0)
        for i in range(len(distance)):
            rows = np.flatnonzero(distance[i] <= reach[i])
            score = (x[rows] * q[at + i]).sum(axis=1)
            best = np.lexsort((ids[rows], -score))[:keep]
            yield at + i, rows[best], score[best]


def probed(entries: DataFrame, questions: DataFrame, codes: Codes) -> DataFrame:
    """(question, entry): all entries whose codes are within the radius of a question's, from the buckets in its balls."""
    masks = F.array(*[F.array(*[F.lit(x) for x in ball(*p)]).cast("array<long>") for p in codes.probes()])
    buckets = entries.select("entry", "code", F.posexplode("subs").alias("table", "value"))
    asks = questions.select("question", "query_code", F.posexplode("query_subs").alias("table", "sub"))
    values = F.transform(masks[F.col("table")], lambda m: m.bitwiseXOR(F.col("sub")))
    probes = asks.select("question", "query_code", "table", F.explode(values).alias("value"))
    apart = F.aggregate(F.zip_with("code", "query_code", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, x: s + x)
    return buckets.join(probes, ["table", "value"]).where(apart <= codes.radius).select("question", "entry").distinct()


def search(
    vectors: DataFrame, queries: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, target: float = 0.99,
) -> DataFrame:
    """The ``k`` rows with the largest inner product found for each query row, the query's own row aside.

    Rotations are learned on a bounded sample (SAMPLE rows with the least hashes of their ids); all rows are coded and
    indexed. Equal vectors are one entry of the index with the k + 1 smallest of their ids, as no other can be among the
    nearest. An entry lies in a bucket for each substring of its code. A query retrieves all codes within the radius that
    ``fit`` found: where the substrings' Hamming balls have at most BALL values, these are joined with the buckets; larger
    ones would reach most buckets, and blocks of codes are read through instead, as they are for queries whose radius holds
    fewer than k rows, which then take the nearest codes. What is retrieved is reranked on the original vectors in double
    precision. Work of the second way is queries times rows.

    Returns query_id, rank (int, from 1), vec_id, score (double); ties go to the smaller vec_id. Vectors that are null,
    zero, of another length than most, or hold null or non-finite components, and rows without id take no part. Of
    rows with one id, that with the least hash of its vector takes part. Ids are whole numbers. An empty table gives no
    rows; other columns and their names don't matter.
    """
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    sane = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
    sane = sane.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))
    spark = vectors.sparkSession
    usual = sane.groupBy(F.size("v").alias("d")).agg(
        F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("norm2"),
    ).orderBy(F.desc("n"), "d").first()
    if usual is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sane = sane.where(F.size("v") == usual["d"])
    sample = np.array([r["v"] for r in sane.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").collect()])
    codes = fit(sample, float(np.sqrt(usual["norm2"])), k, usual["n"], target)
    held = spark.sparkContext.broadcast(codes)  # bounded: ROTATIONS matrices

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vs, asks = batch.columns
            x = np.array(vs.to_pylist(), dtype=float).reshape(len(batch), -1)
            bits = [held.value.bits(x, query) for query in (False, True)] if len(batch) else [np.zeros((0, 1), bool)] * 2
            arrays = [pa.array(list(words(b).view(np.int64)), pa.list_(pa.int64())) for b in bits]
            subs = [pa.array(list(held.value.substrings(b)), pa.list_(pa.int64())) if len(batch) else pa.array([], pa.list_(pa.int64())) for b in bits]
            yield pa.RecordBatch.from_arrays([ids, vs, asks, *arrays, *subs], names=["ids", "v", "asks", "code", "query_code", "subs", "query_subs"])

    once = sane.groupBy("vec_id").agg(F.min(F.struct(
        F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(3), "v").alias("h2"), "v", "asks",
    )).alias("r")).select("vec_id", "r.*")
    once = materialize(once, "vectors")
    first = Window.partitionBy("h1", "h2").orderBy("vec_id")
    few = once.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)
    asked = once.where("asks").select("h1", "h2").distinct().withColumn("asks", F.lit(True))
    entries = few.groupBy("h1", "h2").agg(
        F.sort_array(F.collect_list("vec_id")).alias("ids"), F.min_by("v", "vec_id").alias("v"),
    ).join(asked, ["h1", "h2"], "left")
    entries = entries.select("ids", "v", F.coalesce("asks", F.lit(False)).alias("asks")).mapInArrow(
        coded,
        "ids array<long>, v array<double>, asks boolean, code array<long>, query_code array<long>, subs array<long>, query_subs array<long>",
    )
    entries = materialize(entries.withColumn("entry", F.col("ids")[0]), "index")
    questions = entries.where("asks").select(F.col("entry").alias("question"), F.col("v").alias("asked"), "query_code", "query_subs")

    best = Window.partitionBy("question").orderBy(F.desc("score"), "vec_id")
    top = lambda df: df.select("question", "score", F.explode("ids").alias("vec_id")).withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1)
    found = None
    if max(size_of_ball(*p) for p in codes.probes()) <= BALL:
        close = probed(entries, questions, codes)
        product = F.aggregate(F.zip_with("v", "asked", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        met = close.join(entries.select("entry", "ids", "v"), "entry").join(questions.select("question", "asked"), "question")
        found = materialize(top(met.select("question", "ids", product.alias("score"))), "found")
        full = found.groupBy("question").agg(F.count("*").alias("n")).where(F.col("n") > k).select("question")
        questions = materialize(questions.join(full, "question", "left_anti"), "questions")
        found = found.join(full, "question", "left_semi")

    n_rows, n_queries = usual["n"], questions.count()
    if n_queries:
        row_blocks, query_blocks = max(1, -(-n_rows // BLOCK_ROWS)), max(1, -(-n_queries // BLOCK_QUERIES))
        dealt = lambda n, c: F.pmod(F.xxhash64(F.lit(n), c), F.lit(n)).cast("int")
        index = entries.select(
            dealt(row_blocks, "entry").alias("rows"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("queries"), "entry",
            "ids", "v",
        )
        asking = questions.select(
            dealt(query_blocks, "question").alias("queries"), F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))).alias("rows"),
            "question", "asked",
        )

        def cell(index: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
            out = {"question": [], "ids": [], "score": []}
            if len(index) and len(asking):
                x, q = np.stack(index["v"].to_numpy()), np.stack(asking["asked"].to_numpy())
                ids, names = index["ids"].to_numpy(), asking["question"].to_numpy()
                for i, rows, score in scanned(x, index["entry"].to_numpy(), q, held.value, k + 1):
                    out["question"] += [names[i]] * len(rows)
                    out["ids"] += list(ids[rows])
                    out["score"] += score.tolist()
            return pd.DataFrame(out)

        cells = index.groupBy("rows", "queries").cogroup(asking.groupBy("rows", "queries"))
        scan = top(cells.applyInPandas(cell, "question long, ids array<long>, score double"))
        found = scan if found is None else found.unionByName(scan)

    asks = once.where("asks").select(F.col("vec_id").alias("query_id"), "h1", "h2")
    named = entries.where("asks").select(F.col("entry").alias("question"), F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(3), "v").alias("h2"))
    pairs = asks.join(named, ["h1", "h2"]).join(found.select("question", "vec_id", "score"), "question").where("query_id != vec_id")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.select("query_id", F.row_number().over(ranked).cast("int").alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
