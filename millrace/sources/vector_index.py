"""Vectors in lists by centroid: a question reads the lists near it, or all that its hits can be in."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import cosine
from ..tables import tidy

#: Lists of an index, and vectors for each that its centroids are fitted on at most.
LISTS, SAMPLE = 64, 256
PLACES = 9  # as scores are rounded elsewhere


def write_index(chunks: DataFrame, path: str, lists: int = LISTS, seed: int = 1) -> None:
    """Write (chunk_id, embedding) in ``lists`` lists by direction at ``path``: a folder of rows for each, and a table of centroids
    with the widest angle of each list.

    Centroids are fitted on at most ``SAMPLE`` vectors a list, those with the least hash of their id; every vector is indexed, but for
    null and zero ones, which have no direction. A large list is written by several tasks.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    length = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    rows = chunks.select("chunk_id", "embedding").where(length > 0).withColumn("v", array_to_vector(F.col("embedding").cast("array<double>")))
    sample = rows.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(lists * SAMPLE)
    if not sample.limit(1).count():
        centers = []
        dealt = rows.select("chunk_id", "embedding", F.lit(0).alias("list"))
    else:
        model = KMeans(k=lists, distanceMeasure="cosine", seed=seed, maxIter=10, featuresCol="v", predictionCol="list").fit(sample)
        centers = [(i, (c / np.linalg.norm(c)).tolist()) for i, c in enumerate(model.clusterCenters())]
        dealt = model.transform(rows).select("chunk_id", "embedding", "list")
    spark = chunks.sparkSession
    table = spark.createDataFrame(centers, "list int, center array<double>")
    with tidy(spark):
        dealt.hint("rebalance", "list").write.partitionBy("list").option("compression", "zstd").parquet(f"{path}/rows")
    stored = _rows(spark, path).join(table, "list")
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine(F.col("embedding"), F.col("center")))))
    widest = stored.groupBy("list").agg(F.max(angle).alias("angle"), F.count("*").alias("size"))
    table.join(widest, "list").coalesce(1).write.parquet(f"{path}/lists")


def _rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("chunk_id long, embedding array<float>, list int").parquet(f"{path}/rows")


@dataclass(frozen=True)
class VectorIndex:
    """A written index. The driver holds its centroids, a row for each list."""

    rows: DataFrame
    lists: np.ndarray
    centers: np.ndarray
    angles: np.ndarray

    @staticmethod
    def open(spark: SparkSession, path: str) -> VectorIndex:
        found = sorted(spark.read.schema("list int, center array<double>, angle double").parquet(f"{path}/lists").collect())
        return VectorIndex(_rows(spark, path), np.array([r.list for r in found], np.int64), np.array([r.center for r in found]), np.array([r.angle for r in found]))

    def angles_to(self, query: list[float]) -> np.ndarray:
        q = np.asarray(query, np.float64)
        return np.arccos(np.clip(self.centers @ (q / np.linalg.norm(q)), -1, 1)) if len(self.lists) else np.zeros(0)

    def scored(self, query: list[float], lists: np.ndarray) -> DataFrame:
        """Rows of some lists with their score; the other lists' files are not listed among the scan's partitions."""
        score = F.round(cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in query])), PLACES)
        return self.rows.where(F.col("list").isin(*lists.tolist())).select("chunk_id", score.alias("v_score")).where("v_score is not null")

    def hits(self, query: list[float], k: int = 50, probes: int | None = None) -> DataFrame:
        """The ``k`` nearest (chunk_id, v_score) of the ``probes`` nearest lists; exactly the nearest of all where that is None.

        For the exact way the three nearest lists give a k-th score; then all lists are read whose widest angle lets a row reach it.
        """
        if not any(query):
            return self.rows.select("chunk_id", F.lit(0.0).alias("v_score")).where("false")
        to = self.angles_to(query)
        order = np.argsort(to, kind="stable")
        best = lambda lists: self.scored(query, lists).orderBy(F.desc("v_score"), "chunk_id").limit(k)
        if probes is not None:
            return best(self.lists[order[:probes]])
        first = best(self.lists[order[:3]]).agg(F.count("*").alias("n"), F.min("v_score").alias("least")).first()
        if first.n < k:
            return best(self.lists)
        reach = np.cos(np.maximum(0.0, to - self.angles)) >= first.least - 1e-8
        reach[order[:3]] = True
        return best(self.lists[reach])

    def probes_for(self, queries: list[list[float]], k: int = 50, recall: float = 0.9) -> int:
        """The least number of probes that finds this share of the true hits of some questions, all together."""
        found = []
        for q in queries:
            rank = np.empty(len(self.lists), np.int64)
            rank[np.argsort(self.angles_to(q), kind="stable")] = np.arange(len(self.lists))
            of = dict(zip(self.lists.tolist(), rank.tolist()))
            true = self.hits(q, k).join(self.rows.select("chunk_id", "list"), "chunk_id").select("list").collect()
            found += [of[r.list] + 1 for r in true]
        return int(np.sort(found)[max(0, int(np.ceil(recall * len(found))) - 1)]) if found else 1
