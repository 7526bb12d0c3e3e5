"""Quality rules: base limits, and robust multivariate outliers per language and source."""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize

#: Characters that count as symbols (fixed value).
SYMBOLS = "#*$%&|<>"
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: The transformed statistics and the spread below which a difference in each says nothing (added to the covariance).
FEATURES = {
    "log_words": 0.3, "log_word_length": 0.05, "root_symbols": 0.04, "root_dup_lines": 0.12, "root_repeats": 0.12, "root_upper": 0.04,
    "root_punctuation": 0.04,
}
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """Base counts and transformed statistics of a whole text."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # of bytes: at ASCII white space only
    n, chars = len(words), max(1, len(text))
    word_chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    symbols = sum(map(text.count, SYMBOLS))
    seen: set[bytes] = set()
    dup = lines = 0
    for line in raw.split(b"\n"):
        if line.strip():
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    repeats = 0
    if n > 3:
        number = {w: i for i, w in enumerate(dict.fromkeys(words))}
        at, v = np.fromiter(map(number.__getitem__, words), np.int64, n), len(number)
        pair = np.unique(at[:-1] * v + at[1:], return_inverse=True)[1]
        _, inverse, count = np.unique(pair[:-1] * v + at[2:], return_inverse=True, return_counts=True)
        hit = count[inverse] > 1
        cover = np.zeros(n, dtype=bool)
        for k in range(3):
            cover[k : n - 2 + k] |= hit
        repeats = int(cover.sum())
    share = lambda x: math.sqrt(x / chars)
    upper, punctuation = len(raw) - len(raw.translate(None, UPPER)), len(raw) - len(raw.translate(None, PUNCTUATION))
    return [n, word_chars, symbols, dup, repeats], [
        math.log1p(n), math.log(word_chars / n) if n else 0.0, share(symbols), math.sqrt(dup / max(1, lines)),
        math.sqrt(repeats / max(1, n)), share(upper), share(punctuation),
    ]


@F.pandas_udf(T.StructType([*(T.StructField(c, T.LongType()) for c in BASE), T.StructField("v", T.ArrayType(T.DoubleType()))]))
def _statistics(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        found = [statistics(t) for t in texts]
        out = pd.DataFrame([f[0] for f in found], columns=BASE, dtype="int64")
        out["v"] = pd.Series([f[1] for f in found], dtype=object)
        yield out


def chi2(p: float, k: int) -> float:
    """Quantile of the chi-squared distribution, by Wilson and Hilferty."""
    return k * (1 - 2 / (9 * k) + NormalDist().inv_cdf(p) * math.sqrt(2 / (9 * k))) ** 3


P = len(FEATURES)
FLOORS = np.array([s * s for s in FEATURES.values()])
PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
FIT = "center array<double>, cov array<double>, inverse array<double>, logdet double"


def shrunk(
    n: float, center: np.ndarray, cov: np.ndarray, parent: tuple[np.ndarray, np.ndarray] | None, prior: float,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Center, covariance, its inverse and the log of its determinant: of n rows and ``prior`` rows like the parent's fit.

    The floors are added to the rows' own covariance, so that no direction is without spread.
    """
    cov = cov + np.diag(FLOORS)
    if parent is not None:
        weight = prior / (n + prior)
        center, cov = (1 - weight) * center + weight * parent[0], (1 - weight) * cov + weight * parent[1]
    return center, cov, np.linalg.inv(cov), float(np.linalg.slogdet(cov)[1])


def away(rows: DataFrame) -> DataFrame:
    """Add ``d0_``, ``d1_``, ..., what each statistic lies above the center, and ``d2``, the squared Mahalanobis distance, written
    out so that it is compiled. The differences are columns of their own, so that plans don't repeat them in every term."""
    d = [F.col(f"d{i}_") for i in range(P)]
    terms = (d[i] * d[j] * F.col("inverse")[i * P + j] * F.lit(1.0 if i == j else 2.0) for i, j in PAIRS)
    there = rows.withColumns({f"d{i}_": F.col("v")[i] - F.col("center")[i] for i in range(P)})
    return there.withColumn("d2", sum(terms, F.lit(0.0)))


def _starts(rows: DataFrame, key: str) -> DataFrame:
    """Two fits to start from for each group: its medians with the floors, and with its quartile ranges added to them."""
    quartiles = [F.percentile_approx(F.col("v")[i], F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.lit(2000)).alias(f"q{i}") for i in range(P)]

    @F.pandas_udf(f"array<struct<start:int,{FIT.replace(' array', ':array').replace(' double', ':double').replace(', ', ',')}>>")
    def made(q: pd.Series) -> pd.Series:
        out = []
        for x in q:
            m = np.stack([np.asarray(r, float) for r in x])
            both = []
            for start, spread in enumerate((FLOORS, FLOORS + (m[:, 2] - m[:, 0]) ** 2 / 1.82)):
                both.append({
                    "start": start, "center": m[:, 1], "cov": np.diag(spread).ravel(), "inverse": np.diag(1 / spread).ravel(),
                    "logdet": float(np.log(spread).sum()),
                })
            out.append(both)
        return pd.Series(out, dtype=object)

    found = rows.groupBy(key).agg(*quartiles).select(key, F.array(*[f"q{i}" for i in range(P)]).alias("q"))
    return found.select(key, F.explode(made("q")).alias("f")).select(key, "f.*")


def fits(
    rows: DataFrame, key: str, parent: str | None = None, parents: DataFrame | None = None, *, share: float = 0.75, prior: float = 100.0,
    steps: int = 20,
) -> DataFrame:
    """(key, center, cov, inverse, logdet): the minimum-covariance-determinant estimate of ``v`` for every value of ``key``.

    From each start, concentration steps fit center and covariance to the ``share`` of the group's rows nearest to the last
    fit, until no determinant moves by more than a hundredth; the start that ends with the least determinant counts. A group's estimate is
    shrunk towards its parent's, ``prior`` rows strong, in every step (a regularised determinant, which steps don't
    raise either). Rows are read as often as there are steps; groups are sums and mergeable sketches, never gathered.
    """
    current = materialize(_starts(rows, key), "fits")
    for _ in range(steps):
        with_fit = rows.join(current.select(key, "start", "center", "inverse"), key)
        near = away(with_fit)
        limit = near.groupBy(key, "start").agg(F.percentile_approx("d2", F.lit(share), F.lit(2000)).alias("limit"))
        inner = near.join(limit, [key, "start"]).where(F.col("d2") <= F.col("limit"))
        # plain sums around the last center: a far smaller plan than that of as many covariances
        d = [F.col(f"d{i}_") for i in range(P)]
        own = [F.count("*").alias("n"), F.array(*[F.sum(c) for c in d]).alias("m"), F.array(*[F.sum(d[i] * d[j]) for i, j in PAIRS]).alias("s")]
        sums = inner.groupBy(key, "start").agg(*own, F.first("center").alias("at"), *([F.first(parent).alias("_parent")] if parent else []))
        if parents is not None:
            up = parents.select(F.col(parent).alias("_parent"), F.col("center").alias("up_center"), F.col("cov").alias("up_cov"))
            sums = sums.join(up, "_parent")
        else:
            sums = sums.withColumns({"up_center": F.lit(None).cast("array<double>"), "up_cov": F.lit(None).cast("array<double>")})

        @F.pandas_udf(FIT)
        def fitted(n: pd.Series, m: pd.Series, s: pd.Series, at: pd.Series, up_center: pd.Series, up_cov: pd.Series) -> pd.DataFrame:
            out = []
            for count, total, values, old, uc, us in zip(n, m, s, at, up_center, up_cov):
                mean, cov = np.asarray(total, float) / count, np.zeros((P, P))
                for (i, j), value in zip(PAIRS, values):
                    cov[i, j] = cov[j, i] = value / count - mean[i] * mean[j]
                center = np.asarray(old, float) + mean
                over = None if uc is None else (np.asarray(uc, float), np.asarray(us, float).reshape(P, P))
                center, cov, inverse, logdet = shrunk(count, center, cov, over, prior)
                out.append((center, cov.ravel(), inverse.ravel(), logdet))
            return pd.DataFrame(out, columns=["center", "cov", "inverse", "logdet"])

        before = current.select(key, "start", F.col("logdet").alias("before"))
        new = sums.select(key, "start", fitted("n", "m", "s", "at", "up_center", "up_cov").alias("f")).select(key, "start", "f.*")
        seen = Observation()  # taken while the table is written: no job of its own
        new = new.join(before, [key, "start"]).observe(seen, F.max(F.abs(F.col("logdet") - F.col("before"))).alias("moved"))
        current = materialize(new, "fits")
        moved = seen.get.get("moved")  # none where no row passes the base rules
        if moved is None or moved < 1e-2:
            break
    best = current.groupBy(key).agg(F.min_by(F.struct("center", "cov", "inverse", "logdet"), F.struct("logdet", "start")).alias("f"))
    return materialize(best.select(key, "f.*"), "fits")


def robust_distance(rows: DataFrame, keys: list[str], *, share: float = 0.75, prior: float = 100.0, tail: float = 0.01) -> DataFrame:
    """Add ``d2``, the squared Mahalanobis distance of ``v`` to its group's ``fits``, and ``cut``, beyond which ``tail`` of the
    group's regular rows are expected. ``keys`` are key columns from the widest group to the narrowest, which is judged.

    The cut carries a log-normal tail on from the median and upper quartile of the group's distances, which up to a
    quarter of outliers don't reach, and is fitted once more to the rows within it, as outliers widen the first one; it
    is never below the chi-squared quantile. Quartiles of small groups are drawn towards those of the wider ones, ``prior``
    rows strong. Distances are scaled so that the median of the rows within is that of a chi-squared variable.
    """
    parents, up = None, None
    for key in keys:
        parents, up = fits(rows, key, up, parents, share=share, prior=prior), key
    columns, own = rows.columns, keys[-1]
    judged = rows.join(parents.select(own, "center", "inverse"), own)
    judged = away(judged).select(*columns, "d2")
    reach = NormalDist().inv_cdf(1 - tail) / NormalDist().inv_cdf(0.75)

    def fitted(part: DataFrame) -> DataFrame:
        quartiles = None
        for key in keys:
            above = keys[: keys.index(key)][-1:]
            both = F.percentile_approx("d2", F.array(F.lit(0.5), F.lit(0.75)), F.lit(2000))
            logs = F.transform(both, lambda x: F.log(F.greatest(x, F.lit(1e-9))))
            here = part.groupBy(key).agg(F.count("*").alias("n"), logs.alias("q"), *[F.first(c).alias(c) for c in above])
            if quartiles is not None:
                weight = F.col("n") / (F.col("n") + F.lit(prior))
                mix = F.zip_with("q", "up_q", lambda a, b: weight * a + (1 - weight) * b)
                here = here.join(quartiles.withColumnRenamed("q", "up_q"), above).select(key, mix.alias("q"))
            quartiles = here.select(key, "q")
        middle, upper = (F.exp(F.col("q")[i]) for i in range(2))
        cut = F.greatest(F.pow(upper / middle, F.lit(reach)), F.lit(chi2(1 - tail, P) / chi2(0.5, P)))
        return quartiles.select(own, middle.alias("middle"), (middle * cut).alias("limit"))

    regular = judged.join(materialize(fitted(judged), "cuts"), own).where(F.col("d2") <= F.col("limit")).select(*columns, "d2")
    scale = F.lit(chi2(0.5, P)) / F.col("middle")
    last = materialize(fitted(regular), "cuts")
    return judged.join(last, own).select(*columns, (F.col("d2") * scale).alias("d2"), (F.col("limit") * scale).alias("cut"))


def quality_rules(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
    min_words: int = 50, max_repeat: int = 50, prior: float = 100.0, tail: float = 0.01,
) -> DataFrame:
    """Base counts of every whole text, and whether it is kept.

    base_failed: fewer than ``min_words`` words, or over ``max_repeat`` percent of them in 3-word windows found twice
    or more. The others are outliers where their transformed statistics lie further from the robust center of their
    (language, source) than a cut from that group's own distances, which ``tail`` of its regular documents exceed. Every
    group is judged by its own estimate; those are drawn towards the language's, and these towards that of all documents, by
    as much as ``prior`` documents weigh, so that a group of any size has one.

    Returns doc_id, the five base counts (long), base_failed, distance (squared; null where base_failed), kept; a row
    for each input row, whatever other columns there are. Null language or source is a group of its own; null or empty text
    has no words and fails; very long texts are counted whole; repeated rows are judged each; an empty table gives no rows.
    Statistics cover all rows that pass the base rules.
    """
    lang, source = F.col(lang_col).cast("string"), F.col(source_col).cast("string")
    groups = [
        F.lit("all").alias("k0"), F.to_json(F.struct(lang.alias("l"))).alias("k1"),
        F.to_json(F.struct(lang.alias("l"), source.alias("s"))).alias("k2"),
    ]
    rows = docs.select(F.col(id_col).alias("doc_id"), *groups, _statistics(F.col(text_col).cast("string")).alias("s"))
    failed: Column = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    rows = materialize(rows.select("doc_id", "k0", "k1", "k2", "s.*").withColumn("base_failed", failed), "statistics")
    judged = robust_distance(rows.where(~F.col("base_failed")), ["k0", "k1", "k2"], prior=prior, tail=tail)
    columns = ["doc_id", *BASE, "base_failed"]
    done = judged.select(*columns, F.col("d2").alias("distance"), (F.col("d2") <= F.col("cut")).alias("kept"))
    return done.unionByName(rows.where("base_failed").select(*columns, F.lit(None).cast("double").alias("distance"), F.lit(False).alias("kept")))
