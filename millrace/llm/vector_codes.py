"""Vectors as short codes: integer codebooks for each part, with entries found by Orchard search."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Vectors that one step of the search works on, which bounds its memory.
BATCH = 8_192


def usable(vector: Column) -> Column:
    """Neither null nor with null or non-finite components."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & fine


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return np.einsum("...i,...i->...", d, d)


@dataclass(frozen=True)
class Book:
    """The entries of one part, as rows of integers."""

    entries: np.ndarray

    @cached_property
    def lists(self) -> tuple[np.ndarray, np.ndarray]:
        """For every entry all others by distance, and a quarter of the squared distances, rounded up: an entry is beyond
        twice a distance if that exceeds its square. The last column ends each list."""
        k = len(self.entries)
        d = squares(self.entries[:, None], self.entries[None])
        np.fill_diagonal(d, -1)
        order = np.argsort(d, axis=1, kind="stable")
        quarters = -(-np.take_along_axis(d, order, 1) // 4)
        ends = np.full((k, 1), np.iinfo(np.int64).max)
        return np.hstack((order[:, 1:], np.zeros((k, 1), np.int64))), np.hstack((quarters[:, 1:], ends))

    @cached_property
    def central(self) -> int:
        """Where searches start: the entry nearest to the mean of all."""
        return int(np.argmin(squares(self.entries, self.entries.sum(0) // len(self.entries))))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """The nearest entry of every row (ties to the lower index), its squared distance, and how many distances that took.

        All rows walk in step. Each goes along the list of its best entry so far, passes over entries it has visited, jumps to
        the list of one that is better, and stops where the list is beyond twice its current distance: no entry farther
        from the best one can be as near to the row.
        """
        order, quarters = self.lists
        best = np.full(len(x), self.central)
        near = squares(x, self.entries[self.central])
        seen = np.zeros((len(x), len(self.entries)), bool)
        seen[:, self.central] = True
        at, live, taken = np.zeros(len(x), np.int64), np.arange(len(x)), len(x)
        while live.size:
            live = live[quarters[best[live], at[live]] <= near[live]]
            entry = order[best[live], at[live]]
            at[live] += 1
            new = ~seen[live, entry]
            row, entry = live[new], entry[new]
            seen[row, entry] = True
            d = squares(x[row], self.entries[entry])
            taken += len(row)
            better = (d < near[row]) | ((d == near[row]) & (entry < best[row]))
            row = row[better]
            best[row], near[row], at[row] = entry[better], d[better], 0
        return best, near, taken


@dataclass(frozen=True)
class Codebooks:
    """A book for each part of a vector; components are floor(scale * x)."""

    books: tuple[Book, ...]
    width: int
    scale: int

    @property
    def sha256(self) -> str:
        """Of all entries' components in decimal by part, entry and position, joined by commas."""
        values = [str(v) for b in self.books for v in b.entries.ravel().tolist()]
        return hashlib.sha256(",".join(values).encode()).hexdigest()

    def parts(self, vectors: list) -> np.ndarray:
        """Rows x parts x width: integers of the vectors, with zeros after the end of short ones."""
        total = len(self.books) * self.width
        x = np.zeros((len(vectors), total))
        for row, v in zip(x, vectors):
            row[: len(v)] = v
        x = np.floor(self.scale * x)
        most = int((2**62 // max(1, self.width)) ** 0.5) // 2
        if x.size and np.abs(x).max() > most:
            raise ValueError(f"components beyond {most // self.scale} have no exact squared distances in 64 bits")
        return x.astype(np.int64).reshape(len(x), len(self.books), self.width)

    def assign(self, vectors: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Parts, the index of each part's nearest entry, and the squared distances summed over a vector's parts."""
        x = self.parts(vectors)
        index, error = np.zeros(x.shape[:2], np.int64), np.zeros(len(x), np.int64)
        for p, book in enumerate(self.books):
            for a in range(0, len(x), BATCH):
                index[a : a + BATCH, p], d, _ = book.nearest(x[a : a + BATCH, p])
                error[a : a + BATCH] += d
        return x, index, error


def fit(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> Codebooks:
    """Codebooks over all usable vectors: each starts as that part of those with the smallest ids, and every round replaces
    an entry by the mean of what is nearest to it, rounded down; entries without anything stay.

    Rows of one id are taken in the order of their vectors, those without id last; fewer rows give fewer entries, none
    give empty books. Vectors that don't cut evenly, or are shorter than the longest, count as ending in zeros.
    Tasks send one sum for each entry; the driver holds the books alone, whose size is ``entries`` vectors.
    """
    used = vectors.where(usable(F.col(vector_col))).select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    longest = used.agg(F.max(F.size("v"))).first()[0] or 0
    first = [r.v for r in used.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()]
    width = -(-longest // parts)
    shape = Codebooks(tuple(Book(np.zeros((0, width), np.int64)) for _ in range(parts)), width, scale)
    start = shape.parts(first)
    found = Codebooks(tuple(Book(start[:, p]) for p in range(parts)), width, scale)
    for _ in range(rounds if first else 0):
        found = _moved(used.select("v"), found)
    return found


def _moved(vectors: DataFrame, old: Codebooks) -> Codebooks:
    """One round: assign all parts, add up, divide."""
    parts, k = len(old.books), len(old.books[0].entries)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros((parts, k), np.int64), np.zeros((parts, k, old.width), np.int64)
        for b in batches:
            x, index, _ = old.assign(b.column(0).to_pylist())
            for p in range(parts):
                n[p] += np.bincount(index[:, p], minlength=k)
                np.add.at(sums[p], index[:, p], x[:, p])
        part, entry = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(entry), pa.array(n[part, entry]), pa.array(list(sums[part, entry]), pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])

    partial = vectors.mapInArrow(add_up, "part long, entry long, n long, sums array<long>")
    total = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[j]).alias(f"s{j}") for j in range(old.width)])
    new = [b.entries.copy() for b in old.books]
    for r in total.collect():  # parts x entries rows at most
        new[r.part][r.entry] = [r[f"s{j}"] // r.n for j in range(old.width)]
    return Codebooks(tuple(map(Book, new)), old.width, old.scale)


def encode(vectors: DataFrame, codebooks: Codebooks, vector_col: str = "embedding") -> DataFrame:
    """Usable rows with ``code`` (two hex digits for each part's entry) and ``error`` (squared distances summed over parts).

    Other rows are dropped; further columns stay, but for those named code and error, which are replaced.
    """
    @F.pandas_udf("code string, error long")
    def coded(v: pd.Series) -> pd.DataFrame:
        _, index, error = codebooks.assign(v.tolist())
        digits = [bytes(r).hex() for r in index.astype(np.uint8)]
        return pd.DataFrame({"code": digits, "error": error})

    others = [c for c in vectors.columns if c not in ("code", "error")]
    rows = vectors.where(usable(F.col(vector_col))).withColumns({"code": coded(vector_col)})
    return rows.select(*others, F.col("code.code").alias("code"), F.col("code.error").alias("error"))


def decode(codes: DataFrame, codebooks: Codebooks, code_col: str = "code") -> DataFrame:
    """``approximate``, the vector that a code stands for: the middle of each integer's interval, divided by the scale."""
    values = [[[(v + 0.5) / codebooks.scale for v in e] for e in b.entries.tolist()] for b in codebooks.books]

    @F.pandas_udf("array<double>")
    def vector(code: pd.Series) -> pd.Series:
        return code.map(lambda c: None if c is None else [x for p, e in enumerate(bytes.fromhex(c)) for x in values[p][e]])

    return codes.withColumn("approximate", vector(code_col))
