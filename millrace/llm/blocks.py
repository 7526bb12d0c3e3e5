"""Corpus-wide sums over the distinct keys of blocks of documents.

A block is a run of documents in one partition. What a block needs to know about its distinct keys (words, n-grams) over
the whole corpus is asked for and answered by ranges of the keys' hashes:

* a block sends each of FAN ranges one cell with the keys that fall into it, never a row for each occurrence;
* a range, one group of a shuffle, sums the keys of all its cells and answers each cell in the order in which it asked;
* where one range would be too much for a task, FAN blocks at a time first merge their cells of a range, whose distinct keys
  are sent on to FAN ranges within it, and their answers are dealt out again.

A block thus writes FAN cells on each level, so that rows and bytes follow the number of blocks, and a key in every
document costs one entry for each block.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import input_bytes, materialize

#: Characters of text in a block; ranges a level splits into, a power of two; bytes of input that one range may stand for.
BLOCK_CHARS, FAN_BITS, RANGE_BYTES = 6_000_000, 6, 16 << 20
FAN = 1 << FAN_BITS
CELL = "block long, part long, payload binary"


def planes(a: np.ndarray, kind: str = "<u4") -> np.ndarray:
    """Whole numbers of ``kind`` as byte planes, which compress well."""
    a = np.ascontiguousarray(a, kind)
    return np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.dtype.itemsize).T)


def unplanes(p: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(p.T).view(f"<u{len(p)}").ravel()


def rising(a: np.ndarray) -> np.ndarray:
    """Sorted 64-bit hashes as planes of their differences."""
    return planes(np.diff(a, prepend=a.dtype.type(0)), "<u8")


def unrising(p: np.ndarray) -> np.ndarray:
    return np.cumsum(unplanes(p), dtype=np.uint64)


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of two, in order."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ np.uint64(0xC2B2AE3D27D4EB4F))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def dumps(*what) -> bytes:
    return pickle.dumps(what, protocol=5)


loads = pickle.loads


def table(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    """Cells as an Arrow batch."""
    block, part, payload = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(block, pa.int64()), pa.array(part, pa.int64()), pa.array(payload, pa.binary())], names=["block", "part", "payload"],
    )


def levels_for(df: DataFrame) -> int:
    """Levels of ranges in proportion to the logarithm of the input; one where Spark has no estimate of its size."""
    size, levels = input_bytes(df), 1
    while size < 1 << 55 and size > RANGE_BYTES * FAN**levels:
        levels += 1
    return levels


def _number(v: np.ndarray) -> np.ndarray:
    """A column of a cell: floats as they are, whole numbers as planes."""
    return v if v.dtype.kind == "f" else planes(v, "<u4" if not len(v) or v.max() < 1 << 32 else "<u8")


def _column(v: np.ndarray) -> np.ndarray:
    return v if v.dtype.kind == "f" else unplanes(v).astype(np.int64)


def asks(block: int, keys: np.ndarray, values: list[np.ndarray], wanted: np.ndarray | None = None, level: int = 1) -> list[tuple[int, int, bytes]]:
    """The cells of a block for its sorted distinct keys: their values, and for which of them it wants the sums (all)."""
    part = (keys >> np.uint64(64 - FAN_BITS * level)).astype(np.int64)
    found, first = np.unique(part, return_index=True)
    out = []
    for p, a, b in zip(found.tolist(), first, [*first[1:], len(keys)]):
        want = None if wanted is None else np.packbits(wanted[a:b])
        out.append((block, p, dumps(rising(keys[a:b]), [_number(v[a:b]) for v in values], want)))
    return out


class Cells:
    """The cells of one group, with their keys numbered."""

    def __init__(self, payloads: list[bytes]):
        got = [loads(p) for p in payloads]
        keys = [unrising(k) for k, _, _ in got]
        self.sizes = [len(k) for k in keys]
        self.keys, self.first, self.inverse = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        self.values = [np.concatenate([_column(v[c]) for _, v, _ in got]) for c in range(len(got[0][1]))]
        bits = [None if w is None else np.unpackbits(w, count=n).astype(bool) for (_, _, w), n in zip(got, self.sizes)]
        self.wanted = None if bits[0] is None else np.concatenate(bits)

    def sums(self) -> list[np.ndarray]:
        n = len(self.keys)
        return [np.bincount(self.inverse, v, n) if v.dtype.kind == "f" else np.bincount(self.inverse, v, n).round().astype(np.int64) for v in self.values]

    def answers(self, sums: list[np.ndarray], owned: np.ndarray) -> list[bytes]:
        """The sums for each cell, and of which keys it is the owner: the first cell that holds one."""
        mine = np.zeros(len(self.inverse), dtype=bool)
        mine[self.first] = owned
        out, at = [], 0
        for n in self.sizes:
            part = slice(at, at + n)
            keep = slice(None) if self.wanted is None else self.wanted[part]
            out.append(dumps([_number(s[self.inverse[part]][keep]) for s in sums], np.packbits(mine[part]), n))
            at += n
        return out


def sums(cells: DataFrame, levels: int, level: int = 1) -> DataFrame:
    """The answer to every cell (see ``asks``): (block, part, payload), payload being sums of the wanted keys for each
    column, owner bits of all keys, and their number."""

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block", kind="stable")
        held = Cells(pdf["payload"].tolist())
        return pdf.assign(payload=held.answers(held.sums(), np.ones(len(held.keys), bool)))

    if level >= levels:
        return cells.groupBy("part").applyInPandas(whole, CELL)
    groups = -(-cells.select("block").distinct().count() // FAN)
    grouped = cells.withColumn("group", F.pmod(F.xxhash64("block"), F.lit(max(1, groups))))

    def merge(key, pdf: pd.DataFrame) -> pd.DataFrame:
        held = Cells(pdf.sort_values("block", kind="stable")["payload"].tolist())
        wanted = None if held.wanted is None else np.bincount(held.inverse, held.wanted, len(held.keys)) > 0
        return pd.DataFrame(asks(int(key[1]), held.keys, held.sums(), wanted, level + 1), columns=["block", "part", "payload"])

    def spread(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values("block", kind="stable")
        held, told = Cells(left["payload"].tolist()), [loads(p) for p in right.sort_values("part")["payload"]]
        owned = np.concatenate([np.unpackbits(o, count=n).astype(bool) for _, o, n in told])
        columns = [np.concatenate([_column(s[c]) for s, _, _ in told]) for c in range(len(told[0][0]))]
        if held.wanted is not None:  # sums came for wanted keys only
            wanted = np.bincount(held.inverse, held.wanted, len(held.keys)) > 0
            for c, v in enumerate(columns):
                columns[c] = np.zeros(len(held.keys), v.dtype)
                columns[c][wanted] = v
        return left.assign(payload=held.answers(columns, owned))[["block", "part", "payload"]]

    merged = materialize(grouped.groupBy("part", "group").applyInPandas(merge, CELL), "merged")
    told = sums(merged, levels, level + 1).select(F.shiftright("part", FAN_BITS).alias("top"), F.col("block").alias("of"), "part", "payload")
    return grouped.groupBy("part", "group").cogroup(told.groupBy("top", "of")).applyInPandas(spread, CELL)


def told(answers: list[tuple[int, bytes]], columns: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Sums and ownership of a block's keys in their order, from its (part, payload) answers."""
    got = [loads(p) for _, p in sorted(answers)]
    if not got:
        return [np.zeros(0)] * columns, np.zeros(0, bool)
    return [np.concatenate([_column(s[c]) for s, _, _ in got]) for c in range(columns)], np.concatenate([np.unpackbits(o, count=n).astype(bool) for _, o, n in got])


def meet(states: DataFrame, answers: DataFrame, fn, schema: str) -> DataFrame:
    """``fn(block, state, answers)`` for each block: its state and a dict of lists of (part, payload) by kind.

    ``answers`` has the columns kind, block, part, payload.
    """

    def run(key, left, right):
        by_kind: dict[str, list] = {}
        for kind, part, payload in zip(right["kind"], right["part"], right["payload"]):
            by_kind.setdefault(kind, []).append((part, payload))
        return fn(int(key[0]), left["payload"].iloc[0], by_kind)

    return states.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(run, schema)


def labelled(kind: str, answers: DataFrame) -> DataFrame:
    return answers.select(F.lit(kind).alias("kind"), "block", "part", "payload")
