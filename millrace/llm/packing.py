"""Packing token sequences into windows by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
import os
import re
import sys
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame

#: How the byte-level vocabulary splits text before merges (fixed value, from the tokenizer's published pattern).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same split for the standard library's faster engine, right where no character of UNCOMMON is met: those are
#: numbers other than digits, separators on which the engines differ, and all beyond the Latin blocks.
COMMON_SPLIT = r""" ?[^\W\d_]+| ?\d+|'s|'t|'re|'ve|'m|'ll|'d| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"""
UNCOMMON = "[\x1c-\x1f\xb2\xb3\xb9\xbc-\xbe\u0250-\U0010ffff]"
MEMO_PIECES, MEMO_CHARS = 1_500_000, 32
_encoders: dict[str, "ByteLevelEncoder"] = {}


def as_bytes(ids: list[int]) -> bytes:
    """Ids as little-endian uint32."""
    a = array("I", ids)
    if sys.byteorder != "little":
        a.byteswap()
    return a.tobytes()


class _Pieces(dict):
    """Ids of pieces, encoded by the library when first met."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        ids = as_bytes(self.encode(piece, add_special_tokens=False).ids)
        if len(piece) <= MEMO_CHARS:
            self[piece] = ids
        return ids


class ByteLevelEncoder:
    """Token ids of a byte-level BPE file as little-endian uint32 bytes.

    Merges never cross the pieces that the split pattern makes, so each distinct piece is encoded once by the library
    and remembered; texts that hold a special token's string go to the library whole. The memory of pieces is bounded
    by MEMO_PIECES and only saves time.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.any_split = regex.compile(SPLIT).findall
        self.common_split, self.uncommon = re.compile(COMMON_SPLIT).findall, re.compile(UNCOMMON).search
        self.memo = _Pieces(self.tokenizer.encode)

    def library(self, text: str) -> bytes:
        return as_bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return self.library(text)
        if len(self.memo) > MEMO_PIECES:
            self.memo.clear()
        split = self.any_split if self.uncommon(text) else self.common_split
        return b"".join(map(self.memo.__getitem__, split(text)))


def encoder(path: str) -> ByteLevelEncoder:
    if path not in _encoders:
        _encoders[path] = ByteLevelEncoder(path)
    return _encoders[path]


def difference(sizes: np.ndarray, windows: int) -> np.ndarray:
    """Karmarkar-Karp: the window of each size when they are dealt over ``windows`` windows.

    A partial partition is a vector of window sums in falling order. The two with the largest spread are merged with
    opposing order, the larger sums of one meeting the smaller of the other, until one partition is left. Ties go to
    the partition made first.
    """
    n = len(sizes)
    if windows <= 1 or n == 1:
        return np.zeros(n, dtype=np.int64)
    sums: list[np.ndarray | None] = []
    heap = []
    for i, s in enumerate(sizes):
        v = np.zeros(windows, dtype=np.int64)
        v[0] = s
        sums.append(v)
        heap.append((-int(s), i))
    heapq.heapify(heap)
    merges = []
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        v = sums[a] + sums[b][::-1]
        order = np.argsort(-v, kind="stable")
        v = v[order]
        v -= v[-1]
        sums[a] = sums[b] = None
        sums.append(v)
        merges.append((a, b, order.astype(np.int32)))
        heapq.heappush(heap, (-int(v[0]), len(sums) - 1))
    place: dict[int, np.ndarray] = {len(sums) - 1: np.arange(windows)}
    for k in range(len(merges) - 1, -1, -1):
        a, b, order = merges[k]
        here = place.pop(n + k)
        back = np.empty(windows, dtype=np.int64)
        back[order] = here
        place[a], place[b] = back, back[::-1]
    return np.array([place[i][0] for i in range(n)], dtype=np.int64)


def windows_of(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """Windows for ``sizes``: as few as their sum allows, one more as long as some window exceeds the capacity."""
    windows = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        dealt = difference(sizes, windows)
        if np.bincount(dealt, sizes, windows).max() <= capacity:
            return dealt, windows
        windows += 1


def pack(
    docs: DataFrame, id_col: str | Column, text_col: str | Column, tokenizer_path: str, *, capacity: int = 1024, fragment: int = 256,
    group: int = 640, end_id: int = 0, carry: str | None = None,
) -> DataFrame:
    """Pack every document's token ids, each followed by ``end_id``, into sequences of at most ``capacity``.

    A document gives as many whole windows as it fills; its remainder is cut into fragments of at most ``fragment``
    ids. Fragments of about ``group`` neighbours in a partition are dealt over the fewest windows by Karmarkar-Karp
    differencing. Nothing is shuffled and a task holds one group of fragments at a time.

    Returns a row for each piece: doc_id, start, length, tokens (the ids as little-endian uint32 bytes), doc_tokens,
    sequence_id (unique, not consecutive, rising with the partition and the groups within), offset, and the document's
    value of the whole-number column ``carry`` where one is named. A null or empty text is the end id alone; very long texts are
    encoded whole, one at a time, and give a window after the other; rows with equal or null ids are packed each for itself;
    an empty table gives no rows. Ids are whole numbers; other columns don't matter, whatever their names. Sequences aren't
    filled with padding here.
    """
    import pyspark.sql.functions as F

    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    schema = "doc_id long, start long, length long, tokens binary, doc_tokens long, sequence_id long, offset long"
    names = ["doc_id", "start", "length", "tokens", "doc_tokens", "sequence_id", "offset"]
    arrow = pa.schema([
        ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("tokens", pa.binary()), ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()), ("offset", pa.int64()),
    ])
    if carry:
        schema, names, arrow = f"{schema}, `{carry}` long", [*names, carry], arrow.append(pa.field(carry, pa.int64()))
    if not 1 <= fragment <= capacity:
        raise ValueError("fragment must be from 1 to capacity")

    def run(batches):
        encode = encoder(tokenizer_path).encode
        end = np.asarray([end_id], "<u4").tobytes()
        first = TaskContext.get().partitionId() << 40
        made = 0
        rows: list[tuple] = []
        waiting: list[tuple] = []

        def deal():
            nonlocal made
            sizes = np.array([len(w[2]) // 4 for w in waiting], dtype=np.int64)
            dealt, windows = windows_of(sizes, capacity)
            order = np.argsort(dealt, kind="stable")
            last, offset = -1, 0
            for i in order:
                if dealt[i] != last:
                    last, offset = dealt[i], 0
                doc, start, ids, total, *more = waiting[i]
                rows.append((doc, start, int(sizes[i]), ids, total, first + made + int(last), offset, *more))
                offset += int(sizes[i])
            made += windows
            waiting.clear()

        def out():
            table = pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), arrow)], names=names)
            rows.clear()
            return table

        for batch in batches:
            texts, carried = batch.column(1), batch.column(2).to_pylist() if carry else None
            held = 0
            for k, doc in enumerate(batch.column(0).to_pylist()):
                ids = encode(texts[k].as_py() or "") + end
                total, at, more = len(ids) // 4, 0, (carried[k],) if carry else ()
                while total - at >= capacity:
                    rows.append((doc, at, capacity, ids[4 * at : 4 * (at + capacity)], total, first + made, 0, *more))
                    made += 1
                    at += capacity
                while at < total:
                    size = min(fragment, total - at)
                    waiting.append((doc, at, ids[4 * at : 4 * (at + size)], total, *more))
                    at += size
                if len(waiting) >= group:
                    deal()
                held += len(ids)
                if held > 1 << 23 and rows:
                    yield out()
                    held = 0
            if rows:
                yield out()
        if waiting:
            deal()
            yield out()

    return docs.select(
        as_col(id_col).cast("long").alias("doc_id"), as_col(text_col).cast("string").alias("text"),
        *[F.col(c).cast("long") for c in [carry] if c],
    ).mapInArrow(run, schema)
