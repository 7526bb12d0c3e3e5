"""Passages of test sets in training texts: a broadcast set of word windows, scanned, verified and cut out."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: A set of at most so many windows, with so many bytes, is broadcast; beyond that, windows are joined.
MAX_WINDOWS, MAX_BYTES = 1_000_000, 64 << 20
#: Words, after A-Z are lower-cased: runs of digits, a-z, and whatever isn't ASCII.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BASE = np.uint64(0x9E3779B97F4A7C15)
FOUND = "n_words long, n_hit long, spans array<struct<start:int,end:int>>, windows array<long>"


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.encode().lower().decode()) if text else []


def word_hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word) or 1


def window_hashes(values: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Of the windows that begin at ``starts``, from the hashes of their words."""
    h = np.full(len(starts), length, np.uint64)
    for j in range(length):
        h = h * BASE + values[starts + j]
    return h


@dataclass(frozen=True)
class Windows:
    """The windows of a test set: words, by their number, and the values of all words in them."""

    words: dict[int, tuple[str, ...]]
    values: dict[str, int]
    lengths: dict[int, tuple[np.ndarray, np.ndarray]]

    @staticmethod
    def of(windows: dict[int, tuple[str, ...]]) -> Windows:
        values = {w: word_hash(w) for words in windows.values() for w in words}
        by_length: dict[int, list[int]] = {}
        for i, w in windows.items():
            by_length.setdefault(len(w), []).append(i)
        lengths = {}
        for n, ids in by_length.items():
            rows = np.array([[values[w] for w in windows[i]] for i in ids], np.uint64).reshape(-1)
            h = window_hashes(rows, np.arange(len(ids)) * n, n)
            order = np.argsort(h, kind="stable")
            lengths[n] = h[order], np.array(ids)[order]
        return Windows(windows, values, lengths)

    def hits(self, words: list[str]) -> list[tuple[int, int]]:
        """(start, window) of every occurrence. Windows with a word that the test set lacks are passed over."""
        v = np.fromiter(map(self.values.get, words, [0] * len(words)), np.uint64, len(words))
        known = np.concatenate(([0], np.cumsum(v != 0)))
        found = []
        for n, (hashes, ids) in self.lengths.items():
            starts = np.flatnonzero(known[n:] - known[:-n] == n) if len(words) >= n else ()
            if not len(starts):
                continue
            h = window_hashes(v, starts, n)
            low = np.searchsorted(hashes, h, "left")
            for s, a, b in zip(starts.tolist(), low.tolist(), np.searchsorted(hashes, h, "right").tolist()):
                found += [(s, i) for i in ids[a:b].tolist() if self.words[i] == tuple(words[s : s + n])]
        return found


def _marked(text: str | None, words: list[str], hits: list[tuple[int, int, int]]) -> tuple:
    """Counts, spans of hit words (merged where nothing but non-words lies between) and windows, from (start, length, window)."""
    if not hits:
        return len(words), 0, [], []
    hit = np.zeros(len(words) + 1, np.int64)
    for s, n, _ in hits:
        hit[s] += 1
        hit[s + n] -= 1
    hit = np.cumsum(hit)[:-1] > 0
    spans: list[tuple[int, int]] = []
    inside = False
    for at, m in zip(hit, WORD.finditer(text.encode().lower().decode())):
        if at:
            spans.append((spans.pop()[0] if inside else m.start(), m.end()))
        inside = at
    return len(words), int(hit.sum()), spans, sorted({w for *_, w in hits})


def _rows(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame({
        "n_words": [r[0] for r in rows], "n_hit": [r[1] for r in rows], "spans": [[{"start": a, "end": b} for a, b in r[2]] for r in rows],
        "windows": [r[3] for r in rows],
    })


def test_windows(items: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """(item, window): the distinct windows of ``n`` words of each item, or all of its words if fewer; ids as strings, a
    null id as the empty one."""
    def windows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for item, text in zip(f["item"], f["text"]):
                w = words_of(text)
                rows += [(item, " ".join(w[i : i + n])) for i in range(max(1, len(w) - n + 1))] if w else []
            yield pd.DataFrame(rows, columns=["item", "window"])

    named = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).alias("text"))
    return named.mapInPandas(windows, "item string, window string").distinct()


test_windows.__test__ = False


def contamination(
    docs: DataFrame, items: DataFrame, n: int = 10, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", max_windows: int = MAX_WINDOWS,
) -> DataFrame:
    """Every document with ``n_words``, ``n_hit`` (words within windows of the test set), ``spans`` (of hit words, in code points,
    end exclusive) and ``items`` (ids as strings, sorted); columns of these names are replaced.

    Null and empty texts have no words; items without words have no windows. Repeated items count once by id. A text is
    scanned whole, in time linear in its words and its hits. The test set's windows are counted first: up to ``max_windows`` they go to
    the executors as one broadcast set and documents need no shuffle; more of them are joined by hash, and hits verified afterwards.
    """
    grams = materialize(test_windows(items, n, item_id, item_text), "windows")
    size = grams.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("window") + F.octet_length("item")), F.lit(0)).alias("bytes")).first()
    others = [c for c in docs.columns if c not in ("n_words", "n_hit", "spans", "items")]
    docs = docs.select(*others)
    return (_scanned if size.n <= max_windows and size.bytes <= MAX_BYTES else _joined)(docs, grams, n, text_col, others)


def _scanned(docs: DataFrame, grams: DataFrame, n: int, text_col: str, others: list[str]) -> DataFrame:
    numbers: dict[str, int] = {}
    items: dict[int, list[str]] = {}
    for r in grams.collect():  # counted before
        items.setdefault(numbers.setdefault(r.window, len(numbers)), []).append(r.item)
    windows = {i: tuple(w.split(" ")) for w, i in numbers.items()}
    shared = docs.sparkSession.sparkContext.broadcast((windows, items))

    @F.pandas_udf("n_words long, n_hit long, spans array<struct<start:int,end:int>>, items array<string>")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        windows, items = shared.value
        known = Windows.of(windows)
        for texts in batches:
            rows = []
            for text in texts:
                words = words_of(text)
                rows.append(_marked(text, words, [(s, len(windows[i]), i) for s, i in known.hits(words)]))
            found = _rows(rows)
            yield found.drop(columns="windows").assign(items=[sorted({i for w in ws for i in items[w]}) for ws in found["windows"]])

    return docs.withColumn("spans", scan(text_col)).select(*others, "spans.n_words", "spans.n_hit", "spans.spans", "spans.items")


def _joined(docs: DataFrame, grams: DataFrame, n: int, text_col: str, others: list[str]) -> DataFrame:
    """For test sets of any size: windows of all documents meet those of the test set by hash; frequent ones are split by
    adaptive execution, as each hash has few rows on the other side."""
    inner = F.struct(*others).alias("doc")
    rows = materialize(docs.select(F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"), inner), "texts")
    words = grams.select("window").distinct().select(F.monotonically_increasing_id().alias("id"), "window")
    numbered = materialize(words.withColumns({"hash": F.pandas_udf(_hash_of, "long")("window"), "length": F.size(F.split("window", " "))}), "numbered")
    lengths = [r.length for r in numbered.select("length").distinct().collect()]  # n at most

    def hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for row, text in zip(f["row"], f["text"]):
                w = words_of(text)
                v = np.fromiter(map(word_hash, w), np.uint64, len(w))
                for length in lengths:
                    for a in range(0, len(w) - length + 1, 100_000):
                        starts = np.arange(a, min(a + 100_000, len(w) - length + 1))
                        yield pd.DataFrame({"row": row, "start": starts, "length": length, "hash": window_hashes(v, starts, length).view(np.int64)})

    at = rows.select("row", "text").mapInPandas(hashed, "row long, start long, length int, hash long")
    hits = at.join(numbered, ["hash", "length"]).groupBy("row").agg(F.collect_list(F.struct("start", "id", "window")).alias("hits"))

    @F.pandas_udf(FOUND)
    def verified(texts: pd.Series, hits: pd.Series) -> pd.DataFrame:
        out = []
        for text, found in zip(texts, hits):
            w = words_of(text)
            split = [(h["start"], tuple(h["window"].split(" ")), h["id"]) for h in (found if found is not None else [])]
            out.append(_marked(text, w, [(s, len(x), i) for s, x, i in split if tuple(w[s : s + len(x)]) == x]))
        return _rows(out)

    seen = materialize(rows.join(hits, "row", "left").withColumn("found", verified("text", "hits")).select("row", "doc", "found"), "seen")
    named = numbered.select("id", "window").join(grams, "window").select("id", "item")
    items = seen.select("row", F.explode("found.windows").alias("id")).join(named, "id").groupBy("row").agg(F.sort_array(F.collect_set("item")).alias("items"))
    none = F.array().cast("array<string>")
    return seen.join(items, "row", "left").select("doc.*", "found.n_words", "found.n_hit", "found.spans", F.coalesce("items", none).alias("items"))


def _hash_of(windows: pd.Series) -> pd.Series:
    def one(window: str) -> int:
        v = np.array([word_hash(w) for w in window.split(" ")], np.uint64)
        return int(window_hashes(v, np.zeros(1, np.int64), len(v)).view(np.int64)[0])

    return windows.map(one)


def without_spans(text: Column, spans: Column) -> Column:
    """The text without its hit words; what lies between spans stays."""
    gaps = F.transform(
        F.sequence(F.lit(0), F.size(spans)),
        lambda i: F.substring(
            text, F.coalesce(F.get(spans, i - 1)["end"], F.lit(0)) + 1,
            F.coalesce(F.get(spans, i)["start"], F.length(text)) - F.coalesce(F.get(spans, i - 1)["end"], F.lit(0)),
        ),
    )
    return F.when(F.size(spans) == 0, text).otherwise(F.array_join(gaps, ""))


def decontaminate(found: DataFrame, remove: str = "documents", share: float = 0.0, text_col: str = "text") -> DataFrame:
    """What ``contamination`` found is taken out: ``spans`` cuts the hit words from texts, ``documents`` drops documents of which
    more than ``share`` of the words are hit (any, by default)."""
    if remove == "spans":
        return found.withColumn(text_col, without_spans(F.col(text_col), F.col("spans")))
    if remove != "documents":
        raise ValueError("remove is spans or documents")
    return found.where(F.col("n_hit") <= share * F.col("n_words"))
