"""Language-model scores: a Katz backoff model with Good-Turing discounts, gathered from and read by blocks of documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks
from .common import materialize

#: Counts up to this one are discounted; a history's total is its count plus RESERVE, so that some mass is always left
#: for unseen words.
DISCOUNTED, RESERVE = 5, 0.05
END_WORD = b" end"  # no word holds a space
START = np.uint64(0x51A27B00C0FFEE11)


def discounts(n: list[int]) -> np.ndarray:
    """Katz's Good-Turing factors for counts 0 to DISCOUNTED, from the numbers n[r] of types with count r.

    Where the counts of counts give none between 0 and 1 (small or odd corpora), all counts give up the same absolute
    amount instead.
    """
    k, d = DISCOUNTED, np.ones(DISCOUNTED + 1)
    if all(n[r] > 0 for r in range(1, k + 2)):
        rest = (k + 1) * n[k + 1] / n[1]
        for r in range(1, k + 1):
            d[r] = ((r + 1) * n[r + 1] / (r * n[r]) - rest) / (1 - rest) if rest < 1 else -1
    else:
        d[1:] = -1
    if not all(0 < d[r] < 1 for r in range(1, k + 1)):
        amount = n[1] / (n[1] + 2 * n[2]) if n[1] > 0 and n[2] > 0 else 0.5
        d[1:] = 1 - amount / np.arange(1, k + 1)
    return d


def discounted(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Counts times their discount factors."""
    return c * np.where(c <= DISCOUNTED, d[np.minimum(c, DISCOUNTED).astype(np.int64)], 1.0)


class Unigrams:
    """Probabilities of words from their counts; all unknown words share what the discounts leave."""

    def __init__(self, total: int, n: list[int]):
        self.d = discounts(n)
        kept = discounted(np.arange(DISCOUNTED + 1.0), self.d) @ np.array(n[: DISCOUNTED + 1], float)
        kept += total - sum(r * n[r] for r in range(DISCOUNTED + 1))
        self.unknown = 1.0 if not total else max(1 - kept / total, 1 / (total + 1))
        self.scale = (1 - self.unknown) / kept if total else 0.0

    def __call__(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, discounted(c, self.d) * self.scale, self.unknown)


def _counts_of_counts(answers: DataFrame) -> tuple[int, list[int]]:
    """All occurrences, and the number of types seen 0, 1, ... DISCOUNTED + 1 times; the last item is all types seen."""
    width = DISCOUNTED + 2

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, occurrences = np.zeros(width + 1, dtype=np.int64), 0
        for batch in batches:
            for p in batch.column(0).to_pylist():
                (t, _), owner = blocks.told([(0, p)], 2)
                mine = t[owner]
                occurrences += int(mine.sum())
                mine = mine[mine > 0]
                n[:width] += np.bincount(mine[mine < width], minlength=width)
                n[width] += len(mine)
        yield pa.RecordBatch.from_arrays([pa.array([int(x)]) for x in (occurrences, *n)], names=["all", *[f"n{i}" for i in range(width + 1)]])

    names = ["all", *[f"n{i}" for i in range(width + 1)]]
    row = answers.select("payload").mapInArrow(count, ", ".join(f"`{c}` long" for c in names)).agg(*[F.sum(c).alias(c) for c in names]).first()
    return row["all"] or 0, [row[f"n{i}"] or 0 for i in range(width + 1)]


class Grams:
    """The distinct grams of a block, order by order: 1 are words.

    ``keys`` are their hashes in order, ``inverse`` says which each token ends, ``first`` where each is first met,
    ``before`` which gram of the order below is each token's history: its number there, or the number of them for the
    start of a text.
    """

    def __init__(self, hashes: np.ndarray, stream: np.ndarray, sizes: np.ndarray, order: int):
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
        self.starts, self.keys, self.inverse, self.first, self.before = starts, [hashes], [stream], [None], [None]
        words, gram, start = hashes[stream], hashes[stream], START
        for _ in range(2, order + 1):
            below = np.concatenate(([len(self.keys[-1])], self.inverse[-1][:-1]))
            below[starts] = len(self.keys[-1])
            history = np.concatenate(([start], gram[:-1]))
            history[starts] = start
            gram = blocks.mixed(history, words)
            keys, first, inverse = np.unique(gram, return_index=True, return_inverse=True)
            self.keys.append(keys)
            self.first.append(first)
            self.inverse.append(inverse)
            self.before.append(below)
            start = blocks.mixed(np.array([start]), np.array([START]))[0]

    @staticmethod
    def of(payload: bytes, order: int) -> tuple["Grams", tuple]:
        ids, sizes, taught, hashes, tokens, end = blocks.loads(payload)
        sizes = np.array(sizes)
        return Grams(blocks.unrising(hashes), blocks.unplanes(tokens).astype(np.int64), sizes, order), (ids, sizes, np.array(taught), end)


def katz_scores(docs: DataFrame, train: Column, *, order: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every whole text under a Katz model of ``order`` words learned from the rows where ``train`` holds.

    Words are runs of anything but ASCII white space, A-Z lower-cased; a text is its words and an end, the first words
    having the start in their history. Grams of each order are counted over the corpus in hash ranges (``blocks``): every
    block of documents sends the counts of its distinct grams and gets the corpus-wide ones back. A token is evaluated
    recursively: a seen gram has its discounted count over its history's; an unseen one backs off to the gram without
    its first word, times a weight of its history, so that each history's distribution sums to one; at the bottom are
    words. The weights are sums over the distinct seen grams of a history, each counting once in the block that owns
    it, and go by the same exchange to the blocks that met an unseen gram; only histories that occur outside the training
    rows, where alone grams are unseen, take part.

    Returns doc_id, n_tokens, n_known (tokens seen in training), train_tokens (long), base_score (add-half unigram) and
    score (log10), a row for each input row; other columns don't matter, whatever their names. Ids are whole numbers. A null
    or empty text is the end alone; very long texts are read whole, as a block of their own if need be; null and repeated
    ids keep their rows; without any training row every word is equally unknown and scores 0; an empty table gives no rows.
    """
    levels = blocks.levels_for(docs)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
        F.coalesce(train, F.lit(False)).alias("train"),
    )

    def counted(block: int, grams: Grams, sizes: np.ndarray, taught: np.ndarray, k: int) -> list:
        """Cells of the grams of order ``k``: training counts, and how often held-out tokens have one as their history."""
        learned, n = np.repeat(taught, sizes), len(grams.keys[k - 1])
        counts = np.bincount(grams.inverse[k - 1][learned], minlength=n)
        uses = np.zeros(n, np.int64)
        if k < order:
            follows = ~learned
            follows[grams.starts] = False  # a text's first token has the start as its history
            uses = np.bincount(grams.inverse[k - 1][np.flatnonzero(follows) - 1], minlength=n)
        return blocks.asks(block, grams.keys[k - 1], [counts, uses])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        first, made, chars = TaskContext.get().partitionId() << 24, 0, 0
        number: dict[bytes, int] = {END_WORD: 0}
        ids, sizes, taught, stream = [], [], [], []

        def flush():
            nonlocal made, chars
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, number), np.uint64, len(number))
            sort = np.argsort(hashes)
            rank = np.empty(len(sort), dtype=np.int64)
            rank[sort] = np.arange(len(sort))
            hashes, tokens = hashes[sort], rank[np.concatenate(stream)]
            block = first + made
            state = blocks.dumps(ids[:], sizes[:], taught[:], blocks.rising(hashes), blocks.planes(tokens), int(rank[0]))
            cells = [(block, -1, state), *counted(block, Grams(hashes, tokens, np.array(sizes), 1), np.array(sizes), np.array(taught), 1)]
            made, chars = made + 1, 0
            number.clear()
            number[END_WORD] = 0
            for x in (ids, sizes, taught, stream):
                x.clear()
            return blocks.table(cells)

        for batch in batches:
            texts, flags = batch.column(1), batch.column(2).to_pylist()
            for k, doc in enumerate(batch.column(0).to_pylist()):
                words = (texts[k].as_py() or "").encode().lower().split()
                for w in set(words).difference(number):
                    number[w] = len(number)
                n = len(words)
                at = np.zeros(n + 1, dtype=np.int64)
                at[:n] = np.fromiter(map(number.__getitem__, words), np.int64, n)
                ids.append(doc)
                sizes.append(n + 1)
                taught.append(flags[k])
                stream.append(at)
                chars += 8 * n
                if chars >= blocks.BLOCK_CHARS:
                    yield flush()
        if ids:
            yield flush()

    def gram_counts(k: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                    grams, (_, sizes, taught, _) = Grams.of(payload.as_py(), k)
                    yield blocks.table(counted(block, grams, sizes, taught, k))

        return run

    cells = materialize(rows.mapInArrow(gather, blocks.CELL), "words")
    states = cells.where("part < 0").select("block", "payload")
    answers = [materialize(blocks.sums(cells.where("part >= 0"), levels), "counts-1")]
    for k in range(2, order + 1):
        answers.append(materialize(blocks.sums(states.mapInArrow(gram_counts(k), blocks.CELL), levels), f"counts-{k}"))
    found = [_counts_of_counts(a) for a in answers]
    total, n_words = found[0]
    vocabulary, unigrams, factors = n_words[-1], Unigrams(total, n_words), [discounts(n) for _, n in found]

    def seen_part(block, state, told):
        """What a block knows without backoff weights, and its share of and wish for those."""
        grams, (ids, sizes, taught, end) = Grams.of(state, order)
        got = [blocks.told(told.get(str(k), []), 2) for k in range(1, order + 1)]
        count, uses, owned = [g[0][0] for g in got], [g[0][1] for g in got], [g[1] for g in got]
        assert all(len(c) == len(k) for c, k in zip(count, grams.keys)), "an answer is missing"
        tokens, starts = grams.inverse[0], grams.starts
        p = [unigrams(count[0])]
        with np.errstate(divide="ignore", invalid="ignore"):
            base = np.log10((count[0] + 0.5) / (total + 0.5 * (vocabulary + 1)))
            log_p = np.log10(p[0])[tokens]
        best = np.ones(len(tokens), np.int64)
        history = [None]
        for k in range(2, order + 1):
            texts = count[0][end]  # the start is met as often as the end
            history.append(np.append(count[k - 2], texts))
            over = history[-1][grams.before[k - 1][grams.first[k - 1]]]
            p.append(discounted(count[k - 1], factors[k - 1]) / (over + RESERVE))
            seen = (count[k - 1] > 0)[grams.inverse[k - 1]]
            best[seen] = k
            with np.errstate(divide="ignore"):
                log_p = np.where(seen, np.log10(p[-1])[grams.inverse[k - 1]], log_p)
        known = np.add.reduceat((count[0] > 0)[tokens].astype(np.int64), starts)
        doc_base, doc_log = np.add.reduceat(base[tokens], starts), np.add.reduceat(log_p, starts)
        of_doc = np.repeat(np.arange(len(sizes)), sizes)
        waits, keys, values, wanted = [], [], [], []
        for k in range(2, order + 1):
            before, width = grams.before[k - 1], len(history[k - 1])
            wait = (best < k) & (history[k - 1][before] > 0)
            which, often = np.unique(of_doc[wait] * width + before[wait], return_counts=True)
            mine = owned[k - 1] & (count[k - 1] > 0)
            left = before[grams.first[k - 1]]
            asked = np.append(uses[k - 2] > 0, True)
            mine &= asked[left]
            seen = np.bincount(left[mine], p[k - 1][mine], width)
            lower = np.bincount(left[mine], p[k - 2][grams.inverse[k - 2][grams.first[k - 1]]][mine], width)
            want = np.zeros(width, bool)
            want[which % width] = True
            own = np.flatnonzero(want | (np.bincount(left[mine], minlength=width) > 0))
            names = blocks.mixed(np.append(grams.keys[k - 2], START), np.full(width, k, np.uint64))
            waits.append((which // width, names[which % width], often))
            keys.append(names[own])
            values.append((seen[own], lower[own]))
            wanted.append(want[own])
        out = [(block, -1, blocks.dumps(ids, sizes, known, doc_base, doc_log, waits))]
        if keys and sum(map(len, keys)):
            every = np.concatenate(keys)
            sort = np.argsort(every)
            columns = [np.concatenate([v[c] for v in values])[sort] for c in range(2)]
            out += blocks.asks(block, every[sort], columns, np.concatenate(wanted)[sort])
            out.append((block, -2, blocks.dumps(blocks.rising(every[sort][np.concatenate(wanted)[sort]]))))
        return pd.DataFrame(out, columns=["block", "part", "payload"])

    def whole(block, state, told):
        ids, sizes, known, doc_base, doc_log, waits = blocks.loads(state)
        names = [blocks.unrising(blocks.loads(x)[0]) for _, x in told.get("names", [])]
        if names and len(names[0]):
            (seen, lower), _ = blocks.told(told["weights"], 2)
            weight = np.log10(np.maximum(1 - seen, 1e-12) / np.maximum(1 - lower, 1e-12))
            for doc, name, often in waits:
                doc_log = doc_log + np.bincount(doc, weight[np.searchsorted(names[0], name)] * often, len(sizes))
        return pd.DataFrame({
            "doc_id": pd.array(ids, dtype="Int64"), "n_tokens": sizes, "n_known": known, "train_tokens": total, "base_score": doc_base,
            "score": doc_log,
        })

    told = blocks.labelled("1", answers[0])
    for k in range(2, order + 1):
        told = told.unionByName(blocks.labelled(str(k), answers[k - 1]))
    partial = materialize(blocks.meet(states, told, seen_part, blocks.CELL), "seen")
    weights = blocks.labelled("weights", blocks.sums(partial.where("part >= 0"), levels)).unionByName(blocks.labelled("names", partial.where("part = -2")))
    return blocks.meet(
        partial.where("part = -1"), weights, whole,
        "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )
