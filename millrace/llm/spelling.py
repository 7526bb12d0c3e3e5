"""Spelling variants: words of one edit, found by neighbourhoods of words over a reduced alphabet."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Maximal runs of letters, after A-Z are lower-cased.
RUN = "[a-zÀ-ÿ]"
#: Distinct words that a task counts before it hands them on, and neighbours in one batch.
HELD, BATCH = 200_000, 100_000
#: Hashes of reduced words are sums of symbols times powers of BASE, modulo 2^64; INVERSE undoes one power.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 6, min_count: int = 5, slip: int | None = None) -> DataFrame:
    """(word, n): lower-cased runs of letters of whole texts with at least ``min_chars`` code points and ``min_count`` occurrences.

    ``slip`` plants misspellings: a run loses one letter where the crc32 of its document's id and itself is divisible by it;
    a null id is empty there. Null texts have no runs. Tasks count before the shuffle, with bounded memory.
    """
    runs = re.compile(f"{RUN}{{{min_chars},}}")

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()
        for f in frames:
            for i, text in zip(f["id"], f["text"]):
                found = Counter(runs.findall(text.encode().lower().decode())) if text else {}
                if slip and found:
                    start, slipped = zlib.crc32(f"{i or ''}:".encode()), {}
                    for w in found:
                        h = zlib.crc32(w.encode(), start)
                        if h % slip == 0:
                            slipped[w] = h % len(w)
                    for w, at in slipped.items():
                        n = found.pop(w)
                        if len(w) > min_chars:
                            held[w[:at] + w[at + 1 :]] += n
                held.update(found)
                if len(held) > HELD:
                    yield pd.DataFrame({"word": list(held.keys()), "n": list(held.values())})
                    held.clear()
        yield pd.DataFrame({"word": pd.Series(list(held.keys()), dtype=object), "n": pd.Series(list(held.values()), dtype="int64")})

    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def symbols_of(word: str, symbols: int) -> np.ndarray:
    """The letters of a word hashed to 1 .. symbols."""
    points = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64)
    return (points * np.uint64(2654435761) >> np.uint64(7)) % np.uint64(symbols) + np.uint64(1)


def powers(n: int) -> np.ndarray:
    out = np.full(n + 2, BASE, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def reduced_hash(c: np.ndarray) -> np.uint64:
    return (c * powers(len(c))[: len(c)]).sum(dtype=np.uint64)


def neighbourhood(c: np.ndarray, symbols: int) -> Iterator[np.ndarray]:
    """Hashes of a reduced word and of all words one edit away, each word once, in batches of bounded size.

    Words that arise in several ways are taken from the last place of a run: deletions where the next symbol differs,
    insertions where the next symbol isn't the inserted one.
    """
    n, p = len(c), powers(len(c))
    before = np.concatenate((np.zeros(1, np.uint64), np.cumsum(c * p[:n], dtype=np.uint64)))
    total = before[n]
    every = np.arange(1, symbols + 1, dtype=np.uint64)
    after = np.concatenate((c[1:], np.zeros(1, np.uint64)))
    yield total[None] if isinstance(total, np.ndarray) else np.array([total], np.uint64)
    step = max(1, BATCH // symbols)
    for a in range(0, n + 1, step):
        at = np.arange(a, min(a + step, n))
        ends = at[c[at] != after[at]]
        yield before[ends] + (total - before[ends + 1]) * np.uint64(INVERSE)
        swap = total + (every[None] - c[at, None]) * p[at, None]
        yield swap[every[None] != c[at, None]]
        gaps = np.arange(a, min(a + step, n + 1))
        inserted = before[gaps, None] + every[None] * p[gaps, None] + ((total - before[gaps]) * np.uint64(BASE))[:, None]
        follows = np.concatenate((c, np.zeros(1, np.uint64)))[gaps]
        yield inserted[every[None] != follows[:, None]]


def near_pairs(words: DataFrame, symbols: int = 6) -> DataFrame:
    """(a, b, a_n, b_n) of ids: all unordered pairs of words (id, word, n) that differ by exactly one inserted, deleted or
    replaced code point, each once.

    Letters are hashed to a few symbols, so many words share a reduced form. Each reduced form generates its whole one-edit
    neighbourhood, itself included, as hashes; those meet the reduced vocabulary, a pair of forms from its smaller side, and the words
    behind both forms are verified as they are. Hashes only propose: equal ones of different forms cost a check, no result.
    """
    @F.pandas_udf("symbols binary, hash long")
    def reduced(words: pd.Series) -> pd.DataFrame:
        forms = [symbols_of(w, symbols) for w in words]
        return pd.DataFrame({"symbols": [f.astype(np.uint8).tobytes() for f in forms], "hash": [int(reduced_hash(f).view(np.int64)) for f in forms]})

    forms = words.withColumn("r", reduced("word")).select("id", "word", "n", "r.*")
    kinds = materialize(forms.groupBy("symbols", "hash").agg(F.min("id").alias("form")), "forms")
    members = materialize(forms.join(kinds.select("symbols", "form"), "symbols").select("form", "id", "word", "n"), "members")

    def generate(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for f in frames:
            for form, s in zip(f["form"], f["symbols"]):
                for h in neighbourhood(np.frombuffer(s, np.uint8).astype(np.uint64), symbols):
                    held.append((form, h))
                    size += len(h)
                    if size >= BATCH:
                        yield _batch(held)
                        held, size = [], 0
        yield _batch(held)

    tasks = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a form becomes a hundred rows
    around = kinds.select("form", "symbols").repartition(tasks).mapInPandas(generate, "one long, hash long")
    met = around.join(kinds.select("hash", F.col("form").alias("two")), "hash").where("one <= two").select("one", "two")
    left = members.select(F.col("form").alias("one"), F.col("id").alias("a"), F.col("word").alias("a_word"), F.col("n").alias("a_n"))
    right = members.select(F.col("form").alias("two"), F.col("id").alias("b"), F.col("word").alias("b_word"), F.col("n").alias("b_n"))
    once = (F.col("one") < F.col("two")) | (F.col("a") < F.col("b"))
    near = F.expr("levenshtein(a_word, b_word, 1)") == 1
    return met.join(left, "one").join(right, "two").where(once & near).select("a", "b", "a_n", "b_n").distinct()


def _batch(held: list[tuple[int, np.ndarray]]) -> pd.DataFrame:
    one = np.repeat(np.array([f for f, _ in held], np.int64), [len(h) for _, h in held])
    hashes = np.concatenate([h for _, h in held]) if held else np.zeros(0, np.uint64)
    return pd.DataFrame({"one": one, "hash": hashes.view(np.int64)})


def variants(words: DataFrame, ratio: int = 5, symbols: int = 6) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for words with their counts, one row each, null words dropped.

    ``form`` is the near word of largest n (ties to the first in code-point order) where that n is ``ratio`` times the word's own or
    more, else null; ``root`` is where forms lead in the end, the word itself without one. As counts grow by the ratio along
    forms, there are no circles and chains are short: their doubling takes a few joins.
    """
    if ratio < 2:
        raise ValueError("ratio is 2 or more")
    order = words.where(F.col("word").isNotNull()).select("word", "n").repartitionByRange("word").sortWithinPartitions("word")
    table = materialize(order.select(F.monotonically_increasing_id().alias("id"), "word", "n"), "vocabulary")  # ids follow the words' order
    both = F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("to"), F.col("b_n").alias("n")), F.struct(F.col("b").alias("id"), F.col("a").alias("to"), F.col("a_n").alias("n"))))
    near = near_pairs(table, symbols).select(both.alias("x")).select("x.*").groupBy("id").agg(
        F.count("*").alias("n_near"), F.max(F.struct("n", (-F.col("to")).alias("to"))).alias("best"),
    )
    joined = table.join(near, "id", "left").withColumn("formed", F.col("best.n") >= ratio * F.col("n"))
    found = materialize(joined.select("id", "word", "n", "n_near", F.when(F.col("formed"), -F.col("best.to")).alias("form_id")), "near")
    most = found.agg(F.max("n")).first()[0] or 1
    steps = math.ceil(math.log2(1 + math.log(most) / math.log(ratio)))
    roots = found.where("form_id is not null").select("id", F.col("form_id").alias("root_id"))
    for _ in range(steps):
        roots = materialize(_doubled(roots), "roots")
    names = table.select("id", "word", "n")
    form = names.select(F.col("id").alias("form_id"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    root = names.select(F.col("id").alias("root_id"), F.col("word").alias("root"))
    ended = roots.join(root, "root_id").select("id", "root")
    out = found.join(form, "form_id", "left").join(ended, "id", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")


def _doubled(roots: DataFrame) -> DataFrame:
    on = roots.select(F.col("id").alias("root_id"), F.col("root_id").alias("next"))
    return roots.join(on, "root_id", "left").select("id", F.coalesce("next", "root_id").alias("root_id"))
