"""Language identification as a mixture of languages within each document."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Trigrams are hashed to so many bits for any number of languages; with MAX_LANGUAGES the model has 64 MB, which bounds
#: what is broadcast.
BUCKET_BITS, MAX_LANGUAGES = 15, 512
CHUNK = 1 << 20
_alpha: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _alpha:
        _alpha.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _alpha[0]


def trigram_counts(text: str, bits: int) -> np.ndarray | None:
    """Hashed character trigrams of a whole text, counted; None if it has no letter.

    Letters are lower-cased, everything between them counts as one space. Long texts are taken in overlapping chunks.
    """
    total, any_letter, tail = np.zeros(1 << bits, dtype=np.int64), False, np.full(1, 32, dtype=np.uint32)
    for at in range(0, len(text) + 1, CHUNK):
        piece = text[at : at + CHUNK].lower() + (" " if at + CHUNK > len(text) else "")
        codes = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        letter = _letters()[codes]
        any_letter |= bool(letter.any())
        codes = np.concatenate((tail, np.where(letter, codes, np.uint32(32))))
        codes = codes[np.concatenate(([True], (codes[1:] != 32) | (codes[:-1] != 32)))]
        if len(codes) > 2:
            h = codes[:-2] * np.uint32(0x9E3779B1) ^ codes[1:-1] * np.uint32(0x85EBCA6B) ^ codes[2:] * np.uint32(0xC2B2AE35)
            total += np.bincount((h * np.uint32(0x27D4EB2F)) >> np.uint32(32 - bits), minlength=1 << bits)
        tail = codes[-2:]
    return total if any_letter else None


@dataclass
class LanguageModel:
    """Languages and the likelihoods of hashed trigrams: probability has the shape (2**bits, languages)."""

    languages: list[str]
    bits: int = BUCKET_BITS
    probability: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))


def learn(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Trigram likelihoods of each language, from every row that has text and a language.

    Tasks count into one dense vector for each language; what leaves a task is bounded by the model, not by its rows.
    More than MAX_LANGUAGES labels are refused with a ValueError. Rows without text or label teach nothing; repeated rows
    count each; without any row the model has no language. Long texts are counted whole, in chunks.
    """
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    languages = sorted(r.lang for r in rows.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} language labels")
    if not languages:
        return LanguageModel([])
    bits = BUCKET_BITS
    number = {name: i for i, name in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            texts = batch.column(0)
            for k, lang in enumerate(batch.column(1).to_pylist()):
                if (c := trigram_counts(texts[k].as_py(), bits)) is not None:
                    i = number[lang]
                    held[i] = held[i] + c if i in held else c
        for i, c in held.items():
            at = np.nonzero(c)[0]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), i), pa.int32()), pa.array(at, pa.int32()), pa.array(c[at], pa.int64())],
                names=["language", "bucket", "n"],
            )

    counts = rows.mapInArrow(count, "language int, bucket int, n long").groupBy("language", "bucket").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros((1 << bits, len(languages)))
    table[counts["bucket"].to_numpy(int), counts["language"].to_numpy(int)] = counts["n"].to_numpy(float)
    table = (table + 0.5) / (table.sum(axis=0) + 0.5 * (1 << bits))
    return LanguageModel(languages, bits, table.astype(np.float32))


def proportions(p: np.ndarray, w: np.ndarray, start: np.ndarray, steps: int = 30) -> tuple[np.ndarray, float]:
    """Expectation-maximisation: the mixture of p's columns under which counts w are likeliest, and the log likelihood."""
    mix, total = start, w.sum()
    for _ in range(steps):
        new = mix * (p.T @ (w / (p @ mix))) / total
        moved, mix = np.abs(new - mix).max(), new
        if moved < 2e-3:
            break
    return mix, float(w @ np.log(p @ mix))


def select(counts: np.ndarray, model: LanguageModel, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """The language set of a document and its proportions, largest first.

    Languages enter by their share of the mixture of all, as long as the penalised likelihood rises: a language more
    must gain ``penalty`` times half the log of the number of trigrams, raised threefold because trigrams overlap.
    """
    at = np.nonzero(counts)[0]
    p, w = model.probability[at], counts[at].astype(np.float32)
    single = w @ np.log(p)
    if len(single) == 1:
        return np.array([0]), np.array([1.0])
    mix, _ = proportions(p, w, np.full(len(single), 1 / len(single), np.float32), steps=12)
    order = np.argsort(-mix, kind="stable")
    order = np.concatenate(([np.argmax(single)], order[order != np.argmax(single)]))
    best, chosen, share = float(single.max()), order[:1], np.array([1.0])
    cost = penalty * 3 * 0.5 * np.log(max(w.sum(), 2.0))
    for k in range(2, len(order) + 1):
        if mix[order[k - 1]] < 0.02:
            break
        got, fit = proportions(p[:, order[:k]], w, np.full(k, 1 / k, np.float32))
        if fit - cost * (k - 1) <= best:
            break
        best, chosen, share = fit - cost * (k - 1), order[:k], got
    rank = np.argsort(-share, kind="stable")
    return chosen[rank], share[rank] / share.sum()


def identify(docs: DataFrame, model: LanguageModel, *, text_col: str = "text", penalty: float = 4.0) -> DataFrame:
    """Add lang_pred (the largest language, `und` without text or letter or model), score (its proportion, 0 for
    `und`), lang_set and lang_share (arrays, largest first) to the rows; they replace columns of these names.

    Only the text is read, whole, however long. Every row stays, whatever its id, and repeated rows get equal results;
    other columns keep their names but for those four; an empty table gives no rows. Of equally likely languages the
    first by name is the prediction.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by MAX_LANGUAGES

    @F.pandas_udf("lang_pred string, score double, lang_set array<string>, lang_share array<double>")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = held.value
        for texts in batches:
            out = []
            for text in texts:
                counts = trigram_counts(text, m.bits) if text and m.languages else None
                if counts is None:
                    out.append(("und", 0.0, [], []))
                else:
                    which, share = select(counts, m, penalty)
                    out.append((m.languages[which[0]], float(min(1.0, share[0])), [m.languages[i] for i in which], [float(x) for x in share]))
            yield pd.DataFrame(out, columns=["lang_pred", "score", "lang_set", "lang_share"])

    added = ("lang_pred", "score", "lang_set", "lang_share")
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in added]
    return docs.select(*kept, predict(F.col(text_col).cast("string")).alias("_found")).select(*kept, *[F.col(f"_found.{c}").alias(c) for c in added])
