"""Token counts from the pieces of distinct pre-tokens, without materialising ids."""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .common import materialize

#: How the word-end vocabulary splits normalised text before merges (fixed value, from the tokenizer's file).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"""
#: Characters of text in a block of documents.
BLOCK_CHARS = 32_000_000
_loaded: dict[str, tuple] = {}


def _tokenizer(path: str):
    """The library's tokenizer, a splitter at special tokens (or None), the normaliser and the pre-token pattern."""
    if path not in _loaded:
        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        t = Tokenizer.from_file(path)
        special = [x.content for x in t.get_added_tokens_decoder().values()]
        _loaded[path] = (t, special, re.compile("|".join(map(re.escape, special))) if special else None, regex.compile(SPLIT).findall)
    return _loaded[path]


def pretokens(text: str, path: str) -> tuple[list[str], int]:
    """The pre-tokens of a text and how many special tokens its strings make."""
    t, special, cut, split = _tokenizer(path)
    norm = t.normalizer.normalize_str
    if special and any(s in text for s in special):
        parts = cut.split(text)
        return [w for p in parts for w in split(norm(p))], len(parts) - 1
    return split(norm(text)), 0


def pieces(words: list[str], path: str) -> np.ndarray:
    """How many tokens each pre-token makes, by the library's merges."""
    return np.array([len(e.ids) for e in _tokenizer(path)[0].encode_batch(words, add_special_tokens=False)], dtype=np.int64)


def token_counts(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens and UTF-8 bytes of every whole text under a tokenizer that splits words before it merges.

    One pass over the texts gives per-document pre-token frequencies, held for each block of neighbouring documents as
    numbers of the block's distinct pre-tokens. These are rows (block, number, pre-token): a pre-token is encoded once for
    the corpus, its number of pieces is joined to the rows that hold it, and a block sums pieces times frequencies for each
    of its documents. Ids of texts are never made; a word in every document is a row for each block, and rows follow the
    number of blocks, whose size is fixed.

    Returns doc_id (of its type), n_bytes, n_tokens (long), a row for each input row; other columns don't matter, whatever
    their names. A null or empty text has none of both; long texts are counted whole; null and repeated ids keep their
    rows; an empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def gather(batches):
        first, made = TaskContext.get().partitionId() << 24, 0
        number: dict[str, int] = {}
        ids, sizes, extra, runs, each, often, chars = [], [], [], [], [], [], 0

        def flush():
            nonlocal made, chars
            join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
            own_ids = pa.concat_arrays(ids)
            state = blocks.dumps(np.array(sizes), np.array(extra), np.array(runs), blocks.planes(join(each)), blocks.planes(join(often)))
            block, n = first + made, len(number)
            made, chars = made + 1, 0
            yield _rows(block, pa.array([-1], pa.int32()), pa.array([None], pa.string()), pa.array([state], pa.binary()), [own_ids])
            nothing = pa.nulls(n, pa.binary()), [None] * n
            yield _rows(block, pa.array(np.arange(n, dtype=np.int32)), pa.array(list(number), pa.string()), nothing[0], nothing[1])
            number.clear()
            for x in (ids, sizes, extra, runs, each, often):
                x.clear()

        def _rows(block, at, word, payload, of):
            listed = pa.array([None if x is None else x.to_pylist() for x in of], pa.list_(id_type))
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), block)), at, word, payload, listed], names=["block", "at", "word", "payload", "ids"],
            )

        id_type = None
        for batch in batches:
            texts, id_type = batch.column(1), batch.schema.types[0]
            begun = 0
            for k in range(batch.num_rows):
                text = texts[k].as_py() or ""
                words, n = pretokens(text, tokenizer_path)
                for w in set(words).difference(number):
                    number[w] = len(number)
                which, count = np.unique(np.fromiter(map(number.__getitem__, words), np.int64, len(words)), return_counts=True)
                sizes.append(len(text) if text.isascii() else len(text.encode()))
                extra.append(n)
                runs.append(len(which))
                each.append(which)
                often.append(count)
                chars += len(text)
                if chars >= BLOCK_CHARS:
                    ids.append(batch.column(0).slice(begun, k + 1 - begun))
                    begun = k + 1
                    yield from flush()
            if begun < batch.num_rows:
                ids.append(batch.column(0).slice(begun))
        if ids:
            yield from flush()

    def encode(batches):
        for batch in batches:
            words = batch.column(0)
            yield pa.RecordBatch.from_arrays([words, pa.array(pieces(words.to_pylist(), tokenizer_path), pa.int32())], names=["word", "n"])

    def total(left: pa.Table, right: pa.Table) -> pa.Table:
        sizes, extra, runs, each, often = blocks.loads(left.column("payload")[0].as_py())
        of = np.zeros(right.num_rows, dtype=np.int64)
        of[right.column("at").to_numpy()] = right.column("n").to_numpy()
        sums = np.concatenate(([0], np.cumsum(of[blocks.unplanes(each)] * blocks.unplanes(often).astype(np.int64))))
        ends = np.concatenate(([0], np.cumsum(runs))).astype(np.int64)
        n_tokens = sums[ends[1:]] - sums[ends[:-1]] + extra
        return pa.table({"doc_id": left.column("ids")[0].values, "n_bytes": pa.array(sizes, pa.int64()), "n_tokens": pa.array(n_tokens, pa.int64())})

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    cells = materialize(rows.mapInArrow(gather, f"block long, at int, word string, payload binary, ids array<{kind}>"), "pretokens")
    held = cells.where("word is not null").select("block", "at", "word")
    counted = materialize(held.select("word").distinct().mapInArrow(encode, "word string, n int"), "pieces")
    known = materialize(held.join(counted, "word").select(F.col("block").alias("of"), "at", "n"), "known")
    states = cells.where("at < 0").select("block", "payload", "ids")
    return states.groupBy("block").cogroup(known.groupBy("of")).applyInArrow(total, f"doc_id {kind}, n_bytes long, n_tokens long")
