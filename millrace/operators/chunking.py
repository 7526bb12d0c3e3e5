"""Chunks within a token budget."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..options import ChunkOptions

SPACE = " \t\n\r\x0b\x0c"
WORD = re.compile(r"\S+", re.ASCII)
HEADING = re.compile(r"(?m)(?=^#{1,3}[ \t\n\r\x0b\x0c]+.)")
BLANK_LINE = re.compile(r"\n[ \t\n\r\x0b\x0c]*\n")
SENTENCE_END = re.compile(r"([.?!][)\]\"']*)[ \n\t]")
CHUNKS = "array<struct<content:string,token_count:int,chunk_kind:string>>"


@dataclass(frozen=True)
class Encoder:
    """Tokens of a text and back, and what stands between two runs of them that are put together again. Chunk sizes and
    overlaps count what ``encode`` gives; both functions have to be picklable."""

    encode: Callable[[str], list]
    decode: Callable[[list], str]
    glue: str = ""

    def count(self, text: str) -> int:
        return len(self.encode(text))


def _join(tokens: list) -> str:
    return " ".join(tokens)


#: Runs of anything but white space.
WORDS = Encoder(WORD.findall, _join, " ")


class _FileTokens:
    """A tokenizer's file, opened when a task first needs it."""

    def __init__(self, path: str, back: bool):
        self.path, self.back, self._run = path, back, None

    def __getstate__(self):
        return {"path": self.path, "back": self.back, "_run": None}

    def __call__(self, x):
        if self._run is None:
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(self.path)
            self._run = t.decode if self.back else lambda text: t.encode(text, add_special_tokens=False).ids
        return self._run(x)


def file_encoder(path: str) -> Encoder:
    """The encoder of a public tokenizer's JSON file, whose place is a parameter."""
    return Encoder(_FileTokens(path, False), _FileTokens(path, True))


def sections(body: Column) -> Column:
    """Parts that start at level 1 to 3 headings; what stands before the first is one of its own; blank ones go."""
    parts = F.transform(F.split(body, r"(?dm)(?=^#{1,3}\s+.)"), lambda s: F.regexp_replace(s, r"\n+\z", ""))
    return F.filter(parts, lambda s: F.trim(F.regexp_replace(s, r"\s", "")) != "")


def paragraphs(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"\n\s*\n"), lambda p: F.regexp_replace(p, r"\A\s+|\s+\z", "")), lambda p: p != "")


def runs(tokens: Sequence, size: int) -> list[list]:
    return [list(tokens[i : i + size]) for i in range(0, len(tokens), size)]


def pieces(text: str, budget: int, encoder: Encoder) -> list[str]:
    """Paragraphs; of those over the budget the sentences; of those over it runs of ``budget`` tokens."""
    out = []
    for p in filter(None, (x.strip(SPACE) for x in BLANK_LINE.split(text))):
        if encoder.count(p) <= budget:
            out.append(p)
            continue
        ends = [0, *(m.end() for m in SENTENCE_END.finditer(p)), len(p)]
        for s in filter(None, (p[a:b].strip(SPACE) for a, b in zip(ends, ends[1:]))):
            tokens = encoder.encode(s)
            out += [s] if len(tokens) <= budget else map(encoder.decode, runs(tokens, budget))
    return out


def tail(text: str, options: ChunkOptions, encoder: Encoder) -> list:
    return encoder.encode(text)[-options.overlap_tokens :] if options.overlap_tokens else []


def packed(units: list[str], options: ChunkOptions, encoder: Encoder) -> list[str]:
    """Greedy packing of text units into chunks: a unit that would not fit (two tokens of slack for the join) starts a
    new chunk, which begins with the last tokens of the one before. The budget is soft: overlap and one unit may exceed it."""
    out, current, size = [], "", 0
    for u in units:
        n = encoder.count(u)
        if current and size + n + 2 > options.max_tokens:
            out.append(current)
            last = tail(current, options, encoder)
            carried = encoder.decode(last) if last else ""
            current, size = (f"{carried}\n\n{u}", len(last) + n) if carried else (u, n)
        else:
            current, size = f"{current}\n\n{u}" if current else u, size + n
    return out + [current] if current else out


def drained(units: list[tuple[str, str]], options: ChunkOptions, encoder: Encoder) -> list[tuple[str, str]]:
    """Chunks (kind, text) of (kind, text) units: a unit goes on in the open chunk if it fits, exactly; else it opens one of
    its own kind after the last tokens of the one before, and is cut wherever the budget ends. The budget is hard."""
    out: list[tuple[str, str]] = []
    current, size, kind = "", 0, "body"

    def turn(to: str):
        nonlocal current, size, kind
        if current:
            out.append((kind, current.lstrip("\n")))
        last = tail(out[-1][1], options, encoder) if out else []
        current, size, kind = encoder.decode(last) if last else "", len(last), to

    for to, text in units:
        tokens = encoder.encode(text)
        if size + len(tokens) <= options.max_tokens:
            current, size = current + text, size + len(tokens)
            continue
        turn(to)
        while tokens:
            if size >= options.max_tokens:
                turn(to)
            room = options.max_tokens - size
            piece = encoder.decode(tokens[:room])
            current, size = current + encoder.glue + piece if current else piece, size + len(tokens[:room])
            tokens = tokens[room:]
    if current:
        out.append((kind, current.lstrip("\n")))
    return out


def _counted(chunks: list[tuple[str, str]], encoder: Encoder) -> list[dict]:
    return [{"content": text, "token_count": encoder.count(text), "chunk_kind": kind} for kind, text in chunks]


def _rows(docs: DataFrame, id_col: str, chunks: Column) -> DataFrame:
    return docs.select(id_col, F.posexplode(chunks).alias("chunk_index", "_c")).select(id_col, "chunk_index", "_c.*")


def document_chunks(
    docs: DataFrame, options: ChunkOptions = ChunkOptions(), *, encoder: Encoder = WORDS, id_col: str = "doc_id", title_col: str = "title",
    body_col: str = "body",
) -> DataFrame:
    """Chunks of documents, headings aside: title and body as one if they fit, else packed paragraphs. Blank bodies have
    none."""

    @F.pandas_udf(CHUNKS)
    def run(titles: pd.Series, bodies: pd.Series) -> pd.Series:
        out = []
        for title, body in zip(titles, bodies):
            body = (body or "").strip(SPACE)
            whole = f"# {title or ''}\n\n{body}"
            texts = [] if not body else [whole] if encoder.count(whole) <= options.max_tokens else packed(
                pieces(whole, options.max_tokens, encoder), options, encoder,
            )
            out.append(_counted([("section", t) for t in texts], encoder))
        return pd.Series(out, dtype=object)

    return _rows(docs, id_col, run(F.col(title_col), F.col(body_col)))


def page_chunks(
    docs: DataFrame, options: ChunkOptions = ChunkOptions(), *, encoder: Encoder = WORDS, id_col: str = "doc_id", body_col: str = "body",
) -> DataFrame:
    """Chunks of pages: a section each, or its packed paragraphs where it is over the budget."""

    @F.pandas_udf(CHUNKS)
    def run(bodies: pd.Series) -> pd.Series:
        out = []
        for body in bodies:
            texts: list[str] = []
            for s in (x.rstrip("\n") for x in HEADING.split(body or "") if x.strip(SPACE)):
                texts += [s] if encoder.count(s) <= options.max_tokens else packed(pieces(s, options.max_tokens, encoder), options, encoder)
            out.append(_counted([("section", t) for t in texts], encoder))
        return pd.Series(out, dtype=object)

    return _rows(docs, id_col, run(F.col(body_col)))


def issue_chunks(issues: DataFrame, options: ChunkOptions = ChunkOptions(4000, 200), *, encoder: Encoder = WORDS, id_col: str = "key") -> DataFrame:
    """Chunks of issues with title, description and comments array<struct<author, created_at, body>>: the head, then each
    comment under its own heading with author and day, as far as they are known.

    A chunk is body as long as the head or what fits beside it fills it, an overflowing description included, and
    comment where a comment opened it. The budget is hard.
    """
    from .feed import comment_text

    head = F.concat(
        F.lit("# "), F.coalesce("title", F.lit("")), F.lit(" ("), F.col(id_col), F.lit(")\n\n"),
        F.when(F.coalesce("description", F.lit("")) != "", F.concat(F.regexp_replace("description", r"\n+\z", ""), F.lit("\n"))).otherwise(""),
    )
    said = F.transform("comments", comment_text)

    @F.pandas_udf(CHUNKS)
    def run(heads: pd.Series, comments: pd.Series) -> pd.Series:
        units = ([("body", h), *(("comment", c) for c in (said if said is not None else []))] for h, said in zip(heads, comments))
        return pd.Series([_counted(drained(u, options, encoder), encoder) for u in units], dtype=object)

    return _rows(issues, id_col, run(head, said))
