"""Snippets with the words of a query marked."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .english import STOP_WORDS, stem

_TOKEN, _WORD = re.compile("[a-z0-9]+"), re.compile(r"\S+", re.ASCII)
#: Words of this length or less don't begin or end a snippet, unless they match.
SHORT = 3


def covers(found: list[tuple[int, frozenset[str]]], terms: frozenset[str]) -> list[tuple[int, int]]:
    """The least spans (first, last word) that hold all terms: of those with one end the shortest, of those with one start too."""
    last: dict[str, int] = {}
    ends: dict[int, int] = {}
    for i, here in found:
        last.update(dict.fromkeys(here, i))
        if len(last) == len(terms):
            ends.setdefault(min(last.values()), i)
    return sorted(ends.items())


def fitted(a: int, b: int, good: Callable[[int], bool], size: int, least: int, most: int) -> tuple[int, int]:
    """A cover as a snippet: cut after ``most`` words and back to a good one, but not below ``least``; or stretched to ``least`` words and on to the
    next good one, to the right and, where the text ends, to the left."""
    if b - a + 1 > most:
        b = a + most - 1
        while b - a + 1 > least and not good(b):
            b -= 1
        return a, b
    right = min(a + most, size) - 1
    b = next((j for j in range(max(b, a + least - 1), right + 1) if good(j)), right)
    if b - a + 1 < least:
        left = max(b - most + 1, 0)
        a = next((j for j in range(min(a, max(b - least + 1, 0)), left - 1, -1) if good(j)), left)
    return a, b


def snippet(text: str, terms: frozenset[str], least: int = 20, most: int = 40, form: Callable[[str], str] = str) -> str:
    """From ``least`` to ``most`` words around a cover of all terms, matches marked: the cover with most matches, the first of several.

    ``form`` turns a token into what terms are. Without a cover it is the text's first ``least`` words.
    """
    words = _WORD.findall(text)
    found = [(i, here) for i, w in enumerate(words) if (here := terms.intersection(map(form, _TOKEN.findall(w.lower()))))]
    hits = {i for i, _ in found}
    a, b, best = 0, least - 1, 0
    for start, end in covers(found, terms) if terms else ():
        s, e = fitted(start, end, lambda j: j in hits or len(words[j]) > SHORT, len(words), least, most)
        n = sum(j in hits for j in range(s, e + 1))
        if n > best:
            a, b, best = s, e, n
    return " ".join(f"<mark>{w}</mark>" if i in hits else w for i, w in enumerate(words[a : b + 1], a))


def headline(text: Column, terms: list[str], least: int = 20, most: int = 40, *, stemmed: bool = False) -> Column:
    """A snippet of each text for lower-cased query words, or lexemes if ``stemmed``; null for a null text."""
    wanted = frozenset(terms)

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        form = cache(lambda w: "" if w in STOP_WORDS else stem(w)) if stemmed else str  # each word once a batch
        return s.map(lambda t: None if t is None else snippet(t, wanted, least, most, form))

    return run(text)
