"""Plain versions of what the operators compute, and awkward inputs."""

import re
from collections import Counter, defaultdict

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 997}" for i in range(60_000))
AWKWARD = [
    (1, None, None, None, None),
    (2, "", "en", "s", 0),
    (3, "   \t \n\n ", "en", None, 8),
    (None, "a line without id " * 5 + "\nx", "en", "s", 9),
    (None, None, None, "s", None),
    (5, "same text in two rows, long enough to count as a line\nb", "en", "s", 5),
    (5, "same text in two rows, long enough to count as a line\nb", "en", "s", 5),
    (6, "other text of an id that comes twice, again a long line", "de", "t", 5),
    (6, "its second text is this one: another long line, really", "de", "t", 5),
    (7, LONG, "en", "s", len(LONG)),
    (8, "12345 67890 !!! ???", "fr", "t", 19),
    (9, "Ünïcödé ﬁ İ 日本語 😀 " * 9, "xx", "t", 9),
    (10, "<|endoftext|> and <|startoftext|> as text", "en", "t", 4),
]


def awkward(spark):
    """The rows above with more columns, whose names the operators use for themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(AWKWARD, DOCS)
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(["row", "key", "drop", "n_lines", "score", "lang_pred", "kept", "block", "part", "sid", "node", "region", "v", "d2", "mix_slot", "_size", "start", "spans", "tokens"])])


def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(text):
    return (text or "").encode().lower().split()


def shingles(text, k):
    w = words(text)
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def components(sets, up, down):
    """Least id reachable over pairs with down * intersection >= up * union."""
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = defaultdict(list)
    for i, s in sets.items():
        for j, n in Counter(j for g in s for j in holders[g]).items():
            if down * n >= up * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
        for g in s:
            holders[g].append(i)
    return {i: find(i) for i in sets}


def base_spans(text):
    """Personal data by the plain patterns."""
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group() if c.isdigit()][::-1]
        if 16 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append(("phone", *m.span()))
    return out
