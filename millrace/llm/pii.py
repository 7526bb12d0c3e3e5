"""Personal data: fixed shapes, and what bootstrapped contextual extraction adds to them."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Base shapes (fixed values). The run of digits before an address can't begin within a run, so it is looked at once.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: Looser shapes, which only a trusted context turns into a find.
LOOSE_NUMBER = re.compile(r"(?<![A-Za-z0-9+.])\(?[0-9](?:[ ().\-\[\]]{0,3}[0-9])++")
LOOSE_AT = re.compile(r"@| ?[\[({]at[\])}] ?| at | AT ")
LOOSE_HOST = re.compile(r"[A-Za-z0-9-]+(?:(?:\.| ?[\[({]dot[\])}] ?| dot | DOT )[A-Za-z0-9-]+)*+")
WORD = re.compile(r"[^\W_]+")
CONTEXT = 48


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of a local part, @ and a domain with a dot, found from each @."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        if m := DOMAIN.match(text, at + 1):
            start = at
            while start > last and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                out.append((start, m.end()))
                last = m.end()
        at = text.find("@", max(at + 1, last))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) by kind and start."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(len(p := g.lstrip("0")) < 3 or (len(p) == 3 and p <= "255") for g in m.groups())]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := digits_of(m.group())) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(digits_of(m.group())) <= 15]
    return out


def loose_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans that look like an identifier of a kind but don't meet its base shape; none overlaps a base span.

    A number is given once for each kind that its shape and count of digits allow.
    """
    out = []
    for m in LOOSE_NUMBER.finditer(text):
        if m.end() - m.start() < 7:
            continue
        s, d = m.group(), digits_of(m.group())
        allowed = (bool(re.fullmatch(r"[0-9]{1,3}(?: ?\[?\.\]? ?[0-9]{1,3}){3}", s)), 13 <= len(d) <= 19, 7 <= len(d) <= 15)
        out += [(k, m.start(), m.end()) for k, yes in enumerate(allowed, 1) if yes]
    for m in LOOSE_AT.finditer(text):
        start = m.start()
        while start > 0 and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start() and (host := LOOSE_HOST.match(text, m.end())) and ("@" in m.group() or host.end() - host.start() > len(host.group().split(" ")[0].split("[")[0].split("(")[0]) or "." in host.group()):
            out.append((0, start, host.end()))
    taken = sorted((a, b) for _, a, b in base)
    starts, ends = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))

    def free(a: int, b: int) -> bool:
        n = bisect_left(starts, b)  # base spans that begin before b; the furthest of their ends decides
        return n == 0 or ends[n - 1] <= a

    return [(k, a, b) for k, a, b in out if free(a, b)]


def contexts(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns of a span: the two words before it, and the word before with the word after it, whole words of which
    each begins or ends within CONTEXT characters of the span."""
    near = max(0, start - CONTEXT)
    while 0 < near and text[near - 1].isalnum() and text[near].isalnum():
        near -= 1
    left = [w.lower() for w in WORD.findall(text[near:start])][-2:]
    after = WORD.search(text, end)
    right = [after.group().lower()] if after and after.start() < end + CONTEXT else []
    out = []
    if len(left) == 2:
        out.append("B " + " ".join(left))
    if left and right:
        out.append(f"A {left[-1]} _ {right[0]}")
    return out


def _is(kind: int):
    return lambda s: s["kind"] == kind


def find_personal_data(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rounds: int = 3, least_instances: int = 3, confidence: float = 0.8,
) -> DataFrame:
    """Personal data in every whole text: base shapes, and identifiers of looser shapes in contexts those induce.

    Every base find is a seed instance (its kind and surface) with confidence 1. The words around finds and around
    looser look-alikes are patterns; the two make a graph of (pattern, instance) edges, grouped before anything else.
    For ``rounds`` rounds, a pattern's confidence is the mean confidence of its distinct instances, one doubtful instance
    added, and a look-alike's is the chance that not all its patterns err, of those with at least ``least_instances``
    instances that are seeds or reached ``confidence`` in the round before: what a round finds induces the patterns of
    the next. Look-alikes that end at ``confidence`` or above are added, each as its most trusted kind (the first of
    KINDS on ties); base finds always stay. A pattern's words lie within CONTEXT characters of the span.

    Returns doc_id, n_email, n_ip, n_card, n_phone (long, base finds), base and spans (arrays of kind, start, end in
    code points, by kind as in KINDS and start), a row for each input row; other columns don't matter, whatever their
    names. Null or empty text has none; very long texts are searched whole; repeated or null ids keep their rows; equal
    finds are one instance; an empty table gives no rows.
    """
    mention = pa.struct([
        ("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("seed", pa.bool_()), ("instance", pa.int64()),
        ("patterns", pa.list_(pa.string())),
    ])
    ddl = "array<struct<kind:int,start:bigint,end:bigint,seed:boolean,instance:bigint,patterns:array<string>>>"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, out = batch.column(1), []
            for k in range(len(texts)):
                text = texts[k].as_py() or ""
                base = base_spans(text)
                found = [(s, True) for s in base] + [(s, False) for s in loose_spans(text, base)]
                out.append([{"kind": s[0], "start": s[1], "end": s[2], "seed": seed, "instance": xxhash.xxh64_intdigest("".join(text[s[1] : s[2]].lower().split())) - (1 << 63), "patterns": contexts(text, s[1], s[2])} for s, seed in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(mention))], names=["doc_id", "mentions"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind_of_id = rows.schema["doc_id"].dataType.simpleString()
    rows = rows.mapInArrow(scan, f"doc_id {kind_of_id}, mentions {ddl}")
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "mentions")

    each = rows.select("row", F.explode("mentions").alias("m")).select("row", "m.*")
    edges = materialize(
        each.select(
            "kind", "instance", "seed", F.explode("patterns").alias("pattern"),
        ).groupBy("kind", "pattern", "instance").agg(F.max("seed").alias("seed")),
        "edges",
    )
    trust = edges.where("not seed").select("kind", "instance").distinct().withColumn("trust", F.lit(0.0))
    for _ in range(rounds):
        weighed = edges.join(trust, ["kind", "instance"], "left").withColumn(
            "trust", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("trust", F.lit(0.0))),
        )
        patterns = weighed.groupBy("kind", "pattern").agg(
            F.sum("trust").alias("s"), F.count("*").alias("n"), F.count_if(F.col("trust") >= confidence).alias("trusted"),
        ).where(F.col("trusted") >= least_instances)
        good = patterns.select("kind", "pattern", (F.col("s") / (F.col("n") + 1)).alias("c"))
        doubt = F.exp(F.sum(F.log(F.greatest(1 - F.col("c"), F.lit(1e-9)))))
        trust = materialize(edges.where("not seed").join(good, ["kind", "pattern"]).groupBy("kind", "instance").agg((1 - doubt).alias("trust")), "trust")
    trusted = each.where("not seed").join(trust.where(F.col("trust") >= confidence), ["kind", "instance"])
    one_kind = trusted.groupBy("row", "start", "end").agg(F.max_by("kind", F.struct("trust", -F.col("kind"))).alias("kind"))
    added = one_kind.groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("added"))

    plain = lambda m: F.struct(m["kind"].alias("kind"), m["start"].alias("start"), m["end"].alias("end"))
    base = F.transform(F.filter("mentions", lambda m: m["seed"]), plain)
    joined = rows.join(added, "row", "left").select(
        "doc_id", F.array_sort(base).alias("base"),
        F.array_sort(F.concat(base, F.coalesce("added", F.array().cast("array<struct<kind:int,start:bigint,end:bigint>>")))).alias("spans"),
    )
    named = lambda a: F.transform(
        a,
        lambda s: F.struct(F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end")),
    )
    counts = [F.size(F.filter("base", _is(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return joined.select("doc_id", *counts, named("base").alias("base"), named("spans").alias("spans"))
