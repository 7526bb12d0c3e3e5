"""Near-duplicate documents: an exact Jaccard join of word n-gram sets in the Jaccard metric."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blocks
from .common import discard, drop_part, materialize

#: Sizes of sets fall into classes whose bounds grow by this factor.
CLASS_GROWTH = 1.6
#: Regions of up to this many points are joined within a task, larger ones are split by pivots. Shared members are
#: counted in so many columns at a time.
SMALL, COLUMNS = 1024, 16_384
#: Regions are looked up in so many passes over their keys, each with as much less on disk.
PASSES = 2
MEMO_WORDS, HELD_SHINGLES = 250_000, 2_000_000
_words: dict[bytes, int] = {}


def shingles(text: str | None, k: int) -> np.ndarray:
    """The distinct word k-grams of a text as sorted 64-bit hashes; one of the whole sequence where it is shorter."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(_words) > MEMO_WORDS:
        _words.clear()
    for w in set(words).difference(_words):
        _words[w] = xxhash.xxh64_intdigest(w)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    size = min(k, len(h))
    s = np.full(len(h) - size + 1, np.uint64(size), dtype=np.uint64)
    for j in range(size):
        s = blocks.mixed(s, h[j : len(h) - size + 1 + j])
    return np.unique(s)


class Regions:
    """Where two different sets within the distance ``1 - threshold`` must meet.

    Jaccard similarity T bounds the symmetric difference of sets of x and y members by D = (1 - T) / (1 + T) (x + y).
    A class of sizes cuts the hash space into m > D cells; two such sets then have the same members in m - D of them.
    A set stands in a region for every cell with members, and for the empty ones too in the rare case that as many
    cells are empty as could be the same. A set near the upper bound of its class also stands in the regions of the
    next class, if a set that large could be within the distance: sizes are distances to the empty and the full set, so
    these windows follow from the triangle inequality.
    """

    def __init__(self, threshold: Fraction):
        self.threshold = threshold
        self.up, self.down = threshold.numerator, threshold.denominator
        self.bounds = [1]

    def _bound(self, c: int) -> int:
        while len(self.bounds) <= c:
            self.bounds.append(max(self.bounds[-1] + 1, math.ceil(self.bounds[-1] * CLASS_GROWTH)))
        return self.bounds[c]

    def differing(self, total: int) -> int:
        """The largest symmetric difference of two sets within the distance, from the sum of their sizes."""
        return (self.down - self.up) * total // (self.down + self.up)

    def near(self, difference: int, total: int) -> bool:
        return (self.down + self.up) * difference <= (self.down - self.up) * total

    def largest(self, n: int) -> int:
        """The largest set that can be within the distance of one of n members."""
        return n * self.down // self.up

    def cells(self, c: int) -> tuple[int, int]:
        """The number of cells of a class, and the number in which sets of it may differ."""
        d = self.differing(2 * (self._bound(c + 1) - 1))
        return d + 1 + max(6, d // 6), d

    def alone(self, n: int) -> bool:
        """No different set can be as near: even one member more or less is too many."""
        return Fraction(n, n + 1) < self.threshold

    def keys(self, s: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
        """For each of the one or two classes in which a set stands: the class, the least number of regions of it that a
        set within the distance shares there, and the regions' keys."""
        n = len(s)
        if n == 0 or self.alone(n):
            return []
        c = 0
        while self._bound(c + 1) <= n:
            c += 1
        out = []
        for at in (c, c + 1):
            if at > c and self.largest(n) < self._bound(at):
                break
            m, d = self.cells(at)
            cell = (s >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)
            found, first = np.unique(cell, return_index=True)
            content = np.add.reduceat(blocks.mixed(s, np.full(n, np.uint64(at))), first)
            keys = blocks.mixed(content, found + np.uint64(at << 40))
            if len(found) <= d:
                empty = np.setdiff1d(np.arange(m, dtype=np.uint64), found)
                keys = np.concatenate((keys, blocks.mixed(np.full(len(empty), np.uint64(0xE0E0)), empty + np.uint64(at << 40))))
            most = self.differing(n + min(self.largest(n), self._bound(at + 1) - 1))
            out.append((at, max(1, len(found) - most), keys))
        return out

    def prefix(self, n: int, center: int, delta: int, ball: bool) -> int:
        """How many members of its difference from a pivot a set has to show so that it meets every partner.

        ``n``, ``center`` and ``delta`` are the sizes of the set, the pivot and their difference; of two partners, one at
        least is outside the pivot's ball. Differences X and Y of partners share at least (|X| + |Y| - D) / 2 members,
        where |Y| >= |X| - D by the triangle inequality, and |Y| > (1 - T) / (1 + T) (y + center) outside the ball.
        """
        u, w = self.down - self.up, self.down + self.up
        if ball:
            shared = (w * delta + u * (center - n)) // (2 * w) + 1
        else:
            most = self.differing(n + self.largest(n))
            shared = max(delta - most, -(-(delta + 1 - most) // 2))
        return max(0, delta - max(1, shared) + 1)


def components(edges: DataFrame) -> DataFrame:
    """(v, comp): the least vertex reachable over edges (a, b), for every vertex in an edge.

    Each round takes the least label around every vertex and then the label of that label, until none changes.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct()
    both = materialize(both, "edges")
    labels = materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("comp")).select(F.col("a").alias("v"), "comp"), "labels")
    before = labels
    while True:
        near = both.join(labels, both.b == labels.v).groupBy("a").agg(F.min("comp").alias("near"))
        step = labels.join(near, labels.v == near.a).select("v", "comp", F.least("comp", "near").alias("new"))
        jump = labels.select(F.col("v").alias("new"), F.col("comp").alias("next"))
        new = materialize(step.join(jump, "new").select("v", F.col("comp").alias("old"), F.least("new", "next").alias("comp")), "labels")
        changed = new.where("old != comp").limit(1).count()
        labels = new.select("v", "comp")
        discard(before)
        before = new
        if not changed:
            discard(both)
            return labels


class Kept(dict):
    """Shingle sets of pivots by id; it is emptied when it holds too many members."""

    held = 0

    def of(self, key: int, text: pa.Scalar, k: int) -> np.ndarray:
        if key not in self:
            if self.held > HELD_SHINGLES:
                self.clear()
                self.held = 0
            self[key] = shingles(text.as_py(), k)
            self.held += len(self[key])
        return self[key]


def numbers(cell: pa.Scalar) -> np.ndarray:
    return np.frombuffer(cell.as_py(), np.uint64)


def arrow(columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def binary(arrays: Sequence[np.ndarray]) -> pa.Array:
    return pa.array([a.tobytes() for a in arrays], pa.binary())


def lists(arrays: Sequence[np.ndarray]) -> pa.Array:
    """A column of lists of 64-bit numbers."""
    ends = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    flat = np.concatenate([*arrays, np.zeros(0, np.uint64)]).astype(np.uint64).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def within(group: list[list], regions: Regions) -> list[tuple[int, int]]:
    """Links that join the points of a region, of rows (x, n, ball, plus, minus): no more than it takes to connect them.

    Points of the ball are linked already. Shared members are counted for all pairs at once, some columns at a time.
    """
    x, n, ball = ([r[i].as_py() for r in group] for i in range(3))
    if len(group) < 2 or all(ball):
        return []
    members = [np.concatenate((numbers(r[3]), numbers(r[4]))) for r in group]
    size = np.array([len(v) for v in members])
    owner = np.repeat(np.arange(len(group)), size)
    found, column, often = np.unique(np.concatenate(members), return_inverse=True, return_counts=True)
    some = often[column] > 1  # what only one point has isn't shared
    owner, column = owner[some], np.cumsum(often > 1)[column[some]] - 1
    order = np.argsort(column, kind="stable")
    owner, column, found = owner[order], column[order], found[often > 1]
    shared = np.zeros((len(group), len(group)), np.float32)
    for at in range(0, len(found), COLUMNS):
        a, b = np.searchsorted(column, (at, at + COLUMNS))
        held = np.zeros((len(group), min(COLUMNS, len(found) - at)), np.float32)
        held[owner[a:b], column[a:b] - at] = 1
        shared += held @ held.T
    differ = size[:, None] + size[None, :] - 2 * shared.astype(np.int64)
    total = np.array(n)[:, None] + np.array(n)[None, :]
    near = (regions.down + regions.up) * differ <= (regions.down - regions.up) * total
    root = list(range(len(group)))
    first = ball.index(True) if any(ball) else 0

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, inside in enumerate(ball):
        if inside:
            root[i] = first
    links = []
    for i, j in zip(*np.nonzero(np.triu(near, 1))):
        a, b = top(i), top(j)
        if a != b:
            root[max(a, b)] = min(a, b)
            links.append((x[i], x[j]))
    return links


SETS = "kind int, row long, stand int, n long, s1 long, s2 long, need int, keys array<long>"
BALLS = "region string, pivot long, pivot_n long, x long, n long, delta long, ball boolean, plus binary, minus binary"


def _sets(rows: DataFrame, k: int, regions: Regions) -> DataFrame:
    """Rows (id, text, rest) with their number, the size and 128-bit hash of their set (kind 0), and a row for each class
    in which the set stands, with its regions (kind 1)."""
    kinds = rows.schema.fields
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        first, made = TaskContext.get().partitionId() << 33, 0
        known: set[bytes] = set()
        for batch in batches:
            texts, n = batch.column(1), batch.num_rows
            size, found, stands = np.zeros(n, np.int64), [], []
            for i in range(n):
                s = shingles(texts[i].as_py(), k)
                size[i] = len(s)
                sid = xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None
                found.append(sid)
                if sid is not None and sid not in known:
                    if len(known) > MEMO_WORDS:
                        known.clear()
                    known.add(sid)
                    stands += [(i, c, *x[1:]) for c, x in enumerate(regions.keys(s))]
            ids = np.arange(first + made, first + made + n)
            made += n
            half = lambda at: pa.array(
                [None if x is None else int.from_bytes(x[at : at + 8], "little", signed=True) for x in found], pa.int64(),
            )
            own = {
                "row": pa.array(ids), "stand": pa.nulls(n, pa.int32()), "n": pa.array(size), "s1": half(0), "s2": half(8),
                "need": pa.nulls(n, pa.int32()),
            }
            yield arrow({"kind": pa.array(np.zeros(n, np.int32))} | own | {"keys": pa.nulls(n, pa.list_(pa.int64()))} | dict(zip(batch.schema.names, batch.columns)))
            if stands:
                at, stand, needs, keys = zip(*stands)
                m = len(at)
                own = {"row": pa.array(ids[list(at)]), "stand": pa.array(stand, pa.int32())} | {c: pa.nulls(m, pa.int64()) for c in ("n", "s1", "s2")}
                own |= {"need": pa.array(needs, pa.int32()), "keys": lists(keys)}
                yield arrow({"kind": pa.array(np.ones(m, np.int32))} | own | {f.name: pa.nulls(m, f.type) for f in batch.schema})

    return rows.mapInArrow(gather, f"{SETS}, {schema}")


def _assigned(stands: DataFrame, rows: DataFrame) -> DataFrame:
    """(x, pivot): the pivots in whose Voronoi regions each point takes part.

    ``rows`` gives the point of each row. A point that stands in fewer occupied regions than a partner must share has no
    partner and goes. The pivot of a region is its most central point, that whose regions hold most points. A point
    belongs to the pivot that it shares most regions with and, as partners may have another, to every pivot but those that
    have fewer than half of what partners must share: whatever two partners leave out, a region of both stays.
    """
    members, gone = None, []
    for part in range(PASSES):
        of_part = F.filter("keys", lambda key: F.pmod(key, F.lit(PASSES)) == part) if PASSES > 1 else F.col("keys")
        keyed = stands.select((F.col("row") * 2 + F.col("stand")).alias("at"), F.explode(of_part).alias("key"))
        often = materialize(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "often")
        held = materialize(keyed.join(often.hint("shuffle_hash"), "key"), "members")
        discard(often)
        gone.append(held)
        members = held if members is None else members.unionByName(held)
    row_of = members.select("key", F.expr("at div 2").alias("row"), F.expr("cast(at % 2 as int)").alias("stand"))
    found = row_of.join(rows.select("row", "point"), "row").select("key", "point", "stand").distinct()
    found = materialize(found, "standing")
    discard(*gone)
    occupied = found.groupBy("key").agg(F.count("*").alias("points")).where("points > 1")
    needs = stands.select(F.col("row").alias("point"), "stand", "need")
    needs = materialize(needs.join(found.select("point", "stand").distinct(), ["point", "stand"]), "needs")
    strong = found.join(occupied, "key").groupBy("point", "stand").agg(F.count("*").alias("n"), F.sum("points").alias("central"))
    strong = strong.join(needs, ["point", "stand"]).where("n >= need").select("point", "stand", "need", "central")
    alive = materialize(found.join(strong, ["point", "stand"]), "alive")
    pivots = alive.groupBy("key").agg(
        F.max(F.struct("central", (-F.col("point")).alias("p"))).alias("best"), F.count("*").alias("points"),
    ).where("points > 1")
    votes = alive.join(pivots.select("key", (-F.col("best.p")).alias("pivot")), "key").where("point != pivot")
    votes = votes.groupBy("point", "stand", "need", "pivot").agg(F.count("*").alias("n"))
    rising = Window.partitionBy("point", "stand").orderBy("n", "pivot")
    kept = votes.withColumn("left_out", F.sum("n").over(rising)).where("left_out > (need - 1) div 2")
    done = materialize(kept.select(F.col("point").alias("x"), "pivot").distinct(), "assigned")
    discard(found, needs, alive)
    return done


def _shown(full: DataFrame) -> DataFrame:
    """(region, x, ball, e): the prefix of each difference, in an order that all points of a region share: the rarest members
    first, so that what most points differ in from their pivot, such as a word that it alone has changed, comes last. What
    one point alone has fills its prefix, but meets nothing and is left out."""
    each = full.select("region", "x", "ball", "length", F.explode("members").alias("e"))
    often = each.groupBy("region", "e").agg(F.count("*").alias("often"))
    rising = Window.partitionBy("region", "x").orderBy("often", "e")
    ranked = each.join(often, ["region", "e"]).withColumn("rank", F.row_number().over(rising))
    return ranked.where("rank <= length and often > 1").select("region", "x", "ball", "e")


def near_duplicates(
    docs: DataFrame, *, k: int = 5, threshold: Fraction | float = Fraction(4, 5), id_col: str = "doc_id", text_col: str = "text",
    carry: Sequence[str] = (),
) -> DataFrame:
    """Components of documents linked by Jaccard similarity of their distinct word ``k``-grams, exactly.

    Equal sets (by a 128-bit hash) are one point of the metric space. ``Regions`` tells points that can't have a partner,
    and where partners meet; their most central points are pivots, and points go to the Voronoi regions of their
    pivots, on a border to several. A point is measured against its pivot once: those within the distance are its ball and
    link to it. Every other pair of a region is judged by the differences of its points from the pivot, which have no part
    in what the region has in common: |x - y| is the symmetric difference of the two differences. By the triangle
    inequality partners share part of their differences, so that each shows only a prefix of its own, rare
    members first, and points that show one member alike are a region of the next level. Small regions are joined in one task, a pivot's as a whole; in
    large ones a pivot is chosen again, and so on; a region has fewer points than the one before. Regions with no point
    outside the ball need no join.

    Returns doc_id, n_shingles (long), component_id (the smallest doc_id reachable, itself included) and the columns of
    ``carry`` other than these, and, if any are named, first (boolean: one row of each component, that with the smallest doc_id, those
    without id last); a row for each input row. Ids may be of any type with an order; clashing names of other columns
    don't matter. A null or empty text, or one without words, has no shingles, is linked with nothing, and is first. Rows
    with one id count as one document, which links by any of its texts; rows without id take part, and have a null
    component_id if no row in reach has an id. Long texts are taken whole. An empty table gives no rows. Links are at
    similarity >= ``threshold``; texts are held alike where all their shingles have equal 64-bit hashes.
    """
    bound = threshold if isinstance(threshold, Fraction) else Fraction(str(threshold))
    regions = Regions(bound)
    carry = [c for c in carry if c not in ("doc_id", "n_shingles", "component_id", "first")]
    others = [c for c in carry if c != text_col]
    rest = [F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)]).alias("rest")] if others else []
    sets = materialize(_sets(
        docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *rest), k, regions,
    ), "sets", by="kind")
    each = sets.where("kind = 0")
    worded = each.where("n > 0").select("row", "id", "n", "s1", "s2")
    points = worded.groupBy("s1", "s2").agg(F.min("row").alias("point"))
    rows = materialize(worded.join(points, ["s1", "s2"]), "points")
    assigned = _assigned(sets.where("kind = 1").select("row", "stand", "need", "keys"), rows)
    drop_part(docs.sparkSession, "sets", "kind=1")  # most of what is written, and not read again

    def against(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What points have more and less than their pivots."""
        kept = Kept()
        for batch in batches:
            xs, pivots, text_x, text_p = batch.columns
            out = []
            for i, pivot in enumerate(pivots.to_pylist()):
                p, s = kept.of(pivot, text_p[i], k), shingles(text_x[i].as_py(), k)
                plus, minus = np.setdiff1d(s, p, assume_unique=True), np.setdiff1d(p, s, assume_unique=True)
                out.append((str(pivot), pivot, len(p), len(s), len(plus) + len(minus), regions.near(len(plus) + len(minus), len(s) + len(p)), plus, minus))
            region, pivot, pivot_n, n, delta, ball, plus, minus = zip(*out) if out else [()] * 8
            ints = lambda v: pa.array(v, pa.int64())
            points = {"pivot": ints(pivot), "pivot_n": ints(pivot_n), "x": xs, "n": ints(n), "delta": ints(delta)}
            sides = {"ball": pa.array(ball, pa.bool_()), "plus": binary(plus), "minus": binary(minus)}
            yield arrow({"region": pa.array(region, pa.string())} | points | sides)

    def differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The members of each difference, and how many of them, the rarest of the region first, it has to show."""
        for batch in batches:
            region, x, *same, ball, center, plus, minus = batch.columns
            sizes = zip(*(c.to_pylist() for c in (same[0], center, same[1], ball)))
            length = pa.array([regions.prefix(*size) for size in sizes], pa.int64())
            members = [np.concatenate((numbers(more), numbers(less))) for more, less in zip(plus, minus)]
            yield arrow({"region": region, "x": x, "ball": ball, "length": length, "members": lists(members)})

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Differences from a new pivot, from both points' differences from the old one."""
        for batch in batches:
            region, pivot, pivot_n, x, n, plus_p, minus_p, plus_x, minus_x = batch.columns
            totals, out = np.array(pivot_n) + np.array(n), []
            for i, total in enumerate(totals.tolist()):
                pp, mp, px, mx = (numbers(v[i]) for v in (plus_p, minus_p, plus_x, minus_x))
                less = lambda a, b: np.setdiff1d(a, b, assume_unique=True)
                plus, minus = np.sort(np.concatenate((less(px, pp), less(mp, mx)))), np.sort(np.concatenate((less(pp, px), less(mx, mp))))
                out.append((len(plus) + len(minus), regions.near(len(plus) + len(minus), total), plus, minus))
            delta, ball, plus, minus = zip(*out) if out else [()] * 4
            points = {"region": region, "pivot": pivot, "pivot_n": pivot_n, "x": x, "n": n, "delta": pa.array(delta, pa.int64())}
            yield arrow(points | {"ball": pa.array(ball, pa.bool_()), "plus": binary(plus), "minus": binary(minus)})

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links between the points of each small region. Rows (region, share, x, members, ...) of one share follow each
        other; each of a share's members is a region of the points that show it."""
        group: list[list] = []
        key, links = None, []

        def end():
            cells: dict[int, list] = {}
            for members, *row in group:
                for e in members.as_py():
                    cells.setdefault(e, []).append(row)
            for cell in cells.values():
                links.extend(within(cell, regions))
            group.clear()

        def out():
            left, right = zip(*links) if links else ((), ())
            links.clear()
            return arrow({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})

        for batch in batches:
            region, share, *rest = batch.columns
            for i, at in enumerate(zip(region.to_pylist(), share.to_pylist())):
                if at != key:
                    end()
                    key = at
                group.append([c[i] for c in rest])
            yield out()
        end()
        yield out()

    picked = assigned.select(F.col("x").alias("row")).unionByName(assigned.select(F.col("pivot").alias("row"))).distinct()
    texts = materialize(each.select("row", "text").join(picked, "row"), "texts")
    pairs = assigned.join(texts.select(F.col("row").alias("x"), F.col("text").alias("text_x")), "x")
    pairs = pairs.join(texts.select(F.col("row").alias("pivot"), F.col("text").alias("text_p")), "pivot")
    balls = materialize(pairs.select("x", "pivot", "text_x", "text_p").mapInArrow(against, BALLS), "balls")
    discard(texts)
    near = lambda balls: materialize(balls.where("ball").select(F.col("x").alias("a"), F.col("pivot").alias("b")), "links")
    edges = near(balls)

    sides = ["n", "ball", "plus", "minus"]
    while True:
        open_ = balls.groupBy("region").agg(
            F.count("*").alias("m"), F.count_if(~F.col("ball")).alias("out"),
        ).where("m > 1 and out > 0").select("region", "m")
        held = materialize(balls.join(open_, "region"), "open")
        whole = held.where(F.col("m") <= SMALL).select(
            "region", F.lit(0).cast("long").alias("share"), F.array(F.lit(0).cast("long")).alias("members"), "x", *sides,
        )
        wide = held.where(F.col("m") > SMALL)
        full = wide.select("region", "x", "n", "delta", "ball", "pivot_n", "plus", "minus")
        full = materialize(full.mapInArrow(differences, "region string, x long, ball boolean, length long, members array<long>"), "differences")
        cast = materialize(_shown(full), "shown")
        outside = F.count_if(~F.col("ball")).alias("out")
        cells = cast.groupBy("region", "e").agg(F.count("*").alias("m"), outside).where("m > 1 and out > 0")
        cells = materialize(cells, "cells")
        # members of a wide region are dealt over shares, so that a point's difference is sent once for each share
        some = cast.join(cells.where(F.col("m") <= SMALL), ["region", "e"]).select("region", "e", "x").join(open_, "region")
        share = F.pmod(F.xxhash64("e"), F.ceil(F.col("m") / F.lit(SMALL)))
        some = some.groupBy("region", share.alias("share"), "x").agg(F.collect_list("e").alias("members"))
        some = some.join(wide.select("region", "x", *sides), ["region", "x"]).select("region", "share", "members", "x", *sides)
        some = whole.unionByName(some).repartition("region", "share").sortWithinPartitions("region", "share", "x")
        edges = edges.unionByName(materialize(some.mapInArrow(joined, "a long, b long"), "links"))
        large = cells.where(F.col("m") > SMALL)
        if not large.limit(1).count():
            discard(balls, held, full, cast, cells)
            break
        # the point that shows most of them is the pivot of as many large regions as it can be
        shows = cast.join(large.select("region", "e"), ["region", "e"]).select("region", "e", "x")
        shows = shows.join(shows.groupBy("region", "x").agg(F.count("*").alias("central")), ["region", "x"])
        heads = shows.groupBy("region", "e").agg((-F.max(F.struct("central", (-F.col("x")).alias("p")))["p"]).alias("pivot"))
        dealt = shows.join(heads, ["region", "e"]).where("x != pivot").select("region", "pivot", "x").distinct()
        for end in ("x", "pivot"):
            side = balls.select("region", F.col("x").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in ("n", "plus", "minus")])
            dealt = dealt.join(side, ["region", end])
        below = [F.concat_ws("/", "region", "pivot").alias("region"), "pivot", F.col("n_pivot").alias("pivot_n"), "x", F.col("n_x").alias("n")]
        dealt = dealt.select(*below, "plus_pivot", "minus_pivot", "plus_x", "minus_x")
        below = materialize(dealt.mapInArrow(moved, BALLS), "balls")
        discard(balls, held, full, cast, cells)  # a level is done when the next one is written
        balls = below
        edges = edges.unionByName(near(balls))

    same = rows.where("id is not null").groupBy("id").agg(F.min("point").alias("a"), F.max("point").alias("b")).where("a != b").select("id", "a")
    edges = edges.unionByName(rows.join(same, "id").select("a", F.col("point").alias("b")))
    labels = components(edges).select(F.col("v").alias("point"), "comp")
    placed = materialize(rows.join(labels, "point", "left").select("row", "id", "n", "s1", "s2", F.coalesce("comp", "point").alias("comp")), "placed")
    order = F.struct(F.col("id").isNull().alias("without"), "id", "s1", "s2", "row")
    least = placed.groupBy("comp").agg(F.min("id").alias("component_id"), F.min(order).alias("least"))
    done = placed.join(least, "comp").select("row", "id", "n", "component_id", (F.col("row") == F.col("least.row")).alias("first"))
    bare = each.where("n = 0").select("row", "id", "n", F.col("id").alias("component_id"), F.lit(True).alias("first"))
    done = done.unionByName(bare)
    if not carry:
        return done.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")
    kept = {c: F.col(f"rest.c{i}") for i, c in enumerate(others)} | {text_col: F.col("text")}
    done = each.select("row", "text", *(["rest"] if others else [])).join(done, "row")
    return done.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", "first", *[kept[c].alias(c) for c in carry])
