"""Mixing sources to target weights by Pfair scheduling."""

from __future__ import annotations

import bisect
import heapq
import math
from collections import Counter
from collections.abc import Callable, Iterator
from fractions import Fraction
from functools import partial
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize

#: Bytes of a block, and the number of shares that sources' weights are rounded to: at least this many, and 16 a source.
BLOCK, SHARES = 1 << 16, 1 << 14


class Segment(NamedTuple):
    """Slots from ``slot`` on: the sources of ``pattern``, ``repeats`` times over."""

    slot: int
    pattern: list[str]
    repeats: int


def shares(weights: dict[str, float]) -> dict[str, int]:
    """Weights as whole shares, one at least."""
    total, parts = sum(weights.values()), max(SHARES, 16 * len(weights))
    return {s: max(1, round(w / total * parts)) for s, w in weights.items()}


class Fluid:
    """The ideal mixture, in which every source flows by its share until its blocks are used up.

    At virtual time v a source with a shares and n blocks has had min(n, a v) blocks, and the slots so far are the sum over
    sources: a line between the times at which sources end.
    """

    def __init__(self, blocks: dict[str, int], share: dict[str, int]):
        self.share = share
        order = sorted((Fraction(n, share[s]), s) for s, n in blocks.items())
        self.ends = [v for v, _ in order]
        self.rate, self.gone = [sum(share[s] for s in blocks)], [0]
        for _, s in order:
            self.rate.append(self.rate[-1] - share[s])
            self.gone.append(self.gone[-1] + blocks[s])

    def phase(self, i: int, s: str, guess: int) -> int:
        """How many sources have ended before the flow reaches block ``i`` of ``s``."""
        a = self.share[s]
        above = guess == 0 or i * self.ends[guess - 1].denominator > self.ends[guess - 1].numerator * a
        if above and i * self.ends[guess].denominator <= self.ends[guess].numerator * a:
            return guess
        return bisect.bisect_left(self.ends, Fraction(i, a))

    def end(self, p: int) -> int:
        """The first slot at or after the end of a phase."""
        return self.gone[p] + math.ceil(self.rate[p] * self.ends[p])

    def floor(self, i: int, s: str, p: int) -> int:
        return self.gone[p] + self.rate[p] * i // self.share[s]

    def ceil(self, i: int, s: str, p: int) -> int:
        return self.gone[p] - (-self.rate[p] * i // self.share[s])


def schedule(blocks: dict[str, int], share: dict[str, int]) -> list[Segment]:
    """The source of every slot; a source's blocks come in their order.

    A block is released at the slot at which its source's flow reaches its beginning and has to end by that at which the
    flow reaches its end. In each slot the released block with the earliest deadline runs, the larger share and then
    the name first. The flow itself fits these windows, so every deadline is met: at any time a source has had less than
    one block more or less than its flow, also over the ends of others, as windows follow the flow through them.

    Between two ends, windows recur with as many slots as there are shares. When the schedule has come to the same state
    after such a period, the periods that follow are the same and are not run through.
    """
    blocks = {s: n for s, n in blocks.items() if n > 0}
    share = {s: share[s] for s in blocks}
    fluid, done, out, segments, now, begun = Fluid(blocks, share), dict.fromkeys(blocks, 0), [], [], 0, 0
    waiting: list[tuple[int, str]] = []
    ready: list[tuple[int, int, str]] = []

    total, phase, mark = sum(blocks.values()), 0, 0

    def enter(s: str) -> None:
        i = done[s]
        if i < blocks[s]:
            heapq.heappush(waiting, (fluid.floor(i, s, fluid.phase(i, s, phase)), s))

    for s in blocks:
        enter(s)
    end = fluid.end(0) if blocks else 0
    while now < total:
        while waiting and waiting[0][0] <= now:
            _, s = heapq.heappop(waiting)
            i = done[s] + 1
            heapq.heappush(ready, (fluid.ceil(i, s, fluid.phase(i, s, phase)), -share[s], s))
        s = heapq.heappop(ready)[2]
        out.append(s)
        done[s] += 1
        now += 1
        enter(s)
        if now >= end and now < total:
            while now >= end:
                phase += 1
                end = fluid.end(phase)
            mark = now
        elif now - mark == (period := fluid.rate[phase]):
            repeats, mark = (end - now) // period - 2, now
            if repeats > 0:
                pattern = out[-period:]
                if all(n == share[x] for x, n in Counter(pattern).items()):
                    segments += [Segment(begun, out, 1), Segment(now, pattern, repeats)]
                    now += repeats * period
                    begun, mark, out, waiting, ready = now, now, [], [], []
                    for x in set(pattern):
                        done[x] += repeats * share[x]
                    for x in done:
                        enter(x)
    return [*segments, Segment(begun, out, 1)] if out else segments


def places(segments: list[Segment]) -> dict[str, Callable[[np.ndarray], np.ndarray]]:
    """For each source the slots of its blocks; what recurs is counted out, so the size is that of the schedule."""
    done: Counter = Counter()
    rows: dict[str, list[tuple]] = {}
    for at, pattern, repeats in segments:
        where: dict[str, list[int]] = {}
        for j, s in enumerate(pattern):
            where.setdefault(s, []).append(j)
        for s, p in where.items():
            rows.setdefault(s, []).append((done[s], at, len(pattern), np.array(p)))
            done[s] += len(p) * repeats
    return {s: partial(_slots, np.array([r[0] for r in own]), own) for s, own in rows.items()}


def _slots(first: np.ndarray, own: list[tuple], blocks: np.ndarray) -> np.ndarray:
    out = np.zeros(len(blocks), np.int64)
    of = np.searchsorted(first, blocks, "right") - 1
    for k in np.unique(of):
        begin, at, length, p = own[k]
        again, j = np.divmod(blocks[of == k] - begin, len(p))
        out[of == k] = at + again * length + p[j]
    return out


def mix(
    docs: DataFrame, weights: dict[str, float] | None = None, *, id_col: str = "doc_id", source_col: str = "source",
    size_col: str | None = None, text_col: str = "text", temperature: float = 2.0, block: int = BLOCK,
) -> DataFrame:
    """Deal all documents into one sequence in which sources follow their target weights.

    Documents of a source stand in the order of a hash of their id and are cut into blocks of ``block`` bytes (a document
    belongs to the block in which it starts). ``schedule`` gives each block its slot. Without ``weights``, a source
    weighs its bytes to the power 1 / ``temperature``; one that ``weights`` leaves out weighs as much as the least.
    Weights are rounded to whole ``shares``. Nothing is dropped or repeated: when a source ends, the others go on by their
    shares.

    Running sums come from range partitions over (source, hash), so a source with most rows is spread over many tasks. Texts are
    shuffled once, for these. A number for each source and partition that meet (partitions and sources together, at most) and the periods of the schedule
    are on the driver and go to the tasks, which count out the slots of their rows.

    Returns the input's columns and mix_slot, mix_block, mix_start (long; replacing such columns): by (mix_slot,
    mix_start) is the mixed order, mix_start being bytes from the start of the block. ``size_col`` gives bytes if the text is
    not at hand. Null sizes count 0, a null source is a source, rows with null or equal ids stay each; long texts may be
    longer than their block; an empty table gives no rows.
    """
    size = F.col(size_col).cast("long") if size_col else F.octet_length(F.col(text_col)).cast("long")
    own = ["_source", "_order", "_size", "mix_slot", "mix_block", "mix_start"]
    columns = [c for c in docs.columns if c not in own]
    source = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("null"))
    keyed = docs.select(
        *[F.col(f"`{c}`") for c in columns], source.alias("_source"), F.xxhash64(F.col(id_col)).alias("_order"),
        F.greatest(F.coalesce(size, F.lit(0)), F.lit(0)).alias("_size"),
    )

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        so_far: dict[str, int] = {}
        for batch in batches:
            before = []
            for s, n in zip(batch.column("_source").to_pylist(), batch.column("_size").to_pylist()):
                at = so_far.get(s, 0)
                before.append(at)
                so_far[s] = at + n
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before, pa.int64())], names=[*batch.schema.names, "_before"])

    tie = F.col(f"`{id_col}`")
    ranged = keyed.repartitionByRange("_source", "_order", tie).sortWithinPartitions("_source", "_order", tie)
    schema = T.StructType([*ranged.schema.fields, T.StructField("_before", T.LongType())])
    dealt = materialize(ranged.mapInArrow(running, schema).withColumn("_part", F.spark_partition_id()), "ranged")

    sums = dealt.groupBy("_source", "_part").agg(F.sum("_size").alias("n"))
    earlier = Window.partitionBy("_source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets, totals = {}, Counter()
    for r in sums.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).collect():
        offsets[r["_source"], r["_part"]] = r["before"]
        totals[r["_source"]] += r["n"]
    if weights is None:
        target = {s: max(n, 1) ** (1 / temperature) for s, n in totals.items()}
    else:
        least = min((w for w in weights.values() if w > 0), default=1.0)
        target = {s: max(weights.get(s[1:], least) if s != "null" else least, least * 1e-6) for s in totals}
    number = {s: max(1, -(-n // block)) for s, n in totals.items()}
    plan = places(schedule(number, shares(target) if target else {}))

    @F.pandas_udf("mix_slot long, mix_block long, mix_start long")
    def placed(sources: pd.Series, parts: pd.Series, before: pd.Series) -> pd.DataFrame:
        offset = np.array([offsets[key] for key in zip(sources, parts)], np.int64)
        at = offset + before.to_numpy()
        last = np.array([number[s] - 1 for s in sources], np.int64)
        own = np.minimum(at // block, last)  # an empty document may start where its source ends
        slot = np.zeros(len(at), np.int64)
        for s, rows in sources.groupby(sources).indices.items():
            slot[rows] = plan[s](own[rows])
        return pd.DataFrame({"mix_slot": slot, "mix_block": own, "mix_start": at - own * block})

    found = dealt.withColumn("_placed", placed("_source", "_part", "_before"))
    return found.select(*[F.col(f"`{c}`") for c in columns], "_placed.mix_slot", "_placed.mix_block", "_placed.mix_start")
