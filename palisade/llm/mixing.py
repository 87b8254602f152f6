"""Mixing of sources to target weights by Pfair scheduling.

Each source's documents are dealt, in a hashed order, to blocks of BLOCK. The slots of the mix are cut
into frames of FRAME. A source with a slot or more in a frame has at the start of each frame its exact
share of the slots before, rounded so that all sources together have them all (the cumulative shares are
rounded, so nothing is lost from frame to frame). Inside a frame, where a source has q blocks, block j is
released at slot floor(j * FRAME / q) and due by ceil((j + 1) * FRAME / q); taking the released block with
the earliest deadline in every slot meets all deadlines. Both errors are below one block, so after any
number of slots each of these sources has had less than two blocks more or less than its share; less than
one in a mix of one frame, and where the shares are multiples of 1 / FRAME.

The sources of less than one slot in a frame, however many, share a pool that is scheduled as one more
source. In the pool a block stands at (j + u) / w, u in [0, 1) hashed from the source's name. So the driver
holds FRAME sources at most, and frames are scheduled by the executors, each on its own.

With natural shares all sources run dry in the last slot. With a caller's weights the mix ends where the
schedule would take a block that its source no longer has.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from fractions import Fraction
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from palisade.llm.common import identified, packed, ranked, save, scanned, tidy, unpacked

FRAME = 1 << 14
BLOCK = 8


def natural_weights(sizes: Mapping[str | None, int], most: float = 1.0) -> dict[str | None, Fraction]:
    """Shares in proportion to the sizes, so that all sources run dry together. With a lower `most`, none is
    above it (or an equal share, if that is more): what is cut off goes to the others in proportion."""
    left = {k: n for k, n in sizes.items() if n > 0}
    most = max(Fraction(most).limit_denominator(10_000), Fraction(1, max(len(left), 1)))
    out: dict[str | None, Fraction] = {}
    share = Fraction(1)
    while left:
        total = sum(left.values())
        over = [k for k, n in left.items() if share * Fraction(n, total) > most]
        if not over:
            return out | {k: share * Fraction(n, total) for k, n in left.items()}
        for k in over:
            out[k] = most
            share -= most
            del left[k]
    return out


def quotas(weights: Mapping[str | None, Fraction], frame: int = FRAME) -> dict[str | None, int]:
    """Slots of each source in a frame: largest remainders, one at least for a weight above 0."""
    weights = {k: w for k, w in weights.items() if w > 0}
    if len(weights) > frame:
        raise ValueError(f"{len(weights)} sources have weights; a frame has {frame} slots")
    total = sum(weights.values())
    exact = {k: w / total * frame for k, w in weights.items()}
    out = {k: max(1, int(x)) for k, x in exact.items()}
    name = lambda k: (k is not None, k or "")
    rest = frame - sum(out.values())
    for k in sorted(exact, key=lambda k: (int(exact[k]) - exact[k], name(k)))[: max(rest, 0)]:
        out[k] += 1
    while sum(out.values()) > frame:  # sources below one slot have taken from the largest
        out[max(out, key=lambda k: (out[k], name(k)))] -= 1
    return out


def frame_schedule(quota: Mapping[str | None, int]) -> list[tuple[str | None, int]]:
    """Source and index in the frame of the block in each slot of a frame."""
    frame = sum(quota.values())
    names = sorted(quota, key=lambda k: (k is not None, k or ""))
    release = lambda i, j: j * frame // quota[names[i]]
    deadline = lambda i, j: -(-(j + 1) * frame // quota[names[i]])
    waiting = [(0, i, 0) for i in range(len(names))]
    ready: list[tuple[int, int, int]] = []
    out: list[tuple[str | None, int]] = []
    for slot in range(frame):
        while waiting and waiting[0][0] <= slot:
            _, i, j = heapq.heappop(waiting)
            heapq.heappush(ready, (deadline(i, j), i, j))
        due, i, j = heapq.heappop(ready)
        if due <= slot:
            raise AssertionError("a deadline is missed")
        out.append((names[i], j))
        if j + 1 < quota[names[i]]:
            heapq.heappush(waiting, (release(i, j + 1), i, j + 1))
    return out


@dataclass(frozen=True)
class Shares:
    """Integer weights of sources 0, 1, ...: upto[i] is the sum of those before i."""

    upto: list[int]

    def before(self, i: int, slot: int) -> int:
        """Blocks of source i in the slots before `slot`; it does not fall from one frame to the next if
        the source has a slot in a frame or is the last."""
        total = self.upto[-1]
        return self.upto[i + 1] * slot // total - self.upto[i] * slot // total

    def frame_of(self, i: int, block: int, frame: int) -> int:
        """The frame that takes this block."""
        lo, hi = 0, (block + 1) * self.upto[-1] // ((self.upto[i + 1] - self.upto[i]) * frame) + 1
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if self.before(i, (mid + 1) * frame) > block else (mid + 1, hi)
        return lo

    def slots(self, start: int, end: int) -> list[tuple[int, int, int]]:
        """Source, its block and the slot, for the frame of the slots from start to end."""
        first = [self.before(i, start) for i in range(len(self.upto) - 1)]
        quota = {f"{i:06d}": n for i, at in enumerate(first) if (n := self.before(i, end) - at) > 0}
        return [(int(k), first[int(k)] + j, start + slot) for slot, (k, j) in enumerate(frame_schedule(quota))]


def schedule(spark: SparkSession, shares: Shares, slots: int, frame: int) -> DataFrame:
    """at (the source), turn (its block) and slot, for each of so many slots."""
    frames = -(-slots // frame)
    held = spark.sparkContext.broadcast(shares)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in b.column(0).to_pylist():
                at, turn, slot = zip(*held.value.slots(k * frame, min((k + 1) * frame, slots)), strict=True)
                yield pa.record_batch([pa.array(at, pa.int32()), pa.array(turn, pa.int64()), pa.array(slot, pa.int64())], names=["at", "turn", "slot"])

    return spark.range(0, frames, 1, max(1, min(frames, 10_000))).mapInArrow(f, "at int, turn long, slot long")


def pooled(spark: SparkSession, blocks: DataFrame, horizon: float, rows: int, in_part: int = 20_000) -> tuple[DataFrame, int]:
    """blocks (source, block, rate) of the pool that stand before horizon, with turn, their rank; and how many."""
    phase = F.shiftrightunsigned(F.xxhash64("source"), 11) / F.lit(2.0**53)
    parts = max(1, -(-rows // in_part))
    found = blocks.withColumn("stands", (F.col("block") + phase) / F.col("rate")).filter(F.col("stands") < horizon)
    found = save(spark, found.withColumn("part", F.least(F.lit(parts - 1), F.floor(F.col("stands") / horizon * parts)).cast("int")), "pool")
    before, total = [], 0
    for r in found.groupBy("part").count().orderBy("part").collect():  # a row for in_part blocks
        before.append((r["part"], total))
        total += r["count"]
    inside = W.partitionBy("part").orderBy("stands", "source", "block")
    found = found.withColumn("turn", F.row_number().over(inside).cast("long") - 1)
    found = found.join(F.broadcast(spark.createDataFrame(before, "part int, before long")), "part")
    return found.select("source", "block", (F.col("turn") + F.col("before")).alias("turn")), total


def scheduled(spark: SparkSession, rows: DataFrame, weights: Mapping[str | None, float] | None, block: int, frame: int = FRAME) -> DataFrame:
    """rows (source, order columns uid and spread) with block, slot and selected."""
    sizes = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n")).withColumn("blocks", F.ceil(F.col("n") / block).cast("long"))
    sizes = save(spark, sizes, "sources")
    n, blocks = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("blocks"), F.lit(0))).first()
    name = lambda k: (k is not None, k or "")
    if weights is None:
        large = sizes.filter(F.col("blocks") * frame >= blocks).select("source", "blocks").collect()  # FRAME rows at most
        held = wanted = dict(sorted(map(tuple, large), key=lambda r: name(r[0])))
        total, small = blocks, []
        pool_blocks = pool = blocks - sum(held.values())
        rates = sizes.filter(F.col("blocks") * frame < blocks).select("source", (F.col("blocks") / F.lit(float(blocks or 1))).alias("rate"))
        horizon = float(blocks) + 1  # beyond all
    else:
        exact = {k: Fraction(w) for k, w in weights.items() if w > 0}
        unit = math.lcm(*[w.denominator for w in exact.values()])
        asked = spark.createDataFrame([(k,) for k in exact], "source string")
        there = {r["source"]: r["blocks"] for r in sizes.join(F.broadcast(asked), sizes["source"].eqNullSafe(asked["source"]), "left_semi").collect()}
        exact = {k: int(exact[k] * unit) for k in sorted(there, key=name)}
        total = sum(exact.values())
        wanted = {k: w for k, w in exact.items() if w * frame >= total}
        held = {k: there[k] for k in wanted}
        small = [(k, w / total) for k, w in exact.items() if k not in wanted]
        pool, pool_blocks = total - sum(wanted.values()), sum(there[k] for k, _ in small)
        rates = spark.createDataFrame(small, "source string, rate double")
        horizon = min((there[k] / rate for k, rate in small), default=0.0)
    own = list(wanted.values()) + ([pool] if pool else [])
    shares = Shares([0, *accumulate(own)])

    known = spark.createDataFrame([(k, i, w / total) for i, (k, w) in enumerate(wanted.items())] + [(k, None, rate) for k, rate in small], "source string, at int, rate double")
    places = ranked(rows, ["source"], ["spread", "uid"], total=n)
    places = places.withColumn("block", F.floor(F.col("place") / block).cast("long"))
    same = places["source"].eqNullSafe(known["source"])
    places = places.join(F.broadcast(known), same, "left").select(*[places[c] for c in places.columns], F.coalesce(known["at"], F.lit(-1)).alias("at"), "rate")
    if pool:
        first = places.filter((F.col("at") == -1) & (F.col("place") % block == 0)).select("source", "block")
        first = first.join(rates, first["source"].eqNullSafe(rates["source"])).select(first["source"], first["block"], rates["rate"])
        turns, pool_blocks = pooled(spark, first, horizon, pool_blocks)
    if weights is None:
        slots = end = blocks
    elif own:
        has = [*held.values(), *([pool_blocks] if pool else [])]
        last = min(shares.frame_of(i, b, frame) for i, b in enumerate(has))
        slots = (last + 1) * frame
        end = min(slot for i, turn, slot in shares.slots(last * frame, slots) if turn == has[i])
    else:
        slots = end = 0
    timed = schedule(spark, shares, slots, frame)
    if pool:
        turns = turns.join(timed.filter(F.col("at") == len(wanted)).select("turn", "slot"), "turn").select("source", "block", F.col("slot").alias("pool_slot"))
        turns = save(spark, turns, "pool_slots")
        same = places["source"].eqNullSafe(turns["source"]) & (places["block"] == turns["block"])
        places = places.join(turns, same, "left").select(*[places[c] for c in places.columns], "pool_slot")
    else:
        places = places.withColumn("pool_slot", F.lit(None).cast("long"))
    out = places.join(timed.withColumnRenamed("turn", "block").hint("shuffle_hash"), ["at", "block"], "left")
    # past the last frame that is scheduled, the first slot that the share allows
    later = F.when(F.col("rate").isNotNull(), F.greatest(F.lit(slots), F.floor(F.col("block") / F.col("rate")))).cast("long")
    slot = F.coalesce("slot", "pool_slot", later)
    return out.withColumn("slot", slot).withColumn("selected", F.coalesce(F.col("slot") < end, F.lit(False))).drop("at", "rate", "pool_slot")


def keyed(docs: DataFrame) -> DataFrame:
    return identified(docs, [docs["doc_id"].cast("long").alias("doc_id"), docs["source"].cast("string").alias("source"), F.xxhash64(docs["doc_id"].cast("string")).alias("spread")])


@tidy
def mixture(spark: SparkSession, docs: DataFrame, weights: Mapping[str | None, float] | None = None, block: int = BLOCK, frame: int = FRAME) -> DataFrame:
    """doc_id, source, block, place (in the source), slot and selected for each row of docs (doc_id, source).

    weights: the target share of each source; by default its share of all blocks, and every row is
    selected. A null source is a source of its own; a source without a weight, or with weight 0, has null
    slots and is not selected, and weights of sources that are not there are left out. Inside a block rows go by place. Repeated rows
    are rows like others; an empty table gives no rows.
    """
    docs = scanned(spark, docs)
    return scheduled(spark, keyed(docs), weights, block, frame).select("doc_id", "source", "block", "place", "slot", "selected")


@tidy
def mix(spark: SparkSession, docs: DataFrame, weights: Mapping[str | None, float] | None = None, block: int = BLOCK) -> DataFrame:
    """The selected rows of docs in the order of the mix, with their columns."""
    docs = scanned(spark, docs)
    chosen = scheduled(spark, keyed(docs), weights, block).filter("selected").select("uid", "slot", "place")
    chosen = save(spark, chosen, "chosen")
    rows = packed(docs).join(chosen.hint("shuffle_hash"), "uid")
    return unpacked(rows.orderBy("slot", "place"), docs.columns)
