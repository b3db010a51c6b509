"""Mixing sources to target weights by Pfair scheduling.

Time is cut into slots of one block each. A source of weight w (a whole number of slots per period)
releases its j-th block at floor(j * period / w), with the deadline ceil((j + 1) * period / w), and
among the released blocks the earliest deadline goes first. The windows of a set of weights that sum
to one are always met, so at every time each source has had within one block of its share.

The schedule of one period repeats, so it is computed once (its size depends on the sources and the
period, not on the documents), and a document's place follows from its rank within its source alone.
Ranks are taken by doc_id over slices of each source, so that a source which holds a third of all
rows isn't ranked in one task.

A mix has as many slots as there are blocks, and each source has within one block of its weight's share
of them. A source with fewer blocks than that begins again with its first, so ``repeats`` says how often
a block is in the mix; what another source has beyond its share is left out of the mix, but is still
returned, with later slots, ``repeats`` 0 and ``in_mix`` false.

The period has at least four slots for each source, so that any number of sources fits; one count per
source and the schedule of a period are on the driver, and nothing that grows with the documents.

Defined results: columns with the names of the results give way to them; null sources are a source of their own; null doc_ids come first; repeated rows are
rows of their own; a source without a weight, or with weight 0, is never in the mix (slot null);
weights are rounded to whole slots of the period, at least one each; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import parallelism, spread_rank

PERIOD = 4096


def whole_slots(weights: Mapping[str | None, float], period: int) -> dict[str | None, int]:
    """Slots of each source in a period, by largest remainder, at least one for each positive weight."""
    positive = {k: float(v) for k, v in weights.items() if v > 0}
    if not positive:
        return {}
    total = sum(positive.values())
    if len(positive) > period:
        raise ValueError(f"{len(positive)} sources don't fit into a period of {period}")
    exact = {k: v / total * period for k, v in positive.items()}
    slots = {k: max(1, int(v)) for k, v in exact.items()}
    by_need = sorted(exact, key=lambda k: (slots[k] - exact[k], k is None, k or ""))
    at = 0
    while (over := period - sum(slots.values())) > 0:
        slots[by_need[at % len(by_need)]] += 1
        at += 1
    while over < 0:
        most = max(slots, key=lambda k: (slots[k] - exact[k] if slots[k] > 1 else float("-inf"), k is None, k or ""))
        slots[most] -= 1
        over += 1
    return slots


def pfair(slots: Mapping[str | None, int], period: int) -> dict[str | None, list[int]]:
    """The slots of one period that each source gets: earliest deadline first among released blocks."""
    names = sorted(slots, key=lambda k: (k is None, k or ""))
    waiting = [(0, i, 0) for i in range(len(names))]  # release, source, block
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []  # deadline, source, block
    out: dict[str | None, list[int]] = {k: [] for k in names}
    for t in range(period):
        while waiting and waiting[0][0] <= t:
            _, i, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-((j + 1) * period // -slots[names[i]]), i, j))
        deadline, i, j = heapq.heappop(ready)
        if deadline < t + 1:
            raise ValueError("weights exceed one")
        out[names[i]].append(t)
        if j + 1 < slots[names[i]]:
            heapq.heappush(waiting, ((j + 1) * period // slots[names[i]], i, j + 1))
    return out


def tempered_weights(docs: DataFrame, source_col: str = "source", power: float = 0.7) -> dict[str | None, float]:
    """Target weights in proportion to a power of each source's rows, over all rows."""
    counts = docs.groupBy(source_col).agg(F.count(F.lit(1)).alias("n")).collect()  # a row per source
    return {r[0]: float(r[1]) ** power for r in counts}


def mix_sources(
    docs: DataFrame,
    weights: Mapping[str | None, float],
    source_col: str = "source",
    block_docs: int = 4,
    period: int = PERIOD,
    names: tuple[str, str, str, str] = ("block", "slot", "in_mix", "repeats"),
) -> DataFrame:
    """All rows of ``docs`` with their block within the source, its first slot in the interleaved order, whether the mix holds it, and how often."""
    spark = docs.sparkSession
    block, slot, in_mix, repeats = names
    sizes = {r[0]: r[1] for r in docs.groupBy(F.col(source_col).cast("string")).agg(F.count(F.lit(1))).collect()}  # a row per source
    held = {k: -(-n // block_docs) for k, n in sizes.items()}
    weights = {k if k is None else str(k): w for k, w in weights.items()}
    weights = {k: w for k, w in weights.items() if k in held}
    period = max(period, 1 << (4 * len(weights)).bit_length())
    slots = whole_slots(weights, period)
    total = sum(held.values())
    kept = [c for c in docs.columns if c not in names or c in (source_col, "doc_id")]
    tie = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns if c == source_col or docs.schema[c].dataType.simpleString() in ("string", "bigint")])
    ranked = spread_rank(docs.withColumn("_corvane_tie", tie), [source_col], ["doc_id", "_corvane_tie"], "_corvane_rank", min(64, parallelism(spark)))
    rows = []
    for k, at in (pfair(slots, period) if slots else {}).items():
        share = total // period * slots[k] + sum(t < total % period for t in at)  # slots of the source in the mix
        rows.append((k, slots[k], at, held[k], share))
    plan = spark.createDataFrame(rows, "_corvane_source string, _corvane_w int, _corvane_at array<int>, _corvane_held long, _corvane_share long").coalesce(1)
    found = ranked.join(F.broadcast(plan), F.col(source_col).cast("string").eqNullSafe(F.col("_corvane_source")), "left")
    j, w = F.floor(F.col("_corvane_rank") / block_docs), F.col("_corvane_w")
    place = F.floor(j / w) * period + F.element_at("_corvane_at", (j % w + 1).cast("int"))
    times = F.coalesce(F.greatest(F.ceil((F.col("_corvane_share") - j) / F.col("_corvane_held")), F.lit(0)), F.lit(0)).cast("long")
    return found.select(*[F.col(f"`{c}`") for c in kept], j.cast("long").alias(block), place.cast("long").alias(slot), (times > 0).alias(in_mix), times.alias(repeats))
