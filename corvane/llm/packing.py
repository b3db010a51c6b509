"""Best-fit packing of token sequences by minimum bin slack.

The search never sees documents, only how many pieces there are of each length (at most ``capacity``
numbers, whatever the size of the corpus). For each bin the longest length left is fixed, and a
bitset subset-sum over the other available lengths finds the fullest feasible combination. That
combination is removed as many times as the counts allow. Pieces then take their places by their
rank within their length, which needs one narrow shuffle.

Defined results: a null or empty text is a piece of the end id alone; repeated rows are packed each;
null doc_ids rank first; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import crc, encoder, with_end
from .shared import parallelism, spread_rank, staged

BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
ROWS = 2000  # texts that a worker gets at once, at most: a batch is held by the JVM and by the worker, with copies
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def fullest(room: int, left: dict[int, int]) -> Counter[int]:
    """The combination of available lengths with the largest sum of at most ``room``; longer lengths are preferred."""
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length in sorted((x for x in left if x <= room), reverse=True):
        copies, take = min(left[length], room // length), 1
        while copies > 0 and not reach >> room & 1:
            take = min(take, copies)
            steps.append((length, take, reach))
            reach |= reach << (length * take) & mask
            copies, take = copies - take, take * 2
        if reach >> room & 1:
            break
    at, chosen = reach.bit_length() - 1, Counter()
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            chosen[length] += take
            at -= length * take
    return chosen


def minimum_bin_slack(counts: dict[int, int], capacity: int) -> list[tuple[Counter[int], int]]:
    """Combinations and how often each is used; together they use every piece once."""
    left, bins = {k: v for k, v in counts.items() if v}, []
    while left:
        first = max(left)
        rest = {k: v - (k == first) for k, v in left.items() if v > (k == first)}
        chosen = fullest(capacity - first, rest)
        chosen[first] += 1
        times = min(left[k] // m for k, m in chosen.items())
        for k, m in chosen.items():
            left[k] -= m * times
            if not left[k]:
                del left[k]
        bins.append((chosen, times))
    return bins


def placements(bins: list[tuple[Counter[int], int]]) -> dict[str, np.ndarray]:
    """For ranges of ranks within a length: the first sequence, pieces of it per sequence, and the first offset."""
    used: Counter[int] = Counter()
    rows, base = [], 0
    for chosen, times in bins:
        offset = 0
        for length in sorted(chosen, reverse=True):
            m = chosen[length]
            rows.append((length, used[length], base, m, offset))
            used[length] += m * times
            offset += m * length
        base += times
    cols = np.array(sorted(rows), np.int64).reshape(-1, 5).T
    return dict(zip(("length", "rank", "sequence", "per", "offset"), cols, strict=True))


def _cut(path: str, kind: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, kind)
        for whole in batches:
            for at, ids, edges in enc.ids(whole.column("text")):
                ids, edges = with_end(ids, edges, end_id)
                n = np.diff(edges)
                cuts = -(-n // capacity)  # pieces of each document
                doc = np.repeat(np.arange(len(n)), cuts)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
                start = piece * capacity
                length = np.minimum(n[doc] - start, capacity)
                first = edges[doc] + start
                sums = [crc(ids[s:e]) for s, e in zip(first.tolist(), (first + length).tolist(), strict=True)]
                ids_of = whole.column("doc_id").slice(at, len(n)).take(pa.array(doc))
                yield pa.RecordBatch.from_arrays([ids_of, pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(sums, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def _place(plan: dict[str, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = 1 << 40  # above any rank
        keys = plan["length"] * wide + plan["rank"]
        for b in batches:
            if not b.num_rows:
                continue
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            at = np.searchsorted(keys, length * wide + rank, "right") - 1
            nth, per = rank - plan["rank"][at], plan["per"][at]
            sequence, offset = plan["sequence"][at] + nth // per, plan["offset"][at] + nth % per * length
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")], pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack_pieces(pieces: DataFrame, capacity: int) -> DataFrame:
    """Adds sequence_id and offset to rows of (doc_id, piece, start, length, ids_crc32)."""
    spark = pieces.sparkSession
    before = spark.conf.get(BATCH_ROWS)
    spark.conf.set(BATCH_ROWS, str(min(int(before), ROWS) if int(before) > 0 else ROWS))
    try:
        kept = staged(pieces)
    finally:
        spark.conf.set(BATCH_ROWS, before)
    counts = {r["length"]: r["n"] for r in kept.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per length
    plan = placements(minimum_bin_slack(counts, capacity))
    slices = min(64, parallelism(kept.sparkSession))
    ranked = spread_rank(kept, ["length"], ["doc_id", "piece", "ids_crc32"], "rank", slices)
    return ranked.mapInArrow(_place(plan), f"{PIECES}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, kind: str = "word", end_id: int = 1, capacity: int = 4096, text_col: str = "text") -> DataFrame:
    """Encode, cut what is longer than ``capacity``, and pack."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col(text_col).alias("text"))
    return pack_pieces(rows.mapInArrow(_cut(tokenizer_path, kind, end_id, capacity), PIECES), capacity)
