"""Similarity self-join on word shingles: a count-vector R-tree whose first level is an exact prefix index.

Two documents link when 100 * |A n B| >= 75 * |A u B| over their distinct shingles. Shingles are
hashed into groups; a document's counts per group are a point, and the sum of coordinate minima of two
points bounds the overlap of their sets from above. An R-tree over points (a node holds the
coordinate maxima of what is below it) finds the pairs that the bound leaves, and those are verified
on their sets.

Near the root such a tree can't prune among unrelated texts (their points all lie in one ball, so work
grows with the square of the corpus). So the root branches by shingle, which loses no pair: a document
with n shingles is below its first n - ceil(0.75 n) + 1 in one global order (frequent ones last, then by
hash); any two linked documents share one of these. Subtrees (blocks) are what is shuffled:

1. Frequent shingles, counted over all documents, a bounded list. It only sets the order.
2. Prefixes meet in buckets of packed arrays, with each shingle's place and its document's size. A linked
   pair has nothing in common before the first shingle it shares, so there the places leave room
   for the overlap it needs; pairs for which they don't (most of those that meet by chance) go no further.
   Within a bucket each prefix shingle links its documents to the smallest one: a star, linear in the
   group, however large. Star pairs that the bound leaves are verified, and linked documents form
   first components. What has such room beside the star, is the shingle's block.
3. Blocks whose documents lie in several components are searched in full: a subtree
   each, bulk-loaded by size, finds all pairs across components that the bound leaves. Only the documents
   of such pairs go on, with their whole sets: their pairs are verified in place, those of components that
   a link has joined meanwhile are passed over, and each call yields a forest of links, never its pairs.
   Near copies share most of their prefixes, so a group of them meets in block after block: blocks with
   the same smallest component become one of all their documents where that has no more pairs.
   A block of more than TILE documents is parted by size first (sets that link differ in
   size by 4/3 at most, so each band meets itself and the next), and what is still larger in tiles.
   So a group of near copies costs rows in proportion to its documents, and no link between different texts is lost.

A point made of a set at hand has a group for each shingle, about; one that is stored or sent, a group for two and half
a byte for each. Prefixes are made anew for the buckets and not stored, since they would be most of what is. Star pairs
are bounded by points and then by 16-bit forms of the sets, sent for the survivors alone, before whole sets decide. Blocks
with the same smallest component go to the same call, where a document's point comes once, however many of its blocks are there.

Documents with equal sets collapse per batch before all this, and by a fingerprint across batches.

Defined results: a null, empty or wordless text has no shingles and links with nothing; rows that
repeat a doc_id are one node; rows with a null doc_id link with nothing and their component is null;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import parallelism, released, staged
from .words import blocks, shingle_runs, shingle_sets

WORDS = 5
PERCENT = 75
GROUPS = 64  # of a point, at least
FINE = 1  # shingles to a group
SENT = 2  # the same in points that are stored and sent, with half a byte to a group if no count is larger than 15
FINEST = 13  # at most 2 ** 13 groups
FAN = 16  # entries of a node
PAIRED = 64  # documents of a prefix shingle whose pairs are looked at one by one
FREQUENT = 200_000  # frequent shingles put last in the order, at most
FREQUENT_FROM = 12  # documents
BUCKET = 800_000  # prefix entries in a bucket, about
LOCAL = 4_000_000  # documents to a salt: bounds what one prefix shingle brings into a task
TILE = 2048  # documents of a block that are compared at once
GROUP = 20_000  # rows of tiles that a call gets, about
SMALL = 5_000  # the same where whole sets come along
STEP = 4096  # pairs between looks at what has been joined
BROADCAST_IDS = 500_000
SHINGLES = 1 << 21  # counted or dealt at once


def prefix_size(n: int, percent: int = PERCENT) -> int:
    """So many first shingles that two linked sets share one of them."""
    return n - -(-percent * n // 100) + 1


def needed(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The least overlap of linked sets of sizes ``a`` and ``b``: 100 I >= p (a + b - I)."""
    return -(-percent * (a + b) // (100 + percent))


def packed_point(s: np.ndarray, per: int = FINE) -> bytes:
    """Counts per group, with a group or more for ``per`` shingles of all but the longest texts, so that the bound stays sharp for long texts."""
    g = GROUPS.bit_length() - 1
    while per << g < len(s) and g < FINEST:
        g += 1
    counts = np.bincount((s & np.uint64((1 << g) - 1)).astype(np.int64), minlength=1 << g)
    return bytes([g]) + counts.astype(np.uint8 if counts.max(initial=0) < 256 else np.uint32).tobytes()


def packed_points(flat: np.ndarray, edges: np.ndarray, per: int = FINE) -> list[bytes]:
    """Points like :func:`packed_point` of each of the sets between ``edges``; two counts to a byte where all are below 16."""
    n = np.diff(edges)
    low = GROUPS.bit_length() - 1
    grain = low + sum((n > per << g).astype(np.int64) for g in range(low, FINEST))
    out: list[bytes] = [b""] * len(n)
    for g in np.unique(grain).tolist():
        mine = np.flatnonzero(grain == g)
        inside = flat[np.repeat(grain == g, n)]
        counts = np.bincount(np.repeat(np.arange(len(mine)) << g, n[mine]) + (inside & np.uint64((1 << g) - 1)).astype(np.int64), minlength=len(mine) << g).reshape(-1, 1 << g)
        most, head = counts.max(1).tolist(), bytes([g])
        narrow = counts.astype(np.uint8)
        halves = narrow[:, ::2] | narrow[:, 1::2] << 4
        for k, d in enumerate(mine.tolist()):
            out[d] = head + (halves[k] if most[k] < 16 else narrow[k] if most[k] < 256 else counts[k].astype(np.uint32)).tobytes()
    return out


class Points:
    """Count vectors of several grains: groups are powers of two, so a finer one folds into any coarser."""

    def __init__(self, packed: list[bytes]):
        self.grain = np.array([p[0] for p in packed], np.int64)
        self.bits = np.array([(len(p) - 1 << 3) >> p[0] for p in packed], np.int64)  # of a count
        self.raw = [memoryview(p)[1:] for p in packed]

    def folded(self, rows: np.ndarray, g: int) -> np.ndarray:
        own, bits = self.grain[rows], self.bits[rows]

        def read(mine: np.ndarray, width: int) -> np.ndarray:
            flat = np.frombuffer(b"".join([self.raw[r] for r in mine.tolist()]), np.uint32 if width == 32 else np.uint8)
            if width == 4:
                flat = np.stack([flat & 15, flat >> 4], 1)
            return flat.reshape(len(mine), -1, 1 << g)

        if len(rows) and (bits == bits[0]).all() and bits[0] < 32 and (own == g).all():
            return read(rows, bits[0])[:, 0]
        out = np.empty((len(rows), 1 << g), np.uint32)
        for h in np.unique(own).tolist():
            for width in (4, 8, 32):
                mine = (own == h) & (bits == width)
                if mine.any():
                    out[mine] = read(rows[mine], width).sum(1, dtype=np.uint32)
        return out

    def bounds(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Sums of coordinate minima of pairs, each at the finer grain that both have."""
        out = np.zeros(len(x), np.int64)
        common = np.minimum(self.grain[x], self.grain[y])
        for g in np.unique(common).tolist():
            mine = np.flatnonzero(common == g)
            step = max(1, (1 << 22) >> g)
            for k in range(0, len(mine), step):
                at = mine[k : k + step]
                rows, inverse = np.unique(np.concatenate([x[at], y[at]]), return_inverse=True)
                m = self.folded(rows, g)
                out[at] = np.minimum(m[inverse[: len(at)]], m[inverse[len(at) :]]).sum(1, dtype=np.int64)
        return out


class CountVectorRTree:
    """Bulk-loaded R-tree over count vectors, searched by the bound on overlap."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, fan: int = FAN):
        order = np.lexsort((points.argmax(1) if len(points) else [], sizes))  # neighbours in size, then in their fullest group
        self.points, self.sizes, self.order, self.fan = points[order], sizes[order], order, fan
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # coordinate maxima and smallest size of each node
        high, low = self.points, self.sizes
        while len(high) > fan:
            cuts = np.arange(0, len(high), fan)
            high, low = np.maximum.reduceat(high, cuts), np.minimum.reduceat(low, cuts)
            self.levels.append((high, low))

    def join(self, points: np.ndarray, sizes: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
        """(query, position) of all pairs whose overlap may suffice; the queries descend together, level by level."""
        top = len(self.levels[-1][0]) if self.levels else len(self.points)
        step, asked, hits = max(1, (1 << 15) // max(top, 1)), [], []
        for s in range(0, len(points), step):
            q = np.repeat(np.arange(s, min(s + step, len(points))), top)
            at = np.tile(np.arange(top), min(s + step, len(points)) - s)
            for depth in range(len(self.levels), -1, -1):
                high, low = self.levels[depth - 1] if depth else (self.points, self.sizes)
                left = np.concatenate([self._open(high[at[k : k + (1 << 15)]], low[at[k : k + (1 << 15)]], points[q[k : k + (1 << 15)]], sizes[q[k : k + (1 << 15)]], percent) for k in range(0, len(q), 1 << 15)] or [np.zeros(0, bool)])
                q, at = q[left], at[left]
                if depth:
                    total = len(self.levels[depth - 2][0]) if depth > 1 else len(self.points)
                    q, at = np.repeat(q, self.fan), (at[:, None] * self.fan + np.arange(self.fan)).ravel()
                    q, at = q[at < total], at[at < total]
            asked.append(q)
            hits.append(self.order[at])
        return (np.concatenate(asked), np.concatenate(hits)) if asked else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    @staticmethod
    def _open(high: np.ndarray, low: np.ndarray, points: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
        return np.minimum(high, points).sum(1, dtype=np.int64) >= needed(low, sizes, percent)

    def search(self, point: np.ndarray, size: int, percent: int = PERCENT) -> np.ndarray:
        """Positions whose overlap with ``point`` may suffice."""
        return self.join(point[None, :], np.array([size], np.int64), percent)[1]


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def counted(sets: list[np.ndarray]) -> pa.RecordBatch:
        h = np.sort(np.concatenate(sets)) if sets else np.zeros(0, np.uint64)
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        n = np.diff(np.concatenate([first, [len(h)]]))
        return pa.RecordBatch.from_arrays([pa.array(h[first][n > 1].view(np.int64)), pa.array(n[n > 1].astype(np.int64))], ["h", "n"])

    for b in batches:
        seen, sets, size = set(), [], 0
        for _, texts in blocks(b):
            flat, edges = shingle_runs(texts, WORDS)
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(flat)])[edges]
            new = []
            for key in zip(np.diff(edges).tolist(), (total[1:] - total[:-1]).tolist(), strict=True):
                new.append(key not in seen)
                seen.add(key)
            sets.append(flat if all(new) else flat[np.repeat(new, np.diff(edges))])
            size += len(sets[-1])
            if size > SHINGLES:
                yield counted(sets)
                sets, size = [], 0
        yield counted(sets)


def frequent_shingles(docs: DataFrame) -> np.ndarray:
    """Sorted hashes of shingles that many different texts share; those met twice at once are summed over all batches."""
    rows = docs.select("text").mapInArrow(_frequent, "h long, n long")
    top = rows.groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= FREQUENT_FROM).orderBy(F.desc("n"), "h").limit(FREQUENT)
    return np.sort(top.select("h").toArrow().column("h").to_numpy().view(np.uint64))


def fingerprints(flat: np.ndarray, edges: np.ndarray) -> list[bytes]:
    """128 bits and the size of each of the sets between ``edges``."""
    sums = np.zeros((len(flat) + 1, 2), np.uint64)
    np.cumsum(flat, out=sums[1:, 0])
    np.cumsum((flat ^ (flat >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93), out=sums[1:, 1])
    both = (sums[edges[1:]] - sums[edges[:-1]]).tobytes()
    return [both[16 * k : 16 * k + 16] + n.to_bytes(4, "little") for k, n in enumerate(np.diff(edges).tolist())]


class Order:
    """The global order: by hash, frequent shingles last."""

    def __init__(self, frequent: np.ndarray):
        self.frequent = frequent
        self.maybe = np.zeros(1 << 22, bool)  # by the low bits of a hash: few others are looked up
        self.maybe[self._low(frequent)] = True

    def _low(self, h: np.ndarray) -> np.ndarray:
        return (h & np.uint64(len(self.maybe) - 1)).astype(np.int64)

    def late(self, h: np.ndarray) -> np.ndarray:
        out = self.maybe[self._low(h)]
        at = np.flatnonzero(out)
        if len(at):
            out[at] = self.frequent[np.minimum(np.searchsorted(self.frequent, h[at]), len(self.frequent) - 1)] == h[at]
        return out

    def prefixes(self, flat: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The prefix of each of the sorted sets between ``edges``, in the order, and the edges between prefixes."""
        n = np.diff(edges)
        size = np.where(n > 0, prefix_size(n), 0)
        late = self.late(flat)
        before = np.concatenate([[0], np.cumsum(late)])
        doc = np.repeat(np.arange(len(n)), n)
        behind = np.arange(len(flat)) - edges[doc]  # place by hash alone
        lates = before[:-1] - before[edges[doc]]  # late ones before it
        place = np.where(late, (n - np.diff(before[edges]))[doc] + lates, behind - lates)
        taken = place < size[doc]
        cuts = np.concatenate([[0], np.cumsum(size)])
        out = np.empty(cuts[-1], np.uint64)
        out[cuts[doc[taken]] + place[taken]] = flat[taken]
        return out, cuts


INDEX = "doc_id long, rep long, n int, fp binary, fine binary"


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Ids of runs of rows, the first of each batch with the same set, and the sets."""
    for whole in batches:
        seen: dict[bytes, int] = {}
        for b, texts in blocks(whole):
            flat, edges = shingle_runs(texts, WORDS)
            ids, sizes, fps = b.column("doc_id").to_pylist(), np.diff(edges), fingerprints(flat, edges)
            reps = [seen.setdefault(fp, doc_id) if doc_id is not None and n else None for doc_id, n, fp in zip(ids, sizes.tolist(), fps, strict=True)]
            yield ids, reps, fps, flat, edges


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, reps, fps, flat, edges in _told(batches):
        fine = np.full(len(ids), None)
        some = np.array([rep is not None for rep in reps], bool)
        sizes = np.diff(edges)
        fine[some] = packed_points(flat[np.repeat(some, sizes)], np.concatenate([[0], np.cumsum(sizes[some])]), SENT)
        columns = [pa.array(ids, pa.int64()), pa.array(reps, pa.int64()), pa.array(sizes.astype(np.int32)), *(pa.array(c, pa.binary()) for c in (fps, fine))]
        yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in INDEX.split(", ")])


def _prefixes(frequent: np.ndarray):
    """(doc_id, n, sigs): the prefix of the first document of each batch with the same set, about ``SHINGLES`` of them at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, docs, ns, sigs, held = Order(frequent), [], [], [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(ns, pa.int32()), pa.array(sigs, pa.binary())], ["doc_id", "n", "sigs"])

        for ids, reps, _, flat, edges in _told(batches):
            sizes = np.diff(edges)
            own = np.array([rep is not None and rep == doc_id for rep, doc_id in zip(reps, ids, strict=True)], bool)
            prefix, cuts = order.prefixes(flat[np.repeat(own, sizes)], np.concatenate([[0], np.cumsum(sizes[own])]))
            docs += [doc_id for doc_id, mine in zip(ids, own.tolist(), strict=True) if mine]
            ns += sizes[own].tolist()
            sigs += [prefix[s:e].tobytes() for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            held += len(prefix)
            if held > SHINGLES:
                yield batch()
                docs, ns, sigs, held = [], [], [], 0
        yield batch()

    return run


PREFIXES = "doc_id long, n int, sigs binary"


def narrowed(x: np.ndarray) -> bytes:
    """Integers as differences from the least of them, in 1, 2, 4 or 8 bytes each."""
    x = x.astype(np.int64)
    least = x.min()
    apart = x.view(np.uint64) - least.view(np.uint64)
    width = next(w for w in (1, 2, 4, 8) if int(apart.max()) < 1 << 8 * w)
    return bytes([width]) + least.tobytes() + apart.astype(f"u{width}").tobytes()


def widened(blobs: list[bytes]) -> np.ndarray:
    """The integers of such blobs, one after the other."""
    return np.concatenate([(np.frombuffer(b, f"u{b[0]}", offset=9).astype(np.uint64) + np.frombuffer(b, np.uint64, 1, 1)).view(np.int64) for b in blobs])


def grain_of_places(n: np.ndarray) -> np.ndarray:
    """So many low bits of a place in the prefix of a set of size ``n`` are dropped that a byte holds it."""
    return np.maximum(np.ceil(np.log2(np.maximum(prefix_size(n), 1))).astype(np.int64) - 8, 0)


def _deal(buckets: int, salts: int):
    """Packs (shingle, doc_id) pairs into a row for each bucket and batch; without salts, half a shingle and its place in a byte, and
    once for all shingles of a document there its id, its size and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            blobs = b.column("sigs").to_pylist()
            count = np.array([len(x) >> 3 for x in blobs])
            sig = np.frombuffer(b"".join(blobs), np.uint64)
            bucket = (sig % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            row = np.repeat(np.arange(len(count)), count)
            ids = b.column("doc_id").to_numpy()
            salt = int(ids[0]) % salts if salts > 1 else 0
            named = bucket[order]
            first = np.flatnonzero(np.concatenate([[True], named[1:] != named[:-1]]))
            cuts = list(zip(first.tolist(), [*first[1:].tolist(), len(named)], strict=True))
            head = [pa.array(named[first]), pa.array(np.full(len(first), salt))]
            if salts > 1:
                packed = {"sigs": sig[order], "docs": ids[row][order]}
                packs = [pa.array([x[s:e].tobytes() for s, e in cuts]) for x in packed.values()]
                yield pa.RecordBatch.from_arrays([*head, *packs], ["bucket", "salt", *packed])
                continue
            size = b.column("n").to_numpy().astype(np.int64)
            place = (np.arange(len(sig)) - np.repeat(np.cumsum(count) - count, count)) >> grain_of_places(size)[row]
            packed = {"sigs": (sig >> np.uint64(32)).astype(np.uint32)[order], "places": place.astype(np.uint8)[order]}  # shingles that meet in a half share a block
            row = row[order]
            new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (named[1:] != named[:-1])]))
            runs = {"docs": ids[row[new]], "sizes": size[row[new]], "runs": np.diff(np.concatenate([new, [len(row)]]))}
            inner = np.searchsorted(new, [*first, len(row)]).tolist()
            packs = [pa.array([x[s:e].tobytes() for s, e in cuts]) for x in packed.values()]
            packs += [pa.array([narrowed(x[s:e]) for s, e in zip(inner[:-1], inner[1:], strict=True)]) for x in runs.values()]
            yield pa.RecordBatch.from_arrays([*head, *packs], ["bucket", "salt", *packed, *runs])

    return run


def _dealt(frequent: np.ndarray, buckets: int, salts: int):
    """Packs of the documents' prefixes, in one pass over the texts."""
    return lambda batches: _deal(buckets, salts)(_prefixes(frequent)(batches))


DEALT = "bucket long, salt long, sigs binary, docs binary"
PLACED = "bucket long, salt long, sigs binary, places binary, docs binary, sizes binary, runs binary"


def roomy(n: np.ndarray, at: np.ndarray, m: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Whether sets of sizes ``n`` and ``m`` may link if the first shingle they share is at these places: it and what comes later must do."""
    return np.minimum(n - at, m - to) >= needed(n, m)


def _meetings(part: pa.Table) -> pa.Table:
    """In a bucket, by prefix shingle: the star's pairs (a, b) that have room, and as a block (sig, doc_id) what has room for another pair beside the star."""
    sig, place = (np.frombuffer(b"".join(part.column(c).to_pylist()), k) for c, k in (("sigs", np.uint32), ("places", np.uint8)))
    doc, size, runs = (widened(part.column(c).to_pylist()) for c in ("docs", "sizes", "runs"))
    grain, run = grain_of_places(size), np.repeat(np.arange(len(runs), dtype=np.int32), runs)
    order = np.argsort(sig)
    again = sig[order][1:] == sig[order][:-1]
    order = order[np.concatenate([[False], again]) | np.concatenate([again, [False]])]  # most shingles are in one document
    order = order[np.lexsort((place[order], doc[run[order]], sig[order]))]
    sig, place, run = sig[order], place[order], run[order]
    doc, size, place = doc[run], size[run], place.astype(np.int64) << grain[run]  # the first place that it may be
    once = np.ones(len(sig), bool)
    once[1:] = (sig[1:] != sig[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(once)
    if len(at) < len(sig):  # rows that repeat a doc_id, or halves that meet: the first place; any size where sizes differ
        odd = np.maximum.reduceat(size, at) != np.minimum.reduceat(size, at)
        sig, doc, size, place = sig[at], doc[at], size[at], place[at]
    else:
        odd = np.zeros(len(sig), bool)

    def room(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return roomy(size[x], place[x], size[y], place[y]) | odd[x] | odd[y]

    first = np.ones(len(sig), bool)
    first[1:] = sig[1:] != sig[:-1]
    at = np.flatnonzero(first)
    many = np.diff(np.concatenate([at, [len(sig)]]))
    centre, rest = np.repeat(at, many)[~first], np.flatnonzero(~first)
    open_ = room(centre, rest)
    pairs = np.stack([doc[centre[open_]], doc[rest[open_]]], 1)
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    pairs = pairs[np.concatenate([[True], (pairs[1:] != pairs[:-1]).any(1)])[: len(pairs)]]

    block = np.repeat(many > PAIRED, many) & ~first
    for m in np.unique(many[(many > 2) & (many <= PAIRED)]).tolist():  # the centre's pairs are all in the star
        x, y = np.triu_indices(m - 1, 1)
        tops = at[many == m]
        step = max(1, (1 << 18) // len(x))
        for k in range(0, len(tops), step):
            own = tops[k : k + step, None] + 1
            p, q = (own + x).ravel(), (own + y).ravel()
            open_ = room(p, q)
            block[p[open_]] = block[q[open_]] = True
    name = (part.column("bucket")[0].as_py() << 32) + sig[block].astype(np.int64)
    found = [pa.table({"a": pairs[:, 0], "b": pairs[:, 1]}), pa.table({"sig": name, "doc_id": doc[block]})]
    return pa.concat_tables(found, promote_options="default")


MET = "a long, b long, sig long, doc_id long"


def _stars(carry: bool):
    """Each shingle's documents linked to the smallest of them, and what shingles of three documents or more hold; with ``carry`` also all smallest ones, for a second level."""

    def run(part: pa.Table) -> pa.Table:
        sig = np.frombuffer(b"".join(part.column("sigs").to_pylist()), np.uint64)
        doc = np.frombuffer(b"".join(part.column("docs").to_pylist()), np.int64)
        order = np.lexsort((doc, sig))
        sig, doc = sig[order], doc[order]
        once = np.concatenate([[True], (sig[1:] != sig[:-1]) | (doc[1:] != doc[:-1])])  # rows that repeat a doc_id
        sig, doc = sig[once], doc[once]
        first = np.concatenate([[True], sig[1:] != sig[:-1]])
        at = np.flatnonzero(first)
        group = np.cumsum(first) - 1
        centre = doc[at][group]
        apart = centre != doc
        pairs = np.unique(np.stack([centre[apart], doc[apart]], 1), axis=0) if apart.any() else np.zeros((0, 2), np.int64)
        many = (np.diff(np.concatenate([at, [len(sig)]])) > 2)[group]  # a shingle of two documents has no pair but the star's
        out = [pa.table({"a": pairs[:, 0], "b": pairs[:, 1]}), pa.table({"sig": sig[many].view(np.int64), "doc_id": doc[many]})]
        blobs = [[sig[at].tobytes()], [doc[at].tobytes()]] if carry else [[], []]
        out.append(pa.table({"bucket": part.column("bucket")[: int(carry)], "sigs": pa.array(blobs[0], pa.binary()), "docs": pa.array(blobs[1], pa.binary())}))
        return pa.concat_tables(out, promote_options="default").select([x.split()[0] for x in STARS.split(", ")])

    return run


STARS = "a long, b long, sig long, doc_id long, bucket long, sigs binary, docs binary"


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose count vectors leave room for the overlap they need."""
    for b in batches:
        if b.num_rows:
            n, m = (b.column(c).to_numpy().astype(np.int64) for c in ("na", "nb"))
            points, k = Points([*b.column("va").to_pylist(), *b.column("vb").to_pylist()]), np.arange(len(n))
            ok = points.bounds(k, k + len(n)) >= needed(n, m)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(ok))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b, texts in blocks(whole):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([s.tobytes() for s in shingle_sets(texts, WORDS)], pa.binary())], ["doc_id", "members"])


def _short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted 16-bit forms of the sets: a quarter of their size."""
    for b in batches:
        forms = [np.sort(np.frombuffer(m.as_buffer(), np.uint64).astype(np.uint16)).tobytes() for m in b.column("members")]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(forms, pa.binary())], ["doc_id", "short"])


def _overlapping(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose 16-bit forms share enough; equal shingles have equal forms, so no link is lost."""

    def inside(s: np.ndarray, t: np.ndarray) -> int:
        return int((t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s).sum())

    for b in batches:
        ok = []
        for x, y in zip(b.column("sa"), b.column("sb"), strict=True):
            s, t = np.frombuffer(x.as_buffer(), np.uint16), np.frombuffer(y.as_buffer(), np.uint16)
            ok.append(bool(len(s) and len(t)) and min(inside(s, t), inside(t, s)) >= -(-PERCENT * (len(s) + len(t)) // (100 + PERCENT)))
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ok = []
        for x, y in zip(b.column("sa"), b.column("sb"), strict=True):
            s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            ok.append(linked_sets(s, t))
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))


def members(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, members): the whole shingle set of each of the documents ``ids``, one row each."""
    ids = staged(ids)
    mine = docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi")
    sets = staged(mine.select("doc_id", "text").mapInArrow(_sets, "doc_id long, members binary"))
    released(ids)
    return sets


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) of doc_ids whose whole shingle sets meet the threshold."""
    sets = members(docs, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    short = staged(sets.mapInArrow(_short, "doc_id long, short binary"))
    coarse = pairs.join(short.select(F.col("doc_id").alias("b"), F.col("short").alias("sb")), "b").join(short.select(F.col("doc_id").alias("a"), F.col("short").alias("sa")), "a")
    likely = staged(coarse.select("a", "b", "sa", "sb").mapInArrow(_overlapping, "a long, b long").distinct())
    with_b = likely.join(sets.select(F.col("doc_id").alias("b"), F.col("members").alias("sb")), "b")
    full = with_b.join(sets.select(F.col("doc_id").alias("a"), F.col("members").alias("sa")), "a")
    found = staged(full.select("a", "b", "sa", "sb").mapInArrow(_linked, "a long, b long").distinct())
    released(sets, short, likely)
    return found


class Forest:
    """Components that grow while links are found."""

    def __init__(self, n: int):
        self.top = np.arange(n)

    def tops(self) -> np.ndarray:
        while (self.top != (up := self.top[self.top])).any():
            self.top = up
        return self.top

    def find(self, x: int) -> int:
        top = self.top
        while top[x] != x:
            top[x] = top[top[x]]
            x = int(top[x])
        return x

    def join(self, x: int, y: int) -> None:
        self.top[y] = x


def _left_over(part: pa.Table, ids: np.ndarray, points: Points, n: np.ndarray) -> tuple[pa.Table, Iterator[tuple[np.ndarray, np.ndarray]]]:
    """The rows of tiles at hand in order, and their pairs from different components that the bound leaves; ``ids`` (sorted), ``points`` and sizes ``n`` have a row for each text of a document."""
    part = part.sort_by([(c, "ascending") for c in ("sig", "band", "i", "j", "chunk")])
    sig, band, i, j, doc, label, chunk = (part.column(c).to_numpy().astype(np.int64) for c in ("sig", "band", "i", "j", "doc_id", "label", "chunk"))
    at = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])[: len(ids)])
    more = np.diff(np.concatenate([at, [len(ids)]]))
    odd = more > 1  # of a repeated doc_id each text counts: its pairs go on
    place = np.searchsorted(ids[at], doc)
    sizes = (np.minimum.reduceat(n, at) if len(at) else n)[place]
    first = np.flatnonzero(np.concatenate([[True], (sig[1:] != sig[:-1]) | (band[1:] != band[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))

    def keep(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sure = odd[place[x]] | odd[place[y]]
        apart = (label[x] != label[y]) & (sure | (np.minimum(sizes[x], sizes[y]) >= needed(sizes[x], sizes[y])))
        x, y = x[apart], y[apart]
        _, once = np.unique(np.minimum(place[x], place[y]) * len(ids) + np.maximum(place[x], place[y]), return_index=True)
        x, y = x[once], y[once]  # documents meet in many blocks
        sure = odd[place[x]] | odd[place[y]]
        left = sure | (points.bounds(at[place[x]], at[place[y]]) >= needed(sizes[x], sizes[y]))
        return x[left], y[left]

    def found() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        left, right = [], []
        for s, e in zip(first.tolist(), [*first[1:].tolist(), len(sig)], strict=True):
            if e - s <= FAN and i[s] == j[s]:  # a tree of one leaf: its pairs are bounded together with those of other such trees
                x, y = np.triu_indices(e - s, 1)
                left.append(x + s)
                right.append(y + s)
                continue
            same = i[s] == j[s]
            low = s + np.flatnonzero(same | (chunk[s:e] == i[s]))
            base = points.folded(at[place[s:e]], GROUPS.bit_length() - 1)
            if odd[place[s:e]].any():
                base = base.astype(np.uint32)
            for k in np.flatnonzero(odd[place[s:e]]).tolist():
                d = place[s + k]
                base[k] = points.folded(np.arange(at[d], at[d] + more[d]), GROUPS.bit_length() - 1).max(0)
            tree = CountVectorRTree(base[low - s], sizes[low])
            asked = np.arange(s, e) if same else s + np.flatnonzero(chunk[s:e] == j[s])
            q, hit = tree.join(base[asked - s], sizes[asked])
            q, hit = asked[q], low[hit]
            once = hit < q if same else np.ones(len(q), bool)
            yield keep(hit[once], q[once])
        if left:
            yield keep(np.concatenate(left), np.concatenate(right))

    return part, found()


def _sorted(vectors: pa.Table) -> tuple[np.ndarray, Points, np.ndarray]:
    vectors = vectors.sort_by("doc")
    return vectors.column("doc").to_numpy(), Points(vectors.column("vec").to_pylist()), vectors.column("n").to_numpy().astype(np.int64)


def _across(part: pa.Table, vectors: pa.Table) -> pa.Table:
    """Pairs from different components that the bound leaves, in each of the tiles at hand; ``vectors`` has each document once."""
    part, pairs = _left_over(part, *_sorted(vectors))
    doc = part.column("doc_id").to_numpy()
    found = [np.stack([np.minimum(doc[x], doc[y]), np.maximum(doc[x], doc[y])], 1) for x, y in pairs]
    both = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
    return pa.table({"a": both[:, 0], "b": both[:, 1]})


def _met(part: pa.Table, vectors: pa.Table) -> pa.Table:
    """The rows of tiles whose document has such a pair: rows grow with documents, not with pairs."""
    ids, points, n = _sorted(vectors)
    part, pairs = _left_over(part, ids, points, n)
    place = np.searchsorted(ids, part.column("doc_id").to_numpy())
    met = np.zeros(len(ids), bool)
    for x, y in pairs:
        met[place[x]] = met[place[y]] = True
    return part.select(TILES).filter(pa.array(met[place]))


TILES = ["sig", "lo", "band", "doc_id", "label", "chunk", "i", "j"]


def linked_sets(s: np.ndarray, t: np.ndarray) -> bool:
    if len(s) > len(t):
        s, t = t, s
    both = int((t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s).sum()) if len(t) else 0
    return 100 * both >= PERCENT * (len(s) + len(t) - both) and both > 0


def _joined(part: pa.Table, members: pa.Table) -> pa.Table:
    """Links between different components in the tiles at hand, verified on whole sets: a forest, since pairs within what is joined already are passed over."""
    members = members.sort_by("doc")
    sets = [np.frombuffer(m.as_buffer(), np.uint64) for m in members.column("members").combine_chunks()]
    ids, n = members.column("doc").to_numpy(), np.array([len(s) for s in sets], np.int64)
    part, pairs = _left_over(part, ids, Points([packed_point(s, FINE) for s in sets]), n)
    doc, label = part.column("doc_id").to_numpy(), part.column("label").to_numpy()
    low, high = np.searchsorted(ids, doc), np.searchsorted(ids, doc, "right")  # a repeated doc_id has a set for each row
    _, at = np.unique(label, return_inverse=True)
    forest, out = Forest(int(at.max(initial=-1)) + 1), []
    for x, y in pairs:
        order = np.lexsort((y, x))
        x, y = x[order], y[order]
        for k in range(0, len(x), STEP):  # most pairs of a group go at once when it has been joined
            tops = forest.tops()
            p, q = x[k : k + STEP], y[k : k + STEP]
            open_ = tops[at[p]] != tops[at[q]]
            for u, v in zip(p[open_].tolist(), q[open_].tolist(), strict=True):
                a, b = forest.find(int(at[u])), forest.find(int(at[v]))
                if a != b and any(linked_sets(s, t) for s in sets[low[u] : high[u]] for t in sets[low[v] : high[v]]):
                    forest.join(a, b)
                    out.append((min(doc[u], doc[v]), max(doc[u], doc[v])))
    links = np.array(out, np.int64).reshape(-1, 2)
    return pa.table({"a": links[:, 0], "b": links[:, 1]})


def bounded(pairs: DataFrame, points: DataFrame, grain: str) -> DataFrame:
    """The pairs (a, b) whose points of a grain leave room for a link."""

    def side(x: str) -> DataFrame:
        return points.select(F.col("doc_id").alias(x), F.col("n").alias(f"n{x}"), F.col(grain).alias(f"v{x}"))

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "va", "vb").mapInArrow(_bounded, "a long, b long")


def ngram_components(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles and component_id."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    frequent = frequent_shingles(docs)
    index = staged(docs.mapInArrow(_index, INDEX))
    nodes = index.filter("rep = doc_id")
    size = nodes.agg(F.expr(f"sum(n - ({PERCENT} * n + 99) div 100 + 1)"), F.count(F.lit(1))).first()
    rows = staged(index.select("doc_id", F.col("n").cast("long").alias("n_shingles")))
    if not size[1]:
        return rows.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))

    # equal sets: within a batch, then across batches
    copies = index.filter("rep is not null and rep <> doc_id").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    twins = nodes.join(nodes.groupBy("fp").agg(F.min("doc_id").alias("a")), "fp").filter("a <> doc_id").select("a", F.col("doc_id").alias("b"))
    sure = staged(copies.union(twins).distinct())

    # stars around the smallest document of each prefix shingle
    buckets, salts = max(parallelism(spark), int(size[0] // BUCKET) + 1), int(size[1] // LOCAL) + 1
    if salts == 1:
        dealt = docs.mapInArrow(_dealt(frequent, buckets, salts), PLACED)
        stars = staged(dealt.groupBy("bucket").applyInArrow(_meetings, MET))
    else:  # a shingle's documents are dealt over several salts, where their places can't be compared
        dealt = docs.mapInArrow(_dealt(frequent, buckets, salts), DEALT)
        stars = staged(dealt.groupBy("bucket", "salt").applyInArrow(_stars(True), STARS))
        tops = stars.filter("sigs is not null").select("bucket", F.lit(0).cast("long").alias("salt"), "sigs", "docs")
        stars = staged(stars.unionByName(tops.groupBy("bucket").applyInArrow(_stars(False), STARS)))
    star = staged(stars.filter("a is not null").select("a", "b").distinct())
    entry = stars.filter("sig is not null").select("sig", "doc_id")
    met = star.select(F.explode(F.array("a", "b")).alias("doc_id"))
    met = staged((met.union(entry.select("doc_id")) if salts == 1 else met).distinct())
    if salts > 1:
        own = docs.mapInArrow(_prefixes(frequent), PREFIXES)
        entry = staged(own.join(met, "doc_id", "left_semi").select("doc_id", "sigs").mapInArrow(_entries, "sig long, doc_id long").distinct())
    # all that have a set, not the first of a batch alone: batches may be other ones when docs are read again
    points = staged(index.filter("fine is not null").join(met, "doc_id", "left_semi").select("doc_id", "n", "fine"))
    released(index)

    close = staged(bounded(star.join(sure, ["a", "b"], "left_anti"), points, "fine"))
    links = staged(sure.union(verified(close, docs)))
    released(close)
    first = staged(components(links))

    # blocks that hold several components are searched in full
    label = F.coalesce("label", "doc_id").alias("label")
    entry = staged(entry.join(first.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("sig", "doc_id", label))
    tiles = staged(tiled(entry, points))
    vectors = points.select(F.col("doc_id").alias("doc"), "n", F.col("fine").alias("vec"))
    near = staged(called(tiles, vectors, GROUP, _met, "sig long, lo long, band int, doc_id long, label long, chunk int, i int, j int"))
    sets = members(docs, near.select("doc_id").distinct())
    links = staged(links.union(called(near, sets.withColumnRenamed("doc_id", "doc"), SMALL, _joined, "a long, b long")))
    final = staged(components(links))
    released(stars, star, met, points, entry, tiles, near, sets, links, first, sure)
    return rows.join(final.select(F.col("id").alias("doc_id"), "label"), "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("label", "doc_id").alias("component_id")
    )


def called(tiles: DataFrame, values: DataFrame, rows: int, f, schema: str) -> DataFrame:
    """``f`` of about ``rows`` rows of tiles at once (each tile whole, those of a smallest component together) and the values of their documents, each once."""
    groups = int(tiles.count() // rows) + 1
    heavy = staged(tiles.groupBy("lo").agg(F.expr(f"int(ceil(count(1) / {rows}))").alias("parts")).filter("parts > 1"))
    few = heavy.count() <= BROADCAST_IDS  # at most one for ``rows`` rows
    cell = F.expr("pmod(xxhash64(sig, band, i, j), coalesce(parts, 1))")
    dealt = tiles.join(F.broadcast(heavy) if few else heavy, "lo", "left").withColumn("g", F.pmod(F.xxhash64("lo", cell), F.lit(groups))).drop("parts")
    dealt = staged(dealt)  # read twice
    asked = dealt.select(F.col("g").alias("call"), F.col("doc_id").alias("doc")).distinct()
    return dealt.groupBy("g").cogroup(asked.join(values, "doc").groupBy("call")).applyInArrow(f, schema)


def tiled(entry: DataFrame, points: DataFrame) -> DataFrame:
    """(sig, lo, band, doc_id, label, chunk, i, j), lo a block's smallest component: blocks whose documents lie in several components, the large ones in bands of sizes and in tiles (i, j) of their chunks."""
    marks = [F.expr(f"bit_xor(xxhash64(doc_id, {k}))").alias(f"x{k}") for k in (1, 2)]
    mixed = entry.groupBy("sig").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("m"), *marks).filter("lo <> hi")
    # of blocks with the same documents one is searched
    mixed = mixed.groupBy("lo", "hi", "m", "x1", "x2").agg(F.min("sig").alias("sig")).select("sig", "lo", "m")
    mixed = staged(mixed)
    large = mixed.filter(F.col("m") > TILE).select("sig", "lo")
    found = merged(entry, mixed.filter(F.col("m") <= TILE)).select("sig", "lo", "band", "doc_id", "label", F.lit(0).alias("chunk"), F.lit(0).alias("i"), F.lit(0).alias("j"))
    if large.isEmpty():
        return found
    # sets that link differ in size by 4/3 at most, so they lie in the same band or in neighbouring ones
    step = float(np.log(100 / PERCENT) * (1 + 1e-9))
    own = F.floor(F.log("n") / step).cast("int")
    inside = entry.join(large, "sig").join(points.select("doc_id", "n"), "doc_id").withColumn("band", F.explode(F.array(own, own + 1)))
    many = inside.groupBy("sig", "band").agg(F.expr(f"int(ceil(count(1) / {TILE}))").alias("chunks"), F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high")
    inside = inside.join(many.select("sig", "band", "chunks"), ["sig", "band"]).withColumn("chunk", F.expr("int(pmod(xxhash64(doc_id), chunks))"))
    inside = inside.withColumn("other", F.explode(F.expr("sequence(0, chunks - 1)")))
    return found.unionByName(inside.select("sig", "lo", "band", "doc_id", "label", "chunk", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j")))


def merged(entry: DataFrame, small: DataFrame) -> DataFrame:
    """(sig, lo, band, doc_id, label) of the blocks ``small`` (sig, lo, m). Those with the same smallest component become one block of
    their documents (its band is -1) where that has no more pairs than they have together, or is a tree of one leaf."""
    rows = staged(entry.join(small.select("sig", "lo"), "sig").select("sig", "lo", "doc_id", "label"))
    once = staged(rows.groupBy("lo", "doc_id").agg(F.min("label").alias("label")))
    cost = small.groupBy("lo").agg(F.sum(F.col("m").cast("double") * F.col("m")).alias("cost"))
    whole = once.groupBy("lo").agg(F.count(F.lit(1)).alias("u")).join(cost, "lo").filter(f"u <= {FAN} or u <= {TILE} and double(u) * u <= cost")
    whole = staged(whole.select("lo"))
    apart = rows.join(whole, "lo", "left_anti").select("sig", "lo", F.lit(0).alias("band"), "doc_id", "label")
    out = staged(apart.unionByName(once.join(whole, "lo").select(F.col("lo").alias("sig"), "lo", F.lit(-1).alias("band"), "doc_id", "label")))
    released(rows, once, whole)
    return out


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        blobs = b.column("sigs").to_pylist()
        docs = np.repeat(b.column("doc_id").to_numpy(), [len(x) >> 3 for x in blobs])
        yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(blobs), np.int64)), pa.array(docs)], ["sig", "doc_id"])
