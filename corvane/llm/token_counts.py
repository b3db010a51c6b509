"""Edit-aware token counts: a segment tree over each document's pre-tokens.

A byte-level BPE vocabulary merges within pre-tokens only, so a document's token count is the sum over
its pre-tokens. The tree keeps, for each node, the characters and tokens below it. An edit finds its
leaves by descending on characters, splits the touched region and its boundary context anew, encodes
only that, and updates the sums above the leaves that changed.

Boundary context: where a pre-token ends depends on at most the two characters after it, and on
nothing before its start. So splitting starts anew at the first pre-token that ends less than two
characters before the edit, and stops as soon as a new boundary falls on an old one behind the edit.

Defined results: a null text is empty; null edits mean none, and a null among them is passed over;
positions beyond the text are clipped; a special token's string is ordinary text (an edit may cut it);
edits apply in the order given, each to the result of the one before; repeated rows are counted each;
other columns are ignored. A document's edits are a bounded array, its text is never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pieces import WINDOW, PieceEncoder, as_bytes, encoder

#: Fixed value: the splitting pattern of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_SPLIT = regex.compile(PATTERN)
CONTEXT = 2  # characters behind a pre-token on which its end may depend
FULL = 32  # pre-tokens in a leaf before the tree is laid out anew


class SegmentTree:
    """Leaves are runs of pre-tokens (one each, at first); inner nodes hold sums of characters and tokens."""

    def __init__(self, pieces: list[str], counts: Sequence[int] | np.ndarray, lengths: np.ndarray | None = None):
        """``lengths`` are the pre-tokens' characters, where the caller has them."""
        if not pieces:
            pieces, counts, lengths = [[]], [[]], None
        self._build(list(pieces), counts if isinstance(counts, np.ndarray) else list(counts), lengths)

    def _build(self, runs: list[str | list[str]], counts: list[int | list[int]] | np.ndarray, lengths: np.ndarray | None = None) -> None:
        #: A leaf's pre-token, or a list of them; and its tokens alike.
        self.runs, self.counts = runs, counts
        size, n = 1, len(runs)
        while size < n:
            size *= 2
        self.size = size
        chars, tokens = np.zeros(2 * size, np.int64), np.zeros(2 * size, np.int64)
        if lengths is None:
            lengths = [chars_of(x) for x in runs]
            counts = [x if isinstance(x, int) else sum(x) for x in counts]
        chars[size : size + n], tokens[size : size + n] = lengths, counts
        while size > 1:
            half = size // 2
            for a in (chars, tokens):
                np.add(a[size : 2 * size : 2], a[size + 1 : 2 * size : 2], out=a[half:size])
            size = half
        self.chars, self.tokens = chars, tokens

    @property
    def leaves(self) -> list[list[str]]:
        return [[x] if isinstance(x, str) else x for x in self.runs]

    def _pieces(self, first: int, last: int) -> list[str]:
        return [p for x in self.runs[first:last] for p in ((x,) if isinstance(x, str) else x)]

    def _counts(self, first: int, last: int) -> list[int]:
        return [c for x in self.counts[first:last] for c in (x if isinstance(x, list) else (int(x),))]

    @property
    def total(self) -> int:
        return int(self.tokens[1])

    @property
    def length(self) -> int:
        return int(self.chars[1])

    def leaf_at(self, pos: int) -> tuple[int, int]:
        """The leaf that holds the character ``pos``, and its first character."""
        node, before = 1, 0
        while node < self.size:
            node *= 2
            if pos - before >= self.chars[node]:
                before += int(self.chars[node])
                node += 1
        return node - self.size, before

    def put(self, first: int, pieces: list[list[str]], counts: list[list[int]]) -> None:
        """New content of the leaves from ``first`` on; sums above them are updated once, level by level."""
        last = first + len(pieces)
        if isinstance(self.counts, np.ndarray):
            self.counts = self.counts.tolist()
        self.runs[first:last], self.counts[first:last] = pieces, counts
        lo, hi = first + self.size, last + self.size
        chars, tokens = self.chars, self.tokens
        chars[lo:hi], tokens[lo:hi] = [sum(map(len, x)) for x in pieces], [sum(x) for x in counts]
        while lo > 1:
            lo, hi = lo // 2, (hi + 1) // 2
            for a in (chars, tokens):
                if hi - lo < 8:
                    for node in range(lo, hi):
                        a[node] = a[2 * node] + a[2 * node + 1]
                else:
                    np.add(a[2 * lo : 2 * hi : 2], a[2 * lo + 1 : 2 * hi : 2], out=a[lo:hi])

    def text(self) -> str:
        return "".join(self._pieces(0, len(self.runs)))

    def edit(self, start: int, deleted: int, inserted: str, count: PieceEncoder) -> int:
        """Apply one edit; returns how many pre-tokens were encoded anew."""
        start = min(max(start, 0), self.length)
        end = min(start + max(deleted, 0), self.length)
        first, base = self.leaf_at(max(start - CONTEXT, 0)) if self.length else (0, 0)
        first = min(first, len(self.runs) - 1)
        # a pre-token that ends within the context may change; none before it can
        last, reached = first, base
        while last < len(self.runs) and reached < end:
            reached += chars_of(self.runs[last])
            last += 1
        shift = len(inserted) - (end - start)
        ahead = 4
        while True:
            more = min(len(self.runs), last + ahead)
            joined = "".join(self._pieces(first, more))
            window = joined[: start - base] + inserted + joined[end - base :]
            whole = more == len(self.runs)
            leaf_ends, at = {}, base  # old boundaries behind the edit, in the window's coordinates
            for k in range(first, more):
                at += chars_of(self.runs[k])
                if at >= end:
                    leaf_ends[at + shift - base] = k + 1
            pieces, at, stop = [], 0, None
            for m in _SPLIT.finditer(window):
                if not whole and m.end() + CONTEXT > len(window):
                    break  # its end can't be known yet
                pieces.append(m[0])
                at = m.end()
                if at in leaf_ends and at >= start - base + len(inserted):
                    stop = leaf_ends[at]
                    break
            if stop is None and whole:
                stop = len(self.runs)
            if stop is not None:
                break
            ahead *= 4
        counts = count.counts(pieces)
        room, n = stop - first, len(pieces)
        if room == 0:
            first, room = max(first - 1, 0), 1
            pieces, counts = self._pieces(first, first + 1) + pieces, self._counts(first, first + 1) + counts
        # a piece to each leaf, what is over to the last
        parts = [slice(k, k + 1) if k < room - 1 else slice(k, None) for k in range(room)]
        self.put(first, [pieces[x] for x in parts], [counts[x] for x in parts])
        if len(pieces) - room >= FULL or len(self.runs[first + room - 1]) > FULL:
            self._build(self._pieces(0, len(self.runs)), self._counts(0, len(self.runs)))
        return n


def chars_of(run: str | list[str]) -> int:
    return len(run) if isinstance(run, str) else sum(map(len, run))


def split(text: str) -> list[str]:
    return _SPLIT.findall(text)


OUT = "doc_id long, n_tokens_before long, n_edits int, n_tokens long, n_chars long, n_reencoded long"


def trees(enc: PieceEncoder, texts: pa.Array) -> Iterator[SegmentTree]:
    """The tree of each text. The encoder's pieces are whole pre-tokens, or a few that are split here."""
    texts, data, edges = as_bytes(texts)
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(edges, edges[at] + WINDOW, "right")) - 1)
        keys, ids, which, among = enc.pieces(data[edges[at] : edges[stop]], edges[at : stop + 1] - edges[at])
        several = {k: parts for k, x in enumerate(keys) if not (x.isalpha() or x[1:].isalpha()) and len(parts := split(x)) > 1}
        odd = np.zeros(len(keys), bool)
        odd[list(several)] = True
        tokens = np.fromiter(map(len, ids), np.int64, len(ids)) >> 2
        chars, names = np.fromiter(map(len, keys), np.int64, len(keys)), np.array([*keys, None], object)[:-1]
        for s, e in zip(among[:-1].tolist(), among[1:].tolist(), strict=True):
            mine = which[s:e]
            if not odd[mine].any():
                yield SegmentTree(names[mine].tolist(), tokens[mine], chars[mine])
                continue
            pieces = [p for k in mine.tolist() for p in several.get(k, (keys[k],))]
            yield SegmentTree(pieces, enc.counts(pieces))
        at = stop


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, "byte", specials=False)
        for b in batches:
            rows = []
            for tree, edits in zip(trees(enc, b.column("text")), b.column("edits").to_pylist(), strict=True):
                edits = [e for e in edits or () if e is not None]
                before, again = tree.total, 0
                for e in edits:
                    again += tree.edit(e["start"] or 0, e["deleted"] or 0, e["inserted"] or "", enc)
                rows.append((before, len(edits), tree.total, tree.length, again))
            if rows:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]], [x.split()[0] for x in OUT.split(", ")])

    return run


def count_tokens_with_edits(docs: DataFrame, tokenizer_path: str, edits: Column, text_col: str = "text") -> DataFrame:
    """Token counts before and after ``edits``, an array of struct(start int, deleted int, inserted string)."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col(text_col).alias("text"), edits.alias("edits"))
    return rows.mapInArrow(_count(tokenizer_path), OUT)


def sample_edits(text: Column) -> Column:
    """Three edits of every text: an insertion in the middle, a deletion at a third, and a new end."""
    n = F.length(F.coalesce(text, F.lit("")))

    def one(start: Column, deleted: int, inserted: str) -> Column:
        return F.struct(start.cast("int").alias("start"), F.lit(deleted).alias("deleted"), F.lit(inserted).alias("inserted"))

    return F.array(one(F.floor(n / 2), 0, " reviewed"), one(F.floor(n / 3), 7, ""), one(F.greatest(n - 3, F.lit(0)), 12, "n't it?\n"))
