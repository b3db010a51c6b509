"""Words and word shingles of whole texts as 64-bit hashes, by numpy over the bytes of many texts.

A word is ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. Separators are single bytes, so UTF-8 needs no
decoding. A word is read eight bytes at a time: each step is a 64-bit bijection with full avalanche of what
was before and the next eight bytes, and the length comes last. So work goes by words rather than bytes, equal
words have equal hashes, different words of one length up to eight bytes never meet, and others meet as random
64-bit numbers do. A word of more than LONG bytes is hashed by BLAKE2.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WINDOW = 1 << 18  # bytes hashed at once
LONG = 64
_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240501))
_MUL = _rng.integers(0, 1 << 64, 64, dtype=np.uint64) | _U(1)
_BASE = 0x9E3779B97F4A7C15
_FOLD = bytes(32 if 9 <= k <= 13 else k + 32 if 65 <= k <= 90 else k for k in range(256))  # separators to one of them
_SEP = frozenset(b" \t\n\v\f\r")
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # of so many first bytes


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _window_words(buf: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in ``buf``, which ends with a separator, and where they start."""
    buf = buf.translate(_FOLD)
    end = np.flatnonzero(np.frombuffer(buf, np.uint8) == 32)
    start = np.concatenate([[0], end[:-1] + 1])
    n = end - start
    if len(n) and not n.all():
        start, end, n = start[n > 0], end[n > 0], n[n > 0]
    eight = np.ndarray(len(buf), "<u8", buf + bytes(8), strides=(1,))  # the eight bytes from each place
    h = mixed(_U(_BASE) ^ (eight[start] & _MASK[np.minimum(n, 8)]))
    rows, at = np.flatnonzero((n > 8) & (n <= LONG)), 8
    while len(rows):
        h[rows] = mixed(h[rows] ^ (eight[start[rows] + at] & _MASK[np.minimum(n[rows] - at, 8)]))
        at += 8
        rows = rows[n[rows] > at]
    for k in np.flatnonzero(n > LONG).tolist():
        h[k] = int.from_bytes(hashlib.blake2b(buf[start[k] : end[k]], digest_size=8).digest(), "little")
    return mixed(h + n.astype(np.uint64) * _U(_BASE)), start


def blocks(batch: pa.RecordBatch, column: str = "text", rows: int = 512, size: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Runs of rows with about ``size`` bytes of text at most (or one row), and their texts; a null text is empty."""
    texts = batch.column(column).cast(pa.large_binary())
    edges = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))])
    at = 0
    while at < batch.num_rows:
        stop = min(at + rows, max(at + 1, int(np.searchsorted(edges, edges[at] + size, "right")) - 1))
        yield batch.slice(at, stop - at), [t or b"" for t in texts.slice(at, stop - at).to_pylist()]
        at = stop


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, one after the other, and the edges between texts (one more than texts)."""
    hashes, counts, block, size = [], [], [], 0

    def flush() -> None:
        if block:
            n = np.array([len(t) + 1 for t in block])
            h, start = _window_words(b" ".join(block) + b" ")
            hashes.append(h)
            counts.extend(np.diff(np.searchsorted(start, np.concatenate([[0], np.cumsum(n)]))).tolist())
            block.clear()

    for t in texts:
        if size + len(t) > WINDOW:
            flush()
            size = 0
        if len(t) <= WINDOW:
            block.append(t)
            size += len(t) + 1
            continue
        at, n = 0, 0  # a long text, window by window, cut between words
        while at < len(t):
            end = min(at + WINDOW, len(t))
            while end < len(t) and t[end] not in _SEP:
                end += 1
            h, _ = _window_words(t[at:end] + b" ")
            hashes.append(h)
            n += len(h)
            at = end
        counts.append(n)
    flush()
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's k-word shingles; the whole sequence of a shorter text is one; no words, none."""
    flat, edges = shingle_runs(texts, k)
    edges = edges.tolist()
    return [flat[s:e] for s, e in zip(edges[:-1], edges[1:], strict=True)]


def shingle_runs(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """:func:`shingle_sets` one after the other, and the edges between them (one more than texts)."""
    w, edges = words_of(texts)
    words = np.diff(edges)
    n = len(w) - k + 1
    rolled = np.zeros(len(w), np.uint64)  # of the k words from each place; of those that a text has, at its start, if they are fewer
    for j in range(k if n > 0 else 0):
        rolled[:n] += w[j : j + n] * _MUL[j]
    rolled[: max(n, 0)] = mixed(rolled[: max(n, 0)])
    for t in np.flatnonzero((words > 0) & (words < k)).tolist():
        s, e = edges[t], edges[t + 1]
        length = np.array([e - s], np.uint64) * _MUL[-1]
        rolled[s] = mixed(length + (w[s:e] * _MUL[: e - s]).sum(dtype=np.uint64))[0]
    size = np.where(words >= k, words - k + 1, np.minimum(words, 1))
    stop = edges[:-1] + size
    for s, e in zip(edges[:-1].tolist(), stop.tolist(), strict=True):
        rolled[s:e].sort()
    keep = np.ones(len(rolled), bool)
    keep[1:] = rolled[1:] != rolled[:-1]
    keep[edges[:-1][words > 0]] = True
    marks = np.zeros(len(rolled) + 1, np.int64)  # places past a text's last shingle go
    np.add.at(marks, edges[:-1], 1)
    np.add.at(marks, stop, -1)
    keep &= np.cumsum(marks[:-1]) > 0
    return rolled[keep], np.concatenate([[0], np.cumsum(keep)])[edges]
