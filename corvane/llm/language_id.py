"""Language identification by nearest centroid.

A text is a normalised TF-IDF vector of hashed byte n-grams (orders 1 to 3, A-Z lower-cased, ASCII
other than letters as blank). Each language has several centroids, found by spherical k-means, and a
text gets the language of the centroid with the largest cosine. A text is rejected when it has no
letter, or when its cosine is below the language's own bound: ``slack`` times a low quantile of the
cosines that training texts of that language have to their nearest centroid. Training texts have a letter.

The model is fitted on at most ``per_language`` labelled texts of each language (those with the
smallest hash of doc_id): a bounded, documented sample. Prediction reads every whole text, map-side.

Defined results: null text or text without a letter gives ``und`` with score 0, rejected; with no
labelled row every text does; repeated rows are predicted alike; of equal cosines the first language
in order wins; lang, source and doc_id are never inputs of a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DIM = 4096
LETTER = r"\p{L}"
WINDOW = 1 << 19  # bytes counted at once
_CODE = np.arange(256, dtype=np.uint32)
_CODE[:128] = 32
_CODE[97:123] = np.arange(97, 123)
_CODE[65:91] = np.arange(97, 123)


def _slots(codes: np.ndarray, order: int) -> np.ndarray:
    """Slot of the n-gram that starts at each position."""
    h = np.full(len(codes) - order + 1, 2166136261 + order, np.uint32)
    for k in range(order):
        h = (h ^ codes[k : len(codes) - order + 1 + k]) * np.uint32(16777619)
    h ^= h >> np.uint32(15)
    return (h * np.uint32(2246822519) >> np.uint32(20)).astype(np.int64)


def _count_short(texts: list[bytes]) -> np.ndarray:
    n = np.array([len(t) for t in texts])
    codes = _CODE[np.frombuffer(b"".join(texts), np.uint8)]
    doc = np.repeat(np.arange(len(texts)), n)
    out = np.zeros((len(texts), DIM))
    for order in (1, 2, 3):
        if len(codes) >= order:
            inside = doc[: len(codes) - order + 1] == doc[order - 1 :]
            flat = (doc[: len(codes) - order + 1] * DIM + _slots(codes, order))[inside]
            out += np.bincount(flat, minlength=out.size).reshape(out.shape)
    return out


def ngram_counts(texts: list[bytes]) -> np.ndarray:
    """Counts of hashed n-grams, a row per text; long texts are counted window by window."""
    out, block, size = [], [], 0
    for t in texts:
        if len(t) > WINDOW or size + len(t) > WINDOW or len(block) >= 64:
            if block:
                out.append(_count_short(block))
            block, size = [], 0
        if len(t) > WINDOW:
            total = np.zeros((1, DIM))
            for s in range(0, len(t), WINDOW):
                total += _count_short([t[s : s + WINDOW + 2]])
                if s + WINDOW < len(t):  # what both windows hold
                    total -= _count_short([t[s + WINDOW : s + WINDOW + 2]])
            out.append(total)
        else:
            block.append(t)
            size += len(t)
    if block:
        out.append(_count_short(block))
    return np.vstack(out) if out else np.zeros((0, DIM))


@dataclass
class CentroidModel:
    langs: list[str]  # of each centroid
    centroids: np.ndarray  # rows of length 1
    idf: np.ndarray
    bound: np.ndarray  # of each centroid's language

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        out = np.empty(counts.shape, np.float32)
        for k in range(0, len(counts), 256):  # few rows in double precision at a time
            v = (np.log1p(counts[k : k + 256]) * self.idf).astype(np.float32)
            out[k : k + 256] = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        return out

    def predict(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest centroid, and its cosine."""
        cosines = self.vectors(counts) @ self.centroids.T
        best = cosines.argmax(1)
        return best, np.clip(cosines[np.arange(len(best)), best].astype(np.float64), 0, 1)


def _spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    first = x.sum(0)
    chosen = [first / max(np.linalg.norm(first), 1e-12)]
    while len(chosen) < min(k, len(x)):  # the farthest from those chosen
        chosen.append(x[np.max(np.stack([x @ c for c in chosen]), 0).argmin()])
    c = np.stack(chosen)
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        for j in range(len(c)):
            total = x[near == j].sum(0)
            if (norm := np.linalg.norm(total)) > 0:
                c[j] = total / norm
    return c


LOW = 0.01  # share of a language's training texts that may lie below what its bound is taken from


def fit_centroids(counts: np.ndarray, langs: list[str], per_language: int = 4, slack: float = 0.5) -> CentroidModel:
    df = np.count_nonzero(counts > 0, 0)
    idf = np.log((1 + len(counts)) / (1 + df)) + 1
    model = CentroidModel([], np.zeros((0, DIM), np.float32), idf, np.zeros(0))
    names = np.array(langs)
    for lang in sorted(set(langs)):  # the driver holds the vectors of one language at a time
        mine = model.vectors(counts[names == lang])
        c = _spherical_kmeans(mine, per_language)
        model.langs += [lang] * len(c)
        model.centroids = np.vstack([model.centroids, c.astype(np.float32)])
        model.bound = np.concatenate([model.bound, np.full(len(c), slack * float(np.quantile((mine @ c.T).max(1), LOW)))])
    return model


def held_out(doc_id: Column, parts: int, which: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == which, F.lit(False))


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for i in range(0, whole.num_rows, 256):
            b = whole.slice(i, 256)
            counts = ngram_counts([t or b"" for t in b.column("text").cast(pa.binary()).to_pylist()])
            at = [np.flatnonzero(r) for r in counts]
            yield pa.RecordBatch.from_arrays(
                [b.column("lang"), pa.array([a.astype(np.uint16).tobytes() for a in at]), pa.array([r[a].astype(np.float32).tobytes() for r, a in zip(counts, at, strict=True)])],
                ["lang", "at", "n"],
            )


def train_language_id(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", per_language: int = 800, centroids: int = 4, slack: float = 0.5) -> CentroidModel:
    """Fit on at most ``per_language`` rows of ``docs`` for each label."""
    usable = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col("doc_id")).alias("_h")).filter(F.col("lang").isNotNull() & F.col("text").rlike(LETTER))
    # the smallest hashes of each label: first within 64 parts of it, then among what those leave
    ranked = usable.select("lang", "_h").distinct()
    for parts in ([F.col("lang"), F.pmod("_h", F.lit(64))], [F.col("lang")]):
        ranked = ranked.withColumn("_r", F.row_number().over(W.partitionBy(*parts).orderBy("_h"))).filter(F.col("_r") <= per_language).drop("_r")
    cutoff = {r["lang"]: r["h"] for r in ranked.groupBy("lang").agg(F.max("_h").alias("h")).collect()}  # a row per language
    if not cutoff:
        return CentroidModel([], np.zeros((0, DIM), np.float32), np.ones(DIM), np.zeros(0))
    limits = F.create_map(*[F.lit(x) for pair in sorted(cutoff.items()) for x in pair])
    # one row of those that share a hash (repeated or null ids), so that what is collected is bounded
    sample = usable.filter(F.col("_h") <= limits[F.col("lang")]).groupBy("lang", "_h").agg(F.min("text").alias("text")).select("lang", "text")
    rows = sample.mapInArrow(_sparse, "lang string, at binary, n binary").collect()
    rows = sorted(rows, key=lambda r: (r["lang"], bytes(r["at"]), bytes(r["n"])))
    counts = np.zeros((len(rows), DIM), np.float32)
    for row, r in zip(counts, rows, strict=True):
        row[np.frombuffer(r["at"], np.uint16)] = np.frombuffer(r["n"], np.float32)
    return fit_centroids(counts, [r["lang"] for r in rows], centroids, slack)


def _predict(model: CentroidModel, columns: list[str], names: tuple[str, str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                b = whole.slice(i, 256)
                lettered = b.column("_corvane_lettered").to_numpy(zero_copy_only=False)
                if model.langs:
                    counts = ngram_counts([t or b"" for t in b.column("_corvane_text").cast(pa.binary()).to_pylist()])
                    best, score = model.predict(counts)
                    lang = np.array(model.langs, object)[best]
                    rejected = ~lettered | (score < model.bound[best])
                    lang[~lettered], score[~lettered] = "und", 0.0
                else:
                    lang, score, rejected = np.full(b.num_rows, "und", object), np.zeros(b.num_rows), np.ones(b.num_rows, bool)
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in columns], pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], [*columns, *names])

    return run


def identify(docs: DataFrame, model: CentroidModel, keep: list[str], text_col: str = "text", names: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """Columns ``keep`` of ``docs`` and, under ``names``, the language, its cosine and whether the text is rejected."""
    lettered = F.coalesce(F.col(text_col).rlike(LETTER), F.lit(False))
    rows = docs.select(*keep, F.col(text_col).alias("_corvane_text"), lettered.alias("_corvane_lettered"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return rows.mapInArrow(_predict(model, keep, names), f"{kinds}, `{names[0]}` string, `{names[1]}` double, `{names[2]}` boolean")
