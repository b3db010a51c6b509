"""Language-model scoring with a log-bilinear neural model, trained in numpy by noise-contrastive estimation.

Counts come from all training texts: of every word, and of every pair of neighbouring classes. A class is one of
the most frequent words, the end of a text, or "other". The model is s(w | h) = (R[h] C) . Q[w] + b[w]; it
learns to tell the counted pairs, in whole passes, from pairs with a word drawn from the unigram distribution.
Scoring takes one matrix product for the distinct contexts of a batch and normalises its rows, so
every token has a proper log-probability; words under "other" share its probability by their smoothed
counts.

Scale: word counts are summed map-side per batch. The counts of the more frequent words (at most HEAD, a
bounded table) go to every worker; all rarer and unknown words of a text meet their counts in a join on the
word's hash. Texts are never shuffled.

Defined results: a null text is empty and has the end token alone; with no training text every base
probability is 1 and the model is uniform; repeated rows are scored each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import staged
from .words import words_of

HEAD = 1 << 19  # words whose counts every worker holds, at most
CLASSES = 1024
OTHER, END = 0, 1
SLICE = 512


@dataclass
class LogBilinear:
    """``context`` (R), ``mix`` (C), ``target`` (Q) and ``bias`` (b)."""

    context: np.ndarray
    mix: np.ndarray
    target: np.ndarray
    bias: np.ndarray

    def log_probs(self, contexts: np.ndarray) -> np.ndarray:
        """Natural log-probabilities of all classes after each of ``contexts``: a batched product, normalised."""
        s = ((self.context[contexts] @ self.mix) @ self.target.T + self.bias).astype(np.float64)
        s = s - s.max(1, keepdims=True)
        return s - np.log(np.exp(s).sum(1, keepdims=True))


def shares(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Visits of each pair in a pass, at most twice as many as there are pairs, and the weight of one; visits times weight is the count over the mean count."""
    each = counts / counts.mean()
    visits = np.ceil(each).astype(np.int64)
    return visits, (each / np.maximum(visits, 1)).astype(np.float32)


def _passes(visits: np.ndarray, batch: int, steps: int, rng: np.random.Generator) -> Iterator[np.ndarray]:
    """Places of the pairs in each batch, until a pass is over and there were ``steps`` batches."""
    done = 0
    while done < steps:
        order = rng.permutation(np.repeat(np.arange(len(visits), dtype=np.int32), visits))
        for i in range(0, len(order), batch):
            yield order[i : i + batch]
            done += 1


def train_nce(pairs: np.ndarray, counts: np.ndarray, classes: int, dim: int = 32, noise: int = 16, pool: int = 256, batch: int = 2048, steps: int = 600, rate: float = 0.1, seed: int = 7) -> LogBilinear:
    """Fit on ``pairs`` (previous, next) that occur ``counts`` times; deterministic for equal input.

    Whole passes over all pairs in random order, as many as it takes for at least ``steps`` steps. A pass meets a pair
    once for each mean count it has, rounded up, and these visits share its count as their weight.
    Each pair is set against ``noise`` words, estimated from ``pool`` words that a batch shares.
    """
    rng = np.random.Generator(np.random.PCG64(seed))
    seen = np.bincount(pairs[:, 1], weights=counts, minlength=classes) + 0.5
    unigram = seen / seen.sum()
    m = LogBilinear(rng.normal(0, 0.1, (classes, dim)), np.eye(dim), rng.normal(0, 0.1, (classes, dim)), np.log(unigram))
    if not len(pairs):
        return LogBilinear(m.context * 0, m.mix, m.target * 0, m.bias * 0)
    m = LogBilinear(*[p.astype(np.float32) for p in (m.context, m.mix, m.target, m.bias)])
    sums = [np.full_like(p, 1e-8) for p in (m.context, m.mix, m.target, m.bias)]
    heads = np.cumsum(unigram)
    visits, weights = shares(counts)
    log_noise = np.log(noise * unigram).astype(np.float32)

    def step(p: np.ndarray, g: np.ndarray, s: np.ndarray, rows: np.ndarray | None = None) -> None:
        if rows is not None:  # sum what falls on the same row
            at, inverse = np.unique(rows, return_inverse=True)
            order = np.argsort(inverse, kind="stable")
            g = np.add.reduceat(g[order], np.searchsorted(inverse[order], np.arange(len(at))))
            s[at] += g * g
            p[at] += (rate * g / np.sqrt(s[at])).astype(np.float32)
        else:
            s += g * g
            p += (rate * g / np.sqrt(s)).astype(np.float32)

    for at in _passes(visits, batch, steps, rng):
        h, w, weight = pairs[at, 0], pairs[at, 1], weights[at]
        words = np.concatenate([w, np.minimum(np.searchsorted(heads, rng.random(pool)), classes - 1)])
        # each pair is told apart from its own word and from the shared noise words
        r = m.context[h]
        v = r @ m.mix
        q = m.target[words]
        true = (v * q[: len(at)]).sum(1) + m.bias[w] - log_noise[w]
        fake = v @ q[len(at) :].T + m.bias[words[len(at) :]] - log_noise[words[len(at) :]]
        g_true = weight / (1 + np.exp(np.clip(true, -30, 30)))
        g_fake = -(noise / pool) * weight[:, None] / (1 + np.exp(-np.clip(fake, -30, 30)))
        g_v = g_true[:, None] * q[: len(at)] + g_fake @ q[len(at) :]
        g_q = np.concatenate([g_true[:, None] * v, g_fake.T @ v])
        g_b = np.concatenate([g_true, g_fake.sum(0)])
        g_mix = r.T @ g_v
        step(m.context, g_v @ m.mix.T, sums[0], h)
        step(m.mix, g_mix / len(at), sums[1])
        step(m.target, g_q, sums[2], words)
        step(m.bias, g_b / 16, sums[3], words)
    return m


def _texts(b: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in b.column("text").cast(pa.binary()).to_pylist()]


def _summed(keys: list[np.ndarray], names: tuple[str, str], counts: list[np.ndarray] | None = None) -> pa.RecordBatch:
    flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
    at, n = np.unique(flat, return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(n.astype(np.int64))], list(names))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        yield _summed([words_of(_texts(whole.slice(i, SLICE)))[0].view(np.int64) for i in range(0, whole.num_rows, SLICE)], ("h", "c"))


@dataclass
class Lexicon:
    """Counts and classes of the more frequent words, by sorted hash."""

    hashes: np.ndarray
    counts: np.ndarray
    classes: np.ndarray

    def look(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash, or -1."""
        if not len(self.hashes):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, at, -1)

    def class_of(self, at: np.ndarray) -> np.ndarray:
        return np.where(at >= 0, self.classes[at], OTHER) if len(self.classes) else np.full(len(at), OTHER)


def _chain(cls: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(previous, next) classes of all tokens of all texts; each text begins after an end and closes with one."""
    n = np.diff(edges)
    seq = np.insert(cls, edges[1:], END)
    prev = np.empty_like(seq)
    prev[1:] = seq[:-1]
    if len(seq):
        prev[0] = END
    assert len(seq) == n.sum() + len(n)
    return prev, seq


def _count_pairs(lexicon: Lexicon, classes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            codes = []
            for i in range(0, whole.num_rows, SLICE):
                h, edges = words_of(_texts(whole.slice(i, SLICE)))
                prev, nxt = _chain(lexicon.class_of(lexicon.look(h.view(np.int64))), edges)
                codes.append(prev.astype(np.int64) * classes + nxt)
            yield _summed(codes, ("pair", "n"))

    return run


def _score(lexicon: Lexicon, model: LogBilinear, end_count: int):
    kinds = [("rid", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("model", pa.float64()), ("n_other", pa.int64()), ("rare", pa.list_(pa.int64()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, SLICE):
                b = whole.slice(i, SLICE)
                h, edges = words_of(_texts(b))
                h = h.view(np.int64)
                at = lexicon.look(h)
                cls = lexicon.class_of(at)
                prev, nxt = _chain(cls, edges)
                contexts, inverse = np.unique(prev, return_inverse=True)
                logp = model.log_probs(contexts)[inverse, nxt] / np.log(10)
                ends = edges[1:] + np.arange(1, len(edges))  # of each text among all tokens
                # each text is summed on its own: running sums over a batch would lose digits
                score = np.array([logp[s:e].sum() for s, e in zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist(), strict=True)])
                known = at >= 0
                smooth = np.where(known, np.log10((lexicon.counts[at] if len(lexicon.counts) else np.zeros(len(at))) + 0.5), 0.0)
                other = cls == OTHER
                base, n_known, n_other, rare = [], [], [], []
                for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    k, o, x = known[s:e], other[s:e], smooth[s:e]
                    base.append(float(x.sum()))
                    n_known.append(int(k.sum()))
                    n_other.append(int(o.sum()))
                    rare.append(h[s:e][~k])
                    score[len(base) - 1] += float(x[o & k].sum())
                n = np.diff(edges) + 1
                base = np.array(base) + np.log10(end_count + 0.5)
                edge = np.concatenate([[0], np.cumsum([len(r) for r in rare])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(edge), pa.array(np.concatenate(rare) if rare else np.zeros(0, np.int64)))
                arrays = [b.column("rid"), b.column("doc_id"), b.column("held_out"), pa.array(n.astype(np.int64)), pa.array(np.array(n_known) + (end_count > 0)), pa.array(base), pa.array(score), pa.array(np.array(n_other, np.int64)), lists]
                yield pa.RecordBatch.from_arrays([a.cast(k) for a, (_, k) in zip(arrays, kinds, strict=True)], [x for x, _ in kinds])

    return run


def score_texts(docs: DataFrame, train: Column, text_col: str = "text", head: int = HEAD, classes: int = CLASSES, **fit: object) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out (not ``train``), n_tokens, n_known, train_tokens, base_score, score, both in log10."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).alias("text"), (~train).alias("held_out"))
    learn = rows.filter(~F.col("held_out")).select("text")
    n_ends = learn.count()
    words = staged(learn.mapInArrow(_count_words, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")))
    size = words.agg(F.sum("c"), F.count(F.lit(1))).first()
    n_words, n_distinct = size[0] or 0, size[1]
    tokens, distinct = n_words + n_ends, n_distinct + (n_ends > 0)

    # the most frequent words that fit the head: bands of counts, a bounded number, and of the band that doesn't fit the smallest hashes
    band = F.floor(F.log2("c") * 16)
    bands = words.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n")).collect()
    least, room = 1 << 20, head
    for r in sorted(bands, key=lambda r: -r["band"]):
        if r["n"] > room:
            break
        room, least = room - r["n"], r["band"]
    part = words.filter(band == max((r["band"] for r in bands if r["band"] < least), default=-1)).orderBy("h").limit(room)
    top = words.filter(band >= least).unionByName(part).toArrow()
    h, c = top.column("h").to_numpy(), top.column("c").to_numpy()
    order = np.argsort(h)
    h, c = h[order], c[order]
    best = np.lexsort((h, -c))[: classes - 2]
    ids = np.zeros(len(h), np.int32)
    ids[best] = np.arange(2, 2 + len(best))
    lexicon = Lexicon(h, c, ids)

    pairs = learn.mapInArrow(_count_pairs(lexicon, classes), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()  # at most classes ** 2 rows
    code, n = pairs.column("pair").to_numpy(), pairs.column("n").to_numpy()
    order = np.argsort(code)
    code, n = code[order], n[order]
    model = train_nce(np.stack([code // classes, code % classes], 1), n.astype(float), classes, **fit)
    # words that are no class of their own: what "other" is shared among
    others = np.log10((n_words - int(c[best].sum())) + 0.5 * (n_distinct - len(best) + 1))

    scored = rows.withColumn("rid", F.monotonically_increasing_id()).mapInArrow(
        _score(lexicon, model, n_ends), "rid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, model double, n_other long, rare array<long>"
    )
    scored = staged(scored)
    rare = scored.select("rid", F.explode("rare").alias("h")).groupBy("rid", "h").agg(F.count(F.lit(1)).alias("tf"))
    met = rare.join(words, "h", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    extra = met.groupBy("rid").agg(
        F.sum(F.col("tf") * F.log10(F.col("c") + 0.5)).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(F.lit(0))).alias("known")
    )
    more, total = F.coalesce("more", F.lit(0.0)), float(np.log10(tokens + 0.5 * (distinct + 1)))
    return scored.join(extra, "rid", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(int(tokens)).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * total).alias("base_score"),
        (F.col("model") + more - F.col("n_other") * float(others)).alias("score"),
    )
