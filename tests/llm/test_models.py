import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from corvane.llm.language_id import DIM, held_out, identify, ngram_counts, train_language_id
from corvane.llm import language_id as li
from corvane.llm.lm_scoring import LogBilinear, score_texts, shares, train_nce
from corvane.llm.nearest import nearest, usable_vectors

from .conftest import HARD, SF


def test_long_texts_are_counted_like_short_ones(monkeypatch):
    text = ("Straße über naïve words " * 50).encode()
    want = ngram_counts([text])
    monkeypatch.setattr(li, "WINDOW", 64)
    assert (ngram_counts([text]) == want).all() and want.shape == (1, DIM)


def test_language_id_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("held_out", held_out(F.col("doc_id"), 4, 2))
    model = train_language_id(docs.filter("not held_out"))
    rows = identify(docs, model, ["doc_id", "held_out", "lang"]).filter("held_out and lang_pred <> 'und'").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows) > 20
    assert sum(r.rejected for r in rows) <= 0.02 * len(rows)


def test_language_id_on_hard_rows(hard, empty):
    model = train_language_id(hard)
    got = identify(hard, model, ["doc_id", "score"], names=("lang_pred", "cosine", "rejected")).collect()
    assert len(got) == len(HARD)
    for r, h in zip(sorted(got, key=lambda r: r.doc_id or 0), sorted(HARD, key=lambda h: h[0] or 0), strict=True):
        assert 0 <= r.cosine <= 1
    lettered = {h[0]: bool(re.search(r"[^\W\d_]", h[1] or "")) for h in HARD if h[0] is not None}
    for r in got:
        if r.doc_id is not None:
            assert (r.lang_pred == "und") == (not lettered[r.doc_id]) == (r.cosine == 0.0) == r.rejected
    assert {r.lang_pred for r in identify(hard, train_language_id(empty), ["doc_id"]).collect()} == {"und"}
    assert identify(empty, model, ["doc_id"]).count() == 0


def test_texts_without_letters_and_outliers_leave_the_rejection_bound(spark):
    words = {"en": "the of and to in is that it was for", "fr": "le la les des une dans est que pour avec"}
    rows = [(i, " ".join(w[(i * k + j) % 10] for k in (1, 3, 7) for j in range(6)), lang) for i in range(200) for lang, s in words.items() for w in [s.split()]]
    kind = "doc_id long, text string, lang string"
    clean = train_language_id(spark.createDataFrame(rows, kind))
    blank = train_language_id(spark.createDataFrame([*rows, (900, "", "fr"), (901, "12 34", "fr"), (902, " ", "fr")], kind))
    assert (blank.bound == clean.bound).all() and (np.linalg.norm(blank.centroids, axis=1) > 0.99).all()
    odd = train_language_id(spark.createDataFrame([*rows, (900, "这是中文的一段文字", "fr")], kind), centroids=1)
    assert min(odd.bound) > 0.25
    far = spark.createDataFrame([(1, "x" * 200), (2, "я не знаю этого языка")], "doc_id long, text string")
    assert all(r.rejected for r in identify(far, blank, ["doc_id"]).collect())


def test_nce_learns_the_distribution_it_is_shown():
    rng = np.random.default_rng(5)
    p = rng.dirichlet(np.ones(20) * 0.3, 20)
    pairs = np.stack(np.meshgrid(np.arange(20), np.arange(20), indexing="ij"), -1).reshape(-1, 2)
    counts = np.round(p * 5000).ravel()
    model = train_nce(pairs[counts > 0], counts[counts > 0], 20)
    logp = model.log_probs(np.arange(20))
    assert np.allclose(np.exp(logp).sum(1), 1)
    unigram = np.bincount(pairs[:, 1], weights=counts)
    unigram = unigram / unigram.sum()
    best, flat, got = (-(p * np.log(q + 1e-9)).sum() / 20 for q in (p, np.tile(unigram, (20, 1)), np.exp(logp)))
    assert got - best < 0.35 * (flat - best)
    assert isinstance(train_nce(pairs[:0], counts[:0], 20), LogBilinear)


def test_training_meets_every_pair_with_its_whole_count():
    counts = np.array([1.0, 1, 2, 7, 1000, 50_000, 1])
    visits, weight = shares(counts)
    assert visits.min() >= 1 and visits.sum() <= 2 * len(counts) and weight.max() <= 1
    assert np.allclose(visits * weight, counts / counts.mean())
    n = 300  # two steps hold 16 of these pairs; the pass goes on until every context has been met
    pairs = np.stack([np.arange(n), np.arange(n)[::-1]], 1)
    model = train_nce(pairs, np.ones(n), n, batch=8, steps=2)
    start = np.random.Generator(np.random.PCG64(7)).normal(0, 0.1, (n, 32)).astype(np.float32)
    assert (np.abs(model.context - start).max(1) > 0).all()


def test_scores_match_counts_and_beat_the_base(spark, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    docs = docs.union(spark.createDataFrame([(900_001, None, "x"), (900_002, "", "x"), (900_003, "Zzyzx unseen ZZYZX", "x")], docs.schema))
    src = [(r.doc_id, re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))) for r in docs.collect()]
    out = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in src}
    c = Counter(w for i, ws in src if not out[i] for w in [*ws, 0])
    n, v = sum(c.values()), len(c)
    for head in (1 << 19, 40):  # with few known to the workers, most counts come from the join
        got = score_texts(docs, ~held_out(F.col("doc_id"), 5, 1), head=head, classes=32, steps=150).collect()
        assert len(got) == len(src)
        rows = {r.doc_id: r for r in got}
        for i, ws in src:
            r, tokens = rows[i], [*ws, 0]
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[i], len(tokens), sum(c[w] > 0 for w in tokens), n)
            assert math.isclose(r.base_score, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens), rel_tol=1e-9)
            assert math.isfinite(r.score) and r.score < 0
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert score_texts(empty, F.lit(True), classes=32).count() == 0


def test_recall_on_embeddings_in_one_shard_and_in_several(spark, monkeypatch):
    from corvane.llm import nearest as ne

    rows = usable_vectors(spark.read.parquet(f"{SF}/../sf0.1/embeddings.parquet"))
    x = {r.vec_id: np.array(r.vector) for r in rows.collect()}
    ids, m = np.array(sorted(x)), np.stack([x[i] for i in sorted(x)])
    for shard in (8192, 300):
        monkeypatch.setattr(ne, "SHARD", shard)
        found = {}
        for r in nearest(rows.withColumn("rank", F.lit("taken")), rows.filter("vec_id % 100 = 0")).collect():
            found.setdefault(r.query_id, set()).add(r.vec_id)
        hits = 0
        for q, got in found.items():
            d = np.sqrt(((m - x[q]) ** 2).sum(1))
            d[ids == q] = np.inf
            hits += len(got & set(ids[np.lexsort((ids, d))[:10]].tolist()))
        assert len(found) == 20 and hits >= 0.95 * 200


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 16)) + 4 * rng.normal(size=(12, 16))[rng.integers(0, 12, 900)]
    x[500:540] = x[500]  # copies: ties go to the smaller id
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(1000, None), (1100, [0.0] * 16), (1200, [None] + [1.0] * 15), (1300, [float("nan")] + [1.0] * 15), (1400, [float("inf")] + [1.0] * 15), (1500, [1.0, 2.0]), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>")
    use = usable_vectors(df)
    assert use.count() == 900
    got = nearest(use, use.filter("vec_id % 20 = 0")).collect()
    found = {}
    for r in got:
        assert math.isclose(r.score, math.sqrt(((x[r.query_id] - x[r.vec_id]) ** 2).sum()), rel_tol=1e-12)
        found.setdefault(r.query_id, {})[r.rank] = r.vec_id
    hits = 0
    for q in range(0, 900, 20):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(900), d))[:10]
        assert sorted(found[q]) == list(range(1, 11))
        hits += len(set(want.tolist()) & set(found[q].values()))
    assert hits >= 0.9 * 450
    assert [found[500][k] for k in range(1, 11)] == list(range(501, 511))
    few = use.filter("vec_id < 4")
    assert nearest(few, few.filter("vec_id = 0")).count() == 3
    assert nearest(use.limit(0), use.limit(0)).count() == 0
    assert usable_vectors(df.limit(0)).count() == 0

