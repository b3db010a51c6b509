import random
from collections import Counter

from corvane.llm import queries as q

from .test_dedup_and_join import brute, lowered

import corpus_pipeline


def test_every_operator_has_a_query():
    assert sorted(int(k[2:].split("_")[0]) for k in q.queries()) == list(range(1, 11))
    assert set(q.oracle_sql()) <= set(q.queries())


def test_stages_keep_what_they_should(spark, empty):
    rnd = random.Random(6)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "ter") for b in ("na", "sun", "dor", "pel", "vi")]
    rows = []
    for i in range(0, 240, 2):
        text = " ".join(rnd.choice(words) for _ in range(40))
        rows.append((i, text, "en", f"s{i % 5}", 1))
        if i % 20 == 0:
            rows.append((i + 1, text.upper() if i % 40 else text + " tail", "en", "s1", 1))
    rows += [(1001, "123 456", "en", "s1", 1), (1002, None, "en", "s1", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = docs
    sizes = []
    for name, stage in corpus_pipeline.STAGES[:3]:
        kept = stage(spark, kept, None)
        assert kept.columns == docs.columns, name
        sizes.append({r.doc_id: r.text for r in kept.collect()})
    lettered = {r[0]: r[1] for r in rows if r[0] < 1000}
    assert sizes[0] == lettered
    last = {}
    for i in sorted(lettered):
        last[lowered(lettered[i])] = i
    assert set(sizes[1]) == set(last.values())
    assert set(sizes[2]) == {i for i, _, c in brute(sorted(sizes[1].items())) if i == c}
    mixed = corpus_pipeline.mix(spark, kept, None)
    assert mixed.columns == docs.columns
    assert {r.doc_id for r in mixed.collect()} <= set(sizes[2])
    packed = corpus_pipeline.pack(spark, mixed, None).collect()
    assert Counter(r.doc_id for r in packed) == Counter(r.doc_id for r in mixed.collect())
    none = empty.selectExpr("doc_id", "text", "lang", "source", "n as n_chars")
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, None)
    assert none.count() == 0
