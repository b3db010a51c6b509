import hashlib
import random
import re
from collections import defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from corvane.llm import ngram_join as nj
from corvane.llm.components import components
from corvane.llm.exact_dedup import drop_exact_copies, exact_dedup

from .conftest import HARD


def lowered(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def test_exact_dedup_matches_brute_force_also_when_every_hash_clashes(spark):
    rnd = random.Random(2)
    rows = [(i, "".join(rnd.choice("aAbBé ") for _ in range(rnd.choice([0, 1, 2, 3, 7, 8, 9, 40])))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    groups = defaultdict(list)
    for i, t in rows:
        groups[lowered(t)].append(i)
    want = {(i, max(v), len(v), i == max(v), hashlib.sha256(t.encode()).hexdigest()) for t, v in groups.items() for i in v}
    assert {tuple(r) for r in exact_dedup(docs, block_bytes=4).collect()} == want
    clash = exact_dedup(docs, block_bytes=4, block_hash=lambda b: F.length(b).cast("long"))
    assert {tuple(r) for r in clash.collect()} == want


def test_exact_dedup_on_hard_rows(spark, hard, empty):
    rows = exact_dedup(hard).collect()
    assert len(rows) == len(HARD)
    fox = [r for r in rows if r.doc_id in (1, 2)]
    assert [r.keep_id for r in fox] == [2, 2, 2] and [r.group_size for r in fox] == [3, 3, 3] and sum(r.kept for r in fox) == 1
    blank = [r for r in rows if r.text_sha256 == hashlib.sha256(b"").hexdigest()]
    assert {r.doc_id for r in blank} == {None, 3, 4} and {r.keep_id for r in blank} == {4}
    kept = drop_exact_copies(hard)
    assert kept.columns == hard.columns and kept.count() == len({lowered(r[1]) for r in HARD})
    assert exact_dedup(empty).count() == 0 and drop_exact_copies(empty).count() == 0


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(10, 60)] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    got = {r.id: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 10 for i in range(10, 61)}, **{i: 100 for i in range(100, 140)}}


def brute(rows):
    sets = []
    for i, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", lowered(t))
        sets.append((i, frozenset(tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))) if w else frozenset()))
    top = {i: i for i, _ in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                u, v = find(i), find(j)
                top[max(u, v)] = min(u, v)
    return sorted((i, len(x), find(i)) for i, x in sets)


def copies(seed, n=300):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(150)]
    bases = [[rnd.choice(words) for _ in range(rnd.choice([3, 8, 20, 40, 90]))] for _ in range(15)]
    passage, rows = [rnd.choice(words) for _ in range(30)], []
    for k in range(n):
        w = list(rnd.choice(bases))
        for _ in range(rnd.choice([0, 0, 1, 2, 3, 5])):
            p = rnd.randrange(len(w))
            w[p : p + rnd.choice([0, 1, 2])] = [rnd.choice(words)]
        if rnd.random() < 0.3:
            w = w[: rnd.randint(0, len(w))] + passage + [rnd.choice(words) for _ in range(rnd.choice([5, 10, 15, 60]))]
        rows.append((k * 3 + 1, " ".join(w)))
    return rows


def test_ngram_components_match_brute_force(spark, monkeypatch):
    rows = [*copies(5), (5000, None), (5001, ""), (5002, " \n"), (5003, "A b"), (5004, "a  B"), (7000, "x " * 9000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute(rows)
    monkeypatch.setattr(nj, "FREQUENT_FROM", 8)
    monkeypatch.setattr(nj, "TILE", 32)
    assert sorted(map(tuple, nj.ngram_components(docs).collect())) == want
    monkeypatch.setattr(nj, "LOCAL", 60)  # two levels of stars
    monkeypatch.setattr(nj, "BROADCAST_IDS", 0)
    assert sorted(map(tuple, nj.ngram_components(docs).collect())) == want


def test_ngram_components_on_hard_rows(spark, hard, empty):
    rows = nj.ngram_components(hard).collect()
    assert len(rows) == len(HARD)
    assert {(r.doc_id, r.component_id) for r in rows if r.doc_id in (1, 2)} == {(1, 1), (2, 1)}
    assert {r.component_id for r in rows if r.doc_id is None} == {None}
    assert all(r.component_id == r.doc_id for r in rows if r.doc_id and r.doc_id > 2)
    assert nj.ngram_components(empty).count() == 0


def test_rtree_leaves_every_pair_that_may_link():
    import numpy as np

    rnd = np.random.default_rng(1)
    points = rnd.poisson(2, (500, nj.GROUPS)).astype(np.uint32)
    points[100:200] = points[:100] + (rnd.random((100, nj.GROUPS)) < 0.05)
    sizes = points.sum(1).astype(np.int64)
    tree = nj.CountVectorRTree(points, sizes)
    for i in range(0, 500, 7):
        want = np.flatnonzero(np.minimum(points, points[i]).sum(1) >= nj.needed(sizes, sizes[i]))
        assert sorted(tree.search(points[i], int(sizes[i]))) == want.tolist()


def test_a_repeated_doc_id_is_in_a_block_once():
    sig, doc = np.array([5] * 5 + [6] * 5, np.uint64), np.array([7, 7, 1, 2, 3, 8, 8, 1, 2, 3])
    part = pa.table({"bucket": [0], "salt": [0], "sigs": [sig.tobytes()], "docs": [doc.tobytes()]})
    got = nj._stars(False)(part).to_pylist()
    assert sorted((r["sig"], r["doc_id"]) for r in got if r["sig"] is not None) == [(5, 1), (5, 2), (5, 3), (5, 7), (6, 1), (6, 2), (6, 3), (6, 8)]


def test_a_block_that_needs_a_tree_yields_every_pair_its_points_leave():
    rnd = np.random.default_rng(4)
    base = rnd.integers(0, 1 << 63, 400).astype(np.uint64)
    sets = [np.unique(np.where(rnd.random(400) < rnd.choice([0.02, 0.1, 0.4]), rnd.integers(0, 1 << 63, 400).astype(np.uint64), base)) for _ in range(90)]
    n = len(sets)
    assert n > 3 * nj.FAN
    part = pa.table({
        "sig": [1] * n, "band": [0] * n, "doc_id": list(range(n)), "label": [k % 7 for k in range(n)], "chunk": [0] * n, "i": [0] * n, "j": [0] * n,
    })
    vectors = pa.table({"doc": list(range(n)), "n": [len(x) for x in sets], "vec": pa.array([nj.packed_point(x) for x in sets], pa.binary())})
    points = nj.Points(vectors.column("vec").to_pylist())
    x, y = np.triu_indices(n, 1)
    size = np.array([len(s) for s in sets])
    ok = (x % 7 != y % 7) & (points.bounds(x, y) >= nj.needed(size[x], size[y]))
    want = set(zip(x[ok].tolist(), y[ok].tolist(), strict=True))
    got = {(r["a"], r["b"]) for r in nj._across(part, vectors).to_pylist()}
    assert got == want and 0 < len(want) < len(x) // 2
    linked = {(a, b) for a, b in zip(x.tolist(), y.tolist(), strict=True) if a % 7 != b % 7 and 100 * len(i := np.intersect1d(sets[a], sets[b])) >= 75 * (len(sets[a]) + len(sets[b]) - len(i))}
    assert linked and linked <= want


def test_large_blocks_are_searched_in_bands_and_tiles(spark, monkeypatch):
    rows = copies(11, 200)
    monkeypatch.setattr(nj, "TILE", 6)
    got = nj.ngram_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_a_group_that_meets_in_many_blocks_has_a_row_for_each_document(spark):
    rnd = random.Random(7)
    blocks = {100 + s: [0, *(d for d in range(1, 25) if rnd.random() < 0.9)] for s in range(60)}  # a group, each block without some of it
    blocks |= {200 + s: [1000, 1001 + s] for s in range(40)}  # pairs that have one document in common
    blocks |= {300: list(range(2000, 2030)), 301: [2000, *range(2030, 2040)]}  # as one they'd have more pairs
    rows = [(s, d, d) for s, docs in blocks.items() for d in docs]
    entry = spark.createDataFrame(rows, "sig long, doc_id long, label long")
    points = spark.createDataFrame([(d, 10) for d in {d for _, d, _ in rows}], "doc_id long, n int")
    got = nj.tiled(entry, points).collect()
    tiles = defaultdict(set)
    for r in got:
        assert r.label == r.doc_id and r.lo == r.doc_id // 1000 * 1000 and r.doc_id not in tiles[r.sig, r.band, r.i, r.j]
        tiles[r.sig, r.band, r.i, r.j].add(r.doc_id)
    assert all(any({*docs} <= t for t in tiles.values()) for docs in blocks.values())
    assert sum(r.doc_id < 1000 for r in got) == 25
    assert sorted(len(t) for t in tiles.values() if min(t) >= 1000) == [2] * 40 + [11, 30]


def test_words_that_meet_under_powers_keep_apart():
    from corvane.llm.words import blocks, words_of

    turn = ["a", "b"]
    for _ in range(11):  # Thue-Morse words of 2048 letters and their complements
        turn = [turn[0] + turn[1], turn[1] + turn[0]]
    h, edges = words_of([f"{turn[0]} {turn[1]} {turn[0].upper()}".encode(), b"", b"x"])
    assert len(turn[0]) == 2048 and len(set(h.tolist())) == 3 and h[0] == h[2] and edges.tolist() == [0, 3, 3, 4]
    texts = ["a b", None, "c" * 50, "", "d"]
    got = [t for b, ts in blocks(pa.record_batch({"text": texts}).slice(1), size=10) for t in ts]
    assert got == [(t or "").encode() for t in texts[1:]]


def test_a_group_of_near_copies_gives_a_forest_of_links_and_no_pairs():
    rnd = np.random.default_rng(8)
    base = rnd.integers(0, 1 << 63, 300).astype(np.uint64)
    sets = [np.unique(np.where(rnd.random(300) < 0.08, rnd.integers(0, 1 << 63, 300).astype(np.uint64), base)) for _ in range(120)]
    n = len(sets)
    part = pa.table({"sig": [1] * n, "lo": [0] * n, "band": [0] * n, "doc_id": list(range(n)), "label": list(range(n)), "chunk": [0] * n, "i": [0] * n, "j": [0] * n})
    vectors = pa.table({"doc": list(range(n)), "n": [len(x) for x in sets], "vec": pa.array([nj.packed_point(x) for x in sets], pa.binary())})
    near = nj._met(part, vectors)
    assert near.num_rows <= n < nj._across(part, vectors).num_rows // 10
    got = nj._joined(near, pa.table({"doc": list(range(n)), "members": pa.array([x.tobytes() for x in sets], pa.binary())})).to_pylist()
    top = list(range(n))
    linked = [(a, b) for a in range(n) for b in range(a + 1, n) if nj.linked_sets(sets[a], sets[b])]

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in linked:
        u, v = find(a), find(b)
        top[max(u, v)] = min(u, v)
    assert len(linked) > 10 * n and {(r["a"], r["b"]) for r in got} <= set(linked)
    assert len(got) == n - len({find(k) for k in range(n)})


def test_a_bucket_yields_every_pair_that_may_link_and_none_that_meets_by_chance():
    rnd = np.random.default_rng(3)
    sets = []
    for _ in range(40):
        base = np.unique(rnd.integers(0, 1 << 63, int(rnd.integers(1, 120))).astype(np.uint64))
        sets += [np.unique(np.where(rnd.random(len(base)) < p, rnd.integers(0, 1 << 63, len(base)).astype(np.uint64), base)) for p in (0, 0.02, 0.05, 0.1)]
    one = np.uint64(1 << 62)  # the last place of the prefix of each of 30 unrelated sets
    sets += [np.sort(np.concatenate([rnd.integers(0, 1 << 62, 25), [1 << 62], rnd.integers((1 << 62) + 1, 1 << 63, 74)]).astype(np.uint64)) for _ in range(30)]
    flat, edges = np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    prefix, cuts = nj.Order(np.zeros(0, np.uint64)).prefixes(flat, edges)
    assert all((prefix[cuts[k] : cuts[k + 1]] == s[: nj.prefix_size(len(s))]).all() for k, s in enumerate(sets)) and one in prefix[cuts[-2] :]
    rows = pa.record_batch({"doc_id": list(range(len(sets))), "n": [len(s) for s in sets], "sigs": [prefix[s:e].tobytes() for s, e in zip(cuts[:-1], cuts[1:], strict=True)]})
    got = nj._meetings(pa.Table.from_batches(list(nj._deal(1, 1)(iter([rows]))))).to_pylist()
    pairs, held = {(r["a"], r["b"]) for r in got if r["a"] is not None}, defaultdict(set)
    for r in got:
        if r["sig"] is not None:
            held[r["sig"]].add(r["doc_id"])
    near = [(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if nj.linked_sets(sets[a], sets[b])]
    assert len(near) > 100 and all(p in pairs or any({*p} <= v for v in held.values()) for p in near)
    assert max(max(p) for p in pairs) < 160 > max(max(v) for v in held.values())


def test_a_bucket_holds_few_bytes_for_a_shingle_and_loses_no_pair_of_long_sets():
    rnd = np.random.default_rng(6)
    sets = []
    for _ in range(60):
        base = np.unique(rnd.integers(0, 1 << 63, int(rnd.integers(1000, 3000))).astype(np.uint64))  # prefixes of more than 256
        sets += [np.unique(np.where(rnd.random(len(base)) < p, rnd.integers(0, 1 << 63, len(base)).astype(np.uint64), base)) for p in (0, 0.1, 0.13)]
    flat, edges = np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    prefix, cuts = nj.Order(np.zeros(0, np.uint64)).prefixes(flat, edges)
    ids = [10**15 + 7 * k for k in range(len(sets))]
    rows = pa.record_batch({"doc_id": ids, "n": [len(s) for s in sets], "sigs": [prefix[s:e].tobytes() for s, e in zip(cuts[:-1], cuts[1:], strict=True)]})
    packs = pa.Table.from_batches(list(nj._deal(40, 1)(iter([rows]))))
    blobs = [packs.column(c) for c in packs.column_names if c not in ("bucket", "salt")]
    assert packs.num_rows == 40 and sum(len(x.as_buffer()) for c in blobs for x in c) < 7 * len(prefix)  # 18 when each had its document's id, size and a wide place
    met = [nj._meetings(packs.filter(pa.array(np.arange(40) == k))).to_pylist() for k in range(40)]
    pairs, held = {(r["a"], r["b"]) for m in met for r in m if r["a"] is not None}, defaultdict(set)
    for r in (r for m in met for r in m if r["sig"] is not None):
        held[r["sig"]].add(r["doc_id"])
    near = [(ids[a], ids[b]) for k in range(0, len(sets), 3) for a, b in ((k, k + 1), (k, k + 2), (k + 1, k + 2)) if nj.linked_sets(sets[a], sets[b])]
    assert len(near) > 100 and all(p in pairs or any({*p} <= v for v in held.values()) for p in near)


def test_narrow_integers_come_back():
    for x in ([5], [-(1 << 63), (1 << 63) - 1], [-3, 252], [-3, 253], [1 << 40, (1 << 40) + 65536]):
        assert nj.widened([nj.narrowed(np.array(x)), nj.narrowed(np.array(x[::-1]))]).tolist() == x + x[::-1]


def test_stored_points_are_small_and_bound_the_overlap_from_above():
    rnd = np.random.default_rng(9)
    sets = [np.unique(rnd.integers(0, 1 << 63, n).astype(np.uint64)) for n in (1, 30, 490, 490, 3000)]
    sets += [np.concatenate([s[: len(s) // 2], s[len(s) // 2 :] + np.uint64(1 << 20)]) for s in sets]
    sets += [np.arange(k, dtype=np.uint64) << np.uint64(20) for k in (20, 300)]  # all in one group: more than half a byte, more than a byte
    flat, edges = np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    packed = nj.packed_points(flat, edges, nj.SENT)
    points = nj.Points(packed)
    assert [len(p) for p in packed[:5]] == [33, 33, 129, 129, 1025] and [len(p) for p in packed[-2:]] == [65, 1 + 4 * 256]
    x, y = np.triu_indices(len(sets))
    for a, b, room in zip(x.tolist(), y.tolist(), points.bounds(x, y).tolist(), strict=True):
        g = min(packed[a][0], packed[b][0])
        counts = [np.bincount((sets[k] & np.uint64((1 << g) - 1)).astype(np.int64), minlength=1 << g) for k in (a, b)]
        assert room == np.minimum(*counts).sum() >= len(np.intersect1d(sets[a], sets[b]))


def test_what_the_join_stores_is_small_beside_the_texts(spark, monkeypatch):
    rnd = random.Random(12)
    rows = [(k, " ".join(f"w{rnd.randrange(50_000)}" for _ in range(404))) for k in range(300)]
    kept, real = [], nj.staged

    def staged(df):
        out = real(df)
        kept.append(sum(f.stat().st_size for f in Path(out.inputFiles()[0].removeprefix("file:").replace("//", "/")).parent.iterdir()))
        return out

    monkeypatch.setattr(nj, "staged", staged)
    got = nj.ngram_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()
    assert sorted(map(tuple, got)) == [(k, 400, k) for k in range(300)]
    assert kept[0] < 300 * 400 < 300 * 101 * 8  # the last: its prefixes alone


def test_each_text_of_a_repeated_doc_id_counts_in_a_block():
    rnd = np.random.default_rng(10)
    for n in (3, 40):  # a tree of one leaf and a larger one
        sets = [np.unique(rnd.integers(0, 1 << 63, 200).astype(np.uint64)) for _ in range(n)]
        second = np.unique(np.concatenate([sets[2][:190], rnd.integers(0, 1 << 63, 90).astype(np.uint64)[:5]]))  # of document 0, near document 2
        docs, both = [*range(n), 0], [*sets, second]
        part = pa.table({"sig": [1] * n, "lo": [0] * n, "band": [0] * n, "doc_id": list(range(n)), "label": list(range(n)), "chunk": [0] * n, "i": [0] * n, "j": [0] * n})
        for order in (range(n + 1), range(n, -1, -1)):
            vectors = pa.table({"doc": [docs[k] for k in order], "n": [len(both[k]) for k in order], "vec": pa.array(nj.packed_points(np.concatenate([both[k] for k in order]), np.concatenate([[0], np.cumsum([len(both[k]) for k in order])]), nj.SENT), pa.binary())})
            near = nj._met(part, vectors)
            assert {0, 2} <= {*near.column("doc_id").to_pylist()}
            got = nj._joined(near, pa.table({"doc": [docs[k] for k in order], "members": pa.array([both[k].tobytes() for k in order], pa.binary())}))
            assert got.to_pylist() == [{"a": 0, "b": 2}]


def test_words_of_any_length_are_told_apart_and_sets_are_those_of_each_text():
    from corvane.llm.words import shingle_runs, shingle_sets, words_of

    words = [("aB\u00e9-" * 60)[:n] + c for n in range(0, 150, 3) for c in "xyz"]
    h, edges = words_of([" ".join(words).encode(), "\t\n".join(words).upper().lower().encode(), b"\v", (" ".join(words) * 3000).encode()])
    assert len(set(h[: len(words)].tolist())) == len({lowered(w) for w in words}) and (h[edges[1] : edges[2]] == h[: len(words)]).all()
    assert edges[3] == edges[2] and (h[edges[3] :][: len(words) - 1] == h[: len(words) - 1]).all()
    texts = [b"a b c d e f a b c d e f g", b"", b"c d e f a", b"x", b" ", b"E f A b c D"]
    flat, cuts = shingle_runs(texts, 5)
    assert [flat[s:e].tolist() for s, e in zip(cuts[:-1], cuts[1:], strict=True)] == [s.tolist() for s in shingle_sets(texts, 5)]
    assert np.diff(cuts).tolist() == [7, 0, 1, 1, 0, 2] and {*flat[cuts[2] : cuts[3]], *flat[cuts[5] :]} <= {*flat[: cuts[1]]}
