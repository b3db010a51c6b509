import functools
import random
import struct
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from corvane.llm import pieces
from corvane.llm.packing import minimum_bin_slack, pack_documents
from corvane.llm.pieces import PieceEncoder
from corvane.llm.shared import shared_dir
from corvane.llm.token_counts import SegmentTree, count_tokens_with_edits, sample_edits, split
from corvane.llm.token_orc import read_tokens, token_digests, write_tokens

from .conftest import HARD

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
PARTS = ["a", "B", "é", " ", "  ", "\n", "\t", "'s", "'", "1", "23", ".", ",", "<|endoftext|>", "\xa0", "　", "中", "́", "\x1c", "\r\n", "-", " the", "ß", "İ", "Σ", "µ", "\x85", "\u1680", "\u2028", "×", "!", "###", "&"]


@functools.cache
def library(path, specials):
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = not specials
    return tok


def plain(path, texts, specials=True):
    """A plain call of the library; without ``specials`` their strings are ordinary text."""
    tok = library(path, specials)
    return [e.ids for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("window", [64, 4 << 20])
@pytest.mark.parametrize("specials", [True, False])
@pytest.mark.parametrize(("path", "kind"), [(BYTE, "byte"), (WORD, "word")])
def test_pieces_give_the_ids_of_whole_texts(path, kind, specials, window, monkeypatch):
    monkeypatch.setattr(pieces, "WINDOW", window)
    rnd = random.Random(4)
    texts = ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 25))) for _ in range(4000)] + ["", " ", "\n", "x" * 5000, None]
    enc = PieceEncoder(path, kind, limit=500, specials=specials)
    got = [list(struct.unpack(f"<{len(x) // 4}I", x)) for k in range(0, len(texts), 700) for x in enc.encode(texts[k : k + 700])]
    assert got == plain(path, texts, specials)


def test_segment_tree_keeps_counts_under_edits():
    enc = PieceEncoder(BYTE, "byte")
    rnd = random.Random(3)
    parts = ["'", "s", "'re", "'ll", "e", " ", "  ", "\n", "\t", "a", "é", "1", ".", "!", "　", "ab", "B"]
    for it in range(600):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 60)))
        tree = SegmentTree(split(text), enc.counts(split(text)))
        for _ in range(5):
            s, d = rnd.randint(0, len(text) + 1), rnd.randint(0, 5)
            new = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 90 if it % 7 == 0 else 4)))
            tree.edit(s, d, new, enc)
            s = min(s, len(text))
            text = text[:s] + new + text[s + d :]
            assert tree.text() == text and [p for leaf in tree.leaves for p in leaf] == split(text)
            assert tree.total == len(plain(BYTE, [text], specials=False)[0]) and tree.length == len(text)


def test_counts_hold_when_the_cache_rolls_over():
    rnd = random.Random(12)
    words = [f"w{i} " for i in range(40)]
    enc = PieceEncoder(BYTE, "byte", limit=20)
    texts = ["".join(rnd.choice(words) for _ in range(rnd.randint(1, 30))) for _ in range(200)]
    assert [sum(enc.counts(split(t))) for t in texts] == [len(ids) for ids in plain(BYTE, texts)]


def edited(text):
    t = text or ""
    n = len(t)
    for start, deleted, new in ((n // 2, 0, " reviewed"), (n // 3, 7, ""), (max(n - 3, 0), 12, "n't it?\n")):
        t = t[:start] + new + t[start + deleted :]
    return t


def test_null_edits_are_passed_over(spark):
    df = spark.createDataFrame([(1, "one two", [None, (0, 3, "ten")]), (2, "one two", None)], "doc_id long, text string, edits array<struct<start:int,deleted:int,inserted:string>>")
    got = {r.doc_id: (r.n_edits, r.n_chars) for r in count_tokens_with_edits(df, BYTE, df["edits"]).collect()}
    assert got == {1: (1, 7), 2: (0, 7)}


def test_counts_with_edits_match_full_recounts(spark, hard, empty):
    got = count_tokens_with_edits(hard, BYTE, sample_edits(hard["text"])).collect()
    texts = [r[1] for r in HARD]
    want = Counter((r[0], len(a), 3, len(b), len(edited(r[1]))) for r, a, b in zip(HARD, plain(BYTE, texts, False), plain(BYTE, [edited(t) for t in texts], False), strict=True))
    assert Counter(tuple(r)[:5] for r in got) == want
    assert max(r.n_reencoded for r in got) < 100
    assert count_tokens_with_edits(empty, BYTE, sample_edits(empty["text"])).count() == 0


def test_orc_holds_every_documents_ids_in_order(spark, hard, empty):
    out = shared_dir(spark)
    write_tokens(hard, out, BYTE, "byte", end_id=0, files=3)
    got = token_digests(spark, out).collect()
    want, start = [], 0
    by_id = defaultdict(list)
    for r, ids in zip(HARD, plain(BYTE, [r[1] for r in HARD]), strict=True):
        by_id[r[0]].append([*ids, 0])
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((k, len(x), zlib.crc32(struct.pack(f"<{len(x)}I", *x))) for k, v in by_id.items() for x in v)
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == start
        want.append(r.doc_id)
        start += r.n_tokens
    assert want == sorted(want, key=lambda x: (x is not None, x or 0))
    plan = read_tokens(spark, out).filter("doc_id = 6").select("n_tokens")._jdf.queryExecution().toString()
    assert "EqualTo(doc_id,6)" in plan and "ids:array" not in plan.split("ReadSchema")[1]
    write_tokens(empty, none := shared_dir(spark), BYTE, "byte", end_id=0)
    assert token_digests(spark, none).count() == 0


def test_minimum_bin_slack_uses_every_piece_and_fills_bins():
    rnd = random.Random(9)
    counts = Counter(rnd.choice([rnd.randint(1, 100), rnd.randint(1, 20), 100]) for _ in range(900))
    bins = minimum_bin_slack(counts, 100)
    used = Counter()
    for chosen, times in bins:
        assert sum(k * m for k, m in chosen.items()) <= 100
        used.update({k: m * times for k, m in chosen.items()})
    assert used == counts
    assert sum(t for _, t in bins) <= -(-sum(k * n for k, n in counts.items()) // 100) + 1


def test_packing_is_whole_and_gapless(spark, hard, empty):
    got = pack_documents(hard, WORD).collect()
    want = []
    for r, ids in zip(HARD, plain(WORD, [r[1] for r in HARD]), strict=True):
        ids = [*ids, 1]
        want += [(r[0], p, s, len(x := ids[s : s + 4096]), zlib.crc32(struct.pack(f"<{len(x)}I", *x))) for p, s in enumerate(range(0, len(ids), 4096))]
    assert Counter(tuple(r)[:5] for r in got) == Counter(want)
    rows = defaultdict(list)
    for r in got:
        rows[r.sequence_id].append((r.offset, r.length))
    for v in rows.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(rows) == -(-sum(x[3] for x in want) // 4096)
    assert pack_documents(empty, WORD).count() == 0


def test_packing_takes_small_batches_and_leaves_the_setting_as_it_was(spark):
    import pyarrow as pa

    from corvane.llm import packing

    def sizes(batches):
        for b in batches:
            yield pa.record_batch({"doc_id": [0], "piece": pa.array([0], pa.int32()), "start": [0], "length": [b.num_rows], "ids_crc32": [0]})

    before = spark.conf.get(packing.BATCH_ROWS)
    rows = spark.range(0, 5001, 1, 1).mapInArrow(sizes, packing.PIECES)
    packed = packing.pack_pieces(rows, 4096)
    assert sum(r.length for r in packed.collect()) == 5001 and max(r.length for r in packed.collect()) <= packing.ROWS
    assert spark.conf.get(packing.BATCH_ROWS) == before
