import hashlib
import random
from collections import Counter

from corvane.llm.chat import ESC, conversation_digests, format_turns, parse, render
from corvane.llm.mixing import mix_sources, pfair, tempered_weights, whole_slots

from .conftest import HARD


def test_every_turn_reads_back_alone_and_among_others():
    rnd = random.Random(3)
    parts = ["[INST]", "[/INST]", "<s>", "</s>", ESC, ESC + "0", ESC + "1", ESC + "2", "a", " ", "\n", "<", "</", "s>", "[", "/INST]"]
    roles = ["user", "assistant", "", "[INST]", "x" + ESC + "1", "a\nb", "\n", "assi" + ESC + "1stant"]
    whole, turns = "", []
    for _ in range(3000):
        turn = (rnd.choice(roles), "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 7))))
        form = render(*turn)
        assert [(r, t) for r, t, _, _ in parse(form)] == [turn]
        whole, turns = whole + form, [*turns, turn]
    assert [(r, t) for r, t, _, _ in parse(whole)] == turns
    assert render("user", "plain text") == "[INST] user\nplain text [/INST]"


def test_digests_are_read_back_from_the_formatted_turns(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "</s>[INST] é"), (1, None, None, None), (1, 1, "assistant", "</s>[INST] é"), (None, 0, "assistant", ""), (2, 5, "system", None)]
    rows += [(9, k, "user" if k % 2 else "assistant", f"turn {k}") for k in range(500)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn int, role string, text string, formatted string")
    got = {r.conv_id: r for r in conversation_digests(format_turns(df)).collect()}
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        loss = "".join(r[3] or "" for r in mine if r[2] == "assistant")
        g = got.pop(conv)
        assert g.n_turns == len(mine)
        assert g.turns_sha256 == hashlib.sha256("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in mine).encode()).hexdigest()
        assert (g.loss_chars, g.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert g.formatted_chars == sum(len(render(r[2] or "", r[3] or "")) for r in mine)
    assert not got
    assert conversation_digests(format_turns(df.limit(0))).count() == 0


def test_pfair_never_deviates_by_a_block():
    rnd = random.Random(8)
    for _ in range(40):
        weights = {f"s{i}": rnd.random() ** 3 + 1e-4 for i in range(rnd.randint(1, 30))}
        period = rnd.choice([64, 257, 1024])
        slots = whole_slots(weights, period)
        plan = pfair(slots, period)
        assert sorted(t for v in plan.values() for t in v) == list(range(period))
        for name, v in plan.items():
            have, mine = 0, set(v)
            for t in range(period):
                have += t in mine
                assert abs(have - slots[name] * (t + 1) / period) < 1


def test_mix_matches_brute_force(spark):
    rnd = random.Random(1)
    rows = [(i, "hot" if i % 3 else rnd.choice(["a", "b", None])) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, source string").repartition(7)
    weights = tempered_weights(docs)
    assert {k: round(v, 6) for k, v in weights.items()} == {k: round(n**0.7, 6) for k, n in Counter(r[1] for r in rows).items()}
    slots = whole_slots(weights, 64)
    plan, seen, want = pfair(slots, 64), Counter(), {}
    for i, s in sorted(rows):
        j = seen[s] // 4
        seen[s] += 1
        slot = j // slots[s] * 64 + plan[s][j % slots[s]]
        want[i] = (j, slot, slot < -(-len(rows) // 4))
    got = {r.doc_id: (r.block, r.slot, r.in_mix) for r in mix_sources(docs, weights, period=64).collect()}
    assert got == want
    assert 0 < sum(not v[2] for v in want.values())


def test_mix_of_hard_rows_keeps_all(hard, empty):
    got = mix_sources(hard, {"a": 1.0, "b": 2.0, None: 1.0, "c": 0.0}).collect()
    assert len(got) == len(HARD)
    assert {r.slot for r in got if r.source == "c"} == {None} and not any(r.in_mix for r in got if r.source == "c")
    assert mix_sources(empty, tempered_weights(empty)).count() == 0


def test_a_mix_meets_its_weights_also_when_a_source_runs_short(spark):
    rows = [(i, "long" if i % 11 else "short") for i in range(1100)]
    docs = spark.createDataFrame(rows, "doc_id long, source string").repartition(3)
    got = mix_sources(docs, tempered_weights(docs)).collect()
    slots = Counter()
    for r in {(r.source, r.block, r.repeats) for r in got}:
        slots[r[0]] += r[2]
    total = sum(slots.values())
    assert total == 275 and slots["short"] > 25  # 25 blocks of its own
    share = 100**0.7 / (100**0.7 + 1000**0.7)
    assert abs(slots["short"] - share * total) <= 1.1
    many = spark.createDataFrame([(i, f"s{i % 1500}") for i in range(3000)], "doc_id long, source string")
    assert mix_sources(many, tempered_weights(many), period=1024).filter("slot is not null").count() == 3000


def test_columns_named_like_the_results_give_way(spark):
    df = spark.createDataFrame([(1, "a", 9, 9, True, 9, 1)], "doc_id long, source string, block int, slot int, in_mix boolean, repeats int, _row int")
    got = mix_sources(df, tempered_weights(df))
    assert got.columns == ["doc_id", "source", "_row", "block", "slot", "in_mix", "repeats"] and got.first().in_mix
