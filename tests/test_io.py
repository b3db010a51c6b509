"""Readers, writers, vocabulary operators and streams on small files."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import lines as ln
from corvane.operators import quality as q
from corvane.operators import vocabulary as v
from corvane.sources import readers, writers
from corvane.streaming import incremental


def test_splits_come_from_file_names(spark, tmp_path):
    import pandas as pd

    for name, ids in (("train-0", [1, 2]), ("validation-0", [3]), ("test-0", [4]), ("other", [5])):
        pd.DataFrame({"id": ids, "func": [f"f{i}" for i in ids], "target": [i % 2 for i in ids], "vul_lines": ["[3, 1, 3]"] * len(ids), "line_no": ["[1]"] * len(ids)}).to_parquet(tmp_path / f"{name}.parquet")
    rows = readers.read_splits(spark, str(tmp_path))
    assert {(r.id, r.split) for r in rows.collect()} == {(1, "train"), (2, "train"), (3, "validation"), (4, "test"), (5, None)}
    assert readers.read_splits(spark, str(tmp_path), ["id"], "test").columns == ["id", "split"]
    with pytest.raises(ValueError, match="unknown split"):
        readers.read_splits(spark, str(tmp_path), split="dev")
    s = readers.as_samples(rows)
    assert s.columns[:11] == readers.SAMPLE.names and dict(s.dtypes)["target"] == "boolean" and s.first().line_no == [1]
    assert {r.split: r.n_rows for r in readers.list_splits(rows).collect()}["train"] == 2


@pytest.mark.parametrize(("raw", "want"), [("[3, 1, 3]", [1, 3]), ('{"line_no": [7, 2], "code": ["a", "b"]}', [2, 7]), ('{"12": "x", "4": "y"}', [4, 12]), (None, []), ("oops", [])])
def test_vulnerable_lines_in_every_shape(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "r string").select(readers.vulnerable_lines(F.col("r")).alias("l")).first().l == want


def test_code_falls_back_on_the_cleaned_form(spark):
    rows = spark.createDataFrame([("", "b"), (None, None), ("a", "b")], "f string, c string")
    assert [r.x for r in rows.select(readers.code_of(F.col("f"), F.col("c")).alias("x")).collect()] == ["b", "", "a"]


def test_json_csv_and_slices(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"split": "train", "x": 1}\n\n{"split": "test", "x": 2}\n')
    assert readers.read_json_lines(spark, str(tmp_path / "a.jsonl"), "test").collect()[0].x == 2
    (tmp_path / "s.json").write_text(json.dumps([{"sliced_code": "a", "label": 1}, {"code": "b", "target": 0}]))
    assert {tuple(r) for r in readers.read_slices(spark, str(tmp_path / "s.json")).collect()} == {("a", 1), ("b", 0)}
    (tmp_path / "j.csv").write_text(",".join(readers.JAVA_COLUMNS) + "\n" + ",".join(["1"] * 11) + "\n")
    assert readers.read_java_csv(spark, str(tmp_path / "j.csv")).count() == 1
    (tmp_path / "k.csv").write_text("label,x\n1,2\n")
    with pytest.raises(ValueError, match="missing columns"):
        readers.read_java_csv(spark, str(tmp_path / "k.csv"))
    writers.write_table(readers.read_any(spark, str(tmp_path / "k.csv")), str(tmp_path / "out.parquet"))
    assert readers.read_any(spark, str(tmp_path / "out.parquet")).first().x == 2
    with pytest.raises(ValueError, match="no reader"):
        readers.read_any(spark, "x.bin")


def test_sources_and_rules(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for name in ("a.c", "d/b.HPP", "d/c.py"):
        (tmp_path / name).write_text("int x;")
    got = readers.read_sources(spark, str(tmp_path))
    assert sorted(r.path.rsplit("/", 1)[1] for r in got.collect()) == ["a.c", "b.HPP"] and got.first().content == "int x;"
    (tmp_path / "r.yaml").write_text("buf:\n  dangerous_functions: [gets]\n  patterns: ['gets\\(', '(oops']\nother: 3\n")
    rules = readers.read_rules(str(tmp_path / "r.yaml"))
    assert rules == {"buf": (["gets"], ["gets\\("])}
    funcs, patterns = readers.rule_tables(spark, rules)
    assert funcs.collect()[0].func == "gets" and patterns.count() == 1


def test_array_files_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([([1, 2], 0), ([3, 4], 1)], "ids array<int>, label int").coalesce(1)
    blob = writers.write_arrays(rows, str(tmp_path / "blobs"), ["ids", "label"]).first()
    (tmp_path / "x.npz").write_bytes(blob.content)
    assert np.load(tmp_path / "x.npz")["ids"].tolist() == [[1, 2], [3, 4]]
    back = readers.read_arrays(spark, str(tmp_path / "x.npz"), {"ids": "array<int>", "label": "int"})
    assert {(tuple(r.ids), r.label) for r in back.collect()} == {((1, 2), 0), ((3, 4), 1)}


def test_vocabulary_order_cap_and_encoding(spark):
    rows = spark.createDataFrame([(1, ["b", "a", "b", "z"]), (2, ["a", "c"]), (3, []), (4, None)], "id long, tokens array<string>")
    vocab = v.build_vocabulary(v.token_frequencies(rows), 1, 7)
    assert {r.token: r.id for r in vocab.collect()} == {"<PAD>": 0, "<UNK>": 1, "<BOS>": 2, "<EOS>": 3, "a": 4, "b": 5, "c": 6}
    ids = v.encode(rows, vocab, "id")
    assert {r.id: r.ids for r in ids.collect()} == {1: [5, 4, 5, 1], 2: [4, 6], 3: [], 4: []}
    assert {r.id: r.tokens for r in v.decode(ids, vocab, "id").collect()} == {1: ["b", "a", "b", "<UNK>"], 2: ["a", "c"]}
    assert {r.id: r.oov_rate for r in v.unknown_rate(rows, vocab, "id").collect()} == {1: 0.25, 2: 0.0, 3: 0.0, 4: 0.0}


@pytest.mark.parametrize(("mode", "limit", "kw", "want"), [("tail", 3, {}, [1, 2, 3]), ("head", 3, {}, [4, 5, 6]), ("center", 3, {}, [1, 2, 6]), ("head_tail", 4, {"head": 2, "sep": 9}, [1, 2, 9, 6]), ("tail", 6, {}, [1, 2, 3, 4, 5, 6])])
def test_truncation(spark, mode, limit, kw, want):
    row = spark.createDataFrame([([1, 2, 3, 4, 5, 6],)], "x array<int>").select(v.truncated(F.col("x"), limit, mode, **kw).alias("y"))
    assert row.first().y == want


def test_padding_and_mask(spark):
    row = spark.createDataFrame([([7, 8],)], "x array<int>").select(v.padded(F.col("x"), 4).alias("r"), v.padded(F.col("x"), 4, left=True).alias("l"), v.attention_mask(F.col("x"), 3).alias("m"), v.with_ends(F.col("x")).alias("e")).first()
    assert (row.r, row.l, row.m, row.e) == ([7, 8, 0, 0], [0, 0, 7, 8], [1, 1, 0], [2, 7, 8, 3])


def test_leakage_and_conflicts(spark):
    rows = spark.createDataFrame([(1, "train", "a"), (2, "validation", "a"), (3, "validation", "b"), (4, "test", "b"), (5, "test", "a"), (6, "test", "c")], "id long, split string, key string")
    assert sorted(r.id for r in q.leakage_removed(rows, "split", "key").collect()) == [1, 3, 6]
    rows = spark.createDataFrame([(1, "a", 0), (2, "a", 1), (3, "b", 1), (4, "b", 1)], "id long, key string, label int")
    assert [r.id for r in q.without_conflicts(rows, "key", "label", "id").collect()] == [3]


def test_windows_islands_and_dedent(spark):
    row = spark.createDataFrame([(10, [1, 9])], "n int, c array<int>").select(ln.window_lines(F.col("n"), F.col("c"), 2).alias("w")).first()
    assert row.w == [1, 2, 3, 7, 8, 9, 10]
    rows = spark.createDataFrame([("u", t) for t in (1, 2, 9, 10, 30)], "k string, t int")
    assert [r.island for r in ln.islands(rows, ["k"], "t", 5).orderBy("t").collect()] == [0, 0, 1, 1, 2]
    row = spark.createDataFrame([(["    a", "", "      b"],)], "x array<string>").select(ln.dedented(F.col("x")).alias("d")).first()
    assert row.d == "a\n\n  b"
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src long, dst long")
    assert {(r.node, r.distance) for r in ln.reachable(edges, spark.createDataFrame([(1,)], "seed long"), 2).collect()} == {(1, 0), (2, 1), (3, 2)}


def test_streams_drain_new_files_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a b"), (2, "b"), (3, "a b")], "id long, text string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = lambda: incremental.follow(spark, str(tmp_path / "in"), "id long, text string")
    run = lambda: incremental.drain(stream(), str(tmp_path / "out"), str(tmp_path / "ck"), lambda d: incremental.first_of_each(d, "text")).awaitTermination(60)
    assert run() and spark.read.parquet(str(tmp_path / "out")).count() == 2
    spark.createDataFrame([(4, "b"), (5, "c")], "id long, text string").write.mode("append").parquet(str(tmp_path / "in"))
    assert run() and {r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"a b", "b", "c"}
    words = stream().select(F.split("text", " ").alias("t"))
    assert incremental.count_tokens(words, "t", "freqs", str(tmp_path / "ck2")).awaitTermination(60)
    assert {r.token: r.freq for r in spark.table("freqs").collect()} == {"a": 2, "b": 4, "c": 1}


def test_streaming_windows(spark, tmp_path):
    spark.sql("select timestamp'2024-01-01 00:05:00' as ts, 'x' as k union all select timestamp'2024-01-01 01:05:00', 'x'").write.parquet(str(tmp_path / "ev"))
    s = incremental.windowed_counts(incremental.follow(spark, str(tmp_path / "ev"), "ts timestamp, k string"), "ts", ["k"])
    assert s.writeStream.format("memory").queryName("wins").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(60)
    assert spark.table("wins").count() == 2
