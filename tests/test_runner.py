import pandas as pd
import pytest

from corvane.__main__ import main
from corvane.plans.runner import Run, RunConfig


def body(k):
    return f"int f{k}(char *dst, char *src) {{\n  char buf[{k}];\n  strcpy(buf, src);\n  memcpy(dst, buf, {k});\n  return {k};\n}}"


@pytest.fixture(scope="module")
def source(tmp_path_factory):
    path = tmp_path_factory.mktemp("corpus")
    for split, ks in (("train", range(20)), ("validation", [5, 30, 31]), ("test", [6, 30, 40])):
        pd.DataFrame({"id": [1000 * len(split) + k for k in ks], "func": [body(k) for k in ks], "target": [k % 2 for k in ks], "vul_lines": ["[3]"] * len(ks)}).to_parquet(path / f"{split}-0.parquet")
    return str(path)


def test_run_resumes_and_reports(spark, source, tmp_path):
    run = Run(spark, RunConfig(source, str(tmp_path / "out"), min_freq=2, max_len=40, head=10))
    assert run.run(last="slices") == ["clean", "features", "slices"]
    assert run.run() == ["tokens", "vocabulary", "vectors"] and run.run() == []
    assert {r.split: r["count"] for r in run.table("clean").groupBy("split").count().collect()} == {"train": 20, "validation": 2, "test": 1}
    assert {r.step: r.status for r in run.status().collect()} == dict.fromkeys(run.steps, "completed")
    rows = run.table("vectors").collect()
    assert rows and all(len(r.input_ids) == len(r.attention_mask) == len(r.token_type_ids) == 40 and sum(r.attention_mask) == r.length for r in rows)
    assert run.run(first="vectors", again=True) == ["vectors"]
    with pytest.raises(ValueError, match="unknown step"):
        run.run(first="nope")


def test_failed_steps_are_marked(spark, source, tmp_path):
    run = Run(spark, RunConfig(source, str(tmp_path / "out")), {"bad": lambda r: r.table("missing")})
    with pytest.raises(Exception, match="missing"):
        run.run()
    assert run.status().first().status == "failed"


def test_scan_from_the_command_line(spark, tmp_path, capsys):
    (tmp_path / "a.c").write_text("void f() { gets(x); strcpy(a, b); }")
    assert main(["scan", str(tmp_path)]) == 1
    assert "gets,strcpy" in capsys.readouterr().out
    assert main(["queries"]) == 0
