"""Every query with SQL gives DuckDB's rows; the others give rows of a stable schema."""

import pytest

from corvane import catalog

from .compare import compare, connect

SF = "/root/testdata/sf0.001"
ORACLES = catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_duckdb(spark, con, name):
    assert compare(spark, name, catalog.queries()[name], ORACLES[name], SF, con) == ""


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(ORACLES)))
def test_query_without_sql_runs_twice_alike(spark, name):
    df = catalog.queries()[name](spark, SF)
    rows = sorted(map(repr, df.collect()))
    assert rows and rows == sorted(map(repr, catalog.queries()[name](spark, SF).collect()))


def test_taint_follows_chains_of_any_length(spark, tmp_path):
    rows = [(5 * k, k, float(k + 1)) for k in range(3, 16)] + [(5 * 40, 12, 3.0), (5 * 41, 14, None)]
    spark.createDataFrame(rows, "event_id long, user_id long, value double").write.parquet(str(tmp_path / "events.parquet"))
    got = catalog.queries()["taint_fixpoint"](spark, str(tmp_path)).collect()
    assert sorted((r.node for r in got), key=lambda n: (n is None, n or 0)) == [*range(3, 17), None]


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 4
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_aligned_words_are_cut_once_for_each_text(spark, tmp_path):
    words = [str(k % 50) for k in range(4000)]
    spark.createDataFrame([(1, " ".join(words)), (2, "one"), (3, None), (4, "a b a c"), (5, "")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for name, want in (("aligned_first", "b"), ("aligned_last", "c")):
        df = catalog.queries()[name](spark, str(tmp_path))
        assert df._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
        got = {(r.doc_id, r.a): r.b for r in df.collect()}
        assert got == {**{(1, str(k)): str((k + 1) % 50) for k in range(50)}, (4, "a"): want, (4, "b"): "a"}
