"""Hand-derived expectations on C fixtures: parser, graphs, slices, features, scanner."""

import random

import pytest
from pyspark.sql import functions as F

from corvane.functions import c_parser as cp
from corvane.functions import risk, slices
from corvane.operators import graphs as g
from corvane.operators import scanner
from corvane.sources import writers

WORK = """static int work(char *buf, int n)
{
    int total = 0, *p = &n;
    for (int i = 0; i < n; i++) {
        if (buf[i] == 0)
            break;
        total += buf[i];
    }
    switch (n) {
    case 1: total = 2; break;
    default: total = 3;
    }
    do { n--; } while (n > 0);
    if (!p) goto out;
    *p = total;
out:
    return total; // x
}
"""


def test_flow_has_break_loop_back_switch_goto_and_return_edges():
    f = cp.control_flow(WORK)
    kinds = {k for _, _, k in f.edges}
    assert kinds == {"sequential", "true", "false", "break", "loop_back", "switch_case", "goto", "return"}
    at = {b[1]: b[0] for b in f.blocks if b[3] == "loop_header"}
    assert any(dst == at[4] and k == "loop_back" for _, dst, k in f.edges)
    assert {b[3] for b in f.blocks} >= {"entry", "exit", "condition", "loop_header", "return", "label"}


def test_continue_and_else_edges():
    f = cp.control_flow("while (a) {\n if (b)\n continue;\n else\n c();\n}\nd();")
    header = next(b[0] for b in f.blocks if b[3] == "loop_header")
    assert any(dst == header and k == "continue" for _, dst, k in f.edges)
    assert sum(k == "false" for _, _, k in f.edges) == 2


def test_accesses_and_functions():
    got = cp.accesses(WORK)
    assert ("buf", 1, 22, "param") in got and ("n", 3, 25, "address") in got and ("p", 15, 5, "pointer_def") in got
    assert ("i", 4, 27, "update") in got and ("total", 17, 11, "use") in got and ("buf", 5, 12, "array") in got
    (f,) = cp.functions(WORK)
    assert (f["name"], f["start_line"], f["end_line"], f["return_type"], f["parameters"]) == ("work", 1, 18, "static int", ["char * buf", "int n"])


def test_parser_takes_anything():
    rnd = random.Random(1)
    parts = ["{", "}", "(", ")", "if ", "else ", "a", "=", "; ", "\n", "do ", "while", "for", "case 1:", "*", "&", "[", "]", "int ", "goto x;", "x:", '"', "/*"]
    for _ in range(800):
        text = "".join(rnd.choice(parts) for _ in range(40))
        cp.control_flow(text), cp.accesses(text), cp.control_scopes(text), cp.functions(text)
    assert cp.parse("int f( {")[1] > 0 and cp.parse("")[1] == 0


def test_comments_go_but_strings_and_lines_stay():
    code = 'a /* x\ny */ = "// no"; // gone \\\n too\nb'
    assert cp.strip_comments(code) == 'a \n = "// no"; \n\nb'
    kept = cp.strip_comments(code, keep_columns=True)
    assert len(kept) == len(code) and kept.split("\n")[1] == "     = \"// no\"; " + " " * len("// gone \\")


def test_graph_tables(spark):
    rows = spark.createDataFrame([(1, WORK), (2, None), (3, "x = 1;\ny = x;\nx = 2;\nz = x + y;")], "func_id long, code string")
    access = g.dfg_access(rows, "func_id", "code")
    edges = g.reaching_definitions(access, "func_id")
    names = access.select("func_id", F.col("idx").alias("i"), "var_name", "line")
    pairs = edges.join(names.withColumnsRenamed({"i": "from_idx", "line": "src"}), ["func_id", "from_idx"]).join(names.select("func_id", F.col("i").alias("to_idx"), F.col("line").alias("dst")), ["func_id", "to_idx"])
    assert {(r.var_name, r.src, r.dst) for r in pairs.filter("func_id = 3").collect()} == {("x", 1, 2), ("y", 2, 4), ("x", 3, 4)}
    dep = g.dependence_edges(access, edges, g.control_edges(rows, "func_id", "code"), "func_id")
    crit = spark.createDataFrame([(3, 4)], "func_id long, line int")
    back = lambda d: sorted(r.line for r in g.dependence_slice(dep, crit, "func_id", d, 0).collect())
    assert back(0) == [4] and back(1) == [2, 3, 4] and back(2) == [1, 2, 3, 4]
    assert {(r.src, r.dst) for r in dep.filter("func_id = 1 and type = 'control'").collect()} == {(4, 5), (4, 6), (4, 7), (5, 6), (9, 10), (9, 11)}
    assert {r.func_id: r.n for r in g.graph_sizes(rows, "func_id", g.cfg_blocks(rows, "func_id", "code"), "n").collect()}[2] == 2
    pf = g.pointer_flow(g.dfg_access(spark.createDataFrame([(1, "p = &a;\nq = *p;\n*p = 3;\nr = s->t;")], "func_id long, code string"), "func_id", "code"), "func_id")
    assert pf.count() == 2
    assert g.def_use_chains(access, "func_id").filter("func_id = 3").count() == 4


def test_slicing_rules():
    lines = [f"line{i} = call({i});" for i in range(1, 41)]
    assert slices.clustered([1, 2, 3, 30, 31, 90], 5, 6) == [1, 2, 3, 30, 31, 90]
    assert slices.clustered([1, 2, 3, 30, 31, 90], 5, 2) == [2, 31]
    short = ["a", "b b b b b b b b", "c"]
    assert slices.within_budget(short, [1, 2, 3], [1], [], 10, 3) == [1, 3]  # what doesn't fit is skipped
    assert slices.within_budget(lines, range(1, 41), [20], [3], 3, 1000) == [3, 19, 20]
    assert slices.laid_out(["  a", "    b", "", "  d", "  d"], [1, 2, 4, 5]) == "a\n  b\n[SEP]\nd"
    assert slices.merged_separators("[SEP]\na\nb\nc\n[SEP]\n[SEP]\nd\ne\nf\n[SEP]\ng") == "a\nb\nc\n[SEP]\nd\ne\nf\ng"
    assert slices.two_sided("a\nb", "b\nc", 100) == "a\nb\n[SEP]\nc" and slices.two_sided("", "x", 10) == "x" and slices.two_sided("x", "", 10) == "x"
    assert slices.guard_lines(["if (p == NULL)", "  return;", "if (q > 3)", "  q++;", "use(p, q);"], [5]) == [1]
    assert slices.guard_lines(["assert(p);", "use(p);"], [2]) == [1]


@pytest.mark.parametrize(("code", "want"), [("a;\nstrcpy(x, y);\nb;", [2]), ("a;\np->q = 1;", [2]), ("a;\nb;\nc;\nd;", [2]), ("a;", [1])])
def test_criteria(spark, code, want):
    assert spark.createDataFrame([(code,)], "c string").select(slices.criteria(F.split("c", "\n")).alias("k")).first().k == want


def features(spark, code):
    first, second = risk.feature_columns(F.col("c"))
    return spark.createDataFrame([(code,)], "c string").select(*first).select(*second).first().asDict()


@pytest.mark.parametrize(("gap", "want"), [(0, 1.0), (1, 0.0), (15, 0.0), (16, 1.0)])
def test_allocation_checks_count_on_the_next_fifteen_lines(spark, gap, want):
    check = "if (p == NULL) return;"
    code = f"p = malloc(4); {check}" if gap == 0 else "p = malloc(4);\n" + "x;\n" * (gap - 1) + check
    assert features(spark, code)["has_unchecked_malloc"] == want


@pytest.mark.parametrize("check", ["if (NULL != p)", "if (!p)", "if (p)", "y = p ? 1 : 2;", "assert(p);", "BUG_ON(!p);"])
def test_each_form_of_check(spark, check):
    assert features(spark, f"p = calloc(1, 2);\n{check}")["has_unchecked_malloc"] == 0.0


@pytest.mark.parametrize(("code", "want"), [("free(a);\nfree(a);", 1.0), ("free(a);\na = NULL;\nfree(a);", 0.0), ("free(a); a = b; free(a);", 1.0), ("free(a);\nfree(b);", 0.0), ("free(a);\na = b;\nfree(a);", 0.0)])
def test_double_free(spark, code, want):
    assert features(spark, code)["has_potential_double_free"] == want


def test_feature_vector(spark):
    f = features(spark, "strcpy(a, b);\ngets(line);")
    assert len(f) == 36 and f["has_unbounded_strcpy"] == f["has_dangerous_gets"] == 1.0
    assert f["dangerous_call_density"] == 1.0 and f["missing_defense_ratio"] == 1.0
    assert f["danger_score"] == round(min(1, 2 * 1.9 / 8.05), 6) and f["buffer_overflow_patterns"] == round(2 / 3, 6)
    assert f["vuln_likelihood_score"] == round(0.3 + 0.2 + 0.3 * 0.4 + 0.2 + 0.1, 6)
    assert set(features(spark, "  \n ").values()) == {0.0} and set(features(spark, None).values()) == {0.0}


def test_scan_and_reports(spark):
    files = spark.createDataFrame([("src/a.c", "int f() {\n gets(b);\n strcpy(a, b);\n}"), ("src/b.c", "int g() { return 1; }\n// gets(x)"), ("src/c.c", None)], "path string, content string")
    got = {r.path: r for r in scanner.scan_files(files).collect()}
    assert got["src/a.c"].apis == ["gets", "strcpy"] and got["src/a.c"].line == 2 and got["src/a.c"].vulnerable
    assert got["src/b.c"].apis == [] and not got["src/b.c"].vulnerable and got["src/c.c"].risk_level == "ERROR"
    found = writers.findings(scanner.scan_files(files).filter("vulnerable"), "src")
    row = found.first()
    assert row.uri == "a.c" and len(row.fingerprint) == 32
    import json

    report = json.loads(writers.sarif(found).first().sarif)
    assert report["version"] == "2.1.0" and report["runs"][0]["results"][0]["locations"][0]["physicalLocation"]["region"]["startLine"] == 2
    assert writers.annotations(found).first().annotation.startswith("::warning file=a.c,line=2::")
    assert json.loads(writers.json_report(scanner.scan_files(files)).first().report)["summary"] == {"files": 3, "vulnerable": 1, "errors": 1}
    assert writers.text_report(scanner.scan_files(files)).count() == 3
    roll = {r.path: r for r in scanner.file_rollup(scanner.scan_functions(files.filter("content is not null"))).collect()}
    assert roll["src/a.c"].n_functions == 1 and roll["src/a.c"].n_vulnerable == 1


def test_second_feature_set(spark):
    from corvane.functions.checks import check_features, checked_columns

    code = "// head\nchar *p = malloc(n);\nif (p == NULL) return;\nstrcpy(p, q);\nstrcpy(r, s);\nif (i < 3) x = a[i] + b[k] + c[2];\nfree(p);\nfree(z);\nfd = fopen(q);\nif (fd < 0) {}\nread(fd, p, 1);"
    f = spark.createDataFrame([(code,), ("",), (None,)], "c string").select(*checked_columns(F.col("c"))).select(*check_features()).collect()
    g = f[0].asDict()
    assert len(g) == 26 and g["loc"] == 10 and g["dangerous_call_count"] == 2 and g["dangerous_call_without_check_count"] == 1
    assert (g["array_access_count"], g["array_access_without_bounds_check_count"]) == (3, 1)
    assert (g["malloc_count"], g["malloc_without_free_count"], g["free_count"], g["free_without_null_check_count"]) == (1, 0, 2, 1)
    assert g["unchecked_return_value_count"] == 1 and g["unchecked_return_value_ratio"] == round(1 / 3, 6)
    assert set(f[1].asDict().values()) == set(f[2].asDict().values()) == {0.0}


def test_slices_of_texts_are_those_of_the_edge_tables(spark):
    from corvane.plans.program import composed

    rows = composed(spark, "/root/testdata/sf0.001").filter("func_id % 40 = 0").withColumn("code", F.when(F.col("func_id") % 80 == 0, F.concat("code", F.lit(WORK))).otherwise(F.col("code")))
    rows = rows.select("func_id", "code", slices.criteria(F.split("code", "\n")).alias("c")).localCheckpoint()
    access = g.dfg_access(rows, "func_id", "code").localCheckpoint()
    dep = g.dependence_edges(access, g.reaching_definitions(access, "func_id"), g.control_edges(rows, "func_id", "code"), "func_id").localCheckpoint()
    crit = rows.select("func_id", F.explode("c").alias("line"))
    for back, ahead in ((0, 0), (1, 1), (2, 1)):
        lines = g.dependence_slice(dep, crit, "func_id", back, ahead).groupBy("func_id").agg(F.array_sort(F.collect_list("line")).alias("l")).collect()
        got = rows.select("func_id", g.text_slices(F.col("code"), F.col("c"), back, ahead).alias("s")).collect()
        assert len(got) > 10 and {r.func_id: r.s for r in got} == {r.func_id: ",".join(map(str, r.l)) for r in lines}


def test_the_slices_query_shuffles_its_rows_once_at_most_for_each_function(spark):
    from corvane import catalog

    plan = catalog.queries()["dependence_slices"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Scan parquet") == 1


def test_second_features_read_counts_and_no_texts(spark):
    from corvane.functions.checks import check_features, checked_columns

    assert not any("regexp" in str(c) or "filter" in str(c) for c in check_features())
    (first,) = checked_columns(F.col("c"))
    code = "if (elif(x) ) y;\n*  p1 = *q->r;\nv = fopen(a);\n\n" + "w;\n" * 9 + "if (v) z;\nread(fd, p, 1); n = read(fd, p, 1);\nwhile (n > 0) a[ n + m ] = b[n];\ngets(n);"
    (f,) = spark.createDataFrame([(code,)], "c string").select(first).select(*check_features()).collect()
    assert (f.unchecked_return_value_count, f.unchecked_return_value_ratio, f.pointer_deref_count) == (2.0, round(2 / 3, 6), 4.0)
    assert (f.array_access_count, f.array_access_without_bounds_check_count, f.dangerous_call_without_check_count) == (2.0, 0.0, 0.0)
