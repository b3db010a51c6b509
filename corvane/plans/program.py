"""Tokenizer, graph, slice and scanner queries over composed C functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import c_tokens, slices
from ..operators import graphs as g
from ..operators import scanner
from ..operators import vocabulary as v
from ..sources import writers
from .code import sql_code, synth_code
from .registry import registered


def composed(spark, sf_dir):
    """(func_id, code): an order's statements, in line order, as the body of one function."""
    code = synth_code(spark, sf_dir)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "code"))), lambda x: x["code"]), "\n")
    rows = code.groupBy(F.col("l_orderkey").alias("func_id")).agg(body.alias("body"))
    head = F.concat(F.lit("int f"), F.col("func_id").cast("string"), F.lit("(char *src, char *arg, int len, struct node *ptr) {\n"))
    return rows.select("func_id", F.concat(head, "body", F.lit("\nreturn 0;\n}")).alias("code"))


COMPOSED = f"""{sql_code()}, composed AS (SELECT l_orderkey AS func_id, 'int f' || l_orderkey || '(char *src, char *arg, int len, struct node *ptr) {{' || chr(10) ||
    string_agg(code, chr(10) ORDER BY l_linenumber) || chr(10) || 'return 0;' || chr(10) || '}}' AS code FROM code GROUP BY l_orderkey)"""


def tokens_of(policy):
    def run(spark, sf_dir):
        rows = composed(spark, sf_dir).select("func_id", c_tokens.tokenized(F.col("code"), policy).alias("t"))
        return rows.select("func_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), F.array_join("t", " ").alias("tokens"))

    run.__name__ = f"tokenizer_{policy}"
    return run


for _policy in c_tokens.POLICIES:
    registered()(tokens_of(_policy))


@registered()
def optimized_vocabulary(spark, sf_dir):
    rows = composed(spark, sf_dir).select(c_tokens.tokenized(F.col("code"), "optimized").alias("tokens"))
    return v.build_vocabulary(v.token_frequencies(rows), 5, 15_000, ("PAD", "UNK", "BOS", "EOS", "SEP"))


@registered()
def syntax_summary(spark, sf_dir):
    n = g.syntax_nodes(composed(spark, sf_dir), "func_id", "code")
    return n.groupBy("func_id").agg(F.count(F.lit(1)).alias("n_nodes"), F.max("depth").alias("max_depth"), F.max("n_errors").alias("n_errors"), F.count_if(F.col("kind").isin("if", "for", "while", "do", "switch")).alias("n_control"))


@registered()
def control_flow_sizes(spark, sf_dir):
    rows = composed(spark, sf_dir)
    return g.graph_sizes(rows, "func_id", g.cfg_blocks(rows, "func_id", "code"), "n_blocks").join(g.graph_sizes(rows, "func_id", g.cfg_edges(rows, "func_id", "code"), "n_edges"), "func_id")


@registered()
def data_flow_edges(spark, sf_dir):
    access = g.dfg_access(composed(spark, sf_dir), "func_id", "code")
    return g.reaching_definitions(access, "func_id").unionByName(g.pointer_flow(access, "func_id"))


@registered()
def dependence_slices(spark, sf_dir):
    rows = composed(spark, sf_dir).select("func_id", "code", slices.criteria(F.split("code", "\n")).alias("c"))
    return rows.select("func_id", g.text_slices(F.col("code"), F.col("c"), 3, 2).alias("included"))


@registered()
def budgeted_slices(spark, sf_dir):
    rows = composed(spark, sf_dir)
    cut = rows.select("func_id", slices.budgeted_slice(F.col("code"), slices.criteria(F.split("code", "\n"))).alias("sliced_code"))
    return cut.withColumn("n_tokens", slices.estimated_tokens_column(F.col("sliced_code")))


@registered(f"""WITH {COMPOSED} SELECT func_id, len(string_split(code, chr(10))) AS n_lines,
    CAST(len(regexp_extract_all(code, '[A-Za-z_]\\w*|\\d+|->|<<|>>|<=|>=|==|!=|&&|\\|\\||[^\\s\\w]')) AS BIGINT) AS n_estimated FROM composed""")
def estimated_sizes(spark, sf_dir):
    return composed(spark, sf_dir).select("func_id", F.size(F.split("code", "\n")).cast("long").alias("n_lines"), slices.estimated_tokens_column(F.col("code")).alias("n_estimated"))


def files(spark, sf_dir):
    return composed(spark, sf_dir).select(F.concat(F.lit("src/f"), F.col("func_id").cast("string"), F.lit(".c")).alias("path"), F.col("code").alias("content"))


@registered()
def scan_report(spark, sf_dir):
    found = scanner.scan_files(files(spark, sf_dir))
    return found.select("path", "vulnerable", "probability", "risk_level", F.array_join("apis", ",").alias("apis"), "line")


@registered()
def scan_by_function(spark, sf_dir):
    return scanner.file_rollup(scanner.scan_functions(files(spark, sf_dir)))


@registered()
def finding_annotations(spark, sf_dir):
    return writers.annotations(writers.findings(scanner.scan_files(files(spark, sf_dir)).filter("vulnerable"), "src"))


@registered()
def feature_vector_v2(spark, sf_dir):
    from ..functions.checks import check_features, checked_columns

    return composed(spark, sf_dir).select("func_id", *checked_columns(F.col("code"))).select("func_id", *check_features())
