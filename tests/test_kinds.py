import pytest
from pyspark.sql import functions as F

from corvane.functions import boosts, java_tokens, token_kinds


@pytest.mark.parametrize(("token", "want"), [("strcpy", 8), ("STRCPY", 8), ("snprintf", 9), ("malloc", 10), ("free", 11), ("->", 12), ("[", 13), ("NULL", 14), ("0", 14), ("sizeof", 15), ("int", 4), ("while", 2), ("42", 6), ("0xff", 6), (";", 7), ("+", 5), ("foo", 3), ("", 0), (None, 0)])
def test_type_ids(spark, token, want):
    assert spark.createDataFrame([(token,)], "t string").select(token_kinds.type_id(F.col("t")).alias("k")).first().k == want


def test_type_sequences_and_histogram(spark):
    rows = spark.createDataFrame([(["int", "x", ";", "x"],), ([],)], "t array<string>")
    assert [r.k for r in rows.select(token_kinds.type_ids(F.col("t"), 3).alias("k")).collect()] == [[4, 3, 7], [0, 0, 0]]
    h = {r.kind: (r.n, r.ratio) for r in token_kinds.type_histogram(rows, "t").collect()}
    assert len(h) == 16 and h["IDENTIFIER"] == (2, 0.5) and h["ALLOC"] == (0, 0.0)


def test_java_tokens():
    got = java_tokens.java_tokens('int a = 300; String s = "SELECT x"; // gone\nf(12.5, 120.5, 999.5, "GET", "a@b.c", "plain");')
    assert got == ["int", "a", "=", "<num_16bit>", ";", "String", "s", "=", "<sql_str>", ";", "f", "(", "<gps_lat>", ",", "<gps_lon>", ",", "<num_float>", ",", "<http_method>", ",", "<regex_str>", ",", "plain", ")", ";"]


def test_java_vocabulary(spark):
    rows = spark.createDataFrame([(["a", "b", "a", "1", "22"],), (["a", "b", "333"],)], "t array<string>")
    got = {r.token: (r.id, r.waiting) for r in java_tokens.java_vocabulary(rows, "t", 2, 9).collect()}
    assert got == {"<pad>": (0, False), "<unk>": (1, False), "<num>": (2, False), "<sos>": (3, False), "<eos>": (4, False), "a": (5, False), "b": (6, False), "token7": (7, True), "token8": (8, True)}


@pytest.mark.parametrize(
    ("code", "want"),
    [
        ("gets(x);", ["gets"]), ("printf(buf);", ["format:printf"]), ('printf("%d", x);', []), ("strcpy(a, b);", ["copy:strcpy"]), ("strcpy(a, b); strlen(b);", []),
        ("p = (char *) malloc(3);\nuse(p);", ["allocation:p"]), ("p = (char *) malloc(3);\nif (p == NULL) return;", []), ("free(p);\nfree(p);", ["double_free:p"]),
        ("free(a);\nfree(b);\nb = x;\nfree(b);\nq;\nfree(a);", ["double_free:a"]), ("free(a); free(b); free(b); free(a);", ["double_free:b"]),
        ("free(p);\nreturn p;", ["use_after_free:p"]), ("free(p);\np = NULL;\nreturn p;", []), (None, []),
    ],
)
def test_critical_patterns(spark, code, want):
    assert spark.createDataFrame([(code,)], "c string").select(boosts.critical_patterns(F.col("c")).alias("f")).first().f == want


def test_domains_are_urls_in_any_case():
    from corvane.functions import c_tokens

    assert c_tokens.string_word('"Example.Com"') == "URL_STR" and java_tokens.string_word('"Example.Com/x"') == "<regex_str>"
    assert java_tokens.string_word('"get"') == "<http_method>" and java_tokens.string_word('"getter"') == "getter"


def test_boost_columns(spark):
    df = spark.createDataFrame([("gets(x); strcpy(a, b);", 0.5)], "c string, p double")
    row = df.select(boosts.pattern_boost(F.col("c")).alias("b"), boosts.adjusted(F.col("p"), F.lit(0.0)).alias("a"), boosts.graph_risk(*[F.lit(x) for x in (1, 1, 0, 9)]).alias("g"), F.round(boosts.softened(F.lit(2.0), 2.0), 4).alias("s")).first()
    assert (row.b.boost, row.a, row.g, row.s) == (0.25, 0.425, 1.0, 0.7311)
