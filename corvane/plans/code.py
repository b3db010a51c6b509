"""Risk queries over C statements that are composed from ``lineitem`` columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import risk
from ..functions.lexer import sql_tokens, tokens
from .registry import registered, spread, table

#: One snippet for each remainder of the line number and key: allocations, copies, frees, indices, formats.
SNIPPETS = {
    0: "char *p{k} = malloc({q} * 4);\nif (p{k} == NULL) return -1;\nmemcpy(p{k}, src, {q});",
    1: "char *p{k} = malloc({q} + 1);\np{k}->next = head;\nreturn p{k}[i];",
    2: "strcpy(buf{q}, arg);\nstrcat(buf{q}, \"x\");\nprintf(buf{q});",
    3: "free(ctx{k});\nlog(\"again\");\nfree(ctx{k});",
    4: "free(ctx{k});\nctx{k} = NULL;\nfree(ctx{k});",
    5: "for (int i = 0; i < len; i++) {{\n  total += data[i] * {q};\n}}",
    6: "int n = atoi(argv[{q}]);\nif (n > {q} && !quiet) snprintf(out, sizeof(out), \"%d\", n);",
    7: "while (ptr) {{\n  gets(line);\n  ptr = ptr->next;\n}}\nassert(ptr);",
}
PICK = "(l_orderkey + l_linenumber) % 8"


def sql_code() -> str:
    def made(s: str) -> str:
        text = s.replace("{{", "{").replace("}}", "}").replace("'", "''")
        parts = text.replace("{k}", "\0k\0").replace("{q}", "\0q\0").split("\0")
        names = {"k": "CAST(l_orderkey % 7 AS VARCHAR)", "q": "CAST(CAST(l_quantity AS INTEGER) AS VARCHAR)"}
        lit = [names[p] if p in names else "'" + p.replace("\n", "' || chr(10) || '") + "'" for p in parts if p]
        return " || ".join(lit)

    arms = " ".join(f"WHEN {k} THEN {made(s)}" for k, s in SNIPPETS.items())
    return f"code AS (SELECT l_orderkey, l_linenumber, CASE {PICK} {arms} END AS code FROM lineitem)"


def synth_code(spark, sf_dir):
    rows = spread(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"))
    k, q = (F.col("l_orderkey") % 7).cast("string"), F.col("l_quantity").cast("int").cast("string")
    pick, made = F.expr(PICK), None
    for n, s in SNIPPETS.items():
        text = s.replace("{{", "{").replace("}}", "}").replace("{k}", "\0k\0").replace("{q}", "\0q\0")
        value = F.concat(*[{"k": k, "q": q}.get(p, F.lit(p)) for p in text.split("\0") if p])
        made = F.when(pick == n, value) if made is None else made.when(pick == n, value)
    return rows.select("l_orderkey", "l_linenumber", made.alias("code"))


def sql_count(pattern: str, flags: str = "") -> str:
    pattern = pattern.replace("(?i)", "").replace("'", "''")
    return f"CAST(len(regexp_extract_all(code, '{'(?i)' if flags else ''}{pattern}')) AS BIGINT)"


def sql_rule_counts() -> dict[str, str]:
    out = {f"{n}_count": " + ".join(sql_count(p) for p in ps) for n, (_, ps) in risk.DEFAULT_RULES.items()}
    names = sorted({f for fs, _ in risk.DEFAULT_RULES.values() for f in fs})
    out["dangerous_function_count"] = sql_count(rf"\b(?:{'|'.join(names)})\s*\(")
    return out | {k: sql_count(p) for k, p in risk.STRUCTURE.items()}


COUNTS = ", ".join(f"{v} AS {k}" for k, v in sql_rule_counts().items())
RAW = " + ".join(f"{w} * {k}" for k, w in risk.WEIGHTS.items())


@registered(f"WITH {sql_code()} SELECT l_orderkey, l_linenumber, {COUNTS} FROM code")
def rule_counts(spark, sf_dir):
    return synth_code(spark, sf_dir).select("l_orderkey", "l_linenumber", *[c.alias(k) for k, c in risk.rule_counts(F.col("code")).items()])


@registered(f"""WITH {sql_code()}, n AS (SELECT l_orderkey, l_linenumber, {COUNTS} FROM code),
    s AS (SELECT l_orderkey, l_linenumber, round(1.0::DOUBLE - 1.0::DOUBLE / (1.0::DOUBLE + greatest(({RAW})::DOUBLE, 0) * 0.1::DOUBLE), 3) AS risk_score FROM n)
    SELECT *, CASE WHEN risk_score >= 0.7 THEN 'high' WHEN risk_score >= 0.4 THEN 'medium' WHEN risk_score > 0 THEN 'low' ELSE 'none' END AS risk_level FROM s""")
def risk_score_level(spark, sf_dir):
    n = synth_code(spark, sf_dir).select("l_orderkey", "l_linenumber", *[c.alias(k) for k, c in risk.rule_counts(F.col("code")).items()])
    s = n.select("l_orderkey", "l_linenumber", risk.risk_score({k: F.col(k) for k in risk.WEIGHTS}).alias("risk_score"))
    return s.withColumn("risk_level", risk.risk_level(F.col("risk_score")))


@registered(f"""WITH {sql_code()}, lines AS (SELECT l_orderkey, l_linenumber, unnest(string_split(code, chr(10))) AS line_text, unnest(range(1, 1 + len(string_split(code, chr(10))))) AS line FROM code),
    rules(category, idx, pattern) AS (VALUES {", ".join(f"('{n}', {i}, '{p.replace(chr(39), chr(39) * 2)}')" for n, (_, ps) in risk.DEFAULT_RULES.items() for i, p in enumerate(ps))})
    SELECT l_orderkey, l_linenumber, category, idx, line, regexp_extract(line_text, pattern, 0) AS matched FROM lines, rules WHERE regexp_matches(line_text, pattern)""")
def rule_detect_lines(spark, sf_dir):
    code = synth_code(spark, sf_dir).select("l_orderkey", "l_linenumber", F.posexplode(F.split("code", "\n")).alias("p", "line_text"))
    hits = [
        F.when(F.col("line_text").rlike(p), F.struct(F.lit(n).alias("category"), F.lit(i).alias("idx"), F.regexp_extract("line_text", p, 0).alias("matched")))
        for n, (_, ps) in risk.DEFAULT_RULES.items()
        for i, p in enumerate(ps)
    ]
    found = code.select("l_orderkey", "l_linenumber", (F.col("p") + 1).alias("line"), F.explode(F.filter(F.array(*hits), lambda h: h.isNotNull())).alias("h"))
    return found.select("l_orderkey", "l_linenumber", "h.category", "h.idx", "line", "h.matched")


SQL_COUNTED = ", ".join(f"{sql_count(p, 'i' if '(?i)' in p else '')} AS n_{k}" for k, p in risk.COUNTED.items())
SQL_FLAGS = ", ".join(
    f"CAST(regexp_matches(code, '{p.replace(chr(39), chr(39) * 2)}')" + (f" AND NOT regexp_matches(code, '{g}')" if g else "") + f" AS INTEGER) AS h_{k}"
    for k, (p, g, _, _) in risk.HAZARDS.items()
    if k not in ("unchecked_malloc", "potential_double_free")
)


@registered(f"WITH {sql_code()} SELECT l_orderkey, l_linenumber, {SQL_COUNTED}, {SQL_FLAGS} FROM code")
def hazard_flags(spark, sf_dir):
    code = synth_code(spark, sf_dir)
    counted = [risk.count(F.col("code"), p).alias(f"n_{k}") for k, p in risk.COUNTED.items()]
    flags = [h.cast("int").alias(f"h_{k}") for k, h in risk.hazards(F.col("code")).items() if k not in ("unchecked_malloc", "potential_double_free")]
    return code.select("l_orderkey", "l_linenumber", *counted, *flags)


@registered()
def feature_vector_v3(spark, sf_dir):
    first, second = risk.feature_columns(F.col("code"))
    return synth_code(spark, sf_dir).select("l_orderkey", "l_linenumber", *first).select("l_orderkey", "l_linenumber", *second)


@registered(f"""WITH {sql_code()} SELECT l_orderkey, count(*) AS n_functions, count(*) FILTER (regexp_matches(code, '\\b(strcpy|strcat|gets|free)\\s*\\(')) AS n_flagged,
    max(CAST(len({sql_tokens('code')}) AS BIGINT)) AS most_tokens FROM code GROUP BY l_orderkey""")
def file_rollup(spark, sf_dir):
    code = synth_code(spark, sf_dir)
    return code.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n_functions"), F.count_if(F.col("code").rlike(r"\b(strcpy|strcat|gets|free)\s*\(")).alias("n_flagged"), F.max(F.size(tokens(F.col("code")))).cast("long").alias("most_tokens")
    )


@registered(f"""WITH {sql_code()} SELECT l_orderkey, l_linenumber, CAST(substr(sha256('VULN001:' || l_orderkey || ':' || l_linenumber), 1, 32) AS VARCHAR) AS fingerprint,
    'order_' || l_orderkey || '.c' AS uri FROM code WHERE regexp_matches(code, '\\b(strcpy|gets)\\s*\\(')""")
def finding_fingerprints(spark, sf_dir):
    hit = synth_code(spark, sf_dir).filter(F.col("code").rlike(r"\b(strcpy|gets)\s*\("))
    key = F.concat_ws(":", F.lit("VULN001"), F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    return hit.select("l_orderkey", "l_linenumber", F.substring(F.sha2(key, 256), 1, 32).alias("fingerprint"), F.concat(F.lit("order_"), F.col("l_orderkey").cast("string"), F.lit(".c")).alias("uri"))


STRING_KINDS = {
    "SQL": r"(?i)\b(select|insert|update|delete)\b.+\b(from|into|set|where)\b", "URL": r"(?i)^(https?|ftp)://", "PATH": r"^(/|\./|\.\./|[A-Za-z]:\\)", "CRED": r"(?i)(password|passwd|secret|token|api_?key)",
    "EMAIL": r"^[^@\s]+@[^@\s]+\.[A-Za-z]+$", "IP": r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$",
}


@registered(r"""WITH s AS (SELECT page_id, unnest(regexp_extract_all(html, '"([^"\n]*)"', 1)) AS s FROM pages)
    SELECT page_id, """ + "CASE " + " ".join(f"WHEN regexp_matches(s, '{p}') THEN '{k}'" for k, p in STRING_KINDS.items()) + """ ELSE 'STR' END AS kind, count(*) AS n FROM s GROUP BY ALL""")
def string_category(spark, sf_dir):
    s = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'"([^"\n]*)"'), F.lit(1))).alias("s"))
    kind = None
    for k, p in STRING_KINDS.items():
        hit = F.col("s").rlike(p)
        kind = F.when(hit, k) if kind is None else kind.when(hit, k)
    return s.groupBy("page_id", kind.otherwise("STR").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@registered(r"""WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '\b[0-9]+\b')) AS t FROM pages), d AS (SELECT page_id, CASE WHEN len(t) > 18 THEN NULL ELSE CAST(t AS BIGINT) END AS v FROM t)
    SELECT page_id, CASE WHEN v IS NULL OR v > 4294967295 THEN 'NUM_LARGE' WHEN v > 65535 THEN 'NUM_32BIT' WHEN v > 255 THEN 'NUM_16BIT' ELSE 'NUM_8BIT' END AS kind, count(*) AS n FROM d GROUP BY ALL""")
def number_policy(spark, sf_dir):
    t = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r"\b[0-9]+\b"), F.lit(0))).alias("t"))
    v = F.when(F.length("t") <= 18, F.col("t").try_cast("long"))
    kind = F.when(v.isNull() | (v > 4294967295), "NUM_LARGE").when(v > 65535, "NUM_32BIT").when(v > 255, "NUM_16BIT").otherwise("NUM_8BIT")
    return t.groupBy("page_id", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))
