"""Sampling and summary queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.risk import bound
from ..operators import samples as sm
from .code import sql_code, synth_code
from .lines import CRITERIA, criteria
from .registry import registered, table


def labelled(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")


LABELLED = "d AS (SELECT documents.*, quality, toxic FROM documents JOIN labels USING (doc_id))"


@registered(f"WITH {LABELLED} SELECT doc_id, source FROM d WHERE quality = 0 ORDER BY doc_id LIMIT 20")
def label_sample(spark, sf_dir):
    return sm.first_of_label(labelled(spark, sf_dir).select("doc_id", "source", "quality"), "quality", 0, "doc_id", 20).select("doc_id", "source")


@registered(f"WITH {LABELLED} SELECT doc_id, quality, CAST(floor((row_number() OVER (PARTITION BY quality ORDER BY doc_id) - 1) / 8) AS BIGINT) AS batch FROM d")
def balanced_batches(spark, sf_dir):
    return sm.balanced_batches(labelled(spark, sf_dir).select("doc_id", "quality"), "quality", "doc_id", 8)


@registered("""SELECT doc_id FROM (SELECT doc_id, round(-ln(((doc_id * 2654435761) % 4294967296 + 0.5) / 4294967296.0::DOUBLE) / CAST(n_chars AS DOUBLE), 12) AS k FROM documents WHERE n_chars > 0)
    ORDER BY k, doc_id LIMIT 50""")
def weighted_sample(spark, sf_dir):
    return sm.weighted_sample(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id", F.col("n_chars"), 50).select("doc_id")


@registered("""WITH t AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents), s AS (SELECT doc_id, w, greatest(CAST(ceil(len(w) / 6.0) AS BIGINT), 1) AS n FROM t),
    p AS (SELECT doc_id, k, w[k * n + 1 : (k + 1) * n] AS part FROM s, range(6) AS r(k))
    SELECT doc_id, CAST(k AS INTEGER) AS part, CAST(len(part) AS BIGINT) AS n_tokens, coalesce(array_to_string(part, ' '), '') AS tokens FROM p""")
def even_slices(spark, sf_dir):
    parts = sm.even_slices(F.split("text", " "), 6)
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(parts).alias("part", "t"))
    return rows.select("doc_id", "part", F.size("t").cast("long").alias("n_tokens"), F.array_join("t", " ").alias("tokens"))


@registered("""WITH b AS (SELECT conv_id, turn AS line, min(CASE role WHEN 'assistant' THEN 1 WHEN 'user' THEN 2 ELSE 0 END) AS priority FROM conversations GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY priority, line) AS place FROM b) SELECT conv_id, line, priority, CAST(place AS INTEGER) AS place FROM r WHERE place <= 3""")
def seed_lines(spark, sf_dir):
    priority = F.when(F.col("role") == "assistant", 1).when(F.col("role") == "user", 2).otherwise(0)
    return sm.seed_lines(table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("line"), priority.alias("priority")), "conv_id", 3).select("conv_id", "line", "priority", "place")


@registered("SELECT conv_id, first, last, min(role) AS kind FROM (SELECT conv_id, turn AS first, turn + len(coalesce(text, '')) % 3 AS last, role FROM conversations) GROUP BY ALL")
def token_spans(spark, sf_dir):
    end = F.col("turn") + F.length(F.coalesce("text", F.lit(""))) % 3
    c = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("start"), end.alias("end"), F.col("role").alias("kind"))
    return sm.spans_once(c, "conv_id").select("conv_id", F.col("start").alias("first"), F.col("end").alias("last"), "kind")


@registered(f"""WITH {LABELLED} SELECT count(*) AS n, count(*) FILTER (quality = 1) AS n_pos, count(*) FILTER (quality = 0) AS n_neg, round(count(*) FILTER (quality = 1) / count(*)::DOUBLE, 6) AS pos_share,
    round(avg(len(text)), 4) AS mean_len, CAST(min(len(text)) AS BIGINT) AS min_len, CAST(max(len(text)) AS BIGINT) AS max_len FROM d""")
def dataset_stats(spark, sf_dir):
    return sm.dataset_stats(labelled(spark, sf_dir), "quality", F.length("text"))


@registered(f"""WITH {CRITERIA} SELECT CAST(sum(len(hits)) AS BIGINT) AS n_lines, count(*) FILTER (len(hits) > 0) AS n_rows, round(avg(len(hits)) FILTER (len(hits) > 0), 4) AS mean_lines,
    CAST(max(len(hits)) FILTER (len(hits) > 0) AS BIGINT) AS max_lines FROM crit""")
def marked_line_stats(spark, sf_dir):
    return sm.marked_line_stats(criteria(spark, sf_dir), F.size("hits"))


PARTS = {"has_malloc": "malloc", "has_free": "free(", "has_strcpy": "strcpy", "has_printf": "printf", "has_null": "NULL", "has_if": "if (", "has_for": "for (", "has_while": "while (", "has_arrow": "->", "has_index": "["}


@registered(f"""WITH {sql_code()} SELECT l_linenumber, count(*) AS n, round(avg(len(code)), 4) AS mean_length,
    {", ".join(f"round(avg(CASE WHEN contains(code, '{p}') THEN 1.0 ELSE 0.0 END) * 100, 4) AS {k}" for k, p in PARTS.items())} FROM code GROUP BY l_linenumber""")
def pattern_percentages(spark, sf_dir):
    return sm.pattern_percentages(synth_code(spark, sf_dir), "code", PARTS, "l_linenumber")


@registered("SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM events GROUP BY event_type")
def logged_summary(spark, sf_dir):
    return sm.logged_summary(table(spark, sf_dir, "events"), "event_type", "value")


LEVELS = ("LOW", "MEDIUM", "HIGH", "CRITICAL")


@registered("""WITH l AS (SELECT CASE WHEN l_discount >= 0.08 THEN 'CRITICAL' WHEN l_discount >= 0.05 THEN 'HIGH' WHEN l_discount >= 0.03 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM lineitem)
    SELECT count(*) AS total, count(*) FILTER (level = 'LOW') AS low, count(*) FILTER (level = 'MEDIUM') AS medium, count(*) FILTER (level = 'HIGH') AS high, count(*) FILTER (level = 'CRITICAL') AS critical FROM l""")
def findings_summary(spark, sf_dir):
    d = F.col("l_discount")
    level = F.when(d >= 0.08, "CRITICAL").when(d >= 0.05, "HIGH").when(d >= 0.03, "MEDIUM").otherwise("LOW")
    return sm.level_counts(table(spark, sf_dir, "lineitem").select(level.alias("level")), "level", LEVELS)


ALIGNED = """t AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents), p AS (SELECT doc_id, unnest(range(1, len(w))) AS position, w FROM t),
    z AS (SELECT doc_id, position, w[position] AS a, w[position + 1] AS b FROM p)"""


def aligned(spark, sf_dir):
    pairs = bound(F.split("text", " "), lambda w: sm.zipped(w, F.slice(w, F.lit(2), F.size(w))))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(pairs).alias("p"))
    return rows.select("doc_id", "p.position", "p.a", "p.b")


@registered(f"WITH {ALIGNED} SELECT doc_id, a, arg_max(b, position) AS b FROM z GROUP BY doc_id, a")
def aligned_last(spark, sf_dir):
    return sm.mapped(aligned(spark, sf_dir), "doc_id", "a", "b", "position", last=True)


@registered(f"WITH {ALIGNED} SELECT doc_id, a, arg_min(b, position) AS b FROM z GROUP BY doc_id, a")
def aligned_first(spark, sf_dir):
    return sm.mapped(aligned(spark, sf_dir), "doc_id", "a", "b", "position", last=False)
