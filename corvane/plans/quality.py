"""Profiling and cleaning queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality as q
from .registry import registered, table

SPLIT = "CASE WHEN doc_id % 10 = 8 THEN 'validation' WHEN doc_id % 10 = 9 THEN 'test' ELSE 'train' END"


def split_docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang", q.split_of(F.col("doc_id")).alias("split"))


@registered("SELECT quality, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 4) AS ratio FROM labels GROUP BY quality")
def label_distribution(spark, sf_dir):
    n = table(spark, sf_dir, "labels").groupBy("quality").agg(F.count(F.lit(1)).alias("n"))
    return n.join(F.broadcast(n.agg(F.sum("n").alias("t")))).select("quality", "n", F.round(F.col("n") / F.col("t"), 4).alias("ratio"))


STATS = """CAST(min(x) AS BIGINT) AS min_len, CAST(max(x) AS BIGINT) AS max_len, round(avg(x), 2) AS mean_len,
    round(median(x), 2) AS median_len, round(stddev_samp(x), 2) AS std_len"""


@registered(f"SELECT lang, {STATS} FROM (SELECT lang, len(text) AS x FROM documents) GROUP BY lang")
def length_stats(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(*q.length_stats(F.length("text")))


@registered(f"SELECT lang, {STATS} FROM (SELECT lang, len(string_split(text, chr(10))) AS x FROM documents) GROUP BY lang")
def lines_stats(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(*q.length_stats(F.size(F.split("text", "\n"))))


@registered("SELECT source, count(*) AS n, count(DISTINCT lang) AS n_lang FROM documents GROUP BY source")
def source_distribution(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("lang").alias("n_lang"))


@registered(f"""SELECT split, grouping(split) AS overall, count(*) AS n, {STATS} FROM (SELECT {SPLIT} AS split, len(text) AS x FROM documents)
    GROUP BY GROUPING SETS ((split), ())""")
def eda_grouping_sets(spark, sf_dir):
    docs = split_docs(spark, sf_dir).select("split", F.length("text").alias("x"))
    agg = docs.groupingSets([("split",), ()], "split").agg(F.grouping("split").cast("long").alias("overall"), F.count(F.lit(1)).alias("n"), *q.length_stats(F.col("x")))
    return agg


@registered("""SELECT reason, count(*) AS n FROM (SELECT CASE WHEN text IS NULL THEN 'null' WHEN text = '' THEN 'empty' WHEN trim(text) = '' THEN 'blank' ELSE 'valid' END AS reason
    FROM (SELECT nullif(substr(text, strpos(text || chr(10), chr(10)) + 1), '.') AS text FROM documents)) GROUP BY reason""")
def invalid_rows(spark, sf_dir):
    """Texts behind the first line break: many are empty."""
    text = F.nullif(F.expr("substr(text, instr(concat(text, '\\n'), '\\n') + 1)"), F.lit("."))
    return table(spark, sf_dir, "documents").select(q.invalid_reason(text).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@registered("SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def keep_first_rows(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("key"), "doc_id", "source")
    return q.keep_first(docs, ["key"], "doc_id").select("doc_id", "source")


@registered(f"SELECT split, count(*) - count(DISTINCT text) AS n_duplicates FROM (SELECT {SPLIT} AS split, text FROM documents) GROUP BY split")
def internal_dup_counts(spark, sf_dir):
    docs = split_docs(spark, sf_dir).select("split", F.sha2("text", 256).alias("key"))
    return docs.groupBy("split").agg((F.count(F.lit(1)) - F.count_distinct("key")).alias("n_duplicates"))


@registered(f"""WITH d AS (SELECT DISTINCT {SPLIT} AS split, text FROM documents)
    SELECT a.split AS first_split, b.split AS second_split, count(*) AS n_shared FROM d a JOIN d b ON a.text = b.text AND a.split < b.split GROUP BY ALL""")
def split_overlap(spark, sf_dir):
    d = split_docs(spark, sf_dir).select("split", F.sha2("text", 256).alias("key")).distinct()
    both = d.select(F.col("split").alias("first_split"), "key").join(d.select(F.col("split").alias("second_split"), "key"), "key")
    return both.filter("first_split < second_split").groupBy("first_split", "second_split").agg(F.count(F.lit(1)).alias("n_shared"))


@registered(f"""WITH d AS (SELECT doc_id, text, {SPLIT} AS split FROM documents)
    SELECT doc_id, split FROM d WHERE split = 'train'
       OR (split = 'validation' AND text NOT IN (SELECT text FROM d WHERE split = 'train'))
       OR (split = 'test' AND text NOT IN (SELECT text FROM d WHERE split <> 'test'))""")
def leakage_removed(spark, sf_dir):
    d = split_docs(spark, sf_dir).select("doc_id", "split", F.sha2("text", 256).alias("key"))
    return q.leakage_removed(d, "split", "key").select("doc_id", "split")


@registered("""WITH d AS (SELECT doc_id, quality, string_split(text, ' ')[1] AS key FROM documents JOIN labels USING (doc_id)),
    g AS (SELECT key, min(doc_id) AS doc_id FROM d GROUP BY key HAVING min(quality) = max(quality))
    SELECT doc_id, key, quality FROM g JOIN d USING (doc_id, key)""")
def label_conflicts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    d = d.select("doc_id", "quality", F.split("text", " ")[0].alias("key"))
    return q.without_conflicts(d, "key", "quality", "doc_id").select("doc_id", "key", "quality")


@registered("""WITH d AS (SELECT quality, string_split(text, ' ')[1] AS key FROM documents JOIN labels USING (doc_id)),
    g AS (SELECT key, count(*) AS n, min(quality) <> max(quality) AS clash FROM d GROUP BY key)
    SELECT count(*) FILTER (clash) AS n_conflicts, CAST(coalesce(sum(n) FILTER (clash), 0) AS BIGINT) AS n_removed,
           CAST(coalesce(sum(n - 1) FILTER (NOT clash), 0) AS BIGINT) AS n_duplicates FROM g""")
def conflict_stats(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("quality", F.split("text", " ")[0].alias("key"))
    g = d.groupBy("key").agg(F.count(F.lit(1)).alias("n"), (F.min("quality") != F.max("quality")).alias("clash"))
    total = lambda x, on: F.coalesce(F.sum(F.when(on, x)), F.lit(0)).cast("long")
    clash = F.col("clash")
    return g.agg(F.count_if(clash).alias("n_conflicts"), total(F.col("n"), clash).alias("n_removed"), total(F.col("n") - 1, ~clash).alias("n_duplicates"))


@registered("""SELECT doc_id, quality, CASE WHEN pos < floor(n * 0.8) THEN 'train' WHEN pos < floor(n * 0.9) THEN 'validation' ELSE 'test' END AS part
    FROM (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY md5(CAST(doc_id AS VARCHAR) || ':42'), doc_id) - 1 AS pos, count(*) OVER (PARTITION BY quality) AS n FROM labels)""")
def stratified_split(spark, sf_dir):
    order = F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(":42")).cast("binary"))
    ranked = q.stratified_rank(table(spark, sf_dir, "labels"), "quality", order)
    part = F.when(F.col("_at") < F.floor(F.col("_n") * 0.8), "train").when(F.col("_at") < F.floor(F.col("_n") * 0.9), "validation").otherwise("test")
    return ranked.select("doc_id", "quality", part.alias("part"))


@registered("""WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label)
    SELECT label, n, round(sum(n) OVER () / (count(*) OVER () * n), 6) AS balanced,
           round(1.0::DOUBLE / n / sum(1.0::DOUBLE / n) OVER () * count(*) OVER (), 6) AS inverse,
           round(1 / sqrt(n) / sum(1 / sqrt(n)) OVER () * count(*) OVER (), 6) AS sqrt_inverse FROM c""")
def class_weights(spark, sf_dir):
    return q.class_weights(table(spark, sf_dir, "embeddings"), "label")


@registered("""SELECT round(count(*) FILTER (toxic = 0) / nullif(count(*) FILTER (toxic = 1), 0), 6) AS pos_weight,
    round(count(*) / (2 * count(*) FILTER (toxic = 0)), 6) AS weight_negative, round(count(*) / (2 * count(*) FILTER (toxic = 1)), 6) AS weight_positive FROM labels""")
def positive_weight(spark, sf_dir):
    neg, pos, n = F.count_if(F.col("toxic") == 0), F.count_if(F.col("toxic") == 1), F.count(F.lit(1))
    return table(spark, sf_dir, "labels").agg(
        F.round(F.try_divide(neg, pos), 6).alias("pos_weight"), F.round(F.try_divide(n, 2 * neg), 6).alias("weight_negative"), F.round(F.try_divide(n, 2 * pos), 6).alias("weight_positive")
    )


@registered("""WITH s AS (SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq, avg(l_extendedprice) AS mp, stddev_pop(l_extendedprice) AS sp FROM lineitem WHERE l_orderkey % 10 < 8)
    SELECT l_orderkey, l_linenumber, round((l_quantity - mq) / sq, 5) AS quantity_z, round((l_extendedprice - mp) / sp, 5) AS price_z FROM lineitem, s""")
def zscore_train_fit(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    z = q.standardised(rows, ["l_quantity", "l_extendedprice"], F.col("l_orderkey") % 10 < 8)
    return z.select("l_orderkey", "l_linenumber", F.round("l_quantity_z", 5).alias("quantity_z"), F.round("l_extendedprice_z", 5).alias("price_z"))


@registered("""SELECT l_orderkey, l_linenumber, round(sign(x) * ln(1 + abs(x)), 6) AS logged, greatest(-5.0, least(5.0, x / 1000)) AS clipped
    FROM (SELECT l_orderkey, l_linenumber, l_extendedprice - 30000 AS x FROM lineitem)""")
def log_clip_transform(spark, sf_dir):
    x = F.col("l_extendedprice") - 30000
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(F.signum(x) * F.log1p(F.abs(x)), 6).alias("logged"), F.greatest(F.lit(-5.0), F.least(F.lit(5.0), x / 1000)).alias("clipped")
    )
