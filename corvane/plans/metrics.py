"""Evaluation queries: labels against a score made from document lengths."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as m
from .registry import registered, table

SCORED = """scored AS (SELECT doc_id, quality AS label, toxic, round(1 - exp(-len(text) / 3000.0::DOUBLE), 3) AS score, len(text) AS x, lang
    FROM documents JOIN labels USING (doc_id))"""


def scored(spark, sf_dir):
    both = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    n = F.length("text")
    return both.select("doc_id", F.col("quality").alias("label"), "toxic", F.round(1 - F.exp(-n / 3000.0), 3).alias("score"), n.alias("x"), "lang")


COUNTS = """count(*) FILTER (label = 1 AND {hit}) AS tp, count(*) FILTER (label = 0 AND {hit}) AS fp,
    count(*) FILTER (label = 1 AND NOT ({hit})) AS fn, count(*) FILTER (label = 0 AND NOT ({hit})) AS tn"""
RATES = """round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 6) AS recall,
    round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0), 6) AS f1, round(coalesce((tp + tn) / nullif(tp + fp + fn + tn, 0)::DOUBLE, 0), 6) AS accuracy,
    round(sqrt(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) * coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0)), 6) AS balanced,
    round(coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0), 6) AS mcc,
    round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) + coalesce(tn / nullif(tn + fp, 0)::DOUBLE, 0) - 1, 6) AS youden"""


@registered(f"WITH {SCORED}, c AS (SELECT lang, {COUNTS.format(hit='score >= 0.5')} FROM scored GROUP BY lang) SELECT lang, tp, fp, fn, tn, {RATES} FROM c")
def confusion_metrics(spark, sf_dir):
    return scored(spark, sf_dir).groupBy("lang").agg(*m.confusion(F.col("label"), F.col("score") >= 0.5)).select("lang", "tp", "fp", "fn", "tn", *m.rates())


@registered(f"""WITH {SCORED}, r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS r FROM scored)
    SELECT round((sum(r) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0::DOUBLE)
        / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0)), 6) AS auc,
        count(*) FILTER (label = 1) AS n_pos, count(*) FILTER (label = 0) AS n_neg FROM r""")
def roc_auc(spark, sf_dir):
    return m.roc_auc(scored(spark, sf_dir), "label", "score")


GRID = "grid AS (SELECT round(0.1 + k * 0.01, 4) AS threshold FROM (SELECT unnest(range(81)) AS k))"


@registered(f"""WITH {SCORED}, {GRID}, c AS (SELECT threshold, {COUNTS.format(hit='score >= threshold - 1e-9')} FROM scored, grid GROUP BY threshold)
    SELECT threshold, tp, fp, fn, tn, {RATES} FROM c""")
def threshold_sweep(spark, sf_dir):
    return m.threshold_sweep(scored(spark, sf_dir), "label", "score", 0.1, 0.01, 81)


@registered(f"""WITH {SCORED}, {GRID}, c AS (SELECT threshold, {COUNTS.format(hit='score >= threshold - 1e-9')} FROM scored, grid GROUP BY threshold),
    r AS (SELECT threshold, tp + fp AS hits, tp + fp + fn + tn AS n, {RATES} FROM c),
    u AS (UNPIVOT r ON f1, precision, recall, balanced, mcc, youden INTO NAME metric VALUE value)
    SELECT metric, threshold, value FROM u WHERE hits > 0 AND hits < n QUALIFY row_number() OVER (PARTITION BY metric ORDER BY value DESC, threshold) = 1""")
def best_thresholds(spark, sf_dir):
    sweep = m.threshold_sweep(scored(spark, sf_dir), "label", "score", 0.1, 0.01, 81).filter("tp + fp > 0 and fn + tn > 0")
    names = ["f1", "precision", "recall", "balanced", "mcc", "youden"]
    long = sweep.unpivot(["threshold"], names, "metric", "value")
    best = long.groupBy("metric").agg(F.max(F.struct("value", -F.col("threshold"))).alias("b"))
    return best.select("metric", (-F.col("b")["col2"]).alias("threshold"), F.col("b")["value"].alias("value"))


@registered(f"""WITH {SCORED}, t AS (SELECT label, string_split(text, ' ') AS w FROM documents JOIN (SELECT doc_id, label FROM scored) USING (doc_id)),
    c AS (SELECT token, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM (SELECT label, unnest(w) AS token FROM t) GROUP BY token HAVING count(*) >= 50)
    SELECT token, pos, neg, round((pos + 1) / (neg + 1)::DOUBLE, 6) AS ratio FROM c""")
def token_class_ratio(spark, sf_dir):
    t = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select(F.col("quality").alias("label"), F.explode(F.split("text", " ")).alias("token"))
    c = t.groupBy("token").agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg")).filter("pos + neg >= 50")
    return c.select("token", "pos", "neg", F.round((F.col("pos") + 1) / (F.col("neg") + 1), 6).alias("ratio"))


@registered(f"""WITH {SCORED}, d AS (SELECT x, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM scored GROUP BY x),
    g AS (SELECT abs(sum(pos) OVER (ORDER BY x) / sum(pos) OVER () - sum(neg) OVER (ORDER BY x) / sum(neg) OVER ()) AS gap FROM d)
    SELECT round(max(gap), 6) AS ks FROM g""")
def ks_statistic(spark, sf_dir):
    return m.ks_statistic(scored(spark, sf_dir), "label", "x")


@registered(f"""WITH {SCORED}, s AS (SELECT count(*) FILTER (label = 1) AS n1, count(*) FILTER (label = 0) AS n0, avg(x) FILTER (label = 1) AS m1, avg(x) FILTER (label = 0) AS m0,
    var_samp(x) FILTER (label = 1) AS v1, var_samp(x) FILTER (label = 0) AS v0 FROM scored)
    SELECT n1, n0, round(m1, 4) AS mean1, round(m0, 4) AS mean0, round(sqrt(v1), 4) AS std1, round(sqrt(v0), 4) AS std0, round((m1 - m0) / sqrt(v1 / n1 + v0 / n0), 5) AS t FROM s""")
def t_statistic(spark, sf_dir):
    return m.welch_t(scored(spark, sf_dir), "label", "x")


@registered(f"""WITH {SCORED}, b AS (SELECT least(29, CAST(floor((x - lo) * 30 / nullif(hi - lo, 0)::DOUBLE) AS INTEGER)) AS bin FROM scored, (SELECT min(x) AS lo, max(x) AS hi FROM scored))
    SELECT bin, count(*) AS n, CAST(sum(count(*)) OVER (ORDER BY bin) AS BIGINT) AS cumulative FROM b GROUP BY bin""")
def histogram_cdf(spark, sf_dir):
    from pyspark.sql import Window as W

    rows = scored(spark, sf_dir)
    edges = rows.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    bin_ = F.least(F.lit(29), F.floor(F.try_divide((F.col("x") - F.col("lo")) * 30, F.col("hi") - F.col("lo"))).cast("int"))
    n = rows.join(F.broadcast(edges)).groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("cumulative", F.sum("n").over(W.orderBy("bin")))  # thirty rows


@registered(f"""WITH {SCORED}, o AS (SELECT *, CASE WHEN label = 1 AND score >= 0.5 THEN 'TP' WHEN label = 1 THEN 'FN' WHEN score >= 0.5 THEN 'FP' ELSE 'TN' END AS outcome FROM scored)
    SELECT outcome, count(*) AS n, round(avg(x), 4) AS mean_chars, round(avg(score), 5) AS mean_score, round(median(score), 5) AS median_score,
           round(coalesce(stddev_samp(score), 0), 5) AS std_score FROM o GROUP BY outcome""")
def outcome_means(spark, sf_dir):
    hit, yes = F.col("score") >= 0.5, F.col("label") == 1
    outcome = F.when(yes & hit, "TP").when(yes, "FN").when(hit, "FP").otherwise("TN")
    return scored(spark, sf_dir).groupBy(outcome.alias("outcome")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("x"), 4).alias("mean_chars"), F.round(F.avg("score"), 5).alias("mean_score"),
        F.round(F.median("score"), 5).alias("median_score"), F.round(F.coalesce(F.stddev_samp("score"), F.lit(0.0)), 5).alias("std_score"),
    )


@registered(f"""WITH {SCORED}, o AS (SELECT doc_id, score, CASE WHEN label = 0 AND score >= 0.5 THEN 'FP' WHEN label = 1 AND score < 0.5 THEN 'FN' END AS outcome FROM scored)
    SELECT outcome, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY outcome ORDER BY CASE WHEN outcome = 'FP' THEN -score ELSE score END, doc_id) AS r
    FROM o WHERE outcome IS NOT NULL) WHERE r <= 5""")
def most_confident_errors(spark, sf_dir):
    rows = scored(spark, sf_dir)
    fp = rows.filter("label = 0 and score >= 0.5").orderBy(F.desc("score"), "doc_id").limit(5).select(F.lit("FP").alias("outcome"), "doc_id", "score")
    fn = rows.filter("label = 1 and score < 0.5").orderBy("score", "doc_id").limit(5).select(F.lit("FN").alias("outcome"), "doc_id", "score")
    return fp.unionByName(fn)


@registered("""WITH v AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS pos FROM embeddings),
    c AS (SELECT label, pos, avg(x) AS c, var_pop(x) AS v, count(*) AS n FROM v GROUP BY label, pos),
    o AS (SELECT pos, sum(c * n) / sum(n) AS m FROM c GROUP BY pos)
    SELECT pos, round(sum(n * (c - m) * (c - m)) / nullif(sum(n * v), 0), 6) AS fisher FROM c JOIN o USING (pos) GROUP BY pos""")
def centroid_fisher(spark, sf_dir):
    x = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x")).withColumn("x", F.col("x").cast("double"))
    c = x.groupBy("label", "pos").agg(F.avg("x").alias("c"), F.var_pop("x").alias("v"), F.count(F.lit(1)).alias("n"))
    o = c.groupBy("pos").agg((F.sum(F.col("c") * F.col("n")) / F.sum("n")).alias("m"))
    gap = F.col("c") - F.col("m")
    return c.join(o, "pos").groupBy("pos").agg(F.round(F.try_divide(F.sum(F.col("n") * gap * gap), F.sum(F.col("n") * F.col("v"))), 6).alias("fisher")).withColumn("pos", F.col("pos").cast("long"))


@registered("""WITH v AS (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS pos, vec_id FROM embeddings),
    c AS (SELECT label, pos, avg(x) AS c FROM v GROUP BY label, pos),
    s AS (SELECT vec_id, c.label AS centre, v.label AS label, sum(x * c) / nullif(sqrt(sum(x * x)) * sqrt(sum(c * c)), 0) AS cosine FROM v JOIN c USING (pos) GROUP BY ALL)
    SELECT label, round(avg(cosine) FILTER (label = centre), 5) AS intra, round(avg(cosine) FILTER (label <> centre), 5) AS inter,
           round(avg(cosine) FILTER (label = centre) - avg(cosine) FILTER (label <> centre), 5) AS gap FROM s GROUP BY label""")
def cosine_intra_inter(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))
    c = e.select("label", F.posexplode("e").alias("pos", "x")).groupBy("label", "pos").agg(F.avg("x").alias("c"))
    centres = c.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "c"))), lambda p: p["c"]).alias("centre"))
    every = centres.agg(F.collect_list(F.struct("label", "centre")).alias("centres"))  # a row for each class
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    s = e.join(F.broadcast(every)).select("label", "e", F.explode("centres").alias("c"))
    s = s.select("label", F.col("c.label").alias("centre"), F.try_divide(dot("e", "c.centre"), F.sqrt(dot("e", "e")) * F.sqrt(dot("c.centre", "c.centre"))).alias("cosine"))
    own = F.col("label") == F.col("centre")
    intra, inter = F.avg(F.when(own, F.col("cosine"))), F.avg(F.when(~own, F.col("cosine")))
    return s.groupBy("label").agg(F.round(intra, 5).alias("intra"), F.round(inter, 5).alias("inter"), F.round(intra - inter, 5).alias("gap"))


@registered(f"""WITH {SCORED}, a AS (SELECT CAST(doc_id % 5 AS INTEGER) AS seed, {COUNTS.format(hit='score >= 0.5')} FROM scored GROUP BY 1),
    r AS (SELECT seed, 2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE AS f1 FROM a)
    SELECT round(avg(f1), 6) AS mean_f1, round(stddev_pop(f1), 6) AS std_f1, round(max(f1), 6) AS best_f1, CAST(arg_max(seed, f1) AS BIGINT) AS best_seed FROM r""")
def seed_aggregation(spark, sf_dir):
    a = scored(spark, sf_dir).groupBy((F.col("doc_id") % 5).alias("seed")).agg(*m.confusion(F.col("label"), F.col("score") >= 0.5))
    r = a.select("seed", F.try_divide(2 * F.col("tp").cast("double"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))
    return r.agg(F.round(F.avg("f1"), 6).alias("mean_f1"), F.round(F.stddev_pop("f1"), 6).alias("std_f1"), F.round(F.max("f1"), 6).alias("best_f1"), F.max_by("seed", "f1").alias("best_seed"))


@registered(f"""WITH {SCORED}, p AS (SELECT doc_id, score AS a, least(1.0, score + 0.1) AS b, score * score AS c FROM scored)
    SELECT doc_id, round((a + b + c) / 3, 6) AS probability,
      CASE WHEN (a + b + c) / 3 >= 0.9 THEN 'CRITICAL' WHEN (a + b + c) / 3 >= 0.75 THEN 'HIGH' WHEN (a + b + c) / 3 >= 0.5 THEN 'MEDIUM' WHEN (a + b + c) / 3 >= 0.25 THEN 'LOW' ELSE 'NONE' END AS risk_level,
      round(abs((a + b + c) / 3 - 0.5) * 2, 6) AS confidence FROM p""")
def ensemble_scores(spark, sf_dir):
    from ..functions.risk import risk_band

    s = F.col("score")
    p = (s + F.least(F.lit(1.0), s + 0.1) + s * s) / 3
    return scored(spark, sf_dir).select("doc_id", F.round(p, 6).alias("probability"), risk_band(p).alias("risk_level"), F.round(F.abs(p - 0.5) * 2, 6).alias("confidence"))
