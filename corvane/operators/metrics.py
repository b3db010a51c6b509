"""Classifier evaluation as aggregates: confusion counts, ranking metrics and threshold sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def confusion(label: Column, predicted: Column) -> list[Column]:
    return [
        F.count_if((label == 1) & predicted).alias("tp"),
        F.count_if((label == 0) & predicted).alias("fp"),
        F.count_if((label == 1) & ~predicted).alias("fn"),
        F.count_if((label == 0) & ~predicted).alias("tn"),
    ]


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


def rates(digits: int = 6) -> list[Column]:
    """Precision, recall, F1, accuracy, balanced, MCC and Youden's J from tp, fp, fn, tn; 0 where undefined."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    mcc = ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))
    named = {
        "precision": p, "recall": r, "f1": ratio(2 * tp, 2 * tp + fp + fn), "accuracy": ratio(tp + tn, tp + fp + fn + tn),
        "balanced": F.sqrt(p * r), "mcc": mcc, "youden": r + ratio(tn, tn + fp) - 1,
    }
    return [F.round(v, digits).alias(k) for k, v in named.items()]


def at_score(rows: DataFrame, label: str, score: str) -> DataFrame:
    """(score, pos, neg): the rows of each distinct score, combined map-side."""
    return rows.groupBy(F.col(score).alias("score")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))


def roc_auc(rows: DataFrame, label: str, score: str, bins: int = 64) -> DataFrame:
    """Tie-aware area under the ROC curve (0.5 with one class).

    Negatives below a score are counted over ranges of scores: each range's own running sum plus the sums
    of the ranges before it, so no single task sees all distinct scores.
    """
    per = at_score(rows, label, score)
    lo, hi = F.min("score"), F.max("score")
    edges = per.agg(lo.alias("_lo"), hi.alias("_hi"))
    cut = per.join(F.broadcast(edges)).withColumn("_bin", F.least(F.floor(ratio(F.col("score") - F.col("_lo"), F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1)))
    starts = cut.groupBy("_bin").agg(F.sum("neg").alias("_n")).withColumn("_before", F.sum("_n").over(W.orderBy("_bin")) - F.col("_n")).drop("_n")
    below = F.sum("neg").over(W.partitionBy("_bin").orderBy("score")) - F.col("neg")
    won = cut.withColumn("_below", below).join(F.broadcast(starts), "_bin")
    wins = F.sum(F.col("pos") * (F.col("_below") + F.col("_before") + F.col("neg") / 2))
    n_pos, n_neg = F.sum("pos"), F.sum("neg")
    return won.agg(F.round(F.coalesce(F.try_divide(wins, n_pos * n_neg), F.lit(0.5)), 6).alias("auc"), n_pos.alias("n_pos"), n_neg.alias("n_neg"))


def threshold_sweep(rows: DataFrame, label: str, score: str, low: float, step: float, count: int) -> DataFrame:
    """Confusion counts and rates at each threshold, score >= threshold being positive.

    Each row falls into the band of the last threshold it meets; the bands are summed once, and a
    threshold's counts are the sums of the bands above it. The rows are read once, not once per threshold.
    """
    band = F.greatest(F.lit(0), F.least(F.floor((F.col(score) - low) / step + 1 + 1e-9), F.lit(count))).cast("int")
    sums = rows.groupBy(band.alias("band")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    grid = rows.sparkSession.range(0, count + 1).select(F.col("id").cast("int").alias("band"))
    every, above = W.partitionBy(), W.orderBy(F.desc("band"))
    full = grid.join(F.broadcast(sums), "band", "left").na.fill(0)  # a row per threshold
    full = full.select("band", F.sum("p").over(above).alias("tp"), F.sum("n").over(above).alias("fp"), F.sum("p").over(every).alias("_p"), F.sum("n").over(every).alias("_n"))
    full = full.filter("band > 0").withColumn("fn", F.col("_p") - F.col("tp")).withColumn("tn", F.col("_n") - F.col("fp"))
    return full.select(F.round(low + (F.col("band") - 1) * step, 4).alias("threshold"), "tp", "fp", "fn", "tn", *rates())


def ks_statistic(rows: DataFrame, label: str, value: str, bins: int = 256) -> DataFrame:
    """Largest distance between the two classes' cumulative distributions, over distinct values.

    Distinct values are cut at their approximate quantiles (any cuts give the same result); each range
    has its own running sums, which start at the sums of the ranges before it.
    """
    per = at_score(rows, label, value)
    cuts = sorted(set(per.approxQuantile("score", [k / bins for k in range(1, bins)], 1 / (4 * bins))))
    cut = per.withColumn("_bin", F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c <= F.col("score"))) if cuts else F.lit(0))
    sums = cut.groupBy("_bin").agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    every, before = W.partitionBy(), W.orderBy("_bin")
    running = [(F.sum(c).over(before) - F.col(c)).alias(f"{c}0") for c in ("_p", "_n")] + [F.sum(c).over(every).alias(f"{c}t") for c in ("_p", "_n")]
    at = cut.join(F.broadcast(sums.select("_bin", *running)), "_bin")  # a row per range
    up = W.partitionBy("_bin").orderBy("score")
    gap = F.abs((F.sum("pos").over(up) + F.col("_p0")) / F.col("_pt") - (F.sum("neg").over(up) + F.col("_n0")) / F.col("_nt"))
    return at.select(gap.alias("gap")).agg(F.round(F.max("gap"), 6).alias("ks"))


def welch_t(rows: DataFrame, label: str, value: str) -> DataFrame:
    """Means, sample deviations and Welch's t of a value between classes 1 and 0."""
    side = lambda f, k: f(F.when(F.col(label) == k, F.col(value)))
    m1, m0, v1, v0 = side(F.avg, 1), side(F.avg, 0), side(F.var_samp, 1), side(F.var_samp, 0)
    n1, n0 = F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)
    return rows.agg(
        n1.alias("n1"), n0.alias("n0"), F.round(m1, 4).alias("mean1"), F.round(m0, 4).alias("mean0"), F.round(F.sqrt(v1), 4).alias("std1"), F.round(F.sqrt(v0), 4).alias("std0"),
        F.round((m1 - m0) / F.sqrt(v1 / n1 + v0 / n0), 5).alias("t"),
    )
