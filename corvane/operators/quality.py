"""Profiling, duplicates, leakage between splits, label conflicts, splits and weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def split_of(key: Column) -> Column:
    """The engine's convention for tables without a split column."""
    return F.when(key % 10 == 8, "validation").when(key % 10 == 9, "test").otherwise("train")


def is_valid_text(text: Column) -> Column:
    return text.isNotNull() & (F.length(F.trim(text)) > 0)


def invalid_reason(text: Column) -> Column:
    return F.when(text.isNull(), "null").when(F.length(text) == 0, "empty").when(F.length(F.trim(text)) == 0, "blank").otherwise("valid")


def length_stats(value: Column) -> list[Column]:
    return [
        F.min(value).cast("long").alias("min_len"),
        F.max(value).cast("long").alias("max_len"),
        F.round(F.avg(value), 2).alias("mean_len"),
        F.round(F.median(value), 2).alias("median_len"),
        F.round(F.stddev_samp(value), 2).alias("std_len"),
    ]


def keep_first(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row of each key: the first by ``order``. An aggregate, not a window, so a hot key is combined map-side."""
    others = [c for c in rows.columns if c not in keys]
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*others), order).alias("_r"))
    return first.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in others]).select(*rows.columns)


def leakage_removed(rows: DataFrame, split: str, key: str) -> DataFrame:
    """Rows whose key isn't in an earlier split: train stays, validation loses train's, test loses both's (as they were)."""
    seen = rows.groupBy(key).agg(F.max((F.col(split) == "train").cast("int")).alias("_t"), F.max((F.col(split) == "validation").cast("int")).alias("_v"))
    joined = rows.join(seen, key)
    leaked = ((F.col(split) != "train") & (F.col("_t") == 1)) | ((F.col(split) == "test") & (F.col("_v") == 1))
    return joined.filter(~leaked).drop("_t", "_v").select(*rows.columns)


def without_conflicts(rows: DataFrame, key: str, label: str, order: str) -> DataFrame:
    """Keys with more than one label lose all rows; of the others the first row stays."""
    agreed = rows.groupBy(key).agg(F.min(label).alias("_lo"), F.max(label).alias("_hi")).filter("_lo = _hi").select(key)
    return keep_first(rows.join(agreed, key, "left_semi"), [key], order)


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    """Balanced, inverse and square-root inverse weights; the last two sum to the number of classes."""
    n = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    every = W.partitionBy()
    total, k = F.sum("n").over(every), F.count(F.lit(1)).over(every)
    inverse, root = 1 / F.col("n"), 1 / F.sqrt("n")
    return n.select(
        label,
        "n",
        F.round(total / (k * F.col("n")), 6).alias("balanced"),
        F.round(inverse / F.sum(inverse).over(every) * k, 6).alias("inverse"),
        F.round(root / F.sum(root).over(every) * k, 6).alias("sqrt_inverse"),
    )


def standardised(rows: DataFrame, columns: list[str], fitted_on: Column) -> DataFrame:
    """z-scores with the mean and population deviation of the rows that ``fitted_on`` marks; a zero deviation counts as 1."""
    stats = rows.filter(fitted_on).agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    z = [((F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") == 0, 1.0).otherwise(F.col(f"_s_{c}"))).alias(f"{c}_z") for c in columns]
    return rows.join(F.broadcast(stats)).select(*rows.columns, *z)  # stats is one row


def stratified_rank(rows: DataFrame, label: str, order: Column) -> DataFrame:
    """Fraction of its class that comes before each row, in a pseudo-random order."""
    mine = W.partitionBy(label)
    return rows.withColumn("_at", F.row_number().over(mine.orderBy(order)) - 1).withColumn("_n", F.count(F.lit(1)).over(mine))
