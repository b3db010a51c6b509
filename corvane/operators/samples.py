"""Samples, batches, slices of token lists and summaries of labelled rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_of_label(rows: DataFrame, label: str, value: int, key: str, n: int) -> DataFrame:
    """The ``n`` rows of a label with the smallest keys (a top-k, nothing is sorted whole)."""
    return rows.filter(F.col(label) == value).orderBy(key).limit(n)


def balanced_batches(rows: DataFrame, label: str, key: str, per_class: int) -> DataFrame:
    """Adds ``batch``: each class gives ``per_class`` rows to a batch, by key, as long as it has rows."""
    place = F.row_number().over(W.partitionBy(label).orderBy(key)) - 1
    return rows.withColumn("batch", F.floor(place / per_class).cast("long"))


def unit_interval(key: Column) -> Column:
    """A number between 0 and 1 that depends on an integer key alone (multiplicative hashing)."""
    return (F.pmod(key * F.lit(2654435761), F.lit(1 << 32)) + 0.5) / float(1 << 32)


def weighted_sample(rows: DataFrame, key: str, weight: Column, n: int) -> DataFrame:
    """``n`` rows without replacement, each step's chance in proportion to weight: the smallest -ln(u) / w."""
    return rows.withColumn("_w", weight.cast("double")).filter("_w > 0").orderBy(F.round(-F.log(unit_interval(F.col(key))) / F.col("_w"), 12), key).limit(n).drop("_w")


def class_weights_of(counts: Mapping[int, int]) -> dict[int, float]:
    """Weights of a sampler that draws all classes alike."""
    total = sum(counts.values())
    return {k: total / (len(counts) * n) for k, n in counts.items() if n}


def even_slices(tokens: Column, parts: int) -> Column:
    """``parts`` runs of a token list, equally long but for the last; missing ones are empty."""
    size = F.greatest(F.ceil(F.size(tokens) / parts), F.lit(1)).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda k: F.slice(tokens, k * size + 1, size))


def seed_lines(lines: DataFrame, key: str, most: int) -> DataFrame:
    """(key, line, priority, place): a line once, by its best priority, then by number; ``most`` for each key."""
    best = lines.groupBy(key, "line").agg(F.min("priority").alias("priority"))
    place = F.row_number().over(W.partitionBy(key).orderBy("priority", "line"))
    return best.withColumn("place", place).filter(F.col("place") <= most)


def seeds(base: int, n: int) -> list[int]:
    return [base + 1000 * i for i in range(n)]


def spans_once(tokens: DataFrame, key: str) -> DataFrame:
    """Tokens (key, start, end, ...) in order of start, the longer first; of those with one span the first kind stays."""
    r = F.row_number().over(W.partitionBy(key, "start", "end").orderBy("kind"))
    return tokens.withColumn("_r", r).filter("_r = 1").drop("_r")


def dataset_stats(rows: DataFrame, label: str, length: Column) -> DataFrame:
    """One row: rows, positives, negatives, the positive share, and the lengths' mean, smallest and largest."""
    pos, n = F.count_if(F.col(label) == 1), F.count(F.lit(1))
    return rows.agg(
        n.alias("n"), pos.alias("n_pos"), F.count_if(F.col(label) == 0).alias("n_neg"), F.round(F.try_divide(pos, n), 6).alias("pos_share"),
        F.round(F.avg(length), 4).alias("mean_len"), F.min(length).cast("long").alias("min_len"), F.max(length).cast("long").alias("max_len"),
    )


def marked_line_stats(rows: DataFrame, n_marked: Column) -> DataFrame:
    """One row: marked lines in all, rows that have any, and the mean and largest number of those."""
    some = F.when(n_marked > 0, n_marked)
    return rows.agg(F.coalesce(F.sum(n_marked), F.lit(0)).cast("long").alias("n_lines"), F.count(some).alias("n_rows"), F.round(F.avg(some), 4).alias("mean_lines"), F.max(some).cast("long").alias("max_lines"))


def pattern_percentages(rows: DataFrame, code: str, parts: Mapping[str, str], by: str) -> DataFrame:
    """Per group: share in percent of the texts that hold each part, and their mean length."""
    share = [F.round(F.avg(F.col(code).contains(p).cast("double")) * 100, 4).alias(name) for name, p in parts.items()]
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.length(code)), 4).alias("mean_length"), *share)


def logged_summary(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, mean, std) of logged values; population deviation."""
    return rows.groupBy(key).agg(F.count(value).alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(F.stddev_pop(value), 6).alias("std"))


def level_counts(rows: DataFrame, level: str, levels: tuple[str, ...]) -> DataFrame:
    """One row: findings in all and of each level."""
    return rows.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col(level) == x).alias(x.lower()) for x in levels])


def mapped(pairs: DataFrame, key: str, left: str, right: str, position: str, last: bool) -> DataFrame:
    """(key, left, right) of aligned pairs: of a repeated left side the first or the last position wins."""
    pick = F.max_by(right, position) if last else F.min_by(right, position)
    return pairs.groupBy(key, left).agg(pick.alias(right))


def zipped(a: Column, b: Column) -> Column:
    """Array of (position, a, b), as long as the shorter one; each list is computed once, not once for each element."""
    whole = F.transform(
        F.array(F.struct(a.alias("a"), b.alias("b"))),
        lambda z: F.transform(
            F.slice(F.arrays_zip(z["a"].alias("a"), z["b"].alias("b")), F.lit(1), F.least(F.size(z["a"]), F.size(z["b"]))),
            lambda x, i: F.struct((i + 1).alias("position"), x["a"].alias("a"), x["b"].alias("b")),
        ),
    )
    return F.element_at(whole, 1)


def separator_position(ids: Column, separator: int, pad: int = 0) -> Column:
    """0-based place of the first separator; without one, four fifths of the ids that aren't padding."""
    at = F.array_position(ids, separator)
    return F.when(at > 0, at - 1).otherwise(F.floor(0.8 * F.size(F.filter(ids, lambda x: x != pad)))).cast("long")
