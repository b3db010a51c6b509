"""Line-level operators: windows around criteria, islands, separators, reaching definitions and bounded reachability."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def numbered_lines(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, code), lines from 1."""
    return rows.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("_p", "code")).select(key, (F.col("_p") + 1).alias("line"), "code")


def window_lines(n_lines: Column, criteria: Column, k: int) -> Column:
    """Sorted distinct lines within ``k`` of any criterion, clipped to the text."""
    spans = F.transform(criteria, lambda c: F.sequence(F.greatest(c - k, F.lit(1)), F.greatest(F.least(c + k, n_lines), F.greatest(c - k, F.lit(1)))))
    return F.filter(F.array_sort(F.array_distinct(F.flatten(spans))), lambda x: x <= n_lines)


def islands(rows: DataFrame, keys: list[str], at: str, gap: int) -> DataFrame:
    """Adds ``island``: numbers rows of a key whose neighbours lie within ``gap``."""
    order = W.partitionBy(*keys).orderBy(at)
    new = (F.col(at) - F.lag(at).over(order) > gap).cast("int")
    return rows.withColumn("_new", F.coalesce(new, F.lit(0))).withColumn("island", F.sum("_new").over(order)).drop("_new")


def last_before(rows: DataFrame, keys: list[str], at: str, marked: Column, value: str, out: str) -> DataFrame:
    """Adds the value of the last marked row of the key strictly before each row (as-of)."""
    frame = W.partitionBy(*keys).orderBy(at).rangeBetween(W.unboundedPreceding, -1)
    return rows.withColumn(out, F.last(F.when(marked, F.col(value)), ignorenulls=True).over(frame))


def dedented(lines: Column) -> Column:
    """Lines without the indent that all non-blank ones share, as one text."""
    indents = F.transform(F.filter(lines, lambda x: F.trim(x) != ""), lambda x: F.length(x) - F.length(F.ltrim(x)))
    cut = F.coalesce(F.array_min(indents), F.lit(0))
    return F.array_join(F.transform(lines, lambda x: F.when(F.trim(x) == "", "").otherwise(F.substr(x, cut + 1))), "\n")


def reachable(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(seed, node, distance) for nodes within ``depth`` steps along (src, dst); each node once, at its least distance.

    Unrolled joins with a distinct frontier each round, so cycles end and a hub is met once per seed.
    """
    links = edges.select("src", "dst").distinct()
    seen = frontier = seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("distance")).distinct()
    for d in range(1, depth + 1):
        step = frontier.join(links, frontier["node"] == links["src"]).select("seed", F.col("dst").alias("node"), F.lit(d).alias("distance")).distinct()
        frontier = step.join(seen, ["seed", "node"], "left_anti")
        seen = seen.unionByName(frontier)
    return seen


def closure(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node): ``seeds`` and all that is reached from them along (src, dst), in as many rounds as it takes; null is a node without edges.

    Each round starts from files, and only nodes that were new in the last one are followed.
    """
    links = _cut(edges.select("src", "dst").distinct())
    seen = frontier = _cut(seeds.select("node").distinct())
    while not frontier.isEmpty():
        step = frontier.join(links, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        known = seen.select(F.col("node").alias("_seen"))
        frontier = _cut(step.join(known, F.col("node").eqNullSafe(F.col("_seen")), "left_anti"))
        seen = _cut(seen.unionByName(frontier).distinct())  # distinct already; keeps the number of partitions
    return seen


def _cut(df: DataFrame) -> DataFrame:
    """Checkpointed in the cluster's shared folder; in one of this machine's only where none is set and all of Spark is one process."""
    context = df.sparkSession.sparkContext
    if not df.sparkSession.conf.get("spark.checkpoint.dir", None) and not context.getCheckpointDir():
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="corvane-"))
    return df.checkpoint()
