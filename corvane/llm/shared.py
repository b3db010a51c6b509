"""Cutting lineage through the cluster's shared folder, and scale-free ranking."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_LOCAL: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder name under ``spark.checkpoint.dir``; a local one only where that is unset and all of Spark is one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="corvane-"))
        base = _LOCAL[0]
    return f"{base.rstrip('/')}/corvane-{uuid.uuid4().hex}"


def staged(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the plan above starts from files.

    Unlike localCheckpoint this survives lost executors, and unlike checkpoint() the files are columnar.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def released(*tables: DataFrame) -> None:
    """Delete the files of tables from :func:`staged` that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def parallelism(spark: SparkSession) -> int:
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def spread_rank(df: DataFrame, keys: list[str], order: list[str], out: str, slices: int) -> DataFrame:
    """0-based rank of every row within ``keys`` by ``order``, without one task per key.

    The first order column is cut into ``slices`` ranges at its approximate quantiles (any cut
    points give the same ranks), rows are numbered inside (keys, range), and the small table of
    counts per (keys, range) gives each range its start. So a key that holds a third of all rows
    is spread over all ranges. ``order[0]`` must be numeric; nulls come first.
    """
    lead = order[0]
    cuts = df.approxQuantile(lead, [i / slices for i in range(1, slices)], 1.0 / (20 * slices)) if slices > 1 else []
    cuts = sorted(set(cuts))
    # one non-null column stands for the keys, so that window and join use the same partitioning
    key = F.concat_ws("|", *[F.coalesce(F.concat(F.lit("="), F.col(k).cast("string")), F.lit("-")) for k in keys])
    place = F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c <= F.col(lead))) if cuts else F.lit(0)
    sliced = df.withColumn("_corvane_key", key).withColumn("_corvane_slice", F.when(F.col(lead).isNull(), F.lit(-1)).otherwise(place))
    starts = (
        sliced.groupBy("_corvane_key", "_corvane_slice")
        .agg(F.count(F.lit(1)).alias("_corvane_n"))
        .withColumn("_corvane_start", F.sum("_corvane_n").over(W.partitionBy("_corvane_key").orderBy("_corvane_slice")) - F.col("_corvane_n"))
        .drop("_corvane_n")
    )
    within = W.partitionBy("_corvane_key", "_corvane_slice").orderBy(*[F.asc_nulls_first(c) for c in order])
    ranked = sliced.withColumn("_corvane_row", F.row_number().over(within) - 1).join(starts, ["_corvane_key", "_corvane_slice"])
    return ranked.select(*[F.col(f"`{c}`") for c in df.columns if c != out], (F.col("_corvane_row") + F.col("_corvane_start")).cast("long").alias(out))
