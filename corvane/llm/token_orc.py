"""Token ids as ORC: run-length encoded integers, row indexes and Bloom filters on the document id.

Rows are cut into ranges of doc_id, sorted, encoded inside their task and written as one file per
range, so that file order and row order give ascending doc_id. Stripes are read in parallel, and a
filter on doc_id prunes stripes and row groups by their statistics and Bloom filters.

Each row holds part (the range), start (ids of the documents before it in its part), n_tokens and
ids. A global start is a part's offset plus the local one; the offsets come from one sum per part.

Defined results: a null text has only the end id; null doc_ids come first; rows that repeat a doc_id
follow each other by the hash of their text; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .pieces import crc, encoder, with_end
from .shared import parallelism

SCHEMA = "part int, doc_id long, start long, n_tokens int, ids array<int>"
ORC = {"compression": "zstd", "orc.create.index": "true", "orc.row.index.stride": "2000", "orc.stripe.size": str(16 << 20), "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01"}


def _encode(path: str, kind: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, before = encoder(path, kind), 0
        for whole in batches:
            for at, ids, edges in enc.ids(whole.column("text")):
                ids, edges = with_end(ids, edges, end_id)
                b = whole.slice(at, len(edges) - 1)
                lists = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(ids.view(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column("part"), b.column("doc_id"), pa.array(before + edges[:-1]), pa.array(np.diff(edges).astype(np.int32)), lists], ["part", "doc_id", "start", "n_tokens", "ids"])
                before += int(edges[-1])

    return run


def write_tokens(docs: DataFrame, out: str, tokenizer_path: str, kind: str, end_id: int, files: int | None = None, text_col: str = "text") -> None:
    """Write every document's ids and ``end_id`` to ``out`` in ascending doc_id order."""
    rows = docs.select("doc_id", F.col(text_col).alias("text")).withColumn("_h", F.xxhash64("text"))
    order = [F.asc_nulls_first("doc_id"), F.asc("_h")]
    cut = rows.repartitionByRange(files or parallelism(docs.sparkSession), *order).sortWithinPartitions(*order)
    cut = cut.select(F.spark_partition_id().alias("part"), "doc_id", "text")
    cut.mapInArrow(_encode(tokenizer_path, kind, end_id), SCHEMA).write.options(**ORC).orc(out)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The rows written; filters on doc_id and unused columns are pushed into the scan."""
    return spark.read.schema(SCHEMA).orc(path)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists = b.column("ids")
        edges, values = lists.offsets.to_numpy(), np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<i4")
        sums = [crc(values[s:e].tobytes()) for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("part"), b.column("doc_id"), b.column("start"), pa.array(np.diff(edges).astype(np.int64)), pa.array(sums, pa.int64())], ["part", "doc_id", "start", "n_tokens", "ids_crc32"])


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start over all files, n_tokens, ids_crc32."""
    kept = read_tokens(spark, path)
    totals = kept.groupBy("part").agg(F.sum(F.col("n_tokens").cast("long")).alias("_n"))  # a row per file
    offsets = totals.select("part", (F.sum("_n").over(W.orderBy("part")) - F.col("_n")).alias("_offset"))
    rows = kept.mapInArrow(_digests, "part int, doc_id long, start long, n_tokens long, ids_crc32 long")
    return rows.join(F.broadcast(offsets), "part").select("doc_id", (F.col("start") + F.col("_offset")).alias("start"), "n_tokens", "ids_crc32")
