"""A training-data pipeline over ``documents``: each stage's rows are written as Parquet and reread by the next.

1. language ID: documents without a letter, or far from every language learned, go.
2. exact dedup: of texts equal after lower-casing A-Z the largest doc_id stays.
3. n-gram Jaccard join: of linked documents (five-word shingles, similarity 0.75 or more) the smallest doc_id stays.
4. mixing: sources with more than their share of a mix (weights: rows to the power 0.7) are held to it
   (blocks that the mix repeats, of sources with fewer than their share, are kept once: no copies come back).
5. best-fit packing: what is left, as pieces in sequences of at most 4096 tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.exact_dedup import drop_exact_copies
from corvane.llm.language_id import identify, train_language_id
from corvane.llm.mixing import mix_sources, tempered_weights
from corvane.llm.ngram_join import BROADCAST_IDS, ngram_components
from corvane.llm.packing import pack_documents
from corvane.llm.queries import tokenizer
from corvane.llm.shared import released, staged

OWN = ("_corvane_1", "_corvane_2", "_corvane_3", "_corvane_4")

#: No SQL: the language model, the similarity classes and the packing aren't SQL-expressible.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    known = identify(docs, train_language_id(docs), docs.columns, names=OWN[:3])
    return known.filter(~F.col(OWN[2])).select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    classes = ngram_components(docs).filter("component_id <> doc_id")
    gone = staged(classes.select("doc_id").distinct())
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, "doc_id", "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mix_sources(docs, tempered_weights(docs), names=OWN)
    return mixed.filter(OWN[2]).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, tokenizer("word_bpe_49k.json"))


STAGES = [("language ID", language_id), ("exact dedup", exact), ("n-gram Jaccard join", near), ("mixing", mix), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        last, docs = docs, staged(stage(spark, docs, sf_dir))
        if k:
            released(last)  # the stage before has been read for the last time
    return docs
