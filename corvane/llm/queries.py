"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sql
from .chat import conversation_digests, format_turns
from .exact_dedup import exact_dedup
from .language_id import held_out, identify, train_language_id
from .lm_scoring import score_texts
from .mixing import mix_sources, tempered_weights
from .nearest import nearest, usable_vectors
from .ngram_join import ngram_components
from .packing import pack_documents
from .shared import shared_dir, staged
from .token_counts import count_tokens_with_edits, sample_edits
from .token_orc import token_digests, write_tokens

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    """The default place of a public vocabulary file; every operator takes another as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return count_tokens_with_edits(docs, tokenizer("byte_bpe_50k.json"), sample_edits(F.col("text")))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    return conversation_digests(staged(format_turns(turns.unionByName(planted))))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mix_sources(docs, tempered_weights(docs))


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = usable_vectors(table(spark, sf_dir, "embeddings"))
    return nearest(rows, rows.filter("vec_id % 100 = 0"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", held_out(F.col("doc_id"), 4, 2))
    model = train_language_id(docs.filter(~F.col("held_out")))
    return identify(docs, model, ["doc_id", "held_out"])


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"), ~held_out(F.col("doc_id"), 5, 1))


def op9_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared_dir(spark)
    write_tokens(table(spark, sf_dir, "documents"), out, tokenizer("byte_bpe_50k.json"), "byte", end_id=0)
    return token_digests(spark, out)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return dict(sql.ORACLES)
