"""Vocabulary and encoding queries over ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lexer import sql_class, sql_tokens, token_class, tokens
from ..operators import vocabulary as v
from .registry import registered, spread, table

LEXED = f"lexed AS (SELECT doc_id, lang, {sql_tokens('text')} AS tokens FROM documents)"
FREQS = "freqs AS (SELECT token, count(*) AS freq FROM (SELECT unnest(tokens) AS token FROM lexed) GROUP BY token)"


def vocab_sql(least: int, cap: int, source: str = "freqs") -> str:
    return f"""vocab AS (
        SELECT token, CAST(row_number() OVER (ORDER BY freq DESC, token) + 3 AS INTEGER) AS id, freq
        FROM {source} WHERE freq >= {least} ORDER BY freq DESC, token LIMIT {cap - 4})"""


def lexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text")).select("doc_id", "lang", tokens(F.col("text")).alias("tokens"))


def vocab_of(docs: DataFrame, least: int, cap: int) -> DataFrame:
    return v.build_vocabulary(v.token_frequencies(docs), least, cap)


@registered(f"""WITH {LEXED}, {FREQS}, {vocab_sql(2, 5000)}
    SELECT token, id, freq FROM vocab UNION ALL
    SELECT * FROM (VALUES ('<PAD>', 0, 0), ('<UNK>', 1, 0), ('<BOS>', 2, 0), ('<EOS>', 3, 0)) AS s(token, id, freq)""")
def vocab_topk(spark, sf_dir):
    return vocab_of(lexed(spark, sf_dir), 2, 5000)


@registered(f"""WITH {LEXED} SELECT doc_id, len(tokens) AS n_tokens, len(list_distinct(tokens)) AS n_distinct,
    CAST(coalesce(list_sum(list_transform(tokens, lambda t: len(t))), 0) AS BIGINT) AS n_token_chars FROM lexed""")
def lex_token_counts(spark, sf_dir):
    chars = F.aggregate("tokens", F.lit(0).cast("long"), lambda a, t: a + F.length(t))
    n = F.size("tokens").cast("long")
    return lexed(spark, sf_dir).select("doc_id", n.alias("n_tokens"), F.size(F.array_distinct("tokens")).cast("long").alias("n_distinct"), chars.alias("n_token_chars"))


@registered(f"""WITH {LEXED}, t AS (SELECT unnest(tokens) AS token FROM lexed), c AS (SELECT {sql_class('token')} AS class, count(*) AS n FROM t GROUP BY 1)
    SELECT class, n, round(n / sum(n) OVER (), 6) AS ratio FROM c""")
def token_class_histogram(spark, sf_dir):
    by_token = v.token_frequencies(lexed(spark, sf_dir))  # classes are matched once per distinct token
    n = by_token.groupBy(token_class(F.col("token")).alias("class")).agg(F.sum("freq").alias("n"))
    total = n.agg(F.sum("n").alias("_t"))
    return n.join(F.broadcast(total)).select("class", "n", F.round(F.col("n") / F.col("_t"), 6).alias("ratio"))


IDS = """ids AS (SELECT l.doc_id, coalesce(list(coalesce(vocab.id, 1) ORDER BY pos) FILTER (pos IS NOT NULL), []) AS ids
    FROM lexed l LEFT JOIN (SELECT doc_id, unnest(tokens) AS token, unnest(range(len(tokens))) AS pos FROM lexed) t USING (doc_id) LEFT JOIN vocab USING (token) GROUP BY l.doc_id)"""


def text(ids):
    return F.array_join(F.transform(ids, lambda x: x.cast("string")), ",")


@registered(f"""WITH {LEXED}, {FREQS}, {vocab_sql(2, 5000)}, {IDS},
    cut AS (SELECT doc_id, len(ids) AS n, CASE WHEN len(ids) <= 128 THEN ids ELSE list_concat(list_concat(ids[1:48], [4]), ids[len(ids)-78:len(ids)]) END AS x FROM ids)
    SELECT doc_id, n AS n_tokens, len(x) AS n_kept, array_to_string(list_resize(x, 128, 0), ',') AS input_ids FROM cut""")
def encode_head_tail(spark, sf_dir):
    docs = lexed(spark, sf_dir)
    ids = v.encode(docs, vocab_of(docs, 2, 5000), "doc_id")
    cut = ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), v.truncated(F.col("ids"), 128, "head_tail", 48, 4).alias("x"))
    return cut.select("doc_id", "n_tokens", F.size("x").cast("long").alias("n_kept"), text(v.padded(F.col("x"), 128)).alias("input_ids"))


@registered(f"""WITH {LEXED}, {FREQS}, {vocab_sql(2, 5000)}, {IDS},
    cut AS (SELECT doc_id, (list_concat(list_concat([2], ids), [3]))[1:64] AS x FROM ids)
    SELECT doc_id, len(x) AS seq_length, array_to_string(list_resize(x, 64, 0), ',') AS input_ids,
           array_to_string(list_resize(list_transform(x, lambda i: 1), 64, 0), ',') AS attention_mask FROM cut""")
def encode_tail_bos_eos(spark, sf_dir):
    docs = lexed(spark, sf_dir)
    ids = v.encode(docs, vocab_of(docs, 2, 5000), "doc_id")
    cut = ids.select("doc_id", v.truncated(v.with_ends(F.col("ids")), 64, "tail").alias("x"))
    return cut.select("doc_id", F.size("x").cast("long").alias("seq_length"), text(v.padded(F.col("x"), 64)).alias("input_ids"), text(v.attention_mask(F.col("x"), 64)).alias("attention_mask"))


@registered(f"""WITH {LEXED}, {FREQS}, {vocab_sql(2, 5000)}, {IDS},
    cut AS (SELECT doc_id, CASE WHEN len(ids) <= 33 THEN ids ELSE list_concat(ids[1:17], ids[len(ids)-15:len(ids)]) END AS x FROM ids)
    SELECT doc_id, array_to_string(list_concat(list_transform(range(33 - len(x)), lambda i: 0), x), ',') AS input_ids FROM cut""")
def encode_center(spark, sf_dir):
    docs = lexed(spark, sf_dir)
    ids = v.encode(docs, vocab_of(docs, 2, 5000), "doc_id")
    return ids.select("doc_id", text(v.padded(v.truncated(F.col("ids"), 33, "center"), 33, left=True)).alias("input_ids"))


TRAIN = "train AS (SELECT * FROM lexed WHERE doc_id % 10 < 8), freqs AS (SELECT token, count(*) AS freq FROM (SELECT unnest(tokens) AS token FROM train) GROUP BY token)"


@registered(f"""WITH {LEXED}, {TRAIN}, {vocab_sql(2, 2000)}, t AS (SELECT doc_id, unnest(tokens) AS token FROM lexed WHERE doc_id % 10 >= 8)
    SELECT d.doc_id, count(t.token) AS n_tokens, count(t.token) FILTER (v.id IS NULL) AS n_unknown,
           round(coalesce(count(t.token) FILTER (v.id IS NULL) / nullif(count(t.token), 0), 0), 6) AS oov_rate
    FROM (SELECT doc_id FROM lexed WHERE doc_id % 10 >= 8) d LEFT JOIN t USING (doc_id) LEFT JOIN vocab v USING (token) GROUP BY d.doc_id""")
def oov_rate(spark, sf_dir):
    docs = lexed(spark, sf_dir)
    return v.unknown_rate(docs.filter("doc_id % 10 >= 8"), vocab_of(docs.filter("doc_id % 10 < 8"), 2, 2000), "doc_id")


@registered(f"""WITH {LEXED}, {TRAIN}, {vocab_sql(2, 2000)}
    SELECT token, count(*) AS n FROM (SELECT unnest(tokens) AS token FROM lexed WHERE doc_id % 10 >= 8) ANTI JOIN vocab USING (token)
    GROUP BY token ORDER BY n DESC, token LIMIT 50""")
def unk_stats_top(spark, sf_dir):
    docs = lexed(spark, sf_dir)
    vocab = vocab_of(docs.filter("doc_id % 10 < 8"), 2, 2000)
    freqs = v.token_frequencies(docs.filter("doc_id % 10 >= 8")).withColumnRenamed("freq", "n")
    return freqs.join(vocab.select("token"), "token", "left_anti").orderBy(F.desc("n"), "token").limit(50)


@registered(f"""WITH {LEXED}, {FREQS}, {vocab_sql(3, 1500)}
    SELECT CAST(sum(freq) AS BIGINT) AS total, CAST(sum(CASE WHEN id IS NOT NULL THEN f.freq ELSE 0 END) AS BIGINT) AS covered, count(*) AS distinct_tokens,
           round(sum(CASE WHEN id IS NOT NULL THEN f.freq ELSE 0 END) / sum(f.freq), 6) AS coverage
    FROM freqs f LEFT JOIN (SELECT token, id FROM vocab) v USING (token)""")
def vocab_coverage(spark, sf_dir):
    docs = lexed(spark, sf_dir)
    freqs = v.token_frequencies(docs)
    return v.coverage(freqs, v.build_vocabulary(freqs, 3, 1500))


@registered(f"""WITH {LEXED}, p AS (SELECT lang, token, count(*) AS freq FROM (SELECT lang, unnest(tokens) AS token FROM lexed WHERE lang IN ('en', 'de', 'es', 'fr')) GROUP BY ALL)
    SELECT token, CAST(sum(freq) AS BIGINT) AS freq FROM p GROUP BY token""")
def vocab_merge(spark, sf_dir):
    docs = lexed(spark, sf_dir)
    return v.merge_frequencies(*[v.token_frequencies(docs.filter(F.col("lang") == x)) for x in ("en", "de", "es", "fr")])


@registered(f"""WITH {LEXED}, {FREQS}, {vocab_sql(2, 5000)}, t AS (SELECT doc_id, unnest(tokens) AS token, unnest(range(len(tokens))) AS pos FROM lexed)
    SELECT doc_id, array_to_string(list(CASE WHEN id IS NULL THEN '<UNK>' ELSE token END ORDER BY pos), ' ') AS decoded, bool_and(id IS NOT NULL) AS same
    FROM t LEFT JOIN vocab USING (token) GROUP BY doc_id""")
def decode_roundtrip(spark, sf_dir):
    docs = lexed(spark, sf_dir)
    vocab = vocab_of(docs, 2, 5000)
    back = v.decode(v.encode(docs, vocab, "doc_id"), vocab, "doc_id").withColumnRenamed("tokens", "back")
    both = back.join(docs, "doc_id")
    return both.select("doc_id", F.array_join("back", " ").alias("decoded"), (F.col("back") == F.col("tokens")).alias("same"))


@registered(f"""WITH {LEXED}, {FREQS}, best AS (SELECT token, freq FROM freqs ORDER BY freq DESC, token LIMIT 10)
    SELECT count(*) AS n_distinct, CAST(sum(freq) AS BIGINT) AS n_tokens, (SELECT string_agg(token || '=' || freq, ' ' ORDER BY freq DESC, token) FROM best) AS top FROM freqs""")
def token_counter_stats(spark, sf_dir):
    return v.counter_stats(v.token_frequencies(lexed(spark, sf_dir)))


@registered(f"""WITH {LEXED}, n AS (SELECT len(tokens) AS n FROM lexed)
    SELECT count(*) AS n_rows, round(avg(n), 4) AS mean_length, CAST(min(n) AS BIGINT) AS min_length, CAST(max(n) AS BIGINT) AS max_length, round(avg(CASE WHEN n > 256 THEN 1.0 ELSE 0.0 END), 6) AS truncated_share FROM n""")
def encoded_lengths(spark, sf_dir):
    docs = lexed(spark, sf_dir)
    return v.encoded_length_stats(v.encode(docs, vocab_of(docs, 2, 5000), "doc_id"), "ids", 256)


@registered(f"""WITH {LEXED}, {FREQS}, {vocab_sql(2, 5000)}, asked(token) AS (VALUES ('the'), ('de'), ('<UNK>'), ('nowhere to be found'))
    SELECT asked.token, vocab.id IS NOT NULL AS present, coalesce(vocab.freq, 0) AS freq FROM asked LEFT JOIN (SELECT token, id, freq FROM vocab UNION ALL SELECT '<UNK>', 1, 0) vocab USING (token)""")
def vocab_membership(spark, sf_dir):
    """Important tokens in a vocabulary or not."""
    asked = spark.createDataFrame([("the",), ("de",), ("<UNK>",), ("nowhere to be found",)], "token string")
    vocab = vocab_of(lexed(spark, sf_dir), 2, 5000)
    return asked.join(vocab, "token", "left").select("token", F.col("id").isNotNull().alias("present"), F.coalesce("freq", F.lit(0)).cast("long").alias("freq"))


@registered(f"""WITH {LEXED}, i AS (SELECT doc_id, tokens, list_position(tokens, '.') AS p FROM lexed)
    SELECT doc_id, CAST(CASE WHEN p > 0 THEN p - 1 ELSE floor(0.8 * len(tokens)) END AS BIGINT) AS position FROM i""")
def separator_positions(spark, sf_dir):
    from ..operators.samples import separator_position

    ids = F.transform("tokens", lambda t: F.when(t == ".", 4).otherwise(9))
    return lexed(spark, sf_dir).select("doc_id", separator_position(ids, 4).alias("position"))
