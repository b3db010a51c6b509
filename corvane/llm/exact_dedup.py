"""Exact dedup by deterministic block naming.

Each normalised text is cut into blocks of fixed size. The distinct blocks are sorted and named by
integers; then adjacent pairs of names are sorted and named in turn, until each document is left
with one name. Two documents of the same height get the same name if and only if their texts are
equal: names come from sorted distinct contents, never from a hash. (A 64-bit hash only routes a
block to its name; blocks whose hash is not unique are routed by their content.)

Scale: only distinct block contents are shuffled, once, after map-side aggregation, so a hot group
of copies costs one row per map task. All other shuffles carry integers, and halve at every level.

Defined results: a null text counts as the empty text; repeated rows are copies of each other, of
which exactly one stays (of equal doc_ids the last in scan order); null doc_ids are smaller than all
others; an empty table gives an empty result; other columns than doc_id and the text are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK_BYTES = 4096


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def _named(distinct: DataFrame, order: list[str]) -> DataFrame:
    """Integer names: the partition's number leads, then the place in its sorted order. Equal contents share a partition, so a name stands for one content."""
    return distinct.sortWithinPartitions(*order).withColumn("name", F.monotonically_increasing_id())


def block_names(docs: DataFrame, text_col: str, block_bytes: int, block_hash: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
    """(rid, doc_id, sha, n) of every row, and (rid, pos, name) of every block."""
    body = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id"), normalised(F.col(text_col)).alias("_t"))
    cut = F.expr(f"transform(sequence(0L, greatest(length(_b) - 1, 0) div {block_bytes}), i -> substring(_b, int(i) * {block_bytes} + 1, {block_bytes}))")
    blocks = body.select("rid", "doc_id", "_t", F.col("_t").cast("binary").alias("_b")).withColumn("_blocks", cut)
    rows = staged(
        blocks.select("rid", "doc_id", F.unhex(F.sha2(F.col("_t"), 256)).alias("sha"), F.transform("_blocks", lambda b: block_hash(b)).alias("hashes")),
    )
    contents = blocks.select(F.explode("_blocks").alias("block")).withColumn("h", block_hash(F.col("block")))
    # the content travels once; what is kept of it is its name
    names = staged(_named(contents.groupBy("h", "block").agg(F.lit(1).alias("_one")), ["block"]).select("h", "name", F.length("block").alias("_len")))
    per_hash = names.groupBy("h").agg(F.min("name").alias("name"), F.count(F.lit(1)).alias("_same"))
    at = rows.select("rid", F.posexplode("hashes").alias("pos", "h"))
    routed = at.join(per_hash.filter("_same = 1").select("h", "name"), "h")
    clashing = per_hash.filter("_same > 1").select("h")
    if not clashing.isEmpty():
        # blocks whose hash is shared by other contents: named once more, by content alone
        # (rid comes from the staged rows alone: read anew, the input may be in another order)
        ids = at.join(clashing, "h", "left_semi").select("rid").distinct()
        texts = body.select(F.unhex(F.sha2(F.col("_t"), 256)).alias("sha"), "_t").dropDuplicates(["sha"])
        source = rows.join(ids, "rid").select("rid", "sha").join(texts, "sha").select("rid", F.posexplode(F.expr(cut_expr(block_bytes))).alias("pos", "block")).withColumn("h", block_hash(F.col("block")))
        mine = staged(source.join(clashing, "h", "left_semi"))
        own = _named(mine.groupBy("block").agg(F.lit(1).alias("_one")), ["block"]).select("block", (-1 - F.col("name")).alias("name"))
        routed = routed.select("rid", "pos", "name").unionByName(mine.join(staged(own), "block").select("rid", "pos", "name"))
    return rows, staged(routed.select("rid", "pos", "name"))


def cut_expr(block_bytes: int) -> str:
    return f"transform(sequence(0L, greatest(length(cast(_t as binary)) - 1, 0) div {block_bytes}), i -> substring(cast(_t as binary), int(i) * {block_bytes} + 1, {block_bytes}))"


def document_names(blocks: DataFrame) -> DataFrame:
    """(rid, level, name): adjacent names are paired and renamed until one is left for each rid."""
    done: DataFrame | None = None
    level = 0
    at = blocks
    longest = at.agg(F.max("pos")).first()[0]
    while longest is not None:
        if longest == 0:
            last = at.select("rid", F.lit(level).alias("level"), "name")
            return last if done is None else done.unionByName(last)
        # a document leaves with its first name when it has no second one
        pairs = at.groupBy("rid", F.expr("pos div 2").alias("pos")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("left"),
            F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))).alias("right"),
        )
        heights = at.groupBy("rid").agg(F.max("pos").alias("_last"))
        single = at.join(heights.filter("_last = 0").select("rid"), "rid", "left_semi")
        ended = single.select("rid", F.lit(level).alias("level"), "name")
        done = ended if done is None else done.unionByName(ended)
        pairs = staged(pairs.join(heights.filter("_last > 0").select("rid"), "rid", "left_semi"))
        none = -(2**62)  # an odd row's last name has no partner
        pairs = pairs.withColumn("right", F.coalesce("right", F.lit(none)))
        names = _named(pairs.groupBy("left", "right").agg(F.lit(1).alias("_one")), ["left", "right"]).select("left", "right", "name")
        at = staged(pairs.join(staged(names), ["left", "right"]).select("rid", "pos", "name"))
        longest //= 2
        level += 1
    return blocks.select("rid", F.lit(0).alias("level"), "name")


def exact_dedup(
    docs: DataFrame,
    text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
    block_hash: Callable[[Column], Column] = F.xxhash64,
) -> DataFrame:
    """Per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256. Of equal texts the largest doc_id stays."""
    rows, blocks = block_names(docs, text_col, block_bytes, block_hash)
    named = staged(document_names(blocks))
    full = rows.select("rid", "doc_id", "sha").join(named, "rid")
    groups = full.groupBy("level", "name").agg(
        F.max(F.struct(F.coalesce("doc_id", F.lit(-(2**63))).alias("d"), F.col("rid").alias("rid"))).alias("_keep"),
        F.max("doc_id").alias("keep_id"),
        F.count(F.lit(1)).alias("group_size"),
    )
    return full.join(groups, ["level", "name"]).select(
        "doc_id",
        "keep_id",
        F.col("group_size").cast("long").alias("group_size"),
        (F.col("rid") == F.col("_keep.rid")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, text_col: str = "text", **options: object) -> DataFrame:
    """The rows that stay, with the columns of ``docs``; of rows that repeat both doc_id and text, one."""
    kept = staged(exact_dedup(docs, text_col, **options))
    stay = kept.groupBy("doc_id", "text_sha256").agg(F.max("kept").alias("_kept"), F.count(F.lit(1)).alias("_corvane_rows")).filter("_kept")
    stay = stay.select(F.col("doc_id").alias("_corvane_id"), F.unhex("text_sha256").alias("_corvane_sha"), "_corvane_rows")
    hashed = docs.withColumn("_corvane_own", F.unhex(F.sha2(normalised(F.col(text_col)), 256)))
    found = hashed.join(stay, hashed["doc_id"].eqNullSafe(stay["_corvane_id"]) & (hashed["_corvane_own"] == stay["_corvane_sha"]))
    once = found.filter("_corvane_rows = 1").select(*docs.columns)
    if stay.filter("_corvane_rows > 1").isEmpty():
        return once
    # only rows that repeat are shuffled again
    repeated = found.filter("_corvane_rows > 1").dropDuplicates(["doc_id", "_corvane_own"]).select(*docs.columns)
    return once.unionByName(repeated)
