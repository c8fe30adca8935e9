"""Exact deduplication with a heavy-hitter split (DataFrame operations only).

1. One scan turns each text into a SHA-256 digest; digests and ids are written to a table.
2. A Misra-Gries family sketch (Spark's frequent-items sketch, merged in two levels so that no
   task receives the sketches of all tasks) proposes the most frequent digests.
3. A second look at the digest table counts the proposals exactly, with map-side combining. These
   verified winners are at most ``max_heavy`` rows, which bounds the broadcast.
4. Rows of a winner are resolved map-side by the broadcast join; only the rest, where no digest can
   hold a large share of the rows, is shuffled by digest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch, ascii_lower

#: Bound on the broadcast rows, items a sketch tracks, and least copies worth a broadcast row.
MAX_HEAVY, TRACKED, MIN_COPIES = 1000, 8192, 32
#: Sketches of the scan's tasks are first merged in this many groups.
SKETCH_GROUPS = 64


def heavy_digests(digests: DataFrame, max_heavy: int = MAX_HEAVY, tracked: int = TRACKED, min_copies: int = MIN_COPIES) -> DataFrame:
    """Verified frequent digests: (digest, keep_id, group_size), at most ``max_heavy`` rows.

    Every digest with more than about 1.4 / ``tracked`` of the rows is sure to be tracked.
    """
    sketches = (
        digests.select(F.xxhash64("digest").alias("item"), F.pmod(F.spark_partition_id(), F.lit(SKETCH_GROUPS)).alias("g"))
        .groupBy("g")
        .agg(F.expr(f"approx_top_k_accumulate(item, {tracked})").alias("sketch"))
    )
    proposed = (
        # Grouped, not global: a global aggregate also makes a state for partitions without rows, which can't be combined.
        sketches.groupBy(F.lit(0).alias("all"))
        .agg(F.expr(f"approx_top_k_combine(sketch, {tracked})").alias("sketch"))
        .select(F.explode(F.expr(f"approx_top_k_estimate(sketch, {max_heavy})")).alias("top"))
        .where(F.col("top.count") >= min_copies)
        .select(F.col("top.item").alias("item"))
    )
    return (
        digests.withColumn("item", F.xxhash64("digest"))
        .join(F.broadcast(proposed), "item", "left_semi")
        .groupBy("digest")
        .agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .where(F.col("group_size") >= min_copies)
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_heavy: int = MAX_HEAVY, min_copies: int = MIN_COPIES) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; a null text counts as the empty text.
    Of equal texts the largest id stays. Rows that repeat an id count as rows of the group and share
    its verdict; a null id is below every other, and a group of null ids only keeps no id
    (keep_id null, kept true, as nothing else stands for it). An empty table gives an empty result; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "exact")
    digest = F.unhex(F.sha2(F.encode(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), "UTF-8"), 256))
    digests = scratch.save(docs.select(F.col(id_col).alias("id"), digest.alias("digest")), "digests")
    heavy = scratch.save(heavy_digests(digests, max_heavy, min_copies=min_copies), "heavy")
    marked = digests.join(F.broadcast(heavy), "digest", "left")
    hot = marked.where(F.col("group_size").isNotNull())
    group = Window.partitionBy("digest")
    rest = digests.join(F.broadcast(heavy), "digest", "left_anti").select(
        "digest", "id", F.max("id").over(group).alias("keep_id"), F.count(F.lit(1)).over(group).alias("group_size")
    )
    return hot.select("digest", "id", "keep_id", "group_size").unionByName(rest).select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
