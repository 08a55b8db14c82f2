"""Exact deduplication by a tree-merge of sorted digest runs (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, digest_tree


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", fan_in: int = 8) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Equal
    means the same SHA-256, the same number of bytes and the same independent 64-bit hash,
    checked at every level of the tree. Of each group the row with the largest (or
    smallest) id stays; of rows that repeat that id and text, exactly one. Null ids are
    legal and never preferred. An empty table gives an empty result; other columns of
    ``docs``, whatever their names, are not read.
    """
    work = common.workspace(docs.sparkSession, "exact-dedup")
    merged = _merged(docs, F.monotonically_increasing_id(), id_col, text_col, keep, fan_in, work)
    return merged.select(
        F.col("_id").alias(id_col),
        F.col("_keep.id").alias("keep_id"),
        F.col("_size").alias("group_size"),
        (F.col("_uid") == F.col("_keep.uid")).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )


def _merged(docs: DataFrame, uid: Column, id_col: str, text_col: str, keep: str, fan_in: int, work: str) -> DataFrame:
    """The rows' digests (_uid, _id, _sha, ...) with what the tree says of them."""
    text = common.ascii_lower(F.coalesce(docs[text_col].cast("string"), F.lit("")))
    own = docs.select(uid.alias("_uid"), docs[id_col].alias("_id"), text.alias("_text"))
    digests = own.select("_uid", "_id", F.unhex(F.sha2("_text", 256)).alias("_sha"), F.octet_length("_text").alias("_bytes"), F.xxhash64("_text").alias("_check"))
    rows = common.stage(digest_tree.with_run(digests), f"{work}/digests")
    return digest_tree.merge_runs(rows, ["_sha", "_bytes", "_check"], "_id", work, keep=keep, fan_in=fan_in)


def deduplicated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", fan_in: int = 8) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: exactly one of each group.

    Rows are told apart by a number of their own, so each text is hashed once and repeated
    rows, equal ids and null ids need no other comparison. Null and empty texts are one
    group; an empty table stays empty; other columns may have any names.
    """
    work = common.workspace(docs.sparkSession, "exact-dedup")
    docs, uid = common.numbered(docs, f"{work}/docs")
    merged = _merged(docs, docs[uid], id_col, text_col, keep, fan_in, f"{work}/tree")
    gone = common.stage(merged.where(F.col("_uid") != F.col("_keep.uid")).select(F.col("_uid").alias(uid)), f"{work}/gone")
    common.drop_path(docs.sparkSession, f"{work}/tree")
    return docs.join(gone, uid, "left_anti").drop(uid)
