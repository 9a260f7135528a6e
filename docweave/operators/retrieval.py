"""Filters and record rules over the table of points."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def visible(points: DataFrame, active: DataFrame, denied: DataFrame) -> DataFrame:
    """Vector rows of an active generation of a document that is not denied; no active document, no row.

    Predicates on the rows themselves come first and reach the scan; both joins only test for membership.
    """
    rows = points.where("vector_point and graph_control_point is null").where("not coalesce(graph_tombstoned, false) and not coalesce(graph_point, false)")
    rows = rows.join(active.select("document_id", "document_generation"), ["document_id", "document_generation"], "left_semi")
    return rows.join(denied.select("document_id"), "document_id", "left_anti")


def active_graph(points: DataFrame, active: DataFrame) -> DataFrame:
    """Graph rows of the active generation and attempt, tombstoned ones left out."""
    rows = points.where("graph_point and not coalesce(graph_tombstoned, false)")
    keys = ["document_id", "document_generation", "document_attempt_id"]
    return rows.join(active.select(*keys), keys, "left_semi")


def normal_payload(points: DataFrame) -> DataFrame:
    """Aliases and defaults settled once: a missing uid is made from its parts, level and source have defaults."""
    made = F.concat("document_id", F.lit(":chunk:"), F.col("chunk_id").cast("string"))
    return points.select("point_id", F.coalesce(T.blank_to_null(F.col("chunk_uid")), made).alias("chunk_uid"), F.coalesce("level", F.lit("paragraph")).alias("level"), F.coalesce("source", F.lit("docling")).alias("source"), "page_no", "image_url")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order_col: str) -> DataFrame:
    """One row per key, the one of the latest batch. Partial aggregation keeps hot keys small before the shuffle."""
    both = old.unionByName(new)
    rest = [c for c in both.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), order_col).alias("_r")).select(*keys, "_r.*")


def stale(points: DataFrame, entries: DataFrame) -> DataFrame:
    """Rows of a generation older than the document's."""
    now = entries.select("document_id", F.col("document_generation").alias("_now"))
    return points.where("graph_control_point is null").join(now, "document_id").where("document_generation < _now").drop("_now")


def replaced(points: DataFrame, kept: DataFrame) -> DataFrame:
    """What remains of ``points`` once everything not in ``kept`` (point_id) is deleted from the documents kept has rows of."""
    docs = kept.join(points.select("point_id", "document_id"), "point_id").select("document_id").distinct()
    gone = points.join(docs, "document_id", "left_semi").join(kept.select("point_id"), "point_id", "left_anti").select("point_id")
    return points.join(gone, "point_id", "left_anti")


def canonical_records(points: DataFrame, entries: DataFrame) -> DataFrame:
    """(chunk_uid, point_id, n_candidates): per source and chunk the row of the current attempt, else the original, else the smallest id."""
    attempt = entries.select("document_id", F.col("document_attempt_id").alias("_now"))
    rows = points.where("vector_point").join(attempt, "document_id", "left")
    rank = F.struct(F.when(F.col("document_attempt_id") == F.col("_now"), 0).when(F.col("document_attempt_id") != F.col("_now"), 1).otherwise(2), F.when(F.col("source_point_id").isNull(), 0).otherwise(1), "point_id")
    best = rows.groupBy("source_point_id", "chunk_uid").agg(F.min_by("point_id", rank).alias("point_id"), F.count(F.lit(1)).alias("n_candidates"))
    return best.select("chunk_uid", "point_id", "n_candidates")


def point_set_digest(points: DataFrame) -> DataFrame:
    """(document_id, n, digest): SHA-256 over the document's point ids in order. A digest needs all ids of its document in one place: 36 bytes each."""
    g = points.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("point_id")).alias("_ids"))
    return g.select("document_id", "n", F.sha2(F.array_join("_ids", ","), 256).alias("digest"))


def difference(existing: DataFrame, keep: DataFrame, key: str) -> DataFrame:
    """The rows whose key is not among those to keep; rows without a key are not."""
    return existing.join(keep.select(key).distinct(), key, "left_anti").select(*existing.columns)


def graph_chunks(nodes: DataFrame, chunks: DataFrame) -> DataFrame:
    """(node, document_id, chunk_uid) of graph nodes (node, document_id): by the node's name as a uid, else by what follows ``chunk_`` as a uid, else as a number, in the node's
    document if it has one. A step that fits several chunks fits none."""
    n = nodes.select("node", "document_id", F.when(F.col("node").startswith("chunk_"), F.substring("node", 7, 2**30)).alias("_tail"))
    k = chunks.select("chunk_uid", F.col("document_id").alias("_doc"), F.col("chunk_id").cast("string").alias("_no")).distinct()
    steps = [
        n.join(k.select("chunk_uid"), F.col("node") == F.col("chunk_uid")).select("node", "document_id", "chunk_uid", F.lit(1).alias("_s")),
        n.join(k.select("chunk_uid"), F.col("_tail") == F.col("chunk_uid")).select("node", "document_id", "chunk_uid", F.lit(2).alias("_s")),
        n.where("document_id is not null").join(k, (F.col("_tail") == F.col("_no")) & (F.col("document_id") == F.col("_doc"))).select("node", "document_id", "chunk_uid", F.lit(3).alias("_s")),
        # without a document only a number that a single chunk has will do, so each number is one row
        n.where("document_id is null").join(k.where("_no is not null").groupBy("_no").agg(F.min("chunk_uid").alias("chunk_uid"), F.count_distinct("chunk_uid").alias("_c")).where("_c = 1"), F.col("_tail") == F.col("_no")).select("node", "document_id", "chunk_uid", F.lit(3).alias("_s")),
    ]
    every = steps[0]
    for s in steps[1:]:
        every = every.unionByName(s)
    one = every.groupBy("node", "document_id", "_s").agg(F.min("chunk_uid").alias("chunk_uid"), F.count_distinct("chunk_uid").alias("_c")).where("_c = 1")
    return one.groupBy("node", "document_id").agg(F.min_by("chunk_uid", "_s").alias("chunk_uid"))
