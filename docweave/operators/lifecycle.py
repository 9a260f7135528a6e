"""Ingest of document rows: append, replace a document, replace the collection; and proofs that a write arrived.

Each function is a plan over tables; a run publishes its result as a new version of the table (see the artifact store), so readers keep
the version they began with.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .retrieval import point_set_digest

MODES = ("append", "replace-document", "replace-collection")


def ingest(old: DataFrame, new: DataFrame, mode: str) -> DataFrame:
    """The table after the new rows came in. Appending keeps what is there and adds documents not yet present;
    replacing a document drops its old rows; replacing the collection drops everything."""
    if mode not in MODES:
        raise ValueError(f"the mode must be one of {', '.join(MODES)}")
    if mode == "append":
        return old.unionByName(new.join(old.select("document_id").distinct(), "document_id", "left_anti").select(*new.columns))
    if mode == "replace-document":
        return old.join(new.select("document_id").distinct(), "document_id", "left_anti").select(*old.columns).unionByName(new)
    return new


def control_proof(points: DataFrame, controls: DataFrame) -> DataFrame:
    """(document_id, ok): whether each control's count and digest agree with the rows there are."""
    seen = point_set_digest(points)
    c = controls.select("document_id", F.col("n").alias("_n"), F.col("digest").alias("_d"))
    j = c.join(seen, "document_id", "left")
    return j.select("document_id", F.coalesce((F.col("n") == F.col("_n")) & (F.col("digest") == F.col("_d")), F.lit(False)).alias("ok"))


def next_versions(ledger: DataFrame) -> DataFrame:
    """(document_id, next_version): one above the highest there is."""
    return ledger.where("version is not null").groupBy("document_id").agg((F.max("version") + 1).alias("next_version"))


def expired(ledger: DataFrame, now, seconds: int = 900) -> DataFrame:
    """Reservations older than the time they are good for; without a time they never expire."""
    return ledger.where((F.col("state") == "reserved") & (F.timestamp_diff("SECOND", F.col("reserved_at").cast("timestamp"), F.lit(now).cast("timestamp")) > seconds))


def backfilled(points: DataFrame, entries: DataFrame) -> DataFrame:
    """Rows rewritten for the document's current generation and attempt, vectors reused; ``retired`` marks their sources."""
    now = entries.select("document_id", F.col("document_generation").alias("_g"), F.col("document_attempt_id").alias("_a"))
    rows = points.where("vector_point").join(now, "document_id").where("not (document_generation <=> _g)")
    made = rows.withColumn("source_point_id", F.col("point_id")).withColumn("document_generation", F.col("_g")).withColumn("document_attempt_id", F.col("_a"))
    return made.drop("_g", "_a").withColumn("backfill_retired", F.lit(False))


def active_generations(entries: DataFrame, ledger: DataFrame) -> DataFrame:
    """(document_id, status, active_generation): the generation whose rows a query may see. A pending document shows the one its active version was
    made with, a tombstoned one none, one that is partial, unavailable or stale its own only if its vectors are ready."""
    made = ledger.where("version is not null").groupBy("document_id", F.col("version").alias("active_version")).agg(F.max("document_generation").alias("_g"))
    e = entries.join(made, ["document_id", "active_version"], "left")
    unready = F.col("status").isin("partial", "unavailable", "stale") & ~F.coalesce("vector_ready", F.lit(False))
    active = F.when((F.col("status") == "tombstoned") | unready, None).when(F.col("status") == "pending", F.col("_g")).otherwise(F.col("document_generation"))
    return e.select("document_id", "status", active.alias("active_generation"))


def reservations(entries: DataFrame, ledger: DataFrame, requests: DataFrame) -> DataFrame:
    """(document_id, outcome, version, document_generation, fence_token, n_burned) of requests (document_id, operation_id, mode), one a document.

    The operation that already holds the pending version resumes it; appending refuses a document that is there; all else reserves the version after the highest
    that ever was, with the next generation and fence, and burns versions that other operations had reserved.
    """
    top = ledger.where("version is not null").groupBy("document_id").agg(F.max("version").alias("_top"))
    open_ = ledger.where("state = 'reserved'").select("document_id", "version", F.col("operation_id").alias("_held")).distinct()
    e = entries.select("document_id", F.lit(True).alias("_known"), "pending_version", F.col("document_generation").alias("_g"), F.col("document_fence_token").alias("_f"))
    r = requests.join(e, "document_id", "left").join(top, "document_id", "left")
    held = r.select("document_id", "operation_id", "pending_version").join(open_, "document_id")
    held = held.groupBy("document_id").agg(F.max((F.col("_held") == F.col("operation_id")) & (F.col("version") == F.col("pending_version"))).alias("_mine"), F.count_if(F.col("_held") != F.col("operation_id")).alias("_others"))
    r = r.join(held, "document_id", "left")
    mine = F.coalesce("_mine", F.lit(False))
    outcome = F.when(mine, "resumed").when((F.col("mode") == "append") & F.col("_known"), "refused").otherwise("reserved")
    new = outcome == "reserved"
    return r.select(
        "document_id", outcome.alias("outcome"), F.when(mine, F.col("pending_version")).when(new, F.coalesce("_top", F.lit(0)) + 1).cast("int").alias("version"), F.when(mine, F.col("_g")).when(new, F.coalesce("_g", F.lit(0)) + 1).cast("int").alias("document_generation"),
        F.when(mine, F.col("_f")).when(new, F.coalesce("_f", F.lit(0)) + 1).cast("int").alias("fence_token"), F.when(new, F.coalesce("_others", F.lit(0))).otherwise(0).cast("bigint").alias("n_burned"),
    )


def published(entries: DataFrame, ledger: DataFrame) -> DataFrame:
    """The ledger after every pending version whose vectors are ready was published: it is available, the version before it retired. ``new_state`` beside ``state``."""
    e = entries.where("pending_version is not null and vector_ready and status = 'pending'").select("document_id", "pending_version", "active_version")
    new = F.when(F.col("version") == F.col("pending_version"), "published_available").when((F.col("version") == F.col("active_version")) & (F.col("state") == "published_available"), "retired").otherwise(F.col("state"))
    return ledger.join(e, "document_id").select("document_id", "version", "operation_id", "state", new.alias("new_state"))


def failed(entries: DataFrame, ledger: DataFrame) -> DataFrame:
    """(document_id, status, new_status, n_failed): what becomes of pending documents whose build failed. One with an artifact stays in part, one without is unavailable;
    its reserved versions fail."""
    n = ledger.where("state = 'reserved'").select("document_id", "version", "operation_id").distinct().groupBy("document_id").agg(F.count(F.lit(1)).alias("n_failed"))
    e = entries.where("status = 'pending'").join(n, "document_id", "left")
    return e.select("document_id", "status", F.when(F.col("active_artifact_key").isNotNull(), "partial").otherwise("unavailable").alias("new_status"), F.coalesce("n_failed", F.lit(0)).cast("bigint").alias("n_failed"))


def denials(points: DataFrame, entries: DataFrame) -> DataFrame:
    """(document_id, n_points, n_controls, proof): for each tombstoned document the rows still to be deleted, its deny controls, and the digest
    of the claim a cleanup must show."""
    t = entries.where("status = 'tombstoned'")
    text = F.concat_ws("|", "document_id", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("document_generation", "document_attempt_id", "document_fence_token")])
    held = points.groupBy("document_id").agg(F.count_if(F.col("graph_control_point").isNull()).alias("n_points"), F.count_if(F.col("graph_control_point") == "tombstone").alias("n_controls"))
    return t.select("document_id", F.sha2(text, 256).alias("proof")).join(held, "document_id", "left").select("document_id", F.coalesce("n_points", F.lit(0)).cast("bigint").alias("n_points"), F.coalesce("n_controls", F.lit(0)).cast("bigint").alias("n_controls"), "proof")


def authorised(points: DataFrame, entries: DataFrame, ledger: DataFrame, after: DataFrame | None = None) -> DataFrame:
    """The vector rows a query may return: of the generation that is active for their document. ``after`` are the entries as read once the search is done;
    rows of a document whose generation, attempt or fence changed meanwhile are left out."""
    now = active_generations(entries, ledger).where("active_generation is not null").select("document_id", "active_generation")
    rows = points.where("vector_point and graph_control_point is null and graph_tombstoned is not true").join(now, "document_id").where("document_generation = active_generation").select(*points.columns)
    if after is None:
        return rows
    claim = ("document_generation", "document_attempt_id", "document_fence_token", "status")
    same = entries.select("document_id", *[F.col(c).alias(f"_{c}") for c in claim]).join(after.select("document_id", *claim), "document_id")
    for c in claim:
        same = same.where(F.col(c).eqNullSafe(F.col(f"_{c}")))
    return rows.join(same.select("document_id"), "document_id", "left_semi").select(*points.columns)


def claims(entries: DataFrame, ledger: DataFrame) -> DataFrame:
    """(document_id, version, same): whether a ledger row's claim is the entry's, field by field, nothing equal to nothing."""
    e = entries.select("document_id", F.col("document_attempt_id").alias("_a"), F.col("document_generation").alias("_g"), F.col("active_version").alias("_v"), F.col("pending_version").alias("_p"))
    same = F.col("attempt_id").eqNullSafe(F.col("_a")) & F.col("document_generation").eqNullSafe(F.col("_g")) & (F.col("version").eqNullSafe(F.col("_v")) | F.col("version").eqNullSafe(F.col("_p")))
    return ledger.join(e, "document_id").select("document_id", "version", same.alias("same")).groupBy("document_id", "version").agg(F.max("same").alias("same"))


def backfill_groups(points: DataFrame) -> DataFrame:
    """(document_id, n, n_generations, n_sizes, valid): the vector rows of a document may be filled in anew if they are of one generation, their vectors of one size and usable."""
    v = points.where("vector_point").select("document_id", "document_generation", F.size("embedding").alias("_n"), (F.size(F.filter("embedding", lambda x: x.isNull() | F.isnan(x) | x.isin(float("inf"), float("-inf")))) > 0).alias("_bad"))
    g = v.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.coalesce("document_generation", F.lit(-1))).alias("n_generations"), F.countDistinct(F.coalesce("_n", F.lit(-1))).alias("n_sizes"), F.max(F.coalesce("_bad", F.lit(True))).alias("_bad"))
    return g.select("document_id", "n", "n_generations", "n_sizes", ((F.col("n_generations") == 1) & (F.col("n_sizes") == 1) & ~F.col("_bad")).alias("valid"))


def once_published(entries: DataFrame) -> DataFrame:
    """The entries as they are when every pending version has been published: their generation is the next one."""
    return entries.withColumn("document_generation", F.col("document_generation") + F.col("pending_version").isNotNull().cast("int"))
