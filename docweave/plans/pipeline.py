"""Runs made of the operators: a query over stored chunks, an ingest, and the whole way from a query to a judged summary."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import context as C
from ..operators import evaluate as E
from ..operators import evidence as M
from ..operators import graph as G
from ..operators import lifecycle as L
from ..operators import models
from ..operators import retrieval as R
from ..operators import summarize as S
from ..operators import vectors as V
from ..session import materialize


def query_only(points: DataFrame, entries: DataFrame, query: list[float], k: int = 10) -> DataFrame:
    """The k visible chunks most similar to a query vector, ranked; no active document, no row."""
    rows = R.visible(points, entries.where("status = 'available'"), entries.where("status = 'tombstoned'"))
    return V.top_k(rows.where(V.valid_vector(F.col("embedding"), len(query))), query, k, "chunk_uid").select("chunk_uid", "document_id", "text", "score", "rank")


def ingest(points: DataFrame, chunks: DataFrame, mode: str, generation: int, model=None) -> DataFrame:
    """The table of points after chunks (document_id, chunk_id, chunk_uid, text) were embedded and came in by ``mode``."""
    rows = chunks.where("not coalesce(context_only, false)") if "context_only" in chunks.columns else chunks
    v = models.embed(rows, "chunk_uid", model=model)
    new = rows.select("document_id", "chunk_id", "chunk_uid", "text").dropDuplicates(["chunk_uid"]).join(v.dropDuplicates(["chunk_uid"]), "chunk_uid")
    from ..functions.text import POINT_PREFIX, URL_NAMESPACE, uuid5

    made = new.select(uuid5(URL_NAMESPACE, F.concat(F.lit(POINT_PREFIX), "chunk_uid")).alias("point_id"), "document_id", "chunk_id", "chunk_uid", "text", "embedding", F.lit(generation).alias("document_generation"), F.lit(True).alias("vector_point"))
    missing = [c for c in points.columns if c not in made.columns]
    made = made.select("*", *[F.lit(None).cast(points.schema[c].dataType).alias(c) for c in missing]).select(*[F.col(c).cast(points.schema[c].dataType) for c in points.columns])
    return L.ingest(points, made, mode)


def document_graph(points: DataFrame, mentions: DataFrame, evidence: DataFrame, chunks: DataFrame, verify=None, k: int = 3, above: float = 0.3, least: int = 1, most: int = 5) -> dict[str, DataFrame]:
    """The graph of every document, all documents at once, in two passes: semantic edges and local evidence; candidates for lost
    relations between near chunks, within their caps; then entities, relations and mentions from local and recovered evidence.

    ``verify`` takes the candidates (document_id, head, tail, support_chunk_uids, triggers) and gives the rows ``recovered_evidence`` reads;
    without it all candidates are unavailable. What a cap turned away is in ``candidates``, with the reason.
    """
    vec = materialize(V.usable_points(points), "pipeline-vectors")
    edges = materialize(G.adaptive_topology(vec, k, above, least, most), "pipeline-edges")
    own = chunks.where("not coalesce(context_only, false)") if "context_only" in chunks.columns else chunks
    protected = chunks.where("query_protected").select("chunk_uid") if "query_protected" in chunks.columns else None
    local = M.normal_evidence(evidence)
    near = M.neighbourhoods(own, mentions, edges)
    # chunks of context only and chunks that are unknown are no place to recover from
    known = own.select("chunk_uid").distinct()
    for end in ("a", "b"):
        near = near.join(known.withColumnRenamed("chunk_uid", end), end, "left_semi")
    tried = materialize(M.capped_candidates(near, mentions, M.entity_support(mentions, local, protected)), "pipeline-candidates")
    pending = tried.where("reason is null").drop("reason")
    found = materialize(M.normal_evidence(M.recovered_evidence(pending, mentions, verify(pending) if verify else None)), "pipeline-recovered")
    # what was not accepted stays on record, but supports nothing
    e = local.unionByName(M.active(found))
    entities = M.cleaned_entities(M.entity_support(mentions, e, protected))
    men = M.mention_edges(own, mentions).join(entities.select("document_id", F.col("canonical").alias("entity")), ["document_id", "entity"], "left_semi")
    candidates = materialize(G.community_candidates(edges), "pipeline-communities")
    best = G.select_communities(candidates, edges, vec)
    every = local.withColumn("_from", F.lit("local")).unionByName(found.withColumn("_from", F.lit("recovered")))
    counts = every.groupBy("document_id", F.col("_from").alias("source"), "status").agg(F.count(F.lit(1)).alias("n"))
    turned = tried.where("reason is not null").groupBy("document_id", F.lit("caps").alias("source"), F.col("reason").alias("status")).agg(F.count(F.lit(1)).alias("n"))
    return {
        "edges": edges, "communities": candidates.join(best.select("document_id", "resolution", "seed"), ["document_id", "resolution", "seed"]).select("document_id", "node", "community"),
        "entities": entities, "relations": M.coalesced_edges(M.active(e)), "mentions": men.select("document_id", "chunk_uid", "entity", "weight"), "candidates": tried, "evidence": every.drop("_from"), "diagnostics": counts.unionByName(turned),
    }


@dataclass
class Run:
    """What a full run made, stage by stage, and how it ended."""

    retrieved: DataFrame
    context: DataFrame
    summary: DataFrame
    decision: DataFrame
    status: str
    retries: int = 0
    log: list[str] = field(default_factory=list)


def full_pipeline(spark: SparkSession, points: DataFrame, entries: DataFrame, chunks: DataFrame, query: str, vector: list[float], k: int = 10, most_retries: int = 2, mentions: DataFrame | None = None, evidence: DataFrame | None = None) -> Run:
    """Retrieve, build the graph of what was found, choose context within the budget, summarise, judge; where the gate fails for want of
    grounding, retrieve two chunks more and try again. If the graph cannot be built, everything found forms one community.
    With mentions and evidence, verified relations support the chunks that mention their ends."""
    log: list[str] = []
    support = spark.createDataFrame([], "chunk_uid string, support double")
    if mentions is not None and evidence is not None:
        support = C.relation_support(M.mention_edges(chunks, mentions).select("document_id", "chunk_uid", "entity").distinct(), M.normal_evidence(evidence)).groupBy("chunk_uid").agg(F.max("support").alias("support"))
    for turn in range(most_retries + 1):
        found = materialize(query_only(points, entries, vector, k + 2 * turn), "run-retrieved")
        try:
            edges = V.either(V.group_neighbours(found.join(points.select("chunk_uid", "embedding").dropDuplicates(["chunk_uid"]), "chunk_uid").withColumn("all", F.lit("query")), "all", "chunk_uid", 3), "all", 0.3)
            degree = G.degrees(edges.withColumnRenamed("all", "document_id")).select("node", "degree")
        except AnalysisException as e:
            # a table without the columns a graph needs; a lost executor or any other fault is not covered up
            log.append(f"graph unavailable: {e}")
            degree = spark.createDataFrame([], "node string, degree bigint")
        section = chunks.groupBy("chunk_uid").agg(F.max("hierarchy.section_id").alias("section"))
        m = found.join(section, "chunk_uid", "left").join(degree.withColumnRenamed("node", "chunk_uid"), "chunk_uid", "left").join(support, "chunk_uid", "left")
        members = m.select(F.lit("query").alias("scope"), F.concat_ws("/", "document_id", "section").alias("community"), "chunk_uid", F.col("score").alias("query"), F.greatest("score", F.lit(0.0)).alias("retrieval"), F.coalesce("degree", F.lit(0)).cast("double").alias("graph"), F.coalesce("support", F.lit(0.0)).alias("relation"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("section", F.lit("")).alias("section"), (F.col("rank") == 1).alias("protected"))
        chosen = materialize(C.select_context(members), "run-context")
        sources = members.join(chosen.where("status = 'selected'").select(F.col("id").alias("chunk_uid")), "chunk_uid").select(F.lit("query").alias("id"), F.col("chunk_uid").alias("source_id"), "text", F.col("section").alias("group"))
        asked = spark.createDataFrame([("query", "", query)], "id string, summary string, query string")
        summary = materialize(S.extractive_summaries(asked, sources, k=4), "run-summary")
        judged = summary.join(asked.select("id", "query"), "id")
        # a chunk without a section is of no group
        grouped = sources.withColumn("group", F.nullif("group", F.lit("")))
        decision = materialize(E.decide(E.gate_metrics(judged, grouped)), "run-decision")
        row = decision.select("status", "action").first()
        status, action = (row.status, row.action) if row else ("FAIL", "manual_review")
        log.append(f"turn {turn}: {status}, {action}")
        if action != "retry_retrieval":
            break
    return Run(found, chosen, summary, decision, status, turn, log)
