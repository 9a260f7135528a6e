"""Entity mentions and relation evidence: validity, canonical records, tiers, support, recovery candidates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import materialize

#: Weights of kinds of evidence, sources that count as weak, the widest gap that still is near.
WEIGHTS = {"verified": 1.0, "explicit": 1.0, "same_sentence": 0.6, "nearby_window": 0.4, "same_chunk": 0.2}
LABEL_ALIASES = {"organization": "org", "company": "org", "institution": "org", "location": "loc", "geopolitical_entity": "gpe", "facility": "fac"}
WEAK_SOURCES, ACTIVE_KINDS, NEAR = ("rule-based", "fallback"), ("explicit", "verified"), 120
NEIGHBOURHOOD_CAP = 16
#: What a verifier is shown of a candidate, and what is asked of an extractor at once.
WINDOW_CHUNKS, WINDOW_CHARS, WINDOW_RELATIONS, ASKED_ENTITIES, ASKED_RELATIONS = 8, 600, 8, 20, 8
#: Candidates of an entity, of a chunk and of a document.
ENTITY_CAP, CHUNK_CAP, TOTAL_CAP = 4, 6, 24


def valid_mentions(mentions: DataFrame) -> DataFrame:
    """Mentions whose cleaned text can name something: longer than two characters, no stop word, year, number or mere punctuation, of a known label."""
    t = T.clean_entity(F.col("text"))
    low = F.lower(F.trim(t))
    ok = (F.length(t) > 2) & ~low.isin(*T.STOP_ENTITIES) & ~t.rlike(r"^(19|20)\d{2}$") & ~t.rlike(r"^[0-9]+$") & ~t.rlike(r"^[^\p{L}\p{N}]+$") & F.col("label").isin(*T.ENTITY_LABELS)
    return mentions.withColumn("entity", t).where(ok)


def distinct_mentions(mentions: DataFrame) -> DataFrame:
    """One mention per chunk, lower-case text and label: the first by position."""
    m = valid_mentions(mentions)
    g = m.groupBy("document_id", "chunk_uid", F.lower("entity").alias("name"), "label")
    return g.agg(F.min(F.struct(F.coalesce("start_char", F.lit(2**31 - 1)).alias("pos"), "entity")).alias("_f"), F.count(F.lit(1)).alias("n")).select("document_id", "chunk_uid", "name", "label", F.col("_f.entity").alias("entity"), F.col("_f.pos").alias("pos"), "n")


def canonical_mentions(mentions: DataFrame) -> DataFrame:
    """Each valid mention with its canonical id within the document; a surface seen with several labels gets the label into its id.

    Labels per surface are aggregated, then joined back, so a surface of very many mentions is no single window.
    """
    m = valid_mentions(mentions).withColumn("surface", T.canonical_surface(F.col("entity"))).where("surface <> ''")
    labels = m.groupBy("document_id", "surface").agg(F.countDistinct("label").alias("_labels"))
    m = m.join(labels, ["document_id", "surface"])
    return m.withColumn("canonical", F.when(F.col("_labels") > 1, T.canonical_id(F.col("surface"), F.col("label"))).otherwise(T.canonical_id(F.col("surface"))))


def canonical_entities(mentions: DataFrame) -> DataFrame:
    """(document_id, canonical, aliases, n_chunks, mention_count)"""
    g = canonical_mentions(mentions).groupBy("document_id", "canonical")
    return g.agg(F.sort_array(F.collect_set("entity")).alias("aliases"), F.countDistinct("chunk_uid").alias("n_chunks"), F.count(F.lit(1)).alias("mention_count"))


def cooccurrences(mentions: DataFrame) -> DataFrame:
    """(document_id, chunk_uid, head, tail): pairs of different entities of one chunk, in order of appearance, once each.

    The join is on the chunk, whose text bounds the number of its entities.
    """
    d = distinct_mentions(mentions).groupBy("document_id", "chunk_uid", "name").agg(F.min("pos").alias("pos"))
    a = d.select("document_id", "chunk_uid", F.col("name").alias("head"), F.col("pos").alias("_p"))
    b = d.select("chunk_uid", F.col("name").alias("tail"), F.col("pos").alias("_q"))
    return a.join(b, "chunk_uid").where((F.col("_p") < F.col("_q")) | ((F.col("_p") == F.col("_q")) & (F.col("head") < F.col("tail")))).select("document_id", "chunk_uid", "head", "tail")


def evidence_tiers(mentions: DataFrame) -> DataFrame:
    """Each co-occurrence with the best tier any pair of mentions gives it: one sentence, at most NEAR characters apart, or one chunk."""
    m = valid_mentions(mentions).select("chunk_uid", F.lower("entity").alias("name"), "sentence_index", "sentence_start_char", "sentence_end_char", "start_char", "end_char").distinct()
    left = m.select(*[F.col(c).alias(f"h_{c}" if c != "chunk_uid" else c) for c in m.columns])
    right = m.select(*[F.col(c).alias(f"t_{c}" if c != "chunk_uid" else c) for c in m.columns])
    pairs = cooccurrences(mentions)
    pairs = pairs.join(left, ["chunk_uid"]).where("head = h_name").join(right, ["chunk_uid"]).where("tail = t_name")
    one = (F.col("h_sentence_index") == F.col("t_sentence_index")) | ((F.col("h_sentence_start_char") == F.col("t_sentence_start_char")) & (F.col("h_sentence_end_char") == F.col("t_sentence_end_char")))
    spans = (F.col("h_end_char") >= F.col("h_start_char")) & (F.col("t_end_char") >= F.col("t_start_char"))
    gap = F.greatest(F.col("h_start_char") - F.col("t_end_char"), F.col("t_start_char") - F.col("h_end_char"), F.lit(0))
    tier = F.when(F.coalesce(one, F.lit(False)), 3).when(F.coalesce(spans & (gap <= NEAR), F.lit(False)), 2).otherwise(1)
    best = pairs.groupBy("document_id", "chunk_uid", "head", "tail").agg(F.max(tier).alias("_t"))
    kind = F.when(F.col("_t") == 3, "same_sentence").when(F.col("_t") == 2, "nearby_window").otherwise("same_chunk")
    return best.select("document_id", "chunk_uid", "head", "tail", kind.alias("evidence_type")).withColumn("weight", weight(F.col("evidence_type")))


def label_key(label: Column) -> Column:
    """A label in lower case under its short name; nothing for none."""
    low = F.coalesce(F.lower(F.trim(label)), F.lit(""))
    return F.coalesce(F.create_map(*[F.lit(x) for kv in LABEL_ALIASES.items() for x in kv])[low], low)


def labels_fit(left: Column, right: Column) -> Column:
    """Whether two entities may be of one kind: by their label keys, of which an empty one fits any."""
    a, b = label_key(left), label_key(right)
    return (a == "") | (b == "") | (a == b)


def weight(kind: Column) -> Column:
    w = F.lit(0.0)
    for k, v in WEIGHTS.items():
        w = F.when(kind == k, F.lit(v)).otherwise(w)
    return w


def normal_evidence(evidence: DataFrame) -> DataFrame:
    """Evidence rows with defaults by source, confidence within [0, 1], support sorted and distinct."""
    source = F.coalesce(T.blank_to_null(F.col("source")), F.lit("llm"))
    weak = F.lower(source).isin(*WEAK_SOURCES)
    kind = F.coalesce(T.blank_to_null(F.col("evidence_type")), F.when(weak, "same_chunk").otherwise("explicit"))
    status = F.coalesce(T.blank_to_null(F.col("status")), F.when(weak, "unverified").otherwise("accepted"))
    support = F.array_sort(F.array_distinct(F.filter(F.coalesce("support_chunk_uids", F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))))
    return evidence.select(
        "document_id", "head", "relation", "tail", source.alias("source"), F.coalesce(T.blank_to_null(F.col("scope")), F.lit("local")).alias("scope"), T.clamp_confidence(F.col("confidence"), weight(kind)).alias("confidence"),
        support.alias("support_chunk_uids"), kind.alias("evidence_type"), F.coalesce(T.blank_to_null(F.col("verification_state")), status).alias("verification_state"), status.alias("status"), weight(kind).alias("resolved_weight"),
    )


def active(evidence: DataFrame) -> DataFrame:
    return evidence.where((F.col("status") == "accepted") & F.col("evidence_type").isin(*ACTIVE_KINDS))


def distinct_relations(evidence: DataFrame) -> DataFrame:
    """One row per document and lower-case (head, relation, tail), with its number of rows and highest confidence."""
    g = evidence.groupBy("document_id", F.lower("head").alias("head"), F.lower("relation").alias("relation"), F.lower("tail").alias("tail"))
    return g.agg(F.count(F.lit(1)).alias("n"), F.max("confidence").alias("confidence"))


def coalesced_edges(evidence: DataFrame) -> DataFrame:
    """Per document and unordered pair of endpoint keys: highest weight, union of support, number of rows; relations to oneself are dropped."""
    h, t = T.endpoint_key(F.col("head")), T.endpoint_key(F.col("tail"))
    e = evidence.select("document_id", F.least(h, t).alias("src"), F.greatest(h, t).alias("dst"), "resolved_weight", "support_chunk_uids").where("src <> dst")
    g = e.groupBy("document_id", "src", "dst").agg(F.max("resolved_weight").alias("weight"), F.count(F.lit(1)).alias("evidence_count"), F.array_distinct(F.flatten(F.collect_set("support_chunk_uids"))).alias("_s"))
    return g.select("document_id", "src", "dst", "weight", "evidence_count", F.size("_s").cast("bigint").alias("n_support"))


def resolved_endpoints(evidence: DataFrame, entities: DataFrame) -> DataFrame:
    """Evidence with both ends resolved to entities of its document; a key that fits several entities resolves to none."""
    keys = entities.select("document_id", "canonical_id", F.explode(F.array_distinct(F.array(T.endpoint_key(F.col("original_mention")), T.endpoint_key(F.col("canonical_text"))))).alias("_k")).where("_k is not null")
    one = keys.groupBy("document_id", "_k").agg(F.min("canonical_id").alias("_id"), F.countDistinct("canonical_id").alias("_n")).where("_n = 1").drop("_n")
    e = evidence.select("document_id", "head", "relation", "tail", T.endpoint_key(F.col("head")).alias("_h"), T.endpoint_key(F.col("tail")).alias("_t"))
    e = e.join(one.select("document_id", F.col("_k").alias("_h"), F.col("_id").alias("head_id")), ["document_id", "_h"]).join(one.select("document_id", F.col("_k").alias("_t"), F.col("_id").alias("tail_id")), ["document_id", "_t"])
    return e.where("head_id <> tail_id").select("document_id", "head", "relation", "tail", "head_id", "tail_id")


def entity_support(mentions: DataFrame, evidence: DataFrame, protected: DataFrame | None = None) -> DataFrame:
    """Per document and canonical entity: mentions, support by relations, whether it is a candidate for noise, and protection.

    Endpoints are canonicalised without a label, so an entity whose id carries its label has no relations; that is as intended.
    """
    m = canonical_mentions(mentions)
    e = m.groupBy("document_id", "canonical").agg(F.count(F.lit(1)).alias("mention_count"))
    ends = evidence.select("document_id", F.explode(F.array("head", "tail")).alias("_e"), ((F.col("status") == "accepted") & F.col("evidence_type").isin(*ACTIVE_KINDS)).alias("_active")).where("_e is not null")
    ends = ends.groupBy("document_id", T.canonical_id(T.canonical_surface(F.col("_e"))).alias("canonical")).agg(F.max(F.coalesce("_active", F.lit(False))).alias("_active"))
    out = e.join(ends, ["document_id", "canonical"], "left")
    support = F.when(F.col("_active"), "strongly_supported").when(F.col("_active").isNotNull(), "weakly_supported").otherwise("mention_only")
    out = out.select("document_id", "canonical", "mention_count", support.alias("support"), ((F.col("mention_count") == 1) & F.col("_active").isNull()).alias("isolated_noise_candidate"))
    if protected is not None:
        hit = m.join(protected.select("chunk_uid").distinct(), "chunk_uid", "left_semi").select("document_id", "canonical").distinct().withColumn("_p", F.lit(True))
        out = out.join(hit, ["document_id", "canonical"], "left").withColumn("query_protected", F.coalesce("_p", F.lit(False))).drop("_p")
    return out


def cleaned_entities(support: DataFrame) -> DataFrame:
    """What stays once unprotected candidates for noise are taken out."""
    keep = ~F.col("isolated_noise_candidate")
    if "query_protected" in support.columns:
        keep = keep | F.col("query_protected")
    return support.where(keep)


def neighbourhoods(chunks: DataFrame, mentions: DataFrame, semantic: DataFrame) -> DataFrame:
    """(document_id, a, b, triggers), a < b: pairs of chunks of a document that are near in one of several ways.

    Groups (an entity, a section, a paragraph) link only chunks that follow each other in the document, so they grow linearly.
    """
    c = chunks.groupBy("document_id", "chunk_uid").agg(F.min("chunk_id").alias("chunk_id"), F.max("hierarchy.section_id").alias("section"), F.max("hierarchy.paragraph_id").alias("paragraph"), F.max("hierarchy.parent_chunk_uid").alias("parent"))

    def follow(rows: DataFrame, trigger: str) -> DataFrame:
        w = Window.partitionBy("document_id", "g").orderBy("chunk_id", "chunk_uid")
        return rows.select("document_id", F.col("chunk_uid").alias("x"), F.lead("chunk_uid").over(w).alias("y"), F.lit(trigger).alias("t")).where("y is not null")

    ids = canonical_mentions(mentions).select("document_id", "chunk_uid", F.col("canonical").alias("g")).distinct().join(c.select("document_id", "chunk_uid", "chunk_id"), ["document_id", "chunk_uid"])
    parts = [
        semantic.select("document_id", F.col("i").alias("x"), F.col("j").alias("y"), F.lit("semantic_neighbor").alias("t")),
        follow(ids, "canonical_identity"),
        follow(c.where("section <> ''").withColumn("g", F.col("section")), "hierarchy_adjacency"),
        follow(c.where("paragraph <> ''").withColumn("g", F.col("paragraph")), "hierarchy_adjacency"),
        c.where("parent <> ''").select("document_id", F.col("chunk_uid").alias("x"), F.col("parent").alias("y"), F.lit("hierarchy_adjacency").alias("t")).join(c.select("document_id", F.col("chunk_uid").alias("y")), ["document_id", "y"], "left_semi").select("document_id", "x", "y", "t"),
    ]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    every = every.where("x <> y").select("document_id", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "t")
    return every.groupBy("document_id", "a", "b").agg(F.sort_array(F.collect_set("t")).alias("triggers"))


def _recovery_pairs(near: DataFrame, mentions: DataFrame, support: DataFrame) -> DataFrame:
    """(document_id, a, b, triggers, l, r, _k): entity pairs across near chunks of which one holds a weakly supported entity, numbered within the chunks."""
    ent = canonical_mentions(mentions).groupBy("document_id", "chunk_uid", "canonical").agg(F.min("label").alias("label"))
    weak = support.where("support <> 'strongly_supported'").select("document_id", "canonical")
    weak_chunks = ent.join(weak, ["document_id", "canonical"], "left_semi").select("document_id", "chunk_uid").distinct()
    w = weak_chunks.withColumn("_w", F.lit(True))
    n = near.join(w.select("document_id", F.col("chunk_uid").alias("a"), F.col("_w").alias("_wa")), ["document_id", "a"], "left").join(w.select("document_id", F.col("chunk_uid").alias("b"), F.col("_w").alias("_wb")), ["document_id", "b"], "left").where("_wa or _wb")
    left = ent.select("document_id", F.col("chunk_uid").alias("a"), F.col("canonical").alias("l"), F.col("label").alias("_ll"))
    right = ent.select("document_id", F.col("chunk_uid").alias("b"), F.col("canonical").alias("r"), F.col("label").alias("_lr"))
    p = n.join(left, ["document_id", "a"]).join(right, ["document_id", "b"]).where((F.col("l") != F.col("r")) & labels_fit(F.col("_ll"), F.col("_lr")))
    return p.withColumn("_k", F.row_number().over(Window.partitionBy("document_id", "a", "b").orderBy("l", "r")))


def recovery_candidates(near: DataFrame, mentions: DataFrame, support: DataFrame, cap: int = NEIGHBOURHOOD_CAP) -> DataFrame:
    """(document_id, head, tail, n_support, triggers): entity pairs across near chunks of which one holds a weakly supported entity.

    The cap is the operator's own rule: the first ``cap`` pairs of each pair of chunks, in order of their ids.
    """
    p = _recovery_pairs(near, mentions, support).where(F.col("_k") <= cap)
    g = p.groupBy("document_id", F.least("l", "r").alias("head"), F.greatest("l", "r").alias("tail")).agg(F.array_distinct(F.flatten(F.collect_list(F.array("a", "b")))).alias("_s"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("triggers")))).alias("triggers"))
    return g.select("document_id", "head", "tail", F.size("_s").cast("bigint").alias("n_support"), F.array_join("triggers", ",").alias("triggers"))


def _capped(entity_cap: int, chunk_cap: int, total_cap: int):
    def run(key, b):
        entities: dict[str, int] = {}
        chunks: dict[str, int] = {}
        reasons, total = [], 0
        b = b.sort_values(["head", "tail"])
        for head, tail, support in zip(b["head"], b["tail"], b["support_chunk_uids"]):
            if max(entities.get(head, 0), entities.get(tail, 0)) >= entity_cap:
                reasons.append("per_entity_cap")
            elif any(chunks.get(c, 0) >= chunk_cap for c in support):
                reasons.append("per_chunk_cap")
            elif total >= total_cap:
                reasons.append("total_cap")
            else:
                reasons.append(None)
                total += 1
                for e in (head, tail):
                    entities[e] = entities.get(e, 0) + 1
                for c in support:
                    chunks[c] = chunks.get(c, 0) + 1
        return b.assign(reason=pd.array(reasons, dtype="object"))

    return run


def capped_candidates(near: DataFrame, mentions: DataFrame, support: DataFrame, cap: int = NEIGHBOURHOOD_CAP, entity_cap: int = ENTITY_CAP, chunk_cap: int = CHUNK_CAP, total_cap: int = TOTAL_CAP) -> DataFrame:
    """(document_id, head, tail, support_chunk_uids, triggers, reason): recovery candidates, and with a reason what a cap turned away.

    A pair beyond the cap of its two chunks is a row of its own; the others are merged, then taken per document in the order of
    their ids as long as both entities, all chunks and the document have room.
    """
    # the triggers of a candidate name the rules it came by besides the ones of its chunks
    also = F.array(F.lit("compatible_entity_label"), F.lit("weak_orphan_recovery"))
    p = materialize(_recovery_pairs(near, mentions, support).select("document_id", F.least("l", "r").alias("head"), F.greatest("l", "r").alias("tail"), F.array("a", "b").alias("_s"), F.concat("triggers", also).alias("_t"), "_k"), "recovery-pairs")
    merged = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    g = p.where(F.col("_k") <= cap).groupBy("document_id", "head", "tail").agg(merged("_s").alias("support_chunk_uids"), merged("_t").alias("triggers"))
    shape = "document_id string, head string, tail string, support_chunk_uids array<string>, triggers array<string>, reason string"
    taken = g.groupBy("document_id").applyInPandas(_capped(entity_cap, chunk_cap, total_cap), shape)
    beyond = p.where(F.col("_k") > cap).select("document_id", "head", "tail", F.array_sort("_s").alias("support_chunk_uids"), F.array_sort("_t").alias("triggers"), F.lit("per_neighborhood_cap").alias("reason"))
    return taken.unionByName(beyond)


def recovered_evidence(candidates: DataFrame, mentions: DataFrame, verified: DataFrame | None = None) -> DataFrame:
    """Raw evidence of candidates under their names, by the verifier's rows (document_id, head, tail, status, relation, confidence, support_chunk_uids);
    a candidate that no row speaks of is unavailable. Only accepted ones get active; one without a relation, with a confidence beyond [0, 1]
    or with support outside the candidate's chunks is insufficient.
    """
    if verified is None:
        verified = candidates.sparkSession.createDataFrame([], "document_id string, head string, tail string, status string, relation string, confidence double, support_chunk_uids array<string>")
    names = canonical_mentions(mentions).groupBy("document_id", "canonical").agg(F.min("surface").alias("_name"))
    # one answer a candidate: the least by its fields
    v = verified.groupBy("document_id", "head", "tail").agg(F.min(F.struct(F.col("status").alias("s"), F.col("relation").alias("r"), F.col("confidence").cast("double").alias("c"), F.col("support_chunk_uids").alias("u"))).alias("_v"))
    e = candidates.join(v, ["document_id", "head", "tail"], "left")
    for end in ("head", "tail"):
        e = e.join(names.select("document_id", F.col("canonical").alias(end), F.col("_name").alias(f"_{end}")), ["document_id", end])
    sound = (F.trim("_v.r") != "") & F.col("_v.c").between(0.0, 1.0) & (F.size("_v.u") > 0) & (F.size(F.array_except("_v.u", "support_chunk_uids")) == 0)
    status = F.when(F.col("_v.s").isNull(), "unavailable").when(F.col("_v.s") == "accepted", F.when(F.coalesce(sound, F.lit(False)), "accepted").otherwise("insufficient")).when(F.col("_v.s") == "rejected", "rejected").otherwise("insufficient")
    e = e.withColumn("status", status)
    yes = F.col("status") == "accepted"
    return e.select(
        "document_id", F.col("_head").alias("head"), F.when(yes, F.trim("_v.r")).alias("relation"), F.col("_tail").alias("tail"), F.lit("recovery").alias("source"), F.lit("cross_chunk").alias("scope"), F.when(yes, F.col("_v.c")).alias("confidence"),
        F.when(yes, F.col("_v.u")).otherwise(F.col("support_chunk_uids")).alias("support_chunk_uids"), F.when(yes, "verified").otherwise("unverified").alias("evidence_type"), F.when(yes, "verified").otherwise(F.col("status")).alias("verification_state"), "status",
    )


def mention_edges(chunks: DataFrame, mentions: DataFrame) -> DataFrame:
    """(document_id, chunk_uid, entity, weight): the canonical entities of each of the chunks."""
    m = canonical_mentions(mentions).join(chunks.select("chunk_uid"), "chunk_uid", "left_semi")
    return m.select("document_id", "chunk_uid", F.col("canonical").alias("entity"), F.lit(1.0).alias("weight")).distinct()


def recovery_support(near: DataFrame, mentions: DataFrame, support: DataFrame, cap: int = NEIGHBOURHOOD_CAP) -> DataFrame:
    """(document_id, head, tail, chunk_uid): the chunks each recovery candidate stands on."""
    p = _recovery_pairs(near, mentions, support).where(F.col("_k") <= cap)
    return p.select("document_id", F.least("l", "r").alias("head"), F.greatest("l", "r").alias("tail"), F.explode(F.array("a", "b")).alias("chunk_uid")).distinct()


def evidence_windows(support: DataFrame, chunks: DataFrame, semantic: DataFrame, evidence: DataFrame, most: int = WINDOW_CHUNKS, chars: int = WINDOW_CHARS, relations: int = WINDOW_RELATIONS) -> DataFrame:
    """(document_id, head, tail, chunk_uids, texts, n_chunks, n_chars, relations, n_relations): what a verifier is shown of each candidate: its own chunks, semantic neighbours of theirs as
    long as there are fewer than ``most``, the beginning of each text, and the first relations that any of the chunks supports. The limits are the window's own."""
    key = ["document_id", "head", "tail"]
    sides = semantic.select("document_id", F.col("i").alias("chunk_uid"), F.col("j").alias("v")).unionByName(semantic.select("document_id", F.col("j").alias("chunk_uid"), F.col("i").alias("v")))
    beside = support.join(sides, ["document_id", "chunk_uid"]).select(*key, F.col("v").alias("chunk_uid")).distinct().join(support, [*key, "chunk_uid"], "left_anti")
    every = support.withColumn("_far", F.lit(0)).unionByName(beside.withColumn("_far", F.lit(1)))
    order = Window.partitionBy(*key).orderBy("_far", "chunk_uid")
    win = every.withColumn("_k", F.row_number().over(order)).where((F.col("_far") == 0) | (F.col("_k") <= most))
    texts = chunks.where("text is not null").groupBy("chunk_uid").agg(F.max("text").alias("_t"))
    shown = win.join(texts, "chunk_uid", "left").withColumn("_t", F.substring(F.coalesce("_t", F.lit("")), 1, chars))
    w = shown.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("_k", "chunk_uid", "_t"))).alias("_w"), F.count(F.lit(1)).alias("n_chunks"), F.sum(F.length("_t")).cast("bigint").alias("n_chars"))
    told = evidence.select("document_id", F.explode("support_chunk_uids").alias("chunk_uid"), F.struct(F.col("head").alias("head"), F.col("relation").alias("relation"), F.col("tail").alias("tail")).alias("_r"))
    told = win.join(told, ["document_id", "chunk_uid"]).select(*key, "_r").distinct().withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy("_r"))).where(F.col("_n") <= relations)
    told = told.groupBy(*key).agg(F.array_sort(F.collect_list("_r")).alias("relations"))
    names = lambda f: F.transform("_w", lambda x: x[f])
    return w.join(told, key, "left").select(*key, names("chunk_uid").alias("chunk_uids"), names("_t").alias("texts"), "n_chunks", "n_chars", "relations", F.coalesce(F.size("relations"), F.lit(0)).cast("bigint").alias("n_relations"))


def relation_requests(mentions: DataFrame, entities: int = ASKED_ENTITIES, relations: int = ASKED_RELATIONS) -> DataFrame:
    """(chunk_uid, n_entities, asked, most_relations) of chunks with two entities or more: the first ``entities`` names that relations are asked for."""
    m = mentions.where("trim(text) <> ''").groupBy("chunk_uid", F.lower(F.trim("text")).alias("name")).agg(F.min(F.coalesce("start_char", F.lit(2**31 - 1))).alias("pos"))
    n = m.groupBy("chunk_uid").agg(F.count(F.lit(1)).alias("n_entities")).where("n_entities >= 2")
    first = m.withColumn("_k", F.row_number().over(Window.partitionBy("chunk_uid").orderBy("pos", "name"))).where(F.col("_k") <= entities)
    asked = first.groupBy("chunk_uid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", "name"))), lambda x: x["name"]), "; ").alias("asked"))
    return n.join(asked, "chunk_uid").select("chunk_uid", "n_entities", "asked", F.lit(relations).alias("most_relations"))


def united(local: DataFrame, recovered: DataFrame) -> DataFrame:
    """(document_id, head, relation, tail, n, recovered): relations told in place or recovered, names in lower case, and whether any piece was recovered."""
    low = [F.lower(c).alias(c) for c in ("head", "relation", "tail")]
    u = local.select("document_id", *low, F.lit(False).alias("_r")).unionByName(recovered.select("document_id", *low, F.lit(True).alias("_r")))
    return u.groupBy("document_id", "head", "relation", "tail").agg(F.count(F.lit(1)).alias("n"), F.max("_r").alias("recovered"))


def extracted_entities(chunks: DataFrame, extract=None) -> DataFrame:
    """(chunk_uid, sentence_index, entity) of chunks (chunk_uid, text). ``extract`` gives the entities of a text column as an array; without it they are
    its acronyms and title-case words."""
    s = chunks.select("chunk_uid", F.posexplode(T.sentences(F.col("text"))).alias("sentence_index", "_s"))
    return s.select("chunk_uid", "sentence_index", F.explode((extract or T.named_like)(F.col("_s"))).alias("entity"))


def adjacent_occurrences(mentions: DataFrame, chunks: DataFrame) -> DataFrame:
    """(document_id, canonical, chunk_uid, next_uid): each chunk that mentions an entity with the next one of the document that does."""
    c = chunks.groupBy("document_id", "chunk_uid").agg(F.min("chunk_id").alias("chunk_id"))
    o = canonical_mentions(mentions).select("document_id", "canonical", "chunk_uid").distinct().join(c, ["document_id", "chunk_uid"])
    later = F.lead("chunk_uid").over(Window.partitionBy("document_id", "canonical").orderBy("chunk_id", "chunk_uid"))
    return o.select("document_id", "canonical", "chunk_uid", later.alias("next_uid")).where("next_uid is not null")
