import pytest
from pyspark.sql import functions as F

from docweave.operators import chunking
from docweave.operators import context as C
from docweave.operators import evaluate as V
from docweave.operators import evidence as E
from docweave.operators import graph as G
from docweave.operators import lifecycle as L
from docweave.operators import retrieval as R
from docweave.operators import summarize as S
from docweave.sources.collections import Collection, empty_graph, evidence_source

ENTRY = "document_id string, document_generation int, document_attempt_id string, document_fence_token int, status string, vector_ready boolean, active_version int, pending_version int, active_artifact_key string, failure_reason string"
LEDGER = "document_id string, version int, document_generation int, operation_id string, attempt_id string, fence_token int, state string"


@pytest.fixture(scope="module")
def tables(spark):
    entries = [
        ("a", 2, "x", 3, "pending", True, 1, 2, "k", None), ("b", 1, "y", 1, "available", True, 4, None, "k", None), ("c", 1, "z", 1, "pending", False, None, 1, None, None),
        ("d", 3, "w", 5, "tombstoned", True, 2, None, "k", None), ("e", 1, "v", 1, "stale", False, 1, None, "k", "late"),
    ]
    ledger = [("a", 1, 1, "op1", "o", 1, "published_available"), ("a", 2, 2, "op2", "x", 3, "reserved"), ("a", 2, 2, "op2", "x", 3, "reserved"), ("b", 4, 1, "op9", "y", 1, "published_available"), ("c", 1, 1, "op3", "z", 1, "reserved"), ("d", 2, 3, "op4", "w", 5, "tombstoned"), ("b", None, 1, "op9", "y", 1, "burned")]
    return spark.createDataFrame(entries, ENTRY), spark.createDataFrame(ledger, LEDGER)


def test_reservations(spark, tables):
    asked = spark.createDataFrame([("a", "op2", "replace-document"), ("b", "new", "append"), ("c", "other", "replace-document"), ("n", "new", "append")], "document_id string, operation_id string, mode string")
    got = {r.document_id: tuple(r)[1:] for r in L.reservations(*tables, asked).collect()}
    assert got == {"a": ("resumed", 2, 2, 3, 0), "b": ("refused", None, None, None, 0), "c": ("reserved", 2, 2, 2, 1), "n": ("reserved", 1, 1, 1, 0)}
    assert L.reservations(tables[0].limit(0), tables[1].limit(0), asked).where("outcome = 'reserved' and version = 1").count() == 4


def test_publishing_failing_and_generations(tables):
    entries, ledger = tables
    assert {(r.version, r.new_state) for r in L.published(entries, ledger).collect()} == {(1, "retired"), (2, "published_available")}
    assert {r.document_id: (r.new_status, r.n_failed) for r in L.failed(entries, ledger).collect()} == {"a": ("partial", 1), "c": ("unavailable", 1)}
    assert {r.document_id: r.active_generation for r in L.active_generations(entries, ledger).collect()} == {"a": 1, "b": 1, "c": None, "d": None, "e": None}
    assert {(r.document_id, r.version): r.same for r in L.claims(entries, ledger).collect()} == {("a", 1): False, ("a", 2): True, ("b", 4): True, ("b", None): True, ("c", 1): True, ("d", 2): True}


def test_denials_and_authorisation(spark, tables):
    entries, ledger = tables
    shape = "point_id string, document_id string, document_generation int, vector_point boolean, graph_control_point string, graph_tombstoned boolean, embedding array<double>"
    points = spark.createDataFrame([("p1", "a", 1, True, None, None, [1.0]), ("p2", "a", 2, True, None, None, [1.0, 2.0]), ("p3", "b", 1, True, None, False, [1.0]), ("p4", "d", 3, True, None, None, None), ("p5", "d", 3, False, "tombstone", True, None), ("p6", "e", 1, True, None, None, [float("nan")])], shape)
    d = L.denials(points, entries).collect()
    assert [(r.document_id, r.n_points, r.n_controls, len(r.proof)) for r in d] == [("d", 1, 1, 64)]
    assert {r.point_id for r in L.authorised(points, entries, ledger).collect()} == {"p1", "p3"}
    later = entries.withColumn("document_fence_token", F.when(F.col("document_id") == "b", 9).otherwise(F.col("document_fence_token")))
    assert {r.point_id for r in L.authorised(points, entries, ledger, later).collect()} == {"p1"}
    assert {r.document_id: r.valid for r in L.backfill_groups(points).collect()} == {"a": False, "b": True, "d": False, "e": False}
    assert {r.point_id for r in R.difference(points, spark.createDataFrame([("p1",), ("p1",)], "point_id string"), "point_id").collect()} == {"p2", "p3", "p4", "p5", "p6"}


def test_graph_reports_and_views(spark):
    nodes = spark.createDataFrame([("d", f"n{i:02d}", i % 5, "x" if i < 25 else "y") for i in range(30)], "document_id string, node string, degree int, community string")
    r = G.graph_summaries(nodes).collect()[0]
    assert (r.n_nodes, r.n_communities, len(r.top_nodes.split(",")), len(r.largest.split(","))) == (30, 2, 10, 20) and r.top_nodes.startswith("n04,n09")
    comp = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "c")], "node string, component string")
    assert {tuple(x) for x in G.retrieved_view(comp, spark.createDataFrame([("b",), ("z",)], "node string")).collect()} == {("a", "a", False), ("b", "a", True)}
    chunks = spark.createDataFrame([("d:1", "d", 1), ("e:1", "e", 1), ("e:2", "e", 2)], "chunk_uid string, document_id string, chunk_id int")
    asked = spark.createDataFrame([("chunk_1", "d"), ("chunk_1", None), ("chunk_2", None), ("e:1", None), ("chunk_e:2", "q"), ("other", "d")], "node string, document_id string")
    assert {(r.node, r.document_id): r.chunk_uid for r in R.graph_chunks(asked, chunks).collect()} == {("chunk_1", "d"): "d:1", ("chunk_2", None): "e:2", ("e:1", None): "e:1", ("chunk_e:2", "q"): "e:2"}


def test_windows_requests_and_prompts(spark):
    support = spark.createDataFrame([("d", "a", "b", "c1"), ("d", "a", "b", "c2")], "document_id string, head string, tail string, chunk_uid string")
    chunks = spark.createDataFrame([(f"c{i}", "x" * 700) for i in range(1, 20)], "chunk_uid string, text string")
    semantic = spark.createDataFrame([("d", "c1", f"c{i}") for i in range(2, 20)], "document_id string, i string, j string")
    evidence = spark.createDataFrame([("d", f"h{i}", "r", "t", ["c1"]) for i in range(12)] + [("d", "h0", "r", "t", ["c2"]), ("d", "far", "r", "t", ["c99"])], "document_id string, head string, relation string, tail string, support_chunk_uids array<string>")
    w = E.evidence_windows(support, chunks, semantic, evidence).collect()[0]
    assert (w.n_chunks, w.n_chars, w.n_relations) == (8, 4800, 8) and w.chunk_uids[:2] == ["c1", "c2"] and {len(t) for t in w.texts} == {600}
    m = spark.createDataFrame([("c", f" Name{i:02d}", 100 - i) for i in range(30)] + [("e", "Alone", 1), ("c", " ", 1)], "chunk_uid string, text string, start_char int")
    r = E.relation_requests(m).collect()
    assert len(r) == 1 and r[0].n_entities == 30 and r[0].asked.startswith("name29; name28") and r[0].asked.count(";") == 19
    p = S.reduce_prompts(spark.createDataFrame([("q", "2", " two "), ("q", "1", "one"), ("q", "3", " ")], "scope string, community string, summary string")).collect()
    assert {x.style for x in p} == set(S.REDUCE_STYLES) and all(x.n == 2 and x.prompt.endswith("[Community 1]\none\n\n[Community 2]\ntwo") for x in p)
    united = E.united(evidence.where("head = 'h0'"), evidence.where("head = 'h1'")).collect()
    assert {(r.head, r.n, r.recovered) for r in united} == {("h0", 2, False), ("h1", 1, True)}
    assert [tuple(r) for r in E.extracted_entities(spark.createDataFrame([("c", "NASA met. Kuiper left.")], "chunk_uid string, text string")).collect()] == [("c", 0, "nasa"), ("c", 1, "kuiper")]


def test_labels_fit(spark):
    rows = [("ORG", "Company", True), ("ORG", "PERSON", False), ("", "PERSON", True), (None, None, True), ("Location", "LOC", True), (" gpe", "geopolitical_entity", True)]
    df = spark.createDataFrame(rows, "a string, b string, want boolean").withColumn("got", E.labels_fit(F.col("a"), F.col("b")))
    assert all(r.want == r.got for r in df.collect())


def test_simple_decisions_and_merging_again(spark):
    m = spark.createDataFrame([("a", 0.2, None), ("b", 0.2, 0.5), ("c", 0.9, 0.1), ("d", None, None)], "id string, lexical_overlap double, rouge_l double")
    assert {r.id: r.passed for r in V.simple_decision(m).collect()} == {"a": False, "b": True, "c": False, "d": True}
    full = "id string, n_words int, lexical_overlap double, qa_coverage double, query_relevance double, entity_consistency double, number_date_consistency double, sentence_support double, redundancy double, rouge_l double"
    row = spark.createDataFrame([("a", 100, 0.9, 0.9, 0.9, 0.9, 1.0, 0.9, 0.9, 0.05), ("b", 100, 0.9, 0.9, 0.9, 0.9, 1.0, 0.9, 0.9, None)], full)
    assert {r.id: (r.status, r.action) for r in V.decide(row).collect()} == {"a": ("FAIL", "retry_reduce"), "b": ("PASS", "accept")}


def test_relations_support_chunks(spark):
    edges = spark.createDataFrame([("d", "c1", "ent_a"), ("d", "c1", "ent_b"), ("d", "c2", "ent_c")], "document_id string, chunk_uid string, entity string")
    ev = spark.createDataFrame([("d", "A", "b", "verified", ""), ("d", "B", "a", "explicit", "verified"), ("d", "A", "C", "explicit", "unverified"), ("d", "A", "A", "verified", "verified"), ("e", "A", "B", "verified", "")], "document_id string, head string, tail string, evidence_type string, verification_state string")
    assert {r.chunk_uid: r.support for r in C.relation_support(edges, ev).collect()} == {"c1": 4.0}


def test_structural_chunks(spark):
    text = "Lead one. Lead two.\n# Head\nA lone sentence.\n\n| a | b |\nOne. Two.\nFigure 3 shows it"
    rows = chunking.structural_chunks(spark.createDataFrame([(1, text), (2, None), (3, " \n ")], "doc_id int, text string")).orderBy("chunk_id").collect()
    got = [(r.chunk_id, r.level, r.parent_chunk_id, r.path) for r in rows]
    assert got == [
        (0, "paragraph", None, "paragraph:1"), (1, "sentence", 0, "paragraph:1/sentence:1"), (2, "sentence", 0, "paragraph:1/sentence:2"), (3, "section", None, "section:1"), (4, "paragraph", 3, "section:1/paragraph:2"), (5, "sentence", 4, "section:1/paragraph:2/sentence:1"),
        (6, "table", 3, "section:1/table:6"), (7, "paragraph", 3, "section:1/paragraph:3"), (8, "sentence", 7, "section:1/paragraph:3/sentence:1"), (9, "sentence", 7, "section:1/paragraph:3/sentence:2"), (10, "figure", 3, "section:1/figure:10"),
    ]
    assert [r.context_only for r in rows if r.chunk_id == 4] == [True] and {r.section for r in rows[3:]} == {"# Head"}


def test_collections(spark, tmp_path):
    c = Collection(spark, f"file://{tmp_path}/c")
    rows = spark.createDataFrame([("p1", "a"), ("p2", "a"), ("p3", "b")], "point_id string, document_id string")
    assert not c.exists() and c.create(rows.schema) and c.exists() and not c.create(rows.schema) and c.mode() is None
    c.append(rows, "document-safe")
    assert c.read("document-safe").count() == 3 and c.mode() == "document-safe"
    with pytest.raises(PermissionError):
        c.append(rows, "legacy-vector")
    with pytest.raises(PermissionError):
        c.read("legacy-vector")
    with pytest.raises(ValueError):
        c.append(rows, "document-safe")
    with pytest.raises(ValueError):
        c.bind("other")
    assert evidence_source(None, rows) is rows and evidence_source(rows.limit(0), rows).count() == 0
    assert all(d.count() == 0 for d in empty_graph(spark).values())
