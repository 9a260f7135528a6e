import uuid

import pytest
from pyspark.sql import functions as F

from docweave.functions.canonical_json import canonical_json
from docweave.operators import lifecycle as L
from docweave.operators import models
from docweave.operators import retrieval as R
from docweave.plans import pipeline
from docweave.sources.artifacts import ArtifactStore, ObjectStore, flatten_context, graph_edges, graph_rows, write_table
from docweave.streaming import ingest as stream


def test_canonical_json():
    assert canonical_json({"b": [1, True, None], "a": "é\n"}) == '{"a":"é\\n","b":[1,true,null]}'
    assert [canonical_json(x) for x in (1.0, 0.1, 1e21, 1e20, 123.456, 1e-7, 0.000001, -0.0, 5e-324)] == ["1", "0.1", "1e+21", "100000000000000000000", "123.456", "1e-7", "0.000001", "0", "5e-324"]
    with pytest.raises(ValueError):
        canonical_json(float("nan"))


def test_artifacts(spark, tmp_path):
    store = ArtifactStore(spark, str(tmp_path))
    df = spark.range(50).withColumn("x", F.col("id") * 2)
    d = store.write(df, "coll", "doc/1", 1)
    assert store.write(df.repartition(7), "coll", "doc/1", 1) == d and store.read("coll", "doc/1", 1, d).count() == 50
    with pytest.raises(FileExistsError):
        store.write(df.limit(3), "coll", "doc/1", 1)
    with pytest.raises(ValueError):
        store.read("coll", "doc/1", 1, "0" * 64)


def test_object_store(tmp_path):
    s = ObjectStore(str(tmp_path))
    tag = s.put("a/b", {"fence": 2}, if_none=True)
    assert s.get("a/b") == ({"fence": 2}, tag)
    for bad in (dict(if_none=True), dict(if_match="x")):
        with pytest.raises(FileExistsError):
            s.put("a/b", {"fence": 3}, **bad)
    with pytest.raises(ValueError):
        s.put("a/b", {"fence": 1})
    s.delete("a/b")
    assert s.get("a/b") is None
    with pytest.raises(ValueError):
        s.get("../x")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("q", 1, [("c1", ["p", "g"])])], "scope string, community int, chunks array<struct<chunk_uid:string,parents:array<string>>>")
    flat = flatten_context(df)
    assert flat.first().parents == "p,g"
    for kind in ("parquet", "json", "csv"):
        write_table(flat, f"{tmp_path}/{kind}", kind)
        assert getattr(spark.read.option("header", True), kind)(f"{tmp_path}/{kind}").count() == 1
    e = spark.createDataFrame([("d", "a", "b", 0.5), ("d", "a", "c", 0.25)], "document_id string, i string, j string, sim double")
    assert sorted(map(tuple, graph_edges(graph_rows(e)).collect())) == sorted(map(tuple, e.collect()))


def test_ingest_modes(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "document_id string, v int")
    new = spark.createDataFrame([("b", 2), ("c", 2)], "document_id string, v int")
    want = {"append": {("a", 1), ("b", 1), ("c", 2)}, "replace-document": {("a", 1), ("b", 2), ("c", 2)}, "replace-collection": {("b", 2), ("c", 2)}}
    assert {m: {tuple(r) for r in L.ingest(old, new, m).collect()} for m in L.MODES} == want
    with pytest.raises(ValueError):
        L.ingest(old, new, "merge")
    assert {tuple(r) for r in R.upsert(old, new, ["document_id"], "v").collect()} == {("a", 1), ("b", 2), ("c", 2)}


def test_control_proof(spark):
    p = spark.createDataFrame([("a", "p1"), ("a", "p2"), ("b", "p3")], "document_id string, point_id string")
    c = R.point_set_digest(p)
    assert {r.document_id: r.ok for r in L.control_proof(p.where("point_id <> 'p2'"), c).collect()} == {"a": False, "b": True}


def test_ids_match_the_standard(spark):
    from docweave.functions.text import URL_NAMESPACE, uuid5

    df = spark.createDataFrame([("docweave:d:chunk:1",), ("é",)], "x string")
    assert [r[0] for r in df.select(uuid5(URL_NAMESPACE, F.col("x"))).collect()] == [str(uuid.uuid5(uuid.NAMESPACE_URL, x)) for x in ("docweave:d:chunk:1", "é")]


def test_router():
    calls, naps = [], []

    def broken(p):
        calls.append("broken")
        raise OSError("down")

    def refused(p):
        calls.append("refused")
        raise PermissionError("key")

    r = models.Router({"x": broken, "y": refused, "z": lambda p: p.upper()}, sleep=naps.append)
    assert r.call("hi") == "HI" and calls == ["broken"] * 3 + ["refused"] and naps == [1.0, 2.0]
    assert r.call("yo") == "YO" and len(calls) == 4
    with pytest.raises(RuntimeError):
        r.call("no", valid=lambda t: False)


def test_streaming(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id int, v string, n int")
    rows.write.parquet(f"{tmp_path}/in/1")
    source = lambda: stream.read_stream(spark, f"{tmp_path}/in/*", rows)
    stream.stream_upserts(source(), f"{tmp_path}/out", ["id"], "n", f"{tmp_path}/cp").awaitTermination(60)
    spark.createDataFrame([(2, "c", 2), (3, "d", 2)], "id int, v string, n int").write.parquet(f"{tmp_path}/in/2")
    stream.stream_upserts(source(), f"{tmp_path}/out", ["id"], "n", f"{tmp_path}/cp").awaitTermination(60)
    assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out/v1").collect()} == {(1, "a", 1), (2, "c", 2), (3, "d", 2)}
    e = spark.sql("select 1 as event_id, timestamp_ntz'2024-01-01 00:10:00' as ts, 'view' as event_type, 2.0D as value union all select 2, timestamp_ntz'2024-01-01 00:20:00', 'view', 3.0D")
    r = stream.event_rollup(e).collect()
    assert len(r) == 1 and (r[0].n, r[0].total) == (2, 5.0)


def test_runs(spark):
    points = spark.createDataFrame([], "point_id string, embedding array<double>, chunk_id bigint, document_id string, chunk_uid string, document_generation int, vector_point boolean, graph_point boolean, graph_control_point string, graph_tombstoned boolean, text string")
    text = ["The reef grows slowly. Warm water harms the reef.", "Tunnels carry trains. The tunnel is long.", "Reef fish live near the reef and feed on algae."]
    chunks = spark.createDataFrame([("d", i, f"d:chunk:{i}", t, ("s1",)) for i, t in enumerate(text)], "document_id string, chunk_id bigint, chunk_uid string, text string, hierarchy struct<section_id:string>")
    p = pipeline.ingest(points, chunks, "append", 1).cache()
    assert p.count() == 3
    entries = spark.createDataFrame([("d", 1, "available")], "document_id string, document_generation int, status string")
    q = models.embed(spark.createDataFrame([("q", "reef fish algae")], "id string, text string"), "id").first().embedding
    top = pipeline.query_only(p, entries, q, 2).collect()
    assert top[0].chunk_uid == "d:chunk:2" and [r["rank"] for r in top] == [1, 2]
    assert pipeline.query_only(p, entries.limit(0), q, 2).count() == 0
    run = pipeline.full_pipeline(spark, p, entries, chunks, "reef fish", q, k=2, most_retries=1)
    assert run.status in ("PASS", "WARN", "FAIL") and run.log and "eef" in run.summary.first().summary


def test_artifacts_are_checked_field_by_field(spark, tmp_path):
    store = ArtifactStore(spark, f"file://{tmp_path}/s")
    df = spark.createDataFrame([("a", 1.0), ("b", None)], "i string, sim double")
    claim = {"generation": 2, "fingerprint": "f", "attempt": "x", "fence": 3}
    d = store.write(df, "c", "d", 1, claim)
    assert store.read("c", "d", 1, d, claim).count() == 2 and store.write(df, "c", "d", 1, claim) == d
    for k, v in (("generation", 1), ("fingerprint", "g"), ("attempt", "y"), ("fence", 4)):
        with pytest.raises(ValueError, match=k):
            store.read("c", "d", 1, d, claim | {k: v})
    with pytest.raises(ValueError, match="digest"):
        store.read("c", "d", 1, "0" * 64)
    spark.createDataFrame([("z", 1.0)], "i string, sim double").write.mode("append").parquet(f"file://{tmp_path}/s/graphs/c/d/v1/data")
    with pytest.raises(ValueError, match="stored"):
        store.read("c", "d", 1, d)


def test_one_of_two_writers_wins(tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    s = ObjectStore(str(tmp_path))
    tag = s.put("k", {"n": 0})

    def write(n):
        try:
            return s.put("k", {"n": n}, if_match=tag)
        except FileExistsError:
            return None

    with ThreadPoolExecutor(16) as pool:
        done = [t for t in pool.map(write, range(1, 17)) if t]
    assert len(done) == 1 and s.get("k")[1] == done[0]
    s.delete("k")
    assert s.get("k") is None and s.put("k", {"n": 5}, if_none=True)
