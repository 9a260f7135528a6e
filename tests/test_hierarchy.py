import random

from docweave.operators.hierarchy import chunk_links, descendants, resolve_hierarchy, walk


def forest(n, seed):
    rng = random.Random(seed)
    parent = {}
    for i in range(n):
        kind = rng.random()
        parent[f"n{i:04d}"] = None if kind < 0.1 else f"n{rng.randrange(n):04d}" if kind < 0.5 else f"n{max(0, i - 1):04d}" if kind < 0.95 else "gone"
    return parent


def test_both_ways_agree(spark):
    parent = forest(800, 3)
    rows = [(k, v, str(hash(k) % 7)) for k, v in parent.items()]
    links = spark.createDataFrame(rows, "node string, parent string, block string")
    want = {r[0]: r for r in walk(list(parent), list(parent.values()))}
    assert {r[5] for r in want.values()} == {"tree", "ring", "leads to ring"}
    for giant in (10**6, 5):
        got = {r.node: (r.node, r.root, r.depth, list(r.path), r.ring, r.state) for r in resolve_hierarchy(links, giant).collect()}
        assert got == want
    below = descendants(resolve_hierarchy(links)).collect()
    assert len(below) == sum(len(r[3]) - 1 for r in want.values()) and all(r.distance >= 1 for r in below)


def test_long_chain(spark):
    rows = [(f"{i:05d}", f"{i - 1:05d}" if i else None, str(i // 50)) for i in range(700)]
    h = resolve_hierarchy(spark.createDataFrame(rows, "node string, parent string, block string"), giant=100)
    assert h.agg({"depth": "max"}).first()[0] == 699 and h.select("root").distinct().count() == 1


def test_chunks(spark):
    h = "struct<parent_chunk_uid:string,parent_chunk_id:bigint>"
    rows = [("d", 0, "d:chunk:0", None, 9), ("d", 1, "d:chunk:1", ("", 0), 9), ("d", 2, "d:chunk:2", ("d:chunk:2", None), 9), ("d", 3, "d:chunk:3", ("e:chunk:0", 1), 9), ("d", 3, "d:chunk:3", ("e:chunk:0", 1), 9), ("d", 4, "d:chunk:4", (None, 77), 9), (None, None, "x", None, 9), ("d", 5, None, (None, 1), 9)]
    df = spark.createDataFrame(rows, f"document_id string, chunk_id bigint, chunk_uid string, hierarchy {h}, node int")
    got = {r.node: (r.root, r.depth, r.state) for r in resolve_hierarchy(chunk_links(df)).collect()}
    assert got == {"d:chunk:0": ("d:chunk:0", 0, "tree"), "d:chunk:1": ("d:chunk:0", 1, "tree"), "d:chunk:2": (None, 0, "ring"), "d:chunk:3": ("d:chunk:3", 0, "tree"), "d:chunk:4": ("d:chunk:4", 0, "tree"), "x": ("x", 0, "tree")}
    assert resolve_hierarchy(chunk_links(df.limit(0))).count() == 0


def test_paths_of_a_chain_are_not_held_together():
    import tracemalloc

    n = 6000
    tracemalloc.start()
    last = None
    for last in walk([f"{i:05d}" for i in range(n)], [f"{i - 1:05d}" if i else None for i in range(n)]):
        pass
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert last[2] == n - 1 and len(last[3]) == n and most < 20e6


def test_rows_without_document_are_spread(spark):
    h = "struct<parent_chunk_uid:string,parent_chunk_id:bigint>"
    rows = [(None, None, f"u{i:03d}", (f"u{i - 1:03d}" if i % 10 else None, None)) for i in range(300)]
    links = chunk_links(spark.createDataFrame(rows, f"document_id string, chunk_id bigint, chunk_uid string, hierarchy {h}"))
    assert links.select("block").distinct().count() > 200
    got = resolve_hierarchy(links)
    assert got.agg({"depth": "max"}).first()[0] == 9 and got.select("root").distinct().count() == 30
