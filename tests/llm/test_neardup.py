import random
from itertools import combinations

from docweave.llm.neardup import NearDuplicates, most_own, word_set


def brute(rows, t, least):
    sets = {}
    for u, x in rows:
        if u is not None and x is not None and len(word_set(x)) >= least:
            sets.setdefault(u, []).append(word_set(x))
    return {(a, b) for a, b in combinations(sorted(sets), 2) if any(len(x & y) >= t * len(x | y) for x in sets[a] for y in sets[b])}


def corpus(n, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(n):
        words = rng.sample(vocabulary, rng.choice([25, 30, 50, 70, 130, 200]))
        rows.append((f"u{i}", " ".join(words)))
        for k in range(rng.randint(0, 2)):
            copy = list(words)
            for _ in range(rng.randint(0, len(words) // 5)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rng.shuffle(copy)
            rows.append((f"u{i}c{k}", ", ".join(copy).upper()))
    return rows


def test_all_pairs_are_found(spark):
    rows = corpus(120, 1)
    rows += [rows[0], ("dup", rows[0][1]), (None, rows[0][1]), ("none", None), ("empty", ""), ("short", "a b c"), ("u1", rows[40][1]), ("long", " ".join(f"z{i}" for i in range(30_000)))]
    want = brute(rows, 0.75, 25)
    assert len(want) > 60
    df = spark.createDataFrame([(u, x, 1) for u, x in rows], "chunk_uid string, text string, rep int")
    for hot, tile in ((4096, 4096), (3, 4096), (3, 4)):
        n = NearDuplicates(df, hot=hot, tile=tile)
        assert {tuple(r) for r in n.pairs().collect()} == want
    members = n.summary().collect()
    assert {r.chunk_uid for r in members} >= {a for p in want for a in p}


def test_empty(spark):
    df = spark.createDataFrame([], "chunk_uid string, text string")
    assert NearDuplicates(df).pairs().count() == 0


def test_bound_on_own_words():
    assert most_own(40, 0.75) == 10 and most_own(41, 0.75) == 10 and most_own(10, 1.0) == 0


def test_hot_pairs_of_bits_are_cut_into_tiles(spark):
    from pyspark.sql import functions as F

    from docweave.llm.neardup import spread_hot

    band = (2 << 56) | (1 << 55)
    rows = [(band | 5, i) for i in range(100)] + [(band | 6, i) for i in range(3)] + [((2 << 56) | 5, i) for i in range(50)]
    out = spread_hot(spark.createDataFrame(rows, "_key bigint, _id bigint"), tile=10).groupBy("_key").agg(F.collect_set("_id").alias("ids")).collect()
    assert max(len(r.ids) for r in out if r["_key"] & (1 << 55)) < 30 and all(r["_key"] >> 56 == 2 for r in out)
    met = {p for r in out if r["_key"] & (1 << 55) for p in combinations(sorted(r.ids), 2)}
    assert met == set(combinations(range(100), 2))
