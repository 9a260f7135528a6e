import random
import time

from docweave.llm.leak import contains_span, find_leaks, words_of


def test_spans():
    item = [f"w{i}" for i in range(20)]
    assert contains_span(["a", *item[3:15], "b"], item) == 12
    assert contains_span(["a", *item[3:14], "b"], item) == 0
    assert contains_span(["a", "x", "y"], ["x", "y"]) == 2 and contains_span(["x", "b", "y"], ["x", "y"]) == 0
    assert words_of("Ein—Wort, ÉTÉ_2 x²") == ["ein", "wort", "été", "2", "x²"] and words_of(None) == []


def test_against_brute_force(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 5, 9, 11, 12, 13, 40])))) for i in range(60)] + [(100, None), (101, "..."), (None, "w1 w2"), (102, "w1"), (102, "w1")]
    docs = []
    for d in range(150):
        w = rng.choices(vocabulary, k=rng.randint(0, 80))
        if rng.random() < 0.6:
            src = words_of(rng.choice(items)[1])
            n = rng.randint(8, 16)
            at = rng.randint(0, max(0, len(src) - n))
            w[len(w) // 2 : len(w) // 2] = src[at : at + n]
        docs.append((d, rng.choice([" ", "  ", " — ", "\n"]).join(w).title(), 1))
    docs += [(500, None, 1), (501, "", 1), (None, "w1", 1), (0, docs[0][1], 1), (502, "w7 " * 20_000, 1)]
    want = {(d, i) for d, t, _ in docs if d is not None for i, x in items if i is not None and contains_span(words_of(t), words_of(x))}
    d = spark.createDataFrame(docs, "doc_id bigint, text string, item_id int")
    q = spark.createDataFrame(items, "item_id bigint, text string")
    out = find_leaks(d, q).collect()
    assert {(r.doc_id, r.item_id) for r in out} == want and len(out) == len(want)
    # past the size that is broadcast, and with one text beside thousands of items, the rows are the same
    assert {(r.doc_id, r.item_id) for r in find_leaks(d, q, broadcast_rows=0).collect()} == want
    assert find_leaks(d.limit(0), q).count() == 0 and find_leaks(d, q.limit(0)).count() == 0


def naive(text, item, span=12):
    need = min(span, len(item))
    runs = [n for i in range(len(text)) for j in range(len(item)) for n in [next((k for k in range(min(len(text) - i, len(item) - j)) if text[i + k] != item[j + k]), min(len(text) - i, len(item) - j))]]
    n = max(runs, default=0)
    return n if item and n >= need else 0


def test_longest_runs_of_few_words():
    rng = random.Random(4)
    for _ in range(300):
        text, item = rng.choices("ab", k=rng.randint(0, 40)), rng.choices("ab", k=rng.randint(0, 20))
        assert contains_span(text, item) == naive(text, item)


def test_repeated_words_take_linear_time():
    began = time.time()
    assert contains_span(["w"] * 100_000, ["w"] * 100_000) == 100_000
    assert time.time() - began < 5


def test_containment_and_many_items_of_one_text(spark):
    words = [f"w{i}" for i in range(3000)]
    items = spark.createDataFrame([(i, " ".join(words[i : i + 14])) for i in range(2500)] + [(9999, " ".join(words[:12] + ["x"] * 8))], "item_id int, text string")
    out = {r.item_id: r for r in find_leaks(spark.createDataFrame([(1, " ".join(words)), (1, "w1")], "doc_id int, text string"), items).collect()}
    assert len(out) == 2501 and out[7].n_words == 14 and out[7].containment == 1.0
    assert out[9999].n_words == 12 and out[9999].containment < 1.0
