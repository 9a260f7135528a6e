import random

from docweave.llm.split import split_oversized, split_points


def check(text, level=None, limit=100, overlap=20):
    points = split_points(text, level, limit, overlap)
    covered = 0
    for k, (s, e, _) in enumerate(points):
        assert 0 < e - s <= limit and s <= covered and covered - s <= overlap and e > covered
        covered = e
    assert points[0][0] == 0 and covered == len(text)
    return points


def test_pieces_cover_and_overlap():
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice(["ab ", "word. ", "x", "\n", "\n\n", "; ", "é̂", "中。"]) for _ in range(rng.randint(1, 400))).strip() or "x"
        check(text, rng.choice([None, "table", "SENTENCE", "paragraph"]))


def test_ends_at_the_strongest_boundary():
    text = "a" * 40 + ". " + "b" * 30 + "\n\n" + "c" * 60
    assert split_points(text, "paragraph", 100, 20)[0][2] == "block"
    assert split_points("x" * 250, None, 100, 20)[0] == (0, 100, "hard")
    rows = "| a | b |\n" * 30
    assert all(e[2] in ("line", "end") for e in split_points(rows.strip(), "table", 100, 20))


def test_natural_end_in_the_first_half_before_a_mere_word():
    text = "One, two three four five. " + "word " * 60
    points = check(text.strip())
    assert points[0] == (0, 26, "sentence") and points[1][2] == "word"
    # what lies within the overlap is no end, a boundary of the second half comes first
    assert check(("Too short. " + "word " * 60).strip())[0][2] == "word"
    assert check(("A first sentence of its own. " + "word " * 9 + "word, " + "word " * 40).strip())[0][2] == "clause"


def test_table(spark):
    rows = [("a", "  " + "One sentence here. " * 100, "paragraph", 1), ("a", "  " + "One sentence here. " * 100, "PARAGRAPH", 1), ("b", "short", None, 2), ("c", None, "table", 3), ("d", " ", None, 4), (None, "y" * 1300, None, 5), ("e", "", None, 6), ("f", "z " * 30_000, "sentence", 7)]
    df = spark.createDataFrame(rows, "chunk_uid string, text string, level string, piece int")
    out = split_oversized(df).collect()
    by = {}
    for r in out:
        by.setdefault(r.chunk_uid, []).append(r)
    assert set(by) == {"a", "b", "d", "e", "f", None}
    a = sorted(by["a"], key=lambda r: r.piece_no)
    assert len(a) == a[0].n_pieces and all(r.piece == rows[0][1][r.start_char : r.end_char] for r in a) and a[0].start_char == 2
    assert [r.piece for r in by["b"]] == ["short"] and [r.piece for r in by["d"]] == [""]
    assert max(len(r.piece) for r in by["f"]) <= 1200
    assert split_oversized(df.limit(0)).count() == 0
    assert split_oversized(df.drop("level")).where("n_pieces > 1").select("chunk_uid").distinct().count() == 3
