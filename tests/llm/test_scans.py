import random

import numpy as np

from docweave.llm.boost import Boosted
from docweave.llm.scans import JoinModel, Scans, WordModel, explain, is_folio, lines_of, repair_text, split_candidates, title_of

BODY = "the residual harvest follows each measured current and the coastal network reduces annual inflation because the optical tunnel was compared with a ceramic detector over several hundred hours".split()


def test_lines():
    assert is_folio("Page 32 of 71", 32, False) and is_folio("- 38 -", 38, False) and is_folio("xxxiii", None, False) and is_folio("19", 19, False)
    assert not is_folio("1663", 4, False) and not is_folio("19", 19, True) and not is_folio("mild", None, False) and not is_folio("word", 1, False)
    assert title_of("27    Pneumatic pipeline proceedings, vol. 15") == ("Pneumatic pipeline proceedings, vol. 15", True)
    assert title_of("Robust Ward Review (Draft)") and not title_of("ends with a stop.") and not title_of("lower case line")
    known = {"detector", "well", "known", "the"}
    assert [c[:4] for c in split_candidates(lines_of("a dete-\nctor"), None, False)] == [(0, 1, "dete", "ctor")]
    assert [(c[0], c[1], c[5]) for c in split_candidates(lines_of("a dete-\nPage 4\nBig Title Review\nctor"), 4, False)] == [(0, 3, ["big title review"])]
    assert not list(split_candidates(lines_of("1958-\n2022"), None, False))
    counts = dict.fromkeys(known, 5)
    assert JoinModel(counts).joins("dete", "ctor", "-", counts) and not JoinModel(counts).joins("well", "known", "-", counts) and JoinModel(counts).joins("well", "known", "¬", counts)


def test_confusions():
    assert explain("rneasurecl", "measured")[:2] == explain("clioxicle", "dioxide")[:2] == explain("1nformati0n", "information")[:2] == (2, 0)
    assert explain("xnformatixn", "information")[:2] == (0, 9) and explain("1nformatixn", "information")[:2] == (1, 1)
    assert explain("cornmunity", "community")[:2] == (1, 0) and explain("fo1lovvs", "follows")[:2] == (2, 0) and explain("abc", "abd")[1] == 1


def test_candidates_by_confusions_know_no_cap():
    like = ("rake", "snake", "wake", "lake", "take", "cake", "bake", "fake", "sake", "brake", "shake", "awake")
    m = WordModel({**dict.fromkeys(like, 900), "make": 5, "minimum": 7}, 20_000)
    got = [w for w, _ in m.candidates("rnake")]
    assert "make" in got and len(got) == len(set(got)) and "make" in [w for w, _ in m.candidates("rn�ke")]
    # any number of confusions, ends included
    assert "minimum" in [m.words[i] for i in m.undone("rn1nirnurn")] and not m.undone("xyz")


def test_boosting_learns_a_rule():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 3))
    y = (x[:, 0] > 0) ^ (x[:, 1] > 0)
    m = Boosted().fit(x[:400], y[:400])
    assert ((m.predict(x[400:]) > 0.5) == y[400:]).mean() > 0.9


def test_repair():
    t = "The coastal net-\nRobust Ward Review (Draft)\nPage 4\nwork rnoves on.\n\nNext part."
    out = repair_text(t, {"robust ward review draft"}, {"rnoves": "moves"}, 4, False, {(i, j) for i, j, *_ in split_candidates(lines_of(t), 4, False)})
    assert out == "The coastal network moves on.\n\nNext part."


def test_scans(spark):
    rng = np.random.default_rng(1)
    rows = []
    for d in range(12):
        for c in range(14):
            w = rng.choice(BODY, 40).tolist()
            lines = [" ".join(w[i : i + 8]) for i in range(0, 40, 8)]
            if c % 3 == 0:
                lines.insert(int(rng.integers(0, 6)), f"Annual Harbour{d} Proceedings")
            if c % 4 == 0:
                lines.append(f"Page {c}")
            if c % 5 == 0:
                lines.append("network re-\nduces")
            if c % 6 == 0:
                lines.append("coastal detect0r")
            rows.append((f"d{d}", f"d{d}:chunk:{c}", "\n".join(lines), "paragraph", c))
    rows += [("d0", "x1", None, None, None), (None, None, "tbe", None, None), ("d0", "x2", "", "table", None), rows[0], (None, "x3", "word " * 20_000, None, None)]
    df = spark.createDataFrame([(*r, "k") for r in rows], "document_id string, chunk_uid string, text string, level string, page_no int, kind string")
    s = Scans(df)
    found = {tuple(r) for r in s.found.collect()}
    of = lambda k: {u for u, kind in found if kind == k}
    want = lambda n: {u for _, u, t, _, p in rows if u and t and p is not None and p % n == 0}
    assert of("header") == want(3) and of("folio") == want(4) and of("hyphen") == want(5) and of("glyph") == want(6)
    fixed = {r.chunk_uid: r.text for r in s.repaired().collect()}
    assert "Proceedings" not in fixed["d1:chunk:0"] and "network reduces" in fixed["d1:chunk:5"] and "detector" in fixed["d1:chunk:6"]
    empty = Scans(df.limit(0))
    assert empty.found.count() == 0 and empty.repaired().count() == 0


def test_halves_are_judged_by_a_fitted_model():
    rng = random.Random(3)
    syllables = [a + b for a in "bdfgklmnprst" for b in "aeiou"]
    words = sorted({"".join(rng.choices(syllables, k=rng.choice([2, 3, 4]))) for _ in range(400)})
    counts = {w: rng.randint(3, 60) for w in words}
    short = [w for w in words if len(w) == 4]
    compounds = {f"{rng.choice(short)}-{rng.choice(short)}": rng.randint(1, 9) for _ in range(60)}
    m = JoinModel(counts | compounds)
    assert m.model is not None
    whole = [w for w in words if len(w) >= 6]
    assert sum(m.joins(w[:3], w[3:], "-", counts | compounds) for w in whole) >= 0.95 * len(whole)
    assert sum(m.joins(*c.split("-"), "-", counts | compounds) for c in compounds) <= 0.1 * len(compounds)
    # neither half nor the whole is known: a rare word, cut
    assert m.joins("xylo", "phonist", "-", counts | compounds)


def test_misreadings_are_read_whatever_the_size():
    rng = np.random.default_rng(4)
    part = lambda: "".join(rng.choice(list("kpvxyj"), 3))
    # a 1 may be an l or an i: only a frequency that gives the answer away tells the words of such examples apart
    pairs = [(part(), part()) for _ in range(150)]
    words = sorted({x + c + y for x, y in pairs for c in "li"}) + sorted({part() + "m" + part() for _ in range(100)})
    for k in (1, 10, 1000):
        counts = {w: 150 * k * (1 + i % 37) for i, w in enumerate(words)}
        m = WordModel(counts, sum(counts.values()))
        for rare in (1, 2 * k):
            meant = [w for w in words if "m" in w]
            assert m.read([(w.replace("m", "rn"), rare) for w in meant]) == meant


def test_a_header_of_a_long_document_that_stands_in_few_surroundings(spark):
    rows = [("x", f"x{c}", f"{BODY[c % 4]} flows on and\nRobust Ward Review\n{BODY[4 + c % 4]} goes on.\nWhat {BODY[c % 30 % len(BODY)]} {c // 26} says {'abcdefghijklmnopqrstuvwxyz'[c % 26]}\nends here.", None, "paragraph") for c in range(300)]
    df = spark.createDataFrame(rows, "document_id string, chunk_uid string, text string, page_no int, level string")
    assert Scans(df).found.where("kind = 'header'").count() == 300
