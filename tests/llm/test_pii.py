import re

from docweave.llm.pii import Surrogates, find_items, find_personal, mask, replace_personal

CASES = {
    "Contact: Larpinvinpel, Francisco, tel. (415) 555-0191.": [("person", "Larpinvinpel, Francisco"), ("phone", "415) 555-0191")],
    "reviewer=Y. Fonmolhodin; orcid QQ 91 55 10 C; mail=y.fonmolhodin-6@lab.example": [("person", "Y. Fonmolhodin"), ("id_number", "QQ 91 55 10 C"), ("email", "y.fonmolhodin-6@lab.example")],
    "Write to mnirsolvamol [at] lab dot example or +44 (0)1632 960 929.": [("email", "mnirsolvamol [at] lab dot example"), ("phone", "+44 (0)1632 960 929")],
    "Herr Hokellafa wohnt in der Calle Hosrukupa 9, 78975 Davutulvi.": [("person", "Hokellafa"), ("address", "Calle Hosrukupa 9")],
    "went to Flat 7, 231 Dafotomu Terrace, Muduszivu.": [("address", "Flat 7, 231 Dafotomu Terrace")],
    "153, rue de Nohidakin, 30401 Pel; Fesdozurserstraße 176, 42839 Beg": [("address", "153, rue de Nohidakin"), ("address", "Fesdozurserstraße 176")],
    "The number 990-71-0285, 0000-0007-1887-7662 or 68007003-M.": [("id_number", "990-71-0285"), ("id_number", "0000-0007-1887-7662"), ("id_number", "68007003-M")],
    "user: wei smith; and Kwame alone, ROBERT HOMANTOSTE too": [("person", "wei smith"), ("person", "Kwame"), ("person", "ROBERT HOMANTOSTE")],
    "John Smith called Maria Garcia about Sarah's invoice.": [("person", "John Smith"), ("person", "Maria Garcia"), ("person", "Sarah")],
    "Emma Johnson or Mohammed Ali, then Laura Schmidt": [("person", "Emma Johnson"), ("person", "Mohammed Ali"), ("person", "Laura Schmidt")],
    "Wang Xiaoming met Иван Петров, Алексей Иванович Смирнов and 王小明先生; ask Nkechi Okafor": [("person", "Wang Xiaoming"), ("person", "Иван Петров"), ("person", "Алексей Иванович Смирнов"), ("person", "王小明"), ("person", "Nkechi Okafor")],
    "Run id 98739049-1998 wrote 330 vectors; ISBN 978-0-2054-9332-8, grid 151 891 150; x@y and @summary; Over the period 1999-1976": [],
    "Lake Bulnoskinbir and Port Talverarhi; the University of Rurkinfaro; version 3.28 of the Kelkasneri model": [],
}


def test_formats():
    for text, want in CASES.items():
        assert [(k, text[s:e]) for s, e, k in find_items(text)] == want, text


def test_replacement_keeps_coreference_and_form():
    t = "Dear Francisco Larpinvinpel, (415) 555-0191. Larpinvinpel, Francisco and Marta Zobukola met F. Larpinvinpel."
    masked, made, n = mask(t, b"k")
    assert n == 5 and masked.startswith("Dear [PERSON_1], [PHONE_1]. [PERSON_1] and [PERSON_2]")
    assert "Francisco" not in made and "Larpinvinpel" not in made and "555-0191" not in made
    first = made[5 : made.index(", (")].split()
    assert f"{first[1]}, {first[0]}" in made
    assert mask(t, b"k") == (masked, made, n) != mask(t, b"other")


def test_short_forms_alone_unless_everyday_words():
    found = lambda t: [t[a:b] for a, b, k in find_items(t) if k == "person"]
    assert found("Then Katya called, and Andy answered.") == ["Katya", "Andy"]
    assert found("Will Bill pay? Pat the dog. A Rich Kit.") == [] and found("Will Fokanir came.") == ["Will Fokanir"]


def test_tables(spark):
    rows = [(1, "mail a.b@example.org"), (1, "mail a.b@example.org"), (2, None), (3, ""), (None, "call 020 7946 0378"), (4, "word " * 30_000 + "Ms Vukastikel")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, kind string")
    found = sorted((str(r.doc_id), r.kind, r.start_char) for r in find_personal(df, "k").collect())
    assert found == [("1", "email", 5), ("4", "person", 150_003), ("None", "phone", 5)]
    out = replace_personal(df, "k").collect()
    assert len(out) == 6 and [r.masked for r in out if r.doc_id == 2] == [None] and [r.masked for r in out if r.doc_id == 1] == ["mail [EMAIL_1]"] * 2
    assert find_personal(df.limit(0), "k").count() == 0


def test_surrogates_stay_distinct_however_many():
    for draw in (lambda m, i: m.given_name(f"Xa{i}"), lambda m, i: m.surname(f"Bo{i}"), lambda m, i: m.given_name(f"Иа{i}"), lambda m, i: m.coded("phone", f"{i:04d}")):
        m = Surrogates(b"q")
        assert len({draw(m, i) for i in range(2000)}) == 2000
    text = ". ".join(f"Ms {a}{b}{c}ton" for a in "BDFGHKLMNP" for b in "aeiou" for c in "rlnt")
    _, made, n = mask(text, b"k")
    assert n == 200 and len(set(re.findall(r"Ms (\w+)", made))) == 200


def test_nothing_of_an_item_stays():
    for text in ("x@maria-lopez.es", "a.b+7 [at] lopez dot example", "JLOPEZ99@MAIL.LOPEZ.ORG"):
        made = mask(text, b"k")[1].lower()
        assert "lopez" not in made and "maria" not in made and not made.startswith(text[:2].lower()), made
    assert mask("0000-0002-1825-0097", b"k")[1][:7] != "0000-00"
    assert {mask("12345678Z", bytes([i]))[1][-1] == "TRWAGMYFPDXBNJZSQVHLCKE"[int(mask("12345678Z", bytes([i]))[1][:8]) % 23] for i in range(20)} == {True}
    for i in range(20):
        made = mask("0000-0002-1825-0097", bytes([i]))[1].replace("-", "")
        t = 0
        for c in made[:15]:
            t = (t + int(c)) * 2
        assert "0123456789X"[(12 - t % 11) % 11] == made[15]
    assert re.fullmatch("[А-Я][а-я-]+ [А-Я][а-я]+", mask("Иван Петров", b"k")[1])


def test_names_are_learned_from_the_corpus(spark):
    rows = [(i, t) for i, t in enumerate(["Dr Velkarin spoke.", "Prof. Zumotal and T. Bresk agreed.", "Quorvath Velkarin wrote.", "Then Quorvath Zumotal came.", "QUORVATH BRESK signed.", "We met Quorvath.", "user: wei nizuzilbir", "The miller sold flour. ", "One Modular Miller mended it; millers and a miller", "wei said the miller left", "Regional Miller hid", "they said, she said, he said"])]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    for most in (200_000, 0):
        got = sorted((r.doc_id, r["item"]) for r in find_personal(df, "k", broadcast_words=most).collect())
        assert got == [(0, "Velkarin"), (1, "T. Bresk"), (1, "Zumotal"), (2, "Quorvath Velkarin"), (3, "Quorvath Zumotal"), (4, "QUORVATH BRESK"), (5, "Quorvath"), (6, "wei nizuzilbir")]
