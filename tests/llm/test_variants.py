from docweave.llm.variants import edits, given_names, link_variants, near, spelling_forms, variant_pairs


def test_edits():
    assert near("abc", "acb") and near("abc", "ab") and near("abc", "abd") and not near("abc", "cab")
    assert edits("hetazilo", "heazlio") == 2 and edits("a", "") == 1 and edits("ab", "ba") == 1


def test_rewritings():
    assert given_names("bill") == {"william"} and "william" in given_names("willaim") and given_names("xyz") == set()
    full = ("person", "fokanir", "william", "full")
    for s in ("William Fokanir", "Fokanir, Bill", "Dr. Bill Fokanir", "FOKANIR William", "WilliamFokanir", "(Will Fokanir)"):
        assert full in spelling_forms(s), s
    assert spelling_forms("W. K. Fokanir") == [("person", "fokanir", "w", "initial")] == spelling_forms("WK Fokanir")
    org = spelling_forms("Pudasla Institute of Polymer Science")
    for s in ("The Pudasla Institute for Polymer Science", "Institute of Polymer Science, Pudasla", "Pudasla Inst. Polymer Science", "Pudasla I. of Poly. Scie."):
        assert spelling_forms(s) == org, s
    assert spelling_forms("University of Pudasla") == spelling_forms("Univ. Pudasla") == spelling_forms("U. Pudasla") != org
    assert spelling_forms("Lake Pudasla") == [] == spelling_forms("")


def test_links(spark):
    rows = [
        ("a1", "William Fokanir", None, ["William Fokanir"]), ("a2", "Fokanir, Bill", "x", None), ("a3", "W. Fokanir", None, []), ("a4", "Will Fokaniir", None, None), ("a5", "Marta Fokanir", None, None),
        ("b1", "Anna Zuvolemi", None, None), ("b2", "Andrew Zuvolemi", None, None), ("b3", "A. Zuvolemi", None, None),
        ("c1", "FSL", None, ["FSL", "Fuzelutal Systems Ltd"]), ("c2", "Fuzelutal-Systems GmbH", None, None), ("c3", "Fuzelutal Airport Authority", None, None),
        ("d1", None, None, None), ("d2", "", "", []), (None, "William Fokanir", None, None), ("a1", "William Fokanir", None, ["William Fokanir"]), ("e1", "Upper Fokanir", None, None),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], "canonical_id string, original_mention string, canonical_text string, aliases array<string>, component int")
    pairs = {tuple(r) for r in variant_pairs(link_variants(df)).collect()}
    assert pairs == {("a1", "a2"), ("a1", "a3"), ("a1", "a4"), ("a2", "a3"), ("a2", "a4"), ("a3", "a4"), ("c1", "c2")}
    assert link_variants(df.limit(0)).count() == 0


def test_short_forms_of_several_names(spark):
    rows = [("a", "Edward Mokalis"), ("b", "Theodore Mokalis"), ("c", "Ted Mokalis"), ("d", "Ted Bunorel"), ("e", "Edward Bunorel"), ("f", "Ted Fanukor"), ("g", "Fanukor, Ted"), ("h", "Weii Sorbenal"), ("i", "W. Sorbenal"), ("j", "Wei Sorbenal"), ("k", "ED Sorbenal")]
    df = spark.createDataFrame([(i, m, None, None) for i, m in rows], "canonical_id string, original_mention string, canonical_text string, aliases array<string>")
    assert {tuple(r) for r in variant_pairs(link_variants(df)).collect()} == {("d", "e"), ("f", "g"), ("h", "i"), ("h", "j"), ("i", "j")}


def test_copies_do_not_undo_links(spark):
    # hetazilo and heazlio are two edits apart
    once = [("n1", "William Hetaziloru", ["d:chunk:1"]), ("n2", "William Hetaziloru", ["e:chunk:7"]), ("s", "William Heazlioru", ["f:chunk:3"]), ("o", "William Heazlioqq", ["f:chunk:4"])]
    shape = "canonical_id string, original_mention string, chunk_uids array<string>, canonical_text string, aliases array<string>"
    groups = lambda rows: {tuple(r) for r in variant_pairs(link_variants(spark.createDataFrame([(*r, None, None) for r in rows], shape))).collect()}
    assert {("n1", "n2"), ("n1", "s"), ("n2", "s")} <= groups(once)
    copies = [(f"{i}-copy", m, [c.replace(":", "-copy:", 1) for c in u]) for i, m, u in once]
    got = groups(once + copies)
    assert all(p in got for p in (("n1", "s"), ("n2", "s"), ("n1", "s-copy"), ("n1-copy", "s"), ("s", "s-copy")))
    # the same slip in two texts that are no copies is far the rarer of the two
    often = [(f"n{k}", "William Hetaziloru", [f"d{k}:chunk:{k}"]) for k in range(10)] + [("s1", "William Heazlioru", ["x:chunk:50"]), ("s2", "William Heazlioru", ["y:chunk:60"])]
    assert ("n0", "s1") in groups(often) and ("n0", "s1") not in groups(often[5:])


def test_short_surnames_with_one_slip(spark):
    rows = [("a", "William Meier"), ("b", "William Meir"), ("c", "Marta Meir"), ("d", "William Kolt"), ("e", "William Kotl"), ("f", "W. Kelt"), ("g", "William Li"), ("h", "William Lu")]
    df = spark.createDataFrame([(i, m, None, None) for i, m in rows], "canonical_id string, original_mention string, canonical_text string, aliases array<string>")
    assert {tuple(r) for r in variant_pairs(link_variants(df)).collect()} == {("a", "b"), ("d", "e")}


def test_names_outside_the_tables(spark):
    assert spelling_forms("Toyota Motor Corp")[0][:2] == ("org", "toyota") == spelling_forms("Toyota Motors")[0][:2]
    assert spelling_forms("Acme Widgets", "ORG") == [("org", "acme widgets", " ", "full")] and spelling_forms("Apple", "ORG") == [("org", "apple", "", "bare")] and spelling_forms("Apple") == []
    assert spelling_forms("Anna Schmidt", "ORG")[0][0] == "person" and spelling_forms("San Miguel Lopez") != []
    four = spelling_forms("José María García López")
    assert four and four[0][:2] == ("person", "mariagarcialopez")
    rows = [
        ("a", "John Smith", "PERSON"), ("b", "Smith, John", "PERSON"), ("c", "J. Smith", "PERSON"), ("d", "Mary Jones", "PERSON"), ("e", "Michael Jones", "PERSON"), ("f", "M. Jones", "PERSON"),
        ("g", "Apple Inc", "ORG"), ("h", "Apple", "ORG"), ("i", "Acme Widgets", "ORG"), ("j", "Widgets Acme", "ORG"), ("k", "Delta Airlines", "ORG"), ("l", "Delta Software", "ORG"), ("m", "Delta", "ORG"),
    ]
    df = spark.createDataFrame([(i, m, None, None, t) for i, m, t in rows], "canonical_id string, original_mention string, canonical_text string, aliases array<string>, label string")
    links = link_variants(df)
    assert {tuple(r) for r in variant_pairs(links).collect()} == {("a", "b"), ("a", "c"), ("b", "c"), ("g", "h"), ("i", "j")}
    got = {r.canonical_id: (r.score, r.rarity) for r in links.collect()}
    assert got["a"][0] == 1.0 and all(s >= 0.6 and r >= 0 for s, r in got.values())
