"""Linking the spellings of one person or organisation by canonical rewriting.

Every spelling is rewritten in all ways the rules allow: without titles, accents, case and punctuation; in given-name-first order;
short forms and misspelt given names to the names they may stand for; given names to initials; kinds of organisations, fields
and legal forms to fixed keys. The rewritings are exploded and equi-joined. A rewriting counts as much as it is rare: one that
carries the full name links at once, one that carries only an initial links if no two given names of that surname share it.
Misspelt surnames and stems are rewritten by leaving out one character each, joined, and checked by edit distance.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..session import materialize
from .names import GIVEN_NAMES, SHORT_FORMS, TITLES

_FOLD = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe", "ı": "i", "þ": "th", "ð": "d", "’": "", "'": ""})
#: Stems of this length or more may be two edits apart.
TWO_EDITS_FROM = 8
#: A spelling found this many times as often as another may be what the other, itself found more than once, is a slip of.
RARER = 5
#: Letter triples are counted in so many buckets; one that at most LEAST_TRIPLES stems or this share of them have is odd.
TRIPLES, LEAST_TRIPLES, RARE_TRIPLE = 65_536, 2, 5e-4
#: A link needs this score: a rewriting of two names or more has less.
LEAST_SCORE = 0.6
#: Words that tell the kind of an organisation; an abbreviation stands for the kind it begins.
ORG_KINDS = {
    "institute": "institute inst instituto institut", "university": "university univ universitat universite universidad", "ministry": "ministry min ministerium ministere", "laboratory": "laboratory laboratories lab labs laboratorium",
    "systems": "systems sys syst system", "partners": "partners ptnrs partner", "hospital": "hospital hosp", "cooperative": "cooperative coop", "department": "department dept", "centre": "centre center", "college": "college coll", "authority": "authority auth", "association": "association assoc", "society": "society soc", "foundation": "foundation", "agency": "agency", "council": "council", "group": "group", "bank": "bank", "company": "company co corporation corp",
    "motors": "motors motor automobiles", "airlines": "airlines airline airways", "software": "software", "electronics": "electronics", "pharmaceuticals": "pharmaceuticals pharmaceutical pharma", "industries": "industries", "holdings": "holdings holding",
    "technologies": "technologies", "solutions": "solutions", "services": "services", "insurance": "insurance assurance", "publishing": "publishing publishers verlag press", "academy": "academy academie akademie", "school": "school schule ecole", "museum": "museum musee museo", "library": "library bibliothek bibliotheque",
    "bureau": "bureau", "commission": "commission", "committee": "committee", "federation": "federation", "trust": "trust", "works": "works werke", "stores": "stores", "club": "club", "union": "union",
}
_KIND = {w: k for k, v in ORG_KINDS.items() for w in v.split()}
_SMALL = {"the", "of", "for", "and", "de", "del", "la", "le", "du", "des", "der", "die", "das", "fur", "i"}
_LEGAL = {"ltd", "limited", "inc", "incorporated", "gmbh", "llc", "plc", "ag", "sa", "sarl", "bv", "co"}
PLACES = {"upper", "lower", "port", "lake", "san", "santa", "new", "mount", "north", "south", "east", "west", "st", "saint", "cape", "fort", "river"}
#: Ordinary words for what an organisation works on; four letters of each tell fields apart and survive abbreviation.
FIELDS = """academic aerospace agriculture airport analysis animal applied archaeology architecture art arts astronomy biology brewing building business chemical chemistry city civil climate computer
computing construction crop cultural culture data dairy defence design development digital earth ecology economic economics education electric electrical energy engineering environment environmental finance fisheries food foreign
forest forestry general genetics geology geography geophysics health heritage history housing hydrology industrial industry information interior international justice labour land language languages law linguistics literature
management marine materials mathematics mechanical mechanics medical medicine memorial meteorology mining molecular music national natural nuclear nuclear ocean oceanography optical optics physics plant polar policy political
polymer psychology public radio rail regional research river rural safety science sciences security sediment seismic social soil solar space statistics studies systematic technical technology telecom text theoretical theory
trade transport tropical urban veterinary water wildlife wind youth zoology""".split()
_FIELDS, _FIELD4 = set(FIELDS), {f[:4] for f in FIELDS}
_TITLES = {t.lower() for t in TITLES}


def fold(text: str) -> str:
    t = unicodedata.normalize("NFKD", text.casefold().translate(_FOLD))
    return "".join(c for c in t if not unicodedata.combining(c)).translate(_FOLD)


def near(a: str, b: str) -> bool:
    """At most one insertion, deletion, substitution or swap of neighbours apart."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (i + 1 < len(a) and a[i] == b[i + 1] and a[i + 1] == b[i] and a[i + 2 :] == b[i + 2 :])
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


_GIVEN: dict[str, set[str]] = {}
_SHORT = {fold(s) for v in SHORT_FORMS.values() for s in v.split()}
for _v in GIVEN_NAMES.values():
    for _g in _v:
        # a name that is short for another stands for that one
        if fold(_g) not in _SHORT or _g in SHORT_FORMS:
            _GIVEN.setdefault(fold(_g), set()).add(fold(_g))
_WHOLE = set(_GIVEN)
for _g, _v in SHORT_FORMS.items():
    for _s in _v.split():
        _GIVEN.setdefault(fold(_s), set()).add(fold(_g))


def given_names(word: str) -> set[str]:
    """The given names a folded word may stand for: itself, those it is short for, or those it misspells."""
    if word in _GIVEN:
        return _GIVEN[word]
    if len(word) < 3:
        return set()
    full = {g for g in _WHOLE if near(word, g)}
    return full or set().union(*(names for g, names in _GIVEN.items() if len(g) >= 4 and near(word, g)))


def org_form(words: list[str]) -> tuple[str, str, str] | None:
    """(kind, field, stem) of an organisation's folded words: the words that are no kind, field or small word are the stem."""
    kinds, rest = [], []
    for w in words:
        k = _KIND.get(w)
        if k is None and len(w) >= 6:
            k = next((v for x, v in _KIND.items() if len(x) >= 7 and near(w, x)), None)
        if k:
            kinds.append(k)
        elif w not in _SMALL and w not in _LEGAL and len(w) > 1:
            rest.append(w)
    if not kinds and any(w in _LEGAL for w in words[1:]):
        kinds.append("company")
    if not kinds and len(words) >= 3 and words[:2] == ["i", "of"] or len(words) >= 4 and words[1:3] == ["i", "of"]:
        kinds.append("institute")
    field = sorted({w[:4] for w in rest if w in _FIELDS or (len(w) <= 4 and w in _FIELD4) or (len(w) >= 6 and any(near(w, f) for f in FIELDS if len(f) >= 5))})
    stem = [w for w in rest if w[:4] not in field or len(w) > 4 and w not in _FIELDS and not any(near(w, f) for f in FIELDS if len(f) >= 5)]
    if not kinds or not stem:
        return None
    return kinds[0], " ".join(field), " ".join(stem)


def spelling_forms(text: str, label: str | None = None) -> list[tuple[str, str, str, str]]:
    """Rewritings (type, stem, rest, strength) of one spelling. Type is person or org. Strength is full, maybe (short for, or a slip of, several
    names), initial, or bare (an organisation without its kind). The label counts only where the words tell neither a person nor a kind of organisation."""
    clean = re.sub(r"[()\[\]{}\"“”]", " ", text)
    clean = re.sub(r"\s+", " ", clean).strip(" ,.;:")
    if not clean:
        return []
    parts = [p.strip() for p in clean.split(",") if p.strip()]
    words = [fold(w) for w in re.findall(r"[^\W\d_]+(?:['’][^\W\d_]+)*", clean)]
    raw = re.findall(r"[^\W\d_]+(?:['’][^\W\d_]+)*", clean)
    if len(words) == 2 and words[0] == "u" and len(words[1]) > 3:
        return [("org", words[1], "university ", "full")]
    org = org_form(words)
    if org and org[2]:
        return [("org", org[2], f"{org[0]} {org[1]}", "full")]
    shouted = all(r.isupper() for r in raw if len(r) > 2)
    pair = lambda r: len(r) == 2 and r.isupper() and not shouted  # noqa: E731  two initials, not a title
    words_raw = [(w, r) for w, r in zip(words, raw) if w not in _TITLES or pair(r)]
    if not words_raw or words_raw[0][0] in PLACES and not pair(words_raw[0][1]) and not any(w in _GIVEN for w, _ in words_raw[1:]):
        return []
    if label == "ORG" and len(words_raw) == len(words) and len(parts) == 1 and not any(len(w) == 1 or given_names(w) for w in words):
        stem = [w for w in words if w not in _SMALL and w not in _LEGAL]
        if len(stem) > 1 and not any(len(r) <= 3 and r.isupper() for r in raw) and all(r.isupper() or not re.search(r"[^\W\dA-ZÀ-Þ_][A-ZÀ-Þ]", r) for r in raw):
            return [("org", " ".join(sorted(stem)), " ", "full")]
        if len(stem) == 1 and len(stem[0]) > 3 and not shouted and raw[0][1:].islower():
            return [("org", stem[0], "", "bare")]
    if len(words_raw) == 1:
        w, r = words_raw[0]
        inner = re.match(r"([A-ZÀ-Þ][^\W\dA-ZÀ-Þ_]+)([A-ZÀ-Þ][^\W\d_]+)$", r)
        if not inner:
            return []
        words_raw = [(fold(inner[1]), inner[1]), (fold(inner[2]), inner[2])]

    def initial(w: str, r: str) -> bool:
        return len(w) == 1 or pair(r) or (len(w) <= 3 and r.isupper() and w not in _GIVEN)

    full = [(w, r) for w, r in words_raw if not initial(w, r)]
    letters = "".join(w for w, r in words_raw if initial(w, r))
    if not full:
        return []
    out: list[tuple[str, str, str, str]] = []
    if len(full) == 1:
        return [("person", full[0][0], letters[0], "initial")] if letters else []
    known = [bool(given_names(w)) for w, _ in full]
    exact = [w in _GIVEN for w, _ in full]
    if len(parts) > 1 and len(re.findall(r"[^\W\d_]+", parts[0])) == 1:
        orders = [(full[1][0], full[0][0])]
    elif len(full) == 2:
        if exact[0] != exact[1]:
            g = 0 if exact[0] else 1
            orders = [(full[g][0], full[1 - g][0])]
        elif known[0] != known[1]:
            g = 0 if known[0] else 1
            orders = [(full[g][0], full[1 - g][0])]
        else:
            orders = [(full[0][0], full[1][0]), (full[1][0], full[0][0])]
    else:
        # a double surname, or something else of three words or more: the given name is at one end
        if known[0]:
            orders = [(full[0][0], "".join(w for w, _ in full[1:]))]
        elif known[-1]:
            orders = [(full[-1][0], "".join(w for w, _ in full[:-1]))]
        else:
            return []
    for g, s in orders:
        names = sorted(given_names(g)) or [g]
        out.append(("person", s, "|".join(names), "full" if len(names) == 1 else "maybe"))
    return out


def _forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = set()
        for i, seen, names, label in zip(b["_id"], b["_seen"], b["_names"], b["_label"]):
            for n in names:
                if n:
                    rows.update((i, seen, *f) for f in spelling_forms(n, label))
        yield pd.DataFrame(sorted(rows), columns=["_id", "_seen", "type", "stem", "rest", "strength"])


def edits(a: str, b: str) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours that turn one into the other."""
    last2: list[int] = []
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, last2[j - 2] + 1)
            row.append(d)
        last2, last = last, row
    return last[-1]


def _left_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(hash, class, two) of each stem whole and with one character left out; long ones beside a full name also with two, short ones beside an
    equal full given name only. The hash stands for the type, what must be equal besides the stem, and what is left of the stem."""
    import xxhash

    for b in batches:
        hashes, numbers, twos = [], [], []
        for c, t, s, r in zip(b["_c"], b["type"], b["stem"], b["rest"]):
            one = {s, *(s[:i] + s[i + 1 :] for i in range(len(s)))}
            made: list[tuple[str, set[str]]] = []
            if t == "person" and 3 <= len(s) <= 5 and len(r) > 1 and "|" not in r:
                made.append((f"{t}0{r}\x1f", one))
            if len(s) >= 5:
                made.append((f"{t}1{r[:1] if t == 'person' else r}\x1f", one))
                if len(s) >= TWO_EDITS_FROM and len(r) > 1:
                    made.append((f"{t}2{r}\x1f", one | {v[:i] + v[i + 1 :] for v in one for i in range(len(v)) if len(v) < len(s)}))
            for head, variants in made:
                hashes += [xxhash.xxh3_64_intdigest((head + v).encode("utf-8", "surrogatepass")) for v in variants]
                numbers += [c] * len(variants)
                twos += [head[len(t)] == "2"] * len(variants)
        yield pd.DataFrame({"_h": np.array(hashes, dtype=np.uint64).view(np.int64), "_c": np.array(numbers, dtype=np.int64), "_two": np.array(twos, dtype=bool)})


def odd_parts(stem: str) -> set[int]:
    """The buckets of a stem's letter triples, its ends included."""
    w = f"^{stem}$"
    return {zlib.crc32(w[i : i + 3].encode("utf-8", "surrogatepass")) % TRIPLES for i in range(len(w) - 2)}


def _triples(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        c = Counter(x for s in b["stem"] for x in odd_parts(s))
        yield pd.DataFrame({"t": list(c), "n": list(c.values())}, dtype="int64")


def _alike(seen, few: int):
    """Keeps pairs one or, where that may count, two edits apart; ``d`` is how many. Two edits that leave both spellings with
    none but usual letter triples make another name, not a slip."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = seen.value
        odd = lambda s: min(counts[x] for x in odd_parts(s)) <= few
        for b in batches:
            d = [1 if near(x, y) else 2 if two and edits(x, y) <= 2 and (odd(x) or odd(y)) else 3 for x, y, two in zip(b["stem_a"], b["stem_b"], b["_two"])]
            yield b.assign(d=pd.array(d, dtype="int32"))[[x < 3 for x in d]]

    return run


def link_variants(df: DataFrame, id_col: str = "canonical_id", mention_col: str = "original_mention", text_col: str = "canonical_text", aliases_col: str = "aliases", chunks_col: str = "chunk_uids", label_col: str = "label", least_score: float = LEAST_SCORE) -> DataFrame:
    """(id, component, score, rarity): every row that names a person or organisation, with the smallest id that names the same.

    The spellings of a row are its mention and aliases, or its canonical text where there are none. Rows without a
    readable spelling, and places, get no component; rows repeated with one id count once, null ids are left out.
    Where a spelling's rarity counts, rows with the same spellings in the same chunks but for the document are copies of one.

    A rewriting that n names share scores 1/n, a slip four fifths for each edit; what scores less than LEAST_SCORE links nothing.
    ``score`` is the best of a row's links, ``rarity`` the negative decimal logarithm of the share of all rows that have the link's rewriting.
    """
    label = F.upper(F.trim(label_col)) if label_col in df.columns else F.lit(None).cast("string")
    # what follows the document in a chunk's id
    places = F.transform(chunks_col, lambda x: F.regexp_extract(x, "[^:]*$", 0)) if chunks_col in df.columns else F.array().cast("array<string>")
    src = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("_id"), F.array_distinct(F.concat(F.array(mention_col), F.coalesce(aliases_col, F.array().cast("array<string>")))).alias("_all"), F.col(text_col).alias("_text"), places.alias("_places"), label.alias("_label"))
    names = F.filter("_all", lambda x: F.length(F.trim(x)) > 0)
    src = src.select("_id", F.when(F.size(names) > 0, names).otherwise(F.array("_text")).alias("_names"), "_places", "_label")
    seen = F.when(F.size("_places") > 0, F.concat_ws("\x1f", F.array_sort("_names"), F.array_sort("_places"))).otherwise(F.col("_id"))
    src = src.select("_id", F.sha2(seen, 256).alias("_seen"), "_names", "_label")
    forms = materialize(src.mapInPandas(_forms, "_id string, _seen string, type string, stem string, rest string, strength string").distinct(), "variant-forms")
    # a class is a rewriting; its members form a star around the smallest id, never all pairs
    full = forms.where("strength = 'full'")
    rows = forms.select("_id").distinct().count()
    # one edge: who, to whom, over how many names the rewriting leaves open, and how many rows have it
    edge = lambda d, names=F.lit(1): d.select(F.col("_id").alias("src"), F.col("_hub").alias("dst"), (F.lit(1.0) / names).alias("score"), F.col("_df").alias("df"))
    star = lambda f, by: f.join(f.groupBy(*by).agg(F.min("_id").alias("_hub"), F.countDistinct("_id").alias("_df")), by)
    edges = edge(star(full.select("_id", "type", "stem", "rest"), ["type", "stem", "rest"]))
    letters = forms.where("type = 'person'").withColumn("letter", F.substring("rest", 1, 1))
    hubs = materialize(full.groupBy("type", "stem", "rest").agg(F.min("_id").alias("_hub"), F.countDistinct("_id").alias("_df")), "variant-hubs")
    people = hubs.where("type = 'person'").drop("type")
    # an initial is a rewriting of every full name of the surname that begins with it
    names_of = people.groupBy("stem", F.substring("rest", 1, 1).alias("letter")).agg(F.count(F.lit(1)).alias("_open"), F.min("_hub").alias("_hub"), F.sum("_df").alias("_df"))
    initials = letters.where("strength = 'initial'").select("_id", "stem", "letter").join(names_of, ["stem", "letter"], "left")
    edges = edges.unionByName(edge(initials.where("_hub is not null"), F.col("_open")))
    edges = edges.unionByName(edge(star(initials.where("coalesce(_open, 1) = 1").select("_id", "stem", "letter"), ["stem", "letter"])))
    # a short form of several names stands with its like, and with the one of those names that the surname is known with
    maybe = forms.where("strength = 'maybe'").select("_id", "stem", "rest")
    edges = edges.unionByName(edge(star(maybe, ["stem", "rest"])))
    fits = maybe.select("stem", F.col("rest").alias("_m"), F.explode(F.split("rest", r"\|")).alias("rest")).distinct().join(people, ["stem", "rest"])
    fits = fits.groupBy("stem", "_m").agg(F.min("_hub").alias("_hub"), F.count(F.lit(1)).alias("_open"), F.sum("_df").alias("_df")).withColumnRenamed("_m", "rest")
    edges = edges.unionByName(edge(maybe.join(fits, ["stem", "rest"]), F.col("_open")))
    # an organisation without its kind is a rewriting of every kind of organisation of that name
    kinds_of = hubs.where("type = 'org'").groupBy("stem").agg(F.count(F.lit(1)).alias("_open"), F.min("_hub").alias("_hub"), F.sum("_df").alias("_df"))
    bare = forms.where("strength = 'bare'").select("_id", "stem").distinct()
    edges = edges.unionByName(edge(bare.join(kinds_of, "stem"), F.col("_open"))).unionByName(edge(star(bare, ["stem"])))
    # two given names one slip apart, with no third of that surname
    pair = people.groupBy("stem").agg(F.min(F.struct("rest", "_hub", "_df")).alias("_a"), F.max(F.struct("rest", "_hub", "_df")).alias("_b"), F.count(F.lit(1)).alias("_n")).where("_n = 2 and levenshtein(_a.rest, _b.rest) = 1 and length(stem) >= 5")
    edges = edges.unionByName(pair.select(F.col("_a._hub").alias("src"), F.col("_b._hub").alias("dst"), F.lit(0.8).alias("score"), F.least("_a._df", "_b._df").alias("df")))
    # misspelt stems: classes, not rows, are compared
    classes = materialize(forms.groupBy("type", "stem", "rest").agg(F.min("_id").alias("_hub"), F.countDistinct("_seen").alias("_n")), "variant-classes")
    # rows of 17 bytes meet by their hash; which classes met is then told by the classes themselves
    numbered = classes.withColumn("_c", F.xxhash64("type", "stem", "rest"))
    v = materialize(numbered.select("_c", "type", "stem", "rest").mapInPandas(_left_out, "_h bigint, _c bigint, _two boolean"), "variant-left-out")
    met = v.select("_h", F.col("_c").alias("_ca"), F.col("_two")).join(v.select("_h", F.col("_c").alias("_cb")), "_h").where("_ca < _cb").groupBy("_ca", "_cb").agg(F.max("_two").alias("_two"))
    side = lambda x: numbered.select(F.col("_c").alias(f"_c{x}"), F.col("type").alias(f"type_{x}"), F.col("stem").alias(f"stem_{x}"), F.col("rest").alias(f"rest_{x}"), F.col("_n").alias(f"_n{x}"))
    alike = (F.col("rest_a") == F.col("rest_b")) | ((F.col("type_a") == "person") & ((F.length("rest_a") == 1) | (F.length("rest_b") == 1)))
    # two edits count only where one of the spellings stands in a single row but for copies, as a slip does and a name seldom, or is far the rarer
    slip = lambda x, y: (F.col(x) == 1) | (F.col(x) * RARER <= F.col(y))
    pairs = met.join(side("a"), "_ca").join(side("b"), "_cb").where((F.col("type_a") == F.col("type_b")) & (F.col("stem_a") != F.col("stem_b")) & alike)
    pairs = pairs.select(F.col("type_a").alias("type"), "stem_a", "rest_a", "stem_b", "rest_b", (F.col("_two") & (slip("_na", "_nb") | slip("_nb", "_na"))).alias("_two"), "_na", "_nb")
    shape = "type string, stem_a string, rest_a string, stem_b string, rest_b string, _two boolean, _na bigint, _nb bigint, d int"
    # TRIPLES counts whatever the data
    stems = classes.where("length(stem) >= 5").select("stem").distinct()
    counted = stems.mapInPandas(_triples, "t bigint, n bigint").groupBy("t").agg(F.sum("n").alias("n")).toPandas()
    seen3 = np.zeros(TRIPLES, dtype=np.int64)
    seen3[counted["t"].to_numpy(dtype=np.int64)] = counted["n"].to_numpy(dtype=np.int64)
    few = max(LEAST_TRIPLES, int(RARE_TRIPLE * stems.count()))
    pairs = materialize(pairs.mapInPandas(_alike(df.sparkSession.sparkContext.broadcast(seen3), few), shape), "variant-pairs")
    # a spelling with a neighbour one edit away is that neighbour's slip, and is not linked further away
    slips = pairs.where("d = 1")
    placed = slips.select("type", F.col("stem_a").alias("stem"), F.col("rest_a").alias("rest")).unionByName(slips.select("type", F.col("stem_b").alias("stem"), F.col("rest_b").alias("rest"))).distinct()
    far = pairs.where("d = 2")
    ends = ("type", "stem_a", "rest_a", "stem_b", "rest_b")
    for x in "ab":
        far = far.join(placed.select("type", F.col("stem").alias(f"stem_{x}"), F.col("rest").alias(f"rest_{x}"), F.lit(True).alias(f"_p{x}")), ["type", f"stem_{x}", f"rest_{x}"], "left")
    far = far.where((slip("_na", "_nb") & F.col("_pa").isNull()) | (slip("_nb", "_na") & F.col("_pb").isNull()))
    pairs = slips.select(*ends, F.lit(0.8).alias("score"), F.least("_na", "_nb").alias("df")).unionByName(far.select(*ends, F.lit(0.64).alias("score"), F.least("_na", "_nb").alias("df")))
    hub = classes.groupBy("type", "stem", "rest").agg(F.min("_hub").alias("_hub"))
    ha = hub.select("type", F.col("stem").alias("stem_a"), F.col("rest").alias("rest_a"), F.col("_hub").alias("src"))
    hb = hub.select("type", F.col("stem").alias("stem_b"), F.col("rest").alias("rest_b"), F.col("_hub").alias("dst"))
    typos = pairs.join(ha, ["type", "stem_a", "rest_a"]).join(hb, ["type", "stem_b", "rest_b"]).select("src", "dst", "score", "df")
    edges = materialize(edges.unionByName(typos).where(F.col("score") >= least_score).groupBy("src", "dst").agg(F.max(F.struct("score", (-F.col("df")).alias("df"))).alias("_s")), "variant-edges")
    ends_ = edges.select(F.col("src").alias("_id"), "_s").unionByName(edges.where("src <> dst").select(F.col("dst").alias("_id"), "_s")).groupBy("_id").agg(F.max("_s").alias("_s"))
    found = connected_components(edges.select("src", "dst")).join(ends_, F.col("node") == F.col("_id"))
    return found.select(F.col("node").alias(id_col), "component", F.round("_s.score", 4).alias("score"), F.round(F.log10(F.lit(max(1, rows)) / -F.col("_s.df")), 4).alias("rarity"))


def variant_pairs(links: DataFrame, id_col: str = "canonical_id") -> DataFrame:
    """(a, b), a < b: all pairs of ids of one component."""
    a = links.select("component", F.col(id_col).alias("a"))
    return a.join(links.select("component", F.col(id_col).alias("b")), "component").where("a < b").select("a", "b")
