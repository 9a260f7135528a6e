"""Personal information in free text: finding it, typed placeholders, and keyed surrogates.

E-mail addresses, phone numbers, identity numbers and street addresses are found by their formats, each of which
excludes look-alikes (run ids, ISBNs, grids, decorators); persons by given names with surnames in either order, by
initials, titles, patronymics or honorifics beside a surname, by well-known surnames, and by a given name standing alone. Which words are
given names, and which words in lower case are surnames, is learned from the whole corpus, beginning with the seeds of ``names``.
What one kind has claimed is closed to the next.

A surrogate is drawn with a keyed hash from the item's own parts: a given name becomes another of the same gender and script, a
surname another of the same script, case and number of syllables, digits and letters of codes others in the same format with a valid check
character; of an e-mail address only the last label of the host stays. Parts, not whole names, are mapped, so "A. Tal", "Tal, Anna" and "Anna Tal" stay
one person; within a text two different parts never get the same surrogate: the later one is drawn again, from a space that grows.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import load_shared, materialize, share
from .names import FAMILY_FIRST, GIVEN_NAMES, HAN_FAMILIES, SHORT_FORMS, SURNAMES, TITLES

KINDS = ("email", "phone", "id_number", "address", "person")
#: A learned given name stands before so many different surnames; of the capitalised words behind it every so many-th is one, and so many times
#: the share of any capitalised words.
LEAST_SURNAMES, FEWEST, LIFT = 3, 100, 3.0
#: Learned names are shared as one set up to this many words; beyond, each text gets those it holds by a join.
BROADCAST_WORDS = 200_000

_DOT = r"(?:\.|\s?[\[({]\s?dot\s?[\])}]\s?|\sdot\s)"
_EMAIL = re.compile(
    r"(?<![\w.+@/-])[^\W_][\w.+-]*(?:@|\s?[\[({]\s?at\s?[\])}]\s?)[^\W_][\w-]*(?:" + _DOT + r"[^\W\d_][\w-]*)+"
    r"|(?<![\w.+@/-])[^\W_][\w.+-]*\sat\s[^\W_][\w-]*(?:(?:\s?[\[({]\s?dot\s?[\])}]\s?|\sdot\s)[^\W\d_][\w-]*)+",
    re.I,
)
_PHONE = re.compile(
    r"(?<![\w.,/-])(?:"
    r"\+\d{1,3}(?:[ .-]?\(\d{1,4}\))?(?:[ .-]?\d{2,10}|[ .-]\d){2,6}"
    r"|00\d{1,3} \d{2,4} \d{6,8}"
    r"|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}-\d{3}-\d{4}|\d{3}\.\d{3}\.\d{4}"
    r"|\(0\)\d{2,4} \d{4,6}(?: \d{2,4})?"
    r"|0\d{4} \d{6}|0\d{4} \d{3} \d{3}|0\d{2} \d{4} \d{4}|0\d{3} \d{3} \d{4}|0\d{2,3} \d{5} ?\d{3}"
    r"|0\d(?:[ .-]\d{2}){4}"
    r")(?![\w-]*\d)"
)
_ID = re.compile(
    r"(?<![\w.-])(?:"
    r"\d{4}-\d{4}-\d{4}-\d{3}[\dXx]"
    r"|\d{3}([- ])\d{2}\1\d{4}"
    r"|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]"
    r"|[A-Z]\d{8}|[XYZ]-?\d{7}-?[A-Z]"
    r"|\d{8}-?[A-HJ-NP-TV-Z]"
    r")(?![\w-])"
)
_UP = "A-ZÀ-ÖØ-ÞŁŚŞÇĐŠŽČĞİА-ЯЁІЇЄҐΑ-ΩΆΈΉΊΌΎΏ"
_LOW = "a-zß-öø-ÿāăąćčđďęěēğīıłńňőœřśşšťūůűźżžа-яёіїєґά-ώ"
_CAP = rf"[{_UP}][\w’'-]*"
_STREET = r"(?:Drive|Dr|Blvd|Boulevard|Terrace|Close|Court|Ct|Way|Road|Rd|Street|St|Lane|Ln|Crescent|Avenue|Ave|Place|Pl|Square|Gardens|Row|Hill|Parade|Mews|Grove)"
_ADDRESS = re.compile(
    rf"(?<![\w.-])(?:(?:Flat|Apt|Unit|Suite) \d+[A-Za-z]?, )?\d{{1,5}}[a-z]? (?:(?:North|South|East|West) )?(?:{_CAP} ){{1,2}}{_STREET}\b"
    rf"|\b(?:Calle|Avenida|Paseo|Plaza|Via|Viale|Rua) (?:(?:de|del|la|las|los) )*{_CAP} \d{{1,4}}\b"
    rf"|(?<![\w.-])\d{{1,4}}(?: ?(?:bis|ter))?,? (?:rue|avenue|boulevard|place|quai|chemin|impasse) (?:(?:de|du|des|la|le|les) |d’|d'|l’|l')*{_CAP}"
    rf"|\b{_CAP}(?:stra(?:ß|ss)e|weg|allee|gasse|platz|damm) \d{{1,4}}[a-z]?\b",
)
_WORD = re.compile(r"[^\W\d_]+(?:[’'][^\W\d_]+)*")
_GENDER = {g.casefold(): k for k, v in GIVEN_NAMES.items() for g in v}
_GENDER |= {s.casefold(): _GENDER[g.casefold()] for g, v in SHORT_FORMS.items() for s in v.split()}
_LOWER_GIVEN = frozenset(g for g in _GENDER if g.islower())
_TITLES = {t.casefold() for t in TITLES}
#: Short forms and names that are also everyday words stand for persons only before a surname.
_WEAK = set("art bas bill billy bob chuck dan dick drew ed fran jo justin kit lex memo mick nick pat patty rich rick rob sandy scott sue ted teddy tori will".split())
_INITIALS = rf"(?:[{_UP}]\.[ -]?)"
_SURNAME = rf"[{_UP}](?:[{_LOW}]{{2,}}|[{_UP}]{{2,}})(?:[’'-](?:[{_UP}][^\W\d_]+))*"
_AFTER = re.compile(rf" {_INITIALS}*({_SURNAME})")
_AFTER_LOWER = re.compile(r" (?:[^\W\d_]\.? )*([^\W\d_]{3,}(?:-[^\W\d_]{3,})*)\b")
_MIDDLE = re.compile(rf"(?: {_INITIALS})*")
_BEFORE_LOWER = re.compile(r"(?<![\w-])([^\W\d_]{3,}(?:-[^\W\d_]{3,})*), $")
_BEFORE = re.compile(rf"({_SURNAME}), $")
_INITIALED = re.compile(rf"(?<![\w.’'-]){_INITIALS}+ ?{_SURNAME}(?![\w’'])")
_TITLED = re.compile(rf"\b(?:{'|'.join(TITLES)})\.? ((?:{_INITIALS}+ ?)?{_SURNAME})(?: ({_SURNAME}))?")
_PAIR = re.compile(rf"(?<![\w.’'-])({_SURNAME})(?= ({_SURNAME})(?![\w’']))")
_PATRONYMIC = re.compile(r"(?<!\w)[А-ЯЁ][а-яё]+ [А-ЯЁ][а-яё]+(?:ович|евич|ич|овна|евна|инична)\b(?: [А-ЯЁ][а-яё]+)?")
_SLAVIC = re.compile(r"(?:ов|ев|ёв|ин|ын|ский|цкий|ова|ева|ёва|ина|ына|ская|цкая|енко|чук|юк)$")
_HAN = re.compile(rf"(?<![一-鿿])[{HAN_FAMILIES}][一-鿿]{{1,2}}(?=先生|女士|小姐|教授|博士|老师|医生)|(?<![一-鿿])[一-鿿]{{2,4}}(?=さん|様|氏(?![一-鿿]))")
_PLACED = re.compile(r"(?:Lake|Port|Mount|Fort|Cape|Saint|St\.?|Hotel|Villa|Upper|Lower|Hurricane) $")
_THING = re.compile(r"(?:’s|'s)? (?:Street|Road|Hospital|University|Institute|Lake)\b")
_NOT_SURNAMES = {w.casefold() for w in "The And Of From For At In On By With Street Road University Institute Ministry Lake Port Upper Hospital Laboratory January February March April May June July August September October November December Monday Tuesday Wednesday Thursday Friday Saturday Sunday Inc Ltd Limited GmbH LLC PLC AG Corp Corporation Company Partners".split()}


@dataclass(frozen=True)
class Names:
    """What counts as a name beyond the seeds: ``given`` as learned from a corpus, ``lower`` surnames that stand in lower case only behind given names;
    ``plain`` are well-known surnames that the corpus uses as ordinary words."""

    given: frozenset = frozenset()
    lower: frozenset = frozenset()
    plain: frozenset = frozenset()

    def is_given(self, word: str) -> bool:
        return word in _GENDER or word in self.given

    def is_lower_surname(self, word: str) -> bool:
        return word in self.lower or word in SURNAMES


def find_items(text: str, names: Names = Names()) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every item, in order of their starts; items do not overlap."""
    taken: list[tuple[int, int]] = []  # in order; they never overlap
    out: list[tuple[int, int, str]] = []

    def free(s: int, e: int) -> bool:
        k = bisect_left(taken, (s, s))
        return (k == len(taken) or taken[k][0] >= e) and (k == 0 or taken[k - 1][1] <= s)

    def claim(s: int, e: int, kind: str) -> bool:
        if not free(s, e):
            return False
        insort(taken, (s, e))
        out.append((s, e, kind))
        return True

    if "@" in text or re.search(r"\bat\b", text, re.I):
        for m in _EMAIL.finditer(text):
            claim(m.start(), m.end(), "email")
    if any(c.isdigit() for c in text):
        for m in _ADDRESS.finditer(text):
            claim(m.start(), m.end(), "address")
        for m in _ID.finditer(text):
            claim(m.start(), m.end(), "id_number")
        for m in _PHONE.finditer(text):
            if sum(c.isdigit() for c in m[0]) >= 9:
                s = m.start() + next(i for i, c in enumerate(m[0]) if c.isdigit() or c == "+")
                claim(s, m.end(), "phone")
    for m in _TITLED.finditer(text):
        if m[1].casefold() not in _NOT_SURNAMES:
            first = _WORD.match(m[1])
            if not (first and names.is_given(first[0].casefold())):
                claim(m.start(1), m.end(1), "person")
    for m in _PATRONYMIC.finditer(text):
        claim(m.start(), m.end(), "person")
    for m in _HAN.finditer(text):
        claim(m.start(), m.end(), "person")
    family_at = -1
    for m in _WORD.finditer(text):
        w = m[0].casefold()
        s, e = m.span()
        if w[-2:] in ("'s", "’s"):
            w, e = w[:-2], e - 2
        if m[0][0].isupper() and w not in _GENDER and (w in FAMILY_FIRST or w in SURNAMES and w not in names.plain or "а" <= w[0] <= "ё") and free(s, s + 1):
            if w in FAMILY_FIRST:
                after = _AFTER.match(text, e)
                if after and after[1].casefold() not in _NOT_SURNAMES and (s < 1 or text[s - 1] not in "@_+-.’'") and not _THING.match(text, after.end()):
                    claim(s, after.end(), "person")
                    continue
            # an unknown given name before a surname that is well known, or has the shape Slavic surnames have
            elif family_at >= 0 and (w in SURNAMES or _SLAVIC.search(w) and len(w) > 4) and text[family_end:s] == " " and not _THING.match(text, e):
                claim(family_at, e, "person")
                continue
        family_at = -1
        if not names.is_given(w):
            if m[0][0].isupper() and len(w) > 2 and w not in _NOT_SURNAMES and w not in _TITLES and (("а" <= w[0] <= "ё") or not _opens(text, s)) and (s < 1 or text[s - 1] not in "@_+-.’'"):
                family_at, family_end = s, e
            continue
        if not free(s, s + 1) or (s and (text[s - 1] in "@_+-.’'" and text[s - 1 : s] != "-" or text[s - 1].isdigit())) or text[e : e + 1] in "@_+" and text[e : e + 1]:
            continue
        upper = m[0][0].isupper()
        if upper:
            after = _AFTER.match(text, e)
            if after and after[1].casefold() not in _NOT_SURNAMES and not (names.is_given(x := after[1].casefold()) and (w in _WEAK or x in _WEAK)):
                claim(s, after.end(), "person")
                continue
            before = _BEFORE.search(text, max(0, s - 60), s)
            if before and before[1].casefold() not in _NOT_SURNAMES and free(before.start(1), before.end(1)):
                middle = _MIDDLE.match(text, e)
                claim(before.start(1), middle.end() if middle else e, "person")
                continue
            if w not in _WEAK and not _THING.match(text, e) and not _PLACED.search(text, max(0, s - 12), s):
                claim(s, e, "person")
        else:
            after = _AFTER_LOWER.match(text, e)
            if after and names.is_lower_surname(after[1].casefold()):
                claim(s, after.end(), "person")
            else:
                before = _BEFORE_LOWER.search(text, max(0, s - 60), s)
                if before and w not in _WEAK and names.is_lower_surname(before[1].casefold()):
                    claim(before.start(1), e, "person")
    for m in _INITIALED.finditer(text):
        if _WORD.findall(m[0])[-1].casefold() not in _NOT_SURNAMES:
            claim(m.start(), m.end(), "person")
    return sorted(out)


def _opens(text: str, s: int) -> bool:
    """Whether a sentence or line begins here, where any word is written with a capital."""
    before = text[max(0, s - 3) : s].rstrip(" ")
    return not before or before[-1] in ".!?:\n\r\"“(["


_ALPHABETS = (
    ("а", "ё", "бвгдклмнпрстфх", "аеиоу", "нлр"),
    ("ά", "ώ", "βγδζθκλμνπρστφ", "αειου", "νλρ"),
    ("一", "鿿", "".join(dict.fromkeys("安宝成德恩福光海华嘉建健杰金静军凯兰丽亮林龙明宁平启庆仁荣瑞森诗天文武贤祥晓欣雄雅艺英永玉云泽志中")), "", ""),
)


class Surrogates:
    """Replacements for the items of one text: the same part always gets the same one, two different parts never do."""

    def __init__(self, key: bytes):
        self.key = key
        self.given: dict[tuple[str, str], str] = {}
        self.used: dict[tuple[str, str], str] = {}

    def _draw(self, kind: str, part: str, turn: int) -> int:
        return int.from_bytes(hmac.new(self.key, f"{kind}\x1f{part}\x1f{turn}".encode("utf-8", "surrogatepass"), hashlib.sha256).digest(), "big")

    def part(self, kind: str, part: str, make) -> str:
        """``make(number, turn)`` draws from a space that grows with the turn, so a free replacement is always found."""
        known, turn = self.given.get((kind, part)), 0
        while known is None:
            made = make(self._draw(kind, part, turn), turn)
            turn += 1
            if made != part and self.used.setdefault((kind, made), part) == part:
                known = self.given[(kind, part)] = made
        return known

    def syllables(self, n: int, count: int, like: str) -> str:
        c, v, k = "bdfghklmnprstv", "aeiou", "lnr"
        for low, high, *own in _ALPHABETS:
            if low <= like[:1].lower() <= high:
                c, v, k = own
        out = ""
        for _ in range(count):
            n, i = divmod(n, len(c))
            out += c[i]
            if v:
                n, i = divmod(n, len(v))
                out += v[i]
                n, i = divmod(n, len(k) + 1)
                out += (k[i] if i < len(k) else "")
        return out

    def given_name(self, word: str) -> str:
        gender = _GENDER.get(word.casefold())
        like = word[:1].lower()
        script = next((i for i, (low, high, *_) in enumerate(_ALPHABETS) if low <= like <= high), -1)
        pool = [g for k in ([gender] if gender else ["f", "m"]) for g in GIVEN_NAMES[k] if script == next((i for i, (low, high, *_) in enumerate(_ALPHABETS) if low <= g[0].lower() <= high), -1)]

        def make(n: int, turn: int) -> str:
            # single names first, then two of them, then ever longer ones
            if pool and turn < 8:
                return pool[n % len(pool)].casefold()
            if pool and turn < 16:
                return f"{pool[n % len(pool)]}-{pool[n // len(pool) % len(pool)]}".casefold()
            return self.syllables(n, 2 + (turn - 16 if pool else turn) // 4, word)

        return self.part("name", word.casefold(), make).title()

    def surname(self, word: str) -> str:
        return self.part("name", word.casefold(), lambda n, turn: self.syllables(n, max(2, round(len(word) / 2.6)) + turn // 8, word))

    def coded(self, kind: str, text: str) -> str:
        """Digits for digits and letters for letters, in the format of the text; the first digit of a block stays no 0 unless it was one."""
        core = re.sub(r"[\W_]", "", text)

        def make(n: int, turn: int) -> str:
            out = []
            for i, c in enumerate(core):
                if c.isdigit():
                    n, d = divmod(n, 10)
                    c = "0" if kind == "phone" and i == 0 and c == "0" else str(d or int(i == 0))
                elif c.isascii() and c.isalpha():
                    n, d = divmod(n, 21)
                    made = "ABCEGHJKLMNPRSTWXYZVD"[d]
                    c = made if c.isupper() else made.lower()
                out.append(c)
            return _with_check("".join(out), core)

        made = iter(self.part(kind, core, make))
        return "".join(next(made) if c.isalnum() else c for c in text)

    def words(self, text: str) -> str:
        def one(m: re.Match) -> str:
            w = m[0]
            if len(w) == 1:
                return w
            made = self.given_name(w) if w.casefold() in _GENDER else self.surname(w)
            return made.upper() if w.isupper() else made.lower() if w.islower() else made[0].upper() + made[1:]

        return _WORD.sub(one, text)

    def plain(self, kind: str, text: str) -> str:
        """Every run of letters or digits replaced, in ASCII."""

        def one(m: re.Match) -> str:
            w = m[0]
            if w.isdigit():
                return self.coded(kind, w)
            made = (self.given_name(w) if w.casefold() in _GENDER else self.surname(w)) if len(w) > 2 else self.part(kind, w.casefold(), lambda n, turn: self.syllables(n, 1 + turn // 8, "a"))
            made = re.sub(r"[^a-z]", "", unicodedata.normalize("NFKD", made.casefold()).encode("ascii", "ignore").decode()) or "user"
            return made.upper() if w.isupper() else made

        return re.sub(r"\d+|[^\W\d_]+", one, text)

    def replace(self, text: str, kind: str) -> str:
        if kind == "person":
            return self.words(text)
        if kind == "email":
            at = re.search(r"@|\s?[\[({]\s?at\s?[\])}]\s?|\sat\s", text, re.I)
            dots = [m.span() for m in re.finditer(_DOT, text[at.end() :], re.I)]
            host, last = [], 0
            for s, e in dots:
                host += [self.plain("host", text[at.end() + last : at.end() + s]), text[at.end() + s : at.end() + e]]
                last = e
            # only the last label, which names no one, stays
            return self.plain("email", text[: at.start()]) + text[at.start() : at.end()] + "".join(host) + text[at.end() + last :]
        if kind == "address":
            keep = {"flat", "apt", "unit", "suite", "north", "south", "east", "west", "calle", "avenida", "paseo", "plaza", "via", "viale", "rua", "rue", "avenue", "boulevard", "place", "quai", "chemin", "impasse", "bis", "ter", "de", "del", "du", "des", "la", "le", "les", "las", "los"} | {x.casefold() for x in re.findall(r"\w+", _STREET)}
            tail = re.search(r"stra(?:ß|ss)e|weg|allee|gasse|platz|damm", text)

            def one(m: re.Match) -> str:
                w = m[0]
                if w.isdigit():
                    return self.coded("address", w)
                if w.casefold() in keep or len(w) == 1:
                    return w
                if tail and w.endswith(tail[0]) and w != tail[0]:
                    made = self.surname(w[: -len(tail[0])])
                    return made[0].upper() + made[1:] + tail[0]
                made = self.surname(w)
                return made[0].upper() + made[1:]

            return re.sub(r"\d+|" + _WORD.pattern, one, text)
        return self.coded(kind, text)


def _with_check(code: str, like: str) -> str:
    """The code with the check character its format asks for: ISO 7064 for researcher numbers, modulo 23 for Spanish ones."""
    if re.fullmatch(r"\d{15}[\dXx]", like):
        t = 0
        for c in code[:15]:
            t = (t + int(c)) * 2
        r = (12 - t % 11) % 11
        return code[:15] + ("X" if r == 10 else str(r))
    m = re.fullmatch(r"([XYZ]?)(\d{7,8})[A-Z]", like)
    if m and len(m[1]) + len(m[2]) == 8:
        first = m[1] and "XYZ"["ABCEGHJKLMNPRSTWXYZVD".index(code[0]) % 3]
        body = first + code[len(first) : 8]
        return body + "TRWAGMYFPDXBNJZSQVHLCKE"[int(body.replace("X", "0").replace("Y", "1").replace("Z", "2")) % 23]
    if re.fullmatch(r"[A-Z]{2}\d{6}[A-D]", like):
        return code[:8] + "ABCD"[ord(code[8]) % 4]
    return code


def _observe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(role, word, other, n) summed over a batch: how words are written, which stand behind titles, initials and given names, which in pairs."""
    for b in batches:
        seen: Counter = Counter()
        for t in b["_text"]:
            words = Counter(_WORD.findall(t))
            for w, n in words.items():
                if len(w) > 2:
                    seen["low" if w.islower() else "cap", w.casefold(), ""] += n
            for m in _TITLED.finditer(t):
                seen["surname", _WORD.findall(m[2] or m[1])[-1].casefold(), ""] += 1
            for m in _INITIALED.finditer(t):
                seen["surname", _WORD.findall(m[0])[-1].casefold(), ""] += 1
            streets = [m.span() for m in _ADDRESS.finditer(t)] if any(c.isdigit() for c in t) else []
            for m in _PAIR.finditer(t):
                x, y = m[1].casefold(), m[2].casefold()
                k = bisect_left(streets, (m.start() + 1,)) - 1
                if k >= 0 and streets[k][1] > m.start():
                    continue
                if x not in _NOT_SURNAMES and y not in _NOT_SURNAMES and x not in _TITLES:
                    seen["pair", x, y] += 1
            # few texts write a given name in lower case
            for m in re.finditer(r"(?<![\w@.+-])[^\W\d_]{2,}(?![\w@+-])", t) if _LOWER_GIVEN.intersection(words) else ():
                if m[0].islower() and m[0] in _GENDER:
                    after, before = _AFTER_LOWER.match(t, m.end()), _BEFORE_LOWER.search(t, max(0, m.start() - 60), m.start())
                    for x in (after, before):
                        if x and x[1].islower():
                            seen["behind", x[1].casefold(), ""] += 1
        yield pd.DataFrame([(*k, n) for k, n in seen.items()], columns=["role", "word", "other", "n"])


def learn_names(texts: DataFrame) -> DataFrame:
    """(word, role) of the names that the texts (column ``_text``) show, over all of them.

    A surname stands behind a title, an initial or a seed given name. A word is a given name if it stands before LEAST_SURNAMES different
    surnames, which are at least every FEWEST-th capitalised word behind it and LIFT times as frequent as behind any, if the words behind it are many (at least
    the square root of their number), if it never stands behind a title alone, is in lower case at most half as often as capitalised,
    and stands before a capitalised word at least every third time. A word in lower case behind a given name in lower case
    is a surname if it stands there at least every third time; a well-known surname that is in lower case at least every tenth time is an ordinary word.
    """
    seen = materialize(texts.mapInPandas(_observe, "role string, word string, other string, n bigint").groupBy("role", "word", "other").agg(F.sum("n").alias("n")), "name-observations")
    pairs = seen.where("role = 'pair'")
    seeds = pairs.where(F.col("word").isin(*sorted(_GENDER)))
    surnames = seen.where("role = 'surname'").select("word").unionByName(seeds.select(F.col("other").alias("word"))).distinct()
    low = seen.where("role = 'low'").select("word", F.col("n").alias("_low"))
    cap = seen.where("role = 'cap'").select("word", F.col("n").alias("_cap"))
    marked = pairs.join(surnames.select(F.col("word").alias("other"), F.lit(True).alias("_is")), "other", "left")
    # how often any capitalised word is such a surname behind another
    base = marked.where(~F.col("word").isin(*sorted(_GENDER))).agg((F.coalesce(F.sum(F.when(F.col("_is"), F.col("n"))), F.lit(0)) / F.greatest(F.sum("n"), F.lit(1))).alias("_base"))
    given = marked.groupBy("word").agg(F.count("_is").alias("_s"), F.count(F.lit(1)).alias("_d"), F.sum(F.when(F.col("_is"), F.col("n"))).alias("_n"), F.sum("n").alias("_all")).where((F.col("_s") >= LEAST_SURNAMES) & (F.col("_n") * FEWEST >= F.col("_all")) & (F.col("_d") * F.col("_d") >= F.col("_all")))
    given = given.join(cap, "word").join(low, "word", "left").where((F.coalesce("_low", F.lit(0)) * 2 <= F.col("_cap")) & (F.col("_all") * 3 >= F.col("_cap"))).join(F.broadcast(base)).where(F.col("_n") >= F.least(F.lit(0.5), LIFT * F.col("_base")) * F.col("_all"))
    given = given.join(seen.where("role = 'surname'").select("word"), "word", "left_anti")
    lower = seen.where("role = 'behind'").groupBy("word").agg(F.sum("n").alias("_n")).join(low, "word").where(F.col("_n") * 3 >= F.col("_low"))
    plain = low.where(F.col("word").isin(*sorted(SURNAMES))).join(cap, "word", "left").join(lower.select("word"), "word", "left_anti").where(F.col("_low") * 10 >= F.col("_low") + F.coalesce("_cap", F.lit(0)))
    role = lambda d, r: d.select("word", F.lit(r).alias("role"))
    return role(given, "given").unionByName(role(lower, "lower")).unionByName(role(plain, "plain"))


def _rows_of(src: DataFrame, broadcast_words: int) -> tuple[DataFrame, object]:
    """The texts with what is needed to know the learned names in them: one shared set if it is small, else a list beside each text."""
    names = materialize(learn_names(src.select("_text")), "names")
    if names.count() <= broadcast_words:
        rows = names.collect()
        shared = share(src.sparkSession, Names(*(frozenset(r.word for r in rows if r.role == role) for role in ("given", "lower", "plain"))))
        return src.withColumn("_names", F.lit(None).cast("array<string>")), shared
    key = F.md5("_text")
    words = src.select(key.alias("_m"), F.explode(F.array_distinct(F.transform(F.regexp_extract_all("_text", F.lit(r"([\p{L}]+(?:[’'][\p{L}]+)*)"), 1), F.lower))).alias("word")).distinct()
    own = words.join(names, "word").groupBy("_m").agg(F.collect_set(F.concat_ws(":", "role", "word")).alias("_names"))
    return src.withColumn("_m", key).join(own, "_m", "left").drop("_m"), None


def _known(shared, own) -> Names:
    if own is None:
        return shared or Names()
    return Names(*(frozenset(x[6:] for x in own if x[:6] == f"{role}:") for role in ("given", "lower", "plain")))


def _spans(shared, key: bytes):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = load_shared(shared) if shared else None
        for b in batches:
            rows = []
            for i, t, own in zip(b["_id"], b["_text"], b["_names"]):
                made = Surrogates(key)
                rows += [(i, kind, s, e, t[s:e], made.replace(t[s:e], kind)) for s, e, kind in find_items(t, _known(names, own))]
            yield pd.DataFrame(rows, columns=["_id", "kind", "start_char", "end_char", "item", "surrogate"])

    return run


def find_personal(df: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """Rows (id, kind, start_char, end_char, item, surrogate), offsets in code points. Rows repeated with id and text count once;
    a null or empty text has no items. Other columns are ignored."""
    src = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where(F.length("_text") > 0)
    kind = src.schema["_id"].dataType.simpleString()
    rows, shared = _rows_of(src, broadcast_words)
    return rows.mapInPandas(_spans(shared, key.encode()), f"_id {kind}, kind string, start_char bigint, end_char bigint, item string, surrogate string").distinct().withColumnRenamed("_id", id_col)


def mask(text: str, key: bytes, names: Names = Names()) -> tuple[str, str, int]:
    """The text with typed placeholders, numbered so that equal items share one, and the text with surrogates."""
    made, known, numbers = Surrogates(key), {}, dict.fromkeys(KINDS, 0)
    placed, kept, last, items = [], [], 0, find_items(text, names)
    for s, e, kind in items:
        item = text[s:e]
        own = (kind, " ".join(sorted(w for w in _WORD.findall(item.casefold()) if len(w) > 1)) if kind == "person" else re.sub(r"[\W_]", "", item.casefold()))
        if own not in known:
            numbers[kind] += 1
            known[own] = f"[{kind.upper()}_{numbers[kind]}]"
        # "(415) 555-0191" begins at its 4; the bracket goes with it
        cut = s - 1 if s > last and text[s - 1] == "(" and item.count(")") > item.count("(") else s
        placed += [text[last:cut], known[own]]
        kept += [text[last:s], made.replace(item, kind)]
        last = e
    return "".join(placed) + text[last:], "".join(kept) + text[last:], len(items)


def replace_personal(df: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """(id, masked, surrogate, n_items) for every row: a null text stays null with 0 items, repeated rows stay repeated.
    ``key`` decides the surrogates; whoever lacks it cannot link them to the originals."""
    src = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = src.schema["_id"].dataType.simpleString()
    secret = key.encode()
    rows, shared = _rows_of(src.where("_text is not null"), broadcast_words)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = load_shared(shared) if shared else None
        for b in batches:
            made = [mask(t, secret, _known(names, own)) for t, own in zip(b["_text"], b["_names"])]
            yield pd.DataFrame({"_id": b["_id"], "masked": [r[0] for r in made], "surrogate": [r[1] for r in made], "n_items": [r[2] for r in made]})

    out = rows.mapInPandas(run, f"_id {kind}, masked string, surrogate string, n_items int")
    none = src.where("_text is null").select("_id", F.lit(None).cast("string").alias("masked"), F.lit(None).cast("string").alias("surrogate"), F.lit(0).alias("n_items"))
    return out.unionByName(none).withColumnRenamed("_id", id_col)
