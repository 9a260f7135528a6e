"""Repair of text from scanned pages: split words, misread letters, running headers and page numbers.

Words that make up at least one in 100,000 of all running words, at most 100,000 of them whatever the corpus, are the vocabulary.
Tokens outside it get candidates through an inverted index of letter pairs; boosted trees, fitted on misreadings made from the
vocabulary itself, rank them by how well known confusions explain the difference. Page furniture is
told from text line by line: by repetition within the document in changing surroundings, and by boosted trees fitted on a bounded
sample of documents (SAMPLE chunks) whose repeated lines give the labels, which also judge lines that occur once.
Boosted trees over the halves on two lines, fitted on the vocabulary's own words cut in two and on compounds that the corpus hyphenates within lines, say whether
they are one word; they also meet over furniture. What is found and what is repaired rest on the same decisions.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import load_shared, materialize, share
from .boost import Boosted

#: The fitting sample has at most SAMPLE chunks of fewer than LONGEST characters.
SAMPLE, LONGEST, COMMON_SHARE, LEAST_COUNT, RATIO = 6000, 20_000, 1e-5, 3, 30
#: A running header is on at least this share of the title-like lines of its document, and stands in three surroundings or more.
SHARE = 0.02
#: A word stands between so many times as often as its misreading in the examples; fixed, whatever the corpus.
RARITY = (30, 30_000)
#: What is printed and what it may be read as. Fixed values.
CONFUSIONS = (("m", "rn"), ("d", "cl"), ("w", "vv"), ("h", "li"), ("n", "ri"), ("h", "b"), ("n", "u"), ("u", "n"), ("b", "6"), ("g", "9"), ("q", "9"), ("l", "1"), ("i", "1"), ("o", "0"), ("s", "5"), ("z", "2"), ("i", "!"), ("l", "!"), ("e", "€"), ("c", "©"), ("e", "c"), ("c", "e"), ("fi", "ﬁ"), ("fl", "ﬂ"), ("ff", "ﬀ"), ("ffi", "ﬃ"), ("ffl", "ﬄ"), ("m", "nn"), ("t", "f"), ("a", "�"))
_ODD = "0123456789!€©�ﬀﬁﬂﬃﬄ"
_SIGNS = "-‐¬\xad"
_TOKEN = re.compile(r"[^\s.,;:()\[\]\"“”„»«'’‘|?—–/<>{}=+*#@&_\\~^%$-]+")
_PLAIN = re.compile(r"[^\W\d_]+")
_LINES = re.compile(r"\r\n|\r|\n")
_ROMAN = r"(?=[ivxlc])(?:x[cl]|l?x{0,3})(?:i[xv]|v?i{0,3})"
_FOLIO = re.compile(rf"(?:(?:page|p\.|pp\.|seite|s\.|página|pág\.)\s*(?P<a>\d{{1,4}})(?:\s*(?:of|/|von|de|sur)\s*\d{{1,4}})?|[-–—]\s*(?P<b>\d{{1,4}}|{_ROMAN})\s*[-–—]|\[\s*(?P<c>\d{{1,4}})\s*\]|(?P<d>\d{{1,4}})|(?P<e>{_ROMAN}))", re.I)
_EDGE_NUMBER = re.compile(r"^(?:(?P<a>\d{1,4})(?:\s{2,}|\t|\s*[|·•]\s*)(?P<x>\D.*)|(?P<y>.*\D)(?:\s{2,}|\t|\s*[|·•]\s*)(?P<b>\d{1,4}))$")
_TITLE = re.compile(r"[^.!?;]*(?:, (?:vol|no|nr|bd)\. ?\d+|[^\W_)]|\))", re.I)
_TABLE = re.compile(r"^\s*\|.*\|\s*$", re.M)
_OPENING = re.compile(r"(?:^|[.!?]\s+)([^\W\d_]+)")
_COMPOUND = re.compile(r"(?<![\w-])[^\W\d_]{2,}-[^\W\d_]{2,}(?![\w-])")
_HYPHEN_END = re.compile(rf"([^\W\d_]+)[{_SIGNS}][ \t]*$")


def lines_of(text: str) -> list[str]:
    return _LINES.split(text)


def folio_number(line: str) -> str | None:
    """The page number a line consists of, as written, or None."""
    m = _FOLIO.fullmatch(line.strip())
    return next((x for x in m.groups() if x), None) if m else None


def is_folio(line: str, page: int | None, table: bool) -> bool:
    """A line that is a page number and nothing else. A bare number or numeral must agree with the page, if that is known."""
    y = line.strip()
    number = folio_number(y)
    if number is None:
        return False
    if not number.isdigit():
        return not table and y == y.strip("-–— ").lower() or y[0] in "-–—"
    if y == number:
        return not table and (page is None or abs(int(number) - page) <= 1)
    return not table or page is None or abs(int(number) - page) <= 1


def title_of(line: str) -> tuple[str, bool] | None:
    """(the line without a page number at its edge, whether it had one), if it looks like a title at all."""
    y = line.strip()
    m = _EDGE_NUMBER.match(y)
    numbered = bool(m)
    if m:
        y = (m["x"] or m["y"]).strip()
    words = y.split()
    if not 2 <= len(words) <= 10 or len(y) > 90 or "|" in y or not y[0].isupper() or not _TITLE.fullmatch(y) or y[-1] in _SIGNS:
        return None
    return y, numbered


def title_key(title: str) -> str:
    t = unicodedata.normalize("NFKD", title.casefold())
    return " ".join(re.findall(r"[^\W_]+", t))


def _features(lines: list[str], i: int, scores: dict[str, float], widest: int) -> list[float]:
    y = lines[i].strip()
    title = title_of(y)
    t = title[0] if title else y
    before = next((lines[j].strip() for j in range(i - 1, -1, -1) if lines[j].strip()), "")
    behind = next((lines[j].strip() for j in range(i + 1, len(lines)) if lines[j].strip()), "")
    words = _PLAIN.findall(t)
    long_words = [w for w in words if len(w) > 3] or words or [""]
    return [
        len(words), len(t) / max(1, widest), float(t[-1:] in ".!?"), sum(w[0].isupper() for w in words) / max(1, len(words)), float(t.isupper()),
        float(behind[:1].islower()), float(bool(behind)), float(before[-1:] in ".!?:"), float(bool(before)), float(before[-1:] in _SIGNS), float(title[1] if title else 0),
        float(any(c in t for c in "—(")), sum(c.isdigit() for c in t), sum(scores.get(w.casefold(), 0.0) for w in words) / max(1, len(words)), max((scores.get(w.casefold(), 0.0) for w in long_words), default=0.0), float(any(len(w) <= 3 and w.islower() for w in words)),
    ]


class LineModel:
    """Says whether a title-like line is page furniture. Without enough examples it says no, and repetition alone decides."""

    def __init__(self, rows: pd.DataFrame):
        seen: dict[tuple[str, str], set[str]] = {}
        lines: list[tuple[list[str], int, str, str, int]] = []
        for doc, text in zip(rows["_doc"], rows["_text"]):
            ls = lines_of(text)
            widest = max(len(x.strip()) for x in ls)
            for i, x in enumerate(ls):
                t = title_of(x)
                if t:
                    key = title_key(t[0])
                    seen.setdefault((doc, key), set()).add(surroundings(ls, i))
                    lines.append((ls, i, doc, key, widest))
        # a long document repeats lines of text too, but not on its every so many pages
        whole, uses = Counter(d for _, _, d, _, _ in lines), Counter((d, k) for _, _, d, k, _ in lines)
        labels = [len(seen[d, k]) >= 3 and uses[d, k] >= SHARE * whole[d] for _, _, d, k, _ in lines]
        # words of titles that recur in several documents mark a title that occurs but once; it is no example of text
        titles = {(d, k) for (_, _, d, k, _), y in zip(lines, labels) if y}
        others = {(d, k) for (_, _, d, k, _), y in zip(lines, labels) if not y}
        often = Counter(w for _, k in titles for w in set(k.split()))
        else_ = Counter(w for _, k in others for w in set(k.split()))
        marks = {w for w, n in often.items() if n >= 3 and n / len(titles) >= 20 * else_[w] / len(others)}
        doubt = [not y and (len(seen[d, k]) == 2 or len(set(k.split()) & marks) > 0) for (_, _, d, k, _), y in zip(lines, labels)]
        # words are counted once per title, however often it recurs, and few of its lines teach the trees
        yes, no, keys = Counter(), Counter(), {}
        for (_, _, d, k, _), y, z in zip(lines, labels, doubt):
            if not z:
                keys[d, k] = y
        for (_, k), y in keys.items():
            (yes if y else no).update(set(k.split()))
        n = sum(keys.values()) + 1
        m = len(keys) - n + 2
        self.scores = {w: float(np.log((yes[w] + 0.5) / n / ((no[w] + 0.5) / m))) for w in {*yes, *no}}
        self.model = None
        if sum(labels) >= 8 and len(labels) - sum(labels) >= 8:
            x = np.array([_features(ls, i, self.scores, p) for ls, i, _, _, p in lines])
            met: Counter = Counter()
            keep = np.zeros(len(lines), dtype=bool)
            for r, ((_, _, d, k, _), z) in enumerate(zip(lines, doubt)):
                met[d, k] += 1
                keep[r] = not z and met[d, k] <= 20
            self.model = Boosted().fit(x[keep], np.array(labels)[keep])

    def score(self, lines: list[tuple[list[str], int, int]]) -> np.ndarray:
        if self.model is None or not lines:
            return np.zeros(len(lines))
        return self.model.predict(np.array([_features(ls, i, self.scores, p) for ls, i, p in lines]))


def surroundings(lines: list[str], i: int) -> str:
    """What stands next to a line, to tell a line that recurs on many pages from a text that is stored twice."""
    before = next((lines[j].strip() for j in range(i - 1, -1, -1) if lines[j].strip() and not folio_number(lines[j])), "")
    behind = next((lines[j].strip() for j in range(i + 1, len(lines)) if lines[j].strip() and not folio_number(lines[j])), "")
    return before[-12:] + "\x1f" + behind[:12]


def split_candidates(lines: list[str], page: int | None, table: bool) -> Iterator[tuple[int, int, str, str, str, list[str]]]:
    """(line, line, first half, second half, sign, titles between) of every line that ends in a hyphenation sign and the first line of text behind it.

    Blank lines and page numbers are passed over; so are lines that look like titles, which must prove to be furniture for the halves to meet.
    """
    for i, x in enumerate(lines):
        m = _HYPHEN_END.search(x)
        if not m:
            continue
        between: list[str] = []
        for j in range(i + 1, len(lines)):
            y = lines[j].strip()
            if not y or is_folio(y, page, table):
                continue
            title = title_of(y)
            if title:
                between.append(title_key(title[0]))
                continue
            k = re.match(r"[^\W\d_]+", y)
            if k and k[0][0].islower():
                yield i, j, m[1].lower(), k[0].lower(), x.rstrip()[-1], between
            break


def _halves(a: str, b: str, sign: str, counts: dict[str, int], whole: int | None = None) -> list[float]:
    n = counts.get(a + b, 0) if whole is None else whole
    x, y, z = counts.get(a, 0), counts.get(b, 0), counts.get(f"{a}-{b}", 0)
    return [float(x > 0), float(y > 0), float(n > 0), float(z > 0), np.log1p(n) - np.log1p(z), np.log1p(min(x, y)), len(a), len(b), float(sign != "-")]


class JoinModel:
    """Says whether the halves on two lines are one word. Fitted on words of the vocabulary cut in two, half of them as if the vocabulary lacked
    them, and on compounds that the corpus writes with a hyphen within a line. Without compounds every pair joins but two words that make none."""

    def __init__(self, counts: dict[str, int]):
        rng = np.random.default_rng(11)
        words = [w for w in sorted(counts) if len(w) >= 5 and "-" not in w]
        pairs = [w.split("-") for w in sorted(counts) if w.count("-") == 1]
        self.model = None
        self.known: dict[tuple[str, str, str], bool] = {}
        if len(words) >= 50 and pairs:
            x, y = [], []
            for w in [words[i] for i in rng.permutation(len(words))[:3000]]:
                k = int(rng.integers(2, len(w) - 1))
                for whole in (None, 0):
                    x.append(_halves(w[:k], w[k:], "-", counts, whole))
                    y.append(True)
            for a, b in [pairs[i] for i in rng.permutation(len(pairs))[:3000]]:
                x += [_halves(a, b, "-", counts)] * max(1, 3000 // min(3000, len(pairs)))
                y += [False] * max(1, 3000 // min(3000, len(pairs)))
            self.model = Boosted().fit(np.array(x), np.array(y))

    def judge(self, keys: set[tuple[str, str, str]], counts: dict[str, int]) -> None:
        """Settles many pairs of halves at once."""
        if len(self.known) > 100_000:
            self.known.clear()
        new = [key for key in keys if key not in self.known]
        for a, b, sign in new:
            self.known[a, b, sign] = sign != "-" or not (a in counts and b in counts and a + b not in counts and len(a) > 2 and len(b) > 2)
        asked = [key for key in new if key[2] == "-"]
        if self.model is not None and asked:
            found = self.model.predict(np.array([_halves(*key, counts) for key in asked]))
            self.known.update(zip(asked, (bool(p > 0.5) for p in found)))

    def joins(self, a: str, b: str, sign: str, counts: dict[str, int]) -> bool:
        self.judge({(a, b, sign)}, counts)
        return self.known[a, b, sign]


_BY_SIGN: dict[str, list[tuple[str, str]]] = {}
for _a, _b in CONFUSIONS:
    _BY_SIGN.setdefault(_b[0], []).append((_a, _b))


def explain(seen: str, meant: str) -> tuple[int, int, float]:
    """(confusions, other edits, cost) of the cheapest way to read ``meant`` as ``seen``."""
    i = 0
    while i < min(len(seen), len(meant)) and seen[i] == meant[i]:
        i += 1
    j = 0
    while j < min(len(seen), len(meant)) - i and seen[-1 - j] == meant[-1 - j]:
        j += 1
    # a confusion may begin or end with a letter that is equal by chance
    i, j = max(0, i - 1), max(0, j - 1)
    seen, meant = seen[i : len(seen) - j], meant[i : len(meant) - j]
    n, m = len(seen), len(meant)
    # over a long difference, ways with more than one other edit are given up: no reading has them, and what is left is few
    most = 9 if max(n, m) <= 8 else 1
    best: list[dict[int, tuple[float, int, int]]] = [{} for _ in range(n + 1)]
    best[0][0] = (0.0, 0, 0)
    for i in range(n + 1):
        for j in range(m + 1) if best[i] else ():
            at = best[i].get(j)
            if at is None:
                continue
            c, p, q = at
            steps = []
            same = i < n and j < m and seen[i] == meant[j]
            if same:
                steps.append((i + 1, j + 1, 0.0, 0, 0))
            for a, b in _BY_SIGN.get(seen[i], ()) if i < n else ():
                if (not same or len(a) + len(b) > 2) and seen.startswith(b, i) and meant.startswith(a, j):
                    steps.append((i + len(b), j + len(a), 0.3, 1, 0))
            if not same:
                if i < n and j < m:
                    steps.append((i + 1, j + 1, 0.35, 1, 0) if seen[i] == "�" else (i + 1, j + 1, 1.0, 0, 1))
                if i < n:
                    steps.append((i + 1, j, 1.0, 0, 1))
                if j < m:
                    steps.append((i, j + 1, 1.0, 0, 1))
            for x, y, d, e, f in steps:
                z = (c + d, p + e, q + f)
                if z[2] <= most and (y not in best[x] or z < best[x][y]):
                    best[x][y] = z
    c, p, q = best[n].get(m, (9.0, 0, 9))
    return p, q, c


def _pairs(word: str) -> list[str]:
    w = f"^{word}$"
    return [w[i : i + 2] for i in range(len(w) - 1)]


class WordModel:
    """Vocabulary with an inverted index of letter pairs, and the trees that rank its words as readings of a token."""

    def __init__(self, counts: dict[str, int], total: int):
        self.total = max(1, total)
        # compounds tell which words keep their hyphen, but are no readings
        self.joined = counts
        counts = {w: n for w, n in counts.items() if "-" not in w}
        self.counts = counts
        self.misread: dict[str, str] = {}
        self._index()
        # misreadings so frequent that they got into the vocabulary: a far more frequent word explains them wholly
        for w in sorted(counts):
            if len(w) >= 3:
                for v, _ in self.candidates(w):
                    if v != w and counts[v] >= RATIO * counts[w]:
                        p, q, _ = explain(w, v)
                        if q == 0 and 1 <= p <= 2 and len(v) >= 3:
                            self.misread[w] = v
                            break
        self.counts = {w: n for w, n in counts.items() if w not in self.misread}
        self._index()
        self.joiner = JoinModel(self.joined)
        self.model = self._fit()

    def _index(self) -> None:
        self.words = sorted(self.counts)
        self.lengths = np.array([len(w) for w in self.words] or [0])
        self.weights = np.log1p(np.array([self.counts[w] for w in self.words] or [0], dtype=float))
        index: dict[str, list[int]] = {}
        for i, w in enumerate(self.words):
            for p in set(_pairs(w)):
                index.setdefault(p, []).append(i)
        self.index = {p: np.array(v, dtype=np.int32) for p, v in index.items()}
        self.letters = sorted({c for w in self.words for c in w})

    def undone(self, token: str) -> list[int]:
        """All words that confusions alone turn into the token, however many: read sign by sign, as long as some word begins so."""
        out, todo, met = set(), [(0, "")], {(0, "")}
        while todo:
            i, head = todo.pop()
            if i == len(token):
                k = bisect_left(self.words, head)
                if head != token and k < len(self.words) and self.words[k] == head:
                    out.add(k)
                continue
            steps = [(1, token[i])] + [(len(b), a) for a, b in _BY_SIGN.get(token[i], ()) if token.startswith(b, i)]
            if token[i] == "�":
                steps += [(1, c) for c in self.letters]
            for n, more in steps:
                at = (i + n, head + more)
                if at not in met:
                    met.add(at)
                    k = bisect_left(self.words, at[1])
                    if k < len(self.words) and self.words[k].startswith(at[1]):
                        todo.append(at)
        return sorted(out)

    def candidates(self, token: str, k: int = 8) -> list[tuple[str, float]]:
        """The words most like the token by letter pairs, best first, and behind them all others that confusions alone explain."""
        # a short token shares few letter pairs with the word it was, so more words are looked at
        k, t = (k if len(token) > 4 else 4 * k), token
        for a, b in (("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl")):
            t = t.replace(a, b)
        lists = [self.index[p] for p in set(_pairs(t)) if p in self.index]
        exact = self.undone(token)
        if not lists:
            return [(self.words[i], 0.0) for i in exact]
        shared = np.bincount(np.concatenate(lists), minlength=len(self.words))
        near = np.where(np.abs(self.lengths - len(t)) <= 2, shared / (self.lengths + 1 + len(t) + 1 - shared), 0)
        near += np.where(near > 0, 1e-3 * self.weights, 0)
        top = np.argpartition(-near, k)[:k] if k < len(near) else np.arange(len(near))
        top = top[np.argsort(-near[top], kind="stable")]
        out = [(self.words[i], float(near[i])) for i in top if near[i] > 0]
        got = {w for w, _ in out}
        return out + [(self.words[i], float(near[i])) for i in exact if self.words[i] not in got]

    def features(self, token: str, count: float, word: str, overlap: float) -> list[float]:
        p, q, c = explain(token, word)
        n = self.counts.get(word, 1)
        return [p, q, c, overlap, len(word), np.log(n / self.total), np.log(n / count), float(any(x in _ODD for x in token)), abs(len(token) - len(word))]

    def _fit(self) -> Boosted | None:
        rng = np.random.default_rng(7)
        words = [w for w in self.words if len(w) >= 3]
        if len(words) < 20:
            return None
        x, y = [], []
        letters = "abcdefghijklmnopqrstuvwxyz"
        for w in [words[i] for i in rng.permutation(len(words))[:1500]]:
            # how rare a misreading is comes by chance: a fixed share of its word would tell the word from the others, and the more exactly the larger the corpus
            n = self.counts[w] / float(np.exp(rng.uniform(*np.log(RARITY))))
            spots = [(m.start(), a, b) for a, b in CONFUSIONS for m in re.finditer(a, w)]
            if not spots:
                continue
            i, a, b = spots[rng.integers(len(spots))]
            seen = w[:i] + b + w[i + len(a) :]
            if rng.random() < 0.15:
                more = [(m.start(), a, b) for a, b in CONFUSIONS for m in re.finditer(a, seen)]
                if more:
                    i, a, b = more[rng.integers(len(more))]
                    seen = seen[:i] + b + seen[i + len(a) :]
            if seen in self.counts:
                continue
            for v, o in self.candidates(seen):
                x.append(self.features(seen, n, v, o))
                y.append(v == w)
            # a slip of the hand is no misreading
            i = int(rng.integers(len(w)))
            kind = int(rng.integers(3))
            slip = w[:i] + w[i + 1 :] if kind == 0 else w[:i] + letters[rng.integers(26)] + w[i + (kind == 1) :]
            if slip not in self.counts and slip != w:
                for v, o in self.candidates(slip, 4):
                    if explain(slip, v)[1] > 0:
                        x.append(self.features(slip, n, v, o))
                        y.append(False)
        return Boosted().fit(np.array(x), np.array(y)) if sum(y) >= 8 else None

    def read(self, tokens: list[tuple[str, int]]) -> list[str | None]:
        """The words that tokens, given with their counts, were printed as; None where a token is no misreading."""
        out: list[str | None] = [self.misread.get(t) for t, _ in tokens]
        if self.model is None:
            return out
        x, at, words, fit = [], [], [], []
        for k, (t, n) in enumerate(tokens):
            if out[k] is None and t not in self.counts:
                for v, o in self.candidates(t):
                    f = self.features(t, n, v, o)
                    # what confusions do not explain stays as it is
                    if f[0] > 0 and f[1] <= 1:
                        x.append(f)
                        at.append(k)
                        words.append(v)
        if x:
            best: dict[int, float] = {}
            for k, v, p in zip(at, words, self.model.predict(np.array(x))):
                if p > max(0.5, best.get(k, 0.0)):
                    best[k], out[k] = p, v
        return out


def _count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        c: Counter = Counter()
        for t in b["_text"]:
            c.update(_PLAIN.findall(t))
            if "-" in t:
                c.update(_COMPOUND.findall(t))
        low = [(w, n) for w, n in c.items() if w.islower()]
        yield pd.DataFrame({"word": [w for w, _ in low], "n": np.array([n for _, n in low], dtype=np.int64)})


def odd_tokens(text: str, known: set[str]) -> set[str]:
    """Tokens that may be misreadings: in lower case, or with a sign no word has, or at the beginning of a sentence."""
    out: set[str] = set()
    odd = set(_TOKEN.findall(text)) - known
    opening = None
    for w in odd:
        w = w.strip("!")
        if len(w) < 3 or len(w) > 30 or w in known or not any(c.isalpha() for c in w):
            continue
        if all(c.isalpha() and c not in _ODD for c in w):
            if w.islower():
                out.add(w)
            elif w[0].isupper() and w[1:].islower():
                if opening is None:
                    opening = set(_OPENING.findall(text))
                if w in opening:
                    out.add(w)
        elif sum(c.isalpha() for c in w) >= 2 and all(c.isalpha() or c in _ODD for c in w) and (w[0].islower() or w[1:].islower()):
            out.add(w)
    return out


def _without_halves(text: str) -> str:
    """Split words joined, so that their halves are not taken for misreadings."""
    return re.sub(rf"(?<=[^\W\d_])[{_SIGNS}][ \t]*(?:\r\n|\r|\n)[ \t]*(?=[^\W\d_])", "", text)


def _marks(words, model: LineModel):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary = load_shared(words)
        known = set(vocabulary.counts)
        known |= {w[0].upper() + w[1:] for w in known}
        for b in batches:
            rows, titles, asked = [], [], []
            halves: list[tuple] = []
            for u, d, p, k, t in zip(b["_uid"], b["_doc"], b["_page"], b["_kind"], b["_text"]):
                page = None if p is None or p != p else int(p)
                table = k == "table" or bool(_TABLE.search(t))
                if "\n" in t or "\r" in t:
                    ls = lines_of(t)
                    widest = max(len(x.strip()) for x in ls)
                    for i, j, x, y, sign, between in split_candidates(ls, page, table):
                        halves.append(((x, y, sign), (u, d, "hyphen", "\x1f".join(sorted(set(between))), f"{i}:{j}", None)))
                    for i, x in enumerate(ls):
                        if not x.strip():
                            continue
                        if is_folio(x, page, table):
                            rows.append((u, d, "folio", None, None, None))
                            continue
                        title = title_of(x)
                        if title and not table:
                            asked.append((ls, i, widest))
                            titles.append((u, d, "numbered" if title[1] else "title", title_key(title[0]), surroundings(ls, i)))
                    t = _without_halves(t)
                rows += [(u, d, "token", w, None, None) for w in odd_tokens(t, known)]
            vocabulary.joiner.judge({key for key, _ in halves}, vocabulary.joined)
            rows += [row for key, row in halves if vocabulary.joiner.known[key]]
            rows += [(*t, float(s)) for t, s in zip(titles, model.score(asked))]
            yield pd.DataFrame(rows, columns=["_uid", "_doc", "mark", "key", "around", "score"])

    return run


def _readings(words):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = load_shared(words)
        for b in batches:
            read = m.read([(w if w[0].islower() or not w[0].isalpha() else w.lower(), int(n)) for w, n in zip(b["key"], b["n"])])
            yield pd.DataFrame([(w, r) for w, r in zip(b["key"], read) if r], columns=["key", "word"])

    return run


class Scans:
    """``found`` (id, kind): kind is hyphen, glyph, header or folio, one row per id and kind.
    ``repaired()`` (id, text): the texts with all of that put right and lines joined to paragraphs.

    Null ids and texts are left out; rows without a document form one; rows repeated with the same id and text count once. An empty table gives empty results. Besides id and text,
    ``document_id``, ``page_no``, and ``level`` are read if present; other columns are ignored.
    """

    def __init__(self, df: DataFrame, id_col: str = "chunk_uid", text_col: str = "text", doc_col: str = "document_id", page_col: str = "page_no", level_col: str = "level"):
        spark, self.id_col = df.sparkSession, id_col
        has = lambda c, kind: (F.col(c).cast(kind) if c in df.columns else F.lit(None).cast(kind))
        self.src = df.select(F.col(id_col).cast("string").alias("_uid"), F.coalesce(has(doc_col, "string"), F.lit("")).alias("_doc"), has(page_col, "int").alias("_page"), F.lower(has(level_col, "string")).alias("_kind"), F.col(text_col).alias("_text")).where("_uid is not null and _text is not null")
        counts = materialize(self.src.select("_text").mapInPandas(_count_words, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")), "scan-words")
        total = counts.agg(F.sum("n")).first()[0] or 0
        common = counts.where(F.col("n") >= max(LEAST_COUNT, COMMON_SHARE * total)).toPandas()
        self.words = WordModel(dict(zip(common["word"], common["n"].astype(int))), total)
        words = share(spark, self.words)
        multi = self.src.where((F.length("_text") < LONGEST) & F.col("_text").rlike("[\r\n]") & ~F.col("_text").rlike(r"(?m)^\s*\|.*\|\s*$"))
        # documents whose hash lets a little more than SAMPLE chunks pass; no task sends the driver more than its share of them
        n = multi.count()
        drawn = multi.where(F.pmod(F.xxhash64("_doc"), F.lit(1_000_003)) / 1_000_003 * max(1, n) < 1.5 * SAMPLE) if n > 2 * SAMPLE else multi
        sample = drawn.select("_doc", "_page", "_text", "_uid").orderBy(F.xxhash64("_doc"), "_doc", "_uid", "_text").limit(SAMPLE).toPandas()
        self.line_model = LineModel(sample.astype({"_page": object}))
        marks = self.src.mapInPandas(_marks(words, self.line_model), "_uid string, _doc string, mark string, key string, around string, score double")
        self.marks = materialize(marks.distinct(), "scan-marks")
        titles = self.marks.where("mark in ('title', 'numbered')")
        whole = titles.groupBy("_doc").agg(F.count(F.lit(1)).alias("_all"))
        seen = titles.groupBy("_doc", "key").agg(F.countDistinct("around").alias("_n"), F.count(F.lit(1)).alias("_u"), F.max("score").alias("_s"), F.max(F.when(F.col("mark") == "numbered", 1).otherwise(0)).alias("_e"))
        heads = seen.join(whole, "_doc").where((F.col("_s") > 0.5) | ((F.col("_n") >= 2) & (F.col("_s") > 0.1)) | ((F.col("_n") >= 3) & (F.col("_u") >= SHARE * F.col("_all"))))
        self.heads = titles.join(heads.select("_doc", "key"), ["_doc", "key"]).select("_uid", "key", "mark").distinct()
        # few bytes but much work: spread by number, not by size
        parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
        tokens = self.marks.where("mark = 'token'").select("_uid", "key")
        self.readings = materialize(tokens.groupBy("key").agg(F.count(F.lit(1)).alias("n")).repartition(parts, F.xxhash64("key")).mapInPandas(_readings(words), "key string, word string"), "scan-readings")
        self.misread = tokens.join(self.readings, "key")
        # halves meet over furniture only: every title between them must be a running header
        split = self.marks.where("mark = 'hyphen'").select("_uid", "_doc", "around", "key")
        over = split.where("key <> ''").select("_uid", "_doc", "around", F.explode(F.split("key", "\x1f")).alias("key")).join(heads.select("_doc", "key", F.lit(True).alias("_is")), ["_doc", "key"], "left")
        over = over.groupBy("_uid", "around").agg(F.every(F.coalesce("_is", F.lit(False))).alias("_all")).where("_all").select("_uid", "around")
        self.joins = split.where("key = ''").select("_uid", "around").unionByName(over)
        kinds = self.marks.where("mark = 'folio'").select("_uid", F.col("mark").alias("kind")).unionByName(self.joins.select("_uid", F.lit("hyphen").alias("kind")))
        kinds = kinds.unionByName(self.heads.select("_uid", F.lit("header").alias("kind"))).unionByName(self.heads.where("mark = 'numbered'").select("_uid", F.lit("folio").alias("kind")))
        self.found = kinds.unionByName(self.misread.select("_uid", F.lit("glyph").alias("kind"))).distinct().withColumnRenamed("_uid", id_col)

    def repaired(self) -> DataFrame:
        heads = self.heads.groupBy("_uid").agg(F.collect_set("key").alias("_heads"))
        words = self.misread.groupBy("_uid").agg(F.map_from_entries(F.collect_set(F.struct("key", "word"))).alias("_readings"))
        joins = self.joins.groupBy("_uid").agg(F.collect_set("around").alias("_joins"))
        texts = self.src.groupBy("_uid", "_text").agg(F.min("_page").alias("_page"), F.min("_kind").alias("_kind"))
        return texts.join(heads, "_uid", "left").join(words, "_uid", "left").join(joins, "_uid", "left").select("_uid", "_text", "_page", "_kind", "_heads", F.map_entries("_readings").alias("_readings"), "_joins").mapInPandas(_repair, "_uid string, text string").withColumnRenamed("_uid", self.id_col)


def repair_text(text: str, heads: set[str], readings: dict[str, str], page: int | None, table: bool, joined: set[tuple[int, int]]) -> str:
    """The text without furniture, split words joined (by their lines), misreadings replaced, lines of a paragraph on one line."""

    # all at once, so that the work is linear and no replacement is replaced again
    seen = re.compile(rf"(?<![^\W_])(?:{'|'.join(re.escape(w) for w in sorted(readings, key=len, reverse=True))})(?![^\W_])") if readings else None

    def meant(m: re.Match) -> str:
        w = readings[m[0]]
        return w[0].upper() + w[1:] if m[0][0].isupper() else w

    def read(t: str) -> str:
        return seen.sub(meant, t) if seen else t

    if table or not _LINES.search(text):
        return read(text)
    ls = lines_of(text)
    gone = {i for i, x in enumerate(ls) if is_folio(x, page, table) or ((t := title_of(x)) and title_key(t[0]) in heads)}
    joins = {i for i, j in joined if j < len(ls) and _HYPHEN_END.search(ls[i])}
    out, glue = [""], False
    for i, x in enumerate(ls):
        if i in gone:
            continue
        y = x.strip()
        if not y:
            # a blank line next to furniture is the page's, not the text's
            if not ({i - 1, i + 1} & gone) and out[-1]:
                out.append("")
            continue
        out[-1] += y if glue or not out[-1] else " " + y
        glue = False
        if i in joins:
            out[-1] = re.sub(rf"[{_SIGNS}]$", "", out[-1])
            glue = True
    return read("\n\n".join(p for p in out if p))


def _repair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for t, p, k, h, r, j in zip(b["_text"], b["_page"], b["_kind"], b["_heads"], b["_readings"], b["_joins"]):
            page = None if p is None or p != p else int(p)
            pairs = {tuple(map(int, x.split(":"))) for x in j} if j is not None else set()
            out.append(repair_text(t, set(h) if h is not None else set(), {e["key"]: e["value"] for e in r} if r is not None else {}, page, k == "table" or bool(_TABLE.search(t)), pairs))
        yield pd.DataFrame({"_uid": b["_uid"], "text": out})
