"""Test items that leaked, fully or in part, into a corpus: containment search by MinHash in size partitions.

An item leaks if SPAN consecutive words of it (all words of a shorter item) stand in a text as consecutive words.
Every such span is searched as a set of shingles. The partition of a span is its number of words; in it the
MinHash of a text's window of that many words is compared with the span's. Equal windows have equal MinHashes, so a
search over all windows misses nothing; neighbouring windows mostly share theirs, so a text yields about two
for every window length. Candidates are then verified: the longest shared run of words, by the item's suffix automaton in one
pass over the text, and the exact share of the item's shingles that the text contains.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

SPAN, SHINGLE = 12, 5
#: The signatures of the items are broadcast up to this many rows of 16 bytes; beyond, they are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Candidates of a text that are verified beside one copy of it.
ITEM_TILE = 1000
_WORDS = re.compile(r"[^\W_]+")
_MUL = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    """Maximal runs of letters and digits, in lower case."""
    return [w.lower() for w in _WORDS.findall(text)] if text else []


def _hashes(words: list[str], known: dict[str, int]) -> np.ndarray:
    import xxhash

    if len(known) > 500_000:
        known.clear()
    out = np.empty(len(words), dtype=np.uint64)
    for i, w in enumerate(words):
        h = known.get(w)
        if h is None:
            h = known[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        out[i] = h
    return out


def window_minima(h: np.ndarray, size: int) -> np.ndarray:
    """The MinHash of each window of ``size`` words, over its shingles of at most SHINGLE words, as signed 64 bits."""
    k = min(SHINGLE, size)
    if len(h) < size:
        return np.empty(0, dtype=np.int64)
    s = np.zeros(len(h) - k + 1, dtype=np.uint64)
    for j in range(k):
        s = (s * np.uint64(0x100000001B3)) ^ (h[j : len(h) - k + 1 + j] * _MUL)
        s ^= s >> np.uint64(31)
    s *= np.uint64(0xBF58476D1CE4E5B9)
    s ^= s >> np.uint64(29)
    return np.lib.stride_tricks.sliding_window_view(s, size - k + 1).min(axis=1).view(np.int64)


def _signatures(sizes: list[int] | None):
    """Rows (id, size, minimum). Without sizes: of items, each in the partition of its own size."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = {}
        for b in batches:
            ids, kinds, minima = [], [], []
            for i, t in zip(b["_id"], b["_text"]):
                w = words_of(t)
                h = _hashes(w, known)
                for size in sizes if sizes is not None else [min(SPAN, len(w))] * bool(w):
                    m = np.unique(window_minima(h, size))
                    ids.append(np.repeat(i, len(m)))
                    kinds.append(np.full(len(m), size, dtype=np.int32))
                    minima.append(m)
            empty = not ids
            yield pd.DataFrame({"_id": [] if empty else np.concatenate(ids), "_size": np.array([], dtype=np.int32) if empty else np.concatenate(kinds), "_min": np.array([], dtype=np.int64) if empty else np.concatenate(minima)})

    return run


class ItemRuns:
    """The item's words as a suffix automaton: the longest run it shares with a text takes one pass over the text."""

    def __init__(self, words: list[str]):
        self.n = len(words)
        self.step: list[dict[str, int]] = [{}]
        self.back, self.length = [-1], [0]
        last = 0
        for w in words:
            new = self._state(self.length[last] + 1, {})
            at = last
            while at >= 0 and w not in self.step[at]:
                self.step[at][w] = new
                at = self.back[at]
            if at < 0:
                self.back[new] = 0
            else:
                to = self.step[at][w]
                if self.length[to] == self.length[at] + 1:
                    self.back[new] = to
                else:
                    copy = self._state(self.length[at] + 1, dict(self.step[to]))
                    self.back[copy] = self.back[to]
                    while at >= 0 and self.step[at].get(w) == to:
                        self.step[at][w] = copy
                        at = self.back[at]
                    self.back[to] = self.back[new] = copy
            last = new

    def _state(self, length: int, step: dict[str, int]) -> int:
        self.step.append(step)
        self.back.append(0)
        self.length.append(length)
        return len(self.step) - 1

    def longest_in(self, text_words: list[str]) -> int:
        at = run = best = 0
        for w in text_words:
            while at and w not in self.step[at]:
                at = self.back[at]
                run = self.length[at]
            to = self.step[at].get(w)
            if to is None:
                at = run = 0
            else:
                at, run = to, run + 1
                best = max(best, run)
        return best


def contains_span(text_words: list[str], item_words: list[str], span: int = SPAN) -> int:
    """The longest run of the item's words found in the text's if it is long enough to count, else 0."""
    if not item_words or not text_words:
        return 0
    n = ItemRuns(item_words).longest_in(text_words)
    return n if n >= min(span, len(item_words)) else 0


def shingle_share(text_shingles: set, item_words: list[str]) -> float:
    """The share of the item's shingles that stand in the text."""
    own = _shingle_set(item_words, min(SHINGLE, len(item_words)))
    return len(own & text_shingles) / len(own) if own else 0.0


def _shingle_set(words: list[str], k: int) -> set:
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if k else set()


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by document and tile, the text (kind 0) before the items it may hold: a text is taken apart once a tile."""
    key, words, sets = None, [], {}
    runs: dict[str, tuple[list[str], ItemRuns]] = {}
    for b in batches:
        ids, items, n, share = [], [], [], []
        for i, tile, kind, item, text in zip(b["_id"], b["_tile"], b["_kind"], b["_item"], b["_text"]):
            if kind == 0:
                key, words, sets = (i, tile), words_of(text), {}
                continue
            if key != (i, tile):
                continue
            if text not in runs:
                if len(runs) >= 4096:
                    runs.clear()
                own = words_of(text)
                runs[text] = own, ItemRuns(own)
            own, runner = runs[text]
            found = runner.longest_in(words)
            if found < min(SPAN, len(own)):
                continue
            k = min(SHINGLE, len(own))
            if k not in sets:
                sets[k] = _shingle_set(words, k)
            ids.append(i)
            items.append(item)
            n.append(found)
            share.append(round(shingle_share(sets[k], own), 6))
        if ids:
            yield pd.DataFrame({"_id": ids, "_item": items, "n_words": np.array(n, dtype=np.int32), "containment": share})


def find_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Rows (doc_id, item_id, n_words, containment): n_words is the longest run of the item's words in the document,
    containment the share of the item's shingles that stand in it.

    Null or wordless texts and items leak nothing; rows with a null id are left out; repeated rows count once; of an id with
    several texts the best counts. Only the two named columns of each table are read, so clashing names elsewhere do no harm.
    A text goes to verification once for every ITEM_TILE candidates it has, never once a candidate.
    """
    d = docs.select(F.col(doc_id).alias("_key"), F.col(doc_text).alias("_text")).where(F.col("_key").isNotNull() & F.col("_text").isNotNull())
    # rows of one id may hold several texts
    d = d.select(F.md5(F.concat_ws("\x1f", F.col("_key").cast("string"), "_text")).alias("_id"), "_key", "_text")
    q = items.select(F.col(item_id).alias("_item"), F.col(item_text).alias("_item_text")).where(F.col("_item").isNotNull() & F.col("_item_text").isNotNull())
    item_kind = q.schema["_item"].dataType.simpleString()
    sig = q.select(F.col("_item").alias("_id"), F.col("_item_text").alias("_text")).mapInPandas(_signatures(None), f"_id {item_kind}, _size int, _min bigint")
    sig = materialize(sig.withColumnRenamed("_id", "_item").distinct(), "leak-signatures")
    by_size = {r["_size"]: r["n"] for r in sig.groupBy("_size").agg(F.count(F.lit(1)).alias("n")).collect()}
    small = sum(by_size.values()) <= broadcast_rows
    mins = d.select("_id", "_text").mapInPandas(_signatures(sorted(by_size)), "_id string, _size int, _min bigint")
    found = materialize(mins.join(F.broadcast(sig) if small else sig, ["_size", "_min"]).select("_id", "_item").distinct(), "leak-candidates")
    tiles = found.groupBy("_id").agg(F.count(F.lit(1)).alias("_n")).select("_id", F.ceil(F.col("_n") / ITEM_TILE).cast("int").alias("_n"))
    asked = found.join(tiles, "_id").select("_id", F.pmod(F.xxhash64("_item"), "_n").cast("int").alias("_tile"), "_item")
    texts = d.dropDuplicates(["_id"]).join(tiles, "_id").select("_id", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_tile"), F.lit(0).alias("_kind"), F.lit(None).cast(item_kind).alias("_item"), "_text")
    both = texts.unionByName(asked.join(q, "_item").select("_id", "_tile", F.lit(1).alias("_kind"), "_item", F.col("_item_text").alias("_text")))
    both = both.repartition("_id", "_tile").sortWithinPartitions("_id", "_tile", "_kind")
    seen = both.mapInPandas(_verify, f"_id string, _item {item_kind}, n_words int, containment double")
    keys = d.select("_id", "_key").distinct()
    out = seen.join(keys, "_id").groupBy("_key", "_item").agg(F.max("n_words").alias("n_words"), F.max("containment").alias("containment"))
    return out.withColumnsRenamed({"_key": doc_id, "_item": item_id})
