"""Near-duplicate texts by a parity-sketch join.

A text is its set of words. Every word toggles one bit of a sparse sketch of 2^31 bits, so the Hamming distance of two
sketches never exceeds the size of the sets' symmetric difference. A Jaccard similarity of at least t allows a set of n
words at most n - ceil(t n) words of its own, hence few set bits of its own: by the pigeonhole principle two similar sketches share
one of their so many plus one rarest set bits. Those bits, within bands of set sizes, are the join keys; a bit held
by more than HOT texts is no key by itself but only together with another of the (one longer) list. A pair of hot bits that more
than TILE classes share is cut into tiles before the shuffle, and every two tiles meet in a task of their own. Partners are
compared by dense sketches folded to the band's width, whose distance is a lower bound too; what passes is verified on the words.
Equal word sets are one class throughout: links are found between class representatives.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

THRESHOLD, LEAST_WORDS = 0.75, 25
BITS, BUCKETS, HOT, TILE = 31, 20, 4096, 4096
_WORDS = re.compile(r"[^\W_]+")
_MIX, _LOW, _HIGH = np.uint64(0x9E3779B97F4A7C15), np.uint64((1 << 55) - 1), np.uint64(1 << 55)


def word_set(text: str) -> set[str]:
    """Maximal runs of letters and digits, in lower case."""
    return set("\n".join(_WORDS.findall(text)).lower().split("\n")) - {""}


def band_of(n: np.ndarray) -> np.ndarray:
    """Band b > 0 holds sets of 2^(b+5) words and more, band 0 the smaller ones; its sketches have 2^(b+7) bits."""
    return np.maximum(0, np.log2(np.maximum(n, 1)).astype(np.int64) - 5)


def most_own(n: int, t: float) -> int:
    """The most words of a set of n that a set of similarity t or more can lack."""
    f = Fraction(t).limit_denominator(10_000)
    return n - -(-n * f.numerator // f.denominator)


def _sketches(least_words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        known: dict[str, int] = {}
        for b in batches:
            if len(known) > 500_000:
                known.clear()
            uid, key, size, bits = [], [], [], []
            for u, t in zip(b["_uid"], b["_text"]):
                words = _WORDS.findall(t)
                if len(words) < least_words:
                    continue
                words = set("\n".join(words).lower().split("\n"))
                if len(words) < least_words:
                    continue
                own: set[int] = set()
                for w in words:
                    h = known.get(w)
                    if h is None:
                        h = known[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) >> (64 - BITS)
                    if h in own:
                        own.remove(h)
                    else:
                        own.add(h)
                uid.append(u)
                key.append(xxhash.xxh3_128_digest("\n".join(sorted(words)).encode("utf-8", "surrogatepass")))
                size.append(len(words))
                bits.append(np.array(sorted(own), dtype=np.int32))
            yield pd.DataFrame({"_uid": uid, "_set": key, "_n": np.array(size, dtype=np.int32), "_bits": bits})

    return run


def _own_text(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Keeps the texts that are of the class: the representative may have others."""
    import xxhash

    for b in batches:
        ok = [xxhash.xxh3_128_digest("\n".join(sorted(word_set(t))).encode("utf-8", "surrogatepass")) == bytes(s) for t, s in zip(b["_text"], b["_set"])]
        yield b.loc[ok, ["_id", "_set", "_rep", "_text"]]


def _fold(bits: np.ndarray, width: int) -> bytes:
    return np.packbits((np.bincount(bits & (width - 1), minlength=width) & 1).astype(np.uint8)).tobytes()


def _postings(shared, t: float, spare: int, hot: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        often = shared.value
        for b in batches:
            key, ids, size, sketch, guest = [], [], [], [], []
            for i, n, bits in zip(b["_id"], b["_n"], b["_bits"]):
                f = often[bits >> (BITS - BUCKETS)]
                need = most_own(n, t) + spare + 1
                order = np.lexsort((bits, f))[: need + 1]
                bits_, f = bits[order].astype(np.uint64), f[order]
                # only a set with a hot bit among its keys needs the one bit more
                if not (f[:need] > hot).any():
                    bits_, f = bits_[:need], f[:need]
                keys = bits_[(f > 1) & (f <= hot)]
                many = np.sort(bits_[f > hot])
                if len(many) > 1:
                    p, q = np.triu_indices(len(many), 1)
                    both = (many[p] << np.uint64(31) | many[q]) * _MIX
                    keys = np.concatenate((keys, (both ^ (both >> np.uint64(29))) & _LOW | _HIGH))
                if not len(keys):
                    continue
                band = int(band_of(np.array([n]))[0])
                # a set little larger than the band's least size may have partners in the band below, and visits it
                for at in (band, band - 1) if band and n * t <= (1 << (band + 5)) else (band,):
                    key.append(keys | (np.uint64(at) << np.uint64(56)))
                    ids.append(np.full(len(keys), i))
                    size.append(np.full(len(keys), n, dtype=np.int32))
                    sketch += [_fold(bits, 1 << (at + 7))] * len(keys)
                    guest.append(np.full(len(keys), at < band))
            if key:
                yield pd.DataFrame({"_key": np.concatenate(key).view(np.int64), "_id": np.concatenate(ids), "_n": np.concatenate(size), "_guest": np.concatenate(guest), "_sk": sketch})

    return run


def _partners(t: float):
    near = (1 - t) / (1 + t)

    def close(i: np.ndarray, j: np.ndarray, n: np.ndarray, g: np.ndarray, sk: list[np.ndarray]) -> np.ndarray:
        d = np.bitwise_count(sk[0][i] ^ sk[0][j]).astype(np.int16)
        for w in sk[1:]:
            d += np.bitwise_count(w[i] ^ w[j])
        ok = np.flatnonzero(d <= near * (n[i] + n[j]) + 1e-9)
        i, j = i[ok], j[ok]
        ok = (np.minimum(n[i], n[j]) >= t * np.maximum(n[i], n[j]) - 1e-9) & ~(g[i] & g[j])
        return i[ok], j[ok]

    def tiles(rows: np.ndarray, n: np.ndarray, g: np.ndarray, sk: list[np.ndarray]):
        """All pairs of a large group, tile by tile; in order of size, so that partners are a run of rows."""
        rows = rows[np.argsort(n[rows], kind="stable")]
        m = n[rows]
        own = [w[rows] for w in sk]
        for x in range(0, len(rows), 256):
            end = min(len(rows), x + 256)
            last = int(np.searchsorted(m, m[end - 1] / t + 1e-9, side="right"))
            for y in range(x, last, 8192):
                stop = min(last, y + 8192)
                d = np.bitwise_count(own[0][x:end, None] ^ own[0][None, y:stop])
                if len(own) > 1:
                    d = d.astype(np.uint16) if len(own) > 3 else d
                    for w in own[1:]:
                        d += np.bitwise_count(w[x:end, None] ^ w[None, y:stop])
                i, j = np.nonzero(d <= (near * (m[end - 1] + m[y:stop]) + 1e-9).astype(d.dtype)[None, :])
                ok = i + x < j + y
                yield close(rows[i[ok] + x], rows[j[ok] + y], n, g, sk)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def of(b: pd.DataFrame) -> pd.DataFrame | None:
            out = []
            key, bands = b["_key"].to_numpy(), b["_key"].to_numpy() >> 56
            for band in np.unique(bands):
                s, e = np.searchsorted(bands, band), np.searchsorted(bands, band, side="right")
                k, ids, n, g = key[s:e], b["_id"].to_numpy()[s:e], b["_n"].to_numpy()[s:e], b["_guest"].to_numpy()[s:e]
                sk = list(np.ascontiguousarray(np.frombuffer(b"".join(b["_sk"].iloc[s:e]), dtype=np.uint64).reshape(e - s, -1).T))
                edge = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
                runs = np.diff(np.r_[edge, len(k)])
                left = np.repeat(edge + runs, runs) - np.arange(len(k))
                i = np.flatnonzero((left > 1) & (np.repeat(runs, runs) <= 48))
                d = 1
                while len(i):
                    out.append(tuple(ids[x] for x in close(i, i + d, n, g, sk)))
                    d += 1
                    i = i[left[i] > d]
                for a, m in zip(edge[runs > 48], runs[runs > 48]):
                    out += [(ids[i], ids[j]) for i, j in tiles(np.arange(a, a + m), n, g, sk)]
            if out:
                p, q = np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])
                pairs = np.unique(np.stack((np.minimum(p, q), np.maximum(p, q))), axis=1)
                pairs = pairs[:, pairs[0] != pairs[1]]
                if pairs.shape[1]:
                    return pd.DataFrame({"_a": pairs[0], "_b": pairs[1]})
            return None

        parts: list[pd.DataFrame] = []
        for b in batches:
            parts.append(b)
            if sum(map(len, parts)) < 100_000:
                continue
            b = pd.concat(parts, ignore_index=True) if len(parts) > 1 else b
            cut = int(np.searchsorted(b["_key"].to_numpy(), b["_key"].iloc[-1]))
            parts = [b.iloc[cut:]]
            if cut and (found := of(b.iloc[:cut])) is not None:
                yield found
        if parts and (found := of(pd.concat(parts, ignore_index=True))) is not None:
            yield found

    return run


def spread_hot(post: DataFrame, tile: int = TILE) -> DataFrame:
    """The postings with the keys of more than ``tile`` rows split: rows get a tile by their id and meet those of each other tile once.

    Keys of a single bit hold at most HOT rows by construction, so only pairs of bits are counted.
    """
    paired = F.col("_key").bitwiseAND(1 << 55) != 0
    large = post.where(paired).groupBy("_key").agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > tile)
    large = materialize(large.select("_key", F.ceil(F.col("_rows") / tile * 2).cast("int").alias("_tiles")), "neardup-hot")
    if large.isEmpty():
        return post
    hot = post.where(paired).join(large, "_key", "left")
    own = F.pmod(F.xxhash64("_id"), F.col("_tiles")).cast("int")
    split = hot.where("_tiles is not null").withColumn("_t", own).withColumn("_u", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1))).where("_t <> _u")
    # the band stays in the highest bits
    key = F.col("_key").bitwiseAND(~((1 << 56) - 1)).bitwiseOR(F.xxhash64("_key", F.least("_t", "_u"), F.greatest("_t", "_u")).bitwiseAND((1 << 55) - 1)).bitwiseOR(F.lit(1 << 55))
    return post.where(~paired).unionByName(hot.where("_tiles is null").drop("_tiles")).unionByName(split.withColumn("_key", key).drop("_tiles", "_t", "_u"))


def _verify(t: float):
    f = Fraction(t).limit_denominator(10_000)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            both, either = [], []
            for x, y in zip(b["_ta"], b["_tb"]):
                x, y = word_set(x), word_set(y)
                both.append(len(x & y))
                either.append(len(x | y))
            out = pd.DataFrame({"set_a": b["set_a"], "set_b": b["set_b"], "rep_a": b["rep_a"], "rep_b": b["rep_b"], "n_both": np.array(both, dtype=np.int32), "n_either": np.array(either, dtype=np.int32)})
            yield out[out["n_both"].astype(np.int64) * f.denominator >= out["n_either"].astype(np.int64) * f.numerator]

    return run


class NearDuplicates:
    """``members`` (id, rep): every id with enough words and its class, named by the class's smallest id.
    ``links`` (rep_a, rep_b, n_both, n_either): all similar pairs of classes, rep_a < rep_b.

    Null ids and texts, and texts with fewer than ``least_words`` distinct words, are in no class. Rows repeated with the
    same id and text count once; an id with several texts is in several classes. Empty tables give empty results. Only the
    two named columns are read. All similar pairs are found; there is no cap on partners.
    """

    def __init__(self, df: DataFrame, id_col: str = "chunk_uid", text_col: str = "text", threshold: float = THRESHOLD, least_words: int = LEAST_WORDS, hot: int = HOT, tile: int = TILE):
        if not 0 < threshold <= 1:
            raise ValueError("the threshold must be above 0 and at most 1")
        spark, self.id_col = df.sparkSession, id_col
        src = df.select(F.col(id_col).cast("string").alias("_uid"), F.col(text_col).alias("_text")).where(F.col("_uid").isNotNull() & (F.length("_text") >= 2 * least_words - 1))
        rows = src.mapInPandas(_sketches(least_words), "_uid string, _set binary, _n int, _bits array<int>")
        rows = materialize(rows, "neardup-sketches")
        # 64 bits of the set's digest stand for it in the join; should two sets share them, verification tells them apart
        classes = rows.groupBy("_set").agg(F.min("_uid").alias("_rep"), F.first("_n").alias("_n"), F.first("_bits").alias("_bits"))
        number = F.conv(F.hex(F.substring("_set", 1, 7)), 16, 10).cast("bigint")
        classes = materialize(classes.select("_set", "_rep", number.alias("_id"), "_n", "_bits"), "neardup-classes")
        self._rows = rows.select("_uid", "_set").distinct()
        self.members = self._rows.join(classes.select("_set", "_rep"), "_set").select(F.col("_uid").alias(id_col), F.col("_rep").alias("rep")).distinct()
        # the counts have 2^BUCKETS entries whatever the data, 4 MB
        counted = classes.select(F.explode("_bits").alias("x")).groupBy(F.shiftright("x", BITS - BUCKETS).alias("x")).count().toPandas()
        often = np.zeros(1 << BUCKETS, dtype=np.int32)
        often[counted["x"].to_numpy(dtype=np.int64)] = np.minimum(counted["count"].to_numpy(dtype=np.int64), 2**31 - 1)
        lost = classes.agg(F.max(F.col("_n") - F.size("_bits"))).first()[0] or 0
        shared = spark.sparkContext.broadcast(often)
        post = classes.select("_id", "_n", "_bits").mapInPandas(_postings(shared, threshold, lost // 2, hot), "_key bigint, _id bigint, _n int, _guest boolean, _sk binary")
        if int(often.max()) > hot:
            post = spread_hot(materialize(post, "neardup-postings"), tile)
        pairs = post.repartition("_key").sortWithinPartitions("_key").mapInPandas(_partners(threshold), "_a bigint, _b bigint").distinct()
        pairs = materialize(pairs, "neardup-pairs")
        ids = pairs.select(F.col("_a").alias("_id")).union(pairs.select("_b")).distinct()
        wanted = classes.select("_id", "_set", "_rep").join(ids, "_id")
        texts = src.join(wanted, src["_uid"] == wanted["_rep"]).select("_id", "_rep", "_set", "_text").mapInPandas(_own_text, "_id bigint, _set binary, _rep string, _text string")
        texts = materialize(texts.groupBy("_id", "_set", "_rep").agg(F.min("_text").alias("_text")), "neardup-texts")
        a = texts.select(F.col("_id").alias("_a"), F.col("_set").alias("set_a"), F.col("_rep").alias("rep_a"), F.col("_text").alias("_ta"))
        b = texts.select(F.col("_id").alias("_b"), F.col("_set").alias("set_b"), F.col("_rep").alias("rep_b"), F.col("_text").alias("_tb"))
        shape = "set_a binary, set_b binary, rep_a string, rep_b string, n_both int, n_either int"
        found = pairs.join(a, "_a").join(b, "_b").select("set_a", "set_b", "rep_a", "rep_b", "_ta", "_tb").mapInPandas(_verify(threshold), shape)
        self._sets = found.select("set_a", "set_b")
        self.links = found.select(F.least("rep_a", "rep_b").alias("rep_a"), F.greatest("rep_a", "rep_b").alias("rep_b"), "n_both", "n_either")

    def pairs(self) -> DataFrame:
        """(a, b), a < b: all similar pairs of ids, those within a class included."""
        a, b = (self._rows.select(F.col("_uid").alias(x), F.col("_set").alias(f"set_{x}")) for x in "ab")
        across = self._sets.join(a, "set_a").join(b, "set_b").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        within = a.join(b, F.col("set_a") == F.col("set_b")).where("a < b").select("a", "b")
        return across.unionByName(within).distinct()

    def summary(self) -> DataFrame:
        """One row per id: its class and the number of other classes that class is similar to."""
        ends = self.links.select(F.col("rep_a").alias("rep")).unionByName(self.links.select(F.col("rep_b").alias("rep"))).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
        return self.members.join(ends, "rep", "left").select(self.id_col, "rep", F.coalesce("n_links", F.lit(0)).alias("n_links"))
