"""The k most similar vectors of every vector: inverted lists, product-quantised residuals, exact reranking.

Vectors of one direction form a class and are searched once; a class keeps its k + 1 smallest ids, more can
never be among anybody's k nearest. Coarse centroids and codebooks are fitted on a bounded sample (SAMPLE rows,
those with the smallest hashes of their ids); every row is indexed. Each class asks the lists of its PROBES nearest
centroids. In a list, tables of products between the parts of the query and the codebooks score all codes; the best
RERANK are scored by their vectors, and the best of all lists again in double precision.
A list of more than SPLIT rows is divided again, by centroids of its own that are fitted on a sample of it, and queries visit the SUB_PROBES
nearest parts; so lists stay short however many rows there are. Parts of more than TILE rows are cut, and so are the queries of a part beyond QUERY_TILE.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

SAMPLE, LIST_ROWS, MOST_LISTS, PROBES, PARTS, RERANK, SLACK, TILE, QUERY_TILE = 32_768, 200, 4096, 6, 8, 256, 0.25, 16_384, 65_536
#: Rows from which a list is divided again, and the parts of such a list that a query visits.
SPLIT, SUB_PROBES = 4096, 16


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Centroids by Lloyd's rounds; an empty one moves to a row picked at random."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = nearest(x, c, 1)[:, 0]
        n = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        order = np.argsort(near, kind="stable")
        starts = np.concatenate(([0], np.cumsum(n)))[:-1]
        full = n > 0
        total[full] = np.add.reduceat(x[order], starts[full], axis=0)
        c[full] = total[full] / n[full, None]
        c[~full] = x[rng.choice(len(x), int((~full).sum()))]
    return c


def nearest(x: np.ndarray, c: np.ndarray, k: int) -> np.ndarray:
    """The k nearest centroids of each row, the nearest first."""
    half = (c * c).sum(1) / 2
    out = np.empty((len(x), k), dtype=np.int32)
    step = max(1, 4_000_000 // len(c))
    for i in range(0, len(x), step):
        s = x[i : i + step] @ c.T - half
        if k == 1:
            out[i : i + step, 0] = s.argmax(1)
        else:
            top = np.argpartition(-s, k - 1, axis=1)[:, :k] if k < len(c) else np.tile(np.arange(len(c)), (len(s), 1))
            out[i : i + step] = np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, 1), axis=1), 1)
    return out


def fit(x: np.ndarray, lists: int, parts: int = PARTS) -> tuple[np.ndarray, np.ndarray]:
    """Coarse centroids and, of each part of the residuals, up to 256 codewords."""
    x = x.astype(np.float32)
    c = kmeans(x, lists, 8, 1)
    res = x - c[nearest(x, c, 1)[:, 0]]
    width = -(-x.shape[1] // parts)
    res = np.pad(res, ((0, 0), (0, width * parts - x.shape[1])))
    words = min(256, len(x))
    return c, np.stack([kmeans(np.ascontiguousarray(res[:, p * width : (p + 1) * width]), words, 5, 2 + p) for p in range(parts)])


def encode(res: np.ndarray, books: np.ndarray) -> np.ndarray:
    parts, _, width = books.shape
    res = np.pad(res, ((0, 0), (0, width * parts - res.shape[1])))
    return np.stack([nearest(np.ascontiguousarray(res[:, p * width : (p + 1) * width]), books[p], 1)[:, 0] for p in range(parts)], 1).astype(np.uint8)


def _unit_rows(dim: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        for b in batches:
            uid, vec, key = [], [], []
            for u, e in zip(b["_uid"], b["_vec"]):
                if e is None or len(e) != dim:
                    continue
                v = np.array([np.nan if x is None else x for x in e] if getattr(e, "dtype", None) == object else e, dtype=np.float64)
                top = np.abs(v).max()
                if not np.isfinite(top) or top == 0:
                    continue
                v = v / top
                v /= np.sqrt(v @ v)
                uid.append(u)
                vec.append(v.tobytes())
                key.append(hashlib.blake2b((np.round(v, 12) + 0.0).tobytes(), digest_size=16).digest())
            yield pd.DataFrame({"_uid": uid, "_vec": vec, "_dir": key})

    return run


def _assign(c: np.ndarray, books: np.ndarray, probes: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            x = np.frombuffer(b"".join(b["_vec"]), dtype=np.float64).reshape(len(b), -1).astype(np.float32)
            lists = nearest(x, c, probes)
            codes = encode(x - c[lists[:, 0]], books)
            yield pd.DataFrame({"_dir": b["_dir"], "_lists": list(lists), "_code": [r.tobytes() for r in codes], "_short": [r.tobytes() for r in x]})

    return run


def _fit_parts(list_rows: int):
    def run(key, b):
        x = np.frombuffer(b"".join(b["_short"]), dtype=np.float32).reshape(len(b), -1)
        c = kmeans(x, int(max(1, min(len(x) // 8, -(-int(b["_held"].iloc[0]) // list_rows)))), 8, 3)
        return pd.DataFrame({"_list": np.full(len(c), key[0], dtype=np.int32), "_sub": np.arange(len(c), dtype=np.int32), "_short": [r.tobytes() for r in c]})

    return run


def _place_parts(probes: int):
    """Rows sorted by list and slice, the centroids of the list's parts (kind -1) first; index rows go to the nearest part, queries to several."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, subs, cents, ready = None, [], [], None
        for b in batches:
            if not len(b):
                continue
            out = []
            where, kinds = list(zip(b["_list"], b["_slice"])), b["_kind"].to_numpy()
            edges = [0, *(i for i in range(1, len(b)) if where[i] != where[i - 1] or kinds[i] != kinds[i - 1]), len(b)]
            for s, e in zip(edges, edges[1:]):
                x = np.frombuffer(b"".join(b["_short"].iloc[s:e]), dtype=np.float32).reshape(e - s, -1)
                if where[s] != at:
                    at, subs, cents, ready = where[s], [], [], None
                if kinds[s] < 0:
                    subs.append(b["_sub"].to_numpy()[s:e])
                    cents.append(x)
                    continue
                if ready is None:
                    ready = np.concatenate(subs), np.concatenate(cents)
                near = ready[0][nearest(x, ready[1], 1 if kinds[s] == 0 else min(probes, len(ready[1])))]
                out.append(b.iloc[s:e][["_dir", "_list", "_kind", "_code", "_short"]].assign(_subs=list(near.astype(np.int32))))
            if out:
                yield pd.concat(out)

    return run


def divided(rows: DataFrame, held: DataFrame, split: int, list_rows: int, sub_probes: int) -> DataFrame:
    """(_dir, _list, _sub, _kind, _code, _short): index rows (kind 0) and queries (kind 1) with the parts of their lists. Lists of at most ``split`` rows are one part."""
    large = held.where(F.col("_held") > split)
    h = F.pmod(F.xxhash64("_dir"), F.lit(1_000_003))
    marked = rows.join(F.broadcast(large), "_list", "left")
    sample = marked.where((F.col("_kind") == 0) & (h / 1_000_003 * F.col("_held") < SAMPLE))
    shape = "_list int, _sub int, _short binary"
    parts = materialize(sample.select("_list", "_held", "_short").groupBy("_list").applyInPandas(_fit_parts(list_rows), shape), "knn-parts")
    slices = F.ceil(F.col("_held") / TILE).cast("int")
    big = marked.where("_held is not null").select("_dir", "_list", F.pmod(h, slices).cast("int").alias("_slice"), "_kind", F.lit(None).cast("int").alias("_sub"), "_code", "_short")
    cents = parts.join(F.broadcast(large), "_list").select(F.lit(None).cast("binary").alias("_dir"), "_list", F.explode(F.sequence(F.lit(0), slices - 1)).alias("_slice"), F.lit(-1).alias("_kind"), "_sub", F.lit(None).cast("binary").alias("_code"), "_short")
    both = big.unionByName(cents).repartition("_list", "_slice").sortWithinPartitions("_list", "_slice", "_kind")
    placed = both.mapInPandas(_place_parts(sub_probes), "_dir binary, _list int, _kind int, _code binary, _short binary, _subs array<int>")
    placed = placed.select("_dir", "_list", F.explode("_subs").alias("_sub"), "_kind", "_code", "_short")
    return marked.where("_held is null").select("_dir", "_list", F.lit(0).alias("_sub"), "_kind", "_code", "_short").unionByName(placed)


def _scan(c: np.ndarray, books: np.ndarray, k: int, rerank: int, least: float | None):
    """Rows sorted by tile, index rows first: the tile's codes are kept, its queries stream past them."""
    parts, words, width = books.shape

    def score(at: int, ids: np.ndarray, codes: np.ndarray, x: np.ndarray, qid: np.ndarray, q: np.ndarray):
        n, keep = len(ids), min(rerank, len(ids))
        out = []
        step = max(1, 1_500_000 // n)
        for i in range(0, len(q), step):
            qq, own = q[i : i + step], qid[i : i + step]
            padded = np.pad(qq, ((0, 0), (0, parts * width - qq.shape[1])))
            approx = np.repeat((qq @ c[at])[:, None], n, 1)
            for p in range(parts):
                table = padded[:, p * width : (p + 1) * width] @ books[p].T
                approx += table[:, codes[:, p]]
            if least is not None:
                # far from the wanted cosine nothing needs its vector; the table's error is far below SLACK
                approx[approx < least - SLACK] = -np.inf
            if keep < n:
                full = np.flatnonzero((approx > -np.inf).sum(1) > keep)
                floor = np.partition(approx[full], n - keep, axis=1)[:, n - keep : n - keep + 1]
                approx[full] = np.where(approx[full] < floor, -np.inf, approx[full])
            rows, cols = np.nonzero(approx > -np.inf)
            exact = np.einsum("ij,ij->i", x[cols], qq[rows])
            good = ids[cols] != own[rows]
            if least is not None:
                good &= exact > least - 1e-5
            rows, cols, exact = rows[good], cols[good], exact[good]
            order = np.lexsort((-exact, rows))
            rows, cols, exact = rows[order], cols[order], exact[order]
            starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else np.empty(0, dtype=np.int64)
            rank = np.arange(len(rows)) - np.repeat(starts, np.diff(np.r_[starts, len(rows)]))
            top = rank < 2 * k
            out.append((own[rows[top]], ids[cols[top]], exact[top]))
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tile, index = None, []
        ready = None
        for b in batches:
            if not len(b):
                continue
            found = []
            keys = b["_tile"].to_numpy()
            lists, kinds = b["_list"].to_numpy(), b["_kind"].to_numpy()
            ids = b["_dir"].to_numpy(dtype=object)
            edges = np.flatnonzero((keys[1:] != keys[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for s, e in zip([0, *edges], [*edges, len(b)]):
                if keys[s] != tile:
                    tile, index, ready = keys[s], [], None
                v = np.frombuffer(b"".join(b["_short"].iloc[s:e]), dtype=np.float32).reshape(e - s, -1)
                if kinds[s] == 0:
                    index.append((ids[s:e], np.frombuffer(b"".join(b["_code"].iloc[s:e]), dtype=np.uint8).reshape(e - s, -1), v))
                elif index:
                    if ready is None:
                        ready = tuple(np.concatenate(z) for z in zip(*index))
                    found += score(lists[s], *ready, ids[s:e], v)
            if found:
                yield pd.DataFrame({"_q": np.concatenate([f[0] for f in found]), "_x": np.concatenate([f[1] for f in found]), "_s": np.concatenate([f[2] for f in found]).astype(np.float32)})

    return run


def _exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        if len(b):
            q, x = (np.frombuffer(b"".join(b[n]), dtype=np.float64).reshape(len(b), -1) for n in ("_qv", "_xv"))
            yield pd.DataFrame({"_q": b["_q"], "_x": b["_x"], "_cos": np.round(np.einsum("ij,ij->i", q, x), 9)})


def knn(df: DataFrame, id_col: str = "chunk_uid", vector_col: str = "embedding", k: int = 10, dim: int = 64, least: float | None = None, probes: int = PROBES, rerank: int = RERANK, list_rows: int = LIST_ROWS, split: int = SPLIT, sub_probes: int = SUB_PROBES, queries: DataFrame | None = None) -> DataFrame:
    """Rows (id, neighbour, cosine): of every id, or of those in ``queries``, its k most similar others, equal cosines going to the smaller id.

    Vectors of another length than ``dim``, with nulls, NaN or infinities, or all zero are left out, as are null
    ids; an id counts once, with the smallest of its vectors. The cosine is rounded to 9 decimals. With ``least``,
    only neighbours of at least that cosine are kept. All rows are searched whatever the queries. An empty table gives an empty result.
    """
    spark = df.sparkSession
    src = df.select(F.col(id_col).cast("string").alias("_uid"), F.col(vector_col).cast("array<double>").alias("_vec")).where(F.col("_uid").isNotNull() & (F.size("_vec") == dim))
    rows = src.mapInPandas(_unit_rows(dim), "_uid string, _vec binary, _dir binary").groupBy("_uid").agg(F.min(F.struct("_dir", "_vec")).alias("_m"))
    rows = materialize(rows.select("_uid", F.col("_m._dir").alias("_dir"), F.col("_m._vec").alias("_vec")), "knn-rows")
    # the limit of the window is applied on the map side too, so copies of one vector do not meet in one task
    firsts = rows.withColumn("_r", F.row_number().over(Window.partitionBy("_dir").orderBy("_uid"))).where(F.col("_r") <= k + 1)
    classes = materialize(firsts.groupBy("_dir").agg(F.sort_array(F.collect_list("_uid")).alias("_members"), F.min_by("_vec", "_r").alias("_vec")), "knn-classes")
    n = classes.count()
    # a little more than SAMPLE rows pass the hash, wherever they lie; of these the first by hash
    h = F.pmod(F.xxhash64("_dir"), F.lit(1_000_003))
    drawn = classes.where(h / 1_000_003 * max(1, n) < 1.1 * SAMPLE)
    sample = drawn.select("_dir", "_vec").orderBy(F.xxhash64("_dir"), "_dir").limit(SAMPLE).toPandas()
    own = rows.join(classes.where(F.size("_members") > 1).select("_dir", "_members"), "_dir")
    own = own.select("_uid", F.explode(F.slice(F.filter("_members", lambda m: m != F.col("_uid")), 1, k)).alias("_other"), F.lit(1.0).alias("_cos"))
    if len(sample) < 2:
        out = own
    else:
        x = np.frombuffer(b"".join(sample["_vec"]), dtype=np.float64).reshape(len(sample), -1)
        lists = int(min(max(1, n // list_rows), MOST_LISTS, max(1, len(x) // 8)))
        c, books = fit(x, lists)
        placed = materialize(classes.select("_dir", "_vec").mapInPandas(_assign(c, books, min(probes, lists)), "_dir binary, _lists array<int>, _code binary, _short binary"), "knn-placed")
        held = placed.groupBy(F.col("_lists")[0].alias("_list")).agg(F.count(F.lit(1)).alias("_held"))
        index = placed.select("_dir", F.col("_lists")[0].alias("_list"), F.lit(0).alias("_kind"), "_code", "_short")
        asks = placed.select("_dir", F.explode("_lists").alias("_list"), F.lit(1).alias("_kind"), F.lit(None).cast("binary").alias("_code"), "_short")
        if queries is not None:
            # only classes with an asking member ask
            mine = rows.join(queries.select(F.col(id_col).cast("string").alias("_uid")).distinct(), "_uid", "left_semi").select("_dir").distinct()
            asks = asks.join(mine, "_dir", "left_semi")
        every = index.unionByName(asks)
        largest = held.agg(F.max("_held")).first()[0]
        if largest > split:
            every = materialize(divided(every, held, split, list_rows, sub_probes), "knn-divided")
        else:
            every = every.withColumn("_sub", F.lit(0))
        sizes = every.groupBy("_list", "_sub").agg(F.ceil(F.count_if(F.col("_kind") == 0) / TILE).cast("int").alias("_ni"), F.greatest(F.ceil(F.count_if(F.col("_kind") == 1) / QUERY_TILE).cast("int"), F.lit(1)).alias("_nq")).where("_ni > 0")
        few = largest <= split
        sizes = spark.createDataFrame(sizes.collect(), sizes.schema) if few else sizes  # one row a list, at most MOST_LISTS
        sized = every.join(F.broadcast(sizes) if few else sizes, ["_list", "_sub"])
        tile = F.concat_ws("/", "_list", "_sub", "_i", "_j")
        rowed = sized.where("_kind = 0").withColumn("_i", F.pmod(h, "_ni")).withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_nq") - 1)))
        asked = sized.where("_kind = 1").withColumn("_j", F.pmod(h, "_nq")).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_ni") - 1)))
        shape = ("_list", "_kind", "_dir", "_code", "_short")
        both = rowed.select(tile.alias("_tile"), *shape).unionByName(asked.select(tile.alias("_tile"), *shape)).repartition("_tile").sortWithinPartitions("_tile", "_kind")
        pairs = both.mapInPandas(_scan(c, books, k, rerank, least), "_q binary, _x binary, _s float")
        pairs = pairs.withColumn("_r", F.row_number().over(Window.partitionBy("_q").orderBy(F.desc("_s"), "_x"))).where(F.col("_r") <= 2 * k).select("_q", "_x")
        vq = classes.select(F.col("_dir").alias("_q"), F.col("_vec").alias("_qv"), F.col("_members").alias("_qm"))
        vx = classes.select(F.col("_dir").alias("_x"), F.col("_vec").alias("_xv"))
        mx = classes.select(F.col("_dir").alias("_x"), F.col("_members").alias("_xm"))
        scored = pairs.join(vq.where(F.size("_qm") <= k).drop("_qm"), "_q").join(vx, "_x").select("_q", "_x", "_qv", "_xv").mapInPandas(_exact, "_q binary, _x binary, _cos double")
        if least is not None:
            scored = scored.where(F.col("_cos") >= least)
        scored = scored.join(mx, "_x").join(vq.select("_q", "_qm"), "_q")
        other = scored.select("_qm", "_xm", "_cos").select(F.explode("_qm").alias("_uid"), F.size("_qm").alias("_n"), "_xm", "_cos").select("_uid", "_n", F.explode("_xm").alias("_other"), "_cos")
        w = Window.partitionBy("_uid").orderBy(F.desc("_cos"), "_other")
        other = other.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k + 1 - F.col("_n"))
        out = own.unionByName(other.select("_uid", "_other", "_cos"))
    if queries is not None:
        out = out.join(queries.select(F.col(id_col).cast("string").alias("_uid")).distinct(), "_uid", "left_semi")
    return out.select(F.col("_uid").alias(id_col), F.col("_other").alias("neighbour"), F.col("_cos").alias("cosine"))


def similar_pairs(df: DataFrame, least: float = 0.8, **kw) -> DataFrame:
    """Unordered pairs (a, b, cosine), a < b, where at least one is among the k most similar of the other."""
    id_col = kw.get("id_col", "chunk_uid")
    n = knn(df, least=least, **kw)
    return n.select(F.least(id_col, "neighbour").alias("a"), F.greatest(id_col, "neighbour").alias("b"), "cosine").groupBy("a", "b").agg(F.max("cosine").alias("cosine"))
