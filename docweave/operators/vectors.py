"""Vector operators: validity, cosine, exact top-k, per-group similarity statistics and neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one block; a group of more rows is compared block by block, each pair of blocks in its own task.
BLOCK = 2048
#: As many blocks as a group is cut into before its blocks grow.
WIDE = 8
#: As many best columns are picked one after the other; more are sorted for.
FEW = 30


def valid_vector(v: Column, dim: int | None = None) -> Column:
    """Not empty, all finite, not all zero, of the given length; null counts as invalid."""
    ok = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & ~x.isin(float("inf"), float("-inf"))) & F.exists(v, lambda x: x != 0)
    if dim:
        ok = ok & (F.size(v) == dim)
    return F.coalesce(ok, F.lit(False))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null where either vector has no direction or the lengths differ."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (n > 0), dot(a, b) / n)


def usable_points(points: DataFrame, dim: int = 64) -> DataFrame:
    """(chunk_uid, document_id, embedding): visible vectors, one per chunk, of the smallest point_id."""
    seen = points.where("vector_point and graph_control_point is null and graph_tombstoned is not true").where(valid_vector(F.col("embedding"), dim))
    best = seen.groupBy("chunk_uid").agg(F.min_by(F.struct("document_id", "embedding"), "point_id").alias("p"))
    return best.select("chunk_uid", "p.document_id", "p.embedding")


def top_k(vectors: DataFrame, query: list[float], k: int, id_col: str, vector_col: str = "embedding") -> DataFrame:
    """The k rows most similar to one query vector, with score and rank; ties go to the smaller id.

    The sort keeps k rows per partition before anything is exchanged.
    """
    q = F.array(*[F.lit(float(x)) for x in query])
    best = vectors.withColumn("score", cosine(F.col(vector_col).cast("array<double>"), q)).where("score is not null").orderBy(F.desc("score"), id_col).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), id_col)).cast("bigint"))


def _moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        if not len(b):
            continue
        v = np.stack([np.asarray(x, dtype=np.float64) for x in b["_v"]])
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        rows = []
        codes, groups = pd.factorize(b["_g"])
        for g, name in enumerate(groups):
            x = v[codes == g]
            rows.append((name, len(x), x.sum(0).tolist(), (x.T @ x).ravel().tolist()))
        yield pd.DataFrame(rows, columns=["_g", "n", "s", "m"])


def _merge(key, b):
    n = int(b["n"].sum())
    s, m = np.sum(np.stack(b["s"]), axis=0), np.sum(np.stack(b["m"]), axis=0)
    pairs = n * (n - 1) // 2
    if not pairs:
        return pd.DataFrame([(key[0], n, 0, None, None)], columns=["_g", "n", "n_pairs", "mean", "std"])
    mean = (s @ s - n) / 2 / pairs
    square = (m @ m - n) / 2 / pairs
    return pd.DataFrame([(key[0], n, pairs, mean, float(np.sqrt(max(0.0, square - mean * mean))))], columns=["_g", "n", "n_pairs", "mean", "std"])


def pair_statistics(vectors: DataFrame, group_col: str, vector_col: str = "embedding") -> DataFrame:
    """(group, n, n_pairs, mean, std): mean and population deviation of the cosines of all unordered pairs of a group.

    No pair is ever formed: with unit vectors, the sum of all cosines is (|sum v|^2 - n) / 2 and the sum of their squares
    (|sum v v'|^2 - n) / 2, so a partition passes on one vector and one matrix per group, whatever the group's size.
    """
    src = vectors.select(F.col(group_col).cast("string").alias("_g"), F.col(vector_col).cast("array<double>").alias("_v")).where(F.col("_g").isNotNull())
    parts = src.mapInPandas(_moments, "_g string, n bigint, s array<double>, m array<double>")
    out = parts.groupBy("_g").applyInPandas(_merge, "_g string, n bigint, n_pairs bigint, mean double, std double")
    return out.withColumnRenamed("_g", group_col)


def _best(s: np.ndarray, i: np.ndarray, j: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best columns of each row, ties to the smaller id of the column; no row is its own."""
    order = np.argsort(j, kind="stable")
    s = np.array(s, order="C") if (order[1:] > order[:-1]).all() else np.take(s, order, axis=1)
    j = j[order]
    if k > FEW:
        best = np.argsort(-s, axis=1, kind="stable")[:, :k]
        value = np.take_along_axis(s, best, 1)
    else:
        # the first of the greatest, k times, is faster than a sort
        s[np.isnan(s)] = -np.inf
        each = np.arange(len(i))
        best = np.empty((len(i), min(k, len(j))), dtype=np.int64)
        value = np.empty(best.shape)
        for n in range(best.shape[1]):
            best[:, n] = s.argmax(1)
            value[:, n] = s[each, best[:, n]]
            s[each, best[:, n]] = -np.inf
    rows, cols, value = np.repeat(np.arange(len(i)), best.shape[1]), best.ravel(), value.ravel()
    ok = value > -np.inf
    return i[rows[ok]], j[cols[ok]], value[ok]


def _cosines(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Cosines of unit vectors; none of a row with itself."""
    s = np.round(a @ b.T, 9)
    same = pd.factorize(np.concatenate([i, j]))[0]
    s[same[: len(i), None] == same[None, len(i) :]] = -np.inf
    return s


def whole_groups(batches: Iterator[pd.DataFrame], name: str) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Rows and the bounds of the groups in them, from batches sorted by a column; the last group of a batch waits for the next one."""
    kept = None
    for b in batches:
        b = b if kept is None else pd.concat([kept, b], ignore_index=True)
        g = b[name].to_numpy()
        cut = np.flatnonzero(g[1:] != g[:-1]) + 1
        last = int(cut[-1]) if len(cut) else 0
        kept = b.iloc[last:]
        if last:
            yield b.iloc[:last], np.r_[0, cut]
    if kept is not None and len(kept):
        yield kept, np.array([0, len(kept)])


def _small_neighbours(k: int):
    def run(batches):
        for b, cuts in whole_groups(batches, "_g"):
            ids, vecs = b["_id"].to_numpy(), b["_v"].to_numpy()
            parts = []
            for p, q in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                x = np.stack([np.asarray(v, dtype=np.float64) for v in vecs[p:q]])
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                parts.append(_best(_cosines(x, x, ids[p:q], ids[p:q]), ids[p:q], ids[p:q], k))
            x, y, z = (np.concatenate(c) for c in zip(*parts))
            groups = np.repeat(b["_g"].to_numpy()[cuts[:-1]], [len(c[0]) for c in parts])
            yield pd.DataFrame({"_g": groups, "_i": x, "_j": y, "_s": z})

    return run


def _nearest(i: np.ndarray, j: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each i, ties to the smaller j."""
    order = np.lexsort((j, -s, i))
    i, j, s = i[order], j[order], s[order]
    n = np.arange(len(i))
    new = np.r_[True, i[1:] != i[:-1]]
    ok = n - np.maximum.accumulate(np.where(new, n, 0)) < k
    return i[ok], j[ok], s[ok]


def _block_neighbours(k: int, block: int):
    def run(key, left, right):
        names = ["_g", "_i", "_j", "_s"]
        if not len(left) or not len(right):
            return pd.DataFrame(columns=names)
        left, right = left.sort_values("_id", kind="stable"), right.sort_values("_rid", kind="stable")
        a, b = (np.stack([np.asarray(x, dtype=np.float64) for x in d]) for d in (left["_v"], right["_rv"]))
        a, b = a / np.linalg.norm(a, axis=1, keepdims=True), b / np.linalg.norm(b, axis=1, keepdims=True)
        i, j = left["_id"].to_numpy(), right["_rid"].to_numpy()
        one, other = [], []
        for p in range(0, len(i), block):
            for q in range(0, len(j), block):
                s = _cosines(a[p : p + block], b[q : q + block], i[p : p + block], j[q : q + block])
                x, y = np.arange(p, p + s.shape[0]), np.arange(q, q + s.shape[1])
                one.append(_best(s, x, y, k))
                # one product serves both sides of a pair of blocks
                if key[1] != key[2]:
                    other.append(_best(s.T, y, x, k))
        x, y, z = _nearest(*(np.concatenate(c) for c in zip(*one)), k)
        parts = [(i[x], j[y], z)]
        if other:
            x, y, z = _nearest(*(np.concatenate(c) for c in zip(*other)), k)
            parts.append((j[x], i[y], z))
        x, y, z = (np.concatenate(c) for c in zip(*parts))
        return pd.DataFrame({"_g": key[0], "_i": x, "_j": y, "_s": z}, columns=names)

    return run


def group_neighbours(vectors: DataFrame, group_col: str, id_col: str, k: int, vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(group, i, j, rank, sim): exactly the k most similar rows of the same group for each row, ties to the smaller id.

    A group is cut by a hash of the id into blocks of about ``block`` rows, or into ``WIDE`` larger ones if these would be more, of at most
    2 * ``WIDE`` * ``block`` rows; every unordered pair of blocks is multiplied by pieces of ``block`` rows and passes on k rows per row of
    either, so no task holds more than two blocks, and a row is copied once for every block of its group.
    A row alone in its group has no neighbour.
    """
    src = vectors.select(F.col(group_col).cast("string").alias("_g"), F.col(id_col).alias("_id"), F.col(vector_col).cast("array<double>").alias("_v")).where(F.col("_g").isNotNull())
    sizes = src.groupBy("_g").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("_n")).withColumn("_n", F.least("_n", F.greatest(F.lit(WIDE), F.ceil(F.col("_n") / F.lit(2 * WIDE)).cast("int"))))
    rows = src.join(sizes, "_g").withColumn("_b", F.pmod(F.xxhash64("_id"), F.col("_n")).cast("int"))
    # groups of one block are read one after the other, many in a task
    small = rows.where("_n = 1").select("_g", "_id", "_v").repartition("_g").sortWithinPartitions("_g")
    rows = rows.where("_n > 1")
    left = rows.select("_g", F.col("_b").alias("_x"), F.explode(F.sequence(F.col("_b"), F.col("_n") - 1)).alias("_y"), "_id", "_v")
    # the same rows again, under other names: both sides of a cogroup must be told apart
    right = rows.select(F.col("_g").alias("_rg"), F.explode(F.sequence(F.lit(0), F.col("_b"))).alias("_rx"), F.col("_b").alias("_ry"), F.col("_id").alias("_rid"), F.col("_v").alias("_rv"))
    kind = src.schema["_id"].dataType.simpleString()
    found = left.groupBy("_g", "_x", "_y").cogroup(right.groupBy("_rg", "_rx", "_ry")).applyInPandas(_block_neighbours(k, block), f"_g string, _i {kind}, _j {kind}, _s double")
    found = found.unionByName(small.mapInPandas(_small_neighbours(k), found.schema))
    w = Window.partitionBy("_g", "_i").orderBy(F.desc("_s"), "_j")
    out = found.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k)
    return out.select(F.col("_g").alias(group_col), F.col("_i").alias("i"), F.col("_j").alias("j"), "rank", F.col("_s").alias("sim"))


def mutual(neighbours: DataFrame, group_col: str) -> DataFrame:
    """(group, i, j, sim), i < j: pairs in which each is a neighbour of the other."""
    n = neighbours.select(group_col, "i", "j", "sim")
    back = n.select(group_col, F.col("j").alias("i"), F.col("i").alias("j"))
    return n.join(back, [group_col, "i", "j"]).where("i < j")


def either(neighbours: DataFrame, group_col: str, above: float) -> DataFrame:
    """(group, i, j, sim), i < j: pairs in which one is a neighbour of the other, above a similarity."""
    n = neighbours.where(F.col("sim") > above)
    return n.select(group_col, F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "sim").distinct()
