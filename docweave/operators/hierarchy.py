"""Parent-child rows to full hierarchies: path, depth, root, descendants and cycles.

Every node has at most one parent, so each connected component holds one root or one ring.
1. Nodes are brought together by document, in blocks of bounded size, and each partition contracts the links within it.
2. What is left, the links between partitions, is a far smaller graph of the same kind; pointer doubling labels it.
3. Components are co-located by label and walked depth first with node colouring. A component of more than
   ``giant`` nodes is never put into one task: pointer doubling resolves it in place. The walk streams its rows,
   so a task holds the nodes of one component and one path, never all paths.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, release

BLOCK, GIANT = 50_000, 20_000
#: Path entries of one batch of output; the paths of a component are never held together.
ENTRIES = 200_000
_COLUMNS = ["node", "root", "depth", "path", "ring", "state"]
_SHAPE = "node string, root string, depth int, path array<string>, ring string, state string"


def chunk_links(chunks: DataFrame) -> DataFrame:
    """(node, parent, block) of chunk rows: the parent is named by uid or, where that is null or empty, by its
    chunk_id in the same document. Rows repeated with one uid count once; rows without a uid are left out."""
    uid = F.col("hierarchy.parent_chunk_uid")
    by_id = F.concat(F.col("document_id"), F.lit(":chunk:"), F.col("hierarchy.parent_chunk_id").cast("string"))
    # rows without a document or a number are spread by their uid
    spread = F.concat(F.lit("#"), F.pmod(F.xxhash64("chunk_uid"), F.lit(65_521)).cast("string"))
    block = F.when(F.col("document_id").isNull() | F.col("chunk_id").isNull(), spread).otherwise(F.concat_ws("/", "document_id", F.floor(F.col("chunk_id") / BLOCK).cast("string")))
    rows = chunks.where(F.col("chunk_uid").isNotNull()).select(F.col("chunk_uid").alias("node"), F.when(uid != "", uid).otherwise(by_id).alias("parent"), block.alias("block"))
    return rows.groupBy("node").agg(F.max("parent").alias("parent"), F.max("block").alias("block"))


def _contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Labels the nodes of each block with the node their links end at inside it; ``exit`` is a parent elsewhere.

    Rows come sorted by block. Small blocks are contracted together, up to BLOCK rows at a time.
    """
    parts: list[pd.DataFrame] = []
    held = 0
    for b in batches:
        at = 0
        blocks = b["block"].to_numpy(dtype=object)
        for cut in [*(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1).tolist(), len(b)]:
            if parts and held + cut - at > BLOCK and parts[-1]["block"].iloc[-1] != blocks[at]:
                yield _contracted(pd.concat(parts, ignore_index=True))
                parts, held = [], 0
            parts.append(b.iloc[at:cut])
            held += cut - at
            at = cut
    if held:
        yield _contracted(pd.concat(parts, ignore_index=True))


def _contracted(b: pd.DataFrame) -> pd.DataFrame:
    node, parent = b["node"], b["parent"]
    up = pd.Index(node).get_indexer(parent.where(parent.notna(), None))
    up[parent.isna().to_numpy()] = -1
    own = np.arange(len(b))
    at = np.where(up < 0, own, up)
    lowest = node.rank(method="first").to_numpy().astype(np.int64)
    low, to = np.minimum(lowest, lowest[at]), at
    for _ in range(len(b).bit_length() + 1):
        low, to = np.minimum(low, low[to]), to[to]
    ringed = up[to] >= 0
    by_rank = np.empty(len(b) + 1, dtype=np.int64)
    by_rank[lowest] = own
    end = np.where(ringed, by_rank[low[to]], to)
    leaves = (up < 0) & parent.notna().to_numpy()
    return pd.DataFrame({"node": node, "parent": parent, "label": node.to_numpy()[end], "exit": parent.where(pd.Series(leaves, index=b.index), None)})


def resolve_by_doubling(links: DataFrame, with_path: bool = True) -> DataFrame:
    """(node, root, depth, path, ring, state) of a functional graph (node, parent), no component in one task.

    A parent that is no node counts as none. After k rounds every node knows its ancestor 2^k steps up. Where a
    round resolves no further node, what is left ends in rings; the ring nodes are the image of what is left.
    """
    nodes = links.select("node", "parent")
    known = nodes.select(F.col("node").alias("parent")).withColumn("_is", F.lit(True))
    start = nodes.join(known, "parent", "left").select("node", F.when(F.col("_is"), F.col("parent")).alias("up"))
    seg = F.array("node") if with_path else F.array().cast("array<string>")
    state = materialize(start.select("node", "up", seg.alias("path"), F.col("node").alias("last"), F.lit(0).alias("n"), F.col("node").alias("low"), F.col("up").alias("parent")), "doubling")
    left, image = state.where("up is not null").count(), -1
    while left:
        far = state.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("path").alias("path2"), F.col("last").alias("last2"), F.col("n").alias("n2"), F.col("low").alias("low2"))
        step = state.join(far, "up", "left")
        moved = F.col("up").isNotNull()
        last_state = state
        state = materialize(step.select("node", F.col("up2").alias("up"), F.when(moved, F.concat("path2", "path")).otherwise(F.col("path")).alias("path"), F.when(moved, F.col("last2")).otherwise(F.col("last")).alias("last"), F.when(moved, F.col("n") + F.col("n2") + 1).otherwise(F.col("n")).alias("n"), F.when(moved, F.least("low", "low2")).otherwise(F.col("low")).alias("low"), "parent"), "doubling")
        now = state.where("up is not null").count()
        release(last_state)
        if now == left:
            open_ = state.where("up is not null")
            on = open_.select(F.col("up").alias("node")).distinct()
            size = on.count()
            if size == image:
                # low of the node an open node now points at covers its whole ring once neighbours agree
                lows = open_.select(F.col("node").alias("up"), F.col("low").alias("ring"))
                named = open_.select("node", "up", "parent").join(lows, "up").select("node", "parent", "ring")
                same = named.join(named.select(F.col("node").alias("parent"), F.col("ring").alias("ring2")), "parent").where("ring <> ring2")
                if same.isEmpty():
                    return _with_rings(state, named, on, with_path)
            image = size
        left = now
    return state.select("node", F.col("last").alias("root"), F.col("n").cast("int").alias("depth"), "path", F.lit(None).cast("string").alias("ring"), F.lit("tree").alias("state"))


def _with_rings(state: DataFrame, named: DataFrame, on: DataFrame, with_path: bool) -> DataFrame:
    done = state.where("up is null").select("node", F.col("last").alias("root"), F.col("n").cast("int").alias("depth"), "path", F.lit(None).cast("string").alias("ring"), F.lit("tree").alias("state"))
    marked = named.join(on.withColumn("_on", F.lit(True)), "node", "left")
    ring = marked.where("_on").select("node", F.lit(None).cast("string").alias("root"), F.lit(0).alias("depth"), F.array("node").alias("path") if with_path else F.array().cast("array<string>").alias("path"), "ring", F.lit("ring").alias("state"))
    # the rest leads to a ring: cut the links into rings and resolve it as trees below ring nodes
    rest = marked.where("_on is null").select("node", "parent", "ring")
    if rest.isEmpty():
        return done.unionByName(ring)
    trees = resolve_by_doubling(rest.select("node", "parent").unionByName(on.select("node", F.lit(None).cast("string").alias("parent"))), with_path)
    trees = trees.join(rest.select("node", "ring"), "node")
    tail = trees.select("node", F.lit(None).cast("string").alias("root"), "depth", "path", rest["ring"], F.lit("leads to ring").alias("state"))
    return done.unionByName(ring).unionByName(tail)


def walk(nodes: list, parents: list) -> Iterator[tuple]:
    """Depth-first traversal with colours over whole components; a grey node met again closes a ring.

    Goes up from each white node until a coloured one tells a ring from a tree, then down from every root and from every node of a
    ring, with the way there as the only path that is held.
    """
    at = {n: i for i, n in enumerate(nodes)}
    up = [at.get(p, -1) if p is not None else -1 for p in parents]
    below: list[list[int]] = [[] for _ in nodes]
    for i, p in enumerate(up):
        if p >= 0:
            below[p].append(i)
    colour = bytearray(len(nodes))
    tops: list[tuple[int, object]] = [(i, None) for i in range(len(nodes)) if up[i] < 0]
    ringed: set[int] = set()
    for first in range(len(nodes)):
        way, i = [], first
        while i >= 0 and not colour[i]:
            colour[i] = 1
            way.append(i)
            i = up[i]
        if i >= 0 and colour[i] == 1:
            circle = way[way.index(i) :]
            ring = min(nodes[j] for j in circle)
            ringed.update(circle)
            tops += [(j, ring) for j in circle]
        for j in way:
            colour[j] = 2
    for top, ring in tops:
        path: list = []
        todo = [(top, 0)]
        while todo:
            i, depth = todo.pop()
            del path[depth:]
            path.append(nodes[i])
            root = nodes[top] if ring is None else None
            yield nodes[i], root, depth, list(path), ring, "tree" if ring is None else "leads to ring" if depth else "ring"
            todo += [(j, depth + 1) for j in below[i] if j not in ringed]


def _walked(b: pd.DataFrame) -> Iterator[pd.DataFrame]:
    rows, entries = [], 0
    for r in walk(b["node"].tolist(), b["parent"].where(b["parent"].notna(), None).tolist()):
        rows.append(r)
        entries += len(r[3])
        if entries >= ENTRIES:
            yield pd.DataFrame(rows, columns=_COLUMNS)
            rows, entries = [], 0
    if rows:
        yield pd.DataFrame(rows, columns=_COLUMNS)


def _walk_components(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by component; the last, perhaps unfinished, one of a batch waits for the next batch."""
    rest: pd.DataFrame | None = None
    for b in batches:
        b = b if rest is None else pd.concat([rest, b], ignore_index=True)
        if not len(b):
            continue
        last = b["label"].iloc[-1]
        cut = int(b["label"].searchsorted(last)) if b["label"].is_monotonic_increasing else int(np.flatnonzero((b["label"] != last).to_numpy())[-1] + 1 if (b["label"] != last).any() else 0)
        ready, rest = b.iloc[:cut], b.iloc[cut:]
        if len(ready):
            yield from _walked(ready)
    if rest is not None and len(rest):
        yield from _walked(rest)


def resolve_hierarchy(links: DataFrame, giant: int = GIANT) -> DataFrame:
    """(node, root, depth, path, ring, state) for each node of ``links`` (node, parent, block), node unique.

    state is ``tree`` (path runs from the root), ``ring`` (on a cycle; ring is its smallest node, path the node
    itself) or ``leads to ring`` (path runs from the ring's node; no root). A parent that is no node counts as
    none, a node that is its own parent is a ring of one. ``block`` groups nodes that are likely linked, in groups of bounded
    size; it never changes the result. An empty table gives an empty result.
    """
    local = links.repartition("block").sortWithinPartitions("block").mapInPandas(_contract, "node string, parent string, label string, exit string")
    local = materialize(local, "hierarchy-local")
    exits = local.where("exit is not null").select("label", "exit")
    over = exits.join(local.select(F.col("node").alias("exit"), F.col("label").alias("to")), "exit").select("label", "to")
    over = materialize(over, "hierarchy-exits")
    if over.isEmpty():
        placed = local.select("node", "parent", "label")
    else:
        graph = over.select(F.col("label").alias("node"), F.col("to").alias("parent"))
        ends = graph.select(F.col("parent").alias("node")).distinct().join(graph.select("node"), "node", "left_anti").select("node", F.lit(None).cast("string").alias("parent"))
        solved = resolve_by_doubling(graph.unionByName(ends), with_path=False)
        solved = solved.select(F.col("node").alias("label"), F.coalesce("root", "ring").alias("whole"))
        placed = local.select("node", "parent", "label").join(solved, "label", "left").select("node", "parent", F.coalesce("whole", "label").alias("label"))
    large = materialize(placed.groupBy("label").count().where(F.col("count") > giant).select("label"), "hierarchy-giants")
    has_giants = not large.isEmpty()
    small = placed.join(large, "label", "left_anti") if has_giants else placed
    out = small.repartition("label").sortWithinPartitions("label").select("label", "node", "parent").mapInPandas(_walk_components, _SHAPE)
    if has_giants:
        out = out.unionByName(resolve_by_doubling(placed.join(large, "label", "left_semi").select("node", "parent")))
    return out


def descendants(hierarchy: DataFrame) -> DataFrame:
    """(ancestor, descendant, distance) for each node and each node below it, from the paths; no list per ancestor
    is ever held, so the root of a giant tree is no hot spot."""
    d = hierarchy.where("size(path) > 1").select("node", "path", F.posexplode(F.slice("path", 1, F.size("path") - 1)).alias("_at", "ancestor"))
    return d.select("ancestor", F.col("node").alias("descendant"), (F.size("path") - 1 - F.col("_at")).alias("distance"))
