"""Connected components of an undirected edge table, without collecting edges or components anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, release


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", most_rounds: int = 100) -> DataFrame:
    """(node, component): each node that has an edge, with the smallest node of its component.

    Alternates large-star and small-star steps, which halve the depth of what is left; a node of very many edges is
    aggregated partially before each shuffle. Self-loops make a component of one; null ends are left out. An
    empty table gives an empty result.
    """
    both = materialize(edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null").distinct(), "components-edges")
    nodes = both.select(F.col("u").alias("node")).unionByName(both.select(F.col("v").alias("node"))).distinct()
    sign = lambda d: tuple(d.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())  # noqa: E731  of an edge set, in one small aggregate
    e = materialize(both.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "components")
    last = sign(e)
    for _ in range(most_rounds):
        # large star: every node links its larger neighbours to its smallest one
        sym = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sym.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: every node links its smaller neighbours and itself to the smallest
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        new = materialize(new, "components")
        before, last = last, sign(new)
        release(e)
        e = new
        if last == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return nodes.join(e.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
