"""The queries of the core, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.hierarchy import chunk_links, descendants, resolve_hierarchy
from ..sources.tables import read_table
from . import context_queries, evidence_queries, lifecycle_queries, record_queries, text_queries, vector_queries

MODULES = (text_queries, vector_queries, evidence_queries, context_queries, record_queries, lifecycle_queries)

Query = Callable[[SparkSession, str], DataFrame]


def _hierarchy(spark: SparkSession, root: str) -> DataFrame:
    return resolve_hierarchy(chunk_links(read_table(spark, root, "chunks")))


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return _hierarchy(spark, root).where("state = 'ring'").select(F.col("node").alias("chunk_uid"), F.col("ring").alias("ring_uid"))


def p4_nodes(spark: SparkSession, root: str) -> DataFrame:
    return _hierarchy(spark, root)


def p4_descendants(spark: SparkSession, root: str) -> DataFrame:
    return descendants(_hierarchy(spark, root))


def queries() -> dict[str, Query]:
    own = {f.__name__: f for f in (p4_found, p4_nodes, p4_descendants)}
    return own | {k: f for m in MODULES for k, f in m.QUERIES.items()}


_LINKS = """links as (
  select chunk_uid as node, max(case when hierarchy.parent_chunk_uid <> '' then hierarchy.parent_chunk_uid
    else document_id || ':chunk:' || hierarchy.parent_chunk_id end) as parent
  from chunks group by 1),
up as (select l.node, p.node as parent from links l left join links p on l.parent = p.node)"""


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.SQL.items()} | {
        # a node is on a ring if a walk up from it meets it again; UNION ends the walks
        "p4_found": f"""with recursive {_LINKS},
          walk(node, place) as (select node, parent from up where parent is not null union select w.node, u.parent from walk w join up u on w.place = u.node where u.parent is not null),
          on_ring as (select node from walk where node = place)
          select w.node as chunk_uid, min(w.place) as ring_uid from walk w join on_ring r on w.node = r.node group by 1""",
        "p4_nodes": f"""with recursive {_LINKS},
          walk(node, place) as (select node, parent from up where parent is not null union select w.node, u.parent from walk w join up u on w.place = u.node where u.parent is not null),
          on_ring as (select w.node, min(w.place) as ring from walk w join (select node from walk where node = place) r using (node) group by 1),
          free as (select u.node, case when r.node is null then u.parent end as parent from up u left join on_ring r on u.node = r.node),
          down(node, top, depth, path) as (select node, node, 0, [node] from free where parent is null union all select f.node, d.top, d.depth + 1, list_append(d.path, f.node) from down d join free f on f.parent = d.node)
          select d.node, case when r.ring is null then d.top end as root, d.depth, d.path, r.ring, case when r.ring is null then 'tree' when d.depth = 0 then 'ring' else 'leads to ring' end as state from down d left join on_ring r on r.node = d.top""",
        "p4_descendants": f"""with recursive {_LINKS},
          walk(node, place) as (select node, parent from up where parent is not null union select w.node, u.parent from walk w join up u on w.place = u.node where u.parent is not null),
          on_ring as (select node from walk where node = place),
          free as (select u.node, case when r.node is null then u.parent end as parent from up u left join on_ring r on u.node = r.node),
          down(ancestor, descendant, distance) as (select parent, node, 1 from free where parent is not null union all select f.parent, d.descendant, d.distance + 1 from down d join free f on d.ancestor = f.node where f.parent is not null)
          select ancestor, descendant, distance from down""",
    }
