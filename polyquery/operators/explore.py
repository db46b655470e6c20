"""Exploring a graph: whole, from a seed, or around given nodes."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyquery.operators.cut import cut
from polyquery.sources.catalog import Graph

BROADCAST_ROWS = 1_000_000  # (label, key) pairs of 16 bytes


def links(graph: Graph) -> DataFrame:
    """(edge_id, src, dst, type) of all edges."""
    return graph.any_edges([]).rows.select("edge_id", "src", "dst", "type")


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("edge_id", F.col("src").alias("at"), F.col("dst").alias("to")).union(edges.select("edge_id", F.col("dst"), F.col("src")))


def by_keys(graph: Graph) -> bool:
    """Whether all nodes and edges have whole-number keys."""
    return bool(graph.keyed) and set(graph.keyed) >= set(graph.nodes) and all(graph.edges[k].keys and graph.edges[k].src_label in graph.keyed and graph.edges[k].dst_label in graph.keyed for k in graph.edges)


def keys_of(graph: Graph, ids: DataFrame) -> DataFrame:
    """(label, key) of ids `label:key`; others are left out."""
    names = {k.lower(): k for k in graph.keyed}
    found = F.regexp_extract("node_id", "^(" + "|".join(map(re.escape, names)) + "):(0|-?[1-9][0-9]{0,17})$", 1)
    label = F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), found)
    rows = ids.where(found != "").select(label.alias("label"), F.substring_index("node_id", ":", -1).cast("bigint").alias("key"))
    return rows.distinct()


def node_id(label: Column, key: Column) -> Column:
    return F.concat(F.lower(label), F.lit(":"), key.cast("string"))


def counts(rows: DataFrame) -> dict[str, int]:
    """Rows of each label: as many entries as the graph has labels."""
    return {r[0]: r[1] for r in rows.groupBy("label").count().collect()}


def few(rows: DataFrame, n: int) -> DataFrame:
    return F.broadcast(rows) if n <= BROADCAST_ROWS else rows


def living(graph: Graph, rows: DataFrame, sizes: dict[str, int]) -> DataFrame | None:
    """Of rows (label, key), as many as sizes says, those that are nodes: each label's table meets its keys alone."""
    out = None
    for label, n in sizes.items():
        table = graph.nodes[label].select(F.col(graph.keyed[label]).cast("bigint").alias("key"))
        some = table.join(few(rows.where(F.col("label") == label).select("key"), n), "key", "left_semi").distinct().select(F.lit(label).alias("label"), "key")
        out = some if out is None else out.unionByName(some)
    return out


def induced(graph: Graph, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among nodes (node_id)."""
    if not by_keys(graph):
        ids = nodes.select("node_id").distinct()
        inside = links(graph).join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi")
        return inside.join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi").select("edge_id", "src", "dst", "type")
    ids = cut(keys_of(graph, nodes))
    sizes, out = counts(ids), graph.spark.createDataFrame([], "edge_id string, src string, dst string, type string")
    for kind in graph.edges:
        e = graph.edges[kind]
        if e.src_label in sizes and e.dst_label in sizes:
            rows = e.rows
            for side, label in (("src_key", e.src_label), ("dst_key", e.dst_label)):
                rows = rows.join(few(ids.where(F.col("label") == label).select(F.col("key").alias(side)), sizes[label]), side, "left_semi")
            out = out.unionByName(rows.select("edge_id", "src", "dst", F.lit(kind).alias("type")))
    return out


def whole(graph: Graph, limit: int) -> tuple[DataFrame, DataFrame, bool]:
    """The first `limit` nodes by id, the edges between them, and whether there are more nodes."""
    ids = graph.all_nodes().select("node_id").orderBy("node_id")
    kept = ids.limit(limit)
    return kept, induced(graph, kept), ids.limit(limit + 1).count() > limit


def reached(graph: Graph, seeds: DataFrame, depth: int) -> DataFrame:
    """(node_id, hops): nodes within `depth` undirected hops. Each hop joins the frontier only, with the edge tables of the
    labels that it holds, and is kept by a reliable checkpoint."""
    if not by_keys(graph):
        return reached_by_id(graph, seeds, depth)
    near = cut(keys_of(graph, seeds.select("node_id")))
    seen = None
    for hop in range(depth + 1):
        sizes = counts(near)
        frontier = living(graph, near, sizes)
        if frontier is None:
            break
        frontier = frontier.withColumn("hops", F.lit(hop))
        seen = frontier if seen is None else seen.unionByName(frontier)
        if hop == depth:
            break
        frontier = cut(frontier)
        seen = frontier if hop == 0 else cut(seen)
        sizes, steps = counts(frontier), None
        for kind in graph.edges:
            e = graph.edges[kind]
            for a, b, label, to in (("src_key", "dst_key", e.src_label, e.dst_label), ("dst_key", "src_key", e.dst_label, e.src_label)):
                if label in sizes:
                    rows = e.rows.join(few(frontier.where(F.col("label") == label).select(F.col("key").alias(a)), sizes[label]), a, "left_semi").select(F.lit(to).alias("label"), F.col(b).alias("key"))
                    steps = rows if steps is None else steps.unionByName(rows)
        if steps is None:
            break
        near = cut(steps.where("key is not null").distinct().join(seen.select("label", "key"), ["label", "key"], "left_anti"))
    if seen is None:
        return graph.spark.createDataFrame([], "node_id string, hops int")
    return seen.select(node_id(F.col("label"), F.col("key")).alias("node_id"), "hops")


def reached_by_id(graph: Graph, seeds: DataFrame, depth: int) -> DataFrame:
    """The same over string ids, for graphs without keys."""
    steps = both_ways(links(graph)).select("at", "to")
    live = graph.all_nodes().select("node_id")
    seen = frontier = cut(live.join(seeds.select("node_id").distinct(), "node_id", "left_semi").withColumn("hops", F.lit(0)))
    for hop in range(1, depth + 1):
        near = steps.join(frontier.select(F.col("node_id").alias("at")), "at").select(F.col("to").alias("node_id")).distinct()
        frontier = cut(near.join(live, "node_id", "left_semi").join(seen, "node_id", "left_anti").withColumn("hops", F.lit(hop)))
        seen = seen.unionByName(frontier)
    return seen


@dataclass
class Explored:
    nodes: DataFrame
    edges: DataFrame
    truncated: bool


def explored(graph: Graph, seeds: DataFrame, depth: int, limit: int) -> Explored:
    """The first `limit` nodes around the seeds by (hops, id), all edges that touch them, and whether nodes were left out."""
    found = cut(reached(graph, seeds, depth).orderBy("hops", "node_id").limit(limit + 1))
    more = found.count() > limit
    nodes = found.orderBy("hops", "node_id").limit(limit)
    ids = nodes.select("node_id")
    edges = links(graph)
    touching = edges.join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi").unionByName(edges.join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi"))
    return Explored(nodes, touching.dropDuplicates(["edge_id"]), more)


def subgraph(graph: Graph, ids: DataFrame, hops: int = 0) -> tuple[DataFrame, DataFrame]:
    """The nodes of a list of ids (those that exist), with neighbours up to `hops`, and the edges among them."""
    nodes = reached(graph, ids, hops)
    return nodes, induced(graph, nodes)


def edge_by_id(graph: Graph, edge_id: str) -> DataFrame:
    """(edge_id, src, dst, type) of one edge; its type is in its id, so that one table is read."""
    parts = edge_id.split("|")
    kind = parts[1] if len(parts) > 2 else ""
    return graph.any_edges([kind]).rows.select("edge_id", "src", "dst", "type").where(F.col("edge_id") == edge_id) if kind in graph.edges else links(graph).limit(0)


def redacted(rows: DataFrame, shown: bool, keep: tuple[str, ...] = ("node_id", "edge_id", "src", "dst", "type", "hops")) -> DataFrame:
    """rows as they are if values may be shown, else with every other column's values hidden."""
    return rows if shown else rows.select(*[F.col(f"`{c}`") if c in keep else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns])
