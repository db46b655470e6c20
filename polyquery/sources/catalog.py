"""Property graphs as typed DataFrames, and how they come from tables, fixtures and generators."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


class Lazy(Mapping):
    """A mapping whose values are made when they are first asked for, so that a query plans only the tables it names."""

    def __init__(self, makers: dict[str, Callable[[], object]]) -> None:
        self.makers, self.made = makers, {}

    def __getitem__(self, key: str):
        if key not in self.made:
            self.made[key] = self.makers[key]()
        return self.made[key]

    def __contains__(self, key: object) -> bool:
        return key in self.makers

    def __iter__(self) -> Iterator[str]:
        return iter(self.makers)

    def __len__(self) -> int:
        return len(self.makers)


@dataclass(frozen=True)
class EdgeType:
    """rows: (edge_id, src, dst, properties...); the labels that its ends have, where all have one.

    keys: rows also have src_key and dst_key, the ends' whole-number keys. own: (side, column) where the nodes
    of that side are themselves the edges, with the other end's key in the column, as foreign keys are.
    """

    rows: DataFrame
    src_label: str | None = None
    dst_label: str | None = None
    keys: bool = False
    own: tuple[str, str] | None = None
    kind: str | None = None

    def plain(self) -> DataFrame:
        return self.rows.drop("src_key", "dst_key")


@dataclass(frozen=True)
class VectorIndex:
    """rows: (id, vector, node_id); label: that of the nodes that the vectors belong to."""

    rows: DataFrame
    metric: str = "cosine"
    label: str | None = None
    approximate: object = None


@dataclass(frozen=True)
class Graph:
    """nodes: label -> (node_id, properties...); edges: type -> EdgeType. Values are immutable: writes give a new graph."""

    spark: SparkSession
    nodes: Mapping[str, DataFrame] = field(default_factory=dict)
    edges: Mapping[str, EdgeType] = field(default_factory=dict)
    indexes: Mapping[str, VectorIndex] = field(default_factory=dict)
    kv: DataFrame | None = None  # (namespace, key, value): the live records
    hashes: DataFrame | None = None  # (ns, coll, field, value)
    zsets: DataFrame | None = None  # (ns, coll, member, score)
    overlapping: bool = False  # some node is in the tables of several labels
    keyed: Mapping[str, str] = field(default_factory=dict)  # label -> key column, where node_id is `label:key`
    writes: int = 0  # what kv.put and kv.delete have written so far, as a version

    def with_nodes(self, label: str, rows: DataFrame) -> Graph:
        have = self.nodes.get(label)
        return replace(self.unkeyed(label), nodes={**self.nodes, label: rows if have is None else have.unionByName(rows, allowMissingColumns=True)})

    def unkeyed(self, *labels: str) -> Graph:
        """The graph with these labels' nodes known by node_id alone, since a write may have changed their columns."""
        return replace(self, keyed={k: v for k, v in self.keyed.items() if k not in labels})

    def with_edges(self, kind: str, rows: DataFrame, src: str | None = None, dst: str | None = None) -> Graph:
        have = self.edges.get(kind)
        if have is None:
            return replace(self, edges={**self.edges, kind: EdgeType(rows, src, dst)})
        same = EdgeType(have.plain().unionByName(rows, allowMissingColumns=True), have.src_label if have.src_label == src else None, have.dst_label if have.dst_label == dst else None)
        return replace(self, edges={**self.edges, kind: same})

    def labelled(self, label: str) -> DataFrame:
        return self.nodes[label] if label in self.nodes else self.spark.createDataFrame([], "node_id string")

    def all_nodes(self) -> DataFrame:
        """Every node once, with the properties of all labels."""
        out = None
        for rows in self.nodes.values():
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
        if out is None:
            return self.spark.createDataFrame([], "node_id string")
        return out.dropDuplicates(["node_id"]) if self.overlapping else out

    def any_edges(self, kinds: list[str]) -> EdgeType:
        found = [(k, self.edges[k]) for k in (kinds or self.edges) if k in self.edges]
        if not found:
            return EdgeType(self.spark.createDataFrame([], "edge_id string, src string, dst string, type string"))
        if len(found) == 1:
            return replace(found[0][1], rows=found[0][1].rows.withColumn("type", F.lit(found[0][0])), kind=found[0][0])
        rows = None
        for k, e in found:
            one = e.plain().withColumn("type", F.lit(k))
            rows = one if rows is None else rows.unionByName(one, allowMissingColumns=True)
        label = lambda side: next(iter(s)) if len(s := {getattr(e, side) for _, e in found}) == 1 else None
        return EdgeType(rows, label("src_label"), label("dst_label"))


def node_key(label: str, column: str):
    return F.concat(F.lit(f"{label.lower()}:"), F.col(column).cast("string"))


def tpch_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The star-schema tables as a graph: Region, Nation, Customer, Supplier, Part and Order nodes and their keys as edges."""
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")

    def nodes(label: str, name: str, key: str) -> Callable[[], DataFrame]:
        return lambda: t(name).select(node_key(label, key).alias("node_id"), "*")

    def edges(kind: str, name: str, src: str, src_key: str, dst: str, dst_key: str, *props: str) -> Callable[[], EdgeType]:
        a, b = node_key(src, src_key), node_key(dst, dst_key)
        extra = [F.col(props[0]).cast("string")] if props else []
        keys = [F.col(c).cast("bigint").alias(k) for c, k in ((src_key, "src_key"), (dst_key, "dst_key"))]
        own = next(((side, other) for side, key, other in (("src", src_key, dst_key), ("dst", dst_key, src_key)) if (name, key) in labels.values()), None)
        return lambda: EdgeType(t(name).select(F.concat_ws("|", a, F.lit(kind), b, *extra).alias("edge_id"), a.alias("src"), b.alias("dst"), *keys, *props), src, dst, True, own)

    def vectors() -> VectorIndex:
        return VectorIndex(t("embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector"), node_key("Part", "vec_id").alias("node_id"), F.col("vec_id").cast("bigint").alias("node_key")), "cosine", "Part")

    line = ("l_linenumber", "l_quantity")
    labels = {"Region": ("region", "r_regionkey"), "Nation": ("nation", "n_nationkey"), "Customer": ("customer", "c_custkey"), "Supplier": ("supplier", "s_suppkey"), "Part": ("part", "p_partkey"), "Order": ("orders", "o_orderkey")}
    kinds = {
        "LOCATED_IN": ("customer", "Customer", "c_custkey", "Nation", "c_nationkey"),
        "BASED_IN": ("supplier", "Supplier", "s_suppkey", "Nation", "s_nationkey"),
        "IN_REGION": ("nation", "Nation", "n_nationkey", "Region", "n_regionkey"),
        "PLACED": ("orders", "Customer", "o_custkey", "Order", "o_orderkey"),
        "CONTAINS": ("lineitem", "Order", "l_orderkey", "Part", "l_partkey", *line),
        "SUPPLIED_BY": ("lineitem", "Order", "l_orderkey", "Supplier", "l_suppkey", *line),
    }
    return Graph(spark, Lazy({k: nodes(k, *v) for k, v in labels.items()}), Lazy({k: edges(k, *v) for k, v in kinds.items()}), Lazy({"docs": vectors}), keyed={k: v[1] for k, v in labels.items()})


def bench_graph(spark: SparkSession, users: int, follows: int) -> Graph:
    """A generated graph of users who follow one another; self-loops are left out and equal edges are one."""
    ids = spark.range(users)
    cities = F.array(*map(F.lit, ("NYC", "SF", "LA", "SEA", "AUS")))
    nodes = ids.select(F.concat(F.lit("user-"), "id").alias("node_id"), F.concat(F.lit("User "), "id").alias("name"), (18 + F.col("id") % 60).alias("age"), F.element_at(cities, (F.col("id") % 5 + 1).cast("int")).alias("city"))
    ends = spark.range(follows).select((F.col("id") % users).alias("a"), ((F.col("id") * 7 + 1) % users).alias("b")).where("a <> b").distinct()
    src, dst = F.concat(F.lit("user-"), "a"), F.concat(F.lit("user-"), "b")
    return Graph(spark).with_nodes("User", nodes).with_edges("FOLLOWS", ends.select(F.concat_ws("|", src, F.lit("FOLLOWS"), dst).alias("edge_id"), src.alias("src"), dst.alias("dst")), "User", "User")


def sample_films(spark: SparkSession) -> Graph:
    """A small graph of films and people, of our own making."""
    films = spark.createDataFrame([("f1", "The Quiet Shore", 1994, "Tides keep secrets"), ("f2", "Paper Lanterns", 2003, None), ("f3", "North Line", 2011, "Every stop is a choice")], "node_id string, title string, released bigint, tagline string")
    people = spark.createDataFrame([("p1", "Ada Moss", 1960), ("p2", "Ben Orr", 1971), ("p3", "Cleo Park", 1985), ("p4", "Dov Hale", None)], "node_id string, name string, born bigint")
    edge = "edge_id string, src string, dst string"
    rows = lambda kind, pairs: spark.createDataFrame([(f"{a}|{kind}|{b}", a, b) for a, b in pairs], edge)
    g = Graph(spark).with_nodes("Movie", films).with_nodes("Person", people)
    acted = spark.createDataFrame([(f"{a}|ACTED_IN|{b}", a, b, r) for a, b, r in (("p1", "f1", ["Mara"]), ("p2", "f1", ["Finn", "Old Finn"]), ("p2", "f2", None), ("p3", "f3", ["Driver"]))], edge + ", roles array<string>")
    reviewed = spark.createDataFrame([("p4|REVIEWED|f3", "p4", "f3", 78, "worth the ride")], edge + ", rating bigint, summary string")
    g = g.with_edges("ACTED_IN", acted, "Person", "Movie").with_edges("REVIEWED", reviewed, "Person", "Movie")
    for kind, pairs in (("DIRECTED", [("p4", "f1"), ("p1", "f2")]), ("PRODUCED", [("p3", "f2")]), ("WROTE", [("p4", "f3")])):
        g = g.with_edges(kind, rows(kind, pairs), "Person", "Movie")
    return g.with_edges("FOLLOWS", rows("FOLLOWS", [("p2", "p1"), ("p4", "p3")]), "Person", "Person")


def load_statements(graph: Graph, text: str) -> Graph:
    """Runs statements that end in semicolons, with // comments, and returns the graph that they leave."""
    from polyquery.plans.language import statements
    from polyquery.plans.planner import run

    for statement in statements(text):
        graph = run(graph, statement).graph
    return graph


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Vectors from JSON lines of id and values."""
    return spark.read.schema("id string, values array<float>").json(path).select("id", F.col("values").alias("vector"))


def export_table(rows: DataFrame, path: str, by: list[str], where=None) -> None:
    """Writes the selected rows, partitioned by their selector columns, so that a restore reads only what it selects."""
    (rows if where is None else rows.where(where)).write.mode("overwrite").partitionBy(*by).parquet(path)


def restore_table(spark: SparkSession, path: str, where=None) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows if where is None else rows.where(where)


def reservoir(rows: DataFrame, n: int = 1000, seed: int = 0, key: str | None = None) -> DataFrame:
    """Exactly min(n, count) rows, each set of rows as likely as any: the n lowest seeded hashes (a top-n, not a full sort).

    key: a column that tells rows apart; by default the whole row does.
    """
    of = F.to_json(F.struct(*rows.columns)) if key is None else F.col(key).cast("string")
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}|"), of)), of).limit(n)
