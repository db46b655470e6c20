"""Queries of the pattern language as DataFrame plans.

A query is a pipeline: each clause turns the rows so far into new rows. Variables are bound to column
groups: a node n with property p has the columns `n.id` and `n.p` (with a separator that no name has).
Two sets of rules exist. "classic" keeps the language's own: optional matches are inner, only the first
label and type of a pattern count, labels of expanded-to nodes and properties of relationships are not
looked at, a pattern that returns to a bound variable binds it anew, WITH turns entities into ids and
ORDER BY sees output names only. "open" follows openCypher in these points.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from polyquery.functions.values import Value, arithmetic, compare, literal, sort_keys, truth
from polyquery.operators import vectors
from polyquery.plans import language as L
from polyquery.sources.catalog import Graph

MAX_ROWS = 100_000
SEP = "·"


@dataclass(frozen=True)
class Limits:
    """Rows between clauses (checked by counting after each clause, so off by default) and hops of one path."""

    intermediate: int | None = None
    depth: int | None = 8


@dataclass
class Meta:
    """What is known of a result besides its rows."""

    consistency: str = "EVENTUAL"
    completeness: str = "COMPLETE"
    partial: bool = False
    warnings: list[str] = field(default_factory=list)


@dataclass
class Result:
    df: DataFrame
    graph: Graph
    meta: Meta

    def guarded(self, most: int = MAX_ROWS) -> DataFrame:
        """The rows, after a check that there are no more than `most` (reads at most one row beyond)."""
        if self.df.limit(most + 1).count() > most:
            raise L.QueryError(f"over {most} rows")
        return self.df


@dataclass
class Bound:
    kind: str  # node, edge or value
    props: tuple[str, ...] = ()
    type: T.DataType | None = None
    labels: tuple[str, ...] = ()
    key: str | None = None  # the label whose whole-number keys stand for node ids
    many: bool = False  # rows may repeat a node, since many lead to it
    told: str | None = None  # the one type of an edge whose id spells it out


class Planner:
    def __init__(self, graph: Graph, params: dict, rules: str, limits: Limits = Limits()) -> None:  # noqa: B008
        if rules not in ("classic", "open"):
            raise ValueError("rules are classic or open")
        self.graph, self.params, self.open = graph, params, rules == "open"
        self.df: DataFrame | None = None
        self.bound: dict[str, Bound] = {}
        self.meta, self.hidden, self.projected, self.limits = Meta(), 0, False, limits

    # names

    def id_of(self, var: str) -> Column:
        b = self.bound.get(var)
        if b is not None and b.key:  # written only where an id is shown; joins and filters go by the key
            return F.concat(F.lit(f"{b.key.lower()}:"), self.key_of(var).cast("string"))
        return F.col(f"`{var}{SEP}{SEP}id`")

    def key_of(self, var: str) -> Column:
        return F.col(f"`{var}{SEP}{SEP}key`")

    def by_key(self, e: tuple, other: tuple) -> Column | None:
        """`id = 'label:key'` of a keyed node as a comparison of its key, which scans can push down."""
        b = self.bound.get(e[1]) if e[0] == "var" or e[0] == "prop" and e[2] == "id" else None
        if b is None or not b.key or e[0] == "prop" and "id" in b.props or other[0] not in ("lit", "param"):
            return None
        want = other[1] if other[0] == "lit" else self.params.get(other[1])
        if not isinstance(want, str):
            return None
        m = re.fullmatch(rf"{re.escape(b.key.lower())}:(0|-?[1-9][0-9]{{0,17}})", want)
        return self.key_of(e[1]) == F.lit(int(m[1])) if m else F.lit(False)

    def fresh(self) -> str:
        self.hidden += 1
        return f"_{self.hidden}"

    def nodes_as(self, label: str | None, var: str, rows: DataFrame | None = None) -> tuple[DataFrame, Bound]:
        """A label's nodes (or all) as columns of a variable, known by key where they have one."""
        if rows is None:
            rows = self.graph.labelled(label) if label else self.graph.all_nodes()
        key = self.graph.keyed.get(label) if label else None
        if key is None:
            rows, props = self.prefixed(rows, var, "node_id")
        else:
            props = tuple(c for c in rows.columns if c not in ("node_id", "src", "dst", "type"))
            rows = rows.select(F.col(key).cast("bigint").alias(f"{var}{SEP}{SEP}key"), *[F.col(f"`{c}`").alias(f"{var}{SEP}{c}") for c in props])
        return rows, Bound("node", props, labels=(label,) if label else (), key=label if key else None)

    def prefixed(self, rows: DataFrame, var: str, key: str) -> tuple[DataFrame, tuple[str, ...]]:
        props = tuple(c for c in rows.columns if c not in (key, "src", "dst", "type", "src_key", "dst_key"))
        return rows.select(F.col(key).alias(f"{var}{SEP}{SEP}id"), *[F.col(f"`{c}`").alias(f"{var}{SEP}{c}") for c in props], *[c for c in ("src", "dst", "type") if c in rows.columns]), props

    # expressions

    def value(self, e: tuple, conjunct: bool = False) -> Value:
        kind = e[0]
        if kind == "lit":
            return literal(e[1])
        if kind == "param":
            return literal(self.params.get(e[1]))
        if kind == "var":
            b = self.bound.get(e[1])
            if b is None:
                return literal(None)
            return Value(F.col(f"`{e[1]}`"), b.type) if b.kind == "value" else Value(self.id_of(e[1]), T.StringType())
        if kind == "prop":
            b = self.bound.get(e[1])
            if b is None or e[2] not in b.props:
                if b is not None and b.kind != "value" and e[2] == "id":
                    return Value(self.id_of(e[1]), T.StringType())
                return literal(None)
            name = f"{e[1]}{SEP}{e[2]}"
            return Value(F.col(f"`{name}`"), self.df.schema[name].dataType)
        if kind in ("and", "or"):
            a, b = truth(self.value(e[1], conjunct and kind == "and")), truth(self.value(e[2], conjunct and kind == "and"))
            return Value(a & b if kind == "and" else a | b, T.BooleanType())
        if kind == "not":
            return Value(~truth(self.value(e[1])), T.BooleanType())
        if kind == "cmp":
            if e[1] == "=":
                for a, b in ((e[2], e[3]), (e[3], e[2])):
                    if (same := self.by_key(a, b)) is not None:
                        return Value(same if conjunct else F.coalesce(same, F.lit(False)), T.BooleanType())
            return Value(compare(e[1], self.value(e[2]), self.value(e[3]), conjunct), T.BooleanType())
        if kind == "in":
            return self.member(e, conjunct)
        if kind == "math":
            return arithmetic(e[1], self.value(e[2]), self.value(e[3]))
        if kind == "neg":
            v = self.value(e[1])
            if v.literal and isinstance(v.constant, (int, float)) and not isinstance(v.constant, bool):
                return literal(-v.constant)
            return Value(-v.col, v.type) if v.family == "num" else literal(None)
        if kind == "list":
            parts = [self.value(x) for x in e[1]]
            if all(p.literal for p in parts):
                return literal([p.constant for p in parts])
            inner = next((p.type for p in parts if not isinstance(p.type, T.NullType)), T.NullType())
            return Value(F.array(*[p.col.cast(inner) for p in parts]), T.ArrayType(inner))
        if kind == "map":
            return literal({k: self.value(v).constant for k, v in e[1].items()})
        if kind == "call":
            return self.function(e[1], e[2])
        raise L.QueryError(f"can't evaluate {kind}")

    def member(self, e: tuple, conjunct: bool) -> Value:
        a, b = self.value(e[1]), self.value(e[2])
        if not isinstance(b.type, T.ArrayType):
            return literal(False)
        if b.literal:
            same = all(literal(x).family == a.family for x in b.constant)
            if same and a.family in ("num", "str"):
                found = a.col.isin(*b.constant) if b.constant else F.lit(False)
                return Value(found if conjunct else F.coalesce(found, F.lit(False)), T.BooleanType())
            found = F.lit(False)
            for x in b.constant:
                found = found | compare("=", a, literal(x))
            return Value(found, T.BooleanType())
        return Value(F.coalesce(F.exists(b.col, lambda x: compare("=", a, Value(x, b.type.elementType))), F.lit(False)), T.BooleanType())

    def function(self, name: str, args: list[tuple]) -> Value:
        """Look-ups of other stores: a left join on the last argument; the others must be constants."""
        stores = {"kv.get": (self.graph.kv, ("namespace",), "key", "value"), "hash.get": (self.graph.hashes, ("ns", "coll"), "field", "value"), "zset.score": (self.graph.zsets, ("ns", "coll"), "member", "score")}
        if name not in stores:
            raise L.QueryError(f"unknown function {name}")
        rows, fixed, key, out = stores[name]
        if rows is None:
            raise L.QueryError(f"{name}: no such store in this graph")
        if len(args) != len(fixed) + 1:
            raise L.QueryError(f"{name} takes {len(fixed) + 1} arguments")
        values = [self.value(a) for a in args]
        if any(not (v.literal and isinstance(v.constant, str)) for v in values[:-1]) or values[-1].family not in ("str", "bytes"):
            raise L.QueryError(f"{name} takes strings")
        for column, v in zip(fixed, values, strict=False):
            rows = rows.where(F.col(column) == v.constant)
        k, o = self.fresh(), self.fresh()
        kind = rows.schema[out].dataType
        # repeated keys would repeat rows: one value for each
        self.df = self.df.join(rows.groupBy(F.col(key).alias(k)).agg(F.max(out).alias(o)), values[-1].col == F.col(k), "left").drop(k)
        return Value(F.col(o), kind)

    # reading clauses

    def where(self, e: tuple | None) -> None:
        if e is not None:
            condition = truth(self.value(e, True)) if e[0] not in ("cmp", "in") else self.value(e, True).col
            self.df = self.df.where(condition)

    def join_rows(self, rows: DataFrame) -> None:
        self.df = rows if self.df is None else self.df.crossJoin(rows)

    def scan(self, p: L.NodePattern, var: str) -> None:
        if var in self.bound and self.bound[var].kind == "node":
            if self.open and p.labels:
                self.df = self.df.join(self.graph.labelled(p.labels[0]).select(F.col("node_id").alias("_l")), self.id_of(var) == F.col("_l"), "left_semi")
        else:
            label = p.labels[0] if p.labels else None
            rows = self.graph.labelled(label) if label else self.graph.all_nodes()
            for more in p.labels[1:] if self.open else []:
                rows = rows.join(self.graph.labelled(more).select("node_id"), "node_id", "left_semi")
            rows, bound = self.nodes_as(label, var, rows)
            self.join_rows(rows)
            self.bound[var] = bound
        self.inline(var, p.props)

    def inline(self, var: str, props: dict[str, tuple]) -> None:
        for name, e in props.items():
            self.df = self.df.where(self.value(("cmp", "=", ("prop", var, name), e), True).col)

    def expand(self, start: str, r: L.RelPattern, p: L.NodePattern, end: str) -> None:
        kinds = r.types if self.open else r.types[:1]
        edge = self.graph.any_edges(kinds)
        var = r.var or self.fresh()
        if self.hop_by_key(edge, var, start, r, p, end):
            return
        rows, props = self.prefixed(edge.rows, var, "edge_id")
        at, to = f"{var}{SEP}from", f"{var}{SEP}to"
        out = rows.withColumnsRenamed({"src": at, "dst": to})
        back = rows.withColumnsRenamed({"dst": at, "src": to})
        rows = {"out": out, "in": back}.get(r.way)
        if rows is None:
            rows = out.unionByName(back)
        rows = rows.drop("type")
        if self.open and r.props:
            saved = self.df, self.bound
            self.df, self.bound = rows, {**self.bound, var: Bound("edge", props)}
            self.inline(var, r.props)
            rows, (self.df, self.bound) = self.df, saved
        if start not in self.bound or self.bound[start].kind != "node":
            self.df = self.df.where(F.lit(False)).crossJoin(rows)
        else:
            self.df = self.df.join(rows, self.id_of(start) == F.col(f"`{at}`"))
        self.bound[var] = Bound("edge", props)
        again = end in self.bound
        if again and self.open:
            self.df = self.df.where(F.col(f"`{to}`") == self.id_of(end))
        else:
            if again:
                self.forget(end)
            label = {"out": edge.dst_label, "in": edge.src_label}.get(r.way) or (edge.src_label if edge.src_label == edge.dst_label else None)
            nodes, bound = self.nodes_as(label, end)
            self.bound[end] = bound
            self.df = self.df.join(nodes, F.col(f"`{to}`") == self.id_of(end))
            self.require(end, p.labels, label)
        self.df = self.df.drop(at, to)
        self.inline(end, p.props)

    def forget(self, var: str) -> None:
        self.df = self.df.drop(*[c for c in self.df.columns if c.startswith(f"{var}{SEP}")])

    def require(self, var: str, labels: list[str], known: str | None) -> None:
        for want in labels if self.open else []:
            if want != known:
                self.df = self.df.join(self.graph.labelled(want).select(F.col("node_id").alias("_l")), self.id_of(var) == F.col("_l"), "left_semi")

    def hop_by_key(self, edge, var: str, start: str, r: L.RelPattern, p: L.NodePattern, end: str) -> bool:
        """A hop between keyed labels as a join of whole numbers; where one end's rows are the edges, without an edge table."""
        here, there = ("src", "dst") if r.way == "out" else ("dst", "src")
        a, b = getattr(edge, f"{here}_label"), getattr(edge, f"{there}_label")
        s, again = self.bound.get(start), end in self.bound
        if not edge.keys or r.way == "both" or start == end or s is None or s.key != a or a is None or b not in self.graph.keyed or self.open and r.props:
            return False
        if again and self.open and self.bound[end].key != b:
            return False
        side, column = edge.own or (None, None)
        if side == here and column not in s.props:
            return False
        if again and not self.open:
            self.forget(end)
            again = False
        props: tuple[str, ...] = ()
        to = None
        if side != here and s.many and not again:
            self.spread()
        if side == here:
            to = F.col(f"`{start}{SEP}{column}`").cast("bigint")
        elif side is None:
            rows, props = self.prefixed(edge.rows.drop("src", "dst", "type"), var, "edge_id")
            ends = edge.rows.select(F.col(f"{here}_key").alias(f"{var}{SEP}from"), F.col(f"{there}_key").alias(f"{var}{SEP}to"), F.col("edge_id").alias(f"{var}{SEP}{SEP}id"), *[F.col(f"`{c}`").alias(f"{var}{SEP}{c}") for c in props])
            self.df = self.df.join(ends, self.key_of(start) == F.col(f"`{var}{SEP}from`"))
            to = F.col(f"`{var}{SEP}to`")
        if again:
            self.df = self.df.where((to if to is not None else F.col(f"`{end}{SEP}{column}`").cast("bigint")) == (self.key_of(end) if to is not None else self.key_of(start)))
        else:
            nodes, bound = self.nodes_as(b, end)
            self.bound[end] = replace(bound, many=s.many or side != there)
            if side != here:
                self.bound[start] = replace(s, many=True)
            self.df = self.df.join(nodes, to == self.key_of(end) if to is not None else F.col(f"`{end}{SEP}{column}`").cast("bigint") == self.key_of(start))
        if side is not None:
            ids = (self.id_of(start), self.id_of(end)) if r.way == "out" else (self.id_of(end), self.id_of(start))
            self.df = self.df.withColumn(f"{var}{SEP}{SEP}id", F.concat_ws("|", ids[0], F.lit(edge.kind), ids[1]))
        else:
            self.df = self.df.drop(f"{var}{SEP}from", f"{var}{SEP}to")
        self.bound[var] = Bound("edge", props, told=edge.kind)
        self.require(end, p.labels, b)
        self.inline(end, p.props)
        return True

    def spread(self) -> None:
        """Rows dealt evenly over tasks before a hop that gives many rows for each: a small file is one task's, and few nodes
        that many rows share are few tasks'."""
        self.df = self.df.repartition(int(self.graph.spark.conf.get("spark.sql.shuffle.partitions")))

    def match(self, c: L.Match) -> None:
        if c.optional and self.open and self.df is not None:
            return self.optional(c)
        for path in c.paths:
            if self.limits.depth is not None and len(path.rels) > self.limits.depth:
                raise L.QueryError(f"a path of over {self.limits.depth} hops")
            names = [n.var or self.fresh() for n in path.nodes]
            self.scan(path.nodes[0], names[0])
            used: list[str] = []
            for i, r in enumerate(path.rels):
                before = set(self.bound)
                self.expand(names[i], r, path.nodes[i + 1], names[i + 1])
                edge = next(iter(k for k, b in self.bound.items() if k not in before and b.kind == "edge"), None)
                if self.open and edge:  # a relationship is walked once in a path
                    told = self.bound[edge].told
                    for other in used:
                        if told is None or self.bound[other].told in (None, told):  # ids that tell of two types differ
                            self.df = self.df.where(self.id_of(edge) != self.id_of(other))
                    used.append(edge)
        self.where(c.where)

    def optional(self, c: L.Match) -> None:
        """Left outer: matched from the rows so far, which keep a number, then joined back to them."""
        row = self.fresh()
        left, known = self.df.withColumn(row, F.monotonically_increasing_id()), dict(self.bound)
        self.df = left
        self.match(replace(c, optional=False))
        new = [x for x in self.df.columns if x not in left.columns]
        self.df = left.join(self.df.select(row, *[F.col(f"`{x}`") for x in new]), row, "left").drop(row)
        self.bound = {**known, **self.bound}

    def unwind(self, c: L.Unwind) -> None:
        if self.df is None:
            self.df = self.graph.spark.range(1).select()
        v = self.value(c.expr)
        if not isinstance(v.type, T.ArrayType):
            self.df = self.df.where(F.lit(False)).withColumn(c.var, F.lit(None))
            self.bound[c.var] = Bound("value", type=T.NullType())
        else:
            self.df = self.df.select("*", F.explode(v.col).alias(c.var))
            self.bound[c.var] = Bound("value", type=v.type.elementType)

    def project(self, c: L.Projection) -> None:
        if self.df is None:
            self.df = self.graph.spark.range(1).select()
        names, cols, kinds, kept = [], [], {}, {}
        for e, alias in c.items:
            name = alias or {"var": lambda e: e[1], "prop": lambda e: f"{e[1]}.{e[2]}"}.get(e[0], lambda e: "expr")(e)
            if name in names:
                raise L.QueryError(f"two columns named {name}: give one an alias")
            v = self.value(e)
            names.append(name)
            cols.append(v.col.alias(name))
            kinds[name] = v.type
            if e[0] == "var" and self.open and not c.final and self.bound.get(e[1], Bound("value")).kind != "value":
                kept[name] = e[1]
        extra, order = [], []
        for e, ascending in c.order:
            name = e[1] if e[0] == "var" else f"{e[1]}.{e[2]}" if e[0] == "prop" else None
            if name in names and (e[0] == "var" or self.open):
                order += sort_keys(Value(F.col(f"`{name}`"), kinds[name]), ascending)
            elif self.open and not c.distinct:
                v, hidden = self.value(e), self.fresh()
                extra.append(v.col.alias(hidden))
                order += sort_keys(Value(F.col(hidden), v.type), ascending)
            elif name is not None and (e[0] == "prop" or name not in names):
                self.meta.warnings.append(f"ORDER BY {name}: not an output name, rows are not sorted by it")
        for new, old in kept.items():
            extra += [F.col(f"`{x}`").alias(new + x[len(old) :]) for x in self.df.columns if x.startswith(f"{old}{SEP}")]
        self.df = self.df.select(*cols, *extra)
        if c.distinct:
            self.df = self.df.dropDuplicates(names)
        before = self.bound
        self.bound = {n: Bound("value", type=kinds[n]) for n in names} | {n: before[o] for n, o in kept.items()}
        if c.where is not None:
            self.where(c.where)
        if order:
            rest = [F.col(f"`{n}`") for n in names if not isinstance(kinds[n], (T.MapType,))]
            self.df = self.df.orderBy(*order, *rest)
        skip, limit = self.count(c.skip, "SKIP"), self.count(c.limit, "LIMIT")
        if (c.skip or c.limit) and not order:
            self.df = self.df.orderBy(*[F.col(f"`{n}`") for n in names])
        if skip:
            self.df = self.df.offset(skip)
        if c.limit is not None:
            self.df = self.df.limit(limit)
        if c.final:
            self.df = self.df.select(*[F.col(f"`{n}`") for n in names])
            self.projected = True

    def count(self, e: tuple | None, what: str) -> int:
        if e is None:
            return 0
        n = self.value(e).constant
        if n is None:
            return 0
        if not isinstance(n, int) or isinstance(n, bool) or n < 0:
            raise L.QueryError(f"{what} takes a whole number from 0 on")
        return n

    # procedures

    def call(self, c: L.Call) -> None:
        known = {"vector.searchExact": ("node", "score"), "vector.searchApprox": ("node", "score"), "kv.put": ("version",), "kv.delete": ("version",)}
        if c.name not in known:
            raise L.QueryError(f"unknown procedure {c.name}")
        unknown = set(c.wanted) - set(known[c.name])
        if unknown:
            raise L.QueryError(f"{c.name} has no column {', '.join(sorted(unknown))}")
        if c.name.startswith("kv."):
            self.write_records(c)
        else:
            self.nearest(c)

    def nearest(self, c: L.Call) -> None:
        """The k nearest of a vector; for rows with vectors of their own, of each row's (asked once for equal ones)."""
        if len(c.args) < 3:
            raise L.QueryError(f"{c.name} takes an index, a vector and a number")
        index, query, k = (self.value(a) for a in c.args[:3])
        options = self.value(c.args[3]).constant if len(c.args) > 3 else {}
        if index.constant not in self.graph.indexes:
            raise L.QueryError(f"unknown vector index {index.constant}")
        vector = isinstance(query.constant, list) if query.literal else isinstance(query.type, T.ArrayType)
        if not vector or not isinstance(k.constant, int):
            raise L.QueryError(f"{c.name}: the vector must be a list of numbers and k a whole number")
        ix = self.graph.indexes[index.constant]
        rows, approximate = ix.rows, c.name == "vector.searchApprox" and ix.approximate is not None
        if query.literal:
            rows = ix.approximate.candidates(rows, query.constant, options.get("efSearch")) if approximate else rows
            hits, asked = vectors.top_k(rows, query.constant, k.constant, ix.metric), None
        else:
            asked = self.fresh()
            self.df = self.df.withColumn(asked, query.col)
            each = self.df.where(F.col(asked).isNotNull()).select(F.col(asked).alias("query_id"), F.col(asked).alias("query")).distinct()
            hits = vectors.batch_top_k(rows, each, k.constant, ix.metric).withColumnRenamed("query_id", "_asked")
        keyed = ix.label in self.graph.keyed and "node_key" in rows.columns
        hits = hits.select(F.col("node_key").alias("_hit") if keyed else F.coalesce("node_id", F.col("id").cast("string")).alias("_hit"), "score", *(["_asked"] if asked else []))
        bound, name = Bound("node"), f"node{SEP}{SEP}{'key' if keyed else 'id'}"
        if ix.label:
            nodes, bound = self.nodes_as(ix.label, "node") if keyed else (lambda x: (x[0], Bound("node", x[1], labels=(ix.label,))))(self.prefixed(self.graph.labelled(ix.label), "node", "node_id"))
            hits = hits.join(nodes, F.col("_hit") == F.col(f"`{name}`"), "left")
        hits = hits.withColumn(name, F.col("_hit")).drop("_hit")
        if asked is None:
            self.join_rows(hits)
        else:
            self.df = self.df.join(hits, F.col(asked) == F.col("_asked")).drop(asked, "_asked")
        self.bound |= {"node": bound, "score": Bound("value", type=T.DoubleType())}

    def write_records(self, c: L.Call) -> None:
        """Each row puts (namespace, key, value) or deletes (namespace, key); of rows with one key the greatest value stays."""
        count = 3 if c.name == "kv.put" else 2
        if len(c.args) != count:
            raise L.QueryError(f"{c.name} takes {count} arguments")
        values = [self.value(a) for a in c.args]
        if any(v.family not in ("str", "bytes") for v in values):
            raise L.QueryError(f"{c.name} takes strings")
        rows = self.df if self.df is not None else self.graph.spark.range(1).select(F.lit(1).alias("_one"))
        new = rows.select(*[v.col.alias(n) for v, n in zip(values, ("namespace", "key", "value"), strict=False)]).where("namespace is not null and key is not null")
        old = self.graph.kv
        keys = new.select("namespace", "key").distinct()
        kept = None if old is None else old.join(keys, ["namespace", "key"], "left_anti")
        if c.name == "kv.put":
            new = new.groupBy("namespace", "key").agg(F.max("value").alias("value"))
            kept = new if kept is None else kept.select("namespace", "key", "value").unionByName(new)
        self.graph = replace(self.graph, kv=kept, writes=self.graph.writes + 1)
        self.df = rows.withColumn("version", F.lit(self.graph.writes).cast("bigint"))
        self.bound["version"] = Bound("value", type=T.LongType())

    # writes: each gives a new graph

    def create(self, c: L.Create) -> None:
        rows = self.df if self.df is not None else self.graph.spark.range(1).select(F.lit(1).alias("_one"))
        held, self.df = self.df, rows
        seq = 0
        for path in c.paths:
            ids: list[Column] = []
            labels: list[str | None] = []
            for p in path.nodes:
                if p.var in self.bound and self.bound[p.var].kind == "node":
                    ids.append(self.id_of(p.var))
                    labels.append((self.bound[p.var].labels or (None,))[0])
                    continue
                values = {k: self.value(e) for k, e in p.props.items()}
                own = values.get("id")
                node = own.col if own is not None and own.family == "str" else F.lit(f"_n{seq}")
                seq += 1
                if len(p.labels) > 1:
                    self.graph = replace(self.graph, overlapping=True)
                for label in p.labels or ["_"]:
                    made = self.df.select(node.alias("node_id"), *[v.col.alias(k) for k, v in values.items()])
                    self.graph = self.graph.with_nodes(label, made.dropDuplicates(["node_id"]))
                ids.append(node)
                labels.append(p.labels[0] if p.labels else "_")
            for i, r in enumerate(path.rels):
                a, b = (i + 1, i) if r.way == "in" else (i, i + 1)
                kind = r.types[0] if r.types else "_"
                values = {k: self.value(e).col.alias(k) for k, e in r.props.items()}
                edge = self.df.select(F.concat_ws("|", ids[a], F.lit(kind), ids[b]).alias("edge_id"), ids[a].alias("src"), ids[b].alias("dst"), *values.values())
                self.graph = self.graph.with_edges(kind, edge.dropDuplicates(["edge_id"]), labels[a], labels[b])
        self.df = held

    def set(self, c: L.SetProps) -> None:
        for var, prop, e in c.items:
            if self.bound.get(var, Bound("value")).kind != "node":
                continue
            v = self.value(e)
            new = self.df.select(self.id_of(var).alias("_id"), v.col.alias("_new")).groupBy("_id").agg(F.max("_new").alias("_new"))
            nodes = dict(self.graph.nodes)
            for label in self.bound[var].labels or tuple(nodes):
                rows = nodes[label]
                old = F.col(f"`{prop}`") if prop in rows.columns else F.lit(None).cast(v.type)
                nodes[label] = rows.join(new, rows["node_id"] == new["_id"], "left").withColumn(prop, F.when(F.col("_id").isNotNull(), F.col("_new")).otherwise(old)).drop("_id", "_new")
            self.graph = replace(self.graph.unkeyed(*(self.bound[var].labels or tuple(nodes))), nodes=nodes)

    def delete(self, c: L.Delete) -> None:
        for var in c.names:
            b = self.bound.get(var)
            if b is None or b.kind == "value":
                continue
            gone = self.df.select(self.id_of(var).alias("_id")).distinct()
            if b.kind == "node":  # edges to it stay, and no pattern reaches them any more
                nodes = dict(self.graph.nodes)
                for label in b.labels if b.labels and not self.graph.overlapping else tuple(nodes):
                    nodes[label] = nodes[label].join(gone, nodes[label]["node_id"] == gone["_id"], "left_anti")
                self.graph = replace(self.graph, nodes=nodes)
            else:
                self.graph = replace(self.graph, edges={k: replace(t, rows=t.rows.join(gone, t.rows["edge_id"] == gone["_id"], "left_anti"), own=None) for k, t in self.graph.edges.items()})

    def result(self, clauses: list) -> Result:
        steps = {L.Match: self.match, L.Unwind: self.unwind, L.Projection: self.project, L.Call: self.call, L.Create: self.create, L.SetProps: self.set, L.Delete: self.delete}
        for c in clauses:
            steps[type(c)](c)
            most = self.limits.intermediate
            if most is not None and self.df is not None and self.df.limit(most + 1).count() > most:
                raise L.QueryError(f"over {most} rows between clauses")
        if self.df is None:
            self.df = self.graph.spark.createDataFrame([], "empty string").drop("empty")
        elif not self.projected:
            names = [n for n in self.bound if not n.startswith("_")]
            self.df = self.df.select(*[(F.col(f"`{n}`") if self.bound[n].kind == "value" else self.id_of(n)).alias(n) for n in names])
        return Result(self.df, self.graph, self.meta)


def run(graph: Graph, text: str, params: dict | None = None, rules: str = "classic", limits: Limits = Limits()) -> Result:  # noqa: B008
    """Plans a query. Nothing is computed until the result's rows are asked for; writes show in result.graph."""
    return Planner(graph, params or {}, rules, limits).result(L.parse(text))
