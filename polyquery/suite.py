"""The queries of this engine over the test tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyquery.operators import budget, collections, explore, history, kv, statistics, vectors
from polyquery.plans.planner import run
from polyquery.sources.catalog import Graph, tpch_graph

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}
NOW = 1_706_600_000_000  # a fixed clock for expiry, in milliseconds


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        _queries[name] = f
        if sql:
            _sql[name] = sql
        return f

    return add


def pattern(name: str, text: str, sql: str, params: dict | None = None, rules: str = "classic", graph=tpch_graph) -> None:
    query(name, sql)(lambda spark, d: run(graph(spark, d), text, params, rules).df)


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def millis(ts):
    """Milliseconds of a timestamp without zone, taken as UTC, whatever the session's zone is."""
    return F.unix_millis(F.from_utc_timestamp(F.col(ts).cast("timestamp"), F.current_timezone()))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(tpch_graph(spark, sf_dir), "MATCH (c:Customer)-[:LOCATED_IN]->(n:Nation)-[:IN_REGION]->(r:Region) WHERE c.c_acctbal > 5000 RETURN c.c_name AS name, n.n_name AS nation, r.r_name AS region").df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# patterns: scans, filters, expansion

pattern("label_scan", "MATCH (c:Customer) RETURN c AS id, c.c_name AS name", "SELECT 'customer:' || c_custkey AS id, c_name AS name FROM customer")
pattern("all_nodes_scan", "MATCH (n) RETURN n AS id", " UNION ALL ".join(f"SELECT '{p}:' || {k} AS id FROM {t}" for p, k, t in (("region", "r_regionkey", "region"), ("nation", "n_nationkey", "nation"), ("customer", "c_custkey", "customer"), ("supplier", "s_suppkey", "supplier"), ("part", "p_partkey", "part"), ("order", "o_orderkey", "orders"))))
pattern("property_filter", "MATCH (c:Customer) WHERE c.c_acctbal > 5000 RETURN c.c_name AS name, c.c_acctbal AS balance", "SELECT c_name AS name, c_acctbal AS balance FROM customer WHERE c_acctbal > 5000 OR c_acctbal IS NULL")
pattern("property_seek_eq", "MATCH (p:Part {p_size: 7}) RETURN p AS id, p.p_name AS name", "SELECT 'part:' || p_partkey AS id, p_name AS name FROM part WHERE p_size = 7")
pattern("property_seek_gte", "MATCH (p:Part) WHERE p.p_size >= 40 RETURN p AS id, p.p_size AS size", "SELECT 'part:' || p_partkey AS id, p_size AS size FROM part WHERE p_size >= 40 OR p_size IS NULL")
pattern("node_by_id", "MATCH (c:Customer) WHERE c = 'customer:17' RETURN c.c_name AS name", "SELECT c_name AS name FROM customer WHERE c_custkey = 17")
pattern("expand_out", "MATCH (c:Customer)-[:LOCATED_IN]->(n) RETURN c.c_name AS name, n.n_name AS nation", "SELECT c_name AS name, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey")
pattern("expand_in", "MATCH (n:Nation)<-[:BASED_IN]-(s) RETURN n.n_name AS nation, s.s_name AS supplier", "SELECT n_name AS nation, s_name AS supplier FROM nation JOIN supplier ON s_nationkey = n_nationkey")
pattern(
    "expand_both",
    "MATCH (n:Nation)-[:IN_REGION]-(m) RETURN n AS a, m AS b",
    "SELECT 'nation:' || n_nationkey AS a, 'region:' || n_regionkey AS b FROM nation",
)
pattern("two_hop", "MATCH (c:Customer)-[:LOCATED_IN]->(n)-[:IN_REGION]->(r) RETURN c.c_name AS name, r.r_name AS region", "SELECT c_name AS name, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
pattern(
    "three_hop",
    "MATCH (n:Nation {n_nationkey: 3})<-[:LOCATED_IN]-(c)-[:PLACED]->(o)-[l:CONTAINS]->(p) WHERE l.l_quantity > 40 RETURN c.c_name AS name, o.o_orderkey AS ord, p.p_name AS part, l.l_linenumber AS line",
    "SELECT c_name AS name, o_orderkey AS ord, p_name AS part, l_linenumber AS line FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE c_nationkey = 3 AND l_quantity > 40",
)
pattern(
    "filtered_expand",
    "MATCH (c:Customer)-[:PLACED]->(o:Order) WHERE o.o_totalprice > 100000.0 AND c.c_mktsegment = 'BUILDING' RETURN c.c_name AS name, o.o_orderkey AS ord, o.o_totalprice AS price",
    "SELECT c_name AS name, o_orderkey AS ord, o_totalprice AS price FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 100000 AND c_mktsegment = 'BUILDING'",
)
pattern("cross_product", "MATCH (a:Region), (b:Nation) RETURN a.r_name AS a, b.n_name AS b", "SELECT r_name AS a, n_name AS b FROM region, nation")
pattern("theta_match", "MATCH (a:Nation), (b:Nation) WHERE a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey RETURN a.n_name AS a, b.n_name AS b", "SELECT x.n_name AS a, y.n_name AS b FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey AND x.n_nationkey < y.n_nationkey")
pattern("shared_variable", "MATCH (s:Supplier)-[:BASED_IN]->(n), (n)-[:IN_REGION]->(r) RETURN s.s_name AS supplier, r.r_name AS region", "SELECT s_name AS supplier, r_name AS region FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
pattern("cycle_open", "MATCH (c:Customer)-[:LOCATED_IN]->(n)<-[:BASED_IN]-(s), (s)-[:BASED_IN]->(n) WHERE c.c_custkey < 50 RETURN c.c_name AS name, s.s_name AS supplier", "SELECT c_name AS name, s_name AS supplier FROM customer JOIN supplier ON s_nationkey = c_nationkey WHERE c_custkey < 50", rules="open")
pattern(
    "optional_open",
    "MATCH (c:Customer) WHERE c.c_custkey <= 300 OPTIONAL MATCH (c)-[:PLACED]->(o) WHERE o.o_totalprice > 200000.0 RETURN c.c_name AS name, o.o_orderkey AS ord",
    "SELECT c_name AS name, o_orderkey AS ord FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 200000 WHERE c_custkey <= 300",
    rules="open",
)
pattern("optional_classic", "MATCH (c:Customer) WHERE c.c_custkey <= 300 OPTIONAL MATCH (c)-[:PLACED]->(o) RETURN c.c_name AS name, o.o_orderkey AS ord", "SELECT c_name AS name, o_orderkey AS ord FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_custkey <= 300")
pattern("edge_types_open", "MATCH (o:Order {o_orderkey: 1})-[e:CONTAINS|SUPPLIED_BY]->(x) RETURN e AS edge, x AS id", "SELECT 'order:' || l_orderkey || '|CONTAINS|part:' || l_partkey || '|' || l_linenumber AS edge, 'part:' || l_partkey AS id FROM lineitem WHERE l_orderkey = 1 UNION ALL SELECT 'order:' || l_orderkey || '|SUPPLIED_BY|supplier:' || l_suppkey || '|' || l_linenumber, 'supplier:' || l_suppkey FROM lineitem WHERE l_orderkey = 1", rules="open")

# the same over all customers

pattern("cycle_open_all", "MATCH (c:Customer)-[:LOCATED_IN]->(n)<-[:BASED_IN]-(s), (s)-[:BASED_IN]->(n) RETURN c.c_name AS name, s.s_name AS supplier", "SELECT c_name AS name, s_name AS supplier FROM customer JOIN supplier ON s_nationkey = c_nationkey", rules="open")
pattern(
    "optional_open_all",
    "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o) WHERE o.o_totalprice > 200000.0 RETURN c.c_name AS name, o.o_orderkey AS ord",
    "SELECT c_name AS name, o_orderkey AS ord FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 200000",
    rules="open",
)
pattern("optional_classic_all", "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o) RETURN c.c_name AS name, o.o_orderkey AS ord", "SELECT c_name AS name, o_orderkey AS ord FROM customer JOIN orders ON o_custkey = c_custkey")

# expressions and projections

pattern("unwind", "UNWIND [1, 2, 3] AS x MATCH (r:Region) WHERE r.r_regionkey < x RETURN x, r.r_name AS region", "SELECT x::BIGINT AS x, r_name AS region FROM (SELECT unnest([1, 2, 3]) AS x), region WHERE r_regionkey < x")
pattern(
    "with_pipeline",
    "MATCH (c:Customer) WITH c.c_name AS name, c.c_acctbal AS balance ORDER BY balance DESC LIMIT 50 WHERE balance > 9000 RETURN name, balance",
    "SELECT * FROM (SELECT c_name AS name, c_acctbal AS balance FROM customer WHERE c_acctbal > 9000 OR c_acctbal IS NULL ORDER BY balance DESC NULLS FIRST, name LIMIT 50)",
)
pattern("return_distinct", "MATCH (p:Part) RETURN DISTINCT p.p_brand AS brand, p.p_size AS size", "SELECT DISTINCT p_brand AS brand, p_size AS size FROM part")
pattern("order_skip_limit", "MATCH (o:Order) RETURN o.o_orderkey AS ord, o.o_totalprice AS price ORDER BY price DESC, ord SKIP 10 LIMIT 25", "SELECT o_orderkey AS ord, o_totalprice AS price FROM orders ORDER BY price DESC, ord LIMIT 25 OFFSET 10")
pattern("null_compare", "MATCH (p:Part) WHERE p.nothing > 5 AND NOT p.nothing < 'x' OR p.nothing = null RETURN p AS id", "SELECT 'part:' || p_partkey AS id FROM part")
pattern("int_division", "MATCH (p:Part) RETURN p.p_partkey AS k, (0 - p.p_partkey) / p.p_size AS q, p.p_partkey / 0 AS z, p.p_retailprice / p.p_size AS d", "SELECT p_partkey AS k, CASE WHEN p_size = 0 THEN 0 ELSE -p_partkey // p_size END::BIGINT AS q, 0::BIGINT AS z, p_retailprice / p_size AS d FROM part")
pattern("arithmetic", "MATCH (o:Order) RETURN o.o_orderkey * 2 + 1 AS a, o.o_totalprice - 0.5 AS b, o.o_orderstatus + 'x' AS c", "SELECT (o_orderkey * 2 + 1)::BIGINT AS a, o_totalprice - 0.5 AS b, NULL AS c FROM orders")
pattern("in_list", "MATCH (c:Customer) WHERE c.c_mktsegment IN ['BUILDING', 'MACHINERY'] AND c.c_nationkey IN $keys RETURN c.c_name AS name", "SELECT c_name AS name FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey IN (1, 2, 3)", params={"keys": [1, 2, 3]})
pattern("boolean_logic", "MATCH (n:Nation) WHERE NOT (n.n_regionkey = 1 OR n.n_regionkey = 2) AND n.n_name RETURN n.n_name AS name", "SELECT n_name AS name FROM nation WHERE n_regionkey NOT IN (1, 2)")


def _kv_graph(spark: SparkSession, d: str) -> Graph:
    from dataclasses import replace

    t = table(spark, d, "nation")
    store = t.select(F.lit("names").alias("namespace"), F.concat(F.lit("R"), "n_regionkey").alias("key"), "n_name").groupBy("namespace", "key").agg(F.min("n_name").alias("value"))
    z = table(spark, d, "customer").select(F.lit("bal").alias("ns"), F.lit("all").alias("coll"), F.col("c_name").alias("member"), F.col("c_acctbal").alias("score"))
    return replace(tpch_graph(spark, d), kv=store, zsets=z, hashes=z.select("ns", "coll", F.col("member").alias("field"), F.col("score").cast("string").alias("value")))


pattern("kv_lookup_join", "UNWIND ['R1', 'R2', 'R9'] AS k RETURN k, kv.get('names', k) AS v", "SELECT k, v FROM (SELECT unnest(['R1', 'R2', 'R9']) AS k) LEFT JOIN (SELECT 'R' || n_regionkey AS key, min(n_name) AS v FROM nation GROUP BY 1) ON k = key", graph=_kv_graph)
pattern("zset_score_join", "MATCH (c:Customer) WHERE c.c_custkey < 100 RETURN c.c_name AS name, zset.score('bal', 'all', c.c_name) AS score", "SELECT c_name AS name, c_acctbal AS score FROM customer WHERE c_custkey < 100", graph=_kv_graph)
pattern("zset_score_join_all", "MATCH (c:Customer) RETURN c.c_name AS name, zset.score('bal', 'all', c.c_name) AS score", "SELECT c_name AS name, c_acctbal AS score FROM customer", graph=_kv_graph)

# vectors: the query vector is that of vec_id 0

_Q = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"
_DIST = {"cosine": f"1 - list_cosine_similarity(embedding::DOUBLE[], {_Q})", "dot": f"-list_inner_product(embedding::DOUBLE[], {_Q})", "l2": f"list_distance(embedding::DOUBLE[], {_Q})"}


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def _first(spark: SparkSession, d: str) -> list[float]:
    return [float(x) for x in table(spark, d, "embeddings").where("vec_id = 0").select("embedding").first()[0]]


for _m in _DIST:

    @query(f"vector_exact_{_m}", f"SELECT vec_id AS id, round({_DIST[_m]}, 5) AS distance FROM embeddings ORDER BY {_DIST[_m]}, vec_id LIMIT 10")
    def _exact(spark, d, m=_m):
        return vectors.top_k(_vectors(spark, d), _first(spark, d), 10, m).select("id", F.round("distance", 5).alias("distance"))


@query("vector_filtered", f"SELECT vec_id AS id, round({_DIST['cosine']}, 5) AS distance FROM embeddings WHERE label = 3 ORDER BY {_DIST['cosine']}, vec_id LIMIT 10")
def _filtered(spark, d):
    return vectors.top_k(_vectors(spark, d), _first(spark, d), 10, where=F.col("label") == 3).select("id", F.round("distance", 5).alias("distance"))


@query("vector_merge_topk", f"SELECT 'docs' AS collection, vec_id AS id, round({_DIST['l2']}, 5) AS distance FROM embeddings ORDER BY {_DIST['l2']}, vec_id LIMIT 10")
def _merge(spark, d):
    q = _first(spark, d)
    parts = [vectors.top_k(_vectors(spark, d).where(F.col("id") % 3 <= i), q, 10, "l2").select(F.lit("docs").alias("collection"), "id", "distance") for i in range(3)]
    return vectors.merge_top_k(parts, 10).withColumn("distance", F.round("distance", 5))


@query("vector_batch", "SELECT q.vec_id AS query_id, x.vec_id AS id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(x.embedding::DOUBLE[], q.embedding::DOUBLE[]), x.vec_id)::INTEGER AS rank FROM embeddings q, embeddings x WHERE q.vec_id < 3 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(x.embedding::DOUBLE[], q.embedding::DOUBLE[]), x.vec_id) <= 5")
def _batch(spark, d):
    rows = _vectors(spark, d)
    asked = rows.where("id < 3").select(F.col("id").alias("query_id"), F.col("vector").alias("query"))
    return vectors.batch_top_k(rows, asked, 5, "l2").select("query_id", "id", "rank")


@query("hybrid_vector_graph", f"SELECT p_name AS name, round(score, 5) AS score FROM (SELECT vec_id, 1 - ({_DIST['cosine']}) AS score FROM embeddings ORDER BY {_DIST['cosine']}, vec_id::VARCHAR LIMIT 10) JOIN part ON p_partkey = vec_id")
def _hybrid(spark, d):
    df = run(tpch_graph(spark, d), "CALL vector.searchExact('docs', $q, 10) YIELD node, score MATCH (node) RETURN node.p_name AS name, score", {"q": _first(spark, d)}).df
    return df.where("name is not null").withColumn("score", F.round("score", 5))


@query("vector_segment", f"SELECT vec_id AS id, round({_DIST['l2']}, 5) AS distance FROM embeddings WHERE vec_id % 7 <> 1 ORDER BY {_DIST['l2']}, vec_id LIMIT 10")
def _segment(spark, d):
    rows = _vectors(spark, d).drop("label")
    delta = rows.where("id % 7 = 1 or id % 5 = 0").withColumn("tombstone", F.col("id") % 7 == 1)
    return vectors.top_k(vectors.latest(rows, delta), _first(spark, d), 10, "l2").select("id", F.round("distance", 5).alias("distance"))


@query("vector_ids")
def _ids(spark, d):
    return vectors.vector_ids(_vectors(spark, d)).select("id", "vector_id")


LSH, LSH_PROBES = (64, 6, 7), 56  # dimensions, bits, seed; buckets looked into, of 64
IVF_CELLS, IVF_PROBES = 16, 13


@query("lsh_search")
def _lsh(spark, d):
    return vectors.top_k(vectors.Hyperplanes.drawn(*LSH).candidates(_vectors(spark, d), _first(spark, d), LSH_PROBES), _first(spark, d), 10).select("id", F.round("distance", 5).alias("distance"))


@query("ivf_search")
def _ivf(spark, d):
    rows = _vectors(spark, d)
    return vectors.top_k(vectors.Cells.trained(rows, IVF_CELLS, probes=IVF_PROBES).candidates(rows, _first(spark, d)), _first(spark, d), 10, "l2").select("id", F.round("distance", 5).alias("distance"))


# versioned records: events as a log

_LOG = """WITH log AS (
    SELECT 'events' AS namespace, 'user:' || user_id AS key, props AS value, epoch_ms(ts) AS physical, 'c' || (event_id % 2) AS cluster, event_type AS member,
        event_id AS sequence, CASE WHEN event_id % 4 = 0 THEN epoch_ms(ts) + 3600000 END AS expires_at, event_type = 'error' AS tombstone, event_id % 3 AS holder FROM events
), win AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY key ORDER BY physical DESC, cluster DESC, member DESC, sequence DESC) = 1) """


def _log(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    ms = millis("ts")
    v = kv.version(ms, F.lit(0).cast("bigint"), F.concat(F.lit("c"), F.col("event_id") % 2), F.col("event_type"), F.col("event_id"))
    return e.select(F.lit("events").alias("namespace"), F.concat(F.lit("user:"), "user_id").alias("key"), F.col("props").alias("value"), v.alias("version"), F.when(F.col("event_id") % 4 == 0, ms + 3_600_000).alias("expires_at"), (F.col("event_type") == "error").alias("tombstone"))


def _held(spark: SparkSession, d: str) -> DataFrame:
    return _log(spark, d).withColumn("holder", F.col("version.sequence") % 3)


@query("kv_lww_latest", _LOG + "SELECT key, value, sequence, tombstone FROM win")
def _lww(spark, d):
    return kv.winners(_log(spark, d)).select("key", "value", F.col("version.sequence").alias("sequence"), "tombstone")


@query("kv_siblings", _LOG + ", w AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY key, cluster, member ORDER BY physical DESC, sequence DESC) = 1) SELECT key, count(*) AS n, string_agg(sequence::VARCHAR, ',' ORDER BY physical, cluster, member, sequence) AS siblings FROM w GROUP BY key")
def _sib(spark, d):
    s = kv.siblings(_log(spark, d))
    return s.select("key", "n", F.array_join(F.transform("siblings", lambda x: x["version"]["sequence"].cast("string")), ",").alias("siblings"))


@query("kv_live_scan", _LOG + f"SELECT key, value FROM win WHERE NOT tombstone AND (expires_at IS NULL OR expires_at > {NOW}) AND key >= 'user:1' AND key < 'user:5'")
def _scan(spark, d):
    return kv.scan(_log(spark, d), "events", NOW, "user:1", "user:5").rows.select("key", "value")


@query("kv_page", _LOG + f"SELECT key FROM win WHERE NOT tombstone AND (expires_at IS NULL OR expires_at > {NOW}) AND key >= 'user:3' ORDER BY key LIMIT 20")
def _page(spark, d):
    return kv.page(_log(spark, d), "events", NOW, "user:3", 20)[0].select("key")


@query("kv_ttl_sweep", _LOG + f"SELECT key, sequence FROM win WHERE NOT tombstone AND expires_at <= {NOW}")
def _sweep(spark, d):
    return kv.sweep(_log(spark, d), NOW).select("key", F.col("version.sequence").alias("sequence"))


@query("kv_time_travel", _LOG + f"SELECT key, value, sequence FROM log WHERE physical <= {NOW} QUALIFY row_number() OVER (PARTITION BY key ORDER BY physical DESC, cluster DESC, member DESC, sequence DESC) = 1")
def _travel(spark, d):
    return kv.travel(_log(spark, d), NOW).select("key", "value", F.col("version.sequence").alias("sequence"))


@query("kv_multi_get", _LOG + f"SELECT pos, 'user:' || u AS key, value, value IS NOT NULL AS found FROM (SELECT generate_subscripts([5, 3, 99999, 3], 1)::BIGINT - 1 AS pos, unnest([5, 3, 99999, 3]) AS u) LEFT JOIN (SELECT key, value FROM win WHERE NOT tombstone AND (expires_at IS NULL OR expires_at > {NOW})) ON key = 'user:' || u")
def _multi(spark, d):
    wanted = spark.range(4).select(F.col("id").alias("pos"), F.lit("events").alias("namespace"), F.concat(F.lit("user:"), F.element_at(F.array(*map(F.lit, (5, 3, 99999, 3))), (F.col("id") + 1).cast("int"))).alias("key"))
    return kv.multi_get(_log(spark, d), wanted, NOW).select("pos", "key", "value", "found")


@query("kv_routed_merge", _LOG + f"SELECT key, value FROM win WHERE NOT tombstone AND (expires_at IS NULL OR expires_at > {NOW}) ORDER BY key LIMIT 30")
def _routed(spark, d):
    rows = _held(spark, d)
    each = rows.where("holder = 0").unionByName(rows.where("holder = 1")).unionByName(rows.where("holder = 2"))
    return kv.routed(each, NOW, 30).select("key", "value")


@query("kv_holders", _LOG + ", h AS (SELECT key, holder, max(struct_pack(p := physical, c := cluster, m := member, s := sequence)) AS v FROM log GROUP BY ALL) SELECT key, count(*) AS holders, max(v).s AS newest FROM h GROUP BY key")
def _holders(spark, d):
    return kv.holders_of(_held(spark, d)).select("key", F.size("holders").cast("bigint").alias("holders"), F.col("newest.sequence").alias("newest"))


@query("kv_global", _LOG + ", h AS (SELECT key, cluster, member, max(struct_pack(p := physical, c := cluster, m := member, s := sequence)) AS v FROM log GROUP BY ALL) SELECT key, cluster, member, v.s AS sequence, v = max(v) OVER (PARTITION BY key) AS newest FROM h")
def _global(spark, d):
    rows = _log(spark, d).withColumns({"cluster": F.col("version.cluster"), "member": F.col("version.member")})
    return kv.across_clusters(rows).select("key", "cluster", "member", F.col("version.sequence").alias("sequence"), "newest")


@query("live_key_count", _LOG + "SELECT namespace, count(*) AS n FROM win WHERE NOT tombstone GROUP BY namespace")
def _live(spark, d):
    return kv.live_keys(_log(spark, d))


@query("kv_delete_namespace", _LOG + "SELECT key, true AS tombstone FROM win WHERE NOT tombstone")
def _delete(spark, d):
    return kv.delete_namespace(_log(spark, d), "events").select("key", "tombstone")


@query("kv_append_once", "SELECT count(*) AS n FROM events")
def _append(spark, d):
    log = _log(spark, d)
    return kv.append_once(log.where("version.sequence % 2 = 0"), log).agg(F.count("*").alias("n"))


@query("anti_entropy_diff", _LOG + ", a AS (SELECT key, max(struct_pack(p := physical, c := cluster, m := member, s := sequence)) AS v FROM log WHERE holder <> 0 GROUP BY key), b AS (SELECT key, max(struct_pack(p := physical, c := cluster, m := member, s := sequence)) AS v FROM log WHERE holder <> 1 GROUP BY key) SELECT b.key, b.v.s AS sequence FROM b LEFT JOIN a USING (key) WHERE a.v IS NULL OR b.v > a.v")
def _entropy(spark, d):
    rows = _held(spark, d)
    side = lambda h: kv.winners(rows.where(F.col("holder") != h).drop("holder"))
    return kv.anti_entropy(side(0), side(1)).select("key", F.col("version.sequence").alias("sequence"))


@query("under_replicated", _LOG + "SELECT key, count(DISTINCT CASE WHEN holder IN (0, 1) THEN holder END) AS n FROM log GROUP BY key HAVING n < 2")
def _under(spark, d):
    return kv.under_replicated(_held(spark, d), [0, 1], 2).select("key", "n")


# collections

def _commands(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    op = F.when(F.col("event_type") == "error", "remove").otherwise("add")
    return e.select(F.col("event_id").alias("log_index"), op.alias("op"), F.lit("u").alias("ns"), F.concat(F.lit("user:"), F.col("user_id") % 20).alias("coll"), F.concat(F.lit("m"), F.col("event_id") % 50).alias("item"), F.col("props").alias("value"), F.col("value").alias("score"), F.lit(None).cast("bigint").alias("expiry"))


_CMD = "WITH cmd AS (SELECT event_id, event_type = 'error' AS gone, 'user:' || (user_id % 20) AS coll, 'm' || (event_id % 50) AS item, props AS value, value AS score FROM events), st AS (SELECT * FROM (SELECT * FROM cmd QUALIFY row_number() OVER (PARTITION BY coll, item ORDER BY event_id DESC) = 1) WHERE NOT gone) "


@query("set_card", _CMD + "SELECT coll, count(*) AS n FROM st GROUP BY coll")
def _card(spark, d):
    return collections.cardinality(collections.state(_commands(spark, d))).select("coll", "n")


@query("set_members", _CMD + "SELECT item FROM st WHERE coll = 'user:3' ORDER BY item LIMIT 15")
def _members(spark, d):
    return collections.members(collections.state(_commands(spark, d)), "u", "user:3", 15).select("item")


@query("set_contains", _CMD + "SELECT coll, i AS item, item IS NOT NULL AS found FROM (SELECT 'user:' || (x % 20) AS coll, 'm' || (x % 50) AS i FROM range(100) t(x)) LEFT JOIN st USING (coll) WHERE st.item = i UNION ALL SELECT coll, i, false FROM (SELECT 'user:' || (x % 20) AS coll, 'm' || (x % 50) AS i FROM range(100) t(x)) q WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.coll = q.coll AND st.item = q.i)")
def _contains(spark, d):
    asked = spark.range(100).select(F.lit("u").alias("ns"), F.concat(F.lit("user:"), F.col("id") % 20).alias("coll"), F.concat(F.lit("m"), F.col("id") % 50).alias("item"))
    return collections.contains(collections.state(_commands(spark, d)), asked).select("coll", "item", "found")


@query("hash_getall", _CMD + "SELECT item, value FROM st WHERE coll = 'user:7'")
def _getall(spark, d):
    return collections.members(collections.state(_commands(spark, d)), "u", "user:7").select("item", "value")


@query("hash_incr", "WITH c AS (SELECT user_id % 20 AS g, event_id, event_type, (event_id % 9)::BIGINT AS v FROM events), b AS (SELECT *, max(CASE WHEN event_type IN ('error', 'signup') THEN event_id END) OVER (PARTITION BY g) AS base FROM c) SELECT 'h' || g AS coll, sum(CASE WHEN event_type = 'error' THEN 0 ELSE v END)::BIGINT::VARCHAR AS value FROM b WHERE base IS NULL OR event_id >= base GROUP BY g HAVING max(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) = 1")
def _incr(spark, d):
    op = F.when(F.col("event_type") == "error", "remove").when(F.col("event_type") == "signup", "set").otherwise("incr")
    log = table(spark, d, "events").select(F.lit("u").alias("ns"), F.concat(F.lit("h"), F.col("user_id") % 20).alias("coll"), F.lit("f").alias("item"), F.col("event_id").alias("log_index"), op.alias("op"), (F.col("event_id") % 9).cast("string").alias("value"))
    return collections.incremented(log).select("coll", "value")


@query("zset_range", _CMD + "SELECT item, score FROM st WHERE coll = 'user:4' ORDER BY score, item LIMIT 12")
def _zrange(spark, d):
    return collections.ranged(collections.state(_commands(spark, d)), "u", "user:4", 12).select("item", "score")


@query("bulk_remove", _CMD + "SELECT coll, count(*) AS n FROM st WHERE item IN ('m1', 'm2', 'm3') GROUP BY coll")
def _bulk(spark, d):
    gone = spark.range(1, 4).select(F.concat(F.lit("m"), "id").alias("item"))
    return collections.bulk_remove(collections.state(_commands(spark, d)), gone)[1].select("coll", "n")


@query("list_collections", "SELECT DISTINCT 'user:' || (user_id % 20) AS coll FROM events")
def _list(spark, d):
    return collections.collections(_commands(spark, d).withColumn("kind", F.lit("set"))).select("coll")


@query("sadd_new", _CMD + "SELECT coll, count(*) AS n FROM (SELECT 'user:' || (x % 20) AS coll, 'm' || (x % 60) AS item FROM range(600) t(x) GROUP BY ALL) q WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.coll = q.coll AND st.item = q.item) GROUP BY coll")
def _sadd(spark, d):
    items = spark.range(600).select(F.lit("u").alias("ns"), F.concat(F.lit("user:"), F.col("id") % 20).alias("coll"), F.concat(F.lit("m"), F.col("id") % 60).alias("item"))
    return collections.newly_added(collections.state(_commands(spark, d)), items).select("coll", "n")


# budgets

@query("budget_reported", "WITH l AS (SELECT o_orderkey, o_custkey % 10 AS b, o_totalprice::BIGINT AS amount FROM orders), r AS (SELECT l_orderkey, max((l_extendedprice * 3)::BIGINT) AS m FROM lineitem GROUP BY 1) SELECT b AS budget, sum(least(coalesce(m, 0), amount))::BIGINT AS spent FROM l LEFT JOIN r ON l_orderkey = o_orderkey GROUP BY b")
def _reported(spark, d):
    leases = table(spark, d, "orders").select((F.col("o_custkey") % 10).alias("budget"), F.col("o_orderkey").alias("lease"), F.rint("o_totalprice").cast("bigint").alias("amount"))
    reports = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("lease"), F.rint(F.col("l_extendedprice") * 3).cast("bigint").alias("amount"))
    return budget.reported(reports, leases)


@query("budget_fold")
def _fold(spark, d):
    e = table(spark, d, "events")
    first = e.groupBy((F.col("user_id") % 20).alias("b")).agg(F.min("event_id").alias("first"))
    op = F.when(F.col("event_id") == F.col("first"), "define").when(F.col("event_type") == "purchase", "grant").when(F.col("event_type") == "view", "report").when(F.col("event_type") == "click", "return").when(F.col("event_type") == "error", "expire").otherwise("grant")
    log = e.join(first, F.col("user_id") % 20 == F.col("b")).select(
        F.lit("n").alias("ns"), F.col("b").cast("string").alias("budget"), F.col("event_id").alias("log_index"), op.alias("op"), F.concat(F.lit("l"), F.col("event_id") % 7).alias("lease"), F.lit("h").alias("holder"),
        F.when(F.col("event_id") == F.col("first"), 100_000).otherwise(F.col("value").cast("bigint")).alias("amount"), F.when(F.col("event_id") % 2 == 0, 5000).otherwise(0).alias("ttl"), F.lit(0).alias("rate"), F.lit(0).alias("burst"), F.lit(0).alias("pause"), millis("ts").alias("now"),
    )
    return budget.fold(log)


# statistics

@query("distinct_keys_hll", "SELECT true AS near")
def _hll(spark, d):
    n = table(spark, d, "events").select(F.count_distinct("user_id").alias("exact"))
    sketches = statistics.key_sketches(table(spark, d, "events"), ["event_type"], "user_id")
    return statistics.distinct_keys(sketches).crossJoin(n).select((F.abs(F.col("n") - F.col("exact")) <= F.greatest(F.lit(2), 0.05 * F.col("exact"))).alias("near"))


@query("p95_last64", "WITH r AS (SELECT event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 64), s AS (SELECT event_type, list_sort(list(value)) AS x FROM r GROUP BY 1) SELECT event_type, x[floor(0.95 * (len(x) - 1))::INTEGER + 1] AS value FROM s")
def _p95(spark, d):
    return statistics.last_quantile(table(spark, d, "events"), ["event_type"], ["ts", "event_id"], "value")


@query("ewma_rtt", "WITH x AS (SELECT user_id, list(value ORDER BY ts, value) AS v FROM events WHERE user_id < 40 GROUP BY 1) SELECT user_id, round(list_reduce(v, lambda s, a: 0.8 * s + 0.2 * a), 6) AS ewma FROM x")
def _ewma(spark, d):
    return statistics.smoothed(table(spark, d, "events").where("user_id < 40"), ["user_id"], "ts", "value").select("user_id", F.round("ewma", 6).alias("ewma"))


@query("ewma_rtt_all", "WITH x AS (SELECT user_id, list(value ORDER BY ts, value) AS v FROM events GROUP BY 1) SELECT user_id, round(list_reduce(v, lambda s, a: 0.8 * s + 0.2 * a), 6) AS ewma FROM x")
def _ewma_all(spark, d):
    return statistics.smoothed(table(spark, d, "events"), ["user_id"], "ts", "value").select("user_id", F.round("ewma", 6).alias("ewma"))


@query("latency_histogram", "SELECT event_type, CASE WHEN v < 8 THEN v ELSE (floor(log2(v))::INTEGER - 2) * 8 + floor(v / pow(2, floor(log2(v)) - 3))::INTEGER - 8 END::INTEGER AS bucket, count(*) AS n FROM (SELECT event_type, floor(value)::BIGINT AS v FROM events) GROUP BY ALL")
def _hist(spark, d):
    return statistics.histogram(table(spark, d, "events"), ["event_type"], "value")


@query("window_stats", "SELECT event_type, time_bucket(INTERVAL '1 hour', ts) AS start, count(*) AS n, count_if(value < 10) AS errors, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY ALL")
def _window(spark, d):
    return statistics.per_second(table(spark, d, "events"), "ts", ["event_type"], "value", F.col("value") < 10, "1 hour").withColumns({"p50": F.round("p50", 6), "p99": F.round("p99", 6)}).withColumn("start", F.col("start").cast(table(spark, d, "events").schema["ts"].dataType))


@query("placement", "SELECT 's' || s_suppkey AS id, s_acctbal AS score FROM supplier WHERE s_acctbal > 0 ORDER BY s_nationkey <> 3, s_acctbal, 's' || s_suppkey LIMIT 8")
def _place(spark, d):
    m = table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.col("s_acctbal").alias("score"), "s_nationkey")
    return statistics.place(m, 8, F.col("score") > 0, F.col("s_nationkey") == 3).select("id", "score")


# exploring

_NODE = "customer:1"


@query("graph_bfs", """WITH RECURSIVE e AS (
    SELECT 'customer:' || c_custkey AS a, 'nation:' || c_nationkey AS b FROM customer UNION SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey FROM supplier
    UNION SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey FROM nation UNION SELECT 'customer:' || o_custkey, 'order:' || o_orderkey FROM orders
    UNION SELECT 'order:' || l_orderkey, 'part:' || l_partkey FROM lineitem UNION SELECT 'order:' || l_orderkey, 'supplier:' || l_suppkey FROM lineitem
), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), w AS (SELECT 'customer:1' AS node_id, 0 AS hops UNION SELECT b, hops + 1 FROM w JOIN u ON a = node_id WHERE hops < 2)
SELECT node_id, min(hops)::INTEGER AS hops FROM w GROUP BY 1""")
def _bfs(spark, d):
    return explore.reached(tpch_graph(spark, d), spark.createDataFrame([(_NODE,)], "node_id string"), 2)


@query("induced_subgraph", "SELECT 'nation:' || n_nationkey AS src, 'region:' || n_regionkey AS dst FROM nation WHERE n_regionkey IN (0, 1)")
def _induced(spark, d):
    g = tpch_graph(spark, d)
    ids = g.labelled("Nation").select("node_id").unionByName(spark.createDataFrame([("region:0",), ("region:1",)], "node_id string"))
    return explore.induced(g, ids).select("src", "dst")


# history checks over events: a session is a user, a key its event type, a version the value

def _reads(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.lit("read").alias("kind"), F.col("event_type").alias("key"), F.col("user_id").alias("session"), millis("ts").alias("start_ms"), F.col("event_id").alias("end_ms"), F.col("value").alias("observed"), "event_id")


@query("history_session_monotonicity", "WITH r AS (SELECT event_id, value, max(value) OVER (PARTITION BY user_id, event_type ORDER BY epoch_ms(ts), event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM events) SELECT event_id, best FROM r WHERE value < best")
def _session(spark, d):
    return history.session_monotonicity(_reads(spark, d)).select("event_id", "best")


@query("history_budget_cap", "WITH r AS (SELECT o_custkey, o_orderkey, sum(greatest(o_totalprice::BIGINT, 0)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM orders) SELECT o_custkey AS budget, o_orderkey AS ord, running FROM r WHERE running > 500000 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY running, o_orderkey) = 1")
def _cap(spark, d):
    spends = table(spark, d, "orders").select(F.col("o_custkey").alias("budget"), F.col("o_orderkey").alias("ord"), "o_orderdate", F.rint("o_totalprice").cast("bigint").alias("units"))
    return history.budget_cap(spends, ["budget"], ["o_orderdate", "ord"], "units", F.lit(500_000)).select("budget", "ord", "running")


@query("history_lww_check", "WITH w AS (SELECT event_type AS key, max(value) AS newest FROM events WHERE event_id % 2 = 0 GROUP BY 1) SELECT event_id FROM events JOIN w ON event_type = key WHERE event_id % 2 = 1 AND value <> newest")
def _lww_check(spark, d):
    rows = _reads(spark, d).withColumns({"policy": F.lit("lww"), "ack": F.lit(True), "written": F.col("observed")})
    writes = rows.where("event_id % 2 = 0").withColumn("kind", F.lit("write"))
    return history.lww_determinism(writes, rows.where("event_id % 2 = 1")).select("event_id")


@query("history_convergence", "SELECT event_type AS key, count(DISTINCT value) AS n FROM events GROUP BY 1 HAVING n > 1")
def _converge(spark, d):
    return history.convergence(_reads(spark, d).withColumn("value", F.col("observed").cast("string"))).select("key", "n")


@query("history_idempotency", "SELECT user_id AS request_id, count(DISTINCT value) AS n FROM events GROUP BY 1 HAVING n > 1")
def _idem(spark, d):
    return history.idempotency(_reads(spark, d).withColumns({"kind": F.lit("write"), "request_id": F.col("session"), "written": F.col("observed")})).select("request_id", "n")


from polyquery import suite_more  # noqa: E402, F401  (more queries, registered on import)
