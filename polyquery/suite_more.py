"""More registered queries: writes, procedures, stores, statistics, streams and history checks, each with its SQL."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyquery.operators import budget, collections, explore, history, kv, statistics, vectors
from polyquery.operators.cut import shared_folder
from polyquery.plans.planner import run
from polyquery.sources import catalog
from polyquery.sources.catalog import Graph, VectorIndex, tpch_graph
from polyquery.streaming import changefeed
from polyquery.suite import _CMD, _LOG, IVF_CELLS, IVF_PROBES, NOW, _commands, _first, _held, _kv_graph, _log, _vectors, millis, pattern, query, table

# writes: statements one after another, the last one's rows


def written(name: str, sql: str, *texts: str, rules: str = "classic", graph=tpch_graph) -> None:
    def go(spark: SparkSession, d: str) -> DataFrame:
        g = graph(spark, d)
        for text in texts[:-1]:
            g = run(g, text, rules=rules).graph
        return run(g, texts[-1], rules=rules).df

    query(name, sql)(go)


written("create_nodes", "SELECT c_name AS id, c_acctbal AS balance FROM customer WHERE c_mktsegment = 'BUILDING'", "MATCH (c:Customer) WHERE c.c_mktsegment = 'BUILDING' CREATE (v:Vip {id: c.c_name, balance: c.c_acctbal})", "MATCH (v:Vip) RETURN v AS id, v.balance AS balance")
written("create_edges", "SELECT n_name AS nation, s_name AS supplier FROM nation JOIN supplier ON s_nationkey = n_nationkey", "MATCH (s:Supplier)-[:BASED_IN]->(n) CREATE (n)-[:HOSTS]->(s)", "MATCH (n:Nation)-[:HOSTS]->(s) RETURN n.n_name AS nation, s.s_name AS supplier")
written("set_property", "SELECT n_name AS name, CASE WHEN n_regionkey = 1 THEN n_nationkey + 100 END AS code FROM nation", "MATCH (n:Nation) WHERE n.n_regionkey = 1 SET n.code = n.n_nationkey + 100", "MATCH (n:Nation) RETURN n.n_name AS name, n.code AS code")
written("delete_nodes", "SELECT o_orderkey AS ord FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment <> 'BUILDING'", "MATCH (c:Customer) WHERE c.c_mktsegment = 'BUILDING' DELETE c", "MATCH (c:Customer)-[:PLACED]->(o) RETURN o.o_orderkey AS ord")
written("delete_edges", "SELECT c_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> 2", "MATCH (c:Customer)-[e:LOCATED_IN]->(n) WHERE n.n_regionkey = 2 DELETE e", "MATCH (c:Customer)-[:LOCATED_IN]->(n) RETURN c.c_name AS name")
written("kv_put_call", "SELECT n_name AS name, CASE WHEN n_regionkey <> 1 THEN n_name END AS v FROM nation", "MATCH (n:Nation) CALL kv.put('nat', n.n_name, n.n_name)", "MATCH (n:Nation {n_regionkey: 1}) CALL kv.delete('nat', n.n_name)", "MATCH (n:Nation) RETURN n.n_name AS name, kv.get('nat', n.n_name) AS v")
written("kv_put_version", "SELECT n_name AS name, 2::BIGINT AS version FROM nation", "MATCH (r:Region) CALL kv.put('reg', r.r_name, 'x')", "MATCH (n:Nation) CALL kv.put('nat', n.n_name, 'y') YIELD version RETURN n.n_name AS name, version")
pattern("hash_get", "MATCH (c:Customer) RETURN c.c_name AS name, hash.get('bal', 'seg', c.c_name) AS segment", "SELECT c_name AS name, c_mktsegment AS segment FROM customer", graph=lambda s, d: replace(_kv_graph(s, d), hashes=table(s, d, "customer").select(F.lit("bal").alias("ns"), F.lit("seg").alias("coll"), F.col("c_name").alias("field"), F.col("c_mktsegment").alias("value"))))
pattern("unary_minus", "MATCH (s:Supplier) RETURN s.s_name AS name, -s.s_acctbal AS neg, -(s.s_nationkey + 1) AS k", "SELECT s_name AS name, -s_acctbal AS neg, -(s_nationkey + 1)::BIGINT AS k FROM supplier")
pattern("null_ordering", "MATCH (p:Part) WHERE p.p_size > p.nothing OR NOT p.p_name < null RETURN p AS id", "SELECT 'part:' || p_partkey AS id FROM part WHERE p_name IS NOT NULL")
pattern("anonymous_nodes", "MATCH (:Region), (:Region) RETURN 1 AS one", "SELECT 1::BIGINT AS one FROM region, region r2")
pattern("with_open_entities", "MATCH (n:Nation) WITH n WHERE n.n_regionkey = 2 MATCH (n)<-[:BASED_IN]-(s) RETURN n.n_name AS nation, s AS supplier", "SELECT n_name AS nation, 'supplier:' || s_suppkey AS supplier FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE n_regionkey = 2", rules="open")
pattern("rebind_classic", "MATCH (c:Customer)-[:LOCATED_IN]->(n)<-[:BASED_IN]-(s), (s)-[:BASED_IN]->(n) RETURN c.c_name AS name, s.s_name AS supplier", "SELECT c_name AS name, s_name AS supplier FROM customer JOIN supplier ON s_nationkey = c_nationkey")
pattern("self_loop_both", "MATCH (a:Node)-[:NEXT]-(b) RETURN a AS a, b AS b", "WITH e AS (SELECT n_nationkey AS s, n_regionkey AS t FROM nation) SELECT 'n' || s AS a, 'n' || t AS b FROM e UNION ALL SELECT 'n' || t, 'n' || s FROM e", graph=lambda s, d: _loops(s, d))


def _loops(spark: SparkSession, d: str) -> Graph:
    t = table(spark, d, "nation")
    name = lambda c: F.concat(F.lit("n"), F.col(c).cast("string"))
    edges = t.select(F.concat_ws("|", name("n_nationkey"), F.lit("NEXT"), name("n_regionkey")).alias("edge_id"), name("n_nationkey").alias("src"), name("n_regionkey").alias("dst"))
    return Graph(spark).with_nodes("Node", t.select(name("n_nationkey").alias("node_id"))).with_edges("NEXT", edges, "Node", "Node")


# vectors


def _vector_graph(spark: SparkSession, d: str) -> Graph:
    rows = table(spark, d, "embeddings")
    ids = F.concat(F.lit("vec:"), F.col("vec_id").cast("string"))
    index = VectorIndex(rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), ids.alias("node_id")), "l2", "Vec")
    return Graph(spark, indexes={"vecs": index}).with_nodes("Vec", rows.select(ids.alias("node_id"), "vec_id", "embedding", "label"))


_L2 = "list_distance(x.embedding::DOUBLE[], q.embedding::DOUBLE[])"


@query("vector_call_each_row", f"SELECT q.vec_id AS q, x.vec_id AS found, round(-{_L2}, 5) AS score FROM embeddings q, embeddings x WHERE q.label = 3 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY {_L2}, x.vec_id) <= 3")
def _each_row(spark, d):
    df = run(_vector_graph(spark, d), "MATCH (v:Vec {label: 3}) CALL vector.searchExact('vecs', v.embedding, 3) YIELD node, score RETURN v.vec_id AS q, node.vec_id AS found, score").df
    return df.withColumn("score", -F.round(-F.col("score"), 5))  # the negative of a distance, -0.0 included


@query("vector_search_approx")
def _approx(spark, d):
    """The cells are stored as partitions; the call reads those that it probes and scores what they hold exactly."""
    g = _vector_graph(spark, d)
    ix = g.indexes["vecs"]
    cells = vectors.Cells.trained(ix.rows, IVF_CELLS, probes=IVF_PROBES)
    rows = vectors.stored(ix.rows, cells, f"{shared_folder(spark)}/cells-{uuid.uuid4().hex}")
    g = replace(g, indexes={"vecs": replace(ix, rows=rows, approximate=cells)})
    return run(g, "CALL vector.searchApprox('vecs', $q, 10) YIELD node, score RETURN node AS id, score", {"q": _first(spark, d)}).df


@query("vector_zero_norm", "SELECT vec_id AS id, 1.0::DOUBLE AS distance, 0.0::DOUBLE AS score FROM embeddings ORDER BY vec_id LIMIT 10")
def _zero(spark, d):
    return vectors.top_k(_vectors(spark, d), [0.0] * 64, 10).select("id", "distance", "score")


@query("vector_shorter", "SELECT vec_id AS id, round(list_distance((embedding::DOUBLE[])[1:8], (SELECT (embedding::DOUBLE[])[1:8] FROM embeddings WHERE vec_id = 0)), 5) AS distance FROM embeddings")
def _shorter(spark, d):
    q = vectors.constant(_first(spark, d)[:8])
    return _vectors(spark, d).select("id", F.round(vectors.distance(F.col("vector"), q, "l2", checked=False), 5).alias("distance"))


@query("vector_put", "SELECT label, count(*) AS n FROM embeddings WHERE label <> 2 GROUP BY 1")
def _put(spark, d):
    rows = vectors.vector_ids(_vectors(spark, d))
    after = vectors.put(rows.where("label <> 3"), _vectors(spark, d).where("label = 3"), 64)
    return vectors.removed(after, _vectors(spark, d).where("label = 2")).groupBy("label").agg(F.count("*").alias("n"))


@query("vector_rerank", "SELECT vec_id AS id FROM (SELECT vec_id, embedding FROM embeddings ORDER BY list_distance(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), vec_id LIMIT 40) ORDER BY 1 - list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), vec_id LIMIT 10")
def _rerank(spark, d):
    q = _first(spark, d)
    return vectors.rerank(vectors.top_k(_vectors(spark, d), q, 40, "l2"), q, 10).select("id")


# records


@query("kv_get", _LOG + f"SELECT key, CASE WHEN NOT tombstone THEN value END AS value, NOT tombstone AS found, sequence FROM win WHERE key = 'user:5' AND (expires_at IS NULL OR expires_at > {NOW})")
def _get(spark, d):
    return kv.get(_log(spark, d), "events", "user:5", NOW).select("key", "value", "found", F.col("version.sequence").alias("sequence"))


@query("kv_page_cursor", _LOG + f"SELECT key FROM win WHERE NOT tombstone AND (expires_at IS NULL OR expires_at > {NOW}) AND key >= 'user:3' ORDER BY key LIMIT 1 OFFSET 20")
def _cursor(spark, d):
    return kv.page(_log(spark, d), "events", NOW, "user:3", 20)[1]


@query("kv_winner_and_others", _LOG + ", w AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY key, cluster, member ORDER BY physical DESC, sequence DESC) = 1) SELECT key, max(struct_pack(p := physical, c := cluster, m := member, s := sequence)).s AS winner, count(*) - 1 AS others FROM w GROUP BY key")
def _others(spark, d):
    return kv.with_siblings(_log(spark, d)).select("key", F.col("winner.version.sequence").alias("winner"), F.size("others").cast("bigint").alias("others"))


@query("kv_policies", _LOG + "SELECT 'lww' AS policy, count(DISTINCT key) AS n FROM log UNION ALL SELECT 'other', count(DISTINCT key) FROM log UNION ALL SELECT 'keep-siblings', count(DISTINCT key || cluster || member) FROM log")
def _policies(spark, d):
    one = lambda p, n: kv.resolve(_log(spark, d), p).agg(n.cast("bigint").alias("n")).select(F.lit(p).alias("policy"), "n")
    return one("lww", F.count("*")).unionByName(one("other", F.count("*"))).unionByName(one("keep-siblings", F.sum("n")))


@query("kv_put_replay", "WITH p AS (SELECT user_id, event_id, event_type, 'r' || (event_id % 97) AS idem FROM events), stored AS (SELECT idem, min(event_id) FILTER (WHERE event_type = 'view') AS old, min(event_id) FILTER (WHERE event_type <> 'view') AS new FROM p GROUP BY 1) SELECT idem AS idem_key, coalesce(old, new) AS sequence FROM stored WHERE new IS NOT NULL")
def _replay(spark, d):
    e = table(spark, d, "events")
    v = kv.version(F.lit(0).cast("bigint"), F.lit(0).cast("bigint"), F.lit("c"), F.lit("m"), F.col("event_id"))
    rows = e.select("event_type", F.lit("n").alias("namespace"), F.col("user_id").cast("string").alias("key"), F.col("props").alias("value"), v.alias("version"), F.concat(F.lit("r"), F.col("event_id") % 97).alias("idem_key"))
    log = rows.where("event_type = 'view'").drop("event_type").withColumns({"expires_at": F.lit(None).cast("bigint"), "tombstone": F.lit(False)})
    puts = rows.where("event_type <> 'view'").drop("event_type").withColumn("ttl_ms", F.lit(1000).cast("bigint"))
    return kv.put_once(log, puts, NOW)[1].select("idem_key", F.col("version.sequence").alias("sequence"))


@query("kv_delete_keys", _LOG + "SELECT key, sequence FROM win WHERE NOT tombstone AND key NOT IN (SELECT 'user:' || user_id FROM events WHERE event_type = 'purchase' AND event_id % 10 = 0)")
def _deleted(spark, d):
    log = _log(spark, d)
    v = kv.version(F.lit(1 << 60), F.lit(0).cast("bigint"), F.lit("z"), F.lit("z"), F.lit(0).cast("bigint"))
    gone = table(spark, d, "events").where("event_type = 'purchase' and event_id % 10 = 0").select(F.lit("events").alias("namespace"), F.concat(F.lit("user:"), "user_id").alias("key"), v.alias("version")).distinct()
    return kv.winners(kv.deleted(log, gone)).where("not tombstone").select("key", F.col("version.sequence").alias("sequence"))


@query("kv_clock", "WITH w AS (SELECT event_id, user_id, max(epoch_ms(ts) // 3600000) OVER (PARTITION BY user_id ORDER BY event_id) AS physical FROM events) SELECT event_id, physical, (row_number() OVER (PARTITION BY user_id, physical ORDER BY event_id) - 1)::INTEGER AS logical FROM w")
def _clock(spark, d):
    e = table(spark, d, "events").withColumn("wall", F.floor(millis("ts") / 3_600_000))
    return kv.ticked(e, "user_id", "event_id", "wall").select("event_id", "physical", "logical")


@query("kv_range_digests", _LOG + "SELECT substr(key, 1, 6) AS part, count(*) AS n, sum(('0x' || substr(md5(concat_ws('|', 'events', key, (epoch_us(ts) // 1000)::VARCHAR, '0', cluster, member, sequence::VARCHAR)), 1, 15))::BIGINT)::VARCHAR AS digest FROM win JOIN events ON event_id = sequence GROUP BY 1")
def _digests(spark, d):
    return kv.range_digests(kv.winners(_log(spark, d)), F.substring("key", 1, 6))


@query("kv_diverged_ranges", _LOG + ", a AS (SELECT key, max(struct_pack(p := physical, c := cluster, m := member, s := sequence)) AS v FROM log WHERE holder <> 0 GROUP BY key), b AS (SELECT key, max(struct_pack(p := physical, c := cluster, m := member, s := sequence)) AS v FROM log WHERE holder <> 1 GROUP BY key) SELECT DISTINCT substr(key, 1, 7) AS part FROM a FULL JOIN b USING (key) WHERE a.v IS DISTINCT FROM b.v")
def _diverged(spark, d):
    rows = _held(spark, d)
    side = lambda h: kv.range_digests(kv.winners(rows.where(F.col("holder") != h).drop("holder")), F.substring("key", 1, 7)).select("part", F.col("digest").alias(f"d{h}"))
    return side(0).join(side(1), "part", "full").where(~F.col("d0").eqNullSafe(F.col("d1"))).select("part")


@query("kv_only_held", _LOG + ", a AS (SELECT key, max(struct_pack(p := physical, c := cluster, m := member, s := sequence)) AS v FROM log WHERE holder = 0 GROUP BY key), b AS (SELECT key, max(struct_pack(p := physical, c := cluster, m := member, s := sequence)) AS v FROM log WHERE holder <> 0 GROUP BY key) SELECT b.key, b.v.s AS sequence FROM b JOIN a USING (key) WHERE b.v > a.v")
def _only_held(spark, d):
    rows = _held(spark, d)
    return kv.anti_entropy(kv.winners(rows.where("holder = 0").drop("holder")), kv.winners(rows.where("holder <> 0").drop("holder")), only_held=True).select("key", F.col("version.sequence").alias("sequence"))


@query("kv_under_target", "SELECT 'user:' || user_id AS key, count(DISTINCT event_id % 3) AS n FROM events GROUP BY user_id, event_type HAVING n < 3")
def _under(spark, d):
    rows = _held(spark, d).withColumn("namespace", F.col("version.member"))
    return kv.under_replicated(rows, [0, 1, 2], 3).select("key", "n")


@query("kv_replicas", "SELECT event_type AS namespace, count(*) AS replicas, string_agg(DISTINCT 'm' || (event_id % 3), ',' ORDER BY 'm' || (event_id % 3)) AS members FROM events GROUP BY 1")
def _replicas(spark, d):
    each = table(spark, d, "events").groupBy(F.col("event_type").alias("namespace"), F.concat(F.lit("m"), F.col("event_id") % 3).alias("member")).agg(F.count("*").alias("keys"))
    return kv.replicas(each)


_CERT = "(SELECT 'user:' || (p_partkey % 4) AS a, 'user:' || (3 + p_size % 4) AS z, p_partkey AS until FROM part)"


@query("kv_certificates", f"SELECT a AS start_key, z AS end_key, until AS valid_until FROM {_CERT} WHERE a <= 'user:2' AND z >= 'user:5' AND until > 40")
def _certificates(spark, d):
    part = table(spark, d, "part")
    c = part.select(F.lit("events").alias("namespace"), F.concat(F.lit("user:"), F.col("p_partkey") % 4).alias("start_key"), F.concat(F.lit("user:"), 3 + F.col("p_size") % 4).alias("end_key"), F.col("p_partkey").alias("valid_until"))
    return kv.covering(c, "events", "user:2", "user:5", 40).select("start_key", "end_key", "valid_until")


# collections


@query("set_removed", _CMD + "SELECT coll, count(*) AS n FROM st WHERE item IN (SELECT 'm' || (event_id % 50) FROM events WHERE event_type = 'purchase' AND event_id % 50 < 20) GROUP BY coll")
def _removed(spark, d):
    st = collections.state(_commands(spark, d))
    gone = table(spark, d, "events").where("event_type = 'purchase' and event_id % 50 < 20").select(F.concat(F.lit("m"), F.col("event_id") % 50).alias("item")).distinct()
    return collections.removed(st, st.select("ns", "coll").distinct().crossJoin(F.broadcast(gone))).select("coll", "n")  # at most 20 items


@query("hash_set_new", _CMD + "SELECT coll, count(*) AS n FROM (SELECT DISTINCT coll, 'm' || (event_id % 70) AS item FROM cmd) q WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.coll = q.coll AND st.item = q.item) GROUP BY coll")
def _hash_new(spark, d):
    c = _commands(spark, d)
    return collections.newly_added(collections.state(c), c.withColumn("item", F.concat(F.lit("m"), F.col("log_index") % 70))).select("coll", "n")


@query("hash_incr_float", "SELECT 'h' || (user_id % 20) AS coll, round(sum(value), 3) AS value FROM events GROUP BY 1")
def _incr_float(spark, d):
    log = table(spark, d, "events").select(F.lit("u").alias("ns"), F.concat(F.lit("h"), F.col("user_id") % 20).alias("coll"), F.lit("f").alias("item"), F.col("event_id").alias("log_index"), F.lit("incr").alias("op"), F.col("value").cast("string").alias("value"))
    return collections.incremented(collections.numeric(log, True), True).select("coll", F.round(F.col("value").cast("double"), 3).alias("value"))


@query("hash_not_numbers", "SELECT event_id AS log_index FROM events WHERE event_type IS NOT NULL")
def _not_numbers(spark, d):
    log = table(spark, d, "events").select(F.col("event_id").alias("log_index"), F.lit("incr").alias("op"), F.col("event_type").alias("value"))
    return collections.not_numbers(log).select("log_index")


@query("card_check", _CMD + "SELECT coll, a.n AS counted, b.n AS stored FROM (SELECT coll, count(*) AS n FROM st GROUP BY 1) a JOIN (SELECT coll, count(DISTINCT item) AS n FROM cmd GROUP BY 1) b USING (coll) WHERE a.n <> b.n")
def _card_check(spark, d):
    c = _commands(spark, d)
    stored = c.groupBy("ns", "coll").agg(F.count_distinct("item").alias("n"))
    return collections.card_check(collections.state(c), stored).select("coll", "counted", "stored")


@query("element_sweep", f"WITH c AS (SELECT *, 'user:' || (user_id % 20) AS coll, 'm' || (event_id % 50) AS item, CASE WHEN event_id % 4 = 0 THEN epoch_ms(ts) END AS expiry FROM events), l AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY coll, item ORDER BY event_id DESC) = 1) SELECT coll, item FROM l WHERE event_type <> 'error' AND expiry <= {NOW}")
def _element_sweep(spark, d):
    due = table(spark, d, "events").select(F.col("event_id").alias("log_index"), F.when(F.col("event_id") % 4 == 0, millis("ts")).alias("expiry"))
    return collections.sweep(collections.state(_commands(spark, d).drop("expiry").join(due, "log_index")), NOW).select("coll", "item")


@query("commands_once", "SELECT event_id AS log_index FROM events WHERE event_type <> 'purchase' UNION ALL SELECT min(event_id) FROM events WHERE event_type = 'purchase' GROUP BY user_id % 50")
def _once(spark, d):
    log = table(spark, d, "events").select(F.col("event_id").alias("log_index"), F.when(F.col("event_type") == "purchase", F.col("user_id") % 50).alias("idem_key"))
    return collections.once(log).select("log_index")


@query("wrong_types", "WITH k AS (SELECT user_id % 20 AS coll, event_id, CASE WHEN event_type = 'signup' THEN 'hash' ELSE 'set' END AS kind FROM events), f AS (SELECT coll, arg_min(kind, event_id) AS kind FROM k GROUP BY 1) SELECT event_id AS log_index FROM k JOIN f USING (coll) WHERE k.kind <> f.kind")
def _wrong(spark, d):
    log = _commands(spark, d).join(table(spark, d, "events").select(F.col("event_id").alias("log_index"), F.when(F.col("event_type") == "signup", "hash").otherwise("set").alias("kind")), "log_index")
    return collections.wrong_types(log).select("log_index")


# budgets: a define, grants in order, and at the end the expiry of timed leases

_CAP = 1_000_000


@query(
    "budget_grants",
    f"""WITH g AS (SELECT o_custkey % 10 AS b, o_orderkey AS k, floor(o_totalprice)::BIGINT AS a FROM orders),
    r AS (SELECT *, coalesce(sum(a) OVER (PARTITION BY b ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g),
    x AS (SELECT *, greatest(0, least(a, {_CAP} - before))::BIGINT AS got FROM r)
    SELECT b::VARCHAR AS budget, {_CAP}::BIGINT AS cap, greatest(0, {_CAP} - sum(a))::BIGINT AS available, sum(CASE WHEN k % 2 = 1 THEN got ELSE 0 END)::BIGINT AS leased, sum(CASE WHEN k % 2 = 0 THEN got ELSE 0 END)::BIGINT AS spent, count_if(got > 0)::BIGINT AS granted, count_if(got = 0)::BIGINT AS refused FROM x GROUP BY b""",
)
def _grants(spark, d):
    o = table(spark, d, "orders").select((F.col("o_custkey") % 10).cast("string").alias("budget"), "o_orderkey", F.floor("o_totalprice").cast("bigint").alias("amount"))
    first = o.groupBy("budget").agg(F.max("o_orderkey").alias("last"))
    rest = {"ns": F.lit("n"), "holder": F.lit("h"), "rate": F.lit(0), "burst": F.lit(0), "pause": F.lit(0)}
    grants = o.select("budget", F.col("o_orderkey").alias("log_index"), F.lit("grant").alias("op"), F.concat(F.lit("l"), "o_orderkey").alias("lease"), "amount", F.when(F.col("o_orderkey") % 2 == 0, 5000).otherwise(0).alias("ttl"), F.lit(0).cast("bigint").alias("now"))
    ends = lambda op, at, now: first.select("budget", at.alias("log_index"), F.lit(op).alias("op"), F.lit("").alias("lease"), F.lit(_CAP).cast("bigint").alias("amount"), F.lit(0).alias("ttl"), F.lit(now).cast("bigint").alias("now"))
    log = grants.unionByName(ends("define", F.lit(-1).cast("bigint"), 0)).unionByName(ends("expire", F.col("last") + 1, 10**9))
    return budget.fold(log.withColumns(rest)).select("budget", "cap", "available", "leased", "spent", "granted", "refused")


# statistics

_OLD = "(p_partkey * 7) % 60000 > 30000"


@query(
    "edge_score",
    f"""SELECT p_partkey AS id, round(0.55 * CASE WHEN {_OLD} THEN 1 ELSE p_size / 50.0 END + 0.15 * CASE WHEN {_OLD} THEN 1 ELSE p_retailprice::DOUBLE / 2500 END + 0.10 * CASE WHEN {_OLD} OR p_size % 3 = 0 THEN 1 ELSE 0.1 END
    + 0.10 * CASE WHEN p_size % 4 = 0 THEN 0.5 WHEN p_size % 4 = 1 THEN 1.0 WHEN p_size % 8 < 4 THEN 0.4 WHEN p_size % 16 < 8 THEN 0.2 ELSE 0 END + 0.05 * 0.5 + 0.05, 6)::DOUBLE AS score FROM part""",
)
def _score(spark, d):
    s = F.col("p_size")
    far = statistics.topology_penalty(s % 4 > 0, s % 4 > 1, s % 8 > 3, s % 16 > 7)
    loss = F.when(s % 3 == 0, F.lit(None).cast("double")).otherwise(0.1)
    score = statistics.edge_score(s / 50.0, F.col("p_retailprice").cast("double") / 2500, loss, far, F.lit(0.5), F.lit(None).cast("double"), F.col("p_partkey") * 7 % 60000)
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.round(score, 6).alias("score"))


@query("ewma_loss", "WITH x AS (SELECT user_id, list(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END::DOUBLE ORDER BY event_id) AS v FROM events GROUP BY 1) SELECT user_id, round(list_reduce(v, lambda s, a: 0.8 * s + 0.2 * a), 6) AS ewma FROM x")
def _loss(spark, d):
    lost = table(spark, d, "events").withColumn("lost", (F.col("event_type") == "error").cast("double"))
    return statistics.smoothed(lost, ["user_id"], "event_id", "lost").select("user_id", F.round("ewma", 6).alias("ewma"))


@query("may_hold", "SELECT o_orderkey AS ord FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def _may_hold(spark, d):
    keys = table(spark, d, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    return statistics.may_hold(table(spark, d, "orders"), keys, "o_custkey").select(F.col("o_orderkey").alias("ord"))


@query("distinct_keys_near", "SELECT event_type, count(DISTINCT user_id) AS exact, true AS near FROM events GROUP BY 1")
def _near(spark, d):
    e = table(spark, d, "events")
    sketches = statistics.key_sketches(e, ["event_type"], "user_id").select("event_type", F.hll_sketch_estimate("sketch").alias("n"))
    exact = e.groupBy("event_type").agg(F.count_distinct("user_id").alias("exact"))
    return sketches.join(exact, "event_type").select("event_type", "exact", (F.abs(F.col("n") - F.col("exact")) <= F.greatest(F.lit(2), 0.04 * F.col("exact"))).alias("near"))


_BUCKET = "CASE WHEN v < 8 THEN v ELSE (floor(log2(v))::INTEGER - 2) * 8 + floor(v / pow(2, floor(log2(v)) - 3))::INTEGER - 8 END::INTEGER"
_FLOOR = "CASE WHEN {b} < 8 THEN {b}::DOUBLE ELSE ({b} % 8 + 8) * pow(2, floor({b} / 8) - 1) END"


@query(
    "window_quantiles",
    f"WITH b AS (SELECT event_type, start, {_BUCKET} AS b, count(*) AS n FROM (SELECT event_type, time_bucket(INTERVAL '1 day', ts) AS start, floor(value)::BIGINT AS v FROM events) GROUP BY ALL), c AS (SELECT *, sum(n) OVER (PARTITION BY event_type, start ORDER BY b) AS c, sum(n) OVER (PARTITION BY event_type, start) AS t FROM b), m AS (SELECT event_type, start, sum(n)::BIGINT AS n, min(b) FILTER (WHERE c >= 0.5 * t) AS b50, min(b) FILTER (WHERE c >= 0.95 * t) AS b95, min(b) FILTER (WHERE c >= 0.99 * t) AS b99 FROM c GROUP BY ALL) SELECT event_type, start, n, {_FLOOR.format(b='b50')} AS p50, {_FLOOR.format(b='b95')} AS p95, {_FLOOR.format(b='b99')} AS p99 FROM m",
)
def _quantiles(spark, d):
    e = table(spark, d, "events")
    return statistics.window_quantiles(e, "ts", ["event_type"], "value", "1 day").withColumn("start", F.col("start").cast(e.schema["ts"].dataType))


# exploring


@query("edge_by_id", "SELECT 'customer:' || c_custkey || '|LOCATED_IN|nation:' || c_nationkey AS edge_id, 'customer:' || c_custkey AS src, 'nation:' || c_nationkey AS dst FROM customer WHERE c_custkey = 17")
def _edge(spark, d):
    nation = table(spark, d, "customer").where("c_custkey = 17").first()["c_nationkey"]
    return explore.edge_by_id(tpch_graph(spark, d), f"customer:17|LOCATED_IN|nation:{nation}").select("edge_id", "src", "dst")


@query("explore_whole", "SELECT 'nation:' || n_nationkey AS src, 'region:' || n_regionkey AS dst FROM nation")
def _whole(spark, d):
    g = tpch_graph(spark, d)
    small = Graph(spark, {k: g.nodes[k] for k in ("Nation", "Region")}, {"IN_REGION": g.edges["IN_REGION"]}, keyed={k: g.keyed[k] for k in ("Nation", "Region")})
    return explore.whole(small, 1000)[1].select("src", "dst")


@query("explore_around", "SELECT 'region:' || r_regionkey AS node_id, 0 AS hops FROM region WHERE r_regionkey = 1 UNION ALL SELECT * FROM (SELECT 'nation:' || n_nationkey AS node_id, 1 AS hops FROM nation WHERE n_regionkey = 1 ORDER BY node_id LIMIT 3)")
def _around(spark, d):
    return explore.explored(tpch_graph(spark, d), spark.createDataFrame([("region:1",)], "node_id string"), 1, 4).nodes


@query("explore_hidden", "SELECT 'nation:' || n_nationkey AS node_id, NULL::VARCHAR AS n_name FROM nation")
def _hidden(spark, d):
    return explore.redacted(tpch_graph(spark, d).nodes["Nation"].select("node_id", "n_name"), shown=False)


# sources and sinks


@query("reservoir", "SELECT event_id FROM events ORDER BY md5('0|' || event_id), event_id::VARCHAR LIMIT 100")
def _reservoir(spark, d):
    return catalog.reservoir(table(spark, d, "events"), 100, key="event_id").select("event_id")


@query("export_restore", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'MACHINERY'")
def _restore(spark, d):
    path = f"{shared_folder(spark)}/export-{uuid.uuid4().hex}"
    catalog.export_table(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), path, ["c_mktsegment"], F.col("c_mktsegment").isin("MACHINERY", "BUILDING"))
    return catalog.restore_table(spark, path, F.col("c_mktsegment") == "MACHINERY")


# streams: the events file as a stream, taken in one go


def _stream(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    reader = spark.readStream.schema(events.schema)
    if events.inputFiles()[0].endswith("/events.parquet"):
        return reader.option("pathGlobFilter", "events.parquet").parquet(d)
    return reader.parquet(f"{d}/events.parquet")


def _drained(spark: SparkSession, stream: DataFrame) -> DataFrame:
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    return changefeed.drained(stream, f"{at}/rows", f"{at}/checkpoint")


@query("stream_observed", "SELECT event_id FROM events WHERE event_type IN ('purchase', 'signup') AND user_id % 3 = 1")
def _observed(spark, d):
    ring = _stream(spark, d).select("event_id", F.col("event_type").alias("kind"), F.concat(F.lit("p"), F.col("user_id") % 3).alias("peer"))
    return _drained(spark, changefeed.observed(ring, ["purchase", "signup"], ["p1"])).select("event_id")


@query("stream_latest", _LOG + "SELECT key, sequence FROM win")
def _latest(spark, d):
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    ms = millis("ts")
    v = kv.version(ms, F.lit(0).cast("bigint"), F.concat(F.lit("c"), F.col("event_id") % 2), F.col("event_type"), F.col("event_id"))
    rows = _stream(spark, d).select(F.lit("events").alias("namespace"), F.concat(F.lit("user:"), "user_id").alias("key"), F.col("props").alias("value"), v.alias("version"), (F.col("event_type") == "error").alias("tombstone"))
    changefeed.keep_latest(rows, f"{at}/state", f"{at}/checkpoint").awaitTermination()
    return changefeed.latest(spark, f"{at}/state", rows.schema).select("key", F.col("version.sequence").alias("sequence"))


@query("stream_expired", _LOG + ", whole AS (SELECT key, sequence, tombstone, epoch_us(ts) // 1000 AS ms FROM win JOIN events ON event_id = sequence) SELECT key, sequence, ms + 3600000 AS expires_at FROM whole WHERE NOT tombstone AND sequence % 4 = 0 AND ms + 3600000 < (SELECT max(epoch_us(ts) // 1000) - 10000 FROM events)")
def _expired(spark, d):
    ms = millis("ts")
    v = kv.version(ms, F.lit(0).cast("bigint"), F.concat(F.lit("c"), F.col("event_id") % 2), F.col("event_type"), F.col("event_id"))
    rows = _stream(spark, d).select(F.lit("events").alias("namespace"), F.concat(F.lit("user:"), "user_id").alias("key"), v.alias("version"), F.when(F.col("event_id") % 4 == 0, ms + 3_600_000).alias("expires_at"), (F.col("event_type") == "error").alias("tombstone"))
    return _drained(spark, changefeed.expired(rows)).select("key", F.col("version.sequence").alias("sequence"), "expires_at")


# history: purchases are writes, views are reads; a key is a user, a version the event's value

_W, _R = "event_type = 'purchase'", "event_type = 'view'"


def _history(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select("event_id", "event_type", F.when(F.col("event_type") == "purchase", "write").otherwise("read").alias("kind"), F.col("user_id").alias("key"), F.lit(True).alias("ack"), F.col("value").alias("observed"), F.col("value").alias("written"), F.col("props").alias("value"), millis("ts").alias("start_ms"), (millis("ts") + 1000).alias("expires_at_ms"))


@query("history_durability", f"SELECT key, newest, best FROM (SELECT user_id AS key, max(value) AS newest FROM events WHERE {_W} GROUP BY 1) JOIN (SELECT user_id AS key, max(value) AS best FROM events WHERE {_R} GROUP BY 1) USING (key) WHERE best < newest")
def _durability(spark, d):
    h = _history(spark, d)
    return history.durability(h, h.where(_R)).select("key", "newest", "best")


@query("history_completeness", "SELECT event_id FROM events WHERE event_type IN ('view', 'click') AND event_id % 3 > 0")
def _completeness(spark, d):
    h = _history(spark, d).withColumns({"kind": F.lit("scan"), "completeness": F.when(F.col("event_type").isin("view", "click"), "COMPLETE").otherwise("PARTIAL"), "valid_until_ms": F.when(F.col("event_id") % 3 < 2, F.col("start_ms") + F.when(F.col("event_id") % 3 == 0, 1).otherwise(0))})
    return history.completeness(h).select("event_id")


@query("history_lost_updates", f"SELECT user_id AS key, event_id % 7 AS writer, max(event_id) AS written FROM events WHERE {_W} GROUP BY 1, 2 HAVING max(event_id) NOT IN (SELECT event_id + 1 FROM events WHERE {_R} AND event_id IS NOT NULL)")
def _lost(spark, d):
    h = _history(spark, d).withColumns({"policy": F.lit("keep-siblings"), "writer": F.col("event_id") % 7, "written": F.col("event_id")})
    seen = table(spark, d, "events").where(_R).select((F.col("event_id") + 1).alias("seen"))
    reads = h.where(_W).join(seen, F.col("event_id") == F.col("seen"), "left_semi").select("key", F.array("event_id").alias("siblings"))
    return history.lost_updates(h, reads).select("key", "writer", "written")


@query("history_ttl_bound", f"SELECT event_id FROM events JOIN (SELECT user_id, min(epoch_ms(ts)) + 1000 AS due FROM events WHERE {_W} GROUP BY 1) USING (user_id) WHERE NOT ({_W}) AND props <> '' AND epoch_ms(ts) > due + 120000")
def _ttl_bound(spark, d):
    return history.ttl_bound(_history(spark, d)).select("event_id")


@query("history_lease_disjointness", "SELECT o_orderkey AS ord FROM orders WHERE o_orderkey % 3 > 0 AND o_orderkey % 100 >= o_custkey % 100")
def _disjoint(spark, d):
    spends = table(spark, d, "orders").select(F.col("o_orderkey").alias("ord"), (F.col("o_orderkey") % 100).alias("at_ms"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_custkey") % 100).alias("reclaim_ms"))
    return history.lease_disjointness(spends).select("ord")


@query("history_healed", "WITH f AS (SELECT event_type, min(epoch_ms(ts)) AS e FROM events GROUP BY 1) SELECT event_id FROM events WHERE event_type <> 'purchase' AND epoch_ms(ts) > (SELECT max(e) FROM f)")
def _healed(spark, d):
    h = _history(spark, d)
    faults = h.groupBy("event_type").agg(F.min("start_ms").alias("end_ms"))
    return history.healed(h, faults).select("event_id")
