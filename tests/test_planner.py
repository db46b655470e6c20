import pytest

from polyquery.plans.language import QueryError
from polyquery.plans.planner import run
from polyquery.sources.catalog import Graph, bench_graph, load_statements, sample_films

# The people, the follows and the answers of test_golden are those that the language's own rules are checked with.
PEOPLE = [("alice", "Alice", 30, "NYC"), ("bob", "Bob", 40, "NYC"), ("carol", "Carol", 25, "SF"), ("dave", "Dave", 35, "LA"), ("eve", "Eve", 45, "NYC"), ("frank", "Frank", 28, "SF"), ("grace", "Grace", 50, "LA"), ("heidi", "Heidi", 33, "NYC")]
FOLLOWS = [("alice", "bob"), ("alice", "carol"), ("bob", "carol"), ("dave", "eve"), ("eve", "grace"), ("heidi", "alice"), ("frank", "heidi"), ("grace", "alice")]


@pytest.fixture(scope="module")
def social(spark):
    nodes = spark.createDataFrame([(i, i, n, a, c) for i, n, a, c in PEOPLE], "node_id string, id string, name string, age bigint, city string")
    edges = spark.createDataFrame([(f"{a}|FOLLOWS|{b}", a, b) for a, b in FOLLOWS], "edge_id string, src string, dst string")
    return Graph(spark).with_nodes("User", nodes).with_edges("FOLLOWS", edges, "User", "User")


def column(graph, text, rules="classic", **params):
    return sorted((r[0] for r in run(graph, text, params, rules).df.collect()), key=repr)


def test_golden(social):
    assert column(social, "MATCH (n:User) RETURN n.name") == sorted(p[1] for p in PEOPLE)
    assert column(social, "MATCH (n:User) WHERE n.age >= 35 RETURN n.name") == ["Bob", "Dave", "Eve", "Grace"]
    assert column(social, "MATCH (n:User) WHERE n.city = 'NYC' RETURN n.name") == ["Alice", "Bob", "Eve", "Heidi"]
    assert column(social, "MATCH (a:User {id:'alice'})-[:FOLLOWS]->(m) RETURN m.name") == ["Bob", "Carol"]
    assert column(social, "MATCH (a:User {id:$who})-[:FOLLOWS]-(m) RETURN m.name", who="carol") == ["Alice", "Bob"]


def test_rules_of_values(spark, social):
    one = lambda e: run(social, f"UNWIND [1] AS x RETURN {e} AS v").df.first()[0]
    assert one("null = null") is True and one("null > 5") is True and one("null < 'a'") is True
    assert one("'a' > 99") is True and one("true < 0") is True and one("1 = 1.0") is True
    assert one("7 / 2") == 3 and one("(0 - 7) / 2") == -3 and one("5 / 0") == 0 and one("'a' + 'b'") is None
    assert one("1.0 / 0") == float("inf") and one("NOT 0") is False and one("NOT null") is True
    assert one("3 IN [1, 2.5, 3]") is True and one("null IN [null]") is True
    # nothing is above every number: users without the property are kept
    assert len(column(social, "MATCH (n:User) WHERE n.height > 3 RETURN n.name")) == 8


def test_order_and_pages(social):
    names = [r[0] for r in run(social, "MATCH (n:User) RETURN n.name AS name, n.age AS age ORDER BY age DESC SKIP 1 LIMIT 3").df.collect()]
    assert names == ["Eve", "Bob", "Dave"]
    assert run(social, "MATCH (n:User) RETURN n.name ORDER BY n.name").meta.warnings
    with pytest.raises(QueryError):
        run(social, "MATCH (n) RETURN n.a, n.b LIMIT -1")
    with pytest.raises(QueryError):
        run(social, "MATCH (n) RETURN n.age + 1, n.age + 2")
    with pytest.raises(QueryError):
        run(social, "MATCH (n) RETURN n.name").guarded(3)


def test_classic_and_open_rules(social):
    text = "MATCH (a:User {id:'carol'}) OPTIONAL MATCH (a)-[:FOLLOWS]->(m) RETURN m.name AS name"
    assert column(social, text) == [] and column(social, text, "open") == [None]
    text = "MATCH (a:User {id:'alice'}) WITH a MATCH (a)-[:FOLLOWS]->(m) RETURN m.name"
    assert column(social, text, "open") == ["Bob", "Carol"]
    assert column(social, "MATCH (a:User {id:'alice'})-[:FOLLOWS]->(m:Robot) RETURN m.name") == ["Bob", "Carol"]
    assert column(social, "MATCH (a:User {id:'alice'})-[:FOLLOWS]->(m:Robot) RETURN m.name", "open") == []
    assert column(social, "MATCH (a:User {id:'alice'})-[:FOLLOWS]->(b)-[:FOLLOWS]->(c)<-[:FOLLOWS]-(a) RETURN c.name", "open") == ["Carol"]


def test_writes(spark):
    g = load_statements(Graph(spark), "CREATE (a:User {id:'a', age:1})-[:F]->(b:User {id:'b'}); // twice the same edge is one\n MATCH (a:User {id:'a'}), (b:User {id:'b'}) CREATE (a)-[:F]->(b);")
    g = run(g, "MATCH (a:User {id:'a'}) SET a.age = a.age + 1").graph
    assert column(g, "MATCH (a:User {id:'a'}) RETURN a.age") == [2]
    g = run(g, "MATCH (b:User {id:'b'}) DELETE b").graph
    assert column(g, "MATCH (a:User)-[:F]->(b) RETURN b") == [] and column(g, "MATCH (n) RETURN n") == ["a"]


def test_several_labels(spark):
    g = load_statements(Graph(spark), "CREATE (a:User:Admin {id:'a'}); CREATE (b:User {id:'b'});")
    assert column(g, "MATCH (n) RETURN n") == ["a", "b"] and column(g, "MATCH (n:Admin) RETURN n") == ["a"]
    assert column(g, "MATCH (n:User:Admin) RETURN n") == ["a", "b"] and column(g, "MATCH (n:User:Admin) RETURN n", "open") == ["a"]


def test_other_graphs(spark):
    assert column(sample_films(spark), "MATCH (p:Person)-[:DIRECTED]->(m) RETURN m.title") == ["Paper Lanterns", "The Quiet Shore"]
    g = bench_graph(spark, 20, 60)
    assert len(column(g, "MATCH (u:User) RETURN u.name")) == 20
    assert all(a != b for a, b in run(g, "MATCH (a:User)-[:FOLLOWS]->(b) RETURN a, b").df.collect())


def test_limits_and_procedures(spark, social):
    from polyquery.plans.planner import Limits

    with pytest.raises(QueryError):
        run(social, "MATCH (a)" + "-[:FOLLOWS]->(b)" * 9 + " RETURN 1 AS one")
    with pytest.raises(QueryError):
        run(social, "MATCH (n:User) RETURN n.name", limits=Limits(intermediate=3))
    for text in ("CALL vector.search('docs', [1.0], 3)", "CALL kv.put('a', 'b')", "CALL kv.put('a', 'b', 3)", "CALL kv.put('a', 'b', 'c') YIELD node", "CALL vector.searchExact('none', [1.0], 3)", "MERGE (n)", "DETACH DELETE n"):
        with pytest.raises(QueryError):
            run(social, text)
    g = run(social, "CALL kv.put('a', 'k', 'v')").graph
    assert column(g, "UNWIND ['k', 'x'] AS k RETURN kv.get('a', k)") == ["v", None]


def test_strings_hold_comment_signs_and_semicolons(spark):
    g = load_statements(Graph(spark), "CREATE (a:Page {id:'a', url:'http://x.y/;z'}); // a comment; with a semicolon\nCREATE (b:Page {id:'b', url:\"// no\"});")
    assert column(g, "MATCH (p:Page) RETURN p.url") == ["// no", "http://x.y/;z"]


def test_ids_are_looked_up_by_key(spark, sf_dir):
    from polyquery.sources.catalog import tpch_graph

    g = tpch_graph(spark, sf_dir)
    plan = run(g, "MATCH (c:Customer) WHERE c = 'customer:17' RETURN c.c_name AS name").df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(c_custkey,17)" in plan
    hop = run(g, "MATCH (c:Customer)-[:LOCATED_IN]->(n) RETURN c.c_name AS name, n.n_name AS nation").df._jdf.queryExecution().optimizedPlan().toString()
    assert hop.count("Relation [") == 2 and "concat" not in hop
    assert column(g, "MATCH (c:Customer) WHERE c = 'customer:017' OR c = 'nation:17' RETURN c") == []
    assert column(g, "MATCH (c:Customer {id: 'customer:17'}) RETURN c") == ["customer:17"]
    changed = run(g, "MATCH (n:Nation) SET n.n_nationkey = 0").graph
    assert len(column(changed, "MATCH (c:Customer)-[:LOCATED_IN]->(n) RETURN n")) == len(column(g, "MATCH (c:Customer) RETURN c"))


def test_one_type_twice_in_a_path_is_not_walked_back(spark, sf_dir):
    """Ids of edges of two types need no comparison; those of one type still do."""
    from polyquery.sources.catalog import tpch_graph

    pairs = run(tpch_graph(spark, sf_dir), "MATCH (c:Customer)-[:LOCATED_IN]->(n)<-[:LOCATED_IN]-(d) RETURN c AS a, d AS b", rules="open").df
    assert not pairs.isEmpty() and pairs.where("a = b").isEmpty()
