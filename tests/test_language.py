import pytest

from polyquery.plans.language import Match, Projection, QueryError, Unwind, parse


def test_clauses():
    q = parse("MATCH (a:User {id: 'x'})-[e:FOLLOWS|LIKES]->(b)<--(c) WHERE a.age >= 3 AND NOT b.x IN [1, 2] RETURN DISTINCT a.name AS n, b ORDER BY n DESC SKIP 1 LIMIT 2")
    assert isinstance(q[0], Match) and isinstance(q[1], Projection)
    assert [r.way for r in q[0].paths[0].rels] == ["out", "in"] and q[0].paths[0].rels[0].types == ["FOLLOWS", "LIKES"]
    assert q[1].distinct and q[1].order == [(("var", "n"), False)] and q[1].skip == ("lit", 1)
    assert isinstance(parse("UNWIND [1] AS x RETURN x")[0], Unwind)


@pytest.mark.parametrize("text", ["MERGE (a)", "MATCH (a) DETACH DELETE a", "LOAD x", "MATCH (a) REMOVE a.x", "MATCH (a RETURN a", "CALL set.add('a')", "RETURN count(x)", "", "MATCH (a)<-[:X]->(b) RETURN a"])
def test_errors(text):
    with pytest.raises(QueryError):
        parse(text)


def test_literals():
    item = lambda t: parse(f"RETURN {t} AS x")[0].items[0][0]
    assert item("99999999999999999999") == ("lit", (1 << 63) - 1)
    assert item(r"'a\nb'") == ("lit", "anb")
    assert item("1 + 2 * 3") == ("math", "+", ("lit", 1), ("math", "*", ("lit", 2), ("lit", 3)))
