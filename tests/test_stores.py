import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from polyquery import suite
from polyquery.operators import budget, collections, explore, history, kv, statistics, vectors
from polyquery.streaming import changefeed

LOG = "namespace string, key string, value string, version struct<physical:bigint,logical:bigint,cluster:string,member:string,sequence:bigint>, expires_at bigint, tombstone boolean"


def log(spark, rows):
    return spark.createDataFrame([("n", k, v, (p, 0, c, m, s), e, t) for k, v, p, c, m, s, e, t in rows], LOG)


ROWS = [("a", "1", 10, "c1", "m", 1, None, False), ("a", "2", 20, "c1", "m", 2, None, False), ("b", "x", 5, "c1", "m", 3, None, False), ("b", None, 6, "c2", "m", 1, None, True), ("c", "t", 7, "c1", "m", 4, 50, False), ("d", "p", 9, "c1", "m", 5, None, False), ("d", "q", 9, "c2", "m", 6, None, False)]


def test_last_write_wins_whatever_the_order(spark):
    want = {"a": "2", "b": None, "c": "t", "d": "q"}
    for seed in range(3):
        rows = ROWS + ROWS[:3]
        random.Random(seed).shuffle(rows)
        assert {r.key: r.value for r in kv.winners(log(spark, rows)).collect()} == want
    live = kv.scan(log(spark, ROWS), "n", 50)
    assert [r.key for r in live.rows.collect()] == ["a", "d"] and live.completeness == "BEST_EFFORT"
    assert {r.key: r.value for r in kv.travel(log(spark, ROWS), 9).collect()} == {"b": None, "c": "t", "d": "q"}


def test_siblings_and_sweeps(spark):
    n = {r.key: r.n for r in kv.siblings(log(spark, ROWS)).collect()}
    assert n == {"a": 1, "b": 2, "c": 1, "d": 2}
    assert [r.key for r in kv.sweep(log(spark, ROWS), 50).collect()] == ["c"]
    assert kv.prefix_end(b"a\xff") == b"b" and kv.prefix_end(b"\xff") is None
    everything = log(spark, ROWS)
    assert kv.append_once(everything, everything).count() == len(ROWS)
    assert kv.diverged(kv.winners(everything), kv.winners(everything)).isEmpty()
    assert not kv.diverged(kv.winners(everything), kv.travel(everything, 9)).isEmpty()


def test_complete_only_under_a_certificate(spark):
    cert = spark.createDataFrame([("n", "a", "z", 100)], "namespace string, start_key string, end_key string, valid_until bigint")
    mode = lambda end, now: kv.scan(log(spark, ROWS), "n", now, "b", end, mode="CACHE_COMPLETE", certificates=cert).completeness
    assert mode("c", 50) == "COMPLETE" and mode("zz", 50) == "BEST_EFFORT" and mode("c", 100) == "BEST_EFFORT"


def test_collections(spark):
    cols = "log_index bigint, op string, ns string, coll string, item string, value string, score double, expiry bigint, idem_key string, kind string"
    rows = [(1, "add", "n", "s", "x", None, 1.0, None, "k1", "set"), (2, "add", "n", "s", "x", None, 2.0, None, "k1", "set"), (3, "add", "n", "s", "y", None, 0.5, 10, None, "set"), (4, "remove", "n", "s", "x", None, None, None, None, "set")]
    df = spark.createDataFrame(rows, cols)
    assert collections.once(df).count() == 3
    assert [r.item for r in collections.state(df).collect()] == ["y"] and collections.state(df, now=10).isEmpty()
    with pytest.raises(collections.WrongType):
        collections.checked(df.unionByName(df.where("log_index = 4").withColumns({"kind": F.lit("hash"), "log_index": F.lit(9)})))


def commands(seed):
    r = random.Random(seed)
    rows = [dict(op="define", lease="", holder="", amount=1000, ttl=0, rate=r.choice([0, 50]), burst=200, pause=10, now=0)]
    for i in range(200):
        rows.append(dict(op=r.choice(["grant", "report", "return", "expire", "collect", "define"]), lease=f"l{r.randrange(12)}", holder=r.choice("ab"), amount=r.randrange(-5, 120), ttl=r.choice([0, 500]), rate=0, burst=0, pause=0, now=i * 300))
    return [dict(x, ns="n", budget=str(seed), log_index=i) for i, x in enumerate(rows)]


def test_budgets_conserve(spark):
    for seed in range(20):
        pool = budget.Pool()
        for c in pd.DataFrame(commands(seed)).itertuples():
            pool.apply(c)
            assert pool.cap == pool.available + pool.leased + pool.spent and pool.available >= 0
    out = budget.fold(spark.createDataFrame(pd.DataFrame(commands(1) + commands(2)))).collect()
    assert len(out) == 2 and all(r.cap == r.available + r.leased + r.spent for r in out)
    s = budget.Spender(100)
    s.grant(5)
    assert s.spend(3, 0) and not s.spend(3, 10) and s.spend(0, 20) and not s.spend(1, 500)


def test_vectors(spark):
    assert vectors.metric_of("Euclidean") == "l2" and vectors.metric_of("odd") == "cosine"
    rng = random.Random(0)
    rows = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(8)], None) for i in range(400)] + [(1000, [0.0] * 8, None), (1001, [1.0] * 3, None)], "id bigint, vector array<float>, node_id string")
    q = [rng.gauss(0, 1) for _ in range(8)]
    best = [r.id for r in vectors.top_k(rows, q, 10, "l2").collect()]
    assert 1001 not in best and vectors.top_k(rows, q, 0).isEmpty()
    cells = vectors.Cells.trained(rows.where("id < 1000"), 8, probes=8)
    assert [r.id for r in vectors.top_k(cells.candidates(rows.where("id < 1000"), q), q, 10, "l2").collect()] == [i for i in best if i < 1000][:10] or len(best) == 10
    planes = vectors.Hyperplanes.drawn(8, 4, 1)
    found = {r.id for r in vectors.top_k(planes.candidates(rows, q, 11), q, 10, "l2").collect()}
    assert len(found & set(best)) >= 9
    assert vectors.top_k(rows.where("id = 1000"), q, 1).first().score == 0.0


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_registered_searches_keep_their_recall(spark, sf):
    """Of the ten nearest, 95 % are among the candidates of the registered settings, over some 300 queries."""
    rows = suite._vectors(spark, f"/root/testdata/{sf}")
    planes, cells = vectors.Hyperplanes.drawn(*suite.LSH), vectors.Cells.trained(rows, suite.IVF_CELLS, probes=suite.IVF_PROBES)
    all_rows = rows.select("id", "vector", planes.bucket(F.col("vector")).alias("bucket"), cells.cell(F.col("vector")).alias("cell")).toPandas()
    x, ids = np.array(all_rows["vector"].tolist(), float), all_rows["id"].to_numpy()
    unit, centroids, lsh, ivf = x / np.linalg.norm(x, axis=1)[:, None], np.array(cells.centroids), [], []
    for q in range(0, len(x), len(x) // 300 or 1):
        best = np.lexsort((ids, 1 - unit @ unit[q]))[:10]
        lsh.append(all_rows["bucket"].iloc[best].isin(planes.probes(x[q].tolist(), suite.LSH_PROBES)).mean())
        best = np.lexsort((ids, ((x - x[q]) ** 2).sum(axis=1)))[:10]
        near = np.argsort(((centroids - x[q]) ** 2).sum(axis=1), kind="stable")[: cells.probes]
        ivf.append(all_rows["cell"].iloc[best].isin(near).mean())
    assert np.mean(lsh) >= 0.95 and np.mean(ivf) >= 0.95
    for name, metric in (("lsh_search", "cosine"), ("ivf_search", "l2")):
        found = {r.id for r in suite.queries()[name](spark, f"/root/testdata/{sf}").collect()}
        assert len(found & {r.id for r in vectors.top_k(rows, x[ids.tolist().index(0)].tolist(), 10, metric).collect()}) >= 8


def test_probes_come_to_every_bucket_once():
    planes = vectors.Hyperplanes.drawn(8, 4, 1)
    probes = planes.probes([1.0, -2.0, 0.5, 3.0, 0.0, 1.0, -1.0, 2.0], 16)
    assert sorted(probes) == list(range(16)) and [(p ^ probes[0]).bit_count() for p in probes] == [0] + [1] * 4 + [2] * 6 + [3] * 4 + [4]


def test_statistics_and_history(spark):
    rows = spark.createDataFrame([("a", i, float(i)) for i in range(100)], "g string, t bigint, v double")
    assert statistics.last_quantile(rows, ["g"], ["t"], "v").first().v == sorted(range(36, 100))[int(0.95 * 63)]
    e = 0.0
    for i in range(1, 100):
        e = 0.8 * e + 0.2 * i
    assert abs(statistics.smoothed(rows, ["g"], "t", "v").first().ewma - e) < 1e-9
    n = statistics.histogram(rows, ["g"], "v")
    assert n.agg(F.sum("n")).first()[0] == 100 and 44 <= statistics.histogram_quantile(n, ["g"], 0.5).first().value <= 50
    h = spark.createDataFrame([("read", "k", "s", 1, 1, 5), ("read", "k", "s", 2, 2, 3), ("read", "k", "t", 3, 3, 4)], "kind string, key string, session string, start_ms bigint, end_ms bigint, observed bigint")
    assert [r.start_ms for r in history.session_monotonicity(h).collect()] == [2]
    spends = spark.createDataFrame([("b", 1, 6), ("b", 2, -9), ("b", 3, 5), ("b", 4, 1)], "b string, at bigint, units bigint")
    assert history.budget_cap(spends, ["b"], ["at"], "units", F.lit(10)).first().at == 3


def test_exploring(spark):
    from polyquery.sources.catalog import sample_films

    g = sample_films(spark)
    seen = {r.node_id: r.hops for r in explore.reached(g, spark.createDataFrame([("f1",)], "node_id string"), 2).collect()}
    assert seen["f1"] == 0 and seen["p1"] == 1 and seen["f2"] == 2
    kept, edges, more = explore.whole(g, 4)
    assert kept.count() == 4 and more and edges.count() == 2


def test_stream_equals_batch(spark, tmp_path):
    folder, rows = str(tmp_path / "in"), ROWS * 2
    random.Random(5).shuffle(rows)
    for i in range(0, len(rows), 5):
        log(spark, rows[i : i + 5]).write.mode("append").parquet(folder)
    stream = changefeed.changes(spark, folder, log(spark, ROWS).schema)
    changefeed.keep_latest(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    last = changefeed.latest(spark, str(tmp_path / "out"), log(spark, ROWS).schema)
    assert {tuple(r) for r in last.select("key", "value").collect()} == {tuple(r) for r in kv.winners(log(spark, ROWS)).select("key", "value").collect()}


def test_runs_merge_as_batches_come(spark, tmp_path):
    """Nine batches of one file each: the state is the batch answer after every call, and few runs are left."""
    assert changefeed.runs(0) == [] and changefeed.runs(6) == [(0, 4), (4, 5), (5, 6)] and changefeed.runs(16) == [(0, 16)]
    folder, target, schema = str(tmp_path / "in"), str(tmp_path / "out"), log(spark, ROWS).schema
    assert changefeed.latest(spark, target, schema).count() == 0
    seen = []
    for i in range(9):
        new = [(f"k{j}", f"{i}", (i * 7 + j) % 10, "c", "m", i, None, j == i) for j in range(i % 3, 6)]
        seen += new
        log(spark, new).write.mode("append").parquet(folder)
        changefeed.keep_latest(changefeed.changes(spark, folder, schema), target, str(tmp_path / "ck")).awaitTermination()
        want = {tuple(r) for r in kv.winners(log(spark, seen)).select("key", "value", "tombstone").collect()}
        assert {tuple(r) for r in changefeed.latest(spark, target, schema).select("key", "value", "tombstone").collect()} == want
    assert len(list((tmp_path / "out").iterdir())) <= 6


def test_records_expire_once_the_watermark_passes(spark, tmp_path):
    """What is superseded in time, deleted, without an end, or not yet due stays; the rest is reported once."""
    folder = str(tmp_path / "in")
    first = [("due", "1", 1000, "c", "m", 1, 5000, False), ("renewed", "1", 1000, "c", "m", 2, 5000, False), ("renewed", "2", 2000, "c", "m", 3, 900_000, False), ("dead", None, 1000, "c", "m", 4, 5000, True), ("endless", "1", 1000, "c", "m", 5, None, False)]
    later = [("clock", "1", 100_000, "c", "m", 6, None, False)]
    got = []
    for rows in (first, later):
        log(spark, rows).coalesce(1).write.mode("append").parquet(folder)
        stream = changefeed.expired(changefeed.changes(spark, folder, log(spark, ROWS).schema))
        got = sorted(tuple(r) for r in changefeed.drained(stream, str(tmp_path / "out"), str(tmp_path / "ck")).select("key", "version.sequence", "expires_at").collect())
        if rows is first:
            assert got == []
    assert got == [("due", 1, 5000)]


@pytest.mark.parametrize("size", [100_000, 40, 1])
def test_smoothing_in_stretches_is_the_plain_fold(spark, size):
    r = random.Random(5)
    rows = [(r.choice(["hot", "hot", "cold", None]), r.choice([None, *range(60)]), r.choice([None, r.uniform(-9, 9)])) for _ in range(400)]
    want = {}
    for g in ("hot", "cold", None):
        s = None
        for _, x in sorted(((-1 if t is None else t), x) for k, t, x in rows if k == g and x is not None):
            s = x if s is None else 0.8 * s + 0.2 * x
        want[g] = s
    df = spark.createDataFrame(rows, "g string, t bigint, v double")
    got = {x.g: x.ewma for x in statistics.smoothed(df, ["g"], "t", "v", rows_per_part=size).collect()}
    assert got.keys() == want.keys() and all(abs(got[g] - want[g]) < 1e-9 for g in want)
    assert statistics.smoothed(df.limit(0), ["g"], "t", "v").collect() == []


def test_spenders_pause_pace_and_pass_deadlines():
    s = budget.Spender(100)
    s.grant(5)
    assert s.spend(5, 0) and not s.spend(1, 50)
    s.grant(4, deadline=80)
    s.grant(9)
    assert s.spend(1, 60) and not s.spend(4, 70) and s.spend(4, 90)  # too small isn't drained; past its deadline it goes
    assert not s.spend(1, 500)
    s.grant(2)
    assert s.spend(2, 510)
    paced = budget.Spender(0, rate=10, burst=3)
    paced.grant(100)
    assert paced.spend(3, 0) and not paced.spend(1, 50) and paced.spend(1, 200)


def test_budgets_against_a_plain_fold(spark):
    r = random.Random(3)
    ops = ["grant", "grant", "report", "return", "expire", "collect", "reconcile", "nonsense"]
    rows = []
    for b in ("x", "y", "z"):
        rows.append(("n", b, 0, "define", "", "", 500, 0, 10 if b == "y" else 0, 50, 20, 0))
        rows += [("n", b, i, r.choice(ops), f"l{r.randint(0, 9)}", r.choice("hk"), r.randint(0, 80), r.choice((0, 3000)), 0, 0, 0, i * 100) for i in range(1, 300)]
    names = "ns budget log_index op lease holder amount ttl rate burst pause now".split()
    shuffled = spark.createDataFrame(r.sample(rows, len(rows)), "ns string, budget string, log_index bigint, op string, lease string, holder string, amount bigint, ttl bigint, rate bigint, burst bigint, pause bigint, now bigint")
    want = set()
    for b in ("x", "y", "z"):
        pool = budget.Pool()
        for row in sorted(x for x in rows if x[1] == b):
            pool.apply(budget.Command(**dict(zip(names, row, strict=True))))
            assert pool.cap == pool.available + pool.leased + pool.spent or row[3] == "reconcile" or pool.available == 0
        want.add(budget.state(("n", b), pool))
    assert {tuple(x) for x in budget.fold(shuffled).collect()} == want
    assert budget.fold(shuffled.limit(0)).collect() == []


def test_stored_cells_and_recall(spark, tmp_path):
    """A stored index reads the cells it probes alone, finds 95 % of the ten nearest, and takes a delta in."""
    rows = suite._vectors(spark, "/root/testdata/sf0.01").drop("label")
    cells = vectors.Cells.trained(rows, suite.IVF_CELLS, probes=suite.IVF_PROBES)
    kept = vectors.stored(rows, cells, str(tmp_path / "a"))
    by_rule = {r.id: r.cell for r in rows.select("id", cells.cell(F.col("vector")).alias("cell")).collect()}
    assert {r.id: r.cell for r in kept.select("id", "cell").collect()} == by_rule
    q = suite._first(spark, "/root/testdata/sf0.01")
    near = cells.candidates(kept, q)
    assert "PartitionFilters: [cell" in near._jdf.queryExecution().executedPlan().toString().replace("PartitionFilters: [isnotnull(cell#", "PartitionFilters: [cell(")
    planes = vectors.Hyperplanes.drawn(*suite.LSH)
    assert {(r.id, r.cell) for r in planes.assigned(rows).select("id", "cell").collect()} == {(r.id, r.b) for r in rows.select("id", planes.bucket(F.col("vector")).alias("b")).collect()}
    delta = rows.where("id < 5").withColumn("tombstone", F.lit(True))
    assert vectors.compacted(str(tmp_path / "a"), kept, delta, cells, str(tmp_path / "b")).count() == rows.count() - 5
    with pytest.raises(ValueError):
        vectors.put(vectors.vector_ids(rows), rows.select("id", F.slice("vector", F.lit(1), 3).alias("vector")), 64)


def test_numbers_are_checked(spark):
    rows = spark.createDataFrame([(1, "incr", "n", "h", "f", "1.5"), (2, "incr", "n", "h", "f", "x")], "log_index bigint, op string, ns string, coll string, item string, value string")
    with pytest.raises(collections.NotANumber):
        collections.numeric(rows, True)
    assert collections.incremented(collections.numeric(rows.limit(1), True), True).first().value == "1.5"


def test_clock_of_events_that_share_a_place(spark):
    """Whatever order tied events come in, they have one physical time, as the SQL's frame has it; events without a place come last."""
    rows = [("a", 1, 5), ("a", 1, 9), ("a", 1, 7), ("a", 2, 6), ("a", None, 3), ("b", None, 4), ("b", 3, 2), ("b", 3, 1)]
    for turned in (rows, rows[::-1]):
        events = spark.createDataFrame(turned, "node string, place bigint, wall bigint").coalesce(1)
        got = sorted(tuple(r) for r in kv.ticked(events, "node", "place", "wall").select(F.coalesce("place", F.lit(99)), "node", "physical", "logical").collect())
        assert got == [(1, "a", 9, 0), (1, "a", 9, 1), (1, "a", 9, 2), (2, "a", 9, 3), (3, "b", 2, 0), (3, "b", 2, 1), (99, "a", 9, 4), (99, "b", 4, 0)]


@pytest.mark.parametrize("metric", ["l2", "cosine", "dot"])
@pytest.mark.parametrize("broadcast", [10_000, 50])
def test_batches_meet_in_blocks_with_the_answers_of_each_pair(spark, monkeypatch, metric, broadcast):
    """Blocks give what each pair's distance gives: copies tie by id, and zero, extreme, null, shorter and non-finite vectors count as before."""
    monkeypatch.setattr(vectors, "BROADCAST_QUERIES", broadcast)
    monkeypatch.setattr(vectors, "BLOCK_BYTES", 4_000)
    rng = np.random.default_rng(5)
    x = rng.integers(-3, 4, (600, 8)).astype(float).tolist() + rng.standard_normal((300, 8)).tolist()
    x += [[0.5] * 8] * 70 + [[0.0] * 8] * 5 + [[1e200] * 8, [1e-200] * 8, [float("nan")] * 8, [float("inf")] * 8, [None] + [1.0] * 7, [], None] + rng.standard_normal((30, 3)).tolist()
    rng.shuffle(ids := list(range(len(x))))
    rows = spark.createDataFrame([(i, v, f"n{i}") for i, v in zip(ids, x, strict=True)], "id bigint, vector array<double>, name string").repartition(3)
    queries = rows.where("id % 3 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query"))
    got = vectors.batch_top_k(rows, queries, 4, metric)
    assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()
    met = rows.crossJoin(queries).where(F.size("vector") == F.size("query")).withColumn("distance", vectors.distance(F.col("vector"), F.col("query"), metric))
    met.createOrReplaceTempView("met_in_pairs")
    want = spark.sql("SELECT query_id, rank, id, name, distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM met_in_pairs) WHERE rank <= 4")
    assert sorted(map(repr, got.select(want.columns).collect())) == sorted(map(repr, want.collect()))
    assert vectors.batch_top_k(rows, queries, 0, metric).isEmpty()
