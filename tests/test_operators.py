import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nearlight.functions import cosine, phi, quantile_exclusive
from nearlight.operators import clustering, health, ranking, replication, search, store
from nearlight.plans import catalog
from nearlight.streaming import ingest


def test_cosine_of_zero_is_zero(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(cosine("a", "b")).collect()] == [1.0, 0.0, 0.0]


def test_topk_ties_nulls_and_dimensions(spark):
    v = spark.createDataFrame([(3, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0]), (4, None), (5, [1.0])], "id long, vec array<double>")
    q = spark.createDataFrame([(7, [1.0, 0.0])], "qid long, qvec array<double>")
    assert [(r["id"], r["rank"]) for r in search.topk(q, v, 2).orderBy("rank").collect()] == [(1, 1), (3, 2)]
    assert search.topk(q, v.limit(0), 2).count() == 0
    assert search.topk(q.limit(0), v, 2).count() == 0


def test_best_rows_in_many_batches():
    """What is added later enters by score, then by id, as if all were ranked at once."""
    rng = np.random.default_rng(5)
    q, x, ids = rng.integers(-2, 3, (7, 3)).astype(float), rng.integers(-2, 3, (900, 3)).astype(float), rng.permutation(900)
    for metric in ("cosine", "dot", "euclid"):
        best = search.Best(np.arange(7), q, 5, metric)
        for a in range(0, 900, 37):
            best.add(ids[a : a + 37], x[a : a + 37])
        s = search.scores(q, x, metric)
        for i, order in enumerate(np.lexsort((np.broadcast_to(ids, s.shape), -s), axis=1)[:, :5]):
            assert best.id[i].tolist() == ids[order].tolist() and np.allclose(best.score[i], s[i, order])


def test_routed_search_joins_hits_only(spark):
    """No join of queries with all rows of their nodes, of which there are a hundred times as many as hits."""
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=4).tolist(), i % 4) for i in range(2000)]
    v = spark.createDataFrame(rows, "id long, vec array<double>, cluster_id long")
    clusters = spark.createDataFrame([(c, rng.normal(size=4).tolist()) for c in range(4)], "cluster_id long, centroid array<double>")
    placement = spark.createDataFrame([(c, (c + d) % 4) for c in range(4) for d in (0, 1)], "cluster_id long, node_id long")
    q = v.filter("id < 100").select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = search.search_routed(q, clusters, placement, placement.select("node_id").distinct(), v.join(placement, "cluster_id"), 10, 3)
        assert len(out.collect()) == 1000
        nodes, joined = [out._jdf.queryExecution().executedPlan()], []
        while nodes:
            n = nodes.pop()
            nodes += [n.children().apply(i) for i in range(n.children().size())]
            if "Join" in n.nodeName():
                joined.append(n.metrics().get("numOutputRows").get().value())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert joined and max(joined) <= 4000  # as many as there are copies of rows; it had been 300 000


def test_upsert_needs_a_newer_version(spark):
    schema = "id long, vec array<double>, payload string, cluster_id long, ts double, node long"
    old = spark.createDataFrame([(1, None, "a", 0, 1.0, 0), (2, None, "b", 0, 1.0, 1)], schema)
    new = spark.createDataFrame([(1, None, "x", 0, 1.0, 0), (2, None, "y", 0, 1.0, 2), (3, None, "z", 0, None, None)], schema)
    assert {r["id"]: r["payload"] for r in store.upsert(old, new).collect()} == {1: "a", 2: "y", 3: "z"}
    assert sorted(r["id"] for r in store.accepted(old, new).collect()) == [2, 3]


def test_digest_diff(spark):
    a = spark.createDataFrame([(1, 1.0, 0), (2, 2.0, 0), (4, 1.0, 0)], "id long, ts double, node long")
    b = spark.createDataFrame([(2, 1.0, 0), (3, 1.0, 0), (4, 1.0, 0)], "id long, ts double, node long")
    assert {r["id"]: r["what"] for r in replication.digest_diff(a, b).collect()} == {1: "missing_there", 2: "newer_here", 3: "missing_here"}


def test_phi_is_capped(spark):
    got = [r[0] for r in spark.createDataFrame([(0.0,), (1e10,)], "y double").select(phi("y")).collect()]
    assert got[1] == 100.0 and math.isclose(got[0], -math.log10(0.5))


def test_exclusive_quantile(spark):
    import statistics

    v = [float(x * x % 37) for x in range(30)]
    df = spark.createDataFrame([(v,)], "v array<double>")
    assert math.isclose(df.select(quantile_exclusive("v", 0.95)).first()[0], statistics.quantiles(v, n=20)[18])


@settings(max_examples=20, deadline=None)
@given(st.integers(3, 40), st.integers(1, 4), st.integers(0, 99))
def test_bounded_split(n, k, seed):
    x = np.random.default_rng(seed).normal(size=(n, 2))
    limit = clustering.max_split_size(n, min(k, n))
    lab = clustering.bounded_kmeans(x, k, limit)
    assert len(lab) == n and np.bincount(lab).max() <= limit


def test_placement_gives_every_cluster_its_replicas():
    made = clustering.place({0: 10, 1: 20, 2: 30}, [0, 1, 2], 2)
    assert all(len(set(v)) == 2 for v in made.values()) and set(made) == {0, 1, 2}
    assert clustering.place({0: 1}, [], 2) == {}


def test_delete_keeps_null(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 6)], "id long, cluster_id long")
    assert sorted(r["id"] for r in store.delete_where(df, F.col("cluster_id") == 5).collect()) == [2, 3]


def test_ranks_with_nulls_ties_and_an_empty_table(spark):
    rows = [(1, "a", 3), (2, "a", 1), (3, None, 5), (4, None, 5), (5, "b", None), (6, "a", 2)]
    df = spark.createDataFrame(rows, "id long, g string, x long")
    got = {r["id"]: (r["rank"], r["total"]) for r in ranking.ranked(df, ["g"], ["x", "id"]).collect()}
    assert got == {1: (3, 3), 2: (1, 3), 6: (2, 3), 3: (1, 2), 4: (2, 2), 5: (1, 1)}
    assert [r["rank"] for r in ranking.ranked(df, [], ["id"]).orderBy("id").collect()] == [1, 2, 3, 4, 5, 6]
    assert ranking.ranked(df.limit(0), ["g"], ["x"]).count() == 0


def test_latency_of_few_and_many(spark):
    import statistics

    many = [float(x * x % 101) for x in range(150)]
    df = spark.createDataFrame([("many", x) for x in many] + [("few", 4.0), ("few", 2.0), ("few", None)], "op string, ms double")
    got = {r["op"]: r for r in health.latency(df, "op").collect()}
    cut = statistics.quantiles(many, n=100)
    assert math.isclose(got["many"]["p95"], cut[94]) and math.isclose(got["many"]["p99"], cut[98])
    assert math.isclose(got["many"]["median"], statistics.median(many))
    assert (got["few"]["n"], got["few"]["median"], got["few"]["p95"]) == (2, 3.0, 4.0)


def test_split_keeps_every_row_and_the_bound(spark):
    rng = np.random.default_rng(5)
    near, far = rng.normal(size=(90, 2)), rng.normal(size=(6, 2)) + 50
    rows = [(i, 0, x.tolist()) for i, x in enumerate(np.concatenate([near, far]))] + [(200, 1, [1.0, 2.0]), (201, 2, None), (202, None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "id long, cluster_id long, vec array<double>")
    got = clustering.split_clusters(df, 3).toPandas()
    assert sorted(got["id"]) == [*range(96), 200]
    assert got.groupby(["cluster_id", "label"]).size().max() <= clustering.max_split_size(96, 3)


def test_replayed_hints_lose_to_equal_versions(spark):
    schema = "id long, node_id long, cluster_id long, ts double, node long"
    stored = spark.createDataFrame([(1, 0, 5, 1.0, 0), (2, 0, 5, 1.0, 0)], schema)
    hints = spark.createDataFrame([(1, 0, 6, 1.0, 0), (2, 0, 6, 2.0, 0), (3, 0, 6, 1.0, 0), (4, 1, 6, 1.0, 0)], schema)
    got = replication.replay_hints(stored, hints, spark.createDataFrame([(0,)], "node_id long"))
    assert {r["id"]: r["cluster_id"] for r in got.collect()} == {1: 5, 2: 6, 3: 6}


def test_silhouette_takes_every_row(spark):
    rng = np.random.default_rng(8)
    lab = rng.choice([-3, 0, 7, 9], 2500, p=[0.2, 0.6, 0.1, 0.1])
    lab[17] = 50  # alone in its cluster
    x = rng.normal(size=(2500, 3)) + lab[:, None] / 5
    rows = [(i, int(c), v.tolist()) for i, (c, v) in enumerate(zip(lab, x))] + [(3000, None, [0.0] * 3), (3001, 0, None)]
    df = spark.createDataFrame(rows, "id long, cluster_id long, vec array<double>")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    want = []
    for i, c in enumerate(lab):
        mean = {k: d[i, lab == k].sum() / max((lab == k).sum() - (k == c), 1) for k in set(lab)}
        a, b = mean[c], min(m for k, m in mean.items() if k != c)
        want.append((b - a) / max(a, b) if (lab == c).sum() > 1 else 0)
    got = clustering.silhouette_score(df).first()
    assert got["n"] == 2500 and math.isclose(got["score"], np.mean(want), abs_tol=1e-9)
    assert tuple(clustering.silhouette_score(df.limit(0)).first()) == (None, 0)
    assert clustering.silhouette_score(df.filter("cluster_id = 7")).first()["score"] == -1


def test_select_k_finds_more_than_twelve_clusters(spark, tmp_path):
    rng = np.random.default_rng(4)
    lab = np.arange(16 * 25) % 16
    x = np.eye(16)[lab] * 10 + rng.normal(size=(400, 16)) / 100
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r["id"]: r["cluster_id"] for r in catalog.QUERIES["kmeans_select_k"](spark, str(tmp_path)).collect()}
    assert len(got) == 400 and len(set(got.values())) > 12
    assert len({(lab[i], c) for i, c in got.items()}) == 16 == len(set(got.values()))


def test_bootstrap_learns_its_clusters_and_keeps_every_row(spark):
    rng = np.random.default_rng(6)
    lab = np.arange(40) % 5
    x = np.eye(5)[lab] + rng.normal(size=(40, 5)) / 1000
    odd = {3: None, 7: [1.0], 33: None, 38: [1.0, 2.0]}
    df = spark.createDataFrame([(i, odd.get(i, v.tolist()), -1) for i, v in enumerate(x)], "id long, vec array<double>, cluster_id long")
    got = {r["id"]: r for r in ingest.bootstrap(spark, df, 20).collect()}
    assert sorted(got) == [*range(40)] and {r["state"] for r in got.values()} == {"clustered"}
    assert {i for i, r in got.items() if r["cluster_id"] == -1} == set(odd)
    assert len({(lab[i], r["cluster_id"]) for i, r in got.items() if i not in odd}) == 5 == len({r["cluster_id"] for r in got.values()} - {-1})
    waiting = ingest.bootstrap(spark, df, 41).collect()
    assert len(waiting) == 40 and {r["state"] for r in waiting} == {"bootstrap"}


def rows_of(spark, n, dim=2, start=0):
    rng = np.random.default_rng(start + n)
    data = [(i, rng.normal(size=dim).tolist(), f"p{i}", i) for i in range(start, start + n)]
    return spark.createDataFrame(data, "ord long, vec array<double>, payload string, k long").drop("k")


def test_euclid_of_long_vectors(spark):
    v = spark.createDataFrame([(1, [1e8, 1.0]), (2, [1e8, 0.0]), (3, [1e8, 3.0]), (4, [float("nan"), 0.0]), (5, [float("inf"), 0.0])], "id long, vec array<double>")
    q = spark.createDataFrame([(7, [1e8, 0.0])], "qid long, qvec array<double>")
    got = [(r["id"], r["score"]) for r in search.topk(q, v, 3, "euclid").orderBy("rank").collect()]
    assert got == [(2, 0.0), (1, 1.0), (3, 3.0)]
    assert [r["id"] for r in search.topk(q, v, 9, "dot").orderBy("rank").collect()] == [1, 2, 3]


@settings(max_examples=25, deadline=None)
@given(st.integers(1, 40), st.integers(1, 6), st.integers(1, 5), st.sampled_from(["cosine", "dot", "euclid"]), st.integers(0, 99))
def test_running_best_is_the_best(n, nq, k, metric, seed):
    rng = np.random.default_rng(seed)
    x, q = rng.integers(-2, 3, (n, 3)).astype(float), rng.integers(-2, 3, (nq, 3)).astype(float)
    ids = rng.permutation(n)
    b = search.Best(np.arange(nq), q, k, metric)
    for part in np.array_split(np.arange(n), 3):
        if len(part):
            b.add(ids[part], x[part])
    s = search.scores(q, x, metric)
    for i in range(nq):
        want = sorted(range(n), key=lambda j: (-s[i, j], ids[j]))[:k]
        assert b.id[i].tolist() == ids[want].tolist()


def test_queries_in_blocks(spark, monkeypatch):
    v = rows_of(spark, 60, 3).withColumnRenamed("ord", "id")
    q = v.select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    whole = sorted(map(tuple, search.topk(q, v, 4).collect()))
    monkeypatch.setattr(search, "QUERY_BYTES", 700)
    assert sorted(map(tuple, search.topk(q, v, 4).collect())) == whole


def test_large_index_is_joined(spark, monkeypatch):
    v = rows_of(spark, 40, 3).withColumnRenamed("ord", "id")
    c = rows_of(spark, 6, 3, 100).select(F.col("ord").alias("cluster_id"), F.col("vec").alias("centroid"))
    p = c.select("cluster_id", F.explode(F.array(F.col("cluster_id") % 4, (F.col("cluster_id") + 1) % 4)).alias("node_id"))
    live = spark.createDataFrame([(0,), (1,), (3,)], "node_id long")

    def all_():
        parts = [search.nearest_clusters(v, c, 2), search.node_similarity(v, c, p), search.route(v, c, p, live, 2, 1), search.nearest_by_euclid(v, c)]
        return [sorted(tuple(round(x, 9) for x in r) for r in part.collect()) for part in parts]

    small = all_()
    monkeypatch.setattr(search, "INDEX_BYTES", 0)
    assert all_() == small


def test_batch_insert_comes_one_by_one(spark):
    schema = "id long, seq string, ts double, node long, at long"
    old = spark.createDataFrame([(1, "old", 5.0, 0, 0)], schema)
    new = spark.createDataFrame([(1, "a", 6.0, 0, 0), (1, "b", 6.0, 0, 1), (1, "c", 5.5, 0, 2), (1, "d", 7.0, 0, 3), (2, "e", 1.0, 0, 4), (2, "f", 1.0, 0, 5)], schema)
    table, n = store.insert_batch(old, new, "at")
    assert {r["id"]: r["seq"] for r in table.collect()} == {1: "d", 2: "e"} and n.first()["n"] == 3
    assert sorted(r["seq"] for r in store.accepted(old, new, "at").collect()) == ["a", "d", "e"]


def test_place_is_near_the_best_sum_of_squares():
    import itertools

    for sizes in ([9, 7, 5, 4, 2], [6, 6, 6, 1], [10, 1, 1, 1, 1]):
        made = clustering.place(dict(enumerate(sizes)), [0, 1, 2, 3], 2)
        score = lambda m: sum(sum(s for c, s in enumerate(sizes) if n in m[c]) ** 2 for n in range(4))
        pairs = list(itertools.combinations(range(4), 2))
        assert score(made) == min(score(dict(enumerate(m))) for m in itertools.product(pairs, repeat=len(sizes)))
    assert clustering.place({1: 3}, [], 2) == {} and clustering.place({1: 3}, [5], 2) == {1: (5,)}


def test_split_is_bounded_and_whole(spark):
    rng = np.random.default_rng(1)
    pts = np.concatenate([rng.normal(0, 0.1, (20, 2)), [[1000.0, 1000.0]]])
    v = spark.createDataFrame([(i, 4, p.tolist()) for i, p in enumerate(pts)], "id long, cluster_id long, vec array<double>")
    got = clustering.split_clusters(v, 2).toPandas()
    assert sorted(got["id"]) == list(range(21)) and got.groupby("label").size().max() <= clustering.max_split_size(21, 2)


def engine_of(spark, n=60, threshold=50):
    from nearlight.operators.engine import Engine

    e = Engine(spark, [0, 1, 2, 3], 2, threshold)
    rng = np.random.default_rng(3)
    data = [(i, (np.array([[0, 10], [10, 0], [-10, 0], [0, -10], [10, 10], [-10, -10]][i % 6]) + rng.normal(0, 0.1, 2)).tolist(), f"p{i}") for i in range(n)]
    df = spark.createDataFrame(data, "ord long, vec array<double>, payload string")
    return e, df


def test_engine_from_buffer_to_search_and_heal(spark):
    e, df = engine_of(spark)
    e.insert(df.filter("ord < 20"), "ord", 1.0)
    q = spark.createDataFrame([(1, [0.0, 10.0])], "qid long, qvec array<double>")
    assert e.status == "bootstrap" and e.query(q, 3).count() == 3
    e.insert(df.filter("ord >= 20"), "ord", 2.0)
    assert e.status == "clustered" and e.buffer.count() == 0 and e.topology.version == 1
    check = replication.replication_check(e.replicas, 2).first()
    assert (check["n_unique"], check["n_total"], check["complete"]) == (60, 120, True)
    hits = e.query(q, 5).collect()
    assert len(hits) == 5 and all(abs(r["vec"][1] - 10) < 1 and abs(r["vec"][0]) < 1 for r in hits)
    ids = {r["id"] for r in e.replicas.select("id").collect()}
    assert len(ids) == 60 and all(i % 10 == 3 for i in ids)  # counter * 10 + coordinator
    change = e.set_active([0, 1, 2])
    assert [tuple(r) for r in change.collect()] == [(3, "left")] and e.coordinator == 2
    more = df.limit(12).withColumn("ord", F.col("ord") + 100).withColumn("vec", F.transform("vec", lambda x: x + 0.01))
    e.insert(more, "ord", 3.0)
    waiting = e.hints.count()
    assert waiting + e.replicas.count() == 144 and {r["target_id"] for r in e.hints.collect()} <= {3}
    e.set_active([0, 1, 2, 3])
    check = replication.replication_check(e.replicas, 2).first()
    assert (check["n_unique"], check["n_total"], check["complete"]) == (72, 144, True) and e.hints.count() == 0


def test_engine_forwards_refuses_and_drops(spark):
    e, df = engine_of(spark)
    q = spark.createDataFrame([(1, [0.0, 10.0])], "qid long, qvec array<double>")
    rows = df.limit(5).withColumn("ord", F.col("ord") + 1000)
    e.insert(df.filter("ord < 20"), "ord", 1.0)
    held = e.buffer.count()
    assert e.coordinator == 3 and e.receive(e.buffer.limit(4), "client", at=1) == "forward" and e.buffer.count() == held
    assert e.receive(e.buffer, "bootstrap", at=1) == "refuse" == e.receive(e.buffer, "other")
    assert e.query(q, 3, at=0).count() == 3 == e.query(q, 3).count()
    lost = e.dropped
    e.set_active([])  # nobody is reachable, so nobody coordinates
    assert e.receive(e.buffer, "client", at=1) == "drop" and e.dropped == lost + held and e.query(q, 3, at=1).count() == 0
    e.set_active([0, 1, 2, 3])
    e.insert(rows, "ord", 2.0)
    assert e.buffer.count() == held + 5


def test_without_order_only_the_newest_is_taken(spark):
    stored = spark.createDataFrame([(1, 2.0, 0)], "id long, ts double, node long")
    new = spark.createDataFrame([(1, 1.0, 0, "a"), (1, 3.0, 0, "b"), (1, 4.0, 0, "c"), (1, 4.0, 0, "d"), (2, 1.0, 0, "e")], "id long, ts double, node long, p string")
    first = {tuple(r) for r in store.accepted(stored, new).collect()}
    assert len(first) == 2 and {r[:2] for r in first} == {(1, 4.0), (2, 1.0)}
    assert {tuple(r) for r in store.accepted(stored, new.repartition(4)).collect()} == first
    kept = store.upsert(stored.withColumn("p", F.lit("s")), new).filter("id = 1").first()
    assert kept == store.upsert(stored.withColumn("p", F.lit("s")), new.repartition(3)).filter("id = 1").first() and kept["ts"] == 4.0


def test_beats_are_jittered_within_their_bounds(spark):
    s = spark.range(2000).select(health.jittered(1).alias("s")).agg(F.min("s").alias("lo"), F.max("s").alias("hi")).first()
    assert 2.5 <= s["lo"] < 2.55 and 3.45 < s["hi"] <= 3.5
    assert spark.range(50).select(health.jittered(1, 0.0, 0.05).alias("s")).agg(F.min("s")).first()[0] == 0.1
    asked = spark.createDataFrame([(1, True), (2, False)], "peer_id long, answered boolean")
    assert [tuple(r) for r in health.first_contact(asked, 5).collect()] == [(1, 5.0)]


def test_engine_rows_wait_for_a_split(spark):
    e, df = engine_of(spark)
    e.insert(df, "ord", 1.0)
    cluster = e.topology.clusters.orderBy("cluster_id").first()["cluster_id"]
    row = e.replicas.filter(F.col("cluster_id") == cluster).first()
    e.begin_split(cluster)
    new = spark.createDataFrame([(999, list(row["vec"]), "late")], "ord long, vec array<double>, payload string")
    e.insert(new, "ord", 5.0)
    assert e.pending.count() == 1 and e.replicas.filter("payload = 'late'").count() == 0
    e.end_split()
    assert e.pending.count() == 0 and e.replicas.filter("payload = 'late'").count() == 2
    assert e.receive(e.replicas.limit(0), "other") == "refuse"


def test_rebalance_splits_the_fullest_cluster(spark):
    from nearlight.operators import rebalance

    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=2).tolist(), f"p{i}", 0 if i < 80 else 1 + i % 3, 1.0, 0) for i in range(110)]
    v = spark.createDataFrame(rows, "id long, vec array<double>, payload string, cluster_id long, ts double, node long")
    place = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 2), (2, 2), (2, 3), (3, 3), (3, 0)], "cluster_id long, node_id long")
    copies = v.join(place, "cluster_id").select(*v.columns, "node_id")
    topology = rebalance.empty(spark).with_clusters(None, clustering.centroids(v), place)
    nodes = spark.createDataFrame([(n,) for n in range(4)], "node_id long")
    after, new, moved = rebalance.rebalance(copies, topology, nodes, 0, 2)
    assert moved and new.version == topology.version + 1
    got = after.toPandas()
    assert set(got["id"]) == set(range(110)) and len(got) == 220 and (got.groupby("id")["node_id"].nunique() == 2).all()
    sizes = got.drop_duplicates("id").groupby("cluster_id").size()
    assert 0 not in sizes and sizes[sizes.index > 3].sum() == 80 and sizes[sizes.index > 3].max() <= clustering.max_split_size(80, 3)
    assert {r["cluster_id"] for r in new.clusters.collect()} == set(sizes.index)
    assert {(r["cluster_id"], r["node_id"]) for r in new.placement.collect()} >= {(c, n) for c, n in zip(got["cluster_id"], got["node_id"])}
    before, after_n = copies.groupBy("node_id").count().toPandas()["count"], got.groupby("node_id").size()
    assert after_n.max() < before.max()
    assert not rebalance.rebalance(copies, topology, nodes.limit(1), 0, 2)[2]  # one node alone
    assert not rebalance.rebalance(copies, topology, nodes, 0, 2, tolerance=9)[2]
    assert rebalance.plan_split(copies, topology, nodes, 0, 77, 2) is None
    few = v.limit(2).join(place.limit(2), "cluster_id").select(*v.columns, "node_id")
    plan, labels = rebalance.plan_split(few, topology, nodes, 0, 0, 2)
    assert plan.count() == 1 and {r["label"] for r in labels.collect()} == {0}
    assert rebalance.due(86_400, "clustered") and not rebalance.due(86_400, "bootstrap")


def test_collections(spark):
    from nearlight.session import kept_dir
    from nearlight.sources.collections import Collections

    c = Collections(spark, kept_dir(spark, "c"))
    assert c.create("a", 2, "Euclid") and not c.create("a", 2) and c.about("a") == (2, "euclid") and c.count("a") == 0
    rows = spark.createDataFrame([(1, [1.0, 0.0], "x", 5, 1.0, 0), (2, [0.0, 1.0], "y", 10, 1.0, 0)], "id long, vec array<float>, payload string, cluster_id long, ts double, node long")
    assert c.insert("a", rows, "1") == 2 == c.insert("a", rows, "1") and c.count("a") == 2
    plan = c.scan("a", 5)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and [r["id"] for r in c.scan("a", 5).collect()] == [1]
    q = spark.createDataFrame([(9, [1.0, 0.1])], "qid long, qvec array<double>")
    assert [(r["id"], r["payload"]) for r in c.query("a", q, 1).collect()] == [(1, "x")]
    try:
        c.insert("a", rows.withColumn("vec", F.array(F.lit(1.0)).cast("array<float>")), "2")
        raise AssertionError("another dimension was taken")
    except Exception as e:
        assert "has 2 components" in str(e)
    assert c.drop("a") and c.drop("a") and not c._exists(f"{c.base}/a")


def test_requests_and_report(spark, tmp_path):
    from nearlight.sources import requests

    text = [r[0] for r in spark.createDataFrame([("<a href='x'>&\"",)], "t string").select(requests.escaped(F.col("t"))).collect()]
    assert text == ["&lt;a href=&#39;x&#39;&gt;&amp;&quot;"]
    k = [r[0] for r in spark.createDataFrame([(0,), (7,), (500,)], "k int").select(requests.clamped(F.col("k"))).collect()]
    assert k == [1, 7, 100]
    s = spark.createDataFrame([("sanity_check", 1), ("balanced", 2)], "scenario string, n int")
    requests.write_report(s, f"file://{tmp_path}/r")
    assert [r["scenario"] for r in spark.read.json(f"file://{tmp_path}/r").collect()] == ["balanced"]


def test_stream_restart_keeps_the_table(spark):
    from nearlight.session import kept_dir

    schema = spark.createDataFrame([], "id long, ts double, node long").schema
    source, path, ck = kept_dir(spark, "s"), kept_dir(spark, "t"), kept_dir(spark, "k")
    spark.createDataFrame([(1, 1.0, 0), (2, 1.0, 0)], schema).write.parquet(source)
    assert ingest.upsert_stream(spark, source, schema, path, ck).count() == 2
    assert ingest.upsert_stream(spark, source, schema, path, ck).count() == 2  # nothing new
    spark.createDataFrame([(2, 2.0, 0), (3, 1.0, 0)], schema).write.mode("append").parquet(source)
    assert sorted((r["id"], r["ts"]) for r in ingest.upsert_stream(spark, source, schema, path, ck).collect()) == [(1, 1.0), (2, 2.0), (3, 1.0)]


def test_hints_are_taken_once(spark):
    hints = spark.createDataFrame([(1, 5, 0), (2, 5, 1), (3, 6, 2)], "id long, target_id long, seq long")
    mine, rest = replication.take_hints(replication.add_hints(hints, 5, spark.createDataFrame([(4, 3)], "id long, seq long")), 5)
    assert [r["id"] for r in mine.collect()] == [1, 2, 4] and [r["id"] for r in rest.collect()] == [3]
    assert {(r["target_id"], r["n"]) for r in replication.hint_counts(hints).collect()} == {(5, 2), (6, 1)}
