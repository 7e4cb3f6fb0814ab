"""Placement, choice of k, silhouettes, what a split leaves at home, reconciliation of all nodes, the monitor."""

import itertools
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearlight.operators import clustering, rebalance, replication
from nearlight.session import work_dir


def every_set(sizes, nodes, rf, beam):
    """The beam over all combinations."""
    rf = min(rf, len(nodes))
    states = [({n: 0 for n in nodes}, {})]
    for c in sorted(sizes, key=lambda c: (-sizes[c], c)):
        following = []
        for loads, made in states:
            for combo in itertools.combinations(sorted(nodes), rf):
                new = loads | {n: loads[n] + sizes[c] for n in combo}
                following.append((sum(v * v for v in new.values()), len(following), new, made | {c: combo}))
        following.sort(key=lambda s: s[:2])
        states = [(s[2], s[3]) for s in following[:beam]]
    return states[0][1]


def test_best_first_placement_is_the_beam():
    rng = random.Random(4)
    for _ in range(80):
        sizes = {c: rng.randint(0, rng.choice([3, 40])) for c in range(rng.randint(1, 8))}
        nodes = sorted(rng.sample(range(60), rng.randint(1, 7)))
        rf, beam = rng.randint(1, 4), rng.choice([1, 6, 50])
        assert clustering.place(sizes, nodes, rf, beam) == every_set(sizes, nodes, rf, beam)
    assert clustering.place({}, [1], 1) == {} and clustering.place({1: 1}, [], 2) == {}


def test_placement_on_a_thousand_nodes():
    began = time.monotonic()
    made = clustering.place({c: 1 + c * 37 % 1000 for c in range(400)}, list(range(1000)), 3)
    assert time.monotonic() - began < 60 and all(len(set(x)) == 3 for x in made.values())
    load = np.zeros(1000)
    for c, x in made.items():
        load[list(x)] += 1 + c * 37 % 1000
    assert load.max() <= 1.5 * max(1 + c * 37 % 1000 for c in range(400))


def blobs(spark, k, n, dim=8, seed=3):
    rng = np.random.default_rng(seed)
    c = 20 * rng.normal(size=(k, dim))
    return spark.createDataFrame([(i, (c[i % k] + rng.normal(size=dim)).tolist(), i % k) for i in range(n)], "id long, vec array<double>, cluster_id long")


@pytest.mark.parametrize("k", [5, 17])
def test_all_k_settle_together(spark, k):
    rows = blobs(spark, k, 900)
    found, got = clustering.choose_k(rows)
    assert got == k
    pairs = found.withColumnRenamed("cluster_id", "c").join(rows, "id").select("c", "cluster_id").distinct()
    assert pairs.count() == k  # one to one
    assert clustering.choose_k(rows.limit(3))[1] == 1 and clustering.choose_k(rows.limit(0))[0].count() == 0


def test_passes_move_all_models_by_all_rows(spark):
    rows = blobs(spark, 3, 200, 2)
    x = np.array([r["vec"] for r in rows.collect()])
    models = {2: x[:2], 3: x[:3], 4: np.vstack([x[:3], [[1e6, 1e6]]])}
    new, moved = clustering._pass(rows.repartition(5), models)
    for k, c in models.items():
        lab = clustering.distances(x, c).argmin(1)
        np.testing.assert_allclose(new[k], [x[lab == i].mean(0) if (lab == i).any() else c[i] for i in range(k)])
    assert moved > 0


def test_estimated_silhouette_keeps_its_bound(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=3).tolist(), int(rng.integers(0, 6)) if i % 3 else 0) for i in range(900)]
    v = spark.createDataFrame(rows, "id long, vec array<double>, cluster_id long").repartition(5)
    exact = clustering.silhouette_score(v).first()["score"]
    all_ = clustering.silhouette_estimate(v, 10_000).first()
    assert abs(all_["score"] - exact) < 1e-9 and all_["sampled"] == 900 and all_["bound"] < 0.1
    for rows in (20, 200):
        some = clustering.silhouette_estimate(v, rows).first()
        assert some["sampled"] == rows and abs(some["score"] - exact) <= some["bound"]
    assert tuple(clustering.silhouette_estimate(v.limit(0)).first()) == (None, None, 0, 0)
    assert clustering.silhouette_estimate(v.filter("cluster_id = 1")).first()["score"] == -1


# --- splits


def layout(spark, copies):
    """``{(cluster, node): rows}``: replicas; ids are shared by the nodes of a cluster."""
    rng = np.random.default_rng(1)
    rows = [(c * 1000 + i, rng.normal(size=2).tolist(), "p", c, 1.0, 0, n) for (c, n), k in copies.items() for i in range(k)]
    return spark.createDataFrame(rows, "id long, vec array<double>, payload string, cluster_id long, ts double, node long, node_id long")


def nodes_of(spark, n):
    return spark.createDataFrame([(i,) for i in range(n)], "node_id long")


def topology_of(spark, copies):
    place = spark.createDataFrame([(c, n) for c, n in copies], "cluster_id long, node_id long")
    return rebalance.empty(spark).with_clusters(None, clustering.centroids(layout(spark, copies).dropDuplicates(["id"])), place)


def test_a_split_without_home_keeps_a_part_only_if_it_must(spark):
    for rest, stays in ((0, True), (300, False)):
        copies = {(0, 0): 90, (0, 1): 90, (1, 1): 100, (2, 2): 150, (3, 0): rest}
        copies = {k: v for k, v in copies.items() if v}
        r = layout(spark, copies)
        plan, labels = rebalance.plan_split(r, topology_of(spark, copies), nodes_of(spark, 3), 0, 0, 1, home=False)
        to = {x["label"]: x["destinations"][0] for x in plan.collect()}
        assert to[0] != 0 and to[1] != 0 and (to[2] == 0) == (stays or set(to.values()) == {0, 1, 2})
        assert rebalance.plan_split(r, topology_of(spark, copies), nodes_of(spark, 3), 0, 0, 1)[0].filter("label = 0").first()["destinations"] == [0]


def test_a_split_does_not_empty_its_node(spark):
    copies = {(0, 0): 60, (0, 1): 60, (1, 1): 100, (2, 2): 150, (2, 3): 150}
    r, top = layout(spark, copies), topology_of(spark, copies)
    labels = r.filter("cluster_id = 0").select("id", (F.col("id") % 6 > 3).cast("long").alias("label")).distinct()  # label 1 is the smaller
    plan = spark.createDataFrame([(0, 10, [0.0, 0.0], [1, 2]), (1, 11, [1.0, 1.0], [2, 3])], "label long, new_id long, centroid array<double>, destinations array<long>")
    away, _ = rebalance.split(r, top, 0, plan, labels)
    assert away.filter("node_id = 0").count() == 0
    out, new = rebalance.split(r, top, 0, plan, labels, 0, nodes_of(spark, 4))
    assert {(x["cluster_id"], x["node_id"]) for x in out.filter("cluster_id > 9").select("cluster_id", "node_id").distinct().collect()} == {(10, 1), (10, 2), (11, 2), (11, 0)}
    assert out.filter("node_id = 0").count() == 20 and {(x["cluster_id"], x["node_id"]) for x in new.placement.filter("cluster_id = 11").collect()} == {(11, 2), (11, 0)}
    single = plan.withColumn("destinations", F.slice("destinations", 1, 1))
    out, _ = rebalance.split(r, top, 0, single, labels, 0, nodes_of(spark, 4))
    assert {x["node_id"] for x in out.filter("cluster_id = 11").collect()} == {2, 0}
    # a node that has enough left, and one that keeps a part anyway
    full = r.unionByName(layout(spark, {(7, 0): 400}))
    assert rebalance.split(full, top, 0, plan, labels, 0, nodes_of(spark, 4))[0].filter("node_id = 0 and cluster_id > 9").count() == 0
    home = plan.withColumn("destinations", F.array(F.lit(0).cast("long"), F.lit(2).cast("long")))
    assert rebalance.split(r, top, 0, home, labels, 0, nodes_of(spark, 4))[0].filter("node_id = 0").count() == 60


def test_monitor_looks_again_and_again(spark):
    looks, state = [], ["bootstrap"]

    def look():
        looks.append(time.monotonic())
        if len(looks) == 1:
            raise ValueError("a look that fails")

    began = time.monotonic()
    q = rebalance.monitor(spark, look, lambda: state[0], work_dir(spark, "monitor"), 1)
    try:
        time.sleep(4)
        assert not looks  # nothing is clustered yet
        state[0] = "clustered"
        while len(looks) < 3 and time.monotonic() - began < 60:
            time.sleep(0.2)
        assert len(looks) >= 3 and q.isActive
    finally:
        q.stop()


# --- reconciliation


def brute_pairs(copies, nodes, homes):
    """All pairs compare, again and again until nothing moves; ``copies``: {(id, node): (ts, writer, destinations)}."""
    copies, changed = dict(copies), True
    while changed:
        changed = False
        for a, b in itertools.permutations(nodes, 2):
            for (i, n), row in list(copies.items()):
                if n == a:
                    hold = b in (row[2] or (homes.get(i, []) if homes is not None else nodes))
                    mine = copies.get((i, b))
                    if hold and (mine is None or row[:2] > mine[:2]):
                        copies[i, b] = row
                        changed = True
    return copies


@pytest.mark.parametrize("calculated", [True, False])
def test_eight_nodes_reconcile_in_one_plan(spark, calculated):
    rng = random.Random(8)
    nodes, homes = [0, 1, 2, 3, 4, 6, 7], {i: rng.sample(range(8), 3) for i in range(150)}
    copies = {}
    for i in range(150):
        to = None if rng.random() < 0.8 else sorted(rng.sample(range(8), 2))
        version = {v: (float(v), rng.randint(0, 2), to) for v in range(3)}
        for n in homes[i] if i % 3 else range(8):
            if i % 5 == 0 or rng.random() < 0.7:
                copies[i, n] = version[2] if i % 5 == 0 else version[rng.randint(0, 2)]
    r = spark.createDataFrame([(i, n, [float(ts)], ts, w, d) for (i, n), (ts, w, d) in copies.items()], "id long, node_id long, vec array<double>, ts double, node long, destinations array<long>").repartition(3)
    calc = spark.createDataFrame([(i, h) for i, h in homes.items() if i != 33], "id long, destinations array<long>") if calculated else None
    homes.pop(33)
    active = spark.createDataFrame([(n,) for n in nodes], "node_id long")
    out, told = replication.reconcile_all(r, active, calc, 64)
    got = {(x["id"], x["node_id"]): (x["ts"], x["node"], x["destinations"]) for x in out.collect()}
    want = brute_pairs(copies, nodes, homes if calculated else None)
    assert out.count() == len(got) and {k: v[:2] for k, v in got.items()} == {k: v[:2] for k, v in want.items()}
    assert all(x["vec"] == [x["ts"]] for x in out.collect())
    assert told.agg(F.sum("n")).first()[0] == sum(copies.get(k) is None or copies[k][:2] != v[:2] for k, v in want.items())
    moves, differ = replication.missing_copies(out, active, calc, 64)
    assert moves.count() == 0
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("\n") < 120


def test_settled_ranges_are_not_compared(spark):
    r = spark.range(5000).select("id", F.explode(F.array(*[F.lit(n).cast("long") for n in range(4)])).alias("node_id"), F.lit(1.0).alias("ts"), F.lit(0).cast("long").alias("node"))
    r = r.withColumn("ts", F.when((F.col("id") == 77) & (F.col("node_id") == 2), 0.5).otherwise(F.col("ts"))).filter("not (id = 4000 and node_id = 1)")
    moves, differ = replication.missing_copies(r, nodes_of(spark, 4))
    assert {tuple(x) for x in moves.collect()} == {(77, 0, 2), (4000, 0, 1)} and differ.count() == 2


def test_sketches_merge(spark):
    rows = spark.range(30_000).select((F.col("id") % 20_000).alias("id"), (F.col("id") % 3).alias("node_id"), (F.col("id") % 5).alias("batch"))
    kept = replication.id_sketches(rows, "node_id", "batch")
    assert kept.count() == 15
    assert abs(replication.merged_sketches(kept).first()["ids"] - 20_000) < 600
    for x in replication.merged_sketches(kept, "node_id").join(rows.groupBy("node_id").agg(F.countDistinct("id").alias("n")), "node_id").collect():
        assert abs(x["ids"] - x["n"]) < 0.03 * x["n"]


def test_peer_lists(spark, tmp_path):
    from nearlight.sources import tables

    path = f"file://{tmp_path}/peers.json"
    assert tables.write_peers(spark, [("a", 1), ("", "2"), (" a ", 1)], path) == 3
    assert {tuple(r) for r in tables.peers(spark, path).collect()} >= {(1, "127.0.0.1", 2)} and tables.peers(spark, path).count() == 2
    assert [r["id"] for r in tables.peers(spark, path, me=1).collect()] == [0]
    with pytest.raises(ValueError):
        tables.write_peers(spark, [("a", "x")], path)
