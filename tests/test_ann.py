"""The approximate index against exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearlight.operators import ann, search

VEC = "id long, vec array<double>"


def blobs(n, dim=24, centres=40, seed=1, spread=0.35):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, dim))
    # a third of all rows about one centre
    which = np.where(rng.random(n) < 0.33, 0, rng.integers(0, centres, n))
    return c[which] + spread * rng.normal(size=(n, dim))


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], VEC).repartition(4)


def asked(rows, every=40):
    return rows.filter(F.col("id") % every == 0).select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))


def hits(df):
    return sorted((r["qid"], r["rank"], r["id"], round(r["score"], 9)) for r in df.collect())


@pytest.mark.parametrize("metric", ["cosine", "euclid", "dot"])
def test_recall_is_measured_and_kept(spark, tmp_path, metric):
    rows = frame(spark, blobs(4000))
    index = ann.build(rows, f"file://{tmp_path}/i", metric)
    assert index.n == 4000 and index.sizes.sum() == 4000 and index.measured >= 0.95
    assert index.probes < len(index.centres)
    q = asked(rows)
    exact = search.topk(q, rows, 10, metric)
    again = ann.load(spark, f"file://{tmp_path}/i")
    found = again.search(q, 10)
    assert search.recall(exact, found).agg(F.avg("recall")).first()[0] >= 0.9
    assert hits(again.search(q, 10, exact=True)) == hits(exact)
    # scores are exact, whatever was found
    want = {(r["qid"], r["id"]): r["score"] for r in search.topk(q, rows, 4000, metric).collect()}
    assert all(abs(want[r["qid"], r["id"]] - r["score"]) < 1e-6 for r in found.collect())


@pytest.mark.parametrize("metric", ["cosine", "euclid"])
def test_all_lists_are_exact_by_every_way(spark, tmp_path, monkeypatch, metric):
    x = blobs(1500, dim=7)
    x[10] = 0
    x[20:30] = x[20]  # ties
    rows = frame(spark, x)
    index = ann.build(rows, f"file://{tmp_path}/i", metric)
    q, every = asked(rows, 7), len(index.centres)
    want = hits(search.topk(q, rows, 5, metric))
    assert hits(index.search(q, 5, probes=every, depth=0)) == want
    assert hits(index.search(q, 5, probes=every, depth=400)) == want
    monkeypatch.setattr(ann, "LUT_BYTES", 2 * ann.CODES * 4 * 64)  # several blocks of queries
    monkeypatch.setattr(ann, "BLOCKS", 1000)
    assert hits(index.search(q, 5, probes=every, depth=400)) == want
    monkeypatch.setattr(ann, "BLOCKS", 0)  # tiles joined by list
    assert hits(index.search(q, 5, probes=every)) == want


def test_few_rows_and_odd_vectors(spark, tmp_path):
    odd = [(None, [1.0, 0.0]), (100, None), (101, []), (102, [1.0]), (103, [float("nan"), 1.0]), (104, [None, 1.0]), (105, [1.0, 2.0, 3.0])]
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.5, 0.5]), *odd], VEC)
    index = ann.build(rows, f"file://{tmp_path}/i")
    q = spark.createDataFrame([(7, [1.0, 0.0]), (8, None), (9, [1.0])], "qid long, qvec array<double>")
    got = index.search(q, 10)
    assert [(r["qid"], r["id"]) for r in got.orderBy("rank").collect()] == [(7, 0), (7, 2), (7, 1)]
    assert index.search(q, 1).first()["id"] == 0
    assert index.search(q, 0).count() == 0


def test_k_reaches_beyond_the_probed_lists(spark, tmp_path):
    rows = frame(spark, blobs(600))
    index = ann.build(rows, f"file://{tmp_path}/i")
    q = asked(rows, 300)
    assert index.search(q, 250, probes=1, depth=0).groupBy("qid").count().filter("count = 250").count() == 2
    assert index.search(q, 10_000, probes=1, depth=0).count() == 1200


def test_empty(spark, tmp_path):
    index = ann.build(spark.createDataFrame([], VEC), f"file://{tmp_path}/i")
    q = spark.createDataFrame([(7, [1.0, 0.0])], "qid long, qvec array<double>")
    assert index.n == 0 and index.search(q, 3).count() == 0 and ann.load(spark, f"file://{tmp_path}/i").search(q, 3).count() == 0


def test_add(spark, tmp_path):
    x = blobs(1200)
    rows = frame(spark, x)
    index = ann.build(rows.filter("id < 1000"), f"file://{tmp_path}/i")
    index.add(rows.filter("id >= 1000"))
    assert index.n == 1200 and index.rows().count() == 1200 and index.sizes.sum() == 1200
    q = asked(rows.filter("id >= 1000"), 10)
    assert hits(index.search(q, 3, probes=len(index.centres), depth=0)) == hits(search.topk(q, rows, 3))


def test_lists_are_skipped(spark, tmp_path):
    """A search reads codes, and the vectors of few lists: the scan is filtered by list."""
    rows = frame(spark, blobs(2000))
    index = ann.build(rows, f"file://{tmp_path}/i")
    pairs = index.probed(asked(rows, 1000), 3, 1)
    plan = index.candidates(pairs, 10)._jdf.queryExecution().executedPlan().toString()
    assert "list IN (" in plan or "In(list" in plan or "list" in plan.split("PushedFilters")[1][:200]
    scan = [x for x in plan.split("\n") if "ReadSchema" in x][0]
    assert "code" in scan and "vec" not in scan.split("ReadSchema")[1]


def test_many_clusters_are_indexed(spark, monkeypatch):
    x = blobs(300)
    rows = frame(spark, x)
    clusters = rows.filter("id < 60").select(F.col("id").alias("cluster_id"), F.col("vec").alias("centroid"))
    want = search.nearest_clusters(rows, clusters, 2).collect()
    monkeypatch.setattr(search, "INDEX_BYTES", 1000)
    got = {(r["id"], r["cluster_id"]) for r in search.nearest_clusters(rows, clusters, 2).collect()}
    assert len(got) == 600 and len(got & {(r["id"], r["cluster_id"]) for r in want}) >= 0.9 * 600
