"""Exact and routed similarity search.

Queries travel, vectors stay: a block of queries of bounded size goes to every task, and each task
carries a running top k through its rows. A cluster index (centroids and placement) travels the same
way up to ``INDEX_BYTES``; beyond that, clusters get an approximate index of their own (:mod:`nearlight.operators.ann`)
that vectors meet list by list, and placement is joined. Vectors that are null or hold null or non-finite components match nothing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearlight.operators.vectors import usable
from nearlight.session import cut, kept_dir, ship

#: Bytes of query vectors, and of running answers, that one pass over the vectors carries.
QUERY_BYTES = 64 << 20
INDEX_BYTES = 64 << 20
CELLS = 4 << 20  # scores that are held at a time
HITS = "qid long, id long, score double"


def scores(q: np.ndarray, x: np.ndarray, metric: str, k: int | None = None) -> np.ndarray:
    """Query-by-row scores, higher is better; zero vectors score 0 under cosine.

    The Euclidean expansion loses small distances between long vectors, so it only picks, by its
    error bound, the rows that can be among the ``k`` nearest (all without ``k``); these are measured
    by differences, the others are -inf."""
    if metric == "euclid":
        qq, xx = (q * q).sum(1)[:, None], (x * x).sum(1)[None, :]
        near, slack = qq + xx - 2 * (q @ x.T), 4e-16 * (q.shape[1] + 4) * (qq + xx)
        if k is None or k >= len(x):
            i, j = np.indices(near.shape).reshape(2, -1)
        else:
            kth = np.partition(near + slack, k - 1, axis=1)[:, k - 1 : k]
            i, j = np.nonzero(near - slack <= kth)
        s = np.full(near.shape, -np.inf)
        step = max(1, CELLS // q.shape[1])
        for a in range(0, len(i), step):
            t = slice(a, a + step)
            s[i[t], j[t]] = -np.sqrt(((q[i[t]] - x[j[t]]) ** 2).sum(1))
        return s
    s = q @ x.T
    if metric == "cosine":
        n = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :]
        s = np.divide(s, n, out=np.zeros_like(s), where=n > 0)
    return s


class Best:
    """The running ``k`` best rows of each of some queries, ties to the least id."""

    def __init__(self, qid: np.ndarray, q: np.ndarray, k: int, metric: str):
        self.qid, self.q, self.k, self.metric = qid, q, k, metric
        self.score = np.full((len(qid), 0), 0.0)
        self.id = np.zeros((len(qid), 0), np.int64)

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        step = max(16, CELLS // len(self.qid))
        for a in range(0, len(ids), step):
            order = np.argsort(ids[a : a + step], kind="stable")
            rid = ids[a : a + step][order]
            s = scores(self.q, x[a : a + step][order], self.metric, self.k)
            if self.score.shape[1] == self.k > 0:
                self._enter(s, rid)
                continue
            top = np.argsort(-s, axis=1, kind="stable")[:, : self.k]
            score = np.hstack([self.score, np.take_along_axis(s, top, 1)])
            rid = np.hstack([self.id, rid[top]])
            keep = np.lexsort((rid, -score), axis=1)[:, : self.k]
            self.score, self.id = np.take_along_axis(score, keep, 1), np.take_along_axis(rid, keep, 1)

    def _enter(self, s: np.ndarray, rid: np.ndarray) -> None:
        """Only what reaches a query's last place is ranked."""
        i, j = np.nonzero(s >= self.score[:, -1:])
        if not len(i):
            return
        some = np.unique(i)
        of = np.concatenate([np.repeat(some, self.k), i])
        score, ids = np.concatenate([self.score[some].ravel(), s[i, j]]), np.concatenate([self.id[some].ravel(), rid[j]])
        order = np.lexsort((ids, -score, of))
        keep = order[np.searchsorted(of[order], some)[:, None] + np.arange(self.k)]
        self.score[some], self.id[some] = score[keep], ids[keep]

    def rows(self) -> pd.DataFrame:
        m = self.id.shape[1]
        out = pd.DataFrame({"qid": np.repeat(self.qid, m), "id": self.id.ravel(), "score": self.score.ravel()})
        return out[np.isfinite(out["score"])]


def _scan(vectors: DataFrame, block: list[tuple], k: int, metric: str) -> DataFrame:
    """The best rows of ``vectors(part, id, vec)`` in each task for the queries ``(qid, qvec, part)``."""
    held: dict = {}
    for qid, vec, part in block:
        held.setdefault((part, len(vec)), []).append((qid, vec))
    sent = vectors.sparkSession.sparkContext.broadcast(  # QUERY_BYTES at most
        {key: (np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.float64)) for key, rows in held.items()}
    )

    def run(batches):
        best = {key: Best(qid, q, k, metric) for key, (qid, q) in sent.value.items()}
        for pdf in batches:
            vec, part = pdf["vec"].to_numpy(), pdf["part"].to_numpy()
            dim = np.array([len(v) for v in vec], np.int64)
            for (p, d), b in best.items():
                t = np.flatnonzero((part == p) & (dim == d))
                if len(t):
                    b.add(pdf["id"].to_numpy(np.int64)[t], np.array([vec[i] for i in t], np.float64))
        for b in best.values():
            yield b.rows()

    return vectors.filter(usable("vec")).filter("id is not null").select("part", "id", "vec").mapInPandas(run, HITS)


def _blocks(queries: DataFrame, k: int):
    """``queries(qid, qvec, part)`` as lists of bounded size, by a hash of the query's id."""
    size = queries.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("qvec")), F.lit(0)).alias("x")).first()
    n = max(1, -(-8 * (size["x"] + 2 * k * size["n"]) // QUERY_BYTES))
    for b in range(n):
        part = queries if n == 1 else queries.filter(F.pmod(F.xxhash64("qid"), F.lit(n)) == b)
        yield [(r["qid"], r["qvec"], r["part"]) for r in part.collect()], n


def _answers(queries: DataFrame, vectors: DataFrame, k: int, metric: str) -> DataFrame:
    out = None
    for block, n in _blocks(queries, k):
        got = _scan(vectors, block, k, metric)
        got = got if n == 1 else cut(got, "answers")
        out = got if out is None else out.unionByName(got)
    return out


def _ranked(found: DataFrame, k: int, metric: str) -> DataFrame:
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    out = found.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)
    return out.withColumn("score", -F.col("score")) if metric == "euclid" else out


def topk(queries: DataFrame, vectors: DataFrame, k: int, metric: str = "cosine") -> DataFrame:
    """``(qid, id, score, rank)``: the ``k`` best rows of ``vectors(id, vec)`` for each of
    ``queries(qid, qvec)``, ties by id, under ``cosine``, ``dot`` or ``euclid`` (any other name means
    cosine). Rows of another dimension do not match."""
    ship(vectors.sparkSession)
    metric = metric if metric in ("dot", "euclid") else "cosine"
    q = queries.filter(usable("qvec")).select("qid", "qvec", F.lit(0).alias("part"))
    return _ranked(_answers(q, vectors.select(F.lit(0).alias("part"), "id", "vec"), max(k, 0), metric), k, metric)


def with_rows(found: DataFrame, vectors: DataFrame) -> DataFrame:
    """Hits with the payload and vector of their rows."""
    return found.join(vectors.select("id", "vec", "payload"), "id").select("qid", "rank", "id", "score", "vec", "payload")


def merged(results: DataFrame, k: int) -> DataFrame:
    """One list over all queries: best score of each id, ``k`` rows."""
    best = results.groupBy("id").agg(F.max("score").alias("score"))
    return best.orderBy(F.desc("score"), "id").limit(k)


class Index:
    """A cluster index that travels: centroids, the nodes of each cluster, and who is reachable."""

    def __init__(self, clusters: DataFrame, placement: DataFrame | None = None, active: DataFrame | None = None):
        rows = [(r["cluster_id"], r["centroid"]) for r in clusters.orderBy("cluster_id").collect()]
        self.cid = np.array([r[0] for r in rows], np.int64)
        self.mat = np.array([r[1] for r in rows], np.float64).reshape(len(rows), -1) if rows else np.zeros((0, 0))
        pairs = sorted({(r["node_id"], r["cluster_id"]) for r in placement.collect()}) if placement is not None else []
        self.nodes = np.array(sorted({n for n, _ in pairs}), np.int64)
        at = {c: i for i, c in enumerate(self.cid.tolist())}
        self.of = [np.array([at[c] for n, c in pairs if n == node and c in at], np.int64) for node in self.nodes.tolist()]
        self.live = np.isin(self.nodes, [r["node_id"] for r in active.collect()]) if active is not None else np.ones(len(self.nodes), bool)

    @staticmethod
    def fits(clusters: DataFrame, placement: DataFrame | None = None) -> bool:
        size = clusters.agg(F.coalesce(F.sum(8 * F.size("centroid") + 8), F.lit(0))).first()[0]
        return size + (16 * placement.count() if placement is not None else 0) <= INDEX_BYTES

    def similar(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cosines of rows to centroids, and to each node's best centroid."""
        s = scores(x, self.mat, "cosine")
        return s, np.stack([s[:, c].max(1) if len(c) else np.zeros(len(x)) for c in self.of], 1) if len(self.of) else np.zeros((len(x), 0))


def _mapped(vectors: DataFrame, index: Index, of, schema: str) -> DataFrame:
    """``of(index, ids, matrix)`` over the rows of the index's dimension."""
    ship(vectors.sparkSession)
    sent = vectors.sparkSession.sparkContext.broadcast(index)  # INDEX_BYTES at most

    def run(batches):
        for pdf in batches:
            for a in range(0, len(pdf), step):
                part = pdf.iloc[a : a + step]
                yield of(sent.value, part["id"].to_numpy(np.int64), np.array(part["vec"].tolist(), np.float64))

    step = max(64, CELLS // max(1, len(index.cid)))
    dim = index.mat.shape[1] if len(index.cid) else -1
    rows = vectors.filter(usable("vec")).filter("id is not null").filter(F.size("vec") == dim)
    return rows.select("id", "vec").mapInPandas(run, schema)


def nearest_clusters(vectors: DataFrame, clusters: DataFrame, k: int = 1, index=None) -> DataFrame:
    """``(id, cluster_id, score, rank)`` by cosine to ``clusters(cluster_id, centroid)``, ties to the least
    cluster; ``k`` is clamped to their number, and 0 gives nothing. ``index``, over the clusters as ``(id, vec)``, is
    asked in their place; without one, more clusters than may travel are indexed first."""
    schema = "id long, cluster_id long, score double, rank long"
    if k <= 0:
        return vectors.sparkSession.createDataFrame([], schema)
    if index is None and not Index.fits(clusters):
        from nearlight.operators import ann

        index = ann.build(clusters.select(F.col("cluster_id").alias("id"), F.col("centroid").alias("vec")), kept_dir(vectors.sparkSession, "cluster-index"))
    if index is not None:
        got = index.search(vectors.select(F.col("id").alias("qid"), F.col("vec").alias("qvec")), k)
        return got.select(F.col("qid").alias("id"), F.col("id").alias("cluster_id"), "score", "rank")

    def near(index, ids, x):
        s = scores(x, index.mat, "cosine")
        best = np.argsort(-s, axis=1, kind="stable")[:, :k]
        m = best.shape[1]
        return pd.DataFrame({"id": np.repeat(ids, m), "cluster_id": index.cid[best].ravel(), "score": np.take_along_axis(s, best, 1).ravel(), "rank": np.tile(np.arange(1, m + 1), len(ids))})

    return _mapped(vectors, Index(clusters), near, schema)


def node_similarity(vectors: DataFrame, clusters: DataFrame, placement: DataFrame) -> DataFrame:
    """``(id, node_id, sim)``: the best cosine to a centroid that the node holds."""
    schema = "id long, node_id long, sim double"
    if not Index.fits(clusters, placement):
        near = nearest_clusters(vectors, clusters, 1 << 30).select("id", "cluster_id", "score")
        return near.join(placement, "cluster_id").groupBy("id", "node_id").agg(F.max("score").alias("sim"))

    def similar(index, ids, x):
        return pd.DataFrame({"id": np.repeat(ids, len(index.nodes)), "node_id": np.tile(index.nodes, len(ids)), "sim": index.similar(x)[1].ravel()})

    return _mapped(vectors, Index(clusters, placement), similar, schema)


def route(vectors: DataFrame, clusters: DataFrame, placement: DataFrame, active: DataFrame, top_k: int = 3, probes: int = 3) -> DataFrame:
    """``(id, node_id, sim, rank)``: nodes of the nearest clusters that are reachable, by similarity;
    every reachable node where none of these is. No row is shuffled while the index fits."""
    schema = "id long, node_id long, sim double, rank long"
    if not Index.fits(clusters, placement):
        return _route_joined(vectors, clusters, placement, active, top_k, probes)

    def routed(index, ids, x):
        s, sim = index.similar(x)
        near = np.argsort(-s, axis=1, kind="stable")[:, :probes]
        holds = np.zeros((len(index.nodes), len(index.cid)), bool)
        for i, c in enumerate(index.of):
            holds[i, c] = True
        hit = np.zeros(sim.shape, bool)
        for p in range(near.shape[1]):
            hit |= holds[:, near[:, p]].T
        hit &= index.live
        hit[~hit.any(1)] = index.live
        rank = np.argsort(np.where(hit, -sim, np.inf), axis=1, kind="stable")[:, :top_k]  # nodes ascend: ties to the least
        ok = np.take_along_axis(hit, rank, 1).ravel()
        m = rank.shape[1]
        out = pd.DataFrame({"id": np.repeat(ids, m), "node_id": index.nodes[rank].ravel(), "sim": np.take_along_axis(sim, rank, 1).ravel(), "rank": np.tile(np.arange(1, m + 1), len(ids))})
        return out[ok]

    return _mapped(vectors, Index(clusters, placement, active), routed, schema)


def _route_joined(vectors, clusters, placement, active, top_k, probes) -> DataFrame:
    sim = node_similarity(vectors, clusters, placement).join(active, "node_id", "left_semi")
    cand = nearest_clusters(vectors, clusters, probes).join(placement, "cluster_id").select("id", "node_id", F.lit(True).alias("hit")).distinct()
    both = sim.join(cand, ["id", "node_id"], "left")
    any_ = Window.partitionBy("id")
    both = both.withColumn("some", F.max(F.coalesce("hit", F.lit(False))).over(any_)).filter("hit or not some")
    ranked = both.withColumn("rank", F.row_number().over(any_.orderBy(F.desc("sim"), "node_id")).cast("long"))
    return ranked.filter(F.col("rank") <= top_k).select("id", "node_id", "sim", "rank")


def destinations(vectors: DataFrame, clusters: DataFrame, placement: DataFrame) -> DataFrame:
    """``(id, cluster_id, destinations)`` of the nearest cluster."""
    reps = placement.groupBy("cluster_id").agg(F.array_sort(F.collect_set("node_id")).alias("destinations"))
    near = nearest_clusters(vectors, clusters, 1).select("id", "cluster_id")
    return near.join(reps, "cluster_id", "left").select("id", "cluster_id", F.coalesce("destinations", F.array().cast("array<long>")).alias("destinations"))


def destinations_without_index(vectors: DataFrame, clusters: DataFrame, placement: DataFrame, rf: int) -> DataFrame:
    """As :func:`destinations` where there is no index: the ``rf`` most similar nodes, cluster -1."""
    top = route(vectors, clusters, placement, placement.select("node_id").distinct(), rf, 1 << 30)
    return top.groupBy("id").agg(F.array_sort(F.collect_set("node_id")).alias("destinations")).withColumn("cluster_id", F.lit(-1).cast("long"))


def search_routed(queries: DataFrame, clusters: DataFrame, placement: DataFrame, active: DataFrame, replicas: DataFrame, k: int, top_look: int = 1) -> DataFrame:
    """``(qid, node_id, id, score, rank)``: top ``k`` of all that each query's ``top_look`` best nodes
    store, an id once; ``node_id`` is the best of the nodes that hold it. One is the default."""
    q = queries.select(F.col("qid").alias("id"), F.col("qvec").alias("vec"))
    best = route(q, clusters, placement, active, top_look).select(F.col("id").alias("qid"), "node_id", F.col("rank").alias("look"))
    asked = best.join(queries, "qid").select("qid", "qvec", F.col("node_id").alias("part"))
    found = _answers(asked, replicas.select(F.col("node_id").alias("part"), "id", "vec"), k, "cosine")
    if top_look > 1:
        found = found.groupBy("qid", "id").agg(F.max("score").alias("score"))
    top = _ranked(found, k, "cosine")
    if top_look > 1:
        # Only hits ask which nodes hold them: by node alone, every query would meet all rows of its nodes.
        held = top.join(replicas.select("node_id", "id"), "id").join(best, ["qid", "node_id"])
        held = held.groupBy("qid", "id", "score", "rank").agg(F.min_by("node_id", "look").alias("node_id"))
        return held.select("qid", "node_id", "id", "score", "rank")
    return top.join(best, "qid").select("qid", "node_id", "id", "score", "rank")


def recall(exact: DataFrame, found: DataFrame) -> DataFrame:
    """Share of exact results that were found, by query."""
    hit = exact.select("qid", "id").join(found.select("qid", "id").withColumn("h", F.lit(1)), ["qid", "id"], "left")
    return hit.groupBy("qid").agg((F.sum(F.coalesce("h", F.lit(0))) / F.count("*")).alias("recall"))


def nearest_by_euclid(vectors: DataFrame, clusters: DataFrame) -> DataFrame:
    """``(id, cluster_id)`` of the nearest centroid by distance, ties to the least cluster."""
    if not Index.fits(clusters):
        q = vectors.select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
        got = topk(q, clusters.select(F.col("cluster_id").alias("id"), F.col("centroid").alias("vec")), 1, "euclid")
        return got.select(F.col("qid").alias("id"), F.col("id").alias("cluster_id"))

    def near(index, ids, x):
        return pd.DataFrame({"id": ids, "cluster_id": index.cid[scores(x, index.mat, "euclid", 1).argmax(1)]})

    return _mapped(vectors, Index(clusters), near, "id long, cluster_id long")
