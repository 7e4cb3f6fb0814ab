"""Centroids, choice of k, size-bounded splits and replica placement."""

from __future__ import annotations

import heapq
import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearlight.operators.ranking import ranked
from nearlight.operators.vectors import usable
from nearlight.session import cut, ship

SILHOUETTE_ROWS = 2000
SPLIT_ROWS = 5000  # of a cluster that its centres are fitted on
TILE = 1024  # rows that are compared at a time
CELLS = 1 << 18  # sums of distances that a task keeps
PASSES = 8  # over all rows, to settle the models of all k together
STARTS = 3  # of each model on the sample


def centroids(vectors: DataFrame) -> DataFrame:
    """``(cluster_id, centroid)``: element-wise means over usable vectors, summed in each task to one row
    for each cluster before anything is shuffled."""
    ship(vectors.sparkSession)

    def add(batches):
        sums: dict = {}
        for pdf in batches:
            for (c, d), g in pdf.groupby(["cluster_id", "dim"]):
                s, n = sums.get((c, d), (0.0, 0))
                sums[(c, d)] = (s + np.array(g["vec"].tolist(), np.float64).sum(0), n + len(g))
        yield pd.DataFrame([(c, s.tolist(), n) for (c, _), (s, n) in sums.items()], columns=["cluster_id", "s", "n"])

    rows = vectors.filter(usable("vec")).filter("cluster_id is not null").select("cluster_id", F.size("vec").alias("dim"), F.col("vec").cast("array<double>").alias("vec"))
    each = rows.mapInPandas(add, "cluster_id long, s array<double>, n long").select("cluster_id", "n", F.posexplode("s").alias("pos", "x"))
    mean = each.groupBy("cluster_id", "pos").agg((F.sum("x") / F.sum("n")).alias("m"))
    return mean.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("centroid"))


def learn(buffer: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """K-means with chosen k over the usable vectors of the commonest length: ``(id, cluster_id)``
    of these and the centroids; None where there are none."""
    good = buffer.filter(usable("vec")).select("id", F.col("vec").cast("array<double>").alias("vec"))
    size = good.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if size is None:
        return None
    good = good.filter(F.size("vec") == size["d"])
    labels = cut(choose_k(good)[0], "boot-labels")
    return labels, cut(centroids(good.join(labels, "id")), "boot-centroids")


def silhouette(x: np.ndarray, lab: np.ndarray) -> float:
    """Mean Euclidean silhouette."""
    ks, inv, cnt = np.unique(lab, return_inverse=True, return_counts=True)
    member = np.eye(len(ks))[inv]
    sums = np.vstack([distances(x[a : a + TILE], x) @ member for a in range(0, len(x), TILE)])
    return float(silhouettes(sums, cnt, inv).mean())


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T, 0))


def silhouettes(sums: np.ndarray, cnt: np.ndarray, inv: np.ndarray) -> np.ndarray:
    """Of each row, from its sums of distances to the ``cnt`` rows of every cluster; ``inv`` is its own."""
    if len(cnt) < 2:
        return np.full(len(inv), -1.0)
    own = sums[np.arange(len(inv)), inv] / np.maximum(cnt[inv] - 1, 1)
    other = sums / cnt
    other[np.arange(len(inv)), inv] = np.inf
    b = other.min(1)
    return np.where(cnt[inv] > 1, (b - own) / np.maximum(np.maximum(own, b), 1e-300), 0)


def _seeds(x: np.ndarray, most: int, seed: int) -> np.ndarray:
    """``most`` rows of a sample, each drawn by its squared distance to those before."""
    rng = np.random.default_rng(seed)
    chosen = [int(rng.integers(len(x)))]
    far = ((x - x[chosen[0]]) ** 2).sum(1)
    while len(chosen) < most and far.max() > 0:
        chosen.append(int(rng.choice(len(x), p=far / far.sum())))
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(1))
    return x[chosen]


def _settled(x: np.ndarray, centres: np.ndarray, rounds: int = 150) -> np.ndarray:
    """Lloyd's rounds on a sample."""
    for _ in range(rounds):
        lab = distances(x, centres).argmin(1)
        n = np.bincount(lab, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, lab, x)
        new = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        if np.allclose(new, centres, atol=1e-9):
            break
        centres = new
    return centres


def _best_start(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """The tightest of a few settled starts."""
    starts = [_settled(x, _seeds(x, k, seed + i)) for i in range(STARTS)]
    return min(starts, key=lambda c: (distances(x, c).min(1) ** 2).sum())


def _pass(rows: DataFrame, models: dict[int, np.ndarray]) -> tuple[dict[int, np.ndarray], float]:
    """One round of Lloyd over all rows for all models: their new centres, and the farthest that one has moved.
    A task sums its rows to one row for each centre before anything is shuffled."""
    sent = rows.sparkSession.sparkContext.broadcast(models)  # max_k ** 2 / 2 centres

    def add(batches):
        sums = {k: np.zeros((len(c), c.shape[1] + 1)) for k, c in sent.value.items()}
        for pdf in batches:
            x = np.array(pdf["vec"].tolist(), float)
            for k, c in sent.value.items():
                np.add.at(sums[k], distances(x, c).argmin(1), np.hstack([x, np.ones((len(x), 1))]))
        yield pd.DataFrame([(k, i, v.tolist()) for k, s in sums.items() for i, v in enumerate(s)], columns=["k", "i", "s"])

    each = rows.mapInPandas(add, "k int, i int, s array<double>").select("k", "i", F.posexplode("s").alias("pos", "x"))
    total = each.groupBy("k", "i", "pos").agg(F.sum("x").alias("x")).toPandas()
    out, moved = {}, 0.0
    for k, g in total.groupby("k"):
        s = g.pivot(index="i", columns="pos", values="x").to_numpy()
        out[int(k)] = np.where(s[:, -1:] > 0, s[:, :-1] / np.maximum(s[:, -1:], 1), models[int(k)])
        moved = max(moved, float(np.abs(out[int(k)] - models[int(k)]).max()))
    return out, moved


def choose_k(vectors: DataFrame, min_k: int = 5, max_k: int = 30, seed: int = 42) -> tuple[DataFrame, int]:
    """K-means with the ``k`` of best silhouette (least of equals), over a sample of at most
    ``SILHOUETTE_ROWS`` rows; too few rows give one cluster. Returns ``(id, cluster_id)`` and k.

    The models for all ``k`` are started on that sample, a task for each, and then settled together: every one
    of at most ``PASSES`` passes over all rows moves the centres of all of them."""
    spark = vectors.sparkSession
    ship(spark)
    n = vectors.count()
    ks = range(max(2, min_k), min(max_k, n - 1) + 1)
    if not len(ks):
        return vectors.select("id", F.lit(0).cast("long").alias("cluster_id")), 1
    rows = cut(vectors.select("id", F.col("vec").cast("array<double>").alias("vec")), "kmeans-rows")
    sample = rows.orderBy(F.xxhash64("id")).limit(SILHOUETTE_ROWS).select("vec").toPandas()
    x = np.array(sample["vec"].tolist())
    given = spark.sparkContext.broadcast(x)

    def start(batches):
        for pdf in batches:
            for k in pdf["id"]:
                yield pd.DataFrame({"k": [k], "centres": [_best_start(given.value, int(k), seed).tolist()]})

    tasks = spark.range(ks[0], ks[-1] + 1, 1, len(ks))
    models = {r["k"]: np.array(r["centres"]) for r in tasks.mapInPandas(start, "k long, centres array<array<double>>").collect()}
    for _ in range(PASSES):
        models, moved = _pass(rows, models)
        if moved < 1e-4:
            break
    settled = spark.sparkContext.broadcast(models)

    def judge(batches):
        for pdf in batches:
            for k in pdf["id"]:
                yield pd.DataFrame({"k": [k], "s": [silhouette(given.value, distances(given.value, settled.value[k]).argmin(1))]})

    score = {r["k"]: r["s"] for r in tasks.mapInPandas(judge, "k long, s double").collect()}
    k = max(ks, key=lambda k: (score[k], -k))
    centres = spark.sparkContext.broadcast(models[k])

    def label(batches):
        for pdf in batches:
            lab = distances(np.array(pdf["vec"].tolist(), float), centres.value).argmin(1)
            yield pd.DataFrame({"id": pdf["id"], "cluster_id": lab.astype(np.int64)})

    return rows.mapInPandas(label, "id long, cluster_id long"), k


def max_split_size(n: int, k: int) -> int:
    m = math.ceil(1.2 * n / k)
    return math.ceil(n / k) + 1 if m * k < n else m


def bounded_kmeans(x: np.ndarray, k: int, limit: int, rounds: int = 20, seed: int = 42) -> np.ndarray:
    """Labels with at most ``limit`` rows a cluster: Lloyd, then cheapest moves out of full ones."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    cent = x[rng.choice(len(x), k, replace=False)].astype(float)
    for _ in range(50):
        lab = ((x[:, None] - cent[None]) ** 2).sum(2).argmin(1)
        new = np.stack([x[lab == c].mean(0) if (lab == c).any() else cent[c] for c in range(k)])
        if np.allclose(new, cent):
            break
        cent = new
    for _ in range(rounds):
        size = np.bincount(lab, minlength=k)
        if size.max() <= limit:
            break
        d = ((x[:, None] - cent[None]) ** 2).sum(2)
        for c in np.argsort(-size, kind="stable"):
            mine = np.flatnonzero(lab == c)
            for _ in range(max(0, size[c] - limit)):
                room = size < limit
                room[c] = False
                if not room.any():
                    break
                cost = np.where(room, d[mine], np.inf) - d[mine, c][:, None]
                i, to = np.unravel_index(cost.argmin(), cost.shape)
                lab[mine[i]] = to
                size[c] -= 1
                size[to] += 1
                mine = np.delete(mine, i)
        cent = np.stack([x[lab == c].mean(0) if (lab == c).any() else cent[c] for c in range(k)])
    return lab


def split_clusters(vectors: DataFrame, k: int = 3) -> DataFrame:
    """``(id, cluster_id, label, size_limit)``: every cluster split into ``k`` bounded ones.

    Centres are fitted on about ``SPLIT_ROWS`` rows of a cluster, drawn by a hash of the id; all rows are then assigned.
    Where a label is over the limit it keeps the rows that lose most by leaving and is closed,
    and the others go on to their next label; ``k - 1`` rounds are enough, as ``k`` limits hold
    all rows. Rows without cluster or vector are left out."""
    v = vectors.select("id", "cluster_id", "vec").filter("cluster_id is not null and vec is not null")
    n = cut(v.groupBy("cluster_id").agg(F.count("*").alias("n")), "split-sizes")
    draw = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) * F.col("n") < F.lit(SPLIT_ROWS << 30)  # about SPLIT_ROWS rows, all of fewer
    ship(vectors.sparkSession)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.array(pdf.sort_values("id")["vec"].tolist(), float)
        lab = bounded_kmeans(x, k, max_split_size(len(x), k))
        centres = [x[lab == c].mean(0).tolist() for c in np.unique(lab)]
        return pd.DataFrame({"cluster_id": pdf["cluster_id"].iloc[:1], "centres": [centres]})

    centres = v.join(n, "cluster_id").filter(draw).drop("n").groupBy("cluster_id").applyInPandas(fit, "cluster_id long, centres array<array<double>>")
    limit = F.when(F.ceil(1.2 * F.col("n") / k) * k < F.col("n"), F.ceil(F.col("n") / k) + 1).otherwise(F.ceil(1.2 * F.col("n") / k))
    per = cut(centres.join(n, "cluster_id").select("cluster_id", "centres", limit.cast("long").alias("size_limit")), "split-centres")
    gap = F.transform("centres", lambda c, i: F.struct(F.aggregate(F.zip_with("vec", c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, y: s + y).alias("d"), i.alias("label")))
    left = v.join(per, "cluster_id").select("id", "cluster_id", "size_limit", F.array_sort(gap).alias("far"))
    out = None
    for _ in range(k - 1):
        best, second = F.col("far")[0], F.get("far", F.lit(1))
        cost = F.coalesce(best["d"] - second["d"], F.lit(float("-inf")))  # those that lose most come first
        r = ranked(left.select("*", best["label"].alias("label"), cost.alias("cost")), ["cluster_id", "label"], ["cost", "id"])
        r = cut(r.withColumn("full", F.col("total") > F.col("size_limit")), "split-round")
        shut = r.filter("full").groupBy("cluster_id").agg(F.collect_set("label").alias("shut"))
        stay = r.filter("full and rank <= size_limit").select("id", "cluster_id", F.col("label").cast("long").alias("label"), "size_limit")
        out = stay if out is None else out.unionByName(stay)
        if shut.isEmpty():
            break
        rest = r.filter("not full or rank > size_limit").join(shut, "cluster_id", "left")
        still = F.filter("far", lambda s: ~F.array_contains(F.coalesce("shut", F.array().cast("array<int>")), s["label"]))
        left = rest.select("id", "cluster_id", "size_limit", still.alias("far"))
    last = left.select("id", "cluster_id", F.col("far")[0]["label"].cast("long").alias("label"), "size_limit")
    return last if out is None else out.unionByName(last)


def _lightest(loads: np.ndarray, rf: int):
    """Sets of ``rf`` positions by the sum of their loads, then by position, one after the other: the next
    of any set exchanges one member for the one that follows it in the order of loads."""
    order = np.lexsort((np.arange(len(loads)), loads))
    weight = loads[order].tolist()
    at = order.tolist()

    def entry(chosen: tuple[int, ...]) -> tuple:
        return sum(weight[i] for i in chosen), tuple(sorted(at[i] for i in chosen)), chosen

    queue, seen = [entry(tuple(range(rf)))], {tuple(range(rf))}
    while queue:
        total, combo, chosen = heapq.heappop(queue)
        yield total, combo
        for k, i in enumerate(chosen):
            if i + 1 < len(at) and (k + 1 == rf or chosen[k + 1] != i + 1):
                following = (*chosen[:k], i + 1, *chosen[k + 1 :])
                if following not in seen:
                    seen.add(following)
                    heapq.heappush(queue, entry(following))


def place(sizes: dict[int, int], nodes: list[int], rf: int, beam: int = 50) -> dict[int, tuple[int, ...]]:
    """Replica nodes of each cluster: beam search for the least sum of squared loads, the fullest cluster first.

    A set of nodes adds what its loads add up to, so each of the beam's states yields its sets best first, and a
    queue over the states takes as many as the beam holds; no other set is looked at. Ties go to the earlier
    state, then to the least nodes."""
    nodes, rf = sorted(nodes), min(rf, len(nodes))
    if not rf:
        return {}
    states: list[tuple[int, np.ndarray, tuple]] = [(0, np.zeros(len(nodes), np.int64), ())]  # score, loads, sets so far
    order = sorted(sizes, key=lambda c: (-sizes[c], c))
    for c in order:
        ways = [_lightest(loads if sizes[c] else 0 * loads, rf) for _, loads, _ in states]  # an empty cluster adds nothing anywhere
        queue: list[tuple] = []

        def offer(i: int) -> None:
            found = next(ways[i], None)
            if found is not None:
                score = states[i][0] + 2 * sizes[c] * found[0] + rf * sizes[c] ** 2
                heapq.heappush(queue, (score, i, found[1]))

        for i in range(len(states)):
            offer(i)
        following = []
        while queue and len(following) < beam:
            score, i, combo = heapq.heappop(queue)
            loads = states[i][1].copy()
            loads[list(combo)] += sizes[c]
            following.append((score, loads, (states[i][2], combo)))
            offer(i)
        states = following
    made, chain = {}, states[0][2]
    for c in reversed(order):
        chain, combo = chain
        made[c] = tuple(nodes[i] for i in combo)
    return {c: made[c] for c in order}


def silhouette_score(vectors: DataFrame) -> DataFrame:
    """``(score, n)``: mean Euclidean silhouette of the given clusters, every row against all rows.

    Rows lie in tiles of at most ``TILE`` by cluster. A pair of tiles gives each row of either its sums
    of distances to the other's rows by cluster; a tile's sums are then added up."""
    spark = vectors.sparkSession
    ship(spark)

    def lay(batches):
        from pyspark import TaskContext

        base, n, held = TaskContext.get().partitionId() << 32, 0, None
        for pdf in itertools.chain(batches, [None]):
            if pdf is not None:
                held = pdf if held is None else pd.concat([held, pdf])
            while held is not None and len(held) >= (TILE if pdf is not None else 1):
                t, held = held[:TILE], held[TILE:]
                x = np.array(t["vec"].tolist(), float)
                yield pd.DataFrame({"tile": [base + n], "labels": [t["cluster_id"].to_numpy(np.int64).tobytes()], "vecs": [x.tobytes()]})
                n += 1

    def measure(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                la, lb = np.frombuffer(r.labels, np.int64), np.frombuffer(r.labels2, np.int64)
                d = distances(np.frombuffer(r.vecs).reshape(len(la), -1), np.frombuffer(r.vecs2).reshape(len(lb), -1))
                if r.tile == r.tile2:
                    np.fill_diagonal(d, 0)
                for tile, to, m in [(r.tile, lb, d), (r.tile2, la, d.T)][: 1 + (r.tile != r.tile2)]:
                    ks, at, cnt = np.unique(to, return_index=True, return_counts=True)  # a tile is in the order of its clusters
                    sums = [x.tobytes() for x in np.add.reduceat(m, at, axis=1).T]
                    yield pd.DataFrame({"tile": tile, "cluster_id": ks, "n": cnt, "sums": sums, "labels": [r.labels if r.tile == r.tile2 else None] * len(ks)})

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        ks, which = np.unique(pdf["cluster_id"], return_inverse=True)
        lab = np.frombuffer(pdf["labels"].dropna().iloc[0], np.int64)
        sums, cnt = np.zeros((len(ks), len(lab))), np.zeros(len(ks), np.int64)
        for k, n, x in zip(which, pdf["n"], pdf["sums"]):
            sums[k] += np.frombuffer(x)
            cnt[k] += n
        return pd.DataFrame({"s": [silhouettes(sums.T, cnt, np.searchsorted(ks, lab)).sum()], "n": [len(lab)]})

    v = vectors.filter("vec is not null and cluster_id is not null").select("cluster_id", "id", F.col("vec").cast("array<double>").alias("vec"))
    order = v.repartitionByRange("cluster_id", "id").sortWithinPartitions("cluster_id", "id").select("cluster_id", "vec")
    laid = order.mapInPandas(lay, "tile long, labels binary, vecs binary")
    laid = cut(laid.repartition(spark.sparkContext.defaultParallelism), "silhouette-tiles")
    other = laid.select(F.col("tile").alias("tile2"), F.col("labels").alias("labels2"), F.col("vecs").alias("vecs2"))
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, 1)  # a pair of tiles is large
    try:
        sums = cut(laid.join(other, F.col("tile") <= F.col("tile2")).mapInPandas(measure, "tile long, cluster_id long, n long, sums binary, labels binary"), "silhouette-sums")
    finally:
        spark.conf.set(size, before)
    per = sums.groupBy("tile").applyInPandas(score, "s double, n long")
    return per.agg((F.sum("s") / F.sum("n")).alias("score"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def silhouette_estimate(vectors: DataFrame, rows: int = SILHOUETTE_ROWS, chance: float = 0.01) -> DataFrame:
    """``(score, bound, n, sampled)``: the mean silhouette of the given clusters from ``rows`` of the rows, drawn by a hash
    of the id, each measured against all rows in one pass; but for ``chance``, the mean over all ``n`` rows lies within
    ``bound`` (Serfling's inequality for draws without replacement; values lie between -1 and 1).

    A task keeps the sampled rows' sums of distances by cluster, so their number goes down with the number of clusters."""
    spark = vectors.sparkSession
    ship(spark)
    v = vectors.filter("vec is not null and cluster_id is not null").select("id", "cluster_id", F.col("vec").cast("array<double>").alias("vec"))
    sizes = {r["cluster_id"]: r["n"] for r in v.groupBy("cluster_id").agg(F.count("*").alias("n")).limit(CELLS).collect()}
    n, schema = sum(sizes.values()), "score double, bound double, n long, sampled long"
    if not n:
        return spark.createDataFrame([(None, None, 0, 0)], schema)
    ks = np.array(sorted(sizes))
    m = max(1, min(rows, n, CELLS // len(ks)))
    drawn = v.orderBy(F.xxhash64("id"), "id").limit(m).toPandas()
    sent = spark.sparkContext.broadcast((np.array(drawn["vec"].tolist(), float), ks))

    def add(batches):
        x, ks = sent.value
        sums = np.zeros((len(x), len(ks)))
        for pdf in batches:
            for a in range(0, len(pdf), TILE):
                part = pdf.iloc[a : a + TILE].sort_values("cluster_id")
                lab, first = np.unique(part["cluster_id"].to_numpy(), return_index=True)
                d = distances(x, np.array(part["vec"].tolist(), float))
                sums[:, np.searchsorted(ks, lab)] += np.add.reduceat(d, first, axis=1)
        at = np.nonzero(sums)
        yield pd.DataFrame({"i": at[0], "c": at[1], "s": sums[at]})

    total = v.select("cluster_id", "vec").mapInPandas(add, "i int, c int, s double").groupBy("i", "c").agg(F.sum("s").alias("s")).toPandas()
    sums = np.zeros((m, len(ks)))
    sums[total["i"], total["c"]] = total["s"]
    s = silhouettes(sums, np.array([sizes[k] for k in ks.tolist()]), np.searchsorted(ks, drawn["cluster_id"].to_numpy()))
    bound = 2 * math.sqrt(math.log(2 / chance) * (1 - (m - 1) / n) / (2 * m))
    return spark.createDataFrame([(float(s.mean()), bound, n, m)], schema)


def sizes_with_empty(vectors: DataFrame, k: int) -> DataFrame:
    """``(cluster_id, n)`` for the clusters 0 to ``k - 1``, those without rows included."""
    n = vectors.groupBy("cluster_id").agg(F.count("*").alias("n"))
    return vectors.sparkSession.range(k).withColumnRenamed("id", "cluster_id").join(n, "cluster_id", "left").select("cluster_id", F.coalesce("n", F.lit(0)).alias("n"))
