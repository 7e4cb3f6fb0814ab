"""A persisted approximate index: inverted lists with product-quantised codes, and exact scores at the end.

Every row belongs to the list of its nearest coarse centre. A row's difference to its centre is cut into
subspaces, each coded by one byte, so a search reads a few bytes a row of a few lists: files are in the
order of the lists, and Parquet's statistics skip the others. The rows that the codes rank first are scored again
by their vectors. Centres and code words are fitted on a sample of ``FIT_BYTES``; all rows are indexed.

How many lists a search probes and how many rows it scores again is measured when the index is built:
``TRIALS`` of the rows are searched exactly, and the least numbers that find the wanted share of their
true neighbours are kept with it. Where codes cannot, lists are scored by their vectors.

Few queries travel to the rows in blocks of bounded size. Many meet them list by list: both sides
are packed into tiles and joined by list, so that a hot list is split like any skewed join.

Cosine is searched as the inner product of unit vectors, distance as the inner product less half the
squared length; a null or unusable vector, or one of another length than most, is not indexed and matches nothing.
"""

from __future__ import annotations

import itertools
import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nearlight import functions as fn
from nearlight.operators import search
from nearlight.operators.vectors import usable
from nearlight.session import cut, scratch, ship

FIT_BYTES = 32 << 20
CODES = 256
SUB = 4  # components of a subspace
ROUNDS = 15
TRIALS = 256
DEPTHS = (2, 4, 8, 16, 32, 64)  # rows that are scored again, times k
LUT_BYTES = 64 << 20  # tables of products of one block of queries
BLOCKS = 4  # more blocks of queries than these are joined
TILE = 512

_ROWS = "list long, id long, bias float, code binary, vec array<double>"


def _unit(x: np.ndarray, metric: str) -> np.ndarray:
    if metric != "cosine":
        return x
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Of each row, the nearest centre."""
    out, half = np.empty(len(x), np.int64), (centres * centres).sum(1) / 2
    step = max(1, search.CELLS // len(centres))
    for a in range(0, len(x), step):
        out[a : a + step] = (x[a : a + step] @ centres.T - half).argmax(1)
    return out


def lloyd(x: np.ndarray, k: int, seed: int = 42) -> np.ndarray:
    """Centres of a sample."""
    distinct = np.unique(x, axis=0)
    if len(distinct) <= k:
        return distinct
    centres = distinct[np.random.default_rng(seed).choice(len(distinct), k, replace=False)]
    for _ in range(ROUNDS):
        lab = _nearest(x, centres)
        n = np.bincount(lab, minlength=k)
        sums = np.stack([np.bincount(lab, x[:, j], k) for j in range(x.shape[1])], 1)
        new = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        if np.allclose(new, centres):
            break
        centres = new
    return centres


def _cuts(dim: int) -> list[int]:
    return [*range(0, dim, SUB), dim]


def _encode(r: np.ndarray, books: list[np.ndarray]) -> np.ndarray:
    """Codes of differences to centres."""
    at = _cuts(r.shape[1])
    return np.stack([_nearest(r[:, a:b], w) for a, b, w in zip(at, at[1:], books)], 1).astype(np.uint8)


class VectorIndex:
    """An index below ``path``, as :func:`build` leaves it and :func:`load` finds it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        about = json.loads(spark.read.schema("about string").parquet(f"{self.path}/about").first()[0])
        self.metric, self.dim, self.k, self.probes, self.depth = (about[c] for c in ("metric", "dim", "k", "probes", "depth"))
        self.measured, self.n = about["recall"], about["n"]
        lists = sorted(spark.read.schema("list long, centre array<double>, n long").parquet(f"{self.path}/lists").collect())
        self.centres = np.array([r["centre"] for r in lists], float).reshape(len(lists), self.dim)
        self.sizes = np.array([r["n"] for r in lists], np.int64)
        books = sorted(spark.read.schema("j int, words array<array<double>>").parquet(f"{self.path}/books").collect())
        self.books = [np.array(r["words"], float) for r in books]

    def rows(self) -> DataFrame:
        return self.spark.read.schema(_ROWS).parquet(f"{self.path}/rows")

    def probed(self, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """``(qid, qvec, lists)``: the lists that each of ``queries(qid, qvec)`` asks, nearest first, and as many more
        as ``k`` rows take."""
        most, metric = probes or self.probes, self.metric
        sent = self.spark.sparkContext.broadcast((self.centres, self.sizes))  # bounded by search.INDEX_BYTES

        def run(batches):
            centres, sizes = sent.value
            half = (centres * centres).sum(1) / 2 if metric == "euclid" else 0
            step = max(64, search.CELLS // max(1, len(sizes)))
            for pdf in batches:
                for a in range(0, len(pdf), step):
                    part = pdf.iloc[a : a + step]
                    order = np.argsort(half - _unit(np.array(part["qvec"].tolist(), float), metric) @ centres.T, axis=1, kind="stable")
                    enough = (np.cumsum(sizes[order], axis=1) < k).sum(1) + 1
                    n = np.minimum(np.maximum(enough, most), len(sizes))
                    yield part.assign(lists=[o[:m].tolist() for o, m in zip(order, n)])

        good = queries.filter(usable("qvec")).filter((F.size("qvec") == self.dim) & F.col("qid").isNotNull())
        return good.select("qid", F.col("qvec").cast("array<double>").alias("qvec")).mapInPandas(run, "qid long, qvec array<double>, lists array<long>")

    def search(self, queries: DataFrame, k: int, probes: int | None = None, depth: int | None = None, exact: bool = False) -> DataFrame:
        """``(qid, id, score, rank)`` like :func:`nearlight.operators.search.topk`. ``probes`` and ``depth``
        default to what the index measured; ``depth`` 0 scores all rows of the probed lists; ``exact`` all rows."""
        ship(self.spark)
        k = min(k, self.n)
        if k <= 0:
            return self.spark.createDataFrame([], "qid long, id long, score double, rank long")
        if exact:
            return search.topk(queries, self.rows(), k, self.metric)
        n_queries = queries.count()
        depth = self.depth if depth is None else depth
        blocks = -(-n_queries * len(self.books) * CODES * 4 // LUT_BYTES)
        asked = self.probed(queries, k, probes)
        if blocks > BLOCKS:
            return search._ranked(self._joined(asked.select("qid", "qvec", F.explode("lists").alias("list")), k), k, self.metric)
        if not depth:
            return search._ranked(self._blocked(asked, k, blocks, exact=True).select("qid", "id", F.col("approx").alias("score")), k, self.metric)
        return search._ranked(self._scored(self.candidates(asked, depth * k, blocks), queries, n_queries * depth * k), k, self.metric)

    def candidates(self, asked: DataFrame, want: int, blocks: int = 1) -> DataFrame:
        """``(qid, list, id, approx, rank)``: the ``want`` rows of the asked lists that the codes rank first."""
        found = self._blocked(asked, want, blocks)
        w = Window.partitionBy("qid").orderBy(F.desc("approx"), "id", "list")
        return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= want)

    def _blocked(self, asked: DataFrame, want: int, blocks: int, exact: bool = False) -> DataFrame:
        found = None
        for b in range(max(1, blocks)):
            part = asked if blocks <= 1 else asked.filter(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b)
            got = self._best(part.toPandas(), want, exact)  # LUT_BYTES bound the queries of a block
            got = got if blocks <= 1 else cut(got, "ann-best")
            found = got if found is None else found.unionByName(got)
        return found

    def _best(self, asked: pd.DataFrame, want: int, exact: bool) -> DataFrame:
        """The best ``want`` rows of the asked lists in each task, by codes or by vectors."""
        qid = asked["qid"].to_numpy(np.int64)
        q = np.array(asked["qvec"].tolist(), float).reshape(len(asked), self.dim)
        q = q if exact else _unit(q, self.metric)
        askers: dict[int, list[int]] = {}
        for p, lists in enumerate(asked["lists"]):
            for c in lists:
                askers.setdefault(int(c), []).append(p)
        sent = self.spark.sparkContext.broadcast((qid, q, askers, self.centres, self.books))  # LUT_BYTES and search.INDEX_BYTES at most
        metric = self.metric

        def by_codes(q, centres, books):
            at, m = _cuts(q.shape[1]), len(books)
            lut = np.zeros((len(q), m, CODES), np.float32)
            for j, w in enumerate(books):
                lut[:, j, : len(w)] = q[:, at[j] : at[j + 1]] @ w.T
            lut = lut.reshape(len(q), -1)
            offset = np.arange(m, dtype=np.int32) * CODES

            def scored(c, who, g):
                codes = np.frombuffer(b"".join(g["code"]), np.uint8).reshape(len(g), m) + offset
                less = g["bias"].to_numpy(np.float64) if metric == "euclid" else 0
                for p, base in zip(who, q[who] @ centres[c]):
                    yield p, base + lut[p][codes].sum(1, dtype=np.float64) - less

            return scored

        def by_vectors(q, centres, books):
            def scored(c, who, g):
                x = np.array(g["vec"].tolist(), float)
                step = max(1, search.CELLS // len(x))
                for a in range(0, len(who), step):
                    yield from zip(who[a : a + step], search.scores(q[who[a : a + step]], x, metric))

            return scored

        def run(batches):
            qid, q, askers, centres, books = sent.value
            scored = (by_vectors if exact else by_codes)(q, centres, books)
            held: dict[int, list] = {}

            def best(parts):
                s, i, c = (np.concatenate(x) for x in zip(*parts))
                keep = np.lexsort((c, i, -s))[:want]
                return [(s[keep], i[keep], c[keep])]

            for pdf in batches:
                for c, g in pdf.groupby("list", sort=False):
                    who = askers.get(c)
                    if who is None:
                        continue
                    ids = g["id"].to_numpy(np.int64)
                    for p, s in scored(c, who, g):
                        if len(s) > want:
                            top = np.flatnonzero(s >= np.partition(s, len(s) - want)[len(s) - want])  # ties stay
                            s, i = s[top], ids[top]
                        else:
                            i = ids
                        parts = held.setdefault(p, [])
                        parts.append((s, i, np.full(len(s), c, np.int64)))
                        if len(parts) > 16:
                            held[p] = best(parts)
            for p, parts in held.items():
                s, i, c = best(parts)[0]
                yield pd.DataFrame({"qid": qid[p], "list": c, "id": i, "approx": s})

        rows = self.rows().select("list", "id", *(["vec"] if exact else ["bias", "code"]))
        if len(askers) <= 1000:
            rows = rows.filter(F.col("list").isin(list(askers)))
        return rows.mapInPandas(run, "qid long, list long, id long, approx double")

    def _scored(self, found: DataFrame, queries: DataFrame, most: int) -> DataFrame:
        found = found.select(F.col("qid").alias("_q"), F.col("list").alias("_l"), F.col("id").alias("_i")).distinct()
        found = found.join(queries.select(F.col("qid").alias("_q"), F.col("qvec").cast("array<double>").alias("qvec")), "_q")
        if most * (8 * self.dim + 32) <= search.INDEX_BYTES:
            found = F.broadcast(found)
        rows = self.rows().select("list", "id", "vec").join(found, (F.col("list") == F.col("_l")) & (F.col("id") == F.col("_i")))
        score = {"cosine": fn.cosine, "dot": fn.dot}.get(self.metric, lambda a, b: -fn.euclid(a, b))
        return rows.select(F.col("_q").alias("qid"), "id", score("qvec", "vec").alias("score"))

    def _joined(self, asked: DataFrame, k: int) -> DataFrame:
        """The best ``k`` rows of each query in each tile of its lists."""
        metric, dim = self.metric, self.dim

        def pack(key: str, vec: str):
            def run(batches):
                held = None
                for pdf in itertools.chain(batches, [None]):
                    if pdf is not None:
                        held = pdf if held is None else pd.concat([held, pdf])
                    while held is not None and len(held) and (pdf is None or len(held) >= 2 * TILE):
                        c = held["list"].iloc[0]
                        n = min(TILE, int((held["list"].to_numpy() == c).argmin()) or len(held)) if held["list"].iloc[-1] != c else min(TILE, len(held))
                        t, held = held[:n], held[n:]
                        yield pd.DataFrame({"list": [c], "keys": [t[key].to_numpy(np.int64).tobytes()], "vecs": [np.array(t[vec].tolist(), float).tobytes()]})

            return run

        def measure(batches):
            for pdf in batches:
                for r in pdf.itertuples(index=False):
                    q, x = np.frombuffer(r.q_vecs).reshape(-1, dim), np.frombuffer(r.vecs).reshape(-1, dim)
                    best = search.Best(np.frombuffer(r.q_keys, np.int64), q, k, metric)
                    best.add(np.frombuffer(r.keys, np.int64), x)
                    yield best.rows()

        tiles = "list long, keys binary, vecs binary"
        rows = self.rows().select("list", "id", "vec").mapInPandas(pack("id", "vec"), tiles)
        near = asked.repartitionByRange("list", "qid").sortWithinPartitions("list", "qid").mapInPandas(pack("qid", "qvec"), tiles)
        near = near.select(F.col("list").alias("q_list"), F.col("keys").alias("q_keys"), F.col("vecs").alias("q_vecs"))
        pairs = rows.join(near, F.col("list") == F.col("q_list")).select("keys", "vecs", "q_keys", "q_vecs")
        size = "spark.sql.execution.arrow.maxRecordsPerBatch"
        before = self.spark.conf.get(size)
        self.spark.conf.set(size, 8)  # a pair of tiles is large
        try:
            return cut(pairs.mapInPandas(measure, search.HITS), "ann-hits", keep=True)
        finally:
            self.spark.conf.set(size, before)

    def add(self, vectors: DataFrame) -> None:
        """Index further rows under the centres that are there."""
        _lay(_good(vectors, self.dim), self.centres, self.books, self.metric).write.mode("append").parquet(f"{self.path}/rows")
        _count(self.spark, self.path, self.centres)
        n = int(self.spark.read.parquet(f"{self.path}/lists").agg(F.sum("n")).first()[0])
        _about(self.spark, self.path, self, n=n)
        self.__init__(self.spark, self.path)


def load(spark: SparkSession, path: str) -> VectorIndex:
    return VectorIndex(spark, path)


def _good(vectors: DataFrame, dim: int) -> DataFrame:
    return vectors.filter(usable("vec")).filter((F.size("vec") == dim) & F.col("id").isNotNull()).select("id", F.col("vec").cast("array<double>").alias("vec"))


def _about(spark: SparkSession, path: str, index, **changed) -> None:
    about = {c: getattr(index, c) for c in ("metric", "dim", "k", "probes", "depth", "n")} | {"recall": index.measured} | changed
    _put(spark, f"{path}/about", [(json.dumps(about),)], "about string")


def _put(spark: SparkSession, path: str, rows: list, schema: str) -> None:
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(path)


def _lay(rows: DataFrame, centres: np.ndarray, books: list[np.ndarray], metric: str) -> DataFrame:
    """Rows with list and code, in the order of the lists."""
    sent = rows.sparkSession.sparkContext.broadcast((centres, books))  # search.INDEX_BYTES at most

    def run(batches):
        centres, books = sent.value
        for pdf in batches:
            x = _unit(np.array(pdf["vec"].tolist(), float), metric)
            c = _nearest(x, centres)
            code = _encode(x - centres[c], books)
            yield pd.DataFrame({"list": c, "id": pdf["id"], "bias": ((x * x).sum(1) / 2).astype(np.float32), "code": [r.tobytes() for r in code], "vec": pdf["vec"]})

    return rows.mapInPandas(run, _ROWS).repartitionByRange("list", "id").sortWithinPartitions("list", "id")


def _count(spark: SparkSession, path: str, centres: np.ndarray) -> None:
    n = {r["list"]: r["n"] for r in spark.read.schema(_ROWS).parquet(f"{path}/rows").groupBy("list").agg(F.count("*").alias("n")).collect()}
    _put(spark, f"{path}/lists", [(c, v.tolist(), n.get(c, 0)) for c, v in enumerate(centres)], "list long, centre array<double>, n long")


def build(vectors: DataFrame, path: str, metric: str = "cosine", n_lists: int | None = None, target: float = 0.95, k: int = 10) -> VectorIndex:
    """Index ``vectors(id, vec)`` below ``path`` for a recall of ``target`` at ``k`` on its own rows."""
    spark, path = vectors.sparkSession, path.rstrip("/")
    ship(spark)
    metric = metric if metric in ("dot", "euclid") else "cosine"
    common = vectors.filter(usable("vec")).filter("id is not null").groupBy(F.size("vec").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    dim, n = (common["d"], common["n"]) if common else (1, 0)
    rows = _good(vectors, dim)
    with scratch(spark):
        fit = FIT_BYTES // (8 * dim)
        share = min(1.0, fit / max(n, 1))
        sample = cut((rows if share == 1 else rows.filter(F.rand(42) < share)).select("vec"), "ann-sample")
        x = _unit(np.array([r["vec"] for r in sample.limit(2 * fit).collect()], float).reshape(-1, dim), metric)
        most = max(1, min(search.INDEX_BYTES // (8 * dim), len(x) // 16))
        centres = lloyd(x, min(most, n_lists or max(1, round(n**0.5)))) if len(x) else np.zeros((1, dim))
        books = _books(sample, centres, metric, dim) if len(x) else [np.zeros((1, b - a)) for a, b in zip(_cuts(dim), _cuts(dim)[1:])]
        _lay(rows, centres, books, metric).write.mode("overwrite").parquet(f"{path}/rows")
        _put(spark, f"{path}/books", [(j, w.tolist()) for j, w in enumerate(books)], "j int, words array<array<double>>")
        _count(spark, path, centres)
        _put(spark, f"{path}/about", [(json.dumps({"metric": metric, "dim": dim, "k": k, "probes": len(centres), "depth": 0, "n": n, "recall": 1.0}),)], "about string")
        index = VectorIndex(spark, path)
        if n:
            index.probes, index.depth, index.measured = _measure(index, n, k, target)
            _about(spark, path, index)
    return index


def _books(sample: DataFrame, centres: np.ndarray, metric: str, dim: int) -> list[np.ndarray]:
    """Code words of each subspace, one task a subspace; each reads the sample."""
    at = _cuts(dim)
    sent = sample.sparkSession.sparkContext.broadcast(centres)

    def parts(batches):
        for pdf in batches:
            x = _unit(np.array(pdf["vec"].tolist(), float), metric)
            r = x - sent.value[_nearest(x, sent.value)]
            for j in range(len(at) - 1):
                yield pd.DataFrame({"j": j, "part": r[:, at[j] : at[j + 1]].tolist()})

    def words(pdf):
        return pd.DataFrame({"j": pdf["j"].iloc[:1], "words": [lloyd(np.array(pdf["part"].tolist(), float), CODES).tolist()]})

    found = sample.mapInPandas(parts, "j int, part array<double>").groupBy("j").applyInPandas(words, "j int, words array<array<double>>")
    return [np.array(r["words"], float) for r in sorted(found.collect())]


def _measure(index: VectorIndex, n: int, k: int, target: float) -> tuple[int, int, float]:
    """Probes and depth for ``target``, by rows that stand in as queries, and the recall they have."""
    rows = index.rows()
    trial = cut(rows.select("id", "vec").filter(F.rand(7) < min(1.0, 2 * TRIALS / n)).limit(TRIALS).select(F.monotonically_increasing_id().alias("qid"), F.col("vec").alias("qvec")), "ann-trials")
    k = min(k, n)
    exact = cut(index.search(trial, k, exact=True), "ann-exact")
    ranks = index.probed(trial, k, len(index.centres)).select("qid", F.posexplode("lists").alias("place", "list"))
    lists = exact.join(rows.select("id", "list").distinct(), "id").join(ranks, ["qid", "list"])
    places = np.array([r["place"] + 1 for r in lists.select("place").collect()])  # TRIALS * k, but for repeated ids
    total = max(1, len(places))
    probes = 1
    while probes < len(index.centres) and (places <= probes).sum() < (1 + target) / 2 * total:
        probes += max(1, probes // 4)
    probes = min(probes, len(index.centres))
    found = index.candidates(index.probed(trial, k, probes), DEPTHS[-1] * k)
    hit = exact.select("qid", "id").join(found.groupBy("qid", "id").agg(F.min("rank").alias("rank")), ["qid", "id"])
    at = np.array([r["rank"] for r in hit.collect()])
    for depth in DEPTHS:
        if (at <= depth * k).sum() >= target * total:
            return probes, depth, float((at <= depth * k).sum() / total)
    return probes, 0, float((places <= probes).sum() / total)
