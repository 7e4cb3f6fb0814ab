"""Near-duplicate embeddings by int8 tile products with rigorous error bounds.

Equal vectors of a label collapse to one numbered class with a count. The classes are laid out in
tiles of one label, near vectors together by random-hyperplane signs; pairs of tiles whose centroids
and radii rule out a link are left out. Tiles travel as int8 with a scale and the exact length of what
quantisation loses: with ``u = q / s + d``, ``|u.v - (q_u.q_v) / (s_u s_v)| <= |d_u| |v| + |q_u / s_u|
|d_v|``, so that a product less that bound at the threshold is a link, and one plus that bound below
it is none. Only tile pairs with products between the two are sent once more with their doubles, and
only those products are recomputed. A task returns, for each vector, the count of its links and one
edge to its local component, never the pairs themselves.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components, and
vectors without label, link with nothing and are kept as their own component; vectors of
different lengths do not link; repeated rows are links of each other; a row with a null key links and
counts like others but names no component (null where no member has a key); an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearlight.llm.common import NO_KEY, blob, components, cut, key_column, null_key, scratch, small_batches, spanning

THRESHOLD = 0.98
TILE = 2048
STRIP = 256
PLANES = 12
SLACK = 1e-9  # of double arithmetic on unit vectors

TILES = "tile long, label long, dim int, ids binary, mult binary, vecs binary, quant binary, scale binary, lost binary, mid binary, far double"


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def quantise(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Integer components in [-127, 127], their scale, and the exact length of what is lost."""
    s = 127 / np.abs(u).max(axis=1)
    q = np.rint(u * s[:, None])
    return q, s, np.sqrt(((u - q / s[:, None]) ** 2).sum(axis=1))


def products(qa, sa, ea, qb, sb, eb, threshold: float):
    """Index pairs by strips of ``a``: those that are links for sure, and those left open."""
    kind = np.float32 if qa.shape[1] * 127 * 127 < 1 << 24 else np.float64  # integer sums stay exact
    right = qb.T.astype(kind)
    for k in range(0, len(qa), STRIP):
        t = slice(k, k + STRIP)
        near = (qa[t].astype(kind) @ right).astype(np.float64) / (sa[t, None] * sb)
        bound = ea[t, None] + (1 + ea[t, None]) * eb + SLACK
        i, j = np.nonzero(near + bound >= threshold)
        sure = near[i, j] - bound[i, j] >= threshold
        yield i[sure] + k, j[sure], i[~sure] + k, j[~sure]


def recomputed(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the open pairs are links, in double precision."""
    out = np.zeros(len(i), bool)
    for m in range(0, len(i), 1 << 16):
        t = slice(m, m + (1 << 16))
        out[t] = np.einsum("nd,nd->n", a[i[t]], b[j[t]]) >= threshold
    return out


def usable(column: str = "embedding") -> str:
    c = f"`{column}`"
    return (
        f"{c} is not null and size({c}) > 0 and not exists({c}, x -> x is null or isnan(x) or abs(x) = double('infinity'))"
        f" and exists({c}, x -> x <> 0)"
    )


def tiles(reps: DataFrame) -> DataFrame:
    """Tiles of ``reps(label, dim, e, id, mult)`` in the order of their hyperplane signs."""
    spark = reps.sparkSession
    small_batches(spark, 10_000)

    def signs(batches):
        for pdf in batches:
            sig = np.zeros(len(pdf), np.int64)
            for dim, rows in pdf.reset_index(drop=True).groupby("dim").groups.items():
                planes = np.random.default_rng(dim).standard_normal((dim, PLANES))
                x = unit(np.array(pdf["e"].to_numpy()[rows].tolist(), np.float64))
                sig[rows] = ((x @ planes > 0) << np.arange(PLANES)).sum(axis=1)
            yield pdf.assign(sig=sig)

    def lay(batches):
        from pyspark import TaskContext

        base, n = TaskContext.get().partitionId() << 32, 0

        def rows(label, dim, held):
            nonlocal n
            x = np.concatenate([h[2] for h in held])
            ids, mult = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            for k in range(0, len(x), TILE):
                t = slice(k, k + TILE)
                u = unit(x[t].astype(np.float64))
                q, s, e = quantise(u)
                mid = u.mean(axis=0)
                mid = mid / max(np.linalg.norm(mid), 1e-300)
                far = float(np.arccos(np.clip((u @ mid).min(), -1, 1)))
                yield {"tile": base + n, "label": label, "dim": dim, "ids": blob(ids[t]), "mult": blob(mult[t]), "vecs": blob(u), "quant": blob(q.astype(np.int8)), "scale": blob(s), "lost": blob(e), "mid": blob(mid), "far": far}
                n += 1

        held, at, size = [], None, 0
        for pdf in batches:
            for (label, dim), g in pdf.groupby(["label", "dim"], sort=False):
                if held and (at != (label, dim) or size >= TILE):
                    yield pd.DataFrame(list(rows(*at, held)))
                    held, size = [], 0
                at = (label, dim)
                held.append((g["id"].to_numpy(np.int64), g["mult"].to_numpy(np.int64), np.array(g["e"].tolist(), np.float64)))
                size += len(g)
        if held:
            yield pd.DataFrame(list(rows(*at, held)))

    signed = cut(reps.mapInPandas(signs, "label long, dim int, e array<double>, id long, mult long, sig long"), "embedding-signs")
    order = signed.repartitionByRange("label", "dim", "sig", "id").sortWithinPartitions("label", "dim", "sig", "id")
    return cut(order.mapInPandas(lay, TILES), "embedding-tiles")


def tile_links(laid: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(u, v, n)``: for each vector of each pair of tiles ``n`` links and an edge ``u - v``."""
    small_batches(laid.sparkSession, 1)
    meta = laid.select("tile", "label", "dim", "mid", "far")
    other = meta.select(F.col("tile").alias("tile2"), "label", "dim", F.col("mid").alias("mid2"), F.col("far").alias("far2"))
    reach = float(np.arccos(threshold)) + 1e-7

    @F.pandas_udf("boolean")
    def near(a: pd.Series, b: pd.Series, ra: pd.Series, rb: pd.Series) -> pd.Series:
        cos = [float(np.frombuffer(x) @ np.frombuffer(y)) for x, y in zip(a, b)]
        return pd.Series(np.arccos(np.clip(cos, -1, 1)) <= ra + rb + reach)

    pairs = meta.join(other, ["label", "dim"]).filter("tile <= tile2").filter(near("mid", "mid2", "far", "far2")).select("tile", "tile2")
    light = ["ids", "mult", "quant", "scale", "lost"]

    def with_tiles(pairs: DataFrame, columns: list[str]) -> DataFrame:
        a = laid.select("tile", "dim", *columns)
        b = laid.select(F.col("tile").alias("tile2"), *[F.col(c).alias(f"{c}2") for c in columns])
        return pairs.join(a, "tile").join(b, "tile2")

    def multiply(doubles: bool):
        def run(batches):
            for pdf in batches:
                for r in pdf.itertuples(index=False):
                    one = r.tile == r.tile2
                    ia, ma = np.frombuffer(r.ids, np.int64), np.frombuffer(r.mult, np.int64)
                    ib, mb = (ia, ma) if one else (np.frombuffer(r.ids2, np.int64), np.frombuffer(r.mult2, np.int64))
                    left = np.frombuffer(r.quant, np.int8).reshape(len(ia), -1), np.frombuffer(r.scale), np.frombuffer(r.lost)
                    right = np.frombuffer(r.quant2, np.int8).reshape(len(ib), -1), np.frombuffer(r.scale2), np.frombuffer(r.lost2)
                    if doubles:
                        xa, xb = np.frombuffer(r.vecs).reshape(len(ia), -1), np.frombuffer(r.vecs2).reshape(len(ib), -1)
                    got, n_open = [], 0
                    for i, j, oi, oj in products(*left, *right, threshold):
                        if doubles:
                            hit = recomputed(xa, xb, oi, oj, threshold)
                            i, j = oi[hit], oj[hit]
                        n_open += int((oi != oj).sum()) if one else len(oi)
                        got.append((i, j))
                    i, j = np.concatenate([x for x, _ in got]), np.concatenate([x for _, x in got])
                    if one:
                        i, j = i[i != j], j[i != j]
                        n, ids, cnt = len(ia), ia, np.bincount(i, ma[j], len(ia))
                    else:
                        n, ids = len(ia) + len(ib), np.concatenate([ia, ib])
                        cnt = np.bincount(i, mb[j], n) + np.bincount(j + len(ia), ma[i], n)
                        j = j + len(ia)
                    some = np.flatnonzero(cnt)
                    yield pd.DataFrame({"u": ids[some], "v": ids[spanning(i, j, n)][some], "n": cnt[some].astype(np.int64), "tile": -1, "tile2": -1})
                    if n_open and not doubles:
                        yield pd.DataFrame({"u": [-1], "v": [-1], "n": [0], "tile": [r.tile], "tile2": [r.tile2]})

        return run

    schema = "u long, v long, n long, tile long, tile2 long"
    first = cut(with_tiles(pairs, light).mapInPandas(multiply(False), schema), "embedding-products")
    again = first.filter("tile >= 0").select("tile", "tile2")
    second = with_tiles(again, [*light, "vecs"]).mapInPandas(multiply(True), schema)
    return first.filter("tile < 0").unionByName(second).select("u", "v", "n")


def dedup(vectors: DataFrame, threshold: float = THRESHOLD, key: str = "vec_id", vec: str = "embedding", label: str = "label") -> DataFrame:
    """``(key, n_links, component_id, kept)`` for every row."""
    with scratch(vectors.sparkSession):
        return cut(_dedup(vectors, threshold, key, vec, label), "embedding-result", keep=True)


def _dedup(vectors: DataFrame, threshold: float, key: str, vec: str, label: str) -> DataFrame:
    rows = vectors.select(
        key_column(key).alias("k"), F.col(f"`{label}`").cast("long").alias("label"), F.col(f"`{vec}`").cast("array<double>").alias("e"),
        F.expr(f"coalesce({usable(vec)}, false) and `{label}` is not null").alias("ok"),
    )
    good = rows.filter("ok").select("label", "e", "k")
    # Classes are numbered: keys may be null or repeated.
    named = F.nullif("k", F.lit(NO_KEY))
    reps = good.groupBy("label", "e").agg(F.min(named).alias("least"), F.count("*").alias("mult"))
    reps = cut(reps.withColumn("rep", F.monotonically_increasing_id()), "embedding-reps")
    found = cut(tile_links(tiles(reps.select("label", F.size("e").alias("dim"), "e", F.col("rep").alias("id"), "mult")), threshold), "embedding-links")
    small_batches(vectors.sparkSession, 10_000)
    comps = components(found.select("u", "v"), "embedding")
    counts = found.groupBy("u").agg(F.sum("n").alias("n")).withColumnRenamed("u", "rep")
    facts = reps.join(counts, "rep", "left").join(comps.withColumnRenamed("node", "rep"), "rep", "left").select(
        "label", "e", "least", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("comp", "rep").alias("comp")
    )
    names = facts.groupBy("comp").agg(F.min("least").alias("component_id"))
    linked = good.join(facts.join(names, "comp"), ["label", "e"]).select("k", "n_links", "component_id")
    alone = rows.filter("not ok").select("k", F.lit(0).cast("long").alias("n_links"), named.alias("component_id"))
    return null_key(linked.unionByName(alone).withColumn("kept", named.eqNullSafe(F.col("component_id"))).select("k", "n_links", "component_id", "kept"), key)


def query(spark, sf_dir: str) -> DataFrame:
    """op5: every embedding's links, component and verdict."""
    return dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = r"""
with recursive v as (
  select vec_id, label, embedding::double[] as e from embeddings
), l as (
  select a.vec_id as u, b.vec_id as w from v a join v b on a.label = b.label and a.vec_id <> b.vec_id
  where list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.98
), r as (
  select vec_id as u, vec_id as w from v
  union
  select r.u, l.w from r join l on r.w = l.u
), c as (
  select u, min(w) as component_id from r group by u
), n as (
  select u, count(*) as n from l group by u
)
select v.vec_id, coalesce(n.n, 0)::bigint as n_links, c.component_id, v.vec_id = c.component_id as kept
from v join c on c.u = v.vec_id left join n on n.u = v.vec_id
"""
