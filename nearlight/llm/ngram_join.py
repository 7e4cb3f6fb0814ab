"""N-gram Jaccard self-join: exact links and components over word shingles.

Set relations are used at two levels. Index level: shingles are put in one global order, rare
first (counts from a sketch of fixed size over all documents), and only the prefix of a set
that any linked set must meet is indexed, each shingle with its position. Index lists are kept in
order of set size and of position and cut into blocks where sizes can no longer link or positions
lie too far apart (before a common shingle two sets differ at least by the difference of its
positions), so whole blocks are skipped; sets that are equal are one class, and lists with equal
members are one list. Answer level: in each block the
first set is the leader and is compared with all members, once for each pair of sets; members
of a block that the leader's answers have joined need no comparison with each other. Blocks that
still span components get their most central member as a further leader. Before sets
travel, counts of their hashes by range, a hundredth of their size, rule out pairs that must
differ too much. What is left, members of one block in different components, is grouped into
families; a family is compared tile by tile, and each set's overlaps are derived from those of
the set before it by the shingles in which the two differ.

No link between components is lost: every pair of linked sets meets in a block, and each pair
of a block is either in one component or compared. Sets travel only for classes that meet
another one, a hot leader's members are dealt to many tasks, and nothing but a sketch of fixed
size and a bitmap of bounded size reaches the driver.

Defined cases: null texts and texts without words have size 0 and link with nothing; with
fewer words than ``N`` the whole sequence is the one shingle; repeated rows and equal texts
link; rows with a null key take part but never name a component (one of such rows only has a null
name); an empty table gives an empty result; other columns are not read. Equality of shingles is
equality of 64-bit hashes.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearlight.llm.common import NO_KEY, blob, chunks, components, cut, hold, key_column, lean, let_go, mix, null_key, scratch, small_batches, spanning

N = 5
SKETCH = 1 << 20  # counters
BITMAP = (16, 28)  # least and most bits of the prefilter's names; it has 16 for each wanted set
LONG = 1 << 22  # bytes of a text that are hashed together
CHUNK = 1 << 19  # bytes of text that are hashed together
HUB_ROUNDS = 1  # further leaders before what is left is compared by families
TILE_SHINGLES = 500_000  # of the sets that a task holds on either side
ENTRIES = 500_000  # of the index that a task packs at a time
BLOCK = 512  # members of a leader that one task compares

_K = np.uint64(0x9E3779B97F4A7C15)


_BLANK = re.compile(rb"[\x09-\x0D\x20]")


class Shingler:
    """Sets of hashed word shingles of whole texts; words are runs of non-blank bytes."""

    BASE = np.uint64(0xC2B2AE3D27D4EB4F)

    def __init__(self, n: int = N):
        self.n = n
        rng = np.random.default_rng(11)
        self.table = rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.table[65:91] = self.table[97:123]
        self.blank = np.zeros(256, bool)
        self.blank[[9, 10, 11, 12, 13, 32]] = True
        self.power = self.inverse = np.ones(0, np.uint64)

    def _powers(self, n: int) -> None:
        if n > len(self.power):
            inv = np.uint64(pow(int(self.BASE), -1, 1 << 64))
            self.power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, self.BASE)]))
            self.inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, inv)]))

    def words(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Word hashes of all texts in a row, and each text's number of words."""
        if len(raw) == 1 and len(raw[0]) > LONG:
            cuts = [0]
            while len(raw[0]) - cuts[-1] > LONG and (m := _BLANK.search(raw[0], cuts[-1] + LONG)):
                cuts.append(m.end())
            got = [self.words([raw[0][a:b], b""])[0] for a, b in zip(cuts, [*cuts[1:], len(raw[0])])]
            return np.concatenate(got), np.array([sum(map(len, got))])
        size = np.array([len(r) + 1 for r in raw], np.int64)
        buf = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
        self._powers(len(buf) + 1)
        blank = self.blank[buf]
        turn = np.flatnonzero(np.diff(blank, prepend=True))
        s, e = turn[0::2], turn[1::2]
        prefix = np.concatenate([[np.uint64(0)], np.cumsum(self.table[buf] * self.power[: len(buf)])])
        h = mix((prefix[e] - prefix[s]) * self.inverse[s])
        return h, np.diff(np.searchsorted(s, np.cumsum(size)), prepend=0)

    def sets(self, raw: list[bytes]) -> list[np.ndarray]:
        """Each text's distinct shingles, ascending."""
        h, count = self.words(raw)
        sh = h.copy()
        m = max(0, len(h) - self.n + 1)
        roll = h[:m]
        for k in range(1, self.n):
            roll = roll * _K + h[k : m + k]
        sh = mix(roll + np.uint64(self.n))
        out, at = [], 0
        for c in count.tolist():
            if c >= self.n:
                x = np.sort(sh[at : at + c - self.n + 1])
                out.append(x[np.flatnonzero(np.diff(x, prepend=x[0] ^ np.uint64(1)))])
            elif c:
                x = h[at : at + 1]
                for k in range(1, c):
                    x = x * _K + h[at + k : at + k + 1]
                out.append(mix(x + np.uint64(c)))
            else:
                out.append(np.zeros(0, np.uint64))
            at += c
        return out


def signature(x: np.ndarray) -> int:
    """A signed 64-bit name for a set."""
    v = np.add.reduce(mix(x * np.uint64(0xD6E8FEB86659FD93) + _K), keepdims=True)
    return int(mix(v + np.array([len(x)], np.uint64) * _K).view(np.int64)[0])


_shinglers: dict = {}


def shingler(n: int) -> Shingler:
    if n not in _shinglers:
        _shinglers[n] = Shingler(n)
    return _shinglers[n]


def _sets(batches, n: int):
    """Keys and sets of all rows, chunk by chunk."""
    maker = shingler(n)
    for pdf in batches:
        raw = [t.encode() if isinstance(t, str) else b"" for t in pdf["t"]]
        keys = pdf["k"].to_numpy()
        for i, j in chunks(raw, CHUNK):
            yield keys[i:j], maker.sets(raw[i:j])


def spread(x: np.ndarray) -> bytes:
    """How many shingles of a set fall into each of about ``len(x) / 8`` equal ranges of hashes."""
    if not len(x):
        return b""
    bits = max(3, (len(x) // 8).bit_length())
    return blob(np.bincount((x >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits).astype(np.uint16))


def apart(a: bytes, b: bytes) -> int:
    """A lower bound of the symmetric difference of two sets from their spreads."""
    x, y = np.frombuffer(a, np.uint16).astype(np.int32), np.frombuffer(b, np.uint16).astype(np.int32)
    if len(x) > len(y):
        x, y = y, x
    y = y.reshape(len(x), -1).sum(axis=1)
    return int(np.abs(x - y).sum())


def possible(pairs: DataFrame, facts: DataFrame, percent: int) -> DataFrame:
    """The ``pairs(a, c)`` that their spreads do not rule out: linked sets differ in at most
    ``(100 - percent) / (100 + percent)`` of both sizes."""
    small_batches(pairs.sparkSession)
    x = facts.select(F.col("sig").alias("a"), F.col("n").alias("na"), F.col("counts").alias("sa"))
    y = facts.select(F.col("sig").alias("c"), F.col("n").alias("nc"), F.col("counts").alias("sc"))

    def run(batches):
        for pdf in batches:
            keep = [(100 + percent) * apart(p, q) <= (100 - percent) * (m + n) for p, q, m, n in zip(pdf["sa"], pdf["sc"], pdf["na"], pdf["nc"])]
            yield pdf.loc[np.array(keep, bool), ["a", "c"]]

    return pairs.join(x, "a").join(y, "c").mapInPandas(run, "a long, c long")


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def survey(rows: DataFrame, n: int) -> DataFrame:
    """``(k, n, sig, part, counts)``: a row for each document with its spread (part -1), and parts
    of the task's sketch."""

    def run(batches):
        total = np.zeros(SKETCH, np.int64)
        for keys, sets in _sets(batches, n):
            all_ = np.concatenate(sets)
            total += np.bincount((all_ & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH)
            yield pd.DataFrame({"k": keys, "n": [len(x) for x in sets], "sig": [signature(x) for x in sets], "part": -1, "counts": [spread(x) for x in sets]})
        parts = np.minimum(total, 65535).astype(np.uint16).reshape(64, -1)
        yield pd.DataFrame({"k": 0, "n": 0, "sig": 0, "part": range(64), "counts": [blob(p) for p in parts]})

    return rows.mapInPandas(lean(run), "k long, n long, sig long, part int, counts binary")


def merged_sketch(found: DataFrame) -> np.ndarray:
    """The sum of all sketches: ``SKETCH`` counters, whatever the input."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(SKETCH // 64, np.int64)
        for c in pdf["counts"]:
            total += np.frombuffer(c, np.uint16)
        return pd.DataFrame({"part": pdf["part"].iloc[:1], "counts": [blob(np.minimum(total, 2**31 - 1).astype(np.int32))]})

    parts = {r["part"]: r["counts"] for r in found.filter("part >= 0").groupBy("part").applyInPandas(add, "part int, counts binary").collect()}
    return np.concatenate([np.frombuffer(parts[p], np.int32) if p in parts else np.zeros(SKETCH // 64, np.int32) for p in range(64)])


def frequency_classes(counts: np.ndarray) -> np.ndarray:
    """0 for what may be rare, else the binary order of the count."""
    floor = 2 * counts.mean() + 16
    return np.where(counts > floor, np.ceil(np.log2(np.maximum(counts, 1))), 0).astype(np.uint8)


def index_entries(rows: DataFrame, n: int, percent: int, classes: np.ndarray, n_buckets: int) -> DataFrame:
    """``(b, body)``: packed prefix entries (shingle, size, position, class) by bucket of the shingle."""
    held = rows.sparkSession.sparkContext.broadcast(classes)  # SKETCH bytes

    def run(batches):
        order = held.value
        seen: set[int] = set()
        hs, sigs, sizes, many = [], [], [], 0

        def flush():
            h, sig = np.concatenate(hs), np.repeat(np.array(sigs, np.int64), [len(x) for x in hs])
            size = np.repeat(np.array(sizes, np.int32), [len(x) for x in hs])
            place = np.concatenate([np.arange(len(x), dtype=np.int32) for x in hs])
            b = ((h >> np.uint64(32)) % np.uint64(n_buckets)).astype(np.int64)
            by = np.argsort(b, kind="stable")
            cuts = np.searchsorted(b[by], np.arange(n_buckets + 1))
            low = h.astype(np.uint32)
            out = []
            for k in range(n_buckets):
                t = by[cuts[k] : cuts[k + 1]]
                if len(t):
                    out.append((k, blob(low[t]) + blob(size[t]) + blob(place[t]) + blob(sig[t])))
            return pd.DataFrame(out, columns=["b", "body"])

        for _, sets in _sets(batches, n):
            for x in sets:
                if not len(x):
                    continue
                sig = signature(x)
                if sig in seen:
                    continue
                seen.add(sig)
                c = order[(x & np.uint64(SKETCH - 1)).astype(np.int64)]
                p = prefix_length(len(x), percent)
                # x ascends, so a stable sort by class orders by (class, hash).
                hs.append(x[np.argsort(c, kind="stable")[:p]] if c.any() else x[:p])
                sigs.append(sig)
                sizes.append(len(x))
                many += p
            if many > ENTRIES:
                yield flush()
                hs, sigs, sizes, many = [], [], [], 0
        if hs:
            yield flush()

    return rows.mapInPandas(lean(run), "b int, body binary")


def blocks(entries: DataFrame, percent: int) -> DataFrame:
    """Lists of equal shingles, cut where sizes can no longer link or positions are too far apart.

    Rows ``(a, c, block)``: leader ``a`` and member ``c``; ``block`` names a block of three or more
    (those of two are settled by their leader), null for the leader's pair itself."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        parts: list = [[], [], [], []]
        for body in pdf["body"]:
            m = len(body) // 20
            for x, kind, at in zip(parts, (np.uint32, np.int32, np.int32, np.int64), (0, 4, 8, 12)):
                x.append(np.frombuffer(body, kind, m, at * m))
        h, size, place, sig = [np.concatenate(x) for x in parts]
        order = np.lexsort((sig, size, h))
        first = np.ones(len(h), bool)
        first[1:] = (h[order[1:]] != h[order[:-1]]) | (sig[order[1:]] != sig[order[:-1]])  # one class from many tasks
        t = order[np.flatnonzero(first)]
        h, size, place, sig = h[t], size[t], place[t], sig[t]
        fresh = np.ones(len(h), bool)
        # Sizes ascend: where the next is out of reach of this one, nothing later reaches back.
        fresh[1:] = (h[1:] != h[:-1]) | (100 * size[:-1].astype(np.int64) < percent * size[1:].astype(np.int64))
        run = np.cumsum(fresh) - 1
        most = size[np.append(np.flatnonzero(fresh)[1:], len(h)) - 1].astype(np.int64)
        by = np.lexsort((place, run))
        # So with positions, which may differ by what two of the run's largest sets may.
        fresh[1:] |= (100 + percent) * np.diff(place[by].astype(np.int64)) > 2 * (100 - percent) * most[run[1:]]
        run = np.empty(len(h), np.int64)
        run[by] = np.cumsum(fresh)
        t = np.lexsort((sig, size, run))
        size, sig = size[t], sig[t]
        start = np.flatnonzero(fresh)
        length = np.diff(start, append=len(h))
        some = np.flatnonzero(length > 1)
        start, length = start[some], length[some]
        if not len(start):
            return pd.DataFrame({"a": [], "c": [], "block": [], "n": []})
        name = np.add.reduceat(mix(sig.view(np.uint64) + _K), start_ends(start, length, len(sig)))[::2].view(np.int64)
        _, only = np.unique(name, return_index=True)  # lists with equal members are one list
        start, length, name = start[only], length[only], name[only]
        at = np.repeat(start - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
        lead = sig[np.repeat(start, length)]
        member, nm = sig[at], size[at]
        three = np.repeat(length > 2, length)
        star = np.flatnonzero(lead != member)
        pairs = np.unique(np.stack([lead[star], member[star]]), axis=1)
        w = np.flatnonzero(three)
        return pd.concat(
            [
                pd.DataFrame({"a": pairs[0], "c": pairs[1], "block": None, "n": 0}),
                pd.DataFrame({"a": 0, "c": member[w], "block": np.repeat(name, length)[w], "n": nm[w]}),
            ]
        ).astype({"block": "Int64"})

    return entries.groupBy("b").applyInPandas(one, "a long, c long, block long, n long")


def start_ends(start: np.ndarray, length: np.ndarray, total: int) -> np.ndarray:
    """Interleaved bounds for ``reduceat``; the last end may not be the array's own."""
    out = np.empty(2 * len(start), np.int64)
    out[0::2] = start
    out[1::2] = start + length
    return out[:-1] if out[-1] >= total else out


def needed_sets(rows: DataFrame, n: int, wanted: DataFrame) -> DataFrame:
    """``(sig, body)`` for all classes of ``wanted(sig)``, found again by a bitmap of 32 MB at most."""
    width = min(max(BITMAP[0], (16 * wanted.count()).bit_length()), BITMAP[1])
    words, shift = (1 << width) // 64, 64 - width

    def bits(batches):
        got = np.zeros(1 << width, bool)
        for pdf in batches:
            got[(pdf["sig"].to_numpy(np.int64).view(np.uint64) >> np.uint64(shift)).astype(np.int64)] = True
        packed = np.packbits(got).reshape(64, -1)
        some = [p for p in range(64) if packed[p].any()]
        yield pd.DataFrame({"part": some, "bits": [blob(packed[p]) for p in some]})

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(words // 8, np.uint8)
        for b in pdf["bits"]:
            out |= np.frombuffer(b, np.uint8)
        return pd.DataFrame({"part": pdf["part"].iloc[:1], "bits": [blob(out)]})

    whole = np.zeros((64, words // 8), np.uint8)
    for r in wanted.mapInPandas(bits, "part int, bits binary").groupBy("part").applyInPandas(join, "part int, bits binary").collect():
        whole[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    held = rows.sparkSession.sparkContext.broadcast(whole.reshape(-1))

    def run(batches):
        maybe = held.value
        seen: set[int] = set()
        for _, sets in _sets(batches, n):
            out = []
            for x in sets:
                if not len(x):
                    continue
                sig = signature(x)
                k = (sig & (1 << 64) - 1) >> shift
                if maybe[k >> 3] >> (7 - (k & 7)) & 1 and sig not in seen:
                    seen.add(sig)
                    out.append((sig, blob(x)))
            if out:
                yield pd.DataFrame(out, columns=["sig", "body"])

    return rows.mapInPandas(lean(run), "sig long, body binary").join(wanted, "sig", "left_semi").groupBy("sig").agg(F.first("body").alias("body"))


def sets_of(rows: DataFrame, n: int, pairs: DataFrame) -> DataFrame:
    small_batches(rows.sparkSession)
    wanted = cut(pairs.select(F.col("a").alias("sig")).union(pairs.select("c")).distinct(), "ngram-wanted")
    return cut(needed_sets(rows, n, wanted), "ngram-sets")


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two ascending arrays."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a))


def compare(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``(a, c, inter, na, nc)`` for each of the distinct ``pairs(a, c)``."""
    spark = pairs.sparkSession
    load = pairs.groupBy("a").agg(F.count("*").alias("m"))
    dealt = pairs.join(load, "a").withColumn("salt", F.expr(f"pmod(xxhash64(c), cast(ceil(m / {BLOCK}) as bigint))")).select("a", "salt", "c")
    members = dealt.join(sets, F.col("c") == F.col("sig")).select("a", "salt", F.lit(1).alias("role"), "c", "body")
    leaders = dealt.select("a", "salt").distinct().join(sets, F.col("a") == F.col("sig")).select("a", "salt", F.lit(0).alias("role"), F.col("a").alias("c"), "body")
    small_batches(spark, 500)

    def run(batches):
        lead, who = None, None
        for pdf in batches:
            out = []
            for a, role, c, body in zip(pdf["a"].tolist(), pdf["role"].tolist(), pdf["c"].tolist(), pdf["body"].tolist()):
                x = np.frombuffer(body, np.uint64)
                if role == 0:
                    lead, who = x, a
                else:
                    assert who == a, "a member without its leader"
                    out.append((a, c, overlap(lead, x), len(lead), len(x)))
            yield pd.DataFrame(out, columns=["a", "c", "inter", "na", "nc"])

    both = members.unionByName(leaders).repartition("a", "salt").sortWithinPartitions("a", "salt", "role")
    return both.mapInPandas(lean(run), "a long, c long, inter long, na long, nc long")


def linked(percent: int) -> str:
    return f"100 * inter >= {percent} * (na + nc - inter)"


def mixed(members: DataFrame, comps: DataFrame) -> DataFrame:
    """``(block, c, n, comp, m)``: members of blocks that span components, ``m`` to a block."""
    named = members.join(comps.withColumnRenamed("node", "c"), "c", "left").select("block", "c", "n", F.coalesce("comp", "c").alias("comp"))
    spans = named.groupBy("block").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("m")).filter("lo <> hi").select("block", "m")
    return named.join(spans, "block")


def groups(batches, *keys):
    """Consecutive rows of equal keys as frames' slices; rows come sorted by the keys."""
    held = None
    for pdf in batches:
        pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        if not len(pdf):
            held = None
            continue
        turn = np.zeros(len(pdf), bool)
        for k in keys:
            v = pdf[k].to_numpy()
            turn[1:] |= v[1:] != v[:-1]
        cuts = np.flatnonzero(turn).tolist()
        for a, b in zip([0, *cuts[:-1]], cuts):
            yield pdf.iloc[a:b]
        held = pdf.iloc[cuts[-1] if cuts else 0 :]
    if held is not None and len(held):
        yield held


def fold(x: np.ndarray, size: int) -> np.ndarray:
    return x.reshape(*x.shape[:-1], size, -1).sum(axis=-1)


def surviving(sx: list, nx: np.ndarray, cx: np.ndarray, sy: list, ny: np.ndarray, cy: np.ndarray, percent: int):
    """Index pairs of members of different components that sizes and spreads leave possible."""
    ys = [np.frombuffer(b, np.uint16).astype(np.int32) for b in sy]
    size = np.array([len(y) for y in ys])
    parts = {int(w): (np.flatnonzero(size == w), np.stack([y for y in ys if len(y) == w])) for w in set(size.tolist())}
    cache: dict = {}
    for i, b in enumerate(sx):
        x = np.frombuffer(b, np.uint16).astype(np.int32)
        for w, (at, mat) in parts.items():
            ok = (cy[at] != cx[i]) & (100 * np.minimum(ny[at], nx[i]) >= percent * np.maximum(ny[at], nx[i]))
            t = np.flatnonzero(ok)
            if not len(t):
                continue
            short = min(len(x), w)
            if (w, short) not in cache:
                cache[(w, short)] = fold(mat, short)
            far = np.abs(cache[(w, short)][t] - fold(x, short)).sum(axis=1)
            t = t[np.flatnonzero((100 + percent) * far <= (100 - percent) * (ny[at[t]] + nx[i]))]
            if len(t):
                yield i, at[t]


def hub_pairs(rest: DataFrame, kinds: DataFrame, percent: int) -> DataFrame:
    """One more leader for each block: ``(a, c)`` of its most central member and the others.

    Each class takes part in its largest block only; a large block has a hub for each part."""
    own = rest.groupBy("c").agg(F.max_by(F.struct("block", "m", "n", "comp"), F.struct("m", "block")).alias("r")).select("c", "r.*")
    own = own.join(kinds.select(F.col("sig").alias("c"), "counts"), "c")
    own = own.withColumn("salt", F.expr(f"pmod(xxhash64(c), cast(ceil(m / {8 * BLOCK}) as bigint))"))

    def run(batches):
        for g in groups(batches, "block", "salt"):
            spreads = [np.frombuffer(b, np.uint16).astype(np.int32) for b in g["counts"]]
            short = min(len(x) for x in spreads)
            x = np.stack([fold(v, short) for v in spreads]).astype(np.float64)
            c, comp, n = g["c"].to_numpy(), g["comp"].to_numpy(), g["n"].to_numpy(np.int64)
            far = np.abs(x - x.mean(axis=0)).sum(axis=1)
            hub = int(np.lexsort((c, far))[0])
            s = list(g["counts"])
            for _, at in surviving([s[hub]], n[hub : hub + 1], comp[hub : hub + 1], s, n, comp, percent):
                yield pd.DataFrame({"a": c[hub], "c": c[at]})

    return own.repartition("block", "salt").sortWithinPartitions("block", "salt").mapInPandas(run, "a long, c long")


def open_families(rest: DataFrame, kinds: DataFrame, percent: int) -> DataFrame:
    """``(u, v)``: a spanning forest of the pairs of one block in different components that sizes
    and spreads leave possible. Blocks are looked at by pairs of tiles of members; a task emits
    an edge for each member at most, never the pairs."""
    tile = 2 * BLOCK
    r = rest.join(kinds.select(F.col("sig").alias("c"), "counts"), "c")
    r = r.withColumn("tiles", F.expr(f"cast(ceil(m / {tile}) as int)")).withColumn("tile", F.expr("cast(pmod(xxhash64(c), tiles) as int)"))
    r = r.select("block", "c", "n", "comp", "counts", "tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    r = r.select("block", F.least("tile", "other").alias("t1"), F.greatest("tile", "other").alias("t2"), "tile", "c", "n", "comp", "counts")

    def run(batches):
        for g in groups(batches, "block", "t1", "t2"):
            in1, in2 = tile_rows(g)
            if not len(in1) or not len(in2):
                continue
            c, comp, n, s = g["c"].to_numpy(), g["comp"].to_numpy(), g["n"].to_numpy(np.int64), list(g["counts"])
            got = list(surviving([s[k] for k in in1], n[in1], comp[in1], [s[k] for k in in2], n[in2], comp[in2], percent))
            if got:
                i = np.concatenate([np.full(len(at), in1[i]) for i, at in got])
                lab = spanning(i, in2[np.concatenate([at for _, at in got])], len(c))
                some = np.flatnonzero(lab != np.arange(len(c)))
                yield pd.DataFrame({"u": c[lab[some]], "v": c[some]})

    return r.repartition("block", "t1", "t2").sortWithinPartitions("block", "t1", "t2").mapInPandas(run, "u long, v long")


def tile_rows(g: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    t = g["tile"].to_numpy()
    return np.flatnonzero(t == g["t1"].iloc[0]), np.flatnonzero(t == g["t2"].iloc[0])


def tile_overlaps(xs: list[np.ndarray], ys: list[np.ndarray]):
    """For each set of ``xs`` its overlaps with all of ``ys``: from the lists of ``ys`` once, and from
    the answers of the set before it where the two differ in less than they hold."""
    owner = np.repeat(np.arange(len(ys)), [len(y) for y in ys])
    vals = np.concatenate(ys)
    order = np.argsort(vals, kind="stable")
    vals, owner = vals[order], owner[order]

    def count(x: np.ndarray) -> np.ndarray:
        a, b = np.searchsorted(vals, x, "left"), np.searchsorted(vals, x, "right")
        size = b - a
        at = np.repeat(a - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        return np.bincount(owner[at], minlength=len(ys))

    last, answer = None, None
    for x in xs:
        if last is not None:
            more, less = np.setdiff1d(x, last, True), np.setdiff1d(last, x, True)
            answer = answer + count(more) - count(less) if len(more) + len(less) < len(x) else count(x)
        else:
            answer = count(x)
        last = x
        yield answer


def family_links(families: DataFrame, facts: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``(u, v)``: a spanning forest of the links within each family, all of its pairs compared.

    ``families(node, comp)``, ``facts(c, n, at)`` with the components so far as ``at``."""
    f = families.select(F.col("node").alias("c"), F.col("comp").alias("f")).join(facts, "c")
    load = f.groupBy("f").agg(F.expr(f"cast(greatest(ceil(count(*) / {2 * BLOCK}), ceil(sum(n) / {TILE_SHINGLES})) as int)").alias("tiles"))
    r = f.join(load, "f").withColumn("tile", F.expr("cast(pmod(xxhash64(c), tiles) as int)")).join(sets.withColumnRenamed("sig", "c"), "c")
    r = r.select("f", "c", "at", "body", "tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    r = r.select("f", F.least("tile", "other").alias("t1"), F.greatest("tile", "other").alias("t2"), "tile", "at", "c", "body")
    small_batches(families.sparkSession)

    def run(batches):
        for g in groups(batches, "f", "t1", "t2"):
            in1, in2 = tile_rows(g)
            at, c = g["at"].to_numpy(), g["c"].to_numpy()
            if not len(in1) or not len(in2) or (at == at[0]).all():
                continue
            body = [np.frombuffer(b, np.uint64) for b in g["body"]]
            size = np.array([len(b) for b in body])
            left, right = [], []
            for i, inter in zip(in1, tile_overlaps([body[k] for k in in1], [body[k] for k in in2])):
                hit = in2[np.flatnonzero(100 * inter >= percent * (size[i] + size[in2] - inter))]
                hit = hit[at[hit] != at[i]]
                left.append(np.full(len(hit), i))
                right.append(hit)
            lab = spanning(np.concatenate(left), np.concatenate(right), len(c))
            some = np.flatnonzero(lab != np.arange(len(c)))
            if len(some):
                yield pd.DataFrame({"u": c[lab[some]], "v": c[some]})

    return r.repartition("f", "t1", "t2").sortWithinPartitions("f", "t1", "t2", "at").mapInPandas(lean(run), "u long, v long")


def grown(comps: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """Components after more links."""
    small_batches(links.sparkSession, 10_000)
    if links.isEmpty():
        return comps
    return components(comps.select(F.col("node").alias("u"), F.col("comp").alias("v")).union(links), name)


def _join(docs: DataFrame, n: int, percent: int, key: str, text: str) -> DataFrame:
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(key_column(key).alias("k"), F.col(f"`{text}`").cast("string").alias("t"))
    found = hold(survey(rows, n))
    facts = found.filter("part < 0").select("k", "n", "sig")
    kinds = found.filter("part < 0 and n > 0").groupBy("sig").agg(F.first("n").alias("n"), F.first("counts").alias("counts"))
    classes = frequency_classes(merged_sketch(found))
    n_buckets = max(64, 4 * rows.rdd.getNumPartitions())
    small_batches(spark)
    met = cut(blocks(index_entries(rows, n, percent, classes, n_buckets), percent), "ngram-blocks")
    let_go(spark)
    pairs = cut(possible(met.filter("block is null").select("a", "c").distinct(), kinds, percent), "ngram-pairs")
    members = met.filter("block is not null").select("block", "c", "n").distinct()
    known = cut(compare(pairs, sets_of(rows, n, pairs), percent), "ngram-known")
    small_batches(spark, 10_000)
    links = known.filter(linked(percent)).select(F.col("a").alias("u"), F.col("c").alias("v"))
    comps = components(links, "ngram")
    members = cut(members, "ngram-members")
    for turn in range(HUB_ROUNDS):
        rest = cut(mixed(members, comps), "ngram-mixed")
        if rest.isEmpty():
            break
        small_batches(spark)
        pairs = cut(hub_pairs(rest, kinds, percent).join(known.select("a", "c"), ["a", "c"], "left_anti"), "ngram-hubs")
        if pairs.isEmpty():
            break
        got = cut(compare(pairs, sets_of(rows, n, pairs), percent), "ngram-known")
        known = known.unionByName(got)
        comps = grown(comps, got.filter(linked(percent)).select(F.col("a").alias("u"), F.col("c").alias("v")), f"ngram-hub{turn}")
    rest = cut(mixed(members, comps), "ngram-mixed")
    if not rest.isEmpty():
        small_batches(spark)
        families = components(cut(open_families(rest, kinds, percent), "ngram-open"), "ngram-families")
        small_batches(spark)
        sets = sets_of(rows, n, families.select(F.col("node").alias("a"), F.col("node").alias("c")))
        now = rest.select("c", "n", F.col("comp").alias("at")).distinct()
        comps = grown(comps, cut(family_links(families, now, sets, percent), "ngram-late"), "ngram-last")
    named = facts.filter("n > 0").join(comps.withColumnRenamed("node", "sig"), "sig", "left").select("k", "n", F.coalesce("comp", "sig").alias("comp"))
    least = cut(named.groupBy("comp").agg(F.min(F.nullif("k", F.lit(NO_KEY))).alias("component_id")), "ngram-least")  # apart, so that the join may split a hot component
    out = named.join(least, "comp").select("k", "n", "component_id")
    out = out.unionByName(facts.filter("n = 0").select("k", "n", F.nullif("k", F.lit(NO_KEY)).alias("component_id")))
    return null_key(out.select("k", F.col("n").alias("n_shingles"), "component_id"), key)


def join(docs: DataFrame, n: int = N, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n_shingles, component_id)`` for every row: sets link at Jaccard ``percent`` / 100."""
    with scratch(docs.sparkSession):
        return cut(_join(docs, n, percent, key, text), "ngram-result", keep=True)


def query(spark, sf_dir: str) -> DataFrame:
    """op7: every document's set size and component."""
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
