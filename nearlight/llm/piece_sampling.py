"""Sampled SentencePiece segmentations by forward filtering and backward sampling.

A text is its dummy space and itself, cut into units before every line end and every space that does
not follow a space; no piece reaches over such a cut (inside a piece a space mark only follows a space
mark, which is checked, and none holds a line end), so the lattice of a text is the chain of its units'
lattices, and sampling each unit is sampling the text. For the same reason a unit of more than ``LONG``
characters, as texts without spaces have, is cut further wherever no piece of the vocabulary that
stands there reaches over. All distinct units of a
batch are filtered together: for every end position, in ascending order, the log-sum over the
pieces that end there. Every occurrence then walks back from its end, drawing pieces by their
share of that sum. The draws come from a counter-based generator over the row's key, the unit's
place in the text and the step, so that a row's segmentation does not depend on batches,
partitions or retries.

The model's piece scores are ranks, not probabilities: a piece of rank ``r`` weighs
``(r + 8) ** -theta``. Characters without a piece of their own, and the space mark itself where a
text holds it, go by the byte pieces, so that decoding gives the text back exactly.

Defined cases: a null text counts as empty and has no pieces; a null key draws as key 0 and stays null; repeated rows
get equal segmentations; an empty table gives an empty result; other columns are not read. Only where
pieces overlap without end, as in one letter repeated for megabytes, a long unit stays whole and is
filtered byte by byte.
"""

from __future__ import annotations

import re
import zlib
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearlight.llm.common import NO_KEY, chunks, key_column, mix, null_key, ship

THETA = 1.0
SEED = 20
MARK = "▁"
LONG = 256  # characters of a unit that is cut further
STEP = 64  # bytes between such cuts, at least now and then
WINDOW = 1 << 18  # bytes whose pieces are looked at together
UNIT = re.compile("\n[^ \n]*| +[^ \n]*")
_M = np.uint64(0x9E3779B97F4A7C15)


def uniform(key: np.ndarray, place: np.ndarray, step: int) -> np.ndarray:
    """Numbers in [0, 1) by row key, place and step."""
    x = mix(key + _M) + place.astype(np.uint64) * np.uint64(0xD1342543DE82EF95) + np.array(step, np.uint64) * _M
    return (mix(x) >> np.uint64(11)).astype(np.float64) * 2.0**-53


def units(text: str) -> list[str]:
    """The units of a text, each without its first space."""
    if not text:
        return []
    if text[0] != " " and "  " not in text:
        return text.replace("\n", " \n").split(" ")
    return [u[1:] if u[0] == " " else u for u in UNIT.findall(" " + text)]


class Numbers(dict):
    """Numbers of units in order of first sight."""

    def __missing__(self, unit: str) -> int:
        n = self[unit] = len(self)
        return n


def _eight(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each byte on as one number, zeros after the end."""
    return np.ndarray(len(buf), "<u8", buf.tobytes() + bytes(8), strides=(1,))


def _mask(n: int) -> np.uint64:
    return np.uint64((1 << 8 * min(n, 8)) - 1)


class Sampler:
    """Pieces of one model. ``sample`` segments texts, ``decode`` gives bytes back."""

    def __init__(self, path: str, theta: float = THETA, seed: int = SEED):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.seed = mix(np.array([seed], np.uint64))[0]
        rng = np.random.default_rng(7)
        self.table = rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = np.uint64(0xC2B2AE3D27D4EB4F)
        self.inverse = np.uint64(pow(int(self.base), -1, 1 << 64))
        surface: list[bytes] = []
        by_len: dict[int, list[tuple[bytes, int]]] = {}
        self.byte_id = np.zeros(256, np.int64)
        logp = np.zeros(sp.get_piece_size())
        singles = set()
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                v = int(piece[3:5], 16)
                self.byte_id[v] = i
                surface.append(bytes([v]))
                continue
            if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                surface.append(b"")
                continue
            raw = piece.replace(MARK, " ").encode()
            surface.append(raw)
            if re.search(b"(?s:.)\\n|[^ ] ", raw):
                raise ValueError(f"piece {i} reaches over a cut between units")
            logp[i] = -theta * np.log(8 - sp.get_score(i))
            by_len.setdefault(len(raw), []).append((raw, i))
            if len(piece) == 1:
                singles.add(piece)
        self.logp, self.singles = logp, singles
        logp[self.byte_id] = -theta * np.log(8 + sp.get_piece_size())
        self.by_len = {}
        self.maybe = np.zeros(1 << 20, bool)  # what is not set here is no piece
        for n, rows in by_len.items():
            buf = np.frombuffer(b"".join(r for r, _ in rows), np.uint8)
            h = self._hashes(self._prefix(buf), np.arange(len(rows)) * n, n)
            order = np.argsort(h)
            self.maybe[h >> np.uint64(44)] = True
            ends = _eight(buf)
            at = (np.arange(len(rows)) * n)[order]
            self.by_len[n] = (h[order], np.array([i for _, i in rows], np.int64)[order], ends[at] & _mask(n), ends[at + max(0, n - 8)], buf.reshape(-1, n)[order])
        self.flat = np.frombuffer(b"".join(surface), np.uint8)
        self.wide = np.array([len(x) for x in surface], np.int64)
        self.at = np.cumsum(self.wide) - self.wide

    def _prefix(self, buf: np.ndarray) -> np.ndarray:
        if len(buf) + 1 > len(getattr(self, "powers", ())):
            n = 2 * len(buf) + 2
            self.powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, self.base)]))
            self.inverses = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, self.inverse)]))
        return np.concatenate([[np.uint64(0)], np.cumsum(self.table[buf] * self.powers[: len(buf)])])

    def _hashes(self, prefix: np.ndarray, start: np.ndarray, n: int) -> np.ndarray:
        return (prefix[start + n] - prefix[start]) * self.inverses[start]

    def _found(self, buf: np.ndarray, left: np.ndarray):
        """Where pieces stand: for each length, their places, the length and their ids. ``left``: bytes from each
        place to the end that no piece may cross."""
        prefix, ahead = self._prefix(buf), _eight(buf)
        room = np.arange(len(buf))
        for n, (hashes, piece, front, back, whole) in sorted(self.by_len.items()):
            room = room[np.flatnonzero(left[room] >= n)]
            h = self._hashes(prefix, room, n)
            may = np.flatnonzero(self.maybe[h >> np.uint64(44)])
            h = h[may]
            k = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            hit = np.flatnonzero(hashes[k] == h)
            # A hash finds a piece, its bytes decide.
            at, own = room[may[hit]], k[hit]
            same = ahead[at] & _mask(n) == front[own]
            if n > 8:
                same &= ahead[at + n - 8] == back[own]
            if n > 16:
                same &= (buf[at[:, None] + np.arange(8, n - 8)] == whole[own, 8 : n - 8]).all(axis=1)
            yield at[same], n, piece[own[same]]

    def split(self, unit: str) -> list:
        """A long unit in parts that no piece reaches over: the first like a unit, the others as 1-tuples."""
        raw = (unit if unit[:1] == "\n" else " " + unit).encode()
        reach, cuts = max(self.by_len), []
        for a in range(0, len(raw), WINDOW):
            lo = max(0, a - reach)
            buf = np.frombuffer(raw[lo : a + WINDOW + reach], np.uint8)
            change = np.zeros(len(buf) + 1, np.int64)
            for at, n, _ in self._found(buf, len(buf) - np.arange(len(buf))):
                change += np.bincount(at + 1, minlength=len(change)) - np.bincount(at + n, minlength=len(change))
            free = np.flatnonzero((np.cumsum(change)[:-1] == 0) & (buf & 0xC0 != 0x80)) + lo
            cuts.append(free[(free >= max(a, 1)) & (free < a + WINDOW)])
        at = np.concatenate(cuts)
        at = at[np.flatnonzero(np.diff(at // STEP, prepend=-1))].tolist()
        parts = [raw[a:b].decode() for a, b in zip([0, *at], [*at, len(raw)])]
        return [parts[0] if unit[:1] == "\n" else parts[0][1:], *[(p,) for p in parts[1:]]]

    def units(self, text: str, known: dict) -> list:
        """The units of a text; ``known``: those that were split before in this batch."""
        cut = units(text)
        if len(text) > LONG and max(map(len, cut)) > LONG:
            for u in cut:
                if len(u) > LONG and u not in known:
                    known[u] = self.split(u)
            cut = [p for u in cut for p in (known[u] if len(u) > LONG else (u,))]
        return cut

    def lattice(self, units: list[str]):
        """Filtered lattices of ``units``, one node for each byte position of each unit.

        Returns nodes' first edge, edges' piece and start node, edges' cumulative share among
        those that end in the same node, and the units' first and last nodes."""
        raw = [u.encode() for u in units]
        size = np.array([len(r) for r in raw], np.int64)
        end = np.cumsum(size)
        begin = end - size
        buf = np.frombuffer(b"".join(raw), np.uint8)
        left = np.repeat(end, size) - np.arange(len(buf))  # bytes to the unit's end
        node0 = begin + np.arange(len(units))  # a unit of n bytes has n + 1 nodes
        node = np.arange(len(buf)) + np.repeat(np.arange(len(units)), size)
        starts, ends, ids = [], [], []
        for at, n, found in self._found(buf, left):
            starts.append(node[at])
            ends.append(starts[-1] + n)
            ids.append(found)
        bare = self._bare(units, begin)
        starts.append(node[bare])
        ends.append(starts[-1] + 1)
        ids.append(self.byte_id[buf[bare]])
        s, e, p = np.concatenate(starts), np.concatenate(ends), np.concatenate(ids)
        n_nodes = len(buf) + len(units)
        local = np.arange(n_nodes) - np.repeat(node0, size + 1)
        order = np.argsort(local[e] * n_nodes + e, kind="stable")
        s, e, p = s[order], e[order], p[order]
        alpha = np.full(n_nodes, -np.inf)
        alpha[node0] = 0.0
        weight = np.empty(len(s))
        at = np.searchsorted(local[e], np.arange(1, int(size.max(initial=0)) + 2))
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            if a == b:
                continue
            w = alpha[s[a:b]] + self.logp[p[a:b]]
            first = np.flatnonzero(np.diff(e[a:b], prepend=-1))
            top = np.maximum.reduceat(w, first)
            flat = np.where(np.isfinite(top), top, 0.0)
            x = np.exp(w - np.repeat(flat, np.diff(first, append=b - a)))
            total = np.add.reduceat(x, first)
            with np.errstate(divide="ignore"):
                alpha[e[a:b][first]] = flat + np.log(total)
            weight[a:b] = x
        first = np.flatnonzero(np.diff(e, prepend=-1))
        group = np.repeat(np.arange(len(first)), np.diff(first, append=len(e)))
        edge0 = np.full(n_nodes, -1, np.int64)
        share = weight
        if len(first):
            run = np.cumsum(weight)
            total = np.maximum(np.add.reduceat(weight, first), 1e-300)
            share = np.clip((run - (run - weight)[first][group]) / total[group], 0, 1)
            share[np.append(first[1:], len(e)) - 1] = 1.0
            edge0[e[first]] = first
        return edge0, p, s, share, node0, node0 + size

    def _bare(self, units: list[str], begin: np.ndarray) -> np.ndarray:
        """Bytes of characters that have no piece of their own."""
        chars = set().union(*units) if units else set()
        odd = {c for c in chars if c not in self.singles and c != " "} | ({MARK} & chars)
        if not odd:
            return np.zeros(0, np.int64)
        out: list[int] = []
        for u, b in zip(units, begin.tolist()):
            if not odd.isdisjoint(u):
                for c in u:
                    n = len(c.encode())
                    if c in odd:
                        out.extend(range(b, b + n))
                    b += n
        return np.array(out, np.int64)

    def sample(self, texts: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all texts in a row, and their number for each text."""
        known: dict = {}
        cut = [self.units(t, known) for t in texts]
        per = np.array([len(p) for p in cut], np.int64)
        number = Numbers()
        unit = np.fromiter(map(number.__getitem__, chain.from_iterable(cut)), np.int64, int(per.sum()))
        if not len(unit):
            return np.zeros(0, np.int64), per
        # A unit begins with its first space or, where the text has one, with its line end.
        edge0, piece, start, share, node0, node1 = self.lattice([u[0] if type(u) is tuple else u if u[:1] == "\n" else " " + u for u in number])
        key = np.repeat(keys.astype(np.int64).view(np.uint64) ^ self.seed, per)
        place = np.arange(len(unit)) - np.repeat(np.cumsum(per) - per, per)
        who, now = np.arange(len(unit)), node1[unit]
        got_who, got_id = [], []
        step = 0
        while len(who):
            u = uniform(key[who], place[who], step)
            edge = edge0[now]
            more = np.flatnonzero(share[edge] <= u)
            while len(more):
                edge[more] += 1
                more = more[share[edge[more]] <= u[more]]
            got_who.append(who)
            got_id.append(piece[edge])
            now = start[edge]
            go = now > node0[unit[who]]
            who, now = who[go], now[go]
            step += 1
        who, ids = np.concatenate(got_who), np.concatenate(got_id)
        count = np.bincount(who, minlength=len(unit))
        after = np.cumsum(count)
        # Steps go backward: the k-th draw of an occurrence is its k-th piece from the end.
        out = np.empty(len(ids), np.int64)
        done = 0
        for k, w in enumerate(got_who):
            out[after[w] - 1 - k] = ids[done : done + len(w)]
            done += len(w)
        ends = np.cumsum(per)
        upto = np.concatenate([[0], after])
        return out, upto[ends] - upto[ends - per]

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The texts' bytes: surfaces joined, less the dummy space."""
        wide = self.wide[ids]
        upto = np.cumsum(wide)
        total = int(upto[-1]) if len(ids) else 0
        raw = self.flat[np.repeat(self.at[ids] - (upto - wide), wide) + np.arange(total)].tobytes()
        bounds = np.concatenate([[0], upto])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        return [raw[a + 1 : b] if b > a else b"" for a, b in zip(bounds[:-1], bounds[1:])]


_samplers: dict = {}


def sampler(path: str, theta: float = THETA, seed: int = SEED) -> Sampler:
    if (path, theta, seed) not in _samplers:
        _samplers[(path, theta, seed)] = Sampler(path, theta, seed)
    return _samplers[(path, theta, seed)]


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    ship(docs.sparkSession)
    return docs.select(key_column(key).alias("k"), F.col(f"`{text}`").cast("string").alias("t"))


def _segment(model: Sampler, pdf: pd.DataFrame):
    texts = pdf["t"].fillna("").tolist()
    keys = pdf["k"].to_numpy(np.int64)
    keys = np.where(keys == NO_KEY, 0, keys)
    for i, j in chunks(texts, 4 << 20):
        ids, counts = model.sample(texts[i:j], keys[i:j])
        yield slice(i, j), texts[i:j], ids, counts


def encode(docs: DataFrame, model: str, theta: float = THETA, seed: int = SEED, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, pieces array<int>)``: one sampled segmentation of every text."""

    def run(batches):
        m = sampler(model, theta, seed)
        for pdf in batches:
            for at, _, ids, counts in _segment(m, pdf):
                parts = np.split(ids.astype(np.int32), np.cumsum(counts)[:-1])
                yield pd.DataFrame({"k": pdf["k"].iloc[at], "pieces": list(parts)})

    return null_key(_rows(docs, key, text).mapInPandas(run, "k long, pieces array<int>"), key)


def decode(rows: DataFrame, model: str, key: str = "doc_id") -> DataFrame:
    """``(key, text)`` from ``(key, pieces)``."""

    def run(batches):
        m = sampler(model)
        for pdf in batches:
            parts = [np.asarray(p if p is not None else [], np.int64) for p in pdf["pieces"]]
            ids = np.concatenate(parts) if parts else np.zeros(0, np.int64)
            texts = m.decode(ids, np.array([len(p) for p in parts], np.int64))
            yield pd.DataFrame({"k": pdf["k"], "text": [t.decode() for t in texts]})

    ship(rows.sparkSession)
    return null_key(rows.select(key_column(key).alias("k"), "pieces").mapInPandas(run, "k long, text string"), key)


def digest(docs: DataFrame, model: str, theta: float = THETA, seed: int = SEED, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n_pieces, ids_crc32, n_bytes, lossless)``: each text segmented, decoded and compared."""

    def run(batches):
        m = sampler(model, theta, seed)
        for pdf in batches:
            for at, texts, ids, counts in _segment(m, pdf):
                back = m.decode(ids, counts)
                ends = np.cumsum(counts).tolist()
                raw = ids.astype("<u4").tobytes()
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends, counts.tolist())]
                same = [b == t.encode() for b, t in zip(back, texts)]
                yield pd.DataFrame({"k": pdf["k"].iloc[at], "n_pieces": counts, "ids_crc32": crc, "n_bytes": [len(b) for b in back], "lossless": same})

    return null_key(_rows(docs, key, text).mapInPandas(run, "k long, n_pieces long, ids_crc32 long, n_bytes long, lossless boolean"), key)


def query(spark, sf_dir: str) -> DataFrame:
    """op6: every document's sampled segmentation, decoded again."""
    import public_tokenizers

    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
