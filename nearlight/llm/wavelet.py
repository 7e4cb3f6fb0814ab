"""Token ids in wavelet-matrix shards.

Texts are encoded whole, an end id follows each, and the ids go to shards in ascending key
order. A shard is one wavelet matrix: for each of 16 bits a plane of one bit a token, the
tokens being stably parted by that bit from plane to plane, with a directory of counts. Planes
are compressed in blocks of their own, so that :class:`WaveletMatrix` answers access, rank,
select and counting without inflating the rest.

Files: Parquet, a row for each shard, so that any store that Spark writes will do and a lost
executor's output is written anew by the retried task. Columns: ``part`` and ``seq`` (order),
``part_start`` (ids before the shard in its part), ``n_tokens``, ``keys`` and ``counts`` (each
document's key and number of ids, little-endian int64; the least int64 is a null key), ``data`` (the
matrix).

Defined cases: a null or empty text is the end id alone; a null key sorts first; equal keys follow each
other by a hash of their texts; strings of special tokens in a text are ordinary text; an empty table writes no shard;
a document longer than a shard is a shard of its own; other columns are not read.
"""

from __future__ import annotations

import json
import re
import string
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearlight.llm.common import blob, chunks, kept_dir, key_column, mix, null_key, scratch, ship, small_batches

END_ID = 2
SHARD_TOKENS = 1 << 20
BITS = 16
BLOCK = 16 << 10  # bytes of a plane that are compressed together
CACHE_WORDS = 800_000
_WORD_CUT = re.compile(r"(?<=\S) ")


class Merges:
    """A byte-level vocabulary's merges over many short words at once.

    Every word does one merge a round: of its neighbouring pairs the one of least rank, the leftmost
    of equals, which is the order that the tokenizers library keeps. Ranks are kept beside the
    symbols, so that a merge looks up its two new pairs only."""

    NONE = 1 << 24
    WIDEST = 64  # symbols of a word

    def __init__(self, model: dict):
        vocab = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        key = np.array([vocab[a] << 16 | vocab[b] for a, b in pairs], np.uint32)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        # The alphabet: bytes that print stand for themselves, the others follow 255 in order.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        sign = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
        self.first = np.array([vocab[sign[b]] for b in range(256)], np.int32)
        rank = np.arange(len(key), dtype=np.int32)
        self.tables = []
        seed = 0x9E3779B1
        while len(key):  # a key whose slot is taken goes to the next table
            at = self._slot(key, seed)
            _, one = np.unique(at, return_index=True)
            keys, ranks = np.zeros(1 << 18, np.uint32), np.full(1 << 18, self.NONE, np.int32)
            keys[at[one]], ranks[at[one]] = key[one], rank[one]
            self.tables.append((seed, keys, ranks))
            rest = np.setdiff1d(np.arange(len(key)), one)
            key, rank, seed = key[rest], rank[rest], (seed * 0x85EBCA6B | 1) & 0xFFFFFFFF

    @staticmethod
    def _slot(key: np.ndarray, seed: int) -> np.ndarray:
        return (key * np.uint32(seed)) >> np.uint32(14)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.uint32) << np.uint32(16) | b.astype(np.uint32)
        out = np.full(len(key), self.NONE, np.int32)
        todo = None
        for seed, keys, ranks in self.tables:
            k = key if todo is None else key[todo]
            at = self._slot(k, seed)
            hit = keys[at] == k
            if todo is None:
                np.copyto(out, ranks[at], where=hit)
                taken = ranks[at] < self.NONE  # an empty slot ends the search
                todo = np.flatnonzero(taken & ~hit)
            else:
                out[todo[hit]] = ranks[at[hit]]
                todo = todo[(ranks[at] < self.NONE) & ~hit]
            if not len(todo):
                break
        return out

    def encode(self, raw: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of ``size`` bytes (1 to ``WIDEST``) that follow each other in ``raw``, and
        their numbers."""
        sym = self.first[raw]
        count = size.astype(np.int64)
        who = np.arange(len(count))
        done_who, done_sym, final = [], [], count.copy()
        end = np.cumsum(count)
        rank = np.full(len(sym), self.NONE, np.int32)
        if len(sym) > 1:
            rank[:-1] = self.ranks(sym[:-1], sym[1:])
        rank[end - 1] = self.NONE
        while len(who):
            start = np.cumsum(count) - count
            place = np.arange(len(sym)) - np.repeat(start, count)
            best = np.minimum.reduceat(rank.astype(np.int64) * self.WIDEST + place, start)
            more = best < self.NONE * self.WIDEST
            if not more.all():
                keep = np.repeat(more, count)
                done_who.append(who[~more])
                done_sym.append(sym[~keep])
                final[who[~more]] = count[~more]
                sym, rank = sym[keep], rank[keep]
                who, count, best = who[more], count[more], best[more]
                start = np.cumsum(count) - count
                if not len(who):
                    break
            at = start + best % self.WIDEST
            sym[at] = self.made[best // self.WIDEST]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            count = count - 1
            sym, rank = sym[keep], rank[keep]
            at -= np.arange(len(at))  # one symbol less for each word before
            start = np.cumsum(count) - count
            rank[at] = self.NONE
            t = at[at + 1 < start + count]
            rank[t] = self.ranks(sym[t], sym[t + 1])
            t = at[at > start]
            rank[t - 1] = self.ranks(sym[t - 1], sym[t])
        order = np.concatenate(done_who) if done_who else who
        ids = np.concatenate(done_sym) if done_sym else sym
        # Words end in the order of their rounds: back to their own.
        n = final[order]
        begin = np.empty(len(order), np.int64)
        begin[order] = np.cumsum(n) - n
        upto = np.cumsum(final)
        return ids[np.repeat(begin - (upto - final), final) + np.arange(int(upto[-1]) if len(upto) else 0)], final


class Encoder:
    """Byte-level BPE of whole texts, each distinct piece encoded once.

    A text may be cut before any space that follows a non-space character, and before a single
    line end between two of them: the pre-tokenizer begins a token there whatever surrounds it. So
    it does before signs that follow a letter and end such a piece. The cut pieces' ids, joined, are
    the text's. Words of letters go through :class:`Merges`, all other pieces through the tokenizers
    library. Pieces are kept by a 64-bit hash with their length and first eight bytes beside it.
    """

    SPACE, LINE, HEAD, TAIL = range(4)  # what comes before a piece: a space, a line end, the end id, nothing
    WIDE_SPACES = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
    BASE = np.uint64(0xC2B2AE3D27D4EB4F)

    def __init__(self, path: str, end_id: int = END_ID):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        if self.tok.get_vocab_size() > 1 << BITS or not 0 <= end_id < 1 << BITS:
            raise ValueError(f"ids of {BITS} bits are not enough for this vocabulary")
        self.merges = self._merges(path)
        self.end_id, self.line = end_id, self.tok.encode("\n", add_special_tokens=False).ids
        rng = np.random.default_rng(17)
        self.table = rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.power = self.inverse = np.ones(0, np.uint64)
        self.blank, self.sign, self.letter = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
        self.blank[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
        self.sign[[ord(c) for c in string.punctuation]] = True
        self.letter[[ord(c) for c in string.ascii_letters]] = True
        self._reset()

    @staticmethod
    def _merges(path: str) -> Merges | None:
        """The vocabulary's merges where a word of letters after a space is one token to them."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, cut = spec["model"], spec.get("pre_tokenizer") or {}
        odd = [model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback")]
        fits = model.get("type", "BPE") == "BPE" and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
        return Merges(model) if fits and not any(odd) and spec.get("normalizer") is None else None

    def _reset(self) -> None:
        self.n, self.n_vals, self.slots = 0, 0, 20
        self.vals = np.zeros(1 << 16, np.uint16)
        self.facts = {k: np.zeros(1 << 16, t) for k, t in (("starts", np.int64), ("lens", np.int64), ("hits", np.uint8), ("hash", np.uint64), ("check", np.uint64))}
        self.place = np.full(1 << self.slots, -1, np.int32)

    def _shrink(self) -> None:
        """Forget the pieces that fewer than three batches had."""
        f, n = self.facts, self.n
        keep = np.flatnonzero(f["hits"][:n] >= 3)
        if len(keep) > CACHE_WORDS // 2:
            keep = keep[:0]
        lens = f["lens"][keep]
        upto = np.cumsum(lens)
        ids = self.vals[np.repeat(f["starts"][keep] - (upto - lens), lens) + np.arange(int(lens.sum()))]
        h, check = f["hash"][keep], f["check"][keep]
        self._reset()
        self._add(h, check)
        self._store(np.arange(len(keep)), ids, lens)

    def _add(self, h: np.ndarray, check: np.ndarray) -> None:
        """New numbers for pieces that the table does not have."""
        n = self.n + len(h)
        while n > len(self.facts["hash"]):
            self.facts = {k: np.concatenate([v, np.zeros_like(v)]) for k, v in self.facts.items()}
        self.facts["hash"][self.n : n], self.facts["check"][self.n : n] = h, check
        number = np.arange(self.n, n, dtype=np.int32)
        self.n = n
        if 2 * n > len(self.place):
            self.slots += 2
            self.place = np.full(1 << self.slots, -1, np.int32)
            number, h = np.arange(n, dtype=np.int32), self.facts["hash"][:n]
        at = (h >> np.uint64(64 - self.slots)).astype(np.int64)
        while len(at):
            free = np.flatnonzero(self.place[at] < 0)
            _, one = np.unique(at[free], return_index=True)
            self.place[at[free[one]]] = number[free[one]]
            rest = np.ones(len(at), bool)
            rest[free[one]] = False
            at, number = (at[rest] + 1) & (len(self.place) - 1), number[rest]

    def _find(self, h: np.ndarray, check: np.ndarray) -> np.ndarray:
        """Numbers of pieces, -1 for those that the table does not have."""
        at = (h >> np.uint64(64 - self.slots)).astype(np.int64)
        out = self.place[at]
        todo = np.flatnonzero((out >= 0) & ((self.facts["hash"][out] != h) | (self.facts["check"][out] != check)))
        while len(todo):
            at[todo] = (at[todo] + 1) & (len(self.place) - 1)
            got = self.place[at[todo]]
            out[todo] = got
            todo = todo[(got >= 0) & ((self.facts["hash"][got] != h[todo]) | (self.facts["check"][got] != check[todo]))]
        return out

    def _store(self, numbers: np.ndarray, ids: np.ndarray, lens: np.ndarray) -> None:
        while self.n_vals + len(ids) > len(self.vals):
            self.vals = np.concatenate([self.vals, np.zeros_like(self.vals)])
        self.vals[self.n_vals : self.n_vals + len(ids)] = ids
        self.facts["lens"][numbers] = lens
        self.facts["starts"][numbers] = self.n_vals + np.cumsum(lens) - lens
        self.n_vals += len(ids)

    def _letters(self, raw: np.ndarray) -> np.ndarray:
        """Bytes of Latin letters: of ASCII, or two bytes of U+00C0 to U+017F but for two signs."""
        ok = self.letter[raw]
        lead = np.flatnonzero((raw[:-1] >= 0xC3) & (raw[:-1] <= 0xC5))
        lead = lead[(raw[lead] != 0xC3) | ((raw[lead + 1] >= 0x80) & (raw[lead + 1] != 0x97) & (raw[lead + 1] != 0xB7))]
        ok[lead] = ok[lead + 1] = True
        return ok

    def _learn(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray, kind: np.ndarray, base: int) -> None:
        """Encode new pieces and store them from the number ``base`` on."""
        size = end - start
        latin = np.zeros(len(size), bool)
        if self.merges:
            upto = np.cumsum(size)
            raw = buf[np.repeat(start - (upto - size), size) + np.arange(int(upto[-1]))]
            odd = np.concatenate([[0], np.cumsum(~self._letters(raw))])
            latin = (odd[upto] == odd[upto - size]) & (size > 0) & (size < Merges.WIDEST) & (kind != self.TAIL)
            part = np.flatnonzero(latin)
        if latin.any():
            spaced = (kind[part] == self.SPACE).astype(np.int64)
            n = size[part] + spaced
            upto = np.cumsum(n)
            at = np.repeat(start[part] - spaced - (upto - n), n) + np.arange(int(upto[-1]))
            words = buf[at]
            words[(upto - n)[spaced > 0]] = 32
            ids, lens = self.merges.encode(words, n)
            more = np.where(kind[part] == self.LINE, len(self.line), np.where(kind[part] == self.HEAD, 1, 0))
            out = np.empty(len(ids) + int(more.sum()), np.uint16)
            upto = np.cumsum(lens + more)
            own = np.arange(len(out)) >= np.repeat(upto - lens, lens + more)
            out[own] = ids
            first = upto - lens - more
            out[first[kind[part] == self.HEAD]] = self.end_id
            for i, x in enumerate(self.line):
                out[first[kind[part] == self.LINE] + i] = x
            self._store(base + part, out, lens + more)
        rest = np.flatnonzero(~latin)
        if len(rest):
            raw, before = buf.tobytes(), {self.SPACE: " ", self.LINE: "\n", self.HEAD: "", self.TAIL: ""}
            words = [before[k] + raw[a:b].decode() for a, b, k in zip(start[rest].tolist(), end[rest].tolist(), kind[rest].tolist())]
            got = [e.ids for e in self.tok.encode_batch_fast(words, add_special_tokens=False)]
            got = [[self.end_id, *g] if k == self.HEAD else g for g, k in zip(got, kind[rest].tolist())]
            self._store(base + rest, np.array([i for g in got for i in g], np.uint16), np.array([len(g) for g in got], np.int64))

    def _cut(self, raw: list[bytes]):
        """Bytes, and each piece's first byte, end and kind, for all texts in a row."""
        buf = np.frombuffer(b"\n" + b"\n".join(raw) + b"\n", np.uint8)
        size = np.array([len(r) for r in raw], np.int64)
        head = np.cumsum(size + 1) - size - 1  # the line end before each text
        blank = self.blank[buf]
        odd = np.zeros(len(raw), bool)
        # Blanks in a row, at a text's ends, or none between: texts that need a closer look.
        odd[np.minimum(np.searchsorted(head, np.flatnonzero(blank[1:] & blank[:-1]), side="right") - 1, len(raw) - 1)] = True
        runs = np.flatnonzero(blank[1:] & blank[:-1])
        odd[np.maximum(np.searchsorted(head, runs + 1, side="right") - 1, 0).clip(max=len(raw) - 1)] = True
        high = np.flatnonzero((buf == 0xC2) | ((buf >= 0xE1) & (buf <= 0xE3)))  # wide spaces begin with these
        for k in np.unique(np.searchsorted(head, high, side="right") - 1).tolist():
            odd[k] = odd[k] or bool(self.WIDE_SPACES.search(raw[k].decode()))
        if not odd.any():
            at = np.flatnonzero((buf == 32) | (buf == 10))
            start, end = at[:-1] + 1, at[1:]
            kind = np.where(buf[at[:-1]] == 10, self.LINE, self.SPACE)
            kind[np.searchsorted(at, head)] = self.HEAD
            last = np.maximum.accumulate(np.where(self.sign[buf], -1, np.arange(len(buf))))[end - 1]
            tail = (last >= start) & (last < end - 1) & self.letter[buf[last]]
            to = np.arange(len(start)) + np.cumsum(tail) - tail
            n = len(start) + int(tail.sum())
            s, e, k = np.empty(n, np.int64), np.empty(n, np.int64), np.full(n, self.TAIL, np.int64)
            s[to], e[to], k[to] = start, np.where(tail, last + 1, end), kind
            s[to[tail] + 1], e[to[tail] + 1] = last[tail] + 1, end[tail]
            return buf, s, e, k
        if len(raw) > 1:
            turn = [0, *(np.flatnonzero(np.diff(odd)) + 1).tolist(), len(raw)]
            parts = []
            for a, b in zip(turn, turn[1:]):
                parts += [self._cut(raw[i : i + 1]) for i in range(a, b)] if odd[a] else [self._cut(raw[a:b])]
            base = np.cumsum([0, *[len(x[0]) for x in parts]])
            return np.concatenate([x[0] for x in parts]), *[np.concatenate([x[j] + (b if j < 3 else 0) for x, b in zip(parts, base)]) for j in (1, 2, 3)]
        words = [w.encode() for w in _WORD_CUT.split(raw[0].decode())]
        n = np.array([len(w) for w in words], np.int64)
        kind = np.full(len(n), self.SPACE)
        kind[0] = self.HEAD
        end = np.cumsum(n) + 1
        return np.frombuffer(b" " + b"".join(words), np.uint8), end - n, end, kind

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, each with its end id, and their numbers."""
        if not texts:
            return np.zeros(0, np.uint16), np.zeros(0, np.int64)
        if self.n > CACHE_WORDS:
            self._shrink()
        buf, start, end, kind = self._cut([t.encode() for t in texts])
        if len(buf) + 1 > len(self.power):
            inv = np.uint64(pow(int(self.BASE), -1, 1 << 64))
            one = np.ones(1, np.uint64)
            self.power = np.cumprod(np.concatenate([one, np.full(len(buf) + 1, self.BASE)]))
            self.inverse = np.cumprod(np.concatenate([one, np.full(len(buf) + 1, inv)]))
        prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.table[buf] * self.power[: len(buf)])])
        size = end - start
        h = mix((prefix[end] - prefix[start]) * self.inverse[start] + (4 * size + kind).astype(np.uint64))
        # The first eight bytes of each piece, read across the buffer.
        eight = np.ndarray(len(buf), "<u8", np.concatenate([buf, np.zeros(8, np.uint8)]).tobytes(), strides=(1,))
        check = eight[np.minimum(start, len(buf) - 1)] & (~np.uint64(0) >> (8 * (8 - np.clip(size, 0, 8))).clip(max=63).astype(np.uint64)) ^ (size.astype(np.uint64) << np.uint64(48)) ^ (kind.astype(np.uint64) << np.uint64(62))
        idx = self._find(h, check)
        new = np.flatnonzero(idx < 0)
        if len(new):
            _, first, which = np.unique(h[new], return_index=True, return_inverse=True)
            at, base = new[first], self.n
            self._add(h[at], check[at])
            self._learn(buf, start[at], end[at], kind[at], base)
            idx[new] = base + which
        hits = self.facts["hits"][idx]
        self.facts["hits"][idx] = hits + (hits < 3)  # once a batch, however often a piece occurs
        lens = self.facts["lens"][idx]
        upto = np.cumsum(lens)
        at = np.repeat(self.facts["starts"][idx] - (upto - lens), lens) + np.arange(int(upto[-1]))
        ids = np.append(self.vals[at[1:]], np.uint16(self.end_id))  # each head begins with the end id of the text before
        return ids, np.diff((upto - lens)[np.flatnonzero(kind == self.HEAD)], append=upto[-1])


class WaveletMatrix:
    """Bit planes over a sequence of ids below ``2**BITS``."""

    MAGIC = b"NLWM1\0\0\0"

    @staticmethod
    def build(ids: np.ndarray) -> bytes:
        import zstandard

        comp = zstandard.ZstdCompressor(level=1)
        seq = np.ascontiguousarray(ids, np.uint16)
        n = len(seq)
        zeros, blocks, ranks = [], [], []
        for b in range(BITS - 1, -1, -1):
            ones = 0
            low, high = [], []
            for k in range(0, n, 8 * BLOCK):  # a block at a time stays in the processor's cache
                run = seq[k : k + 8 * BLOCK]
                bit = (run & np.uint16(1 << b)) != 0
                blocks.append(comp.compress(np.packbits(bit, bitorder="little").tobytes()))
                ranks.append(ones)
                at = np.flatnonzero(bit)
                ones += len(at)
                low.append(run.take(np.flatnonzero(~bit), mode="clip"))
                high.append(run.take(at, mode="clip"))
            zeros.append(n - ones)
            seq = np.concatenate(low + high) if n else seq
        head = WaveletMatrix.MAGIC + struct.pack("<QII", n, BITS, BLOCK) + blob(np.array(zeros, "<u8"))
        return head + struct.pack("<I", len(blocks)) + blob(np.array(ranks, "<u8")) + blob(np.array([len(x) for x in blocks], "<u4")) + b"".join(blocks)

    def __init__(self, data: bytes):
        import zstandard

        if data[:8] != self.MAGIC:
            raise ValueError("not a wavelet-matrix shard")
        self.data, self.unzip = data, zstandard.ZstdDecompressor()
        self.n, self.bits, self.block = struct.unpack_from("<QII", data, 8)
        at = 24
        self.zeros = np.frombuffer(data, "<u8", self.bits, at).astype(np.int64)
        at += 8 * self.bits
        (count,) = struct.unpack_from("<I", data, at)
        at += 4
        self.ranks = np.frombuffer(data, "<u8", count, at).astype(np.int64)
        at += 8 * count
        lens = np.frombuffer(data, "<u4", count, at).astype(np.int64)
        at += 4 * count
        self.at = at + np.cumsum(lens) - lens
        self.lens = lens
        self.per = count // self.bits
        self.held: dict[int, np.ndarray] = {}

    def _bits(self, i: int) -> np.ndarray:
        if i not in self.held:
            raw = self.unzip.decompress(self.data[self.at[i] : self.at[i] + self.lens[i]])
            self.held[i] = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")
        return self.held[i]

    def _rank1(self, level: int, i: int) -> int:
        """Ones of a plane before ``i``."""
        if not self.n or i <= 0:
            return 0
        k, r = divmod(min(i, self.n), self.block * 8)
        if k == self.per:
            return self.n - int(self.zeros[level])
        return int(self.ranks[level * self.per + k]) + (int(self._bits(level * self.per + k)[:r].sum()) if r else 0)

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        v = 0
        for lv in range(self.bits):
            k, r = divmod(i, self.block * 8)
            one = int(self._bits(lv * self.per + k)[r])
            ones = self._rank1(lv, i)
            i = int(self.zeros[lv]) + ones if one else i - ones
            v = v << 1 | one
        return v

    def _range(self, token: int, i: int) -> tuple[int, int]:
        lo, hi = 0, min(max(i, 0), self.n)
        for lv in range(self.bits):
            a, b = self._rank1(lv, lo), self._rank1(lv, hi)
            if token >> (self.bits - 1 - lv) & 1:
                lo, hi = int(self.zeros[lv]) + a, int(self.zeros[lv]) + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def rank(self, token: int, i: int) -> int:
        """Occurrences of ``token`` before position ``i``."""
        if not 0 <= token < 1 << self.bits:
            return 0
        lo, hi = self._range(token, i)
        return hi - lo

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """Position of the ``k``-th occurrence, from 0; -1 if there are fewer."""
        if not 0 <= k < self.count(token):
            return -1
        lo, hi = 0, self.n
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if self.rank(token, mid + 1) > k else (mid + 1, hi)
        return lo

    def decode(self) -> np.ndarray:
        """All ids: the planes undone from the last to the first."""
        seq = np.zeros(self.n, np.uint16)
        for lv in range(self.bits - 1, -1, -1):
            z = int(self.zeros[lv])
            if z == self.n:
                continue
            out = np.empty(self.n, np.uint16)
            low, high, one = 0, z, np.uint16(1 << (self.bits - 1 - lv))
            for k in range(self.per):
                i, run = lv * self.per + k, out[8 * self.block * k : 8 * self.block * (k + 1)]
                raw = self.unzip.decompress(self.data[self.at[i] : self.at[i] + self.lens[i]])
                bit = np.unpackbits(np.frombuffer(raw, np.uint8), count=len(run), bitorder="little").view(bool)
                at = np.flatnonzero(bit)
                rest = len(run) - len(at)
                run[np.flatnonzero(~bit)] = seq[low : low + rest]
                run[at] = seq[high : high + len(at)] | one
                low, high = low + rest, high + len(at)
            seq = out
        return seq


_encoders: dict = {}


def encoder(path: str) -> Encoder:
    """The worker process's encoder, with what it has learned in earlier tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


FILES = "part int, seq int, part_start long, n_tokens long, keys binary, counts binary, data binary"


def write_shards(docs: DataFrame, path: str, tokenizer: str, shard_tokens: int = SHARD_TOKENS, key: str = "doc_id", text: str = "text") -> None:
    """Encode ``docs`` and write shards in ascending key order below ``path``."""
    spark = docs.sparkSession
    rows = docs.select(key_column(key).alias("k"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t")).withColumn("h", F.xxhash64("t"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))  # dealt evenly: a byte costs more here than in a shuffle
    rows = rows.repartitionByRange(n, "k", "h").sortWithinPartitions("k", "h", "t").drop("h")  # rows of one key, the null one too, may be many

    def encode(batches):
        from pyspark import TaskContext

        enc = encoder(tokenizer)
        part, seq, start = TaskContext.get().partitionId(), 0, 0
        held: list[tuple] = []
        size = 0

        def flush():
            nonlocal seq, start, held, size
            ids = np.concatenate([x[2] for x in held])
            row = {
                "part": part, "seq": seq, "part_start": start, "n_tokens": len(ids), "keys": blob(np.concatenate([x[0] for x in held])),
                "counts": blob(np.concatenate([x[1] for x in held])), "data": WaveletMatrix.build(ids),
            }
            seq, start, held, size = seq + 1, start + len(ids), [], 0
            return pd.DataFrame([row])

        for pdf in batches:
            texts, keys = pdf["t"].tolist(), pdf["k"].to_numpy(np.int64)
            for i, j in chunks(texts, 1 << 20):
                ids, counts = enc.encode(texts[i:j])
                held.append((keys[i:j], counts, ids))
                size += len(ids)
                if size >= shard_tokens:
                    yield flush()
        if held:
            yield flush()

    with scratch(spark):
        small_batches(spark)
        rows.mapInPandas(encode, FILES).write.option("compression", "none").parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a shard folder: key, start, n_tokens and ids (little-endian uint32)."""
    return _read(spark, path, lambda ids: ids.astype("<u4").tobytes(), "ids binary", "ids")


def digest_documents(spark: SparkSession, path: str) -> DataFrame:
    """As :func:`read_documents`, with the crc32 of the ids in their place."""
    return _read(spark, path, lambda ids: zlib.crc32(ids.astype("<u4").tobytes()), "ids_crc32 long", "ids_crc32")


def _read(spark: SparkSession, path: str, of, column: str, name: str) -> DataFrame:
    ship(spark)
    files = spark.read.schema(FILES).parquet(path)
    base, total = {}, 0
    for r in files.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect():  # a row for each writing task
        base[r["part"]] = total
        total += r["n"]

    def decode(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                ids = WaveletMatrix(r.data).decode()
                keys, counts = np.frombuffer(r.keys, np.int64), np.frombuffer(r.counts, np.int64)
                ends = np.cumsum(counts)
                begin = ends - counts
                out = [of(ids[a:b]) for a, b in zip(begin.tolist(), ends.tolist())]
                yield pd.DataFrame({"k": keys, "start": begin + (base[r.part] + r.part_start), "n_tokens": counts, name: out})

    out = files.mapInPandas(decode, f"k long, start long, n_tokens long, {column}")
    return null_key(out, "k")


def query(spark, sf_dir: str) -> DataFrame:
    """op1: every document's place and digest, from the shards read back."""
    import public_tokenizers

    path = kept_dir(spark, "wavelet")
    write_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return digest_documents(spark, path).withColumnRenamed("k", "doc_id")
