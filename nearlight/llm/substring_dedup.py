"""Exact removal of repeated byte strings by a hash-compared suffix sort.

A byte goes if a string of ``LENGTH`` bytes over it also starts anywhere else. Suffixes are
compared by prefix polynomial hashes: a binary search over lengths finds the common extension of
two suffixes in logarithmic time, and a mergesort orders them by the byte after it; strings that
the order brings together are verified byte by byte.

Sorting every suffix of a corpus in one place is neither possible nor needed. Every window of
``LENGTH`` bytes names one anchor, the least of its ``GRAM``-byte hashes (the leftmost of equals):
equal windows name equal anchors at equal offsets, so suffixes are dealt to sorts by anchor.
Consecutive windows with one anchor are a segment.

- Segments that are equal as a whole, by a cryptographic digest of anchor, place and bytes, are
  counted without their text.
- An anchor that occurs once settles its windows; so does one whose segments are all equal.
- For the others, one text of each distinct segment goes to the sort of its anchor. There the
  cores of 16 neighbouring windows are sorted first, and the windows themselves only where two
  cores agree.
- The windows of an anchor with more than ``HOT`` distinct segments (a passage that many documents hold
  in different surroundings) are dealt on by window: a sort needs them in one task, and such an
  anchor may have a third of all rows. Their 128-bit cryptographic digests are counted with partial sums.

Polynomial hashes are taken modulo 2**64 with random odd values for the bytes; the strings that
defeat any such base agree in fewer than 50 of the 64 bits at ``LENGTH`` bytes and below. What hashes
find equal in a sort is compared byte by byte. Long texts are looked at in overlapping parts.

A passage of many short words may have fewer than ``LENGTH`` bytes. With ``words``, a second pass finds
the strings of that many words (``[^\\x20\\x09-\\x0D]+``) in the same way, with 64 bits for a word in the place of a
byte: up to eight bytes as they are, shuffled, else a cryptographic digest; whitespace between words may differ. What either pass finds goes; with ``aside`` the
columns follow the strings of ``LENGTH`` bytes alone, and what both passes leave stands beside them.

Defined cases: null texts are empty; texts shorter than ``LENGTH`` keep everything; repeated rows
are occurrences of each other; null keys stay null; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearlight.llm.common import blob, chunks, cut, hold, key_column, lean, let_go, mix, null_key, scratch, small_batches

LENGTH = 400
GRAM = 100
CORE = 16  # windows whose common bytes are sorted first
HOT = 4_000
BITMAP = (16, 28)  # least and most bits of the prefilter's names; it has 16 for each wanted segment
PASSAGE_WORDS = 50  # as many whole words as a passage of over 50 has, even where it is joined to other text at one end
PART = 1 << 22  # bytes of a text that are looked at together
LIVE = 1 << 18  # windows that are sorted together
CHUNK = 1 << 19  # bytes of text whose windows are looked at together
SORT_BYTES = 1 << 20  # text of the anchors that are sorted together, some 95 bytes of memory for each

_K = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.isin(np.arange(256), [*b" \t\n\v\f\r"])
_LEFT = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)  # masks of the first bytes of a word
BYTES, WORDS = np.dtype(np.uint8), np.dtype(np.uint64)  # symbols that are compared: bytes, or words by 64 bits


class _Digests(dict):
    """Digests of words, as they are asked for."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= 1 << 18:
            self.clear()
        self[word] = out = hashlib.blake2b(word, digest_size=8).digest()
        return out


def word_edges(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of ``raw`` start and end."""
    edge = np.flatnonzero(np.diff(_SPACE[np.frombuffer(raw, np.uint8)], prepend=True, append=True))
    return edge[0::2], edge[1::2]


def word_symbols(texts: list[bytes], digests: _Digests) -> list[bytes]:
    """64 bits for each word of each text. Words of up to eight bytes never share them: shorter ones
    have their number in the last byte, and those of eight whose own last byte looks so are digested as longer ones are."""
    raw = b" ".join(texts) + b" " * 8
    lo, hi = word_edges(raw)
    size = hi - lo
    eight = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))
    last = np.where(size < 8, size, 0).astype(np.uint64) << np.uint64(56)
    code = eight[lo] & _LEFT[np.minimum(size, 8)] | last
    out = mix(code + _K)
    t = np.flatnonzero((size > 8) | (size == 8) & (code >> np.uint64(56) < 8))
    out[t] = np.frombuffer(b"".join([digests[raw[a:b]] for a, b in zip(lo[t].tolist(), hi[t].tolist())]), np.uint64)
    ends = np.searchsorted(lo, np.cumsum([len(x) + 1 for x in texts])).tolist()
    whole = memoryview(out.tobytes())
    return [bytes(whole[8 * a : 8 * b]) for a, b in zip([0, *ends], ends)]


class Hashes:
    """Prefix polynomial hashes of a buffer; ``of(i, n)`` names the ``n`` symbols from ``i``."""

    BASE = np.uint64(0xC2B2AE3D27D4EB4F)
    TABLE = np.random.default_rng(13).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    power = inverse = np.ones(0, np.uint64)

    def __init__(self, buf: np.ndarray):
        n = len(buf) + 1
        if n > len(Hashes.power):
            inv = np.uint64(pow(int(self.BASE), -1, 1 << 64))
            Hashes.power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, self.BASE)]))
            Hashes.inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, inv)]))
        self.buf = buf
        self.prefix = np.concatenate([[np.uint64(0)], np.cumsum((self.TABLE[buf] if buf.dtype == BYTES else buf) * Hashes.power[: len(buf)])])

    @classmethod
    def forget(cls, most: int) -> None:
        """Keep the powers for buffers of up to ``most`` symbols only."""
        if len(cls.power) > most + 1:
            cls.power, cls.inverse = cls.power[: most + 1].copy(), cls.inverse[: most + 1].copy()

    def of(self, i: np.ndarray, n) -> np.ndarray:
        return (self.prefix[i + n] - self.prefix[i]) * Hashes.inverse[i]

    def common(self, a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
        """Length of the common extension of the suffixes at ``a`` and ``b``, up to ``limit``."""
        lo = np.zeros(len(a), np.int64)
        hi = np.full(len(a), limit, np.int64)
        for _ in range(limit.bit_length()):
            mid = (lo + hi + 1) // 2
            same = self.of(a, mid) == self.of(b, mid)
            lo = np.where(same, mid, lo)
            hi = np.where(same, hi, mid - 1)
        return lo

    def less(self, a: np.ndarray, b: np.ndarray, limit: int, ties: bool) -> np.ndarray:
        """Suffix at ``a`` before that at ``b``; ``ties`` is the answer for equal ones."""
        n = self.common(a, b, limit)
        last = len(self.buf) - 1
        return np.where(n == limit, ties, self.buf[np.minimum(a + n, last)] < self.buf[np.minimum(b + n, last)])


def suffix_sort(h: Hashes, at: np.ndarray, limit: int) -> np.ndarray:
    """Order of the suffixes ``at`` by their first ``limit`` symbols (``limit >= 8`` for bytes).

    Runs are formed by the first eight bytes, or the first word; each run of equal ones is merged bottom up, all
    runs together, every comparison being a common extension by hashes."""
    key = h.buf[at].astype(np.uint64)
    for k in range(1, 8 if h.buf.dtype == BYTES else 1):
        key = key << np.uint64(8) | h.buf[at + k].astype(np.uint64)
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(at) else np.zeros(0, np.int64)
    size = np.diff(first, append=len(at))
    some = np.flatnonzero(size > 1)
    first, size = first[some], size[some]
    width = 1
    while len(size):
        some = np.flatnonzero(size > width)
        first, size = first[some], size[some]
        if not len(size):
            break
        # Every element of these runs: its place in its run, and the half-run it is merged with.
        total = int(size.sum())
        run = np.repeat(np.arange(len(size)), size)
        place = np.arange(total) - np.repeat(np.cumsum(size) - size, size)
        pair = place // (2 * width) * (2 * width)
        right = (place - pair) >= width
        lo = np.where(right, pair, pair + width)
        hi = np.minimum(lo + width, size[run])
        lo = np.minimum(lo, hi)
        other0, own = lo.copy(), place - pair - np.where(right, width, 0)
        base = first[run]
        mine = at[order[base + place]]
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            mid = (lo[open_] + hi[open_]) // 2
            theirs = at[order[base[open_] + mid]]
            # The left half goes first among equals.
            r = right[open_]
            before = np.empty(len(open_), bool)
            for side in (False, True):
                t = np.flatnonzero(r == side)
                before[t] = h.less(theirs[t], mine[open_[t]], limit, side)
            up = np.flatnonzero(before)
            down = np.flatnonzero(~before)
            lo[open_[up]] = mid[up] + 1
            hi[open_[down]] = mid[down]
            open_ = open_[np.flatnonzero(lo[open_] < hi[open_])]
        new = pair + own + (lo - other0)
        moved = np.empty(total, np.int64)
        flat = np.repeat(np.cumsum(size) - size, size)
        moved[flat + new] = order[base + place]
        order[base + place] = moved
        width *= 2
    return order


def equal_runs(h: Hashes, at: np.ndarray, limit: int) -> np.ndarray:
    """Class of each suffix by its first ``limit`` symbols, verified one by one; -1 if alone."""
    out = np.full(len(at), -1, np.int64)
    if len(at) < 2:
        return out
    order = suffix_sort(h, at, limit)
    a, b = at[order[:-1]], at[order[1:]]
    same = h.common(a, b, limit) == limit
    t = np.flatnonzero(same)
    step = np.arange(limit)
    for k in range(0, len(t), 4096):
        u = t[k : k + 4096]
        same[u] = (h.buf[a[u, None] + step] == h.buf[b[u, None] + step]).all(axis=1)
    number = np.concatenate([[0], np.cumsum(~same)])
    twin = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    t = np.flatnonzero(twin)
    out[order[t]] = number[t]
    return out


def segments(raw: list[bytes], length: int, gram: int, kind: np.dtype = BYTES):
    """Segments of all texts: text index, first and last window, anchor, hashes, and ``Hashes``."""
    wide = kind.itemsize
    size = np.array([len(r) // wide for r in raw], np.int64)
    end = np.cumsum(size)
    begin = end - size
    buf = np.frombuffer(b"".join(raw), kind)
    n = len(buf)
    if n < length or not (size >= length).any():
        return None
    h = Hashes(buf)
    w = length - gram + 1
    pos = np.arange(n - gram + 1)
    packed = (mix(h.of(pos, gram)) >> np.uint64(28) << np.uint64(28)) | pos.astype(np.uint64)
    rows = -(-len(packed) // w)
    grid = np.concatenate([packed, np.full(rows * w - len(packed), np.uint64(2**64 - 1))]).reshape(rows, w)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    n_win = n - length + 1
    least = np.minimum(back[:n_win], ahead[w - 1 : w - 1 + n_win])
    per = np.maximum(size - length + 1, 0)
    win = np.repeat(begin - (np.cumsum(per) - per), per) + np.arange(int(per.sum()))
    anchor = (least[win] & np.uint64((1 << 28) - 1)).astype(np.int64)
    first = np.flatnonzero(np.diff(anchor, prepend=-1))
    lo, hi = win[first], win[np.append(first[1:], len(win)) - 1]
    p = anchor[first]
    doc = np.searchsorted(end, lo, side="right")
    ah = mix(h.of(p, gram) + _K)
    whole, digest = memoryview(buf.tobytes()), hashlib.blake2b
    cx = b"".join([digest(whole[a:b], digest_size=8).digest() for a, b in zip((lo * wide).tolist(), ((hi + length) * wide).tolist())])
    cx = np.frombuffer(cx, np.uint64) ^ mix((p - lo).astype(np.uint64) + _K)
    return doc, lo, hi, p, ah, cx, begin, h


def _texts(batches, length: int, kind: np.dtype):
    """Texts or parts of long ones with their rows: ``(frame, rows, first symbols, symbols)``. Parts
    overlap by ``length - 1``, so that each window lies in one part."""
    digests, wide = _Digests(), kind.itemsize
    for pdf in batches:
        rows, froms, raw = [], [], []
        texts = [t.encode() for t in pdf["t"]]
        if kind == WORDS:
            texts = [x for i, j in chunks(texts, 1 << 20) for x in word_symbols(texts[i:j], digests)]
        for i, x in enumerate(texts):
            for a in range(0, max(1, len(x) // wide - length + 1), PART):
                rows.append(i)
                froms.append(a)
                raw.append(x[a * wide : (a + PART + length - 1) * wide])
        rows, froms = np.array(rows, np.int64), np.array(froms, np.int64)
        for i, j in chunks(raw, CHUNK * wide):
            yield pdf, rows[i:j], froms[i:j], raw[i:j]


def anchored(rows: DataFrame, length: int, gram: int, kind: np.dtype) -> DataFrame:
    """``(ah, cx, k, th, lo, hi)``: a row for each segment."""

    def run(batches):
        for pdf, row, at, raw in _texts(batches, length, kind):
            got = segments(raw, length, gram, kind)
            if got is None:
                continue
            doc, lo, hi, _, ah, cx, begin, _ = got
            k, th, base = pdf["k"].to_numpy()[row[doc]], pdf["th"].to_numpy()[row[doc]], at[doc] - begin[doc]
            yield pd.DataFrame({"ah": ah.view(np.int64), "cx": cx.view(np.int64), "k": k, "th": th, "lo": lo + base, "hi": hi + base})

    return rows.mapInPandas(lean(run), "ah long, cx long, k long, th long, lo long, hi long")


def _name(ah, cx, k, th, lo) -> np.ndarray:
    x = [np.asarray(v, np.int64).view(np.uint64) for v in (ah, cx, k, th, lo)]
    out = x[0]
    for v in x[1:]:
        out = mix(out + v * np.uint64(0xD1342543DE82EF95) + _K)
    return out


def _row_name(k, th) -> np.ndarray:
    none = np.zeros(len(k), np.int64)
    return _name(none, none, k, th, none)


def bitmap(wanted: DataFrame) -> tuple[np.ndarray, int]:
    """Bits of the names of ``wanted`` segments and of their texts, 32 MB at most, and what names are shifted by."""
    width = min(max(BITMAP[0], (16 * wanted.count()).bit_length()), BITMAP[1])
    shift = np.uint64(64 - width)

    def bits(batches):
        got = np.zeros(1 << width, bool)
        for pdf in batches:
            for name in (_name(pdf["ah"], pdf["cx"], pdf["k"], pdf["th"], pdf["lo"]), _row_name(pdf["k"], pdf["th"])):
                got[(name >> shift).astype(np.int64)] = True
        packed = np.packbits(got).reshape(64, -1)
        some = [p for p in range(64) if packed[p].any()]
        yield pd.DataFrame({"part": some, "bits": [blob(packed[p]) for p in some]})

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros((1 << width) // 512, np.uint8)
        for b in pdf["bits"]:
            out |= np.frombuffer(b, np.uint8)
        return pd.DataFrame({"part": pdf["part"].iloc[:1], "bits": [blob(out)]})

    whole = np.zeros((64, (1 << width) // 512), np.uint8)
    for r in wanted.mapInPandas(bits, "part int, bits binary").groupBy("part").applyInPandas(join, "part int, bits binary").collect():
        whole[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    return whole.reshape(-1), shift


def cut_segments(rows: DataFrame, wanted: DataFrame, length: int, gram: int, kind: np.dtype) -> DataFrame:
    """``wanted(ah, cx, k, th, lo, n, hot)`` with the segment's symbols, its anchor's offset and, for hot
    anchors, two hashes of each window in place of the bytes."""
    held = rows.sparkSession.sparkContext.broadcast(bitmap(wanted))
    wide = kind.itemsize

    def run(batches):
        maybe, shift = held.value

        def has(name):
            name = (name >> shift).astype(np.int64)
            return maybe[name >> 3] >> (7 - (name & 7)).astype(np.uint8) & 1

        some = (pdf[has(_row_name(pdf["k"], pdf["th"])) == 1] for pdf in batches)
        for pdf, row, begins, raw in _texts(some, length, kind):
            got = segments(raw, length, gram, kind)
            if got is None:
                continue
            doc, lo, hi, p, ah, cx, begin, h = got
            k, th = pdf["k"].to_numpy()[row[doc]], pdf["th"].to_numpy()[row[doc]]
            at = lo - begin[doc] + begins[doc]
            t = np.flatnonzero(has(_name(ah.view(np.int64), cx.view(np.int64), k, th, at)))
            if len(t):
                text = h.buf.tobytes()
                yield pd.DataFrame(
                    {
                        "ah": ah[t].view(np.int64), "cx": cx[t].view(np.int64), "k": k[t], "th": th[t], "lo": at[t], "off": (p - lo)[t].astype(np.int32),
                        "body": [text[a * wide : (b + length) * wide] for a, b in zip(lo[t].tolist(), hi[t].tolist())],
                    }
                )

    got = rows.mapInPandas(lean(run), "ah long, cx long, k long, th long, lo long, off int, body binary")
    # Rows that are repeated as a whole give the same segment twice.
    return got.join(wanted, ["ah", "cx", "k", "th", "lo"]).dropDuplicates(["ah", "cx"])


def sort_segments(parts: list[tuple[bytes, int]], length: int, kind: np.dtype) -> list[np.ndarray]:
    """For each ``(symbols, anchor offset)``, which of its windows another part also has."""
    raw = [b for b, _ in parts]
    size = np.array([len(b) // kind.itemsize for b in raw], np.int64)
    begin = np.cumsum(size) - size
    n_win = size - length + 1
    off = np.array([o for _, o in parts], np.int64)
    h = Hashes(np.frombuffer(b"".join(raw), kind))
    part = np.repeat(np.arange(len(parts)), n_win)
    start = np.repeat(begin - (np.cumsum(n_win) - n_win), n_win) + np.arange(int(n_win.sum()))
    anchor = begin + off
    # Windows that begin 16b to 16b + 15 symbols before the anchor share the core from 16b before it.
    block = (anchor[part] - start) // CORE
    code = part * (1 << 32) + block
    first = np.flatnonzero(np.diff(code, prepend=-1))
    core = anchor[part[first]] - CORE * block[first]
    met = equal_runs(h, core, length - CORE + 1)
    # Equal windows have equal cores: the windows of some classes of cores are sorted at a time.
    each = np.diff(first, append=len(code))
    by = np.argsort(met, kind="stable")
    by = by[np.searchsorted(met[by], 0) :]
    dup = np.zeros(len(start), bool)
    many = np.cumsum(each[by])
    fresh = np.flatnonzero(np.diff(met[by], prepend=-1))
    cut_at = fresh[np.flatnonzero(np.diff(many[fresh] // LIVE, prepend=-1))] if len(fresh) else fresh
    for a, b in zip(cut_at.tolist(), [*cut_at[1:].tolist(), len(by)]):
        n = each[by[a:b]]
        live = np.repeat(first[by[a:b]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        dup[live] = equal_runs(h, start[live], length) >= 0
    return np.split(dup, np.cumsum(n_win)[:-1])


def solved(batches, length: int, kind: np.dtype):
    """Frames ``(k, th, a, b)`` of the segments of ``batches``, whose anchors come one after another."""

    def solve(held):
        flags = sort_segments([(r[6], r[5]) for r in held], length, kind)
        out = []
        for r, f in zip(held, flags):
            if r[4] == 1 and f.any():
                edge = np.flatnonzero(np.diff(np.concatenate([[False], f, [False]]).astype(np.int8)))
                out += [(r[1], r[2], r[3] + a, r[3] + b - 1) for a, b in zip(edge[0::2].tolist(), edge[1::2].tolist())]
        return pd.DataFrame(out, columns=["k", "th", "a", "b"])

    held, size = [], 0
    for pdf in batches:
        for r in pdf[["ah", "k", "th", "lo", "n", "off", "body"]].itertuples(index=False, name=None):
            if size >= SORT_BYTES and held[-1][0] != r[0]:
                yield solve(held)
                held, size = [], 0
            held.append(r)
            size += len(r[6])
    if held:
        yield solve(held)
    Hashes.forget(CHUNK)


def sorted_windows(parts: DataFrame, length: int, kind: np.dtype) -> DataFrame:
    """``(k, th, a, b)``: runs of repeated windows of the segments that are not repeated whole."""
    spark = parts.sparkSession
    small_batches(spark, 2000)

    def run(batches):
        return solved(batches, length, kind)

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))  # dealt evenly: a byte costs more here than in a shuffle
    return parts.repartition(n, "ah").sortWithinPartitions("ah").mapInPandas(lean(run), "k long, th long, a long, b long")


def hot_windows(parts: DataFrame, length: int, kind: np.dtype) -> DataFrame:
    """As :func:`sorted_windows` for hot anchors: windows are counted by 128 bits of their digest."""
    wide = kind.itemsize

    def run(batches):
        digest = hashlib.blake2b
        for pdf in batches:
            for k, th, lo, n, body in pdf[["k", "th", "lo", "n", "body"]].itertuples(index=False, name=None):
                view = memoryview(body)
                got = np.frombuffer(b"".join([digest(view[a : a + length * wide], digest_size=16).digest() for a in range(0, len(body) - length * wide + 1, wide)]), np.int64)
                yield pd.DataFrame({"w1": got[0::2], "w2": got[1::2], "k": k, "th": th, "a": lo + np.arange(len(got) // 2), "n": n})

    each = hold(parts.mapInPandas(lean(run), "w1 long, w2 long, k long, th long, a long, n long"))
    twice = each.groupBy("w1", "w2").agg(F.sum("n").alias("m")).filter("m > 1")
    return each.filter("n = 1").join(twice, ["w1", "w2"], "left_semi").select("k", "th", "a", F.col("a").alias("b"))


def dedup(docs: DataFrame, length: int = LENGTH, gram: int | None = None, hot: int = HOT, key: str = "doc_id", text: str = "text", keep_text: bool = False, words: int | None = None, aside: bool = False) -> DataFrame:
    """``(key, n_bytes, n_removed, n_spans, kept_sha256, spans)`` for every row, ``spans`` the removed
    ``[from, to)`` as longs in bytes; with ``words``, strings of that many words go too; with ``keep_text`` also ``row`` (the document's other columns, after one named ``_``) and ``kept_text``.

    ``kept_text`` is the remaining bytes with what is no longer whole UTF-8 left out. With ``aside``, strings of
    ``words`` words don't go from these columns; ``n_passage_bytes``, the bytes that only they cover, and ``text``, what
    is left without either kind, follow."""
    if aside and not words:
        raise ValueError("aside needs words")
    spark = docs.sparkSession
    gram = gram or max(8, length // 4)
    small_batches(spark)
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t")
    rows = docs.select(key_column(key).alias("k"), whole).withColumn("th", F.xxhash64("t"))
    with scratch(spark):
        small_batches(spark)
        flags = _flags(rows, length, gram, hot, BYTES)
    if words:
        with scratch(spark):
            small_batches(spark)
            flags = flags.join(_flags(rows, words, max(4, words // 4), hot, WORDS).withColumnRenamed("runs", "word_runs"), ["k", "th"], "full")
    others = [F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in docs.columns if c != text]]
    carry = [F.struct(*others).alias("row")] if keep_text else []
    whole_rows = docs.select(key_column(key).alias("k"), whole, *carry).withColumn("th", F.xxhash64("t"))

    def apply(batches):
        for pdf in batches:
            out = []
            word_runs = pdf["word_runs"] if words else [None] * len(pdf)
            for t, runs, by_word in zip(pdf["t"], pdf["runs"], word_runs):
                raw = t.encode()
                by_byte, by_word = covered(runs, length), worded(raw, by_word, words)
                spans = merge(by_byte if aside else by_byte + by_word)
                left = without(raw, spans)
                rest = without(raw, merge(by_byte + by_word)) if aside and by_word else left
                out.append((len(raw), len(raw) - len(left), len(spans), hashlib.sha256(left).hexdigest(), [x for s in spans for x in s], left, rest))
            cols = list(zip(*out)) if out else [[]] * 7
            frame = {"k": pdf["k"], "n_bytes": cols[0], "n_removed": cols[1], "n_spans": cols[2], "kept_sha256": cols[3], "spans": list(cols[4])}
            if keep_text:
                frame |= {"row": pdf["row"], "kept_text": [x.decode("utf-8", "ignore") for x in cols[5]]}
            if aside:
                frame |= {"n_passage_bytes": [len(a) - len(b) for a, b in zip(cols[5], cols[6])], "text": [x.decode("utf-8", "ignore") for x in cols[6]]}
            yield pd.DataFrame(frame)

    schema = "k long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>"
    if keep_text:
        schema += f", row {whole_rows.schema['row'].dataType.simpleString()}, kept_text string"
    if aside:
        schema += ", n_passage_bytes long, text string"
    out = whole_rows.join(flags, ["k", "th"], "left").drop("th").mapInPandas(lean(apply), schema)
    return null_key(out, key)


def _flags(rows: DataFrame, length: int, gram: int, hot: int, kind: np.dtype) -> DataFrame:
    """``(k, th, runs)``: runs of repeated windows of each text that has any."""
    spark = rows.sparkSession
    found = hold(anchored(rows, length, gram, kind))
    # Any segment of a kind stands for it: first values are of one row, and need no sort as a least struct does.
    kinds = found.groupBy("ah", "cx").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("k", "th", "lo")])
    many = kinds.groupBy("ah").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).filter("total > 1")
    known = cut(kinds.join(many, "ah").select("ah", "cx", "n", "kinds", "k", "th", "lo"), "substring-kinds")
    wanted = known.filter("kinds > 1").select("ah", "cx", "k", "th", "lo", "n", (F.col("kinds") > hot).alias("hot"))
    small_batches(spark)
    parts = cut(cut_segments(rows, wanted, length, gram, kind), "substring-segments")
    let_go(spark)
    lone = sorted_windows(parts.filter("not hot"), length, kind)
    if not parts.filter("hot").isEmpty():
        lone = lone.unionByName(hot_windows(parts.filter("hot"), length, kind))
    whole = found.join(known.filter("n > 1").select("ah", "cx"), ["ah", "cx"], "left_semi").select("k", "th", F.col("lo").alias("a"), F.col("hi").alias("b"))
    # Copies of a text under one key, the null key above all, bring the same runs.
    flags = lone.unionByName(whole).distinct().groupBy("k", "th").agg(F.collect_list(F.struct("a", "b")).alias("runs"))
    return cut(flags, "substring-flags", keep=True)


def covered(runs, length: int) -> list[tuple[int, int]]:
    """Ranges covered by windows of ``length`` that start in ``runs`` of ``(a, b)``."""
    return [] if runs is None else [(r["a"], r["b"] + length) for r in runs]


def worded(raw: bytes, runs, length: int | None) -> list[tuple[int, int]]:
    """As :func:`covered` for windows of words, in bytes of ``raw``."""
    if runs is None or not len(runs):
        return []
    lo, hi = word_edges(raw)
    return [(int(lo[a]), int(hi[b - 1])) for a, b in covered(runs, length)]


def merge(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal byte runs covered by ``pairs`` of ``(from, to)``."""
    out: list[list[int]] = []
    for a, b in sorted(pairs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(int(a), int(b)) for a, b in out]


def without(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    """What ``spans``, in order and apart, leave of ``raw``."""
    kept, at = [], 0
    for a, b in spans:
        kept.append(raw[at:a])
        at = b
    kept.append(raw[at:])
    return b"".join(kept)


def query(spark, sf_dir: str) -> DataFrame:
    """op2: every document's repeated strings removed; beside them, passages that repeat and have fewer bytes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = dedup(docs, words=PASSAGE_WORDS, aside=True)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_bytes", "text")
