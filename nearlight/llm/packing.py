"""Variable-capacity best-fit packing of documents into training sequences.

A document's length is its ids of the given tokenizer and one end id (without a tokenizer, its UTF-8
bytes and one). Documents longer than the largest sequence fill whole sequences; their rest is packed
like another document. Pieces are dealt evenly, whatever their keys, to tasks of bounded size, and each
task packs by itself: pieces in descending length go to the open bin with the least room that still
holds them; where none does, the bin size of least cost is opened, and at the end each bin shrinks
to the smallest permitted length that holds its contents.

A sequence of ``c`` ids costs ``c + c * c / ATTENTION + OVERHEAD``: padding and length compete with
the price of one more sequence. A size's cost is taken for each id that a bin of it would hold:
the piece and what a look-ahead over the remaining lengths puts beside it, the longest first. All
sizes are tried with the same remaining lengths, so the choice is a joint one.

Defined cases: a null or empty text is one end id; null keys stay null; repeated rows are packed
each; equal lengths go by key; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearlight.llm.common import chunks, cut, key_column, lean, null_key, scratch, ship, small_batches
from nearlight.llm.wavelet import encoder

SIZES = (512, 1024, 2048, 4096, 8192)
OVERHEAD = 256  # of a sequence, in ids
ATTENTION = 16_384  # ids of a sequence whose attention costs as much as the rest
TASK_ROWS = 50_000


def cost(c: int, overhead: int = OVERHEAD, attention: int = ATTENTION) -> float:
    return c + c * c / attention + overhead


def fill(room: int, after: list[int], at: int) -> int:
    """What the remaining lengths put into ``room``: the longest that fits, until none does.
    ``after`` holds all lengths in ascending order, those below ``at`` remaining. It looks at as many pieces as
    the room takes, so all looks of a task together cost a small multiple of its pieces."""
    got = 0
    while (at := bisect_left(after, room - got + 1, 0, at) - 1) >= 0:
        got += after[at]
    return got


def pack(lengths: list[int], sizes: tuple[int, ...] = SIZES, overhead: int = OVERHEAD, attention: int = ATTENTION) -> tuple[list[int], list[int], list[int]]:
    """Best-fit decreasing over several bin sizes jointly.

    ``lengths`` must be in descending order and at most ``max(sizes)``. Returns each piece's bin
    and offset, and each bin's final capacity."""
    sizes = tuple(sorted(sizes))
    price = {c: cost(c, overhead, attention) for c in sizes}
    after = lengths[::-1]
    rooms: list[tuple[int, int]] = []  # (room, bin), ascending
    used: list[int] = []
    bins, offs = [], []
    for done, n in enumerate(lengths, 1):
        i = bisect_left(rooms, (n, -1))
        if i < len(rooms):
            room, b = rooms.pop(i)
        else:
            left = len(lengths) - done
            c = min((c for c in sizes if c >= n), key=lambda c: (price[c] / (n + fill(c - n, after, left)), c))
            b, room = len(used), c
            used.append(0)
        bins.append(b)
        offs.append(used[b])
        used[b] += n
        if room > n:
            insort(rooms, (room - n, b))
    final = [sizes[bisect_left(sizes, u)] for u in used]
    return bins, offs, final


def lengths(docs: DataFrame, tokenizer: str | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(k, n)``: every document's ids with its end id; null keys are ``NO_KEY``."""
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    if tokenizer is None:
        return docs.select(key_column(key).alias("k"), (F.octet_length(t).cast("long") + 1).alias("n"))

    def run(batches):
        enc = encoder(tokenizer)
        for pdf in batches:
            texts = pdf["t"].tolist()
            for i, j in chunks(texts, 1 << 19):
                yield pd.DataFrame({"k": pdf["k"].iloc[i:j], "n": enc.encode(texts[i:j])[1]})

    return docs.select(key_column(key).alias("k"), t.alias("t")).mapInPandas(lean(run), "k long, n long")


def pieces(found: DataFrame, top: int) -> DataFrame:
    """``(k, piece, length)``: whole sequences of ``top`` first, then the rest."""
    spans = F.expr(f"transform(sequence(0L, (n - 1) div {top}L), i -> named_struct('piece', i, 'length', least({top}L, n - i * {top}L)))")
    return found.select("k", F.inline(spans))


def pack_documents(
    docs: DataFrame, tokenizer: str | None = None, sizes: tuple[int, ...] = SIZES, overhead: int = OVERHEAD, attention: int = ATTENTION, task_rows: int = TASK_ROWS,
    key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """One row per piece: key, piece, length, bin, capacity and offset in the bin."""
    spark = docs.sparkSession
    ship(spark)
    with scratch(spark):
        small_batches(spark)
        parts = cut(pieces(lengths(docs, tokenizer, key, text), max(sizes)), "packing-pieces", keep=True)
        n_tasks = max(1, -(-parts.count() // task_rows))

    def run(batches):
        from pyspark import TaskContext

        held = [x for x in batches if len(x)]
        if not held:
            return
        pdf = pd.concat(held).sort_values(["length", "k", "piece"], ascending=[False, True, True], kind="stable")
        bins, offs, caps = pack(pdf["length"].tolist(), sizes, overhead, attention)
        part = TaskContext.get().partitionId()
        yield pd.DataFrame({"k": pdf["k"], "piece": pdf["piece"], "length": pdf["length"], "bin": [f"{part}-{x}" for x in bins], "capacity": [caps[x] for x in bins], "off": offs})

    # Rows go round the tasks: no key, the null one neither, makes a task larger than the others.
    return null_key(parts.repartition(n_tasks).mapInPandas(lean(run), "k long, piece long, length long, bin string, capacity long, off long"), key)


def query(spark, sf_dir: str) -> DataFrame:
    """op4: every document's pieces with their bin, its capacity and their offset."""
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
