"""Variable-capacity best-fit packing.

Documents are cut into pieces of at most the longest permitted length and
packed block by block: largest pieces first, each into the open bin that it
leaves fullest. When no bin fits, a bin of the least cost is opened: the price
of its length less the worth of the room that smaller pieces can still use. The
lengths are optimised jointly through that worth: it is the rate at which one
of the permitted lengths houses words when full, each rate is tried in turn,
bins are shrunk to the least-cost length that holds their contents, and the
cheapest outcome wins.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strophe.llm.common import WORD, Tables, ship

#: Permitted sequence lengths and their cost: a fixed share for a sequence, its slots, and attention.
LENGTHS = (512, 1024, 2048, 4096)


def cost(length: int) -> float:
    """Of a sequence of this length, whatever it holds."""
    return 16.0 + length + length * length / 65536


def best_fit(sizes: Sequence[int], lengths: Sequence[int], price=cost) -> tuple[list[int], list[int]]:
    """Bin of each size, and length of each bin. Sizes are 1 to the longest length.

    Ties go to the earlier size, the bin opened first, the shorter length and
    the lower worth; same input, same output.
    """
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    steps = sorted(lengths)
    prices = [price(x) for x in steps]
    shrunk = lambda held: min((p, x) for p, x in zip(prices, steps, strict=True) if x >= held)
    best = None
    for worth in sorted({0.0, *(p / x for p, x in zip(prices, steps, strict=True))}):
        free: list[tuple[int, int]] = []
        filled, place, rest = [], [0] * len(sizes), sum(sizes)
        for i in order:
            s = sizes[i]
            rest -= s
            k = bisect_left(free, (s, -1))
            if k < len(free):
                room, b = free.pop(k)
            else:
                # what the pieces to come can't fill is worth nothing
                _, room = min((p - worth * min(x - s, rest), x) for p, x in zip(prices, steps, strict=True) if x >= s)
                b = len(filled)
                filled.append(0)
            filled[b] += s
            place[i] = b
            if room > s:
                insort(free, (room - s, b))
        sized = [shrunk(f) for f in filled]
        total = sum(p for p, _ in sized)
        if best is None or total < best[0]:
            best = (total, place, [x for _, x in sized])
    return (best[1], best[2]) if best else ([], [])


def dealt(rows: DataFrame, longest: int, block: int) -> DataFrame:
    """``doc_id, n_words, g, o``: rows dealt to groups of about ``block`` pieces by their hash.

    The number of groups depends on the rows alone, so bins don't depend on
    the cluster. Rows alike in id and size are counted, then told apart by
    number, so that very many of them don't meet in one group.
    """
    alike = Tables(rows.sparkSession, "packing").write(rows.groupBy("doc_id", "n_words").agg(F.count(F.lit(1)).alias("c")))
    pieces = alike.agg(F.sum(F.col("c") * F.greatest(F.ceil(F.col("n_words") / longest), F.lit(1)))).first()[0] or 0
    one = alike.select("doc_id", "n_words", F.explode(F.sequence(F.lit(1).cast("long"), "c")).alias("o"))
    return one.withColumn("g", F.pmod(F.xxhash64("doc_id", "n_words", "o"), F.lit(max(1, -(-pieces // block)))))


def pack(docs: DataFrame, lengths: Sequence[int] = LENGTHS, block: int = 8192, id_col: str = "doc_id", text_col: str | None = "text", size_col: str | None = None, group_col: str | None = None, order_col: str | None = None) -> DataFrame:
    """``bin_id, seq_len, slot, doc_id, piece, start, n_words`` for each piece.

    Sizes are words of ``text_col``, or ``size_col`` if given. A document of
    more than the longest length gives several pieces that cover it whole, by
    ``start`` and ``n_words``. A document without words (null text too) gives
    one row with null bin, piece 0 and size 0. ``block``: pieces that are
    packed together, twice as many at most, which bounds memory. Repeated rows
    are packed as often as they stand. With ``group_col`` and ``order_col``
    (longs, not null) the groups, such as files of range-sorted input, are
    packed one by one in that order; otherwise rows are dealt by hash and
    sorted by id. Bins are numbered by group. Reruns agree, with any number of
    partitions.
    """
    size = F.col(size_col) if size_col else F.regexp_count(F.col(text_col), F.lit(WORD))
    longest, lengths = max(lengths), tuple(lengths)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(size, F.lit(0)).cast("long").alias("n_words"), *((F.col(group_col).alias("g"), F.col(order_col).alias("o")) if group_col else ()))
    most = block if group_col else 2 * block
    order = ("o", "doc_id", "n_words") if group_col else ("doc_id", "n_words", "o")
    rows = (rows if group_col else dealt(rows, longest, block)).repartition("g").sortWithinPartitions("g", *order).select("doc_id", "n_words", "g")
    schema = "bin_id long, seq_len int, slot int, doc_id long, piece int, start long, n_words long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [("bin_id", pa.int64()), ("seq_len", pa.int32()), ("slot", pa.int32()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("n_words", pa.int64())]
        base, opened, group = 0, 0, None
        pieces: list[tuple] = []

        def frame(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out, strict=True), kinds, strict=True)], names=[n for n, _ in kinds])

        def flush() -> pa.RecordBatch:
            nonlocal opened
            place, sized = best_fit([p[3] for p in pieces], lengths)
            slots: dict[int, int] = {}
            out = []
            for p, b in zip(pieces, place, strict=True):
                slots[b] = slots.get(b, -1) + 1
                out.append((base + opened + b, sized[b], slots[b], *p))
            opened += len(sized)
            pieces.clear()
            return frame(out)

        for batch in batches:
            empty = []
            for d, n, g in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if g != group:
                    if pieces:
                        yield flush()
                    base, opened, group = g << 32, 0, g
                if n <= 0:
                    empty.append((None, None, None, d, 0, 0, 0))
                for k, at in enumerate(range(0, max(n, 0), longest)):
                    pieces.append((d, k, at, min(longest, n - at)))
                    if len(pieces) >= most:
                        yield flush()
            if empty:
                yield frame(empty)
        if pieces:
            yield flush()

    return rows.mapInArrow(run, schema)


ship(__name__)
