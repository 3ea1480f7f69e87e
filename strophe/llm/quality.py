"""Quality classifier by importance resampling.

Two generative models of hashed n-grams are fitted, one to target text (rows
labelled good), one to raw text (all rows). The mean log of their ratio over a
document's n-grams, for a passage of ``PASSAGE`` of them, is its log weight;
adding Gumbel noise and taking the k largest samples k documents without
replacement in proportion to the weights. (A mean, as over whole texts the sums
differ by so much that the longest would win whatever the noise.)

N-grams are those of the words (without case) and those of the words' shapes
(case, digits, which punctuation, repeats of the word before), one and two
long. Counting and scoring stream over Arrow batches; what is gathered from
the corpus is one sparse vector of counts per task, added up part by part. The
number of buckets grows with the corpus as its vocabulary does (with the square
root of its size), up to ``MOST_BUCKETS``, which bounds what is broadcast (8 MB).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strophe.llm.common import Tables, ship, small_batches

#: Buckets of the hashed n-grams (the first half for words, the second for shapes): a power of two near so many times the root of the bytes.
BUCKETS, MOST_BUCKETS, PER_ROOT = 1 << 14, 1 << 20, 24
#: Parts of a vector of counts that are added up on their own.
PARTS = 64
#: Share of the raw model that is mixed into the target model, so that n-grams the sample lacks are rare there, not absent; n-grams of a passage.
SMOOTH, PASSAGE = 0.1, 32
BLANK, LETTER, CAPITAL, DIGIT, MARK = range(5)


def byte_classes() -> np.ndarray:
    kinds = np.full(256, MARK, np.uint8)
    kinds[[32, *range(9, 14)]] = BLANK
    kinds[list(range(97, 123)) + list(range(128, 256))] = LETTER
    kinds[list(range(65, 91))] = CAPITAL
    kinds[list(range(48, 58))] = DIGIT
    return kinds


CLASSES = byte_classes()
FOLDED = np.arange(256, dtype=np.uint64) + np.uint64(1)
FOLDED[65:91] += np.uint64(32)
PRIME = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x * PRIME
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(20)


def features(texts: list[bytes], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each n-gram of the texts, and the text that each belongs to."""
    half = np.uint64(buckets // 2)
    data = np.frombuffer(b"\x00".join([*texts, b""]), np.uint8)
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    kind = CLASSES[data]
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    kind[ends] = BLANK
    group = np.where(kind == MARK, np.uint8(2), (kind != BLANK).astype(np.uint8))
    first = group != np.concatenate(([0], group[:-1]))
    start = np.flatnonzero(first & (group > 0))
    if not len(start):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    edge = np.append(np.flatnonzero(first), len(data))
    stop = edge[np.searchsorted(edge, start, "right")]
    size = stop - start
    owner = np.searchsorted(ends, start, "left")
    # a token's hash: its bytes times powers of an odd number by their place in it
    place = np.arange(len(data)) - np.repeat(edge[:-1], np.diff(edge)) if edge[0] == 0 else np.arange(len(data)) - np.concatenate((np.arange(edge[0]), np.repeat(edge[:-1], np.diff(edge))))
    power = np.cumprod(np.concatenate(([np.uint64(1)], np.full(min(int(size.max()), 64) - 1, PRIME, np.uint64))), dtype=np.uint64)
    # places past the table take its values again, so each byte of a long token still counts
    weighed = np.where(group > 0, FOLDED[data] * power[place % len(power)], np.uint64(0))
    total = np.add.reduceat(weighed, edge[:-1])
    word = mixed(total[np.searchsorted(edge, start)] + size.astype(np.uint64))
    capitals = np.add.reduceat((kind == CAPITAL).astype(np.int32), edge[:-1])[np.searchsorted(edge, start)]
    digits = np.add.reduceat((kind == DIGIT).astype(np.int32), edge[:-1])[np.searchsorted(edge, start)]
    mark = group[start] == 2
    same = np.zeros(len(word), bool)
    if len(word) > 1:
        same[1:] = (word[1:] == word[:-1]) & (owner[1:] == owner[:-1])
        gap = (word[2:] == word[:-2]) & (owner[2:] == owner[:-2]) & ~mark[2:]
        same[2:] |= gap & mark[1:-1]
    case = np.select([digits > 0, (capitals >= 2) & (capitals * 2 > size), (capitals >= 1) & (kind[start] == CAPITAL), capitals > 0], [4, 3, 2, 5], 1).astype(np.uint64)
    shape = np.where(mark, word | np.uint64(64), case + np.uint64(8) * same.astype(np.uint64))
    pair = owner[1:] == owner[:-1]
    grams = [word, mixed(word[:-1] * np.uint64(31) + word[1:])[pair]]
    shapes = [mixed(shape + np.uint64(7)), mixed(mixed(shape[:-1]) + np.uint64(3) * shape[1:])[pair]]
    ids = np.concatenate([*(g % half for g in grams), *(half + s % half for s in shapes)]).astype(np.int64)
    docs = np.concatenate([owner, owner[1:][pair]] * 2)
    return ids, docs


def encoded(column: pa.Array) -> list[bytes]:
    return [(t or "").encode() for t in column.to_pylist()]


def slices(batch: pa.RecordBatch, limit: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most ``limit`` characters, one row at least."""
    lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column("text")), 0).to_numpy()
    at, held = 0, 0
    for k, n in enumerate(lengths):
        if k > at and held + n > limit:
            yield batch.slice(at, k - at)
            at, held = k, 0
        held += n
    if at < batch.num_rows:
        yield batch.slice(at)


def fit_sample(labels: DataFrame, sample: int) -> DataFrame:
    """``(doc_id, good, test)`` of at most ``sample`` labelled ids, in hash order.

    Ids labelled both ways, and null labels or ids, are left out. ``test`` marks
    the half that is not fitted but used to set the cut.
    """
    one = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("a"), F.max("quality").alias("b")).where("a = b")
    return one.select("doc_id", (F.col("a") > 0).alias("good"), (F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(2)) == 0).alias("test")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)


def bucket_count(docs: DataFrame) -> int:
    """Buckets for the corpus: a power of two near ``PER_ROOT`` times the root of its bytes."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(MOST_BUCKETS, max(BUCKETS, 1 << round(math.log2(PER_ROOT * math.sqrt(max(1, size))))))


def fit(docs: DataFrame, labels: DataFrame, sample: int = 20_000, buckets: int | None = None, smooth: float = SMOOTH) -> np.ndarray:
    """Log ratio of target and raw model for each bucket. All rows count in the raw model.

    ``sample`` bounds the labelled rows, and so what is broadcast. Without
    labelled good rows the ratio is 0.
    """
    known = fit_sample(labels, sample)
    buckets = buckets or bucket_count(docs)
    width = buckets // PARTS
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id", "left").select("text", F.coalesce(F.col("good") & ~F.col("test"), F.lit(False)).alias("target"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets), np.zeros(buckets)
        for whole in batches:
            for batch in slices(whole):
                ids, owner = features(encoded(batch.column("text")), buckets)
                raw += np.bincount(ids, minlength=buckets)
                good = batch.column("target").to_numpy(zero_copy_only=False).astype(bool)
                if good.any():
                    target += np.bincount(ids[good[owner]], minlength=buckets)
        used = np.flatnonzero(raw)
        ends = pa.array(np.searchsorted(used, np.arange(PARTS + 1) * width), pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int64))) for x in (used % width, raw[used], target[used])]
        yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), *lists], names=["part", "place", "raw", "target"])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, part in enumerate(batch.column("part").to_pylist()):
                at, *counts = (batch.column(c)[k].values.to_numpy() for c in ("place", "raw", "target"))
                total = sums.setdefault(part, np.zeros((2, width), np.int64))
                total[:, at] += np.stack(counts)
        dense = [pa.array([v[r] for v in sums.values()], pa.list_(pa.int64())) for r in (0, 1)]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), *dense], names=["part", "raw", "target"])

    with small_batches(docs.sparkSession):
        parts = rows.mapInArrow(count, "part int, place array<long>, raw array<long>, target array<long>").repartition("part").mapInArrow(add_up, "part int, raw array<long>, target array<long>").toArrow()
    raw, target = np.ones(buckets), np.zeros(buckets)
    for part, r, t in zip(parts["part"].to_pylist(), parts["raw"], parts["target"], strict=True):
        here = slice(part * width, (part + 1) * width)
        raw[here] += r.values.to_numpy()
        target[here] += t.values.to_numpy()
    if not target.any():
        return np.zeros(buckets)
    ratio = np.empty(buckets)
    for half in (slice(0, buckets // 2), slice(buckets // 2, buckets)):
        r = raw[half] / raw[half].sum()
        ratio[half] = np.log((target[half] / max(target[half].sum(), 1.0) + smooth * r) / (1 + smooth)) - np.log(r)
    return ratio


def score(docs: DataFrame, ratio: np.ndarray, passage: int = PASSAGE, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys..., log_ratio`` for each row: ``passage`` times the mean over its n-grams; 0 for texts without words."""
    buckets = len(ratio)
    held = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                ids, owner = features(encoded(batch.column("text")), buckets)
                n = np.bincount(owner, minlength=batch.num_rows)
                z = np.bincount(owner, held.value[ids], minlength=batch.num_rows) * passage / np.maximum(n, 1)
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(np.round(z, 6))], names=[*keys, "log_ratio"])

    kinds = ", ".join(f"{k} {docs.schema[k].dataType.simpleString()}" for k in keys)
    return docs.select(*keys, "text").mapInArrow(run, f"{kinds}, log_ratio double")


def cut(scored: DataFrame, labels: DataFrame, sample: int, share_kept: float = 0.999) -> float:
    """The log ratio from which on documents look like the target.

    Of the rows held out from the fit, good and bad, the fewest are on the
    wrong side of it; of equal cuts the lowest, half way down to the next
    row. So wrong labels hardly move it while they are fewer than the bad
    rows. Without bad rows: all but ``1 - share_kept`` of the good ones are
    above it. Without good rows: no cut.
    """
    known = fit_sample(labels, sample).where("test").select("doc_id", "good")
    got = scored.join(F.broadcast(known), "doc_id").select("log_ratio", "good").orderBy(F.xxhash64("doc_id"), "log_ratio").limit(sample).toPandas().sort_values("log_ratio")
    is_good = got["good"].to_numpy(bool)
    z = got["log_ratio"].to_numpy()
    good, bad = z[is_good], z[~is_good]
    if not len(good):
        return float("-inf")
    if not len(bad):
        return float(good[int(len(good) * (1 - share_kept))])
    wrong = np.searchsorted(good, z, "left") + len(bad) - np.searchsorted(bad, z, "left")
    at = int(np.argmin(wrong))
    return float((z[at] + z[max(0, at - 1)]) / 2)


def kth_largest(df: DataFrame, column: str, k: int) -> int | None:
    """The k-th largest value of a long column, exactly, by counting 16 bits at a time.

    Each round gathers at most 65,536 counts; the rows stay where they are.
    """
    shifted = df.select(F.col(column).bitwiseXOR(F.lit(-(1 << 63))).alias("v"))
    found, left = 0, k
    for round_ in range(4):
        bits = 48 - 16 * round_
        here = shifted if round_ == 0 else shifted.where(F.shiftrightunsigned("v", bits + 16) == F.lit(found))
        counts = here.groupBy(F.shiftrightunsigned("v", bits).bitwiseAND(F.lit(0xFFFF)).alias("d")).count().collect()
        for d, n in sorted(((r.d, r["count"]) for r in counts), reverse=True):
            if left <= n:
                found = (found << 16) | d
                break
            left -= n
        else:
            return None
    value = found ^ (1 << 63)
    return value - (1 << 64) if value >= 1 << 63 else value


def gumbel_top_k(weighted: DataFrame, k: int, seed: int, tables: Tables) -> DataFrame:
    """``weighted`` (``doc_id, log_ratio``) with ``key`` and ``selected``: k rows drawn without replacement in proportion to the weights.

    ``key`` is the log weight plus Gumbel noise from a hash of the id; the k
    largest are selected, and rows that tie with the k-th.
    """
    noise = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    keyed = tables.write(weighted.withColumn("key", F.col("log_ratio") - F.log(-F.log(noise))).withColumn("_key", F.round(F.col("key") * 1e6).cast("long")))
    least = kth_largest(keyed, "_key", k) if k > 0 else None
    chosen = F.lit(k > 0) if least is None else F.col("_key") >= F.lit(least)
    return keyed.withColumn("selected", chosen).drop("_key")


def select(docs: DataFrame, labels: DataFrame, keep: float | None = None, sample: int = 20_000, buckets: int | None = None, seed: int = 17, carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, log_ratio, key, selected`` for each row of ``docs``, and its columns ``carry`` (such as a row's own number).

    ``keep`` is how many rows are drawn (a whole number) or which share of
    them (a fraction below 1); without it, as many as look like the target
    (see ``cut``). Null and empty texts weigh 1 (log 0); a repeated id draws
    the same noise each time. Without labels all weigh the same, and without
    ``keep`` all are selected. No rows in, no rows out.
    """
    tables = Tables(docs.sparkSession, "quality")
    scored = tables.write(score(docs, fit(docs, labels, sample, buckets), keys=("doc_id", *carry)))
    if keep is None:
        k = scored.where(F.col("log_ratio") >= cut(scored, labels, sample)).count()
    else:
        k = round(keep * scored.count()) if 0 < keep < 1 else int(keep)
    return gumbel_top_k(scored, k, seed, tables)


ship(__name__)
