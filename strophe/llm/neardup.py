"""MinHash near-duplicates by a multi-index Hamming join.

Each distinct shingle set gets a signature of ``POSITIONS`` b-bit minima. The
signature is split into ``CHUNKS`` chunks; by the pigeonhole principle two
signatures that differ in at most ``2 * CHUNKS - 1`` positions agree in some
chunk but for one position. So the chunks, each with one position left out in
turn, are the keys of an index that meets every pair within that distance. For
similar pairs at the limit of 0.8 the distance exceeds it about once in ten
thousand.

Buckets of the index are never expanded into pairs. Each bucket's smallest
member is compared with the others and the links are confirmed on the full
sets; buckets whose members are then in one component are done. The others
draw a further leader, and what is still apart is compared on signatures: in
one task for a bucket of at most ``CROWDED`` members, and for larger ones, and
all that hang together with them, block by block in many tasks, so the
guarantee holds for buckets of any size and none is gathered. From there come
only the edges of a forest over signatures within the guaranteed distance,
whose trees are clusters that may hold more links. In each cluster the
documents outside its largest component meet all others block by block, on the
full sets, and again only links that join components come out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strophe.llm.common import Tables, components, ordered, ship, text_parts

#: Minima per signature, bits of each, chunks, and the distance above which a leader's pair isn't confirmed.
POSITIONS, BITS, CHUNKS, FAR = 65, 16, 13, 32
#: The distance within which every pair meets in the index.
REACH = 2 * CHUNKS - 1
#: Members above which a bucket is compared block by block; further leaders before comparing.
CROWDED, LEADERS = 4096, 1
#: Documents of a block: for full sets, and for signatures.
BLOCK, SIGNATURE_BLOCK = 256, 2048

BLANK = np.zeros(256, bool)
BLANK[[32, *range(9, 14)]] = True
FOLDED = np.arange(256, dtype=np.uint64) + np.uint64(1)
FOLDED[65:91] += np.uint64(32)
STEP = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate(([np.uint64(1)], np.full(n - 1, STEP, np.uint64))), dtype=np.uint64)


def word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of each word; ``ends`` are the places of the blank after each document."""
    blank = BLANK[data]
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    edge = np.concatenate(([0], edge)) if len(data) else edge
    size = np.diff(np.append(edge, len(data)))
    place = np.arange(len(data)) - np.repeat(edge, size)
    weighed = FOLDED[data] * powers(max(1, int(size.max(initial=1))))[place]
    total = np.add.reduceat(weighed, edge) if len(edge) else np.empty(0, np.uint64)
    is_word = ~blank[edge]
    return mixed(total[is_word] + size[is_word].astype(np.uint64)), np.searchsorted(ends, edge[is_word], "left")


def shingle_sets(data: np.ndarray, sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, one after the other, and their number.

    ``data`` holds the texts one after the other. A text of fewer than ``k``
    words has one shingle, all its words; one without words has none.
    """
    ends = np.cumsum(sizes + 1) - 1
    spread = np.full(int(sizes.sum()) + len(sizes), 32, np.uint8)
    keep = np.ones(len(spread), bool)
    keep[ends] = False
    spread[keep] = data
    words, owner = word_hashes(spread, ends)
    count = np.bincount(owner, minlength=len(sizes))
    start = np.cumsum(count) - count
    full = len(words) - k + 1
    h, d = np.empty(0, np.uint64), np.empty(0, np.int64)
    if full > 0:
        inside = owner[:full] == owner[k - 1:]
        h = words[:full]
        for j in range(1, k):
            h = mixed(h * STEP + words[j:full + j])
        h, d = h[inside], owner[:full][inside]
    for x in np.flatnonzero((count > 0) & (count < k)):
        part = words[start[x]:start[x] + count[x]]
        one = part[:1]
        for j in range(1, len(part)):
            one = mixed(one * STEP + part[j:j + 1])
        h, d = np.append(h, mixed(one + np.uint64(count[x]))), np.append(d, x)
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    if len(h):
        fresh = np.append(True, (h[1:] != h[:-1]) | (d[1:] != d[:-1]))
        h, d = h[fresh], d[fresh]
    return h, np.bincount(d, minlength=len(sizes))


def signatures(h: np.ndarray, count: np.ndarray, seed: int) -> np.ndarray:
    """``POSITIONS`` b-bit minima for each document that has shingles."""
    count = count[count > 0]
    at = np.cumsum(count) - count
    salt = mixed(np.arange(1, POSITIONS + 1, dtype=np.uint64) * STEP + np.uint64(seed)) | np.uint64(1)
    out = np.empty((len(count), POSITIONS), np.uint16)
    for p in range(POSITIONS if len(count) else 0):
        out[:, p] = mixed(np.minimum.reduceat(h * salt[p], at)) & np.uint64((1 << BITS) - 1)
    return out


def packed(rows: np.ndarray) -> list[bytes]:
    raw, w = rows.tobytes(), rows.dtype.itemsize * rows.shape[1]
    return [raw[i:i + w] for i in range(0, len(raw), w)]


def sketch(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, sizes in text_parts(batch.column("text"), 1_000_000):
                h, count = shingle_sets(data, sizes, k)
                stop, raw = np.cumsum(count) * 8, h.tobytes()
                sets = [hashlib.md5(raw[e - 8 * n:e]).digest() if n else None for e, n in zip(stop.tolist(), count.tolist(), strict=True)]
                found = iter(packed(signatures(h, count, 1)))
                sigs = [next(found) if n else None for n in count]
                yield pa.RecordBatch.from_arrays([batch.column("uid").slice(at, len(sizes)), pa.array(count.astype(np.int64)), pa.array(sets, pa.binary()), pa.array(sigs, pa.binary())], names=["uid", "n", "set_id", "sig"])

    return run


def full_sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, sizes in text_parts(batch.column("text"), 1_000_000):
                h, count = shingle_sets(data, sizes, k)
                stop, raw = np.cumsum(count) * 8, h.tobytes()
                sets = [raw[e - 8 * n:e] for e, n in zip(stop.tolist(), count.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("uid").slice(at, len(sizes)), pa.array(sets, pa.binary())], names=["uid", "hashes"])

    return run


def stacked(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, POSITIONS)


def index_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each chunk with one position left out, hashed."""
    width = POSITIONS // CHUNKS
    salt = mixed(np.arange(1, POSITIONS + 1, dtype=np.uint64))
    for whole in batches:
        for at in range(0, whole.num_rows, 4096):
            batch = whole.slice(at, 4096)
            sig = stacked(batch.column("sig")).astype(np.uint64)
            keys = []
            for c in range(CHUNKS):
                for out in range(width):
                    key = np.full(len(sig), salt[c * width + out])
                    for j in range(width):
                        if j != out:
                            key = mixed(key * STEP + sig[:, c * width + j])
                    keys.append(key.astype(np.int64))
            ids = np.tile(batch.column("uid").to_numpy(), len(keys))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(ids)], names=["key", "uid"])


def near_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures differ in at most ``FAR`` positions."""
    for batch in batches:
        if batch.num_rows:
            near = (stacked(batch.column("sa")) != stacked(batch.column("sb"))).sum(axis=1) <= FAR
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(near)) for c in ("a", "b")], names=["a", "b"])


def similar(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("ha").to_pylist(), batch.column("hb").to_pylist(), strict=True):
                both = np.concatenate((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)))
                both.sort(kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                ok.append(100 * shared >= percent * (len(both) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(ok, pa.bool_())) for c in ("a", "b")], names=["a", "b"])

    return run


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str], columns: list[str]) -> Iterator[list]:
    """The columns of each group of rows with equal keys; rows come sorted, groups may span batches."""
    key, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.stack([batch.column(c).to_numpy() for c in keys])
        edges = np.append(np.flatnonzero(np.append(True, (k[:, 1:] != k[:, :-1]).any(axis=0))), batch.num_rows)
        for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if (now := tuple(k[:, s].tolist())) != key:
                if held:
                    yield [pa.chunked_array(x) for x in zip(*held, strict=True)]
                key, held = now, []
            held.append([batch.column(c).slice(s, e - s) for c in columns])
    if held:
        yield [pa.chunked_array(x) for x in zip(*held, strict=True)]


def forest(near_rows: Iterator[np.ndarray], n: int) -> np.ndarray:
    """The tree of each of ``n`` nodes, by its smallest node, where row k of ``near_rows`` holds the nodes near node k."""
    label = np.arange(n)
    for k, near in enumerate(near_rows):
        if len(near):
            trees = np.unique(np.append(label[near], label[k]))
            if len(trees) > 1:
                label[np.isin(label, trees)] = trees[0]
    return label


def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A forest over the near pairs from different components in each bucket."""
    for uid, comp, sig in grouped(batches, ["key"], ["uid", "component", "sig"]):
        uid, comp, sig = uid.to_numpy(), comp.to_numpy(), stacked(sig)

        def near(i: int) -> np.ndarray:
            other = np.flatnonzero(comp[i + 1:] != comp[i]) + i + 1
            return other[(sig[other] != sig[i]).sum(axis=1) <= REACH]

        label = forest(map(near, range(len(uid))), len(uid))
        joined = label != np.arange(len(uid))
        yield pa.RecordBatch.from_arrays([pa.array(uid[label[joined]]), pa.array(uid[joined])], names=["a", "b"])


def near_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A forest over the near pairs from different components, of each block of outliers with a block of their cluster."""
    for side, uid, comp, sig in grouped(batches, ["cluster", "i", "j"], ["outlier", "uid", "component", "sig"]):
        order = np.argsort(-side.to_numpy(), kind="stable")  # outliers first
        uid, comp, sig = uid.to_numpy()[order], comp.to_numpy()[order], stacked(sig)[order]
        m = int(side.to_numpy().sum())
        same = np.zeros((m, len(uid) - m), np.uint8)
        for p in range(POSITIONS):
            same += sig[:m, p, None] == sig[None, m:, p]
        near = (same >= POSITIONS - REACH) & (comp[:m, None] != comp[None, m:])
        label = forest((np.flatnonzero(row) + m for row in near), len(uid))
        joined = label != np.arange(len(uid))
        yield pa.RecordBatch.from_arrays([pa.array(uid[label[joined]]), pa.array(uid[joined])], names=["a", "b"])


def link_blocks(percent: int):
    """Links that join components, of each block of outliers with a block of their cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for side, uid, comp, sets in grouped(batches, ["cluster", "i", "j"], ["outlier", "uid", "component", "hashes"]):
            side, uid, comp = side.to_numpy(), uid.to_numpy(), comp.to_numpy()
            rows = [np.frombuffer(x, np.uint64) for x in sets.to_pylist()]
            size = np.array([len(x) for x in rows])
            _, place, times = np.unique(np.concatenate(rows), return_inverse=True, return_counts=True)
            owner = np.repeat(np.arange(len(rows)), size)
            shared = times[place] > 1
            number = np.cumsum(times > 1) - 1
            column, owner = number[place[shared]], owner[shared]
            outliers, others = np.flatnonzero(side == 1), np.flatnonzero(side == 0)
            common = np.zeros((len(outliers), len(others)), np.float64)
            width, last = 16384, int(column.max(initial=-1)) + 1
            for at in range(0, last, width):
                here = (column >= at) & (column < at + width)
                m = np.zeros((len(rows), min(width, last - at)), np.float32)
                m[owner[here], column[here] - at] = 1
                common += m[outliers] @ m[others].T
            union = size[outliers][:, None] + size[others][None, :] - common
            o, x = np.nonzero((100 * common >= percent * union) & (comp[outliers][:, None] != comp[others][None, :]))
            o, x = outliers[o], others[x]
            root: dict[int, int] = {}

            def find(c: int) -> int:
                while (up := root.get(c, c)) != c:
                    root[c] = root.get(up, up)
                    c = up
                return c

            links = []
            pairs = np.stack((comp[o], comp[x]), axis=1)
            _, first = np.unique(pairs, axis=0, return_index=True) if len(pairs) else (None, [])
            for k in first:
                a, b = find(int(comp[o[k]])), find(int(comp[x[k]]))
                if a != b:
                    root[max(a, b)] = min(a, b)
                    links.append((int(uid[o[k]]), int(uid[x[k]])))
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], names=["a", "b"])

    return run


class Join:
    """State of one multi-index join: signatures, sets and confirmed links."""

    def __init__(self, sigs: DataFrame, tables: Tables, percent: int):
        self.sigs, self.tables, self.percent = sigs, tables, percent
        self.links: list[DataFrame] = []

    def members(self, keyed: DataFrame) -> DataFrame:
        """``key, uid, lead`` of the buckets with company; counts are combined before the shuffle."""
        keys = self.tables.write(keyed.mapInArrow(index_keys, "key long, uid long"))
        # sums are written before they are joined, so that AQE can split a key of very many rows
        shared = self.tables.write(keys.groupBy("key").agg(F.min("uid").alias("lead"), F.count(F.lit(1)).alias("c")).where("c > 1").select("key", "lead"))
        out = self.tables.write(keys.join(shared, "key"))
        self.tables.drop(keys, shared)
        return out

    def confirm(self, pairs: DataFrame) -> None:
        """Links among ``pairs(a, b)``: near by signature, then similar by their full sets."""
        sig = self.sigs.select("uid", "sig", "n")
        a, b = sig.toDF("a", "sa", "na"), sig.toDF("b", "sb", "nb")
        sized = pairs.join(b, "b").join(a, "a").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * self.percent)
        near = self.tables.write(sized.select("a", "b", "sa", "sb").mapInArrow(near_pairs, "a long, b long"))
        ha, hb = self.sets.toDF("a", "ha"), self.sets.toDF("b", "hb")
        found = near.join(hb, "b").join(ha, "a").select("a", "b", "ha", "hb").mapInArrow(similar(self.percent), "a long, b long")
        self.links.append(self.tables.write(found))
        self.tables.drop(near)

    def components(self) -> DataFrame:
        edges = self.links[0]
        for x in self.links[1:]:
            edges = edges.union(x)
        return components(edges.toDF("u", "v"), self.tables)

    def open_buckets(self, members: DataFrame) -> DataFrame | None:
        """``key, uid, component`` of the buckets whose members are in several components."""
        comp = self.components().toDF("uid", "component")
        rows = members.join(comp, "uid", "left").select("key", "uid", F.coalesce("component", "uid").alias("component"))
        several = self.tables.write(rows.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key"))
        out = self.tables.write(rows.join(several, "key", "left_semi"))
        return None if out.isEmpty() else out

    def search(self, members: DataFrame, crowded: int) -> None:
        """All links between members of a bucket, up to what their components imply."""
        self.confirm(members.where("uid <> lead").select(F.col("lead").alias("a"), F.col("uid").alias("b")).distinct())
        rest = self.open_buckets(members)
        for turn in range(LEADERS):
            if rest is None:
                return
            lead = self.tables.write(rest.groupBy("key").agg(F.max(F.struct(F.xxhash64("component", F.lit(turn)), "component", "uid")).alias("l")).select("key", F.col("l.component").alias("lc"), F.col("l.uid").alias("lead")))
            pairs = rest.join(lead, "key").where("component <> lc").select(F.least("uid", "lead").alias("a"), F.greatest("uid", "lead").alias("b")).distinct()
            self.confirm(pairs)
            rest = self.open_buckets(rest.select("key", "uid"))
        if rest is None:
            return
        big = self.tables.write(rest.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("uid").alias("lead")).where(F.col("c") > crowded).select("key", "lead"))
        small = rest.join(big, "key", "left_anti")
        near = small.join(self.sigs.select("uid", "sig"), "uid").repartition("key").sortWithinPartitions("key", "uid").select("key", "uid", "component", "sig").mapInArrow(apart, "a long, b long")
        comp = rest.select("uid", "component").distinct()
        if not big.isEmpty():
            # crowded buckets share most members: what hangs together is compared once
            together = components(rest.join(big, "key").select(F.col("lead").alias("u"), F.col("uid").alias("v")).distinct(), self.tables).toDF("uid", "cluster")
            near = near.union(self.blocks(together.join(comp, "uid"), self.sigs.select("uid", "sig"), "sig", SIGNATURE_BLOCK).mapInArrow(near_blocks, "a long, b long"))
        near = self.tables.write(near.distinct())
        clusters = components(near.toDF("u", "v"), self.tables).toDF("uid", "cluster")
        self.links.append(self.tables.write(self.blocks(clusters.join(comp, "uid"), self.sets, "hashes", BLOCK).mapInArrow(link_blocks(self.percent), "a long, b long")))

    def blocks(self, rows: DataFrame, data: DataFrame, column: str, size: int) -> DataFrame:
        """Blocks ``i`` of each cluster in ``rows(uid, component, cluster)`` beside blocks ``j`` of its outliers, the rows outside its largest component.

        Rows come with ``data(uid, column)``, those of a pair of blocks together.
        """
        rows = self.tables.write(rows.select("uid", "component", "cluster"))
        each = rows.groupBy("cluster", "component").agg(F.count(F.lit(1)).alias("c"))
        sizes = each.groupBy("cluster").agg(F.sum("c").alias("n"), F.max(F.struct("c", "component")).alias("g"))
        sizes = sizes.select("cluster", F.col("g.component").alias("largest"), F.ceil(F.col("n") / size).alias("all"), F.ceil((F.col("n") - F.col("g.c")) / size).alias("out")).where("out > 0")
        rows = rows.join(self.tables.write(sizes), "cluster").withColumn("h", F.xxhash64("uid"))
        here, there = F.pmod("h", "all"), F.pmod("h", "out")
        every = rows.select("cluster", here.alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("out") - 1)).alias("j"), F.lit(0).alias("outlier"), "uid", "component")
        out = rows.where("component <> largest").select("cluster", F.explode(F.sequence(F.lit(0).cast("long"), F.col("all") - 1)).alias("i"), there.alias("j"), F.lit(1).alias("outlier"), "uid", "component")
        return every.union(out).join(data, "uid").repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j").select("cluster", "i", "j", "outlier", "uid", "component", column)


def near_dedup(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", crowded: int = CROWDED) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row of ``docs``.

    Texts are lower-cased (A-Z) and cut at ASCII blanks. Rows are linked if
    their sets of ``words``-word shingles have at least ``percent`` per cent of
    their union in common; a text with fewer words is one shingle. Links are
    confirmed on the full sets of 64-bit shingle hashes. ``component_id`` is
    the smallest id that links reach, and one row of a component is kept, the
    one that has it. Texts without words, null too, are linked with nothing.
    Rows that share an id, or have none, are rows of their own (see
    ``common.ordered``). Other columns are ignored; no rows in, no rows out.
    """
    tables = Tables(docs.sparkSession, "neardup")
    rows, unique = ordered(docs, tables, id_col, text_col)
    sketches = tables.write(rows.select("uid", "text").mapInArrow(sketch(words), "uid long, n long, set_id binary, sig binary"))
    # rows with the same set stand for one another: the first one's signature goes on
    first = tables.write(sketches.where("n > 0").groupBy("set_id").agg(F.min("uid").alias("first")))
    sigs = tables.write(sketches.join(first.select(F.col("first").alias("uid")), "uid", "left_semi").select("uid", "n", "sig"))
    join = Join(sigs, tables, percent)
    members = join.members(sigs.select("uid", "sig"))
    candidates = members.select("uid").distinct()
    join.sets = tables.write(rows.select("uid", "text").join(candidates, "uid", "left_semi").mapInArrow(full_sets(words), "uid long, hashes binary"))
    join.search(members, crowded)
    comp = join.components().toDF("first", "component")
    classes = first.join(comp, "first", "left").select("set_id", F.coalesce("component", "first").alias("component"))
    out = sketches.select("uid", "n", "set_id").join(classes, "set_id", "left").select("uid", F.col("n").alias("n_shingles"), F.coalesce("component", "uid").alias("component"))
    if unique:
        return out.select(F.col("uid").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), (F.col("uid") == F.col("component")).alias("kept"))
    names = rows.select("uid", "doc_id")
    out = out.join(names, "uid").join(names.toDF("component", "component_id"), "component")
    return out.select("doc_id", "n_shingles", "component_id", (F.col("uid") == F.col("component")).alias("kept"))


ship(__name__)
