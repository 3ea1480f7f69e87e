"""Approximate nearest neighbours with robust-pruned directed graphs.

Vectors are dealt into shards. Each shard builds a graph: greedy searches over
the graph so far propose a node's neighbours, and pruning drops a candidate
that is much nearer to a neighbour already chosen than to the node. The factor
of "much" is relaxed in the second pass, which keeps long, diverse edges. Every
query runs a beam search in each shard, and the shards' best are merged.

Equal vectors are pre-aggregated, so a vector that a third of all rows share is
one node, and so are vectors of one direction in a shard. Distances are lengths
of differences of unit vectors, which lose nothing to cancellation: in single
precision while the graph is built and walked, in double precision for all that
a beam ends with. Where the whole beam lies at the distance of the k-th, within
what single precision tells apart, the shard is searched exactly for that query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strophe.llm.common import Tables, ship

#: Vectors per shard, edges per node, beam of searches while building and for queries, relaxation of the pruning.
SHARD, DEGREE, BUILD_BEAM, BEAM, RELAXED = 16384, 28, 56, 128, 1.2
#: Nodes inserted together, best nodes expanded together, and entry points besides the medoid.
BATCH, EXPAND, ENTRIES = 512, 4, 12
#: Decimals to which the distance of unit vectors is taken: their rounding is some 1e-15. Distances that single precision may confuse.
DECIMALS, CONFUSED = 12, 2e-6


def distances(x: np.ndarray, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Squared distance of unit vectors: of each query to its row of ids (-1: infinite)."""
    d = np.empty(ids.shape, x.dtype)
    step = max(1, (1 << 18) // max(1, ids.shape[1] * x.shape[1]))
    for at in range(0, len(ids), step):
        apart = x[ids[at:at + step]]
        apart -= q[at:at + step, None]
        np.einsum("mcd,mcd->mc", apart, apart, out=d[at:at + step])
    d[ids < 0] = np.inf
    return d


def beam_search(x: np.ndarray, graph: np.ndarray, entries: np.ndarray, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query the nearest nodes that greedy expansion meets: ids (-1 at the end) and distances."""
    m, rows = len(q), np.arange(len(q))[:, None]
    seen = np.zeros((m, len(x) + 1), bool)  # the last column stands for -1
    seen[:, -1] = True
    ids = np.full((m, beam), -1, np.int64)
    width = min(len(entries), beam)
    ids[:, :width] = entries[:width]
    seen[:, entries[:width]] = True
    d = distances(x, q, ids)
    done = ids < 0
    while True:
        open_ = np.where(done, np.inf, d)
        pick = np.argpartition(open_, min(EXPAND, beam - 1), axis=1)[:, :EXPAND]
        chosen = np.isfinite(np.take_along_axis(open_, pick, 1))
        if not chosen.any():
            break
        np.put_along_axis(done, pick, True, 1)
        near = graph[np.take_along_axis(ids, pick, 1)]
        near[~chosen] = -1
        near = np.sort(near.reshape(m, -1), axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        near[seen[rows, near]] = -1
        live = (near >= 0).any(axis=1)
        if not live.any():
            continue
        near = near[:, (near >= 0).any(axis=0)]
        seen[rows, near] = True
        ids, d, done = np.hstack((ids, near)), np.hstack((d, distances(x, q, near))), np.hstack((done, near < 0))
        best = np.argpartition(d, beam, axis=1)[:, :beam]
        ids, d, done = (np.take_along_axis(v, best, 1) for v in (ids, d, done))
        done |= ~np.isfinite(d)
    order = np.argsort(d, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(d, order, 1)


def robust_prune(x: np.ndarray, of: np.ndarray, candidates: np.ndarray, degree: int, relaxed: float) -> np.ndarray:
    """At most ``degree`` diverse neighbours of each node from its row of candidates (-1: none)."""
    c = np.sort(candidates, axis=1)
    c[:, 1:][c[:, 1:] == c[:, :-1]] = -1
    c[c == of[:, None]] = -1
    d = distances(x, x[of], c)
    order = np.argsort(d, axis=1, kind="stable")
    c, d = np.take_along_axis(c, order, 1), np.take_along_axis(d, order, 1)
    used = np.isfinite(d).any(axis=0).sum()
    c, d = c[:, :max(1, used)], d[:, :max(1, used)]
    # seen from the node, as cancellation is then small next to the distances compared
    v = x[c] - x[of][:, None]
    near = np.where(np.isfinite(d), d, 0.0)
    apart = near[:, :, None] + near[:, None] - 2.0 * (v @ v.transpose(0, 2, 1))
    alive, rows = np.isfinite(d), np.arange(len(of))
    out = np.full((len(of), degree), -1, np.int64)
    for k in range(degree):
        any_ = alive.any(axis=1)
        if not any_.any():
            break
        j = alive.argmax(axis=1)
        out[any_, k] = c[rows, j][any_]
        alive[rows, j] = False
        alive &= ~((relaxed * relaxed * apart[rows, j] <= d) & any_[:, None])
    return out


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, relaxed: float = RELAXED, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Graph over unit vectors (a row of neighbours for each, -1 at the end) and its entry points."""
    n, rng = len(x), np.random.default_rng(seed)
    medoid = int(np.argmax(x @ x.mean(axis=0)))
    entries = np.unique(np.append(rng.choice(n, min(n, ENTRIES), replace=False), medoid))
    graph = np.full((n, degree), -1, np.int64)
    if n == 1:
        return graph, entries
    fill = min(degree // 2, n - 1)
    graph[:, :fill] = (np.arange(n)[:, None] + rng.integers(1, n, (n, fill))) % n
    for factor in (1.0, relaxed):
        order = rng.permutation(n)
        for at in range(0, n, BATCH):
            of = order[at:at + BATCH]
            found, _ = beam_search(x, graph, entries, x[of], beam)
            graph[of] = robust_prune(x, of, np.hstack((found, graph[of])), degree, factor)
            to = graph[of]
            source, target = np.repeat(of, degree)[to.ravel() >= 0], to.ravel()[to.ravel() >= 0]
            by = np.argsort(target, kind="stable")
            source, target = source[by], target[by]
            nodes, start, count = np.unique(target, return_index=True, return_counts=True)
            back = np.full((len(nodes), int(count.max())), -1, np.int64)
            back[np.repeat(np.arange(len(nodes)), count), np.arange(len(target)) - np.repeat(start, count)] = source
            for part in range(0, len(nodes), BATCH):
                who = nodes[part:part + BATCH]
                wide = int(count[part:part + BATCH].max())
                both = np.hstack((graph[who], back[part:part + BATCH, :wide]))
                both = np.sort(both, axis=1)[:, ::-1]
                both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
                size = (both >= 0).sum(axis=1)
                full = size > degree
                if (~full).any():
                    graph[who[~full]] = np.sort(both[~full], axis=1)[:, ::-1][:, :degree]
                if full.any():
                    graph[who[full]] = robust_prune(x, who[full], both[full], degree, factor)
    return graph, entries


def search_shards(k: int, beam: int, degree: int):
    """Reads each shard's vectors, then its queries, and yields each query's ``k`` nearest in it."""

    def unit(v: np.ndarray) -> np.ndarray:
        v = v / np.abs(v).max(axis=1, keepdims=True)
        return v / np.sqrt((v * v).sum(axis=1, keepdims=True))

    def index(vectors: list[np.ndarray], ids: list[list[int]]) -> tuple:
        """Unit vectors of different directions with the ids of each, and their graph.

        Of one direction the k + 1 smallest ids can be among a query's k nearest.
        """
        x = unit(np.stack(vectors))
        _, first, of = np.unique(np.round(x, DECIMALS) + 0.0, axis=0, return_index=True, return_inverse=True)
        own = [[] for _ in first]
        for w, i in zip(of.ravel().tolist(), ids, strict=True):
            own[w] += i
        x = x[first]
        single = x.astype(np.float32)
        return x, single, [sorted(set(i))[:k + 1] for i in own], *build_graph(single, degree)

    def within(x: np.ndarray, q: np.ndarray) -> Iterator[np.ndarray]:
        """For each query all nodes that are no farther than the (k+1)-th nearest, float error included."""
        step = max(1, (1 << 22) // len(x))
        for at in range(0, len(q), step):
            s = q[at:at + step] @ x.T
            least = np.partition(s, len(x) - k - 1, axis=1)[:, len(x) - k - 1]
            yield from (np.flatnonzero(row >= low - 1e-11) for row, low in zip(s, least, strict=True))

    def answer(state: tuple, q_ids: np.ndarray, q: np.ndarray) -> pa.RecordBatch:
        x, single, ids, graph, entries = state
        q = unit(q)
        found, edge = beam_search(single, graph, entries, q.astype(np.float32), min(max(beam, 2 * k), len(x) + 2 * k))
        d = np.sqrt(distances(x, q, found))
        order = np.argsort(d, axis=1, kind="stable")
        found, d = np.take_along_axis(found, order, 1), np.take_along_axis(d, order, 1)
        # a beam that ends at the distance of the k-th may have left out others of that distance
        tied = np.flatnonzero((found[:, -1] >= 0) & (np.sqrt(edge[:, -1]) - d[:, k] <= CONFUSED)) if k < min(len(x), found.shape[1]) else np.empty(0, np.int64)
        exact = dict(zip(tied.tolist(), within(x, q[tied]), strict=True))
        out = []
        for at, (row, q_id, vec) in enumerate(zip(found, q_ids.tolist(), q, strict=True)):
            near = exact.get(at, row[row >= 0])
            far = np.round(np.sqrt(distances(x, vec[None], near[None])[0]), DECIMALS)
            if len(far) > k:
                close = far <= np.partition(far, k)[k]
                near, far = near[close], far[close]
            best = sorted((f, i) for f, w in zip(far.tolist(), near.tolist(), strict=True) for i in ids[w] if i != q_id)[:k]
            out += [(q_id, i, f) for f, i in best]
        cols = list(zip(*out, strict=True)) if out else [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "vec_id", "distance"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, vectors, ids, state = None, [], [], None
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("shard", "is_query", "ids")]
            rows = batch.column("vec")
            flat, offsets = rows.flatten().to_numpy(), np.cumsum(np.append(0, pa.compute.list_value_length(rows).to_numpy()))
            q_ids, q = [], []
            for at, (s, is_query, own) in enumerate(zip(*cols, strict=True)):
                if s != shard:
                    if q:
                        yield answer(state, np.array(q_ids), np.stack(q))
                        q_ids, q = [], []
                    shard, vectors, ids, state = s, [], [], None
                vec = flat[offsets[at]:offsets[at + 1]]
                if not is_query:
                    vectors.append(vec)
                    ids.append(own)
                elif vectors:
                    if state is None:
                        state = index(vectors, ids)
                    q_ids.append(own[0])
                    q.append(vec)
                    if len(q) >= BATCH:
                        yield answer(state, np.array(q_ids), np.stack(q))
                        q_ids, q = [], []
            if q:
                yield answer(state, np.array(q_ids), np.stack(q))

    return run


def nearest(vectors: DataFrame, is_query, k: int = 5, shard: int = SHARD, beam: int = BEAM, degree: int = DEGREE, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of each row that meets ``is_query``.

    Nearness is the largest cosine, ties go to the smaller id; cosines are
    compared by the distance of the unit vectors to ``DECIMALS`` places. A row
    with the query's own id is no candidate. Vectors that are null, empty, all zero or
    hold null or non-finite components, and rows without id, take no part.
    Vectors of different lengths are not compared. Rows equal in id and
    direction count once; rows that share an id alone are candidates each, and as
    queries their results are merged. Fewer candidates than
    ``k``: all of them. Every row is indexed.
    """
    tables = Tables(vectors.sparkSession, "ann")
    vec = F.transform(vec_col, lambda v: v.cast("double"))
    fine = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vec", lambda v: v != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), vec.alias("vec"), is_query.alias("is_query")).where("vec_id is not null and vec is not null").where(fine)
    # of equal vectors the k + 1 smallest ids can be among a query's k nearest; the limit applies before the shuffle
    place = F.row_number().over(W.partitionBy("vec").orderBy("vec_id"))
    ids = rows.select("vec", "vec_id").distinct().withColumn("place", place).where(F.col("place") <= k + 1)
    unique = tables.write(ids.groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    # shards of about equal size for each length of vectors
    sizes = unique.groupBy(F.size("vec").alias("d")).count().select("d", F.ceil(F.col("count") / shard).cast("int").alias("shards"))
    nodes = unique.join(sizes, F.size("vec") == F.col("d")).select(F.concat_ws("-", "d", F.pmod(F.xxhash64("ids"), F.col("shards"))).alias("shard"), F.lit(False).alias("is_query"), "ids", "vec")
    queries = rows.where("is_query").select("vec_id", "vec").distinct().join(sizes, F.size("vec") == F.col("d"))
    queries = queries.select(F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("s"), "d", "vec_id", "vec").select(F.concat_ws("-", "d", "s").alias("shard"), F.lit(True).alias("is_query"), F.array("vec_id").alias("ids"), "vec")
    both = nodes.union(queries).repartition("shard").sortWithinPartitions("shard", "is_query", "ids")
    found = tables.write(both.mapInArrow(search_shards(k, beam, degree), "query_id long, vec_id long, distance double"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("distance", "vec_id"))
    return found.distinct().withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", (1 - F.col("distance") * F.col("distance") / 2).alias("score"))


ship(__name__)
