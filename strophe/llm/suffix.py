"""Removal of repeated byte strings with suffix arrays built by induced sorting.

A window of ``width`` bytes is repeated if the same bytes also start earlier.
Windows that are equal choose the same anchor (the least hash of the short
strings in them), so the corpus can be dealt into shards by anchor:

1. anchors that occur once can't belong to a repeat; the rest are found by
   counting over all documents;
2. documents with such anchors are cut into segments, the runs of windows with
   one anchor. Equal segments are pre-aggregated: the first stays, every window
   of the others is repeated;
3. the segments that stay and share their anchor with a different one, or hold
   it twice, go to shards by anchor. (One that does neither can't hold or meet
   an equal window.) Each shard is sorted by
   induced sorting (suffixes are classified, leftmost-smaller substrings are
   sorted recursively, and the array is induced in two linear scans), and the
   permuted common prefixes show which windows are equal;
4. an anchor with very many bytes of different segments (a passage that stands
   in a large share of all documents, next to different text each time) is
   dealt anew by what its windows must share around the anchor, up to all but
   ``SLACK`` bytes of them, and these smaller shards go through steps 2 and 3.
   Only windows that differ from very many others within those last bytes are
   dealt by their digests, so no task gathers them.

No counts, anchors or segments reach the driver, and every pre-aggregation is
combined before its shuffle.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strophe.llm.common import Tables, ordered, ship, text_parts

#: Bytes hashed for an anchor.
ANCHOR = 24
#: Bytes of segments per shard (what fits a core's cache), shards per task up to ``TASKS_PER_CORE`` tasks (then a task takes more), and bytes
#: of different segments of one anchor above which it is dealt by window.
SHARD_BYTES, SHARDS_PER_TASK, TASKS_PER_CORE, CROWDED = 1_000_000, 3, 64, 1_000_000
#: Bytes of a window that the parts of a crowded anchor's segments may differ in.
SLACK = 10
#: Letters of a leftmost-smaller substring up to which substrings of large alphabets are sorted directly.
DIRECT = 256


# --- induced sorting ---------------------------------------------------------


def small_types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one (the empty suffix is the least)."""
    n = len(t)
    differs = np.append(t[:-1] != t[1:], True)
    at = np.where(differs, np.arange(n), n - 1)
    then = np.minimum.accumulate(at[::-1])[::-1]
    return np.append(t[:-1] < t[1:], False)[then]


def induce_by_bucket(t: np.ndarray, small: np.ndarray, lms: np.ndarray, k: int) -> np.ndarray:
    """The suffix array induced from leftmost-smaller suffixes in sorted order.

    Two linear scans, one bucket of equal first letters at a time: what stands
    in a bucket sends the suffixes one letter longer to the buckets ahead. Runs
    of one letter, which would send to their own bucket, are expanded at once.
    """
    n = len(t)
    sizes = np.bincount(t, minlength=k)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    place = np.arange(n)
    fresh = np.append(True, t[1:] != t[:-1])
    run = (place - np.maximum.accumulate(np.where(fresh, place, 0))).astype(np.int32)  # equal letters right before
    sa = np.zeros(n, np.int32)
    lms_of = np.split(lms, np.cumsum(np.bincount(t[lms], minlength=k))[:-1])
    letters = t.astype(np.uint16)

    def longer(of: np.ndarray) -> np.ndarray:
        """Suffixes that extend these by more of the same letter, shortest extension first."""
        r = run[of]
        if not r.any():
            return of[:0]
        who = np.repeat(np.arange(len(of)), r)
        step = np.arange(len(who)) - np.repeat(np.cumsum(r) - r, r) + 1
        order = np.argsort(step, kind="stable")
        return (of[who] - step)[order]

    heads = starts.copy()

    def send(of: np.ndarray, c: int) -> None:
        before = of[of > 0] - 1
        to = letters[before]
        before, to = before[to > c], to[to > c]
        if len(before):
            order = np.argsort(to, kind="stable")
            to = to[order]
            count = np.bincount(to, minlength=k)
            sa[np.repeat(heads - (np.cumsum(count) - count), count) + np.arange(len(to))] = before[order]
            heads[:] += count

    sa[heads[t[n - 1]]] = n - 1  # from the empty suffix
    heads[t[n - 1]] += 1
    present = np.flatnonzero(sizes)
    for c in present:
        more = longer(sa[starts[c]:heads[c]])
        sa[heads[c]:heads[c] + len(more)] = more
        heads[c] += len(more)
        send(sa[starts[c]:heads[c]], c)
        send(lms_of[c], c)
    larger_ends, tails = heads.copy(), ends.copy()

    def send_back(of: np.ndarray, c: int) -> None:
        before = of[of > 0] - 1
        to = letters[before]
        before, to = before[to < c], to[to < c]
        if len(before):
            order = np.argsort(to, kind="stable")
            to = to[order]
            count = np.bincount(to, minlength=k)
            sa[np.repeat(tails - 1 + (np.cumsum(count) - count), count) - np.arange(len(to))] = before[order]
            tails[:] -= count

    for c in present[::-1]:
        more = longer(sa[tails[c]:ends[c]][::-1])
        sa[tails[c] - len(more):tails[c]] = more[::-1]
        tails[c] -= len(more)
        send_back(sa[tails[c]:ends[c]][::-1], c)
        send_back(sa[starts[c]:larger_ends[c]][::-1], c)
    return sa


def induce_by_letter(t: np.ndarray, small: np.ndarray, lms: np.ndarray, k: int) -> np.ndarray:
    """The same, suffix by suffix, for alphabets as large as the string.

    Works on compact arrays, which stay in cache where lists of objects don't.
    """
    compact = lambda x: array("i", x.astype(np.int32).tobytes())
    n = len(t)
    ends = np.cumsum(np.bincount(t, minlength=k))
    heads = compact(ends - np.bincount(t, minlength=k))
    # a suffix sends the one before it if that is larger (first scan) or smaller (second); -1 sends nothing
    before = np.arange(-1, n)
    kinds = np.append(False, small)
    letters, sends = compact(t), compact(np.append(np.where(kinds, -1, before)[:n], -1))
    sends[0] = -1
    start = np.full(n, n)
    count = np.bincount(t[lms], minlength=k)
    start[np.repeat(ends - count, count) + np.arange(len(lms)) - np.repeat(np.cumsum(count) - count, count)] = lms
    sa = compact(start)
    c = letters[n - 1]
    sa[heads[c]] = n - 1
    heads[c] += 1
    for j in sa:
        p = sends[j]
        if p >= 0:
            c = letters[p]
            h = heads[c]
            sa[h] = p
            heads[c] = h + 1
    tails, sends = compact(ends - 1), compact(np.append(np.where(kinds, before, -1)[:n], -1))
    for i in range(n - 1, -1, -1):
        p = sends[sa[i]]
        if p >= 0:
            c = letters[p]
            h = tails[c]
            sa[h] = p
            tails[c] = h - 1
    return np.frombuffer(sa, np.int32)


def sort_substrings(t: np.ndarray, lms: np.ndarray, size: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Leftmost-smaller substrings in order, and where a new one starts, letter by letter among ties.

    Where one ends and the other goes on, the longer is the smaller: its next
    letter belongs to a larger-type suffix.
    """
    order = np.argsort(t[lms], kind="stable")
    first = t[lms[order]]
    new = np.append(True, first[1:] != first[:-1])
    live, depth = np.arange(len(lms)), 1
    while len(live):
        group = np.cumsum(new[live]) - 1
        live = live[(np.bincount(group)[group] > 1) & (size[lms[order[live]]] >= depth)]
        at = lms[order[live]]
        letter = np.where(depth >= size[at], k, t[np.minimum(at + depth, len(t) - 1)])
        letter[at + depth >= len(t)] = -1
        group = np.cumsum(new[live]) - 1
        by = np.argsort(group * (k + 2) + letter + 1, kind="stable")
        order[live] = order[live][by]
        letter = letter[by]
        new[live[1:]] |= (group[1:] == group[:-1]) & (letter[1:] != letter[:-1])
        depth += 1
    return order, new


def suffix_array(t: np.ndarray, k: int) -> np.ndarray:
    """Suffix array of integers below ``k``, by induced sorting."""
    n = len(t)
    if n < 2:
        return np.arange(n, dtype=np.int32)
    small = small_types(t)
    lms = (np.flatnonzero(small[1:] & ~small[:-1]) + 1).astype(np.int32)
    by_bucket = k <= 1024
    induce = induce_by_bucket if by_bucket else induce_by_letter
    ordered_lms = lambda order: order[np.argsort(t[order], kind="stable")]
    if len(lms) < 2:
        return induce(t, small, lms, k)
    size = np.zeros(n, np.int32)
    size[lms[:-1]] = np.diff(lms) + 1
    size[lms[-1]] = n + 2  # ends with the empty suffix, like no other
    if by_bucket or int(size[lms[:-1]].max()) > DIRECT:
        # sort the leftmost-smaller substrings by inducing from unsorted ones, then compare neighbours
        sa = induce(t, small, ordered_lms(lms), k)
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        order = np.asarray(sa)[is_lms[sa]]
        a, b = order[:-1], order[1:]
        new = np.ones(len(order), bool)
        alike = np.flatnonzero(size[a] == size[b])
        if len(alike):
            span = size[a[alike]]
            offset = np.arange(int(span.sum())) - np.repeat(np.cumsum(span) - span, span)
            odd = t[np.repeat(a[alike], span) + offset] != t[np.repeat(b[alike], span) + offset]
            new[alike + 1] = np.logical_or.reduceat(odd, np.cumsum(span) - span)
    else:
        by, new = sort_substrings(t, lms, size, k)
        order = lms[by]
    names = np.zeros(n, np.int64)
    names[order] = np.cumsum(new) - 1
    if not new.all():
        order = lms[suffix_array(names[lms], int(new.sum()))]
    return induce(t, small, ordered_lms(order), k)


def words_at(data: np.ndarray, pad: int) -> np.ndarray:
    """Eight bytes from each position on, as one number; ``pad`` zeros follow the data."""
    held = np.concatenate((data, np.zeros(pad + 8, np.uint8)))
    return np.ndarray((len(data) + pad,), "<u8", held, strides=(1,)).copy()


def permuted_lcp(t: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """Common prefix of each suffix with the one before it in ``sa``, in text order.

    Where both are preceded by the same byte the value is one less than the
    position's before; only the others are compared, eight bytes at a time.
    """
    n = len(t)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    i = np.arange(n)
    known = (i > 0) & (before > 0)
    known[known] = t[i[known] - 1] == t[before[known] - 1]
    todo = np.flatnonzero(~known & (before >= 0))
    out = np.zeros(n, np.int64)
    words = words_at(t, 8)
    live, a, b = todo, todo.copy(), before[todo]
    while len(live):
        end = n - np.maximum(a, b)
        differ = words[a] ^ words[b]
        low = differ & (~differ + np.uint64(1))
        same = np.where(differ == 0, 8, np.log2(np.maximum(low, np.uint64(1)).astype(np.float64)).astype(np.int64) // 8)
        same = np.minimum(same, end)
        out[live] += same
        on = (same == 8) & (end > 8)
        live, a, b = live[on], a[on] + 8, b[on] + 8
    last = np.maximum.accumulate(np.where(known, 0, i))
    return np.where(known, out[last] - (i - last), out)


# --- anchors and segments ----------------------------------------------------


def mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


def spread(x: np.ndarray, reach: int, pick: np.ufunc) -> np.ndarray:
    """Least or largest of ``reach`` values from each place on, by doubling."""
    span = 1
    while span * 2 <= reach:
        x = pick(x[:-span], x[span:])
        span *= 2
    return pick(x[:len(x) - (reach - span)], x[reach - span:]) if span < reach else x


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the ``ANCHOR`` bytes from each place on."""
    w = words_at(data, 16)
    m = len(data) - ANCHOR + 1
    h = w[:m] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(31)
    h += w[8:8 + m] * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(28)
    h += w[16:16 + m] * np.uint64(0x165667B19E3779F9)
    return mixed(h)


def anchor_runs(data: np.ndarray, sizes: np.ndarray, width: int, count: bool = False) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: document, place in it, windows, anchor.

    ``data`` holds the documents one after the other. With ``count`` the
    last item is how often the anchor stands in the run.
    """
    none = np.empty(0, np.int64)
    ends = np.cumsum(sizes)
    n = len(data) - width + 1
    if n < 1 or not (sizes >= width).any():
        return (none, none, none, none, none) if count else (none, none, none, none)
    h = gram_hashes(data)
    reach = width - ANCHOR + 1
    least = spread(h, reach, np.minimum)
    # windows that stay inside their document
    inside = np.zeros(len(data) + 1, np.int32)
    fits = sizes >= width
    starts = ends - sizes
    inside[starts[fits]] += 1
    np.subtract.at(inside, ends[fits] - width + 1, 1)
    inside = np.cumsum(inside[:n]) > 0
    fresh = np.empty(n, bool)
    fresh[0] = True
    np.not_equal(least[1:], least[:-1], out=fresh[1:])
    fresh[1:] |= ~inside[:-1]
    fresh[starts[fits]] = True
    at = np.flatnonzero(fresh & inside)
    # a run ends where the next one starts or where its document's windows end
    doc = np.searchsorted(ends, at, "right")
    stop = np.minimum(np.append(at[1:], n), ends[doc] - width + 1)
    anchor = least[at]
    if not count:
        return doc, at - starts[doc], stop - at, anchor.astype(np.int64)
    # places that are the anchor of some window around them, then those of each run
    edge = np.zeros(reach - 1, np.uint64)
    held = np.flatnonzero(spread(np.concatenate((edge, least, edge)), reach, np.maximum) == h)
    a, b = np.searchsorted(held, at), np.searchsorted(held, stop + reach - 1)
    run = np.repeat(np.arange(len(at)), b - a)
    own = h[held[np.arange(len(run)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + a[run]]] == anchor[run]
    return doc, at - starts[doc], stop - at, anchor.astype(np.int64), np.bincount(run[own], minlength=len(at))


def count_anchors(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("uid").to_numpy()
            for at, data, sizes in text_parts(batch.column("text"), 1_000_000):
                doc, _, _, anchor, stands = anchor_runs(data, sizes, width, True)
                order = np.lexsort((anchor, doc))
                doc, anchor = doc[order], anchor[order]
                total = np.append(0, np.cumsum(stands[order]))
                first = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (anchor[1:] != anchor[:-1]))) if len(doc) else np.empty(0, np.int64)
                stop = np.append(first[1:], len(doc))
                times = total[stop] - total[first]
                yield pa.RecordBatch.from_arrays([pa.array(anchor[first]), pa.array(ids[at + doc[first]]), pa.array(times.astype(np.int32))], names=["anchor", "uid", "times"])

    return run


def describe_segments(width: int):
    """Segments of the wanted anchors: digest of the bytes, place, windows, and whether the anchor stands more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, anchors = batch.column("uid").to_numpy(), batch.column("anchors")
            for at, data, sizes in text_parts(batch.column("text"), 1_000_000):
                doc, place, n, anchor, stands = anchor_runs(data, sizes, width, True)
                here = anchors.slice(at, len(sizes))
                wanted = here.flatten().to_numpy()
                owner = np.repeat(np.arange(len(sizes)), pa.compute.list_value_length(here).to_numpy())
                d, x = np.concatenate((owner, doc)), np.concatenate((wanted, anchor))
                order = np.lexsort((x, d))
                d, x = d[order], x[order]
                code = np.empty(len(order), np.int64)
                code[order] = np.cumsum(np.append(True, (d[1:] != d[:-1]) | (x[1:] != x[:-1]))) if len(order) else 0
                known = np.zeros(len(order) + 2, bool)
                known[code[:len(owner)]] = True
                keep = np.flatnonzero(known[code[len(owner):]])
                start = (np.cumsum(sizes) - sizes)[doc[keep]] + place[keep]
                raw = data.tobytes()
                sids = [hashlib.md5(raw[a:b]).digest() for a, b in zip(start.tolist(), (start + n[keep] + width - 1).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(anchor[keep]), pa.array(sids, pa.binary()), pa.array(ids[at + doc[keep]]), pa.array(place[keep]), pa.array(n[keep]), pa.array(stands[keep] > 1)], names=["anchor", "sid", "uid", "place", "n", "again"])

    return run


def cut_segments(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uid, text, parts in zip(*(batch.column(c).to_pylist() for c in ("uid", "text", "parts")), strict=True):
                raw = text.encode()
                cut = [raw[x["place"]:x["place"] + x["n"] + width - 1] for x in parts]
                yield pa.RecordBatch.from_arrays([pa.array([x["anchor"] for x in parts], pa.int64()), pa.array(cut, pa.binary()), pa.array([uid] * len(cut), pa.int64()), pa.array([x["place"] for x in parts], pa.int64())], names=["anchor", "segment", "uid", "place"])

    return run


def shard_repeats(width: int, limit: int):
    """Repeated windows of each shard: ``uid, place, n`` for runs of them."""

    def solve(segments: list[bytes], uid: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
        t = np.frombuffer(b"".join(segments), np.uint8)
        sa = suffix_array(t, 256)
        equal = permuted_lcp(t, sa)[sa] >= width
        group = np.cumsum(~equal)
        sizes = np.array([len(s) for s in segments])
        starts = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(sizes)), sizes)[sa]
        inside = sa - starts[owner] <= sizes[owner] - width
        sa, group, owner = sa[inside], group[inside], owner[inside]
        crowd = np.bincount(group)[group] > 1
        sa, group, owner = sa[crowd], group[crowd], owner[crowd]
        where = place[owner] + sa - starts[owner]
        order = np.lexsort((where, uid[owner], group))
        later = np.append(False, group[order][1:] == group[order][:-1]) if len(order) else np.empty(0, bool)
        hit = order[later]
        hit = hit[np.lexsort((where[hit], uid[owner[hit]]))]
        u, p = uid[owner[hit]], where[hit]
        first = np.flatnonzero(np.append(True, (u[1:] != u[:-1]) | (p[1:] != p[:-1] + 1))) if len(u) else np.empty(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(u[first]), pa.array(p[first]), pa.array(np.diff(np.append(first, len(u))).astype(np.int64))], names=["uid", "place", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments: list[bytes] = []
        uid, place, anchors, held = [], [], [], 0
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("anchor", "segment", "uid", "place")]
            for a, s, u, p in zip(*columns, strict=True):
                if held >= limit and a != anchors[-1]:  # rows come by anchor, so a shard may end here
                    yield solve(segments, np.array(uid), np.array(place))
                    segments, uid, place, anchors, held = [], [], [], [], 0
                segments.append(s)
                uid.append(u)
                place.append(p)
                anchors.append(a)
                held += len(s)
        if segments:
            yield solve(segments, np.array(uid), np.array(place))

    return run


def split_segments(width: int):
    """Parts of the segments of a crowded anchor: runs of windows that share ``width - SLACK`` bytes, with the hash of these.

    A window is told by where its first anchor stands in it. Windows in which
    it stands up to ``SLACK`` places apart share what lies around it, and equal
    windows have equal places, so they are in parts of one hash.
    """
    reach = width - ANCHOR

    kinds = (("anchor", pa.int64()), ("sid", pa.binary()), ("segment", pa.binary()), ("uid", pa.int64()), ("place", pa.int64()))

    def parts(anchor: int, s: bytes, u: int, p: int) -> Iterator[tuple]:
        n = len(s) - width + 1
        held = np.flatnonzero(gram_hashes(np.frombuffer(s, np.uint8)) == np.uint64(anchor & (1 << 64) - 1))
        at = held[np.searchsorted(held, np.arange(n))]
        low = (at - np.arange(n)) // SLACK * SLACK
        first = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (low[1:] != low[:-1])))
        for a, b in zip(first.tolist(), np.append(first[1:], n).tolist(), strict=True):
            lo, around = int(low[a]), int(at[a])
            hi = min(lo + SLACK - 1, reach)
            key = hashlib.md5(b"%d " % lo + s[around - lo:around + ANCHOR + reach - hi]).digest()
            part = s[a:b + width - 1]
            yield int.from_bytes(key[:8], "little", signed=True), hashlib.md5(part).digest(), part, u, p + a

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = chain.from_iterable(parts(*row) for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "segment", "uid", "place")), strict=True))
            # a segment that repeats a short period has very many parts
            while some := list(islice(every, 4096)):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*some, strict=True), kinds, strict=True)], names=[name for name, _ in kinds])

    return run


def single_windows(width: int):
    """Digest, document and place of each window of the segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, u, p in zip(*(batch.column(c).to_pylist() for c in ("segment", "uid", "place")), strict=True):
                n = len(s) - width + 1
                yield pa.RecordBatch.from_arrays([pa.array([hashlib.md5(s[i:i + width]).digest() for i in range(n)], pa.binary()), pa.array([u] * n, pa.int64()), pa.array(range(p, p + n), pa.int64())], names=["window", "uid", "place"])

    return run


def digests(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, places, ns in zip(*(batch.column(c).to_pylist() for c in ("text", "places", "ns")), strict=True):
                raw = (text or "").encode()
                removed = spans = at = 0
                kept = hashlib.sha256()
                for a, n in sorted(zip(places or (), ns or (), strict=True)):
                    b = a + n + width - 1
                    if b <= at:
                        continue
                    if a > at or not spans:
                        spans += 1
                        kept.update(raw[at:a])
                        removed += b - a
                    else:
                        removed += b - at
                    at = b
                kept.update(raw[at:])
                out.append((len(raw), removed, spans, kept.hexdigest()))
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


# --- the operator --------------------------------------------------------------


def in_order(uid: str = "uid", place: str = "place") -> Column:
    """Document and place as one number, so that the first of several is found in hash maps."""
    return F.col(uid).cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(11,0)") + F.col(place).cast("decimal(11,0)")


def later_windows(windows: DataFrame) -> DataFrame:
    """Of equal windows all but the first, as runs of one: ``uid, place, n``."""
    many = windows.groupBy("window").agg(F.min(in_order()).alias("f"), F.count(F.lit(1)).alias("c")).where("c > 1").select("window", "f")
    return windows.join(many, "window").where(in_order() > F.col("f")).select("uid", "place", F.lit(1).cast("long").alias("n"))


def repeated_windows(rows: DataFrame, tables: Tables, width: int = 100, shard_bytes: int = SHARD_BYTES, crowded: int = CROWDED) -> DataFrame:
    """``uid, place, n``: runs of ``n`` windows from byte ``place`` on that also start earlier.

    ``rows``: ``uid`` (unique, ordered) and ``text``. Exact, for any width of at
    least 32 bytes.
    """
    texts = rows.select("uid", "text")
    anchors = tables.write(texts.mapInArrow(count_anchors(width), "anchor long, uid long, times int"))
    # written, not joined as it is summed, so that AQE can split an anchor of very many rows
    common = tables.write(anchors.groupBy("anchor").agg(F.sum("times").alias("c")).where("c > 1").select("anchor"))
    wanted = tables.write(anchors.join(common, "anchor", "left_semi").groupBy("uid").agg(F.collect_list("anchor").alias("anchors")))
    tables.drop(anchors, common)
    occ = tables.write(texts.join(wanted, "uid").mapInArrow(describe_segments(width), "anchor long, sid binary, uid long, place long, n long, again boolean"))
    tables.drop(wanted)
    # equal segments: every window of all but the first is repeated
    keyed = occ.withColumn("at", in_order())
    groups = tables.write(keyed.groupBy("anchor", "sid").agg(F.min("at").alias("f"), F.count(F.lit(1)).alias("c"), F.max("again").alias("again")))
    # a segment alone under an anchor that stands once has all its windows different and meets no other
    mixed_anchors = groups.groupBy("anchor").agg(F.count(F.lit(1)).alias("k"), F.max("again").alias("x")).where("k > 1 or x").select("anchor", F.lit(True).alias("open"))
    tagged = groups.join(mixed_anchors, "anchor", "left").where("c > 1 or open").select("anchor", "sid", "f", "open")
    joined = tables.write(keyed.join(tagged, ["anchor", "sid"]).select("anchor", "uid", "place", "n", (F.col("at") > F.col("f")).alias("later"), F.coalesce("open", F.lit(False)).alias("open")))
    tables.drop(occ, groups)
    later = joined.where("later").select("uid", "place", "n")
    parts = joined.where("open and not later").groupBy("uid").agg(F.collect_list(F.struct("anchor", "place", "n")).alias("parts"))
    first = tables.write(texts.join(parts, "uid").mapInArrow(cut_segments(width), "anchor long, segment binary, uid long, place long"))
    calm, crowd = sharded(first, tables, width, shard_bytes, crowded)
    out = later.union(calm)
    if crowd is not None:
        parts = tables.write(crowd.mapInArrow(split_segments(width), "anchor long, sid binary, segment binary, uid long, place long"))
        groups = tables.write(parts.groupBy("anchor", "sid").agg(F.min(in_order()).alias("f"), F.count(F.lit(1)).alias("c")))
        several = groups.groupBy("anchor").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("anchor", F.lit(True).alias("open"))
        tagged = tables.write(groups.join(several, "anchor", "left").where("c > 1 or open"))
        told = tables.write(parts.join(tagged, ["anchor", "sid"]).withColumn("later", in_order() > F.col("f")))
        again = told.where("later").select("uid", "place", (F.length("segment") - (width - 1)).cast("long").alias("n"))
        calm, crowd = sharded(told.where("open and not later").select("anchor", "segment", "uid", "place"), tables, width, shard_bytes, crowded)
        out = out.union(again).union(calm)
        if crowd is not None:
            split = tables.write(crowd.mapInArrow(single_windows(width), "window binary, uid long, place long"))
            out = out.union(tables.write(later_windows(split)))
            tables.drop(split)
        tables.drop(parts, groups, tagged)
    tables.drop(first)
    return out


def sharded(segments: DataFrame, tables: Tables, width: int, shard_bytes: int, crowded: int) -> tuple[DataFrame, DataFrame | None]:
    """Repeated windows (``uid, place, n``) among ``segments(anchor, segment, uid, place)`` by suffix arrays, and the segments of crowded anchors, if any."""
    sizes = tables.write(segments.groupBy("anchor").agg(F.sum(F.length("segment")).alias("b")))
    crowds = tables.write(sizes.where(F.col("b") > crowded).select("anchor"))
    total = sizes.agg(F.sum("b")).first()[0] or 0
    tasks = max(1, min(-(-total // (shard_bytes * SHARDS_PER_TASK)), TASKS_PER_CORE * segments.sparkSession.sparkContext.defaultParallelism))
    calm = segments.join(crowds, "anchor", "left_anti").repartition(tasks, "anchor").sortWithinPartitions("anchor", "uid", "place")
    found = tables.write(calm.select("anchor", "segment", "uid", "place").mapInArrow(shard_repeats(width, shard_bytes), "uid long, place long, n long"))
    tables.drop(sizes)
    return found, None if crowds.isEmpty() else segments.join(crowds, "anchor", "left_semi").select("anchor", "segment", "uid", "place")


def remove_repeats(docs: DataFrame, width: int = 100, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES, crowded: int = CROWDED) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for each row.

    Each byte covered by a string of ``width`` bytes that also starts earlier
    is removed, judged on the input. Null text is empty; texts shorter than
    ``width`` stay whole. Shared and null ids: see ``common.ordered``. Other columns
    are ignored; no rows in, no rows out.
    """
    tables = Tables(docs.sparkSession, "suffix")
    rows, _ = ordered(docs, tables, id_col, text_col)
    runs = repeated_windows(rows, tables, width, shard_bytes, crowded)
    spans = runs.groupBy("uid").agg(F.collect_list(F.struct("place", "n")).alias("s")).select("uid", F.col("s.place").alias("places"), F.col("s.n").alias("ns"))
    return rows.join(spans, "uid", "left").select("doc_id", "text", "places", "ns").mapInArrow(digests(width), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def removed_spans(docs: DataFrame, width: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, start, stop``: the byte runs that ``remove_repeats`` removes, for callers that cut texts themselves.

    Runs of one document may touch or overlap. With shared or null ids a run
    belongs to one of the rows of its id, the order of which ``common.ordered``
    gives; callers that need to tell them apart give rows an id of their own.
    """
    tables = Tables(docs.sparkSession, "suffix")
    rows, _ = ordered(docs, tables, id_col, text_col)
    runs = repeated_windows(rows, tables, width)
    return runs.join(rows.select("uid", "doc_id"), "uid").select("doc_id", F.col("place").alias("start"), (F.col("place") + F.col("n") + (width - 1)).alias("stop"))


ship(__name__)
