"""Each stage of the pipeline against a plain version of it, and on odd tables."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import corpus_pipeline
import pytest

from strophe.llm import mixing, packing, quality

from test_brute_force import edited, reachable

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


def corpus(seed: int, unique: bool) -> list[tuple]:
    rng = random.Random(seed)
    base = [" ".join(f"w{rng.randrange(300)}" for _ in range(rng.randint(8, 90))) for _ in range(40)]
    texts = base + [rng.choice(base) for _ in range(20)] + [edited(rng.choice(base), rng, 1) for _ in range(40)]
    texts += [" ".join(f"{rng.choice('abc')}{rng.randrange(9)}%%%" for _ in range(40)) for _ in range(15)] + [None, "", "one", "  "]
    rng.shuffle(texts)
    ids = list(range(1, len(texts) + 1)) if unique else [rng.choice([None, *range(1, 40)]) for _ in texts]
    return [(i, t, "en", rng.choice(["s1", "s2", "s2", "s2", None]), None) for i, t in zip(ids, texts, strict=True)]


@pytest.fixture(scope="module", params=["own ids", "shared ids"])
def table(spark, request, tmp_path_factory):
    rows = corpus(4, request.param == "own ids")
    folder = tmp_path_factory.mktemp("sf")
    labels = [(i, 0 if "%" in (t or "") else 1, 0) for i, t, *_ in rows if i is not None and i % 2]
    spark.createDataFrame(labels, LABELS).write.parquet(str(folder / "labels.parquet"))
    path = str(folder / "documents.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return rows, spark.read.parquet(path), str(folder)


def counted(df) -> Counter:
    return Counter((r.doc_id, r.text, r.source) for r in df.collect())


def test_quality_stage(spark, table):
    rows, docs, folder = table
    got = corpus_pipeline.quality_filter(spark, docs, folder)
    assert got.columns == docs.columns
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    weighed = quality.select(docs, labels).collect()
    k = sum(r.selected for r in weighed)
    keys = sorted((r.key for r in weighed), reverse=True)
    plain = Counter(r.doc_id for r in weighed if r.key >= keys[k - 1])
    kept = counted(got)
    assert Counter(d for d, _, _ in kept.elements()) == plain and not kept - counted(docs)
    # rows that share an id are drawn by their own weights: junk goes, good text stays
    good = [t for t in (t or "" for _, t, *_ in rows) if t.startswith("w")]
    assert sum((t or "").startswith("w") for _, t, _ in kept.elements()) >= 0.95 * len(good)
    assert sum("%" in (t or "") for _, t, _ in kept.elements()) <= 1


def test_exact_stage(spark, table):
    rows, docs, folder = table
    best: dict = {}
    for row in rows:
        t, key = row[1] or "", (row[0] is not None, row[0] or 0)
        if t not in best or key > best[t][0]:
            best[t] = (key, row[0])
    got = corpus_pipeline.exact_filter(spark, docs, folder)
    assert got.columns == docs.columns
    assert sorted((r.text or "", r.doc_id) for r in got.collect()) == sorted((t, i) for t, (_, i) in best.items())


def test_near_stage(spark, table):
    rows, docs, folder = table
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    component = reachable([t or "" for _, t, *_ in order], 5, 80)
    want = Counter((r[0], r[1] or "") for k, r in enumerate(order) if component[k] == k)
    got = corpus_pipeline.near_filter(spark, docs, folder)
    assert got.columns == docs.columns and Counter((r.doc_id, r.text or "") for r in got.collect()) == want


def plain_mix(rows: list[tuple], ids: list) -> list[tuple[float, int]]:
    """(position, row) of each epoch taken."""
    size = [len((r[1] or "").split()) for r in rows]
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(n for n, r in zip(size, rows, strict=True) if r[3] == s) for s in sources}
    weight = {s: k % 3 + 1 for k, s in enumerate(sources)}
    capped: set = set()
    while True:
        rest = sum(total.values()) - sum(3 * total[s] for s in capped)
        share = {s: rest * weight[s] / sum(weight[x] for x in sources if x not in capped) for s in sources if s not in capped}
        over = {s for s, x in share.items() if x > 3 * total[s]}
        if not over:
            break
        capped |= over
    target = {s: 3 * total[s] if s in capped else share[s] for s in sources}
    out = []
    for rank, s in enumerate(sources):
        mine = sorted((k for k, r in enumerate(rows) if r[3] == s), key=lambda k: (hashlib.md5(str(ids[k]).encode()).hexdigest(), ids[k], size[k]))
        whole, place = int(target[s] // total[s]) if total[s] else 0, 0
        for k in mine:
            epochs = whole + (whole < 3 and place + size[k] / 2 <= target[s] - whole * total[s]) if size[k] else 0
            for turn in range(epochs):
                due = min(1.0, (turn * total[s] + place + size[k] / 2) / max(target[s], 1e-9))
                knots = mixing.SCHEDULES[rank % 3]
                (_, w0), (_, w1) = knots
                lo, hi = 0.0, 1.0
                for _ in range(60):  # the time by which the schedule's integral is due
                    mid = (lo + hi) / 2
                    lo, hi = (mid, hi) if w0 * mid + (w1 - w0) * mid * mid / 2 < due * (w0 + w1) / 2 else (lo, mid)
                out.append((lo, k))
            place += size[k]
    return sorted(out)


def test_mix_stage(spark, table):
    rows, docs, folder = table
    got = corpus_pipeline.mix(spark, docs, folder)
    assert got.columns == docs.columns
    seen = [(r.doc_id, r.text, r.source) for r in got.collect()]
    if len({r[0] for r in rows}) == len(rows):
        want = plain_mix(rows, [r[0] for r in rows])
        assert [d for d, _, _ in seen] == [rows[k][0] for _, k in want]
    else:
        # rows have numbers of their own: each is taken at most three times, and sources reach their targets
        numbered, key = corpus_pipeline.keyed(spark, docs)
        order = sorted(((r[key], (r.doc_id, r.text, r.lang, r.source, r.n_chars)) for r in numbered.collect()))
        want = plain_mix([r for _, r in order], [k for k, _ in order])
        assert seen == [(order[k][1][0], order[k][1][1], order[k][1][3]) for _, k in want]


def test_pack_stage(spark, table, tmp_path):
    rows, docs, folder = table
    corpus_pipeline.mix(spark, docs, folder).write.parquet(str(tmp_path / "mixed"))
    mixed = spark.read.parquet(str(tmp_path / "mixed"))
    got = corpus_pipeline.pack(spark, mixed, folder).collect()
    files = mixed.selectExpr("doc_id", "text", "_metadata.file_name f", "_metadata.row_index i").collect()
    want = Counter()
    for f in {r.f for r in files}:
        sizes = [len((r.text or "").split()) for r in sorted((r for r in files if r.f == f), key=lambda r: r.i)]
        place, sized = packing.best_fit([n for n in sizes if n], packing.LENGTHS)
        held = [[] for _ in sized]
        for n, b in zip((n for n in sizes if n), place, strict=True):
            held[b].append(n)
        want.update((x, tuple(sorted(h))) for x, h in zip(sized, held, strict=True))
    bins: dict = {}
    for r in got:
        if r.bin_id is not None:
            bins.setdefault((r.bin_id, r.seq_len), []).append(r.n_words)
    assert Counter((x, tuple(sorted(h))) for (_, x), h in bins.items()) == want
    assert sum(r.n_words for r in got) == sum(len((r.text or "").split()) for r in files)


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None)], [(None, "", None, None, None)] * 3], ids=["empty", "null text", "null ids"])
def test_odd_tables(spark, rows, tmp_path):
    spark.createDataFrame([], LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.quality_filter(spark, docs, str(tmp_path)).count() == len(rows)
    assert corpus_pipeline.exact_filter(spark, docs, "").count() == min(1, len(rows))
    assert corpus_pipeline.near_filter(spark, docs, "").count() == len(rows)
    assert corpus_pipeline.mix(spark, docs, "").count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
