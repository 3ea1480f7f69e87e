"""The method of each operator against a plain version of it."""

from __future__ import annotations

import hashlib
import random
import re
from urllib.parse import urljoin, urlsplit

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strophe.llm import ann, exact, packing, quality, secrets, urls
from strophe.llm.common import Tables


def plain_node(url: str | None) -> str:
    if not url or "://" not in url:
        return ""
    u = urlsplit(url)
    return u.netloc.lower() + (u.path or "/") + (f"?{u.query}" if u.query else "") if u.netloc else ""


@pytest.mark.parametrize("seed", [1, 2])
def test_aliases_of_random_link_graphs(spark, seed):
    rng = random.Random(seed)
    hosts = ["a.example", "B.example", "c.example"] * 6 + ["bad.example", "bad.example", "www.ok.example"]
    paths = ["", "/", "/x/", "/x/y", "/x/y/z.html", "/v", *(f"/p{i}/r" for i in range(12))]
    asks = ["", "?id=1", "?id=2", "?q=a/b"]
    make = lambda: f"{rng.choice(['http', 'https'])}://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(asks)}{rng.choice(['', '#top'])}"
    near = ["../w", "..", "./u", "?id=2", "z", "../../x/y", "/v?id=1", "//c.example/x/", "y/./q/../z.html", "#part", "mailto:me@a.example", "z?q=../r"]
    rules = [("block", "bad.example", "/x/"), ("allow", "ok.example", "/")]
    pages, edges = [], []
    for k in range(160):
        url = make() if rng.random() < 0.95 else rng.choice([None, "no scheme", ""])
        html, base = rng.choice([None, "", "<p>none</p>"]), url
        if url and "://" in url and rng.random() < 0.5:
            html = ""
            if rng.random() < 0.2:
                html, base = '<base href="/x/y/">', urljoin(url, "/x/y/")
            target = rng.choice(near) if rng.random() < 0.5 else make()
            html += f'<link rel="canonical" href="{target}">' if rng.random() < 0.6 else f"<meta http-equiv='refresh' content='0; url={target}'>"
            edges.append((url, urljoin(base, target)))
        pages.append((k, url, html))
    given = [(make(), make()) for _ in range(15)] + [(None, make()), (make(), None)]
    label: dict[str, str] = {}

    def find(x: str) -> str:
        while label.setdefault(x, x) != x:
            x = label[x]
        return x

    def rule(url: str | None) -> str | None:
        if not url or "://" not in url:
            return None
        u, best = urlsplit(url), None
        for kind, host, path in rules:
            h = u.netloc.lower()
            if (h == host or h.endswith("." + host)) and u.path.startswith(path):
                best = kind
        return best

    for u, v in edges + given:
        if plain_node(u) and plain_node(v):
            label[find(plain_node(u))] = find(plain_node(v))
    says: dict[str, set] = {}
    for n in list(label):
        says.setdefault(find(n), set()).add(rule("http://" + n))
    want = {}
    for k, url, _ in pages:
        group = says.get(find(plain_node(url)), set()) if plain_node(url) else set()
        want[k] = rule(url) or ("allow" if "allow" in group else "block" if "block" in group else "allow")
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    more = spark.createDataFrame(given, "from_url string, to_url string")
    got = {r.page_id: r.verdict for r in urls.judge_urls(df, rules, more).collect()}
    assert got == want and sum(v == "block" and rule(u) is None for (_, u, _), v in zip(pages, want.values(), strict=True)) >= 1


def test_exact_dedup_shuffles_no_text(spark):
    df = spark.createDataFrame([(i, "same " * 50 if i % 3 else f"own {i} " * 50) for i in range(300)], "doc_id long, text string")
    plan = exact.exact_dedup(df).select("doc_id", "keep_id")._jdf.queryExecution().executedPlan().toString()
    assert all("text#" not in line.replace("text_sha256#", "") for line in plan.splitlines() if "Exchange hashpartitioning" in line)
    got = exact.exact_dedup(df).collect()
    assert {(r.keep_id, r.group_size, r.kept) for r in got if r.doc_id % 3} == {(299, 200, False), (299, 200, True)}
    assert all(r.keep_id == r.doc_id and r.group_size == 1 for r in got if r.doc_id % 3 == 0)


def least_cost(sizes: list[int], lengths: tuple[int, ...], price) -> float:
    """Of all ways to deal the sizes to bins."""
    best = [float("inf")]

    def deal(i: int, bins: list[int]) -> None:
        if i == len(sizes):
            best[0] = min(best[0], sum(min(price(x) for x in lengths if x >= b) for b in bins))
            return
        for k in range(len(bins)):
            if bins[k] + sizes[i] <= max(lengths):
                bins[k] += sizes[i]
                deal(i + 1, bins)
                bins[k] -= sizes[i]
        deal(i + 1, [*bins, sizes[i]])

    deal(0, [])
    return best[0]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=7), st.sampled_from([lambda x: 3.0 + x, lambda x: x + x * x / 50, lambda x: 10.0 + x**0.5]))
def test_best_fit_near_the_optimum(sizes, price):
    lengths = (16, 40, 100)
    place, sized = packing.best_fit(sizes, lengths, price)
    held = [sum(s for s, b in zip(sizes, place, strict=True) if b == k) for k in range(len(sized))]
    assert all(h <= x for h, x in zip(held, sized, strict=True)) and sum(held) == sum(sizes)
    assert all(price(x) == min(price(y) for y in lengths if y >= h) for h, x in zip(held, sized, strict=True))
    least = least_cost(sizes, lengths, price)
    assert least - 1e-9 <= sum(map(price, sized)) <= 1.35 * least


def test_best_fit_opens_by_cost():
    rng = random.Random(6)
    over = []
    for _ in range(60):
        sizes = [rng.randint(1, 60) for _ in range(7)]
        price = lambda x: 3.0 + x + x * x / 400
        _, sized = packing.best_fit(sizes, (16, 40, 100), price)
        over.append(sum(map(price, sized)) / least_cost(sizes, (16, 40, 100), price))
    assert sum(over) / len(over) < 1.04
    # long bins that cost no more than short ones are opened, and shrunk only if that is cheaper
    assert packing.best_fit([10] * 10, (16, 100), lambda x: 1.0)[1] == [16] * 0 + [packing.best_fit([10] * 10, (16, 100), lambda x: 1.0)[1][0]]
    assert sorted(packing.best_fit([10] * 10, (16, 100), lambda x: float(x) ** 2)[1]) == [16] * 10


def test_packing_is_the_same_on_any_number_of_partitions(spark):
    rows = [(i % 40, None if i % 50 == 0 else "w " * (i * 37 % 300)) for i in range(900)] + [(7, "same " * 30)] * 300
    df = spark.createDataFrame(rows, "doc_id long, text string")
    key = "spark.sql.shuffle.partitions"
    before, seen = spark.conf.get(key), []
    for n in ("3", "11"):
        spark.conf.set(key, n)
        seen.append(sorted(map(tuple, packing.pack(df.repartition(int(n)), (64, 128, 256), block=64).collect()), key=str))
    spark.conf.set(key, before)
    assert seen[0] == seen[1]
    got = packing.pack(df, (64, 128, 256), block=64).collect()
    assert sum(r.n_words for r in got) == sum(len((t or "").split()) for _, t in rows)
    assert sum(r.doc_id == 7 and r.n_words == 30 for r in got) >= 300
    bins: dict = {}
    for r in got:
        if r.bin_id is not None:
            bins.setdefault((r.bin_id, r.seq_len), []).append(r.n_words)
    assert all(sum(v) <= size for (_, size), v in bins.items()) and len({b for b, _ in bins}) == len(bins)
    assert len({b >> 32 for b, _ in bins}) > 5


def test_draws_follow_the_weights(spark):
    weights = (1.0, 2.0, 6.0)
    rows = [(i, float(np.log(weights[i % 3]))) for i in range(30_000)]
    df = spark.createDataFrame(rows, "doc_id long, log_ratio double")
    got = quality.gumbel_top_k(df, 900, 5, Tables(spark, "test")).where("selected").select(F.pmod("doc_id", F.lit(3)).alias("w")).groupBy("w").count().collect()
    n = {r.w: r["count"] for r in got}
    assert sum(n.values()) == 900
    # without replacement, from so many rows, nearly in proportion: 100, 200 and 600 are expected
    assert all(abs(n[k] - 900 * w / 9) < 4 * (900 * w / 9) ** 0.5 for k, w in enumerate(weights))
    again = quality.gumbel_top_k(df.repartition(7), 900, 5, Tables(spark, "test")).where("selected")
    other = quality.gumbel_top_k(df, 900, 6, Tables(spark, "test")).where("selected")
    first = {r.doc_id for r in quality.gumbel_top_k(df, 900, 5, Tables(spark, "test")).where("selected").collect()}
    assert {r.doc_id for r in again.collect()} == first and {r.doc_id for r in other.collect()} != first


def plain_ratio(docs, target, buckets):
    """The two models and the mean log ratio, text by text."""
    raw, good = np.ones(buckets), np.zeros(buckets)
    grams = {d: quality.features([(t or "").encode()], buckets)[0] for d, t in docs}
    for d, g in grams.items():
        for b in g:
            raw[b] += 1
            good[b] += d in target
    out = {}
    for d, g in grams.items():
        z = 0.0
        for b in g:
            half = slice(0, buckets // 2) if b < buckets // 2 else slice(buckets // 2, buckets)
            r = raw[b] / raw[half].sum()
            z += np.log((good[b] / good[half].sum() + quality.SMOOTH * r) / (1 + quality.SMOOTH)) - np.log(r)
        out[d] = quality.PASSAGE * z / len(g) if len(g) else 0.0
    return out


def test_weights_equal_plain_models(spark):
    rng = random.Random(1)
    docs = [(i, " ".join(rng.choice(["river", "moss", "Stone", "a1", "!!", "the"]) for _ in range(rng.randint(0, 30)))) for i in range(60)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(60)], "doc_id long, quality int, toxic int")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    target = {r.doc_id for r in quality.fit_sample(labels, 100).collect() if r.good and not r.test}
    want = plain_ratio(docs, target, 1 << 8)
    got = {r.doc_id: r.log_ratio for r in quality.select(df, labels, keep=0.5, buckets=1 << 8).collect()}
    assert all(abs(got[d] - want[d]) < 1e-5 for d, _ in docs)
    assert quality.select(df, labels, keep=0.5).where("selected").count() == 30
    # the table of n-grams grows with the corpus
    assert quality.bucket_count(df) == 1 << 14 and quality.bucket_count(df.select("doc_id", F.repeat("text", F.lit(30_000)).alias("text"))) > 1 << 16


def test_secrets_found_and_left_alone(spark):
    """Hand-labelled lines held out from the training, and the tokens planted in the documents."""
    model = secrets.train(secrets.training_findings(spark))
    rows = secrets.reviewed_findings(spark, True)
    rows = rows.withColumns(secrets.features(F.col("value"), F.col("word"), F.coalesce("before", F.lit("")), F.col("source")))
    got = rows.select("secret", (secrets.forest_expression(model) > 0.5).alias("hit")).collect()
    hits, true, both = sum(r.hit for r in got), sum(r.secret > 0 for r in got), sum(r.hit and r.secret > 0 for r in got)
    assert true == 20 and both / hits >= 0.8 and both / true >= 0.9
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = {(r.doc_id, r.secret_sha256) for r in secrets.scan(docs, model=model).where("is_secret").collect()}
    planted = {(r.doc_id, hashlib.sha256(m.encode()).hexdigest()) for r in docs.collect() for m in re.findall(r'(?i)token = "([0-9a-f]{40})"', r.text or "")}
    assert planted and planted <= found and len(found - planted) <= 1


def test_short_and_marked_values_are_candidates(spark):
    texts = ['password = "S3cr3t!pass"', "DB_PASS: x", "my pwd=Nx9$kQ2!vv; then", "the auth token is abc%def&12", "a password policy", None, ""]
    df = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "doc_id long, text string, source string")
    assert {(r.doc_id, r.value) for r in secrets.candidates(df).collect()} == {(0, "S3cr3t!pass"), (2, "Nx9$kQ2!vv"), (3, "abc%def&12")}


def test_recall_at_the_production_shard(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    x = table.toPandas().drop_duplicates("vec_id").sort_values("vec_id")
    ids = x.vec_id.to_numpy()
    n = np.array(x.embedding.tolist(), float)
    n /= np.linalg.norm(n, axis=1, keepdims=True)
    hit = total = 0
    got: dict = {}
    for r in ann.nearest(table, F.col("vec_id") % 50 == 0, 5).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    for at in np.flatnonzero(ids % 50 == 0):
        s = n @ n[at]
        s[at] = -9
        want = set(ids[np.lexsort((ids, -np.round(s, 12)))[:5]].tolist())
        hit, total = hit + len(want & got[ids[at]]), total + 5
    assert hit / total >= 0.95


def test_scaled_and_huge_vectors(spark):
    vecs = [(0, [1e200, 1e200]), (1, [1.0, 1.0]), (2, [1e-200, 2e-200]), (3, [-1e300, 1e300]), (4, [3.0, 3.0])] + [(i, [float(i), float(i)]) for i in range(5, 60)]
    df = spark.createDataFrame(vecs, "vec_id long, embedding array<double>")
    got = ann.nearest(df, F.col("vec_id") == 0, 5).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [1, 4, 5, 6, 7] and all(abs(r.score - 1) < 1e-12 for r in got)
