"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from strophe.llm import ann, chat, exact, mixing, neardup, packing, quality, secrets, suffix, urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, group_size string, size string, uid string, anchor string, label string, key string, position string"
TAIL = ("x",) * 8
PROSE = " ".join(f"word{i % 97} of the {i * i % 1013} tale" for i in range(400))
LONG = " ".join(f"w{i}" for i in range(30_000))


def rows():
    texts = [(1, PROSE), (2, None), (3, ""), (4, "   \n\t "), (5, "one"), (6, PROSE), (7, PROSE), (7, PROSE), (8, LONG), (9, "é" * 150 + " ünï"), (None, "no id"), (None, None), (10, "same same"), (10, "other text"), (11, "a b\x00c"), (12, "ab" * 400)]
    return [(i, t, None if i == 5 else "en", None if i in (2, 9) else f"s{(i or 0) % 3}", None, *TAIL) for i, t in texts]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


LABELS = "doc_id long, quality int, toxic int"


def test_exact(docs, none):
    got = exact.exact_dedup(docs).collect()
    assert len(got) == len(rows())
    by = [(r.doc_id, r.text) for r in got if r.kept]
    assert (7, PROSE) in by and (1, PROSE) not in by and (6, PROSE) not in by
    assert {(r.doc_id, r.keep_id, r.group_size) for r in got if (r.text or "") == ""} == {(2, 3, 3), (3, 3, 3), (None, 3, 3)}
    assert all(r.text_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest() for r in got)
    assert exact.exact_dedup(none).count() == 0


def test_near(docs, none):
    got = neardup.near_dedup(docs, 4).collect()
    assert len(got) == len(rows())
    assert [r.component_id for r in got if r.doc_id in (1, 6, 7)] == [1, 1, 1, 1]
    assert sum(r.kept for r in got if r.doc_id in (1, 6, 7)) == 1
    assert sorted(r.n_shingles for r in got if r.doc_id in (2, 3, 4)) == [0, 0, 0]
    assert {r.n_shingles for r in got if r.doc_id == 5} == {1}
    assert neardup.near_dedup(none, 4).count() == 0


def test_suffix(docs, none):
    got = sorted(suffix.remove_repeats(docs).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.n_removed))
    assert len(got) == len(rows())
    n = len(PROSE.encode())
    first = next(r for r in got if r.doc_id == 1)
    assert first.n_removed < n and all(r.n_removed == n and r.n_spans == 1 for r in got if r.doc_id in (6, 7))
    assert next(r for r in got if r.doc_id == 12).n_removed == 798  # all but the first period
    assert all(r.n_bytes == 0 for r in got if r.doc_id in (2, 3))
    assert suffix.remove_repeats(none).count() == 0


def test_mixing(docs, none):
    got = mixing.plan_mixture(docs).collect()
    assert len(got) == len(rows())
    assert all(r.taken <= 3 * r.size for r in got) and all(r.taken == 0 for r in got if not r.size)
    for source in {r.source for r in got}:
        own = [r for r in got if r.source == source]
        assert len({r.target for r in own}) == 1 and abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own)
    assert mixing.plan_mixture(none).count() == 0
    stream = mixing.training_stream(docs.where("doc_id not in (7, 10)"), mixing.plan_mixture(docs.where("doc_id not in (7, 10)")))
    assert stream.columns == docs.columns and stream.count() > 0


def test_packing(docs, none):
    got = packing.pack(docs).collect()
    words = {r: len((t or "").split()) for r, t in ((1, PROSE), (8, LONG), (3, ""))}
    for d, n in words.items():
        own = sorted((r.start, r.n_words) for r in got if r.doc_id == d)
        assert sum(x for _, x in own) == n and all(a + x == b for (a, x), (b, _) in zip(own, own[1:], strict=False))
    bins = {}
    for r in got:
        if r.bin_id is not None:
            bins.setdefault((r.bin_id, r.seq_len), []).append(r.n_words)
    assert all(sum(v) <= size and size in packing.LENGTHS for (_, size), v in bins.items())
    assert packing.pack(none).count() == 0


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(1, 1, 0), (8, 0, 0), (6, None, 0), (None, 1, 1), (7, 1, 0), (7, 0, 0)], LABELS)
    got = quality.select(docs, labels).collect()
    assert len(got) == len(rows()) and all(r.log_ratio == 0 for r in got if r.doc_id in (2, 3, 4))
    assert all(r.selected for r in quality.select(docs, spark.createDataFrame([], LABELS)).collect())
    assert quality.select(none, labels).count() == 0
    assert len([r for r in quality.select(docs, labels, keep=5).collect() if r.selected]) >= 5


def test_secrets(docs, none, spark):
    model = secrets.train(secrets.labelled_findings(spark, 600), trees=5)
    got = secrets.scan(docs, model=model).collect()
    assert {r.doc_id for r in got} <= {12}
    key = "f33e61083db5dbdf4bd2369d2f80176e57f7fda2"
    one = spark.createDataFrame([(1, f'my token = "{key}"', None)], "doc_id long, text string, source string")
    assert [(r.secret_sha256, r.is_secret) for r in secrets.scan(one, model=model).collect()] == [(hashlib.sha256(key.encode()).hexdigest(), True)]
    assert secrets.scan(none, model=model).count() == 0


def test_chat(spark):
    schema = "conv_id long, turn long, role string, text string, part string, trained string"
    convs = [(1, 0, "user", "<|im_start|>hi\\<|x"), (1, 1, "assistant", None), (1, None, None, "first"), (2, 0, "assistant", "a"), (2, 0, "assistant", "a"), (None, 0, "role\nwith \\n line", "x<"), (3, 5, "assistant", "long " * 50_000)]
    df = spark.createDataFrame([(*c, "p", "q") for c in convs], schema)
    got = {r.conv_id: r for r in chat.chat_digests(df).collect()}
    assert {k: r.n_turns for k, r in got.items()} == {1: 3, 2: 2, None: 1, 3: 1}
    turns = "\nfirst\nuser\n<|im_start|>hi\\<|x\nassistant\n\n"
    assert got[1].turns_sha256 == hashlib.sha256(turns.encode()).hexdigest()
    assert got[None].turns_sha256 == hashlib.sha256(b"role\nwith \\n line\nx<\n").hexdigest()
    assert got[2].loss_sha256 == hashlib.sha256(b"aa").hexdigest() and got[3].loss_chars == 250_000
    text = "".join(r.text for r in sorted(chat.format_chats(df.where("conv_id = 2")).collect(), key=lambda r: r.part))
    assert text == "<|im_start|>assistant\na<|im_end|>\n" * 2
    assert chat.chat_digests(spark.createDataFrame([], schema)).count() == 0


def test_urls(spark):
    schema = "page_id long, url string, html string, host string, verdict string"
    rules = [("block", "bad.example", "/x/"), ("allow", "ok.example", "/")]
    pages = [
        (1, "http://BAD.example/x/1?q", None), (2, "https://a.example/p", '<link rel="canonical" href="http://bad.example/x/1">'), (3, None, ""), (4, "no scheme", "x"),
        (5, "http://b.example/", '<meta http-equiv="refresh" content="0; url=https://a.example/p#top">'), (6, "http://sub.ok.example/y", "<LINK href='http://bad.example/x/1' rel=canonical>"),
        (7, "http://c.example/d/e", '<link rel="canonical" href="/d/e">'), (7, "http://c.example/d/e", None),
    ]
    df = spark.createDataFrame([(*p, "h", "v") for p in pages], schema)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(df, rules).collect()}
    assert got[1] == ("bad.example", "/x/1", "bad.example/x/", "block")
    assert got[6][2:] == ("ok.example/", "allow")
    assert got[2][2:] == (None, "allow") and got[5][2:] == (None, "allow")  # an allowed alias takes precedence
    assert got[3] == ("", "", None, "allow") and got[4] == ("", "", None, "allow")
    only = df.where("page_id <> 6")
    assert {r.page_id: r.verdict for r in urls.judge_urls(only, rules).collect()} == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "block", 7: "allow"}
    assert urls.judge_urls(df.limit(0), rules).count() == 0
    more = spark.createDataFrame([("http://c.example/d/e", "http://bad.example/x/1")], "from_url string, to_url string")
    assert {r.verdict for r in urls.judge_urls(only, rules, more).where("page_id = 7").collect()} == {"block"}


def test_neighbours(spark):
    schema = "vec_id long, embedding array<float>, label int, shard string, ids string"
    vecs = [(50, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (8, [1.0, 0.1]), (100, [1.0]), (None, [1.0, 0.0]), (9, [float("inf"), 0.0]), (10, []), (1, [1.0, 0.0]), (11, [-1.0, 0.0]), (12, [1e30, 0.0])]
    df = spark.createDataFrame([(*v, 1, "s", "i") for v in vecs], schema)
    got = ann.nearest(df, F.col("vec_id") % 50 == 0, 5).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in got] == [(50, 1, 1), (50, 2, 2), (50, 3, 12), (50, 4, 8), (50, 5, 3)]
    assert ann.nearest(df.limit(0), F.col("vec_id") % 50 == 0, 5).count() == 0
