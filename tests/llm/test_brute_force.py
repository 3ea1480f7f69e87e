"""Operators against plain versions of themselves."""

from __future__ import annotations

import hashlib
import os
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strophe.llm import ann, chat, neardup, packing, quality, queries, suffix


@settings(max_examples=150, deadline=None)
@given(st.binary(min_size=1, max_size=80).map(lambda b: bytes(97 + x % 3 for x in b)))
def test_suffix_array(raw):
    t = np.frombuffer(raw, np.uint8)
    want = sorted(range(len(raw)), key=lambda i: raw[i:])
    sa = suffix.suffix_array(t, 256)
    assert sa.tolist() == want
    assert suffix.suffix_array(t.astype(np.int64), 5000).tolist() == want
    lcp = suffix.permuted_lcp(t, sa)
    for a, b in zip(want[1:], want, strict=False):
        assert lcp[a] == len(os.path.commonprefix((raw[a:], raw[b:])))


def test_suffix_array_of_long_ascents():
    """Large alphabets with leftmost-smaller substrings too long to sort directly."""
    t = np.concatenate([np.arange(2000, 2700), [1500], np.arange(2000, 2700), [1500], np.arange(2000, 2650), [7], np.arange(2000, 2700)]).astype(np.int64)
    sa = suffix.suffix_array(t, 5000)
    assert sa.tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())


def test_suffix_dedup_of_a_crowded_passage(spark):
    """One passage in most documents, next to other text each time, and texts that repeat a short period."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    passage = " ".join(word() for _ in range(60))
    texts = [" ".join(word() for _ in range(rng.randint(0, 30))) + passage[:rng.randint(150, len(passage))] + rng.choice("xy") + " ".join(word() for _ in range(rng.randint(0, 12))) for _ in range(150)]
    texts += ["ab" * rng.randint(60, 300) + word() for _ in range(12)] + [passage] * 3
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for crowded in (20_000, 900):
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.remove_repeats(df, shard_bytes=20_000, crowded=crowded).collect()}
        assert [got[i] for i in range(len(texts))] == removed(texts, 100)


def test_removed_spans(spark):
    rng = random.Random(7)
    own = ["".join(rng.choice("abcdefgh ") for _ in range(260)) for _ in range(4)]
    texts = [own[0], own[1] + own[0][40:200], own[2], own[2], "short", "é" * 80 + own[3], own[3] * 2]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans: dict = {}
    for r in suffix.removed_spans(df).collect():
        spans.setdefault(r.doc_id, []).append((r.start, r.stop))
    for i, (size, gone, _, digest) in enumerate(removed(texts, 100)):
        kept = bytearray(texts[i].encode())
        marks = bytearray(size)
        for a, b in spans.get(i, []):
            marks[a:b] = b"\x01" * (b - a)
        assert sum(marks) == gone and hashlib.sha256(bytes(x for x, m in zip(kept, marks, strict=True) if not m)).hexdigest() == digest
    assert suffix.removed_spans(df.limit(0)).count() == 0


def removed(texts: list[str], width: int) -> list[tuple[int, int, int, str]]:
    seen, out = set(), []
    for t in texts:
        b = t.encode()
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if (w := b[i:i + width]) in seen:
                gone[i:i + width] = b"\x01" * width
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((len(b), sum(gone), len(re.findall(b"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("crowded", [2_000_000, 3000, 600])
def test_suffix_dedup(spark, crowded):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    passage = " ".join(rng.choice(words) for _ in range(40))
    texts = []
    for k in range(60):
        own = " ".join(rng.choice(words) for _ in range(rng.randint(1, 120)))
        texts.append(f"{own} {passage[k % 20:]} {own[::-1]}" if k % 3 else own * (1 + k % 2))
    texts += texts[:5] + ["z" * 500, "zy" * 300, "short"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.remove_repeats(df, shard_bytes=20_000, crowded=crowded).collect()}
    assert [got[i] for i in range(len(texts))] == removed(texts, 100)


def shingles(text: str, k: int) -> frozenset:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def reachable(texts: list[str], k: int, percent: int) -> list[int]:
    sets = [shingles(t, k) for t in texts]
    label = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            n = len(a & sets[j])
            if n and 100 * n >= percent * len(a | sets[j]) and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return label


def edited(text: str, rng: random.Random, n: int) -> str:
    w = text.split(" ")
    for _ in range(n):
        w[rng.randrange(len(w))] = f"new{rng.randrange(9999)}"
    return " ".join(w)


def near_texts(seed: int) -> list[str]:
    rng = random.Random(seed)
    base = [" ".join(f"w{rng.randrange(500)}" for _ in range(n)) for n in (150, 150, 60, 20, 5, 3)]
    texts = []
    for b in base:
        texts += [edited(b, rng, rng.randint(0, max(1, len(b.split()) // 22))) for _ in range(35)]
        chain = b
        for _ in range(15):
            chain = edited(chain, rng, 2)
            texts.append(chain)
    shared = " ".join(f"p{i}" for i in range(50))
    texts += [" ".join(f"q{rng.randrange(10 ** 6)}" for _ in range(70)) + " " + shared for _ in range(60)]
    rng.shuffle(texts)
    return [*texts, texts[0], texts[1].upper(), "", "one", "One"]


@pytest.mark.parametrize("crowded", [8192, 6])
def test_near_dedup(spark, monkeypatch, crowded):
    monkeypatch.setattr(neardup, "SIGNATURE_BLOCK", 32)
    texts = near_texts(5)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in neardup.near_dedup(df, 4, 80, crowded=crowded).collect()}
    assert [got[i].n_shingles for i in range(len(texts))] == [len(shingles(t, 4)) for t in texts]
    assert [got[i].component_id for i in range(len(texts))] == reachable(texts, 4, 80)


def test_blocks_of_a_large_cluster(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 16)
    monkeypatch.setattr(neardup, "LEADERS", 0)
    texts = near_texts(8)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in neardup.near_dedup(df, 5, 80).collect()}
    assert [got[i] for i in range(len(texts))] == reachable(texts, 5, 80)


def test_index_meets_every_pair_within_the_distance():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 16, (200, neardup.POSITIONS)).astype(np.uint16)
    b = a.copy()
    for row in b:
        row[rng.choice(neardup.POSITIONS, 2 * neardup.CHUNKS - 1, replace=False)] ^= 1
    import pyarrow as pa

    def keys(sig):
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(sig)), pa.int64()), pa.array(neardup.packed(sig), pa.binary())], names=["uid", "sig"])
        out = [set() for _ in sig]
        for r in neardup.index_keys(iter([batch])):
            for k, u in zip(r.column(0).to_pylist(), r.column(1).to_pylist(), strict=True):
                out[u].add(k)
        return out

    assert all(x & y for x, y in zip(keys(a), keys(b), strict=True))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=60))
def test_best_fit(sizes):
    place, sized = packing.best_fit(sizes, (16, 40, 100), lambda x: 3 + x)
    held = [0] * len(sized)
    for s, b in zip(sizes, place, strict=True):
        held[b] += s
    assert all(h <= c for h, c in zip(held, sized, strict=True)) and all(c == min(x for x in (16, 40, 100) if x >= h) for h, c in zip(held, sized, strict=True))
    one = sum(3 + min(x for x in (16, 40, 100) if x >= s) for s in sizes)
    assert sum(3 + c for c in sized) <= max(one, 0)


def test_recall(spark):
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(12, 24))
    x = (centers[rng.integers(0, 12, 3000)] + rng.normal(size=(3000, 24)) * 0.6).astype(np.float32)
    x[100:400] = x[100]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = ann.nearest(df, F.col("vec_id") % 50 == 0, 5, shard=700).collect()
    n = x.astype(float)
    n /= np.linalg.norm(n, axis=1, keepdims=True)
    hit = 0
    for q in range(0, 3000, 50):
        s = n @ n[q]
        s[q] = -9
        want = set(np.lexsort((np.arange(3000), -np.round(s, 12)))[:5].tolist())
        hit += len(want & {r.vec_id for r in got if r.query_id == q})
    assert hit / 300 >= 0.9


def test_kth_largest(spark):
    values = [5, -3, 5, 0, 9, -(1 << 62), (1 << 62), 5]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    assert [quality.kth_largest(df, "v", k) for k in range(1, 9)] == sorted(values, reverse=True)
    assert quality.kth_largest(df, "v", 9) is None


def test_quality_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op4_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    good, bad = got.where("quality = 1"), got.where("quality = 0")
    assert good.where("selected").count() >= 0.99 * good.count() and bad.where("not selected").count() >= 0.9 * bad.count()


@pytest.mark.parametrize(
    ("template", "names", "want"),
    [
        ("{{ 'a' + 'b' ~ 1 }}{# gone #}", {}, [("ab1", False)]),
        ("{% if x == 'y' %}yes{% elif x %}some{% else %}no{% endif %}", {"x": "z"}, [("some", False)]),
        ("{% for m in ms %}{% if not loop.first %}, {% endif %}{% generation %}{{ m.a | up }}{% endgeneration %}{% endfor %}.", {"ms": [{"a": "q"}, {"a": "r"}]}, [("Q", True), (", ", False), ("R", True), (".", False)]),
        ("{% if false %}{{ x }}{% endif %} {{- ' t' }}", {}, [(" t", False)]),
        ("{{ '}}' + \"%}\" }}{% if\n  x == '%}' %}yes{% endif\n%}{# it's {{ open #}", {"x": "%}"}, [("}}%}", False), ("yes", False)]),
    ],
)
def test_templates(template, names, want):
    assert list(chat.compile_template(template, {"up": str.upper})(names)) == want


@pytest.mark.parametrize("template", ["{{ x.__class__ }}", "{{ _x }}", "{{ f() }}", "{% while x %}{% endwhile %}", "{% for x in y %}", "{{ x | nothing }}", "{{ 'open }}", "{% endif %}", "text {% if x", "{{ x"])
def test_sandbox(template):
    with pytest.raises((chat.TemplateError, IndexError)):
        chat.compile_template(template, {})


def test_folding():
    tree = chat.fold(chat.parse("{{ 'a' + 'b' }}c{% if true %}d{{ 'e' }}{% endif %}"), {})
    assert tree == ("block", [("text", "abcde")])


@settings(max_examples=200, deadline=None)
@given(st.text("<|\\im_endstart>\nx"), st.text("<|\\im_endstart>\nx"))
def test_round_trip(role, text):
    assert chat.unescape(chat.escape(text)) == text and chat.unescape_line(chat.escape_line(role)) == role and "<|" not in chat.escape(text)
    out = chat.compile_template(chat.TEMPLATE, chat.FILTERS)({"messages": [{"role": role, "text": text}, {"role": "assistant", "text": text}]})
    got = list(chat.read_back((c, on) for t, on in out for c in t))
    assert [(r, t, x) for r, t, x, _ in got] == [(role, text, text if role == "assistant" else ""), ("assistant", text, text)]
