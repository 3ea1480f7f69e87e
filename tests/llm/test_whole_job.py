"""Inputs on which an operator once did less than its whole job."""

from __future__ import annotations

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from strophe.llm import ann, quality


@pytest.mark.parametrize("kind", ["jitter 1e-3", "jitter 1e-5", "scaled"])
def test_neighbours_in_a_hot_group(spark, kind):
    rng = np.random.default_rng(8)
    one = rng.normal(size=32)
    if kind == "scaled":
        x = one * rng.uniform(0.1, 9, (1500, 1))
    else:
        x = one * (1 + float(kind.split()[1]) * rng.normal(size=(1500, 32)))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.nearest(df, F.col("vec_id") % 100 == 0, 5, shard=1000).collect()
    n = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = 0
    for q in range(0, 1500, 100):
        far = np.round(np.linalg.norm(n - n[q], axis=1), 12)
        far[q] = 9
        want = np.lexsort((np.arange(1500), far))[:5].tolist()
        hit += len(set(want) & {r.vec_id for r in got if r.query_id == q})
    assert hit / 75 >= 0.97


def test_quality_with_wrong_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{name}.parquet") for name in ("documents", "labels"))
    wrong = [r.doc_id for r in labels.where("quality = 0").orderBy("doc_id").limit(4).collect()]  # one per cent
    told = labels.withColumn("quality", F.when(F.col("doc_id").isin(wrong), 1).otherwise(F.col("quality")))
    got = quality.select(docs, told).join(labels, "doc_id")
    good, bad = got.where("quality = 1"), got.where("quality = 0")
    assert good.where("selected").count() >= 0.99 * good.count() and bad.where("not selected").count() >= 0.9 * bad.count()


def test_pipeline_rows_that_share_an_id(spark):
    prose = " ".join(f"word{i % 97} of the {i * i % 1013} tale" for i in range(400))
    rows = [(7, prose, "a"), (7, prose, "a"), (7, prose, "b"), (7, prose + " the end", "a"), (7, "other text", "a"), (None, prose + " at last", "a"), (None, "alone", "a"), (8, "alone too", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    exact = corpus_pipeline.exact_filter(spark, docs, "").collect()
    assert sorted(r.text for r in exact) == sorted({t for _, t, _ in rows}) and exact[0].__fields__ == docs.columns
    near = corpus_pipeline.near_filter(spark, spark.createDataFrame(exact, docs.schema), "").collect()
    assert sorted((r.doc_id or 0, r.text) for r in near) == [(0, "alone"), (0, prose + " at last"), (7, "other text"), (8, "alone too")]
    again = corpus_pipeline.near_filter(spark, docs, "").collect()
    assert sorted((r.doc_id or 0, r.text) for r in again) == [(0, "alone"), (0, prose + " at last"), (7, "other text"), (8, "alone too")]
