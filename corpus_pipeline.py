"""A corpus pipeline of five stages, each one operator of ``strophe.llm``.

``run(spark, sf_dir)`` applies the stages to ``documents``; each result is
written as Parquet and read again as the next stage's input. All stages but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strophe.llm import exact, mixing, neardup, packing, quality
from strophe.llm.common import Tables


def own_ids(docs: DataFrame) -> bool:
    """Whether each row has an id of its own."""
    return docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty()


def keyed(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a key for each row: the id, or a number in order of id and text where rows share an id or have none."""
    if own_ids(docs):
        return docs, "doc_id"
    numbered = docs.sort(F.col("doc_id").asc_nulls_first(), F.coalesce("text", F.lit(""))).withColumn("_row", F.monotonically_increasing_id())
    return Tables(spark, "pipeline").write(numbered), "_row"  # written, as the numbers must stay as they are


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Importance resampling against the labelled good text; rejected documents go, each row on its own."""
    columns, (docs, key) = docs.columns, keyed(spark, docs)
    chosen = quality.select(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), carry=("_row",) if key == "_row" else ())
    chosen = chosen.where("selected").select(F.col(key).alias("_id"))
    return docs.join(chosen, docs[key] == chosen["_id"], "left_semi").select(*columns)


def exact_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, the one with the largest id stays; of rows that repeat that id too, one."""
    columns = docs.columns
    kept = exact.exact_dedup(docs).where("kept")
    if own_ids(docs):
        return kept.select(*columns)
    one = kept.where("group_size > 1").groupBy("text_sha256").agg(F.min(F.struct(*columns)).alias("row")).select("row.*")
    return kept.where("group_size = 1").select(*columns).union(one)


def near_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates (five-word shingles, similarity 0.8 or more), the one with the smallest id stays."""
    columns, (docs, key) = docs.columns, keyed(spark, docs)
    kept = neardup.near_dedup(docs, words=5, percent=80, id_col=key).where("kept").select(F.col("doc_id").alias("_id"))
    return docs.join(kept, docs[key] == kept["_id"], "left_semi").select(*columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights along the curriculum: a document once for each epoch it is taken."""
    columns, (docs, key) = docs.columns, keyed(spark, docs)
    return mixing.training_stream(docs, mixing.plan_mixture(docs, id_col=key), id_col=key).select(*columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of permitted lengths, packed along the order of training.

    The stage before wrote range-sorted files, so a file's number and a row's
    place in it give the order.
    """
    number = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("long")
    return packing.pack(docs.select("doc_id", "text", number.alias("file"), F.col("_metadata.row_index").alias("row")), group_col="file", order_col="row")


STAGES = [("quality classifier", quality_filter), ("exact dedup", exact_filter), ("near dedup", near_filter), ("mix sources", mix), ("pack", pack)]

#: SQL can't express the trained classifier of the first stage; tests/llm/test_pipeline.py compares each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    tables = Tables(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = tables.write(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
