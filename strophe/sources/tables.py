"""Readers, and the text-catalogue views over the driver's tables.

Operators work on views with the columns named here, so any table that can be
projected onto them will do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def balanced(df: DataFrame) -> DataFrame:
    """Spreads input of fewer files than the cluster has cores.

    A small file has one row group and so one task with rows, however many
    splits it is planned in. Input of many splits or files is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() > 4 * cores or len(df.inputFiles()) >= cores:
        return df
    return df.repartition(cores)


def songs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``song_id, artist, lang, lyrics, title``: documents as songs, the first line as title."""
    docs = balanced(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text"))
    return docs.select(F.col("doc_id").alias("song_id"), F.col("source").alias("artist"), "lang", F.col("text").alias("lyrics"), F.substring_index("text", "\n", 1).alias("title"))


def timed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``song_id, at, words``: events as lines with a time in seconds and a word count."""
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("song_id"), seconds.alias("at"), (F.col("event_id") % 9 + 1).alias("words"))


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, columns: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Quoted multi-line CSV with a header; malformed rows are dropped, ``columns`` are pruned at the scan."""
    df = spark.read.csv(path, schema=schema, header=True, multiLine=True, escape='"', mode="DROPMALFORMED")
    df = df.select(*columns) if columns else df
    return df.limit(limit) if limit else df


def read_tsv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A hand-kept table: tab-separated strings without header, ``#`` starts a comment."""
    return spark.read.csv(path, sep="\t", comment="#", schema=T.StructType([T.StructField(c, T.StringType()) for c in columns]))


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines, gzip included; unknown keys are ignored and missing ones are null."""
    return spark.read.json(path, schema=schema)


def read_json_config(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A hand-kept JSON file: one object, or an array of them, over many lines."""
    return spark.read.json(path, schema=schema, multiLine=True)


def rows_of_keys(df: DataFrame, keys: DataFrame, *columns: str) -> DataFrame:
    """The rows of ``df`` whose key is listed; a semi-join, which AQE broadcasts if the list is small."""
    return df.join(keys.select(*columns).distinct(), list(columns), "left_semi")


def read_jdbc(spark: SparkSession, url: str, query: str, fetch: int = 2000, **options: str) -> DataFrame:
    """A query of a database, read in batches of ``fetch`` rows (needs the driver's jar)."""
    return spark.read.format("jdbc").options(url=url, query=query, fetchsize=str(fetch), **options).load()


def describe_tables(tables: dict[str, DataFrame]) -> DataFrame:
    """``table_name, column_name, type, rows`` of each column, for a look at a new dump."""
    out = None
    for name, df in tables.items():
        cols = F.array(*(F.struct(F.lit(c).alias("c"), F.lit(t).alias("t")) for c, t in df.dtypes))
        one = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), F.explode(cols).alias("x"), "rows").select("table_name", F.col("x.c").alias("column_name"), F.col("x.t").alias("type"), "rows")
        out = one if out is None else out.union(one)
    return out
