"""Writes: replace, upsert, patch, trim, restore; each returns or writes a whole new table.

Tables are Parquet; an upsert is an outer join whose result replaces the old
table under a new path, so readers never see a half-written one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def replace_all(df: DataFrame, path: str, key: str, order: list | None = None) -> None:
    """Overwrites ``path`` with one row for each key: the first by ``order``, by default by the other columns, so that reruns keep the same."""
    rest = [c for c in df.columns if c != key and df.schema[c].dataType.typeName() != "map"]
    ranked = df.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(*(order or rest or [key]))))
    ranked.where("_r = 1").drop("_r").write.mode("overwrite").parquet(path)


def ingest(stream: DataFrame, folder: str, keys: list[str], checkpoint: str, valid: str = "true") -> StreamingQuery:
    """Upserts what is available of a stream of rows into a table of versions under ``folder``.

    Rows that don't meet ``valid`` are turned away. Each batch writes the next
    version whole and readers take the last (``last_version``), so a batch
    that is run again writes the same one.
    """
    spark = stream.sparkSession

    def merge(batch: DataFrame, number: int) -> None:
        fresh = batch.where(valid)
        old = spark.read.schema(stream.schema).parquet(f"{folder}/v={number - 1}") if number else spark.createDataFrame([], stream.schema)
        upsert(old, fresh, keys).write.mode("overwrite").parquet(f"{folder}/v={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def last_version(spark: SparkSession, folder: str) -> DataFrame:
    """The newest version that ``ingest`` has written whole."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    names = [f.getPath().getName() for f in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)]
    return spark.read.parquet(f"{folder}/v={max(int(n[2:]) for n in names if n.startswith('v='))}")


def write_partitioned(df: DataFrame, path: str, *columns: str) -> None:
    df.write.mode("overwrite").partitionBy(*columns).parquet(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    """A gzip backup, one object a line."""
    df.write.mode("overwrite").json(path, compression="gzip")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], clear: tuple[str, ...] = ()) -> DataFrame:
    """``old`` with the rows of ``new``: known values win over null, and ``clear`` columns become null where new rows came.

    Rows of ``new`` that repeat a key count once, the last by its other columns.
    """
    rest = [c for c in old.columns if c not in keys]
    given = [c for c in rest if c in new.columns]
    last = new.groupBy(*keys).agg(F.max(F.struct(*given)).alias("_new"), F.lit(True).alias("_came")) if given else new.select(*keys).distinct().withColumn("_came", F.lit(True))
    both = old.join(last, keys, "full_outer")

    def value(c: str):
        kept = F.coalesce(F.col(f"_new.{c}"), F.col(c)) if c in given else F.col(c)
        return (F.when(F.col("_came"), F.lit(None).cast(old.schema[c].dataType)).otherwise(kept) if c in clear else kept).alias(c)

    return both.select(*keys, *(value(c) for c in rest)).select(*old.columns)


def fill_missing(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Two tables by natural key; blanks of the left are filled from the right, rows of either stay."""
    rest = [c for c in left.columns if c not in keys]
    both = left.join(right.select(*keys, F.struct(*rest).alias("_o")), keys, "full_outer")
    filled = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")) if left.schema[c].dataType.typeName() == "string" else F.col(c), F.col(f"_o.{c}")).alias(c)
    return both.select(*keys, *map(filled, rest))


def patch_maps(df: DataFrame, patches: DataFrame, key: str, column: str) -> DataFrame:
    """Entries of a string map column replaced or added by ``patches`` of the same shape."""
    p = patches.select(key, F.col(column).alias("_p"))
    merged = F.map_concat(F.map_filter(column, lambda k, _: ~F.coalesce(F.map_contains_key("_p", k), F.lit(False))), F.coalesce("_p", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))))
    return df.join(p, key, "left").withColumn(column, F.when(F.col("_p").isNull(), F.col(column)).otherwise(merged)).drop("_p")


def trim_for_serving(df: DataFrame, drop: list[str], caps: dict[str, int]) -> DataFrame:
    """Without heavy columns, and arrays cut to what a page shows."""
    return df.drop(*drop).withColumns({c: F.slice(c, 1, n) for c, n in caps.items()})


def remove_listed(df: DataFrame, listed: DataFrame, key: str, canonical: str | None = None) -> DataFrame:
    """Without the listed rows; a row whose canonical name is missing from the table stays."""
    gone = listed
    if canonical:
        gone = listed.join(df.select(F.col(key).alias(canonical)).distinct(), canonical, "left_semi")
    return df.join(gone.select(key).distinct(), key, "left_anti")


def restore_missing(backup: DataFrame, target: DataFrame, local: DataFrame, key: str) -> DataFrame:
    """Rows of a backup that the target lacks and the local table still knows."""
    return backup.join(target.select(key), key, "left_anti").join(local.select(key), key, "left_semi")


def size_report(df: DataFrame, column: str, cutoffs: list[int]) -> DataFrame:
    """Characters of the table as JSON and rows that reach each cut-off of a column."""
    text = F.to_json(F.struct(*df.columns))
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.length(text)).alias("chars"), *(F.count_if(F.col(column) >= c).alias(f"at_least_{c}") for c in cutoffs))
