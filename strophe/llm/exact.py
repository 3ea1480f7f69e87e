"""Exact deduplication by progressive refinement (DataFrame functions only).

Rows are split by byte length, then by a hash of a short prefix; only rows
that still have company are hashed whole and split by SHA-256. Each step works
on a narrow table of numbers, and a whole text is hashed where it is scanned:
no text is shuffled to find the groups. Which rows are still in company is told
to the scan by a bitmap of fixed size (``BITS`` hash values), so a row that is
alone passes without a hash and without a shuffle; the exact joins that follow
see only the rows that the bitmap lets through. Every count is combined before
its shuffle and every join is one that AQE can split, so one text may hold any
share of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strophe.llm.common import Tables

#: Hash values told apart by the bitmap (1 MB of bits), and those in one of its rows, which Spark fixes.
BITS, ROW_BITS = 1 << 23, 1 << 15


def bitmap(keys: DataFrame, key: str) -> DataFrame:
    """``_row, _bits``: a bitmap of the hash values of a long column, at most ``BITS / ROW_BITS`` rows of 4 KB."""
    place = F.pmod(F.col(key), F.lit(BITS)) + 1
    return keys.groupBy(F.bitmap_bucket_number(place).alias("_row")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("_bits"))


def marked(rows: DataFrame, key: str, bits: DataFrame) -> DataFrame:
    """``rows`` with ``_mark``: whether the bitmap may hold the value of ``key``. A broadcast of bounded size, no shuffle."""
    place = F.pmod(F.col(key), F.lit(BITS)) + 1
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    mark = F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
    return rows.withColumn("_row", F.bitmap_bucket_number(place)).join(F.broadcast(bits), "_row", "left").withColumn("_mark", mark).drop("_row", "_bits")


def whole(text_col: str) -> Column:
    return F.coalesce(F.col(text_col), F.lit(""))


def short_hash(sha256: Column) -> Column:
    """The first 60 bits of a hex digest as a number."""
    return F.conv(F.left(sha256, F.lit(15)), 16, 10).cast("long")


def repeated_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = 64) -> DataFrame:
    """``(text_sha256, keep_id, group_size)`` of each text that occurs more than once.

    Null texts count as empty. ``keep_id`` is the largest id (null only if all
    are null). Repeated rows count as often as they stand. No rows in: no rows
    out. ``prefix`` is only a filter: survivors are compared in full.
    """
    tables = Tables(docs.sparkSession, "exact")
    text = whole(text_col)
    n = F.octet_length(text)
    # the second key holds the first, so each refinement deals its rows anew
    keys = {"_n": n, "_p": F.xxhash64(n, F.left(text, F.lit(prefix)))}
    probe = tables.write(docs.select(*(c.alias(k) for k, c in keys.items())).groupBy("_n", "_p").agg(F.count(F.lit(1)).alias("_c")))
    # counts are written before they are joined: so AQE can split a length or prefix of very many rows
    lengths = tables.write(probe.groupBy("_n").agg(F.sum("_c").alias("_c")).where("_c > 1").select("_n"))
    prefixes = tables.write(probe.where("_c > 1").join(lengths, "_n", "left_semi").select("_p"))
    rows = marked(docs.select(F.col(id_col).alias("_id"), text.alias("_text"), keys["_p"].alias("_p")), "_p", tables.write(bitmap(prefixes, "_p")))
    hashed = rows.where("_mark").select("_id", "_p", F.sha2("_text", 256).alias("text_sha256"))
    return (
        hashed.groupBy("_p", "text_sha256").agg(F.max("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1").join(prefixes, "_p", "left_semi").select("text_sha256", "keep_id", "group_size")
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = 64) -> DataFrame:
    """``docs`` with ``text_sha256``, ``keep_id``, ``group_size`` and ``kept``.

    ``kept`` marks the rows whose id is the largest of their text's; rows that
    repeat both id and text are all marked. Columns of these names in ``docs``
    are replaced. Rows whose text stands alone are not shuffled.
    """
    added = ["text_sha256", "keep_id", "group_size", "kept"]
    tables = Tables(docs.sparkSession, "exact")
    # written before it is joined, so that AQE can split a text of very many rows
    groups = tables.write(repeated_texts(docs, id_col, text_col, prefix))
    rows = docs.drop(*(c for c in added if c not in (id_col, text_col))).withColumn("text_sha256", F.sha2(whole(text_col), 256)).withColumn("_short", short_hash(F.col("text_sha256")))
    rows = marked(rows, "_short", tables.write(bitmap(groups.select(short_hash(F.col("text_sha256")).alias("_short")), "_short"))).drop("_short")
    alone = rows.where("not _mark").withColumns({"keep_id": F.lit(None).cast(docs.schema[id_col].dataType), "group_size": F.lit(None).cast("long")})
    both = rows.where("_mark").join(groups, "text_sha256", "left").select(*alone.columns).union(alone)
    return (
        both.drop("_mark").withColumn("group_size", F.coalesce("group_size", F.lit(1)).cast("long"))
        .withColumn("keep_id", F.when(F.col("group_size") > 1, F.col("keep_id")).otherwise(F.col(id_col)))
        .withColumn("kept", F.col(id_col).eqNullSafe(F.col("keep_id")))
    )
