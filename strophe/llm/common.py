"""What several operators of this folder share."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strophe.sources.scratch import Tables, components, shared_dir, small_batches

__all__ = ["WORD", "Tables", "components", "ordered", "shared_dir", "ship", "small_batches", "text_parts"]

#: A word, by the contracts of this folder: a run of anything but ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"


def ship(name: str) -> None:
    """Send the worker functions of module ``name`` by value.

    Executors then need no copy of this package on their path.
    """
    cloudpickle.register_pickle_by_value(sys.modules[name])


def text_parts(text: pa.Array, limit: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, UTF-8 bytes and byte counts of groups of texts of about ``limit`` bytes, without a copy.

    A group holds at least one text and at most 4,096; null counts as empty.
    """
    wide = pa.types.is_large_string(text.type)
    _, offsets, data = text.buffers()
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[text.offset:text.offset + len(text) + 1].astype(np.int64) if len(text) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    at = 0
    while at < len(text):
        take = max(1, int(np.searchsorted(ends[at + 1:at + 4097] - ends[at], limit, "right")))
        yield at, raw[ends[at]:ends[at + take]], np.diff(ends[at:at + take + 1])
        at += take


def ordered(docs: DataFrame, tables: Tables, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """``uid, doc_id, text`` with a unique uid in the order of the ids; whether the id is the uid.

    The id itself if it is unique and not null. Otherwise rows are numbered in
    order of id (nulls first) and text, so of rows that share an id the one
    with the smaller text counts as the earlier.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if rows.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        return rows.select(F.col("doc_id").alias("uid"), "doc_id", "text"), True
    return tables.write(rows.sort(F.col("doc_id").asc_nulls_first(), "text").select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text")), False


ship(__name__)
