"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight and a schedule that says how the weight changes over
the training run. The weight fixes how many words the source gives (its
target); the schedule's integral is the share of them due by any time, so its
inverse turns a document's place in its source's stream into a training
position. Documents are then sorted by position, by range.

Places are prefix sums over a hash order, taken in two levels (blocks of the
hash, then rows in a block), so no task holds a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strophe.llm.common import WORD, Tables

#: Copies of one row in a part.
ALIKE = 4096
#: Schedules by source rank, in turn: knots (time, relative weight), linear in between.
RISING, FALLING, LEVEL = ((0.0, 0.5), (1.0, 1.5)), ((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0))
SCHEDULES = (RISING, FALLING, LEVEL)


def when_due(share: Column, knots: tuple[tuple[float, float], ...]) -> Column:
    """The time by which a schedule has called for ``share`` of its words.

    The integral of a linear piece is a quadratic; its root in the piece is
    taken in the form that is stable for level pieces too.
    """
    pieces, total = [], 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
        pieces.append((t0, t1, w0, w1, total))
        total += (t1 - t0) * (w0 + w1) / 2
    due = share * F.lit(total)
    out = F.lit(float(knots[-1][0]))
    for t0, t1, w0, w1, before in reversed(pieces):
        y, slope = due - F.lit(before), (w1 - w0) / (t1 - t0)
        root = F.lit(t0) + F.lit(2.0) * y / (F.lit(w0) + F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2.0 * slope) * y, F.lit(1e-300))))
        end = before + (t1 - t0) * (w0 + w1) / 2
        out = F.when(due <= F.lit(end), F.least(root, F.lit(float(t1)))).otherwise(out)
    return F.greatest(out, F.lit(float(knots[0][0])))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """``(source, rank, weight, source_size, target)`` from ``sizes(source, size)``.

    Sources by code point, null last, take ``weights`` in turn and share the
    sum of all sizes. No target exceeds ``most`` times its source's size; the
    excess goes to the others by weight until none is above. In closed form:
    by growing cap per weight, sources are capped as long as the level of the
    rest is above their cap. Sums are integers, so engines agree to the bit.
    """
    one = W.orderBy(F.col("source").asc_nulls_last())
    src = sizes.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("source_size"))
    src = src.withColumn("rank", F.row_number().over(one) - 1)
    src = src.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("long"))
    src = src.withColumn("cap", F.lit(most) * F.col("source_size"))
    order = W.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("rank"))
    before, every = order.rowsBetween(W.unboundedPreceding, -1), W.partitionBy(F.lit(0))
    src = src.withColumns({
        "rest": F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0)),
        "rest_weight": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
        "place": F.row_number().over(order),
    })
    free = F.col("rest") * F.col("weight") <= F.col("cap") * F.col("rest_weight")
    src = src.withColumn("level", F.min(F.when(free, F.struct("place", "rest", "rest_weight"))).over(every))
    target = F.when(F.col("place") < F.col("level.place"), F.col("cap").cast("double")).otherwise((F.col("level.rest") * F.col("weight")).cast("double") / F.col("level.rest_weight").cast("double"))
    return src.select("source", "rank", "weight", "source_size", target.alias("target"))


def plan_mixture(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, schedules=SCHEDULES, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", hash_digits: int = 3) -> DataFrame:
    """One row per row of ``docs``: what the mix takes of it, and when.

    ``doc_id, source, size, source_size, target, epochs, taken, position``
    (of the first epoch; null if none), and ``place`` and ``rank`` for
    ``training_stream``. A source gives whole epochs, then documents in hash
    order until its target is reached, the last one if at least half of it
    fits; so no document is taken more than ``most`` times. Null text: size 0.
    Null source: a source of its own, the last. Rows repeated in the input are
    rows of their own. ``hash_digits``: blocks of the prefix sums, in hex
    digits.

    Texts are read once, for their sizes. Rows alike in id, source and size
    are counted before anything is put in order, so an id (or none) that very
    many rows share is one row of the prefix sums; very many copies of one
    row are dealt to tasks in parts of ``ALIKE``.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"))
    rows = Tables(docs.sparkSession, "mixing").write(rows.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("copies")))
    rows = rows.withColumn("h", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
    rows = rows.withColumn("block", F.left("h", F.lit(hash_digits)))
    words = F.col("size") * F.col("copies")
    blocks = rows.groupBy("source", "block").agg(F.sum(words).alias("s"))
    before = W.partitionBy("source").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select(F.col("source").alias("_s"), F.col("block").alias("_b"), F.coalesce(F.sum("s").over(before), F.lit(0)).alias("ahead"))
    goals = source_targets(rows.select("source", words.alias("size")), weights, most).withColumnRenamed("source", "_s")
    ahead = blocks.join(goals, blocks["_s"].eqNullSafe(goals["_s"])).drop(goals["_s"])
    inside = W.partitionBy("source", "block").orderBy("h", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("inner", F.coalesce(F.sum(words).over(inside), F.lit(0)))
    rows = rows.join(ahead, rows["source"].eqNullSafe(ahead["_s"]) & (rows["block"] == ahead["_b"]))
    rows = each_copy(rows.withColumn("start", F.col("ahead") + F.col("inner")))
    place = F.col("start") + F.col("size") * F.col("copy")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rows = rows.withColumns({"place": place, "whole": whole})
    part = (F.col("place") + F.col("size") / 2.0) <= (F.col("target") - F.col("whole") * F.col("source_size"))
    rows = rows.withColumn("epochs", F.when(F.col("size") > 0, F.col("whole") + F.when(part & (F.col("whole") < most), 1).otherwise(0)).otherwise(0).cast("long"))
    rows = rows.withColumn("taken", F.col("epochs") * F.col("size"))
    first = due_time(F.col("place") + F.col("size") / 2.0, schedules)
    rows = rows.withColumn("position", F.when(F.col("epochs") > 0, first))
    return rows.select("doc_id", "source", "size", "source_size", "target", "epochs", "taken", "position", "place", "rank")


def each_copy(rows: DataFrame) -> DataFrame:
    """A row for each of ``copies``, numbered from 0 in ``copy``; parts of many copies are dealt before they are spread out."""
    few = rows.where(F.col("copies") <= ALIKE).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    parts = rows.where(F.col("copies") > ALIKE).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / ALIKE))))
    first = F.col("_part") * ALIKE
    many = parts.repartition("doc_id", "size", "_part").withColumn("copy", F.explode(F.sequence(first, F.least(first + ALIKE, F.col("copies")) - 1))).drop("_part")
    return few.union(many.select(*few.columns))


def due_time(words: Column, schedules=SCHEDULES) -> Column:
    """Training position of the word with this number in its source's stream."""
    share = F.least(F.greatest(words / F.greatest(F.col("target"), F.lit(1e-9)), F.lit(0.0)), F.lit(1.0))
    out = when_due(share, schedules[-1])
    for k, knots in enumerate(schedules[:-1]):
        out = F.when(F.col("rank") % len(schedules) == k, when_due(share, knots)).otherwise(out)
    return out


def training_stream(docs: DataFrame, plan: DataFrame, schedules=SCHEDULES, id_col: str = "doc_id") -> DataFrame:
    """``docs`` once for each epoch that ``plan`` takes, in order of training position.

    Range-sorted, so the order is global; its columns are those of ``docs``.
    ``id_col`` tells rows apart: rows that share an id are given a number of
    their own first (see ``corpus_pipeline``), as one plan holds for an id.
    """
    one = plan.where("epochs > 0").groupBy(F.col("doc_id").alias("_id")).agg(F.max(F.struct("epochs", "place", "source_size", "size", "target", "rank")).alias("p")).select("_id", "p.*")
    one = one.withColumnsRenamed({c: f"_{c}" for c in ("epochs", "place", "source_size", "size", "target", "rank")})
    turns = one.select("_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_epochs") - 1)).alias("_turn"), F.col("_place").alias("place"), F.col("_source_size").alias("source_size"), F.col("_size").alias("size"), F.col("_target").alias("target"), F.col("_rank").alias("rank"))
    turns = turns.select("_id", due_time(F.col("_turn") * F.col("source_size") + F.col("place") + F.col("size") / 2.0, schedules).alias("_at"))
    out = docs.join(turns, docs[id_col].eqNullSafe(turns["_id"])).sort("_at", id_col)
    return out.select(*(docs[c] for c in docs.columns))
