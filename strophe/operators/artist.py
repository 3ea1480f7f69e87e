"""Folds of songs into artists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strophe.functions.text import sung, token_array
from strophe.functions.words import DEMOS
from strophe.operators.classify import holds_any
from strophe.operators.song import kept, share, word_counts


def mean(ratio):
    """Mean of ratios of 4 decimals, rounded half to even; null without values.

    Added as whole ten-thousandths, so that no order of addition can change it.
    """
    c = F.col(ratio) if isinstance(ratio, str) else ratio
    return F.rint(F.sum(F.round(c * 10000).cast("long")) / F.count(c)) / 10000


def counted_songs(songs: DataFrame) -> DataFrame:
    """``song_id, artist, title, lang, wc, uniq, ttr`` of songs that have words, from arrays in the row."""
    w = kept(songs.select("song_id", "artist", "title", "lang", token_array(sung(songs["lyrics"])).alias("w")), F.size("w") > 0)
    w = w.select("song_id", "artist", "title", "lang", F.size("w").alias("n"), F.size(F.array_distinct("w")).alias("u"))
    return w.select("song_id", "artist", "title", "lang", F.col("n").cast("long").alias("wc"), F.col("u").cast("long").alias("uniq"), share(F.col("u"), F.col("n")).alias("ttr"))


def highlight_parts(least: int = 80) -> list:
    """Aggregates that ``highlight_columns`` reads: the records of eligible songs and of all."""
    fit = (F.col("wc") >= least) & ~holds_any(F.lower("title"), DEMOS)

    def best(value, ok):
        return F.max(F.when(ok, F.struct(value.alias("v"), (-F.col("song_id")).alias("o"), F.col("wc").alias("words"))))

    return [best(v, ok).alias(f"_{name}{k}") for k, ok in ((0, fit), (1, F.lit(True))) for name, v in (("l", F.col("wc")), ("s", -F.col("wc")), ("r", F.col("ttr")))]


def highlight_columns() -> list:
    pick = lambda name: F.coalesce(f"_{name}0", f"_{name}1")
    second = lambda c: -c.getField("o")
    return [second(pick("l")).alias("longest_song"), pick("l").getField("words").alias("longest_words"), second(pick("s")).alias("shortest_song"), second(pick("r")).alias("richest_song")]


def highlights(counted: DataFrame, least: int = 80) -> DataFrame:
    """``artist, longest_song, longest_words, shortest_song, richest_song``; ties go to the smaller id.

    Songs of at least ``least`` words whose title doesn't mark a demo compete;
    if an artist has none, all do. Both cases are one aggregation.
    """
    return counted.groupBy("artist").agg(*highlight_parts(least)).select("artist", *highlight_columns())


def vocabulary(tokens: DataFrame) -> DataFrame:
    """``artist, total_unique_words, top_word, top_word_n``; ties go to the first use by song and place.

    A first use is one number (song, then place), so that it is found in hash
    maps, and only words that tie for the top are put in order.
    """
    at = F.col("song_id").cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(11,0)") + F.col("pos").cast("decimal(11,0)")
    words = tokens.groupBy("artist", "word").agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("f"))
    return words.groupBy("artist").agg(F.count(F.lit(1)).alias("total_unique_words"), F.max(F.struct("n", -F.col("f"), "word")).alias("w")).select("artist", "total_unique_words", F.col("w.word").alias("top_word"), F.col("w.n").alias("top_word_n"))


def artist_fold(songs: DataFrame, tokens: DataFrame) -> DataFrame:
    """Each artist's catalogue in one row: sizes, variety, most used word, highlights.

    Averages are of the songs' rounded ratios. The most used word's ties go to
    the first use by song and place.
    """
    sums = counted_songs(songs).groupBy("artist").agg(F.count(F.lit(1)).alias("song_count"), F.sum("wc").alias("total_words"), mean("ttr").alias("t"), *highlight_parts())
    out = sums.join(vocabulary(tokens), "artist")
    return out.select(
        "artist", "song_count", "total_words", "total_unique_words",
        F.bround(F.col("total_words") / F.col("song_count"), 4).alias("words_per_song"), F.col("t").alias("avg_ttr"), "top_word", "top_word_n", *highlight_columns(),
    )


def artist_top_words(tokens: DataFrame, k: int = 100, stop: tuple[str, ...] | None = None, first: int = 400) -> DataFrame:
    """``artist, rank, word, uses``; with ``stop`` the ``first`` most used are filtered, then cut to ``k``."""
    return most_used(word_counts(tokens, "artist"), k, stop, first)


def most_used(counts: DataFrame, k: int = 100, stop: tuple[str, ...] | None = None, first: int = 400) -> DataFrame:
    """``artist_top_words`` of ``counts``: ``artist, word, uses``."""
    order = W.partitionBy("artist").orderBy(F.desc("uses"), "word")
    ranked = counts.withColumn("r", F.row_number().over(order))
    if stop is None:
        return ranked.where(F.col("r") <= k).select("artist", F.col("r").cast("long").alias("rank"), "word", "uses")
    left = ranked.where(F.col("r") <= first).where(~F.col("word").isin(*stop))
    return left.withColumn("rank", F.row_number().over(W.partitionBy("artist").orderBy("r")).cast("long")).where(F.col("rank") <= k).select("artist", "rank", "word", "uses")


def language_mix(songs: DataFrame, k: int = 3) -> DataFrame:
    """``artist, rank, lang, share``: the most used languages, of the songs that have one."""
    n = songs.where("lang is not null").groupBy("artist", "lang").agg(F.count(F.lit(1)).alias("n"))
    one = W.partitionBy("artist")
    ranked = n.withColumn("rank", F.row_number().over(one.orderBy(F.desc("n"), "lang")).cast("long")).withColumn("share", F.bround(F.col("n") / F.sum("n").over(one), 3))
    return ranked.where(F.col("rank") <= k).select("artist", "rank", "lang", "share")


def density_curve(curves: DataFrame, least: int = 5) -> DataFrame:
    """``artist, part, share``: words in each tenth of an artist's songs together, if at least ``least`` songs have a curve."""
    parts = curves.select("artist", "song_id", F.posexplode("curve").alias("part", "n")).groupBy("artist", "part").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("songs"))
    total = F.sum("n").over(W.partitionBy("artist"))
    return parts.withColumn("share", F.bround(F.col("n") / total, 3)).where(F.col("songs") >= least).select("artist", F.col("part").cast("long").alias("part"), "share")


def album_rollup(counted: DataFrame, tokens: DataFrame, least: int = 3, k: int = 12) -> DataFrame:
    """``artist, album, songs, words, unique_words, avg_ttr, avg_wpm`` of the ``k`` largest albums of ``least`` songs (``lang`` stands for the album)."""
    sums = counted.groupBy("artist", "lang").agg(F.count(F.lit(1)).alias("songs"), F.sum("wc").alias("words"), mean("ttr").alias("avg_ttr"), mean("wpm").alias("avg_wpm")).where(F.col("songs") >= least)
    vocabulary = tokens.select("artist", "lang", "word").distinct().groupBy("artist", "lang").agg(F.count(F.lit(1)).alias("unique_words"))
    ranked = sums.join(vocabulary, ["artist", "lang"]).withColumn("r", F.row_number().over(W.partitionBy("artist").orderBy(F.desc("songs"), "lang")))
    return ranked.where(F.col("r") <= k).select("artist", F.col("lang").alias("album"), "songs", "words", "unique_words", "avg_ttr", "avg_wpm")


def catalogue_list(counted: DataFrame, k: int = 500) -> DataFrame:
    """``artist, place, song_id, wc, uniq``: the longest songs first, at most ``k``."""
    place = F.row_number().over(W.partitionBy("artist").orderBy(F.desc("wc"), "song_id"))
    return counted.withColumn("place", place.cast("long")).where(F.col("place") <= k).select("artist", "place", "song_id", "wc", "uniq")


def texture(readings: DataFrame, drops: DataFrame, least: int = 40) -> DataFrame:
    """Averages and records of an artist's readings: hook, repetition, line marks, longest word, career line, title drops."""
    r = readings.join(drops, "song_id")
    big = F.col("wc") >= least
    return r.groupBy("artist").agg(
        mean("hook").alias("avg_hook"), mean("rep").alias("avg_rep"),
        mean("q").alias("avg_q"), mean("excl").alias("avg_excl"), mean("one_word").alias("avg_one_word"),
        F.max(F.struct(F.length("longest_word"), -F.col("song_id"), "longest_word")).getField("longest_word").alias("longest_word"),
        F.max(F.when(F.col("top_line_n") > 0, F.struct("top_line_n", -F.col("song_id"), "top_line"))).getField("top_line").alias("career_line"),
        F.sum("drops").alias("title_drops_total"),
        (-F.max(F.when(big, F.struct("hook", -F.col("song_id")))).getField("col2")).alias("hookiest_song"),
        (-F.max(F.when(big & (F.col("drops") > 0), F.struct("drops", -F.col("song_id")))).getField("col2")).alias("biggest_title_drop"),
    )


def backfill_years(rows: DataFrame, legacy: DataFrame) -> DataFrame:
    """``rows`` (with ``key``) and the ``year`` of the last legacy row (``key, year, ord``) of that key."""
    years = legacy.where("year is not null").groupBy("key").agg(F.max_by("year", "ord").alias("year"))
    return rows.drop("year").join(years, "key", "left")


def merge_catalogues(dataset: DataFrame, live: DataFrame) -> DataFrame:
    """``artist, title_key, song_id, wc, ttr, chorus, has_sections, source``: the union by title, where live rows win."""
    cols = ("artist", "title_key")
    fields = ("song_id", "wc", "ttr", "chorus", "has_sections")
    d = dataset.select(*cols, F.struct(*fields).alias("d"))
    v = live.select(*cols, F.struct(*fields).alias("v"))
    both = d.join(v, list(cols), "full_outer")
    return both.select(*cols, *(F.coalesce(f"v.{f}", f"d.{f}").alias(f) for f in fields), F.when(F.col("v").isNotNull(), "live").otherwise("dataset").alias("source"))


def merged_summary(merged: DataFrame) -> DataFrame:
    """``artist, songs, live_songs, total_words, avg_ttr, avg_chorus``: the chorus average is over songs with sections."""
    return merged.groupBy("artist").agg(
        F.count(F.lit(1)).alias("songs"), F.count_if(F.col("source") == "live").alias("live_songs"), F.sum("wc").alias("total_words"),
        mean("ttr").alias("avg_ttr"), mean(F.when(F.col("has_sections"), F.col("chorus"))).alias("avg_chorus"),
    )
