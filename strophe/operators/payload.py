"""What a reader is shown: a song's payload, an artist's merged catalogue, and how stored readings are kept fresh.

Many requests are answered by one plan: requests are a table, and every lookup
is an equality join on a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strophe.functions.text import name_key, slug, unslug
from strophe.operators.artist import highlight_columns, highlight_parts, mean
from strophe.operators.corpus import place_among

#: Songs of a catalogue that are listed; songs below which a live view is partial; words in a payload's lists.
LISTED, PARTIAL, WORDS = 500, 20, 30
#: What a reading shows, in this order.
READING = ("wc", "uniq", "ttr", "rep", "hook", "top_line", "top_line_n", "q", "excl", "one_word", "rhyme", "longest_word", "awl", "line_count", "line_words", "top_line_at", "once")


def by_key(songs: DataFrame, requests: DataFrame) -> DataFrame:
    """``request_id`` and the song that a name or slug of artist and title names; blank lyrics are passed over.

    ``songs``: ``song_id, artist, title, lyrics``; ``requests``: ``request_id,
    artist, title``. Of several the smallest id.
    """
    asked = requests.select("request_id", name_key(F.col("artist")).alias("_a"), name_key(F.col("title")).alias("_t")).where("_a <> '' and _t <> ''")
    held = songs.where(F.trim("lyrics") != "").withColumns({"_a": name_key(F.col("artist")), "_t": name_key(F.col("title"))})
    first = F.row_number().over(W.partitionBy("request_id").orderBy("song_id"))
    return held.join(asked, ["_a", "_t"]).withColumn("_r", first).where("_r = 1").drop("_a", "_t", "_r")


def listed_rows(rows: DataFrame) -> DataFrame:
    """A stored catalogue: an artist's 500 longest songs with ratios to two decimals (``artist, place, song_id, title, wc, uniq, ttr, rep``)."""
    place = F.row_number().over(W.partitionBy("artist").orderBy(F.desc("wc"), "song_id"))
    two = lambda c: (F.rint(F.round(F.col(c) * 10000) / 100) / 100).alias(c)
    return rows.withColumn("place", place.cast("long")).where(F.col("place") <= LISTED).select("artist", "place", "song_id", "title", "wc", "uniq", two("ttr"), two("rep"))


def song_payloads(requests: DataFrame, listed: DataFrame, live: DataFrame, cuts: DataFrame) -> DataFrame:
    """One row for each request that a text or a stored row answers.

    ``requests``: ``request_id, artist, title`` (names or slugs). ``listed``:
    stored catalogues (``artist, place, title, wc, uniq, ttr, rep``).
    ``live``: texts with figures (``song_id, artist, title, wc, uniq, ttr,
    rep, hook, has_sections``). ``cuts``: ``metric, p, cut``. The text's
    figures are shown where there is a text (``source`` cache), else the
    stored row's (dataset). ``words_...``, ``variety_...`` and
    ``repetition_...`` place the song among its artist's stored songs, and
    ``percentiles`` among the archive's (``metric:percentile``, joined).
    """
    asked = requests.select("request_id", F.col("artist").alias("_artist"), F.col("title").alias("_title"), name_key(F.col("artist")).alias("_a"), name_key(F.col("title")).alias("_t"))
    rows = listed.withColumns({"_a": name_key(F.col("artist")), "_t": name_key(F.col("title"))})
    catalogues = rows.groupBy("_a").agg(F.min("artist").alias("display"), F.count(F.lit(1)).alias("songs"), *(F.sort_array(F.collect_list(c)).alias(f"_{c}s") for c in ("wc", "ttr", "rep")))
    stored = rows.groupBy("_a", "_t").agg(F.min(F.struct("place", "title", "wc", "uniq", "ttr", "rep")).alias("row"))
    texts = live.withColumns({"_a": name_key(F.col("artist")), "_t": name_key(F.col("title"))}).groupBy("_a", "_t").agg(F.min(F.struct("song_id", "artist", "title", "wc", "uniq", "ttr", "rep", "hook", "has_sections")).alias("text"))
    both = asked.join(catalogues, "_a", "left").join(stored, ["_a", "_t"], "left").join(texts, ["_a", "_t"], "left").where("row is not null or text is not null")
    known = lambda c: F.coalesce(F.col(f"text.{c}"), F.col(f"row.{c}"))
    both = both.withColumns({c: known(c) for c in ("wc", "uniq", "ttr", "rep")})
    name = F.coalesce("display", F.when(F.lower("_artist") == F.col("text.artist"), F.col("_artist")).otherwise(F.col("text.artist")), unslug(F.col("_artist")))
    title = F.coalesce("row.title", "text.title", unslug(F.col("_title")))
    out = both.select(
        "request_id", name.alias("artist"), title.alias("title"), F.when(F.col("text").isNotNull(), "cache").otherwise("dataset").alias("source"), F.col("text").isNotNull().alias("complete"),
        "wc", "uniq", "ttr", "rep", F.col("text.hook").alias("hook"), F.coalesce("text.has_sections", F.lit(False)).alias("has_sections"),
        "songs", F.when(F.col("songs").isNotNull(), F.col("row").isNotNull()).alias("in_catalogue"),
        *standing("words", "wc", "_wcs"), *standing("variety", "ttr", "_ttrs"), *standing("repetition", "rep", "_reps"),
        slug(name).alias("artist_slug"), slug(title).alias("title_slug"),
    )
    table = cuts.groupBy("metric").agg(F.sort_array(F.collect_list("cut")).alias("c"))
    table = table.agg(F.map_from_entries(F.collect_list(F.struct("metric", "c"))).alias("_cuts"))  # one row: 101 cuts for each metric

    def percentile(metric: str) -> Column:
        of = F.try_element_at("_cuts", F.lit(metric))
        return F.when(F.col(metric).isNotNull() & of.isNotNull(), F.concat(F.lit(f"{metric}:"), place_among(F.col(metric).cast("double"), of).cast("string")))

    return out.join(F.broadcast(table)).withColumn("percentiles", F.concat_ws(",", *map(percentile, ("wc", "uniq", "ttr", "rep", "hook")))).drop("_cuts")


def standing(name: str, value: str, among: str) -> list[Column]:
    """Rank (1 is the highest) and upper median, lowest and highest of the values that a song stands among."""
    v, all_ = F.col(value), F.col(among)
    some = all_.isNotNull() & (F.size(all_) > 0)
    when = lambda c: F.when(some, c)
    return [
        when(F.size(F.filter(all_, lambda x: x > v)) + 1).cast("long").alias(f"{name}_rank"),
        when(F.get(all_, F.floor(F.size(all_) / 2).cast("int"))).alias(f"{name}_median"),
        when(F.get(all_, F.lit(0))).alias(f"{name}_low"), when(F.element_at(all_, -1)).alias(f"{name}_high"),
    ]


SONG = ("song_id", "title", "wc", "uniq", "ttr", "chorus", "rep", "has_sections")


def merged_songs(listed: DataFrame, live: DataFrame) -> DataFrame:
    """``artist``, a song's columns and ``source``: stored and live songs by title without case, where live ones win.

    ``listed``: ``artist, place`` and a song's columns; of equal titles the
    last counts. ``live``: ``artist`` and a song's columns; of equal titles the
    largest id. Live songs without words don't count.
    """
    key = F.lower(F.trim("title"))
    d = listed.groupBy("artist", key.alias("_t")).agg(F.max_by(F.struct(*SONG), "place").alias("d"))
    v = live.where("wc > 0").groupBy("artist", key.alias("_t")).agg(F.max_by(F.struct(*SONG), "song_id").alias("v"))
    both = d.join(v, ["artist", "_t"], "full_outer")
    return both.select("artist", F.coalesce("v", "d").alias("s"), F.when(F.col("v").isNull(), "dataset").when(F.col("d").isNull(), "new").otherwise("live").alias("source")).select("artist", "s.*", "source")


def bumped(stored: DataFrame, fresh: DataFrame, k: int = WORDS) -> DataFrame:
    """``artist, rank, word, uses``: a stored list of words with the uses of new songs added, for listed words alone.

    ``stored``: ``artist, rank, word, uses``; ``fresh``: ``artist, word,
    uses``. Ties keep the stored order.
    """
    sums = stored.join(fresh.select("artist", "word", F.col("uses").alias("_more")), ["artist", "word"], "left").withColumn("uses", F.col("uses") + F.coalesce("_more", F.lit(0)))
    place = F.row_number().over(W.partitionBy("artist").orderBy(F.desc("uses"), "rank"))
    return sums.withColumn("rank", place.cast("long")).where(F.col("rank") <= k).select("artist", "rank", "word", "uses")


def joined_words(ranked: DataFrame, name: str) -> DataFrame:
    """``artist`` and its ranked words as ``word:uses``, joined by commas."""
    entry = F.struct("rank", F.concat_ws(":", "word", F.col("uses").cast("string")).alias("x"))
    return ranked.groupBy("artist").agg(F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda p: p["x"]), ",").alias(name))


def artist_payloads(totals: DataFrame, merged: DataFrame, words: dict[str, DataFrame], live_sizes: DataFrame) -> DataFrame:
    """One row for each artist: what a page shows of the merged catalogue.

    ``totals``: ``artist, total_words`` of the stored aggregate (artists
    without one are live only). ``merged``: ``merged_songs``. ``words``: lists
    by name (``bumped``). ``live_sizes``: ``artist, n`` live songs with words.
    Words of new songs are added to the stored total; averages are over all
    songs, that of the chorus over songs with sections. A live-only artist of
    fewer than 20 songs is ``limited``.
    """
    sums = merged.groupBy("artist").agg(
        F.count(F.lit(1)).alias("song_count"), F.sum("wc").alias("_all"), F.coalesce(F.sum(F.when(F.col("source") == "new", F.col("wc"))), F.lit(0)).alias("_new"),
        mean("ttr").alias("avg_ttr"), mean("rep").alias("avg_repetition_ratio"), F.coalesce(mean(F.when(F.col("has_sections"), F.col("chorus"))), F.lit(0.0)).alias("avg_chorus_ratio"),
        F.max("has_sections").alias("has_sections"), *highlight_parts(),
    )
    out = sums.join(totals.select("artist", F.col("total_words").alias("_stored")), "artist", "left").join(live_sizes, "artist", "left")
    for name, ranked in words.items():
        out = out.join(joined_words(ranked, name), "artist", "left")
    total = F.when(F.col("_stored").isNull(), F.col("_all")).otherwise(F.col("_stored") + F.col("_new"))
    return out.select(
        "artist", "song_count", total.alias("total_words"), (F.rint(total * 100 / F.col("song_count")) / 100).alias("avg_words_per_song"), "avg_ttr", "avg_chorus_ratio", "avg_repetition_ratio",
        *highlight_columns(), *words, "has_sections", F.when(F.col("_stored").isNull(), "cache").otherwise("dataset").alias("source"),
        (F.col("_stored").isNull() & (F.col("n") < PARTIAL)).alias("limited"), F.when(F.col("_stored").isNull(), F.col("n")).otherwise(F.col("song_count")).alias("cached_total"),
    )


def sorted_catalogue(songs: DataFrame, requests: DataFrame) -> DataFrame:
    """``request_id, place, song_id``: a catalogue filtered by a text and sorted by a field.

    ``songs``: ``artist, song_id, title, album, wc, uniq, ttr``; ``requests``:
    ``request_id, artist, q, field, ascending``, where the field is one of
    title, words, unique and variety. The text is looked for in titles and
    albums, whatever the case; an empty one finds all. Ties: smaller id.
    """
    q = F.lower(F.trim("q"))
    held = F.contains(F.lower("title"), q) | F.contains(F.lower(F.coalesce("album", F.lit(""))), q)
    rows = songs.join(requests, "artist").where((q == "") | held)
    number = F.when(F.col("field") == "words", F.col("wc").cast("double")).when(F.col("field") == "unique", F.col("uniq").cast("double")).when(F.col("field") == "variety", F.col("ttr")).otherwise(0.0)
    name = F.when(F.col("field") == "title", F.lower("title")).otherwise("")
    up = F.col("ascending")
    order = W.partitionBy("request_id").orderBy(F.when(up, number).otherwise(-number), F.when(up, name), F.when(~up, name).desc(), "song_id")
    return rows.select("request_id", F.row_number().over(order).cast("long").alias("place"), "song_id")


def rebuilt_aggregates(stored: DataFrame, live: DataFrame, known_totals: DataFrame) -> DataFrame:
    """``artist, song_count, total_words, avg_words_per_song, avg_ttr, avg_chorus_ratio, avg_repetition_ratio, source``.

    A stored aggregate gives way to one of the live songs if these, or the
    known total, are more than its songs. ``stored`` has the result's columns
    but the source, ``live`` a song's, ``known_totals``: ``artist, total``.
    """
    some = live.where("wc > 0")
    fresh = some.groupBy("artist").agg(F.count(F.lit(1)).alias("n"), F.sum("wc").alias("w"), mean("ttr").alias("t"), mean("chorus").alias("c"), mean("rep").alias("r"))
    both = stored.join(fresh, "artist", "left").join(known_totals, "artist", "left")
    held = F.greatest(F.coalesce("n", F.lit(0)), F.coalesce("total", F.lit(0)))
    anew = (held > F.col("song_count")) & F.col("n").isNotNull()
    pick = lambda new, old: F.when(anew, new).otherwise(F.col(old)).alias(old)
    return both.select(
        "artist", pick(held, "song_count"), pick(F.col("w"), "total_words"), pick(F.rint(F.col("w") * 100 / F.col("n")) / 100, "avg_words_per_song"), pick(F.col("t"), "avg_ttr"),
        pick(F.col("c"), "avg_chorus_ratio"), pick(F.col("r"), "avg_repetition_ratio"), F.when(anew, "live_cache").otherwise("dataset").alias("source"),
    )


def public_reading(readings: DataFrame, *clock: str) -> DataFrame:
    """``song_id, reading``: what a reading shows as one JSON object, with the clock's values where there are any."""
    return readings.select("song_id", F.to_json(F.struct(*(c for c in READING if c in readings.columns), *clock)).alias("reading"))


def clock_backfill(songs: DataFrame, aligned: DataFrame, timed: DataFrame) -> DataFrame:
    """``song_id, outcome``: what a pass that gives stored songs a clock does with each.

    ``songs``: ``song_id, lyrics, clocked``; ``aligned``: songs whose timed
    text lined up (``song_id``, see ``resolve.align_lines``); ``timed``: songs
    that have timed text.
    """
    flag = lambda df, name: df.select("song_id", F.lit(True).alias(name)).distinct()
    rows = songs.join(flag(timed, "_timed"), "song_id", "left").join(flag(aligned, "_fits"), "song_id", "left")
    outcome = F.when(F.trim("lyrics") == "", "no text").when(F.col("clocked"), "timed already").when(F.col("_timed").isNull(), "no timed text").when(F.col("_fits").isNull(), "did not line up").otherwise("clocked")
    return rows.select("song_id", outcome.alias("outcome"))
