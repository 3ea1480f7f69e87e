"""What stands between the corpus passes and a page: built catalogues, audits, sheets, evidence checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strophe.functions.text import name_key, token_array
from strophe.functions.titles import pseudo_artist, title_key
from strophe.functions.words import SPLIT_SCRIPT
from strophe.operators.artist import highlight_columns, highlight_parts, mean
from strophe.operators.classify import JUNK, filler
from strophe.operators.lookup import seeded_hash
from strophe.operators.resolve import canonical_dedupe


def build_catalogues(songs: DataFrame, least: int = 5) -> DataFrame:
    """``artist, song_count, total_words, words_per_song, avg_ttr`` and the records of what stays of an artist's rows.

    ``songs``: ``artist, song_id, title, wc, ttr, reason``. Rows with a reason
    go, versions of a title count once (the longest, under the shortest
    title), and artists of fewer than ``least`` songs have no catalogue. Names
    that differ in case are one artist, shown as most of its rows spell it
    (then by code point).
    """
    rows = songs.where("reason is null").withColumn("a", F.lower(F.trim("artist")))
    spelled = rows.groupBy("a", "artist").agg(F.count(F.lit(1)).alias("n"))
    shown = spelled.groupBy("a").agg(F.max(F.struct("n", "artist")).alias("s")).select("a", F.col("s.artist").alias("shown"))
    one = canonical_dedupe(rows.select(F.col("a").alias("artist"), title_key(F.col("title")).alias("key"), "song_id", "title", "wc")).join(rows.select("song_id", "ttr"), "song_id")
    sums = one.groupBy(F.col("artist").alias("a")).agg(F.count(F.lit(1)).alias("song_count"), F.sum("wc").alias("total_words"), mean("ttr").alias("avg_ttr"), *highlight_parts())
    full = sums.where(F.col("song_count") >= least).join(shown, "a")
    return full.select(F.col("shown").alias("artist"), "song_count", "total_words", F.bround(F.col("total_words") / F.col("song_count"), 4).alias("words_per_song"), "avg_ttr", *highlight_columns())


def clock_fold(clocks: DataFrame, songs: DataFrame) -> DataFrame:
    """``artist, synced_share, avg_first_s, longest_silence_s, silent_song, fastest_burst, fast_song``.

    ``clocks``: ``song_id, first_s, gap_s, fast``; ``songs``: ``artist,
    song_id``. Ties go to the smaller id.
    """
    rows = songs.join(clocks, "song_id", "left")
    best = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("v"), (-F.col("song_id")).alias("o"))))
    out = rows.groupBy("artist").agg(F.count(F.lit(1)).alias("n"), F.count("first_s").alias("timed"), F.sum(F.round(F.col("first_s") * 10).cast("long")).alias("f"), best("gap_s").alias("g"), best("fast").alias("b"))
    return out.select("artist", F.bround(F.col("timed") / F.col("n"), 4).alias("synced_share"), (F.rint(F.col("f") / F.col("timed")) / 10).alias("avg_first_s"), F.col("g.v").alias("longest_silence_s"), (-F.col("g.o")).alias("silent_song"), F.col("b.v").alias("fastest_burst"), (-F.col("b.o")).alias("fast_song"))


def recurring_word(ranked: DataFrame, grammar: tuple[str, ...] = ()) -> DataFrame:
    """``artist, word, uses``: the first word of an artist's list (``artist, rank, word, uses``) that is no filler and has no apostrophe."""
    fit = ranked.where(~F.col("word").rlike("['’]") & (F.col("uses") > 0) & ~filler(F.col("word"), grammar))
    best = fit.groupBy("artist").agg(F.min(F.struct("rank", "word", "uses")).alias("b"))
    return best.select("artist", F.col("b.word").alias("word"), F.col("b.uses").alias("uses"))


def lead_figure(places: DataFrame, key: str, floors: dict[str, int] | None = None, gap: int = 15) -> DataFrame:
    """``key, metric, pct``: the stat farthest from the middle, at least ``gap`` away.

    ``floors`` are distances that single metrics must reach to lead.
    """
    far = F.abs(F.col("pct") - 50)
    fit = far >= gap
    for metric, least in (floors or {}).items():
        fit = fit & ~((F.col("metric") == metric) & (far < least))
    order = W.partitionBy(key).orderBy(F.desc("_far"), "metric")
    return places.where(fit).withColumn("_far", far).withColumn("_r", F.row_number().over(order)).where("_r = 1").select(key, "metric", "pct")


def quote_evidence(quotes: DataFrame, words: DataFrame) -> DataFrame:
    """``artist, word, counted, quoted``: whether a quoted word is counted for the artist and stands in its line."""
    known = words.select("artist", "word", F.lit(True).alias("k")).distinct()
    return quotes.join(known, ["artist", "word"], "left").select("artist", "word", F.coalesce("k", F.lit(False)).alias("counted"), F.array_contains(token_array(F.col("line")), F.col("word")).alias("quoted"))


def review_sheet(artists: DataFrame, must: DataFrame, least: int = 25, k: int = 100) -> DataFrame:
    """``place, artist, songs, uploads``: artists to review, named ones first, then by uploads; no pseudo artists.

    ``artists``: ``artist, songs, uploads``; ``must``: ``artist``. A top-k
    report.
    """
    rows = artists.join(must.select("artist", F.lit(True).alias("m")).distinct(), "artist", "left").where(F.coalesce("m", F.lit(False)) | ((F.col("songs") >= least) & ~pseudo_artist(F.col("artist"))))
    top = rows.orderBy(F.coalesce("m", F.lit(False)).desc(), F.desc("uploads"), "artist").limit(k)
    place = F.row_number().over(W.orderBy(F.coalesce("m", F.lit(False)).desc(), F.desc("uploads"), "artist")).cast("long")
    return top.select(place.alias("place"), "artist", "songs", "uploads")


def catalogue_diff(mine: DataFrame, theirs: DataFrame, key: Column | None = None) -> DataFrame:
    """Titles of ``mine`` that ``theirs`` lacks, by normal form."""
    k = key if key is not None else title_key(F.col("title"))
    return mine.withColumn("_k", k).join(theirs.select(k.alias("_k")).distinct(), "_k", "left_anti").drop("_k")


def suspects(songs: DataFrame, k: int = 6) -> DataFrame:
    """``artist, n, titles``: titles that still look like junk, with the first ``k``."""
    hit = songs.where(F.lower("title").rlike(JUNK))
    ranked = hit.withColumn("r", F.row_number().over(W.partitionBy("artist").orderBy("title", "song_id"))).withColumn("n", F.count(F.lit(1)).over(W.partitionBy("artist")))
    return ranked.where(F.col("r") <= k).groupBy("artist", "n").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "title"))), lambda x: x["title"]), " / ").alias("titles"))


def audit_layers(reasons: DataFrame) -> DataFrame:
    """``layer, n``: which rule set how many rows aside."""
    return reasons.groupBy(F.coalesce("reason", F.lit("kept")).alias("layer")).agg(F.count(F.lit(1)).alias("n"))


#: What separates the names of a joint credit.
JOINT = r"(?i)\s*(?:&|\+|/|,|;|\band the\b|\band\b|\bwith\b|\bx\b)\s*"


def fragments(prints: DataFrame, pages: DataFrame, share: float = 0.3, least: int = 25) -> DataFrame:
    """``part, whole, overlap``: pages that are part of a joint credit, whose texts the credit or its other parts largely hold.

    ``prints``: ``artist, fp``; ``pages``: ``artist, songs``. Parts meet pages
    by key, and only pages of ``least`` songs are judged.
    """
    keyed = pages.select("artist", "songs", name_key(F.col("artist")).alias("k"))
    parts = keyed.select(F.col("artist").alias("whole"), F.col("k").alias("kw"), F.explode(F.split("artist", JOINT)).alias("p")).select("whole", "kw", name_key(F.col("p")).alias("k")).where("k <> '' and k <> kw").distinct()
    judged = parts.join(keyed.where(F.col("songs") >= least).select("k", F.col("artist").alias("part")), "k")
    sets = prints.where("fp is not null").select(name_key(F.col("artist")).alias("k"), "fp").distinct()
    # what the whole and each of its parts hold, by part that holds it
    holders = parts.select("whole", "k").union(parts.select("whole", F.col("kw").alias("k"))).distinct().join(sets, "k").select("whole", F.col("k").alias("by"), "fp")
    mine = judged.select("part", "whole", "k").join(sets, "k")
    n = mine.groupBy("part", "whole").agg(F.count(F.lit(1)).alias("n"))
    shared = mine.join(holders, ["whole", "fp"]).where("by <> k").groupBy("part", "whole").agg(F.count_distinct("fp").alias("s"))
    return shared.join(n, ["part", "whole"]).withColumn("overlap", F.bround(F.col("s") / F.col("n"), 4)).where(F.col("overlap") >= share).select("part", "whole", "overlap")


def twins(prints: DataFrame, pages: DataFrame, share: float = 0.5) -> DataFrame:
    """``artist, twin, overlap``: for each of ``pages(artist)`` the artist that holds most of its texts, if half or more."""
    sets = prints.where("fp is not null").select("artist", "fp").distinct()
    mine = sets.join(pages.select("artist").distinct(), "artist")
    n = mine.groupBy("artist").agg(F.count(F.lit(1)).alias("n"))
    both = mine.join(sets.select(F.col("artist").alias("twin"), "fp"), "fp").where("artist <> twin").groupBy("artist", "twin").agg(F.count(F.lit(1)).alias("s"))
    top = both.groupBy("artist").agg(F.max(F.struct("s", "twin")).alias("b"))
    return top.join(n, "artist").withColumn("overlap", F.bround(F.col("b.s") / F.col("n"), 4)).where(F.col("overlap") >= share).select("artist", F.col("b.twin").alias("twin"), "overlap")


#: Languages that word lists confuse with each other.
CONFUSED = (("es", "pt", "it", "fr", "ro", "sc"), ("bs", "pl", "ru", "uk", "cy"), ("de", "nl"), ("sv", "nl"), ("hi", "bs", "en"))


def namesakes(songs: DataFrame, least: int = 2, most: float = 0.6, unclassified: float = 0.4, confused: tuple[tuple[str, ...], ...] = CONFUSED) -> DataFrame:
    """``artist, lang, songs, main``: clusters of songs that may be another artist's of the same name.

    ``songs``: ``artist, lang, album, song_id``. A cluster is in a language
    other than the artist's main one that word lists don't confuse with it,
    has ``least`` songs and at most ``most`` of those that have a language,
    and shares no album with the rest. Artists of which more than
    ``unclassified`` of the songs have no language are left out.
    """
    rows = songs.withColumn("a", F.lower(F.regexp_replace(F.trim(F.coalesce("album", F.lit(""))), r"\s+", " ")))
    n = rows.where("lang is not null").groupBy("artist", "lang").agg(F.count(F.lit(1)).alias("songs"))
    main = n.groupBy("artist").agg(F.max(F.struct("songs", "lang")).alias("m"), F.sum("songs").alias("labelled"))
    total = rows.groupBy("artist").agg(F.count(F.lit(1)).alias("all"))
    pages = main.join(total, "artist").where((F.col("all") - F.col("labelled")) / F.col("all") <= unclassified)
    alike = F.lit(False)
    for group in confused:
        alike = alike | (F.col("lang").isin(*group) & F.col("m.lang").isin(*group))
    other = n.join(pages, "artist").where((F.col("lang") != F.col("m.lang")) & (F.col("songs") >= least) & (F.col("songs") / F.col("labelled") <= most) & ~alike)
    albums = rows.where("a <> ''").select("artist", "a", F.coalesce("lang", F.lit("")).alias("lang")).distinct()
    shared = albums.groupBy("artist", "a").agg(F.count(F.lit(1)).alias("langs")).where("langs > 1").join(albums, ["artist", "a"]).select("artist", "lang").distinct()
    return other.select("artist", "lang", "songs", F.col("m.lang").alias("main")).join(shared, ["artist", "lang"], "left_anti").select("artist", "lang", "songs", "main")


def whole_words(words: DataFrame, lines: DataFrame) -> DataFrame:
    """``word, whole``: words of scripts with vowel signs, which tokens break, as lines spell them most often.

    ``words``: ``word``; ``lines``: ``line``.
    """
    script = SPLIT_SCRIPT
    spelled = lines.select(F.explode(F.regexp_extract_all("line", F.lit(rf"((?:[\p{{L}}\p{{Nl}}\p{{No}}]|{script}|\x{{200D}})+)"), F.lit(1))).alias("whole")).where(F.col("whole").rlike(script))
    counted = spelled.groupBy("whole").agg(F.count(F.lit(1)).alias("n"))
    pieces = counted.select("whole", "n", F.explode(F.array_distinct(token_array(F.col("whole")))).alias("word"))
    best = pieces.groupBy("word").agg(F.max(F.struct("n", "whole")).alias("b"))
    return words.join(best, "word", "left").select("word", F.coalesce("b.whole", "word").alias("whole"))


def refresh_readings(stored: DataFrame, fresh: DataFrame, clock: list[str]) -> DataFrame:
    """Fresh readings with the stored clock values, which a text alone can't give."""
    kept = stored.select("song_id", *(F.col(c).alias(f"_{c}") for c in clock))
    both = fresh.join(kept, "song_id", "left")
    return both.withColumns({c: F.coalesce(f"_{c}", F.col(c)) if c in fresh.columns else F.col(f"_{c}") for c in clock}).drop(*(f"_{c}" for c in clock))


def sampled_payload(rows: DataFrame, n: int = 20, seed: int = 1, totals: DataFrame | None = None) -> DataFrame:
    """``artist, songs, sampled, limited, cached_total``: a seeded sample of ``n`` songs with words for each artist.

    ``limited``: under ``n`` songs are known. ``cached_total`` is the songs, or
    where there are more than ``n`` the total that ``totals(artist, total)``
    knows. Only the sampled ids are gathered: the rest are counted.
    """
    some = rows.where("wc > 0")
    place = F.row_number().over(W.partitionBy("artist").orderBy(seeded_hash("song_id", seed), "song_id"))
    sizes = some.groupBy("artist").agg(F.count(F.lit(1)).alias("songs"))
    picked = some.withColumn("_r", place).where(F.col("_r") <= n).groupBy("artist").agg(F.sort_array(F.collect_list("song_id")).alias("sampled")).join(sizes, "artist")
    picked = picked.withColumn("total", F.lit(None).cast("long")) if totals is None else picked.join(totals.select("artist", "total"), "artist", "left")
    known = F.when(F.col("songs") > n, F.coalesce("total", "songs")).otherwise(F.col("songs"))
    return picked.select("artist", "songs", "sampled", (F.col("songs") < n).alias("limited"), known.alias("cached_total"))
