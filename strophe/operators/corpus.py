"""Corpus-wide passes: document frequency, signatures, percentiles and ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strophe.functions.text import minutes, name_key, name_tokens, ordinal, percent, token_array, unaccented
from strophe.functions.titles import clean_title, display_title, squashed, title_key, version_clauses
from strophe.functions.words import CREDITS, EN_SPELLINGS, LABELS, SPLIT_SCRIPT

#: Titles of mash-ups, and of versions that a quote is taken from only where nothing else has the word.
MASH_UP = r"(?i)\b(?:mash-?up|megamix|medley)\b|[(\[][^)\]]*\bvs\.?\s[^)\]]*[)\]]"
VERSION_TITLE = r"(?i)\b(?:vs\.?|remix|mix|mashup|megamix|medley|karaoke|live|edit|version)\b"


def artist_words(words: DataFrame) -> DataFrame:
    """``artist, word, uses, spread``: uses of a word and how many of the artist's songs have it, from ``functions.text.word_table``."""
    return words.groupBy("artist", "word").agg(F.count(F.lit(1)).alias("uses"), F.count_if("first").alias("spread"))


def document_frequency(words: DataFrame) -> DataFrame:
    """``word, df, uses``: how many artists use a word, exactly."""
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("df"), F.sum("uses").alias("uses"))


def candidates(words: DataFrame, stop: tuple[str, ...], k: int = 250, letters: int = 3, uses: int = 3) -> DataFrame:
    """An artist's ``k`` most used words, of which long and frequent ones that aren't stop words stay."""
    ranked = words.withColumn("r", F.row_number().over(W.partitionBy("artist").orderBy(F.desc("uses"), "word")))
    return ranked.where((F.col("r") <= k) & (F.length("word") >= letters) & (F.col("uses") >= uses) & ~F.col("word").isin(*stop)).drop("r")


def exclusive_words(words: DataFrame, stop: tuple[str, ...], k: int = 50) -> DataFrame:
    """``artist, rank, word, uses``: candidates that no other artist uses."""
    alone = words.groupBy("word").agg(F.count(F.lit(1)).alias("df")).where("df = 1").select("word")
    own = candidates(words, stop).join(alone, "word")
    return own.withColumn("rank", F.row_number().over(W.partitionBy("artist").orderBy(F.desc("uses"), "word")).cast("long")).where(F.col("rank") <= k).select("artist", "rank", "word", "uses")


def signature_words(words: DataFrame, stop: tuple[str, ...], k: int = 150, uses: int = 5, ratio: float = 2.0) -> DataFrame:
    """``artist, rank, word, ratio``: candidates used at least ``ratio`` times as often as in the corpus.

    The corpus's count of a word sums only rows that are candidates; its size
    sums all rows.
    """
    own = candidates(words, stop)
    freq = own.groupBy("word").agg(F.sum("uses").alias("freq"))
    totals = words.groupBy("artist").agg(F.sum("uses").alias("total"))
    corpus = words.agg(F.sum("uses").alias("corpus"))
    rows = own.where(F.col("uses") >= uses).join(freq, "word").join(totals, "artist").join(F.broadcast(corpus))
    rows = rows.withColumn("x", (F.col("uses") / F.col("total") * 1000) / F.greatest(F.col("freq") / F.col("corpus") * 1000, F.lit(0.0005))).where(F.col("x") >= ratio)
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy("artist").orderBy(F.desc(F.bround("x", 6)), "word")).cast("long"))
    return ranked.where(F.col("rank") <= k).select("artist", "rank", "word", F.bround("x", 1).alias("ratio"))


def unpivoted(rows: DataFrame, metrics: list[str], *keep: str) -> DataFrame:
    """``keep..., metric, value``: one row for each metric that isn't null."""
    long = rows.select(*keep, F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics))).alias("x"))
    return long.select(*keep, "x.*").where("value is not null")


def value_places(long: DataFrame, buckets: int = 1024) -> DataFrame:
    """``metric, value, c, below, n``: rows of each value, rows of smaller values, and all rows of the metric.

    Rows are counted by value first, so what is put in order is each distinct
    value once. Prefix sums are taken in two levels (buckets of the metric's
    span, then values in a bucket), so no task holds all values of a metric.
    """
    counts = long.groupBy("metric", "value").agg(F.count(F.lit(1)).alias("c"))
    span = counts.groupBy("metric").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.sum("c").alias("n"))
    share = F.when(F.col("hi") > F.col("lo"), (F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)
    dealt = counts.join(span, "metric").withColumn("b", F.floor(share * (buckets - 1)))
    before = lambda *by: W.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(W.unboundedPreceding, -1)
    sums = dealt.groupBy("metric", "b").agg(F.sum("c").alias("s")).withColumn("ahead", F.coalesce(F.sum("s").over(before("metric", "b")), F.lit(0))).select("metric", "b", "ahead")
    inner = dealt.withColumn("inner", F.coalesce(F.sum("c").over(before("metric", "b", "value")), F.lit(0)))
    return inner.join(sums, ["metric", "b"]).select("metric", "value", "c", (F.col("ahead") + F.col("inner")).alias("below"), "n")


def percent_below(rows: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """``key, metric, value, pct``: percentage of values that are smaller, half to even; nulls take no part."""
    long = unpivoted(rows, metrics, key)
    places = value_places(long).select("metric", "value", F.rint(100.0 * F.col("below") / F.col("n")).cast("long").alias("pct"))
    return long.join(places, ["metric", "value"]).select(key, "metric", "value", "pct")


def language_document_frequency(tokens: DataFrame, uses: int = 5, least: int = 2) -> DataFrame:
    """``lang, word, n, artists, idf, share``: artists who use a word at least ``uses`` times in a language."""
    per = tokens.groupBy("lang", "artist", "word").agg(F.count(F.lit(1)).alias("c"))
    artists = tokens.select("lang", "artist").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("artists"))
    n = per.where(F.col("c") >= uses).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return n.join(artists, "lang").select("lang", "word", "n", "artists", F.bround(F.ln((F.col("artists") + 1) / (F.col("n") + 1)), 6).alias("idf"), F.bround(F.col("n") / F.col("artists"), 6).alias("share"))


def credit_spread(tokens: DataFrame) -> DataFrame:
    """``artist, word, credited``: in how many of an artist's songs with a credit word a word stands."""
    marked = tokens.where(F.col("word").isin(*CREDITS)).select("song_id").distinct()
    return tokens.join(marked, "song_id", "left_semi").groupBy("artist", "word").agg(F.count_distinct("song_id").alias("credited"))


def usable_words(words: DataFrame, artists: DataFrame, frequency: DataFrame, credits: DataFrame, function_words: tuple[str, ...], listed: tuple[str, ...], whole: DataFrame | None = None) -> DataFrame:
    """The rows of ``words`` (``artist, word, uses, spread``) that may be a signature or staple, with ``lang``, ``songs``, ``idf``.

    Set aside are words once in each song they are in or mostly beside a
    credit (if in five songs or more), short words, words with apostrophes,
    the artist's name, labels, vocables, grammar (``function_words`` of any
    language; English spellings for English; in a language that is not
    ``listed``, what half of its artists use), words at home in another
    language, and pieces of words that the tokens broke and no line of
    ``whole`` gives back. ``artists``: ``artist, display, lang, songs``;
    ``frequency``: ``lang, word, n`` and ``language_sizes`` from it.
    """
    from strophe.operators.classify import adlib

    sizes = artists.groupBy("lang").agg(F.count(F.lit(1)).alias("n_lang"))
    share = frequency.join(sizes, "lang").select("lang", "word", "n", (F.col("n") / F.col("n_lang")).alias("share"))
    order = W.partitionBy("word").orderBy(F.desc("share"), "lang")
    # the two languages that use a word most tell the largest share elsewhere
    top = share.withColumn("r", F.row_number().over(order)).where("r <= 2").groupBy("word").agg(F.max(F.when(F.col("r") == 1, F.struct("lang", "share"))).alias("a"), F.max(F.when(F.col("r") == 2, F.col("share"))).alias("b"))
    people = artists.join(sizes, "lang").withColumn("_names", F.array_union(name_tokens(F.col("display")), F.transform(name_tokens(F.col("display")), unaccented))).drop("display")
    rows = words.join(people, "artist").join(share, ["lang", "word"], "left").join(top, "word", "left").join(credits, ["artist", "word"], "left")
    mine = F.coalesce("share", F.lit(0.0))
    other = F.when(F.col("a.lang") == F.col("lang"), F.col("b")).otherwise(F.col("a.share"))
    word = F.col("word")
    broken = word.rlike(SPLIT_SCRIPT)
    if whole is not None:
        rows = rows.join(whole.select("word", F.lit(True).alias("_whole")).distinct(), "word", "left")
        broken = broken & F.col("_whole").isNull()
    footer = (F.col("spread") >= 5) & ((F.col("uses") == F.col("spread")) | (F.coalesce("credited", F.lit(0)) >= F.col("spread") * 0.8))
    grammar = word.isin(*function_words) | ((F.col("lang") == "en") & word.isin(*EN_SPELLINGS)) | (~F.col("lang").isin(*listed) & (mine >= 0.5))
    foreign = (F.coalesce(other, F.lit(0.0)) > mine) & (F.coalesce(other, F.lit(0.0)) >= 0.02) & (mine < 0.003)
    fit = (F.length("word") >= 3) & ~word.rlike("['’]") & ~F.array_contains("_names", word) & ~F.array_contains("_names", unaccented(word)) & ~word.isin(*LABELS)
    idf = F.ln((F.col("n_lang") + 1) / (F.coalesce("n", F.lit(0)) + 1))
    return rows.where(fit & ~footer & ~broken & ~adlib(word) & ~grammar & ~foreign).select("artist", "lang", "word", "uses", "spread", "songs", F.bround(idf, 6).alias("idf"))


def signature_score(usable: DataFrame, k: int = 12, uses: int = 10, idf: float = 1.0, part: float = 0.06) -> DataFrame:
    """``artist, rank, word, spread, uses, score``: usable words that recur through a catalogue and are rare elsewhere.

    Score: share of songs, times squared idf, times log of uses; words in at
    least 6 % of the songs (3 at least) with an idf of at least 1.
    """
    rows = usable.where((F.col("uses") >= uses) & (F.col("spread") >= F.greatest(F.lit(3), F.ceil(F.col("songs") * part))) & (F.col("idf") >= idf))
    rows = rows.withColumn("score", F.bround(F.col("spread") / F.col("songs") * F.col("idf") * F.col("idf") * F.ln(1 + F.col("uses")), 6))
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("artist").orderBy(F.desc("score"), F.desc("word"))).cast("long")).where(F.col("rank") <= k).select("artist", "rank", "word", "spread", "uses", "score")


def staples(words: DataFrame, usable: DataFrame, k: int = 25, first: int = 800, share: float = 0.03, least: int = 2) -> DataFrame:
    """``artist, rank, word, uses, spread``: of the ``first`` most used ``words`` the usable ones that stand in many songs."""
    ranked = words.withColumn("r", F.row_number().over(W.partitionBy("artist").orderBy(F.desc("uses"), "word"))).where(F.col("r") <= first).select("artist", "word", "r")
    rows = ranked.join(usable, ["artist", "word"]).where(F.col("spread") >= F.greatest(F.lit(least), F.ceil(F.col("songs") * share)))
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("artist").orderBy("r")).cast("long")).where(F.col("rank") <= k).select("artist", "rank", "word", "uses", "spread")


def staple(words: DataFrame, usable: DataFrame) -> DataFrame:
    """``artist, word, songs, uses, share``: the most used usable word of the first 400 that stands in a tenth of the songs."""
    top = staples(words, usable, 1, 400, 0.1, 3).select("artist", "word")
    return top.join(usable, ["artist", "word"]).select("artist", "word", F.col("spread").alias("songs"), "uses", F.bround(F.col("spread") / F.col("songs"), 3).alias("share"))


def hook_quotes(top_lines: DataFrame, words: DataFrame) -> DataFrame:
    """``artist, word, line, title, times``: for each artist's word the hook line that quotes it best.

    ``top_lines``: ``artist, song_id, title, top_line, top_line_n``, each
    song's line that stands three times or more. Lines of 3 to 16 words count,
    not in capitals alone; a line scores its repeats, 4 if it has 5 to 12
    words, and a tenth for each word up to 8. Mash-ups, and remixes credited
    to the artist, are left out; other versions count only where nothing else
    has the word. Ties go to the smaller song.
    """
    n = F.size(F.split("top_line", " "))
    own = F.filter(F.split(squashed(F.col("artist")), " "), lambda w: F.length(w) >= 3)
    credited = F.exists(version_clauses(F.col("title")), lambda c: F.size(F.array_intersect(F.split(squashed(c), " "), own)) > 0)
    rows = top_lines.where((F.col("top_line_n") >= 3) & n.between(3, 16) & ~F.col("top_line").startswith("[") & ((F.upper("top_line") != F.col("top_line")) | (F.lower("top_line") == F.col("top_line"))) & ~F.col("title").rlike(MASH_UP) & ~credited)
    score = F.col("top_line_n") * 10 + F.when(n.between(5, 12), 40).otherwise(0) + F.least(n, F.lit(8)) - F.when(F.col("title").rlike(VERSION_TITLE), 10_000).otherwise(0)
    hits = rows.select("artist", "song_id", "title", "top_line", "top_line_n", score.alias("s"), F.explode(F.array_distinct(token_array(F.col("top_line")))).alias("word")).join(words.select("artist", "word"), ["artist", "word"])
    best = hits.groupBy("artist", "word").agg(F.max(F.struct("s", (-F.col("song_id")).alias("o"), "top_line", "title", "top_line_n")).alias("b"))
    return best.select("artist", "word", F.col("b.top_line").alias("line"), display_title(F.col("b.title")).alias("title"), F.col("b.top_line_n").cast("long").alias("times"))


def curated_motifs(computed: DataFrame, reviews: DataFrame, words: DataFrame) -> DataFrame:
    """``artist, word, spread, uses, curated``: the reviewed word where the artist's songs have it, else the computed one.

    ``computed``: ``artist, word``; ``reviews``: ``artist, word``; ``words``:
    ``artist, word, uses, spread``.
    """
    given = reviews.join(words.where("spread >= 1"), ["artist", "word"]).groupBy("artist").agg(F.min("word").alias("given"))
    both = computed.select("artist", "word").join(given, "artist", "full_outer").select("artist", F.coalesce("given", "word").alias("word"), F.col("given").isNotNull().alias("curated"))
    return both.join(words, ["artist", "word"]).select("artist", "word", "spread", "uses", "curated")


def motif_word(signatures: DataFrame, top_words: DataFrame, artists: DataFrame, vocables: tuple[str, ...]) -> DataFrame:
    """``artist, word``: an artist's first acceptable signature word, else top word, else any top word.

    ``signatures`` and ``top_words``: ``artist, rank, word``; ``artists``:
    ``artist, display``. Acceptable: three letters, no apostrophe, no vocable,
    not in the name; the third choice may be a vocable, the last may be all.
    """
    names = artists.select("artist", F.split(F.lower("display"), r"\s+").alias("names"))
    both = signatures.select("artist", "rank", "word", F.lit(0).alias("list")).union(top_words.select("artist", "rank", "word", F.lit(1).alias("list"))).join(names, "artist")
    plain = (F.length("word") > 2) & ~F.col("word").rlike("['’]") & ~F.array_contains("names", F.col("word"))
    tier = F.when(plain & ~F.col("word").isin(*vocables), F.col("list")).when(plain & (F.col("list") == 1), 2).when(F.col("list") == 1, 3)
    return both.withColumn("t", tier).where("t is not null").groupBy("artist").agg(F.min(F.struct("t", "rank", "word")).alias("b")).select("artist", F.col("b.word").alias("word"))


def motif_quotes(lines: DataFrame, motifs: DataFrame) -> DataFrame:
    """``artist, word, song_id, line, score``: the line that shows a motif word best.

    Lines of 6 to 12 words are best, of 4 to 20 allowed; capitals at the start
    help, shouting and lines of few different words lose. Lines in brackets
    don't count. Ties go to the smaller song and the earlier line.
    """
    line = F.col("line")
    words = F.split(line, r"(?U)\s+")
    n = F.size(words)
    bracketed = line.startswith("[") | line.endswith("]") | (line.startswith("(") & line.endswith(")"))
    few = F.size(F.array_distinct(F.transform(words, F.lower))) < 0.6 * n
    first = F.left(line, F.lit(1))
    score = F.when(bracketed, -100).when((n < 4) | (n > 20), -50).otherwise(
        F.when(n.between(6, 12), 20).otherwise(0) + F.when((F.upper(first) == first) & (F.lower(first) != first), 10).otherwise(0)
        - F.when((F.upper(line) == line) & (F.lower(line) != line), 20).otherwise(0) - F.when(few, 50).otherwise(0)
    )
    # lines meet an artist's words all at once, and only the words they have make rows
    wanted = motifs.where("word is not null").groupBy("artist").agg(F.collect_set("word").alias("wanted"))
    met = lines.select("artist", "song_id", "line_no", "line").join(wanted, "artist").select("artist", "song_id", "line_no", "line", F.array_intersect(token_array(line), "wanted").alias("found"))
    hits = met.where(F.size("found") > 0).select("artist", "song_id", "line_no", "line", score.cast("long").alias("score"), F.explode("found").alias("word"))
    best = hits.groupBy("artist", "word").agg(F.max(F.struct("score", (-F.col("song_id")).alias("o"), (-F.col("line_no")).alias("p"), "line")).alias("b"))
    return best.select("artist", "word", (-F.col("b.o")).alias("song_id"), F.col("b.line").alias("line"), F.col("b.score").alias("score"))


# --- percentile tables ---------------------------------------------------------


#: What the archive's songs are placed by.
SONG_METRICS = ("wc", "uniq", "ttr", "rep", "hook", "rhyme", "drops", "awl", "q", "one_word", "wpm", "first_s", "gap_s", "fast15")


def archive_metrics(rows: DataFrame, least_words: int = 30, most_words: int = 2000) -> DataFrame:
    """The songs that the archive's percentiles count, with null where a metric doesn't.

    Clock metrics count songs with timed text; a pace counts with a duration
    of 30 seconds or more and up to 400 words a minute.
    """
    paced = (F.col("duration") >= 30) & (F.col("wpm") <= 400)
    out = rows.where(F.col("wc").between(least_words, most_words))
    return out.withColumns({**{m: F.when(F.col("has_synced"), F.col(m)) for m in ("first_s", "gap_s", "fast15")}, "wpm": F.when(paced, F.col("wpm"))})


def quantile_cuts(rows: DataFrame, metrics: list[str], least: int = 1, steps: int = 100) -> DataFrame:
    """``metric, p, cut``: the value at index ``rint(p / 100 * (n - 1))``, without interpolation, of metrics with ``least`` values."""
    places = value_places(unpivoted(rows, metrics)).where(F.col("n") >= least)
    at = lambda p: F.rint(p / F.lit(100.0) * (F.col("n") - 1))
    wanted = F.filter(F.sequence(F.lit(0), F.lit(steps)), lambda p: (at(p) >= F.col("below")) & (at(p) < F.col("below") + F.col("c")))
    return places.select("metric", F.explode(wanted).alias("p"), F.col("value").alias("cut")).select("metric", F.col("p").cast("long").alias("p"), "cut")


def place_among(value: Column, cuts: Column) -> Column:
    """Percentile of a value among sorted cuts: the middle of a plateau, rounded half to even."""
    mid = (F.size(F.filter(cuts, lambda c: c < value)) + F.size(F.filter(cuts, lambda c: c <= value))) / 2.0
    return F.rint(F.least(F.lit(100.0), F.greatest(F.lit(0.0), mid / (F.size(cuts) - 1) * 100))).cast("long")


def percentile_places(rows: DataFrame, key: str, cuts: DataFrame, metrics: list[str]) -> DataFrame:
    """``key, metric, pct``: each value placed among its metric's cuts (a table of a few hundred rows)."""
    table = cuts.groupBy("metric").agg(F.sort_array(F.collect_list("cut")).alias("cuts"))
    long = unpivoted(rows, metrics, key)
    return long.join(F.broadcast(table), "metric").select(key, "metric", place_among(F.col("value"), F.col("cuts")).alias("pct"))


def catalogue_standing(rows: DataFrame, value: str) -> DataFrame:
    """``artist, song_id, rank, of, median, low, high``: place of a song among its artist's; the median is the upper one."""
    one = W.partitionBy("artist")
    ordered = rows.withColumn("i", F.row_number().over(one.orderBy(value, "song_id"))).withColumn("of", F.count(F.lit(1)).over(one))
    mid = F.max(F.when(F.col("i") == F.floor(F.col("of") / 2) + 1, F.col(value))).over(one)
    return ordered.select("artist", "song_id", F.rank().over(one.orderBy(F.desc(value))).cast("long").alias("rank"), "of", mid.alias("median"), F.min(value).over(one).alias("low"), F.max(value).over(one).alias("high"))


def catalogue_points(rows: DataFrame, value: str, most: int = 240) -> DataFrame:
    """``artist, point, value``: an artist's values in order, thinned to ``most`` evenly spaced ones."""
    one = W.partitionBy("artist")
    ordered = rows.where(F.col(value).isNotNull()).withColumn("i", F.row_number().over(one.orderBy(value, "song_id")) - 1).withColumn("n", F.count(F.lit(1)).over(one))
    picked = F.filter(F.sequence(F.lit(0), F.least(F.col("n"), F.lit(most)).cast("int") - 1), lambda k: F.floor(k * (F.col("n") / F.lit(float(most)))) == F.col("i"))
    return ordered.select("artist", F.explode(F.when(F.col("n") <= most, F.array(F.col("i").cast("int"))).otherwise(picked)).alias("point"), F.col(value).alias("value")).select("artist", F.col("point").cast("long").alias("point"), "value")


def standing_phrase(rank: Column, of: Column, most: str = "longest", least: str = "shortest") -> Column:
    """``3rd longest of 385``, or past the middle ``12th shortest of 385``."""
    place = lambda n, word: F.concat(ordinal(n), F.lit(f" {word} of "), of.cast("string"))
    return F.when(rank <= of / 2, place(rank, most)).otherwise(place(of - rank + 1, least))


def percentile_phrase(pct: Column, more: str = "longer than", less: str = "shorter than") -> Column:
    """``longer than 78% of songs``, or below the middle ``shorter than 61% of songs``."""
    said = lambda word, p: F.concat(F.lit(f"{word} "), p.cast("string"), F.lit("% of songs"))
    return F.when(pct >= 50, said(more, pct)).otherwise(said(less, 100 - pct))


def interesting(places: DataFrame, key: str) -> DataFrame:
    """``key, metric, pct, side``: the two highest stats above the middle and the lowest below (or a third high one)."""
    rows = places.where("pct is not null and pct <> 0").withColumn("away", F.abs(F.col("pct") - 50))
    high = rows.where("pct >= 50").withColumn("r", F.row_number().over(W.partitionBy(key).orderBy(F.desc("away"), "metric"))).where("r <= 3")
    low = rows.where("pct < 50").withColumn("r", F.row_number().over(W.partitionBy(key).orderBy(F.desc("away"), "metric"))).where("r = 1")
    has_low = low.select(key).withColumn("has_low", F.lit(True))
    third = high.join(has_low, key, "left").where("r <= 2 or has_low is null")
    return third.select(key, "metric", "pct", F.lit("high").alias("side")).union(low.select(key, "metric", "pct", F.lit("low").alias("side")))


def song_verdict(rows: DataFrame) -> Column:
    """Two or three plain sentences on a song's length, repetition and pace; null for a song that none is true of.

    Reads ``wc, rep, first_s, wpm`` and the percentiles ``wc_pct, rep_pct,
    wpm_pct``; a percentile that is missing says nothing.
    """
    said = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    whole = lambda c: F.floor(F.col(c) + 0.5).cast("long").cast("string")
    pct, text = F.col, lambda c: F.col(c).cast("string")
    other = lambda c: (100 - F.col(c)).cast("string")
    length = (
        F.when(pct("wc_pct") >= 80, said("Long for a song: ", F.format_number("wc", 0), " words, more than ", text("wc_pct"), "% of everything we have read."))
        .when(pct("wc_pct") <= 20, said("Short: ", text("wc"), " words, fewer than ", other("wc_pct"), "% of everything we have read."))
        .when(pct("wc_pct").isNotNull(), said(text("wc"), " words, an ordinary length."))
    )
    again = (
        F.when(F.col("rep") == 0, "No line is sung twice.")
        .when(pct("rep_pct") >= 75, said("It leans on repetition: ", percent(F.col("rep")), " of its lines come back, more than in ", text("rep_pct"), "% of songs."))
        .when(pct("rep_pct") <= 25, said("It rarely repeats itself: only ", percent(F.col("rep")), " of its lines come back."))
    )
    pace = (
        F.when(F.col("first_s") >= 30, said("The first word waits ", minutes(F.col("first_s")), "."))
        .when(pct("wpm_pct") >= 85, said("And it moves: ", whole("wpm"), " words a minute, faster than ", text("wpm_pct"), "% of songs."))
        .when(pct("wpm_pct") <= 15, said("It takes its time: ", whole("wpm"), " words a minute, slower than ", other("wpm_pct"), "% of songs."))
    )
    return F.nullif(F.concat_ws(" ", length, again, pace), F.lit(""))


def pick_rows(rows: DataFrame, catalogue: DataFrame) -> DataFrame:
    """``artist, place, song_id``: the row that stands for each title of a catalogue.

    ``rows``: ``artist, song_id, title, wc``; ``catalogue``: ``artist, place,
    title, wc``. A title has three keys: its own, that of its clean form, and
    its title key; a key that several catalogue titles share is the first
    one's. A row goes to the title of the first of its keys that is wanted. Of
    a title's rows the first of the same word count is taken, else the first.
    """
    keys = lambda: F.array(name_key(F.col("title")), name_key(clean_title(F.col("title"))), F.concat(F.lit("k:"), title_key(F.col("title"))))
    wanted = catalogue.select("artist", "place", F.col("wc").alias("_wc"), F.explode(keys()).alias("k")).where("k not in ('', 'k:')")
    first = wanted.groupBy("artist", "k").agg(F.min(F.struct("place", "_wc")).alias("w"))
    asked = rows.select("artist", "song_id", "wc", F.posexplode(keys()).alias("i", "k")).join(first, ["artist", "k"])
    mine = asked.groupBy("artist", "song_id", "wc").agg(F.min(F.struct("i", "w")).alias("b"))
    best = mine.groupBy("artist", F.col("b.w.place").alias("place")).agg(F.min(F.struct((F.coalesce(F.col("wc") != F.col("b.w._wc"), F.lit(True))).alias("d"), "song_id")).alias("r"))
    return best.select("artist", "place", F.col("r.song_id").alias("song_id"))
