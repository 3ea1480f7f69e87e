"""Lookups: exact and by key, type-ahead, did-you-mean, fetch plans.

Single lookups are plans over a table of names; each also takes a table of
requests, so that many are answered by one join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strophe.functions.text import edit_similarity, name_key


def exact_songs(songs: DataFrame, requests: DataFrame) -> DataFrame:
    """``request_id`` and the song of requests ``(request_id, artist, title)``; case is ignored, wildcards mean themselves."""
    r = requests.select("request_id", F.lower(F.trim("artist")).alias("_a"), F.lower(F.trim("title")).alias("_t"))
    return songs.join(r, (F.lower(F.trim(songs["artist"])) == F.col("_a")) & (F.lower(F.trim(songs["title"])) == F.col("_t"))).drop("_a", "_t")


def joiner_variants(name: Column) -> Column:
    """Forms of a name with ``&`` and ``+`` as ``and``, and without them; the first word stays as it is."""
    words = F.split(F.trim(F.lower(name)), r"\s+")
    spelled = F.transform(words, lambda w, i: F.when((i > 0) & w.isin("&", "+"), "and").otherwise(w))
    bare = F.filter(spelled, lambda w, i: (i == 0) | (i == F.size(words) - 1) | (w != "and"))
    return F.array_distinct(F.array(F.array_join(words, " "), F.array_join(spelled, " "), F.array_join(bare, " ")))


def tiered_lookup(names: DataFrame, requests: DataFrame) -> DataFrame:
    """``request_id, tier, key, display, n``: the largest catalogue under the key, else under a variant's key.

    ``names``: ``key, display, n``; ``requests``: ``request_id, name``.
    """
    asked = requests.select("request_id", F.posexplode(joiner_variants(F.col("name"))).alias("tier", "v")).select("request_id", F.col("tier").cast("long").alias("tier"), name_key(F.col("v")).alias("key"))
    order = W.partitionBy("request_id").orderBy("tier", F.desc("n"), "display")
    return names.join(asked, "key").withColumn("_r", F.row_number().over(order)).where("_r = 1").select("request_id", "tier", "key", "display", "n")


def holding(rows: DataFrame, text: Column, asked: DataFrame, part: str) -> DataFrame:
    """``rows`` whose ``text`` holds ``asked[part]``, met by equality on the part's first two characters."""
    n = F.length("_t")
    grams = F.when(n == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.array(F.substr(F.col("_t"), i, F.lit(1)), F.substr(F.col("_t"), i, F.lit(2)))))))
    index = rows.withColumn("_t", text).withColumn("_g", F.explode(grams))
    return index.join(asked.select(part).distinct().withColumn("_g", F.left(part, F.lit(2))), "_g").where(F.contains(F.col("_t"), F.col(part))).drop("_g", "_t")


def typeahead(names: DataFrame, prefixes: DataFrame, limit: int = 8, few: int = 5) -> DataFrame:
    """``prefix, place, display, n``: names that start with a prefix, the largest first.

    If there are fewer than ``few`` (or the limit), names that hold it follow.
    A name stands once whatever its case. Prefixes of one character match
    nothing. ``names``: ``key, display, n``.
    """
    hits = holding(names, F.col("key"), prefixes.where(F.length("prefix") >= 2), "prefix").withColumn("starts", F.col("key").startswith(F.col("prefix")))
    # of names that differ in case the largest stays
    one = hits.withColumn("_r", F.row_number().over(W.partitionBy("prefix", F.lower("display")).orderBy(F.desc("n"), "display"))).where("_r = 1").drop("_r")
    n = F.count_if("starts").over(W.partitionBy("prefix"))
    order = W.partitionBy("prefix").orderBy(F.desc("starts"), F.desc("n"), "display")
    ranked = one.withColumn("_s", n).where(F.col("starts") | (F.col("_s") < min(limit, few))).withColumn("place", F.row_number().over(order).cast("long"))
    return ranked.where(F.col("place") <= limit).select("prefix", "place", "display", "n")


def did_you_mean(names: DataFrame, requests: DataFrame, least: float = 0.6, block: int = 3, similarity=edit_similarity) -> DataFrame:
    """``name, display, n, score``: the most similar name with the same first letters; ties go to the larger, then by name.

    Both sides need a key of at least ``block`` characters; the similarity is 1
    less edits over the longer length, and must exceed ``least``.
    """
    a = requests.where(F.length("key") >= block).select("name", F.col("key").alias("_k"), F.left("key", F.lit(block)).alias("_p"))
    b = names.where(F.length("key") >= block).withColumn("_p", F.left("key", F.lit(block)))
    scored = b.join(a, "_p").withColumn("score", F.bround(similarity(F.col("key"), F.col("_k")), 4)).where(F.col("score") > least)
    best = W.partitionBy("name").orderBy(F.desc("score"), F.desc("n"), "display")
    return scored.withColumn("_r", F.row_number().over(best)).where("_r = 1").select("name", "display", "n", "score")


def autocomplete_titles(titles: DataFrame, asked: DataFrame, limit: int = 8) -> DataFrame:
    """``q, place, title``: equal titles, then those that start with the text (shorter first), then those that hold it."""
    hits = holding(titles.select("title").distinct(), F.lower("title"), asked.select(F.lower("q").alias("q")), "q")
    tier = F.when(F.lower("title") == F.col("q"), 0).when(F.lower("title").startswith(F.col("q")), 1).otherwise(2)
    order = W.partitionBy("q").orderBy(tier, F.length("title"), "title")
    return hits.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= limit).select("q", "place", "title")


def fetch_plan(wanted: DataFrame, *have: tuple[DataFrame, str]) -> DataFrame:
    """Rows of ``wanted`` that none of the tables has, each by the column it is paired with."""
    for df, column in have:
        wanted = wanted.join(df.select(column).distinct(), column, "left_anti")
    return wanted


def hash_sample(rows: DataFrame, key: str, n: int, seed: int = 1) -> DataFrame:
    """``n`` rows in the order of a seeded hash: the same on every run and machine."""
    return rows.orderBy(seeded_hash(key, seed), key).limit(n)


def seeded_hash(key: str, seed: int) -> Column:
    """The hash that samples are in order of: of the seed and the key, the same in any engine."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))


def modulo_sample(rows: DataFrame, key: str, every: int) -> DataFrame:
    """One row in ``every`` by its key (a sampling operator)."""
    return rows.where(F.pmod(F.col(key), F.lit(every)) == 0)


def best_hit(hits: DataFrame) -> DataFrame:
    """``request_id`` and its best hit: title matches with timed text, title matches, timed text, any; then by position.

    ``hits``: ``request_id, pos, wanted_key, title_key, synced``.
    """
    match = F.col("wanted_key") == F.col("title_key")
    timed = F.col("synced").isNotNull() & (F.col("synced") != "")
    tier = F.when(match & timed, 0).when(match, 1).when(timed, 2).otherwise(3)
    order = W.partitionBy("request_id").orderBy("tier", "pos")
    return hits.withColumn("tier", tier.cast("long")).withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def first_provider(rows: DataFrame, providers: list[str]) -> DataFrame:
    """Adds ``lyrics`` and ``lyrics_source``: the first provider column that holds text."""
    some = lambda c: F.when(F.trim(F.coalesce(c, F.lit(""))) != "", F.col(c))
    tag = F.lit(None).cast("string")
    for p in reversed(providers):
        tag = F.when(some(p).isNotNull(), p).otherwise(tag)
    return rows.withColumns({"lyrics": F.coalesce(*map(some, providers)), "lyrics_source": tag})


def dump_songs(tracks: DataFrame, lyrics: DataFrame, limit: int | None = None) -> DataFrame:
    """Tracks with their last lyrics, if those are words (not instrumental, not empty)."""
    words = lyrics.where("not coalesce(instrumental, false) and plain_lyrics is not null and plain_lyrics <> ''")
    out = tracks.join(words, tracks["last_lyrics_id"] == words["id"]).drop(words["id"])
    return out.limit(limit) if limit else out


def slim_meta(raw: DataFrame) -> DataFrame:
    """``id, title, artist_id, artist, album, year`` of nested song records; the first of several artists stands in for a missing one."""
    lead = F.coalesce(F.col("primary_artist"), F.get("primary_artists", 0))
    date = F.col("release_date_for_display") if "release_date_for_display" in raw.columns else F.lit(None).cast("string")
    return raw.select("id", F.trim("title").alias("title"), lead["id"].alias("artist_id"), lead["name"].alias("artist"), F.col("album")["name"].alias("album"), F.regexp_extract(date, r"(\d{4})", 1).try_cast("int").alias("year"))
