"""Queries that fold songs into artists, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from strophe.functions.text import token_table
from strophe.functions.words import ALL_STOPWORDS, DEMOS
from strophe.operators import artist, clock, song
from strophe.plans.song_queries import ORACLES as SONG_SQL
from strophe.plans.sqltext import SONGS, TIMED, TOKENS, holds_sql, words_sql
from strophe.sources.tables import songs, table, timed_lines


def artist_fold(spark, sf):
    s = songs(spark, sf)
    return artist.artist_fold(s, token_table(s))


def artist_top_words(spark, sf):
    return artist.artist_top_words(token_table(songs(spark, sf)))


def artist_top_words_no_stop(spark, sf):
    return artist.artist_top_words(token_table(songs(spark, sf)), 100, ALL_STOPWORDS)


def language_mix(spark, sf):
    return artist.language_mix(songs(spark, sf))


def density_curve(spark, sf):
    start = timed_lines(spark, sf)
    first = start.groupBy("song_id").agg(F.min("at").alias("zero"))
    curves = clock.decile_curve(start.join(first, "song_id").select("song_id", (F.col("at") - F.col("zero")).alias("at"), "words"))
    return artist.density_curve(curves.withColumn("artist", F.col("song_id") % 10))


def album_rollup(spark, sf):
    s = songs(spark, sf)
    counted = artist.counted_songs(s).withColumn("duration", F.col("song_id") % 300 + 20)
    return artist.album_rollup(clock.words_per_minute(counted), token_table(s))


def catalogue_list(spark, sf):
    return artist.catalogue_list(artist.counted_songs(songs(spark, sf)))


def artist_texture(spark, sf):
    s = songs(spark, sf)
    return artist.texture(song.song_reading(s), song.title_drops(s))


def orders_as_catalogues(spark, sf):
    """Customers as artists, orders as songs, quantities as words."""
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("song_id")).agg(F.sum("l_quantity").cast("long").alias("wc"), F.count(F.lit(1)).alias("lines"))
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("song_id"), F.col("o_custkey").alias("artist"), "o_orderpriority", "o_orderstatus", F.year("o_orderdate").cast("long").alias("year"))
    return orders.join(lines, "song_id")


def merged_catalogue(spark, sf):
    rows = orders_as_catalogues(spark, sf)
    side = lambda status: rows.where(F.col("o_orderstatus") == status).groupBy("artist", F.col("o_orderpriority").alias("title_key")).agg(F.min("song_id").alias("song_id"), F.max("wc").alias("wc"), F.bround(F.sum("lines") / F.count(F.lit(1)) / 7, 4).alias("ttr"), F.bround(F.min("lines") / 7, 4).alias("chorus"), (F.max("lines") > 3).alias("has_sections"))
    return artist.merged_summary(artist.merge_catalogues(side("O"), side("F")))


def merged_count(spark, sf):
    rows = orders_as_catalogues(spark, sf)
    titles = rows.where("o_orderstatus = 'O'").select("artist", "year").union(rows.where("o_orderstatus = 'F'").select("artist", "year")).distinct()
    return titles.groupBy("artist").agg(F.count(F.lit(1)).alias("titles"))


QUERIES = {f.__name__: f for f in (artist_fold, artist_top_words, artist_top_words_no_stop, language_mix, density_curve, album_rollup, catalogue_list, artist_texture, merged_catalogue, merged_count)}

COUNTED = f"""{TOKENS}, cs as (select song_id, any_value(artist) artist, any_value(lang) lang, count(*) wc, count(distinct word) uniq, round_even(count(distinct word)::double / count(*)::double, 4) ttr from tokens group by song_id),
counted as (select cs.*, songs.title from cs join songs using (song_id))"""
ARTIST_WORDS = "aw as (select artist, word, count(*) uses from tokens group by 1, 2)"
LONG_LINES = "with o as (select l_orderkey song_id, sum(l_quantity)::bigint wc, count(*) lines from lineitem group by 1), rows_ as (select o_orderkey song_id, o_custkey artist, o_orderpriority, o_orderstatus, year(o_orderdate)::bigint \"year\", wc, lines from orders join o on o_orderkey = song_id)"

ORACLES = {
    "artist_fold": f"""
        with {COUNTED},
        fit as (select *, wc >= 80 and not ({holds_sql("lower(title)", DEMOS)}) fit from counted),
        pool as (select * from fit qualify fit or not bool_or(fit) over (partition by artist)),
        hi as (select artist, arg_min(song_id, (-wc, song_id)) longest_song, max(wc) longest_words, arg_min(song_id, (wc, song_id)) shortest_song, arg_min(song_id, (-ttr, song_id)) richest_song from pool group by 1),
        w as (select artist, word, count(*) n, min((song_id, pos)) f from tokens group by 1, 2),
        v as (select artist, count(*) total_unique_words, arg_min(word, (-n, f)) top_word, max(n) top_word_n from w group by 1),
        s as (select artist, count(*) song_count, sum(wc)::bigint total_words, round_even(sum(round(ttr * 10000)::bigint)::double / count(*)::double, 0) / 10000 t from counted group by 1)
        select artist, song_count, total_words, total_unique_words, round_even(total_words::double / song_count::double, 4) words_per_song, round_even(t, 4) avg_ttr, top_word, top_word_n, longest_song, longest_words, shortest_song, richest_song
        from s join v using (artist) join hi using (artist)""",
    "artist_top_words": f"""
        with {TOKENS}, {ARTIST_WORDS} select artist, row_number() over (partition by artist order by uses desc, word) "rank", word, uses from aw qualify "rank" <= 100""",
    "artist_top_words_no_stop": f"""
        with {TOKENS}, {ARTIST_WORDS}, r as (select *, row_number() over (partition by artist order by uses desc, word) r from aw qualify r <= 400)
        select artist, row_number() over (partition by artist order by r) "rank", word, uses from r where word not in ({words_sql(ALL_STOPWORDS)}) qualify "rank" <= 100""",
    "language_mix": f"""
        with {SONGS}, n as (select artist, lang, count(*) n from songs where lang is not null group by 1, 2)
        select artist, row_number() over (partition by artist order by n desc, lang) "rank", lang, round_even(n::double / (sum(n) over (partition by artist))::double, 3) share from n qualify "rank" <= 3""",
    "density_curve": f"""
        with {TIMED}, z as (select song_id, sec - min(sec) over (partition by song_id) sec, words from timed), t as (select *, max(sec) over (partition by song_id) + 5 total from z),
        p as (select song_id % 10 artist, least(9, floor(sec / total * 10)::bigint) part, sum(words) n from t group by 1, 2), k as (select song_id % 10 artist, count(distinct song_id) songs from timed group by 1),
        s as (select artist, unnest(range(10)) part from k where songs >= 5)
        select artist, part, round_even(coalesce(n, 0)::double / (sum(coalesce(n, 0)) over (partition by artist))::double, 3) share from s left join p using (artist, part)""",
    "album_rollup": f"""
        with {COUNTED}, s as (select artist, lang, count(*) songs, sum(wc)::bigint words, round_even(sum(round(ttr * 10000)::bigint)::double / count(*)::double, 0) / 10000 avg_ttr,
          round_even(sum(round(wpm * 10000)::bigint)::double / count(wpm)::double, 0) / 10000 avg_wpm from (select *, case when song_id % 300 + 20 >= 30 then round_even(wc * 600 / (song_id % 300 + 20)::double, 0) / 10 end wpm from counted) group by 1, 2 having count(*) >= 3),
        v as (select artist, lang, count(distinct word) unique_words from tokens group by 1, 2)
        select artist, lang album, songs, words, unique_words, avg_ttr, avg_wpm from s join v using (artist, lang) qualify row_number() over (partition by artist order by songs desc, lang) <= 12""",
    "catalogue_list": f"""
        with {COUNTED} select artist, row_number() over (partition by artist order by wc desc, song_id) place, song_id, wc, uniq from counted qualify place <= 500""",
    "artist_texture": f"""
        with r as ({SONG_SQL["song_reading"]}), d as ({SONG_SQL["title_drops"]}), x as (select * from r join d using (song_id))
        select artist, round_even(sum(round(hook * 10000)::bigint)::double / count(*)::double, 0) / 10000 avg_hook, round_even(sum(round(rep * 10000)::bigint)::double / count(*)::double, 0) / 10000 avg_rep, round_even(sum(round(q * 10000)::bigint)::double / count(*)::double, 0) / 10000 avg_q, round_even(sum(round(excl * 10000)::bigint)::double / count(*)::double, 0) / 10000 avg_excl, round_even(sum(round(one_word * 10000)::bigint)::double / count(*)::double, 0) / 10000 avg_one_word,
          arg_min(longest_word, (-length(longest_word), song_id)) longest_word, arg_min(top_line, (-top_line_n, song_id)) filter (top_line_n > 0) career_line, sum(drops)::bigint title_drops_total,
          arg_min(song_id, (-hook, song_id)) filter (wc >= 40) hookiest_song, arg_min(song_id, (-drops, song_id)) filter (wc >= 40 and drops > 0) biggest_title_drop
        from x group by artist""",
    "merged_catalogue": f"""
        {LONG_LINES}, side as (select o_orderstatus st, artist, o_orderpriority title_key, max(wc) wc, round_even(sum(lines)::double / count(*)::double / 7, 4) ttr, round_even(min(lines)::double / 7, 4) chorus, max(lines) > 3 has_sections from rows_ group by 1, 2, 3),
        m as (select * from side where st = 'F' or (st = 'O' and not exists (select 1 from side f where f.st = 'F' and f.artist = side.artist and f.title_key = side.title_key)))
        select artist, count(*) songs, count(*) filter (st = 'F') live_songs, sum(wc)::bigint total_words, round_even(sum(round(ttr * 10000)::bigint)::double / count(*)::double, 0) / 10000 avg_ttr, round_even(sum(round(chorus * 10000)::bigint) filter (has_sections)::double / count(*) filter (has_sections)::double, 0) / 10000 avg_chorus from m group by artist""",
    "merged_count": f"""{LONG_LINES} select artist, count(distinct "year") titles from rows_ where o_orderstatus in ('O', 'F') group by artist""",
}
