"""Queries on built catalogues, audits and evidence, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from strophe.functions.titles import PSEUDO, SITE
from strophe.operators import artist, editorial
from strophe.operators.classify import JUNK
from strophe.plans import artist_queries, corpus_queries, resolve_queries, song_queries
from strophe.plans.resolve_queries import canonical_sql, numbered_sql
from strophe.plans.sqltext import SONGS, q
from strophe.sources.tables import songs, table


def built_catalogues(spark, sf):
    s = songs(spark, sf)
    rows = artist.counted_songs(s).select("artist", "song_id", "title", "wc", "ttr").join(corpus_queries.non_song_reasons(spark, sf), "song_id")
    return editorial.build_catalogues(rows)


def clock_fold(spark, sf):
    clocks = song_queries.clock_summary(spark, sf)
    people = table(spark, sf, "events").select(F.col("user_id").alias("song_id")).distinct().withColumn("artist", F.col("song_id") % 10)
    return editorial.clock_fold(clocks, people)


def recurring_word(spark, sf):
    return editorial.recurring_word(artist_queries.artist_top_words_no_stop(spark, sf), ("and", "mit", "que", "con", "pour"))


def lead_figure(spark, sf):
    return editorial.lead_figure(corpus_queries.percentile_places(spark, sf), "song_id", {"ttr": 12})


def quote_evidence(spark, sf):
    return editorial.quote_evidence(corpus_queries.hook_quotes(spark, sf), corpus_queries.exclusive_words(spark, sf))


def review_sheet(spark, sf):
    rows = artist.counted_songs(songs(spark, sf)).groupBy("artist").agg(F.count(F.lit(1)).alias("songs"), F.sum("wc").alias("uploads"))
    return editorial.review_sheet(rows, spark.createDataFrame([("src7",), ("nobody",)], "artist string"), 25, 15)


def catalogue_diff(spark, sf):
    """Titles of all documents that no conversation, benchmark item or labelled document has."""
    s = songs(spark, sf).select("song_id", "artist", "title")
    listed = s.join(table(spark, sf, "labels").select(F.col("doc_id").alias("song_id")).distinct(), "song_id", "left_semi").select("title")
    first = lambda name: table(spark, sf, name).select(F.substring_index("text", "\n", 1).alias("title")).where("title is not null")
    return editorial.catalogue_diff(s, listed.union(first("benchmark")).union(first("conversations")))


def fragments(spark, sf):
    """Sources, and joint credits of two that hold half of the texts of each."""
    p = resolve_queries.prints(spark, sf)
    k = F.regexp_extract("artist", r"(\d+)", 1).cast("int")
    joint = p.where("song_id % 2 = 0").select(F.concat(F.lit("src"), F.floor(k / 2) * 2, F.lit(" & src"), F.floor(k / 2) * 2 + 1).alias("artist"), "fp")
    both = p.select("artist", "fp").union(joint)
    pages = both.groupBy("artist").agg(F.count(F.lit(1)).alias("songs"))
    return editorial.fragments(both, pages, 0.3, 5)


def twins(spark, sf):
    p = resolve_queries.prints(spark, sf)
    joint = p.where("song_id % 4 <> 1").select(F.concat(F.lit("the "), "artist").alias("artist"), "fp")
    return editorial.twins(p.select("artist", "fp").union(joint), p.select("artist").distinct())


def suspects(spark, sf):
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("song_id"), F.col("p_brand").alias("artist"), F.concat(F.col("p_name"), F.when(F.col("p_size") < 5, F.lit(" (live)")).otherwise("")).alias("title"))
    return editorial.suspects(parts)


def audit_layers(spark, sf):
    return editorial.audit_layers(corpus_queries.non_song_reasons(spark, sf))


def namesakes(spark, sf):
    """Sources with albums of single languages, but for every third source, whose albums mix them; one song in nine has no language."""
    k = F.regexp_extract("artist", r"(\d+)", 1).cast("int")
    album = F.when(k % 3 == 0, F.concat(F.lit("Mixed "), F.col("song_id") % 2)).otherwise(F.concat(F.lit("In "), "lang"))
    s = songs(spark, sf).select("artist", F.when((F.col("song_id") % 9 > 0) & ((k != 4) | (F.col("song_id") % 2 == 0)), F.col("lang")).alias("lang"), album.alias("album"), "song_id")
    return editorial.namesakes(s)


QUERIES = {f.__name__: f for f in (built_catalogues, clock_fold, recurring_word, lead_figure, quote_evidence, review_sheet, catalogue_diff, fragments, twins, suspects, audit_layers, namesakes)}

A, C, S = artist_queries.ORACLES, corpus_queries.ORACLES, song_queries.ORACLES
KEYS = f"n0 as (select song_id, artist, title, regexp_replace(title, {q(SITE)}, '') n from songs), n1 as (select song_id, artist, title, {canonical_sql(numbered_sql('n'))} k from n0), keys as (select song_id, artist, title, case when length(regexp_replace(k, '\\s+(?:19|20)\\d{{2}}$', '')) >= 3 then regexp_replace(k, '\\s+(?:19|20)\\d{{2}}$', '') else k end key from n1)"

ORACLES = {
    "built_catalogues": f"""
        with {artist_queries.COUNTED}, rs as ({C["non_song_reasons"]}), {KEYS},
        x as (select keys.*, wc, ttr from keys join counted using (song_id) join rs using (song_id) where reason is null),
        d as (select lower(trim(artist)) a, key, max(wc) wc, arg_min(song_id, (-wc, song_id)) song_id, arg_min(ttr, (-wc, song_id)) ttr, arg_min(title, (length(title), -song_id)) title from x group by 1, 2),
        sp as (select lower(trim(artist)) a, arg_max(artist, (n, artist)) artist from (select artist, count(*) n from x group by 1) group by 1),
        f as (select *, wc >= 80 and not regexp_matches(lower(title), '[(\\[](?:demo|snippet|teaser|promo|skit)[)\\]]') fit from d), pool as (select * from f qualify fit or not bool_or(fit) over (partition by a)),
        hi as (select a, arg_min(song_id, (-wc, song_id)) longest_song, max(wc) longest_words, arg_min(song_id, (wc, song_id)) shortest_song, arg_min(song_id, (-ttr, song_id)) richest_song from pool group by 1),
        su as (select a, count(*) song_count, sum(wc)::bigint total_words, round_even(sum(wc)::double / count(*)::double, 4) words_per_song, round_even(sum(round(ttr * 10000)::bigint)::double / count(*)::double, 0) / 10000 avg_ttr from d group by 1 having count(*) >= 5)
        select sp.artist, song_count, total_words, words_per_song, avg_ttr, longest_song, longest_words, shortest_song, richest_song from su join sp using (a) join hi using (a)""",
    "clock_fold": f"""
        with c as ({S["clock_summary"]}), p as (select distinct user_id song_id, user_id % 10 artist from events)
        select artist, round_even(count(first_s)::double / count(*)::double, 4) synced_share, round_even(sum(round(first_s * 10)::bigint)::double / count(first_s)::double, 0) / 10 avg_first_s, max(gap_s) longest_silence_s,
          arg_min(song_id, (-gap_s, song_id)) filter (gap_s is not null) silent_song, max(fast) fastest_burst, arg_min(song_id, (-fast, song_id)) filter (fast is not null) fast_song from p left join c using (song_id) group by artist""",
    "recurring_word": f"""with r as ({A["artist_top_words_no_stop"]}) select artist, arg_min(word, "rank") word, arg_min(uses, "rank") uses from r where not regexp_matches(word, '[''’]') and length(word) >= 3 and word not in ('and', 'mit', 'que', 'con', 'pour') and not ({corpus_queries.ADLIB.format(w="word")}) group by artist""",
    "lead_figure": f"""with p as ({C["percentile_places"]}) select song_id, metric, pct from p where not (metric = 'ttr' and abs(pct - 50) < 12) and abs(pct - 50) >= 15 qualify row_number() over (partition by song_id order by abs(pct - 50) desc, metric) = 1""",
    "quote_evidence": f"""
        with h as ({C["hook_quotes"]}), e as (select distinct artist, word, true k from ({C["exclusive_words"]}))
        select artist, word, coalesce(k, false) counted, list_contains(regexp_extract_all(lower(line), '([\\p{{L}}\\p{{Nl}}\\p{{No}}]+(?:[''’][\\p{{L}}\\p{{Nl}}\\p{{No}}]+)*)', 1), word) quoted from h left join e using (artist, word)""",
    "review_sheet": f"""
        with {artist_queries.COUNTED}, a as (select artist, count(*) songs, sum(wc)::bigint uploads from counted group by 1), x as (select *, artist = 'src7' m from a where artist = 'src7' or (songs >= 25 and not regexp_matches(artist, {q(PSEUDO)})))
        select row_number() over (order by m desc, uploads desc, artist) place, artist, songs, uploads from x qualify place <= 15""",
    "catalogue_diff": f"""
        with {SONGS}, {KEYS}, ot as (select split_part(text, chr(10), 1) title from benchmark union select split_part(text, chr(10), 1) from conversations where text is not null),
        o0 as (select title, regexp_replace(title, {q(SITE)}, '') n from ot), o1 as (select {canonical_sql(numbered_sql('n'))} k from o0), ok as (select case when length(regexp_replace(k, '\\s+(?:19|20)\\d{{2}}$', '')) >= 3 then regexp_replace(k, '\\s+(?:19|20)\\d{{2}}$', '') else k end key from o1
          union select key from keys where song_id in (select doc_id from labels))
        select song_id, artist, title from keys where key not in (select key from ok)""",
    "fragments": f"""
        with {resolve_queries.PRINTS}, al as (select artist, fp from fps union all select 'src' || (k // 2 * 2) || ' & src' || (k // 2 * 2 + 1), fp from (select fp, song_id, regexp_extract(artist, '(\\d+)', 1)::int k from fps) where song_id % 2 = 0),
        pg as (select artist, count(*) songs from al group by 1), st as (select distinct artist, fp from al), cr as (select artist whole, unnest(string_split(artist, ' & ')) part from pg where contains(artist, ' & ')),
        jd as (select whole, part from cr join pg on pg.artist = part where songs >= 5), n as (select artist part, count(*) n from st group by 1),
        hs as (select distinct j.part, j.whole, s.fp from jd j join st s on s.artist = j.part where exists (select 1 from st o where o.fp = s.fp and (o.artist = j.whole or (o.artist <> j.part and o.artist in (select part from cr c where c.whole = j.whole))))),
        o as (select part, whole, round_even(count(*)::double / any_value(n)::double, 4) "overlap" from hs join n using (part) group by 1, 2) select part, whole, "overlap" from o where "overlap" >= 0.3""",
    "twins": f"""
        with {resolve_queries.PRINTS}, st as (select artist, fp from fps union select 'the ' || artist, fp from fps where song_id % 4 <> 1), m as (select distinct artist, fp from fps),
        b as (select x.artist, y.artist twin, count(*) s from m x join st y on x.fp = y.fp and x.artist <> y.artist group by 1, 2), n as (select artist, count(*) n from m group by 1),
        t as (select artist, arg_max(twin, (s, twin)) twin, max(s) s from b group by 1) select artist, twin, round_even(s::double / n::double, 4) "overlap" from t join n using (artist) where round_even(s::double / n::double, 4) >= 0.5""",
    "suspects": f"""
        with x as (select p_partkey song_id, p_brand artist, p_name || case when p_size < 5 then ' (live)' else '' end title from part), h as (select *, row_number() over (partition by artist order by title, song_id) r, count(*) over (partition by artist) n from x where regexp_matches(lower(title), {q(JUNK)}))
        select artist, n, string_agg(title, ' / ' order by r) titles from h where r <= 6 group by artist, n""",
    "audit_layers": f"""with r as ({C["non_song_reasons"]}) select coalesce(reason, 'kept') layer, count(*) n from r group by 1""",
    "namesakes": f"""
        with {SONGS}, k as (select song_id, artist, lang l0, regexp_extract(artist, '(\\d+)', 1)::int k from songs), r as (select song_id, artist, case when song_id % 9 > 0 and (k <> 4 or song_id % 2 = 0) then l0 end lang, case when k % 3 = 0 then 'mixed ' || song_id % 2 else 'in ' || l0 end a from k),
        n as (select artist, lang, count(*) songs from r where lang is not null group by 1, 2), m as (select artist, arg_max(lang, (songs, lang)) main, sum(songs) labelled from n group by 1), t as (select artist, count(*) total from r group by 1),
        sh as (select artist, a from (select distinct artist, a, coalesce(lang, '') lang from r where a is not null) group by 1, 2 having count(*) > 1)
        select n.artist, n.lang, songs, main from n join m using (artist) join t using (artist) where n.lang <> main and (total - labelled)::double / total::double <= 0.4 and songs >= 2 and songs::double / labelled::double <= 0.6
          and not (n.lang in ('es', 'fr') and main in ('es', 'fr')) and not exists (select 1 from r join sh using (artist, a) where r.artist = n.artist and r.lang = n.lang)""",
}
