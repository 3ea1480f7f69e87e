"""Payloads of songs and artists over stored and live catalogues, with their SQL.

Documents are the stored songs (but for those whose id leaves 3 when divided by
4); those whose id is divisible by 3, and conversations as sheets with
sections, are the live ones.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from strophe.functions.text import section_table, slug, token_table
from strophe.functions.words import ALL_STOPWORDS
from strophe.operators import artist, payload, song
from strophe.plans.corpus_queries import ORACLES as CORPUS_SQL
from strophe.plans.corpus_queries import archive_quantiles
from strophe.plans.song_queries import CONV_SHEETS, SECTION_SUMMARY, SECTIONS, conversation_sheets
from strophe.plans.song_queries import ORACLES as SONG_SQL
from strophe.plans.sqltext import SONGS, TOKEN, q, words_sql
from strophe.sources.tables import songs

LIVE_ID = 1_000_000_000


def stored_songs(spark, sf):
    return songs(spark, sf).where("song_id % 4 <> 3")


def live_songs(spark, sf):
    """``song_id, artist, lang, lyrics, title``."""
    docs = songs(spark, sf).where("song_id % 3 = 0").select("song_id", "artist", "lang", "lyrics", "title")
    talk = conversation_sheets(spark, sf).select(
        (F.col("song_id") + LIVE_ID).alias("song_id"), F.when(F.col("song_id") % 2 == 0, F.concat(F.lit("src"), F.col("song_id") % 20)).otherwise(F.concat(F.lit("act "), F.col("song_id") % 10)).alias("artist"),
        "lang", "lyrics", F.concat(F.lit("Talk No. "), F.col("song_id")).alias("title"),
    )
    return docs.union(talk)


def stored_rows(spark, sf):
    s = stored_songs(spark, sf)
    stats = song.song_stats(s).where("word_count > 0").select("song_id", F.col("repetition_ratio").alias("rep"))
    return payload.listed_rows(artist.counted_songs(s).join(stats, "song_id")).withColumns({"chorus": F.lit(0.0), "has_sections": F.lit(False)})


def live_rows(spark, sf):
    live = live_songs(spark, sf)
    lean = song.lean_stats(song.song_stats(live), song.section_summary(section_table(live)))
    return lean.join(live.select("song_id", "title"), "song_id")


def by_key(spark, sf):
    s = songs(spark, sf).select("song_id", "artist", "title", "lyrics")
    asked = s.select(F.col("song_id").alias("request_id"), F.upper("artist").alias("artist"), slug(F.col("title")).alias("title"))
    return payload.by_key(s, asked).select("request_id", "song_id")


def requests(spark, sf):
    """Every title, by its slug for odd ids, every live sheet, and a name that nothing has."""
    docs = songs(spark, sf).select(F.col("song_id").alias("request_id"), F.when(F.col("song_id") % 2 == 1, F.upper("artist")).otherwise(F.col("artist")).alias("artist"), F.when(F.col("song_id") % 2 == 1, slug(F.col("title"))).otherwise(F.col("title")).alias("title"))
    talk = live_songs(spark, sf).where(F.col("song_id") > LIVE_ID).select("song_id", slug(F.col("artist")).alias("artist"), slug(F.col("title")).alias("title"))
    return docs.union(talk).union(spark.createDataFrame([(-1, "nobody-at-all", "no-such-song")], "request_id long, artist string, title string"))


def song_payloads(spark, sf):
    live = live_songs(spark, sf)
    hooks = song.song_reading(live).select("song_id", "hook")
    return payload.song_payloads(requests(spark, sf), stored_rows(spark, sf), live_rows(spark, sf).join(hooks, "song_id", "left"), archive_quantiles(spark, sf))


def merged_songs(spark, sf):
    return payload.merged_songs(stored_rows(spark, sf), live_rows(spark, sf))


def artist_payloads(spark, sf):
    stored, live = token_table(stored_songs(spark, sf)), live_rows(spark, sf)
    merged = merged_songs(spark, sf)
    new = live_songs(spark, sf).join(titles(spark, sf, new=True), "song_id", "left_semi")
    fresh = song.word_counts(token_table(new), "artist")
    own = token_table(live_songs(spark, sf).join(stored_songs(spark, sf).select("artist").distinct(), "artist", "left_anti"))
    lists = lambda tokens, stop: artist.artist_top_words(tokens, payload.WORDS, stop, 60 if stop else 400)
    words = {}
    for name, stop in (("top_words", None), ("top_words_no_stop", ALL_STOPWORDS)):
        words[name] = payload.bumped(lists(stored, stop), fresh).union(lists(own, stop))
    totals = stored.groupBy("artist").agg(F.count(F.lit(1)).alias("total_words"))
    return payload.artist_payloads(totals, merged, words, live.groupBy("artist").agg(F.count(F.lit(1)).alias("n")))


def titles(spark, sf, new):
    """Live songs whose title the stored catalogue lacks."""
    key = F.lower(F.trim("title")).alias("_t")
    have = stored_rows(spark, sf).select("artist", key)
    return live_rows(spark, sf).select("song_id", "artist", key).join(have, ["artist", "_t"], "left_anti" if new else "left_semi")


def sorted_catalogue(spark, sf):
    rows = merged_songs(spark, sf).withColumn("album", F.when(F.col("song_id") % 5 == 0, "Evening Album"))
    fields = [(f"{a} {f} {up} {text}", a, text, f, up) for a in ("src1", "src8", "act 3") for f in ("title", "words", "unique", "variety") for up in (True, False) for text in ("", "EVENING ", "the")]
    return payload.sorted_catalogue(rows, spark.createDataFrame(fields, "request_id string, artist string, q string, field string, ascending boolean"))


def rebuilt_aggregates(spark, sf):
    s = stored_songs(spark, sf).where("song_id % 8 < 3")
    stats = song.song_stats(s).where("word_count > 0").select("song_id", F.col("repetition_ratio").alias("rep"))
    rows = artist.counted_songs(s).join(stats, "song_id")
    stored = rows.groupBy("artist").agg(F.count(F.lit(1)).alias("song_count"), F.sum("wc").alias("total_words"), (F.rint(F.sum("wc") * 100 / F.count(F.lit(1))) / 100).alias("avg_words_per_song"), artist.mean("ttr").alias("avg_ttr"), F.lit(0.0).alias("avg_chorus_ratio"), artist.mean("rep").alias("avg_repetition_ratio"))
    totals = songs(spark, sf).where("artist in ('src1', 'src2', 'src13')").groupBy("artist").agg(F.count(F.lit(1)).alias("total"))
    return payload.rebuilt_aggregates(stored, live_rows(spark, sf).where("song_id % 5 < 3 or artist = 'src4'"), totals)


def public_readings(spark, sf):
    """Readings as the objects that a page gets, taken apart again."""
    r = payload.public_reading(song.song_reading(songs(spark, sf)))
    got = F.from_json("reading", "wc long, uniq long, ttr double, top_line string, line_words array<long>, longest_word string, once long")
    r = r.withColumn("r", got)
    return r.select("song_id", "r.wc", "r.uniq", "r.ttr", "r.top_line", F.size("r.line_words").cast("long").alias("lines"), "r.longest_word", "r.once")


QUERIES = {f.__name__: f for f in (by_key, song_payloads, merged_songs, artist_payloads, sorted_catalogue, rebuilt_aggregates, public_readings)}

KEY = r"regexp_replace(lower(strip_accents({})), '[^\p{{L}}\p{{N}}]', '', 'g')".format
SLUG = r"regexp_replace(regexp_replace(lower(strip_accents({})), '[^\p{{L}}\p{{N}}]+', '-', 'g'), '^-|-$', '', 'g')".format
MEAN = "round_even(sum(round({0} * 10000)::bigint){1}::double / count({0}){1}::double, 0) / 10000".format
LIVE = f"""{SONGS}, conv as (select * from ({CONV_SHEETS[len("sheets as ("):-1]})),
live0 as (select song_id, artist, lyrics, title from songs where song_id % 3 = 0
  union all select song_id + {LIVE_ID}, case when song_id % 2 = 0 then 'src' || song_id % 20 else 'act ' || song_id % 10 end, lyrics, 'Talk No. ' || song_id from conv),
sheets as (select song_id, artist, lyrics from live0), {SECTIONS}, sm as ({SECTION_SUMMARY}),
lt as (select song_id, artist, unnest(regexp_extract_all(lower(regexp_replace(lyrics, '(?m)^[^\\S\\n]*\\[[^\\]\\n]*\\][^\\S\\n]*$', '', 'g')), {q(TOKEN)}, 1)) word from live0),
ln as (select song_id, count(*) wc, count(distinct word) uniq from lt group by 1),
ll as (select song_id, unnest(string_split(lyrics, chr(10))) line, unnest(range(len(string_split(lyrics, chr(10))))) at_ from live0),
lc as (select song_id, at_, regexp_replace(line, '^\\s+|\\s+$', '', 'g') line from ll where regexp_matches(line, '\\S') and not regexp_matches(line, '^\\s*\\[[^\\]]*\\]\\s*$')),
lr as (select song_id, count(*) nl, count(distinct lower(line)) dl from lc group by 1),
live as (select song_id, artist, title, wc, uniq, round_even(uniq::double / wc::double, 4) ttr, coalesce(chorus_ratio, 0.0) chorus, round_even(1 - dl::double / nl::double, 4) rep, coalesce(has_sections, false) has_sections
  from live0 join ln using (song_id) join lr using (song_id) left join sm using (song_id))"""
STORED = f"""st as (select song_id, artist, title, lyrics from songs where song_id % 4 <> 3),
stt as (select song_id, artist, unnest(w) word, unnest(range(len(w))) pos from (select song_id, artist, regexp_extract_all(lower(lyrics), {q(TOKEN)}, 1) w from st)),
sn as (select song_id, artist, count(*) wc, count(distinct word) uniq from stt group by 1, 2),
sl as (select song_id, unnest(string_split(lyrics, chr(10))) line from st), sr as (select song_id, count(*) nl, count(distinct lower(regexp_replace(line, '^\\s+|\\s+$', '', 'g'))) dl from sl where regexp_matches(line, '\\S') and not regexp_matches(line, '^\\s*\\[[^\\]]*\\]\\s*$') group by 1),
srows as (select sn.*, title, round_even(uniq::double / wc::double, 4) ttr, round_even(1 - dl::double / nl::double, 4) rep from sn join sr using (song_id) join st using (song_id)),
listed as (select artist, row_number() over (partition by artist order by wc desc, song_id) place, song_id, title, wc, uniq, round_even(round(ttr * 10000) / 100, 0) / 100 ttr, round_even(round(rep * 10000) / 100, 0) / 100 rep, 0.0::double chorus, false has_sections from srows qualify place <= 500)"""
MERGED = f"""{LIVE}, {STORED}, dd as (select artist, lower(trim(title)) t, max(place) place from listed group by 1, 2), vv as (select artist, lower(trim(title)) t, max(song_id) song_id from live group by 1, 2),
dr as (select l.*, t from dd join listed l using (artist, place)), vr as (select l.*, t from vv join live l using (artist, song_id)),
merged as (select artist, coalesce(v.song_id, d.song_id) song_id, coalesce(v.title, d.title) title, coalesce(v.wc, d.wc) wc, coalesce(v.uniq, d.uniq) uniq, coalesce(v.ttr, d.ttr) ttr, coalesce(v.chorus, d.chorus) chorus, coalesce(v.rep, d.rep) rep,
  coalesce(v.has_sections, d.has_sections) has_sections, case when v.t is null then 'dataset' when d.t is null then 'new' else 'live' end source from dr d full join vr v using (artist, t))"""


def standing_sql(name: str, value: str) -> str:
    return f"""case when songs is not null then len(list_filter({value}s, lambda x: x > {value})) + 1 end::bigint {name}_rank, {value}s[len({value}s) // 2 + 1] {name}_median, {value}s[1] {name}_low, {value}s[-1] {name}_high"""


def top_sql(name: str, stop: str, first: int) -> str:
    """Ranked words of stored artists with the uses of new songs, and of artists that are live alone."""
    ranked = lambda source: f"select artist, row_number() over (partition by artist order by r) r, word, n from (select *, row_number() over (partition by artist order by n desc, word) r from {source} qualify r <= {first}) where true {stop} qualify row_number() over (partition by artist order by r) <= 30"
    return f"""{name}_s as ({ranked("sc")}), {name}_b as (select s.artist, s.word, s.n + coalesce(f.n, 0) n, s.r from {name}_s s left join fc f using (artist, word)),
{name} as (select artist, string_agg(word || ':' || n, ',' order by n desc, r) {name} from {name}_b group by 1 union all select artist, string_agg(word || ':' || n, ',' order by r) from ({ranked("oc")}) group by 1)"""


ORACLES = {
    "by_key": f"""with {SONGS}, k as (select song_id, {KEY('artist')} a, {KEY('title')} t, lyrics from songs)
        select x.song_id request_id, min(y.song_id) song_id from k x join k y on x.a = y.a and x.t = y.t and trim(y.lyrics) <> '' where x.a <> '' and x.t <> '' group by 1""",
    "merged_songs": f"with {MERGED} select artist, song_id, title, wc, uniq, ttr, chorus, rep, has_sections, source from merged",
    "song_payloads": f"""
        with {LIVE}, {STORED}, cuts as ({CORPUS_SQL["archive_quantiles"]}),
        nc as (select song_id, regexp_replace(lower(line), '\\s+', ' ', 'g') norm, count(*) n from lc group by 1, 2), hk as (select song_id, round_even(sum(case when n >= 3 then n else 0 end)::double / sum(n)::double, 4) hook from nc group by 1),
        rq as (select song_id request_id, case when song_id % 2 = 1 then upper(artist) else artist end artist, case when song_id % 2 = 1 then {SLUG('title')} else title end title from songs
          union all select song_id, {SLUG('artist')}, {SLUG('title')} from live0 where song_id > {LIVE_ID} union all select -1, 'nobody-at-all', 'no-such-song'),
        ra as (select request_id, artist, title, {KEY('artist')} a, {KEY('title')} t from rq),
        lk as (select *, {KEY('artist')} a, {KEY('title')} t from listed), ca as (select a, min(artist) display, count(*) songs, list_sort(list(wc)) wcs, list_sort(list(ttr)) ttrs, list_sort(list(rep)) reps from lk group by 1),
        ro as (select * from lk qualify row_number() over (partition by a, t order by place) = 1),
        tx as (select l.*, hook, {KEY('artist')} a, {KEY('title')} t from live l left join hk on hk.song_id = l.song_id and l.wc <= 2000 qualify row_number() over (partition by {KEY('artist')}, {KEY('title')} order by l.song_id) = 1),
        px as (select request_id, coalesce(display, case when lower(ra.artist) = tx.artist then ra.artist else tx.artist end) artist, coalesce(ro.title, tx.title) title, tx.a is not null complete, ro.a is not null has_row,
          coalesce(tx.wc, ro.wc) wc, coalesce(tx.uniq, ro.uniq) uniq, coalesce(tx.ttr, ro.ttr) ttr, coalesce(tx.rep, ro.rep) rep, hook, coalesce(tx.has_sections, false) has_sections, songs, wcs, ttrs, reps
          from ra left join ca using (a) left join ro on ro.a = ra.a and ro.t = ra.t left join tx on tx.a = ra.a and tx.t = ra.t where ro.a is not null or tx.a is not null),
        lg as (select request_id, unnest(['wc', 'uniq', 'ttr', 'rep', 'hook']) metric, unnest([wc::double, uniq::double, ttr, rep, hook]) v, unnest(range(5)) i from px),
        pc as (select request_id, metric, i, round_even(least(100.0, greatest(0.0, (count(*) filter ("cut" < v) + count(*) filter ("cut" <= v))::double / 2.0 / 100.0 * 100)), 0)::bigint pct from lg join cuts using (metric) where v is not null group by 1, 2, 3),
        ps as (select request_id, string_agg(metric || ':' || pct, ',' order by i) percentiles from pc group by 1)
        select px.request_id, artist, title, case when complete then 'cache' else 'dataset' end source, complete, wc, uniq, ttr, rep, hook, has_sections, songs, case when songs is not null then has_row end in_catalogue,
          {standing_sql('words', 'wc')}, {standing_sql('variety', 'ttr')}, {standing_sql('repetition', 'rep')}, {SLUG('artist')} artist_slug, {SLUG('title')} title_slug, coalesce(percentiles, '') percentiles from px left join ps using (request_id)""",
    "artist_payloads": f"""
        with {MERGED}, sc as (select artist, word, count(*) n from stt group by 1, 2), nw as (select song_id from live l where not exists (select 1 from listed d where d.artist = l.artist and lower(trim(d.title)) = lower(trim(l.title)))),
        fc as (select artist, word, count(*) n from lt where song_id in (select song_id from nw) group by 1, 2), oc as (select artist, word, count(*) n from lt where artist not in (select artist from st) group by 1, 2),
        {top_sql('top_words', '', 30)}, {top_sql('top_words_no_stop', f'and word not in ({words_sql(ALL_STOPWORDS)})', 60)},
        fit as (select *, wc >= 80 and not (regexp_matches(lower(title), '[(\\[](?:demo|snippet|teaser|promo|skit)[)\\]]')) fit from merged), pool as (select * from fit qualify fit or not bool_or(fit) over (partition by artist)),
        hi as (select artist, arg_min(song_id, (-wc, song_id)) longest_song, max(wc) longest_words, arg_min(song_id, (wc, song_id)) shortest_song, arg_min(song_id, (-ttr, song_id)) richest_song from pool group by 1),
        tot as (select artist, count(*) stored from stt group by 1), ls as (select artist, count(*) n from live group by 1),
        sm2 as (select artist, count(*) song_count, sum(wc) all_, coalesce(sum(wc) filter (source = 'new'), 0) new_, {MEAN('ttr', '')} avg_ttr, {MEAN('rep', '')} avg_repetition_ratio, coalesce({MEAN('chorus', ' filter (has_sections)')}, 0.0) avg_chorus_ratio, bool_or(has_sections) has_sections from merged group by 1),
        y as (select *, (case when stored is null then all_ else stored + new_ end)::bigint total_words from sm2 left join tot using (artist) left join ls using (artist))
        select artist, song_count, total_words, round_even(total_words * 100 / song_count::double, 0) / 100 avg_words_per_song, avg_ttr, avg_chorus_ratio, avg_repetition_ratio, longest_song, longest_words, shortest_song, richest_song, top_words, top_words_no_stop, has_sections,
          case when stored is null then 'cache' else 'dataset' end source, stored is null and n < 20 limited, case when stored is null then n else song_count end cached_total from y join hi using (artist) left join top_words using (artist) left join top_words_no_stop using (artist)""",
    "sorted_catalogue": f"""
        with {MERGED}, rows_ as (select *, case when song_id % 5 = 0 then 'Evening Album' else '' end album from merged),
        rq as (select a || ' ' || f || ' ' || case when up then 'True' else 'False' end || ' ' || t request_id, a artist, lower(trim(t)) t, f, up from (values ('src1'), ('src8'), ('act 3')) a(a), (values ('title'), ('words'), ('unique'), ('variety')) f(f), (values (true), (false)) u(up), (values (''), ('EVENING '), ('the')) t(t)),
        hq as (select r.*, rq.* exclude (artist), case f when 'words' then wc::double when 'unique' then uniq::double when 'variety' then ttr else 0.0 end num, case when f = 'title' then lower(title) else '' end nam from rows_ r join rq using (artist) where t = '' or contains(lower(title), t) or contains(lower(album), t))
        select request_id, row_number() over (partition by request_id order by case when up then num else -num end, case when up then nam end nulls first, case when not up then nam end desc nulls last, song_id) place, song_id from hq""",
    "rebuilt_aggregates": f"""
        with {LIVE}, {STORED}, s8 as (select artist, count(*) song_count, sum(wc)::bigint total_words, round_even(sum(wc) * 100 / count(*)::double, 0) / 100 avg_words_per_song, {MEAN('ttr', '')} avg_ttr, 0.0::double avg_chorus_ratio, {MEAN('rep', '')} avg_repetition_ratio from srows where song_id % 8 < 3 group by 1),
        fr as (select artist, count(*) n, sum(wc)::bigint w, {MEAN('ttr', '')} t, {MEAN('chorus', '')} c, {MEAN('rep', '')} r from live where song_id % 5 < 3 or artist = 'src4' group by 1),
        kt as (select artist, count(*) total from songs where artist in ('src1', 'src2', 'src13') group by 1),
        b as (select *, greatest(coalesce(n, 0), coalesce(total, 0)) held from s8 left join fr using (artist) left join kt using (artist)), z as (select *, held > song_count and n is not null anew from b)
        select artist, case when anew then held else song_count end song_count, case when anew then w else total_words end total_words, case when anew then round_even(w * 100 / n::double, 0) / 100 else avg_words_per_song end avg_words_per_song, case when anew then t else avg_ttr end avg_ttr,
          case when anew then c else avg_chorus_ratio end avg_chorus_ratio, case when anew then r else avg_repetition_ratio end avg_repetition_ratio, case when anew then 'live_cache' else 'dataset' end source from z""",
}

ORACLES["public_readings"] = f"""with r as ({SONG_SQL["song_reading"]}) select song_id, wc, uniq, ttr, top_line, line_count lines, longest_word, "once" from r"""
