"""Queries on single songs, clocks and sections, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from strophe.functions.text import line_table, section_table, token_table
from strophe.functions.words import ALL_STOPWORDS
from strophe.operators import clock, song
from strophe.plans.sqltext import LINE_PARTS, LINES, SONGS, TIMED, TOKEN, TOKENS, words_sql
from strophe.sources.tables import songs, table, timed_lines

#: Lyrics with sections, which the tables have none of: the same literals on both sides.
SHEETS = (
    (1, "[Verse 1]\nriver runs\nover stone\n[Chorus]\nsing again\nsing again\n[Outro]\ngone"),
    (2, "no header here\njust lines"),
    (3, "[Refren]\nla la\n\n[Most]\nbridge line\n[Strofa 2]\none\ntwo\nthree"),
    (4, "[Intro]\n[Hook]\nhold on\n[?]\nlost words"),
    (5, ""),
    (6, "[Tekst pesme]\nnot a line\n[Pre-Chorus]\nalmost\n[Almost]\nthere"),
)


def sheets(spark):
    return spark.createDataFrame(list(SHEETS), "song_id long, lyrics string")


def song_stats(spark, sf):
    return song.song_stats(songs(spark, sf))


def song_reading(spark, sf):
    r = song.song_reading(songs(spark, sf))
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return r.withColumns({c: joined(c) for c in ("line_words", "top_line_at")})


def song_top_words(spark, sf):
    return song.top_words(token_table(songs(spark, sf)), 20)


def song_top_words_no_stop(spark, sf):
    return song.top_words(token_table(songs(spark, sf)), 20, ALL_STOPWORDS)


def longest_words(spark, sf):
    return song.longest_words(songs(spark, sf)).select("song_id", F.array_join("words", " ").alias("words"))


def word_length_histogram(spark, sf):
    return song.word_length_histogram(token_table(songs(spark, sf)))


def title_drops(spark, sf):
    return song.title_drops(songs(spark, sf))


def drop_lines(spark, sf):
    return song.drop_lines(songs(spark, sf)).select("song_id", F.array_join(F.transform("at", lambda x: x.cast("string")), ",").alias("at"))


def conversation_sheets(spark, sf):
    """Conversations as lyrics with sections: the role opens a section, the text is its lines."""
    turns = table(spark, sf, "conversations").select("conv_id", F.struct(F.col("turn").alias("t"), F.concat(F.lit("["), F.when(F.col("role") == "assistant", "Chorus").when(F.col("role") == "system", "Intro").otherwise("Verse"), F.lit("]\n"), F.coalesce("text", F.lit(""))).alias("x")).alias("p"))
    sheet = F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["x"]), "\n")
    return turns.groupBy(F.col("conv_id").alias("song_id")).agg(sheet.alias("lyrics")).select("song_id", (F.col("song_id") % 20).cast("string").alias("artist"), F.lit("en").alias("lang"), "lyrics", F.lit("").alias("title"))


def song_sections(spark, sf):
    return song.section_summary(section_table(conversation_sheets(spark, sf)))


def lean_songs(spark, sf):
    s = conversation_sheets(spark, sf)
    return song.lean_stats(song.song_stats(s), song.section_summary(section_table(s)))


def rhyme_pairs(spark, sf):
    return song.rhyme_pairs(line_table(songs(spark, sf)))


def section_shares(spark, sf):
    return song.section_summary(section_table(sheets(spark)))


def turn_sections(spark, sf):
    turns = table(spark, sf, "conversations").select(F.col("conv_id").alias("song_id"), F.col("turn").alias("section_no"), F.col("role").alias("kind"), (F.size(F.split(F.coalesce("text", F.lit("")), "\n"))).cast("long").alias("n_lines"))
    return song.section_summary(turns.withColumn("kind", F.when(F.col("kind") == "assistant", "chorus").when(F.col("kind") == "system", "other").otherwise("verse")))


def clock_summary(spark, sf):
    return clock.clock_summary(timed_lines(spark, sf))


def clock_curve(spark, sf):
    start = timed_lines(spark, sf)
    first = start.groupBy("song_id").agg(F.min("at").alias("zero"))
    timed = start.join(first, "song_id").select("song_id", (F.col("at") - F.col("zero")).alias("at"), "words")
    return clock.decile_curve(timed).select("song_id", F.posexplode("curve").alias("part", "words")).select("song_id", F.col("part").cast("long").alias("part"), "words")


def silences(spark, sf):
    return clock.silences(timed_lines(spark, sf), 86400.0)


QUERIES = {
    f.__name__: f
    for f in (
        song_stats, song_reading, song_top_words, song_top_words_no_stop, longest_words, word_length_histogram, title_drops, drop_lines, rhyme_pairs,
        section_shares, turn_sections, song_sections, lean_songs, clock_summary, clock_curve, silences,
    )
}

SHEETS_SQL = ", ".join(f"({i}, '{t}')" for i, t in SHEETS).replace("\n", "' || chr(10) || '")
COUNTED = "c as (select song_id, word, count(*) uses, min(pos) as first from tokens group by 1, 2)"
SECTION_SUMMARY = """
    select song_id, count(*) n_sections, string_agg(kind, ',' order by section_no) kinds,
           (select string_agg(k || ':' || n, ',' order by k) from (select k, count(*) n from unnest(list(kind)) t(k) group by k)) kind_counts, bool_or(kind <> 'other') has_sections,
           case when sum(n_lines) > 0 then round_even(sum(case when kind in ('chorus', 'refrain') then n_lines else 0 end)::double / sum(n_lines)::double, 4) else 0.0::double end chorus_ratio
    from sections group by song_id"""

SECTIONS = r"""x as (select song_id::bigint song_id, unnest(string_split(lyrics, chr(10))) line, unnest(range(len(string_split(lyrics, chr(10))))) ln from sheets),
        h as (select *, regexp_matches(line, '^\s*\[[^\]]*\]\s*$') head, sum(regexp_matches(line, '^\s*\[[^\]]*\]\s*$')::int) over (partition by song_id order by ln) no from x),
        s as (select song_id, no, lower(coalesce(max(regexp_extract(line, '\[([^\]]*)\]', 1)) filter (head), '')) name, count(*) filter (not head and trim(line) <> '') n_lines from h group by 1, 2),
        sections as (select song_id, no section_no, n_lines,
          case when contains(name, 'refren') or contains(name, 'hook') then 'chorus' when contains(name, 'stih') or contains(name, 'strofa') then 'verse' when contains(name, 'uvod') then 'intro'
               when contains(name, 'kraj') then 'outro' when contains(name, 'most') then 'bridge' when contains(name, 'chorus') then 'chorus' when contains(name, 'verse') then 'verse' when contains(name, 'bridge') then 'bridge'
               when contains(name, 'intro') then 'intro' when contains(name, 'outro') then 'outro' when contains(name, 'refrain') then 'refrain' else 'other' end kind
          from s where n_lines > 0 and not (contains(name, 'tekst pesme') or name = 'tekst' or contains(name, 'lyrics for') or ends_with(name, 'lyrics')))"""
CONV_SHEETS = """sheets as (select conv_id song_id, (conv_id % 20)::varchar artist, string_agg('[' || case role when 'assistant' then 'Chorus' when 'system' then 'Intro' else 'Verse' end || ']' || chr(10) || coalesce(text, ''), chr(10) order by turn) lyrics from conversations group by 1)"""

ORACLES = {
    "song_stats": f"""
        with {TOKENS}, {COUNTED},
        l1 as (select song_id, artist, list_filter(list_transform(string_split(lyrics, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')),
                      lambda x: x <> '' and not regexp_matches(x, '^\\s*\\[[^\\]]*\\]\\s*$')) l from songs),
        l2 as (select song_id, unnest(l) line from l1),
        hs as (select song_id, list_transform(list_filter(string_split(lyrics, chr(10)), lambda x: regexp_matches(x, '\\S')), lambda x: regexp_matches(x, '^\\s*\\[[^\\]]*\\]\\s*$')) hd from songs),
        ls as (select song_id, count(*) nl, count(distinct lower(line)) dl, sum(length(regexp_replace(line, '\\s', '', 'g'))) ch from l2 group by 1),
        pl as (select song_id, count(*) np, sum(n) sn, max(n) mx, min(n) mn from (select song_id, len(regexp_extract_all(lower(line), '{TOKEN}', 1)) n from l2) where n > 0 group by 1),
        ws as (select song_id, sum(uses) n, count(*) u, count(*) filter (uses = 1) h, sum(uses * length(word)) tl from c group by 1)
        select s.song_id, s.artist, coalesce(n, 0)::bigint word_count, coalesce(u, 0)::bigint unique_words, case when n > 0 then round_even(u::double / n::double, 4) else 0.0::double end ttr,
          case when n > 0 then coalesce(ch, 0) else 0 end::bigint chars_no_spaces, case when n > 0 then coalesce(nl, 0) else 0 end::bigint line_count,
          case when n > 0 then len(list_filter(list_transform(range(1, len(hd) + 1), lambda i: not hd[i] and (i = 1 or hd[i - 1])), lambda x: x)) else 0 end::bigint section_count,
          coalesce(h, 0)::bigint hapax_count, case when u > 0 then round_even(h::double / u::double, 4) else 0.0::double end hapax_ratio,
          case when n > 0 then round_even(tl * 100 / n::double, 0) / 100 else 0.0::double end avg_word_length,
          case when n > 0 and np > 0 then round_even(sn * 100 / np::double, 0) / 100 else 0.0::double end avg_words_per_line,
          case when n > 0 then coalesce(mx, 0) else 0 end::bigint longest_line_words, case when n > 0 then coalesce(mn, 0) else 0 end::bigint shortest_line_words,
          case when n > 0 and nl > 0 then round_even(1 - dl::double / nl::double, 4) else 0.0::double end repetition_ratio
        from songs s left join ws using (song_id) left join ls using (song_id) left join pl using (song_id) left join hs using (song_id)""",
    "song_reading": f"""
        with {TOKENS}, {COUNTED}, {LINE_PARTS},
        ws as (select song_id, sum(uses) wc, count(*) uniq, sum(uses * length(word)) chars, count(*) filter (uses = 1) "once", arg_min(word, (-length(word), first)) longest_word from c group by 1 having sum(uses) <= 2000),
        nc as (select song_id, norm, count(*) n, min(line_no) fl from nlines group by 1, 2),
        tops as (select song_id, arg_min(norm, (-n, fl)) tl, max(n) tn, sum(case when n >= 3 then n else 0 end) hooked, count(*) dn, sum(n) nl from nc group by 1),
        en as (select song_id, line_no, right(regexp_replace(strip_accents(lower(line)), '[^\\p{{L}}]', '', 'g'), 3) e from nlines), ep as (select *, lag(e) over (partition by song_id order by line_no) p from en),
        rh as (select song_id, count(*) filter (length(e) = 3 and length(p) = 3) pairs, count(*) filter (length(e) = 3 and length(p) = 3 and e = p) same from ep group by 1),
        lw as (select song_id, string_agg(len(regexp_extract_all(lower(line), '{TOKEN}', 1))::varchar, ',' order by line_no) line_words from nlines group by 1),
        ta as (select song_id, string_agg(line_no::varchar, ',' order by line_no) filter (norm = tl and tn >= 3) places from nlines join tops using (song_id) group by 1),
        marks as (select song_id, count(*) filter (ends_with(line, '?')) q, count(*) filter (ends_with(line, '!')) e, count(*) filter (not regexp_matches(line, '\\s')) o from nlines group by 1)
        select s.song_id, s.artist, wc::bigint wc, uniq::bigint uniq, round_even(uniq::double / wc::double, 4) ttr, round_even(chars * 100 / wc::double, 0) / 100 awl, case when pairs > 0 then round_even(same::double / pairs::double, 4) else 0.0::double end rhyme, line_words, coalesce(places, '') top_line_at, "once"::bigint "once", round_even(1 - dn::double / nl::double, 4) rep, round_even(q::double / nl::double, 4) q, round_even(e::double / nl::double, 4) excl, round_even(o::double / nl::double, 4) one_word,
          longest_word, nl::bigint line_count, case when tn >= 3 then tl else '' end top_line, case when tn >= 3 then tn else 0 end::bigint top_line_n, round_even(hooked::double / nl::double, 4) hook
        from songs s join ws using (song_id) join tops using (song_id) join marks using (song_id) join rh using (song_id) join lw using (song_id) join ta using (song_id)""",
    "song_top_words": f"""
        with {TOKENS}, {COUNTED}
        select song_id, row_number() over (partition by song_id order by uses desc, first) "rank", word, uses from c qualify "rank" <= 20""",
    "song_top_words_no_stop": f"""
        with {TOKENS}, {COUNTED},
        r as (select *, row_number() over (partition by song_id order by uses desc, first) r from c qualify r <= 60)
        select song_id, row_number() over (partition by song_id order by r) "rank", word, uses from r where word not in ({words_sql(ALL_STOPWORDS)}) qualify "rank" <= 20""",
    "longest_words": f"""
        with {TOKENS}, {COUNTED}, r as (select song_id, word, row_number() over (partition by song_id order by length(word) desc, word) r from c qualify r <= 10)
        select s.song_id, coalesce(string_agg(word, ' ' order by r), '') words from songs s left join r using (song_id) group by s.song_id""",
    "word_length_histogram": f"with {TOKENS} select song_id, length(word)::bigint \"length\", count(*) n from tokens group by 1, 2",
    "title_drops": f"""
        with {SONGS}, k as (select song_id, trim(regexp_replace(lower(regexp_replace(title, '\\([^)]*\\)|\\[[^\\]]*\\]', '', 'g')), '\\s+', ' ', 'g')) k, trim(regexp_replace(lower(lyrics), '\\s+', ' ', 'g')) t from songs)
        select song_id, case when length(k) between 3 and 60 and len(string_split(k, ' ')) <= 6 then (length(t) - length(replace(t, k, ''))) // length(k) else 0 end::bigint drops from k""",
    "drop_lines": f"""
        with {LINES}, k as (select song_id, trim(regexp_replace(lower(regexp_replace(title, '\\([^)]*\\)|\\[[^\\]]*\\]', '', 'g')), '\\s+', ' ', 'g')) k from songs)
        select k.song_id, coalesce(string_agg(line_no::varchar, ',' order by line_no) filter (contains(norm, k)), '') "at" from k left join nlines n on n.song_id = k.song_id where length(k) between 3 and 60 and len(string_split(k, ' ')) <= 6 group by k.song_id""",
    "rhyme_pairs": f"""
        with {LINES}, e as (select song_id, line_no, right(regexp_replace(strip_accents(lower(line)), '[^\\p{{L}}]', '', 'g'), 3) e from lines),
        p as (select *, lag(e) over (partition by song_id order by line_no) p from e)
        select song_id, count(*) filter (length(e) = 3 and length(p) = 3) pairs, count(*) filter (length(e) = 3 and length(p) = 3 and e = p) rhymes,
          case when pairs > 0 then round_even(rhymes::double / pairs::double, 4) else 0.0::double end rhyme from p group by song_id""",
    "section_shares": f"""
        with sheets(song_id, lyrics) as (values {SHEETS_SQL}), {SECTIONS}{SECTION_SUMMARY}""",
    "song_sections": f"with {CONV_SHEETS}, {SECTIONS}{SECTION_SUMMARY}",
    "turn_sections": f"""
        with sections as (select conv_id song_id, turn section_no, case role when 'assistant' then 'chorus' when 'system' then 'other' else 'verse' end kind, len(string_split(coalesce(text, ''), chr(10))) n_lines from conversations){SECTION_SUMMARY}""",
    "clock_summary": f"""
        with {TIMED}, g as (select *, lead(sec) over (partition by song_id order by sec) - sec gap, sum(words) over (partition by song_id order by sec range between 15.0 preceding and current row) burst from timed)
        select song_id, count(*) n_lines, round_even(min(sec), 1) first_s, round_even(max(sec), 1) last_s, round_even(max(gap), 1) gap_s, round_even(arg_max(sec, (gap, sec)) filter (gap is not null), 1) gap_at, max(burst)::bigint fast
        from g group by song_id having count(*) >= 4""",
    "clock_curve": f"""
        with {TIMED}, z as (select song_id, sec - min(sec) over (partition by song_id) sec, words from timed),
        t as (select *, max(sec) over (partition by song_id) + 5 total from z),
        p as (select song_id, least(9, floor(sec / total * 10)::bigint) part, sum(words)::bigint words from t group by 1, 2),
        s as (select song_id, unnest(range(10)) part from (select distinct song_id from p))
        select song_id, part, coalesce(words, 0)::bigint words from s left join p using (song_id, part)""",
    "silences": f"""
        with {TIMED}, g as (select song_id, sec, lead(sec) over (partition by song_id order by sec) - sec gap from timed)
        select song_id, round_even(sec, 3) "at", round_even(gap, 3) gap from g where gap >= 86400""",
}

ORACLES["lean_songs"] = rf"""
    with {CONV_SHEETS}, x as ({ORACLES["song_sections"]}), w as (select song_id, unnest(regexp_extract_all(lower(regexp_replace(lyrics, '(?m)^[^\S\n]*\[[^\]\n]*\][^\S\n]*$', '', 'g')), '{TOKEN}', 1)) word from sheets),
    n as (select song_id, count(*) wc, count(distinct word) uniq from w group by 1),
    l as (select song_id, unnest(string_split(lyrics, chr(10))) line from sheets), r as (select song_id, count(*) nl, count(distinct lower(regexp_replace(line, '^\s+|\s+$', '', 'g'))) dl from l where regexp_matches(line, '\S') and not regexp_matches(line, '^\s*\[[^\]]*\]\s*$') group by 1)
    select song_id, artist, wc, uniq, round_even(uniq::double / wc::double, 4) ttr, coalesce(chorus_ratio, 0.0) chorus, round_even(1 - dl::double / nl::double, 4) rep, coalesce(has_sections, false) has_sections, coalesce(kinds, '') kinds
    from sheets join n using (song_id) join r using (song_id) left join x using (song_id)"""
