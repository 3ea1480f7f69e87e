"""Queries over the whole corpus, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from strophe.functions.text import line_table, token_table, word_table
from strophe.functions.titles import GUARD
from strophe.functions.words import ALL_STOPWORDS, CREDITS, EN_SPELLINGS, ENGLISH, JUNK_ALL_THE_SAME, JUNK_EXCEPTIONS, LABELS, NOT_SONGS, STOPWORDS
from strophe.operators import artist, classify, corpus, song
from strophe.plans.artist_queries import COUNTED, LONG_LINES, orders_as_catalogues
from strophe.plans.artist_queries import ORACLES as ARTIST_SQL
from strophe.plans.song_queries import ORACLES as SONG_SQL
from strophe.plans.sqltext import LINE_PARTS, SONGS, TOKEN, TOKENS, holds_sql, q, words_sql
from strophe.sources.scratch import Tables
from strophe.sources.tables import songs, table

METRICS = ["word_count", "unique_words", "ttr", "hapax_ratio", "avg_word_length", "line_count", "avg_words_per_line", "repetition_ratio"]


def artist_words(spark, sf):
    return corpus.artist_words(word_table(songs(spark, sf)))


def song_counts(spark, sf):
    return artist.counted_songs(songs(spark, sf)).groupBy("artist").agg(F.count(F.lit(1)).alias("songs"))


def word_df(spark, sf):
    return corpus.document_frequency(artist_words(spark, sf))


def exclusive_words(spark, sf):
    return corpus.exclusive_words(artist_words(spark, sf), ALL_STOPWORDS)


def signature_words(spark, sf):
    return corpus.signature_words(artist_words(spark, sf), ALL_STOPWORDS).select("artist", "rank", "word", "ratio")


def singers(spark, sf):
    """Documents as songs of one artist for each source and language."""
    return songs(spark, sf).withColumn("artist", F.concat_ws("/", "artist", "lang"))


def singer_words(spark, sf):
    return corpus.artist_words(word_table(singers(spark, sf)))


def word_frequency(spark, sf):
    """How many artists of a language use a word five times or more."""
    tokens = token_table(singers(spark, sf))
    return corpus.language_document_frequency(tokens)


def usable_words(spark, sf):
    s = singers(spark, sf)
    tokens = token_table(s)
    people = tokens.groupBy("artist").agg(F.count_distinct("song_id").alias("songs"), F.min("lang").alias("lang")).withColumn("display", F.concat(F.lit("The "), "artist"))
    return corpus.usable_words(singer_words(spark, sf), people, word_frequency(spark, sf), corpus.credit_spread(tokens), ALL_STOPWORDS, ("en", "de", "fr"))


def signature_score(spark, sf):
    return corpus.signature_score(usable_words(spark, sf))


def staples(spark, sf):
    return corpus.staples(singer_words(spark, sf), usable_words(spark, sf))


def artist_staple(spark, sf):
    return corpus.staple(singer_words(spark, sf), usable_words(spark, sf))


def hook_quotes(spark, sf):
    """Conversations as songs, whose lines repeat often enough for hooks."""
    from strophe.operators.song import song_reading

    sheets = turn_songs(spark, sf)
    lines = song_reading(sheets).select("artist", "song_id", "top_line", "top_line_n").join(sheets.select("song_id", "title"), "song_id")
    words = corpus.artist_words(word_table(sheets)).where("uses >= 6 and length(word) >= 4").select("artist", "word")
    return corpus.hook_quotes(lines, words)


def turn_songs(spark, sf):
    """All that a role says in a conversation, three times over, as one song."""
    turns = table(spark, sf, "conversations").where("text is not null").select("conv_id", "role", F.struct(F.col("turn").alias("t"), F.col("text").alias("x")).alias("p"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["x"]), "\n")
    rows = turns.groupBy("conv_id", "role").agg(text.alias("lyrics"))
    number = F.col("conv_id") * 4 + F.when(F.col("role") == "assistant", 1).when(F.col("role") == "system", 2).otherwise(0)
    title = F.when(F.col("conv_id") % 5 == 0, "Evening Song (Live)").when(F.col("conv_id") % 7 == 0, "Night Mashup").otherwise("Morning Song")
    return rows.select(number.alias("song_id"), F.concat(F.lit("act "), F.col("conv_id") % 10).alias("artist"), F.lit("en").alias("lang"), F.concat_ws("\n", "lyrics", "lyrics", "lyrics").alias("lyrics"), title.alias("title"))


def motif_quotes(spark, sf):
    # the words are read four times and the motifs are few, which a written table tells the planner
    tables = Tables(spark, "motifs")
    words = tables.write(artist_words(spark, sf))
    own = tables.write(corpus.exclusive_words(words, ALL_STOPWORDS, 30).select("artist", "rank", "word"))
    top = tables.write(artist.most_used(words.select("artist", "word", "uses"), 30).select("artist", "rank", "word"))
    people = own.select("artist").union(top.select("artist")).distinct().withColumn("display", F.col("artist"))
    motifs = tables.write(corpus.motif_word(own, top, people, ("ooh", "ah", "oh", "uh", "la", "da", "na")))
    tables.drop(words, own, top)
    return corpus.motif_quotes(line_table(songs(spark, sf)), motifs)


def curated_motifs(spark, sf):
    words = artist_words(spark, sf)
    computed = corpus.exclusive_words(words, ALL_STOPWORDS, 1)
    reviews = words.where("artist in ('src1', 'src4') and word = 'the'").select("artist", "word").union(spark.createDataFrame([("src2", "nowhere to be found")], "artist string, word string"))
    return corpus.curated_motifs(computed, reviews, words)


def artist_percentiles(spark, sf):
    s = songs(spark, sf)
    rows = artist.artist_fold(s, token_table(s))
    return corpus.percent_below(rows, "artist", ["song_count", "total_words", "total_unique_words", "words_per_song", "avg_ttr", "top_word_n"])


def language_word_df(spark, sf):
    return corpus.language_document_frequency(token_table(songs(spark, sf)))


def foreign_words(spark, sf):
    """Each document counts as an artist, so that shares as small as the rule asks for exist."""
    tokens = token_table(songs(spark, sf)).withColumn("artist", F.col("song_id"))
    return classify.foreign_words(corpus.language_document_frequency(tokens, 1, 1))


def archive_rows(spark, sf):
    """Orders as songs with all that the archive's percentiles count, in the same range of values."""
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("song_id")).agg(
        F.sum("l_quantity").cast("long").alias("wc"), F.count_distinct("l_partkey").alias("uniq"), F.count(F.lit(1)).alias("n"), F.count_distinct("l_returnflag").alias("kinds"),
        F.count_if(F.col("l_linestatus") == "O").alias("drops"), F.count_if(F.col("l_discount") > 0.05).alias("hooked"), F.count_if(F.col("l_tax") > 0.04).alias("same"), F.max("l_linenumber").cast("long").alias("last"),
    )
    rows = lines.join(table(spark, sf, "orders").withColumnRenamed("o_orderkey", "song_id"), "song_id")
    ratio = lambda a, b: F.bround(F.col(a) / F.col(b), 4)
    duration = F.col("o_custkey") % 400 + 1
    return rows.select(
        "song_id", "wc", "uniq", ratio("uniq", "wc").alias("ttr"), (1 - ratio("kinds", "n")).alias("rep"), ratio("hooked", "n").alias("hook"), ratio("same", "n").alias("rhyme"), "drops",
        (F.rint(F.col("wc") * 100 / F.col("n")) / 100).alias("awl"), ratio("kinds", "n").alias("q"), ratio("last", "wc").alias("one_word"), (F.rint(F.col("wc") * 600 / duration) / 10).alias("wpm"),
        (F.col("song_id") % 97).alias("first_s"), (F.col("song_id") % 61).alias("gap_s"), (F.col("song_id") % 43).alias("fast15"), duration.alias("duration"), (F.col("o_orderstatus") == "O").alias("has_synced"),
    )


def archive_quantiles(spark, sf):
    return corpus.quantile_cuts(corpus.archive_metrics(archive_rows(spark, sf)), list(corpus.SONG_METRICS), 1000)


def archive_places(spark, sf):
    rows = corpus.archive_metrics(archive_rows(spark, sf))
    places = corpus.percentile_places(rows, "song_id", corpus.quantile_cuts(rows, list(corpus.SONG_METRICS), 1000), list(corpus.SONG_METRICS))
    return places.withColumn("phrase", corpus.percentile_phrase(F.col("pct")))


def catalogue_points(spark, sf):
    return corpus.catalogue_points(archive_rows(spark, sf).withColumn("artist", F.col("song_id") % 20), "wc")


def standing_phrases(spark, sf):
    return catalogue_standing(spark, sf).select("artist", "song_id", corpus.standing_phrase(F.col("rank"), F.col("of")).alias("phrase"))


def function_words(spark, sf):
    df = language_word_df(spark, sf)
    return classify.function_words(df.select("lang", "word"), df, ALL_STOPWORDS)


def quantile_cuts(spark, sf):
    return corpus.quantile_cuts(song.song_stats(songs(spark, sf)), METRICS)


def percentile_places(spark, sf):
    stats = song.song_stats(songs(spark, sf))
    return corpus.percentile_places(stats, "song_id", corpus.quantile_cuts(stats, METRICS), METRICS)


def interesting_stats(spark, sf):
    return corpus.interesting(percentile_places(spark, sf), "song_id")


def catalogue_standing(spark, sf):
    return corpus.catalogue_standing(orders_as_catalogues(spark, sf).select("artist", "song_id", "wc"), "wc")


def archive_size(spark, sf):
    return artist.counted_songs(songs(spark, sf)).agg(F.count(F.lit(1)).alias("songs"), F.sum("wc").alias("words"))


def repetition_median(spark, sf):
    return song.song_stats(songs(spark, sf)).groupBy("artist").agg(F.bround(F.median("repetition_ratio"), 4).alias("median_repetition"))


def non_song_reasons(spark, sf):
    s = songs(spark, sf)
    words = s.join(artist.counted_songs(s).select("song_id", "wc", "ttr"), "song_id", "left").withColumn("w", F.regexp_extract_all(F.lower("lyrics"), F.lit(r"([a-z]+)"), F.lit(1)))
    return words.select("song_id", classify.non_song_reason(F.col("title"), F.coalesce("wc", F.lit(0)), F.coalesce("ttr", F.lit(0.0)), F.col("w")).alias("reason"))


def song_language(spark, sf):
    return classify.language_by_words(token_table(songs(spark, sf))).select("song_id", "guess")


def main_language(spark, sf):
    """Each document's language by its 30 most used words; some texts are given the letters of other scripts."""
    greek = F.translate(F.lower("lyrics"), "abcdefghijklmnopqrstuvwxyz", "".join(chr(0x3B1 + k) for k in range(24)) + "αβ")
    kana = F.translate(F.lower("lyrics"), "abcdefghijklmnopqrstuvwxyz", "".join(chr(0x30A2 + k) for k in range(26)))
    n = F.col("song_id") % 15
    return classify.song_language(token_table(songs(spark, sf).withColumn("lyrics", F.when(n == 0, kana).when(n == 5, greek).otherwise(F.col("lyrics")))))


def detected_language(spark, sf):
    return classify.detected_language(songs(spark, sf), classify.share_detector(STOPWORDS), least=0.6).select("song_id", "detected")


def filler_words(spark, sf):
    words = token_table(songs(spark, sf)).select("word").distinct()
    return words.select("word", classify.filler(F.col("word"), ALL_STOPWORDS).alias("filler"), classify.grammar_word(F.col("word"), ALL_STOPWORDS, ("that", "with", "this")).alias("grammar"))


def adlib_words(spark, sf):
    return token_table(songs(spark, sf)).select("word").distinct().where(classify.adlib(F.col("word")))


def weak_labels(spark, sf):
    """Parts, some of which are titled like pages of other kinds."""
    n = F.col("p_partkey") % 6
    title = F.when(n == 0, F.concat(F.lit("Interview: "), "p_name")).when(n == 1, F.concat("p_name", F.lit(" (Liner Notes)"))).when(n == 2, F.concat(F.lit("Tour Dates Freestyle "), "p_name")).when(n == 3, F.lit(" x ")).otherwise(F.col("p_name"))
    return table(spark, sf, "part").select("p_partkey", classify.weak_label(title).alias("label"))


def shared_vocabulary(spark, sf):
    """Extension: how many words each pair of languages shares, and each has alone."""
    words = token_table(songs(spark, sf)).select("lang", "word").distinct()
    n = words.groupBy("word").agg(F.count(F.lit(1)).alias("langs"))
    return words.join(n, "word").groupBy("lang").agg(F.count(F.lit(1)).alias("words"), F.count_if(F.col("langs") == 1).alias("alone"), F.count_if(F.col("langs") > 1).alias("shared"))


def rollup_words(spark, sf):
    """Extension: words by language and artist with subtotals."""
    return artist.counted_songs(songs(spark, sf)).rollup("lang", "artist").agg(F.count(F.lit(1)).alias("songs"), F.sum("wc").alias("words"))


QUERIES = {
    f.__name__: f
    for f in (
        word_df, exclusive_words, signature_words, word_frequency, usable_words, signature_score, staples, artist_staple, hook_quotes, motif_quotes, curated_motifs,
        archive_quantiles, archive_places, catalogue_points, standing_phrases, artist_percentiles, language_word_df, foreign_words, function_words,
        quantile_cuts, percentile_places, interesting_stats, catalogue_standing, archive_size, repetition_median, non_song_reasons, song_language, main_language, detected_language, filler_words, adlib_words,
        weak_labels, shared_vocabulary, rollup_words,
    )
}

STOP = words_sql(ALL_STOPWORDS)
ADLIB = r"""regexp_matches({w}, '^(?:[aeiouy]+h*|(?:la|na|da|dah|ooh|ohh|aah|ah|oh|uh|eh|ey|ay|yeah|yah|yo|mm|hmm|ba|bum|whoa|woah|wah|ha|hey|oi|ra|ta|ti|di|du|lo|le|li|nah|yea|ye|wo|wa|ho|oo|ai|ya|yu|yi|hi|hu|hah|heh|huh|hum|shh|ssh|tsk|brr|grr)+h?)$')
  or (regexp_matches({w}, '^(?:(?:wh?|h|d)o{{2,}}h*|(?:wh|h)e{{2,}}h*|(?:he){{2,}}h?)+$') and {w} <> 'hoodoo') or {w} in ('wow', 'ugh', 'mwah', 'muah', 'meh', 'bleh', 'aha', 'umm', 'uhm', 'pow', 'baow', 'sheesh')
  or (length({w}) >= 4 and len(list_distinct(string_split({w}, ''))) <= 2) or (regexp_matches({w}, '^[\x00-\x7F]+$') and not regexp_matches({w}, '[aeiouy]'))"""
SPREAD = f"{TOKENS}, aw as (select artist, word, count(*) uses, count(distinct song_id) spread from tokens group by 1, 2)"
CANDIDATES = f"{SPREAD}, top250 as (select * from aw qualify row_number() over (partition by artist order by uses desc, word) <= 250), cand as (select * from top250 where length(word) >= 3 and uses >= 3 and word not in ({STOP}))"
EXCLUSIVE = f"{CANDIDATES}, alone as (select word from aw group by word having count(*) = 1), ex as (select artist, row_number() over (partition by artist order by uses desc, word) r, word, uses from cand where word in (select word from alone))"
SCOUNTS = "sc as (select artist, count(distinct song_id) songs from tokens group by 1)"
LANG_DF_OF = lambda artist, uses, least: f"""{TOKENS}, per as (select lang, {artist} artist, word from tokens group by 1, 2, 3 having count(*) >= {uses}), la as (select lang, count(distinct {artist}) artists from tokens group by 1),
ldf as (select lang, word, count(*) n, artists, round_even(ln((artists + 1)::double / (count(*) + 1)::double), 6) idf, round_even(count(*)::double / artists::double, 6) share from per join la using (lang) group by lang, word, artists having count(*) >= {least})"""  # noqa: E731
LANG_DF = LANG_DF_OF("artist", 5, 2)
UNPIVOT = "select song_id, metric, value from (select song_id, " + ", ".join(f"{m}::double {m}" for m in METRICS) + f" from st) unpivot (value for metric in ({', '.join(METRICS)}))"
CUTS = f"""st as ({SONG_SQL["song_stats"]}), long as ({UNPIVOT}), rk as (select metric, value, row_number() over (partition by metric order by value) - 1 i, count(*) over (partition by metric) n from long),
steps as (select unnest(range(101)) p), cuts as (select metric, p, value "cut" from rk, steps where round_even(p / 100.0::double * (n - 1), 0) = i)"""
PLACES = f"""{CUTS}, pl as (select song_id, l.metric, round_even(least(100.0, greatest(0.0, (count(*) filter ("cut" < value) + count(*) filter ("cut" <= value))::double / 2.0 / 100.0 * 100)), 0)::bigint pct from long l join cuts c on l.metric = c.metric group by song_id, l.metric)"""
SINGERS = f"""{TOKENS}, st as (select song_id, concat_ws('/', artist, lang) artist, lang, word, pos from tokens),
sw as (select artist, word, count(*) uses, count(distinct song_id) spread from st group by 1, 2), sl as (select artist, count(distinct song_id) songs, min(lang) lang from st group by 1), nl as (select lang, count(*) n_lang from sl group by 1),
wf as (select lang, word, count(*) n from (select lang, artist, word from st group by 1, 2, 3 having count(*) >= 5) group by 1, 2 having count(*) >= 2),
sh as (select lang, word, n, n::double / n_lang::double share from wf join nl using (lang)), ow as (select k.lang, s.word, max(s.share) other from nl k join sh s on s.lang <> k.lang group by 1, 2),
cr as (select artist, word, count(distinct song_id) credited from st where song_id in (select song_id from st where word in ({words_sql(CREDITS)})) group by 1, 2),
nm as (select artist, list_concat(regexp_extract_all(strip_accents(lower('The ' || artist)), {q(TOKEN)}, 1), regexp_extract_all(lower('The ' || artist), {q(TOKEN)}, 1)) names from sl),
us as (select w.artist, l.lang, w.word, uses, spread, songs, round_even(ln((n_lang + 1)::double / (coalesce(n, 0) + 1)::double), 6) idf
  from sw w join sl l using (artist) join nl using (lang) join nm using (artist) left join sh on sh.lang = l.lang and sh.word = w.word left join ow on ow.lang = l.lang and ow.word = w.word left join cr on cr.artist = w.artist and cr.word = w.word
  where length(w.word) >= 3 and not regexp_matches(w.word, '[''’]') and not list_contains(names, w.word) and not list_contains(names, strip_accents(w.word)) and w.word not in ({words_sql(LABELS)})
    and not (spread >= 5 and (uses = spread or coalesce(credited, 0) >= spread * 0.8)) and not ({ADLIB.format(w="w.word")})
    and not (w.word in ({STOP}) or (l.lang = 'en' and w.word in ({words_sql(EN_SPELLINGS)})) or (l.lang not in ('en', 'de', 'fr') and coalesce(share, 0) >= 0.5))
    and not (coalesce(other, 0) > coalesce(share, 0) and coalesce(other, 0) >= 0.02 and coalesce(share, 0) < 0.003))"""
RANKED800 = "rk as (select *, row_number() over (partition by artist order by uses desc, word) r from sw qualify r <= 800)"
TURN_SONGS = r"""ts as (select conv_id * 4 + case role when 'assistant' then 1 when 'system' then 2 else 0 end song_id, 'act ' || conv_id % 10 artist, case when conv_id % 5 = 0 then 'Evening Song (Live)' when conv_id % 7 = 0 then 'Night Mashup' else 'Morning Song' end title,
  string_agg(text, chr(10) order by turn) t from conversations where text is not null group by conv_id, role),
tl as (select song_id, artist, title, unnest(string_split(t || chr(10) || t || chr(10) || t, chr(10))) line, unnest(range(len(string_split(t || chr(10) || t || chr(10) || t, chr(10))))) ln from ts),
tn as (select song_id, artist, title, ln, regexp_replace(regexp_replace(lower(line), '\s+', ' ', 'g'), '^ | $', '', 'g') norm from tl where regexp_matches(line, '\S') and not regexp_matches(line, '^\s*\[[^\]]*\]\s*$'))"""
ARCHIVE = """l as (select l_orderkey song_id, sum(l_quantity)::bigint wc, count(distinct l_partkey) uniq, count(*) n, count(distinct l_returnflag) kinds, count(*) filter (l_linestatus = 'O') drops,
  count(*) filter (l_discount > 0.05) hooked, count(*) filter (l_tax > 0.04) same, max(l_linenumber)::bigint last from lineitem group by 1),
ar as (select song_id, wc, uniq, round_even(uniq::double / wc::double, 4) ttr, 1 - round_even(kinds::double / n::double, 4) rep, round_even(hooked::double / n::double, 4) hook, round_even(same::double / n::double, 4) rhyme, drops,
  round_even(wc * 100 / n::double, 0) / 100 awl, round_even(kinds::double / n::double, 4) q, round_even(last::double / wc::double, 4) one_word, round_even(wc * 600 / (o_custkey % 400 + 1)::double, 0) / 10 wpm,
  song_id % 97 first_s, song_id % 61 gap_s, song_id % 43 fast15, o_custkey % 400 + 1 duration, o_orderstatus = 'O' has_synced from l join orders on o_orderkey = song_id)"""
TIMED_METRICS = ("first_s", "gap_s", "fast15")
ARCHIVE_LONG = ARCHIVE + ", long as (" + " union all ".join(
    f"select song_id, '{m}' metric, {m}::double value from ar where wc between 30 and 2000" + (" and has_synced" if m in TIMED_METRICS else " and duration >= 30 and wpm <= 400" if m == "wpm" else "")
    for m in ("wc", "uniq", "ttr", "rep", "hook", "rhyme", "drops", "awl", "q", "one_word", "wpm", *TIMED_METRICS)
) + ")"
ARCHIVE_CUTS = f"""{ARCHIVE_LONG}, rk as (select metric, value, row_number() over (partition by metric order by value) - 1 i, count(*) over (partition by metric) n from long),
steps as (select unnest(range(101)) p), cuts as (select metric, p, value "cut" from rk, steps where n >= 1000 and round_even(p / 100.0::double * (n - 1), 0) = i)"""
GUESS = ", ".join(f"count(distinct word) filter (word in ({words_sql(ws)})) h{i}" for i, ws in enumerate(STOPWORDS.values()))
BEST = "greatest(" + ", ".join(f"h{i}" for i in range(len(STOPWORDS))) + ")"
PICK = " ".join(f"when h{i} = {BEST} then '{lang}'" for i, lang in enumerate(STOPWORDS))
ORACLES = {
    "word_df": f"with {SPREAD} select word, count(*) df, sum(uses)::bigint uses from aw group by word",
    "exclusive_words": f'with {EXCLUSIVE} select artist, r "rank", word, uses from ex where r <= 50',
    "signature_words": f"""
        with {CANDIDATES}, f as (select word, sum(uses) freq from cand group by 1), t as (select artist, sum(uses) total from aw group by 1), k as (select sum(uses) corpus from aw),
        x as (select artist, word, (uses::double / total::double * 1000) / greatest(freq::double / corpus::double * 1000, 0.0005) x from cand join f using (word) join t using (artist), k where uses >= 5)
        select artist, row_number() over (partition by artist order by round_even(x, 6) desc, word) "rank", word, round_even(x, 1) ratio from x where x >= 2 qualify "rank" <= 150""",
    "language_word_df": f"with {LANG_DF} select lang, word, n, artists, idf, share from ldf",
    "foreign_words": f"with {LANG_DF_OF('song_id', 1, 1)}, b as (select *, max(share) over (partition by word) best from ldf) select lang, word from b where best > share and best >= 0.02 and share < 0.003",
    "function_words": f"with {LANG_DF} select lang, word, word in ({STOP}) or share >= 0.5 is_function from ldf",
    "quantile_cuts": f'with {CUTS} select metric, p, "cut" from cuts',
    "percentile_places": f"with {PLACES} select song_id, metric, pct from pl",
    "interesting_stats": f"""
        with {PLACES}, z as (select *, abs(pct - 50) away from pl where pct <> 0),
        hi as (select *, row_number() over (partition by song_id order by away desc, metric) r from z where pct >= 50 qualify r <= 3),
        lo as (select *, row_number() over (partition by song_id order by away desc, metric) r from z where pct < 50 qualify r = 1),
        u as (select song_id, metric, pct, 'high' side from hi where r <= 2 or song_id not in (select song_id from lo) union all select song_id, metric, pct, 'low' from lo)
        select * from u""",
    "catalogue_standing": f"""
        {LONG_LINES}, o2 as (select artist, song_id, wc, row_number() over (partition by artist order by wc, song_id) i, count(*) over (partition by artist) n from rows_)
        select artist, song_id, rank() over (partition by artist order by wc desc) "rank", n "of", max(wc) filter (i = n // 2 + 1) over (partition by artist) "median", min(wc) over (partition by artist) low, max(wc) over (partition by artist) high from o2""",
    "archive_size": f"with {TOKENS} select count(distinct song_id) songs, count(*) words from tokens",
    "repetition_median": f'with st as ({SONG_SQL["song_stats"]}) select artist, round_even(median(repetition_ratio), 4) median_repetition from st group by artist',
    "non_song_reasons": rf"""
        with {COUNTED}, x as (select s.song_id, lower(s.title) t, coalesce(wc, 0) wc, coalesce(ttr, 0) ttr, regexp_extract_all(lower(s.lyrics), '([a-z]+)', 1) w from songs s left join cs using (song_id)),
        y as (select *, len(list_filter(w, lambda e: e in ({words_sql(ENGLISH)})))::double / greatest(len(w), 1)::double e from x)
        select song_id, case when regexp_matches(t, {q(GUARD)}) then null when wc > 0 and wc < 60 then 'short' when wc > 2000 then 'long' when {holds_sql("t", NOT_SONGS)} then 'title'
          when regexp_matches(t, {q(classify.JUNK)}) and not (({holds_sql("t", JUNK_EXCEPTIONS)}) and not ({holds_sql("t", JUNK_ALL_THE_SAME)})) then 'pattern' when ttr > 0.65 and e > 0.1 then 'variety' end reason from y""",
    "song_language": f"with {TOKENS}, h as (select song_id, {GUESS} from tokens group by 1) select song_id, case when {BEST} <= 4 then 'xx' {PICK} end guess from h",
    "adlib_words": f"with {TOKENS} select distinct word from tokens where {ADLIB.format(w='word')}",
    "word_frequency": f"with {SINGERS} select lang, word, n, n_lang artists, round_even(ln((n_lang + 1)::double / (n + 1)::double), 6) idf, round_even(n::double / n_lang::double, 6) share from wf join nl using (lang)",
    "usable_words": f"with {SINGERS} select artist, lang, word, uses, spread, songs, idf from us",
    "signature_score": f"""
        with {SINGERS}, y as (select *, round_even(spread::double / songs::double * idf * idf * ln(1 + uses), 6) score from us where uses >= 10 and spread >= greatest(3, ceil(songs * 0.06)) and idf >= 1)
        select artist, row_number() over (partition by artist order by score desc, word desc) "rank", word, spread, uses, score from y qualify "rank" <= 12""",
    "staples": f"""
        with {SINGERS}, {RANKED800}, y as (select us.*, r from us join rk using (artist, word) where us.spread >= greatest(2, ceil(songs * 0.03)))
        select artist, row_number() over (partition by artist order by r) "rank", word, uses, spread from y qualify "rank" <= 25""",
    "artist_staple": f"""
        with {SINGERS}, {RANKED800}, y as (select us.*, r from us join rk using (artist, word) where r <= 400 and us.spread >= greatest(3, ceil(songs * 0.1)) qualify row_number() over (partition by artist order by r) = 1)
        select artist, word, spread songs, uses, round_even(spread::double / songs::double, 3) share from y""",
    "hook_quotes": f"""
        with {TURN_SONGS}, c as (select song_id, artist, title, norm, count(*) n, min(ln) f from tn group by 1, 2, 3, 4), top as (select song_id, artist, title, arg_min(norm, (-n, f)) line, max(n) n from c group by 1, 2, 3),
        wc as (select song_id, sum(len(regexp_extract_all(norm, {q(TOKEN)}, 1))) wc from tn group by 1),
        tw as (select artist, unnest(regexp_extract_all(norm, {q(TOKEN)}, 1)) word from tn), w as (select artist, word from tw group by 1, 2 having count(*) >= 6 and length(word) >= 4),
        fit as (select *, len(string_split(line, ' ')) k from top join wc using (song_id) where n >= 3 and wc between 1 and 2000 and title <> 'Night Mashup' and k between 3 and 16 and not starts_with(line, '[')),
        sc as (select *, n * 10 + case when k between 5 and 12 then 40 else 0 end + least(k, 8) - case when contains(title, 'Live') then 10000 else 0 end s, unnest(list_distinct(regexp_extract_all(line, {q(TOKEN)}, 1))) word from fit)
        select artist, word, arg_min(line, (-s, song_id)) line, arg_min(replace(title, ' (Live)', ''), (-s, song_id)) title, arg_min(n, (-s, song_id)) times from sc join w using (artist, word) group by 1, 2""",
    "motif_quotes": f"""
        with {EXCLUSIVE}, {LINE_PARTS}, tw as (select artist, word, row_number() over (partition by artist order by uses desc, word) r from aw qualify r <= 30),
        b as (select artist, r, word, 0 l from ex where r <= 30 union all select artist, r, word, 1 from tw),
        t as (select *, length(word) > 2 and not regexp_matches(word, '[''’]') and word <> artist plain from b), m as (select *, case when plain and word not in ('ooh', 'ah', 'oh', 'uh', 'la', 'da', 'na') then l when plain and l = 1 then 2 when l = 1 then 3 end tier from t),
        mw as (select artist, arg_min(word, (tier, r)) word from m where tier is not null group by 1),
        s as (select artist, song_id, line_no, line, string_split(regexp_replace(line, '\\s+', ' ', 'g'), ' ') ws, unnest(list_distinct(regexp_extract_all(lower(line), {q(TOKEN)}, 1))) word from nlines),
        g as (select s.*, case when starts_with(line, '[') or ends_with(line, ']') or (starts_with(line, '(') and ends_with(line, ')')) then -100 when len(ws) < 4 or len(ws) > 20 then -50 else
          case when len(ws) between 6 and 12 then 20 else 0 end + case when upper(left(line, 1)) = left(line, 1) and lower(left(line, 1)) <> left(line, 1) then 10 else 0 end - case when upper(line) = line and lower(line) <> line then 20 else 0 end
          - case when len(list_distinct(list_transform(ws, lambda x: lower(x)))) < 0.6 * len(ws) then 50 else 0 end end score from s join mw using (artist, word))
        select artist, word, arg_min(song_id, (-score, song_id, line_no)) song_id, arg_min(line, (-score, song_id, line_no)) line, max(score)::bigint score from g group by 1, 2""",
    "curated_motifs": f"""
        with {EXCLUSIVE}, gv as (select artist, word from aw where artist in ('src1', 'src4') and word = 'the'), cm as (select artist, word from ex where r <= 1),
        b as (select artist, coalesce(gv.word, cm.word) word, gv.word is not null curated from cm full join gv using (artist))
        select artist, word, spread, uses, curated from b join aw using (artist, word)""",
    "archive_quantiles": f'with {ARCHIVE_CUTS} select metric, p, "cut" from cuts',
    "archive_places": f"""
        with {ARCHIVE_CUTS}, pl as (select song_id, metric, round_even(least(100.0, greatest(0.0, (count(*) filter ("cut" < value) + count(*) filter ("cut" <= value))::double / 2.0 / 100.0 * 100)), 0)::bigint pct from long join cuts using (metric) group by song_id, metric)
        select song_id, metric, pct, case when pct >= 50 then 'longer than ' || pct else 'shorter than ' || 100 - pct end || '% of songs' phrase from pl""",
    "catalogue_points": f"""
        with {ARCHIVE}, o as (select song_id % 20 artist, wc, row_number() over (partition by song_id % 20 order by wc, song_id) - 1 i, count(*) over (partition by song_id % 20) n from ar), k as (select unnest(range(240)) k)
        select artist, i point, wc value from o where n <= 240 union all select artist, k, wc from o, k where n > 240 and floor(k * (n::double / 240.0::double)) = i""",
    "weak_labels": """select p_partkey, case p_partkey % 6 when 0 then 0.0::double when 1 then 0.0::double when 4 then 1.0::double when 5 then 1.0::double end "label" from part""",
    "filler_words": f"""with {TOKENS}, p as (select distinct word, replace(word, '’', chr(39)) w from tokens), f as (select word, w, length(w) < 3 or w in ({STOP}) or {ADLIB.format(w="w")} filler from p)
        select word, filler, filler and w not in ('that', 'with', 'this') grammar from f""",
    "detected_language": f"""
        with {SONGS}, s as (select song_id, left(array_to_string(string_split(lyrics, chr(10))[1:30], ' '), 1500) t from songs), w as (select song_id, case when length(t) >= 40 then regexp_extract_all(lower(t), {q(TOKEN)}, 1) end w from s),
        h as (select song_id, {", ".join(f"len(list_filter(w, lambda x: x in ({words_sql(ws)}))) h{i}" for i, ws in enumerate(STOPWORDS.values()))} from w)
        select song_id, case when {" + ".join(f"h{i}" for i in range(len(STOPWORDS)))} > 0 and {BEST}::double / ({" + ".join(f"h{i}" for i in range(len(STOPWORDS)))})::double >= 0.6 then case {PICK} end end detected from h""",
    "main_language": f"""
        with {TOKENS}, lt as (select song_id, case song_id % 15 when 0 then 'ja' when 5 then 'el' end forced, word, pos from tokens), c as (select song_id, forced, word, count(*) n, min(pos) f from lt group by 1, 2, 3),
        t as (select * from c qualify row_number() over (partition by song_id order by n desc, f) <= 30), h as (select song_id, forced, count(*) words, {GUESS} from t group by 1, 2)
        select song_id, case when words >= 10 then coalesce(forced, case when {BEST} > 4 then case {PICK} end end) end lang from h""",
    "shared_vocabulary": f"""
        with {TOKENS}, w as (select distinct lang, word from tokens), n as (select word, count(*) langs from w group by 1)
        select lang, count(*) words, count(*) filter (langs = 1) alone, count(*) filter (langs > 1) shared from w join n using (word) group by lang""",
    "rollup_words": f"with {COUNTED} select lang, artist, count(*) songs, sum(wc)::bigint words from counted group by rollup (lang, artist)",
}
FOLD_METRICS = ["song_count", "total_words", "total_unique_words", "words_per_song", "avg_ttr", "top_word_n"]
ORACLES["standing_phrases"] = f"""
    with c as ({ORACLES["catalogue_standing"]}), x as (select artist, song_id, case when "rank" <= "of" / 2 then "rank" else "of" - "rank" + 1 end k, case when "rank" <= "of" / 2 then 'longest' else 'shortest' end w, "of" n from c)
    select artist, song_id, k || case when k % 100 between 11 and 13 then 'th' when k % 10 = 1 then 'st' when k % 10 = 2 then 'nd' when k % 10 = 3 then 'rd' else 'th' end || ' ' || w || ' of ' || n phrase from x"""
ORACLES["artist_percentiles"] = f"""
    with fold as ({ARTIST_SQL["artist_fold"]}), long as (select artist, metric, value from (select artist, {", ".join(f"{m}::double {m}" for m in FOLD_METRICS)} from fold) unpivot (value for metric in ({", ".join(FOLD_METRICS)})))
    select artist, metric, value, round_even(100.0::double * (rank() over (partition by metric order by value) - 1) / count(*) over (partition by metric), 0)::bigint pct from long"""
