"""Song statistics, readings, clocks and sections on small texts."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from strophe.functions import text, unicode
from strophe.operators import clock, resolve, song

SCHEMA = "song_id long, artist string, lang string, lyrics string, title string"


def one(spark, lyrics, title="t"):
    return spark.createDataFrame([(1, "a", "en", lyrics, title)], SCHEMA)


def test_reading(spark):
    lines = "river take me home\nriver take me home\nriver take me home\nare you there?\nnow we go"
    r = song.song_reading(one(spark, lines, "river")).first()
    assert (r.wc, r.uniq, r.once, r.hook, r.rep, r.q, r.top_line, r.top_line_n) == (18, 10, 6, 0.6, 0.4, 0.2, "river take me home", 3)
    assert song.title_drops(one(spark, lines, "river")).first().drops == 3
    assert song.drop_lines(one(spark, lines, "river")).first()["at"] == [0, 1, 2]
    assert clock.words_per_minute(spark.createDataFrame([(18, 120.0), (18, 10.0)], "wc long, duration double")).select("wpm").collect() == [(9.0,), (None,)]


@pytest.mark.parametrize("lyrics", ["", "  \n ", "[Verse]\n[Chorus]", "😀 123", None])
def test_empty_texts(spark, lyrics):
    r = song.song_stats(one(spark, lyrics)).first()
    assert (r.word_count, r.unique_words, r.ttr, r.line_count, r.hapax_count, r.repetition_ratio) == (0, 0, 0.0, 0, 0, 0.0)
    assert song.song_reading(one(spark, lyrics)).count() == 0


def test_tokens(spark):
    words = song.with_arrays(one(spark, "Don’t stop, can't wait 42 times ½ à-la")).select("w").first().w
    assert words == ["don’t", "stop", "can't", "wait", "times", "½", "à", "la"]
    r = song.song_stats(one(spark, "la la la la la")).first()
    assert (r.ttr, r.hapax_count, r.avg_words_per_line) == (0.2, 0, 5.0)
    assert song.song_stats(one(spark, "w " * 5000)).first().longest_line_words == 5000
    assert song.song_reading(one(spark, "w " * 2001)).count() == 0


def test_top_words_ties(spark):
    tokens = text.token_table(one(spark, "b a b a c the the the"))
    assert [(r.word, r.uses) for r in song.top_words(tokens, 3).orderBy("rank").collect()] == [("the", 3), ("b", 2), ("a", 2)]
    assert [r.word for r in song.top_words(tokens, 20, ("the",), 2).collect()] == ["b"]
    assert song.longest_words(one(spark, "bb aa ccc a"), 3).first().words == ["ccc", "aa", "bb"]


def test_sections(spark):
    sheet = "[Verse 1]\na\nb\nc\n[Chorus]\nd\ne\n[Verse 2]\nf\ng\n[Chorus]\nd\ne\n[Empty]\n[Tekst]\ngone"
    s = text.section_table(one(spark, sheet))
    assert [(r.kind, r.n_lines) for r in s.orderBy("section_no").collect()] == [("verse", 3), ("chorus", 2), ("verse", 2), ("chorus", 2)]
    r = song.section_summary(s).first()
    assert (r.n_sections, r.kinds, r.has_sections, r.chorus_ratio) == (4, "verse,chorus,verse,chorus", True, 0.4444)
    kinds = spark.createDataFrame([("Almost",), ("Pre-Chorus",), ("?",)], "n string").select(text.section_kind(F.col("n"))).collect()
    assert [k[0] for k in kinds] == ["bridge", "chorus", "other"]


def test_two_decimals_and_marks(spark):
    r = song.song_stats(one(spark, "[Verse]\naa bb\nccc\n[Empty]\n[Chorus]\nd e f")).first()
    assert (r.avg_word_length, r.avg_words_per_line, r.section_count) == (1.67, 2.0, 2)
    r = song.song_reading(one(spark, "one two\nla la la\nla la la\nLA  la la")).first()
    assert (r.top_line_at, r.line_words, r.awl, r.rhyme) == ([1, 2, 3], [2, 3, 3, 3], 2.18, 0.6667)
    long_title = one(spark, "a b c d e f g\nz", "a b c d e f g")
    assert song.drop_lines(long_title).count() == 0 and song.title_drops(long_title).first().drops == 0


def test_accents_fold(spark):
    df = spark.createDataFrame([("Beyoncé",), ("BEYONCE\u0301",), ("Straße Ñ Ø",)], "n string")
    got = df.select(text.name_key(F.col("n")), text.slug(F.col("n")), text.name_tokens(F.col("n"))).collect()
    assert [r[0] for r in got] == ["beyonce", "beyonce", "straßenø"] and got[0][2] == ["beyonce", "beyoncé"]
    both = df.select(text.name_key(F.col("n")).alias("a"), unicode.name_key("n").alias("b")).collect()
    assert all(r.a == r.b for r in both)


def test_clean_raw(spark):
    raw = "12 Contributors\r\nSome Song Lyrics\nfirst line\nYou might also like that\nsecond line12Embed"
    assert one(spark, raw).select(text.clean_raw(F.col("lyrics"))).first()[0] == "first line\nsecond line"


def test_clock(spark):
    timed = spark.createDataFrame([(1, 10.0, 3), (1, 12.0, 2), (1, 20.0, 1), (1, 50.0, 4), (2, 1.0, 1)], "song_id long, at double, words long")
    r = clock.clock_summary(timed).collect()
    assert [(x.song_id, x.first_s, x.last_s, x.gap_s, x.gap_at, x.fast) for x in r] == [(1, 10.0, 50.0, 30.0, 20.0, 6)]
    durations = spark.createDataFrame([(1, 60.0)], "song_id long, duration double")
    assert clock.decile_curve(timed, durations).where("song_id = 1").first().curve == [0, 3, 2, 1, 0, 0, 0, 0, 4, 0]
    lrc = spark.createDataFrame([(1, "[00:10.5][1:02] two stamps\nno stamp\n[0:03:250]x")], "song_id long, synced string")
    assert [(e["at"], e.line) for e in clock.lrc_events(lrc).orderBy("line_no", "stamp_no").collect()] == [(10.5, "two stamps"), (62.0, "two stamps"), (3.25, "x")]


def test_alignment(spark):
    lines = ["walking down the river", "all the stones are cold", "hold on", "to the morning light"]
    lyrics = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)] + [(2, 0, "nothing like it")], "song_id long, line_no long, line string")
    timed = spark.createDataFrame([(1, 1.0, "Walking down the River!"), (1, 2.0, "all the stones"), (1, 3.0, "are cold"), (1, 4.0, "hold on to the morning lights"), (2, 1.0, "different words")], "song_id long, at double, line string")
    got = resolve.align_lines(lyrics, timed).orderBy("line_no").collect()
    assert [(r.line_no, r["at"]) for r in got][:2] == [(0, 1.0), (1, 2.0)] and {r.song_id for r in got} == {1}


def test_unicode_keys(spark):
    df = spark.createDataFrame([("Čćž — ﬁnale ½",), (None,)], "n string")
    got = df.select(unicode.name_key("n").alias("k"), unicode.name_slug("n").alias("s"), unicode.unbracketed("n").alias("b"), unicode.line_ending("n").alias("e")).collect()
    assert (got[0].k, got[0].s, got[0].e) == ("cczfinale12", "ccz-finale-1-2", "ale") and got[1].k is None
    assert unicode.without_brackets("a (b [c] d) e (f") == "a e"
    assert unicode.plain_title("x_y  z") == "x y z" and unicode.squash("Ünï—x") == "uni x"


def test_rhymes(spark):
    lines = text.line_table(one(spark, "the night\nso bright\nno\nway"))
    r = song.rhyme_pairs(lines).first()
    assert (r.pairs, r.rhymes, r.rhyme) == (1, 1, 1.0)
