"""Corpus passes, percentiles, resolution, classification, lookups and sinks on small tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from strophe.functions import titles
from strophe.operators import artist, classify, corpus, lookup, resolve
from strophe.sources import sinks, tables
from strophe.streaming import windows


def places(spark, cuts, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    return [r[0] for r in df.select(corpus.place_among(F.col("v"), F.array(*(F.lit(float(c)) for c in cuts)))).collect()]


def test_percentiles(spark):
    assert places(spark, [i * 10 for i in range(101)], [500.0, 0.0, 5000.0]) == [50, 0, 100]
    assert places(spark, [0] * 60 + list(range(1, 42)), [0.0, 41.0]) == [30, 100]
    rows = spark.createDataFrame([(i, float(i)) for i in range(1000)], "k long, m double")
    cuts = {r.p: r["cut"] for r in corpus.quantile_cuts(rows, ["m"]).collect()}
    assert len(cuts) == 101 and cuts[0] == 0 and cuts[50] == 500 and cuts[100] == 999


def test_archive(spark):
    schema = "wc long, uniq long, ttr double, rep double, hook double, rhyme double, drops long, awl double, q double, one_word double, wpm double, first_s double, gap_s double, fast15 long, duration double, has_synced boolean"
    one = lambda **k: tuple({"wc": 100, "uniq": 50, "ttr": 0.5, "rep": 0.1, "hook": 0.1, "rhyme": 0.1, "drops": 1, "awl": 4.0, "q": 0.0, "one_word": 0.0, "wpm": 90.0, "first_s": 1.0, "gap_s": 2.0, "fast15": 9, "duration": 60.0, "has_synced": True, **k}.values())
    rows = spark.createDataFrame([one(), one(wc=29), one(wc=2001), one(has_synced=False), one(wpm=401.0), one(duration=29.0)], schema)
    got = corpus.archive_metrics(rows).collect()
    assert [(r.wpm, r.first_s) for r in got] == [(90.0, 1.0), (90.0, None), (None, 1.0), (None, 1.0)]
    assert {r.metric for r in corpus.quantile_cuts(corpus.archive_metrics(rows), list(corpus.SONG_METRICS), 3).collect()} == set(corpus.SONG_METRICS) - {"wpm"}


def test_value_places(spark):
    import random

    rng = random.Random(2)
    values = [rng.choice([0.0, 1e-9, 1.0, rng.random(), 1e12]) for _ in range(800)]
    rows = spark.createDataFrame([("m", v) for v in values] + [("k", 5.0)] * 3, "metric string, value double")
    got = {(r.metric, r.value): (r.c, r.below, r.n) for r in corpus.value_places(rows, 16).collect()}
    assert got == {("k", 5.0): (3, 0, 3), **{("m", v): (values.count(v), sum(x < v for x in values), 800) for v in values}}


def test_phrases(spark):
    df = spark.createDataFrame([(3, 385, 78), (374, 385, 39), (1, 1, 50)], "r long, n long, p long")
    got = df.select(corpus.standing_phrase(F.col("r"), F.col("n")), corpus.percentile_phrase(F.col("p"))).collect()
    assert [tuple(r) for r in got] == [("3rd longest of 385", "longer than 78% of songs"), ("12th shortest of 385", "shorter than 61% of songs"), ("1st shortest of 1", "longer than 50% of songs")]
    points = spark.createDataFrame([("a", i, i) for i in range(1000)], "artist string, song_id long, wc long")
    got = [r.value for r in corpus.catalogue_points(points, "wc").orderBy("point").collect()]
    assert got == [int(i * 1000 / 240) for i in range(240)]


def test_standing(spark):
    rows = spark.createDataFrame([("a", 1, 300), ("a", 2, 400), ("a", 3, 100)], "artist string, song_id long, wc long")
    got = {r.song_id: (r["rank"], r["of"], r["median"], r.low, r.high) for r in corpus.catalogue_standing(rows, "wc").collect()}
    assert got[3] == (3, 3, 300, 100, 400) and got[2][0] == 1


def test_exclusive(spark):
    words = [("a", "river", 12, 8), ("a", "the", 90, 9), ("b", "the", 90, 9), ("a", "stone", 4, 2), ("b", "stone", 40, 9)]
    df = spark.createDataFrame(words, "artist string, word string, uses long, spread long")
    assert [(r.artist, r.word) for r in corpus.exclusive_words(df, ("the",)).collect()] == [("a", "river")]


def test_signatures(spark):
    """A vocable, a label, a name, a footer, grammar and a foreign word are set aside; one recurring word is left."""
    spread = {"river": (40, 30), "la": (90, 40), "chorus": (60, 40), "moss": (50, 30), "tape": (12, 12), "the": (300, 60), "cos": (40, 30), "muro": (30, 20), "booking": (40, 30), "stone": (400, 50), "oh": (80, 40)}
    words = [("a", w, u, s) for w, (u, s) in spread.items()] + [(f"b{i}", "stone", 20, 9) for i in range(500)] + [(f"c{i}", "muro", 20, 9) for i in range(9)]
    df = spark.createDataFrame(words, "artist string, word string, uses long, spread long")
    people = [("a", "The Moss", "en", 60)] + [(f"b{i}", f"b{i}", "en", 20) for i in range(500)] + [(f"c{i}", f"c{i}", "it", 20) for i in range(9)]
    artists = spark.createDataFrame(people, "artist string, display string, lang string, songs long")
    frequency = spark.createDataFrame([("en", "stone", 501), ("it", "muro", 9), ("en", "river", 1)], "lang string, word string, n long")
    credits = spark.createDataFrame([("a", "booking", 25)], "artist string, word string, credited long")
    usable = corpus.usable_words(df, artists, frequency, credits, ("the",), ("en", "it"))
    assert {r.word for r in usable.where("artist = 'a'").collect()} == {"river", "stone"}
    assert [(r.word, r.score > 0) for r in corpus.signature_score(usable).where("artist = 'a'").collect()] == [("river", True)]
    assert [(r.word, r.share) for r in corpus.staple(df, usable).where("artist = 'a'").collect()] == [("stone", 0.833)]


def test_lists_of_titles():
    """Parts that mark pages of other kinds, as the catalogue has them."""
    from strophe.functions.words import ALL_STOPWORDS, NOT_SONGS

    assert NOT_SONGS[:19] == ("interview", "discography", "tracklist", "tracklisting", "booklet", "conference call", "setlist", "annotated", "tour dates", "album art", "cover art", "liner notes", "press release", "(album)", "full album", "q&a", "biography", "snippet", "teaser")
    assert len(NOT_SONGS) == 49 and {"yeah", "k'o", "njihov"} <= set(ALL_STOPWORDS)


def test_non_songs(spark):
    rows = [("Tour Dates 2011", 300, "title"), ("Discography", 300, "title"), ("Evening Interlude", 20, None), ("Short", 20, "short"), ("Long", 2001, "long"), ("River Q&A", 300, "title"), ("Long Live (live)", 300, None), ("River (live)", 300, "pattern"), ("River", 300, None)]
    df = spark.createDataFrame([(*r, ["x"]) for r in rows], "t string, wc long, want string, w array<string>")
    got = df.select("t", "want", classify.non_song_reason(F.col("t"), F.col("wc"), F.lit(0.4), F.col("w")).alias("got")).collect()
    assert [(r.t, r.got) for r in got] == [(r.t, r.want) for r in got]


def test_quotes_and_motifs(spark):
    schema = "artist string, song_id long, title string, top_line string, top_line_n long"
    lines = spark.createDataFrame([("moss", 1, "River (Live)", "down the river we go again", 9), ("moss", 2, "River", "the river is wide", 3), ("moss", 3, "River (x vs. y)", "river river river again now", 9), ("moss", 4, "River (Moss Remix)", "river under the moon tonight", 9), ("moss", 5, "R", "river", 9)], schema)
    words = spark.createDataFrame([("moss", "river")], "artist string, word string")
    assert [(r.line, r.title, r.times) for r in corpus.hook_quotes(lines, words).collect()] == [("the river is wide", "River", 3)]
    own = spark.createDataFrame([("moss", 1, "moss"), ("moss", 2, "ooh"), ("moss", 3, "river")], "artist string, rank long, word string")
    people = spark.createDataFrame([("moss", "Moss"), ("reed", "Reed")], "artist string, display string")
    top = spark.createDataFrame([("reed", 1, "ah"), ("reed", 2, "ooh")], "artist string, rank long, word string")
    motifs = corpus.motif_word(own, top, people, ("ooh",))
    assert sorted((r.artist, r.word) for r in motifs.collect()) == [("moss", "river"), ("reed", "ooh")]
    sung = spark.createDataFrame([("moss", 1, 0, "river river river river"), ("moss", 1, 1, "Take me down to the river"), ("moss", 2, 0, "[river]")], "artist string, song_id long, line_no long, line string")
    assert [(r.line, r.score) for r in corpus.motif_quotes(sung, motifs).collect()] == [("Take me down to the river", 30)]
    counted = spark.createDataFrame([("moss", "river", 9, 5), ("moss", "stone", 3, 1), ("reed", "ooh", 2, 1)], "artist string, word string, uses long, spread long")
    reviews = spark.createDataFrame([("moss", "stone"), ("reed", "never sung")], "artist string, word string")
    assert sorted((r.artist, r.word, r.curated) for r in corpus.curated_motifs(motifs, reviews, counted).collect()) == [("moss", "stone", True), ("reed", "ooh", False)]


def test_highlights(spark):
    schema = "song_id long, artist string, title string, lang string, wc long, uniq long, ttr double"
    rows = [(1, "a", "x", "en", 100, 50, 0.5), (2, "a", "x (Demo)", "en", 900, 50, 0.9), (3, "a", "y", "en", 200, 50, 0.4), (4, "a", "z", "en", 10, 10, 1.0), (5, "b", "demo", "en", 5, 5, 1.0), (6, "b", "demo", "en", 5, 5, 1.0)]
    got = {r.artist: (r.longest_song, r.longest_words, r.shortest_song, r.richest_song) for r in artist.highlights(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"a": (3, 200, 1, 1), "b": (5, 5, 5, 5)}


def test_merge(spark):
    schema = "artist string, title_key string, song_id long, wc long, ttr double, chorus double, has_sections boolean"
    d = spark.createDataFrame([("a", "x", 1, 10, 0.5, 0.1, False), ("a", "y", 2, 20, 0.5, 0.3, True)], schema)
    v = spark.createDataFrame([("a", "y", 3, 30, 0.7, 0.5, True), ("a", "z", 4, 40, 0.9, None, True)], schema)
    merged = artist.merge_catalogues(d, v)
    assert {(r.title_key, r.song_id, r.source) for r in merged.collect()} == {("x", 1, "dataset"), ("y", 3, "live"), ("z", 4, "live")}
    s = artist.merged_summary(merged).first()
    assert (s.songs, s.live_songs, s.total_words, s.avg_ttr, s.avg_chorus) == (3, 2, 80, 0.7, 0.5)
    years = spark.createDataFrame([("y", 1999, 1), ("y", 2001, 2), ("q", None, 3)], "key string, year int, ord long")
    assert {r.key: r.year for r in artist.backfill_years(spark.createDataFrame([("y",), ("q",)], "key string"), years).collect()} == {"y": 2001, "q": None}


def test_groups_and_reasons(spark):
    rows = spark.createDataFrame([(1, "a", "river", "f1"), (2, "a", "river live", "f1"), (3, "a", "river", "f2"), (4, "a", "moss", None), (5, "b", "river", "f1"), (6, "a", "xx", "f3"), (7, "a", "xx", "f4")], "song_id long, artist string, key string, fp string")
    got = {r.song_id: r.group_id for r in resolve.song_groups(rows).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 7}
    cases = spark.createDataFrame([("Big Medley", "moss", 300, 1, None, None), ("song", "moss", 300, 1, "b", 60), ("cover", "moss", 300, 30, "b", 45), ("Skit one", "moss", 50, 9, None, None), ("x (Moss remix)", "moss", 300, 9, None, None), ("Outro", "moss", 99, 9, None, None), ("Liner Notes", "moss", 300, 1, None, None)], "t string, a string, w long, u long, o string, c long")
    reasons = [r[0] for r in cases.select(resolve.set_aside_reason(*map(F.col, "tawuoc"))).collect()]
    assert reasons == ["medley or megamix", "belongs to another artist", None, "skit or interlude", "their remix of another artist's song", "skit or interlude", "not a song"]
    assert [r[0] for r in cases.select(resolve.flags(F.col("u"), F.col("c"))).collect()][1] == "more uploads elsewhere"


def test_reviews_and_aliases(spark):
    songs = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z"), ("b", "q"), ("b", "q")], "artist string, title string")
    reviews = spark.createDataFrame([("a", "drop", "x", None), ("a", "rename", "y", "Y!"), ("b", "only", "z", None)], "artist string, action string, title string, value string")
    assert sorted(map(tuple, resolve.apply_reviews(songs, reviews).collect())) == [("a", "Y!"), ("b", "z")]
    asked = spark.createDataFrame([("b", "q"), ("b", "none"), ("a", "x")], "artist string, title string")
    assert {(r.title, r.matches) for r in resolve.review_misses(songs, asked).collect()} == {("q", 2), ("none", 0)}
    stubs = spark.createDataFrame([("beyonc", 52), ("Beyoncé", 2067), ("emin", 60), ("eminem", 9000), ("silen", 60), ("silenç", 52), ("z", 5), ("zé", 500)], "name string, songs long")
    assert [(r.name, r.longer) for r in resolve.truncation_stubs(stubs).collect()] == [("beyonc", "Beyoncé")]
    chain = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x")], "alias string, canonical string")
    got = {r.alias: r.canonical for r in resolve.close_aliases(chain).collect()}
    assert got["a"] == "c" and got["b"] == "c" and set(got) == {"a", "b", "x", "y"}


def test_titles(spark):
    df = spark.createDataFrame([("01. River Song (Live)", "Moss"), ("Moss - River Song - 2009 Remaster", "Moss"), ("(Intro)", "Moss"), ("River Song demo mix", "x")], "t string, a string")
    assert [r[0] for r in df.select(titles.canonical_title(F.col("t"), F.col("a"))).collect()] == ["01 river song", "river song", "intro", "river song"]
    assert [r[0] for r in df.select(titles.title_key(F.col("t"), F.col("a"))).collect()] == ["river song", "river song", "intro", "river song"]
    assert [r[0] for r in df.select(titles.display_title(F.col("t"), F.col("a"))).collect()][:2] == ["River Song", "River Song"]
    rows = spark.createDataFrame([("a", 1, "River", 100, None), ("a", 2, "river!", 105, 1999), ("a", 3, "Rivver", 98, None), ("a", 4, "Stone", 100, None), ("a", 5, "River", 400, None)], "artist string, song_id long, title string, wc long, year int")
    assert {r.song_id: r.keep_id for r in resolve.similar_title_groups(rows).collect()} == {1: 2, 2: 2, 3: 2, 4: 4, 5: 5}


def test_classifier(spark):
    rows = [(f"interview with {i}",) for i in range(40)] + [(f"river song {i}",) for i in range(40)] + [("interview freestyle",)]
    df = spark.createDataFrame(rows, "title string").withColumn("label", classify.weak_label(F.col("title")))
    got = classify.junk_titles(df, classify.train_titles(df), 0.5)
    wrong = classify.confusion(got, "label", "is_junk").where((F.col("label") == 0) != F.col("is_junk"))
    assert wrong.count() == 0 and not got.where("title = 'interview freestyle'").first().is_junk
    names = spark.createDataFrame([("",), ("nan",), ("Spotify Sessions",), ("Moss",)], "n string")
    assert [r[0] for r in names.select(classify.junk_artist(F.col("n"))).collect()] == [True, True, True, False]


def test_lookups(spark):
    names = spark.createDataFrame([("riverband", "River Band", 50), ("riverband", "river band", 9), ("rivers", "Rivers", 70), ("oldriver", "Old River", 99), ("stoneandmoss", "Stone and Moss", 5)], "key string, display string, n long")
    asked = spark.createDataFrame([("river",), ("r",)], "prefix string")
    assert [(r.place, r.display) for r in lookup.typeahead(names, asked).orderBy("place").collect()] == [(1, "Rivers"), (2, "River Band"), (3, "Old River")]
    typo = spark.createDataFrame([("rivres", "rivres"), ("zz", "zz")], "name string, key string")
    assert [(r.name, r.display) for r in lookup.did_you_mean(names, typo).collect()] == [("rivres", "Rivers")]
    req = spark.createDataFrame([("q", "Stone & Moss"), ("none", "x")], "request_id string, name string")
    assert [(r.request_id, r.tier, r.display) for r in lookup.tiered_lookup(names, req).collect()] == [("q", 1, "Stone and Moss")]
    songs = spark.createDataFrame([(1, "A", "100% x"), (2, "a", "100y x")], "song_id long, artist string, title string")
    hit = spark.createDataFrame([(9, "a ", "100% X")], "request_id long, artist string, title string")
    assert [r.song_id for r in lookup.exact_songs(songs, hit).collect()] == [1]


def test_sinks(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", None), (2, "b", 5)], "k long, s string, n long")
    new = spark.createDataFrame([(2, None, 7), (3, "c", None)], "k long, s string, n long")
    assert sorted(sinks.upsert(old, new, ["k"]).collect()) == [(1, "a", None), (2, "b", 7), (3, "c", None)]
    assert sorted(sinks.upsert(old, new, ["k"], ("n",)).where("k = 2").collect()) == [(2, "b", None)]
    maps = spark.createDataFrame([(1, {"a": "1", "b": "2"}), (2, {"c": "3"})], "k long, m map<string,string>")
    patch = spark.createDataFrame([(1, {"b": "9", "z": "8"})], "k long, m map<string,string>")
    assert {r.k: r.m for r in sinks.patch_maps(maps, patch, "k", "m").collect()} == {1: {"a": "1", "b": "9", "z": "8"}, 2: {"c": "3"}}
    gone = spark.createDataFrame([(1, 2), (2, 77)], "k long, c long")
    assert [r.k for r in sinks.remove_listed(old, gone, "k", "c").collect()] == [2]
    assert sinks.restore_missing(old, new, old, "k").select("k").collect() == [(1,)]
    sinks.replace_all(old.union(old), str(tmp_path / "t"), "k")
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    sinks.write_json_lines(old, str(tmp_path / "j"))
    assert sorted(tables.read_json_lines(spark, str(tmp_path / "j"), "k long, s string, n long").collect()) == sorted(old.collect())
    (tmp_path / "a.tsv").write_text("# note\nx\ty\n")
    assert tables.read_tsv(spark, str(tmp_path / "a.tsv"), ["p", "q"]).collect() == [("x", "y")]
    (tmp_path / "b.csv").write_text('id,name\n1,"two\nlines"\nbad,x\n')
    assert tables.read_csv(spark, str(tmp_path / "b.csv"), "id long, name string").collect() == [(1, "two\nlines")]
    assert tables.describe_tables({"t": old}).where("rows = 2").count() == 3


def test_stream(spark, sf, tmp_path):
    batch = spark.read.parquet(f"{sf}/events.parquet")
    batch.coalesce(1).sortWithinPartitions("ts").write.parquet(str(tmp_path / "in"))
    stream = windows.read_event_stream(spark, str(tmp_path / "in"), batch.schema)
    for name, f in (("tumbling", windows.stream_tumbling(stream, "1 minute")), ("sessions", windows.stream_sessions(stream, "1 minute"))):
        q = windows.append_to(f, str(tmp_path / name), str(tmp_path / f"cp-{name}"))
        q.awaitTermination(120)
        assert q.exception() is None
    # what the watermark has passed is final and equals the batch; nothing else is written yet
    batch = batch.withColumn("ts", F.col("ts").cast("timestamp"))
    for name, whole, keys in (("tumbling", windows.tumbling_counts(batch), ("window_start", "event_type", "n")), ("sessions", windows.sessions(batch), ("user_id", "session_start", "session_end", "n"))):
        final = {tuple(r) for r in spark.read.parquet(str(tmp_path / name)).select(*keys).collect()}
        assert final and final <= {tuple(r) for r in whole.select(*keys).collect()}
