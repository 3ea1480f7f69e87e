"""Editorial operators on small tables."""

from __future__ import annotations

from strophe.operators import editorial


def test_catalogues(spark):
    rows = [("Moss", i, f"song {i}", 100 + i, 0.5, None) for i in range(5)] + [("moss", 9, "Song 1 (Live)", 300, 0.4, None), ("Moss", 10, "an interview", 5000, 0.1, "long"), ("Few", 11, "x", 90, 0.2, None)]
    got = editorial.build_catalogues(spark.createDataFrame(rows, "artist string, song_id long, title string, wc long, ttr double, reason string")).collect()
    assert [(r.artist, r.song_count, r.total_words, r.longest_song, r.avg_ttr, r.shortest_song) for r in got] == [("Moss", 5, 100 + 102 + 103 + 104 + 300, 9, 0.48, 0)]


def test_words_and_quotes(spark):
    words = spark.createDataFrame([("river",), ("अरम",)], "word string")
    lines = spark.createDataFrame([("अरमान है",), ("अरमान",), ("river",)], "line string")
    assert {r.word: r.whole for r in editorial.whole_words(words, lines).collect()} == {"river": "river", "अरम": "अरमान"}
    quotes = spark.createDataFrame([("a", "river", "down the River"), ("a", "moss", "no such word")], "artist string, word string, line string")
    known = spark.createDataFrame([("a", "river")], "artist string, word string")
    assert {(r.word, r.counted, r.quoted) for r in editorial.quote_evidence(quotes, known).collect()} == {("river", True, True), ("moss", False, False)}
    ranked = spark.createDataFrame([("a", 1, "don't", 9), ("a", 2, "river", 5)], "artist string, rank long, word string, uses long")
    assert editorial.recurring_word(ranked).collect() == [("a", "river", 5)]


def test_fragments(spark):
    prints = spark.createDataFrame([("a", f"f{i}") for i in range(4)] + [("a & bee", "f1"), ("bee", "f2"), ("bee", "q")], "artist string, fp string")
    pages = spark.createDataFrame([("a", 30), ("a & bee", 30), ("bee", 3)], "artist string, songs long")
    assert [(r.part, r.whole, r.overlap) for r in editorial.fragments(prints, pages).collect()] == [("a", "a & bee", 0.5)]
    twins = spark.createDataFrame([("x", f"f{i}") for i in range(4)] + [("y", f"f{i}") for i in range(3)] + [("z", "f0")], "artist string, fp string")
    assert [(r.artist, r.twin, r.overlap) for r in editorial.twins(twins, twins.where("artist = 'x'")).collect()] == [("x", "y", 0.75)]


def test_sheets_and_samples(spark):
    artists = spark.createDataFrame([("moss", 30, 5), ("reed", 30, 9), ("c", 2, 1), ("Various Artists", 99, 99), ("a", 99, 99)], "artist string, songs long, uploads long")
    must = spark.createDataFrame([("c",)], "artist string")
    assert [r.artist for r in editorial.review_sheet(artists, must).orderBy("place").collect()] == ["c", "reed", "moss"]
    rows = spark.createDataFrame([("a", i, i % 7) for i in range(40)], "artist string, song_id long, wc long")
    r = editorial.sampled_payload(rows, 10).first()
    assert (r.songs, len(r.sampled), r.limited) == (34, 10, False)
    places = spark.createDataFrame([(1, "ttr", 75), (1, "wc", 68), (2, "wc", 99), (3, "wc", 64)], "song_id long, metric string, pct long")
    assert {(r.song_id, r.metric) for r in editorial.lead_figure(places, "song_id", {"ttr": 30}).collect()} == {(1, "wc"), (2, "wc")}
    fresh = spark.createDataFrame([(1, 10, None)], "song_id long, wc long, first_s double")
    stored = spark.createDataFrame([(1, 9, 1.5)], "song_id long, wc long, first_s double")
    assert editorial.refresh_readings(stored, fresh, ["first_s"]).collect() == [(1, 10, 1.5)]
    mine = spark.createDataFrame([("River (Live)",), ("Stone",)], "title string")
    assert editorial.catalogue_diff(mine, spark.createDataFrame([("river",)], "title string")).collect() == [("Stone",)]
    junk = spark.createDataFrame([(1, "a", "x (live)"), (2, "a", "song")], "song_id long, artist string, title string")
    assert editorial.suspects(junk).select("artist", "n", "titles").collect() == [("a", 1, "x (live)")]
    assert {tuple(r) for r in editorial.audit_layers(spark.createDataFrame([("short",), (None,)], "reason string")).collect()} == {("short", 1), ("kept", 1)}
    clocks = spark.createDataFrame([(1, 1.0, 9.0, 5), (2, 2.0, 9.0, 7)], "song_id long, first_s double, gap_s double, fast long")
    people = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3)], "artist string, song_id long")
    assert editorial.clock_fold(clocks, people).collect() == [("a", 0.6667, 1.5, 9.0, 1, 7, 2)]
