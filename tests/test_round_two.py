"""Payloads, cleaning, alignment, the fold, sources and sinks on small tables."""

from __future__ import annotations

from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from strophe.operators import artist, classify, clock, editorial, fold, lookup, payload, resolve
from strophe.sources import sinks, tables


def aligned(spark, lines, events):
    lyrics = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "song_id long, line_no long, line string")
    timed = spark.createDataFrame([(1, float(a), x) for a, x in events], "song_id long, at double, line string")
    got = resolve.align_lines(lyrics, timed).orderBy("line_no").collect()
    return [r["at"] for r in got] if got else None


@pytest.mark.parametrize(
    ("lines", "events", "want"),
    [
        # spelt otherwise, split in two, nearly alike
        (["walking down the river", "all the stones are cold", "hold on", "to the morning light"], [(1.04, "Walking down the River!"), (2, "all the stones"), (3, "are cold"), (4, "hold on to the morning light")], [1.0, 2.0, None, 4.0]),
        (["lurkin' in the alley", "to the morning light and more"], [(1, "lurking in the alley"), (2.25, "to the morning light, and more")], [1.0, 2.2]),
        (["to the morning light", "we go again"], [(4, "and to the morning light we go again"), (9, "bye")], [4.0, None]),
        # a rule looks at the whole window before the next one is tried
        (["hold the long line", "x"], [(1, "hold the long line and more"), (2, "hold the long line"), (3, "x")], [2.0, 3.0]),
        (["one", "two"], [(1, "three"), (2, "four")], None),
        (["one", "two"], [], None),
    ],
)
def test_alignment_rules(spark, lines, events, want):
    assert aligned(spark, lines, events) == want


def test_aliases_and_fragments(spark):
    assert resolve.is_fragment("garfunkel", "Simon & Garfunkel") and not resolve.is_fragment("simonandgarfunkel", "Simon & Garfunkel")
    assert resolve.is_fragment("nash", "Crosby Stills Nash") and not resolve.is_fragment("beatles", "The Beatles") and not resolve.is_fragment("ye", "Ye")
    assert resolve.is_fragment("lakeandpalmeremerson", "Emerson, Lake and Palmer") and resolve.is_fragment("presleyelvis", "Elvis Presley")
    assert not resolve.spelled_by("aa", ["a"], False) and resolve.spelled_by("thebandand", ["band"], True)
    prints = spark.createDataFrame([(a, f"f{i}") for a in ("The Moss", "Moss, The") for i in range(6)] + [("moss", f"g{i}") for i in range(9)], "artist string, fp string")
    pages = spark.createDataFrame([("The Moss",)], "artist string")
    assert [(r.alias, r.canonical, r.overlap) for r in resolve.alias_overlap(prints, pages).collect()] == [("Moss, The", "The Moss", 1.0)]


def test_reviews_with_twins(spark):
    songs = spark.createDataFrame([("a", "River"), ("a", "River (Live)"), ("a", "Moss"), ("a", "Stone"), ("b", "x"), ("b", "y")], "artist string, title string")
    reviews = spark.createDataFrame([("a", "drop", "River (Live)", None), ("a", "drop", "Moss", None), ("a", "keep", "Moss", None), ("a", "rename", "stone", "Cold Stone"), ("b", "only", "X", None)], "artist string, action string, title string, value string")
    assert sorted(map(tuple, resolve.apply_reviews(songs, reviews).collect())) == [("a", "Cold Stone"), ("a", "River"), ("b", "x")]


def test_medley_guard(spark):
    texts = {1: "river " * 30, 2: "stone " * 30, 3: "river " * 30 + "stone " * 30, 4: "moss " * 60, 5: "moss " * 60 + "fern " * 8, 6: "fern " * 30, 7: "fern " * 30 + "leaf " * 90 + "dew " * 30, 8: "leaf " * 90}
    keys = {1: "river", 2: "stone", 3: "river and stone", 4: "moss", 5: "moss", 6: "fern", 7: "fern", 8: "leaf"}
    words = spark.createDataFrame([("a", i, w, t.split().count(w)) for i, t in texts.items() for w in set(t.split())], "artist string, song_id long, word string, uses long")
    pairs = spark.createDataFrame([("a", 1, 3), ("a", 2, 3), ("a", 4, 5), ("a", 6, 7), ("a", 8, 7)], "artist string, part long, whole long").withColumn("shared", F.lit(1.0))
    named = spark.createDataFrame(list(keys.items()), "song_id long, key string")
    found, links = resolve.medleys(pairs, words, named)
    # 3 holds two unlike texts; 5 extends 4; 7 holds two unlike ones, of which 8 is most
    assert [r.whole for r in found.collect()] == [3]
    assert {(r.u, r.v) for r in links.collect()} == {(5, 4), (7, 8)}


def plain_groups(rows):
    def near(a, b):
        if a == b or a.startswith(b) or b.startswith(a) or a.endswith(b) or b.endswith(a):
            return True
        limit = max(1, int(0.2 * max(len(a), len(b))))
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            d = [i, *d[1:]] if False else [(n := [i]), [n.append(min(d[j] + 1, n[j - 1] + 1, d[j - 1] + (x != b[j - 1]))) for j in range(1, len(b) + 1)]][0]
        return d[-1] <= limit

    groups = []
    for i, t, wc, year in rows:
        for g in groups:
            j, u, w, _ = g[0]
            if (not w or not wc or abs(w - wc) / max(w, 1) <= 0.18) and near(t, u):
                g.append((i, t, wc, year))
                break
        else:
            groups.append([(i, t, wc, year)])
    return {r[0]: min(g, key=lambda r: (r[3] is None, len(r[1]), -r[2], r[0]))[0] for g in groups for r in g}


def test_similar_titles_as_the_greedy_rule_has_them(spark):
    import random

    rng = random.Random(3)
    base = ["river song", "the long road home", "stone", "moss and fern", "a", "evening bells"]
    rows = []
    for i in range(120):
        t = rng.choice(base)
        if rng.random() < 0.6:
            k = rng.randrange(len(t) + 1)
            t = t[:k] + rng.choice(["x", "", "yz", " live"]) + t[k:]
        rows.append((i, " ".join(t.split()), rng.choice([0, 100, 110, 130, 400]), rng.choice([None, 1999])))
    df = spark.createDataFrame([("a", i, t, w, y) for i, t, w, y in rows], "artist string, song_id long, title string, wc long, year int")
    assert {r.song_id: r.keep_id for r in resolve.similar_title_groups(df).collect()} == plain_groups(rows)
    assert resolve.without_similar(df).count() == len(set(plain_groups(rows).values()))


def test_namesakes_by_share_album_and_language(spark):
    songs = [("x", "en", "one", i) for i in range(6)] + [("x", "de", "two", 9), ("x", "de", "two", 10)]  # a cluster
    songs += [("y", "en", "one", i) for i in range(6)] + [("y", "de", "One ", 9), ("y", "de", None, 10)]  # shares an album
    songs += [("z", "es", "one", i) for i in range(6)] + [("z", "pt", "two", 9), ("z", "pt", "two", 10)]  # languages that lists confuse
    songs += [("w", "en", "one", i) for i in range(3)] + [("w", "de", "two", 9), ("w", "de", "two", 10)] + [("w", None, None, 20 + i) for i in range(5)]  # too few have a language
    got = editorial.namesakes(spark.createDataFrame(songs, "artist string, lang string, album string, song_id long")).collect()
    assert [(r.artist, r.lang, r.songs, r.main) for r in got] == [("x", "de", 2, "en")]


def test_languages(spark):
    def lang(*texts):
        rows = [(i, k, w) for i, t in enumerate(texts) for k, w in enumerate(t.split())]
        df = spark.createDataFrame(rows, "song_id long, pos int, word string")
        return {r.song_id: r.lang for r in classify.song_language(df).collect()}

    other = " ".join(f"w{i}" for i in range(5))
    assert lang("the and you with that this for was " + other, "der die und das ist " + other, "한국 노래 사랑 바다 하늘 밤 별 " + other, "カタカナ ひらがな うみ そら ほし よる かぜ " + other, "a b c") == {0: "en", 1: "de", 2: "ko", 3: "ja", 4: None}
    assert lang("и не на что " + " ".join(f"слово{i}" for i in range(12)))[0] is None  # Cyrillic is left to the lists


def test_titles_of_pages(spark):
    rows = [("River", 1.0), ("Interview with Moss", 0.0), ("Interview (Skit)", None), (" x", None), ("Super Bowl Halftime", 0.0), ("Instagram", 1.0), ("Instagram Story", 0.0), ("Übersetzung", 0.0)]
    df = spark.createDataFrame(rows, "t string, want double")
    assert [tuple(r) for r in df.select(classify.weak_label(F.col("t")), "want").collect() if r[0] != r[1]] == []
    many = spark.createDataFrame([(i, 1.0) for i in range(5000)] + [(10_000 + i, 0.0) for i in range(40)], "id long, label double")
    n = {r.label: r["count"] for r in classify.balanced_labels(many, "id").groupBy("label").count().collect()}
    assert n[0.0] == 40 and 320 <= n[1.0] <= 480


def test_payloads(spark):
    stored = spark.createDataFrame([("Beyoncé", p, p, t, w, w // 2, 0.5, 0.1, 0.0, False) for p, (t, w) in enumerate([("Halo", 400), ("Déjà Vu", 300), ("halo ", 100)], 1)], "artist string, place long, song_id long, title string, wc long, uniq long, ttr double, rep double, chorus double, has_sections boolean")
    live = spark.createDataFrame([(9, "Beyoncé", "Halo", 410, 200, 0.4878, 0.3, True, 0.2, 0.6), (10, "new act", "First", 90, 50, 0.5556, 0.2, True, 0.0, 0.25), (11, "Beyoncé", "New One", 50, 30, 0.6, 0.0, False, 0.0, 0.0)], "song_id long, artist string, title string, wc long, uniq long, ttr double, rep double, has_sections boolean, hook double, chorus double")
    cuts = spark.createDataFrame([("wc", p, float(p * 10)) for p in range(101)], "metric string, p long, cut double")
    asked = spark.createDataFrame([(1, "beyonce", "deja-vu"), (2, "BEYONCE", "halo"), (3, "new-act", "first"), (4, "nobody", "x")], "request_id long, artist string, title string")
    got = {r.request_id: r for r in payload.song_payloads(asked, stored, live, cuts).collect()}
    assert set(got) == {1, 2, 3}
    assert (got[1].artist, got[1].title, got[1].source, got[1].wc, got[1].words_rank, got[1].songs, got[1].percentiles, got[1].title_slug) == ("Beyoncé", "Déjà Vu", "dataset", 300, 2, 3, "wc:30", "deja-vu")
    assert (got[2].title, got[2].source, got[2].wc, got[2].words_rank, got[2].words_median, got[2].in_catalogue) == ("Halo", "cache", 410, 1, 300, True)
    assert (got[3].artist, got[3].source, got[3].songs, got[3].in_catalogue, got[3].hook) == ("new act", "cache", None, None, 0.0)
    merged = payload.merged_songs(stored, live)
    assert {(r.title, r.wc, r.source) for r in merged.where("artist = 'Beyoncé'").collect()} == {("Halo", 410, "live"), ("Déjà Vu", 300, "dataset"), ("New One", 50, "new")}
    lists = spark.createDataFrame([("Beyoncé", 1, "love", 9), ("Beyoncé", 2, "halo", 8)], "artist string, rank long, word string, uses long")
    fresh = spark.createDataFrame([("Beyoncé", "halo", 3), ("Beyoncé", "unlisted", 50)], "artist string, word string, uses long")
    totals = spark.createDataFrame([("Beyoncé", 800)], "artist string, total_words long")
    sizes = spark.createDataFrame([("Beyoncé", 2), ("new act", 1)], "artist string, n long")
    page = {r.artist: r for r in payload.artist_payloads(totals, merged, {"top_words": payload.bumped(lists, fresh)}, sizes).collect()}
    b = page["Beyoncé"]
    assert (b.song_count, b.total_words, b.avg_words_per_song, b.top_words, b.avg_chorus_ratio, b.source, b.limited, b.cached_total) == (3, 850, 283.33, "halo:11,love:9", 0.6, "dataset", False, 3)
    assert (page["new act"].source, page["new act"].limited, page["new act"].avg_chorus_ratio) == ("cache", True, 0.25)


def test_fold(spark):
    rows = spark.createDataFrame([("bad�", "x", 100), ("ï¿½ugh", "x", 100), ("ok\0", "t\0", 100), ("ok", "short", 59), ("ok", "skit", 5), ("ok", "long", 2001)], "artist string, title string, wc long")
    assert sorted((r.artist, r.title) for r in fold.clean_rows(rows, "artist", "title").collect()) == [("ok", "skit"), ("ok", "t")]
    kept = fold.clean_rows(rows.where("wc = 0"), "artist")
    assert kept.count() == 0


def test_backfill_and_refresh(spark):
    songs = spark.createDataFrame([(1, " ", False), (2, "x", True), (3, "x", False), (4, "x", False), (5, "x", False)], "song_id long, lyrics string, clocked boolean")
    ids = lambda *k: spark.createDataFrame([(i,) for i in k], "song_id long")
    assert {r.song_id: r.outcome for r in payload.clock_backfill(songs, ids(5), ids(4, 5)).collect()} == {1: "no text", 2: "timed already", 3: "no timed text", 4: "did not line up", 5: "clocked"}
    lrc = spark.createDataFrame([(1, "[00:10.5][1:02] two stamps\n[0:03:250]x\nno stamp\n[0:09]\n [1:00.123456] late")], "song_id long, synced string")
    assert [(r["at"], r.words) for r in clock.first_stamps(lrc).orderBy("at").collect()] == [(3.25, 1), (9.0, 0), (10.5, 2)]


def test_samples(spark):
    rows = spark.createDataFrame([("a", i, i) for i in range(40)] + [("b", 100, 5)], "artist string, song_id long, wc long")
    totals = spark.createDataFrame([("a", 99), ("b", 99)], "artist string, total long")
    got = {r.artist: r for r in editorial.sampled_payload(rows, 10, 1, totals).collect()}
    assert (got["a"].songs, len(got["a"].sampled), got["a"].limited, got["a"].cached_total) == (39, 10, False, 99)
    assert (got["b"].sampled, got["b"].limited, got["b"].cached_total) == ([100], True, 1)
    assert lookup.hash_sample(rows, "song_id", 5).collect() == lookup.hash_sample(rows.repartition(3), "song_id", 5).collect()


def test_ingest_and_versions(spark, tmp_path):
    schema = "k long, title string, lyrics string"
    spark.createDataFrame([(1, "a", "words"), (2, "b", " ")], schema).coalesce(1).write.parquet(str(tmp_path / "in" / "0"))
    read = lambda: spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    run = lambda: sinks.ingest(read(), str(tmp_path / "songs"), ["k"], str(tmp_path / "cp"), "trim(lyrics) <> ''").awaitTermination(120)
    run()
    assert sorted(map(tuple, sinks.last_version(spark, str(tmp_path / "songs")).collect())) == [(1, "a", "words")]
    spark.createDataFrame([(1, None, "other words"), (3, "c", "more")], schema).coalesce(1).write.parquet(str(tmp_path / "in" / "1"))
    run()
    assert sorted(map(tuple, sinks.last_version(spark, str(tmp_path / "songs")).collect())) == [(1, "a", "other words"), (3, "c", "more")]


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "x", "b"), (1, "x", "a"), (2, "y", "c")], "k long, s string, t string")
    for n in (1, 3):
        sinks.replace_all(df.repartition(n), str(tmp_path / "r"), "k")
        assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "r")).collect())) == [(1, "x", "a"), (2, "y", "c")]
    sinks.write_partitioned(df, str(tmp_path / "p"), "k")
    assert spark.read.parquet(str(tmp_path / "p")).where("k = 1").count() == 2 and (tmp_path / "p" / "k=2").is_dir()
    (tmp_path / "c.json").write_text('[{"name": "moss",\n "drop": ["a", "b"]},\n {"name": "reed"}]')
    assert {(r.name, tuple(r.drop or ())) for r in tables.read_json_config(spark, str(tmp_path / "c.json"), "name string, drop array<string>").collect()} == {("moss", ("a", "b")), ("reed", ())}
    assert tables.rows_of_keys(df, spark.createDataFrame([(2,), (2,), (9,)], "k long"), "k").count() == 1
    assert sinks.trim_for_serving(df.withColumn("l", F.array(F.lit(1), F.lit(2))), ["t"], {"l": 1}).first().l == [1]


def test_jdbc(spark, tmp_path):
    """The database that ships with Spark stands for any other."""
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    driver = "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    try:
        spark._jvm.java.lang.Class.forName(driver)
    except Exception:  # noqa: BLE001
        pytest.skip("no embedded database")
    spark.range(50).selectExpr("id", "id * 2 twice").write.format("jdbc").options(url=url, dbtable="numbers", driver=driver).save()
    got = tables.read_jdbc(spark, url, 'select "id", "twice" from numbers where "id" < 10', 5, driver=driver)
    assert sorted(r.twice for r in got.collect()) == [2 * i for i in range(10)]


def test_merged_years(spark):
    assert SequenceMatcher(None, "abcd", "bcde").ratio() == 0.75  # the similarity that alignment goes by
    years = spark.createDataFrame([("y", 1999, 1), ("y", 2001, 2)], "key string, year int, ord long")
    assert artist.backfill_years(spark.createDataFrame([("y",)], "key string"), years).first().year == 2001
