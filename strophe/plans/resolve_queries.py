"""Entity-resolution queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strophe.functions.text import name_key, token_table
from strophe.functions.titles import BRACKETS, CLAUSE, DASH_VARIANT, INTERLUDE, LAST_VARIANT, MEDLEY, NOT_A_SONG, PSEUDO, REMIX, SITE, SKIT, TRACK_NUMBER, VERSION, canonical_title, display_title, is_plain_title, title_key, version_clauses
from strophe.functions.words import ALL_STOPWORDS
from strophe.operators import artist, resolve
from strophe.operators.song import row_words
from strophe.plans.artist_queries import COUNTED
from strophe.plans.sqltext import SONGS, TOKENS, q, words_sql
from strophe.sources.scratch import Tables
from strophe.sources.tables import songs, table

#: What is put before and after the names of parts, which have no versions of their own, by their key.
DECORATIONS = (("01. ", ""), ("", " (Live)"), ("", " - 2009 Remaster"), ("", " [Demo] (Acoustic)"), ("Moss - ", ""), ("", " remix"), ("Interlude ", ""), ("(Intro) ", ""), ("", "  - live version"), ("B2 ", " (Moss Remix"), ("7 ", ""), ("", " 1999"), ("", " - lyrics.net"), ("Megamix ", ""), ("", ""))


def decorated_parts(spark, sf):
    """``song_id, artist, title, wc, year``: parts as songs of their brands, with titles as uploads have them."""
    rows = table(spark, sf, "part")
    pick = lambda k: F.element_at(F.array(*(F.lit(d[k]) for d in DECORATIONS)), (F.col("p_partkey") % len(DECORATIONS) + 1).cast("int"))
    year = F.when(F.col("p_partkey") % 3 == 0, (F.col("p_partkey") % 50 + 1970).cast("int"))
    return rows.select(F.col("p_partkey").alias("song_id"), F.col("p_brand").alias("artist"), F.concat(pick(0), "p_name", pick(1)).alias("title"), (F.col("p_size") * 10).cast("long").alias("wc"), year.alias("year"))


def prints(spark, sf):
    return resolve.fingerprints(token_table(songs(spark, sf)), ALL_STOPWORDS)


def fingerprints(spark, sf):
    return prints(spark, sf)


def owner_index(spark, sf):
    s = songs(spark, sf)
    return resolve.owner_index(resolve.fingerprints(token_table(s), ALL_STOPWORDS), s.select("song_id", "artist", "title"))


def best_owner(spark, sf):
    return resolve.best_owner(owner_index(spark, sf))


def set_aside_reasons(spark, sf):
    s = songs(spark, sf)
    p = resolve.fingerprints(token_table(s), ALL_STOPWORDS)
    owners = resolve.best_owner(resolve.owner_index(p, s.select("song_id", "artist", "title")))
    wc = artist.counted_songs(s).select("song_id", "wc")
    rows = s.join(p.select("song_id", "fp"), "song_id", "left").join(owners, ["artist", "fp"], "left").join(wc, "song_id", "left")
    reason = resolve.set_aside_reason(F.col("title"), F.col("artist"), F.coalesce("wc", F.lit(0)), F.col("uploads"), F.col("owner"), F.col("owner_uploads"))
    return rows.select("song_id", reason.alias("reason"), resolve.flags(F.col("uploads"), F.col("owner_uploads")).alias("flag"))


def canonical_dedupe(spark, sf):
    s = songs(spark, sf)
    rows = s.join(artist.counted_songs(s).select("song_id", "wc"), "song_id").withColumn("key", canonical_title(F.col("title")))
    return resolve.canonical_dedupe(rows)


def song_groups(spark, sf):
    s = songs(spark, sf)
    rows = s.select("song_id", "artist", canonical_title(F.col("title")).alias("key")).join(prints(spark, sf).select("song_id", "fp"), "song_id", "left")
    return resolve.song_groups(rows)


def group_representatives(spark, sf):
    s = songs(spark, sf)
    groups = song_groups(spark, sf)
    rows = s.select("song_id", "title", F.lit(0).alias("has_synced")).join(groups, "song_id").join(artist.counted_songs(s).select("song_id", "wc"), "song_id")
    return resolve.representative(rows)


def title_votes(spark, sf):
    return resolve.title_votes(songs(spark, sf).select("song_id", "title").join(song_groups(spark, sf), "song_id"))


def containment_pairs(spark, sf):
    return resolve.containment_pairs(token_table(songs(spark, sf)), ALL_STOPWORDS)


def title_forms(spark, sf):
    t = decorated_parts(spark, sf)
    return t.select("song_id", "title", canonical_title(F.col("title")).alias("canonical"), title_key(F.col("title")).alias("key"), display_title(F.col("title")).alias("display"), is_plain_title(F.col("title")).alias("plain"), F.size(version_clauses(F.col("title"))).cast("long").alias("clauses"))


def alias_closure(spark, sf):
    """Parts as names, each an alias of the one of half its key."""
    p = table(spark, sf, "part").where("p_partkey > 1")
    return resolve.close_aliases(p.select(F.col("p_partkey").cast("string").alias("alias"), F.floor(F.col("p_partkey") / 2).cast("string").alias("canonical")))


def truncation_stubs(spark, sf):
    """Customers' names, and the same names with a letter outside ASCII behind."""
    c = table(spark, sf, "customer").select("c_name", F.col("c_custkey").alias("k"))
    longer = c.select(F.concat("c_name", F.lit("é and more")), F.when(F.col("k") % 2 == 0, F.col("k") * 12).otherwise(F.col("k") * 3))
    return resolve.truncation_stubs(c.toDF("name", "songs").union(longer).union(c.select(F.concat("c_name", F.lit("x")), F.col("k") * 50)))


def alias_overlap(spark, sf):
    """Sources under their name, a third of their texts under an inverted one as well, and some under a name of their own."""
    p = prints(spark, sf)
    again = p.where("song_id % 3 = 0").select(F.concat("artist", F.lit(", The")).alias("artist"), "fp")
    alone = p.where("song_id % 7 = 0").select(F.concat(F.lit("The "), F.concat("artist", F.lit(" Band"))).alias("artist"), "fp").union(p.where("song_id % 7 = 1").select(F.concat(F.lit("Band "), "artist").alias("artist"), "fp"))
    return resolve.alias_overlap(p.select("artist", "fp").union(again).union(alone), p.select("artist").union(alone.where("artist like 'Band%'").select("artist")))


def hashed_owners(spark, sf):
    """The owner index keyed by hashes of the prints."""
    s = songs(spark, sf)
    hashed = resolve.fingerprints(token_table(s), ALL_STOPWORDS).withColumn("fp", resolve.print_hash(F.col("fp")))
    return resolve.owner_index(hashed, s.select("song_id", "artist", "title")).select("artist", "uploads", "title")


def best_titles(spark, sf):
    t = decorated_parts(spark, sf)
    return resolve.best_title(t.select("artist", (F.col("song_id") % 4).alias("group_id"), "title"))


def credited_songs(spark, sf):
    """Documents whose titles name a source that may hold their words too."""
    p = prints(spark, sf)
    s = songs(spark, sf).select("song_id", "artist").join(p.select("song_id", "fp"), "song_id")
    n = F.col("song_id") % 4
    named = F.concat(F.lit("src"), ((F.col("song_id") * 7 + 3) % 20).cast("string"))
    title = F.when(n == 0, F.concat(F.lit("Some Song ("), named, F.lit(")"))).when(n == 1, F.concat(named, F.lit(" / Some Song"))).when(n == 2, F.concat(F.lit("Some Song - "), named, F.lit(" & nobody"))).otherwise(F.concat(F.lit("Some Song (feat. "), named, F.lit(")")))
    owners = s.select("fp", "artist").union(s.where("song_id % 3 = 0").select("fp", named.alias("artist"))).groupBy("fp", "artist").agg(F.count(F.lit(1)).alias("uploads"))
    uploads = songs(spark, sf).groupBy(F.col("artist").alias("key")).agg(F.count(F.lit(1)).alias("rows"))
    return resolve.credited_elsewhere(s.withColumn("title", title), owners, uploads, 5)


def listed_medleys(spark, sf):
    """Parts, of which some are titled as two parts of the same brand."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("song_id"), F.col("p_brand").alias("artist"), F.col("p_name").alias("name"))
    other = F.lead("name").over(W.partitionBy("artist").orderBy("song_id"))
    t = p.withColumn("o", F.coalesce(other, F.lit("Nothing"))).withColumn("title", F.when(F.col("song_id") % 3 == 0, F.concat("name", F.lit(" / "), "o")).when(F.col("song_id") % 3 == 1, F.concat("name", F.lit(" / "), F.lit("unheard of"))).otherwise(F.col("name")))
    return resolve.names_listed_songs(t.select("song_id", "artist", "title", title_key(F.col("title")).alias("key")))


def held_songs(spark, sf):
    """Documents, and for some of them a text of two documents of one source, or of one with words of another."""
    s = songs(spark, sf).select("song_id", "artist", "lang", "lyrics", "title")
    after = s.select((F.col("song_id") - 20).alias("song_id"), "artist", F.col("lyrics").alias("more"))
    both = s.join(after, ["song_id", "artist"]).where("song_id % 10 in (0, 5)")
    more = F.when(F.col("song_id") % 10 == 5, F.left("more", F.floor(F.length("lyrics") / 4).cast("int"))).otherwise(F.col("more"))
    return s.union(both.select((F.col("song_id") + 1_000_000_000).alias("song_id"), "artist", "lang", F.concat_ws("\n", "lyrics", more).alias("lyrics"), F.concat(F.lit("Both of "), "song_id").alias("title")))


def held_texts(spark, sf):
    s = held_songs(spark, sf)
    texts = Tables(spark, "held").write(row_words(s, lambda w: ~w.isin(*ALL_STOPWORDS) & (F.length(w) >= 3)))
    keys = s.select("song_id", canonical_title(F.col("title")).alias("key"))
    return resolve.medleys(resolve.contained(texts), texts, keys)


def medleys(spark, sf):
    return held_texts(spark, sf)[0].select("artist", "whole")


def extended_takes(spark, sf):
    return held_texts(spark, sf)[1].select("u", "v").distinct()


def cleaned_songs(spark, sf):
    """One row for each song that an artist's uploads make: who stands for it, its title, and why it is set aside."""
    s = songs(spark, sf)
    p = prints(spark, sf)
    keyed = s.select("song_id", "artist", canonical_title(F.col("title")).alias("key")).join(p.select("song_id", "fp"), "song_id", "left")
    groups = resolve.song_groups(keyed)
    rows = s.select("song_id", "title", F.lit(0).alias("has_synced")).join(groups, "song_id").join(artist.counted_songs(s).select("song_id", "wc"), "song_id")
    reps = resolve.representative(rows).join(rows.select("song_id", "wc"), "song_id").join(p.select("song_id", "fp"), "song_id", "left")
    shown = reps.join(resolve.best_title(rows), ["artist", "group_id"], "left").join(resolve.title_votes(rows), ["artist", "group_id"])
    owners = resolve.best_owner(resolve.owner_index(p, s.select("song_id", "artist", "title"))).drop("uploads")
    shown = shown.join(owners, ["artist", "fp"], "left")
    title = F.coalesce("title", F.lit(""))
    reason = resolve.set_aside_reason(title, F.col("artist"), F.col("wc"), F.col("uploads"), F.col("owner"), F.col("owner_uploads"), F.col("medley"), None, F.col("talk"), F.col("skit"), F.col("interlude"))
    return shown.select("artist", "group_id", "song_id", title.alias("title"), "uploads", "wc", reason.alias("reason"), resolve.flags(F.col("uploads"), F.col("owner_uploads")).alias("flag"))


def similar_titles(spark, sf):
    return resolve.similar_title_groups(decorated_parts(spark, sf))


def fragment_aliases(spark, sf):
    """Brands as joint credits, with aliases that are pieces, scrambles and spellings of them."""
    b = table(spark, sf, "part").select(F.regexp_replace("p_name", " ", " & ").alias("display")).distinct()
    parts = F.split("display", " & ")
    rows = b.select("display", F.explode(F.array(name_key(F.element_at(parts, 1)), name_key(F.array_join(F.reverse(parts), "")), name_key(F.col("display")), F.lit("someone else"))).alias("alias"))
    return resolve.fragment_aliases(rows.select("alias", "display").distinct())


def reviewed_songs(spark, sf):
    """Labels as hand reviews: low quality drops a song, toxic renames it."""
    s = songs(spark, sf).select("song_id", "artist", F.col("song_id").cast("string").alias("title"))
    labels = table(spark, sf, "labels").join(s.withColumnRenamed("song_id", "doc_id"), "doc_id")
    reviews = labels.select("artist", F.when(F.col("quality") == 0, "drop").when(F.col("toxic") == 1, "rename").otherwise("keep").alias("action"), "title", F.concat(F.lit("renamed "), "title").alias("value"))
    return resolve.apply_reviews(s, reviews)


def review_misses(spark, sf):
    s = songs(spark, sf).select("artist", "title")
    reviews = table(spark, sf, "labels").select("doc_id").join(songs(spark, sf).withColumnRenamed("song_id", "doc_id"), "doc_id").select("artist", "title")
    return resolve.review_misses(s, reviews)


QUERIES = {
    f.__name__: f
    for f in (
        fingerprints, owner_index, best_owner, set_aside_reasons, canonical_dedupe, song_groups, group_representatives, title_votes, containment_pairs, title_forms, alias_closure,
        truncation_stubs, alias_overlap, hashed_owners, best_titles, credited_songs, listed_medleys, medleys, extended_takes, cleaned_songs, similar_titles, fragment_aliases,
        reviewed_songs, review_misses,
    )
}

STOP = words_sql(ALL_STOPWORDS)
PRINTS = f"""{TOKENS}, c as (select song_id, any_value(artist) artist, word, count(*) uses, min(pos) as first from tokens group by song_id, word),
t40 as (select *, row_number() over (partition by song_id order by uses desc, first) r from c qualify r <= 40),
t12 as (select *, row_number() over (partition by song_id order by r) k from t40 where length(word) >= 3 and word not in ({STOP}) qualify k <= 12),
fps as (select song_id, any_value(artist) artist, string_agg(word, '|' order by word) fp from t12 group by song_id)"""
OWNERS = f"{PRINTS}, own as (select fp, f.artist, count(*) uploads, min(title) title from fps f join songs using (song_id) group by 1, 2)"
BEST = f"""{OWNERS}, bo as (select a.fp, a.artist, any_value(a.uploads) uploads, arg_max(b.artist, (b.uploads, b.artist)) filter (b.artist is not null) owner, max(b.uploads) owner_uploads
from own a left join own b on a.fp = b.fp and a.artist <> b.artist group by 1, 2)"""


def squashed(c: str) -> str:
    return rf"trim(regexp_replace(strip_accents(lower({c})), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


def canonical_sql(c: str) -> str:
    out = squashed(f"regexp_replace(regexp_replace({c}, {q(BRACKETS)}, ' ', 'g'), {q(DASH_VARIANT)}, ' ', 'g')")
    for _ in range(4):
        out = f"trim(regexp_replace({out}, {q(LAST_VARIANT)}, ''))"
    return f"coalesce(nullif({out}, ''), nullif({squashed(c)}, ''), lower(trim({c})))"


def clauses_sql(c: str) -> str:
    last = f"regexp_split_to_array({c}, {q(DASH)})"
    return f"list_concat(list_filter(regexp_extract_all({c}, {q(CLAUSE)}), lambda x: regexp_matches(x, {q(VERSION)})), case when len({last}) > 1 and regexp_matches({last}[-1], {q(VERSION)}) then [{last}[-1]] else []::varchar[] end)"


def plain_sql(c: str) -> str:
    return f"(len({clauses_sql(c)}) = 0 and not regexp_matches({c}, {q(SITE)}) and not regexp_matches({c}, {q(MEDLEY)}))"


def numbered_sql(c: str) -> str:
    t = f"regexp_replace({c}, {q(TRACK_NUMBER)}, '\\1')"
    return f"case when length({t}) >= 2 then {t} else {c} end"


DASH = r"\s[-–—]\s"
#: The display form in three rounds, as a chain of tables d0 to d3 over t(title).
ROUND = "select title, regexp_replace(regexp_replace(list_reduce(list_prepend(d, {c}), lambda a, x: replace(a, x, '')), '^\\s+|\\s+$', '', 'g'), '\\s*[-–—]\\s*$', '') d from d{i}"
DISPLAY = f"n0 as (select title, regexp_replace(title, {q(SITE)}, '') n from t), d0 as (select title, {numbered_sql('n')} d from n0)" + "".join(f", d{i + 1} as ({ROUND.format(c=clauses_sql('d'), i=i)})" for i in range(3)) + r", ds as (select title, coalesce(nullif(regexp_replace(regexp_replace(d, '\s{2,}', ' ', 'g'), '^[ \-–]+|[ \-–]+$', '', 'g'), ''), title) display from d3)"
KEY_SQL = f"tk as (select title, {canonical_sql('d')} k from d0), ks as (select title, case when length(regexp_replace(k, '\\s+(?:19|20)\\d{{2}}$', '')) >= 3 then regexp_replace(k, '\\s+(?:19|20)\\d{{2}}$', '') else k end key from tk)"


KEYED = f"{PRINTS}, keyed as (select s.song_id, s.artist, {canonical_sql('s.title')} key, fp from songs s left join fps using (song_id))"
GROUPS = f"""{KEYED}, per as (select artist, fp, key, count(*) n from keyed where fp is not null group by 1, 2, 3),
home as (select artist, fp, max((n, key)) h from per group by 1, 2),
hall as (select artist, fp, sum(n) alln from per group by 1, 2),
mk as (select k.*, coalesce(h[2] <> k.key and per.n * 2 < alln, false) stray from keyed k left join home using (artist, fp) left join hall using (artist, fp) left join per using (artist, fp, key)),
kk as (select * from mk where not stray and length(key) >= 3 and key <> {squashed('artist')}),
ed as (select song_id u, min(song_id) over (partition by artist, key) v from kk union select song_id, min(song_id) over (partition by artist, fp) from keyed where fp is not null),
sym as (select u, v from ed union select v, u from ed),
reach(a, b) as (select u, u from sym union select reach.a, sym.v from reach join sym on reach.b = sym.u),
comp as (select a song_id, min(b) c from reach group by 1),
grp as (select k.song_id, k.artist, coalesce(c, k.song_id) group_id from keyed k left join comp using (song_id))"""
DECORATED = f"""dp as (select p_partkey song_id, p_brand artist, [{", ".join(q(a) for a, _ in DECORATIONS)}][p_partkey % {len(DECORATIONS)} + 1] || p_name || [{", ".join(q(b) for _, b in DECORATIONS)}][p_partkey % {len(DECORATIONS)} + 1] title from part)"""
CONTENT = f"w as (select artist, song_id, word, count(*) uses from tokens where word not in ({STOP}) and length(word) >= 3 group by 1, 2, 3)"
NAME_WORDS = r"list_aggregate(list_sort(list_filter(string_split(regexp_replace(strip_accents(lower(artist)), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), lambda x: x <> '' and x <> 'the')), 'string_agg', ' ')"

ORACLES = {
    "fingerprints": f"with {PRINTS} select song_id, artist, fp from fps",
    "owner_index": f"with {OWNERS} select fp, artist, uploads, title from own",
    "best_owner": f"with {BEST} select fp, artist, uploads, owner, owner_uploads from bo",
    "set_aside_reasons": rf"""
        with {BEST}, w as (select song_id, count(*) wc from tokens group by 1), x as (select s.song_id, s.title, lower(s.title) t, s.artist, coalesce(wc, 0) wc, coalesce(uploads, 0) u, owner, coalesce(owner_uploads, 0) c,
            string_split({squashed('s.artist')}, ' ') own
          from songs s left join fps f using (song_id) left join bo on bo.fp = f.fp and bo.artist = s.artist left join w using (song_id))
        select song_id, case when regexp_matches(title, {q(MEDLEY)}) then 'medley or megamix'
            when len(list_filter({clauses_sql('title')}, lambda z: regexp_matches(z, {q(REMIX)}) and len(list_intersect(string_split({squashed('z')}, ' '), own)) > 0)) > 0 then 'their remix of another artist''s song'
            when regexp_matches(title, {q(NOT_A_SONG)}) then 'not a song'
            when regexp_matches(title, {q(SKIT)}) or (regexp_matches(title, {q(INTERLUDE)}) and wc < 100) then 'skit or interlude'
            when regexp_matches(title, '(?i)\bvs\.?\s') and len(list_intersect(string_split({squashed('title')}, ' '), own)) > 0 then 'mash-up'
            when owner is not null and not regexp_matches(owner, {q(PSEUDO)}) and ((u <= 2 and c >= greatest(5, 5 * u)) or (u <= 5 and c >= 10 * u) or (length(owner) >= 6 and contains(t, lower(owner)) and c >= u)) then 'belongs to another artist' end reason,
          case when c >= 2 * u and c > 0 then 'more uploads elsewhere' end flag from x""",
    "canonical_dedupe": f"""
        with {COUNTED}, x as (select *, {canonical_sql('title')} key from counted)
        select artist, key, arg_min(song_id, (-wc, song_id)) song_id, max(wc) wc, arg_min(title, (length(title), -song_id)) title, count(*) versions from x group by artist, key""",
    "song_groups": f"with recursive {GROUPS} select song_id, artist, group_id from grp",
    "group_representatives": rf"""
        with recursive {GROUPS}, w as (select song_id, count(*) wc from tokens group by 1),
        x as (select g.*, wc, {plain_sql('title')}::int plain from grp g join songs using (song_id) join w using (song_id)),
        p as (select * from x qualify plain = max(plain) over (partition by artist, group_id)),
        m as (select *, count(*) over (partition by artist, group_id, wc) same, abs(wc - median(wc) over (partition by artist, group_id)) off from p)
        select artist, group_id, song_id from m qualify row_number() over (partition by artist, group_id order by same desc, off, song_id) = 1""",
    "title_votes": f"""
        with recursive {GROUPS} select g.artist, group_id, count(*) uploads, 2 * count(*) filter (regexp_matches(title, {q(MEDLEY)})) > count(*) medley, 2 * count(*) filter (regexp_matches(title, {q(NOT_A_SONG)})) > count(*) talk,
          2 * count(*) filter (regexp_matches(title, {q(SKIT)})) > count(*) skit, 2 * count(*) filter (regexp_matches(title, {q(INTERLUDE)})) > count(*) interlude from grp g join songs using (song_id) group by 1, 2""",
    "containment_pairs": f"""
        with {TOKENS}, w as (select artist, song_id, word, count(*) uses from tokens where word not in ({STOP}) and length(word) >= 3 group by 1, 2, 3),
        n as (select artist, song_id, sum(uses) n from w group by 1, 2 having sum(uses) >= 25), d as (select artist, word, count(*) df from w group by 1, 2),
        ld as (select artist, word, song_id, n from (select w.*, n, df, row_number() over (partition by artist, song_id order by uses desc, df, word) r from w join n using (artist, song_id) join d using (artist, word)) where r <= 6 and df between 2 and 300),
        p as (select distinct a.artist, a.song_id part, b.song_id whole, a.n from ld a join ld b on a.artist = b.artist and a.word = b.word and (a.n < b.n or (a.n = b.n and a.song_id < b.song_id)))
        select p.artist, part, whole, round_even(sum(least(x.uses, y.uses))::double / any_value(n)::double, 4) shared from p join w x on x.song_id = part join w y on y.song_id = whole and y.word = x.word group by p.artist, part, whole having shared >= 0.85""",
    "title_forms": f"""
        with {DECORATED}, t as (select distinct title from dp), {DISPLAY}, {KEY_SQL}
        select song_id, title, {canonical_sql('title')} canonical, key, display, {plain_sql('title')} plain, len({clauses_sql('title')})::bigint clauses from dp join ds using (title) join ks using (title)""",
    "alias_closure": """
        with recursive a as (select p_partkey::varchar alias, (p_partkey // 2)::varchar canonical from part where p_partkey > 1),
        ch(alias, canonical, depth) as (select *, 1 from a union all select ch.alias, a.canonical, depth + 1 from ch join a on ch.canonical = a.alias where depth < 20 and a.canonical <> ch.alias)
        select alias, arg_max(canonical, depth) canonical from ch group by alias""",
    "truncation_stubs": """
        with a as (select c_name name, c_custkey songs from customer union all select c_name || 'é and more', c_custkey * case when c_custkey % 2 = 0 then 12 else 3 end from customer union all select c_name || 'x', c_custkey * 50 from customer)
        select s.name, s.songs::bigint songs, arg_max(l.name, (l.songs, l.name)) longer, max(l.songs)::bigint longer_songs from a s join a l on left(l.name, 18) = left(s.name, 18) and left(l.name, length(s.name)) = s.name and length(l.name) > length(s.name)
          and unicode(substr(l.name, length(s.name) + 1, 1)) > 127 and l.songs >= 10 * s.songs group by s.name, s.songs""",
    "alias_overlap": f"""
        with {PRINTS}, al as (select artist, fp from fps union all select artist || ', The', fp from fps where song_id % 3 = 0 union all select 'The ' || artist || ' Band', fp from fps where song_id % 7 = 0 union all select 'Band ' || artist, fp from fps where song_id % 7 = 1),
        ks as (select artist, fp, {NAME_WORDS} k from al), n as (select k, artist, count(*) n_rows, count(distinct fp) n from ks where k <> '' group by 1, 2 having count(*) >= 5),
        pg as (select distinct artist from fps union select distinct 'Band ' || artist from fps where song_id % 7 = 1), z as (select n.*, pg.artist is not null page, contains(n.artist, ', ') or ends_with(lower(n.artist), ' the') inv from n left join pg using (artist)),
        hd as (select k, arg_min(artist, (not page, inv, -n_rows, artist)) canonical from z group by 1 having count(*) > 1 and bool_or(page)),
        m as (select z.artist alias, canonical, n from z join hd using (k) where z.artist <> canonical), st as (select distinct artist, fp from al),
        o as (select alias, canonical, count(*) shared, round_even(count(*)::double / any_value(n)::double, 4) "overlap" from m join st x on x.artist = alias join st y on y.artist = canonical and y.fp = x.fp group by 1, 2)
        select alias, canonical, shared, "overlap" from o where "overlap" >= 0.25""",
    "hashed_owners": f"with {OWNERS} select artist, uploads, title from own",
    "best_titles": rf"""
        with {DECORATED}, t as (select distinct title from dp), {DISPLAY}, g as (select artist, song_id % 4 group_id, title, {plain_sql('title')} plain from dp),
        c as (select artist, group_id, display d, count(*) n from (select * from g qualify plain or not bool_or(plain) over (partition by artist, group_id)) join ds using (title) where {squashed('display')} <> '' group by 1, 2, 3)
        select artist, group_id, arg_max(d, (n, not (upper(d) = d and lower(d) <> d and length(d) > 4), not regexp_matches(d, '[a-z][A-Z]'), -length(d), d)) title from c group by 1, 2""",
    "credited_songs": f"""
        with {PRINTS}, up as (select artist, count(*) n from songs group by 1), ow as (select distinct fp, artist from fps union select fp, 'src' || (song_id * 7 + 3) % 20 from fps where song_id % 3 = 0)
        select song_id, 'src' || (song_id * 7 + 3) % 20 other from fps f join up on up.artist = 'src' || (song_id * 7 + 3) % 20 join ow on ow.fp = f.fp and ow.artist = 'src' || (song_id * 7 + 3) % 20
        where song_id % 4 <> 3 and n >= 5 and not contains(f.artist, 'src' || (song_id * 7 + 3) % 20) and not contains('src' || (song_id * 7 + 3) % 20, f.artist)""",
    "listed_medleys": rf"""
        with p as (select p_partkey song_id, p_brand artist, p_name name, coalesce(lead(p_name) over (partition by p_brand order by p_partkey), 'Nothing') o from part),
        t as (select song_id, artist, case song_id % 3 when 0 then name || ' / ' || o when 1 then name || ' / unheard of' else name end title, name, o from p), k as (select song_id, artist, title, name, o, {squashed('title')} key from t),
        e as (select song_id, artist, key own, unnest([{squashed('name')}, case when song_id % 3 = 0 then {squashed('o')} else 'unheard of' end]) key from k where song_id % 3 < 2)
        select distinct song_id from e where key <> own and exists (select 1 from k where k.artist = e.artist and k.key = e.key)""",
    "cleaned_songs": rf"""
        with recursive {GROUPS}, wn as (select song_id, count(*) wc from tokens group by 1), t as (select distinct title from songs), {DISPLAY},
        ow as (select fp, f.artist, count(*) uploads from fps f group by 1, 2), bo as (select a.fp, a.artist, arg_max(b.artist, (b.uploads, b.artist)) filter (b.artist is not null) owner, max(b.uploads) owner_uploads from ow a left join ow b on a.fp = b.fp and a.artist <> b.artist group by 1, 2),
        r0 as (select g.*, title, wc, {plain_sql('title')} plain from grp g join songs using (song_id, artist) join wn using (song_id)),
        r1 as (select * from r0 qualify plain or not bool_or(plain) over (partition by artist, group_id)),
        r2 as (select *, count(*) over (partition by artist, group_id, wc) same, abs(wc - median(wc) over (partition by artist, group_id)) off from r1),
        rp as (select artist, group_id, song_id, wc from r2 qualify row_number() over (partition by artist, group_id order by same desc, off, song_id) = 1),
        tc as (select artist, group_id, display d, count(*) n from r1 join ds using (title) where {squashed('display')} <> '' group by 1, 2, 3),
        bt as (select artist, group_id, arg_max(d, (n, not (upper(d) = d and lower(d) <> d and length(d) > 4), not regexp_matches(d, '[a-z][A-Z]'), -length(d), d)) title from tc group by 1, 2),
        vo as (select artist, group_id, count(*) uploads, 2 * count(*) filter (regexp_matches(title, {q(MEDLEY)})) > count(*) medley, 2 * count(*) filter (regexp_matches(title, {q(NOT_A_SONG)})) > count(*) talk, 2 * count(*) filter (regexp_matches(title, {q(SKIT)})) > count(*) skit, 2 * count(*) filter (regexp_matches(title, {q(INTERLUDE)})) > count(*) interlude from r0 group by 1, 2),
        fin as (select rp.*, coalesce(bt.title, '') title, uploads, medley, talk, skit, interlude, owner, coalesce(owner_uploads, 0) c, uploads u, string_split({squashed('rp.artist')}, ' ') own from rp left join bt using (artist, group_id) join vo using (artist, group_id) left join fps f on f.song_id = rp.song_id left join bo on bo.fp = f.fp and bo.artist = rp.artist)
        select artist, group_id, song_id, title, uploads, wc, case when medley then 'medley or megamix'
            when len(list_filter({clauses_sql('title')}, lambda z: regexp_matches(z, {q(REMIX)}) and len(list_intersect(string_split({squashed('z')}, ' '), own)) > 0)) > 0 then 'their remix of another artist''s song'
            when talk then 'not a song' when skit or (interlude and wc < 100) then 'skit or interlude'
            when regexp_matches(title, '(?i)\bvs\.?\s') and len(list_intersect(string_split({squashed('title')}, ' '), own)) > 0 then 'mash-up'
            when owner is not null and not regexp_matches(owner, {q(PSEUDO)}) and ((u <= 2 and c >= greatest(5, 5 * u)) or (u <= 5 and c >= 10 * u) or (length(owner) >= 6 and contains(lower(title), lower(owner)) and c >= u)) then 'belongs to another artist' end reason,
          case when c >= 2 * u and c > 0 then 'more uploads elsewhere' end flag from fin""",
    "reviewed_songs": f"""
        with {SONGS} select song_id, artist, case when quality <> 0 and toxic = 1 then 'renamed ' else '' end || song_id::varchar title from songs left join labels on doc_id = song_id where quality is null or quality <> 0""",
    "review_misses": f"""
        with {SONGS}, r as (select distinct artist, title from labels join songs on song_id = doc_id), n as (select artist, title, count(*) matches from songs group by 1, 2)
        select artist, title, coalesce(matches, 0)::bigint matches from r left join n using (artist, title) where coalesce(matches, 0) <> 1""",
}

#: Texts that hold others: wholes, what they hold (widened for large ones), and whether they hold two unlike texts.
HELD = rf"""cp as ({ORACLES["containment_pairs"]}), {TOKENS}, {CONTENT}, sz as (select artist, song_id, sum(uses) n from w group by 1, 2),
ky as (select song_id, {canonical_sql('title')} key from songs),
lg as (select cp.artist, whole, a.n nw from cp join sz a on a.song_id = whole join sz b on b.song_id = part group by 1, 2, 3 having a.n >= 1.4 * min(b.n)),
l6 as (select artist, word, song_id from w qualify row_number() over (partition by artist, song_id order by uses desc, word) <= 6),
nr as (select distinct lg.artist, l6.song_id part, whole from lg join w on w.song_id = whole join l6 on l6.artist = lg.artist and l6.word = w.word join sz on sz.song_id = l6.song_id where l6.song_id <> whole and sz.n between 25 and nw),
wd as (select nr.artist, part, whole from nr join w x on x.song_id = part join w y on y.song_id = whole and y.word = x.word join sz on sz.song_id = part group by 1, 2, 3 having round_even(sum(least(x.uses, y.uses))::double / any_value(sz.n)::double, 4) >= 0.85),
hd as (select artist, part, whole from cp union select artist, part, whole from wd),
hn as (select hd.*, a.n np, b.n nw, starts_with(kp.key, kw.key) own from hd join sz a on a.song_id = part join sz b on b.song_id = whole join ky kp on kp.song_id = part join ky kw on kw.song_id = whole),
tw as (select x.artist, x.whole, x.part, y.part other, x.np from hn x join hn y using (whole) where x.np < y.np or (x.np = y.np and x.part < y.part)),
sh as (select t.part, t.other, sum(least(x.uses, y.uses)) s from (select distinct part, other from tw) t join w x on x.song_id = t.part join w y on y.song_id = t.other and y.word = x.word group by 1, 2),
un as (select distinct whole from tw left join sh using (part, other) where coalesce(round_even(s::double / np::double, 4), 0) < 0.5),
jd as (select artist, whole, nw, bool_and(own) own, arg_max(part, (np, -part)) best, max(np) bn, whole in (select whole from un) and not bool_and(own) apart from hn group by artist, whole, nw)"""
HELD_SONGS = SONGS.replace("songs as (", "songs0 as (") + """,
songs as (select * from songs0 union all select a.song_id + 1000000000, a.artist, a.lang, a.lyrics || chr(10) || case when a.song_id % 10 = 5 then left(b.lyrics, length(a.lyrics) // 4) else b.lyrics end, 'Both of ' || a.song_id
  from songs0 a join songs0 b on b.song_id = a.song_id + 20 and a.artist = b.artist where a.song_id % 10 in (0, 5))"""
HELD = HELD.replace(SONGS, HELD_SONGS)
ORACLES["medleys"] = f"with {HELD} select artist, whole from jd where apart and bn < 0.6 * nw"
ORACLES["extended_takes"] = f"with {HELD} select distinct whole u, part v from hd join jd using (whole) where not apart union select whole, best from jd where apart and bn >= 0.6 * nw"
