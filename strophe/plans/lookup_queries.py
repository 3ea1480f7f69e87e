"""Lookups, source operators and window extensions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from strophe.functions.text import artist_name, big_number, minutes, name_key, ordinal, percent, slug, title_words, unslug
from strophe.operators import lookup
from strophe.plans.sqltext import SONGS
from strophe.sources.sinks import fill_missing, size_report, upsert
from strophe.sources.tables import songs, table
from strophe.streaming import windows

PREFIXES = ("cu", "customer00000000", "supplier", "an", "gre", "lav", "00")
REQUESTS = (("r1", "Customer#000000001"), ("r2", "nobody"), ("r3", "ALGERIA"), ("r4", "united & kingdom"), ("r5", "middle + east"))
TYPOS = ("algerai", "argentin", "brasil", "chinna", "germani", "jordann", "untied kingdom", "supplier#00000000x")


def names(spark, sf):
    """``key, display, n``: nations, regions, suppliers and customers as names with a catalogue size."""
    t = lambda x: table(spark, sf, x)
    parts = [t("nation").select(F.col("n_name").alias("display"), F.col("n_nationkey").cast("long").alias("n")), t("region").select("r_name", F.col("r_regionkey").cast("long")), t("supplier").select("s_name", F.col("s_suppkey").cast("long")), t("customer").select("c_name", F.col("c_custkey").cast("long"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.select(name_key(F.col("display")).alias("key"), "display", "n")


def name_keys(spark, sf):
    return names(spark, sf).select("display", "key", slug(F.col("display")).alias("slug"), unslug(slug(F.col("display"))).alias("unslug"), title_words(F.col("display")).alias("words"), artist_name(F.lower("display")).alias("shown"))


def number_forms(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", ordinal(F.col("o_orderkey")).alias("place"), minutes(F.col("o_orderkey")).alias("clock"), big_number(F.col("o_orderkey") * 1000).alias("big"), percent(F.col("o_orderkey") % 7 / 7).alias("share"))


def typeahead(spark, sf):
    return lookup.typeahead(names(spark, sf), spark.createDataFrame([(p,) for p in PREFIXES], "prefix string"))


def tiered_lookup(spark, sf):
    return lookup.tiered_lookup(names(spark, sf), spark.createDataFrame(list(REQUESTS), "request_id string, name string"))


def did_you_mean(spark, sf):
    asked = spark.createDataFrame([(t,) for t in TYPOS], "name string").withColumn("key", name_key(F.col("name")))
    return lookup.did_you_mean(names(spark, sf), asked)


def exact_songs(spark, sf):
    s = songs(spark, sf).select("song_id", "artist", "title")
    asked = s.select(F.col("song_id").alias("request_id"), F.upper("artist").alias("artist"), F.concat(F.lit(" "), "title").alias("title"))
    return lookup.exact_songs(s, asked).groupBy("request_id").agg(F.count(F.lit(1)).alias("matches"), F.min("song_id").alias("first"))


def autocomplete_titles(spark, sf):
    asked = spark.createDataFrame([("the",), ("la",), ("ein",), ("green",)], "q string")
    return lookup.autocomplete_titles(table(spark, sf, "part").select(F.col("p_name").alias("title")), asked)


def fetch_plan(spark, sf):
    o = table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    v = table(spark, sf, "events").where("event_type = 'click'").select("user_id")
    wanted = table(spark, sf, "customer").select("c_custkey", "c_name").withColumn("user_id", F.col("c_custkey"))
    return lookup.fetch_plan(wanted, (o, "c_custkey"), (v, "user_id")).select("c_custkey", "c_name")


def title_list(spark, sf):
    return songs(spark, sf).where("lyrics <> ''").select("artist", "title").distinct()


def dump_songs(spark, sf):
    tracks = table(spark, sf, "labels").select("doc_id", F.col("doc_id").alias("last_lyrics_id"))
    words = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("plain_lyrics"), (F.col("lang") == "de").alias("instrumental"))
    return lookup.dump_songs(tracks, words).select("doc_id", F.length("plain_lyrics").cast("long").alias("chars"))


def best_hits(spark, sf):
    hits = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("request_id"), F.col("l_linenumber").cast("long").alias("pos"), F.lit("AIR").alias("wanted_key"), F.when(F.col("l_returnflag") == "A", "AIR").otherwise("X").alias("title_key"), F.when(F.col("l_linestatus") == "F", "timed").alias("synced"))
    return lookup.best_hit(hits).select("request_id", "pos", "tier")


def first_provider(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.when(F.col("lang") == "en", F.col("text")).alias("a"), F.when(F.col("lang") == "fr", F.lit(" ")).when(F.col("lang") == "de", F.col("text")).alias("b"), F.col("source").alias("c"))
    return lookup.first_provider(d, ["a", "b", "c"]).select("doc_id", "lyrics_source", F.length("lyrics").cast("long").alias("chars"))


def upserted_customers(spark, sf):
    old = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    new = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.bround(F.max("o_totalprice"), 2).alias("c_acctbal"))
    return upsert(old, new, ["c_custkey"])


def filled_customers(spark, sf):
    left = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_mktsegment") == "BUILDING", F.lit("")).otherwise(F.col("c_mktsegment")).alias("segment"))
    right = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("segment"))
    return fill_missing(left, right, ["c_custkey"])


def size_by_cutoff(spark, sf):
    return size_report(table(spark, sf, "nation").select("n_nationkey", "n_name"), "n_nationkey", [3, 5, 8, 10, 15, 20])


def tumbling_events(spark, sf):
    return windows.tumbling_counts(table(spark, sf, "events"))


def sliding_events(spark, sf):
    return windows.sliding_counts(table(spark, sf, "events"))


def session_events(spark, sf):
    return windows.sessions(table(spark, sf, "events"))


QUERIES = {
    f.__name__: f
    for f in (
        name_keys, number_forms, typeahead, tiered_lookup, did_you_mean, exact_songs, autocomplete_titles, fetch_plan, title_list, dump_songs, best_hits, first_provider,
        upserted_customers, filled_customers, size_by_cutoff, tumbling_events, sliding_events, session_events,
    )
}

KEY = r"regexp_replace(lower(strip_accents({})), '[^\p{{L}}\p{{N}}]', '', 'g')"
NAMES = f"""names as (select {KEY.format("display")} key, display, n from (
select n_name display, n_nationkey::bigint n from nation union all select r_name, r_regionkey::bigint from region union all select s_name, s_suppkey from supplier union all select c_name, c_custkey from customer))"""
SLUG = r"regexp_replace(regexp_replace(lower(strip_accents(display)), '[^\p{L}\p{N}]+', '-', 'g'), '^-|-$', '', 'g')"
PREFIX_SQL = ", ".join(f"('{p}')" for p in PREFIXES)
TYPO_SQL = ", ".join(f"('{p}')" for p in TYPOS)
ASKED = """asked as (select request_id, tier, {} k from (
select request_id, unnest([0, 1, 2]) tier, unnest([lower(name), replace(replace(lower(name), ' & ', ' and '), ' + ', ' and '), replace(replace(lower(name), ' & ', ' '), ' + ', ' ')]) v from req))""".format(KEY.format("v"))

ORACLES = {
    "name_keys": rf"""with {NAMES}, x as (select *, {SLUG} slug from names)
        select display, key, slug, case when not contains(slug, ' ') and contains(slug, '-') then replace(slug, '-', ' ') else slug end unslug, trim(regexp_replace(regexp_replace(lower(display), '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g')) words,
          list_aggregate(list_transform(string_split(lower(display), ' '), lambda w: upper(left(w, 1)) || substr(w, 2)), 'string_agg', ' ') shown from x""",
    "number_forms": """
        select o_orderkey, o_orderkey || case when o_orderkey % 100 between 11 and 13 then 'th' when o_orderkey % 10 = 1 then 'st' when o_orderkey % 10 = 2 then 'nd' when o_orderkey % 10 = 3 then 'rd' else 'th' end place,
          (o_orderkey // 60) || ':' || lpad((o_orderkey % 60)::varchar, 2, '0') clock,
          case when o_orderkey >= 1000 then ((o_orderkey * 1000 + 50000) // 100000 // 10) || case when (o_orderkey * 1000 + 50000) // 100000 % 10 <> 0 then '.' || ((o_orderkey * 1000 + 50000) // 100000 % 10) else '' end || ' million'
            when o_orderkey >= 1 then o_orderkey || ',000' else '0' end big, round(o_orderkey % 7 / 7.0 * 100)::bigint || '%' share from orders""",
    "typeahead": f"""
        with {NAMES}, p(prefix) as (values {PREFIX_SQL}), h as (select prefix, display, n, starts_with(key, prefix) st from names, p where contains(key, prefix) and length(prefix) >= 2
          qualify row_number() over (partition by prefix, lower(display) order by n desc, display) = 1),
        g as (select *, count(*) filter (st) over (partition by prefix) s from h)
        select prefix, row_number() over (partition by prefix order by st desc, n desc, display) place, display, n from g where st or s < 5 qualify place <= 8""",
    "tiered_lookup": f"""
        with {NAMES}, req(request_id, name) as (values {", ".join(f"('{a}', '{b}')" for a, b in REQUESTS)}), {ASKED}
        select request_id, tier::bigint tier, key, display, n from asked join names on key = k qualify row_number() over (partition by request_id order by tier, n desc, display) = 1""",
    "did_you_mean": f"""
        with {NAMES}, t(name) as (values {TYPO_SQL}), a as (select name, {KEY.format("name")} k from t),
        s as (select name, display, n, round_even(1 - levenshtein(key, k)::double / greatest(length(key), length(k), 1)::double, 4) score from a join names on left(key, 3) = left(k, 3) and length(key) >= 3 and length(k) >= 3)
        select name, display, n, score from s where score > 0.6 qualify row_number() over (partition by name order by score desc, n desc, display) = 1""",
    "exact_songs": f"""
        with {SONGS}, k as (select song_id, lower(trim(artist)) a, lower(trim(title)) t from songs)
        select x.song_id request_id, count(*) matches, min(y.song_id) "first" from k x join k y on x.a = y.a and x.t = y.t group by 1""",
    "autocomplete_titles": """
        with q(q) as (values ('the'), ('la'), ('ein'), ('green')), t as (select distinct p_name title from part)
        select q, row_number() over (partition by q order by case when lower(title) = q then 0 when starts_with(lower(title), q) then 1 else 2 end, length(title), title) place, title from t, q where contains(lower(title), q) qualify place <= 8""",
    "fetch_plan": "select c_custkey, c_name from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'P') and c_custkey not in (select user_id from events where event_type = 'click')",
    "title_list": f"with {SONGS} select distinct artist, title from songs where lyrics <> ''",
    "dump_songs": "select l.doc_id, length(text)::bigint chars from labels l join documents d on l.doc_id = d.doc_id where lang <> 'de' and text is not null and text <> ''",
    "best_hits": """
        select l_orderkey request_id, l_linenumber::bigint pos, (case when l_returnflag = 'A' and l_linestatus = 'F' then 0 when l_returnflag = 'A' then 1 when l_linestatus = 'F' then 2 else 3 end)::bigint tier
        from lineitem qualify row_number() over (partition by l_orderkey order by tier, pos) = 1""",
    "first_provider": """
        select doc_id, case when lang = 'en' and trim(text) <> '' then 'a' when lang = 'de' and trim(text) <> '' then 'b' else 'c' end lyrics_source,
          length(case when lang in ('en', 'de') and trim(text) <> '' then text else source end)::bigint chars from documents""",
    "upserted_customers": """
        with n as (select o_custkey, round_even(max(o_totalprice), 2) p from orders group by 1)
        select coalesce(c_custkey, o_custkey) c_custkey, c_name, coalesce(p, c_acctbal) c_acctbal from customer full join n on c_custkey = o_custkey""",
    "filled_customers": """
        select coalesce(c_custkey, s_suppkey) c_custkey, coalesce(nullif(case when c_mktsegment = 'BUILDING' then '' else c_mktsegment end, ''), s_name) segment from customer full join supplier on c_custkey = s_suppkey""",
    "size_by_cutoff": """
        select count(*) "rows", sum(length('{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}'))::bigint chars, """ + ", ".join(f"count(*) filter (n_nationkey >= {c}) at_least_{c}" for c in (3, 5, 8, 10, 15, 20)) + " from nation",
    "tumbling_events": "select time_bucket(interval '1 hour', ts) window_start, event_type, count(*) n, count(distinct user_id) users from events group by 1, 2",
    "sliding_events": """
        select time_bucket(interval '15 minutes', ts) - k * interval '15 minutes' window_start, event_type, count(*) n from events, range(4) t(k) group by 1, 2""",
    "session_events": """
        with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval '30 minutes' then 0 else 1 end f from events),
        s as (select *, sum(f) over (partition by user_id order by ts rows unbounded preceding) k from g)
        select user_id, min(ts) session_start, max(ts) + interval '30 minutes' session_end, count(*) n from s group by user_id, k""",
}
