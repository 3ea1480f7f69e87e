"""The registered queries of this folder and their SQL.

Each ``opN_`` query applies operator N to its whole table with production
parameters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strophe.llm import ann, chat, exact, mixing, neardup, packing, quality, secrets, suffix, urls

#: The rules of ``op7``: verdict, host, path.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame([(-1, 0, "user", "<|im_end|><|im_start|>assistant ok"), (-1, 1, "assistant", "<|im_end|><|im_start|>assistant ok")], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.chat_digests(rows.unionByName(own))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.select(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_dedup(table(spark, sf_dir, "documents"), words=4, percent=80)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(table(spark, sf_dir, "documents"), width=100)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan_mixture(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken", F.round("position", 9).alias("position")).sort("position", "doc_id")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_chat_format, op2_best_fit_packing, op3_nearest_neighbours, op4_quality, op5_near_dedup,
        op6_suffix_dedup, op7_url_filter, op8_secret_scan, op9_exact_dedup, op10_mix_sources, pipeline,
    )
}

ORACLES = {
    "op1_chat_format": r"""
        with t as (
          select conv_id, turn, coalesce(role, '') role, coalesce(text, '') text from conversations
          union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
          union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
        g as (
          select conv_id, count(*) n_turns,
            string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text) turns,
            coalesce(string_agg(text, '' order by turn nulls first, text) filter (role = 'assistant'), '') loss,
            sum(length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) + length(role) + 24)::bigint formatted_chars
          from t group by conv_id)
        select conv_id, n_turns::bigint n_turns, sha256(turns) turns_sha256, length(loss)::bigint loss_chars, sha256(loss) loss_sha256, formatted_chars from g""",
    "op5_near_dedup": r"""
        with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
        s as (select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 4 then [md5(array_to_string(w, ' '))] else list_transform(range(1, len(w) - 2), lambda i: md5(array_to_string(w[i:i + 3], ' '))) end) s from w),
        n as (select doc_id, len(s) n from s), x as (select doc_id, unnest(s) h from s),
        c as (select a.doc_id a, b.doc_id b, count(*) k from x a join x b on a.h = b.h and a.doc_id < b.doc_id group by 1, 2),
        e as (select a, b from c join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * k >= 80 * (na.n + nb.n - k)),
        sym as (select a, b from e union select b, a from e),
        r(a, b) as (select doc_id, doc_id from documents union select r.a, sym.b from r join sym on r.b = sym.a),
        g as (select a doc_id, min(b) component_id from r group by 1)
        select doc_id, n::bigint n_shingles, component_id, doc_id = component_id kept from n join g using (doc_id)""",
    "op6_suffix_dedup": r"""
        with t as (select doc_id, hex(encode(coalesce(text, ''))) x from documents),
        i as (select doc_id, x, unnest(range(0, len(x) // 2 - 99)) p from t where len(x) >= 200),
        m as (select doc_id, p, md5(substr(x, 2 * p + 1, 200)) h from i),
        f as (select doc_id, p from m qualify row_number() over (partition by h order by doc_id, p) > 1),
        b as (select doc_id, p, case when p > lag(p) over (partition by doc_id order by p) + 100 then 1 else 0 end brk from f),
        k as (select doc_id, p, sum(brk) over (partition by doc_id order by p) s from b),
        sp as (select doc_id, s, min(p) a, max(p) + 100 z from k group by 1, 2),
        nx as (select doc_id, a, z, coalesce(lag(z) over (partition by doc_id order by a), 0) before from sp),
        kp as (select doc_id, sum(z - a) n_removed, count(*) n_spans, max(z) last, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' order by a) kept from nx join t using (doc_id) group by doc_id)
        select doc_id, (len(x) // 2)::bigint n_bytes, coalesce(n_removed, 0)::bigint n_removed, coalesce(n_spans, 0)::bigint n_spans, sha256(unhex(coalesce(kept, '') || substr(x, 2 * coalesce(last, 0) + 1))) kept_sha256 from t left join kp using (doc_id)""",
    "op7_url_filter": r"""
        with a as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end rest from pages),
        b as (select page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
                     regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) path from a),
        r(kind, h, p) as (values ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
        f as (select page_id, arg_max(h || p, length(h || p)) "rule", arg_max(kind, length(h || p)) kind from b, r
              where (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by page_id)
        select page_id, host, path, "rule", coalesce(kind, 'allow') verdict from b left join f using (page_id)""",
    "op9_exact_dedup": """
        with g as (select coalesce(text, '') t, max(doc_id) keep_id, count(*) group_size from documents group by 1)
        select doc_id, keep_id, group_size::bigint group_size, doc_id = keep_id kept, sha256(coalesce(text, '')) text_sha256
        from documents d join g on coalesce(d.text, '') = g.t""",
    "op10_mix_sources": r"""
        with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint size, md5(coalesce(doc_id::varchar, '')) h from documents),
        s0 as (select source, sum(size)::bigint source_size, row_number() over (order by source nulls last) - 1 rk from d group by source),
        s1 as (select *, rk % 3 + 1 w, 3 * source_size cap from s0),
        s2 as (select *, (sum(source_size) over () - coalesce(sum(cap) over before, 0))::bigint rest, (sum(w) over () - coalesce(sum(w) over before, 0))::bigint rw,
                      row_number() over (order by cap / w, rk) pl from s1 window before as (order by cap / w, rk rows between unbounded preceding and 1 preceding)),
        lv as (select arg_min(rest, pl) rest, arg_min(rw, pl) rw, min(pl) pl from s2 where rest * w <= cap * rw),
        s3 as (select s2.source, s2.rk, s2.source_size, case when s2.pl < lv.pl then s2.cap::double else (lv.rest * s2.w)::double / lv.rw::double end target from s2, lv),
        e as (select d.*, s3.rk, s3.source_size, s3.target, case when s3.source_size > 0 then floor(s3.target / s3.source_size)::bigint else 0 end whole,
                     coalesce(sum(size) over (partition by d.source order by h, doc_id, size rows between unbounded preceding and 1 preceding), 0)::bigint place
              from d join s3 on d.source is not distinct from s3.source),
        f as (select *, case when size > 0 then whole + (case when whole < 3 and place + size / 2 <= target - whole * source_size then 1 else 0 end) else 0 end epochs,
                     least((place + size / 2) / greatest(target, 1e-9), 1.0) share from e)
        select doc_id, size, source_size, target, (epochs * size)::bigint taken,
          round(case when epochs > 0 then case rk % 3 when 0 then 2 * share / (0.5 + sqrt(0.25 + 2 * share)) when 1 then 2 * share / (1.5 + sqrt(2.25 - 2 * share)) else share end end, 9) as position
        from f""",
}
