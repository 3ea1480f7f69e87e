"""URL filter with redirect equivalence (DataFrame functions only).

Pages, redirect targets and canonical links are nodes named by their url, query
included, without scheme and fragment. Their edges' connected components carry
a block from one alias to the others; an explicit allow takes precedence. Components are found by joins alone (see
``common.components``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strophe.llm.common import Tables, components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for null or for a url without ``://``."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest of ``rules`` (verdict, host, path) that fits, and its verdict; null if none.

    A rule fits its host and all subdomains if the path starts with the rule's.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def node(url: Column) -> Column:
    """The name of a page among its aliases: the url without scheme and fragment, an empty path as ``/``; empty for null or no ``://``."""
    host, path = split_url(url)
    return F.when(host != "", F.concat(host, F.when(path == "", "/").otherwise(path), F.regexp_extract(url, r"^[^#]*?(\?[^#]*)", 1))).otherwise("")


def without_dots(path: Column) -> Column:
    """A path without its ``.`` and ``..`` segments; ``..`` at the root is dropped."""
    step = lambda done, s: (
        F.when(s == ".", done).when(s == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(s)))
    )
    # the first segment, before the leading slash, is empty; a last one of dots leaves its slash
    parts = F.split(F.regexp_replace(F.regexp_replace(path, "^/", ""), r"(^|/)(\.\.?)$", "$1$2/"), "/")
    return F.concat(F.lit("/"), F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/"))


def resolved(base: Column, target: Column) -> Column:
    """The absolute url of a link target on a page whose base is ``base`` (an absolute url)."""

    def absolute(x: Column) -> Column:
        root, t, own = F.concat(x["scheme"], F.lit("://"), x["host"]), x["t"], x["own"]
        return (
            F.when(t.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), t)
            .when(t.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), "")
            .when(t.startswith("//"), F.concat(x["scheme"], F.lit(":"), t))
            .when(t.startswith("?"), F.concat(root, x["path"], t))
            .when(t.startswith("#"), F.concat(F.regexp_extract(x["base"], r"^([^#]*)", 1), t))
            .otherwise(F.concat(root, without_dots(F.when(t.startswith("/"), own).otherwise(F.concat(F.regexp_extract(x["path"], r"^(.*/)", 1), own))), F.substr(t, F.length(own) + 1)))
        )

    host, path = split_url(base)
    t = F.replace(target, F.lit("&amp;"), F.lit("&"))
    parts = F.struct(
        base.alias("base"), F.substring_index(base, "://", 1).alias("scheme"), host.alias("host"), F.when(path == "", "/").otherwise(path).alias("path"),
        t.alias("t"), F.regexp_extract(t, r"^([^?#]*)", 1).alias("own"),
    )
    return F.get(F.transform(F.array(parts), absolute), F.lit(0))  # each part is worked out once


def page_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(from_url, to_url)`` of the canonical links and refresh redirects in the pages.

    Relative targets are resolved against the page's ``<base>`` or else its
    url; targets of other kinds, such as ``mailto:``, lead nowhere. Null html,
    and pages without such tags, give no rows.
    """
    html, url = F.col(html_col), F.col(url_col)
    attr = lambda tag, name: F.regexp_extract(tag, rf"(?is)\b{name}\s*=\s*[\"']?\s*([^\"'>\s]+)", 1)
    links = F.transform(
        F.filter(F.regexp_extract_all(html, F.lit(r"(?is)<link\b[^>]*>"), F.lit(0)), lambda t: F.lower(attr(t, "rel")) == "canonical"),
        lambda t: attr(t, "href"),
    )
    turns = F.transform(
        F.filter(F.regexp_extract_all(html, F.lit(r"(?is)<meta\b[^>]*>"), F.lit(0)), lambda t: F.lower(attr(t, "http-equiv")) == "refresh"),
        lambda t: F.regexp_extract(t, r"(?is)\burl\s*=\s*[\"']?\s*([^\"'>\s;]+)", 1),
    )
    # a page without either tag costs two substring tests
    some = F.lower(html).contains("canonical") | F.lower(html).contains("refresh")
    base = attr(F.regexp_extract(html, r"(?is)<base\b[^>]*>", 0), "href")
    found = pages.where(some).select(url.alias("from_url"), base.alias("b"), F.explode(F.concat(links, turns)).alias("t")).where("t <> '' and from_url is not null")
    found = found.withColumn("b", F.when(F.col("b") == "", F.col("from_url")).otherwise(resolved(F.col("from_url"), F.col("b"))))
    return found.select("from_url", resolved(F.col("b"), F.col("t")).alias("to_url"))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], redirects: DataFrame | None = None, url_col: str = "url", html_col: str | None = "html", default: str = "allow") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``.

    The verdict is that of the longest fitting rule. Without one it is that of
    the aliases (pages joined by ``redirects(from_url, to_url)`` and by links
    in the html): allow if a rule allows any of them, else block if a rule
    blocks any, else ``default``. Null urls have empty host and path and no
    aliases; null in ``redirects`` links nothing. Columns of the added names in ``pages`` are replaced.
    """
    spark = pages.sparkSession
    links = page_links(pages, url_col, html_col) if html_col else None
    if redirects is not None:
        given = redirects.select("from_url", "to_url")
        links = given if links is None else links.union(given)
    host, path = split_url(F.col(url_col))
    out = pages.drop("host", "path", "rule", "verdict", "_node", "_own", "_alias")
    out = out.withColumns({"host": host, "path": path})
    rule, own = fitting_rule(F.col("host"), F.col("path"), rules)
    out = out.withColumns({"rule": rule, "_own": own})
    plain = out.withColumn("verdict", F.coalesce("_own", F.lit(default))).drop("_own")
    if links is None:
        return plain
    tables = Tables(spark, "urls")
    # written first, so that no filter repeats the parsing
    named = tables.write(links.select(node(F.col("from_url")).alias("u"), node(F.col("to_url")).alias("v")))
    edges = tables.write(named.where("u <> '' and v <> '' and u <> v").distinct())
    if edges.isEmpty():
        tables.drop(edges)
        return plain
    found = components(edges, tables)
    _, kind = fitting_rule(F.regexp_extract("node", r"^([^/]*)", 1), F.regexp_extract("node", r"^[^/]*([^?]*)", 1), rules)
    group = (
        found.select("component", kind.alias("k")).groupBy("component")
        .agg(F.max(F.col("k") == "allow").alias("a"), F.max(F.col("k") == "block").alias("b"))
        .select("component", F.when(F.col("a"), "allow").when(F.col("b"), "block").alias("_alias"))
        .where("_alias is not null")
    )
    alias = found.join(group, "component").select(F.col("node").alias("_node"), "_alias")
    return (
        out.withColumn("_node", node(F.col(url_col))).join(alias, "_node", "left")
        .withColumn("verdict", F.coalesce("_own", "_alias", F.lit(default))).drop("_own", "_alias", "_node")
    )
