"""Text primitives as Column functions (generated code, no Python on executors)."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A token: letters and letter- or fraction-like numbers, with inner apostrophes. Text is lower-cased first.
TOKEN = r"([\p{L}\p{Nl}\p{No}]+(?:['’][\p{L}\p{Nl}\p{No}]+)*)"
#: A line that opens a section.
HEADER = r"^\s*\[[^\]]*\]\s*$"
#: Lines that page scrapers leave behind.
JUNK_LINE = r"(?iu)^\d+ Contributors?.*$|^.*Lyrics\s*$|^.*Translations?.*$|^\d*Embed$|^You might also like.*$"
#: What a section's name must contain to be of a kind, in order of precedence.
SECTION_KINDS = (
    ("refren", "chorus"), ("hook", "chorus"), ("stih", "verse"), ("strofa", "verse"), ("uvod", "intro"), ("kraj", "outro"), ("most", "bridge"),
    ("chorus", "chorus"), ("verse", "verse"), ("bridge", "bridge"), ("intro", "intro"), ("outro", "outro"), ("refrain", "refrain"),
)


def stripped(c: Column) -> Column:
    """Without blanks at the ends, by Unicode's definition."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


@cache
def folding() -> tuple[str, str]:
    """Letters to fold and what they fold to, from Unicode's own tables; marks stand last and fold to nothing.

    A letter folds if its compatibility form is one letter with combining
    marks. Forms of several letters (ligatures, fractions, Hangul) are left to
    ``functions.unicode``.
    """
    letters, marks = [], []
    for code in range(0x80, 0x10000):
        c = chr(code)
        if 0xD800 <= code < 0xE000:
            continue
        if unicodedata.combining(c):
            marks.append(c)
            continue
        bare = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if len(bare) == 1 and bare != c:
            letters.append((c, bare))
    return "".join(c for c, _ in letters) + "".join(marks), "".join(b for _, b in letters)


def unaccented(c: Column) -> Column:
    """Letters without their accents, in generated code (see ``folding``)."""
    return F.translate(c, *folding())


def token_array(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(1))


def sung(text: Column) -> Column:
    """A text without the lines that open sections; texts without brackets are left alone."""
    return F.when(F.contains(text, F.lit("[")), F.regexp_replace(text, r"(?m)^[^\S\n]*\[[^\]\n]*\][^\S\n]*$", "")).otherwise(text)


def norm_line(line: Column) -> Column:
    """Lower case, each run of blanks one space."""
    return stripped(F.regexp_replace(F.lower(line), r"(?U)\s+", " "))


def match_key(c: Column) -> Column:
    """Lower case, letters and numbers alone."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")


def char_count(c: Column) -> Column:
    """Characters that aren't blanks."""
    return F.length(F.regexp_replace(c, r"(?U)\s", ""))


def clean_raw(c: Column) -> Column:
    """Scraped text without preamble, footer and junk lines."""
    text = F.regexp_replace(F.regexp_replace(c, "\r\n", "\n"), "\r", "\n")
    text = stripped(F.regexp_replace(text, r"(?s)\A.*?Lyrics\s*\n", ""))
    text = F.regexp_replace(text, r"\d*Embed\s*\z", "")
    return stripped(F.array_join(F.filter(F.split(text, "\n"), lambda x: ~stripped(x).rlike(JUNK_LINE)), "\n"))


def section_kind(name: Column) -> Column:
    low = F.lower(name)
    out = F.lit("other")
    for part, kind in reversed(SECTION_KINDS):
        out = F.when(F.contains(low, F.lit(part)), kind).otherwise(out)
    return out


def name_key(c: Column) -> Column:
    """Lookup key of names: without accents, lower case, letters and numbers alone."""
    return F.regexp_replace(F.lower(unaccented(c)), r"[^\p{L}\p{N}]", "")


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(unaccented(c)), r"[^\p{L}\p{N}]+", "-"), r"^-|-$", "")


def name_tokens(c: Column) -> Column:
    """The words of a name, as written and without accents."""
    return F.array_union(token_array(unaccented(F.lower(c))), token_array(c))


def line_ending(line: Column) -> Column:
    """The last three letters of a line without accents, for end rhymes."""
    return F.right(F.regexp_replace(unaccented(F.lower(line)), r"[^\p{L}]", ""), F.lit(3))


def letter_words(c: Column) -> Column:
    """Words of letters alone with inner apostrophes, lower case (text in composed form; ``unicode.composed`` gives it)."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"(\p{L}+(?:['’]\p{L}+)*)"), F.lit(1))


def unslug(c: Column) -> Column:
    """Dashes back to spaces, for names that have no space."""
    return F.when(~F.contains(c, F.lit(" ")) & F.contains(c, F.lit("-")), F.replace(c, F.lit("-"), F.lit(" "))).otherwise(c)


def year_of(c: Column) -> Column:
    """The first four digits, as a year; null if there are none."""
    return F.regexp_extract(c, r"(\d{4})", 1).try_cast("int")


def leading_year(c: Column) -> Column:
    """The year that a date starts with; null if it doesn't start with four digits."""
    return F.regexp_extract(c, r"^(\d{4})", 1).try_cast("int")


def title_words(c: Column) -> Column:
    """Lower case, punctuation to blanks, blanks collapsed (the form a title classifier reads)."""
    return stripped(F.regexp_replace(F.regexp_replace(F.lower(c), r"(?U)[^\w\s]", " "), r"(?U)\s+", " "))


def minutes(seconds: Column) -> Column:
    """``m:ss`` of the rounded seconds; empty for null, 0:00 below zero."""
    s = F.greatest(F.lit(0).cast("long"), F.floor(seconds + 0.5).cast("long"))
    return F.when(seconds.isNull(), "").otherwise(F.concat(F.floor(s / 60).cast("string"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0")))


def percent(share: Column) -> Column:
    """A ratio as a whole percentage; empty for null."""
    return F.coalesce(F.concat(F.floor(share * 100 + 0.5).cast("string"), F.lit("%")), F.lit(""))


def ordinal(n: Column) -> Column:
    end = F.when((n % 100).between(11, 13), "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), end)


def big_number(n: Column) -> Column:
    """``4.7 million`` (one decimal, half up, none if it is 0), or digits in groups of three."""
    tenths = F.floor((n + 50_000) / 100_000).cast("long")
    short = F.concat(F.floor(tenths / 10).cast("string"), F.when(tenths % 10 != 0, F.concat(F.lit("."), (tenths % 10).cast("string"))).otherwise(""))
    return F.when(n >= 1_000_000, F.concat(short, F.lit(" million"))).otherwise(F.format_number(n, 0))


def title_case(c: Column) -> Column:
    """Each run of non-blanks from its first word character on: that one upper case, the rest lower case."""
    word = lambda w: F.regexp_extract(w, r"^([^A-Za-z0-9_]*)(.?)(.*)$", 2)
    head = lambda w: F.regexp_extract(w, r"^([^A-Za-z0-9_]*)", 1)
    return F.array_join(F.transform(F.split(c, " "), lambda w: F.concat(head(w), F.upper(word(w)), F.lower(F.substr(w, F.length(head(w)) + F.lit(2))))), " ")


def artist_name(c: Column) -> Column:
    """Names all in lower case get capitals; others stay as they are."""
    return F.when(c == F.lower(c), F.array_join(F.transform(F.split(c, " "), lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substr(w, F.lit(2)))), " ")).otherwise(c)


# --- tables of tokens and lines ---------------------------------------------


def token_table(songs: DataFrame, text: str = "lyrics", keep: tuple[str, ...] = ("song_id", "artist", "lang")) -> DataFrame:
    """``keep..., pos, word``: each token with its place from 0."""
    return songs.select(*keep, F.posexplode(token_array(sung(F.col(text)))).alias("pos", "word"))


def word_table(songs: DataFrame, text: str = "lyrics", keep: tuple[str, ...] = ("song_id", "artist", "lang")) -> DataFrame:
    """``keep..., word, first``: each token, in order of the words; ``first`` marks one of those alike in a song.

    So the songs that have a word can be counted without a group for each song.
    """
    rows = songs.select(*keep, F.sort_array(token_array(sung(F.col(text)))).alias("_w"))
    marked = F.transform("_w", lambda x, i: F.struct(x.alias("word"), ((i == 0) | (x != F.get("_w", F.greatest(i - 1, F.lit(0))))).alias("first")))
    return rows.select(*keep, F.inline(marked))


def line_table(songs: DataFrame, text: str = "lyrics", keep: tuple[str, ...] = ("song_id", "artist")) -> DataFrame:
    """``keep..., line_no, line, norm``: lines that aren't blank and open no section, numbered from 0."""
    lines = F.filter(F.transform(F.split(F.col(text), "\n"), stripped), lambda x: (x != "") & ~x.rlike(HEADER))
    return songs.select(*keep, F.posexplode(lines).alias("line_no", "line")).withColumn("norm", norm_line(F.col("line")))


def section_table(songs: DataFrame, text: str = "lyrics", keep: tuple[str, ...] = ("song_id",)) -> DataFrame:
    """``keep..., section_no, name, kind, n_lines, lines``: sections that have lines.

    A header opens a section; lines before the first one are a section without
    name. Sections that only repeat the page's title are dropped with their
    lines.
    """
    every = songs.select(*keep, F.posexplode(F.split(F.col(text), "\n")).alias("at", "line"))
    head = F.col("line").rlike(HEADER)
    here = W.partitionBy(*keep).orderBy("at")
    rows = every.withColumn("head", head).withColumn("no", F.sum(F.col("head").cast("int")).over(here))
    names = rows.groupBy(*keep, "no").agg(
        F.max(F.when(F.col("head"), F.regexp_extract("line", r"^\s*\[([^\]]*)\]", 1))).alias("name"),
        F.transform(F.array_sort(F.collect_list(F.when(~F.col("head") & (stripped(F.col("line")) != ""), F.struct("at", "line")))), lambda x: x["line"]).alias("lines"),
    )
    title = F.lower(F.coalesce("name", F.lit("")))
    marked = F.contains(title, F.lit("tekst pesme")) | (title == "tekst") | F.contains(title, F.lit("lyrics for")) | title.endswith("lyrics")
    full = names.where((F.size("lines") > 0) & ~marked)
    place = F.row_number().over(W.partitionBy(*keep).orderBy("no")) - 1
    return full.select(*keep, place.cast("long").alias("section_no"), F.coalesce("name", F.lit("")).alias("name"), section_kind(F.coalesce("name", F.lit(""))).alias("kind"), F.size("lines").cast("long").alias("n_lines"), "lines")


# --- trigrams, for approximate names ----------------------------------------


def trigrams(key: Column) -> Column:
    padded = F.concat(F.lit("  "), key, F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substr(padded, i, F.lit(3))))


def trigram_similarity(a: Column, b: Column) -> Column:
    ta, tb = trigrams(a), trigrams(b)
    return F.size(F.array_intersect(ta, tb)) / F.size(F.array_union(ta, tb))


def edit_similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance over the longer length."""
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))
