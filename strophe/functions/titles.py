"""The grammar of song titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strophe.functions.text import bound, stripped, unaccented
from strophe.functions.words import DESCRIPTORS, GUARDS, INTERLUDES, MEDLEYS, PSEUDO_ARTISTS, REMIX_WORDS, TALK, VERSION_WORDS


def any_word(words: tuple[str, ...]) -> str:
    return r"\b(?:" + "|".join(words) + r")\b"


#: What counts as a track or side number, a site's name, a bracket, a dash part that names a variant,
#: a clause of a title, a credit before a title (no look-around, so that both engines read them).
TRACK_NUMBER = r"^\s*(?:0\d{1,2}\s*[-._)]?\s*|\d{1,3}\s*[-._)]\s*(?:\d{1,2}\s*[-._)]?\s*)?|[A-Da-d]\d{1,2}\s*[-._)]?\s+)(\S)"
SITE = r"(?i)\s*[-–|]?\s*(?:www\.\S+|\S+\.(?:com|net|org))\s*$"
BRACKETS = r"[(\[{][^)\]}]*[)\]}]"
DASH_VARIANT = r"(?i)\s[-–—]\s[^-]*" + any_word(DESCRIPTORS) + r".*$"
LAST_VARIANT = r"\s*\b(?:" + "|".join(DESCRIPTORS) + r")\s*$"
CLAUSE = r"[(\[{][^)\]}]*(?:[)\]}]|$)"
CREDIT = r"^\s*(.+?)\s*[-:–—|]\s+(.+)$"
VERSION = r"(?i)" + any_word(VERSION_WORDS)
REMIX = r"(?i)" + any_word(REMIX_WORDS)
MEDLEY = r"(?i)" + any_word(MEDLEYS)
SKIT = r"(?i)\bskit\b"
INTERLUDE = r"(?i)" + any_word(INTERLUDES)
NOT_A_SONG = r"(?i)" + any_word(TALK) + r"|(?i)[(\[-]\s*spoken word\b"
PSEUDO = r"(?i)^(?:" + "|".join(PSEUDO_ARTISTS) + ")$"
GUARD = r"(?i)" + any_word(GUARDS)


def squashed(c: Column) -> Column:
    """Lower case without accents, anything but letters and numbers as single blanks."""
    return stripped(F.regexp_replace(unaccented(F.lower(c)), r"[^\p{L}\p{N}]+", " "))


def without_track_number(title: Column) -> Column:
    """``01. Title``, ``3 - Title`` and ``B2 Title`` as ``Title``; ``7 Rings`` stays."""
    return bound(title, lambda x: bound(F.regexp_replace(x, TRACK_NUMBER, "$1"), lambda t: F.when(F.length(t) >= 2, t).otherwise(x)))


def without_artist(title: Column, artist: Column) -> Column:
    """``Artist - Title`` and the like as ``Title``, if the part before is the artist's name."""

    def rest(x: Column) -> Column:
        return bound(F.regexp_extract(x, CREDIT, 1), lambda head: F.when((head != "") & (squashed(head) == squashed(artist)), F.regexp_extract(x, CREDIT, 2)).otherwise(x))

    return bound(title, rest)


def version_clauses(title: Column) -> Column:
    """Bracketed parts, closed or cut off, and a last part after a dash, that name a version."""

    def clauses(t: Column) -> Column:
        inner = F.filter(F.regexp_extract_all(t, F.lit(CLAUSE), F.lit(0)), lambda c: c.rlike(VERSION))
        last = lambda parts: F.when((F.size(parts) > 1) & F.element_at(parts, -1).rlike(VERSION), F.slice(parts, -1, 1)).otherwise(F.array().cast("array<string>"))
        return F.concat(inner, bound(F.split(t, r"\s[-–—]\s"), last))

    return bound(title, clauses)


def is_plain_title(title: Column) -> Column:
    """No version clause, no site's name, no medley."""
    return bound(title, lambda t: (F.size(version_clauses(t)) == 0) & ~t.rlike(SITE) & ~t.rlike(MEDLEY))


def display_title(title: Column, artist: Column | None = None) -> Column:
    """Without site, track number, artist and version clauses."""
    t = without_track_number(F.regexp_replace(title, SITE, ""))
    t = without_artist(t, artist) if artist is not None else t
    for _ in range(3):
        t = bound(t, lambda x: F.regexp_replace(stripped(F.aggregate(version_clauses(x), x, lambda a, c: F.replace(a, c, F.lit("")))), r"\s*[-–—]\s*$", ""))
    t = F.regexp_replace(F.regexp_replace(t, r"\s{2,}", " "), r"^[ \-–]+|[ \-–]+$", "")
    return bound(t, lambda x: F.when(x == "", title).otherwise(x))


def canonical_title(title: Column, artist: Column | None = None) -> Column:
    """One form for the release variants of a title.

    Without the artist's credit, brackets, a dash part that names a variant,
    and up to four trailing variant words. Titles that were nothing else keep
    their words.
    """
    t = F.translate(title, "\0", "")
    t = without_artist(t, artist) if artist is not None else t
    out = squashed(F.regexp_replace(F.regexp_replace(t, BRACKETS, " "), DASH_VARIANT, " "))
    for _ in range(4):
        out = stripped(F.regexp_replace(out, LAST_VARIANT, ""))
    plain = lambda p: F.when(p != "", p).otherwise(F.lower(stripped(title)))
    return bound(out, lambda o: F.when(o != "", o).otherwise(bound(squashed(title), plain)))


def title_key(title: Column, artist: Column | None = None) -> Column:
    """The key that a song's uploads share: canonical, without site, track number and trailing year."""
    t = without_track_number(F.regexp_replace(title, SITE, ""))
    k = canonical_title(without_artist(t, artist) if artist is not None else t)
    return bound(k, lambda x: bound(F.regexp_replace(x, r"\s+(?:19|20)\d{2}$", ""), lambda short: F.when(F.length(short) >= 3, short).otherwise(x)))


#: Words of a last part after a dash that make it no part of the title, and of a bracket that stays.
DASH_JUNK = r"(?i)remaster|edit|acoustic|live|version|mix|demo"
FEATURED = r"(?i)\b(?:feat\.?|ft\.?|featuring)\b"


def clean_title(title: Column) -> Column:
    """Without a last part after a dash that names a version, and without brackets but those that credit a guest."""

    def bare(t: Column) -> Column:
        parts = F.split(t, " - ")
        kept = F.when((F.size(parts) > 1) & F.element_at(parts, -1).rlike(DASH_JUNK), F.array_join(F.slice(parts, 1, F.size(parts) - 1), " - ")).otherwise(t)
        brackets = lambda k: F.filter(F.regexp_extract_all(k, F.lit(r"\([^)]*\)|\[[^\]]*\]"), F.lit(0)), lambda b: ~b.rlike(FEATURED))
        gone = bound(kept, lambda k: stripped(F.aggregate(brackets(k), k, lambda a, b: F.replace(a, b, F.lit("")))))
        return bound(gone, lambda g: F.when(g == "", t).otherwise(g))

    return bound(title, bare)


def guarded(title: Column) -> Column:
    """Titles whose words keep them from the junk rules."""
    return title.rlike(GUARD)


def pseudo_artist(name: Column) -> Column:
    return name.rlike(PSEUDO)
