"""Parts that the DuckDB statements share."""

from __future__ import annotations

TOKEN = r"([\p{L}\p{Nl}\p{No}]+(?:[''’][\p{L}\p{Nl}\p{No}]+)*)"
SONGS = "songs as (select doc_id song_id, source artist, lang, text lyrics, split_part(text, chr(10), 1) title from documents)"
TOKENS = SONGS + f""",
w0 as (select song_id, artist, lang, regexp_extract_all(lower(lyrics), '{TOKEN}', 1) w from songs),
tokens as (select song_id, artist, lang, unnest(w) word, unnest(range(len(w))) pos from w0)"""
LINE_PARTS = r"""
l0 as (select song_id, artist, list_filter(list_transform(string_split(lyrics, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')),
              lambda x: x <> '' and not regexp_matches(x, '^\s*\[[^\]]*\]\s*$')) l from songs),
lines as (select song_id, artist, unnest(l) line, unnest(range(len(l))) line_no from l0),
nlines as (select *, regexp_replace(lower(line), '\s+', ' ', 'g') norm from lines)"""
LINES = SONGS + "," + LINE_PARTS
TIMED = "timed as (select user_id song_id, epoch_us(ts) / 1e6 as sec, event_id % 9 + 1 words from events)"


def words_sql(words) -> str:
    """A list of words as a SQL list of strings."""
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def holds_sql(text: str, parts) -> str:
    """Whether a text holds any of the parts."""
    return " or ".join("contains({}, '{}')".format(text, p.replace("'", "''")) for p in parts)


def q(pattern: str) -> str:
    """A pattern as a SQL string."""
    return "'" + pattern.replace("'", "''") + "'"
