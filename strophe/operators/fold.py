"""The fold of an artist's uploads into the one row that a page is made from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strophe.operators.artist import highlight_columns, highlight_parts, mean, vocabulary
from strophe.operators.classify import song_length


def clean_rows(rows: DataFrame, *names: str) -> DataFrame:
    """Rows of a song's length whose artist isn't broken by its encoding; ``names`` lose their NUL characters.

    A name with U+FFFD, or with its bytes read as Latin letters, was broken
    before it came here: its artist stands elsewhere under the right spelling.
    """
    broken = F.contains("artist", F.lit("�")) | F.contains("artist", F.lit("ï¿½"))
    kept = rows.where(~broken & song_length(F.coalesce("title", F.lit("")), F.coalesce("wc", F.lit(0))))
    return kept.withColumns({c: F.translate(c, "\0", "") for c in names})


def record(value: str, most: bool = True, words: int = 80) -> Column:
    """The song with the largest or smallest value among those of ``words`` words or more; ties go to the smaller id."""
    v = F.col(value) if most else -F.col(value)
    return F.max(F.when(F.col(value).isNotNull() & (F.col("wc") >= words), F.struct(v.alias("v"), (-F.col("song_id")).alias("o"))))


def fold_artists(rows: DataFrame, tokens: DataFrame, least: int = 5) -> DataFrame:
    """One row for each artist of ``least`` songs or more.

    ``rows``: ``artist, song_id, title, wc, uniq, ttr, rep, hook, rhyme, q,
    excl, one_word, awl, top_line, top_line_n, longest_word, drops, wpm,
    first_s, gap_s, fast, has_synced``, one for each song that counts;
    ``tokens``: ``artist, song_id, pos, word`` of the same songs. Means skip
    what is missing. Records of pace need 80 words, those of silences and
    bursts 40. One aggregation of the rows and one of the tokens.
    """
    longest = F.max(F.struct(F.length("longest_word").alias("n"), (-F.col("song_id")).alias("o"), "longest_word"))
    line = F.max(F.when(F.col("top_line") != "", F.struct("top_line_n", (-F.col("song_id")).alias("o"), "top_line")))
    drop = F.max(F.struct("drops", (-F.col("song_id")).alias("o")))
    sums = rows.groupBy("artist").agg(
        F.count(F.lit(1)).alias("song_count"), F.sum("wc").alias("total_words"),
        *(mean(c).alias(name) for c, name in (
            ("ttr", "avg_ttr"), ("rep", "avg_repetition_ratio"), ("hook", "avg_hook_share"), ("wpm", "avg_wpm"), ("first_s", "avg_first_word_s"), ("rhyme", "avg_rhyme"), ("q", "question_share"),
            ("excl", "exclaim_share"), ("one_word", "one_word_line_share"), ("awl", "avg_word_length"),
        )),
        F.sum(F.col("has_synced").cast("int")).alias("_synced"), F.sum("drops").alias("title_drops_total"), longest.alias("_word"), line.alias("_line"), drop.alias("_drop"),
        record("wpm").alias("_fast"), record("wpm", False).alias("_slow"), record("first_s", words=40).alias("_intro"), record("gap_s", words=40).alias("_gap"), record("fast", words=40).alias("_burst"),
        *highlight_parts(),
    ).where(F.col("song_count") >= least)
    song = lambda c: -F.col(f"{c}.o")
    return sums.join(vocabulary(tokens), "artist").select(
        "artist", "song_count", "total_words", "total_unique_words", (F.rint(F.col("total_words") * 100 / F.col("song_count")) / 100).alias("avg_words_per_song"),
        "avg_ttr", "avg_repetition_ratio", "avg_hook_share", "avg_wpm", "avg_first_word_s", "avg_rhyme", "question_share", "exclaim_share", "one_word_line_share", "avg_word_length",
        (F.rint(F.col("_synced") * 1000 / F.col("song_count")) / 1000).alias("synced_share"), "title_drops_total", F.col("_word.longest_word").alias("longest_word"),
        F.col("_line.top_line").alias("career_line"), F.col("_line.top_line_n").alias("career_line_n"), F.when(F.col("_drop.drops") > 0, song("_drop")).alias("biggest_title_drop"),
        song("_fast").alias("fastest_song"), song("_slow").alias("slowest_song"), song("_intro").alias("longest_intro"), song("_gap").alias("longest_silence"), song("_burst").alias("fastest_burst"),
        "top_word", "top_word_n", *highlight_columns(),
    )
