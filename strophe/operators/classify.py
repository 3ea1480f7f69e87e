"""Classification of titles, songs, words and languages."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strophe.functions.text import bound, token_array
from strophe.functions.titles import guarded
from strophe.functions.words import EN_SPELLINGS, ENGLISH, INTERJECTIONS, JUNK_ALL_THE_SAME, JUNK_EXCEPTIONS, JUNK_PARTS, NO_ARTIST_PAGES, NO_SONG_TITLES, NOT_SONGS, STOPWORDS, SYLLABLES

JUNK = "(?i)" + "|".join(JUNK_PARTS)
WEAK_JUNK = "(?iU)" + "|".join(NO_SONG_TITLES)


def english_share(words: Column) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(*ENGLISH))) / F.greatest(F.size(words), F.lit(1))


def song_length(title: Column, wc: Column, least: int = 60, most: int = 2000) -> Column:
    """Whether a text has a song's length; guard words in the title keep it."""
    return guarded(title) | ~((wc > 0) & (wc < least) | (wc > most))


def holds_any(low: Column, parts: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(low, F.lit(p))
    return out


def non_song_reason(title: Column, wc: Column, ttr: Column, words: Column) -> Column:
    """The first rule that makes a text no song; null for songs.

    Order: guard words keep; too short; too long; words of other kinds of page
    in the title; junk pattern unless excepted; English of very high variety.
    """
    low = F.lower(title)
    spared = holds_any(low, JUNK_EXCEPTIONS) & ~holds_any(low, JUNK_ALL_THE_SAME)
    return (
        F.when(guarded(title), F.lit(None).cast("string"))
        .when((wc > 0) & (wc < 60), "short").when(wc > 2000, "long").when(holds_any(low, NOT_SONGS), "title")
        .when(low.rlike(JUNK) & ~spared, "pattern")
        .when((ttr > 0.65) & (english_share(words) > 0.1), "variety")
    )


def junk_artist(name: Column, parts: tuple[str, ...] = NO_ARTIST_PAGES) -> Column:
    """Names that stand for no artist."""
    low = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    return (low == "") | (low == "nan") | holds_any(low, parts)


#: Scripts and the ranges of their letters, in the order in which they are tried.
SCRIPTS = (
    ("cjk", r"[\x{3040}-\x{30FF}\x{3400}-\x{9FFF}\x{AC00}-\x{D7AF}]"), ("ar", r"[\x{0600}-\x{06FF}]"), ("he", r"[\x{0590}-\x{05FF}]"), ("el", r"[\x{0370}-\x{03FF}]"),
    ("th", r"[\x{0E00}-\x{0E7F}]"), ("hi", r"[\x{0900}-\x{097F}]"), ("cy", r"[\x{0400}-\x{04FF}]"),
)


def language_by_words(tokens: DataFrame, key: str = "song_id", lists: dict[str, tuple[str, ...]] | None = None, hits: int = 4, k: int | None = None) -> DataFrame:
    """``key, guess``: the language that a text's words tell, else ``xx``.

    A script that half of the distinct words are written in decides, but for
    Cyrillic, whose languages the lists tell apart. Otherwise the list with
    most hits, more than ``hits``; of equals the first. ``k``: only the most
    used words count. Runs as conditional counts, no join.
    """
    lists = lists or STOPWORDS
    words = tokens.groupBy(key, "word").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("f"))
    if k:
        words = words.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(F.desc("n"), "f"))).where(F.col("_r") <= k)
    marks = [F.count_if(F.col("word").rlike(rx)).alias(f"_s_{tag}") for tag, rx in SCRIPTS]
    split = [F.count_if(F.col("word").rlike(r"[\x{AC00}-\x{D7AF}]")).alias("_ko"), F.count_if(F.col("word").rlike(r"[\x{3040}-\x{30FF}]")).alias("_ja")]
    counts = words.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), *marks, *split, *(F.count_if(F.col("word").isin(*ws)).alias(f"_{lang}") for lang, ws in lists.items()))
    best = F.greatest(*(F.struct(F.col(f"_{lang}").alias("n"), F.lit(-i).alias("o"), F.lit(lang).alias("l")) for i, lang in enumerate(lists)))
    guess = F.when(best["n"] > hits, best["l"]).otherwise("xx")
    for tag, _ in reversed(SCRIPTS):
        if tag != "cy":  # the first script that half of the words are in decides; Cyrillic comes last
            guess = F.when(2 * F.col(f"_s_{tag}") >= F.col("_n"), tag).otherwise(guess)
    return counts.select(key, guess.alias("guess"), F.col("_n").alias("words"), "_ko", "_ja")


def song_language(tokens: DataFrame, key: str = "song_id", lists: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """``key, lang``: the language of a song by its 30 most used words; null for under ten words or no answer.

    Korean, Japanese and Chinese are told apart by their letters.
    """
    rows = language_by_words(tokens, key, lists, k=30)
    east = F.when(F.col("_ko") >= F.greatest("_ja", F.lit(1)), "ko").when(F.col("_ja") > 0, "ja").otherwise("zh")
    lang = F.when(F.col("guess") == "cjk", east).when(F.col("guess") != "xx", F.col("guess"))
    return rows.select(key, F.when(F.col("words") >= 10, lang).alias("lang"))


def language_sample(text: Column) -> Column:
    """What a language detector reads: the first 30 lines, 1,500 characters at most, as one line; null under 40 characters."""
    joined = F.left(F.array_join(F.slice(F.split(text, "\n"), 1, 30), " "), F.lit(1500))
    return F.when(F.length(joined) >= 40, joined)


def detected_language(texts: DataFrame, detect, text: str = "lyrics", least: float = 0.45) -> DataFrame:
    """``texts`` with ``detected``: what a detector says of the sample, if it is sure enough.

    ``detect`` takes a column of samples and gives a struct ``lang, p``; any
    model can stand behind it as a pandas UDF. ``share_detector`` is a plain one.
    """
    said = texts.withColumn("_d", detect(language_sample(F.col(text))))
    return said.withColumn("detected", F.when(F.col("_d.p") >= least, F.col("_d.lang"))).drop("_d")


def share_detector(lists: dict[str, tuple[str, ...]]):
    """A detector by word lists: the language whose words are most of those that any list has."""

    def detect(sample: Column) -> Column:
        words = token_array(sample)
        hits = lambda ws: F.size(F.filter(words, lambda w: w.isin(*ws)))
        n = [hits(ws) for ws in lists.values()]
        best = F.greatest(*(F.struct(c.alias("n"), F.lit(-i).alias("o"), F.lit(lang).alias("lang")) for i, (lang, c) in enumerate(zip(lists, n, strict=True))))
        total = sum(n[1:], n[0])
        return bound(F.struct(best.alias("b"), total.alias("t")), lambda x: F.struct(x["b"]["lang"].alias("lang"), F.when(x["t"] > 0, x["b"]["n"] / x["t"]).otherwise(0.0).alias("p")))

    return detect


#: Words made of syllables, stretched vowels and sung vocables; Latin words without a vowel.
SUNG = r"^(?:[aeiouy]+h*|(?:" + "|".join(SYLLABLES) + r")+h?)$"
VOCABLE = r"^(?:(?:wh?|h|d)o{2,}h*|(?:wh|h)e{2,}h*|(?:he){2,}h?)+$"
NO_VOWEL = r"^[\x00-\x7F&&[^aeiouy]]+$"


def adlib(word: Column) -> Column:
    """Vocables and interjections, stretched letters, few letters, consonants alone."""
    letters = F.size(F.array_distinct(F.split(word, "")))
    vocable = word.rlike(VOCABLE) & (word != "hoodoo")
    return word.rlike(SUNG) | vocable | word.isin(*INTERJECTIONS) | ((F.length(word) >= 4) & (letters <= 2)) | word.rlike(NO_VOWEL)


def filler(word: Column, grammar: tuple[str, ...] = ()) -> Column:
    """Words that carry no meaning on their own: short ones, grammar, vocables."""
    low = F.replace(F.lower(word), F.lit("’"), F.lit("'"))
    listed = low.isin(*grammar) if grammar else F.lit(False)
    return (F.length(low) < 3) | listed | adlib(low)


def grammar_word(word: Column, grammar: tuple[str, ...], generic: tuple[str, ...]) -> Column:
    """Fillers but for the generic words, which word tables keep."""
    return filler(word, grammar) & ~F.replace(F.lower(word), F.lit("’"), F.lit("'")).isin(*generic)


def function_words(df: DataFrame, lang_df: DataFrame, listed: tuple[str, ...], share: float = 0.5, languages: tuple[str, ...] = ()) -> DataFrame:
    """``lang, word, is_function``: listed words, English spellings in English, or words that most artists of a language without a list use."""
    common = F.coalesce("share", F.lit(0.0)) >= share
    own = ~F.col("lang").isin(*languages) if languages else F.lit(True)
    is_function = F.col("word").isin(*listed) | ((F.col("lang") == "en") & F.col("word").isin(*EN_SPELLINGS)) | (own & common)
    return df.join(lang_df.select("lang", "word", "share"), ["lang", "word"], "left").select("lang", "word", is_function.alias("is_function"))


def foreign_words(lang_df: DataFrame, most: float = 0.02, mine: float = 0.003) -> DataFrame:
    """``lang, word``: words at home in another language (its share is larger, at least ``most``, and mine is tiny)."""
    rows = lang_df.withColumn("best", F.max("share").over(W.partitionBy("word")))
    return rows.where((F.col("best") > F.col("share")) & (F.col("best") >= most) & (F.col("share") < mine)).select("lang", "word")


# --- a title classifier --------------------------------------------------------


def weak_label(title: Column) -> Column:
    """0 for titles of pages that are no songs, 1 for the rest, null where a guard word speaks against the pattern or under two characters."""
    t = F.trim(title)
    junk = t.rlike(WEAK_JUNK)
    return F.when(F.length(t) < 2, None).when(junk & ~guarded(t), 0.0).when(junk, None).otherwise(1.0)


def balanced_labels(titles: DataFrame, key: str, times: int = 10, seed: int = 1) -> DataFrame:
    """The labelled titles, of the songs at most ``times`` as many as there are other pages, in the order of a seeded hash (a sampling operator)."""
    songs = titles.where("label = 1.0")
    other = titles.where("label = 0.0")
    most = other.agg((F.count(F.lit(1)) * times).alias("_most"))
    ranked = songs.withColumn("_h", F.xxhash64(F.lit(seed), key))
    # the cut is a hash value, found by counting, so that no task sorts all songs
    kept = ranked.join(F.broadcast(most)).join(F.broadcast(songs.agg(F.count(F.lit(1)).alias("_all"))))
    share = F.col("_most") / F.greatest(F.col("_all"), F.lit(1))
    return kept.where(F.pmod("_h", F.lit(1_000_000)) < share * 1_000_000).drop("_h", "_most", "_all").unionByName(other)


def train_titles(titles: DataFrame, label: str = "label") -> PipelineModel:
    """Logistic regression on hashed words of titles (``title`` and a label: 1 for songs)."""
    steps = [RegexTokenizer(inputCol="title", outputCol="_w", pattern=r"[^\p{L}\p{N}]+"), HashingTF(inputCol="_w", outputCol="_f", numFeatures=1 << 14), LogisticRegression(featuresCol="_f", labelCol=label, maxIter=20, regParam=0.001)]
    return Pipeline(stages=steps).fit(titles.where(F.col(label).isNotNull()))


def junk_titles(titles: DataFrame, model: PipelineModel, threshold: float = 0.9) -> DataFrame:
    """Adds ``p_junk`` (of no song) and ``is_junk``; guard words override the model."""
    scored = model.transform(titles).withColumn("p_junk", F.get(vector_to_array("probability"), 0))
    return scored.withColumn("is_junk", (F.col("p_junk") >= threshold) & ~guarded(F.col("title"))).drop("_w", "_f", "rawPrediction", "probability", "prediction")


def confusion(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    return rows.groupBy(truth, guess).agg(F.count(F.lit(1)).alias("n"))
