"""Secret scan with a random forest against false positives (DataFrame and SQL functions only).

Candidates are long runs of key-like characters in whole texts, and shorter
values of any signs where the words before announce a secret. Each gets
features of its length, character transitions, dictionary coverage, path and
neighbouring words, and a random forest trained on labelled findings decides
which are secrets. The trees are turned into one SQL expression, so scoring
stays in generated code.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strophe.llm.findings import LINES

#: A candidate inside a word, and words that announce a secret or a mere digest.
CANDIDATE = r"[A-Za-z0-9+/=_\-]{16,}"
ANNOUNCES = r"(?i)token|secret|passw|pwd|api[_-]?key|auth|credential|bearer|private"
#: A shorter candidate: eight signs or more after a word that announces it, in an assignment or said in prose; and what of a word is its value.
SHORT = r"(?i)(?:token|secret|passw|pwd|api[_-]?key|auth|credential|bearer|private)\w*[\"'`]?(?:\s*(?:[=:]+|=>)|\s+is|)\s*[\"'`(]*[^\s\"'`=:()]{8,}\S*$"
VALUE = r"^(?:\S*[=:(])?[\"'`(]*([^\s\"'`=:()]{8,}?)[\"'`,;.)#&]*(?:[\"'`,;)#&]\S*)?$"
DIGESTS = r"(?i)commit|sha\d*|md5|checksum|digest|hash|uuid|rev"
#: The dictionary for coverage (words and endings common in identifiers and prose).
DICTIONARY = (
    "about", "access", "after", "also", "build", "class", "client", "code", "content", "data", "date", "default", "document", "error", "example", "field", "file", "from",
    "function", "group", "have", "image", "index", "info", "item", "lich", "list", "local", "mail", "ment", "message", "name", "node", "number", "object", "page", "path",
    "schein", "server", "size", "source", "style", "system", "table", "test", "text", "that", "their", "there", "thing", "time", "tion", "title", "type", "user", "value",
    "version", "which", "with", "word", "your", "ung", "ing", "the", "and", "ent", "con", "der", "que", "ver", "ion",
)
FEATURES = ("length", "digits", "capitals", "transitions", "distinct", "longest_run", "covered", "vowels", "hexadecimal", "slashes", "url", "mail", "assigned", "quoted", "announced", "digest")


def features(value: Column, word: Column, before: Column, source: Column) -> dict[str, Column]:
    """Feature columns of a candidate: the run, the word it stands in, the two words before, the source's path."""
    n = F.length(value).cast("double")
    share = lambda pattern: F.regexp_count(value, F.lit(pattern)) / n
    low = F.lower(value)
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    context = F.concat_ws(" ", before, word)
    return {
        "length": n,
        "digits": share(r"[0-9]"),
        "capitals": share(r"[A-Z]"),
        "transitions": share(r"(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])|(?<=[^A-Za-z0-9])(?=[A-Za-z0-9])"),
        "distinct": F.size(F.array_distinct(F.split(value, ""))) / F.least(n, F.lit(64.0)),
        "longest_run": F.coalesce(F.array_max(F.transform(F.regexp_extract_all(value, F.lit(r"[A-Za-z]+"), F.lit(0)), F.length)), F.lit(0)) / n,
        "covered": 1 - F.length(F.regexp_replace(low, "|".join(map(re.escape, sorted(DICTIONARY, key=lambda w: (-len(w), w)))), "")) / n,
        "vowels": F.regexp_count(low, F.lit(r"[aeiou]")) / n,
        "hexadecimal": flag(low.rlike(r"^[0-9a-f]+$") & value.rlike(r"[a-fA-F]")),
        "slashes": share(r"/"),
        "url": flag(word.rlike(r"://|\.(?:com|org|net|html?|js|py|css)\b") | F.coalesce(source, F.lit("")).rlike(r"(?i)(?:^|/)(?:test|fixture|mock|example)s?(?:/|$)")),
        "mail": flag(word.contains("@")),
        "assigned": flag(context.rlike(r"[=:]\s*[\"']?[A-Za-z0-9+/=_\-]*$|[=:]\s*[\"'][A-Za-z0-9+/=_\-]+[\"']")),
        "quoted": flag(word.rlike(r"[\"'`]")),
        "announced": flag(context.rlike(ANNOUNCES)),
        "digest": flag(before.rlike(DIGESTS)),
    }


def labelled_findings(spark: SparkSession, n: int = 6000) -> DataFrame:
    """``value, word, before, source, secret``: made-up findings to train on, the same on every run.

    A third each are keys in an assignment, keys that other words announce, and
    look-alikes: digests, long numbers, addresses, paths, words run together,
    placeholders. Give a table of real findings instead where there is one.
    """
    h = lambda salt: F.sha2(F.concat(F.col("id").cast("string"), F.lit(salt)), 512)
    pick = lambda salt, *values: F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(values))) + 1).cast("int"))
    mixed = F.translate(F.base64(F.unhex(h("b"))), "/+=", "xQz")
    size = (F.pmod(F.xxhash64("id", F.lit("n")), F.lit(33)) + 16).cast("int")
    key = F.when(F.col("id") % 3 == 0, F.left(h("k"), F.when(F.col("id") % 2 == 0, 40).otherwise(size))).when(F.col("id") % 3 == 1, F.left(mixed, size)).otherwise(F.concat(pick("p", "AKIA", "ghp_", "sk_live_", "xoxb-", "SG"), F.left(mixed, size)))
    words = F.concat(*(pick(f"w{i}", "then", "lich", "queue", "tion", "stern", "mente", "thing", "eaux", "and", "ber", "ing", "osa", "content", "user", "ver", "the") for i in range(6)))
    number = F.left(F.regexp_replace(F.conv(F.left(h("d"), F.lit(15)), 16, 10), "^", "4"), F.lit(16))
    look = F.pmod(F.xxhash64("id", F.lit("f")), F.lit(8))
    value = F.when(look == 0, F.left(h("s"), F.lit(40))).when(look == 1, F.rpad(number, 16, "7")).when(look == 2, words).when(look == 3, F.concat(words, F.lit("/"), words)).when(look == 4, F.upper(words)).when(look == 5, F.concat_ws("_", pick("a", "your", "my", "the"), pick("b", "secret", "api", "access"), pick("c", "key", "token"), F.lit("here"))).when(look == 6, F.repeat(pick("x", "x", "0", "a", "-", "="), size)).otherwise(F.concat_ws("-", words, F.lit("2020"), words))
    plain = pick("q", "the", "und", "de", "with", "la", "from", "is of", "this and")
    name = pick("e", "token", "api_key", "secret", "password", "auth_token", "client_secret", "access_token", "bearer")
    rows = spark.range(n)
    real = rows.where("id % 3 <> 2").select("id", key.alias("value"), (F.col("id") % 2 == 0).alias("inline"))
    real = real.select("value", F.when(F.col("inline"), F.concat(name, F.lit("="), "value")).otherwise(F.concat(F.lit('"'), "value", F.lit('"'), pick("z", "", ";", ",", "###", "."))).alias("word"), F.when(F.col("inline"), plain).otherwise(F.concat(name, F.lit(" "), pick("o", "=", ":", "is"))).alias("before"), F.lit("src").alias("source"), F.lit(1.0).alias("secret"))
    false = rows.where("id % 3 = 2").select("id", value.alias("value"), look.alias("look"))
    false = false.select(
        "value",
        F.when((F.col("look") == 2) & (F.col("id") % 2 == 0), F.concat("value", F.lit("@mail.example.com"))).when(F.col("look") == 3, F.concat(F.lit("https://www.example.com/"), "value")).when(F.col("look") == 5, F.concat(F.lit('"'), "value", F.lit('"'))).otherwise(F.concat("value", pick("y", "", ".", ",", "!!"))).alias("word"),
        F.when(F.col("look") == 0, F.concat(pick("g", "commit", "sha1", "checksum", "digest of", "md5"), F.lit(" "), plain)).when(F.col("look").isin(5, 6), F.concat(name, F.lit(" ="))).otherwise(plain).alias("before"), F.lit("src").alias("source"), F.lit(0.0).alias("secret"),
    )
    return real.union(false)


def train(findings: DataFrame, trees: int = 24, depth: int = 7, sample: int = 20_000) -> RandomForestClassificationModel:
    """A forest on at most ``sample`` labelled findings (a documented bound, in hash order)."""
    one = findings.where("value is not null and value <> '' and secret is not null").withColumn("o", F.xxhash64("value", "word", "before", "secret")).orderBy("o").limit(sample)
    rows = one.select("secret", *(c.cast("double").alias(k) for k, c in features(F.col("value"), F.col("word"), F.coalesce("before", F.lit("")), F.col("source")).items()))
    table = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows).select("features", F.col("secret").cast("double").alias("label")).repartition(4).cache()
    try:
        return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=11, subsamplingRate=0.8).fit(table)
    finally:
        table.unpersist()


NODE = re.compile(r"^\s*(If|Else) \(feature (\d+) (<=|>) ([^)]+)\)$|^\s*Predict: (\S+)$")


def forest_expression(model: RandomForestClassificationModel) -> Column:
    """Share of the trees that vote for a secret, as nested ``case`` expressions.

    Read from the model's own listing of its trees; the vote of a tree is the
    class in its leaf.
    """
    lines = [m for m in map(NODE.match, model.toDebugString.splitlines()) if m]
    at = 0

    def tree() -> str:
        nonlocal at
        m = lines[at]
        at += 1
        if m[5] is not None:
            return f"{float(m[5])!r}D"
        yes = tree()
        at += 1  # the matching Else
        no = tree()
        return f"if({FEATURES[int(m[2])]} {m[3]} {float(m[4])!r}D, {yes}, {no})"

    votes = []
    while at < len(lines):
        votes.append(tree())
    return F.expr("(" + " + ".join(votes) + f") / {len(votes)}.0D")


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str | None = "source") -> DataFrame:
    """``doc_id, source, word_no, part, word, before, value``: each run of key-like signs, and each shorter value that the words before it announce."""
    source = F.col(source_col) if source_col else F.lit(None).cast("string")
    text = F.col(text_col)
    some = docs.where(text.rlike(CANDIDATE) | text.rlike(ANNOUNCES)).select(F.col(id_col).alias("doc_id"), source.alias("source"), F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("words"))

    def hit(word: Column, i: Column) -> Column:
        before = F.concat_ws(" ", F.get(F.col("words"), i - 2), F.get(F.col("words"), i - 1))
        long = word.rlike(CANDIDATE)
        short = ~long & (F.length(word) >= 8) & F.concat_ws(" ", before, word).rlike(SHORT) & (F.regexp_extract(word, VALUE, 1) != "")
        return F.when(long | short, F.struct(i.cast("long").alias("word_no"), word.alias("word"), before.alias("before"), long.alias("long")))

    found = some.select("doc_id", "source", F.explode(F.filter(F.transform("words", hit), lambda x: x.isNotNull())).alias("c")).select("doc_id", "source", "c.*")
    runs = F.when(F.col("long"), F.regexp_extract_all("word", F.lit(CANDIDATE), F.lit(0))).otherwise(F.array(F.regexp_extract("word", VALUE, 1)))
    found = found.select("doc_id", "source", "word_no", "word", "before", F.posexplode(runs).alias("part", "run"))
    # signs that belong to an assignment are not part of the value
    return found.select("doc_id", "source", "word_no", "word", "before", F.col("part").cast("long").alias("part"), F.regexp_replace("run", r"^[A-Za-z_-]*=(?=.{16})|^[=\-/]+(?=[^=\-/])", "").alias("value"))


def reviewed_findings(spark: SparkSession, held_out: bool) -> DataFrame:
    """``value, word, before, source, secret`` of the hand-labelled lines (``findings``): those held out, or those to train on."""
    rows = [(k, t, s, v) for k, (t, s, v) in enumerate(LINES) if (k % 2 == 1) == held_out]
    lines = spark.createDataFrame(rows, "doc_id long, text string, source string, answer string")
    found = candidates(lines).join(lines.select("doc_id", "answer"), "doc_id")
    return found.select("value", "word", "before", "source", F.coalesce(F.col("value") == F.col("answer"), F.lit(False)).cast("double").alias("secret"))


def training_findings(spark: SparkSession) -> DataFrame:
    """The reviewed findings to train on, each as often as makes them a third of the whole, and the made-up ones."""
    own = reviewed_findings(spark, False).withColumn("again", F.explode(F.sequence(F.lit(1), F.lit(40)))).drop("again")
    return labelled_findings(spark).union(own)


def scan(docs: DataFrame, findings: DataFrame | None = None, model: RandomForestClassificationModel | None = None, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", source_col: str | None = "source") -> DataFrame:
    """``doc_id, word_no, part, length, secret_sha256, votes, is_secret`` for each candidate.

    ``word_no`` counts the text's words from 0 and ``part`` the candidates in
    the word; the value itself is not returned, only its digest. Null and empty
    texts have no candidates; a null source counts as empty. Repeated rows are
    scanned as often as they stand. Without ``findings`` or a ``model`` the
    forest learns from ``training_findings``.
    """
    spark = docs.sparkSession
    model = model or train(training_findings(spark) if findings is None else findings)
    found = candidates(docs, id_col, text_col, source_col)
    rows = found.withColumns(features(F.col("value"), F.col("word"), F.col("before"), F.col("source")))
    rows = rows.withColumn("votes", F.round(forest_expression(model), 6))
    return rows.select("doc_id", "word_no", "part", F.length("value").cast("long").alias("length"), F.sha2("value", 256).alias("secret_sha256"), "votes", (F.col("votes") > threshold).alias("is_secret"))
