"""Secret scan: candidates by pattern, false positives removed by a random forest.

A candidate is a long run of key characters that holds a digit.  Its features are its length, the
transitions between character classes, the share of it that words of the corpus cover, the path
or address it stands in, and the words before and after it.  A random forest learned from labelled
findings says how likely it is a secret.

Everything is columns: candidates and the text between them come from one pattern, applied once to
find and once to split; the forest is the one of Spark's machine learning package.  It is fitted on
a bounded sample of the findings.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framesift.llm.common import HOT_SHARE, bounded
from framesift.session import cut_lineage

#: Sixteen key characters or more, at least one of them a digit.
CANDIDATE = r"(?<![A-Za-z0-9_+/=\-])(?=[A-Za-z_+/=\-]{0,512}[0-9])[A-Za-z0-9_+/=\-]{16,}"
#: Characters of context kept before and after, findings to learn from at most, trees and their depth.
CONTEXT, MOST, TREES, DEPTH, SEED = 64, 20_000, 24, 6, 13
#: A word of the corpus counts for coverage from so many occurrences on, and from so many letters on.
COMMON, LETTERS = 5, 3
#: A forest's probability from which a candidate is reported as a secret.
THRESHOLD = 0.5

_WORDS_OF_KEYS = r"(?i)(?:token|secret|passw|pwd|api.?key|auth|bearer|credential|private)"
_FEATURES = ("length", "lower_digit", "digit_lower", "upper_lower", "lower_upper", "changes", "digits", "letters", "symbols",
             "distinct", "coverage", "slashes", "in_path", "in_address", "assigned", "quoted", "key_word", "odds_before", "odds_after")


def candidates(docs: DataFrame, pattern: str = CANDIDATE) -> DataFrame:
    """(row, doc_id, nth, start, candidate, before, after): every candidate of every whole text.

    ``start`` is the 0-based character position.  ``row`` tells apart rows of one doc_id.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").where(F.col("text").rlike(pattern))
    found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    split = rows.select("row", "doc_id", found.alias("c"), F.split("text", pattern, -1).alias("p"))
    some = split.select("row", "doc_id", F.posexplode(F.arrays_zip(
        F.col("c").alias("candidate"),
        F.transform(F.slice("p", F.lit(1), F.size("c")), lambda p: F.struct(F.length(p).alias("n"), F.substring(p, F.greatest(F.length(p) - CONTEXT + 1, F.lit(1)), F.lit(CONTEXT)).alias("t"))).alias("b"),
        F.transform(F.slice("p", F.lit(2), F.size("c")), lambda p: F.substring(p, 1, CONTEXT)).alias("after"))).alias("nth", "z"))
    flat = some.select("row", "doc_id", "nth", F.col("z.candidate").alias("candidate"), F.col("z.b.n").alias("gap"),
                       F.col("z.b.t").alias("before"), F.coalesce("z.after", F.lit("")).alias("after"))
    # A text's candidates are no more than its length allows, so its window is bounded by one text.
    flat = cut_lineage(flat, "candidates")
    past = Window.partitionBy("row").orderBy("nth")
    placed = flat.withColumn("start", F.sum(F.col("gap") + F.length("candidate")).over(past) - F.length("candidate"))
    return placed.select("row", "doc_id", "nth", F.col("start").cast("long").alias("start"), "candidate", "before", "after")


def common_words(docs: DataFrame, least: int = COMMON) -> DataFrame:
    """Lower-case words of letters that the whole corpus holds ``least`` times or more; counted before the shuffle."""
    words = docs.select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word")).where(F.length("word") >= LETTERS)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("word")


def coverage(found: DataFrame, words: DataFrame) -> DataFrame:
    """(row, nth, covered): letters of a candidate in runs that are words."""
    runs = found.select("row", "nth", F.explode(F.regexp_extract_all(F.lower("candidate"), F.lit(r"[a-z]{%d,}" % LETTERS), F.lit(0))).alias("word"))
    # A run is one key of many candidates at most as often as it is typed; fold equal runs of a candidate first.
    folded = runs.groupBy("row", "nth", "word").agg(F.sum(F.length("word")).alias("n"))
    return folded.join(words, "word", "left_semi").groupBy("row", "nth").agg(F.sum("n").alias("covered"))


def _neighbour(context: Column, last: bool) -> Column:
    words = F.regexp_extract_all(F.lower(context), F.lit(r"[\p{L}\p{N}_]+|[=:]"), F.lit(0))
    return F.coalesce(F.try_element_at(words, F.lit(-1 if last else 1)), F.lit(""))


def features(found: DataFrame, words: DataFrame) -> DataFrame:
    """``found`` with the plain features and the neighbouring words ``w1`` (before) and ``w2`` (after)."""
    c, before, after = F.col("candidate"), F.col("before"), F.col("after")
    n = lambda p: F.regexp_count(c, F.lit(p)).cast("double")
    met = found.join(coverage(found, words), ["row", "nth"], "left")
    tail = F.regexp_extract(before, r"(\S*)$", 1)
    is_ = lambda b: F.coalesce(b, F.lit(False)).cast("double")
    letters = n("[A-Za-z]")
    return met.select(
        "row", "doc_id", "nth", "start", "candidate",
        _neighbour(F.regexp_replace(before, r"[^\p{L}\p{N}_]*$", ""), True).alias("w1"), _neighbour(after, False).alias("w2"),
        F.length(c).cast("double").alias("length"), n("(?<=[a-z])[0-9]").alias("lower_digit"), n("(?<=[0-9])[a-z]").alias("digit_lower"),
        n("(?<=[A-Z])[a-z]").alias("upper_lower"), n("(?<=[a-z])[A-Z]").alias("lower_upper"),
        (n("(?<=[A-Za-z])[^A-Za-z]|(?<=[^A-Za-z])[A-Za-z]") / F.length(c)).alias("changes"),
        n("[0-9]").alias("digits"), letters.alias("letters"), n("[_+/=-]").alias("symbols"),
        (F.size(F.array_distinct(F.split(c, ""))) / F.length(c)).cast("double").alias("distinct"),
        (F.coalesce("covered", F.lit(0)) / F.greatest(letters, F.lit(1.0))).cast("double").alias("coverage"),
        (n("/") + F.regexp_count(tail, F.lit("/"))).cast("double").alias("slashes"),
        is_(tail.rlike(r"(?i)(?:/|\\|\.[a-z]{1,4}/|test|mock|sample|example)")).alias("in_path"), is_(tail.rlike(r"(?i)https?:|www\.|@")).alias("in_address"),
        is_(before.rlike(r"[=:]\s*[\"']?$")).alias("assigned"), is_(before.rlike(r"[\"']$") & after.rlike(r"^[\"']")).alias("quoted"),
        is_(before.rlike(_WORDS_OF_KEYS)).alias("key_word"))


def neighbour_odds(learned: DataFrame, word: str) -> DataFrame:
    """(word, odds): how much more often secrets stand next to a word; only words with a share of all findings.

    So there are at most HOT_SHARE words, whatever the corpus.
    """
    total = learned.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("y"))
    per = learned.groupBy(word).agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("y"))
    base = F.log((total.select("y").scalar() + 1) / (total.select("n").scalar() - total.select("y").scalar() + 1))
    return per.where(F.col("n") * HOT_SHARE >= total.select("n").scalar()).select(
        word, (F.log((F.col("y") + 1) / (F.col("n") - F.col("y") + 1)) - F.coalesce(base, F.lit(0.0))).alias("odds"))


def _ready(found: DataFrame, odds: dict[str, DataFrame]) -> DataFrame:
    for word, name in (("w1", "odds_before"), ("w2", "odds_after")):
        found = found.join(F.broadcast(odds[word].withColumnRenamed("odds", name)), word, "left").withColumn(name, F.coalesce(name, F.lit(0.0)))
    return VectorAssembler(inputCols=list(_FEATURES), outputCol="features").transform(found)


def weak_findings(found: DataFrame) -> DataFrame:
    """Labelled findings by rule, for corpora without hand-made ones: label 1 for a quoted value given to a key word
    (``w1``) that mixes letters and digits, else 0."""
    rule = (F.col("assigned") == 1) & (F.col("quoted") == 1) & F.col("w1").rlike(_WORDS_OF_KEYS) & (F.col("digits") > 0) & (F.col("letters") > 0)
    return found.withColumn("label", F.coalesce(rule, F.lit(False)).cast("double"))


def train(learned: DataFrame, most: int = MOST) -> tuple[RandomForestClassificationModel | None, dict[str, DataFrame]]:
    """Forest and neighbour odds from findings with features and ``label``; at most ``most``, the first by a hash.

    None where the findings hold fewer than two labels.
    """
    sample = cut_lineage(bounded(learned, F.xxhash64("doc_id", "nth", "candidate"), most, learned.count()), "findings")
    odds = {w: cut_lineage(neighbour_odds(sample, w), "odds") for w in ("w1", "w2")}
    if sample.select("label").distinct().count() < 2:
        return None, odds
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED)
    return forest.fit(_ready(sample, odds).select("features", "label")), odds


def scan(docs: DataFrame, learn_from: Column, labelled: DataFrame | None = None, most: int = MOST) -> DataFrame:
    """(doc_id, nth, start, candidate, score, secret) for every candidate of every row of ``docs``.

    Findings to learn from are the candidates of rows where ``learn_from`` (a condition on doc_id)
    holds, labelled by ``labelled`` (doc_id, start, label) where given and by ``weak_findings`` otherwise.
    Without findings of both labels the rule's own label is the score.  Null, empty and plain texts
    have no candidates; repeated rows are scanned each for itself; other columns are not read.
    """
    found = cut_lineage(features(candidates(docs), cut_lineage(common_words(docs), "words")), "features")
    ruled = weak_findings(found)
    learned = ruled.where(F.coalesce(learn_from, F.lit(False)))
    if labelled is not None:
        mine = labelled.select("doc_id", "start", F.col("label").cast("double").alias("label")).dropDuplicates(["doc_id", "start"])
        learned = learned.drop("label").join(mine, ["doc_id", "start"])
    model, odds = train(learned, most)
    if model is None:
        scored = ruled.withColumn("score", F.col("label"))
    else:
        scored = model.transform(_ready(found, odds)).withColumn("score", vector_to_array("probability")[1])
    return scored.select("doc_id", "nth", "start", "candidate", F.round("score", 9).alias("score"), (F.col("score") >= THRESHOLD).alias("secret"))
