"""Licence scan: a trained paragraph classifier, confirmed by comparison with templates.

Every paragraph (line) of a text is turned into hashed word n-grams; a multinomial logistic
regression gives the probabilities of the licence families, of other licence language and of plain
text.  A temperature fitted on part of the findings makes the probabilities honest; a paragraph whose
best family stays under a threshold is of unknown licence.  A predicted family is
confirmed when the paragraph holds enough of the words of one of the family's templates.

Everything is columns and Spark's machine learning package.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framesift.llm.common import bounded
from framesift.session import cut_lineage

#: Hashed columns, words of the longest n-gram, labelled paragraphs per class at most.
COLUMNS, LONGEST, MOST = 12288, 3, 1500
#: Plain paragraphs to learn from, as many times those of a class: they are by far the most in a corpus.
PLAIN_TIMES = 6
#: Least calibrated probability of a family, least share of a template's words for confirmation.
CERTAIN, CONFIRMED = 0.6, 0.75
PLAIN, UNKNOWN = "none", "unknown"
#: Characters of a paragraph beyond which it is cut into pieces of that length, all of which are classified.
LONG = 4000
#: Notices of the licence families, as people write them.
TEMPLATES = (
    ("apache", "licensed under the apache license version 2.0"),
    ("apache", "you may not use this file except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "released under the bsd license"),
    ("cc", "licensed under cc by 4.0"),
    ("cc", "licensed under cc by-nc 4.0"),
    ("cc", "licensed under cc by-sa 4.0"),
    ("cc", "this work is licensed under a creative commons attribution license"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it under the terms of the gnu general public license"),
    ("gpl", "licensed under the gnu lesser general public license version 2.1"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license version 2.0"),
)
#: Notices that name no family: examples of the class of other licence language.
UNNAMED = (
    "all rights reserved", "copyright by the authors", "see the license file for details", "licensed under the terms below",
    "this license does not grant permission", "distributed under its own license", "subject to the license agreement of the vendor",
    "no license is granted", "used with permission of the copyright holder",
)
#: Speaks of licences at all; sets training examples of the classes apart.
_LICENCE_WORDS = r"(?i)\b(?:licen[cs]e[ds]?|copyright|all rights reserved|redistribut\w+|spdx)\b"


def words_of(text: Column) -> Column:
    """Lower-case words: letters and digits, with dots and hyphens between them."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]++(?:[.-]++[\p{L}\p{N}]++)*+"), F.lit(0))


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, nth, text, words): the lines of every text that hold a word; very long ones in pieces."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", r"\n")).alias("nth", "line"))
    pieces = F.when(F.length("line") <= LONG, F.array("line")).otherwise(
        F.transform(F.sequence(F.lit(0), F.floor(F.length("line") / LONG)), lambda i: F.substring(F.col("line"), (i * LONG + 1).cast("int"), F.lit(LONG))))
    each = lines.select("doc_id", "nth", F.explode(pieces).alias("text"))
    return each.where(F.col("text").rlike(r"[\p{L}\p{N}]")).withColumn("words", words_of(F.col("text")))


def _vectors(rows: DataFrame) -> DataFrame:
    """``rows`` with ``features``: which hashed n-grams of words, of one to LONGEST words, occur.

    An n-gram is the hash of the two that are shorter by a word, so that no strings are put together.
    """
    own, grams = rows.columns, ["__g1"]
    rows = rows.withColumn("__g1", F.transform("words", lambda w: F.xxhash64(w)))
    for n in range(2, LONGEST + 1):
        short = F.col(grams[-1])
        rows = rows.withColumn(f"__g{n}", F.zip_with(F.slice(short, 1, F.greatest(F.size(short) - 1, F.lit(0))), F.slice(short, F.lit(2), F.greatest(F.size(short) - 1, F.lit(0))), lambda a, b: F.xxhash64(a, b)))
        grams.append(f"__g{n}")
    rows = rows.withColumn("__grams", F.concat(*grams))
    return HashingTF(numFeatures=COLUMNS, inputCol="__grams", outputCol="features", binary=True).transform(rows).select(*own, "features")


def template_share(words: Column) -> dict[str, Column]:
    """Per family the largest share of a template's distinct words that ``words`` holds."""
    families: dict[str, list[Column]] = {}
    for family, notice in TEMPLATES:
        own = sorted(set(notice.split()))
        held = F.size(F.array_intersect(words, F.array(*[F.lit(w) for w in own]))) / F.lit(float(len(own)))
        families.setdefault(family, []).append(held)
    return {f: F.greatest(*held) if len(held) > 1 else held[0] for f, held in families.items()}


@dataclass
class Classifier:
    model: LogisticRegressionModel
    classes: list[str]
    temperature: float


def speaks(rows: DataFrame) -> Column:
    """Whether a paragraph speaks of licences at all; the rule that sets examples of the classes apart."""
    return rows["text"].rlike(_LICENCE_WORDS)


def weak_labels(rows: DataFrame) -> DataFrame:
    """Label of a paragraph by rule: the family whose template it holds most of, other licence language, or plain."""
    share = template_share(F.col("words"))
    best = F.greatest(*[F.struct(s.alias("share"), F.lit(f).alias("family")) for f, s in sorted(share.items())])
    return rows.withColumn("label", F.when(~speaks(rows), F.lit(PLAIN)).when(best["share"] >= 0.85, best["family"]).otherwise(F.lit(UNKNOWN)))


def fit(spark: SparkSession, named: DataFrame, plain: DataFrame, texts: int, most: int = MOST) -> Classifier:
    """Classifier from labelled paragraphs (doc_id, nth, text, label) and from the notices.

    ``named`` are those of a family or of other licence language, ``plain`` the rest, out of about
    ``texts`` texts; at most ``most`` of each class and PLAIN_TIMES as many plain
    ones, the first by a hash.  Four fifths and the notices fit the regression; the rest fits the temperature that
    makes its log-loss least.
    """
    classes = sorted({f for f, _ in TEMPLATES} | {UNKNOWN, PLAIN})
    notices = spark.createDataFrame([(n, f) for f, n in TEMPLATES] + [(n, UNKNOWN) for n in UNNAMED], "text string, label string")
    order = F.xxhash64("doc_id", "nth", "text")
    columns = ["text", "label", (F.pmod(order, F.lit(5)) == 0).alias("calibrating"), order.alias("o")]
    known = cut_lineage(named.select(*columns), "named")
    sample = bounded(plain.select(*columns), F.col("o"), PLAIN_TIMES * most, texts)
    for c in classes:
        if c != PLAIN:
            sample = sample.unionByName(bounded(known.where(F.col("label") == c), F.col("o"), most))
    sample = sample.drop("o").unionByName(notices.withColumn("calibrating", F.lit(False)))
    sample = sample.withColumn("y", (F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("label")) - F.lit(1)).cast("double"))
    # Written first: the words and n-grams would otherwise be made below the limits, of all rows, and turn them into whole sorts.
    sample = cut_lineage(sample, "chosen").withColumn("words", words_of(F.col("text")))
    sample = cut_lineage(_vectors(sample).select("calibrating", "y", "features"), "paragraphs")
    calibrating = F.col("calibrating")
    model = LogisticRegression(featuresCol="features", labelCol="y", maxIter=40, regParam=1e-3, family="multinomial").fit(sample.where(~calibrating))
    raw = cut_lineage(model.transform(sample.where(calibrating)).select(vector_to_array("rawPrediction").alias("z"), F.col("y").cast("int").alias("y")), "calibration")
    # Every candidate temperature's log-loss in one pass; an empty calibration set keeps 1.
    grid = [0.5 * 1.25**i for i in range(14)]
    loss = lambda t: F.avg(F.log(F.aggregate("z", F.lit(0.0), lambda a, z: a + F.exp((z - F.array_max("z")) / t))) - (F.element_at("z", F.col("y") + 1) - F.array_max("z")) / t)
    losses = raw.agg(*[loss(t).alias(f"t{i}") for i, t in enumerate(grid)]).first()
    best = min(((x, grid[i]) for i, x in enumerate(losses) if x is not None), default=(0.0, 1.0))[1]
    return Classifier(model, classes, best)


def classify(rows: DataFrame, classifier: Classifier) -> DataFrame:
    """``rows`` (…, words) with family, probability, template_share and confirmed.

    ``none`` is plain text; ``unknown`` is licence language whose family is not certain.
    """
    # A generator, as filters don't move below it: a filter on the family would run the model again for every use of its result.
    scored = classifier.model.transform(_vectors(rows)).select(*rows.columns, F.explode(F.array(vector_to_array("rawPrediction"))).alias("__z"))
    top = F.array_max("__z")
    e = F.transform("__z", lambda z: F.exp((z - top) / classifier.temperature))
    names = F.array(*[F.lit(c) for c in classifier.classes])
    at = F.array_position(F.col("__z"), top).cast("int")
    scored = scored.withColumn("probability", F.lit(1.0) / F.aggregate(e, F.lit(0.0), lambda a, x: a + x)).withColumn("__class", F.element_at(names, at))
    share = template_share(F.col("words"))
    held = F.coalesce(*[F.when(F.col("__class") == f, s) for f, s in sorted(share.items())], F.lit(0.0))
    named = ~F.col("__class").isin(PLAIN, UNKNOWN)
    family = F.when(named & (F.col("probability") < CERTAIN), F.lit(UNKNOWN)).otherwise(F.col("__class"))
    return scored.withColumns({"family": family, "template_share": F.when(named, held).otherwise(F.lit(0.0))}).withColumn(
        "confirmed", named & (F.col("probability") >= CERTAIN) & (F.col("template_share") >= CONFIRMED)).drop("__z", "__class")


def scan(docs: DataFrame, learn_from: Column, labelled: DataFrame | None = None, most: int = MOST) -> DataFrame:
    """(doc_id, nth, paragraph, family, probability, template_share, confirmed): paragraphs that are not plain text.

    All paragraphs of all rows are classified.  Paragraphs of rows where ``learn_from`` holds are
    learned from, with labels from ``labelled`` (doc_id, nth, label) where given and by
    ``weak_labels`` otherwise.  Null and empty texts have no paragraphs; repeated rows are scanned
    each for itself; a null doc_id stays null; other columns are not read.
    """
    every = paragraphs(docs)
    own = every.where(F.coalesce(learn_from, F.lit(False)))
    if labelled is None:
        named = weak_labels(own.where(speaks(own)))
        plain = own.where(~speaks(own)).withColumn("label", F.lit(PLAIN))
    else:
        known = own.join(labelled.select("doc_id", "nth", "label").dropDuplicates(["doc_id", "nth"]), ["doc_id", "nth"])
        named, plain = known.where(F.col("label") != PLAIN), known.where(F.col("label") == PLAIN)
    classifier = fit(docs.sparkSession, named, plain, docs.count(), most)
    found = classify(every, classifier).where(F.col("family") != PLAIN)
    return found.select("doc_id", "nth", F.col("text").alias("paragraph"), "family", F.round("probability", 6).alias("probability"), F.round("template_share", 6).alias("template_share"), "confirmed")
