"""Pages of strung keywords, tags and links: bagged decision trees on weak labels, smoothed by host.

Weak labels come from pages that are clear cases: nearly no words, or nearly all words, of the main region stand in
sentences.  The trees, fitted on a bounded sample of them, don't see that share, which is left to the labels: they judge
all pages, clear or not, by links, repetition, separators, ends of sentences and the like.  To a page's log odds the
share is added as weak evidence of its own; they then move towards those of the rate of such pages on its host, the more
so the more pages the host has.  A page is a case by the sum, which overturns the share where the text only looks unlike
sentences (garbled letters) or like them (keywords with full stops).
"""

from __future__ import annotations

from zlib import crc32

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from ..operators.seeding import hash_sample
from .mainbody import FEATURES

#: Rows of either weak label that the trees are fitted on, at most.
SAMPLE = 4000
#: The share of words outside sentences from which on, and up to which, a page has a weak label.
CLEAR_ROWS, CLEAR_PROSE, LEAST_WORDS = 0.6, 0.4, 12
TREES, DEPTH = 30, 7
#: A host's rate counts as so many pages more of the mean rate; the part of it that a page on a host of many pages takes.
HOST_PRIOR, HOST_PART = 10.0, 0.3
#: What the share of words outside sentences adds to the log odds, from - to +, as evidence the trees don't have.
SHARE_ODDS = 0.8
#: The features that the trees see.
SEEN = [i for i, f in enumerate(FEATURES) if f != "row_share"]


def weak_labels(judged: DataFrame) -> DataFrame:
    share, words = F.col("features")[FEATURES.index("row_share")], F.exp(F.col("features")[0]) - 1
    y = F.when(words < LEAST_WORDS, F.when(share <= CLEAR_PROSE, 0.0)).when(share >= CLEAR_ROWS, 1.0).when(share <= CLEAR_PROSE, 0.0)
    return judged.withColumn("y", y)


def score_pages(judged: DataFrame) -> DataFrame:
    """``judged`` with ``spam_score``: the probability that a page is made of rows of keywords, tags or links.

    Without clear cases of both kinds to learn from, the score is 1 or 0 by the share of words outside sentences.
    """
    judged = judged.withColumn("fv", array_to_vector(F.array(*[F.col("features")[i] for i in SEEN])))
    labelled = weak_labels(judged).where(F.col("y").isNotNull()).select("row_id", "fv", "y")
    numbers = {r["y"]: r["count"] for r in labelled.groupBy("y").count().collect()}
    picked = []
    for y in (0.0, 1.0):
        rows = hash_sample(labelled.where(F.col("y") == y), SAMPLE, numbers.get(y, 0), "row_id", "spam").collect()
        picked.append(sorted(rows, key=lambda r: crc32(str(r["row_id"]).encode()))[:SAMPLE])
    if min(map(len, picked)) < 2:
        share = F.col("features")[FEATURES.index("row_share")]
        return judged.drop("fv").withColumn("spam_score", F.when(share > 0.5, 1.0).otherwise(0.0))
    sample = judged.sparkSession.createDataFrame([(r["fv"], r["y"]) for rows in picked for r in rows], ["fv", "y"])
    model = RandomForestClassifier(featuresCol="fv", labelCol="y", numTrees=TREES, maxDepth=DEPTH, featureSubsetStrategy="all", seed=11, rawPredictionCol="raw", probabilityCol="prob", predictionCol="pred").fit(sample.coalesce(1))
    scored = model.transform(judged).withColumn("p", vector_to_array("prob")[1]).drop("fv", "raw", "prob", "pred")
    mean = F.avg("p")
    total = scored.agg(mean.alias("m")).first()["m"] or 0.0
    share = F.col("features")[FEATURES.index("row_share")]
    rate = ((F.sum("p") + HOST_PRIOR * total) / (F.count("*") + HOST_PRIOR)).alias("rate")
    hosts = scored.groupBy("host").agg(rate, (HOST_PART * F.count("*") / (F.count("*") + HOST_PRIOR)).alias("part"))
    near = lambda c: F.least(F.greatest(c, F.lit(0.01)), F.lit(0.99))
    odds = lambda c: F.log(near(c) / (1 - near(c)))
    pull = F.col("part") * (odds(F.col("rate")) - odds(F.lit(total)))
    smoothed = scored.join(hosts, "host", "left").withColumn("spam_score", 1 / (1 + F.exp(-(odds(F.col("p")) + pull + SHARE_ODDS * (2 * share - 1))))).drop("part")
    return smoothed.drop("p", "rate")


def spam_pages(judged: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(row_id, spam_score) of the pages that are cases."""
    return score_pages(judged).where(F.col("spam_score") > threshold).select("row_id", "spam_score")
