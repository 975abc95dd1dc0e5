"""Queries of the llm subpackage for the driver's contract, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import stored, table
from .bpe import count_tokens, encode_ids
from .language import doubtful_labels, language_segments, main_languages
from .mainbody import judge_pages
from .mojibake import garbled_fields, restored_fields
from .packing import pack
from .pii import find_personal, redact_personal
from .simclusters import describe_clusters, similarity_clusters
from .spam import score_pages, spam_pages
from .vectorknn import nearest_vectors, neighbour_pairs


def p1_found(spark, d):
    judged = stored(judge_pages(table(spark, d, "records"), table(spark, d, "langrefs")))
    bodies = judged.join(stored(spam_pages(judged).select("row_id")), "row_id", "left_anti")
    return bodies.select("row_id", F.explode(F.col("lines").cast("array<bigint>")).alias("line_no"))


def p4_found(spark, d):
    judged = stored(judge_pages(table(spark, d, "records"), table(spark, d, "langrefs")))
    return spam_pages(judged).select("row_id")


def p4_scores(spark, d):
    judged = stored(judge_pages(table(spark, d, "records"), table(spark, d, "langrefs")))
    return score_pages(judged).select("row_id", "host", F.round("spam_score", 6).alias("spam_score"))


def p6_found(spark, d):
    return garbled_fields(table(spark, d, "records"))


def p6_restored(spark, d):
    return restored_fields(table(spark, d, "records"))


def p7_found(spark, d):
    # by definition only pages with a main body are cases; others change nothing for them
    return doubtful_labels(main_languages(table(spark, d, "records"), table(spark, d, "langrefs"), spam_pages, every=False))


def p7_segments(spark, d):
    return language_segments(main_languages(table(spark, d, "records"), table(spark, d, "langrefs"), spam_pages))


def p2_found(spark, d):
    return similarity_clusters(table(spark, d, "sigs")).select("cluster_id", "id")


def p2_clusters(spark, d):
    return describe_clusters(similarity_clusters(table(spark, d, "sigs")))


def p3_found(spark, d):
    return neighbour_pairs(nearest_vectors(table(spark, d, "svecs")))


def p3_neighbours(spark, d):
    return nearest_vectors(table(spark, d, "svecs"))


def p8_ids(spark, d):
    return encode_ids(table(spark, d, "documents"), "doc_id")


def p9_containers(spark, d):
    documents = table(spark, d, "documents")
    return pack(count_tokens(documents, "doc_id"), "doc_id", "n_tokens", rows=documents.count())


def p10_found(spark, d):
    return find_personal(table(spark, d, "documents"), "doc_id").select("doc_id", "pos", "kind")


def p10_redacted(spark, d):
    return redact_personal(table(spark, d, "documents"), "doc_id")


QUERIES = {"p1_found": p1_found, "p4_found": p4_found, "p4_scores": p4_scores, "p6_found": p6_found, "p6_restored": p6_restored, "p7_found": p7_found, "p7_segments": p7_segments, "p2_found": p2_found, "p2_clusters": p2_clusters, "p3_found": p3_found, "p3_neighbours": p3_neighbours, "p8_ids": p8_ids, "p9_containers": p9_containers, "p10_found": p10_found, "p10_redacted": p10_redacted}
SQL: dict[str, str] = {}
