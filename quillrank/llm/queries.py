"""The pN_ queries: each operator over its whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.llm import capping, fusion, leaks, lookalike, neardup, products, spans, tokens, topn
from quillrank.runtime import table

Query = Callable[[SparkSession, str], DataFrame]
SCORES = ["normalized_mf", "normalized_graph", "normalized_aspect"]


LISTING = ("item_id", "title", "features_json", "details_json", "brand")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Catalogue listings that are one product."""
    return products.same_products(table(spark, folder, "item_metadata"), *LISTING).selectExpr("key_a AS item_id_a", "key_b AS item_id_b")


def p1_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Each identified listing with its product."""
    return products.product_groups(table(spark, folder, "item_metadata"), *LISTING).selectExpr("key AS item_id", "product_id", "listings")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Evidence beyond five records per author."""
    dropped = capping.verdicts(table(spark, folder, "t4_2_evidence"), "author_id", "confidence", "evidence_id", cap=5, only=False)
    return dropped.selectExpr("record AS evidence_id")


def p2_capped(spark: SparkSession, folder: str) -> DataFrame:
    """The evidence that stays, with no author above a thousandth of all records."""
    kept = capping.capped(table(spark, folder, "t4_2_evidence"), "author_id", "confidence", "evidence_id", cap=None, share=0.001)
    return kept.select("evidence_id", "author_id", "confidence")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Reviews of one item, and catalogue titles, that look the same but differ in characters."""
    texts = lookalike.equal_looking(table(spark, folder, "review_texts"), "review_id", "text", ["item_id"])
    titles = lookalike.equal_looking(table(spark, folder, "item_metadata"), "item_id", "title", [])
    return texts.select(F.lit("review_texts").alias("table_name"), "key_a", "key_b").unionByName(titles.select(F.lit("item_metadata").alias("table_name"), "key_a", "key_b"))


def p3_unified(spark: SparkSession, folder: str) -> DataFrame:
    """The one form of every title and every review text."""
    parts = []
    for name, key, column in (("item_metadata", "item_id", "title"), ("review_texts", "review_id", "text")):
        rows = table(spark, folder, name).select(F.col(key).alias("key"), F.col(column).alias("text"), "_metadata")
        parts.append(lookalike.unified(lookalike.once_each(rows, "key", "text"), "text", "form").select(F.lit(name).alias("table_name"), "key", "form"))
    return parts[0].unionByName(parts[1])


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """The five best items of each user by the sum of their standings in the three scores."""
    return fusion.fused(table(spark, folder, "hybrid_scores"), "user_id", "item_id", SCORES, top=5, by="standing").select("user_id", "item_id")


def p4_reciprocal(spark: SparkSession, folder: str) -> DataFrame:
    """The whole ranking of each user's items by reciprocal rank fusion."""
    return fusion.fused(table(spark, folder, "hybrid_scores"), "user_id", "item_id", SCORES)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best distinct items of each user."""
    best = topn.best_of_arrays(table(spark, folder, "topk_recommendations"), "user_id", "item_ids", "scores", 10)
    return best.selectExpr("user_id", "item AS item_id")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Reviews of one item with at least 36 words whose runs of three words agree to 0.55 or more."""
    pairs = neardup.similar_pairs(table(spark, folder, "review_texts"), "review_id", "item_id", "text", run=3, least_words=36, least=0.55)
    return pairs.selectExpr("key_a AS review_id_a", "key_b AS review_id_b")


def p6_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Each review's class of equal texts and its number of near-duplicates, by runs of five words and 0.8."""
    found = neardup.classes_with_links(table(spark, folder, "review_texts"), "review_id", "item_id", "text", run=5, least_words=5, least=0.8)
    return found.selectExpr("key AS review_id", "class_id", "copies", "n_links")


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The token ids of every document."""
    return tokens.encoded(table(spark, folder, "documents").select("doc_id", "text"), "text").select("doc_id", "ids")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold 13 consecutive words, or all words, of a held-out unit."""
    found = leaks.leaked(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "eval_units"), "unit_id", "text", 13)
    return found.selectExpr("doc AS doc_id", "unit AS unit_id")


def p9_clean(spark: SparkSession, folder: str) -> DataFrame:
    """The documents that stay once those with held-out passages are removed."""
    return leaks.without_leaks(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "eval_units"), "unit_id", "text", 13).select("doc_id")


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that share 300 characters in a row."""
    return spans.sharing_pairs(table(spark, folder, "documents"), "doc_id", "text", 300).selectExpr("key_a AS doc_id_a", "key_b AS doc_id_b")


def p10_shared(spark: SparkSession, folder: str) -> DataFrame:
    """How many characters of each document other documents hold too, in passages of at least 300."""
    return spans.shared_lengths(table(spark, folder, "documents"), "doc_id", "text", 300).selectExpr("key AS doc_id", "n_chars", "shared_chars")


def p10_passages(spark: SparkSession, folder: str) -> DataFrame:
    """Where the passages of at least 300 characters lie that other documents hold too."""
    return spans.shared_passages(table(spark, folder, "documents"), "doc_id", "text", 300).selectExpr("key AS doc_id", "begin", "end")


def p9_places(spark: SparkSession, folder: str) -> DataFrame:
    """How long the longest passage of each leaked unit is, and at which words it begins in document and unit."""
    found = leaks.leaked(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "eval_units"), "unit_id", "text", 13)
    return found.selectExpr("doc AS doc_id", "unit AS unit_id", "words", "doc_at", "unit_at")


QUERIES: dict[str, Query] = {
    q.__name__: q
    for q in (
        *(p1_found, p1_groups, p2_found, p2_capped, p3_found, p3_unified, p4_found, p4_reciprocal, p5_found),
        *(p6_found, p6_classes, p8_ids, p9_found, p9_places, p9_clean, p10_found, p10_shared, p10_passages),
    )
}
