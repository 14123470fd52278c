"""Queries over explanations of recommendations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.operators import evidence, explain, ranking
from quillrank.plans.catalogue import Said, _claims, query
from quillrank.runtime import table, written

FIRST = 10
ASPECT_WEIGHT = 0.25


def _number(c) -> object:
    return F.coalesce(F.when(~F.isnan(c), c), F.lit(0.0))


def _ranked(spark: SparkSession, folder: str) -> DataFrame:
    """The first eleven items of each user by the stored total, with what the explanations need of them."""
    rows = table(spark, folder, "hybrid_scores").where("user_id is not null and item_id is not null").groupBy("user_id", "item_id")
    one = rows.agg(F.round(_number(F.max("total_score")), 9).alias("score"), _number(F.max("aspect_contribution")).alias("aspect"), F.coalesce(F.max("history_count"), F.lit(0)).alias("history_count"))
    ranked = ranking.top_k(one, FIRST + 1)
    return written(ranked.join(one.select("user_id", "item_id", (F.col("aspect") != 0).alias("aspect_in_score"), "history_count"), ["user_id", "item_id"]), "recommended")


class Explained:
    def __init__(self, spark: SparkSession, folder: str, claims: int = 2) -> None:
        self.said = Said(spark, folder)
        self.ranked = _ranked(spark, folder)
        self.recs = self.ranked.where(F.col("rank") <= FIRST)
        self.passages, self.claim = _claims(self.said)
        self.weights = written(evidence.user_weights(self.said.obs, self.said.cutoff), "weights")
        self.rows = written(explain.explained(self.recs, self.weights, self.claim, claims), "explained")


@query
def dense_profiles(spark: SparkSession, folder: str) -> DataFrame:
    """Every item of the evidence with every aspect, said or not."""
    s = Said(spark, folder)
    contrib = s.contributions()
    prior = evidence.priors(contrib)
    rows = explain.dense_profiles(s.obs, explain.aspect_names(s.obs), s.profiles(contrib), prior)
    return rows.select("item_id", "aspect", *[F.round(c, 8).alias(c) for c in ("prior", "score", "support", "effective_sample_size")], "author_count", "review_count")


@query
def explained_claims(spark: SparkSession, folder: str) -> DataFrame:
    return Explained(spark, folder).rows.select("user_id", "item_id", "place", "aspect", "status", "direction", F.round("contribution", 9).alias("contribution"), "reason", "claim")


@query
def explained_items(spark: SparkSession, folder: str) -> DataFrame:
    e = Explained(spark, folder)
    return explain.explanation_status(e.recs.select("user_id", "item_id", "rank"), e.rows)


@query
def explained_summary(spark: SparkSession, folder: str) -> DataFrame:
    e = Explained(spark, folder)
    status = explain.explanation_status(e.recs.select("user_id", "item_id", "aspect_in_score", "rank"), e.rows)
    return explain.explanation_summary(status, e.rows, ["aspect_in_score", "rank"])


@query
def next_scores(spark: SparkSession, folder: str) -> DataFrame:
    return explain.next_scores(_ranked(spark, folder), FIRST)


def _effects(e: Said, **more) -> DataFrame:
    contrib = written(e.contributions(), "contributions")
    return explain.removal_effects(contrib, evidence.priors(contrib), **more)


@query
def removal_effects(spark: SparkSession, folder: str) -> DataFrame:
    """Deviations without the cited reviews and without as many others."""
    rows = _effects(Said(spark, folder))
    return rows.select("item_id", "aspect", "other_aspect", *[F.round(c, 8).alias(c) for c in ("before", "cited", "random")], "cited_count", "random_count", "pool_short")


@query
def removal_audit(spark: SparkSession, folder: str) -> DataFrame:
    """The same with cited and drawn reviews of one aspect."""
    rows = _effects(Said(spark, folder), same_aspect=True).where("aspect = other_aspect")
    return rows.select("item_id", "aspect", *[F.round(c, 8).alias(c) for c in ("before", "cited", "random")], "cited_count", "random_count", "pool_short")


def _faithful(spark: SparkSession, folder: str) -> DataFrame:
    e = Explained(spark, folder, 1)
    pairs = table(spark, folder, "hybrid_scores").select("user_id", "item_id").dropna()
    match = evidence.aspect_match(pairs, e.weights, e.said.profiles(e.said.contributions()))
    spans = match.groupBy("user_id").agg(F.min("aspect_score").alias("low"), F.max("aspect_score").alias("high"))
    scores = e.recs.select("user_id", "item_id", "score").join(explain.next_scores(e.ranked, FIRST), "user_id")
    return written(explain.faithfulness(e.rows, _effects(e.said), e.weights, spans, scores, ASPECT_WEIGHT, 1e-9), "faithful")


@query
def faithfulness(spark: SparkSession, folder: str) -> DataFrame:
    rows = _faithful(spark, folder)
    return rows.select("user_id", "item_id", "aspect", "direction", "cited_count", "random_count", "pool_short", F.round("score_delta", 8).alias("score_delta"), F.round("random_score_delta", 8).alias("random_score_delta"), "moves_as_claimed", "leaves", "random_leaves")


@query
def faithfulness_summary(spark: SparkSession, folder: str) -> DataFrame:
    rows = explain.faithfulness_summary(_faithful(spark, folder))
    return rows.select("direction", "n", "short_pools", "leaves", "random_leaves", F.round("median_change", 8).alias("median_change"), F.round("random_median_change", 8).alias("random_median_change"))


def _verified(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """A verifier that trusts what is stated with a confidence of at least a half."""
    passages, claim = _claims(Said(spark, folder))
    candidates = evidence.longest(passages, claim).join(passages.select("item_id", "aspect", "review_id", "sentiment"), ["item_id", "aspect", "review_id"])
    verdicts = passages.groupBy("review_id", "aspect").agg(F.max(F.col("confidence") >= 0.5).alias("about_aspect"), F.lit(True).alias("about_product"), F.min("sentiment").alias("polarity"))
    return explain.verified(candidates, verdicts, claim)


@query
def verified_passages(spark: SparkSession, folder: str) -> DataFrame:
    return _verified(spark, folder)[0]


@query
def verified_claims(spark: SparkSession, folder: str) -> DataFrame:
    return _verified(spark, folder)[1]


@query
def claim_exposure(spark: SparkSession, folder: str) -> DataFrame:
    return explain.exposure(Explained(spark, folder).rows)


@query
def judge_sample(spark: SparkSession, folder: str) -> DataFrame:
    return explain.judge_sample(written(explain.exposure(Explained(spark, folder).rows), "exposure"), 5, 3)


@query
def judge_summary(spark: SparkSession, folder: str) -> DataFrame:
    """The sampled claims, judged by whether they keep their support among verified passages."""
    sample = explain.judge_sample(written(explain.exposure(Explained(spark, folder).rows), "exposure"), 5, 3)
    judged = _verified(spark, folder)[1].select("item_id", "aspect", F.col("keeps").alias("supported"))
    rows = explain.judge_summary(sample, judged)
    return rows.select("stratum", "claims", "judged", F.round("supported_share", 9).alias("supported_share"), F.round("weighted_share", 9).alias("weighted_share"))
