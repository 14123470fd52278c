"""Weighted aspect evidence: profiles of items, priors, users' weights, claims and their tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MS_PER_DAY = 86_400_000


def observations(df: DataFrame) -> DataFrame:
    """``evidence_id, review_id, item_id, aspect, sentiment, z, confidence, timestamp, author_id, duplicate_group, text,
    evidence, start_offset, end_offset``, one row per evidence id.

    ``z`` is 1, -1 or 0. A confidence that is NULL or outside 0..1 counts as 1. Rows without item, aspect, review or time
    are left out. Where the input has no ``duplicate_group`` it is NULL.
    """
    own = ["evidence_id", "review_id", "item_id", "aspect", "sentiment", "timestamp", "author_id", "text", "evidence", "start_offset", "end_offset"]
    group = F.col("duplicate_group") if "duplicate_group" in df.columns else F.lit(None).cast("string")
    z = F.when(F.col("sentiment") == "positive", 1.0).when(F.col("sentiment") == "negative", -1.0).otherwise(0.0)
    sure = F.when(F.col("confidence").between(0, 1), F.col("confidence")).otherwise(F.lit(1.0))
    valid = df.where("item_id is not null and aspect is not null and review_id is not null and timestamp is not null")
    rows = valid.select(*own, z.alias("z"), sure.alias("confidence"), group.alias("duplicate_group"))
    at = F.row_number().over(W.partitionBy("evidence_id").orderBy("timestamp", "review_id", "aspect", "sentiment", F.col("confidence").desc()))
    return rows.withColumn("at", at).where("at = 1").drop("at")


def weighted(obs: DataFrame, cutoff: int, half_life_days: float = 0.0, duplicate_penalty: float | None = None) -> DataFrame:
    """Adds ``weight`` to the rows before the cutoff: confidence, less for repeated texts, less with age.

    The share of a repeated text is one by the number of distinct reviews of the item in its duplicate group.
    """
    rows = obs.where(F.col("timestamp") < cutoff)
    groups = rows.where("duplicate_group is not null").groupBy("item_id", "duplicate_group").agg(F.count_distinct("review_id").alias("copies"))
    rows = rows.join(groups, ["item_id", "duplicate_group"], "left")
    share = F.lit(1.0) / F.coalesce("copies", F.lit(1)) if duplicate_penalty is None else F.lit(float(duplicate_penalty))
    age = F.exp(-F.log(F.lit(2.0)) * ((cutoff - F.col("timestamp")) / MS_PER_DAY) / half_life_days) if half_life_days else F.lit(1.0)
    return rows.withColumn("weight", F.col("confidence") * share * age).drop("copies")


def contributions(rows: DataFrame) -> DataFrame:
    """``item_id, aspect, review_id, author_id, q, z, positive, negative, neutral``: clauses of a review become one.

    Scores are weighted means of the clauses, and the review's weight is its heaviest clause's. The author is that of
    the first clause.
    """
    total = F.sum("weight")
    mean = lambda x: F.when(total > 0, F.sum(F.col("weight") * x) / total).otherwise(F.lit(0.0))
    one = rows.groupBy("item_id", "aspect", "review_id").agg(
        F.min_by("author_id", "evidence_id").alias("author_id"),
        F.max("weight").alias("q"),
        mean(F.col("z")).alias("z"),
        mean(F.greatest("z", F.lit(0.0))).alias("positive"),
        mean(F.greatest(-F.col("z"), F.lit(0.0))).alias("negative"),
    )
    return one.withColumn("neutral", F.greatest(F.lit(0.0), 1 - F.col("positive") - F.col("negative")))


def priors(contrib: DataFrame) -> DataFrame:
    """``aspect, prior``: the weighted mean score of each aspect, 0 without weight."""
    q = F.sum("q")
    return contrib.groupBy("aspect").agg(F.when(q > 0, F.sum(F.col("q") * F.col("z")) / q).otherwise(F.lit(0.0)).alias("prior"))


def profiles(contrib: DataFrame, prior: DataFrame, shrinkage: float = 5.0) -> DataFrame:
    """Item and aspect: score shrunk to the aspect's prior, support, masses, authors, effective sample and reviews."""
    q, q2 = F.sum("q"), F.sum(F.col("q") * F.col("q"))
    mass = lambda c: F.sum(F.col("q") * F.col(c))
    one = contrib.groupBy("item_id", "aspect").agg(
        q.alias("total_weight"),
        mass("z").alias("sum_z"),
        mass("positive").alias("positive_mass"),
        mass("negative").alias("negative_mass"),
        mass("neutral").alias("neutral_mass"),
        F.count_distinct("author_id").alias("author_count"),
        F.when(q2 > 0, q * q / q2).otherwise(F.lit(0.0)).alias("effective_sample_size"),
        F.count(F.lit(1)).alias("review_count"),
    )
    rows = one.join(F.broadcast(prior), "aspect")  # a row per aspect
    score = (shrinkage * F.col("prior") + F.col("sum_z")) / (shrinkage + F.col("total_weight"))
    return rows.withColumn("score", score).withColumn("support", F.col("total_weight") / (shrinkage + F.col("total_weight"))).drop("sum_z")


def user_weights(obs: DataFrame, cutoff: int, alpha: float = 1.0, shared_prior: bool = False) -> DataFrame:
    """``user_id, aspect, weight``: how much each author speaks of each aspect, smoothed.

    Mentions are distinct (review, aspect). The prior is uniform, or with ``shared_prior`` the share of each aspect in all
    mentions. Every author has every aspect.
    """
    said = obs.where((F.col("timestamp") < cutoff) & F.col("author_id").isNotNull()).select(F.col("author_id").alias("user_id"), "review_id", "aspect").distinct()
    per = said.groupBy("user_id", "aspect").agg(F.count(F.lit(1)).alias("n"))
    each = per.groupBy("aspect").agg(F.sum("n").alias("mentions"))
    every = F.sum("mentions").over(W.partitionBy(F.lit(1)))  # a row per aspect
    aspects = each.withColumn("prior", F.col("mentions") / every if shared_prior else F.lit(1.0) / F.count(F.lit(1)).over(W.partitionBy(F.lit(1)))).select("aspect", "prior")
    totals = per.groupBy("user_id").agg(F.sum("n").alias("total"))
    dense = totals.join(F.broadcast(aspects), F.lit(True)).join(per, ["user_id", "aspect"], "left")  # users by a handful of aspects
    weight = (F.coalesce("n", F.lit(0)) + alpha * F.col("prior")) / (F.col("total") + alpha)
    return dense.select("user_id", "aspect", weight.alias("weight"))


def aspect_match(pairs: DataFrame, weights: DataFrame, profile: DataFrame) -> DataFrame:
    """``user_id, item_id, aspect_score, aspect_support`` of user-item pairs; items without a profile add nothing."""
    item = profile.select("item_id", "aspect", (F.col("score") - F.col("prior")).alias("deviation"), "support")
    rows = pairs.select("user_id", "item_id").distinct().join(item, "item_id").join(weights, ["user_id", "aspect"])
    return rows.groupBy("user_id", "item_id").agg(F.sum(F.col("weight") * F.col("deviation")).alias("aspect_score"), F.sum(F.col("weight") * F.col("support")).alias("aspect_support"))


def direction(share: float = 2 / 3) -> Column:
    """positive, negative or conflicting by the share of positive mass; without any mass by score against prior."""
    polar = F.col("positive_mass") + F.col("negative_mass")
    part = F.col("positive_mass") / polar
    plain = F.when(F.col("score") > F.col("prior"), "positive").when(F.col("score") < F.col("prior"), "negative").otherwise("neutral")
    return F.when(polar > 0, F.when(part >= share, "positive").when(part <= 1 - share, "negative").otherwise("conflicting")).otherwise(plain)


def passages(obs: DataFrame, cutoff: int) -> DataFrame:
    """The surest row of each item, aspect and review before the cutoff, with ``traceable``: its span is in its text."""
    at = F.row_number().over(W.partitionBy("item_id", "aspect", "review_id").orderBy(F.col("confidence").desc(), "evidence_id"))
    one = obs.where(F.col("timestamp") < cutoff).withColumn("at", at).where("at = 1").drop("at")
    found = F.substring("text", F.col("start_offset") + 1, F.col("end_offset") - F.col("start_offset")) == F.col("evidence")
    return one.withColumn("traceable", F.coalesce(found, F.lit(False)))


def claims(passage: DataFrame, profile: DataFrame, support: float = 0.25, authors: int = 5, sample: float = 2.0, confidence: float = 0.5, share: float = 2 / 3) -> DataFrame:
    """One row per item and aspect: direction, share, deviation, evidence counts and what it lacks, if anything."""
    said = passage.groupBy("item_id", "aspect").agg(
        F.count(F.lit(1)).alias("passages"), F.count_distinct("author_id").alias("authors"), F.avg("confidence").alias("mean_confidence"), F.every("traceable").alias("traceable")
    )
    rows = profile.join(said, ["item_id", "aspect"], "left")
    lacks = F.array_compact(
        F.array(
            F.when(F.col("passages").isNull(), "no_evidence"),
            F.when(~F.col("traceable"), "evidence_offsets_missing"),
            F.when(F.col("support") < support, "support_below_threshold"),
            F.when(F.coalesce("authors", F.lit(0)) < authors, "distinct_authors_below_threshold"),
            F.when(F.col("effective_sample_size") < sample, "effective_sample_size_below_threshold"),
            F.when(F.coalesce("mean_confidence", F.lit(0.0)) < confidence, "confidence_below_threshold"),
        )
    )
    polar = F.col("positive_mass") + F.col("negative_mass")
    return rows.select(
        "item_id", "aspect", direction(share).alias("direction"), F.when(polar > 0, F.col("positive_mass") / polar).alias("positive_share"), (F.col("score") - F.col("prior")).alias("deviation"),
        F.coalesce("passages", F.lit(0)).alias("passages"), F.coalesce("authors", F.lit(0)).alias("authors"), "support", "effective_sample_size", F.array_join(lacks, ",").alias("lacks"),
    )


def side(direction: str = "direction", positive: str = "positive", negative: str = "negative") -> Column:
    """The polarity that a claim's passages must have; a conflicting claim leads with the side that has more."""
    return F.when(F.col(direction).isin("positive", "negative"), F.col(direction)).when(F.col(direction) == "conflicting", F.when(F.col(negative) > F.col(positive), "negative").otherwise("positive"))


def cited(passage: DataFrame, claim: DataFrame, shown: int = 3) -> DataFrame:
    """``item_id, aspect, place, review_id, sentiment``: up to ``shown`` passages of each claim.

    Two on the claim's side, one of the other, then the next by confidence and review.
    """
    key = W.partitionBy("item_id", "aspect")
    counted = passage.withColumn("positive", F.count_if(F.col("sentiment") == "positive").over(key)).withColumn("negative", F.count_if(F.col("sentiment") == "negative").over(key))
    rows = counted.join(claim.select("item_id", "aspect", "direction"), ["item_id", "aspect"]).withColumn("side", side())
    order = [F.col("confidence").desc(), F.col("review_id").asc()]
    rows = rows.withColumn("n", F.row_number().over(W.partitionBy("item_id", "aspect", "sentiment").orderBy(*order)))
    other = F.when(F.col("side") == "positive", "negative").when(F.col("side") == "negative", "positive")
    group = F.when((F.col("sentiment") == F.col("side")) & (F.col("n") <= 2), 0).when((F.col("sentiment") == other) & (F.col("n") <= 1), 1).otherwise(2)
    at = F.row_number().over(key.orderBy(F.col("group"), *order))
    return rows.withColumn("group", group).withColumn("place", at).where(F.col("place") <= shown).select("item_id", "aspect", "place", "review_id", "sentiment")


def longest(passage: DataFrame, claim: DataFrame, own: int = 8, opposing: int = 4) -> DataFrame:
    """``item_id, aspect, on_side, place, review_id``: the longest passages on the claim's side and against it."""
    key = W.partitionBy("item_id", "aspect")
    counted = passage.withColumn("positive", F.count_if(F.col("sentiment") == "positive").over(key)).withColumn("negative", F.count_if(F.col("sentiment") == "negative").over(key))
    rows = counted.join(claim.select("item_id", "aspect", "direction"), ["item_id", "aspect"]).withColumn("side", side()).where("side is not null and sentiment in ('positive', 'negative')")
    rows = rows.withColumn("on_side", F.col("sentiment") == F.col("side"))
    at = F.row_number().over(W.partitionBy("item_id", "aspect", "on_side").orderBy(F.char_length("evidence").desc(), F.col("review_id").asc()))
    limit = F.when(F.col("on_side"), own).otherwise(opposing)
    return rows.withColumn("place", at).where(F.col("place") <= limit).select("item_id", "aspect", "on_side", "place", "review_id")


def removal(contrib: DataFrame, prior: DataFrame, shrinkage: float = 5.0) -> DataFrame:
    """``item_id, aspect, other_aspect, before, after``: how each deviation of an item changes without all reviews
    that speak of ``aspect``. The removed reviews' clauses leave all aspects of the item."""
    said = contrib.select("item_id", F.col("aspect").alias("gone"), "review_id").distinct()
    base = contrib.select("item_id", "aspect", "review_id", "q", "z")
    gone = base.join(said, ["item_id", "review_id"]).groupBy("item_id", "gone", "aspect").agg(F.sum("q").alias("gone_q"), F.sum(F.col("q") * F.col("z")).alias("gone_z"))
    whole = base.groupBy("item_id", "aspect").agg(F.sum("q").alias("q"), F.sum(F.col("q") * F.col("z")).alias("qz"))
    pairs = whole.join(said.select("item_id", "gone").distinct(), "item_id").join(gone, ["item_id", "gone", "aspect"], "left").join(F.broadcast(prior), "aspect")
    deviation = lambda q, qz: (shrinkage * F.col("prior") + qz) / (shrinkage + q) - F.col("prior")
    rest_q, rest_z = F.col("q") - F.coalesce("gone_q", F.lit(0.0)), F.col("qz") - F.coalesce("gone_z", F.lit(0.0))
    return pairs.select("item_id", F.col("gone").alias("aspect"), F.col("aspect").alias("other_aspect"), deviation(F.col("q"), F.col("qz")).alias("before"), deviation(rest_q, rest_z).alias("after"))


def threshold_grid(claim: DataFrame, supports: list[float], authors: list[int]) -> DataFrame:
    """``support, authors, supported``: how many claims would stand under each pair of thresholds, in one pass."""
    cells = [(s, a) for s in supports for a in authors]
    rest = ~F.col("lacks").rlike("no_evidence|offsets|effective|confidence")
    one = claim.agg(*[F.count_if((F.col("support") >= s) & (F.col("authors") >= a) & rest).alias(f"c{i}") for i, (s, a) in enumerate(cells)])
    named = F.array(*[F.struct(F.lit(float(s)).alias("support"), F.lit(a).alias("authors"), F.col(f"c{i}").alias("supported")) for i, (s, a) in enumerate(cells)])
    return one.select(F.inline(named))
