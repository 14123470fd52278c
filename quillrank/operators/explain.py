"""Explanations of recommendations: ranked claims, removal tests, verified passages, samples for judges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillrank.operators.evaluation import upper_medians
from quillrank.operators.evidence import side
from quillrank.operators.skew import positions
from quillrank.runtime import SENT_ROWS

SHOWN = 3


def aspect_names(df: DataFrame) -> list[str]:
    """The distinct aspects of a table; a closed vocabulary, whose size is checked."""
    names = [r["aspect"] for r in df.select("aspect").where("aspect is not null").distinct().limit(SENT_ROWS + 1).collect()]
    if len(names) > SENT_ROWS:
        raise ValueError(f"more than {SENT_ROWS} aspects")
    return sorted(names)


def dense_profiles(items: DataFrame, aspects: list[str], profile: DataFrame, prior: DataFrame, item_prior: DataFrame | None = None) -> DataFrame:
    """``item_id, aspect, prior, score, support, effective_sample_size, author_count, review_count`` of every item and aspect.

    Where nothing is said the score is the prior and all else 0. A prior of the item and aspect (``item_prior``) goes before
    the aspect's, which goes before 0.
    """
    every = items.select("item_id").where("item_id is not null").distinct().select("item_id", F.explode(F.array(*[F.lit(a) for a in aspects])).alias("aspect"))
    own = profile.select("item_id", "aspect", "score", "support", "effective_sample_size", "author_count", "review_count", F.col("prior").alias("told"))
    rows = every.join(own, ["item_id", "aspect"], "left").join(prior.select("aspect", F.col("prior").alias("general")), "aspect", "left")
    first = F.lit(None).cast("double")
    if item_prior is not None:
        rows = rows.join(item_prior.select("item_id", "aspect", F.col("prior").alias("special")), ["item_id", "aspect"], "left")
        first = F.col("special")
    known = F.coalesce(first, F.col("told"), F.col("general"), F.lit(0.0))
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return rows.select("item_id", "aspect", known.alias("prior"), F.coalesce("score", known).alias("score"), F.coalesce("support", F.lit(0.0)).alias("support"), F.coalesce("effective_sample_size", F.lit(0.0)).alias("effective_sample_size"), number("author_count"), number("review_count"))


def claim_text(item: Column, aspect: Column, direction: Column, share: Column) -> Column:
    """The sentence of a supported claim; shares as whole percents."""
    percent = lambda c: F.concat(F.bround(c * 100).cast("int").cast("string"), F.lit("%"))
    head = F.concat(item, F.lit(", "), aspect, F.lit(": "))
    said = (
        F.when(direction == "conflicting", F.concat(F.lit("opinions differ, "), percent(share), F.lit(" are positive")))
        .when(direction == "negative", F.concat(percent(1 - share), F.lit(" of opinions are negative")))
        .when(direction == "positive", F.concat(percent(share), F.lit(" of opinions are positive")))
    )
    return F.concat(head, said)


def explained(recs: DataFrame, weights: DataFrame, claim: DataFrame, max_claims: int = 1) -> DataFrame:
    """``user_id, item_id, place, aspect, status, direction, contribution, reason, claim``: the weightiest claims of each
    recommendation.

    ``recs`` has ``user_id, item_id, aspect_in_score``. Claims are ordered by the size of weight times deviation, equal ones by aspect.
    Where the aspect term is no part of the score, claims describe the item but contribute 0. Claims that lack support have
    their reasons and no text. Recommendations whose item or user has no profile have no row (:func:`explanation_status`).
    """
    rows = recs.select("user_id", "item_id", "aspect_in_score").join(claim, "item_id").join(weights.select("user_id", "aspect", "weight"), ["user_id", "aspect"])
    rows = rows.withColumn("pull", F.col("weight") * F.col("deviation"))
    at = F.row_number().over(W.partitionBy("user_id", "item_id").orderBy(F.round(F.abs("pull"), 12).desc(), F.col("aspect").asc()))
    first = rows.withColumn("place", at).where(F.col("place") <= max_claims)
    supported = F.col("lacks") == ""
    text = claim_text(F.col("item_id"), F.col("aspect"), F.col("direction"), F.col("positive_share"))
    return first.select(
        "user_id", "item_id", "place", "aspect", F.when(supported, "supported").otherwise("insufficient_support").alias("status"), "direction",
        F.when(F.col("aspect_in_score"), F.col("pull")).otherwise(F.lit(0.0)).alias("contribution"), F.when(~supported, F.col("lacks")).alias("reason"), F.when(supported, text).alias("claim"),
    )


def explanation_status(recs: DataFrame, claims: DataFrame) -> DataFrame:
    """``recs`` with ``status``: supported if one of its claims is, insufficient_support if it has others, else unavailable."""
    one = claims.groupBy("user_id", "item_id").agg(F.bool_or(F.col("status") == "supported").alias("good"))
    status = F.when(F.col("good"), "supported").when(~F.col("good"), "insufficient_support").otherwise("unavailable")
    return recs.join(one, ["user_id", "item_id"], "left").withColumn("status", status).drop("good")


def explanation_summary(status: DataFrame, claims: DataFrame, keys: list[str]) -> DataFrame:
    """``key_name, key_value, name, n``: statuses by each key and in all, users with a supported explanation, directions and refusals.

    One pass over the recommendations and one over the claims.
    """
    sets = F.array(F.struct(F.lit("all").alias("key_name"), F.lit("all").alias("key_value")), *[F.struct(F.lit(k).alias("key_name"), F.coalesce(F.col(k).cast("string"), F.lit("none")).alias("key_value")) for k in keys])
    counted = status.select("status", F.inline(sets)).groupBy("key_name", "key_value", F.concat(F.lit("status:"), "status").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    covered = status.groupBy("user_id").agg(F.bool_or(F.col("status") == "supported").alias("good")).agg(F.count_if("good").alias("n"))
    whole = lambda rows, name: rows.select(F.lit("all").alias("key_name"), F.lit("all").alias("key_value"), name.alias("name"), "n")
    users = whole(covered, F.lit("users_with_supported"))
    ways = claims.where("status = 'supported'").groupBy("direction").agg(F.count(F.lit(1)).alias("n"))
    refusals = claims.where("reason is not null").select(F.explode(F.split("reason", ",")).alias("r")).groupBy("r").agg(F.count(F.lit(1)).alias("n"))
    out = counted.unionByName(users)
    for rows, name in ((ways, F.concat(F.lit("direction:"), "direction")), (refusals, F.concat(F.lit("refusal:"), "r"))):
        out = out.unionByName(whole(rows, name))
    return out


def next_scores(ranked: DataFrame, k: int) -> DataFrame:
    """``user_id, next_score``: the score of the first item that a user's first ``k`` leave out; NULL without one."""
    return ranked.groupBy("user_id").agg(F.max(F.when(F.col("rank") == k + 1, F.col("score"))).alias("next_score"))


def removal_effects(contrib: DataFrame, prior: DataFrame, shrinkage: float = 5.0, seed: int = 7, same_aspect: bool = False) -> DataFrame:
    """``item_id, aspect, other_aspect, before, cited, random, cited_count, random_count, pool_short``: how each deviation of an
    item changes without the reviews that speak of ``aspect``, and without as many others.

    The others are drawn by the hash of seed, item, aspect and review; if the item has too few, all of them are taken and
    ``pool_short`` is true. With ``same_aspect`` only the first half (by that hash) of the reviews that speak of the aspect is cited and the others of
    that half's aspect are the pool.
    """
    base = contrib.select("item_id", "aspect", "review_id", "q", "z")
    spoken = base.select("item_id", F.col("aspect").alias("gone"), "review_id").distinct()
    draw = F.sha2(F.concat_ws("|", F.lit(str(seed)), "item_id", "gone", "review_id"), 256)
    if same_aspect:
        ordered = positions(spoken.withColumn("draw", draw), ["item_id", "gone"], [F.col("draw").asc(), F.col("review_id").asc()])
        whole = spoken.groupBy("item_id", "gone").agg(F.count(F.lit(1)).alias("every"))
        marked = ordered.join(whole, ["item_id", "gone"]).withColumn("mine", F.col("position") <= F.ceil(F.col("every") / 2))
        said, pool = marked.where("mine").select("item_id", "gone", "review_id"), marked.where("not mine").select("item_id", "gone", "review_id")
    else:
        said = spoken
        reviews = base.select("item_id", "review_id").distinct()
        pool = reviews.join(spoken.select("item_id", "gone").distinct(), "item_id").join(spoken, ["item_id", "gone", "review_id"], "left_anti").select("item_id", "gone", "review_id")
    counts = said.groupBy("item_id", "gone").agg(F.count(F.lit(1)).alias("cited_count"))
    placed = positions(pool.withColumn("draw", draw), ["item_id", "gone"], [F.col("draw").asc(), F.col("review_id").asc()])
    drawn = placed.join(counts, ["item_id", "gone"]).where("position <= cited_count").select("item_id", "gone", "review_id")
    other = drawn.groupBy("item_id", "gone").agg(F.count(F.lit(1)).alias("random_count"))
    lost = lambda rows, name: base.join(rows, ["item_id", "review_id"]).groupBy("item_id", "gone", "aspect").agg(F.sum("q").alias(f"{name}_q"), F.sum(F.col("q") * F.col("z")).alias(f"{name}_z"))
    whole = base.groupBy("item_id", "aspect").agg(F.sum("q").alias("q"), F.sum(F.col("q") * F.col("z")).alias("qz"))
    rows = whole.join(counts.join(other, ["item_id", "gone"], "left"), "item_id").join(lost(said, "cited"), ["item_id", "gone", "aspect"], "left").join(lost(drawn, "random"), ["item_id", "gone", "aspect"], "left").join(prior, "aspect")

    def deviation(name: str | None) -> Column:
        gone_q, gone_z = (F.coalesce(f"{name}_q", F.lit(0.0)), F.coalesce(f"{name}_z", F.lit(0.0))) if name else (F.lit(0.0), F.lit(0.0))
        return (shrinkage * F.col("prior") + F.col("qz") - gone_z) / (shrinkage + F.col("q") - gone_q) - F.col("prior")

    n = F.coalesce("random_count", F.lit(0))
    return rows.select(
        "item_id", F.col("gone").alias("aspect"), F.col("aspect").alias("other_aspect"), deviation(None).alias("before"), deviation("cited").alias("cited"), deviation("random").alias("random"),
        "cited_count", n.alias("random_count"), (n < F.col("cited_count")).alias("pool_short"),
    )


def faithfulness(claims: DataFrame, effects: DataFrame, weights: DataFrame, spans: DataFrame, scores: DataFrame, aspect_weight: float, least: float = 1e-12) -> DataFrame:
    """One row per claim: how its recommendation's score changes without the cited and without the drawn reviews.

    ``spans`` has each user's least and greatest aspect score (``user_id, low, high``), which stay as they were; ``scores``
    has ``user_id, item_id, score, next_score``. A claim is faithful if the cited reviews change the score, and more than
    the drawn ones do; it moves as claimed if the score falls without positive or rises without negative evidence.
    """
    change = lambda c: F.sum(F.col("weight") * (F.col(c) - F.col("before")))
    own = claims.select("user_id", "item_id", "aspect", "direction").join(effects, ["item_id", "aspect"])
    local = own.join(weights.select("user_id", F.col("aspect").alias("other_aspect"), "weight"), ["user_id", "other_aspect"])
    one = local.groupBy("user_id", "item_id", "aspect", "direction").agg(change("cited").alias("cited_change"), change("random").alias("random_change"), F.any_value("cited_count").alias("cited_count"), F.any_value("random_count").alias("random_count"), F.any_value("pool_short").alias("pool_short"))
    rows = one.join(spans, "user_id").join(scores, ["user_id", "item_id"])
    width = F.col("high") - F.col("low")
    part = lambda c: F.when(width > 0, aspect_weight * F.col(c) / width).otherwise(F.lit(0.0))
    rows = rows.withColumn("score_delta", part("cited_change")).withColumn("random_score_delta", part("random_change"))
    size = F.abs("score_delta")
    sign = F.when(F.col("direction") == "positive", -1.0).when(F.col("direction") == "negative", 1.0)
    below = lambda c: F.when(F.col("next_score").isNotNull(), F.col("score") + F.col(c) < F.col("next_score"))
    return rows.select(
        "user_id", "item_id", "aspect", "direction", "cited_count", "random_count", "pool_short", "cited_change", "random_change", "score_delta", "random_score_delta",
        ((size > least) & (size > F.abs("random_score_delta"))).alias("faithful"), (F.col("score_delta") * sign > least).alias("moves_as_claimed"),
        below("score_delta").alias("leaves"), below("random_score_delta").alias("random_leaves"),
    )


def faithfulness_summary(rows: DataFrame) -> DataFrame:
    """``direction, n, faithful, short_pools, leaves, random_leaves, median_change, random_median_change`` in all and by direction;
    medians are the middle sizes of the changes, of an even number the upper one."""
    sets = F.explode(F.array(F.lit("all"), F.col("direction"))).alias("direction")
    each = rows.select(sets, "faithful", "pool_short", "leaves", "random_leaves", F.abs("score_delta").alias("change"), F.abs("random_score_delta").alias("random_change"))
    counts = each.groupBy("direction").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c)).alias(a) for c, a in (("faithful", "faithful"), ("pool_short", "short_pools"), ("leaves", "leaves"), ("random_leaves", "random_leaves"))])
    middle = lambda c, a: upper_medians(each.withColumn("v", F.round(c, 12)), ["direction"], "v").select("direction", F.col("median").alias(a))
    return counts.join(middle("change", "median_change"), "direction").join(middle("random_change", "random_median_change"), "direction")


def verified(candidates: DataFrame, verdicts: DataFrame, claim: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The passages of claims that a verifier passes, and whether each claim keeps its support.

    ``candidates`` has ``item_id, aspect, review_id, sentiment, place, on_side``, ``verdicts`` ``review_id, aspect, about_aspect, about_product,
    polarity``. Shown are up to two passages on the claim's side and one against it whose verdict is about the aspect and
    the product and of that polarity. A conflicting claim needs both sides, any other its own.
    """
    counted = candidates.groupBy("item_id", "aspect").agg(F.count_if(F.col("sentiment") == "positive").alias("positive"), F.count_if(F.col("sentiment") == "negative").alias("negative"))
    sided = claim.select("item_id", "aspect", "direction").join(counted, ["item_id", "aspect"], "left").withColumn("side", side()).select("item_id", "aspect", "direction", "side")
    rows = candidates.join(sided, ["item_id", "aspect"]).join(verdicts, ["review_id", "aspect"]).where("about_aspect and about_product and side is not null")
    other = F.when(F.col("side") == "positive", "negative").otherwise("positive")
    group = F.when(F.col("polarity") == F.col("side"), "own").when(F.col("polarity") == other, "other")
    at = F.row_number().over(W.partitionBy("item_id", "aspect", "group").orderBy(F.col("on_side").desc(), "place", "review_id"))
    passing = rows.withColumn("group", group).where("group is not null").withColumn("at", at).where("(group = 'own' and at <= 2) or (group = 'other' and at <= 1)")
    shown = passing.select("item_id", "aspect", "review_id", "polarity", "group")
    has = passing.groupBy("item_id", "aspect").agg(F.bool_or(F.col("group") == "own").alias("own"), F.bool_or(F.col("group") == "other").alias("other"))
    keeps = F.coalesce(F.col("own") & (F.col("other") | (F.col("direction") != "conflicting")), F.lit(False))
    return shown, sided.join(has, ["item_id", "aspect"], "left").select("item_id", "aspect", "direction", keeps.alias("keeps"))


def exposure(claims: DataFrame) -> DataFrame:
    """``item_id, aspect, direction, uses``: in how many recommendations each supported claim stands."""
    return claims.where("status = 'supported'").groupBy("item_id", "aspect", "direction").agg(F.count(F.lit(1)).alias("uses"))


def judge_sample(uses: DataFrame, per_stratum: int, top: int = 0, seed: int = 7) -> DataFrame:
    """``stratum, stratum_size, item_id, aspect, uses``: claims for a judge, up to ``per_stratum`` of each direction by a hash of
    seed, item and aspect, and the ``top`` most shown ones as a stratum of their own."""
    draw = F.sha2(F.concat_ws("|", F.lit(str(seed)), "item_id", "aspect"), 256)
    sizes = uses.groupBy("direction").agg(F.count(F.lit(1)).alias("stratum_size"))
    at = F.row_number().over(W.partitionBy("direction").orderBy(draw, "item_id", "aspect"))  # ends with the limit of each stratum
    drawn = uses.withColumn("at", at).where(F.col("at") <= per_stratum).join(sizes, "direction").select(F.col("direction").alias("stratum"), "stratum_size", "item_id", "aspect", "uses")
    most = uses.orderBy(F.col("uses").desc(), "item_id", "aspect").limit(top).select(F.lit("top_exposure").alias("stratum"), F.lit(uses.count()).cast("long").alias("stratum_size"), "item_id", "aspect", "uses")
    return drawn.unionByName(most)


def judge_summary(sample: DataFrame, judged: DataFrame) -> DataFrame:
    """``stratum, claims, judged, supported_share, weighted_share``: how many sampled claims a judge supports, as they are and by their uses.

    ``judged`` has ``item_id, aspect, supported``; claims without a judgement count as failed.
    """
    rows = sample.join(judged, ["item_id", "aspect"], "left")
    sets = F.explode(F.array_compact(F.array(F.when(F.col("stratum") != "top_exposure", F.lit("all")), F.col("stratum")))).alias("stratum")
    each = rows.select(sets, "uses", "supported")
    n, weight = F.count("supported"), F.sum(F.when(F.col("supported").isNotNull(), F.col("uses")))
    return each.groupBy("stratum").agg(
        F.count(F.lit(1)).alias("claims"), n.alias("judged"), F.when(n > 0, F.count_if("supported") / n).alias("supported_share"),
        F.when(weight > 0, F.sum(F.when(F.col("supported"), F.col("uses")).otherwise(F.lit(0))) / weight).alias("weighted_share"),
    )
