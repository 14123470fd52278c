"""Views over prepared rankings: temporary priorities, changed ranks, evidence states."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def evidence_state(rows: DataFrame, threshold: float = 0.25) -> DataFrame:
    """``item_id, state``: conflicting, insufficient_support or supported by the well-supported rows (``sentiment, support``)."""
    enough = F.col("support") >= threshold
    agg = rows.groupBy("item_id").agg(
        F.coalesce(F.bool_or(enough & (F.col("sentiment") == "positive")), F.lit(False)).alias("p"),
        F.coalesce(F.bool_or(enough & (F.col("sentiment") == "negative")), F.lit(False)).alias("n"),
        F.max("support").alias("most"),
    )
    state = F.when(F.col("p") & F.col("n"), "conflicting").when(F.col("most") < threshold, "insufficient_support").otherwise("supported")
    return agg.select("item_id", state.alias("state"))


def reranked(ranking: DataFrame, weights: DataFrame, item_aspects: DataFrame, priorities: dict[str, float], k: int) -> DataFrame:
    """``user_id, item_id, total_score, rank``: rankings with the aspect part made anew under temporary priorities.

    ``ranking`` has ``user_id, item_id, total_score, aspect_part, aspect_weight``; ``weights`` the users' learned
    aspect weights; ``item_aspects`` ``item_id, aspect, value``. Learned and temporary weights are added and
    renormalised over the aspects an item has; without any weight the plain mean counts.
    """
    extra = F.coalesce(*[F.when(F.col("aspect") == a, F.lit(float(v))) for a, v in priorities.items()], F.lit(0.0)) if priorities else F.lit(0.0)
    total = weights.withColumn("w", F.col("weight") + extra).select("user_id", "aspect", "w")
    parts = ranking.select("user_id", "item_id").join(item_aspects, "item_id").join(total, ["user_id", "aspect"], "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
    one = parts.groupBy("user_id", "item_id").agg(F.when(F.sum("w") > 0, F.sum(F.col("w") * F.col("value")) / F.sum("w")).otherwise(F.avg("value")).alias("adjusted"))
    rows = ranking.join(one, ["user_id", "item_id"], "left")
    new = F.when((F.col("aspect_weight") > 0) & F.col("adjusted").isNotNull(), F.col("total_score") - F.col("aspect_part") + F.col("aspect_weight") * F.col("adjusted")).otherwise(F.col("total_score"))
    at = F.row_number().over(W.partitionBy("user_id").orderBy(F.col("total_score").desc(), F.col("item_id").asc()))
    return rows.select("user_id", "item_id", F.round(new, 12).alias("total_score")).withColumn("rank", at).where(F.col("rank") <= k)


def rank_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """``user_id, item_id, rank_before, rank_after`` of the items that both hold at different ranks."""
    a = before.select("user_id", "item_id", F.col("rank").alias("rank_before"))
    b = after.select("user_id", "item_id", F.col("rank").alias("rank_after"))
    return a.join(b, ["user_id", "item_id"]).where("rank_before <> rank_after")
