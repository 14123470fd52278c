"""One ranking out of several scores on unlike scales."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillrank.operators.skew import positions
from quillrank.runtime import bounded, partitions, written

#: Candidates of one group that a single task may rank.
GROUP_ROWS = 200_000
#: The constant added to a rank before it is inverted; the usual value.
RRF_CONSTANT = 60


def _ranked_in_task(df: DataFrame, scores: list[str]) -> DataFrame:
    """Adds ``lower_X``, ``equal_X`` and ``others``; a group lies in one task."""
    for s in scores:
        w = W.partitionBy("g").orderBy(F.col(s).asc_nulls_first())
        df = df.withColumn(f"lower_{s}", F.rank().over(w) - 1).withColumn(f"equal_{s}", F.count(F.lit(1)).over(w.rangeBetween(W.currentRow, W.currentRow)) - 1)
    return df.withColumn("others", F.count(F.lit(1)).over(W.partitionBy("g")) - 1)


def _ranked_in_ranges(df: DataFrame, scores: list[str], group_rows: int) -> DataFrame:
    """The same for groups of any size, from counts of their distinct scores.

    Rows are first counted by (group, score), so any number of equal scores is one row. The counts lie in sorted ranges
    of (group, score); the rows of lower scores are those before in the range and those of the ranges before. Scores of more
    than ``group_rows`` rows are few (at most the rows by that) and looked up apart from the others.
    """
    spark = df.sparkSession
    base = df
    for s in scores:
        counts = df.groupBy("g", s).agg(F.count(F.lit(1)).alias("n"))
        order = F.col(s).asc_nulls_first()
        at = written(counts.repartitionByRange(partitions(spark), "g", order).withColumn("piece", F.spark_partition_id()), "ranges")
        held = at.groupBy("g", "piece").agg(F.sum("n").alias("held"))
        before = held.select("g", "piece", F.coalesce(F.sum("held").over(W.partitionBy("g").orderBy("piece").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row per piece
        inside = F.coalesce(F.sum("n").over(W.partitionBy("g", "piece").orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        code = F.coalesce(F.hex(F.col(s).cast("string")), F.lit("~"))  # a key that is never NULL
        place = at.withColumn("inside", inside).join(before, ["g", "piece"]).select(F.col("g").alias("og"), code.alias("oc"), "n", (F.col("inside") + F.col("before")).alias(f"lower_{s}"), (F.col("n") - 1).alias(f"equal_{s}"))
        place = written(place, "score-places")
        many = place.where(F.col("n") > group_rows).drop("n")
        rows = base.withColumn("__c", code)
        same = (F.col("g") == F.col("og")) & (F.col("__c") == F.col("oc"))
        frequent = rows.join(bounded(many), same)
        rare = rows.join(bounded(many), same, "left_anti").join(place.where(F.col("n") <= group_rows).drop("n"), same)
        base = frequent.unionByName(rare).drop("og", "oc", "__c")
    sizes = written(df.groupBy("g").agg((F.count(F.lit(1)) - 1).alias("others")), "sizes")
    return base.join(bounded(sizes), "g")


def rank_positions(df: DataFrame, group: str, item: str, scores: list[str], group_rows: int = GROUP_ROWS) -> tuple[DataFrame, DataFrame | None]:
    """``g, i, others`` and for each score ``lower_X, equal_X``: how many of the group's other items
    are lower in it, and how many equal.

    Copies of a (group, item) count once, by the largest value of each score. NULL and NaN are lower
    than all numbers and equal to each other. Rows whose group or item is NULL are no candidates.
    The first result has the groups of at most ``group_rows`` rows, each ranked in one task; the second, if there are any,
    the larger ones, ranked over sorted ranges.
    """
    named = {s: f"s{k}" for k, s in enumerate(scores)}
    number = lambda s: F.when(~F.isnan(s), F.col(s).cast("double") + 0.0)  # noqa: E731  (-0.0 becomes 0.0)
    rows = df.where(F.col(group).isNotNull() & F.col(item).isNotNull()).select(F.col(group).alias("g"), F.col(item).alias("i"), *[number(s).alias(a) for s, a in named.items()])
    large = written(rows.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > group_rows).select("g"), "large")
    some = not large.isEmpty()
    best = [F.max(a).alias(a) for a in named.values()]
    back = [F.col(f"{kind}_{a}").alias(f"{kind}_{s}") for s, a in named.items() for kind in ("lower", "equal")]
    usual = rows.join(bounded(large), "g", "left_anti") if some else rows
    out = _ranked_in_task(usual.repartition("g").groupBy("g", "i").agg(*best), list(named.values())).select("g", "i", "others", *back)
    if not some:
        return out, None
    hot = written(rows.join(bounded(large), "g", "left_semi").groupBy("g", "i").agg(*best), "large-groups")
    return out, _ranked_in_ranges(hot, list(named.values()), group_rows).select("g", "i", "others", *back)


def _standing(scores: list[str]) -> Column:
    """Twice the sum of the shares of lower others, times the others: whole numbers, so ties are exact."""
    return sum((2 * F.col(f"lower_{s}") + F.col(f"equal_{s}") for s in scores), F.lit(0))


def _reciprocal(scores: list[str], constant: int) -> Column:
    """Sum of 1 / (constant + rank), equal scores sharing the mean of their ranks."""
    rank = lambda s: 1 + F.col("others") - F.col(f"lower_{s}") - F.col(f"equal_{s}") / 2
    return sum((F.lit(1.0) / (constant + rank(s)) for s in scores), F.lit(0.0))


def fused(df: DataFrame, group: str, item: str, scores: list[str], top: int | None = None, by: str = "reciprocal", constant: int = RRF_CONSTANT, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``group, item, fused_score, position``: the items of each group by all scores together.

    Items are ranked separately in each score and only the ranks are combined, so no score's
    range or distribution matters. ``by="reciprocal"`` sums 1 / (constant + rank); ``by="standing"``
    sums the shares of the group's other items that are lower, equal ones counting half (0 in a group
    of one). Equal results are ordered by item. ``top`` keeps that many items of each group.
    See :func:`rank_positions` for NULL, NaN, copies and large groups; no rows give no rows.
    """
    usual, large = rank_positions(df, group, item, scores, group_rows)
    if by == "standing":
        key = _standing(scores)
        shown = F.when(F.col("others") > 0, F.col("key") / (2 * F.col("others"))).otherwise(F.lit(0.0))
    else:
        key, shown = F.round(_reciprocal(scores, constant), 12), F.col("key")
    order = [F.col("key").desc(), F.col("i").asc()]
    out = usual.select("g", "i", "others", key.alias("key")).withColumn("position", F.row_number().over(W.partitionBy("g").orderBy(*order)))
    if large is not None:
        ranged = positions(large.select("g", "i", "others", key.alias("key")), ["g"], order)
        out = out.unionByName(ranged.withColumn("position", F.col("position").cast("int")))
    if top is not None:
        out = out.where(F.col("position") <= top)
    return out.select(F.col("g").alias(group), F.col("i").alias(item), shown.alias("fused_score"), "position")
