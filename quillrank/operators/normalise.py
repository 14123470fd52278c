"""Scores of a group on one scale, and cuts of a whole ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillrank.operators.ranking import placed


def percentile(score: Column, group: list[str]) -> Column:
    """Mean rank among the group from 0 to 1; where all are equal, or one stands alone, 0.5."""
    own = W.partitionBy(*group)
    w = own.orderBy(score)
    n = F.count(F.lit(1)).over(own)
    equal = F.count(F.lit(1)).over(w.rangeBetween(W.currentRow, W.currentRow))
    mean_rank = F.rank().over(w) + (equal - 1) / 2.0
    return F.when(equal == n, F.lit(0.5)).otherwise((mean_rank - 1) / (n - 1))


def min_max(score: Column, group: list[str]) -> Column:
    """From 0 to 1 between the group's least and greatest; where all are equal 0.5."""
    own = W.partitionBy(*group)
    low, high = F.min(score).over(own), F.max(score).over(own)
    return F.when(high > low, (score - low) / (high - low)).otherwise(F.lit(0.5))


def fixed_hybrid(df: DataFrame, parts: dict[str, float], group: list[str], scale: str = "percentile") -> DataFrame:
    """Adds ``normalized_X``, ``X_contribution`` of each part and ``total_score``; weights must sum to 1."""
    if any(w < 0 for w in parts.values()) or abs(sum(parts.values()) - 1) > 1e-9:
        raise ValueError("weights must be at least 0 and sum to 1")
    make = percentile if scale == "percentile" else min_max
    for name, weight in parts.items():
        df = df.withColumn(f"normalized_{name}", make(F.col(name), group))
        df = df.withColumn(f"{name}_contribution", weight * F.col(f"normalized_{name}"))
    return df.withColumn("total_score", sum((F.col(f"{n}_contribution") for n in parts), F.lit(0.0)))


def gated_hybrid(df: DataFrame, group: list[str], kappa: float = 5.0, g_max: float = 0.5, rho: float = 0.5, tau: float = 0.0, scale: str = "percentile") -> DataFrame:
    """Adds ``gate`` and ``total_score`` to rows with mf, graph, aspect, support, history_count (and recency).

    The gate gives the aspect part more weight where its evidence is well supported and the user's history short.
    """
    if kappa <= 0 or not all(0 <= x <= 1 for x in (g_max, rho, tau)):
        raise ValueError("kappa must be above 0; g_max, rho and tau from 0 to 1")
    make = percentile if scale == "percentile" else min_max
    names = ["mf", "graph", "aspect", *(["recency"] if tau else [])]
    for n in names:
        df = df.withColumn(f"normalized_{n}", make(F.col(n), group))
    gate = g_max * (kappa / (kappa + F.col("history_count"))) * F.col("support")
    personal = rho * F.col("normalized_mf") + (1 - rho) * F.col("normalized_graph")
    base = tau * F.col("normalized_recency") + (1 - tau) * personal if tau else personal
    return df.withColumn("gate", gate).withColumn("total_score", (1 - F.col("gate")) * base + F.col("gate") * F.col("normalized_aspect"))


def thirds(catalog: DataFrame, names: tuple[str, str, str] = ("tail", "middle", "head")) -> DataFrame:
    """``item_id, tertile``: the catalogue cut in three by popularity and item, items without likes included."""
    at = placed(catalog.select("item_id", "popularity"), [F.col("popularity").asc(), F.col("item_id").asc()])
    n = catalog.select(F.count(F.lit(1))).scalar()
    third = F.floor(3 * (F.col("place") - 1) / n)
    return at.select("item_id", F.when(third == 0, names[0]).when(third == 1, names[1]).otherwise(names[2]).alias("tertile"))
