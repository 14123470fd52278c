"""Locked evaluation cases, ranking metrics, slices, leakage checks and bootstrap intervals."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Users whose metrics one worker resamples; more are resampled by weights (see :func:`bootstrap`).
WORKER_USERS = 5_000_000


class LeakageError(ValueError):
    """Held-out rows were visible before their time."""


def history_slice(n: Column) -> Column:
    return F.when(n == 0, "no_history").when(n <= 2, "1-2").when(n <= 5, "3-5").otherwise(">5")


def exclusions(edge: DataFrame, targets: DataFrame, cutoff: int, threshold: float = 4.0) -> DataFrame:
    """``targets`` with ``reason``: why a row is no case, the first that applies; NULL where it is one.

    In order: before the cutoff, rating NULL or too low, item unknown, already met, or the pair came before.
    """
    known = edge.select("item_id").distinct().withColumn("known", F.lit(True))
    met = edge.select("user_id", "item_id").withColumn("met", F.lit(True))
    rows = targets.join(known, "item_id", "left").join(met, ["user_id", "item_id"], "left")
    first = (
        F.when(F.col("timestamp") < cutoff, "target_before_cutoff")
        .when(~F.coalesce(F.col("rating") >= threshold, F.lit(False)), "target_not_positive")
        .when(F.col("known").isNull(), "target_unknown_item")
        .when(F.col("met"), "target_in_history")
    )
    rows = rows.withColumn("reason", first)
    again = F.row_number().over(W.partitionBy("user_id", "item_id", F.col("reason").isNull()).orderBy("timestamp", F.col("review_id").asc_nulls_first()))
    reason = F.when(F.col("reason").isNull() & (again > 1), "target_duplicate_pair").otherwise(F.col("reason"))
    return rows.withColumn("reason", reason).drop("known", "met")


def cases(edge: DataFrame, targets: DataFrame, cutoff: int, threshold: float = 4.0) -> DataFrame:
    """``user_id, item_id, history_count``: each target of each user that has a candidate left."""
    good = exclusions(edge, targets, cutoff, threshold).where("reason is null").select("user_id", "item_id")
    history = edge.groupBy("user_id").agg(F.count(F.lit(1)).alias("history_count"))
    catalog = edge.select(F.count_distinct("item_id")).scalar()
    rows = good.join(history, "user_id", "left").withColumn("history_count", F.coalesce("history_count", F.lit(0)))
    return rows.where(F.col("history_count") < catalog)


def metrics(ranking: DataFrame, case: DataFrame, ks: list[int]) -> DataFrame:
    """``user_id`` and ``ndcg_k, recall_k, precision_k`` of each case user; a user without ranking has zeros.

    Precision divides by k, the ideal gain by the smaller of k and the number of targets.
    """
    hits = ranking.join(case.select("user_id", "item_id"), ["user_id", "item_id"])
    sums = []
    for k in ks:
        within = F.col("rank") <= k
        sums += [F.sum(F.when(within, 1 / F.log2(F.col("rank") + 1.0))).alias(f"dcg_{k}"), F.count_if(within).alias(f"hit_{k}")]
    found = hits.groupBy("user_id").agg(*sums)
    n = case.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    rows = n.join(found, "user_id", "left")
    out = [F.col("user_id")]
    for k in ks:
        ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.col("n").cast("int"))), F.lit(0.0), lambda a, r: a + 1 / F.log2(r + 1.0))
        hit = F.coalesce(f"hit_{k}", F.lit(0))
        out += [(F.coalesce(f"dcg_{k}", F.lit(0.0)) / ideal).alias(f"ndcg_{k}"), (hit / F.col("n")).alias(f"recall_{k}"), (hit / F.lit(k)).alias(f"precision_{k}")]
    return rows.select(*out)


def diversity(ranking: DataFrame, aspects: DataFrame, k: int) -> DataFrame:
    """``user_id, diversity``: mean distance (1 - Jaccard of aspect sets) between a user's first ``k`` known items.

    One known item gives 0, none NULL. ``aspects`` has ``item_id, aspect``.
    """
    sets = aspects.groupBy("item_id").agg(F.collect_set("aspect").alias("set"))  # as many as there are aspects
    own = ranking.where(F.col("rank") <= k).join(sets, "item_id", "left").groupBy("user_id").agg(F.collect_list("set").alias("sets"))  # k at most
    apart = lambda x, y: 1 - F.size(F.array_intersect(x, y)) / F.greatest(F.size(F.array_union(x, y)), F.lit(1))
    total = F.aggregate(F.transform("sets", lambda x: F.aggregate("sets", F.lit(0.0), lambda a, y: a + apart(x, y))), F.lit(0.0), lambda a, x: a + x)
    n = F.size("sets")
    return own.select("user_id", F.when(n == 0, F.lit(None)).when(n == 1, F.lit(0.0)).otherwise(total / (n * (n - 1))).alias("diversity"))


def by_history(per_user: DataFrame, case: DataFrame, columns: list[str]) -> DataFrame:
    """Users and mean metrics by length of history."""
    kind = case.select("user_id", history_slice(F.col("history_count")).alias("slice")).distinct()
    return per_user.join(kind, "user_id").groupBy("slice").agg(F.count(F.lit(1)).alias("users"), *[F.avg(c).alias(c) for c in columns])


def by_popularity(ranking: DataFrame, case: DataFrame, tertiles: DataFrame, ks: list[int]) -> DataFrame:
    """Users, targets and mean metrics by popularity of the targets; metrics are made anew over each third's targets."""
    named = case.join(tertiles, "item_id")
    whole = named.select(F.concat_ws("\u001f", "tertile", "user_id").alias("user_id"), "item_id")
    every = ranking.join(named.select("user_id", "tertile").distinct(), "user_id").select(F.concat_ws("\u001f", "tertile", "user_id").alias("user_id"), "rank", "item_id")
    rows = metrics(every, whole, ks).withColumn("tertile", F.split_part("user_id", F.lit("\u001f"), F.lit(1)))
    n = named.groupBy("tertile").agg(F.count(F.lit(1)).alias("targets"))
    names = [c for c in rows.columns if c not in ("user_id", "tertile")]
    return rows.groupBy("tertile").agg(F.count(F.lit(1)).alias("users"), *[F.avg(c).alias(c) for c in names]).join(n, "tertile")


def late_rows(df: DataFrame, cutoff: int) -> DataFrame:
    """``n_late, latest``: rows at or after a cutoff, or without a time; one row."""
    late = F.col("timestamp").isNull() | (F.col("timestamp") >= cutoff)
    return df.agg(F.count_if(late).alias("n_late"), F.max("timestamp").alias("latest"))


def assert_before(df: DataFrame, cutoff: int, what: str) -> None:
    n, latest = late_rows(df, cutoff).first()
    if n:
        raise LeakageError(f"{what}: {n} rows are not before {cutoff}, the latest at {latest}")


def overlap(a: DataFrame, b: DataFrame, key: str = "review_id") -> DataFrame:
    """Keys that both sides hold."""
    return a.select(key).where(F.col(key).isNotNull()).distinct().join(b.select(key), key, "left_semi")


def assert_disjoint(a: DataFrame, b: DataFrame, what: str, key: str = "review_id") -> None:
    n = overlap(a, b, key).count()
    if n:
        raise LeakageError(f"{what}: {n} values of {key} are on both sides")


def assert_same_sets(a: DataFrame, b: DataFrame, what: str) -> None:
    """Both sides hold the same rows, each as often."""
    if not (a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()):
        raise LeakageError(f"{what} differ")


def bootstrap(per_user: DataFrame, models: list[str], samples: int = 2000, level: float = 0.95, seed: int = 7, reference: str | None = None) -> DataFrame:
    """``model, estimate, lower, upper, delta, delta_lower, delta_upper`` of paired resamples of users.

    ``per_user`` has one column per model; users with a NULL in any model are left out. The same users are drawn
    for all models. Up to ``WORKER_USERS`` users are drawn with replacement in one worker; more are resampled where they
    lie, each user with a Poisson weight of its own hash and the sample's number, and only sums are brought together.
    """
    rows = per_user.select("user_id", *models).dropna()
    alpha = (1 - level) / 2
    schema = "model string, estimate double, lower double, upper double, delta double, delta_lower double, delta_upper double"

    def summary(names, means, draws):
        out = []
        for m in names:
            other = reference and m != reference
            d = draws[m] - draws[reference] if other else None
            out.append((m, means[m], *np.quantile(draws[m], [alpha, 1 - alpha]), *((means[m] - means[reference], *np.quantile(d, [alpha, 1 - alpha])) if other else (None, None, None))))
        return pd.DataFrame(out, columns=["model", "estimate", "lower", "upper", "delta", "delta_lower", "delta_upper"])

    if rows.limit(WORKER_USERS + 1).count() <= WORKER_USERS:

        def run(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values("user_id")
            rng, values = np.random.default_rng(seed), {m: frame[m].to_numpy(float) for m in models}
            draws = {m: np.empty(samples) for m in models}
            for begin in range(0, samples, 64):
                at = rng.integers(0, len(frame), (min(64, samples - begin), len(frame)))
                for m in models:
                    draws[m][begin : begin + len(at)] = values[m][at].mean(axis=1)
            return summary(models, {m: float(values[m].mean()) for m in models}, draws)

        return rows.groupBy(F.lit(1).alias("all")).applyInPandas(run, schema)

    def weigh(frames):
        total = np.zeros((samples, len(models) + 1))
        for frame in frames:
            values = np.c_[np.ones(len(frame)), frame[models].to_numpy(float)]
            for begin in range(0, len(frame), 512):
                part = values[begin : begin + 512]
                weights = np.array([np.random.default_rng([seed, int(h) & 0xFFFFFFFF]).poisson(1.0, samples) for h in frame["h"].iloc[begin : begin + 512]])
                total += weights.T @ part
        yield pd.DataFrame({"s": np.arange(samples), **{f"c{j}": total[:, j] for j in range(len(models) + 1)}})

    columns = ", ".join(f"c{j} double" for j in range(len(models) + 1))
    sums = rows.withColumn("h", F.xxhash64("user_id")).mapInPandas(weigh, f"s int, {columns}").groupBy("s").agg(*[F.sum(f"c{j}").alias(f"c{j}") for j in range(len(models) + 1)])
    means = rows.agg(*[F.avg(m).alias(m) for m in models]).first().asDict()

    def finish(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("s")
        return summary(models, means, {m: (frame[f"c{j + 1}"] / frame["c0"]).to_numpy() for j, m in enumerate(models)})

    return sums.groupBy(F.lit(1).alias("all")).applyInPandas(finish, schema)  # one row per sample


def ranking_violations(ranking: DataFrame, case: DataFrame, edge: DataFrame) -> DataFrame:
    """One row of counts, all 0 in a sound ranking: items twice for a user, items unknown or already met, users
    without a case, and case users without a ranking."""
    twice = ranking.groupBy("user_id", "item_id").agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("repeated_items"))
    unknown = ranking.join(edge.select("item_id"), "item_id", "left_anti").agg(F.count(F.lit(1)).alias("unknown_items"))
    met = ranking.join(edge, ["user_id", "item_id"], "left_semi").agg(F.count(F.lit(1)).alias("met_items"))
    foreign = ranking.join(case, "user_id", "left_anti").agg(F.count_distinct("user_id").alias("foreign_users"))
    missing = case.join(ranking, "user_id", "left_anti").agg(F.count_distinct("user_id").alias("missing_users"))
    out = twice
    for one in (unknown, met, foreign, missing):
        out = out.join(one, F.lit(True))  # one row each
    return out


def upper_medians(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """The middle value of each group, of an even number the upper one; NULLs don't count."""
    w = W.partitionBy(*group)
    rows = df.where(F.col(value).isNotNull()).withColumn("__n", F.count(F.lit(1)).over(w)).withColumn("__at", F.row_number().over(w.orderBy(value)))
    return rows.where(F.col("__at") == F.floor(F.col("__n") / 2) + 1).select(*group, F.col(value).alias("median"))


def summary_sets(df: DataFrame, keys: list[str], status: str) -> DataFrame:
    """``key_name, key_value, status, n``: the statuses by each key alone and in all, in one pass over the rows."""
    sets = F.array(F.struct(F.lit("all").alias("key_name"), F.lit("all").alias("key_value")), *[F.struct(F.lit(k).alias("key_name"), F.col(k).cast("string").alias("key_value")) for k in keys])
    return df.select(F.col(status).alias("status"), F.inline(sets)).groupBy("key_name", "key_value", "status").agg(F.count(F.lit(1)).alias("n"))
