"""Named queries over the test tables, and SQL stating the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.functions import scalars
from quillrank.operators import evaluation, evidence, labels, normalise, ranking, serving, skew, snapshot
from quillrank.plans import sql
from quillrank.runtime import table, written
from quillrank.streaming import events as stream

Query = Callable[[SparkSession, str], DataFrame]
KEYS = ["item_id", "user_id"]
FLAGSHIP = "eval_popularity"
K = 10
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = dict(sql.ORACLE)


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


class Snapshot:
    """The events of a folder, their cutoffs and what is known before the second one."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.clean = written(snapshot.events(table(spark, folder, "interactions")), "events")
        self.t0, self.t1 = snapshot.cutoffs(self.clean)

    @property
    def tests(self) -> DataFrame:
        return snapshot.targets(self.clean, self.t1)

    def edge(self) -> DataFrame:
        return written(ranking.edges(self.clean, self.t1), "edges")

    def locked(self, edge: DataFrame) -> DataFrame:
        return written(evaluation.cases(edge, self.tests, self.t1), "cases")


# Per-key results in spite of heavy keys


@query
def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Items and users that hold at least a twentieth of all interactions."""
    return skew.heavy_keys(table(spark, folder, "interactions"), KEYS, "rating")


@query
def p7_per_key(spark: SparkSession, folder: str) -> DataFrame:
    """Rows, ratings and mean rating of each item and each user."""
    stats = skew.per_key_stats(table(spark, folder, "interactions"), KEYS, "rating")
    return stats.selectExpr("key_name", "key_value", "n_rows", "n_values", "round(mean_value, 9) AS mean_value")


# Snapshots


@query
def snap_events(spark: SparkSession, folder: str) -> DataFrame:
    return snapshot.events(table(spark, folder, "interactions"))


@query
def snap_texts(spark: SparkSession, folder: str) -> DataFrame:
    return snapshot.texts(table(spark, folder, "review_texts")).select("review_id", "item_id", "timestamp")


@query
def snap_first_events(spark: SparkSession, folder: str) -> DataFrame:
    return snapshot.first_events(snapshot.events(table(spark, folder, "interactions")))


@query
def snap_cutoffs(spark: SparkSession, folder: str) -> DataFrame:
    s = Snapshot(spark, folder)
    return spark.createDataFrame([(s.t0, s.t1)], "t0 bigint, t1 bigint")


@query
def snap_counts(spark: SparkSession, folder: str) -> DataFrame:
    s = Snapshot(spark, folder)
    return snapshot.counts(s.clean, s.t0, s.t1)


@query
def snap_train(spark: SparkSession, folder: str) -> DataFrame:
    s = Snapshot(spark, folder)
    return snapshot.before(s.clean, s.t0)


@query
def snap_fit(spark: SparkSession, folder: str) -> DataFrame:
    s = Snapshot(spark, folder)
    return snapshot.before(s.clean, s.t1)


@query
def snap_validation_targets(spark: SparkSession, folder: str) -> DataFrame:
    s = Snapshot(spark, folder)
    return snapshot.targets(s.clean, s.t0, s.t1)


@query
def snap_test_targets(spark: SparkSession, folder: str) -> DataFrame:
    return Snapshot(spark, folder).tests


@query
def rating_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return snapshot.rating_histogram(table(spark, folder, "interactions"))


@query
def profile_missingness(spark: SparkSession, folder: str) -> DataFrame:
    return snapshot.missingness(table(spark, folder, "item_metadata"), sql.METADATA)


@query
def profile_retention(spark: SparkSession, folder: str) -> DataFrame:
    s = Snapshot(spark, folder)
    return snapshot.retention(s.clean, s.t0, s.t1)


@query
def text_profile(spark: SparkSession, folder: str) -> DataFrame:
    shown = F.trim("text") != ""
    rows = table(spark, folder, "review_texts")
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(~F.coalesce(shown, F.lit(False))).alias("n_missing"), F.round(F.avg(F.when(shown, F.char_length("text"))), 9).alias("mean_chars"))


@query
def duplicate_groups(spark: SparkSession, folder: str) -> DataFrame:
    rows = snapshot.texts(table(spark, folder, "review_texts")).withColumn("normal", scalars.normalized_text("text"))
    return rows.select("review_id", scalars.duplicate_group("item_id", F.col("normal")).alias("duplicate_group"))


@query
def leak_late_rows(spark: SparkSession, folder: str) -> DataFrame:
    s = Snapshot(spark, folder)
    return evaluation.late_rows(snapshot.before(s.clean, s.t1), s.t0)


@query
def leak_overlap(spark: SparkSession, folder: str) -> DataFrame:
    s = Snapshot(spark, folder)
    return evaluation.overlap(snapshot.before(s.clean, s.t1), snapshot.targets(s.clean, s.t0, s.t1))


# Rankings


@query
def popularity(spark: SparkSession, folder: str) -> DataFrame:
    s = Snapshot(spark, folder)
    return ranking.popularity(ranking.edges(s.clean, s.t1), s.t1, 365)


@query
def popular_top(spark: SparkSession, folder: str) -> DataFrame:
    s = Snapshot(spark, folder)
    edge = s.edge()
    return ranking.popular(s.locked(edge).select("user_id").distinct(), edge, s.t1, K)


@query
def recent_top(spark: SparkSession, folder: str) -> DataFrame:
    s = Snapshot(spark, folder)
    edge = s.edge()
    return ranking.popular(s.locked(edge).select("user_id").distinct(), edge, s.t1, K, 365)


@query
def nearest_items(spark: SparkSession, folder: str) -> DataFrame:
    """The five nearest items of each item by common users."""
    return ranking.nearest_items(Snapshot(spark, folder).edge(), 5)


@query
def neighbour_top(spark: SparkSession, folder: str) -> DataFrame:
    s = Snapshot(spark, folder)
    edge = s.edge()
    return ranking.neighbours_top(s.locked(edge).select("user_id").distinct(), edge, s.t1, K)


@query
def walk_top(spark: SparkSession, folder: str) -> DataFrame:
    """The walk run until it settles."""
    s = Snapshot(spark, folder)
    edge = s.edge()
    users = s.locked(edge).select("user_id").distinct()
    own = ranking.walks(users, edge, K).drop("settled")
    return ranking.with_fallback(own, users, edge, s.t1, K, "all_zero_scores")


@query
def walk_steps(spark: SparkSession, folder: str) -> DataFrame:
    """The walk's first double step."""
    s = Snapshot(spark, folder)
    edge = s.edge()
    return ranking.steps_top(s.locked(edge).select("user_id").distinct(), edge, K)


@query
def factor_top(spark: SparkSession, folder: str) -> DataFrame:
    s = Snapshot(spark, folder)
    edge = s.edge()
    users = s.locked(edge).select("user_id").distinct()
    return ranking.with_fallback(ranking.factor_top(users, edge, ranking.factors(edge), K), users, edge, s.t1, K, None)


@query
def ranking_checks(spark: SparkSession, folder: str) -> DataFrame:
    """The recommendations of a table, taken as rankings, held against the test cases."""
    s = Snapshot(spark, folder)
    edge = s.edge()
    flat = table(spark, folder, "topk_recommendations").select("user_id", F.explode("item_ids").alias("item_id")).dropna()
    return evaluation.ranking_violations(flat, s.locked(edge), edge)


@query
def first_seen(spark: SparkSession, folder: str) -> DataFrame:
    return snapshot.first_seen(snapshot.events(table(spark, folder, "interactions")))


@query
def shuffled_reviews(spark: SparkSession, folder: str) -> DataFrame:
    """A hundred reviews in a repeatable shuffle, those of training time first."""
    s = Snapshot(spark, folder)
    return snapshot.hash_ordered(s.clean.where("review_id is not null"), "review_id", F.col("timestamp") < s.t0, 100).select("review_id")


# Hybrids


def _parts(spark: SparkSession, folder: str) -> DataFrame:
    number = lambda c: F.coalesce(F.when(~F.isnan(c), F.col(c)), F.lit(0.0))
    rows = table(spark, folder, "hybrid_scores").where("user_id is not null and item_id is not null").groupBy("user_id", "item_id")
    named = {"mf": "normalized_mf", "graph": "normalized_graph", "aspect": "normalized_aspect", "support": "support"}
    one = rows.agg(*[F.max(c).alias(c) for c in named.values()], F.max("history_count").alias("history_count"))
    return one.select("user_id", "item_id", *[number(c).alias(a) for a, c in named.items()], F.coalesce("history_count", F.lit(0)).alias("history_count"))


@query
def scaled_scores(spark: SparkSession, folder: str) -> DataFrame:
    own = ["user_id"]
    rows = _parts(spark, folder)
    return rows.select("user_id", "item_id", F.round(normalise.percentile(F.col("mf"), own), 9).alias("by_rank"), F.round(normalise.min_max(F.col("mf"), own), 9).alias("by_range"))


@query
def fixed_hybrid(spark: SparkSession, folder: str) -> DataFrame:
    rows = normalise.fixed_hybrid(_parts(spark, folder), {"mf": 0.5, "graph": 0.25, "aspect": 0.25}, ["user_id"])
    return ranking.top_k(rows.select("user_id", "item_id", F.round("total_score", 9).alias("score")), K)


@query
def gated_hybrid(spark: SparkSession, folder: str) -> DataFrame:
    rows = normalise.gated_hybrid(_parts(spark, folder), ["user_id"])
    return ranking.top_k(rows.select("user_id", "item_id", F.round("total_score", 9).alias("score")), K)


# Evaluation


@query
def eval_exclusions(spark: SparkSession, folder: str) -> DataFrame:
    s = Snapshot(spark, folder)
    rows = evaluation.exclusions(s.edge(), s.clean.where(F.col("timestamp") >= s.t0), s.t1)
    return rows.groupBy(F.coalesce("reason", F.lit("case")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def _means(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("users"), *[F.round(F.avg(c), 9).alias(c) for c in rows.columns if c != "user_id"])


@query
def eval_popularity(spark: SparkSession, folder: str) -> DataFrame:
    """Mean metrics of the popularity ranking over all test users."""
    s = Snapshot(spark, folder)
    edge = s.edge()
    case = s.locked(edge)
    ranked = ranking.popular(case.select("user_id").distinct(), edge, s.t1, K)
    return _means(evaluation.metrics(ranked, case, [5, 10]))


@query
def eval_by_history(spark: SparkSession, folder: str) -> DataFrame:
    s = Snapshot(spark, folder)
    edge = s.edge()
    case = s.locked(edge)
    ranked = ranking.popular(case.select("user_id").distinct(), edge, s.t1, K, 365)
    rows = evaluation.by_history(evaluation.metrics(ranked, case, [10]), case, ["ndcg_10", "recall_10"])
    return rows.select("slice", "users", F.round("ndcg_10", 9).alias("ndcg_10"), F.round("recall_10", 9).alias("recall_10"))


@query
def eval_by_popularity(spark: SparkSession, folder: str) -> DataFrame:
    s = Snapshot(spark, folder)
    edge = s.edge()
    case = s.locked(edge)
    ranked = ranking.popular(case.select("user_id").distinct(), edge, s.t1, K)
    rows = evaluation.by_popularity(ranked, case, normalise.thirds(ranking.popularity(edge, s.t1)), [10])
    return rows.select("tertile", "users", "targets", F.round("ndcg_10", 9).alias("ndcg_10"), F.round("recall_10", 9).alias("recall_10"), F.round("precision_10", 9).alias("precision_10"))


@query
def popularity_thirds(spark: SparkSession, folder: str) -> DataFrame:
    s = Snapshot(spark, folder)
    return normalise.thirds(ranking.popularity(s.edge(), s.t1))


@query
def eval_diversity(spark: SparkSession, folder: str) -> DataFrame:
    s = Snapshot(spark, folder)
    edge = s.edge()
    ranked = ranking.popular(s.locked(edge).select("user_id").distinct(), edge, s.t1, K)
    aspects = table(spark, folder, "t4_2_evidence").select("item_id", "aspect").dropna().distinct()
    return evaluation.diversity(ranked, aspects, K).select("user_id", F.round("diversity", 9).alias("diversity"))


@query
def eval_bootstrap(spark: SparkSession, folder: str) -> DataFrame:
    s = Snapshot(spark, folder)
    edge = s.edge()
    case = s.locked(edge)
    users = case.select("user_id").distinct()
    both = [evaluation.metrics(ranking.popular(users, edge, s.t1, K, days), case, [10]).select("user_id", F.col("ndcg_10").alias(name)) for name, days in (("popular", None), ("recent", 365))]
    return evaluation.bootstrap(both[0].join(both[1], "user_id"), ["popular", "recent"], reference="popular")


# Evidence


class Said:
    """Observations of a folder, the cutoff at their nine tenths, and what they add up to."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.obs = written(evidence.observations(table(spark, folder, "t4_2_evidence")), "observations")
        self.cutoff = round(snapshot.exact_quantiles(self.obs, "timestamp", [0.9])[0] or 0)

    def contributions(self) -> DataFrame:
        return evidence.contributions(evidence.weighted(self.obs, self.cutoff, 365.0))

    def profiles(self, contrib: DataFrame) -> DataFrame:
        return evidence.profiles(contrib, evidence.priors(contrib))


@query
def evidence_weights(spark: SparkSession, folder: str) -> DataFrame:
    s = Said(spark, folder)
    return evidence.weighted(s.obs, s.cutoff, 365.0).select("evidence_id", F.round("weight", 9).alias("weight"))


@query
def aspect_priors(spark: SparkSession, folder: str) -> DataFrame:
    return evidence.priors(Said(spark, folder).contributions()).select("aspect", F.round("prior", 9).alias("prior"))


@query
def evidence_profiles(spark: SparkSession, folder: str) -> DataFrame:
    s = Said(spark, folder)
    rows = s.profiles(s.contributions())
    numbers = ["score", "support", "total_weight", "positive_mass", "negative_mass", "neutral_mass", "effective_sample_size"]
    return rows.select("item_id", "aspect", "author_count", "review_count", *[F.round(c, 8).alias(c) for c in numbers])


@query
def user_aspect_weights(spark: SparkSession, folder: str) -> DataFrame:
    s = Said(spark, folder)
    return evidence.user_weights(s.obs, s.cutoff, shared_prior=True).select("user_id", "aspect", F.round("weight", 9).alias("weight"))


@query
def aspect_match(spark: SparkSession, folder: str) -> DataFrame:
    s = Said(spark, folder)
    pairs = table(spark, folder, "hybrid_scores").select("user_id", "item_id").dropna()
    rows = evidence.aspect_match(pairs, evidence.user_weights(s.obs, s.cutoff), s.profiles(s.contributions()))
    return rows.select("user_id", "item_id", F.round("aspect_score", 8).alias("aspect_score"), F.round("aspect_support", 8).alias("aspect_support"))


def _claims(s: Said) -> tuple[DataFrame, DataFrame]:
    passage = written(evidence.passages(s.obs, s.cutoff), "passages")
    return passage, written(evidence.claims(passage, s.profiles(s.contributions())), "claims")


@query
def claim_facts(spark: SparkSession, folder: str) -> DataFrame:
    _, rows = _claims(Said(spark, folder))
    return rows.select("item_id", "aspect", "direction", "passages", "authors", "lacks", F.round("deviation", 8).alias("deviation"))


@query
def cited_passages(spark: SparkSession, folder: str) -> DataFrame:
    return evidence.cited(*_claims(Said(spark, folder)))


@query
def longest_passages(spark: SparkSession, folder: str) -> DataFrame:
    return evidence.longest(*_claims(Said(spark, folder)))


@query
def claim_thresholds(spark: SparkSession, folder: str) -> DataFrame:
    _, rows = _claims(Said(spark, folder))
    return evidence.threshold_grid(rows, [0.05, 0.1, 0.25], [1, 2, 5])


@query
def evidence_removal(spark: SparkSession, folder: str) -> DataFrame:
    s = Said(spark, folder)
    contrib = written(s.contributions(), "contributions")
    rows = evidence.removal(contrib, evidence.priors(contrib))
    return rows.select("item_id", "aspect", "other_aspect", F.round("before", 8).alias("before"), F.round("after", 8).alias("after"))


@query
def removal_medians(spark: SparkSession, folder: str) -> DataFrame:
    """The middle change of a deviation when an aspect's reviews are removed."""
    s = Said(spark, folder)
    contrib = written(s.contributions(), "contributions")
    rows = evidence.removal(contrib, evidence.priors(contrib)).where("aspect = other_aspect").select("aspect", F.abs(F.col("after") - F.col("before")).alias("change"))
    return evaluation.upper_medians(rows, ["aspect"], "change").select("aspect", F.round("median", 8).alias("median"))


@query
def claim_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Claims that stand and that don't, by aspect, by direction and in all."""
    _, rows = _claims(Said(spark, folder))
    marked = rows.withColumn("status", F.when(F.col("lacks") == "", "supported").otherwise("insufficient_support"))
    return evaluation.summary_sets(marked, ["aspect", "direction"], "status")


# Labels


@query
def located_evidence(spark: SparkSession, folder: str) -> DataFrame:
    rows = evidence.observations(table(spark, folder, "t4_2_evidence")).select("evidence_id", "text", "evidence")
    return labels.located(rows, "text", "evidence").select("evidence_id", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))


@query
def clause_split(spark: SparkSession, folder: str) -> DataFrame:
    return labels.clause_rows(snapshot.texts(table(spark, folder, "review_texts")), "review_id", "text")


@query
def lexicon_labels(spark: SparkSession, folder: str) -> DataFrame:
    return labels.lexicon_labels(snapshot.texts(table(spark, folder, "review_texts")), "review_id", "text")


@query
def word_matches(spark: SparkSession, folder: str) -> DataFrame:
    return labels.word_matches(snapshot.texts(table(spark, folder, "review_texts")), "review_id", "text", sql.WORDS).selectExpr("key AS review_id", "term")


@query
def merged_labels(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "t4_2_evidence").selectExpr("review_id", "aspect", "sentiment AS polarity", "start_offset - 20 AS start", "end_offset + 20 AS end").dropna()
    return labels.curated(rows, "review_id")


@query
def last_success(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "interactions").where("review_id is not null and ingested_at is not null")
    return labels.last_success(rows, "review_id", ["ingested_at", "timestamp", "user_id", "item_id"], F.col("rating").isNull()).select("review_id", "item_id", "timestamp")


@query
def quota_sample(spark: SparkSession, folder: str) -> DataFrame:
    rows = snapshot.events(table(spark, folder, "interactions"))
    picked = labels.quota_sample(rows, F.col("rating").cast("int"), [1, 2, 3, 4, 5], 15, 100, [F.col("timestamp").asc(), F.col("review_id").asc()])
    return picked.select("review_id", "rating", "picked")


@query
def pair_agreement(spark: SparkSession, folder: str) -> DataFrame:
    rows = evidence.observations(table(spark, folder, "t4_2_evidence"))
    found = labels.pair_agreement(rows.where("confidence >= 0.6"), rows.where("confidence <= 0.8"), "review_id", ["aspect", "sentiment"])
    return found.select("tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query
def valid_spans(spark: SparkSession, folder: str) -> DataFrame:
    found = labels.valid_spans(table(spark, folder, "t4_2_evidence"))
    return found.select("n_valid", "n", F.round("valid_rate", 9).alias("valid_rate"))


@query
def trained_sentiment(spark: SparkSession, folder: str) -> DataFrame:
    """How a classifier fitted on half of the evidence agrees with the other half."""
    rows = evidence.observations(table(spark, folder, "t4_2_evidence")).select("evidence", "sentiment").dropna()
    half = F.pmod(F.xxhash64("evidence"), F.lit(2))
    model = labels.trained_sentiment(rows.where(half == 0), "evidence", "sentiment")
    names = model.stages[0].labels
    told = model.transform(rows.where(half == 1).select(F.col("evidence").alias("text"), F.col("sentiment").alias("label_name")))
    named = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("prediction").cast("int") + 1)
    return told.groupBy("label_name", named.alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


# Serving


@query
def evidence_states(spark: SparkSession, folder: str) -> DataFrame:
    rows = evidence.observations(table(spark, folder, "t4_2_evidence")).selectExpr("item_id", "sentiment", "confidence - 0.4 AS support")
    return serving.evidence_state(rows, 0.25)


def _prepared(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    s = Said(spark, folder)
    rows = _parts(spark, folder).withColumn("aspect_weight", F.lit(0.25)).withColumn("aspect_part", 0.25 * F.col("aspect"))
    ranked = rows.select("user_id", "item_id", F.round(F.col("mf") * 0.5 + F.col("aspect_part"), 12).alias("total_score"), "aspect_part", "aspect_weight")
    aspects = s.profiles(s.contributions()).select("item_id", "aspect", F.col("score").alias("value"))
    return ranked, evidence.user_weights(s.obs, s.cutoff), aspects


@query
def temporary_priorities(spark: SparkSession, folder: str) -> DataFrame:
    ranked, weights, aspects = _prepared(spark, folder)
    return serving.reranked(ranked, weights, aspects, {"story": 1.0}, K).select("user_id", "item_id", F.round("total_score", 9).alias("total_score"))


@query
def rank_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Items of the fixed hybrid's first ten that the gated one ranks elsewhere."""
    return serving.rank_changes(fixed_hybrid(spark, folder), gated_hybrid(spark, folder))


# Streams


@query
def stream_daily_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Ingested interactions per day and item, as a stream that handles all files and stops."""
    source = stream.stream(spark, f"{folder}/interactions.parquet").where("ingested_at is not null and item_id is not null")
    rows = stream.run_to_end(stream.counted(source, "ingested_at", "item_id"))
    return rows.select(F.date_format("start", "yyyy-MM-dd").alias("day"), F.col("key").alias("item_id"), "n")


from quillrank.plans import explaining, explaining_sql, labelling, labelling_sql  # noqa: E402, F401  (add their queries)

ORACLE.update(explaining_sql.ORACLE)
ORACLE.update(labelling_sql.ORACLE)
