"""Queries over labels and their agreement, and over joined texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.operators import agreement, evidence, labels, snapshot
from quillrank.plans.catalogue import Said, Snapshot, query
from quillrank.runtime import table, written

POLARITIES = ["positive", "negative", "neutral"]


def _units(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "eval_units").select("unit_id", "text", "aspect", "split_role", "label_status")


@query
def weak_aspects(spark: SparkSession, folder: str) -> DataFrame:
    """Aspects of which a review holds a term, anywhere."""
    return agreement.suggestions(snapshot.texts(table(spark, folder, "review_texts")), "review_id", "text", labels.ASPECT_TERMS).selectExpr("key AS review_id", "aspect")


@query
def aspect_f1(spark: SparkSession, folder: str) -> DataFrame:
    """The weak hints against the held-out units' aspects."""
    units = _units(spark, folder)
    said = agreement.suggestions(units, "unit_id", "text", labels.ASPECT_TERMS).withColumnRenamed("key", "unit_id")
    rows = agreement.multilabel(units, said, "unit_id", "aspect", list(labels.ASPECTS))
    return rows.select("label", "tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


def _two(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Two readings of one review and aspect: its first and its last evidence."""
    rows = evidence.observations(table(spark, folder, "t4_2_evidence"))
    pick = lambda f: rows.groupBy("review_id", "aspect").agg(f("sentiment", "evidence_id").alias("sentiment"))
    return pick(F.min_by), pick(F.max_by)


@query
def sentiment_f1(spark: SparkSession, folder: str) -> DataFrame:
    first, last = _two(spark, folder)
    unsure = F.when(F.pmod(F.length("review_id") + F.ascii("review_id"), F.lit(5)) != 0, F.col("sentiment"))
    rows = agreement.target_sentiment(first, last.withColumn("sentiment", unsure), ["review_id", "aspect"], "sentiment", POLARITIES)
    return rows.select("scope", "n", "covered", F.round("accuracy", 9).alias("accuracy"), F.round("macro_f1", 9).alias("macro_f1"))


@query
def contained_spans(spark: SparkSession, folder: str) -> DataFrame:
    rows = evidence.observations(table(spark, folder, "t4_2_evidence")).selectExpr("evidence_id", "review_id", "aspect", "start_offset AS start", "end_offset AS end", "text", "evidence", "confidence")
    sure = rows.where("confidence >= 0.6")
    return agreement.contained(sure, rows.where("confidence < 0.8").drop("confidence"), "review_id", "text")


@query
def nearest_spans(spark: SparkSession, folder: str) -> DataFrame:
    """First clauses' starts and the nearest starts of other evidence of the review and aspect."""
    rows = evidence.observations(table(spark, folder, "t4_2_evidence")).selectExpr("review_id", "aspect", "start_offset AS start", "confidence")
    return agreement.nearest_spans(rows.where("confidence >= 0.6"), rows.where("confidence < 0.8"), "review_id").withColumnRenamed("key", "review_id")


@query
def record_checks(spark: SparkSession, folder: str) -> DataFrame:
    s = Said(spark, folder)
    return agreement.record_violations(table(spark, folder, "t4_2_evidence"), ["evidence_id", "review_id", "item_id", "author_id", "sentiment"], aspects=list(labels.ASPECTS), cutoff=s.cutoff)


@query
def record_differences(spark: SparkSession, folder: str) -> DataFrame:
    first, last = _two(spark, folder)
    key = lambda rows: rows.withColumn("unit", F.concat_ws("|", "review_id", "aspect"))
    return agreement.record_differences(key(first), key(last), "unit", ["aspect", "sentiment"])


@query
def labelling_counts(spark: SparkSession, folder: str) -> DataFrame:
    return agreement.labelling_summary(labels.lexicon_labels(snapshot.texts(table(spark, folder, "review_texts")), "review_id", "text"))


@query
def attached_authors(spark: SparkSession, folder: str) -> DataFrame:
    """Texts before the test time with the author and item of their event."""
    s = Snapshot(spark, folder)
    rows, _ = snapshot.attached(snapshot.texts(table(spark, folder, "review_texts")), snapshot.before(s.clean, s.t1))
    return rows.select("review_id", "item_id", "user_id")


@query
def attached_checks(spark: SparkSession, folder: str) -> DataFrame:
    s = Snapshot(spark, folder)
    return snapshot.attached(snapshot.texts(table(spark, folder, "review_texts")), snapshot.before(s.clean, s.t1))[1]


@query
def catalogued_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events with the brand of their item's last catalogue row."""
    found = table(spark, folder, "item_metadata").where("metadata_found")
    rows = snapshot.with_metadata(snapshot.events(table(spark, folder, "interactions")), found, "item_id", ["parent_asin", "title", "brand"])
    return rows.select("review_id", "item_id", "brand", "title")


@query
def fresh_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Texts that are neither in a pilot nor copies of its texts."""
    s = Snapshot(spark, folder)
    texts = written(snapshot.texts(table(spark, folder, "review_texts")), "texts")
    pilot = labels.quota_sample(s.clean, F.col("rating").cast("int"), [1, 2, 3, 4, 5], 15, 100, [F.col("timestamp").asc(), F.col("review_id").asc()]).select("review_id")
    return snapshot.fresh_texts(texts, s.clean, pilot).select("review_id", "item_id", "user_id")


@query
def item_label_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Catalogue items with the evidence they have, 0 where there is none."""
    said = evidence.observations(table(spark, folder, "t4_2_evidence")).groupBy("item_id").agg(F.count(F.lit(1)).alias("labels"), F.count_distinct("review_id").alias("reviews"))
    items = table(spark, folder, "item_metadata").select("item_id").dropna().distinct()
    return items.join(said, "item_id", "left").na.fill(0, ["labels", "reviews"])


@query
def curation_counts(spark: SparkSession, folder: str) -> DataFrame:
    """What curation did: spans given, in conflict, merged and left."""
    rows = table(spark, folder, "t4_2_evidence").selectExpr("review_id", "aspect", "sentiment AS polarity", "start_offset AS start", "end_offset AS end").dropna()
    return labels.curation_counts(rows, "review_id")


@query
def metadata_profile(spark: SparkSession, folder: str) -> DataFrame:
    """The ten most frequent categories, and lengths of titles."""
    return snapshot.most_frequent(table(spark, folder, "item_metadata"), "main_category", 10)


@query
def title_lengths(spark: SparkSession, folder: str) -> DataFrame:
    n = F.char_length("title")
    return table(spark, folder, "item_metadata").where("title is not null").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(n), 9).alias("mean_chars"), F.percentile(n, F.lit(0.5)).alias("median_chars"))


@query
def retention_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Users who come back in the validation and in the test window."""
    s = Snapshot(spark, folder)
    rows = [snapshot.retention(s.clean, a, b).withColumn("window", F.lit(n)) for n, a, b in (("validation", s.t0, s.t1), ("test", s.t1, None))]
    return rows[0].unionByName(rows[1])


@query
def listing_features(spark: SparkSession, folder: str) -> DataFrame:
    """The features of the listings, one row each; broken or other JSON has none."""
    return snapshot.json_list(table(spark, folder, "item_metadata").select("item_id", "features_json").dropna(subset=["item_id"]).distinct(), "item_id", "features_json")


@query
def parsed_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Answers of a model in JSON, made of the evidence, with text around them, read again."""
    rows = evidence.observations(table(spark, folder, "t4_2_evidence")).where("evidence is not null")
    one = F.struct(F.lit(1).alias("id"), F.lit(False).alias("out_of_scope"), F.array(F.struct("aspect", F.col("sentiment").alias("polarity"), "evidence")).alias("labels"))
    told = rows.select("evidence_id", F.concat(F.lit('I first thought {"reviews": [{"id": 9}]} but: '), F.to_json(F.struct(F.array(one).alias("reviews"))), F.lit(" That is all.")).alias("answer"))
    return labels.answered(told, "evidence_id", "answer").selectExpr("key AS evidence_id", "id", "aspect", "polarity", "evidence")
