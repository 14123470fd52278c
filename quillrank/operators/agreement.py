"""How labels agree: F1 by label, spans that contain or lie nearest, target sentiment, and checks of records."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _rate(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def _scores(rows: DataFrame, name: str) -> DataFrame:
    out = rows.withColumn("precision", _rate(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", _rate(F.col("tp"), F.col("tp") + F.col("fn")))
    return out.withColumn("f1", _rate(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).select(name, "tp", "fp", "fn", "precision", "recall", "f1")


def multilabel(target: DataFrame, predicted: DataFrame, key: str, label: str, labels: list[str]) -> DataFrame:
    """``label, tp, fp, fn, precision, recall, f1`` of each of ``labels``, over all decisions (micro), and their plain mean (macro).

    Both sides count each (key, label) once. Predictions of keys that have no target row don't count; keys without a
    prediction are misses. Undefined rates are 0; a label that neither side has counts 0 in the mean.
    """
    t = target.select(F.col(key).alias("k"), F.col(label).alias("label")).where(F.col("label").isin(labels)).distinct().withColumn("t", F.lit(1))
    p = predicted.select(F.col(key).alias("k"), F.col(label).alias("label")).where(F.col("label").isin(labels)).distinct().withColumn("p", F.lit(1))
    p = p.join(target.select(F.col(key).alias("k")).distinct(), "k", "left_semi")
    both = t.join(p, ["k", "label"], "full_outer")
    counts = both.groupBy("label").agg(F.count_if(F.col("t").isNotNull() & F.col("p").isNotNull()).alias("tp"), F.count_if(F.col("t").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"))
    every = target.sparkSession.createDataFrame([(x,) for x in labels], "label string").join(counts, "label", "left").na.fill(0, ["tp", "fp", "fn"])
    own = _scores(every, "label")
    total = every.agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    micro = _scores(total.withColumn("label", F.lit("micro")), "label")
    macro = own.agg(F.lit("macro").alias("label"), *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")], *[F.avg(c).alias(c) for c in ("precision", "recall", "f1")])
    return own.unionByName(micro).unionByName(macro)


def target_sentiment(target: DataFrame, predicted: DataFrame, keys: list[str], label: str, classes: list[str]) -> DataFrame:
    """``scope, n, covered, accuracy, macro_f1`` for all targets and for those with an answer.

    A target without a prediction, or with none of the ``classes``, is an abstention: wrong among all targets, left out among the covered ones.
    """
    p = predicted.select(*keys, F.when(F.col(label).isin(classes), F.col(label)).alias("said"))
    rows = target.where(F.col(label).isin(classes)).select(*keys, F.col(label).alias("true")).join(p, keys, "left")
    sets = F.explode(F.array_compact(F.array(F.lit("all"), F.when(F.col("said").isNotNull(), F.lit("covered"))))).alias("scope")
    each = rows.select(sets, "true", "said")
    sums = []
    for c in classes:
        hit = F.count_if((F.col("true") == c) & (F.col("said") == c))
        sums.append(_rate(2 * hit, F.count_if(F.col("true") == c) + F.count_if(F.col("said") == c)))
    n = F.count(F.lit(1))
    return each.groupBy("scope").agg(n.alias("n"), F.count("said").alias("covered"), (F.count_if(F.col("true") == F.col("said")) / n).alias("accuracy"), (sum(sums[1:], sums[0]) / len(classes)).alias("macro_f1"))


def contained(target: DataFrame, predicted: DataFrame, key: str, text: str) -> DataFrame:
    """One row ``n, n_valid, n_comparable, n_contained``: predicted spans that are their text's slice, those of them with a target of the
    same aspect, and those that hold such a target whole.

    ``target`` has ``key, aspect, start, end``, ``predicted`` also the text and ``evidence``. Each predicted row counts once.
    """
    slice_ = F.substring(text, F.col("start") + 1, F.col("end") - F.col("start"))
    valid = (F.col("start") >= 0) & (F.col("start") <= F.col("end")) & (F.col("end") <= F.char_length(text)) & (slice_ == F.col("evidence"))
    rows = predicted.withColumn("valid", F.coalesce(valid, F.lit(False))).withColumn("row", F.xxhash64(*predicted.columns)).select(key, "aspect", "start", "end", "valid", "row")
    spans = target.select(key, "aspect", F.col("start").alias("s"), F.col("end").alias("e")).distinct()
    inside = (F.col("start") <= F.col("s")) & (F.col("s") <= F.col("e")) & (F.col("e") <= F.col("end"))
    met = rows.join(spans, [key, "aspect"], "left").groupBy(key, "row", "valid").agg(F.count("s").alias("met"), F.count_if(inside).alias("held"))
    good = F.col("valid") & (F.col("met") > 0)
    return met.agg(F.count(F.lit(1)).alias("n"), F.count_if("valid").alias("n_valid"), F.count_if(good).alias("n_comparable"), F.count_if(good & (F.col("held") > 0)).alias("n_contained"))


def nearest_spans(target: DataFrame, predicted: DataFrame, key: str) -> DataFrame:
    """``key, aspect, start, found``: each target's nearest predicted start of the same aspect that no target before it took.

    Both sides have ``key, aspect, start``. Targets go in order of their start, and of two equally near ones the first is taken; NULL where
    none is left. The choice depends on those before it, so a text's spans are matched in one place, by merging sorted lists.
    """
    kind = target.schema[key].dataType.simpleString()
    both = target.select(F.col(key).alias("key"), "aspect", "start", F.lit(True).alias("true")).unionByName(predicted.select(F.col(key).alias("key"), "aspect", "start", F.lit(False).alias("true")))
    grouped = both.where("key is not null and aspect is not null and start is not null").groupBy("key", "aspect").agg(
        F.sort_array(F.collect_list(F.when(F.col("true"), F.col("start")))).alias("t"), F.sort_array(F.collect_list(F.when(~F.col("true"), F.col("start")))).alias("p")
    )  # the spans of one text

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for k, aspect, wanted, free in zip(frame["key"], frame["aspect"], frame["t"], frame["p"], strict=True):
                left = [int(x) for x in free]
                for s in map(int, wanted):
                    best = min(range(len(left)), key=lambda i: (abs(left[i] - s), i), default=None)
                    out.append((k, aspect, s, None if best is None else left.pop(best)))
            yield pd.DataFrame(out, columns=["key", "aspect", "start", "found"]).astype({"found": "Int32"})

    return grouped.where(F.size("t") > 0).mapInPandas(run, f"key {kind}, aspect string, start int, found int")


def record_violations(df: DataFrame, required: list[str], text: str = "text", start: str = "start_offset", end: str = "end_offset", evidence: str = "evidence", aspects: list[str] | None = None, cutoff: int | None = None) -> DataFrame:
    """One row of counts, all 0 in sound records: missing fields, offsets outside the text, evidence that is no slice, unknown aspects, late rows."""
    missing = F.lit(False)
    for c in required:
        missing = missing | F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
    offsets = F.coalesce((F.col(start) < 0) | (F.col(start) > F.col(end)) | (F.col(end) > F.char_length(text)), F.lit(True))
    no_slice = ~F.coalesce(F.substring(text, F.col(start) + 1, F.col(end) - F.col(start)) == F.col(evidence), F.lit(False))
    unknown = ~F.coalesce(F.col("aspect").isin(aspects), F.lit(False)) if aspects else F.lit(False)
    late = F.coalesce(F.col("timestamp") >= cutoff, F.lit(True)) if cutoff is not None else F.lit(False)
    named = {"missing_fields": missing, "bad_offsets": offsets, "no_slice": no_slice, "unknown_aspects": unknown, "late_rows": late}
    return df.agg(*[F.count_if(c).alias(a) for a, c in named.items()])


def assert_records(df: DataFrame, **rules) -> None:
    held = record_violations(df, **rules).first().asDict()
    if any(held.values()):
        raise ValueError(f"unsound records: {held}")


def record_differences(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``column_name, n``: in how many keys the two sides differ in each column, NULL being equal to NULL, and how many keys only one has."""
    left = a.select(F.col(key).alias("k"), F.struct(*columns).alias("l"))
    both = left.join(b.select(F.col(key).alias("k"), F.struct(*columns).alias("r")), "k", "full_outer")
    paired = F.col("l").isNotNull() & F.col("r").isNotNull()
    one = both.agg(*[F.count_if(paired & ~F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))).alias(c) for c in columns], F.count_if(F.col("r").isNull()).alias("__only_left"), F.count_if(F.col("l").isNull()).alias("__only_right"))
    names = [*columns, "__only_left", "__only_right"]
    return one.select(F.inline(F.array(*[F.struct(F.lit(n.removeprefix("__")).alias("column_name"), F.col(n).alias("n")) for n in names])))


def suggestions(df: DataFrame, key: str, text: str, terms: dict[str, tuple[str, ...]]) -> DataFrame:
    """``key, aspect``: the aspects of which a text holds a term anywhere, also inside a word; a weak hint, all in the JVM."""
    low = F.lower(text)
    hits = [F.when(F.greatest(*[F.contains(low, F.lit(t)) for t in (*words, *words[:1])]), F.lit(a)) for a, words in terms.items()]
    return df.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.explode(F.array_compact(F.array(*hits))).alias("aspect"))


def labelling_summary(labels: DataFrame) -> DataFrame:
    """``name, n``: texts and labels, refusals by reason, and labels by aspect and polarity, of the rows of lexicon labels."""
    pairs = F.array_compact(F.array(
        F.when(F.col("refusal").isNotNull(), F.concat(F.lit("refusal:"), "refusal")), F.when(F.col("aspect").isNotNull(), F.concat(F.lit("aspect:"), "aspect")),
        F.when(F.col("polarity").isNotNull(), F.concat(F.lit("polarity:"), "polarity")), F.when(F.col("aspect").isNotNull(), F.lit("labels")),
    ))
    counts = labels.select(F.explode(pairs).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    return counts.unionByName(labels.agg(F.lit("texts").alias("name"), F.count_distinct("key").alias("n")))


def aspect_models(df: DataFrame, text: str, aspects: list[str], key: str, label: str, group: str | None = None, rows: int = 200_000, folds: int = 3, seed: int = 7) -> dict[str, object]:
    """For each aspect a linear SVM over word 1- and 2-grams that tells whether a text speaks of it, with calibrated probabilities.

    ``df`` has a row per (text, aspect). Calibration is a logistic regression over scores of texts whose ``group`` was held out of
    the fit (``folds`` parts by the group's hash). An aspect that all or no texts have has no model but its constant (True or False); one without
    both classes in every part has no calibration. At most ``rows`` texts are fitted on, in the order of their hash.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LinearSVC, LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF, NGram, Normalizer, RegexTokenizer, SQLTransformer, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    own = df.groupBy(F.col(key).alias("key")).agg(F.min(text).alias("text"), F.collect_set(label).alias("own"), F.min(F.col(group or key).cast("string")).alias("grp"))
    sample = own.where("text is not null").orderBy(F.xxhash64("text", F.lit(seed)), "key").limit(rows).withColumn("fold", F.pmod(F.xxhash64("grp"), F.lit(folds))).cache()

    def fitted(part: DataFrame):
        stages = [
            RegexTokenizer(inputCol="text", outputCol="words", pattern=r"(?U)\W+"), NGram(n=2, inputCol="words", outputCol="pairs"),
            SQLTransformer(statement="SELECT *, concat(words, pairs) AS grams FROM __THIS__"), HashingTF(inputCol="grams", outputCol="tf", numFeatures=1 << 16),
            IDF(inputCol="tf", outputCol="weighted"), Normalizer(inputCol="weighted", outputCol="features"), LinearSVC(maxIter=20, regParam=0.01),
        ]
        return Pipeline(stages=stages).fit(part)

    out: dict[str, object] = {}
    for a in aspects:  # a closed list
        part = sample.withColumn("label", F.array_contains("own", a).cast("double"))
        held = {(r["fold"], r["label"]) for r in part.select("fold", "label").distinct().collect()}
        seen = {x for _, x in held}
        if len(seen) < 2:
            out[a] = 1.0 in seen
            continue
        calibration = None
        if len(held) == 2 * folds:
            scored = None
            for k in range(folds):
                told = fitted(part.where(F.col("fold") != k)).transform(part.where(F.col("fold") == k)).select("label", vector_to_array("rawPrediction")[1].alias("score"))
                scored = told if scored is None else scored.unionByName(told)
            calibration = LogisticRegression(featuresCol="v").fit(VectorAssembler(inputCols=["score"], outputCol="v").transform(scored))
        out[a] = (fitted(part), calibration)
    sample.unpersist()
    return out
