"""Time-safe snapshots: one row per event, exact cutoffs, splits and first-event targets."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Buckets into which a value range is cut in each pass of the exact quantile search.
BUCKETS = 1 << 15


def one_per_key(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order, NULL keys being a key."""
    at = F.row_number().over(W.partitionBy(*key).orderBy(*order))
    return df.withColumn("__at", at).where(F.col("__at") == 1).drop("__at")


def events(df: DataFrame) -> DataFrame:
    """``review_id, user_id, item_id, rating, timestamp`` of valid interactions, one row per review.

    Rows with a NULL or blank user or item or without a time are left out; of redelivered rows the one that is
    first by time, user, item and rating stays.
    """
    named = df.select("review_id", "user_id", "item_id", F.col("rating").cast("double").alias("rating"), "timestamp")
    valid = named.where((F.trim("user_id") != "") & (F.trim("item_id") != "") & F.col("timestamp").isNotNull())
    return one_per_key(valid, ["review_id"], [F.col(c).asc_nulls_first() for c in ("timestamp", "user_id", "item_id", "rating")])


def texts(df: DataFrame) -> DataFrame:
    """Review texts, one row per review: the first by time, item and text."""
    return one_per_key(df, ["review_id"], [F.col(c).asc_nulls_first() for c in ("timestamp", "item_id", "text")])


def first_events(df: DataFrame) -> DataFrame:
    """The first event of each user with each item, by time and review."""
    return one_per_key(df, ["user_id", "item_id"], [F.col("timestamp").asc(), F.col("review_id").asc_nulls_first()])


def exact_quantiles(df: DataFrame, column: str, probabilities: list[float]) -> list[float | None]:
    """Continuous quantiles (linear between neighbours) of a whole-number column, exactly.

    The value range is cut into a fixed number of buckets, the bucket of each wanted rank is cut again, and
    so on: a few counting passes, and never more than ``BUCKETS`` counts per rank at the driver. NULLs don't count;
    without values all quantiles are None.
    """
    values = df.select(F.col(column).cast("bigint").alias("v")).where("v is not null")
    low, high, n = values.agg(F.min("v"), F.max("v"), F.count(F.lit(1))).first()
    if not n:
        return [None] * len(probabilities)
    at = [(n - 1) * p for p in probabilities]
    ranks = sorted({r for a in at for r in (math.floor(a), math.ceil(a))})
    found: dict[int, int] = {}
    open_ = {r: (low, high, 0) for r in ranks}  # rank: value range and rows below it
    while open_:
        ranges = sorted({(a, b) for a, b, _ in open_.values()})  # equal or apart, never overlapping
        width = {r: max(1, -(-(r[1] - r[0] + 1) // BUCKETS)) for r in ranges}
        number, bucket = F.lit(None).cast("int"), F.lit(None).cast("bigint")
        for i, (a, b) in enumerate(ranges):
            inside = F.col("v").between(a, b)
            number = F.when(inside, F.lit(i)).otherwise(number)
            bucket = F.when(inside, F.floor((F.col("v") - a) / width[a, b])).otherwise(bucket)
        rows = values.select(number.alias("i"), bucket.alias("k")).where("i is not null").groupBy("i", "k").agg(F.count(F.lit(1)).alias("n")).collect()
        for rank, (a, b, below) in list(open_.items()):
            i = ranges.index((a, b))
            for k, n in sorted((r["k"], r["n"]) for r in rows if r["i"] == i):
                if below + n > rank:
                    start = a + k * width[a, b]
                    if width[a, b] == 1:
                        found[rank] = start
                        del open_[rank]
                    else:
                        open_[rank] = (start, min(b, start + width[a, b] - 1), below)
                    break
                below += n
    return [found[math.floor(a)] * (1 - (a - math.floor(a))) + found[math.ceil(a)] * (a - math.floor(a)) for a in at]


def cutoffs(clean: DataFrame, first: float = 0.8, second: float = 0.9) -> tuple[int, int]:
    """The two times that part training from validation and validation from test."""
    a, b = exact_quantiles(clean, "timestamp", [first, second])
    if a is None or round(a) >= round(b):
        raise ValueError("the events don't have two different cutoffs")
    return round(a), round(b)


def before(df: DataFrame, cutoff: int) -> DataFrame:
    return df.where(F.col("timestamp") < cutoff)


def targets(clean: DataFrame, start: int, end: int | None = None, threshold: float = 4.0) -> DataFrame:
    """First events in ``[start, end)`` with a rating of at least ``threshold``, of items known before ``start``
    that their user had not met before it. A later better rating makes no target."""
    window = F.col("timestamp") >= start
    if end is not None:
        window = window & (F.col("timestamp") < end)
    past = before(clean, start)
    chosen = first_events(clean).where(window & (F.col("rating") >= threshold))
    known = chosen.join(past.select("item_id").distinct(), "item_id", "left_semi")
    return known.join(past.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti").select(*clean.columns)


def counts(clean: DataFrame, first: int, second: int) -> DataFrame:
    """Events, users and items in all and before each cutoff: ``part, n_events, n_users, n_items``."""
    parts = F.array(F.lit("all"), F.when(F.col("timestamp") < first, F.lit("train")), F.when(F.col("timestamp") < second, F.lit("fit")))
    rows = clean.select(F.explode(parts).alias("part"), "user_id", "item_id").where("part is not null")
    return rows.groupBy("part").agg(F.count(F.lit(1)).alias("n_events"), F.count_distinct("user_id").alias("n_users"), F.count_distinct("item_id").alias("n_items"))


def rating_histogram(df: DataFrame) -> DataFrame:
    """Rows per rating as stored, NULL included."""
    return df.groupBy("rating").agg(F.count(F.lit(1)).alias("n"))


def missingness(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column_name, n_rows, n_missing, share``: NULL, blank or empty-list values of each column, in one pass."""
    missing = [F.count_if(F.col(c).isNull() | F.trim(F.col(c).cast("string")).isin("", "[]")).alias(c) for c in columns]
    one = df.agg(F.count(F.lit(1)).alias("n_rows"), *missing)
    names = ", ".join(f"'{c}', `{c}`" for c in columns)
    long = one.selectExpr("n_rows", f"stack({len(columns)}, {names}) AS (column_name, n_missing)")
    return long.select("column_name", "n_rows", "n_missing", F.round(F.col("n_missing") / F.col("n_rows"), 6).alias("share"))


def retention(clean: DataFrame, start: int, end: int | None) -> DataFrame:
    """How many users with history come back with a new, liked, known item: one row of counts."""
    past = before(clean, start)
    history = past.groupBy("user_id").agg(F.count_distinct("item_id").alias("items"))
    window = F.col("timestamp") >= start
    if end is not None:
        window = window & (F.col("timestamp") < end)
    pairs = clean.where(window & (F.col("rating") >= 4)).select("user_id", "item_id").distinct()
    eligible = pairs.join(past.select("item_id").distinct(), "item_id", "left_semi").join(past.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")
    groups = history.agg(
        F.count(F.lit(1)).alias("users_with_history"),
        F.count_if(F.col("items") <= 2).alias("history_1_2"),
        F.count_if(F.col("items").between(3, 5)).alias("history_3_5"),
        F.count_if(F.col("items") > 5).alias("history_more"),
    )
    coming = eligible.agg(F.count_distinct("user_id").alias("eligible_users"), F.count(F.lit(1)).alias("target_pairs"))
    known = past.agg(F.count_distinct("item_id").alias("known_items"))
    return groups.join(coming, F.lit(True)).join(known, F.lit(True))  # one row each


def first_seen(df: DataFrame, key: str = "item_id") -> DataFrame:
    """When each key was met first and last, and how often."""
    return df.groupBy(key).agg(F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"), F.count(F.lit(1)).alias("n"))


def hash_ordered(df: DataFrame, key: str, early: Column, limit: int) -> DataFrame:
    """The first ``limit`` rows in a repeatable shuffle: early ones first, then by the hash of the key."""
    return df.orderBy(F.coalesce(early, F.lit(False)).desc(), F.sha2(key, 256), key).limit(limit)


def with_metadata(df: DataFrame, metadata: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows whose item the catalogue has, with ``columns`` of its last row: the greatest by those columns, whatever the scheduling."""
    whole = F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"o{i}") for i, c in enumerate(columns)])
    one = metadata.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*columns), whole).alias("__m"))
    return df.join(one, key).select(*df.columns, *[F.col(f"__m.{c}").alias(c) for c in columns if c not in df.columns])


def attached(texts: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Texts with the user of their event, and one row of counts: texts without an event, texts of another item than their event, texts attached.

    The second is for a check before the first is used (:func:`attached_or_raise`): texts of another item are left out here.
    """
    own = events.select("review_id", "user_id", F.col("item_id").alias("__item"), F.col("timestamp").alias("event_time")).where("review_id is not null")
    rows = texts.where("review_id is not null").join(own, "review_id", "left")
    same = F.col("item_id").eqNullSafe(F.col("__item"))
    checks = rows.agg(F.count_if(F.col("__item").isNull()).alias("without_event"), F.count_if(F.col("__item").isNotNull() & ~same).alias("other_item"), F.count_if(F.col("__item").isNotNull() & same).alias("attached"))
    return rows.where(F.col("__item").isNotNull() & same).drop("__item"), checks


def attached_or_raise(texts: DataFrame, events: DataFrame) -> DataFrame:
    """Texts with the user of their event; a text whose event has another item is an error."""
    rows, checks = attached(texts, events)
    n = checks.first()["other_item"]
    if n:
        raise ValueError(f"{n} texts belong to another item than their event")
    return rows


def found_or_raise(texts: DataFrame, wanted: DataFrame, key: str = "review_id") -> DataFrame:
    """The texts of the wanted keys; a key without a text is an error."""
    keys = wanted.select(key).where(F.col(key).isNotNull()).distinct()
    missing = keys.join(texts.select(key), key, "left_anti").count()
    if missing:
        raise ValueError(f"{missing} values of {key} have no text")
    return texts.join(keys, key, "left_semi")


def fresh_texts(texts: DataFrame, events: DataFrame, pilot: DataFrame) -> DataFrame:
    """Texts with an event that are not in the pilot and not of the item and duplicate group of one of its texts, NULL groups being equal."""
    groups = texts.join(pilot.select("review_id").distinct(), "review_id", "left_semi").select(F.col("item_id").alias("__i"), F.col("duplicate_group").alias("__g")).distinct()
    own = events.select("review_id", "user_id").where("review_id is not null")
    rows = texts.join(own, "review_id").join(pilot.select("review_id").distinct(), "review_id", "left_anti")
    # NULLs are one value of a key that is never NULL, so the join stays an equality.
    key = lambda i, g: F.struct(F.coalesce(i, F.lit("")), i.isNull(), F.coalesce(g, F.lit("")), g.isNull())
    return rows.join(groups, key(F.col("item_id"), F.col("duplicate_group")) == key(F.col("__i"), F.col("__g")), "left_anti")


def most_frequent(df: DataFrame, column: str, n: int) -> DataFrame:
    """``column, n``: the ``n`` most frequent values, equal ones by value; NULLs don't count."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.col("n").desc(), F.col(column).asc()).limit(n)


def json_list(df: DataFrame, key: str, column: str) -> DataFrame:
    """``key, place, value``: the entries of a JSON list, from 0; what is no list or broken has none."""
    return df.select(key, F.posexplode(F.from_json(column, "array<string>")).alias("place", "value"))


def one_per_parent(df: DataFrame, labels: str, fields: list[str]) -> DataFrame:
    """Rows with a list of labels as one row per label, its fields going before the parent's; rows without a list pass as they are."""
    inner = {f.name for f in df.schema[labels].dataType.elementType.fields}
    rows = df.withColumn("__l", F.explode_outer(labels)).drop(labels)
    own = [F.coalesce(F.col(f"__l.{f}"), F.col(f)).alias(f) if f in inner and f in df.columns else F.col(f"__l.{f}").alias(f) if f in inner else F.col(f) for f in fields]
    return rows.select(*own)


def limited(clean: DataFrame, rows: int) -> DataFrame:
    """The first ``rows`` events by time, user, item and review: a pilot of a snapshot."""
    return clean.orderBy(F.col("timestamp"), F.col("user_id"), F.col("item_id"), F.col("review_id")).limit(rows)
