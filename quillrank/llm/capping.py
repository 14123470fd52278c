"""At most so many records per contributor, the best ones first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillrank.operators.skew import positions
from quillrank.runtime import bounded, written

#: Pieces into which a contributor's records are spread before the final ranking.
SALTS = 64
#: Records of one contributor that a single task may rank.
TASK_ROWS = 1 << 18


def verdicts(
    df: DataFrame, contributor: str, score: str, record: str, cap: int | None = 5, share: float | None = None, salts: int = SALTS, only: bool | None = None, task_rows: int = TASK_ROWS
) -> DataFrame:
    """``record, contributor, kept`` for each distinct record that has a contributor.

    Kept are a contributor's ``cap`` records with the highest score, equal ones by the smaller
    record id; with ``share`` the cap is that part of all distinct records (at least one), with both
    the smaller of the two. Scores that are NULL, NaN or outside 0..1 come after all others, among
    themselves by record id. Copies of a record count once, by their best score. Records without
    a contributor are never dropped and have no row here; NULL record ids are no records.
    ``only`` limits the result to the kept (True) or the dropped (False) records.

    Records are first ranked inside (contributor, salt), the salt being taken from the record id:
    a record beyond the cap there is beyond it overall, so at most ``cap`` records a salt
    reach the second ranking. Contributors with more than ``task_rows`` rows have as many salts as keep a salt
    below that, and what is left of them is ranked over sorted ranges, so that a large cap doesn't bring them into one task.
    """
    owned = df.where(F.col(contributor).isNotNull() & F.col(record).isNotNull())
    if share is not None:
        part = F.greatest(F.lit(1), F.floor(F.lit(share) * df.where(F.col(record).isNotNull()).select(F.count_distinct(record)).scalar()))
        limit = F.least(part, F.lit(cap)) if cap is not None else part
    else:
        limit = F.lit(cap)
    value = F.when(F.col(score).between(0, 1), F.col(score).cast("double") + 0.0)
    narrow = owned.select(F.col(contributor).alias("contributor"), F.col(record).alias("record"), value.alias("score"))
    best = [F.col("score").desc_nulls_last(), F.col("record").asc()]

    def preranked(rows: DataFrame, of: object) -> DataFrame:
        salted = rows.withColumn("salt", F.pmod(F.xxhash64("record"), of))
        once = salted.repartition("contributor", "salt").groupBy("contributor", "salt", "record").agg(F.max("score").alias("score"))
        return once.withColumn("at", F.row_number().over(W.partitionBy("contributor", "salt").orderBy(*best)))

    def verdict(first: DataFrame, again) -> DataFrame:
        second = again(first.where(F.col("at") <= limit))
        if only is True:
            return second.where(F.col("at") <= limit).select("record", "contributor", F.lit(True).alias("kept"))
        ranked = second.withColumn("kept", F.col("at") <= limit)
        beyond = first.where(F.col("at") > limit).withColumn("kept", F.lit(False))
        return beyond.unionByName(ranked.where(~F.col("kept")) if only is False else ranked).select("record", "contributor", "kept")

    large = written(narrow.groupBy("contributor").agg(F.count(F.lit(1)).alias("held")).where(F.col("held") > task_rows), "large-contributors")
    some = not large.isEmpty()
    usual = narrow.join(bounded(large), "contributor", "left_anti") if some else narrow
    out = verdict(preranked(usual, F.lit(salts)), lambda left: left.withColumn("at", F.row_number().over(W.partitionBy("contributor").orderBy(*best))))
    if some:
        hot = narrow.join(bounded(large), "contributor")
        first = written(preranked(hot, F.greatest(F.lit(salts), F.ceil(F.col("held") / task_rows))), "preranked")
        out = out.unionByName(verdict(first, lambda left: positions(left.drop("at"), ["contributor"], best, "at")))
    return out


def capped(df: DataFrame, contributor: str, score: str, record: str, cap: int | None = 5, share: float | None = None, salts: int = SALTS, task_rows: int = TASK_ROWS) -> DataFrame:
    """The records of ``df`` that stay, one row each, with all their columns.

    Rules as in :func:`verdicts`; records without a contributor stay, rows without a record id too.
    Of copies that differ in other columns the one stays that is smallest as JSON, whatever the scheduling.
    """
    kept = verdicts(df, contributor, score, record, cap, share, salts, True, task_rows).select(F.col("record").alias("__record"), F.col("contributor").alias("__contributor"))
    stay = df.join(kept, (F.col(record) == F.col("__record")) & (F.col(contributor) == F.col("__contributor")), "left_semi")
    rest = df.where(F.col(record).isNotNull() & F.col(contributor).isNull())
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    one = stay.unionByName(rest).groupBy(F.col(record).alias("__r"), F.col(contributor).alias("__c")).agg(F.min_by(row, F.to_json(row)).alias("__row"))
    return one.select("__row.*").unionByName(df.where(F.col(record).isNull()))
