"""The best N distinct items of every group, however large a group is."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows a task holds before it cuts its heaps back to N items a group.
HELD_ROWS = 1 << 18


def _cut(rows: pa.Table, n: int) -> pa.Table:
    """Each group's N best distinct items by (score, then smaller item)."""
    best = rows.group_by(["g", "i"]).aggregate([("s", "max")]).rename_columns(["g", "i", "s"])
    best = best.take(pc.sort_indices(best, [("g", "ascending"), ("s", "descending"), ("i", "ascending")]))
    codes = best["g"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.zeros(0, int)
    within = np.arange(len(codes)) - np.repeat(starts, np.diff(np.r_[starts, len(codes)]))
    return best.filter(pa.array(within < n))


def _heaps(n: int):
    """Partial state of a task: the heaps of all groups met so far, as one table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count > HELD_ROWS:
                state = _cut(pa.Table.from_batches(held), n)
                if state.num_rows > HELD_ROWS // 2:  # many groups: hand them on, the merge is associative
                    yield from state.combine_chunks().to_batches()
                    held, count = [], 0
                else:
                    held, count = state.to_batches(), state.num_rows
        if count:
            yield from _cut(pa.Table.from_batches(held), n).combine_chunks().to_batches()

    return run


def best_items(df: DataFrame, group: str, item: str, score: str, n: int) -> DataFrame:
    """``group, item, score, position``: each group's ``n`` distinct items with the highest score.

    An item's score is its highest; equal scores are ordered by the smaller item. Rows with a NULL
    group, a NULL item or a NULL or NaN score don't count; groups with fewer items give all of them.

    Every task keeps a heap of ``n`` items per group it meets and only the heaps are shuffled, so a
    group with most of the rows sends at most ``n`` rows per task.
    """
    kind = {f: df.schema[f].dataType.simpleString() for f in (group, item)}
    rows = df.select(F.col(group).alias("g"), F.col(item).alias("i"), (F.col(score).cast("double") + 0.0).alias("s")).where("g is not null and i is not null and s is not null and not isnan(s)")
    partial = rows.mapInArrow(_heaps(n), f"g {kind[group]}, i {kind[item]}, s double")
    merged = partial.repartition("g").groupBy("g", "i").agg(F.max("s").alias("s"))
    at = F.row_number().over(W.partitionBy("g").orderBy(F.col("s").desc(), F.col("i").asc()))
    ranked = merged.withColumn("position", at).where(F.col("position") <= n)
    return ranked.select(F.col("g").alias(group), F.col("i").alias(item), F.col("s").alias(score), "position")


def best_of_arrays(df: DataFrame, group: str, items: str, scores: str, n: int) -> DataFrame:
    """:func:`best_items` over rows that hold parallel arrays: ``group, item, score, position``.

    Positions without a partner in the other array don't count; NULL and empty arrays hold nothing.
    """
    pairs = df.select(F.col(group).alias("g"), F.explode(F.arrays_zip(F.col(items).alias("i"), F.col(scores).alias("s"))).alias("p"))
    flat = pairs.select(F.col("g").alias(group), F.col("p.i").alias("item"), F.col("p.s").alias("score"))
    return best_items(flat, group, "item", "score", n)
