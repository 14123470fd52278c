"""Per-key aggregates and ranks when a handful of keys hold most of the rows."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillrank.runtime import bounded, partitions, written

#: Rows of one key that a single task may hold.
CHUNK_ROWS = 1 << 16


def _placed(df: DataFrame, columns: list[Column], rows: int) -> DataFrame:
    """The columns with ``__part`` and ``__row``: where a row lies in its input, whatever the scheduling.

    Rows of Parquet files get their file and a block of ``rows`` row numbers, which stay the same when a lost task runs
    again. Other inputs have no such place, so they are written once with Spark's partition and a running number.
    """
    try:
        at = df.select(*columns, F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
        at.schema  # noqa: B018  (analyses the plan)
    except AnalysisException:  # no file source below
        return written(df.select(*columns, F.spark_partition_id().cast("long").alias("__part"), F.monotonically_increasing_id().alias("__row")), "placed")
    return at.withColumn("__part", F.xxhash64("__file", F.floor(F.col("__row") / F.lit(rows)))).drop("__file")


def _keyed(df: DataFrame, key_columns: list[str], value: str, chunk_rows: int) -> DataFrame:
    """``value, __part, __row, key_name, code`` of every row, once per key column. ``code`` is never NULL."""
    codes = [F.coalesce(F.concat(F.lit("="), F.col(k).cast("string")), F.lit("~")).alias(f"k{i}") for i, k in enumerate(key_columns)]
    placed = _placed(df, [F.col(value).cast("double").alias("value"), *codes], chunk_rows)
    keys = F.array(*[F.struct(F.lit(k).alias("key_name"), F.col(f"k{i}").alias("code")) for i, k in enumerate(key_columns)])
    return placed.select("value", "__part", "__row", F.inline(keys))


def _key_value() -> Column:
    return F.when(F.col("code") != "~", F.substring("code", 2, 1 << 30)).alias("key_value")


def _totals(rows: DataFrame) -> DataFrame:
    number = F.when(~F.isnan("value"), F.col("value"))
    return rows.groupBy("key_name", "code").agg(F.count(F.lit(1)).alias("n_rows"), F.count(number).alias("n_values"), F.sum(number).alias("total"))


def _numbered(rows: DataFrame, long_keys: DataFrame) -> DataFrame:
    """``key_name, code, value, position`` of the rows of the long keys; positions of a key run from 0 without a gap."""
    named = long_keys.select("key_name", "code").withColumn("id", F.xxhash64("key_name", "code"))
    own = rows.join(bounded(named), ["key_name", "code"])
    counts = own.groupBy("key_name", "code", "id", "__part").agg(F.count(F.lit(1)).alias("held"))
    before = W.partitionBy("key_name", "code").orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(F.col("key_name").alias("o_name"), F.col("code").alias("o_code"), F.col("id").alias("o_id"), F.col("__part").alias("o_part"), F.coalesce(F.sum("held").over(before), F.lit(0)).alias("offset"))
    inside = W.partitionBy("id", "__part").orderBy("key_name", "code", "__row")
    narrow = own.select("id", "key_name", "code", "__part", "__row", "value")
    # Rows are sorted by (id, part) for their number; the offsets join on the same keys, so only they move.
    ranked = narrow.withColumn("inside", F.row_number().over(inside) - 1)
    same = (F.col("id") == F.col("o_id")) & (F.col("__part") == F.col("o_part")) & (F.col("key_name") == F.col("o_name")) & (F.col("code") == F.col("o_code"))
    return ranked.join(offsets, same).select("key_name", "code", "value", (F.col("inside") + F.col("offset")).alias("position"))


def keyed_chunks(df: DataFrame, key_columns: list[str], value: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Every row once per key column, the rows of long keys numbered exactly and cut into equal chunks.

    Result: ``key_name, key_value, value, position, chunk``. A key of at most ``chunk_rows`` rows is one chunk and its rows
    need no number (NULL). Positions of a longer key run from 0 without a gap, so each of its chunks but the last holds
    exactly ``chunk_rows`` rows.

    Counts per (key, input partition) are made before anything moves; their running sum over a
    key's partitions gives the offset of each partition's first row. Rows then only need their
    number inside (key, partition), so even a key with a third of all rows is spread over as many
    tasks as the input has partitions. NULL keys are numbered like any other key; an empty input
    gives an empty result; further columns are dropped.
    """
    rows = _keyed(df, key_columns, value, chunk_rows)
    totals = written(_totals(rows), "totals")
    long_keys = totals.where(F.col("n_rows") > chunk_rows)
    short = rows.join(bounded(long_keys.select("key_name", "code")), ["key_name", "code"], "left_anti")
    few = short.select("key_name", _key_value(), "value", F.lit(None).cast("long").alias("position"), F.lit(0).cast("long").alias("chunk"))
    many = _numbered(rows, long_keys).select("key_name", _key_value(), "value", "position", F.floor(F.col("position") / chunk_rows).alias("chunk"))
    return few.unionByName(many)


def per_key_stats(df: DataFrame, key_columns: list[str], value: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Rows, valued rows and mean of ``value`` for each value of each key column.

    Result: ``key_name, key_value, n_rows, n_values, mean_value, n_chunks``. Keys of at most ``chunk_rows`` rows are
    aggregated at once. The rows of longer keys are numbered exactly and each (key, chunk) is
    reduced to a boundary state (rows, sum, first and last position); the states of a key are then
    merged, and the merge fails if they leave a gap or overlap. Values that are NULL or NaN count
    as rows but not as values; NULL is a key of its own; redelivered rows count as stored.
    """
    rows = _keyed(df, key_columns, value, chunk_rows)
    totals = written(_totals(rows), "totals")
    few = totals.where(F.col("n_rows") <= chunk_rows).withColumn("n_chunks", F.lit(1).cast("long"))
    number = F.when(~F.isnan("value"), F.col("value"))
    numbered = _numbered(rows, totals.where(F.col("n_rows") > chunk_rows)).withColumn("chunk", F.floor(F.col("position") / chunk_rows))
    states = numbered.groupBy("key_name", "code", "chunk").agg(
        F.count(F.lit(1)).alias("n"),
        F.count(number).alias("n_values"),
        F.sum(number).alias("total"),
        F.min("position").alias("first"),
        F.max("position").alias("last"),
    )
    merged = states.groupBy("key_name", "code").agg(
        F.sum("n").alias("n"),
        F.sum("n_values").alias("n_values"),
        F.sum("total").alias("total"),
        F.count(F.lit(1)).alias("n_chunks"),
        F.min("first").alias("first"),
        F.max("last").alias("last"),
        F.every((F.col("last") - F.col("first") + 1 == F.col("n")) & (F.col("first") == F.col("chunk") * chunk_rows)).alias("whole"),
    )
    sound = F.col("whole") & (F.col("first") == 0) & (F.col("last") + 1 == F.col("n"))
    many = merged.withColumn("n_rows", F.when(sound, F.col("n")).otherwise(F.raise_error(F.lit("a key's chunks leave a gap"))))
    out = few.unionByName(many.select(*few.columns))
    return out.select("key_name", _key_value(), "n_rows", "n_values", (F.col("total") / F.when(F.col("n_values") > 0, F.col("n_values"))).alias("mean_value"), "n_chunks")


def heavy_keys(df: DataFrame, key_columns: list[str], value: str, share: int = 20, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``key_name, key_value`` of the keys that hold at least one in ``share`` of all rows.

    Rows are counted as stored. NULL and blank values are no keys, but their rows are in the total.
    """
    stats = per_key_stats(df, key_columns, value, chunk_rows)
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()  # one number from the files' footers
    return stats.where((F.trim("key_value") != "") & (F.col("n_rows") * share >= total)).select("key_name", "key_value")


def positions(df: DataFrame, group: list[str], order: list[Column], name: str = "position") -> DataFrame:
    """``df`` with ``name``: each row's number in its group, from 1, in the given total order, for groups of any size.

    Rows are cut into ranges of (group, order), which are sorted side by side and written once; a row's number is its place
    in its range and the number of its group's rows in the ranges before. No task holds more of a group than a range, and
    nothing moves after the ranges are made. Groups are never NULL.
    """
    sorted_rows = df.repartitionByRange(2 * partitions(df.sparkSession), *group, *order).sortWithinPartitions(*group, *order)
    # In a partition the id runs on from 0 below bit 33.
    ranged = written(sorted_rows.withColumn("__piece", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "ranges")
    held = ranged.groupBy(*group, "__piece").agg(F.count(F.lit(1)).alias("__held"), F.min("__at").alias("__first"))
    before = F.sum("__held").over(W.partitionBy(*group).orderBy("__piece").rowsBetween(W.unboundedPreceding, -1))  # a row per piece
    named = {g: f"__{i}" for i, g in enumerate(group)}
    places = held.select(*[F.col(g).alias(a) for g, a in named.items()], F.col("__piece").alias("__p"), (F.coalesce(before, F.lit(0)) - F.col("__first") + 1).alias("__shift"))
    same = F.col("__piece") == F.col("__p")
    for g, a in named.items():
        same = same & (F.col(g) == F.col(a))
    return ranged.join(bounded(places), same).select(*df.columns, (F.col("__at") + F.col("__shift")).alias(name))


def pairs_within(df: DataFrame, group: str, member: str, chunk_rows: int = 2048) -> DataFrame:
    """``group, a, b``: every two different members of each group once, ``a < b``; members of a group are distinct.

    A group above ``chunk_rows`` members is cut into chunks and every pair of chunks is joined under a key of its own, so
    no key holds more than two chunks. The result is as large as the pairs that the caller asks for.
    """
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > 1)
    wide = written(sizes.where(F.col("__n") > chunk_rows).select(F.col(group).alias("__g"), F.ceil(F.col("__n") / chunk_rows).cast("int").alias("__c")), "wide")
    some = not wide.isEmpty()
    if some:
        rows = df.select(group, member).join(bounded(wide), F.col(group) == F.col("__g"), "left").select(group, member, F.coalesce("__c", F.lit(1)).alias("__c"))
    else:
        rows = df.select(group, member, F.lit(1).alias("__c"))
    own, every = F.pmod(F.hash(member), F.col("__c")), F.explode(F.sequence(F.lit(0), F.col("__c") - 1))
    left = rows.select(F.col(group), F.col(member).alias("a"), own.alias("__i"), every.alias("__j"))
    right = rows.select(F.col(group), F.col(member).alias("b"), every.alias("__i"), own.alias("__j"))
    return left.join(right, [group, "__i", "__j"]).where("a < b").select(group, "a", "b")
