"""Column expressions shared by the operators."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf


def canonical_json(columns: list[str]) -> Column:
    """A row's columns as JSON in the order of their names, NULLs left out."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]))


def short_hash(value: Column, length: int = 24) -> Column:
    return F.substring(F.sha2(value, 256), 1, length)


def _nfkc(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        yield pa.array([None if t is None else " ".join(unicodedata.normalize("NFKC", t).split()) for t in texts.to_pylist()], pa.string())


def normalized_text(column: str) -> Column:
    """Compatibility forms unified and blanks collapsed; NULL becomes the empty text. Spark has no such function."""
    return F.coalesce(arrow_udf(_nfkc, "string")(F.col(column)), F.lit(""))


def duplicate_group(item: str, text: Column) -> Column:
    """Equal for equal texts of one item, whatever their letter case."""
    return short_hash(F.to_json(F.struct(F.coalesce(F.col(item), F.lit("")).alias("item_id"), F.lower(text).alias("text"))))


def epoch_ms(column: str) -> Column:
    """Milliseconds of a text that is an ISO time with zone, or a number; NULL for all else (also times without zone)."""
    zoned = F.col(column).rlike(r"(?i)^\d{4}-\d\d-\d\d[T ].*(Z|[+-]\d\d:?\d\d)$")
    return F.coalesce(F.when(zoned, F.unix_millis(F.try_to_timestamp(F.col(column)))), F.expr(f"try_cast(round(try_cast({column} AS DOUBLE)) AS BIGINT)"))


def bucket(value: Column, bounds: list[tuple[float, str]], last: str) -> Column:
    """The name of the first bound above the value."""
    out = None
    for upper, name in bounds:
        out = F.when(value < upper, name) if out is None else out.when(value < upper, name)
    return out.otherwise(last)


def has_word(column: Column, terms: list[str]) -> Column:
    """Whether a text holds one of the terms as whole words, in any letter case (Unicode)."""
    inner = "|".join(re.escape(t) for t in terms)
    return column.rlike(rf"(?iU)(?<!\w)(?:{inner})(?!\w)")


def percent(share: Column) -> Column:
    """``0.125`` as ``12%``: halves go to the even number."""
    return F.concat(F.bround(share * 100).cast("int").cast("string"), F.lit("%"))


def dominant_part(parts: dict[str, Column]) -> Column:
    """The name of the part with the largest absolute value, of equal ones the last by name; NULLs don't count."""
    each = F.array_compact(F.array(*[F.when(v.isNotNull(), F.struct(F.abs(v).alias("size"), F.lit(n).alias("name"))) for n, v in parts.items()]))
    return F.array_max(each)["name"]


def content_hash(columns: list[str]) -> Column:
    """An aggregate: the hash of a table's rows, whatever their order. 64-bit hashes are summed, nothing is gathered."""
    x, y = F.xxhash64(*columns), F.xxhash64(*columns, F.lit(1))
    return F.sha2(F.concat_ws(":", F.count(F.lit(1)), F.sum(x.cast("decimal(20,0)")), F.sum(y.cast("decimal(20,0)"))), 256)
