"""Parquet and JSON sinks with counts and content hashes, and manifests that name them."""

from __future__ import annotations

import json
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quillrank.functions.scalars import content_hash

# The columns of the tables that are exchanged.
SCHEMAS = {
    "interactions": "review_id STRING, user_id STRING, item_id STRING, rating DOUBLE, timestamp BIGINT",
    "review_texts": "review_id STRING, item_id STRING, title STRING, text STRING, normalized_text STRING, language STRING, timestamp BIGINT, source_text_sha256 STRING, duplicate_group STRING",
    "item_metadata": "item_id STRING, parent_asin STRING, main_category STRING, title STRING, description_json STRING, features_json STRING, price STRING, brand STRING, images_json STRING, details_json STRING, metadata_found BOOLEAN, entity_scope STRING",
}
# End of fixed values.


def projected(df: DataFrame, columns: list[str]) -> DataFrame:
    """Those of the columns that are there, in the asked order."""
    return df.select([c for c in columns if c in df.columns])


def write_table(df: DataFrame, path: str, order: list[str] | None = None, rows_per_file: int | None = None) -> dict:
    """Writes a new Parquet table and returns its row count and content hash, made in the same pass.

    An existing table is never overwritten.
    """
    seen = Observation("written")
    rows = df.orderBy(*order) if order else df  # sorting samples its input, so rows are counted after it
    counted = rows.observe(seen, F.count(F.lit(1)).alias("rows"), content_hash(df.columns).alias("hash"))
    writer = counted.write.option("compression", "zstd").mode("errorifexists")
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    writer.parquet(path)
    return {"path": path, "rows": seen.get["rows"], "content_hash": seen.get["hash"]}


def write_json(df: DataFrame, path: str) -> None:
    df.select(*sorted(df.columns)).write.mode("errorifexists").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Nested columns become JSON texts."""
    flat = [F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("errorifexists").option("header", True).csv(path)


def read_checked(spark: SparkSession, entry: dict) -> DataFrame:
    """A table that a manifest names, after its content is found unchanged."""
    df = spark.read.parquet(entry["path"])
    held = df.agg(F.count(F.lit(1)).alias("rows"), content_hash(df.columns).alias("hash")).first()
    if (held["rows"], held["hash"]) != (entry["rows"], entry["content_hash"]):
        raise ValueError(f"{entry['path']} is not the table that its manifest names")
    return df


def write_manifest(spark: SparkSession, path: str, content: dict) -> None:
    """A small JSON document beside the tables, wherever they lie; an existing one is never overwritten."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(target, False)
    out.write(json.dumps(content, sort_keys=True, indent=1).encode())
    out.close()


def read_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads("\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))  # one document


def resolved(manifest_path: str, artifact: str) -> str:
    """An artifact's place: as given if absolute, else beside its manifest."""
    return artifact if artifact.startswith("/") or "://" in artifact else str(PurePosixPath(manifest_path).parent / artifact)
