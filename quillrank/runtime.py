"""Session facts shared by every module: tables, the shared folder, written stages, checked broadcasts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a small table that the driver may hold or send to the executors; a larger one is joined.
SENT_ROWS = 100_000

_shipped: set[str] = set()
_stages: dict[str, set[str]] = {}


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per application, so that their Python needs no path to it."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        _shipped.add(context.applicationId)
        here = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="quillrank-code-")  # read by the driver only
        shutil.copytree(here, f"{folder}/code/{here.name}", ignore=shutil.ignore_patterns("__pycache__"))
        context.addPyFile(shutil.make_archive(f"{folder}/{here.name}", "zip", f"{folder}/code"))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder."""
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Where the setting is missing a local session (tests, a laptop) gets a temporary folder of its own; a cluster
    has to name one, since a folder of one machine can't be read by the others, and is refused without it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = held.get() if held.isDefined() else None
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="quillrank-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def clear_stages(spark: SparkSession) -> None:
    """Removes the stages that this application has written; results that were not yet read are lost with them."""
    jvm = spark._jvm
    for path in _stages.pop(spark.sparkContext.applicationId, set()):
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _clear_at_exit() -> None:
    spark = SparkSession.getActiveSession()
    try:
        if spark is not None and _stages:
            clear_stages(spark)
    except Exception:  # noqa: BLE001  (the session has ended before: its stages stay)
        pass


atexit.register(_clear_at_exit)


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back.

    Cuts the lineage like a checkpoint, survives the loss of any executor, and keeps
    column pruning and filter pushdown for the stages that read it several times.
    Stages are removed when the driver's Python ends, or by :func:`clear_stages`.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stages/{label}-{uuid.uuid4().hex}"
    _stages.setdefault(spark.sparkContext.applicationId, set()).add(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = SENT_ROWS) -> bool:
    """Whether a table has at most so many rows, counted before it is broadcast."""
    return df.limit(rows + 1).count() <= rows


def bounded(df: DataFrame, rows: int = SENT_ROWS) -> DataFrame:
    """A written table, marked for broadcast if it is counted to be small."""
    return F.broadcast(df) if small(df, rows) else df


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions of the session, at least as many as it has cores."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), spark.sparkContext.defaultParallelism)
