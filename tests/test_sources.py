import json

import pytest

from quillrank.functions import scalars
from quillrank.sources import jsonl, tables
from quillrank.streaming import events
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


@pytest.fixture
def lines(tmp_path):
    rows = [{"id": f"k{n}", "v": {"a": n}, "t": "x" * (n % 50)} for n in range(500)]
    path = tmp_path / "rows.jsonl"
    path.write_text("".join(json.dumps(r) + "\n" for r in rows) + '{"id": "last"}', encoding="utf-8")
    return str(path)


def test_byte_ranges_lose_and_repeat_nothing(spark, lines):
    jsonl.register(spark)
    for width in (137, 4096, 1 << 20):
        df = spark.read.format("json_windows").schema("id string, v string").option("window_bytes", width).load(lines)
        assert sorted(r.id for r in df.collect()) == sorted([*(f"k{n}" for n in range(500)), "last"])
    part = spark.read.format("json_windows").schema("id string").option("window_bytes", 500).option("fractions", "0,0.5,1").load(lines).collect()
    assert 0 < len(part) < 100 and "last" in {r.id for r in part}


def test_strict_and_tolerant(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"id": "a"}\nbroken\n{"id": "b"}\n')
    schema = StructType().add("id", "string")
    assert sorted(r.id for r in jsonl.read_tolerant(spark, str(tmp_path), schema).collect()) == ["a", "b"]
    with pytest.raises(Exception):
        jsonl.read_strict(spark, str(tmp_path), schema).collect()


def test_tables_keep_their_content(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, s string")
    entry = tables.write_table(df, str(tmp_path / "t"), order=["id"])
    assert entry["rows"] == 2 and tables.read_checked(spark, entry).count() == 2
    with pytest.raises(Exception):
        tables.write_table(df, str(tmp_path / "t"))
    with pytest.raises(ValueError):
        tables.read_checked(spark, {**entry, "content_hash": "other"})
    tables.write_manifest(spark, str(tmp_path / "m.json"), {"t": entry})
    assert tables.read_manifest(spark, str(tmp_path / "m.json"))["t"]["rows"] == 2
    assert tables.resolved("/a/m.json", "t.parquet") == "/a/t.parquet"


def test_hash_ignores_order(spark):
    df = spark.range(100).withColumn("x", F.col("id") % 7)
    one, two = (d.agg(scalars.content_hash(["id", "x"])).first()[0] for d in (df, df.repartition(7).orderBy(F.desc("id"))))
    assert one == two


def test_times_and_words(spark):
    df = spark.createDataFrame([("2019-01-13T04:24:39.377Z",), ("1547353479377",), ("2019-01-13T04:24:39",), ("x",), (None,)], "t string")
    assert [r[0] for r in df.select(scalars.epoch_ms("t")).collect()] == [1547353479377, 1547353479377, None, None, None]
    words = spark.createDataFrame([("a story",), ("éstory",), ("STORY!",), (None,)], "t string")
    assert [r[0] for r in words.select(scalars.has_word(F.col("t"), ["story"])).collect()] == [True, False, True, None]


def test_stream_counts_and_copies(spark, tmp_path):
    df = spark.createDataFrame([("a", "2020-01-01 01:00:00"), ("a", "2020-01-01 01:30:00"), ("b", "2020-01-02 05:00:00")], "k string, t string")
    df.write.parquet(str(tmp_path / "in"))
    counted = events.run_to_end(events.counted(events.stream(spark, str(tmp_path / "in")), "t", "k"))
    assert sorted((r.key, r.n) for r in counted.collect()) == [("a", 2), ("b", 1)]
    once = events.run_to_end(events.once(events.stream(spark, str(tmp_path / "in")), "t", "k"), "append")
    assert sorted(r.k for r in once.collect()) == ["a", "b"]
    events.keep_latest(events.stream(spark, str(tmp_path / "in")), "k", "t", str(tmp_path / "log"), str(tmp_path / "cp")).awaitTermination()
    assert sorted((r.k, r.t) for r in events.latest(spark, "k", "t", str(tmp_path / "log")).collect()) == [("a", "2020-01-01 01:30:00"), ("b", "2020-01-02 05:00:00")]
