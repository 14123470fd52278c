import random

import pytest

from quillrank.operators import skew

SCHEMA = "user_id string, item_id string, rating double, extra string"


def rows(n=3000, seed=3):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        item = "hot" if rng.random() < 0.4 else rng.choice(["a", "b", None, "", " "])
        out.append((rng.choice(["u1", "u2", None]), item, rng.choice([1.0, 2.0, 5.0, None, float("nan")]), "x"))
    return out


@pytest.mark.parametrize("chunk", [7, 100, 1 << 16])
def test_stats_equal_brute_force(spark, chunk):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    got = {(r.key_name, r.key_value): (r.n_rows, r.n_values, r.mean_value and round(r.mean_value, 9)) for r in skew.per_key_stats(df, ["item_id", "user_id"], "rating", chunk).collect()}
    want = {}
    for name, at in (("item_id", 1), ("user_id", 0)):
        for key in {r[at] for r in data}:
            own = [r[2] for r in data if r[at] == key]
            values = [v for v in own if v is not None and v == v]
            want[name, key] = (len(own), len(values), round(sum(values) / len(values), 9) if values else None)
    assert got == want


def test_chunks_are_exact(spark, tmp_path):
    spark.createDataFrame(rows(), SCHEMA).repartition(4).write.parquet(str(tmp_path / "t"))
    chunks = skew.keyed_chunks(spark.read.parquet(str(tmp_path / "t")), ["item_id"], "rating", 50).where("key_value = 'hot'").collect()
    assert sorted(r.position for r in chunks) == list(range(len(chunks)))
    sizes = {}
    for r in chunks:
        sizes[r.chunk] = sizes.get(r.chunk, 0) + 1
    assert all(n == 50 for c, n in sizes.items() if c < max(sizes))


def test_heavy_keys_leave_out_null_and_blank(spark):
    got = {(r.key_name, r.key_value) for r in skew.heavy_keys(spark.createDataFrame(rows(), SCHEMA), ["item_id"], "rating").collect()}
    assert got == {("item_id", "hot"), ("item_id", "a"), ("item_id", "b")}


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert skew.per_key_stats(df, ["item_id"], "rating").count() == 0
    assert skew.heavy_keys(df, ["item_id"], "rating").count() == 0


def test_positions_spread_one_group(spark):
    from pyspark.sql import functions as F

    rng = random.Random(8)
    data = [("g", rng.choice([1.0, 2.0, 2.0]), k) for k in range(4000)] + [("h", 1.0, k) for k in range(10)]
    df = spark.createDataFrame(data, "g string, s double, i long").repartition(5)
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        rows = skew.positions(df, ["g"], [F.col("s").desc(), F.col("i").asc()]).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = {(g, i): n for name in "gh" for n, (g, _, i) in enumerate(sorted((r for r in data if r[0] == name), key=lambda r: (-r[1], r[2])), 1)}
    assert {(r.g, r.i): r.position for r in rows} == want


def test_chunks_spread_one_key(spark, tmp_path):
    data = [("u1", "hot", 1.0, "x")] * 4000
    spark.createDataFrame(data, SCHEMA).repartition(4).write.parquet(str(tmp_path / "t"))
    r = skew.per_key_stats(spark.read.parquet(str(tmp_path / "t")), ["item_id"], "rating", 100).first()
    assert (r.key_value, r.n_rows, r.n_values, r.mean_value, r.n_chunks) == ("hot", 4000, 4000, 1.0, 40)
