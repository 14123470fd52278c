"""Caps, fusion, best items and tokens against brute force and on odd inputs."""

import math
import os
import random
from collections import defaultdict

import pytest

pytest.importorskip("quillrank.llm")

from quillrank.llm import capping, fusion, tokens, topn  # noqa: E402

VOCABULARY = f"{tokens.FOLDER}/byte_bpe_50k.tiktoken"


def evidence(n=900, seed=5):
    rng = random.Random(seed)
    rows = [(k, "hot" if rng.random() < 0.4 else rng.choice(["a", "b", "c", None]), rng.choice([0.5, 0.5, 0.9, None, 1.5, -1.0, float("nan"), rng.random()])) for k in range(n)]
    return rows + rows[:60]


@pytest.mark.parametrize("salts", [1, 7, 64])
def test_caps_equal_brute_force(spark, salts):
    data = evidence()
    df = spark.createDataFrame(data, "id long, who string, c double").repartition(6)
    own = defaultdict(set)
    for i, who, c in data:
        if who is not None:
            own[who].add((-c if c is not None and 0 <= c <= 1 else 9.0, i))
    want = {i for rows in own.values() for _, i in sorted(rows)[5:]}
    got = [r.record for r in capping.verdicts(df, "who", "c", "id", 5, salts=salts, only=False).collect()]
    assert sorted(got) == sorted(want)
    kept = [r.id for r in capping.capped(df, "who", "c", "id", 5, salts=salts).collect()]
    assert sorted(kept) == sorted({i for i, _, _ in data} - want)


def test_share_and_empty(spark):
    df = spark.createDataFrame([(k, "a", 0.5, "x") for k in range(50)] + [(None, "a", 0.5, "x"), (60, None, 0.5, "x")], "id long, who string, c double, salt string")
    kept = capping.capped(df, "who", "c", "id", None, 0.1).collect()
    assert sorted(r.id for r in kept if r.who and r.id is not None) == [0, 1, 2, 3, 4] and len(kept) == 7
    assert capping.capped(df.limit(0), "who", "c", "id", 5).count() == 0


SCORES = ["x", "y"]


def candidates(seed=2):
    rng = random.Random(seed)
    pick = [None, float("nan"), 0.0, -0.0, 1.0, 2.0, 1e300, -1e-9]
    rows = [(f"u{rng.randrange(4)}", f"i{k:03d}", rng.choice(pick), rng.choice([*pick, rng.random()])) for k in range(160)]
    return rows + rows[:20] + [(None, "i", 1.0, 1.0), ("u0", None, 1.0, 1.0), ("alone", "i", None, None)]


@pytest.mark.parametrize("group_rows", [10, 1000])
@pytest.mark.parametrize("by", ["standing", "reciprocal"])
def test_fusion_equals_brute_force(spark, by, group_rows):
    data = candidates()
    df = spark.createDataFrame(data, "g string, i string, x double, y double").repartition(5)
    got = {(r.g, r.i): (r.fused_score, r.position) for r in fusion.fused(df, "g", "i", SCORES, by=by, group_rows=group_rows).collect()}
    own = defaultdict(dict)
    for g, i, *s in data:
        if g is not None and i is not None:
            own[g][i] = [-math.inf if v is None or v != v else v + 0.0 for v in s]
    want = {}
    for g, items in own.items():
        total = {}
        for i, s in items.items():
            t = 0
            for k in range(2):
                lower, equal = sum(o[k] < s[k] for o in items.values()), sum(o[k] == s[k] for o in items.values()) - 1
                n = len(items) - 1
                t += ((2 * lower + equal) / (2 * n) if n else 0) if by == "standing" else 1 / (60 + 1 + n - lower - equal / 2)
            total[i] = round(t, 12)
        for p, i in enumerate(sorted(total, key=lambda i: (-total[i], i)), 1):
            want[g, i] = (pytest.approx(total[i]), p)
    assert got == want
    assert fusion.fused(df.limit(0), "g", "i", SCORES, by=by).count() == 0


@pytest.mark.parametrize("held", [64, 1 << 18])
def test_best_items_equal_brute_force(spark, monkeypatch, held):
    monkeypatch.setattr(topn, "HELD_ROWS", held)
    rng = random.Random(4)
    rows = []
    for _ in range(300):
        n = rng.randrange(12)
        items = [rng.choice([None, *(f"i{k}" for k in range(40))]) for _ in range(n)]
        scores = [rng.choice([None, float("nan"), 0.5, 0.5, rng.random()]) for _ in range(rng.choice([n, n + 2, max(0, n - 3)]))]
        rows.append((rng.choice(["hot", "hot", "u1", "u2", None]), rng.choice([items, None, items]), rng.choice([scores, scores, None])))
    df = spark.createDataFrame(rows, "u string, items array<string>, scores array<double>").repartition(7)
    best = defaultdict(dict)
    for u, items, scores in rows:
        for i, s in zip(items or [], scores or []):
            if u is not None and i is not None and s is not None and s == s:
                best[u][i] = max(s, best[u].get(i, -1))
    want = {(u, i, p) for u, d in best.items() for p, i in enumerate(sorted(d, key=lambda i: (-d[i], i))[:4], 1)}
    assert {(r.u, r.item, r.position) for r in topn.best_of_arrays(df, "u", "items", "scores", 4).collect()} == want
    assert topn.best_of_arrays(df.limit(0), "u", "items", "scores", 4).count() == 0


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary")
def test_ids_equal_the_library(spark):
    tiktoken = pytest.importorskip("tiktoken")
    with open(VOCABULARY, "rb") as f:
        ranks = tokens.read_ranks(f.read())
    library = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(9)
    texts = ["".join(rng.choice("aab bc  \né漢😀the ing0ab'st") for _ in range(rng.randrange(300))) for _ in range(400)]
    texts += ["a" * 20_000, " " * 5000, "=-" * 3000, "<|endoftext|>", "", None, "don't  \t\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.ids for r in tokens.encoded(df, "text").collect()}
    assert got == {k: library.encode_ordinary(t) if t else [] for k, t in enumerate(texts)}
    assert tokens.encoded(df.limit(0), "text").count() == 0


@pytest.fixture
def eight_tasks(spark):
    """Eight shuffle partitions as they are, and a task for each file."""
    own = {"spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.enabled": "false", "spark.sql.files.openCostInBytes": str(128 << 20)}
    held = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    yield
    for k, v in held.items():
        spark.conf.set(k, v)


def _most_in_a_task(df):
    from pyspark.sql import functions as F

    sizes = [r.n for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    return max(sizes) / sum(sizes)


def test_one_contributor_of_all_rows_is_spread(spark, eight_tasks):
    rng = random.Random(3)
    data = [(k, "hot", rng.choice([0.1, 0.5, None])) for k in range(8000)]
    df = spark.createDataFrame(data, "id long, who string, c double").repartition(8)
    out = capping.verdicts(df, "who", "c", "id", None, 0.5, task_rows=1000)
    assert _most_in_a_task(out) <= 0.25
    assert {r.record for r in out.where("kept").collect()} == {i for i, _, _ in sorted(data, key=lambda r: (-(r[2] or -1), r[0]))[:4000]}


def test_one_group_of_all_rows_is_spread(spark, eight_tasks):
    rng = random.Random(4)
    data = [("g", f"i{k:05d}", rng.random() if k % 3 else None, 1.0) for k in range(8000)]
    df = spark.createDataFrame(data, "g string, i string, x double, y double").repartition(8)
    out = fusion.fused(df, "g", "i", SCORES, group_rows=1000)
    assert _most_in_a_task(out) <= 0.25
    order = sorted(data, key=lambda r: (-(r[2] if r[2] is not None else -1.0), r[1]))
    assert {r.i: r.position for r in out.collect()} == {r[1]: n for n, r in enumerate(order, 1)}
