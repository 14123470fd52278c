import math
import random
from collections import defaultdict

import numpy as np
import pytest

from quillrank.operators import evaluation, evidence, labels, normalise, ranking, serving, snapshot

EVENTS = "review_id string, user_id string, item_id string, rating double, timestamp bigint"


def seeded(n=600, users=40, items=25, seed=11):
    rng = random.Random(seed)
    return [(f"r{k:04d}", f"u{rng.randrange(users):02d}", f"i{min(items - 1, int(rng.paretovariate(1.1))):02d}", float(rng.randint(1, 5)), rng.randrange(100)) for k in range(n)]


@pytest.fixture(scope="module")
def clean(spark):
    return snapshot.events(spark.createDataFrame(seeded(), EVENTS)).cache()


def test_events_keep_the_first_delivery(spark):
    data = [("a", "u", "i", 5.0, 2), ("a", "u", "i", 5.0, 1), ("b", " ", "i", 1.0, 1), ("c", None, "i", 1.0, 1), ("d", "u", "i", 1.0, None), (None, "u", "j", 1.0, 4)]
    got = snapshot.events(spark.createDataFrame(data, EVENTS)).collect()
    assert sorted((r.review_id or "", r.timestamp) for r in got) == [("", 4), ("a", 1)]


@pytest.mark.parametrize("values", [[5], [1, 2, 3, 10], list(range(-50, 1000, 7)), [3] * 40 + [10**13]])
def test_exact_quantiles(spark, values):
    df = spark.createDataFrame([(v,) for v in [*values, None]], "v bigint")
    got = snapshot.exact_quantiles(df, "v", [0.0, 0.25, 0.8, 1.0])
    assert got == pytest.approx(list(np.quantile(values, [0.0, 0.25, 0.8, 1.0])))


def test_quantiles_of_nothing(spark):
    assert snapshot.exact_quantiles(spark.createDataFrame([], "v bigint"), "v", [0.5]) == [None]


def test_later_better_rating_makes_no_target(spark):
    data = [("a", "u", "i", 1.0, 60), ("b", "u", "i", 5.0, 70), ("c", "v", "i", 5.0, 10), ("d", "w", "i", 5.0, 65), ("e", "w", "new", 5.0, 66)]
    got = snapshot.targets(spark.createDataFrame(data, EVENTS), 50).collect()
    assert [r.review_id for r in got] == ["d"]


def test_future_rows_change_nothing(spark, clean):
    late = spark.createDataFrame([("z", "u00", "i00", 5.0, 95), ("y", "u01", "new", 5.0, 99)], EVENTS)
    a, b = (ranking.popularity(ranking.edges(x, 90), 90).collect() for x in (clean, clean.unionByName(late)))
    assert sorted(a) == sorted(b)


def test_best_unseen_equals_brute_force(spark, clean):
    edge = ranking.edges(clean, 90).cache()
    users = edge.select("user_id").distinct()
    got = {(r.user_id, r["rank"]): r.item_id for r in ranking.popular(users, edge, 90, 5).collect()}
    seen, likes = defaultdict(set), defaultdict(int)
    for r in edge.collect():
        seen[r.user_id].add(r.item_id)
        likes[r.item_id] += r.positive
    order = sorted({i for s in seen.values() for i in s}, key=lambda i: (-likes[i], i))
    want = {(u, n): i for u in seen for n, i in enumerate([i for i in order if i not in seen[u]][:5], 1)}
    assert got == want


def _brute_neighbours(edge, n=None):
    liked, seen = defaultdict(set), defaultdict(set)
    for r in edge:
        seen[r.user_id].add(r.item_id)
        if r.positive:
            liked[r.item_id].add(r.user_id)
    out = {}
    for u in seen:
        mine = [i for i in liked if u in liked[i]]
        for c in liked:
            if c not in seen[u]:
                sims = sorted((len(liked[c] & liked[j]) / math.sqrt(len(liked[c]) * len(liked[j])) for j in mine), reverse=True)[:n]
                if sum(sims) > 0:
                    out[u, c] = sum(sims)
    return out


@pytest.mark.parametrize("n", [None, 2])
def test_neighbour_scores(spark, clean, n):
    edge = ranking.edges(clean, 90).cache()
    users = edge.select("user_id").distinct()
    want = _brute_neighbours(edge.collect(), n)
    assert {(r.user_id, r.item_id): r.score for r in ranking.neighbour_scores(users, edge, n).collect() if r.score > 0} == pytest.approx(want)
    joined = ranking.with_fallback(ranking.top_k(ranking.neighbour_scores(users, edge, n).where("score > 0"), 4), users, edge, 90, 4, "no_similar_items")
    local = ranking.neighbours_top(users, edge, 90, 4, n)
    key = lambda d: {(r.user_id, r["rank"], r.item_id, r.fallback_reason or ""): r.score for r in d.collect()}
    assert key(local) == pytest.approx(key(joined))


def test_walks_equal_node_by_node(spark, clean):
    edge = ranking.edges(clean, 90).cache()
    users = edge.select("user_id").distinct()
    got = {(r.user_id, r.item_id): r.score for r in ranking.walks(users, edge, 100).collect()}
    liked = [(r.user_id, r.item_id) for r in edge.collect() if r.positive]
    seen = {(r.user_id, r.item_id) for r in edge.collect()}
    names, items = sorted({u for u, _ in liked}), sorted({i for _, i in liked})
    b = np.zeros((len(names), len(items)))
    for u, i in liked:
        b[names.index(u), items.index(i)] = 1
    for n, u in enumerate(names[:6]):
        e = np.eye(len(names))[n]
        pu, pi = e.copy(), np.zeros(len(items))
        for _ in range(400):
            pu, pi = 0.85 * (b / b.sum(0)) @ pi + 0.15 * e, 0.85 * (b / b.sum(1)[:, None]).T @ pu
        for j, i in enumerate(items):
            if (u, i) not in seen:
                assert got.get((u, i), 0.0) == pytest.approx(pi[j], abs=1e-5)


def test_factors_are_repeatable(spark, clean):
    edge = ranking.edges(clean, 90).cache()
    users = edge.select("user_id").distinct()
    a, b = (sorted(ranking.factor_top(users, edge, ranking.factors(edge, 4, epochs=2), 3).collect()) for _ in range(2))
    assert a == b and a


def test_factors_in_blocks_learn(spark, clean):
    edge = ranking.edges(clean, 90).cache()
    user_f, item_f = ranking.factors(edge, 8, rate=0.05, epochs=20, block_edges=100, rounds=4)
    x, y = {r.user_id: np.array(r.vector) for r in user_f.collect()}, {r.item_id: (r.bias, np.array(r.vector)) for r in item_f.collect()}
    rows = edge.collect()
    assert set(x) == {r.user_id for r in rows if r.positive} and set(y) == {r.item_id for r in rows}
    score = lambda u, i: y[i][0] + x[u] @ y[i][1]
    seen = {(r.user_id, r.item_id) for r in rows}
    wins = [score(r.user_id, r.item_id) > score(r.user_id, i) for r in rows if r.positive for i in y if (r.user_id, i) not in seen]
    assert np.mean(wins) > 0.65


def test_factors_equal_plain_training(spark):
    """With the defaults, against training row by row with the same draws: 64 dimensions, rate 0.001, 50 passes."""
    data = seeded(400, 30, 12) + [(f"n{k}", "sour", f"i{k:02d}", 1.0, 5) for k in range(1, 4)] + [(f"f{k}", "full", f"i{k:02d}", 5.0, 5) for k in range(1, 12)]
    edge = ranking.edges(snapshot.events(spark.createDataFrame(data, EVENTS)), 90).cache()
    rows = sorted((r.user_id, r.item_id, r.positive) for r in edge.collect())
    items, liking = sorted({i for _, i, _ in rows}), sorted({u for u, _, p in rows if p})
    seen = defaultdict(set)
    for u, i, _ in rows:
        seen[u].add(items.index(i))
    rng = np.random.default_rng(7)
    x = dict(zip(liking, rng.normal(0, 0.01, (len(liking), 64)), strict=True))
    y, bias = rng.normal(0, 0.01, (len(items), 64)), np.zeros(len(items))
    pairs = [(u, items.index(i)) for u, i, p in rows if p and len(seen[u]) < len(items)]
    assert "full" in liking and len(seen["full"]) == len(items) and "sour" not in liking and len(pairs) < 1024
    for _ in range(50):
        batch = [pairs[n] for n in rng.permutation(len(pairs))]
        drawn = rng.integers(0, len(items), len(batch))
        for _ in range(20):
            bad = [n for n, (u, _) in enumerate(batch) if drawn[n] in seen[u]]
            if not bad:
                break
            drawn[bad] = rng.integers(0, len(items), len(bad))
        for n in bad:
            left = [i for i in range(len(items)) if i not in seen[batch[n][0]]]
            drawn[n] = left[int(rng.integers(len(left)))]
        new_x, new_y, add = {u: v.copy() for u, v in x.items()}, y.copy(), np.zeros(len(items))
        less, own = np.zeros(len(items)), bias.copy()
        pulls = [1 / (1 + math.exp(bias[b] - bias[c] + x[u] @ (y[b] - y[c]))) for (u, b), c in zip(batch, drawn, strict=True)]
        for (u, b), c, pull in zip(batch, drawn, pulls, strict=True):
            new_x[u] += 0.001 * (pull * (y[b] - y[c]) - 1e-4 * x[u])
            new_y[b] += 0.001 * (pull * x[u] - 1e-4 * y[b])
            new_y[c] += 0.001 * (-pull * x[u] - 1e-4 * y[c])
            add[b] += 0.001 * (pull - 1e-4 * own[b])
        bias = own + add
        for (_, _), c, pull in zip(batch, drawn, pulls, strict=True):
            less[c] += 0.001 * (-pull - 1e-4 * bias[c])
        x, y, bias = new_x, new_y, bias + less
    user_f, item_f = ranking.factors(edge)
    got = {r.user_id: r.vector for r in user_f.collect()}
    assert sorted(got) == liking
    np.testing.assert_allclose([got[u] for u in liking], [x[u] for u in liking], atol=1e-10)
    items_got = sorted((r.item_id, r.bias, r.vector) for r in item_f.collect())
    np.testing.assert_allclose([r[1] for r in items_got], bias, atol=1e-10)
    np.testing.assert_allclose([r[2] for r in items_got], y, atol=1e-10)
    users = edge.select("user_id").distinct()
    top = ranking.with_fallback(ranking.factor_top(users, edge, (user_f, item_f), 3), users, edge, 90, 3, None).where("user_id = 'sour'").collect()
    assert len(top) == 3 and {r.fallback_reason for r in top} == {"no_positive_history"}
    assert ranking.factors(edge.where("not positive"))[0].count() == 0


def test_percentile_and_min_max(spark):
    df = spark.createDataFrame([("g", "a", 1.0), ("g", "b", 2.0), ("g", "c", 2.0), ("g", "d", 4.0), ("h", "a", 3.0), ("h", "b", 3.0)], "g string, i string, s double")
    got = {(r.g, r.i): (r.p, r.m) for r in df.select("g", "i", normalise.percentile(df["s"], ["g"]).alias("p"), normalise.min_max(df["s"], ["g"]).alias("m")).collect()}
    assert [got["g", x][0] for x in "abcd"] == [0, 0.5, 0.5, 1] and got["h", "a"] == (0.5, 0.5) and got["g", "b"][1] == pytest.approx(1 / 3)


def test_weights_must_sum_to_one(spark):
    with pytest.raises(ValueError):
        normalise.fixed_hybrid(spark.range(1), {"id": 0.4}, ["id"])


def test_thirds(spark):
    for n in (1, 2, 3, 7, 10):
        df = spark.createDataFrame([(f"i{k:02d}", k // 2) for k in range(n)], "item_id string, popularity long")
        got = {r.item_id: r.tertile for r in normalise.thirds(df).collect()}
        assert [got[f"i{k:02d}"] for k in range(n)] == [("tail", "middle", "head")[3 * k // n] for k in range(n)]


def test_metrics(spark):
    ranked = spark.createDataFrame([("u", 1, "b"), ("u", 2, "a"), ("u", 3, "c")], "user_id string, rank int, item_id string")
    case = spark.createDataFrame([("u", "a", 0), ("u", "c", 0), ("v", "a", 0)], "user_id string, item_id string, history_count long")
    got = {r.user_id: r for r in evaluation.metrics(ranked, case, [2]).collect()}
    assert got["u"].recall_2 == 0.5 and got["u"].precision_2 == 0.5
    assert got["u"].ndcg_2 == pytest.approx((1 / math.log2(3)) / (1 + 1 / math.log2(3)))
    assert got["v"].ndcg_2 == 0


def test_diversity(spark):
    ranked = spark.createDataFrame([("u", k, i) for k, i in enumerate("abc", 1)] + [("v", 1, "x"), ("w", 1, "a")], "user_id string, rank int, item_id string")
    aspects = spark.createDataFrame([("a", "story"), ("a", "graphics"), ("b", "story"), ("c", "value")], "item_id string, aspect string")
    got = {r.user_id: r.diversity for r in evaluation.diversity(ranked, aspects, 3).collect()}
    assert got["u"] == pytest.approx(((1 - 0.5) + 1 + 1) / 3) and got["v"] is None and got["w"] == 0


def test_bootstrap_both_ways(spark, monkeypatch):
    rng = random.Random(1)
    df = spark.createDataFrame([(f"u{k}", rng.random(), rng.random() + 0.2) for k in range(400)], "user_id string, a double, b double")
    first = {r.model: r for r in evaluation.bootstrap(df, ["a", "b"], 300, reference="a").collect()}
    monkeypatch.setattr(evaluation, "WORKER_USERS", 10)
    second = {r.model: r for r in evaluation.bootstrap(df, ["a", "b"], 300, reference="a").collect()}
    for m in ("a", "b"):
        assert first[m].estimate == pytest.approx(second[m].estimate)
        assert first[m].lower == pytest.approx(second[m].lower, abs=0.01)
    assert first["b"].delta_lower < first["b"].delta < first["b"].delta_upper


def test_leakage_is_an_error(spark):
    df = spark.createDataFrame([("a", 5), ("b", None)], "review_id string, timestamp long")
    with pytest.raises(evaluation.LeakageError):
        evaluation.assert_before(df, 10, "rows")
    with pytest.raises(evaluation.LeakageError):
        evaluation.assert_disjoint(df, df, "parts")
    evaluation.assert_same_sets(df, df, "sets")


EVIDENCE = "evidence_id long, review_id string, item_id string, aspect string, sentiment string, confidence double, timestamp long, author_id string, duplicate_group string, text string, evidence string, start_offset int, end_offset int"


def test_profile_closed_form(spark):
    day = 86_400_000
    data = [(1, "r1", "i", "story", "positive", 1.0, 9 * day, "a", "g", "good x", "good", 0, 4), (2, "r2", "i", "story", "negative", 0.5, 8 * day, "b", "g", "bad", "bad", 0, 3)]
    obs = evidence.observations(spark.createDataFrame(data, EVIDENCE))
    contrib = evidence.contributions(evidence.weighted(obs, 10 * day, 10.0))
    prior = spark.createDataFrame([("story", 0.2)], "aspect string, prior double")
    r = evidence.profiles(contrib, prior, 1.0).first()
    q1, q2 = 0.5 * 2 ** (-1 / 10), 0.25 * 2 ** (-2 / 10)
    assert r.score == pytest.approx((0.2 + q1 - q2) / (1 + q1 + q2))
    assert r.effective_sample_size == pytest.approx((q1 + q2) ** 2 / (q1**2 + q2**2)) and r.author_count == 2


def test_one_review_of_two_clauses(spark):
    data = [(1, "r", "i", "story", "positive", 1.0, 1, "a", None, "t", "t", 0, 1), (2, "r", "i", "story", "negative", 1.0, 1, "a", None, "t", "t", 0, 1)]
    c = evidence.contributions(evidence.weighted(evidence.observations(spark.createDataFrame(data, EVIDENCE)), 10)).first()
    assert (c.q, c.z, c.positive, c.negative) == (1.0, 0.0, 0.5, 0.5)


@pytest.mark.parametrize("text, want", [
    ("Great story. Bad controls, but fun!", ["Great story.", "Bad controls", "fun!"]),
    ("One<br/>two ;  énd \U0001f600", ["One", "two ;  énd \U0001f600"]),
    ("  ", []), (None, []), ("a, However b", ["a", "b"]),
])
def test_clauses(text, want):
    assert [text[a:b] for a, b in labels.clauses(text)] == want


def test_lexicon_labels(spark):
    data = [("1", "The story is not good. Graphics are great!"), ("2", ""), ("3", "My headset broke"), ("4", "Nothing here"), ("5", "The plot"), ("6", None)]
    got = sorted((r.key, r.refusal, r.aspect, r.polarity) for r in labels.lexicon_labels(spark.createDataFrame(data, "id string, text string"), "id", "text").collect())
    assert got == [("1", None, "graphics", "positive"), ("1", None, "story", "negative"), ("2", "empty_text", None, None), ("3", "out_of_scope", None, None),
                   ("4", "no_aspect_match", None, None), ("5", "no_explicit_sentiment", None, None), ("6", "empty_text", None, None)]


def test_merged_spans_touching_stay_apart(spark):
    df = spark.createDataFrame([("k", 0, 5), ("k", 4, 8), ("k", 8, 9), ("k", 3, 3)], "k string, start int, end int")
    assert sorted((r.start, r.end) for r in labels.merged_spans(df, ["k"]).collect()) == [(0, 8), (8, 9)]


def test_temporary_priorities(spark):
    ranked = spark.createDataFrame([("u", "a", 1.0, 0.2, 0.5), ("u", "b", 0.9, 0.2, 0.5)], "user_id string, item_id string, total_score double, aspect_part double, aspect_weight double")
    weights = spark.createDataFrame([("u", "story", 0.5), ("u", "value", 0.5)], "user_id string, aspect string, weight double")
    aspects = spark.createDataFrame([("a", "story", 0.0), ("b", "story", 1.0), ("b", "value", 0.0)], "item_id string, aspect string, value double")
    got = {r.item_id: r.total_score for r in serving.reranked(ranked, weights, aspects, {"story": 1.0}, 5).collect()}
    assert got == {"a": pytest.approx(0.8), "b": pytest.approx(0.7 + 0.5 * 0.75)}


def test_located(spark):
    data = [(1, "x \U0001f600 Good  Game", "Good  Game"), (2, "x Good \n Game", "good game"), (3, "abc", "'b'"), (4, "abc", "d"), (5, None, "a"), (6, "abc", ""), (7, "a", None)]
    got = {r.k: (r.start, r.end) for r in labels.located(spark.createDataFrame(data, "k int, t string, e string"), "t", "e").collect()}
    assert got == {1: (4, 14), 2: (2, 13), 3: (1, 2), 4: (None, None), 5: (None, None), 6: (None, None), 7: (None, None)}


def test_answers(spark):
    good = '```json {"reviews": [{"id": 0, "labels": [{"aspect": "story", "polarity": "positive", "evidence": "x"}, {"aspect": "odd", "polarity": "positive", "evidence": "y"}]}]} ```'
    df = spark.createDataFrame([("a", good), ("b", "no answer"), ("c", None)], "k string, t string")
    assert [(r.key, r.id, r.aspect) for r in labels.answered(df, "k", "t").collect()] == [("a", 0, "story")]


def test_upper_median_and_checks(spark):
    df = spark.createDataFrame([("g", v) for v in (1.0, 2.0, 3.0, 4.0, None)], "g string, v double")
    assert evaluation.upper_medians(df, ["g"], "v").first()["median"] == 3.0
    ranked = spark.createDataFrame([("u", "a"), ("u", "a"), ("u", "new"), ("w", "b")], "user_id string, item_id string")
    case = spark.createDataFrame([("u", "c"), ("v", "c")], "user_id string, item_id string")
    edge = spark.createDataFrame([("u", "b"), ("w", "b"), ("x", "a")], "user_id string, item_id string")
    assert tuple(evaluation.ranking_violations(ranked, case, edge).first()) == (1, 1, 1, 1, 1)


def test_heavy_user_is_cut_into_chunks(spark, clean, monkeypatch):
    edge = ranking.edges(clean, 90).cache()
    want = sorted(ranking.item_similarity(edge).collect())
    monkeypatch.setattr(ranking, "CHUNK_LIKES", 3)
    assert sorted(ranking.item_similarity(edge).collect()) == want


def test_walk_by_joins_comes_near_the_settled_one(spark, clean, monkeypatch):
    edge = ranking.edges(clean, 90).cache()
    users = edge.select("user_id").distinct().limit(5).cache()
    want = {(r.user_id, r.item_id): r.score for r in ranking.walks(users, edge, 5).collect()}
    monkeypatch.setattr(ranking, "WORKER_BYTES", 9)
    got = {(r.user_id, r.item_id): r.score for r in ranking.walks(users, edge, 5, limit=24).collect()}
    assert got and all(got[k] == pytest.approx(want[k], abs=0.02) for k in got.keys() & want.keys())


def test_nearest_spans_take_each_start_once(spark):
    from quillrank.operators import agreement

    kind = "k string, aspect string, start int"
    target = spark.createDataFrame([("a", "x", 10), ("a", "x", 12), ("a", "x", 40), ("a", "y", 5), (None, "x", 1), ("b", "x", 3)], kind)
    told = spark.createDataFrame([("a", "x", 11), ("a", "x", 13), ("b", "y", 3), ("c", "x", 1)], kind)
    got = sorted(((r.key, r.aspect, r.start, r.found) for r in agreement.nearest_spans(target, told, "k").collect()), key=str)
    assert got == sorted([("a", "x", 10, 11), ("a", "x", 12, 13), ("a", "x", 40, None), ("a", "y", 5, None), ("b", "x", 3, None)], key=str)
    assert agreement.nearest_spans(target.limit(0), told, "k").count() == 0


def _skewed_graph():
    """Some users like nearly all items and some items are liked by nearly all users."""
    rng = np.random.default_rng(5)
    met = rng.random((60, 300)) < 0.03
    met[:2] |= rng.random((2, 300)) < 0.6
    met[:, :2] |= rng.random((60, 2)) < 0.7
    u, i = np.nonzero(met)
    liked = rng.random(len(u)) < 0.8
    return ranking.Held(u.astype(np.int32), i.astype(np.int32), liked, 60, 300), met, np.bincount(u * 300 + i, liked, 60 * 300).reshape(60, 300)


@pytest.mark.parametrize("dense", [0, 1, 32])
def test_hops_of_walk_equal_matrix(monkeypatch, dense):
    monkeypatch.setattr(ranking, "DENSE", dense)
    monkeypatch.setattr(ranking, "HELD_PATHS", 50)
    monkeypatch.setattr(ranking, "HELD_SCORES", 900)
    held, met, b = _skewed_graph()
    likes, degree = np.maximum(b.sum(1), 1), np.maximum(b.sum(0), 1)
    want = 0.85**3 * (b / likes[:, None]) @ (b / degree).T @ (b / likes[:, None])
    asked = np.flatnonzero(b.sum(1))
    rows = [r for batch in ranking.hops_top(held, "walk", ranking._walk_hops, asked, 7, lambda graph: 0.85**3 / np.maximum(np.diff(graph.likes_cut), 1)) for r in batch.to_pylist()]
    for u in asked:
        score = np.round(np.where(met[u], 0, want[u]), 12)
        top = [i for i in np.lexsort((np.arange(300), -score))[:7] if score[i] > 0]
        assert [r["i"] for r in rows if r["u"] == u] == top
        assert [r["score"] for r in rows if r["u"] == u] == pytest.approx(score[top], abs=2e-12)


def test_walk_steps_need_no_joins(spark, clean, monkeypatch):
    edge = ranking.edges(clean, 90).cache()
    users = edge.select("user_id").distinct()
    want = {(r.user_id, r["rank"], r.item_id): r.score for r in ranking.top_k(ranking.walk_steps(users, edge, steps=1), 4).collect()}
    monkeypatch.setattr(ranking, "walk_steps", None)
    assert {(r.user_id, r["rank"], r.item_id): r.score for r in ranking.steps_top(users, edge, 4).collect()} == pytest.approx(want)


def test_nearest_items_need_no_pairs(spark, clean, monkeypatch):
    edge = ranking.edges(clean, 90).cache()
    liked = defaultdict(set)
    for r in edge.where("positive").collect():
        liked[r.item_id].add(r.user_id)
    want = {}
    for a in liked:
        near = sorted((-round(len(liked[a] & liked[b]) / math.sqrt(len(liked[a]) * len(liked[b])), 12), b) for b in liked if b != a and liked[a] & liked[b])[:3]
        want |= {(a, n, b): -s for n, (s, b) in enumerate(near, 1)}
    monkeypatch.setattr(ranking, "item_similarity", None)
    assert {(r.item_id, r["rank"], r.near_item): r.score for r in ranking.nearest_items(edge, 3).collect()} == pytest.approx(want)


@pytest.mark.parametrize("dense", [0, 1, 32])
def test_neighbours_make_no_row_of_cosines_per_item(monkeypatch, dense):
    monkeypatch.setattr(ranking, "DENSE", dense)
    monkeypatch.setattr(ranking, "HELD_PATHS", 50)
    monkeypatch.setattr(ranking, "HELD_SCORES", 900)
    monkeypatch.setattr(ranking.Graph, "cosines", None)
    held, met, b = _skewed_graph()
    cosine = b.T @ b / np.sqrt(np.maximum(np.outer(b.sum(0), b.sum(0)), 1))
    np.fill_diagonal(cosine, 0)
    asked = np.flatnonzero(b.sum(1))
    rows = [r for batch in ranking.hops_top(held, "cosines", ranking._cosine_hops, asked, 7, lambda graph: np.ones(graph.users), summed=True) for r in batch.to_pylist()]
    for u in asked:
        score = np.round(np.where(met[u], 0, b[u] @ cosine), 12)
        top = [i for i in np.lexsort((np.arange(300), -score))[:7] if score[i] > 0]
        assert [r["i"] for r in rows if r["u"] == u] == top
        assert [r["score"] for r in rows if r["u"] == u] == pytest.approx(score[top], abs=2e-12)


@pytest.mark.parametrize("limit", [4, 7, 100, 400])
def test_walk_equals_plain_steps(limit, monkeypatch):
    """Lists and dense rows, over a graph of three parts, against matrices; who settles; and changes are looked at only when they may have ended."""
    monkeypatch.setattr(ranking, "DENSE", 2)
    held, _, b = _skewed_graph()
    b = np.block([[b, np.zeros((60, 4))], [np.zeros((2, 300)), np.array([[1, 1, 0, 0], [0, 0, 1, 1]])]])
    u, i = np.nonzero(b)
    walk = ranking.Walk(ranking.Graph(u, i, np.ones(len(u), bool), 62, 304), 0.85, limit, 1e-12)
    n, degree = np.maximum(b.sum(1), 1), np.maximum(b.sum(0), 1)
    asked = [0, 5, 60, 61]
    start = (b / n[:, None])[asked].T
    twice, looks = walk.twice, []
    monkeypatch.setattr(walk, "twice", lambda mass, look: looks.append(look) or twice(mass, look))
    got, change = walk.run(start)
    want = 0.85 * start
    for _ in range(limit // 2 - 1):
        want = 0.85**2 * (b / n[:, None]).T @ ((b / degree) @ want) + 0.85 * 0.15 * start
    np.testing.assert_allclose(got, want, atol=1e-11 if limit == 400 else 1e-14)
    assert (change <= 1e-12).tolist() == [limit == 400] * 4
    assert sum(looks) < 50
    assert not limit == 100 or sum(looks) < 10


def test_best_factors_without_sorting_rows():
    rng = np.random.default_rng(3)
    score = np.round(rng.normal(0, 1, (9, 700)), 1) - rng.random((9, 700)) * 1e-13
    wanted = np.array([1, 3, 3, 5, 8, 8, 13, 699, 900])
    row, column, value = ranking._near_best_first(score, wanted)
    for r, n in enumerate(wanted):
        line = np.round(score[r], 12)
        top = np.lexsort((np.arange(700), -line))[:n]
        assert column[row == r].tolist() == top.tolist()
        assert value[row == r].tolist() == line[top].tolist()


def test_factor_updates_of_equal_rows_are_summed():
    rng = np.random.default_rng(3)
    model = ranking.Factors(np.array([0]), np.array([0]), np.array([True]), 1, 2, 0.1, 0.0, rng)
    rows, values, to = np.minimum(rng.geometric(0.02, 5000), 400) - 1, rng.normal(0, 1, (5000, 4)), rng.normal(0, 1, (400, 4))
    want = to.copy()
    np.add.at(want, rows, 0.1 * values)
    model._add(to, rows, values.copy(), np.zeros(400, np.int64))
    np.testing.assert_allclose(to, want, atol=1e-11)
    model._add(to, rows[:0], values[:0], np.zeros(400, np.int64))
    np.testing.assert_allclose(to, want, atol=1e-11)
