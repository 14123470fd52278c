"""SQL that states the results of the named queries independently, for a single-node engine."""

from __future__ import annotations

METADATA = ["item_id", "parent_asin", "main_category", "title", "description_json", "features_json", "price", "brand", "images_json", "details_json"]
WORDS = ["combat", "story", "camera", "price", "fishing", "loading", "puzzle", "bazaar", "skyboxes", "crafting"]

_CLEAN = """clean AS (SELECT review_id, user_id, item_id, rating, timestamp FROM (SELECT *, row_number() OVER (PARTITION BY review_id
    ORDER BY timestamp NULLS FIRST, user_id NULLS FIRST, item_id NULLS FIRST, rating NULLS FIRST) AS rn FROM interactions
    WHERE trim(user_id) <> '' AND trim(item_id) <> '' AND timestamp IS NOT NULL) WHERE rn = 1)"""
_CUT = "cut AS (SELECT round_even(quantile_cont(timestamp, 0.8), 0)::BIGINT AS t0, round_even(quantile_cont(timestamp, 0.9), 0)::BIGINT AS t1 FROM clean)"
_BASE = f"WITH {_CLEAN}, {_CUT}"
_FIRST = "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY timestamp, review_id NULLS FIRST) AS rn FROM {}) WHERE rn = 1"
_EDGE = f"edge AS (SELECT user_id, item_id, timestamp, coalesce(rating >= 4, false) AS positive FROM ({_FIRST.format('(SELECT * FROM clean, cut WHERE timestamp < t1)')}))"


def _targets(start: str, end: str | None) -> str:
    upper = f"AND p.timestamp < {end}" if end else ""
    return f"""SELECT p.review_id, p.user_id, p.item_id, p.rating, p.timestamp FROM ({_FIRST.format('clean')}) p, cut
        WHERE p.timestamp >= {start} {upper} AND p.rating >= 4
        AND EXISTS (SELECT 1 FROM clean h WHERE h.timestamp < {start} AND h.item_id = p.item_id)
        AND NOT EXISTS (SELECT 1 FROM clean h WHERE h.timestamp < {start} AND h.item_id = p.item_id AND h.user_id = p.user_id)"""


_CASES = f"""cases AS (SELECT t.user_id, t.item_id, coalesce(h.n, 0) AS history_count FROM ({_targets('t1', None)}) t
    LEFT JOIN (SELECT user_id, count(*) AS n FROM edge GROUP BY 1) h USING (user_id) WHERE coalesce(h.n, 0) < (SELECT count(DISTINCT item_id) FROM edge))"""
_POP = """pop AS (SELECT item_id, count(*) FILTER (WHERE positive) AS popularity,
    count(*) FILTER (WHERE positive AND edge.timestamp >= t1 - 365 * 86400000::BIGINT) AS recent FROM edge, cut GROUP BY 1)"""
_ALL = f"{_BASE}, {_EDGE}, {_CASES}, {_POP}"


def _top(score: str, order: str) -> str:
    return f"""SELECT user_id, rank, item_id, score FROM (SELECT u.user_id, p.item_id, p.{score}::DOUBLE AS score,
        row_number() OVER (PARTITION BY u.user_id ORDER BY {order}) AS rank FROM (SELECT DISTINCT user_id FROM cases) u CROSS JOIN pop p
        WHERE NOT EXISTS (SELECT 1 FROM edge e WHERE e.user_id = u.user_id AND e.item_id = p.item_id)) WHERE rank <= 10"""


_B0 = _top("popularity", "p.popularity DESC, p.item_id")
_B5 = _top("recent", "p.recent DESC, p.popularity DESC, p.item_id")


def _metrics(ranked: str, cases: str, ks: list[int], more: str = "") -> str:
    key = f"user_id{', ' + more if more else ''}"
    cols = []
    for k in ks:
        ideal = f"(SELECT sum(1 / log2(i + 1)) FROM range(1, least({k}, n)::BIGINT + 1) t(i))"
        cols.append(f"coalesce(dcg_{k}, 0) / {ideal} AS ndcg_{k}, coalesce(hit_{k}, 0) / n AS recall_{k}, coalesce(hit_{k}, 0) / {k} AS precision_{k}")
    sums = ", ".join(f"sum(CASE WHEN rank <= {k} THEN 1 / log2(rank + 1) END) AS dcg_{k}, count(*) FILTER (WHERE rank <= {k}) AS hit_{k}" for k in ks)
    return f"""SELECT {key}, {', '.join(cols)} FROM (SELECT {key}, count(*) AS n FROM ({cases}) GROUP BY ALL)
        LEFT JOIN (SELECT c.user_id{', c.' + more if more else ''}, {sums} FROM ({ranked}) r JOIN ({cases}) c ON r.user_id = c.user_id AND r.item_id = c.item_id GROUP BY ALL) USING ({key})"""


_SIM = """deg AS (SELECT item_id, count(*) AS d FROM edge WHERE positive GROUP BY 1),
    pairs AS (SELECT a.item_id AS item_a, b.item_id AS item_b, count(*) AS common FROM edge a JOIN edge b USING (user_id) WHERE a.positive AND b.positive AND a.item_id <> b.item_id GROUP BY 1, 2),
    sim AS (SELECT item_a, item_b, common, common / sqrt(da.d::DOUBLE * db.d) AS similarity FROM pairs JOIN deg da ON item_a = da.item_id JOIN deg db ON item_b = db.item_id)"""
_USERS = "(SELECT DISTINCT user_id FROM cases)"

def _nan_max(c: str) -> str:
    """As the query: the largest value, NaN above all numbers and then 0."""
    return f"CASE WHEN max(isnan({c})::INT) = 1 THEN 0 ELSE coalesce(max({c}), 0) END"


_PARTS = f"""parts AS (SELECT user_id, item_id, {_nan_max('normalized_mf')} AS mf, {_nan_max('normalized_graph')} AS graph, {_nan_max('normalized_aspect')} AS aspect,
    {_nan_max('support')} AS support, coalesce(max(history_count), 0) AS history_count
    FROM hybrid_scores WHERE user_id IS NOT NULL AND item_id IS NOT NULL GROUP BY 1, 2)"""


def _percentile(c: str) -> str:
    return f"""CASE WHEN count(*) OVER (PARTITION BY user_id, {c}) = count(*) OVER (PARTITION BY user_id) THEN 0.5
        ELSE (rank() OVER (PARTITION BY user_id ORDER BY {c}) + (count(*) OVER (PARTITION BY user_id, {c}) - 1) / 2.0 - 1)::DOUBLE / (count(*) OVER (PARTITION BY user_id) - 1) END"""


_RANKED = f"ranked AS (SELECT *, {_percentile('mf')} AS rmf, {_percentile('graph')} AS rgraph, {_percentile('aspect')} AS raspect FROM parts)"


def _hybrid_top(total: str) -> str:
    return f"""WITH {_PARTS}, {_RANKED} SELECT user_id, rank, item_id, score FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank
        FROM (SELECT user_id, item_id, round({total}, 9) AS score FROM ranked)) WHERE rank <= 10"""


_H0 = _hybrid_top("0.5 * rmf + 0.25 * rgraph + 0.25 * raspect")
_GATE = "(0.5 * (5.0::DOUBLE / (5.0 + history_count)) * support)"
_T0 = _hybrid_top(f"(1 - {_GATE}) * (0.5 * rmf + 0.5 * rgraph) + {_GATE} * raspect")

_OBS = """obs AS (SELECT * EXCLUDE (rn, confidence), CASE WHEN confidence BETWEEN 0 AND 1 THEN confidence ELSE 1.0 END AS confidence,
    CASE sentiment WHEN 'positive' THEN 1.0::DOUBLE WHEN 'negative' THEN -1.0 ELSE 0.0 END AS z FROM (SELECT *, row_number() OVER (PARTITION BY evidence_id
    ORDER BY timestamp, review_id, aspect, sentiment, confidence DESC NULLS LAST) AS rn FROM t4_2_evidence
    WHERE item_id IS NOT NULL AND aspect IS NOT NULL AND review_id IS NOT NULL AND timestamp IS NOT NULL) WHERE rn = 1),
    ecut AS (SELECT round_even(quantile_cont(timestamp, 0.9), 0)::BIGINT AS c FROM obs),
    weighted AS (SELECT obs.*, confidence * exp(-ln(2.0::DOUBLE) * ((c - timestamp) / 86400000.0::DOUBLE) / 365.0::DOUBLE) AS weight FROM obs, ecut WHERE timestamp < c)"""
_CONTRIB = """contrib AS (SELECT item_id, aspect, review_id, arg_min_null(author_id, evidence_id) AS author_id, max(weight) AS q,
    CASE WHEN sum(weight) > 0 THEN sum(weight * z) / sum(weight) ELSE 0 END AS z,
    CASE WHEN sum(weight) > 0 THEN sum(weight * greatest(z, 0)) / sum(weight) ELSE 0 END AS positive,
    CASE WHEN sum(weight) > 0 THEN sum(weight * greatest(-z, 0)) / sum(weight) ELSE 0 END AS negative FROM weighted GROUP BY 1, 2, 3),
    prior AS (SELECT aspect, CASE WHEN sum(q) > 0 THEN sum(q * z) / sum(q) ELSE 0 END AS prior FROM contrib GROUP BY 1)"""
_PROFILE = """profile AS (SELECT item_id, aspect, (5 * any_value(prior) + sum(q * z)) / (5 + sum(q)) AS score, any_value(prior) AS prior, sum(q) / (5 + sum(q)) AS support, sum(q) AS total_weight,
    sum(q * positive) AS positive_mass, sum(q * negative) AS negative_mass, sum(q * greatest(0, 1 - positive - negative)) AS neutral_mass,
    count(DISTINCT author_id) AS author_count, CASE WHEN sum(q * q) > 0 THEN sum(q) * sum(q) / sum(q * q) ELSE 0 END AS effective_sample_size, count(*) AS review_count
    FROM contrib JOIN prior USING (aspect) GROUP BY 1, 2)"""
_EV = f"WITH {_OBS}, {_CONTRIB}, {_PROFILE}"
_MENTIONS = "said AS (SELECT DISTINCT author_id AS user_id, review_id, aspect FROM obs, ecut WHERE timestamp < c AND author_id IS NOT NULL), per AS (SELECT user_id, aspect, count(*) AS n FROM said GROUP BY 1, 2)"


def _weights(shared: bool) -> str:
    prior = "sum(n) / (SELECT sum(n) FROM per)" if shared else "1.0::DOUBLE / (SELECT count(DISTINCT aspect) FROM per)"
    return f"""uw AS (SELECT t.user_id, a.aspect, (coalesce(p.n, 0) + a.prior) / (t.total + 1) AS weight FROM (SELECT user_id, sum(n) AS total FROM per GROUP BY 1) t
        CROSS JOIN (SELECT aspect, {prior} AS prior FROM per GROUP BY 1) a LEFT JOIN per p ON p.user_id = t.user_id AND p.aspect = a.aspect)"""


_PASSAGE = """passage AS (SELECT *, coalesce(substr(text, start_offset + 1, end_offset - start_offset) = evidence, false) AS traceable FROM (SELECT obs.*, row_number() OVER (PARTITION BY item_id, aspect, review_id
    ORDER BY confidence DESC, evidence_id) AS rn FROM obs, ecut WHERE timestamp < c) WHERE rn = 1)"""
_CLAIM = """claim AS (SELECT p.*, s.passages, coalesce(s.authors, 0) AS authors, s.mean_confidence, s.traceable,
    CASE WHEN positive_mass + negative_mass > 0 THEN CASE WHEN positive_mass / (positive_mass + negative_mass) >= 2 / 3.0::DOUBLE THEN 'positive'
        WHEN positive_mass / (positive_mass + negative_mass) <= 1 - 2 / 3.0::DOUBLE THEN 'negative' ELSE 'conflicting' END
        WHEN score > prior THEN 'positive' WHEN score < prior THEN 'negative' ELSE 'neutral' END AS direction,
    array_to_string([x FOR x IN [CASE WHEN s.passages IS NULL THEN 'no_evidence' END, CASE WHEN NOT s.traceable THEN 'evidence_offsets_missing' END,
        CASE WHEN p.support < 0.25 THEN 'support_below_threshold' END, CASE WHEN coalesce(s.authors, 0) < 5 THEN 'distinct_authors_below_threshold' END,
        CASE WHEN p.effective_sample_size < 2 THEN 'effective_sample_size_below_threshold' END, CASE WHEN coalesce(s.mean_confidence, 0) < 0.5 THEN 'confidence_below_threshold' END] IF x IS NOT NULL], ',') AS lacks
    FROM profile p LEFT JOIN (SELECT item_id, aspect, count(*) AS passages, count(DISTINCT author_id) AS authors, avg(confidence) AS mean_confidence, bool_and(traceable) AS traceable FROM passage GROUP BY 1, 2) s USING (item_id, aspect))"""
_SIDED = """sided AS (SELECT p.*, c.direction, CASE WHEN c.direction IN ('positive', 'negative') THEN c.direction WHEN c.direction = 'conflicting' THEN
    CASE WHEN count(*) FILTER (WHERE sentiment = 'negative') OVER w > count(*) FILTER (WHERE sentiment = 'positive') OVER w THEN 'negative' ELSE 'positive' END END AS side
    FROM passage p JOIN claim c USING (item_id, aspect) WINDOW w AS (PARTITION BY item_id, aspect))"""
_CL = f"{_EV}, {_PASSAGE}, {_CLAIM}"

_missing = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) FILTER (WHERE {c} IS NULL OR trim({c}) IN ('', '[]')) AS n_missing, round(count(*) FILTER (WHERE {c} IS NULL OR trim({c}) IN ('', '[]')) / count(*), 6) AS share FROM item_metadata"
    for c in METADATA
)

ORACLE: dict[str, str] = {
    "p7_found": """
        SELECT key_name, key_value FROM (
            SELECT 'item_id' AS key_name, item_id AS key_value, count(*) AS n FROM interactions GROUP BY 2
            UNION ALL SELECT 'user_id', user_id, count(*) FROM interactions GROUP BY 2)
        WHERE trim(key_value) <> '' AND n * 20 >= (SELECT count(*) FROM interactions)""",
    "p7_per_key": """
        SELECT key_name, key_value, count(*) AS n_rows, count(CASE WHEN NOT isnan(rating) THEN 1 END) AS n_values,
            round(avg(CASE WHEN NOT isnan(rating) THEN rating END), 9) AS mean_value
        FROM (SELECT 'item_id' AS key_name, item_id AS key_value, rating FROM interactions
            UNION ALL SELECT 'user_id', user_id, rating FROM interactions) GROUP BY 1, 2""",
    "snap_events": f"{_BASE} SELECT * FROM clean",
    "snap_texts": """SELECT review_id, item_id, timestamp FROM (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY timestamp NULLS FIRST, item_id NULLS FIRST, text NULLS FIRST) AS rn
        FROM review_texts) WHERE rn = 1""",
    "snap_first_events": f"{_BASE} {_FIRST.format('clean')}",
    "snap_cutoffs": f"{_BASE} SELECT t0, t1 FROM cut",
    "snap_counts": f"""{_BASE} SELECT part, count(*) AS n_events, count(DISTINCT user_id) AS n_users, count(DISTINCT item_id) AS n_items FROM (
        SELECT 'all' AS part, * FROM clean UNION ALL SELECT 'train', clean.* FROM clean, cut WHERE timestamp < t0 UNION ALL SELECT 'fit', clean.* FROM clean, cut WHERE timestamp < t1) GROUP BY 1""",
    "snap_train": f"{_BASE} SELECT clean.* FROM clean, cut WHERE timestamp < t0",
    "snap_fit": f"{_BASE} SELECT clean.* FROM clean, cut WHERE timestamp < t1",
    "snap_validation_targets": f"{_BASE} {_targets('t0', 't1')}",
    "snap_test_targets": f"{_BASE} {_targets('t1', None)}",
    "rating_histogram": "SELECT rating, count(*) AS n FROM interactions GROUP BY 1",
    "profile_missingness": _missing,
    "profile_retention": f"""{_BASE}, past AS (SELECT clean.* FROM clean, cut WHERE timestamp < t0), hist AS (SELECT user_id, count(DISTINCT item_id) AS n FROM past GROUP BY 1),
        pairs AS (SELECT DISTINCT user_id, item_id FROM clean, cut WHERE timestamp >= t0 AND timestamp < t1 AND rating >= 4 AND item_id IN (SELECT item_id FROM past)
            AND NOT EXISTS (SELECT 1 FROM past h WHERE h.user_id = clean.user_id AND h.item_id = clean.item_id))
        SELECT (SELECT count(*) FROM hist) AS users_with_history, (SELECT count(*) FROM hist WHERE n <= 2) AS history_1_2, (SELECT count(*) FROM hist WHERE n BETWEEN 3 AND 5) AS history_3_5,
            (SELECT count(*) FROM hist WHERE n > 5) AS history_more, (SELECT count(DISTINCT user_id) FROM pairs) AS eligible_users, (SELECT count(*) FROM pairs) AS target_pairs,
            (SELECT count(DISTINCT item_id) FROM past) AS known_items""",
    "text_profile": """SELECT count(*) AS n_rows, count(*) FILTER (WHERE text IS NULL OR trim(text) = '') AS n_missing, round(avg(length(text)) FILTER (WHERE trim(text) <> ''), 9) AS mean_chars FROM review_texts""",
    "leak_late_rows": f"{_BASE} SELECT count(*) FILTER (WHERE timestamp >= t0) AS n_late, max(timestamp) AS latest FROM clean, cut WHERE timestamp < t1",
    "leak_overlap": f"{_BASE} SELECT review_id FROM ({_targets('t0', 't1')}) WHERE review_id IN (SELECT review_id FROM clean, cut WHERE timestamp < t1)",
    "popularity": f"{_BASE}, {_EDGE}, {_POP} SELECT item_id, popularity, recent FROM pop",
    "popular_top": f"{_ALL} {_B0}",
    "recent_top": f"{_ALL} {_B5}",
    "nearest_items": f"""{_ALL}, {_SIM} SELECT item_a AS item_id, rank, item_b AS near_item, score FROM (SELECT *, row_number() OVER (PARTITION BY item_a ORDER BY score DESC, item_b) AS rank
        FROM (SELECT item_a, item_b, round(similarity, 12) AS score FROM sim)) WHERE rank <= 5""",
    "neighbour_top": f"""{_ALL}, {_SIM}, own AS (SELECT user_id, rank, item_id, score FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM (
            SELECT u.user_id, s.item_b AS item_id, round(sum(s.similarity), 12) AS score
                FROM {_USERS} u JOIN edge e ON e.user_id = u.user_id AND e.positive JOIN sim s ON s.item_a = e.item_id
                WHERE NOT EXISTS (SELECT 1 FROM edge h WHERE h.user_id = u.user_id AND h.item_id = s.item_b) GROUP BY 1, 2)) WHERE rank <= 10)
        SELECT *, NULL::VARCHAR AS fallback_reason FROM own UNION ALL SELECT b.*, CASE WHEN EXISTS (SELECT 1 FROM edge e WHERE e.user_id = b.user_id AND e.positive) THEN 'no_similar_items' ELSE 'no_positive_history' END
        FROM ({_B0}) b WHERE b.user_id NOT IN (SELECT user_id FROM own)""",
    "walk_steps": f"""{_ALL}, liked AS (SELECT user_id, item_id FROM edge WHERE positive), du AS (SELECT user_id, 1.0::DOUBLE / count(*) AS u FROM liked GROUP BY 1), di AS (SELECT item_id, 1.0::DOUBLE / count(*) AS w FROM liked GROUP BY 1),
        start AS (SELECT l.user_id, l.item_id, u AS v FROM liked l JOIN du USING (user_id) WHERE user_id IN {_USERS}),
        at_users AS (SELECT s.user_id, l.user_id AS via, sum(0.85 * v * w) AS p FROM start s JOIN liked l USING (item_id) JOIN di USING (item_id) GROUP BY 1, 2),
        moved AS (SELECT a.user_id, l.item_id, 0.85 * 0.85 * p * u AS p FROM at_users a JOIN liked l ON l.user_id = a.via JOIN du ON du.user_id = a.via UNION ALL SELECT user_id, item_id, 0.85 * (1 - 0.85) * v FROM start),
        mass AS (SELECT user_id, item_id, round(sum(p), 12) AS score FROM moved m WHERE NOT EXISTS (SELECT 1 FROM edge h WHERE h.user_id = m.user_id AND h.item_id = m.item_id) GROUP BY 1, 2)
        SELECT user_id, rank, item_id, score FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM mass) WHERE rank <= 10""",
    "scaled_scores": f"""WITH {_PARTS} SELECT user_id, item_id, round({_percentile('mf')}, 9) AS by_rank,
        round(CASE WHEN max(mf) OVER w > min(mf) OVER w THEN (mf - min(mf) OVER w) / (max(mf) OVER w - min(mf) OVER w) ELSE 0.5 END, 9) AS by_range FROM parts WINDOW w AS (PARTITION BY user_id)""",
    "fixed_hybrid": _H0,
    "gated_hybrid": _T0,
    "rank_changes": f"SELECT a.user_id, a.item_id, a.rank AS rank_before, b.rank AS rank_after FROM ({_H0}) a JOIN ({_T0}) b USING (user_id, item_id) WHERE a.rank <> b.rank",
    "eval_exclusions": f"""{_BASE}, {_EDGE} SELECT reason, count(*) AS n FROM (SELECT CASE WHEN r <> 'case' THEN r WHEN row_number() OVER (PARTITION BY user_id, item_id, r ORDER BY timestamp, review_id NULLS FIRST) > 1 THEN 'target_duplicate_pair' ELSE 'case' END AS reason
        FROM (SELECT c.*, CASE WHEN timestamp < t1 THEN 'target_before_cutoff' WHEN NOT coalesce(rating >= 4, false) THEN 'target_not_positive' WHEN item_id NOT IN (SELECT item_id FROM edge) THEN 'target_unknown_item'
            WHEN EXISTS (SELECT 1 FROM edge e WHERE e.user_id = c.user_id AND e.item_id = c.item_id) THEN 'target_in_history' ELSE 'case' END AS r FROM clean c, cut WHERE timestamp >= t0)) GROUP BY 1""",
    "eval_popularity": f"""{_ALL} SELECT count(*) AS users, {', '.join(f'round(avg({m}_{k}), 9) AS {m}_{k}' for k in (5, 10) for m in ('ndcg', 'recall', 'precision'))}
        FROM ({_metrics(_B0, 'SELECT user_id, item_id FROM cases', [5, 10])})""",
    "eval_by_history": f"""{_ALL} SELECT slice, count(*) AS users, round(avg(ndcg_10), 9) AS ndcg_10, round(avg(recall_10), 9) AS recall_10 FROM ({_metrics(_B5, 'SELECT user_id, item_id FROM cases', [10])})
        JOIN (SELECT DISTINCT user_id, CASE WHEN history_count = 0 THEN 'no_history' WHEN history_count <= 2 THEN '1-2' WHEN history_count <= 5 THEN '3-5' ELSE '>5' END AS slice FROM cases) USING (user_id) GROUP BY 1""",
    "eval_by_popularity": f"""{_ALL}, thirds AS (SELECT item_id, CASE ntile(3) OVER (ORDER BY popularity, item_id) WHEN 1 THEN 'tail' WHEN 2 THEN 'middle' ELSE 'head' END AS tertile FROM pop)
        SELECT tertile, count(*) AS users, any_value(t.targets) AS targets, round(avg(ndcg_10), 9) AS ndcg_10, round(avg(recall_10), 9) AS recall_10, round(avg(precision_10), 9) AS precision_10
        FROM ({_metrics(_B0, 'SELECT user_id, item_id, tertile FROM cases JOIN thirds USING (item_id)', [10], 'tertile')}) JOIN (SELECT tertile, count(*) AS targets FROM cases JOIN thirds USING (item_id) GROUP BY 1) t USING (tertile) GROUP BY 1""",
    "popularity_thirds": f"{_BASE}, {_EDGE}, {_POP} SELECT item_id, CASE ntile(3) OVER (ORDER BY popularity, item_id) WHEN 1 THEN 'tail' WHEN 2 THEN 'middle' ELSE 'head' END AS tertile FROM pop",
    "eval_diversity": f"""{_ALL}, asp AS (SELECT DISTINCT item_id, aspect FROM t4_2_evidence WHERE item_id IS NOT NULL AND aspect IS NOT NULL), sets AS (SELECT item_id, list(aspect) AS s FROM asp GROUP BY 1),
        r AS ({_B0}) SELECT u.user_id, CASE WHEN k.n IS NULL THEN NULL WHEN k.n = 1 THEN 0.0 ELSE round(d, 9) END AS diversity FROM (SELECT DISTINCT user_id FROM r) u
        LEFT JOIN (SELECT user_id, count(*) AS n FROM r JOIN sets USING (item_id) GROUP BY 1) k USING (user_id)
        LEFT JOIN (SELECT a.user_id, avg(1 - len(list_intersect(sa.s, sb.s)) / len(list_distinct(list_concat(sa.s, sb.s)))) AS d FROM r a JOIN r b ON a.user_id = b.user_id AND a.item_id < b.item_id
            JOIN sets sa ON sa.item_id = a.item_id JOIN sets sb ON sb.item_id = b.item_id GROUP BY 1) USING (user_id)""",
    "evidence_weights": f"WITH {_OBS} SELECT evidence_id, round(weight, 9) AS weight FROM weighted",
    "aspect_priors": f"WITH {_OBS}, {_CONTRIB} SELECT aspect, round(prior, 9) AS prior FROM prior",
    "evidence_profiles": f"""{_EV} SELECT item_id, aspect, author_count, review_count, {', '.join(f'round({c}, 8) AS {c}' for c in ('score', 'support', 'total_weight', 'positive_mass', 'negative_mass', 'neutral_mass', 'effective_sample_size'))} FROM profile""",
    "user_aspect_weights": f"WITH {_OBS}, {_MENTIONS}, {_weights(True)} SELECT user_id, aspect, round(weight, 9) AS weight FROM uw",
    "aspect_match": f"""{_EV}, {_MENTIONS}, {_weights(False)} SELECT user_id, item_id, round(sum(weight * (score - prior)), 8) AS aspect_score, round(sum(weight * support), 8) AS aspect_support
        FROM (SELECT DISTINCT user_id, item_id FROM hybrid_scores) JOIN profile USING (item_id) JOIN uw USING (user_id, aspect) GROUP BY 1, 2""",
    "claim_facts": f"{_CL} SELECT item_id, aspect, direction, coalesce(passages, 0) AS passages, authors, lacks, round(score - prior, 8) AS deviation FROM claim",
    "cited_passages": f"""{_CL}, {_SIDED} SELECT item_id, aspect, place, review_id, sentiment FROM (SELECT *, row_number() OVER (PARTITION BY item_id, aspect ORDER BY grp, confidence DESC, review_id) AS place FROM (
        SELECT *, CASE WHEN sentiment = side AND n <= 2 THEN 0 WHEN side IN ('positive', 'negative') AND sentiment IN ('positive', 'negative') AND sentiment <> side AND n <= 1 THEN 1 ELSE 2 END AS grp FROM (
            SELECT *, row_number() OVER (PARTITION BY item_id, aspect, sentiment ORDER BY confidence DESC, review_id) AS n FROM sided))) WHERE place <= 3""",
    "longest_passages": f"""{_CL}, {_SIDED} SELECT item_id, aspect, on_side, place, review_id FROM (SELECT *, row_number() OVER (PARTITION BY item_id, aspect, on_side ORDER BY length(evidence) DESC, review_id) AS place FROM (
        SELECT *, sentiment = side AS on_side FROM sided WHERE side IS NOT NULL AND sentiment IN ('positive', 'negative'))) WHERE place <= CASE WHEN on_side THEN 8 ELSE 4 END""",
    "claim_thresholds": f"""{_CL} SELECT s.support, a.authors, (SELECT count(*) FROM claim WHERE claim.support >= s.support AND claim.authors >= a.authors AND NOT regexp_matches(lacks, 'no_evidence|offsets|effective|confidence')) AS supported
        FROM (VALUES (0.05::DOUBLE), (0.1), (0.25)) s(support), (VALUES (1), (2), (5)) a(authors)""",
    "evidence_removal": f"""WITH {_OBS}, {_CONTRIB}, said AS (SELECT DISTINCT item_id, aspect AS gone, review_id FROM contrib)
        SELECT w.item_id, g.gone AS aspect, w.aspect AS other_aspect, round((5 * prior + w.qz) / (5 + w.q) - prior, 8) AS before,
            round((5 * prior + w.qz - coalesce(x.qz, 0)) / (5 + w.q - coalesce(x.q, 0)) - prior, 8) AS after
        FROM (SELECT item_id, aspect, sum(q) AS q, sum(q * z) AS qz FROM contrib GROUP BY 1, 2) w JOIN (SELECT DISTINCT item_id, gone FROM said) g USING (item_id) JOIN prior USING (aspect)
        LEFT JOIN (SELECT c.item_id, s.gone, c.aspect, sum(q) AS q, sum(q * z) AS qz FROM contrib c JOIN said s ON s.item_id = c.item_id AND s.review_id = c.review_id GROUP BY 1, 2, 3) x
            ON x.item_id = w.item_id AND x.gone = g.gone AND x.aspect = w.aspect""",
    "word_matches": f"""SELECT DISTINCT review_id, term FROM (SELECT review_id, unnest(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}_]+')) AS term FROM (SELECT *, row_number() OVER (PARTITION BY review_id
        ORDER BY timestamp NULLS FIRST, item_id NULLS FIRST, text NULLS FIRST) AS rn FROM review_texts) WHERE rn = 1 AND review_id IS NOT NULL) WHERE term IN ({', '.join(f"'{w}'" for w in WORDS)})""",
    "merged_labels": """WITH raw AS (SELECT review_id, aspect, sentiment, start_offset - 20 AS s, end_offset + 20 AS e FROM t4_2_evidence WHERE review_id IS NOT NULL AND aspect IS NOT NULL AND sentiment IS NOT NULL AND start_offset IS NOT NULL AND end_offset IS NOT NULL),
        spans AS (SELECT review_id, aspect, s, e, unnest(CASE WHEN bool_or(sentiment = 'positive') AND bool_or(sentiment = 'negative') THEN ['neutral'] ELSE list(DISTINCT sentiment) END) AS polarity FROM raw WHERE s < e GROUP BY 1, 2, 3, 4),
        marked AS (SELECT *, max(e) OVER (PARTITION BY review_id, aspect, polarity ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM spans),
        islands AS (SELECT *, sum(CASE WHEN reach IS NOT NULL AND s < reach THEN 0 ELSE 1 END) OVER (PARTITION BY review_id, aspect, polarity ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM marked),
        merged AS (SELECT review_id, aspect, polarity, min(s) AS start, max(e) AS "end" FROM islands GROUP BY review_id, aspect, polarity, island)
        SELECT review_id, row_number() OVER (PARTITION BY review_id ORDER BY start, "end", aspect, polarity) - 1 AS label_index, aspect, polarity, start, "end" FROM merged""",
    "last_success": """SELECT review_id, item_id, timestamp FROM (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY ingested_at DESC NULLS LAST, timestamp DESC NULLS LAST, user_id DESC NULLS LAST, item_id DESC NULLS LAST) AS rn
        FROM interactions WHERE review_id IS NOT NULL AND ingested_at IS NOT NULL AND rating IS NOT NULL) WHERE rn = 1""",
    "quota_sample": f"""{_BASE}, s AS (SELECT *, row_number() OVER (PARTITION BY trunc(rating) ORDER BY timestamp, review_id) AS n FROM clean WHERE trunc(rating) IN (1, 2, 3, 4, 5)),
        q AS (SELECT * FROM s WHERE n <= 15) SELECT review_id, rating, 'quota' AS picked FROM q UNION ALL
        SELECT review_id, rating, 'fill' FROM (SELECT *, row_number() OVER (ORDER BY timestamp, review_id) AS f FROM s WHERE n > 15) WHERE f <= 100 - (SELECT count(*) FROM q)""",
    "pair_agreement": f"""WITH {_OBS}, t AS (SELECT DISTINCT review_id, aspect, sentiment FROM obs WHERE confidence >= 0.6), p AS (SELECT DISTINCT review_id, aspect, sentiment FROM obs WHERE confidence <= 0.8),
        n AS (SELECT (SELECT count(*) FROM t JOIN p USING (review_id, aspect, sentiment)) AS tp, (SELECT count(*) FROM p) AS np, (SELECT count(*) FROM t) AS nt)
        SELECT tp, np - tp AS fp, nt - tp AS fn, round(tp / np, 9) AS precision, round(tp / nt, 9) AS recall, round(2 * (tp / np) * (tp / nt) / (tp / np + tp / nt), 9) AS f1 FROM n""",
    "valid_spans": """SELECT n_valid, n, round(n_valid / n, 9) AS valid_rate FROM (SELECT count(*) FILTER (WHERE start_offset >= 0 AND start_offset <= end_offset
        AND substr(text, start_offset + 1, end_offset - start_offset) = evidence) AS n_valid, count(*) AS n FROM t4_2_evidence)""",
    "evidence_states": f"""WITH {_OBS} SELECT item_id, CASE WHEN bool_or(confidence - 0.4 >= 0.25 AND sentiment = 'positive') AND bool_or(confidence - 0.4 >= 0.25 AND sentiment = 'negative') THEN 'conflicting'
        WHEN max(confidence - 0.4) < 0.25 THEN 'insufficient_support' ELSE 'supported' END AS state FROM obs GROUP BY 1""",
    "temporary_priorities": f"""{_EV}, {_MENTIONS}, {_weights(False)}, {_PARTS}, one AS (SELECT x.user_id, x.item_id, CASE WHEN sum(coalesce(w, 0)) > 0 THEN sum(coalesce(w, 0) * p.score) / sum(coalesce(w, 0)) ELSE avg(p.score) END AS adjusted
        FROM parts x JOIN profile p USING (item_id) LEFT JOIN (SELECT user_id, aspect, weight + CASE WHEN aspect = 'story' THEN 1.0 ELSE 0.0 END AS w FROM uw) u ON u.user_id = x.user_id AND u.aspect = p.aspect GROUP BY 1, 2),
        t AS (SELECT user_id, item_id, round(CASE WHEN adjusted IS NOT NULL THEN round(mf * 0.5 + 0.25 * aspect, 12) - 0.25 * aspect + 0.25 * adjusted ELSE round(mf * 0.5 + 0.25 * aspect, 12) END, 12) AS total_score FROM parts LEFT JOIN one USING (user_id, item_id))
        SELECT user_id, item_id, round(total_score, 9) AS total_score FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY total_score DESC, item_id) AS rank FROM t) WHERE rank <= 10""",
    "stream_daily_counts": "SELECT strftime(ingested_at, '%Y-%m-%d') AS day, item_id, count(*) AS n FROM interactions WHERE ingested_at IS NOT NULL AND item_id IS NOT NULL GROUP BY 1, 2",
    "ranking_checks": f"""{_ALL}, flat AS (SELECT user_id, unnest(item_ids) AS item_id FROM topk_recommendations), r AS (SELECT * FROM flat WHERE user_id IS NOT NULL AND item_id IS NOT NULL)
        SELECT (SELECT count(*) FROM (SELECT user_id, item_id FROM r GROUP BY 1, 2 HAVING count(*) > 1)) AS repeated_items, (SELECT count(*) FROM r WHERE item_id NOT IN (SELECT item_id FROM edge)) AS unknown_items,
            (SELECT count(*) FROM r WHERE (user_id, item_id) IN (SELECT (user_id, item_id) FROM edge)) AS met_items, (SELECT count(DISTINCT user_id) FROM r WHERE user_id NOT IN (SELECT user_id FROM cases)) AS foreign_users,
            (SELECT count(DISTINCT user_id) FROM cases WHERE user_id NOT IN (SELECT user_id FROM r)) AS missing_users""",
    "first_seen": f"{_BASE} SELECT item_id, min(timestamp) AS first_seen, max(timestamp) AS last_seen, count(*) AS n FROM clean GROUP BY 1",
    "shuffled_reviews": f"{_BASE} SELECT review_id FROM clean, cut WHERE review_id IS NOT NULL ORDER BY (timestamp < t0) DESC, sha256(review_id), review_id LIMIT 100",
    "removal_medians": f"""WITH {_OBS}, {_CONTRIB}, w AS (SELECT item_id, aspect, sum(q) AS q, sum(q * z) AS qz, any_value(prior) AS prior FROM contrib JOIN prior USING (aspect) GROUP BY 1, 2),
        d AS (SELECT aspect, abs((5 * prior) / 5 - prior - ((5 * prior + qz) / (5 + q) - prior)) AS change FROM w)
        SELECT aspect, round(change, 8) AS median FROM (SELECT *, row_number() OVER (PARTITION BY aspect ORDER BY change) AS at_, count(*) OVER (PARTITION BY aspect) AS n FROM d) WHERE at_ = n // 2 + 1""",
    "claim_summary": f"""{_CL}, m AS (SELECT aspect, direction, CASE WHEN lacks = '' THEN 'supported' ELSE 'insufficient_support' END AS status FROM claim)
        SELECT 'all' AS key_name, 'all' AS key_value, status, count(*) AS n FROM m GROUP BY 3 UNION ALL SELECT 'aspect', aspect, status, count(*) FROM m GROUP BY 2, 3
        UNION ALL SELECT 'direction', direction, status, count(*) FROM m GROUP BY 2, 3""",
    "located_evidence": f"""WITH {_OBS} SELECT evidence_id, (strpos(text, evidence) - 1)::INTEGER AS start, (strpos(text, evidence) - 1 + length(evidence))::INTEGER AS "end" FROM obs""",
}
