"""SQL that states the results of the queries over explanations independently."""

from __future__ import annotations

from quillrank.plans.sql import _CL, _CONTRIB, _MENTIONS, _OBS, _SIDED, _nan_max, _weights

_RANKED = f"""totals AS (SELECT user_id, item_id, round({_nan_max('total_score')}, 9) AS score, {_nan_max('aspect_contribution')} <> 0 AS aspect_in_score FROM hybrid_scores
    WHERE user_id IS NOT NULL AND item_id IS NOT NULL GROUP BY 1, 2), ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM totals) WHERE rank <= 11),
    recs AS (SELECT * FROM ranked WHERE rank <= 10)"""
_SAID = """CASE direction WHEN 'conflicting' THEN concat('opinions differ, ', round_even(100 * share, 0)::INT, '% are positive') WHEN 'negative' THEN concat(round_even(100 * (1 - share), 0)::INT, '% of opinions are negative')
    WHEN 'positive' THEN concat(round_even(100 * share, 0)::INT, '% of opinions are positive') END"""


def _explained(n: int) -> str:
    return f"""{_CL}, {_MENTIONS}, {_weights(False)}, {_RANKED}, pulls AS (SELECT r.user_id, r.item_id, r.aspect_in_score, c.aspect, c.direction, c.lacks, u.weight * (c.score - c.prior) AS pull,
        CASE WHEN positive_mass + negative_mass > 0 THEN positive_mass / (positive_mass + negative_mass) END AS share FROM recs r JOIN claim c USING (item_id) JOIN uw u ON u.user_id = r.user_id AND u.aspect = c.aspect),
    explained AS (SELECT user_id, item_id, place, aspect, CASE WHEN lacks = '' THEN 'supported' ELSE 'insufficient_support' END AS status, direction, CASE WHEN aspect_in_score THEN pull ELSE 0 END AS contribution,
        CASE WHEN lacks <> '' THEN lacks END AS reason, CASE WHEN lacks = '' THEN item_id || ', ' || aspect || ': ' || {_SAID} END AS claim
        FROM (SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY round(abs(pull), 12) DESC, aspect) AS place FROM pulls) WHERE place <= {n})"""


_STATUS = """status AS (SELECT r.user_id, r.item_id, r.rank, r.aspect_in_score, CASE WHEN g THEN 'supported' WHEN NOT g THEN 'insufficient_support' ELSE 'unavailable' END AS status FROM recs r
    LEFT JOIN (SELECT user_id, item_id, bool_or(status = 'supported') AS g FROM explained GROUP BY 1, 2) USING (user_id, item_id))"""
_USES = "uses AS (SELECT item_id, aspect, direction, count(*) AS uses FROM explained WHERE status = 'supported' GROUP BY 1, 2, 3)"
_SAMPLE = """sample AS (SELECT direction AS stratum, stratum_size, item_id, aspect, uses FROM (SELECT *, count(*) OVER (PARTITION BY direction) AS stratum_size,
        row_number() OVER (PARTITION BY direction ORDER BY sha256('7|' || item_id || '|' || aspect), item_id, aspect) AS at_ FROM uses) WHERE at_ <= 5
    UNION ALL SELECT * FROM (SELECT 'top_exposure', (SELECT count(*) FROM uses), item_id, aspect, uses FROM uses ORDER BY uses DESC, item_id, aspect LIMIT 3))"""


def _effects(mine: str, pool: str) -> str:
    return f"""spoken AS (SELECT DISTINCT item_id, aspect AS gone, review_id, sha256('7|' || item_id || '|' || aspect || '|' || review_id) AS draw FROM contrib), {mine}, {pool},
    cnt AS (SELECT item_id, gone, count(*) AS cited_count FROM mine GROUP BY 1, 2),
    drawn AS (SELECT item_id, gone, review_id FROM (SELECT p.*, row_number() OVER (PARTITION BY item_id, gone ORDER BY sha256('7|' || item_id || '|' || gone || '|' || review_id), review_id) AS at_ FROM pool p) JOIN cnt USING (item_id, gone) WHERE at_ <= cited_count),
    lost AS (SELECT c.item_id, s.gone, c.aspect, sum(q) AS q, sum(q * z) AS qz FROM contrib c JOIN mine s USING (item_id, review_id) GROUP BY 1, 2, 3),
    lost2 AS (SELECT c.item_id, s.gone, c.aspect, sum(q) AS q, sum(q * z) AS qz FROM contrib c JOIN drawn s USING (item_id, review_id) GROUP BY 1, 2, 3),
    effects AS (SELECT w.item_id, n.gone AS aspect, w.aspect AS other_aspect, (5 * prior + w.qz) / (5 + w.q) - prior AS before, (5 * prior + w.qz - coalesce(x.qz, 0)) / (5 + w.q - coalesce(x.q, 0)) - prior AS cited,
        (5 * prior + w.qz - coalesce(y.qz, 0)) / (5 + w.q - coalesce(y.q, 0)) - prior AS random, n.cited_count, coalesce(d.n, 0) AS random_count, coalesce(d.n, 0) < n.cited_count AS pool_short
        FROM (SELECT item_id, aspect, sum(q) AS q, sum(q * z) AS qz FROM contrib GROUP BY 1, 2) w JOIN cnt n USING (item_id) JOIN prior ON prior.aspect = w.aspect
        LEFT JOIN (SELECT item_id, gone, count(*) AS n FROM drawn GROUP BY 1, 2) d ON d.item_id = w.item_id AND d.gone = n.gone
        LEFT JOIN lost x ON x.item_id = w.item_id AND x.gone = n.gone AND x.aspect = w.aspect LEFT JOIN lost2 y ON y.item_id = w.item_id AND y.gone = n.gone AND y.aspect = w.aspect)"""


_OTHERS = _effects("mine AS (SELECT item_id, gone, review_id FROM spoken)", "pool AS (SELECT DISTINCT c.item_id, g.gone, c.review_id FROM contrib c JOIN (SELECT DISTINCT item_id, gone FROM spoken) g USING (item_id) WHERE (c.item_id, g.gone, c.review_id) NOT IN (SELECT (item_id, gone, review_id) FROM spoken))")
_SAME = _effects(
    "halves AS (SELECT *, row_number() OVER (PARTITION BY item_id, gone ORDER BY draw, review_id) <= ceil(count(*) OVER (PARTITION BY item_id, gone) / 2) AS mine FROM spoken), mine AS (SELECT item_id, gone, review_id FROM halves WHERE mine)",
    "pool AS (SELECT item_id, gone, review_id FROM halves WHERE NOT mine)",
)
_FAITHFUL = f"""{_explained(1)}, {_OTHERS}, match AS (SELECT user_id, item_id, sum(weight * (score - prior)) AS s FROM (SELECT DISTINCT user_id, item_id FROM hybrid_scores) JOIN profile USING (item_id) JOIN uw USING (user_id, aspect) GROUP BY 1, 2),
    span AS (SELECT user_id, max(s) - min(s) AS width FROM match GROUP BY 1), nxt AS (SELECT user_id, max(score) FILTER (WHERE rank = 11) AS next_score FROM ranked GROUP BY 1),
    f AS (SELECT e.user_id, e.item_id, e.aspect, any_value(e.direction) AS direction, any_value(cited_count) AS cited_count, any_value(random_count) AS random_count, any_value(pool_short) AS pool_short,
        CASE WHEN any_value(width) > 0 THEN 0.25 * sum(weight * (cited - before)) / any_value(width) ELSE 0 END AS d, CASE WHEN any_value(width) > 0 THEN 0.25 * sum(weight * (random - before)) / any_value(width) ELSE 0 END AS rd,
        any_value(r.score) AS score, any_value(next_score) AS next_score FROM explained e JOIN effects x ON x.item_id = e.item_id AND x.aspect = e.aspect JOIN uw u ON u.user_id = e.user_id AND u.aspect = x.other_aspect
        JOIN span ON span.user_id = e.user_id JOIN recs r ON r.user_id = e.user_id AND r.item_id = e.item_id JOIN nxt ON nxt.user_id = e.user_id GROUP BY 1, 2, 3),
    faithful AS (SELECT user_id, item_id, aspect, direction, cited_count, random_count, pool_short, d, rd, d * CASE direction WHEN 'positive' THEN -1 WHEN 'negative' THEN 1 END > 1e-9 AS moves_as_claimed,
        CASE WHEN next_score IS NOT NULL THEN score + d < next_score END AS leaves, CASE WHEN next_score IS NOT NULL THEN score + rd < next_score END AS random_leaves FROM f)"""
_LONG = f"""{_CL}, {_SIDED}, cand AS (SELECT item_id, aspect, review_id, sentiment, on_side, place FROM (SELECT *, row_number() OVER (PARTITION BY item_id, aspect, on_side ORDER BY length(evidence) DESC, review_id) AS place FROM (
        SELECT *, sentiment = side AS on_side FROM sided WHERE side IS NOT NULL AND sentiment IN ('positive', 'negative'))) WHERE place <= CASE WHEN on_side THEN 8 ELSE 4 END),
    verdict AS (SELECT review_id, aspect, max(confidence) >= 0.5 AS about, min(sentiment) AS polarity FROM passage GROUP BY 1, 2),
    facing AS (SELECT c.item_id, c.aspect, c.direction, CASE WHEN c.direction IN ('positive', 'negative') THEN c.direction WHEN c.direction = 'conflicting' THEN CASE WHEN n > p THEN 'negative' ELSE 'positive' END END AS side FROM claim c
        LEFT JOIN (SELECT item_id, aspect, count(*) FILTER (WHERE sentiment = 'positive') AS p, count(*) FILTER (WHERE sentiment = 'negative') AS n FROM cand GROUP BY 1, 2) USING (item_id, aspect)),
    passing AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id, aspect, grp ORDER BY on_side DESC, place, review_id) AS at_ FROM (SELECT x.*, v.polarity,
        CASE WHEN v.polarity = f.side THEN 'own' WHEN v.polarity IN ('positive', 'negative') THEN 'other' END AS grp FROM cand x JOIN facing f USING (item_id, aspect) JOIN verdict v USING (review_id, aspect) WHERE v.about AND f.side IS NOT NULL)
        WHERE grp IS NOT NULL) WHERE at_ <= CASE grp WHEN 'own' THEN 2 ELSE 1 END),
    kept AS (SELECT f.item_id, f.aspect, f.direction, coalesce(o AND (t OR f.direction <> 'conflicting'), false) AS keeps FROM facing f LEFT JOIN (SELECT item_id, aspect, bool_or(grp = 'own') AS o, bool_or(grp = 'other') AS t FROM passing GROUP BY 1, 2) USING (item_id, aspect))"""
_EFFECT_COLUMNS = "round(before, 8) AS before, round(cited, 8) AS cited, round(random, 8) AS random, cited_count, random_count, pool_short"

ORACLE: dict[str, str] = {
    "dense_profiles": f"""{_CL} SELECT item_id, aspect, round(coalesce(p.prior, r.prior, 0), 8) AS prior, round(coalesce(p.score, r.prior, 0), 8) AS score, round(coalesce(p.support, 0), 8) AS support,
        round(coalesce(p.effective_sample_size, 0), 8) AS effective_sample_size, coalesce(author_count, 0) AS author_count, coalesce(review_count, 0) AS review_count
        FROM (SELECT DISTINCT item_id FROM obs) CROSS JOIN (SELECT DISTINCT aspect FROM obs) LEFT JOIN profile p USING (item_id, aspect) LEFT JOIN prior r USING (aspect)""",
    "explained_claims": f"{_explained(2)} SELECT user_id, item_id, place, aspect, status, direction, round(contribution, 9) AS contribution, reason, claim FROM explained",
    "explained_items": f"{_explained(2)}, {_STATUS} SELECT user_id, item_id, rank, status FROM status",
    "explained_summary": f"""{_explained(2)}, {_STATUS}
        SELECT 'all' AS key_name, 'all' AS key_value, 'status:' || status AS name, count(*) AS n FROM status GROUP BY 3 UNION ALL SELECT 'rank', rank::VARCHAR, 'status:' || status, count(*) FROM status GROUP BY 2, 3
        UNION ALL SELECT 'aspect_in_score', aspect_in_score::VARCHAR, 'status:' || status, count(*) FROM status GROUP BY 2, 3
        UNION ALL SELECT 'all', 'all', 'users_with_supported', count(DISTINCT user_id) FROM status WHERE status = 'supported'
        UNION ALL SELECT 'all', 'all', 'direction:' || direction, count(*) FROM explained WHERE status = 'supported' GROUP BY 3
        UNION ALL SELECT 'all', 'all', 'refusal:' || r, count(*) FROM (SELECT unnest(string_split(reason, ',')) AS r FROM explained WHERE reason IS NOT NULL) GROUP BY 3""",
    "next_scores": f"WITH {_RANKED} SELECT user_id, max(score) FILTER (WHERE rank = 11) AS next_score FROM ranked GROUP BY 1",
    "removal_effects": f"WITH {_OBS}, {_CONTRIB}, {_OTHERS} SELECT item_id, aspect, other_aspect, {_EFFECT_COLUMNS} FROM effects",
    "removal_audit": f"WITH {_OBS}, {_CONTRIB}, {_SAME} SELECT item_id, aspect, {_EFFECT_COLUMNS} FROM effects WHERE aspect = other_aspect",
    "faithfulness": f"""{_FAITHFUL} SELECT user_id, item_id, aspect, direction, cited_count, random_count, pool_short, round(d, 8) AS score_delta, round(rd, 8) AS random_score_delta, moves_as_claimed, leaves, random_leaves FROM faithful""",
    "faithfulness_summary": f"""{_FAITHFUL}, e AS (SELECT unnest(['all', direction]) AS direction, * EXCLUDE (direction), round(abs(d), 12) AS a, round(abs(rd), 12) AS b FROM faithful)
        SELECT direction, count(*) AS n, count(*) FILTER (WHERE pool_short) AS short_pools, count(*) FILTER (WHERE leaves) AS leaves, count(*) FILTER (WHERE random_leaves) AS random_leaves,
            round(list_sort(list(a))[count(*) // 2 + 1], 8) AS median_change, round(list_sort(list(b))[count(*) // 2 + 1], 8) AS random_median_change FROM e GROUP BY 1""",
    "verified_passages": f'{_LONG} SELECT item_id, aspect, review_id, polarity, grp AS "group" FROM passing',
    "verified_claims": f"{_LONG} SELECT * FROM kept",
    "claim_exposure": f"{_explained(2)}, {_USES} SELECT * FROM uses",
    "judge_sample": f"{_explained(2)}, {_USES}, {_SAMPLE} SELECT * FROM sample",
    "judge_summary": f"""{_explained(2)}, {_USES}, {_SAMPLE}, {_LONG[len(_CL) + 2:]}, j AS (SELECT s.*, k.keeps FROM sample s LEFT JOIN kept k USING (item_id, aspect)),
        e AS (SELECT * FROM j UNION ALL SELECT 'all', * EXCLUDE (stratum) FROM j WHERE stratum <> 'top_exposure')
        SELECT stratum, count(*) AS claims, count(keeps) AS judged, round(count(*) FILTER (WHERE keeps) / count(keeps), 9) AS supported_share, round(coalesce(sum(uses) FILTER (WHERE keeps), 0) / sum(uses) FILTER (WHERE keeps IS NOT NULL), 9) AS weighted_share FROM e GROUP BY 1""",
}
