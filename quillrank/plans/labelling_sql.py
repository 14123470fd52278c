"""SQL that states the results of the queries over labels and joined texts independently."""

from __future__ import annotations

from quillrank.operators.labels import ASPECT_TERMS, ASPECTS
from quillrank.plans.sql import _BASE, _OBS

_TERMS = ", ".join(f"('{a}', '{t}')" for a, terms in ASPECT_TERMS.items() for t in terms)
_TEXTS = "texts AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY timestamp NULLS FIRST, item_id NULLS FIRST, text NULLS FIRST) AS rn FROM review_texts) WHERE rn = 1)"
_F1 = "CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END"
_PR = "CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r"
_TWO = f"""{_OBS}, first AS (SELECT review_id, aspect, arg_min(sentiment, evidence_id) AS s FROM obs GROUP BY 1, 2), last AS (SELECT review_id, aspect, arg_max(sentiment, evidence_id) AS s FROM obs GROUP BY 1, 2)"""
_CLASS = " + ".join(f"CASE WHEN count(*) FILTER (WHERE t = '{c}') + count(*) FILTER (WHERE p = '{c}') > 0 THEN 2 * count(*) FILTER (WHERE t = '{c}' AND p = '{c}') / (count(*) FILTER (WHERE t = '{c}') + count(*) FILTER (WHERE p = '{c}')) ELSE 0 END" for c in ("positive", "negative", "neutral"))
_SPANS = f"""{_OBS}, t AS (SELECT review_id, aspect, start_offset AS s, end_offset AS e FROM obs WHERE confidence >= 0.6),
    p AS (SELECT *, coalesce(start_offset >= 0 AND start_offset <= end_offset AND end_offset <= length(text) AND substr(text, start_offset + 1, end_offset - start_offset) = evidence, false) AS valid FROM obs WHERE confidence < 0.8)"""


def _retention(name: str, start: str, end: str | None) -> str:
    upper = f"AND timestamp < {end}" if end else ""
    return f"""
        (WITH past AS (SELECT clean.* FROM clean, cut WHERE timestamp < {start}), h AS (SELECT user_id, count(DISTINCT item_id) AS n FROM past GROUP BY 1),
        pairs AS (SELECT DISTINCT user_id, item_id FROM clean, cut WHERE timestamp >= {start} {upper} AND rating >= 4 AND item_id IN (SELECT item_id FROM past) AND (user_id, item_id) NOT IN (SELECT (user_id, item_id) FROM past))
        SELECT (SELECT count(*) FROM h) AS users_with_history, (SELECT count(*) FROM h WHERE n <= 2) AS history_1_2, (SELECT count(*) FROM h WHERE n BETWEEN 3 AND 5) AS history_3_5, (SELECT count(*) FROM h WHERE n > 5) AS history_more,
            (SELECT count(DISTINCT user_id) FROM pairs) AS eligible_users, (SELECT count(*) FROM pairs) AS target_pairs, (SELECT count(DISTINCT item_id) FROM past) AS known_items, '{name}' AS "window")"""


ORACLE: dict[str, str] = {
    "weak_aspects": f"WITH {_TEXTS} SELECT DISTINCT review_id, a AS aspect FROM texts, (VALUES {_TERMS}) v(a, t) WHERE review_id IS NOT NULL AND contains(lower(text), t)",
    "aspect_f1": f"""WITH said AS (SELECT DISTINCT unit_id, a FROM eval_units, (VALUES {_TERMS}) v(a, t) WHERE contains(lower(text), t)), names AS (SELECT unnest([{', '.join(f"'{a}'" for a in ASPECTS)}]) AS label),
        n AS (SELECT label, (SELECT count(*) FROM eval_units u JOIN said s ON s.unit_id = u.unit_id AND s.a = u.aspect WHERE u.aspect = label) AS tp,
            (SELECT count(*) FROM said WHERE a = label) AS np, (SELECT count(*) FROM eval_units WHERE aspect = label) AS nt FROM names),
        c AS (SELECT label, tp, np - tp AS fp, nt - tp AS fn FROM n), own AS (SELECT *, {_PR} FROM c), micro AS (SELECT *, {_PR} FROM (SELECT 'micro' AS label, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM c))
        SELECT label, tp, fp, fn, round(p, 9) AS precision, round(r, 9) AS recall, round({_F1}, 9) AS f1 FROM (SELECT * FROM own UNION ALL SELECT * FROM micro)
        UNION ALL SELECT 'macro', sum(tp)::BIGINT, sum(fp)::BIGINT, sum(fn)::BIGINT, round(avg(p), 9), round(avg(r), 9), round(avg({_F1}), 9) FROM own""",
    "sentiment_f1": f"""WITH {_TWO}, j AS (SELECT f.s AS t, CASE WHEN (length(review_id) + ascii(review_id)) % 5 <> 0 AND l.s IN ('positive', 'negative', 'neutral') THEN l.s END AS p FROM first f LEFT JOIN last l USING (review_id, aspect) WHERE f.s IN ('positive', 'negative', 'neutral')),
        e AS (SELECT 'all' AS scope, * FROM j UNION ALL SELECT 'covered', * FROM j WHERE p IS NOT NULL)
        SELECT scope, count(*) AS n, count(p) AS covered, round(count(*) FILTER (WHERE t = p) / count(*), 9) AS accuracy, round(({_CLASS}) / 3, 9) AS macro_f1 FROM e GROUP BY 1""",
    "contained_spans": f"""WITH {_SPANS}, m AS (SELECT p.evidence_id, any_value(valid) AS valid, count(t.s) AS met, count(*) FILTER (WHERE start_offset <= s AND s <= e AND e <= end_offset) AS held FROM p LEFT JOIN t USING (review_id, aspect) GROUP BY 1)
        SELECT count(*) AS n, count(*) FILTER (WHERE valid) AS n_valid, count(*) FILTER (WHERE valid AND met > 0) AS n_comparable, count(*) FILTER (WHERE valid AND met > 0 AND held > 0) AS n_contained FROM m""",
    "record_checks": f"""WITH {_OBS} SELECT count(*) FILTER (WHERE evidence_id IS NULL OR coalesce(trim(review_id), '') = '' OR coalesce(trim(item_id), '') = '' OR coalesce(trim(author_id), '') = '' OR coalesce(trim(sentiment), '') = '') AS missing_fields,
        count(*) FILTER (WHERE coalesce(start_offset < 0 OR start_offset > end_offset OR end_offset > length(text), true)) AS bad_offsets,
        count(*) FILTER (WHERE NOT coalesce(substr(text, start_offset + 1, end_offset - start_offset) = evidence, false)) AS no_slice,
        count(*) FILTER (WHERE NOT coalesce(aspect IN ({', '.join(f"'{a}'" for a in ASPECTS)}), false)) AS unknown_aspects, count(*) FILTER (WHERE coalesce(timestamp >= c, true)) AS late_rows FROM t4_2_evidence, ecut""",
    "record_differences": f"""WITH {_TWO} SELECT 'aspect' AS column_name, 0::BIGINT AS n UNION ALL SELECT 'sentiment', count(*) FROM first f JOIN last l USING (review_id, aspect) WHERE f.s IS DISTINCT FROM l.s
        UNION ALL SELECT 'only_left', 0 UNION ALL SELECT 'only_right', 0""",
    "attached_authors": f"{_BASE}, {_TEXTS} SELECT t.review_id, t.item_id, c.user_id FROM texts t JOIN clean c ON c.review_id = t.review_id AND c.item_id = t.item_id, cut WHERE c.timestamp < t1",
    "attached_checks": f"""{_BASE}, {_TEXTS}, e AS (SELECT clean.* FROM clean, cut WHERE timestamp < t1) SELECT count(*) FILTER (WHERE e.item_id IS NULL) AS without_event,
        count(*) FILTER (WHERE e.item_id IS NOT NULL AND e.item_id IS DISTINCT FROM t.item_id) AS other_item, count(*) FILTER (WHERE e.item_id = t.item_id) AS attached FROM texts t LEFT JOIN e USING (review_id) WHERE t.review_id IS NOT NULL""",
    "catalogued_events": f"""{_BASE}, m AS (SELECT item_id, arg_max({{'b': brand, 't': title}}, concat_ws('', coalesce(parent_asin, ''), chr(1), coalesce(title, ''), chr(1), coalesce(brand, ''))) AS v FROM item_metadata WHERE metadata_found AND item_id IS NOT NULL GROUP BY 1)
        SELECT review_id, item_id, v.b AS brand, v.t AS title FROM clean JOIN m USING (item_id)""",
    "fresh_texts": f"""{_BASE}, {_TEXTS}, s AS (SELECT *, row_number() OVER (PARTITION BY trunc(rating) ORDER BY timestamp, review_id) AS n FROM clean WHERE trunc(rating) IN (1, 2, 3, 4, 5)), q AS (SELECT review_id FROM s WHERE n <= 15),
        pilot AS (SELECT review_id FROM q UNION ALL SELECT review_id FROM (SELECT *, row_number() OVER (ORDER BY timestamp, review_id) AS f FROM s WHERE n > 15) WHERE f <= 100 - (SELECT count(*) FROM q)),
        g AS (SELECT DISTINCT item_id, duplicate_group FROM texts WHERE review_id IN (SELECT review_id FROM pilot))
        SELECT t.review_id, t.item_id, c.user_id FROM texts t JOIN clean c USING (review_id) WHERE t.review_id NOT IN (SELECT review_id FROM pilot WHERE review_id IS NOT NULL)
            AND NOT EXISTS (SELECT 1 FROM g WHERE g.item_id IS NOT DISTINCT FROM t.item_id AND g.duplicate_group IS NOT DISTINCT FROM t.duplicate_group)""",
    "item_label_counts": f"WITH {_OBS} SELECT i.item_id, count(o.evidence_id) AS labels, count(DISTINCT o.review_id) AS reviews FROM (SELECT DISTINCT item_id FROM item_metadata WHERE item_id IS NOT NULL) i LEFT JOIN obs o USING (item_id) GROUP BY 1",
    "curation_counts": """WITH raw AS (SELECT review_id, aspect, sentiment, start_offset AS s, end_offset AS e FROM t4_2_evidence WHERE review_id IS NOT NULL AND aspect IS NOT NULL AND sentiment IS NOT NULL AND start_offset IS NOT NULL AND end_offset IS NOT NULL),
        grouped AS (SELECT review_id, aspect, s, e, bool_or(sentiment = 'positive') AND bool_or(sentiment = 'negative') AS mixed, list(DISTINCT sentiment) AS p FROM raw WHERE s < e GROUP BY 1, 2, 3, 4),
        spans AS (SELECT review_id, aspect, s, e, unnest(CASE WHEN mixed THEN ['neutral'] ELSE p END) AS polarity FROM grouped),
        marked AS (SELECT *, max(e) OVER (PARTITION BY review_id, aspect, polarity ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM spans)
        SELECT 'given' AS name, count(*) AS n FROM raw UNION ALL SELECT 'spans', count(*) FROM grouped UNION ALL SELECT 'conflicts', count(*) FILTER (WHERE mixed) FROM grouped
        UNION ALL SELECT 'left', count(*) FILTER (WHERE reach IS NULL OR s >= reach) FROM marked""",
    "metadata_profile": "SELECT main_category, count(*) AS n FROM item_metadata WHERE main_category IS NOT NULL GROUP BY 1 ORDER BY n DESC, main_category LIMIT 10",
    "title_lengths": "SELECT count(*) AS n, round(avg(length(title)), 9) AS mean_chars, quantile_cont(length(title), 0.5)::DOUBLE AS median_chars FROM item_metadata WHERE title IS NOT NULL",
    "retention_windows": f"{_BASE} {_retention('validation', 't0', 't1')} UNION ALL {_retention('test', 't1', None)}",
    "listing_features": """SELECT item_id, (i - 1)::INTEGER AS place, l[i] AS value FROM (SELECT item_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT DISTINCT item_id, features_json, CASE WHEN json_valid(features_json) THEN from_json(features_json, '["VARCHAR"]') END AS l FROM item_metadata WHERE item_id IS NOT NULL))""",
    "parsed_answers": f"WITH {_OBS} SELECT evidence_id, 1 AS id, aspect, sentiment AS polarity, evidence FROM obs WHERE evidence IS NOT NULL AND sentiment IN ('positive', 'negative', 'neutral')",
}
