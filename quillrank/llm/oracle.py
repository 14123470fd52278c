"""SQL that states the results of the pN_ queries independently."""

from quillrank.llm.lookalike import LATIN_TWINS

ORACLE: dict[str, str] = {
    "p2_found": """
        WITH once AS (
            SELECT evidence_id, author_id, max(CASE WHEN confidence BETWEEN 0 AND 1 THEN confidence END) AS c
            FROM t4_2_evidence WHERE author_id IS NOT NULL AND evidence_id IS NOT NULL GROUP BY 1, 2)
        SELECT evidence_id FROM (
            SELECT evidence_id, row_number() OVER (PARTITION BY author_id ORDER BY c DESC NULLS LAST, evidence_id) AS n FROM once)
        WHERE n > 5""",
    "p2_capped": """
        WITH once AS (
            SELECT evidence_id, author_id, any_value(confidence) AS confidence, max(CASE WHEN confidence BETWEEN 0 AND 1 THEN confidence END) AS c
            FROM t4_2_evidence WHERE evidence_id IS NOT NULL GROUP BY 1, 2)
        SELECT evidence_id, author_id, confidence FROM (
            SELECT *, row_number() OVER (PARTITION BY author_id ORDER BY c DESC NULLS LAST, evidence_id) AS n,
                greatest(1, floor(0.001 * (SELECT count(DISTINCT evidence_id) FROM t4_2_evidence))) AS cap FROM once)
        WHERE n <= cap OR author_id IS NULL""",
    "p5_found": """
        WITH flat AS (
            SELECT user_id, unnest(item_ids[:least(len(item_ids), len(scores))]) AS item_id, unnest(scores[:least(len(item_ids), len(scores))]) AS score
            FROM topk_recommendations WHERE user_id IS NOT NULL),
        best AS (SELECT user_id, item_id, max(score) AS score FROM flat WHERE item_id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) GROUP BY 1, 2)
        SELECT user_id, item_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS n FROM best) WHERE n <= 10""",
}

_CANDIDATES = "SELECT user_id, item_id, " + ", ".join(
    f"max(CASE WHEN NOT isnan({c}) THEN {c} END) AS {c}" for c in ("normalized_mf", "normalized_graph", "normalized_aspect")
) + " FROM hybrid_scores WHERE user_id IS NOT NULL AND item_id IS NOT NULL GROUP BY 1, 2"
_PLACED = "SELECT user_id, item_id, count(*) OVER (PARTITION BY user_id) AS n, " + ", ".join(
    f"rank() OVER (PARTITION BY user_id ORDER BY {c} ASC NULLS FIRST) - 1 AS lower_{k}, count(*) OVER (PARTITION BY user_id, {c}) - 1 AS equal_{k}"
    for k, c in enumerate(("normalized_mf", "normalized_graph", "normalized_aspect"))
) + f" FROM ({_CANDIDATES})"
ORACLE["p4_found"] = f"""
    SELECT user_id, item_id FROM (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY
        2 * (lower_0 + lower_1 + lower_2) + equal_0 + equal_1 + equal_2 DESC, item_id) AS place FROM ({_PLACED})) WHERE place <= 5"""
ORACLE["p4_reciprocal"] = f"""
    SELECT user_id, item_id, fused_score, CAST(row_number() OVER (PARTITION BY user_id ORDER BY fused_score DESC, item_id) AS INTEGER) AS position
    FROM (SELECT user_id, item_id, round(0.0 + {' + '.join(f'1.0::DOUBLE / (60 + (1 + n - 1 - lower_{k} - equal_{k} / 2))' for k in range(3))}, 12) AS fused_score FROM ({_PLACED}))"""

_WINDOWS = """w AS (SELECT doc_id, i, md5(substr(text, i, 300)) AS s FROM (
    SELECT doc_id, text, unnest(range(1, length(text) - 298)) AS i FROM documents WHERE length(text) >= 300))"""
ORACLE["p10_found"] = f"WITH {_WINDOWS} SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM w a JOIN w b ON a.s = b.s AND a.doc_id < b.doc_id"
ORACLE["p10_shared"] = f"""
    WITH {_WINDOWS}, c AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM w WHERE s IN (
        SELECT s FROM w GROUP BY 1 HAVING count(DISTINCT doc_id) > 1))
    SELECT d.doc_id, length(d.text) AS n_chars, coalesce(n, 0)::BIGINT AS shared_chars FROM documents d
    LEFT JOIN (SELECT doc_id, sum(least(300, coalesce(i - before, 300))) AS n FROM c GROUP BY 1) USING (doc_id)"""
ORACLE["p10_passages"] = f"""
    WITH {_WINDOWS}, c AS (SELECT DISTINCT doc_id, i FROM w WHERE s IN (SELECT s FROM w GROUP BY 1 HAVING count(DISTINCT doc_id) > 1)),
    f AS (SELECT *, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 300, true)::INT AS first FROM c),
    n AS (SELECT *, sum(first) OVER (PARTITION BY doc_id ORDER BY i) AS stretch FROM f)
    SELECT doc_id, (min(i) - 1)::INTEGER AS begin, (max(i) + 299)::INTEGER AS "end" FROM n GROUP BY doc_id, stretch"""

# Texts as they look: full-width letters and look-alikes as ordinary ones, nothing without width, accents composed, single blanks.
_WIDE = {chr(0xFEE0 + c): chr(c) for c in range(0x21, 0x7F)}
_FROM = "".join([*_WIDE, *LATIN_TWINS]).replace("'", "''")
_TO = "".join([*_WIDE.values(), *LATIN_TWINS.values()]).replace("'", "''")


def _look(x: str) -> str:
    out = f"translate(regexp_replace({x}, '[\\x{{200b}}-\\x{{200f}}\\x{{2060}}\\x{{feff}}\\x{{ad}}\\x{{34f}}\\x{{fe0f}}]', '', 'g'), '{_FROM}', '{_TO}')"
    for a, b in (("ﬃ", "ffi"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("Ⅲ", "III"), ("Ⅱ", "II")):
        out = f"replace({out}, '{a}', '{b}')"
    return f"nfc_normalize(trim(regexp_replace({out}, '[\\s\\x{{b}}\\p{{Z}}]+', ' ', 'g')))"


def _words(x: str) -> str:
    return f"regexp_extract_all(lower({_look(x)}), '[\\p{{L}}\\p{{N}}]+')"


def _runs(length: int, least: int) -> str:
    return f"""words AS (SELECT DISTINCT review_id, item_id, {_words('text')} AS w FROM review_texts WHERE review_id IS NOT NULL AND item_id IS NOT NULL AND text IS NOT NULL),
    sets AS (SELECT review_id, item_id, w, list_distinct(list_transform(range(1, (len(w) - {length - 2})::BIGINT), lambda i: array_to_string(w[i:i + {length - 1}], ' '))) AS r FROM words WHERE len(w) >= {least})"""


_SIMILAR = """a.item_id = b.item_id AND a.review_id {} b.review_id AND
    (a.w = b.w OR len(list_intersect(a.r, b.r)) / (len(a.r) + len(b.r) - len(list_intersect(a.r, b.r))) >= {})"""
ORACLE["p6_found"] = f"WITH {_runs(3, 36)} SELECT DISTINCT a.review_id AS review_id_a, b.review_id AS review_id_b FROM sets a JOIN sets b ON {_SIMILAR.format('<', 0.55)}"
ORACLE["p6_classes"] = f"""
    WITH {_runs(5, 5)}, classes AS (SELECT *, min(review_id) OVER (PARTITION BY item_id, w) AS class_id, count(*) OVER (PARTITION BY item_id, w) AS copies FROM sets),
    linked AS (SELECT a.review_id, count(*) AS n FROM sets a JOIN sets b ON {_SIMILAR.format('<>', 0.8)} GROUP BY 1)
    SELECT review_id, class_id, copies, coalesce(n, 0) AS n_links FROM classes LEFT JOIN linked USING (review_id)"""

_LOOKS = """SELECT '{0}' AS table_name, a.k AS key_a, b.k AS key_b FROM {0}_looks a JOIN {0}_looks b ON a.s IS NOT DISTINCT FROM b.s AND a.form = b.form AND a.v <> b.v AND a.k < b.k"""


def _looks(table: str, key: str, column: str, scope: str) -> str:
    return f"{table}_looks AS (SELECT DISTINCT {key} AS k, {scope} AS s, {column} AS v, {_look(column)} AS form FROM {table} WHERE {key} IS NOT NULL AND {column} IS NOT NULL AND {_look(column)} <> '')"


ORACLE["p3_found"] = f"""WITH {_looks('review_texts', 'review_id', 'text', 'item_id')}, {_looks('item_metadata', 'item_id', 'title', 'NULL')}
    SELECT DISTINCT * FROM ({_LOOKS.format('review_texts')} UNION ALL {_LOOKS.format('item_metadata')})"""

_LEAKS = f"""d AS (SELECT DISTINCT doc_id, {_words('text')} AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
    u AS (SELECT DISTINCT unit_id, {_words('text')} AS w, least(13, len({_words('text')}))::BIGINT AS m FROM eval_units WHERE len({_words('text')}) > 0),
    dg AS (SELECT doc_id, m, i, array_to_string(w[i + 1:i + m], ' ') AS s FROM (SELECT doc_id, w, m, unnest(range(0, len(w) - m + 1)) AS i FROM d, (SELECT DISTINCT m FROM u))),
    ug AS (SELECT unit_id, m, j, array_to_string(w[j + 1:j + m], ' ') AS s FROM (SELECT unit_id, w, m, unnest(range(0, len(w) - m + 1)) AS j FROM u)),
    hits AS (SELECT doc_id, unit_id, m, i, j FROM dg JOIN ug USING (m, s))"""
ORACLE["p9_found"] = f"WITH {_LEAKS} SELECT DISTINCT doc_id, unit_id FROM hits"
ORACLE["p9_clean"] = f"WITH {_LEAKS} SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM hits)"
ORACLE["p9_places"] = f"""
    WITH {_LEAKS}, n AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, unit_id, i - j ORDER BY i) AS run FROM hits),
    spans AS (SELECT doc_id, unit_id, (count(*) + any_value(m) - 1)::INTEGER AS words, min(i) AS doc_at, min(j)::INTEGER AS unit_at FROM n GROUP BY doc_id, unit_id, i - j, run)
    SELECT doc_id, unit_id, words, doc_at, unit_at FROM spans
    QUALIFY row_number() OVER (PARTITION BY doc_id, unit_id ORDER BY words DESC, doc_at, unit_at) = 1"""
