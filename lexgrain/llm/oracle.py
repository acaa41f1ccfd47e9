"""DuckDB SQL for the queries of this package that SQL can express."""

from __future__ import annotations

from lexgrain.llm.decontaminate import WINDOW_WORDS
from lexgrain.llm.license_texts import complete_texts
from lexgrain.llm.licenses import EQUIVALENT, KNOWN, NO_NOTICE
from lexgrain.llm.secret_scan import BASE_RULES, MORE_RULES

_A_Z = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _kept(text: str) -> str:
    """Canonical lines of a text as a list."""
    words = f"regexp_replace(lower({text}), '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g')"
    words = f"(' ' || replace({words}, chr(10), ' ' || chr(10) || ' ') || ' ')"
    for other, usual in EQUIVALENT:
        words = f"replace({words}, ' {other} ', ' {usual} ')"
    trimmed = f"list_transform(string_split({words}, chr(10)), lambda l: trim(l))"
    sentence = f"'^copyright ({'|'.join(NO_NOTICE)})( |$)'"
    notice = f"starts_with(l, 'copyright ') AND NOT regexp_matches(l, {sentence})"
    other = "regexp_matches(l, '^((copyright )?c \\d{4}( |$)|copyright c |copr |all rights reserved$)')"
    return f"list_filter({trimmed}, lambda l: NOT (({notice}) OR {other}))"


def _joined(lines: str) -> str:
    return f"trim(regexp_replace(array_to_string({lines}, ' '), ' +', ' ', 'g'))"


LICENSES = f"""
    WITH known_texts(i, license, text) AS (
        VALUES {", ".join(f"({i}, {_quoted(n)}, {_quoted(t)})" for i, (n, t) in enumerate([*KNOWN, *complete_texts()]))}
    ), known AS (
        SELECT arg_min(license, i) AS license, {_joined(_kept("text"))} AS unit FROM known_texts GROUP BY 2
    ), plain AS (
        SELECT doc_id, {_kept("coalesce(text, '')")} AS lines FROM documents
    ), units AS (
        SELECT doc_id, {_joined("lines")} AS whole,
               unnest(list_distinct(list_concat(
                   lines,
                   CASE WHEN list_contains(lines, '') THEN list_transform(
                       string_split(array_to_string(list_transform(lines, lambda l: CASE WHEN l = '' THEN chr(10) ELSE l END), ' '), chr(10)),
                       lambda q: trim(q)) ELSE [] END,
                   [{_joined("lines")}]))) AS unit
        FROM plain
    ), hits AS (
        SELECT doc_id, max(license) FILTER (WHERE u.unit = u.whole) AS whole_license,
               string_agg(DISTINCT license, ',' ORDER BY license) AS licenses,
               count(DISTINCT k.unit) AS n_units
        FROM units u JOIN known k ON u.unit = k.unit
        WHERE u.unit <> '' GROUP BY doc_id
    )
    SELECT doc_id, whole_license, licenses, coalesce(n_units, 0) AS n_units
    FROM documents LEFT JOIN hits USING (doc_id)
"""

_WORDS = f"regexp_extract_all(translate(text, {_A_Z}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

DECONTAMINATION = f"""
    WITH d AS (
        SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents
    ), items AS (
        SELECT item_id, w, least(len(w), {WINDOW_WORDS}) AS size
        FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0
    ), windows AS (
        SELECT DISTINCT item_id, size, array_to_string(list_slice(w, k, k + size - 1), ' ') AS g
        FROM (SELECT item_id, size, w, unnest(range(1, len(w) - size + 2)) AS k FROM items)
    ), places AS (
        SELECT doc_id, size, k, array_to_string(list_slice(w, k, k + size - 1), ' ') AS g
        FROM (SELECT doc_id, size, w, unnest(range(1, len(w) - size + 2)) AS k
              FROM d, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size)
    ), found AS (
        SELECT doc_id, item_id, k, size FROM places JOIN windows USING (size, g)
    ), hit AS (
        SELECT doc_id, count(DISTINCT h) AS n_hit
        FROM (SELECT doc_id, unnest(range(k, k + size)) AS h FROM found) GROUP BY doc_id
    ), named AS (
        SELECT doc_id, count(DISTINCT item_id) AS n_items,
               string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names
        FROM found GROUP BY doc_id
    )
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(names, '')) AS items_sha256,
           coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""


def _secret_spans(order: int, rule) -> str:
    """``(s, o, k, e)`` of a rule's matches: pieces between them and matches alternate."""
    pattern = _quoted(rule.pattern)
    return f"""
        SELECT doc_id, {order} AS o, '{rule.kind}' AS k,
               unnest(list_filter(list_transform(range(1, len(m) + 1), lambda i: struct_pack(
                   g := length(g[i]),
                   s := list_sum(list_transform(p[1:i], lambda x: length(x)))
                        + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0),
                   n := length(m[i]))), lambda r: r.g >= {rule.least})) AS r
        FROM (SELECT doc_id, regexp_extract_all(text, {pattern}) AS m,
                     regexp_extract_all(text, {pattern}, {rule.group}) AS g,
                     string_split_regex(text, {pattern}) AS p
              FROM documents WHERE text IS NOT NULL)
    """


_SPANS = " UNION ALL ".join(_secret_spans(i, r) for i, r in enumerate(BASE_RULES + MORE_RULES))
_LISTED = "string_agg(k || ':' || s || ':' || e, ',' ORDER BY s, o)"

SECRETS = f"""
    WITH spans AS (
        SELECT doc_id, o, k, r.s::BIGINT AS s, (r.s + r.n)::BIGINT AS e FROM ({_SPANS})
    ), sums AS (
        SELECT doc_id, count(*) FILTER (WHERE o = 0) AS n_assign, count(*) FILTER (WHERE o = 1) AS n_access,
               count(*) FILTER (WHERE o = 2) AS n_hex, {_LISTED} FILTER (WHERE o < 3) AS base, {_LISTED} AS listed
        FROM spans GROUP BY doc_id
    )
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
           coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(listed, '') AS spans
    FROM documents LEFT JOIN sums USING (doc_id)
"""

ORACLE: dict[str, str] = {
    "op1_exact_dedup": """
        WITH folded AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                     'abcdefghijklmnopqrstuvwxyz') AS body
            FROM documents
        )
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(body) AS text_sha256
        FROM folded WINDOW same AS (PARTITION BY body)
    """,
    "op3_license_scan": LICENSES,
    "op5_url_filter": """
        WITH rules(host, path, verdict) AS (
            VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
                   ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
        ), cut AS (
            SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
            FROM pages
        ), parts AS (
            SELECT page_id,
                   translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                             'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
            FROM cut
        ), fits AS (
            SELECT p.page_id, p.host, p.path, r.host || r.path AS rule, r.verdict,
                   row_number() OVER (PARTITION BY p.page_id
                                      ORDER BY length(r.host || r.path) DESC NULLS LAST, length(r.host) DESC) AS place
            FROM parts p LEFT JOIN rules r
              ON (p.host = r.host OR suffix(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
        )
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits WHERE place = 1
    """,
    "op6_decontamination": DECONTAMINATION,
    "op7_secret_scan": SECRETS,
}
