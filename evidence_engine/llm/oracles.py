"""SQL for the operators that SQL can express whole."""

from __future__ import annotations

from evidence_engine.llm.url_filters import RULES

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_RULES = ", ".join(f"('{rule}', '{verdict}')" for rule, verdict in RULES)


def _parts(url: str) -> str:
    """Host, path and the name that variants of an address share."""
    rest = f"CASE WHEN contains({url}, '://') THEN substr({url}, strpos({url}, '://') + 3) ELSE '' END"
    host = f"translate(regexp_extract({rest}, '^[^/?#]*'), '{_UPPER}', '{_LOWER}')"
    path = f"regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1)"
    query = f"""list_filter(string_split(regexp_extract({rest}, '^[^?#]*\\?([^#]*)', 1), '&'),
        lambda p: p <> '' AND NOT regexp_full_match(p, '(utm_[a-z]+|gclid|fbclid|ref)=[^&]*'))"""
    node = f"""CASE WHEN contains({url}, '://') THEN regexp_replace({host}, ':(80|443)?$', '')
        || regexp_replace({path}, '/+$', '')
        || CASE WHEN len({query}) > 0 THEN '?' || array_to_string({query}, '&') ELSE '' END END"""
    return f"{host} AS host, {path} AS path, {node} AS node"


#: Canonical links and refreshes with a whole address; the tables have no others.
_TARGET = r"""coalesce(
    nullif(regexp_extract(html, '<link[^>]*\brel\s*=\s*["'']?canonical[^>]*\bhref\s*=\s*["'']?([^"''>\s]+)', 1, 'is'), ''),
    nullif(regexp_extract(html, '<meta[^>]*http-equiv\s*=\s*["'']?refresh[^>]*url\s*=\s*["'']?([^"''>\s]+)', 1, 'is'), ''))"""

URL_FILTERS = f"""WITH RECURSIVE rules(rule, verdict) AS (VALUES {_RULES}),
    parsed AS (SELECT page_id, {_parts("url")}, {_TARGET} AS target FROM pages),
    named AS (SELECT f AS linked_from, host, path, node FROM (SELECT node AS f, {_parts("target")}
              FROM parsed WHERE target IS NOT NULL) WHERE node IS NOT NULL),
    addresses AS (SELECT host, path, node FROM parsed UNION SELECT host, path, node FROM named),
    ruled AS (SELECT host, path, arg_max(rule, len(rule)) AS rule, arg_max(verdict, len(rule)) AS rule_verdict
              FROM (SELECT DISTINCT host, path FROM addresses) JOIN rules
              ON ('.' || host) LIKE '%.' || split_part(rule, '/', 1) AND starts_with(path, substr(rule, strpos(rule, '/')))
              GROUP BY host, path),
    edges AS (SELECT linked_from AS a, node AS b FROM named UNION SELECT node, linked_from FROM named),
    blocked AS (SELECT node FROM addresses JOIN ruled USING (host, path)
                WHERE rule_verdict = 'block' AND node IS NOT NULL
                UNION SELECT b FROM blocked JOIN edges ON node = a)
    SELECT page_id, parsed.host, parsed.path, rule,
        coalesce(rule_verdict, CASE WHEN blocked.node IS NULL THEN 'allow' ELSE 'block' END) AS verdict,
        rule IS NULL AND blocked.node IS NOT NULL AS passed_on
    FROM parsed LEFT JOIN ruled ON parsed.host = ruled.host AND parsed.path = ruled.path
    LEFT JOIN (SELECT DISTINCT node FROM blocked) blocked ON parsed.node = blocked.node"""

LSH_FOREST = f"""WITH RECURSIVE split AS (SELECT doc_id, list_filter(regexp_split_to_array(
        translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
    shingles AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) > 2
        THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM split),
    sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
    shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM shingles a JOIN shingles b USING (shingle)
               WHERE a.doc_id < b.doc_id GROUP BY ALL),
    links AS (SELECT x, y FROM shared JOIN sizes s ON s.doc_id = x JOIN sizes t ON t.doc_id = y
              WHERE 100 * shared.n >= 85 * (s.n + t.n - shared.n)),
    both_ways AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
    reach AS (SELECT x AS doc_id, x AS reached FROM both_ways
              UNION SELECT doc_id, y FROM reach JOIN both_ways ON reached = x),
    found AS (SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(c, doc_id) AS component_id
              FROM documents LEFT JOIN sizes USING (doc_id)
              LEFT JOIN (SELECT doc_id, min(reached) AS c FROM reach GROUP BY doc_id) USING (doc_id))
    SELECT *, doc_id = component_id AS kept FROM found"""

CAPTURE_INDEX = """WITH hashed AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes,
        sha256(coalesce(html, '')) AS payload_digest FROM pages),
    firsts AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM hashed)
    SELECT page_id, payload_bytes, payload_digest,
        CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
        CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to FROM firsts"""

ORACLES = {"op1_url_filters": URL_FILTERS, "op3_lsh_forest": LSH_FOREST, "op4_capture_index": CAPTURE_INDEX}
