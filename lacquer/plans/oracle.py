"""DuckDB SQL whose rows equal those of the queries."""

from . import policies, shapes
from .tables import LOW_WRITTEN

LOW = "CASE WHEN {0} = '' THEN '' WHEN length({0}) <= 4 THEN '****' ELSE left({0}, 2) || '****' || right({0}, 2) END"
MEDIUM = "CASE WHEN {0} = '' THEN '' WHEN length({0}) <= 1 THEN '*******' ELSE '*******' || right({0}, 1) END"
ESCAPED = "replace(replace(replace({0}, chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t')"
BATCH = f"""
WITH m AS (SELECT conv_id, turn, {ESCAPED.format("text")} AS raw FROM conversations),
t AS (SELECT *, {LOW_WRITTEN.format("raw")} AS shown FROM m),
s AS (SELECT *, coalesce(sum(strlen(shown)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM t),
f AS (SELECT *, spent >= 1500 OR strlen(raw) > 1500 - spent OR spent + strlen(shown) > 1500 AS fails FROM s),
b AS (SELECT conv_id, turn, shown, bool_or(fails) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS done FROM f)
"""

SQL = {
    "mask_low": f"SELECT c_custkey, {LOW.format('c_name')} AS masked FROM customer",
    "mask_medium": f"SELECT c_custkey, {MEDIUM.format('c_mktsegment')} AS masked FROM customer",
    "mask_high": "SELECT o_orderkey, CASE WHEN o_orderpriority = '' THEN '' ELSE '****' END AS masked FROM orders",
    "mask_secret": "SELECT o_orderkey, CASE WHEN o_orderpriority = '' THEN '' ELSE '<redacted>' END AS masked FROM orders",
    "mask_custom": "SELECT p_partkey, CASE WHEN p_name = '' THEN '' WHEN length(p_name) <= 6 THEN '#' ELSE left(p_name, 3) || '#' || right(p_name, 1) END AS edges, CASE WHEN p_brand = '' THEN '' ELSE '?' END AS suffix, '' AS emptied FROM part",
    "mask_by_level_column": f"SELECT event_id, CASE event_type WHEN 'click' THEN {LOW.format('props')} WHEN 'view' THEN {MEDIUM.format('props')} WHEN 'purchase' THEN CASE WHEN props = '' THEN '' ELSE '****' END ELSE props END AS masked FROM events",
    "field_names": """
        SELECT n_nationkey, lower(regexp_replace('user' || n_name || CASE n_nationkey % 3 WHEN 0 THEN 'accesstoken' WHEN 1 THEN 'comment' ELSE 'apikey' END, '[_. -]', '', 'g')) AS canonical,
        CASE n_nationkey % 3 WHEN 0 THEN 'token' WHEN 1 THEN 'comment' ELSE 'key' END AS last_token, CASE n_nationkey % 3 WHEN 1 THEN 0 ELSE 3 END AS level FROM nation""",
    "classify_rules_join": """
        WITH n AS (SELECT DISTINCT event_type AS name, event_type AS t, 'exact' AS m FROM events UNION SELECT DISTINCT event_type || '_' || event_type, event_type, 'token_suffix' FROM events)
        SELECT name, CASE WHEN t = 'purchase' THEN 'sensitive' WHEN t = 'view' OR t = 'click' AND m = 'exact' THEN 'allowed' ELSE 'unknown' END AS kind,
        CASE WHEN t IN ('purchase', 'view') OR t = 'click' AND m = 'exact' THEN t END AS rule, CASE WHEN t IN ('purchase', 'view') OR t = 'click' AND m = 'exact' THEN m END AS match FROM n""",
    "redact_columns_customer": f"SELECT c_custkey, {LOW_WRITTEN.format('c_name')} AS c_name, c_nationkey, '****' AS c_acctbal, '*******' || right(c_mktsegment, 1) AS c_mktsegment FROM customer",
    "redact_field_long": f"""
        WITH d AS (SELECT doc_id, strlen({ESCAPED.format("text")}) AS n FROM documents)
        SELECT doc_id, CASE WHEN n > 16384 THEN 0 ELSE n END AS n_bytes, CASE WHEN n > 16384 THEN 2 ELSE 0 END AS completion, CASE WHEN n > 16384 THEN 2 ELSE 0 END AS reasons FROM d""",
    "env_pair": "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'NATION_TOKEN=****' ELSE 'NATION_LABEL=' || n_name END AS text FROM nation",
    "env_pairs": """SELECT s_suppkey, '["MODE=' || s_name || '", "DB_PASSWORD=<redacted>"]' AS text FROM supplier""",
    "argv_explicit": f"""SELECT o_orderkey, '["ship", "' || {LOW.format('o_orderstatus')} || '", "' || {LOW.format('o_orderpriority')} || '"]' AS text FROM orders""",
    "argv_heuristic": """SELECT o_orderkey, '["--password", "<redacted>", "--token=****", "MODE=' || o_orderpriority || '", "-Ddb.secret=<redacted>", "-v", "' || o_orderpriority || '"]' AS text, 4 AS level FROM orders""",
    "process_redact": """SELECT o_orderkey, '["client", "--api-key", "****"]["REGION=' || o_orderstatus || '"]' AS text, 3 AS level FROM orders""",
    "json_mask": """SELECT event_id, '{"k":"****"}' AS text FROM events""",
    "json_pass": "SELECT event_id, replace(props, ' ', '') AS text FROM events",
    "json_inspect": "SELECT event_type, count(*) AS n_ok, 3 AS level, sum(strlen(props))::BIGINT AS presented FROM events GROUP BY event_type",
    "json_invalid": "SELECT item_id, '<redacted>' AS text, 32 AS reasons FROM benchmark",
    "http_url_standard": "SELECT page_id, regexp_replace(url, '#.+$', '#****') AS text FROM pages",
    "http_url_query_rule": """
        WITH p AS (SELECT page_id, regexp_replace(url, '#.+$', '#****') AS u FROM pages), q AS (SELECT page_id, regexp_replace(u, '([?&](?:ref|utm_source)=)[^&#]+([^&#])', '\\1*******\\2', 'g') AS u FROM p)
        SELECT page_id, regexp_replace(u, '([?&](?:ref|utm_source)=)[^&#]([&#]|$)', '\\1*******\\2', 'g') AS text FROM q""",
    "http_url_strict_path": "SELECT page_id, regexp_replace(regexp_replace(url, '#.+$', '#****'), '^(https?://[^/]+)/[^?#]+', '\\1/<redacted>') AS text FROM pages",
    "uri_fragment": "SELECT page_id, regexp_replace(url, '#.+$', '#****') AS text, CASE WHEN url LIKE '%#_%' THEN 3 END AS level FROM pages",
    "http_headers": "SELECT page_id, 'cookie: [****]' || chr(10) || 'host: [<redacted>]' || chr(10) || 'x-page: [' || page_id || ', second]' AS text, 4 AS level FROM pages",
    "form_body": "SELECT page_id, 'token=****&page=' || page_id || '&note=a+b' AS text FROM pages",
    "html_body": "SELECT page_id, CASE WHEN html = '' THEN '' ELSE '<redacted: text body>' END AS text, CASE WHEN strlen(html) > 65536 THEN 1 ELSE 0 END AS reasons, strlen(html) AS presented, least(strlen(html), 65536) AS inspected FROM pages",
    "shaped_orders": """SELECT o_orderkey, '{"o_orderstatus":"' || o_orderstatus || '","session_id":"****"}' AS who, o_orderstatus || '|' || o_orderpriority AS tags, o_orderstatus AS status, '****' AS api_key FROM orders""",
    "debug_orders": """SELECT o_orderkey, 'Order { id: ' || o_orderkey || ', status: "' || o_orderstatus || '", password: "<redacted>" }' AS text FROM orders""",
    "batch_budget": BATCH + "SELECT conv_id, turn, sha256(CASE WHEN done THEN '' ELSE shown END) AS text, CASE WHEN done THEN 2 ELSE 0 END AS completion FROM b",
    "batch_mixed": BATCH + "SELECT conv_id, turn, sha256(CASE WHEN done THEN '' ELSE shown END) AS text, CASE WHEN done THEN 2 ELSE 0 END AS completion FROM b",
    "composer_text": BATCH + "SELECT conv_id, sha256(string_agg(CASE WHEN done THEN '' ELSE shown END, '' ORDER BY turn)) AS text, max(CASE WHEN done THEN 2 ELSE 0 END) AS completion, max(CASE WHEN done THEN 2 ELSE 0 END) AS reasons FROM b GROUP BY conv_id",
    "role_levels": f"SELECT conv_id, turn, CASE WHEN role = 'system' THEN '<redacted>' WHEN strlen({ESCAPED.format('text')}) > 16384 THEN '' WHEN role = 'user' THEN {LOW_WRITTEN.format(ESCAPED.format('text'))} ELSE {ESCAPED.format('text')} END AS text FROM conversations",
    "sensitivity_report": """
        WITH e AS (SELECT event_type, CASE event_type WHEN 'purchase' THEN 3 WHEN 'click' THEN 1 ELSE 0 END AS v FROM events)
        SELECT event_type, count(*) AS n_rows, max(v) AS event_max, count(*) FILTER (v > 0) AS event_sensitive FROM e GROUP BY ROLLUP (event_type)""",
    "segment_report": "SELECT n_name, '*******' || right(c_mktsegment, 1) AS c_mktsegment, count(*) AS n_customers, '****' AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2",
}


def oracle_sql() -> dict[str, str]:
    return SQL | policies.SQL | shapes.SQL
