"""Registered queries of repeated operations, appended pages, route reports, recovery names and bytes of tenants, and their SQL."""

from __future__ import annotations

from ..operators import content, history, planning, queues
from ..sources.tables import read
from .local import INPUTS, derived, with_inputs
from .registry import BROKEN, CHANGES, broken

_TEXT = "VARCHAR(40)"
ROUTES = ("/v1/items", "/v1/items/{id}", "/v1/orders/{id}/lines", "/v1/signup")
_LABEL = "(Wiederhergestellt - "

INPUTS |= {
    "request_log": f"""SELECT ts, CASE event_type WHEN 'click' THEN '/v1/items/' || CAST(event_id AS {_TEXT}) WHEN 'view' THEN '/v1/items' WHEN 'purchase' THEN '/v1/orders/' || CAST(user_id AS {_TEXT}) || '/lines'
          WHEN 'error' THEN '/v1/items/' ELSE CASE WHEN user_id % 2 = 0 THEN '/v1/signup' ELSE '/V1/signup/' || CAST(user_id AS {_TEXT}) END END AS path,
        CASE WHEN event_id % 13 <> 0 THEN CAST(floor(value) AS BIGINT) END AS duration_ms,
        CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 7 = 0 THEN 503 WHEN event_id % 5 = 0 THEN 429 ELSE 200 END AS status FROM {{events}}""",
    "lost_folders": f"""SELECT p_partkey AS operation_id, p_brand AS parent_id,
        CASE WHEN p_partkey % 17 = 0 THEN 'a:b' WHEN p_partkey % 7 = 0 THEN repeat(p_name || '-', 20) WHEN p_partkey % 19 = 0 THEN '' ELSE p_name END AS stem FROM {{part}}""",
    "lost_names": f"""SELECT p.operation_id, p.parent_id, p.stem, n.n AS number, ' {_LABEL}' || CAST(p.operation_id AS {_TEXT}) || ')' || CASE WHEN n.n > 0 THEN '-' || CAST(n.n AS {_TEXT}) ELSE '' END AS ending
        FROM {{lost_folders}} p JOIN (SELECT DISTINCT p_size - 1 AS n FROM {{part}} WHERE p_size <= 6) n ON n.n < p.operation_id % 6 OR n.n = p.operation_id % 6 + 1""",
    "occupied_names": """SELECT parent_id, CASE WHEN operation_id % 2 = 0 THEN upper(name) ELSE name END AS name
        FROM (SELECT parent_id, operation_id, substr(stem, 1, 180 - length(ending)) || ending AS name FROM {lost_names} WHERE operation_id % 5 > 0) x""",
}

QUERIES = {
    "duplicate_operations": lambda s, d: history.duplicate_operations(broken(s, d)),
    "append_changes": lambda s, d: (lambda p: queues.append_changes(p, queues.ingest_changes(p, derived(s, d, "stored"))))(derived(s, d, "pages_in")),
    "route_report": lambda s, d: content.route_report(derived(s, d, "request_log"), ROUTES, "ts", "path", "duration_ms", "status", "1 hour"),
    "recovery_names": lambda s, d: planning.recovery_names(derived(s, d, "lost_folders"), derived(s, d, "occupied_names")),
    "logical_bytes": lambda s, d: content.logical_bytes(read(s, d, "documents"), "source", "text"),
}

#: Verdicts by following pages one after the other.
INGESTED = """, f AS (SELECT tenant, max(cursor) AS frontier FROM stored GROUP BY 1),
g AS (SELECT p.tenant, page, from_cursor, next_cursor, count(*) AS n_rows, list_sort(list(p.cursor)) = list_transform(range(from_cursor + 1, next_cursor + 1), lambda x: CAST(x AS BIGINT)) AS dense FROM pages_in p GROUP BY 1, 2, 3, 4),
steps AS (SELECT t.tenant, CAST(-1 AS BIGINT) AS page, CAST(coalesce(frontier, 0) AS BIGINT) AS reached FROM (SELECT DISTINCT tenant FROM pages_in) t LEFT JOIN f USING (tenant)
  UNION ALL SELECT s.tenant, min(g.page), arg_min(g.next_cursor, g.page) FROM steps s JOIN g ON g.tenant = s.tenant AND g.page > s.page AND g.from_cursor = s.reached AND g.dense GROUP BY s.tenant),
had AS (SELECT tenant, cursor, payload, CAST(-1 AS BIGINT) AS since FROM stored UNION ALL SELECT p.tenant, p.cursor, p.payload, p.page FROM pages_in p JOIN steps s ON s.tenant = p.tenant AND s.page = p.page),
again AS (SELECT p.tenant, p.page, bool_and(EXISTS (SELECT 1 FROM had h WHERE h.tenant = p.tenant AND h.cursor = p.cursor AND h.payload = p.payload AND h.since < p.page)) AS same FROM pages_in p GROUP BY 1, 2),
verdicts AS (SELECT g.tenant, g.page, from_cursor, next_cursor, n_rows, CASE WHEN s.page IS NOT NULL THEN 'append' WHEN dense AND same THEN 'replay' ELSE 'reject' END AS verdict
  FROM g LEFT JOIN steps s ON s.tenant = g.tenant AND s.page = g.page JOIN again a ON a.tenant = g.tenant AND a.page = g.page)"""

SQL = {
    "duplicate_operations": f"""WITH {CHANGES}, {BROKEN} SELECT tenant, operation_id, count(*) AS n_rows, count(DISTINCT cursor) AS n_cursors, min(cursor) AS first_cursor, max(cursor) AS last_cursor
FROM broken GROUP BY 1, 2 HAVING count(*) > 1""",
    "ingest_changes": with_inputs("pages_in", "stored") + INGESTED + " SELECT * FROM verdicts",
    "append_changes": with_inputs("pages_in", "stored") + INGESTED + " SELECT p.tenant, p.cursor, p.payload FROM pages_in p JOIN verdicts v ON v.tenant = p.tenant AND v.page = p.page WHERE verdict = 'append'",
    "route_report": with_inputs("request_log") + r""", r AS (SELECT *, CASE WHEN path IN ('/v1/items', '/v1/signup') THEN path WHEN regexp_full_match(path, '/v1/items/[^/]+') THEN '/v1/items/{id}'
  WHEN regexp_full_match(path, '/v1/orders/[^/]+/lines') THEN '/v1/orders/{id}/lines' ELSE 'unknown' END AS route FROM request_log)
SELECT date_trunc('hour', ts) AS window_start, route, count(*) AS n_requests, count(*) FILTER (status >= 500) AS n_failed, round(count(*) FILTER (status >= 500) / count(*), 6) AS error_rate,
  round(quantile_cont(CAST(duration_ms AS DOUBLE), 0.5), 3) AS p50, round(quantile_cont(CAST(duration_ms AS DOUBLE), 0.95), 3) AS p95, round(quantile_cont(CAST(duration_ms AS DOUBLE), 0.99), 3) AS p99 FROM r GROUP BY 1, 2""",
    "recovery_names": with_inputs("lost_folders", "occupied_names") + f""", c AS (SELECT l.*, k.k, ' {_LABEL}' || operation_id || ')' || CASE WHEN k.k > 0 THEN '-' || k.k ELSE '' END AS ending FROM lost_folders l, (SELECT unnest(range(0, 9)) AS k) k),
d AS (SELECT *, stem[:180 - length(ending)] || ending AS candidate FROM c),
e AS (SELECT operation_id, min(k) AS number, arg_min(candidate, k) AS name FROM d WHERE (parent_id, lower(candidate)) NOT IN (SELECT (parent_id, lower(name)) FROM occupied_names) GROUP BY 1)
SELECT l.operation_id, parent_id, stem, CASE WHEN NOT contains(stem, ':') THEN name END AS name, CASE WHEN NOT contains(stem, ':') THEN CAST(number AS INTEGER) END AS number FROM lost_folders l JOIN e USING (operation_id)""",
    "logical_bytes": """SELECT source AS tenant, CAST(sum(strlen(text)) AS BIGINT) AS logical_bytes, CAST((SELECT sum(strlen(t)) FROM (SELECT DISTINCT text AS t FROM documents i WHERE i.source IS NOT DISTINCT FROM o.source)) AS BIGINT) AS stored_bytes,
  count(*) AS n_references, count(DISTINCT text) AS n_blobs FROM documents o WHERE text IS NOT NULL GROUP BY 1""",
}
