"""Registered queries of documents with front matter, of checks before changes are applied, and of shared limits, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import checks, documents, limits
from ..streaming import jobs
from ..streaming.admission import stream_admission
from . import recovery
from .local import _NAME, INPUTS, derived, with_inputs
from .streams import stream, written

_TEXT = "VARCHAR(40)"
#: An id for each number, of the form that ids have.
_ID = "'550e8400-e29b-41d4-a716-' || lpad(CAST({} AS VARCHAR(40)), 12, '0')"
_HEAD = f"'---' || chr(10) || 'title: t' || chr(10) || 'meta:' || chr(10) || '  schema: 1' || chr(10) || '  note_id: \"' || {_ID.format('doc_id')} || '\"' || chr(10)"
_KIND = "doc_id % 9"

INPUTS |= {
    "noted": f"""SELECT doc_id, 'd' || CAST(doc_id AS {_TEXT}) AS path, CASE {_KIND} WHEN 1 THEN '---' || chr(10) || 'title: t # kept' || chr(10) || '---' || chr(10) || text
        WHEN 2 THEN {_HEAD} || '  tags: [alpha, ' || lang || ']' || chr(10) || 'rest: [1, 2]' || chr(10) || '---' || chr(10) || text
        WHEN 3 THEN '---' || chr(10) || 'title: open' WHEN 4 THEN '---' || chr(10) || 'a:' || chr(10) || '  b: 1' || chr(10) || '  b: 2' || chr(10) || '---' || chr(10) || text
        WHEN 5 THEN replace({_HEAD}, 'schema: 1', 'schema: 2') || '---' || chr(10) || text WHEN 6 THEN upper({_HEAD}) || '---' || chr(10) || text
        WHEN 7 THEN replace({_HEAD} || '  tags: [A, a]' || chr(10) || '---' || chr(10), chr(10), chr(13) || chr(10)) || text WHEN 8 THEN replace({_HEAD} || '---' || chr(10), chr(10), chr(13) || chr(10)) || text
        ELSE text END AS text, text AS body, lang FROM {{documents}}""",
    "tag_edits": f"SELECT path, {_ID.format('doc_id')} AS expected_id, 'new' || chr(10) || 'body' AS new_body FROM {{noted}} WHERE {_KIND} IN (0, 2, 8)",
    "note_copies": f"""SELECT path, {_ID.format('doc_id')} AS expected_id, {_ID.format('doc_id + 500000')} AS new_id, 'op' || CAST(doc_id AS {_TEXT}) AS operation_id,
        CASE WHEN doc_id % 2 = 0 THEN 'path_collision' ELSE 'object_deleted' END AS reason, 'in/' || path AS original_target, doc_id AS base_revision, doc_id % 3 AS canonical_revision FROM {{noted}} WHERE {_KIND} IN (1, 2)""",
    "step_page": f"""SELECT user_id % 10 AS tenant, event_id AS cursor, 'o' || CAST(user_id AS {_TEXT}) AS object_id, CASE WHEN user_id % 4 = 0 THEN 'folder' ELSE 'note' END AS type,
        CASE WHEN event_type = 'click' THEN 'create' WHEN event_type IN ('view', 'signup') THEN 'update' WHEN event_type = 'purchase' THEN 'move' ELSE 'delete' END AS mutation,
        CASE WHEN event_type = 'click' THEN 1 ELSE 2 + event_id % 7 END AS revision, CASE WHEN event_id % 3 = 0 THEN 'o' || CAST(user_id - user_id % 40 AS {_TEXT}) END AS parent_id,
        'n' || CAST(user_id AS {_TEXT}) || CASE WHEN event_id % 29 = 0 THEN '.txt' WHEN event_id % 31 = 0 THEN '?.md' WHEN user_id % 4 = 0 THEN '' ELSE '.MD' END AS name,
        CASE WHEN user_id % 4 > 0 THEN 'h' || CAST(user_id AS {_TEXT}) || '-' || CAST(event_id % 2 AS {_TEXT}) END AS blob_hash FROM {{events}}""",
    "step_objects": "SELECT DISTINCT tenant, object_id, type, parent_id, name, blob_hash FROM (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY cursor DESC) AS k FROM {step_page}) x WHERE k = 1 AND cursor % 3 > 0",
    "step_open": "SELECT DISTINCT tenant, object_id FROM {step_page} WHERE cursor % 997 = 5",
    "step_blobs": """SELECT DISTINCT blob_hash, CASE WHEN length(object_id) = 3 AND cursor % 2 = 1 THEN 'bad' ELSE blob_hash END AS content_hash, CASE WHEN length(object_id) = 2 THEN 'other' ELSE object_id END AS note_id
        FROM {step_page} WHERE blob_hash IS NOT NULL AND tenant <> 7""",
    "shared_tries": f"""SELECT 'e' || CAST(user_id % 2 AS {_TEXT}) AS scope, 'u' || CAST(user_id % 7 AS {_TEXT}) AS key, event_id * 5 + user_id % 3 AS at, event_id AS attempt_id FROM {{events}}""",
    "scanned": f"""SELECT 'f' || CAST(page_id % 50 AS {_TEXT}) || '/' || CASE WHEN page_id % 4 = 0 THEN upper(regexp_extract(url, '([^/]*)$', 1)) ELSE regexp_extract(url, '([^/]*)$', 1) END AS path, 'note' AS type,
        CASE WHEN page_id % 5 > 0 THEN 'i' || CAST(page_id - page_id % 11 AS {_TEXT}) END AS note_id, CASE WHEN page_id % 13 = 0 THEN 'invalid_yaml' END AS problem, page_id % 17 > 0 AS readable FROM {{pages}}""",
    "tagged_notes": f"""SELECT p_type || '/' || CASE WHEN p_size % 2 = 0 THEN 'size ' || CAST(p_size AS {_TEXT}) || '/' ELSE '' END || 'p' || CAST(p_partkey AS {_TEXT}) || '.md' AS path,
        CASE WHEN p_size % 3 = 0 THEN 'hot' ELSE 'cold' END AS tag FROM {{part}} WHERE p_size % 7 > 0""",
    "tag_folders": f"SELECT DISTINCT p_type || '/size ' || CAST(p_size AS {_TEXT}) AS path FROM {{part}}",
    "sealed_links": f"""SELECT 's' || CAST(o_orderkey AS {_TEXT}) AS seal_id, depth, 'a' || CAST(o_custkey - depth AS {_TEXT}) AS ancestor_id, CASE WHEN depth < 3 THEN 'a' || CAST(o_custkey - depth - 1 AS {_TEXT}) END AS parent_id,
        'p' || CAST(o_custkey AS {_TEXT}) AS path, 1 AS device, 1 + o_custkey % 9 AS inode, 1 + o_orderkey % 5 AS revision FROM {{orders}}, (SELECT 1 AS depth UNION ALL SELECT 2 UNION ALL SELECT 3) x""",
    "current_links": """SELECT seal_id, depth, ancestor_id, parent_id, CASE WHEN length(seal_id) % 2 = 0 AND depth = 2 AND inode = 3 THEN 'moved' ELSE path END AS path, device, CASE WHEN inode = 5 AND depth = 1 THEN 50 ELSE inode END AS inode, revision
        FROM {sealed_links} WHERE NOT (revision = 4 AND inode = 2 AND depth = 3)""",
}


def edits(spark: SparkSession, d: str) -> DataFrame:
    return derived(spark, d, "tag_edits").withColumn("new_tags", F.array(F.lit(" Ä"), F.lit("ä"), F.lit("two words")))


def admitted_stream(spark: SparkSession, d: str) -> DataFrame:
    """The mutations of the events table as a stream, against the tenants' blobs."""
    muts = spark.sql(recovery.INPUTS["submitted"], events=stream(spark, d, "events"))
    return written(spark, stream_admission(muts, derived(spark, d, "held_blobs")))


def expired_registrations(spark: SparkSession, d: str) -> DataFrame:
    """Sign-ups as registrations, clicks of the same user's next event as verifications; both are streams of the events table."""
    e = stream(spark, d, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    sign = e.where("event_type = 'signup'").select(F.concat(F.lit("r"), "event_id").alias("registration_id"), F.col("ts").alias("issued"))
    seen = e.where("event_type IN ('click', 'view')").select(F.concat(F.lit("r"), F.col("event_id") - 1 - F.col("user_id") % 3).alias("registration_id"), F.col("ts").alias("at"))
    out = jobs.stream_registration_expiry(sign, seen, lifetime="5 minutes", late="1 hour")
    done = written(spark, out)
    # rows that no watermark has passed yet are still open when the stream ends
    return done.where("verified_at IS NOT NULL").select("registration_id", F.col("issued").cast("timestamp_ntz").alias("issued"), F.col("verified_at").cast("timestamp_ntz").alias("verified_at"))


QUERIES = {
    "front_matter_extract": lambda s, d: documents.front_matter_extract(derived(s, d, "noted").select("doc_id", "text")).withColumn("tags", F.array_join("tags", "|")).withColumn("body", F.sha2(F.col("body").cast("binary"), 256)),
    "assign_document_ids": lambda s, d: documents.assign_document_ids(derived(s, d, "noted").select("path", "text")).withColumn("text", F.sha2(F.col("text").cast("binary"), 256)),
    "rewrite_front_matter": lambda s, d: documents.rewrite_front_matter(derived(s, d, "noted"), edits(s, d), "replace"),
    "conflict_copies": lambda s, d: documents.conflict_copies(derived(s, d, "noted"), derived(s, d, "note_copies")).withColumn("text", F.sha2(F.col("text").cast("binary"), 256)),
    "page_conflict_check": lambda s, d: checks.page_conflict_check(*(derived(s, d, n) for n in ("step_page", "step_objects", "step_open", "step_blobs"))),
    "inventory_issues": lambda s, d: checks.inventory_issues(derived(s, d, "scanned")),
    "tag_tree_rollup": lambda s, d: checks.tag_tree_rollup(derived(s, d, "tagged_notes").select("path", F.array("tag").alias("tag_keys")), derived(s, d, "tag_folders"), "hot"),
    "folder_tree_rollup": lambda s, d: checks.tag_tree_rollup(derived(s, d, "tagged_notes").select("path", F.array("tag").alias("tag_keys")), derived(s, d, "tag_folders")),
    "ancestry_seal_check": lambda s, d: checks.ancestry_seal_check(derived(s, d, "sealed_links"), derived(s, d, "current_links")),
    "rate_limit_stages": lambda s, d: limits.rate_limit_stages(derived(s, d, "shared_tries"), 40, 9, 900),
    "stream_admission": admitted_stream,
    "stream_registration_expiry": expired_registrations,
}

_SHA = "sha256({})"
_CAND = "(substr(sha256(path), 1, 8) || '-' || substr(sha256(path), 9, 4) || '-5' || substr(sha256(path), 14, 3) || '-a' || substr(sha256(path), 18, 3) || '-' || substr(sha256(path), 21, 12))"
_NL = "CASE WHEN contains(text, chr(13) || chr(10)) THEN chr(13) || chr(10) ELSE chr(10) END"
_PROBLEM = "CASE doc_id % 9 WHEN 3 THEN 'unclosed' WHEN 4 THEN 'duplicate_key' WHEN 5 THEN 'unsupported_schema' WHEN 7 THEN 'invalid_tags' END"
_TREE = """f AS (SELECT path, {} AS hit FROM tagged_notes), a AS (SELECT array_to_string((string_split(path, '/'))[1:n], '/') AS folder, regexp_extract(path, '^(.*)/', 1) AS own FROM f, (VALUES (1), (2)) x(n) WHERE hit AND n < len(string_split(path, '/'))),
c AS (SELECT folder, CAST(count(*) AS BIGINT) AS n_notes, CAST(count(CASE WHEN own = folder THEN 1 END) AS BIGINT) AS n_direct FROM a GROUP BY 1)"""
_KEY = "replace(regexp_replace(regexp_replace(lower(folder), '([0-9]+)', '00000000000000000000\\1', 'g'), '[0-9]*([0-9]{20})', '\\1', 'g'), '/', chr(1)) AS sort_key"

SQL = {
    "front_matter_extract": with_inputs("noted") + f""" SELECT doc_id, coalesce(problem IS NULL AND k IN (1, 2, 6, 8), false) AS has_front_matter, k IN (2, 8) AS has_block, CASE WHEN k IN (2, 8) THEN {_ID.format('doc_id')} END AS note_id,
  CASE WHEN k IN (2, 8) THEN 1 END AS schema, CASE WHEN k = 2 THEN 'alpha|' || lang WHEN problem IS NULL THEN '' END AS tags, CASE WHEN problem IS NULL THEN sha256(body) END AS body, problem FROM (SELECT *, doc_id % 9 AS k, {_PROBLEM} AS problem FROM noted)""",
    "assign_document_ids": with_inputs("noted") + f""" SELECT path, sha256(CASE k WHEN 0 THEN '---' || n || 'meta:' || n || '  schema: 1' || n || '  note_id: "' || c || '"' || n || '---' || n || text
  WHEN 1 THEN '---' || chr(10) || 'title: t # kept' || chr(10) || 'meta:' || chr(10) || '  schema: 1' || chr(10) || '  note_id: "' || c || '"' || chr(10) || '---' || chr(10) || body
  WHEN 6 THEN replace(text, '---' || chr(10) || body, 'meta:' || chr(10) || '  schema: 1' || chr(10) || '  note_id: "' || c || '"' || chr(10) || '---' || chr(10) || body) ELSE text END) AS text,
  CASE WHEN k IN (0, 1, 6) THEN c WHEN k IN (2, 8) THEN {_ID.format('doc_id')} END AS note_id, k IN (0, 1, 6) AS changed, problem
  FROM (SELECT *, doc_id % 9 AS k, {_PROBLEM} AS problem, {_CAND} AS c, {_NL} AS n FROM noted)""",
    "rewrite_front_matter": with_inputs("noted", "tag_edits") + f""" SELECT path, CASE k WHEN 0 THEN text
  WHEN 2 THEN replace(left(text, length(text) - length(body)), '[alpha, ' || lang || ']', '["Ä", "two words"]') || new_body
  ELSE replace(left(text, length(text) - length(body)), '"' || chr(13) || chr(10) || '---', '"' || chr(13) || chr(10) || '  tags: ["Ä", "two words"]' || chr(13) || chr(10) || '---') || replace(new_body, chr(10), chr(13) || chr(10)) END AS text,
  CASE WHEN k > 0 THEN expected_id END AS note_id, k > 0 AS changed, CASE WHEN k = 0 THEN 'other_id' END AS problem FROM (SELECT *, doc_id % 9 AS k FROM noted JOIN tag_edits USING (path))""",
    "conflict_copies": with_inputs("noted", "note_copies") + """ SELECT path, sha256(CASE WHEN problem IS NULL THEN replace(replace(text, expected_id, new_id), ']' || chr(10) || 'rest:', ']' || chr(10) || '  conflict: {original_note_id: "' || expected_id || '", operation_id: "' || operation_id
    || '", reason: "' || reason || '", original_target: "' || original_target || '", base_revision: ' || base_revision || ', canonical_revision: ' || canonical_revision || '}' || chr(10) || 'rest:') ELSE text END) AS text,
  CASE WHEN problem IS NULL THEN new_id END AS note_id, problem IS NULL AS changed, problem
  FROM (SELECT *, CASE WHEN doc_id % 9 = 1 THEN 'other_id' WHEN canonical_revision = 0 AND reason <> 'path_collision' THEN 'invalid_origin' END AS problem FROM noted JOIN note_copies USING (path))""",
    "page_conflict_check": with_inputs("step_page", "step_objects", "step_open", "step_blobs") + """, r AS (SELECT * FROM step_page UNION ALL SELECT tenant, -1, object_id, type, 'stored', 0, parent_id, name, blob_hash FROM step_objects),
w AS (SELECT *, lag(mutation) OVER o AS wm, lag(type) OVER o AS wt, lag(parent_id) OVER o AS wp, lag(name) OVER o AS wn, lag(blob_hash) OVER o AS wb FROM r WINDOW o AS (PARTITION BY tenant, object_id ORDER BY cursor)),
f AS (SELECT tenant, object_id, min(cursor) AS since FROM r WHERE type = 'folder' AND mutation IN ('create', 'stored') GROUP BY 1, 2), b AS (SELECT blob_hash, min(content_hash) AS content_hash, min(note_id) AS note_id FROM step_blobs GROUP BY 1),
x AS (SELECT w.*, f.since, b.content_hash, b.note_id, (w.parent_id IS NOT DISTINCT FROM wp AND w.name = wn) AS here, w.blob_hash IS NOT DISTINCT FROM wb AS bytes FROM w LEFT JOIN f ON f.tenant = w.tenant AND f.object_id = w.parent_id LEFT JOIN b ON b.blob_hash = w.blob_hash WHERE mutation <> 'stored')
SELECT tenant, cursor, object_id, mutation, CASE WHEN (tenant, object_id) IN (SELECT (tenant, object_id) FROM step_open) THEN 'local_intent' WHEN (mutation = 'update' AND type = 'folder') OR contains(name, '?') THEN 'shape'
  WHEN type = 'note' AND NOT lower(name) LIKE '%.md' THEN 'extension' WHEN parent_id IS NOT NULL AND (since IS NULL OR since >= cursor) THEN 'parent_missing' WHEN type = 'note' AND content_hash IS NULL THEN 'missing_blob'
  WHEN type = 'note' AND content_hash <> blob_hash THEN 'hash_mismatch' WHEN type = 'note' AND note_id <> object_id THEN 'identity_mismatch' WHEN mutation <> 'create' AND wm IS NULL THEN 'unknown_object' WHEN wm = 'delete' THEN 'after_delete'
  WHEN mutation = 'create' AND wm IS NOT NULL AND (wm <> 'stored' OR wt <> type OR NOT here) THEN 'repeated_create' WHEN mutation = 'update' AND NOT here THEN 'path_changed' WHEN mutation = 'move' AND NOT bytes THEN 'bytes_changed'
  WHEN mutation = 'delete' AND NOT (here AND bytes) THEN 'delete_differs' END AS reason FROM x""",
    "inventory_issues": with_inputs("scanned") + f""", n AS (SELECT *, regexp_extract(path, '([^/]*)$', 1) AS name, regexp_extract(path, '^(.*)/[^/]*$', 1) AS parent FROM scanned),
s AS (SELECT *, CASE WHEN name = '' THEN 'empty' ELSE {_NAME} END AS bad FROM n), g AS (SELECT * FROM s WHERE bad IS NULL)
SELECT path, 'invalid_name' AS code, bad AS detail FROM s WHERE bad IS NOT NULL UNION ALL SELECT path, 'name_collision', lower(name) FROM g WHERE (parent, lower(name)) IN (SELECT (parent, lower(name)) FROM g GROUP BY parent, lower(name) HAVING count(*) > 1)
UNION ALL SELECT path, 'invalid_front_matter', problem FROM s WHERE problem IS NOT NULL UNION ALL SELECT path, 'duplicate_note_id', note_id FROM s WHERE note_id IN (SELECT note_id FROM s GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT path, 'unreadable', NULL FROM s WHERE NOT readable""",
    "tag_tree_rollup": with_inputs("tagged_notes") + ", " + _TREE.format("tag = 'hot'") + " SELECT folder, CAST(len(string_split(folder, '/')) AS BIGINT) AS depth, n_notes, n_direct, " + _KEY + " FROM c",
    "folder_tree_rollup": with_inputs("tagged_notes", "tag_folders") + ", " + _TREE.format("true") + """, e AS (SELECT path AS folder FROM tag_folders UNION SELECT regexp_extract(path, '^(.*)/', 1) FROM tag_folders UNION SELECT folder FROM c)
SELECT folder, CAST(len(string_split(folder, '/')) AS BIGINT) AS depth, coalesce(n_notes, 0) AS n_notes, coalesce(n_direct, 0) AS n_direct, """ + _KEY + " FROM e LEFT JOIN c USING (folder)",
    "ancestry_seal_check": with_inputs("sealed_links", "current_links") + """, b AS (SELECT s.seal_id, count(*) AS n_sealed, count(c.seal_id) AS n_current, count(CASE WHEN s.path = c.path AND s.inode = c.inode THEN 1 END) AS n_equal,
  count(CASE WHEN c.seal_id IS NOT NULL AND c.parent_id IS NULL THEN 1 END) AS roots FROM sealed_links s LEFT JOIN current_links c ON c.seal_id = s.seal_id AND c.depth = s.depth GROUP BY 1)
SELECT seal_id, n_sealed = n_current AND n_sealed = n_equal AND roots > 0 AS valid, n_sealed, n_current, n_equal FROM b""",
    "rate_limit_stages": with_inputs("shared_tries") + """, w1 AS (SELECT scope, min("at") AS s FROM shared_tries GROUP BY 1 UNION ALL SELECT scope, (SELECT min(t."at") FROM shared_tries t WHERE t.scope = w1.scope AND t."at" >= w1.s + 900) FROM w1 WHERE s IS NOT NULL),
a1 AS (SELECT t.*, w.s, row_number() OVER (PARTITION BY t.scope, w.s ORDER BY t."at", t.attempt_id) AS k FROM shared_tries t JOIN w1 w ON w.scope = t.scope AND w.s <= t."at" AND t."at" < w.s + 900),
p AS (SELECT * FROM a1 WHERE k <= 40), w2 AS (SELECT scope, key, min("at") AS s FROM p GROUP BY 1, 2 UNION ALL SELECT scope, key, (SELECT min(t."at") FROM p t WHERE t.scope = w2.scope AND t.key = w2.key AND t."at" >= w2.s + 900) FROM w2 WHERE s IS NOT NULL),
a2 AS (SELECT t.scope, t.key, t."at", t.attempt_id, w.s, row_number() OVER (PARTITION BY t.scope, t.key, w.s ORDER BY t."at", t.attempt_id) AS k FROM p t JOIN w2 w ON w.scope = t.scope AND w.key = t.key AND w.s <= t."at" AND t."at" < w.s + 900)
SELECT scope, key, "at", attempt_id, 'all' AS stage, s + 900 - "at" AS outcome FROM a1 WHERE k > 40
UNION ALL SELECT scope, key, "at", attempt_id, CASE WHEN k > 9 THEN 'key' END, CASE WHEN k > 9 THEN s + 900 - "at" END FROM a2""",
    "stream_registration_expiry": """WITH r AS (SELECT 'r' || event_id AS registration_id, ts AS issued FROM events WHERE event_type = 'signup'), v AS (SELECT 'r' || (event_id - 1 - user_id % 3) AS registration_id, ts AS at FROM events WHERE event_type IN ('click', 'view'))
SELECT r.registration_id, r.issued, v.at AS verified_at FROM r JOIN v ON v.registration_id = r.registration_id AND v.at >= r.issued AND v.at < r.issued + INTERVAL 5 MINUTES""",
}
