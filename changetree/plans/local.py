"""Registered queries of the queue, access, tree and document operators and their SQL. Inputs are derived from the given tables by
statements that Spark and other engines read alike; operators and their SQL are written apart."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import access, content, planning, queues, tree
from ..sources.tables import read
from .registry import nodes

INPUTS = {
    "outbox": """SELECT user_id % 10 AS tenant, event_id AS sequence, event_id AS operation_id, user_id AS object_id,
        CASE event_type WHEN 'error' THEN 'delete' WHEN 'purchase' THEN 'move' ELSE 'update' END AS kind,
        CASE WHEN event_id % 11 < 4 THEN 'accepted' WHEN event_id % 11 < 6 THEN 'pending' WHEN event_id % 11 < 8 THEN 'attempted' WHEN event_id % 11 = 8 THEN 'mismatch' ELSE 'conflict' END AS status,
        event_id % 5 AS revision, event_id + 1000 AS cursor FROM {events}""",
    "deps": "SELECT event_id AS operation_id, event_id - 1 - event_id % 9 AS needs FROM {events} WHERE event_id % 4 = 1 AND event_id > 10",
    "resolved": "SELECT event_id AS operation_id, CASE WHEN event_id % 2 = 0 THEN 'reverted' ELSE 'manual' END AS resolution FROM {events} WHERE event_id % 6 = 3",
    "covered": "SELECT event_id AS operation_id FROM {events} WHERE event_id % 7 = 2",
    "state": "SELECT tenant, object_id, max(revision) AS revision, max(operation_id) AS last_id, 'n' || CAST(max(sequence) AS VARCHAR(20)) AS name FROM {outbox} WHERE object_id % 3 <> 0 GROUP BY tenant, object_id",
    "inbox": """SELECT tenant, operation_id + 1000 AS cursor, CASE WHEN operation_id % 13 = 0 THEN operation_id + 1 ELSE operation_id END AS operation_id, object_id, kind AS mutation,
        CASE WHEN operation_id % 17 = 0 THEN revision + 1 ELSE revision END AS revision FROM {outbox} WHERE operation_id % 3 <> 2""",
    "log": "SELECT tenant, cursor, operation_id, object_id, kind AS mutation, revision, 'n' || CAST(sequence % 3 AS VARCHAR(20)) AS name, 'h' || CAST(sequence % 4 AS VARCHAR(20)) AS blob_hash FROM {outbox} WHERE status = 'accepted' AND sequence % 23 <> 0",
    "versions": """SELECT tenant, cursor, object_id, kind AS mutation, CASE WHEN sequence % 29 = 0 THEN revision + 1 ELSE revision END AS revision, 'n' || CAST(sequence % 3 AS VARCHAR(20)) AS name,
        CASE WHEN sequence % 31 = 0 THEN NULL ELSE 'h' || CAST(sequence % 4 AS VARCHAR(20)) END AS blob_hash FROM {outbox} WHERE status = 'accepted' AND sequence % 19 <> 0""",
    "operations": "SELECT tenant, cursor, object_id, revision, CASE WHEN sequence % 37 = 0 THEN operation_id + 1 ELSE operation_id END AS operation_id, status FROM {outbox} WHERE sequence % 41 <> 0",
    "manifest": """SELECT p_brand AS root, p_brand AS path, 'folder' AS type, CAST(NULL AS VARCHAR(20)) AS content_hash FROM {part} GROUP BY p_brand
        UNION ALL SELECT p_brand, p_brand || '/' || CAST(p_partkey AS VARCHAR(20)), CASE WHEN p_partkey % 7 = 0 THEN 'folder' ELSE 'note' END, p_type FROM {part} WHERE p_partkey % 11 <> 0""",
    "listing": """SELECT p_brand AS root, p_brand AS path, CASE WHEN min(p_partkey) % 5 = 0 THEN 'note' ELSE 'folder' END AS type, CAST(NULL AS VARCHAR(20)) AS content_hash FROM {part} GROUP BY p_brand
        UNION ALL SELECT p_brand, p_brand || '/' || CAST(p_partkey AS VARCHAR(20)), CASE WHEN p_partkey % 21 = 0 THEN 'note' WHEN p_partkey % 7 = 0 THEN 'folder' ELSE 'note' END,
        CASE WHEN p_partkey % 13 = 0 THEN p_name ELSE p_type END FROM {part} WHERE p_partkey % 9 <> 0""",
    "diff": "SELECT p_partkey AS object_id, CASE WHEN p_size % 5 = 0 THEN 'delete' ELSE 'update' END AS mutation, p_name AS path, p_type AS content_hash FROM {part}",
    "applied": """SELECT p_partkey AS object_id, CASE WHEN p_size % 10 = 0 THEN 'delete' ELSE 'update' END AS mutation, CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_partkey % 3 = 1 THEN p_name ELSE p_brand END AS path,
        CASE WHEN p_partkey % 4 = 0 THEN p_name ELSE p_type END AS content_hash FROM {part} WHERE p_partkey % 2 = 0""",
    "detections": "SELECT user_id % 10 AS tenant, event_type AS code, event_id AS at FROM {events}",
    "acks": "SELECT user_id % 10 AS tenant, event_type AS code, max(event_id) - event_id % 3 AS at FROM {events} WHERE user_id % 10 <> 4 GROUP BY user_id % 10, event_type, event_id % 3",
    "uses": "SELECT l_partkey AS blob_hash, l_orderkey * 10 + l_linenumber AS sequence, l_orderkey % 50 <> 0 AS finished FROM {lineitem}",
    "protectors": "SELECT p_partkey AS blob_hash FROM {part} WHERE p_size % 6 = 0",
    "cleanups": "SELECT l_partkey AS blob_hash, max(l_orderkey * 10 + l_linenumber) - l_partkey % 2 AS cleaned FROM {lineitem} WHERE l_partkey % 3 = 0 GROUP BY l_partkey",
    "newer": "SELECT tenant, object_id, max(sequence) AS sequence, max(operation_id) AS operation_id FROM {outbox} WHERE object_id % 2 = 0 GROUP BY tenant, object_id",
    "failed": "SELECT operation_id FROM {outbox} WHERE status = 'conflict'",
    "stored": "SELECT o_custkey % 7 AS tenant, o_orderkey AS cursor, o_orderstatus AS payload FROM {orders} WHERE o_orderkey <= 400 UNION ALL SELECT tenant, 400, 'x' FROM (SELECT DISTINCT o_custkey % 7 AS tenant FROM {orders}) t",
    "pages_in": """SELECT l_orderkey % 7 AS tenant, l_orderkey AS page, CASE WHEN l_orderkey % 2 = 0 THEN 400 ELSE l_orderkey END AS from_cursor,
        CASE WHEN l_orderkey % 2 = 0 THEN 400 ELSE l_orderkey END + count(*) OVER (PARTITION BY l_orderkey) AS next_cursor,
        CASE WHEN l_orderkey % 2 = 0 THEN 400 ELSE l_orderkey END + l_linenumber AS cursor, l_linestatus AS payload FROM {lineitem}""",
    "conflicts": "SELECT tenant, object_id, operation_id, revision AS canonical_revision FROM {outbox} WHERE status = 'conflict' AND kind = 'delete'",
    "copies": "SELECT event_id - event_id % 3 AS operation_id, event_id AS create_id, event_id % 5 AS sequence FROM {events}",
    "muts": """SELECT event_id, '0190aaaa-bbbb-' || CASE WHEN event_id % 37 = 0 THEN '4' ELSE '7' END || 'ccc-8ddd-' || lpad(CAST(event_id AS VARCHAR(20)), 12, '0') AS operation_id,
        '0190aaaa-bbbb-4ccc-' || CASE WHEN event_id % 41 = 0 THEN 'c' ELSE '9' END || 'ddd-' || lpad(CAST(user_id AS VARCHAR(20)), 12, '0') AS object_id,
        CASE event_id % 5 WHEN 0 THEN 'create' WHEN 1 THEN 'update' WHEN 2 THEN 'move' WHEN 3 THEN 'delete' ELSE CASE WHEN event_id % 43 = 0 THEN 'copy' ELSE 'create' END END AS kind,
        CASE WHEN event_id % 47 = 0 THEN NULL WHEN user_id % 4 = 0 THEN 'folder' ELSE 'note' END AS type,
        CASE WHEN event_id % 5 IN (0, 4) THEN CASE WHEN event_id % 53 = 0 THEN 1 ELSE 0 END ELSE CASE WHEN event_id % 59 = 0 THEN 0 ELSE 3 END END AS base_revision,
        CASE WHEN event_id % 5 IN (0, 2, 4) OR event_id % 61 = 0 THEN 'p' END AS parent_id, CASE WHEN event_id % 5 IN (0, 2, 4) OR event_id % 67 = 0 THEN 'n' END AS name,
        CASE WHEN event_id % 5 IN (0, 1, 4) AND user_id % 4 <> 0 OR event_id % 71 = 0 THEN repeat('ab', CASE WHEN event_id % 73 = 0 THEN 31 ELSE 32 END) END AS blob_hash,
        CASE WHEN event_id % 79 = 0 THEN '0190aaaa-bbbb-7ccc-8ddd-' || lpad(CAST(event_id AS VARCHAR(20)), 12, '0') END AS depends_on FROM {events}""",
    "downloads": """SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 'folder' ELSE 'note' END AS type, CASE event_id % 4 WHEN 0 THEN 'create' WHEN 1 THEN 'update' WHEN 2 THEN 'move' ELSE 'delete' END AS mutation,
        CASE WHEN event_id % 4 = 0 OR event_id % 17 = 0 THEN 1 ELSE 2 END AS revision, event_id % 4 = 3 OR event_id % 19 = 0 AS deleted, CASE WHEN user_id % 3 <> 0 AND event_id % 7 <> 0 OR event_id % 23 = 0 THEN 'h' END AS blob_hash FROM {events}""",
    "sessions": """SELECT o_orderkey AS session_id, o_custkey AS user_id, o_custkey * 3 + o_orderkey % 3 AS device_id, o_orderkey * 10 AS created, o_orderkey * 10 + 500 AS expires, o_orderkey % 13 = 0 AS revoked FROM {orders}""",
    "devices": """SELECT c_custkey * 3 + 0 AS device_id, c_name || ' a' AS device_name, c_custkey % 11 <> 0 AS active FROM {customer} UNION ALL SELECT c_custkey * 3 + 1, c_name || ' b', true FROM {customer}
        UNION ALL SELECT c_custkey * 3 + 2, c_name || ' c', c_custkey % 5 <> 0 FROM {customer} WHERE c_custkey % 7 <> 0""",
    "users": "SELECT c_custkey AS user_id, c_nationkey % 6 <> 0 AS active FROM {customer}",
    "current": "SELECT max(o_orderkey) AS session_id FROM {orders} GROUP BY o_custkey",
    "tokens": """SELECT l_orderkey * 10 + l_linenumber AS token_hash, l_orderkey AS session_id, l_orderkey * 10 + l_linenumber * 60 AS issued, l_orderkey * 10 + l_linenumber * 60 + 100 AS expires, min(l_partkey) % 17 = 0 AS revoked FROM {lineitem} WHERE l_linenumber < 5 GROUP BY l_orderkey, l_linenumber""",
    "requests": """SELECT l_orderkey * 10 + l_linenumber AS request_id, l_orderkey * 10 + l_linenumber % 5 AS token_hash, l_orderkey * 10 + l_linenumber * 60 + l_partkey % 150 - 20 AS at FROM {lineitem}""",
    "blob_requests": "SELECT l_orderkey * 10 + l_linenumber AS request_id, l_orderkey % 1500 AS user_id, l_suppkey % 5 AS tenant, l_partkey AS blob_hash FROM {lineitem}",
    "entitled": "SELECT l_suppkey % 5 AS tenant, l_partkey AS blob_hash FROM {lineitem} WHERE l_linenumber = 1",
    "blobs": "SELECT p_partkey AS blob_hash, p_size % 4 <> 0 AS available FROM {part}",
    "refreshes": "SELECT DISTINCT l_orderkey * 100 + l_linenumber * 10 + l_partkey % 3 AS use_id, l_orderkey * 10 + l_partkey % 3 + 1 AS token_hash, l_orderkey * 10 + l_linenumber * 40 AS at FROM {lineitem}",
    "revocations": "SELECT o_custkey * 3 + o_orderkey % 2 AS device_id, o_orderkey * 9 AS at FROM {orders} WHERE o_orderkey % 5 = 0",
    "issued": "SELECT token_hash, session_id, issued, CASE WHEN token_hash % 9 = 0 THEN issued + 7 END AS revoked_at FROM {tokens}",
    "registrations": "SELECT o_orderkey AS registration_id, o_orderkey * 20 AS issued FROM {orders}",
    "verifications": "SELECT l_orderkey AS registration_id, l_orderkey * 20 + (l_partkey - 400) * l_linenumber * 37 AS at FROM {lineitem} WHERE l_linenumber % 3 = 0",
    "mails": "SELECT o_orderkey AS message_id, o_orderkey AS created, o_orderkey + 30000 AS expires FROM {orders}",
    "attempts": "SELECT l_orderkey AS message_id, l_orderkey + l_linenumber * 100 + l_partkey % 50 AS at FROM {lineitem} WHERE l_suppkey % 3 = 0",
    "logins": "SELECT 'u' || CAST(user_id AS VARCHAR(20)) AS key, event_id AS attempt_id, event_id / 1 * 3 + user_id % 2 AS at0 FROM {events}",
    "tries": "SELECT key, attempt_id, CAST(at0 AS BIGINT) AS at FROM {logins}",
    "uploads": "SELECT o_custkey % 10 AS tenant, o_orderkey AS sequence, o_custkey % 97 AS blob_hash, o_custkey % 97 * 3 + 1 AS size FROM {orders}",
    "held": "SELECT p_partkey AS n, p_size AS size, p_brand AS b FROM {part}",
    "objects": """SELECT 'r' || CAST(r_regionkey AS VARCHAR(20)) AS object_id, CAST(NULL AS VARCHAR(20)) AS parent_id, r_name AS name, 'folder' AS type FROM {region}
        UNION ALL SELECT 'n' || CAST(n_nationkey AS VARCHAR(20)), 'r' || CAST(n_regionkey AS VARCHAR(20)), n_name, 'folder' FROM {nation}
        UNION ALL SELECT 'c' || CAST(c_custkey AS VARCHAR(20)), 'n' || CAST(c_nationkey AS VARCHAR(20)), c_name, 'folder' FROM {customer}
        UNION ALL SELECT 'o' || CAST(o_orderkey AS VARCHAR(20)), 'c' || CAST(o_custkey AS VARCHAR(20)), CAST(o_orderkey AS VARCHAR(20)) || '.md', 'note' FROM {orders}""",
    "versioned": "SELECT object_id, parent_id, type, CAST(1 + length(name) % 3 AS BIGINT) AS revision, length(name) % 5 = 0 AND type = 'note' AS deleted, lower(name) AS name_key FROM {objects}",
    "moves": """SELECT 'n' || CAST(n_nationkey AS VARCHAR(20)) AS object_id, CASE WHEN n_nationkey % 3 = 0 THEN 'n' || CAST(n_nationkey AS VARCHAR(20)) ELSE 'r' || CAST(n_regionkey AS VARCHAR(20)) END AS new_parent, n_name AS new_name FROM {nation}
        UNION ALL SELECT 'r' || CAST(n_regionkey AS VARCHAR(20)), 'n' || CAST(n_nationkey AS VARCHAR(20)), 'x' FROM {nation} WHERE n_nationkey % 2 = 0
        UNION ALL SELECT 'c' || CAST(c_custkey AS VARCHAR(20)), CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE 'n' || CAST(c_custkey % 25 AS VARCHAR(20)) END, CASE WHEN c_custkey % 10 = 0 THEN 'Trash' ELSE repeat(c_name, c_custkey % 60) END FROM {customer} WHERE c_custkey % 5 = 0""",
    "proposals": """SELECT o_orderkey AS operation_id, CASE o_orderkey % 4 WHEN 0 THEN 'create' WHEN 1 THEN 'update' WHEN 2 THEN 'move' ELSE 'delete' END AS kind,
        CASE WHEN o_orderkey % 9 = 0 THEN 'x' ELSE CASE WHEN o_orderkey % 7 = 0 THEN 'c' ELSE 'o' END END || CAST(CASE WHEN o_orderkey % 7 = 0 THEN o_custkey ELSE o_orderkey END AS VARCHAR(20)) AS object_id,
        CASE WHEN o_orderkey % 7 = 0 AND o_orderkey % 5 <> 0 THEN 'folder' ELSE 'note' END AS type, o_orderkey % 3 + 1 AS base_revision,
        CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN 'o' || CAST(o_orderkey AS VARCHAR(20)) ELSE 'c' || CAST(o_custkey % 1600 AS VARCHAR(20)) END AS parent_id,
        CASE WHEN o_orderkey % 5 = 0 THEN 'africa' ELSE CAST(o_orderkey AS VARCHAR(20)) || '.md' END AS name_key FROM {orders}""",
    "links": "SELECT page_id, url, html FROM {pages}",
    "tagged": "SELECT doc_id AS doc_order, doc_id, lang, CASE WHEN doc_id % 3 = 0 THEN upper(source) ELSE source END AS source FROM {documents}",
    "disputes": """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'create' WHEN 1 THEN 'update' WHEN 2 THEN 'move' ELSE 'delete' END AS kind, CASE WHEN user_id % 2 = 0 THEN 'note' ELSE 'folder' END AS type,
        CASE event_id % 7 WHEN 0 THEN 'path_collision' WHEN 1 THEN 'parent_unavailable' WHEN 2 THEN 'base_revision_mismatch' WHEN 3 THEN 'object_missing' WHEN 4 THEN 'object_deleted' WHEN 5 THEN 'folder_cycle' ELSE 'folder_not_empty' END AS code,
        event_id % 3 AS base_revision, CASE WHEN event_id % 5 > 1 THEN event_id % 11 END AS canonical_revision, CASE WHEN event_id % 5 > 1 THEN CASE WHEN user_id % 6 < 4 THEN 'note' ELSE 'folder' END END AS canonical_type,
        CASE WHEN event_id % 5 > 1 THEN user_id % 3 = 0 END AS canonical_deleted, user_id % 5 < 2 AS same_target, user_id % 7 < 3 AS same_parent FROM {events}""",
    "mutations": """SELECT (p_partkey - p_partkey % 10) % 7 AS replica, p_partkey AS object_id, CASE WHEN p_partkey % 10 > 0 THEN p_partkey - p_partkey % 10 END AS parent_id,
        CASE p_partkey % 4 WHEN 0 THEN 'create' WHEN 1 THEN 'move' WHEN 2 THEN CASE WHEN p_size % 2 = 0 THEN 'create' ELSE 'update' END ELSE 'delete' END AS mutation, p_size AS revision,
        CASE WHEN p_partkey % 10 > 0 THEN p_brand || '/' ELSE '' END || p_name AS path FROM {part}
        UNION ALL SELECT (p_partkey - p_partkey % 10) % 7, p_partkey, NULL, 'update', p_size, p_brand || '/' || p_name FROM {part} WHERE p_partkey % 8 = 1 AND p_partkey % 10 > 0""",
    "unnamed": """SELECT p_partkey AS operation_id, CASE WHEN p_partkey % 3 = 0 THEN 'folder' ELSE 'note' END AS type,
        CASE WHEN p_partkey % 9 = 1 THEN '.md' WHEN p_partkey % 11 = 0 THEN '' WHEN p_partkey % 7 = 0 THEN repeat(p_name || '-', 12) || '.md' WHEN p_partkey % 4 = 0 THEN p_name ELSE p_name || '.v1.md' END AS name FROM {part}""",
    "signups": """SELECT c_custkey AS account_id, CASE WHEN c_custkey % 11 = 0 THEN 'a..b@example.org' WHEN c_custkey % 13 = 0 THEN 'two@at@example.org' WHEN c_custkey % 17 = 0 THEN 'x@-bad.org' WHEN c_custkey % 19 = 0 THEN NULL
        ELSE CASE WHEN c_custkey % 2 = 0 THEN ' User' ELSE 'user' END || CAST(c_custkey % 50 AS VARCHAR(20)) || '@Example' || CAST(c_nationkey % 3 AS VARCHAR(20)) || '.org' END AS email FROM {customer}""",
    "labelled": "SELECT doc_id, lang AS a, ' ' || source AS b, upper(lang) || ' ' AS c, CASE WHEN doc_id % 13 = 0 THEN repeat('x', 41) WHEN doc_id % 17 = 0 THEN ' ' ELSE 'z' || CAST(doc_id % 3 AS VARCHAR(20)) END AS d FROM {documents}",
    "arrivals": """SELECT CAST(1 AS BIGINT) AS tenant, o_orderkey * 2 AS cursor, 'o' || CAST(o_orderkey AS VARCHAR(20)) AS object_id, 'note' AS type, CASE o_orderkey % 4 WHEN 0 THEN 'move' WHEN 1 THEN 'delete' ELSE 'update' END AS mutation, 1 + o_orderkey % 3 AS revision FROM {orders}
        UNION ALL SELECT 1, o_orderkey * 2 - 5, 'o' || CAST(o_orderkey AS VARCHAR(20)), 'note', 'update', 1 + o_orderkey % 3 FROM {orders} WHERE o_orderkey % 10 = 3
        UNION ALL SELECT 1, c_custkey * 20 + 1, 'c' || CAST(c_custkey AS VARCHAR(20)), 'folder', 'move', 2 FROM {customer} WHERE c_custkey % 4 = 0""",
    "known": "SELECT object_id, length(name) % 3 AS revision FROM {objects} WHERE name NOT LIKE '%7%'",
    "contested": "SELECT object_id FROM {objects} WHERE name LIKE '%33%'",
    "urls": "SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS path FROM {pages}",
}


def derived(spark: SparkSession, d: str, name: str) -> DataFrame:
    """An input, or one of the given tables."""
    if name not in INPUTS:
        return read(spark, d, name)
    needed = {n: derived(spark, d, n) for n in re.findall(r"\{(\w+)\}", INPUTS[name])}
    return spark.sql(INPUTS[name], **needed)


def with_inputs(*names: str) -> str:
    """The inputs and what they are derived from as common table expressions."""
    done: dict[str, str] = {}

    def add(name: str) -> None:
        if name in INPUTS and name not in done:
            for n in re.findall(r"\{(\w+)\}", INPUTS[name]):
                add(n)
            done[name] = re.sub(r"\{(\w+)\}", r"\1", INPUTS[name])

    for n in names:
        add(n)
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({q})" for n, q in done.items())


NOW_MAIL, NOW_REGISTRATION, QUOTA, LIMIT, WINDOW = 20_000, 200_000, 3_000, 3, 900
PATHS = """, paths AS (SELECT o.object_id, o.name, o.type, CASE substr(o.object_id, 1, 1) WHEN 'r' THEN 1 WHEN 'n' THEN 2 WHEN 'c' THEN 3 ELSE 4 END AS depth,
  concat_ws('/', c.name, b.name, a.name, o.name) AS path, list_filter([a.object_id, b.object_id, c.object_id], lambda x: x IS NOT NULL) AS ancestors
  FROM objects o LEFT JOIN objects a ON o.parent_id = a.object_id LEFT JOIN objects b ON a.parent_id = b.object_id LEFT JOIN objects c ON b.parent_id = c.object_id),
chain AS (SELECT object_id, object_id AS root, 0 AS level FROM paths UNION ALL SELECT object_id, unnest(ancestors), generate_subscripts(ancestors, 1) FROM paths)"""
ROOTS = "object_id LIKE 'n%'"


def _named(proposals: DataFrame) -> DataFrame:
    """Proposals with names, some of them too long for any path."""
    return proposals.withColumn("name", F.when(F.col("operation_id") % 37 == 0, F.repeat(F.lit("x"), content.PATH_BYTES + 1)).otherwise(F.col("name_key")))


def _paths(s, d):
    return tree.ancestor_paths(nodes(s, d))


def _roots(s, d):
    return derived(s, d, "objects").where(ROOTS).select(F.col("object_id").alias("root"), F.col("object_id").alias("operation_id"), F.lit(100).cast("long").alias("first_cursor"))


def _files(s, d):
    h = lambda x: F.sha2(F.concat(F.lit("b"), x).cast("binary"), 256)
    p = derived(s, d, "held")
    registry = p.where("n % 11 <> 0").select(h(F.col("n")).alias("blob_hash"), "size", (F.col("n") % 5 != 0).alias("available"))
    found = F.when(F.col("n") % 13 == 0, h(F.col("n") + 1)).otherwise(h(F.col("n")))
    files = p.where("n % 7 <> 0").select(F.when(F.col("n") % 17 == 0, F.concat(F.lit("t/"), "n")).otherwise(F.concat(F.lit("f/"), h(F.col("n")))).alias("path"), F.when(F.col("n") % 19 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("size"), found.alias("content_hash"))
    return registry, files


def _erased(s, d):
    held, gone = derived(s, d, "entitled"), derived(s, d, "entitled").where("tenant = 3 OR tenant = 1").select("tenant")
    after = access.erase_tenant({"entitled": held}, gone)["entitled"]
    return access.orphaned_blobs(held, after)


def _op(function, *names, **options):
    return lambda s, d: function(*[derived(s, d, n) for n in names], **options)


QUERIES = {
    "unresolved_objects": _op(queues.unresolved_objects, "outbox", "covered", "resolved"),
    "open_conflicts": _op(queues.open_conflicts, "outbox", "state", "resolved"),
    "ready_operations": _op(queues.ready_operations, "outbox", "deps", "resolved", limit=20),
    "blocked_subtree_deletes": _op(queues.blocked_subtree_deletes, "outbox", "deps", "inbox"),
    "own_echoes": lambda s, d: queues.own_echoes(derived(s, d, "inbox"), derived(s, d, "outbox").withColumnRenamed("kind", "mutation"), derived(s, d, "state")),
    "history_consistency_audit": _op(queues.history_consistency_audit, "log", "versions", "operations"),
    "tree_manifest_check": _op(queues.tree_manifest_check, "manifest", "listing"),
    "suppress_echoes": _op(queues.suppress_echoes, "diff", "applied"),
    "projected_revision": _op(queues.projected_revision, "state", "outbox"),
    "incident_rollup": _op(queues.incident_rollup, "detections", "acks"),
    "collectable_blobs": _op(queues.collectable_blobs, "uses", "protectors", "cleanups"),
    "supersede_pending": _op(queues.supersede_pending, "outbox", "deps", "newer"),
    "doomed_dependents": _op(queues.doomed_dependents, "outbox", "deps", "failed"),
    "ingest_changes": _op(queues.ingest_changes, "pages_in", "stored"),
    "rebase_deletes": _op(queues.rebase_deletes, "conflicts", "state", "copies"),
    "mutation_shape_check": lambda s, d: access.mutation_shape_check(derived(s, d, "muts")).select("event_id", "reason"),
    "change_shape_check": lambda s, d: access.change_shape_check(derived(s, d, "downloads")).select("event_id", "reason"),
    "token_validity": _op(access.token_validity, "requests", "tokens", "sessions", "devices", "users"),
    "blob_access_check": _op(access.blob_access_check, "blob_requests", "entitled", "blobs", "users"),
    "refresh_reuse_report": lambda s, d: access.refresh_reuse_report(derived(s, d, "refreshes"), derived(s, d, "tokens").drop("revoked")),
    "revocation_cascade": _op(access.revocation_cascade, "devices", "sessions", "issued", "revocations"),
    "registration_expiry": _op(access.registration_expiry, "registrations", "verifications", now=NOW_REGISTRATION),
    "erase_tenant": _erased,
    "session_roster": _op(access.session_roster, "sessions", "devices", "current"),
    "delivery_due_queue": _op(access.delivery_due_queue, "mails", "attempts", now=NOW_MAIL),
    "rate_limit_decisions": _op(access.rate_limit_decisions, "tries", limit=LIMIT, window=WINDOW),
    "quota_admission": _op(access.quota_admission, "uploads", limit=QUOTA),
    "blob_store_audit": lambda s, d: access.blob_store_audit(*_files(s, d)),
    "classify_proposals": lambda s, d: access.classify_proposals(_named(derived(s, d, "proposals")), derived(s, d, "versioned"), _paths(s, d)),
    "subtree_members": lambda s, d: tree.subtree_members(_paths(s, d), _roots(s, d)),
    "cycle_report": lambda s, d: tree.cycle_report(_paths(s, d), derived(s, d, "moves")),
    "moved_path_check": lambda s, d: tree.moved_path_check(_paths(s, d), derived(s, d, "moves"), reserved=("Trash",)),
    "subtree_signature": lambda s, d: tree.subtree_signature(derived(s, d, "objects"), _paths(s, d)),
    "clone_subtree_plan": lambda s, d: tree.clone_subtree_plan(derived(s, d, "objects"), _paths(s, d), _roots(s, d)),
    "manifest_audit": lambda s, d: tree.manifest_audit(tree.clone_subtree_plan(derived(s, d, "objects"), _paths(s, d), _roots(s, d)).where("cursor % 37 <> 0")),
    "resolve_conflicts": lambda s, d: planning.resolve_conflicts(derived(s, d, "disputes")).select("event_id", "action"),
    "plan_mutation_order": _op(planning.plan_mutation_order, "mutations"),
    "independent_changes": lambda s, d: planning.independent_changes(derived(s, d, "arrivals"), derived(s, d, "known"), _paths(s, d), derived(s, d, "contested")),
    "conflict_names": lambda s, d: planning.conflict_names(derived(s, d, "unnamed")).select("operation_id", "copy_name"),
    "email_identity": _op(planning.email_identity, "signups"),
    "normalize_tags": lambda s, d: planning.normalize_tags(derived(s, d, "labelled").withColumn("tags", F.array("a", "b", "c", "d"))),
    "path_policy_check": lambda s, d: content.path_policy_check(derived(s, d, "urls"), "path"),
    "tag_index": lambda s, d: content.tag_index(derived(s, d, "tagged").withColumn("tags", F.array("lang", "source"))),
    "link_safety_audit": lambda s, d: content.link_safety_audit(derived(s, d, "links"), "page_id", "html"),
}

_NAME = rf"""CASE WHEN coalesce(name, '') = '' THEN 'empty' WHEN name <> nfc_normalize(name) THEN 'not_nfc' WHEN strlen(name) > {content.NAME_BYTES} THEN 'too_long' WHEN regexp_matches(name, '{content.FORBIDDEN}') THEN 'forbidden_character'
  WHEN name LIKE '% ' OR name LIKE '%.' THEN 'trailing_space_or_dot' WHEN list_contains([{', '.join(f"'{x}'" for x in content.DEVICES)}], upper(rtrim(string_split(name, '.')[1], ' '))) THEN 'reserved_device' END"""
SQL = {
    "unresolved_objects": with_inputs("outbox", "covered", "resolved") + """ SELECT DISTINCT tenant, object_id FROM outbox o WHERE operation_id NOT IN (SELECT operation_id FROM covered)
AND (status IN ('pending', 'attempted', 'mismatch') OR status = 'conflict' AND operation_id NOT IN (SELECT operation_id FROM resolved))""",
    "open_conflicts": with_inputs("outbox", "state", "resolved") + """ SELECT o.tenant, o.object_id, sequence, operation_id, kind, s.revision AS canonical_revision, s.name AS canonical_name
FROM (SELECT * FROM outbox WHERE status = 'conflict' AND operation_id NOT IN (SELECT operation_id FROM resolved) ORDER BY sequence LIMIT 100) o LEFT JOIN state s ON s.tenant = o.tenant AND s.object_id = o.object_id""",
    "ready_operations": with_inputs("outbox", "deps", "resolved") + """ SELECT * FROM (SELECT tenant, object_id, sequence, operation_id, kind, row_number() OVER (PARTITION BY tenant ORDER BY sequence) AS place FROM outbox o WHERE status = 'pending'
AND NOT EXISTS (SELECT 1 FROM deps d WHERE d.operation_id = o.operation_id AND NOT EXISTS (SELECT 1 FROM outbox p WHERE p.operation_id = d.needs AND p.status = 'accepted')
  AND NOT EXISTS (SELECT 1 FROM resolved r WHERE r.operation_id = d.needs AND r.resolution IN ('reverted', 'equivalent')))) WHERE place <= 20""",
    "blocked_subtree_deletes": with_inputs("outbox", "deps", "inbox") + """ SELECT o.tenant, o.object_id, o.operation_id, count(DISTINCT p.operation_id) AS n_waiting,
(SELECT min(cursor) FROM inbox i WHERE i.tenant = o.tenant AND i.object_id = o.object_id AND mutation = 'move') AS moved_at
FROM outbox o JOIN deps d ON d.operation_id = o.operation_id JOIN outbox p ON p.operation_id = d.needs WHERE o.kind = 'delete' AND o.status <> 'accepted' AND p.kind = 'delete' AND p.status <> 'accepted' GROUP BY 1, 2, 3""",
    "own_echoes": with_inputs("inbox", "outbox", "state") + """ SELECT DISTINCT tenant, cursor FROM inbox i WHERE EXISTS (SELECT 1 FROM outbox o WHERE o.status = 'accepted' AND o.tenant = i.tenant AND o.operation_id = i.operation_id AND o.object_id = i.object_id
AND o.kind = i.mutation AND o.revision = i.revision AND o.cursor = i.cursor) OR i.mutation = 'delete' AND EXISTS (SELECT 1 FROM state s WHERE s.tenant = i.tenant AND s.object_id = i.object_id AND s.revision = i.revision)""",
    "history_consistency_audit": with_inputs("log", "versions", "operations") + """, keys AS (SELECT tenant, cursor FROM log UNION SELECT tenant, cursor FROM versions UNION SELECT tenant, cursor FROM operations WHERE status = 'accepted')
SELECT * FROM (SELECT k.tenant, k.cursor, CASE WHEN l.cursor IS NULL THEN 'not_logged' WHEN v.cursor IS NULL THEN 'no_version' WHEN o.cursor IS NULL THEN 'no_operation'
WHEN (l.object_id, l.revision, l.mutation, l.name) <> (v.object_id, v.revision, v.mutation, v.name) OR l.blob_hash IS DISTINCT FROM v.blob_hash THEN 'version_differs'
WHEN (l.object_id, l.revision, l.operation_id) <> (o.object_id, o.revision, o.operation_id) THEN 'operation_differs' END AS problem FROM keys k LEFT JOIN log l ON l.tenant = k.tenant AND l.cursor = k.cursor
LEFT JOIN versions v ON v.tenant = k.tenant AND v.cursor = k.cursor LEFT JOIN operations o ON o.tenant = k.tenant AND o.cursor = k.cursor AND o.status = 'accepted') WHERE problem IS NOT NULL""",
    "tree_manifest_check": with_inputs("manifest", "listing") + """, k AS (SELECT root, path FROM manifest UNION SELECT root, path FROM listing)
SELECT * FROM (SELECT k.root, k.path, CASE WHEN f.type IS NULL THEN 'missing' WHEN e.type IS NULL THEN 'unexpected' WHEN e.type <> f.type THEN 'type' WHEN e.content_hash IS DISTINCT FROM f.content_hash THEN 'hash'
WHEN EXISTS (SELECT 1 FROM listing u WHERE u.root = k.root AND u.type <> 'folder' AND u.path = array_to_string(string_split(k.path, '/')[:-2], '/')) THEN 'parent' END AS problem
FROM k LEFT JOIN manifest e ON e.root = k.root AND e.path = k.path LEFT JOIN listing f ON f.root = k.root AND f.path = k.path) WHERE problem IS NOT NULL""",
    "suppress_echoes": with_inputs("diff", "applied") + """ SELECT * FROM diff d WHERE NOT EXISTS (SELECT 1 FROM applied a WHERE a.object_id = d.object_id AND (a.mutation = 'delete' AND d.mutation = 'delete'
OR a.mutation <> 'delete' AND d.mutation <> 'delete' AND a.content_hash = d.content_hash AND coalesce(a.path, d.path) = d.path))""",
    "projected_revision": with_inputs("state", "outbox") + """, n AS (SELECT tenant, object_id, count(*) AS n, max(operation_id) AS depends_on FROM outbox WHERE status IN ('pending', 'attempted') GROUP BY 1, 2)
SELECT tenant, object_id, coalesce(s.revision, 0) + coalesce(n, 0) AS projected, depends_on, s.revision IS NOT NULL AS durable FROM state s FULL JOIN n USING (tenant, object_id)""",
    "incident_rollup": with_inputs("detections", "acks") + """ SELECT tenant, code, min("at") AS first_seen, max("at") AS last_seen, count(*) AS n_seen FROM detections d GROUP BY 1, 2
HAVING max("at") > coalesce((SELECT max(a."at") FROM acks a WHERE a.tenant = d.tenant AND a.code = d.code), -1)""",
    "collectable_blobs": with_inputs("uses", "protectors", "cleanups") + """ SELECT blob_hash, max(sequence) AS last_sequence FROM uses u WHERE blob_hash NOT IN (SELECT blob_hash FROM protectors) GROUP BY 1
HAVING count(*) FILTER (NOT finished) = 0 AND max(sequence) > coalesce((SELECT cleaned FROM cleanups c WHERE c.blob_hash = u.blob_hash), -1)""",
    "supersede_pending": with_inputs("outbox", "deps", "newer") + """ SELECT o.tenant, o.operation_id, n.operation_id AS by FROM outbox o JOIN newer n ON n.tenant = o.tenant AND n.object_id = o.object_id AND n.sequence > o.sequence
WHERE o.status = 'pending' AND o.operation_id NOT IN (SELECT needs FROM deps)""",
    "doomed_dependents": with_inputs("outbox", "deps", "failed") + """, reach AS (SELECT operation_id FROM failed UNION SELECT d.operation_id FROM deps d JOIN reach r ON d.needs = r.operation_id)
SELECT operation_id FROM reach WHERE operation_id NOT IN (SELECT operation_id FROM failed) AND operation_id IN (SELECT operation_id FROM outbox WHERE status IN ('pending', 'attempted', 'mismatch'))""",
    "rebase_deletes": with_inputs("conflicts", "state", "copies") + """ SELECT c.tenant, c.object_id, c.operation_id AS replaces, s.revision AS base_revision, k.create_id AS depends_on FROM conflicts c
JOIN state s ON s.tenant = c.tenant AND s.object_id = c.object_id AND s.revision = c.canonical_revision
JOIN (SELECT *, row_number() OVER (PARTITION BY operation_id ORDER BY sequence DESC, create_id DESC) AS r FROM copies) k ON k.operation_id = c.operation_id AND r = 1""",
    "mutation_shape_check": with_inputs("muts") + r""" SELECT event_id, CASE WHEN NOT regexp_full_match(operation_id, '[0-9a-f]{8}-[0-9a-f]{4}-7[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}') THEN 'operation_id'
WHEN NOT regexp_full_match(object_id, '[0-9a-f]{8}-[0-9a-f]{4}-[1-8][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}') THEN 'object_id' WHEN depends_on = operation_id THEN 'depends_on_itself' WHEN type IS NULL THEN 'type'
WHEN kind = 'copy' THEN 'kind' WHEN kind = 'create' AND base_revision > 0 OR kind <> 'create' AND base_revision = 0 THEN 'base_revision'
WHEN kind IN ('create', 'move') AND name IS NULL OR kind IN ('update', 'delete') AND name IS NOT NULL THEN 'name' WHEN kind IN ('update', 'delete') AND parent_id IS NOT NULL THEN 'parent'
WHEN kind = 'update' AND type = 'folder' THEN 'folder_update' WHEN (kind = 'update' OR kind = 'create' AND type = 'note') AND coalesce(length(blob_hash), 0) <> 64 THEN 'hash_missing'
WHEN blob_hash IS NOT NULL AND (kind IN ('move', 'delete') OR kind = 'create' AND type = 'folder') THEN 'hash_not_allowed' END AS reason FROM muts""",
    "change_shape_check": with_inputs("downloads") + """ SELECT event_id, CASE WHEN mutation = 'create' AND revision <> 1 OR mutation <> 'create' AND revision = 1 THEN 'create_revision'
WHEN mutation = 'delete' AND NOT deleted OR mutation <> 'delete' AND deleted THEN 'deleted_flag' WHEN type = 'folder' AND mutation = 'update' THEN 'folder_update' WHEN type = 'folder' AND blob_hash = 'h' THEN 'folder_hash'
WHEN type = 'note' AND NOT deleted AND blob_hash IS NULL THEN 'note_hash' END AS reason FROM downloads""",
    "token_validity": with_inputs("requests", "tokens", "sessions", "devices", "users") + """ SELECT r.request_id, r.token_hash, r.at, CASE WHEN t.token_hash IS NULL THEN 'unknown_token' WHEN t.revoked THEN 'revoked' WHEN NOT (r.at >= t.issued AND r.at < t.expires) THEN 'expired'
WHEN s.session_id IS NULL OR s.revoked THEN 'session' WHEN NOT (r.at >= s.created AND r.at < s.expires) THEN 'session_expired' WHEN d.active IS NOT TRUE THEN 'device' WHEN u.active IS NOT TRUE THEN 'user' END AS reason
FROM requests r LEFT JOIN tokens t ON t.token_hash = r.token_hash LEFT JOIN sessions s ON s.session_id = t.session_id LEFT JOIN devices d ON d.device_id = s.device_id LEFT JOIN users u ON u.user_id = s.user_id""",
    "blob_access_check": with_inputs("blob_requests", "entitled", "blobs", "users") + """ SELECT *, CASE WHEN user_id IN (SELECT user_id FROM users WHERE active) AND EXISTS (SELECT 1 FROM entitled e WHERE e.tenant = q.tenant AND e.blob_hash = q.blob_hash)
AND blob_hash IN (SELECT blob_hash FROM blobs WHERE available) THEN 'available' ELSE 'unavailable' END AS outcome FROM blob_requests q""",
    "refresh_reuse_report": with_inputs("refreshes", "tokens") + """, u AS (SELECT r.*, t.session_id, r."at" >= t.issued AND r."at" < t.expires AS good FROM refreshes r LEFT JOIN tokens t USING (token_hash)),
n AS (SELECT *, coalesce(sum(CASE WHEN good THEN 1 ELSE 0 END) OVER (PARTITION BY token_hash ORDER BY "at", use_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0 AS again FROM u),
k AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY again DESC, "at", use_id) AS p FROM n), v AS (SELECT session_id, "at" AS va, use_id AS vu FROM k WHERE p = 1 AND again AND session_id IS NOT NULL)
SELECT use_id, token_hash, "at", session_id, CASE WHEN session_id IS NULL THEN 'unknown' WHEN use_id = vu THEN 'reuse_revokes' WHEN "at" > va OR "at" = va AND use_id > vu THEN 'session_revoked' WHEN good THEN 'rotated' ELSE 'expired' END AS outcome
FROM n LEFT JOIN v USING (session_id)""",
    "revocation_cascade": with_inputs("devices", "sessions", "issued", "revocations") + """ SELECT token_hash, session_id, s.device_id, coalesce(revoked_at, (SELECT greatest(min(r.at), issued) FROM revocations r WHERE r.device_id = s.device_id
AND r.device_id IN (SELECT device_id FROM devices) HAVING min(r.at) IS NOT NULL)) AS revoked_at FROM issued JOIN sessions s USING (session_id)""",
    "registration_expiry": with_inputs("registrations", "verifications") + f""" SELECT g.registration_id, g.issued, min(v.at) AS verified_at, CASE WHEN min(v.at) IS NOT NULL THEN 'verified' WHEN g.issued + 86400 <= {NOW_REGISTRATION} THEN 'expired' ELSE 'pending' END AS status
FROM registrations g LEFT JOIN verifications v ON v.registration_id = g.registration_id AND v.at >= g.issued AND v.at < g.issued + 86400 GROUP BY 1, 2""",
    "erase_tenant": with_inputs("entitled") + " SELECT blob_hash FROM entitled GROUP BY 1 HAVING bool_and(tenant IN (1, 3))",
    "session_roster": with_inputs("sessions", "devices", "current") + """ SELECT user_id, session_id, device_name, created, session_id IN (SELECT session_id FROM current) AS is_current,
row_number() OVER (PARTITION BY user_id ORDER BY created DESC, session_id) AS place FROM sessions LEFT JOIN devices USING (device_id)""",
    "delivery_due_queue": with_inputs("mails", "attempts") + f""", q AS (SELECT message_id, created, expires, count(a.at) AS n_failed, CAST(coalesce(max(a.at) + 15 * (1 << greatest(least(count(a.at), 8) - 1, 0)), created) AS BIGINT) AS due FROM mails LEFT JOIN attempts a USING (message_id) GROUP BY 1, 2, 3)
SELECT message_id, n_failed, due, created FROM q WHERE due <= {NOW_MAIL} AND expires > {NOW_MAIL}""",
    "rate_limit_decisions": with_inputs("tries") + f""", o AS (SELECT *, min("at") OVER (PARTITION BY key ORDER BY "at" RANGE BETWEEN {WINDOW} FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM tries),
starts AS (SELECT key, min("at") AS s FROM tries GROUP BY 1 UNION SELECT o.key, o.nxt FROM o JOIN starts ON o.key = starts.key AND o."at" = starts.s WHERE o.nxt IS NOT NULL),
p AS (SELECT t.*, max(s) AS s FROM tries t JOIN starts ON starts.key = t.key AND s <= "at" GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY key, s ORDER BY "at", attempt_id) AS k FROM p)
SELECT key, "at", attempt_id, CASE WHEN k > {LIMIT} THEN {WINDOW} - ("at" - s) END AS outcome FROM n""",
    "quota_admission": with_inputs("uploads") + f""", f AS (SELECT tenant, blob_hash, min(sequence) AS sequence, any_value(size) AS size FROM uploads GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY tenant ORDER BY sequence) AS k FROM f),
r AS (SELECT tenant, blob_hash, k, size <= {QUOTA} AS admitted, CASE WHEN size <= {QUOTA} THEN size ELSE 0 END AS used FROM o WHERE k = 1
UNION ALL SELECT o.tenant, o.blob_hash, o.k, o.size <= {QUOTA} - used, used + CASE WHEN o.size <= {QUOTA} - used THEN o.size ELSE 0 END FROM r JOIN o ON o.tenant = r.tenant AND o.k = r.k + 1)
SELECT u.tenant, u.blob_hash, u.sequence, u.size, r.admitted FROM uploads u JOIN r USING (tenant, blob_hash)""",
    "blob_store_audit": with_inputs("held") + """, g AS (SELECT n, sha256('b' || n) AS h, size FROM held), r AS (SELECT *, n % 5 <> 0 AS available FROM g WHERE n % 11 <> 0), f AS (SELECT * FROM g WHERE n % 7 <> 0 AND n % 17 <> 0)
SELECT coalesce(r.h, f.h) AS blob_hash, CASE WHEN r.h IS NULL THEN 'orphan' WHEN f.h IS NULL AND available THEN 'missing' WHEN f.h IS NULL THEN 'unavailable' WHEN f.n % 19 = 0 OR f.n % 13 = 0 THEN 'corrupt' ELSE 'ok' END AS status
FROM r FULL JOIN f ON r.h = f.h UNION ALL SELECT 't/' || n, 'malformed' FROM g WHERE n % 7 <> 0 AND n % 17 = 0""",
    "classify_proposals": with_inputs("proposals", "versioned", "objects") + PATHS + """ SELECT p.operation_id, p.kind, p.object_id, CASE WHEN kind = 'create' AND k.object_id IS NOT NULL THEN 'object_exists'
WHEN kind = 'create' THEN CASE WHEN p.parent_id IS NOT NULL AND (u.object_id IS NULL OR u.deleted OR u.type <> 'folder') THEN 'parent_unavailable' WHEN p.operation_id % 37 = 0 THEN 'invalid'
  WHEN EXISTS (SELECT 1 FROM versioned x WHERE NOT x.deleted AND x.name_key = p.name_key AND x.parent_id IS NOT DISTINCT FROM p.parent_id AND x.object_id <> p.object_id) THEN 'path_collision' ELSE 'accepted' END
WHEN k.object_id IS NULL THEN 'object_missing' WHEN k.deleted THEN 'object_deleted' WHEN p.type <> k.type THEN 'type_mismatch' WHEN p.base_revision <> k.revision THEN 'base_revision_mismatch'
WHEN kind = 'move' AND p.parent_id IS NOT NULL AND (u.object_id IS NULL OR u.deleted OR u.type <> 'folder') THEN 'parent_unavailable'
WHEN kind = 'move' AND p.type = 'folder' AND EXISTS (SELECT 1 FROM chain c WHERE c.root = p.object_id AND c.object_id = p.parent_id) THEN 'folder_cycle'
WHEN kind = 'move' AND p.operation_id % 37 = 0 THEN 'invalid'
WHEN kind = 'move' AND EXISTS (SELECT 1 FROM versioned x WHERE NOT x.deleted AND x.name_key = p.name_key AND x.parent_id IS NOT DISTINCT FROM p.parent_id AND x.object_id <> p.object_id) THEN 'path_collision'
WHEN kind = 'delete' AND p.type = 'folder' AND EXISTS (SELECT 1 FROM versioned x WHERE NOT x.deleted AND x.parent_id = p.object_id) THEN 'folder_not_empty' ELSE 'accepted' END AS code
FROM proposals p LEFT JOIN versioned k ON k.object_id = p.object_id LEFT JOIN versioned u ON u.object_id = p.parent_id""",
    "subtree_members": with_inputs("objects") + PATHS + " SELECT root, object_id, level, count(*) OVER (PARTITION BY root) > 10000 AS too_large FROM chain WHERE root LIKE 'n%'",
    "cycle_report": with_inputs("objects", "moves") + PATHS + " SELECT m.object_id, 'move' AS reason FROM moves m WHERE EXISTS (SELECT 1 FROM chain c WHERE c.root = m.object_id AND c.object_id = m.new_parent)",
    "moved_path_check": with_inputs("objects", "moves") + PATHS + """, n AS (SELECT m.object_id AS moved, c.object_id, concat_ws('/', u.path, m.new_name) || substr(p.path, length(o.path) + 1) AS new_path
FROM moves m JOIN paths o ON o.object_id = m.object_id LEFT JOIN paths u ON u.object_id = m.new_parent JOIN chain c ON c.root = m.object_id JOIN paths p ON p.object_id = c.object_id WHERE m.new_parent IS NULL OR u.path IS NOT NULL)
SELECT * FROM (SELECT *, CASE WHEN strlen(new_path) > 768 THEN 'too_long' WHEN string_split(lower(new_path), '/')[1] = 'trash' THEN 'reserved_root' END AS problem FROM n) WHERE problem IS NOT NULL""",
    "subtree_signature": with_inputs("objects") + """, o AS (SELECT parent_id, 'f:' || name || ':' || object_id AS e FROM objects WHERE type = 'note'), so AS (SELECT parent_id AS i, sha256(string_agg(e, ',' ORDER BY e)) AS s FROM o GROUP BY 1),
c AS (SELECT object_id, parent_id, name, coalesce(s, '') AS s FROM objects LEFT JOIN so ON i = object_id WHERE object_id LIKE 'c%'), sc AS (SELECT parent_id AS i, sha256(string_agg('d:' || name || ':' || s, ',' ORDER BY 'd:' || name || ':' || s)) AS s FROM c GROUP BY 1),
n AS (SELECT object_id, parent_id, name, coalesce(s, '') AS s FROM objects LEFT JOIN sc ON i = object_id WHERE object_id LIKE 'n%'), sn AS (SELECT parent_id AS i, sha256(string_agg('d:' || name || ':' || s, ',' ORDER BY 'd:' || name || ':' || s)) AS s FROM n GROUP BY 1)
SELECT object_id, s AS signature FROM c UNION ALL SELECT object_id, s FROM n UNION ALL SELECT object_id, coalesce(s, '') FROM objects LEFT JOIN sn ON i = object_id WHERE object_id LIKE 'r%'""",
    "clone_subtree_plan": with_inputs("objects") + PATHS + """, m AS (SELECT c.root, c.object_id, c.level, o.parent_id, o.type FROM chain c JOIN objects o USING (object_id) WHERE c.root LIKE 'n%' AND (SELECT count(*) FROM chain x WHERE x.root = c.root) <= 10000),
s AS (SELECT root, object_id, 1 AS o, level AS l, 'clone' AS phase, substr(sha256(root || ':' || object_id), 1, 32) AS target FROM m WHERE type = 'folder' UNION ALL SELECT root, object_id, 2, level, 'move', substr(sha256(root || ':' || parent_id), 1, 32) FROM m WHERE type = 'note'
UNION ALL SELECT root, object_id, 3, -level, 'delete', NULL FROM m WHERE type = 'folder')
SELECT root, 99 + row_number() OVER (PARTITION BY root ORDER BY o, l, object_id) AS cursor, phase, object_id, target FROM s""",
    "resolve_conflicts": with_inputs("disputes") + """, x AS (SELECT *, code IN ('path_collision', 'parent_unavailable') AS blocked, canonical_revision IS NULL AS unknown, coalesce(canonical_revision > base_revision, false) AS newer, canonical_deleted IS TRUE AS gone FROM disputes)
SELECT event_id, CASE WHEN type = 'folder' THEN CASE WHEN kind = 'create' AND blocked AND unknown THEN 'recover_folder' WHEN kind = 'move' AND code = 'object_deleted' THEN 'recover_moved_folder'
  WHEN kind = 'delete' AND code = 'base_revision_mismatch' AND newer AND NOT gone THEN 'preserve_then_delete' WHEN kind = 'move' AND code = 'base_revision_mismatch' AND NOT same_target THEN 'split_divergent_folder'
  WHEN kind = 'move' AND (blocked OR code = 'folder_cycle' OR same_target) THEN 'revert_move' WHEN kind = 'delete' AND code = 'folder_not_empty' THEN 'restore_folder'
  WHEN kind = 'delete' AND (code = 'object_missing' AND unknown OR code = 'object_deleted' AND gone AND newer AND canonical_type = 'folder') THEN 'already_deleted' ELSE 'needs_attention' END
WHEN kind = 'create' THEN CASE WHEN unknown AND blocked THEN 'copy_orphan' ELSE 'needs_attention' END
WHEN kind = 'update' THEN CASE WHEN unknown AND code = 'object_missing' THEN 'copy_orphan' WHEN newer AND code IN ('base_revision_mismatch', 'object_deleted') THEN 'keep_both' ELSE 'needs_attention' END
WHEN kind = 'move' THEN CASE WHEN code = 'base_revision_mismatch' AND same_target THEN 'equivalent' WHEN unknown AND code = 'object_missing' THEN 'copy_orphan' WHEN blocked OR code = 'base_revision_mismatch' AND same_parent THEN 'copy_and_restore'
  WHEN newer AND code = 'object_deleted' THEN 'keep_both' ELSE 'needs_attention' END
WHEN code = 'object_missing' AND unknown OR code = 'object_deleted' AND gone AND newer AND canonical_type = 'note' THEN 'already_deleted' WHEN code = 'base_revision_mismatch' AND newer AND NOT gone THEN 'rescue_remote_then_delete' ELSE 'needs_attention' END AS action FROM x""",
    "plan_mutation_order": with_inputs("mutations") + """, r AS (SELECT *, CASE mutation WHEN 'create' THEN 1 WHEN 'delete' THEN 3 ELSE 2 END AS ph, len(string_split(path, '/')) AS dp FROM mutations),
p AS (SELECT *, row_number() OVER (PARTITION BY replica ORDER BY ph, CASE ph WHEN 1 THEN dp WHEN 3 THEN -dp ELSE 0 END, path, object_id, mutation) AS place FROM r), m AS (SELECT replica, object_id, min(place) AS place FROM p WHERE mutation = 'move' GROUP BY 1, 2)
SELECT p.replica, p.place, p.object_id, mutation, CASE mutation WHEN 'create' THEN (SELECT min(q.place) FROM p q WHERE q.replica = p.replica AND q.object_id = p.parent_id AND q.mutation = 'create') WHEN 'update' THEN m.place
WHEN 'delete' THEN (SELECT max(q.place) FROM p q WHERE q.replica = p.replica AND q.mutation = 'delete' AND q.place < p.place) END AS depends_on,
CAST(CASE mutation WHEN 'create' THEN 0 WHEN 'update' THEN revision + CASE WHEN m.place IS NULL THEN 0 ELSE 1 END ELSE revision END AS BIGINT) AS base_revision FROM p LEFT JOIN m ON m.replica = p.replica AND m.object_id = p.object_id""",
    "independent_changes": with_inputs("objects", "arrivals", "known", "contested") + PATHS + """, e AS (SELECT object_id, min(cursor) AS lowest FROM arrivals GROUP BY 1)
SELECT i.tenant, i.cursor, i.object_id FROM arrivals i JOIN known k ON k.object_id = i.object_id AND k.revision = i.revision - 1 JOIN e own ON own.object_id = i.object_id AND own.lowest = i.cursor
WHERE i.type = 'note' AND i.mutation <> 'move' AND i.object_id NOT IN (SELECT object_id FROM contested) AND i.object_id IN (SELECT object_id FROM paths)
AND NOT EXISTS (SELECT 1 FROM chain c LEFT JOIN e ON e.object_id = c.root WHERE c.object_id = i.object_id AND c.level > 0 AND (c.root NOT IN (SELECT object_id FROM known) OR c.root IN (SELECT object_id FROM contested) OR e.lowest < i.cursor))""",
    "conflict_names": with_inputs("unnamed") + """, s AS (SELECT *, CASE WHEN type = 'note' AND contains(name, '.') THEN name[:len(name) - strpos(reverse(name), '.')] ELSE name END AS stem, ' (Konflikt - ' || operation_id || CASE type WHEN 'note' THEN ').md' ELSE ')' END AS suffix FROM unnamed)
SELECT operation_id, CASE WHEN stem <> '' THEN stem[:180 - len(suffix)] WHEN type = 'note' THEN 'Notiz' ELSE 'Ordner' END || suffix AS copy_name FROM s""",
    "email_identity": with_inputs("signups") + """, k AS (SELECT account_id, trim(email) AS e, string_split(trim(email), '@') AS parts FROM signups),
c AS (SELECT account_id, CASE WHEN len(parts) = 2 AND regexp_full_match(parts[1], '[!#-''*+/-9=?A-Z^-~.-]+') AND NOT contains('.' || parts[1] || '.', '..') AND len(list_filter(string_split(parts[2], '.'), lambda x: x = '' OR starts_with(x, '-') OR ends_with(x, '-'))) = 0 THEN lower(e) END AS canonical FROM k)
SELECT account_id, canonical, CASE WHEN canonical IS NOT NULL THEN count(*) OVER (PARTITION BY canonical) END AS n_same FROM c""",
    "normalize_tags": with_inputs("labelled") + """, t AS (SELECT doc_id, trim(unnest([a, b, c, d])) AS tag, unnest([0, 1, 2, 3]) AS place FROM labelled),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(tag) ORDER BY place) AS r FROM t)
SELECT doc_id, CASE WHEN bool_and(coalesce(len(tag) BETWEEN 1 AND 40, false)) THEN list(tag ORDER BY place) FILTER (r = 1) END AS tags, bool_and(coalesce(len(tag) BETWEEN 1 AND 40, false)) AS valid FROM o GROUP BY 1""",
    "path_policy_check": with_inputs("urls") + f""", c AS (SELECT DISTINCT path, unnest(string_split(path, '/')) AS name, generate_subscripts(string_split(path, '/'), 1) - 1 AS part FROM urls), b AS (SELECT path, part, CASE WHEN name IN ('', '.', '..') THEN 'empty_or_dots' ELSE {_NAME} END AS problem FROM c),
f AS (SELECT path, CAST(min(part) AS INTEGER) AS part, arg_min(problem, part) AS problem FROM b WHERE problem IS NOT NULL GROUP BY 1)
SELECT u.page_id, u.path, CASE WHEN coalesce(u.path, '') = '' THEN 'empty' WHEN strlen(u.path) > 768 THEN 'too_long' WHEN u.path[1] = '/' THEN 'leading_slash' ELSE f.problem END AS problem,
CASE WHEN NOT (coalesce(u.path, '') = '' OR strlen(u.path) > 768 OR u.path[1] = '/') THEN f.part END AS part FROM urls u LEFT JOIN f USING (path)""",
    "tag_index": with_inputs("tagged") + """, t AS (SELECT doc_id, 0 AS "at", lang AS tag FROM tagged WHERE lang IS NOT NULL UNION ALL SELECT doc_id, 1, source FROM tagged WHERE source IS NOT NULL)
SELECT lower(tag) AS tag_key, arg_min(tag, doc_id * 2 + "at") AS tag, count(DISTINCT doc_id) AS n_docs FROM t GROUP BY 1""",
    "link_safety_audit": r"""WITH l AS (SELECT page_id, coalesce(html, '') AS h, regexp_extract_all(coalesce(html, ''), '(?is)<a\s[^>]*?href\s*=\s*["'']([^"'']*)["'']', 1) AS links FROM pages)
SELECT page_id, len(links) AS n_links, len(list_filter(links, lambda x: NOT (starts_with(x, '#') OR starts_with(lower(x), 'http:') OR starts_with(lower(x), 'https:') OR starts_with(lower(x), 'mailto:')))) AS n_refused,
len(regexp_extract_all(h, '(?i)<(script|style|iframe|object|embed|form|svg|base|meta)[\s>/]')) AS n_barred, len(regexp_extract_all(h, '(?i)\son[a-z]+\s*=')) AS n_handlers FROM l""",
}
SQL["manifest_audit"] = SQL["clone_subtree_plan"].replace("SELECT root, 99 + row_number()", ", p AS (SELECT root, 99 + row_number()") + """), q AS (SELECT * FROM p WHERE cursor % 37 <> 0)
SELECT root, 'cursors' AS problem FROM q GROUP BY 1 HAVING count(*) <> max(cursor) - min(cursor) + 1 UNION ALL SELECT root, 'phases' FROM q GROUP BY 1
HAVING max(cursor) FILTER (phase = 'clone') > coalesce(min(cursor) FILTER (phase = 'move'), min(cursor) FILTER (phase = 'delete')) OR coalesce(max(cursor) FILTER (phase = 'move'), max(cursor) FILTER (phase = 'clone')) > min(cursor) FILTER (phase = 'delete')
UNION ALL SELECT root, 'clones' FROM q GROUP BY 1 HAVING count(*) FILTER (phase = 'clone') <> count(*) FILTER (phase = 'delete')
UNION ALL SELECT DISTINCT root, 'moves' FROM q m WHERE phase = 'move' AND NOT EXISTS (SELECT 1 FROM q c WHERE c.root = m.root AND c.phase = 'clone' AND c.target = m.target)"""
