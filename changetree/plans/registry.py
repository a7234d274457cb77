"""Registered queries of the change-data operators and their SQL. The inputs are derived from the given
tables, once as DataFrames and once as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import content, history, tree
from ..sources.tables import read

CHANGES = """changes AS (
  SELECT user_id % 10 AS tenant, user_id AS object_id, row_number() OVER (PARTITION BY user_id % 10 ORDER BY event_id) AS cursor,
    row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS revision, event_id AS operation_id, event_type AS name,
    CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1 THEN 'create'
         WHEN event_type = 'error' AND row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1 THEN 'delete'
         WHEN event_type = 'purchase' THEN 'move' ELSE 'update' END AS mutation,
    sha256(CAST(event_id AS VARCHAR)) AS blob_hash FROM events)"""
BROKEN = """broken AS (SELECT * FROM changes WHERE operation_id % 97 <> 0 UNION ALL SELECT * FROM changes WHERE operation_id % 101 = 0 AND operation_id % 97 <> 0)"""
STATE = """SELECT tenant, object_id, cursor, revision, operation_id, name, mutation, blob_hash, mutation = 'delete' AS deleted
FROM (SELECT *, row_number() OVER (PARTITION BY tenant, object_id ORDER BY cursor DESC) AS k FROM {}) WHERE k = 1"""
TREE = """tree AS (
  SELECT 'r' || r_regionkey AS object_id, NULL AS parent_id, r_name AS name FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_name FROM customer
  UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, CAST(o_orderkey AS VARCHAR) || '.md' FROM orders)"""
PATHS = """paths AS (
  SELECT o.object_id, CASE substr(o.object_id, 1, 1) WHEN 'r' THEN 1 WHEN 'n' THEN 2 WHEN 'c' THEN 3 ELSE 4 END AS depth,
    concat_ws('/', c.name, b.name, a.name, o.name) AS path, list_filter([a.object_id, b.object_id, c.object_id], lambda x: x IS NOT NULL) AS ancestors
  FROM tree o LEFT JOIN tree a ON o.parent_id = a.object_id LEFT JOIN tree b ON a.parent_id = b.object_id LEFT JOIN tree c ON b.parent_id = c.object_id)"""
SNAPSHOT = """prev AS (SELECT p_partkey AS object_id, p_brand AS parent, p_name AS name, sha256(p_type) AS content_hash FROM part WHERE p_partkey % 11 <> 0),
cur AS (SELECT p_partkey AS object_id, CASE WHEN p_partkey % 19 = 0 THEN 'moved' ELSE p_brand END AS parent,
  CASE WHEN p_partkey % 17 = 0 THEN p_name || '2' ELSE p_name END AS name, CASE WHEN p_partkey % 23 = 0 THEN sha256(p_type || '2') ELSE sha256(p_type) END AS content_hash
  FROM part WHERE p_partkey % 13 <> 0)"""
NAMES = r"""names AS (SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS name, regexp_extract(url, '^(.*)/[^/]*$', 1) AS parent FROM pages)"""


def changes(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select("event_id", "user_id", "event_type")
    by_object = W.partitionBy("user_id")
    revision = F.row_number().over(by_object.orderBy("event_id"))
    numbered = e.select(
        (F.col("user_id") % 10).alias("tenant"), F.col("user_id").alias("object_id"), F.row_number().over(W.partitionBy(F.col("user_id") % 10).orderBy("event_id")).cast("long").alias("cursor"),
        revision.cast("long").alias("revision"), F.col("event_id").alias("operation_id"), F.col("event_type").alias("name"),
        (F.max("event_id").over(by_object) == F.col("event_id")).alias("last"), F.sha2(F.col("event_id").cast("string").cast("binary"), 256).alias("blob_hash"),
    )
    mutation = F.when(F.col("revision") == 1, "create").when(F.col("last") & (F.col("name") == "error"), "delete").when(F.col("name") == "purchase", "move").otherwise("update")
    return numbered.withColumn("mutation", mutation).drop("last")


def broken(spark: SparkSession, d: str) -> DataFrame:
    whole = changes(spark, d).where("operation_id % 97 <> 0")
    return whole.unionByName(whole.where("operation_id % 101 = 0"))


def nodes(spark: SparkSession, d: str) -> DataFrame:
    def level(name, key, parent, label, p):
        t = read(spark, d, name)
        above = F.concat(F.lit(parent[0]), F.col(parent[1:])) if parent else F.lit(None).cast("string")
        return t.select(F.concat(F.lit(p), F.col(key)).alias("object_id"), above.alias("parent_id"), label.alias("name"))

    return (
        level("region", "r_regionkey", "", F.col("r_name"), "r")
        .unionByName(level("nation", "n_nationkey", "rn_regionkey", F.col("n_name"), "n"))
        .unionByName(level("customer", "c_custkey", "nc_nationkey", F.col("c_name"), "c"))
        .unionByName(level("orders", "o_orderkey", "co_custkey", F.concat(F.col("o_orderkey"), F.lit(".md")), "o"))
    )


def snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p, k = read(spark, d, "part"), F.col("p_partkey")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    prev = p.where(k % 11 != 0).select(k.alias("object_id"), F.col("p_brand").alias("parent"), F.col("p_name").alias("name"), digest(F.col("p_type")).alias("content_hash"))
    cur = p.where(k % 13 != 0).select(
        k.alias("object_id"), F.when(k % 19 == 0, "moved").otherwise(F.col("p_brand")).alias("parent"), F.when(k % 17 == 0, F.concat("p_name", F.lit("2"))).otherwise(F.col("p_name")).alias("name"),
        F.when(k % 23 == 0, digest(F.concat("p_type", F.lit("2")))).otherwise(digest(F.col("p_type"))).alias("content_hash"),
    )
    return prev, cur


def page_names(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", F.regexp_extract("url", r"([^/]*)$", 1).alias("name"), F.regexp_extract("url", r"^(.*)/[^/]*$", 1).alias("parent"))


def middles(log: DataFrame) -> DataFrame:
    return log.groupBy("tenant").agg(F.floor(F.max("cursor") / 2).cast("long").alias("frontier"))


def inbox(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = broken(spark, d).select("tenant", "cursor", (F.col("operation_id") % 89 != 0).alias("applied"))
    return rows, rows.groupBy("tenant").agg(F.min("cursor").alias("confirmed"))


def arrivals(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "conversations")
    return c.select(F.lit(0).alias("tenant"), F.concat_ws(":", "conv_id", F.floor(F.col("turn") / 2)).alias("operation_id"), F.col("turn").alias("arrival"), F.sha2(F.col("role").cast("binary"), 256).alias("digest"))


QUERIES = {
    "latest_state": lambda s, d: history.latest_state(changes(s, d)),
    "state_as_of": lambda s, d: (lambda c: history.state_as_of(c, middles(c)))(changes(s, d)),
    "change_feed_page": lambda s, d: (lambda c: history.change_feed_page(c, middles(c).withColumnRenamed("frontier", "after")))(changes(s, d)),
    "revision_chain_audit": lambda s, d: history.revision_chain_audit(broken(s, d)),
    "cursor_gap_report": lambda s, d: history.cursor_gap_report(broken(s, d)),
    "contiguous_frontier": lambda s, d: history.contiguous_frontier(*inbox(s, d)),
    "merge_baselines": lambda s, d: (lambda c: history.merge_baselines(c.join(middles(c), "tenant").where("cursor <= frontier"), c))(changes(s, d)),
    "operation_replay_check": lambda s, d: history.operation_replay_check(arrivals(s, d)),
    "monotonic_version_filter": lambda s, d: history.monotonic_version_filter(read(s, d, "events").select("user_id", "event_id", (F.col("event_id") % 7).alias("g"), (F.col("event_id") % 5).alias("r")), "user_id", "g", "r", "event_id"),
    "replica_divergence": lambda s, d: history.replica_divergence(history.latest_state(changes(s, d)), history.latest_state(changes(s, d).where("operation_id % 7 <> 0"))),
    "content_dedupe": lambda s, d: content.content_dedupe(read(s, d, "documents"), "source", "text"),
    "quota_usage": lambda s, d: content.quota_usage(read(s, d, "documents"), "source", "text", 60_000),
    "portable_name_check": lambda s, d: content.portable_name_check(page_names(s, d), "name").drop("parent"),
    "sibling_collisions": lambda s, d: content.sibling_collisions(read(s, d, "pages").select(F.lit("").alias("parent"), F.regexp_extract("url", r"://(?:www\.|m\.|blog\.)?([^./]*)", 1).alias("n"), "page_id").select("parent", F.when(F.col("page_id") % 2 == 0, F.upper("n")).otherwise(F.col("n")).alias("name"))).withColumn("names", F.array_join("names", ",")),
    "snapshot_diff": lambda s, d: content.snapshot_diff(*snapshots(s, d)),
    "route_metrics": lambda s, d: content.route_metrics(read(s, d, "events"), "ts", "event_type", "value", F.col("event_type") == "error", "1 hour"),
    "ancestor_paths": lambda s, d: tree.ancestor_paths(nodes(s, d)).withColumn("ancestors", F.array_join("ancestors", ",")),
    "subtree_sizes": lambda s, d: tree.subtree_sizes(tree.ancestor_paths(nodes(s, d))),
}

MIDDLES = "m AS (SELECT tenant, CAST(floor(max(cursor) / 2) AS BIGINT) AS frontier FROM changes GROUP BY 1)"
SQL = {
    "latest_state": f"WITH {CHANGES} {STATE.format('changes')}",
    "state_as_of": f"WITH {CHANGES}, {MIDDLES}, upto AS (SELECT c.* FROM changes c JOIN m USING (tenant) WHERE cursor <= frontier) {STATE.format('upto')}",
    "change_feed_page": f"""WITH {CHANGES}, {MIDDLES},
p AS (SELECT c.*, row_number() OVER (PARTITION BY tenant ORDER BY cursor) AS k, count(*) OVER (PARTITION BY tenant) AS n FROM changes c JOIN m USING (tenant) WHERE cursor > frontier)
SELECT tenant, object_id, cursor, revision, operation_id, name, mutation, blob_hash, n > 100 AS has_more, max(cursor) OVER (PARTITION BY tenant) AS next_cursor FROM p WHERE k <= 100""",
    "revision_chain_audit": f"""WITH {CHANGES}, {BROKEN},
w AS (SELECT tenant, object_id, revision, mutation, lag(revision) OVER o AS b, lag(mutation) OVER o AS was FROM broken WINDOW o AS (PARTITION BY tenant, object_id ORDER BY revision)),
q AS (SELECT tenant, object_id, revision, CASE WHEN b IS NULL AND revision <> 1 THEN 'starts_late' WHEN b IS NULL AND mutation <> 'create' THEN 'no_create' WHEN b = revision THEN 'repeated'
  WHEN revision > b + 1 THEN 'gap' WHEN was = 'delete' THEN 'after_delete' WHEN b IS NOT NULL AND mutation = 'create' THEN 'created_again' END AS problem FROM w)
SELECT * FROM q WHERE problem IS NOT NULL""",
    "cursor_gap_report": f"""WITH {CHANGES}, {BROKEN}, d AS (SELECT DISTINCT tenant, cursor FROM broken),
w AS (SELECT tenant, cursor, coalesce(lag(cursor) OVER (PARTITION BY tenant ORDER BY cursor), 0) AS b FROM d)
SELECT tenant, b + 1 AS gap_from, cursor - 1 AS gap_to FROM w WHERE cursor > b + 1""",
    "contiguous_frontier": f"""WITH {CHANGES}, {BROKEN}, i AS (SELECT tenant, cursor, bool_or(operation_id % 89 <> 0) AS applied FROM broken GROUP BY 1, 2),
c AS (SELECT tenant, min(cursor) AS confirmed FROM i GROUP BY 1),
w AS (SELECT i.*, confirmed, lag(cursor, 1, confirmed) OVER (PARTITION BY tenant ORDER BY cursor) AS b FROM i JOIN c USING (tenant) WHERE cursor > confirmed),
s AS (SELECT tenant, min(b) AS stop FROM w WHERE NOT applied OR cursor <> b + 1 GROUP BY 1), l AS (SELECT tenant, max(cursor) AS last FROM w GROUP BY 1)
SELECT c.tenant, c.confirmed, coalesce(s.stop, l.last, c.confirmed) AS frontier FROM c LEFT JOIN s USING (tenant) LEFT JOIN l USING (tenant)""",
    "merge_baselines": f"WITH {CHANGES} SELECT tenant, object_id, max(revision) AS revision, arg_max(operation_id, revision) AS operation_id FROM changes GROUP BY 1, 2",
    "operation_replay_check": """WITH a AS (SELECT 0 AS tenant, conv_id || ':' || (turn // 2) AS operation_id, turn AS arrival, sha256(role) AS digest FROM conversations),
f AS (SELECT *, first_value(arrival) OVER w AS fa, first_value(digest) OVER w AS fd FROM a WINDOW w AS (PARTITION BY tenant, operation_id ORDER BY arrival, digest))
SELECT tenant, operation_id, arrival, digest, CASE WHEN arrival = fa AND digest = fd THEN 'first' WHEN digest = fd THEN 'replay' ELSE 'mismatch' END AS outcome FROM f""",
    "monotonic_version_filter": """SELECT user_id, event_id, event_id % 7 AS g, event_id % 5 AS r,
  coalesce((event_id % 7) * 10 + event_id % 5 >= max((event_id % 7) * 10 + event_id % 5) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS accepted FROM events""",
    "replica_divergence": f"""WITH {CHANGES}, part_ AS (SELECT * FROM changes WHERE operation_id % 7 <> 0), a AS ({STATE.format('changes')}), b AS ({STATE.format('part_')})
SELECT * FROM (SELECT coalesce(a.tenant, b.tenant) AS tenant, coalesce(a.object_id, b.object_id) AS object_id, CASE WHEN a.revision IS NULL THEN 'missing_left' WHEN b.revision IS NULL THEN 'missing_right'
  WHEN a.revision <> b.revision THEN 'revision' WHEN a.name <> b.name THEN 'name' WHEN a.blob_hash <> b.blob_hash THEN 'hash' END AS difference
  FROM a FULL JOIN b ON a.tenant = b.tenant AND a.object_id = b.object_id) WHERE difference IS NOT NULL""",
    "content_dedupe": """SELECT sha256(text) AS blob_hash, strlen(any_value(text)) AS size_bytes, count(*) AS n_references, count(DISTINCT source) AS n_tenants,
  strlen(any_value(text)) * (count(*) - 1) AS saved_bytes FROM documents GROUP BY 1""",
    "quota_usage": """SELECT tenant, CAST(sum(b) AS BIGINT) AS used_bytes, count(*) AS n_blobs, CAST(60000 - sum(b) AS BIGINT) AS headroom
FROM (SELECT DISTINCT source AS tenant, sha256(text) AS h, strlen(text) AS b FROM documents) GROUP BY 1""",
    "portable_name_check": rf"""WITH {NAMES} SELECT page_id, name, CASE WHEN coalesce(name, '') = '' THEN 'empty' WHEN name <> nfc_normalize(name) THEN 'not_nfc' WHEN strlen(name) > {content.NAME_BYTES} THEN 'too_long'
  WHEN regexp_matches(name, '{content.FORBIDDEN}') THEN 'forbidden_character' WHEN name LIKE '% ' OR name LIKE '%.' THEN 'trailing_space_or_dot'
  WHEN list_contains([{', '.join(f"'{x}'" for x in content.DEVICES)}], upper(rtrim(string_split(name, '.')[1], ' '))) THEN 'reserved_device' END AS problem FROM names""",
    "sibling_collisions": r"""WITH n AS (SELECT DISTINCT '' AS parent, CASE WHEN page_id % 2 = 0 THEN upper(x) ELSE x END AS name FROM (SELECT page_id, regexp_extract(url, '://(?:www\.|m\.|blog\.)?([^./]*)', 1) AS x FROM pages) WHERE x <> '')
SELECT parent, lower(name) AS name_key, count(*) AS n_names, string_agg(name, ',' ORDER BY name) AS names FROM n GROUP BY 1, 2 HAVING count(*) > 1""",
    "snapshot_diff": f"""WITH {SNAPSHOT}, j AS (SELECT coalesce(p.object_id, c.object_id) AS object_id, p.object_id AS pi, c.object_id AS ci, p.parent AS pp, c.parent AS cp, p.name AS pn, c.name AS cn, p.content_hash AS ph, c.content_hash AS ch FROM prev p FULL JOIN cur c ON p.object_id = c.object_id)
SELECT object_id, 'create' AS mutation FROM j WHERE pi IS NULL UNION ALL SELECT object_id, 'delete' FROM j WHERE ci IS NULL
UNION ALL SELECT object_id, 'move' FROM j WHERE pi = ci AND (pp <> cp OR pn <> cn) UNION ALL SELECT object_id, 'update' FROM j WHERE pi = ci AND ph <> ch""",
    "route_metrics": """SELECT date_trunc('hour', ts) AS window_start, event_type AS route, count(*) AS n_requests, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS n_failed,
  round(avg(value), 4) AS mean_duration, max(value) AS max_duration FROM events GROUP BY 1, 2""",
    "ancestor_paths": f"WITH {TREE}, {PATHS} SELECT object_id, CAST(depth AS BIGINT) AS depth, path, array_to_string(ancestors, ',') AS ancestors, 'ok' AS status FROM paths",
    "subtree_sizes": f"""WITH {TREE}, {PATHS}, a AS (SELECT depth, unnest(ancestors) AS object_id FROM paths), s AS (SELECT object_id, count(*) AS n_below, max(depth) AS deepest FROM a GROUP BY 1)
SELECT s.object_id, n_below, CAST(deepest - p.depth AS BIGINT) AS levels_below FROM s JOIN paths p USING (object_id)""",
}
