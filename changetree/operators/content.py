"""Operators over content, names and snapshots."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import collision_key, in_normal_form

# Device names that no file may have, and characters that no name may hold.
DEVICES = ["CON", "PRN", "AUX", "NUL", "CONIN$", "CONOUT$", *(f"{d}{n}" for d in ("COM", "LPT") for n in (*range(1, 10), "¹", "²", "³"))]
FORBIDDEN = r'[\x00-\x1f<>:"/\\|?*]'
NAME_BYTES = 180


def content_dedupe(docs: DataFrame, tenant: str, content: str) -> DataFrame:
    """One row for each content hash: blob_hash, size_bytes, n_references, n_tenants, saved_bytes (what further references of it
    don't store)."""
    sized = docs.select(F.col(tenant).alias("tenant"), F.sha2(F.col(content).cast("binary"), 256).alias("blob_hash"), F.octet_length(content).cast("long").alias("size_bytes"))
    held = sized.groupBy("blob_hash", "tenant").agg(F.first("size_bytes").alias("size_bytes"), F.count(F.lit(1)).alias("n"))
    return held.groupBy("blob_hash").agg(F.first("size_bytes").alias("size_bytes"), F.sum("n").alias("n_references"), F.count(F.lit(1)).alias("n_tenants")).withColumn(
        "saved_bytes", F.col("size_bytes") * (F.col("n_references") - 1)
    )


def quota_usage(docs: DataFrame, tenant: str, content: str, limit: int) -> DataFrame:
    """Each tenant's bytes, every hash counted once, and what the limit leaves (negative when over it)."""
    held = docs.select(F.col(tenant).alias("tenant"), F.sha2(F.col(content).cast("binary"), 256).alias("h"), F.octet_length(content).cast("long").alias("b")).groupBy("tenant", "h").agg(F.first("b").alias("b"))
    return held.groupBy("tenant").agg(F.sum("b").alias("used_bytes"), F.count(F.lit(1)).alias("n_blobs")).withColumn("headroom", F.lit(limit) - F.col("used_bytes"))


def name_problem(name: Column) -> Column:
    """The first rule of portable names that a name breaks, null if none."""
    stem = F.upper(F.rtrim(F.regexp_extract(name, r"^([^.]*)", 1)))
    return (
        F.when(F.coalesce(name, F.lit("")) == "", "empty")
        .when(~F.is_valid_utf8(name), "invalid_utf8")
        .when(~in_normal_form(name), "not_nfc")
        .when(F.octet_length(name) > NAME_BYTES, "too_long")
        .when(name.rlike(FORBIDDEN), "forbidden_character")
        .when(name.rlike(r"[. ]$"), "trailing_space_or_dot")
        .when(stem.isin(DEVICES), "reserved_device")
    )


def portable_name_check(names: DataFrame, name: str) -> DataFrame:
    """names with `problem`, the first rule that a name breaks."""
    return names.withColumn("problem", name_problem(F.col(name)))


def sibling_collisions(objects: DataFrame) -> DataFrame:
    """Groups of two or more different names under one parent with one collision key: parent, name_key,
    n_names and the names in order. A group holds distinct names only; objects are the active ones."""
    distinct = objects.select("parent", collision_key(F.col("name")).alias("name_key"), "name").where(name_problem(F.col("name")).isNull()).distinct()
    return distinct.groupBy("parent", "name_key").agg(F.count(F.lit(1)).alias("n_names"), F.sort_array(F.collect_list("name")).alias("names")).where("n_names > 1")


def snapshot_diff(prev: DataFrame, cur: DataFrame) -> DataFrame:
    """Mutations (object_id, mutation) from one listing (object_id, parent, name, content_hash) to the next: create, delete,
    move (parent or name differs), update (hash differs); one object may both move and be updated."""
    x, y = (s.select("object_id", F.lit(True).alias(f"in_{k}"), *[F.col(c).alias(f"{c}_{k}") for c in ("parent", "name", "content_hash")]) for s, k in ((prev, "p"), (cur, "c")))
    both = x.join(y, "object_id", "full")
    differs = lambda c: ~F.col(f"{c}_p").eqNullSafe(F.col(f"{c}_c"))
    kept = F.col("in_p").isNotNull() & F.col("in_c").isNotNull()
    mutations = F.array_compact(
        F.array(
            F.when(F.col("in_p").isNull(), "create"),
            F.when(F.col("in_c").isNull(), "delete"),
            F.when(kept & (differs("parent") | differs("name")), "move"),
            F.when(kept & differs("content_hash"), "update"),
        )
    )
    return both.select("object_id", F.explode(mutations).alias("mutation"))


def route_metrics(requests: DataFrame, ts: str, route: str, duration: str, failed: Column, window: str = "1 minute") -> DataFrame:
    """Requests, failures and mean and largest duration for each route and time window."""
    return (
        requests.groupBy(F.window(ts, window).alias("w"), F.col(route).alias("route"))
        .agg(F.count(F.lit(1)).alias("n_requests"), F.sum(failed.cast("long")).alias("n_failed"), F.round(F.avg(duration), 4).alias("mean_duration"), F.max(duration).alias("max_duration"))
        .select(F.col("w.start").alias("window_start"), "route", "n_requests", "n_failed", "mean_duration", "max_duration")
    )


def known_route(path: Column, routes: tuple[str, ...]) -> Column:
    """The template of `routes` that a path fits, the first of several, else `unknown`. {word} in a template stands for one part of a path, which isn't empty;
    all else is taken as it is. A null path is unknown."""
    out = F.lit(None).cast("string")
    for route in routes:
        pattern = "".join("[^/]+" if part.startswith("{") else re.escape(part) for part in re.split(r"(\{\w+\})", route))
        fits = path.rlike(rf"\A{pattern}\z") if "{" in route else path == route
        out = F.coalesce(out, F.when(fits, F.lit(route)))
    return F.coalesce(out, F.lit("unknown"))


def route_report(requests: DataFrame, routes: tuple[str, ...], ts: str, path: str, duration_ms: str, status: str, window: str = "1 minute") -> DataFrame:
    """For each route and time window: requests, failures (status 500 and more), the error rate, and the median, 95th and 99th percentile of whole milliseconds
    (interpolated between neighbours). Paths are folded to their templates, so that an id makes no group.

    Percentiles are exact: tasks send how often each millisecond came, at most as many numbers as there are different
    durations. Nulls in duration don't count, nor do nulls in status as failures; rows without ts are left out."""
    share = [0.5, 0.95, 0.99]
    sums = requests.groupBy(F.window(ts, window).alias("w"), known_route(F.col(path), routes).alias("route")).agg(
        F.count(F.lit(1)).alias("n_requests"),
        F.count(F.when(F.col(status) >= 500, 1)).alias("n_failed"),
        F.percentile(F.col(duration_ms).cast("long"), share).alias("p"),
    )
    return sums.select(
        F.col("w.start").alias("window_start"), "route", "n_requests", "n_failed", F.round(F.col("n_failed") / F.col("n_requests"), 6).alias("error_rate"),
        *[F.round(F.col("p")[i], 3).alias(f"p{int(100 * x)}") for i, x in enumerate(share)],
    )


def logical_bytes(docs: DataFrame, tenant: str, text: str) -> DataFrame:
    """(tenant, logical_bytes, stored_bytes, n_references, n_blobs): what a tenant's references add up to, and what its distinct contents take. Each task sends
    one row for each content of a tenant it holds, so a content that is referred to very often is no hot group. Null texts are no content."""
    each = docs.where(F.col(text).isNotNull()).groupBy(F.col(tenant).alias("tenant"), F.sha2(F.col(text).cast("binary"), 256).alias("h"), F.octet_length(text).cast("long").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("tenant").agg(
        F.sum(F.col("b") * F.col("n")).alias("logical_bytes"), F.sum("b").alias("stored_bytes"), F.sum("n").alias("n_references"), F.count(F.lit(1)).alias("n_blobs")
    )


#: Bytes of a path.
PATH_BYTES = 768


def path_policy_check(paths: DataFrame, path: str, reserved: tuple[str, ...] = ()) -> DataFrame:
    """paths with `problem`, the first rule that a path breaks, and `part`, the place of the component it lies in (null where it is the whole path's). reserved
    holds names that no path may begin with; they are compared by collision key."""
    p = F.col(path)
    parts = paths.select(p.alias("p_path")).distinct().select("p_path", F.posexplode(F.split("p_path", "/")).alias("part", "name"))
    first = F.col("part") == 0
    roots = F.coalesce(collision_key(F.when(first, F.col("name"))).isin(*[r.casefold() for r in reserved]), F.lit(False)) if reserved else F.lit(False)
    part = F.when(F.col("name").isin("", ".", ".."), "empty_or_dots").otherwise(F.coalesce(name_problem(F.col("name")), F.when(roots, "reserved_root")))
    bad = parts.withColumn("p_problem", part).where("p_problem IS NOT NULL").groupBy("p_path").agg(F.min(F.struct("part", "p_problem")).alias("b"))
    whole = F.when(F.coalesce(p, F.lit("")) == "", "empty").when(F.octet_length(p) > PATH_BYTES, "too_long").when(p.startswith("/"), "leading_slash")
    joined = paths.join(bad, p == F.col("p_path"), "left")
    return joined.select(*paths.columns, F.coalesce(whole, F.col("b.p_problem")).alias("problem"), F.when(whole.isNull(), F.col("b.part")).alias("part"))


def tag_index(docs: DataFrame) -> DataFrame:
    """docs (doc_order, doc_id, tags) as tag_key, the name it is first shown by in document order, and the number of documents."""
    tags = docs.select("doc_order", "doc_id", F.posexplode("tags").alias("at", "tag")).withColumn("tag_key", collision_key(F.col("tag")))
    return tags.groupBy("tag_key").agg(F.min_by("tag", F.struct("doc_order", "doc_id", "at")).alias("tag"), F.countDistinct("doc_id").alias("n_docs"))


LINK = r"""(?is)<a\s[^>]*?href\s*=\s*["']([^"']*)["']"""
BARRED = r"(?i)<(script|style|iframe|object|embed|form|svg|base|meta)[\s>/]"
HANDLER = r"(?i)\son[a-z]+\s*="


def link_safety_audit(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """For each page its links, those that are refused (neither #... nor absolute with scheme http, https or mailto; relative ones are refused too), and its
    barred elements and event handlers."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    links = F.regexp_extract_all(html, F.lit(LINK), 1)
    refused = F.filter(links, lambda x: ~x.rlike(r"(?i)^(#|https?:|mailto:)"))
    count = lambda pattern: F.regexp_count(html, F.lit(pattern)).cast("long")
    return pages.select(id_col, F.size(links).cast("long").alias("n_links"), F.size(refused).cast("long").alias("n_refused"), count(BARRED).alias("n_barred"), count(HANDLER).alias("n_handlers"))


def file_inventory(spark, root: str, note: str = ".md") -> DataFrame:
    """Notes below a folder: path from there, size in bytes, content_hash, modified. Each file is read by one task. The reader leaves empty files out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{note}").load(root)
    path = F.regexp_replace("path", r"^[a-z]+:/+", "/")
    cut = F.length(F.lit("/" + root.split(":")[-1].strip("/") + "/"))
    return files.select(F.substring(path, cut + 1, F.length(path)).alias("path"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("content_hash"), F.col("modificationTime").alias("modified"))
