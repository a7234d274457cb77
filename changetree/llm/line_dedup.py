"""Operator 2, line dedup [native]: overlapping three-line windows.

Each run of three consecutive non-blank lines is hashed; windows that occur more than once anywhere are
found by one aggregation, and the lines that later occurrences cover are removed. Only the hashes and
places of windows shuffle, pre-aggregated per task, so a window that a third of all documents hold is
no hot group; the texts are joined with the places to remove once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, persisted, table

#: Lines in a window (fixed by the method).
WINDOW = 3
#: What is trimmed from a line before it is compared (ASCII white space).
BLANKS = r"^[\t-\r ]+|[\t-\r ]+$"


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with text_deduped, n_lines and n_removed behind its columns (underscores are added to names
    that docs has already); one row for each row of docs.

    Lines are split at \\n and compared trimmed. Blank lines belong to no window and are never removed;
    a text with fewer than three non-blank lines has no window and stays as it is. Windows are ordered
    by (id, line); every occurrence behind the first is a later one, in the same text too, and all
    lines it covers go. A null id sorts before all others; a null text counts as empty and stays null. Rows that
    repeat both id and text count as one document. An empty table gives an empty result."""
    out_text, n_lines, n_removed = (free_name(docs, c) for c in ("text_deduped", "n_lines", "n_removed"))
    g_id, g_th, g_key, g_lines = (free_name(docs, c) for c in ("g_id", "g_th", "g_key", "g_lines"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    places = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), F.split(text, "\n").alias("lines"))
    trimmed = F.transform("lines", lambda x, i: F.struct(F.regexp_replace(x, BLANKS, "").alias("t"), i.alias("i")))
    places = places.select("id", "th", F.filter(trimmed, lambda x: x["t"] != "").alias("solid")).where(F.size("solid") >= WINDOW)
    # the lists of first, second and third lines side by side
    lines = [F.slice(F.col("solid"), F.lit(k + 1), F.size("solid") - (WINDOW - 1)) for k in range(WINDOW)]
    two = F.zip_with(lines[0], lines[1], lambda x, y: F.struct(F.concat(x["t"], F.lit("\n"), y["t"]).alias("t"), x["i"].alias("i"), y["i"].alias("j")))

    def window(x, y):
        joined = F.concat(x["t"], F.lit("\n"), y["t"])
        return F.struct(F.xxhash64(joined).alias("a"), F.xxhash64(F.lit(1), joined).alias("b"), F.array(x["i"], x["j"], y["i"]).alias("at"))

    windows = places.select("id", "th", F.explode(F.zip_with(two, lines[2], window)).alias("w")).select("id", "th", "w.a", "w.b", "w.at")
    first = persisted(
        windows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", F.col("at")[0].alias("line"))).alias("first")).where("n > 1")
    )
    later = windows.join(first, ["a", "b"]).where(~F.struct("id", F.col("at")[0].alias("line")).eqNullSafe(F.col("first")))
    places = later.select(F.col("id").alias(g_id), F.col("th").alias(g_th), F.explode("at").alias("i"))
    gone = places.groupBy(g_id, g_th).agg(F.sort_array(F.collect_set("i")).alias(g_lines))
    marked = docs.withColumn(g_key, F.xxhash64(text)).join(gone, F.col(id_col).eqNullSafe(F.col(g_id)) & (F.col(g_key) == F.col(g_th)), "left")
    # a flag for each line up to the last one that goes
    steps = F.transform(F.sequence(F.lit(0), F.size(g_lines) - 1), lambda k: F.struct(F.get(g_lines, k).alias("at"), F.coalesce(F.get(g_lines, k - 1), F.lit(-1)).alias("last")))
    flags = F.flatten(F.transform(steps, lambda x: F.concat(F.array_repeat(F.lit(False), x["at"] - x["last"] - 1), F.array(F.lit(True)))))
    kept = F.zip_with(F.split(text, "\n"), flags, lambda line, goes: F.when(~F.coalesce(goes, F.lit(False)), line))  # array_join leaves nulls out
    return marked.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.when(F.col(g_lines).isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n")).alias(out_text),
        F.size(F.split(text, "\n")).cast("long").alias(n_lines),
        F.when(F.col(g_lines).isNull(), F.lit(0)).otherwise(F.size(g_lines)).cast("long").alias(n_removed),
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text_deduped", F.lit("")).cast("binary"), 256).alias("text_sha256"))


OP2_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS i FROM documents),
s AS (SELECT doc_id, i, regexp_replace(line, '^[\t-\r ]+|[\t-\r ]+$', '', 'g') AS t FROM l),
w AS (
  SELECT doc_id, i, lead(i, 1) OVER o AS i1, lead(i, 2) OVER o AS i2, t || chr(10) || lead(t, 1) OVER o || chr(10) || lead(t, 2) OVER o AS win
  FROM s WHERE t <> '' WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT *, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS k FROM w WHERE win IS NOT NULL),
gone AS (SELECT DISTINCT doc_id, unnest([i, i1, i2]) AS i FROM r WHERE k > 1),
k AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.i) AS t FROM l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.i = l.i WHERE g.i IS NULL GROUP BY 1),
n AS (SELECT l.doc_id, count(*) AS n_lines, count(g.i) AS n_removed FROM l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.i = l.i GROUP BY 1)
SELECT n.doc_id, n_lines, n_removed, sha256(coalesce(k.t, '')) AS text_sha256 FROM n LEFT JOIN k ON k.doc_id = n.doc_id
"""
