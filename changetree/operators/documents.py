"""Operators over documents with YAML front matter. Documents without any are told apart in the JVM; the others go through Python in
Arrow batches, each by itself."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import front_matter as fm

BLOCK = "meta"
EXTRACTED = "has_front_matter boolean, has_block boolean, note_id string, schema int, tags array<string>, body string, problem string"
PATCHED = "text string, note_id string, changed boolean, problem string"


def _extracted(block: str):
    @F.pandas_udf(EXTRACTED)
    def run(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            try:
                d = fm.read(text, block)
                out.append((d.has_front_matter, d.has_block, d.note_id, d.schema, d.tags, d.body, None))
            except fm.Unfit as e:
                out.append((False, False, None, None, None, None, str(e)))
        return pd.DataFrame(out, columns=[c.split()[0] for c in EXTRACTED.split(", ")]).astype({"schema": "Int32"})

    return run


def front_matter_extract(docs: DataFrame, text: str = "text", block: str = BLOCK) -> DataFrame:
    """docs with has_front_matter, has_block, note_id, schema, tags, body and problem instead of the text; a null text stays null.

    Front matter lies between --- on the first line and the next --- line. problem names the first rule that it breaks (unclosed, invalid_yaml,
    invalid_root, duplicate_key at any depth, invalid_block, missing_schema, unsupported_schema, missing_id, invalid_id,
    invalid_tags); then the rest is false or null."""
    t = F.col(f"`{text}`")
    begins = t.startswith("---\n") | t.startswith("---\r\n")
    plain = F.struct(
        F.lit(False).alias("has_front_matter"), F.lit(False).alias("has_block"), F.lit(None).cast("string").alias("note_id"), F.lit(None).cast("int").alias("schema"),
        F.array().cast("array<string>").alias("tags"), t.alias("body"), F.lit(None).cast("string").alias("problem"),
    )
    kept = [F.col(f"`{c}`") for c in docs.columns if c != text]
    without = docs.where(~begins).select(*kept, plain.alias("front"))
    with_ = docs.where(begins).select(*kept, _extracted(block)(t).alias("front"))
    empty = docs.where(t.isNull()).select(*kept, F.lit(None).cast(with_.schema["front"].dataType).alias("front"))
    return without.unionByName(with_).unionByName(empty).select(*kept, "front.*")


def _patched(rows: DataFrame, kept: list[str], patch: Callable[[pd.Series], tuple[str, str]], needs: list[str]) -> DataFrame:
    """kept columns of rows with PATCHED, from patch(row of the needed columns) -> (text, id); a row that can't be patched keeps its text."""

    @F.pandas_udf(PATCHED)
    def run(args: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in args.itertuples(index=False):
            if row.text is None:
                out.append((None, None, False, "no_text"))
                continue
            try:
                text, note_id = patch(row)
                out.append((text, note_id, text != row.text, None))
            except fm.Unfit as e:
                out.append((row.text, None, False, str(e)))
        return pd.DataFrame(out, columns=["text", "note_id", "changed", "problem"])

    done = rows.withColumn("patched", run(F.struct(*needs)))
    return done.select(*[F.col(f"`{c}`") for c in kept], "patched.*")


def id_of(path: Column) -> Column:
    """An id of RFC 4122's form made of a hash of the path, so that a repeated run gives the same one."""
    h = F.sha2(path.cast("binary"), 256)
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-a"), part(18, 3), F.lit("-"), part(21, 12))


def assign_document_ids(docs: DataFrame, block: str = BLOCK) -> DataFrame:
    """docs (path, text) as path, text, note_id, changed and problem: documents without an identity block get one, valid ones stay byte for byte, and
    invalid ones are reported and stay, too."""
    rows = docs.select("path", "text", id_of(F.col("path")).alias("candidate"))
    return _patched(rows, ["path"], lambda r: fm.with_identity(r.text, r.candidate, block), ["text", "candidate"])


def rewrite_front_matter(docs: DataFrame, edits: DataFrame, mode: str, block: str = BLOCK) -> DataFrame:
    """docs (path, text) with one of edits for each, by path: in mode `rekey` (path, expected_id, new_id), in mode `replace` (path,
    expected_id, new_body, new_tags). The id must be the expected one. Gives path, text, note_id, changed and problem for each edit; one whose
    document isn't there has problem no_text."""
    if mode not in ("rekey", "replace"):
        raise ValueError(f"no such mode: {mode}")
    rows = edits.join(docs.select("path", "text"), "path", "left")
    if mode == "rekey":
        return _patched(rows, ["path"], lambda r: (fm.with_new_id(r.text, r.expected_id, r.new_id, block), r.new_id), ["text", "expected_id", "new_id"])
    patch = lambda r: (fm.with_body_and_tags(r.text, r.expected_id, r.new_body, list(r.new_tags if r.new_tags is not None else ()), block), r.expected_id)
    return _patched(rows, ["path"], patch, ["text", "expected_id", "new_body", "new_tags"])


def conflict_copies(docs: DataFrame, conflicts: DataFrame, block: str = BLOCK) -> DataFrame:
    """For each of conflicts (path, expected_id, new_id, operation_id, reason, original_target, base_revision, canonical_revision) a copy of its document of docs (path,
    text) under the new id, with a block `conflict` that says where it comes from; body, tags and unknown keys stay."""
    origin = ["operation_id", "reason", "original_target", "base_revision", "canonical_revision"]
    rows = conflicts.join(docs.select("path", "text"), "path", "left")
    rows = rows.select("path", "text", "expected_id", "new_id", *origin[:3], *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in origin[3:]))

    def patch(r):
        given = {k: getattr(r, k) for k in origin}
        return fm.as_conflict_copy(r.text, r.expected_id, r.new_id, given, block), r.new_id

    return _patched(rows, ["path"], patch, ["text", "expected_id", "new_id", *origin])
