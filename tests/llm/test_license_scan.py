from pathlib import Path

import duckdb

from changetree.llm import license_scan as ls

FOLDER = Path(ls.__file__).parent / "licenses"


def test_whole_texts_and_headings(spark):
    text = {f.stem: f.read_text() for f in FOLDER.glob("*.txt")}
    known = dict(ls.KNOWN)
    mit = known["MIT"].removeprefix("MIT License\n\n")
    isc = known["ISC"].removeprefix("ISC License\n\n")
    apache = text["Apache-2.0"]
    three = text["BSD-3-Clause"][text["BSD-3-Clause"].index("Redistribution and") :]
    cases = [(name, t) for name, t in text.items()] + [
        ("MIT", mit), ("MIT", "The MIT License (MIT)\n\nCopyright (c) 2020 Jo\n\n" + mit), ("MIT", known["MIT"]),
        ("ISC", isc), ("ISC", "The ISC License\n\nCopyright (c) 2020 Jo\n\n" + isc), ("0BSD", "Zero-Clause BSD\n\n" + known["0BSD"]),
        ("Apache-2.0", apache[: apache.index("   APPENDIX")]), ("Apache-2.0", apache.replace("[yyyy] [name of copyright owner]", "2020 Jo")),
        ("GPL-3.0", text["GPL-3.0"].split("            How to Apply")[0]),
        ("BSD-3-Clause", "BSD 3-Clause License\n\nCopyright (c) 2020, Jo\n\n" + three),
        ("BSD-3-Clause", three.replace("1. R", "* R").replace("2. R", "* R").replace("3. N", "* N").replace("COPYRIGHT\nHOLDER OR", "COPYRIGHT OWNER OR")),
        (None, mit[:-60]), (None, None), (None, ""),
    ]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(cases)], "doc_id int, text string")
    got = {r.doc_id: r.license_id for r in ls.license_scan(docs, ls.known_licenses(spark)).collect()}
    assert got == {i: name for i, (name, _) in enumerate(cases)}


def test_query_equals_sql(spark, sf):
    want = duckdb.connect().execute(ls.OP6_SQL.replace("FROM documents", f"FROM '{sf}/documents.parquet'")).fetchall()
    assert sorted(map(tuple, ls.op6_license_scan(spark, sf).collect())) == sorted(want)


def test_sql_knows_every_text(spark, tmp_path):
    """Every known text in every form, changed in case, punctuation and copyright lines, and texts that are none, by the operator and by its SQL."""
    texts = [t for _, t in [*ls.KNOWN, *ls.full_texts()]]
    docs = [*texts, *[t.upper().replace("\n", "\r\n") for t in texts], *["Copyright (c) 2021 Jo Doe\n\n" + t for t in texts], *[t + " more" for t in texts], "", None, "!!", texts[0], texts[0] * 50]
    spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, ls.op6_license_scan(spark, str(tmp_path)).collect()))
    want = duckdb.connect().execute(ls.OP6_SQL.replace("FROM documents", f"FROM '{tmp_path}/documents.parquet/*.parquet'")).fetchall()
    assert got == sorted(want)
    assert all(x[2] for x in got[: 3 * len(texts)]) and {x[2] for x in got[3 * len(texts) : 4 * len(texts)]} == {None}
