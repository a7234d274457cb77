"""The corpus operators against SQL, the tokenizer library or brute force, and on rows that break things: nulls, empty and very
long texts, ties, repeats, empty tables and columns whose names clash."""

import itertools
import random
import time
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from changetree.llm import decontaminate, exact_dedup, html_extract, license_scan, line_dedup, packing, quality, registry, token_counts, url_filter

ODD = ["", " ", "\n\n", "a", "<|endoftext|>x<|startoftext|>", "İstanbul ΣΑΣ", "éa Å", "x\x1cy", "'s 'LL don't", "1234½", "\U0001f44d\U0001f3fd x"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(token_counts.default_tokenizer())


def within(seconds, run):
    began = time.time()
    out = run()
    assert time.time() - began < seconds
    return out


@pytest.mark.parametrize("name", registry.SQL)
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(registry.SQL[name])
    columns = [c[0] for c in want.description]
    got = registry.QUERIES[name](spark, sf).select(*columns).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want.fetchall(), key=repr)


def clashing(spark, rows, schema, names):
    return spark.createDataFrame([(*r, *(f"own {c}" for c in names)) for r in rows], schema + "".join(f", {c} string" for c in names))


CLASHES = {
    "line_dedup": (line_dedup.line_dedup, ["g_id", "g_th", "g_key", "g_lines", "id", "th", "lines", "solid", "text_deduped"]),
    "exact_dedup": (exact_dedup.exact_dedup, ["g_sha", "g_keep", "g_size", "kept", "maybe_repeated", "h"]),
    "license_scan": (lambda d: license_scan.license_scan(d, license_scan.known_licenses(d.sparkSession)), ["k_sha", "k_id", "license_id"]),
    "token_counts": (lambda d: token_counts.token_counts(d, token_counts.default_tokenizer()), ["n_bytes", "n_tokens", "over_limit"]),
}


@pytest.mark.parametrize("name", CLASHES)
def test_columns_of_clashing_names_are_kept(spark, name):
    run, names = CLASHES[name]
    rows = [(1, "a\nb\nc"), (2, "a\nb\nc"), (None, None), (2, "")]
    out = run(clashing(spark, rows, "doc_id long, text string", names))
    assert out.columns[: 2 + len(names)] == ["doc_id", "text", *names]
    assert sorted((tuple(r)[: 2 + len(names)] for r in out.collect()), key=repr) == sorted(((*r, *(f"own {c}" for c in names)) for r in rows), key=repr)
    assert run(clashing(spark, [], "doc_id long, text string", names)).collect() == []


def test_line_dedup(spark, docs):
    rows = [(1, "a\nb\nc\nx\na\nb\nc"), (2, " a\nb\n\nc\nd"), (3, None), (4, "a\nb"), (5, "q\nr\ns\nt"), (5, "q\nr\ns\nt"), (None, "z\nr\ns\nt")]
    got = {(r.doc_id, r.text): (r.text_deduped, r.n_lines, r.n_removed) for r in line_dedup.line_dedup(docs(rows, ("g_id",))).collect()}
    assert got[rows[0]] == ("a\nb\nc\nx", 7, 3) and got[rows[1]] == ("\nd", 5, 3) and got[rows[2]] == (None, 1, 0) and got[rows[3]] == ("a\nb", 2, 0)
    assert got[rows[6]] == ("z\nr\ns\nt", 4, 0) and got[rows[4]] == ("q", 4, 3)  # the null id sorts first


def test_line_dedup_of_long_texts(spark, docs):
    lines = [f"line {k}" for k in range(200_000)]
    text = "\n".join(lines)
    rows = within(60, lambda: line_dedup.line_dedup(docs([(1, text), (2, "new\n" + text + "\nend")], ("x",))).select("doc_id", "text_deduped", "n_removed").collect())
    assert {r.doc_id: (r.text_deduped, r.n_removed) for r in rows} == {1: (text, 0), 2: ("new\nend", 200_000)}


def test_exact_dedup(spark, docs):
    rows = [(5, "a  b"), (3, "a\tb"), (9, "a b "), (None, "a b"), (7, None), (8, ""), (3, "a\tb"), (4, "A b")]
    got = [(r.doc_id, r.text, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(docs(rows, ("x",))).collect()]
    assert sorted(got, key=repr) == sorted([(5, "a  b", 3, 4, False), (3, "a\tb", 3, 4, True), (9, "a b ", 9, 1, True), (None, "a b", 3, 4, False), (7, None, 7, 2, True), (8, "", 7, 2, False), (3, "a\tb", 3, 4, True), (4, "A b", 4, 1, True)], key=repr)
    assert sorted((r.doc_id for r in exact_dedup.keep_first(docs(rows)).collect()), key=repr) == [3, 4, 7, 9]
    few = exact_dedup.exact_dedup(docs([(k, str(k % 700)) for k in range(2000)]), most_bits=64, task_hashes=100, task_bits=256)  # full filters
    assert all(r.keep_id == r.doc_id % 700 for r in few.collect())


def page(main, before="", after=""):
    return f"<html><head><title>T</title></head><body><nav><a href='/'>Home</a></nav>{before}<article class='post'>{main}</article>{after}<footer>Imprint</footer></body></html>"


def test_html_extract(spark):
    long = "This is a sentence that is long enough to count as a paragraph of the article, and it goes on for a while. "
    rows = [
        (1, "http://h/a", page(f"<h1 id='related'>Caf&eacute; &amp; more</h1><p>{long}<span class='share'>Share!</span>Good<b> bold</b> <script>x()</script>end</p>")),
        (2, "http://h/b", page(f"<p>{long}</p><ul><li>one<li>two</ul>", after="<div class='comments'><p>First!</p></div>")),
        (3, None, None), (4, "x", ""), (5, "http://other/", "no markup & none <"), (6, "http://h/c", page("<p>x</p>", before="<div class='cookie-notice'>We use cookies</div>")),
    ]
    df = spark.createDataFrame([(*r, "mine", "mine", "mine") for r in rows], "page_id long, url string, html string, w_host string, w_key string, n_chars string")
    out = html_extract.html_extract(df)
    assert out.columns == ["page_id", "url", "html", "w_host", "w_key", "n_chars", "text", "n_chars_"]
    got = {r.page_id: r.text for r in out.collect()}
    assert got == {
        1: f"Café & more\n\n{long}Good bold end", 2: f"{long.strip()}\n\none\n\ntwo", 3: "", 4: "", 5: "no markup & none <", 6: "x",
    }
    assert all(r.w_host == r.w_key == r.n_chars == "mine" and r.n_chars_ == len(r.text) for r in out.collect())
    assert html_extract.html_extract(df.limit(0)).collect() == []


@pytest.mark.parametrize("broken", ['<a href="x ' * 100_000, "<div class='a'>t" * 50_000, '<a href="u">x' * 80_000, "<div>" * 5000 + "</x>" * 200_000, "<" * 500_000, '<p a="' * 170_000 + ">"])
def test_broken_pages_take_linear_time(broken):
    within(10, lambda: html_extract.extract(broken, html_extract.vote(broken)[0]))


def test_decontaminate_equals_brute_force(spark, docs):
    r = random.Random(4)
    word = lambda: r.choice("abcdefgh") + str(r.randrange(60))
    items = [(k, " ".join(word() for _ in range(r.randrange(7, 28)))) for k in range(25)] + [(30, "the same"), (31, None), (32, ""), (33, "one two three")]
    rows = []
    for k in range(120):
        words = [word() for _ in range(r.randrange(0, 80))]
        for _ in range(r.randrange(3)):
            item = r.choice(items[:25])[1].split()
            for _ in range(r.randrange(5)):
                item[r.randrange(len(item))] = word()
            at = r.randrange(len(words) + 1)
            words[at:at] = item
        rows.append((k, " ".join(words)))
    rows += [(200, "x The SAME y"), (201, None), (202, "one two four"), (203, "one two three")]
    got = {x.doc_id: (x.contaminated, x.n_items, x["item"]) for x in decontaminate.decontaminate(docs(rows, ("hit",)), spark.createDataFrame(items, "item_id long, text string"), most_seeds=400).collect()}
    for k, text in rows:
        words, found = (text or "").lower().split(), []
        for i, item in items:
            item = (item or "").lower().split()
            best = max((sum(a == b for a, b in zip(item[max(0, -s) :], words[max(0, s) :])) for s in range(-len(item) + 1, len(words))), default=0) if item else 0
            if item and best >= 0.8 * len(item):
                found.append((-best / len(item), i))
        assert got[k] == (bool(found), len(found), min(found)[1] if found else None), k
    empty = spark.createDataFrame([], "item_id long, text string")
    assert [x.contaminated for x in decontaminate.decontaminate(docs(rows[:2]), empty).collect()] == [False, False]


def test_decontaminate_finds_every_substitution_in_short_items(spark, docs):
    """All ways to change a fifth of the words of items of 4 to 12 words; one change more isn't contaminated."""
    items = [(n, " ".join(f"i{n}w{k}" for k in range(n))) for n in range(4, 13)]
    rows = []
    for n, item in items:
        for m in (n // 5, n // 5 + 1):
            for at in itertools.combinations(range(n), m):
                rows.append((len(rows), " ".join(["before", *("x" if k in at else w for k, w in enumerate(item.split())), "behind"]), m == n // 5))
    got = decontaminate.decontaminate(docs([r[:2] for r in rows]), spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id: r.contaminated for r in got.collect()} == {i: hit for i, _, hit in rows}


def test_decontaminate_repeated_rows_empty_documents_and_long_texts(spark, docs):
    items = spark.createDataFrame([(1, "one two three four five six seven eight")], "item_id long, text string")
    far = "filler " * 60_000 + "one two three four five six seven eight " + "more " * 60_000
    got = decontaminate.decontaminate(docs([(1, far), (1, far), (None, far), (2, "filler")]), items).collect()
    assert [r.contaminated for r in got] == [True, True, True, False]
    assert decontaminate.decontaminate(docs([]), items).collect() == []


def test_decontaminate_repeated_words():
    block = decontaminate.Block([(k, next(decontaminate.lowered(["spam " * 20 + f"w{k}"]))) for k in range(20)])
    best = within(10, lambda: block.overlaps(next(decontaminate.lowered(["spam " * 8000]))))
    assert {n for n, _ in best.values()} == {20}


def test_license_scan(spark):
    mit, apache = dict(license_scan.KNOWN)["MIT"], next(t for n, t in license_scan.full_texts() if n == "Apache-2.0")
    texts = [mit, mit.upper().replace("MIT LICENSE", "MIT Licence"), "# Copyright (c) 2020 Someone\n" + "\n".join(f"#  {x}" for x in mit.split("\n")), apache, mit + " and more", None, "", "licence licence licence"]
    out = license_scan.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), license_scan.known_licenses(spark)).orderBy("doc_id").collect()
    assert [r.license_id for r in out] == ["MIT", "MIT", "MIT", "Apache-2.0", None, None, None, None]
    form = spark.createDataFrame([(texts[-1],)], "t string").select(license_scan.canonical(F.col("t"))).first()[0]
    assert form == "license license license"


def strings():
    r, pool = random.Random(3), "aAbé́̇İσΣςKk \n\t\x1c'sStT<|endoftext|>19½!?.ﬁ 中文"
    return [*ODD, *("".join(r.choice(pool) for _ in range(r.randrange(1, 14))) for _ in range(3000))]


def test_token_counts_equal_the_library(spark, docs, texts, library, monkeypatch):
    some = [*texts.values()][:60]
    rows = [*enumerate([*strings(), *some, "word " * 30_000, "x" * 70_000]), (None, None)]
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(docs(rows), token_counts.default_tokenizer()).collect()), key=repr)
    n = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    assert got == sorted(((i, len((t or "").encode()), n(t), n(t) > 2048) for i, t in rows), key=repr)
    for chunk in (1, 7, 64):  # maps of small chunks compose to the same counts
        monkeypatch.setattr(token_counts, "CHUNK", chunk)
        counter = token_counts.counter(token_counts.default_tokenizer())
        assert [counter.tokens(t) for t in [*strings()[:400], *some[:5]]] == [n(t) for t in [*strings()[:400], *some[:5]]]


def test_packing(spark, docs, texts, library):
    rows = [*enumerate([*ODD, *texts.values(), "word " * 30_000]), (None, None), (7, "twice"), (7, "twice")]
    pieces = packing.pack(docs(rows), token_counts.default_tokenizer()).collect()
    want = {}
    for i, t in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for k in range(0, len(ids), 4096):
            cut = ids[k : k + 4096]
            key = (i, k // 4096, k, len(cut), zlib.crc32(cut.tobytes()))
            want[key] = want.get(key, 0) + 1
    got, places = {}, {}
    for r in pieces:
        key = (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
        got[key] = got.get(key, 0) + 1
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert got == want
    for x in places.values():  # no gaps, no overlaps, nothing too long
        end = 0
        for offset, length in sorted(x):
            assert offset == end
            end += length
        assert end <= 4096
    assert len(places) <= 1.01 * -(-sum(r.length for r in pieces) // 4096) + 1
    assert packing.pack(docs([]), token_counts.default_tokenizer()).collect() == []


@pytest.mark.parametrize("seed", range(6))
def test_plans_are_near_the_lower_bound(seed):
    r = random.Random(seed)
    counts = {}
    for _ in range(20_000):
        n = min(4096, int(r.lognormvariate(r.choice((4, 6, 7)), 1)) + 1)
        counts[n] = counts.get(n, 0) + 1
    plan = packing.best_plan(counts, 4096)
    filled, seen = {}, {}
    for s, _, count, first, each, offset in plan.runs:
        seen[s] = seen.get(s, 0) + count
        for k in range(count):
            filled.setdefault(first + k // each, []).append((offset + k % each * s, s))
    assert seen == counts and len(filled) == plan.sequences
    assert all(max(o + s for o, s in x) == sum(s for _, s in x) <= 4096 for x in filled.values())
    assert plan.sequences <= 1.01 * sum(n * c for n, c in counts.items()) / 4096 + 1


def test_quality_is_learnt_and_independent_of_row_order(spark):
    folder = "/root/testdata/sf0.01"
    d, known = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    scored = quality.quality_scores(d, known).select("doc_id", "score", "held_out", "predicted")
    other = quality.quality_scores(d.orderBy(F.xxhash64("doc_id")).repartition(13), known.orderBy(F.rand(3))).select("doc_id", F.col("score").alias("again"))
    assert scored.join(other, "doc_id").agg(F.max(F.abs(F.col("score") - F.col("again")))).first()[0] < 1e-6
    rows = scored.where("held_out").join(known.groupBy("doc_id").agg(F.max("quality").alias("quality")), "doc_id").collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.95 * len(rows) and len(rows) > 50


def test_prior_is_estimated_from_positives_and_unlabelled(spark):
    """With trusted positives only, the class prior comes from where positives and unlabelled texts lie."""
    rng = np.random.default_rng(1)
    good = rng.normal(2, 1, 4000)
    for share in (0.2, 0.5, 0.8):
        every = np.concatenate((rng.normal(2, 1, int(20_000 * share)), rng.normal(-2, 1, int(20_000 * (1 - share)))))
        histograms = [quality.histogram(x) for x in (good, every)]
        assert abs(quality.estimated_prior(*histograms) - share) < 0.06


def test_weights_minimise_the_risk():
    """No other weights have a smaller non-negative risk than those of the linear system."""
    rng = np.random.default_rng(4)
    for prior in (0.3, 0.9):
        model = quality.Model(np.zeros(3), np.ones(3), hidden=4)
        p, u = model.basis(rng.normal(1, 1, (300, 3))), model.basis(rng.normal(0, 1.5, (400, 3)))
        model.fit(p.mean(0), p.T @ p / len(p), u.mean(0), u.T @ u / len(u), prior)

        def risk(w):
            loss = lambda z, y: ((z - y) ** 2).mean() / 4
            ridge = 1e-3 / 4 * w @ w
            return prior * loss(p @ w, 1) + max(0, loss(u @ w, -1) - prior * loss(p @ w, -1)) + ridge

        least = risk(model.weights)
        assert all(risk(model.weights + step) >= least - 1e-6 for scale in (1e-3, 1e-2, 0.1, 1) for step in rng.normal(0, scale, (200, len(model.weights))))


def test_quality_edge_cases(spark, docs):
    known = spark.createDataFrame([(k, k % 2, None) for k in range(30)] + [(None, 1, None), (3, None, None)], "doc_id long, quality int, toxic int")
    rows = [(k, f"Some text number {k}.\nIt goes on." if k % 2 else "@@## !! 000 " * k) for k in range(30)] + [(None, None), (40, ""), (5, "x")]
    got = quality.quality_scores(docs(rows, ("score",)), known).collect()
    assert len(got) == len(rows) and all(0 <= r["score_"] <= 1 and r.predicted == (r["score_"] >= 0.5) for r in got)
    assert len(quality.quality_scores(docs(rows, ("score",)), known, most_rows=5).collect()) == len(rows)
    assert {r["score_"] for r in quality.quality_scores(docs(rows, ("score",)), known.where("quality = 0")).collect()} == {0.5}
    assert quality.quality_scores(docs([]), known).collect() == []


def test_op9_rules_equal_sql(spark, sf):
    """Host, path and rule by SQL; the verdict of ruled URLs is the rule's."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    want = con.execute(
        r"""WITH p AS (SELECT page_id, coalesce(lower(regexp_extract(url, '^.*?://([^/?#]*)', 1)), '') AS host, coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
        r(rule, host, path, allow) AS (VALUES ('net/', 'net', '/', false), ('example.net/en/', 'example.net', '/en/', true), ('example.com/de/', 'example.com', '/de/', false), ('org/fr/', 'org', '/fr/', true)),
        f AS (SELECT page_id, max_by(rule, length(rule)) AS rule, max_by(allow, length(rule)) AS allow FROM p JOIN r ON (p.host = r.host OR p.host LIKE '%.' || r.host) AND starts_with(p.path, r.path) GROUP BY 1)
        SELECT p.page_id, host, path, rule, allow FROM p LEFT JOIN f USING (page_id)"""
    ).fetchall()
    got = {r.page_id: r for r in url_filter.op9_url_filter(spark, sf).collect()}
    assert len(got) == len(want)
    for i, host, path, rule, allow in want:
        r = got[i]
        assert (r.host, r.path, r.rule) == (host, path, rule) and (rule is None or r.verdict == ("allow" if allow else "block"))
