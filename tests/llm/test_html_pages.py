"""Extraction over pages of many templates: measured precision and recall of words, votes that tie, repeated pages, furniture within lines."""

import random
from collections import Counter

import pytest

from changetree.llm import html_extract as he

LONG = "This is a sentence that is long enough to count as a paragraph of the article, and it goes on for a while."


def inner(x):
    return he.extract(f"<body><article><p>{LONG}</p>{x}<p>end</p></article></body>", None).split("\n\n")[1:-1]


def test_furniture_within_a_line_does_not_cut_it():
    cases = ["Press <button>OK</button> to go", "pick <select><option>a<option>b</select> more", "a <textarea>z</textarea> b", "q <svg><title>t</title><text>w</text></svg> r", "k <button/> l", "m <button><div>deep</div></button> n"]
    assert [inner(f"<p>{c}</p>") for c in cases] == [["Press to go"], ["pick more"], ["a b"], ["q r"], ["k l"], ["m n"]]
    assert inner("<p>x <button>open <b>y</p>") == ["x"]


def test_names_that_articles_use_too():
    kept = ["related-work", "search-results", "share-of-votes", "social-science", "research", "responder"]
    gone = ["related", "related-posts", "post-related", "share-buttons", "sharedaddy", "search-box", "site-search", "social-media-links", "main related x", "notice", "cookie-notice", "advert_2", "comments"]
    assert [k for k in kept + gone if inner(f"<div class='{k}'>text</div>") == ["text"]] == kept


def site(r, host):
    """A template of its own: how articles of a host are held, and what stands around and in them."""
    box = r.choice(["<article class='post-{n} entry'>{}</article>", "<main><section class='story'>{}</section></main>", "<div id='c{n}' class='content'>{}</div>", "<div class='row'><div class='col-8 text{n}'>{}</div><div class='col-4 sidebar'><p>{f}</p></div></div>", "<table><tr><td class='body'>{}</td><td class='widget-area'><p>{f}</p></td></tr></table>"])
    before = r.sample(["<header><h2>{f}</h2></header>", "<nav><ul><li><a href='/'>{f}</a><li><a href='/x'>{f}</a></ul></nav>", "<div class='cookie-consent'><p>{f}</p></div>", "<div role='banner'>{f}</div>", "<form action='/s'><label>{f}</label><input name=q></form>"], 3)
    after = r.sample(["<footer><p>{f}</p></footer>", "<div class='comments'><div class='comment'><p>{f}</p></div></div>", "<aside><p>{f}</p></aside>", "<section class='related-articles'><p>{f}</p></section>", "<div id='newsletter'><p>{f}</p></div>", "<ul class='share-buttons'><li>{f}</ul>"], 3)
    return host, box, before, after


def built(r, template, n, word):
    _, box, before, after = template
    furniture = lambda: " ".join(f"furn{r.randrange(500)}" for _ in range(r.randint(2, 60)))
    blocks, html = [], []
    for k in range(r.randint(1, 9)):
        text = " ".join(word() for _ in range(r.randint(3, 90)))
        tag = r.choice(["p", "p", "p", "h2", "blockquote", "li", "pre"]) if k else "h1"
        extra = r.choice(["", "", "", " <button>Copy</button> ", " <span class='ad'>furn1</span>", "<script>furn2</script>"])
        html.append(("<ul><li>{}</ul>" if tag == "li" else f"<{tag}>{{}}</{tag}>").format(text.replace("&", "&amp;") + extra))
        blocks.append(text)
        if r.random() < 0.2:
            html.append(f"<div class='advert'><p>{furniture()}</p></div>")
    around = lambda parts: "".join(p.replace("{f}", furniture()) for p in parts)
    body = around(before) + box.replace("{n}", str(n)).replace("{f}", furniture()).replace("{}", "".join(html)) + around(after)
    return f"<html><head><title>furn0</title></head><body>{body}</body></html>", "\n\n".join(blocks)


@pytest.fixture(scope="module")
def extracted(spark):
    r = random.Random(11)
    word = lambda: r.choice(["a&b", "wörd", "x"]) + str(r.randrange(2000))
    templates = [site(r, f"h{k}.example") for k in range(30)]
    pages = [(i, f"http://{t[0]}/{i}", *built(r, t, i, word)) for i, t in enumerate(r.choice(templates) for _ in range(450))]
    df = spark.createDataFrame([p[:3] for p in pages], "page_id long, url string, html string")
    return pages, {x.page_id: x.text for x in he.html_extract(df).collect()}


def test_precision_and_recall_over_templates(extracted):
    pages, got = extracted
    same = wanted = found = 0
    for i, _, _, text in pages:
        a, b = Counter(text.split()), Counter(got[i].split())
        same, wanted, found = same + (a & b).total(), wanted + a.total(), found + b.total()
    whole = sum(got[i] == text for i, _, _, text in pages)
    print(f"precision {same / found:.4f}, recall {same / wanted:.4f}, whole pages {whole} of {len(pages)}")
    assert same / found > 0.98 and same / wanted > 0.98


def test_ties_and_repeated_pages(spark):
    """Two paths with equal votes: the first by name holds for the host; where a page hasn't it, its own best container does. Copies all stay."""
    a, b = (f"<div class='{c}'><p>{c} {LONG}</p></div>" for c in "ab")
    rows = [(1, "http://t/1", a + "<div><p>other</p></div>"), (2, "http://t/2", b + "<div><p>other</p></div>"), (3, "http://t/3", b + a), (3, "http://t/3", b + a), (4, "http://T/4", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    votes = he.host_paths(df.where("page_id < 3")).collect()
    assert [(x.host, x.path) for x in votes] == [("t", "div.a")]
    got = sorted((x.page_id, x.text) for x in he.html_extract(df).collect())
    assert [i for i, _ in got] == [1, 2, 3, 3, 4] and got[2] == got[3] and got[4][1] == ""
    assert got[0][1] == f"a {LONG}" and got[1][1] == f"b {LONG}"
