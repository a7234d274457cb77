"""Operator 3, HTML extraction: consensus host paths.

Each page's containers are scored by the text that stands in them and not in furniture (menus, adverts,
forms), less what links take. The best container's generalised path of tags and classes is the page's vote, and
votes are summed per host in Spark, pre-aggregated per task. Each page is then extracted at its host's
winning path; where a page hasn't that path, at its own best container."""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, persisted, table

# Elements of HTML by what they do to text.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title".split())
SKIP = set("script style noscript template head nav header footer aside form button select textarea iframe svg canvas object dialog menu title".split())
INLINE_SKIP = set("button select textarea iframe svg canvas object noscript template".split())  # these of SKIP stand within a line
BLOCK = set(
    "address article blockquote body caption center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hr html legend li main ol p pre "
    "section summary table tbody td tfoot th thead tr ul".split()
)
PLAIN = {"html", "body", "article", "main", "h1", "h2", "h3", "h4", "h5", "h6"}  # never furniture by their names alone
CONTAINERS = set("article main section div td body".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Words of a class, id or role that mark furniture, alone or as a part of a name.
FURNITURE = re.compile(
    r"(?:^|[-_ ])(?:ad|ads|adv|advert\w*|banner|breadcrumb\w*|comment\w*|cookie\w*|consent|disqus|footer|header|masthead|menu|nav\w*|newsletter|notice\w*|"
    r"pager|pagination|popup|promo\w*|replies|sidebar\w*|sponsor\w*|subscribe|toolbar|widget\w*|complementary|contentinfo)(?:[-_ ]|$)"
)
#: Words that an article's own parts are named by too (related work, search results, share of votes): they mark furniture alone, or with a word for the
#: thing it is made of.
SHARED = re.compile(
    r"(?:^| )(?:[a-z0-9]+[-_])*(?:related|respond|share\w*|social|search)(?:[-_](?:post|article|link|story|stories|item|list|box|bar|form|field|input|block|wrap|wrapper|container|button|btn|icon|media|news|read|reading|content|panel)s?)*(?= |$)"
)
#: Nothing is tried twice (possessive), and a quote that is never closed is an ordinary character.
TAG = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*+(?:>|$)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)")
SPACE = re.compile(r"\s+")


@dataclass
class Node:
    tag: str
    label: str
    skip: bool
    parent: Node | None
    blocks: list = field(default_factory=list)  # texts and nodes in page order
    own: int = 0  # characters outside furniture, and of these those of links
    linked: int = 0
    paragraphs: int = 0
    around: list | None = None  # of inline furniture: the text that goes on behind it

    def __post_init__(self):
        self.key = step(self.parent.key, self.label) if self.parent else b""

    @property
    def path(self) -> str:
        labels, node = [], self
        while node.parent:
            labels.append(node.label)
            node = node.parent
        return ">".join(reversed(labels))


def step(key: bytes, label: str) -> bytes:
    """A digest of a path from that of its parent's, so that deep pages keep no long paths."""
    return hashlib.blake2b(key + label.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def path_key(path: str) -> bytes:
    return reduce(step, path.split(">"), b"")


def generalised(tag: str, attributes: str) -> tuple[str, str]:
    """(tag.class with digits removed, class, id and role)."""
    found = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(attributes)} if "=" in attributes else {}
    classes = sorted({re.sub(r"\d+", "", c.lower()) for c in found.get("class", "").split()} - {""})
    return ".".join([tag, *classes]).replace(">", ""), " ".join(found.get(k, "") for k in ("class", "id", "role")).lower()


def parse(page: str) -> Node:
    """The page's tree; what is never closed ends where its parent does, and paragraphs end where a block begins.
    Furniture inside a line of text is left out of it without cutting it in two."""
    root = node = Node("", "", False, None)
    at, end = 0, page.rfind(">") + 1
    run: list[str] = []
    opened: Counter[str] = Counter()
    link_end = -1

    def flush() -> None:
        nonlocal run
        if run:
            t = SPACE.sub(" ", "".join(run)).strip()
            if t:
                node.blocks.append(t)
                if not node.skip:
                    node.own += len(t)
                    node.paragraphs += len(t) >= 80
            run = []

    def leave() -> None:
        nonlocal node, run
        flush()
        run = node.around or []
        opened[node.tag] -= 1
        node = node.parent

    while m := TAG.search(page, at, end):
        if m.start() > at:
            run.append(entities.unescape(page[at : m.start()]))
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                run.append(" ")
            if opened[tag] > 0:
                while node.tag != tag:
                    leave()
                leave()
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            else:
                run.append(" " if tag == "br" else "")
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            if tag == "title":
                flush()
            at = close.end() if close else len(page)
            continue
        label, marks = generalised(tag, m[3])
        named = bool(marks.strip() and tag not in PLAIN and (FURNITURE.search(marks) or SHARED.search(marks)))
        if tag in INLINE_SKIP:
            if m[3].endswith("/"):
                continue
            child = Node(tag, label, True, node, around=run)
            run = []
        elif tag in BLOCK or tag in SKIP:
            flush()
            if tag in BLOCK and node.tag == "p":
                leave()
            if tag in CLOSES and node.tag in CLOSES[tag]:
                leave()
            if m[3].endswith("/") and tag not in BLOCK:
                continue
            child = Node(tag, label, node.skip or tag in SKIP or named, node)
        elif named and not node.skip and not m[3].endswith("/"):
            child = Node(tag, label, True, node, around=run)
            run = []
        else:
            if tag == "a" and not node.skip:
                if link_end < at:
                    found = page.find("</a", at)
                    link_end = found if found >= 0 else len(page)
                node.linked += link_end - at if link_end < len(page) else 0
            continue
        opened[tag] += 1
        node.blocks.append(child)
        node = child
    if at < len(page):
        run.append(entities.unescape(page[at:]))
    while node is not root:
        leave()
    flush()
    return root


def containers(root: Node) -> list[tuple[bytes, float, Node]]:
    """(key of the path, score, node) of each container outside furniture. Text counts in its nearest containers,
    by half at each step up; paragraphs count for more than scattered text."""
    found: dict[int, list] = {}
    nearest: dict[int, Node | None] = {id(root): None}  # the container around a node
    todo = [root]
    while todo:
        node = todo.pop()
        if node.skip:
            continue
        for x in node.blocks:
            if isinstance(x, Node):
                nearest[id(x)] = node if node.tag in CONTAINERS else nearest[id(node)]
                todo.append(x)
        gain = max(node.own - 2 * node.linked, 0) + 50 * node.paragraphs
        up, share = node if node.tag in CONTAINERS else nearest[id(node)], 1.0
        while up is not None and gain and share > 1e-9:
            found.setdefault(id(up), [up, 0.0])[1] += gain * share
            share /= 2
            up = nearest[id(up)]
    bonus = {"article": 2.0, "main": 1.5}
    return [(n.key, s * bonus.get(n.tag, 1.0), n) for n, s in found.values()]


def blocks(node: Node) -> list[str]:
    out: list[str] = []
    todo: list = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif not x.skip:
            todo += reversed(x.blocks)
    return out


def at_path(root: Node, path: str) -> list[Node]:
    """The outermost nodes outside furniture with this generalised path, in page order."""
    key, out, todo = path_key(path), [], [root]
    while todo:
        node = todo.pop()
        if node.skip:
            continue
        if node.key == key:
            out.append(node)
        else:
            todo += reversed([x for x in node.blocks if isinstance(x, Node)])
    return out


def vote(page: str | None) -> tuple[str, float]:
    best = max(containers(parse(page)), key=lambda x: (x[1], x[0]), default=None) if page else None
    return (best[2].path, best[1]) if best else ("", 0.0)


def extract(page: str | None, path: str | None) -> str:
    """The main text at the host's path, else at the page's own best container, else of the whole page."""
    if not page:
        return ""
    root = parse(page)
    nodes = at_path(root, path) if path else []
    if not any(blocks(n) for n in nodes):
        nodes = [n for _, _, n in sorted(containers(root), key=lambda x: (-x[1], x[0]))[:1]] or [root]
    return "\n\n".join(b for n in nodes for b in blocks(n))


@F.pandas_udf(T.StructType().add("path", T.StringType()).add("score", T.DoubleType()))
def _votes(pages: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([vote(p) for p in pages], columns=["path", "score"])


_votes = _votes.asNondeterministic()  # so that a condition on the vote isn't pushed below it, which would parse each page once more


@F.pandas_udf(T.StringType())
def _texts(pages: pd.Series, paths: pd.Series) -> pd.Series:
    return pd.Series([extract(p, w) for p, w in zip(pages, paths)], dtype=object)


def host_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each host: host, path, the generalised path with the highest sum of votes (of equal
    sums the first by name). A vote is one at most, by the score's share of 1000 characters."""
    votes = pages.select(host_of(F.col(url_col)).alias("host"), _votes(F.col(html_col)).alias("v"))
    sums = votes.where("v.path <> ''").groupBy("host", F.col("v.path").alias("path")).agg(F.sum((F.least(F.lit(1.0), F.col("v.score") / 1000) * 1e6).cast("long")).alias("votes"))
    return sums.groupBy("host").agg(F.min(F.struct(-F.col("votes"), "path")).alias("first")).select("host", "first.path")


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def html_extract(pages: DataFrame, url_col: str = "url", html_col: str = "html", max_broadcast: int = 200_000) -> DataFrame:
    """pages with text and n_chars (code points) behind its columns (underscores are added to names that
    pages has already); one row for each row of pages.

    Null or empty html gives an empty text. Pages with a null URL or one without :// share the empty host.
    Repeated rows vote as often as they stand and are all kept; an empty table gives an empty result. The table of
    winning paths is broadcast while it has at most max_broadcast hosts, else joined by shuffle."""
    text, n_chars, w_host, w_path, w_key = (free_name(pages, c) for c in ("text", "n_chars", "w_host", "w_path", "w_key"))
    winners = persisted(host_paths(pages, url_col, html_col).select(F.col("host").alias(w_host), F.col("path").alias(w_path)))
    small = winners.limit(max_broadcast + 1).count() <= max_broadcast
    joined = pages.withColumn(w_key, host_of(F.col(url_col))).join(F.broadcast(winners) if small else winners, F.col(w_key) == F.col(w_host), "left")
    out = joined.withColumn(text, _texts(F.col(html_col), F.col(w_path)))
    return out.select(*[F.col(f"`{c}`") for c in pages.columns], F.col(text), F.length(text).cast("long").alias(n_chars))


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
