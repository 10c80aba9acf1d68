"""Main text of web pages by consensus of each host's pages on where their content stands.

Every page is parsed into a tree; containers are scored by the share of the page's running text that they hold, and
the page votes for the generalised paths of all of them (tags with classes and ids, digits replaced). A path is a 64-bit hash that
grows by a name with each element, so parsing and voting are linear in the page, however deep it nests. Votes are added per
host and path in Spark, pre-aggregated before the shuffle, so a host with a third of all pages is only as many rows as it
has different paths. Then each page is extracted again from its host's winning path; a page without such an element
uses its own best container. Menus, headers, footers, sidebars, notices, adverts, forms, comments and anything
hidden are left out wherever they stand.

Defined results: null or empty html has an empty text; a null url, or one without "://", belongs to the empty host;
repeated pages vote and are returned one by one; of paths with equal votes the greater hash wins, of a page's equal containers the
first; an empty table gives no rows; columns other than page_id, url and html aren't read, whatever their names; markup that doesn't end, or ends twice, is read as browsers do,
as far as blocks go; pages of any length are read whole.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.common import table, written

#: Winning paths are broadcast up to so many bytes, else joined with salted hosts.
BROADCAST_BYTES = 32 << 20
SALTS = 32

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|<|[^<]+", re.S)
ATTR = re.compile(r"([^\s=/>\"']+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CONTAINER = frozenset("article main section div td body center blockquote".split())
DROP = frozenset("nav footer aside form button select option input svg canvas dialog menu menuitem object audio video map datalist head".split()) | RAW
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: Start tags that end an open element of the same family, unless one of the second set is in between.
FAMILY = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
SCOPE = frozenset("article aside blockquote body div footer form header html main nav section table td th ul ol dl".split())
#: Words in a class, id or role that tell parts which are not the article.
NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adslot adbox banner banners sponsor sponsored promo promotion promoted cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe subscription signup login sidebar sidebars rail widget widgets related recommended recommendations outbrain taboola share sharing social breadcrumb breadcrumbs menu menus nav navbar navigation topbar "
    "footer comment comments commentlist respond reply replies disqus pagination pager paywall toolbar search contentinfo complementary masthead".split()
)
#: These tell noise only outside an article.
NOISE_OUTSIDE = frozenset(["header", "top", "hero"])
GOOD = frozenset("article content main post entry story body text page".split())
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class Node:
    __slots__ = ("tag", "path", "parent", "kids", "dropped", "mass", "good")

    def __init__(self, tag, name, parent, dropped, good):
        self.tag, self.parent, self.dropped, self.good = tag, parent, dropped, good
        self.path = step(parent.path, name) if parent is not None else 0
        self.kids: list = []
        self.mass = 0.0


def step(path: int, name: str) -> int:
    """The path of an element of that name below the path: a signed 64-bit hash."""
    return int.from_bytes(hashlib.blake2b(name.encode("utf-8", "surrogatepass"), digest_size=8, key=path.to_bytes(8, "little", signed=True)).digest(), "little", signed=True)


def parse(html: str) -> Node:
    root = node = Node("", "", None, False, False)
    opened: Counter = Counter()  # open elements by tag
    at, end = 0, len(html)
    match = TOKEN.match

    def leave(upto: Node) -> Node:
        k = node
        while k is not upto:
            opened[k.tag] -= 1
            k = k.parent
        return upto

    while at < end:
        m = match(html, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            if html[m.start()] != "<" or m.end() - m.start() == 1:
                node.kids.append(m[0])
            continue
        tag = tag.lower()
        if m[1]:
            k = node if opened[tag] else root
            while k.parent is not None and k.tag != tag:
                if k.tag in SCOPE and tag not in SCOPE:
                    k = root
                    break
                k = k.parent
            if k.parent is not None:
                node = leave(k.parent)
            elif tag in ("br", "p"):
                node.kids.append(Node("br", "br", node, False, False))
            continue
        if tag in CLOSES_P and opened["p"]:
            k = node
            while k.parent is not None and k.tag != "p" and k.tag not in SCOPE:
                k = k.parent
            if k.tag == "p":
                node = leave(k.parent)
        if tag in FAMILY and any(opened[t] for t in FAMILY[tag][0]):
            same, stop = FAMILY[tag]
            k, found = node, None
            while k.parent is not None and k.tag not in stop:
                if k.tag in same:
                    found = k
                k = k.parent
            if found is not None:
                node = leave(found.parent)
        inside = opened["article"] + opened["main"]
        attrs = m[3]
        name, noise, good = tag, tag in DROP or (tag == "header" and not inside), tag in ("article", "main")
        if attrs and "=" in attrs or "hidden" in attrs:
            marks = []
            for a in ATTR.finditer(attrs):
                key, value = a[1].lower(), unescape(a[2] or a[3] or a[4] or "")
                if key == "class":
                    marks += value.split()
                    name += "".join("." + c for c in sorted({re.sub(r"\d+", "0", c) for c in value.split()}))
                elif key == "id" and value:
                    marks.append(value)
                    name += "#" + re.sub(r"\d+", "0", value)
                elif key == "role":
                    marks.append(value)
                elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
                    noise = noise or tag not in ("html", "body")
            words = {w.lower() for c in marks for w in WORD.findall(c)}
            good = good or bool(words & GOOD)
            if tag not in ("html", "body", "main", "article") and (words & NOISE or (words & NOISE_OUTSIDE and not inside and not words & GOOD)):
                noise = True
        new = Node(tag, name, node, noise, good)
        node.kids.append(new)
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(html, at)
            at = close.end() if close else end
        elif tag not in VOID and not attrs.endswith("/") or tag in CONTAINER:
            opened[tag] += 1
            node = new
    return root


def text_of(top: Node) -> str:
    out: list[str] = []
    stack: list = [top]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        elif x is None:
            out.append(" ")
        elif not x.dropped or x is top:
            block = x.tag not in INLINE
            if block:
                out.append(" ")
                stack.append(None)
            stack.extend(reversed(x.kids))
    return " ".join(unescape("".join(out)).split())


def containers(root: Node) -> list[tuple[float, Node]]:
    """Containers by score: the share of the page's text outside links that one holds, for deeper and better named ones raised."""
    order: list[tuple[Node, int, bool]] = []
    stack = [(root, 0, False)]
    while stack:
        node, depth, link = stack.pop()
        order.append((node, depth, link))
        for k in node.kids:
            if isinstance(k, str):
                node.mass += len(k.strip()) * (0.2 if link else 1.0)
            elif not k.dropped:
                stack.append((k, depth + 1, link or k.tag == "a"))
    for node, _, _ in reversed(order):
        if node.parent is not None:
            node.parent.mass += node.mass
    whole = root.mass or 1.0
    found = []
    for node, depth, _ in order:
        if node.tag in CONTAINER and node.mass:
            share = node.mass / whole
            found.append((share * share * (1 + 0.05 * min(depth, 8)) * (1.5 if node.tag in ("article", "main") else 1.2 if node.good else 1.0), node))
    found.sort(key=lambda x: -x[0])
    return found


def extract(html: str, path: int | None) -> str:
    root = parse(html)
    found = containers(root)
    return text_of(next((n for _, n in found if n.path == path), found[0][1] if found else root))


def host_of(url: Column) -> Column:
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))
    return host


def winners(pages: DataFrame) -> DataFrame:
    """host and path: the path with the most votes of the host's pages."""

    def votes(batches):
        for batch in batches:
            hosts, paths, scores = [], [], []
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for score, node in containers(parse(html or "")):
                    hosts.append(host)
                    paths.append(node.path)
                    scores.append(int(score * 1000))  # whole numbers: sums don't depend on their order
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.int64()), pa.array(scores, pa.int64())], ["host", "path", "score"])

    cast = pages.select("host", "html").mapInArrow(votes, "host string, path long, score long")
    summed = cast.groupBy("host", "path").agg(F.sum("score").alias("score"))
    return summed.groupBy("host").agg(F.max(F.struct("score", "path")).alias("best")).select("host", F.col("best.path").alias("path"))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of pages (page_id, url, html)."""
    spark = pages.sparkSession
    pages = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    best = written(winners(pages), "paths")
    size = best.agg(F.sum(F.octet_length("host") + 72)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        both = pages.join(F.broadcast(best), "host", "left")
    else:
        salted = best.withColumn("_h_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        both = pages.withColumn("_h_salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["host", "_h_salt"], "left")

    def again(batches):
        for batch in batches:
            texts = [extract(h or "", p) for h, p in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return both.select("page_id", "url", "html", "path").mapInArrow(again, "page_id long, url string, text string, n_chars long")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
