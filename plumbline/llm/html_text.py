"""Main text of web pages by consensus host paths.

A first pass scores the containers of every page: each gets the share of the
page's running text that stands inside it, less the share of its own text that
looks like furniture. Containers are named by generalised tag-class paths
(``body>div.post-#>article``), and each page votes for its best path. The path
with most votes wins its host, and a second pass extracts the text of each
page from the nodes on the winning path; a page that has none, or keeps little
of its running text there, is extracted from its own best container.

A page is read in one pass with bounded work for each tag, and a node holds its
parent and a digest of its path, so broken or hostile markup costs no more than
its length.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.plans.runtime import broadcast_if_small, cut

from .arrow import slices

# Elements by what they do to the text.
#: Content that is never text, up to the end tag; so are scripts and styles, which may also lack one.
RAW = "noscript template svg math iframe object canvas audio video textarea select title".split()
#: Furniture by element.
FURNITURE = set("nav header footer aside form button menu dialog head fieldset label".split())
#: Containers that can hold an article.
CONTAINERS = set("html body main article section div td center table tbody tr ul ol dl figure details".split())
#: Blocks: text on both sides is apart.
BLOCKS = CONTAINERS | FURNITURE | set("p h1 h2 h3 h4 h5 h6 li pre blockquote th dt dd figcaption caption summary address hr thead tfoot hgroup search legend".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Furniture by a word of class or id; not asked of html, body, main and article.
WORDS = set(
    "ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos promotion promoted banner banners "
    "cookie cookies consent gdpr notice notices alert alerts popup modal overlay toast newsletter subscribe subscription signup signin login register "
    "nav navbar navigation menu menus breadcrumb breadcrumbs topbar toolbar pagination pager skip "
    "header masthead footer foot colophon copyright sidebar sidebars rail widget widgets aside "
    "comment comments commentlist respond replies reply disqus discussion reactions "
    "related recommended recommendations share sharing social follow rating ratings search searchform form".split()
)
#: An element that only such a word makes furniture is none if it holds an article, main or first heading and at least this
#: part of the page's running text: then the word names the page's layout (``sidebar-layout``, ``search-page``).
TOO_MUCH = 0.8
#: Furniture by role.
ROLES = set("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form toolbar".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+)(?P<close>>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)",
    re.S,
)
#: A tag whose quotes don't matter, for what comes after one that a quote kept from ending.
_PLAIN = re.compile(r"<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>[^>]*)(?P<close>>)", re.S)
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in [*RAW, "script", "style"]}
_ANY_RAW = frozenset(_RAW_END)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_SPLIT = re.compile(r"[\s_-]+|(?<=[a-z])(?=[A-Z])")


@dataclass
class Block:
    node: int
    text: str
    running: float  # how much of it is running text, in characters
    raw: int


@dataclass
class Page:
    """Nodes of containers, each behind its parent, and blocks of text in page order. A node's key is a digest of its path."""

    labels: list[str] = field(default_factory=lambda: ["html"])
    parents: list[int] = field(default_factory=lambda: [-1])
    depths: list[int] = field(default_factory=lambda: [0])
    keys: list[bytes] = field(default_factory=lambda: [b""])
    blocks: list[Block] = field(default_factory=list)

    def add(self, node: int, label: str) -> int:
        self.labels.append(label)
        self.parents.append(node)
        self.depths.append(self.depths[node] + 1)
        self.keys.append(blake2b(self.keys[node] + label.encode("utf-8", "replace"), digest_size=16).digest())
        return len(self.labels) - 1

    def path(self, node: int) -> str:
        """The path in words; one of over ``LONGEST_PATH`` characters gives its end only."""
        said: list[str] = []
        length = 0
        while node >= 0 and length <= LONGEST_PATH:
            said.append(self.labels[node])
            length += len(said[-1]) + 1
            node = self.parents[node]
        found = ">".join(reversed(said))
        return found if len(found) <= LONGEST_PATH else "..." + found[-LONGEST_PATH:]


#: Characters of a path in words; paths are told apart by their digests.
LONGEST_PATH = 1000


def _label(tag: str, classes: str) -> str:
    names = sorted({re.sub(r"\d+", "#", c.lower()) for c in classes.split()})
    return ".".join([tag, *names])


def _furniture(tag: str, attributes: dict[str, str]) -> int:
    """0: none; 1: by a word of class or id alone; 2: by element or role."""
    if tag in FURNITURE:
        return 2
    if not attributes or tag in ("html", "body", "main", "article"):
        return 0
    if attributes.get("role", "").lower() in ROLES:
        return 2
    return int(any(w.lower() in WORDS for c in ("class", "id") if c in attributes for w in _SPLIT.split(attributes[c])))


def _tokens(source: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, "/" or "", tag in lower case, rest) of each tag; comments and the like have tag "".

    Scripts, styles and the elements of ``RAW`` come as one token of tag "", up
    to their end tag. Where there is none, scripts and styles go to the end of
    the page, and the others are passed over like unknown tags; that an element
    has no end tag is found out once.
    """
    at, pattern = 0, _TOKEN
    endless: set[str] = set()
    while m := pattern.search(source, at):
        if pattern is _TOKEN and m["tag"] and not m["close"]:
            pattern = _PLAIN  # no end outside quotes: from here on they don't count
            if not (m := pattern.match(source, m.start())):
                yield source.find("<", at), len(source), "", "", ""
                return
        if pattern is _PLAIN and (comment := source.find("<!--", at, m.start())) >= 0:
            stop = source.find("-->", comment)
            at = len(source) if stop < 0 else stop + 3
            yield comment, at, "", "", ""
            continue
        at = m.end()
        tag = (m["tag"] or "").lower()
        if tag in _ANY_RAW and not m["end"] and tag not in endless:
            if stop := _RAW_END[tag].search(source, at):
                at = stop.end()
                yield m.start(), at, "", "", ""
                continue
            endless.add(tag)
            if tag in ("script", "style"):
                yield m.start(), len(source), "", "", ""
                return
        yield m.start(), at, m["end"] if tag else "", tag, m["rest"] if tag else ""
    if pattern is _PLAIN and (m := _BROKEN.search(source, at)):
        yield m.start(), len(source), "", "", ""


_BROKEN = re.compile(r"<[a-zA-Z/!?]")


class _Stack:
    """Open elements, with the places of each tag, so that looking for a tag takes no longer than closing it."""

    def __init__(self):
        self.items: list[tuple[str, int, int]] = [("html", 0, -1)]  # tag, node, outermost furniture that it is in, or -1
        self.places: dict[str, list[int]] = {"html": [0]}

    def push(self, tag: str, node: int, inside: int) -> None:
        self.places.setdefault(tag, []).append(len(self.items))
        self.items.append((tag, node, inside))

    def last(self, *tags: str) -> int:
        """The place of the innermost of ``tags``; 0 if none is open."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def cut(self, place: int) -> None:
        """Close the elements from ``place`` on."""
        while len(self.items) > max(1, place):
            self.places[self.items.pop()[0]].pop()


def parse(source: str) -> Page:
    """The containers of a page and its text blocks in page order, furniture left out."""
    page = Page()
    stack = _Stack()
    # furniture by a word alone: its running text, the furniture around it, and whether an article begins in it
    doubtful: list[list] = []
    order: list[tuple[int, Block]] = []
    parts: list[str] = []
    linked = 0
    in_link = heading = in_paragraph = False
    hidden = False  # inside furniture by element or role

    def flush() -> None:
        nonlocal parts, linked, in_link
        if parts:
            joined = "".join(parts)
            text = " ".join((html_lib.unescape(joined) if "&" in joined else joined).split())
            _, node, inside = stack.items[-1]
            if text and not hidden:
                own = max(0, len(text) - linked)
                running = 0.0 if heading else own * (1.0 if own >= 80 else 0.3) * (1.0 if in_paragraph else 0.5)
                order.append((inside, Block(node, text, running, len(text))))
                if inside >= 0:
                    doubtful[inside][0] += running
            parts = []
        linked, in_link = 0, False

    at = 0
    for start, stop, closing, tag, rest in _tokens(source):
        if start > at and not hidden:
            parts.append(run := source[at:start])
            if in_link:
                linked += len(run)
        at = stop
        if not tag:
            continue
        if tag not in BLOCKS:
            if tag == "a":
                in_link = not closing
            elif tag == "br" and not hidden:
                parts.append(" ")
            continue
        flush()
        heading = in_paragraph = False
        if closing:
            if tag not in ("p", "html", "body") and (place := stack.last(tag)):
                stack.cut(place)
                hidden = stack.items[-1][2] == HIDDEN
            continue
        if tag in ("article", "main", "h1") and stack.items[-1][2] >= 0:
            doubtful[stack.items[-1][2]][2] = True
        if tag in HEADINGS:
            heading = True
            continue
        kind = None
        if tag not in CONTAINERS and tag not in FURNITURE:
            in_paragraph = tag in ("p", "pre", "blockquote", "dd")
            if tag in ("p", "hr") or "=" not in rest or not (kind := _furniture(tag, _attributes(rest))):
                continue
        if tag == "html":
            continue
        attributes = _attributes(rest) if "=" in rest else {}
        if tag == "body":
            stack.cut(1)
        elif tag in ("td", "tr"):
            if (place := stack.last(tag)) > stack.last("table", "div", "article", "body"):
                stack.cut(place)
        hidden = stack.items[-1][2] == HIDDEN
        if rest.endswith("/") or tag in VOID:
            continue
        _, node, inside = stack.items[-1]
        if not hidden:
            kind = _furniture(tag, attributes) if kind is None else kind
            if kind == 2:
                inside = HIDDEN
            else:
                node = page.add(node, _label(tag, attributes.get("class", "")))
                if kind:
                    doubtful.append([0.0, inside, False])
                    inside = len(doubtful) - 1
        stack.push(tag, node, inside)
        hidden = inside == HIDDEN
    if at < len(source) and not hidden:
        parts.append(source[at:])
    flush()
    # inner before outer: what an element holds counts for those around it
    whole = sum(b.running for _, b in order)
    for x in reversed(doubtful):
        if x[1] >= 0:
            doubtful[x[1]][0] += x[0]
            doubtful[x[1]][2] |= x[2]
    gone: list[bool] = []
    for running, around, has_article in doubtful:  # outer before inner
        gone.append(not has_article or running < TOO_MUCH * whole or around >= 0 and gone[around])
    page.blocks = [b for inside, b in order if inside < 0 or not gone[inside]]
    return page


#: In place of a number in ``doubtful``: inside furniture by element or role.
HIDDEN = -2


def _attributes(rest: str) -> dict[str, str]:
    return {k.lower(): html_lib.unescape(v.strip("\"'")) for k, v in _ATTRIBUTE.findall(rest)}


def scores(page: Page) -> dict[bytes, tuple[float, int]]:
    """The score of each path of a page that holds running text, by its key, and the first node on it."""
    n = len(page.labels)
    running, raw, short = [0.0] * n, [0] * n, [0.0] * n
    for b in page.blocks:
        running[b.node] += b.running
        raw[b.node] += b.raw
        if b.running < 0.5 * b.raw:
            short[b.node] += b.raw
    for node in range(n - 1, 0, -1):
        up = page.parents[node]
        running[up] += running[node]
        raw[up] += raw[node]
        short[up] += short[node]
    whole = running[0]
    by: dict[bytes, list] = {}
    for node in range(1, n):
        if running[node] > 0:
            x = by.setdefault(page.keys[node], [0.0, 0, 0.0, node])
            x[0] += running[node]
            x[1] += raw[node]
            x[2] += short[node]
    found = {}
    for key, (r, length, s, node) in by.items():
        label = page.labels[node]
        tag = label.partition(".")[0]
        kind = 0.5 if tag in ("article", "main") else 0.0 if tag in ("div", "td", "body") or "." in label else -0.3
        found[key] = ((r / whole) * (1 + kind) - 0.5 * s / length + 0.01 * min(page.depths[node], 20), node)
    return found


def best_path(own: dict[bytes, tuple[float, int]]) -> bytes | None:
    return max(own, key=lambda p: (round(own[p][0], 9), p), default=None)


def extract(page: Page, winner: bytes | None) -> str:
    """The text of the blocks under the path with the key ``winner``, or under the page's own best path where that keeps too little."""
    if not page.blocks:
        return ""
    best = best_path(scores(page))

    def under(key: bytes | None) -> tuple[list[str], float]:
        inside = [k == key for k in page.keys]
        for node, parent in enumerate(page.parents):
            if parent >= 0 and inside[parent]:
                inside[node] = True
        kept = [b for b in page.blocks if inside[b.node]]
        return [b.text for b in kept], sum(b.running for b in kept)

    lines, running = under(winner) if winner else ([], 0.0)
    if winner != best and running < 0.3 * sum(b.running for b in page.blocks) or not lines:
        lines = under(best)[0] if best else [b.text for b in page.blocks]
    return "\n".join(lines)


def _sources(batch: pa.RecordBatch) -> list[str]:
    return [x or "" for x in batch.column("html").to_pylist()]


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, key, path, votes): each host's winning path. ``pages``: (host, html).

    A page votes for its best path; of paths with equal votes the one with the
    larger sum of scores wins, of these the last by key. ``key`` is the path's
    digest; ``path`` says it in words, shortened if it is very long.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            rows = []
            for host, source in zip(batch.column("host").to_pylist(), _sources(batch)):
                page = parse(source)
                own = scores(page)
                best = best_path(own)
                rows += [(host, key, page.path(node) if key == best else None, int(key == best), round(score * 1000)) for key, (score, node) in own.items()]
            columns = zip(*rows) if rows else [()] * 5
            kinds = (pa.string(), pa.binary(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["host", "key", "path", "vote", "score"])

    found = pages.select("host", "html").mapInArrow(run, "host string, key binary, path string, vote long, score long")
    sums = found.groupBy("host", "key").agg(F.sum("vote").alias("votes"), F.sum("score").alias("score"), F.max("path").alias("path"))
    return sums.groupBy("host").agg(F.max(F.struct("votes", "score", "key", "path")).alias("won")).select("host", "won.key", "won.path", "won.votes")


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of ``pages`` (page_id, url, html).

    Null or empty html gives an empty text; pages whose url is null or has no
    host vote together; a null page_id stays null; repeated rows give repeated
    rows; other columns are ignored; an empty table gives no rows. Votes are
    pre-aggregated per task, so a host with a third of all pages costs no more
    than another. Time and memory are linear in a page's length.
    """
    hosted = pages.select("page_id", "url", "html", F.coalesce(F.lower(F.try_parse_url("url", F.lit("HOST"))), F.lit("")).alias("host"))
    winners = cut(host_paths(hosted)).select(F.col("host").alias("_host"), "key")
    met = hosted.join(broadcast_if_small(winners), F.col("host") == F.col("_host"), "left").select("page_id", "url", "html", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            found = [extract(parse(s), k) for s, k in zip(_sources(batch), batch.column("key").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("page_id").cast(pa.int64()), batch.column("url").cast(pa.string()), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return met.mapInArrow(run, "page_id long, url string, text string, n_chars long")
