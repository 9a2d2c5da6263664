"""Main text of web pages: pages score their containers, hosts vote on a path, pages are read again with it.

A container is an element that may hold an article (``div``, ``section``, ``article``, ...).  Its path is the
chain of tags and classes above it, digits in classes made equal.  On each page the containers get a score
from the text that lies directly in them and, halved, in their children, lowered by link text; the best one
is the page's vote.  Spark counts the votes per host, and every page is read again with its host's path; a
page that lacks the path keeps its own best container.

Boilerplate (menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, comments) is
recognised by tag, role, class or id and never gives text or votes.  Outside an article one word of a name is
enough.  Inside it a whole name must say so (``ad``, ``share-buttons``; not ``search-term``), or the element
must consist of links for the most part.  Elements within a line are adverts or share links by a whole name.

Defined results: null html is empty and gives empty text; so does a page without text outside boilerplate.
A null url belongs to the empty host.  End tags that HTML lets authors omit (``p``, ``li``, ``dt``, ``dd``,
``option``, ``head``, parts of tables) are implied; a stray end tag is ignored, any other unclosed element
ends with its parent.  Repeated rows give repeated results, an empty table an empty one.  Whole pages are
read, whatever their length and depth; only the named columns are.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ardoise.llm.common import batches, join_lookup, to_spark
from ardoise.llm.urls import url_parts
from ardoise.sources.workdir import materialise

#: Elements whose text is never part of an article.
DROPPED = frozenset(
    "nav footer aside form script style noscript template iframe button select option textarea input svg canvas dialog "
    "menu head title object embed audio video fieldset datalist".split()
)
#: Words in a class, id or role that mark boilerplate.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent "
    "gdpr notice notices alert popup modal overlay newsletter subscribe subscription paywall sidebar sidenav rail widget "
    "widgets menu nav navbar navigation breadcrumb breadcrumbs footer foot comment comments disqus reply replies respond "
    "discussion related recommended recommendations share sharing social login signup search toolbar pagination pager "
    "skip complementary contentinfo hidden".split()
)
#: Words that go with those in the name of a piece of furniture.
PARTS = frozenset(
    "area bar block box button buttons container content entry form group icon icons inner item items left link links list "
    "module outer panel post posts right row section site slot story stories text top bottom title unit wrap wrapper zone".split()
)
#: Marks of elements within a line.
WITHIN = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion popup newsletter subscribe "
    "share sharing social skip hidden".split()
)
#: These mark boilerplate only outside an article, where a heading may stand in a header of its own.
OUTSIDE = frozenset("header masthead topbar".split())
VOTERS = frozenset("html body div section article main center td".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub "
    "sup time tt u var wbr label".split()
)
RAW = frozenset("script style textarea title noscript template iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Start tags that end an open paragraph, and elements that keep a paragraph outside them open.
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr li dd dt main menu nav ol p pre search section summary table ul".split()
)
P_SCOPE = frozenset("table td th caption button object template html".split())
LISTS = frozenset("ul ol menu dl".split()) | P_SCOPE
TABLE = frozenset(("table", "template", "html"))
#: Start tag: the open elements that it ends, and what it does not look beyond.
IMPLIED = {
    "li": (frozenset(["li"]), LISTS), "dt": (frozenset(("dt", "dd")), LISTS), "dd": (frozenset(("dt", "dd")), LISTS),
    "td": (frozenset(("td", "th")), TABLE), "th": (frozenset(("td", "th")), TABLE), "tr": (frozenset(["tr"]), TABLE),
    **dict.fromkeys(("tbody", "thead", "tfoot"), (frozenset(("tbody", "thead", "tfoot")), TABLE)),
    "option": (frozenset(["option"]), frozenset(("select", "datalist", "html"))),
}
#: End tags that are stray beyond these.
END_SCOPE = {"p": P_SCOPE, "li": LISTS, "dt": LISTS, "dd": LISTS, "td": TABLE, "th": TABLE, "tr": TABLE}
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
#: A tag that says "article" is worth this many times its text.
MEANT = {"article": 3.0, "main": 2.0}

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^'">]|"[^"]*"|'[^']*')*+)>|<[!?][^>]*>""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORDS = re.compile(r"[a-z]+")
DIGITS = re.compile(r"[0-9]+")


def _furniture(name: str) -> bool:
    """Whether a whole class or id names boilerplate."""
    words = set(WORDS.findall(name))
    return bool(words & MARKS) and words <= MARKS | PARTS


class _Node:
    __slots__ = ("above", "tag", "name", "key", "voter", "dropped", "suspect", "article", "text", "links")

    def __init__(self, above: "_Node | None", tag: str, attributes: str):
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)} if attributes else {}
        name = DIGITS.sub("#", ".".join(sorted(found.get("class", "").lower().split()))).replace(">", "_")
        self.above, self.tag = above, tag
        self.name = f"{tag}.{name}" if name else tag
        self.key = hash((above.key if above else 0, self.name))
        self.voter = self if tag in VOTERS else above.voter if above else None
        self.article = tag in MEANT or bool(above and above.article)
        names = " ".join(found.values()).lower() if found else ""
        marks = set(WORDS.findall(names))
        self.suspect = bool(marks & MARKS)
        if tag in INLINE:
            said = any(WITHIN >= set(WORDS.findall(x)) and WORDS.search(x) for x in names.split())
        elif self.article:
            said = self.suspect and any(map(_furniture, names.split()))
        else:
            said = self.suspect or tag == "header" or bool(marks & OUTSIDE)
        self.dropped = bool(above and above.dropped) or tag in DROPPED or said
        self.text = self.links = 0

    def path(self) -> str:
        names, x = [], self
        while x is not None:
            names.append(x.name)
            x = x.above
        return ">".join(reversed(names))


class _Stack(list):
    """Open elements, and how many there are of each tag."""

    def __init__(self, root: _Node):
        super().__init__([root])
        self.tags = Counter()

    def enter(self, x: _Node) -> None:
        self.append(x)
        self.tags[x.tag] += 1

    def leave(self, tags: frozenset, scope: frozenset | None) -> None:
        """Ends the innermost element of these tags and all within it, unless one of ``scope`` lies between."""
        if not any(self.tags[t] for t in tags):
            return
        for k in range(len(self) - 1, 0, -1):
            if self[k].tag in tags:
                for x in self[k:]:
                    self.tags[x.tag] -= 1
                del self[k:]
                return
            if scope is None and self[k].tag not in INLINE or scope and self[k].tag in scope:
                return


ANYWHERE, P, HEAD = frozenset([""]), frozenset(["p"]), frozenset(["head"])


def _read(page: str) -> tuple[list[_Node], list[tuple[_Node, str | None]]]:
    """Elements in page order, and the runs of text with the element of each; a run of None parts blocks."""
    root = _Node(None, "html", "")
    stack, nodes, runs, at, links = _Stack(root), [root], [], 0, 0
    while True:
        m = TAG.search(page, at)
        top = stack[-1]
        piece = page[at : m.start()] if m else page[at:]
        if piece and not top.dropped:
            piece = entities.unescape(piece) if "&" in piece else piece
            runs.append((top, piece))
            n = len(piece.strip())
            top.text += n
            if links:
                top.links += n
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag in INLINE:
            if tag == "a":
                links = 0 if m[1] else 1
            if m[1]:
                if stack.tags[tag]:
                    stack.leave(frozenset([tag]), None)
            elif tag not in VOID and (stack.tags[tag] or m[3] and ATTRIBUTE.search(m[3])):
                # Only boilerplate within a line becomes a node, with what it holds of the same tag.
                x = _Node(top, tag, m[3])
                if x.dropped and (not top.dropped or stack.tags[tag]):
                    stack.enter(x)
                    nodes.append(x)
            continue
        runs.append((top, None))
        links = 0
        if m[1]:
            if stack.tags[tag]:
                stack.leave(frozenset([tag]), END_SCOPE.get(tag, ANYWHERE))
            continue
        if stack.tags["head"] and tag not in IN_HEAD:
            stack.leave(HEAD, ANYWHERE)
        if tag in ENDS_P and stack.tags["p"]:
            stack.leave(P, P_SCOPE)
        if tag in IMPLIED:
            stack.leave(*IMPLIED[tag])
        if tag in RAW and not m[3].endswith("/"):
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in VOID or tag == "html" or m[3].endswith("/"):
            continue
        stack.enter(_Node(stack[-1], tag, m[3]))
        nodes.append(stack[-1])
    _drop_links(nodes)
    return nodes, runs


def _drop_links(nodes: list[_Node]) -> None:
    """Drops elements inside articles whose names hint at boilerplate and whose text is links for the most part."""
    if not any(x.suspect and not x.dropped for x in nodes):
        return
    text, links = {id(x): x.text for x in nodes}, {id(x): x.links for x in nodes}
    for x in reversed(nodes[1:]):
        text[id(x.above)] += text[id(x)]
        links[id(x.above)] += links[id(x)]
    for x in nodes[1:]:
        if x.above.dropped or x.suspect and x.tag not in INLINE and 2 * links[id(x)] > text[id(x)]:
            x.dropped = True


def _vote(nodes: list[_Node]) -> tuple[str, float] | None:
    """Path and score of the best container."""
    score: dict[int, float] = {}
    for x in nodes:
        if x.dropped or not x.text:
            continue
        value, share = x.text - 2.0 * x.links, 1.0
        y = x.voter
        while y is not None and share >= 0.25:
            score[id(y)] = score.get(id(y), 0.0) + value * share
            share /= 2
            y = y.above and y.above.voter
    best = None
    for x in nodes:
        s = score.get(id(x), 0.0) * MEANT.get(x.tag, 1.0)
        if s > 0 and (best is None or s > best[1]):
            best = (x, s)
    return best and (best[0].path(), best[1])


def _text(nodes: list[_Node], runs: list[tuple[_Node, str | None]], path: str) -> str | None:
    """Text below containers of that path, or None if there is none."""
    key = 0
    for name in path.split(">"):
        key = hash((key, name))
    inside: set[int] = set()
    for x in nodes:
        if x.key == key or id(x.above) in inside:
            inside.add(id(x))
    parts = [" " if piece is None else piece for x, piece in runs if id(x) in inside and (piece is None or not x.dropped)]
    return " ".join("".join(parts).split()) if parts else None


def best_container(page: str) -> tuple[str, float] | None:
    return _vote(_read(page)[0])


def main_text(page: str, path: str | None) -> str:
    """The main text by the host's path, or else by the page's own best container."""
    nodes, runs = _read(page)
    text = _text(nodes, runs, path) if path else None
    if not text:
        best = _vote(nodes)
        text = _text(nodes, runs, best[0]) if best else ""
    return text or ""


VOTES = pa.schema([("host", pa.string()), ("path", pa.string()), ("score", pa.float64()), ("pages", pa.int64())])
TEXTS = pa.schema([("id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def _votes(batch: pa.RecordBatch) -> dict[str, list]:
    """Votes of a batch, one row per host and path."""
    sums: dict[tuple[str, str], list] = {}
    for host, page in zip(batch["host"].to_pylist(), batch["html"].to_pylist()):
        best = best_container(page)
        if best:
            x = sums.setdefault((host, best[0]), [0.0, 0])
            x[0] += best[1]
            x[1] += 1
    return {"host": [k[0] for k in sums], "path": [k[1] for k in sums], "score": [float(round(x[0])) for x in sums.values()], "pages": [x[1] for x in sums.values()]}


def _extract(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        found = [main_text(p, path) for p, path in zip(batch["html"].to_pylist(), batch["path"].to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [batch["id"], batch["url"], pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())], schema=TEXTS
        )


def host_paths(pages: DataFrame) -> DataFrame:
    """The winning path of each host: most pages, then most text, then the smaller path.  ``pages``: host, html."""
    votes = pages.mapInArrow(batches(_votes, VOTES), to_spark(VOTES)).groupBy("host", "path").agg(
        F.sum("pages").alias("pages"), F.sum("score").alias("score")
    )
    best = F.min(F.struct((-F.col("pages")).alias("a"), (-F.col("score")).alias("b"), "path"))
    return votes.groupBy("host").agg(best.alias("best")).select("host", "best.path")


def extract_pages(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``key``, url, text and n_chars of every row of ``pages``."""
    cut = pages.select(
        F.col(key).cast("long").alias("id"), F.col(url).alias("url"),
        url_parts(F.col(url))[0].alias("host"), F.coalesce(F.col(html), F.lit("")).alias("html"),
    )
    paths = materialise(host_paths(cut.select("host", "html")), "paths")
    found = join_lookup(cut, paths, ["host"]).select("id", "url", "html", "path").mapInArrow(_extract, to_spark(TEXTS))
    return found.select(F.col("id").alias(key), F.col("url"), "text", "n_chars")
