"""Main text of web pages by consensus of their host.

Pass one parses each page, scores its containers by the text of the blocks in them (link text counts against, and a container
passes half of its score up to the one around it), and votes for the generalised paths of all that score: tags and classes from
the root, digits dropped. Votes are summed per host in Spark. Pass two parses each page again and starts from the elements on its
host's winning path, or on the page's own best path where the page has no such element, or its host no path with half of the
votes. From there it widens (`Page.widened`), so that headings, intros, tables and further sections around the best one stay.

Both passes leave out menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments, by tag,
role, and words of class or id. Words alone don't decide about an element that holds most of the page's text (`Page.settle`).
Votes are pre-aggregated before the shuffle, and a host with most of all pages is spread over salts in the join with the winners.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, stored

#: Elements of HTML by what they mean for text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("nav header footer aside script style title noscript template iframe object svg math button select textarea dialog head canvas audio video".split())
BLOCKS = frozenset("address article blockquote body caption center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hgroup hr html legend li main ol p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = frozenset("article body main section div td blockquote".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
#: Words of class and id names, between separators, that mark what is not the article.
WORDS = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar aside footer masthead header topbar toolbar ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended pagination pager comment comments commentlist disqus replies respond widget skip".split()
)
#: Those of the words that also name what is wrapped around an article, and words whose headers are an article's own.
WRAPPING = frozenset("widget header footer sidebar aside masthead topbar toolbar banner notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related skip".split())
OWN = frozenset("post entry article story".split())
#: p ends where a block starts; these end an open one of the same kind.
SELF_CLOSING = {"li": "li", "dt": "dd", "dd": "dt", "tr": "tr", "td": "td", "th": "th", "option": "option"}
#: Elements that list items, table cells and paragraphs don't end across; elements of drawings and formulas, which "/>" ends.
SCOPES = (CONTAINERS - {"td"}) | frozenset("ul ol dl table tbody thead".split())
FOREIGN = frozenset("svg math path".split())
#: Elements whose content is no markup up to their end tag.
_RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.IGNORECASE) for t in "script style textarea title iframe xmp noembed noframes".split()}
_COMMENT_END = re.compile(r"--!?>")
_NAME = re.compile(r"[^\t\n\f\r />]+")
_GAP = re.compile(r"[\t\n\f\r /]*")
_ATTRIBUTE = re.compile(r"=?[^\t\n\f\r />=]*")
_EQUAL = re.compile(r"[\t\n\f\r ]*=[\t\n\f\r ]*")
_BARE = re.compile(r"[^\t\n\f\r >]*")
_SPLIT = re.compile(r"[^a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_DIGITS = re.compile(r"\d+")


WANTED, WRAPPER, MARKED, GONE = range(4)


def _kind(tag: str, attrs: dict[str, str | None]) -> int:
    """GONE by tag, role or style; MARKED or (by words or tags that may stand for the whole page) WRAPPER: left out unless it holds the article."""
    if tag in SKIPPED or "hidden" in attrs or attrs.get("aria-hidden") == "true" or (attrs.get("role") or "").lower() in ROLES:
        return GONE
    if tag in ("html", "body", "article", "main"):
        return WANTED
    if tag == "form":
        return WRAPPER
    names = f"{attrs.get('class') or ''} {attrs.get('id') or ''}"
    if names == " ":
        return GONE if "display:none" in (attrs.get("style") or "").replace(" ", "").lower() else WANTED
    words = set(_SPLIT.split(_CAMEL.sub(" ", names).lower()))
    found = words & WORDS
    if not OWN.isdisjoint(words):
        found.discard("header")
    return WANTED if not found else WRAPPER if found <= WRAPPING else MARKED


class Page:
    """Blocks of a page in order, each with its innermost container; containers with their path and the one around them.

    Any text is a page: markup is read as browsers read it, and time and memory grow with its length, however it is nested or
    broken. Paths are numbers of a trie; a path's name is its labels from the root, blanks between.
    """

    def __init__(self, html: str):
        self.open: list[tuple[str, int, int]] = []  # tag ("" once its end tag came out of turn), container and doubtful element outside it
        self.where: dict[str, list[int]] = {}  # places of each open tag
        self.blocks_at: list[int] = []  # places of open blocks
        self.scopes: list[int] = [-1]  # places of open elements that list items and table cells don't end across
        self.skip = -1  # place of the outermost open element that is left out
        self.doubts: list[tuple[int, int]] = []  # of elements that words leave out: the one around, its kind
        self.doubt, self.doubts_at = -1, []  # the innermost open one, and the places of all open ones
        self.titled: set[int] = set()  # paths whose containers themselves have a main heading
        self.articles: list[int] = []  # the doubtful element around each article or main
        self.trie: dict[tuple[int, str], int] = {}
        self.labels: list[tuple[int, str]] = []  # of each path: the one above, and the last label
        self.containers: list[tuple[int, int]] = []  # path, parent
        self.marked: list[tuple[int, str, int, int]] = []  # all blocks, with the doubtful element they are in
        self.parts: list[str] = []
        self.link, self.links = 0, 0
        self.at = -1
        self.read(html)
        self.end_block()
        self.blocks = self.settle()  # container, text, characters of links

    def read(self, html: str) -> None:
        i, n = 0, len(html)
        while i < n:
            j = html.find("<", i)
            if j < 0 or j == n - 1:
                self.text(html[i:])
                return
            c = html[j + 1]
            if c.isascii() and c.isalpha():
                tag = _NAME.match(html, j + 1)
                end = self.attributes(html, tag.end())
                self.text(html[i:j])
                if end is None:
                    return  # a tag that the page's end cuts off
                attrs, i = end
                name = tag[0].lower()
                self.start(name, attrs, html[i - 2] == "/")
                if name in _RAW:
                    close = _RAW[name].search(html, i)
                    if close is None:
                        return
                    i = close.start()
            elif c == "/" and j + 2 < n and html[j + 2].isascii() and html[j + 2].isalpha():
                tag = _NAME.match(html, j + 2)
                end = self.attributes(html, tag.end())
                self.text(html[i:j])
                if end is None:
                    return
                i = end[1]
                self.end(tag[0].lower())
            elif c in "!?/":
                self.text(html[i:j])
                if html.startswith("<!--", j):
                    close = None if html.startswith((">", "->"), j + 4) else _COMMENT_END.search(html, j + 4)
                    i = html.find(">", j) + 1 if html.startswith((">", "->"), j + 4) else close.end() if close else n
                else:  # a doctype, a marked section, an instruction, or no tag's end
                    i = html.find(">", j + 2) + 1 or n
            else:
                self.text(html[i : j + 1])
                i = j + 1

    @staticmethod
    def attributes(html: str, i: int) -> tuple[dict[str, str], int] | None:
        """The attributes of the tag whose name ends at i (the first of each name), and where the tag ends; None if it doesn't."""
        attrs: dict[str, str] = {}
        n = len(html)
        while True:
            i = _GAP.match(html, i).end()
            if i >= n:
                return None
            if html[i] == ">":
                return attrs, i + 1
            name = _ATTRIBUTE.match(html, i)
            i = name.end()
            value = ""
            if (equal := _EQUAL.match(html, i)) is not None:
                i = equal.end()
                quote = html[i : i + 1]
                if quote in ("'", '"') and quote:
                    j = html.find(quote, i + 1)
                    if j < 0:
                        return None
                    value, i = html[i + 1 : j], j + 1
                else:
                    bare = _BARE.match(html, i)
                    value, i = bare[0], bare.end()
            attrs.setdefault(name[0].lower(), unescape(value) if "&" in value else value)

    def end_block(self) -> None:
        if self.parts:
            if text := " ".join("".join(self.parts).split()):
                self.marked.append((self.at, text, self.links, self.doubt))
                if self.where.get("h1") and self.at >= 0:
                    self.titled.add(self.containers[self.at][0])
            self.parts.clear()
        self.links = 0

    def text(self, data: str) -> None:
        if self.skip < 0 and data:
            if "&" in data:
                data = unescape(data)
            self.parts.append(data)
            if self.link:
                self.links += len(data)

    def push(self, tag: str) -> None:
        place = len(self.open)
        self.open.append((tag, self.at, self.doubt))
        self.where.setdefault(tag, []).append(place)
        if tag in BLOCKS:
            self.blocks_at.append(place)
        if tag in SCOPES:
            self.scopes.append(place)

    def pop(self, place: int) -> None:
        """Close the element at a place and all in it."""
        while len(self.open) > place:
            tag, self.at, self.doubt = self.open.pop()
            if self.doubts_at and self.doubts_at[-1] == len(self.open):
                self.doubts_at.pop()
            if not tag:
                continue
            self.where[tag].pop()
            if tag in BLOCKS:
                self.blocks_at.pop()
            if tag in SCOPES:
                self.scopes.pop()
            if tag == "a" and self.link:
                self.link -= 1
        if place <= self.skip:
            self.skip = -1

    def start(self, tag: str, attrs: dict[str, str], closed: bool) -> None:
        if tag == "br":
            self.text(" ")
            return
        if tag in VOID:
            if tag == "hr" and self.skip < 0:
                self.end_block()
            return
        if self.skip >= 0:  # nothing but the end of what is left out matters
            if not (closed and tag in FOREIGN):
                self.push(tag)
            return
        if tag in BLOCKS:
            self.end_block()
            if tag not in ("html", "body") and (p := self.where.get("p")) and p[-1] > self.scopes[-1]:
                self.pop(p[-1])
        if tag in SELF_CLOSING:
            places = [x[-1] for t in (tag, SELF_CLOSING[tag]) if (x := self.where.get(t))]
            if places and max(places) >= self.scopes[-1]:
                self.pop(max(places))
        kind = _kind(tag, attrs)
        if kind == GONE:
            self.end_block()
            if not (closed and tag in FOREIGN):
                self.skip = len(self.open)
                self.push(tag)
            return
        self.push(tag)
        if kind != WANTED:
            self.end_block()
            self.doubts.append((self.doubt, kind))
            self.doubt = len(self.doubts) - 1
            self.doubts_at.append(len(self.open) - 1)
        if tag in ("article", "main"):
            self.articles.append(self.doubt)
        if tag in CONTAINERS:
            label = ".".join((tag, *sorted(_DIGITS.sub("", attrs.get("class", "")).split())))
            above = self.containers[self.at][0] if self.at >= 0 else -1
            path = self.trie.setdefault((above, label), len(self.labels))
            if path == len(self.labels):
                self.labels.append((above, label))
            self.containers.append((path, self.at))
            self.at = len(self.containers) - 1
        if tag == "a":
            self.link += 1

    def end(self, tag: str) -> None:
        if tag == "br":
            self.text(" ")
            return
        if not (places := self.where.get(tag)):
            return
        place = places[-1]
        doubtful = bool(self.doubts_at) and place <= self.doubts_at[-1]
        if tag in BLOCKS or place == self.skip or not self.blocks_at or place > self.blocks_at[-1] or doubtful and place == self.doubts_at[-1]:
            if (tag in BLOCKS or doubtful) and self.skip < 0:
                self.end_block()
            self.pop(place)
        else:  # blocks go on behind the end of what is around them but no block itself
            places.pop()
            self.open[place] = ("", *self.open[place][1:])
            if tag == "a" and self.link and self.skip < 0:
                self.link -= 1

    def settle(self) -> list[tuple[int, str, int]]:
        """The blocks without those in elements that words leave out. Such an element stays if all articles of the page are in it and it holds
        more than half of the page's text, or 9 tenths in two blocks or more where its words never name a wrapper."""
        n = len(self.doubts)
        sizes, blocks, articles = [0] * n, [0] * n, [0] * n
        for _, text, _, d in self.marked:
            if d >= 0:
                sizes[d] += len(text)
                blocks[d] += 1
        for d in self.articles:
            if d >= 0:
                articles[d] += 1
        for d in range(n - 1, -1, -1):  # what is inside comes behind what is around it
            if (up := self.doubts[d][0]) >= 0:
                sizes[up], blocks[up], articles[up] = sizes[up] + sizes[d], blocks[up] + blocks[d], articles[up] + articles[d]
        total, gone = sum(len(text) for _, text, _, _ in self.marked), [False] * n
        for d, (up, kind) in enumerate(self.doubts):
            most = 2 * sizes[d] > total if kind == WRAPPER else 10 * sizes[d] > 9 * total and blocks[d] > 1
            gone[d] = up >= 0 and gone[up] or not most or articles[d] < len(self.articles)
        return [(at, text, links) for at, text, links, d in self.marked if d < 0 or not gone[d]]

    def scores(self) -> list[int]:
        """Of each container: its characters outside links less those inside; half of what a block adds goes up a container."""
        out = [0] * len(self.containers)
        for at, text, links in self.blocks:
            gain = len(text) - 2 * links
            while at >= 0 and gain > 0:
                out[at] += gain
                gain, at = gain // 2, self.containers[at][1]
        return out

    def name(self, path: int) -> str:
        out = []
        while path >= 0:
            path, label = self.labels[path]
            out.append(label)
        return " ".join(reversed(out))

    def path(self, name: str) -> int:
        """The number of a path by its name; -1 if the page has none."""
        at = -1
        for label in name.split(" "):
            at = self.trie.get((at, label), -2)
            if at == -2:
                return -1
        return at

    def inside(self, path: int) -> list[bool]:
        """Of each container: whether it is on a path, or within one that is."""
        out = [False] * len(self.containers)
        for i, (p, up) in enumerate(self.containers):
            out[i] = p == path or up >= 0 and out[up]
        return out

    def within(self, path: int) -> str:
        inside = self.inside(path)
        return "\n\n".join(text for at, text, _ in self.blocks if at >= 0 and inside[at])

    def widened(self, path: int) -> int:
        """The path of what is around the elements on `path` and belongs to the same article.

        An article element around them is that. Else a path above is, as long as it adds text of which no more than three tenths
        are links, and has text of its own (a heading, an intro: text in no smaller container), or adds a main heading, or a quarter
        of what there is or more. The page's body counts by text of its own alone. What adds no text is passed over.
        """
        up, found = path, path
        while up >= 0:
            above, label = self.labels[up]
            if label.split(".")[0] == "article":
                return up
            up = above
        own: dict[int, list[int]] = {}  # characters in containers of each path itself: all, of links
        for at, text, links in self.blocks:
            if at >= 0:
                x = own.setdefault(self.containers[at][0], [0, 0])
                x[0], x[1] = x[0] + len(text), x[1] + min(links, len(text))
        whole = {p: list(x) for p, x in own.items()}
        for p in range(len(self.labels) - 1, -1, -1):  # a path comes behind the one above it
            if p in whole and (above := self.labels[p][0]) >= 0:
                x = whole.setdefault(above, [0, 0])
                x[0], x[1] = x[0] + whole[p][0], x[1] + whole[p][1]
        titled = {p for p in self.titled if p in own}
        for p in range(len(self.labels) - 1, -1, -1):
            if p in titled:
                titled.add(self.labels[p][0])
        has, up = whole.get(path, [0, 0]), self.labels[path][0]
        while up >= 0:
            now, here = whole.get(up, [0, 0]), own.get(up, [0, 0])
            more, links = now[0] - has[0], now[1] - has[1]
            if more:
                body = self.labels[up][1].split(".")[0] == "body"
                if 10 * links > 3 * more or not (10 * here[1] <= 3 * here[0] > 0 or not body and (up in titled and found not in titled or 4 * (more - links) >= has[0] - has[1])):
                    break
                found, has = up, now
            up = self.labels[up][0]
        return found


def votes(html: str, whole: int = 1000) -> list[tuple[str, int]]:
    """The generalised paths of all containers that score, the best one's vote `whole`, the others' in proportion (those that come to one at least)."""
    page = Page(html)
    by: dict[int, int] = {}
    for (path, _), score in zip(page.containers, page.scores()):
        by[path] = by.get(path, 0) + score
    best = max(by.values(), default=0)
    top = min((page.name(p) for p, s in by.items() if s == best), default="")
    out = [(page.name(p), whole * s // best) for p, s in by.items() if s > 0 and whole * s >= best]
    return sorted(((p, v if v < whole or p == top else whole - 1) for p, v in out), key=lambda x: (-x[1], x[0]))


def extract(html: str, path: str | None) -> str:
    """Blocks within the elements on `path` and around them; if there are none with text, the same from the page's own best path; at last, all blocks."""
    page = Page(html)
    if path is not None and (at := page.path(path)) >= 0 and page.within(at):
        return page.within(page.widened(at))
    by: dict[int, int] = {}
    for (p, _), score in zip(page.containers, page.scores()):
        by[p] = by.get(p, 0) + score
    if by and max(by.values()) > 0:
        return page.within(page.widened(max(by, key=lambda p: (by[p], -p))))
    return "\n\n".join(text for _, text, _ in page.blocks)


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def consensus(pages: DataFrame, least_share: float = 0.5, whole: int = 1000) -> DataFrame:
    """(host, path): each host's winning path, where its pages give one at least `least_share` of their best votes.

    Votes are integers, so that their sums are the same however pages are dealt; ties go to the greatest path name.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            rows = [(host_of(u), p, s) for u, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if h for p, s in votes(h, whole=whole)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 3, (pa.string(), pa.string(), pa.int64()))], names=["host", "path", "vote"])

    cast = pages.select(F.col("url").cast("string").alias("url"), "html").mapInArrow(run, "host string, path string, vote long")
    summed = cast.groupBy("host", "path").agg(F.sum("vote").alias("votes"), F.sum((F.col("vote") == whole).cast("long")).alias("firsts"))
    best = summed.groupBy("host").agg(F.max(F.struct("firsts", "votes", "path")).alias("best"), F.sum("firsts").alias("all"))
    return best.filter(F.col("best.firsts") >= least_share * F.col("all")).select("host", F.col("best.path").alias("path"))


def main_text(pages: DataFrame, salts: int = 16) -> DataFrame:
    """A row per row of `pages`: page_id, url, text. Null and empty html give an empty text; null urls vote as one host."""
    kind = pages.schema["page_id"].dataType.simpleString()

    def hosts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([host_of(u) for u in batch.column(1).to_pylist()], pa.string())], names=["page_id", "url", "html", "host"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            out = [extract(h, p) if h else "" for h, p in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], names=["page_id", "url", "text"])

    winners = stored(consensus(pages)).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    plain = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = plain.mapInArrow(hosts, f"page_id {kind}, url string, html string, host string")
    rows = rows.withColumn("salt", (F.monotonically_increasing_id() % salts).cast("int")).join(winners, ["host", "salt"], "left")
    return rows.select("page_id", "url", "html", "path").mapInArrow(run, f"page_id {kind}, url string, text string")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main texts of pages: page_id, url, text, n_chars.

    Every row of pages keeps its row, repeated ones too; null and empty html, and pages without text, give an empty text. Any
    string is a page. An empty table gives no rows. Other columns of pages are not read.
    """
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("n_chars", F.char_length("text").cast("long"))
