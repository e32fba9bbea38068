"""Main text of web pages: containers are scored per page, hosts vote on their paths, pages are read by the winners.

Of every page the container whose blocks are worth most is found. Its path from the root, with tags and generalised
classes, is a vote for the page's host. Then each page is read again at the path that won most votes among those it has.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streetflow.llm.common import Scratch, broadcast_bytes, with_group

# Elements by what HTML makes of them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp noembed noframes".split())
CONTAINERS = frozenset("body main article section div td form center".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td th dd dt figcaption caption summary".split())
BLOCKS = PROSE | CONTAINERS | frozenset(
    "html head header footer nav aside ul ol dl table thead tbody tfoot tr figure details address fieldset hr dialog menu "
    "hgroup search option noscript template".split())
#: What never belongs to an article. A header does inside an article or main, a form if it holds the article.
APART = frozenset("head nav aside footer noscript template iframe object svg button select datalist dialog menu search audio video canvas "
                  "script style title textarea xmp noembed noframes".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
#: Words of classes and ids that mark what is no article text.
MARKS = frozenset(
    "nav navbar navigation navi menu menubar breadcrumb breadcrumbs topbar masthead footer sidebar sidebars aside widget widgets cookie cookies "
    "consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription signup login register ad ads adv advert adverts "
    "advertisement advertisements advertising adsense adslot adbox adunit sponsor sponsored sponsors promo promos promotion promotions banner banners comment "
    "comments commentlist disqus reply replies respond responses discussion share shares sharing social related recommended recommendations "
    "recommends pagination pager toolbar search searchbox searchform copyright legal feedback reviews skip paywall form contactform".split())
#: The same where they are a whole class or id outside the article.
HEADERS = frozenset("header site-header siteheader top-header global-header main-header header-main".split())
#: Words before a mark that make it a mere property of the page, as in "has-sidebar".
PROPERTY = frozenset("has with without no not is show hide enable disable layout page".split())
#: What a start tag ends if it is still open, and the elements beyond which it does not look.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
        "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
        "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"})}

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<data>.*?)\]\]>|<[!?][^>]*>|"
                     r"<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attributes>(?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)>|<[/!a-zA-Z][^>]*\Z", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_HIDDEN = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)

#: A path needs 1 of so many votes of its host to be kept, so a host keeps at most as many.
PATHS = 50


def general(name: str) -> str:
    """A class or id without what changes from page to page: numbers become #, pieces that mix in digits become *."""
    out = []
    for piece in re.split(r"[-_]+", name.lower()):
        if any(c.isdigit() for c in piece):
            piece = "#" if piece.isdigit() else "*"
        if not (out and piece in "#*" and out[-1] == piece):
            out.append(piece)
    return "-".join(out)


def marked(names: str) -> bool:
    """Whether a class list or id names something that is no article text."""
    for name in names.split():
        words = [w.lower() for w in _WORDS.findall(name)]
        if any(w in MARKS and not (k and words[k - 1] in PROPERTY) for k, w in enumerate(words)):
            return True
    return False


class Page:
    """Elements in page order (parent, path, tag and so on in lists) and text blocks with their element."""

    def __init__(self, source: str):
        self.parent, self.tag, self.path, self.apart, self.marked = [-1], ["#"], [""], [False], [False]
        self.holds, self.article = [False], [0]  # whether it holds an h1 or main; its nearest article or main
        self.blocks: list[tuple[int, str, float]] = []  # element, text, share of it in links
        self._read(source)
        self._settle()

    def _read(self, source: str) -> None:
        stack, texts, at, pos = [0], [], 0, 0
        in_link = muted = 0

        def flush() -> None:
            if texts:
                text = " ".join("".join(t for t, _ in texts).split())
                if text:
                    linked = sum(len(t.strip()) for t, link in texts if link)
                    inner = next(n for n in reversed(stack) if self.tag[n] in BLOCKS or n == 0)
                    self.blocks.append((inner, text, min(1.0, linked / len(text))))
                texts.clear()

        def say(begin: int, end: int) -> None:
            if end > begin and not muted:
                texts.append((entities.unescape(source[begin:end]), in_link > 0))

        def shut(k: int) -> None:
            """Ends the elements of the stack from place ``k`` on."""
            nonlocal in_link, muted
            for n in stack[k:]:
                in_link -= self.tag[n] == "a"
                muted -= self._muted(n)
            del stack[k:]

        while m := _MARKUP.search(source, pos):
            say(at, m.start())
            at = pos = m.end()
            tag = m["tag"]
            if tag is None:
                if m["data"]:
                    texts.append((m["data"], in_link > 0))
                continue
            tag = tag.lower()
            if m["close"]:
                if tag == "br":
                    texts.append((" ", False))
                    continue
                place = next((k for k in range(len(stack) - 1, 0, -1) if self.tag[stack[k]] == tag), 0)
                if tag in BLOCKS:
                    flush()
                elif place and any(self.tag[n] in BLOCKS for n in stack[place + 1:]):
                    continue  # an inline end tag does not end the blocks around it
                if place and tag not in ("html", "body"):
                    shut(place)
                continue
            if tag in VOID:
                if tag == "hr":
                    flush()
                elif tag == "br":
                    texts.append((" ", False))
                continue
            if tag in BLOCKS:
                flush()
                self._end_implied(tag, stack, shut)
            self._open(tag, m["attributes"], stack)
            in_link += tag == "a"
            muted += self._muted(stack[-1])
            if tag in RAW:
                end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>|\Z", re.I).search(source, pos)
                at = pos = end.end()
                shut(len(stack) - 1)
        say(at, len(source))
        flush()

    def _muted(self, n: int) -> bool:
        """Inline elements that stand apart do so at once, as their text is part of the block around them."""
        return self.tag[n] not in BLOCKS and (self.apart[n] or self.marked[n])

    def _end_implied(self, tag: str, stack: list[int], shut) -> None:
        names = [self.tag[n] for n in stack]
        for k in range(len(names) - 1, 0, -1):
            if names[k] == "p":
                shut(k)
                break
            if names[k] in BLOCKS:
                break
        names = names[:len(stack)]
        if "head" in names and tag != "head" and tag not in ("noscript", "template"):
            shut(names.index("head"))
        elif tag in ENDS:
            ended, limit = ENDS[tag]
            first = 0
            for k in range(len(names) - 1, 0, -1):
                if names[k] in limit:
                    break
                if names[k] in ended:
                    first = k
            if first:
                shut(first)
        elif tag[0] == "h" and tag[1:].isdigit() and re.fullmatch(r"h[1-6]", names[-1]):
            shut(len(stack) - 1)

    def _open(self, tag: str, attributes: str, stack: list[int]) -> None:
        n, up = len(self.tag), stack[-1]
        names, apart, mark = [], tag in APART, False
        if attributes and not attributes.isspace():
            for name, *values in _ATTRIBUTE.findall(attributes):
                name, value = name.lower(), "".join(values)
                if name in ("class", "id"):
                    mark |= marked(value)
                    names += [("." if name == "class" else "#") + general(x) for x in value.split()]
                elif name == "role":
                    apart |= value.lower() in ROLES
                elif name == "hidden" or name == "style" and _HIDDEN.search(value):
                    apart = True
                if name in ("class", "id") and not self.article[up]:
                    apart |= any(x in HEADERS for x in value.lower().split())
        apart |= tag == "header" and not self.article[up]
        self.parent.append(up)
        self.tag.append(tag)
        if tag in ("html", "body"):
            apart, mark, names = False, False, []
        self.apart.append(apart)
        self.marked.append(mark or tag == "form")
        self.path.append(f"{self.path[up]}>{tag}{''.join(sorted(set(names)))}")
        self.holds.append(False)
        self.article.append(n if tag in ("article", "main") else self.article[up])
        if tag in ("main", "h1"):
            for k in stack:
                self.holds[k] = True
        stack.append(n)

    def _summed(self, values: list[float]) -> list[float]:
        """Values per element with those of all elements within it."""
        for k in range(len(values) - 1, 0, -1):
            values[self.parent[k]] += values[k]
        return values

    def _settle(self) -> None:
        """Spreads what stands apart downwards and sums up the worth of the blocks of every element."""
        n = len(self.tag)
        size, of_articles = [0] * n, [0] * n
        for at, text, _ in self.blocks:
            size[at] += len(text)
            if self.article[at] and not self.marked[self.article[at]]:
                of_articles[at] += len(text)
        size, of_articles = self._summed(size), self._summed(of_articles)

        def spread(marks: bool) -> list[bool]:
            apart = list(self.apart)
            for k in range(1, n):
                # what holds the article itself is no advert, whatever it is called
                own = marks and self.marked[k] and self.tag[k] != "main" and not (
                    self.holds[k] and 10 * size[k] >= 3 * size[0] or 10 * of_articles[k] > 6 * of_articles[0])
                apart[k] |= apart[self.parent[k]] or own
            return apart

        apart = spread(True)
        self.apart = apart if any(not apart[at] for at, _, _ in self.blocks) else spread(False)
        self._drop_link_lists()
        self.blocks = [b for b in self.blocks if not self.apart[b[0]]]
        in_article = any(self.article[at] for at, _, _ in self.blocks)
        self.worth, self.inside = [0.0] * n, [0.0] * n
        for at, text, linked in self.blocks:
            good = self.article[at] > 0 if in_article else self.tag[at] in PROSE or len(text) >= 80
            # short lines are no sign of an article, nor do they weigh much against one
            short = len(text) < 40 and not (self.article[at] or re.fullmatch("h[1-6]", self.tag[at]))
            self.worth[at] += -25 - len(text) / 2 if not good or linked > 0.5 else -10 if short else len(text)
            self.inside[at] += len(text)
        self.worth, self.inside = self._summed(self.worth), self._summed(self.inside)

    def _drop_link_lists(self) -> None:
        """Lists of three links and more with hardly any other text are menus."""
        lists: dict[int, list[float]] = {}
        for at, text, linked in self.blocks:
            k = at
            while k > 0 and self.tag[k] not in ("ul", "ol", "dl"):
                k = self.parent[k]
            if k > 0:
                seen = lists.setdefault(k, [0, 0.0, 0])
                seen[0] += linked > 0.8
                seen[1] += linked * len(text)
                seen[2] += len(text)
        menus = {k for k, (n, linked, size) in lists.items() if n >= 3 and linked > 0.8 * size}
        if menus:
            for k in range(1, len(self.tag)):
                self.apart[k] |= k in menus or self.apart[self.parent[k]]

    def best(self) -> int:
        """The container worth most, of equal ones the innermost; the root if no text is worth anything."""
        best = 0
        for k in range(1, len(self.tag)):
            if self.tag[k] in CONTAINERS and not self.apart[k] and self.inside[k] and (
                    self.worth[k] > self.worth[best] or self.worth[k] == self.worth[best] and self._within(k, best)):
                best = k
        return best

    def _within(self, k: int, outer: int) -> bool:
        while k > outer:
            k = self.parent[k]
        return k == outer

    def chosen(self, winners: list[str]) -> int:
        """The container at the first winning path that is worth at least half of the page's own best."""
        own = self.best()
        for path in winners:
            at = [k for k in range(len(self.tag)) if self.path[k] == path and not self.apart[k] and self.inside[k]]
            if at:
                k = max(at, key=lambda k: (self.worth[k], -k))
                if 2 * self.worth[k] >= self.worth[own]:
                    return k
        return own

    def text(self, container: int) -> str:
        return "\n".join(text for at, text, _ in self.blocks if self._within(at, container))


def page_host(url: Column) -> Column:
    """Host of an address in lower case, without user and port; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def winning_paths(pages: DataFrame) -> DataFrame:
    """group_key (host), paths (most votes first) and group_rows (votes) from (host, html)."""
    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for source in b.column(1):
                page = Page(source.as_py() or "")
                found.append(page.path[page.best()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.string())], ["host", "path"])

    votes = pages.select("host", "html").mapInArrow(vote, "host string, path string").groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"))
    of_host = votes.withColumn("votes", F.sum("n").over(Window.partitionBy("host")))
    ranked = F.sort_array(F.collect_list(F.when(F.col("n") * PATHS >= F.col("votes"), F.struct(
        (-F.col("n")).alias("order"), (-F.length("path")).alias("shorter"), "path"))))
    return of_host.groupBy(F.col("host").alias("group_key")).agg(
        F.transform(ranked, lambda x: x["path"]).alias("paths"), F.max("votes").alias("group_rows"))


def extract(pages: DataFrame, max_broadcast: int | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row of (page_id, url, html).

    Blocks are joined by one line feed in page order, white space within a block is one blank, character references
    are decoded. A page is read at the path with most votes among those of its host with at least 1 in 50 votes; where
    none of them is worth half of the page's own best container, at that one. Null and empty pages have an empty text,
    pages without a host are voted on together, repeated rows are extracted each, an empty table gives no rows; other
    columns are ignored.
    """
    scratch = Scratch(pages.sparkSession, "main-text")
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"), page_host(F.col("url")).alias("host"))
    joined = with_group(rows, scratch.keep(winning_paths(rows), "paths"), "host", broadcast_bytes(max_broadcast))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for source, paths in zip(b.column(2), b.column(3)):
                page = Page(source.as_py() or "")
                found.append(page.text(page.chosen(paths.as_py() or [])))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    kinds = ", ".join(f"{c} {t}" for c, t in rows.select("page_id", "url").dtypes)
    return joined.select("page_id", "url", "html", "paths").mapInArrow(read, f"{kinds}, text string, n_chars long")
