"""Main text of web pages by line-block distribution.

Markup is stripped to one line for each block element; menus, adverts and the like give no line. Sliding windows of
lines sum the text outside links; the text starts where the sums surge and ends where they dive. Of these stretches the
one that holds most text is widened to the bounds of the element it lies in, an article element where there is one,
and all lines between the bounds are the main text. Where one article element has text, only its lines have weight.
Readers' comments are told by name, by microdata, or as siblings alike that each show an author or a time and a reply link.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

#: Lines in a window, and the share of the largest window that counts as a surge.
WINDOW, SURGE = 3, 0.2

# Element names of HTML and names that sites give to parts around the article.
_RAW = "script style textarea title xmp noframes"
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small"
    " span strike strong sub sup time tt u var wbr".split()
)
_NOISE = frozenset(
    "nav footer aside script style noscript template iframe object svg button select option textarea"
    " title head menu dialog input canvas audio video map".split()
)
_HOLDERS = frozenset(("article", "main"))
_NEVER = frozenset("html body article main h1".split())
_NOISE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs consent cookie"
    " cookies footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices pager"
    " pagination paywall popup promo promoted promotion related recommended search share sharing sidebar"
    " signup social sponsor sponsored subscribe subscription toolbar topbar widget header alert".split()
)
_COMMENT_NAMES = frozenset("comment comments disqus reply replies respond responses discussion discussions".split())
#: Parts of a name that tell comments whatever else it holds, unless one of the states is among them.
_COMMENT_PART = re.compile(
    "(?:all|article|blog|entry|facebook|fb|news|page|post|reader|user|wp)?comment"
    "(?:s|area|block|body|box|container|count|er|ers|form|group|item|list|lists|meta|section|stream|text|thread|threads|wrap|wrapper)?"
    "|disqus|wpdiscuz|livefyre"
)
_STATES = frozenset("no not has have with without open opened closed on off enabled disabled allow allowed".split())
#: Names of parts that say who wrote something and when, and texts of links that answer it.
_BYLINES = frozenset("author byline avatar user username commenter poster date time timestamp posted when".split())
_REPLY = frozenset("reply|respond|answer|antworten|répondre|responder|contestar|rispondi|beantwoorden|odpowiedz|ответить|返信|回复".split("|"))
#: What a name may hold beside these and still mean the same: site-footer and sidebar-left, not no-sidebar or ad-free.
_PLAIN_NAMES = frozenset(
    "area bar block bottom box column container fixed global inner item items left links list main page primary right"
    " secondary section site slot sticky top unit wrap wrapper".split()
)
_NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
#: What an opening tag closes if it is open: paragraphs at any block, items at the next item.
_SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}


def _token(quoted: str):
    """Comments, raw elements with their content, tags, and what is left of '<': quoted is what a quoted value may hold."""
    rest = rf"(?:[^>\"']++|\"[^\"{quoted}]*+\"|'[^'{quoted}]*+')*+"
    return re.compile(
        r"<!--.*?(?:-->|\Z)"
        rf"|<(?P<raw>{'|'.join(_RAW.split())})\b{rest}>.*?(?:</(?P=raw)\s*>|\Z)"
        rf"|<(?P<close>/?)(?P<name>[a-zA-Z][\w:-]*)(?P<rest>{rest})>"
        r"|(?P<odd><[/!?a-zA-Z][^>]*+(?:>|\Z))",
        re.S | re.I,
    )


#: Once a tag has no end outside quotes, quoted values end at the next '<', so that no page is scanned over and over.
_TOKEN, _TOKEN_SHORT = _token(""), _token("<")
_ATTRIBUTE = re.compile(r"([\w:-]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NAME_PARTS = re.compile(r"[^a-z0-9]+")
#: Kinds of noise: SOFT is text after all where it holds most of a page, COMMENTS only with a main heading, HARD never is.
_SOFT, _COMMENTS, _HARD = 1, 2, 3
#: What shows that an element is a comment: a byline and a link to answer it.
_BYLINE, _ANSWER = 1, 2


def _named(value: str, names: frozenset[str]) -> set[str]:
    """The names that whole class tokens stand for."""
    found = set()
    for token in value.split():
        parts = {x for x in _NAME_PARTS.split(token) if x and not x.isdigit()}
        if parts & names and not parts - names - _PLAIN_NAMES:
            found |= parts & names
    return found


def _attributes(rest: str) -> dict[str, str]:
    return {k.lower(): (a or b or c or "").lower() for k, a, b, c in _ATTRIBUTE.findall(rest)} if rest else {}


def _comments(name: str, found: dict[str, str]) -> int:
    """HARD for names and microdata that only comments have, COMMENTS for names that hold such a name, 0 for others."""
    if found.get("itemprop") == "comment" or found.get("itemtype", "").endswith("schema.org/comment"):
        return _HARD
    # an article may have a part named discussion by its id
    value = found.get("class", "") + " " + " ".join(t for t in found.get("id", "").split() if not t.startswith("discussion"))
    if name != "section" and not re.fullmatch("h[1-6]", name) and _named(value, _COMMENT_NAMES):
        return _HARD
    for token in value.split():
        parts = set(_NAME_PARTS.split(token))
        if not parts & _STATES and any(_COMMENT_PART.fullmatch(x) for x in parts):
            return _COMMENTS
    return 0


def _noise(name: str, found: dict[str, str], inside: bool) -> int:
    if name in _NEVER - {"article"} or (name == "article" and not found):
        return 0
    if name in _NOISE:
        return _HARD
    if name in ("header", "form") and not (name == "header" and inside):
        return max(_SOFT, _comments(name, found))
    if not found:
        return 0
    comments = _comments(name, found)
    if name == "article":
        return comments if inside else 0
    if "hidden" in found or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", "")):
        return _HARD
    if comments:
        return comments
    names = _named(f"{found.get('class', '')} {found.get('id', '')}", _NOISE_NAMES)
    return _SOFT if names - {"header"} or (names and not inside) or found.get("role") in _NOISE_ROLES else 0


class _Walk:
    """One pass over a page: its lines, the ranges of lines of its block elements, its soft noise and what looks like comments.

    Each tag costs the same however deep it lies: open elements are found by name, blocks by a list of their own.
    """

    def __init__(self, page: str, kept: frozenset[int] = frozenset(), dropped: frozenset[int] = frozenset()) -> None:
        self.kept, self.dropped = kept, dropped  # numbers of soft noise that is text after all, and of comments
        self.lines: list[tuple[str, int, int, int]] = []  # text, weight, parent of its block, outermost article
        self.ranges: list[list[int]] = [[0, 0]]  # of lines, for each block element
        self.soft: list[tuple[int, int, int, int, str, int]] = []  # number; characters, article elements and main headings in it; name, kind
        self.chars = self.holders = self.heads = 0  # characters outside links and hard noise, article elements and main headings
        self.stack: list[tuple[str, int, int, int, tuple[int, int, int, int, int] | None]] = []  # name, block, noise, article, soft
        self.frames: list[list] = [[0, "", 0, 0]]  # for the page and each open element: number, class, signs of a comment, characters before
        self.alike: dict[tuple[int, str, str], list[tuple[int, int]]] = {}  # (parent, name, class) -> blocks like comments: number, characters
        self.articles: set[int] = set()  # blocks of article elements with a main heading
        self.blocks: list[int] = []  # places in the stack
        self.places: dict[str, list[int]] = {}
        self.parts: list[str] = []
        self.weight = self.links = 0
        token, at, number = _TOKEN, 0, 0
        while m := token.search(page, at):
            if m.start() > at:
                self._text(page[at : m.start()])
            at = m.end()
            if m["odd"] and token is _TOKEN:
                token = _TOKEN_SHORT
            name = (m["name"] or "").lower()
            if name == "hr":
                self._flush()
            elif name == "br":
                if not self._noise():
                    self.parts.append(" ")
            elif name and name not in _VOID:
                if m["close"]:
                    self._close(name)
                else:
                    number += 1
                    self._open(name, m["rest"], number)
        if at < len(page):
            self._text(page[at:])
        self._flush()
        self._pop(0)

    def _noise(self) -> int:
        return self.stack[-1][2] if self.stack else 0

    def _text(self, text: str) -> None:
        noise, n = self._noise(), 0 if self.links else len(text.strip())
        if (self.links or self.stack and self.stack[-1][0] == "button") and len(text) < 40 and text.strip().lower() in _REPLY:
            self.frames[-1][2] |= _ANSWER
        if noise != _HARD:
            self.chars += n
        if not noise:
            self.parts.append(text)
            self.weight += n

    def _flush(self) -> None:
        text = " ".join(html.unescape("".join(self.parts)).split())
        self.parts.clear()
        if text:
            parent = self.stack[self.blocks[-2 if len(self.blocks) > 1 else -1]][1] if self.blocks else 0
            self.lines.append((text, self.weight, parent, self.stack[-1][3] if self.stack else 0))
        self.weight = 0

    def _pop(self, to: int) -> None:
        while len(self.stack) > to:
            name, block, _, _, soft = self.stack.pop()
            number, look, signs, before = self.frames.pop()
            self.frames[-1][2] |= signs
            if block and signs == _BYLINE | _ANSWER:
                self.alike.setdefault((self.frames[-1][0], name, look), []).append((number, self.chars - before))
            self.places[name].pop()
            self.links -= name == "a"
            if block:
                self.blocks.pop()
                self.ranges[block][1] = len(self.lines)
            if soft:
                number, chars, holders, heads, kind = soft
                self.soft.append((number, self.chars - chars, self.holders - holders, self.heads - heads, name, kind))

    def _close(self, name: str) -> None:
        places = self.places.get(name)
        if not places:
            return
        last = self.blocks[-1] if self.blocks else -1
        if name in _INLINE and last > places[-1]:
            return
        if last >= places[-1]:
            self._flush()
        self._pop(places[-1])

    def _open(self, name: str, rest: str, number: int) -> None:
        block = name not in _INLINE
        if block:
            self._flush()
            closes, k = (*_SIBLINGS.get(name, ()), "p"), len(self.blocks)
            while k and self.stack[self.blocks[k - 1]][0] in closes:
                k -= 1
            if k < len(self.blocks):
                self._pop(self.blocks[k])
        elif rest.endswith("/"):
            return
        _, _, noise, article, _ = self.stack[-1] if self.stack else ("", 0, 0, 0, None)
        found = _attributes(rest)
        own = _HARD if number in self.dropped else _noise(name, found, article > 0)
        soft = (number, self.chars, self.holders, self.heads, own) if own in (_SOFT, _COMMENTS) else None
        if soft and number in self.kept:
            own = 0
        if noise != _HARD:
            self.holders += name in _HOLDERS or name == "h1"
            self.heads += name == "h1"
        if own and not block and self.parts:
            self.parts.append(" ")
        if block:
            self.blocks.append(len(self.stack))
            self.ranges.append([len(self.lines), len(self.lines)])
        made = len(self.ranges) - 1 if block else 0
        self.places.setdefault(name, []).append(len(self.stack))
        article = article or (made if name in _HOLDERS else 0)
        if name == "h1" and not max(noise, own):
            self.articles.add(article)
        self.stack.append((name, made, max(noise, own), article, soft))
        named = found and set(_NAME_PARTS.split(f"{found.get('class', '')} {found.get('rel', '')} {found.get('itemprop', '')}"))
        self.frames.append([number, found.get("class", ""), _BYLINE if name in ("time", "cite") or named and named & _BYLINES else 0, self.chars])
        self.links += name == "a"


def _walk(page: str) -> _Walk:
    """Soft noise that holds over half of a page's text is none: a wrapper with an article in it, or a form around it all.

    Two or more siblings of one name and class that each hold a byline and a link to answer are comments, if what is
    left of the page has at least as much text as one of them has on average; else they are what the page is about.
    """
    walk = _Walk(page)
    most = lambda chars: 2 * chars > walk.chars
    kept = frozenset(n for n, chars, holders, heads, name, kind in walk.soft if most(chars) and (heads if kind == _COMMENTS else holders or name == "form"))
    items = [x for group in walk.alike.values() if len(group) > 1 for x in group]
    chars = sum(n for _, n in items)
    dropped = frozenset(n for n, _ in items) if items and (walk.chars - chars) * len(items) >= chars else frozenset()
    return _Walk(page, kept, dropped) if kept or dropped else walk


def stretches(weights: list[int]) -> list[tuple[int, int]]:
    """[surge, dive) stretches: from where a window's sum rises over the threshold to where the sums fall to nothing."""
    sums = [sum(weights[k : k + WINDOW]) for k in range(len(weights))]
    least, out, start = max(sums) * SURGE, [], None
    for k, total in enumerate(sums):
        if start is None and total > least:
            start = k
        elif start is not None and not weights[k] and total <= least:
            out.append((start, k))
            start = None
    return [*out, (start, len(sums))] if start is not None else out


def _heaviest(weights: list[int], keys: list[int]) -> int:
    """The key with the largest sum of weights, of equal ones the least."""
    sums: dict[int, int] = {}
    for key, weight in zip(keys, weights):
        sums[key] = sums.get(key, 0) + weight
    return max(sums, key=lambda k: (sums[k], -k))


def main_text(page: str | None) -> str:
    """The article of a page: its blocks in page order, joined by a line feed; empty if there is no text."""
    walk = _walk(page or "")
    weights = [x[1] for x in walk.lines]
    if not any(weights):
        return ""
    articles = {x[3] for x in walk.lines if x[1] and x[3]}
    if len(articles) > 1:
        articles &= walk.articles
    if len(articles) == 1:
        weights = [x[1] if x[3] in articles else 0 for x in walk.lines]
    first, last = max(stretches(weights), key=lambda s: sum(weights[s[0] : s[1]]))
    inside = walk.lines[first:last]
    article = _heaviest(weights[first:last], [x[3] for x in inside])
    if article:
        first, last = walk.ranges[article]
    else:
        heavy = [k for k in range(first, last) if weights[k]]  # a stretch may begin and end with lines of mere links
        first, last = heavy[0], heavy[-1] + 1
        holder = _heaviest(weights[first:last], [x[2] for x in walk.lines[first:last]])
        if holder:
            first, last = min(first, walk.ranges[holder][0]), max(last, walk.ranges[holder][1])
    return "\n".join(x[0] for x in walk.lines[first:last])


def _extract(batches):
    for batch in slices(batches):
        texts = [main_text(x) for x in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )


def extract_text(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) -> (page_id, url, text, n_chars), a row for each row of pages.

    Null or empty html gives an empty text. Nothing is shuffled; rows that repeat come out as often. Malformed
    markup (unclosed tags, stray '<') is read as browsers mostly do: a closing tag closes all it encloses.
    """
    return pages.select("page_id", "url", "html").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
