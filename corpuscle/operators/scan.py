"""Tokens of wikitext, and markup extensions that users add."""

from __future__ import annotations

import codecs
import itertools
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Token classes and their patterns, in the order in which they are tried.
TOKENS = (
    ("comment", r"<!--.*?-->"),
    ("pre_block", r"<(?:pre|nowiki|math|source)\b[^>]*>.*?</(?:pre|nowiki|math|source)\s*>"),
    ("end_tag", r"</\s*[A-Za-z][^<>]*>"),
    ("tag", r"<\s*[A-Za-z][^<>]*>"),
    ("entity", r"&(?:\w+|#\d+|#[xX][0-9A-Fa-f]+);"),
    ("named_url", r"\[(?=(?:https?|ftp|mailto)[:/])"),
    ("url", r"(?:https?|ftp)://[^\s\[\]<>\"|]+|mailto:[^\s\[\]<>\"|]+"),
    ("link_open", r"\[\["),
    ("link_close", r"\]\]"),
    ("template_open", r"\{\{"),
    ("template_close", r"\}\}"),
    ("table_open", r"^[ \t]*\{\|"),
    ("table_close", r"^[ \t]*\|\}"),
    ("row", r"^[ \t]*\|-+"),
    ("caption", r"^[ \t]*\|\+"),
    ("column", r"^[ \t]*[|!]|\|\||!!"),
    ("rule", r"^-{4,}"),
    ("section_end", r"={1,6}[ \t]*$"),
    ("section", r"^={1,6}"),
    ("item", r"^[*#:;]+"),
    ("style", r"'{5}|'{3}|'{2}"),
    ("magic", r"__[A-Z]+__"),
    ("break", r"\n{2,}"),
    ("newline", r"\n"),
    ("pre", r"^ (?=\S)"),
    ("special", r"[\[\]{}|=<>&]"),
    ("text", r"[^\W_]+|[ \t]+|."),
)
_SCANNER = re.compile("|".join(f"(?P<{name}>{pattern})" for name, pattern in TOKENS), re.M | re.S)


def scan(text: str) -> list[tuple[str, int, str]]:
    """(class, position, text) of each token; their texts make up the whole."""
    return [(m.lastgroup, m.start(), m.group()) for m in _SCANNER.finditer(text)]


#: Rows that a task makes before it passes them on.
ROWS_AT_ONCE = 50_000


def token_table(pages: DataFrame) -> DataFrame:
    """(title, pos, class, token) of pages (title, text)."""

    def run(batches):
        rows = ((t, m.start(), m.lastgroup, m.group()) for pdf in batches for t, x in zip(pdf["title"], pdf["text"]) for m in _SCANNER.finditer(x or ""))
        while some := list(itertools.islice(rows, ROWS_AT_ONCE)):
            yield pd.DataFrame(some, columns=["title", "pos", "class", "token"])

    return pages.select("title", "text").mapInPandas(run, "title string, pos long, class string, token string")


#: Extensions by tag: the body of <tag>...</tag> is replaced by what the function returns.
EXTENSIONS: dict[str, Callable[[str, dict[str, str]], str]] = {}


def extension(tag: str):
    """Registers a function (body, attributes) -> text for a tag."""

    def add(function):
        EXTENSIONS[tag] = function
        return function

    return add


@extension("rot13")
def _rot13(body: str, attributes: dict[str, str]) -> str:
    return codecs.encode(body, "rot13")


@extension("poem")
def _poem(body: str, attributes: dict[str, str]) -> str:
    return "\n".join(f":{line}" for line in body.strip("\n").split("\n"))


@extension("listing")
def _listing(body: str, attributes: dict[str, str]) -> str:
    lead = ", ".join(x for x in (attributes.get("name", ""), attributes.get("address", ""), attributes.get("phone", "")) if x)
    return f"* '''{lead}''' {body.strip()}".rstrip()


for _tag in ("see", "buy", "do", "eat", "drink", "sleep"):
    EXTENSIONS[_tag] = _listing
for _tag in ("timeline", "hiero", "idl", "rdf"):
    EXTENSIONS[_tag] = lambda body, attributes: ""
EXTENSIONS["section"] = lambda body, attributes: body


def expand(text: str, extensions: dict[str, Callable[[str, dict[str, str]], str]] | None = None) -> str:
    """text with every registered tag replaced."""
    known = extensions or EXTENSIONS
    tags = "|".join(map(re.escape, known))
    attribute = re.compile(r"([\w-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")

    def one(match: re.Match) -> str:
        found = {k.lower(): a or b or c for k, a, b, c in attribute.findall(match["attrs"] or "")}
        return known[match["tag"].lower()](match["body"] or "", found)

    return re.sub(rf"<(?P<tag>{tags})\b(?P<attrs>[^<>]*?)(?:/>|>(?P<body>.*?)</(?P=tag)\s*>)", one, text, flags=re.S | re.I)


def expand_extensions(pages: DataFrame) -> DataFrame:
    """pages (title, text) with the registered extensions expanded."""

    def run(batches):
        for pdf in batches:
            yield pdf.assign(text=[None if x is None else expand(x) for x in pdf["text"]])

    return pages.select("title", "text").mapInPandas(run, "title string, text string")


def groups_of(items: Column, n: int) -> Column:
    """An array cut into arrays of n; the last may be shorter."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(items), F.lit(1)), F.lit(n))
    return F.filter(F.transform(starts, lambda s: F.slice(items, s, F.lit(n))), lambda x: F.size(x) > 0)
