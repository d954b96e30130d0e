"""Markup trees of single documents: a small wikitext parser, rewrites that tidy a tree, and plain text.

A tree fits one row, so a corpus of them is cleaned without a shuffle, document by document.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

INLINE_STYLES = frozenset("Big Cite Code Deleted Emphasized Inserted Italic Overline Small Strike Strong Sub Sup Teletyped Underline Var".split())
TEXT_STYLES = frozenset("Italic Emphasized Strong Overline Underline Sub Sup Small Big Var".split())
BLOCKS = frozenset("Article Section Paragraph ItemList Item Table Row Cell PreFormatted Blockquote Center Div Gallery DefinitionList DefinitionTerm DefinitionDescription ReferenceList HorizontalRule Chapter".split())
# What may stand without children, what hides, and what may not stand where.
CHILDLESS = frozenset("ArticleLink BreakingReturn CategoryLink Cell Chapter Code HorizontalRule ImageLink InterwikiLink LangLink Link Math NamedURL NamespaceLink ReferenceList Reference SpecialLink Text URL".split())
NO_PRINT = frozenset("dablink editlink metadata noprint portal sisterproject NavFrame geo-multi-punct coordinates_3_ObenRechts microformat coordinates navbox".split())
FORBIDDEN_ABOVE = {
    "ImageLink": {"PreFormatted"}, "ItemList": {"Div", "PreFormatted"}, "Source": INLINE_STYLES | {"Center", "PreFormatted"},
    "DefinitionList": {"Paragraph"}, "Blockquote": {"PreFormatted"}, "Center": {"PreFormatted"}, "Paragraph": {"PreFormatted"},
    "Section": {"PreFormatted"}, "Gallery": {"PreFormatted"},
}
UNWRAP_UNDER = {"PreFormatted": {"Reference", "PreFormatted"}, "Cite": {"Item", "Reference"}, "Code": {"PreFormatted"}, "ImageLink": {"Reference"}, "Div": {"Reference"}}
SWAP = {"Center": {"Underline", "Emphasized"}}
ONLY_CHILDREN = {"Gallery": {"ImageLink"}}
SPLIT_IDS = frozenset(("mp-upper",))
#: Style keys that children don't take over.
OWN_STYLES = frozenset("width height margin padding border float display position top left right bottom clear overflow z-index background page-break-after".split())
_HIDES_OUTSIDE = frozenset(("Table", "Section"))


class Node:
    __slots__ = ("kind", "caption", "target", "attrs", "children", "parent")

    def __init__(self, kind: str, caption: str = "", children: list[Node] | None = None, target: str = "", attrs: dict[str, str] | None = None) -> None:
        self.kind, self.caption, self.target, self.attrs = kind, caption, target, attrs or {}
        self.children: list[Node] = []
        self.parent: Node | None = None
        if children:
            self.put(children)

    def put(self, children: list[Node]) -> None:
        self.children = list(children)
        for child in self.children:
            child.parent = self

    def add(self, *children: Node) -> None:
        """Puts children after those that are there; the time does not depend on how many these are."""
        for child in children:
            child.parent = self
        self.children.extend(children)

    def replace(self, child: Node, by: list[Node]) -> None:
        at = next(k for k, c in enumerate(self.children) if c is child)
        self.put(self.children[:at] + by + self.children[at + 1 :])

    def drop(self) -> None:
        if self.parent:
            self.parent.replace(self, [])

    def unwrap(self) -> None:
        if self.parent:
            self.parent.replace(self, self.children)

    def walk(self) -> Iterator[Node]:
        """This node and all below, parents first; what a caller changes below a node counts as long as it isn't passed."""
        left = [self]
        while left:
            node = left.pop()
            yield node
            left.extend(reversed(node.children))

    def of(self, *kinds: str) -> list[Node]:
        return [n for n in self.walk() if n.kind in kinds]

    def above(self) -> list[Node]:
        """Ancestors from outside in."""
        out, node = [], self.parent
        while node:
            out.append(node)
            node = node.parent
        return out[::-1]

    def text(self) -> str:
        return "".join(n.caption for n in self.walk() if n.kind in ("Text", "PreFormatted", "Math"))

    def beside(self, step: int) -> Node | None:
        if not self.parent:
            return None
        at = next(k for k, c in enumerate(self.parent.children) if c is self) + step
        return self.parent.children[at] if 0 <= at < len(self.parent.children) else None

    def styles(self) -> dict[str, str]:
        pairs = (x.split(":", 1) for x in self.attrs.get("style", "").split(";") if ":" in x)
        return {k.strip().lower(): v.strip().lower() for k, v in pairs}

    def number(self, name: str) -> int:
        value = self.attrs.get(name, "1")
        return max(1, int(value)) if value.isdigit() else 1


# --- parsing

_INLINE = re.compile(
    r"'''''(?P<both>.+?)'''''|'''(?P<strong>.+?)'''|''(?P<em>.+?)''|\[\[(?P<link>[^\[\]]*(?:\[\[[^\[\]]*\]\][^\[\]]*)*)\]\]"
    r"|\[(?P<url>(?:https?|ftp)://[^\s\]]+)(?:\s+(?P<named>[^\]]*))?\]|(?P<bare>(?:https?|ftp)://[^\s<>\]]+)"
    r"|<(?P<tag>ref|math|nowiki|code|cite|center|small|big|sub|sup|u|s|del|ins|b|i|em|strong|div|span|blockquote|gallery|source|tt|var)\b(?P<attrs>[^<>]*?)(?:/>|>(?P<body>.*?)</(?P=tag)\s*>)"
    r"|<references[^<>]*/>|<br\s*/?>",
    re.S | re.I,
)
_TAGS = {"b": "Strong", "strong": "Strong", "i": "Emphasized", "em": "Emphasized", "u": "Underline", "s": "Strike", "del": "Deleted", "ins": "Inserted", "tt": "Teletyped", "ref": "Reference"}
_ATTRIBUTE = re.compile(r"([\w-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_HEADING = re.compile(r"^(={1,6})\s*(.+?)\s*\1\s*$")


def _attributes(text: str | None) -> dict[str, str]:
    return {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(text or "")}


def _link(text: str) -> Node:
    target, _, label = text.partition("|")
    plain = target.lstrip(":").strip()
    prefix = plain.partition(":")[0].lower() if ":" in plain else ""
    visible = target.strip().startswith(":")
    if prefix in ("image", "file"):
        kind = "ImageLink"
    elif prefix == "category" and not visible:
        kind = "CategoryLink"
    elif re.fullmatch(r"[a-z]{2,3}", prefix) and not visible:
        kind = "LangLink"
    else:
        kind = "NamespaceLink" if prefix else "ArticleLink"
    shown = label.rsplit("|", 1)[-1] if kind == "ImageLink" else label
    return Node(kind, target=plain, children=inline(shown) if label else [], attrs={"colon": "1"} if visible else {})


def inline(text: str) -> list[Node]:
    if not ("''" in text or "[" in text or "<" in text or "://" in text):  # every kind of markup has one of these
        return [Node("Text", text)] if text else []
    out, at = [], 0
    for m in _INLINE.finditer(text):
        if m.start() > at:
            out.append(Node("Text", text[at : m.start()]))
        at = m.end()
        if m["both"]:
            out.append(Node("Strong", children=[Node("Emphasized", children=inline(m["both"]))]))
        elif m["strong"]:
            out.append(Node("Strong", children=inline(m["strong"])))
        elif m["em"]:
            out.append(Node("Emphasized", children=inline(m["em"])))
        elif m["link"] is not None:
            out.append(_link(m["link"]))
        elif m["url"]:
            out.append(Node("NamedURL", target=m["url"], children=inline(m["named"] or "")))
        elif m["bare"]:
            out.append(Node("URL", target=m["bare"]))
        elif m["tag"]:
            tag, body = m["tag"].lower(), m["body"] or ""
            if tag in ("math", "nowiki"):
                out.append(Node("Math" if tag == "math" else "Text", body))
            elif tag == "gallery":
                out.append(Node("Gallery", children=[_link(x.strip()) for x in body.splitlines() if x.strip()], attrs=_attributes(m["attrs"])))
            else:
                out.append(Node(_TAGS.get(tag, tag.capitalize()), children=inline(body), attrs=_attributes(m["attrs"])))
        else:
            out.append(Node("BreakingReturn" if m.group(0).lower().startswith("<br") else "ReferenceList"))
    if at < len(text):
        out.append(Node("Text", text[at:]))
    return out


def _strip_templates(text: str) -> str:
    while "{{" in text and (plain := re.sub(r"\{\{[^{}]*\}\}", "", text)) != text:
        text = plain
    return text


def _table(lines: list[str], at: int) -> tuple[Node, int]:
    table = Node("Table", attrs=_attributes(lines[at][2:]))
    rows: list[Node] = [Node("Row")]
    at += 1
    while at < len(lines) and not lines[at].lstrip().startswith("|}"):
        line = lines[at].lstrip()
        if line.startswith("{|") and rows[-1].children:
            inner, at = _table(lines, at)
            rows[-1].children[-1].add(inner)
            continue
        if line.startswith("|-"):
            rows.append(Node("Row", attrs=_attributes(line)))
        elif line.startswith("|+"):
            table.add(Node("Caption", children=inline(line[2:].strip())))
        elif line[:1] in ("|", "!"):
            for cell in re.split(r"\|\||!!", line[1:]):
                head, bar, body = cell.partition("|")
                styled = bar and "=" in head and "[[" not in head
                rows[-1].add(Node("Cell", children=inline((body if styled else cell).strip()), attrs=_attributes(head) if styled else {}))
        elif rows[-1].children:
            rows[-1].children[-1].add(*inline("\n" + line))
        at += 1
    table.add(*[r for r in rows if r.children])
    return table, at + 1


def _items(lines: list[str], depth: int) -> list[Node]:
    """Nested lists of lines that start with * # ; or :, however deep."""
    top = Node("Lists")
    left = [(lines, depth, top)]
    while left:
        lines, depth, holder = left.pop()
        out: list[Node] = []
        at = 0
        while at < len(lines):
            mark = lines[at][depth]
            end = at
            while end < len(lines) and len(lines[end]) > depth and lines[end][depth] == mark:
                end += 1
            kind = {"*": "ItemList", "#": "ItemList"}.get(mark, "DefinitionList")
            items: list[Node] = []
            k = at
            while k < end:
                deeper = k + 1
                while deeper < end and len(lines[deeper]) > depth + 1 and lines[deeper][depth + 1] in "*#;:":
                    deeper += 1
                own = lines[k][depth + 1 :]
                nested = own[:1] and own[0] in "*#;:"
                item = Node({";": "DefinitionTerm", ":": "DefinitionDescription"}.get(mark, "Item"), children=[] if nested else inline(own.strip()))
                items.append(item)
                left.append((lines[k + (not nested) : deeper], depth + 1, item))
                k = deeper
            out.append(Node(kind, children=items, attrs={"numbered": "1"} if mark == "#" else {}))
            at = end
        holder.add(*out)
    return top.children


def parse(text: str, title: str = "") -> Node:
    """The tree of a page: sections by heading, paragraphs, lists, tables, preformatted text, inline markup. Templates go."""
    root = Node("Article", caption=title)
    stack: list[tuple[int, Node]] = [(0, root)]
    lines = _strip_templates(re.sub(r"<!--.*?-->", "", text, flags=re.S) if "<!--" in text else text).split("\n")
    buffer: list[str] = []

    def add(node: Node) -> None:
        stack[-1][1].add(node)

    def flush() -> None:
        if any(x.strip() for x in buffer):
            add(Node("Paragraph", children=inline("\n".join(buffer).strip())))
        buffer.clear()

    at = 0
    while at < len(lines):
        line = lines[at]
        if line.startswith("=") and (m := _HEADING.match(line)):
            flush()
            level = len(m[1])
            while stack[-1][0] >= level:
                stack.pop()
            section = Node("Section", caption=m[2], attrs={"level": str(level)}, children=[Node("Caption", children=inline(m[2]))])
            add(section)
            stack.append((level, section))
        elif line.lstrip().startswith("{|"):
            flush()
            table, at = _table(lines, at)
            add(table)
            continue
        elif line[:1] and line[0] in "*#;:":
            flush()
            end = at
            while end < len(lines) and lines[end][:1] and lines[end][0] in "*#;:":
                end += 1
            for node in _items(lines[at:end], 0):
                add(node)
            at = end
            continue
        elif line.startswith("----"):
            flush()
            add(Node("HorizontalRule"))
        elif line.startswith(" ") and line.strip():
            flush()
            end = at
            while end < len(lines) and lines[end].startswith(" ") and lines[end].strip():
                end += 1
            add(Node("PreFormatted", children=[Node("Text", "\n".join(x[1:] for x in lines[at:end]))]))
            at = end
            continue
        elif not line.strip():
            flush()
        else:
            buffer.append(line)
        at += 1
    flush()
    return root


# --- passes


def remove_empty_text(root: Node) -> None:
    for n in root.of("Text"):
        before, after = n.beside(-1), n.beside(1)
        if not n.caption or (not n.caption.strip() and (before is None or before.kind in BLOCKS) and (after is None or after.kind in BLOCKS)):
            n.drop()


def remove_invisible_links(root: Node) -> None:
    for n in root.of("CategoryLink", "LangLink"):
        if "colon" not in n.attrs:
            n.drop()


def clean_section_captions(root: Node) -> None:
    for section in root.of("Section"):
        for caption in [c for c in section.children if c.kind == "Caption"][:1]:
            if not caption.text().strip():
                section.replace(caption, [Node("BreakingReturn")])
            for n in caption.walk():
                if n is not caption and n.kind in BLOCKS:
                    n.unwrap()


def remove_childless(root: Node) -> None:
    for n in list(root.walk())[::-1]:
        if n.parent and not n.children and n.kind not in CHILDLESS and n.parent is not None:
            n.drop()


def remove_no_print(root: Node) -> None:
    for n in root.walk():
        if n.parent and NO_PRINT & {*n.attrs.get("class", "").split(), n.attrs.get("id", "")}:
            n.drop()


def remove_invisible(root: Node) -> None:
    for n in root.walk():
        style = n.styles()
        if n.parent and (style.get("display") == "none" or style.get("visibility") == "hidden"):
            n.drop()


def remove_list_only_paragraphs(root: Node) -> None:
    for n in root.of("Paragraph"):
        if n.children and all(c.kind == "ItemList" for c in n.children):
            n.unwrap()


def fix_paragraphs(root: Node) -> None:
    moved = True
    while moved:
        moved = False
        for n in root.of("Paragraph"):
            before = n.beside(-1)
            if before is not None and before.kind == "Section":
                n.drop()
                home = before.children[-1] if before.children and before.children[-1].kind == "Section" else before
                home.put([*home.children, n])
                moved = True
                break


def simplify_blocks(root: Node) -> None:
    for n in root.of("Paragraph"):
        if len(n.children) == 1 and n.children[0].kind in BLOCKS:
            n.unwrap()


def fix_nesting(root: Node) -> None:
    """A node under a forbidden ancestor splits that ancestor into what stands before it, itself, and what follows."""
    while True:  # each split takes a node out of a forbidden ancestor and puts none into one
        for n in root.walk():
            bad = FORBIDDEN_ABOVE.get(n.kind, frozenset())
            chain = n.above()
            hidden = max((k for k, a in enumerate(chain) if a.kind in _HIDES_OUTSIDE), default=-1)
            top = next((a for a in chain[hidden + 1 :] if a.kind in bad and a.parent), None)
            if top:
                _split(top, n)
                break
        else:
            return


def _split(top: Node, middle: Node) -> None:
    def copy(n: Node, children: list[Node]) -> Node:
        return Node(n.kind, n.caption, children, n.target, dict(n.attrs))

    before, after, node = [], [], middle
    while node is not top:
        siblings = node.parent.children
        at = next(k for k, c in enumerate(siblings) if c is node)
        before, after = siblings[:at] + before, after + siblings[at + 1 :]
        node = node.parent
        if node is not top:
            before, after = [copy(node, before)] if before else [], [copy(node, after)] if after else []
    parts = ([copy(top, before)] if before else []) + [middle] + ([copy(top, after)] if after else [])
    top.parent.replace(top, parts)


def _cells(table: Node) -> list[list[Node]]:
    return [[c for c in row.children if c.kind == "Cell"] for row in table.children if row.kind == "Row"]


def remove_critical_tables(root: Node) -> None:
    for table in root.of("Table"):
        if "navbox" in table.attrs.get("class", "").split() and table.parent:
            table.parent.replace(table, [x for row in _cells(table) for cell in row for x in cell.children])


def remove_textless_styles(root: Node) -> None:
    for n in list(root.walk())[::-1]:
        if n.kind in TEXT_STYLES and n.parent and not n.text().strip():
            n.unwrap()


def remove_broken_children(root: Node) -> None:
    for n in root.walk():
        if n.kind in UNWRAP_UNDER and n.parent and any(a.kind in UNWRAP_UNDER[n.kind] for a in n.above()):
            n.unwrap()


def fix_colspans(root: Node) -> None:
    for table in root.of("Table"):
        rows = _cells(table)
        widest = max([sum(c.number("colspan") for c in row) for row in rows if len(row) > 1], default=1)
        for row in rows:
            if len(row) == 1 and row[0].number("colspan") > widest:
                row[0].attrs["colspan"] = str(widest)


def single_column_tables(root: Node) -> None:
    for table in root.of("Table"):
        rows = _cells(table)
        if table.parent and rows and all(len(row) == 1 for row in rows) and "box" not in table.attrs.get("class", ""):
            short = len(table.text()) <= 5000
            parts = [Node("Div", children=row[0].children) for row in rows] if short else [x for row in rows for x in row[0].children]
            table.parent.replace(table, parts)


def split_tables_to_columns(root: Node) -> None:
    for table in root.of("Table"):
        rows = _cells(table)
        big = any(len(c.text()) > 5000 or any(max(map(len, _cells(t)), default=0) > 30 or len(_cells(t)) > 40 for t in c.of("Table")) for row in rows for c in row)
        if table.parent and (big or SPLIT_IDS & {table.attrs.get("id", ""), *table.attrs.get("class", "").split()}):
            width = max(map(len, rows), default=0)
            table.parent.replace(table, [x for k in range(width) for row in rows if k < len(row) for x in row[k].children])


def linearize_wide_tables(root: Node) -> None:
    for table in root.of("Table"):
        outer = [a for a in table.above() if a.kind == "Table"]
        if outer and max(map(len, _cells(table)), default=0) > 15:
            for t in outer:
                if t.parent:
                    t.parent.replace(t, [x for row in _cells(t) for c in row for x in c.children])


def remove_breaking_returns(root: Node) -> None:
    for n in root.of("BreakingReturn"):
        before, after = n.beside(-1), n.beside(1)
        edge = n.parent is not None and n.parent.kind in BLOCKS and (before is None or after is None)
        if edge or any(x is not None and (x.kind in BLOCKS) for x in (before, after)) or (after is not None and after.kind == "BreakingReturn"):
            n.drop()


def remove_empty_reference_lists(root: Node) -> None:
    if root.of("Reference"):
        return
    for n in root.of("ReferenceList"):
        section = n.parent
        if section and section.kind == "Section" and section.parent and not "".join(c.text() for c in section.children if c.kind != "Caption").strip():
            section.drop()


def swap_nodes(root: Node) -> None:
    for n in root.walk():
        p = n.parent
        if p and p.parent and n.kind in SWAP and p.kind in SWAP[n.kind] and len(p.children) == 1:
            outer = p.parent
            p.put(n.children)
            outer.replace(p, [n])
            n.put([p])


def remove_big_sections_from_cells(root: Node) -> None:
    for section in root.of("Section"):
        table = next((a for a in section.above() if a.kind == "Table"), None)
        if table and table.parent and len(section.text()) > 2000:
            section.drop()
            table.parent.replace(table, [table, section])


def transform_nested_tables(root: Node) -> None:
    for table in root.of("Table"):
        cells = [c for row in _cells(table) for c in row]
        inner = [x for c in cells for x in c.children if x.kind == "Table"]
        bare = inner and all(x.kind == "Table" or not x.text().strip() for c in cells for x in c.children)
        if table.parent and bare and sum(len(t.text()) for t in inner) > 500:
            captions = [Node("Paragraph", children=c.children) for c in table.children if c.kind == "Caption"]
            table.parent.replace(table, captions + inner)


def remove_newlines(root: Node) -> None:
    for n in root.of("Text"):
        if any(a.kind in ("PreFormatted", "Source") for a in n.above()):
            continue
        beside = [x for x in (n.beside(-1), n.beside(1)) if x is not None]
        if not n.caption.strip() and "\n" in n.caption and (not beside or any(x.kind in BLOCKS for x in beside)):
            n.drop()
        else:
            n.caption = n.caption.replace("\n", " ")


def build_definition_lists(root: Node) -> None:
    parts = ("DefinitionTerm", "DefinitionDescription")
    for n in root.walk():
        if n.kind == "DefinitionList" or not any(c.kind in parts for c in n.children):
            continue
        out: list[Node] = []
        for child in n.children:
            if child.kind in parts:
                if not out or out[-1].kind != "DefinitionList":
                    out.append(Node("DefinitionList"))
                out[-1].put([*out[-1].children, child])
            else:
                out.append(child)
        n.put(out)


def restrict_children(root: Node) -> None:
    for n in root.walk():
        if n.kind in ONLY_CHILDREN:
            n.put([c for c in n.children if c.kind in ONLY_CHILDREN[n.kind]])


def fix_references(root: Node) -> None:
    named: dict[str, list[Node]] = {}
    for n in root.of("Reference"):
        if n.attrs.get("name"):
            named.setdefault(n.attrs["name"], []).append(n)
    for uses in named.values():
        body = next((u.children for u in uses if u.children), [])
        for u in uses:
            u.put([])
        uses[0].put(body)


def fix_infoboxes(root: Node) -> None:
    for table in root.of("Table"):
        if "infobox" in table.attrs.get("class", ""):
            for row in _cells(table):
                for cell in row:
                    images = [x for x in cell.children if x.kind == "ImageLink"]
                    for image in images:
                        rest = "".join(x.text() for x in cell.children if x is not image).strip()
                        if image.text().strip() and image.text().strip() == rest:
                            image.put([])


def fix_chapters(root: Node) -> None:
    if not any(c.kind == "Chapter" for c in root.children):
        return
    out: list[Node] = []
    for child in root.children:
        if child.kind != "Chapter" and out and out[-1].kind == "Chapter":
            out[-1].put([*out[-1].children, child])
        else:
            out.append(child)
    root.put(out)


def fix_preformatted(root: Node) -> None:
    for n in root.of("PreFormatted"):
        if not n.text().strip():
            n.drop()
        else:
            for t in n.of("Text"):
                t.parent.replace(t, [Node("Text", x) for x in re.split(r"(?<=\n)", t.caption) if x])


def fix_list_nesting(root: Node) -> None:
    for n in root.of("ItemList"):
        if len(n.children) == 1 and n.parent and n.children[0].children and all(c.kind == "ItemList" for c in n.children[0].children):
            n.parent.replace(n, [Node("DefinitionDescription", children=n.children[0].children)])


def inherit_styles(root: Node) -> None:
    for n in root.walk():
        mine = {k: v for k, v in n.styles().items() if k not in OWN_STYLES}
        for child in n.children if mine else []:
            if child.kind != "Text":
                child.attrs["style"] = ";".join(f"{k}:{v}" for k, v in (mine | child.styles()).items())


Pass = Callable[[Node], None]
#: The passes in the order in which they apply; some come again, as others leave work for them.
PIPELINE: tuple[Pass, ...] = (
    remove_empty_text, remove_invisible_links, clean_section_captions, remove_childless, remove_no_print, remove_invisible,
    remove_list_only_paragraphs, fix_paragraphs, simplify_blocks, fix_nesting, remove_critical_tables, remove_textless_styles,
    remove_broken_children, fix_colspans, single_column_tables, split_tables_to_columns, linearize_wide_tables,
    remove_breaking_returns, remove_empty_reference_lists, swap_nodes, remove_big_sections_from_cells, transform_nested_tables,
    remove_childless, remove_newlines, remove_breaking_returns, build_definition_lists, restrict_children, fix_references,
    fix_infoboxes, fix_nesting, fix_chapters, fix_preformatted, fix_list_nesting, remove_empty_text, remove_childless,
    remove_breaking_returns,
)


def clean(root: Node, passes: tuple[Pass, ...] = PIPELINE) -> Node:
    for one in passes:
        one(root)
    return root


# --- passes for trees that become XML

#: Nodes that stand on their own in XML and may not lie within each other, but for sections.
XML_BLOCKS = frozenset("Paragraph PreFormatted ItemList Section Table Blockquote DefinitionList HorizontalRule Source".split())


def unwrap_lone_lists(root: Node) -> None:
    """A list that is all a paragraph holds takes its place."""
    for n in root.of("ItemList"):
        if n.parent and n.parent.kind == "Paragraph" and len(n.parent.children) == 1:
            n.parent.unwrap()


def remove_barren(root: Node) -> None:
    """Nodes without children go, and with them all above that hold nothing else."""
    for n in list(root.walk()):
        if n.children or n.kind in CHILDLESS:
            continue
        while n.parent and len(n.parent.children) == 1:
            n = n.parent
        n.drop()


def remove_language_blocks(root: Node) -> None:
    """Nodes that hold language links and no text beside them."""
    for n in list(root.walk()):
        if n.parent and any(c.kind == "LangLink" for c in n.children) and not "".join(c.text() for c in n.children if c.kind != "LangLink").strip():
            n.drop()


def split_blocks(root: Node) -> None:
    """A block within a block splits the outer one into what stands before, itself, and what follows; sections may hold blocks."""
    while True:
        inner = next((n for n in root.walk() if n.kind in XML_BLOCKS and n.parent and n.parent.parent and n.parent.kind in XML_BLOCKS - {"Section"}), None)
        if inner is None:
            return
        _split(inner.parent, inner)


XML_PIPELINE: tuple[Pass, ...] = (unwrap_lone_lists, fix_paragraphs, remove_barren, remove_language_blocks, split_blocks, remove_barren)


# --- notation

_NOTED = re.compile(r"\s*(?:'(?P<text>[^']*)'|(?P<kind>[A-Za-z]+)(?:\{(?P<attrs>[^}]*)\})?(?:@\[(?P<target>[^\]]*)\])?(?:#\[(?P<caption>[^\]]*)\])?(?P<open>\()?|(?P<close>\)))")


def _fold(root: Node, value: Callable[[Node, list[str]], str]) -> str:
    """value(node, values of its children) of the root: children first, however deep they lie."""
    done: dict[int, str] = {}
    for node in reversed(list(root.walk())):
        done[id(node)] = value(node, [done.pop(id(c)) for c in node.children])
    return done[id(root)]


def outline(node: Node) -> str:
    """A tree in one line: 'text', Kind{attribute=value,...}@[target]#[caption](children)."""

    def one(n: Node, parts: list[str]) -> str:
        if n.kind == "Text":
            return f"'{n.caption}'"
        attrs = ",".join([f"{k}={v}" for k, v in sorted(n.attrs.items())]) if n.attrs else ""
        inner = " ".join(parts)
        return n.kind + f"{{{attrs}}}" * bool(attrs) + f"@[{n.target}]" * bool(n.target) + f"#[{n.caption}]" * bool(n.caption) + f"({inner})" * bool(inner)

    return _fold(node, one)


def from_outline(line: str) -> Node:
    """The tree that outline() writes as line; texts hold no quote."""
    top = Node("")
    stack, at = [top], 0
    while m := _NOTED.match(line, at):
        at = m.end()
        if m["close"]:
            stack.pop()
            continue
        attrs = dict(x.split("=", 1) for x in m["attrs"].split(",")) if m["attrs"] else {}
        made = Node(m["kind"], m["caption"] or "", target=m["target"] or "", attrs=attrs) if m["kind"] else Node("Text", m["text"])
        stack[-1].add(made)
        if m["open"]:
            stack.append(made)
    root = top.children[0]
    root.parent = None
    return root


# --- output

_HIDDEN = frozenset("PreFormatted Cell Row Table Math URL ImageLink CategoryLink LangLink ReferenceList Reference Deleted Strike Source Caption".split())
_LEFT_OUT = frozenset(("references", "see also", "external links"))


def plain_text(node: Node, number: int | None = None) -> str:
    """Readable text: no tables, formulas, images, references; no section titles; none of the closing sections."""

    def one(n: Node, parts: list[str]) -> str:
        if n.kind in _HIDDEN or (n.kind == "Section" and n.caption.strip().lower() in _LEFT_OUT):
            return ""
        if n.kind == "Text":
            return n.caption
        if n.kind.endswith("Link") and not n.children:
            return n.target.lstrip("#")
        if n.kind == "ItemList":
            if "numbered" in n.attrs:
                parts = [f"{k + 1}. {part}" if c.kind == "Item" else part for k, (c, part) in enumerate(zip(n.children, parts))]
            return "\n" * (n.parent is not None and n.parent.kind == "Item") + "".join(parts)
        inner = "".join(parts)
        if n.kind == "Paragraph":
            return inner + "\n\n"
        if n.kind == "Item":
            return inner.rstrip("\n") + "\n"
        if n.kind == "Blockquote":
            return f"QUOTE: {inner} END QUOTE. "
        return inner

    return (f"{number}. " if number and node.kind == "Item" else "") + _fold(node, one)


def section_texts(root: Node) -> list[tuple[list[int], str, str]]:
    """(index, title, own text) of each section; (1,) is the first, (2, 1) the first within the second."""
    out: list[tuple[list[int], str, str]] = []

    def visit(node: Node, index: list[int]) -> None:
        own = "".join(plain_text(c) for c in node.children if c.kind != "Section")
        out.append((index, node.caption, own.strip()))
        for k, child in enumerate([c for c in node.children if c.kind == "Section"]):
            visit(child, [*index, k + 1])

    visit(root, [])
    return out


def rows(root: Node) -> list[tuple[int, int | None, int, str, str, str, dict[str, str]]]:
    """(node_id, parent_id, pos, class, caption, target, attrs) in document order; ids count from 0."""
    ids: dict[int, int] = {}
    out = []
    for n in root.walk():
        ids[id(n)] = len(ids)
        pos = 0 if n.parent is None else next(k for k, c in enumerate(n.parent.children) if c is n)
        out.append((ids[id(n)], None if n.parent is None else ids[id(n.parent)], pos, n.kind, n.caption, n.target, dict(n.attrs)))
    return out


# --- rules

_REACH: dict[str, Callable[[Node], list[Node]]] = {
    "children": lambda n: n.children,
    "all_children": lambda n: list(n.walk())[1:],
    "parents": lambda n: n.above(),
    "parent": lambda n: [n.parent] if n.parent else [],
    "siblings": lambda n: [c for c in n.parent.children if c is not n] if n.parent else [],
}
Rule = tuple[str, str, str, tuple[str, ...]]


def _fault(n: Node, rule: Rule) -> Node | None:
    """The node at fault where n breaks the rule; n itself where none of the others is."""
    kind, reach, constraint, kinds = rule
    if n.kind != kind:
        return None
    found = _REACH[reach](n)
    if constraint == "forbid":
        return next((x for x in found if x.kind in kinds), None)
    if constraint == "allow":
        return next((x for x in found if x.kind not in kinds), None)
    if constraint == "require":
        return None if any(x.kind in kinds for x in found) else n
    if constraint == "some":
        return None if found else n
    return next((x for x, k in zip(found, kinds) if x.kind != k), None) or (n if len(found) != len(kinds) else None)


def violations(root: Node, rules: list[Rule]) -> list[tuple[str, str, str]]:
    """(class, reach, constraint) of each rule that a node breaks.

    A rule is (class, reach, constraint, classes): reach one of children, all_children, parents, parent, siblings;
    constraint one of forbid, allow, require (any of the classes), equal (all, in order) and some (any node at all).
    """
    return [rule[:3] for n in root.walk() for rule in rules if _fault(n, rule)]


def enforce(root: Node, rules: list[Rule], strict: bool = False) -> None:
    """Removes the node at fault, again and again, until no rule is broken; strict raises an error at the first instead."""
    while True:
        fault = next(((rule, x) for n in root.walk() for rule in rules if (x := _fault(n, rule)) is not None and (strict or x.parent)), None)
        if fault is None:
            return
        if strict:
            raise ValueError(f"{fault[1].kind} breaks {fault[0]}")
        fault[1].drop()
