"""The extraction of main text: readers' comments by name and by structure, articles, and a slow plain version of all of it."""

import html
import random
from html.parser import HTMLParser

import pytest

from corpuscle.llm import html_text

PARAGRAPHS = "".join(f"<p>Paragraph {k} of the article, which has some length to it.</p>" for k in range(6))
COMMENTS = "".join(f"<p>Comment {k} by a reader that goes on and on for a while, it does.</p>" for k in range(20))
NAMES = "commentlist comment-thread user-comments reader-comments fb-comments discussion article-comments wpdiscuz post-comments-block comments-area comments__list".split()
PLACES = ["<article><h1>Head</h1>{0}{1}</article>", "<article><h1>Head</h1>{0}</article>{1}", "<div><h1>Head</h1>{0}</div>{1}"]


@pytest.mark.parametrize("place", PLACES)
@pytest.mark.parametrize("name", NAMES)
def test_comments_by_name(name, place):
    page = "<body>" + place.format(PARAGRAPHS, f'<div class="{name}">{COMMENTS}</div>') + "</body>"
    assert len(html_text.main_text(page).split("\n")) == 7 and "Comment" not in html_text.main_text(page)


@pytest.mark.parametrize("wrapper", ['<div class="comments-open">', '<div class="no-comments post">', '<div class="has-comments">', '<div class="commentary">', '<div class="section" id="discussion">', '<section id=discussion>', '<div class="article-comments-page">'])
def test_names_of_wrappers_are_no_comments(wrapper):
    assert len(html_text.main_text(f"<body>{wrapper}<h1>Head</h1>{PARAGRAPHS}</div>").split("\n")) == 7


ITEM = "<div class=x1><span class='nick author'>Bob</span><time>1h</time><p>I think that this is really something {}, and so on.</p><a href=#>{}</a></div>"


@pytest.mark.parametrize("place", PLACES)
@pytest.mark.parametrize("answer", ["Reply", "Antworten", "<b> Répondre </b>"])
def test_comments_by_structure(answer, place):
    page = "<body>" + place.format(PARAGRAPHS, f"<div class=y>{''.join(ITEM.format(k, answer) for k in range(20))}</div>") + "</body>"
    assert html_text.main_text(page).count("\n") == 6 and "Bob" not in html_text.main_text(page)


def test_a_thread_is_what_its_page_is_about():
    """Siblings like comments stay where there is no article beside them, and a single one is none."""
    thread = "".join(ITEM.format(k, "Reply") for k in range(20))
    assert html_text.main_text(f"<body><div><h1>T</h1>{thread}</div></body>").count("something") == 20
    one = html_text.main_text(f"<body><div><h1>T</h1>{PARAGRAPHS}{ITEM.format(1, 'Reply')}</div></body>")
    assert "something" in one


def test_microdata():
    page = f"<body><div><h1>T</h1>{PARAGRAPHS}<div itemprop=comment>{COMMENTS}</div><div itemscope itemtype='https://schema.org/Comment'>{COMMENTS}</div></div></body>"
    assert len(html_text.main_text(page).split("\n")) == 7


def test_a_short_article_beside_a_longer_part():
    long = "A longer part of the page. " * 20
    assert html_text.main_text(f"<body><article><h1>Head</h1><p>A short text.</p></article><div><p>{long}</p></div></body>") == "Head\nA short text."
    cards = "".join(f"<article><a href=x>Card {k}</a><p>Teaser.</p></article>" for k in range(3))
    assert html_text.main_text(f"<body><article><h1>Head</h1><p>A short text.</p></article><div><p>{long}</p></div>{cards}</body>") == "Head\nA short text."
    assert html_text.main_text(f"<body><div><p>{long}</p><p>{long}</p></div>{cards}</body>") == "\n".join([long.strip()] * 2)


class Tree(HTMLParser):
    """Nested elements of a well-formed page: (name, attributes, children); children are elements and texts."""

    def __init__(self, page):
        super().__init__(convert_charrefs=False)
        self.open = [("page", {}, [])]
        self.feed(page)
        self.close()

    def handle_starttag(self, name, attributes):
        node = (name, {k: v or "" for k, v in attributes}, [])
        self.open[-1][2].append(node)
        self.open.append(node)

    def handle_endtag(self, name):
        assert self.open.pop()[0] == name

    def handle_data(self, data):
        """Texts keep their entities, as sizes are those of the page's own characters."""
        within = self.open[-1][2]
        if within and isinstance(within[-1], str):
            within[-1] += data
        else:
            within.append(data)

    def handle_entityref(self, name):
        self.handle_data(f"&{name};")


NOISE = {"nav", "footer", "ad", "sidebar", "comments", "reader-comments"}


def elements(node):
    for child in node[2]:
        if isinstance(child, tuple):
            yield child
            yield from elements(child)


def size(node, linked=False):
    """Characters outside links and hard noise."""
    if node[0] in ("nav", "footer") or "comments" in node[1].get("class", ""):
        return 0
    linked = linked or node[0] == "a"
    return sum(size(c, linked) if isinstance(c, tuple) else 0 if linked else len(c.strip()) for c in node[2])


def slow_text(page):
    """The whole extraction again, on a tree, from the definitions: lines, weights, windows, stretches, bounds."""
    root = Tree(page).open[0]
    whole, lines = size(root), []

    def noise(node, inside):
        name = node[1].get("class", "")
        if node[0] in ("nav", "footer") or "comments" in name:
            return True
        return name in NOISE and not (2 * size(node) > whole and any(e[0] in ("article", "h1") for e in elements(node)))

    def walk(node, blocks, article, hidden):
        """Adds the lines of a block: [text, weight, elements around, outermost article]."""
        current = ["", 0]

        def flush():
            text = " ".join(html.unescape(current[0]).split())
            if text:
                lines.append((text, current[1], blocks, article))
            current[:] = ["", 0]

        def inline(n, linked):
            for child in n[2]:
                if isinstance(child, str):
                    current[0] += child
                    current[1] += 0 if linked else len(child.strip())
                elif child[0] in ("a", "b"):
                    inline(child, linked or child[0] == "a")
                elif not noise(child, article):
                    flush()
                    walk(child, [*blocks, id(child)], article or (id(child) if child[0] == "article" else 0), hidden)
                else:
                    flush()

        inline(node, False)
        flush()

    walk(root, [0], 0, False)
    weights = [x[1] for x in lines]
    if not any(weights):
        return ""
    headed = {id(a) for a in [root, *elements(root)] if a[0] == "article" and any(e[0] == "h1" for e in elements(a))}
    articles = {x[3] for x in lines if x[1] and x[3]}
    articles = articles & headed if len(articles) > 1 else articles
    if len(articles) == 1:
        weights = [w if x[3] in articles else 0 for w, x in zip(weights, lines)]
    total = lambda k: sum(weights[k : k + html_text.WINDOW])
    least, found, start = html_text.SURGE * max(map(total, range(len(lines)))), [], None
    for k in range(len(lines) + 1):
        if start is None and k < len(lines) and total(k) > least:
            start = k
        elif start is not None and (k == len(lines) or not weights[k] and total(k) <= least):
            found.append((start, k))
            start = None
    first, last = max(found, key=lambda s: sum(weights[s[0] : s[1]]))

    def heaviest(keys):
        order = list(dict.fromkeys([0, *keys]))
        sums = {key: sum(w for w, k in zip(weights[first:last], keys) if k == key) for key in order}
        return max(set(keys), key=lambda k: (sums[k], -places.get(k, 0)))

    places = {id(e): k + 1 for k, e in enumerate(elements(root))}
    holder = heaviest([x[3] for x in lines[first:last]])
    if not holder:
        heavy = [k for k in range(first, last) if weights[k]]
        first, last = heavy[0], heavy[-1] + 1
        holder = heaviest([x[2][-2] if len(x[2]) > 1 else x[2][-1] for x in lines[first:last]])
        inside = [k for k, x in enumerate(lines) if holder and holder in x[2]]
        first, last = min([first, *inside]), max([last - 1, *inside]) + 1
    else:
        inside = [k for k, x in enumerate(lines) if holder in x[2]]
        first, last = inside[0], inside[-1] + 1
    return "\n".join(x[0] for x in lines[first:last])


def random_page(rng):
    def words():
        return " ".join(rng.choice(["word", "other &amp; more", "caf&eacute;", "long" * 9, "x"]) for _ in range(rng.randrange(1, 14)))

    def part(depth):
        kind = rng.random()
        if depth == 0 or kind < 0.45:
            return f"<p>{words()}</p>"
        if kind < 0.55:
            return f"<ul><li><a>{words()}</a></li><li><b>{words()}</b> {words()}</li></ul>"
        if kind < 0.6:
            return f"<nav><p>{words()}</p></nav>"
        if kind < 0.75:
            return f'<div class="{rng.choice(["ad", "sidebar", "comments", "reader-comments"])}">{part(depth - 1)}</div>'
        return f"<div>{''.join(part(depth - 1) for _ in range(rng.randrange(4)))}</div>"

    body = [part(3) for _ in range(rng.randrange(1, 7))]
    for _ in range(rng.choice([0, 1, 1, 2])):
        head = rng.choice(["", f"<h1>{words()}</h1>"])
        body.insert(rng.randrange(len(body) + 1), f"<article>{head}{''.join(part(2) for _ in range(rng.randrange(4)))}</article>")
    return f"<body>{''.join(body)}<footer>{words()}</footer></body>"


def test_whole_extraction():
    rng = random.Random(11)
    for _ in range(3000):
        page = random_page(rng)
        assert html_text.main_text(page) == slow_text(page), page


def test_repeated_rows_and_nulls(spark):
    page = f"<body><article>{PARAGRAPHS}</article></body>"
    rows = [(1, "u", page), (1, "u", page), (None, None, page), (2, "v", None)]
    found = html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    text = html_text.main_text(page)
    key = lambda r: (r[0] or 0, r[2])
    assert sorted(map(tuple, found), key=key) == sorted([(1, "u", text, len(text))] * 2 + [(None, None, text, len(text)), (2, "v", "", 0)], key=key)
