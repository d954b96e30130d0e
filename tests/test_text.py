from html.entities import name2codepoint

from pyspark.sql import functions as F

from corpuscle.functions import collections, expr, text, tree


def value(spark, column, *args):
    names = [f"c{k}" for k in range(len(args))]
    row = spark.createDataFrame([args], ", ".join(f"{n} string" for n in names)).select(column(*map(F.col, names)).alias("x")).first()
    return row.x


def test_token_filter(spark):
    assert value(spark, text.drop_extraneous, "3rd -x $5 ok") == "ok"
    assert value(spark, text.tokens, " a \n b\t") == ["a", "b"]
    assert value(spark, text.tokens, None) == []
    assert value(spark, text.tokens_single_space, "a  b") == ["a", "", "b"]


def test_markup(spark):
    assert value(spark, text.strip_wiki, "[[Image:x|y]][[a|b|c]] [[d]] {{t}} {x}") == "b d  {x"
    assert value(spark, lambda c: text.strip_html(c, every_entity=True), "<b>&#233;&#xe9;&amp;lt;&bogus;</b>") == "éé&lt;&bogus;"
    assert value(spark, text.strip_html, "a&amp;lt;b") == "a&lt;b"
    assert value(spark, text.is_redirect, "#Redirect [[X]]") is False
    assert value(spark, text.is_redirect, "#REDIRECT [[X]]") is True
    assert value(spark, text.redirect_target, "#redirect: [[A b#c|d]]") == "A b"


def test_titles(spark):
    assert value(spark, text.normalize_title, " foo_bar ") == "Foo bar"
    row = value(spark, lambda c: text.split_title(c, {"category": 14}), ":category:foo")
    assert (row.ns, row.partial, row.full) == (14, "Foo", "Category:Foo")
    assert value(spark, lambda c: text.split_title(c, {"category": 14}), "no:such")["ns"] == 0


def test_truncation(spark):
    assert value(spark, lambda c: text.truncate_at_sentence(text.tokens(c), 4), "a b. c d e.") == "a b."
    assert value(spark, lambda c: text.truncate_at_sentence(text.tokens(c), 4), "a b c") == ""


def test_sections(spark):
    found = value(spark, text.sections, "lead\n== One ==\nx\n=== Two ===\ny")
    assert [(s.level, s.title, s.body.strip()) for s in found] == [(0, None, "lead"), (2, "One", "x"), (3, "Two", "y")]


def test_colours(spark):
    assert value(spark, text.css_colour, "#f00").r == 1.0
    assert abs(value(spark, text.css_colour, "rgb(0, 255, 50%)").b - 0.5) < 1e-9
    assert value(spark, text.css_colour, "white").grey > 0.999
    assert value(spark, text.css_colour, "nonsense") is None


def test_urls(spark):
    assert value(spark, text.safe_url, "http://x.org/a b") == "http://x.org/a%20b"
    assert value(spark, text.safe_url, "mailto") is None
    row = value(spark, text.article_of_url, "http://x.org/w/index.php?title=A_b&oldid=7")
    assert (row.title, row.oldid) == ("A b", 7)
    assert value(spark, text.article_of_url, "http://x.org/wiki/C%C3%A9").title == "Cé"


def test_expressions(spark):
    assert expr.evaluate("1 + 2 * 3") == 7
    assert expr.evaluate("7 mod 3 = 1 and not 0") == 1
    assert expr.evaluate("2.345 round 2") in (2.35, 2.34)
    assert value(spark, expr.evaluate_expressions, "(1 + 2) * 2") == 6
    assert value(spark, expr.evaluate_expressions, "1 / 0") is None


def test_collection(spark):
    page = "== Book ==\n=== Sub ===\n;One\n:[[A|a]]\n:[{{fullurl:B|oldid=3}} b]\n;Two\n:[[:C]]"
    rows = collections.collection_items(spark.createDataFrame([("p", page)], "page string, text string")).orderBy("pos").collect()
    assert [(r.kind, r.chapter, r.title) for r in rows] == [("title", None, "Book"), ("subtitle", None, "Sub"), ("chapter", None, "One"), ("article", "One", "A"), ("article", "One", "B"), ("chapter", None, "Two"), ("article", "Two", "C")]
    assert rows[4].revision == "3"


def test_image_map_and_symbols(spark):
    found = value(spark, collections.image_map, "# no\nrect 1 2 3 4 [[A]]\ndefault [[B]]")
    assert [(m.shape, m.coords, m.link) for m in found] == [("rect", [1, 2, 3, 4], "A"), ("default", [], "B")]
    page = "# no\n\n Image:Foo.jpg|200px|a foo\ndesc bottom-left\ndesc nowhere\npoly 1 2 3 4 [[B]]"
    assert [(m.shape, m.link) for m in value(spark, collections.image_map, page)] == [("desc", "bottom-left"), ("poly", "B")]
    assert value(spark, collections.image_of_map, page) == "Image:Foo.jpg|200px|a foo" and value(spark, collections.image_of_map, "rect 1 2 3 4 [[A]]") is None
    symbols = lambda x: value(spark, collections.tex_symbols, x)
    assert symbols(r"x \in \N, \Nx \Darr\ge1 \alpha" + "\\") == r"x \in \mathbb{N}, \Nx \Downarrow\geq1 \alpha" + "\\"
    assert symbols(r"\Alpha_\le\leq") == r"A{}_\leq\leq" and symbols("") == ""


def test_entities(spark):
    """Against the definition: every name, numbers of all ranges, one level, from left to right, never across a tag."""
    decode = lambda x: value(spark, text.strip_html, x)
    every = "".join(f"&{name};" for name in name2codepoint)
    assert decode(every) == "".join(map(chr, name2codepoint.values()))
    assert decode("caf&eacute; &#65;&#x1F600;&#0233;&amp;lt;&amp;#65;") == "café A😀é&lt;&#65;"
    assert decode("&#xD800;&#1114112;&#99999999999999999999;&#x;&#X41;&#;&;&bogus;&eacute &") == "&#xD800;&#1114112;&#99999999999999999999;&#x;&#X41;&#;&;&bogus;&eacute &"
    assert decode("&<b>lt;</b>&l<i>t;") == "&lt;&lt;" and decode("&lt;b&gt;") == "<b>" and decode("") == "" and decode(None) is None


def test_scripts(spark):
    rows = collections.script_runs(spark.createDataFrame([(1, "ab γδ e")], "doc_id long, text string")).orderBy("run").collect()
    assert [(r.script, r.text) for r in rows] == [("latin", "ab "), ("greek", "γδ "), ("latin", "e")]


def test_deep_input_fails_no_job(spark):
    """Lists of many levels keep their text; an expression of too many brackets is none."""
    for mark in "*:#":
        root = tree.parse(mark * 1500 + " x")
        assert len(list(root.walk())) > 3000 and tree.plain_text(root).strip("\n0123456789. ") == "x" and "x" in tree.outline(tree.clean(root))
        assert [r[2].strip("\n0123456789. ") for r in tree.section_texts(tree.parse(mark * 1500 + " x"))][-1] == "x"
    rows = spark.createDataFrame([("(" * 3000 + "1" + ")" * 3000,), ("1+1",), ("((",), (None,)], "e string")
    assert sorted((r.v for r in rows.select(expr.evaluate_expressions("e").alias("v")).collect()), key=str) == [2.0, None, None, None]
