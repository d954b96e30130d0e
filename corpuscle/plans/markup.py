"""Queries over markup: trees, tokens, extensions. Every customer or document gives a page, made from its columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tree
from ..operators import scan, trees
from ..sources import staging

#: For each pass a tree before it and after it; {n} stands for a customer's name.
PASSES = {
    "remove_empty_text": ("Article('' Paragraph('a' '' '{n}') ' ' Paragraph('b'))", "Article(Paragraph('a' '{n}') Paragraph('b'))"),
    "remove_invisible_links": ("Article(CategoryLink@[Category:x] LangLink@[fr:{n}] CategoryLink{colon=1}@[Category:y] ArticleLink@[z])", "Article(CategoryLink{colon=1}@[Category:y] ArticleLink@[z])"),
    "clean_section_captions": ("Article(Section(Caption(' ') 'x') Section(Caption(Center('{n}') Strong('b'))))", "Article(Section(BreakingReturn 'x') Section(Caption('{n}' Strong('b'))))"),
    "remove_childless": ("Article(Paragraph(Strong(Emphasized)) Paragraph('{n}' BreakingReturn Center) HorizontalRule)", "Article(Paragraph('{n}' BreakingReturn) HorizontalRule)"),
    "remove_no_print": ("Article(Div{class=x noprint}('gone') Div{id=coordinates}('gone') Div{class=noprints}('{n}'))", "Article(Div{class=noprints}('{n}'))"),
    "remove_invisible": ("Article(Div{style=display:none}('gone') Span{style=color:red;visibility: hidden}('gone') Div{style=display:block}('{n}'))", "Article(Div{style=display:block}('{n}'))"),
    "remove_list_only_paragraphs": ("Article(Paragraph(ItemList(Item('{n}')) ItemList(Item('b'))) Paragraph('c' ItemList(Item('d'))))", "Article(ItemList(Item('{n}')) ItemList(Item('b')) Paragraph('c' ItemList(Item('d'))))"),
    "fix_paragraphs": ("Article(Section('a' Section('b')) Paragraph('{n}') Paragraph('c'))", "Article(Section('a' Section('b' Paragraph('{n}') Paragraph('c'))))"),
    "simplify_blocks": ("Article(Paragraph(Center('{n}')) Paragraph(Strong('b')) Paragraph(Div('c') 'd'))", "Article(Center('{n}') Paragraph(Strong('b')) Paragraph(Div('c') 'd'))"),
    "fix_nesting": ("Article(Paragraph('a' DefinitionList(DefinitionTerm('{n}')) 'b') Div(ItemList(Item('c')) 'd'))", "Article(Paragraph('a') DefinitionList(DefinitionTerm('{n}')) Paragraph('b') ItemList(Item('c')) Div('d'))"),
    "remove_critical_tables": ("Article(Table{class=big navbox}(Row(Cell('{n}') Cell(Strong('b')))) Table(Row(Cell('c'))))", "Article('{n}' Strong('b') Table(Row(Cell('c'))))"),
    "remove_textless_styles": ("Article(Strong(ImageLink@[a.png]) Emphasized(Strong(' ')) Strong('{n}'))", "Article(ImageLink@[a.png] ' ' Strong('{n}'))"),
    "remove_broken_children": ("Article(Reference('{n}' Div('b') ImageLink@[a.png]('c')) PreFormatted(Code('d')))", "Article(Reference('{n}' 'b' 'c') PreFormatted('d'))"),
    "fix_colspans": ("Article(Table(Row(Cell{colspan=9}('{n}')) Row(Cell('a') Cell{colspan=2}('b')) Row(Cell{colspan=2}('c'))))", "Article(Table(Row(Cell{colspan=3}('{n}')) Row(Cell('a') Cell{colspan=2}('b')) Row(Cell{colspan=2}('c'))))"),
    "single_column_tables": ("Article(Table(Row(Cell('{n}')) Row(Cell('b'))) Table{class=box}(Row(Cell('c'))) Table(Row(Cell('d') Cell('e'))))", "Article(Div('{n}') Div('b') Table{class=box}(Row(Cell('c'))) Table(Row(Cell('d') Cell('e'))))"),
    "split_tables_to_columns": ("Article(Table{id=mp-upper}(Row(Cell('{n}') Cell('b')) Row(Cell('c') Cell('d'))) Table(Row(Cell('e'))))", "Article('{n}' 'c' 'b' 'd' Table(Row(Cell('e'))))"),
    "linearize_wide_tables": ("Article(Table(Row(Cell('{n}') Cell(Table(Row(" + " ".join(["Cell('x')"] * 16) + "))))) Table(Row(Cell(Table(Row(Cell('y')))))))", "Article('{n}' Table(Row(" + " ".join(["Cell('x')"] * 16) + ")) Table(Row(Cell(Table(Row(Cell('y')))))))"),
    "remove_breaking_returns": ("Article(Paragraph(BreakingReturn 'a' BreakingReturn BreakingReturn '{n}' BreakingReturn))", "Article(Paragraph('a' BreakingReturn '{n}'))"),
    "remove_empty_reference_lists": ("Article(Section('{n}') Section(Caption('Notes') ReferenceList) Section(ReferenceList 'kept'))", "Article(Section('{n}') Section(ReferenceList 'kept'))"),
    "swap_nodes": ("Article(Underline(Center('{n}')) Emphasized(Center('b') 'c') Strong(Center('d')))", "Article(Center(Underline('{n}')) Emphasized(Center('b') 'c') Strong(Center('d')))"),
    "remove_big_sections_from_cells": ("Article(Table(Row(Cell(Section('" + "x" * 2001 + "') '{n}') Cell(Section('short')))))", "Article(Table(Row(Cell('{n}') Cell(Section('short')))) Section('" + "x" * 2001 + "'))"),
    "transform_nested_tables": ("Article(Table(Caption('{n}') Row(Cell(Table(Row(Cell('" + "x" * 501 + "')))))) Table(Row(Cell(Table(Row(Cell('short')))))))", "Article(Paragraph('{n}') Table(Row(Cell('" + "x" * 501 + "'))) Table(Row(Cell(Table(Row(Cell('short')))))))"),
    "remove_newlines": ("Article(Paragraph('a') '\n' Paragraph('b\n{n}') PreFormatted('c\nd'))", "Article(Paragraph('a') Paragraph('b {n}') PreFormatted('c\nd'))"),
    "build_definition_lists": ("Article(DefinitionTerm('{n}') DefinitionDescription('b') Paragraph('c') DefinitionTerm('d'))", "Article(DefinitionList(DefinitionTerm('{n}') DefinitionDescription('b')) Paragraph('c') DefinitionList(DefinitionTerm('d')))"),
    "restrict_children": ("Article(Gallery('{n}' ImageLink@[a.png] Strong('b') ImageLink@[b.png]('{n}')))", "Article(Gallery(ImageLink@[a.png] ImageLink@[b.png]('{n}')))"),
    "fix_references": ("Article(Reference{name=r} 'a' Reference{name=r}('{n}') Reference('b') Reference{name=r}('other'))", "Article(Reference{name=r}('{n}') 'a' Reference{name=r} Reference('b') Reference{name=r})"),
    "fix_infoboxes": ("Article(Table{class=infobox}(Row(Cell(ImageLink@[a.png]('{n}') '{n}') Cell(ImageLink@[b.png]('x') 'y'))))", "Article(Table{class=infobox}(Row(Cell(ImageLink@[a.png] '{n}') Cell(ImageLink@[b.png]('x') 'y'))))"),
    "fix_chapters": ("Article('a' Chapter#[One] Section('{n}') 'b' Chapter#[Two] 'c')", "Article('a' Chapter#[One](Section('{n}') 'b') Chapter#[Two]('c'))"),
    "fix_preformatted": ("Article(PreFormatted(' ') PreFormatted('a\n{n}\nb'))", "Article(PreFormatted('a\n' '{n}\n' 'b'))"),
    "fix_list_nesting": ("Article(ItemList(Item(ItemList(Item('{n}')))) ItemList(Item('a' ItemList(Item('b')))))", "Article(DefinitionDescription(ItemList(Item('{n}'))) ItemList(Item('a' ItemList(Item('b')))))"),
    "inherit_styles": ("Article(Div{style=color:red;width:9}(Strong('{n}') Span{style=color:blue}('b') 'c'))", "Article(Div{style=color:red;width:9}(Strong{style=color:red}('{n}') Span{style=color:blue}('b') 'c'))"),
    "unwrap_lone_lists": ("Article(Paragraph(ItemList(Item('{n}'))) Paragraph('a' ItemList(Item('b'))))", "Article(ItemList(Item('{n}')) Paragraph('a' ItemList(Item('b'))))"),
    "remove_barren": ("Article(Paragraph(Strong(Emphasized)) Paragraph('{n}' Strong))", "Article(Paragraph('{n}'))"),
    "remove_language_blocks": ("Article(Paragraph(LangLink@[fr:a] ' ' LangLink@[de:b]) Paragraph('{n}' LangLink@[fr:c]))", "Article(Paragraph('{n}' LangLink@[fr:c]))"),
    "split_blocks": ("Article(Paragraph('a' Table(Row(Cell('{n}'))) 'b') Section(Paragraph('c')))", "Article(Paragraph('a') Table(Row(Cell('{n}'))) Paragraph('b') Section(Paragraph('c')))"),
}
RULES = [("Paragraph", "children", "forbid", ("Table",)), ("Gallery", "children", "allow", ("ImageLink",)), ("Section", "children", "some", ()), ("Item", "parent", "require", ("ItemList",)), ("Row", "siblings", "forbid", ("Text",)), ("Cite", "parents", "forbid", ("Cite",)), ("Pair", "children", "equal", ("Cell", "Cell"))]
RULED = ("Article(Paragraph('{n}' Table Table) Gallery(ImageLink@[a] Strong('x') ImageLink@[b]) Section Section(Section) Item('y') Table('z' Row(Cell)) Pair(Cell Cell) Pair(Cell Row))", "Article(Paragraph('{n}') Gallery(ImageLink@[a] ImageLink@[b]) Table(Row(Cell)) Pair(Cell Cell))")
#: A page of wikitext and what the parser and the passes make of it; {n} a customer's name, {k} the key.
PAGE = "Lead [[a {k}|{n}]] and ''more''.\n== One ==\n* item {k}\n** '''sub'''\n# first\n{| class=\"t\"\n|-\n| 1 || {n}\n|}\n=== Two ===\ntext {{box|x}}{k}\n code\n== See also ==\ngone"
PARSED = "Article#[{k}](Paragraph('Lead ' ArticleLink@[a {k}]('{n}') ' and ' Emphasized('more') '.') Section{level=2}#[One](Caption('One') ItemList(Item('item {k}' ItemList(Item(Strong('sub'))))) ItemList{numbered=1}(Item('first')) Table{class=t}(Row(Cell('1') Cell('{n}'))) Section{level=3}#[Two](Caption('Two') Paragraph('text {k}') PreFormatted('code'))) Section{level=2}#[See also](Caption('See also') Paragraph('gone')))"
PLAIN = "Lead {n} and more.\n\nitem {k}\nsub\n1. first\ntext {k}"

#: A page that needs tidying, and what all passes in their order leave of it.
UNTIDY = "Lead '''  ''' [[Category:x]]<br/>\n\n<center></center>\n== One ==\n* item {k}\n{| class=\"navbox\"\n| gone || {n}\n|}\n{|\n| one\n|-\n| two\n|}\n<ref name=a>r {n}</ref> x <ref name=a/>\n== Notes ==\n<references/>"
TIDY = "Article#[{k}](Paragraph('Lead ' ' ') Section{level=2}#[One](Caption('One') ItemList(Item('item {k}')) Div('one') Div('two') Paragraph(Reference{name=a}('r {n}') ' x ' Reference{name=a})) Section{level=2}#[Notes](Caption('Notes') ReferenceList))"


def _customers(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    name = F.replace("c_name", F.lit("'"), F.lit(""))
    made = F.replace(F.replace(F.lit(text), F.lit("{n}"), name), F.lit("{k}"), F.col("c_custkey").cast("string"))
    customers = staging.spread(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name"))
    return customers.select(F.col("c_custkey").cast("string").alias("title"), made.alias("text"))


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of each page, parsed once for all that reads them."""
    return staging.stage(trees.node_table(_customers(spark, sf_dir, PAGE), ()), "nodes")


def _pass_query(name: str):
    def run(spark, sf_dir):
        return trees.outlines(_customers(spark, sf_dir, PASSES[name][0]), (getattr(tree, name),), noted=True)

    return run


def tree_rules(spark, sf_dir):
    return trees.outlines(_customers(spark, sf_dir, RULED[0]), (), RULES, noted=True)


def tree_parse(spark, sf_dir):
    return trees.outlines(_customers(spark, sf_dir, PAGE), ())


def tree_pipeline(spark, sf_dir):
    return trees.outlines(_customers(spark, sf_dir, UNTIDY))


def tree_texts(spark, sf_dir):
    return trees.plain_texts(_customers(spark, sf_dir, PAGE), ())


def tree_section_index(spark, sf_dir):
    found = trees.section_table(_customers(spark, sf_dir, PAGE), ())
    return found.select("title", F.array_join(F.col("index").cast("array<string>"), ".").alias("index"), "section", "text")


def tree_histogram(spark, sf_dir):
    return trees.node_histogram(trees.node_table(_customers(spark, sf_dir, PAGE), ()))


def tree_children(spark, sf_dir):
    nodes = _nodes(spark, sf_dir)
    return trees.children(nodes, nodes.where("class = 'Section'")).groupBy("class").agg(F.count(F.lit(1)).alias("n"))


def tree_descendants(spark, sf_dir):
    nodes = _nodes(spark, sf_dir)
    return trees.descendants(nodes, nodes.where("class = 'Section' and caption = 'One'")).groupBy("class").agg(F.count(F.lit(1)).alias("n"))


def tree_ancestors(spark, sf_dir):
    nodes = _nodes(spark, sf_dir)
    return trees.ancestors(nodes, nodes.where("caption = 'sub'")).groupBy("class").agg(F.count(F.lit(1)).alias("n"))


def tree_siblings(spark, sf_dir):
    nodes = _nodes(spark, sf_dir)
    return trees.siblings(nodes, nodes.where("class = 'Table'")).groupBy("class").agg(F.count(F.lit(1)).alias("n"))


def tree_levels(spark, sf_dir):
    found = trees.levels(_customers(spark, sf_dir, "* {n}\n** b"), ())
    return found.select("title", "node_id", "level", "text")


def wiki_tokens(spark, sf_dir):
    """The tokens of each document, joined again: none is lost, doubled or moved."""
    staging.bound_batches(spark)
    pages = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("string").alias("title"), F.concat(F.lit("== H ==\n* "), F.coalesce("text", F.lit(""))).alias("text"))
    tokens = scan.token_table(pages)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]), "")
    kinds = F.count_if(F.col("class").isin("section", "section_end", "item"))
    return tokens.groupBy("title").agg(F.md5(joined.cast("binary")).alias("digest"), F.least(kinds, F.lit(3)).cast("long").alias("marks"))


def tag_extensions(spark, sf_dir):
    text = "<rot13>{n}</rot13> <poem>a\n{n}</poem> <see name=\"{n}\" phone=7>open</see> <section>s</section> <hiero>x</hiero>|<plain>y</plain>"
    return scan.expand_extensions(_customers(spark, sf_dir, text))


def _sql(expected: str, column: str = "outline") -> str:
    quoted = "'" + expected.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    return f"SELECT c_custkey::VARCHAR AS title, replace(replace({quoted}, '{{n}}', replace(c_name, '''', '')), '{{k}}', c_custkey::VARCHAR) AS {column} FROM customer"


def _counted(**n: int) -> str:
    return "SELECT class, k * (SELECT count(*) FROM customer) AS n FROM (VALUES " + ", ".join(f"('{c}', {k})" for c, k in n.items()) + ") x(class, k)"


QUERIES = {f"pass_{name}": _pass_query(name) for name in PASSES}
for _function in (tree_rules, tree_parse, tree_pipeline, tree_texts, tree_section_index, tree_histogram, tree_children, tree_descendants, tree_ancestors, tree_siblings, tree_levels, wiki_tokens, tag_extensions):
    QUERIES[_function.__name__] = _function

ORACLE_SQL = {f"pass_{name}": _sql(after) for name, (_, after) in PASSES.items()}
ORACLE_SQL |= {
    "tree_rules": _sql(RULED[1]),
    "tree_parse": _sql(PARSED),
    "tree_pipeline": _sql(TIDY),
    "tree_texts": _sql(PLAIN, "text"),
    "tree_section_index": """SELECT c_custkey::VARCHAR AS title, i AS index, CASE WHEN i = '' THEN c_custkey::VARCHAR ELSE s END AS section,
        replace(replace(t, '{n}', replace(c_name, '''', '')), '{k}', c_custkey::VARCHAR) AS text FROM customer,
        (VALUES ('', '', 'Lead {n} and more.'), ('1', 'One', 'item {k}' || chr(10) || 'sub' || chr(10) || '1. first'), ('1.1', 'Two', 'text {k}'), ('2', 'See also', 'gone')) x(i, s, t)""",
    "tree_histogram": """SELECT class, sum(k)::BIGINT AS weight FROM (
        SELECT class, k * (SELECT count(*) FROM customer) AS k FROM (VALUES ('Article', 1), ('Paragraph', 3), ('ArticleLink', 1), ('Emphasized', 1), ('Section', 3), ('Caption', 3), ('ItemList', 3), ('Item', 3), ('Strong', 1), ('Table', 1), ('Row', 1), ('Cell', 2), ('PreFormatted', 1)) x(class, k)
        UNION ALL SELECT 'Text', sum(length('Lead  and more.One') + 2 * length(replace(c_name, '''', '')) + length('item subfirst1Twotext codeSee alsogone') + 2 * length(c_custkey::VARCHAR)) FROM customer) GROUP BY class""",
    "tree_children": _counted(Caption=3, ItemList=2, Table=1, Section=1, Paragraph=2, PreFormatted=1),
    "tree_descendants": _counted(Caption=2, ItemList=3, Item=3, Strong=1, Table=1, Row=1, Cell=2, Section=1, Paragraph=1, PreFormatted=1, Text=9),
    "tree_ancestors": _counted(Strong=1, Item=2, ItemList=2, Section=1, Article=1),
    "tree_siblings": _counted(Caption=1, ItemList=2, Section=1),
    "tree_levels": "SELECT c_custkey::VARCHAR AS title, i::BIGINT AS node_id, l::BIGINT AS level, CASE WHEN s = 2 THEN replace(c_name, '''', '') || 'b' WHEN s = 1 THEN replace(c_name, '''', '') ELSE 'b' END AS text FROM customer, (VALUES (0, 0, 2), (1, 1, 2), (2, 2, 2), (3, 3, 1), (4, 3, 0), (5, 4, 0), (6, 5, 0)) x(i, l, s)",
    "wiki_tokens": "SELECT doc_id::VARCHAR AS title, md5('== H ==' || chr(10) || '* ' || coalesce(text, '')) AS digest, 3::BIGINT AS marks FROM documents",
    "tag_extensions": """SELECT c_custkey::VARCHAR AS title, translate(n, 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', 'NOPQRSTUVWXYZABCDEFGHIJKLMnopqrstuvwxyzabcdefghijklm') || ' :a' || chr(10) || ':' || n || ' * ''''''' || n || ', 7'''''' open s |<plain>y</plain>' AS text
        FROM (SELECT c_custkey, replace(c_name, '''', '') AS n FROM customer)""",
}
