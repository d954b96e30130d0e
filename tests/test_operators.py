import math

import numpy as np
from pyspark.sql import functions as F

from corpuscle.functions import tree
from corpuscle.operators import graph, revisions, similarity, stats, trees, windows


def docs(spark, *texts):
    return spark.createDataFrame([(k, f"t{k}", x) for k, x in enumerate(texts)], "doc_id long, title string, text string")


def words(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "word string")


def test_length_is_strict(spark):
    found = stats.term_doc_freq(docs(spark, "a b", "a b c"), min_doc_len=2, min_df=1)
    assert {(r.word, r.tf, r.df) for r in found.collect()} == {("a", 1, 1), ("b", 1, 1), ("c", 1, 1)}


def test_keys_of_any_shape_stay(spark):
    found = stats.term_doc_freq(docs(spark, "a été 42 a"), min_doc_len=0, min_df=1)
    assert {(r.word, r.tf) for r in found.collect()} == {("a", 2), ("été", 1), ("42", 1)}


def test_unigram_window_is_longer_on_the_left(spark):
    text = "a b c d e f g h"
    found = windows.unigram_contexts(docs(spark, text), words(spark, "e"), words(spark, *text.split()), 2, min_doc_len=0)
    assert {r.feature for r in found.collect()} == set("bcdfg")


def test_raw_window_is_shorter_on_the_right(spark):
    found = windows.raw_contexts(docs(spark, "a b c d e f g"), words(spark, "d"), 3, min_doc_len=0)
    assert found.first().context == "a b c ###d### e f"


def test_long_word_lists_wait_for_narrow_rows(spark, monkeypatch):
    rows, heads, known = docs(spark, "a b c d e f g h a c"), words(spark, "e", "a"), words(spark, *"abcdefgh")
    stats_ = known.withColumn("df", F.lit(9).cast("long"))
    made = lambda: [sorted(map(tuple, x.collect())) for x in (windows.unigram_contexts(rows, heads, known, 2, min_doc_len=0), windows.raw_contexts(rows, heads, 2, min_doc_len=0), windows.gap_contexts(rows, heads, 2, min_doc_len=0), similarity.contextual_similarity(rows, vectors(spark, [("h", "b", 1)]), stats_, 2, 0, 1, 5))]
    short = made()
    monkeypatch.setattr(windows, "LOCAL_WORDS", 1)
    assert made() == short and all(short)


def test_pair_window_holds_the_word(spark):
    found = windows.cooccurrence(docs(spark, "a b c d e f"), 4, 1, 1).where("word = 'c'")
    assert {r.word2 for r in found.collect()} == set("abcd")


def test_pairs_of_long_documents(spark):
    rows = docs(spark, "a b a b c", "a b", "", "a  b a")
    found = [sorted(tuple(r) for r in windows.cooccurrence(rows, 4, 1, 1, at_once=n).collect()) for n in (1, 5, 1 << 20)]
    assert found[0] == found[1] == found[2]
    only = windows.cooccurrence(rows, 4, 1, 1, words(spark, "a", "b"))
    assert {(r.word, r.word2) for r in only.collect()} == {(x, y) for x in "ab" for y in "ab"}


def test_pmi(spark):
    pairs = spark.createDataFrame([("a", "a", 2, 1), ("a", "b", 1, 1), ("b", "a", 1, 1)], "word string, word2 string, cooc long, docs long")
    found = {(r.word, r.word2): r.pmi for r in windows.pmi(pairs).collect()}
    assert math.isclose(found["a", "b"], math.log(1 * 4 / (3 * 1)))


def test_last_ngram_is_left_out(spark):
    found = stats.ngram_bags(docs(spark, "a b c d", "a b"), 2, min_doc_len=0)
    assert {r.doc_id for r in found.collect()} == {"t0-0-2", "t0-1-3"}


def test_bag_without_known_word_stays(spark):
    found = {(r.doc_id, r.word, r.cnt) for r in stats.bags(docs(spark, "x x", "y"), words(spark, "x"), 0).collect()}
    assert found == {("t0", "x", 2), ("t1", None, 0)}


def vectors(spark, rows):
    return spark.createDataFrame(rows, "head string, feature string, cnt long")


def test_zero_overlap_is_a_candidate_and_ties_go_by_target(spark):
    v = vectors(spark, [("h", "x", 1), ("a", "y", 1), ("b", "y", 1)])
    found = similarity.top_neighbours(similarity.jaccard(v), 1).where("head = 'h'").first()
    assert (found.target, found.score) == ("b", 0.0)


def test_weighted_jaccard_is_symmetric(spark):
    v = vectors(spark, [("a", "x", 3), ("a", "y", 1), ("b", "x", 1), ("b", "z", 2)])
    found = {(r.head, r.target): r.score for r in similarity.METRICS["tf_weighted_jaccard"](v).collect()}
    assert found["a", "b"] == found["b", "a"] == 1 / 6


def test_senses_replace_their_word(spark):
    found = similarity.overwrite_senses(vectors(spark, [("ask", "x", 1), ("go", "x", 1)]), vectors(spark, [("askZZZ1", "y", 2)]))
    assert {r["head"] for r in found.collect()} == {"go", "askZZZ1"}


def test_redirects(spark):
    rows = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x")], "src string, dst string")
    assert {(r.src, r.dst, r.hops) for r in graph.resolve_redirects(rows).collect()} == {("a", "c", 2), ("b", "c", 1), ("x", None, None), ("y", None, None)}


def test_templates(spark):
    pages = spark.createDataFrame([("p", "{{a}}")], "title string, text string")
    templates = spark.createDataFrame([("A", "{{b|x}}"), ("B", "{{a}}")], "title string, text string")
    assert {r.template for r in graph.template_closure(pages, templates).collect()} == {"A", "B"}


def test_long_redirects_and_deep_templates(spark):
    """No bound on hops or depth: a chain of 100, one into a circle, a closure 40 deep."""
    chain = [(f"p{k}", f"p{k + 1}") for k in range(100)] + [("in", "c0"), *[(f"c{k}", f"c{(k + 1) % 3}") for k in range(3)]]
    found = {r.src: (r.dst, r.hops) for r in graph.resolve_redirects(spark.createDataFrame([*chain, (None, "x")], "src string, dst string")).collect()}
    assert found == {f"p{k}": ("p100", 100 - k) for k in range(100)} | {x: (None, None) for x in ("in", "c0", "c1", "c2")}
    templates = spark.createDataFrame([(f"T{k}", f"{{{{t{k + 1}}}}}") for k in range(40)], "title string, text string")
    pages = spark.createDataFrame([("p", "{{t0}}"), ("q", None)], "title string, text string")
    assert {r.template for r in graph.template_closure(pages, templates).collect()} == {f"T{k}" for k in range(41)}


def test_navigation(spark):
    deep = "".join(f"{'*' * (k + 1)} i{k}\n" for k in range(30))
    nodes = trees.node_table(spark.createDataFrame([("T", deep)], "title string, text string"), ())
    root = nodes.where("parent_id is null")
    everything = {r.node_id for r in nodes.collect()}
    assert {r.node_id for r in trees.descendants(nodes, root).collect()} == everything - {0}
    deepest = nodes.where("caption = 'i29'")
    assert trees.ancestors(nodes, deepest).count() == 61
    assert {r["class"] for r in trees.leaves(nodes).collect()} == {"Text"}
    assert trees.siblings(nodes, deepest).count() == 0
    item = nodes.where("class = 'Item'").orderBy("node_id").limit(1)
    assert {r["class"] for r in trees.children(nodes, item).collect()} == {"Text", "ItemList"}
    assert trees.levels(spark.createDataFrame([("T", "* a")], "title string, text string"), ()).orderBy("node_id").collect()[-1].level == 3


def test_samples_do_not_depend_on_partitions(spark):
    docs = spark.createDataFrame([(f"t{k}", f"x{k}") for k in range(400)], "title string, text string")
    found = [{r.title for r in stats.sample_documents(docs.repartition(n), 0.5, 3).collect()} for n in (1, 5)]
    assert found[0] == found[1] and 150 < len(found[0]) < 250


def test_fewer_neighbours_than_asked(spark):
    """Heads with few neighbours take the rest by name, as the full list of pairs gives it."""
    rows = [("a", "x", 1), ("b", "x", 2), ("c", "x", 1), ("c", "y", 3), ("d", "z", 1), ("e", "y", 1), ("f", "q", 2)]
    vectors = spark.createDataFrame(rows, "head string, feature string, cnt long")
    for name in similarity.METRICS:
        for k in (1, 2, 4, 50):
            full = similarity.top_neighbours(similarity.METRICS[name](vectors), k)
            assert sorted(similarity.similar_words(vectors, name, k=k).collect()) == sorted(full.collect())


def test_pairs_of_frequent_words_only(spark, monkeypatch):
    """Words of too few documents are left out before pairs are made, or their pairs after, with the same result."""
    rng = np.random.default_rng(5)
    docs = spark.createDataFrame([(" ".join(rng.choice(["a", "b", "c", "", "dé", *[f"r{n}" for n in range(40)]], 30)),) for _ in range(30)] + [(None,), ("",)], "text string")
    found = sorted(windows.cooccurrence(docs, 6, 3, 3).collect())
    monkeypatch.setattr(windows, "LISTED_WORDS", 0)
    assert found and found == sorted(windows.cooccurrence(docs, 6, 3, 3, at_once=50).collect())


def test_authors_and_reverts(spark):
    rows = [("p", 1, "Ann", "", False, 10), ("p", 2, "Vandal", "", False, 99), ("p", 3, "Ann", "undo 2", False, 10), ("p", 4, "RoBot", "", False, 11), ("p", 5, "1.2.3.4", "", True, 12)]
    found = spark.createDataFrame(rows, "title string, revid long, user string, comment string, anon boolean, size long")
    assert revisions.author_list(found).first().authors == ["Ann", "Vandal", "ANONIPEDITS:1"]
    assert [(r.revid, r.reverted_by) for r in revisions.reverts(found).collect()] == [(2, 3)]


WIKI = "Lead [[a|link]].\n\n== One ==\n* item\n** sub\n{| class=\"x\"\n| 1 || 2\n|}\n=== Two ===\n code\n[[Category:C]]\n== See also ==\ngone"


def test_trees(spark):
    pages = spark.createDataFrame([("T", WIKI), ("E", None)], "title string, text string")
    nodes = trees.node_table(pages)
    assert nodes.where("title = 'T' and class = 'CategoryLink'").count() == 0
    found = {tuple(r["index"]): r.text for r in trees.section_table(pages).where("title = 'T'").collect()}
    assert found[()] == "Lead link." and "sub" in found[1,]
    assert "gone" not in trees.plain_texts(pages).where("title = 'T'").first().text
    assert trees.node_histogram(nodes).where("class = 'Section'").first().weight >= 2
    sections = nodes.where("class = 'Section'")
    assert trees.descendants(nodes, sections).count() > trees.children(nodes, sections).count() > 0
    rules = [("Section", "children", "forbid", ("ItemList",)), ("Item", "parent", "allow", ("ItemList",))]
    assert {r.constraint for r in trees.broken_rules(pages, rules).collect()} == {"forbid"}


def test_passes():
    N = tree.Node
    root = N("Article", children=[N("Paragraph", children=[N("Text", "a"), N("DefinitionList", children=[N("DefinitionTerm", children=[N("Text", "t")])]), N("Text", "b")])])
    tree.fix_nesting(root)
    assert [c.kind for c in root.children] == ["Paragraph", "DefinitionList", "Paragraph"]
    root = N("Article", children=[N("Underline", children=[N("Center", children=[N("Text", "x")])])])
    tree.swap_nodes(root)
    assert root.children[0].kind == "Center" and root.children[0].children[0].kind == "Underline"
    root = N("Article", children=[N("Reference", attrs={"name": "r"}), N("Reference", children=[N("Text", "x")], attrs={"name": "r"})])
    tree.fix_references(root)
    assert [bool(c.children) for c in root.children] == [True, False]
    root = N("Article", children=[N("Chapter"), N("Section"), N("Chapter"), N("Section")])
    tree.fix_chapters(root)
    assert [len(c.children) for c in root.children] == [1, 1]
    cell = lambda x, **a: N("Cell", children=[N("Text", x)], attrs=a)
    root = N("Article", children=[N("Table", children=[N("Row", children=[cell("a", colspan="9")]), N("Row", children=[cell("b"), cell("c")])])])
    tree.fix_colspans(root)
    assert root.of("Cell")[0].attrs["colspan"] == "2"
    root = N("Article", children=[N("Table", children=[N("Row", children=[cell("a")]), N("Row", children=[cell("b")])])])
    tree.single_column_tables(root)
    assert [c.kind for c in root.children] == ["Div", "Div"]
