import bz2

import pytest
from pyspark.sql import functions as F

from corpuscle.plans import jobs
from corpuscle.sources import corpus, dump, vectors
from corpuscle.streaming import counts

PAGE = "<page><title>{}</title><id>{}</id><revision><id>{}</id><timestamp>2009-09-29T00:00:00Z</timestamp><contributor><username>U</username></contributor><text xml:space=\"preserve\">{}</text></revision></page>\n"


@pytest.fixture
def wiki(tmp_path):
    pages = [("Alpha", "Alpha &amp;amp; [[beta|Beta]] &lt;ref&gt;x&lt;/ref&gt; 3rd [[fr:X]]"), ("Beta", "#REDIRECT [[Alpha]]"), ("Image:x", "no"), ("Category:C", "[[Category:D]]")]
    body = "<mediawiki>" + "".join(PAGE.format(t, k, k + 100, x) for k, (t, x) in enumerate(pages)) + "</mediawiki>"
    path = tmp_path / "shards"
    path.mkdir()
    (path / "a.xml.bz2").write_bytes(bz2.compress(body.encode()))
    (path / "a-result.xml.bz2").write_bytes(b"")
    return str(path)


def test_wikipedia(spark, wiki):
    assert [p.rsplit("/", 1)[-1] for p in corpus.shards(spark, wiki)] == ["a.xml.bz2"]
    paths = corpus.shards(spark, wiki, 1)
    rows = {r.title: r for r in corpus.read_corpus(spark, paths, "wikipedia-strict", ("Image:",)).collect()}
    assert set(rows) == {"Alpha", "Beta", "Category:C"}
    assert rows["Alpha"].links == ["[[beta|Beta]]", "[[fr:X]]"]
    assert "3rd" not in rows["Alpha"].text and "Beta" in rows["Alpha"].text and "<ref" not in rows["Alpha"].text
    assert rows["Beta"].flags == ["redirect"]
    assert {(r.kind, r.src, r.dst) for r in jobs.link_graph(spark, paths).where("src = 'Beta'").collect()} == {("REDIRECT", "Beta", "Alpha")}
    assert {(r.title, r.category) for r in jobs.category_graph(spark, paths).collect()} == {("Category:C", "Category:D")}


def test_gigaword_and_plain(spark, tmp_path):
    text = "<DOC id=\"1\" type=\"story\">\n<HEADLINE>\nA head\n</HEADLINE>\n<TEXT>\n<P>\nOne, two.\n</P>\n</TEXT>\n</DOC>\n<DOC id=\"2\">\n<TEXT>\nThree\n</TEXT>\n</DOC>\n"
    (tmp_path / "g.txt.bz2").write_bytes(bz2.compress(text.encode()))
    rows = {r.title: r.text for r in corpus.read_corpus(spark, str(tmp_path / "g.txt.bz2"), "gigaword").collect()}
    assert "One , two ." in rows["A head"] and "Three" in rows[""]
    (tmp_path / "p.txt").write_text("a b\nc\n")
    assert corpus.read_corpus(spark, str(tmp_path / "p.txt"), "plain").count() == 2
    with pytest.raises(ValueError, match="unknown source type"):
        corpus.read_corpus(spark, "x", "nothing")


def test_vector_files(spark, tmp_path):
    rows = spark.createDataFrame([("ask", "b:c", 2), ("ask", "foo", 3), ("go", "x", 1)], "head string, feature string, cnt long")
    vectors.write_vectors(rows, str(tmp_path / "v"))
    assert {tuple(r) for r in vectors.read_vectors(spark, str(tmp_path / "v")).collect()} == {("ask", "b:c", 2), ("ask", "foo", 3), ("go", "x", 1)}
    (tmp_path / "t.tsv").write_text("the\t900\t80\na\tx\nb\t1\t2\t3\n")
    assert [tuple(r) for r in vectors.read_term_stats(spark, str(tmp_path / "t.tsv")).collect()] == [("the", 900, 80)]
    (tmp_path / "w.txt").write_text("the\t1\n\nof\n")
    head = spark.createDataFrame([("of",)], "word string")
    assert [r.word for r in vectors.read_words(spark, str(tmp_path / "w.txt"), head).collect()] == ["the"]


def test_dump_and_store(spark, wiki, tmp_path):
    pages = dump.read_dump(spark, f"{wiki}/a.xml.bz2")
    rows = {r.title: r for r in pages.collect()}
    assert set(rows) == {"Alpha", "Beta", "Category:C"} and rows["Category:C"].namespace == 14
    assert rows["Beta"].redirect == "Alpha" and rows["Alpha"].username == "U" and rows["Alpha"].timestamp.year == 2009
    dump.write_store(pages, str(tmp_path / "store"))
    assert dump.read_store(spark, str(tmp_path / "store"), "alpha").count() == 1
    assert dump.read_store(spark, str(tmp_path / "store"), namespace=14).count() == 1
    over = pages.where("title = 'Alpha'").withColumn("text", F.lit("new"))
    assert {r.text for r in dump.overlay(pages, over).where("title = 'Alpha'").collect()} == {"new"}


def test_streams(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "1.txt").write_text("a b a\n")
    (source / "2.txt").write_text("b c\n")
    found = counts.run_to_end(counts.term_counts(counts.stream_lines(spark, str(source)), 0), "terms", str(tmp_path / "check"))
    assert {(r.word, r.tf, r.df) for r in found.collect()} == {("a", 2, 1), ("b", 2, 2), ("c", 1, 1)}
