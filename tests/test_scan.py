import json

import pytest
from pyspark.sql import functions as F

from corpuscle.operators import scan
from corpuscle.sources import dump, wikis

TEXT = "== H ==\n* [[a|b]] ''it'' {{t}}\n{| x\n|-\n| 1 || 2\n|}\n<ref>q</ref> &amp; http://x.org __TOC__\n----\n pre"


def test_tokens_make_up_the_text(spark):
    assert "".join(t for _, _, t in scan.scan(TEXT)) == TEXT
    rows = scan.token_table(spark.createDataFrame([("p", TEXT), ("q", None)], "title string, text string"))
    found = {r["class"] for r in rows.collect()}
    assert {"section", "item", "link_open", "style", "template_open", "table_open", "row", "column", "tag", "end_tag", "entity", "url", "magic", "rule", "pre"} <= found


def test_extensions(spark):
    page = spark.createDataFrame([("p", "<rot13>Uryyb</rot13> <poem>a\nb</poem><hiero>x</hiero><eat name=\"N\">good</eat>")], "title string, text string")
    assert scan.expand_extensions(page).first().text == "Hello :a\n:b* '''N''' good"


def test_groups(spark):
    row = spark.createDataFrame([([1, 2, 3],), ([],)], "a array<int>").select(scan.groups_of(F.col("a"), 2).alias("g")).collect()
    assert [r.g for r in row] == [[[1, 2], [3]], []]


def test_wikis(spark, tmp_path):
    content = {"articles": {"A": {"content": "text"}}, "templates": {"T": {"content": "t"}}, "sources": {"S": {"url": "http://s"}}}
    (tmp_path / "content.json").write_text(json.dumps(content))
    pages = wikis.open_wiki(spark, "collection", str(tmp_path / "content.json"))
    assert {tuple(r) for r in pages.collect()} == {("A", "text"), ("T", "t"), ("S", "http://s")}
    over = spark.createDataFrame([("A", "new"), ("B", "more")], "title string, text string")
    assert {tuple(r) for r in wikis.open_wiki(spark, "collection", str(tmp_path / "content.json"), over).collect()} == {("A", "new"), ("B", "more"), ("T", "t"), ("S", "http://s")}
    with pytest.raises(ValueError, match="unknown kind"):
        wikis.open_wiki(spark, "nothing", "x")
    xml = "<mediawiki><siteinfo><namespaces><namespace key=\"14\">Rubrik</namespace></namespaces></siteinfo><page><title>Rubrik:x</title><id>1</id><revision><id>2</id><text>t</text></revision></page></mediawiki>"
    (tmp_path / "d.xml").write_text(xml)
    assert dump.learned_namespaces(spark, str(tmp_path / "d.xml"))["rubrik"] == 14
    wikis.build_store(spark, str(tmp_path / "d.xml"), str(tmp_path / "store"))
    assert wikis.open_wiki(spark, "store", str(tmp_path / "store")).first().title == "Rubrik:x"
