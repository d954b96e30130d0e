"""What shows only on larger tables: rows that repeat, folders in place of files, groups and batches of any size."""

import datetime
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from corpuscle.functions import tree
from corpuscle.operators import ranges, trees
from corpuscle.plans import markup
from corpuscle.plans.registry import ORACLE_SQL, QUERIES
from corpuscle.sources import vectors

from .test_queries import same


def against_sql(spark, name: str, folder) -> bool:
    con = duckdb.connect()
    for table in os.listdir(folder):
        inside = "/*.parquet" if os.path.isdir(f"{folder}/{table}") else ""
        con.execute(f"CREATE VIEW {table[:-8]} AS SELECT * FROM '{folder}/{table}{inside}'")
    return same(QUERIES[name](spark, str(folder)).toPandas(), con.execute(ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", ["page_links", "degree_table", "degree_file", "in_degree_docs"])
def test_links_of_pages_that_share_a_url(spark, tmp_path, name):
    rows = [(k, f"http://h/{k % 3}", "".join(f'<a href="http://h/{n}">x</a>' for n in (0, 1, k % 7))) for k in range(30)]
    spark.createDataFrame([*rows, (30, "http://h/n", None)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert against_sql(spark, name, tmp_path)


def test_authors_of_pages_that_no_named_author_edited(spark, tmp_path):
    rows = [(k, datetime.datetime(2020, 1, 1), u, "click", 1.0) for k, u in enumerate([11, 22, 1, *[7] * 47, 11, 22, 14, *[14] * 47, 1, 11])]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    assert against_sql(spark, "author_lists", tmp_path)


@pytest.mark.parametrize("name", ["stream_term_counts", "stream_windowed_counts", "stream_expiring_state"])
def test_streams_of_tables_in_parts(spark, sf_dir, tmp_path, name):
    for table in ("documents", "events"):
        spark.read.parquet(f"{sf_dir}/{table}.parquet").repartition(3).write.parquet(f"{tmp_path}/{table}.parquet")
    assert against_sql(spark, name, tmp_path)


def test_small_files_of_pages_are_many_tasks(spark, sf_dir):
    assert markup._customers(spark, sf_dir, markup.PAGE).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("lines", [["----"], ["{|", *["| a || b"] * 3000, "|}"], ["a", ""]])
def test_a_page_is_parsed_in_time_that_grows_with_its_lines(monkeypatch, lines):
    moved, put = [], tree.Node.put
    monkeypatch.setattr(tree.Node, "put", lambda node, children: moved.append(len(children)) or put(node, children))
    page = tree.parse("\n".join(lines if len(lines) > 2 else lines * 3000))
    assert sum(1 for _ in page.walk()) > 3000 and sum(moved) < 20_000
    assert all(child.parent is node for node in page.walk() for child in node.children)


def test_nodes_below_nested_nodes_come_once(spark):
    pages = spark.createDataFrame([("a", "== A ==\n=== B ===\n==== C ====\nx"), ("b", "== A ==\ny")], "title string, text string")
    nodes = trees.node_table(pages, ())
    found = [(r.title, r.node_id) for r in trees.descendants(nodes, nodes.where("class = 'Section'")).collect()]
    top = {("a", 0), ("a", 1), ("b", 0), ("b", 1)}  # the pages and their first sections
    assert len(found) == len(set(found)) and set(found) == {(r.title, r.node_id) for r in nodes.collect()} - top


def test_aggregates_over_ranges_list_no_pairs(spark):
    top = 2**63 - 1
    values = [*range(-40, 40), *range(-5, 5), -top - 1, top, top - 1, None]
    spans = [(k, a, b) for k, (a, b) in enumerate([(-40, 39), (-7, 12), (0, 0), (5, 4), (-top - 1, top), (top, top), (-3, top), (None, 4), (100, 200), (1, 8)])]
    points = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "id long, v long")
    bands = spark.createDataFrame(spans, "band long, low long, high long")
    made = {"n": F.count(F.lit(1)), "first": F.min("id")}
    found = ranges.aggregate_over(points, bands, "band", "v", "low", "high", made, {"n": F.sum("n"), "first": F.min("first")})
    inside = {k: [i for i, v in enumerate(values) if v is not None and a is not None and a <= v <= b] for k, a, b in spans}
    assert {r.band: (r.n, r.first) for r in found.collect()} == {k: (len(x), x[0]) for k, x in inside.items() if x}
    # 20,000 equal points and 20,000 equal bands would be 400 million pairs
    many = spark.range(20_000).select("id", F.lit(7).cast("long").alias("v"))
    wide = spark.range(20_000).select(F.col("id").alias("band"), F.lit(0).cast("long").alias("low"), F.lit(9).cast("long").alias("high"))
    plan = ranges.aggregate_over(many, wide, "band", "v", "low", "high", made, {"n": F.sum("n"), "first": F.min("first")})
    assert plan.agg(F.sum("n"), F.max("first")).first()[:] == (400_000_000, 0)


@pytest.mark.parametrize("name", ["wiki_tokens", "tagged_words", "mapped_words", "missing_languages"])
def test_batches_of_texts_are_bounded(spark, sf_dir, name):
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(setting)
    try:
        spark.conf.set(setting, str(256 << 20))
        QUERIES[name](spark, sf_dir)
        assert int(spark.conf.get(setting)) <= 4 << 20
    finally:
        spark.conf.set(setting, before)


def test_entries_of_a_line_do_not_carry_the_line(spark):
    found = vectors.parse_lines(spark.createDataFrame([("h\ta:b:1\tbad\tc:-2\t:3",), ("alone",), ("",)], "value string"))
    assert sorted(map(tuple, found.collect())) == [("h", "", 3), ("h", "a:b", 1), ("h", "c", -2)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("substring_index")  # the head is cut off below
