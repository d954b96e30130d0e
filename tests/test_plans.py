"""Plans keep the shape that makes them scale."""

from pyspark.sql import functions as F

from corpuscle.operators import stats, windows
from corpuscle.plans import queries


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def test_term_statistics_shuffle_once(spark, sf_dir):
    found = plan(stats.term_doc_freq(docs(spark, sf_dir)))
    assert found.count("Exchange") == 1 and "Python" not in found and "partial_sum" in found
    assert "ReadSchema: struct<text:string>" in found


def test_windows_need_no_join(spark, sf_dir):
    heads = spark.createDataFrame([("the",)], "word string")
    found = plan(windows.raw_contexts(docs(spark, sf_dir), heads))
    assert found.count("SortMergeJoin") + found.count("CartesianProduct") + found.count("NestedLoop") == 0


def test_pairs_shuffle_sums_only(spark, sf_dir):
    found = plan(windows.cooccurrence(docs(spark, sf_dir).select("doc_id", "text"), 10))
    assert found.count("Exchange") == 1 and "partial_sum" in found


def test_filters_reach_the_files(spark, sf_dir):
    rows = docs(spark, sf_dir).where(F.col("lang") == "de")
    assert "EqualTo(lang,de)" in plan(stats.corpus_totals(rows))


def test_weights_join_without_cross_products(spark, sf_dir):
    found = plan(queries.weight_tfidf_mass(spark, sf_dir))
    assert "CartesianProduct" not in found and "NestedLoop" not in found
