from pyspark.sql import functions as F

from corpuscle.operators import numbering


def test_numbers_follow_the_order(spark):
    rows = spark.createDataFrame([(k * 7919 % 1000, str(k)) for k in range(1000)], "x long, s string").repartition(7)
    found = numbering.numbered(rows, F.desc("x")).collect()
    assert sorted((r.n, r.x) for r in found) == list(zip(range(1000), range(999, -1, -1)))


def test_ties_are_split_and_numbered_once(spark):
    rows = spark.range(5000).select(F.lit(1).alias("x"), F.col("id").alias("_row_n"), F.lit("old").alias("n")).repartition(5)
    found = numbering.numbered(rows, "x")
    assert sorted(r.n for r in found.collect()) == list(range(5000)) and found.columns == ["x", "_row_n", "n"]
    again = numbering.numbered(rows.repartition(3), "x")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, found.collect()))
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()


def test_nulls_repeats_and_empty_tables(spark):
    rows = spark.createDataFrame([(None, "a"), (2, None), (2, None), (1, "b")], "x long, s string")
    assert [(r.n, r.x) for r in sorted(numbering.numbered(rows, "x").collect(), key=lambda r: r.n)] == [(0, None), (1, 1), (2, 2), (3, 2)]
    assert numbering.numbered(rows.where("false"), "x").collect() == []


def test_chunks(spark):
    found = numbering.row_chunks(spark.range(25).repartition(4), 10, "id").collect()
    assert sorted((r.chunk, r.place, r.id) for r in found) == [(k // 10, k % 10, k) for k in range(25)]
