"""Range joins, user reductions, table functions, namespaces by language, one file from many parts, counted rejects, expiring state."""

import bz2
import glob
import random
from collections import Counter

import pandas as pd
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import Observation

from corpuscle.functions import tables
from corpuscle.operators import ranges, reductions
from corpuscle.sources import dump, vectors
from corpuscle.streaming import counts

BIG = 2**62


def test_range_join(spark):
    rng = random.Random(3)
    spans = [(k, a := rng.randrange(-300, 300), a + rng.choice([0, 1, 2, 7, 64, 500])) for k in range(150)]
    spans += [(1000, -BIG, BIG), (1001, 5, 4), (1002, None, 9), (1003, 7, None), (1004, 0, 0), (1004, 0, 0)]
    points = [(k, rng.randrange(-320, 320)) for k in range(200)] + [(500, None), (501, BIG), (502, -BIG), (503, 0), (503, 0)]
    found = ranges.range_join(spark.createDataFrame(points, "id long, x long"), spark.createDataFrame(spans, "r long, lo long, hi long"), "x", "lo", "hi")
    expected = Counter((i, x, r, lo, hi) for i, x in points for r, lo, hi in spans if None not in (x, lo, hi) and lo <= x <= hi)
    assert Counter(map(tuple, found.collect())) == expected
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()


def test_innermost_and_no_ranges(spark):
    points = spark.createDataFrame([(5,), (5,), (50,), (500,), (None,)], "x long")
    spans = spark.createDataFrame([("all", 0, 100), ("ten", 0, 10), ("five", 5, 5), ("other", 41, 51), ("same", 41, 51)], "name string, lo long, hi long")
    assert sorted(map(tuple, ranges.innermost(points, spans, "x", "lo", "hi").collect())) == [(5, "five", 5, 5), (50, "other", 41, 51)]
    assert ranges.range_join(points, spans.where("false"), "x", "lo", "hi").collect() == []


def test_character_blocks(spark):
    docs = spark.createDataFrame([(1, "aÉ😀a"), (2, ""), (3, None)], "doc_id long, text string")
    blocks = spark.createDataFrame([("ascii", 0, 127), ("a", 97, 97), ("faces", 0x1F600, 0x1F64F), ("all", 0, 0x10FFFF)], "block string, first long, last long")
    found = {tuple(r) for r in ranges.character_blocks(docs, blocks).collect()}
    assert found == {(1, "ascii", 2), (1, "a", 2), (1, "faces", 1), (1, "all", 4)}


class Spread:
    """Least, largest and number of values; keeps how many rows it ever saw at once."""

    state, result = "low long, high long, n long, most long", "low long, high long, n long, most long"

    def partial(self, rows: pd.DataFrame) -> tuple:
        return int(rows["v"].min()), int(rows["v"].max()), len(rows), len(rows)

    def merge(self, one, other):
        return min(one[0], other[0]), max(one[1], other[1]), one[2] + other[2], max(one[3], other[3])

    def final(self, state):
        return [] if state[0] > 10**6 else [state]


@pytest.mark.parametrize("held", [1, 50_000])
def test_reductions(spark, held):
    rows = [("hot" if k % 3 else None if k % 2 else f"k{k % 7}", k) for k in range(4000)] + [("gone", 10**7)]
    table = spark.createDataFrame(rows, "key string, v long").repartition(9)
    found = {r.key: (r.low, r.high, r.n) for r in reductions.reduce_by_key(table, "key", Spread, held, 3).collect()}
    expected: dict = {}
    for key, v in rows[:-1]:
        low, high, n = expected.get(key, (v, v, 0))
        expected[key] = (min(low, v), max(high, v), n + 1)
    assert found == expected
    assert max(r.most for r in reductions.reduce_by_key(table, "key", Spread, held, 3).collect()) < 500  # no group of rows meets whole
    assert reductions.reduce_by_key(table.where("false"), "key", Spread).collect() == []


def _split(text, size):
    for k in range(0, len(text or ""), size):
        yield text[k : k + size], k


def _known_size(values):
    if not values[1]:
        raise ValueError("size must be a constant")


_split.check = _known_size


def test_table_function_for_mappers(spark):
    tables.register_mapper(spark, "cut_text", _split, "part string, at int")
    spark.createDataFrame([(1, "abcde"), (2, None), (3, "")], "id long, t string").createOrReplaceTempView("cut_docs")
    found = spark.sql("SELECT id, part, at FROM cut_docs, LATERAL cut_text(t, 2)").collect()
    assert sorted(map(tuple, found)) == [(1, "ab", 0), (1, "cd", 2), (1, "e", 4)]
    outer = spark.sql("SELECT id, part FROM cut_docs LEFT JOIN LATERAL cut_text(t, 2) ON true WHERE id > 1").collect()
    assert sorted(map(tuple, outer)) == [(2, None), (3, None)]
    with pytest.raises(AnalysisException, match="constant"):
        spark.sql("SELECT * FROM cut_docs, LATERAL cut_text(t, id)").collect()


class Gaps:
    def __init__(self):
        self.last = None

    def add(self, row):
        if self.last is not None:
            yield row["k"], row["v"] - self.last
        self.last = row["v"]

    def end(self):
        yield None, self.last


def test_table_function_by_key(spark):
    tables.register_by_key(spark, "gaps_of", Gaps, "k", "v", "k string, gap long")
    spark.createDataFrame([("a", 9), ("b", 1), ("a", 2), ("a", 5), (None, 3)], "k string, v long").repartition(3).createOrReplaceTempView("gap_rows")
    found = spark.sql("SELECT * FROM gaps_of(TABLE(gap_rows))").collect()
    assert sorted(map(tuple, found), key=str) == sorted([("a", 3), ("a", 4), (None, 9), (None, 1), (None, 3)], key=str)
    with pytest.raises(AnalysisException, match="columns k and v"):
        spark.sql("SELECT * FROM gaps_of(TABLE(SELECT 1 AS k))").collect()


def test_namespaces_by_language(spark):
    rows = [("de", "Kategorie:x"), ("en", "Kategorie:x"), ("fr", ":modèle:a b"), ("xx", "Category:x"), (None, "Category:x"), ("de", "Category:x"), ("es", None), ("en", "no_prefix")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "lang string, title string, ns string")
    found = {(r.lang, r.title): (r.ns, r.partial, r.full) for r in dump.split_by_language(pages, dump.namespace_table(spark)).collect()}
    assert found["de", "Kategorie:x"] == (14, "X", "Kategorie:X") and found["en", "Kategorie:x"] == (0, "Kategorie:x", "Kategorie:x")
    assert found["fr", ":modèle:a b"] == (10, "A b", "Modèle:A b") and found["xx", "Category:x"][0] == found[None, "Category:x"][0] == 0
    assert found["de", "Category:x"][0] == 14 and found["es", None] == (0, None, None) and found["en", "no_prefix"][1] == "No prefix"
    own = dump.namespace_table(spark, {"xx": {"Klasse": 14}})
    assert dump.split_by_language(spark.createDataFrame([("xx", "klasse:y")], "lang string, title string"), own).first().ns == 14


def test_one_file_from_many_parts(spark, tmp_path):
    rows = spark.createDataFrame([(f"h{k * 37 % 500:03}", f"f{j}", k + 1) for k in range(500) for j in range(k % 3 + 1)], "head string, feature string, cnt long").repartition(6)
    for codec in ("bzip2", "none"):
        path = f"file://{tmp_path}/{codec}"
        vectors.write_vectors(rows, path, one_file=True, compression=codec)
        files = glob.glob(f"{tmp_path}/{codec}/part-*")
        assert len(files) == 1 and not glob.glob(f"{tmp_path}/{codec}-parts*")
        lines = (bz2.open(files[0], "rt") if codec == "bzip2" else open(files[0])).read().splitlines()
        assert lines == sorted(lines) and len(lines) == 500
        assert sorted(map(tuple, vectors.read_vectors(spark, path).collect())) == sorted(map(tuple, rows.collect()))
    plan = rows.groupBy("head").count().orderBy("head")._jdf.queryExecution().toString()
    assert "rangepartitioning" in plan
    with pytest.raises(ValueError, match="end to end"):
        vectors.write_table(rows, f"file://{tmp_path}/x", one_file=True, compression="snappy")
    vectors.write_table(rows.where("false"), f"file://{tmp_path}/none_at_all", one_file=True)
    assert spark.read.text(f"file://{tmp_path}/none_at_all").count() == 0


def test_rejects_are_counted_and_listed(spark, tmp_path):
    lines = ["a\t1\t2", "b\t1", "c\tx\t2", "d\t1\t2\t3", "e\t\t2", "f\t3\t4"]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(2).write.text(f"file://{tmp_path}/t")
    seen = Observation()
    found = vectors.read_term_stats(spark, f"file://{tmp_path}/t", seen)
    assert sorted(map(tuple, found.collect())) == [("a", 1, 2), ("f", 3, 4)] and seen.get == {"n_lines": 6, "n_rejected": 4}
    assert {r.line for r in vectors.rejected_lines(spark, f"file://{tmp_path}/t").collect()} == set(lines[1:5])
    degrees = Observation()
    assert vectors.read_degrees(spark, f"file://{tmp_path}/t", 3, degrees).collect()[0].doc == "f"
    assert degrees.get["n_rejected"] == 4


def test_quiet_keys_are_forgotten(spark, tmp_path):
    """Three batches: a key that comes back within the time to live goes on, after it starts anew; its state has gone by then."""
    hour = lambda h: (pd.Timestamp("2024-01-01") + pd.Timedelta(hours=h)).to_pydatetime()
    batches = [[(1, "a", 0), (2, "b", 0), (3, "a", 5)], [(4, "a", 10), (5, None, 11)], [(6, "b", 40), (7, "a", 41), (8, None, 12 + 28)]]
    schema = "event_id long, user_id string, ts timestamp, value double"
    for rows in batches:
        spark.createDataFrame([(i, u, hour(h), float(i) if i != 2 else None) for i, u, h in rows], schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = counts.stream_parquet(spark, f"file://{tmp_path}/in", spark.read.parquet(f"file://{tmp_path}/in").schema, 1)
    with counts.use_rocks(spark):
        found = counts.run_to_end(counts.counts_until_quiet(stream, ttl="6 hours"), "t", f"file://{tmp_path}/c", "append").collect()
    assert {(r.event_id, r.user_id, r.n, r.total) for r in found} == {(1, "a", 1, 1.0), (2, "b", 1, 0.0), (3, "a", 2, 4.0), (4, "a", 3, 8.0), (5, None, 1, 5.0), (6, "b", 1, 6.0), (7, "a", 1, 7.0), (8, None, 1, 8.0)}
