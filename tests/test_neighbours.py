import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuscle.operators import neighbours, similarity


def weights(spark, rows):
    return spark.createDataFrame(rows, "head string, feature string, weight double")


def drawn(rng, heads, features, low, common=0):
    """Vectors over features of unequal frequency; the first common ones are in every head."""
    rows = []
    for h in range(heads):
        for f in range(features):
            if f < common or rng.random() < 2 / (f + 2):
                rows.append((f"h{h}", f"f{f}", rng.choice([rng.uniform(low, 3), 1.0, 1.0])))
    return rows


CASES = [(1, (40, 30, 0.1, 0)), (4, (40, 30, -1.0, 2)), (4, (30, 40, -6.0, 0)), (2, (12, 200, -0.5, 3)), (100, (60, 4, -2.0, 1))]


@pytest.mark.parametrize("k, case", CASES)
def test_equals_the_full_product(spark, k, case, monkeypatch):
    monkeypatch.setattr(neighbours, "PART_HEADS", 5)
    monkeypatch.setattr(neighbours, "RARE", 2)
    rng = random.Random(k)
    rows = drawn(rng, *case) + [("alone", "only", 2.0), ("zero", "f0", 0.0), ("none", "f1", -1.0)]
    table = spark.createDataFrame(rows, "head string, feature string, weight double").repartition(3)
    full = similarity.top_neighbours(similarity.weighted_jaccard(table), k)
    found = neighbours.top_weighted_jaccard(table, k)
    key = lambda r: (r.head, r.target)
    assert [(r.head, r.target, pytest.approx(r.score, abs=2e-6)) for r in sorted(full.collect(), key=key)] == [(r.head, r.target, r.score) for r in sorted(found.collect(), key=key)]


def test_pairs_that_cannot_win_are_not_made(spark):
    """Many heads share one weak common feature; each has a partner with which it shares much."""
    rows = [(f"h{h:03}", "common", 0.1) for h in range(300)] + [(f"h{h:03}", f"g{h // 3}", 5.0) for h in range(300)]
    table = weights(spark, rows)
    sums, postings = neighbours._sums(table), neighbours._positive_postings(table)
    bounds = neighbours._first_bounds(postings, table, sums, 2, 6)
    assert bounds.count() == 300
    assert neighbours._likely(postings, sums, bounds, 6).count() == 600
    assert neighbours.top_weighted_jaccard(table, 2).count() == 600


def test_no_plan_lists_all_pairs(spark, monkeypatch):
    plans, stage = [], neighbours.stage

    def kept(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stage(df, label)

    monkeypatch.setattr(neighbours, "stage", kept)
    vectors = spark.createDataFrame([(f"h{k % 50}", f"f{k % 17}", k % 5 + 1) for k in range(850)], "head string, feature string, cnt long").dropDuplicates(["head", "feature"])
    found = similarity.similar_words(vectors, k=3)
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert found.count() == 150 and len(plans) > 8
    assert not any("NestedLoop" in p or "Cartesian" in p for p in plans)


def test_repeats_nulls_and_nothing(spark):
    assert neighbours.top_weighted_jaccard(weights(spark, []), 3).collect() == []
    rows = [("a", "x", 1.0), ("b", "x", 1.0), ("c", "x", None), (None, "x", 1.0), ("d", "y", 1.0)]
    found = neighbours.top_weighted_jaccard(weights(spark, rows), 3)
    assert {(r.head, r.target, r.score) for r in found.collect()} == {("a", "b", 1.0), ("b", "a", 1.0), ("a", "d", 0.0), ("b", "d", 0.0), ("d", "a", 0.0), ("d", "b", 0.0)}
    extra = weights(spark, rows).withColumn("at", F.lit(1)).withColumn("total", F.lit("x"))
    assert sorted(neighbours.top_weighted_jaccard(extra, 3).collect()) == sorted(found.collect())


@pytest.mark.parametrize("k, per_head, common", [(4, 6, 0), (50, 3, 1), (3, 12, 2)])
def test_short_lists_are_scored_without_shuffling_pairs(spark, monkeypatch, k, per_head, common):
    """Heads that share little with many others: bounds prune nothing, so that no candidate may become a row."""
    monkeypatch.setattr(similarity, "FEW_HEADS", 5)
    monkeypatch.setattr(neighbours, "TASK_PAIRS", 200)
    monkeypatch.setattr(neighbours, "BATCH_PAIRS", 50)
    labels, stage = [], neighbours.stage
    monkeypatch.setattr(neighbours, "stage", lambda df, label: labels.append(label) or stage(df, label))
    rng = random.Random(k)
    drawn = {(f"{'é' * (h % 2)}h{h}", f"f{f}"): rng.choice([1, 1, 1, 2, 5]) for h in range(70) for f in [*range(common), *rng.sample(range(common, 80), per_head)]}
    rows = [(h, f, n) for (h, f), n in drawn.items()] + [("alone", "own", 1), ("h0", "void", 0), ("h1", "void", 0), ("zero", "void", 0), (None, "f5", 2), ("h3", None, 1), ("h4", "f99", None)]
    vectors = spark.createDataFrame(rows, "head string, feature string, cnt long").repartition(3)
    weights = similarity.weight_ttest(vectors).where("head is not null and weight is not null")
    full = similarity.top_neighbours(similarity.weighted_jaccard(weights), k)
    found = similarity.similar_words(vectors, k=k)
    key = lambda r: (r.head, r.target)
    assert [(r.head, r.target, pytest.approx(r.score, abs=2e-6)) for r in sorted(full.collect(), key=key)] == [(r.head, r.target, r.score) for r in sorted(found.collect(), key=key)]
    assert "lists" in labels and not {"tried", "pairs"} & set(labels)


def test_units_round_as_spark_does(spark):
    rng = random.Random(1)
    values = [0.0, 1.0, 0.0256415, 0.0000005, 0.00000049999999, -0.0000015, 2.5e-6, 12.3456785, *[rng.randrange(10**7) / 1e7 for _ in range(2000)], *[rng.gauss(0, 3) for _ in range(200)]]
    rounded = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double").select("k", F.round("v", 6).alias("r"))
    assert neighbours._units(np.array(values), 6).tolist() == [round(r.r * 1e6) for r in sorted(rounded.collect())]
