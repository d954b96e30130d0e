"""Feature weights and similarity of sparse vectors (head, feature, cnt)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.staging import stage
from . import neighbours
from .stats import uniform


def _model(vectors: DataFrame, more: DataFrame | None) -> DataFrame:
    """The vectors that a weight's statistics come from: these and any secondary ones."""
    columns = ["head", "feature", "cnt"]
    return vectors.select(*columns) if more is None else vectors.select(*columns).unionByName(more.select(*columns))


def weight_tf(vectors: DataFrame, more: DataFrame | None = None) -> DataFrame:
    return vectors.select("head", "feature", F.col("cnt").cast("double").alias("weight"))


def feature_mass(vectors: DataFrame) -> DataFrame:
    """(feature, idf): the sum of a feature's counts."""
    return vectors.groupBy("feature").agg(F.sum("cnt").cast("double").alias("idf"))


def feature_vectors(vectors: DataFrame) -> DataFrame:
    """(feature, idf): the number of vectors that hold a feature."""
    return vectors.groupBy("feature").agg(F.count(F.lit(1)).cast("double").alias("idf"))


def weight_tfidf(vectors: DataFrame, more: DataFrame | None = None, by_vectors: bool = False) -> DataFrame:
    """cnt over the feature's mass, or over the number of vectors that hold it."""
    idf = (feature_vectors if by_vectors else feature_mass)(_model(vectors, more))
    return vectors.join(idf, "feature").select("head", "feature", (F.col("cnt") / F.col("idf")).alias("weight"))


def weight_ttest(vectors: DataFrame, more: DataFrame | None = None, few: bool = False) -> DataFrame:
    """(cnt / N - a) / sqrt(a) with a = p_word p_attrib; 0 where a is 0.

    N is the sum of all counts, p_word a head's number of features over N, p_attrib a feature's counts over N.
    few: there are few heads, so that a feature's rows are few and are dealt by feature once.
    """
    known = _model(vectors, more)
    n = F.lit(known.agg(F.sum("cnt").cast("double")).first()[0])
    heads = known.groupBy("head").agg(F.count(F.lit(1)).cast("double").alias("types"))
    if few and more is None:
        mass = F.sum("cnt").over(Window.partitionBy("feature")).cast("double")
        joined = vectors.where("feature is not null").withColumn("mass", mass).join(F.broadcast(heads), "head")
    else:
        masses = known.groupBy("feature").agg(F.sum("cnt").cast("double").alias("mass"))
        joined = vectors.join(heads, "head").join(masses, "feature")
    a = F.col("types") / n * (F.col("mass") / n)
    weight = F.when(a == 0, 0.0).otherwise((F.col("cnt") / n - a) / F.sqrt(a))
    return joined.select("head", "feature", weight.alias("weight"))


#: Heads that are few: a feature's rows fit one list, and the sums of all pairs any task.
FEW_HEADS = 1000


def has_few_heads(vectors: DataFrame) -> bool:
    return vectors.select("head").distinct().limit(FEW_HEADS + 1).count() <= FEW_HEADS


def _few_tops(weights: DataFrame) -> DataFrame:
    """(head, target, top) of all pairs that share a feature, and of each head with itself, whose top is its sum, in one pass by feature."""
    lists = weights.groupBy("feature").agg(F.collect_list(F.struct("head", "weight")).alias("l"))
    left = lists.select("feature", "l", F.posexplode("l").alias("i", "a"))
    both = left.select("feature", "i", "a", F.posexplode("l").alias("j", "b"))
    both = both.where("i = j or (feature is not null and a.head != b.head)")
    return both.groupBy(F.col("a.head").alias("head"), F.col("b.head").alias("target")).agg(F.sum(F.least("a.weight", "b.weight")).alias("top"))


def weighted_jaccard(weights: DataFrame, all_pairs: bool = True, ordered: bool = True, few: bool = False) -> DataFrame:
    """(head, target, score): sum of minima over sum of maxima of the features that either has.

    maxima = sums of both - minima, so that only shared features are joined. all_pairs adds pairs that share none
    with score 0; their number is the square of the heads' by definition. Of pairs that share a feature, one whose
    maxima sum to 0 scores null. few: the heads are at most FEW_HEADS, and weights are read and dealt by feature once.
    """
    if few:
        both = stage(_few_tops(weights), "tops")
        tops, sums = both.where("head != target"), both.where("head = target").select("head", F.col("top").alias("total"))
    else:
        tops, sums = neighbours.shared_tops(weights, weights), weights.groupBy("head").agg(F.sum("weight").alias("total"))
    tops = tops if ordered else tops.where("head < target")
    scores = neighbours.scores_of(tops, sums)
    if not all_pairs:
        return scores
    targets = sums.select(F.col("head").alias("target"))
    pairs = sums.select("head").crossJoin(targets).where("head != target" if ordered else "head < target")
    joined = pairs.join(scores.withColumn("shared", F.lit(True)), ["head", "target"], "left")
    return joined.select("head", "target", F.when(F.col("shared"), F.col("score")).otherwise(0.0).alias("score"))


def jaccard(vectors: DataFrame, more: DataFrame | None = None, all_pairs: bool = True) -> DataFrame:
    """Shared features over all features of a pair."""
    return weighted_jaccard(vectors.select("head", "feature", F.lit(1.0).alias("weight")).distinct(), all_pairs)


def random_similarity(vectors: DataFrame, seed: int = 0) -> DataFrame:
    """A uniform score for each ordered pair, drawn by a hash of the seed and the pair: a baseline."""
    heads = vectors.select("head").distinct()
    pairs = heads.crossJoin(heads.withColumnRenamed("head", "target")).where("head != target")
    return pairs.withColumn("score", uniform(F.concat_ws("|", F.lit(str(seed)), "head", "target")))


def _scores_by(weight: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    def scores(vectors: DataFrame, more: DataFrame | None = None) -> DataFrame:
        known = stage(vectors.select("head", "feature", "cnt"), "vectors")
        few = has_few_heads(known)
        return weighted_jaccard(weight(known, more, few), few=few)

    return scores


#: Similarity by name: vectors and secondary vectors -> (head, target, score).
METRICS: dict[str, Callable[..., DataFrame]] = {
    "jaccard": jaccard,
    "tf_weighted_jaccard": _scores_by(lambda v, more, few: weight_tf(v)),
    "tfidf_weighted_jaccard": _scores_by(lambda v, more, few: weight_tfidf(v, more)),
    "ttest_weighted_jaccard": _scores_by(weight_ttest),
    "random": lambda v, more=None: random_similarity(v),
}


def top_neighbours(scores: DataFrame, k: int = 50, digits: int = 6) -> DataFrame:
    """(head, target, score): the k best of each head by rounded score, then target, both descending."""
    rounded = scores.withColumn("score", F.round("score", digits))
    order = Window.partitionBy("head").orderBy(F.desc("score"), F.desc("target"))
    return rounded.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= k).drop("_k")


#: Weights by metric: the metrics that are weighted Jaccard.
_WEIGHTS: dict[str, Callable[..., DataFrame]] = {
    "jaccard": lambda v, more=None: v.select("head", "feature", F.lit(1.0).alias("weight")).distinct(),
    "tf_weighted_jaccard": lambda v, more=None: weight_tf(v),
    "tfidf_weighted_jaccard": lambda v, more=None: weight_tfidf(v, more),
    "ttest_weighted_jaccard": weight_ttest,
}


def _ttest_of(n: float) -> Callable:
    """weight_ttest of arrays: counts, heads' numbers of features, features' masses."""

    def weigh(cnt: np.ndarray, types: np.ndarray, mass: np.ndarray) -> np.ndarray:
        a = types / n * (mass / n)
        return np.divide(cnt / n - a, np.sqrt(a), out=np.zeros(len(a)), where=a != 0)

    return weigh


#: Weights that are functions of a row's count and of what its head and its feature have in all, by metric.
_ARRAYS: dict[str, Callable[[float], Callable]] = {
    "ttest_weighted_jaccard": _ttest_of,
}


def similar_words(vectors: DataFrame, metric: str = "ttest_weighted_jaccard", more: DataFrame | None = None, k: int = 50) -> DataFrame:
    """The k nearest targets of each head by a metric of METRICS; of weighted Jaccard without listing all pairs, unless the heads are so few that these are fewer than the vectors' rows."""
    if metric not in _WEIGHTS:
        return top_neighbours(METRICS[metric](vectors, more), k)
    vectors = stage(vectors.select("head", "feature", "cnt"), "vectors")
    few = has_few_heads(vectors)
    if few and vectors.select("head").distinct().count() ** 2 <= vectors.count():
        weights = weight_ttest(vectors, more, few=True) if metric == "ttest_weighted_jaccard" else _WEIGHTS[metric](vectors, more)
        return top_neighbours(weighted_jaccard(weights.where("head is not null and weight is not null"), few=True), k)
    if not few and more is None and metric in _ARRAYS:
        found = neighbours.top_of_short_lists(vectors, _ARRAYS[metric], k)
        if found is not None:
            return top_neighbours(found, k)
    return neighbours.top_weighted_jaccard(_WEIGHTS[metric](vectors, more), k)


def keep_features(vectors: DataFrame, good: DataFrame) -> DataFrame:
    """Vectors restricted to the features of good (feature)."""
    return vectors.join(good.select("feature").distinct(), "feature", "left_semi").select("head", "feature", "cnt")


def _split_names(senses: DataFrame, mark: str) -> DataFrame:
    return senses.select(F.split_part(F.col("head"), F.lit(mark), F.lit(1)).alias("head")).distinct()


def split_heads(vectors: DataFrame, senses: DataFrame, mark: str = "ZZZ") -> DataFrame:
    """The vectors whose heads senses split (the part before mark)."""
    return vectors.join(_split_names(senses, mark), "head", "left_semi").select("head", "feature", "cnt")


def overwrite_senses(vectors: DataFrame, senses: DataFrame, mark: str = "ZZZ") -> DataFrame:
    """vectors without the heads that senses split (the part before mark), and the senses."""
    return vectors.join(_split_names(senses, mark), "head", "left_anti").select("head", "feature", "cnt").unionByName(senses.select("head", "feature", "cnt"))


#: Heads whose sets are bits of a number.
MASKED_HEADS = 62


def contextual_similarity(
    docs: DataFrame, heads: DataFrame, stats: DataFrame, size: int = 50, min_doc_len: int = 1000, min_df: int = 5, min_target_df: int = 1000, stop: tuple[str, ...] = ()
) -> DataFrame:
    """(head, target, jt, jb, wt, wb, jacc, wjacc): how much of a target's windows each head's features cover.

    docs (text); heads are vectors (head, feature, ...); stats (word, df). For each occurrence of a target and each
    head: the distinct features B of the window [i - size, i + size) without the word itself, those shared with the
    head, and both weighted by 1 / df. All four are sums over the features near a target, so that tasks add them up,
    by head where heads are few, else by the set of heads that hold a feature; pairs of target and feature are never
    listed outside a task. Heads meet targets in a cross product only at the end, as the result has a row for each pair.
    """
    from .windows import near_sums

    targets = stage(stats.where((F.col("df") >= min_target_df) & ~F.col("word").isin(list(stop))).select("word").distinct(), "targets")
    known = stats.where(F.col("df") >= min_df).groupBy("word").agg(F.count(F.lit(1)).alias("times"), F.sum(F.lit(1.0) / F.col("df")).alias("weight"))
    names = [r.head for r in heads.where("head is not null").select("head").distinct().limit(MASKED_HEADS + 1).collect()]
    held = heads.where("head is not null and feature is not null").select("head", F.col("feature").alias("word"))
    if len(names) <= MASKED_HEADS:
        numbers = heads.sparkSession.createDataFrame(list(enumerate(sorted(names))), "label long, head string")
        masks = held.join(F.broadcast(numbers), "head").groupBy("word").agg(F.expr("bit_or(shiftleft(1L, int(label)))").alias("label"))
        features = stage(known.join(masks, "word", "left").withColumn("label", F.coalesce("label", F.lit(0))), "features")
        sets = features.select("label").distinct().limit(len(names) + 1)
        split = len(names) if sets.count() > len(names) else None
        columns = numbers if split is not None else stage(sets.crossJoin(numbers.withColumnRenamed("label", "bit")).where("label & shiftleft(1L, int(bit)) != 0").select("label", "head"), "sets")
    else:
        # features that the same heads hold are added up before they meet these
        holders = held.distinct().join(known.select("word"), "word").groupBy("word").agg(F.array_sort(F.collect_list("head")).alias("heads"))
        holders = stage(holders, "holders")
        sets = stage(holders.select("heads").distinct().withColumn("label", F.monotonically_increasing_id()), "sets")
        features = stage(known.join(holders.join(sets, "heads").select("word", "label"), "word", "left").withColumn("label", F.coalesce("label", F.lit(-1))), "features")
        split, columns = None, sets.select("label", F.explode("heads").alias("head"))
    offsets = [*range(-size, 0), *range(1, size)]
    sums = stage(near_sums(docs, targets, features, offsets, split, min_doc_len).withColumnRenamed("word", "target"), "sums")
    shared = sums.join(columns, "label")
    if split is None:
        seen = sums.groupBy("target").agg(F.sum("n").alias("jb"), F.sum("w").alias("wb"))
        shared = shared.groupBy("head", "target").agg(F.sum("n").alias("jt"), F.sum("w").alias("wt"))
    else:
        seen = sums.where(F.col("label") == split).select("target", F.col("n").alias("jb"), F.col("w").alias("wb"))
        shared = shared.select("head", "target", F.col("n").alias("jt"), F.col("w").alias("wt"))
    pairs = seen.crossJoin(heads.select("head").distinct()).where("head != target").join(shared, ["head", "target"], "left")
    jt, jb = F.coalesce("jt", F.lit(0)).cast("long"), F.coalesce("jb", F.lit(0)).cast("long")
    wt, wb = F.coalesce("wt", F.lit(0.0)), F.coalesce("wb", F.lit(0.0))
    return pairs.select(
        "head", "target", jt.alias("jt"), jb.alias("jb"), wt.alias("wt"), wb.alias("wb"),
        F.try_divide(jt, jb).alias("jacc"), F.try_divide(wt, wb).alias("wjacc"),
    )
