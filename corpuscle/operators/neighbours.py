"""The k nearest heads under weighted Jaccard without the product of all heads: pairs that cannot get that far are never made."""

from __future__ import annotations

from collections.abc import Callable
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.staging import stage
from .numbering import numbered

#: Rarest features of a head, and most heads to a feature, by which the first neighbours are sought; they only give a bound.
RARE, RARE_HEADS = 8, 1000
#: First neighbours scored for a head, as a multiple of k.
TRIES = 2
#: Heads that a feature's rows meet in one task: a feature of more is dealt to as many parts as it takes.
PART_HEADS = 10_000
#: What floating-point sums in another order may differ by, as a share.
SLACK = 1e-9
#: Other heads that a head meets through one of its features, on average, up to which all pairs that share a feature are scored: bounds cost more there than they save.
MET = 200
#: Pairs that meet in a task, which also bounds the entries of lists it holds; pairs scored at once, unless one head has more; heads of a task.
TASK_PAIRS, BATCH_PAIRS, TASK_HEADS = 1 << 26, 1 << 21, 1 << 22
#: Rounded scores from which a head's order is left to Spark (a fixed value: 40 bits of a sort key hold a score).
_WIDE = 1 << 38


def _sums(weights: DataFrame) -> DataFrame:
    return weights.groupBy("head").agg(F.sum("weight").alias("total"), F.sum(F.greatest(-F.col("weight"), F.lit(0.0))).alias("negative"))


def scores_of(tops: DataFrame, sums: DataFrame) -> DataFrame:
    """(head, target, score) of tops (head, target, top): the sum of minima over the sum of maxima, both sums less the minima; null where that is 0."""
    totals = sums.select("head", "total")
    joined = tops.join(totals, "head").join(totals.withColumnsRenamed({"head": "target", "total": "total2"}), "target")
    return joined.select("head", "target", F.try_divide(F.col("top"), F.col("total") + F.col("total2") - F.col("top")).alias("score"))


def shared_tops(left: DataFrame, right: DataFrame) -> DataFrame:
    """(head, target, top): the sum of minima over shared features, for all pairs of left's and right's heads that share one.

    Both are (head, feature, weight). A feature of many heads on the right is dealt to several parts, each of which
    meets all of the left's rows with it.
    """
    parts = right.groupBy("feature").agg(F.ceil(F.count(F.lit(1)) / PART_HEADS).cast("int").alias("parts"))
    dealt = right.join(parts, "feature").select(F.col("head").alias("target"), "feature", F.col("weight").alias("b"), F.pmod(F.xxhash64("head"), F.col("parts")).cast("int").alias("part"))
    spread = left.join(parts, "feature").select("head", "feature", F.col("weight").alias("a"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    both = spread.join(dealt, ["feature", "part"]).where("head != target")
    return both.groupBy("head", "target").agg(F.sum(F.least("a", "b")).alias("top"))


def exact_tops(pairs: DataFrame, weights: DataFrame) -> DataFrame:
    """(head, target, top) of the pairs alone, over all features that both have."""
    mine = weights.withColumnRenamed("weight", "a")
    theirs = weights.select(F.col("head").alias("target"), "feature", F.col("weight").alias("b"))
    return pairs.join(mine, "head").join(theirs, ["target", "feature"]).groupBy("head", "target").agg(F.sum(F.least("a", "b")).alias("top"))


def _positive_postings(weights: DataFrame) -> DataFrame:
    """(head, feature, weight, heads, bound): weights over 0 of features that two heads at least have so.

    bound is the most that the feature can add to the minima of the head with any other: its own weight, or the
    feature's largest among the others.
    """
    positive = weights.where("weight > 0")
    first = positive.groupBy("feature").agg(F.max("weight").alias("most"), F.count(F.lit(1)).alias("heads")).where("heads > 1")
    met = stage(positive.join(first, "feature"), "positive")
    is_most = F.col("weight") == F.col("most")
    second = met.groupBy("feature").agg(F.count_if(is_most).alias("n_most"), F.coalesce(F.max(F.when(~is_most, F.col("weight"))), F.lit(0.0)).alias("next"))
    others = F.when(is_most & (F.col("n_most") == 1), F.col("next")).otherwise(F.col("most"))
    return met.join(second, "feature").select("head", "feature", "weight", "heads", F.least("weight", others).alias("bound"))


def _kth(scores: DataFrame, k: int, digits: int) -> DataFrame:
    """(head, least): the k-th best positive score, for heads that have as many."""
    rounded = scores.withColumn("score", F.round("score", digits)).where("score > 0")
    order = Window.partitionBy("head").orderBy(F.desc("score"), F.desc("target"))
    return rounded.withColumn("n", F.row_number().over(order)).where(F.col("n") == k).select("head", F.col("score").alias("least"))


def _first_bounds(postings: DataFrame, weights: DataFrame, sums: DataFrame, k: int, digits: int) -> DataFrame:
    """(head, least): a score that k targets reach, found among those that share a head's rarest features; heads without k such have no row."""
    by_rarity = Window.partitionBy("head").orderBy("heads", "feature")
    some = postings.where(F.col("heads") <= RARE_HEADS)
    rare = some.withColumn("n", F.row_number().over(by_rarity)).where(F.col("n") <= RARE)
    met = shared_tops(rare.select("head", "feature", "weight"), some.select("head", "feature", "weight"))
    best = Window.partitionBy("head").orderBy(F.desc("top"), F.desc("target"))
    tried = met.withColumn("n", F.row_number().over(best)).where(F.col("n") <= TRIES * k).select("head", "target")
    return _kth(scores_of(exact_tops(stage(tried, "tried"), weights), sums), k, digits)


def _likely(postings: DataFrame, sums: DataFrame, bounds: DataFrame, digits: int) -> DataFrame:
    """(head, target): every pair of heads with sums of 0 or more whose rounded score can reach the head's bound, and some others.

    A score s > 0 needs minima of at least s / (1 + s) times both sums. A target's sum is 0 at least, and no less than
    the minima without its negative weights, which gives a bound of the head alone: of its features, most frequent
    first, those whose bounds together stay under it are left out, as sharing them alone is not enough. Pairs found by
    the others are kept if what they share and all that was left out can reach what both sums need.
    """
    most_negative = sums.agg(F.coalesce(F.max("negative"), F.lit(0.0))).first()[0]
    score = F.greatest(F.coalesce("least", F.lit(0.0)) - F.lit(10.0**-digits), F.lit(0.0))
    of_both = F.col("s") / (1 + F.col("s"))
    heads = sums.where("total >= 0").join(bounds, "head", "left").select("head", "total", score.alias("s"))
    heads = heads.withColumn("need", F.greatest(of_both * F.col("total"), F.col("s") * (F.col("total") - F.lit(most_negative))) * (1 - SLACK))
    frequent = Window.partitionBy("head").orderBy(F.desc("heads"), F.desc("feature")).rowsBetween(Window.unboundedPreceding, 0)
    summed = postings.join(heads, "head").withColumn("reach", F.sum("bound").over(frequent))
    summed = stage(summed.select("head", "feature", "weight", "total", "s", "bound", (F.col("reach") < F.col("need")).alias("out")), "prefixes")
    rest = summed.where("out").groupBy("head").agg(F.sum("bound").alias("rest"))
    known = heads.join(rest, "head", "left").select("head", F.col("total"), "s", F.coalesce("rest", F.lit(0.0)).alias("rest"))
    met = shared_tops(summed.where("not out").select("head", "feature", "weight"), summed.select("head", "feature", "weight"))
    joined = met.join(known, "head").join(sums.where("total >= 0").select(F.col("head").alias("target"), F.col("total").alias("total2")), "target")
    return joined.where((F.col("top") + F.col("rest")) * (1 + SLACK) >= of_both * (F.col("total") + F.col("total2")) * (1 - SLACK)).select("head", "target")


def _with_zeros(scores: DataFrame, sums: DataFrame, short: DataFrame, k: int, digits: int) -> DataFrame:
    """scores of the short heads that don't round to 0, and for each head the last k other targets by name that do.

    Targets have numbers from the last name on. In a head's sorted numbers of targets with other scores, and its own,
    the gaps are those that score 0; no more than k numbers of the first gaps are made into rows.
    """
    names = stage(numbered(sums.select("head"), F.desc("head"), name="at"), "names")
    other = stage(scores.withColumn("score", F.round("score", digits)).where("score is null or score != 0"), "other_scores")
    targets = names.withColumnRenamed("head", "target")
    ends = short.select("head", F.lit(names.count()).alias("at"))
    taken = other.join(targets, "target").select("head", "at").unionByName(short.join(names, "head").select("head", "at")).unionByName(ends)
    order = Window.partitionBy("head").orderBy("at")
    gaps = taken.select("head", "at", (F.lag("at", 1, -1).over(order) + 1).alias("first"), (F.row_number().over(order) - 1).alias("n"))
    missing = F.col("first") - F.col("n")  # numbers missing before this gap
    gaps = gaps.where((F.col("first") < F.col("at")) & (missing < k))
    filled = gaps.select("head", F.explode(F.sequence(F.col("first"), F.least(F.col("at") - 1, F.col("first") + k - 1 - missing))).alias("at"))
    return other.unionByName(filled.join(targets, "at").select("head", "target", F.lit(0.0).alias("score")))


def top_weighted_jaccard(weights: DataFrame, k: int = 50, digits: int = 6) -> DataFrame:
    """(head, target, score): the k best targets of each head by rounded weighted Jaccard, then target, both descending.

    weights (head, feature, weight), one row for a head and feature; null weights don't count. The result is that of scoring
    all pairs: pairs that share no feature score 0, negative scores come after those, and pairs without a score
    (maxima that sum to 0) last. Heads whose weights sum to less than 0 break the bounds: they are scored with all that
    share a feature. So are heads with fewer than k positive scores, as any of their targets may come next.
    """
    from .similarity import top_neighbours

    weights = stage(weights.select("head", "feature", F.col("weight").cast("double").alias("weight")).where("head is not null and weight is not null"), "weights")
    sums = stage(_sums(weights), "sums")
    postings = stage(_positive_postings(weights), "postings")
    bounds = stage(_first_bounds(postings, weights, sums, k, digits), "bounds")
    pairs = stage(_likely(postings, sums, bounds, digits), "pairs")
    found = scores_of(exact_tops(pairs, weights), sums)
    odd = weights.join(sums.where("total < 0").select("head"), "head", "left_semi")
    one_way = stage(scores_of(shared_tops(odd, weights), sums), "odd_pairs")
    other_way = one_way.select(F.col("target").alias("head"), F.col("head").alias("target"), "score")
    found = found.unionByName(one_way).unionByName(other_way).groupBy("head", "target").agg(F.max("score").alias("score"))
    found = stage(found, "found")
    rounded = F.round("score", digits)
    enough = found.where(rounded > 0).groupBy("head").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select("head")
    short = stage(sums.select("head").join(enough, "head", "left_anti"), "short")
    every = scores_of(shared_tops(weights.join(short, "head", "left_semi"), weights), sums)
    best = found.join(enough, "head", "left_semi").unionByName(_with_zeros(every, sums, short, k, digits))
    return top_neighbours(best, k, digits)


def _units(scores: np.ndarray, digits: int) -> np.ndarray:
    """Scores rounded to digits as Spark's round does (half away from zero, of the shortest decimal), in units of the last digit; 0 for NaN."""
    scaled = np.abs(np.nan_to_num(scores, posinf=1e12, neginf=-1e12)) * 10.0**digits
    whole = np.floor(np.minimum(scaled, 4.0 * _WIDE))
    part = scaled - whole
    units = (whole + (part >= 0.5)).astype(np.int64)
    for k in np.flatnonzero(np.abs(part - 0.5) < 1e-5):
        units[k] = int(Decimal(repr(abs(float(scores[k])))).scaleb(digits).quantize(Decimal(1), ROUND_HALF_UP))
    return np.where(scores < 0, -units, units)


class _Block:
    """The lists that the heads of one task are in, and what is known of all heads."""

    def __init__(self, batches, weigh: Callable, heads: int) -> None:
        self.weigh, self.first, self.last = weigh, 0, 0
        self.types, self.totals = np.zeros(heads, np.int32), np.zeros(heads)
        ids, counts, sizes, masses = ([np.zeros(0, np.int32)], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [np.zeros(0)])
        for batch in batches:
            first = batch.column("first").to_numpy(zero_copy_only=False)
            for row in np.flatnonzero(first >= 0):
                at = slice(int(first[row]), int(first[row]) + len(batch.column("counts")[row].values))
                self.types[at], self.totals[at] = batch.column("counts")[row].values, batch.column("totals")[row].values
            lists = batch.filter(pa.array(first < 0))
            if lists.num_rows:
                self.block = lists.column("block")[0].as_py()
                ids.append(lists.column("ids").flatten().to_numpy())
                counts.append(lists.column("counts").flatten().to_numpy())
                sizes.append(np.diff(lists.column("ids").offsets.to_numpy()).astype(np.int64))
                masses.append(lists.column("mass").to_numpy())
        self.ids, self.counts, self.sizes, self.masses = map(np.concatenate, (ids, counts, sizes, masses))

    def own(self, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """The entries of the heads from first to last, by head, and the list that each is in."""
        at = np.flatnonzero((self.ids >= first) & (self.ids < last))
        at = at[np.argsort(self.ids[at], kind="stable")]
        return at, np.searchsorted(np.cumsum(self.sizes), at, side="right")

    def scores(self, at: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(head, target, score) of all pairs that share a feature, by head, then target from the last on; NaN where the maxima sum to 0."""
        size = self.sizes[lists]
        before = np.cumsum(size) - size
        met = np.repeat((np.cumsum(self.sizes) - self.sizes)[lists] - before, size) + np.arange(size.sum())
        head, target = np.repeat(self.ids[at], size).astype(np.int64), self.ids[met].astype(np.int64)
        mine = np.repeat(self.weigh(self.counts[at], self.types[self.ids[at]], self.masses[lists]), size)
        least = np.minimum(mine, self.weigh(self.counts[met], self.types[target], np.repeat(self.masses[lists], size)))
        n = len(self.types)
        key = head * n + (n - 1 - target)
        order = np.argsort(key, kind="stable")
        order = order[(head != target)[order]]
        key = key[order]
        starts = np.flatnonzero(np.diff(key, prepend=-1))
        top = np.add.reduceat(least[order], starts) if len(starts) else np.zeros(0)
        head, target = key[starts] // n, n - 1 - key[starts] % n
        most = self.totals[head] + self.totals[target] - top
        return head, target, np.divide(top, most, out=np.full(len(top), np.nan), where=most != 0)


def _best(head: np.ndarray, scores: np.ndarray, k: int, digits: int) -> np.ndarray:
    """Rows of the k best rounded scores of each head, of equal ones the first; of a head with fewer than k over 0, all its rows."""
    units = _units(scores, digits)
    of, back = np.unique(head, return_inverse=True)
    wide = np.bincount(back, weights=np.abs(units) >= _WIDE, minlength=len(of)) > 0
    every = (np.bincount(back, weights=units > 0, minlength=len(of)) < k) | wide
    some = np.flatnonzero(~every[back] & (units > 0))
    some = some[np.argsort((back[some].astype(np.int64) << 40) - units[some], kind="stable")]
    starts = np.flatnonzero(np.diff(back[some], prepend=-1))
    place = np.arange(len(some)) - np.repeat(starts, np.diff(starts, append=len(some)))
    return np.concatenate([np.flatnonzero(every[back]), some[place < k]])


def _score_block(weigh: Callable, heads: int, size: int, k: int, digits: int):
    """One task's heads, number block * size on, against all that they share a feature with."""

    def run(batches):
        block = _Block(batches, weigh, heads)
        if not len(block.ids):
            return
        at, lists = block.own(block.block * size, (block.block + 1) * size)
        ends = np.cumsum(block.sizes[lists])
        last = np.flatnonzero(np.diff(block.ids[at], append=-1))  # the last row of each head
        begin = 0
        while begin < len(at):
            reach = (ends[begin - 1] if begin else 0) + BATCH_PAIRS
            fits = last[(last >= begin) & (ends[last] <= reach)]
            end = int(fits[-1] if len(fits) else last[last >= begin][0]) + 1
            head, target, scores = block.scores(at[begin:end], lists[begin:end])
            rows = _best(head, scores, k, digits)
            found = pa.array(scores[rows], mask=np.isnan(scores[rows]))
            yield pa.RecordBatch.from_arrays([pa.array(head[rows]), pa.array(target[rows]), found], ["head_at", "target_at", "score"])
            begin = end

    return run


def _sum_weights(weigh: Callable):
    def run(batches):
        for batch in batches:
            sizes = np.diff(batch.column("ids").offsets.to_numpy())
            ids, counts, types = (batch.column(x).flatten().to_numpy() for x in ("ids", "counts", "types"))
            heads, back = np.unique(ids, return_inverse=True)
            weights = weigh(counts, types, np.repeat(batch.column("mass").to_numpy(), sizes))
            yield pa.RecordBatch.from_arrays([pa.array(heads), pa.array(np.bincount(back, weights=weights, minlength=len(heads)))], ["at", "total"])

    return run


def top_of_short_lists(vectors: DataFrame, weigh: Callable[[float], Callable], k: int = 50, digits: int = 6) -> DataFrame | None:
    """What top_weighted_jaccard gives, where features have so few heads that all pairs that share one can be scored; None where they have more.

    vectors (head, feature, cnt), read several times; weigh(sum of all counts) gives a function of arrays: count, a head's
    number of features, a feature's sum of counts -> weight. Heads have numbers in the order of their names. A feature's
    list of heads goes to each task that has some of these; a task has a run of numbers, so that heads with numbers near
    to each other that share much cost little. It adds up its heads' pairs and keeps their best: no pair is shuffled.
    """
    spark = vectors.sparkSession
    lengths = vectors.where("head is not null and feature is not null and cnt is not null").groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.max("cnt").alias("most"))
    rows, pairs, most = lengths.agg(F.sum("n"), F.sum(F.col("n") * F.col("n")), F.max("most")).first()
    if not rows or pairs > MET * rows or most >= 1 << 31:
        return None
    types = vectors.where("head is not null").groupBy("head").agg(F.count(F.lit(1)).cast("int").alias("types"), F.count_if(F.expr("feature is not null and cnt is not null")).alias("weighted"))
    names = stage(numbered(types.where("weighted > 0").select("head", "types"), "head", name="at"), "names")
    heads = names.count()
    if heads >= 1 << 31:
        return None
    weight = weigh(float(vectors.agg(F.sum("cnt").cast("double")).first()[0]))
    known = vectors.where("feature is not null").join(names, "head", "left")  # rows without a head count in a feature's mass
    entry = F.when(F.expr("at is not null and cnt is not null"), F.struct(F.col("at").cast("int").alias("at"), F.col("cnt").cast("int").alias("cnt"), "types"))
    lists = known.groupBy("feature").agg(F.sort_array(F.collect_list(entry)).alias("l"), F.sum("cnt").cast("double").alias("mass"))
    lists = stage(lists.where(F.size("l") > 0).select(F.col("l.at").alias("ids"), F.col("l.cnt").alias("counts"), F.col("l.types").alias("types"), "mass"), "lists")
    totals = lists.mapInArrow(_sum_weights(weight), "at int, total double").groupBy("at").agg(F.sum("total").alias("total"))
    blocks = max(-(-pairs // TASK_PAIRS), -(-heads // TASK_HEADS), min(spark.sparkContext.defaultParallelism, heads))
    size = -(-heads // blocks)
    blocks = -(-heads // size)
    known = names.join(totals, "at", "left").select("at", F.struct("at", "types", F.coalesce("total", F.lit(0.0)).alias("total")).alias("x"))
    known = known.groupBy(F.floor(F.col("at") / 65536).alias("part")).agg(F.sort_array(F.collect_list("x")).alias("l"))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    known = known.select(every, (F.col("part") * 65536).alias("first"), F.lit(None).cast("array<int>").alias("ids"), F.col("l.types").alias("counts"), F.col("l.total").alias("totals"), F.lit(0.0).alias("mass"))
    holding = F.explode(F.array_distinct(F.transform("ids", lambda x: F.floor(x / size).cast("int")))).alias("block")
    dealt = lists.select(holding, F.lit(-1).cast("long").alias("first"), "ids", "counts", F.lit(None).cast("array<double>").alias("totals"), "mass")
    dealt = dealt.unionByName(known).repartitionById(blocks, F.col("block"))
    found = stage(dealt.mapInArrow(_score_block(weight, heads, size, k, digits), "head_at long, target_at long, score double"), "found")
    enough = found.where(F.round("score", digits) > 0).groupBy("head_at").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select("head_at")
    short = stage(names.join(enough, names["at"] == F.col("head_at"), "left_anti").select("head"), "short")
    own, other = names.select(F.col("at").alias("head_at"), "head"), names.select(F.col("at").alias("target_at"), F.col("head").alias("target"))
    named = found.join(own, "head_at").join(other, "target_at").select("head", "target", "score")
    if short.isEmpty():
        return named
    return named.join(short, "head", "left_anti").unionByName(_with_zeros(named.join(short, "head", "left_semi"), names, short, k, digits))
