"""Points joined with ranges that hold them, nested and overlapping ones too, by equal keys alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def range_join(points: DataFrame, ranges: DataFrame, value: str, low: str, high: str) -> DataFrame:
    """points with each row of ranges whose bounds low and high, both included, hold the whole number value.

    A range of a length up to 2**n belongs to level n, where bins are 2**n wide: it lies in two of them at most. A point
    looks in its one bin of each level that occurs, of which there are 64 at most, so that both sides meet by (level,
    bin). Points of one value are many rows of one key, which adaptive execution splits. Null values and bounds, and
    ranges that end before they begin, match nothing. The two sides' columns must have different names.
    """
    level, bin_, levels = "_range_level", "_range_bin", "_range_levels"
    kept = ranges.where(F.col(low) <= F.col(high))
    # bounds are far apart where their difference needs more bits than a long has: the widest level then
    width = F.col(high).cast("decimal(38,0)") - F.col(low).cast("decimal(38,0)")
    kept = kept.withColumn(level, F.greatest(F.ceil(F.log2(width.cast("double") + 1)), F.lit(0)).cast("int"))
    of = lambda x, n: F.floor(x.cast("decimal(38,0)") / F.pow(F.lit(2.0), n).cast("decimal(38,0)")).cast("long")
    first, last = of(F.col(low), F.col(level)), of(F.col(high), F.col(level))
    spread = kept.withColumn(bin_, F.explode(F.array_distinct(F.array(first, last))))
    found = sorted(r[0] for r in kept.select(level).distinct().collect())  # 64 at most
    if not found:
        return points.join(ranges, F.lit(False))
    looking = points.where(F.col(value).isNotNull()).withColumn(levels, F.explode(F.array(*[F.lit(n) for n in found])))
    looking = looking.withColumn(bin_, of(F.col(value), F.col(levels))).withColumnRenamed(levels, level)
    joined = looking.join(spread, [level, bin_]).where(F.col(value).between(F.col(low), F.col(high)))
    return joined.drop(level, bin_)


_LEVEL, _BIN = "_range_level", "_range_bin"


def _covered(ranges: DataFrame, low: str, high: str) -> tuple[DataFrame, list[int]]:
    """ranges with a row for each bin (level, number) of those that make up the range exactly, two of a level at most; and the levels.

    A bin of level n is 2**n wide; a whole number lies in bin value >> n. Inwards from both ends, an end that is no
    pair with what is next to it is a bin of this level; what is left is a range of bins of the next.
    """
    step = """CASE WHEN s.a > s.b THEN s
        WHEN s.a = s.b THEN named_struct('a', 1L, 'b', 0L, 'bins', array_append(s.bins, named_struct('n', n, 'k', s.a)))
        ELSE named_struct('a', shiftright(s.a + (s.a & 1L), 1), 'b', shiftright(s.b - 1L + (s.b & 1L), 1), 'bins', concat(s.bins,
            IF((s.a & 1L) = 1L, array(named_struct('n', n, 'k', s.a)), array()), IF((s.b & 1L) = 0L, array(named_struct('n', n, 'k', s.b)), array()))) END"""
    begin = f"named_struct('a', cast(`{low}` AS long), 'b', cast(`{high}` AS long), 'bins', cast(array() AS array<struct<n:int,k:bigint>>))"
    bins = F.expr(f"aggregate(sequence(0, 63), {begin}, (s, n) -> {step}, s -> s.bins)")
    spread = ranges.where(F.col(low) <= F.col(high)).withColumn("_bin", F.explode(bins))
    spread = spread.select(*ranges.columns, F.col("_bin.n").alias(_LEVEL), F.col("_bin.k").alias(_BIN))
    return spread, sorted(r[0] for r in spread.select(_LEVEL).distinct().collect())  # 64 at most


def _looking(points: DataFrame, value: str, levels: list[int]) -> DataFrame:
    """points with a row for the bin of each level that they lie in."""
    rows = points.where(F.col(value).isNotNull()).withColumn(_LEVEL, F.explode(F.array(*[F.lit(n) for n in levels]).cast("array<int>")))
    return rows.withColumn(_BIN, F.expr(f"shiftright(cast(`{value}` AS long), {_LEVEL})"))


def aggregate_over(points: DataFrame, ranges: DataFrame, key: str, value: str, low: str, high: str, made: dict[str, Column], merged: dict[str, Column]) -> DataFrame:
    """(key, names): aggregates of the points in each range, bounds included; ranges without points have no row.

    made: aggregates over points by name; merged: for each name the aggregate that puts several of these together, as
    F.sum(name) does with counts. Points come together by value, then by bin, and a range takes the bins that make it
    up: no pair of point and range is ever listed. Null values and bounds, and ranges that end before they begin, match
    nothing.
    """
    spread, levels = _covered(ranges.select(key, low, high), low, high)
    sums = [merged[name].alias(name) for name in made]
    values = points.groupBy(value).agg(*[c.alias(name) for name, c in made.items()])
    bins = _looking(values, value, levels).groupBy(_LEVEL, _BIN).agg(*sums)
    return spread.join(bins, [_LEVEL, _BIN]).groupBy(key).agg(*sums)


def innermost(points: DataFrame, ranges: DataFrame, value: str, low: str, high: str) -> DataFrame:
    """(value, columns of ranges): for each distinct value in points the shortest range that holds it, of equal ones the last to begin, then by the other columns; values in none have no row.

    Each bin keeps the shortest of the ranges that it is a part of, and a value takes the best of its bins, one of each level.
    """
    columns = ranges.columns
    order = F.struct((F.col(high) - F.col(low)).alias("w"), (-F.col(low)).alias("l"), *[c for c in columns if c not in (low, high)])
    spread, levels = _covered(ranges, low, high)
    bins = spread.groupBy(_LEVEL, _BIN).agg(F.min_by(F.struct(*columns), order).alias("_best"), F.min(order).alias("_order"))
    found = _looking(points.select(value).distinct(), value, levels).join(bins, [_LEVEL, _BIN])
    return found.groupBy(value).agg(F.min_by("_best", "_order").alias("_best")).select(value, "_best.*")


def character_blocks(docs: DataFrame, blocks: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, block, n): how many characters of each text lie in each block of code points (block, first, last), nested blocks in all that hold them."""
    chars = docs.select(key, F.explode(F.split(F.coalesce(F.col(text), F.lit("")), "")).alias("c")).where("c != ''")
    counted = chars.groupBy(key, "c").agg(F.count(F.lit(1)).alias("_n"))
    # a character's code point from its four bytes in UTF-32
    code = F.conv(F.hex(F.encode("c", "UTF-32")), 16, 10).cast("long")
    points = counted.select("c").distinct().select("c", code.alias("_code"))
    held = range_join(points, blocks, "_code", "first", "last").select("c", "block")
    return counted.join(held, "c").groupBy(key, "block").agg(F.sum("_n").alias("n"))
