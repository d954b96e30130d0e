"""Numbers of rows in an order over all of them, and chunks of a table's rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import stage

#: Bits of a row's number within its partition in monotonically_increasing_id (a fixed value of Spark).
_ROW_BITS = 33


def numbered(df: DataFrame, *order, name: str = "n") -> DataFrame:
    """df with a column name: each row's number from 0 in the order given (columns, or expressions like F.desc("x")).

    Rows are dealt out by ranges of the order and sorted within their partition, each with its number there; the
    numbers of rows of the partitions before are added. One shuffle, no task that holds all rows. Rows that are equal
    in the order follow a hash of all their columns, so that a range of ties is split too; those that are equal in
    that as well are told apart arbitrarily. name replaces a column of that name. Map columns don't count in the hash.
    """
    rest = df.drop(name)
    tie = F.xxhash64(*[F.col("`" + c.replace("`", "``") + "`") for c, t in rest.dtypes if "map<" not in t and "variant" not in t], F.lit(0))
    at, part, before = "_row_at", "_row_part", "_rows_before"
    dealt = rest.repartitionByRange(*order, tie).sortWithinPartitions(*order, tie)
    kept = stage(dealt.withColumn(at, F.monotonically_increasing_id()), "numbered")
    placed = kept.withColumn(part, F.shiftright(at, _ROW_BITS))
    sizes = sorted(placed.groupBy(part).agg(F.count(F.lit(1)).alias("c")).collect())  # a row for each task of the shuffle
    sums, total = [], 0
    for number, count in sizes:
        sums.append((number, total))
        total += count
    offsets = df.sparkSession.createDataFrame(sums, f"{part} long, {before} long")
    joined = placed.join(F.broadcast(offsets), part)
    return joined.withColumn(name, F.col(before) + F.col(at).bitwiseAND((1 << _ROW_BITS) - 1)).drop(at, part, before)


def row_chunks(df: DataFrame, size: int, *order, chunk: str = "chunk", place: str = "place") -> DataFrame:
    """df with the number of each row's chunk of size rows in the order given, and its place there, both from 0; the last chunk may be shorter."""
    rows = numbered(df, *order, name=place)
    return rows.withColumn(chunk, F.floor(F.col(place) / size)).withColumn(place, F.col(place) % size)
