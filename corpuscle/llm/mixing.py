"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, quoted, stage

SEED = 17
#: Weights follow a source's size to this power unless they are given.
TEMPERATURE = 0.7
#: Tables of rates of up to so many sources go to every task; larger ones are joined by a shuffle.
LOCAL_SOURCES = 10_000


def poisson_cdf(rate: float) -> list[float]:
    """P(X <= 0), P(X <= 1), ... until what is left is below double precision."""
    out, total, term, k = [], 0.0, 1.0, 0
    while rate > 0 and (k <= rate + 1 or term > 1e-17):
        term = math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
        total += term
        out.append(min(total, 1.0))
        k += 1
    return out or [1.0]


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0, temperature: float = TEMPERATURE) -> DataFrame:
    """(source, chars, rate): the mean number of times that a source's documents are to occur.

    The mix has epochs times the corpus's characters; a source's share of them is its weight over the sum of
    weights. Without weights a source's weight is its size to the power temperature. A source that weights lacks
    has weight 0. A null source is a source of its own. Sources without any character keep rate 1.
    """
    sizes = docs.groupBy("source").agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"))
    if weights is None:
        weight = F.when(F.col("chars") > 0, F.pow(F.col("chars").cast("double"), F.lit(temperature))).otherwise(0.0)
        weighed = sizes.withColumn("weight", weight)
    else:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "source string, weight double")
        weighed = sizes.join(given.withColumnRenamed("source", "named"), F.col("source").eqNullSafe(F.col("named")), "left")
        weighed = weighed.withColumn("weight", F.coalesce("weight", F.lit(0.0))).drop("named")
    weighed = stage(weighed, "source_sizes")
    total, weight_sum = weighed.agg(F.coalesce(F.sum("chars"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("chars") > 0, F.col("weight"))), F.lit(0.0))).first()
    share = F.col("weight") / F.lit(weight_sum) * F.lit(float(total) * epochs) / F.col("chars")
    return weighed.select("source", "chars", F.when(F.col("chars") > 0, share if weight_sum else F.lit(0.0)).otherwise(1.0).alias("rate"))


def _with_cdf(batches):
    for rates in batches:
        yield pd.DataFrame({"_source": rates["source"], "_cdf": [poisson_cdf(x) for x in rates["rate"]]})


def mix(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    epochs: float = 1.0,
    temperature: float = TEMPERATURE,
    seed: int = SEED,
    keep_copy: bool = False,
    local_sources: int = LOCAL_SOURCES,
) -> DataFrame:
    """docs (doc_id, text, source, ...) with each row replicated to its source's rate, in an order shuffled over all.

    A row's number of copies inverts the Poisson distribution of its source's rate at a number in [0, 1) that
    md5 draws from (seed, doc_id): the same in any run, on any cluster. Rows that repeat a doc_id get as many copies
    each. Rows are dealt out by a hash of (seed, doc_id, copy) and sorted by it: a shuffle of the whole corpus
    for which one pass suffices. keep_copy adds columns copy (from 0) and shuffle_key.
    """
    named, cdf, u, n_copies, copy, key = fresh(docs, "_source", "_cdf", "_u", "_n", "_copy", "_key")
    rates = stage(source_rates(docs, weights, epochs, temperature).mapInPandas(_with_cdf, "_source string, _cdf array<double>"), "rates")
    few = rates.count() <= local_sources
    rates = rates.select(F.col("_source").alias(named), F.col("_cdf").alias(cdf))
    id_text = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), id_text).cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))
    joined = docs.join(F.broadcast(rates) if few else rates, F.col("source").eqNullSafe(F.col(named)))
    counted = joined.withColumn(u, drawn).withColumn(n_copies, F.expr(f"size(filter({cdf}, c -> c <= {u}))")).where(F.col(n_copies) > 0)
    copies = counted.withColumn(copy, F.explode(F.sequence(F.lit(0), F.col(n_copies) - 1))).select(*quoted(docs.columns), copy)
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), id_text, F.col(copy).cast("string"), F.lit("order")).cast("binary"))
    shuffled = copies.withColumn(key, order)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shuffled = shuffled.repartition(n, key).sortWithinPartitions(key)
    if keep_copy:
        return shuffled.select(*quoted(docs.columns), F.col(copy).alias("copy"), F.col(key).alias("shuffle_key"))
    return shuffled.select(*quoted(docs.columns))
