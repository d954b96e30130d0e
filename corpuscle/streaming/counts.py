"""Corpus statistics over folders that grow: file streams, checkpoints, late data and expiry."""

from __future__ import annotations

import contextlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import text as X


def stream_lines(spark: SparkSession, path: str, files_per_batch: int = 5) -> DataFrame:
    """(text, file, ts): a document for each line of the files that appear under path, oldest first."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).option("latestFirst", "false").text(path)
    return lines.select(F.col("value").alias("text"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_modification_time").alias("ts"))


def stream_parquet(spark: SparkSession, path: str, schema, files_per_batch: int = 5) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def term_counts(docs: DataFrame, min_doc_len: int = 100) -> DataFrame:
    """(word, tf, df) so far, for update or complete mode: df needs no distinct, as a document marks a word's first occurrence."""
    words = docs.select(F.array_sort(X.tokens(F.col("text"))).alias("s")).where(F.size("s") > min_doc_len)
    marked = F.transform(F.col("s"), lambda w, i: F.struct(w.alias("word"), F.when((i > 0) & (w == F.get(F.col("s"), i - 1)), 0).otherwise(1).alias("first")))
    return words.select(F.inline(marked)).groupBy("word").agg(F.count(F.lit(1)).alias("tf"), F.sum("first").alias("df"))


def unseen_documents(docs: DataFrame, key: str = "text", delay: str = "1 hour") -> DataFrame:
    """Documents whose key has not come within the delay; what is older is forgotten."""
    return docs.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, size: str = "5 minutes", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, total) of events (ts, event_type, value) in windows of event time."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    grouped = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).groupBy(window, "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def run_to_end(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Runs what is there through a stream into a table beside its checkpoint; a second run goes on from there.

    Each batch writes a part of its own, again if it is tried again. In complete mode the last part is the whole
    table; in append mode all parts together are.
    """
    path = f"{checkpoint.rstrip('/')}/table-{name}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", checkpoint)
    writer.foreachBatch(write).start().awaitTermination()
    rows = stream.sparkSession.read.parquet(path)
    if mode == "complete":
        rows = rows.where(F.col("batch") == rows.agg(F.max("batch")).first()[0])
    return rows.drop("batch")


#: The state store that processors with timers and several states need (a class of Spark).
_STORE, _ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Lives(StatefulProcessor):
    """What each key has had since it last started anew; a timer forgets keys that have been quiet for the time to live."""

    def __init__(self, ttl_us: int, columns: list[str]) -> None:
        self.ttl, self.columns = ttl_us, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.life = handle.getValueState("life", "n long, total double, last long, timer long")

    def handleInputRows(self, key, rows, timerValues):
        new = pd.concat(list(rows)).sort_values(["sort_us", self.columns[0]], kind="stable")
        n, total, last, timer = self.life.get() if self.life.exists() else (0, 0.0, None, None)
        counts, totals = [], []
        for us, value in zip(new["sort_us"].tolist(), new["sort_value"].tolist()):
            if last is None or us - last > self.ttl:
                n, total = 0, 0.0
            n, total, last = n + 1, total + (0.0 if value != value else value), us if last is None else max(last, us)
            counts.append(n)
            totals.append(total)
        due = (last + self.ttl) // 1000 + 1
        if timer is not None and timer != due:
            self.handle.deleteTimer(timer)
        if timer != due:
            self.handle.registerTimer(due)
        self.life.update((n, total, last, due))
        yield new[self.columns].assign(n=counts, total=totals)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.life.clear()
        yield from ()

    def close(self) -> None:
        pass


def counts_until_quiet(events: DataFrame, key: str = "user_id", value: str = "value", order: str = "event_id", ttl: str = "6 hours", delay: str = "1 hour") -> DataFrame:
    """events (ts, key, value, order) with n and total: how many events of the key, and the sum of their values, since it was quiet for longer than ttl.

    State of a key is dropped by a timer of event time once the watermark passes its last event by ttl, so that what is
    held does not grow with the keys ever seen; a key that comes back starts anew. The result is that of all events
    sorted by ts, then order, however they are dealt to batches, as long as none is later than delay. Null values add
    nothing; a null key is a key; rows without ts go. The session needs the RocksDB state store, which use_rocks sets.
    """
    us = int(pd.Timedelta(ttl) / pd.Timedelta("1us"))
    columns = [order, key, "ts"]
    kinds = dict(events.dtypes)
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).where("ts is not null").withWatermark("ts", delay)
    rows = rows.select(*columns, F.unix_micros("ts").alias("sort_us"), F.col(value).cast("double").alias("sort_value"))
    schema = f"`{order}` {kinds[order]}, `{key}` {kinds[key]}, ts timestamp, n long, total double"
    return rows.groupBy(key).transformWithStateInPandas(_Lives(us, columns), schema, "Append", "EventTime")


@contextlib.contextmanager
def use_rocks(spark: SparkSession):
    """The RocksDB state store for the streams that start within."""
    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_STORE, before)
