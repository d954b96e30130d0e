"""Authors and reverts of revision histories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ANONYMOUS = "ANONIPEDITS"
_IPV4 = r"^(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}"


def _is_bot():
    bot = lambda c: F.coalesce(F.col(c).rlike("(?i)bot"), F.lit(False))
    return bot("user") | bot("comment")


def author_counts(revisions: DataFrame) -> DataFrame:
    """(title, author, n_edits) of revisions (title, user, comment, anon): bots left out, anonymous edits as one author."""
    anonymous = F.coalesce("anon", F.lit(False)) & (F.coalesce("user", F.lit("")).rlike(_IPV4) | (F.coalesce("user", F.lit("")) == ""))
    named = revisions.where(anonymous | ~_is_bot()).withColumn("author", F.when(anonymous, ANONYMOUS).otherwise(F.col("user")))
    return named.groupBy("title", "author").agg(F.count(F.lit(1)).alias("n_edits"))


def author_list(revisions: DataFrame) -> DataFrame:
    """(title, authors): names in order, then ANONIPEDITS:n."""
    counts = author_counts(revisions)
    names = F.array_sort(F.filter(F.collect_list("author"), lambda a: a != ANONYMOUS))
    anonymous = F.coalesce(F.sum(F.when(F.col("author") == ANONYMOUS, F.col("n_edits"))), F.lit(0))
    return counts.groupBy("title").agg(F.concat(names, F.array(F.concat(F.lit(f"{ANONYMOUS}:"), anonymous))).alias("authors"))


def size_changes(revisions: DataFrame) -> DataFrame:
    """revisions (title, revid, size, ...) with diff_size: the absolute change against the revision before."""
    before = F.lag("size").over(Window.partitionBy("title").orderBy("revid"))
    return revisions.withColumn("diff_size", F.abs(F.col("size") - F.coalesce(before, F.lit(0))))


def reverts(revisions: DataFrame, lookahead: int = 5) -> DataFrame:
    """(title, revid, reverted_by): a later revision within lookahead restores the size before and names this one in its comment."""
    order = Window.partitionBy("title").orderBy("revid")
    later = F.collect_list(F.struct("revid", "size", "comment")).over(order.rowsBetween(1, lookahead))
    rows = revisions.where("size is not null").withColumn("before", F.lag("size").over(order)).withColumn("later", later)
    hits = F.filter("later", lambda r: (r["size"] == F.col("before")) & F.contains(F.coalesce(r["comment"], F.lit("")), F.col("revid").cast("string")))
    return rows.select("title", "revid", F.get(hits, F.lit(0))["revid"].alias("reverted_by")).where("reverted_by is not null")
