"""URL allow and block rules by a sort-merge range join.

A host becomes its labels in reverse order, each ended by a separator that sorts below all others, so that a host
and its subdomains are one interval of keys. A sweep over sorted keys keeps a stack of the rules whose interval
holds the current key; they nest, as one host's interval lies inside another's or apart from it.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rule tables of up to so many rows go to every task; larger ones are dealt out by key range with the urls.
LOCAL_RULES = 50_000
_SEPARATOR, _ESCAPE = "\x01", "\x02"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): host from after the first :// up to / ? # or the end, A-Z lower-cased; path then up to ? or #."""
    cut = F.instr(url, "://")
    rest = F.when(cut > 0, F.substring(url, cut + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def host_key(host: Column) -> Column:
    """The labels in reverse order, each ended by the separator; what a host holds of it, and of the escape, is escaped."""
    host = F.replace(F.replace(host, F.lit(_ESCAPE), F.lit(_ESCAPE + "\x04")), F.lit(_SEPARATOR), F.lit(_ESCAPE + "\x03"))
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), _SEPARATOR), F.lit(_SEPARATOR))


class Sweep:
    """The stack of rules whose interval holds the current key; keys must come in ascending order."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, dict[str, tuple[str, str, str]], list[int]]] = []

    def to(self, key: str) -> None:
        while self.stack and not key.startswith(self.stack[-1][0]):
            self.stack.pop()

    def push(self, key: str, host: str, path: str, verdict: str) -> None:
        self.to(key)
        if not self.stack or self.stack[-1][0] != key:
            self.stack.append((key, {}, []))
        _, paths, lengths = self.stack[-1]
        if path not in paths or verdict == "block":
            if path not in paths and len(path) not in lengths:
                bisect.insort(lengths, len(path))
            paths[path] = (host, path, verdict)

    def best(self, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest rule on the stack that path starts with; of equal ones that of the longer host."""
        found = None
        for _, paths, lengths in reversed(self.stack):
            hit = next((paths[path[:n]] for n in reversed(lengths) if path[:n] in paths), None)
            if hit and (found is None or len(hit[0]) + len(hit[1]) > len(found[0]) + len(found[1])):
                found = hit
        return (found[0] + found[1], found[2]) if found else None


def _result(batch, rules, verdicts):
    return pa.RecordBatch.from_arrays(
        [batch.column("page_id"), batch.column("host"), batch.column("path"), pa.array(rules, pa.string()), pa.array(verdicts, pa.string())],
        ["page_id", "host", "path", "rule", "verdict"],
    )


def _sweep_local(rules: list[tuple[str, str, str, str]], default: str):
    def run(batches):
        sweep, at = Sweep(), 0
        for batch in batches:
            found = []
            for key, path in zip(batch.column("key").to_pylist(), batch.column("path").to_pylist()):
                while at < len(rules) and rules[at][0] <= key:
                    sweep.push(*rules[at])
                    at += 1
                sweep.to(key)
                found.append(sweep.best(path) or (None, default))
            yield _result(batch, [x[0] for x in found], [x[1] for x in found])

    return run


def _sweep_dealt(default: str):
    """Rules come among the urls, before those of the same key; each part starts with an empty stack."""

    def run(batches):
        sweep, part = Sweep(), None
        for batch in batches:
            found, urls = [], []
            columns = [batch.column(x).to_pylist() for x in ("part", "kind", "key", "host", "path", "rule_verdict")]
            for k, (p, kind, key, host, path, verdict) in enumerate(zip(*columns)):
                if p != part:
                    sweep, part = Sweep(), p
                if kind == 0:
                    sweep.push(key, host, path, verdict)
                else:
                    sweep.to(key)
                    urls.append(k)
                    found.append(sweep.best(path) or (None, default))
            yield _result(batch.take(pa.array(urls, pa.int64())), [x[0] for x in found], [x[1] for x in found])

    return run


_OUT = "page_id long, host string, path string, rule string, verdict string"


def judge_urls(
    pages: DataFrame, rules: Iterable[tuple[str, str, str]] | DataFrame, default: str = "allow", local_rules: int = LOCAL_RULES
) -> DataFrame:
    """pages (page_id, url), rules (host, path, verdict) -> (page_id, host, path, rule, verdict), a row for each row.

    A rule fits its host and all subdomains where the url's path starts with the rule's path; the longest rule
    (host and path together) wins, of equal ones that of the longer host, of a rule given twice its block.
    Without a rule: rule null, verdict default. A null url, or one without ://, has an empty host and path.
    Up to local_rules rules are merged with each partition's sorted urls, without a shuffle. Larger tables and the
    urls are dealt out by ranges of keys; a rule goes to each range that its interval meets, and the urls of a
    host that fills several ranges are spread over these.
    """
    host, path = url_parts(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("key", host_key(F.col("host")))
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame([tuple(x) for x in rules], "host string, path string, verdict string")
    rules = rules.where("host is not null and verdict is not null").select(
        F.translate("host", _UPPER, _LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict"
    )
    rules = rules.withColumn("key", host_key(F.col("host")))
    few = rules.limit(local_rules + 1).collect()
    if len(few) <= local_rules:
        listed = sorted((r.key, r.host, r.path, r.verdict) for r in few)
        return urls.sortWithinPartitions("key").mapInArrow(_sweep_local(listed, default), _OUT)

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = max(1, pages.count())
    picked = urls.sample(min(1.0, 40 * n / total), seed=7).select("key").orderBy(F.xxhash64("key", "page_id")).limit(100 * n)
    sample = sorted(r.key for r in picked.collect())
    bounds = [sample[len(sample) * k // n] for k in range(1, n)] if sample else []

    def deal(key: str, salt: str | None) -> list[int]:
        """The part of a url; all parts that a rule's interval meets if salt is None."""
        low = bisect.bisect_left(bounds, key)
        if salt is None:
            return list(range(low, bisect.bisect_right(bounds, key + "\U0010ffff") + 1))
        return [low + zlib.crc32(salt.encode()) % (bisect.bisect_right(bounds, key) - low + 1)]

    def parts(batches):
        for batch in batches:
            keys, kinds, salts = (batch.column(x).to_pylist() for x in ("key", "kind", "salt"))
            dealt = [deal(k, None if kind == 0 else s or "") for k, kind, s in zip(keys, kinds, salts)]
            index = pa.array([k for k, x in enumerate(dealt) for _ in x], pa.int64())
            rows = batch.take(index)
            yield pa.RecordBatch.from_arrays(
                [pa.array([p for x in dealt for p in x], pa.int32()), *[rows.column(x) for x in ("kind", "key", "page_id", "host", "path", "rule_verdict")]],
                ["part", "kind", "key", "page_id", "host", "path", "rule_verdict"],
            )

    both = rules.select(F.lit(0).alias("kind"), "key", F.lit(None).cast("long").alias("page_id"), "host", "path", F.col("verdict").alias("rule_verdict"), F.lit("").alias("salt")).unionByName(
        urls.select(F.lit(1).alias("kind"), "key", "page_id", "host", "path", F.lit(None).cast("string").alias("rule_verdict"), F.concat_ws("/", "page_id", "path").alias("salt"))
    )
    dealt = both.mapInArrow(parts, "part int, kind int, key string, page_id long, host string, path string, rule_verdict string")
    return dealt.repartition(n, "part").sortWithinPartitions("part", "key", "kind").mapInArrow(_sweep_dealt(default), _OUT)
