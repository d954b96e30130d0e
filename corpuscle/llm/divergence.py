"""How the sources of a language differ: every pair of them compared by systolic rotation over blocks of terms."""

from __future__ import annotations

import heapq
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import LETTERS, release, slices, stage, utf8, word_runs

#: A term counts in a language if so many of its documents hold it; terms ranked for each group.
MIN_DOCS, TOP = 3, 200
#: Terms of a language in a block: what a task holds of a group at a time.
BLOCK_TERMS = 1 << 16
#: Counts that a task adds up before it hands them on.
COUNTED = 300_000
#: Bytes of vectors that circulate in a job at most, unless those of one round are more.
TRAVELLING = 256 << 20


def _count_terms(batches):
    """(lang, source, term, n, docs) of a partition; a term may come several times. A group without terms has one row of null term."""
    counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}  # by group: how often each term occurs, and in how many documents
    seen: set[tuple[str, str]] = set()
    held = 0

    def flush():
        for (lang, source), (n, docs) in counts.items():
            names = list(n)
            columns = [pa.array([lang] * len(names), pa.string()), pa.array([source] * len(names), pa.string()), pa.array(names, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n.values(), pa.int64()), pa.array(map(docs.__getitem__, names), pa.int64())], _COUNTS)

    for batch in slices(batches):
        langs, sources = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
        for lang, source, data in zip(langs, sources, utf8(batch.column("text"))):
            group = (lang or "", source or "")
            seen.add(group)
            n, docs = counts.setdefault(group, (Counter(), Counter()))
            held -= len(n)
            own: set[bytes] = set()
            for words in word_runs(data, LETTERS):
                n.update(words)
                own.update(words)
            docs.update(own)
            held += len(n)
            if held > COUNTED:
                yield from flush()
                counts.clear()
                held = 0
    yield from flush()
    nothing = [pa.array([g[k] for g in seen], pa.string()) for k in (0, 1)]
    empty = [pa.nulls(len(seen), t) for t in (pa.string(), pa.int64(), pa.int64())]
    yield pa.RecordBatch.from_arrays([*nothing, *empty], _COUNTS)


_COUNTS = ["lang", "source", "term", "n", "docs"]


def _number_terms(min_docs: int):
    """Rows (lang, source, term, n, docs) sorted by (lang, term) -> those of kept terms, with the term's number in this partition and its count in the language."""

    def run(batches):
        number, before = -1, None
        rest = None
        batches = iter(batches)
        while True:
            batch = next(batches, None)
            rows = rest if batch is None else batch if rest is None else pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            if rows is None or not rows.num_rows:
                return
            new = np.ones(rows.num_rows, bool)
            same = [pc.equal(rows.column(c).slice(1), rows.column(c).slice(0, rows.num_rows - 1)).to_numpy(zero_copy_only=False) for c in ("lang", "term")]
            new[1:] = ~(same[0] & same[1])
            starts = np.flatnonzero(new)
            whole = rows.num_rows if batch is None else int(starts[-1])  # the last term may go on in the next batch
            rest = rows.slice(whole)
            if whole:
                starts = starts[starts < whole]
                term = np.cumsum(new[:whole]) - 1
                total, docs = (np.add.reduceat(rows.column(c).to_numpy()[:whole], starts) for c in ("n", "docs"))
                kept = docs >= min_docs
                langs = rows.column("lang").take(pa.array(starts)).to_pylist()
                ids = np.zeros(len(starts), np.int64)
                for k in np.flatnonzero(kept).tolist():  # numbers start anew with each language
                    number = number + 1 if langs[k] == before else 0
                    ids[k], before = number, langs[k]
                at = np.flatnonzero(kept[term])
                taken = rows.slice(0, whole).take(pa.array(at))
                columns = [*[taken.column(c) for c in ("lang", "source", "term", "n")], pa.array(ids[term[at]]), pa.array(total[term[at]])]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "id", "lang_n"])
            if batch is None:
                return

    return run


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """((lang, source, part, id, term, n, lang_n), groups (lang, source)) of docs (lang, source, text), both stage tables.

    The first has how often each group holds each term of at least min_docs of its language's documents, and how often the
    language does. Counts are added up within tasks, then meet once, by language and term: where all groups' rows of a term
    lie together, it is decided whether it stays, and the terms of a language are numbered within that partition, part.
    """
    partial = stage(docs.select("lang", "source", "text").mapInArrow(_count_terms, "lang string, source string, term string, n long, docs long"), "partial_counts")
    met = partial.where("term is not null").repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    numbers = met.sortWithinPartitions("lang", "term").mapInArrow(_number_terms(min_docs), "lang string, source string, term string, n long, id long, lang_n long")
    entries = stage(numbers.withColumn("part", F.spark_partition_id()), "entries")
    groups = stage(partial.where("term is null").select("lang", "source").distinct(), "groups")
    release(partial)
    return entries, groups


def parts_per_billion(counts: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(10**9 counts / total), exact for numbers below 9 * 10**14: in steps of four digits or fewer."""
    out, rest = np.zeros(len(counts), np.int64), counts.astype(np.int64)
    for digits in (10_000, 10_000, 10):
        more, rest = np.divmod(rest * digits, total)
        out = out * digits + more
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _narrow(x: np.ndarray) -> bytes:
    """Unsigned numbers compressed, in the fewest of 1, 2, 4 or 8 bytes each; the first byte tells how many."""
    width = next(w for w in (1, 2, 4, 8) if not len(x) or x.max() < 1 << (8 * w - (w == 8)))
    return bytes([width]) + zlib.compress(x.astype(f"<u{width}").tobytes(), 1)


def _wide(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data[1:]), f"<u{data[0]}").astype(np.int64)


def _compress(top: int):
    """Rows (..., terms, total, lang_total, n_terms) -> compressed vectors, and the block's best terms of the group from a local heap."""

    def run(batches):
        for batch in slices(batches):
            ids, counts, best = [], [], []
            keep = [batch.column(c) for c in ("lang", "place", "source", "block", "width", "total", "n_terms")]
            for terms, total, n_terms, lang_total in zip(*(batch.column(c).to_pylist() for c in ("terms", "total", "n_terms", "lang_total"))):
                terms = sorted(terms or (), key=lambda t: t["id"])
                at, n, whole = (np.array([t[c] for t in terms], np.int64) for c in ("id", "n", "lang_n"))
                ids.append(_narrow(np.diff(at, prepend=0)))
                counts.append(_narrow(n))
                found = []
                if terms:
                    p, q = parts_per_billion(n + 1, total + n_terms), parts_per_billion(whole + 1, lang_total + n_terms)
                    values = divergence(p, q)
                    found = heapq.nsmallest(top, ((-int(values[k]), terms[k]["term"].encode()) for k in np.flatnonzero(p > q)))
                best.append([{"item": term.decode(), "value": -value} for value, term in found])
            columns = [*keep, pa.array(ids, pa.binary()), pa.array(counts, pa.binary()), pa.array(best, pa.list_(pa.struct([("item", pa.string()), ("value", pa.int64())])))]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "place", "source", "block", "width", "total", "n_terms", "ids", "counts", "best"])

    return run


_VECTOR = "lang string, place int, source string, block int, width int, total long, n_terms long, ids binary, counts binary, best array<struct<item: string, value: long>>"


def group_vectors(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """A row for each group and block of its language's terms: compressed (ids, counts), the group's place in its language, what p needs, best terms.

    The parts' terms of a language, end to end, are cut into blocks of block_terms, in which they have ids from 0; width
    is their number. Each group has a row of every block, an empty one too, so that two groups meet block by block.
    """
    entries, groups = kept_terms(docs, min_docs)
    parts = stage(entries.groupBy("lang", "part").agg((F.max("id") + 1).alias("n"), F.sum("n").alias("sum")), "parts")  # a row for each task and language
    before = F.coalesce(F.sum("n").over(Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = stage(parts.select("lang", "part", before.alias("before")), "places")
    langs = parts.groupBy("lang").agg(F.sum("n").alias("n_terms"), F.sum("sum").alias("lang_total"))
    at = F.col("before") + F.col("id")
    block, width = F.floor(at / block_terms).cast("int"), F.least(F.lit(block_terms), F.col("n_terms") - F.col("block").cast("long") * block_terms)
    vectors = entries.join(places, ["lang", "part"]).select("lang", "source", block.alias("block"), (at % block_terms).alias("id"), "term", "n", "lang_n")
    listed = vectors.groupBy("lang", "source", "block").agg(F.sum("n").alias("n"), F.collect_list(F.struct("id", "term", "n", "lang_n")).alias("terms"))  # at most block_terms each
    listed = stage(listed, "listed")
    totals = listed.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    known = groups.join(langs, "lang", "left").join(totals, ["lang", "source"], "left")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1  # as many rows as a language has sources
    blocks = F.greatest(F.ceil(F.col("n_terms") / block_terms), F.lit(1)).cast("int")
    known = known.select("lang", "source", place.alias("place"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "n_terms", "lang_total")])
    grid = known.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumn("width", width.cast("int"))
    rows = grid.join(listed.drop("n"), ["lang", "source", "block"], "left")
    out = stage(rows.mapInArrow(_compress(top), _VECTOR), "group_vectors")
    for old in (entries, groups, parts, places, listed):
        release(old)
    return out


def _sums(n: np.ndarray, m: np.ndarray, rest: int, total: int, other: int, n_terms: int) -> tuple[int, int]:
    """Both directions of a meeting: counts n and m of the terms that either group has in a block, rest terms that none has."""
    n, m = np.append(n, 0), np.append(m, 0)  # the last stands for the rest
    p, q = parts_per_billion(n + 1, total + n_terms), parts_per_billion(m + 1, other + n_terms)
    times = np.ones(len(n), np.int64)
    times[-1] = rest
    return int((divergence(p, q) * times).sum()), int((divergence(q, p) * times).sum())


def _meet(batches):
    for batch in slices(batches):
        forth, back = [], []
        columns = (batch.column(c).to_pylist() for c in ("ids", "counts", "total", "n_terms", "width", "ids2", "counts2", "total2"))
        for ids, counts, total, n_terms, width, ids2, counts2, total2 in zip(*columns):
            if not width:
                forth.append(0)
                back.append(0)
                continue
            at, at2 = np.cumsum(_wide(ids)), np.cumsum(_wide(ids2))
            union = np.union1d(at, at2)
            n, m = np.zeros(len(union), np.int64), np.zeros(len(union), np.int64)
            n[np.searchsorted(union, at)] = _wide(counts)
            m[np.searchsorted(union, at2)] = _wide(counts2)
            one, two = _sums(n, m, width - len(union), total, total2, n_terms)
            forth.append(one)
            back.append(two)
        keep = [batch.column(c) for c in ("lang", "source", "source2")]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(forth, pa.int64()), pa.array(back, pa.int64())], ["lang", "source", "source2", "forth", "back"])


def meetings(vectors: DataFrame, travelling: int = TRAVELLING) -> DataFrame:
    """(lang, source, item, value): for every ordered pair of a language's groups the divergence of the first from the second, summed over all terms.

    A round-robin tournament by the circle method: with m places (the groups' number made even), in round r the place
    m - 1 meets r, and others meet where their places add up to 2r modulo m - 1. Residents are dealt out once by
    (language, place, block) and stay in their partitions; of a meeting's two vectors one travels there, each group's
    in about half of its meetings, and both directions are computed at once. As many rounds run in a job as keep the
    vectors on their way under travelling bytes. Each pair meets once, in every block; the blocks' sums are added.
    """
    spark = vectors.sparkSession
    size, last = vectors.agg(F.coalesce(F.sum(F.length("ids") + F.length("counts") + 64), F.lit(0)), F.max("place")).first()
    if last is None:
        return spark.createDataFrame([], "lang string, source string, item string, value long")
    seats = stage(vectors.groupBy("lang").agg((F.max("place") + 1).alias("n")), "seats").withColumn("m", F.col("n") + F.col("n") % 2)
    rounds = last + (last + 1) % 2  # m - 1 of the largest language; others rest when theirs are over
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    columns = ["lang", "place", "block", "source", "total", "n_terms", "width", "ids", "counts"]
    residents = vectors.select(*columns).repartition(parts, "lang", "place", "block").persist()
    travellers = vectors.join(seats, "lang").select("lang", "block", "place", "m", "n", F.col("source").alias("source2"), F.col("total").alias("total2"), F.col("ids").alias("ids2"), F.col("counts").alias("counts2"))
    at_once = max(1, int(travelling // max(1, size // 2)))
    done = []
    for first in range(0, rounds, at_once):
        r = F.explode(F.sequence(F.lit(first), F.lit(min(first + at_once, rounds) - 1))).alias("r")
        # where two places add up to 2r they are the same for one of them: that one meets the last place
        met = F.pmod(2 * F.col("r") - F.col("place"), F.col("m") - 1)
        peer = F.when(F.col("place") == F.col("m") - 1, F.col("r")).when(met == F.col("place"), F.col("m") - 1).otherwise(met).cast("int")
        here = F.when((F.col("place") + F.col("peer")) % 2 == 0, F.col("place") > F.col("peer")).otherwise(F.col("place") < F.col("peer"))
        sent = travellers.select("*", r).where(F.col("r") < F.col("m") - 1).withColumn("peer", peer).where((F.col("peer") < F.col("n")) & here)
        sent = sent.drop("place", "m", "n", "r").withColumnRenamed("peer", "place")
        met_rows = residents.hint("merge").join(sent, ["lang", "place", "block"])
        done.append(stage(met_rows.mapInArrow(_meet, "lang string, source string, source2 string, forth long, back long"), "meetings"))
    residents.unpersist()
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    ways = every.select("lang", F.explode(F.array(F.struct("source", F.col("source2").alias("item"), F.col("forth").alias("f")), F.struct(F.col("source2").alias("source"), F.col("source").alias("item"), F.col("back").alias("f")))).alias("w"))
    return ways.groupBy("lang", F.col("w.source").alias("source"), F.col("w.item").alias("item")).agg(F.sum("w.f").alias("value"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, block_terms: int = BLOCK_TERMS, travelling: int = TRAVELLING) -> DataFrame:
    """docs (lang, source, text) -> (lang, source, part, item, value, rank): how each group (lang, source) differs from its language.

    Part pair: the divergence from each other source of the language, all ranks. Part term: the terms that the group
    has more often than its language, the first top of them. Terms are runs of letters a-z (A-Z lower-cased) and
    characters beyond ASCII; those in at least min_docs documents of a language are kept. Null lang, source and text
    count as ''. Every group that occurs has rows, one without terms too, unless it is its language's only one. Rows that
    repeat count each. Empty docs give no rows. Ties go by the item's bytes. Numbers are exact. Other columns are not read.
    """
    vectors = group_vectors(docs, min_docs, top, block_terms)
    columns = ["lang", "source", "item", "value"]
    pairs = meetings(vectors, travelling).select(*columns, F.lit("pair").alias("part"))
    terms = vectors.select("lang", "source", F.inline("best")).select(*columns, F.lit("term").alias("part"))  # at most top a block
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), F.asc("item")))
    ranked = [x.withColumn("rank", rank) for x in (pairs, terms)]
    out = ranked[0].unionByName(ranked[1].where(F.col("rank") <= top))
    return out.select("lang", "source", "part", "item", "value", "rank")
