"""Queries of row numbers, joins by bounds and ranges, expiring state, user reductions and table functions, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tables
from ..functions.collections import SCRIPTS
from ..operators import numbering, ranges, reductions, similarity, stats
from ..sources import dump, staging, vectors
from ..streaming import counts
from .files import written
from .oracle import _TERMS, _TTEST, _jaccard_of
from .queries import _docs, _table, _vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str):
    def add(function):
        QUERIES[function.__name__], ORACLE_SQL[function.__name__] = function, sql
        return function

    return add


@_query("""WITH placed AS (SELECT doc_id, length(coalesce(text, '')) AS n, (row_number() OVER (ORDER BY doc_id) - 1) // 64 AS chunk FROM documents)
    SELECT chunk, count(*) AS n_docs, min(doc_id) AS first_id, max(doc_id) AS last_id, sum(n)::BIGINT AS n_chars FROM placed GROUP BY chunk""")
def document_chunks(spark, sf_dir):
    """Chunks of 64 documents in order of doc_id over the whole table."""
    rows = numbering.row_chunks(_docs(spark, sf_dir).select("doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n")), 64, "doc_id")
    return rows.groupBy("chunk").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.sum("n").alias("n_chars"))


_BEST = "SELECT head, target, score FROM ({}) QUALIFY row_number() OVER (PARTITION BY head ORDER BY score DESC NULLS LAST, target DESC) <= {}"


@_query(_BEST.format(_jaccard_of("bag AS (SELECT source AS head, unnest(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> '')) AS feature FROM documents)", _TTEST), 7))
def topk_ttest(spark, sf_dir):
    """The seven nearest sources of each by the default metric, over the words of all documents."""
    return similarity.similar_words(_vectors(spark, sf_dir), k=7)


@_query(_BEST.format(_jaccard_of("bag AS (SELECT o_custkey::VARCHAR AS head, l_partkey::VARCHAR AS feature FROM lineitem JOIN orders ON l_orderkey = o_orderkey)", _TTEST), 10))
def topk_ttest_customers(spark, sf_dir):
    """The ten customers whose orders hold most nearly the same parts, by the default metric."""
    bag = _table(spark, sf_dir, "lineitem").join(_table(spark, sf_dir, "orders"), F.expr("l_orderkey = o_orderkey"))
    vectors = bag.groupBy(F.col("o_custkey").cast("string").alias("head"), F.col("l_partkey").cast("string").alias("feature")).agg(F.count(F.lit(1)).alias("cnt"))
    return similarity.similar_words(vectors, k=10)


#: Scripts, and blocks within them.
BLOCKS = [(f"{name} {k}", first, last) for k, (name, first, last) in enumerate(SCRIPTS)] + [("ascii", 0x00, 0x7F), ("capitals", 0x41, 0x5A), ("vowels of e", 0xE8, 0xEB), ("all", 0x00, 0x10FFFF), ("e", 0x65, 0x65)]


@_query(f"""WITH blocks(block, first, last) AS (VALUES {", ".join(map(str, BLOCKS))}), chars AS (SELECT doc_id, unnest(string_split(text, '')) AS c FROM documents WHERE text <> '')
    SELECT doc_id, block, count(*) AS n FROM chars JOIN blocks ON ord(c) BETWEEN first AND last GROUP BY ALL""")
def block_counts(spark, sf_dir):
    """Characters of each document by blocks of code points, some of which lie in others."""
    return ranges.character_blocks(_docs(spark, sf_dir), spark.createDataFrame(BLOCKS, "block string, first long, last long"))


_BANDS = "SELECT s_suppkey, round(s_acctbal * 100)::BIGINT - 5000 AS low, round(s_acctbal * 100)::BIGINT + 5000 + s_suppkey % 7 * 20000 AS high FROM supplier"


@_query(f"WITH bands AS ({_BANDS}) SELECT s_suppkey, count(*) AS n, min(c_custkey) AS first_customer FROM customer JOIN bands ON round(c_acctbal * 100)::BIGINT BETWEEN low AND high GROUP BY s_suppkey")
def balance_bands(spark, sf_dir):
    """Customers whose balance lies in a band around each supplier's; bands are of unequal width and overlap."""
    bands = _table(spark, sf_dir, "supplier").selectExpr("s_suppkey", "bigint(round(s_acctbal * 100)) - 5000 AS low", "bigint(round(s_acctbal * 100)) + 5000 + s_suppkey % 7 * 20000 AS high")
    points = _table(spark, sf_dir, "customer").selectExpr("c_custkey", "bigint(round(c_acctbal * 100)) AS cents")
    made = {"n": F.count(F.lit(1)), "first_customer": F.min("c_custkey")}
    return ranges.aggregate_over(points, bands, "s_suppkey", "cents", "low", "high", made, {"n": F.sum("n"), "first_customer": F.min("first_customer")})


@_query(f"WITH bands AS ({_BANDS}), points AS (SELECT DISTINCT round(c_acctbal * 100)::BIGINT AS cents FROM customer) SELECT cents, arg_min(s_suppkey, (high - low, -low, s_suppkey)) AS s_suppkey FROM points JOIN bands ON cents BETWEEN low AND high GROUP BY cents")
def innermost_bands(spark, sf_dir):
    """The narrowest band that holds each balance."""
    bands = _table(spark, sf_dir, "supplier").selectExpr("s_suppkey", "bigint(round(s_acctbal * 100)) - 5000 AS low", "bigint(round(s_acctbal * 100)) + 5000 + s_suppkey % 7 * 20000 AS high")
    points = _table(spark, sf_dir, "customer").selectExpr("bigint(round(c_acctbal * 100)) AS cents")
    return ranges.innermost(points, bands, "cents", "low", "high").select("cents", "s_suppkey")


class Longest:
    """Number of rows, characters in all, and the three longest texts by (length, then least id)."""

    state = "n long, chars long, sizes array<long>, ids array<long>"
    result = "n long, chars long, longest string"

    @staticmethod
    def _best(pairs):
        best = sorted(pairs, key=lambda p: (-p[0], p[1]))[:3]
        return [p[0] for p in best], [p[1] for p in best]

    def partial(self, rows: pd.DataFrame) -> tuple:
        sizes = rows["text"].fillna("").str.len()
        return len(rows), int(sizes.sum()), *self._best(zip(sizes.tolist(), rows["doc_id"].tolist()))

    def merge(self, one: tuple, other: tuple) -> tuple:
        return one[0] + other[0], one[1] + other[1], *self._best([*zip(one[2], one[3]), *zip(other[2], other[3])])

    def final(self, state: tuple):
        yield state[0], state[1], ",".join(f"{i}:{n}" for n, i in zip(state[2], state[3]))


@_query("""WITH sized AS (SELECT source, doc_id, length(coalesce(text, '')) AS n FROM documents), placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, doc_id) AS k FROM sized)
    SELECT source, count(*) AS n, sum(n)::BIGINT AS chars, string_agg(doc_id || ':' || n, ',' ORDER BY k) FILTER (k <= 3) AS longest FROM placed GROUP BY source""")
def merged_reduction(spark, sf_dir):
    """A user's reduction over the documents of each source, one of which has a third of them, combined before and during the shuffle."""
    return reductions.reduce_by_key(_table(spark, sf_dir, "documents").select("source", "doc_id", "text"), "source", Longest)


def _pairs_of(text, least):
    words = (text or "").split()
    yield from ((f"{a} {b}", len(a) + len(b)) for a, b in zip(words, words[1:]) if len(a) + len(b) >= least)


def _check_least(values):
    if values[1] is None or values[1] < 1:
        raise ValueError("word_pairs takes a constant least length of 1 or more")


_pairs_of.check = _check_least


@_query(r"""WITH w AS (SELECT lang, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\r\x0b\x0c]+'), lambda x: x <> '') AS w FROM documents),
    p AS (SELECT lang, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS pair FROM w)
    SELECT lang, pair, (length(pair) - 1)::INT AS size, count(*) AS n FROM p WHERE length(pair) - 1 >= 6 GROUP BY ALL HAVING count(*) >= 5""")
def lateral_pairs(spark, sf_dir):
    """A user's mapper called from SQL: any number of rows for each document, joined to it."""
    tables.register_mapper(spark, "word_pairs", _pairs_of, "pair string, size int")
    _docs(spark, sf_dir).createOrReplaceTempView("docs_of_pairs")
    return spark.sql("SELECT d.lang, p.pair, p.size, count(*) AS n FROM docs_of_pairs d, LATERAL word_pairs(d.text, 6) p GROUP BY ALL HAVING count(*) >= 5")


class Visits:
    """Runs of events without a pause of over six hours: a row as each one ends."""

    def __init__(self):
        self.run = None

    def add(self, row):
        at = row["ts"].timestamp()
        if self.run and at - self.run[2] > 6 * 3600:
            yield self._row()
            self.run = None
        user, first, _, n = self.run or (row["user_id"], row["event_id"], at, 0)
        self.run = (user, first, at, n + 1)

    def _row(self):
        return self.run[0], self.run[1], self.run[3]

    def end(self):
        if self.run:
            yield self._row()


@_query("""WITH m AS (SELECT user_id, event_id, ts, ts - lag(ts) OVER o > INTERVAL 6 HOUR AS pause FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts)),
    r AS (SELECT *, count(*) FILTER (pause) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM m)
    SELECT user_id, arg_min(event_id, ts) AS first_event, count(*) AS n FROM r GROUP BY user_id, k""")
def visits_by_key(spark, sf_dir):
    """A user's function of each key's rows in order, called from SQL: it asks for the partitioning itself and holds one run."""
    tables.register_by_key(spark, "visits", Visits, "user_id", "ts", "user_id long, first_event long, n long")
    _table(spark, sf_dir, "events").createOrReplaceTempView("events_of_visits")
    return spark.sql("SELECT user_id, first_event, n FROM visits(TABLE(events_of_visits))")


def _flawed_terms(spark: SparkSession, sf_dir: str) -> str:
    """Term statistics of which every seventh line by tf has no df, and every eleventh no number for tf."""
    terms = stats.term_doc_freq(_docs(spark, sf_dir))
    tf = F.when(F.col("tf") % 11 == 0, F.concat(F.lit("x"), F.col("tf"))).otherwise(F.col("tf").cast("string"))
    line = F.when(F.col("tf") % 7 == 0, F.concat_ws("\t", "word", tf)).otherwise(F.concat_ws("\t", "word", tf, F.col("df").cast("string")))
    return written(terms.select(line.alias("value")), "flawed.tsv")


@_query(f"WITH {_TERMS} SELECT CASE WHEN tf % 7 = 0 THEN word || chr(9) || CASE WHEN tf % 11 = 0 THEN 'x' || tf ELSE tf::VARCHAR END ELSE word || chr(9) || 'x' || tf || chr(9) || df END AS line FROM terms WHERE df >= 5 AND (tf % 7 = 0 OR tf % 11 = 0)")
def rejected_terms(spark, sf_dir):
    """The lines of a table of terms that fall out when it is read."""
    return vectors.rejected_lines(spark, _flawed_terms(spark, sf_dir)).select("line")


@_query(f"WITH {_TERMS} SELECT count(*) AS n_lines, count(*) FILTER (tf % 7 = 0 OR tf % 11 = 0) AS n_rejected, (sum(tf) FILTER (tf % 7 <> 0 AND tf % 11 <> 0))::BIGINT AS tf FROM terms WHERE df >= 5")
def counted_rejects(spark, sf_dir):
    """How many lines fell out, counted in the pass that read the others."""
    from pyspark.sql import Observation

    seen = Observation("terms")
    total = vectors.read_term_stats(spark, _flawed_terms(spark, sf_dir), seen).agg(F.sum("tf").alias("tf")).first()
    return spark.createDataFrame([(seen.get["n_lines"], seen.get["n_rejected"], total["tf"])], "n_lines long, n_rejected long, tf long")


#: The name of the category namespace in each language, as the titles below spell it.
_CATEGORY = "CASE lang WHEN 'de' THEN 'Kategorie' WHEN 'fr' THEN 'catégorie' WHEN 'es' THEN 'Categoría' ELSE 'CATEGORY' END"
_LOCAL_TITLE = f"CASE doc_id % 5 WHEN 0 THEN {_CATEGORY} || ':d' || doc_id WHEN 1 THEN 'Kategorie:d' || doc_id WHEN 2 THEN 'template : d_' || doc_id WHEN 3 THEN ':Image:d' || doc_id ELSE 'd:' || doc_id END"


@_query(f"""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 14 WHEN 1 THEN CASE WHEN lang = 'de' THEN 14 ELSE 0 END WHEN 2 THEN 10 WHEN 3 THEN 6 ELSE 0 END::INT AS ns,
    CASE WHEN doc_id % 5 = 1 AND lang <> 'de' THEN 'Kategorie:d' || doc_id WHEN doc_id % 5 = 2 THEN 'D ' || doc_id WHEN doc_id % 5 = 4 THEN 'D:' || doc_id ELSE 'D' || doc_id END AS partial,
    CASE doc_id % 5 WHEN 0 THEN upper({_CATEGORY}[1]) || {_CATEGORY}[2:] || ':D' || doc_id WHEN 1 THEN 'Kategorie:' || CASE WHEN lang = 'de' THEN 'D' ELSE 'd' END || doc_id
        WHEN 2 THEN 'Template:D ' || doc_id WHEN 3 THEN 'Image:D' || doc_id ELSE 'D:' || doc_id END AS "full" FROM documents""")
def titles_by_language(spark, sf_dir):
    """Titles of four languages split in one plan, each by the names of its own language."""
    pages = _table(spark, sf_dir, "documents").select("doc_id", "lang", F.expr(_LOCAL_TITLE).alias("title"))
    return dump.split_by_language(pages, dump.namespace_table(spark)).select("doc_id", "ns", "partial", "full")


@_query("""WITH g AS (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER o > 21600000000 AS pause FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)),
    r AS (SELECT *, count(*) FILTER (pause) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g)
    SELECT event_id, user_id, row_number() OVER w AS n, round(sum(value) OVER w, 4) AS total FROM r WINDOW w AS (PARTITION BY user_id, k ORDER BY ts, event_id)""")
def stream_expiring_state(spark, sf_dir):
    """Events in four batches, each of several days: users who were quiet for six hours are forgotten and start anew."""
    events = _table(spark, sf_dir, "events")
    path = staging.folder(spark, "events")
    for part in range(4):
        days = events.where(F.floor(F.dayofmonth("ts") / 8) == part)
        days.repartitionByRange(2, "ts", "event_id").write.mode("append").parquet(path)
    stream = counts.stream_parquet(spark, path, events.schema, files_per_batch=2)
    with counts.use_rocks(spark):
        found = counts.run_to_end(counts.counts_until_quiet(stream), "lives", staging.folder(spark, "checkpoint"), "append")
    return found.select("event_id", "user_id", "n", F.round("total", 4).alias("total"))
