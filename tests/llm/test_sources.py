"""The audit of sources and the resampling towards a target, against plain Python and against their SQL."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from corpuscle.llm import divergence, queries, resampling
from corpuscle.llm.common import LETTERS, LETTERS_AND_DIGITS, word_runs

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM, WORD = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@given(st.text(alphabet="aBZé1  \n\x00_日[`{", max_size=60), st.integers(1, 9))
def test_words(text, size):
    for pattern, table in ((TERM, LETTERS), (WORD, LETTERS_AND_DIGITS)):
        assert [w.decode() for run in word_runs(text.encode(), table, size) for w in run] == re.findall(pattern, text.translate(LOWER))


@given(st.integers(1, 9 * 10**14), st.integers(1, 9 * 10**14))
def test_parts_per_billion(a, b):
    a, b = min(a, b), max(a, b)
    assert divergence.parts_per_billion(np.array([a]), b).tolist() == [1 + 10**9 * a // b]


def audited(rows, min_docs, top):
    """rows (lang, source, text): the audit by its definition, term by term."""
    rows = [(a or "", b or "", re.findall(TERM, (t or "").translate(LOWER))) for a, b, t in rows]
    groups = sorted({r[:2] for r in rows})
    out = []
    for lang in sorted({g[0] for g in groups}):
        df = Counter(t for a, _, w in rows if a == lang for t in set(w))
        kept = sorted(t for t, n in df.items() if n >= min_docs)
        counts = {b: Counter(t for x, y, w in rows if (x, y) == (lang, b) for t in w) for a, b in groups if a == lang}
        whole = sum(counts.values(), Counter())

        def share(c):
            total = sum(c[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (c[t] + 1) // total for t in kept}

        p, q = {b: share(c) for b, c in counts.items()}, share(whole)
        f = lambda x, y: (x - y) ** 2 // y
        for b in counts:
            pairs = [(sum(f(p[b][t], p[o][t]) for t in kept), o) for o in counts if o != b]
            terms = [(f(p[b][t], q[t]), t) for t in kept if counts[b][t] and p[b][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, b, part, item, v, k + 1) for k, (v, item) in enumerate(found[:most])]
    return sorted(out)


def corpus(rng):
    words = ["the", "cat", "Dog", "été", "x1y", "日本", "zz", "q", "w", "É"]
    rows = [(f"l{k % 3}", f"s{rng.integers(k % 3 * 2 + 1)}", " ".join(rng.choice(words, rng.integers(0, 12)))) for k in range(90)]
    return rows + [(None, None, None), (None, "", "the the"), ("alone", "x", "the"), ("two", "x", "rare"), ("two", "y", None), ("two", "z", "1 2 3")] + rows[:5]


@pytest.mark.parametrize("options", [{}, {"block_terms": 2, "travelling": 1, "top": 3}, {"block_terms": 3, "travelling": 2000}])
def test_audit(spark, options, monkeypatch):
    monkeypatch.setattr(divergence, "COUNTED", 7)
    rows = corpus(np.random.default_rng(1))
    table = spark.createDataFrame([(*r, "clash", 1) for r in rows], "lang string, source string, text string, term string, n int").repartition(3)
    found = divergence.audit(table, **options).collect()
    assert sorted(map(tuple, found)) == audited(rows, 3, options.get("top", 200))


def test_every_pair_meets_once(spark):
    """Fields of all sizes up to nine: each ordered pair has one row, and both directions come from one meeting."""
    rows = [(f"l{n}", f"s{k}", "a b a" * (k + 1)) for n in range(1, 10) for k in range(n)]
    found = divergence.audit(spark.createDataFrame(rows, "lang string, source string, text string")).where("part = 'pair'").collect()
    assert Counter((r.lang, r.source, r.item) for r in found) == Counter({(f"l{n}", f"s{a}", f"s{b}"): 1 for n in range(1, 10) for a in range(n) for b in range(n) if a != b})


def test_audit_of_nothing(spark):
    assert divergence.audit(spark.createDataFrame([], "lang string, source string, text string")).collect() == []


def features(text, runs, buckets):
    words = re.findall(WORD, (text or "").translate(LOWER))
    return len(words), Counter(zlib.crc32(" ".join(words[i : i + k]).encode()) % buckets for k in range(1, runs + 1) for i in range(len(words) - k + 1))


def resampled(docs, target, percent, min_words, buckets, runs, seed):
    rows = [(i, *features(t, runs, buckets)) for i, t in docs]
    own, goal = sum((r[2] for r in rows), Counter()), sum((features(t, runs, buckets)[1] for t in target), Counter())
    n, m = sum(own.values()), sum(goal.values())
    gains = [math.floor(1000 * math.log((goal[b] + 1.0) * (n + buckets) / ((own[b] + 1.0) * (m + buckets)))) for b in range(buckets)]
    out = []
    for i, words, c in rows:
        total = sum(c.values())
        weight = math.floor(Fraction(sum(gains[b] * k for b, k in c.items()), total)) if total else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, total, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), words))
    may = sorted((r for r in out if r[4] >= min_words), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    drawn = percent * len(may) // 100
    return Counter((*r[:4], k + 1 if k < drawn else None) for k, r in enumerate(may)) + Counter((*r[:4], None) for r in out if r[4] < min_words)


DOCS = [(k, " ".join(f"w{(k * j) % 37}" for j in range(k % 40))) for k in range(200)] + [(None, None), (None, "a b c d e"), (300, ""), (301, "日本 É1 x-y_z"), (302, "long word " * 3000), (5, "same again here " * 3), (5, "same again here " * 3)]


@pytest.mark.parametrize("options", [{}, {"buckets": 11, "runs": 3, "min_words": 4, "percent": 60, "seed": 1}, {"buckets": 70_000, "runs": 1}])
def test_resample(spark, options, monkeypatch):
    monkeypatch.setattr(resampling, "word_runs", lambda data, table: word_runs(data, table, 500))
    options = {"percent": 25, "min_words": 20, "buckets": 10_000, "runs": 2, "seed": 7} | options
    docs = spark.createDataFrame([(*r, "x", 1, 2.0) for r in DOCS], "doc_id long, text string, rank string, weight int, _place double").repartition(4)
    target = [None, "", "w1 w2 w3 long word", "É1 日本"]
    found = resampling.resample(docs, spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int"), **options)
    assert Counter(map(tuple, found.collect())) == resampled(DOCS, target, **options)


def test_matrix_blocks(spark):
    """The stored rows add up to the counts of each document, and the column sums to those of all."""
    matrix = resampling.count_matrix(spark.createDataFrame(DOCS, "doc_id long, text string"))
    sums = np.zeros(10_000, np.int64)
    per_doc = defaultdict(list)
    for block in (r.asDict() for r in matrix.collect()):
        at, counts = resampling._entries(block, "<u2")
        for k, i in enumerate(block["doc_id"]):
            mine = slice(block["row_start"][k], block["row_start"][k + 1])
            per_doc[i].append(dict(zip(at[mine].tolist(), counts[mine].tolist())))
            sums[at[mine]] += counts[mine]
    assert all(features(t, 2, 10_000)[1] in per_doc[i] for i, t in DOCS)
    assert resampling.column_sums(matrix) == sums.tolist()


def test_resample_empty(spark):
    nothing = spark.createDataFrame([], "doc_id long, text string")
    assert resampling.resample(nothing, nothing).collect() == []
    some = spark.createDataFrame(DOCS, "doc_id long, text string")
    assert Counter(map(tuple, resampling.resample(some, nothing).collect())) == resampled(DOCS, [], 25, 20, 10_000, 2, 7)


@pytest.mark.parametrize("name", ["op11_divergence", "op12_resampling"])
def test_queries_match_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    expected = con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in expected.description]
    assert Counter(map(tuple, queries.QUERIES[name](spark, sf_dir).select(*names).collect())) == Counter(expected.fetchall())
