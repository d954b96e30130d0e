import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpuscle.llm import mixing, packing, token_files, tokens
from corpuscle.llm.tokens import encoder

TEXTS = [(1, "Hello world, it's me."), (2, None), (3, ""), (4, "a  b \n c"), (5, "word " * 5000), (6, "日本 語 😀"), (6, "日本 語 😀"), (None, "no id"), (7, "<|endoftext|> is text"), (8, "x" * 30_000)]


@pytest.fixture(scope="module")
def plain():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


PIECES = st.one_of(st.text(alphabet=" \n\tabcSTé'.,1日\x85\xa0\x1c\x01!-😀ǅͿ\u200b", max_size=40), st.text(max_size=10), st.just("<|endoftext|>"))


@given(st.lists(st.one_of(st.none(), st.lists(PIECES, max_size=4).map("".join)), max_size=6))
@settings(max_examples=300, deadline=None)
def test_encoder(texts):
    """Against the library itself: blanks of all kinds, special tokens' strings and what looks like the splitter's own mark."""
    library = encoder().tokenizer
    ids, sizes = encoder().column(pa.array(texts, pa.string()))
    expected = [library.encode(x or "", add_special_tokens=False).ids for x in texts]
    assert sizes.tolist() == [len(x) for x in expected]
    assert ids.tolist() == [i for x in expected for i in x]
    assert [encoder().encode(x or "").tolist() for x in texts] == expected


def test_special_strings(plain):
    assert encoder().encode("<|endoftext|> is text").tolist() == plain("<|endoftext|> is text") == [50256, 318, 2420]


def test_encoder_cuts_long_texts(plain, monkeypatch):
    monkeypatch.setattr(tokens, "PART", 50)
    rng = np.random.default_rng(2)
    for alphabet in (list("ab .,\n1"), list("日本。,1ab_")):
        text = "".join(rng.choice(alphabet, 3000))
        assert encoder().column(pa.array([text, "short"]))[0].tolist() == plain(text) + plain("short")


def test_encoder_cache_restarts(plain):
    from corpuscle.llm.tokens import Encoder

    small = Encoder(public_tokenizers.path("byte_bpe_50k.json"), cached=3)
    for _ in range(2):
        for _, text in TEXTS:
            assert small.encode(text or "").tolist() == small.column(pa.array([text], pa.string()))[0].tolist() == plain(text)


def docs(spark, rows=TEXTS):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, offset string, length int")


def test_packing(spark, plain):
    found = [r.asDict() for r in packing.pack_documents(docs(spark), with_ids=True).collect()]
    assert {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} <= set(found[0])
    by_sequence: dict = {}
    for r in found:
        by_sequence.setdefault(r["sequence_id"], []).append(r)
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    texts = Counter((i, tuple(plain(t) + [0])) for i, t in TEXTS)
    for (i, ids), copies in texts.items():
        whole = np.array(ids, "<u4").tobytes()
        mine = [r for r in found if r["doc_id"] == i]
        assert all(r["doc_tokens"] == len(ids) for r in mine)
        assert Counter((r["start"], r["ids"]) for r in mine) == Counter({(a, whole[4 * a : 4 * a + 4096]): copies for a in range(0, len(ids), 1024)})


def test_sequences(spark):
    packed = packing.pack_documents(docs(spark), with_ids=True)
    assert {len(r.ids) for r in packing.sequences(packed).collect()} == {1024}


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), min_size=1))
@settings(max_examples=200, deadline=None)
def test_shortest_pack_first(histogram):
    patterns = packing.shortest_pack_first(histogram, 64)
    placed = Counter()
    for lengths, count in patterns:
        assert sum(lengths) <= 64 and count > 0
        for length in lengths:
            placed[length] += count
    assert placed == histogram


def test_packing_wastes_little():
    rng = np.random.default_rng(0)
    histogram = Counter(rng.integers(1, 1025, 20_000).tolist())
    patterns = packing.shortest_pack_first(histogram, 1024)
    assert sum(k * v for k, v in histogram.items()) >= 0.98 * 1024 * sum(c for _, c in patterns)


def test_token_files(spark, plain):
    found = token_files.round_trip(docs(spark)).collect()
    order = sorted(TEXTS, key=lambda x: (x[0] is not None, x[0] or 0))
    at, expected = 0, Counter()
    for i, text in order:
        ids = np.array(plain(text) + [2], "<u4")
        expected[i, at, len(ids), zlib.crc32(ids.tobytes())] += 1
        at += len(ids)
    assert Counter((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in found) == expected


def test_token_files_of_many_files(spark, plain, monkeypatch):
    """Starts follow the numbers of the parts, not the files' names, also where a part is several files."""
    monkeypatch.setitem(token_files.ORC_OPTIONS, "maxRecordsPerFile", "2")
    rows = [(k, f"text {k} " * (k % 7)) for k in range(60)]
    found = token_files.round_trip(docs(spark, rows)).collect()
    at = 0
    for row, (k, text) in zip(sorted(found, key=lambda r: r.doc_id), rows):
        assert (row.doc_id, row.start) == (k, at)
        at += len(plain(text)) + 1


def test_token_files_read_a_part(spark, tmp_path, plain):
    path = f"file://{tmp_path}/tokens"
    token_files.write_token_files(docs(spark), path)
    some = token_files.read_token_files(spark, path, F.col("doc_id") == 5)
    row = some.first()
    assert row.ids == plain("word " * 5000) + [2]
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,5)]" in some._jdf.queryExecution().toString()


@pytest.mark.parametrize("run", [packing.pack_documents, token_files.round_trip, mixing.mix])
def test_empty(spark, run):
    assert run(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_poisson():
    cdf = mixing.poisson_cdf(2.5)
    assert abs(cdf[0] - np.exp(-2.5)) < 1e-15 and cdf == sorted(cdf) and cdf[-1] > 1 - 1e-12
    assert mixing.poisson_cdf(0.0) == [1.0]
    mean = sum(1 - c for c in mixing.poisson_cdf(900.0))
    assert abs(mean - 900) < 1e-6


SOURCES = [(k, "x" * (k % 50 + 1), "hot" if k % 3 else f"s{k % 7}") for k in range(3000)] + [(9000, None, None), (9001, "a", None), (9002, "b", "clash")]


@pytest.mark.parametrize("local", [mixing.LOCAL_SOURCES, 0])
def test_mixing(spark, local):
    table = spark.createDataFrame([(*r, "x", "y") for r in SOURCES], "doc_id long, text string, source string, chars string, rate string")
    weights = {"hot": 1.0, "s0": 1.0, "s3": 2.0}
    out = mixing.mix(table, weights, epochs=2.0, keep_copy=True, local_sources=local).toPandas()
    again = mixing.mix(table, weights, epochs=2.0, keep_copy=True, local_sources=local).toPandas()
    key = ["doc_id", "copy"]
    assert out.sort_values(key).reset_index(drop=True).equals(again.sort_values(key).reset_index(drop=True))
    sizes = out.text.str.len().groupby(out.source).sum()
    total = 2 * sum(len(t or "") for _, t, _ in SOURCES)
    assert set(sizes.index) == {"hot", "s0", "s3"}
    assert abs(sizes["hot"] / total - 0.25) < 0.03 and abs(sizes["s3"] / total - 0.5) < 0.05
    assert (out.groupby("doc_id").copy.max() + 1 == out.groupby("doc_id").copy.count()).all()
    assert mixing.mix(table).columns == table.columns


def test_mixing_of_null_ids_and_repeats(spark):
    """Rows without an id draw like an empty one, and rows that repeat get as many copies each."""
    rows = [(None, f"t{k}", "a") for k in range(3)] + [(7, "same", "a")] * 4 + [(k, "x" * 9, "b") for k in range(20)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = Counter(tuple(r) for r in mixing.mix(table, epochs=3.0).collect())
    n = {found[None, f"t{k}", "a"] for k in range(3)}
    assert len(n) == 1 and found[7, "same", "a"] % 4 == 0 and set(found) <= set(rows)
