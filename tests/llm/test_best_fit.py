import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corpuscle.llm import best_fit, packing, tokens
from corpuscle.llm.tokens import encoder

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [(1, "Hello world, it's ME."), (2, None), (3, ""), (4, "a  b \n c"), (5, "word " * 5000), (6, "日本 語 😀"), (6, "日本 語 😀"), (None, "no id"), (7, "<|endoftext|> is text"), (8, "x" * 30_000), (9, "İ, ǅ's 'tis 12,3")]


@pytest.fixture(scope="module")
def plain():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


PIECES = st.one_of(st.text(alphabet=" \n\tabcSTé'.,1日\x85\xa0\x1c\x01!-😀ǅͿİς̸́=Σ​", max_size=40), st.text(max_size=10), st.sampled_from(["<|endoftext|>", "it's", "'s,", "<|", "́e"]))


@given(st.lists(st.one_of(st.none(), st.lists(PIECES, max_size=4).map("".join)), max_size=6))
@settings(max_examples=300, deadline=None)
def test_word_encoder(texts):
    """Against the library itself: contractions, marks, letters that grow in lower case, combining marks, special tokens' strings."""
    library = encoder(PATH).tokenizer
    ids, sizes = encoder(PATH).column(pa.array(texts, pa.string()))
    expected = [library.encode(x or "", add_special_tokens=False).ids for x in texts]
    assert sizes.tolist() == [len(x) for x in expected]
    assert ids.tolist() == [i for x in expected for i in x]
    assert [encoder(PATH).encode(x or "").tolist() for x in texts] == expected


def test_word_encoder_cuts_long_texts(plain, monkeypatch):
    monkeypatch.setattr(tokens, "PART", 50)
    rng = np.random.default_rng(2)
    for alphabet in (list("ab .,\n1'sS"), list("日本。, 1ab_é")):
        text = "".join(rng.choice(alphabet, 3000))
        assert encoder(PATH).column(pa.array([text, "short"]))[0].tolist() == plain(text) + plain("short")


def one_by_one(histogram: dict[int, int], size: int) -> Counter:
    """Remaining capacities when each item goes into the fullest bin that takes it."""
    bins: list[int] = []
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            fit = [(left, k) for k, left in enumerate(bins) if left >= length]
            if fit:
                bins[min(fit)[1]] -= length
            else:
                bins.append(size - length)
    return Counter(bins)


@given(st.integers(1, 64).flatmap(lambda size: st.tuples(st.just(size), st.dictionaries(st.integers(1, size), st.integers(1, 30), min_size=1, max_size=12))))
@settings(max_examples=300, deadline=None)
def test_best_fit_decreasing(case):
    size, histogram = case
    placed, left = Counter(), Counter()
    for lengths, count in best_fit.best_fit_decreasing(histogram, size):
        assert count > 0
        left[size - sum(lengths)] += count
        for length in lengths:
            placed[length] += count
    assert placed == histogram and left == one_by_one(histogram, size)


@given(st.lists(st.tuples(st.integers(0, 40), st.booleans()), max_size=60))
def test_tightest(changes):
    tree, there = best_fit.Capacities(40), set()
    for capacity, present in changes:
        tree.put(capacity, present)
        (there.add if present else there.discard)(capacity)
        assert [tree.tightest(k) for k in range(41)] == [min((c for c in there if c >= k), default=None) for k in range(41)]


#: Histograms of short pieces and a bound on the sequences of 1024 that they need when pieces stay whole.
SHORT = [({15: 1000}, 15), ({100: 1_000_000}, 100_000), ({300: 1_000_000, 700: 1000}, 334_000)]


@pytest.mark.parametrize("histogram, best", SHORT)
def test_equal_lengths_share_sequences(histogram, best):
    assert sum(c for _, c in packing.shortest_pack_first(histogram, 1024)) <= 1.02 * best


@pytest.mark.parametrize("draw", [lambda r: r.integers(20, 61, 100_000), lambda r: np.clip(r.lognormal(4, 0.5, 100_000).astype(int) + 1, 1, 1024)])
def test_short_documents_fill_sequences(draw):
    histogram = Counter(draw(np.random.default_rng(0)).tolist())
    for size, pack in ((1024, packing.shortest_pack_first), (2048, best_fit.best_fit_decreasing)):
        best = -(-sum(k * n for k, n in histogram.items()) // size)
        patterns = pack(histogram, size)
        assert sum(c for _, c in patterns) <= 1.02 * best
        assert histogram == sum((Counter({k: v * c for k, v in Counter(lengths).items()}) for lengths, c in patterns), Counter())


def test_pack_best_fit(spark, plain):
    rows = spark.createDataFrame([(*r, "x", 1) for r in TEXTS + [(100 + k, "two words") for k in range(500)]], "doc_id long, text string, piece string, length int")
    found = [r.asDict() for r in best_fit.pack_best_fit(rows, with_ids=True).collect()]
    by_sequence: dict = {}
    for r in found:
        by_sequence.setdefault(r["sequence_id"], []).append(r)
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] and r["start"] == 2048 * r["piece"]
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    histogram: Counter = Counter()
    for (i, text), copies in Counter(TEXTS).items():
        ids = plain(text) + [0]
        whole = np.array(ids, "<u4").tobytes()
        starts = range(0, len(ids), 2048)
        assert Counter((r["start"], r["ids"]) for r in found if r["doc_id"] == i) == Counter({(a, whole[4 * a : 4 * a + 8192]): copies for a in starts})
        for a in starts:
            histogram[min(2048, len(ids) - a)] += copies
    histogram[len(plain("two words")) + 1] += 500
    assert len(by_sequence) == sum(one_by_one(histogram, 2048).values())


def test_pack_best_fit_of_nothing(spark):
    assert best_fit.pack_best_fit(spark.createDataFrame([], "doc_id long, text string")).collect() == []
