"""Steps whose memory, shuffles or time grew faster than the input."""

import math
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpuscle.operators import similarity, stats, windows


class Sent:
    def __init__(self, words):
        self.value = windows.Listed(pa.array(words, pa.large_string()))


def test_listed_words_are_compared_where_hashes_are_equal(monkeypatch):
    monkeypatch.setattr(windows.Listed, "_hashes", staticmethod(lambda words: pa.compute.binary_length(words).to_numpy(zero_copy_only=False).astype("uint64")))
    listed = windows.Listed(pa.array(["aa", "b", "cc", "", "dd"], pa.large_string()))
    words = ["dd", "xx", "aa", "", "cc", "yyy", "b", "z"]
    found = [listed.words[int(n)].as_py() if n >= 0 else None for n in listed.numbers(pa.array(words, pa.large_string()))]
    assert found == ["dd", None, "aa", "", "cc", None, "b", None]


def test_pairs_leave_tasks_as_numbers_in_small_batches(monkeypatch):
    monkeypatch.setattr(windows, "ROWS_OUT", 7)
    words = Sent([f"w{k}" for k in range(40)])
    batch = pa.RecordBatch.from_arrays([pa.array([" ".join(f"w{k * j % 41}" for k in range(200)) for j in range(5)])], ["text"])
    made = list(windows._count_near(range(-3, 3), 64, words, words, True, -1, (), False, False)([batch]))
    assert len(made) > 1 and all(len(b) <= 7 and pa.types.is_int32(b.schema.field("a").type) for b in made)


@pytest.mark.parametrize("limit", [0, 3, 1000])
def test_windows_count_alike_with_lists_and_without(spark, monkeypatch, limit):
    texts = ["a b  a c\td a e", "b\na b", "", None, "e d c b a " * 3]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    heads, known = (spark.createDataFrame([(w,) for w in x], "word string") for x in ("ab", "abcde"))
    monkeypatch.setattr(windows, "LISTED_WORDS", limit)
    found = windows.near_counts(docs, heads, known, [-2, -1, 1, 2], at_once=9, min_doc_len=2, once=True, alone=True, stop=("e",))
    want = {}
    for text in texts:
        w = [x for x in (text or "").split() if x != "e"] if len((text or "").split()) > 2 else []
        for i, head in enumerate(w):
            if head in "ab":
                want.setdefault((head, None), 0)
                for other in {w[j] for j in range(max(0, i - 2), min(len(w), i + 3)) if j != i}:
                    want[head, other] = want.get((head, other), 0) + 1
    assert {(r.word, r.word2): r.cnt for r in found.collect()} == want


@pytest.mark.parametrize("listed", [4, 1000])
def test_pairs_are_counted_in_passes(spark, monkeypatch, listed):
    """The disk holds the sums of one pass at a time; long lists are sent in parts, and pairs stay numbers."""
    texts = [" ".join(f"w{k * j % 11}" for k in range(40)) for j in range(1, 9)] + [None, "", "w1  w2", "w1 w2 w1"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    key = lambda df: sorted((r.word, r.word2, r.cooc, r.docs) for r in df.collect())
    want, written, stage = key(windows.cooccurrence(docs, 6, 2, 2)), [], windows.stage

    def kept(df, label, free=False):
        made = stage(df, label, free)
        written.append((label, free, dict(made.dtypes), made.count()))
        return made

    monkeypatch.setattr(windows, "stage", kept)
    monkeypatch.setattr(windows, "PASS_BYTES", 1)
    monkeypatch.setattr(windows, "LISTED_WORDS", listed)
    assert key(windows.cooccurrence(docs, 6, 2, 2)) == want != []
    passes = [x for x in written if x[0] == "counts"]
    assert len(passes) >= 6 and all(x[1] and x[2]["a"] == x[2]["b"] == "int" for x in passes)
    assert sum(x[3] for x in passes) == len(want) and max(x[3] for x in passes) < len(want) / 2


def test_a_stage_frees_its_shuffles(spark):
    from corpuscle.sources import staging

    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {str(manager.getAllFiles().apply(k)) for k in range(manager.getAllFiles().size())}
    before, setting = files(), spark.conf.get(staging._CLEANUP, None)
    rows = staging.stage(spark.range(1000).repartition("id").groupBy("id").count(), "rows", free=True)
    for _ in range(50):
        left = files() - before
        if not left:
            break
        time.sleep(0.2)
    assert not left and rows.count() == 1000 and spark.conf.get(staging._CLEANUP, None) == setting


@pytest.mark.parametrize("listed", [2, 1000])
def test_pmi_shuffles_no_pairs(spark, monkeypatch, listed):
    rows = [(a, b, 2 + len(a) * k, 2) for k, (a, b) in enumerate((x, y) for x in ("a", "bb", "c", "dd", "e") for y in ("a", "bb", "c", "dd", "e", "f") if x != y)] + [(None, "a", 3, 2), ("a", None, 3, 2)]
    pairs = spark.createDataFrame(rows, "word string, word2 string, cooc long, docs long")
    monkeypatch.setattr(windows, "LISTED_WORDS", listed)
    found = windows.pmi(pairs)
    f = {}
    for a, _, n, _ in rows:
        f[a] = f.get(a, 0) + n
    want = {(a, b): round(math.log(n * sum(f.values()) / (f[a] * f[b])), 9) for a, b, n, _ in rows if a and b in f and b}
    assert {(r.word, r.word2): round(r.pmi, 9) for r in found.collect()} == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "HashJoin" not in plan and "SortMergeJoin" not in plan


def test_contextual_similarity_meets_heads_by_sets(spark, monkeypatch):
    """Pairs of target and feature are not listed again for each head: forty heads hold the same features."""
    docs = spark.createDataFrame([("t " + " ".join(f"f{k}" for k in range(j, j + 8)),) for j in range(20)], "text string")
    heads = spark.createDataFrame([(f"h{h}", f"f{k}") for h in range(40) for k in range(28)], "head string, feature string")
    stats = spark.createDataFrame([("t", 20), *((f"f{k}", 5) for k in range(28))], "word string, df long")
    sizes, stage = {}, similarity.stage

    def kept(df, label):
        made = stage(df, label)
        sizes[label] = made.count()
        return made

    monkeypatch.setattr(similarity, "stage", kept)
    found = similarity.contextual_similarity(docs, heads, stats, 10, 1, 5, 20).collect()
    assert sizes["sums"] == 1 and len(found) == 40
    assert {(r.jt, r.jb, r.jacc) for r in found} == {(160, 160, 1.0)}


@pytest.mark.parametrize("masked, listed", [(62, 1000), (0, 1000), (62, 9)])
def test_contextual_similarity_sums_by_head_in_tasks(spark, monkeypatch, masked, listed):
    """What leaves tasks grows with targets and heads, however many sets of heads the features have."""
    texts = [" ".join(f"f{(j * k + k) % 16}" if k % 3 else f"t{k % 2}" for k in range(30)) for j in range(9)] + [None, "t0", "t3 " * 3]
    held = {h: {f"f{k}" for k in range(16) if k >> h & 1} | {"t1"} for h in range(4)}
    df = {f"f{k}": k + 1 for k in range(16)} | {"t0": 9, "t1": 9, "t3": 30}
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    heads = spark.createDataFrame([(f"h{h}", f) for h in held for f in held[h]] + [(None, "f1"), ("h1", None), ("h0", "f1")], "head string, feature string")
    stats_ = spark.createDataFrame([*df.items(), (None, 99)], "word string, df long")
    sizes, stage = {}, similarity.stage
    monkeypatch.setattr(similarity, "stage", lambda df, label: (made := stage(df, label), sizes.update({label: made.count()}))[0])
    monkeypatch.setattr(similarity, "MASKED_HEADS", masked)
    monkeypatch.setattr(windows, "LISTED_WORDS", listed)
    found = similarity.contextual_similarity(docs, heads, stats_, 4, 2, 3, 9, ("f9",)).collect()
    sums = {}
    for text in texts:
        w = (text or "").split()
        for i, target in enumerate(w if len(w) > 2 else []):
            if df[target] >= 9 and target != "f9":
                near = {w[j] for j in range(max(0, i - 4), min(len(w), i + 4)) if j != i and df[w[j]] >= 3}
                for h in held:
                    n = sums.setdefault((f"h{h}", target), [0, 0, 0.0, 0.0])
                    for k, part in ((0, near & held[h]), (1, near)):
                        n[k], n[k + 2] = n[k] + len(part), n[k + 2] + sum(1 / df[f] for f in part)
    assert {(r.head, r.target): (r.jt, r.jb, round(r.wt, 9), round(r.wb, 9)) for r in found} == {k: (*v[:2], *(round(x, 9) for x in v[2:])) for k, v in sums.items()}
    if masked:
        assert sizes["sums"] <= len({t for _, t in sums}) * (len(held) + 1)


@pytest.mark.parametrize("metric", ["jaccard", "tf_weighted_jaccard", "tfidf_weighted_jaccard", "ttest_weighted_jaccard"])
def test_few_heads_score_as_many_do(spark, monkeypatch, metric):
    rows = [(f"h{k % 5}", f"f{k % 7 * (k % 3)}", k % 4 + 1) for k in range(60)] + [("h9", "alone", 1), ("h8", None, 2), (None, "f0", 1)]
    table = spark.createDataFrame(rows, "head string, feature string, cnt long").dropDuplicates(["head", "feature"])
    key = lambda df: sorted((r.head, r.target, None if r.score is None else round(r.score, 9)) for r in df.collect())
    found, best = key(similarity.METRICS[metric](table)), key(similarity.similar_words(table, metric, k=2))
    monkeypatch.setattr(similarity, "FEW_HEADS", 0)
    assert found == key(similarity.METRICS[metric](table)) and best == key(similarity.similar_words(table, metric, k=2))


def test_few_heads_are_dealt_by_feature_once(spark):
    table = spark.createDataFrame([("a", "x", 1), ("b", "x", 2)], "head string, feature string, cnt long")
    plan = similarity._few_tops(similarity.weight_ttest(table, few=True))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(feature") == 1 and "SortMergeJoin" not in plan


def test_ngram_bags_shuffle_no_windows(spark, monkeypatch):
    rows = [("t", "a b a c a b"), ("u", "x a\n a  b"), ("v", None), ("w", "a b"), ("s", "a b c d"), ("s", "b b c d"), (None, "a a c"), (None, "a b c")]
    docs, known = spark.createDataFrame(rows, "title string, text string"), spark.createDataFrame([("a",), ("b",)], "word string")
    found = [sorted(map(tuple, stats.ngram_bags(docs, 2, known, 1, at_once=n).collect())) for n in (1, 5, 1 << 20)]
    assert found[0] == found[1] == found[2] == sorted(map(tuple, stats._shuffled_ngram_bags(docs, 2, known, 1).collect())) != []
    own = docs.where("title in ('t', 'u', 'v', 'w')")
    assert "Exchange" not in stats.ngram_bags(own, 2, known, 1)._jdf.queryExecution().executedPlan().toString()


def test_word_groups_split_a_text_once(spark, sf_dir):
    from corpuscle.plans.readers import word_groups

    plan = word_groups(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" in plan and not any("split(" in line for line in plan.splitlines() if "Generate" in line)


def test_redirects_travel_as_numbers(spark, monkeypatch):
    from corpuscle.operators import graph

    seen, stage = [], graph.stage
    monkeypatch.setattr(graph, "stage", lambda df, label: seen.append((label, dict(df.dtypes))) or stage(df, label))
    rows = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "x")], "src string, dst string")
    assert {tuple(r) for r in graph.resolve_redirects(rows).collect()} == {("a", "d", 3), ("b", "d", 2), ("c", "d", 1), ("x", None, None)}
    hops = [types for label, types in seen if label == "hops"]
    assert len(hops) > 1 and all(set(t.values()) == {"bigint"} for t in hops)
