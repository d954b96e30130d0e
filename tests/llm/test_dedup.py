import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from corpuscle.llm import common, exact_dedup, simhash, vector_graph
from corpuscle.llm.components import components


def frame(spark, rows):
    """Rows with a null id, and columns whose names clash with those that operators make."""
    schema = "doc_id long, text string, fp long, keep_id string, cls string, _drop string, _maybe string"
    return spark.createDataFrame([(*r, 1, "x", "x", "x", "x") for r in rows], schema)


TEXTS = [(1, "a b c d"), (2, "a b c d"), (3, None), (4, ""), (5, "A b c d"), (6, "x" * 200_000), (7, "x" * 200_000), (8, "x" * 199_999 + "y"), (9, "a b c d"), (9, "a b c d"), (None, "a b c d")]


@pytest.mark.parametrize("primes, huge", [(exact_dedup.PRIMES, exact_dedup.HUGE), ((3, 2), 1000)])
def test_exact(spark, primes, huge):
    """A weak fingerprint makes different texts collide; a low limit sends texts through parallel slices."""
    found = exact_dedup.exact_duplicates(frame(spark, TEXTS), primes, huge).collect()
    assert len(found) == len(TEXTS)
    by_text: dict = {}
    for i, t in TEXTS:
        by_text.setdefault(t or "", []).append(i)
    sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in by_text.items()}
    for row in found:
        ids = sha[row.text_sha256]
        keep = max((i for i in ids if i is not None), default=None)
        assert (row.keep_id, row.group_size, row.kept) == (keep, len(ids), row.doc_id == keep)


def test_exact_keeps_columns(spark):
    docs = frame(spark, TEXTS)
    left = exact_dedup.drop_exact_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == [4, 5, 7, 8, 9]


def test_fingerprints_combine():
    rng = random.Random(3)
    data = rng.randbytes(150_000)
    for prime in exact_dedup.PRIMES:
        whole = exact_dedup.polynomial(data, prime)
        slow = 0
        for b in data[:2000]:
            slow = (slow * exact_dedup.BASE + b) % prime
        assert exact_dedup.polynomial(data[:2000], prime) == (slow, 2000)
        cut = rng.randrange(len(data))
        assert exact_dedup.combine(exact_dedup.polynomial(data[:cut], prime), exact_dedup.polynomial(data[cut:], prime), prime) == whole


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1100)] + [(5000, k) for k in range(4000, 4500)]
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    found = {r.node: r.root for r in components(spark.createDataFrame([*links, (None, 1)], "a long, b long")).collect()}
    assert found == {x: root(x) for x in parent if root(x) != x}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def slow_simhash(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def slow_groups(ids, prints):
    parent = list(range(len(ids)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 2:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    least: dict = {}
    for i, x in enumerate(ids):
        least[root(i)] = min(least.get(root(i), x), x)
    return {x: least[root(i)] for i, x in enumerate(ids)}


def test_simhash(spark):
    rng = random.Random(2)
    vocabulary = ["Wort", "été", "the", "Ünder", "a", "日本", "x\u00a0y"]
    rows = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 2, 3, 5, 40])))) for k in range(150)]
    rows += [(500, None), (501, ""), (502, " \n\t"), (503, "Z\x0bZ\x0cz")]
    found = {r.doc_id: r for r in simhash.near_duplicates(frame(spark, rows)).collect()}
    prints = [slow_simhash(t) for _, t in rows]
    groups = slow_groups([i for i, _ in rows], prints)
    for (i, _), p in zip(rows, prints):
        assert found[i].fingerprint == f"{p:016x}"
        assert found[i].component_id == groups[i]


def test_simhash_links_in_full_buckets(spark):
    """More fingerprints alike in three blocks than are paired: linked through one-bit variants."""
    rng = random.Random(4)
    prints = sorted({rng.getrandbits(10) | (rng.getrandbits(3) << 40) for _ in range(400)} | {rng.getrandbits(64) for _ in range(50)} | {0, 1 << 63, (1 << 63) + 3})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    frame = spark.createDataFrame([(s,) for s in signed], "fp long")
    roots = {r.node: r.root for r in components(simhash.links(frame)).collect()}
    groups = slow_groups(signed, prints)
    assert {s: roots.get(s, s) for s in signed} == groups


def test_near_duplicates_keep_one(spark):
    left = simhash.drop_near_duplicates(frame(spark, [(1, "a b c d e"), (2, "A B c d e"), (3, "q r s t u v")]))
    assert sorted(r.doc_id for r in left.collect()) == [1, 3]


def test_near_duplicates_of_null_and_repeated_ids(spark):
    """A row for each row; null ids are a component's smallest only where it has no other."""
    rows = [(None, "a b c d e"), (5, "a b c d e"), (5, "a b c d e"), (None, "q r s t u v"), (None, "q r s t u v"), (4, None), (3, ""), (9, "A B C d e")]
    found = Counter((r.doc_id, r.component_id) for r in simhash.near_duplicates(frame(spark, rows)).collect())
    assert found == Counter({(None, 5): 1, (5, 5): 2, (9, 5): 1, (None, None): 2, (4, 3): 1, (3, 3): 1})


def test_vectors(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(40, 16))
    rows = np.concatenate([base, base[:20] + rng.normal(scale=0.05, size=(20, 16)), base[:1] + rng.normal(scale=0.1, size=(60, 16)), base[:5]])
    data = [(k, [float(v) for v in x], "x") for k, x in enumerate(rows)]
    odd = [(1000, None, ""), (1001, [0.0] * 16, ""), (1002, [float("nan")] * 16, ""), (1003, [None] + [1.0] * 15, ""), (1004, [], ""), (1005, [1.0, 2.0], ""), (1006, [2.0, 4.0], ""), (None, data[0][1], "")]
    found = {r.vec_id: r for r in vector_graph.near_duplicate_vectors(spark.createDataFrame(data + odd, "vec_id long, embedding array<double>, node string")).collect()}
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.95
    np.fill_diagonal(linked, False)
    reach = list(range(len(rows)))
    for _ in rows:
        reach = [min([reach[i], *(reach[j] for j in np.flatnonzero(linked[i]))]) for i in range(len(rows))]
    for k in range(len(rows)):
        assert (found[k].n_links, found[k].component_id, found[k].kept) == (linked[k].sum(), reach[k], reach[k] == k)
    for k in (1000, 1001, 1002, 1003, 1004):
        assert (found[k].n_links, found[k].component_id, found[k].kept) == (0, k, True)
    assert (found[1005].n_links, found[1006].component_id) == (1, 1005)
    assert found[None].n_links == 0


def test_vectors_over_many_graphs(spark, monkeypatch):
    """Shards dealt to several graphs and query blocks, as for very full ones."""
    for name, value in (("SHARD", 64), ("GRAPH", 90), ("QUERIES", 40)):
        monkeypatch.setattr(vector_graph, name, value)
    rng = np.random.default_rng(1)
    base = rng.normal(size=(150, 24))
    rows = np.concatenate([base, base[:60] + rng.normal(scale=0.06, size=(60, 24)), base[:1] + rng.normal(scale=0.1, size=(120, 24))])
    found = vector_graph.near_duplicate_vectors(spark.createDataFrame([(k, [float(v) for v in x]) for k, x in enumerate(rows)], "vec_id long, embedding array<double>")).toPandas().set_index("vec_id")
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    links = (unit @ unit.T >= 0.95).sum(axis=1) - 1
    assert (found.n_links.to_numpy()[np.argsort(found.index)] <= links).all()
    assert found.n_links.sum() >= 0.98 * links.sum()


@pytest.mark.parametrize("run", [lambda d: exact_dedup.exact_duplicates(d), lambda d: simhash.near_duplicates(d), lambda d: exact_dedup.drop_exact_duplicates(d), lambda d: simhash.drop_near_duplicates(d)])
def test_empty(spark, run):
    assert run(frame(spark, [])).count() == 0


def test_search_from_the_medoid_alone():
    """What a search that knows only the medoid finds, without the second chance from the link's other end."""
    rng = np.random.default_rng(3)
    base = vector_graph._unit(rng.normal(size=(3000, 32)))
    for copies in (1, 6):
        some = base[: 3000 // (copies + 1)]
        x = vector_graph._unit(np.concatenate([some, *[some + rng.normal(size=some.shape) * 0.04 for _ in range(copies)]]))
        true = x @ x.T >= 0.95
        np.fill_diagonal(true, False)
        hit = np.zeros_like(true)
        hit[vector_graph.FlatGraph(x).within(x, 0.9)] = True
        assert (hit & true).sum() >= 0.95 * true.sum() > 0


def test_index_in_cells():
    """Two levels of centroids against one: most vectors get the same nearest one."""
    rng = np.random.default_rng(4)
    fine = vector_graph._unit(rng.normal(size=(300, 8)))
    coarse = vector_graph._unit(rng.normal(size=(20, 8)))
    x = vector_graph._unit(rng.normal(size=(500, 8)))
    index = vector_graph.Index(fine, coarse, (fine @ coarse.T).argmax(axis=1))
    near = index.nearest(x, 4)
    assert ((near >= 0) & (near < 300)).all()
    best = (x @ index.fine.T).argmax(axis=1)
    assert (near[:, 0] == best).mean() > 0.9


def test_rows_grow_with_the_nodes_of_a_cluster(spark, monkeypatch):
    """A cluster over many graphs and query blocks: its links number the square of its vectors, the rows that tasks send don't."""
    for name, value in (("SHARD", 64), ("GRAPH", 400), ("QUERIES", 200), ("LISTED", 4)):
        monkeypatch.setattr(vector_graph, name, value)
    sent, stage = [], vector_graph.stage

    def kept(df, label):
        out = stage(df, label)
        if label == "found":
            sent.append(out.count())
        return out

    monkeypatch.setattr(vector_graph, "stage", kept)
    rng = np.random.default_rng(9)
    for n in (200, 800):
        base = rng.normal(size=(60, 24))
        rows = np.concatenate([base, base[:1] + rng.normal(scale=0.08, size=(n, 24))])
        found = vector_graph.near_duplicate_vectors(spark.createDataFrame([(k, [float(v) for v in x]) for k, x in enumerate(rows)], "vec_id long, embedding array<double>")).toPandas().sort_values("vec_id")
        unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
        links = (unit @ unit.T >= 0.95).sum(axis=1) - 1
        assert links.sum() > 0.8 * n * n
        assert (found.n_links.to_numpy() <= links).all() and found.n_links.sum() >= 0.99 * links.sum()
        assert set(found.component_id[found.n_links > 0]) == {0}
        assert sent[-1] < 15 * len(rows)


def test_blind_links_count_once(spark, monkeypatch):
    """Nothing is listed: every link leaves its task as a number, and those that only one end sees count for both."""
    for name, value in (("SHARD", 8), ("LISTED", 0), ("RECALL", 0), ("REQUIRED", 0)):
        monkeypatch.setattr(vector_graph, name, value)
    vectors, linked = paired_vectors(spark, 300, 0)
    found = vector_graph.near_duplicate_vectors(vectors, overlap=2).toPandas().set_index("vec_id")
    assert found.n_links.max() == 1 and found.n_links[linked].sum() > 0.8 * len(linked)


def test_audit_takes_stated_and_found(spark):
    """Ids that 100 divides are all asked; where none is linked, the found ones are; where nothing is, nothing is measured."""
    rng = np.random.default_rng(12)
    rows = rng.normal(size=(400, 16))
    rows[101] = rows[51] + 0.001
    nodes = spark.createDataFrame([(k, 1, [float(v) for v in x]) for k, x in enumerate(rows)], "node long, size long, embedding array<double>")
    counts = lambda *linked: spark.createDataFrame([(k, 1, int(k in linked)) for k in range(400)], "node long, links long, degree long")
    assert vector_graph._audit(nodes, counts(51, 101), 0.95) == (1.0, 2) and vector_graph._audit(nodes, counts(51), 0.95) == (0.5, 2)
    few = nodes.where("node not in (51, 101)")
    assert vector_graph._audit(few, counts(), 0.95) == (1.0, 0)


def test_vectors_with_centroids_in_cells(spark, monkeypatch):
    """Centroids fitted in cells, on executors, and repeated ids."""
    for name, value in (("SHARD", 16), ("ONE_LEVEL", 8), ("COARSE", 6), ("PROBES", 3), ("FIT_EACH", 4)):
        monkeypatch.setattr(vector_graph, name, value)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(300, 24))
    rows = np.concatenate([base, base[:150] + rng.normal(scale=0.06, size=(150, 24))])
    data = [(k, [float(v) for v in x]) for k, x in enumerate(rows)] + [(7, [float(v) for v in rows[7]])] * 2
    found = vector_graph.near_duplicate_vectors(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect()
    unit = np.array([x for _, x in data])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    links = (unit @ unit.T >= 0.95).sum(axis=1) - 1
    assert len(found) == len(data) and sum(r.n_links for r in found) >= 0.95 * links.sum()
    assert {r.n_links for r in found if r.vec_id == 7} == {links[7]}


def test_empty_vectors(spark):
    assert vector_graph.near_duplicate_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_drops_by_row(spark):
    """Null and repeated ids with different texts: no clean text goes, one of each group stays."""
    words = [" ".join(f"{k}w{n}" for n in range(40)) for k in range(3)]
    rows = [(None, words[0]), (3, words[0]), (None, words[1]), (5, "A"), (7, "A"), (5, words[2]), (None, "z"), (None, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    order = lambda found: sorted(found, key=str)
    expected = order([(3, words[0]), (None, words[1]), (5, words[2]), (None, "z")])
    assert order(tuple(r) for r in exact_dedup.drop_exact_duplicates(docs).collect()) == order([*expected, (7, "A")])
    assert order(tuple(r) for r in simhash.drop_near_duplicates(docs).collect()) == order([*expected, (5, "A")])


@pytest.mark.parametrize(
    "rows, exact, near",
    [
        ([(1, "a"), (1, "b"), (2, "a")], [(1, "b"), (2, "a")], [(1, "a"), (1, "b")]),
        ([(None, "a"), (None, "unique"), (2, "a")], [(2, "a"), (None, "unique")], [(2, "a"), (None, "unique")]),
        ([(1, "x"), (5, "x"), (5, "different")], [(5, "different"), (5, "x")], [(1, "x"), (5, "different")]),
        ([(2, "a"), (2, "a")], [(2, "a")], [(2, "a")]),
        ([(None, None), (None, ""), (None, None)], [(None, None)], [(None, None)]),
    ],
)
def test_drops_rows_not_ids(spark, rows, exact, near):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = [sorted(((r.doc_id, r.text or None) for r in run(docs).collect()), key=str) for run in (exact_dedup.drop_exact_duplicates, simhash.drop_near_duplicates)]
    assert found == [exact, near]


def test_repeated_row_stays_the_same(spark):
    """Rows alike in id and text but not elsewhere: the same one stays however the table is dealt."""
    docs = spark.createDataFrame([(2, "a", f"s{k}", {"k": k}) for k in range(20)], "doc_id long, text string, source string, extra map<string,int>")
    for run in (exact_dedup.drop_exact_duplicates, simhash.drop_near_duplicates):
        assert len({run(docs.repartition(n)).collect()[0].source for n in (1, 3, 7)}) == 1


def test_large_texts_of_shuffled_rows(spark):
    """Slices find their text again although no two reads of the input deal rows alike."""
    texts = [(k, f"{k % 40} " * 300) for k in range(120)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    for row in exact_dedup.exact_duplicates(docs, huge=500).collect():
        assert (row.keep_id, row.group_size) == (80 + row.doc_id % 40, 3)


def test_no_local_folder_on_a_cluster():
    class Context:
        applicationId, master = "a", "spark://host:7077"

    class Session:
        sparkContext, conf = Context(), {}

    with pytest.raises(RuntimeError):
        common.shared_dir(Session())


def test_stage_meets_all_of_a_full_bucket(spark, monkeypatch):
    """Chains of texts whose ends differ: with one leader to a bucket, the rest is still compared until all is one component."""
    monkeypatch.setattr(simhash, "PAIRED", 2)
    monkeypatch.setattr(simhash, "LEADERS", 1)
    rng, rows = random.Random(3), []
    for chain in range(3):
        words = [f"c{chain}w{n}" for n in range(200)]
        for k in range(25):
            at = 20 + 7 * k
            words[at : at + 4] = [f"n{rng.random()}" for _ in range(4)]
            rows.append((100 * chain + k, " ".join(words)))
    sets = [set(zip(*[t.split()[k:] for k in range(5)])) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        return x if parent[x] == x else root(parent[x])

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) or bin(slow_simhash(rows[i][1]) ^ slow_simhash(rows[j][1])).count("1") <= 2:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    left = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in left.collect()) == sorted(rows[i][0] for i in range(len(rows)) if root(i) == i)


def test_stage_drops_similar_texts(spark):
    """Texts of which at least 0.8 of the five-word shingles are common go, many bits apart or in one large group; others stay."""
    rng, rows = random.Random(9), []
    for k in range(30):
        words = [f"w{rng.randrange(5000)}" for _ in range(120)]
        rows.append((10 * k, " ".join(words)))
        for copy, edits in ((1, 1), (2, 2), (3, 8)):
            other = list(words)
            for at in range(edits):
                other[5 + at * 13] = f"new{rng.random()}"
            rows.append((10 * k + copy, " ".join(other)))
    words = [f"v{n}" for n in range(150)]
    rows += [(1000 + k, " ".join([*words[: k % 150], f"x{k}", *words[k % 150 + 1 :]])) for k in range(100)]

    def sets(text):
        words = text.split()
        return {tuple(words[n : n + 5]) for n in range(len(words) - 4)}

    each = {i: sets(t) for i, t in rows}
    near = [(a, b) for a in each for b in each if a < b and len(each[a] & each[b]) >= 0.8 * len(each[a] | each[b])]
    roots = {i: i for i in each}
    for _ in range(len(each)):
        before = dict(roots)
        for a, b in near:
            roots[a] = roots[b] = min(roots[a], roots[b])
        if roots == before:
            break
    left = {r.doc_id for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert left == set(roots.values())
    far = [(a, b) for a, b in near if bin(simhash.simhash(dict(rows)[a].encode()) ^ simhash.simhash(dict(rows)[b].encode())).count("1") > 2]
    assert far


def paired_vectors(spark, pairs, singles):
    """Vectors 2k and 2k + 1 link, the others with none."""
    rng = np.random.default_rng(6)
    base = rng.normal(size=(pairs, 24))
    rows = np.stack([base, base + rng.normal(scale=0.2, size=base.shape)], axis=1).reshape(-1, 24)
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    linked = (unit[::2] * unit[1::2]).sum(axis=1) >= 0.95
    rows = np.concatenate([rows, rng.normal(size=(singles, 24))])
    return spark.createDataFrame([(k, [float(v) for v in x]) for k, x in enumerate(rows)], "vec_id long, embedding array<double>"), np.flatnonzero(linked) * 2


def test_links_count_for_both_ends(spark, monkeypatch):
    """Shards that overlap little: the search of one end misses what that of the other finds."""
    for name, value in (("SHARD", 8), ("RECALL", 0), ("REQUIRED", 0)):
        monkeypatch.setattr(vector_graph, name, value)
    vectors, linked = paired_vectors(spark, 300, 0)
    found = vector_graph.near_duplicate_vectors(vectors, overlap=2).toPandas().set_index("vec_id")
    ends = np.stack([found.n_links[linked].to_numpy(), found.n_links[linked + 1].to_numpy()])
    assert (ends[0] == ends[1]).all()
    assert (ends[0] == (found.component_id[linked + 1].to_numpy() == linked)).all() and ends[0].any()


def test_audit_sees_sparse_links(spark, monkeypatch):
    """Few vectors have links: the audit goes on until it has seen some, and what misses them is no result."""
    vectors, linked = paired_vectors(spark, 20, 2000)
    nodes = vectors.select(F.col("vec_id").alias("node"), F.lit(1).cast("long").alias("size"), "embedding")
    none = spark.createDataFrame([], "node long, links long, degree long")
    assert vector_graph._audit(nodes, none, 0.95) == (0.0, 2 * len(linked))
    copies = nodes.select("node", F.lit(1000).cast("long").alias("links"), F.when(F.col("node") < 20, 1).otherwise(0).cast("long").alias("degree"))
    assert vector_graph._audit(nodes, copies, 0.95)[0] == (linked < 20).sum() / len(linked)
    for name, value in (("SHARD", 8), ("TRIES", 1), ("REQUIRED", 0.99)):
        monkeypatch.setattr(vector_graph, name, value)
    with pytest.raises(RuntimeError, match="audited"):
        vector_graph.near_duplicate_vectors(paired_vectors(spark, 300, 0)[0], overlap=1)
