"""SimHash near-dedup: pigeonhole blocks, a join on blocks, then Hamming verification."""

from __future__ import annotations

import hashlib
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import maybe_in, release, slices, stage, utf8, without_rows
from .components import components

SHINGLE, SEED, DISTANCE = 3, 42, 2
#: First bit and width of the five blocks; two differing bits leave at least three blocks alike.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Buckets of more distinct fingerprints are linked through one-bit variants instead of pairs.
PAIRED = 32


def _hashes(data: bytes) -> np.ndarray:
    words = data.lower().split()  # bytes.lower changes A-Z only, bytes.split cuts at 0x20 and 0x09-0x0D
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    if n <= SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    shingles = map(b" ".join, zip(words, words[1:], words[2:]))
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n - SHINGLE + 1)


def simhash(data: bytes) -> int:
    """The fingerprint of a text as an unsigned number: a bit is 1 if set in over half the shingle hashes."""
    hashes = _hashes(data)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        piece = hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(piece, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprint(batches):
    for batch in slices(batches):
        prints = np.fromiter(map(simhash, utf8(batch.column("text"))), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints.view(np.int64), pa.int64())], ["doc_id", "fp"])


def _mask(blocks) -> int:
    value = sum(((1 << width) - 1) << first for first, width in blocks)
    return value - (1 << 64) if value >> 63 else value


_TABLES = [_mask(kept) for kept in combinations(BLOCKS, len(BLOCKS) - DISTANCE)]


def links(prints: DataFrame) -> DataFrame:
    """Distinct fingerprints (fp: long) -> links (a, b) whose components are those of all pairs at 2 or fewer bits.

    Each fingerprint enters ten tables, one for each choice of three blocks. Buckets of up to PAIRED fingerprints
    are joined with themselves and verified. In larger ones each fingerprint meets its one-bit variants over the
    bits that the bucket leaves free: two fingerprints at distance 2 or less share a variant, and all that share
    one are at distance 2 or less, so a star over each variant keeps every link's component at linear cost.
    """
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(_TABLES)])
    rows = prints.select("fp", F.inline(tables))
    full = stage(rows.groupBy("t", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "buckets")
    shared = stage(rows.join(full, ["t", "key"]), "shared")
    left = shared.where(F.col("size") <= PAIRED).select("t", "key", F.col("fp").alias("a"))
    right = shared.where(F.col("size") <= PAIRED).select("t", "key", F.col("fp").alias("b"))
    pairs = left.join(right, ["t", "key"]).where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE))
    flips = F.array(*[F.array(F.lit(0).cast("long"), *[F.lit(_mask([(b, 1)])) for b in range(64) if not (m >> b) & 1]) for m in _TABLES])
    variants = shared.where(F.col("size") > PAIRED).select("fp", "t", F.explode(F.element_at(flips, F.col("t") + 1)).alias("flip"))
    stars = (
        variants.groupBy("t", F.col("fp").bitwiseXOR(F.col("flip")).alias("variant"))
        .agg(F.collect_set("fp").alias("near"))  # at most 27: the variant and its flips over the free bits
        .where(F.size("near") > 1)
        .select(F.explode("near").alias("a"), F.array_min("near").alias("b"))
    )
    return pairs.select("a", "b").union(stars).where("a != b").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, fingerprint, component_id), a row for each row of docs.

    A-Z are lower-cased; words are runs of bytes other than 0x20 and 0x09-0x0D; shingles are three words joined
    by a space, repeats included (all words if fewer). A text without words, null too, has fingerprint zero and
    links like any other. component_id is the smallest doc_id reachable by links of 2 or fewer differing bits;
    null ids count only if there is no other. Equal fingerprints are one node, so copies cost nothing more.
    """
    prints = stage(docs.select("doc_id", "text").mapInArrow(_fingerprint, "doc_id long, fp long"), "simhash")
    nodes = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    roots = components(links(nodes.select("fp")))
    linked = stage(
        nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "rooted"
    )
    smallest = stage(linked.groupBy("root").agg(F.min("first").alias("component_id")), "smallest")
    by_print = stage(linked.join(smallest, "root").select("fp", "component_id"), "by_print")
    for old in (nodes, linked, smallest):
        release(old)
    return prints.join(by_print, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: The stage's rule: words in a shingle, and the least share of shingles in common, in tenths.
STAGE_SHINGLE, TENTHS = 5, 8
#: Bands of minima over random orders of the shingles, and minima in a band: texts of similarity 0.8 share none with odds of 4 in 10,000.
BANDS, ROWS = 20, 5
#: Texts that each text of a band's bucket is compared with at first, where the bucket holds over PAIRED.
LEADERS = 8
_rng = np.random.default_rng(17)
_FACTORS = _rng.integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)
_ADDED = _rng.integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(data: bytes, width: int = STAGE_SHINGLE) -> np.ndarray:
    """The distinct hashes of runs of width words (all words if fewer), sorted."""
    words = data.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = max(1, len(each) - width + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(width, len(each))):
        out = out * _MIX + each[k : k + n]
        out ^= out >> np.uint64(29)
    return np.unique(out * _MIX)


def bands(hashes: np.ndarray) -> list[int]:
    """A key for each band; none without shingles."""
    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1 << 12):
        least = np.minimum(least, (hashes[at : at + (1 << 12)] * _FACTORS + _ADDED).min(axis=1))
    keys = np.zeros(BANDS, np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        keys = (keys ^ row) * _MIX
        keys ^= keys >> np.uint64(29)
    return keys.view(np.int64).tolist()


def _sign(batches):
    for batch in slices(batches):
        texts = utf8(batch.column("text"))
        prints = np.fromiter(map(simhash, texts), np.uint64, len(texts))
        columns = [
            batch.column("doc_id"),
            pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string()),
            pa.array(prints.view(np.int64), pa.int64()),
            pa.array([bands(shingles(x)) for x in texts], pa.list_(pa.int64())),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_sha256", "fp", "bands"])


def _shingle_sets(batches):
    for batch in slices(batches):
        sets = [shingles(x).view(np.int64) for x in utf8(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("sha"), pa.array(sets, pa.list_(pa.int64()))], ["sha", "shingles"])


def _buckets(nodes: DataFrame) -> DataFrame:
    """nodes (node, bands) -> (band, key, node, size) of the buckets that hold several nodes."""
    rows = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    full = stage(rows.groupBy("band", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "band_buckets")
    return stage(rows.join(full, ["band", "key"]), "band_shared")


def _first_pairs(shared: DataFrame) -> DataFrame:
    """All pairs (a, b) of a bucket; in those of over PAIRED nodes, pairs with LEADERS of them.

    Leaders are the nodes whose buckets hold most: of a group of copies those that were changed least.
    """
    few = shared.where(F.col("size") <= PAIRED)
    pairs = few.select("band", "key", F.col("node").alias("a")).join(few.select("band", "key", F.col("node").alias("b")), ["band", "key"]).where("a < b")
    many = shared.where(F.col("size") > PAIRED)
    weighed = many.groupBy("node").agg(F.struct(F.sum("size"), -F.col("node")).alias("weight"))
    # The heaviest of each of LEADERS shares of a bucket, so that no task sorts a bucket.
    share = F.pmod(F.xxhash64("node"), F.lit(LEADERS)).alias("share")
    leaders = stage(many.join(weighed, "node").groupBy("band", "key", share).agg(F.max_by("node", "weight").alias("b")), "leaders")
    led = many.select("band", "key", F.col("node").alias("a")).join(leaders.select("band", "key", "b"), ["band", "key"]).where("a != b")
    return pairs.select("a", "b").union(led.select(F.least("a", "b"), F.greatest("a", "b"))).distinct()


def _rest_pairs(docs: DataFrame, nodes: DataFrame, shared: DataFrame, roots: DataFrame) -> DataFrame | None:
    """Pairs (a, b) of nodes of large buckets that are not linked so far, every similar pair among them; None if all are.

    Nodes outside a bucket's largest component are looked for among all nodes of such buckets: two sets of which
    TENTHS/10 is common share one of the rarest shingles of either, as many as may be missing and one more, and no more
    than either holds from the first of those on. What is rare in a node that is unlike all others is its own, so
    it meets none or few; a bucket that the leaders have made one
    component costs nothing more.
    """
    many = shared.where(F.col("size") > PAIRED).join(roots.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left")
    many = stage(many.select("band", "key", "node", F.coalesce("root", "node").alias("root")), "rooted_buckets")
    held = many.groupBy("band", "key", "root").agg(F.count(F.lit(1)).alias("n"))
    largest = held.groupBy("band", "key").agg(F.max(F.struct("n", "root"))["root"].alias("largest"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    split = many.join(stage(largest, "largest"), ["band", "key"])
    members = stage(split.groupBy("node", "root").agg(F.bool_or(F.col("root") != F.col("largest")).alias("outside")), "members")
    sets = _sets(docs, nodes, members.select("node"))
    if sets is None:
        return None
    each = sets.select("node", F.size("shingles").alias("n"), F.explode("shingles").alias("s"))
    often = stage(each.groupBy("s").agg(F.count(F.lit(1)).alias("df")), "often")
    ordered = each.join(often, "s").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "s"))).alias("l"))
    missing = F.floor(F.size("l") * F.lit(10 - TENTHS) / F.lit(10))
    rare = ordered.select("node", F.size("l").alias("n"), F.posexplode(F.slice("l", F.lit(1), (missing + 1).cast("int"))).alias("at", "x"))
    rare = rare.where("x.df > 1").select("node", "n", (F.col("n") - F.col("at")).alias("most"), "x.s").join(members, "node")
    rare = stage(rare, "rare")
    first = rare.where("outside").select("s", F.col("node").alias("a"), F.col("root").alias("ra"), F.col("n").alias("na"), F.col("most").alias("ma"))
    second = rare.select("s", F.col("node").alias("b"), F.col("root").alias("rb"), F.col("n").alias("nb"), F.col("most").alias("mb"))
    # the first shingle in common, in this order, and all after it are the most that both can share
    enough = (10 + TENTHS) * F.least("ma", "mb") >= TENTHS * (F.col("na") + F.col("nb"))
    both = first.join(second, "s").where((F.col("ra") != F.col("rb")) & enough)
    pairs = stage(both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "more_candidates")
    for old in (many, members, sets, often, rare):
        release(old)
    return pairs


def _sets(docs: DataFrame, nodes: DataFrame, ends: DataFrame) -> DataFrame | None:
    """(node, shingles) of the whole texts of ends (node); None if there are none."""
    wanted = stage(nodes.join(ends, "node").select("node", "text_sha256"), "wanted")
    n = wanted.count()
    if n == 0:
        return None
    text = F.coalesce("text", F.lit(""))
    near, maybe = maybe_in(docs.select(text.alias("text"), F.sha2(text, 256).alias("sha")), "sha", wanted, "text_sha256", n)
    sets = near.where(maybe).mapInArrow(_shingle_sets, "sha string, shingles array<long>")
    sets = sets.join(wanted, F.col("sha") == F.col("text_sha256")).groupBy("node").agg(F.any_value("shingles").alias("shingles"))  # rows of one node are equal
    sets = stage(sets, "shingles")
    release(wanted)
    return sets


def _verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs whose shingle sets, of the whole texts, have a Jaccard similarity of TENTHS/10 or more."""
    sets = _sets(docs, nodes, pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
    if sets is None:
        return pairs
    told = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b"
    )
    common = F.size(F.array_intersect("x", "y"))
    links = stage(told.where((10 + TENTHS) * common >= TENTHS * (F.size("x") + F.size("y"))).select("a", "b"), "similar")
    release(sets)
    return links


def similar(docs: DataFrame, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """docs (text), nodes (node, text_sha256, bands), links (a, b) known already -> (node, root) of all links together.

    Nodes link where TENTHS/10 or more of their distinct shingles are common. Candidates share a band; each is
    verified on the whole sets of both texts. Pairs of large buckets are compared unless other links join their ends
    or their rarest shingles rule them out.
    """
    shared = _buckets(nodes)
    first = stage(_first_pairs(shared), "candidates")
    links = stage(links.union(_verified(docs, nodes, first)), "near_links")
    release(first)
    roots = components(links)
    if shared.where(F.col("size") > PAIRED).isEmpty():
        return roots
    rest = _rest_pairs(docs, nodes, shared, roots)
    return roots if rest is None or rest.isEmpty() else components(links.union(_verified(docs, nodes, rest)))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of near copies, that of the smallest doc_id; all columns stay.

    Texts link at DISTANCE or fewer bits of their fingerprints, and where at least TENTHS/10 of their distinct
    five-word shingles are common. Fingerprint blocks cannot reach the latter, which lie 3 to 15 bits apart, so
    bands of minima find them; each is verified on the whole texts. Null ids count only if there is no other;
    of rows that repeat the id and text that stay, the one of the least common.row_order stays.
    """
    signed = stage(docs.select("doc_id", "text").mapInArrow(_sign, "doc_id long, text_sha256 string, fp long, bands array<long>"), "signed")
    texts = signed.groupBy("text_sha256").agg(F.min("doc_id").alias("first"), F.any_value("fp").alias("fp"), F.any_value("bands").alias("bands"))
    nodes = stage(texts.withColumn("node", F.monotonically_increasing_id()), "nodes")
    prints = stage(nodes.groupBy("fp").agg(F.min("node").alias("lead")), "prints")
    by_print = links(prints.select("fp"))
    bits = by_print.join(prints.select(F.col("fp").alias("a"), F.col("lead").alias("la")), "a").join(
        prints.select(F.col("fp").alias("b"), F.col("lead").alias("lb")), "b"
    )
    same = nodes.join(prints, "fp").where("node != lead").select(F.col("node").alias("a"), F.col("lead").alias("b"))
    roots = similar(docs, nodes.select("node", "text_sha256", "bands"), bits.select(F.col("la").alias("a"), F.col("lb").alias("b")).union(same))
    linked = stage(
        nodes.join(roots.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left").select(
            "text_sha256", F.struct(F.col("first").isNull(), F.col("first").alias("first"), F.col("text_sha256").alias("sha")).alias("own"), F.coalesce("root", "node").alias("root")
        ),
        "linked",
    )
    best = stage(linked.groupBy("root").agg(F.min("own").alias("best")), "best")
    counted = signed.groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("rows"))
    told = counted.join(linked.join(best, "root").select("text_sha256", "best"), "text_sha256")
    kept = F.col("doc_id").eqNullSafe(F.col("best.first")) & (F.col("text_sha256") == F.col("best.sha"))
    told = told.withColumn("kept", kept).where("not kept or rows > 1")
    return without_rows(docs, told.select("doc_id", "text_sha256", F.col("kept").alias("one")))
