"""A hierarchical Pitman-Yor language model over all words: seating sampled by Gibbs, no word or context left out.

Restaurants. Every word and the end of a text is a context with a restaurant of its own; all contexts share the root
as parent, whose base is uniform over the vocabulary and one unknown word. A dish eaten once in a context has one
table there, so only pairs (context, word) that occur twice or more have a seating to sample. They are a table of the
cluster's; tables of a context and customers of the root follow from it and the words' counts, since all else has as
many tables as customers. A round of Gibbs draws each pair's number of tables given all others' of the round before;
the root's own tables, and in the last round the pairs', are conditional means in place of a draw.

What each task holds is bounded for any corpus: the most frequent words and pairs, at most 1 / LOCAL_SHARE of each;
they alone can be frequent enough to fill a part. All others meet by shuffles: tokens with the pairs and rare contexts in parts by context
and word (no such pair is frequent) or by rare context, then rare words with their share of the root by a join.
"""

from __future__ import annotations

import gc
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, release, slices, stage, utf8

#: Share that made a word a context while the model had classes; nothing is cut by it any more.
CLASS_SHARE = 5e-4
#: What is known of the most frequent words and pairs goes to every task instead of being shuffled: at most 1 / LOCAL_SHARE, 500,000 of each.
LOCAL_SHARE = 2e-6
DISCOUNT, STRENGTH = 0.75, 1.0
#: Gibbs sweeps, and how many of the last are averaged.
SWEEPS, AVERAGED = 12, 6
#: Rounds in which pairs are seated; each sees the tables of all others as the round before left them.
ROUNDS = 3
#: Dishes of up to so many customers are seated by their exact conditional; larger ones in blocks of customers.
ONE_BY_ONE = 64
#: Tokens that a task works on at a time; tokens of a part.
BLOCK, PART = 1 << 19, 2_500_000
CACHED = 600_000
SEED = 11
#: The end of a text, hashed like a word that no text can hold.
END = xxhash.xxh64_intdigest(b"\x20end\x20")
#: Kinds of packed rows: tokens, seats of pairs, rare contexts, documents.
TOKENS, SEATS, CONTEXTS, DOCUMENTS = range(4)


def held_out(doc_id: Column) -> Column:
    """Rows that the model doesn't learn from: crc32 of the id as text, modulo 7, is 2. A null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


class _Numbers(dict):
    """Numbers words as they are met; hashes holds their 64-bit hashes."""

    def __init__(self) -> None:
        self.restart()

    def restart(self) -> None:
        self.clear()
        self.hashes = np.zeros(1 << 12, np.int64)

    def __missing__(self, word: bytes) -> int:
        n = len(self)
        if n == len(self.hashes):
            self.hashes = np.concatenate([self.hashes, np.zeros_like(self.hashes)])
        self.hashes[n] = _signed(xxhash.xxh64_intdigest(word))
        self[word] = n
        return n

    def of(self, data: bytes) -> np.ndarray:
        """The hashes of a text's words, A-Z in lower case, then that of the end."""
        words = data.lower().split()  # bytes.split cuts at 0x20 and 0x09-0x0D, bytes.lower changes A-Z only
        if len(self) > CACHED:
            self.restart()
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return np.append(self.hashes[at], _signed(END))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


_numbers = _Numbers()


#: Values sorted at once, and distinct values held, before a task sends on what it has counted.
SORTED, HELD = 1 << 20, 1 << 21


def _tallies(arrays: Iterable[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct values and their counts; a value comes again if what lies between would not fit in memory."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    waiting: list[np.ndarray] = []
    total = 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        values, back = np.unique(np.concatenate([v for v, _ in held]), return_inverse=True)
        return values, np.bincount(back, weights=np.concatenate([c for _, c in held]), minlength=len(values)).astype(np.int64)

    def settle() -> None:
        nonlocal total
        if waiting:
            held.append(np.unique(np.concatenate(waiting), return_counts=True))
            waiting.clear()
            total = 0

    for x in arrays:
        waiting.append(x)
        total += len(x)
        if total >= SORTED:
            settle()
            if sum(len(v) for v, _ in held) > HELD:
                held[:] = [merged()]
                if len(held[0][0]) > HELD // 2:
                    yield held.pop()
    settle()
    if held:
        yield merged()


def _count_words(batches):
    for hashes, counts in _tallies(_numbers.of(x) for batch in slices(batches) for x in utf8(batch.column("text"))):
        yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(counts)], ["h", "c"])


def word_counts(training: DataFrame) -> DataFrame:
    """(h, c): the 64-bit hash of each distinct token of training (text) and its count, the end included."""
    rows = training.select("text").mapInArrow(_count_words, "h long, c long")
    return rows.groupBy("h").agg(F.sum("c").alias("c"))


def _find(hashes: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Where each hash stands in the sorted keys; len(keys) if it doesn't."""
    if not len(keys):
        return np.zeros(len(hashes), np.int64)
    at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
    return np.where(keys[at] == hashes, at, len(keys))


def _mixed(u: np.ndarray, z: np.ndarray | int) -> np.ndarray:
    """A 64-bit hash of each pair; for one u, no two z share one."""
    x = u.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x += z.view(np.uint64) if isinstance(z, np.ndarray) else np.uint64(z)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x.view(np.int64)


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.RecordBatch]]:
    """Texts in blocks: the hash of each number, the number of each token and of the one before it, where texts begin, and their rows."""
    texts, rows, total = [], [], 0

    def block():
        z = np.concatenate(texts)
        starts = np.cumsum([0, *map(len, texts[:-1])])
        u = np.roll(z, 1)
        u[starts] = _numbers[b" end "]  # no word holds a blank; its hash is END
        return _numbers.hashes[: len(_numbers)].copy(), z, u, starts, pa.concat_batches(rows)

    for batch in slices(batches):
        others = batch.select([x for x in batch.schema.names if x != "text"])
        for at, data in enumerate(utf8(batch.column("text"))):
            if texts and (total >= BLOCK or len(_numbers) > CACHED):
                yield block()
                texts.clear(), rows.clear()
                total = 0
                give_back()
            if not texts and len(_numbers) > CACHED:
                _numbers.restart()
            words = data.lower().split()
            words.append(b" end ")
            texts.append(np.fromiter(map(_numbers.__getitem__, words), np.int64, len(words)))
            rows.append(others.slice(at, 1))
            total += len(words)
    if texts:
        yield block()


class _Places:
    """Places of numbered words among the keys, len(keys) if there is none: searched once for each word while it keeps its number."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys, self.hashes, self.at = keys, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __call__(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each word's place, and its place or else its hash (which is as small as a place with a chance of 1 in 10**13)."""
        n = len(self.hashes)
        if n > len(hashes) or (hashes[:n] != self.hashes).any():
            n = 0
        self.at = np.concatenate([self.at[:n], _find(hashes[n:], self.keys)])
        self.hashes = hashes
        return self.at, np.where(self.at < len(self.keys), self.at, hashes)


def _is_local(ids: np.ndarray, keys: int) -> np.ndarray:
    return (ids >= 0) & (ids < keys)


def _part_of(u: np.ndarray, mixed: np.ndarray, keys: int, parts: int) -> np.ndarray:
    """Pairs of a frequent context are dealt by both words; all of a rare context's come to one part."""
    x = np.where(_is_local(u, keys), mixed, _mixed(u, 0)).view(np.uint64)
    return ((x >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)


_PACKED = "part int, kind int, n int, data binary"


def _deal(kind: int, part: np.ndarray, columns: list[np.ndarray], parts: int) -> Iterator[pa.RecordBatch]:
    """A row for each part with its rows of the columns (64 bits each), packed byte by byte."""
    if not len(part):
        return
    codec = pa.Codec("zstd", compression_level=1)
    order = np.argsort(part.astype(np.uint16) if parts <= 1 << 16 else part, kind="stable")
    columns = [x.view(np.int64)[order] for x in columns]
    ends = np.cumsum(np.bincount(part, minlength=parts))
    found, sizes, data, held = [], [], [], 0

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array([kind] * len(found), pa.int32()), pa.array(sizes, pa.int32()), pa.array(data, pa.binary())], ["part", "kind", "n", "data"])

    for k in np.flatnonzero(np.diff(ends, prepend=0)):
        rows = slice(ends[k - 1] if k else 0, ends[k])
        raw = b"".join(np.ascontiguousarray(x[rows].view(np.uint8).reshape(-1, 8).T).tobytes() for x in columns)
        found.append(k)
        sizes.append(rows.stop - rows.start)
        data.append(codec.compress(raw, asbytes=True))
        held += len(data[-1])
        if held > 2 << 20:
            yield batch()
            found, sizes, data, held = [], [], [], 0
    if found:
        yield batch()


def _opened(batches: Iterable[pa.RecordBatch], width: dict[int, int]) -> dict[int, list[np.ndarray]]:
    """The columns of each kind of packed rows, which are width[kind]."""
    codec = pa.Codec("zstd")
    found: dict[int, list[np.ndarray]] = {kind: [] for kind in width}
    for batch in batches:
        for kind, n, data in zip(*(batch.column(x).to_pylist() for x in ("kind", "n", "data"))):
            raw = np.frombuffer(codec.decompress(data, n * 8 * width[kind], asbytes=True), np.uint8)
            found[kind].append(np.ascontiguousarray(raw.reshape(width[kind], 8, n).transpose(0, 2, 1)).view(np.int64)[:, :, 0])
    return {kind: list(np.concatenate(x, axis=1)) if x else [np.zeros(0, np.int64)] * width[kind] for kind, x in found.items()}


def _deal_pairs(keys: np.ndarray, parts: int):
    def run(batches):
        places = _Places(keys)
        for hashes, z, u, _, _ in _blocks(batches):
            pairs, counts = np.unique(u << 32 | z, return_counts=True)
            _, ids = places(hashes)
            u, z = ids[pairs >> 32], ids[pairs & 0xFFFFFFFF]
            yield from _deal(TOKENS, _part_of(u, _mixed(u, z), len(keys), parts), [u, z, counts], parts)

    return run


def _merge_pairs(batches):
    """Pairs of a part that occur at least twice."""
    u, z, c = _opened(batches, {TOKENS: 3})[TOKENS]
    mixed = _mixed(u, z)
    order = np.argsort(mixed)
    starts = np.flatnonzero(np.diff(mixed[order], prepend=~mixed[order[:1]]))
    counts = np.add.reduceat(c[order], starts) if len(starts) else c
    first = order[starts]
    kept = counts > 1
    for at in range(0, len(u := u[first][kept]), 1 << 16):
        rows = slice(at, at + (1 << 16))
        yield pa.RecordBatch.from_arrays([pa.array(x[rows]) for x in (u, z[first][kept], counts[kept])], ["u", "z", "c"])
    del mixed, order, first, u, z, c
    give_back()


def _log_stirling(n: int, d: float) -> np.ndarray:
    """log of the generalised Stirling numbers: ways to seat c customers at t tables, weighted as the process does."""
    out = np.full((n + 1, n + 1), -np.inf)
    out[1, 1] = 0.0
    for c in range(1, n):
        t = np.arange(1, c + 2)
        with np.errstate(divide="ignore"):
            stay = np.log(np.maximum(c - t * d, 1e-300)) + out[c, 1 : c + 2]
        out[c + 1, 1 : c + 2] = np.logaddexp(out[c, : c + 1], stay)
    return out


_STIRLING = _log_stirling(ONE_BY_ONE, DISCOUNT)


def tables_of(c: np.ndarray, alpha: np.ndarray, draw: np.ndarray | None = None) -> np.ndarray:
    """Tables of dishes of c customers given alpha = (strength + d T) * base: drawn by the numbers in draw (0 to 1), or their means."""
    t = np.minimum(c, 1).astype(np.float64)
    order = np.argsort(c, kind="stable")
    bounds = np.searchsorted(c[order], np.arange(2, ONE_BY_ONE + 2))
    for n, start, end in zip(range(2, ONE_BY_ONE + 1), bounds, bounds[1:]):
        if start == end:
            continue
        rows, steps = order[start:end], np.arange(1.0, n + 1)
        w = _STIRLING[n, 1 : n + 1] + np.log(alpha[rows])[:, None] * steps
        w = np.exp(w - w.max(axis=1, keepdims=True))
        if draw is None:
            t[rows] = w @ steps / w.sum(axis=1)
        else:
            w = np.cumsum(w, axis=1)
            t[rows] = 1 + (w[:, :-1] < (draw[rows] * w[:, -1])[:, None]).sum(axis=1)
    rows = order[bounds[-1] :]
    if len(rows):
        t[rows] = _mean_blocks(c[rows].astype(np.float64), alpha[rows])
    return t


def _mean_blocks(c: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    """Mean tables of dishes whose c customers come one after another, in blocks that grow with those seated."""
    t, seated = np.ones(len(c)), np.ones(len(c))
    while (seated < c).any():
        block = np.minimum(np.maximum(1, seated // 8), c - seated)
        t += block * alpha / (alpha + np.maximum(seated - DISCOUNT * t, 1e-9))
        t = np.minimum(t, c)
        seated += block
    return t


class Root:
    """P(word) in the root, as a function of the tables m that serve it, from how many words have each m."""

    def __init__(self, m: np.ndarray, words: np.ndarray, vocabulary: int) -> None:
        top = max(2.0, float(m.max(initial=0)))
        self.grid = np.unique(np.concatenate([np.arange(0, ONE_BY_ONE + 1), np.round(np.geomspace(ONE_BY_ONE + 1, max(top, ONE_BY_ONE + 2), 400))]))
        self.customers, self.tables, total = float((m * words).sum()), np.minimum(self.grid, 1.0), float(words.sum())
        for _ in range(SWEEPS):
            self.new = (STRENGTH + DISCOUNT * total) / (vocabulary + 1)
            self.tables = tables_of(self.grid.astype(np.int64), np.full(len(self.grid), self.new))
            total = float((np.interp(m, self.grid, self.tables) * words).sum())
        self.new = (STRENGTH + DISCOUNT * total) / (vocabulary + 1)

    def __call__(self, m: np.ndarray) -> np.ndarray:
        return (np.maximum(m - DISCOUNT * np.interp(m, self.grid, self.tables), 0) + self.new) / (STRENGTH + self.customers)


def _seat_pairs(keys: np.ndarray, tables: np.ndarray, base: np.ndarray, root: Root, drawn: int | None):
    """(u, z, c, tables, served) -> the same pairs with their tables t: the two last are null where a word is frequent.

    What is drawn follows from the words' hashes, so that it is the same however rows are dealt and however often a task runs.
    """

    def run(batches):
        for batch in batches:
            u, z, c = (batch.column(x).to_numpy() for x in ("u", "z", "c"))
            of_u, of_z = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("tables", "served"))
            mine, at = _is_local(u, len(keys)), np.where(_is_local(u, len(keys)), u, 0)
            t, hash_u = np.where(mine, tables[at], of_u), np.where(mine, keys[at], u)
            mine, at = _is_local(z, len(keys)), np.where(_is_local(z, len(keys)), z, 0)
            p, hash_z = np.where(mine, base[at], root(of_z)), np.where(mine, keys[at], z)
            alpha = (STRENGTH + DISCOUNT * t) * p
            draw = None if drawn is None else (_mixed(_mixed(hash_u, hash_z), drawn + 1).view(np.uint64) >> np.uint64(11)) * 2.0**-53
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("z"), batch.column("c"), pa.array(tables_of(c, alpha, draw))], ["u", "z", "c", "t"])

    return run


def _saved(batches):
    """(w, as_context, as_word): what a word's pairs have of customers over tables, in sums over many rows."""
    held: list[tuple[np.ndarray, ...]] = []

    def merged():
        u, z, saved = (np.concatenate(x) for x in zip(*held))
        words, back = np.unique(np.concatenate([u, z]), return_inverse=True)
        sums = [np.bincount(x, weights=saved, minlength=len(words)) for x in (back[: len(u)], back[len(u) :])]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(words), *map(pa.array, sums)], ["w", "as_context", "as_word"])

    for batch in batches:
        u, z, c, t = (batch.column(x).to_numpy() for x in ("u", "z", "c", "t"))
        held.append((u, z, c - t))
        if sum(len(x[0]) for x in held) > SORTED:
            yield merged()
    if held:
        yield merged()


def _seat_blocks(c: np.ndarray, alpha: np.ndarray, d: float, rng) -> np.ndarray:
    """Tables of dishes whose c customers come one after another, in blocks that grow with those seated."""
    t = np.ones(len(c))
    seated = np.ones(len(c))
    while True:
        block = np.minimum(np.maximum(1, seated // 8), c - seated)
        if not (block > 0).any():
            return t
        p = alpha / (alpha + np.maximum(seated - d * t, 1e-9))
        t += rng.binomial(block.astype(np.int64), np.clip(p, 0, 1))
        t = np.minimum(t, c)
        seated += block


class Seating:
    """Tables of many dishes, each with c customers; sweep() reseats them given alpha = (strength + d T) * base."""

    def __init__(self, c: np.ndarray, alpha: np.ndarray, d: float, rng) -> None:
        self.c, self.d, self.rng = c.astype(np.int64), d, rng
        self.small = np.flatnonzero((self.c > 1) & (self.c <= ONE_BY_ONE))
        self.large = np.flatnonzero(self.c > ONE_BY_ONE)
        self.tables = np.zeros((len(self.small), 8), np.int64)
        self.tables[:, 0] = self.c[self.small]
        self.t = np.ones(len(c))
        self.sweep(alpha)

    def sweep(self, alpha: np.ndarray) -> np.ndarray:
        if len(self.large):
            self.t[self.large] = _seat_blocks(self.c[self.large], alpha[self.large], self.d, self.rng)
        if len(self.small):
            c, a = self.c[self.small], alpha[self.small]
            for step in range(ONE_BY_ONE):
                if not (mine := np.flatnonzero(c > step)).size:
                    break
                self._reseat(mine, c[mine], a[mine])
            self.t[self.small] = (self.tables > 0).sum(axis=1)
        return self.t

    def _reseat(self, rows: np.ndarray, c: np.ndarray, alpha: np.ndarray) -> None:
        """One Gibbs step for each row: a customer leaves and sits down given all others."""
        if (self.tables[:, -1] > 0).any():
            self.tables = np.concatenate([self.tables, np.zeros_like(self.tables)], axis=1)
        own = self.tables[rows]
        at = np.arange(len(rows))
        leaves = (np.cumsum(own, axis=1) > (self.rng.random(len(rows)) * c)[:, None]).argmax(axis=1)
        own[at, leaves] -= 1
        weights = np.cumsum(np.where(own > 0, own - self.d, 0.0), axis=1)
        draw = self.rng.random(len(rows)) * (weights[:, -1] + alpha)
        joins = (weights > draw[:, None]).argmax(axis=1)
        free = (own == 0).argmax(axis=1)
        own[at, np.where(draw < weights[:, -1], joins, free)] += 1
        # tables stay to the left, so that the last column tells when there is no room
        gap = (own[at, leaves] == 0) & (own > 0).any(axis=1)
        if gap.any():
            own[gap] = -np.sort(-own[gap], axis=1)
        self.tables[rows] = own


def sample_classes(k: int, pairs: np.ndarray, counts: np.ndarray, seed: int = SEED) -> np.ndarray:
    """log10 P(dish | context), k x k, averaged over the last sweeps, from counts of context * k + dish."""
    rng = np.random.default_rng(seed)
    u, z = pairs // k, pairs % k
    customers = np.bincount(u, weights=counts, minlength=k)
    root = np.full(k, 1.0 / k)
    t = np.ones(len(counts))
    total = np.zeros((k, k))
    seats = root_seats = None
    for sweep in range(SWEEPS):
        tables = np.bincount(u, weights=t, minlength=k)
        alpha = (STRENGTH + DISCOUNT * tables[u]) * root[z]
        seats = seats or Seating(counts, alpha, DISCOUNT, rng)
        t = seats.sweep(alpha).copy()
        sent = np.bincount(z, weights=t, minlength=k)  # a table in a context is a customer of the root
        at = np.flatnonzero(sent)
        base = np.full(len(at), (STRENGTH + DISCOUNT * len(at)) / k)
        if root_seats is None or len(root_seats.c) != len(at) or (root_seats.c != sent[at]).any():
            root_seats = Seating(sent[at], base, DISCOUNT, rng)
        root_tables = np.zeros(k)
        root_tables[at] = root_seats.sweep(base)
        root = (np.maximum(sent - DISCOUNT * root_tables, 0) + (STRENGTH + DISCOUNT * root_tables.sum()) / k) / (STRENGTH + sent.sum())
        if sweep >= SWEEPS - AVERAGED:
            tables = np.bincount(u, weights=t, minlength=k)
            p = ((STRENGTH + DISCOUNT * tables) / (STRENGTH + customers))[:, None] * root[None, :]
            p[u, z] += np.maximum(counts - DISCOUNT * t, 0) / (STRENGTH + customers[u])
            total += p
    return np.log10(total / AVERAGED)


class OtherWords:
    """P(word | any other word) as a function of the word's count, from how many words have each count."""

    def __init__(self, counts: np.ndarray, words: np.ndarray, vocabulary: int, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        self.customers = float((counts * words).sum())
        once, twice = (float(words[counts == x].sum()) for x in (1, 2))
        self.d = min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5
        base = 1.0 / (vocabulary + 1)
        # words of one count are alike: a few of them are seated and stand for all
        copies = 32
        each, tables = np.repeat(counts, copies), float(words.sum())
        seats, mean, shown = None, np.ones(len(counts)), np.zeros(len(counts))
        for sweep in range(SWEEPS if len(counts) else 0):
            alpha = np.full(len(each), (STRENGTH + self.d * tables) * base)
            seats = seats or Seating(each, alpha, self.d, rng)
            mean = seats.sweep(alpha).reshape(-1, copies).mean(axis=1)
            tables = float((mean * words).sum())
            if sweep >= SWEEPS - AVERAGED:
                shown += mean / AVERAGED
        if len(counts):
            tables = float((shown * words).sum())
        self.counts, self.tables = counts, shown
        self.rest = (STRENGTH + self.d * tables) * base

    def log10(self, counts: np.ndarray) -> np.ndarray:
        """Counts that were not among those given (none is in the corpus) lie between their neighbours."""
        t = np.interp(counts, np.concatenate([[0], self.counts]), np.concatenate([[0.0], self.tables]))
        return np.log10((np.maximum(counts - self.d * t, 0) + self.rest) / (STRENGTH + self.customers))


def _score(model: dict, parts: int):
    """Packed rows: each document with what its local pairs and words add, and its other tokens, dealt by pair or rare context."""

    def run(batches):
        keys, counts, tables, base = (model[x] for x in ("keys", "counts", "tables", "base"))
        pairs, own = model["pairs"], model["own"]
        log_counts = np.append(np.log10(counts + 1.0) - model["log_base"], 0.0)
        known = np.append(counts > 0, False).astype(np.int64)
        share, rest = 1.0 / (STRENGTH + counts), (STRENGTH + DISCOUNT * tables) / (STRENGTH + counts)
        places = _Places(keys)
        for hashes, z, u, starts, rows in _blocks(batches):
            at, ids = places(hashes)
            iu, iz = ids[u], ids[z]
            mixed = _mixed(iu, iz)
            found = _find(mixed, pairs)
            local = found < len(pairs)
            scores = np.zeros(len(z))
            lu, lz = iu[local], iz[local]
            scores[local] = np.log10(own[found[local]] * share[lu] + rest[lu] * base[lz])
            add = lambda x: np.add.reduceat(x, starts)
            uid = rows.column("uid").to_numpy()
            lens = np.diff(np.append(starts, len(z)))
            whole = [uid, rows.column("doc_id").cast(pa.int64()).fill_null(0).to_numpy(), rows.column("doc_id").is_valid().cast(pa.int64()).to_numpy(), lens, add(known[at[z]]), add(log_counts[at[z]]), add(scores)]
            yield from _deal(DOCUMENTS, ((_mixed(uid, 0).view(np.uint64) >> np.uint64(33)) % np.uint64(parts)).astype(np.int64), [x.astype(x.dtype if x.dtype == np.float64 else np.int64) for x in whole], parts)
            others = ~local
            learned = rows.column("training").cast(pa.int64()).to_numpy()
            iu, iz, mixed = iu[others], iz[others], mixed[others]
            of = np.repeat(uid * 2 + learned, lens)[others]
            yield from _deal(TOKENS, _part_of(iu, mixed, len(keys), parts), [iu, iz, of], parts)

    return run


def _deal_seats(keys: int, parts: int):
    def run(batches):
        for batch in batches:
            u, z, t = (batch.column(x).to_numpy() for x in ("u", "z", "t"))
            yield from _deal(SEATS, _part_of(u, _mixed(u, z), keys, parts), [u, z, t], parts)

    return run


def _deal_contexts(keys: int, parts: int):
    def run(batches):
        for batch in batches:
            w, c, tables = (batch.column(x).to_numpy() for x in ("w", "c", "tables"))
            yield from _deal(CONTEXTS, _part_of(w, w, keys, parts), [w, c, tables], parts)

    return run


_PARTS = "uid long, w long, own float, rest float, score double, doc_id long, n_tokens long, known long, base double"


def _rows(columns: dict[str, np.ndarray], doc_id: pa.Array | None = None) -> Iterator[pa.RecordBatch]:
    n = len(columns["uid"])
    arrays = [pa.array(columns["uid"]), pa.array(columns["w"])]
    for name, kind in (("own", pa.float32()), ("rest", pa.float32()), ("score", pa.float64())):
        arrays.append(pa.array(columns[name], kind) if name in columns else pa.nulls(n, kind))
    arrays.append(pa.nulls(n, pa.int64()) if doc_id is None else doc_id)
    for name, kind in (("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64())):
        arrays.append(pa.array(columns[name], kind) if name in columns else pa.nulls(n, kind))
    out = pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in _PARTS.split(", ")])
    for at in range(0, n, 1 << 16):
        yield out.slice(at, 1 << 16)


def _score_parts(model: dict):
    """Documents' own rows, and one for each rare word of theirs: own + rest * P(word in the root) is its probability.

    A row carries what the document's frequent words of this part add; w is null where no rare word is left for that.
    """

    def run(batches):
        counts, tables, base = (model[x] for x in ("counts", "tables", "base"))
        opened = _opened(batches, {TOKENS: 3, SEATS: 3, CONTEXTS: 3, DOCUMENTS: 7})
        uid, doc_id, valid, n_tokens, known, log_counts, scores = opened.pop(DOCUMENTS)
        # any key that spreads a document's own row
        yield from _rows(
            {"uid": uid, "w": _mixed(uid, 1), "score": scores.view(np.float64), "n_tokens": n_tokens, "known": known, "base": log_counts.view(np.float64)},
            pa.array(doc_id, mask=valid == 0),
        )
        u, z, of = opened.pop(TOKENS)
        if not len(u):
            return
        pairs, back = np.unique(_mixed(u, z), return_inverse=True)
        c = np.bincount(back, weights=of & 1, minlength=len(pairs))
        t = np.minimum(c, 1.0)
        su, sz, st = opened.pop(SEATS)
        at = _find(_mixed(su, sz), pairs)
        t[at[at < len(pairs)]] = st.view(np.float64)[at < len(pairs)]
        own = np.maximum(c - DISCOUNT * t, 0)[back]
        w, wc, wt = opened.pop(CONTEXTS)
        order = np.argsort(w)
        w, wc, wt = w[order], np.append(wc[order], 0), np.append(wt.view(np.float64)[order], 0.0)
        local = _is_local(u, len(counts))
        at, place = _find(u, w), np.where(local, u, 0)
        of_u, tables_u = np.where(local, counts[place], wc[at]), np.where(local, tables[place], wt[at])
        own, rest = own / (STRENGTH + of_u), (STRENGTH + DISCOUNT * tables_u) / (STRENGTH + of_u)
        uid, local = of >> 1, _is_local(z, len(counts))
        docs, back = np.unique(uid, return_inverse=True)
        score = np.bincount(back[local], weights=np.log10(own[local] + rest[local] * base[z[local]]), minlength=len(docs))
        rare = np.flatnonzero(~local)
        carried, first = np.unique(back[rare], return_index=True)
        scores = np.zeros(len(rare))
        scores[first] = score[carried]
        yield from _rows({"uid": uid[rare], "w": z[rare], "own": own[rare].astype(np.float32), "rest": rest[rare].astype(np.float32), "score": scores})
        left = np.setdiff1d(np.arange(len(docs)), carried)
        yield from _rows({"uid": docs[left], "w": _mixed(docs[left], 2), "score": score[left]})
        del opened, u, z, of, own, rest, back, pairs
        give_back()

    return run


def _free(spark) -> None:
    """Shuffles that no plan refers to any more are deleted once both sides have collected their garbage."""
    gc.collect()
    spark._jvm.System.gc()


def _least_local(counted: DataFrame, local_share: float) -> int:
    """The least c from which at most 1 / local_share rows have as much."""
    # a row for each distinct count, of which there are few more than the root of twice the tokens
    found = counted.groupBy("c").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("c")).toArrow()
    c, n = found.column("c").to_numpy(), found.column("n").to_numpy()
    fits = c[np.cumsum(n) <= 1 / local_share]
    return int(fits[-1]) if len(fits) else int(c.max(initial=0)) + 1


def train(training: DataFrame, vocabulary: DataFrame, local_share: float, parts: int, tokens: int, distinct: int) -> dict:
    """The model: what tasks need of it is bounded by the share; seats of pairs and words below it are its tables seats and rare."""
    spark = training.sparkSession
    stop = _signed(END)
    stops = sum(r.c for r in vocabulary.where(F.col("h") == stop).collect())
    words = vocabulary.where(F.col("h") != stop)
    least = _least_local(words, local_share)
    frequent = words.where(F.col("c") >= least).orderBy("h").toArrow()  # at most 1 / local_share rows
    keys, counts = (frequent.column(x).to_numpy() for x in ("h", "c"))
    at = np.searchsorted(keys, stop)
    keys, counts = np.insert(keys, at, stop), np.insert(counts, at, stops)
    is_local = lambda x: (F.col(x) >= 0) & (F.col(x) < len(keys))
    dealt = training.select("text").mapInArrow(_deal_pairs(keys, parts), _PACKED).repartitionById(parts, F.col("part"))
    pairs = stage(dealt.mapInArrow(_merge_pairs, "u long, z long, c long"), "pairs")
    del dealt
    _free(spark)
    rare = words.where(F.col("c") < least).select(F.col("h").alias("w"), "c", F.col("c").cast("double").alias("tables"), F.col("c").cast("double").alias("served"))
    plain = rare.select("w", "c")
    tables = served = counts.astype(np.float64)

    def root() -> Root:
        # a row for each distinct number, of which there are few more than the root of the tokens
        found = rare.groupBy("served").agg(F.count(F.lit(1)).alias("words")).toArrow()
        m, n = (np.concatenate([x, found.column(y).to_numpy()]) for x, y in ((served, "served"), (np.ones(len(served)), "words")))
        return Root(m[m > 0], n[m > 0], distinct)

    for step in range(ROUNDS):
        above = root()
        # a frequent word finds its share in each task: its key here is any that spreads it
        key = lambda x: F.when(is_local(x), F.xxhash64("u", "z")).otherwise(F.col(x))
        both = is_local("u") & is_local("z")
        of_u, of_z = rare.select(F.col("w").alias("wu"), "tables"), rare.select(F.col("w").alias("wz"), "served")
        joined = pairs.where(~both).join(of_u, key("u") == F.col("wu"), "left").join(of_z, key("z") == F.col("wz"), "left").select("u", "z", "c", "tables", "served")
        none = F.lit(None).cast("double")
        rows = pairs.where(both).select("u", "z", "c", none.alias("tables"), none.alias("served")).unionByName(joined)
        last = step == ROUNDS - 1
        seats = rows.mapInArrow(_seat_pairs(keys, tables, above(served), above, None if last else step), "u long, z long, c long, t double")
        if last:
            seats = stage(seats, "seats")
            release(pairs)
        sums = seats.mapInArrow(_saved, "w long, as_context double, as_word double").groupBy("w").agg(F.sum("as_context").alias("as_context"), F.sum("as_word").alias("as_word"))
        sums = stage(sums, "saved")
        mine = sums.where(is_local("w")).toArrow()
        at = mine.column("w").to_numpy()
        tables, served = counts.astype(np.float64), counts.astype(np.float64)
        tables[at] -= mine.column("as_context").to_numpy()
        served[at] -= mine.column("as_word").to_numpy()
        less = lambda x: F.col("c") - F.coalesce(F.col(x), F.lit(0.0))
        before, rare = rare, stage(plain.join(sums.where(~is_local("w")), "w", "left").select("w", "c", less("as_context").alias("tables"), less("as_word").alias("served")), "rare")
        release(sums), release(before)
        del rows, joined, sums, of_u, of_z, before
        _free(spark)
    above = root()
    both = is_local("u") & is_local("z")
    least = _least_local(seats.where(both), local_share)
    frequent = seats.where(both & (F.col("c") >= least)).toArrow()  # at most 1 / local_share rows
    u, z, c, t = (frequent.column(x).to_numpy() for x in ("u", "z", "c", "t"))
    mixed = _mixed(u, z)
    order = np.argsort(mixed)
    tasks = {"keys": keys, "counts": counts, "tables": tables, "base": above(served), "pairs": mixed[order], "own": np.append((c - DISCOUNT * t)[order], 0.0), "log_base": math.log10(tokens + distinct + 1)}
    return {"tasks": tasks, "seats": seats.where(~both | (F.col("c") < least)), "rare": rare, "root": above}


def _with_root(root: Root):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("w"), batch.column("c"), pa.array(root(batch.column("served").to_numpy()))], ["w", "c", "p"])

    return run


def score_documents(docs: DataFrame, class_share: float = CLASS_SHARE, local_share: float = LOCAL_SHARE) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row for each row.

    Tokens are a text's words, A-Z in lower case, and one end; null counts as empty. The model learns from rows
    that are not held out. base_score adds one to the unigram counts; score is the model's log10 probability of
    the text. Words are told apart by 64-bit hashes: two in a vocabulary of a hundred million share one with a
    chance of 1 in 3,000; so are pairs of words within a part. Without a row to learn from, all words are unknown. An
    empty table gives no rows. class_share is taken from callers of the model with classes and changes nothing.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", (~held_out(F.col("doc_id"))).alias("training"))
    training = rows.where("training")
    vocabulary = stage(word_counts(training), "vocabulary")
    tokens, distinct = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-tokens // PART))
    model = train(training, vocabulary, local_share, parts, tokens, distinct)
    tasks, seats, rare = model["tasks"], model["seats"], model["rare"]
    keys = len(tasks["keys"])
    packed = rows.withColumn("uid", F.monotonically_increasing_id()).mapInArrow(_score(tasks, parts), _PACKED)
    packed = packed.unionByName(seats.mapInArrow(_deal_seats(keys, parts), _PACKED))
    packed = packed.unionByName(rare.mapInArrow(_deal_contexts(keys, parts), _PACKED))
    scored = packed.repartitionById(parts, F.col("part")).mapInArrow(_score_parts(tasks), _PARTS)
    unseen = float(model["root"](np.zeros(1))[0])
    above = rare.mapInArrow(_with_root(model["root"]), "word long, c long, p double")
    joined = scored.join(above, F.col("w") == F.col("word"), "left")
    token, c = F.col("rest").isNotNull(), F.coalesce("c", F.lit(0))
    p = F.col("own").cast("double") + F.col("rest").cast("double") * F.coalesce("p", F.lit(unseen))
    sums = joined.groupBy("uid").agg(
        F.max("doc_id").alias("doc_id"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.when(token, (c > 0).cast("long")).otherwise(F.coalesce("known", F.lit(0)))).alias("n_known"),
        F.sum(F.when(token, F.log10(c + F.lit(1.0)) - tasks["log_base"]).otherwise(F.coalesce("base", F.lit(0.0)))).alias("base_score"),
        F.sum(F.col("score") + F.when(token, F.log10(p)).otherwise(0.0)).alias("score"),
    )
    return sums.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")


def perplexity(scored: DataFrame) -> DataFrame:
    """(held_out, perplexity, base_perplexity) of score_documents' result."""
    mean = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scored.groupBy("held_out").agg(mean("score").alias("perplexity"), mean("base_score").alias("base_perplexity"))
