"""Best-fit packing: longest documents first, each into the fullest sequence that still takes it, found by a segment tree."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage
from .packing import cut_documents, place_pieces
from .tokens import CACHED

SEQUENCE = 2048


class Capacities:
    """A segment tree over remaining capacities: which of them open sequences have."""

    def __init__(self, size: int) -> None:
        self.leaves = 1 << size.bit_length()
        self.some = [False] * (2 * self.leaves)

    def put(self, capacity: int, present: bool) -> None:
        node = capacity + self.leaves
        self.some[node] = present
        while node > 1:
            node //= 2
            self.some[node] = self.some[2 * node] or self.some[2 * node + 1]

    def tightest(self, length: int) -> int | None:
        """The least capacity of at least length that is present: up to the first right sibling that holds one, then down to its leftmost."""
        node = length + self.leaves
        if not self.some[node]:
            while node > 1 and (node % 2 or not self.some[node + 1]):
                node //= 2
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node *= 2
                node += not self.some[node]
        return node - self.leaves


def best_fit_decreasing(histogram: dict[int, int], size: int) -> list[tuple[list[int], int]]:
    """[(lengths in a sequence, number of such sequences)]: best-fit decreasing over every length of the histogram.

    Open sequences of one remaining capacity are a class of patterns with counts. The tightest class takes equal
    lengths many at a time: a sequence that took one is then the tightest itself, so it takes as many as fit before the
    next one of its class does, which is what placing them one by one does. New sequences open where no class fits.
    The work depends on the histogram's width, not on its counts.
    """
    tree, classes, full = Capacities(size), {}, []

    def put(capacity: int, lengths: list[int], count: int) -> None:
        if capacity == 0:
            full.append((lengths, count))
            return
        if not classes.setdefault(capacity, []):
            tree.put(capacity, True)
        classes[capacity].append((lengths, count))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            capacity = tree.tightest(length)
            if capacity is None:
                capacity, lengths, count = size, [], left
            else:
                lengths, count = classes[capacity].pop()
            together = capacity // length
            filled = min(count, left // together)
            if filled:
                put(capacity - together * length, lengths + [length] * together, filled)
                left -= filled * together
            if left and filled < count:  # fewer than one sequence takes
                put(capacity - left * length, lengths + [length] * left, 1)
                filled, left = filled + 1, 0
            if lengths:
                if count > filled:
                    put(capacity, lengths, count - filled)
                if not classes[capacity]:
                    tree.put(capacity, False)
    return full + [pattern for patterns in classes.values() for pattern in patterns]


def pack_best_fit(docs: DataFrame, size: int = SEQUENCE, tokenizer: str | None = None, with_ids: bool = False, cached: int = CACHED) -> DataFrame:
    """docs (doc_id, text) -> pieces (doc_id, piece, start, length, ids_crc32, doc_tokens[, ids], sequence_id, offset) in few sequences of at most size ids.

    Every document, of null or empty text too, ends with id 0. Only longer ones than size are cut, into pieces of size
    ids and a last one of what is left; each piece lies in one sequence whole. Offsets in a sequence are gapless from 0.
    Rows that repeat are packed each; null ids stay null. An empty table gives no rows. Other columns are not read.
    tokenizer: a vocabulary file, by default public_tokenizers' word_bpe_49k.json. Lengths, at most size, are counted
    over all documents; best-fit decreasing places the counts, and documents find their place by rank within their length.
    """
    pieces = cut_documents(docs, size, tokenizer or public_tokenizers.path("word_bpe_49k.json"), with_ids, cached)
    placed = place_pieces(stage(pieces, "pieces"), size, best_fit_decreasing)
    return placed.select("doc_id", F.expr(f"int(start div {size})").alias("piece"), *[c for c in placed.columns if c != "doc_id"])
