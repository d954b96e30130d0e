"""Term and document statistics, and the filters that use them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def uniform(key: Column) -> Column:
    """A number in [0, 1) from the first 13 hex digits of a key's md5."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def with_tokens(docs: DataFrame, text: str = "text", into: str = "w") -> DataFrame:
    """docs with an array of the words of a text column."""
    return docs.withColumn(into, X.tokens(F.col(text)))


def longer_than(docs: DataFrame, n: int, words: str = "w") -> DataFrame:
    """Documents of more than n words."""
    return docs.where(F.size(words) > n)


def without_titles(docs: DataFrame, banned: tuple[str, ...]) -> DataFrame:
    """Documents whose title starts with none of the prefixes; a null title stays."""
    for prefix in banned:
        docs = docs.where(~F.coalesce(F.col("title").startswith(prefix), F.lit(False)))
    return docs


def term_doc_freq(docs: DataFrame, min_doc_len: int = 100, min_df: int = 5, text: str = "text") -> DataFrame:
    """(word, tf, df) over documents of more than min_doc_len words, for words in at least min_df documents.

    Each document's words are sorted in place, so that a word's first occurrence tells itself; tf and df are then
    plain sums, combined before one shuffle on the word.
    """
    words = longer_than(docs.select(X.tokens(F.col(text)).alias("w")), min_doc_len).select(F.array_sort("w").alias("s"))
    marked = F.transform(F.col("s"), lambda w, i: F.struct(w.alias("word"), F.when((i > 0) & (w == F.get(F.col("s"), i - 1)), 0).otherwise(1).alias("first")))
    rows = words.select(F.inline(marked))
    return rows.groupBy("word").agg(F.count(F.lit(1)).alias("tf"), F.sum("first").alias("df")).where(F.col("df") >= min_df)


def corpus_totals(docs: DataFrame, min_doc_len: int = 100, text: str = "text") -> DataFrame:
    """(n_docs, n_words) over documents of more than min_doc_len words."""
    sized = docs.select(F.size(X.tokens(F.col(text))).alias("n")).where(F.col("n") > min_doc_len)
    return sized.agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_words"))


def vocabulary(stats: DataFrame, min_df: int = 5, strict: bool = False) -> DataFrame:
    """Words whose df reaches min_df; strictly more if asked."""
    return stats.where(F.col("df") > min_df if strict else F.col("df") >= min_df)


def drop_words(docs: DataFrame, words: list[str], column: str = "w") -> DataFrame:
    """Removes every occurrence of the listed words; positions close up. For lists that fit an expression."""
    stop = F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")
    return docs.withColumn(column, F.filter(column, lambda w: ~F.array_contains(stop, w)))


def inverted_index(docs: DataFrame, min_doc_len: int = 100, heads: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(postings (word, title, tf, doc_len, vocab_size), doc_stats (title, doc_len, vocab_size)) of docs (title, text).

    heads (word) restricts the postings; document statistics are always over all words.
    """
    words = longer_than(docs.select("title", X.tokens(F.col("text")).alias("w")), min_doc_len)
    sized = words.select("title", "w", F.size("w").cast("long").alias("doc_len"), F.size(F.array_distinct("w")).cast("long").alias("vocab_size"))
    rows = sized.select("title", "doc_len", "vocab_size", F.explode("w").alias("word"))
    if heads is not None:
        rows = rows.join(heads.select("word").distinct(), "word", "left_semi")
    postings = rows.groupBy("word", "title", "doc_len", "vocab_size").agg(F.count(F.lit(1)).alias("tf"))
    return postings.select("word", "title", "tf", "doc_len", "vocab_size"), sized.select("title", "doc_len", "vocab_size")


def bags(docs: DataFrame, words: DataFrame | None = None, min_doc_len: int = 10_000) -> DataFrame:
    """(doc_id, word, cnt): whole-document bags of docs (title, text); a document without a kept word has one row of null word."""
    rows = longer_than(docs.select("title", X.tokens(F.col("text")).alias("w")), min_doc_len)
    every = rows.select(F.col("title").alias("doc_id"), F.explode_outer("w").alias("word"))
    if words is None:
        return every.groupBy("doc_id", "word").agg(F.count("word").alias("cnt"))
    kept = every.join(words.select("word").distinct(), "word", "left_semi").groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("cnt"))
    empty = rows.select(F.col("title").alias("doc_id")).join(kept.select("doc_id").distinct(), "doc_id", "left_anti")
    return kept.unionByName(empty.select("doc_id", F.lit(None).cast("string").alias("word"), F.lit(0).cast("long").alias("cnt")))


def _window_bags(n: int, min_doc_len: int, listed, at_once: int):
    """Rows (doc_id, word, cnt) of texts whose titles are their own: a window's words are sorted within its row."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    from .windows import ROWS_OUT, _tokens

    def run(batches):
        for batch in batches:
            names, ids, sizes = _tokens(batch.column("text"), False)
            keep = np.ones(len(names), bool) if listed is None else listed.value.numbers(names) >= 0
            kept = np.where(keep[ids], ids, len(names)) if len(names) else ids  # what isn't kept comes last
            counts = np.where((sizes > min_doc_len) & (sizes > n), sizes - n, 0)  # windows of each text
            ends = np.cumsum(counts)
            first = np.cumsum(sizes) - sizes
            for begin in range(0, int(ends[-1]) if len(ends) else 0, step := max(1, at_once // n)):
                window = np.arange(begin, min(begin + step, ends[-1]))
                doc = np.searchsorted(ends, window, "right")
                i = window - (ends[doc] - counts[doc])
                words = np.sort(kept[(first[doc] + i)[:, None] + np.arange(n)], axis=1)
                new = np.ones(words.shape, bool)
                new[:, 1:] = words[:, 1:] != words[:, :-1]
                starts = np.flatnonzero(new)
                cnt, word = np.diff(starts, append=words.size), words.ravel()[starts]
                real = word < len(names)
                title = pc.binary_join_element_wise(batch.column("title").take(pa.array(doc)).cast(pa.string()), pa.array(i).cast(pa.string()), pa.array(i + n).cast(pa.string()), "-")
                row, word, cnt = (starts // n)[real], word[real], cnt[real]
                for k in range(0, len(row), ROWS_OUT):
                    at = slice(k, k + ROWS_OUT)
                    yield pa.RecordBatch.from_arrays([title.take(pa.array(row[at])), names.take(pa.array(word[at])).cast(pa.string()), pa.array(cnt[at].astype(np.int64))], ["doc_id", "word", "cnt"])

    return run


def _shuffled_ngram_bags(docs: DataFrame, n: int, words: DataFrame | None, min_doc_len: int) -> DataFrame:
    """ngram_bags of titles that several documents may have, and of words of any number: a word is sent on once for each window."""
    rows = docs.select("title", X.tokens(F.col("text")).alias("w")).select("title", "w", F.size("w").alias("len")).where((F.col("len") > min_doc_len) & (F.col("len") > n))
    placed = rows.select("title", "len", F.posexplode("w").alias("pos", "word"))
    if words is not None:
        placed = placed.join(words.select("word").distinct(), "word", "left_semi")
    start = F.explode(F.sequence(F.greatest(F.col("pos") - n + 1, F.lit(0)), F.least(F.col("pos"), F.col("len") - n - 1)))
    windows = placed.where(F.greatest(F.col("pos") - n + 1, F.lit(0)) <= F.least(F.col("pos"), F.col("len") - n - 1)).select("title", "word", start.alias("i"))
    name = F.concat_ws("-", "title", "i", F.col("i") + n)
    return windows.groupBy("title", "i", "word").agg(F.count(F.lit(1)).alias("cnt")).select(name.alias("doc_id"), "word", "cnt")


def ngram_bags(docs: DataFrame, n: int = 10, words: DataFrame | None = None, min_doc_len: int = 10_000, at_once: int = 1 << 21) -> DataFrame:
    """(doc_id, word, cnt) of every window [i, i + n) with i + n < length: the last window is left out.

    doc_id is title-i-(i+n); windows without a kept word have no rows. A document's windows are counted in its task,
    with the list of words; only documents that share their title with another (or have none), and all where words are
    too many to send to tasks, are shuffled.
    """
    from ..sources import staging
    from .windows import listed_words

    staging.bound_batches(docs.sparkSession)
    known = None if words is None else staging.stage(words.select("word").distinct(), "words")
    listed = None if known is None else listed_words(known)
    if known is not None and listed is None:
        return _shuffled_ngram_bags(docs, n, known, min_doc_len)
    sent = listed and docs.sparkSession.sparkContext.broadcast(listed)
    shared = staging.stage(docs.groupBy("title").agg(F.count(F.lit(1)).alias("c")).where("c > 1 or title is null").select("title"), "shared")
    rest = None
    if not shared.isEmpty():
        rest = _shuffled_ngram_bags(docs.join(shared, docs["title"].eqNullSafe(shared["title"]), "left_semi"), n, known, min_doc_len)
        docs = docs.join(shared, docs["title"].eqNullSafe(shared["title"]), "left_anti")
    found = docs.select(F.col("title").cast("string").alias("title"), "text").mapInArrow(_window_bags(n, min_doc_len, sent, at_once), "doc_id string, word string, cnt long")
    return found if rest is None else found.unionByName(rest)


def in_category(docs: DataFrame, names: list[str], raw: str = "text") -> DataFrame:
    """Documents whose raw text names any of the categories; no names keep all."""
    if not names:
        return docs
    found: Column = F.lit(False)
    for name in names:
        found = found | F.col(raw).rlike(f"Category:.*{name}.*")
    return docs.where(F.coalesce(found, F.lit(False)))


def linked_documents(docs: DataFrame, degrees: DataFrame, min_incoming: int = 5) -> DataFrame:
    """docs (title, ...) whose row in degrees (doc, incoming, outgoing) has at least min_incoming; all if that is 0."""
    if min_incoming <= 0:
        return docs
    clean = degrees.where(F.col("incoming") >= min_incoming).select(F.col("doc").alias("title"))
    return docs.join(clean, "title", "left_semi")


def sample_documents(docs: DataFrame, share: float = 1.0, seed: int = 0) -> DataFrame:
    """A Bernoulli sample of docs (title, text): each row is drawn by a hash of the seed and itself, the same on any cluster."""
    key = F.concat_ws("|", F.lit(str(seed)), F.coalesce("title", F.lit("")), F.coalesce("text", F.lit("")))
    return docs if share >= 1 else docs.where(uniform(key) < share)


def truncated_text(docs: DataFrame, min_words: int = 1000, truncate: int = 1000) -> DataFrame:
    """(title, text): the first truncate words of documents of more than min_words, cut after the last period."""
    rows = longer_than(docs.select("title", X.tokens(F.col("text")).alias("w")), min_words)
    return rows.select("title", X.truncate_at_sentence(F.col("w"), truncate).alias("text"))
