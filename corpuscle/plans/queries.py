"""A query for each operator on the driver's tables.

documents stand for encyclopedia articles (title = doc_id), sources for the heads of sparse vectors, links of
pages for link graphs, events for revisions. Wikitext is a dump made of documents, with links around their texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import collections, expr
from ..functions import text as X
from ..operators import graph, revisions, similarity, stats, windows
from ..sources import dump, staging
from ..streaming import counts
from . import files

#: Parameters that the queries and their SQL share.
WINDOW, CONTEXT = 10, 5
STOP = ("the", "of", "and", "de", "la", "der", "die", "und")

def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    staging.bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("title"), "text", "source", "lang")


def _wiki(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(title, raw, text, links, flags) of documents written as a dump and read back, in all its namespaces."""
    pages = dump.read_dump(spark, files.dump_file(_table(spark, sf_dir, "documents"), F.expr(files.LINKED)), (0, 2, 6, 10, 14, 100))
    pages = pages.select("title", F.col("text").alias("raw"))
    flags = F.when(X.is_redirect(F.col("raw")), F.array(F.lit("redirect"))).otherwise(F.array().cast("array<string>"))
    return pages.select("title", "raw", F.col("raw").alias("text"), X.wiki_links(F.col("raw")).alias("links"), flags.alias("flags"))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bags of words of each source."""
    words = _docs(spark, sf_dir).select(F.col("source").alias("head"), F.explode(X.tokens(F.col("text"))).alias("feature"))
    return words.groupBy("head", "feature").agg(F.count(F.lit(1)).alias("cnt"))


def _heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return _common(docs, stats.term_doc_freq(docs))


def _common(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(word): words of terms (word, df) in at least four of ten documents that count, without the stop words."""
    total = stats.corpus_totals(docs).select("n_docs")  # one row
    often = terms.where(~F.col("word").isin(list(STOP))).crossJoin(F.broadcast(total)).where(F.col("df") * 10 >= F.col("n_docs") * 4)
    return staging.stage(often.select("word"), "heads")


def _page_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(kind, src, dst): each link once, also where several rows hold one url."""
    pages = _table(spark, sf_dir, "pages")
    links = F.regexp_extract_all("html", F.lit(r'<a href="([^"]*)"'), 1)
    edges = pages.select(F.col("url").alias("src"), F.explode(F.array_distinct(links)).alias("dst")).distinct()
    return edges.select(F.lit("NORMAL").alias("kind"), "src", "dst")


def _revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events")
    user = F.when(F.col("user_id") % 7 == 0, F.concat(F.lit("bot"), F.col("user_id"))).when(F.col("user_id") % 11 == 0, F.lit("10.0.0.1")).otherwise(F.concat(F.lit("user"), F.col("user_id")))
    return events.select(
        F.expr("event_type || ' ' || (event_id div 50)").alias("title"), F.col("event_id").alias("revid"), user.alias("user"), (F.col("user_id") % 11 == 0).alias("anon"),
        F.lit("").alias("comment"), F.round("value").cast("long").alias("size"),
    )


# --- statistics and filters


def term_doc_freq(spark, sf_dir):
    return stats.term_doc_freq(_docs(spark, sf_dir))


def corpus_totals(spark, sf_dir):
    return stats.corpus_totals(_docs(spark, sf_dir))


def min_len_docs(spark, sf_dir):
    rows = stats.longer_than(stats.with_tokens(_docs(spark, sf_dir).select("doc_id", "text")), 1000)
    return rows.select("doc_id", F.size("w").cast("long").alias("n_words"))


def vocab_filter(spark, sf_dir):
    return stats.vocabulary(stats.term_doc_freq(_docs(spark, sf_dir), min_df=1), 10, strict=True)


def stopword_removal(spark, sf_dir):
    rows = stats.drop_words(stats.with_tokens(_docs(spark, sf_dir).select("doc_id", "text")), list(STOP))
    return rows.select("doc_id", F.size("w").cast("long").alias("n_words"), F.md5(F.array_join("w", " ").cast("binary")).alias("digest"))


def in_degree_docs(spark, sf_dir):
    edges = _page_edges(spark, sf_dir)
    pages = edges.select(F.col("dst").alias("title")).distinct()
    return stats.linked_documents(pages, graph.degrees(edges), 5)


def category_restriction(spark, sf_dir):
    return stats.in_category(_wiki(spark, sf_dir), ["Letters", "Pict"], "raw").select("title")


def sample_docs(spark, sf_dir):
    return stats.sample_documents(_docs(spark, sf_dir), 0.5, seed=1).select("doc_id")


# --- text


def strip_html_pages(spark, sf_dir):
    plain = X.strip_html(X.strip_html(F.col("html")))
    return _table(spark, sf_dir, "pages").select("page_id", plain.alias("text"))


def clean_document(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", X.clean_document(F.col("text")).alias("text"))


def clean_keep_punct(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", X.clean_keep_punctuation(F.col("text"), space_punctuation=True).alias("text"))


def strip_wiki(spark, sf_dir):
    return _wiki(spark, sf_dir).select("title", X.strip_wiki(F.replace("raw", F.lit("\n"), F.lit(" <CR> "))).alias("text"))


def extraneous_filter(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", X.drop_extraneous(X.clean_keep_punctuation(F.col("text"))).alias("text"))


def strict_filter(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", X.drop_non_alphabetic(X.drop_extraneous(X.clean_keep_punctuation(F.col("text")))).alias("text"))


def redirect_flag(spark, sf_dir):
    return _wiki(spark, sf_dir).select("title", X.is_redirect(F.col("raw")).alias("redirect"), F.size("links").cast("long").alias("n_links"))


def plain_text_truncated(spark, sf_dir):
    return stats.truncated_text(_docs(spark, sf_dir), 100, 100)


def key_hashes(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", X.key_hash(F.concat(F.lit(":"), F.col("title"))).alias("h"))


def normalized_titles(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", X.normalize_title(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("title"))


# --- graphs


def link_graph(spark, sf_dir):
    return graph.link_graph(_wiki(spark, sf_dir))


def page_links(spark, sf_dir):
    return _page_edges(spark, sf_dir)


def degree_table(spark, sf_dir):
    return graph.degrees(_page_edges(spark, sf_dir))


def category_graph(spark, sf_dir):
    return graph.category_graph(stats.without_titles(_wiki(spark, sf_dir), ("Image:", "Wikipedia:")))


def missing_languages(spark, sf_dir):
    return graph.missing_languages(_wiki(spark, sf_dir), 3)


def redirect_resolution(spark, sf_dir):
    found = _wiki(spark, sf_dir).select(F.col("title").alias("src"), X.redirect_target(F.col("raw")).alias("dst")).where("dst is not null")
    return graph.resolve_redirects(found)


# --- windows


def cooccurrence(spark, sf_dir):
    return windows.cooccurrence(_docs(spark, sf_dir), WINDOW)


def pmi(spark, sf_dir):
    found = windows.pmi(windows.cooccurrence(_docs(spark, sf_dir), WINDOW, keep=True), kept=True)
    return found.withColumn("pmi", F.round("pmi", 6))


def contexts_uni(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    words = staging.stage(stats.term_doc_freq(docs), "terms")
    return windows.unigram_contexts(docs, _common(docs, words), words, CONTEXT, list(STOP))


def contexts_raw(spark, sf_dir):
    return windows.raw_contexts(_docs(spark, sf_dir), _heads(spark, sf_dir), CONTEXT, list(STOP))


def contexts_lr(spark, sf_dir):
    return windows.gap_contexts(_docs(spark, sf_dir), _heads(spark, sf_dir), 1, list(STOP))


def context_unique_words(spark, sf_dir):
    return windows.words_per_context(windows.gap_contexts(_docs(spark, sf_dir), _heads(spark, sf_dir), 1, list(STOP)), 2)


def context_vectors(spark, sf_dir):
    """Unigram contexts of two corpora, the English and German documents and all others, added up."""
    docs = _docs(spark, sf_dir)
    words = staging.stage(stats.term_doc_freq(docs), "terms")
    heads = _common(docs, words)
    first = F.coalesce(F.col("lang").isin("en", "de"), F.lit(False))
    both = [windows.unigram_contexts(docs.where(x), heads, words, CONTEXT) for x in (first, ~first)]
    return windows.sum_vectors(both[0].unionByName(both[1]))


def lda_docs_document(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return stats.bags(docs, stats.vocabulary(stats.term_doc_freq(docs, min_df=1), 10, strict=True), 1000)


def lda_docs_ngram(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return stats.ngram_bags(docs, 10, stats.vocabulary(stats.term_doc_freq(docs, min_df=1), 10, strict=True), 1000)


def esa_postings(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return stats.inverted_index(docs, heads=stats.term_doc_freq(docs))[0]


def esa_doc_stats(spark, sf_dir):
    return stats.inverted_index(_docs(spark, sf_dir))[1]


# --- vectors


def weight_tf(spark, sf_dir):
    return similarity.weight_tf(_vectors(spark, sf_dir))


def _rounded(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.round(column, 6))


def weight_tfidf_mass(spark, sf_dir):
    return _rounded(similarity.weight_tfidf(_vectors(spark, sf_dir)), "weight")


def weight_tfidf_df(spark, sf_dir):
    return _rounded(similarity.weight_tfidf(_vectors(spark, sf_dir), by_vectors=True), "weight")


def weight_ttest(spark, sf_dir):
    return _rounded(similarity.weight_ttest(_vectors(spark, sf_dir)), "weight")


def jaccard(spark, sf_dir):
    return _rounded(similarity.jaccard(_vectors(spark, sf_dir)), "score")


def weighted_jaccard_tf(spark, sf_dir):
    return _rounded(similarity.METRICS["tf_weighted_jaccard"](_vectors(spark, sf_dir)), "score")


def weighted_jaccard_tfidf(spark, sf_dir):
    return _rounded(similarity.METRICS["tfidf_weighted_jaccard"](_vectors(spark, sf_dir)), "score")


def weighted_jaccard_ttest(spark, sf_dir):
    return _rounded(similarity.METRICS["ttest_weighted_jaccard"](_vectors(spark, sf_dir)), "score")


def topk_neighbors(spark, sf_dir):
    return similarity.similar_words(_vectors(spark, sf_dir), "tf_weighted_jaccard", k=5)


def random_similarity(spark, sf_dir):
    return similarity.METRICS["random"](_vectors(spark, sf_dir)).withColumn("score", F.round("score", 6))


def context_whitelist(spark, sf_dir):
    good = stats.term_doc_freq(_docs(spark, sf_dir), min_df=50).select(F.col("word").alias("feature"))
    return similarity.keep_features(_vectors(spark, sf_dir), good)


def sense_overwrite(spark, sf_dir):
    """Vectors of sources, those of two replaced by vectors of each of their languages."""
    docs = _docs(spark, sf_dir).where(F.col("source").isin("src1", "src2"))
    words = docs.select(F.concat("source", F.lit("ZZZ"), "lang").alias("head"), F.explode(X.tokens(F.col("text"))).alias("feature"))
    return similarity.overwrite_senses(_vectors(spark, sf_dir), words.groupBy("head", "feature").agg(F.count(F.lit(1)).alias("cnt")))


def contextual_similarity(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    words = staging.stage(stats.term_doc_freq(docs), "terms", free=True)
    found = similarity.contextual_similarity(docs, staging.stage(_vectors(spark, sf_dir), "vectors", free=True), words, CONTEXT, 100, 5, 300)
    for column in ("wt", "wb", "jacc", "wjacc"):
        found = _rounded(found, column)
    return found


def parse_sparse_vector(spark, sf_dir):
    from ..sources import vectors

    return vectors.parse_lines(vectors.format_lines(_vectors(spark, sf_dir)))


def format_sparse_vector(spark, sf_dir):
    from ..sources import vectors

    return vectors.format_lines(_vectors(spark, sf_dir))


# --- revisions


def authors(spark, sf_dir):
    return revisions.author_counts(_revisions(spark, sf_dir))


def size_changes(spark, sf_dir):
    return revisions.size_changes(_revisions(spark, sf_dir)).select("title", "revid", "diff_size")


# --- collections, expressions, stores


def expressions(spark, sf_dir):
    text = F.concat("p_size", F.lit(" * 2 + 7 mod 4 - (1 < "), "p_size", F.lit(")"))
    return _table(spark, sf_dir, "part").select("p_partkey", expr.evaluate_expressions(text).alias("value"))


def collection_items(spark, sf_dir):
    """The customers of each nation as a collection: a chapter for each market segment."""
    customers = _table(spark, sf_dir, "customer")
    line = F.concat(F.lit(";"), "c_mktsegment", F.lit("\n:[["), "c_name", F.lit("]]"))
    rows = customers.groupBy(F.col("c_nationkey").cast("string").alias("page")).agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("text"))
    return collections.collection_items(rows).where("kind = 'article'").select("page", "chapter", "title")


def script_runs(spark, sf_dir):
    return collections.script_runs(_docs(spark, sf_dir).select("doc_id", "text"))


def overlay_docs(spark, sf_dir):
    docs = _docs(spark, sf_dir).select("title", "text", "lang")
    return dump.overlay(docs, docs.where("lang = 'de'").withColumn("text", F.concat(F.lit("+"), "text"))).select("title", F.md5(F.col("text").cast("binary")).alias("digest"))


def article_urls(spark, sf_dir):
    found = X.article_of_url(F.col("url"))
    return _table(spark, sf_dir, "pages").select("page_id", found["title"].alias("title"))


# --- streams


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream: of the files in its folder, or of its one file, which is picked from the folder around it."""
    path = f"{sf_dir}/{name}.parquet"
    reader = spark.readStream.schema(_table(spark, sf_dir, name).schema)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def stream_term_counts(spark, sf_dir):
    stream = _stream(spark, sf_dir, "documents")
    return counts.run_to_end(counts.term_counts(stream), "terms", staging.folder(spark, "checkpoint"))


def stream_windowed_counts(spark, sf_dir):
    stream = _stream(spark, sf_dir, "events")
    found = counts.run_to_end(counts.windowed_counts(stream, "1 day"), "windows", staging.folder(spark, "checkpoint"))
    return found.withColumn("total", F.round("total", 4))


_NAMES = (
    "term_doc_freq corpus_totals min_len_docs vocab_filter stopword_removal in_degree_docs category_restriction sample_docs"
    " strip_html_pages clean_document clean_keep_punct strip_wiki extraneous_filter strict_filter redirect_flag plain_text_truncated"
    " key_hashes normalized_titles link_graph page_links degree_table category_graph missing_languages redirect_resolution"
    " cooccurrence pmi contexts_uni contexts_raw contexts_lr context_unique_words context_vectors lda_docs_document lda_docs_ngram"
    " esa_postings esa_doc_stats weight_tf weight_tfidf_mass weight_tfidf_df weight_ttest jaccard weighted_jaccard_tf"
    " weighted_jaccard_tfidf weighted_jaccard_ttest topk_neighbors random_similarity context_whitelist sense_overwrite"
    " contextual_similarity parse_sparse_vector format_sparse_vector authors size_changes"
    " expressions collection_items script_runs overlay_docs article_urls"
    " stream_term_counts stream_windowed_counts"
).split()
QUERIES = {name: globals()[name] for name in _NAMES}
