"""Link, category and language graphs; redirects and template closures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.staging import stage
from .numbering import numbered

#: The languages that an article is expected to link to.
LANGUAGES = ("fr", "de", "ja", "zh", "it", "pl", "es", "ru", "pt", "nl")


def link_graph(docs: DataFrame, redirect_max_links: int = 4) -> DataFrame:
    """(kind, src, dst) of docs (title, links, flags): REDIRECT for flagged pages of few links, else NORMAL; distinct per page."""
    few = F.array_contains("flags", "redirect") & (F.size("links") <= redirect_max_links)
    targets = F.filter(F.transform("links", X.link_target), lambda x: x != "")
    rows = docs.select(F.when(few, "REDIRECT").otherwise("NORMAL").alias("kind"), F.col("title").alias("src"), F.explode(F.array_distinct(targets)).alias("dst"))
    return rows


def category_graph(docs: DataFrame) -> DataFrame:
    """(title, category) of docs (title, raw): the distinct categories that each page names, without brackets."""
    found = F.array_distinct(F.transform(X.categories(F.col("title"), F.col("raw")), X.link_target))
    return docs.select("title", F.explode(found).alias("category"))


def degrees(edges: DataFrame) -> DataFrame:
    """(doc, incoming, outgoing) of edges (src, dst)."""
    ends = edges.select(F.col("dst").alias("doc"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionAll(edges.select(F.col("src").alias("doc"), F.lit(0), F.lit(1)))
    return ends.groupBy("doc").agg(F.sum("i").alias("incoming"), F.sum("o").alias("outgoing"))


def missing_languages(docs: DataFrame, min_words: int = 1000, languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """(title, n_words, n_missing, missing) of docs (title, text, links): languages that no interlanguage link names."""
    found = F.transform("links", lambda x: F.regexp_extract(x, r"^\[\[([a-z]{2}):", 1))
    missing = F.array_except(F.array(*[F.lit(x) for x in languages]), found)
    rows = docs.select("title", F.size(X.tokens(X.drop_breaks(F.col("text")))).cast("long").alias("n_words"), missing.alias("_m")).where((F.col("n_words") > min_words) & (F.size("_m") > 0))
    return rows.select("title", "n_words", F.size("_m").cast("long").alias("n_missing"), F.array_join(F.array_sort("_m"), ",").alias("missing"))


def resolve_redirects(redirects: DataFrame) -> DataFrame:
    """(src, dst, hops): where each redirect (src, dst) ends, however far; null where redirects go round in a circle.

    Hops double each time: every redirect that still leads to another is joined with what that one leads to; those that
    are at their end are told by a column and left out of that side. After as many hops as there are redirects, what
    still leads to another is in a circle or leads into one. Titles travel as numbers.
    """
    found = stage(redirects.where("src is not null and dst is not null").groupBy("src").agg(F.min("dst").alias("dst")), "redirects")
    names = stage(numbered(found.select(F.col("src").alias("name")), "name", name="n"), "names")
    # dst is the number of a redirect, or null at an end; at is the redirect whose dst is the end
    linked = found.join(names.select(F.col("name").alias("src"), F.col("n").alias("at")), "src").join(names.select(F.col("name").alias("dst"), F.col("n").alias("to")), "dst", "left")
    linked = stage(linked.select("src", "dst", "at", "to"), "linked")
    current, done, n = stage(linked.select("at", "to", F.col("at").alias("last"), F.lit(1).cast("long").alias("hops")), "hops"), 1, found.count()
    ended, active = current.where("to is null"), current.where("to is not null")
    while done <= n and not active.isEmpty():
        step = current.select(F.col("at").alias("to"), F.col("to").alias("_to"), F.col("last").alias("_last"), F.col("hops").alias("_h"))
        moved = active.join(step, "to").select("at", F.col("_to").alias("to"), F.col("_last").alias("last"), (F.col("hops") + F.col("_h")).alias("hops"))
        moved = stage(moved, "hops")
        ended = ended.unionByName(moved.where("to is null"))
        active = moved.where("to is not null")
        current = ended.unionByName(active)
        done *= 2
    ends = linked.select(F.col("at").alias("last"), F.col("dst").alias("end"))
    known = ended.select("at", "last", "hops").join(ends, "last").select("at", "end", "hops")
    return linked.select("src", "at").join(known, "at", "left").select("src", F.col("end").alias("dst"), "hops")


def template_closure(pages: DataFrame, templates: DataFrame) -> DataFrame:
    """(title, template): every template that a page (title, text) uses, also through templates (title, text), however deep."""

    def used(df: DataFrame) -> DataFrame:
        names = F.regexp_extract_all(F.col("text"), F.lit(r"\{\{\s*([^{}|]+?)\s*(?:\||\}\})"), 1)
        return df.select("title", F.explode(F.array_distinct(F.transform(names, X.normalize_title))).alias("template")).distinct()

    edges = stage(used(templates).select(F.col("title").alias("_t"), F.col("template").alias("_u")), "edges")
    found = frontier = stage(used(pages), "frontier")
    while not frontier.isEmpty():
        reached = frontier.join(edges, F.col("template") == F.col("_t")).select("title", F.col("_u").alias("template")).distinct()
        frontier = stage(reached.join(found, ["title", "template"], "left_anti"), "frontier")
        found = found.unionByName(frontier)
    return found
