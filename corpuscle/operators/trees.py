"""Markup trees of a corpus: parsed, tidied and turned into tables within one task, without a shuffle."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import tree


def _map(pages: DataFrame, make: Callable[[str, tree.Node], list[tuple]], schema: str, passes) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for pdf in batches:
            found = []
            for title, text in zip(pdf["title"], pdf["text"]):
                root = tree.clean(tree.parse(text or "", title or ""), passes)
                found += [(title, *row) for row in make(title, root)]
            yield pd.DataFrame(found, columns=names)

    return pages.select("title", "text").mapInPandas(run, schema)


def node_table(pages: DataFrame, passes: tuple = tree.PIPELINE) -> DataFrame:
    """(title, node_id, parent_id, pos, class, caption, target, attrs) of pages (title, text) after the passes; () for none."""
    schema = "title string, node_id long, parent_id long, pos long, class string, caption string, target string, attrs map<string,string>"
    return _map(pages, lambda title, root: tree.rows(root), schema, passes)


def outlines(pages: DataFrame, passes: tuple = tree.PIPELINE, rules: list[tree.Rule] = (), noted: bool = False) -> DataFrame:
    """(title, outline) of pages (title, text): each tree in one line, after the passes and without what breaks rules.

    noted: text is such a line instead of wikitext.
    """

    def run(batches):
        for pdf in batches:
            lines = []
            for title, text in zip(pdf["title"], pdf["text"]):
                root = tree.from_outline(text) if noted else tree.parse(text or "", title or "")
                tree.clean(root, passes)
                tree.enforce(root, list(rules))
                lines.append(tree.outline(root))
            yield pd.DataFrame({"title": pdf["title"], "outline": lines})

    return pages.select("title", "text").mapInPandas(run, "title string, outline string")


def plain_texts(pages: DataFrame, passes: tuple = tree.PIPELINE) -> DataFrame:
    """(title, text) without markup."""
    return _map(pages, lambda title, root: [(tree.plain_text(root).strip(),)], "title string, text string", passes)


def section_table(pages: DataFrame, passes: tuple = tree.PIPELINE) -> DataFrame:
    """(title, index, section, text) of each section; the lead has an empty index."""
    return _map(pages, lambda title, root: tree.section_texts(root), "title string, index array<int>, section string, text string", passes)


def broken_rules(pages: DataFrame, rules: list[tuple[str, str, str, tuple[str, ...]]], passes: tuple = tree.PIPELINE) -> DataFrame:
    """(title, class, reach, constraint) of each node that breaks a rule."""
    return _map(pages, lambda title, root: tree.violations(root, rules), "title string, class string, reach string, constraint string", passes)


def node_histogram(nodes: DataFrame) -> DataFrame:
    """(class, weight): nodes of each class; text weighs its length."""
    weight = F.when(F.col("class") == "Text", F.length("caption")).otherwise(1)
    return nodes.groupBy("class").agg(F.sum(weight).cast("long").alias("weight"))


def children(nodes: DataFrame, of: DataFrame) -> DataFrame:
    """The nodes whose parent is among of (title, node_id)."""
    up = of.select(F.col("title").alias("_t"), F.col("node_id").alias("_p")).distinct()
    return nodes.join(up, (F.col("title") == F.col("_t")) & (F.col("parent_id") == F.col("_p")), "left_semi")


def _reached(nodes: DataFrame, of: DataFrame, down: bool) -> DataFrame:
    """(_t, _n): the nodes below of, or above, each once.

    A page's pairs of node and parent come together in one row, as they do when it is parsed, and are followed there to
    any depth: one shuffle of narrow rows, whatever the depth.
    """
    near, far = ("parent_id", "node_id") if down else ("node_id", "parent_id")
    pairs = nodes.where("title is not null and parent_id is not null").groupBy("title").agg(F.collect_list(near).alias("near"), F.collect_list(far).alias("far"))
    starts = of.where("title is not null").groupBy("title").agg(F.collect_set("node_id").alias("starts"))

    def run(batches):
        for batch in batches:
            titles, ids = [], []
            for title, near, far, left in zip(*(batch.column(k).to_pylist() for k in range(4))):
                steps, found = {}, set()
                for a, b in zip(near, far):
                    steps.setdefault(a, []).append(b)
                while left:
                    new = [n for n in steps.get(left.pop(), ()) if n not in found]
                    found.update(new)
                    left.extend(new)
                titles += [title] * len(found)
                ids += found
            yield pa.RecordBatch.from_arrays([pa.array(titles, pa.string()), pa.array(ids, pa.int64())], ["_t", "_n"])

    return pairs.join(starts, "title").select("title", "near", "far", "starts").mapInArrow(run, "_t string, _n long")


def _among(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    return nodes.join(ids, (F.col("title") == F.col("_t")) & (F.col("node_id") == F.col("_n")), "left_semi")


def descendants(nodes: DataFrame, of: DataFrame) -> DataFrame:
    """All nodes below of (title, node_id), each once."""
    return _among(nodes, _reached(nodes, of, down=True))


def ancestors(nodes: DataFrame, of: DataFrame) -> DataFrame:
    """All nodes above of (title, node_id); a node above several of them comes once."""
    return _among(nodes, _reached(nodes, of, down=False)).dropDuplicates(["title", "node_id"])


def siblings(nodes: DataFrame, of: DataFrame) -> DataFrame:
    """The other children of the parents of of (title, node_id, parent_id)."""
    own = of.select(F.col("title").alias("_t"), F.col("parent_id").alias("_p"), F.col("node_id").alias("_n"))
    near = nodes.join(own, (F.col("title") == F.col("_t")) & (F.col("parent_id") == F.col("_p")) & (F.col("node_id") != F.col("_n")), "left_semi")
    return near


def leaves(nodes: DataFrame) -> DataFrame:
    """Nodes without children."""
    up = nodes.select(F.col("title").alias("_t"), F.col("parent_id").alias("_p")).distinct()
    return nodes.join(up, (F.col("title") == F.col("_t")) & (F.col("node_id") == F.col("_p")), "left_anti")


def levels(pages: DataFrame, passes: tuple = tree.PIPELINE) -> DataFrame:
    """(title, node_id, level, text): how many nodes stand above each node, and the text of all below it."""

    def make(title: str, root: tree.Node) -> list[tuple]:
        return [(k, len(n.above()), n.text()) for k, n in enumerate(root.walk())]

    return _map(pages, make, "title string, node_id long, level long, text string", passes)
