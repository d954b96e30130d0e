"""Wikis by kind: a dump, a page store or a collection, with pages of another laid over."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import dump

#: Readers by kind: (spark, path) -> pages with at least title and text.
KINDS: dict[str, Callable[[SparkSession, str], DataFrame]] = {"dump": dump.read_dump, "store": dump.read_store, "collection": dump.read_collection, "zip": dump.read_zip, "flat": dump.read_flat, "none": lambda spark, path: dump.no_pages(spark)}


def open_wiki(spark: SparkSession, kind: str, path: str, over: DataFrame | None = None) -> DataFrame:
    """(title, text) of a wiki; rows of over (title, text) take the place of its own."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind!r}; known: {', '.join(KINDS)}")
    pages = KINDS[kind](spark, path).select("title", "text")
    return pages if over is None else dump.overlay(pages, over.select("title", "text"))


def build_store(spark: SparkSession, dump_path: str, path: str) -> None:
    """A page store of a dump, with the namespaces that the dump names."""
    dump.write_store(dump.read_dump(spark, dump_path, namespaces=dump.learned_namespaces(spark, dump_path)), path)
