"""Pages of MediaWiki dumps, and a page store for point lookups."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text as X

# MediaWiki's namespace numbers by English and German name.
NAMESPACES = {
    "media": -2, "special": -1, "talk": 1, "user": 2, "user talk": 3, "project": 4, "wikipedia": 4, "wikipedia talk": 5,
    "image": 6, "file": 6, "image talk": 7, "file talk": 7, "mediawiki": 8, "mediawiki talk": 9, "template": 10,
    "template talk": 11, "help": 12, "help talk": 13, "category": 14, "category talk": 15, "portal": 100, "portal talk": 101,
    "spezial": -1, "diskussion": 1, "benutzer": 2, "benutzer diskussion": 3, "bild": 6, "datei": 6, "vorlage": 10,
    "hilfe": 12, "kategorie": 14,
}
KEPT = (0, 10, 14, 100)
# Names in other languages of the namespaces that articles, media, templates and categories have.
LOCAL_NAMES = {
    "en": {"talk": 1, "user": 2, "file": 6, "image": 6, "template": 10, "help": 12, "category": 14, "portal": 100},
    "de": {"diskussion": 1, "benutzer": 2, "datei": 6, "bild": 6, "vorlage": 10, "hilfe": 12, "kategorie": 14, "portal": 100},
    "fr": {"discussion": 1, "utilisateur": 2, "fichier": 6, "image": 6, "modèle": 10, "aide": 12, "catégorie": 14, "portail": 100},
    "es": {"discusión": 1, "usuario": 2, "archivo": 6, "imagen": 6, "plantilla": 10, "ayuda": 12, "categoría": 14, "portal": 100},
}


def namespace_table(spark: SparkSession, names: dict[str, dict[str, int]] | None = None) -> DataFrame:
    """(lang, name, ns): a dimension table of namespaces, by default of LOCAL_NAMES; any other of these columns does as well.

    The canonical names, in English, count in every language where they don't mean another namespace.
    """
    rows = [(lang, name, ns) for lang, of in (names or LOCAL_NAMES).items() for name, ns in ({k: v for k, v in LOCAL_NAMES["en"].items()} | of).items()]
    return spark.createDataFrame(rows, "lang string, name string, ns int")


def split_by_language(pages: DataFrame, namespaces: DataFrame) -> DataFrame:
    """pages (title, lang, ...) with ns, partial and full as split_title has them, each title by the names of its own language.

    namespaces (lang, name, ns) may hold any number of languages: it is joined by language and the title's prefix, in lower
    case. Names of no row's language match nothing; a null language has none; a name listed twice takes its least number.
    """
    lang, name, ns = "_ns_lang", "_ns_name", "_ns"
    known = namespaces.groupBy(F.col("lang").alias(lang), F.lower("name").alias(name)).agg(F.min("ns").cast("int").alias(ns))
    parts = X.title_parts(F.col("title"))
    joined = pages.join(known, (F.col("lang") == F.col(lang)) & (parts["prefix"] == F.col(name)), "left")
    found = X.joined_title(parts, F.col(ns))
    rest = [c for c in pages.columns if c.lower() not in ("ns", "partial", "full")]
    return joined.select(*["`" + c.replace("`", "``") + "`" for c in rest], found["ns"].alias("ns"), found["partial"].alias("partial"), found["full"].alias("full"))


def learned_namespaces(spark: SparkSession, path: str) -> dict[str, int]:
    """NAMESPACES with the names that the dump's <siteinfo> gives."""
    rows = spark.read.format("xml").option("rowTag", "namespace").schema("_key int, _VALUE string").load(path)
    found = {r._VALUE.lower(): r._key for r in rows.where("_VALUE is not null").distinct().collect()}  # some tens of names
    return NAMESPACES | found


def read_dump(spark: SparkSession, path: str, keep: tuple[int, ...] = KEPT, redirects: bool = True, namespaces: dict[str, int] | None = None) -> DataFrame:
    """(title, page_id, namespace_text, namespace, revid, timestamp, username, userid, minor, comment, text, redirect) of the last revisions."""
    pages = spark.read.format("xml").option("rowTag", "page").schema(schemas.DUMP_PAGE).load(path)
    last = F.try_element_at("revision", F.lit(-1))
    split = X.split_title(F.col("title"), namespaces or NAMESPACES)
    rows = pages.select(
        "title",
        F.col("id").alias("page_id"),
        F.when(split["ns"] != 0, F.substring_index("title", ":", 1)).otherwise("").alias("namespace_text"),
        split["ns"].alias("namespace"),
        last["id"].alias("revid"),
        F.try_to_timestamp(last["timestamp"]).alias("timestamp"),
        F.coalesce(last["contributor"]["username"], last["contributor"]["ip"]).alias("username"),
        last["contributor"]["id"].alias("userid"),
        last["minor"].isNotNull().alias("minor"),
        last["comment"].alias("comment"),
        F.coalesce(last["text"]["_VALUE"], F.lit("")).alias("text"),
    ).withColumn("redirect", X.redirect_target(F.col("text")))
    rows = rows.where(F.col("namespace").isin(list(keep)))
    return rows if redirects else rows.where("redirect is null")


def write_store(pages: DataFrame, path: str) -> None:
    """Parquet by namespace, sorted by title, with a Bloom filter on it: a lookup reads one row group."""
    ordered = pages.withColumn("key", X.normalize_title(F.col("title"))).repartition("namespace", "key").sortWithinPartitions("namespace", "key")
    ordered.write.partitionBy("namespace").option("compression", "zstd").option("parquet.bloom.filter.enabled#key", "true").parquet(path)


def read_store(spark: SparkSession, path: str, title: str | None = None, namespace: int | None = None) -> DataFrame:
    """All pages of a store, or those of a title or a namespace; both filters reach the files."""
    rows = spark.read.parquet(path)
    if namespace is not None:
        rows = rows.where(F.col("namespace") == namespace)
    return rows if title is None else rows.where(F.col("key") == X.normalize_title(F.lit(title)))


def overlay(base: DataFrame, over: DataFrame, key: str = "title") -> DataFrame:
    """over's row where it has one for the key, else base's."""
    names = [c for c in base.columns if c != key]
    mine = over.select(F.col(key).alias("_key"), F.struct(*names).alias("_over"))
    joined = base.select(key, F.struct(*names).alias("_base")).join(mine, F.col(key) == F.col("_key"), "full")
    row = F.coalesce("_over", "_base")
    return joined.select(F.coalesce("_key", key).alias(key), *[row[c].alias(c) for c in names])


def _parsed(column: str):
    kind = "map<string, struct<content: string, content_type: string, revision: string, url: string>>"
    return F.from_json(column, f"articles {kind}, templates {kind}, sources {kind}").alias("c")


def _entries(parsed: DataFrame) -> DataFrame:
    parts = []
    for name in ("articles", "templates", "sources"):
        entry = parsed.select(F.lit(name).alias("kind"), F.explode(f"c.{name}").alias("title", "item"))
        parts.append(entry.select("kind", "title", F.coalesce("item.content", "item.url").alias("text")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def read_collection(spark: SparkSession, path: str) -> DataFrame:
    """(kind, title, text) of a collection's content.json: its articles, templates and sources."""
    return _entries(spark.read.text(path, wholetext=True).select(_parsed("value")))


def unzip(files: DataFrame) -> DataFrame:
    """(path, name, text) of every member of the zip archives in files (path, content); what is no archive has none."""

    def run(batches):
        for pdf in batches:
            found = []
            for path, content in zip(pdf["path"], pdf["content"]):
                if content is not None and zipfile.is_zipfile(io.BytesIO(content)):
                    with zipfile.ZipFile(io.BytesIO(content)) as archive:
                        found += [(path, name, archive.read(name).decode("utf-8", "replace")) for name in archive.namelist()]
            yield pd.DataFrame(found, columns=["path", "name", "text"])

    return files.select("path", "content").mapInPandas(run, "path string, name string, text string")


def zipped_books(members: DataFrame) -> DataFrame:
    """(path, title, subtitle, articles) of unzip's rows, from metabook.json: titles in order, those of chapters among them."""
    item = "struct<type: string, title: string, items: array<struct<type: string, title: string>>>"
    book = members.where("name = 'metabook.json'").select("path", F.from_json("text", f"title string, subtitle string, items array<{item}>").alias("b"))
    titles = F.flatten(F.transform("b.items", lambda x: F.when(x["type"] == "chapter", F.transform(x["items"], lambda y: y["title"])).otherwise(F.array(x["title"]))))
    return book.select("path", "b.title", "b.subtitle", titles.alias("articles"))


def zipped_pages(members: DataFrame) -> DataFrame:
    """(kind, title, text) of unzip's rows, from content.json."""
    return _entries(members.where("name = 'content.json'").select(_parsed("text")))


def read_zip(spark: SparkSession, path: str) -> DataFrame:
    """(kind, title, text) of the collections in zip files."""
    return zipped_pages(unzip(spark.read.format("binaryFile").load(path)))


def read_flat(spark: SparkSession, path: str) -> DataFrame:
    """(title, text) of a flat file: records between form feeds, the first line of each its title."""
    rows = spark.read.option("lineSep", "\f").text(path).where("trim(value) != ''")
    return rows.select(F.trim(F.regexp_extract("value", r"^([^\n]*)", 1)).alias("title"), F.regexp_replace("value", r"^[^\n]*\n?", "").alias("text"))


def write_flat(pages: DataFrame, path: str) -> None:
    """pages (title, text) as read_flat reads them; a form feed becomes a blank."""
    title, text = (F.regexp_replace(F.coalesce(c, F.lit("")), p, " ") for c, p in (("title", r"[\f\n]"), ("text", r"\f")))
    pages.select(F.concat(title, F.lit("\n"), text).alias("value")).write.option("lineSep", "\f").text(path)


def recorded(pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """(kind, title, text): the pages (title, text) that wanted (title) asks for, as a collection holds them.

    Titles are compared normalised; a template is recorded under its own name.
    """
    asked = wanted.select(X.normalize_title(F.col("title")).alias("_t")).distinct()
    rows = pages.withColumn("_t", X.normalize_title(F.col("title"))).join(asked, "_t", "left_semi")
    split = X.split_title(F.col("title"), NAMESPACES)
    template = split["ns"] == NAMESPACES["template"]
    return rows.select(F.when(template, "templates").otherwise("articles").alias("kind"), F.when(template, split["partial"]).otherwise(F.col("title")).alias("title"), "text")


def no_pages(spark: SparkSession) -> DataFrame:
    """(title, text) of a wiki without pages."""
    return spark.createDataFrame([], "title string, text string")


def write_collection(pages: DataFrame, path: str) -> None:
    """A JSON line for each page: title, content, revision."""
    pages.select("title", F.col("text").alias("content"), F.col("revid").alias("revision")).write.json(path)
