"""Files that queries make of the driver's tables and read back."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import LANGUAGES
from ..sources import staging

#: A document's title, in one of several namespaces; the same in Spark's SQL and DuckDB's.
TITLE = """CASE doc_id % 10 WHEN 0 THEN 'Category:c' || doc_id WHEN 1 THEN 'Template:t' || doc_id WHEN 2 THEN 'User:u' || doc_id
    WHEN 3 THEN 'Image:i' || doc_id WHEN 4 THEN 'Portal:p' || doc_id ELSE 'Doc ' || doc_id END"""

#: A page's wikitext with links, categories, languages and redirects, some of which lead to others; in both SQLs.
LINKED = (
    "CASE WHEN doc_id % 7 = 0 THEN '#' || CASE WHEN doc_id % 2 = 0 THEN 'REDIRECT' ELSE 'redirect' END || ' [[' || CASE WHEN doc_id % 3 = 0 THEN "
    + TITLE.replace("doc_id", "(doc_id + 7)")
    + " ELSE 'Doc ' || (doc_id + 1) END || CASE WHEN doc_id % 5 = 0 THEN '#top|see]]' ELSE ']]' END || CASE WHEN doc_id % 4 = 0 THEN ' [[a]] [[b]] [[c]] [[d]]' ELSE '' END"
    " ELSE 'T ' || replace(coalesce(text, ''), chr(13), ' ') || chr(10) || '{{box|x}} [[Doc ' || (doc_id * 3 % 1000) || '|shown]] [[Doc ' || (doc_id + 1) || ']] [[Image:x.png|thumb]] [[]]' || chr(10) || '[[Category:' || lang || ']] [[Category:'"
    " || CASE doc_id % 5 WHEN 0 THEN 'Letters' WHEN 1 THEN 'Pictures' ELSE 'Signs ' || (doc_id % 11) END || ']]' || chr(10) || '[[Category:' || source || ']]' || chr(10) || 'end'"
    + "".join(f" || CASE WHEN doc_id % {k + 2} = 0 THEN ' [[{name}:X ' || doc_id || ']]' ELSE '' END" for k, name in enumerate(LANGUAGES))
    + " END"
)


def written(rows: DataFrame, label: str, compression: str = "bzip2") -> str:
    path = staging.folder(rows.sparkSession, label)
    rows.write.option("compression", compression).text(path)
    return path


def xml(rows: DataFrame, root: str, label: str) -> str:
    """rows (value) as XML files, each with a root element around its part."""

    def wrap(batches):
        yield pd.DataFrame({"value": [f"<{root}>"]})
        yield from batches
        yield pd.DataFrame({"value": [f"</{root}>"]})

    return written(rows.mapInPandas(wrap, "value string"), label)


def dump_file(docs: DataFrame, body: Column) -> str:
    """documents as a dump: two revisions of each, the last one with the body, titles in several namespaces."""
    d = F.col("doc_id").cast("string")
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        body = F.replace(body, F.lit(old), F.lit(new))
    who = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("<ip>10.0.0."), F.col("doc_id") % 200, F.lit("</ip>"))).otherwise(F.concat(F.lit("<username>U"), d, F.lit("</username><id>"), d, F.lit("</id>")))
    minor = F.when(F.col("doc_id") % 2 == 0, "<minor/>").otherwise("")
    page = F.concat(
        F.lit("<page><title>"), F.expr(TITLE), F.lit("</title><id>"), d, F.lit("</id><revision><id>1</id><text>old</text></revision><revision><id>"), F.col("doc_id") + 5,
        F.lit("</id><timestamp>2009-09-29T00:00:00Z</timestamp><contributor>"), who, F.lit("</contributor>"), minor, F.lit("<text xml:space=\"preserve\">"), body, F.lit("</text></revision></page>"),
    )
    return xml(docs.select(page.alias("value")), "mediawiki", "dump.xml")
