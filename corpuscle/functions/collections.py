"""Collections of articles, image maps and symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The forms of the lines of a collection page.
_TITLE, _SUBTITLE, _CHAPTER = r"^==\s+(.*?)\s+==$", r"^===\s+(.*?)\s+===$", r"^;(.*)$"
_ARTICLE = r"^:\[\[:?(.*?)(?:\|(.*?))?\]\]$"
_OLD = r"^:\[\{\{fullurl:(.*?)\|oldid=(.*?)\}\}(.*?)\]$"


def collection_items(pages: DataFrame) -> DataFrame:
    """(page, pos, kind, chapter, title, display_title, revision) of collection pages (page, text), a row for each line that counts.

    kind is title, subtitle, chapter or article; an article belongs to the last chapter before it.
    """
    lines = pages.select("page", F.posexplode(F.split("text", "\r?\n")).alias("pos", "l")).withColumn("l", F.trim("l"))
    of = lambda pattern, k=1: F.trim(F.regexp_extract("l", pattern, k))
    kind = (
        F.when(F.col("l").rlike(_SUBTITLE), "subtitle").when(F.col("l").rlike(_TITLE), "title").when(F.col("l").rlike(_CHAPTER), "chapter")
        .when(F.col("l").rlike(_ARTICLE), "article").when(F.col("l").rlike(_OLD), "old")
    )
    rows = lines.withColumn("k", kind).where("k is not null")
    title = F.when(F.col("k") == "subtitle", of(_SUBTITLE)).when(F.col("k") == "title", of(_TITLE)).when(F.col("k") == "chapter", of(_CHAPTER)).when(F.col("k") == "article", of(_ARTICLE)).otherwise(of(_OLD))
    shown = F.nullif(F.when(F.col("k") == "article", of(_ARTICLE, 2)).when(F.col("k") == "old", of(_OLD, 3)), F.lit(""))
    rows = rows.select("page", "pos", "k", title.alias("title"), shown.alias("display_title"), F.when(F.col("k") == "old", of(_OLD, 2)).alias("revision"))
    chapter = F.last(F.when(F.col("k") == "chapter", F.col("title")), ignorenulls=True).over(Window.partitionBy("page").orderBy("pos"))
    rows = rows.withColumn("chapter", F.when(F.col("k").isin("article", "old"), chapter))
    return rows.select("page", F.col("pos").cast("long").alias("pos"), F.when(F.col("k") == "old", "article").otherwise(F.col("k")).alias("kind"), "chapter", "title", "display_title", "revision")


def collection_checksum(items: DataFrame) -> DataFrame:
    """(page, checksum): the md5 of a collection's articles in order."""
    field = F.concat_ws("|", F.coalesce("title", F.lit("")), F.coalesce("revision", F.lit("")))
    listed = F.array_sort(F.collect_list(F.struct("pos", field.alias("f"))))
    joined = F.array_join(F.transform(listed, lambda x: x["f"]), "\n")
    return items.where("kind = 'article'").groupBy("page").agg(F.md5(joined.cast("binary")).alias("checksum"))


def assemble_book(items: DataFrame, articles: DataFrame) -> DataFrame:
    """items' articles with their text from articles (title, text); a missing one has none."""
    wanted = items.where("kind = 'article'")
    return wanted.join(articles.select("title", "text"), "title", "left")


def image_map(text: Column) -> Column:
    """ARRAY<STRUCT<shape, coords, link>> of an image map's poly, rect, circle, default and desc lines, in order.

    link is the caption without its brackets; that of desc is where the description goes. Comments and other lines go.
    """
    pattern = r"^(poly|rect|circle|default)\s*([\d\s.-]*?)\s*\[\[?(.*?)\]?\]$|^(desc)\s*(top-right|bottom-right|bottom-left|top-left|none)$"
    lines = F.filter(F.transform(F.split(text, "\r?\n"), lambda x: F.trim(x)), lambda x: x.rlike(pattern))

    def entry(line: Column) -> Column:
        group = lambda *at: F.concat(*[F.regexp_extract(line, pattern, k) for k in at])
        numbers = F.filter(F.split(group(2), r"\s+"), lambda n: n != "")
        return F.struct(group(1, 4).alias("shape"), F.transform(numbers, lambda n: n.cast("double")).alias("coords"), group(3, 5).alias("link"))

    return F.transform(lines, entry)


def image_of_map(text: Column) -> Column:
    """The image that an image map shows: its first line that is neither an area nor a description nor a comment; null without one."""
    known = r"^(?:#|(?:poly|rect|circle|default|desc)\b)"
    lines = F.filter(F.transform(F.split(text, "\r?\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.rlike(known))
    return F.get(lines, F.lit(0))


# Commands that formulas may use, and the LaTeX that stands for them.
SYMBOLS = dict(
    line.split(" ", 1)
    for line in r"""
\Bbb \mathbb
\Complex \mathbb{C}
\Dagger \ddagger
\Darr \Downarrow
\Harr \Leftrightarrow
\Larr \Leftarrow
\Lrarr \Leftrightarrow
\N \mathbb{N}
\O \emptyset
\R \mathbb{R}
\Rarr \Rightarrow
\Reals \mathbb{R}
\Uarr \Uparrow
\Z \mathbb{Z}
\alef \aleph
\alefsym \aleph
\and \land
\ang \angle
\arccos \mathop{\mathrm{arccos}}
\arccot \mathop{\mathrm{arccot}}
\arccsc \mathop{\mathrm{arccsc}}
\arcsec \mathop{\mathrm{arcsec}}
\bold \mathbf
\bull \bullet
\clubs \clubsuit
\cnums \mathbb{C}
\dArr \Downarrow
\darr \downarrow
\diamonds \diamondsuit
\empty \emptyset
\exist \exists
\ge \geq
\hAar \Leftrightarrow
\harr \leftrightarrow
\hearts \heartsuit
\image \Im
\infin \infty
\isin \in
\lArr \Leftarrow
\lang \langle
\larr \leftarrow
\le \leq
\lrArr \Leftrightarrow
\lrarr \leftrightarrow
\natnums \mathbb{N}
\ne \neq
\or \lor
\part \partial
\plusmn \pm
\rArr \Rightarrow
\rang \rangle
\rarr \rightarrow
\real \Re
\reals \mathbb{R}
\sdot \cdot
\sect \S
\sgn \mathop{\mathrm{sgn}}
\spades \spadesuit
\sub \subset
\sube \subseteq
\supe \supseteq
\thetasym \vartheta
\uArr \Uparrow
\uarr \uparrow
\weierp \wp
\Alpha A{}
\Beta B{}
\Epsilon E{}
\Zeta Z{}
\Eta H{}
\Iota I{}
\Kappa K{}
\Mu M{}
\Nu N{}
\Rho P{}
\Tau T{}
\Chi C{}
""".split("\n")
    if line
)


def tex_symbols(text: Column) -> Column:
    """Commands of SYMBOLS replaced, in one pass: a command is a backslash and all letters after it; what stands for it is not read again."""
    known = F.create_map(*[F.lit(x) for pair in SYMBOLS.items() for x in pair])
    parts = F.regexp_extract_all(text, F.lit(r"\\[a-zA-Z]+|[^\\]+|\\"), 0)
    return F.array_join(F.transform(parts, lambda x: F.when(x.startswith("\\"), F.coalesce(F.try_element_at(known, x), x)).otherwise(x)), "")


# First and last code point of the scripts that are told apart.
SCRIPTS = (
    ("latin", 0x0000, 0x024F), ("greek", 0x0370, 0x03FF), ("cyrillic", 0x0400, 0x052F), ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x06FF),
    ("devanagari", 0x0900, 0x097F), ("thai", 0x0E00, 0x0E7F), ("hangul", 0x1100, 0x11FF), ("kana", 0x3040, 0x30FF), ("cjk", 0x4E00, 0x9FFF), ("hangul", 0xAC00, 0xD7AF),
)


def script_classes() -> dict[str, str]:
    """What a regular expression's brackets hold for each script: its code points without blanks."""
    blanks = (*range(0x09, 0x0E), 0x20)
    out: dict[str, str] = {}
    for name, first, last in SCRIPTS:
        cuts = [first - 1, *[b for b in blanks if first <= b <= last], last + 1]
        parts = [rf"\x{{{a + 1:X}}}-\x{{{b - 1:X}}}" for a, b in zip(cuts, cuts[1:]) if b - a > 1]
        out[name] = out.get(name, "") + "".join(parts)
    return out


def script_runs(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, run, script, text): runs of characters of one script; blanks and unknown characters join the run before.

    Those at the start of a text count as latin. Runs are cut within the row, so that nothing is shuffled.
    """
    classes = script_classes()
    known = "".join(classes.values())
    other = f"[^{known}]"
    starts = [f"^{other}[{classes['latin']}{other}]*+", *[f"[{c}][{c}{other}]*+" for c in classes.values()]]
    runs = docs.select(key, F.posexplode(F.regexp_extract_all("text", F.lit("|".join(starts)), 0)).alias("pos", "text"))
    script = F.lit("latin")
    for name, c in classes.items():
        script = F.when(F.col("text").rlike(f"[{c}]"), name).otherwise(script)
    return runs.select(key, (F.col("pos") + 1).cast("long").alias("run"), script.alias("script"), "text")
