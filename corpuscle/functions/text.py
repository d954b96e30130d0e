"""Text functions as column expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

# Replacements of the cleaning rules, in the order in which they apply.
_CLEAN = (
    ("==", " "), ("[[", " "), ("]]", " "), ("|", " "), ("[", " "), ("]", " "),
    ("*", ""), ("{", ""), ("}", ""), ("=", ""), (",", ""), (".", ""), (":", " "), ("\n", " "),
    (";", ""), ("(", " "), (")", " "), ("?", " "), ('"', " "), ("\t", " "), ("'", " "), ("/", ""),
)
_KEEP = (
    ("==", " "), ("[[", " "), ("]]", " "), ("|", " "), ("[", " "), ("]", " "),
    ("*", ""), ("{", ""), ("}", ""), ("=", ""), ("\n", " "), ("\t", " "), ("/", ""),
)
_SPACED = (";", "(", ")", "?", '"', ",", ".", ":")
#: A name and its digits or letters after '&', as a piece of text after '&' begins with them.
_REFERENCE = r"^(#[0-9]+|#x[0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);"


def tokens(text: Column) -> Column:
    """Words between runs of white space, without empty ones; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def tokens_single_space(text: Column) -> Column:
    """Words between single spaces; two spaces in a row enclose an empty word."""
    return F.split(F.coalesce(text, F.lit("")), " ", -1)


def _replaced(text: Column, pairs: Iterable[tuple[str, str]]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)<[^>]*>", "")


def _decoded(text: Column) -> Column:
    """One level of entities of a text, from left to right: what an entity stands for is not read again."""
    codes = F.create_map(*[F.lit(x) for pair in name2codepoint.items() for x in pair])

    def piece(part: Column, at: Column) -> Column:
        name = F.regexp_extract(part, _REFERENCE, 1)
        numeric = F.when(name.startswith("#x"), F.conv(F.substring(name, 3, 40), 16, 10)).otherwise(F.substring(name, 2, 40))
        code = F.when(name.startswith("#"), numeric.try_cast("long")).otherwise(F.try_element_at(codes, name).cast("long"))
        known = code.between(0, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        character = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        decoded = F.concat(character, F.substring(part, F.length(name) + 2, F.length(part)))
        return F.when(at == 0, part).when((name != "") & known, decoded).otherwise(F.concat(F.lit("&"), part))

    return F.array_join(F.transform(F.split(text, "&", -1), piece), "")


def decode_entities(text: Column) -> Column:
    """One level of every numeric entity and of the 252 named ones of HTML 4; others stay. Nothing leaves the JVM."""
    return F.when(F.contains(text, F.lit("&")), _decoded(text)).otherwise(text)


decode_all_entities = decode_entities


def strip_html(text: Column, every_entity: bool = True) -> Column:
    """Tags removed and one level of entities decoded, at once: an entity never spans a tag. Markup hidden in entities needs a second call.

    Without every_entity only tags go.
    """
    if not every_entity:
        return strip_tags(text)
    parts = F.array_join(F.transform(F.split(text, r"(?s)<[^>]*>", -1), _decoded), "")
    return F.when(F.contains(text, F.lit("&")), parts).otherwise(strip_tags(text))


def clean_document(text: Column) -> Column:
    """Markup and punctuation removed or turned into spaces."""
    return _replaced(text, _CLEAN)


def strip_wiki(text: Column) -> Column:
    """Images and templates dropped; a link becomes its second field, or its only one."""
    text = F.regexp_replace(text, r"\[\[Image.*?\]\]", "")
    link = r"\[\[(?:(?!\]\])[^|])*\|((?:(?!\]\])[^|])*)(?:\|(?:(?!\]\]).)*)?\]\]|\[\[((?:(?!\]\]).)*)\]\]"
    text = F.regexp_replace(text, link, "$1$2")
    text = F.regexp_replace(text, r"\{\{.*?\}\}", "")
    return F.regexp_replace(text, r"\{*?\}", "")


def clean_keep_punctuation(text: Column, space_punctuation: bool = False) -> Column:
    """Line feeds become ' <CR> ', wiki markup goes, punctuation stays (between spaces if asked), blanks collapse."""
    text = strip_wiki(F.replace(text, F.lit("\n"), F.lit(" <CR> ")))
    text = _replaced(text, _KEEP)
    if space_punctuation:
        text = _replaced(text, [(c, f" {c} ") for c in _SPACED])
    return F.regexp_replace(text, r"\s+", " ")


def drop_breaks(text: Column) -> Column:
    return F.replace(text, F.lit("<CR>"), F.lit(" "))


def drop_extraneous(text: Column) -> Column:
    """Words that start with a digit, a dash or a dollar sign removed."""
    return F.array_join(F.filter(F.split(text, " ", -1), lambda w: ~w.rlike(r"^[0-9\-$]")), " ")


def drop_non_alphabetic(text: Column) -> Column:
    """Only words of ASCII letters stay."""
    return F.array_join(F.filter(F.split(text, " ", -1), lambda w: w.rlike("^[A-Za-z]+$")), " ")


def wiki_links(text: Column) -> Column:
    """Every [[...]] within a line, in order, repeats included."""
    return F.regexp_extract_all(text, F.lit(r"(\[\[.*?\]\])"), 1)


def link_target(link: Column) -> Column:
    """A link without its brackets; an alias after | stays."""
    return F.replace(F.replace(link, F.lit("[["), F.lit("")), F.lit("]]"), F.lit(""))


def categories(title: Column, text: Column) -> Column:
    """Category links: anywhere in an article, only at the start of a line in a category page."""
    trimmed = F.regexp_replace(text, r"^\s+|\s+$", "")
    at_start = F.regexp_extract_all(trimmed, F.lit(r"(?m)^(\[\[Category:.*?\]\])"), 1)
    anywhere = F.regexp_extract_all(text, F.lit(r"(\[\[Category:.*?\]\])"), 1)
    return F.when(title.startswith("Category:"), at_start).otherwise(anywhere)


def is_redirect(text: Column) -> Column:
    """#redirect or #REDIRECT, in these cases only, within the first 20 characters."""
    return F.coalesce(F.substring(text, 1, 20).rlike("#redirect|#REDIRECT"), F.lit(False))


def redirect_target(text: Column) -> Column:
    """The page that a redirect names, without alias and section; null if it is none."""
    inner = F.regexp_extract(text, r"(?i)^#redirect:?\s*?\[\[(.*?)\]\]", 1)
    target = F.trim(F.regexp_extract(inner, r"^([^|#]*)", 1))
    return F.nullif(target, F.lit(""))


def normalize_title(title: Column) -> Column:
    """Trimmed, underscores as spaces, first letter upper case."""
    plain = F.replace(F.trim(title), F.lit("_"), F.lit(" "))
    return F.concat(F.upper(F.substring(plain, 1, 1)), F.substring(plain, F.lit(2), F.length(plain)))


def title_parts(title: Column) -> Column:
    """STRUCT<plain, label, prefix, rest>: a title without leading colons and underscores, what stands before its first colon (as it is and in lower case; null without one) and after it."""
    plain = F.replace(F.regexp_replace(F.trim(title), "^:+", ""), F.lit("_"), F.lit(" "))
    label = F.when(F.instr(plain, ":") > 0, F.trim(F.regexp_extract(plain, r"^([^:]*):", 1)))
    return F.struct(plain.alias("plain"), label.alias("label"), F.lower(label).alias("prefix"), F.trim(F.regexp_extract(plain, r"^[^:]*:(.*)$", 1)).alias("rest"))


def joined_title(parts: Column, number: Column) -> Column:
    """STRUCT<ns, partial, full> of title_parts' result and the number of the namespace that its prefix names, null for none."""
    upper = lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, F.lit(2), F.length(x)))
    rest = upper(F.when(number.isNotNull(), parts["rest"]).otherwise(parts["plain"]))
    full = F.when(number.isNotNull(), F.concat(upper(parts["label"]), F.lit(":"), rest)).otherwise(rest)
    return F.struct(F.coalesce(number, F.lit(0)).alias("ns"), rest.alias("partial"), full.alias("full"))


def split_title(title: Column, namespaces: dict[str, int]) -> Column:
    """STRUCT<ns, partial, full>: the namespace number that a known prefix names, the rest, and the normalised whole."""
    known = F.create_map(*[x for k, v in namespaces.items() for x in (F.lit(k.lower()), F.lit(v))])
    parts = title_parts(title)
    return joined_title(parts, F.try_element_at(known, parts["prefix"]))


def truncate_at_sentence(words: Column, limit: int) -> Column:
    """The first words up to limit, joined by spaces and cut after the last period; empty without one."""
    return F.regexp_extract(F.array_join(F.slice(words, 1, limit), " "), r"(?s)^(.*\.)", 1)


def sections(text: Column) -> Column:
    """ARRAY<STRUCT<level, title, body>>: the parts between heading lines; the lead has level 0 and no title."""
    heading = r"(?m)^(={1,6})[ \t]*(.+?)[ \t]*\1[ \t]*$"
    marked = F.regexp_replace(text, heading, "\u0001$1\u0002$2\u0002")
    return F.transform(
        F.split(marked, "\u0001"),
        lambda part: F.struct(
            F.when(F.instr(part, "\u0002") > 0, F.length(F.split_part(part, F.lit("\u0002"), F.lit(1)))).otherwise(0).alias("level"),
            F.when(F.instr(part, "\u0002") > 0, F.split_part(part, F.lit("\u0002"), F.lit(2))).alias("title"),
            F.trim(F.when(F.instr(part, "\u0002") > 0, F.split_part(part, F.lit("\u0002"), F.lit(3))).otherwise(part)).alias("body"),
        ),
    )


def key_hash(text: Column) -> Column:
    """The 32-bit hash h = h * 33 xor byte, from 5381, over the UTF-8 bytes of a key."""
    codes = F.transform(
        F.filter(F.split(F.regexp_replace(F.hex(F.encode(text, "UTF-8")), "(..)", "$1,"), ","), lambda x: x != ""),
        lambda x: F.conv(x, 16, 10).cast("long"),
    )
    return F.aggregate(codes, F.lit(5381).cast("long"), lambda h, c: (h * 33).bitwiseAND(F.lit(0xFFFFFFFF)).bitwiseXOR(c))


# The colour names of CSS and their digits.
_NAMED = """
aliceblue f0f8ff antiquewhite faebd7 aqua 00ffff aquamarine 7fffd4 azure f0ffff beige f5f5dc bisque ffe4c4 black 000000
blanchedalmond ffebcd blue 0000ff blueviolet 8a2be2 brown a52a2a burlywood deb887 cadetblue 5f9ea0 chartreuse 7fff00 chocolate d2691e
coral ff7f50 cornflowerblue 6495ed cornsilk fff8dc crimson dc143c cyan 00ffff darkblue 00008b darkcyan 008b8b darkgoldenrod b8860b
darkgray a9a9a9 darkgreen 006400 darkgrey a9a9a9 darkkhaki bdb76b darkmagenta 8b008b darkolivegreen 556b2f darkorange ff8c00
darkorchid 9932cc darkred 8b0000 darksalmon e9967a darkseagreen 8fbc8f darkslateblue 483d8b darkslategray 2f4f4f darkslategrey 2f4f4f
darkturquoise 00ced1 darkviolet 9400d3 deeppink ff1493 deepskyblue 00bfff dimgray 696969 dimgrey 696969 dodgerblue 1e90ff
firebrick b22222 floralwhite fffaf0 forestgreen 228b22 fuchsia ff00ff gainsboro dcdcdc ghostwhite f8f8ff gold ffd700 goldenrod daa520
gray 808080 green 008000 greenyellow adff2f grey 808080 honeydew f0fff0 hotpink ff69b4 indianred cd5c5c indigo 4b0082 ivory fffff0
khaki f0e68c lavender e6e6fa lavenderblush fff0f5 lawngreen 7cfc00 lemonchiffon fffacd lightblue add8e6 lightcoral f08080
lightcyan e0ffff lightgoldenrodyellow fafad2 lightgray d3d3d3 lightgreen 90ee90 lightgrey d3d3d3 lightpink ffb6c1 lightsalmon ffa07a
lightseagreen 20b2aa lightskyblue 87cefa lightslategray 778899 lightslategrey 778899 lightsteelblue b0c4de lightyellow ffffe0
lime 00ff00 limegreen 32cd32 linen faf0e6 magenta ff00ff maroon 800000 mediumaquamarine 66cdaa mediumblue 0000cd mediumorchid ba55d3
mediumpurple 9370db mediumseagreen 3cb371 mediumslateblue 7b68ee mediumspringgreen 00fa9a mediumturquoise 48d1cc
mediumvioletred c71585 midnightblue 191970 mintcream f5fffa mistyrose ffe4e1 moccasin ffe4b5 navajowhite ffdead navy 000080
oldlace fdf5e6 olive 808000 olivedrab 6b8e23 orange ffa500 orangered ff4500 orchid da70d6 palegoldenrod eee8aa palegreen 98fb98
paleturquoise afeeee palevioletred db7093 papayawhip ffefd5 peachpuff ffdab9 peru cd853f pink ffc0cb plum dda0dd powderblue b0e0e6
purple 800080 red ff0000 rosybrown bc8f8f royalblue 4169e1 saddlebrown 8b4513 salmon fa8072 sandybrown f4a460 seagreen 2e8b57
seashell fff5ee sienna a0522d silver c0c0c0 skyblue 87ceeb slateblue 6a5acd slategray 708090 slategrey 708090 snow fffafa
springgreen 00ff7f steelblue 4682b4 tan d2b48c teal 008080 thistle d8bfd8 tomato ff6347 turquoise 40e0d0 violet ee82ee wheat f5deb3
white ffffff whitesmoke f5f5f5 yellow ffff00 yellowgreen 9acd32
""".split()
COLOURS = dict(zip(_NAMED[::2], _NAMED[1::2]))


def css_colour(colour: Column) -> Column:
    """STRUCT<r, g, b, grey> in 0 to 1 of rgb(...), #rrggbb, #rgb or a name of CSS; null if it is none of them."""
    plain = F.lower(F.trim(colour))
    names = F.create_map(*[F.lit(x) for pair in COLOURS.items() for x in pair])
    short = F.regexp_replace(plain, r"^#([0-9a-f])([0-9a-f])([0-9a-f])$", "$1$1$2$2$3$3")
    digits = F.coalesce(F.try_element_at(names, plain), F.when(plain.rlike("^#[0-9a-f]{3}$"), short), F.when(plain.rlike("^#[0-9a-f]{6}$"), F.substring(plain, 2, 6)))
    listed = r"^rgb\(\s*(\d+)(%?)\s*,\s*(\d+)(%?)\s*,\s*(\d+)(%?)\s*\)$"

    def part(k: int) -> Column:
        number = F.regexp_extract(plain, listed, 2 * k + 1)
        share = F.when(F.regexp_extract(plain, listed, 2 * k + 2) == "%", F.lit(100.0)).otherwise(255.0)
        from_list = F.when(plain.rlike(listed), F.least(number.cast("double") / share, F.lit(1.0)))
        return F.coalesce(F.conv(F.substring(digits, 2 * k + 1, 2), 16, 10).cast("double") / 255.0, from_list)

    r, g, b = part(0), part(1), part(2)
    grey = F.lit(0.3) * r + F.lit(0.59) * g + F.lit(0.11) * b
    return F.when(r.isNotNull(), F.struct(r.alias("r"), g.alias("g"), b.alias("b"), grey.alias("grey")))


# Date fields by their letter, as patterns of Spark; the others of C's list depend on the locale.
_DATE_FIELDS = {
    "Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "j": "DDD", "a": "E", "A": "EEEE", "b": "MMM", "B": "MMMM", "p": "a",
}


def strftime(when: Column, pattern: str) -> Column:
    """A date or time as text by a pattern of percent letters, in the proleptic Gregorian calendar for any year."""
    parts = []
    for plain, letter in re.findall(r"([^%]+)|%(.?)", pattern, re.S):
        if plain or letter == "%":
            parts.append(F.lit(plain or "%"))
        elif letter in _DATE_FIELDS:
            parts.append(F.date_format(when, _DATE_FIELDS[letter]))
        else:
            raise ValueError(f"no such field: %{letter}")
    return F.concat(*parts) if parts else F.lit("")


def collection_id(*parts: Column) -> Column:
    """The first 16 hex digits of the md5 of the parts, joined by line feeds."""
    return F.substring(F.md5(F.concat_ws("\n", *parts).cast("binary")), 1, 16)


def safe_url(url: Column) -> Column:
    """The url with blanks in its path quoted; null without scheme or host."""
    scheme, host = F.regexp_extract(url, r"^([A-Za-z][\w+.-]*)://", 1), F.regexp_extract(url, r"^[A-Za-z][\w+.-]*://([^/?#]+)", 1)
    return F.when((scheme != "") & (host != ""), F.regexp_replace(F.trim(url), " ", "%20"))


def article_of_url(url: Column) -> Column:
    """STRUCT<title, oldid> of a wiki article's url: title and oldid parameters, or the last part of the path."""
    query_title = F.regexp_extract(url, r"[?&]title=([^&#]*)", 1)
    path_title = F.regexp_extract(url, r"^[a-z]+://[^/?#]+(?:/[^?#]*)?/([^/?#]*)", 1)
    title = F.replace(F.try_url_decode(F.when(query_title != "", query_title).otherwise(path_title)), F.lit("_"), F.lit(" "))
    return F.struct(F.nullif(title, F.lit("")).alias("title"), F.nullif(F.regexp_extract(url, r"[?&]oldid=(\d+)", 1), F.lit("")).cast("long").alias("oldid"))
