"""Fields of an HTML page as column expressions."""

from __future__ import annotations

from html.entities import name2codepoint
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

INVISIBLE = r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->"
TAG = r"(?s)<[^>]+>"
BLOCK = r"(?i)<(h[1-6]|p|li|div|footer)(?: [^>]*)?>"

# Entities that stand for something else than their Latin-1 character,
# or for none; the ampersand comes last.
ENTITIES = {
    "&lt;": "<",
    "&gt;": ">",
    "&quot;": '"',
    "&#39;": "'",
    "&nbsp;": " ",
    "&copy;": "©",
    "&middot;": "·",
    "&amp;": "&",
}


ENTITY = r"&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"
NAMED = {name: chr(code) for name, code in name2codepoint.items() if 160 <= code <= 255}
NAMED |= {entity[1:-1]: char for entity, char in ENTITIES.items()}


def _character(name: Column) -> Column:
    """What one entity stands for; one that is not known stays as it is."""
    hexadecimal = F.lower(F.substring(name, 2, 1)) == "x"
    code = F.when(
        name.startswith("#"),
        F.when(hexadecimal, F.conv(F.substring(name, 3, 8), 16, 10)).otherwise(F.substring(name, 2, 8)).cast("int"),
    )
    valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    # one code point in four bytes
    coded = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    known = F.create_map(*[F.lit(x) for x in chain(*NAMED.items())])
    return F.coalesce(
        F.try_element_at(known, name), F.when(valid, coded), F.concat(F.lit("&"), name, F.lit(";"))
    )


def decode(text: Column) -> Column:
    """Entities by number and by Latin-1 name, each decoded once."""

    def decoded(t: Column) -> Column:
        between = F.split(t, ENTITY, -1)
        found = F.transform(F.regexp_extract_all(t, F.lit(ENTITY), F.lit(1)), _character)
        parts = F.zip_with(between, found, lambda b, e: F.concat(b, F.coalesce(e, F.lit(""))))
        return F.when(F.contains(t, F.lit("&")), F.array_join(parts, "")).otherwise(t)

    return F.get(F.transform(F.array(text), decoded), F.lit(0))


def _first(html: Column, pattern: str) -> Column:
    found = F.regexp_extract(html, pattern, 1)
    return F.when(found != "", found)


def title(html: Column) -> Column:
    return decode(F.trim(_first(html, r"(?is)<title[^>]*>(.*?)</title>")))


def lang(html: Column) -> Column:
    return _first(html, r'(?i)<html[^>]* lang="([^"]*)"')


def charset(html: Column) -> Column:
    return _first(html, r'(?i)<meta[^>]* charset="([^"]*)"')


def body_text(html: Column) -> Column:
    """Visible text: hidden parts go first (a script may hold tags), then tags."""
    inside = F.regexp_replace(html, r"(?is)^.*?</head>", "")
    bare = F.regexp_replace(F.regexp_replace(inside, INVISIBLE, " "), TAG, " ")
    return F.trim(F.regexp_replace(decode(bare), r"[ \t\r\n]+", " "))


def metadata(html: Column) -> Column:
    """``map<name, content>`` of the meta tags; pairs without content drop out."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<meta [^>]*>"), F.lit(0))

    def pair(tag: Column) -> Column:
        name = F.coalesce(
            _first(tag, r'(?i) (?:name|property|http-equiv)="([^"]*)"'),
            F.when(charset(tag).isNotNull(), F.lit("charset")),
        )
        return F.struct(
            F.lower(name).alias("key"),
            F.coalesce(_first(tag, r'(?i) content="([^"]*)"'), charset(tag)).alias("value"),
        )

    pairs = F.filter(
        F.transform(tags, pair), lambda p: p["key"].isNotNull() & p["value"].isNotNull()
    )
    # the first pair of a name wins, as map keys have to be unique
    unique = F.filter(
        pairs,
        lambda p, i: ~F.exists(F.slice(pairs, F.lit(1), i), lambda q: q["key"] == p["key"]),
    )
    return F.map_from_entries(unique)


def links(html: Column) -> Column:
    """``array<struct<url, text>>`` of the page's anchors, in order: ``href`` among any
    attributes, in either quotes or none; markup inside an anchor is left out."""
    anchors = F.regexp_extract_all(html, F.lit(r"(?is)<a\s[^>]*>.*?</a>"), F.lit(0))

    def link(anchor: Column) -> Column:
        head = F.substring_index(anchor, ">", 1)
        quoted = r"(?is)\shref\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"']+)"
        target = F.regexp_extract(head, quoted, 1)
        url = F.when(target != "", F.regexp_replace(target, r"^[\"']|[\"']$", ""))
        text = F.regexp_replace(F.regexp_replace(anchor, r"(?is)^<a\s[^>]*>|</a>$", ""), TAG, "")
        return F.struct(decode(url).alias("url"), decode(text).alias("text"))

    return F.filter(F.transform(anchors, link), lambda z: z["url"].isNotNull())


def section_count(html: Column) -> Column:
    return F.size(F.regexp_extract_all(html, F.lit("(?i)<article"), F.lit(0)))


def problem(html: Column) -> Column:
    """Why a page cannot be read in full, or null."""
    return F.when(html.isNull(), F.lit("missing content")).when(
        ~F.contains(F.lower(html), F.lit("</html>")), F.lit("unterminated document")
    )
