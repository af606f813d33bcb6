"""Find the social image of a page with regular expressions over the whole text."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsflow.functions.clean import first_present
from newsflow.functions.urls import is_web_url, resolve_url

# The meta names that carry a page's social image.
IMAGE_NAMES = (
    "og:image",
    "og:image:url",
    "og:image:secure_url",
    "twitter:image",
    "twitter:image:src",
)

# Comments, scripts and styles are consumed as units, so a meta tag inside one
# is never seen; left open, they run to the end of the page. Group 2 is the
# inside of a real meta tag. All alternatives share the leading bracket, which
# lets the matcher skip text quickly, and possessive quantifiers keep it from
# recursing or backtracking on long pages.
_META = (
    r"(?is)<(?:!--.*?(?:-->|\z)"
    r"|(script|style)(?=[\s/>]).*?(?:</\1(?=[\s/>])|\z)"
    r"|meta(?=[\s/>])((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)>)"
)
# One attribute: name, then a double-quoted, single-quoted or bare value.
_ATTRIBUTE = (
    r"(?s)([^\s/>=\"'][^\s/>=]*+)"
    r"(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"'][^\s>]*+))?)?"
)
# Names that are references without a semicolon too; the longest one counts.
_OPEN_NAMES = "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n)))
_ENTITY_PIECES = (
    rf"(?s)&#[0-9]++;?|&#[xX][0-9a-fA-F]++;?|&[A-Za-z][A-Za-z0-9]*+;|&(?:{_OPEN_NAMES})|[^&]++|&"
)
_BLANKS = " \t\n\r\f\u000b\u00a0"


def _named() -> Column:
    """All named character references, from the standard library's table, as one constant."""
    return F.from_json(F.lit(json.dumps(html5)), "map<string,string>")


def _numbered(piece: Column) -> Column:
    """Character of a numeric reference; numbers without one give the replacement character.

    Numbers of the C1 range mean Windows characters, as browsers read them.
    """
    digits = F.regexp_extract(piece, r"^&#0*([0-9]{1,9})[0-9]*;?$", 1).try_cast("bigint")
    hexa = F.conv(F.regexp_extract(piece, r"^&#[xX]0*([0-9a-fA-F]{1,8})[0-9a-fA-F]*;?$", 1), 16, 10)
    zero = F.when(piece.rlike(r"^&#(?:0+|[xX]0+);?$"), F.lit(0).cast("bigint"))
    code = F.coalesce(zero, digits, hexa.try_cast("bigint"))
    usable = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    code = F.when(usable, code).otherwise(0xFFFD)
    windows = [(n, bytes([n]).decode("cp1252", "ignore")) for n in range(0x80, 0xA0)]
    letter = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    mapped = F.create_map(*[F.lit(x) for n, c in windows if c for x in (n, c)])
    return F.coalesce(F.when(code.between(0x80, 0x9F), mapped[code.cast("int")]), letter)


def _decode_piece(piece: Column) -> Column:
    name = F.substr(piece, F.lit(2))
    # An unknown name that begins with a known open one is that one and the rest.
    known = F.regexp_extract(piece, rf"^&({_OPEN_NAMES})", 1)
    # Both names are looked up by one expression, so the plan holds the table once.
    letters = F.transform(F.array(name, known), lambda key: _named()[key])
    rest = F.substr(name, F.length(known) + 1)
    decoded = F.get(F.transform(F.array(letters), lambda f: F.coalesce(f[0], F.concat(f[1], rest), piece)), F.lit(0))
    return (
        F.when(piece.startswith("&#") & (F.length(piece) > 2), _numbered(piece))
        .when(piece.startswith("&") & (F.length(piece) > 1), decoded)
        .otherwise(piece)
    )


def _decoded(text: Column) -> Column:
    pieces = F.regexp_extract_all(text, F.lit(_ENTITY_PIECES), 0)
    whole = F.array_join(F.transform(pieces, _decode_piece), "")
    return F.when(F.contains(text, F.lit("&")), whole).otherwise(text)


def decode_entities(col: Column) -> Column:
    """Replace character references once: numeric ones and all named ones."""
    return F.get(F.transform(F.array(col), _decoded), F.lit(0))


def _attributes(tag: Column) -> Column:
    """Attributes of a tag in order: lower-cased name and raw value, NULL without one."""
    groups = [
        F.regexp_extract_all(tag, F.lit(_ATTRIBUTE), g).alias(k) for g, k in enumerate("ndqb", 1)
    ]
    return F.transform(
        F.arrays_zip(*groups),
        lambda a: F.struct(
            F.lower(a["n"]).alias("name"), F.concat(a["d"], a["q"], a["b"]).alias("value")
        ),
    )


def _last_value(attributes: Column, name: str) -> Column:
    """Raw value of the last attribute called ``name``, NULL when absent."""
    named = F.filter(attributes, lambda a: a["name"] == name)
    return F.try_element_at(named, F.lit(-1))["value"]


def social_images(html: Column) -> Column:
    """Contents of the page's social image tags, in document order."""
    # Each step hands its result to the next as array elements, so nothing is
    # matched twice. The three values are decoded by one expression, and only those
    # that hold a reference.
    tags = F.filter(
        F.regexp_extract_all(html, F.lit(_META), 2),
        lambda tag: tag.rlike(r"(?i)(?:og|twitter):image"),
    )
    values = F.transform(
        F.transform(tags, _attributes),
        lambda a: F.transform(F.array(*[_last_value(a, n) for n in ("property", "name", "content")]), _decoded),
    )
    wanted = F.filter(
        values,
        lambda v: F.lower(first_present(v[0], v[1])).isin(*IMAGE_NAMES) & (v[2] != ""),
    )
    return F.transform(wanted, lambda v: F.btrim(v[2], F.lit(_BLANKS)))


def social_image_url(html: Column, page_url: Column) -> Column:
    """First social image of a page that resolves to a web URL, NULL when none does."""
    resolved = F.transform(social_images(html), lambda ref: resolve_url(page_url, ref))
    return F.try_element_at(F.filter(resolved, is_web_url), F.lit(1))
