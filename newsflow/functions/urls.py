"""URL functions built from regular expressions, so bad input gives NULL, not an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsflow.functions.clean import null_if_blank

# Component pattern of RFC 3986, appendix B: scheme, authority, path, query, fragment.
_PARTS = (
    r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)"
    r"(?:\?([^#]*))?(?:#(.*))?$"
)
_HTTPS_HOST = r"(?i)^https://(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^:/?#\[\]@]+)"

# IPv4 ranges that are private, loopback, link-local, reserved,
# documentation-only or multicast.
_CLOSED_IPV4 = (
    r"^(?:0|10|127)\.",
    r"^169\.254\.",
    r"^172\.(?:1[6-9]|2[0-9]|3[01])\.",
    r"^192\.0\.[02]\.",
    r"^192\.168\.",
    r"^198\.1[89]\.",
    r"^198\.51\.100\.",
    r"^203\.0\.113\.",
    r"^(?:22[4-9]|23[0-9]|24[0-9]|25[0-5])\.",
)
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_DOTTED_QUAD = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"
# Other spellings of a number as a host: plain, short-dotted, hexadecimal, octets
# out of range or with leading zeros, which some readers take for octal.
_NUMERIC_HOST = r"^(?:0x[0-9a-f]*|[0-9]+)(?:\.(?:0x[0-9a-f]*|[0-9]+))*$"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, _PARTS, group)


def percent_encode(col: Column) -> Column:
    """Percent-encode everything but letters, digits and ``_.-~``."""
    encoded = F.url_encode(col)
    encoded = F.replace(encoded, F.lit("+"), F.lit("%20"))
    encoded = F.replace(encoded, F.lit("*"), F.lit("%2A"))
    return F.replace(encoded, F.lit("%7E"), F.lit("~"))


def https_host(url: Column) -> Column:
    """Lower-cased host of an https URL, trailing dots removed; otherwise NULL."""
    host = F.regexp_extract(url, _HTTPS_HOST, 1)
    return null_if_blank(F.regexp_replace(F.lower(host), r"\.+$", ""))


def admissible_image_url(url: Column) -> Column:
    """True for an https URL whose host is not a closed address.

    Only the host as written is judged; names are not resolved. Any IPv6
    literal, any non-dotted number and ``localhost`` are refused.
    """
    host = https_host(url)
    quad = host.rlike(_DOTTED_QUAD)
    closed = host.rlike("|".join(_CLOSED_IPV4))
    odd = host.rlike(_NUMERIC_HOST) | host.startswith("[") | host.rlike(r"(?:^|\.)localhost$")
    return F.coalesce(F.when(quad, ~closed).otherwise(~odd), F.lit(False))


def is_web_url(url: Column) -> Column:
    """True where the URL starts with ``http://`` or ``https://``."""
    return url.startswith("http://") | url.startswith("https://")


def _clean_path(path: Column) -> Column:
    """Absolute path with ``.`` and ``..`` segments applied."""
    segments = F.split(F.regexp_replace(path, r"/$", ""), "/")
    kept = F.aggregate(
        F.filter(segments, lambda s: s != "."),
        F.array().cast("array<string>"),
        lambda done, s: F.when(
            s == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        ).otherwise(F.array_append(done, s)),
        lambda done: F.array_join(done, "/"),
    )
    return F.get(F.transform(F.array(kept), lambda k: _rooted(k, path)), F.lit(0))


def _rooted(joined: Column, path: Column) -> Column:
    absolute = F.when(joined.startswith("/"), joined).otherwise(F.concat(F.lit("/"), joined))
    directory = path.rlike(r"(?:^|/)\.{0,2}$") & (joined != "")
    return F.when(directory, F.concat(absolute, F.lit("/"))).otherwise(absolute)


def resolve_url(base: Column, ref: Column) -> Column:
    """Resolve ``ref`` against the absolute web URL ``base``.

    A reference with another scheme is returned unchanged, one with its own
    host keeps its path, and a bare path is merged with the path of ``base``.
    """
    names = ("scheme", "host", "path", "query", "fragment")
    cleaned = F.regexp_replace(ref, r"[\t\r\n]", "")
    parts = F.struct(
        base.alias("base"),
        cleaned.alias("ref"),
        *[_part(base, i).alias(f"base_{n}") for i, n in enumerate(names, 1)],
        *[_part(cleaned, i).alias(n) for i, n in enumerate(names, 1)],
    )
    # The one-element array binds the components, so each is extracted once.
    return F.get(F.transform(F.array(parts), _join_parts), F.lit(0))


def _join_parts(p: Column) -> Column:
    scheme, host, path = F.lower(p["scheme"]), p["host"], p["path"]
    base_scheme, base_path = F.lower(p["base_scheme"]), p["base_path"]
    own_host, same_document = host != "", path == ""

    folder = F.concat(F.lit("/"), F.regexp_replace(base_path, r"[^/]*$", ""))
    relative = F.concat(
        F.regexp_replace(folder, r"/+", "/"), F.regexp_replace(path, r"/+", "/")
    )
    merged = F.when(path.startswith("/"), path).otherwise(relative)
    full_path = (
        F.when(own_host, path).when(same_document, base_path).otherwise(_clean_path(merged))
    )
    inherits_query = ~own_host & same_document & (p["query"] == "")
    query = F.when(inherits_query, p["base_query"]).otherwise(p["query"])
    joined = F.concat(
        base_scheme,
        F.lit("://"),
        F.when(own_host, host).otherwise(p["base_host"]),
        full_path,
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""),
        F.when(p["fragment"] != "", F.concat(F.lit("#"), p["fragment"])).otherwise(""),
    )
    foreign = (scheme != "") & (scheme != base_scheme)
    return F.when(p["ref"] == "", p["base"]).when(foreign, p["ref"]).otherwise(joined)
