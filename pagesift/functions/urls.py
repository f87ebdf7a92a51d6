"""URL expressions: resolution against the maps origin, comparable keys,
coordinates in paths and search URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS, col, let, normalize_ws, safe_trim, to_finite

# Base origin for relative links and the search endpoint.
BASE_ORIGIN = "https://www.google.com"
SEARCH_PREFIX = "https://www.google.com/maps/search/"

_SCHEME_RE = r"^([A-Za-z][A-Za-z0-9+.-]*):"
_HIER_RE = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)(.*)$"
COORD_RE = r"@(-?\d+(?:\.\d+)?),(-?\d+(?:\.\d+)?)"


def _encode_path_chars(s: Column) -> Column:
    # Characters the URL parser percent-encodes in paths (subset: space, quotes, angle brackets).
    for ch, enc in ((" ", "%20"), ('"', "%22"), ("<", "%3C"), (">", "%3E"), ("`", "%60")):
        s = F.replace(s, F.lit(ch), F.lit(enc))
    return s


_DOT_RE = r"(?i)/(?:\.|%2e){1,2}(?:/|$)"


def remove_dot_segments(path) -> Column:
    """A path with its ``.`` and ``..`` segments (also written ``%2e``) worked off: a stack of segments, of which ``..``
    takes the last; either at the end leaves a trailing slash.  Other paths are returned as they are."""
    def step(stack, e):
        dots = F.regexp_replace(F.lower(e["s"]), "%2e", ".")
        kept = F.when(dots == "..", F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0)))).when(dots == ".", stack)
        return F.when(dots.isin(".", ".."), F.when(e["last"], F.array_append(kept, F.lit(""))).otherwise(kept)).otherwise(F.array_append(stack, e["s"]))

    def fold(segments):
        each = F.transform(segments, lambda s, i: F.struct(s.alias("s"), (i == F.size(segments) - 1).alias("last")))
        return F.concat(F.lit("/"), F.array_join(F.aggregate(each, F.array().cast("array<string>"), step), "/"))

    return let(col(path), lambda p: F.when(p.rlike(_DOT_RE), let(F.split(F.substr(p, F.lit(2)), "/", -1), fold)).otherwise(p))


def resolve_url(href) -> Column:
    """Resolve a link against https://www.google.com and normalise it:
    lower-case scheme and host, default port dropped, empty path -> '/',
    backslashes as slashes, tabs/newlines removed, dot segments removed, spaces percent-encoded."""
    h0 = F.regexp_replace(col(href), "[\\t\\n\\r]", "")
    h0 = F.regexp_replace(h0, "^[\\x00-\\x20]+|[\\x00-\\x20]+$", "")

    def with_h(h):
        scheme = F.lower(F.regexp_extract(h, _SCHEME_RE, 1))
        has_scheme = h.rlike(_SCHEME_RE)
        special = scheme.isin("http", "https", "ws", "wss", "ftp")

        def with_hs(hs):
            absolute_special = F.concat(
                scheme, F.lit("://"),
                F.regexp_replace(F.lower(F.regexp_extract(hs, r"^[A-Za-z][A-Za-z0-9+.-]*:/*([^/?#]*)", 1)),
                                 r"^([^@]*@)?([^:]*):(443|80)$", "$1$2"),
                F.regexp_extract(hs, r"^[A-Za-z][A-Za-z0-9+.-]*:/*[^/?#]*(.*)$", 1),
            )
            return (
                F.when(has_scheme & special, absolute_special)
                .when(has_scheme, h)
                .when(hs.startswith("//"), F.concat(F.lit("https:"), hs))
                .when(hs.startswith("/"), F.concat(F.lit(BASE_ORIGIN), hs))
                .otherwise(F.concat(F.lit(BASE_ORIGIN + "/"), hs))
            )

        return let(F.when(special | ~has_scheme, F.regexp_replace(h, r"\\", "/")).otherwise(h), with_hs)

    out = let(h0, with_h)
    # empty path after the authority -> "/"
    out = F.regexp_replace(out, r"^([a-z][a-z0-9+.-]*://[^/?#]*)([?#]|$)", "$1/$2")
    return _encode_path_chars(let(out, _without_dots))


def _without_dots(url: Column) -> Column:
    head, path = r"^((?:https?|wss?|ftp)://[^/?#]*)", r"([^?#]*)"
    plain = remove_dot_segments(F.regexp_extract(url, head + path, 2))
    dotted = F.regexp_extract(url, head + path, 2).rlike(_DOT_RE)
    return F.when(dotted, F.concat(F.regexp_extract(url, head, 1), plain, F.regexp_extract(url, head + path + r"([\s\S]*)$", 3))).otherwise(url)


def url_key(url) -> Column:
    """origin + path of the resolved URL; query, hash and trailing slashes dropped."""
    def build(r):
        origin = F.concat(
            F.regexp_extract(r, r"^([a-z][a-z0-9+.-]*://)", 1),
            F.regexp_replace(F.regexp_extract(r, r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1), r"^[^@]*@", ""),
        )
        path = F.regexp_extract(r, r"^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
        return F.concat(origin, F.regexp_replace(path, "/+$", ""))

    return let(resolve_url(url), build)


def coords_from_url(url) -> Column:
    """struct<lat,lng> from the first `@lat,lng` in the URL; both or null."""
    def build(s):
        ll = F.struct(to_finite(F.regexp_extract(s, COORD_RE, 1)).alias("lat"),
                      to_finite(F.regexp_extract(s, COORD_RE, 2)).alias("lng"))
        return F.when(s.rlike(COORD_RE), let(ll, lambda v: F.when(v["lat"].isNotNull() & v["lng"].isNotNull(), v)))

    return let(safe_trim(url), build)


def encode_uri_component(c) -> Column:
    """encodeURIComponent: keeps A-Z a-z 0-9 - _ . ! ~ * ' ( )."""
    s = F.url_encode(col(c))
    for enc, ch in (("+", "%20"), ("%7E", "~"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")")):
        s = F.replace(s, F.lit(enc), F.lit(ch))
    return s


def search_url(keyword, region) -> Column:
    q = normalize_ws(F.concat(col(keyword), F.lit(" "), col(region)))
    return F.concat(F.lit(SEARCH_PREFIX), encode_uri_component(q))


# The listing-link patterns (host part optional, unanchored).
PLACE_LINK_RE = r"(?i)(?:https?://(?:www\.)?google\.[^/]+)?/maps/place/"
REVIEW_LINK_RE = r"(?i)(?:https?://(?:www\.)?google\.[^/]+)?/maps/review"


def is_listing_link(href, kind: str = "place") -> Column:
    return col(href).rlike(PLACE_LINK_RE if kind == "place" else REVIEW_LINK_RE)


__all__ = ["COORD_RE", "coords_from_url", "encode_uri_component", "is_listing_link", "resolve_url",
           "search_url", "url_key", "WS"]
