"""HTML element, attribute, meta, link and JSON-LD extraction as Column builders.

Elements are matched with the listing rules' regular expressions (non-overlapping,
case-insensitive, first close tag wins).  Each builder returns a Column, so a
caller can extract many things from one page in a single projection and drop
the HTML before anything is shuffled.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .text import NOT_WS, WS, WS_CHARS, col, collapse_ws, decode_entities, let, safe_trim

_WORD_END = "(?![A-Za-z0-9_])"  # ECMAScript \b after an ASCII word character


def tag_pattern(tag: str) -> str:
    """An open tag ``<tag ...>``; group 1 = attribute text."""
    return "(?i)<" + re.escape(tag) + _WORD_END + "([^>]*)>"


def close_pattern(tag: str) -> str:
    return "(?i)</" + re.escape(tag) + WS + "*>"


void_pattern = tag_pattern  # a body-less tag (img, meta, link) is its open tag


def before_last(text, mark: str = ">") -> Column:
    """``text`` up to and with the last ``mark`` (a single character), '' without one."""
    s = col(text)
    return F.left(s, F.length(s) - F.length(F.substring_index(s, mark, -1)))


class Pieces(NamedTuple):
    """A text already cut by ``cut``: given in place of the text, so that several lookups share one cut."""
    column: Column


def cut(text) -> Column:
    """array<struct<p, l, i>>: what stands before each ``>`` of the text, as written and in lower case, and its place.  An
    open tag ends with its piece, as its only ``>`` is its end; what follows the last ``>`` holds no tag and is left out."""
    return let(F.split(col(text), ">", -1), lambda s: F.transform(F.slice(s, F.lit(1), F.size(s) - 1), lambda p, i: F.struct(p.alias("p"), F.lower(p).alias("l"), i.alias("i"))))


def _with_pieces(text, fn) -> Column:
    return fn(text.column) if isinstance(text, Pieces) else let(cut(text), fn)


def _part(text: Column, pattern) -> Column:
    """The first match of a pattern that may be a Column ('' without one)."""
    return F.call_function("regexp_extract", text, pattern, F.lit(0))


def spans(text, start: Column, open_re: Column, close_re: Column, accept=None) -> Column:
    """array<struct<open, inner, close>>: what the pattern ``open_re`` + lazy body + ``close_re`` matches, in order and
    without overlaps, in time linear in the text.

    ``open_re`` is an open tag (its only ``>`` is its end) that begins with ``start`` ("(?i)<name"), ``close_re`` its
    close tag; ``accept`` may reject open tags.  Of the text's pieces only those with an open tag (O), a close tag (C) or
    both (B) count, found by a plain test for the tag's name before any pattern is tried.  From an open tag to the next
    piece that ends in a close tag is a match, and the search goes on behind it; opens behind the last close are never tried.
    """
    name = F.lower(F.replace(F.substr(start, F.lit(6)), F.lit("\\"), F.lit("")))

    opening, closing = F.concat(F.lit("<"), name), F.concat(F.lit("</"), name)

    def found(pieces):
        def named(q):
            return q["l"].contains(opening) | q["l"].contains(closing)

        def mark(q):
            def tried(has, pattern):
                return F.when(has, _part(F.concat(q["p"], F.lit(">")), pattern)).otherwise(F.lit(""))

            def kind(e):
                opens = (e["o"] != "") if accept is None else (e["o"] != "") & accept(e["o"])
                closes = e["c"] != ""
                return F.struct(q["i"].alias("i"), e["o"].alias("o"), e["c"].alias("c"), F.when(opens & closes, "B").when(opens, "O").when(closes, "C").alias("k"))

            opens, closes = q["l"].contains(opening), q["l"].contains(closing)
            return let(F.struct(tried(opens, open_re).alias("o"), tried(closes, close_re).alias("c")), kind)

        def element(s, e):
            body = F.array_join(F.transform(F.slice(pieces, s["i"] + 2, e["i"] - s["i"]), lambda q: q["p"]), ">")
            inner = let(body, lambda x: F.left(x, F.length(x) + 1 - F.length(e["c"])))
            return F.struct(s["o"].alias("open"), inner.alias("inner"), e["c"].alias("close"))

        def build(tags):
            marks = F.regexp_extract(F.array_join(F.transform(tags, lambda e: e["k"]), ""), "^.*[CB]", 0)
            bounds = F.split(F.regexp_replace(marks, "[OB]([^CB]*)[CB]", "S$1E"), "")
            # the n-th start and the n-th end belong together
            both = let(bounds, lambda m: F.struct(*[F.filter(tags, lambda e, n: F.get(m, n) == which).alias(which) for which in "SE"]))
            return let(both, lambda b: F.transform(b["S"], lambda s, n: element(s, F.get(b["E"], n))))

        return let(F.filter(F.transform(F.filter(pieces, named), mark), lambda e: e["k"].isNotNull()), build)

    return _with_pieces(text, found)


def element_array(html, tag: str) -> Column:
    """array<struct<open, inner, close>>: the ``<tag ...>inner</tag>`` elements in order, the first close tag winning."""
    return spans(html, F.lit("(?i)<" + re.escape(tag)), F.lit(tag_pattern(tag)), F.lit(close_pattern(tag)))


def elements_of(html, tags, attribute: str | None = None) -> Column:
    """array<struct<tag_ordinal, pos, open, inner, close>>: the elements of several tags, all of the first tag, then of
    the second...  With ``attribute`` those whose open tag names it: a cheap test before any attribute is parsed, and
    a tag that never stands before that name in one piece is not searched for.  Each tag has expressions of its own: a
    pattern that changes from tag to tag would be compiled anew for every text."""
    def in_pieces(pieces):
        def of(t, i):
            found = F.transform(element_array(Pieces(pieces), t), lambda e, p: F.struct(
                F.lit(i).alias("tag_ordinal"), p.alias("pos"), e["open"].alias("open"), e["inner"].alias("inner"), e["close"].alias("close")))
            if attribute is None:
                return found
            named = F.filter(found, lambda e: F.lower(e["open"]).contains(attribute.lower()))
            return F.when(F.exists(pieces, lambda q: q["l"].contains(attribute.lower()) & q["l"].contains("<" + t.lower())), named)

        return F.flatten(F.filter(F.array(*[of(t, i) for i, t in enumerate(tags)]), lambda x: x.isNotNull()))

    return _with_pieces(html, in_pieces)


def open_attrs(open_tag) -> Column:
    """Parsed attributes of an open tag.  What is glued to the tag's name and a final '/' do not count."""
    def source(s):
        head, end = F.regexp_extract(s, _TAG_HEAD_RE, 0), F.when(s.endswith("/>"), 2).when(s.endswith(">"), 1).otherwise(0)
        return F.substr(s, F.length(head) + 1, F.length(s) - F.length(head) - end)

    return parse_attrs(let(open_tag, source) if not isinstance(open_tag, str) else source(F.col(open_tag)))


def raw_element(e) -> Column:
    return F.concat(e["open"], e["inner"], e["close"])


def remove_spans(text, pattern: str, close_re: str, start: str) -> Column:
    """Each match of ``pattern``, which begins with ``start`` (lower case) in any case and ends in ``close_re``, replaced by
    a space; nothing behind the last close is tried."""
    def cut(s):
        head = F.regexp_extract(s, "(?is)^.*" + close_re, 0)
        return F.when(F.lower(s).contains(start), let(head, lambda h: F.concat(F.regexp_replace(h, pattern, " "), F.substr(s, F.length(h) + 1)))).otherwise(s)

    return let(col(text), cut)


# Attribute tokenizer: name (group 1), then optional = "dq" | 'sq' | unquoted (group 2, quotes included).  Plain
# characters are tried before the rest of each class.
ATTR_RE = (
    "([[!-.0-<?-~][^" + WS_CHARS + "=/>]]+)(?:" + WS + "*=" + WS + "*(\"[^\"]*\"|'[^']*'|[[!#-&(-;?-_a-~][^" + WS_CHARS + "\"'=<>`]]+))?"
)
# The start of an open tag, with what is glued to its name and the whitespace behind.
_TAG_HEAD_RE = "^[[!-=?-~][^" + WS_CHARS + ">]]*" + WS + "*"

DUPLICATE_KEYS = "spark.sql.variant.allowDuplicateKeys"

JSONLD_TYPE_RE = r"""(?i)type=["']application/ld\+json["']"""


def parse_attrs(src) -> Column:
    """array<struct<name, value>> in source order; names lower-cased, values decoded.  Two matching passes over the
    tag give aligned arrays of names and values."""
    def plain(v):
        return F.when(v.startswith('"') | v.startswith("'"), F.substr(v, F.lit(2), F.length(v) - 2)).otherwise(v)

    def zipped(s):
        values = F.regexp_extract_all(s, F.lit(ATTR_RE), F.lit(2))
        return let(values, lambda vs: F.transform(F.regexp_extract_all(s, F.lit(ATTR_RE), F.lit(1)), lambda n, i: F.struct(
            F.lower(n).alias("name"), decode_entities(plain(F.get(vs, i))).alias("value"))))

    return let(col(src), zipped)


def _lower_name(name) -> Column:
    return F.lit(name.lower()) if isinstance(name, str) else name


def attr(attrs, name) -> Column:
    """Value of attribute ``name`` (a text, or a Column of lower-case names; last duplicate wins); null when absent."""
    hit = F.try_element_at(F.filter(col(attrs), lambda a: a["name"] == _lower_name(name)), F.lit(-1))
    return hit["value"]


def has_attr(attrs, name) -> Column:
    return F.exists(col(attrs), lambda a: a["name"] == _lower_name(name))


def elements(html, tag: str, with_text: bool = True, with_raw: bool = False) -> Column:
    """array<struct<pos, attrs, inner[, text][, raw]>> for one tag, in document order."""
    def one(e, i):
        fields = [i.alias("pos"), open_attrs(e["open"]).alias("attrs"), e["inner"].alias("inner")]
        if with_text:
            fields.append(collapse_ws(e["inner"]).alias("text"))
        if with_raw:
            fields.append(raw_element(e).alias("raw"))
        return F.struct(*fields)

    return F.transform(element_array(html, tag), one)


def open_tags(html, tag: str) -> Column:
    """The ``<tag ...>`` tags of a page; what follows the last ``>`` holds none."""
    def in_pieces(pieces):
        found = F.transform(F.filter(pieces, lambda q: q["l"].contains("<" + tag.lower())), lambda q: F.regexp_extract(F.concat(q["p"], F.lit(">")), tag_pattern(tag), 0))
        return F.filter(found, lambda o: o != "")

    return _with_pieces(html, in_pieces)


def first(arr) -> Column:
    return F.get(col(arr), 0)


def meta_content(meta_attrs, criteria) -> Column:
    """First meta (document order) matching any criterion with non-blank content.

    ``criteria`` is a list of (attribute, expected) pairs with attribute in
    name / property / itemprop; comparison is case-sensitive after trimming.
    """

    def matches(a):
        cond = F.lit(False)
        for key, expected in criteria:
            cond = cond | (safe_trim(attr(a, key)) == F.lit(expected))
        return cond & safe_trim(attr(a, "content")).isNotNull()

    hit = first(F.filter(col(meta_attrs), matches))
    return decode_entities(safe_trim(attr(hit, "content")))


def link_href(link_attrs, rel: str) -> Column:
    """First <link> whose rel equals ``rel`` (any case) with a non-blank href."""
    hit = first(
        F.filter(
            col(link_attrs),
            lambda a: (F.lower(safe_trim(attr(a, "rel"))) == F.lit(rel.lower())) & safe_trim(attr(a, "href")).isNotNull(),
        )
    )
    return decode_entities(safe_trim(attr(hit, "href")))


def tag_attr_lists(html, tag: str) -> Column:
    """array<array<struct<name,value>>> — the parsed attributes of each void tag."""
    return F.transform(open_tags(html, tag), open_attrs)


def jsonld_objects(html) -> Column:
    """array<variant>: JSON-LD script bodies, top-level arrays flattened one level.

    Of a key that an object repeats the last value counts; Spark's parser needs a session setting for it, which is
    set here for the active session and read when the query is planned."""
    SparkSession.active().conf.set(DUPLICATE_KEYS, "true")
    bodies = F.transform(spans(html, F.lit("(?i)<script"), F.lit(tag_pattern("script")), F.lit("(?i)</script>"), lambda t: t.rlike(JSONLD_TYPE_RE)), lambda e: e["inner"])
    parsed = F.transform(bodies, lambda b: F.try_parse_json(F.regexp_replace(b, "^" + WS + "+|" + WS + "+$", "")))
    nested = F.transform(
        F.filter(parsed, lambda v: v.isNotNull()),
        lambda v: F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v)),
    )
    return F.filter(F.flatten(nested), lambda v: v.isNotNull())


# ---- VARIANT helpers (JSON-LD typing follows the reference's typeof tests) ----

def vget(v, key: str) -> Column:
    return F.try_variant_get(col(v), "$['" + key + "']", "variant")


def v_kind(v) -> Column:
    return F.schema_of_variant(col(v))


def v_is_string(v) -> Column:
    return F.coalesce(v_kind(v) == F.lit("STRING"), F.lit(False))


def v_is_object(v) -> Column:
    return F.coalesce(v_kind(v).startswith("OBJECT"), F.lit(False))


def v_string(v) -> Column:
    return F.when(v_is_string(v), F.try_variant_get(col(v), "$", "string"))


def v_text(v) -> Column:
    """Text form of a scalar (numbers as written) for numeric coercion."""
    return F.when(~v_is_object(v) & ~F.coalesce(v_kind(v).startswith("ARRAY"), F.lit(False)),
                  F.try_variant_get(col(v), "$", "string"))


def page_text(html) -> Column:
    return collapse_ws(html)


__all__ = [
    "ATTR_RE", "NOT_WS", "Pieces", "attr", "before_last", "close_pattern", "cut", "element_array", "elements", "elements_of", "first",
    "has_attr", "jsonld_objects", "link_href", "meta_content", "open_attrs", "open_tags", "page_text", "parse_attrs",
    "raw_element", "remove_spans", "spans", "tag_attr_lists", "tag_pattern", "v_is_object", "v_is_string", "v_kind",
    "v_string", "v_text", "vget", "void_pattern",
]
