"""Label parsing: rating / review count / likes from free text, result labels,
address-like text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS, col, let, safe_trim, to_finite, to_int

_W = "[A-Za-z0-9_]"
_B_BEFORE = "(?<!" + _W + ")"
_B_AFTER = "(?!" + _W + ")"

# Label patterns (English words as in the listing rules).
RATING_RE = "(?i)([0-5](?:\\.\\d+)?)" + WS + "*(?:stars?|★)"
COUNT_RE = "(?i)([\\d,]+)" + WS + "*reviews?"
LIKES_RE = "(?i)([\\d,]+)" + WS + "+likes?"
NUMERIC_SEGMENT_RE = "(?i)^[\\d.,]+" + WS + "*(?:stars?|reviews?|★)?$"
SEGMENT_SPLIT_RE = "[·•|]"
TITLE_SUFFIX_RE = "(?i)" + WS + "*-" + WS + "*google maps$"
# Address heuristics.
ADDRESS_NUMBER_RE = _B_BEFORE + "\\d{1,4}" + _B_AFTER
STREET_WORD_RE = "(?i)" + _B_BEFORE + "(?:street|st|road|rd|avenue|ave|lane|ln|boulevard|blvd)" + _B_AFTER
ADDRESS_WORDS_RE = "(?i)(tokyo|japan|shibuya|shinjuku|minato|chiyoda|setagaya|meguro|city|ward|ku|district)"


def segments(c) -> Column:
    """Split on · • | ; trim; drop blanks."""
    return F.filter(F.transform(F.split(col(c), SEGMENT_SPLIT_RE, -1), lambda s: safe_trim(s)),
                    lambda s: s.isNotNull())


def rating_count(text) -> Column:
    """struct<rating, review_count> from one text, null when neither is found."""
    def build(n):
        rating = F.when(n.rlike(RATING_RE), to_finite(F.regexp_extract(n, RATING_RE, 1)))
        count = F.when(n.rlike(COUNT_RE), to_int(F.regexp_extract(n, COUNT_RE, 1)))
        return let(F.struct(rating.alias("rating"), count.alias("review_count")),
                   lambda s: F.when(s["rating"].isNotNull() | s["review_count"].isNotNull(), s))

    return let(safe_trim(text), build)


def parse_result_label(label) -> Column:
    """struct<title, category, rating, review_count, snippet> of a search-result label."""

    def with_n(n):
        base = F.struct(
            segments(n).alias("segs"),
            F.regexp_extract(n, RATING_RE, 0).alias("rm"), F.regexp_extract(n, COUNT_RE, 0).alias("cm"),
            F.when(n.rlike(RATING_RE), to_finite(F.regexp_extract(n, RATING_RE, 1))).alias("rating"),
            F.when(n.rlike(COUNT_RE), to_int(F.regexp_extract(n, COUNT_RE, 1))).alias("review_count"),
        )

        def with_b(b):
            segs = b["segs"]
            title = F.coalesce(F.get(segs, 0), n)
            rest = F.slice(segs, 2, F.greatest(F.size(segs) - 1, F.lit(0)))
            category = F.get(F.filter(rest, lambda s: ~s.rlike(NUMERIC_SEGMENT_RE)), 0)

            def with_tc(tc):
                kept = F.filter(segs, lambda s: (s != tc["title"]) & ~s.eqNullSafe(tc["category"])
                                & (s != b["rm"]) & (s != b["cm"]))
                snippet = let(kept, lambda k: F.when(F.size(k) > 0, F.array_join(k, " · ")))
                return F.struct(tc["title"].alias("title"), tc["category"].alias("category"),
                                b["rating"].alias("rating"), b["review_count"].alias("review_count"),
                                snippet.alias("snippet"))

            return let(F.struct(title.alias("title"), category.alias("category")), with_tc)

        return F.when(n.isNotNull(), let(base, with_b))

    out = let(safe_trim(label), with_n)
    return F.coalesce(out, F.struct(
        F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("category"),
        F.lit(None).cast("double").alias("rating"), F.lit(None).cast("bigint").alias("review_count"),
        F.lit(None).cast("string").alias("snippet")))


def looks_like_address(c) -> Column:
    """A street word anywhere behind a house number, or a place word.  What follows the first number holds what follows
    any other, so one pass over it does: a pattern of both would go through the rest of the text for every number."""
    v = col(c)
    street = F.regexp_extract(v, ADDRESS_NUMBER_RE + "([\\s\\S]*)", 1).rlike(STREET_WORD_RE)
    return street | F.lower(v).rlike(ADDRESS_WORDS_RE)


def address_from_text(c) -> Column:
    """First address-like segment, else the whole text when address-like."""
    return let(safe_trim(c), lambda n: F.coalesce(
        F.get(F.filter(segments(n), lambda s: looks_like_address(s)), 0), F.when(looks_like_address(n), n)))


def normalize_place_title(c) -> Column:
    stripped = F.regexp_replace(safe_trim(c), TITLE_SUFFIX_RE, "")
    return F.regexp_replace(stripped, "^" + WS + "+|" + WS + "+$", "")
