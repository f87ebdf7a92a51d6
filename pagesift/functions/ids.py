"""Stable identifiers and slugs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .text import col, normalize_ws

# Fixed value: part separator of stable ids (U+241F SYMBOL FOR UNIT SEPARATOR).
ID_SEP = "␟"


def stable_id(*parts) -> Column:
    """First 16 hex chars of SHA-1 over whitespace-normalised parts, each followed
    by the separator; a null part contributes only the separator."""
    pieces = []
    for p in parts:
        c = col(p) if not isinstance(p, (int, float)) else F.lit(p)
        c = c.cast(StringType())
        pieces.append(F.coalesce(normalize_ws(c), F.lit("")))
        pieces.append(F.lit(ID_SEP))
    return F.substring(F.sha1(F.concat(*pieces)), 1, 16)


def slugify(c) -> Column:
    s = F.lower(normalize_ws(col(c)))
    s = F.regexp_replace(s, r"[^\p{L}\p{N}]+", "-")
    s = F.regexp_replace(s, "-+", "-")
    s = F.regexp_replace(s, "^-|-$", "")
    return F.when(F.length(s) > 0, s).otherwise(F.lit("item"))


def sanitize_filename(c) -> Column:
    return F.regexp_replace(slugify(c), r"[^\p{L}\p{N}.-]+", "-")


def join_key_parts(*parts) -> Column:
    return F.concat_ws("::", *[F.coalesce(col(p).cast(StringType()), F.lit("")) for p in parts])


def describe_place(name, category, region) -> Column:
    vals = [F.nullif(col(c), F.lit("")) for c in (name, category, region)]
    return F.concat_ws(" · ", *vals)
