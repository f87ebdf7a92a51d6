"""Text normalisation with ECMAScript semantics, as native Column expressions.

Java's ``\\s`` and Spark's ``trim`` differ from ECMAScript ``\\s``/``trim``; every
whitespace test in the library goes through ``WS`` below so behaviour matches
the listing rules exactly.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ECMAScript WhiteSpace + LineTerminator code points matched
# by `\s` and removed by String.prototype.trim.
WS_CHARS = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
# The same sets, with what most characters need tried first: Java goes through the members of a class one by one.
WS = r"[[\t\n\x0B\f\r \u00A0][\u1680-\uFEFF&&[" + WS_CHARS + "]]]"
NOT_WS = "[[!-~][^" + WS_CHARS + "]]"
# Any whitespace but a plain space, and the next line that ``$`` stands before as it does before a line's end.
_OTHER_WS = r"[[\t\n\x0B\f\r\u0085\u00A0][\u1680-\uFEFF&&[" + WS_CHARS + "]]]"

# Plain number literal accepted by the numeric coercion
# (decimal with optional sign, fraction and exponent; hex/octal/binary forms).
_DEC_RE = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_HEX_RE = r"^0[xX][0-9a-fA-F]+$"
_OCT_RE = r"^0[oO][0-7]+$"
_BIN_RE = r"^0[bB][01]+$"

_MAX_DOUBLE = 1.7976931348623157e308
_MAX_LONG_AS_DOUBLE = 9.2e18


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value, fn) -> Column:
    """Evaluate ``value`` once and pass it to ``fn`` (a single-element transform).

    Used where an expensive expression is referenced several times inside
    higher-order functions, which get no common-subexpression elimination.
    """
    return F.get(F.transform(F.array(value), fn), 0)


def normalize_ws(c) -> Column:
    """Collapse whitespace runs to one space and strip both ends.  Text with single plain spaces only is just trimmed."""
    def run(s):
        collapsed = F.regexp_replace(F.regexp_replace(s, WS + "+", " "), "^ | $", "")
        return F.when(~s.contains("  ") & ~s.rlike(_OTHER_WS), F.trim(s)).otherwise(collapsed)

    # A plain column name is cheap to repeat; any expression is bound once.
    return run(F.col(c)) if isinstance(c, str) else let(c, run)


def js_trim(c) -> Column:
    """String.prototype.trim: strip leading/trailing whitespace only."""
    return F.regexp_replace(col(c), "^" + WS + "+|" + WS + "+$", "")


def safe_trim(c) -> Column:
    """Blank or null -> null, otherwise whitespace-normalised text."""
    return let(normalize_ws(col(c)), lambda s: F.when(s != F.lit(""), s))


def is_non_empty(c) -> Column:
    return safe_trim(c).isNotNull()


def _codepoint_to_str(cp: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(cp), 8, "0")), "UTF-32")


def _replace_numeric(s: Column, kind: Column) -> Column:
    """Single global pass replacing each match of ``kind.pattern`` by its code point.

    The text between matches comes from ``split``; the captured digits from
    ``regexp_extract_all``; both are zipped back together.  Leading zeros do not count; more than ``kind.most``
    digits and out-of-range code points are left as written (the reference raises there).
    """
    found = F.struct(F.regexp_extract_all(s, kind["pattern"], F.lit(0)).alias("whole"), F.regexp_extract_all(s, kind["pattern"], F.lit(1)).alias("digits"))

    def piece(m):
        def one(p, i):
            digits = F.regexp_replace(F.get(m["digits"], i), "^0+(?=.)", "")
            cp = let(digits, lambda d: F.when(F.length(d) <= kind["most"], F.call_function("conv", d, kind["base"], F.lit(10)).try_cast("bigint")))
            char = let(cp, lambda c: F.when(c <= 0x10FFFF, _codepoint_to_str(c)))
            return F.concat(p, F.coalesce(char, F.get(m["whole"], i), F.lit("")))
        return one

    return let(found, lambda m: F.array_join(F.transform(F.split(s, kind["pattern"], -1), piece(m)), ""))


# Named entities, then numeric forms, in their order of replacement.
_NAMED = (("nbsp", " "), ("quot", '"'), ("#39", "'"), ("amp", "&"), ("lt", "<"), ("gt", ">"))
_NUMERIC = (("(?i)&#x([0-9a-f]+);", 16, 8), ("&#([0-9]+);", 10, 9))


def _pairs(rows, names) -> Column:
    return F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(row, names)]) for row in rows])


def decode_entities(c) -> Column:
    """Entity decoding in the reference's order: named, then hex, then decimal."""

    def decode(x: Column) -> Column:
        pairs = _pairs([(f"(?i)&{name};", char) for name, char in _NAMED], ("pattern", "char"))
        named = F.aggregate(pairs, x, lambda acc, e: F.regexp_replace(acc, e["pattern"], e["char"]))
        return let(named, lambda n: F.when(n.contains("&#"), F.aggregate(
            _pairs(_NUMERIC, ("pattern", "base", "most")), n, _replace_numeric)).otherwise(n))

    def run(x: Column) -> Column:
        return F.when(x.contains("&"), decode(x)).otherwise(x)

    # A plain column name is cheap to repeat; any expression is bound once.
    if isinstance(c, str):
        return run(F.col(c))
    return let(c, run)


def strip_tags(c) -> Column:
    """``<...>`` replaced by a space.  An open bracket behind the last ``>`` ends nowhere, so it is not tried."""
    def run(s):
        tail = F.substring_index(s, ">", -1)
        return F.when(tail.contains("<"), let(tail, lambda t: F.concat(
            F.regexp_replace(F.left(s, F.length(s) - F.length(t)), "<[^>]+>", " "), t))).otherwise(F.regexp_replace(s, "<[^>]+>", " "))

    return run(F.col(c)) if isinstance(c, str) else let(c, run)


def collapse_ws(c) -> Column:
    """Strip tags -> decode entities -> normalise whitespace."""
    return normalize_ws(decode_entities(strip_tags(c)))


def to_finite(c) -> Column:
    """Number(...) coercion of text; null unless finite.  Commas are dropped."""
    def parse(s):
        dec = F.when(s.rlike(_DEC_RE), s.try_cast("double"))

        def radix(base):
            # summed as doubles: literals of any length, no overflow error
            digits = F.regexp_extract_all(F.lower(F.regexp_replace(s, "^0.", "")), F.lit("."), F.lit(0))
            value = lambda d: F.call_function("locate", d, F.lit("0123456789abcdef")) - 1
            return F.aggregate(digits, F.lit(0.0), lambda acc, d: acc * F.lit(float(base)) + value(d))

        other = F.when(s.rlike(_HEX_RE), radix(16)).when(s.rlike(_OCT_RE), radix(8)).when(s.rlike(_BIN_RE), radix(2))
        return let(F.coalesce(dec, other), lambda v: F.when(F.abs(v) <= F.lit(_MAX_DOUBLE), v))

    return let(F.regexp_replace(normalize_ws(col(c)), ",", ""), parse)


def to_int(c) -> Column:
    """to_finite then truncate toward zero (BIGINT; out-of-range -> null)."""
    return let(to_finite(c), lambda v: F.when(F.abs(v) < F.lit(_MAX_LONG_AS_DOUBLE), v.cast("bigint")))


def num_to_int(v: Column) -> Column:
    return let(v, lambda x: F.when(F.abs(x) < F.lit(_MAX_LONG_AS_DOUBLE), x.cast("bigint")))


def unique_strings(arr) -> Column:
    """safe_trim each, drop nulls, keep first occurrence order."""
    return F.array_distinct(F.filter(F.transform(col(arr), lambda x: safe_trim(x)), lambda x: x.isNotNull()))


def first_non_null(*cols) -> Column:
    return F.coalesce(*[col(c) for c in cols])


def clamp(c, lo=None, hi=None) -> Column:
    v = col(c)
    if lo is not None:
        v = F.when(v.isNotNull(), F.greatest(v, F.lit(lo)))
    if hi is not None:
        v = F.when(v.isNotNull(), F.least(v, F.lit(hi)))
    return v


def iso_timestamp(ts) -> Column:
    return F.date_format(col(ts), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
