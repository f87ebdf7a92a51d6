"""Helpers that emit DuckDB SQL text for the oracles (the independent check).

The oracle side only ever uses built-in SQL string functions over base columns
or over the given ``pages`` HTML; it never calls this library.
"""

# Fixed value: ECMAScript whitespace as an RE2 class.
D_WS = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def ws(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '{D_WS}+', ' ', 'g'), '^ | $', '', 'g')"


def decode_named(x: str) -> str:
    s = x
    for ent, rep in (("nbsp", " "), ("quot", '"'), ("#39", "''"), ("amp", "&"), ("lt", "<"), ("gt", ">")):
        s = f"regexp_replace({s}, '&{ent};', '{rep}', 'gi')"
    return s


def strip_tags(x: str) -> str:
    return f"regexp_replace({x}, '<[^>]+>', ' ', 'g')"


def collapse(x: str) -> str:
    return ws(decode_named(strip_tags(x)))


def elem_re(tag: str) -> str:
    return rf"(?i)<{tag}\b([^>]*)>([\s\S]*?)</{tag}{D_WS}*>"


def attr_val(src: str, name: str) -> str:
    """Double-quoted attribute value (enough for the generated test pages)."""
    return (f"regexp_extract({src}, '(?i)(?:^|{D_WS}){name}{D_WS}*={D_WS}*\"([^\"]*)\"', 1)")


def has_attr(src: str, name: str) -> str:
    return f"regexp_matches({src}, '(?i)(?:^|{D_WS}){name}(?:{D_WS}|=|$)')"


def sid(*parts: str) -> str:
    """stable id: first 16 hex of sha1 over normalised parts each followed by U+241F."""
    body = " || ".join(f"coalesce({ws(f'CAST({p} AS VARCHAR)')}, '') || '␟'" for p in parts)
    return f"substr(sha1({body}), 1, 16)"


def r10(x: str) -> str:
    """k -> 'k div 10 . k mod 10' text."""
    return f"(CAST(({x}) // 10 AS VARCHAR) || '.' || CAST(({x}) % 10 AS VARCHAR))"
