"""License scans: Aho-Corasick over notice phrases and identifier tags, and a shunting-yard parser for licence
expressions."""

from __future__ import annotations

import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_of, key_of, text_of

#: Phrase (words joined by one space) -> label; counted in n_base, first_word and last_word.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Further notice phrases of the method.
NOTICES = {
    "apache license version 2 0": "apache-2.0", "apache software license": "apache", "licensed under the apache license": "apache",
    "mit license": "mit", "permission is hereby granted free of charge": "mit", "bsd license": "bsd", "3 clause bsd": "bsd-3-clause",
    "2 clause bsd": "bsd-2-clause", "redistribution and use in source and binary forms": "bsd", "isc license": "isc",
    "mozilla public license": "mpl", "eclipse public license": "epl", "lesser general public license": "lgpl",
    "affero general public license": "agpl", "gnu general public license version 2": "gpl-2.0", "gnu general public license version 3": "gpl-3.0",
    "cc by nc": "cc-by-nc", "cc by sa": "cc-by-sa", "cc by nd": "cc-by-nd", "cc by nc sa": "cc-by-nc-sa", "cc by nc nd": "cc-by-nc-nd",
    "cc0 1 0": "cc0", "public domain": "public-domain", "creative commons attribution": "cc-by", "boost software license": "bsl-1.0",
    "unlicense org": "unlicense", "proprietary and confidential": "proprietary",
}
#: Words after which an expression of licence identifiers stands.
TAGS = ("spdx license identifier", "license expression", "spdx license")
#: How much a licence family restricts reuse, by the first fitting prefix.
WEIGHTS = (("public-domain", 0.1), ("unlicense", 0.1), ("cc0", 0.1), ("mit", 0.2), ("bsd", 0.2), ("isc", 0.2), ("bsl", 0.2), ("zlib", 0.2),
           ("apache", 0.2), ("cc-by-nc", 0.8), ("cc-by-nd", 0.7), ("cc-by-sa", 0.5), ("cc-by", 0.3), ("mpl", 0.4), ("epl", 0.4),
           ("lgpl", 0.5), ("agpl", 0.8), ("gpl", 0.7), ("reserved", 1.0), ("proprietary", 1.0))
OTHER = 0.6
#: Names that licence identifiers begin with; an identifier is one of them, alone or followed by a version or a suffix.
FAMILIES = ("0bsd afl agpl apache artistic beerware bsd bsl cc cc0 cddl cecill curl epl eupl ftl gfdl gpl isc lgpl libpng mit mpl ms-pl ms-rl ncsa odbl ofl "
            "openssl osl php postgresql proprietary psf public-domain python ruby unlicense vim w3c wtfpl x11 zlib zpl").split()
_IDENTIFIER = re.compile("(?:licenseref|documentref)-.+|(?:" + "|".join(map(re.escape, FAMILIES)) + r")(?:[-+].*|v?\d.*)?|.*-exception(?:-.*)?")
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_EXPRESSION = re.compile(rb"[ \t]*[:=][ \t\"']*((?:[(]|[)]|[A-Za-z0-9][A-Za-z0-9.+-]*|[ \t])+)")
_TAG_TEXT = re.compile(rb"(?i)(?:spdx[^0-9A-Za-z\x80-\xff]+license(?:[^0-9A-Za-z\x80-\xff]+identifier)?|license[^0-9A-Za-z\x80-\xff]+expression)(?![0-9A-Za-z\x80-\xff])")
_RANK = {"or": 1, "and": 2, "with": 3}


def weight(label: str) -> float:
    return next((w for p, w in WEIGHTS if label.startswith(p)), OTHER)


def postfix(tokens: list[str]) -> list[str]:
    """Shunting-yard: operators or < and < with, left to right, with parentheses.  A token where an operator is due,
    or one that is no licence identifier where an operand is due, ends the expression (the text goes on); unbalanced parentheses and operators without operands are dropped."""
    out, ops, operand = [], [], False
    for t in tokens:
        low = t.lower()
        if t == "(":
            if operand:
                break
            ops.append(t)
        elif t == ")":
            if not operand or "(" not in ops:
                break
            while ops[-1] != "(":
                out.append(ops.pop())
            ops.pop()
        elif low in _RANK:
            if not operand:
                break
            while ops and ops[-1] != "(" and _RANK[ops[-1]] >= _RANK[low]:
                out.append(ops.pop())
            ops.append(low)
            operand = False
        else:
            if operand or not _IDENTIFIER.fullmatch(low):
                break
            out.append(low)
            operand = True
    if not operand and ops:  # a trailing operator
        while ops and ops[-1] == "(":
            ops.pop()
        if ops:
            ops.pop()
    return out + [o for o in reversed(ops) if o != "("]


def evaluate(expression: list[str]) -> tuple[set, float]:
    """(licence labels, restriction from 0 to 1) of a postfix expression: ``or`` takes the freer side, ``and`` the
    stricter, ``with`` (an exception) three quarters of its left side."""
    stack: list = []
    for t in expression:
        if t in _RANK and len(stack) >= 2:
            (b_labels, b), (a_labels, a) = stack.pop(), stack.pop()
            stack.append((a_labels, 0.75 * a) if t == "with" else (a_labels | b_labels, min(a, b) if t == "or" else max(a, b)))
        elif t not in _RANK:
            stack.append(({t}, weight(t)))
    return (set().union(*(x for x, _ in stack)), max(w for _, w in stack)) if stack else (set(), 0.0)


def automaton(base: dict = BASE, notices: dict = NOTICES, tags=TAGS):
    a = ahocorasick.Automaton()
    found: dict = {}
    for phrases, kind in ((base, "base"), (notices, "notice"), ({t: t for t in tags}, "tag")):
        for phrase, label in phrases.items():
            found.setdefault(f" {phrase} ", []).append((kind, label, phrase.count(" ") + 1))
    for key, value in found.items():
        a.add_word(key, (len(key), value))
    a.make_automaton()
    return a


def scan(text: bytes, a) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score) of one UTF-8 text."""
    words = text.translate(_WORDS).split()
    n_base, first, last, base, labels, score, tagged = 0, None, None, set(), set(), 0.0, False
    # phrases are at least as long as the shortest pattern; word starts come from the blanks before a match
    joined = " " + b" ".join(words).decode("utf-8", "replace") + " "
    at = None
    for end, (size, kinds) in a.iter(joined):
        if at is None:
            at = np.flatnonzero(np.frombuffer(joined.encode("utf-32-le"), "<u4") == 32)
        word = int(np.searchsorted(at, end - size + 1))
        for kind, label, _ in kinds:
            if kind == "tag":
                tagged = True
                continue
            labels.add(label)
            score = max(score, weight(label))
            if kind == "base":
                n_base, last = n_base + 1, max(word, last if last is not None else word)
                first = word if first is None else min(first, word)
                base.add(label)
    if tagged:
        for m in _TAG_TEXT.finditer(text):
            e = _EXPRESSION.match(text, m.end())
            if e:
                found, w = evaluate(postfix(re.findall(r"[()]|[^\s()]+", e[1].decode("ascii").rstrip(" \t.-"))))
                labels |= found
                score = max(score, w)
    return len(words), n_base, first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score


_SCHEMA = "k long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def _scan(base, notices, tags):
    def run(batches):
        a = automaton(base, notices, tags)
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                cols = zip(*[scan(t, a) for t in part.column(1).cast(pa.binary()).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, t) for c, t in zip(cols, kinds)]],
                                                 names=[c.split()[0] for c in _SCHEMA.split(", ")])
    return run


def scan_licenses(docs: DataFrame, base: dict = BASE, notices: dict = NOTICES, tags=TAGS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_words, n_base, first_word, last_word, base_labels, labels, score).

    Words are runs of letters, digits and non-ASCII characters with A-Z lower-cased; a phrase is found where its
    words stand consecutively, overlaps included.  ``labels`` adds the further notices and the identifiers of
    expressions after a tag; ``score`` is the strictest finding's restriction (0: none).  One pass, no shuffle.

    Null text has no words and no labels (empty strings, score 0); repeated rows are scanned alike; null ids stay
    null; an empty table gives no rows; other columns are not read.
    """
    out = docs.select(key_of(id_col).alias("k"), text_of(text_col).alias("t")).mapInArrow(_scan(base, notices, tuple(tags)), _SCHEMA)
    return out.select(id_of(F.col("k")).alias(id_col), *[c.split()[0] for c in _SCHEMA.split(", ")[1:]])
