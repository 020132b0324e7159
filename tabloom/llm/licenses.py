"""Licence scans: identifier tags and notice phrases by Aho-Corasick, expressions by shunting-yard.

A text is reduced to its lower-cased words, joined by single spaces; one Aho-Corasick pass over
that string finds all phrases, however many there are. Tags ("SPDX-License-Identifier:") are
found the same way in the lower-cased text. What stands behind one on its line starts with a
licence expression, with the operators with, and, or (strongest first) and parentheses: the longest
beginning that is well formed and whose operands look like licence ids is turned to postfix order
by the shunting-yard method and evaluated against the permitted ids.

The score is the strength of the evidence, 1 - product of (1 - weight) over the distinct labels
and tags found: from 0 for nothing to nearly 1 for several.

Defined results: null or empty text has no words, labels "" and score 0; a tag behind which no
expression begins gives the label "unparsed"; base phrases all count, of our own those that don't lie
inside another one; repeated rows are scanned one by one; an empty table gives an empty one. Extra columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The contract's phrases and labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notices with labels and weights of our own. Words of the notices themselves.
NOTICES = {
    "mit license": ("mit", 0.7),
    "permission is hereby granted free of charge": ("mit", 0.8),
    "gnu general public license": ("gpl", 0.7),
    "redistribution and use in source and binary forms": ("bsd", 0.8),
    "bsd license": ("bsd", 0.7),
    "neither the name of the copyright holder nor the names of its contributors": ("bsd-3-clause", 0.8),
    "permission to use copy modify and or distribute this software for any purpose": ("isc", 0.8),
    "this software is provided as is without any express or implied warranty": ("zlib", 0.5),
    "boost software license": ("bsl-1.0", 0.7),
    "creative commons attribution": ("cc-by", 0.7),
    "creative commons": ("cc", 0.4),
    "cc by sa": ("cc-by-sa", 0.8),
    "cc by nc": ("cc-by-nc", 0.8),
    "cc by nd": ("cc-by-nd", 0.8),
    "cc0": ("cc0", 0.7),
    "public domain": ("public-domain", 0.4),
    "unlicense": ("unlicense", 0.6),
    "sil open font license": ("ofl", 0.7),
    "open data commons": ("odc", 0.5),
    "proprietary and confidential": ("proprietary", 0.6),
    "no part of this publication may be reproduced": ("reserved", 0.6),
}
#: Licences that come in versions: name, id, weight without a version, versions. Fixed values.
FAMILIES = (
    ("apache license", "apache", 0.6, ("1.0", "1.1", "2.0")),
    ("general public license", "gpl", 0.5, ("1", "2", "3")),
    ("lesser general public license", "lgpl", 0.7, ("2.1", "3")),
    ("library general public license", "lgpl", 0.7, ("2",)),
    ("affero general public license", "agpl", 0.7, ("1", "3")),
    ("free documentation license", "gfdl", 0.7, ("1.1", "1.2", "1.3")),
    ("mozilla public license", "mpl", 0.7, ("1.0", "1.1", "2.0")),
    ("eclipse public license", "epl", 0.7, ("1.0", "2.0")),
    ("european union public licence", "eupl", 0.7, ("1.1", "1.2")),
    ("common development and distribution license", "cddl", 0.7, ("1.0", "1.1")),
    ("common public license", "cpl", 0.7, ("1.0",)),
    ("artistic license", "artistic", 0.6, ("1.0", "2.0")),
    ("academic free license", "afl", 0.7, ("2.1", "3.0")),
    ("open software license", "osl", 0.7, ("2.1", "3.0")),
    ("python software foundation license", "psf", 0.7, ("2",)),
    ("open font license", "ofl", 0.7, ("1.0", "1.1")),
    ("attribution sharealike", "cc-by-sa", 0.6, ("2.0", "2.5", "3.0", "4.0")),
    ("attribution noncommercial", "cc-by-nc", 0.6, ("2.0", "3.0", "4.0")),
    ("attribution noderivatives", "cc-by-nd", 0.6, ("3.0", "4.0")),
)
_VERSIONED = 0.9


def notices() -> dict[str, tuple[str, float]]:
    """All phrases of our own: NOTICES, and for each family its name alone and before its versions,
    as "name version 2 0", "name v2 0" and "name 2 0"."""
    out = dict(NOTICES)
    for name, label, weight, versions in FAMILIES:
        out.setdefault(name, (label, weight))
        for v in versions:
            spoken = v.replace(".", " ")
            for link in ("version ", "v", ""):
                out[f"{name} {link}{spoken}"] = (f"{label}-{v if '.' in v else v + '.0'}", _VERSIONED)
    return out


PHRASES = notices()
_BASE_WEIGHT, _TAG_WEIGHT, _UNPARSED_WEIGHT = 0.5, 0.95, 0.3
TAG = "spdx-license-identifier:"
UNPARSED = "unparsed"
#: Ids without a digit or hyphen, which only this list tells from other words. Fixed values.
PLAIN_IDS = frozenset("0bsd aal adsl afmparse aladdin apafml bahyph barr beerware borceux caldera cdl condor crossword crystalstacker cube curl diffmark doc dotseqn dsdp dvipdfm ecos egenix entessa eudatagrid eurosym fair freeimage fsful fsfullr ftl giftware gl2ps glide glulxe gnuplot gsoap haskellreport hpnd icu ijg imagemagick imatix info-zip intel isc jasper json latex2e leptonica libpng libtiff linux-openib makeindex minpack miros mit motosoto mpich2 mtll multics mup naumen ncsa netcdf newsletr ngpl nlpl nokia nosl noweb ntp oclc ofl oml openssl plexus postgresql psfrag psutils qhull rdisc rsa-md ruby saxpath scea sendmail sissl sleepycat snia swl tcl tmate torque tosl unlicense vim vostrom vsl w3c watcom wsuipa wtfpl x11 xerox xinetd xnet xpp xskat zed zlib".split())
#: What evaluate() is asked about each expression in the query: ids that ask for no more than a notice.
PERMISSIVE = ("0bsd", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "bsl-1.0", "cc0-1.0", "isc", "mit", "unlicense", "zlib")

_STRENGTH = {"with": 3, "and": 2, "or": 1}
_ID = re.compile(r"[a-z0-9.+:_-]+")
_TOKEN = re.compile(r"[()]|[A-Za-z0-9.+:_-]+|\S")
#: A-Z to a-z; all ASCII bytes but letters and digits to a space. Bytes of other characters stay.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256))


def _read(tokens: Iterable[str], is_id: Callable[[str], bool]) -> tuple[list[str] | None, bool]:
    """Postfix order of the longest well-formed beginning of tokens (None if there is none), and
    whether that is all of them."""
    out: list[str] = []
    held: list[str] = []
    best, whole = None, False
    operand = True  # an id or an opening parenthesis is due
    for token in tokens:
        word, whole = token.lower(), False
        if operand and word == "(":
            held.append(word)
        elif operand and word not in _STRENGTH and is_id(word):
            out.append(word)
            operand = False
        elif not operand and word in _STRENGTH:
            while held and held[-1] != "(" and _STRENGTH[held[-1]] >= _STRENGTH[word]:
                out.append(held.pop())
            held.append(word)
            operand = True
        elif not operand and word == ")" and "(" in held:
            while held[-1] != "(":
                out.append(held.pop())
            held.pop()
        else:
            return best, False
        if not operand and "(" not in held:
            best, whole = out + held[::-1], True
    return best, whole


def postfix(expression: str) -> list[str]:
    """The expression's ids (lower case) and operators in postfix order; ValueError if it is malformed."""
    found, whole = _read(_TOKEN.findall(expression), lambda w: _ID.fullmatch(w) is not None)
    if found is None or not whole:
        raise ValueError(expression)
    return found


def _likely(word: str) -> bool:
    """Whether a word looks like a licence id: a listed one, or one with a hyphen, or a digit after a letter."""
    return word in PLAIN_IDS or (_ID.fullmatch(word) is not None and re.search(r"[a-z0-9]-[a-z0-9]|[a-z].*[0-9]", word) is not None)


def leading(text: str) -> list[str] | None:
    """Postfix order of the expression that text begins with; None if there is none."""
    tokens = (t.rstrip(".:_-") or t for t in _TOKEN.findall(text))
    return _read(tokens, _likely)[0]


def met(order: list[str], permitted: Iterable[str]) -> bool:
    """Whether an expression in postfix order can be met with permitted ids; "a with b" needs "a with b" or a permitted."""
    allowed, stack = {p.lower() for p in permitted}, []
    for token in order:
        if token in _STRENGTH:
            (right, r), (left, l_) = stack.pop(), stack.pop()
            if token == "with":
                stack.append((f"{left} with {right}", l_ or f"{left} with {right}" in allowed))
            else:
                stack.append(("", (l_ and r) if token == "and" else (l_ or r)))
        else:
            stack.append((token, token in allowed))
    return stack[0][1]


def evaluate(expression: str, permitted: Iterable[str]) -> bool:
    return met(postfix(expression), permitted)


def ids(order: list[str]) -> set[str]:
    """Licence ids of an expression in postfix order; what follows "with" is an exception, no licence."""
    stack: list[set[str]] = []
    for token in order:
        if token in _STRENGTH:
            right, left = stack.pop(), stack.pop()
            stack.append(left if token == "with" else left | right)
        else:
            stack.append({token})
    return stack[0]


@cache
def _phrases() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for phrase in {**BASE, **PHRASES}:
        a.add_word(f" {phrase} ", phrase)
    a.make_automaton()
    return a


@cache
def _tags() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    a.add_word(TAG, TAG)
    a.make_automaton()
    return a


def expressions(text: bytes) -> list[str]:
    """What stands behind each tag, to the end of its line or comment."""
    low = text.lower().decode("latin-1")
    found = []
    for end, _ in _tags().iter(low):
        rest = re.split(r"[\n\r]|\*/|-->", low[end + 1 :], maxsplit=1)[0]
        found.append(rest.strip())
    return found


#: n_words, n_base, first_word, last_word, base_labels, labels, score, expressions, permitted, spans (label, first word, words).
Found = tuple[int, int, int | None, int | None, str, str, float, str, bool | None, list[tuple[str, int, int]]]


def scan(text: bytes | None, permitted: Iterable[str] = PERMISSIVE) -> Found:
    """What a text says of its licence. expressions: in postfix order, one after the other; permitted:
    whether all of them can be met with permitted ids, null without any."""
    raw = text or b""
    words = raw.translate(_WORDS).split()
    line = f" {b' '.join(words).decode('latin-1')} "
    starts: list[int] | None = None
    base_at, base, weights, spans, own = [], set(), {}, [], []
    for end, phrase in _phrases().iter(line):
        if starts is None:
            starts, at = [], 0
            for w in words:
                starts.append(at)
                at += len(w) + 1
        first = bisect_right(starts, end - len(phrase) - 1) - 1
        if phrase in BASE:
            base_at.append(first)
            base.add(BASE[phrase])
            weights[BASE[phrase]] = max(weights.get(BASE[phrase], 0), _BASE_WEIGHT)
            spans.append((BASE[phrase], first, phrase.count(" ") + 1))
        if phrase in PHRASES:
            own.append((first, -phrase.count(" ") - 1, *PHRASES[phrase]))
    reach = 0
    for first, n, label, weight in sorted(own):  # a phrase inside a longer one is part of that
        if first - n > reach:
            reach = first - n
            weights[label] = max(weights.get(label, 0), weight)
            spans.append((label, first, -n))
    orders = []
    for e in expressions(raw) if b":" in raw else []:
        order = leading(e)
        if order is None:
            weights.setdefault(UNPARSED, _UNPARSED_WEIGHT)
            continue
        orders.append(order)
        for i in ids(order):
            weights[i] = max(weights.get(i, 0), _TAG_WEIGHT)
    miss = 1.0
    for label in sorted(weights):
        miss *= 1 - weights[label]
    allowed = all(met(o, permitted) for o in orders) if orders else None
    shown = "; ".join(" ".join(o) for o in orders)
    return len(words), len(base_at), min(base_at, default=None), max(base_at, default=None), ",".join(sorted(base)), ",".join(sorted(weights)), 1 - miss, shown, allowed, spans


_SPAN = "array<struct<label: string, word: int, n: int>>"
_OUT = {"doc_id": "long", "n_words": "long", "n_base": "long", "first_word": "long", "last_word": "long", "base_labels": "string", "labels": "string", "score": "double", "expressions": "string", "permitted": "boolean", "spans": _SPAN}


def _scan(permitted: tuple[str, ...]):
    span = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int32()), ("n", pa.int32())]))
    kinds = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.float64(), pa.string(), pa.bool_(), span]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [scan(t, permitted) for t in b.column(1).to_pylist()]
            flat = [[*r[:-1], [dict(zip(("label", "word", "n"), s, strict=True)) for s in r[-1]]] for r in rows]
            yield pa.record_batch([b.column(0), *(pa.array([r[i] for r in flat], k) for i, k in enumerate(kinds))], names=list(_OUT))

    return run


def licenses(docs: DataFrame, permitted: tuple[str, ...] = PERMISSIVE) -> DataFrame:
    """A row per document, with the spans of the phrases."""
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(_scan(permitted), ", ".join(f"{n} {t}" for n, t in _OUT.items()))
