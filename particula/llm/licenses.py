"""License scans: identifier tags and notice phrases found by an Aho-Corasick automaton, and a shunting-yard parser that evaluates and/or/with expressions.

``scan`` reads every whole text once, without a shuffle. Defined cases: a null
or empty text has no words, no places, empty label strings and score 0;
repeated rows are scanned one by one; an empty table gives no rows; columns
beyond the id and the text are ignored; any number of places is reported by
count, first and last; a malformed expression yields the identifiers that could
be read, with a lower score.
"""

from __future__ import annotations

import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textkernel import short_batches

# Base phrases (words in a row) and their labels.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Further notice phrases and their labels.
NOTICE_PHRASES = {
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "redistribution and use in source and binary forms": "bsd",
    "bsd license": "bsd",
    "isc license": "isc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc0 1 0 universal": "cc0",
    "creative commons zero": "cc0",
    "released into the public domain": "public-domain",
    "all rights reserved": "all-rights-reserved",
}
# Identifier tags, after which an expression follows on the same line.
TAGS = ("spdx-license-identifier:", "license-expression:")
# Families of identifiers; the longest fitting prefix names the label.
IDENTIFIER_PREFIXES = {
    "mit": "mit",
    "apache-2": "apache-2",
    "gpl": "gpl",
    "lgpl": "lgpl",
    "agpl": "agpl",
    "mpl": "mpl",
    "bsd": "bsd",
    "isc": "isc",
    "cc-by-nc": "cc-by-nc",
    "cc-by-sa": "cc-by-sa",
    "cc-by-nd": "cc-by-nd",
    "cc0": "cc0",
}
# Labels under which a text may be kept without further terms.
PERMISSIVE = frozenset({"mit", "apache-2", "bsd", "isc", "cc0", "public-domain"})

#: How much each kind of evidence counts; a score is 1 - product(1 - weight) over the distinct pieces of evidence.
TAG_WEIGHT, BROKEN_TAG_WEIGHT, BASE_WEIGHT, NOTICE_WEIGHT = 0.95, 0.6, 0.9, 0.7

_PRECEDENCE = {"or": 1, "and": 2, "with": 3}
_TOKEN = re.compile(r"\(|\)|[a-z0-9][a-z0-9.+\-]*")

#: Lowers A-Z and turns every byte outside words into a space.
_TO_WORDS = bytes((b + 32 if 65 <= b <= 90 else b) if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def to_postfix(text: str) -> tuple[list[str], bool]:
    """Shunting-yard: operands and operators of a lower-case expression in postfix order, and whether it is well formed.

    Reading stops where two operands meet without an operator (prose after the expression).
    """
    out: list[str] = []
    held: list[str] = []
    well, want_operand = True, True
    for token in _TOKEN.findall(text):
        if token == "(":
            if not want_operand:
                break
            held.append(token)
        elif token == ")":
            if want_operand or "(" not in held:
                well = False
                break
            while held[-1] != "(":
                out.append(held.pop())
            held.pop()
        elif token in _PRECEDENCE:
            if want_operand:
                well = False
                continue
            while held and held[-1] != "(" and _PRECEDENCE[held[-1]] >= _PRECEDENCE[token]:
                out.append(held.pop())
            held.append(token)
            want_operand = True
        else:
            if not want_operand:
                break
            out.append(token)
            want_operand = False
    if want_operand and out:  # a trailing operator has no right side
        well = False
        if held and held[-1] in _PRECEDENCE:
            held.pop()
    while held:
        top = held.pop()
        if top == "(":
            well = False
        else:
            out.append(top)
    return out, well and bool(out)


def label_of(identifier: str) -> str:
    """Label of a licence identifier; unknown ones are their own label."""
    fits = [p for p in IDENTIFIER_PREFIXES if identifier.startswith(p)]
    return IDENTIFIER_PREFIXES[max(fits, key=len)] if fits else identifier.rstrip(".")


def evaluate(text: str) -> tuple[set[str], bool, bool]:
    """(labels named, whether the terms allow keeping the text, well formed).

    ``or`` lets the reader choose, ``and`` binds to both sides, ``with`` adds an
    exception to the licence on its left and keeps that licence's answer.
    """
    postfix, well = to_postfix(text)
    stack: list[tuple[frozenset, bool]] = []  # labels of a part of the expression, and its answer
    for token in postfix:
        if token not in _PRECEDENCE:
            label = label_of(token)
            stack.append((frozenset([label]), label in PERMISSIVE))
        elif len(stack) < 2:
            well = False
        else:
            right, left = stack.pop(), stack.pop()
            if token == "with":
                stack.append(left)
            else:
                stack.append((left[0] | right[0], left[1] or right[1] if token == "or" else left[1] and right[1]))
    return set().union(*(labels for labels, _ in stack)), bool(stack) and stack[-1][1], well


def _automaton(keys: dict[str, object]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for k, v in keys.items():
        out.add_word(k, v)
    out.make_automaton()
    return out


def _words(text: bytes) -> list[bytes]:
    return text.translate(_TO_WORDS).split()


def _spaced(words: list[bytes]) -> str:
    """Words with single spaces around them, a character for each byte."""
    return (b" " + b" ".join(words) + b" ").decode("latin-1")


class Scanner:
    """The two automata, built once in each task; phrases are read as texts are, whatever their case, spacing or letters."""

    def __init__(self, base: dict[str, str], notices: dict[str, str]):
        both = {}
        for phrases, is_base in ((notices, False), (base, True)):
            for phrase, label in phrases.items():
                key = _spaced(_words(phrase.encode()))
                if key.strip():
                    both[key] = (key, label, is_base)
        self.phrases = _automaton(both)
        self.tags = _automaton({t: len(t) for t in TAGS})
        self.tag_bytes = tuple(t.encode() for t in TAGS)

    def __call__(self, text: bytes) -> tuple:
        plain = _words(text)
        spaced = _spaced(plain)
        n_base, low_at, high_at, base, found, evidence = 0, None, None, set(), set(), {}
        for end, (phrase, label, is_base) in self.phrases.iter(spaced):
            found.add(label)
            evidence[phrase] = BASE_WEIGHT if is_base else NOTICE_WEIGHT
            if is_base:
                base.add(label)
                at = end - len(phrase) + 1  # the space before the first word
                n_base += 1
                low_at = at if low_at is None else min(low_at, at)
                high_at = at if high_at is None else max(high_at, at)
        keep = []
        low = text.lower()
        if any(t in low for t in self.tag_bytes):
            line = low.decode("utf-8", "replace")
            for end, _ in self.tags.iter(line):
                stop = line.find("\n", end)
                labels, allows, well = evaluate(line[end + 1 : stop if stop >= 0 else len(line)])
                found |= labels
                keep.append(allows)
                for label in labels:
                    evidence["tag " + label] = TAG_WEIGHT if well else BROKEN_TAG_WEIGHT
        score = 1.0 - float(np.prod([1.0 - w for _, w in sorted(evidence.items())])) if evidence else 0.0
        first, last = (None, None) if low_at is None else (spaced.count(" ", 0, low_at), spaced.count(" ", 0, high_at))
        allowed = (all(keep) if keep else bool(found & PERMISSIVE) and not found - PERMISSIVE) if found else None
        return len(plain), n_base, first, last, ",".join(sorted(base)), ",".join(sorted(found)), score, allowed


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: dict[str, str] | None = None, notices: dict[str, str] | None = None) -> DataFrame:
    """One row per document: n_words, n_base, first_word, last_word, base_labels, labels, score, permissive.

    Words are runs of ASCII digits, letters and non-ASCII characters after
    lowering A-Z; a phrase stands where its words follow one another.
    ``permissive`` is null where no licence was found.
    """
    base = BASE_PHRASES if base is None else base
    notices = NOTICE_PHRASES if notices is None else notices
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        scanner = Scanner(base, notices)
        for batch in batches:
            rows = [scanner(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in batch.column(1)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.bool_()]
            names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "permissive"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=[id_col, *names])

    schema = f"`{id_col}` {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, permissive boolean"
    return short_batches(docs).select(id_col, text_col).mapInArrow(run, schema)
