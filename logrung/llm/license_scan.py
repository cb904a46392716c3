"""Licences in texts: phrases and tags by Aho-Corasick, expressions by a shunting-yard parser.

Texts are lower-cased (A-Z) and reduced to their words; one automaton then
finds the phrases that name a licence or belong to its notice. A second one
finds identifier tags in the raw text, and what follows a tag is read as an
expression of licence ids with ``and``, ``or`` and ``with``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logrung.llm.words import text_slices

#: Phrases that alone give a label.
BASE_PHRASES = (
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
)

#: Further names and notice phrases, in words as they are after reduction.
NOTICE_PHRASES = (
    ("mit licence", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("apache licence", "apache"),
    ("apache software license", "apache"),
    ("general public licence", "gpl"),
    ("lesser general public license", "lgpl"),
    ("library general public license", "lgpl"),
    ("affero general public license", "agpl"),
    ("bsd license", "bsd"),
    ("bsd licence", "bsd"),
    ("bsd 2 clause", "bsd"),
    ("bsd 3 clause", "bsd"),
    ("redistribution and use in source and binary forms", "bsd"),
    ("mozilla public license", "mpl"),
    ("eclipse public license", "epl"),
    ("common development and distribution license", "cddl"),
    ("european union public licence", "eupl"),
    ("boost software license", "bsl"),
    ("isc license", "isc"),
    ("zlib license", "zlib"),
    ("artistic license", "artistic"),
    ("sil open font license", "ofl"),
    ("free and unencumbered software released into the public domain", "unlicense"),
    ("cc0 1 0", "cc0"),
    ("creative commons zero", "cc0"),
    ("licensed under cc by", "cc-by"),
    ("creative commons attribution", "cc-by"),
    ("cc by sa", "cc-by-sa"),
    ("cc by nc", "cc-by-nc"),
    ("cc by nd", "cc-by-nd"),
)

#: What stands before an expression.
TAGS = ("spdx-license-identifier:", "license-expression:", "license:", "licence:", '"license":')

#: Families of licence ids and what they oblige to: 0 little, 1 files, 2 whole works, 3 no free use.
FAMILIES = (
    (r"mit(?:-0)?", "mit", 0),
    (r"apache-[\d.]+", "apache", 0),
    (r"(?:0bsd|bsd-\d-clause)", "bsd", 0),
    (r"isc", "isc", 0),
    (r"zlib", "zlib", 0),
    (r"bsl-1\.0", "bsl", 0),
    (r"unlicense", "unlicense", 0),
    (r"cc0-1\.0", "cc0", 0),
    (r"artistic-[\d.]+", "artistic", 0),
    (r"ofl-[\d.]+", "ofl", 0),
    (r"cc-by-\d\.\d", "cc-by", 0),
    (r"mpl-[\d.]+", "mpl", 1),
    (r"epl-[\d.]+", "epl", 1),
    (r"cddl-[\d.]+", "cddl", 1),
    (r"lgpl-[\d.]+(?:-only|-or-later|\+)?", "lgpl", 1),
    (r"eupl-[\d.]+", "eupl", 2),
    (r"cc-by-sa-\d\.\d", "cc-by-sa", 2),
    (r"gpl-[\d.]+(?:-only|-or-later|\+)?", "gpl", 2),
    (r"agpl-[\d.]+(?:-only|-or-later|\+)?", "agpl", 2),
    (r"cc-by-nc(?:-sa|-nd)?-\d\.\d", "cc-by-nc", 3),
    (r"cc-by-nd-\d\.\d", "cc-by-nd", 3),
)

#: How sure a kind of find makes that a licence is meant.
CERTAINTY = {"base": 0.8, "notice": 0.9, "tag": 1.0}

_FAMILIES = [(re.compile(p), label, duty) for p, label, duty in FAMILIES]
_DUTIES = {label: duty for _, label, duty in FAMILIES}
_TOKEN = re.compile(r"[ \t]*([()]|[a-z0-9](?:[a-z0-9.+-]*[a-z0-9+])?)")
_AFTER_TAG = re.compile(r"[ \t]*[\"']?[ \t]*")
_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BINDS = {"or": 1, "and": 2, "with": 3}


@dataclass(frozen=True)
class Expression:
    """A licence expression: its postfix form, labels and the least obligation that a reader can choose."""

    postfix: tuple[str, ...]
    labels: frozenset[str]
    duty: int
    end: int


def family(licence: str) -> tuple[str, int] | None:
    """(label, obligation) of a lower-case licence id, None if unknown."""
    for pattern, label, duty in _FAMILIES:
        if pattern.fullmatch(licence):
            return label, duty
    return None


def _tokens(text: str, at: int) -> tuple[list[str], int]:
    """(tokens, end) of the longest complete expression that begins at ``at``."""
    tokens: list[str] = []
    whole, end, opened, operand, after_with, plain = 0, at, 0, True, False, False
    while m := _TOKEN.match(text, at):
        token = m.group(1)
        if token == "(":
            if not operand or after_with:
                break
            opened += 1
        elif token == ")":
            if operand or not opened:
                break
            opened, plain = opened - 1, False
        elif operand:
            if not after_with and family(token) is None:
                break
            # An exception belongs to one licence, not to a bracket or another exception.
            operand, plain, after_with = False, not after_with, False
        elif token in _BINDS:
            if token == "with" and not plain:
                break
            operand, after_with = True, token == "with"
        else:
            break
        tokens.append(token)
        at = m.end()
        if not operand and not opened:
            whole, end = len(tokens), at
    return tokens[:whole], end


def parse_expression(text: str, at: int = 0) -> Expression | None:
    """The longest licence expression that begins at ``at`` of a lower-case text, or None.

    ``with`` binds tighter than ``and``, ``and`` tighter than ``or``; operators
    of one rank go left to right. An id is a known one; after ``with`` any
    name is an exception. An expression stays on its line. Reading stops
    before an operator without a right side and at text that fits no place;
    brackets that stay open leave what was complete before them.
    """
    tokens, end = _tokens(text, at)
    if not tokens:
        return None
    output: list[str] = []
    waiting: list[str] = []
    for token in tokens:
        if token == "(":
            waiting.append(token)
        elif token == ")":
            while (top := waiting.pop()) != "(":
                output.append(top)
        elif token in _BINDS:
            while waiting and waiting[-1] != "(" and _BINDS[waiting[-1]] >= _BINDS[token]:
                output.append(waiting.pop())
            waiting.append(token)
        else:
            output.append(token)
    return _evaluated((*output, *waiting[::-1]), end)


def _evaluated(postfix: tuple[str, ...], end: int) -> Expression:
    """Fold a postfix form: ``or`` takes the lesser obligation, ``and`` the greater, ``with`` one less for whole works."""
    stack: list[tuple[frozenset[str], int]] = []
    for i, token in enumerate(postfix):
        if token not in _BINDS:
            known = family(token)
            exception = i + 1 < len(postfix) and postfix[i + 1] == "with"
            stack.append((frozenset(), 0) if exception or known is None else (frozenset([known[0]]), known[1]))
            continue
        right, left = stack.pop(), stack.pop()
        if token == "with":
            stack.append((left[0], 1 if left[1] == 2 else left[1]))
        else:
            stack.append((left[0] | right[0], min(left[1], right[1]) if token == "or" else max(left[1], right[1])))
    return Expression(postfix, *stack[0], end)


class LicenceScanner:
    """Both automata; ``base`` phrases are counted, ``notices`` only add labels."""

    def __init__(self, base=BASE_PHRASES, notices=NOTICE_PHRASES, tags=TAGS):
        self._phrases, self._tags = ahocorasick.Automaton(), ahocorasick.Automaton()
        for kind, phrases in (("notice", notices), ("base", base)):
            for phrase, label in phrases:
                self._phrases.add_word(f" {phrase} ", (kind, label, len(phrase) + 1))
        for tag in tags:
            self._tags.add_word(tag, len(tag))
        self._phrases.make_automaton()
        self._tags.make_automaton()

    def phrases(self, words: str) -> list[tuple[int, str, str]]:
        """(first word, kind, label) of each place of a phrase in words that single blanks surround."""
        found = [(end - size, kind, label) for end, (kind, label, size) in self._phrases.iter(words)]
        if not found:
            return []
        blanks = np.flatnonzero(np.frombuffer(words.encode("utf-32-le"), np.uint32) == 32)
        places = np.searchsorted(blanks, [f[0] for f in found])
        return sorted((p, kind, label) for p, (_, kind, label) in zip(places.tolist(), found, strict=True))

    def expressions(self, lowered: str) -> list[tuple[int, Expression]]:
        """(place of the tag, expression) for the tags of a lower-cased text; a tag inside a longer name is none."""
        found: list[tuple[int, Expression]] = []
        for last, size in self._tags.iter(lowered):
            first, at = last - size + 1, last + 1
            before = lowered[max(0, first - 1) : first]
            if before.isalnum() or before in ("-", "_", "."):
                continue
            expression = parse_expression(lowered, _AFTER_TAG.match(lowered, at).end())
            if expression is not None:
                found.append((first, expression))
        return found


_RESULT = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, places array<struct<word: long, kind: string, label: string>>, "
    "expressions array<string>, obligation int"
)
_PLACE = pa.struct([("word", pa.int64()), ("kind", pa.string()), ("label", pa.string())])
_FOUND = (
    ("n_base", pa.int64()),
    ("first_word", pa.int64()),
    ("last_word", pa.int64()),
    ("base_labels", pa.string()),
    ("labels", pa.string()),
    ("score", pa.float64()),
    ("places", pa.list_(_PLACE)),
    ("expressions", pa.list_(pa.string())),
    ("obligation", pa.int32()),
)


def _scanned(scanner: LicenceScanner, lowered: str, words: str) -> tuple:
    places = scanner.phrases(words)
    tagged = [e for _, e in scanner.expressions(lowered)]
    base = [p for p in places if p[1] == "base"]
    base_labels = {p[2] for p in base}
    labels = {p[2] for p in places}.union(*(e.labels for e in tagged))
    kinds = {p[1] for p in places} | ({"tag"} if tagged else set())
    duties = [_DUTIES.get(p[2], 0) for p in places] + [e.duty for e in tagged]
    return (
        len(base),
        base[0][0] if base else None,
        base[-1][0] if base else None,
        ",".join(sorted(base_labels)),
        ",".join(sorted(labels)),
        max((CERTAINTY[k] for k in kinds), default=0.0),
        [{"word": w, "kind": k, "label": n} for w, k, n in places],
        [" ".join(e.postfix) for e in tagged],
        max(duties, default=None),
    )


def scan_licences(docs: DataFrame, slice_bytes: int = 1 << 21) -> DataFrame:
    """Licences of each row of ``docs`` (doc_id, text).

    (doc_id, n_words, n_base, first_word, last_word, base_labels, labels,
    score, places, expressions, obligation). ``places`` are all phrases found,
    by their first word from 0; ``n_base`` counts those of BASE_PHRASES, whose
    first and last start are ``first_word`` and ``last_word``. Label lists are
    distinct, sorted and joined by commas. ``expressions`` are tagged
    expressions in postfix form. ``obligation`` is the strictest one of all
    finds, where an expression counts with what its reader may choose. The
    score is the certainty of the surest kind of find, 0 without any.

    Null and empty texts have no words and no labels, null counts where there
    is no place. Row-local, whole texts, no shuffle; repeated rows are judged
    one by one, other columns are not read, an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = LicenceScanner()
        for batch in batches:
            for first, last in text_slices(batch.column(1), slice_bytes):
                texts = pc.fill_null(batch.column(1).slice(first, last - first), "")
                lowered = pc.ascii_lower(texts)
                words = pc.utf8_trim(pc.replace_substring_regex(lowered, _NOT_WORD, " "), " ")
                counts = pc.if_else(pc.equal(pc.binary_length(words), 0), 0, pc.add(pc.count_substring(words, " "), 1))
                rows = [
                    _scanned(scanner, low, f" {w} ")
                    for low, w in zip(lowered.to_pylist(), words.to_pylist(), strict=True)
                ]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (k for _, k in _FOUND), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), counts.cast(pa.int64()), *columns],
                    names=["doc_id", "n_words", *(n for n, _ in _FOUND)],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, _RESULT)

