"""License scans: Aho-Corasick for tags and phrases, shunting-yard for expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, as_bytes, slices

# The base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
# Well-known notices, as words, and the labels that the method adds for them.
NOTICES = {
    "gnu lesser general public license": "lgpl",
    "gnu library general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "gnu free documentation license": "gfdl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "european union public licence": "eupl",
    "common development and distribution license": "cddl",
    "common public license": "cpl",
    "microsoft public license": "ms-pl",
    "academic free license": "afl",
    "open software license": "osl",
    "artistic license": "artistic",
    "bsd license": "bsd",
    "isc license": "isc",
    "zlib license": "zlib",
    "x11 license": "x11",
    "ncsa open source license": "ncsa",
    "python software foundation license": "psf",
    "postgresql license": "postgresql",
    "sil open font license": "ofl",
    "boost software license": "bsl",
    "open database license": "odbl",
    "the unlicense": "unlicense",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "creative commons attribution": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution share alike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution non commercial": "cc-by-nc",
    "creative commons attribution noderivatives": "cc-by-nd",
    "creative commons attribution noderivs": "cc-by-nd",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "creative commons zero": "cc0",
    "cc0": "cc0",
    "dedicated to the public domain": "public-domain",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "all rights reserved": "proprietary",
}
#: Words of the tag before an expression.
TAGS = ("spdx license identifier", "spdx licenseidentifier")
# How freely a license family lets a text be used, 0 to 1. Identifiers of other families aren't licenses to this scan.
FREEDOM = {
    "mit": 1.0, "apache": 1.0, "bsd": 1.0, "0bsd": 1.0, "isc": 1.0, "bsl": 1.0, "unlicense": 1.0, "cc0": 1.0, "zlib": 1.0, "x11": 1.0, "ncsa": 1.0, "psf": 1.0, "python": 1.0,
    "postgresql": 1.0, "public-domain": 1.0, "wtfpl": 1.0, "pddl": 1.0, "curl": 1.0, "libpng": 1.0, "openssl": 1.0, "blueoak": 1.0, "upl": 1.0, "artistic": 0.9, "cc-by": 0.9, "odc-by": 0.9,
    "afl": 0.9, "ofl": 0.8, "ms-pl": 0.8, "ms-rl": 0.6, "cc-by-sa": 0.6, "mpl": 0.6, "epl": 0.6, "cpl": 0.6, "cddl": 0.6, "eupl": 0.5, "osl": 0.5, "lgpl": 0.5, "odbl": 0.5, "gfdl": 0.4,
    "gpl": 0.3, "agpl": 0.2, "sspl": 0.1, "busl": 0.1, "cc-by-nc": 0.1, "cc-by-nc-sa": 0.1, "cc-by-nd": 0.1, "cc-by-nc-nd": 0.1, "licenseref": 0.5, "proprietary": 0.0,
}
#: What an exception to a license adds.
EXCEPTION_BONUS = 0.2
_LINE_TAG = re.compile(r"spdx-license-?identifier\s*:\s*([^\r\n]*)", re.I)
_TOKEN = re.compile(r"[()]|[A-Za-z0-9][A-Za-z0-9.+:_-]*")
_EXCEPTION = re.compile(r"(?i)exception|linking|^licenseref-|-note\b")
_RANK = {"or": 1, "and": 2, "with": 3}


def family(identifier: str) -> str:
    """The label of a license identifier: lower case, without version and suffixes."""
    name = identifier.lower().rstrip("+.:")
    if name.startswith(("licenseref-", "documentref-")):
        return "licenseref"
    name = re.sub(r"-(?:only|or-later|clause.*)$", "", name)
    name = re.sub(r"-v?\d+(?:\.\d+)*(?:-.*)?$", "", name)
    return name


def postfix(expression: str) -> list[str]:
    """A license expression in postfix order, by shunting-yard.

    ``with`` binds tighter than ``and``, that tighter than ``or``, in any case.
    Reading ends where the expression does: at a token that can't follow, or an
    operator that no identifier of a known license (or exception) follows, as in
    "MIT or any later version".  Raises ValueError if what was read is no
    expression.
    """
    out: list[str] = []
    held: list[str] = []
    operand = True
    tokens = _TOKEN.findall(expression)
    for token, ahead in zip(tokens, [*tokens[1:], ""]):
        low = token.lower()
        if operand:
            if token == "(":
                held.append(token)
                continue
            if token == ")" or low in _RANK:
                raise ValueError("an operand is missing")
            if not (held and held[-1] == "with") and family(token) not in FREEDOM:
                raise ValueError("no known license")
            out.append(token.rstrip(".:"))
            operand = False
        elif low in _RANK:
            if ahead and not (ahead == "(" and low != "with" or (_EXCEPTION.search(ahead) if low == "with" else family(ahead) in FREEDOM)):
                if "(" in held:
                    raise ValueError("the expression isn't complete")
                break
            while held and held[-1] != "(" and _RANK[held[-1]] >= _RANK[low]:
                out.append(held.pop())
            held.append(low)
            operand = True
        elif token == ")" and "(" in held:
            while held[-1] != "(":
                out.append(held.pop())
            held.pop()
        else:
            break
    if operand or "(" in held:
        raise ValueError("the expression isn't complete")
    return out + held[::-1]


def evaluate(expression: str) -> tuple[set[str], float]:
    """Labels in a license expression, and its freedom: the best of alternatives, the worst of what holds together."""
    stack: list[tuple[set[str], float]] = []
    for token in postfix(expression):
        if token not in _RANK:
            name = family(token)
            stack.append(({name}, FREEDOM.get(name, 0.0)))
            continue
        (right, r), (left, v) = stack.pop(), stack.pop()
        if token == "with":
            stack.append((left, min(1.0, v + EXCEPTION_BONUS)))
        else:
            stack.append((left | right, (max if token == "or" else min)(v, r)))
    return stack[0]


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    """All phrases and tags, each between spaces."""
    found = ahocorasick.Automaton()
    for phrase in {**BASE, **NOTICES, **dict.fromkeys(TAGS, "")}:
        found.add_word(f" {phrase} ", phrase)
    found.make_automaton()
    return found


def scan(text: bytes | None) -> tuple[int, list[int], list[str], list[str], float]:
    """(words, base places, base labels, all labels, score) of a UTF-8 text."""
    words = alnum_words(text)
    line = b" " + b" ".join(words) + b" "
    plain = line.decode()
    places, base, labels, worst = [], set(), set(), []
    starts = None
    found = list(automaton().iter(plain))
    tagged = any(phrase in TAGS for _, phrase in found)
    found = [x for x in found if x[1] not in TAGS]
    # a notice that begins a longer one says nothing of its own
    longest = {}
    for end, phrase in found:
        longest[end - len(phrase)] = max(len(phrase), longest.get(end - len(phrase), 0))
    for end, phrase in found:
        if phrase not in BASE and len(phrase) < longest[end - len(phrase)]:
            continue
        label = BASE.get(phrase) or NOTICES[phrase]
        labels.add(label)
        if len(phrase) == longest[end - len(phrase)]:
            worst.append(FREEDOM[label])
        if phrase in BASE:
            base.add(label)
            if starts is None:
                starts = np.cumsum([1, *(len(w.decode()) + 1 for w in words)])
            places.append(int(np.searchsorted(starts, end - len(phrase))))
    if tagged:
        for expression in _LINE_TAG.findall(text.decode()):
            try:
                more, value = evaluate(expression)
            except ValueError:
                continue
            labels |= more
            worst.append(value)
    return len(words), sorted(places), sorted(base), sorted(labels), min(worst, default=0.0)


def license_scan(docs: DataFrame) -> DataFrame:
    """License notices in ``docs(doc_id, text)``.

    Returns ``doc_id, n_words, n_base, first_word, last_word, base_labels,
    labels, score``, a row for each row.  Base places are those of the four
    base phrases, overlaps included; further labels come from notice phrases
    and from the expressions after identifier tags.  ``score`` is the freedom
    of all that was found, the least of it; 0 if nothing was.  A notice that
    begins a longer one counts for nothing, unless it is a base phrase.  An
    expression that can't be read, or names no known license, adds nothing.
    Null and empty texts have no words, empty labels, null first and last
    words; repeated rows count each; other columns are ignored; an empty table
    gives an empty one.
    """
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            got = [scan(t) for t in as_bytes(part.column(1))]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0), pa.array([g[0] for g in got], pa.int64()), pa.array([len(g[1]) for g in got], pa.int64()),
                    pa.array([g[1][0] if g[1] else None for g in got], pa.int64()), pa.array([g[1][-1] if g[1] else None for g in got], pa.int64()),
                    pa.array([",".join(g[2]) for g in got], pa.string()), pa.array([",".join(g[3]) for g in got], pa.string()), pa.array([g[4] for g in got], pa.float64()),
                ],
                names,
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
