"""Formulas as trees: a node for each token that isn't a bracket, found in one walk over a formula's tokens.

The walk keeps the open brackets and, in each, the commands that still take the
siblings after them as arguments.  A formula is read where its row lies, so that
its tokens are never rows that a shuffle moves.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..functions.text import LATEX_TOKEN
from .lineage import dealt

# Commands that take arguments, as the formulas' authors write them.
TWO_ARGUMENTS = ["\\frac", "\\dfrac", "\\tfrac"]
ONE_ARGUMENT = ["\\sqrt", "\\hat", "\\widehat", "\\bar", "\\overline", "\\vec", "\\dot", "\\ddot", "\\tilde", "\\widetilde", "\\underline", "\\boxed", "\\not", "\\mathbb", "\\mathrm", "\\mathbf", "\\mathcal", "\\operatorname", "\\text", "^", "_"]
ARITY = dict.fromkeys(TWO_ARGUMENTS, 2) | dict.fromkeys(ONE_ARGUMENT, 1)
PARTNER = {"{": "}", "\\left": "\\right", "\\begin{matrix}": "\\end{matrix}"}
KIND = {"{": "group", "\\left": "fence", "\\begin{matrix}": "matrix", "[": "index", "^": "script", "_": "script"}
CLOSE, SIDES = frozenset(PARTNER.values()), ("\\left", "\\right")
SPACES = [" ", "\t", "\n"]
ERRORS = ("unbalanced", "missing argument", "double script", "missing delimiter")
#: Formulas of a task, about: each becomes many rows.
TASK_ROWS = 20_000
#: Characters of the formulas that a task reads at once, about.
TEXT = 1 << 20
_TOKEN = re.compile(LATEX_TOKEN)


class _Bracket:
    """An open bracket, or the whole formula: where it opened, what ends it, and what its next sibling goes to."""

    __slots__ = ("node", "end", "row", "delimiter", "owing", "base", "scripts")

    def __init__(self, node: int | None = None, end: str | None = None, row: int = -1, delimiter: str | None = None):
        self.node, self.end, self.row, self.delimiter = node, end, row, delimiter
        self.owing: list[list[int]] = []  # commands and how many arguments they lack
        self.base, self.scripts = -1, ""


def parsed(latex: str) -> tuple[list[list], str | None]:
    """``node, parent, place, kind, value`` of each node, in order, and what is wrong, as ``formula_nodes`` has them."""
    tokens = [t for t in enumerate(_TOKEN.findall(latex)) if t[1] not in SPACES]
    nodes: list[list] = []
    places: Counter[int | None] = Counter()
    brackets, fault, before = [_Bracket()], len(ERRORS), None
    for k, (pos, token) in enumerate(tokens):
        if k and tokens[k - 1][1] in SIDES:
            continue  # a delimiter
        after = tokens[k + 1][1] if k + 1 < len(tokens) else None
        own = brackets[-1]
        if token in CLOSE or (token == "]" and own.end == "]"):
            if own.end != token:
                return [], ERRORS[0]
            if own.owing:
                fault = min(fault, 1)
            if token == "\\right":
                if own.delimiter is None or after is None:
                    fault = min(fault, 3)
                else:
                    nodes[own.row][4] = own.delimiter + after
            brackets.pop()
        else:
            end = "]" if token == "[" and before == "\\sqrt" else PARTNER.get(token)
            arity = 2 if token == "\\sqrt" and after == "[" else ARITY.get(token, 0)
            script = token in ("^", "_")
            if own.owing:
                parent, lacks = own.owing[-1]
                if lacks > 1:
                    own.owing[-1][1] = lacks - 1
                else:
                    own.owing.pop()
                if script:
                    fault = min(fault, 1)
            elif script:
                parent = own.base if own.base >= 0 else own.node
                if token in own.scripts:
                    fault = min(fault, 2)
                own.scripts += token
            else:
                parent, own.base, own.scripts = own.node, pos, ""
            kind = KIND[token] if end or script else "command" if arity else "symbol"
            nodes.append([pos, parent, places[parent], kind, None if end else token])
            places[parent] += 1
            if arity:
                own.owing.append([pos, arity])
            if end:
                brackets.append(_Bracket(pos, end, len(nodes) - 1, after if token == "\\left" else None))
        before = token
    if len(brackets) > 1:
        return [], ERRORS[0]
    if brackets[0].owing:
        fault = min(fault, 1)
    return ([], ERRORS[fault]) if fault < len(ERRORS) else (nodes, None)


def formula_nodes(formulas: DataFrame) -> DataFrame:
    """``formulas(formula, latex)`` -> ``formula, node, parent, place, kind, value, error``.

    A node's number is that of its token; ``parent`` is null at the top, else the
    command it is an argument of, the base it is a script of, or the bracket
    it stands in; ``place`` counts siblings from 0.  Kinds: ``group`` (braces), ``fence``
    (``\\left``, value: both delimiters), ``matrix``, ``index`` (of a root), ``command``, ``script``
    and ``symbol``; matrix cells and rows are parted by symbols ``&`` and ``\\\\``.
    White space counts for nothing.

    A formula that can't be read has one row, with null node, and ``error``: ``unbalanced``
    (a bracket without or with another partner), ``missing argument`` (of a command,
    or a script as an argument), ``double script`` (two of a kind on one base)
    or ``missing delimiter``, the first of these.  Null and empty formulas have
    one row without node or error.  Formulas of a batch that are the same are read once.
    """
    columns = {"node": IntegerType(), "parent": IntegerType(), "place": IntegerType(), "kind": StringType(), "value": StringType(), "error": StringType()}
    schema = StructType([StructField("formula", formulas.schema["formula"].dataType), *(StructField(*c) for c in columns.items())])
    types = [pa.int32()] * 3 + [pa.string()] * 3

    def trees(latex: pa.Array) -> tuple[np.ndarray, list[pa.Array]]:
        """How many rows each formula has, and their columns."""
        coded = pc.dictionary_encode(latex, null_encoding="encode")
        rows, sizes = [], []
        for text in coded.dictionary.cast(pa.binary()).to_pylist():  # texts that are no UTF-8 are read as Spark does
            nodes, error = parsed((text or b"").decode("utf-8", "replace"))
            rows.append([[*n, None] for n in nodes] or [[None] * 5 + [error]])
            sizes.append(len(rows[-1]))
        each = [pa.array(c, t) for c, t in zip(zip(*chain.from_iterable(rows)), types)]
        codes, size = coded.indices.to_numpy(), np.array(sizes)
        n, begin = size[codes], (np.cumsum(size) - size)[codes]
        at = pa.array(np.arange(n.sum()) + np.repeat(begin - (np.cumsum(n) - n), n))
        return n, [c.take(at) for c in each]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy())
            first = 0
            while first < batch.num_rows:
                last = max(int(np.searchsorted(ends, (ends[first - 1] if first else 0) + TEXT, "right")), first + 1)
                some, first = batch.slice(first, last - first), last
                n, out = trees(some.column(1))
                key = some.column(0).take(pa.array(np.repeat(np.arange(len(n)), n)))
                yield pa.RecordBatch.from_arrays([key, *out], names=schema.names)

    return dealt(formulas, TASK_ROWS, "formula").select("formula", "latex").mapInArrow(read, schema)
