"""Rules over page elements and graphs; each returns the offending rows."""

from __future__ import annotations

import ast
import cmath
import math
import operator
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import IDENTIFIER
from .lineage import cut


def duplicates(rows: DataFrame, *key: str) -> DataFrame:
    return rows.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def dangling(edges: DataFrame, column: str, nodes: DataFrame, key: str) -> DataFrame:
    """Edges whose end isn't among the nodes."""
    return edges.join(nodes.select(F.col(key).alias(column)), column, "left_anti")


def few_exits(nodes: DataFrame, edges: DataFrame, least: int = 2) -> DataFrame:
    """Decision nodes (``node``) with fewer outgoing edges than ``least``."""
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n"))
    return nodes.join(out, "node", "left").fillna(0, ["n"]).filter(F.col("n") < least)


def not_among(rows: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """Rows whose value isn't one of a fixed list; null isn't."""
    return rows.filter(~F.coalesce(F.col(column).isin(allowed), F.lit(False)))


def undrawable(texts: DataFrame, key: str, text: str, glyphs: DataFrame) -> DataFrame:
    """``key, chars``: the characters of each text that ``glyphs(token)`` lacks, in code-point order."""
    chars = texts.select(key, F.explode(F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))).alias("token"))
    lost = chars.join(glyphs, "token", "left_anti").groupBy(key).agg(F.collect_set(F.col("token").cast("binary")).alias("c"))
    return lost.select(key, F.array_join(F.transform(F.array_sort("c"), lambda c: c.cast("string")), "").alias("chars"))


def too_deep(items: DataFrame, item: str = "item", parent: str = "parent", most: int = 3) -> DataFrame:
    """Items nested in more than ``most`` levels: those with that many ancestors, found by as many joins, whatever the depth."""
    up = items.select(F.col(item).alias("__of"), F.col(parent).alias("__next"))
    rows = items.select(item, F.col(parent).alias("__at")).filter("__at is not null")
    for _ in range(most - 1):
        rows = rows.join(up, F.col("__at") == F.col("__of")).select(item, F.col("__next").alias("__at")).filter("__at is not null")
    return rows.join(up, F.col("__at") == F.col("__of"), "left_semi").select(item)


def table_shape(rows: DataFrame) -> DataFrame:
    """``table, row, problem`` of truth tables ``rows(table, row, cells)``: rows narrower than the widest, cells that are no 0, 1, x or -."""
    width = F.max(F.size("cells")).over(Window.partitionBy("table"))
    odd = F.exists("cells", lambda c: ~F.coalesce(c.isin("0", "1", "x", "X", "-"), F.lit(False)))
    problem = F.when(F.size("cells") < F.col("__w"), "too few cells").when(odd, "no bit")
    return rows.withColumn("__w", width).withColumn("problem", problem).filter("problem is not null").select("table", "row", "problem")


def counting_order(cells: DataFrame, table: str = "table", row: str = "row", bits: str = "bits") -> DataFrame:
    """Rows of truth tables whose input bits aren't the row number in binary, most significant first."""
    return cells.withColumn("expected", F.lpad(F.bin(F.col(row)), F.length(bits), "0")).filter(F.col("expected") != F.col(bits))


def off_page(items: DataFrame, width: Column, height: Column) -> DataFrame:
    return items.filter((F.col("l") < 0) | (F.col("t") < 0) | (F.col("r") > width) | (F.col("b") > height))


def order_problems(items: DataFrame, order: DataFrame) -> DataFrame:
    """``page, leaf, problem``: items missing from the writing order, unknown there, or listed twice."""
    listed = order.groupBy("page", "leaf").agg(F.count("*").alias("n"))
    rows = items.select("page", "leaf", F.lit(True).alias("known")).join(listed, ["page", "leaf"], "full")
    problem = F.when(F.col("n").isNull(), "missing").when(F.col("known").isNull(), "unknown").when(F.col("n") > 1, "repeated")
    return rows.withColumn("problem", problem).filter("problem is not null").select("page", "leaf", "problem")


def document_problems(pages: DataFrame, schema: str) -> DataFrame:
    """``page, problem, id`` of ``pages(page, schema, elements)``: another schema; else no elements; else element ids that are no identifiers (null too) or not the only one.

    The first two end the check of a page.
    """
    ids = F.col("elements")
    bad = F.transform(F.filter(ids, lambda x: ~F.coalesce(x.rlike(IDENTIFIER), F.lit(False))), lambda x: F.struct(F.lit("syntax").alias("problem"), x.alias("id")))
    twice = F.filter(F.array_distinct(ids), lambda x: F.size(F.filter(ids, lambda y: y.eqNullSafe(x))) > 1)
    twice = F.transform(twice, lambda x: F.struct(F.lit("duplicate").alias("problem"), x.alias("id")))
    whole = lambda name: F.array(F.struct(F.lit(name).alias("problem"), F.lit(None).cast("string").alias("id")))
    found = F.when(~F.col("schema").eqNullSafe(F.lit(schema)), whole("schema")).when(F.coalesce(F.size(ids), F.lit(0)) < 1, whole("empty")).otherwise(F.concat(bad, twice))
    return pages.select("page", F.explode(found).alias("p")).select("page", "p.problem", "p.id")


def writer_problems(items: DataFrame, writers: DataFrame) -> DataFrame:
    """``page, problem, name`` of ``items(page, item, writer, pos)`` and ``writers(page, writer, start_after)``.

    Items of an unknown writer; a ``start_after`` that is no item or the
    writer's own; writers with an item before the one that they start after.
    """
    text = lambda c: F.col(c).cast("string").alias("name")
    unknown = items.join(writers.select("page", "writer"), ["page", "writer"], "left_anti").select("page", F.lit("unknown writer").alias("problem"), text("item"))
    after = items.select("page", F.col("item").alias("start_after"), F.col("writer").alias("of"), F.col("pos").alias("at"))
    waits = writers.filter("start_after is not null").join(after, ["page", "start_after"], "left")
    wrong = waits.filter("of is null or of = writer").select("page", F.lit("start_after is not another writer's item").alias("problem"), text("writer"))
    first = items.groupBy("page", "writer").agg(F.min("pos").alias("first"))
    early = waits.join(first, ["page", "writer"]).filter("at > first").select("page", F.lit("starts too early").alias("problem"), text("writer"))
    return unknown.unionByName(wrong).unionByName(early)


def target_problems(targets: DataFrame, items: DataFrame) -> DataFrame:
    """``page, target`` of ``targets(page, target, after, wanted)``, ``wanted`` an array of items: an id that is no item of the page, or a wanted item not after its context."""
    place = items.select("page", F.col("item").alias("x"), "pos")
    rows = targets.select("page", "target", "after", F.explode("wanted").alias("x")).join(place, ["page", "x"], "left").withColumnRenamed("pos", "at")
    rows = rows.join(place.select("page", F.col("x").alias("after"), F.col("pos").alias("context")), ["page", "after"], "left")
    return rows.filter("at is null or context is null or at <= context").select("page", "target").distinct()


def labels_of_components(edges: DataFrame, most: int = 60) -> DataFrame:
    """``node, root``: the least node reachable in ``edges(u, v)``, by minimum labels and pointer jumping.

    Each round is cut off by a checkpoint, which outlives lost executors.
    """
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    both, seen = cut(both), None
    labels = both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("root"))
    for i in range(most):
        near = both.join(labels, both.v == labels.node).groupBy("u").agg(F.min("root").alias("m"))
        labels = labels.join(near, labels.node == near.u, "left").select("node", F.least("root", F.coalesce("m", "root")).alias("root"))
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("next"))
        labels = labels.join(jump, "root", "left").select("node", F.least("root", F.coalesce("next", "root")).alias("root"))
        labels = cut(labels)
        mark = labels.agg(F.sum("root").alias("s"), F.count("*").alias("n")).first()
        if mark == seen:
            return labels
        seen = mark
    raise RuntimeError("the components aren't complete")


# --- expressions ----------------------------------------------------------------------------------------------------

_BOOL_TOKEN = {"|": "or", "+": "or", "^": "xor", "⊕": "xor", "*": "and", "&": "and", "·": "and", "~": "not", "!": "not", "(": "(", ")": ")", "'": "'", "0": "0", "1": "1"}


def boolean(expression: str, names: dict[str, int]) -> int:
    """Value of a Boolean expression: or, xor, and (also by juxtaposition), not before or ``'`` after; longest names first.

    Precedence climbing over tokens; raises ValueError if the text is no expression.
    """
    pattern = re.compile(r"\s*(?:(xor)|(" + "|".join(map(re.escape, sorted(names, key=len, reverse=True)) or ["(?!)"]) + r")|([|+^⊕*&·~!()'01]))")
    tokens, at = [], 0
    text = expression.strip()
    while at < len(text):
        m = pattern.match(text, at)
        if not m:
            raise ValueError(f"unknown name at {text[at:]!r}")
        tokens.append(("xor", 0) if m[1] else ("name", names[m[2]]) if m[2] else (_BOOL_TOKEN[m[3]], 0))
        at = m.end()
    tokens.append(("end", 0))
    place = 0
    rank = {"or": 1, "xor": 2, "and": 3}

    def primary() -> int:
        nonlocal place
        kind, value = tokens[place]
        place += 1
        if kind == "not":
            return 1 - primary()
        if kind == "(":
            value = climb(1)
            if tokens[place][0] != ")":
                raise ValueError("a bracket isn't closed")
            place += 1
        elif kind in ("0", "1"):
            value = int(kind)
        elif kind != "name":
            raise ValueError(f"unexpected {kind}")
        while tokens[place][0] == "'":
            place += 1
            value = 1 - value
        return value

    def climb(least: int) -> int:
        nonlocal place
        value = primary()
        while True:
            kind = tokens[place][0]
            beside = kind in ("name", "(", "not", "0", "1")
            own = 3 if beside else rank.get(kind, 0)
            if own < least or not own:
                return value
            place += not beside
            right = climb(own + 1)
            value = value | right if kind == "or" else value ^ right if kind == "xor" else value & right

    value = climb(1)
    if tokens[place][0] != "end":
        raise ValueError("text is left over")
    return value


def bool_eval(expression: Column, names: Column, values: Column) -> Column:
    """Values of expressions, names given as arrays; null where the text is no expression."""

    def run(expressions: pd.Series, n: pd.Series, v: pd.Series) -> pd.Series:
        out = []
        for e, own, bits in zip(expressions, n, v):
            try:
                out.append(boolean(e, {a: int(b) for a, b in zip(own, bits)}))
            except (ValueError, RecursionError):
                out.append(None)
        return pd.Series(out, dtype="Int32")

    run.__annotations__ = {"expressions": pd.Series, "n": pd.Series, "v": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "int")(expression, names, values)


_BINARY = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.Pow: operator.pow, ast.Mod: operator.mod}
_UNARY = {ast.UAdd: operator.pos, ast.USub: operator.neg}
_CALLS = {n: getattr(cmath, n) for n in ("sqrt", "exp", "log", "sin", "cos", "tan", "phase")} | {"abs": abs}
_CONSTANTS = {"pi": math.pi, "e": math.e, "j": 1j, "i": 1j}


def number(text: str, names: dict[str, complex]) -> complex:
    """Value of an arithmetic expression. Only the node kinds listed above are allowed; nothing is executed."""

    def value(n: ast.expr) -> complex:
        if isinstance(n, ast.Constant) and isinstance(n.value, int | float | complex) and not isinstance(n.value, bool):
            return n.value
        if isinstance(n, ast.Name):
            if n.id in names:
                return names[n.id]
            if n.id in _CONSTANTS:
                return _CONSTANTS[n.id]
        if isinstance(n, ast.BinOp) and type(n.op) in _BINARY:
            a, b = value(n.left), value(n.right)
            if isinstance(n.op, ast.Pow) and abs(b) > 64:
                raise ValueError("the exponent is too large")
            return _BINARY[type(n.op)](a, b)
        if isinstance(n, ast.UnaryOp) and type(n.op) in _UNARY:
            return _UNARY[type(n.op)](value(n.operand))
        if isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and n.func.id in _CALLS and len(n.args) == 1 and not n.keywords:
            return _CALLS[n.func.id](value(n.args[0]))
        raise ValueError("not an arithmetic expression")

    try:
        return value(ast.parse(text.replace("^", "**").strip(), mode="eval").body)
    except (SyntaxError, ZeroDivisionError, OverflowError, TypeError, RecursionError) as e:
        raise ValueError(str(e)) from e


def chain_holds(chain: str, names: dict[str, complex], near: float = 1e-6) -> bool | None:
    """Whether all sides of ``a = b = c`` are equal; null if one can't be read."""
    try:
        sides = [number(s, names) for s in chain.split("=")]
    except ValueError:
        return None
    return all(cmath.isclose(a, b, rel_tol=near, abs_tol=1e-9) for a, b in zip(sides, sides[1:]))


def numeric_check(chain: Column) -> Column:
    """``chain_holds`` without variables, by batches."""

    def run(chains: pd.Series) -> pd.Series:
        return pd.Series([None if c is None else chain_holds(c, {}) for c in chains], dtype="boolean")

    run.__annotations__ = {"chains": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "boolean")(chain)


def running_state(codes: DataFrame, by: str, order: str, code: str) -> DataFrame:
    """Rows at which a pen stream breaks its rules: down while down, or up while up."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return codes.withColumn("down", F.sum(F.when(F.col(code) == 0, 1).when(F.col(code) == 1, -1).otherwise(0)).over(w)).filter(~F.col("down").isin(0, 1))
