"""Ink as tokens and back; the Scribe chain code; pair-merge vocabularies."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import half_away, half_even
from ..functions.text import GRID, SEPARATOR, Y_SHIFT

# The chain code's numbers and the steps of its directions; y grows down.
DOWN, UP = 0, 1
DIRECTIONS = {2: (0, -1), 3: (1, -1), 4: (1, 0), 5: (1, 1), 6: (0, 1), 7: (-1, 1), 8: (-1, 0), 9: (-1, -1)}


# --- grid tokens ----------------------------------------------------------------------------------------------------


def tokenize(strokes: Column, strict: bool = False) -> Column:
    """Strokes (array<array<struct<x, y>>>) as grid tokens; coordinates round half to even and are clamped, or raise if ``strict``. Empty strokes go."""

    def grid(v: Column) -> Column:
        r = half_even(v)
        if strict:
            return F.when((r >= 0) & (r <= GRID), r).otherwise(F.raise_error(F.lit("a coordinate lies off the grid"))).cast("int")
        return F.least(F.greatest(r, F.lit(0.0)), F.lit(float(GRID))).cast("int")

    def stroke(s: Column) -> Column:
        pairs = F.flatten(F.transform(s, lambda p: F.array(grid(p["x"]), grid(p["y"]) + Y_SHIFT)))
        return F.concat(F.array(F.lit(SEPARATOR)), pairs)

    return F.flatten(F.transform(F.filter(strokes, lambda s: F.size(s) > 0), stroke))


def detokenize(tokens: Column) -> Column:
    """Grid tokens as strokes: cut at separators, taken in pairs, pairs off the grid and empty strokes left out."""
    text = F.concat(F.lit(","), F.array_join(F.transform(tokens, lambda t: t.cast("string")), ","))
    cut = F.split(text, f",{SEPARATOR}(?=,|$)")

    def stroke(s: Column) -> Column:
        v = F.transform(F.filter(F.split(s, ","), lambda x: x != ""), lambda x: x.cast("int"))
        pair = lambda k: F.struct(F.get(v, k * 2).cast("double").alias("x"), (F.get(v, k * 2 + 1) - Y_SHIFT).cast("double").alias("y"))
        half = F.floor(F.size(v) / 2).cast("int")
        pairs = F.when(half > 0, F.transform(F.sequence(F.lit(0), F.greatest(half - 1, F.lit(0))), pair)).otherwise(F.array().cast("array<struct<x:double,y:double>>"))
        return F.filter(pairs, lambda p: p["x"].between(0, GRID) & p["y"].between(0, GRID))

    return F.filter(F.transform(cut, stroke), lambda s: F.size(s) > 0)


def invalid_tokens(tokens: Column) -> Column:
    """Tokens outside the vocabulary."""
    return F.filter(tokens, lambda t: (t < 0) | (t > SEPARATOR))


# --- chain code -----------------------------------------------------------------------------------------------------


def walk(dx: Column, dy: Column) -> Column:
    """Directions of the grid walk by (dx, dy), in closed form: the long axis steps each time, the short one when its share is due."""
    ax, ay = F.abs(dx), F.abs(dy)
    long, short = F.greatest(ax, ay), F.least(ax, ay)
    due = lambda k: F.floor((2 * short * k + long - 1) / (2 * long))
    sx, sy = F.signum(dx.cast("double")).cast("int"), F.signum(dy.cast("double")).cast("int")

    def step(k: Column) -> Column:
        minor = (due(k) > due(k - 1)).cast("int")
        x, y = F.when(ax >= ay, sx).otherwise(sx * minor), F.when(ax >= ay, sy * minor).otherwise(sy)
        code = F.lit(None).cast("int")
        for n, (u, v) in DIRECTIONS.items():
            code = F.when((x == u) & (y == v), F.lit(n)).otherwise(code)
        return code

    return F.when(long > 0, F.transform(F.sequence(F.lit(1), F.greatest(long, F.lit(1)).cast("int")), step)).otherwise(F.array().cast("array<int>"))


def encode_scribe(points: DataFrame, step: float = 1.0) -> DataFrame:
    """``points(ink_id, stroke_id, point_id, x, y)`` -> ``ink_id, origin_x, origin_y, tokens array<int>``.

    Coordinates are taken from the first point in steps, rounded half away from
    zero; travel between strokes is walked with the pen up. Raises on NaN and
    infinities.
    """
    w = Window.partitionBy("ink_id").orderBy("stroke_id", "point_id")
    s = Window.partitionBy("ink_id", "stroke_id").orderBy("point_id")
    finite = lambda c: F.when(F.isnan(c) | (F.abs(F.col(c)) == float("inf")), F.raise_error(F.lit("a point isn't finite"))).otherwise(F.col(c))
    rows = points.withColumns({"ox": F.first("x").over(w), "oy": F.first("y").over(w)})
    rows = rows.withColumns({"qx": half_away((finite("x") - F.col("ox")) / step).cast("int"), "qy": half_away((finite("y") - F.col("oy")) / step).cast("int")})
    dx, dy = (F.col(c) - F.coalesce(F.lag(c).over(w), F.lit(0)) for c in ("qx", "qy"))
    rows = rows.withColumns({"dx": dx, "dy": dy, "first": F.row_number().over(s) == 1, "last": F.lead("x").over(s).isNull()})
    mark = lambda c, n: F.when(F.col(c), F.array(F.lit(n))).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("part", F.concat(walk(F.col("dx"), F.col("dy")), mark("first", DOWN), mark("last", UP)))
    ordered = F.sort_array(F.collect_list(F.struct("stroke_id", "point_id", "part")))
    out = rows.groupBy("ink_id").agg(F.min(F.struct("stroke_id", "point_id", "ox", "oy")).alias("o"), ordered.alias("parts"))
    return out.select("ink_id", F.col("o.ox").alias("origin_x"), F.col("o.oy").alias("origin_y"), F.flatten("parts.part").alias("tokens"))


def decode_scribe(encoded: DataFrame, step: float = 1.0) -> DataFrame:
    """``encoded(ink_id, origin_x, origin_y, tokens)`` -> ``ink_id, stroke_id, point_id, x, y``: running sums of steps, kept while the pen is down.

    Raises on codes outside 0-9, DOWN while down, UP while up, and an end while down.
    """
    rows = encoded.select("ink_id", "origin_x", "origin_y", F.posexplode("tokens").alias("pos", "code"), F.size("tokens").alias("n"))
    w = Window.partitionBy("ink_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    move = lambda k: F.coalesce(F.element_at(F.create_map(*[F.lit(v) for n, d in DIRECTIONS.items() for v in (n, d[k])]), F.col("code")), F.lit(0))
    state = F.sum(F.when(F.col("code") == DOWN, 1).when(F.col("code") == UP, -1).otherwise(0)).over(w)
    rows = rows.withColumns({"qx": F.sum(move(0)).over(w), "qy": F.sum(move(1)).over(w), "down": state, "stroke_id": F.sum((F.col("code") == DOWN).cast("int")).over(w) - 1})
    wrong = ~F.col("code").between(0, 9) | ~F.col("down").isin(0, 1) | ((F.col("pos") == F.col("n") - 1) & (F.col("down") != 0))
    # one expression: a filter on "down" beside it would let the optimizer fold that value into the check
    kept = rows.filter(F.when(wrong, F.raise_error(F.concat(F.lit("bad pen state at token "), F.col("pos").cast("string")))).otherwise(F.col("down") == 1))
    number = F.row_number().over(Window.partitionBy("ink_id", "stroke_id").orderBy("pos")) - 1
    return kept.select("ink_id", F.col("stroke_id").cast("int").alias("stroke_id"), number.alias("point_id"), (F.col("origin_x") + F.col("qx") * step).alias("x"), (F.col("origin_y") + F.col("qy") * step).alias("y"))


# --- pair merges ----------------------------------------------------------------------------------------------------

#: Symbols are single characters from here on: base directions first, then merges by rank.
FIRST = 0xE000


def symbol(n: int) -> str:
    return chr(FIRST + n)


def runs(encoded: DataFrame) -> DataFrame:
    """``tokens`` -> ``ink_id, run_id, run string``: the directions between pen marks, a character each."""
    text = F.array_join(F.transform("tokens", lambda t: F.when(t <= UP, F.lit("|")).otherwise(F.translate(t.cast("string"), "23456789", "".join(symbol(n) for n in range(2, 10))))), "")
    return encoded.select("ink_id", F.posexplode(F.split(text, r"\|")).alias("run_id", "run")).filter("run != ''")


@dataclass(frozen=True)
class Merges:
    """Merged pairs of symbols in order; the n-th makes symbol 10 + n."""

    pairs: tuple[tuple[str, str], ...]

    def __post_init__(self) -> None:
        """Each merge is of symbols known before it, and makes a new one; raises ValueError otherwise."""
        known = {(n,) for n in range(2, 10)}
        made: dict[str, tuple[int, ...]] = {symbol(n): (n,) for n in range(2, 10)}
        for i, (a, b) in enumerate(self.pairs):
            if a not in made or b not in made:
                raise ValueError(f"merge {i} is of symbols that aren't made before it")
            if made[a] + made[b] in known:
                raise ValueError(f"merge {i} makes a symbol that is known")
            made[symbol(10 + i)] = made[a] + made[b]
            known.add(made[a] + made[b])

    def to_json(self) -> str:
        """The merges as lists of directions."""
        return json.dumps({"version": 1, "merges": [[list(self.expansion(x)) for x in pair] for pair in self.pairs]})

    @classmethod
    def from_json(cls, text: str) -> Merges:
        """What ``to_json`` wrote; ValueError for another version, form, direction or order."""
        data = json.loads(text)
        if not isinstance(data, dict) or data.get("version") != 1:
            raise ValueError("only version 1 can be read")
        if not isinstance(data.get("merges"), list):
            raise ValueError("merges must be a list")
        symbols: dict[tuple[int, ...], str] = {(n,): symbol(n) for n in range(2, 10)}
        pairs: list[tuple[str, str]] = []
        for i, pair in enumerate(data["merges"]):
            sides = pair if isinstance(pair, list) and len(pair) == 2 and all(isinstance(x, list) and x and all(isinstance(n, int) for n in x) for x in pair) else None
            if not sides or any(tuple(x) not in symbols for x in sides):
                raise ValueError(f"merge {i} isn't of two symbols made before it")
            pairs.append((symbols[tuple(sides[0])], symbols[tuple(sides[1])]))
            if tuple(sides[0] + sides[1]) in symbols:
                raise ValueError(f"merge {i} makes a symbol that is known")
            symbols[tuple(sides[0] + sides[1])] = symbol(10 + i)
        return cls(tuple(pairs))

    def expansion(self, c: str) -> tuple[int, ...]:
        n = ord(c) - FIRST
        return (n,) if n < 10 else tuple(d for x in self.pairs[n - 10] for d in self.expansion(x))

    def vocabulary(self) -> list[tuple[int, ...]]:
        return [(n,) for n in range(10)] + [self.expansion(symbol(10 + i)) for i in range(len(self.pairs))]

    def encode(self, run: Column) -> Column:
        """A run with all merges applied, greedily from the left, in order."""
        for i, (a, b) in enumerate(self.pairs):
            run = F.replace(run, F.lit(a + b), F.lit(symbol(10 + i)))
        return run

    def decode(self, run: Column) -> Column:
        for i, (a, b) in reversed(list(enumerate(self.pairs))):
            run = F.replace(run, F.lit(symbol(10 + i)), F.lit(a + b))
        return run


def adjacent(run: Column) -> Column:
    """The pairs of neighbouring symbols of a run, overlaps included, in one walk over its characters."""
    symbols = F.filter(F.split(run, ""), lambda c: c != "")
    n = F.greatest(F.size(symbols) - 1, F.lit(0))
    return F.zip_with(F.slice(symbols, F.lit(1), n), F.slice(symbols, F.lit(2), n), lambda a, b: F.concat(a, b))


def pair_counts(table: DataFrame) -> DataFrame:
    """Adjacent pairs of symbols, overlaps counted: ``pair, n``."""
    return table.select(F.explode(adjacent(F.col("run"))).alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))


def fit_merges(table: DataFrame, merges: int, every: int = 8) -> Merges:
    """Learn merges from ``table(run)``: the most frequent pair each time, ties to the lexicographically least expansions.

    The driver sees the leading pairs only, never the corpus.  Identical runs
    are counted once with their number; the rewritten table is kept in memory
    from merge to merge, and checkpointed every few merges where the session
    names a folder for it, so that the plan stays short.
    """
    found = Merges(())
    lasting = bool(table.sparkSession.conf.get("spark.checkpoint.dir", None))
    now = table.groupBy("run").agg(F.count("*").alias("times")).persist()
    for i in range(merges):
        counts = now.select("times", F.explode(adjacent(F.col("run"))).alias("pair")).groupBy("pair").agg(F.sum("times").alias("n"))
        top = counts.groupBy("n").agg(F.collect_list("pair").alias("pairs")).orderBy(F.desc("n")).limit(1).collect()
        if not top:
            break
        best = min(top[0]["pairs"], key=lambda p: (found.expansion(p[0]), found.expansion(p[1])))
        found = Merges((*found.pairs, (best[0], best[1])))
        after = now.withColumn("run", F.replace("run", F.lit(best), F.lit(symbol(10 + i))))
        after = after.checkpoint() if lasting and (i + 1) % every == 0 else after.persist()
        after.count()
        now.unpersist()
        now = after
    now.unpersist()
    return found
