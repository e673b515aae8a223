"""Queries of gates, components and glyphs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from ..operators import glyphs, symbols
from ..sources import documents
from . import views
from .files import _folder
from .queries import _r, query
from .views import table

# --- gates ----------------------------------------------------------------------------------------------------------

_GATE = "['and2', 'or2', 'xor2', 'nand2', 'nor2', 'xnor2', 'not', 'buf'][(page + idx) % 8 + 1]"


def _gates(spark, d) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, symbols.GATES)), ((F.col("page") + F.col("idx")) % 8 + 1).cast("int"))
    return views.boxes(spark, d).select("page", "idx", kind.alias("kind"), "l", "t", "r", "b")


@query(f"""SELECT page, idx, kind, port, CASE port WHEN 'y' THEN r ELSE l END AS x, CASE WHEN port = 'y' OR kind IN ('not', 'buf') THEN (t + b) / 2 WHEN port = 'a' THEN (3 * t + b) / 4 ELSE (t + 3 * b) / 4 END AS y
FROM (SELECT *, {_GATE} AS kind FROM v_box), (VALUES ('a'), ('b'), ('y')) v(port) WHERE port <> 'b' OR kind NOT IN ('not', 'buf')""", "v_box")
def g25_gate_ports(spark, d):
    return symbols.gate_ports(_gates(spark, d)).select("page", "idx", "kind", "port", "x", "y")


def _rounded(v: np.ndarray, n: int) -> np.ndarray:
    """Half away from zero, as SQL does."""
    many = v * 10.0**n
    return np.where(np.abs(many) < 1 << 52, np.trunc(many + np.copysign(0.5, many)) / 10.0**n, v)


def _sums(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    ends = [_rounded(v[:, k], 6) for k in (0, -1) for v in (x, y)]
    return [np.full(len(x), x.shape[1]), _rounded(x.sum(1) + 0.0000123, 4), _rounded(y.sum(1) + 0.0000123, 4), _rounded(np.einsum("sp,sp->s", x, y) + 0.00123, 2), *ends]


#: Of each stroke: how many points, their sums (a little more, so that none is just between two rounded values), and where it begins and ends.
_SUMMED = [("points", LongType()), *((c, DoubleType()) for c in ("x", "y", "xy", "x0", "y0", "x1", "y1"))], _sums


def _outline_sql(strokes: str) -> str:
    """Strokes with ``p``, a list of points, summed up as in ``_sums``."""
    n = "list_sum(list_transform(p, lambda q: q.{}))"
    ends = ", ".join(f"round(p[{at}].{c}, 6) AS {c}{k}" for k, at in ((0, 1), (1, -1)) for c in "xy")
    return f"SELECT page, idx, kind, part, stroke, len(p) AS points, round({n.format('x')} + 0.0000123, 4) AS x, round({n.format('y')} + 0.0000123, 4) AS y, round(list_sum(list_transform(p, lambda q: q.x * q.y)) + 0.00123, 2) AS xy, {ends} FROM ({strokes})"


def _at(x: str, y: str) -> str:
    return f"{{'x': ({x})::DOUBLE, 'y': ({y})::DOUBLE}}"


def _bend(p0: tuple, p1: tuple, p2: tuple, first: int = 0) -> str:
    mix = [f"((1 - i / 16) ** 2 * ({a}) + 2 * (1 - i / 16) * (i / 16) * ({b}) + (i / 16) ** 2 * ({c}))" for a, b, c in zip(p0, p1, p2)]
    return f"list_transform(range({first}, 17), lambda i: {_at(*mix)})"


_ROUND = "list_transform(range({n} + 1), lambda i: {{'x': {x} {s} {r} * sin({a} * i / {n}), 'y': {y} - {r} * cos({a} * i / {n})}})"
_OR = ("bx", "t"), ("bx + 0.6 * (xe - bx)", "t"), ("xe", "ym"), ("bx + 0.6 * (xe - bx)", "b"), ("bx", "b"), ("bx + 0.24 * w", "ym")


@query(f"""WITH g AS (
  SELECT *, r - l AS w, b - t AS h, (t + b) / 2 AS ym, kind IN ('nand2', 'nor2', 'xnor2', 'not') AS inverted, CASE WHEN inverted THEN r - 0.14::DOUBLE * (b - t) ELSE r END AS xe,
    l + CASE WHEN kind IN ('xor2', 'xnor2') THEN 0.12::DOUBLE * (r - l) ELSE 0 END AS bx
  FROM (SELECT page, idx, l, t, r, b, {_GATE} AS kind FROM v_box)
), s AS (
  SELECT page, idx, kind, 'body' AS part, 0 AS stroke, list_concat([{_at('l', 't')}, {_at('xe - h / 2', 't')}], {_ROUND.format(n=16, x='xe - h / 2', s='+', r='h / 2', a='pi()', y='ym')}, [{_at('l', 'b')}, {_at('l', 't')}]) AS p FROM g WHERE kind IN ('and2', 'nand2')
  UNION ALL SELECT page, idx, kind, 'body', 0, list_concat({_bend(_OR[0], _OR[1], _OR[2])}, {_bend(_OR[2], _OR[3], _OR[4], 1)}, {_bend(_OR[4], _OR[5], _OR[0], 1)}) FROM g WHERE kind IN ('or2', 'nor2', 'xor2', 'xnor2')
  UNION ALL SELECT page, idx, kind, 'xor_curve', 0, {_bend(('l', 't'), ('l + 0.24 * w', 'ym'), ('l', 'b'))} FROM g WHERE kind IN ('xor2', 'xnor2')
  UNION ALL SELECT page, idx, kind, 'stubs', k, [{_at('l', 't + (0.25 + k / 2) * h')}, {_at('bx + 0.09 * w', 't + (0.25 + k / 2) * h')}] FROM g, (VALUES (0), (1)) v(k) WHERE kind IN ('or2', 'nor2', 'xor2', 'xnor2')
  UNION ALL SELECT page, idx, kind, 'body', 0, [{_at('l', 't')}, {_at('xe', 'ym')}, {_at('l', 'b')}, {_at('l', 't')}] FROM g WHERE kind IN ('not', 'buf')
  UNION ALL SELECT page, idx, kind, 'bubble', 0, {_ROUND.format(n=12, x='xe + 0.07 * h', s='-', r='0.07 * h', a='2 * pi()', y='ym')} FROM g WHERE inverted
) {_outline_sql('FROM s')}""", "v_box")
def g25_gate_shapes(spark, d):
    return symbols.gate_strokes(_gates(spark, d), "page", "idx", summary=_SUMMED)


# --- components -----------------------------------------------------------------------------------------------------

_KIND = "['resistor', 'capacitor', 'inductor', 'diode', 'voltage_source', 'current_source', 'battery', 'ground', 'terminal'][(page + idx) % 9 + 1]"


def _components(spark, d) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, symbols.COMPONENTS)), ((F.col("page") + F.col("idx")) % 9 + 1).cast("int"))
    return views.boxes(spark, d).select("page", "idx", kind.alias("kind"), *[F.col(c).alias(n) for c, n in zip("ltrb", ("ax", "ay", "bx", "by"))], F.lit(0.5).alias("size"))


@query(f"""SELECT page, idx, kind, 'a' AS port, l AS x, t AS y FROM (SELECT *, {_KIND} AS kind FROM v_box)
UNION ALL SELECT page, idx, kind, 'b', r, b FROM (SELECT *, {_KIND} AS kind FROM v_box) WHERE kind NOT IN ('ground', 'terminal')""", "v_box")
def g26_component_ports(spark, d):
    return symbols.component_ports(_components(spark, d)).select("page", "idx", "kind", "port", "x", "y")


def _on(s: str, n: str = "0") -> str:
    """A point at distance s along a component and n across."""
    return _at(f"l + ux * ({s}) - uy * ({n})", f"t + uy * ({s}) + ux * ({n})")


_RING = _ROUND.format(n=28, x="(l + ux * m)", s="-", r="body / 2", a="2 * pi()", y="(t + uy * m)")


@query(f"""WITH c AS (
  SELECT *, len / 2 AS m, least(15, 0.7::DOUBLE * len) AS body, (len - body) / 2 AS s0, (len + body) / 2 AS s1, (r - l) / len AS ux, (b - t) / len AS uy
  FROM (SELECT page, idx, l, t, r, b, {_KIND} AS kind, sqrt((r - l) ** 2 + (b - t) ** 2) AS len FROM v_box)
), two AS (
  SELECT page, idx, kind, part, stroke, p FROM (
    SELECT *, CASE kind
      WHEN 'resistor' THEN [{{'part': 'body', 'stroke': 0, 'p': list_concat([{_on('0')}, {_on('s0')}], list_transform(range(6), lambda i: {_on('s0 + body * (i + 0.5) / 6', '0.17 * body * (1 - 2 * (i % 2))')}), [{_on('s1')}, {_on('len')}])}}]
      WHEN 'inductor' THEN [{{'part': 'body', 'stroke': 0, 'p': list_concat([{_on('0')}, {_on('s0')}], flatten(list_transform(range(4), lambda i: list_transform(range(1, 9), lambda k:
        {_on('s0 + body / 8 * (2 * i + 1) - body / 8 * cos(pi() * k / 8)', '-1.6 * body / 8 * sin(pi() * k / 8)')}))), [{_on('len')}])}}]
      WHEN 'capacitor' THEN [{{'part': 'lead_a', 'stroke': 0, 'p': [{_on('0')}, {_on('m - 0.06 * body')}]}}, {{'part': 'body', 'stroke': 0, 'p': [{_on('m - 0.06 * body', '-0.225 * body')}, {_on('m - 0.06 * body', '0.225 * body')}]}},
        {{'part': 'body', 'stroke': 1, 'p': [{_on('m + 0.06 * body', '-0.225 * body')}, {_on('m + 0.06 * body', '0.225 * body')}]}}, {{'part': 'lead_b', 'stroke': 0, 'p': [{_on('m + 0.06 * body')}, {_on('len')}]}}]
      WHEN 'battery' THEN [{{'part': 'lead_a', 'stroke': 0, 'p': [{_on('0')}, {_on('m - 0.06 * body')}]}}, {{'part': 'body', 'stroke': 0, 'p': [{_on('m - 0.06 * body', '-0.225 * body')}, {_on('m - 0.06 * body', '0.225 * body')}]}},
        {{'part': 'body', 'stroke': 1, 'p': [{_on('m + 0.06 * body', '-0.1125 * body')}, {_on('m + 0.06 * body', '0.1125 * body')}]}}, {{'part': 'lead_b', 'stroke': 0, 'p': [{_on('m + 0.06 * body')}, {_on('len')}]}}]
      WHEN 'diode' THEN [{{'part': 'lead_a', 'stroke': 0, 'p': [{_on('0')}, {_on('s0 + 0.15 * body')}]}},
        {{'part': 'body', 'stroke': 0, 'p': [{_on('s0 + 0.15 * body', '-0.3 * body')}, {_on('s0 + 0.15 * body', '0.3 * body')}, {_on('s1 - 0.15 * body')}, {_on('s0 + 0.15 * body', '-0.3 * body')}]}},
        {{'part': 'body', 'stroke': 1, 'p': [{_on('s1 - 0.15 * body', '-0.3 * body')}, {_on('s1 - 0.15 * body', '0.3 * body')}]}}, {{'part': 'lead_b', 'stroke': 0, 'p': [{_on('s1 - 0.15 * body')}, {_on('len')}]}}]
      ELSE list_concat([{{'part': 'lead_a', 'stroke': 0, 'p': [{_on('0')}, {_on('s0')}]}}, {{'part': 'body', 'stroke': 0, 'p': {_RING}}}, {{'part': 'lead_b', 'stroke': 0, 'p': [{_on('s1')}, {_on('len')}]}}],
        CASE kind WHEN 'voltage_source' THEN [{{'part': 'sign', 'stroke': 0, 'p': [{_on('m - body / 4', '-body / 8')}, {_on('m - body / 4', 'body / 8')}]}}, {{'part': 'sign', 'stroke': 1, 'p': [{_on('m - 0.375 * body')}, {_on('m - 0.125 * body')}]}},
          {{'part': 'sign', 'stroke': 2, 'p': [{_on('m + body / 4', '-body / 8')}, {_on('m + body / 4', 'body / 8')}]}}]
        ELSE [{{'part': 'sign', 'stroke': 0, 'p': [{_on('m + 0.275 * body')}, {_on('m - 0.275 * body')}]}}, {{'part': 'sign', 'stroke': 1, 'p': [{_on('m - 0.1 * body', '-0.15 * body')}, {_on('m - 0.275 * body')}, {_on('m - 0.1 * body', '0.15 * body')}]}}] END)
      END AS pieces FROM c WHERE kind NOT IN ('ground', 'terminal')
  ), LATERAL (SELECT unnest(pieces, recursive := false) AS piece) u, LATERAL (SELECT piece.part AS part, piece.stroke AS stroke, piece.p AS p) v
), one AS (
  SELECT page, idx, kind, 'lead' AS part, 0 AS stroke, [{_at('l', 't')}, {_at('l', 't + 4')}] AS p FROM c WHERE kind = 'ground'
  UNION ALL SELECT page, idx, kind, 'body', k, [{_at('l - [4, 2.4, 1][k + 1]', 't + [4, 5.6, 7.2][k + 1]')}, {_at('l + [4, 2.4, 1][k + 1]', 't + [4, 5.6, 7.2][k + 1]')}] FROM c, range(3) v(k) WHERE kind = 'ground'
  UNION ALL SELECT page, idx, kind, 'body', 0, {_ROUND.format(n=12, x='l', s='-', r='1.25', a='2 * pi()', y='t')} FROM c WHERE kind = 'terminal'
) {_outline_sql('FROM two UNION ALL FROM one')}""", "v_box")
def g26_component_shapes(spark, d):
    return symbols.component_strokes(_components(spark, d), "page", "idx", summary=_SUMMED)


# --- glyphs ---------------------------------------------------------------------------------------------------------


def _fonts(spark, d) -> DataFrame:
    """Three SVG fonts of the characters in the parts' names, written as files and read again: each lacks every fifth character."""
    chars = table(spark, d, "part").select(F.explode(F.split("p_name", "")).alias("ch")).filter("ch <> ''").distinct()
    chars = chars.unionByName(spark.createDataFrame([(c,) for c in glyphs.CAPITALS], "ch string")).distinct().withColumn("code", F.ascii("ch"))
    at = _folder(spark, "fonts")
    for k in range(3):
        own = chars.filter((F.col("code") % 5 != k) | F.col("ch").isin(*glyphs.CAPITALS))
        top = F.when(F.col("ch").isin(*glyphs.CAPITALS), 700 + 50 * k).otherwise(500 + F.col("code") % 200)
        glyph = F.format_string('<glyph unicode="&#%d;" horiz-adv-x="%d" d="M0 0L%d %d"/>', "code", 300 + F.col("code") % 17 * 10 + 25 * k, F.col("code") % 50, top)
        body = own.agg(F.array_join(F.sort_array(F.collect_list(glyph)), "").alias("body"))
        body.select(F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg"><defs><font horiz-adv-x="500">'), "body", F.lit("</font></defs></svg>"))).coalesce(1).write.text(f"{at}/font{k}")
    rows = documents.read_svg_glyphs(spark, f"{at}/font*")
    return glyphs.cap_scaled(rows.select(F.regexp_extract("file", r"/(font\d)/", 1).alias("font"), "ch", "advance", "strokes"))


_GLYPHS = """
line AS (SELECT p_partkey AS id, unnest(string_split(p_name, '')) AS ch, generate_subscripts(string_split(p_name, ''), 1) - 1 AS pos FROM part
), glyph AS (
  SELECT ch, k, ascii(ch) AS code, (300 + ascii(ch) % 17 * 10 + 25 * k)::DOUBLE / (700 + 50 * k) AS advance,
    (CASE WHEN ch IN ('H', 'E') THEN 700 + 50 * k ELSE 500 + ascii(ch) % 200 END)::DOUBLE / (700 + 50 * k) AS top FROM (SELECT DISTINCT ch FROM line), range(3) r(k)
  WHERE ascii(ch) % 5 <> k OR ch IN ('H', 'E')
)"""


@query(f"""WITH {_GLYPHS}, pool AS (SELECT ch, max(advance) AS advance FROM glyph GROUP BY ch HAVING count(*) = 3)
SELECT id, round(coalesce(sum(advance), 0), 6) AS width, count(*) FILTER (advance IS NULL) AS missing FROM line LEFT JOIN pool USING (ch) GROUP BY id""")
def t11_pool_widths(spark, d):
    """The width of each part's name that is safe for all fonts of the pool, by the fonts' own advances."""
    own = _fonts(spark, d)
    labels = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"))
    return glyphs.text_widths(labels, glyphs.pool_advances(own, own.select("font"))).select("id", _r("width").alias("width"), "missing")


@query(f"""WITH {_GLYPHS}, first AS (SELECT ch, min(k) AS k, arg_min(advance, k) AS advance, arg_min(top, k) AS top FROM glyph GROUP BY ch
), laid AS (
  SELECT id, pos, k, top, advance, code, sum(advance) OVER (PARTITION BY id ORDER BY pos) - advance AS x FROM (SELECT l.id, l.pos, f.k, f.advance, f.top, ascii(l.ch) AS code FROM line l JOIN first f USING (ch))
)
SELECT id, count(*) AS glyphs, count(*) FILTER (k > 0) AS fallbacks, round(max(x + advance), 6) AS width, round(max(top), 6) AS top, round(max(x + code % 50 / (700 + 50 * k)), 6) AS right_ FROM laid GROUP BY id""")
def t22_laid_out(spark, d):
    """Each part's name in glyphs: the first of three fonts that has a character, at the place that the advances before make."""
    own = _fonts(spark, d)
    pool = own.select("font").distinct().withColumn("place", F.substr("font", F.lit(5), F.lit(1)).cast("int"))
    rows = glyphs.laid_out(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text")), own, pool)
    each = F.flatten("strokes")
    far = lambda c: F.max(F.array_max(F.transform(each, lambda p: p[c])))
    return rows.groupBy("id").agg(
        F.count("*").alias("glyphs"), F.count_if(F.col("font") != "font0").alias("fallbacks"), _r(F.max(F.col("x") + F.col("advance"))).alias("width"), _r(far("y")).alias("top"), _r(far("x")).alias("right_")
    )
