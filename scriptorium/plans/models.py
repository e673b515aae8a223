"""Queries of what stands around models: scoring, formulas, charts, routes, packing."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import charts, formulas, packing, routing, scoring
from ..operators.lineage import dealt
from . import views
from .queries import _r, query
from .views import table

# --- scoring --------------------------------------------------------------------------------------------------------


def keyed_model() -> scoring.Model:
    """A stand-in for a model: two strokes that follow from page and index; for one crop in three only a second prompt gives ink, for one in eleven none."""

    def ask(batch: pa.RecordBatch, prompt: str) -> list[str]:
        out = []
        for page, idx, label in zip(*(batch.column(n).to_pylist() for n in ("page", "idx", "label"))):
            key = page * 7 + idx
            ink = "".join(f"<ink_token_{t}>" for t in (450, key % 225, 225 + key % 199, 450, 224 - key % 101, 300))
            seen = key % 11 > 0 and (key % 3 > 0 or prompt == scoring.DERENDER)
            text = label if prompt == scoring.RECOGNIZE else ""
            out.append(f"{text[:1]}{ink}{text[1:]}" if seen else text)
        return out

    return ask


_SCORED = """
k AS (
  SELECT page, idx, label, l, t, greatest(trunc(r)::INT - trunc(l)::INT, 1) AS pw, greatest(trunc(b)::INT - trunc(t)::INT, 1) AS ph, page * 7 + idx AS key FROM v_box
), f AS (
  SELECT *, least(224 / pw::DOUBLE, 224 / ph::DOUBLE) AS ratio, key % 11 > 0 AND key % 3 > 0 AS first, key % 11 > 0 AS inked FROM k
), g AS (
  SELECT *, floor((224 - greatest(1, trunc(pw * ratio))) / 2) AS dx, floor((224 - greatest(1, trunc(ph * ratio))) / 2) AS dy FROM f
), s AS (
  SELECT page, idx, NOT first AS used_fallback, CASE WHEN first THEN 1 ELSE 2 END AS passes, CASE WHEN first THEN label ELSE '' END AS text, CASE WHEN inked THEN 2 ELSE 0 END AS strokes,
    CASE WHEN inked THEN round((key % 225 - dx) / ratio + l, 6) END AS x, CASE WHEN inked THEN round((key % 199 - dy) / ratio + t, 6) END AS y,
    CASE WHEN inked THEN round((75 - dy) / ratio + t, 6) END AS y_last
  FROM g
)"""


def _derendered(spark, d) -> DataFrame:
    return scoring.derendered(views.boxes(spark, d).select("page", "idx", "l", "t", "r", "b", "label"), keyed_model)


@query(f"WITH {_SCORED} SELECT page, idx, used_fallback, passes::INT AS passes, text, strokes::INT AS strokes, x, y, y_last FROM s", "v_box")
def m1_scored(spark, d):
    """Every box as a crop of its page, scored in one pass or two, its strokes back on the page."""
    point = lambda s, p, c: _r(F.get(F.get("strokes", s), F.lit(p))[c])
    rows = _derendered(spark, d)
    return rows.select("page", "idx", "used_fallback", "passes", "text", F.size("strokes").alias("strokes"), point(0, 0, "x").alias("x"), point(0, 0, "y").alias("y"), point(1, 0, "y").alias("y_last"))


@query(f"""WITH {_SCORED} SELECT page, coalesce(string_agg(text, ' ' ORDER BY idx) FILTER (text <> ''), '') AS text, sum(strokes)::INT AS strokes, bool_or(used_fallback) AS any_fallback,
  sum(passes)::BIGINT AS passes FROM s GROUP BY page""", "v_box")
def m2_scored_pages(spark, d):
    """The crops of each page as one ink, with how often its crops were scored."""
    rows = _derendered(spark, d)
    return scoring.merged_pages(rows, F.sum("passes").alias("passes")).select("page", "text", F.size("strokes").alias("strokes"), "any_fallback", "passes")


# --- formulas -------------------------------------------------------------------------------------------------------

#: Formulas of parts, by the part's key; ? stands for a formula inside, by its size. The seventh to tenth can't be read.
FORMULAS = [
    r"\frac{?}{y_1}+\sqrt[3]{?^2}", r"\frac ?\frac12 y", r"\left(\frac{?}{y}\right)^{?+1}_2", r"\begin{matrix}? & y\\ 1 & 2\end{matrix}", r"\sqrt\frac ?y^2", r"\hat{?}_{y_{?}}^{\sqrt{y}}",
    r"{?}{{y}", r"?}y", r"?^2^y", r"\frac{?}", r"\sqrt[{y}+1]{?}-\left[y\right]", "",
]
_LISTED = ", ".join(f"'{f}'" for f in FORMULAS)
_OPENS, _SCRIPTS = r"['{', '\left', '\begin{matrix}']", "['^', '_']"


def _formulas(spark, d) -> DataFrame:
    """A formula of each part, with another one inside."""
    listed = F.array(*map(F.lit, FORMULAS))
    inner = F.replace(F.element_at(listed, (F.col("p_size") % 6 + 1).cast("int")), F.lit("?"), F.expr("chr(97 + p_partkey % 26)"))
    outer = F.replace(F.element_at(listed, (F.col("p_partkey") % 12 + 1).cast("int")), F.lit("?"), F.concat(F.lit("{"), inner, F.lit("}")))
    return table(spark, d, "part").select(F.col("p_partkey").alias("formula"), outer.alias("latex"))


_FORMULAS = rf"""
text AS (
  SELECT p_partkey AS formula, replace([{_LISTED}][p_partkey % 12 + 1], '?', '{{' || replace([{_LISTED}][p_size % 6 + 1], '?', chr((97 + p_partkey % 26)::INT)) || '}}') AS latex FROM part
), raw AS (
  SELECT formula, regexp_extract_all(latex, '(?s)\\(?:begin|end)\{{[A-Za-z*]+\}}|\\[A-Za-z]+|\\.|.') AS t FROM text
)"""


@query(f"WITH {_FORMULAS} SELECT formula, t.unnest AS token, count(*) AS n FROM raw, unnest(t) t GROUP BY ALL")
def t1_latex_tokens(spark, d):
    """How often each token stands in each formula: commands, environments and single characters."""
    return dealt(_formulas(spark, d), formulas.TASK_ROWS, "formula").select("formula", F.explode(tx.latex_tokens(F.col("latex"))).alias("token")).groupBy("formula", "token").agg(F.count("*").alias("n"))


@query(rf"""WITH RECURSIVE {_FORMULAS}, tok AS (
  SELECT formula, list_filter(list_transform(range(1, len(t) + 1), lambda i: {{'p': i - 1, 't': t[i], 'd': CASE WHEN t[i] IN ('\left', '\right') THEN t[i + 1] END, 'skip': t[i] = ' ' OR (i > 1 AND t[i - 1] IN ('\left', '\right'))}}), lambda x: NOT x.skip) AS toks FROM raw
), run AS (
  SELECT formula, 0 AS i, [{{'n': -1, 'w': -1, 'e': '', 'b': -1, 's': '', 'd': ''}}] AS stack, NULL::BIGINT AS node, NULL::BIGINT AS parent, NULL::VARCHAR AS kind, NULL::VARCHAR AS value, NULL::VARCHAR AS error,
    NULL::BIGINT AS fence, NULL::VARCHAR AS fence_value FROM tok
  UNION ALL
  SELECT formula, i + 1,
    CASE WHEN error IS NOT NULL OR tk.t IS NULL THEN stack
      WHEN arity > 0 OR opens THEN list_append(CASE WHEN script THEN list_append(stack[:-2], {{'n': top.n, 'w': top.w, 'e': top.e, 'b': top.b, 's': top.s || tk.t, 'd': top.d}}) ELSE stack END,
        {{'n': tk.p, 'w': CASE WHEN opens THEN -1 ELSE arity END, 'e': CASE WHEN tk.t = '{{' THEN '}}' WHEN tk.t = '\left' THEN '\right' WHEN tk.t = '[' THEN ']' WHEN opens THEN '\end{{matrix}}' WHEN script THEN 'script' ELSE '' END, 'b': -1, 's': '', 'd': coalesce(tk.d, '')}})
      ELSE list_append(kept[:-2], CASE WHEN kept[-1].w = 2 THEN {{'n': kept[-1].n, 'w': 1, 'e': kept[-1].e, 'b': kept[-1].b, 's': kept[-1].s, 'd': kept[-1].d}}
        WHEN was_script THEN kept[-1] ELSE {{'n': kept[-1].n, 'w': kept[-1].w, 'e': kept[-1].e, 'b': outermost, 's': '', 'd': kept[-1].d}} END) END,
    CASE WHEN NOT closes THEN tk.p END,
    CASE WHEN script AND top.b >= 0 THEN top.b WHEN top.n >= 0 THEN top.n END,
    CASE WHEN tk.t = '[' AND opens THEN 'index' WHEN tk.t = '{{' THEN 'group' WHEN tk.t = '\left' THEN 'fence' WHEN opens THEN 'matrix' WHEN script THEN 'script' WHEN arity > 0 THEN 'command' ELSE 'symbol' END,
    CASE WHEN NOT opens THEN tk.t END,
    CASE WHEN error IS NOT NULL THEN error WHEN tk.t IS NULL THEN CASE WHEN top.w > 0 THEN 'missing argument' ELSE 'unbalanced' END
      WHEN (closes OR script) AND top.w > 0 THEN 'missing argument' WHEN closes AND top.e <> tk.t THEN 'unbalanced' WHEN script AND contains(top.s, tk.t) THEN 'double script' END,
    CASE WHEN closes AND tk.t = '\right' THEN top.n END, CASE WHEN closes AND tk.t = '\right' THEN top.d || tk.d END
  FROM (
    SELECT *, len(base) - coalesce(list_max(list_filter(range(1, len(base) + 1), lambda k: base[k].w <> 1)), 0) AS done, base[:len(base) - done] AS kept,
      done > 0 AND base[len(base) - done + 1].e = 'script' AS was_script, CASE WHEN done > 0 THEN base[len(base) - done + 1].n ELSE CASE WHEN closes THEN top.n ELSE tk.p END END AS outermost
    FROM (
      SELECT *, CASE WHEN closes THEN stack[:-2] ELSE stack END AS base FROM (
        SELECT r.*, k.toks[r.i + 1] AS tk, r.stack[-1] AS top, k.toks[r.i + 1].t IN {_SCRIPTS} AS script,
          coalesce(list_contains({_OPENS}, k.toks[r.i + 1].t) OR (k.toks[r.i + 1].t = '[' AND r.i > 0 AND k.toks[r.i].t = '\sqrt'), false) AS opens,
          coalesce(k.toks[r.i + 1].t IN ('}}', '\right', '\end{{matrix}}') OR (k.toks[r.i + 1].t = ']' AND list_filter(r.stack, lambda f: f.w < 0)[-1].e = ']'), false) AS closes,
          CASE WHEN k.toks[r.i + 1].t = '\frac' OR (k.toks[r.i + 1].t = '\sqrt' AND k.toks[r.i + 2].t = '[') THEN 2 WHEN k.toks[r.i + 1].t IN ('\sqrt', '\hat', '^', '_') THEN 1 ELSE 0 END AS arity, len(k.toks) AS n
        FROM run r JOIN tok k USING (formula) WHERE r.error IS NULL AND r.i <= len(k.toks) AND (r.i < len(k.toks) OR len(r.stack) > 1)
      )
    )
  )
), bad AS (
  SELECT formula, max(error) AS error FROM run WHERE error IS NOT NULL GROUP BY formula
), fences AS (
  SELECT formula, fence, fence_value FROM run WHERE fence IS NOT NULL
), good AS (
  SELECT r.formula, r.node, r.parent, row_number() OVER (PARTITION BY r.formula, r.parent ORDER BY r.node) - 1 AS place, r.kind, CASE WHEN r.kind = 'fence' THEN f.fence_value ELSE r.value END AS value
  FROM run r LEFT JOIN fences f ON f.formula = r.formula AND f.fence = r.node WHERE r.node IS NOT NULL AND r.formula NOT IN (SELECT formula FROM bad)
)
SELECT formula, node::INT AS node, coalesce(parent, -1)::INT AS parent, place::INT AS place, kind, value, NULL::VARCHAR AS error FROM good
UNION ALL SELECT formula, -1, -1, -1, NULL, NULL, error FROM bad
UNION ALL SELECT formula, -1, -1, -1, NULL, NULL, NULL FROM tok WHERE len(toks) = 0""")
def t16_formula_nodes(spark, d):
    """The trees of formulas made from the parts' keys and sizes."""
    out = formulas.formula_nodes(_formulas(spark, d))
    return out.withColumns({c: F.coalesce(c, F.lit(-1)).cast("int") for c in ("node", "parent", "place")})


@query(r"""
WITH r AS (
  SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '\sin' WHEN 2 THEN '\log x+\alpha' ELSE '\arctan\frac{' || p_size || '}{2}' END AS latex FROM part
), t AS (
  SELECT p_partkey, latex, list_filter(regexp_extract_all(latex, '(?s)\\(?:begin|end)\{[A-Za-z*]+\}|\\[A-Za-z]+|\\.|.'), lambda x: x <> ' ') AS t FROM r
)
SELECT p_partkey, latex, array_to_string(flatten(list_transform(t, lambda x: CASE WHEN x IN ('\sin', '\arctan') THEN string_split(x[2:], '') ELSE [x] END)), ' ') AS tokens FROM t""")
def t21_replies(spark, d):
    """Formulas out of JSON replies, some of which are broken; a writer that knows the logarithm spells other functions."""
    k = F.col("p_partkey") % 4
    size = F.col("p_size").cast("string")
    body = F.when(k == 1, F.lit(r"$\\sin$")).when(k == 2, F.lit(r" `$$\\log x+\\alpha$` ")).otherwise(F.concat(F.lit(r"`\\arctan\\frac{"), size, F.lit(r"}{2}`")))
    reply = F.when(k == 0, F.lit("no reply")).otherwise(F.concat(F.lit('{"box": {}, "latex": "'), body, F.lit('"}')))
    rows = table(spark, d, "part").select("p_partkey", tx.reply_formula(reply).alias("latex"))
    tokens = F.filter(tx.latex_tokens(F.col("latex")), lambda t: t != " ")
    return rows.select("p_partkey", "latex", F.array_join(tx.spelled(tokens, F.array(F.lit(r"\log"))), " ").alias("tokens"))


# --- charts ---------------------------------------------------------------------------------------------------------


def _chart(spark, d) -> tuple[DataFrame, DataFrame]:
    """The boxes of a page as nodes of a chart, in writing order, and up to two edges from each."""
    items = views.items(spark, d).select(F.col("page").alias("chart"), "idx", "pos", *[F.col(c).cast("int").alias(c) for c in "lt"])
    items = items.withColumn("n", F.count("*").over(Window.partitionBy("chart")))
    edge = lambda at, dst, keep: F.struct(F.lit(at).alias("k"), (1 + dst % F.col("n")).alias("dst"), keep.alias("keep"))
    both = F.array(edge(0, F.col("l") * 3 + F.col("idx"), (F.col("l") + F.col("idx")) % 4 > 0), edge(1, F.col("t") * 5 + F.col("idx") * 2, (F.col("l") + F.col("t") + F.col("idx")) % 3 > 0))
    edges = items.select("chart", F.col("idx").alias("src"), F.explode(both).alias("e")).filter("e.keep")
    return items.select("chart", F.col("idx").alias("node"), F.col("pos").alias("place")), edges.select("chart", (F.col("src") * 2 + F.col("e.k")).alias("at"), "src", F.col("e.dst").cast("int").alias("dst"))


_CHART = """
item AS (SELECT page, idx::INT AS idx, pos, l::INT AS l, t::INT AS t, count(*) OVER (PARTITION BY page) AS n FROM v_item
), edge AS (
  SELECT page, idx AS src, k, (1 + CASE k WHEN 0 THEN l * 3 + idx ELSE t * 5 + idx * 2 END % n)::INT AS dst FROM item, (SELECT unnest([0, 1]) AS k)
  WHERE CASE k WHEN 0 THEN (l + idx) % 4 ELSE (l + t + idx) % 3 END > 0
), chart AS (
  SELECT page, list(idx ORDER BY pos) AS nodes FROM item GROUP BY page
), outs AS (
  SELECT i.page, i.idx, coalesce(list(e.dst ORDER BY e.k) FILTER (e.dst IS NOT NULL), []) AS outs FROM item i LEFT JOIN edge e ON e.page = i.page AND e.src = i.idx GROUP BY ALL
), roots AS (
  SELECT page, list_concat(list_filter(nodes, lambda x: NOT list_contains(coalesce(used, []), x)), nodes) AS roots FROM chart LEFT JOIN (SELECT page, list(dst) AS used FROM edge GROUP BY page) USING (page)
)"""


@query(f"""WITH RECURSIVE {_CHART}, walk AS (
  SELECT page, []::INT[] AS found, []::INT[] AS stack, []::INT[] AS nexts, []::VARCHAR[] AS back FROM chart
  UNION ALL
  SELECT page,
    CASE WHEN entered IS NOT NULL THEN list_append(found, entered) ELSE found END,
    CASE WHEN left_ THEN stack[:-2] WHEN entered IS NOT NULL THEN list_append(stack, entered) ELSE stack END,
    CASE WHEN left_ THEN nexts[:-2] WHEN len(stack) = 0 THEN [0] ELSE list_concat(nexts[:-2], [nexts[-1] + 1], CASE WHEN entered IS NOT NULL THEN [0] ELSE [] END) END,
    CASE WHEN len(stack) > 0 AND NOT left_ AND list_contains(stack, target) AND NOT list_contains(back, stack[-1] || '>' || target) THEN list_append(back, stack[-1] || '>' || target) ELSE back END
  FROM (
    SELECT *, coalesce(len(stack) > 0 AND nexts[-1] >= len(outs), false) AS left_,
      CASE WHEN len(stack) = 0 THEN root WHEN nexts[-1] < len(outs) AND NOT list_contains(found, target) THEN target END AS entered
    FROM (
      SELECT w.*, o.outs, o.outs[w.nexts[-1] + 1] AS target, list_filter(r.roots, lambda x: NOT list_contains(w.found, x))[1] AS root
      FROM walk w JOIN roots r USING (page) LEFT JOIN outs o ON o.page = w.page AND o.idx = w.stack[-1]
    )
  ) WHERE len(stack) > 0 OR root IS NOT NULL
)
SELECT page, array_to_string(found, ',') AS nodes, array_to_string(back, ',') AS back FROM walk JOIN (SELECT page, len(nodes) AS n FROM chart) USING (page) WHERE len(stack) = 0 AND len(found) = n""", "v_box", "v_item")
def l10_chart_order(spark, d):
    nodes, edges = _chart(spark, d)
    out = charts.chart_order(nodes, edges)
    text = F.transform("back", lambda b: F.concat_ws(">", b["src"].cast("string"), b["dst"].cast("string")))
    return out.select(F.col("chart").alias("page"), F.array_join(F.transform("nodes", lambda n: n.cast("string")), ",").alias("nodes"), F.array_join(text, ",").alias("back"))


# --- wires ----------------------------------------------------------------------------------------------------------


@query("""
WITH RECURSIVE cell AS (
  SELECT o_custkey AS page, (o_orderkey % 12)::INT AS i, (o_totalprice::BIGINT % 10)::INT AS j, o_orderstatus, o_orderkey % 2 = 0 AS level FROM orders
), wall AS (
  SELECT DISTINCT page, i, j FROM cell WHERE o_orderstatus = 'F'
), wire AS (
  SELECT page, i, j, bool_or(level) AS level, bool_or(NOT level) AS upright FROM cell WHERE o_orderstatus = 'O' GROUP BY ALL
), beside AS (
  SELECT page, i, j, sum(level)::INT AS level, sum(upright)::INT AS upright FROM (
    SELECT page, i, j + y AS j, level::INT AS level, 0 AS upright FROM wire, (VALUES (-1), (1)) v(y) UNION ALL SELECT page, i + x, j, 0, upright::INT FROM wire, (VALUES (-1), (1)) v(x)
  ) GROUP BY ALL
), ask AS (
  SELECT c_custkey AS page, (c_custkey % 3)::INT AS si, (c_custkey % 10)::INT AS sj, (11 - c_custkey % 4)::INT AS ti, (c_custkey * 7 % 10)::INT AS tj FROM customer
), best(page, i, j, d, cost, path) USING KEY (page, i, j, d) AS (
  SELECT page, si, sj, d::INT, 0::DOUBLE, '' FROM ask, range(4) x(d)
  UNION
  SELECT m.page, m.i, m.j, m.o, m.m.cost, m.m.path FROM (
    SELECT m.page, m.i, m.j, m.o, min({'cost': m.cost + CASE WHEN m.target THEN 0 ELSE (CASE WHEN w.page IS NULL THEN 0 ELSE 6 END) + 1.5 * coalesce(CASE WHEN m.o % 2 = 0 THEN n.level ELSE n.upright END, 0) END, 'path': m.path}) AS m
    FROM (
      SELECT page, i, j, o, cost, path, i = ti AND j = tj AS target FROM (
        SELECT b.page, b.i + [1, 0, -1, 0][o.o + 1] AS i, b.j + [0, 1, 0, -1][o.o + 1] AS j, o.o::INT AS o, b.cost + 1 + CASE WHEN o.o = b.d THEN 0 ELSE 3 END AS cost, b.path || 'RDLU'[o.o + 1] AS path
        FROM best b CROSS JOIN range(4) o(o) LEFT JOIN wire h ON h.page = b.page AND h.i = b.i AND h.j = b.j WHERE o.o <> (b.d + 2) % 4 AND (h.page IS NULL OR o.o = b.d)
      ) JOIN ask USING (page) WHERE i BETWEEN 0 AND 11 AND j BETWEEN 0 AND 9
    ) m LEFT JOIN wall x ON x.page = m.page AND x.i = m.i AND x.j = m.j LEFT JOIN wire w ON w.page = m.page AND w.i = m.i AND w.j = m.j LEFT JOIN beside n ON n.page = m.page AND n.i = m.i AND n.j = m.j
    WHERE m.target OR (x.page IS NULL AND (w.page IS NULL OR CASE WHEN m.o % 2 = 0 THEN NOT w.level ELSE NOT w.upright END))
    GROUP BY ALL
  ) m LEFT JOIN recurring.best r ON r.page = m.page AND r.i = m.i AND r.j = m.j AND r.d = m.o WHERE r.page IS NULL OR m.m < {'cost': r.cost, 'path': r.path}
)
SELECT a.page, min(b.cost) AS cost, arg_min(b.path, {'cost': b.cost, 'path': b.path}) AS path FROM ask a LEFT JOIN best b ON b.page = a.page AND b.i = a.ti AND b.j = a.tj GROUP BY a.page
""")
def l9_routes(spark, d):
    """A wire across the sheet of each customer, whose orders are obstacles and wires that lie there already."""
    cell = table(spark, d, "orders").select(
        F.col("o_custkey").alias("page"), (F.col("o_orderkey") % 12).cast("int").alias("i"), (F.bround("o_totalprice").cast("long") % 10).cast("int").alias("j"), "o_orderstatus", (F.col("o_orderkey") % 2 == 0).alias("level")
    )
    at = lambda v: v.cast("int")
    k = F.col("c_custkey")
    ask = table(spark, d, "customer").select(k.alias("page"), F.lit(0).alias("net"), at(k % 3).alias("si"), at(k % 10).alias("sj"), at(11 - k % 4).alias("ti"), at(k * 7 % 10).alias("tj"))
    found = routing.routes(ask, cell.filter("o_orderstatus = 'F'"), cell.filter("o_orderstatus = 'O'"), 12, 10)
    return found.select("page", "cost", "path")


# --- packing --------------------------------------------------------------------------------------------------------


def _blocks(spark, d) -> DataFrame:
    """The boxes of a page as blocks, the first and fifth as headings."""
    rows = views.boxes(spark, d).select("page", "idx", (F.col("idx") % 4 == 1).alias("heading"), (F.col("r") - F.col("l")).alias("w"), (F.col("b") - F.col("t")).alias("h"))
    return rows.withColumn("h", F.when(F.col("heading"), F.lit(8.0)).otherwise(F.col("h")))


_KEPT = """
block AS (
  SELECT page, idx, r - l AS w, CASE WHEN idx % 4 = 1 THEN 8.0::DOUBLE ELSE b - t END AS h, coalesce(sum((idx % 4 <> 1)::INT) OVER (PARTITION BY page ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM v_box
), part AS (
  SELECT *, coalesce(sum(h + 3.0) OVER (PARTITION BY page, g ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS dy FROM block
), kept AS (
  SELECT page, min(idx) AS idx, max(w) AS w, max(dy + h) AS h, string_agg(idx || '@' || dy::INT, ' ' ORDER BY idx) AS members FROM part GROUP BY page, g
)"""


@query(f"WITH {_KEPT} SELECT page, idx, w, h, members FROM kept", "v_box")
def l3_kept_with_next(spark, d):
    out = packing.kept_with_next(_blocks(spark, d), 3.0)
    members = F.array_join(F.transform("members", lambda m: F.concat_ws("@", m["idx"].cast("string"), m["dy"].cast("int").cast("string"))), " ")
    return out.select("page", "idx", "w", "h", members.alias("members"))


def _free_sql(x: str, y: str) -> str:
    near = f"{x} - near < p.x + p.w AND p.x - near < {x} + w AND {y} - near < p.y + p.h AND p.y - near < {y} + h"
    return f"({x} >= 2.5 AND {y} >= 2.5 AND {x} + w <= width - 2.5 AND {y} + h <= height - 2.5 AND len(list_filter(placed, lambda p: {near})) = 0)"


@query(f"""WITH RECURSIVE {_KEPT}, page AS (
  SELECT page, list({{'idx': idx, 'w': w, 'h': h}} ORDER BY idx) AS b FROM kept GROUP BY page
), attempt AS (
  SELECT a, CASE WHEN a <= 2 THEN 1.0 WHEN a = 3 THEN 0.92 WHEN a = 4 THEN 0.8464 ELSE 0.778688 END::DOUBLE AS scale, CASE WHEN a < 6 THEN 1.0 WHEN a < 9 THEN 1.25 ELSE 1.5 END::DOUBLE AS board FROM (SELECT unnest(range(12)) AS a)
), fold AS (
  SELECT page, a, 0 AS n, []::STRUCT(x DOUBLE, y DOUBLE, w DOUBLE, h DOUBLE)[] AS placed, 0::DOUBLE AS col, false AS lost FROM page, attempt
  UNION ALL
  SELECT page, a, n + 1, CASE WHEN c IS NULL THEN placed ELSE list_append(placed, {{'x': c.x, 'y': c.y, 'w': w, 'h': h}}) END, CASE WHEN c.new THEN c.x ELSE col END, c IS NULL FROM (
    SELECT *, coalesce(list_filter(CASE WHEN n = 0 THEN [{{'x': 5::DOUBLE, 'y': 5::DOUBLE, 'new': true}}] WHEN a % 2 = 1 THEN [beside, below, fresh] ELSE [below, beside, fresh] END, lambda s: {_free_sql('s.x', 's.y')})[1],
      list_filter(flatten(list_transform(range(greatest(floor((height - h - 5) / 10), 0)::BIGINT + 1), lambda j: list_transform(range(greatest(floor((width - w - 5) / 10), 0)::BIGINT + 1), lambda i: {{'x': 5 + i * 10::DOUBLE, 'y': 5 + j * 10::DOUBLE, 'new': true}}))),
        lambda s: {_free_sql('s.x', 's.y')})[1]) AS c
    FROM (
      SELECT f.*, p.b[f.n + 1].w * t.scale AS w, p.b[f.n + 1].h * t.scale AS h, 160 * t.board AS width, 130 * t.board AS height, 4 * t.scale * 0.6 AS near,
        {{'x': f.col, 'y': f.placed[-1].y + f.placed[-1].h + 4 * t.scale, 'new': false}} AS below, {{'x': f.placed[-1].x + f.placed[-1].w + 6 * t.scale, 'y': f.placed[-1].y, 'new': true}} AS beside,
        {{'x': list_max(list_transform(f.placed, lambda p: p.x + p.w)) + 6 * t.scale, 'y': 5::DOUBLE, 'new': true}} AS fresh
      FROM fold f JOIN page p USING (page) JOIN attempt t USING (a) WHERE NOT f.lost AND f.n < len(p.b)
    )
  )
), best AS (
  SELECT page, min(a) AS a FROM fold JOIN page USING (page) WHERE NOT lost AND n = len(b) GROUP BY page
)
SELECT p.page, coalesce(best.a, -1)::INT AS attempt, p.b[k].idx AS idx, round(f.placed[k].x, 6) AS x, round(f.placed[k].y, 6) AS y
FROM page p LEFT JOIN best USING (page) LEFT JOIN fold f ON f.page = p.page AND f.a = best.a AND f.n = len(p.b), LATERAL (SELECT unnest(range(1, len(p.b) + 1)) AS k) r""", "v_box")
def l5_layouts(spark, d):
    """The blocks of each page, headings kept with the next, on a sheet of 160 by 130, by the first attempt that fits."""
    blocks = packing.kept_with_next(_blocks(spark, d), 3.0)
    out = packing.layouts(blocks, 160.0, 130.0, 4.0, 6.0, 5.0)
    return out.select("page", F.coalesce("attempt", F.lit(-1)).alias("attempt"), "idx", _r("x").alias("x"), _r("y").alias("y"))
