"""Queries of the operators that follow longer rules: tokens, clocks, layouts, and global orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import text as tx
from ..operators import augment, corpus, evaluation, paths, sequences, spatial, validation
from ..operators.lineage import dealt
from ..sources import ink
from . import views
from .queries import _FLOW, _nodes, _r, query
from .views import table

# --- readings as tokens ---------------------------------------------------------------------------------------------

#: Each turn is the label that the next turn of its conversation is a reading of; tokens are words. ``costs`` holds the
#: cost matrix row by row; drops along a row are a running minimum.
_READS = r"""
turns AS MATERIALIZED (
  SELECT conv_id, turn, tokens AS label, lead(tokens) OVER (PARTITION BY conv_id ORDER BY turn) AS read
  FROM (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS tokens FROM conversations)
), pairs AS MATERIALIZED (
  SELECT conv_id, turn, label, read FROM turns WHERE label IS NOT NULL AND read IS NOT NULL
), costs AS (
  SELECT conv_id, turn, 0 AS i, range(len(label) + 1) AS costs FROM pairs
  UNION ALL
  SELECT conv_id, turn, i + 1, list_transform(range(len(label) + 1), lambda j: j + list_min(list_transform(range(j + 1), lambda k: c[k + 1] - k)))
  FROM (
    SELECT conv_id, turn, i, label, list_transform(range(len(label) + 1), lambda k:
      CASE WHEN k = 0 THEN costs[1] + 1 ELSE least(costs[k] + (label[k] <> read[i + 1])::INT, costs[k + 1] + 1) END) AS c
    FROM costs JOIN pairs USING (conv_id, turn) WHERE i < len(read)
  )
), reads AS (
  SELECT conv_id, turn, costs[len(label) + 1]::INT AS errors, len(label)::BIGINT AS tokens FROM costs JOIN pairs USING (conv_id, turn) WHERE i = len(read)
)"""
#: The way back through the matrix: matches and exchanges before drops, drops before additions.
_SCRIPT = r""", matrix AS MATERIALIZED (
  SELECT conv_id, turn, list(costs ORDER BY i) AS m FROM costs GROUP BY conv_id, turn
), way AS (
  SELECT conv_id, turn, 0 AS step, len(read) AS i, len(label) AS j, '' AS kind FROM pairs
  UNION ALL
  SELECT conv_id, turn, step + 1, CASE WHEN kind = 'drop' THEN i ELSE i - 1 END, CASE WHEN kind = 'add' THEN j ELSE j - 1 END, kind
  FROM (
    SELECT conv_id, turn, step, i, j, CASE
      WHEN i > 0 AND j > 0 AND m[i + 1][j + 1] = m[i][j] + (read[i] <> label[j])::INT THEN CASE WHEN read[i] = label[j] THEN 'same' ELSE 'sub' END
      WHEN j > 0 AND (i = 0 OR m[i + 1][j + 1] = m[i + 1][j] + 1) THEN 'drop' ELSE 'add' END AS kind
    FROM way JOIN matrix USING (conv_id, turn) JOIN pairs USING (conv_id, turn) WHERE i > 0 OR j > 0
  )
), script AS (
  SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn ORDER BY step) AS place, kind,
    CASE WHEN kind <> 'add' THEN label[j + 1] END AS label_token, CASE WHEN kind <> 'drop' THEN read[i + 1] END AS read_token
  FROM way JOIN pairs USING (conv_id, turn) WHERE kind IN ('sub', 'drop', 'add')
)"""


def _pairs(spark, d) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    # the work by row is large for its bytes, so that partitions aren't merged by size
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = table(spark, d, "conversations").repartition(parts, "conv_id").select("conv_id", "turn", tx.words(F.col("text")).alias("label"))
    return rows.withColumn("read", F.lead("label").over(w)).filter("label is not null and read is not null")


def _reads(spark, d) -> DataFrame:
    return _pairs(spark, d).select("conv_id", "turn", tx.token_distance(F.col("read"), F.col("label")).alias("errors"), F.size("label").cast("long").alias("tokens"))


@query(f"WITH RECURSIVE {_READS} SELECT conv_id, turn, errors FROM reads")
def e1_edit_distance(spark, d):
    return _reads(spark, d).select("conv_id", "turn", "errors")


@query(f"WITH RECURSIVE {_READS} {_SCRIPT} SELECT * FROM script")
def e2_edit_script(spark, d):
    """Every mistake in order from the end, with its tokens."""
    ops = F.posexplode(evaluation.edit_ops(F.col("read"), F.col("label"))).alias("at", "op")
    rows = _pairs(spark, d).select("conv_id", "turn", ops)
    return rows.select("conv_id", "turn", (F.col("at") + 1).cast("long").alias("place"), "op.kind", F.col("op.label").alias("label_token"), F.col("op.read").alias("read_token"))


@query(f"WITH RECURSIVE {_READS} {_SCRIPT} SELECT * FROM script")
def e2_edit_script_sql(spark, d):
    """The same through the SQL table function."""
    evaluation.register_edit_script(spark)
    pairs = _pairs(spark, d).select(F.concat_ws(":", "conv_id", "turn").alias("id"), "read", "label")
    rows = spark.sql("SELECT * FROM edit_script(TABLE(SELECT * FROM {pairs}) PARTITION BY id)", pairs=pairs)
    key = F.split("id", ":")
    return rows.select(key[0].cast("long").alias("conv_id"), key[1].cast("long").alias("turn"), "place", "kind", "label_token", "read_token")


@query(f"WITH RECURSIVE {_READS} SELECT conv_id % 7 AS grp, count(*) AS n, round(sum(errors) / sum(tokens), 6) AS error_rate, round(avg((errors = 0)::INT), 6) AS exact FROM reads GROUP BY 1")
def a3_error_rate(spark, d):
    rows = evaluation.error_rate(_reads(spark, d).withColumn("grp", F.col("conv_id") % 7), "grp")
    return rows.withColumns({c: _r(c) for c in ("error_rate", "exact")})


@query(f"WITH RECURSIVE {_READS} {_SCRIPT} SELECT coalesce(label_token, read_token) AS token, kind, count(*) AS n FROM script GROUP BY ALL")
def a4_error_kinds(spark, d):
    """How often each token is added, dropped or read as another."""
    ops = F.explode(evaluation.edit_ops(F.col("read"), F.col("label"))).alias("op")
    rows = _pairs(spark, d).select(ops).select(F.coalesce("op.label", "op.read").alias("token"), "op.kind")
    return rows.groupBy("token", "kind").agg(F.count("*").alias("n"))


@query(f"""WITH RECURSIVE {_READS}
SELECT CASE WHEN tokens <= 5 THEN '1-5' WHEN tokens <= 10 THEN '6-10' WHEN tokens <= 20 THEN '11-20' WHEN tokens <= 50 THEN '21-50' END AS len,
  count(*) AS n, round(sum(errors) / sum(tokens), 6) AS error_rate
FROM reads WHERE tokens > 0 GROUP BY 1""")
def a6_bucketed_rates(spark, d):
    rows = _reads(spark, d).filter("tokens > 0").withColumn("len", evaluation.bucket(F.col("tokens"), 5, 10, 20, 50))
    return evaluation.error_rate(rows, "len").select("len", "n", _r("error_rate").alias("error_rate"))


# --- global orders --------------------------------------------------------------------------------------------------


@query("""
SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS i, count(*) OVER () AS n FROM documents)
WHERE list_contains(list_transform(range(9), lambda k: floor(k * (n - 1) / 8)::BIGINT), i)""")
def w9_evenly_spaced(spark, d):
    return evaluation.evenly(table(spark, d, "documents").select("doc_id", "n_chars"), 9, "n_chars", "doc_id").select("doc_id")


@query("SELECT doc_id, ((row_number() OVER (ORDER BY md5('7:' || doc_id::VARCHAR), doc_id) - 1) // 64)::INT AS shard FROM documents")
def o4_shuffle(spark, d):
    return corpus.sharded(table(spark, d, "documents").select("doc_id"), "doc_id", 64, 7)


@query("SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5('7:' || doc_id::VARCHAR), doc_id) AS i FROM documents) WHERE i <= 5")
def o5_sample(spark, d):
    return corpus.picked(table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id", 5, 7)


@query("""
SELECT lang, doc_id FROM (
  SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents
) WHERE i % greatest(n // 5, 1) = 0""")
def o6_stratified(spark, d):
    return corpus.stratified(table(spark, d, "documents").select("lang", "n_chars", "doc_id"), "lang", ["n_chars", "doc_id"], 5).select("lang", "doc_id")


@query("SELECT doc_id, ((row_number() OVER (ORDER BY doc_id) - 1) // 128)::INT AS shard FROM documents")
def o11_chunks(spark, d):
    return corpus.chunked(table(spark, d, "documents").select("doc_id"), "doc_id", 128)


@query("""
WITH RECURSIVE o AS (
  SELECT source, chunk, doc_id, len, row_number() OVER (PARTITION BY source, chunk ORDER BY i) AS k
  FROM (SELECT source, doc_id, n_chars::INT AS len, row_number() OVER w - 1 AS i, (row_number() OVER w - 1) // 32 AS chunk FROM documents WINDOW w AS (PARTITION BY source ORDER BY n_chars, doc_id))
), f AS (
  SELECT source, chunk, 0::BIGINT AS k, 0 AS batch, 0 AS n, NULL::BIGINT AS doc_id, NULL::INT AS len FROM (SELECT DISTINCT source, chunk FROM o)
  UNION ALL
  SELECT f.source, f.chunk, o.k, CASE WHEN f.n > 0 AND o.len * (f.n + 1) > 20000 THEN batch + 1 ELSE batch END,
    CASE WHEN f.n > 0 AND o.len * (f.n + 1) > 20000 THEN 1 ELSE f.n + 1 END, o.doc_id, o.len
  FROM f JOIN o ON o.source = f.source AND o.chunk = f.chunk AND o.k = f.k + 1
)
SELECT source, chunk, doc_id, len, batch FROM f WHERE k > 0""")
def o12_batches(spark, d):
    rows = table(spark, d, "documents").select("source", "doc_id", F.col("n_chars").cast("int").alias("len"))
    return corpus.batches(rows, "source", "doc_id", "len", 20_000, 32)


@query("""
SELECT source, doc_id // 64 AS page, string_agg(lang, ' ' ORDER BY doc_id) AS text, sum(n_chars)::BIGINT AS points, bool_or(n_chars < 30) AS fallback
FROM documents GROUP BY source, doc_id // 64""")
def a14_page_merge(spark, d):
    """A page is 64 ids of a source: what is joined in a row is bounded."""
    text = F.array_join(F.sort_array(F.collect_list(F.struct("doc_id", "lang")))["lang"], " ")
    rows = table(spark, d, "documents").groupBy("source", F.expr("doc_id div 64").alias("page"))
    return rows.agg(text.alias("text"), F.sum("n_chars").alias("points"), F.bool_or(F.col("n_chars") < 30).alias("fallback"))


@query("SELECT ink_id // 16 AS page, count(DISTINCT (ink_id, stroke_id))::BIGINT AS strokes, count(*)::BIGINT AS points, min(x) AS l FROM v_ink GROUP BY 1", "v_ink")
def g5_merge_inks(spark, d):
    page = views.inks(spark, d).groupBy(F.expr("ink_id div 16").alias("page")).agg(F.flatten(F.collect_list("strokes")).alias("s"))
    return page.select("page", F.size("s").cast("long").alias("strokes"), F.size(F.flatten("s")).cast("long").alias("points"), g.bounds(F.flatten("s"))["l"].alias("l"))


# --- ink ------------------------------------------------------------------------------------------------------------

#: Ink at points at most 4 apart, in cells of 8; pages are 16 inks, and two of three are text, which looks around.
_CELLS = """
seg AS (
  SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM v_ink WINDOW w AS (PARTITION BY ink_id, stroke_id ORDER BY point_id)
), part AS (
  SELECT *, greatest(ceil(sqrt((x - px) * (x - px) + (y - py) * (y - py)) / 4), 1)::INT AS n FROM seg WHERE px IS NOT NULL
), dense AS (
  SELECT ink_id, px + (x - px) * k / n AS x, py + (y - py) * k / n AS y FROM (SELECT *, unnest(range(1, n + 1)) AS k FROM part)
  UNION ALL SELECT ink_id, x, y FROM seg WHERE px IS NULL
), cell AS (
  SELECT DISTINCT ink_id // 16 AS page, ink_id AS item, ink_id % 3 <> 0 AS probes, floor(x / 8)::BIGINT AS cx, floor(y / 8)::BIGINT AS cy FROM dense
)"""


def _hits(radius: int) -> str:
    return f"""
hits AS (
  SELECT page, least(item, other) AS a, greatest(item, other) AS b, count(*) AS hits FROM (
    SELECT DISTINCT p.page, p.item, q.item AS other, p.cx, p.cy FROM cell p JOIN cell q ON p.page = q.page AND p.item <> q.item
      AND (p.cx - q.cx) * (p.cx - q.cx) + (p.cy - q.cy) * (p.cy - q.cy) <= {radius * radius} WHERE p.probes
  ) GROUP BY ALL
)"""


def _inked(spark, d) -> DataFrame:
    """The cells of ``_cells`` as a list for each ink; inks are dealt by page before they become cells."""
    page = F.expr("vec_id div 16").alias("page")
    rows = dealt(table(spark, d, "embeddings").filter("vec_id is not null and embedding is not null").select(page, "vec_id", "embedding"), 5_000, "page")
    inks = views.inks_of(rows, "page")
    cell = lambda p: F.struct(F.floor(p["x"] / 8).alias("cx"), F.floor(p["y"] / 8).alias("cy"))
    cells = F.transform(paths.densified(F.col("strokes"), 4), cell)
    return inks.select("page", F.col("ink_id").alias("item"), (F.col("ink_id") % 3 != 0).alias("probes"), cells.alias("cells"))


def _cells(spark, d) -> DataFrame:
    dense = paths.densify(views.ink(spark, d), 4)
    cell = lambda c: F.floor(F.col(c) / 8).alias(f"c{c}")
    return dense.select(F.expr("ink_id div 16").alias("page"), F.col("ink_id").alias("item"), (F.col("ink_id") % 3 != 0).alias("probes"), cell("x"), cell("y")).distinct()


@query(f"WITH {_CELLS}, {_hits(2)} SELECT * FROM hits WHERE hits >= 10", "v_ink")
def j9_near_ink(spark, d):
    return spatial.near_items(_inked(spark, d), 2, 10)


@query(f"WITH {_CELLS}, {_hits(3)} SELECT * FROM hits WHERE hits >= 3 AND NOT (a % 4 = 0 AND b = a + 1)", "v_ink")
def v12_clearance(spark, d):
    """Clean pages: 2.5 cells, three hits; an underline (every fourth ink) may touch what comes after it."""
    allowed = table(spark, d, "embeddings").filter("vec_id % 4 = 0").select(F.expr("vec_id div 16").alias("page"), F.col("vec_id").alias("a"), (F.col("vec_id") + 1).alias("b"))
    return spatial.near_items(_inked(spark, d), 3, 3, allowed)


@query(f"WITH {_CELLS} SELECT page, cx, cy, count(*) AS items FROM cell GROUP BY ALL", "v_ink")
def a13_grid_cells(spark, d):
    return _cells(spark, d).groupBy("page", "cx", "cy").agg(F.count("*").alias("items"))


#: As in p3, for ink in another unit: each stroke in ceil(length / 0.9) equal parts.
_SMALL = """
small AS (SELECT ink_id, stroke_id, point_id, x * 0.1::DOUBLE AS x, y * 0.1::DOUBLE AS y FROM v_ink),
seg AS (
  SELECT *, coalesce(sqrt((x - px) ** 2 + (y - py) ** 2), 0) AS d
  FROM (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM small WINDOW w AS (PARTITION BY ink_id, stroke_id ORDER BY point_id))
), way AS (
  SELECT *, sum(d) OVER (PARTITION BY ink_id, stroke_id ORDER BY point_id ROWS UNBOUNDED PRECEDING) AS s FROM seg
), tot AS (
  SELECT ink_id, stroke_id, max(s) AS total, ceil(max(s) / 0.9)::INT AS n FROM way GROUP BY ALL
), smp AS (
  SELECT *, unnest(range(n + 1)) AS k FROM tot
), pt AS (
  SELECT t.ink_id, t.stroke_id, k, t.n, t.total, min(w.s) FILTER (WHERE w.s >= k * total / n - 1e-9) AS hit FROM smp t JOIN way w USING (ink_id, stroke_id) GROUP BY ALL
), xy AS (
  SELECT a.ink_id, a.stroke_id, k, k = a.n AS eos,
    CASE WHEN k = 0 OR k = a.n OR w.d = 0 THEN w.x ELSE w.px + (w.x - w.px) * (k * a.total / a.n - (w.s - w.d)) / w.d END AS x
  FROM pt a JOIN way w ON w.ink_id = a.ink_id AND w.stroke_id = a.stroke_id AND w.s = a.hit
)"""


@query(f"WITH {_SMALL} SELECT ink_id, stroke_id, k AS point_id, round(x - coalesce(lag(x) OVER (PARTITION BY ink_id ORDER BY stroke_id, k), x), 4) AS dx, eos FROM xy", "v_ink")
def p10_convert_units(spark, d):
    return paths.to_spacing(views.ink(spark, d), 0.1, 0.9).select("ink_id", "stroke_id", F.col("point_id").cast("long").alias("point_id"), F.round("dx", 4).alias("dx"), "eos")


@query(r"""
WITH size AS (
  SELECT ink_id, count(*) AS n, quantile_cont(y, 0.98::DOUBLE) - quantile_cont(y, 0.02::DOUBLE) AS tall, max(x) - min(x) AS width, count(DISTINCT stroke_id) AS strokes FROM v_ink GROUP BY ink_id
), label AS (
  SELECT doc_id AS ink_id, lang || CASE WHEN doc_id % 5 = 0 THEN ' a b c d' ELSE '' END AS label FROM documents
)
SELECT ink_id FROM size JOIN label USING (ink_id)
WHERE n >= 2 AND tall < 1200 AND width / greatest(length(label), 1) > 60 AND width / greatest(length(label), 1) < 400
  AND strokes >= len(list_filter(regexp_split_to_array(label, '\s+'), lambda w: w <> ''))""", "v_ink")
def p15_plausible(spark, d):
    label = F.concat("lang", F.when(F.col("doc_id") % 5 == 0, " a b c d").otherwise(""))
    return paths.plausible(views.ink(spark, d), table(spark, d, "documents").select(F.col("doc_id").alias("ink_id"), label.alias("label")))


@query("""
WITH c AS (
  SELECT ink_id, stroke_id, point_id, (stroke_id * 8 + point_id + ink_id % 5) // 4 - 1 AS char, ink_id % 8 + 1 AS n FROM v_ink
), past AS (
  SELECT ink_id, stroke_id, arg_min(char, point_id) >= any_value(n) AS past FROM c GROUP BY ALL
), last AS (
  SELECT ink_id, max(stroke_id) FILTER (WHERE NOT past) AS last FROM past GROUP BY ink_id
)
SELECT ink_id, stroke_id, point_id, greatest(least(char, n - 1), 0) AS char, point_id = 7 AS eos FROM c JOIN last USING (ink_id) WHERE stroke_id <= last""", "v_ink")
def p16_trim_strokes(spark, d):
    char = F.expr("(stroke_id * 8 + point_id + ink_id % 5) div 4 - 1")
    rows = views.ink(spark, d).select("ink_id", "stroke_id", "point_id", char.alias("char"), (F.col("ink_id") % 8 + 1).alias("n"))
    return paths.trimmed(rows).select("ink_id", "stroke_id", "point_id", "char", "eos")


def _chance(*key: str) -> str:
    """DuckDB's twin of ``augment.chance``."""
    return f"(('0x' || substr(md5(concat_ws(':', {', '.join(key)})), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def _normal(c: str) -> str:
    u, v = (_chance("ink_id", "stroke_id", "point_id", f"'{c}{k}'") for k in (1, 2))
    return f"sqrt(-2 * ln(1 - {u})) * cos(2 * pi() * {v}) * 0.003"


@query(f"""
WITH drawn AS (
  SELECT *, ({_chance("ink_id", "'turn'")} * 2 - 1) * 0.1 AS a, ({_chance("ink_id", "'shear'")} * 2 - 1) * 0.2 AS s, exp(({_chance("ink_id", "'stretch'")} * 2 - 1) * 0.15) AS w FROM v_ink
)
SELECT ink_id, stroke_id, point_id, round(cos(a) * w * x + (cos(a) * s - sin(a)) * y + {_normal("x")}, 6) AS x, round(sin(a) * w * x + (sin(a) * s + cos(a)) * y + {_normal("y")}, 6) AS y
FROM drawn""", "v_ink")
def p23_affine(spark, d):
    rows = augment.affine(views.ink(spark, d), "ink_id")
    return rows.select("ink_id", "stroke_id", "point_id", _r("x").alias("x"), _r("y").alias("y"))


#: Speeds of 40 to 75 a second along each stroke, sampled 20 times a second.
_TIMED = """
seg AS (
  SELECT *, 40 + 5 * point_id AS speed, lag(x) OVER w AS px, lag(y) OVER w AS py FROM v_ink WINDOW w AS (PARTITION BY ink_id, stroke_id ORDER BY point_id)
), way AS (
  SELECT *, sum(coalesce(sqrt((x - px) ** 2 + (y - py) ** 2) / ((speed + speed - 5) / 2.0::DOUBLE), 0)) OVER (PARTITION BY ink_id, stroke_id ORDER BY point_id ROWS UNBOUNDED PRECEDING) AS t FROM seg
), total AS (
  SELECT ink_id, stroke_id, max(t) AS duration, ceil(max(t) * 20)::INT AS n FROM way GROUP BY ALL
), times AS (
  SELECT ink_id, stroke_id, k / 20.0::DOUBLE AS t FROM (SELECT *, unnest(range(n)) AS k FROM total) WHERE NOT (n > 1 AND k = n - 1 AND duration - k / 20.0::DOUBLE < 0.002)
  UNION ALL SELECT ink_id, stroke_id, duration FROM total
), found AS (
  SELECT s.ink_id, s.stroke_id, s.t, min(w.point_id) AS point_id FROM times s JOIN way w ON w.ink_id = s.ink_id AND w.stroke_id = s.stroke_id AND w.point_id > 0 AND w.t >= s.t GROUP BY ALL
)
SELECT f.ink_id, f.stroke_id, row_number() OVER (PARTITION BY f.ink_id, f.stroke_id ORDER BY f.t) - 1 AS sample, round(f.t, 6) AS t,
  round(CASE WHEN w.t > p.t THEN p.x + (f.t - p.t) / (w.t - p.t) * (w.x - p.x) ELSE p.x END, 4) AS x
FROM found f JOIN way w ON w.ink_id = f.ink_id AND w.stroke_id = f.stroke_id AND w.point_id = f.point_id
  JOIN way p ON p.ink_id = f.ink_id AND p.stroke_id = f.stroke_id AND p.point_id = f.point_id - 1"""


@query(f"WITH {_TIMED}", "v_ink")
def w11_timed_samples(spark, d):
    rows = paths.timed(views.ink(spark, d).withColumn("speed", 40 + 5 * F.col("point_id")), 20)
    return rows.select("ink_id", "stroke_id", F.col("sample").cast("long").alias("sample"), _r("t").alias("t"), F.round("x", 4).alias("x"))


@query(r"""
WITH RECURSIVE words AS MATERIALIZED (
  SELECT item_id, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS w FROM benchmark
), lines AS (
  SELECT item_id, 1 AS i, 1 AS line, w[1] AS held FROM words WHERE len(w) > 0
  UNION ALL
  SELECT item_id, i + 1, CASE WHEN length(held) + 1 + length(w[i + 1]) <= 40 THEN line ELSE line + 1 END, CASE WHEN length(held) + 1 + length(w[i + 1]) <= 40 THEN held || ' ' || w[i + 1] ELSE w[i + 1] END
  FROM lines JOIN words USING (item_id) WHERE i < len(w)
), whole AS (
  SELECT item_id, line, arg_max(held, i) AS held FROM lines GROUP BY ALL
)
SELECT b.item_id, coalesce(t.n, 0)::INT AS lines, coalesce(t.text, '') AS text FROM benchmark b
LEFT JOIN (SELECT item_id, count(*) AS n, string_agg(held, chr(10) ORDER BY line) AS text FROM whole GROUP BY item_id) t ON t.item_id = b.item_id""")
def t10_wrap_lines(spark, d):
    lines = tx.wrapped(tx.words(F.col("text")), 40)
    return table(spark, d, "benchmark").select("item_id", F.size(lines).alias("lines"), F.array_join(lines, "\n").alias("text"))


@query(r"""
SELECT count(*) FILTER (WHERE tokens > 50) AS too_long, count(*) FILTER (WHERE tokens <= 50 AND n_chars > 200) AS too_many_points, count(*) FILTER (WHERE tokens <= 50 AND n_chars <= 200) AS kept
FROM (SELECT n_chars, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS tokens FROM documents)""")
def v14_drop_rules(spark, d):
    rows = table(spark, d, "documents").select(tx.words(F.col("text")).alias("tokens"), "n_chars")
    rows = corpus.dropped(rows, "tokens", "n_chars", 50, 200)
    return rows.agg(F.count_if(F.col("reason") == "tokens").alias("too_long"), F.count_if(F.col("reason") == "points").alias("too_many_points"), F.count_if(F.col("reason").isNull()).alias("kept"))


# --- geometry -------------------------------------------------------------------------------------------------------


@query("""
SELECT s_suppkey, round(sum(10 - s_nationkey * sin(i * 2 * pi() / 24)), 6) AS sx, round(min(20 - s_nationkey * cos(i * 2 * pi() / 24)), 6) AS top,
  round(sum(i * (20 - s_nationkey * cos(i * 2 * pi() / 24))), 6) AS turned
FROM supplier, (SELECT unnest(range(25)) AS i) GROUP BY s_suppkey""")
def g24_circle(spark, d):
    points = g.circle(F.lit(10.0), F.lit(20.0), F.col("s_nationkey").cast("double"))
    rows = table(spark, d, "supplier").select("s_suppkey", points.alias("p"))
    total = lambda f: F.aggregate(F.transform("p", f), F.lit(0.0), lambda a, v: a + v)
    return rows.select("s_suppkey", _r(total(lambda q, i: q["x"])).alias("sx"), _r(F.array_min(F.transform("p", lambda q: q["y"]))).alias("top"), _r(total(lambda q, i: i * q["y"])).alias("turned"))


@query("""
WITH corner AS (
  SELECT page, idx, least(idx * 2.0::DOUBLE - 4, (r - l) / 2, (b - t) / 2) AS q, l, t, r, b FROM v_box
), arc AS (
  SELECT page, idx, k * 7 + i AS place, CASE WHEN k < 2 THEN r - q ELSE l + q END + q * cos(radians(k * 90 - 90 + 15.0::DOUBLE * i)) AS x,
    CASE WHEN k IN (0, 3) THEN t + q ELSE b - q END + q * sin(radians(k * 90 - 90 + 15.0::DOUBLE * i)) AS y
  FROM corner, (SELECT unnest(range(4)) AS k), (SELECT unnest(range(7)) AS i) WHERE q > 0
), outline AS (
  SELECT * FROM arc UNION ALL SELECT page, idx, 28, x, y FROM arc WHERE place = 0
  UNION ALL SELECT page, idx, i, CASE WHEN i IN (1, 2) THEN r ELSE l END, CASE WHEN i IN (2, 3) THEN b ELSE t END FROM corner, (SELECT unnest(range(5)) AS i) WHERE q <= 0
), summed AS (
  SELECT page, idx, count(*)::INT AS points, round(sum(place * x), 4) AS sx, round(sum(place * y), 4) AS sy FROM outline GROUP BY ALL
)
SELECT page, idx, points, sx, sy, (l + r) / 2 AS dx, (t + b) / 2 AS dy, l + 8.0::DOUBLE AS px, r - 8.0::DOUBLE AS qx FROM summed JOIN v_box USING (page, idx)""", "v_box")
def g24_outlines(spark, d):
    b = g.Box.of()
    round_ = g.rounded_rectangle(b, F.col("idx") * 2.0 - 4)
    total = lambda c: F.round(F.aggregate(F.transform("p", lambda q, i: i * q[c]), F.lit(0.0), lambda a, v: a + v), 4)
    rows = views.boxes(spark, d).withColumn("p", round_)
    skewed, tilted = g.parallelogram(b), g.diamond(b)
    return rows.select(
        "page", "idx", F.size("p").alias("points"), total("x").alias("sx"), total("y").alias("sy"), tilted[0]["x"].alias("dx"), tilted[1]["y"].alias("dy"), skewed[0]["x"].alias("px"), skewed[2]["x"].alias("qx")
    )


@query("""
WITH pair AS (
  SELECT a.page, a.idx AS a, b.idx AS b, a.l AS ax, a.r AS bx, a.t AS y, c.side, b.l AS cx, CASE WHEN c.side = 'top' THEN b.r ELSE b.l END AS dx, b.t AS cy, CASE WHEN c.side = 'top' THEN b.t ELSE b.b END AS dy
  FROM v_box a JOIN v_box b ON a.page = b.page AND a.idx < b.idx, (SELECT unnest(['top', 'left']) AS side) c
)
SELECT page, a, b, side, CASE
  WHEN side = 'top' THEN CASE WHEN abs(y - cy) > 0.01 THEN NULL WHEN least(bx, dx) - greatest(ax, cx) > 0.01 THEN 'overlap' WHEN least(bx, dx) - greatest(ax, cx) > -0.01 THEN 'touch' END
  WHEN cx BETWEEN ax - 0.01 AND bx + 0.01 AND y BETWEEN cy - 0.01 AND dy + 0.01 AND NOT (cx > ax + 0.01 AND cx < bx - 0.01 AND y > cy + 0.01 AND y < dy - 0.01) THEN 'touch' END AS conflict
FROM pair""", "v_box")
def g21_segment_conflicts(spark, d):
    """The top side of one box against the top and the left side of each later box of its page."""
    own = views.boxes(spark, d).select("page", F.col("idx").alias("a"), F.col("l").alias("ax"), F.col("r").alias("bx"), F.col("t").alias("y"))
    other = views.boxes(spark, d).select("page", F.col("idx").alias("b"), *[F.col(c).alias(f"o{c}") for c in "ltrb"], F.explode(F.array(F.lit("top"), F.lit("left"))).alias("side"))
    rows = own.join(other, "page").filter("a < b")
    top = F.col("side") == "top"
    second = (F.col("ol"), F.col("ot"), F.when(top, F.col("or")).otherwise(F.col("ol")), F.when(top, F.col("ot")).otherwise(F.col("ob")))
    return rows.select("page", "a", "b", "side", g.segment_conflict((F.col("ax"), F.col("y"), F.col("bx"), F.col("y")), second).alias("conflict"))


@query(f"""WITH {_FLOW}
SELECT b.page, b.idx, row_number() OVER (PARTITION BY b.page ORDER BY fl.place NULLS LAST, b.t, b.l, b.idx) AS "order" FROM v_box b LEFT JOIN fl ON fl.page = b.page AND fl.idx = b.idx * 3 % 5""", "v_box")
def w2_fragment_order(spark, d):
    """Boxes as fragments of the nodes; some have none."""
    fragments = views.boxes(spark, d).select("page", "idx", "t", "l", (F.col("idx") * 3 % 5).alias("owner"))
    return spatial.fragment_order(fragments, spatial.flow_order(_nodes(spark, d))).select("page", "idx", "order")


# --- pages ----------------------------------------------------------------------------------------------------------

#: Results by supplier: lists, single results and inks, and each kind of mistake.
_RESULTS = """
SELECT s_suppkey, CASE s_suppkey % 9
  WHEN 0 THEN '[{"ink": {"strokes": []}, "image": "first.png"}, {"ink": {"strokes": [{"points": [[' || s_nationkey::VARCHAR || ', 2], [3, 4.5]]}]}, "image": "page.png"}]'
  WHEN 1 THEN '{"ink": {"strokes": [{"points": [[1, ' || s_nationkey::VARCHAR || ']]}]}, "image": 5}'
  WHEN 2 THEN '{"strokes": [{"points": [[0, 0]]}, {"points": []}]}'
  WHEN 3 THEN '[{"strokes": []}]' WHEN 4 THEN '{"strokes": [' WHEN 5 THEN '[1, 2]' WHEN 6 THEN '{"ink": {"points": []}}' WHEN 7 THEN '{"strokes": [{"points": [["a", 1]]}]}' END AS value
FROM supplier"""


@query(f"""
SELECT s_suppkey, CASE WHEN s_suppkey % 9 = 0 THEN 'page.png' END AS image,
  CASE s_suppkey % 9 WHEN 3 THEN 'index out of range' WHEN 4 THEN 'invalid JSON' WHEN 5 THEN 'no object' WHEN 6 THEN 'no strokes' WHEN 7 THEN 'invalid ink' WHEN 8 THEN 'invalid JSON' END AS error,
  CASE WHEN s_suppkey % 9 = 0 THEN len(json_extract(value, '$[1].ink.strokes[*].points[*]')) WHEN s_suppkey % 9 = 1 THEN len(json_extract(value, '$.ink.strokes[*].points[*]')) WHEN s_suppkey % 9 = 2 THEN len(json_extract(value, '$.strokes[*].points[*]')) END::INT AS points
FROM ({_RESULTS})""")
def io4_results(spark, d):
    kind, nation = F.col("s_suppkey") % 9, F.col("s_nationkey").cast("string")
    value = (
        F.when(kind == 0, F.concat(F.lit('[{"ink": {"strokes": []}, "image": "first.png"}, {"ink": {"strokes": [{"points": [['), nation, F.lit(', 2], [3, 4.5]]}]}, "image": "page.png"}]')))
        .when(kind == 1, F.concat(F.lit('{"ink": {"strokes": [{"points": [[1, '), nation, F.lit(']]}]}, "image": 5}')))
        .when(kind == 2, '{"strokes": [{"points": [[0, 0]]}, {"points": []}]}').when(kind == 3, '[{"strokes": []}]').when(kind == 4, '{"strokes": [').when(kind == 5, "[1, 2]")
        .when(kind == 6, '{"ink": {"points": []}}').when(kind == 7, '{"strokes": [{"points": [["a", 1]]}]}')
    )
    rows = ink.result_at(table(spark, d, "supplier").select("s_suppkey", value.alias("value")), "value", 1)
    return rows.select("s_suppkey", "image", "error", F.size(F.flatten("strokes")).alias("points"))


_TSV = """
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_suppkey % 11 = 0 THEN 'n/a' ELSE l_quantity::VARCHAR END AS conf, (l_partkey % 40)::VARCHAR AS "left", (l_suppkey % 20)::VARCHAR AS top,
  (l_linenumber - 1)::VARCHAR AS width, '12' AS height, CASE WHEN l_suppkey % 7 = 0 THEN '  ' ELSE ' ' || l_returnflag || ' ' END AS text FROM lineitem"""


@query(f"""
SELECT TRY_CAST("left" AS DOUBLE) AS l, TRY_CAST(top AS DOUBLE) AS t, TRY_CAST("left" AS DOUBLE) + TRY_CAST(width AS DOUBLE) AS r, TRY_CAST(top AS DOUBLE) + 12 AS b, TRY_CAST(conf AS DOUBLE) AS score, trim(text) AS label
FROM ({_TSV}) WHERE trim(text) <> '' AND TRY_CAST(conf AS DOUBLE) >= 20 AND TRY_CAST(width AS DOUBLE) > 0""")
def io19_tsv_rows(spark, d):
    """OCR rows as text, some of which can't be read, through their reader."""
    text = lambda c, n: c.cast("string").alias(n)
    li = table(spark, d, "lineitem")
    raw = li.select(
        F.when(F.col("l_suppkey") % 11 == 0, "n/a").otherwise(F.col("l_quantity").cast("string")).alias("conf"), text(F.col("l_partkey") % 40, "left"), text(F.col("l_suppkey") % 20, "top"),
        text(F.col("l_linenumber") - 1, "width"), F.lit("12").alias("height"), F.when(F.col("l_suppkey") % 7 == 0, "  ").otherwise(F.concat(F.lit(" "), "l_returnflag", F.lit(" "))).alias("text"),
    )
    return spatial.text_rows(raw)


@query("""
WITH e AS (
  SELECT c_custkey AS page, CASE WHEN c_custkey % 10 = 0 THEN 'page/v0' ELSE 'page/v1' END AS schema, CASE WHEN o_orderkey % 9 = 0 THEN '#' ELSE 'o' END || (o_orderkey % 40)::VARCHAR AS id
  FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE o_orderkey IS NOT NULL OR NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)
), n AS (
  SELECT page, any_value(schema) AS schema, count(o.o_orderkey) AS n FROM e LEFT JOIN orders o ON o.o_custkey = page GROUP BY page
), ids AS (
  SELECT e.page, e.id FROM e JOIN n USING (page) WHERE n.n > 0 AND n.schema = 'page/v1'
)
SELECT page, 'schema' AS problem, NULL AS id FROM n WHERE schema <> 'page/v1'
UNION ALL SELECT page, 'empty', NULL FROM n WHERE schema = 'page/v1' AND n = 0
UNION ALL SELECT page, 'syntax', id FROM ids WHERE NOT regexp_full_match(id, '[A-Za-z][A-Za-z0-9_-]*')
UNION ALL SELECT page, 'duplicate', id FROM ids GROUP BY page, id HAVING count(*) > 1""")
def v1_documents(spark, d):
    """Customers as pages with their orders as elements."""
    ids = F.concat(F.when(F.col("o_orderkey") % 9 == 0, "#").otherwise("o"), (F.col("o_orderkey") % 40).cast("string"))
    elements = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("page")).agg(F.collect_list(ids).alias("elements"))
    pages = table(spark, d, "customer").select(F.col("c_custkey").alias("page"), F.when(F.col("c_custkey") % 10 == 0, "page/v0").otherwise("page/v1").alias("schema"))
    return validation.document_problems(pages.join(elements, "page", "left"), "page/v1")


#: The items of a page by three writers and, now and then, an unknown one; writers 1 and 2 start after an item.
_WRITERS = """
item AS (SELECT page, idx AS item, CASE WHEN idx % 6 = 5 AND page % 3 = 0 THEN 9 ELSE idx % 3 END AS writer, pos, r - l AS length FROM v_item),
writer AS (
  SELECT page, w AS writer, CASE w WHEN 0 THEN NULL WHEN 1 THEN 3 + page % 2 ELSE 1 + page % 3 END AS start_after FROM (SELECT DISTINCT page FROM v_box), (SELECT unnest(range(3)) AS w)
)"""


def _items(spark, d) -> tuple[DataFrame, DataFrame]:
    item = views.items(spark, d)
    writer = F.when((F.col("idx") % 6 == 5) & (F.col("page") % 3 == 0), 9).otherwise(F.col("idx") % 3).cast("long")
    items = item.select("page", F.col("idx").cast("long").alias("item"), writer.alias("writer"), "pos", (F.col("r") - F.col("l")).alias("length"))
    pages = item.select("page").distinct().select("page", F.explode(F.expr("sequence(0L, 2L)")).alias("writer"))
    after = F.when(F.col("writer") == 1, 3 + F.col("page") % 2).when(F.col("writer") == 2, 1 + F.col("page") % 3)
    return items, pages.withColumn("start_after", after)


@query(f"""WITH {_WRITERS}, waits AS (
  SELECT w.page, w.writer, i.writer AS owner, i.pos AS place FROM writer w LEFT JOIN item i ON i.page = w.page AND i.item = w.start_after WHERE w.start_after IS NOT NULL
)
SELECT page, 'unknown writer' AS problem, item::VARCHAR AS name FROM item ANTI JOIN writer USING (page, writer)
UNION ALL SELECT page, 'start_after is not another writer''s item', writer::VARCHAR FROM waits WHERE owner IS NULL OR owner = writer
UNION ALL SELECT page, 'starts too early', writer::VARCHAR FROM waits JOIN (SELECT page, writer, min(pos) AS first FROM item GROUP BY ALL) USING (page, writer) WHERE place > first""", "v_box", "v_item")
def v11_writers(spark, d):
    return validation.writer_problems(*_items(spark, d))


@query("""
WITH t AS (SELECT page, idx AS target, idx + 1 AS after, unnest([idx, idx + 2]) AS x FROM v_item)
SELECT DISTINCT t.page, t.target FROM t LEFT JOIN v_item a ON a.page = t.page AND a.idx = t.after LEFT JOIN v_item w ON w.page = t.page AND w.idx = t.x
WHERE a.pos IS NULL OR w.pos IS NULL OR w.pos <= a.pos""", "v_box", "v_item")
def v11_targets(spark, d):
    items = views.items(spark, d)
    targets = items.select("page", F.col("idx").alias("target"), (F.col("idx") + 1).alias("after"), F.array(F.col("idx"), F.col("idx") + 2).alias("wanted"))
    return validation.target_problems(targets, items.select("page", F.col("idx").alias("item"), "pos"))


@query(f"""WITH RECURSIVE {_WRITERS}, own AS (
  SELECT i.*, coalesce(sum(length + 2) OVER (PARTITION BY i.page, i.writer ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM item i
), base AS (
  SELECT page, writer, 0::DOUBLE AS base FROM writer WHERE start_after IS NULL
  UNION ALL
  SELECT w.page, w.writer, b.base + o.before + o.length + 2 FROM base b JOIN own o ON o.page = b.page AND o.writer = b.writer JOIN writer w ON w.page = o.page AND w.start_after = o.item AND w.writer <> b.writer
)
SELECT page, item, writer, base + before AS start, base + before + length AS "end", row_number() OVER (PARTITION BY page ORDER BY base + before, pos) - 1 AS trace FROM own JOIN base USING (page, writer)""", "v_box", "v_item")
def st3_interleave(spark, d):
    items, writers = _items(spark, d)
    rows = sequences.clocked(items, writers, 2.0)
    return rows.withColumn("trace", F.col("trace").cast("long"))
