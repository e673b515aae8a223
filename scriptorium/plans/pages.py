"""Queries over page items: targets, diagram rules, circuits, and changes by chance; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import text as tx
from ..operators import augment, corpus, diagrams, paths, sequences, splines, targets, validation
from ..sources import documents
from . import views
from .queries import query
from .views import table

_V = ("v_box", "v_item")
_KIND = "['box', 'diamond', 'ellipse', 'parallelogram'][(idx % 4 + 1)::INT]"


def _text(df: DataFrame) -> DataFrame:
    """Targets with their leaves as one text."""
    return df.withColumn("target", F.array_join(F.transform("target", lambda x: x.cast("string")), " "))


def _tables(spark, d):
    return views.items(spark, d).select("page", "pos", F.col("idx").alias("leaf"), F.when(F.col("label").isin("NO", "AF"), F.col("label")).alias("table"), F.lit(1).alias("n_in"))


_RUNS = """k AS (SELECT page, pos, idx, CASE WHEN label IN ('NO', 'AF') THEN label END AS tab FROM v_item),
c AS (SELECT *, (lag(pos) OVER w IS NULL OR tab IS DISTINCT FROM lag(tab) OVER w)::INT AS ch, lag(idx) OVER w AS prev FROM k WINDOW w AS (PARTITION BY page ORDER BY pos)),
r AS (SELECT *, sum(ch) OVER (PARTITION BY page ORDER BY pos) AS run, row_number() OVER (PARTITION BY page, tab ORDER BY pos) - 1 AS written FROM c),
g AS (SELECT page, tab, run, min(pos) AS s, count(*) AS n, min(written) AS written, arg_min(coalesce(prev, -1), pos) AS prev, string_agg(idx::VARCHAR, ' ' ORDER BY pos) AS target FROM r WHERE tab IS NOT NULL GROUP BY ALL)"""


@query(f"""WITH {_RUNS}, due AS (SELECT * FROM g WHERE s > 1 AND written >= 2), rest AS (SELECT due.page, due.tab, due.run, count(*) AS m, string_agg(k.idx::VARCHAR, ' ' ORDER BY k.pos) AS rest FROM due JOIN k ON k.page = due.page AND k.tab = due.tab AND k.pos >= due.s GROUP BY ALL)
SELECT page, 'truth_table_inputs' AS kind, tab AS element, prev AS after, s - 1 AS after_pos, target, 'next' AS span FROM due UNION ALL
SELECT page, 'truth_table_inputs', tab, prev, s - 1, rest, 'remaining' FROM due JOIN rest USING (page, tab, run) WHERE m > n""", *_V)  # fmt: skip
def w4_table_inputs(spark, d):
    return _text(targets.table_inputs(_tables(spark, d)))


@query(f"""WITH {_RUNS}, f AS (SELECT page, min(pos) AS defined FROM v_item WHERE label = 'RF' GROUP BY page)
SELECT page, 'truth_table_outputs' AS kind, tab AS element, prev AS after, s - 1 AS after_pos, target FROM g JOIN f USING (page) WHERE s > 1 AND s - 1 >= defined""", *_V)
def w5_table_outputs(spark, d):
    items = _tables(spark, d)
    begun = views.items(spark, d).filter("label = 'RF'").groupBy("page").agg(F.min("pos").alias("defined"))
    columns = begun.select("page", "defined", F.explode(F.array(F.lit("NO"), F.lit("AF"))).alias("table"))
    return _text(targets.table_outputs(items, columns, "table"))


@query(f"WITH {_RUNS}, o AS (SELECT *, row_number() OVER (PARTITION BY page, tab ORDER BY s) AS nr FROM g) SELECT page, 'table_rules' AS kind, tab AS element, split_part(target, ' ', 1)::BIGINT AS after, s AS after_pos, substr(target, strpos(target, ' ') + 1) AS target FROM o WHERE nr = 1 AND n > 1", *_V)
def w6_table_rules(spark, d):
    return _text(targets.table_rules(_tables(spark, d)))


_HEADERS = """up AS (SELECT page FROM (SELECT page, v - lag(v) OVER (PARTITION BY page ORDER BY idx) AS d FROM (SELECT page, idx, CASE WHEN page % 3 = 0 THEN r::BIGINT ELSE 10 + 2 * idx END AS v FROM v_item)) GROUP BY page HAVING count(*) >= 3 AND count(DISTINCT d) = 1 AND max(d) <> 0)"""


@query(f"""WITH {_HEADERS}, n AS (SELECT *, count(*) OVER (PARTITION BY page) AS n FROM v_item JOIN up USING (page)) SELECT a.page, 'header_sequence' AS kind, 'h' AS element, a.idx AS after, a.pos AS after_pos, string_agg(b.idx::VARCHAR, ' ' ORDER BY b.pos) AS target
FROM n a JOIN n b ON a.page = b.page AND b.pos > a.pos WHERE a.pos > 1 GROUP BY ALL""", *_V)  # fmt: skip
def w6_header_sequences(spark, d):
    cells = views.items(spark, d).select("page", F.lit("h").alias("element"), "pos", F.col("idx").alias("leaf"), F.when(F.expr("page % 3 = 0"), F.col("r").cast("long")).otherwise(10 + 2 * F.col("idx")).alias("v"))
    up = sequences.counts_up(cells.withColumn("text", F.concat(F.lit("Wk"), F.col("v").cast("string"))), "page", "leaf").filter("up").select("page", F.lit("h").alias("element"))
    return _text(targets.header_sequences(cells.drop("v"), up))


@query("""WITH m AS (SELECT page, label, idx, pos * 2 AS mp, pos * 2 + 1 AS tp, row_number() OVER w AS k, lead(pos * 2) OVER w AS np, lead(idx) OVER w AS nx FROM v_item WINDOW w AS (PARTITION BY page, label ORDER BY idx))
SELECT page, 'list_marker' AS kind, label AS element, 't' || idx AS after, tp AS after_pos, 'm' || nx AS target FROM m WHERE k > 1 AND np IS NOT NULL AND tp < np""", *_V)  # fmt: skip
def w6_list_markers(spark, d):
    """Each item is a marker and, straight after it, a line of text; lists are the items with one label."""
    rows = views.items(spark, d).select("page", F.col("label").alias("element"), F.col("idx").alias("index"), "pos")
    leaf = lambda c, add: [(F.col("pos") * 2 + add).alias("pos"), F.concat(F.lit(c), F.col("index").cast("string")).alias("leaf")]
    return _text(targets.list_markers(rows.select("page", "element", "index", *leaf("m", 0)), rows.select("page", "element", "index", *leaf("t", 1))))


@query("""WITH e AS (SELECT page, label AS node, idx, pos, CASE WHEN l < 20 THEN 'Yes' ELSE 'no ' END AS w FROM v_item), p AS (SELECT page, node, arg_min(idx, pos) AS a, min(pos) AS ap, arg_max(idx, pos) AS b FROM e GROUP BY ALL HAVING count(*) = 2 AND count(DISTINCT w) = 2)
SELECT page, 'branch_label' AS kind, node AS element, a AS after, ap AS after_pos, b::VARCHAR AS target FROM p""", *_V)  # fmt: skip
def w6_branch_labels(spark, d):
    word = F.when(F.col("l") < 20, "Yes").otherwise("no ")
    return _text(targets.branch_labels(views.items(spark, d).select("page", F.col("label").alias("node"), F.col("idx").alias("edge"), word.alias("label"), "pos", F.col("idx").alias("leaf"))))


@query("""WITH x AS (SELECT page, label AS node, idx, pos, idx % 2 AS odd FROM v_item), t AS (SELECT page, node, max(pos) AS tp, arg_max(idx, pos) AS after FROM x WHERE odd = 1 GROUP BY ALL)
SELECT page, 'node_outline' AS kind, node AS element, after, tp AS after_pos, idx::VARCHAR AS target FROM x JOIN t USING (page, node) WHERE odd = 0 AND tp < pos""", *_V)  # fmt: skip
def w6_node_outlines(spark, d):
    rows = views.items(spark, d).select("page", F.col("label").alias("node"), "pos", F.col("idx").alias("leaf"))
    return _text(targets.node_outlines(rows.filter("leaf % 2 = 0"), rows.filter("leaf % 2 = 1")))


@query(f"""WITH {_RUNS}, o AS (SELECT *, row_number() OVER (PARTITION BY page, tab ORDER BY s) AS nr FROM g), f AS (SELECT page, min(pos) AS defined FROM v_item WHERE label = 'RF' GROUP BY page),
a AS (SELECT page, 'table_rules' AS kind, tab AS element, s AS after_pos FROM o WHERE nr = 1 AND n > 1 UNION ALL SELECT page, 'truth_table_outputs', tab, s - 1 FROM g JOIN f USING (page) WHERE s > 1 AND s - 1 >= defined)
SELECT *, 'tgt_' || (row_number() OVER (PARTITION BY page ORDER BY element, kind, after_pos) - 1) AS id FROM a""", *_V)  # fmt: skip
def w7_target_numbers(spark, d):
    items = _tables(spark, d)
    begun = views.items(spark, d).filter("label = 'RF'").groupBy("page").agg(F.min("pos").alias("defined"))
    columns = begun.select("page", "defined", F.explode(F.array(F.lit("NO"), F.lit("AF"))).alias("table"))
    return targets.numbered(targets.table_rules(items), targets.table_outputs(items, columns, "table")).select("page", "kind", "element", "after_pos", "id")


# --- rules ----------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, coalesce(lang, '') AS lang FROM documents WHERE lang IS NULL OR lang NOT IN ('en', 'de', 'fr')")
def v2_allowed_values(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang")
    return validation.not_among(rows, "lang", ["en", "de", "fr"]).select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"))


@query("""WITH c AS (SELECT DISTINCT unnest(string_split(text, '')) AS c FROM benchmark), x AS (SELECT DISTINCT doc_id, unnest(string_split(text, '')) AS c FROM documents)
SELECT doc_id, string_agg(c, '' ORDER BY c) AS chars FROM x ANTI JOIN c USING (c) WHERE c <> '' GROUP BY doc_id""")
def v2_undrawable(spark, d):
    glyphs = corpus.charset(table(spark, d, "benchmark").select(tx.char_tokens(F.col("text")).alias("tokens")))
    return validation.undrawable(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", glyphs.select("token"))


@query("SELECT c_custkey AS item FROM customer WHERE c_custkey // 1000 > 0")
def v3_nesting(spark, d):
    """Items are numbered as in an outline of ten items to a level: 1234 is in 123, which is in 12."""
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("item"), F.expr("nullif(c_custkey div 10, 0)").alias("parent"))
    return validation.too_deep(rows)


@query("""WITH r AS (SELECT page AS "table", idx AS "row", [(l % 2)::INT::VARCHAR, CASE WHEN score = 0 THEN 'y' ELSE (t % 2)::INT::VARCHAR END] || CASE WHEN idx % 3 = 0 THEN []::VARCHAR[] ELSE ['x'] END AS cells FROM v_box)
SELECT "table", "row", CASE WHEN len(cells) < w THEN 'too few cells' ELSE 'no bit' END AS problem FROM (SELECT *, max(len(cells)) OVER (PARTITION BY "table") AS w FROM r) WHERE len(cells) < w OR list_contains(cells, 'y')""", "v_box")  # fmt: skip
def v4_table_shape(spark, d):
    bit = lambda c: (F.col(c) % 2).cast("int").cast("string")
    cells = F.concat(F.array(bit("l"), F.when(F.col("score") == 0, "y").otherwise(bit("t"))), F.when(F.expr("idx % 3 = 0"), F.array().cast("array<string>")).otherwise(F.array(F.lit("x"))))
    return validation.table_shape(views.boxes(spark, d).select(F.col("page").alias("table"), F.col("idx").alias("row"), cells.alias("cells")))


@query("""WITH w AS (SELECT page, idx AS src, idx + CASE WHEN l % 3 = 0 THEN 2 ELSE 1 END AS dst FROM v_box)
SELECT DISTINCT page, port, 'no port' AS problem FROM (SELECT page, src AS port FROM w UNION ALL SELECT page, dst FROM w) e ANTI JOIN (SELECT page, idx AS port FROM v_box) USING (page, port)
UNION ALL SELECT page, dst, 'driven twice' FROM w GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT page, idx, 'not connected' FROM v_box WHERE t % 2 = 0 AND (page, idx) NOT IN (SELECT (page, dst) FROM w)""", "v_box")  # fmt: skip
def v6_circuit_rules(spark, d):
    rows = views.boxes(spark, d)
    wires = rows.select("page", F.col("idx").alias("src"), (F.col("idx") + F.when(F.expr("l % 3 = 0"), 2).otherwise(1)).alias("dst"))
    return diagrams.wire_problems(rows.select("page", F.col("idx").alias("port"), F.expr("t % 2 = 0").alias("is_input")), wires)


@query("""WITH p AS (SELECT page, idx AS part, floor(l / 10)::INT AS col, floor(t / 10)::INT AS row FROM v_box), n AS (SELECT page, label AS net, idx AS port FROM v_box UNION ALL SELECT page, label, idx + 1 FROM v_box WHERE l % 4 = 0)
SELECT page, col || ',' || row AS name, 'place taken' AS problem FROM p GROUP BY page, col, row HAVING count(*) > 1 UNION ALL SELECT page, net, 'one port' FROM n GROUP BY ALL HAVING count(*) < 2
UNION ALL SELECT page, port::VARCHAR, 'in two nets' FROM n GROUP BY page, port HAVING count(DISTINCT net) > 1 UNION ALL SELECT DISTINCT page, port::VARCHAR, 'no part' FROM n ANTI JOIN (SELECT page, part AS port FROM p) USING (page, port)""", "v_box")  # fmt: skip
def v7_schematic_rules(spark, d):
    rows = views.boxes(spark, d)
    parts = rows.select("page", F.col("idx").alias("part"), F.floor(F.col("l") / 10).cast("int").alias("col"), F.floor(F.col("t") / 10).cast("int").alias("row"))
    nets = rows.select("page", F.col("label").alias("net"), F.col("idx").alias("port")).unionByName(rows.filter("l % 4 = 0").select("page", F.col("label").alias("net"), (F.col("idx") + 1).alias("port")))
    return diagrams.net_problems(parts, nets)


@query("SELECT p_partkey, (p_size // 8) % 2 AS told, ((p_size % 2 = 1) <> ((p_size // 2) % 2 = 1 AND (p_size // 4) % 2 = 0))::INT AS got FROM part WHERE (p_size // 8) % 2 <> ((p_size % 2 = 1) <> ((p_size // 2) % 2 = 1 AND (p_size // 4) % 2 = 0))::INT")
def v8_table_against_expression(spark, d):
    """Rows of a truth table over A, B, C whose output isn't what its expression gives."""
    bit = lambda k: F.expr(f"cast((p_size div {k}) % 2 as int)")
    got = validation.bool_eval(F.lit("A xor B C'"), F.array(*map(F.lit, "ABC")), F.array(bit(1), bit(2), bit(4)))
    return table(spark, d, "part").select("p_partkey", F.expr("(p_size div 8) % 2").alias("told"), got.alias("got")).filter("told != got")


@query("""WITH RECURSIVE c AS (SELECT page, idx, label, CASE WHEN idx <= 2 THEN (l % 2)::INT END AS bit FROM v_box), s AS (
  SELECT page, idx, bit AS v, NULL::INT AS before FROM c WHERE idx = 1
  UNION ALL SELECT c.page, c.idx, CASE WHEN c.idx = 2 THEN c.bit WHEN label = 'NO' THEN s.v & s.before WHEN label = 'AF' THEN s.v | s.before WHEN label = 'RF' THEN xor(s.v, s.before) ELSE 1 - (s.v & s.before) END, s.v FROM s JOIN c ON c.page = s.page AND c.idx = s.idx + 1)
SELECT page, idx AS id, v AS value FROM s""", "v_box")  # fmt: skip
def v9_simulation(spark, d):
    """The first two boxes of a page are pins; each later one is a gate fed by the two before it."""
    i = F.col("idx")
    kind = F.when(i <= 2, "in").otherwise(F.element_at(F.create_map(*[F.lit(x) for x in ("NO", "and", "AF", "or", "RF", "xor", "NF", "nand", "AO", "nand", "RO", "nand")]), F.col("label")))
    gates = views.boxes(spark, d).select("page", i.alias("id"), kind.alias("type"), (i - 1).alias("a"), (i - 2).alias("b"), F.when(i <= 2, F.col("l") % 2).cast("int").alias("bit"))
    return diagrams.simulated(gates)


@query("""WITH t AS (SELECT page, list_sort(list_distinct(list(label))) AS n FROM v_box WHERE idx % 2 = 1 GROUP BY page), c AS (SELECT page, list_sort(list_distinct(list(label))) AS n FROM v_box WHERE idx % 2 = 0 GROUP BY page)
SELECT page, 'not simulated' AS warning, NULL::BIGINT AS idx FROM c WHERE (page, n) NOT IN (SELECT (page, n) FROM t) UNION ALL SELECT b.page, 'not checked', idx FROM v_box b WHERE score > 0 AND NOT EXISTS (SELECT 1 FROM v_box q WHERE q.page = b.page AND q.score = 0 AND q.label = b.label)""", "v_box")  # fmt: skip
def v10_warnings(spark, d):
    """Circuits that fit no table's pins, and lines (boxes with a score) that neither a check nor a column of their name covers."""
    rows = views.boxes(spark, d)
    circuits = rows.filter("idx % 2 = 0").select("page", F.lit(0).alias("circuit"), F.col("label").alias("name"))
    tables = rows.filter("idx % 2 = 1").select("page", F.lit(1).alias("table"), F.col("label").alias("name"))
    lost = circuits.select("page").distinct().join(diagrams.same_names(circuits, tables), "page", "left_anti")
    lines = rows.filter("score > 0").join(rows.filter("score = 0").select("page", "label"), ["page", "label"], "left_anti")
    return lost.select("page", F.lit("not simulated").alias("warning"), F.lit(None).cast("long").alias("idx")).unionByName(lines.select("page", F.lit("not checked").alias("warning"), F.col("idx").cast("long").alias("idx")))


# --- geometry and joins ---------------------------------------------------------------------------------------------


@query("SELECT ink_id, stroke_id, point_id, round_even(x, 2) AS x, round_even(y, 2) AS y FROM v_ink", "v_ink")
def g16_rounded(spark, d):
    return views.ink(spark, d).select("ink_id", "stroke_id", "point_id", augment.rounded(F.col("x")).alias("x"), augment.rounded(F.col("y")).alias("y"))


_NEXT = "k AS (SELECT *, (lead(l) OVER w + lead(r) OVER w) / 2 AS x, (lead(t) OVER w + lead(b) OVER w) / 2 AS y, " + _KIND + " AS kind FROM v_box WINDOW w AS (PARTITION BY page ORDER BY idx))"


def _points_at(spark, d):
    """Boxes as shapes of four kinds, each with the centre of the next one as a point."""
    w = Window.partitionBy("page").orderBy("idx")
    middle = lambda a, b: (F.lead(a).over(w) + F.lead(b).over(w)) / 2
    kind = F.get(F.array(*map(F.lit, ("box", "diamond", "ellipse", "parallelogram"))), (F.col("idx") % 4).cast("int"))
    return views.boxes(spark, d).withColumns({"x": middle("l", "r"), "y": middle("t", "b"), "kind": kind}).filter("x is not null")


@query(f"""WITH {_NEXT}, z AS (SELECT *, (l + r) / 2 AS cx, (t + b) / 2 AS cy, (r - l) / 2 - 0.5::DOUBLE AS hw, (b - t) / 2 - 0.5::DOUBLE AS hh, (b - y) / (b - t) AS up FROM k WHERE x IS NOT NULL)
SELECT page, idx, x > l + 0.5 AND x < r - 0.5 AND y > t + 0.5 AND y < b - 0.5 AND CASE kind WHEN 'diamond' THEN abs(x - cx) / hw + abs(y - cy) / hh < 1 WHEN 'ellipse' THEN (abs(x - cx) / hw) * (abs(x - cx) / hw) + (abs(y - cy) / hh) * (abs(y - cy) / hh) < 1
  WHEN 'parallelogram' THEN x > l + up * 8 + 0.5 AND x < r - (1 - up) * 8 - 0.5 ELSE true END AS held FROM z""", "v_box")  # fmt: skip
def g22_inside_shape(spark, d):
    return _points_at(spark, d).select("page", "idx", diagrams.inside(F.col("kind"), g.Box.of(), F.col("x"), F.col("y")).alias("held"))


@query(f"""WITH {_NEXT}, e AS (SELECT *, unnest(CASE kind WHEN 'diamond' THEN [[(l + r) / 2, t, r, (t + b) / 2], [r, (t + b) / 2, (l + r) / 2, b], [(l + r) / 2, b, l, (t + b) / 2], [l, (t + b) / 2, (l + r) / 2, t]]
  WHEN 'parallelogram' THEN [[l + 8, t, r, t], [r, t, r - 8, b], [r - 8, b, l, b], [l, b, l + 8, t]] ELSE [[l, t, r, t], [r, t, r, b], [r, b, l, b], [l, b, l, t]] END) AS s FROM k WHERE x IS NOT NULL),
f AS (SELECT page, idx, x - s[1] AS px, y - s[2] AS py, s[3] - s[1] AS dx, s[4] - s[2] AS dy FROM e), h AS (SELECT *, greatest(0, least(1, (px * dx + py * dy) / (dx * dx + dy * dy))) AS u FROM f)
SELECT page, idx, round(min(sqrt((px - u * dx) ** 2 + (py - u * dy) ** 2)), 6) AS d FROM h GROUP BY ALL""", "v_box")  # fmt: skip
def g22_outline_distance(spark, d):
    return _points_at(spark, d).select("page", "idx", F.round(diagrams.outline_distance(F.col("kind"), g.Box.of(), F.col("x"), F.col("y")), 6).alias("d"))


_SMALL = "q AS (SELECT page, idx, l * 3 AS l, t * 3 AS t, l * 3 + 10 + l_w AS r, t * 3 + 8 AS b FROM (SELECT *, (r - l) / 10 AS l_w FROM v_box))"


@query(f"""WITH {_SMALL}, p AS (SELECT a.page, a.idx AS a, b.idx AS b, a.l AS al, a.t AS a_t, a.r AS ar, a.b AS ab, b.l AS bl, b.t AS bt, b.r AS br, b.b AS bb FROM q a JOIN q b ON a.page = b.page AND a.idx < b.idx)
SELECT page, a, b, round(CASE WHEN bl > ar THEN ar + 1.5 WHEN br < al THEN al - 1.5 WHEN bt > ab OR bb < a_t THEN (al + ar) / 2 END, 6) AS x0, round(CASE WHEN bl > ar OR br < al THEN (a_t + ab) / 2 WHEN bt > ab THEN ab + 1.5 WHEN bb < a_t THEN a_t - 1.5 END, 6) AS y0,
round(CASE WHEN bl > ar THEN bl - 1.5 WHEN br < al THEN br + 1.5 WHEN bt > ab OR bb < a_t THEN (bl + br) / 2 END, 6) AS x1, round(CASE WHEN bl > ar OR br < al THEN (bt + bb) / 2 WHEN bt > ab THEN bt - 1.5 WHEN bb < a_t THEN bb + 1.5 END, 6) AS y1 FROM p""", "v_box")  # fmt: skip
def g23_arrow_between(spark, d):
    small = views.boxes(spark, d).select("page", "idx", (F.col("l") * 3).alias("l"), (F.col("t") * 3).alias("t"), (F.col("l") * 3 + 10 + (F.col("r") - F.col("l")) / 10).alias("r"), (F.col("t") * 3 + 8).alias("b"))
    a, b = (small.select("page", F.col("idx").alias(p), *[F.col(c).alias(p + c) for c in "ltrb"]) for p in "ab")
    arrow = diagrams.arrow_between(g.Box.of("a"), g.Box.of("b"), F.lit(1.5))
    return a.join(b, "page").filter("a < b").select("page", "a", "b", *[F.round(arrow[c], 6).alias(c) for c in ("x0", "y0", "x1", "y1")])


@query("""WITH i AS (SELECT page, 'i' || idx || CASE WHEN idx % 2 = 0 THEN '.marker' ELSE '' END AS leaf, label AS element, CASE WHEN idx > 2 THEN 'i' || (idx - 1) END AS line_of, (l % 3)::INT AS row FROM v_box),
a AS (SELECT page, idx AS ann, CASE idx % 4 WHEN 0 THEN 'i' || idx WHEN 1 THEN label WHEN 2 THEN label || '.r' || (t % 3)::INT ELSE 'i' || (idx + 1) || '.marker' END AS ref FROM v_box)
SELECT DISTINCT a.page, a.ann, i.leaf FROM a JOIN i ON a.page = i.page AND (i.leaf = ref OR i.leaf = ref || '.marker' OR element = ref OR line_of = ref OR element || '.r' || row = ref)""", "v_box")  # fmt: skip
def j10_annotated_items(spark, d):
    rows, idx = views.boxes(spark, d), F.col("idx").cast("string")
    items = rows.select("page", F.concat(F.lit("i"), idx, F.expr("if(idx % 2 = 0, '.marker', '')")).alias("leaf"), F.col("label").alias("element"), F.when(F.col("idx") > 2, F.concat(F.lit("i"), (F.col("idx") - 1).cast("string"))).alias("line_of"), F.expr("cast(l % 3 as int)").alias("row"))
    ref = F.when(F.expr("idx % 4 = 0"), F.concat(F.lit("i"), idx)).when(F.expr("idx % 4 = 1"), F.col("label")).when(F.expr("idx % 4 = 2"), F.expr("concat(label, '.r', cast(t % 3 as int))")).otherwise(F.expr("concat('i', idx + 1, '.marker')"))
    return diagrams.covered(rows.select("page", F.col("idx").alias("ann"), ref.alias("ref")), items)


@query("SELECT l_orderkey, l_linenumber, p_name AS role, count(*) AS n FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 25) ON l_partkey = p_partkey GROUP BY ALL")
def j13_restored_attributes(spark, d):
    """What a written page lost comes back from its layout, where that has it."""
    layout = table(spark, d, "part").filter("p_size > 25").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("role"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(layout, "l_partkey", "left").groupBy("l_orderkey", "l_linenumber", "role").agg(F.count("*").alias("n"))


@query("SELECT page, idx, pos - 1 AS place FROM v_item", *_V)
def j14_order_places(spark, d):
    """A page's writing order as one array, joined back to its items."""
    rows = views.boxes(spark, d)
    order = rows.groupBy("page").agg(F.sort_array(F.collect_list(F.struct("t", "l", "idx"))).alias("o")).select("page", F.posexplode(F.transform("o", lambda s: s["idx"])).alias("place", "idx"))
    return rows.select("page", "idx").join(order, ["page", "idx"])


@query("SELECT m.page, m.idx AS math, t.idx AS tab FROM v_box m JOIN v_box t ON m.page = t.page AND m.label = t.label AND m.idx % 2 = 0 AND t.idx % 2 = 1", "v_box")
def j15_defining_lines(spark, d):
    rows = views.boxes(spark, d)
    side = lambda odd, n: rows.filter(F.col("idx") % 2 == odd).select("page", "label", F.col("idx").alias(n))
    return side(0, "math").join(side(1, "tab"), ["page", "label"]).select("page", "math", "tab")


@query("""WITH t AS (SELECT page, list_sort(list_distinct(list(label))) AS n FROM v_box WHERE idx % 2 = 1 GROUP BY page), c AS (SELECT page, list_sort(list_distinct(list(label))) AS n FROM v_box WHERE idx % 2 = 0 GROUP BY page)
SELECT page, 0 AS circuit, 1 AS "table" FROM c JOIN t USING (page, n)""", "v_box")  # fmt: skip
def j16_circuit_tables(spark, d):
    rows = views.boxes(spark, d)
    side = lambda odd, n: rows.filter(F.col("idx") % 2 == odd).select("page", F.lit(odd).alias(n), F.col("label").alias("name"))
    return diagrams.same_names(side(0, "circuit"), side(1, "table"))


@query("""WITH i AS (SELECT page, idx, ['text', 'shape', 'line', 'node_text'][(idx % 4 + 1)::INT] AS role, label AS g, l, t, r, CASE WHEN idx % 4 = 2 THEN t ELSE b END AS b FROM v_box),
p AS (SELECT a.page, a.idx AS a, b.idx AS b, replace(a.role, 'node_', '') AS ra, replace(b.role, 'node_', '') AS rb, a.g = b.g AND 'node_text' IN (a.role, b.role) AS own, a.g <> b.g AS other, a.l < b.r AND b.l < a.r AND a.t < b.b AND b.t < a.b AS strict,
  a.l < b.r - 0.5 AND b.l < a.r - 0.5 AND a.t < b.b - 0.5 AND b.t < a.b - 0.5 AS into_, a.t = b.t AS level FROM i a JOIN i b ON a.page = b.page AND a.idx < b.idx AND a.l <= b.r AND b.l <= a.r AND a.t <= b.b AND b.t <= a.b),
q AS (SELECT page, a, b, CASE WHEN ra = 'text' AND rb = 'text' AND strict THEN 'texts overlap' WHEN ra <> rb AND 'line' NOT IN (ra, rb) AND strict AND NOT own THEN 'text on shape' WHEN 'text' IN (ra, rb) AND 'line' IN (ra, rb) THEN 'line through text'
  WHEN 'shape' IN (ra, rb) AND 'line' IN (ra, rb) AND into_ THEN 'line through shape' WHEN ra = 'line' AND rb = 'line' AND other AND level THEN 'nets touch' END AS problem FROM p) SELECT * FROM q WHERE problem IS NOT NULL""", "v_box")  # fmt: skip
def j18_diagram_conflicts(spark, d):
    role = F.get(F.array(*map(F.lit, ("text", "shape", "line", "node_text"))), (F.col("idx") % 4).cast("int"))
    rows = views.boxes(spark, d).withColumns({"role": role, "grp": F.col("label"), "b": F.when(F.expr("idx % 4 = 2"), F.col("t")).otherwise(F.col("b"))})
    return diagrams.conflicts(rows)


# --- paths ----------------------------------------------------------------------------------------------------------


@query("""WITH seg AS (SELECT *, coalesce(sqrt((x - px) ** 2 + (y - py) ** 2), 0) AS d FROM (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM v_ink WINDOW w AS (PARTITION BY ink_id, stroke_id ORDER BY point_id))),
way AS (SELECT *, sum(d) OVER (PARTITION BY ink_id, stroke_id ORDER BY point_id ROWS UNBOUNDED PRECEDING) AS s FROM seg), tot AS (SELECT ink_id, stroke_id, max(s) AS total, ceil(max(s) / 9.0)::INT AS n FROM way GROUP BY ALL), smp AS (SELECT *, unnest(range(n + 1)) AS k FROM tot)
SELECT ink_id, stroke_id, k AS sample, CASE WHEN k = n THEN 7 ELSE min(point_id) FILTER (WHERE s >= k * total / n - 1e-9) END AS point_id FROM smp JOIN way USING (ink_id, stroke_id) GROUP BY ink_id, stroke_id, k, n""", "v_ink")  # fmt: skip
def p4_resample_labels(spark, d):
    return paths.resample(views.ink(spark, d), 9.0, "point_id").select("ink_id", "stroke_id", "sample", "point_id")


_SHARES = """WITH RECURSIVE z AS (SELECT ink_id, [((ink_id + 3 * k) % 8 + 1)::BIGINT FOR k IN range(4)] AS sizes FROM (SELECT DISTINCT ink_id FROM v_ink)),
f AS (SELECT ink_id, sizes, list_transform(sizes, lambda k: greatest(1, round_even(k * 22 / list_sum(sizes)::DOUBLE, 0)::BIGINT)) AS c FROM z
  UNION ALL SELECT ink_id, sizes, list_transform(c, lambda v, i: CASE WHEN i = list_position(c, list_max(c)) THEN v + CASE WHEN list_sum(c) < 22 THEN 1 ELSE -1 END ELSE v END) FROM f WHERE list_sum(c) <> 22)"""


@query(f"{_SHARES} SELECT ink_id, array_to_string(c, ' ') AS counts FROM f WHERE list_sum(c) = 22", "v_ink")
def p5_shared_counts(spark, d):
    rows = views.inks(spark, d).select("ink_id", paths.resample_to(_cut(), 22).alias("s"))
    return rows.select("ink_id", F.array_join(F.transform("s", lambda s: F.size(s).cast("string")), " ").alias("counts"))


def _cut():
    """The first points of each stroke, a number that depends on the ink, so that strokes differ in size."""
    return F.transform("strokes", lambda s, k: F.slice(s, F.lit(1), ((F.col("ink_id") + 3 * k) % 8 + 1).cast("int")))


@query(f"""{_SHARES}, g AS (SELECT ink_id, k - 1 AS stroke_id, sizes[k] AS n, c[k] AS m FROM (SELECT *, unnest(range(1, 5)) AS k FROM f WHERE list_sum(c) = 22)),
q AS (SELECT ink_id, stroke_id, n, i, CASE WHEN m = 1 THEN 0 ELSE i * (n - 1) / (m - 1)::DOUBLE END AS u FROM (SELECT *, unnest(range(m)) AS i FROM g)),
p AS (SELECT *, least(floor(u), n - 1)::INT AS low FROM q) SELECT p.ink_id, p.stroke_id, count(*) AS points, round(sum(a.x + (b.x - a.x) * (u - low)), 6) AS sx, sum(round_even(u, 0))::BIGINT AS labels
FROM p JOIN v_ink a ON a.ink_id = p.ink_id AND a.stroke_id = p.stroke_id AND a.point_id = low JOIN v_ink b ON b.ink_id = p.ink_id AND b.stroke_id = p.stroke_id AND b.point_id = least(low + 1, n - 1) GROUP BY ALL""", "v_ink")  # fmt: skip
def p5_resample_to(spark, d):
    rows = views.inks(spark, d).select("ink_id", F.posexplode(paths.resample_to(_cut(), 22)).alias("stroke_id", "s")).select("ink_id", "stroke_id", F.explode("s").alias("p"))
    return rows.groupBy("ink_id", "stroke_id").agg(F.count("*").alias("points"), F.round(F.sum("p.x"), 6).alias("sx"), F.sum("p.label").alias("labels"))


@query("""WITH c AS (SELECT ink_id, stroke_id * 2 + point_id // 4 AS curve, list(x ORDER BY point_id) AS v FROM v_ink GROUP BY ALL), s AS (SELECT *, unnest(range(13)) AS i FROM c)
SELECT ink_id, curve::INT AS curve, count(*) AS points, round(sum((1 - i / 12.0::DOUBLE) ** 3 * v[1] + 3 * (1 - i / 12.0::DOUBLE) ** 2 * (i / 12.0::DOUBLE) * v[2] + 3 * (1 - i / 12.0::DOUBLE) * (i / 12.0::DOUBLE) ** 2 * v[3] + (i / 12.0::DOUBLE) ** 3 * v[4]), 6) AS sx, sum(round_even(i / 4.0::DOUBLE, 0))::BIGINT AS labels FROM s GROUP BY ALL""", "v_ink")  # fmt: skip
def p20_spline_decode(spark, d):
    """Half a stroke gives four control points, whose spline is a Bezier curve."""
    halves = F.flatten(F.transform("strokes", lambda s: F.array(F.slice(s, 1, 4), F.slice(s, 5, 4))))
    rows = views.inks(spark, d).select("ink_id", F.posexplode(halves).alias("curve", "c")).select("ink_id", "curve", F.explode(splines.decoded(F.col("c"))).alias("p"))
    return rows.groupBy("ink_id", "curve").agg(F.count("*").alias("points"), F.round(F.sum("p.x"), 6).alias("sx"), F.sum("p.label").alias("labels"))


# --- chance ---------------------------------------------------------------------------------------------------------


def _u(*parts: str) -> str:
    """DuckDB's twin of ``augment.chance``."""
    return f"(('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


@query(f"SELECT DISTINCT ink_id, round(CASE WHEN {_u('ink_id', chr(39) + 'whether' + chr(39))} < 0.5 THEN exp(({_u('ink_id', chr(39) + 'factor' + chr(39))} * 2 - 1) * ln(2.0::DOUBLE)) ELSE 1 END, 9) AS factor FROM v_ink", "v_ink")
def p24_stretch_factors(spark, d):
    return views.inks(spark, d).select("ink_id", F.round(augment.stretch_factor(2.0, 0.5, F.col("ink_id")), 9).alias("factor"))


_W = "split_part(p_name, ' ', 1)"
_TYPO = f"""WITH w AS (SELECT p_partkey, {_W} AS w, length({_W}) AS n, floor({_u('p_partkey', "'kind'")} * 4) AS kind, (2 + floor({_u('p_partkey', "'swap'")} * (length({_W}) - 3)))::INT AS s, (2 + floor({_u('p_partkey', "'drop'")} * (length({_W}) - 1)))::INT AS d,
  (1 + floor({_u('p_partkey', "'double'")} * length({_W})))::INT AS e, (1 + floor({_u('p_partkey', "'prefix'")} * greatest(1, length({_W}) - 2)))::INT AS b FROM part),
o AS (SELECT *, CASE WHEN kind = 0 AND n > 3 THEN w[:s - 1] || w[s + 1] || w[s] || w[s + 2:] WHEN kind = 1 THEN w[:d - 1] || w[d + 1:] WHEN kind = 2 THEN w[:e] || w[e:] ELSE w[:b] END AS o FROM w)"""


@query(_TYPO + " SELECT p_partkey, w AS word, CASE WHEN n < 2 THEN w WHEN o = w THEN w[:n - 1] ELSE o END AS typo FROM o")
def t12_typos(spark, d):
    word = F.split_part("p_name", F.lit(" "), F.lit(1))
    return table(spark, d, "part").select("p_partkey", word.alias("word")).withColumn("typo", augment.typo(F.col("word"), F.col("p_partkey")))


@query(f"""WITH w AS (SELECT word, row_number() OVER (ORDER BY word) - 1 AS k, count(*) OVER () AS size FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS word FROM benchmark)),
p AS (SELECT o_orderkey AS id, unnest(range(1, (1 + floor({_u('o_orderkey', "'words'")} * 7))::INT + 1)) AS place FROM orders),
q AS (SELECT id, place, floor({_u('id', 'place', "'word'")} * (SELECT max(size) FROM w))::BIGINT AS k FROM p), l AS (SELECT id, string_agg(word, ' ' ORDER BY place) AS line FROM q JOIN w USING (k) GROUP BY id) SELECT DISTINCT line FROM l WHERE length(line) <= 50""")  # fmt: skip
def t20_random_lines(spark, d):
    words = table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("word"))
    return augment.random_lines(table(spark, d, "orders").select(F.col("o_orderkey").alias("id")), words)


@query("""WITH b AS (SELECT page, list(l ORDER BY idx) AS v, count(*)::BIGINT AS n FROM v_box GROUP BY page), i AS (SELECT page, v, n, unnest(range(1, n + 1)) AS i FROM b), j AS (SELECT *, unnest(range(1, i + 1)) AS j FROM i), k AS (SELECT *, unnest(range(i, n + 1)) AS k FROM j),
m AS (SELECT page, i, j, min(list_avg(v[j:k])) AS m FROM k GROUP BY ALL) SELECT page, i AS idx, round(max(m), 6) AS fit FROM m GROUP BY page, i""", "v_box")  # fmt: skip
def l13_rising_fit(spark, d):
    rows = views.boxes(spark, d).groupBy("page").agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", "l"))), lambda s: s["l"]).alias("v"))
    return rows.select("page", F.posexplode(augment.rising_fit(F.col("v"))).alias("i", "fit")).select("page", (F.col("i") + 1).cast("long").alias("idx"), F.round("fit", 6).alias("fit"))


@query(f"""WITH p AS (SELECT writer, t / 1e6 AS t, x, y, row_number() OVER w AS i, lead(t) OVER w IS NULL AS last FROM v_pen WINDOW w AS (PARTITION BY writer ORDER BY t)),
b AS (SELECT *, i > 1 AND NOT last AS inner_, CASE WHEN i > 1 AND NOT last AND {_u('writer', 'i', "'burst'")} < 0.02 THEN i + 1 + floor({_u('writer', 'i', "'length'")} * 5) END AS e FROM p),
k AS (SELECT *, max(e) OVER (PARTITION BY writer ORDER BY i ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS lost FROM b),
f AS (SELECT *, CASE WHEN inner_ THEN t + ({_u('writer', 'i', "'jitter'")} * 2 - 1) * 600 ELSE t END AS u FROM k WHERE NOT (inner_ AND (coalesce(lost >= i, false) OR {_u('writer', 'i', "'drop'")} < 0.05))),
n AS (SELECT *, row_number() OVER (PARTITION BY writer ORDER BY t) - 1 AS q FROM f)
SELECT writer, i AS sample, round(max(u - q * 2) OVER (PARTITION BY writer ORDER BY t ROWS UNBOUNDED PRECEDING) + q * 2, 3) AS t, round_even(x / 0.25::DOUBLE, 0) * 0.25::DOUBLE AS x, round_even(y / 0.25::DOUBLE, 0) * 0.25::DOUBLE AS y FROM n""", "v_pen")  # fmt: skip
def l16_digitized(spark, d):
    pen = views.pen(spark, d).withColumn("t", F.col("t") / 1e6)
    out = augment.digitized(pen, "writer", "t", quantum=0.25, drop=0.05, burst=0.02, jitter=600.0, gap=2.0)
    return out.withColumn("t", F.round("t", 3))


@query("""
SELECT p_partkey, length(p_name) + CASE WHEN p_size % 2 = 0 THEN 2 ELSE 3 END AS steps, p_name[:2] || 'xy' || p_name[3:] AS written,
  CASE WHEN p_size % 2 = 0 THEN 'char' ELSE 'strike' END AS fifth, CASE WHEN p_size % 2 = 0 THEN '2 3' ELSE '' END AS over, CASE WHEN p_size % 2 = 0 THEN '' ELSE '2-3' END AS marks
FROM part""")
def t13_writing_plans(spark, d):
    """Every name is begun wrongly after two characters: overwritten, or struck out with a mark."""
    style = F.when(F.expr("p_size % 2 = 0"), "overwrite").otherwise("strike")
    fix = F.array(F.struct(F.lit(2).alias("index"), F.lit("xy").alias("wrong"), style.alias("style"), F.lit(None).cast("int").alias("replace")))
    steps = augment.writing_steps(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"), fix.alias("fixes")))
    joined = lambda c, by: F.array_join(F.sort_array(F.collect_list(F.struct("step", c)))["c"], by)
    shown = {"written": (F.coalesce("ch", F.lit("")), ""), "over": (F.col("over").cast("string"), " ")}
    return steps.groupBy(F.col("id").alias("p_partkey")).agg(
        F.count("*").alias("steps"), *[joined(c.alias("c"), by).alias(n) for n, (c, by) in shown.items()], F.max(F.when(F.col("step") == 4, F.col("kind"))).alias("fifth"),
        F.coalesce(F.max(F.concat_ws("-", F.col("first").cast("string"), F.when(F.col("first").isNotNull(), F.col("last").cast("string")))), F.lit("")).alias("marks"),
    )


# --- sources and sinks ----------------------------------------------------------------------------------------------


@query("SELECT doc_id, count(*) AS n, sum(length(s))::BIGINT AS chars FROM (SELECT DISTINCT doc_id, regexp_replace(s, '^\\s+|\\s+$', '', 'g') AS s FROM (SELECT doc_id, unnest(string_split(text, chr(10)) || [lang, source]) AS s FROM documents)) WHERE s <> '' AND length(s) <= 50 GROUP BY doc_id")
def io30_json_strings(spark, d):
    doc = F.to_json(F.struct("lang", F.struct("source", F.array(F.struct("text")).alias("blocks")).alias("body"), F.col("n_chars")))
    rows = documents.json_lines(table(spark, d, "documents").select("doc_id", doc.alias("doc")), "doc_id", "doc")
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("line")).alias("chars"))


@query("SELECT o_custkey AS page, count(*) FILTER (WHERE o_orderstatus = 'F') AS renders, count(*) FILTER (WHERE o_orderstatus <> 'F') AS rejected FROM orders GROUP BY 1")
def io14_manifest(spark, d):
    problems = F.when(F.col("o_orderstatus") == "F", F.array().cast("array<string>")).otherwise(F.array("o_orderstatus"))
    m = documents.manifest(table(spark, d, "orders").select(F.col("o_custkey").alias("page"), F.col("o_orderkey").alias("file"), problems.alias("problems")))
    return m.select("page", F.size("renders").cast("long").alias("renders"), F.size("rejected").cast("long").alias("rejected"))


@query("SELECT '<table><tr><th>n_nationkey</th><th>n_name</th></tr>' || string_agg('<tr><td>' || n_nationkey || '</td><td>' || n_name || '</td></tr>', '' ORDER BY n_nationkey) || '</table>' AS html FROM nation")
def io28_html_report(spark, d):
    return documents.html_report(table(spark, d, "nation"), "n_nationkey", "n_name")


@query("SELECT page, idx, greatest(0, l - m) AS l, greatest(0, t - m) AS t, least(80, r + m) AS r, least(90, b + m) AS b FROM (SELECT *, greatest(4, 0.25::DOUBLE * greatest(r - l, b - t)) AS m FROM v_box)", "v_box")
def io23_crop_boxes(spark, d):
    crop = documents.crop_box(g.Box.of(), 0.25, 4.0, 80.0, 90.0)
    return views.boxes(spark, d).select("page", "idx", crop.alias("c")).select("page", "idx", "c.*")
