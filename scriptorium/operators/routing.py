"""Wires with right angles on a grid: cheapest paths, each searched where its page's cells are."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lineage import dealt

# What a bend costs, a crossing, and each side on which a wire runs beside another; a step costs 1.
BEND, CROSSING, BESIDE = 3.0, 6.0, 1.5
#: Right, down, left, up.
STEPS = ((1, 0), (0, 1), (-1, 0), (0, -1))
#: What lies in a cell: a wall, a level wire, an upright one.
_WALL, _LEVEL, _UPRIGHT = range(3)
#: Requests of a task at most, by number: a search takes long for the bytes of its row.
TASK_ROWS = 50_000


def cheapest(ask: tuple[int, int, int, int], lying: list[int], columns: int, rows: int, bend: float, crossing: float, beside: float) -> tuple[float | None, str | None]:
    """Cost and path of the cheapest wire from (si, sj) to (ti, tj), by letters the first of these; ``lying`` has ``3 * cell + what`` for what lies in cells.

    States (cell, direction) are taken in the order of what their way costs, with the
    least that is still to go, then of letters.  Cells are numbered with a rim around the grid.
    """
    si, sj, ti, tj = ask
    wide = rows + 2
    cell = lambda i, j: (i + 1) * wide + j + 1
    if (si, sj) == (ti, tj):
        return 0.0, ""
    if not (-1 <= si <= columns and -1 <= sj <= rows and 0 <= ti < columns and 0 <= tj < rows):
        return None, None
    held: dict[int, int] = {}
    for x in lying:
        held[x // 3] = held.get(x // 3, 0) | 1 << x % 3
    delta = [i * wide + j for i, j in STEPS]
    target = cell(ti, tj)
    # the distance to the target counts only where sums of costs are exact; else ways that cost the same might seem different
    exact = all(c >= 0 and float(c * 1024).is_integer() for c in (bend, crossing, beside))
    entry: dict[tuple[int, int], float | None] = {}

    def enter(at: int, level: int) -> float | None:
        """What it costs to enter a cell in a direction, null if none may."""
        i, j = at // wide - 1, at % wide - 1
        if not (0 <= i < columns and 0 <= j < rows):
            return None
        if at == target:
            return 0.0
        kind, own = held.get(at, 0), _LEVEL if level else _UPRIGHT
        if kind >> _WALL & 1 or kind >> own & 1:
            return None
        side = 1 if level else wide
        near = (held.get(at - side, 0) >> own & 1) + (held.get(at + side, 0) >> own & 1)
        return (crossing if kind else 0.0) + near * beside

    first = cell(si, sj)
    heap = [(0.0, "", 0.0, first, d) for d in range(4)]
    done = set()
    while heap:
        _, path, cost, at, d = heapq.heappop(heap)
        if at == target:
            return cost, path
        if (at, d) in done:
            continue
        done.add((at, d))
        wired = held.get(at, 0) >> _LEVEL
        for o in (d,) if wired else ((d, (d + 1) % 4, (d + 3) % 4)):
            to = at + delta[o]
            if (to, o) in done:
                continue
            key = to, o % 2
            if key not in entry:
                entry[key] = enter(to, o % 2 == 0)
            more = entry[key]
            if more is None:
                continue
            way = cost + 1 + (0.0 if o == d else bend) + more
            ahead = abs(to // wide - 1 - ti) + abs(to % wide - 1 - tj) if exact else 0
            heapq.heappush(heap, (way + ahead, path + "RDLU"[o], way, to, o))
    return None, None


def routes(requests: DataFrame, blocked: DataFrame, wires: DataFrame, columns: int, rows: int, bend: float = BEND, crossing: float = CROSSING, beside: float = BESIDE) -> DataFrame:
    """The cheapest wire of each request: ``page, net, cost, path``, null where there is no way.

    ``requests(page, net, si, sj, ti, tj)`` ask for a wire each; cells of ``blocked(page,
    i, j)`` can't be entered, except as a target.  ``wires(page, i, j, level)`` are
    laid already: a cell that holds one is only crossed, straight on, by a level
    wire where it is upright and the other way round; a wire beside them costs more.  Wires don't turn back.
    ``path`` has a letter of RDLU for each step; of equally cheap paths the first by letters counts.

    What lies on a page is one list, no longer than the grid has cells, and the
    only thing shuffled besides the requests; no state of a search leaves its task.
    """
    on = F.col("i").between(-1, columns) & F.col("j").between(-1, rows)
    at = ((F.col("i") + 1) * (rows + 2) + F.col("j") + 1).cast("int") * 3
    what = F.when(F.col("level"), _LEVEL).otherwise(_UPRIGHT)
    lies = blocked.filter(on).select("page", (at + _WALL).alias("x")).unionByName(wires.filter(on).select("page", (at + what).alias("x")))
    asked = dealt(requests.select("page", "net", "si", "sj", "ti", "tj"), TASK_ROWS, "page")
    sheets = lies.groupBy("page").agg(F.collect_set("x").alias("lying"))
    both = asked.join(sheets, "page", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ask = list(zip(*(batch.column(c).to_pylist() for c in ("page", "si", "sj", "ti", "tj"))))
            found = [(None, None) if None in a else cheapest(a[1:], lying or [], columns, rows, bend, crossing, beside) for a, lying in zip(ask, batch.column("lying").to_pylist())]
            new = [pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("page"), batch.column("net"), *new], ["page", "net", "cost", "path"])

    keys = [requests.schema["page"], requests.schema["net"]]
    return both.mapInArrow(run, T.StructType([*keys, T.StructField("cost", T.DoubleType()), T.StructField("path", T.StringType())]))


def cells(routes_: DataFrame, requests: DataFrame) -> DataFrame:
    """``page, net, at, i, j, level``: the cells of routed wires from source to target, and whether the wire runs level there; both ways where it bends."""
    rows = routes_.filter("path is not null").join(requests.select("page", "net", "si", "sj"), ["page", "net"])
    step = F.posexplode(F.transform(F.sequence(F.lit(0), F.length("path")), lambda n: F.substr(F.col("path"), F.lit(1), n))).alias("at", "gone")
    rows = rows.select("page", "net", "si", "sj", "path", step)
    count = lambda c: F.length("gone") - F.length(F.replace("gone", F.lit(c), F.lit("")))
    here, ahead = F.substr("path", F.col("at"), F.lit(1)), F.substr("path", F.col("at") + 1, F.lit(1))
    ways = F.array_distinct(F.transform(F.filter(F.array(F.when(F.col("at") > 0, here), ahead), lambda c: c.isNotNull() & (c != "")), lambda c: c.isin("R", "L")))
    return rows.select("page", "net", "at", (F.col("si") + count("R") - count("L")).alias("i"), (F.col("sj") + count("D") - count("U")).alias("j"), F.explode(ways).alias("level"))
