"""Nearest points and ray hits through a table of grid cells.

Every group (a mesh, a cloud) has a grid over its bounding box.  Points and triangles are listed under their cells,
queries list the cells they may need, and both meet in an equi-join on ``(group, cell)``.  The reach of a query grows round by
round: what lies within the reach of a round has been met, so a query is settled as soon as its best find lies within it, and
only the others go on.  A predicate over both rows may restrict what a query can find.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetry.functions.scalar import EPSILON
from facetry.functions.vectors import cross3, dot3, sub3, vec3
from facetry.operators.tiles import tile_product
from facetry.session import cut, dealt, forget

#: Rows a cell holds on average, and the most cells along one side of a grid.
PER_CELL, MAX_SIDE = 8, 256
#: Cells a ray walks in its first round; doubled in each further one.
FIRST_STEPS = 4
#: Share of the diagonal by which boxes overlap their neighbours, against rounding at the borders of cells.
SLACK = 1e-7

#: Halvings of the first reach that are tried where points crowd, and the share of rows in a cell above the finest that counts as no gain.
LEVELS = 8
NO_GAIN = 1.5
#: Points that a line is told of by each tile in the first round, how many times as many in each further one, and rows of a tile.
TOLD, TOLD_MORE, LINE_TILE = 4, 8, 8192
LINES_AT_ONCE = 64
#: Most triangles of a group whose rays meet them all in one task, the rays of such a task, and pairs looked at together.
LOCAL_TRIANGLES = 4096
LOCAL_RAYS = 16384
HELD_PAIRS = 1 << 17

Predicate = Callable[[Column, Column], Column]


def _grid(corners: DataFrame, group: list[str], per_cell: int, least: Column | None = None) -> DataFrame:
    """``group, lo{xyz}, hi{xyz}, diag, h`` from rows with ``lo{xyz}`` and ``hi{xyz}``; ``h`` is the side of a cell."""
    box = corners.groupBy(*group).agg(
        *[F.min(f"lo{c}").alias(f"glo{c}") for c in "xyz"],
        *[F.max(f"hi{c}").alias(f"ghi{c}") for c in "xyz"],
        F.count(F.lit(1)).alias("_n"),
        (F.avg(least) if least is not None else F.lit(0.0)).alias("_least"),
    )
    diag = F.sqrt(sum(((F.col(f"ghi{c}") - F.col(f"glo{c}")) ** 2 for c in "xyz"), F.lit(0.0)))
    side = F.least(F.lit(float(MAX_SIDE)), F.greatest(F.lit(1.0), F.cbrt(F.col("_n") / per_cell)))
    h = F.greatest(diag / side, F.col("_least"))
    return box.withColumn("diag", diag).withColumn("h", F.when(h > 0, h).otherwise(1.0)).drop("_n", "_least")


def _at(value: Column, c: str, size: Column) -> Column:
    """Cell number along an axis; the grid begins a little before the box, so that corners are not on borders."""
    return F.floor((value - F.col(f"glo{c}")) / size + F.lit(0.381966)).cast("long")


def _spread(low: Column, high: Column) -> Column:
    return F.when(high >= low, F.sequence(low, high)).otherwise(F.array().cast("array<long>"))


def _border(c: str, a: Column, b: Column, size: Column) -> Callable[[Column], Column]:
    """Where a line from ``a`` along ``b`` crosses the lower border of a cell."""
    return lambda i: F.try_divide(F.col(f"glo{c}") + (i - F.lit(0.381966)) * size - a, b)


def _walk(o, line, t0: Column, t1: Column, size: Column) -> Column:
    """Cells that the part of a line from ``t0`` to ``t1`` runs through, as ``array<struct<cx, cy, cz>>``."""
    borders = []
    for c, a, b in zip("xyz", o, line):
        first, last = (_at(a + t * b, c, size) for t in (t0, t1))
        planes = _spread(F.least(first, last) + 1, F.greatest(first, last))
        crossings = F.transform(planes, _border(c, a, b, size))
        borders.append(F.when(F.abs(b) > EPSILON, crossings).otherwise(F.array().cast("array<double>")))
    ts = F.array_sort(F.concat(F.array(t0, t1), *borders))
    middle = F.zip_with(F.slice(ts, F.lit(1), F.size(ts) - 1), F.slice(ts, F.lit(2), F.size(ts) - 1), lambda a, b: (a + b) / 2)
    cell = lambda t: F.struct(*[_at(a + t * b, c, size).alias(f"c{c}") for c, a, b in zip("xyz", o, line)])
    return F.array_distinct(F.transform(middle, cell))


def _crossing(o, line, margin: Column) -> tuple[Column, Column]:
    """Where a line enters and leaves the group's box, widened by ``margin``; it misses the box if they are out of order."""
    enter, leave = F.lit(float("-inf")), F.lit(float("inf"))
    for c, a, b in zip("xyz", o, line):
        low, high = F.col(f"glo{c}") - margin, F.col(f"ghi{c}") + margin
        flat = F.abs(b) <= EPSILON
        one, two = F.try_divide(low - a, b), F.try_divide(high - a, b)
        outside = (a < low) | (a > high)
        enter = F.greatest(enter, F.when(flat, F.when(outside, float("inf")).otherwise(float("-inf"))).otherwise(F.least(one, two)))
        leave = F.least(leave, F.when(flat, F.when(outside, float("-inf")).otherwise(float("inf"))).otherwise(F.greatest(one, two)))
    return enter, leave


_CELL = ["cx", "cy", "cz"]


def ray_hits(rays: DataFrame, triangles: DataFrame, group: list[str], per_cell: int = PER_CELL, compatible: Predicate | None = None) -> DataFrame:
    """``(group, ray, face, d)``: the first triangle that each ray meets, at distance ``d > 0``; ties by lower face.

    ``rays(group, ray, skip, ox.., lx..)`` have unit directions and ignore the face ``skip`` (or none, if null).
    ``triangles(group, face, ax .. cz)``.  ``compatible(ray, triangle)`` sees both rows as structs.  Without it, the rays of groups of
    up to ``LOCAL_TRIANGLES`` triangles meet them all in tasks of ``LOCAL_RAYS`` rays; others walk the grid.
    """
    if compatible is not None:
        return _walked_hits(rays, triangles, group, per_cell, compatible)
    sizes = triangles.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"), F.max(F.col("face").isNull()).alias("_odd"))
    small = cut(sizes.filter((F.col("_n") <= LOCAL_TRIANGLES) & ~F.col("_odd")).select(*group))
    found = cut(_hits_within(rays, triangles, group, small))
    large = triangles.join(small, group, "left_anti")
    if large.isEmpty():
        forget(small)
        return found
    others = _walked_hits(rays.join(small, group, "left_anti"), large, group, per_cell, None)
    out = cut(found.unionByName(others))
    forget(small, found, others)
    return out


def _hits_within(rays: DataFrame, triangles: DataFrame, group: list[str], small: DataFrame) -> DataFrame:
    """First hits in the groups ``small(group)``, a block of rays against all triangles of its group."""
    asked = rays.filter(F.col("ray").isNotNull()).join(small, group)
    blocks = asked.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / LOCAL_RAYS).cast("long").alias("_blocks"))
    blocks = cut(blocks)
    asked = asked.join(blocks, group).select(
        *group, F.pmod(F.xxhash64("ray"), F.col("_blocks")).alias("_block"), "ray", F.col("skip").isNotNull().alias("_skips"),
        F.coalesce("skip", F.lit(0)).alias("skip"), *[F.col(f"{e}{c}").cast("double").alias(f"{e}{c}") for e in "ol" for c in "xyz"],
    )
    held = triangles.join(blocks, group).withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
    # fresh column identities, so that rays may come from the triangles
    held = held.select(*[F.col(c).alias(c) for c in (*group, "_block", "face")], *[F.col(f"{p}{c}").cast("double").alias(f"{p}{c}") for p in "abc" for c in "xyz"])
    kinds = {f.name: f.dataType.simpleString() for f in [*triangles.schema.fields, *rays.schema.fields]}
    ids = [*group, "ray"]
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in ids], f"face {kinds['face']}", "d double"])

    def kernel(r: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        at, face, d = _first_hits(r, t)
        # rows of one ray share what any of them meets
        hit = pd.DataFrame({"ray": r["ray"].to_numpy()[at], "face": face, "d": d}).sort_values(["d", "face"]).drop_duplicates("ray")
        return r[ids].merge(hit, on="ray")

    key = [*group, "_block"]
    return asked.groupBy(*key).cogroup(held.groupBy(*key)).applyInPandas(kernel, schema)


def _first_hits(r: pd.DataFrame, t: pd.DataFrame):
    """Rows of ``r`` that meet a triangle, its face and the distance; ties by lower face."""
    t = t.sort_values("face")
    face = t["face"].to_numpy()
    corner = {p: t[[f"{p}{c}" for c in "xyz"]].to_numpy("float64") for p in "abc"}
    o, line = (r[[f"{e}{c}" for c in "xyz"]].to_numpy("float64") for e in "ol")
    none = np.zeros(0, int), face[:0], np.zeros(0)
    if not len(r) or not len(t):
        return none
    # a filter: how far the line passes from the middle of a triangle, against the farthest corner
    middle = (corner["a"] + corner["b"] + corner["c"]) / 3
    size2 = np.max([((corner[p] - middle) ** 2).sum(1) for p in "abc"], axis=0)
    base = np.nan_to_num(middle).mean(0)
    m, far = middle - base, o - base
    length = np.sqrt((line**2).sum(1))
    unit = line / np.where(length > 0, length, 1.0)[:, None]
    skips, skip = r["_skips"].to_numpy(bool), r["skip"].to_numpy()
    m2, far2, along0 = (m**2).sum(1), (far**2).sum(1), (far * unit).sum(1)
    best_at, best_face, best_d = [], [], []
    step = max(1, HELD_PAIRS // len(t))
    for i in range(0, len(r), step):
        part = slice(i, i + step)
        along = unit[part] @ m.T - along0[part, None]
        gap2 = far2[part, None] - 2.0 * (far[part] @ m.T) + m2 - along * along
        slack = 1e-9 * (far2[part, None] + m2 + 1e-12)
        with np.errstate(invalid="ignore"):
            ri, ti = np.nonzero(gap2 <= size2 * (1 + 1e-9) + slack)
        ri += i
        use = ~(skips[ri] & (skip[ri] == face[ti]))
        ri, ti = ri[use], ti[use]
        # products are formed as in the walk through the grid, to the last bit
        a, b, c = ([corner[p][ti, k] for k in range(3)] for p in "abc")
        x, s = [line[ri, k] for k in range(3)], [o[ri, k] - a[k] for k in range(3)]
        e1, e2 = [q - p for p, q in zip(a, b)], [q - p for p, q in zip(a, c)]
        p, q = cross3(x, e2), cross3(s, e1)
        det, u, v, d = dot3(p, e1), dot3(s, p), dot3(x, q), dot3(e2, q)
        with np.errstate(all="ignore"):
            ok = (np.abs(det) >= EPSILON) & (u / det >= 0) & (u / det <= 1) & (v / det >= 0) & ((u + v) / det <= 1)
            d = d / det
            ok &= d > 0
        ri, ti, d = ri[ok], ti[ok], d[ok]
        order = np.lexsort((ti, d, ri))
        ri, ti, d = ri[order], ti[order], d[order]
        first = np.r_[True, ri[1:] != ri[:-1]] if len(ri) else np.zeros(0, bool)
        best_at.append(ri[first])
        best_face.append(face[ti[first]])
        best_d.append(d[first])
    return np.concatenate(best_at), np.concatenate(best_face), np.concatenate(best_d)


def _walked_hits(rays: DataFrame, triangles: DataFrame, group: list[str], per_cell: int, compatible: Predicate | None) -> DataFrame:
    low = {c: F.least(*[F.col(f"{p}{c}") for p in "abc"]) for c in "xyz"}
    high = {c: F.greatest(*[F.col(f"{p}{c}") for p in "abc"]) for c in "xyz"}
    boxed = triangles.withColumns({f"lo{c}": low[c] for c in "xyz"} | {f"hi{c}": high[c] for c in "xyz"})
    # cells no smaller than the triangles' mean extent keep the number of cells per triangle small
    grid = cut(_grid(boxed, group, per_cell, F.greatest(*[F.col(f"hi{c}") - F.col(f"lo{c}") for c in "xyz"])))
    slack = F.col("diag") * SLACK
    listed = boxed.select(*group, F.struct(*triangles.columns).alias("_t"), *[f"{e}{c}" for e in ("lo", "hi") for c in "xyz"]).join(grid, group)
    for c in "xyz":
        cells = F.sequence(_at(F.col(f"lo{c}") - slack, c, F.col("h")), _at(F.col(f"hi{c}") + slack, c, F.col("h")))
        listed = listed.withColumn(f"c{c}", F.explode(cells))
    listed = cut(listed.select(*group, *_CELL, "_t"))

    o, line = vec3("o"), vec3("l")
    enter, leave = _crossing(o, line, slack)
    waiting = rays.select(*group, F.struct(*rays.columns).alias("_r"), "ray", *[f"{e}{c}" for e in "ol" for c in "xyz"]).join(grid, group)
    waiting = waiting.withColumn("t0", F.greatest(enter, F.lit(0.0))).withColumn("leave", leave)
    waiting = cut(waiting.filter(F.col("t0") <= F.col("leave")))
    ids = [*group, "ray"]
    best = F.min(F.struct("d", "face")).alias("best")
    done, steps, found = [], FIRST_STEPS, []
    while not waiting.isEmpty():
        reach = F.least(F.col("t0") + steps * F.col("h"), F.col("leave"))
        asked = waiting.withColumn("t1", reach)
        asked = asked.withColumn("cell", F.explode(_walk(o, line, F.col("t0"), F.col("t1"), F.col("h")))).select("*", "cell.*")
        a, b, c = (tuple(F.col(f"_t.{p}{k}") for k in "xyz") for p in "abc")
        met = asked.join(listed, [*group, *_CELL]).filter(F.coalesce(F.col("_t.face") != F.col("_r.skip"), F.lit(True)))
        if compatible is not None:
            met = met.filter(compatible(F.col("_r"), F.col("_t")))
        # o + d * line = a + u * (b - a) + v * (c - a), solved by Cramer's rule.  On a shared edge the last bit decides which
        # triangle is met, so products are formed as the SQL forms them: from line x (c - a) and (o - a) x (b - a).
        e1, e2, s = sub3(b, a), sub3(c, a), sub3(o, a)
        p, q = cross3(line, e2), cross3(s, e1)
        met = met.withColumn("_det", dot3(p, e1)).filter(F.abs("_det") >= EPSILON)
        det, u, v = F.col("_det"), dot3(s, p), dot3(line, q)
        met = met.filter((u / det).between(0, 1) & (v / det >= 0) & ((u + v) / det <= 1))
        met = met.select(*ids, (dot3(e2, q) / det).alias("d"), F.col("_t.face").alias("face"))
        hits = met.filter(F.col("d") > 0).groupBy(*ids).agg(best)
        state = cut(waiting.withColumn("t1", reach).join(hits, ids, "left"))
        # a triangle may be met in a cell and hit beyond it, where others were not met yet
        settled = state.filter(F.col("best.d") <= F.col("t1"))
        found.append(settled.select(*ids, "best.face", "best.d"))
        rest = state.filter(~F.coalesce(F.col("best.d") <= F.col("t1"), F.lit(False)) & (F.col("t1") < F.col("leave")))
        done += [waiting, state]
        waiting = cut(rest.drop("t0", "best").withColumnRenamed("t1", "t0"))
        steps *= 2
    if not found:
        kind = triangles.select("face").schema["face"].dataType
        return rays.select(*ids, F.lit(None).cast(kind).alias("face"), F.lit(None).cast("double").alias("d")).filter(F.lit(False))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    out = cut(out)
    forget(grid, listed, waiting, *done)
    return out


def _first_size(points: DataFrame, grid: DataFrame, group: list[str], per_cell: int) -> DataFrame:
    """The grid with cells halved where points crowd, until a row shares its cell with about ``per_cell`` others or copies remain."""
    at = points.select(*group, "x", "y", "z").dropna().join(grid, group).withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS))))
    size = F.col("h") / F.pow(F.lit(2.0), F.col("_level"))
    cells = at.groupBy(*group, "_level", *[_at(F.col(c), c, size).alias(f"c{c}") for c in "xyz"]).agg(F.count(F.lit(1)).cast("double").alias("_n"))
    shared = cells.groupBy(*group, "_level").agg((F.sum(F.col("_n") * F.col("_n")) / F.sum("_n")).alias("_shared"))
    finest = shared.groupBy(*group).agg(F.min("_shared").alias("_least"))
    enough = F.col("_shared") <= F.greatest(F.lit(2.0 * per_cell), NO_GAIN * F.col("_least"))
    level = shared.join(finest, group).filter(enough).groupBy(*group).agg(F.min("_level").alias("_level"))
    return grid.join(level, group, "left").withColumn("h", F.col("h") / F.pow(F.lit(2.0), F.coalesce("_level", F.lit(0)))).drop("_level")


def _nearest(queries, points, group, key, distance2, cells_of, box_distance, max_distance, compatible, per_cell):
    corners = points.select(*group, *[F.col(c).alias(f"{e}{c}") for e in ("lo", "hi") for c in "xyz"])
    grid = cut(_first_size(points, _grid(corners, group, per_cell), group, per_cell))
    held = points.select(*group, F.struct(*points.columns).alias("_p"), "x", "y", "z").join(grid, group)
    waiting = queries.select(*group, key, F.struct(*queries.columns).alias("_q"), *[c for c in queries.columns if c not in (*group, key)])
    waiting = waiting.join(grid, group).withColumn("_far", box_distance)
    cap = F.lit(float("inf") if max_distance is None else float(max_distance))
    waiting = cut(waiting.withColumn("_limit", F.least(F.col("_far"), cap)).withColumn("_reach", F.least("h", "_limit")))
    ids, found, done = [*group, key], [], []
    scale = 1.0
    while not waiting.isEmpty():
        # cells grow with the reach, so that a query always lists a bounded number of them
        size = F.col("h") * scale
        at = held.select(*group, "_p", *[_at(F.col(c), c, size).alias(f"c{c}") for c in "xyz"])
        asked = waiting.withColumn("cell", F.explode(cells_of(size)))
        asked = asked.select(*ids, "_q", "_reach", "ox", "oy", "oz", "cell.*")
        met = asked.join(at, [*group, *_CELL]).withColumn("_d2", distance2)
        if compatible is not None:
            met = met.filter(compatible(F.col("_q"), F.col("_p")))
        # what lies beyond the reach settles nothing
        met = met.filter(F.sqrt("_d2") <= F.col("_reach")).select(*ids, F.struct(F.col("_d2").alias("d2"), "_p").alias("_hit"))
        hits = met.groupBy(*ids).agg(F.min("_hit").alias("best"))
        state = cut(waiting.join(hits, ids, "left"))
        near = F.coalesce(F.sqrt("best.d2") <= F.col("_reach"), F.lit(False))
        found.append(state.filter(near & (F.sqrt("best.d2") < cap)).select(*ids, F.col("best._p").alias("point"), F.sqrt("best.d2").alias("d")))
        rest = state.filter(~near & (F.col("_reach") < F.col("_limit"))).drop("best")
        scale *= 2.0
        last, waiting = waiting, cut(rest.withColumn("_reach", F.least(F.col("h") * scale, F.col("_limit"))))
        forget(last)
        done.append(state)
    if not found:
        return _nothing(queries, points, ids)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    out = cut(out)
    forget(grid, waiting, *done)
    return out


def _nothing(queries: DataFrame, points: DataFrame, ids: list[str]) -> DataFrame:
    kind = points.select(F.struct(*points.columns).alias("p")).schema["p"].dataType
    return queries.select(*ids, F.lit(None).cast(kind).alias("point"), F.lit(None).cast("double").alias("d")).filter(F.lit(False))


def _around(cells: Column) -> Column:
    """Cells and all their neighbours."""
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("k")) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)])
    moved = lambda e, s: F.struct(*[(e[f"c{c}"] + s[n]).alias(f"c{c}") for c, n in zip("xyz", "ijk")])
    return F.array_distinct(F.flatten(F.transform(cells, lambda e: F.transform(steps, lambda s: moved(e, s)))))


def nearest_point(
    queries: DataFrame,
    points: DataFrame,
    group: list[str],
    key: str = "q",
    max_distance: float | None = None,
    compatible: Predicate | None = None,
    per_cell: int = PER_CELL,
) -> DataFrame:
    """``(group, key, point, d)``: the nearest compatible point of each query, closer than ``max_distance``.

    ``queries(group, key, ox, oy, oz, ...)``, ``points(group, x, y, z, ...)``; ``point`` is the whole row, and of equally near
    points the one whose row compares lowest.  ``compatible(query, point)`` sees both rows as structs.
    """
    o = vec3("o")
    gap = sum(((F.col(f"_p.{c}") - a) ** 2 for c, a in zip("xyz", o)), F.lit(0.0))
    far = sum((F.greatest(F.abs(a - F.col(f"glo{c}")), F.abs(F.col(f"ghi{c}") - a)) ** 2 for c, a in zip("xyz", o)), F.lit(0.0))

    def cells_of(size: Column) -> Column:
        return _around(F.array(F.struct(*[_at(a, c, size).alias(f"c{c}") for c, a in zip("xyz", o)])))

    # beyond the farthest corner of the box there is nothing
    return _nearest(queries, points, group, key, gap, cells_of, F.sqrt(far) * (1 + SLACK), max_distance, compatible, per_cell)


def nearest_to_line(
    lines: DataFrame,
    points: DataFrame,
    group: list[str],
    key: str = "q",
    max_distance: float | None = None,
    compatible: Predicate | None = None,
    per_cell: int = PER_CELL,
) -> DataFrame:
    """Like :func:`nearest_point` for ``lines(group, key, ox.., lx.., ...)`` with unit directions, endless both ways.

    A line crosses so many cells that all lines meet all points, tile by tile.  A tile tells a line of its few nearest points and
    how near others may be; a line is settled once its best compatible point is nearer than that, and the others are told of more.
    """
    ids = [*group, key]
    points = cut(points.withColumn("_p", F.struct(*points.columns)).withColumn("_no", F.monotonically_increasing_id()))
    waiting = cut(lines.select(*ids, F.struct(*lines.columns).alias("_q"), *[f"{e}{c}" for e in "ol" for c in "xyz"]).withColumn("_line", F.monotonically_increasing_id()))
    cap = float("inf") if max_distance is None else float(max_distance)
    gap = sub3(tuple(F.col(f"_p.{c}") for c in "xyz"), vec3("o"))
    across = cross3(gap, vec3("l"))
    spots = points.select(*group, "_no", *[F.col(c).cast("double").alias(c) for c in "xyz"])
    found, told, begun = [], TOLD, waiting
    while not waiting.isEmpty():
        ways = waiting.select(*group, "_line", *[F.col(f"{e}{c}").cast("double").alias(f"{e}{c}") for e in "ol" for c in "xyz"])
        near = tile_product(ways, spots, group, "_line", "_no", _lines_kernel(told, cap), "_line long, _no long, _d2 double, _open double", LINE_TILE)
        known = F.min("_open").over(Window.partitionBy("_line"))
        near = cut(near.withColumn("_open", known).filter((F.col("_d2") <= F.col("_open")) | F.col("_no").isNull()))
        some = near.join(dealt(waiting), "_line").join(dealt(points.select("_no", "_p")), "_no", "left")
        d2 = dot3(across, across)
        good = F.col("_no").isNotNull() & (F.sqrt(d2) < cap)
        if compatible is not None:
            good &= F.coalesce(compatible(F.col("_q"), F.col("_p")), F.lit(False))
        best = some.groupBy("_line").agg(F.min("_open").alias("_open"), F.min(F.when(good, F.struct(d2.alias("d2"), "_p"))).alias("best"))
        state = cut(waiting.join(dealt(best), "_line"))
        sure = F.coalesce(F.col("best.d2") < F.col("_open"), F.lit(False)) | (F.col("_open") == float("inf"))
        found.append(cut(state.filter(sure & F.col("best").isNotNull()).select(*ids, F.col("best._p").alias("point"), F.sqrt("best.d2").alias("d"))))
        rest = cut(state.filter(~sure).drop("best", "_open"))
        forget(near, state, waiting)
        waiting = rest
        told *= TOLD_MORE
    if not found:
        forget(points, begun)
        return _nothing(lines, points, ids)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    out = cut(out)
    forget(points, waiting, *found)
    return out


def _lines_kernel(told: int, cap: float):
    """The ``told`` points of a tile that lie nearest to each line, and what the others' squared distances are at least."""

    def kernel(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        names = ["_line", "_no", "_d2", "_open"]
        spot = b[["x", "y", "z"]].to_numpy("float64") if len(b) else np.zeros((0, 3))
        real = np.isfinite(spot).all(1)
        spot, no = spot[real], b["_no"].to_numpy()[real]
        o, line = (a[[f"{e}{c}" for c in "xyz"]].to_numpy("float64") for e in "ol")
        fine = np.isfinite(o).all(1) & np.isfinite(line).all(1)
        o, line, number = o[fine], line[fine], a["_line"].to_numpy()[fine]
        if not len(spot) or not len(o):
            return pd.DataFrame({c: [] for c in names})
        middle = spot.mean(0)
        spot, o = spot - middle, o - middle
        size2, out = (spot**2).sum(1), []
        for i in range(0, len(o), LINES_AT_ONCE):
            at, way = o[i : i + LINES_AT_ONCE], line[i : i + LINES_AT_ONCE]
            far2, unit = (at**2).sum(1)[:, None], (way**2).sum(1)[:, None]
            along = way @ spot.T - (at * way).sum(1)[:, None]
            # |p - o|^2 |l|^2 - ((p - o) l)^2, as the cross product has it
            d2 = (far2 - 2.0 * (at @ spot.T) + size2) * unit - along * along
            slack = 1e-13 * (far2 + size2.max()) * np.maximum(unit, 1.0)
            if len(spot) > told:
                last = np.partition(d2, told - 1, axis=1)[:, told - 1, None]
                least = np.where(last > cap * cap + slack, np.inf, last - 2 * slack)
            else:
                last = np.full((len(at), 1), np.inf)
                least = last
            li, pi = np.nonzero((d2 <= last) & (d2 <= cap * cap + slack))
            out.append((number[i + li], no[pi], d2[li, pi] - 2 * slack[li, 0], least[li, 0]))
        return pd.DataFrame(dict(zip(names, (np.concatenate(c) for c in zip(*out)))))

    return kernel
