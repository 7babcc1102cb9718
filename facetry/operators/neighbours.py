"""Exact k-nearest-neighbour graphs over vector columns.

Rows are assigned to pivot cells and cells are cut into tiles of bounded size.  Every tile is first
joined with itself, which bounds each row's k-th distance; a row then needs only cells whose
lower bound ``|row - pivot| - radius`` does not exceed that distance.  Cells that lie together share a
shelf, and a row is sent once to every shelf that holds a cell it needs, however many those are.  Shelves and the
queries sent to them are cut into pieces of bounded size, so no task ever holds an unbounded group; a task
compares a block of queries with the needed cells only, and only the k best rows per (row, shelf) leave it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from facetry.session import cut, forget

TILE_ROWS = 4096
MAX_PIVOTS = 2048
#: Most rows of a shelf and of the queries that meet it in a task, and queries compared at once.
SHELF_ROWS = 16384
BLOCK_ROWS = 256
#: Candidates that a block of queries meets at once, and how many times ``k`` may pass before the k-th is looked for among all.
PIECE_ROWS = 4096
MANY = 32
#: Rows whose distances to all pivots are held at once, and rows of a routed batch.
_GAP_ROWS = 512
_SENT_ROWS = 4096
_SUB = 1 << 32


class _Candidates:
    """Rows to search among, with their vectors around a common middle in the precisions that products are formed in.

    Products are only a filter: a bound of their rounding is added, and what passes is measured again.
    """

    def __init__(self, ids: np.ndarray, vec: np.ndarray):
        self.ids, self.vec = ids, vec
        real = np.isfinite(vec).all(1)
        self.middle = vec[real].mean(0) if real.any() else np.zeros(vec.shape[1])
        self.moved = vec - self.middle
        self.size2 = (self.moved**2).sum(1)
        self.most = self.size2[real].max(initial=0.0)
        self.short = self.moved.astype("float32") if self.most < 1e30 else None
        self.short2 = self.size2.astype("float32") if self.short is not None else None

    def products(self, q: np.ndarray, q2: np.ndarray, bar2: np.ndarray, rows, short: bool):
        """``|c|^2 - 2 q c`` of the rows and what it may be at most for a distance of ``sqrt(bar2)``, rounding included."""
        eps = 1.2e-7 if short else 2.3e-16
        slack = eps * (q.shape[1] + 8) * (q2 + self.most) + 1e-30
        c, c2 = (self.short, self.short2) if short else (self.moved, self.size2)
        rough = (-2.0 * q).astype(c.dtype) @ c[rows].T
        rough += c2[rows]
        return rough, bar2 - q2 + slack, slack


def _nearest(q_id, q_vec, held: _Candidates, use, k, limit):
    """k nearest of the candidates ``use`` for each query by (distance, id), never the query itself.

    Candidates are met in pieces; the k-th distance so far bounds what is looked at in the next.
    """
    q = q_vec - held.middle
    q2 = (q**2).sum(1)
    bar2 = limit.astype(float) ** 2
    best = (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    short = False
    for begin in range(0, len(use), PIECE_ROWS):
        rows = use[begin : begin + PIECE_ROWS]
        whole = len(use) == len(held.ids)
        rough, most, slack = held.products(q, q2, bar2, slice(begin, begin + PIECE_ROWS) if whole else rows, short)
        passed = np.flatnonzero((rough <= most.astype(rough.dtype)[:, None]).ravel())
        if len(passed) > MANY * k * len(q):
            own = rough.astype("float64")
            own[q_id[:, None] == held.ids[rows][None, :]] = np.inf
            keep = min(k, own.shape[1]) - 1
            most = np.minimum(most, np.partition(own, keep, axis=1)[:, keep] + 2 * slack)
            passed = np.flatnonzero((own <= most[:, None]).ravel())
        qi, ci = np.divmod(passed, rough.shape[1])
        ci = rows[ci]
        other = q_id[qi] != held.ids[ci]
        qi, ci = qi[other], ci[other]
        d = np.empty(len(qi))
        for i in range(0, len(qi), 1 << 16):
            part = slice(i, i + (1 << 16))
            d[part] = np.sqrt(((q_vec[qi[part]] - held.vec[ci[part]]) ** 2).sum(1))
        near = d <= limit[qi] * (1 + 1e-9) + 1e-12
        qi, ci, d = (np.concatenate(pair) for pair in zip(best, (qi[near], ci[near], d[near])))
        order = np.lexsort((held.ids[ci], d, qi))
        qi, ci, d = qi[order], ci[order], d[order]
        start = np.r_[True, qi[1:] != qi[:-1]] if len(qi) else np.zeros(0, bool)
        rank = np.arange(len(qi)) - np.maximum.accumulate(np.where(start, np.arange(len(qi)), 0))
        first = rank < k
        best = (qi[first], ci[first], d[first])
        last = rank == k - 1
        bar2[qi[last]] = np.minimum(bar2[qi[last]], d[last] ** 2)
        # single precision where its rounding is small against the distances that count
        short = held.short is not None and q2.max(initial=0.0) < 1e30 and np.mean(1.2e-7 * (q.shape[1] + 8) * (q2 + held.most) > 0.05 * bar2) < 0.1
    qi, ci, d = best
    return pd.DataFrame({"src": q_id[qi], "dst": held.ids[ci], "d": d})


def _matrix(column) -> np.ndarray:
    return np.stack(column.to_numpy()).astype("float64")


def _blocks(q_id, q_vec, c_id, c_vec, k, limit, rows=BLOCK_ROWS):
    held, use = _Candidates(c_id, c_vec), np.arange(len(c_id))
    parts = [
        _nearest(q_id[i : i + rows], q_vec[i : i + rows], held, use, k, limit[i : i + rows])
        for i in range(0, len(q_id), rows)
    ]
    return pd.concat(parts) if parts else pd.DataFrame({"src": [], "dst": [], "d": []})


_EDGE = "src long, dst long, d double"


def _best(edges: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest of every source; tasks trim to ``k`` before the shuffle and never hold a whole source."""
    rank = F.row_number().over(Window.partitionBy("src").orderBy("d", "dst"))
    return edges.withColumn("slot", rank).filter(F.col("slot") <= k).select("src", "slot", "dst", "d")


def knn(points: DataFrame, key: str, vector: str, k: int, tile_rows: int = TILE_ROWS) -> DataFrame:
    """``(src, slot, dst, d)``: the ``k`` nearest other rows, slot 1 nearest, ties by lower id."""
    src = points.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    n_pivots = int(max(1, min(MAX_PIVOTS, -(-src.count() // tile_rows))))
    return _expand_copies(src, k, lambda distinct: _knn_tiled(distinct, k, n_pivots, tile_rows))


def _expand_copies(src: DataFrame, k: int, search) -> DataFrame:
    """Search among distinct vectors only, then hand the result to every copy.

    Any number of equal vectors is represented by its ``k + 1`` lowest ids: no row can have more of
    them among its ``k`` nearest, so copies never meet each other pairwise.
    """
    keyed = src.withColumn("_h", F.xxhash64("v"))
    rank = F.row_number().over(Window.partitionBy("_h", "v").orderBy("id"))
    low = keyed.withColumn("_r", rank).filter(F.col("_r") <= k + 1)
    groups = cut(low.groupBy("_h", "v").agg(F.array_sort(F.collect_list("id")).alias("ids")))
    groups = groups.withColumn("rep", F.col("ids")[0])
    near = search(groups.select(F.col("rep").alias("id"), "v"))
    members = groups.select(F.col("rep").alias("dst"), "ids")
    found = near.join(members, "dst").select("src", "d", F.explode("ids").alias("dst"))
    found = _best(found, k + 1).groupBy("src").agg(F.collect_list(F.struct("d", "dst")).alias("_far"))
    own = groups.select(
        F.col("rep").alias("src"),
        F.transform("ids", lambda i: F.struct(F.lit(0.0).alias("d"), i.alias("dst"))).alias("_own"),
    )
    both = own.join(found, "src", "left")
    merged = F.when(F.col("_far").isNull(), F.col("_own")).otherwise(F.concat("_own", "_far"))
    lists = both.select(F.col("src").alias("rep"), F.slice(F.array_sort(merged), 1, k + 1).alias("_top"))
    rows = keyed.join(groups.select("_h", "v", "rep"), ["_h", "v"]).select("id", "rep").join(lists, "rep")
    others = rows.select(
        F.col("id").alias("src"), F.slice(F.filter("_top", lambda e: e["dst"] != F.col("id")), 1, k).alias("_t")
    )
    flat = others.select("src", F.posexplode("_t").alias("_i", "_e"))
    return flat.select("src", (F.col("_i") + 1).alias("slot"), F.col("_e.dst").alias("dst"), F.col("_e.d").alias("d"))


def _knn_tiled(src: DataFrame, k: int, n_pivots: int, tile_rows: int) -> DataFrame:
    placed, layout = _place(src, n_pivots, tile_rows)
    n_sub = F.element_at(F.lit(layout.subs.tolist()), F.col("at").cast("int") + 1)
    tiles = placed.withColumn("tile", F.col("at") * _SUB + F.pmod(F.xxhash64("id"), n_sub))

    def within(pdf):
        ids, x = pdf["id"].to_numpy(), _matrix(pdf["v"])
        near = _blocks(ids, x, ids, x, k, np.full(len(ids), np.inf))
        by = near.groupby("src")["d"].agg(["size", "max"]).reindex(ids)
        limit = np.where(by["size"].to_numpy() >= k, by["max"].to_numpy(), np.inf)
        return pdf.assign(limit=limit)[["id", "v", "at", "limit"]]

    # the own tile only bounds the reach; it is met again with the rest of its shelf
    queries = cut(tiles.select("id", "v", "at", "tile").groupBy("tile").applyInPandas(within, _QUERY))
    found = cut(_best(_routed(queries, placed, layout, k), k))
    forget(queries, placed)
    return found


_QUERY = "id long, v array<double>, at long, limit double"


class _Layout:
    """Pivot cells (at most MAX_PIVOTS): pivot, radius, rows, tiles, and the shelf that each lies on.

    ``at`` counts cells in the order of their shelves.  A shelf has up to ``shelf_rows`` rows, or is one larger cell, whose rows
    are dealt to as many ``parts`` as keep to that size.
    """

    def __init__(self, info: pd.DataFrame, pivots: np.ndarray, tile_rows: int):
        info = info.sort_values("cell")
        cell, rows = info["cell"].to_numpy(), info["n"].to_numpy()
        # small tables are spread over several shelves, for as many tasks
        self.shelf_rows = int(min(SHELF_ROWS, max(tile_rows, -(-rows.sum() // 8))))
        groups = _halves(pivots[cell], rows, np.arange(len(cell)), self.shelf_rows) if len(cell) else []
        order = np.concatenate(groups) if groups else np.zeros(0, int)
        self.cell, self.rows = cell[order], rows[order]
        self.radius = info["radius"].to_numpy()[order]
        self.subs = np.ceil(self.rows / tile_rows).astype(int)
        self.pivots = pivots[self.cell]
        self.first = np.cumsum([0] + [len(g) for g in groups])[:-1].astype(int)
        self.shelf = np.repeat(np.arange(len(groups)), [len(g) for g in groups])
        self.parts = np.array([max(1, -(-int(rows[g].sum()) // self.shelf_rows)) for g in groups], int)

    def gaps(self, x: np.ndarray, cells=slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """Safe lower and upper bounds of the distance from every row to every pivot."""
        pivots = self.pivots[cells]
        scale = (x**2).sum(1)[:, None] + (pivots**2).sum(1)[None, :]
        d2 = scale - 2.0 * (x @ pivots.T)
        slack = 1e-9 * (scale + 1.0)
        return np.sqrt(np.maximum(d2 - slack, 0.0)), np.sqrt(np.maximum(d2, 0.0) + slack)

    def needed(self, x: np.ndarray, limit: np.ndarray, cells=slice(None)) -> np.ndarray:
        """Whether a row's reach meets a cell, for every row and cell."""
        return self.gaps(x, cells)[0] - self.radius[cells][None, :] <= limit[:, None] + 1e-9


def _halves(x: np.ndarray, rows: np.ndarray, which: np.ndarray, most: int) -> list[np.ndarray]:
    """Cells in groups of up to ``most`` rows: halved along the widest axis until they fit."""
    if len(which) == 1 or rows[which].sum() <= most:
        return [which]
    axis = np.ptp(x[which], axis=0).argmax()
    which = which[np.argsort(x[which, axis], kind="stable")]
    total = np.cumsum(rows[which])
    middle = int(np.clip(np.searchsorted(total, total[-1] / 2) + 1, 1, len(which) - 1))
    return _halves(x, rows, which[:middle], most) + _halves(x, rows, which[middle:], most)


def _slices(pdf: pd.DataFrame, rows: int):
    return (pdf.iloc[i : i + rows] for i in range(0, len(pdf), rows))


def _place(src: DataFrame, n_pivots: int, tile_rows: int) -> tuple[DataFrame, _Layout]:
    """Assign rows to cells around pivots: ``id, v, at``."""
    # at most MAX_PIVOTS short vectors reach the driver, whatever the input size
    first = src.orderBy(F.xxhash64("id"), "id").limit(n_pivots).toPandas()["v"]
    pivots = _matrix(first) if len(first) else np.zeros((0, 1))

    def assign(batches):
        for batch in batches:
            for pdf in _slices(batch, _GAP_ROWS):
                x = _matrix(pdf["v"])
                cell = ((pivots**2).sum(1)[None, :] - 2 * x @ pivots.T).argmin(1)
                yield pdf.assign(cell=cell, r=np.sqrt(((x - pivots[cell]) ** 2).sum(1)))

    placed = cut(src.mapInPandas(assign, "id long, v array<double>, cell long, r double"))
    cells = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("r").alias("radius"))
    layout = _Layout(cells.toPandas(), pivots, tile_rows)  # one row per pivot
    place = np.full(len(pivots), -1)
    place[layout.cell] = np.arange(len(layout.cell))
    at = F.element_at(F.lit(place.tolist() or [-1]), F.col("cell").cast("int") + 1).cast("long")
    out = placed.select("id", "v", at.alias("at"))
    out._cut_path = placed._cut_path
    return out, layout


def _routed(queries: DataFrame, placed: DataFrame, layout: _Layout, k: int) -> DataFrame:
    """Every query ``(id, v, at, limit)`` meets the shelves that may hold one of its k nearest."""
    if not len(layout.cell):
        return queries.sparkSession.createDataFrame([], _EDGE)
    starts = np.cumsum(np.r_[0, layout.parts])[:-1]  # numbers of the parts of shelves

    def shelves(pdf):
        hit = layout.needed(_matrix(pdf["v"]), pdf["limit"].to_numpy())
        return np.nonzero(np.logical_or.reduceat(hit, layout.first, axis=1))

    def count(batches):
        total = np.zeros(len(layout.first), np.int64)
        for batch in batches:
            for pdf in _slices(batch, _GAP_ROWS):
                total += np.bincount(shelves(pdf)[1], minlength=len(total))
        yield pd.DataFrame({"shelf": np.arange(len(total)), "n": total})

    def route(batches):
        for batch in batches:
            for pdf in _slices(batch, _GAP_ROWS):
                qi, shelf = shelves(pdf)
                times = layout.parts[shelf]
                part = np.repeat(starts[shelf], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                qi, shelf = np.repeat(qi, times), np.repeat(shelf, times)
                for i in range(0, len(qi), _SENT_ROWS):
                    use = slice(i, i + _SENT_ROWS)
                    yield pdf.iloc[qi[use]].assign(shelf=shelf[use], part=part[use])

    # routes are counted first, without their vectors; one row per shelf
    load = queries.mapInPandas(count, "shelf long, n long").groupBy("shelf").agg(F.sum("n").alias("n"))
    load = cut(load.select("shelf", F.ceil(F.col("n") / layout.shelf_rows).alias("_chunks")))
    routed = queries.mapInPandas(route, _QUERY + ", shelf long, part long")
    asked = routed.join(load, "shelf").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("_chunks")))
    at = F.col("at").cast("int") + 1
    shelf = F.element_at(F.lit(layout.shelf.tolist()), at).cast("long")
    held = placed.withColumn("shelf", shelf)
    n_parts = F.element_at(F.lit(layout.parts.tolist()), F.col("shelf").cast("int") + 1)
    start = F.element_at(F.lit(starts.tolist()), F.col("shelf").cast("int") + 1)
    held = held.withColumn("part", (start + F.pmod(F.xxhash64("id"), n_parts)).cast("long")).join(load, "shelf")
    held = held.filter("_chunks > 0").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_chunks") - 1)))
    # fresh column identities for the second side of the cogroup
    held = held.select(*[F.col(c).alias(c) for c in ("id", "v", "at", "part", "chunk")])
    asked = asked.select("id", "v", "at", "limit", "part", "chunk")

    def across(q, c):
        if not len(q) or not len(c):
            return pd.DataFrame({"src": [], "dst": [], "d": []})
        q = q.sort_values("at")
        q_id, q_vec, limit = q["id"].to_numpy(), _matrix(q["v"]), q["limit"].to_numpy()
        held = _Candidates(c["id"].to_numpy(), _matrix(c["v"]))
        here, cell = np.unique(c["at"].to_numpy(), return_inverse=True)
        parts = []
        for i in range(0, len(q_id), BLOCK_ROWS):
            block = slice(i, i + BLOCK_ROWS)
            use = np.flatnonzero(layout.needed(q_vec[block], limit[block], here).any(0)[cell])
            if len(use):
                parts.append(_nearest(q_id[block], q_vec[block], held, use, k, limit[block]))
        return pd.concat(parts) if parts else pd.DataFrame({"src": [], "dst": [], "d": []})

    return asked.groupBy("part", "chunk").cogroup(held.groupBy("part", "chunk")).applyInPandas(across, _EDGE)


def nearest(
    queries: DataFrame,
    points: DataFrame,
    key: str,
    vector: str,
    k: int = 1,
    max_distance: float | None = None,
    tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """``(src, slot, dst, d)``: for every query the ``k`` nearest rows of another table, exactly.

    A query's reach starts at the smallest ``distance to a pivot + radius`` over cells that hold at
    least ``k`` rows, and at ``max_distance`` if given; only tiles within reach are visited.
    """
    cap = float("inf") if max_distance is None else float(max_distance)
    src = points.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    n_pivots = int(max(1, min(MAX_PIVOTS, -(-src.count() // tile_rows))))
    placed, layout = _place(src, n_pivots, tile_rows)
    full = layout.rows >= k + 1

    def reach(batches):
        for batch in batches:
            for pdf in _slices(batch, _GAP_ROWS):
                far = layout.gaps(_matrix(pdf["v"]))[1] + layout.radius[None, :]
                limit = far[:, full].min(1) if full.any() else np.full(len(pdf), np.inf)
                at = far.argmin(1) if far.shape[1] else 0
                yield pdf.assign(at=at, limit=np.minimum(limit, cap))

    # negative ids keep a query apart from a point of the same number
    asked = queries.select((-F.col(key).cast("long") - 1).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    asked = asked.mapInPandas(reach, _QUERY)
    found = _best(_routed(asked, placed, layout, k).filter(F.col("d") <= cap), k)
    return found.withColumn("src", -F.col("src") - 1)


def knn_cosine(points: DataFrame, key: str, vector: str, k: int, **kw) -> DataFrame:
    """Exact cosine neighbours: nearest by angle equals nearest on the unit sphere.

    ``d`` is the cosine distance ``1 - cos``.
    """
    from facetry.functions.vectors import normalise

    unit = points.select(key, normalise(F.col(vector)).alias(vector))
    near = knn(unit, key, vector, k, **kw)
    return near.withColumn("d", F.col("d") * F.col("d") / 2)
