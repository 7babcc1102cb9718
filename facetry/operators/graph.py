"""Weighted graphs as edge tables: kernels, symmetrising, Laplacians, filters, gather, pooling."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetry.functions.scalar import KERNEL_FLOOR
from facetry.functions.vectors import dist
from facetry.session import cut, forget


def feature_distances(
    edges: DataFrame, features: DataFrame, key: str, vector: str, group: list[str] | None = None
) -> DataFrame:
    """Attach the descriptor-space distance ``d`` to every ``(group, src, slot, dst)`` edge."""
    group = group or []
    a = features.select(*group, F.col(key).alias("src"), F.col(vector).alias("_a"))
    b = features.select(*group, F.col(key).alias("dst"), F.col(vector).alias("_b"))
    both = edges.join(a, [*group, "src"]).join(b, [*group, "dst"])
    return both.withColumn("d", dist(F.col("_a"), F.col("_b"))).drop("_a", "_b")


def gaussian_kernel(edges: DataFrame, group: list[str] | None = None) -> DataFrame:
    """``w = exp(-d^2 / sigma^2)``, sigma = mean distance to the last neighbour slot.

    A weight that underflows to 0 becomes a small floor; self edges are removed.
    """
    group = group or []
    last = edges.groupBy(*group, "src").agg(F.max_by("d", "slot").alias("_last"))
    sigma = last.groupBy(*group).agg(F.avg("_last").alias("_sigma"))
    rows = edges.join(sigma, group) if group else edges.withColumn("_sigma", sigma.scalar())
    spread = F.col("_sigma") * F.col("_sigma")
    # all points equal: no distance is far
    w = F.when(spread > 0, F.exp(-(F.col("d") * F.col("d")) / spread)).otherwise(1.0)
    rows = rows.withColumn("w", F.when(w == 0, KERNEL_FLOOR).otherwise(w)).drop("_sigma")
    return rows.filter(F.col("src") != F.col("dst"))


def symmetrise_max(edges: DataFrame, group: list[str] | None = None) -> DataFrame:
    """``W <- max(W, W^T)`` in one shuffle; parallel edges are added up first."""
    group = group or []
    fwd = edges.select(*group, F.col("src").alias("i"), F.col("dst").alias("j"), "w", F.lit(True).alias("_f"))
    rev = edges.select(*group, F.col("dst").alias("i"), F.col("src").alias("j"), "w", F.lit(False).alias("_f"))
    sums = fwd.unionByName(rev).groupBy(*group, "i", "j").agg(
        F.sum(F.when(F.col("_f"), F.col("w"))).alias("_a"), F.sum(F.when(~F.col("_f"), F.col("w"))).alias("_b")
    )
    return sums.select(*group, "i", "j", F.greatest("_a", "_b").alias("w"))


def degrees(edges: DataFrame, group: list[str] | None = None) -> DataFrame:
    return edges.groupBy(*(group or []), "i").agg(F.sum("w").alias("degree"))


def collapse(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Replace nodes by their cluster and add up parallel edges (``mapping(node, cluster)``)."""
    a = mapping.select(F.col("node").alias("i"), F.col("cluster").alias("ci"))
    b = mapping.select(F.col("node").alias("j"), F.col("cluster").alias("cj"))
    return edges.join(a, "i").join(b, "j").groupBy("ci", "cj").agg(F.sum("w").alias("w"))


def laplacian(edges: DataFrame, normalised: bool = True) -> DataFrame:
    """``I - D^-1/2 W D^-1/2`` or ``D - W`` as an edge table including the diagonal."""
    deg = degrees(edges)
    if not normalised:
        off = edges.select("i", "j", (-F.col("w")).alias("w"))
        return off.unionByName(deg.select("i", F.col("i").alias("j"), F.col("degree").alias("w")))
    di = deg.select("i", F.col("degree").alias("_di"))
    dj = deg.select(F.col("i").alias("j"), F.col("degree").alias("_dj"))
    scaled = edges.join(di, "i").join(dj, "j")
    off = scaled.select("i", "j", (-F.col("w") / F.sqrt(F.col("_di") * F.col("_dj"))).alias("w"))
    return off.unionByName(deg.select("i", F.col("i").alias("j"), F.lit(1.0).alias("w")))


def rescale_laplacian(lap: DataFrame, lmax: float = 2.0) -> DataFrame:
    """``2 L / lmax - I``: shifts the spectrum to [-1, 1]."""
    diag = F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0)
    return lap.withColumn("w", F.col("w") * (2.0 / lmax) - diag)


def multiply(matrix: DataFrame, signal: DataFrame, value: str = "x", out: str = "x") -> DataFrame:
    """Sparse matrix times vector: one join and one map-side-combined sum."""
    x = signal.select(F.col("node").alias("j"), F.col(value).alias("_x"))
    prod = matrix.join(x, "j").groupBy("i").agg(F.sum(F.col("w") * F.col("_x")).alias(out))
    return prod.withColumnRenamed("i", "node")


def chebyshev(lap: DataFrame, signal: DataFrame, order: int) -> DataFrame:
    """``T_0 .. T_{order-1}`` applied to ``signal(node, x)``: ``T_k = 2 L T_{k-1} - T_{k-2}``.

    The matrix and every order are written once, so the plan of an order does not contain the ones before.
    """
    lap, out = cut(lap), signal.select("node", F.col("x").alias("t0"))
    for k in range(1, order):
        step = multiply(lap, out, f"t{k - 1}", "_p")
        prev = F.coalesce("_p", F.lit(0.0))
        new = prev if k == 1 else 2 * prev - F.col(f"t{k - 2}")
        last, out = out, cut(out.join(step, "node", "left").withColumn(f"t{k}", new).drop("_p"))
        forget(last)
    forget(lap)
    return out


def largest_eigenvalue(matrix: DataFrame, tolerance: float = 1e-9) -> float:
    """Power iteration until the Rayleigh quotient settles to ``tolerance``, relative.

    Only two sums of each iterate reach the driver.  Meant for symmetric matrices without negative eigenvalue of
    largest size, such as Laplacians.
    """
    matrix = cut(matrix)
    x = matrix.select(F.col("i").alias("node")).distinct()
    x = cut(x.withColumn("x", (F.pmod(F.xxhash64("node"), F.lit(1000)) + 1) / 1000.0))
    value = None
    while True:
        y = cut(x.join(multiply(matrix, x, out="y"), "node", "left").withColumn("y", F.coalesce("y", F.lit(0.0))))
        sums = y.agg(*[F.sum(F.col(a) * F.col(b)) for a, b in (("x", "x"), ("x", "y"), ("y", "y"))]).first()
        forget(x)
        if not sums[0] or not sums[2]:
            return 0.0
        last, value = value, sums[1] / sums[0]
        if last is not None and abs(value - last) <= tolerance * abs(value):
            forget(matrix, y)
            return value
        x = cut(y.select("node", (F.col("y") / F.lit(math.sqrt(sums[2]))).alias("x")))
        forget(y)


def gather(nbrs: DataFrame, features: DataFrame, key: str, value: str) -> DataFrame:
    """``(node, slot, value)``: the row's own value at slot 0, its neighbours' values behind it.

    Absent neighbours are missing rows, not sentinels.
    """
    own = features.select(F.col(key).alias("node"), F.lit(0).alias("slot"), F.col(value).alias("value"))
    f = features.select(F.col(key).alias("dst"), F.col(value).alias("value"))
    others = nbrs.join(f, "dst").select(F.col("src").alias("node"), F.col("slot").cast("int"), "value")
    return own.unionByName(others)


def gather_gradient(gathered: DataFrame) -> DataFrame:
    """Back-propagation of :func:`gather`: only the centre column's gradient passes."""
    return gathered.filter(F.col("slot") == 0)


def gather_rows(gathered: DataFrame) -> DataFrame:
    """One row per node with the values in slot order (at most k + 1 per node)."""
    pair = F.struct("slot", "value")
    rows = gathered.groupBy("node").agg(F.array_sort(F.collect_list(pair)).alias("_s"))
    return rows.select("node", F.transform("_s", lambda s: s["value"]).alias("values"))


def slot_convolution(gathered: DataFrame, kernel: list[float], bias: float = 0.0) -> DataFrame:
    """Fixed-width dot product along the slot axis of scalar gathered values."""
    weight = F.element_at(F.array(*[F.lit(float(k)) for k in kernel]), F.col("slot") + 1)
    used = gathered.filter(F.col("slot") < len(kernel))
    return used.groupBy("node").agg((F.sum(F.col("value") * weight) + bias).alias("value"))


def max_pool(rows: DataFrame, pos: str, vector: str, width: int = 4) -> DataFrame:
    """Component-wise maximum of every ``width`` consecutive positions."""
    stacked = rows.groupBy(F.floor(F.col(pos) / width).alias("pos")).agg(F.collect_list(vector).alias("_m"))
    best = F.aggregate(
        F.slice(F.col("_m"), 2, width),
        F.element_at("_m", 1),
        lambda acc, v: F.zip_with(acc, v, lambda a, b: F.greatest(a, b)),
    )
    return stacked.select("pos", best.alias(vector))


def grid_edges(height: int, width: int, spark) -> DataFrame:
    """4-connected neighbours of a grid, both directions, ids in row-major order."""
    cell = spark.range(height * width).select(
        F.col("id").alias("i"), F.floor(F.col("id") / width).alias("_r"), (F.col("id") % width).alias("_c")
    )
    moves = F.array(
        F.when(F.col("_c") + 1 < width, F.col("i") + 1),
        F.when(F.col("_c") > 0, F.col("i") - 1),
        F.when(F.col("_r") + 1 < height, F.col("i") + width),
        F.when(F.col("_r") > 0, F.col("i") - width),
    )
    return cell.select("i", F.explode(F.array_compact(moves)).alias("j"))


def rewire(edges: DataFrame, nodes: DataFrame, share: float, seed: int) -> DataFrame:
    """Replace a pseudo-random share of undirected edges (``i < j``) by random ones, reproducibly.

    The new end points are picked by dense node number, so ``nodes(node, pos)`` must be indexed.
    """
    roll = F.pmod(F.xxhash64("i", "j", F.lit(seed)), F.lit(1_000_000)) / 1e6
    half = edges.filter(F.col("i") < F.col("j")).withColumn("_swap", roll < share)
    kept = half.filter(~F.col("_swap")).select("i", "j", "w")
    n = nodes.agg(F.count(F.lit(1))).scalar()
    moved = half.filter("_swap").withColumn("_n", n)
    picks = moved.select(
        F.pmod(F.xxhash64("i", "j", F.lit(seed + 1)), F.col("_n")).alias("_a"),
        F.pmod(F.xxhash64("i", "j", F.lit(seed + 2)), F.col("_n")).alias("_b"),
        "w",
    )
    a = nodes.select(F.col("pos").alias("_a"), F.col("node").alias("_x"))
    b = nodes.select(F.col("pos").alias("_b"), F.col("node").alias("_y"))
    fresh = picks.join(a, "_a").join(b, "_b").filter("_x <> _y")
    fresh = fresh.select(F.least("_x", "_y").alias("i"), F.greatest("_x", "_y").alias("j"), "w")
    one = kept.unionByName(fresh).groupBy("i", "j").agg(F.max("w").alias("w"))
    return one.unionByName(one.select(F.col("j").alias("i"), F.col("i").alias("j"), "w"))


def boundary_fraction(edges: DataFrame, labels: DataFrame, slots: Column | None = None) -> DataFrame:
    """Share of directed edges that join two different labels (``labels(node, label)``)."""
    a = labels.select(F.col("node").alias("i"), F.col("label").alias("_a"))
    b = labels.select(F.col("node").alias("j"), F.col("label").alias("_b"))
    differs = (F.col("_a") != F.col("_b")).cast("double")
    return edges.join(a, "i").join(b, "j").agg(F.avg(differs).alias("fraction"))
