"""Smallest enclosing balls of point clouds of any size.

The ball is fixed by at most four points.  Every task folds its rows, chunk by chunk, into the support of the ball around them;
the supports of a group, a few points per task, are folded once more.  Points outside the result are folded with its support
in a further round.  Radii only grow, so the rounds end, and then the ball of a few points holds all.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetry.session import cut, forget

#: Relative slack of "inside".
INSIDE = 1e-9
#: Rows folded at once.
CHUNK = 8192


def circumsphere(points: np.ndarray) -> tuple[np.ndarray, float] | None:
    """Centre in the points' own affine hull, and squared radius; None if the points are degenerate."""
    side = points[1:] - points[0]
    gram = side @ side.T
    if len(side) and np.linalg.det(gram) <= 1e-18 * max(1e-300, np.prod(np.diag(gram))):
        return None
    step = np.linalg.solve(gram, np.diag(gram) / 2) @ side if len(side) else np.zeros(points.shape[1])
    return points[0] + step, float(step @ step)


def few_points(points: np.ndarray) -> np.ndarray:
    """Rows of the support of the smallest ball around a handful of points, by trying every support set."""
    best, found = np.inf, [0]
    for size in range(1, min(4, len(points)) + 1):
        for rows in combinations(range(len(points)), size):
            ball = circumsphere(points[list(rows)])
            if ball is None or ball[1] >= best:
                continue
            gap = ((points - ball[0]) ** 2).sum(1)
            if (gap <= ball[1] * (1 + INSIDE) + 1e-300).all():
                best, found = ball[1], list(rows)
    return points[found]


def support(points: np.ndarray) -> np.ndarray:
    """Support of the smallest ball around any number of points: the farthest point outside joins until none is left."""
    now = points[:1]
    radius = -1.0
    while True:
        centre, square = circumsphere(now)
        gap = ((points - centre) ** 2).sum(1)
        far = int(gap.argmax())
        if gap[far] <= square * (1 + INSIDE) or square <= radius:
            return now
        radius = square
        now = few_points(np.concatenate([now, points[far : far + 1]]))


def bounding_spheres(points: DataFrame, group: list[str]) -> DataFrame:
    """``(group, cx, cy, cz, r)``: the smallest ball around the points ``(group, x, y, z)`` of each group.

    Rows with a null or non-finite coordinate take no part; equal points count once.
    """
    finite = [F.col(c).isNotNull() & ~F.isnan(F.col(c)) & (F.abs(F.col(c)) < float("inf")) for c in "xyz"]
    rows = points.select(*group, *[F.col(c).cast("double").alias(c) for c in "xyz"]).filter(finite[0] & finite[1] & finite[2])
    names = rows.columns
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)

    def fold(batches):
        """Supports of the groups of a partition; a group's support stands for its earlier rows."""
        held: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            for begin in range(0, len(pdf), CHUNK):
                part = pdf.iloc[begin : begin + CHUNK]
                for key, g in part.groupby(group, dropna=False) if group else [((), part)]:
                    x = g[["x", "y", "z"]].to_numpy(float)
                    if key in held:
                        x = np.concatenate([held[key], x])
                    held[key] = support(x)
        for key, x in held.items():
            yield pd.DataFrame([(*key, *p) for p in x.tolist()], columns=names)

    def ball(key, pdf):
        centre, square = circumsphere(support(pdf[["x", "y", "z"]].to_numpy(float)))
        return pd.DataFrame([(*key, *centre, float(np.sqrt(square)))], columns=[*group, "cx", "cy", "cz", "r"])

    frame = ", ".join([*[f"{n} {t}" for n, t in rows.select(*group).dtypes], "cx double, cy double, cz double, r double"])
    # sorting lets a partition fold one group after the other; only a few points per task and group leave it
    candidates = cut(rows.mapInPandas(fold, kinds))
    while True:
        balls = cut(candidates.groupBy(*group).applyInPandas(ball, frame))
        same = F.lit(True)
        other = balls.select(*[F.col(c).alias(f"_{c}") for c in group], "cx", "cy", "cz", "r")
        for c in group:
            same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
        gap = sum(((F.col(c) - F.col(f"c{c}")) ** 2 for c in "xyz"), F.lit(0.0))
        outside = rows.join(other, same).filter(gap > F.col("r") ** 2 * (1 + 4 * INSIDE)).select(names)
        more = cut(outside.mapInPandas(fold, kinds))
        if more.isEmpty():
            forget(candidates, more)
            return balls
        forget(balls)
        candidates, old = cut(candidates.unionByName(more)), (candidates, more)
        forget(*old)
