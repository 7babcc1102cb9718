"""Near-duplicate vectors by sorted projection passes.

Only vectors with equal labels and lengths are compared.  Each pass gives a vector a code of random-hyperplane
signs and sorts all vectors by label and code prefix over the cluster; those with equal prefixes form a bucket, and
hyperplanes differ from pass to pass.  All vectors of a bucket are compared, however many they are: buckets are cut
into tiles of ``window`` rows, which meet pairwise.  Of the links a pair of tiles shows only those are reported that
unite what it had not yet united, so a dense group yields about one link per vector and tile.  The links of all
passes are united to components.

A hyperplane through the origin parts two vectors at the threshold with probability acos(``cosine``) / pi, whatever
other vectors there are.  So prefixes of b bits need a number of passes that follows from b alone for a link to be
missed by all of them with probability ``MISS`` at most.  Each label takes the b of least cost, by the sizes its
buckets have in the first pass; where codes crowd so much that no prefix pays, b is 0 and all pairs are compared once.

Every link lies inside a component.  The number of links of each vector is then counted exactly: components
are cut into tiles of bounded size, tiles meet pairwise as blocked matrix products, and only sums per vector
leave a task.  Equal vectors are one class with a count, so copies cost nothing.

Vectors that are null, empty, zero or hold null or non-finite components, and those without label or id, link
with nothing; they form components of their own (a null id has a null component and is kept).  Repeated rows
count as copies; rows that share an id are one node.  Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetry.operators.hops import components
from facetry.session import cut

COSINE = 0.98
#: Probability that all passes miss a link at the threshold.
MISS = 1e-4
WINDOW = 8192
#: Numbers in one side of a pair of tiles, where vectors are long.
SIDE = 1 << 22
BITS = 62
#: Lengths of prefixes to choose from.
PREFIXES = (0, 4, 6, 8, 10, 12, 14, 16, 18, 20, 24, 28)
#: What a pass costs for each vector, in comparisons.
ROW_COST = 2000
TILE = 512


def _planes(dimension: int, number: int) -> np.ndarray:
    return np.random.default_rng([dimension, number, 7]).standard_normal((dimension, BITS))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    # scaled first, so that squares of tiny or huge components neither vanish nor overflow
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def passes_needed(bits: int, cosine: float, miss: float = MISS) -> int:
    """Passes after which a link at the threshold was in no common bucket with probability ``miss`` at most."""
    together = (1 - np.arccos(np.clip(cosine, -1, 1)) / np.pi) ** bits
    return 1 if together >= 1 - miss else int(np.ceil(np.log(miss) / np.log1p(-together)))


def _plan(classes: DataFrame, cosine: float) -> DataFrame:
    """``(label, dim, bits, passes)``: the prefixes of least cost."""

    def run(batches):
        for pdf in batches:
            for d, part in pdf.groupby("dim"):
                bits = _unit(_matrix(part["v"])) @ _planes(int(d), 0) > 0
                code = bits @ (np.int64(1) << np.arange(BITS - 1, -1, -1))
                yield pd.DataFrame({"label": part["label"], "dim": d, "code": code})

    choice = F.explode(F.array(*[F.struct(F.lit(b).alias("bits"), F.lit(passes_needed(b, cosine)).alias("passes"), F.lit(2.0 ** (BITS - b)).alias("_width")) for b in PREFIXES]))
    rows = classes.select("label", "dim", "v").mapInPandas(run, "label long, dim int, code long").select("*", choice.alias("c"))
    rows = rows.select("label", "dim", "c.bits", "c.passes", F.floor(F.col("code") / F.col("c._width")).alias("_bucket"))
    sizes = rows.groupBy("label", "dim", "bits", "passes", "_bucket").agg(F.count("*").cast("double").alias("_n"))
    costs = sizes.groupBy("label", "dim", "bits", "passes").agg(F.sum(F.col("_n") * (F.col("_n") + ROW_COST)).alias("_s"))
    best = costs.groupBy("label", "dim").agg(F.min(F.struct(F.col("passes") * F.col("_s"), "bits", "passes")).alias("_best"))
    return best.select("label", "dim", "_best.bits", "_best.passes")


_BUCKET = ["pass", "label", "dim", "bucket"]


def _codes(vectors: DataFrame, whole: bool) -> DataFrame:
    """One row per vector and pass with its bucket, and with node and vector if ``whole``."""

    def run(batches):
        for pdf in batches:
            for (d, b, passes), part in pdf.groupby(["dim", "bits", "passes"]):
                x = _unit(_matrix(part["v"]))
                for p in range(passes):
                    bits = x @ _planes(int(d), p)[:, :b] > 0
                    bucket = bits @ (np.int64(1) << np.arange(b - 1, -1, -1, dtype=np.int64)) if b else np.zeros(len(x), np.int64)
                    out = pd.DataFrame({"pass": p, "label": part["label"].to_numpy(), "dim": d, "bucket": bucket})
                    yield out.assign(node=part["node"].to_numpy(), v=part["v"].to_numpy()) if whole else out

    schema = "pass int, label long, dim int, bucket long"
    vectors = vectors.select("label", "dim", "bits", "passes", "node", "v")
    return vectors.mapInPandas(run, f"{schema}, node long, v array<double>" if whole else schema)


def _forest(x: np.ndarray, ids: np.ndarray, first: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Links that unite rows of ``x``: those from ``first`` on against those before it; at 0, each against all before."""
    n = len(x)
    root = np.arange(n)
    left, right = [], []
    step = max(16, (1 << 21) // max(1, n))
    for at in range(first, n, step):
        high = min(n, at + step)
        end = first or high
        close = x[at:high] @ x[:end].T >= cosine
        close &= root[at:high, None] != root[None, :end]
        a, b = np.nonzero(close)
        a = a + at
        a, b = a[b < a], b[b < a]
        while len(a):
            ra, rb = root[a], root[b]
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            if not len(a):
                break
            # one link per root to be hung up, so that no cycle is reported
            high_root, low_root = np.maximum(ra, rb), np.minimum(ra, rb)
            _, once = np.unique(high_root, return_index=True)
            left.append(ids[a[once]])
            right.append(ids[b[once]])
            root[high_root[once]] = low_root[once]
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root = up
    none = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _pass_links(planned: DataFrame, window: int, cosine: float) -> DataFrame:
    """Links that unite the vectors ``(label, dim, bits, passes, node, v)`` of each bucket."""
    keys = [*_BUCKET, "ti", "tj"]

    def block(parts):
        g = pd.concat(parts)
        own = (g["tile"] == g["ti"]).to_numpy()
        g = g.iloc[np.argsort(~own, kind="stable")]
        first = int(own.sum()) if g["ti"].iloc[0] != g["tj"].iloc[0] else 0
        i, j = _forest(_unit(_matrix(g["v"])), g["node"].to_numpy(np.int64), first, cosine)
        return pd.DataFrame({"i": i, "j": j})

    def run(batches):
        held, name = [], None
        for pdf in batches:
            for key, g in pdf.groupby(keys, sort=False):
                if key != name and held:
                    yield block(held)
                    held = []
                name = key
                held.append(g)
        if held:
            yield block(held)

    # written before it is joined, so that both sides come straight from a shuffle and a large bucket can be split
    sizes = _codes(planned, whole=False).groupBy(*_BUCKET).agg(F.count("*").alias("_n")).filter(F.col("_n") > 1)
    sizes = cut(sizes.withColumn("_tiles", F.ceil(F.col("_n") / F.greatest(F.lit(1), F.least(F.lit(window), F.floor(SIDE / F.col("dim")))))).drop("_n"))
    rows = _codes(planned, whole=True).join(sizes, _BUCKET).withColumn("tile", F.pmod(F.xxhash64("node"), F.col("_tiles")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_tiles") - 1)))
    rows = rows.select(*_BUCKET, "node", "v", "tile", F.least("tile", "other").alias("ti"), F.greatest("tile", "other").alias("tj"))
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInPandas(run, "i long, j long").distinct()


def _count_links(members: DataFrame, cosine: float, tile: int) -> DataFrame:
    """``(node, n)``: for every class of ``(root, node, copies, v)`` how many vectors of other classes it links with."""
    sizes = members.groupBy("root").agg(F.ceil(F.count("*") / tile).cast("long").alias("_tiles"))
    rows = members.join(sizes, "root").withColumn("tile", F.pmod(F.xxhash64("node"), F.col("_tiles")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_tiles") - 1)))
    rows = rows.select(
        "root", "node", "copies", "v", "tile", F.least("tile", "other").alias("ti"), F.greatest("tile", "other").alias("tj")
    )

    def block(g: pd.DataFrame):
        x, copies, node = _unit(_matrix(g["v"])), g["copies"].to_numpy(), g["node"].to_numpy()
        side, ti, tj = g["tile"].to_numpy(), int(g["ti"].iloc[0]), int(g["tj"].iloc[0])
        a, b = np.flatnonzero(side == ti), np.flatnonzero(side == tj)
        close = x[a] @ x[b].T >= cosine
        if ti == tj:
            np.fill_diagonal(close, False)
        yield pd.DataFrame({"node": node[a], "n": close @ copies[b]})
        if ti != tj:
            yield pd.DataFrame({"node": node[b], "n": copies[a] @ close})

    def run(batches):
        held = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf])
            if not len(pdf):
                continue
            last = np.ones(len(pdf), bool)
            for c in ("root", "ti", "tj"):
                last &= (pdf[c] == pdf[c].iloc[-1]).to_numpy()
            held = pdf[last]
            for _, g in pdf[~last].groupby(["root", "ti", "tj"], sort=False):
                yield from block(g)
        if held is not None and len(held):
            yield from block(held)

    dealt = rows.repartition("root", "ti", "tj").sortWithinPartitions("root", "ti", "tj")
    return dealt.mapInPandas(run, "node long, n long").groupBy("node").agg(F.sum("n").alias("n"))


def near_vectors(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    cosine: float = COSINE,
    window: int = WINDOW,
    tile: int = TILE,
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row."""
    v = F.col(vector).cast("array<double>")
    sound = F.coalesce(
        (F.size(v) > 0)
        & F.forall(v, lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < float("inf")), F.lit(False)))
        & F.exists(v, lambda e: e != 0),
        F.lit(False),
    )
    rows = vectors.select(
        F.col(key).cast("long").alias("vec_id"),
        F.col(label).cast("long").alias("label"),
        # -0.0 and 0.0 are one value, also to the hash of a class
        F.when(sound, F.transform(v, lambda e: F.when(e == 0, F.lit(0.0)).otherwise(e))).alias("v"),
    ).withColumn("dim", F.size("v"))
    usable = rows.filter(F.col("v").isNotNull() & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    classes = usable.groupBy("label", "dim", "v").agg(
        F.min("vec_id").alias("node"), F.count_distinct("vec_id").alias("copies")
    )
    # of several vectors under one id one takes part
    one = classes.groupBy("node").agg(F.min(F.struct("label", "dim", "v", "copies")).alias("_one"))
    classes = cut(one.select("node", "_one.*"))
    planned = cut(classes.join(cut(_plan(classes, cosine)), ["label", "dim"]))
    links = cut(_pass_links(planned, window, cosine))
    nodes = links.select(F.col("i").alias("node")).unionByName(links.select(F.col("j").alias("node"))).distinct()
    found = cut(components(links, nodes).select("node", "root"))
    counted = cut(_count_links(classes.join(found, "node").select("root", "node", "copies", "v"), cosine, tile))
    result = classes.join(found, "node", "left").join(counted, "node", "left")
    result = result.select(
        "label",
        "dim",
        "v",
        F.coalesce("root", "node").alias("_root"),
        (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("_links"),
    )
    out = rows.join(result, ["label", "dim", "v"], "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("_root", "vec_id"))
    return out.select(
        "vec_id",
        F.when(F.col("vec_id").isNotNull(), F.coalesce("_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )
