"""Queries over the neighbour graph of the embeddings table."""

from __future__ import annotations

from pyspark.sql import functions as F

from facetry.functions import vectors as V
from facetry.operators import graph, neighbours, votes
from facetry.plans.registry import query
from facetry.session import cut

R, col = F.round, F.col

KNN = """kn AS (SELECT src, dst, d, row_number() OVER (PARTITION BY src ORDER BY d, dst) AS slot FROM (
           SELECT a.vec_id AS src, b.vec_id AS dst,
                  list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d
           FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) QUALIFY slot <= 3)"""
KERNEL = KNN + """, sg AS (SELECT avg(d) AS s FROM kn WHERE slot = 3),
       ke AS (SELECT src, dst, CASE WHEN exp(-d * d / (s * s)) = 0 THEN 1e-5 ELSE exp(-d * d / (s * s)) END AS w
              FROM kn, sg)"""
SYM = KERNEL + """, sy AS (SELECT i, j, max(w) AS w FROM (SELECT src AS i, dst AS j, w FROM ke
              UNION ALL SELECT dst AS i, src AS j, w FROM ke) GROUP BY ALL)"""
LAP = SYM + """, dg AS (SELECT i, sum(w) AS degree FROM sy GROUP BY ALL),
       la AS (SELECT sy.i, sy.j, -w / sqrt(a.degree * b.degree) AS w FROM sy JOIN dg a ON a.i = sy.i
              JOIN dg b ON b.i = sy.j UNION ALL SELECT i, i AS j, 1.0 AS w FROM dg)"""


def knn3(t):
    return neighbours.knn(t.embeddings, "vec_id", "embedding", 3, tile_rows=128)


def kernel3(t):
    return graph.gaussian_kernel(knn3(t))


def sym3(t):
    """Several consumers read this graph, so it is written out once instead of searched again."""
    return cut(graph.symmetrise_max(kernel3(t)))


@query("knn_graph", f"WITH {KNN} SELECT src, slot::INT AS slot, dst, round(d, 6) AS d FROM kn")
def knn_graph(t):
    return knn3(t).withColumn("d", R("d", 6))


@query(
    "knn_cosine",
    """WITH kn AS (SELECT src, dst, d, row_number() OVER (PARTITION BY src ORDER BY d, dst) AS slot FROM (
           SELECT a.vec_id AS src, b.vec_id AS dst,
                  list_cosine_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d
           FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) QUALIFY slot <= 2)
       SELECT src, slot::INT AS slot, dst, round(d, 6) AS d FROM kn""",
)
def knn_cosine(t):
    return neighbours.knn_cosine(t.embeddings, "vec_id", "embedding", 2, tile_rows=128).withColumn("d", R("d", 6))


@query(
    "knn_label_vote",
    f"""WITH {KNN}, c AS (SELECT src, label, count(*) AS votes FROM kn JOIN embeddings ON dst = vec_id GROUP BY ALL),
        v AS (SELECT src, label AS vote FROM c
              QUALIFY row_number() OVER (PARTITION BY src ORDER BY votes DESC, label) = 1)
        SELECT label, count(*) AS n, sum((vote = label)::INT)::DOUBLE AS hits, round(avg((vote = label)::INT), 6) AS accuracy
        FROM v JOIN embeddings ON src = vec_id GROUP BY ALL""",
)
def knn_label_vote(t):
    """Flagship: neighbour graph, majority vote of the neighbours' labels, accuracy per true label."""
    truth = t.embeddings.select("vec_id", "label")
    ballots = knn3(t).join(truth.withColumnRenamed("vec_id", "dst"), "dst")
    vote = votes.majority(ballots.select("src", "label"), ["src"], "label")
    scored = vote.select(col("src").alias("vec_id"), "vote").join(truth, "vec_id")
    one = F.lit(1.0)
    return scored.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"),
        votes.weighted_accuracy(col("vote"), col("label"), one).alias("hits"),
        R(votes.weighted_accuracy(col("vote"), col("label"), one, normalise=True), 6).alias("accuracy"),
    )


@query("gaussian_adjacency", f"WITH {KERNEL} SELECT src, dst, round(w, 6) AS w FROM ke")
def gaussian_adjacency(t):
    return kernel3(t).select("src", "dst", R("w", 6).alias("w"))


@query(
    "feature_distance_edges",
    """WITH e AS (SELECT vec_id AS src, vec_id + k AS dst FROM embeddings CROSS JOIN range(1, 4) r(k)
                  WHERE vec_id + k < (SELECT count(*) FROM embeddings))
       SELECT src, dst, round(list_distance(a.embedding[1:16]::DOUBLE[], b.embedding[1:16]::DOUBLE[]), 6) AS d
       FROM e JOIN embeddings a ON src = a.vec_id JOIN embeddings b ON dst = b.vec_id""",
)
def feature_distance_edges(t):
    """Distances between given neighbours in a descriptor block, without any neighbour search."""
    slots = F.explode(F.array(*[F.lit(i) for i in (1, 2, 3)])).alias("slot")
    edges = t.embeddings.select(col("vec_id").alias("src"), slots).withColumn("dst", col("src") + col("slot"))
    feats = t.embeddings.select("vec_id", V.block(col("embedding"), 0, 16).alias("f"))
    return graph.feature_distances(edges, feats, "vec_id", "f").select("src", "dst", R("d", 6).alias("d"))


@query("symmetrise_max", f"WITH {SYM} SELECT i, j, round(w, 6) AS w FROM sy")
def symmetrise_max(t):
    return sym3(t).withColumn("w", R("w", 6))


@query("degree", f"WITH {LAP} SELECT i, round(degree, 6) AS degree FROM dg")
def degree(t):
    return graph.degrees(sym3(t)).withColumn("degree", R("degree", 6))


@query("laplacian_normalised", f"WITH {LAP} SELECT i, j, round(w, 6) AS w FROM la")
def laplacian_normalised(t):
    return graph.laplacian(sym3(t)).withColumn("w", R("w", 6))


@query(
    "laplacian_plain",
    f"""WITH {LAP} SELECT i, j, round(-w, 6) AS w FROM sy
        UNION ALL SELECT i, i AS j, round(degree, 6) AS w FROM dg""",
)
def laplacian_plain(t):
    return graph.laplacian(sym3(t), normalised=False).withColumn("w", R("w", 6))


@query(
    "chebyshev_k3",
    f"""WITH {LAP}, lr AS (SELECT i, j, w - CASE WHEN i = j THEN 1.0 ELSE 0.0 END AS w FROM la),
        x0 AS (SELECT vec_id AS node, embedding[1]::DOUBLE AS t0 FROM embeddings),
        x1 AS (SELECT i AS node, sum(w * t0) AS t1 FROM lr JOIN x0 ON j = node GROUP BY ALL),
        x2 AS (SELECT i AS node, 2 * sum(w * t1) AS p FROM lr JOIN x1 ON j = node GROUP BY ALL)
        SELECT node, round(t0, 6) AS t0, round(t1, 6) AS t1, round(p - t0, 6) AS t2
        FROM x0 JOIN x1 USING (node) JOIN x2 USING (node)""",
)
def chebyshev_k3(t):
    lap = graph.rescale_laplacian(graph.laplacian(sym3(t)))
    signal = t.embeddings.select(col("vec_id").alias("node"), col("embedding")[0].cast("double").alias("x"))
    out = graph.chebyshev(lap, signal, 3)
    return out.select("node", *[R(c, 6).alias(c) for c in ("t0", "t1", "t2")])


@query(
    "neighbour_gather",
    f"""WITH {KNN}, g AS (SELECT vec_id AS node, 0 AS slot, embedding FROM embeddings
          UNION ALL SELECT src, slot, embedding FROM kn JOIN embeddings ON dst = vec_id),
          u AS (SELECT node, slot, unnest(range(64)) AS dim, embedding FROM g)
        SELECT node, slot::INT AS slot, dim::INT AS dim, round(embedding[dim + 1]::DOUBLE, 6) AS value FROM u""",
)
def neighbour_gather(t):
    feats = t.embeddings.select("vec_id", V.as_double(col("embedding")).alias("f"))
    g = graph.gather(knn3(t), feats, "vec_id", "f")
    out = g.select("node", "slot", F.posexplode("value").alias("dim", "value"))
    return out.withColumn("value", R("value", 6))


@query(
    "gather_gradient",
    """SELECT vec_id AS node, round(embedding[1]::DOUBLE, 6) AS value FROM embeddings""",
)
def gather_gradient(t):
    feats = t.embeddings.select("vec_id", col("embedding")[0].cast("double").alias("f"))
    g = graph.gather_gradient(graph.gather(knn3(t), feats, "vec_id", "f"))
    return g.select("node", R("value", 6).alias("value"))


@query(
    "neighbour_mean",
    f"""WITH {KNN}, g AS (SELECT vec_id AS node, embedding::DOUBLE[] AS v FROM embeddings
          UNION ALL SELECT src, embedding::DOUBLE[] FROM kn JOIN embeddings ON dst = vec_id),
          u AS (SELECT node, unnest(range(64)) AS dim, unnest(v) AS v FROM g)
        SELECT node, dim::INT AS dim, round(avg(v), 6) AS value FROM u GROUP BY ALL""",
)
def neighbour_mean(t):
    feats = t.embeddings.select("vec_id", V.as_double(col("embedding")).alias("f"))
    g = graph.gather(knn3(t), feats, "vec_id", "f").select("node", F.posexplode("value").alias("dim", "value"))
    return g.groupBy("node", "dim").agg(R(F.avg("value"), 6).alias("value"))


@query(
    "slot_convolution",
    f"""WITH {KNN}, g AS (SELECT vec_id AS node, 0 AS slot, embedding[1]::DOUBLE AS v FROM embeddings
          UNION ALL SELECT src, slot, embedding[1]::DOUBLE FROM kn JOIN embeddings ON dst = vec_id)
        SELECT node, round(sum(v * [0.5, 0.25, 0.15, 0.1][slot + 1]) + 1, 6) AS value FROM g GROUP BY ALL""",
)
def slot_convolution(t):
    feats = t.embeddings.select("vec_id", col("embedding")[0].cast("double").alias("f"))
    g = graph.gather(knn3(t), feats, "vec_id", "f")
    return graph.slot_convolution(g, [0.5, 0.25, 0.15, 0.1], 1.0).withColumn("value", R("value", 6))


@query(
    "max_pool4",
    """WITH u AS (SELECT vec_id // 4 AS pos, unnest(range(0, 64)) AS dim, embedding FROM embeddings)
       SELECT pos, dim::INT AS dim, round(max(embedding[dim + 1]::DOUBLE), 6) AS value FROM u GROUP BY ALL""",
)
def max_pool4(t):
    df = t.embeddings.select("vec_id", V.as_double(col("embedding")).alias("f"))
    out = graph.max_pool(df, "vec_id", "f").select("pos", F.posexplode("f").alias("dim", "value"))
    return out.withColumn("value", R("value", 6))


@query(
    "graph_boundary_fraction",
    f"""WITH {KNN} SELECT round(avg((a.label <> b.label)::INT), 6) AS fraction
        FROM kn JOIN embeddings a ON src = a.vec_id JOIN embeddings b ON dst = b.vec_id""",
)
def graph_boundary_fraction(t):
    labels = t.embeddings.select(col("vec_id").alias("node"), "label")
    edges = knn3(t).select(col("src").alias("i"), col("dst").alias("j"))
    return graph.boundary_fraction(edges, labels).select(R("fraction", 6).alias("fraction"))


@query(
    "feature_block_slice",
    """WITH s AS (SELECT vec_id, list_concat(embedding[1:16], embedding[33:48]) AS f FROM embeddings),
            u AS (SELECT vec_id, unnest(range(0, 32)) AS dim, f FROM s)
       SELECT vec_id, dim::INT AS dim, round(f[dim + 1]::DOUBLE, 6) AS value FROM u""",
)
def feature_block_slice(t):
    f = F.concat(V.block(col("embedding"), 0, 16), V.block(col("embedding"), 32, 16))
    out = t.embeddings.select("vec_id", F.posexplode(V.as_double(f)).alias("dim", "value"))
    return out.withColumn("value", R("value", 6))


@query(
    "vector_ops",
    """WITH p AS (SELECT a.vec_id, a.embedding::DOUBLE[] AS a, b.embedding::DOUBLE[] AS b
                  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
       SELECT vec_id, round(list_inner_product(a, b), 6) AS dot, round(sqrt(list_inner_product(a, a)), 6) AS norm,
              round(list_distance(a, b), 6) AS dist, round(list_cosine_similarity(a, b), 6) AS cosine,
              round(a[2] * b[3] - a[3] * b[2], 6) AS cx, round(a[3] * b[1] - a[1] * b[3], 6) AS cy,
              round(a[1] * b[2] - a[2] * b[1], 6) AS cz,
              round(degrees(atan2(sqrt((a[2] * b[3] - a[3] * b[2])^2 + (a[3] * b[1] - a[1] * b[3])^2
                + (a[1] * b[2] - a[2] * b[1])^2), a[1] * b[1] + a[2] * b[2] + a[3] * b[3])), 5) AS angle FROM p""",
)
def vector_ops(t):
    a = t.embeddings.select("vec_id", V.as_double(col("embedding")).alias("a"))
    b = a.select((col("vec_id") - 1).alias("vec_id"), col("a").alias("b"))
    p = a.join(b, "vec_id")
    a3, b3 = [tuple(col(c)[i] for i in range(3)) for c in "ab"]
    cx, cy, cz = V.cross3(a3, b3)
    a, b = col("a"), col("b")
    return p.select(
        "vec_id",
        R(V.dot(a, b), 6).alias("dot"),
        R(V.norm(a), 6).alias("norm"),
        R(V.dist(a, b), 6).alias("dist"),
        R(V.cosine(a, b), 6).alias("cosine"),
        R(cx, 6).alias("cx"),
        R(cy, 6).alias("cy"),
        R(cz, 6).alias("cz"),
        R(V.angle_degrees3(a3, b3), 5).alias("angle"),
    )


CENTROID = """ce AS (SELECT label AS class, list(m ORDER BY dim) AS c FROM (
          SELECT label, dim, avg(embedding[dim + 1]::DOUBLE) AS m
          FROM (SELECT label, embedding, unnest(range(0, 64)) AS dim FROM embeddings) GROUP BY ALL) GROUP BY ALL),
       sc AS (SELECT vec_id, label, class, -list_distance(embedding::DOUBLE[], c) AS score FROM embeddings CROSS JOIN ce)"""


def class_scores(t):
    """Score of every class at every vector: minus the distance to the class centroid.

    The centroids (one short vector per class) enter as a scalar value, not as a join.
    """
    long = t.embeddings.select("label", F.posexplode(V.as_double(col("embedding"))).alias("dim", "x"))
    mean = long.groupBy("label", "dim").agg(F.avg("x").alias("m"))
    centre = mean.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("dim", "m"))).alias("p"))
    centre = centre.select(F.struct(col("label").alias("class"), F.transform("p", lambda s: s["m"]).alias("c")).alias("s"))
    table = centre.agg(F.array_sort(F.collect_list("s"))).scalar()
    rows = t.embeddings.withColumn("_all", table).select("vec_id", "label", "embedding", F.inline("_all"))
    score = -V.dist(col("embedding"), col("c"))
    return rows.select("vec_id", "label", "class", score.alias("score"))


@query(
    "topk_accuracy",
    f"""WITH {CENTROID}, r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, class DESC) AS rn
                               FROM sc),
        h AS (SELECT vec_id, label, max((rn <= 2 AND class = label)::INT) AS direct,
                     max((rn = 2 AND class = label)::INT) AS second, max((rn = 3 AND class = label)::INT) AS third,
                     max((rn = 1 AND class = 0)::INT) AS z1, max((rn = 2 AND class = 0)::INT) AS z2
              FROM r WHERE label <> 0 GROUP BY ALL)
        SELECT label, round(avg(direct), 6) AS accuracy,
               sum((direct + z1 * second + z2 * third) * (1 + vec_id % 3))::DOUBLE AS area
        FROM h GROUP BY ALL""",
)
def topk_accuracy(t):
    scores = class_scores(t).filter(col("label") != 0)
    best = votes.ranked_scores(scores, ["vec_id", "label"], "score", "class", 3)
    best = best.withColumn("area", (1 + col("vec_id") % 3).cast("double"))
    return votes.top_k_accuracy(best, "label", "area", 2).withColumn("accuracy", R("accuracy", 6))


@query(
    "argmax_skip_zero",
    f"""WITH {CENTROID} SELECT vec_id, class AS pred FROM sc WHERE class > 0
        QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, class) = 1""",
)
def argmax_skip_zero(t):
    return votes.argmax_skip_zero(class_scores(t), ["vec_id"], "score", "class")


@query(
    "softmax_rows",
    f"""WITH {CENTROID}, s AS (SELECT vec_id, class, 1 / (1 + exp(-score)) AS p FROM sc)
        SELECT vec_id, class, round(p / sum(p) OVER (PARTITION BY vec_id), 6) AS p FROM s""",
)
def softmax_rows(t):
    from facetry.functions.scalar import sigmoid
    from facetry.operators.stats import with_group_stats

    s = class_scores(t).select("vec_id", "class", sigmoid(col("score")).alias("p"))
    s = with_group_stats(s, ["vec_id"], _sum=F.sum("p"))
    return s.select("vec_id", "class", R(col("p") / col("_sum"), 6).alias("p"))
