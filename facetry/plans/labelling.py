"""Queries for traversal, coarsening and labelling over the embeddings graph and the event chains."""

from __future__ import annotations

from pyspark.sql import functions as F

from facetry.operators import coarsen, energy, graph, hops, votes
from facetry.operators.ordered import running
from facetry.plans.graphs import CENTROID, SYM, class_scores, sym3
from facetry.plans.registry import query
from facetry.session import cut

R, col = F.round, F.col

# ------------------------------------------------------------------ traversal


@query(
    "hop_distance_recursive",
    f"""WITH RECURSIVE {SYM}, walk AS (SELECT vec_id AS src, vec_id AS node, 0 AS d FROM embeddings
          UNION SELECT src, j, d + 1 FROM walk JOIN sy ON i = node WHERE d < 3)
        SELECT src, node, min(d)::DOUBLE AS d FROM walk GROUP BY ALL""",
)
def hop_distance_recursive(t):
    edges = sym3(t).withColumn("w", F.lit(1.0))
    return hops.bounded_distances(edges, t.embeddings.select(col("vec_id").alias("src")), 2.0)


@query(
    "hop_neighbours",
    f"""WITH RECURSIVE {SYM}, fan AS (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY j) AS s FROM sy),
        walk AS (SELECT vec_id AS src, vec_id AS node, 0 AS n, []::BIGINT[] AS p FROM embeddings
          UNION ALL SELECT src, j, n + 1, list_append(p, s) FROM walk JOIN fan ON i = node WHERE n < 3),
        fst AS (SELECT src, node, min(n) AS n FROM walk GROUP BY ALL),
        o AS (SELECT walk.src, walk.node, walk.n, min(p) AS p FROM walk JOIN fst USING (src, node, n)
              WHERE src <> node GROUP BY ALL),
        b AS (SELECT src, node, row_number() OVER (PARTITION BY src ORDER BY n, p) AS o FROM o)
        SELECT src, node AS dst, row_number() OVER (PARTITION BY src ORDER BY coalesce(w, 0) DESC, b.o)::INT AS slot,
               round(coalesce(w, 0), 6) AS w
        FROM b LEFT JOIN sy ON sy.i = src AND sy.j = node WHERE b.o <= 5""",
)
def hop_neighbours(t):
    return hops.hop_neighbours(sym3(t), 5).withColumn("w", R("w", 6))


@query(
    "connected_components",
    f"""WITH RECURSIVE {SYM}, reach AS (SELECT vec_id AS node, vec_id AS root FROM embeddings
          UNION SELECT j, root FROM reach JOIN sy ON i = node)
        SELECT node, min(root) AS root FROM reach GROUP BY ALL""",
)
def connected_components(t):
    return hops.components(sym3(t), t.embeddings.select(col("vec_id").alias("node")))


# ------------------------------------------------------------------ coarsening and tree order


@query(
    "edge_collapse_sum",
    f"""WITH {SYM} SELECT a.label AS ci, b.label AS cj, round(sum(w), 4) AS w FROM sy
        JOIN embeddings a ON i = a.vec_id JOIN embeddings b ON j = b.vec_id GROUP BY ALL""",
)
def edge_collapse_sum(t):
    mapping = t.embeddings.select(col("vec_id").alias("node"), col("label").alias("cluster"))
    return graph.collapse(sym3(t), mapping).withColumn("w", R("w", 4))


@query("coarsen_matching")
def coarsen_matching(t):
    nodes = t.embeddings.select(col("vec_id").alias("node"))
    _, parents = coarsen.coarsen(sym3(t), nodes, 1)
    return parents[0]


@query("tree_permutation")
def tree_permutation(t):
    nodes = t.embeddings.select(col("vec_id").alias("node"))
    _, parents = coarsen.coarsen(sym3(t), nodes, 2)
    return coarsen.tree_orders(parents)[0]


TREE = """pa AS (SELECT vec_id AS node, vec_id * 2 // 3 AS cluster FROM embeddings),
     kd AS (SELECT cluster, min(node) AS c0, max(node) AS c1 FROM pa GROUP BY ALL),
     sl AS (SELECT cluster * 2 AS pos, c0 AS node FROM kd
            UNION ALL SELECT cluster * 2 + 1, CASE WHEN c1 <> c0 THEN c1 END FROM kd),
     od AS (SELECT pos, coalesce(node, (SELECT count(*) FROM embeddings)
              + sum((node IS NULL)::INT) OVER (ORDER BY pos) - 1)::BIGINT AS node FROM sl)"""


def pair_tree(t):
    """One fixed coarsening: three nodes to two parents, so every second parent has one child."""
    parent = t.embeddings.select(
        col("vec_id").alias("node"), F.floor(col("vec_id") * 2 / 3).alias("cluster")
    )
    return coarsen.tree_orders([parent])[0]


@query("tree_order", f"WITH {TREE} SELECT pos, node FROM od")
def tree_order(t):
    return pair_tree(t)


@query(
    "perm_pad",
    f"""WITH {TREE} SELECT pos, node, vec_id IS NULL AS is_fake, coalesce(label, 0) AS label
        FROM od LEFT JOIN embeddings ON vec_id = node""",
)
def perm_pad(t):
    return coarsen.pad_rows(pair_tree(t), t.embeddings.select("vec_id", "label"), "vec_id", {"label": 0})


@query(
    "perm_inverse",
    f"WITH {TREE} SELECT node, pos * 10 AS pred FROM od WHERE node < (SELECT count(*) FROM embeddings)",
)
def perm_inverse(t):
    order = coarsen.pad_rows(pair_tree(t), t.embeddings.select("vec_id"), "vec_id", {})
    preds = order.select("pos", (col("pos") * 10).alias("pred"))
    return coarsen.unpad_rows(preds, order).select("node", "pred")


@query(
    "permuted_neighbours",
    f"""WITH {TREE}, nb AS (SELECT vec_id AS src, 1 AS slot, vec_id + 1 AS dst FROM embeddings
            UNION ALL SELECT vec_id, 2, vec_id - 1 FROM embeddings),
        ff AS (SELECT pos FROM od WHERE node = (SELECT count(*) FROM embeddings))
        SELECT a.pos, slot::INT AS slot, b.pos AS nbr FROM nb JOIN od a ON a.node = src JOIN od b ON b.node = dst
        WHERE dst BETWEEN 0 AND (SELECT count(*) - 1 FROM embeddings)
        UNION ALL SELECT od.pos, s::INT, ff.pos FROM od, ff, range(1, 3) r(s)
        WHERE node >= (SELECT count(*) FROM embeddings)""",
)
def permuted_neighbours(t):
    nodes = t.embeddings.select(col("vec_id").alias("node"))
    steps = F.explode(F.array(F.struct(F.lit(1).alias("slot"), F.lit(1).alias("k")), F.struct(F.lit(2).alias("slot"), F.lit(-1).alias("k")))).alias("s")
    nb = nodes.select("node", steps).select(col("node").alias("src"), col("s.slot").alias("slot"), (col("node") + col("s.k")).alias("dst"))
    nb = nb.join(nodes.withColumnRenamed("node", "dst"), "dst", "left_semi")
    return coarsen.permuted_neighbours(nb, pair_tree(t), nodes, 2)


# ------------------------------------------------------------------ energies

ENERGY = f"""{SYM}, {CENTROID}, dc AS (SELECT vec_id AS site, class AS label, -score AS cost FROM sc),
     lb AS (SELECT vec_id AS site, label FROM embeddings),
     de AS (SELECT sum(cost) AS e FROM lb JOIN dc USING (site, label)),
     se AS (SELECT sum(w * CASE WHEN a.label = b.label THEN 0 ELSE 0.5 END) AS e FROM sy
            JOIN lb a ON a.site = i JOIN lb b ON b.site = j WHERE i < j),
     le AS (SELECT sum(c) AS e FROM (SELECT DISTINCT label % 3 AS s, 1.0 + label % 3 AS c FROM lb))"""


def problem(t):
    data = class_scores(t).select(
        F.lit(0).alias("g"), col("vec_id").alias("site"), col("class").alias("label"), (-col("score")).alias("cost")
    )
    labeling = t.embeddings.select(F.lit(0).alias("g"), col("vec_id").alias("site"), "label")
    sets = labeling.select("label").distinct().select(
        (col("label") % 3).alias("set_id"), "label", (1.0 + col("label") % 3).alias("cost")
    )
    return data, labeling, sets


def problem_edges(t):
    """Neighbour graph of the problem; searched only by the energies that it enters."""
    return energy.single_edges(sym3(t).withColumn("g", F.lit(0)), ["g"])


@query("data_energy", f"WITH {ENERGY} SELECT round(e, 4) AS data FROM de")
def data_energy(t):
    data, labeling, _ = problem(t)
    return energy.data_energy(labeling, data, ["g"]).select(R("data", 4).alias("data"))


@query("smooth_energy", f"WITH {ENERGY} SELECT round(e, 4) AS smooth FROM se")
def smooth_energy(t):
    _, labeling, _ = problem(t)
    edges = problem_edges(t)
    return energy.smooth_energy(labeling, edges, energy.potts(0.5), ["g"]).select(R("smooth", 4).alias("smooth"))


@query("label_energy", f"WITH {ENERGY} SELECT e::DOUBLE AS label_cost FROM le")
def label_energy(t):
    _, labeling, sets = problem(t)
    return energy.label_energy(labeling, sets, ["g"]).select("label_cost")


@query(
    "total_energy",
    f"""WITH {ENERGY} SELECT round(de.e, 4) AS data_energy, round(se.e, 4) AS smooth_energy, le.e::DOUBLE AS label_energy,
        round(de.e + se.e + le.e, 4) AS energy FROM de, se, le""",
)
def total_energy(t):
    data, labeling, sets = problem(t)
    out = energy.total_energy(labeling, data, problem_edges(t), energy.potts(0.5), ["g"], sets)
    return out.select(*[R(c, 4).alias(c) for c in ("data_energy", "smooth_energy", "label_energy", "energy")])


@query(
    "argmin_label",
    f"""WITH {CENTROID} SELECT vec_id AS site, class AS label FROM sc
        QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, class) = 1""",
)
def argmin_label(t):
    data = class_scores(t).select(col("vec_id").alias("site"), col("class").alias("label"), (-col("score")).alias("cost"))
    return energy.argmin_labels(data, [])


@query(
    "cheapest_single_label",
    f"""WITH {CENTROID}, s AS (SELECT class AS label, sum(-score) AS c FROM sc GROUP BY ALL)
        SELECT label FROM s QUALIFY row_number() OVER (ORDER BY c, label) = 1""",
)
def cheapest_single_label(t):
    data, _, _ = problem(t)
    return energy.cheapest_single_label(data, ["g"]).select("label")


@query("greedy_labels")
def greedy_labels(t):
    """Labels worth their fixed cost, and every site's cheapest one among them."""
    data, _, sets = problem(t)
    data = cut(data)
    single = sets.select(col("label").alias("set_id"), "label", F.lit(3.0).alias("cost"))
    chosen, _ = energy.greedy_labels(data.drop("g"), single)
    return energy.assign_chosen(data, chosen, ["g"]).select("site", "label")


# Every user's events in time order form a chain; label 1 fits high values, label 0 low ones.
CHAIN = """ev AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos,
             abs(value - 60) / 100 AS c0, abs(value - 140) / 100 AS c1 FROM events),
     dp AS (SELECT user_id, 0 AS pos, c0 AS e0, c1 AS e1 FROM ev WHERE pos = 0
            UNION ALL SELECT ev.user_id, dp.pos + 1, c0 + least(e0, e1 + 0.4), c1 + least(e1, e0 + 0.4)
            FROM dp JOIN ev ON ev.user_id = dp.user_id AND ev.pos = dp.pos + 1)"""
BEST = f"""WITH RECURSIVE {CHAIN} SELECT user_id, round(least(e0, e1), 6) AS energy FROM dp
           QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY pos DESC) = 1"""


def chains(t):
    ev = running(t.events.select("user_id", "event_id", "value"), ["user_id"], "event_id", "event_id")
    ev = cut(ev.select("user_id", col("pos").alias("site"), "value"))
    fit = F.array(
        F.struct(F.lit(0).alias("label"), (F.abs(col("value") - 60) / 100).alias("cost")),
        F.struct(F.lit(1).alias("label"), (F.abs(col("value") - 140) / 100).alias("cost")),
    )
    data = cut(ev.select("user_id", "site", F.inline(fit)))
    links = ev.filter(col("site") > 0).select("user_id", (col("site") - 1).alias("i"), col("site").alias("j"), F.lit(1.0).alias("w"))
    return data, cut(links)


@query("alpha_beta_swap", BEST)
def alpha_beta_swap(t):
    """Two labels: the swap reaches the optimum, which a chain recursion can confirm."""
    data, links = chains(t)
    out = energy.swap(data, links, energy.potts(0.4), ["user_id"], [0, 1])
    e = energy.total_energy(out, data, links, energy.potts(0.4), ["user_id"])
    return e.select("user_id", R("energy", 6).alias("energy"))


@query("alpha_expansion", BEST)
def alpha_expansion(t):
    data, links = chains(t)
    out = energy.expansion(data, links, energy.potts(0.4), ["user_id"], [0, 1])
    e = energy.total_energy(out, data, links, energy.potts(0.4), ["user_id"])
    return e.select("user_id", R("energy", 6).alias("energy"))


@query("vote_smoothing")
def vote_smoothing(t):
    """Vote shares per customer over three order states, areas from account balances, chain smoothing."""
    votes_in = t.orders.select(
        (col("o_custkey") % 20).alias("g"),
        F.floor(col("o_custkey") / 20).alias("site"),
        F.when(col("o_orderstatus") == "F", 0).when(col("o_orderstatus") == "O", 1).otherwise(2).alias("label"),
    )
    shares = votes.vote_shares(votes_in, ["g", "site"], "label", [0, 1, 2]).select("g", "site", "label", "share")
    sites = shares.select("g", "site").distinct()
    areas = t.customer.select(
        (col("c_custkey") % 20).alias("g"), F.floor(col("c_custkey") / 20).alias("site"), (F.abs("c_acctbal") / 1e4).alias("area")
    )
    links = sites.select("g", col("site").alias("i"), (col("site") + 1).alias("j"), F.lit(1.0).alias("w"))
    links = links.join(sites.select("g", col("site").alias("j")), ["g", "j"], "left_semi")
    return energy.smooth_votes(shares, areas, links, [0, 1, 2], ["g"])
