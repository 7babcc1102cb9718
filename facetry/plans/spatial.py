"""Queries for nearest points, overlap, rays, diffusion, part axes and edge descriptors."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from facetry.operators import approximate, cells, descriptors, edges, hops, mesh, neighbours, spatial
from facetry.plans.meshes import ALL_PATHS, EDGES, GEO, M, NORMALS, VE, curvature_tables, face_edges, faces, geometry, rounded, vertex_edges, vertices
from facetry.plans.registry import query
from facetry.session import cut

R, col = F.round, F.col


def clouds(t):
    c = t.customer.select(
        col("c_custkey").alias("id"), col("c_nationkey").cast("double").alias("x"), (col("c_acctbal") / 1000).alias("y"),
        (col("c_custkey") % 10).cast("double").alias("z"),
    )
    s = t.supplier.select(
        col("s_suppkey").alias("id"), col("s_nationkey").cast("double").alias("x"), (col("s_acctbal") / 1000).alias("y"),
        (col("s_suppkey") % 10).cast("double").alias("z"),
    )
    return c, s


CLOUDS = """c AS (SELECT c_custkey AS id, c_nationkey::DOUBLE AS x, c_acctbal / 1000 AS y, (c_custkey % 10)::DOUBLE AS z FROM customer),
     s AS (SELECT s_suppkey AS id, s_nationkey::DOUBLE AS x, s_acctbal / 1000 AS y, (s_suppkey % 10)::DOUBLE AS z FROM supplier)"""


@query(
    "nearest_point_join",
    f"""WITH {CLOUDS}, d AS (SELECT c.id AS src, s.id AS dst, sqrt((c.x-s.x)^2 + (c.y-s.y)^2 + (c.z-s.z)^2) AS d FROM c CROSS JOIN s)
        SELECT src, 1 AS slot, dst, round(d, 6) AS d FROM d WHERE d <= 2.5
        QUALIFY row_number() OVER (PARTITION BY src ORDER BY d, dst) = 1""",
)
def nearest_point_join(t):
    c, s = (p.select("id", F.array("x", "y", "z").alias("v")) for p in clouds(t))
    return neighbours.nearest(c, s, "id", "v", 1, 2.5).withColumn("d", R("d", 6))


@query(
    "grid_overlap",
    f"""WITH {CLOUDS}, b AS (SELECT min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy, min(z) AS lz, max(z) AS hz,
             greatest(max(x)-min(x), max(y)-min(y), max(z)-min(z)) AS side FROM s),
        g AS (SELECT DISTINCT least(floor(16/side*(x-lx)), 15) AS i, least(floor(16/side*(y-ly)), 15) AS j,
              least(floor(16/side*(z-lz)), 15) AS k FROM s, b)
        SELECT id FROM c, b WHERE x > lx AND x < hx AND y > ly AND y < hy AND z > lz AND z < hz AND EXISTS (
          SELECT 1 FROM g WHERE i = least(floor(16/side*(x-lx)), 15) AND j = least(floor(16/side*(y-ly)), 15)
                 AND k = least(floor(16/side*(z-lz)), 15))""",
)
def grid_overlap(t):
    c, s = clouds(t)
    return spatial.overlap(c, s).select("id")


POINT_NORMALS = """WITH p AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings),
    k AS (SELECT a.vec_id, b.x-a.x AS x, b.y-a.y AS y, b.z-a.z AS z FROM p a JOIN p b ON a.vec_id <> b.vec_id
          QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY sqrt((b.x-a.x)^2+(b.y-a.y)^2+(b.z-a.z)^2), b.vec_id) <= 12),
    s AS (SELECT vec_id, sum(x*x) AS xx, sum(x*y) AS xy, sum(x*z) AS xz, sum(y*y) AS yy, sum(y*z) AS yz, sum(z*z) AS zz FROM k GROUP BY ALL),
    c AS (SELECT *, xx+yy+zz AS tr, xx*yy+xx*zz+yy*zz-xy*xy-xz*xz-yz*yz AS mi, xx*(yy*zz-yz*yz)-xy*(xy*zz-yz*xz)+xz*(xy*yz-yy*xz) AS de FROM s),
    d AS (SELECT *, sqrt(greatest(tr*tr-3*mi, 0)) AS r FROM c),
    e AS (SELECT *, (tr + 2*r*cos(acos(greatest(-1, least(1, (2*tr^3-9*tr*mi+27*de)/(2*r^3))))/3 + 2*pi()/3))/3 AS lo FROM d),
    -- the adjugate of A - lo I has the eigenvector in every column; the longest column is taken
    g AS (SELECT vec_id, (yy-lo)*(zz-lo)-yz*yz AS axx, xz*yz-xy*(zz-lo) AS axy, xy*yz-xz*(yy-lo) AS axz,
                 (xx-lo)*(zz-lo)-xz*xz AS ayy, xy*xz-yz*(xx-lo) AS ayz, (xx-lo)*(yy-lo)-xy*xy AS azz FROM e),
    h AS (SELECT *, axx^2+axy^2+axz^2 AS l0, axy^2+ayy^2+ayz^2 AS l1, axz^2+ayz^2+azz^2 AS l2 FROM g),
    n AS (SELECT vec_id, CASE WHEN l0 >= l1 AND l0 >= l2 THEN [axx, axy, axz, l0] WHEN l1 >= l2 THEN [axy, ayy, ayz, l1]
                         ELSE [axz, ayz, azz, l2] END AS v FROM h)
    SELECT vec_id, round(v[1]/sqrt(v[4]) * q, 4) AS nx, round(v[2]/sqrt(v[4]) * q, 4) AS ny, round(v[3]/sqrt(v[4]) * q, 4) AS nz
    FROM (SELECT *, CASE WHEN v[3] < 0 THEN -1 ELSE 1 END AS q FROM n)"""


@query("point_normals", POINT_NORMALS)
def point_normals(t):
    p = t.embeddings.select("vec_id", F.slice("embedding", 1, 3).alias("v"))
    n = spatial.point_normals(p, "vec_id", "v")
    return n.select("vec_id", *[R(F.col(f"n{k}"), 4).alias(f"n{k}") for k in "xyz"])


@query(
    "ray_distances",
    f"""WITH {GEO}, r AS (SELECT mesh_id, face, gx AS ox, gy AS oy, gz + 1 AS oz, 0.3/sqrt(1.13) AS lx, 0.2/sqrt(1.13) AS ly,
             -1/sqrt(1.13) AS lz FROM ge),
        m AS (SELECT r.mesh_id, r.face AS ray, ox-ax AS sx, oy-ay AS sy, oz-az AS sz, lx, ly, lz, bx-ax AS e1x, b_y-ay AS e1y,
              bz-az AS e1z, cx-ax AS e2x, cy-ay AS e2y, cz-az AS e2z FROM r JOIN ge t ON t.mesh_id = r.mesh_id),
        p AS (SELECT *, ly*e2z-lz*e2y AS px, lz*e2x-lx*e2z AS py, lx*e2y-ly*e2x AS pz,
              sy*e1z-sz*e1y AS qx, sz*e1x-sx*e1z AS qy, sx*e1y-sy*e1x AS qz FROM m),
        h AS (SELECT mesh_id, ray, px*e1x+py*e1y+pz*e1z AS det, sx*px+sy*py+sz*pz AS u, lx*qx+ly*qy+lz*qz AS v,
              e2x*qx+e2y*qy+e2z*qz AS d FROM p)
        SELECT mesh_id, ray, round(min(d/det), 6) AS d FROM h WHERE abs(det) >= 1e-30 AND u/det BETWEEN 0 AND 1 AND v/det >= 0
          AND (u+v)/det <= 1 AND d/det > 0 GROUP BY ALL""",
)
def ray_distances(t):
    g = cut(geometry(t))
    n = 1.13**0.5
    line = {"lx": 0.3 / n, "ly": 0.2 / n, "lz": -1.0 / n}
    rays = g.select(
        M, col("face").alias("ray"), F.lit(-1).cast("long").alias("skip"), col("gx").alias("ox"), col("gy").alias("oy"),
        (col("gz") + 1).alias("oz"), *[F.lit(v).alias(k) for k, v in line.items()],
    )
    return spatial.ray_distances(rays, g).withColumn("d", R("d", 6))


RAYS = f"""WITH {GEO}, r AS (SELECT mesh_id, face, gx AS ox, gy AS oy, gz + 1 AS oz, 0.3/sqrt(1.13) AS lx, 0.2/sqrt(1.13) AS ly,
             -1/sqrt(1.13) AS lz FROM ge),
        m AS (SELECT r.mesh_id, r.face AS ray, t.face, ox-ax AS sx, oy-ay AS sy, oz-az AS sz, lx, ly, lz, bx-ax AS e1x, b_y-ay AS e1y,
              bz-az AS e1z, cx-ax AS e2x, cy-ay AS e2y, cz-az AS e2z FROM r JOIN ge t ON t.mesh_id = r.mesh_id
              WHERE (r.face + t.face) % 3 > 0),
        p AS (SELECT *, ly*e2z-lz*e2y AS px, lz*e2x-lx*e2z AS py, lx*e2y-ly*e2x AS pz,
              sy*e1z-sz*e1y AS qx, sz*e1x-sx*e1z AS qy, sx*e1y-sy*e1x AS qz FROM m),
        h AS (SELECT mesh_id, ray, face, px*e1x+py*e1y+pz*e1z AS det, sx*px+sy*py+sz*pz AS u, lx*qx+ly*qy+lz*qz AS v,
              e2x*qx+e2y*qy+e2z*qz AS d FROM p)"""


@query(
    "compatible_ray_hits",
    RAYS + """ SELECT mesh_id, ray, round(min(d/det), 6) AS d FROM h WHERE abs(det) >= 1e-30 AND u/det BETWEEN 0 AND 1
         AND v/det >= 0 AND (u+v)/det <= 1 AND d/det > 0 GROUP BY ALL""",
)
def compatible_ray_hits(t):
    """First triangle along each ray among those that a predicate over both rows allows."""
    g = cut(geometry(t))
    n = 1.13**0.5
    line = {"lx": 0.3 / n, "ly": 0.2 / n, "lz": -1.0 / n}
    rays = g.select(
        M, col("face").alias("ray"), F.lit(-1).cast("long").alias("skip"), col("gx").alias("ox"), col("gy").alias("oy"),
        (col("gz") + 1).alias("oz"), *[F.lit(v).alias(k) for k, v in line.items()],
    )
    tri = g.select(M, "face", *[f"{p}{c}" for p in "abc" for c in "xyz"])
    hits = cells.ray_hits(rays, tri, [M], compatible=lambda ray, face: (ray["ray"] + face["face"]) % 3 > 0)
    return hits.select(M, "ray", R("d", 6).alias("d"))


LINES = """WITH a AS (SELECT *, embedding::DOUBLE[] AS e FROM embeddings),
     v AS (SELECT vec_id, label, e[1] AS x, e[2] AS y, e[3] AS z, e[4] / sqrt(e[4]^2 + e[5]^2 + e[6]^2) AS lx,
             e[5] / sqrt(e[4]^2 + e[5]^2 + e[6]^2) AS ly, e[6] / sqrt(e[4]^2 + e[5]^2 + e[6]^2) AS lz FROM a),
     j AS (SELECT q.vec_id AS q, p.vec_id AS p, p.x - q.x AS dx, p.y - q.y AS dy, p.z - q.z AS dz, q.lx, q.ly, q.lz
           FROM v q JOIN v p ON q.label <> p.label)"""


def points_and_lines(t):
    """The first three numbers of each embedding as a point, the next three as a direction through it."""
    e = [col("embedding")[i].cast("double") for i in range(6)]
    size = F.sqrt(e[3] ** 2 + e[4] ** 2 + e[5] ** 2)
    named = {"x": e[0], "y": e[1], "z": e[2]}
    points = t.embeddings.select(F.lit(1).alias("cloud"), col("vec_id").alias("id"), "label", *[c.alias(k) for k, c in named.items()])
    lines = t.embeddings.select(
        F.lit(1).alias("cloud"), col("vec_id").alias("q"), "label", *[c.alias(f"o{k}") for k, c in named.items()],
        *[F.try_divide(c, size).alias(f"l{k}") for k, c in zip("xyz", e[3:])],
    )
    return points, lines


@query(
    "nearest_compatible_point",
    LINES + " SELECT q, arg_min(p, dx^2 + dy^2 + dz^2) AS id, round(sqrt(min(dx^2 + dy^2 + dz^2)), 6) AS d FROM j GROUP BY q",
)
def nearest_compatible_point(t):
    """The nearest point of another label."""
    points, lines = points_and_lines(t)
    found = cells.nearest_point(lines, points, ["cloud"], compatible=lambda a, b: a["label"] != b["label"])
    return found.select("q", "point.id", R("d", 6).alias("d"))


@query(
    "nearest_to_line",
    LINES + """, c AS (SELECT q, p, sqrt((dy*lz - dz*ly)^2 + (dz*lx - dx*lz)^2 + (dx*ly - dy*lx)^2) AS d FROM j)
       SELECT q, arg_min(p, d) AS id, round(min(d), 6) AS d FROM c WHERE d < 0.05 GROUP BY q""",
)
def nearest_to_line(t):
    """The point of another label that lies nearest to a line, if closer than 0.05."""
    points, lines = points_and_lines(t)
    found = cells.nearest_to_line(lines, points, ["cloud"], max_distance=0.05, compatible=lambda a, b: a["label"] != b["label"])
    return found.select("q", "point.id", R("d", 6).alias("d"))


@query(
    "approximate_neighbours",
    "SELECT 10 * count(*) AS n_exact, TRUE AS recalled, 0::BIGINT AS wrong FROM embeddings",
)
def approximate_neighbours(t):
    """Ten neighbours by cosine from the forest: nine in ten of the exact ones at least, none at a wrong distance."""
    found = approximate.knn_cosine_reaching(t.embeddings, "vec_id", "embedding", 10)
    exact = cut(neighbours.knn_cosine(t.embeddings, "vec_id", "embedding", 10))
    both = exact.select("src", "dst", col("d").alias("_d")).join(found, ["src", "dst"], "left")
    return both.agg(
        F.count("*").alias("n_exact"), (F.count("d") >= 0.9 * F.count("*")).alias("recalled"),
        F.count_if(F.abs(col("d") - col("_d")) > 1e-6).alias("wrong"),
    )


@query("shape_diameter")
def shape_diameter(t):
    g = cut(geometry(t))
    vn = cut(mesh.vertex_normals(g))
    n = cut(mesh.smooth_face_normals(faces(t), vn))
    return spatial.shape_diameter(g, n, vertices(t), cut(mesh.principal_curvatures(g, vn)))


@query("visible_shape")
def visible_shape(t):
    g = cut(geometry(t))
    vn = cut(mesh.vertex_normals(g))
    n = cut(mesh.smooth_face_normals(faces(t), vn))
    return spatial.visible_shape(g, n, vertices(t), cut(mesh.principal_curvatures(g, vn)))


@query("part_axes")
def part_axes(t):
    v = [col("embedding")[i].cast("double") for i in range(3)]
    p = t.embeddings.select(
        (col("label") % 2).alias("mesh_id"), "label", *[c.alias(k) for c, k in zip(v, "xyz")], (1.0 + col("vec_id") % 7).alias("w")
    )
    out = spatial.part_axes(p, ["mesh_id", "label"])
    return out.select("mesh_id", "label", "axis", R("spread", 6).alias("spread"), R("extent", 6).alias("extent"))


DIFFUSE = EDGES.replace(GEO, NORMALS) + VE + """, va AS (SELECT mesh_id, v, sum(area) AS area FROM co JOIN ge USING (mesh_id, face) GROUP BY mesh_id, v),
     fa AS (SELECT vx.mesh_id, vx.v, x, y, z, nx, ny, nz, area FROM vx JOIN vn USING (mesh_id, v) JOIN va USING (mesh_id, v)),
     walk AS (SELECT mesh_id, v AS src, v AS node FROM fa
              UNION SELECT w.mesh_id, w.src, ve.j FROM walk w JOIN ve ON ve.mesh_id = w.mesh_id AND ve.i = w.node
                JOIN fa a ON a.mesh_id = w.mesh_id AND a.v = w.src JOIN fa b ON b.mesh_id = w.mesh_id AND b.v = ve.j
                WHERE a.nx*b.nx + a.ny*b.ny + a.nz*b.nz > 0 AND (a.x-b.x)^2 + (a.y-b.y)^2 + (a.z-b.z)^2 < 9*0.25),
     ww AS (SELECT w.mesh_id, src, b.z, CASE WHEN src = node THEN b.area ELSE b.area * (a.nx*b.nx + a.ny*b.ny + a.nz*b.nz)
              * exp(-0.5 * ((a.x-b.x)^2 + (a.y-b.y)^2 + (a.z-b.z)^2) / 0.25) END AS w FROM walk w
              JOIN fa a ON a.mesh_id = w.mesh_id AND a.v = src JOIN fa b ON b.mesh_id = w.mesh_id AND b.v = node)"""


#: The same walk with the normals of both ends.
DIFFUSE_ENDS = re.sub(r"\bfa\b", "fq", DIFFUSE).replace(
    "src, b.z,", "src, node, b.nx AS bx, b.ny AS b_y, b.nz AS bz, a.nx AS ox, a.ny AS oy, a.nz AS oz,"
)


@query(
    "diffuse_normals",
    f"""WITH RECURSIVE {DIFFUSE_ENDS}, s AS (SELECT mesh_id, src AS v, sum(w*bx) AS x, sum(w*b_y) AS y, sum(w*bz) AS z FROM ww GROUP BY ALL)
        SELECT mesh_id, v, round(x/sqrt(x*x+y*y+z*z), 6) AS nx, round(y/sqrt(x*x+y*y+z*z), 6) AS ny, round(z/sqrt(x*x+y*y+z*z), 6) AS nz FROM s""",
)
def diffuse_normals(t):
    g = cut(geometry(t))
    out = spatial.diffuse_normals(vertices(t), cut(mesh.vertex_normals(g)), mesh.vertex_areas(g), cut(mesh.vertex_neighbours(faces(t))), 0.5)
    return rounded(out, [M, "v"], nx="nx", ny="ny", nz="nz")


def _dot3(a, b):
    return " + ".join(f"{p}*{q}" for p, q in zip(a, b))


def diffused_curvature_sql() -> str:
    """Means of world tensors, each turned by the rotation between the normals; curvatures are invariants."""
    six, three = [(i, j) for i in range(3) for j in range(i, 3)], range(3)
    n, f = ["bx", "b_y", "bz"], ["ox", "oy", "oz"]
    x = [f"{n[1]}*{f[2]} - {n[2]}*{f[1]}", f"{n[2]}*{f[0]} - {n[0]}*{f[2]}", f"{n[0]}*{f[1]} - {n[1]}*{f[0]}"]
    skew = {(0, 1): "-x2", (0, 2): "x1", (1, 0): "x2", (1, 2): "-x0", (2, 0): "-x1", (2, 1): "x0"}
    rotation = ", ".join(f"{'t' if i == j else skew[i, j]} + x{i}*x{j}/(1 + t) AS r{i}{j}" for i in three for j in three)
    turned = {
        (i, j): " + ".join(f"r{i}{k}*m{min(k, m)}{max(k, m)}*r{j}{m}" for k in three for m in three) for i, j in six
    }
    start = curvature_tables().replace(f"WITH {NORMALS}", f"WITH RECURSIVE {DIFFUSE_ENDS}")
    return start + f""",
      ww1 AS (SELECT *, {_dot3(n, f)} AS t, {", ".join(f"{e} AS x{k}" for k, e in enumerate(x))} FROM ww),
      ww2 AS (SELECT ww1.mesh_id, src, w, {rotation}, me.* EXCLUDE (mesh_id, v) FROM ww1 JOIN me ON me.mesh_id = ww1.mesh_id AND me.v = node),
      ww3 AS (SELECT mesh_id, src AS v, {", ".join(f"sum(w*({e}))/sum(w) AS s{i}{j}" for (i, j), e in turned.items())} FROM ww2 GROUP BY ALL),
      ww4 AS (SELECT mesh_id, v, s00+s11+s22 AS tr2, s00*s11 - s01^2 + s00*s22 - s02^2 + s11*s22 - s12^2 AS mi2 FROM ww3)
      SELECT mesh_id, v, round(tr2/2 + sqrt(greatest(tr2*tr2/4 - mi2, 0)), 5) AS k1, round(tr2/2 - sqrt(greatest(tr2*tr2/4 - mi2, 0)), 5) AS k2 FROM ww4"""


@query("diffuse_curvatures", diffused_curvature_sql())
def diffuse_curvatures(t):
    g = cut(geometry(t))
    vn = cut(mesh.vertex_normals(g))
    k = cut(mesh.principal_curvatures(g, vn))
    out = spatial.diffuse_curvatures(vertices(t), vn, mesh.vertex_areas(g), cut(mesh.vertex_neighbours(faces(t))), k, 0.5)
    return out.select(M, "v", R("k1", 5).alias("k1"), R("k2", 5).alias("k2"))


def bilateral_sql(sigma: float, width: float) -> str:
    """Both passes of the filter, each over the faces that a walk across edges meets near a vertex."""

    def walk(name: str, places: str, reach: float) -> str:
        near = f"(p.x-g.gx)^2 + (p.y-g.gy)^2 + (p.z-g.gz)^2 < {9 * reach * reach}"
        join = f"JOIN {places} p ON p.mesh_id = s.mesh_id AND p.v = s.v JOIN ge g ON g.mesh_id = s.mesh_id AND g.face = s.face WHERE {near}"
        return f"""{name} AS (SELECT s.mesh_id, s.v, s.face FROM b0 s {join}
          UNION SELECT s.mesh_id, s.v, s.face FROM (SELECT {name}.mesh_id, {name}.v, nbr AS face FROM {name}
            JOIN ac ON ac.mesh_id = {name}.mesh_id AND ac.face = {name}.face AND nbr IS NOT NULL) s {join})"""

    return f"""WITH RECURSIVE {EDGES}, b0 AS (SELECT DISTINCT mesh_id, unnest([v0, v1, v2]) AS v, face FROM ge),
      {walk("w1", "vx", sigma / 2)},
      k1 AS (SELECT w1.mesh_id, w1.v, g.gx, g.gy, g.gz, area * exp(-0.5*((p.x-g.gx)^2 + (p.y-g.gy)^2 + (p.z-g.gz)^2)/{sigma * sigma / 4}) AS w
             FROM w1 JOIN vx p ON p.mesh_id = w1.mesh_id AND p.v = w1.v JOIN ge g ON g.mesh_id = w1.mesh_id AND g.face = w1.face),
      m1 AS (SELECT mesh_id, v, sum(w*gx)/sum(w) AS x, sum(w*gy)/sum(w) AS y, sum(w*gz)/sum(w) AS z FROM k1 GROUP BY ALL),
      sv AS (SELECT vx.mesh_id, vx.v, coalesce(m1.x, vx.x) AS x, coalesce(m1.y, vx.y) AS y, coalesce(m1.z, vx.z) AS z
             FROM vx LEFT JOIN m1 ON m1.mesh_id = vx.mesh_id AND m1.v = vx.v),
      fe AS (SELECT fc.mesh_id, fc.face, b.x-a.x AS px, b.y-a.y AS py, b.z-a.z AS pz, c.x-a.x AS qx, c.y-a.y AS qy, c.z-a.z AS qz FROM fc
             JOIN sv a ON a.mesh_id = fc.mesh_id AND a.v = v0 JOIN sv b ON b.mesh_id = fc.mesh_id AND b.v = v1 JOIN sv c ON c.mesh_id = fc.mesh_id AND c.v = v2),
      fx AS (SELECT mesh_id, face, py*qz-pz*qy AS ex, pz*qx-px*qz AS ey, px*qy-py*qx AS ez FROM fe),
      {walk("w2", "sv", sigma)},
      k2 AS (SELECT w2.mesh_id, w2.v, p.x, p.y, p.z, ex/l AS ex, ey/l AS ey, ez/l AS ez, area * exp(-0.5*((p.x-g.gx)^2 + (p.y-g.gy)^2 + (p.z-g.gz)^2)/{sigma * sigma}) AS w,
               ((p.x-g.gx)*ex + (p.y-g.gy)*ey + (p.z-g.gz)*ez)/l AS h
             FROM w2 JOIN sv p ON p.mesh_id = w2.mesh_id AND p.v = w2.v JOIN ge g ON g.mesh_id = w2.mesh_id AND g.face = w2.face
             JOIN (SELECT *, sqrt(ex*ex + ey*ey + ez*ez) AS l FROM fx) n ON n.mesh_id = w2.mesh_id AND n.face = w2.face),
      k3 AS (SELECT *, CASE WHEN h*h < {9 * width * width} THEN w * exp(-0.5*h*h/{width * width}) ELSE 0 END AS u FROM k2),
      m2 AS (SELECT mesh_id, v, sum(u*(x-h*ex))/sum(u) AS x, sum(u*(y-h*ey))/sum(u) AS y, sum(u*(z-h*ez))/sum(u) AS z FROM k3 GROUP BY ALL HAVING sum(u) > 0)
      SELECT sv.mesh_id, sv.v, round(coalesce(m2.x, sv.x), 6) AS x, round(coalesce(m2.y, sv.y), 6) AS y, round(coalesce(m2.z, sv.z), 6) AS z
      FROM sv LEFT JOIN m2 ON m2.mesh_id = sv.mesh_id AND m2.v = sv.v"""


@query("bilateral_smooth", bilateral_sql(1.0, 0.3))
def bilateral_smooth(t):
    f = faces(t)
    out = spatial.bilateral_smooth(vertices(t), f, cut(mesh.across_edges(f)), 1.0, 0.3)
    return rounded(out, [M, "v"], x="x", y="y", z="z")


@query("diffuse_field", f"WITH RECURSIVE {DIFFUSE} SELECT mesh_id, src AS v, round(sum(w*z)/sum(w), 6) AS z FROM ww GROUP BY ALL")
def diffuse_field(t):
    g = cut(geometry(t))
    v = vertices(t)
    out = spatial.diffuse(v, mesh.vertex_normals(g), mesh.vertex_areas(g), cut(mesh.vertex_neighbours(faces(t))), ["z"], 0.5)
    return out.withColumn("z", R("z", 6))


@query(
    "class_context",
    f"""WITH RECURSIVE {EDGES}, {ALL_PATHS},
        ta AS (SELECT mesh_id, sum(area) AS total FROM ge GROUP BY ALL),
        xb AS (SELECT i AS xb, pow(-ln((6.0-i)/6.0), 0.9) * 2.4 / pow(ln(6.0), 0.9) AS x1,
                      pow(-ln((5.0-i)/6.0), 0.9) * 2.4 / pow(ln(6.0), 0.9) AS x2 FROM range(0, 5) r(i)),
        pr AS (SELECT mesh_id, face, 0 AS label, gz AS p FROM ge UNION ALL SELECT mesh_id, face, 1, 1 - gz FROM ge)
        SELECT pa.mesh_id, src AS face, xb::INT AS xb, label, round(sum(area/total/(d/2.0+0.1)*p), 6) AS mass FROM pa
        JOIN ge ON ge.mesh_id = pa.mesh_id AND ge.face = node JOIN ta ON ta.mesh_id = pa.mesh_id
        JOIN pr ON pr.mesh_id = pa.mesh_id AND pr.face = node JOIN xb ON d BETWEEN x1 AND x2 GROUP BY ALL""",
)
def class_context(t):
    """Two made-up class probabilities per face: its height and the rest."""
    g = cut(geometry(t))
    paths = hops.bounded_distances(cut(face_edges(t)), g.select(M, col("face").alias("src")), None, [M])
    two = F.array(F.struct(F.lit(0).alias("label"), col("gz").alias("p")), F.struct(F.lit(1).alias("label"), (1 - col("gz")).alias("p")))
    probs = g.select(M, "face", F.inline(two))
    return descriptors.class_context(paths, probs, g.select(M, "face", "area"), 2.0).withColumn("mass", R("mass", 6))


@query(
    "edge_neighbourhood_angles",
    f"""WITH RECURSIVE {EDGES}{VE}, tn AS (SELECT ac.mesh_id, ac.face*3 + ac.slot AS edge, ac.p, ac.q, (g.area + h.area) AS ar,
             g.ry*h.rz - g.rz*h.ry AS tx, g.rz*h.rx - g.rx*h.rz AS ty, g.rx*h.ry - g.ry*h.rx AS tz,
             g.rx*h.rx + g.ry*h.ry + g.rz*h.rz AS dt, q.x-p.x AS ex, q.y-p.y AS ey, q.z-p.z AS ez
             FROM ac JOIN ge g ON g.mesh_id = ac.mesh_id AND g.face = ac.face
             JOIN ge h ON h.mesh_id = ac.mesh_id AND h.face = nbr
             JOIN vx p ON p.mesh_id = ac.mesh_id AND p.v = ac.p JOIN vx q ON q.mesh_id = ac.mesh_id AND q.v = ac.q),
        ta AS (SELECT mesh_id, sum(area) AS total FROM ge GROUP BY ALL),
        an AS (SELECT tn.mesh_id, edge, p, q, ar / total AS wt, (pi() + atan2(sqrt(tx*tx + ty*ty + tz*tz), dt)
               * CASE WHEN tx*ex + ty*ey + tz*ez < 0 THEN -1 ELSE 1 END) / pi() AS a FROM tn JOIN ta ON ta.mesh_id = tn.mesh_id),
        ev AS (SELECT mesh_id, edge, a, wt, unnest([p, q]) AS v FROM an),
        pt2 AS (SELECT mesh_id, v AS src, v AS node, 0.0::DOUBLE AS d FROM vx
                UNION ALL SELECT mesh_id, i, j, w FROM ve),
        nr AS (SELECT pt2.mesh_id, src, ev.a, wt / (d + 0.01) AS w FROM pt2 JOIN ev ON ev.mesh_id = pt2.mesh_id AND ev.v = node)
        SELECT ev.mesh_id, ev.edge, round(sum(nr.a * w) / sum(w), 6) AS mean_angle FROM ev
        JOIN nr ON nr.mesh_id = ev.mesh_id AND nr.src = ev.v GROUP BY ALL""",
)
def edge_neighbourhood_angles(t):
    """Radius below every edge length, so the neighbourhood of a vertex is its first ring."""
    g = cut(geometry(t))
    across = cut(mesh.across_edges(faces(t)))
    e = edges.edge_ids(across)
    angles = mesh.dihedral_angles(across, g, vertices(t))
    weights = edges.edge_weights(e, g.select(M, "face", "area"))
    paths = hops.bounded_distances(cut(vertex_edges(t)), vertices(t).select(M, col("v").alias("src")), 0.5, [M])
    out = edges.neighbourhood_angles(e, angles, weights, paths)
    return out.select(M, "edge", R("mean_angle", 6).alias("mean_angle"))


@query(
    "edge_differences",
    f"""WITH {EDGES} SELECT ac.mesh_id, ac.face*3 + slot AS edge, round(abs(g.area - h.area), 6) AS d_area FROM ac
        JOIN ge g ON g.mesh_id = ac.mesh_id AND g.face = ac.face JOIN ge h ON h.mesh_id = ac.mesh_id AND h.face = nbr""",
)
def edge_differences(t):
    g = geometry(t)
    e = edges.edge_ids(mesh.across_edges(faces(t)))
    return rounded(edges.differences(e, g.select(M, "face", "area"), ["area"]), [M, "edge"], d_area="d_area")


@query(
    "axis_context",
    f"""WITH {GEO}, bb AS (SELECT mesh_id, max(x)-min(x) AS sx, max(y)-min(y) AS sy, max(z)-min(z) AS sz FROM vx GROUP BY ALL),
        ta AS (SELECT mesh_id, sum(area) AS total FROM ge GROUP BY ALL),
        pr AS (SELECT g.mesh_id, g.face, h.area / total AS share, h.gz AS hp,
                      unnest([abs(h.gx-g.gx), abs(h.gy-g.gy), abs(h.gz-g.gz)]) AS gap, unnest([sx, sy, sz]) AS reach,
                      unnest([0, 1, 2]) AS axis FROM ge g JOIN ge h ON h.mesh_id = g.mesh_id
               JOIN bb ON bb.mesh_id = g.mesh_id JOIN ta ON ta.mesh_id = g.mesh_id),
        xb AS (SELECT i AS xb, pow(-ln((6.0-i)/6.0), 0.9) * 1.2 / pow(ln(6.0), 0.9) AS x1,
                      pow(-ln((5.0-i)/6.0), 0.9) * 1.2 / pow(ln(6.0), 0.9) AS x2 FROM range(0, 5) r(i)),
        su AS (SELECT mesh_id, face, axis, xb, sum(share * hp / (gap/reach + 0.1)) AS m0, sum(share * (1-hp) / (gap/reach + 0.1)) AS m1
               FROM pr JOIN xb ON gap BETWEEN x1*reach AND x2*reach GROUP BY ALL)
        SELECT mesh_id, face, axis::INT AS axis, xb::INT AS xb, 0 AS label, round(m0, 6) AS mass FROM su WHERE m0 <> 0
        UNION ALL SELECT mesh_id, face, axis::INT, xb::INT, 1, round(m1, 6) FROM su WHERE m1 <> 0""",
)
def axis_context(t):
    """Axes of the bounding box; two class probabilities per face, its height and the rest."""
    g = cut(geometry(t))
    box = mesh.bounding_box(vertices(t))
    rows = [
        F.struct(
            F.lit(i).alias("axis"), *[F.lit(1.0 if k == i else 0.0).alias(f"a{c}") for k, c in enumerate("xyz")],
            (col(f"max_{'xyz'[i]}") - col(f"min_{'xyz'[i]}")).alias("extent"),
        )
        for i in range(3)
    ]
    axes = box.select(M, F.inline(F.array(*rows)))
    p = g.select(M, "face", F.array("gz", 1 - col("gz")).alias("p"))
    return descriptors.axis_context(g, p, axes, 2).withColumn("mass", R("mass", 6))


@query("edge_context")
def edge_context(t):
    """Boundary probability by edge number; the reach covers the first ring of vertices."""
    g = cut(geometry(t))
    e = cut(edges.edge_ids(mesh.across_edges(faces(t))))
    n = mesh.smooth_face_normals(faces(t), mesh.vertex_normals(g))
    w = edges.edge_weights(e, g.select(M, "face", "area"))
    p = e.select(M, "edge", ((col("edge") % 5) / 4.0).alias("p"))
    paths = hops.bounded_distances(cut(vertex_edges(t)), vertices(t).select(M, col("v").alias("src")), 0.5, [M])
    out = edges.edge_context(e, p, w, g, n, vertices(t), paths, reach=1.2)
    return out.select(M, "edge", "xb", R("mass", 6).alias("mass"), R("coplanar", 6).alias("coplanar"))
