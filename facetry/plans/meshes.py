"""Queries over triangle meshes laid over the part table.

Every block of 500 consecutive parts is one mesh: parts are the vertices of a 25-column grid raised by
``p_size``, and each grid cell is split into two triangles.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from facetry.operators import derivatives, descriptors, hist, hops, mesh, scales, spheres, stats
from facetry.plans.registry import query
from facetry.session import cut, dealt

R, col = F.round, F.col
M = "mesh_id"

MESH = """vx AS (SELECT p_partkey // 500 AS mesh_id, p_partkey % 500 AS v, ((p_partkey % 500) % 25)::DOUBLE AS x,
                 ((p_partkey % 500) // 25)::DOUBLE AS y, p_size / 50.0 AS z FROM part),
       cell AS (SELECT mesh_id, v, 2 * ((y * 24) + x)::BIGINT AS f FROM vx WHERE x < 24 AND y < 19
                AND mesh_id * 500 + v + 26 < (SELECT count(*) FROM part)),
       fc AS (SELECT mesh_id, f AS face, v AS v0, v + 1 AS v1, v + 25 AS v2 FROM cell
              UNION ALL SELECT mesh_id, f + 1, v + 1, v + 26, v + 25 FROM cell)"""
GEO = MESH + """, pt AS (SELECT fc.*, a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS b_y, b.z AS bz,
                 c.x AS cx, c.y AS cy, c.z AS cz FROM fc
              JOIN vx a ON a.mesh_id = fc.mesh_id AND a.v = v0 JOIN vx b ON b.mesh_id = fc.mesh_id AND b.v = v1
              JOIN vx c ON c.mesh_id = fc.mesh_id AND c.v = v2),
       rn AS (SELECT *, (ay - b_y) * (bz - cz) - (az - bz) * (b_y - cy) AS rx,
                     (az - bz) * (bx - cx) - (ax - bx) * (bz - cz) AS ry,
                     (ax - bx) * (b_y - cy) - (ay - b_y) * (bx - cx) AS rz,
                     (ax + bx + cx) / 3 AS gx, (ay + b_y + cy) / 3 AS gy, (az + bz + cz) / 3 AS gz FROM pt),
       ge AS (SELECT *, 0.5 * sqrt(rx * rx + ry * ry + rz * rz) AS area FROM rn)"""
NORMALS = GEO + """, ln AS (SELECT *, (ax-bx)^2 + (ay-b_y)^2 + (az-bz)^2 AS la, (bx-cx)^2 + (b_y-cy)^2 + (bz-cz)^2 AS lb,
                 (cx-ax)^2 + (cy-ay)^2 + (cz-az)^2 AS lc FROM ge),
       sp AS (SELECT mesh_id, v0 AS v, rx / (la * lc) AS wx, ry / (la * lc) AS wy, rz / (la * lc) AS wz FROM ln
              UNION ALL SELECT mesh_id, v1, rx / (lb * la), ry / (lb * la), rz / (lb * la) FROM ln
              UNION ALL SELECT mesh_id, v2, rx / (lc * lb), ry / (lc * lb), rz / (lc * lb) FROM ln),
       sm AS (SELECT mesh_id, v, sum(wx) AS wx, sum(wy) AS wy, sum(wz) AS wz FROM sp GROUP BY ALL),
       vn AS (SELECT mesh_id, v, wx / sqrt(wx*wx + wy*wy + wz*wz) AS nx, wy / sqrt(wx*wx + wy*wy + wz*wz) AS ny,
                     wz / sqrt(wx*wx + wy*wy + wz*wz) AS nz FROM sm),
       co AS (SELECT mesh_id, face, unnest([v0, v1, v2]) AS v, unnest([0, 1, 2]) AS slot FROM fc),
       fs AS (SELECT mesh_id, face, sum(nx) AS wx, sum(ny) AS wy, sum(nz) AS wz FROM co JOIN vn USING (mesh_id, v) GROUP BY ALL),
       fn AS (SELECT mesh_id, face, wx / sqrt(wx*wx + wy*wy + wz*wz) AS nx, wy / sqrt(wx*wx + wy*wy + wz*wz) AS ny,
                     wz / sqrt(wx*wx + wy*wy + wz*wz) AS nz FROM fs)"""
EDGES = GEO + """, de AS (SELECT mesh_id, face, 0 AS slot, v1 AS p, v2 AS q FROM fc
              UNION ALL SELECT mesh_id, face, 1, v2, v0 FROM fc UNION ALL SELECT mesh_id, face, 2, v0, v1 FROM fc),
       ac AS (SELECT a.mesh_id, a.face, a.slot, a.p, a.q, min(b.face) AS nbr FROM de a LEFT JOIN de b
              ON a.mesh_id = b.mesh_id AND a.p = b.q AND a.q = b.p AND a.face <> b.face GROUP BY ALL),
       fg AS (SELECT ac.mesh_id, ac.face AS i, slot, nbr AS j,
                     sqrt((g.gx - (p.x + q.x) / 2)^2 + (g.gy - (p.y + q.y) / 2)^2 + (g.gz - (p.z + q.z) / 2)^2)
                   + sqrt((h.gx - (p.x + q.x) / 2)^2 + (h.gy - (p.y + q.y) / 2)^2 + (h.gz - (p.z + q.z) / 2)^2) AS w
              FROM ac JOIN ge g ON g.mesh_id = ac.mesh_id AND g.face = ac.face
              JOIN ge h ON h.mesh_id = ac.mesh_id AND h.face = nbr
              JOIN vx p ON p.mesh_id = ac.mesh_id AND p.v = ac.p JOIN vx q ON q.mesh_id = ac.mesh_id AND q.v = ac.q)"""
VE = """, ve AS (SELECT DISTINCT mesh_id, i, j, sqrt((a.x-b.x)^2 + (a.y-b.y)^2 + (a.z-b.z)^2) AS w FROM (
              SELECT mesh_id, p AS i, q AS j FROM de UNION SELECT mesh_id, q, p FROM de) e
              JOIN vx a USING (mesh_id) JOIN vx b USING (mesh_id) WHERE a.v = i AND b.v = j)"""


def vertices(t):
    key, local = col("p_partkey"), col("p_partkey") % 500
    return dealt(t.part).select(
        F.floor(key / 500).alias(M),
        local.alias("v"),
        (local % 25).cast("double").alias("x"),
        F.floor(local / 25).cast("double").alias("y"),
        (col("p_size") / 50.0).alias("z"),
    )


def faces(t):
    n = t.part.agg(F.count(F.lit(1))).scalar()
    v, x, y = col("v"), col("x").cast("long"), col("y").cast("long")
    cell = vertices(t).filter((x < 24) & (y < 19) & (col(M) * 500 + v + 26 < n))
    f = 2 * (y * 24 + x)
    two = F.array(
        F.struct(f.alias("face"), v.alias("v0"), (v + 1).alias("v1"), (v + 25).alias("v2")),
        F.struct((f + 1).alias("face"), (v + 1).alias("v0"), (v + 26).alias("v1"), (v + 25).alias("v2")),
    )
    return cell.select(M, F.inline(two))


def geometry(t):
    return mesh.face_geometry(faces(t), vertices(t))


def rounded(df, keys, digits=6, **renames):
    return df.select(*keys, *[R(v, digits).alias(n) for n, v in renames.items()])


@query(
    "mesh_face_geometry",
    f"""WITH {GEO} SELECT mesh_id, face, round(area, 6) AS area, round(gx, 6) AS gx, round(gz, 6) AS gz,
        round(rx, 6) AS rx, round(ry, 6) AS ry, round(rz, 6) AS rz FROM ge""",
)
def mesh_face_geometry(t):
    return rounded(geometry(t), [M, "face"], **{c: c for c in ("area", "gx", "gz", "rx", "ry", "rz")})


@query(
    "mesh_vertex_normals",
    f"WITH {NORMALS} SELECT mesh_id, v, round(nx, 6) AS nx, round(ny, 6) AS ny, round(nz, 6) AS nz FROM vn",
)
def mesh_vertex_normals(t):
    return rounded(mesh.vertex_normals(geometry(t)), [M, "v"], nx="nx", ny="ny", nz="nz")


@query(
    "mesh_face_normals",
    f"WITH {NORMALS} SELECT mesh_id, face, round(nx, 6) AS nx, round(ny, 6) AS ny, round(nz, 6) AS nz FROM fn",
)
def mesh_face_normals(t):
    n = mesh.smooth_face_normals(faces(t), mesh.vertex_normals(geometry(t)))
    return rounded(n, [M, "face"], nx="nx", ny="ny", nz="nz")


@query(
    "vertex_areas",
    f"""WITH {NORMALS} SELECT mesh_id, v, round(sum(area), 6) AS area
        FROM co JOIN ge USING (mesh_id, face) GROUP BY mesh_id, v""",
)
def vertex_areas(t):
    return rounded(mesh.vertex_areas(geometry(t)), [M, "v"], area="area")


@query(
    "voronoi_areas",
    f"""WITH {GEO}, e AS (SELECT mesh_id, v0, v1, v2, area, (cx-bx)^2 + (cy-b_y)^2 + (cz-bz)^2 AS l0,
             (ax-cx)^2 + (ay-cy)^2 + (az-cz)^2 AS l1, (bx-ax)^2 + (b_y-ay)^2 + (bz-az)^2 AS l2,
             (cx-bx)*(ax-cx) + (cy-b_y)*(ay-cy) + (cz-bz)*(az-cz) AS d01,
             (cx-bx)*(bx-ax) + (cy-b_y)*(b_y-ay) + (cz-bz)*(bz-az) AS d02,
             (ax-cx)*(bx-ax) + (ay-cy)*(b_y-ay) + (az-cz)*(bz-az) AS d12 FROM ge),
        w AS (SELECT *, l0*(l1+l2-l0) AS w0, l1*(l2+l0-l1) AS w1, l2*(l0+l1-l2) AS w2 FROM e),
        c AS (SELECT mesh_id, v0, v1, v2, CASE
              WHEN w0 <= 0 THEN [area + 0.25*l2*area/d02 + 0.25*l1*area/d01, -0.25*l2*area/d02, -0.25*l1*area/d01]
              WHEN w1 <= 0 THEN [-0.25*l2*area/d12, area + 0.25*l0*area/d01 + 0.25*l2*area/d12, -0.25*l0*area/d01]
              WHEN w2 <= 0 THEN [-0.25*l1*area/d12, -0.25*l0*area/d02, area + 0.25*l1*area/d12 + 0.25*l0*area/d02]
              ELSE [0.5*area/(w0+w1+w2)*(w1+w2), 0.5*area/(w0+w1+w2)*(w2+w0), 0.5*area/(w0+w1+w2)*(w0+w1)] END AS s FROM w),
        u AS (SELECT mesh_id, unnest([v0, v1, v2]) AS v, unnest(s) AS a FROM c)
        SELECT mesh_id, v, round(sum(a), 6) AS area FROM u GROUP BY ALL""",
)
def voronoi_areas(t):
    return rounded(mesh.voronoi_areas(geometry(t)), [M, "v"], area="area")


@query("shared_edge_self_join", f"WITH {EDGES} SELECT mesh_id, face, slot, p, q, nbr FROM ac")
def shared_edge_self_join(t):
    return mesh.across_edges(faces(t))


@query(
    "adjacency_rows",
    f"""WITH {EDGES} SELECT mesh_id, face, max(CASE WHEN slot = 0 THEN coalesce(nbr, face) END) AS n0,
        max(CASE WHEN slot = 1 THEN coalesce(nbr, face) END) AS n1,
        max(CASE WHEN slot = 2 THEN coalesce(nbr, face) END) AS n2 FROM ac GROUP BY ALL""",
)
def adjacency_rows(t):
    return mesh.adjacency_rows(mesh.across_edges(faces(t)))


@query("edge_midpoint_distance", f"WITH {EDGES} SELECT mesh_id, i, slot, j, round(w, 6) AS w FROM fg")
def edge_midpoint_distance(t):
    g = mesh.face_graph(mesh.across_edges(faces(t)), geometry(t), vertices(t))
    return g.withColumn("w", R("w", 6))


@query("vertex_neighbours", f"WITH {EDGES} SELECT mesh_id, p AS i, q AS j FROM de UNION SELECT mesh_id, q, p FROM de")
def vertex_neighbours(t):
    return mesh.vertex_neighbours(faces(t))


@query(
    "vertex_faces",
    f"WITH {MESH} SELECT mesh_id, unnest([v0, v1, v2]) AS v, face FROM fc",
)
def vertex_faces(t):
    return mesh.vertex_faces(faces(t))


@query(
    "edge_lengths",
    f"""WITH {EDGES} SELECT de.mesh_id, face, slot, round(sqrt((a.x-b.x)^2 + (a.y-b.y)^2 + (a.z-b.z)^2), 6) AS length
        FROM de JOIN vx a ON a.mesh_id = de.mesh_id AND a.v = p JOIN vx b ON b.mesh_id = de.mesh_id AND b.v = q""",
)
def edge_lengths(t):
    return rounded(mesh.edge_lengths(faces(t), vertices(t)), [M, "face", "slot"], length="length")


@query(
    "feature_size",
    f"""WITH {EDGES} SELECT de.mesh_id, round(median(sqrt((a.x-b.x)^2 + (a.y-b.y)^2 + (a.z-b.z)^2)), 6) AS median
        FROM de JOIN vx a ON a.mesh_id = de.mesh_id AND a.v = p JOIN vx b ON b.mesh_id = de.mesh_id AND b.v = q GROUP BY ALL""",
)
def feature_size(t):
    lengths = mesh.edge_lengths(faces(t), vertices(t))
    return stats.medians(lengths, [M], "length").withColumn("median", R("median", 6))


@query(
    "dihedral_edge_features",
    f"""WITH {EDGES}, tn AS (SELECT ac.mesh_id, ac.face, ac.slot, nbr,
             g.ry*h.rz - g.rz*h.ry AS tx, g.rz*h.rx - g.rx*h.rz AS ty, g.rx*h.ry - g.ry*h.rx AS tz,
             g.rx*h.rx + g.ry*h.ry + g.rz*h.rz AS dt, q.x-p.x AS ex, q.y-p.y AS ey, q.z-p.z AS ez
             FROM ac JOIN ge g ON g.mesh_id = ac.mesh_id AND g.face = ac.face
             JOIN ge h ON h.mesh_id = ac.mesh_id AND h.face = nbr
             JOIN vx p ON p.mesh_id = ac.mesh_id AND p.v = ac.p JOIN vx q ON q.mesh_id = ac.mesh_id AND q.v = ac.q),
        an AS (SELECT mesh_id, face, slot, (pi() + atan2(sqrt(tx*tx + ty*ty + tz*tz), dt)
               * CASE WHEN tx*ex + ty*ey + tz*ez < 0 THEN -1 ELSE 1 END) / pi() AS a FROM tn)
        SELECT mesh_id, face, slot, round(a, 6) AS p1, round(a^2, 6) AS p2, round(a^3, 6) AS p3, round(a^5, 6) AS p5,
               round(a^10, 5) AS p10 FROM an""",
)
def dihedral_edge_features(t):
    from facetry.functions.scalar import powers

    a = mesh.dihedral_angles(mesh.across_edges(faces(t)), geometry(t), vertices(t))
    names = [1, 2, 3, 5, 10]
    return a.select(
        M, "face", "slot", *[R(c, 5 if p == 10 else 6).alias(f"p{p}") for p, c in zip(names, powers(col("angle"), names))]
    )


@query(
    "bbox",
    """SELECT label, min(embedding[1])::DOUBLE AS x0, max(embedding[1])::DOUBLE AS x1, min(embedding[2])::DOUBLE AS y0,
              max(embedding[2])::DOUBLE AS y1 FROM embeddings GROUP BY ALL""",
)
def bbox(t):
    x, y = (col("embedding")[i].cast("double") for i in (0, 1))
    return t.embeddings.groupBy("label").agg(
        F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1")
    )


@query(
    "mesh_bbox",
    f"""WITH {MESH} SELECT mesh_id, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y,
        min(z) AS min_z, max(z) AS max_z FROM vx GROUP BY ALL""",
)
def mesh_bbox(t):
    return mesh.bounding_box(vertices(t))


@query(
    "weighted_centroid",
    f"""WITH {GEO} SELECT mesh_id, round(sum(gx*area)/sum(area), 6) AS mx, round(sum(gy*area)/sum(area), 6) AS my,
        round(sum(gz*area)/sum(area), 6) AS mz, round(sum(area), 6) AS total_area FROM ge GROUP BY ALL""",
)
def weighted_centroid(t):
    return rounded(mesh.mass_centre(geometry(t)), [M], mx="mx", my="my", mz="mz", total_area="total_area")


@query(
    "mesh_covariance",
    f"""WITH {GEO}, m AS (SELECT mesh_id, sum(gx*area)/sum(area) AS mx, sum(gy*area)/sum(area) AS my,
             sum(gz*area)/sum(area) AS mz FROM ge GROUP BY ALL)
        SELECT mesh_id, round(sum((gx-mx)^2*area)/sum(area), 5) AS cxx, round(sum((gx-mx)*(gy-my)*area)/sum(area), 5) AS cxy,
               round(sum((gx-mx)*(gz-mz)*area)/sum(area), 5) AS cxz, round(sum((gy-my)^2*area)/sum(area), 5) AS cyy,
               round(sum((gy-my)*(gz-mz)*area)/sum(area), 5) AS cyz, round(sum((gz-mz)^2*area)/sum(area), 6) AS czz FROM ge JOIN m USING (mesh_id) GROUP BY ALL""",
)
def mesh_covariance(t):
    c = mesh.covariance(geometry(t))
    return c.select(M, *[R(f"c{k}", 6 if k == "zz" else 5).alias(f"c{k}") for k in ("xx", "xy", "xz", "yy", "yz", "zz")])


@query(
    "scatter_matrix3",
    """WITH e AS (SELECT label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings)
       SELECT label, round(sum(x*x), 6) AS sxx, round(sum(x*y), 6) AS sxy, round(sum(x*z), 6) AS sxz,
              round(sum(y*y), 6) AS syy, round(sum(y*z), 6) AS syz, round(sum(z*z), 6) AS szz FROM e GROUP BY ALL""",
)
def scatter_matrix3(t):
    x, y, z = (col("embedding")[i].cast("double") for i in range(3))
    return t.embeddings.groupBy("label").agg(*[R(c, 6).alias(n) for n, c in stats.scatter3(x, y, z).items()])


@query(
    "pca3_eigen",
    """WITH s AS (SELECT label, sum(x*x) AS xx, sum(x*y) AS xy, sum(x*z) AS xz, sum(y*y) AS yy, sum(y*z) AS yz, sum(z*z) AS zz
          FROM (SELECT label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings)
          GROUP BY label),
        c AS (SELECT *, xx+yy+zz AS tr, xx*yy+xx*zz+yy*zz-xy*xy-xz*xz-yz*yz AS mi,
                xx*(yy*zz-yz*yz)-xy*(xy*zz-yz*xz)+xz*(xy*yz-yy*xz) AS de FROM s),
        d AS (SELECT *, sqrt(greatest(tr*tr-3*mi, 0)) AS r FROM c),
        -- roots of the characteristic polynomial by Viete's cosines
        a AS (SELECT *, acos(greatest(-1, least(1, (2*tr^3-9*tr*mi+27*de)/(2*r^3))))/3 AS phi FROM d)
        SELECT label, round((tr + 2*r*cos(phi + 2*pi()/3))/3, 6) AS e0, round((tr + 2*r*cos(phi - 2*pi()/3))/3, 6) AS e1,
               round((tr + 2*r*cos(phi))/3, 6) AS e2 FROM a""",
)
def pca3_eigen(t):
    x, y, z = (col("embedding")[i].cast("double") for i in range(3))
    s = t.embeddings.groupBy("label").agg(*[c.alias(n) for n, c in stats.scatter3(x, y, z).items()])
    eig = stats.symmetric3_eigenvalues(*[col(c) for c in ("sxx", "sxy", "sxz", "syy", "syz", "szz")])
    return s.select("label", *[R(c, 6).alias(f"e{i}") for i, c in enumerate(eig)])


NORMALISE = GEO + """, m AS (SELECT mesh_id, sum(gx*area)/sum(area) AS mx, sum(gy*area)/sum(area) AS my,
             sum(gz*area)/sum(area) AS mz FROM ge GROUP BY ALL),
        d AS (SELECT mesh_id, sqrt((gx-mx)^2 + (gy-my)^2 + (gz-mz)^2) AS d FROM ge JOIN m USING (mesh_id)),
        r AS (SELECT mesh_id, d, row_number() OVER (PARTITION BY mesh_id ORDER BY d) - 1 AS rn,
                     count(*) OVER (PARTITION BY mesh_id) AS n FROM d),
        s AS (SELECT mesh_id, d * (0.5 / 0.33) AS scale FROM r WHERE rn = floor(0.33 * n))"""


@query(
    "mesh_normalise",
    f"""WITH {NORMALISE} SELECT mesh_id, v, round((x-mx)/scale, 6) AS x, round((y-my)/scale, 6) AS y,
        round((z-mz)/scale, 6) AS z FROM vx JOIN m USING (mesh_id) JOIN s USING (mesh_id)""",
)
def mesh_normalise(t):
    out = mesh.normalise(vertices(t), mesh.mesh_scale(geometry(t)))
    return rounded(out, [M, "v"], x="x", y="y", z="z")


# ------------------------------------------------------------------ editing

KEPT = """kv AS (SELECT *, row_number() OVER (PARTITION BY mesh_id ORDER BY v) - 1 AS nv FROM vx WHERE x >= 3 AND z < 0.9)"""


@query(
    "clip_vertices",
    f"WITH {MESH}, {KEPT} SELECT mesh_id, nv AS v, x, y, round(z, 6) AS z FROM kv",
)
def clip_vertices(t):
    v, _ = mesh.keep_vertices(vertices(t), faces(t), (col("x") >= 3) & (col("z") < 0.9))
    return v.withColumn("z", R("z", 6))


@query(
    "clip_faces",
    f"""WITH {MESH}, {KEPT} SELECT fc.mesh_id, row_number() OVER (PARTITION BY fc.mesh_id ORDER BY face) - 1 AS face,
        a.nv AS v0, b.nv AS v1, c.nv AS v2 FROM fc JOIN kv a ON a.mesh_id = fc.mesh_id AND a.v = v0
        JOIN kv b ON b.mesh_id = fc.mesh_id AND b.v = v1 JOIN kv c ON c.mesh_id = fc.mesh_id AND c.v = v2""",
)
def clip_faces(t):
    return mesh.keep_vertices(vertices(t), faces(t), (col("x") >= 3) & (col("z") < 0.9))[1]


@query(
    "sliver_filter",
    f"""WITH {GEO}, s AS (SELECT mesh_id, face, unnest([[ax,ay,az,bx,b_y,bz,cx,cy,cz],[bx,b_y,bz,cx,cy,cz,ax,ay,az],
             [cx,cy,cz,ax,ay,az,bx,b_y,bz]]) AS k FROM ge),
        e AS (SELECT mesh_id, face, (k[4]-k[1])^2+(k[5]-k[2])^2+36*(k[6]-k[3])^2 AS l1,
              (k[7]-k[1])^2+(k[8]-k[2])^2+36*(k[9]-k[3])^2 AS l2,
              (k[4]-k[1])*(k[7]-k[1])+(k[5]-k[2])*(k[8]-k[2])+36*(k[6]-k[3])*(k[9]-k[3]) AS d FROM s)
        SELECT DISTINCT mesh_id, face FROM e WHERE greatest(l1, l2) >= 1.44 AND d*d/(l1*l2) >= 0.85""",
)
def sliver_filter(t):
    steep = vertices(t).withColumn("z", col("z") * 6)
    return mesh.sliver_faces(faces(t), steep, 0.3)


@query("face_flip", f"WITH {MESH} SELECT mesh_id, face, v2 AS v0, v1, v0 AS v2 FROM fc")
def face_flip(t):
    return mesh.flip_faces(faces(t))


@query(
    "erode_boundary",
    f"""WITH {EDGES}, b AS (SELECT DISTINCT mesh_id, unnest([p, q]) AS v FROM ac WHERE nbr IS NULL)
        SELECT mesh_id, face, v0, v1, v2 FROM fc WHERE NOT EXISTS
          (SELECT 1 FROM b WHERE b.mesh_id = fc.mesh_id AND b.v IN (v0, v1, v2))""",
)
def erode_boundary(t):
    return mesh.erode(faces(t))


@query(
    "affine_transform",
    f"""WITH {MESH} SELECT mesh_id, v, round(0.8*x - 0.6*y + 1, 6) AS x, round(0.6*x + 0.8*y - 2, 6) AS y,
        round(2*z + 0.5, 6) AS z FROM vx""",
)
def affine_transform(t):
    m = [[0.8, -0.6, 0.0, 1.0], [0.6, 0.8, 0.0, -2.0], [0.0, 0.0, 2.0, 0.5]]
    return rounded(mesh.transform(vertices(t), m), [M, "v"], x="x", y="y", z="z")


@query(
    "inflate_mesh",
    f"""WITH {NORMALS} SELECT mesh_id, v, round(x + 0.1*nx, 6) AS x, round(y + 0.1*ny, 6) AS y, round(z + 0.1*nz, 6) AS z
        FROM vx JOIN vn USING (mesh_id, v)""",
)
def inflate_mesh(t):
    out = mesh.inflate(vertices(t), mesh.vertex_normals(geometry(t)), 0.1)
    return rounded(out, [M, "v"], x="x", y="y", z="z")


@query(
    "umbrella_smooth",
    f"""WITH {EDGES}{VE}, b AS (SELECT DISTINCT mesh_id, unnest([p, q]) AS v FROM ac WHERE nbr IS NULL),
        a AS (SELECT e.mesh_id, e.i AS v, avg(n.x) AS ax, avg(n.y) AS ay, avg(n.z) AS az FROM ve e
              JOIN vx n ON n.mesh_id = e.mesh_id AND n.v = e.j GROUP BY ALL)
        SELECT vx.mesh_id, vx.v, round(CASE WHEN b.v IS NULL AND a.v IS NOT NULL THEN x + 0.5*(ax-x) ELSE x END, 6) AS x,
               round(CASE WHEN b.v IS NULL AND a.v IS NOT NULL THEN y + 0.5*(ay-y) ELSE y END, 6) AS y,
               round(CASE WHEN b.v IS NULL AND a.v IS NOT NULL THEN z + 0.5*(az-z) ELSE z END, 6) AS z
        FROM vx LEFT JOIN a ON a.mesh_id = vx.mesh_id AND a.v = vx.v
        LEFT JOIN b ON b.mesh_id = vx.mesh_id AND b.v = vx.v""",
)
def umbrella_smooth(t):
    return rounded(mesh.smooth(vertices(t), faces(t), 0.5), [M, "v"], x="x", y="y", z="z")


@query(
    "subdivide_faces",
    f"""WITH {EDGES}, ue AS (SELECT mesh_id, least(p, q) AS lo, greatest(p, q) AS hi, min(face*3 + slot) AS fst FROM de GROUP BY ALL),
        nn AS (SELECT mesh_id, max(v) + 1 AS n FROM vx GROUP BY ALL),
        mi AS (SELECT ue.mesh_id, lo, hi, n + row_number() OVER (PARTITION BY ue.mesh_id ORDER BY fst) - 1 AS m
               FROM ue JOIN nn USING (mesh_id)),
        em AS (SELECT de.mesh_id, face, slot, m FROM de JOIN mi ON mi.mesh_id = de.mesh_id AND lo = least(p, q) AND hi = greatest(p, q)),
        fm AS (SELECT fc.*, a.m AS m0, b.m AS m1, c.m AS m2 FROM fc
               JOIN em a ON a.mesh_id = fc.mesh_id AND a.face = fc.face AND a.slot = 0
               JOIN em b ON b.mesh_id = fc.mesh_id AND b.face = fc.face AND b.slot = 1
               JOIN em c ON c.mesh_id = fc.mesh_id AND c.face = fc.face AND c.slot = 2)
        SELECT mesh_id, face*4 AS face, v0, m2 AS v1, m1 AS v2 FROM fm
        UNION ALL SELECT mesh_id, face*4+1, m2, v1, m0 FROM fm UNION ALL SELECT mesh_id, face*4+2, m1, m0, v2 FROM fm
        UNION ALL SELECT mesh_id, face*4+3, m0, m1, m2 FROM fm""",
)
def subdivide_faces(t):
    return mesh.subdivide(vertices(t), faces(t))[1]


@query(
    "reorder_vertices",
    f"""WITH {MESH}, s AS (SELECT mesh_id, unnest([v0, v1, v2]) AS v, face*3 + unnest([0, 1, 2]) AS k FROM fc),
        f AS (SELECT mesh_id, v, min(k) AS k FROM s GROUP BY ALL)
        SELECT mesh_id, v, row_number() OVER (PARTITION BY mesh_id ORDER BY k) - 1 AS new_v FROM f""",
)
def reorder_vertices(t):
    return mesh.reorder_vertices(vertices(t), faces(t))


# ------------------------------------------------------------------ traversal


def vertex_edges(t):
    v = vertices(t)
    e = mesh.vertex_neighbours(faces(t))
    a = v.selectExpr(M, "v as i", "x as px", "y as py", "z as pz")
    b = v.selectExpr(M, "v as j", "x as qx", "y as qy", "z as qz")
    from facetry.functions.vectors import len3, sub3, vec3

    return e.join(a, [M, "i"]).join(b, [M, "j"]).select(M, "i", "j", len3(sub3(vec3("p"), vec3("q"))).alias("w"))


def face_edges(t):
    g = mesh.face_graph(mesh.across_edges(faces(t)), geometry(t), vertices(t))
    return g.select(M, "i", "j", "w")


@query(
    "bounded_shortest_path",
    f"""WITH RECURSIVE {EDGES}{VE}, walk AS (SELECT mesh_id, v AS src, v AS node, 0.0::DOUBLE AS d, 0 AS n FROM vx
          UNION SELECT walk.mesh_id, src, j, d + w, n + 1 FROM walk JOIN ve ON ve.mesh_id = walk.mesh_id AND ve.i = node
                WHERE d <= 1.5 AND n < 3 AND j <> src)
        SELECT mesh_id, src, node, round(min(d), 6) AS d FROM walk GROUP BY ALL""",
)
def bounded_shortest_path(t):
    sources = vertices(t).select(M, col("v").alias("src"))
    out = hops.bounded_distances(cut(vertex_edges(t)), sources, 1.5, [M])
    return out.withColumn("d", R("d", 6))


@query(
    "nearest_by_path",
    f"""WITH RECURSIVE {EDGES}, walk AS (SELECT mesh_id, face AS src, face AS node, 0.0::DOUBLE AS d, 0 AS n FROM fc
          UNION SELECT walk.mesh_id, src, j, d + w, n + 1 FROM walk JOIN fg ON fg.mesh_id = walk.mesh_id AND fg.i = node
                WHERE n < 3),
        b AS (SELECT mesh_id, src, node, min(d) AS d FROM walk GROUP BY ALL)
        SELECT mesh_id, src, node, round(d, 6) AS d FROM b
        QUALIFY row_number() OVER (PARTITION BY mesh_id, src ORDER BY d, node) <= 4""",
)
def nearest_by_path(t):
    sources = faces(t).select(M, col("face").alias("src"))
    out = hops.nearest_by_path(cut(face_edges(t)), sources, 4, [M])
    return out.select(M, "src", "node", R("d", 6).alias("d"))


# ------------------------------------------------------------------ histograms and descriptors


@query(
    "hist2d_hard",
    """WITH xb AS (SELECT i AS xb, 50.0 * i / 5 AS x1, 50.0 * (i + 1) / 5 AS x2 FROM range(0, 5) r(i)),
            yb AS (SELECT i AS yb, 900.0 + 100.0 * i / 4 AS y1, 900.0 + 100.0 * (i + 1) / 4 AS y2 FROM range(0, 4) r(i))
       SELECT p_brand, xb::INT AS xb, yb::INT AS yb, round(sum(p_size / 50.0), 6) AS mass FROM part
       JOIN xb ON p_size BETWEEN x1 AND x2 JOIN yb ON p_retailprice BETWEEN y1 AND y2 GROUP BY ALL""",
)
def hist2d_hard(t):
    xs, ys = hist.log_edges(5, 50.0, 0.0), hist.equal_edges(4, 900.0, 1000.0)
    out = hist.hard(t.part, ["p_brand"], col("p_size").cast("double"), col("p_retailprice"), col("p_size") / 50.0, xs, ys)
    return out.withColumn("mass", R("mass", 6))


@query(
    "log_bin_edges",
    """WITH m AS (SELECT p_brand, max(p_retailprice) AS reach FROM part GROUP BY ALL)
       SELECT p_brand, i AS edge, CASE WHEN i = 0 THEN 0.0 ELSE
              round(pow(-ln((6.0 - i) / 6.0), 0.9) * reach / pow(ln(6.0), 0.9), 4) END AS value
       FROM m CROSS JOIN range(0, 6) r(i)""",
)
def log_bin_edges(t):
    m = t.part.groupBy("p_brand").agg(F.max("p_retailprice").alias("reach"))
    rows = m.select("p_brand", "reach", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("edge"))
    value = hist.log_edge_column(col("edge").cast("double"), 5, col("reach"))
    return rows.select("p_brand", col("edge").cast("long").alias("edge"), R(value, 4).alias("value"))


@query(
    "hist2d_soft",
    """WITH p AS (SELECT vec_id, label, (embedding[1]::DOUBLE + 0.5) * 10 AS ic, (embedding[2]::DOUBLE + 0.5) * 10 AS jc FROM embeddings),
            c AS (SELECT vec_id, label, x AS xb, y AS yb, exp(-((ic-x-0.5)^2 + (jc-y-0.5)^2) / 0.2) AS w FROM p
                  CROSS JOIN range(0, 10) a(x) CROSS JOIN range(0, 10) b(y)
                  WHERE abs(ic-x-0.5) <= 2.5 AND abs(jc-y-0.5) <= 2.5),
            n AS (SELECT *, w / sum(w) OVER (PARTITION BY vec_id) AS m FROM c WHERE w >= 0.02)
       SELECT label, xb::INT AS xb, yb::INT AS yb, round(sum(m * 0.25), 6) AS mass FROM n GROUP BY ALL""",
)
def hist2d_soft(t):
    ic, jc = ((col("embedding")[i].cast("double") + 0.5) * 10 for i in (0, 1))
    return hist.soft(t.embeddings, ["label"], ic, jc, F.lit(0.25)).withColumn("mass", R("mass", 6))


@query(
    "all_pairs_moments",
    """WITH e AS (SELECT label, vec_id, embedding::DOUBLE[] AS v, (1 + vec_id % 7)::DOUBLE AS w FROM embeddings),
            d AS (SELECT a.label, a.vec_id AS id, b.w, list_distance(a.v, b.v) AS d FROM e a JOIN e b ON a.label = b.label)
       SELECT label, id, round(sum(d*w)/sum(w), 6) AS mean, round(sum(d*d*w)/sum(w), 6) AS mean2,
              round(sum(sqrt(d)*w)/sum(w), 6) AS meansqrt FROM d GROUP BY ALL""",
)
def all_pairs_moments(t):
    w = (1 + col("vec_id") % 7).cast("double")
    out = descriptors.distance_moments(t.embeddings, ["label"], "vec_id", "embedding", w)
    return rounded(out, ["label", "id"], mean="mean", mean2="mean2", meansqrt="meansqrt")


@query(
    "spin_image",
    f"""WITH {NORMALS}, va AS (SELECT co.mesh_id, co.v, sum(area) AS area FROM co JOIN ge USING (mesh_id, face) GROUP BY ALL),
        vs AS (SELECT mesh_id, v, area / sum(area) OVER (PARTITION BY mesh_id) AS share FROM va),
        pr AS (SELECT g.mesh_id, g.face, x - gx AS dx, y - gy AS dy, z - gz AS dz, fn.nx, fn.ny, fn.nz, share
               FROM ge g JOIN fn ON fn.mesh_id = g.mesh_id AND fn.face = g.face JOIN vx ON vx.mesh_id = g.mesh_id
               JOIN vn ON vn.mesh_id = vx.mesh_id AND vn.v = vx.v JOIN vs ON vs.mesh_id = vx.mesh_id AND vs.v = vx.v
               WHERE vn.nx*fn.nx + vn.ny*fn.ny + vn.nz*fn.nz >= 0),
        be AS (SELECT *, nx*dx + ny*dy + nz*dz AS beta, dx*dx + dy*dy + dz*dz AS l2 FROM pr),
        ij AS (SELECT mesh_id, face, share, row_number() OVER () AS k, (4.0 - beta/2) / 0.8 AS ic,
                      sqrt(greatest(l2 - beta*beta, 0)) / 0.8 AS jc FROM be),
        ne AS (SELECT * FROM ij WHERE ic > -1 AND ic < 11 AND jc < 11),
        ce AS (SELECT k, mesh_id, face, share, x, y, exp(-((ic-x-0.5)^2 + (jc-y-0.5)^2)/0.2) AS w FROM ne
               JOIN range(0, 10) a(x) ON abs(ic-x-0.5) < 1 JOIN range(0, 10) b(y) ON abs(jc-y-0.5) < 1),
        nw AS (SELECT *, w / sum(w) OVER (PARTITION BY k) AS m FROM ce WHERE w >= 0.02)
        SELECT mesh_id, face, (x*10 + y)::INT AS cell, round(sum(m*share), 6) AS mass FROM nw GROUP BY ALL""",
)
def spin_image(t):
    g = cut(geometry(t))
    vn = cut(mesh.vertex_normals(g))
    fn = mesh.smooth_face_normals(faces(t), vn)
    out = descriptors.spin_images(g, fn, vertices(t), vn, mesh.vertex_areas(g), support=8.0)
    return out.withColumn("mass", R("mass", 6))


#: Every face's shortest paths to all others: a walk that keeps the least distance per pair and goes on where one improved.
ALL_PATHS = """walk(mesh_id, src, node, d) USING KEY (mesh_id, src, node) AS (
          SELECT mesh_id, face, face, 0.0::DOUBLE FROM fc
          UNION SELECT a.mesh_id, a.src, a.j, min(a.d) FROM (
            SELECT walk.mesh_id, src, j, d + w AS d FROM walk JOIN fg ON fg.mesh_id = walk.mesh_id AND fg.i = node) a
            LEFT JOIN recurring.walk r ON r.mesh_id = a.mesh_id AND r.src = a.src AND r.node = a.j
            WHERE r.d IS NULL OR a.d < r.d GROUP BY a.mesh_id, a.src, a.j),
        pa AS (SELECT mesh_id, src, node, d FROM walk)"""
WHOLE_PATCH = f"{EDGES.replace(GEO, NORMALS)}, {ALL_PATHS}"


@query(
    "geodesic_statistics",
    f"""WITH RECURSIVE {WHOLE_PATCH}, ta AS (SELECT mesh_id, sum(area) AS total FROM ge GROUP BY ALL),
        r AS (SELECT pa.mesh_id, src, d, area / total AS w FROM pa JOIN ge ON ge.mesh_id = pa.mesh_id AND ge.face = node
              JOIN ta ON ta.mesh_id = pa.mesh_id),
        s AS (SELECT mesh_id, src, sum(d*w) AS g0, sum(d*d*w) AS g1, sum(sqrt(d)*w) AS g4 FROM r GROUP BY ALL),
        c AS (SELECT r.mesh_id, r.src, sum((d-g0)^2*w) AS g6 FROM r JOIN s ON s.mesh_id = r.mesh_id AND s.src = r.src GROUP BY ALL)
        SELECT mesh_id, src AS face, round(g0 - min(g0) OVER w, 6) AS g0, round(g1 - min(g1) OVER w, 6) AS g1,
               round(g4 - min(g4) OVER w, 6) AS g4, round(g6 - min(g6) OVER w, 6) AS g6
        FROM s JOIN c USING (mesh_id, src) WINDOW w AS (PARTITION BY mesh_id)""",
)
def geodesic_statistics(t):
    g = cut(geometry(t))
    paths = hops.bounded_distances(cut(face_edges(t)), g.select(M, col("face").alias("src")), None, [M])
    out = descriptors.geodesic_statistics(paths, g.select(M, "face", "area"))
    return rounded(out, [M, "face"], g0="g0", g1="g1", g4="g4", g6="g6")


@query(
    "shape_context",
    f"""WITH RECURSIVE {WHOLE_PATCH}, ta AS (SELECT mesh_id, sum(area) AS total FROM ge GROUP BY ALL),
        dr AS (SELECT pa.mesh_id, src AS face, d, h.gx - g.gx AS lx, h.gy - g.gy AS ly, h.gz - g.gz AS lz,
                      -fn.nx AS bx, -fn.ny AS b_y, -fn.nz AS bz, h.area / total AS share
               FROM pa JOIN ge g ON g.mesh_id = pa.mesh_id AND g.face = src JOIN ge h ON h.mesh_id = pa.mesh_id AND h.face = node
               JOIN fn ON fn.mesh_id = pa.mesh_id AND fn.face = node JOIN ta ON ta.mesh_id = pa.mesh_id WHERE src <> node),
        an AS (SELECT mesh_id, face, d, share / (d / 2.0 + 0.1) AS mass, degrees(atan2(sqrt((ly*bz-lz*b_y)^2 + (lz*bx-lx*bz)^2
                      + (lx*b_y-ly*bx)^2), lx*bx + ly*b_y + lz*bz)) - 90.0 AS angle FROM dr),
        xb AS (SELECT i AS xb, pow(-ln((6.0-i)/6.0), 0.9) * 2.4 / pow(ln(6.0), 0.9) AS x1,
                      pow(-ln((5.0-i)/6.0), 0.9) * 2.4 / pow(ln(6.0), 0.9) AS x2 FROM range(0, 5) r(i)),
        yb AS (SELECT i AS yb, -90.0 + 180.0 * i / 4 AS y1, -90.0 + 180.0 * (i + 1) / 4 AS y2 FROM range(0, 4) r(i))
        SELECT mesh_id, face, 0 AS layout, xb::INT AS xb, yb::INT AS yb, round(sum(mass), 6) AS mass FROM an
        JOIN xb ON d BETWEEN x1 AND x2 JOIN yb ON angle BETWEEN y1 AND y2 GROUP BY ALL""",
)
def shape_context(t):
    g = cut(geometry(t))
    n = mesh.smooth_face_normals(faces(t), mesh.vertex_normals(g))
    paths = hops.bounded_distances(cut(face_edges(t)), g.select(M, col("face").alias("src")), None, [M])
    out = descriptors.shape_context(paths, g, n, reach=2.0, layouts=[(5, 4)])
    return out.withColumn("mass", R("mass", 6))


@query("pca_descriptor")
def pca_descriptor(t):
    g = cut(geometry(t))
    n = cut(mesh.smooth_face_normals(faces(t), mesh.vertex_normals(g)))
    return descriptors.pca_descriptor(cut(face_edges(t)), n, g, scales=[0.4])


@query("curvature_descriptor")
def curvature_descriptor(t):
    g = cut(geometry(t))
    n = cut(mesh.smooth_face_normals(faces(t), mesh.vertex_normals(g)))
    across = cut(mesh.across_edges(faces(t)))
    return descriptors.curvature_descriptor(cut(face_edges(t)), across, n, g, scales=[2.0])


@query("graph_preparation")
def graph_preparation(t):
    """Training rows of all meshes: kernel graph, two coarsenings, tree order, padding."""
    from facetry.plans.jobs import prepare_graphs

    g = cut(geometry(t))
    near = mesh.across_edges(faces(t)).select(M, col("face").alias("src"), "slot", col("nbr").alias("dst"))
    features = g.select(M, "face", F.array("gz", "area").alias("f"))
    labels = g.select(M, "face", (1 + col("face") % 3).alias("label"))
    return prepare_graphs(features, near, labels, g.select(M, "face", "area"), levels=2, k=4)["rows"].drop("f")


def _sql_dot(a, b):
    return "(" + " + ".join(f"{x}*{y}" for x, y in zip(a, b)) + ")"


def _sql_less(a, b):
    return [f"({x} - {y})" for x, y in zip(a, b)]


def _sql_product(left, right, rows=range(3), columns=range(3)):
    """Entries ``(i, j)`` of a product of 3x3 matrices given as functions from indices to SQL."""
    return {(i, j): " + ".join(f"({left(i, k)})*({right(k, j)})" for k in range(3)) for i in rows for j in columns}


def curvature_tables() -> str:
    """Curvatures as invariants of averaged 3x3 matrices in world axes; no tangent frame takes part.

    In a face's plane, with P = I - f f', A = sum(e e') and C = sum(d e' + e d') over its edges e and the flat parts d of the
    changes of the normals, the tensor S of least error solves S A + A S = C; since the adjugate of A is tr(A) P - A,
    S = (det C + (tr P - A) C (tr P - A)) / (2 tr det) with det = (tr(A)^2 - tr(A^2)) / 2.  A rotation R that takes the
    vertex normal to the face normal gives the vertex R' S R.  The mean M of these has the eigenvalue 0 along the normal, so
    the curvatures are the roots of k^2 - tr(M) k + the sum of M's principal minors.
    """
    at = {"a": ["ax", "ay", "az"], "b": ["bx", "b_y", "bz"], "c": ["cx", "cy", "cz"]}
    nrm = {c: [f"{c}m{k}" for k in "xyz"] for c in "abc"}
    f, n, six = ["fx", "fy", "fz"], ["nx", "ny", "nz"], [(i, j) for i in range(3) for j in range(i, 3)]
    sides = []
    for i, j in ("ab", "bc", "ca"):
        change = _sql_less(nrm[j], nrm[i])
        flat = [f"{d} - ({_sql_dot(change, f)})*{x}" for d, x in zip(change, f)]
        columns = [f"{e} AS e{k}" for k, e in enumerate(_sql_less(at[j], at[i]))] + [f"{d} AS d{k}" for k, d in enumerate(flat)]
        sides.append(f"SELECT mesh_id, face, fx, fy, fz, {', '.join(columns)} FROM fb")
    corners = []
    for v, (i, j, k) in enumerate(("abc", "bca", "cab")):
        inner = {x: _sql_dot(_sql_less(at[y], at[x]), _sql_less(at[z], at[x])) for x, y, z in ((i, j, k), (j, k, i), (k, i, j))}
        lj, lk = (_sql_dot(_sql_less(at[x], at[i]), _sql_less(at[x], at[i])) for x in (j, k))
        corners.append(
            f"SELECT mesh_id, face, v{v} AS v, CASE WHEN {inner[i]} <= 0 THEN area - {lj}*area/(4*{inner[j]}) - {lk}*area/(4*{inner[k]}) "
            f"WHEN {inner[j]} <= 0 THEN {lj}*area/(4*{inner[i]}) WHEN {inner[k]} <= 0 THEN {lk}*area/(4*{inner[i]}) "
            f"ELSE ({lj}*{inner[k]} + {lk}*{inner[j]})/(16*area) END AS w FROM ge"
        )
    entry = lambda name: lambda i, j: f"{name}{min(i, j)}{max(i, j)}"
    sums = [f"sum(e{i}*e{j}) AS a{i}{j}, sum(d{i}*e{j} + e{i}*d{j}) AS c{i}{j}" for i, j in six]
    square = " + ".join(f"{1 if i == j else 2}*a{i}{j}^2" for i, j in six)
    adjugate = [f"tr*({int(i == j)} - {f[i]}*{f[j]}) - a{i}{j} AS g{i}{j}" for i, j in six]
    left = _sql_product(entry("g"), entry("c"))
    both = _sql_product(lambda i, k: f"h{i}{k}", entry("g"))
    tensor = [f"(det*c{i}{j} + {both[i, j]})/(2*tr*det) AS s{i}{j}" for i, j in six]
    x = ["ny*fz - nz*fy", "nz*fx - nx*fz", "nx*fy - ny*fx"]
    skew = {(0, 1): "-x2", (0, 2): "x1", (1, 0): "x2", (1, 2): "-x0", (2, 0): "-x1", (2, 1): "x0"}
    rotation = [f"{'t' if i == j else skew[i, j]} + x{i}*x{j}/(1 + t) AS r{i}{j}" for i in range(3) for j in range(3)]
    half = _sql_product(entry("s"), lambda k, j: f"r{k}{j}")
    turned = _sql_product(lambda i, k: f"r{k}{i}", lambda k, j: f"q{k}{j}")
    named = lambda name, entries: ", ".join(f"{e} AS {name}{i}{j}" for (i, j), e in entries.items())
    mean = ", ".join(f"sum(w*({turned[i, j]}))/sum(w) AS m{i}{j}" for i, j in six)
    minors = "m00*m11 - m01^2 + m00*m22 - m02^2 + m11*m22 - m12^2"
    return f"""WITH {NORMALS},
      fa AS (SELECT ge.*, rx/(2*area) AS fx, ry/(2*area) AS fy, rz/(2*area) AS fz FROM ge),
      fb AS (SELECT fa.*, {", ".join(f"{c}.n{k} AS {c}m{k}" for c in "abc" for k in "xyz")} FROM fa
             {" ".join(f"JOIN vn {c} ON {c}.mesh_id = fa.mesh_id AND {c}.v = v{i}" for i, c in enumerate("abc"))}),
      si AS ({" UNION ALL ".join(sides)}),
      no AS (SELECT *, ({" + ".join(f"a{i}{i}" for i in range(3))}) AS tr, {square} AS sq
             FROM (SELECT mesh_id, face, fx, fy, fz, {", ".join(sums)} FROM si GROUP BY ALL)),
      ad AS (SELECT *, (tr*tr - sq)/2 AS det, {", ".join(adjugate)} FROM no),
      hf AS (SELECT *, {named("h", left)} FROM ad),
      te AS (SELECT mesh_id, face, fx, fy, fz, {", ".join(tensor)} FROM hf),
      cw AS ({" UNION ALL ".join(corners)}),
      co2 AS (SELECT cw.*, te.* EXCLUDE (mesh_id, face), {_sql_dot(n, f)} AS t, {", ".join(f"{e} AS x{k}" for k, e in enumerate(x))}
              FROM cw JOIN te ON te.mesh_id = cw.mesh_id AND te.face = cw.face JOIN vn ON vn.mesh_id = cw.mesh_id AND vn.v = cw.v),
      ro AS (SELECT *, {", ".join(rotation)} FROM co2),
      hr AS (SELECT *, {named("q", half)} FROM ro),
      me AS (SELECT mesh_id, v, {mean} FROM hr GROUP BY ALL),
      iv AS (SELECT mesh_id, v, m00 + m11 + m22 AS tr, {minors} AS mi FROM me)"""


CURVATURES = """ SELECT mesh_id, v, round(tr/2 + sqrt(greatest(tr*tr/4 - mi, 0)), 6) AS k1,
        round(tr/2 - sqrt(greatest(tr*tr/4 - mi, 0)), 6) AS k2 FROM iv"""


def derivative_sql() -> str:
    """Squared size of the derivative tensor as a mean of world tensors; vertices need no directions of their own."""
    six, three = [(i, j) for i in range(3) for j in range(i, 3)], range(3)
    sym = lambda name: lambda i, j: f"{name}{min(i, j)}{max(i, j)}"
    at = {"a": ["ax", "ay", "az"], "b": ["bx", "b_y", "bz"], "c": ["cx", "cy", "cz"]}
    rotation = ", ".join(f"r{i}{j}" for i in three for j in three)
    half = _sql_product(lambda i, k: f"r{i}{k}", sym("m"))
    whole = _sql_product(lambda i, k: f"b{i}{k}", lambda k, j: f"r{j}{k}")
    sides = " UNION ALL ".join(
        f"SELECT fa.mesh_id, fa.face, {', '.join(f'{e} AS e{k}' for k, e in enumerate(_sql_less(at[j], at[i])))}, "
        + ", ".join(f"q.k{m}{n} - p.k{m}{n} AS k{m}{n}" for m, n in six)
        + f" FROM fa JOIN tk p ON p.mesh_id = fa.mesh_id AND p.face = fa.face AND p.v = fa.v{'abc'.index(i)}"
        f" JOIN tk q ON q.mesh_id = fa.mesh_id AND q.face = fa.face AND q.v = fa.v{'abc'.index(j)}"
        for i, j in ("ab", "bc", "ca")
    )
    # A without its smaller part is a multiple of u u'; its longest row gives u, any edge does if A is round
    rest = ", ".join(f"a{i}{j} - mu*({int(i == j)} - f{'xyz'[i]}*f{'xyz'[j]}) AS p{i}{j}" for i, j in six)
    row = lambda i: "[" + ", ".join(f"p{min(i, j)}{max(i, j)}" for j in three) + "]"
    dot = lambda x, y: " + ".join(f"{x}{k}*{y}{k}" for k in three)
    form = lambda x, y: " + ".join(f"k{min(i, j)}{max(i, j)}*{x}{i}*{y}{j}" for i in three for j in three)
    ten = [(i, j, k) for i in three for j in range(i, 3) for k in range(j, 3)]

    def entry(i, j, k):
        two = lambda x, y: f"(g{i}*{x}{j}*{y}{k} + {x}{i}*g{j}*{y}{k} + {x}{i}*{y}{j}*g{k})"
        mixed = f"(h{i}*g{j}*g{k} + g{i}*h{j}*g{k} + g{i}*g{j}*h{k})"
        return f"d0*g{i}*g{j}*g{k} + d1*{mixed} + d2*{two('h', 'h')} + d3*h{i}*h{j}*h{k}"

    times = {e: len({(e[x], e[y], e[z]) for x, y, z in ((0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0))}) for e in ten}
    return f""",
      br AS (SELECT ro.mesh_id, ro.face, ro.v, w, {rotation}, {", ".join(f"{e} AS b{i}{j}" for (i, j), e in half.items())}
             FROM ro JOIN me ON me.mesh_id = ro.mesh_id AND me.v = ro.v),
      tk AS (SELECT mesh_id, face, v, w, {rotation}, {", ".join(f"{whole[i, j]} AS k{i}{j}" for i, j in six)} FROM br),
      sd AS ({sides}),
      ea AS (SELECT *, tr/2 + sqrt(greatest(tr*tr/4 - det, 0)) AS la, tr/2 - sqrt(greatest(tr*tr/4 - det, 0)) AS mu FROM ad),
      eu AS (SELECT ea.mesh_id, ea.face, ea.fx, ea.fy, ea.fz, la, mu, [bx-ax, b_y-ay, bz-az] AS eab, {rest}
             FROM ea JOIN ge ON ge.mesh_id = ea.mesh_id AND ge.face = ea.face),
      ev AS (SELECT *, CASE WHEN greatest(p00, p11, p22) <= 1e-9*la THEN eab WHEN p00 >= p11 AND p00 >= p22 THEN {row(0)}
             WHEN p11 >= p22 THEN {row(1)} ELSE {row(2)} END AS ul FROM eu),
      ew AS (SELECT *, {", ".join(f"ul[{k + 1}]/sqrt(ul[1]^2 + ul[2]^2 + ul[3]^2) AS u{k}" for k in three)} FROM ev),
      ex AS (SELECT mesh_id, face, la, mu, u0, u1, u2, fy*u2 - fz*u1 AS z0, fz*u0 - fx*u2 AS z1, fx*u1 - fy*u0 AS z2 FROM ew),
      sx AS (SELECT ex.*, {dot("e", "u")} AS sx, {dot("e", "z")} AS sy, {form("u", "u")} AS kuu, {form("u", "z")} AS kuz, {form("z", "z")} AS kzz
             FROM sd JOIN ex ON ex.mesh_id = sd.mesh_id AND ex.face = sd.face),
      dd AS (SELECT mesh_id, face, u0, u1, u2, z0, z1, z2, sum(kuu*sx)/la AS d0, sum(kuu*sy + 2*kuz*sx)/(2*la + mu) AS d1,
             sum(kzz*sx + 2*kuz*sy)/(la + 2*mu) AS d2, sum(kzz*sy)/mu AS d3 FROM sx GROUP BY mesh_id, face, la, mu, u0, u1, u2, z0, z1, z2),
      tv AS (SELECT tk.mesh_id, tk.v, w, d0, d1, d2, d3, {", ".join(" + ".join(f"r{b}{a}*{n}{b}" for b in three) + f" AS {m}{a}" for n, m in (("u", "g"), ("z", "h")) for a in three)}
             FROM tk JOIN dd ON dd.mesh_id = tk.mesh_id AND dd.face = tk.face),
      mt AS (SELECT mesh_id, v, {", ".join(f"sum(w*({entry(*e)}))/sum(w) AS t{e[0]}{e[1]}{e[2]}" for e in ten)} FROM tv GROUP BY ALL)
      SELECT mesh_id, v, round({" + ".join(f"{times[e]}*t{e[0]}{e[1]}{e[2]}^2" for e in ten)}, 4) AS norm2 FROM mt"""


def curvature_sql() -> str:
    return curvature_tables() + CURVATURES




@query("principal_curvatures", curvature_sql())
def principal_curvatures(t):
    g = cut(geometry(t))
    k = mesh.principal_curvatures(g, cut(mesh.vertex_normals(g)))
    return rounded(k, [M, "v"], k1="k1", k2="k2")


@query("curvature_derivatives", curvature_tables() + derivative_sql())
def curvature_derivatives(t):
    g = cut(geometry(t))
    vn = cut(mesh.vertex_normals(g))
    out = derivatives.curvature_derivatives(g, vn, cut(mesh.principal_curvatures(g, vn)))
    return out.select(M, "v", R("norm2", 4).alias("norm2"))


def _sql_ball(size: int) -> str:
    """Circumspheres of ``size`` suppliers of a nation, from Cramer's rule on the Gram matrix of their differences."""
    names = "abcd"[:size]
    diff = {n: [f"({n}.{k} - a.{k})" for k in "xyz"] for n in names[1:]}
    gram = [[_sql_dot(diff[m], diff[n]) for n in names[1:]] for m in names[1:]]
    right = [f"({gram[i][i]})/2" for i in range(size - 1)]

    def det(m):
        if len(m) == 1:
            return f"({m[0][0]})"
        signs = ["", "-", ""]
        return "(" + " + ".join(f"({signs[j]}({m[0][j]}))*{det([r[:j] + r[j + 1:] for r in m[1:]])}" for j in range(len(m))) + ")"

    whole = det(gram) if size > 1 else "1"
    parts = [det([r[:j] + [right[i]] + r[j + 1:] for i, r in enumerate(gram)]) for j in range(size - 1)]
    centre = [" + ".join([f"a.{k}", *[f"{p}/nullif({whole}, 0)*{diff[n][i]}" for p, n in zip(parts, names[1:])]]) for i, k in enumerate("xyz")]
    joins = "".join(f" JOIN pt {n} ON {n}.g = a.g AND {n}.id > {m}.id" for m, n in zip(names, names[1:]))
    return f"SELECT g, cx, cy, cz, (cx-ax)^2 + (cy-ay)^2 + (cz-az)^2 AS r2 FROM (SELECT a.g, a.x AS ax, a.y AS ay, a.z AS az, {centre[0]} AS cx, {centre[1]} AS cy, {centre[2]} AS cz FROM pt a{joins})"


@query(
    "bounding_spheres",
    f"""WITH pt AS (SELECT s_nationkey AS g, s_suppkey AS id, s_acctbal / 1000 AS x, (s_suppkey * 7 % 11)::DOUBLE AS y, (s_suppkey * 5 % 13)::DOUBLE AS z FROM supplier),
        ball AS (SELECT * FROM ({" UNION ALL ".join(_sql_ball(n) for n in (1, 2, 3, 4))}) WHERE r2 IS NOT NULL AND isfinite(r2)),
        ok AS (SELECT ball.g, cx, cy, cz, r2 FROM ball JOIN pt ON pt.g = ball.g GROUP BY ALL HAVING max((x-cx)^2 + (y-cy)^2 + (z-cz)^2) <= r2 * (1 + 1e-9) + 1e-12)
        SELECT g, round(sqrt(min(r2)), 6) AS r FROM ok GROUP BY g""",
)
def bounding_spheres(t):
    """Smallest ball around the suppliers of each nation, against every support set."""
    p = t.supplier.select(
        col("s_nationkey").alias("g"), (col("s_acctbal") / 1000).alias("x"), (col("s_suppkey") * 7 % 11).cast("double").alias("y"),
        (col("s_suppkey") * 5 % 13).cast("double").alias("z"),
    )
    return spheres.bounding_spheres(p, ["g"]).select("g", R("r", 6).alias("r"))


SCALE_SAMPLES, SCALE_STEPS = 8, 90
SCALES = EDGES + VE + f""", va AS (SELECT mesh_id, v, sum(area/3) AS area FROM (SELECT mesh_id, unnest([v0, v1, v2]) AS v, area FROM ge) GROUP BY ALL),
       st AS (SELECT mesh_id, ceil(count(*) / {SCALE_SAMPLES}.0)::BIGINT AS step FROM vx GROUP BY ALL),
       so AS (SELECT vx.mesh_id, v FROM vx JOIN st USING (mesh_id) WHERE v % step = 0),
       bf AS (SELECT mesh_id, v AS src, v AS node, 0.0::DOUBLE AS d, 0 AS n FROM so
              UNION ALL SELECT mesh_id, src, node, min(d), n FROM (
                SELECT mesh_id, src, node, d, n + 1 AS n FROM bf WHERE n < {SCALE_STEPS}
                UNION ALL SELECT bf.mesh_id, src, ve.j, d + w, n + 1 FROM bf JOIN ve ON ve.mesh_id = bf.mesh_id AND ve.i = bf.node WHERE n < {SCALE_STEPS})
              GROUP BY mesh_id, src, node, n),
       pa AS (SELECT mesh_id, src, node, d, row_number() OVER (PARTITION BY mesh_id, src ORDER BY d) - 1 AS pos,
                count(*) OVER (PARTITION BY mesh_id, src) AS cnt FROM bf WHERE n = {SCALE_STEPS}),
       ps AS (SELECT mesh_id, src, max(d) AS far, max(d) FILTER (pos = floor(cnt * 0.5)) AS middle, max(d) FILTER (pos = floor(cnt * 0.33)) AS low FROM pa GROUP BY ALL),
       pm AS (SELECT pa.mesh_id, src, sum(d * area) / sum(area) AS mean FROM pa JOIN so ON so.mesh_id = pa.mesh_id AND so.v = node
              JOIN va ON va.mesh_id = pa.mesh_id AND va.v = node WHERE src <> node GROUP BY ALL),
       pl AS (SELECT mesh_id, low, row_number() OVER (PARTITION BY mesh_id ORDER BY low) - 1 AS pos, count(*) OVER (PARTITION BY mesh_id) AS cnt FROM ps),
       ce AS (SELECT mesh_id, sum(gx*area)/sum(area) AS mx, sum(gy*area)/sum(area) AS my, sum(gz*area)/sum(area) AS mz FROM ge GROUP BY ALL),
       cd AS (SELECT ge.mesh_id, sqrt((gx-mx)^2 + (gy-my)^2 + (gz-mz)^2) AS d FROM ge JOIN ce USING (mesh_id)),
       cp AS (SELECT mesh_id, d, row_number() OVER (PARTITION BY mesh_id ORDER BY d) - 1 AS pos, count(*) OVER (PARTITION BY mesh_id) AS cnt FROM cd),
       al AS (SELECT mesh_id, 'half_max_path' AS kind, max(far)/2 AS scale FROM ps GROUP BY ALL
              UNION ALL SELECT mesh_id, 'half_mean_max_path', avg(far)/2 FROM ps GROUP BY ALL
              UNION ALL SELECT mesh_id, 'mean_path', avg(mean) FROM pm GROUP BY ALL
              UNION ALL SELECT mesh_id, 'median_path', median(middle) FROM ps GROUP BY ALL
              UNION ALL SELECT mesh_id, 'low_path', max(low) * 0.5/0.33 FROM pl WHERE pos = floor(cnt * 0.33) GROUP BY ALL
              UNION ALL SELECT mesh_id, 'box_diagonal', sqrt((max(x)-min(x))^2 + (max(y)-min(y))^2 + (max(z)-min(z))^2) FROM vx GROUP BY ALL
              UNION ALL SELECT mesh_id, 'median_distance', max(d) FROM cp WHERE pos = floor(cnt * 0.5) GROUP BY ALL
              UNION ALL SELECT mesh_id, 'low_distance', max(d) * 0.5/0.33 FROM cp WHERE pos = floor(cnt * 0.33) GROUP BY ALL)"""


@query("mesh_scales", f"WITH RECURSIVE {SCALES} SELECT mesh_id, kind, round(scale, 6) AS scale FROM al")
def mesh_scales(t):
    """Eight of the nine other scales of every mesh; the ninth, the ball, has its own query."""
    g = cut(geometry(t))
    areas = g.select(M, F.explode(F.array("v0", "v1", "v2")).alias("v"), (col("area") / 3).alias("a")).groupBy(M, "v").agg(F.sum("a").alias("area"))
    out = scales.mesh_scales(g, vertices(t), vertex_edges(t), areas, SCALE_SAMPLES)
    return out.filter(col("kind") != "sphere_radius").select(M, "kind", R("scale", 6).alias("scale"))


@query("orient_faces", f"WITH {MESH} SELECT mesh_id, face, v0, v1, v2 FROM fc")
def orient_faces(t):
    """Every face but the lowest of each mesh is flipped or not by a hash; orienting undoes it."""
    f = faces(t)
    odd = (F.pmod(F.xxhash64(M, "face"), F.lit(2)) == 1) & (col("face") > 0)
    mixed = f.select(
        M, "face", F.when(odd, col("v2")).otherwise(col("v0")).alias("v0"), "v1",
        F.when(odd, col("v0")).otherwise(col("v2")).alias("v2"),
    )
    return mesh.orient(cut(mixed))
