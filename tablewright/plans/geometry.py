"""Geometry over points taken from vectors and table columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.functions import geo
from tablewright.operators import ordered, spatial
from tablewright.plans.registry import query

E_SQL = "(SELECT vec_id, label, " + ", ".join(f"embedding[{i + 1}]::DOUBLE * 10 AS e{i}" for i in range(8)) + " FROM embeddings)"
r8 = lambda c: F.round(c, 6) + 0.0


def vecs(t):
    e = [F.col("embedding")[i].cast("double") * 10 for i in range(8)]
    pts = [geo.point(e[2 * i], e[2 * i + 1]).alias(n) for i, n in enumerate("pqrs")]
    return t.embeddings.select("vec_id", "label", *pts)


@query(
    "point_functions", "2.15.1 2.15.2 2.15.3 2.15.4",
    f"""
    SELECT vec_id, e2 - e0 > 1e-6 AS lf, e0 - e2 > 1e-6 AS rt, e1 - e3 > 1e-6 AS ab, e3 - e1 > 1e-6 AS be, abs(e0 - e2) <= 1e-6 AND abs(e1 - e3) <= 1e-6 AS sm,
           round(sqrt((e0-e2)*(e0-e2) + (e1-e3)*(e1-e3)), 6) + 0.0 AS d, round(e0 + e2, 6) + 0.0 AS ax, round(e1 - e3, 6) + 0.0 AS sy, round(e0*e2 - e1*e3, 6) + 0.0 AS mx,
           round((e1*e2 - e0*e3) / (e2*e2 + e3*e3), 5) + 0.0 AS dy, round((e1-e3) / (e0-e2), 4) + 0.0 AS sl FROM {E_SQL}
    """,
)
def point_functions(t):
    p, q = F.col("p"), F.col("q")
    return vecs(t).select(
        "vec_id", geo.left(p, q).alias("lf"), geo.right(p, q).alias("rt"), geo.above(p, q).alias("ab"), geo.below(p, q).alias("be"), geo.same_point(p, q).alias("sm"),
        r8(geo.distance(p, q)).alias("d"), r8(geo.add(p, q)["x"]).alias("ax"), r8(geo.subtract(p, q)["y"]).alias("sy"), r8(geo.multiply(p, q)["x"]).alias("mx"),
        (F.round(geo.divide(p, q)["y"], 5) + 0.0).alias("dy"), (F.round(geo.slope(p, q), 4) + 0.0).alias("sl"),
    )


BOXES = f"(SELECT vec_id, greatest(e0,e2) AS ax1, greatest(e1,e3) AS ay1, least(e0,e2) AS ax2, least(e1,e3) AS ay2, greatest(e4,e6) AS bx1, greatest(e5,e7) AS by1, least(e4,e6) AS bx2, least(e5,e7) AS by2, e4 AS px, e5 AS py FROM {E_SQL})"


@query(
    "box_functions", "2.15.5 2.15.6",
    f"""
    SELECT vec_id, ax2 <= bx1 AND bx2 <= ax1 AND ay2 <= by1 AND by2 <= ay1 AS ov, bx1 <= ax1 AND ax2 <= bx2 AND by1 <= ay1 AND ay2 <= by2 AS con,
           px BETWEEN ax2 AND ax1 AND py BETWEEN ay2 AND ay1 AS has, ax1 < bx2 AS lf, ay1 < by2 AS be, round((ax1-ax2)*(ay1-ay2), 6) + 0.0 AS area, round(ax1-ax2, 6) + 0.0 AS w, round(ay1-ay2, 6) + 0.0 AS h,
           round((ax1+ax2)/2, 6) + 0.0 AS cx, round(sqrt((ax1-ax2)*(ax1-ax2)+(ay1-ay2)*(ay1-ay2)), 6) + 0.0 AS diag,
           CASE WHEN ax2 <= bx1 AND bx2 <= ax1 AND ay2 <= by1 AND by2 <= ay1 THEN round((least(ax1,bx1)-greatest(ax2,bx2))*(least(ay1,by1)-greatest(ay2,by2)), 6) + 0.0 END AS cut FROM {BOXES}
    """,
)
def box_functions(t):
    a, b = geo.box(F.col("p"), F.col("q")), geo.box(F.col("r"), F.col("s"))
    v = vecs(t).select("vec_id", "r", a.alias("a"), b.alias("b"))
    a, b = F.col("a"), F.col("b")
    return v.select(
        "vec_id", geo.box_overlaps(a, b).alias("ov"), geo.box_contains(a, b).alias("con"), geo.box_contains_point(a, F.col("r")).alias("has"), geo.box_left(a, b).alias("lf"),
        geo.box_below(a, b).alias("be"), r8(geo.box_area(a)).alias("area"), r8(geo.box_width(a)).alias("w"), r8(geo.box_height(a)).alias("h"), r8(geo.box_center(a)["x"]).alias("cx"),
        r8(geo.segment_length(geo.box_diagonal(a))).alias("diag"), r8(geo.box_area(geo.box_intersect(a, b))).alias("cut"),
    )


@query(
    "segment_functions", "2.15.7 2.15.8",
    f"""
    WITH d AS (SELECT *, e2-e0 AS ux, e3-e1 AS uy, e6-e4 AS vx, e7-e5 AS vy FROM {E_SQL}),
    c AS (SELECT *, ux*(e5-e1) - uy*(e4-e0) AS d1, ux*(e7-e1) - uy*(e6-e0) AS d2, vx*(e1-e5) - vy*(e0-e4) AS d3, vx*(e3-e5) - vy*(e2-e4) AS d4,
                 least(1, greatest(0, ((e4-e0)*ux + (e5-e1)*uy) / (ux*ux + uy*uy))) AS u, (e1-e3)/(e0-e2) AS m1, (e5-e7)/(e4-e6) AS m2 FROM d)
    SELECT vec_id, d1*d2 <= 0 AND d3*d4 <= 0 AND greatest(e0,e2) >= least(e4,e6) AND greatest(e4,e6) >= least(e0,e2) AND greatest(e1,e3) >= least(e5,e7) AND greatest(e5,e7) >= least(e1,e3) AS meet,
           abs(ux*vy - uy*vx) <= 1e-6 AS par, abs(ux*vx + uy*vy) <= 1e-6 AS perp, round(sqrt(ux*ux + uy*uy), 6) + 0.0 AS len, round(e0 + u*ux, 6) + 0.0 AS cx,
           round(sqrt((e4 - e0 - u*ux)*(e4 - e0 - u*ux) + (e5 - e1 - u*uy)*(e5 - e1 - u*uy)), 6) + 0.0 AS dist,
           round(abs(m1*e4 - e5 + e1 - m1*e0) / sqrt(m1*m1 + 1), 5) + 0.0 AS line_d, CASE WHEN abs(m1 - m2) > 0.01 THEN round(((e5 - m2*e4) - (e1 - m1*e0)) / (m1 - m2), 3) + 0.0 END AS mx FROM c
    """,
)
def segment_functions(t):
    v = vecs(t).select("vec_id", "p", "r", geo.segment(F.col("p"), F.col("q")).alias("a"), geo.segment(F.col("r"), F.col("s")).alias("b"),
                       geo.line_through(F.col("p"), F.col("q")).alias("l"), geo.line_through(F.col("r"), F.col("s")).alias("m"))
    a, b = F.col("a"), F.col("b")
    meet = geo.lines_meet(F.col("l"), F.col("m"))
    return v.select(
        "vec_id", geo.segments_cross(a, b).alias("meet"), geo.parallel(a, b).alias("par"), geo.perpendicular(a, b).alias("perp"), r8(geo.segment_length(a)).alias("len"),
        r8(geo.closest_point(a, F.col("r"))["x"]).alias("cx"), r8(geo.point_segment_distance(F.col("r"), a)).alias("dist"),
        (F.round(geo.point_line_distance(F.col("r"), F.col("l")), 5) + 0.0).alias("line_d"),
        F.when(F.abs(F.col("l.a") - F.col("m.a")) > 0.01, F.round(meet["x"], 3) + 0.0).alias("mx"),
    )


@query(
    "path_functions", "2.15.9 2.15.11",
    f"""
    WITH d AS (SELECT *, sqrt((e0-e2)*(e0-e2)+(e1-e3)*(e1-e3)) AS d1, sqrt((e2-e4)*(e2-e4)+(e3-e5)*(e3-e5)) AS d2, sqrt((e4-e0)*(e4-e0)+(e5-e1)*(e5-e1)) AS d3, (e0+e2+e4)/3 AS cx, (e1+e3+e5)/3 AS cy FROM {E_SQL})
    SELECT vec_id, round(d1 + d2, 6) + 0.0 AS open_len, round(d1 + d2 + d3, 6) + 0.0 AS closed_len, round(abs(e0*e3 - e1*e2 + e2*e5 - e3*e4 + e4*e1 - e5*e0) / 2, 6) + 0.0 AS area, 3 AS n,
           round(cx, 6) + 0.0 AS cx, round(greatest(e0, e2, e4), 6) + 0.0 AS right_edge,
           round((sqrt((e0-cx)*(e0-cx)+(e1-cy)*(e1-cy)) + sqrt((e2-cx)*(e2-cx)+(e3-cy)*(e3-cy)) + sqrt((e4-cx)*(e4-cx)+(e5-cy)*(e5-cy))) / 3, 6) + 0.0 AS radius FROM d
    """,
)
def path_functions(t):
    v = vecs(t).select("vec_id", F.array("p", "q", "r").alias("g"))
    g = F.col("g")
    return v.select(
        "vec_id", r8(geo.path_length(g)).alias("open_len"), r8(geo.path_length(g, closed=True)).alias("closed_len"), r8(geo.path_area(g)).alias("area"), F.size(g).alias("n"),
        r8(geo.polygon_center(g)["x"]).alias("cx"), r8(geo.bounding_box(g)["x1"]).alias("right_edge"), r8(geo.polygon_circle(g)["r"]).alias("radius"),
    )


@query(
    "polygon_relations", "2.15.10",
    f"""
    WITH d AS (SELECT *, (e2-e0)*(e7-e1) - (e3-e1)*(e6-e0) AS s1, (e4-e2)*(e7-e3) - (e5-e3)*(e6-e2) AS s2, (e0-e4)*(e7-e5) - (e1-e5)*(e6-e4) AS s3 FROM {E_SQL})
    SELECT vec_id, (s1 >= 0 AND s2 >= 0 AND s3 >= 0) OR (s1 <= 0 AND s2 <= 0 AND s3 <= 0) AS has, true AS same_turned, true AS same_back, true AS self_overlap, false AS far FROM d
    """,
)
def polygon_relations(t):
    v = vecs(t).select("vec_id", "s", F.array("p", "q", "r").alias("g"), F.array("q", "r", "p").alias("h"), F.array("r", "q", "p").alias("b"))
    g = F.col("g")
    far = F.transform(g, lambda p: geo.point(p["x"] + 1000, p["y"]))
    return v.select(
        "vec_id", geo.polygon_contains(g, F.col("s")).alias("has"), geo.same_polygon(g, F.col("h")).alias("same_turned"), geo.same_polygon(g, F.col("b")).alias("same_back"),
        geo.polygons_overlap(g, F.col("h")).alias("self_overlap"), geo.polygons_overlap(g, far).alias("far"),
    )


@query(
    "circle_functions", "2.15.12 2.15.13",
    f"""
    WITH d AS (SELECT *, abs(e4) AS r1, abs(e5) AS r2, sqrt((e0-e2)*(e0-e2)+(e1-e3)*(e1-e3)) AS d FROM {E_SQL})
    SELECT vec_id, round(pi()*r1*r1, 6) + 0.0 AS area, d <= r1 AS has, d - (r1 - r2) <= 1e-6 AS con, d - (r1 + r2) <= 1e-6 AS ov, round(greatest(d - (r1 + r2), 0), 6) + 0.0 AS gap,
           round(d / 2, 6) + 0.0 AS box_r, round(r1 * sqrt(2), 6) + 0.0 AS box_w, 4 AS corners, round(e0 - r1, 6) + 0.0 AS first_x FROM d
    """,
)
def circle_functions(t):
    v = vecs(t).select("vec_id", "p", "q", geo.circle(F.col("p"), F.abs(F.col("r.x"))).alias("a"), geo.circle(F.col("q"), F.abs(F.col("r.y"))).alias("b"))
    a, b = F.col("a"), F.col("b")
    return v.select(
        "vec_id", r8(geo.circle_area(a)).alias("area"), geo.circle_contains_point(a, F.col("q")).alias("has"), geo.circle_contains(a, b).alias("con"), geo.circles_overlap(a, b).alias("ov"),
        r8(geo.circle_distance(a, b)).alias("gap"), r8(geo.box_to_circle(geo.box(F.col("p"), F.col("q")))["r"]).alias("box_r"), r8(geo.box_width(geo.circle_to_box(a))).alias("box_w"),
        F.size(geo.box_to_polygon(geo.circle_to_box(a))).alias("corners"), r8(geo.circle_to_polygon(a, 12)[0]["x"]).alias("first_x"),
    )


@query(
    "point_in_polygon_join", "2.15.14",
    f"""
    WITH a AS (SELECT vec_id AS area_id, e0 AS cx, e1 AS cy FROM {E_SQL})
    SELECT area_id, p.vec_id FROM a JOIN (SELECT vec_id, e0 AS x, e1 AS y FROM {E_SQL}) p ON vec_id <> area_id AND abs(x - cx) + abs(y - cy) < 0.05
    """,
)
def point_in_polygon_join(t):
    # one diamond about each vector
    h = 0.05
    v = vecs(t)
    x, y = F.col("p.x"), F.col("p.y")
    diamond = F.array(geo.point(x - h, y), geo.point(x, y + h), geo.point(x + h, y), geo.point(x, y - h))
    areas = v.select(F.col("vec_id").alias("area_id"), diamond.alias("shape"))
    points = v.select("vec_id", x.alias("x"), y.alias("y"))
    return spatial.point_in_polygon_join(points, areas, ("x", "y"), "shape", h).filter("area_id <> vec_id").select("area_id", "vec_id")


@query(
    "great_circle", "2.15.15",
    """
    WITH d AS (SELECT c_custkey, (c_custkey % 180) - 89.5 AS lat, (c_custkey * 7 % 360) - 180.0 AS lon FROM customer),
    h AS (SELECT *, sqrt(pow(sin((radians(lat) - radians(48.0)) / 2), 2) + cos(radians(lat)) * cos(radians(48.0)) * pow(sin((radians(lon) - radians(11.0)) / 2), 2)) AS h FROM d)
    SELECT c_custkey, round(2 * 6378168.0 * asin(least(1, h)), 1) AS metres, round(2 * 3958.747716 * asin(least(1, h)), 4) AS miles FROM h
    """,
)
def great_circle(t):
    lat, lon = F.col("c_custkey") % 180 - 89.5, F.col("c_custkey") * 7 % 360 - 180.0
    here = geo.ll_to_earth(F.lit(48.0), F.lit(11.0))
    return t.customer.select(
        "c_custkey", F.round(geo.earth_distance(geo.ll_to_earth(lat, lon), here), 1).alias("metres"),
        F.round(geo.lon_lat_miles(geo.point(lon, lat), geo.point(F.lit(11.0), F.lit(48.0))), 4).alias("miles"),
    )


@query(
    "cube_functions", "2.15.16",
    f"""
    WITH c AS (SELECT vec_id, least(e0,e3) AS a1, greatest(e0,e3) AS b1, least(e1,e4) AS a2, greatest(e1,e4) AS b2, least(e2,e5) AS a3, greatest(e2,e5) AS b3,
                      least(e6,0) AS c1, greatest(e6,0) AS d1, least(e7,0) AS c2, greatest(e7,0) AS d2, least(e6,e7) AS c3, greatest(e6,e7) AS d3 FROM {E_SQL})
    SELECT vec_id, a1 <= d1 AND c1 <= b1 AND a2 <= d2 AND c2 <= b2 AND a3 <= d3 AND c3 <= b3 AS ov, a1 <= c1 AND d1 <= b1 AND a2 <= c2 AND d2 <= b2 AND a3 <= c3 AND d3 <= b3 AS con,
           round((greatest(b1,d1)-least(a1,c1)) * (greatest(b2,d2)-least(a2,c2)) * (greatest(b3,d3)-least(a3,c3)), 5) AS usize,
           round(least(b1,d1)-greatest(a1,c1), 6) + 0.0 AS i1, round((b1-a1)*(b2-a2)*(b3-a3), 5) AS size, round((b1-a1+1)*(b2-a2+1)*(b3-a3+1), 5) AS grown FROM c
    """,
)
def cube_functions(t):
    e = [F.col("embedding")[i].cast("double") * 10 for i in range(8)]
    zero = F.lit(0.0)
    v = t.embeddings.select("vec_id", geo.cube(F.array(*e[:3]), F.array(*e[3:6])).alias("a"), geo.cube(F.array(e[6], e[7], e[6]), F.array(zero, zero, e[7])).alias("b"))
    a, b = F.col("a"), F.col("b")
    return v.select(
        "vec_id", geo.cube_overlaps(a, b).alias("ov"), geo.cube_contains(a, b).alias("con"), F.round(geo.cube_size(geo.cube_union(a, b)), 5).alias("usize"),
        (F.round(geo.cube_intersect(a, b)["hi"][0] - geo.cube_intersect(a, b)["lo"][0], 6) + 0.0).alias("i1"), F.round(geo.cube_size(a), 5).alias("size"),
        F.round(geo.cube_size(geo.cube_enlarge(a, 0.5)), 5).alias("grown"),
    )


KNN = [("euclidean", "sqrt(list_sum([pow(x::DOUBLE - 0.01, 2) FOR x IN embedding]))"), ("taxicab", "list_sum([abs(x::DOUBLE - 0.01) FOR x IN embedding])"), ("chebyshev", "list_max([abs(x::DOUBLE - 0.01) FOR x IN embedding])")]


@query(
    "vector_knn", "2.15.17",
    " UNION ALL ".join(
        f"SELECT * FROM (SELECT '{n}' AS metric, vec_id, round({e}, 6) AS distance FROM embeddings ORDER BY {e}, vec_id LIMIT 10)" for n, e in KNN
    ),
)
def vector_knn(t):
    target = F.transform("embedding", lambda x: F.lit(0.01))
    out = None
    for name, _ in KNN:
        d = t.embeddings.select(F.lit(name).alias("metric"), "vec_id", getattr(geo, name)(F.col("embedding"), target).alias("d"))
        part = d.orderBy("d", "vec_id").limit(10).select("metric", "vec_id", F.round("d", 6).alias("distance"))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "vector_knn_per_label", "2.15.17 2.3.14",
    """
    SELECT label, vec_id, round(d, 6) AS distance FROM (SELECT label, vec_id, d, row_number() OVER (PARTITION BY label ORDER BY d, vec_id) AS r FROM
      (SELECT label, vec_id, sqrt(list_sum([pow(x::DOUBLE + 0.02, 2) FOR x IN embedding])) AS d FROM embeddings)) WHERE r <= 3
    """,
)
def vector_knn_per_label(t):
    target = F.transform("embedding", lambda x: F.lit(-0.02))
    d = t.embeddings.select("label", "vec_id", geo.euclidean(F.col("embedding"), target).alias("d"))
    return ordered.first_per_key(d, ["label"], ["d", "vec_id"], 3).select("label", "vec_id", F.round("d", 6).alias("distance"))


@query(
    "seg_functions", "2.15.18",
    """
    WITH s AS (SELECT p_partkey, p_size::DOUBLE AS a, p_size + 5.5 AS b, 20.0::DOUBLE AS c, 30.25::DOUBLE AS d FROM part)
    SELECT p_partkey, a <= d AND c <= b AS ov, a <= c AND d <= b AS con, b < c AS lf, round(greatest(b, d) - least(a, c), 6) AS usize, round(least(b, d) - greatest(a, c), 6) + 0.0 AS isize FROM s
    """,
)
def seg_functions(t):
    a, b = geo.seg(F.col("p_size"), F.col("p_size") + 5.5), geo.seg(F.lit(20.0), F.lit(30.25))
    return t.part.select(
        "p_partkey", geo.seg_overlaps(a, b).alias("ov"), geo.seg_contains(a, b).alias("con"), geo.seg_left(a, b).alias("lf"),
        F.round(geo.seg_size(geo.seg_union(a, b)), 6).alias("usize"), (F.round(geo.seg_size(geo.seg_intersect(a, b)), 6) + 0.0).alias("isize"),
    )
