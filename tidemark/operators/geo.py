"""Points and polygons in projected metres: grid cells, radius, containment and nearest joins, map projection."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: GRS80 and the unified national grid (origin 38 N 127.5 E, scale 0.9996, false easting and northing).
A, INVERSE_F, LAT0, LON0, K0, FALSE_E, FALSE_N = 6378137.0, 298.257222101, 38.0, 127.5, 0.9996, 1_000_000.0, 2_000_000.0


def transverse_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Easting and northing of geographic degrees, by the usual series to the sixth power of the longitude's difference."""
    f = 1 / INVERSE_F
    e2 = f * (2 - f)
    ep2 = e2 / (1 - e2)

    def arc(phi):
        s = math.sin if isinstance(phi, float) else F.sin
        return A * (
            (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * phi - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * s(2 * phi)
            + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * s(4 * phi) - (35 * e2**3 / 3072) * s(6 * phi)
        )

    phi, dl = F.radians(lat), F.radians(lon - LON0)
    n = A / F.sqrt(1 - e2 * F.sin(phi) * F.sin(phi))
    t, c, a = F.pow(F.tan(phi), 2), ep2 * F.pow(F.cos(phi), 2), dl * F.cos(phi)
    x = FALSE_E + K0 * n * (a + (1 - t + c) * F.pow(a, 3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep2) * F.pow(a, 5) / 120)
    y = FALSE_N + K0 * (arc(phi) - arc(math.radians(LAT0)) + n * F.tan(phi) * (a * a / 2 + (5 - t + 9 * c + 4 * c * c) * F.pow(a, 4) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep2) * F.pow(a, 6) / 720))
    return x, y


def cell(c: Column, size: float) -> Column:
    return F.floor(c / size)


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def radius_join(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """Pairs of (id_l, x_l, y_l) and (id_r, x_r, y_r) no farther apart than radius.

    Each left point looks into its own cell and the eight around it; the cell is the join key, so dense places spread over as
    many tasks as they have cells.
    """
    around = F.explode(F.expr("flatten(transform(sequence(-1, 1), i -> transform(sequence(-1, 1), j -> struct(i as i, j as j))))"))
    a = left.withColumn("_n", around).withColumn("_cx", cell(F.col("x_l"), radius) + F.col("_n.i")).withColumn("_cy", cell(F.col("y_l"), radius) + F.col("_n.j")).drop("_n")
    b = right.withColumn("_cx", cell(F.col("x_r"), radius)).withColumn("_cy", cell(F.col("y_r"), radius))
    d = distance(F.col("x_l"), F.col("y_l"), F.col("x_r"), F.col("y_r"))
    return a.join(b, ["_cx", "_cy"]).withColumn("distance", d).filter(F.col("distance") <= radius).drop("_cx", "_cy")


def _edges(ring: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(ring) - 1), lambda i: F.struct(F.element_at(ring, i).alias("a"), F.element_at(ring, i + 1).alias("b")))


def on_boundary(ring: Column, x: Column, y: Column, tolerance: float = 1e-9) -> Column:
    def on(e: Column) -> Column:
        cross = (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) - (e["b"]["y"] - e["a"]["y"]) * (x - e["a"]["x"])
        in_x = (x >= F.least(e["a"]["x"], e["b"]["x"])) & (x <= F.greatest(e["a"]["x"], e["b"]["x"]))
        in_y = (y >= F.least(e["a"]["y"], e["b"]["y"])) & (y <= F.greatest(e["a"]["y"], e["b"]["y"]))
        return (F.abs(cross) <= tolerance) & in_x & in_y

    return F.exists(_edges(ring), on)


def inside(ring: Column, x: Column, y: Column) -> Column:
    """Ray casting over a closed ring of (x, y); a point on the boundary is not inside."""

    def crosses(e: Column) -> Column:
        spans = (e["a"]["y"] > y) != (e["b"]["y"] > y)
        at = (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) / F.nullif(e["b"]["y"] - e["a"]["y"], F.lit(0.0)) + e["a"]["x"]
        return spans & (x < at)

    odd = F.size(F.filter(_edges(ring), crosses)) % 2 == 1
    return odd & ~on_boundary(ring, x, y)


def covering_cells(ring: Column, size: float) -> Column:
    """The cells of a ring's bounding box."""
    xs, ys = F.transform(ring, lambda p: cell(p["x"], size)), F.transform(ring, lambda p: cell(p["y"], size))
    wide, high = F.sequence(F.array_min(xs), F.array_max(xs)), F.sequence(F.array_min(ys), F.array_max(ys))
    return F.flatten(F.transform(wide, lambda i: F.transform(high, lambda j: F.struct(i.alias("i"), j.alias("j")))))


def contained(points: DataFrame, areas: DataFrame, size: float, boundary: bool = False) -> DataFrame:
    """Every point (id, x, y) with the areas (code, ring) that hold it: how many, the code if it is one, all codes.

    Areas are keyed by the cells of their bounding boxes, points by their own cell.
    """
    a = areas.withColumn("_c", F.explode(covering_cells(F.col("ring"), size))).select("code", "ring", F.col("_c.i").alias("_i"), F.col("_c.j").alias("_j"))
    p = points.withColumn("_i", cell(F.col("x"), size)).withColumn("_j", cell(F.col("y"), size))
    hit = inside(F.col("ring"), F.col("x"), F.col("y"))
    if boundary:
        hit = hit | on_boundary(F.col("ring"), F.col("x"), F.col("y"))
    found = p.join(a, ["_i", "_j"]).filter(hit).groupBy("id").agg(F.array_sort(F.collect_set("code")).alias("codes"))
    n = F.coalesce(F.size("codes"), F.lit(0))
    out = points.join(found, "id", "left")
    return out.select(*points.columns, F.when(F.col("codes").isNull(), 0).otherwise(n).alias("n_areas"), F.when(F.size("codes") == 1, F.element_at("codes", 1)).alias("code"), (F.coalesce(F.size("codes"), F.lit(0)) > 1).alias("ambiguous"), F.concat_ws("|", F.slice("codes", 1, 5)).alias("candidates"))


def nearest_two(points: DataFrame, places: DataFrame, radii: tuple[float, ...]) -> DataFrame:
    """For each point the nearest place and the nearest of another code, by growing radii; only points that aren't resolved go on."""
    found, left = None, points
    for r in radii:
        pairs = radius_join(left.select(F.col("id").alias("id_l"), F.col("x").alias("x_l"), F.col("y").alias("y_l")), places.select(F.col("code").alias("id_r"), F.col("x").alias("x_r"), F.col("y").alias("y_r")), r)
        per = pairs.groupBy("id_l", "id_r").agg(F.min("distance").alias("d"))
        w = W.partitionBy("id_l").orderBy("d", "id_r")
        per = per.withColumn("_r", F.row_number().over(w)).filter("_r <= 2")
        two = per.groupBy(F.col("id_l").alias("id")).agg(
            F.max(F.when(F.col("_r") == 1, F.col("id_r"))).alias("nearest"), F.max(F.when(F.col("_r") == 1, F.col("d"))).alias("distance"),
            F.max(F.when(F.col("_r") == 2, F.col("id_r"))).alias("second"), F.max(F.when(F.col("_r") == 2, F.col("d"))).alias("second_distance"),
        )
        if r != radii[-1]:
            two = two.filter("second IS NOT NULL")
        found = two if found is None else found.unionByName(two)
        left = points.join(found.select("id"), "id", "left_anti")
    gap = F.col("second_distance") - F.col("distance")
    return points.select("id").join(found, "id", "left").withColumn("gap", gap)


def polygon_area(ring: Column) -> Column:
    """Shoelace area of a closed ring."""
    return F.abs(F.aggregate(_edges(ring), F.lit(0.0), lambda s, e: s + e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])) / 2


def box_pairs(areas: DataFrame, size: float) -> DataFrame:
    """(code_a, code_b, ring_a, ring_b) of areas whose bounding boxes overlap, each pair once; cells are the join key."""
    box = areas.select("code", F.array_min("ring.x").alias("x0"), F.array_max("ring.x").alias("x1"), F.array_min("ring.y").alias("y0"), F.array_max("ring.y").alias("y1"), F.explode(covering_cells(F.col("ring"), size)).alias("_c"))
    a, b = box.alias("a"), box.alias("b")
    meet = (F.least("a.x1", "b.x1") > F.greatest("a.x0", "b.x0")) & (F.least("a.y1", "b.y1") > F.greatest("a.y0", "b.y0"))
    pairs = a.join(b, (F.col("a._c") == F.col("b._c")) & (F.col("a.code") < F.col("b.code")) & meet).select(F.col("a.code").alias("code_a"), F.col("b.code").alias("code_b")).distinct()
    rings = areas.select("code", "ring")
    pairs = pairs.join(rings.select(F.col("code").alias("code_a"), F.col("ring").alias("ring_a")), "code_a")
    return pairs.join(rings.select(F.col("code").alias("code_b"), F.col("ring").alias("ring_b")), "code_b")


def shared_area(a: list[tuple[float, float]], b: list[tuple[float, float]]) -> float:
    """Area that two simple rings share, in whatever direction they run.

    A ring is the signed sum of the triangles from its first point to its edges; two triangles share a convex piece, found by
    cutting one with the other's sides.
    """
    cross = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])

    def fan(ring):
        for q, r in zip(ring[1:], ring[2:], strict=False):
            if turn := cross(ring[0], q, r):
                yield ((ring[0], q, r) if turn > 0 else (ring[0], r, q)), (1 if turn > 0 else -1)

    total = 0.0
    seconds = list(fan(b))
    for one, sign in fan(a):
        for two, other in seconds:
            piece = list(one)
            for p, q in ((two[0], two[1]), (two[1], two[2]), (two[2], two[0])):
                cut, sides = [], [cross(p, q, v) for v in piece]
                for k, v in enumerate(piece):
                    w, s, t = piece[k - 1], sides[k], sides[k - 1]
                    if (s > 0) != (t > 0):
                        f = t / (t - s)
                        cut.append((w[0] + f * (v[0] - w[0]), w[1] + f * (v[1] - w[1])))
                    if s > 0:
                        cut.append(v)
                piece = cut
                if not piece:
                    break
            total += sign * other * sum(v[0] * w[1] - w[0] * v[1] for v, w in zip(piece, piece[1:] + piece[:1], strict=True)) / 2
    return abs(total)


def overlaps(areas: DataFrame, size: float, least: float = 1.0) -> DataFrame:
    """Pairs of areas with the area they share, where it is above `least`. Pairs come from cells and boxes; only cutting runs in Python."""
    from collections.abc import Iterator

    import pyarrow as pa

    from tidemark import shipping

    shipping.ensure(areas.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rings = [[[(p["x"], p["y"]) for p in r] for r in batch.column(c).to_pylist()] for c in (2, 3)]
            shared = [shared_area(x, y) for x, y in zip(*rings, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shared, pa.float64())], ["code_a", "code_b", "overlap"])

    kind = dict(areas.dtypes)["code"]
    pairs = box_pairs(areas, size).select("code_a", "code_b", "ring_a", "ring_b")
    return pairs.mapInArrow(run, f"code_a {kind}, code_b {kind}, overlap double").filter(F.col("overlap") > least)


def assembled(stores: DataFrame, within: DataFrame, ambiguous: DataFrame, key: str) -> DataFrame:
    """Stores with their area and why they have none: missing before suspect before ambiguous before within; only within has an area."""
    out = stores.join(within, key, "left").join(ambiguous, key, "left")
    reason = F.when(F.col("coord_missing"), "missing").when(F.col("coord_suspect"), "suspect").when(F.coalesce("ambiguous", F.lit(False)), "ambiguous").when(F.col("area").isNotNull(), "within").otherwise("outside")
    return out.withColumn("reason", reason).select(key, "reason", F.when(F.col("reason") == "within", F.col("area")).alias("area"))


def nearest_agreeing(pairs: DataFrame, agrees: Column, margin: float) -> DataFrame:
    """Of the pairs (id_l, id_r, distance) that agree, each left id's nearest; ambiguous if the next is not `margin` farther."""
    top = pairs.filter(agrees).groupBy("id_l").agg(F.slice(F.array_sort(F.collect_list(F.struct("distance", "id_r"))), 1, 2).alias("_t"))
    first, second = F.get("_t", F.lit(0)), F.get("_t", F.lit(1))
    return top.select("id_l", first["id_r"].alias("id_r"), first["distance"].alias("distance"), F.coalesce(second["distance"] - first["distance"] < margin, F.lit(False)).alias("ambiguous"))


def nearest_with_ties(points: DataFrame, places: DataFrame, radii: tuple[float, ...]) -> DataFrame:
    """For each point (id, x, y) its nearest place, of equally near ones that of the smallest id, and how many these are.

    Places are sought within growing radii; only points without one go on to the next. A point farther than the last has no row.
    """
    right = places.select(F.col("id").alias("id_r"), F.col("x").alias("x_r"), F.col("y").alias("y_r"))
    left, out = points.select(F.col("id").alias("id_l"), F.col("x").alias("x_l"), F.col("y").alias("y_l")), None
    for radius in radii:
        near = radius_join(left, right, radius).groupBy("id_l", "distance").agg(F.min("id_r").alias("nearest"), F.count("*").alias("n_nearest"))
        best = near.groupBy(F.col("id_l").alias("id")).agg(F.min(F.struct("distance", "nearest", "n_nearest")).alias("_b")).select("id", "_b.nearest", "_b.distance", "_b.n_nearest")
        out = best if out is None else out.unionByName(best)
        left = left.join(best.select(F.col("id").alias("id_l")), "id_l", "left_anti")
    return out


#: The Bessel ellipsoid, the central national grid on it (origin 38 N 127.0028902777778 E, scale 1, false easting 200000 and
#: northing 500000), and the published shift of its datum to the world's (metres, arc seconds, parts per million).
BESSEL_A, BESSEL_INVERSE_F, BESSEL_LON0, BESSEL_FALSE = 6377397.155, 299.1528128, 127.0 + 10.405 / 3600, (200_000.0, 500_000.0)
SHIFT, ROTATION, SCALE_PPM = (-115.80, 474.99, 674.11), (1.16, -2.31, -1.63), 6.43


def geographic(df: DataFrame, x: str, y: str, a: float = BESSEL_A, inverse_f: float = BESSEL_INVERSE_F, lat0: float = LAT0, lon0: float = BESSEL_LON0, k0: float = 1.0, false: tuple[float, float] = BESSEL_FALSE) -> DataFrame:
    """df with _lon and _lat in degrees of grid coordinates, by the usual series. Each step is a column, so that none is written out twice."""
    f = 1 / inverse_f
    e2 = f * (2 - f)
    ep2, e1 = e2 / (1 - e2), (1 - math.sqrt(1 - e2)) / (1 + math.sqrt(1 - e2))
    per = a * (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256)
    p0 = math.radians(lat0)
    m0 = a * ((1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * p0 - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * math.sin(2 * p0) + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * math.sin(4 * p0) - 35 * e2**3 / 3072 * math.sin(6 * p0))
    mu, phi, n, r, t, c, d = (F.col(k) for k in ("_mu", "_phi", "_n", "_r", "_t", "_c", "_d"))
    df = df.withColumn("_mu", (m0 + (F.col(y) - false[1]) / k0) / per)
    df = df.withColumn("_phi", mu + (3 * e1 / 2 - 27 * e1**3 / 32) * F.sin(2 * mu) + (21 * e1**2 / 16 - 55 * e1**4 / 32) * F.sin(4 * mu) + (151 * e1**3 / 96) * F.sin(6 * mu))
    df = df.withColumns({"_n": a / F.sqrt(1 - e2 * F.pow(F.sin(phi), 2)), "_r": a * (1 - e2) / F.pow(1 - e2 * F.pow(F.sin(phi), 2), 1.5), "_t": F.pow(F.tan(phi), 2), "_c": ep2 * F.pow(F.cos(phi), 2)})
    df = df.withColumn("_d", (F.col(x) - false[0]) / (n * k0))
    lat = phi - n * F.tan(phi) / r * (d * d / 2 - (5 + 3 * t + 10 * c - 4 * c * c - 9 * ep2) * F.pow(d, 4) / 24 + (61 + 90 * t + 298 * c + 45 * t * t - 252 * ep2 - 3 * c * c) * F.pow(d, 6) / 720)
    lon = (d - (1 + 2 * t + c) * F.pow(d, 3) / 6 + (5 - 2 * c + 28 * t - 3 * c * c + 8 * ep2 + 24 * t * t) * F.pow(d, 5) / 120) / F.cos(phi)
    return df.withColumns({"_lon": lon0 + F.degrees(lon), "_lat": F.degrees(lat)}).drop("_mu", "_phi", "_n", "_r", "_t", "_c", "_d")


def shifted_datum(df: DataFrame) -> DataFrame:
    """df whose _lon and _lat on the Bessel ellipsoid, at height 0, become those of the world's, by a shift, small rotations and a scale of the axes."""
    f, g = 1 / BESSEL_INVERSE_F, 1 / INVERSE_F
    e2, g2 = f * (2 - f), g * (2 - g)
    b = A * math.sqrt(1 - g2)
    rx, ry, rz = (math.radians(v / 3600) for v in ROTATION)
    m = 1 + SCALE_PPM * 1e-6
    phi, lam, n, x, y, z, u, v, w, p, q = (F.col(k) for k in ("_phi", "_lam", "_n", "_x", "_y", "_z", "_u", "_v", "_w", "_p", "_q"))
    df = df.withColumns({"_phi": F.radians("_lat"), "_lam": F.radians("_lon")}).withColumn("_n", BESSEL_A / F.sqrt(1 - e2 * F.pow(F.sin(phi), 2)))
    df = df.withColumns({"_x": n * F.cos(phi) * F.cos(lam), "_y": n * F.cos(phi) * F.sin(lam), "_z": n * (1 - e2) * F.sin(phi)})
    df = df.withColumns({"_u": SHIFT[0] + m * (x - rz * y + ry * z), "_v": SHIFT[1] + m * (rz * x + y - rx * z), "_w": SHIFT[2] + m * (-ry * x + rx * y + z)})
    df = df.withColumn("_p", F.sqrt(u * u + v * v)).withColumn("_q", F.atan2(w * A, p * b))
    lat = F.atan2(w + g2 / (1 - g2) * b * F.pow(F.sin(q), 3), p - g2 * A * F.pow(F.cos(q), 3))
    return df.withColumns({"_lon": F.degrees(F.atan2(v, u)), "_lat": F.degrees(lat)}).drop("_phi", "_lam", "_n", "_x", "_y", "_z", "_u", "_v", "_w", "_p", "_q")


def standard_coordinates(df: DataFrame, x: str, y: str, lon: tuple[float, float] = (126.7, 127.3), lat: tuple[float, float] = (37.4, 37.75)) -> DataFrame:
    """df with x_std and y_std on the unified grid, and whether the coordinate is missing (null, not a number, or not above zero) or suspect
    (outside a box of degrees)."""
    out = df.withColumns({"_px": F.col(x).try_cast("double"), "_py": F.col(y).try_cast("double")})
    out = shifted_datum(geographic(out, "_px", "_py")).withColumn("coord_missing", F.coalesce((F.col("_px") <= 0) | (F.col("_py") <= 0), F.lit(True)))
    tx, ty = transverse_mercator(F.col("_lon"), F.col("_lat"))
    inside_box = F.coalesce(F.col("_lon").between(*lon) & F.col("_lat").between(*lat), F.lit(False))
    out = out.withColumns({"x_std": F.when(~F.col("coord_missing"), tx), "y_std": F.when(~F.col("coord_missing"), ty), "coord_suspect": ~F.col("coord_missing") & ~inside_box})
    return out.drop("_px", "_py", "_lon", "_lat")
