"""Join, area, geometry and resolution queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark import semantics as S
from tidemark.functions import text as X
from tidemark.operators import areas as A
from tidemark.operators import geo as G
from tidemark.operators import joins as J
from tidemark.operators import resolve as R
from tidemark.queries.registry import query

RINGS = {"a": (-30, -30, 0, 0), "b": (0, -30, 20, 10), "c": (-10, -10, 10, 15), "d": (5, 5, 40, 40), "e": (-40, 10, -10, 30)}


def areas(t):
    rows = [(k, [(float(x0), float(y0)), (float(x1), float(y0)), (float(x1), float(y1)), (float(x0), float(y1)), (float(x0), float(y0))]) for k, (x0, y0, x1, y1) in RINGS.items()]
    values = ", ".join(f"('{k}', array({', '.join(f'named_struct({chr(39)}x{chr(39)}, {x}D, {chr(39)}y{chr(39)}, {y}D)' for x, y in ring)}))" for k, ring in rows)
    return t.sql(f"SELECT * FROM VALUES {values} AS t(code, ring)")


_BOXES = "(VALUES " + ", ".join(f"('{k}', {a}, {b}, {c}, {d})" for k, (a, b, c, d) in RINGS.items()) + ") r(code, x0, y0, x1, y1)"


@query("j01_attach", "SELECT o_orderkey, c_name, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def attach(t):
    return J.attach(t.orders.select("o_orderkey", F.col("o_custkey").alias("k")), t.customer.select(F.col("c_custkey").alias("k"), "c_name", "c_mktsegment"), ["k"]).select("o_orderkey", "c_name", "c_mktsegment")


@query(
    "j04_strict_asof",
    """WITH pub AS (SELECT y AS year, make_date(y, 4, 30) AS available_at FROM range(1995, 2001) t(y)), ch AS (SELECT origin, origin_end, max(year) AS year, max(available_at) AS available_at FROM cal JOIN pub ON available_at <= origin_end GROUP BY 1, 2),
    pr AS (SELECT o_custkey AS pnu, year(o_orderdate) AS year, max(o_totalprice) AS price FROM orders WHERE o_custkey % 3 <> 0 OR year(o_orderdate) <> 1997 GROUP BY 1, 2)
    SELECT p.store_id, p.origin, ch.year, ch.available_at, pr.price FROM panel p LEFT JOIN ch USING (origin) LEFT JOIN pr ON pr.pnu = p.pnu AND pr.year = ch.year""",
)
def asof(t):
    published = t.spark.range(1995, 2001).select(F.col("id").cast("int").alias("year"), F.make_date(F.col("id").cast("int"), F.lit(4), F.lit(30)).alias("available_at"))
    o = t.orders.withColumn("year", F.year("o_orderdate")).filter("o_custkey % 3 <> 0 OR year <> 1997")
    prices = o.groupBy(F.col("o_custkey").alias("pnu"), "year").agg(F.max("o_totalprice").alias("price"))
    return J.strict_asof(t.panel().select("store_id", "origin", "origin_end", "pnu"), prices, published, "pnu").select("store_id", "origin", "year", "available_at", "price")


@query("j05_lagged", "SELECT p.store_id, p.origin, ((origin_no - 1) // 4) || 'Q' || ((origin_no - 1) % 4 + 1) AS quarter_used, qty, lines FROM panel p LEFT JOIN series s ON s.dong = p.dong AND s.q = origin_no - 1")
def lagged(t):
    table = t.series().select("dong", S.quarter_label("q").alias("quarter"), "qty", "lines")
    return J.lagged(t.panel().select("store_id", "origin", "dong"), table, ["dong"]).select("store_id", "origin", "quarter_used", "qty", "lines")


@query(
    "j08_full_series",
    """WITH o AS (SELECT c_nationkey AS dong, year(o_orderdate) * 4 + quarter(o_orderdate) - 1 AS q, count(*) AS opened FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2)
    SELECT coalesce(s.dong, o.dong)::BIGINT AS dong, coalesce(s.q, o.q) AS q, qty, opened FROM series s FULL JOIN o ON o.dong = s.dong AND o.q = s.q""",
)
def full(t):
    d = F.col("o_orderdate").cast("date")
    o = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("dong"), S.quarter_number(d).alias("q")).agg(F.count("*").alias("opened"))
    return J.full_series([t.series().select("dong", "q", "qty"), o], ["dong", "q"])


def grid(t):
    store, sales = t.code_rows()
    every = store.select("dong", "q", "code").unionByName(sales.select("dong", "q", "code"))
    return J.complete_grid([every.select(c).distinct() for c in ("dong", "q", "code")], [store, sales], ["dong", "q", "code"])


_FAMILY = "CASE WHEN code LIKE '%SMALL%' OR code LIKE '%MEDIUM%' THEN 'x' WHEN code LIKE '%LARGE%' OR code LIKE '%STANDARD%' THEN 'y' ELSE 'z' END"


@query("j09_complete_grid", "SELECT dong::BIGINT AS dong, q, code, total, opened, closed, sales, has_0, has_1 FROM code_grid")
def complete(t):
    return grid(t)


@query(
    "a01_observed_partial",
    f"""WITH g AS (SELECT *, {_FAMILY} AS biz_type FROM code_grid), a AS (SELECT dong, q, biz_type, count(*) FILTER (has_0) AS n_store, count(*) FILTER (has_1) AS n_sales, count(DISTINCT code) AS n_expected, sum(total)::BIGINT AS store_total,
    sum(opened)::BIGINT AS opened, sum(closed)::BIGINT AS closed, sum(sales)::BIGINT AS sales_amt, sum(total) FILTER (has_1)::BIGINT AS sales_total, count(*) FILTER (has_1 AND NOT has_0) AS n_unpaired FROM g GROUP BY 1, 2, 3)
    SELECT dong::BIGINT AS dong, q, biz_type, n_store, n_sales, round_even(n_store / 2, 6) AS store_coverage, n_store < 2 AS is_partial, store_total, round_even(CASE WHEN store_total > 0 THEN opened / store_total * 100 END, 6) AS open_rate,
    round_even(CASE WHEN store_total > 0 THEN closed / store_total * 100 END, 6) AS close_rate, sales_amt, round_even(CASE WHEN n_unpaired = 0 AND store_total > 0 THEN coalesce(sales_total, 0) / store_total END, 6) AS sales_store_coverage,
    round_even(CASE WHEN n_unpaired = 0 AND sales_total > 0 THEN sales_amt / sales_total END, 6) AS sales_per_store, n_unpaired FROM a""",
)
def partial(t):
    c = F.col("code")
    family = F.when(c.contains("SMALL") | c.contains("MEDIUM"), "x").when(c.contains("LARGE") | c.contains("STANDARD"), "y").otherwise("z")
    out = A.observed_partial(grid(t).withColumn("biz_type", family), ["dong", "q", "biz_type"], F.lit(2)).drop("n_expected")
    return out.withColumns({k: S.rounded(k) for k in ("store_coverage", "open_rate", "close_rate", "sales_store_coverage", "sales_per_store")})


@query(
    "a02_absence_evidence",
    """WITH g AS (SELECT *, lag(total) OVER (PARTITION BY dong, code ORDER BY q) AS b FROM code_grid) SELECT count(*) AS n_cells, count(*) FILTER (NOT has_0) AS n_no_row, count(*) FILTER (total = 0) AS n_zero,
    count(*) FILTER (b > 0 AND NOT has_0) AS stores_to_no_row, count(*) FILTER (b > 0 AND total = 0) AS stores_to_zero, count(*) FILTER (b = 0 AND NOT has_0) AS zero_to_no_row, count(*) FILTER (NOT has_0 AND has_1) AS sales_without_row,
    count(*) FILTER (NOT has_1 AND total > 0) AS stores_without_sales, count(*) FILTER (sales = 0) AS n_zero_sales FROM g""",
)
def absence(t):
    return A.absence_evidence(grid(t), ["dong", "code"], "q")


@query("a02_suppression_by_size", "SELECT CASE WHEN total <= 0 THEN '0' WHEN total <= 1 THEN '1' WHEN total <= 2 THEN '2' WHEN total <= 3 THEN '3' WHEN total <= 5 THEN '4-5' WHEN total <= 10 THEN '6-10' ELSE '11+' END AS size_bucket, count(*) AS n_cells, round_even(avg((NOT has_1)::INT), 6) AS sales_missing_rate FROM code_grid WHERE total IS NOT NULL GROUP BY 1")
def by_size(t):
    return A.suppression_by_size(grid(t)).withColumn("sales_missing_rate", S.rounded("sales_missing_rate"))


@query(
    "w02_last_change",
    """WITH v AS (SELECT dong, q, CASE WHEN lines % 3 <> 0 THEN lines % 4 END AS v FROM series), f AS (SELECT *, row_number() OVER w AS rn, lag(v) OVER w AS b FROM v WINDOW w AS (PARTITION BY dong ORDER BY q)),
    c AS (SELECT *, CASE WHEN v IS NULL OR b IS NULL OR v <> b THEN q END AS c FROM f) SELECT dong::BIGINT AS dong, q, v, last_value(c IGNORE NULLS) OVER (PARTITION BY dong ORDER BY q ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value_asof FROM c""",
)
def change(t):
    v = t.series().select("dong", "q", F.when(F.col("lines") % 3 != 0, F.col("lines") % 4).alias("v"))
    return v.withColumn("value_asof", A.last_change(v, "v", ["dong"], "q"))


@query(
    "a03_competition",
    """WITH ev AS (SELECT store_id, origin, origin_end, p.license_date AS own, biz_type, pnu, dong, (origin_end - INTERVAL 12 MONTH)::DATE AS before FROM panel p),
    pc AS (SELECT pnu, origin, count(*) AS n FROM panel WHERE pnu IS NOT NULL GROUP BY 1, 2), pt AS (SELECT pnu, biz_type, origin, count(*) AS n FROM panel WHERE pnu IS NOT NULL GROUP BY 1, 2, 3), dt AS (SELECT dong, biz_type, origin, count(*) AS n FROM panel WHERE dong IS NOT NULL GROUP BY 1, 2, 3),
    g AS (SELECT DISTINCT dong, biz_type, origin, origin_end, before FROM ev WHERE dong IS NOT NULL),
    db AS (SELECT g.dong, g.biz_type, g.origin, count(*) FILTER (s.license_date <= g.before AND (s.close_date IS NULL OR s.close_date > g.before)) AS n, count(*) FILTER (s.license_date > g.before AND s.license_date <= g.origin_end) AS opens, count(*) FILTER (s.close_date > g.before AND s.close_date <= g.origin_end) AS closes
      FROM g JOIN stores s ON s.dong = g.dong AND s.biz_type = g.biz_type GROUP BY 1, 2, 3)
    SELECT ev.store_id, ev.origin, pc.n - 1 AS pnu_cnt, pt.n - 1 AS pnu_same_type_cnt, dt.n - 1 AS dong_same_type_cnt, db.opens - (own > before)::INT AS dong_open_4q, db.closes AS dong_close_4q, round_even(CASE WHEN db.n > 0 THEN (dt.n - db.n) / db.n END, 6) AS dong_density_yoy
    FROM ev LEFT JOIN pc ON pc.pnu = ev.pnu AND pc.origin = ev.origin LEFT JOIN pt ON pt.pnu = ev.pnu AND pt.biz_type = ev.biz_type AND pt.origin = ev.origin LEFT JOIN dt ON dt.dong = ev.dong AND dt.biz_type = ev.biz_type AND dt.origin = ev.origin
    LEFT JOIN db ON db.dong = ev.dong AND db.biz_type = ev.biz_type AND db.origin = ev.origin""",
)
def competition(t):
    p = t.panel()
    out = A.competition(p, t.stores(), t.calendar())
    return out.withColumn("dong_density_yoy", S.rounded("dong_density_yoy"))


@query(
    "w03_mentions",
    """WITH qa AS (SELECT p_partkey AS store_id, p_partkey % 10 <> 0 AS ok, p_partkey % 7 = 0 AS truncated, CASE WHEN p_partkey % 7 = 0 THEN 1997 * 12 + 5 END AS tm FROM part WHERE p_partkey % 13 <> 0),
    pn AS (SELECT p_partkey AS store_id, origin, year(origin_end) * 12 + month(origin_end) - 1 AS e FROM part CROSS JOIN cal),
    j AS (SELECT pn.store_id, origin, e, coalesce(sum(mention_count) FILTER (e - month_no < 3), 0) AS c3, coalesce(sum(mention_count) FILTER (e - month_no < 6), 0) AS c6, coalesce(sum(mention_count) FILTER (e - month_no < 12), 0) AS c12, max(month_no) AS last
      FROM pn LEFT JOIN mentions m ON m.store_id = pn.store_id AND month_no <= e GROUP BY 1, 2, 3),
    f AS (SELECT j.*, coalesce(ok, false) AS seen, coalesce(truncated, false) AND tm IS NOT NULL AS cut, coalesce(truncated, false) AND NOT coalesce(last >= coalesce(tm, 0), false) AS blind, tm FROM j LEFT JOIN qa USING (store_id))
    SELECT store_id, origin, CASE WHEN seen AND NOT (cut AND e - 2 < tm) THEN c3 END::BIGINT AS cnt_3m, CASE WHEN seen AND NOT (cut AND e - 11 < tm) THEN c12 END::BIGINT AS cnt_12m, CASE WHEN seen AND NOT (cut AND e - 11 < tm) THEN (c12 > 0)::BIGINT END AS has_12m,
    CASE WHEN seen AND NOT (cut AND e - 11 < tm) THEN 2 * c6 - c12 END::BIGINT AS trend_6m, CASE WHEN seen AND NOT blind THEN (last IS NOT NULL)::BIGINT END AS has_ever, CASE WHEN seen AND NOT blind THEN e - last END AS months_since_last FROM f""",
)
def mentions(t):
    k = F.col("p_partkey")
    qa = t.part.filter("p_partkey % 13 <> 0").select(k.alias("store_id"), (k % 10 != 0).alias("ok"), (k % 7 == 0).alias("truncated"), F.when(k % 7 == 0, 1997 * 12 + 5).alias("trunc_month_no"))
    panel = t.part.select(k.alias("store_id")).crossJoin(F.broadcast(t.calendar()))
    return A.mentions(panel, t.mentions(), qa)


def sides(t):
    p = t.part.select("p_partkey", F.col("p_brand").alias("block"), F.col("p_name").alias("name"), F.element_at(F.split("p_name", " "), 1).alias("short"))
    return p.filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("store_id"), "block", "name", "short"), p.filter("p_partkey % 2 = 1").select(F.col("p_partkey").alias("entity"), "block", "name", "short")


@query(
    "j11_exact_tiers",
    """WITH p AS (SELECT p_partkey, p_brand AS block, p_name AS name, split_part(p_name, ' ', 1) AS short FROM part), l AS (SELECT * FROM p WHERE p_partkey % 2 = 0), c AS (SELECT * FROM p WHERE p_partkey % 2 = 1),
    v AS (SELECT l.p_partkey AS store_id, 1 AS tier, 0 AS variant, list_sort(list(DISTINCT c.p_partkey)) AS f FROM l JOIN c ON l.block = c.block AND l.name = c.name GROUP BY 1 UNION ALL SELECT l.p_partkey, 2, 1, list_sort(list(DISTINCT c.p_partkey)) FROM l JOIN c ON l.block = c.block AND l.short = c.short GROUP BY 1),
    r AS (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY CASE WHEN len(f) = 1 THEN 0 ELSE 1 END, CASE WHEN len(f) = 1 THEN variant ELSE -variant END) AS rn FROM v)
    SELECT store_id, tier::BIGINT AS tier, variant::BIGINT AS variant, len(f) = 1 AS matched, len(f) > 1 AS ambiguous, len(f) AS n_candidates, CASE WHEN len(f) = 1 THEN f[1] END AS entity, CASE WHEN len(f) > 1 THEN array_to_string(f[1:5], '|') END AS candidates FROM r WHERE rn = 1""",
)
def exact(t):
    left, right = sides(t)
    return J.tiers(left, right, [(1, "name", "name"), (2, "short", "short")], "block", "store_id", "entity")


@query("j12_fuzzy_tier")
def fuzzy(t):
    left, right = sides(t)
    return J.best_of_texts(left, right, "block", "store_id", "entity", "name", X.sequence_ratio, 0.75, 0.05, 20, 0.9)


@query("j20_cascade")
def cascade(t):
    left, right = sides(t)
    first = J.tiers(left, right, [(1, "name", "name")], "block", "store_id", "entity").select("store_id", "tier", "matched", "ambiguous", "entity")
    rest = J.remaining(left, first, "store_id")
    second = J.best_of_texts(rest, right, "block", "store_id", "entity", "name", X.sequence_ratio, 0.75, 0.05)
    both = first.unionByName(second.select("store_id", F.lit(3).alias("tier"), "matched", "ambiguous", "entity"))
    return left.select("store_id").join(both, "store_id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("matched", "ambiguous")})


@query(
    "n06_n07_name_similarity",
    """WITH p AS (SELECT a.p_partkey AS ka, b.p_partkey AS kb, a.p_name AS a, b.p_name AS b FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey),
    g AS (SELECT *, list_distinct([a[i:i + 1] for i in range(1, len(a))]) AS x, list_distinct([b[i:i + 1] for i in range(1, len(b))]) AS y FROM p)
    SELECT ka, kb, CASE WHEN a = b THEN 'exact' WHEN contains(a, b) OR contains(b, a) THEN 'containment' ELSE 'other' END AS structure, round_even(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 6) AS bigram FROM g""",
)
def similarity(t):
    p, similar = X.bigram_bits(t.part.select("p_partkey", "p_brand", "p_size", F.col("p_name").alias("name")), "name")
    pairs = p.alias("l").join(p.alias("r"), ["p_brand", "p_size"]).filter("l.p_partkey < r.p_partkey")
    structure, share = similar("l", "r")
    return pairs.select(F.col("l.p_partkey").alias("ka"), F.col("r.p_partkey").alias("kb"), structure.alias("structure"), S.rounded_share(share).alias("bigram"))


@query("j13_radius", "SELECT a.id AS id_l, b.id AS id_r, round_even(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 6) AS distance FROM points a JOIN points b ON a.id < b.id AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 3")
def radius(t):
    p = t.points()
    pairs = G.radius_join(p.toDF("id_l", "x_l", "y_l"), p.toDF("id_r", "x_r", "y_r"), 3.0).filter("id_l < id_r")
    return pairs.select("id_l", "id_r", S.rounded("distance").alias("distance"))


def _contained(op: str) -> str:
    c = f"x {op} x0 AND x {'<' if op == '>' else '<='} x1 AND y {op} y0 AND y {'<' if op == '>' else '<='} y1"
    return f"WITH j AS (SELECT id, list_sort(list(code)) AS codes FROM points JOIN {_BOXES} ON {c} GROUP BY 1) SELECT p.id, coalesce(len(codes), 0) AS n_areas, CASE WHEN len(codes) = 1 THEN codes[1] END AS code, coalesce(len(codes), 0) > 1 AS ambiguous, coalesce(array_to_string(codes[1:5], '|'), '') AS candidates FROM points p LEFT JOIN j ON j.id = p.id"


@query("j14_within", _contained(">"))
def within(t):
    return G.contained(t.points(), areas(t), 25.0).drop("x", "y")


@query("j15_intersects", _contained(">="))
def intersects(t):
    return G.contained(t.points(), areas(t), 25.0, boundary=True).drop("x", "y")


@query(
    "j17_nearest_two",
    """WITH pl AS (SELECT label AS code, round_even(embedding[1]::DOUBLE * 100, 3) AS x, round_even(embedding[2]::DOUBLE * 100, 3) AS y FROM embeddings WHERE vec_id % 10 = 0),
    d AS (SELECT p.id, pl.code, min(sqrt((p.x - pl.x) * (p.x - pl.x) + (p.y - pl.y) * (p.y - pl.y))) AS d FROM points p CROSS JOIN pl GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, code) AS rn FROM d)
    SELECT a.id, a.code::BIGINT AS nearest, round_even(a.d, 6) AS distance, b.code::BIGINT AS second, round_even(b.d, 6) AS second_distance, round_even(b.d - a.d, 6) AS gap FROM r a LEFT JOIN r b ON a.id = b.id AND b.rn = 2 WHERE a.rn = 1""",
)
def nearest(t):
    e = t.embeddings.filter("vec_id % 10 = 0").select(F.col("label").alias("code"), F.bround(F.col("embedding")[0].cast("double") * 100, 3).alias("x"), F.bround(F.col("embedding")[1].cast("double") * 100, 3).alias("y"))
    return G.nearest_two(t.points(), e, (5.0, 20.0, 200.0)).withColumns({c: S.rounded(c) for c in ("distance", "second_distance", "gap")})


@query("j18_overlaps", f"SELECT r.code AS code_a, b.code AS code_b, ((least(r.x1, b.x1) - greatest(r.x0, b.x0)) * (least(r.y1, b.y1) - greatest(r.y0, b.y0)))::DOUBLE AS overlap FROM {_BOXES} JOIN {_BOXES.replace(' r(', ' b(')} ON r.code < b.code AND least(r.x1, b.x1) > greatest(r.x0, b.x0) AND least(r.y1, b.y1) > greatest(r.y0, b.y0)")
def overlaps(t):
    return G.overlaps(areas(t), 25.0).withColumn("overlap", S.rounded("overlap"))


@query("g01_polygon_area", f"SELECT code, ((x1 - x0) * (y1 - y0))::DOUBLE AS area FROM {_BOXES}")
def polygon(t):
    return areas(t).select("code", G.polygon_area(F.col("ring")).alias("area"))


_E2 = "(1 / 298.257222101 * (2 - 1 / 298.257222101))"


def _arc(phi):
    e = _E2
    return f"6378137.0 * ((1 - {e} / 4 - 3 * pow({e}, 2) / 64 - 5 * pow({e}, 3) / 256) * {phi} - (3 * {e} / 8 + 3 * pow({e}, 2) / 32 + 45 * pow({e}, 3) / 1024) * sin(2 * {phi}) + (15 * pow({e}, 2) / 256 + 45 * pow({e}, 3) / 1024) * sin(4 * {phi}) - (35 * pow({e}, 3) / 3072) * sin(6 * {phi}))"


@query(
    "g02_projection",
    f"""WITH a AS (SELECT id, radians(37.5 + y / 1000) AS phi, radians(126.9 + x / 1000 - 127.5) AS dl, {_E2} / (1 - {_E2}) AS ep FROM points), b AS (SELECT *, 6378137.0 / sqrt(1 - {_E2} * pow(sin(phi), 2)) AS n, pow(tan(phi), 2) AS t, ep * pow(cos(phi), 2) AS c, dl * cos(phi) AS a, {_arc('phi')} - {_arc('radians(38.0)')} AS m FROM a)
    SELECT id, round_even(1000000.0 + 0.9996 * n * (a + (1 - t + c) * pow(a, 3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep) * pow(a, 5) / 120), 3) AS east, round_even(2000000.0 + 0.9996 * (m + n * tan(phi) * (a * a / 2 + (5 - t + 9 * c + 4 * c * c) * pow(a, 4) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep) * pow(a, 6) / 720)), 3) AS north FROM b""",
)
def projection(t):
    lon, lat = 126.9 + F.col("x") / 1000, 37.5 + F.col("y") / 1000
    east, north = G.transverse_mercator(lon, lat)
    return t.points().select("id", F.bround(east, 3).alias("east"), F.bround(north, 3).alias("north"))


@query("g03_grid_cells", "SELECT floor(x / 5)::BIGINT AS cx, floor(y / 5)::BIGINT AS cy, count(*) AS n FROM points GROUP BY 1, 2")
def cells(t):
    return t.points().groupBy(G.cell(F.col("x"), 5.0).alias("cx"), G.cell(F.col("y"), 5.0).alias("cy")).agg(F.count("*").alias("n"))


@query("a05_presence", "SELECT id, " + ", ".join(f"max((snapshot = {s})::BIGINT) AS s_{s}" for s in range(7984, 7991)) + " FROM snapshots GROUP BY 1")
def presence(t):
    return R.presence_matrix(t.snapshots(), "id", "snapshot", range(7984, 7991))


_SEEN = "r AS (SELECT id, snapshot AS s, lag(snapshot) OVER w AS b, lead(snapshot) OVER w AS a FROM snapshots WINDOW w AS (PARTITION BY id ORDER BY snapshot))"


@query(
    "a06_transitions",
    f"""WITH {_SEEN}, i AS (SELECT s, count(*) FILTER (b = s - 1) AS retained, count(*) FILTER (b < s - 1) AS reappeared, count(*) FILTER (b IS NULL) AS brand_new FROM r GROUP BY 1),
    o AS (SELECT s + 1 AS s, count(*) FILTER (a IS NULL OR a > s + 1) AS lost, count(*) FILTER (a IS NULL) AS lost_forever FROM r GROUP BY 1)
    SELECT i.s - 1 AS from_snapshot, i.s AS to_snapshot, retained, lost, lost_forever, reappeared + brand_new AS new, brand_new, reappeared FROM i JOIN o ON o.s = i.s WHERE i.s > 7984""",
)
def transitions(t):
    return R.transitions(t.snapshots(), "id", "snapshot")


_LINKS = '''f AS (SELECT id, block, name, min(snapshot) AS first, max(snapshot) AS last FROM snapshots GROUP BY 1, 2, 3), pr AS (SELECT o.last + 1 - 7983 AS "at", o.id AS old_id, n.id AS new_id, o.block, o.name FROM f o JOIN f n ON n.first = o.last + 1 AND n.block = o.block AND n.name = o.name),
    lk AS (SELECT "at", old_id, new_id, count(*) OVER (PARTITION BY "at", block, name, old_id) > 1 OR count(*) OVER (PARTITION BY "at", block, name, new_id) > 1 AS ambiguous FROM pr)'''


def links(t):
    return R.reissue_links(t.snapshots(), "id", "snapshot", ["block", "name"])


@query("j19_reissue_links", f"WITH {_LINKS} SELECT * FROM lk")
def reissue(t):
    return links(t)


@query("m31_chain_roots", f"WITH RECURSIVE {_LINKS}, cl AS (SELECT old_id, new_id FROM lk WHERE NOT ambiguous), u AS (SELECT new_id AS id, old_id AS root, 1 AS n FROM cl UNION ALL SELECT u.id, cl.old_id, n + 1 FROM u JOIN cl ON cl.new_id = u.root) SELECT id, arg_max(root, n) AS root FROM u GROUP BY 1")
def roots(t):
    return R.chain_roots(links(t).filter("NOT ambiguous"), "old_id", "new_id", 7)


@query(
    "a07_entities",
    f"""WITH RECURSIVE {_LINKS}, cl AS (SELECT old_id, new_id FROM lk WHERE NOT ambiguous), u AS (SELECT new_id AS id, old_id AS root, 1 AS n FROM cl UNION ALL SELECT u.id, cl.old_id, n + 1 FROM u JOIN cl ON cl.new_id = u.root), rt AS (SELECT id, arg_max(root, n) AS root FROM u GROUP BY 1),
    so AS (SELECT snapshot, row_number() OVER (ORDER BY snapshot) AS no FROM (SELECT DISTINCT snapshot FROM snapshots)), per AS (SELECT s.id, arg_max(name, (no, name)) AS name_last, arg_max(block, (no, block)) AS block_last, min(s.snapshot) AS first_seen, max(s.snapshot) AS last_seen, count(DISTINCT no) AS n_snapshots,
    max(no) - min(no) + 1 > count(DISTINCT no) AS has_gap, count(DISTINCT name) AS n_name, count(DISTINCT block) AS n_block FROM snapshots s JOIN so USING (snapshot) GROUP BY 1), e AS (SELECT per.*, coalesce(root, per.id) AS entity_id FROM per LEFT JOIN rt ON rt.id = per.id)
    SELECT *, count(*) OVER w AS entity_size, min(first_seen) OVER w AS entity_first, max(last_seen) OVER w AS entity_last FROM e WINDOW w AS (PARTITION BY entity_id)""",
)
def entities(t):
    rows = t.snapshots()
    r = R.chain_roots(links(t).filter("NOT ambiguous"), "old_id", "new_id", 7)
    return R.entities(rows, r, "id", "snapshot", ["name", "block"])


@query("w13_last_by_order", "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_order, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_order, count(*) AS n FROM orders GROUP BY 1")
def last_by(t):
    return J.ends_by_order(t.orders, "o_custkey", "o_orderkey", ["o_orderdate", "o_orderkey"]).withColumnsRenamed({"first": "first_order", "last": "last_order"})


@query("j24_new_wins", "SELECT coalesce(a.k, b.k) AS k, coalesce(b.v, a.v) AS v, CASE WHEN b.v IS NULL THEN 'carried' ELSE 'new' END AS origin_of_value FROM (SELECT o_orderkey AS k, o_orderstatus AS v FROM orders WHERE o_orderkey % 3 <> 0) a FULL JOIN (SELECT o_orderkey AS k, o_orderpriority AS v FROM orders WHERE o_orderkey % 4 = 0) b ON a.k = b.k")
def carried(t):
    k = F.col("o_orderkey").alias("k")
    return J.new_wins(t.orders.filter("o_orderkey % 3 <> 0").select(k, F.col("o_orderstatus").alias("v")), t.orders.filter("o_orderkey % 4 = 0").select(k, F.col("o_orderpriority").alias("v")), ["k"], "v")


POLICIES = [("p1", None, None, None, None, []), ("p2", ["1", "2"], ["1-URGENT"], 12, None, []), ("p3", ["3"], None, None, 24, []), ("p4", None, ["5-LOW", "2-HIGH"], 36, 60, ["x"])]


@query(
    "j25_policy_match",
    """WITH pol(id, gu_in, biz_in, tenure_min, tenure_max, unv) AS (VALUES ('p1', NULL::VARCHAR[], NULL::VARCHAR[], NULL::INT, NULL::INT, false), ('p2', ['1', '2'], ['1-URGENT'], 12, NULL, false), ('p3', ['3'], NULL, NULL, 24, false), ('p4', NULL, ['5-LOW', '2-HIGH'], 36, 60, true)),
    s AS (SELECT store_id, gu::VARCHAR AS g, biz_type, CASE WHEN store_id % 9 <> 0 THEN 24001 - year(license_date) * 12 - month(license_date) END AS m FROM stores)
    SELECT store_id, id, CASE WHEN unv OR ((tenure_min IS NOT NULL OR tenure_max IS NOT NULL) AND m IS NULL) THEN 'check_required' ELSE 'matched' END AS eligibility FROM s JOIN pol ON (gu_in IS NULL OR list_contains(gu_in, g)) AND (biz_in IS NULL OR list_contains(biz_in, biz_type))
    AND (m IS NULL OR ((tenure_min IS NULL OR m >= tenure_min) AND (tenure_max IS NULL OR m <= tenure_max)))""",
)
def policies(t):
    schema = "id string, gu_in array<string>, biz_in array<string>, tenure_min int, tenure_max int, unverifiable array<string>"
    p = t.spark.createDataFrame(POLICIES, schema)
    s = t.stores().select("store_id", F.col("gu").cast("string").alias("gu"), "biz_type", F.when(F.col("store_id") % 9 != 0, 24001 - F.year("license_date") * 12 - F.month("license_date")).alias("tenure_months"))
    return J.eligible(s, p, {"gu": "gu_in", "biz_type": "biz_in"}).select("store_id", "id", "eligibility")


@query("j26_semi_anti", "SELECT count(*) FILTER (o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)) AS semi, count(*) FILTER (NOT EXISTS (SELECT 1 FROM customer WHERE c_acctbal > 5000 AND c_custkey = o_custkey)) AS anti FROM orders")
def semi(t):
    ids = t.customer.filter("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    a = t.orders.join(ids, "o_custkey", "left_semi").agg(F.count("*").alias("semi"))
    return a.crossJoin(t.orders.join(ids, "o_custkey", "left_anti").agg(F.count("*").alias("anti")))


@query("j31_reason_precedence", "SELECT CASE WHEN gu IS NULL THEN 'missing' WHEN area < 2000 THEN 'suspect' WHEN store_id % 11 = 0 THEN 'ambiguous' ELSE 'within' END AS reason, count(*) AS n FROM stores GROUP BY 1")
def reasons(t):
    rule = J.first_reason([("missing", F.col("gu").isNull()), ("suspect", F.col("area") < 2000), ("ambiguous", F.col("store_id") % 11 == 0)], "within")
    return t.stores().groupBy(rule.alias("reason")).agg(F.count("*").alias("n"))


@query("j34_changed_rows", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus END AS before, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END AS after FROM orders WHERE (o_orderkey % 5 = 0) <> (o_orderkey % 3 = 0)")
def changed(t):
    k, s = F.col("o_orderkey"), F.col("o_orderstatus")
    return J.changed_rows(t.orders.select(k, F.when(k % 5 != 0, s).alias("v")), t.orders.select(k, F.when(k % 3 != 0, s).alias("v")), "o_orderkey", "v")


@query("s12_price_years", "SELECT lpad(o_custkey::VARCHAR, 19, '0') AS pnu, year(o_orderdate)::BIGINT AS year, max(o_orderpriority) AS price, count(*) AS n_rows FROM orders GROUP BY 1, 2 HAVING count(DISTINCT o_orderpriority) <= 1")
def prices(t):
    raw = t.orders.select(F.lpad(F.col("o_custkey").cast("string"), 19, "0").alias("pnu"), F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("price"))
    return A.price_year(raw, "pnu", "year", "price")


@query("a09_monthly_buckets", "SELECT user_id, strftime(ts, '%Y%m') AS month, count(*) AS n_posts, count(*) FILTER (event_type = 'purchase') AS n_sponsored, round_even(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def buckets(t):
    return t.events.groupBy("user_id", F.date_format("ts", "yyyyMM").alias("month")).agg(F.count("*").alias("n_posts"), F.count_if(F.col("event_type") == "purchase").alias("n_sponsored"), S.rounded(F.sum("value"), 4).alias("total"))


@query("u01_ragged_union", "SELECT n_name AS name, n_nationkey::BIGINT AS nation, NULL::BIGINT AS region FROM nation UNION ALL SELECT r_name, NULL, r_regionkey::BIGINT FROM region")
def ragged(t):
    return t.nation.select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("nation")).unionByName(t.region.select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("region")), allowMissingColumns=True)


@query("u07_unambiguous_mapping", "SELECT l_orderkey, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) = 1")
def mapping(t):
    return J.unambiguous(t.lineitem, ["l_orderkey"], "l_returnflag")


@query("u03_first_by_key", "SELECT p_brand, p_name, min(p_partkey) AS p_partkey FROM part GROUP BY 1, 2")
def first_by_key(t):
    return J.first_by_key(t.part.select("p_brand", "p_name", "p_partkey"), ["p_brand", "p_name"], ["p_partkey"])
