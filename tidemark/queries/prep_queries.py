"""Preparation of columns, joins of registries, and windows."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark import semantics as S
from tidemark.functions import text as X
from tidemark.operators import geo as G
from tidemark.operators import joins as J
from tidemark.operators import models as ML
from tidemark.operators import prep as P
from tidemark.operators import resolve as RS
from tidemark.queries.registry import FIRST, LAST, query


def text(c):
    return F.col(c).cast("string")


@query("p01_store_ids", "SELECT 'P' || substr(o_orderpriority, 1, 1) || '_' || o_orderkey AS store_id FROM orders")
def store_ids(t):
    from tidemark.sources import readers as R

    rows = t.orders.select("o_orderpriority", F.concat(F.lit(" "), text("o_orderkey"), F.lit(" ")).alias("no"))
    table = {"1-URGENT": "P1", "2-HIGH": "P2", "3-MEDIUM": "P3", "4-NOT SPECIFIED": "P4", "5-LOW": "P5"}
    return R.store_ids(rows, "o_orderpriority", "no", table).select("store_id")


@query("p03_panel_features", "SELECT store_id, origin, age_months, round_even(area, 2) AS area_m2, dong % 3 <> 0 AS has_coord, '202501' AS source_snapshot FROM panel")
def panel_features(t):
    p = t.panel().drop("age_months").withColumns({"area_text": F.format_number("area", 2), "x": F.when(F.col("dong") % 3 != 0, F.lit(1.0)), "y": F.lit(1.0)})
    out = P.panel_features(p, "license_date", "origin_end", "area_text", "x", "y", "202501")
    return out.select("store_id", "origin", "age_months", S.rounded("area_m2", 2).alias("area_m2"), F.coalesce("has_coord", F.lit(False)).alias("has_coord"), "source_snapshot")


@query("p04_output_columns", "SELECT o_orderstatus, o_orderkey FROM orders")
def output(t):
    return P.output_columns(t.orders, ["o_orderstatus", "o_orderkey"])


@query("p05_numbers", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN round_even(o_totalprice, 2) END AS price FROM orders")
def numbers(t):
    rows = t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 4 == 0, " ").otherwise(F.format_number("o_totalprice", 2)).alias("price"))
    return P.numeric(rows, ["price"]).select("o_orderkey", S.rounded("price", 2).alias("price"))


@query("p06_yes_no", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 END AS answer FROM orders")
def yes_no(t):
    code = F.when(F.col("o_orderkey") % 3 == 0, "1").when(F.col("o_orderkey") % 3 == 1, " 2").otherwise("")
    return P.yes_no(t.orders.select("o_orderkey", code.alias("answer")), ["answer"])


@query("p07_tenure_and_margin", "SELECT p_partkey, (p_size = 1)::INT::BIGINT AS tenure_invalid, CASE WHEN p_size <> 1 THEN (2024 * 12 + 6 - ((1970 + p_size) * 12 + p_partkey % 12 + 1))::DOUBLE END AS tenure_months, CASE WHEN p_partkey % 6 <> 0 THEN round_even((p_size - 10) / (p_partkey % 6), 6) END AS profit_margin, (p_partkey % 6 = 0)::INT::BIGINT AS zero_revenue FROM part")
def tenure(t):
    k = F.col("p_partkey")
    rows = t.part.select("p_partkey", F.when(F.col("p_size") == 1, 1900).otherwise(1970 + F.col("p_size")).alias("y"), (k % 12 + 1).alias("m"), (k % 6).cast("double").alias("revenue"), (F.col("p_size") - 10).cast("double").alias("profit"))
    out = P.margin(P.tenure(rows, "y", "m", (2024, 6), 1900, 1950, 2024), "revenue", "profit")
    return out.select("p_partkey", "tenure_invalid", "tenure_months", S.rounded("profit_margin").alias("profit_margin"), "zero_revenue")


@query("p09_treatment", "WITH r AS (SELECT p_partkey, CASE WHEN p_partkey % 7 <> 0 THEN (p_size % 2)::BIGINT END AS a, CASE WHEN p_partkey % 7 <> 0 THEN (p_size % 3 = 0)::INT::BIGINT END AS b, p_partkey % 5 AS total FROM part) SELECT p_partkey, a + b AS n_channels, (a + b > 0)::INT::BIGINT AS treated, CASE WHEN coalesce(a + b, 0) > 0 AND total = 0 THEN 'used_without_sales' WHEN coalesce(a + b, 0) = 0 AND total > 0 THEN 'sales_without_use' END AS contradiction FROM r")
def treatment(t):
    known = F.col("p_partkey") % 7 != 0
    rows = t.part.select("p_partkey", F.when(known, F.col("p_size") % 2).alias("a"), F.when(known, (F.col("p_size") % 3 == 0).cast("int")).alias("b"), (F.col("p_partkey") % 5).alias("total"))
    return P.treatment(rows, ["a", "b"], "total").select("p_partkey", "n_channels", "treated", "contradiction")


@query(
    "p10_design_matrix",
    """SELECT p_partkey, (p_type = 'ECONOMY')::INT::DOUBLE AS "kind_ECONOMY", (p_type = 'LARGE')::INT::DOUBLE AS "kind_LARGE", (p_type = 'MEDIUM')::INT::DOUBLE AS "kind_MEDIUM", (p_type = 'PROMO')::INT::DOUBLE AS "kind_PROMO",
    (p_type = 'SMALL')::INT::DOUBLE AS "kind_SMALL", (p_type = 'STANDARD')::INT::DOUBLE AS "kind_STANDARD", CASE WHEN p_size > 5 THEN p_size::DOUBLE ELSE 0 END AS months, (p_size <= 5)::INT::DOUBLE AS flag FROM part""",
)
def design(t):
    rows = t.part.select("p_partkey", F.col("p_type").alias("kind"), F.lit("x").alias("same"), F.when(F.col("p_size") > 5, F.col("p_size")).alias("months"), (F.col("p_size") <= 5).cast("int").alias("flag"))
    return P.design(rows, ["kind", "same"], "months", "flag", "p_partkey")


@query("p11_model_columns", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE -1 END::DOUBLE AS status, (o_totalprice > 100000)::INT::DOUBLE AS large, o_custkey::DOUBLE AS cust FROM orders")
def typed(t):
    rows = t.orders.select("o_orderkey", F.col("o_orderstatus").alias("status"), (F.col("o_totalprice") > 100000).alias("large"), F.col("o_custkey").alias("cust"))
    return P.model_columns(rows, ["status", "large", "cust"], {"status": ["F", "O"]})


@query("p12_feature_sets", "SELECT unnest(['area', 'age']) AS predictor, unnest([1, 2]) AS place")
def features(t):
    roles = {"store_id": "key", "area": "predictor", "event": "label", "age": "predictor", "mentions": "predictor"}
    chosen = P.feature_set(list(roles), roles, {"area": "base", "age": "base", "mentions": "online"}, ["base"])
    return t.spark.createDataFrame([(c, i + 1) for i, c in enumerate(chosen)], "predictor string, place long")


_TENURE = "CASE WHEN {0} IS NULL THEN 'missing' WHEN NOT ({0} >= 0 AND {0} % 1 = 0) THEN 'invalid' WHEN {0} < 12 THEN '0-11' WHEN {0} < 36 THEN '12-35' WHEN {0} < 60 THEN '36-59' WHEN {0} < 120 THEN '60-119' ELSE '120+' END"


@query("p14_categories", f"WITH r AS (SELECT p_partkey, CASE WHEN p_partkey % 9 <> 0 THEN CASE WHEN p_partkey % 8 = 0 THEN p_size + 0.5 ELSE p_size * 4.0 - 8 END END AS m, p_partkey % 10 = 3 AS bad, CASE WHEN p_partkey % 9 <> 1 THEN (p_partkey % 7)::DOUBLE END AS s FROM part) SELECT p_partkey, CASE WHEN bad THEN 'invalid' ELSE {_TENURE.format('m')} END AS tenure, CASE WHEN s IS NULL THEN 'missing' WHEN s < 1 THEN 'invalid' WHEN s < 2 THEN '1' WHEN s < 3 THEN '2' WHEN s < 5 THEN '3-4' ELSE '5+' END AS size FROM r")
def categories(t):
    k = F.col("p_partkey")
    rows = t.part.select("p_partkey", F.when(k % 9 != 0, F.when(k % 8 == 0, F.col("p_size") + 0.5).otherwise(F.col("p_size") * 4.0 - 8)).alias("m"), (k % 10 == 3).cast("int").alias("bad"), F.when(k % 9 != 1, (k % 7).cast("double")).alias("s"))
    return rows.select("p_partkey", P.tenure_category("m", F.col("bad")).alias("tenure"), P.size_category("s").alias("size"))


@query("p18_priority", "SELECT store_id, close_date IS NULL OR close_date >= DATE '1997-01-01' AS priority FROM stores")
def priority(t):
    return t.stores().select("store_id", P.priority("close_date", F.lit("1997-01-01").cast("date")).alias("priority"))


_KNOTS = "(SELECT quantile_cont(c_acctbal, [0.05, 0.35, 0.65, 0.95]) AS t FROM customer)"


def _cube(k):
    return f"pow(greatest(c_acctbal - t[{k}], 0), 3)"


def _basis(j):
    return f"round_even(({_cube(j)} - {_cube(3)} * (t[4] - t[{j}]) / (t[4] - t[3]) + {_cube(4)} * (t[3] - t[{j}]) / (t[4] - t[3])) / pow(t[4] - t[1], 2), 4)"


@query("p21_spline_basis", f"SELECT c_custkey, {_basis(1)} AS s1, {_basis(2)} AS s2 FROM customer, {_KNOTS}")
def spline(t):
    basis = P.spline_basis("c_acctbal", P.spline_knots(t.customer, "c_acctbal"))
    return t.customer.select("c_custkey", S.rounded(basis[1], 4).alias("s1"), S.rounded(basis[2], 4).alias("s2"))


@query("p22_missing_reasons", "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'not_collected' WHEN 'FURNITURE' THEN CASE WHEN c_nationkey % 2 = 0 THEN 'not_published' ELSE 'outside_area' END WHEN 'MACHINERY' THEN CASE WHEN c_nationkey % 2 = 0 THEN 'no_sales' ELSE 'outside_area' END ELSE 'unknown' END AS reason FROM customer")
def reasons(t):
    rows = t.customer.select("c_custkey", F.col("c_mktsegment").alias("factor"), F.when(F.col("c_nationkey") % 2 == 0, F.col("c_nationkey")).alias("place"))
    return rows.select("c_custkey", P.missing_reason("factor", "place", "BUILDING", {"FURNITURE": "not_published", "MACHINERY": "no_sales"}).alias("reason"))


@query("p23_standardised", "SELECT 'S_' || s_suppkey AS store_id, lower(regexp_replace(s_name, '[^0-9a-zA-Z가-힣]', '', 'g')) AS name_key, make_date(1990 + s_suppkey % 9, 5, 1) AS license_date, s_suppkey % 13 <> 0 AS has_coord FROM supplier WHERE s_nationkey < 20")
def standardised(t):
    from tidemark.sources import readers as R

    k = F.col("s_suppkey")
    raw = t.supplier.select(F.lit("S").alias("kind"), k.cast("string").alias("no"), F.concat(F.lit(" "), F.col("s_name")).alias("name"), text("s_nationkey").alias("district"), F.concat((1990 + k % 9).cast("string"), F.lit("-05-01")).alias("opened"), F.when(k % 13 != 0, "127.0").alias("lon"))
    kept = R.store_ids(P.coded(raw, "district", range(20)), "kind", "no", {"S": "S"})
    return kept.select("store_id", X.match_key(F.trim("name")).alias("name_key"), S.parsed_date("opened").alias("license_date"), F.col("lon").try_cast("double").isNotNull().alias("has_coord"))


@query("p24_stages", "SELECT (SELECT count(*) FROM orders) AS n_all, count(*) AS n_treated FROM orders WHERE o_orderstatus = 'F'")
def stages(t):
    whole, part = P.stages(t.orders.select("o_orderkey", (F.col("o_orderstatus") == "F").cast("int").alias("d")), "d", "o_orderkey")
    return whole.agg(F.count("*").alias("n_all")).crossJoin(part.agg(F.count("*").alias("n_treated")))


@query("f01_expected_rows", "SELECT s_suppkey FROM supplier WHERE s_nationkey IN (1, 2, 3)")
def expected(t):
    kept = P.coded(t.supplier, "s_nationkey", [1, 2, 3])
    return P.expected(kept, t.supplier.filter("s_nationkey BETWEEN 1 AND 3").count(), "districts").select("s_suppkey")


@query("f03_industries", "SELECT p_partkey FROM part WHERE p_type IN ('PROMO', 'SMALL')")
def industries(t):
    return P.coded(t.part, "p_type", ["PROMO", "SMALL"]).select("p_partkey")


@query("f08_short_names", "SELECT n_nationkey, length(n_name) <= 8 AS short_name, CASE WHEN length(n_name) > 8 THEN n_regionkey END AS posts FROM nation")
def short(t):
    return P.without_short_names(t.nation.select("n_nationkey", "n_name", F.col("n_regionkey").alias("posts")), "n_name", ["posts"], 8).drop("n_name")


@query("f09_date_bounds", """WITH r AS (SELECT o_custkey AS k, o_orderstatus AS g, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderdate::DATE END AS lo, CASE WHEN o_orderstatus <> 'O' THEN (o_orderdate::DATE + INTERVAL 90 DAY)::DATE END AS hi FROM orders),
    own AS (SELECT k, g, CASE WHEN bool_and(lo IS NOT NULL) THEN min(lo) END AS lower, CASE WHEN bool_and(hi IS NOT NULL) THEN max(hi) END AS upper FROM r GROUP BY 1, 2)
    SELECT k, g, lower, upper, CASE WHEN bool_and(lower IS NOT NULL) OVER w THEN min(lower) OVER w END AS any_lower, CASE WHEN bool_and(upper IS NOT NULL) OVER w THEN max(upper) OVER w END AS any_upper FROM own WINDOW w AS (PARTITION BY k)""")
def bounds(t):
    d = F.col("o_orderdate").cast("date")
    rows = t.orders.select(F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("g"), F.when(F.col("o_orderkey") % 11 != 0, d).alias("lo"), F.when(F.col("o_orderstatus") != "O", F.date_add(d, 90)).alias("hi"))
    return P.date_bounds(rows, "k", "g", "lo", "hi")


@query("f11_predictors_only", "SELECT 'area' AS predictor")
def predictors(t):
    roles = {"store_id": "key", "area": "predictor", "event": "label"}
    chosen = ML.check_predictors([c for c in roles if roles[c] == "predictor"], roles)
    return t.spark.createDataFrame([(c,) for c in chosen], "predictor string")


@query("l11_final_origins", "SELECT n AS origin_no, CASE WHEN n >= 7999 THEN 'test' WHEN n >= 7997 THEN 'calibrate' ELSE 'train' END AS part FROM range(7984, 8002) r(n) WHERE n >= 7997 OR n < 7997 - 4")
def split(t):
    parts = P.final_origins(range(FIRST, LAST + 1), 3, 2, 4)
    return t.spark.createDataFrame([(o, k) for k, v in parts.items() for o in v], "origin_no long, part string")


@query("j02_store_attributes", "SELECT p.store_id, p.origin, c_mktsegment AS segment, n_name AS nation FROM panel p LEFT JOIN customer ON c_custkey = pnu LEFT JOIN nation ON n_nationkey = dong")
def attributes(t):
    segments = t.customer.select(F.col("c_custkey").alias("pnu"), F.col("c_mktsegment").alias("segment"))
    nations = t.nation.select(F.col("n_nationkey").alias("dong"), F.col("n_name").alias("nation"))
    return J.attach(J.attach(t.panel(), segments, ["pnu"]), nations, ["dong"]).select("store_id", "origin", "segment", "nation")


@query("j06_lagged_by_three_keys", "WITH s AS (SELECT s_nationkey AS dong, CASE WHEN s_suppkey % 2 = 0 THEN '1-URGENT' ELSE '5-LOW' END AS biz_type, year(l_shipdate) * 4 + quarter(l_shipdate) - 1 AS q, count(*) AS lines FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2, 3) SELECT p.store_id, p.origin, s.lines FROM panel p LEFT JOIN s ON s.dong = p.dong AND s.biz_type = p.biz_type AND s.q = origin_no - 1")
def lagged(t):
    d = F.col("l_shipdate").cast("date")
    rows = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("s_nationkey").alias("dong"), F.when(F.col("s_suppkey") % 2 == 0, "1-URGENT").otherwise("5-LOW").alias("biz_type"), (F.year(d) * 4 + F.quarter(d) - 1).alias("q"))
    table = rows.groupBy("dong", "biz_type", "q").agg(F.count("*").alias("lines")).withColumn("quarter", S.quarter_label("q")).drop("q")
    return J.lagged(t.panel(), table, ["dong", "biz_type"]).select("store_id", "origin", "lines")


@query("j07_extension", "SELECT o_orderkey AS store_id, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END AS posts, o_orderkey % 3 = 0 AS collected FROM orders")
def extension(t):
    right = t.orders.filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("store_id"), F.col("o_custkey").alias("posts"), F.lit(True).alias("collected"))
    return J.attach(t.orders.select(F.col("o_orderkey").alias("store_id")), right, ["store_id"]).withColumn("collected", F.coalesce("collected", F.lit(False)))


@query("j10_yearly_prices", "SELECT p_partkey, round_even(max(l_extendedprice) FILTER (year(l_shipdate) = 1996), 2) AS price_1996, round_even(max(l_extendedprice) FILTER (year(l_shipdate) = 1997), 2) AS price_1997 FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1")
def prices(t):
    per = t.lineitem.groupBy(F.col("l_partkey").alias("p_partkey"), F.year("l_shipdate").alias("y")).agg(S.rounded(F.max("l_extendedprice"), 2).alias("price"))
    out = t.part.select("p_partkey")
    for y in (1996, 1997):
        out = J.attach(out, per.filter(F.col("y") == y).select("p_partkey", F.col("price").alias(f"price_{y}")), ["p_partkey"])
    return out


@query("j21_candidate_keys", "SELECT DISTINCT l_partkey AS id, p_brand AS block, v.name AS name, p_type AS kind FROM lineitem JOIN (SELECT *, unnest([p_name, upper(p_name)]) AS name FROM part) v ON p_partkey = l_partkey")
def candidate_keys(t):
    names = t.part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("block"), F.explode(F.array("p_name", F.upper("p_name"))).alias("name"))
    seen = t.lineitem.select(F.col("l_partkey").alias("id")).distinct()
    kinds = t.part.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("kind"))
    return J.candidate_keys(names.join(seen, "id", "left_semi"), kinds, ["id", "block", "name"], "id")


@query("j22_aligned_scores", "SELECT o_orderkey AS k, o_totalprice > 1000 AS a, o_custkey % 2 = 0 AS b FROM orders")
def aligned(t):
    return J.aligned(t.orders.select(F.col("o_orderkey").alias("k"), (F.col("o_totalprice") > 1000).alias("a")), t.orders.select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 2 == 0).alias("b")), ["k"])


@query("j29_meta_in_order", "SELECT k AS place, s.k * 7 AS store_id, n_name AS name FROM range(40) s(k) LEFT JOIN nation ON n_nationkey = s.k * 7")
def meta(t):
    asked = t.spark.range(40).select(F.col("id").alias("place"), (F.col("id") * 7).alias("store_id"))
    return J.attach(asked, t.nation.select(F.col("n_nationkey").cast("long").alias("store_id"), F.col("n_name").alias("name")), ["store_id"])


@query("j30_flags", "SELECT c_custkey, n_regionkey = 1 AS flag FROM customer JOIN nation ON n_nationkey = c_nationkey")
def flags(t):
    lookup = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), (F.col("n_regionkey") == 1).alias("flag"))
    return J.flagged(t.customer, lookup, "flag", [["c_custkey"], ["c_nationkey"]]).select("c_custkey", "flag")


@query("j31_spatial_assembly", "SELECT s_suppkey, CASE WHEN s_suppkey % 11 = 0 THEN 'missing' WHEN s_suppkey % 7 = 0 THEN 'suspect' WHEN s_suppkey % 5 = 0 THEN 'ambiguous' WHEN s_suppkey % 3 = 0 THEN 'within' ELSE 'outside' END AS reason, CASE WHEN s_suppkey % 11 <> 0 AND s_suppkey % 7 <> 0 AND s_suppkey % 5 <> 0 AND s_suppkey % 3 = 0 THEN s_nationkey END AS area FROM supplier")
def assembly(t):
    s = t.supplier
    base = s.select("s_suppkey", (F.col("s_suppkey") % 11 == 0).alias("coord_missing"), (F.col("s_suppkey") % 7 == 0).alias("coord_suspect"))
    within = s.filter("s_suppkey % 3 = 0").select("s_suppkey", F.col("s_nationkey").alias("area"))
    several = s.filter("s_suppkey % 5 = 0").select("s_suppkey", F.lit(True).alias("ambiguous"))
    return G.assembled(base, within, several, "s_suppkey")


@query("j32_score_assembly", "SELECT p.store_id, p.origin, s.qty FROM panel p LEFT JOIN series s ON s.dong = p.dong AND s.q = origin_no - 1 WHERE origin = '2000Q2'")
def score_assembly(t):
    from tidemark.sources import tables as T

    series = t.series().select("dong", S.quarter_label("q").alias("quarter"), "qty")
    return J.lagged(T.score_panel(t.panel().filter("origin = '2000Q2'"), "event_12m"), series, ["dong"]).select("store_id", "origin", "qty")


@query("j33_membership_rate", "SELECT c_mktsegment, count(*) AS n, round_even(avg((c_custkey IN (SELECT o_custkey FROM orders))::INT), 6) AS rate FROM customer GROUP BY 1")
def membership(t):
    return J.membership_rate(t.customer.select("c_mktsegment", F.col("c_custkey").alias("k")), t.orders.select(F.col("o_custkey").alias("k")), "k", "c_mktsegment").withColumn("rate", S.rounded("rate"))


@query("w07_rank_by_contribution", "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS place FROM lineitem")
def ranked(t):
    from tidemark.operators import peers as E

    return E.ranked(t.lineitem, ["l_orderkey"], "l_extendedprice", "l_linenumber").select("l_orderkey", "l_linenumber", F.col("rank").alias("place"))


@query("w09_margin_of_best", """WITH s AS (SELECT l_orderkey AS k, l_suppkey AS e, max(l_discount) AS s FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY s DESC, e) AS r, lead(s) OVER (PARTITION BY k ORDER BY s DESC, e) AS next FROM s)
    SELECT k, e AS best, round_even(s, 4) AS score, round_even(next, 4) AS runner_up, coalesce(round_even(s - next, 4) < 0.02, false) AS ambiguous FROM r WHERE r = 1""")
def margin(t):
    return J.best_two(t.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_suppkey").alias("e"), F.col("l_discount").alias("s")), "k", "e", "s", 0.02)


@query("w10_nearest_named", """WITH p AS (SELECT a.id AS l, b.id AS r, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM points a JOIN points b ON a.id % 2 = 0 AND b.id % 2 = 1 AND a.id % 5 = b.id % 5 AND abs(a.x - b.x) <= 3 AND abs(a.y - b.y) <= 3), q AS (SELECT * FROM p WHERE d <= 3),
    w AS (SELECT *, row_number() OVER (PARTITION BY l ORDER BY d, r) AS k, lead(d) OVER (PARTITION BY l ORDER BY d, r) AS next FROM q) SELECT l AS id_l, r AS id_r, round_even(d, 4) AS distance, next IS NOT NULL AND next - d < 0.5 AS ambiguous FROM w WHERE k = 1""")
def coordinate_tier(t):
    p = t.points()
    left = p.filter("id % 2 = 0").select(F.col("id").alias("id_l"), F.col("x").alias("x_l"), F.col("y").alias("y_l"))
    right = p.filter("id % 2 = 1").select(F.col("id").alias("id_r"), F.col("x").alias("x_r"), F.col("y").alias("y_r"))
    out = G.nearest_agreeing(G.radius_join(left, right, 3.0), F.col("id_l") % 5 == F.col("id_r") % 5, 0.5)
    return out.withColumn("distance", S.rounded("distance", 4))


@query("w11_seen_before", """WITH s AS (SELECT DISTINCT snapshot FROM snapshots), i AS (SELECT id, min(snapshot) AS first FROM snapshots GROUP BY 1), p AS (SELECT id, snapshot, first < snapshot AS seen_before, lag(snapshot) OVER (PARTITION BY id ORDER BY snapshot) AS last FROM snapshots JOIN i USING (id))
    SELECT snapshot, count(*) FILTER (NOT seen_before) AS brand_new, count(*) FILTER (seen_before AND last < snapshot - 1) AS reappeared FROM p GROUP BY 1""")
def seen(t):
    marked = RS.seen_before(t.snapshots().select("id", "snapshot"), "id", "snapshot")
    return marked.groupBy("snapshot").agg(F.count_if(~F.col("seen_before")).alias("brand_new"), F.count_if(F.col("seen_before") & (F.col("last_seen") < F.col("snapshot") - 1)).alias("reappeared"))


@query("j16_nearest_with_ties", """WITH b AS (SELECT a.id AS l, b.id AS r, round_even(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 2) AS d FROM (SELECT id, round_even(x, 0) AS x, round_even(y, 0) AS y FROM points WHERE id % 7 = 0) b JOIN (SELECT id, round_even(x, 0) AS x, round_even(y, 0) AS y FROM points WHERE id % 7 <> 0) a ON true),
    m AS (SELECT l, min(d) AS d FROM b GROUP BY 1) SELECT m.l AS id, min(r) AS nearest, m.d AS distance, count(*) AS n_nearest FROM m JOIN b ON b.l = m.l AND b.d = m.d GROUP BY m.l, m.d""")
def nearest(t):
    p = t.points().select("id", F.bround("x", 0).alias("x"), F.bround("y", 0).alias("y"))
    out = G.nearest_with_ties(p.filter("id % 7 <> 0"), p.filter("id % 7 = 0"), (2.0, 8.0, 32.0, 128.0, 512.0))
    return out.select("id", "nearest", S.rounded("distance", 2).alias("distance"), "n_nearest")


@query("g01_projected_coordinates")
def projected(t):
    p = t.supplier.select("s_suppkey", F.when(F.col("s_suppkey") % 9 != 0, 190000.0 + F.col("s_suppkey") * 7 % 20000).alias("x"), F.when(F.col("s_suppkey") % 10 != 0, 440000.0 + F.col("s_suppkey") * 11 % 20000).alias("y"))
    return G.standard_coordinates(p, "x", "y").select("s_suppkey", S.rounded("x_std", 2).alias("x_std"), S.rounded("y_std", 2).alias("y_std"), "coord_missing", "coord_suspect")
