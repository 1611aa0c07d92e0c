"""Panel, calendar, time, filter and contract queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import semantics as S
from tidemark.operators import contracts as C
from tidemark.operators import panel as P
from tidemark.operators import quality as Q
from tidemark.operators.prep import coded
from tidemark.queries.registry import FIRST, query

END = "DATE '2000-06-30'"


def day(text: str):
    return F.lit(text).cast("date")


@query("j03_panel_label", "SELECT origin, count(*) AS n_rows, sum(event_12m)::BIGINT AS n_events, round_even(avg(event_12m), 6) AS event_rate, round_even(avg(age_months), 6) AS mean_age FROM panel GROUP BY 1")
def panel_label(t):
    return t.panel().groupBy("origin").agg(F.count("*").alias("n_rows"), F.sum("event_12m").alias("n_events"), S.rounded(F.avg("event_12m")).alias("event_rate"), S.rounded(F.avg("age_months")).alias("mean_age"))


@query("j03_panel_rows", "SELECT store_id, origin, origin_end, event_12m::BIGINT AS event_12m, age_months FROM panel")
def panel_rows(t):
    return t.panel().select("store_id", "origin", "origin_end", "event_12m", "age_months")


@query("a15_population_crosstab", "SELECT gu::BIGINT AS gu, count(*) FILTER (biz_type = '1-URGENT') AS urgent, count(*) FILTER (biz_type = '2-HIGH') AS high, count(*) FILTER (biz_type NOT IN ('1-URGENT', '2-HIGH')) AS other, count(*) FILTER (close_date IS NULL) AS still_open FROM stores GROUP BY 1")
def crosstab(t):
    return P.population(t.stores(), "gu", "biz_type", ("1-URGENT", "2-HIGH"), "close_date").withColumnsRenamed({"n0": "urgent", "n1": "high"})


@query(
    "t01_mature_calendar",
    f"""WITH l AS (SELECT (max(o_orderdate::DATE) - INTERVAL 4 MONTH)::DATE AS lim FROM orders)
    SELECT (n // 4) || 'Q' || (n % 4 + 1) AS origin, n AS origin_no, last_day(make_date(n // 4, n % 4 * 3 + 3, 1)) AS origin_end FROM range({FIRST}, 8100) t(n), l WHERE (last_day(make_date(n // 4, n % 4 * 3 + 3, 1)) + INTERVAL 12 MONTH)::DATE <= lim""",
)
def mature(t):
    last = t.orders.agg(F.max(F.col("o_orderdate").cast("date"))).first()[0]
    return P.mature_calendar(t.spark, FIRST, day(str(last)), 4)


@query(
    "t02_quarter_arithmetic",
    """SELECT DISTINCT year(o_orderdate) * 4 + quarter(o_orderdate) - 1 AS number, year(o_orderdate) || 'Q' || quarter(o_orderdate) AS label, last_day(make_date(year(o_orderdate), quarter(o_orderdate) * 3, 1)) AS q_end,
    make_date(year(o_orderdate), quarter(o_orderdate) * 3 - 2, 1) AS q_start, ((year(o_orderdate) * 4 + quarter(o_orderdate) - 6) // 4) || 'Q' || ((year(o_orderdate) * 4 + quarter(o_orderdate) - 6) % 4 + 1) AS five_before FROM orders""",
)
def quarters(t):
    n = S.quarter_number(F.col("o_orderdate").cast("date"))
    rows = t.orders.select(n.alias("number")).distinct()
    return rows.select("number", S.quarter_label("number").alias("label"), S.quarter_end("number").alias("q_end"), S.quarter_start("number").alias("q_start"), S.quarter_label(S.quarter_of_label(S.quarter_label("number")) - 5).alias("five_before"))


@query("t04_whole_months", f"SELECT store_id, (year({END}) - year(license_date)) * 12 + month({END}) - month(license_date) AS months FROM stores")
def months(t):
    return t.stores().select("store_id", S.whole_months("license_date", day("2000-06-30")).alias("months"))


@query("t05_publication_dates", "SELECT DISTINCT q, CASE WHEN q < 7990 THEN 'confirmed' WHEN q < 7996 THEN 'inferred' ELSE 'unverified' END AS basis, CASE WHEN q < 7996 THEN (last_day(make_date(q // 4, q % 4 * 3 + 3, 1)) + INTERVAL 2 MONTH)::DATE END AS available_at FROM series")
def publication(t):
    q = F.col("q")
    basis = F.when(q < 7990, "confirmed").when(q < 7996, "inferred").otherwise("unverified")
    return t.series().select("q").distinct().select("q", basis.alias("basis"), F.when(q < 7996, F.add_months(S.quarter_end("q"), 2)).alias("available_at"))


@query("t06_local_time", "SELECT event_id, (ts + INTERVAL 9 HOUR)::DATE AS local_day, hour(ts + INTERVAL 9 HOUR) AS local_hour FROM events")
def local_time(t):
    local = F.convert_timezone(F.lit("UTC"), F.lit("Asia/Seoul"), F.col("ts").cast("timestamp_ntz"))
    return t.events.select("event_id", local.cast("date").alias("local_day"), F.hour(local).alias("local_hour"))


@query("t07_month_ends", "SELECT DISTINCT last_day(l_shipdate::DATE) AS month_end FROM lineitem")
def month_ends(t):
    return t.lineitem.select(F.last_day(F.col("l_shipdate").cast("date")).alias("month_end")).distinct()


@query("t08_observed_long_enough", f"WITH m AS (SELECT max(greatest(license_date, coalesce(close_date, license_date))) AS last_day FROM stores) SELECT origin, (SELECT last_day FROM m) >= (origin_end + INTERVAL 4 MONTH)::DATE AS enough FROM cal")
def long_enough(t):
    last = t.stores().agg(F.max(F.greatest("license_date", F.coalesce("close_date", "license_date"))).alias("seen"))
    return t.calendar().crossJoin(F.broadcast(last)).select("origin", (F.col("seen") >= F.add_months("origin_end", 4)).alias("enough"))


@query("t09_durations", f"SELECT store_id, round_even((least(coalesce(close_date, {END}), {END}) - license_date) / 30.44, 6) AS months FROM stores WHERE least(coalesce(close_date, {END}), {END}) >= license_date")
def durations(t):
    end = day("2000-06-30")
    days = F.datediff(F.least(F.coalesce("close_date", end), end), "license_date")
    return t.stores().filter(days >= 0).select("store_id", S.rounded(days / 30.44).alias("months"))


_MONTHS = "m AS (SELECT date_trunc('month', close_date)::DATE AS month, count(*) AS n_closed FROM stores WHERE close_date IS NOT NULL GROUP BY 1), b AS (SELECT month, n_closed, quantile_cont(n_closed, 0.5) OVER (ORDER BY month ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS baseline FROM m)"


@query("w01_trailing_median", f"WITH {_MONTHS} SELECT month, n_closed, round_even(baseline, 6) AS baseline FROM b")
def closures(t):
    return P.monthly_closures(t.stores()).select("month", "n_closed", S.rounded("baseline").alias("baseline"))


@query("w01_unripe_tail", f"WITH {_MONTHS}, g AS (SELECT max(month) FILTER (NOT coalesce(n_closed < 0.75 * baseline, false)) AS last_good FROM b) SELECT count(*) FILTER (month > last_good OR last_good IS NULL) AS lag_months FROM b, g")
def tail(t):
    return P.unripe_tail(P.monthly_closures(t.stores()))


@query(
    "a12_survival",
    f"""WITH r AS (SELECT biz_type, floor((least(coalesce(close_date, {END}), {END}) - license_date) / 30.44)::BIGINT AS duration, coalesce(close_date <= {END}, false) AS ended FROM stores),
    g AS (SELECT biz_type, duration, count(*) FILTER (ended) AS events, count(*) AS leaving FROM r WHERE duration >= 0 GROUP BY 1, 2), a AS (SELECT *, sum(leaving) OVER (PARTITION BY biz_type ORDER BY duration DESC) AS at_risk FROM g)
    SELECT biz_type, duration, events, leaving, at_risk::BIGINT AS at_risk, round_even(CASE WHEN max((events = at_risk)::INT) OVER w = 1 THEN 0 ELSE exp(sum(CASE WHEN events = at_risk THEN 0 ELSE ln(1 - events / at_risk) END) OVER w) END, 6) AS survival
    FROM a WINDOW w AS (PARTITION BY biz_type ORDER BY duration)""",
)
def survival(t):
    return P.survival(t.stores(), day("2000-06-30"), ("biz_type",)).withColumn("survival", S.rounded("survival"))


@query("f04_open_at", "SELECT origin, count(store_id) AS n_open FROM cal LEFT JOIN stores ON license_date <= origin_end AND (close_date IS NULL OR close_date > origin_end) GROUP BY 1")
def open_counts(t):
    return t.panel().groupBy("origin").agg(F.count("*").alias("n_open"))


@query("f05_within_year", f"SELECT count(*) FILTER (license_date > DATE '1999-06-30' AND license_date <= {END}) AS opened, count(*) FILTER (close_date > DATE '1999-06-30' AND close_date <= {END}) AS closed FROM stores")
def within(t):
    return t.stores().agg(F.count_if(P.within_year("license_date", day("2000-06-30"))).alias("opened"), F.count_if(P.within_year("close_date", day("2000-06-30"))).alias("closed"))


@query("f06_known_at", "SELECT biz_type, count(*) AS n, count(close_date) FILTER (close_date <= DATE '1998-12-31') AS n_closed FROM stores WHERE license_date <= DATE '1998-12-31' GROUP BY 1")
def known(t):
    return P.known_at(t.stores(), day("1998-12-31")).groupBy("biz_type").agg(F.count("*").alias("n"), F.count("close_date").alias("n_closed"))


@query("f01_district_filter", "SELECT gu::BIGINT AS gu, count(*) AS n FROM stores WHERE gu IN (1, 2, 3) GROUP BY 1")
def districts(t):
    return coded(t.stores(), "gu", [1, 2, 3]).groupBy("gu").agg(F.count("*").alias("n"))


@query("f02_filter_disagreement", "SELECT count(*) AS n, count(*) FILTER (coalesce(gu = 1, false) <> coalesce(dong < 5, false)) AS n_differ FROM stores")
def disagreement(t):
    return Q.disagreement(t.stores(), F.col("gu") == 1, F.col("dong") < 5)


@query("f07_masked_origins", "SELECT origin, count(*) AS n, count(CASE WHEN origin NOT IN ('1996Q1', '1999Q4') THEN area END) AS n_area FROM panel GROUP BY 1")
def masked(t):
    rows = P.masked_origins(t.panel(), ("1996Q1", "1999Q4"), ("area",))
    return rows.groupBy("origin").agg(F.count("*").alias("n"), F.count("area").alias("n_area"))


@query("f10_all_null_columns", "SELECT count(close_date) = 0 AS close_date, count(area) = 0 AS area, count(CASE WHEN false THEN 1 END) = 0 AS never FROM panel WHERE origin_no <= 7990")
def unvalidated(t):
    return t.panel().filter("origin_no <= 7990").agg((F.count("close_date") == 0).alias("close_date"), (F.count("area") == 0).alias("area"), (F.count(F.lit(None)) == 0).alias("never"))


@query(
    "p13_age_bands",
    """SELECT (CASE WHEN age_months >= 120 THEN 4 WHEN age_months >= 60 THEN 3 WHEN age_months >= 36 THEN 2 WHEN age_months >= 12 THEN 1 ELSE 0 END)::BIGINT AS left_closed,
    (CASE WHEN age_months > 120 THEN 4 WHEN age_months > 60 THEN 3 WHEN age_months > 36 THEN 2 WHEN age_months > 12 THEN 1 ELSE 0 END)::BIGINT AS right_closed, count(*) AS n FROM panel GROUP BY 1, 2""",
)
def age_bands(t):
    return t.panel().groupBy(S.age_band("age_months").alias("left_closed"), S.age_band("age_months", closed="right").alias("right_closed")).agg(F.count("*").alias("n"))


@query("p02_parsed_text", "SELECT doc_id, try_cast(nullif(trim(source), '') AS DOUBLE) AS number, TRY_CAST(CASE WHEN length(source) = 4 THEN regexp_replace(source, 'src', '199') || '-01-15' END AS DATE) AS parsed, nullif(trim(lang), 'en') AS other_lang FROM documents")
def parsed(t):
    made = F.concat(F.regexp_replace("source", "src", "199"), F.lit("-01-15"))
    return t.documents.select("doc_id", S.parsed_number("source").alias("number"), F.when(F.length(made) == 10, F.expr("try_cast(concat(regexp_replace(source, 'src', '199'), '-01-15') as date)")).alias("parsed"), F.nullif(F.trim("lang"), F.lit("en")).alias("other_lang"))


@query("p15_store_status", "SELECT CASE WHEN close_date IS NOT NULL THEN 'closed' WHEN status = 'F' THEN 'unknown' ELSE 'open' END AS store_status, count(*) AS n FROM stores GROUP BY 1")
def store_status(t):
    return t.stores().groupBy(P.store_status("close_date", "status", ("F",)).alias("store_status")).agg(F.count("*").alias("n"))


@query("p16_coarsened", "SELECT store_id, round_even(area / 10, 0) * 10 AS area_10, floor(age_months / 12) * 12 AS age_years_in_months FROM panel WHERE origin = '2000Q2'")
def coarsened(t):
    return P.coarsened(t.panel().filter("origin = '2000Q2'"), "area", "age_months").select("store_id", "area_10", "age_years_in_months")


@query("r01_verify_step", "SELECT true AS same_n_rows, true AS same_n_stores, true AS same_n_duplicates, false AS same_n_events, true AS same_n_origins, false AS same_label_hash")
def step(t):
    p = t.panel().select("store_id", "origin", "event_12m")
    return C.verify_step(p, p.withColumn("event_12m", F.when(F.col("store_id") % 50 == 0, 1).otherwise(F.col("event_12m"))), ["store_id", "origin"], "event_12m")


@query("r02_leakage", "SELECT count(*) AS n_rows, count(*) FILTER (close_date > origin_end) AS late_close_date, count(*) FILTER (license_date > origin_end) AS ahead_license_date FROM panel")
def leak(t):
    return C.leakage(t.panel(), "origin_end", ["close_date"], ["license_date"])


@query("r03_duplicate_keys", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicates(t):
    return C.duplicate_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("r04_integrity_counters", "SELECT biz_type, count(*) AS n_rows, count(*) FILTER (area <= 0) AS bad_area, count(*) FILTER (close_date < license_date) AS closed_first, count(*) FILTER (gu IS NULL) AS no_gu, count(*) FILTER (age_months > 36) AS old FROM panel GROUP BY 1")
def integrity(t):
    return C.counters(t.panel(), {"bad_area": F.col("area") <= 0, "closed_first": F.col("close_date") < F.col("license_date"), "no_gu": F.col("gu").isNull(), "old": F.col("age_months") > 36}, ["biz_type"])


@query("r19_origin_ends", "SELECT origin, min(origin_end) AS first, max(origin_end) AS last FROM (SELECT origin, CASE WHEN store_id % 2 = 0 AND origin = '1997Q1' THEN origin_end - 1 ELSE origin_end END AS origin_end FROM panel) GROUP BY 1 HAVING min(origin_end) <> max(origin_end)")
def ends(t):
    bad = F.when((F.col("store_id") % 2 == 0) & (F.col("origin") == "1997Q1"), F.date_sub("origin_end", 1)).otherwise(F.col("origin_end"))
    return C.origin_ends(t.panel().withColumn("origin_end", bad))


@query("u04_set_difference", "SELECT o_custkey, 'left' AS side FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') UNION ALL SELECT o_custkey, 'right' FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def sets(t):
    o = t.orders
    return C.set_difference(o.filter("o_orderstatus = 'F'"), o.filter("o_orderstatus = 'P'"), ["o_custkey"])


@query("j28_compare_builds", "SELECT count(*) FILTER (store_id % 7 = 0) AS only_left, 0::BIGINT AS only_right, 0::BIGINT AS differ_biz_type, count(*) FILTER (store_id % 7 <> 0 AND store_id % 5 = 0 AND area IS NOT NULL) AS differ_area FROM stores")
def builds(t):
    a = t.stores().select("store_id", "biz_type", "area")
    b = a.filter("store_id % 7 <> 0").withColumn("area", F.when(F.col("store_id") % 5 != 0, F.col("area")))
    return C.compare_tables(a, b, ["store_id"])


@query("a13_missing_by_origin", "SELECT origin, round_even(avg((close_date IS NULL)::INT), 6) AS close_date, round_even(avg((gu IS NULL)::INT), 6) AS gu, count(*) AS n FROM panel GROUP BY 1")
def missing(t):
    return t.panel().groupBy("origin").agg(*[S.rounded(F.avg(F.col(c).isNull().cast("int"))).alias(c) for c in ("close_date", "gu")], F.count("*").alias("n"))


@query("r12_domain_and_weights", "SELECT count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS bad_code, count(*) FILTER (o_totalprice <= 0) AS bad_weight, count(*) FILTER (o_custkey IS NULL) AS missing FROM orders")
def domain(t):
    found = C.counters(t.orders, {"bad_code": ~F.col("o_orderstatus").isin("F", "O"), "bad_weight": F.col("o_totalprice") <= 0, "missing": F.col("o_custkey").isNull()})
    return found.drop("n_rows")


@query("p09_treatment_rules", "SELECT o_orderstatus, (CASE WHEN o_orderpriority = '1-URGENT' THEN 1 WHEN o_orderpriority = '5-LOW' THEN 0 END)::BIGINT AS treated, count(*) AS n FROM orders GROUP BY 1, 2")
def treatment(t):
    return t.orders.groupBy("o_orderstatus", F.when(F.col("o_orderpriority") == "1-URGENT", 1).when(F.col("o_orderpriority") == "5-LOW", 0).alias("treated")).agg(F.count("*").alias("n"))


