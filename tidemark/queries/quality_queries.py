"""Quality tables and contracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import semantics as S
from tidemark.operators import areas as AR
from tidemark.operators import contracts as C
from tidemark.operators import panel as PN
from tidemark.operators import quality as Q
from tidemark.operators import resolve as RS
from tidemark.queries.registry import query


def rounded(df, *columns, digits=6):
    return df.withColumns({c: S.rounded(c, digits) for c in columns})


@query("a04_competition_table", "SELECT store_id, origin, count(*) OVER (PARTITION BY origin, dong, biz_type) AS n_same, '202501' AS source_snapshot FROM panel WHERE dong IS NOT NULL")
def competition(t):
    out = AR.provenance(t.panel().filter("dong IS NOT NULL"), "202501")
    from pyspark.sql import Window as W

    return out.withColumn("n_same", F.count("*").over(W.partitionBy("origin", "dong", "biz_type"))).select("store_id", "origin", "n_same", "source_snapshot")


@query("a08_entity_provenance", "SELECT block, count(DISTINCT id) AS n_ids, min(snapshot) AS first, max(snapshot) AS last, arg_max(id, (snapshot, id)) AS latest FROM snapshots GROUP BY 1")
def provenance(t):
    return RS.provenance(t.snapshots(), "block", "id", "snapshot")


@query("a11_maturity_table", """WITH m AS (SELECT year(l_shipdate) * 12 + month(l_shipdate) - 1 AS month_no, count(*) AS n FROM lineitem GROUP BY 1), b AS (SELECT *, median(n) OVER (ORDER BY month_no ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS b, (SELECT max(month_no) FROM m) - month_no AS ago FROM m)
    SELECT month_no, ago AS months_ago, n, round_even(b, 1) AS baseline, CASE WHEN b > 0 THEN round_even(n / b, 2) END AS share, coalesce(n < 0.75 * b, false) AS flagged, ago = 0 AS partial FROM b WHERE ago BETWEEN 0 AND 5""")
def maturity(t):
    monthly = t.lineitem.groupBy((F.year("l_shipdate") * 12 + F.month("l_shipdate") - 1).alias("month_no")).agg(F.count("*").alias("n"))
    last = t.lineitem.agg(F.max(F.col("l_shipdate").cast("date"))).first()[0]
    return Q.maturity_table(monthly, F.lit(last), 0.75)


@query("a13_missing_rates", "WITH r AS (SELECT origin AS g, gu, dong, close_date FROM panel UNION ALL SELECT 'all', gu, dong, close_date FROM panel), c AS (SELECT g AS grp, count(*) AS n, unnest([{'name': 'gu', 'k': count(*) FILTER (gu IS NULL)}, {'name': 'dong', 'k': count(*) FILTER (dong IS NULL)}, {'name': 'close_date', 'k': count(*) FILTER (close_date IS NULL)}]) AS v FROM r GROUP BY 1) SELECT grp, n, v.name AS name, v.k AS n_missing, round_even(v.k / n, 6) AS share FROM c")
def missing(t):
    return rounded(Q.missing_rates(t.panel(), ["gu", "dong", "close_date"], "origin"), "share")


@query("a14_origin_coverage", "SELECT origin, count(*) AS n, min(origin_end) AS origin_end, false AS differs, count(close_date) AS n_close_date, count(gu) AS n_gu FROM panel GROUP BY 1")
def coverage(t):
    return Q.coverage(t.panel(), "origin", ["close_date", "gu"], "origin_end")


@query("a16_match_rates", "WITH r AS (SELECT unnest([{'dim': 'c_mktsegment', 'grp': c_mktsegment}, {'dim': 'zone', 'grp': CASE WHEN c_nationkey % 4 <> 0 THEN (c_nationkey % 4)::VARCHAR END}]) AS g, c_acctbal > 0 AS m, c_custkey % 10 = 0 AS a FROM customer) SELECT g.dim AS dim, g.grp AS grp, count(*) AS n, count(*) FILTER (m) AS n_matched, round_even(avg(m::INT), 6) AS rate, count(*) FILTER (a) AS n_ambiguous FROM r GROUP BY 1, 2")
def matches(t):
    rows = t.customer.select("c_mktsegment", F.when(F.col("c_nationkey") % 4 != 0, F.col("c_nationkey") % 4).alias("zone"), (F.col("c_acctbal") > 0).alias("m"), (F.col("c_custkey") % 10 == 0).alias("a"))
    return rounded(Q.match_rates(rows, ["c_mktsegment", "zone"], "m", "a"), "rate")


@query("a18_rule_precision", """WITH s AS (SELECT p_type AS s, p_size > 20 AS k, CASE p_partkey % 5 WHEN 0 THEN 'unclear' WHEN 1 THEN 'other' ELSE 'same' END AS l FROM part), g AS (SELECT s, count(*) FILTER (k) AS kept, count(*) FILTER (k AND l = 'same') AS good, count(*) FILTER (k AND l = 'unclear') AS unclear, count(*) FILTER (NOT k AND l = 'same') AS lost, count(*) FILTER (NOT k AND l = 'other') AS removed, length(any_value(s)) * 10 AS size FROM s GROUP BY 1)
    SELECT sum(kept)::BIGINT AS kept, sum(good)::BIGINT AS good, sum(unclear)::BIGINT AS unclear, sum(lost)::BIGINT AS lost, sum(removed)::BIGINT AS removed, round_even(sum(good) / sum(kept), 6) AS low, round_even((sum(good) + sum(unclear)) / sum(kept), 6) AS high,
    round_even(sum(CASE WHEN kept > unclear THEN size * good / (kept - unclear) END) / sum(CASE WHEN kept > unclear THEN size END), 6) AS weighted FROM g""")
def precision(t):
    label = F.when(F.col("p_partkey") % 5 == 0, "unclear").when(F.col("p_partkey") % 5 == 1, "other").otherwise("same")
    sizes = t.part.select("p_type", (F.length("p_type") * 10).alias("size")).distinct()
    return rounded(Q.precision(t.part.withColumn("label", label), F.col("p_size") > 20, "label", "p_type", sizes), "low", "high", "weighted")


@query("a19_period_overlap", "WITH r AS (SELECT a.close_date IS NULL AS open_a, b.close_date IS NULL AS open_b, least(coalesce(a.close_date, DATE '1998-08-01'), DATE '1998-08-01', coalesce(b.close_date, DATE '1998-08-01')) - greatest(a.license_date, b.license_date) >= 90 AS l FROM stores a JOIN stores b ON a.pnu = b.pnu AND a.store_id < b.store_id) SELECT open_a, open_b, l AS long_overlap, count(*) AS n FROM r GROUP BY 1, 2, 3")
def overlap(t):
    s = t.stores().select("pnu", "store_id", "license_date", "close_date")
    b = s.select("pnu", F.col("store_id").alias("id_b"), F.col("license_date").alias("start_b"), F.col("close_date").alias("end_b"))
    return Q.overlap_table(s.join(b, "pnu").filter("store_id < id_b"), ("license_date", "start_b"), ("close_date", "end_b"), F.lit("1998-08-01").cast("date"))


@query("a20_reissue_counts", "WITH l AS (SELECT o_custkey AS old, o_orderkey % 400 AS new, o_orderkey % 6 = 0 AS amb FROM orders) SELECT count(*) AS n_links, count(*) FILTER (amb) AS n_ambiguous, (SELECT count(*) FROM (SELECT old FROM l WHERE NOT amb GROUP BY 1 HAVING count(*) > 1)) AS many_old, (SELECT count(*) FROM (SELECT new FROM l WHERE NOT amb GROUP BY 1 HAVING count(*) > 1)) AS many_new FROM l")
def reissues(t):
    links = t.orders.select(F.col("o_custkey").alias("old"), (F.col("o_orderkey") % 400).alias("new"), (F.col("o_orderkey") % 6 == 0).alias("amb"))
    return Q.reissue_counts(links, "old", "new", "amb")


@query("a29_na_composition", "SELECT CASE WHEN c_nationkey < 5 THEN 'cut' WHEN c_acctbal < 0 THEN 'no_posts' ELSE 'other' END AS cause, count(*) AS n, round_even(count(*) / (SELECT count(*) FROM customer), 6) AS share FROM customer WHERE c_custkey % 3 = 0 GROUP BY 1")
def composition(t):
    rows = t.customer.withColumn("posts", F.when(F.col("c_custkey") % 3 != 0, 1))
    return rounded(Q.na_composition(rows, "posts", {"cut": F.col("c_nationkey") < 5, "no_posts": F.col("c_acctbal") < 0}), "share")


@query("a39_spans", "SELECT l_partkey AS store_id, count(*) AS total, min(l_shipdate::DATE) AS first, max(l_shipdate::DATE) AS last, (SELECT (min(l_shipdate::DATE) - INTERVAL 3 MONTH)::DATE FROM lineitem) AS from_day FROM lineitem GROUP BY 1")
def spans(t):
    d = F.col("l_shipdate").cast("date")
    return AR.mention_spans(t.lineitem.select(F.col("l_partkey").alias("store_id"), d.alias("day")), "store_id", "day", 3)


@query("a40_category_totals", """WITH r AS (SELECT l_orderkey, l_returnflag AS c, l_discount AS v FROM lineitem) SELECT l_orderkey, round_even(coalesce(sum(v) FILTER (c = 'A'), 0), 6) AS "A", round_even(coalesce(sum(v) FILTER (c = 'N'), 0), 6) AS "N", round_even(coalesce(sum(v) FILTER (c = 'R'), 0), 6) AS "R", count(*) FILTER (c = 'R') > 0 AS available FROM r GROUP BY 1""")
def totals(t):
    from tidemark.operators import peers as E

    out = E.category_totals(t.lineitem, ["l_orderkey"], "l_returnflag", ["A", "N", "R"], "l_discount", "R")
    return rounded(out, "A", "N", "R")


@query("a41_price_distribution", "SELECT c_mktsegment, count(*) AS n, count(*) FILTER (c_acctbal = 0) AS n_zero, count(*) FILTER (c_acctbal < 0) AS n_negative, 0::BIGINT AS n_missing, round_even(quantile_disc(c_acctbal, 0.5), 4) AS p50, round_even(quantile_disc(c_acctbal, 0.99), 4) AS p99 FROM customer GROUP BY 1")
def distribution(t):
    return rounded(Q.distribution(t.customer, "c_mktsegment", "c_acctbal"), "p50", "p99", digits=4)


@query("a42_seed_summary", "SELECT p_type, count(*) AS n_seeds, median(p_size)::DOUBLE AS median, min(p_size) AS least, max(p_size) AS largest FROM part GROUP BY 1")
def seeds(t):
    return Q.seeds_summary(t.part, ["p_type"], "p_size").withColumn("median", F.col("median").cast("double"))


@query("a44_snapshot_quality", "WITH r AS (SELECT snapshot, block, id, id % 9 = 0 AS m, id % 3 = 0 AS s FROM snapshots), g AS (SELECT snapshot, block, count(*) AS n, avg((length(id::VARCHAR) = 3)::INT) AS v, count(*) FILTER (m) AS n_missing, count(*) FILTER (s) AS n_suspect FROM r GROUP BY 1, 2) SELECT snapshot, block, n, round_even(v, 6) AS valid_share, n_missing, n_suspect, sum(n_suspect) OVER w > 0.3 * sum(n) OVER w AS alert FROM g WINDOW w AS (PARTITION BY snapshot)")
def snapshots(t):
    rows = t.snapshots().select("snapshot", "block", F.col("id").cast("string").alias("key"), (F.col("id") % 9 == 0).alias("m"), (F.col("id") % 3 == 0).alias("s"))
    return rounded(Q.snapshot_quality(rows, "snapshot", "block", "key", 3, "m", "s", 0.3), "valid_share")


@query("a45_short_name_pool", "WITH p AS (SELECT n_nationkey AS id, n_regionkey AS kind FROM nation WHERE length(n_name) <= 8 AND n_nationkey IN (SELECT s_nationkey FROM supplier)) SELECT kind, count(*) AS n, round_even(count(*) / (SELECT count(*) FROM p), 6) AS share FROM p GROUP BY 1")
def pool(t):
    from tidemark.operators import review as V

    mentions = t.supplier.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("total"))
    return rounded(V.short_name_shares(t.nation, mentions, "n_nationkey", "n_name", "n_regionkey", 8).withColumnRenamed("n_regionkey", "kind"), "share")


@query("a46_model_summary", """WITH b AS (SELECT origin_no, avg((p - y) * (p - y)) AS brier, count(*) AS n, avg(y) AS rate FROM scored GROUP BY 1) SELECT round_even(avg(brier), 6) AS brier_mean, round_even(max(brier) - min(brier), 6) AS brier_range, count(*) AS n_origins, sum(n)::BIGINT AS n, round_even(sum(n * rate) / sum(n), 6) AS rate FROM b""")
def summary(t):
    from tidemark.operators import metrics as M

    by = t.scored().groupBy("origin_no").agg(M.brier("y", "p").alias("brier"), F.count("*").alias("n"), F.avg("y").alias("rate"))
    return rounded(M.summary_row(by, "brier"), "brier_mean", "brier_range", "rate")


@query("a47_weighted_series", "SELECT n_regionkey AS region, round_even(sum(c_acctbal * (c_custkey % 4)) / sum(c_custkey % 4), 4) AS weighted, round_even(avg(c_acctbal), 4) AS plain FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1")
def series(t):
    from tidemark.operators import metrics as M

    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("region"), "c_acctbal", (F.col("c_custkey") % 4).alias("w"))
    return rounded(M.weighted_series(rows, "region", "c_acctbal", "w"), "weighted", "plain", digits=4)


@query("a48_crosstab", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round_even(count(*) / sum(count(*)) OVER (PARTITION BY o_orderstatus), 6) AS share FROM orders GROUP BY 1, 2")
def crosstab(t):
    return rounded(Q.crosstab(t.orders, "o_orderstatus", "o_orderpriority"), "share")


@query("a49_missing_counts", "SELECT unnest(['gu', 'dong', 'close_date']) AS name, unnest([count(*) FILTER (gu IS NULL), count(*) FILTER (dong IS NULL), count(*) FILTER (close_date IS NULL)]) AS n_missing FROM panel WHERE origin = '2000Q2'")
def score_missing(t):
    return Q.missing_rates(t.panel().filter("origin = '2000Q2'"), ["gu", "dong", "close_date"]).select("name", "n_missing")


@query("w04_recomputed_mentions", "SELECT count(*) AS n, 0::BIGINT AS n_differ FROM (SELECT DISTINCT l_partkey, year(l_shipdate) * 12 + month(l_shipdate) - 1 AS m FROM lineitem)")
def recomputed(t):
    return AR.recomputed(t.mentions(), "store_id", "month_no", "mention_count", 3)


@query("u04_set_contract", "SELECT false AS equal, true AS left_in_right, false AS right_in_left")
def sets(t):
    return Q.set_contract(t.orders.filter("o_orderkey % 2 = 0").select("o_orderkey"), t.orders.select("o_orderkey"), ["o_orderkey"])


@query("j27_same_keys", "SELECT (SELECT count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)) AS only_left, (SELECT count(*) FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer)) AS only_right")
def keys(t):
    return Q.same_keys(t.customer.select(F.col("c_custkey").alias("k")), t.orders.select(F.col("o_custkey").alias("k")), "k")


_INTEGRITY = {
    "negative_balance": "c_acctbal < 0", "no_name": "c_name IS NULL", "blank_name": "trim(c_name) = ''", "no_nation": "c_nationkey IS NULL", "nation_domain": "c_nationkey NOT BETWEEN 0 AND 24", "no_segment": "c_mktsegment IS NULL", "segment_domain": "c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'FURNITURE', 'AUTOMOBILE')",
    "no_key": "c_custkey IS NULL", "key_sign": "c_custkey < 0", "not_a_number": "isnan(c_acctbal)", "too_large": "c_acctbal > 9000", "two_places": "round_even(c_acctbal, 2) <> c_acctbal", "name_form": "NOT regexp_matches(c_name, '^Customer#[0-9]+$')", "name_key": "TRY_CAST(regexp_extract(c_name, '([0-9]+)$', 1) AS BIGINT) <> c_custkey", "long_name": "length(c_name) > 40", "odd_nation": "c_nationkey % 2 = 1",
}


@query("r04_sixteen_counters", " UNION ALL ".join(f"SELECT '{k}' AS rule, count(*) FILTER ({v}) AS n_broken FROM customer" for k, v in _INTEGRITY.items()))
def integrity(t):
    return Q.integrity(t.customer, sixteen())


def sixteen():
    return {
        "negative_balance": F.col("c_acctbal") < 0, "no_name": F.col("c_name").isNull(), "blank_name": F.trim("c_name") == "", "no_nation": F.col("c_nationkey").isNull(), "nation_domain": ~F.col("c_nationkey").between(0, 24),
        "no_segment": F.col("c_mktsegment").isNull(), "segment_domain": ~F.col("c_mktsegment").isin("BUILDING", "MACHINERY", "FURNITURE", "AUTOMOBILE"), "no_key": F.col("c_custkey").isNull(), "key_sign": F.col("c_custkey") < 0, "not_a_number": F.isnan("c_acctbal"),
        "too_large": F.col("c_acctbal") > 9000, "two_places": F.bround("c_acctbal", 2) != F.col("c_acctbal"), "name_form": ~F.col("c_name").rlike(r"^Customer#\d+$"), "name_key": F.regexp_extract("c_name", r"(\d+)$", 1).cast("long") != F.col("c_custkey"), "long_name": F.length("c_name") > 40, "odd_nation": F.col("c_nationkey") % 2 == 1,
    }



@query("r05_structural", "SELECT unnest(['label_domain', 'opened_after_end', 'closed_before_end', 'negative_age', 'duplicate_keys', 'unknown_store']) AS rule, 0::BIGINT AS n_broken")
def structural(t):
    return Q.structural(t.panel(), t.stores())


@query("r06_competition_checks", "SELECT unnest(['negative_n', 'keys_differ', 'duplicate_keys']) AS rule, unnest([0, (SELECT count(*) FROM panel WHERE dong IS NULL), 0])::BIGINT AS n_broken")
def competition_checks(t):
    p = t.panel().select("store_id", "origin", "dong")
    return Q.competition_checks(p, p.filter("dong IS NOT NULL").withColumn("n", F.lit(1)), ["store_id", "origin"], ["n"])


@query("r07_score_step", "SELECT count(*) AS n_rows, 0::BIGINT AS late, 0::BIGINT AS other_origin FROM panel WHERE origin = '2000Q2'")
def score_step(t):
    p = t.panel().filter("origin = '2000Q2'")
    return C.counters(p, {"late": F.col("license_date") > F.col("origin_end"), "other_origin": F.col("origin") != "2000Q2"})


@query("r09_report_rules", "WITH r AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'high' ELSE 'low' END AS band, CASE WHEN c_custkey % 7 <> 0 THEN c_custkey % 10 / 10 END AS score FROM customer), b AS (SELECT c_custkey, list_filter([CASE WHEN score IS NULL THEN 'band_without_score' END, CASE WHEN band = 'high' AND score < 0.5 THEN 'high_too_low' END], lambda x: x IS NOT NULL) AS b FROM r) SELECT c_custkey, array_to_string(b, ',') AS broken FROM b WHERE len(b) > 0")
def report_rules(t):
    rows = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, "high").otherwise("low").alias("band"), F.when(F.col("c_custkey") % 7 != 0, F.col("c_custkey") % 10 / 10).alias("score"))
    out = Q.broken_rules(rows, "c_custkey", {"band_without_score": F.col("band").isNotNull() & F.col("score").isNull(), "high_too_low": (F.col("band") == "high") & (F.col("score") < 0.5)})
    return out.select("c_custkey", F.array_join("broken", ",").alias("broken"))


@query("r08_cutoff_contract", "SELECT 'order' AS broken, 3::BIGINT AS n UNION ALL SELECT 'range', 2")
def cutoff_contract(t):
    rows = t.spark.createDataFrame([(1, 0.2, 0.4), (2, 0.5, 0.4), (3, -0.1, 1.2), (4, 0.6, 0.5), (5, 0.7, 0.1), (6, 0.0, 1.0), (7, 0.1, 2.0)], "id long, mid double, high double")
    out = Q.broken_rules(rows, "id", {"order": F.col("mid") >= F.col("high"), "range": ~F.col("mid").between(0, 1) | ~F.col("high").between(0, 1)})
    return out.select(F.explode("broken").alias("broken")).groupBy("broken").agg(F.count("*").alias("n"))


@query("r10_index_consistency", "SELECT count(*) FILTER (c_custkey % 10 = 0) AS only_left, 0::BIGINT AS only_right FROM customer")
def index(t):
    return Q.same_keys(t.customer.select(F.col("c_custkey").alias("k")), t.customer.filter("c_custkey % 10 <> 0").select(F.col("c_custkey").alias("k")), "k")


@query("r12_domains", "SELECT unnest(['no_status', 'status_domain', 'weight', 'priority_domain']) AS rule, unnest([0, (SELECT count(*) FROM orders WHERE o_orderstatus NOT IN ('F', 'O')), (SELECT count(*) FROM orders WHERE o_totalprice <= 1000), 0])::BIGINT AS n_broken")
def domains(t):
    return Q.integrity(t.orders, {"no_status": F.col("o_orderstatus").isNull(), "status_domain": ~F.col("o_orderstatus").isin("F", "O"), "weight": F.col("o_totalprice") <= 1000, "priority_domain": ~F.col("o_orderpriority").rlike("^[1-5]-")})


@query("r13_release_gate", "SELECT count(*) FILTER (c_acctbal < 0) = 0 AND count(*) FILTER (c_custkey % 2 = 5) = 0 AS released, CASE WHEN count(*) FILTER (c_acctbal < 0) > 0 THEN 'negative' ELSE '' END AS blockers FROM customer")
def gate(t):
    return Q.gate(t.customer, {"negative": F.col("c_acctbal") < 0, "never": F.col("c_custkey") % 2 == 5})


@query("r15_factor_mapping", "SELECT p_brand AS predictor, count(*) AS n FROM part GROUP BY 1 HAVING count(*) <> 1 UNION ALL SELECT 'Brand#none', 0")
def mapping(t):
    predictors = t.part.select(F.col("p_brand").alias("predictor")).distinct().unionByName(t.spark.createDataFrame([("Brand#none",)], "predictor string"))
    return Q.once_each(t.part.select(F.col("p_brand").alias("predictor")), predictors)


@query("r16_same_run", "SELECT unnest(['rows', 'seed']) AS name, unnest(['10', '1']) AS a, unnest(['11', NULL]) AS b")
def same_run(t):
    rows = lambda *r: t.spark.createDataFrame(r, "name string, value string")
    return Q.same_run(rows(("rows", "10"), ("seed", "1"), ("sha", "x")), rows(("rows", "11"), ("sha", "x")))


@query("r17_undocumented", "SELECT unnest(['p_size', 'p_retailprice', 'gone']) AS name, unnest(['no_definition', 'no_definition', 'no_column']) AS fault")
def undocumented(t):
    written = t.spark.createDataFrame([(c, "a part's " + c) for c in ("p_partkey", "p_name", "p_brand", "p_type", "gone")] + [("p_size", " ")], "name string, definition string")
    return Q.undocumented(t.part, written)


@query("r18_selection_inputs", "SELECT count(*) AS n_rows, count(*) FILTER (c_custkey % 50 = 0) AS not_frozen, count(*) FILTER (c_custkey % 60 = 0) AS no_review FROM customer")
def selection(t):
    rows = t.customer.select(F.when(F.col("c_custkey") % 50 != 0, F.sha2("c_name", 256)).otherwise("x").alias("sha"), "c_name", F.when(F.col("c_custkey") % 60 != 0, "ok").alias("review"))
    return C.counters(rows, {"not_frozen": F.col("sha") != F.sha2("c_name", 256), "no_review": F.col("review").isNull()})


@query("t01_panel_of_ripe_origins", "SELECT origin, count(*) AS n FROM panel GROUP BY 1 HAVING max(origin_end) <= DATE '1999-12-31'")
def ripe(t):
    return t.panel().filter(F.col("origin_end") <= F.lit("1999-12-31").cast("date")).groupBy("origin").agg(F.count("*").alias("n"))
