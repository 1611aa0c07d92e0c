"""Serving, publishing and review."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import semantics as S
from tidemark.operators import publish as PB
from tidemark.operators import review as V
from tidemark.operators import serving as SV
from tidemark.queries.registry import query
from tidemark.sources import readers as R
from tidemark.sources.writers import csv_with_header, shared_folder, staged, stored


def text(c):
    return F.col(c).cast("string")


_DRAW = "md5(1 || ':' || {0})"


@query("l04_banded_quota", f"WITH b AS (SELECT c_custkey, CASE WHEN c_acctbal < -900 THEN 'low' WHEN c_acctbal < 5000 THEN 'mid' ELSE 'high' END AS band FROM customer), n AS (SELECT least(66, count(*) FILTER (band = 'low')) AS low, count(*) FILTER (band = 'mid') AS all_mid, count(*) FILTER (band = 'high') AS all_high FROM b), q AS (SELECT low, least(66 + 66 - low, all_mid) AS mid, all_high FROM n), r AS (SELECT c_custkey, band, row_number() OVER (PARTITION BY band ORDER BY {_DRAW.format('c_custkey')}, c_custkey) AS k FROM b) SELECT c_custkey, band FROM r, q WHERE k <= CASE band WHEN 'low' THEN low WHEN 'mid' THEN mid ELSE 68 + (66 + 66 - low - mid) END")
def banded(t):
    rows = t.customer.select("c_custkey", F.when(F.col("c_acctbal") < -900, "low").when(F.col("c_acctbal") < 5000, "mid").otherwise("high").alias("band"))
    return V.banded_quota(rows, "band", {"low": 66, "mid": 66, "high": 68}, "c_custkey")


@query("l05_representatives")
def representatives(t):
    out = V.nearest_to_centres(t.part.select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"], "p_partkey", 8)
    return out.agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))


@query("l06_uniform_draw", f"SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY 1 ORDER BY {_DRAW.format('o_orderkey')}, o_orderkey) AS k FROM orders) WHERE k <= 128")
def uniform(t):
    return t.orders.orderBy(V.order(1, "o_orderkey"), "o_orderkey").limit(128).select("o_orderkey")


@query("l07_blind_strata", f"SELECT o_orderstatus, o_orderkey, k AS place, substr({_DRAW.format('o_orderkey')}, 1, 12) AS blind_id FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {_DRAW.format('o_orderkey')}, o_orderkey) AS k FROM orders) WHERE k <= 20")
def strata(t):
    return V.blind_ids(V.per_stratum(t.orders.select("o_orderstatus", "o_orderkey"), ["o_orderstatus"], "o_orderkey", 20), "o_orderkey")


@query("l08_pilot", f"SELECT p_type, p_partkey FROM (SELECT *, count(*) OVER (PARTITION BY p_type) AS n, row_number() OVER (PARTITION BY p_type ORDER BY {_DRAW.format('p_partkey')}, p_partkey) AS k FROM part) WHERE k <= greatest(ceil(n * 0.05), 3)")
def pilot(t):
    return V.pilot(t.part.select("p_type", "p_partkey"), "p_type", "p_partkey", 0.05, 3)


@query("l09_validation_bands", f"WITH b AS (SELECT l_orderkey * 10 + l_linenumber AS k, CASE WHEN l_discount >= 0.08 THEN 2 WHEN l_discount >= 0.05 THEN 1 WHEN l_discount >= 0.02 THEN 0 ELSE -1 END AS band, l_returnflag = 'R' AS m FROM lineitem) SELECT k, band::BIGINT AS band, m FROM (SELECT *, row_number() OVER (PARTITION BY band ORDER BY m DESC, {_DRAW.format('k')}, k) AS r FROM b WHERE band >= 0) WHERE r <= 30")
def validation(t):
    rows = t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), "l_discount", (F.col("l_returnflag") == "R").alias("m"))
    return V.validation(rows, "l_discount", [0.02, 0.05, 0.08], "m", "k", 30).select("k", "band", "m")


def judged(t):
    v = F.when(F.col("l_returnflag") == "R", "same").when(F.col("l_returnflag") == "A", "other").otherwise("unclear")
    return t.lineitem.select(F.col("l_orderkey").alias("store"), (F.col("l_orderkey") % 4).alias("stratum"), F.col("l_linenumber").alias("item"), v.alias("verdict"))


@query("a38_review_verdicts", "WITH s AS (SELECT l_orderkey AS k, count(*) FILTER (l_returnflag = 'R') AS y, count(*) FILTER (l_returnflag = 'A') AS n FROM lineitem GROUP BY 1), v AS (SELECT k % 4 AS stratum, CASE WHEN y > n THEN 'same' WHEN y < n THEN 'other' ELSE 'unclear' END AS v FROM s) SELECT stratum, count(*) AS n, count(*) FILTER (v <> 'unclear') AS n_clear, round_even(count(*) FILTER (v = 'same') / nullif(count(*) FILTER (v <> 'unclear'), 0), 6) AS rate FROM v GROUP BY 1")
def verdicts(t):
    stores = V.verdicts(judged(t), "store", "verdict").withColumn("stratum", F.col("store") % 4)
    return V.verdict_rates(stores, "stratum").withColumn("rate", S.rounded("rate"))


@query("a50_second_round", f"WITH v AS (SELECT l_orderkey AS store, l_linenumber AS item FROM lineitem WHERE l_returnflag = 'R'), h AS (SELECT store, count(*) AS n FROM v GROUP BY 1), f AS (SELECT l_orderkey AS store, l_linenumber AS item FROM lineitem WHERE (l_orderkey, l_linenumber) NOT IN (SELECT (store, item) FROM v)), r AS (SELECT f.*, row_number() OVER (PARTITION BY f.store ORDER BY {_DRAW.format('item')}, item) AS k, coalesce(n, 0) AS n FROM f LEFT JOIN h USING (store)) SELECT store, item::BIGINT AS item FROM r WHERE k <= 3 - n")
def second(t):
    items = judged(t).select("store", "item", "verdict")
    return V.refill(items.filter("verdict = 'same'").select("store", "item"), items.select("store", "item"), ["store"], "item")


@query("a51_review_sheet", f"WITH r AS (SELECT o_custkey AS store, o_orderkey AS item, row_number() OVER (PARTITION BY o_custkey ORDER BY {_DRAW.format('o_orderkey')}, o_orderkey) AS k FROM orders) SELECT c_custkey AS store, item, coalesce(k, 0) AS item_no FROM customer LEFT JOIN r ON r.store = c_custkey AND k <= 2")
def sheet(t):
    return V.sheet(t.customer.select(F.col("c_custkey").alias("store")), t.orders.select(F.col("o_custkey").alias("store"), F.col("o_orderkey").alias("item")), "store", "item", 2)


@query("k02_csv_sink", "SELECT c_custkey::VARCHAR AS key, c_name AS name FROM customer")
def csv_sink(t):
    import uuid

    path = f"{shared_folder(t.spark)}/{uuid.uuid4().hex}/out.csv"
    csv_with_header(t.customer.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name")), path)
    return R.csv_text(t.spark, path, ["key", "name"])


@query("k03_staged_build", "SELECT n_nationkey, n_name FROM nation")
def build(t):
    import uuid

    from tidemark.operators import contracts as C

    path = f"{shared_folder(t.spark)}/{uuid.uuid4().hex}/build"
    first = staged(t.nation.select("n_nationkey", "n_name").filter("n_nationkey < 5"), path)
    assert first.count() == 5
    return staged(t.nation.select("n_nationkey", "n_name"), path, lambda again: C.require_unique(again, ["n_nationkey"]))


def documents(t):
    return t.customer.select("c_custkey", F.to_json(F.struct("c_custkey", "c_name", "c_mktsegment")).alias("document"))


@query("k04_bundle_and_check", "SELECT count(*) AS n, 0::BIGINT AS unlisted, 0::BIGINT AS lost, count(*) FILTER (c_custkey % 100 = 0) AS changed FROM customer")
def bundle(t):
    manifest = PB.manifest(documents(t), "c_custkey")
    path = stored(documents(t).withColumn("document", F.when(F.col("c_custkey") % 100 == 0, F.concat("document", F.lit(" "))).otherwise(F.col("document"))), "bundle", "json")
    return SV.bundle_check(t.spark.read.schema("c_custkey long, document string").json(path), manifest, "c_custkey")


@query("r11_bundle_reread", "SELECT count(*) AS n, count(*) FILTER (c_custkey % 3 = 0) AS unlisted, 0::BIGINT AS lost, 0::BIGINT AS changed FROM customer")
def reread(t):
    manifest = PB.manifest(documents(t).filter("c_custkey % 3 <> 0"), "c_custkey")
    return SV.bundle_check(t.spark.read.parquet(stored(documents(t), "bundle")), manifest, "c_custkey")


def reports(t):
    """Parts as reports with two factors and a policy."""
    k = F.col("p_partkey")
    factor = lambda name, c, shown: F.struct(F.lit(name).alias("factor_id"), c.cast("double").alias("contribution"), shown.alias("display"), F.when(c > 0, "up").otherwise("down").alias("direction"), F.when(k % 3 == 0, "low_exposure").otherwise("other").alias("driver"), (k % 7 == 0).alias("sensitive"), (k * 1.5).alias("probability"))
    factors = F.array(factor("online", (k % 5 - 2) / 100, k % 2 == 0), factor("area", (k % 3) / 100, k % 4 != 0))
    policy = F.array(F.struct(F.concat(F.lit("p"), k.cast("string")).alias("id"), F.array(F.lit("c")).alias("open_conditions"), F.lit("secret").alias("note")))
    return t.part.select("p_partkey", F.col("p_type").alias("kind"), factors.alias("factors"), policy.alias("policies"))


@query("d05_submission_cases", """SELECT p_partkey, '{"label":"L' || p_partkey || '","kind":"' || p_type || '","factors":[{"factor_id":"online","display":' || (p_partkey % 2 = 0)::VARCHAR || CASE WHEN p_partkey % 2 = 0 THEN ',"direction":"' || CASE WHEN p_partkey % 5 - 2 > 0 THEN 'up' ELSE 'down' END || '"' ELSE '' END || '},{"factor_id":"area","display":' || (p_partkey % 4 <> 0)::VARCHAR || CASE WHEN p_partkey % 4 <> 0 THEN ',"direction":"' || CASE WHEN p_partkey % 3 > 0 THEN 'up' ELSE 'down' END || '"' ELSE '' END || '}],"policies":[{"id":"p' || p_partkey || '","unverified":1}]}' AS document, 0::BIGINT AS forbidden FROM part""")
def cases(t):
    out = SV.submission_case(reports(t), "p_partkey", ["kind"], "factors", "policies", ["factor_id", "display", "direction"], ["id"], F.concat(F.lit("L"), text("p_partkey")))
    return out.withColumn("forbidden", SV.forbidden_keys("document", ["probability", "note", "contribution"]))


@query("k05_submission_scan", "SELECT count(*) AS n, count(*) FILTER (p_partkey % 9 = 0) AS n_forbidden FROM part")
def submission(t):
    docs = t.part.select(F.when(F.col("p_partkey") % 9 == 0, F.lit('{"a":{"store_id" : 1}}')).otherwise('{"note":"store_id"}').alias("document"))
    return docs.agg(F.count("*").alias("n"), F.count_if(SV.forbidden_keys("document", ["store_id", "address"]) > 0).alias("n_forbidden"))


@query("d07_displayed_factors", "SELECT p_partkey, ((p_partkey % 2 = 0)::INT + (p_partkey % 4 <> 0)::INT)::BIGINT AS n_displayed, (p_partkey % 2 = 0 OR p_partkey % 4 <> 0) AND p_partkey % 7 = 0 AS any_sensitive FROM part")
def shown(t):
    return reports(t).select("p_partkey", SV.displayed("factors").alias("n_displayed"), SV.any_sensitive("factors").alias("any_sensitive"))


_ONLINE, _AREA = "p_partkey % 2 = 0 AND p_partkey % 5 > 2 AND p_partkey % 3 = 0", "p_partkey % 4 <> 0 AND p_partkey % 3 > 0"


@query("d08_linkable_factors", f"SELECT p_partkey, CASE WHEN {_ONLINE} THEN round_even((p_partkey % 5 - 2) / 100, 4) END AS online, CASE WHEN {_AREA} THEN round_even((p_partkey % 3) / 100, 4) END AS area FROM part")
def linkable(t):
    found = reports(t).select("p_partkey", SV.linkable("factors").alias("m"))
    return found.select("p_partkey", *[S.rounded(F.try_element_at("m", F.lit(k)), 4).alias(k) for k in ("online", "area")])


@query("d09_policy_order", f"""WITH p AS (SELECT unnest(['a', 'b', 'c']) AS policy, unnest([['area'], ['online', 'area'], ['none']]) AS related, unnest([true, false, false]) AS open), m AS (SELECT p_partkey, policy, list_filter(related, lambda f: (f = 'online' AND {_ONLINE}) OR (f = 'area' AND {_AREA})) AS linked, open,
    greatest(CASE WHEN list_contains(related, 'online') AND {_ONLINE} THEN (p_partkey % 5 - 2) / 100 ELSE 0 END, CASE WHEN list_contains(related, 'area') AND {_AREA} THEN (p_partkey % 3) / 100 ELSE 0 END) AS s FROM part, p)
    SELECT p_partkey, policy, CASE WHEN open THEN 'check_required' ELSE 'matched' END AS match_status, len(linked) AS n_linked, row_number() OVER (PARTITION BY p_partkey ORDER BY len(linked) = 0, s DESC, open, policy) - 1 AS sort_order FROM m""")
def policy_order(t):
    p = t.spark.createDataFrame([("a", ["area"], ["x"]), ("b", ["online", "area"], []), ("c", ["none"], [])], "policy string, related array<string>, open_conditions array<string>")
    matched = reports(t).select("p_partkey", SV.linkable("factors").alias("links")).crossJoin(F.broadcast(p))
    out = SV.ordered_policies(matched, "p_partkey", "links", "related", "open_conditions", "policy")
    return out.select("p_partkey", "policy", "match_status", F.size("linked_factors").alias("n_linked"), "sort_order")


@query("n20_sentences", """SELECT s_suppkey, CASE WHEN s_suppkey % 9 = 0 THEN 'No data on footfall (unknown), so it isn''t judged.' WHEN abs((s_suppkey % 7 - 3) / 100) < 0.001 THEN 'footfall hardly changes the predicted risk.' ELSE 'footfall ' || CASE WHEN s_suppkey % 7 > 3 THEN 'raises' ELSE 'lowers' END || ' the predicted risk by about ' || abs(s_suppkey % 7 - 3) || '.0 points.' || CASE WHEN s_suppkey % 2 = 0 THEN ' Mainly: few visits.' ELSE '' END END AS said FROM supplier""")
def sentences(t):
    k = F.col("s_suppkey")
    rows = t.supplier.select("s_suppkey", F.lit("footfall").alias("name"), ((k % 7 - 3) / 100).alias("c"), (k % 9 == 0).alias("gone"), F.lit(None).cast("string").alias("why"), F.when(k % 2 == 0, "few visits").alias("driver"))
    return rows.select("s_suppkey", SV.explanation("name", "c", "gone", "why", "driver").alias("said"))


@query("n23_name_review", "WITH r AS (SELECT s_suppkey, s_name AS a, CASE WHEN s_suppkey % 3 = 0 THEN s_name ELSE s_name || 'x' || (s_suppkey % 5) END AS b FROM supplier) SELECT s_suppkey, abs(length(regexp_replace(lower(a), '[^0-9a-z]', '', 'g')) - length(regexp_replace(lower(b), '[^0-9a-z]', '', 'g'))) AS length_difference, CASE WHEN a = b THEN 'exact' ELSE 'containment' END AS name_structure, regexp_extract(a, '([0-9]+)$', 1) = regexp_extract(b, '([0-9]+)$', 1) AS same_digits FROM r")
def name_review(t):
    other = F.when(F.col("s_suppkey") % 3 == 0, F.col("s_name")).otherwise(F.concat("s_name", F.lit("x"), (F.col("s_suppkey") % 5).cast("string")))
    return SV.name_review(t.supplier.select("s_suppkey", F.col("s_name").alias("a"), other.alias("b")), "a", "b").drop("a", "b")


@query("n05_sequence_ratio")
def ratio(t):
    from tidemark.functions import text as X

    pairs = t.part.select(F.col("p_name").alias("a"), F.concat_ws(" ", F.reverse(F.split("p_name", " "))).alias("b")).distinct()
    return X.sequence_ratio(pairs, "a", "b", "ratio").withColumn("ratio", S.rounded("ratio"))


@query("n10_place_agrees", "SELECT s_suppkey, s_suppkey % 4 = 0 OR s_suppkey % 3 = 0 AS agrees FROM supplier")
def places(t):
    from tidemark.functions import text as X

    place = F.when(F.col("s_suppkey") % 4 != 0, F.lit("서초동"))
    address = F.when(F.col("s_suppkey") % 3 == 0, F.lit("서울 서초구 서초동 12")).otherwise(F.lit("서울 마포구 합정동 3"))
    return t.supplier.select("s_suppkey", X.place_agrees(place, address).alias("agrees"))


@query("n11_place_of", "SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN '서초동' WHEN 1 THEN '합정동' END AS place FROM supplier")
def place_of(t):
    from tidemark.functions import text as X

    k = F.col("s_suppkey") % 3
    rows = t.supplier.select("s_suppkey", F.when(k == 0, "서울 서초구 서초동 12-3").otherwise("").alias("lot"), F.when(k == 1, "서울 마포구 길 3 (합정동)").otherwise("서울").alias("road"))
    return rows.select("s_suppkey", X.place_of("lot", "road").alias("place"))


@query("n27_allowed_findings", "SELECT c_custkey AS id, c_mktsegment AS rule FROM customer WHERE NOT (c_mktsegment = 'BUILDING') AND NOT (c_mktsegment = 'MACHINERY' AND contains(c_name, '7'))")
def findings(t):
    found = t.customer.select(F.col("c_custkey").alias("id"), F.lit("f").alias("file"), F.col("c_mktsegment").alias("rule"), F.col("c_name").alias("text"))
    allow = t.spark.createDataFrame([(None, "BUILDING", None), ("f", "MACHINERY", "7")], "file string, rule string, text string")
    return SV.allowed_findings(found, allow).select("id", "rule")


@query("n28_viewer_texts", "SELECT n_regionkey AS region, list_sort(list(n_name)) AS places, CASE n_regionkey WHEN 0 THEN '0 m' WHEN 1 THEN '7 m' WHEN 2 THEN '1 y 2 m' WHEN 3 THEN '1 y 9 m' ELSE '2 y 4 m' END AS age FROM nation GROUP BY 1")
def viewer(t):
    out = SV.places_by_district(t.nation, "n_regionkey", "n_name").withColumn("months", F.col("n_regionkey") * 7)
    return out.select(F.col("n_regionkey").alias("region"), "places", SV.age_text("months").alias("age"))


@query("k09_registered_figures", "SELECT unnest(['a', 'b', 'c', 'd', 'e', 'f']) AS id, unnest([12.5, 3.0, NULL, NULL, NULL, NULL]) AS value, unnest(['ok', 'ok', 'not_one', 'no_source', 'no_value', 'not_a_number']) AS status")
def figures(t):
    entries = t.spark.createDataFrame([("a", "m", "auc", None, None), ("b", "l", "n", "kind", "cafe"), ("c", "l", "n", "kind", "bar"), ("d", "x", "n", None, None), ("e", "m", "gone", None, None), ("f", "m", "name", None, None)], "id string, source string, path string, key_field string, key string")
    docs = t.spark.createDataFrame([("m", '{"auc": 12.5, "name": "x"}'), ("l", '{"items": [{"kind": "cafe", "n": 3}, {"kind": "bar", "n": 4}, {"kind": "bar", "n": 5}]}')], "source string, body string")
    return SV.registered_figures(entries, docs)


@query("k10_content_hash", "SELECT count(*) AS n_rows, 3::BIGINT AS n_columns, true AS same, true AS other_differs FROM nation")
def content(t):
    a, b = SV.provenance(t.nation, ["n_nationkey"]), SV.provenance(t.nation.orderBy(F.desc("n_name")), ["n_nationkey"])
    c = SV.provenance(t.nation.withColumn("n_name", F.lower("n_name")), ["n_nationkey"])
    both = a.alias("a").crossJoin(b.alias("b")).crossJoin(c.alias("c"))
    return both.select("a.n_rows", "a.n_columns", (F.col("a.rows_hash") == F.col("b.rows_hash")).alias("same"), (F.col("a.rows_hash") != F.col("c.rows_hash")).alias("other_differs"))


@query("k11_selection_outputs", "SELECT 'L' || s_suppkey AS label, s_nationkey AS gu FROM supplier")
def outputs(t):
    rows = t.supplier.select(F.concat(F.lit("L"), text("s_suppkey")).alias("label"), F.col("s_suppkey").alias("store_id"), F.col("s_nationkey").alias("gu"), "s_name")
    return SV.selection_outputs(rows, "store_id", "label", ["s_name"], ["gu"])[1]


@query("k12_marked_blocks", "SELECT n_nationkey, 'new' || chr(10) || CASE WHEN n_nationkey % 2 = 0 THEN '<!-- keep -->' || n_name || '<!-- /keep -->' ELSE '' END AS text FROM nation")
def blocks(t):
    old = F.concat(F.lit("old\n"), F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("<!-- keep -->"), "n_name", F.lit("<!-- /keep -->"))).otherwise("<!-- keep -->"), F.lit("\nrest"))
    return t.nation.select("n_nationkey", F.lit("new").alias("new"), old.alias("old")).select("n_nationkey", SV.regenerated("new", "old", "<!-- keep -->", "<!-- /keep -->").alias("text"))


@query("k13_archive_names", "SELECT 'data/' AS what, 'forbidden' AS fault, count(*) FILTER (n_nationkey % 5 = 0) AS n FROM nation UNION ALL SELECT 'LICENSE', 'missing', 0")
def archive(t):
    names = t.nation.select(F.when(F.col("n_nationkey") % 5 == 0, F.concat(F.lit("data/"), "n_name")).otherwise(F.concat(F.lit("src/"), "n_name")).alias("name")).unionByName(t.spark.createDataFrame([("README",), ("data/",)], "name string"))
    return SV.archive_faults(names, ["data/", "outputs/"], ["README", "LICENSE"])


@query("k08_private_paths", "SELECT unnest(['a/outputs/private/x', 'outputs/private', 'b/outputs/public/x']) AS path, unnest([true, true, false]) AS allowed")
def private(t):
    from tidemark.operators import contracts as C

    def allowed(p):
        try:
            return bool(SV.private_path(p, ["outputs/private"]))
        except C.ContractError:
            return False

    return t.spark.createDataFrame([(p, allowed(p)) for p in ("a/outputs/private/x", "outputs/private", "b/outputs/public/x")], "path string, allowed boolean")


@query("k06_quality_report", "SELECT 8 + count(DISTINCT o_orderstatus) AS n_lines FROM orders")
def report(t):
    table = t.orders.groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    written = SV.quality_report(t.spark, "Orders", {"by status": table})
    path = stored(t.spark.createDataFrame([(written,)], "value string"), "report.md", "text")
    return t.spark.read.text(path).agg((F.count("*") + 1).alias("n_lines"))


@query("r14_reverse_search", "SELECT count(*) AS n_found FROM part WHERE p_partkey % 100 = 0")
def reverse(t):
    docs = t.part.select(F.when(F.col("p_partkey") % 100 == 0, F.concat(F.lit("see "), "p_name", F.lit(" #"), text("p_partkey"))).otherwise("nothing").alias("document"))
    return docs.filter(F.col("document").rlike(r"#\d+")).agg(F.count("*").alias("n_found"))


_SIGNALS = """WITH f AS (SELECT p_partkey, unnest(['trend_6m', 'cnt_12m', 'cnt_3m', 'has_12m', 'has_ever', 'months_since_last']) AS f, unnest([p_partkey % 7 - 3, p_partkey % 4, p_partkey % 3, p_partkey % 2, p_partkey % 2, p_partkey % 6]) AS v0 FROM part), g AS (SELECT p_partkey, f, CASE WHEN p_partkey % 9 <> 0 THEN v0 END AS v, p_partkey % 18 <> 0 AS ever FROM f),
    s AS (SELECT p_partkey, f AS feature, CASE WHEN v IS NULL THEN CASE WHEN f = 'months_since_last' AND ever THEN 'never mentioned' ELSE 'not observable (search limit)' END WHEN f = 'trend_6m' THEN CASE WHEN v = 0 THEN 'as many mentions in both halves of the year' ELSE abs(v) || ' mentions ' || CASE WHEN v < 0 THEN 'fewer' ELSE 'more' END || ' in the last 6 months than in the 6 before' END
    WHEN f = 'cnt_12m' THEN v || ' mentions in the last 12 months' WHEN f = 'cnt_3m' THEN v || ' mentions in the last 3 months' WHEN f = 'has_12m' THEN CASE WHEN v = 0 THEN 'no mention in the last 12 months' ELSE 'mentioned in the last 12 months' END WHEN f = 'has_ever' THEN CASE WHEN v = 0 THEN 'never mentioned' ELSE 'mentioned before' END
    ELSE CASE WHEN v = 0 THEN 'mentioned this month' ELSE v || ' months since the last mention' END END AS said, v FROM g)
    SELECT p_partkey, feature, said, CASE WHEN said = 'not observable (search limit)' THEN 'unobservable' WHEN said = 'as many mentions in both halves of the year' THEN 'neutral' WHEN said = 'never mentioned' OR (feature = 'trend_6m' AND v < 0) OR (feature IN ('cnt_12m', 'cnt_3m', 'has_12m') AND v = 0) OR (feature = 'months_since_last' AND v > 0) THEN 'low_exposure' ELSE 'presence' END AS class FROM s"""


@query("n19_signal_texts", _SIGNALS)
def signals(t):
    from tidemark.functions import text as X

    k = F.col("p_partkey")
    values = {"trend_6m": k % 7 - 3, "cnt_12m": k % 4, "cnt_3m": k % 3, "has_12m": k % 2, "has_ever": k % 2, "months_since_last": k % 6}
    rows = t.part.select("p_partkey", F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.when(k % 9 != 0, v).alias("v")) for n, v in values.items()])).alias("r"), F.when(k % 18 != 0, F.lit(0)).alias("ever"))
    rows = rows.select("p_partkey", "r.feature", "r.v", "ever").withColumn("said", X.signal_text("feature", "v", "ever"))
    return rows.select("p_partkey", "feature", "said", X.signal_class("said").alias("class"))


@query("d03_full_reports", """WITH o AS (SELECT o_custkey AS k, list({'o_orderkey': o_orderkey, 'o_orderstatus': o_orderstatus} ORDER BY o_orderkey, o_orderstatus) AS v FROM orders GROUP BY 1), s AS (SELECT o_custkey AS k, list({'status': st, 'n': n} ORDER BY st, n) AS v FROM (SELECT o_custkey, o_orderstatus AS st, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1), p AS (SELECT o_custkey AS k, list({'priority': pr, 'n': n} ORDER BY pr, n) AS v FROM (SELECT o_custkey, o_orderpriority AS pr, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1),
    y AS (SELECT o_custkey AS k, list({'year': y, 'n': n} ORDER BY y, n) AS v FROM (SELECT o_custkey, year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1), l AS (SELECT o_custkey AS k, list({'supplier': s, 'n': n} ORDER BY s, n) AS v FROM (SELECT o_custkey, l_suppkey AS s, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2) GROUP BY 1), n AS (SELECT c_custkey AS k, list({'nation': n_name, 'region': n_regionkey}) AS v FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1)
    SELECT c_custkey, '{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '"' || ',"orders":' || coalesce(to_json(o.v)::VARCHAR, '[]') || ',"statuses":' || coalesce(to_json(s.v)::VARCHAR, '[]') || ',"priorities":' || coalesce(to_json(p.v)::VARCHAR, '[]') || ',"years":' || coalesce(to_json(y.v)::VARCHAR, '[]') || ',"suppliers":' || coalesce(to_json(l.v)::VARCHAR, '[]') || ',"places":' || coalesce(to_json(n.v)::VARCHAR, '[]') || '}' AS document
    FROM customer LEFT JOIN o ON o.k = c_custkey LEFT JOIN s ON s.k = c_custkey LEFT JOIN p ON p.k = c_custkey LEFT JOIN y ON y.k = c_custkey LEFT JOIN l ON l.k = c_custkey LEFT JOIN n ON n.k = c_custkey""")
def full_reports(t):
    o = t.orders.withColumn("c_custkey", F.col("o_custkey"))
    count = lambda df, c, name: df.groupBy("c_custkey", c.alias(name)).agg(F.count("*").alias("n"))
    bought = t.lineitem.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    parts = {
        "orders": o.select("c_custkey", "o_orderkey", "o_orderstatus"), "statuses": count(o, F.col("o_orderstatus"), "status"), "priorities": count(o, F.col("o_orderpriority"), "priority"), "years": count(o, F.year("o_orderdate"), "year"),
        "suppliers": count(bought, F.col("l_suppkey"), "supplier"), "places": t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("nation"), F.col("n_regionkey").alias("region")),
    }
    return PB.reports(t.customer.select("c_custkey", "c_name"), parts, "c_custkey")
