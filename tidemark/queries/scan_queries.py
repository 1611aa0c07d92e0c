"""Scans: files written from the driver's tables and read again by the operators of sources/."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import semantics as S
from tidemark.queries.registry import query
from tidemark.sources import readers as R
from tidemark.sources import tables as T
from tidemark.sources.writers import stored

_DAY = "strftime(o_orderdate, '%Y-%m-%d')"


def text(c):
    return F.col(c).cast("string")


def written_customers(t, name="customer.csv", **options):
    rows = t.customer.select(text("c_custkey").alias("key"), F.when(F.col("c_custkey") % 7 != 0, F.col("c_name")).alias("name"), F.col("c_mktsegment").alias("kind"), F.concat(F.lit("a, \""), F.col("c_mktsegment"), F.lit("\"\nb")).alias("note"))
    return stored(rows, name, "csv", header=True, escape='"', quoteAll=True, **options)


@query("s01_text_scan", "SELECT c_custkey::VARCHAR AS key, CASE WHEN c_custkey % 7 <> 0 THEN c_name END AS name, c_mktsegment AS kind, 'a, \"' || c_mktsegment || '\"' || chr(10) || 'b' AS note FROM customer")
def text_scan(t):
    rows = R.csv_text(t.spark, written_customers(t, encoding="ISO-8859-1"), ["key", "name", "kind", "note"], "ISO-8859-1")
    return rows.withColumn("name", S.blank_to_null("name"))


@query("a43_replacement_counts", "SELECT 0::BIGINT AS key, count(*) FILTER (c_custkey % 3 = 0) AS name FROM customer")
def replaced(t):
    rows = t.customer.select(text("c_custkey").alias("key"), F.when(F.col("c_custkey") % 3 == 0, "caf\u00e9").otherwise("cafe").alias("name"))
    path = stored(rows, "latin.csv", "csv", header=True, encoding="ISO-8859-1")
    return R.replacement_counts(R.csv_text(t.spark, path, ["key", "name"]))


@query("s02_renamed_scan", "SELECT c_custkey::VARCHAR AS mgmt_no, CASE WHEN c_custkey % 7 <> 0 THEN c_name END AS store_name, 'cafe' AS biz_type FROM customer")
def renamed_scan(t):
    rows = R.csv_text(t.spark, written_customers(t), ["key", "name", "kind", "note"])
    return R.renamed(rows, {"mgmt_no": ["no", "key"], "store_name": ["name"]}, {"biz_type": "cafe"})


@query("s03_common_columns", "SELECT c_custkey AS id, c_name AS name, 'customer' AS source_type FROM customer UNION ALL SELECT s_suppkey, s_name, 'supplier' FROM supplier")
def common(t):
    a = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), "c_mktsegment")
    b = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), "s_acctbal")
    core = T.shared_header([a, b])
    return T.common_columns(a, core, "customer").unionByName(T.common_columns(b, core, "supplier"))


@query("u06_shared_header", "SELECT unnest(['id', 'name']) AS column_name")
def header(t):
    a = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), "c_mktsegment")
    b = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), "s_acctbal")
    return t.spark.createDataFrame([(c,) for c in T.shared_header([a, b])], "column_name string")


SNAPSHOTS = ["199703", "199706", "199709"]


def directory(t):
    """Three snapshots of suppliers: each leaves out others."""
    rows = t.supplier.select(text("s_suppkey").alias("id"), text("s_nationkey").alias("area"), F.concat(F.lit(" "), F.col("s_name")).alias("name"), F.lit("").alias("branch"),
                             F.when(F.col("s_suppkey") % 11 != 0, (126.5 + F.col("s_suppkey") % 100 / 100).cast("string")).alias("lon"), F.when(F.col("s_suppkey") % 13 == 0, "12.5").otherwise((37.0 + F.col("s_nationkey") / 100).cast("string")).alias("lat"))
    return [stored(rows.filter(F.col("id").cast("long") % 5 != k), f"stores_{m}.csv", "csv", header=True) for k, m in enumerate(SNAPSHOTS)]


COLUMNS = ["id", "area", "name", "branch", "lon", "lat"]
_DIRECTORY = "(SELECT s_suppkey, s_nationkey, s_name, snapshot, s_suppkey % 11 = 0 AS missing FROM supplier, (SELECT unnest(['199703', '199706', '199709']) AS snapshot, unnest([0, 1, 2]) AS k) WHERE s_suppkey % 5 <> k)"


@query("s04_snapshot_files", f"SELECT snapshot, (row_number() OVER (ORDER BY snapshot)) AS place, n FROM (SELECT snapshot, count(*) AS n FROM {_DIRECTORY} GROUP BY 1)")
def snapshot_files(t):
    from pyspark.sql import Window as W

    per = R.snapshots(t.spark, directory(t), COLUMNS, "id").groupBy("snapshot").agg(F.count("*").alias("n"))
    return per.withColumn("place", F.row_number().over(W.orderBy("snapshot")))


@query("s05_directory_scan", f"SELECT s_suppkey::VARCHAR AS id, snapshot, s_nationkey::VARCHAR AS district, lower(regexp_replace(s_name, '[^0-9a-zA-Z가-힣]', '', 'g')) AS name_key, missing AS coord_missing, NOT missing AND s_suppkey % 13 = 0 AS coord_suspect, NOT missing AND s_suppkey % 13 <> 0 AS projected FROM {_DIRECTORY} WHERE s_nationkey < 12")
def directory_scan(t):
    names = {"key": ["id"], "district": ["area", "gu"], "name": ["name"], "branch": ["branch"], "lon": ["lon"], "lat": ["lat"]}
    out = T.directory_scan(t.spark, directory(t), COLUMNS, names, "key", [str(i) for i in range(12)])
    return out.select(F.col("key").alias("id"), "snapshot", "district", "name_key", "coord_missing", "coord_suspect", (F.col("x").isNotNull() & F.col("y").isNotNull()).alias("projected"))


@query("s06_snapshot_union", f"SELECT s_suppkey::VARCHAR AS id, snapshot FROM {_DIRECTORY}")
def snapshot_union(t):
    return R.snapshots(t.spark, directory(t), COLUMNS, "id").select("id", "snapshot")


def written_series(t):
    q = F.col("q")
    rows = t.series().select(text("dong").alias("dong"), (F.floor(q / 4) * 10 + F.pmod(q, F.lit(4)) + 1).cast("string").alias("code"), text("qty").alias("qty"), F.when(F.col("qty") % 2 == 0, "LL").otherwise("HH").alias("change"), F.floor(F.col("lines") / 40).cast("string").alias("level"))
    return stored(rows, "series.csv", "csv", header=True)


@query(
    "s07_area_series",
    """WITH r AS (SELECT dong::VARCHAR AS dong, (q // 4) || 'Q' || (q % 4 + 1) AS quarter, qty::DOUBLE AS qty, floor(lines / 40)::DOUBLE AS level, CASE WHEN qty % 2 = 0 THEN 'LL' ELSE 'HH' END AS change FROM series),
    c AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR level IS DISTINCT FROM lag(level) OVER w THEN quarter END AS c FROM r WINDOW w AS (PARTITION BY dong ORDER BY quarter))
    SELECT dong, quarter, qty, level, change, last_value(c IGNORE NULLS) OVER (PARTITION BY dong ORDER BY quarter) AS value_asof FROM c""",
)
def series_scan(t):
    raw = R.csv_text(t.spark, written_series(t), ["dong", "code", "qty", "change", "level"])
    return T.area_series(raw, "dong", "code", ["qty", "level"], ["change"], "level")


def yearly(t):
    """Parts as codes, written with other names in each year."""
    rows = t.part.select(text("p_partkey").alias("part"), F.col("p_type").alias("kind_code"), text("p_size").alias("size"))
    a = stored(rows.filter("part % 2 = 0"), "year_2021.csv", "csv", header=True)
    b = stored(rows.filter("part % 2 = 1").withColumnsRenamed({"kind_code": "svc_cd", "size": "sz"}), "year_2022.csv", "csv", header=True)
    return [R.csv_text(t.spark, a, ["part", "kind_code", "size"]), R.csv_text(t.spark, b, ["part", "svc_cd", "sz"])]


NAMES = {"part": ["part"], "code": ["kind_code", "svc_cd"], "size": ["size", "sz"]}
CODES = {"ECONOMY": "cafe", "PROMO": "cafe", "STANDARD": "shop"}


@query("s08_yearly_files", "SELECT p_partkey::VARCHAR AS part, p_type AS code, p_size::VARCHAR AS size, CASE WHEN p_type = 'STANDARD' THEN 'shop' ELSE 'cafe' END AS kind, (SELECT count(DISTINCT p_type) FROM part) AS n_codes FROM part WHERE p_type IN ('ECONOMY', 'PROMO', 'STANDARD')")
def yearly_files(t):
    rows, domains = T.yearly_files(yearly(t), NAMES, ["code"], CODES)
    return rows.crossJoin(F.broadcast(domains["code"].agg(F.count("*").alias("n_codes"))))


@query("s09_alias_columns", "SELECT p_partkey::VARCHAR AS part, p_type AS code, p_size::VARCHAR AS size FROM part WHERE p_partkey % 2 = 1")
def alias_columns(t):
    return R.renamed(yearly(t)[1], NAMES)


@query("s10_store_counts", "SELECT p_partkey::VARCHAR AS part, (p_size + p_partkey % 4 + (p_partkey % 50 = 0)::INT)::BIGINT AS total, p_size::BIGINT AS general, (p_partkey % 4)::BIGINT AS franchise, p_partkey % 50 = 0 AS broken FROM part")
def counts(t):
    k = F.col("p_partkey")
    rows = t.part.select(text("p_partkey").alias("part"), (F.col("p_size") + k % 4 + (k % 50 == 0).cast("int")).cast("string").alias("total"), text("p_size").alias("general"), (k % 4).cast("string").alias("franchise"))
    return T.store_counts(R.csv_text(t.spark, stored(rows, "counts.csv", "csv", header=True), rows.columns), "total", ["general", "franchise"])


@query("s11_sales", "SELECT o_orderkey::VARCHAR AS o_orderkey, CASE WHEN o_orderkey % 9 <> 0 THEN round_even(o_totalprice, 2) END AS sales FROM orders")
def sales(t):
    rows = t.orders.select(text("o_orderkey").alias("o_orderkey"), F.when(F.col("o_orderkey") % 9 != 0, F.bround("o_totalprice", 2).cast("decimal(18,2)").cast("string")).otherwise(" ").alias("sales"))
    raw = R.csv_text(t.spark, stored(rows, "sales.csv", "csv", header=True), rows.columns)
    return raw.select("o_orderkey", T.strict("sales", "double").alias("sales"))


@query("s14_monthly_mentions", "SELECT l_partkey AS store_id, strftime(l_shipdate, '%Y-%m') AS month, count(*) AS mention_count FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1, 2")
def mentions(t):
    month = F.concat(F.date_format("l_shipdate", "yyyy-MM"), F.lit("-01"))
    rows = t.lineitem.groupBy(F.col("l_partkey").alias("store_id"), month.alias("month"), F.col("l_returnflag").alias("platform")).agg(F.count("*").cast("string").alias("mention_count"))
    return T.monthly_mentions(t.spark.read.parquet(stored(rows, "mentions")), "A")


@query("s15_collection_qa", f"SELECT o_orderkey::VARCHAR AS store_id, o_orderstatus <> 'F' AS ok, o_orderkey % 5 = 0 AS truncated, CASE WHEN o_orderkey % 5 = 0 AND o_orderkey % 10 <> 0 THEN strftime(o_orderdate, '%Y-%m') END AS cut_month, strftime(o_orderdate::DATE + INTERVAL 32 HOUR, '%Y-%m-%d %H:%M:%S') AS collected_at FROM orders")
def qa(t):
    k, d = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    rows = t.orders.select(text("o_orderkey").alias("store_id"), F.when(F.col("o_orderstatus") == "F", "timeout").otherwise(" ").alias("error"), F.when(k % 5 == 0, "True").otherwise("False").alias("truncated"),
                           F.when(k % 10 == 0, "soon").otherwise(F.date_format(d, "yyyyMMdd")).alias("oldest"), F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit("T23:00:00Z")).alias("collected"))
    out = T.collection_qa(R.csv_text(t.spark, stored(rows, "qa.csv", "csv", header=True), rows.columns))
    return out.withColumn("collected_at", F.date_format("collected_at", "yyyy-MM-dd HH:mm:ss"))


@query("s16_panel_scan", "SELECT store_id, origin, area FROM panel")
def panel_scan(t):
    return R.panel_columns(t.spark, stored(t.panel().select("store_id", "origin", "area", "gu", "biz_type"), "panel"), ["store_id", "origin", "area"], ["store_id", "origin"])


@query("s18_score_panel", "SELECT store_id, origin, gu FROM panel WHERE origin = '2000Q2'")
def scored_panel(t):
    path = stored(t.panel().filter("origin = '2000Q2'").select("store_id", "origin", "gu", "event_12m"), "score-panel")
    return T.score_panel(t.spark.read.parquet(path), "event_12m")


@query("s27_selected_columns", "SELECT c_custkey::VARCHAR AS key, c_mktsegment AS kind FROM customer")
def selected(t):
    return T.selected(t.spark, written_customers(t), ["key", "kind"], "csv", header=True, multiLine=True, escape='"')


def lines(t):
    good = t.customer.select(F.to_json(F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))).alias("value"))
    return good.unionByName(t.nation.select(F.concat(F.lit('{"id": '), F.col("n_name")).alias("value"))).unionByName(t.region.select(F.lit(" ").alias("value")))


@query("s19_json_lines", "SELECT c_custkey AS id, c_name AS name, (SELECT count(*) FROM nation) AS n_bad FROM customer")
def json_lines(t):
    good, bad = R.json_lines(t.spark, stored(lines(t), "records.jsonl", "text"), "id long, name string")
    return good.crossJoin(F.broadcast(bad.agg(F.count("*").alias("n_bad"))))


@query("s20_collected_items", "SELECT l_suppkey AS store_id, 'http://x/' || (l_partkey % 50) AS link, min(l_linestatus) AS title FROM lineitem WHERE l_linenumber <> 2 AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 10) GROUP BY 1, 2")
def items(t):
    link = F.concat(F.lit("http://x/"), (F.col("l_partkey") % 50).cast("string"))
    rows = t.lineitem.select(F.col("l_suppkey").alias("store_id"), link.alias("link"), F.col("l_linestatus").alias("title"), (F.col("l_linenumber") != 2).alias("matched"))
    path = stored(rows, "items.jsonl.gz", "json", compression="gzip")
    read = t.spark.read.schema("store_id long, link string, title string, matched boolean").json(path)
    return T.collected_items(read, t.supplier.filter("s_nationkey < 10").select(F.col("s_suppkey").alias("store_id"))).select("store_id", "link", "title")


def policy_rows(t):
    return t.part.select(F.concat(F.lit("p"), text("p_partkey")).alias("policy_id"), F.col("p_size").alias("min_age"), (F.col("p_size") + 10).alias("max_age"), F.col("p_type").alias("kind"))


@query("s21_policies", "SELECT 'p' || p_partkey AS policy_id, p_size::BIGINT AS min_age, (p_size + 10)::BIGINT AS max_age, p_type AS kind FROM part")
def policies(t):
    path = stored(policy_rows(t).select(F.struct("*").alias("p")).groupBy(F.crc32("p.policy_id") % 16).agg(F.collect_list("p").alias("policies")).select("policies"), "policies.json", "json", maxRecordsPerFile=1)
    return T.policies(R.json_array(t.spark, path, "policy_id:string,min_age:long,max_age:long,kind:string", "policies"))


@query("s22_application_faults", "SELECT count(*) AS n_rows, count(*) FILTER (p_partkey % 40 = 0) AS unknown_policy, count(*) FILTER (p_partkey % 17 = 0) AS bad_status, count(*) FILTER (p_partkey % 19 = 0) AS bad_date, count(*) > 1 AS several_dates FROM part")
def applications(t):
    k = F.col("p_partkey")
    rows = t.part.select(F.when(k % 40 == 0, "gone").otherwise(F.concat(F.lit("p"), k.cast("string"))).alias("policy_id"), F.when(k % 17 == 0, "maybe").otherwise("open").alias("status"), F.when(k % 19 == 0, "soon").when(k % 2 == 0, "2025-01-02").otherwise("2025-01-03").alias("checked_at"))
    raw = R.csv_text(t.spark, stored(rows, "apply.csv", "csv", header=True), rows.columns)
    return T.application_faults(raw, policy_rows(t), ["open", "closed"])


@query("s23_known_presence", "SELECT o_custkey AS store_id, count(*) AS n, (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 15)) AS ignored FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 15) GROUP BY 1")
def presence(t):
    rows, ignored = T.known_presence(t.orders.select(F.col("o_custkey").alias("store_id"), "o_orderkey"), t.customer.filter("c_nationkey < 15").select(F.col("c_custkey").alias("store_id")))
    return rows.groupBy("store_id").agg(F.count("*").alias("n")).crossJoin(F.broadcast(ignored))


@query("s24_polygons", "SELECT p_partkey AS code, p_partkey % 5 = 1 AS closed_here, CASE p_partkey % 5 WHEN 2 THEN 'empty' WHEN 3 THEN 'few_points' WHEN 4 THEN 'flat' END AS fault, CASE WHEN p_partkey % 5 < 2 THEN round_even(p_size * 3.0, 6) END AS area FROM part")
def rings(t):
    k, s = F.col("p_partkey"), F.col("p_size").cast("double")
    at = lambda x, y: F.struct(F.lit(x).cast("double").alias("x") if not hasattr(x, "cast") else x.alias("x"), F.lit(y).cast("double").alias("y") if not hasattr(y, "cast") else y.alias("y"))
    square = [at(0, 0), at(s, 0), at(s, 3), at(0, 3)]
    ring = F.when(k % 5 == 0, F.array(*square, square[0])).when(k % 5 == 1, F.array(*square)).when(k % 5 == 3, F.array(square[0], square[1], square[0])).when(k % 5 == 4, F.array(square[0], square[1], at(s / 2, 0), square[0]))
    rows = t.part.select(k.alias("code"), F.coalesce(ring, F.array().cast("array<struct<x:double,y:double>>")).alias("ring"))
    out = T.polygons(t.spark.read.parquet(stored(rows, "areas")), "code")
    return out.select("code", "closed_here", "fault", S.rounded("area").alias("area"))


@query("s25_run_versions", "SELECT o_custkey::VARCHAR AS run_id, min(md5(o_orderstatus)) AS git_sha, count(DISTINCT o_orderstatus) > 1 AS conflict FROM orders GROUP BY 1")
def versions(t):
    rows = t.orders.select(text("o_custkey").alias("run_id"), F.md5("o_orderstatus").alias("git_sha")).unionByName(t.nation.select(F.lit("x").alias("run_id"), F.lit(None).cast("string").alias("git_sha")))
    return T.run_versions(R.json_lines(t.spark, stored(rows, "runs.jsonl", "json"), "run_id string, git_sha string")[0])


@query("s28_stores_with_bands", "SELECT c_custkey AS store_id, c_mktsegment AS kind, CASE WHEN c_acctbal > 5000 THEN 'high' ELSE 'low' END AS band FROM customer WHERE c_acctbal > 0")
def bands(t):
    stores = t.spark.read.parquet(stored(t.customer.select(F.col("c_custkey").alias("store_id"), F.col("c_mktsegment").alias("kind")), "stores"))
    risk = t.spark.read.parquet(stored(t.customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("store_id"), F.when(F.col("c_acctbal") > 5000, "high").otherwise("low").alias("band")), "risk"))
    return stores.join(risk, "store_id")


@query("s29_presence_union", "SELECT o_orderkey AS store_id, o_orderstatus = 'F' AS found, o_orderdate::DATE AS asof, (o_orderdate::DATE + INTERVAL 1 DAY)::DATE AS available FROM orders")
def presence_union(t):
    rows = t.orders.select(F.col("o_orderkey").alias("store_id"), (F.col("o_orderstatus") == "F").alias("found"), F.col("o_orderdate").cast("timestamp").alias("at"))
    return T.presence_union(rows.filter("store_id % 2 = 0"), rows.filter("store_id % 2 = 1"), "at").drop("at")


@query("s30_search_candidates", "WITH h AS (SELECT l_orderkey AS store_id, l_linenumber AS r, l_partkey AS c FROM lineitem WHERE l_linenumber % 2 = 1 AND l_returnflag IN ('A', 'R')) SELECT store_id, arg_min(c, (r, c)) AS candidate_id, count(*) > 1 AS ambiguous FROM h GROUP BY 1")
def candidates(t):
    rows = t.lineitem.select(F.col("l_orderkey").alias("store_id"), F.col("l_linenumber").alias("rank"), F.col("l_partkey").alias("candidate_id"), F.lit("Blue Bean").alias("name"), F.lit("Seocho").alias("dong"), F.lit(None).cast("string").alias("gu"),
                             F.when(F.col("l_linenumber") % 2 == 1, "BLUE-bean").otherwise("Red").alias("candidate_name"), F.when(F.col("l_returnflag").isin("A", "R"), "Seocho 12").otherwise("Mapo 3").alias("candidate_address"))
    return T.search_candidates(rows)


@query("s31_in_address", "SELECT s_suppkey FROM supplier WHERE contains(s_name, '01')")
def addresses(t):
    return T.in_address(t.supplier, "s_name", "01").select("s_suppkey")


@query("s32_combined_scan", "SELECT 'K' || (s_suppkey % 3) || '_' || s_suppkey AS store_id, 'K' || (s_suppkey % 3) AS biz_type, make_date(1990 + s_suppkey % 9, 5, 1) AS license_date FROM supplier WHERE s_nationkey < 12")
def combined(t):
    k = F.col("s_suppkey")
    rows = t.supplier.select(F.concat(F.lit("K"), (k % 3).cast("string")).alias("biz_type"), F.concat(F.lit(" "), k.cast("string"), F.lit(" ")).alias("mgmt_no"), text("s_nationkey").alias("district"), F.concat((1990 + k % 9).cast("string"), F.lit("-05-01")).alias("license_date"))
    raw = R.csv_text(t.spark, stored(rows, "licences.csv", "csv", header=True), rows.columns)
    kept = raw.filter(F.trim("district").isin([str(i) for i in range(12)]))
    return R.store_ids(kept, "biz_type", "mgmt_no", {f"K{i}": f"K{i}" for i in range(3)}).select("store_id", "biz_type", S.parsed_date("license_date").alias("license_date"))


_PART = "(('0x' || substr(md5('1:{0}:' || id), 1, 8))::BIGINT % {1})"


@query("s33_synthetic_stores", f"SELECT 'syn_' || lpad(id::VARCHAR, 6, '0') AS store_id, ['cafe', 'bar', 'shop'][{_PART.format('kind', 3)} + 1] AS biz_type, (DATE '2010-01-01' + {_PART.format('day', 4000)}::INT)::DATE AS license_date, {_PART.format('area', 20000)} / 100 AS area, {_PART.format('closed', 4)} = 0 AS closed FROM range(5000) r(id)")
def synthetic(t):
    return T.synthetic_stores(t.spark, 5000)


@query("s34_labelled_sample", "SELECT o_orderkey AS row_id, o_custkey AS store_id, round_even(o_totalprice, 2) AS score, o_orderstatus AS label FROM orders")
def labelled(t):
    sample = t.orders.select(F.col("o_orderkey").alias("row_id"), F.col("o_custkey").alias("store_id"), S.rounded("o_totalprice", 2).alias("score"))
    return T.labelled_sample(sample, t.orders.select(F.col("o_orderkey").alias("row_id"), F.col("o_custkey").alias("store_id"), F.col("o_orderstatus").alias("label")))


@query("s13_file_row_numbers", "SELECT o_orderkey::VARCHAR AS k, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_id FROM orders")
def row_numbers(t):
    rows = t.orders.repartitionByRange(5, "o_orderkey").sortWithinPartitions("o_orderkey").select(text("o_orderkey").alias("k"))
    return R.file_rows(t.spark.read.schema("k string").csv(stored(rows, "survey.csv", "csv", header=True), header=True))


@query("s17_master_scan", "SELECT store_id, origin, event_12m::BIGINT AS event_12m, area FROM panel")
def master_scan(t):
    path = stored(t.panel().select("store_id", "origin", "event_12m", "area", "gu"), "master")
    return R.panel_columns(t.spark, path, ["store_id", "origin", "event_12m", "area"], ["store_id", "origin"]).sort("store_id", "origin")
