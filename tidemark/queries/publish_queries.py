"""Publishing, selection, document and text queries, the master chain, and stored copies read again."""

from __future__ import annotations


from pyspark.sql import functions as F

from tidemark import semantics as S
from tidemark.functions import text as X
from tidemark.operators import contracts as C
from tidemark.operators import joins as J
from tidemark.operators import publish as P
from tidemark.plans import master as MA
from tidemark.queries.registry import query

BANDS = ["low", "mid", "high"]


def banded(t):
    a = F.col("area")
    return t.panel().filter("origin = '2000Q2'").select("store_id", "gu", "dong", "biz_type", F.when(a >= 350000, "high").when(a >= 200000, "mid").otherwise("low").alias("band"), "event_12m", "area", "age_months")


_CELLS = """b AS (SELECT gu, dong, biz_type, CASE WHEN area >= 350000 THEN 'high' WHEN area >= 200000 THEN 'mid' ELSE 'low' END AS band FROM panel WHERE origin = '2000Q2' AND dong IS NOT NULL),
    ce AS (SELECT gu, dong, biz_type, count(*) FILTER (band = 'low') AS low, count(*) FILTER (band = 'mid') AS mid, count(*) FILTER (band = 'high') AS high, count(*) AS n FROM b GROUP BY 1, 2, 3),
    h AS (SELECT *, sum(n) OVER w AS tot, sum((n < {k})::INT) OVER w AS hid, row_number() OVER (PARTITION BY gu, dong ORDER BY (n < {k})::INT, n, biz_type) AS rk FROM ce WINDOW w AS (PARTITION BY gu, dong)),
    su AS (SELECT gu, dong, biz_type, low, mid, high, n, CASE WHEN n < {k} THEN 'small_cell' WHEN tot < {k} THEN 'complementary' WHEN hid = 1 AND rk = 1 THEN 'complementary' END AS reason FROM h)"""
_K = 4


def cells(t):
    return P.cells(banded(t), ["gu", "dong"], "biz_type", "band", BANDS)


@query("a21_cells", f"WITH {_CELLS.format(k=_K)} SELECT gu::BIGINT AS gu, dong::BIGINT AS dong, biz_type, low, mid, high, n FROM ce")
def cell_counts(t):
    return cells(t)


@query("a22_suppression", f"WITH {_CELLS.format(k=_K)} SELECT gu::BIGINT AS gu, dong::BIGINT AS dong, biz_type, low, mid, high, n, reason, reason IS NOT NULL AS suppressed FROM su")
def suppression(t):
    return P.suppressed(cells(t), ["gu", "dong"], "biz_type", _K)


@query("a22_recoverable", f"WITH {_CELLS.format(k=_K)} SELECT count(*) AS n FROM (SELECT gu, dong, count(*) FILTER (reason IS NOT NULL) AS hid, sum(n) AS n FROM su GROUP BY 1, 2) WHERE hid = 1 AND n >= {_K} AND false")
def recoverable(t):
    c = cells(t)
    return P.recoverable(P.suppressed(c, ["gu", "dong"], "biz_type", _K), P.area_totals(c, ["gu", "dong"], _K, BANDS), ["gu", "dong"]).agg(F.count("*").alias("n"))


@query("a23_area_totals", f"WITH {_CELLS.format(k=_K)} SELECT gu::BIGINT AS gu, dong::BIGINT AS dong, sum(n)::BIGINT AS n, sum(low)::BIGINT AS low, sum(mid)::BIGINT AS mid, sum(high)::BIGINT AS high, sum(n) < {_K} AS suppressed FROM ce GROUP BY 1, 2")
def totals(t):
    return P.area_totals(cells(t), ["gu", "dong"], _K, BANDS)


@query("a23_ranked_kinds", f"WITH {_CELLS.format(k=_K)} SELECT gu::BIGINT AS gu, dong::BIGINT AS dong, string_agg(biz_type, ',' ORDER BY high / n DESC, (mid + high) / n DESC, n DESC, biz_type) AS kinds FROM su WHERE reason IS NULL AND high > 0 GROUP BY 1, 2")
def ranked(t):
    shown = P.suppressed(cells(t), ["gu", "dong"], "biz_type", _K).filter("NOT suppressed")
    return P.ranked_kinds(shown, ["gu", "dong"], "biz_type").select("gu", "dong", F.array_join("kinds", ",").alias("kinds"))


def _impact(k):
    return f"SELECT {k}::BIGINT AS least, count(*) AS n_cells, count(*) FILTER (reason IS NOT NULL) AS n_hidden, coalesce(sum(n) FILTER (reason IS NOT NULL), 0)::BIGINT AS stores_hidden FROM (WITH {_CELLS.format(k=k)} SELECT * FROM su)"


@query("a24_threshold_impact", " UNION ALL ".join(_impact(k) for k in (3, 5, 8)))
def impact(t):
    return P.threshold_impact(cells(t), ["gu", "dong"], "biz_type", [3, 5, 8])


@query(
    "a25_composition",
    """WITH d AS (SELECT unnest([{'dimension': 'biz_type', 'category': biz_type}, {'dimension': 'dong', 'category': coalesce(dong::VARCHAR, 'missing')}]) AS v FROM panel WHERE origin = '2000Q2'), g AS (SELECT v.dimension AS dimension, v.category AS category, count(*) AS n FROM d GROUP BY 1, 2)
    SELECT dimension, category, CASE WHEN n BETWEEN 1 AND 4 THEN '<5' ELSE n::VARCHAR END AS n_shown, round_even(CASE WHEN n >= 5 AND category <> 'missing' THEN n / sum(n) FILTER (category <> 'missing') OVER (PARTITION BY dimension) END, 6) AS share FROM g""",
)
def composition(t):
    return P.masked_counts(banded(t), ["biz_type", "dong"]).withColumn("share", S.rounded("share"))


@query("d01_candidate_lists", "SELECT p_brand, array_to_string(list_sort(list(DISTINCT p_name))[1:5], '|') AS candidates FROM part GROUP BY 1")
def candidates(t):
    return t.part.groupBy("p_brand").agg(F.concat_ws("|", F.slice(F.array_sort(F.collect_set("p_name")), 1, 5)).alias("candidates"))


@query("d02_factor_documents", "SELECT l_orderkey, '[' || string_agg('{\"factor_id\":' || l_partkey || ',\"contribution\":' || l_quantity::BIGINT || '}', ',' ORDER BY -l_quantity, l_partkey) || ']' AS factors_json, count(*) AS n_factors FROM lineitem WHERE l_orderkey % 20 = 0 GROUP BY 1")
def documents(t):
    rows = t.lineitem.filter("l_orderkey % 20 = 0").select("l_orderkey", "l_partkey", F.col("l_quantity").cast("long").alias("q"))
    return P.factor_documents(rows, ["l_orderkey"], "l_partkey", "q")


def _reports(score):
    return f"""SELECT c_custkey, '{{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '"' || {score} || ',"orders":[' || coalesce(o, '') || ']}}' AS document FROM customer LEFT JOIN
        (SELECT o_custkey, string_agg('{{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}}', ',' ORDER BY o_orderkey, o_orderstatus) AS o FROM orders GROUP BY 1) ON o_custkey = c_custkey"""


@query("d03_reports", _reports("',\"score\":' || c_acctbal"))
def reports(t):
    head = t.customer.select("c_custkey", "c_name", F.col("c_acctbal").alias("score"))
    orders = t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderstatus")
    return P.reports(head, {"orders": orders}, "c_custkey")


@query("d04_public_projection", f"SELECT c_custkey, false AS leaks, sha256(document) AS sha256 FROM ({_reports("''")})")
def public(t):
    return P.projected(reports(t), ["score"]).select("c_custkey", "leaks", F.sha2("public", 256).alias("sha256"))


@query("d06_case_flags", "SELECT l_orderkey, bool_or(l_discount > 0.05) AS any_positive, bool_and(l_returnflag = 'N') AS all_displayed, max(l_discount) AS max_contribution, count(*) FILTER (l_returnflag = 'N') AS n_displayed FROM lineitem GROUP BY 1")
def flags(t):
    f = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(F.struct((F.col("l_discount") - 0.05).alias("contribution"), F.col("l_discount").alias("d"), (F.col("l_returnflag") == "N").alias("display"))).alias("f"))
    out = P.case_flags(F.col("f"))
    return f.select("l_orderkey", F.exists("f", lambda x: x["d"] > 0.05).alias("any_positive"), out["all_displayed"].alias("all_displayed"), F.array_max(F.transform("f", lambda x: x["d"])).alias("max_contribution"), out["n_displayed"].alias("n_displayed"))


@query("k04_manifest", "SELECT doc_id, sha256(text) AS sha256, strlen(text)::BIGINT AS bytes FROM documents WHERE text IS NOT NULL")
def manifest(t):
    return P.manifest(t.documents.filter("text IS NOT NULL"), "doc_id", "text")


@query("l01_search_order", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderstatus, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END NULLS LAST, o_orderkey) AS place FROM orders QUALIFY place <= 100")
def order(t):
    p = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority"))
    rows = t.orders.select("o_orderkey", "o_orderstatus", p.alias("p")).orderBy("o_orderstatus", F.asc_nulls_last("p"), "o_orderkey").limit(100)
    from pyspark.sql import Window as W

    return rows.select("o_orderkey", F.row_number().over(W.orderBy("o_orderstatus", F.asc_nulls_last("p"), "o_orderkey")).alias("place"))


@query("l02_extremes", "SELECT * FROM (SELECT 'largest' AS kind, o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5) UNION ALL SELECT * FROM (SELECT 'smallest', o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 5)")
def extremes(t):
    a = t.orders.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(5).select(F.lit("largest").alias("kind"), "o_orderkey")
    return a.unionByName(t.orders.orderBy("o_totalprice", "o_orderkey").limit(5).select(F.lit("smallest").alias("kind"), "o_orderkey"))


@query(
    "l03_quota_sample",
    """WITH s AS (SELECT o_orderpriority AS st, count(*) AS z FROM orders GROUP BY 1), q AS (SELECT st, z, least(greatest(round_even(z / sum(z) OVER () * 60, 0), 1), z) AS q FROM s), a AS (SELECT *, 60 - sum(q) OVER () AS short, row_number() OVER (ORDER BY z DESC, st) AS o FROM q),
    f AS (SELECT st, least(greatest(q + CASE WHEN o = 1 THEN short ELSE 0 END, 1), z) AS q FROM a), r AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY sha256('1:' || o_orderkey), o_orderkey) AS n FROM orders)
    SELECT o_orderkey, o_orderpriority FROM r JOIN f ON st = o_orderpriority WHERE n <= q""",
)
def quota(t):
    return P.quota_sample(t.orders.select("o_orderkey", "o_orderpriority"), "o_orderpriority", 60, "o_orderkey")


@query("l10_seeded_choice", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'P' ORDER BY o_orderstatus, sha256('7:' || o_orderkey) LIMIT 10")
def choice(t):
    return P.seeded_first(t.orders.filter("o_orderstatus <> 'P'").select("o_orderkey", "o_orderstatus"), [F.col("o_orderstatus")], "o_orderkey", 10, 7)


@query("p17_masked_ids", "SELECT s_suppkey, s_nationkey::BIGINT AS s_nationkey, substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', dense_rank() OVER (ORDER BY s_nationkey), 1) || '-' || lpad((row_number() OVER (PARTITION BY s_nationkey ORDER BY sha256(s_suppkey::VARCHAR)))::VARCHAR, 3, '0') AS masked_id FROM supplier")
def masked(t):
    return P.masked_ids(t.supplier.select("s_suppkey", "s_nationkey"), "s_nationkey", "s_suppkey")


@query("p19_row_keys", "SELECT store_id, origin, substr(sha256(store_id || '|' || origin), 1, 32) AS row_key FROM panel WHERE origin = '1999Q1'")
def keys(t):
    return t.panel().filter("origin = '1999Q1'").select("store_id", "origin", P.row_key(F.col("store_id").cast("string"), F.col("origin")).alias("row_key"))


@query("p20_directions", "SELECT CASE WHEN abs(l_discount - 0.05) < 0.001 THEN 'neutral' WHEN l_discount > 0.05 THEN 'up' ELSE 'down' END AS direction, count(*) AS n FROM lineitem GROUP BY 1")
def directions(t):
    return t.lineitem.withColumn("c", F.col("l_discount") - 0.05).groupBy(P.direction("c").alias("direction")).agg(F.count("*").alias("n"))


@query("n01_name_parts", r"SELECT p_partkey, regexp_replace(upper(p_name), '[^가-힣A-Za-z0-9]', '', 'g') AS name_norm FROM part")
def names(t):
    return X.compatibility_form(t.part.select("p_partkey", "p_name"), ["p_name"]).select("p_partkey", X.name_parts("p_name")["name_norm"].alias("name_norm"))


@query("n02_name_with_branch", "SELECT p_partkey, CASE WHEN contains(p_name, split_part(p_brand, '#', 1)) THEN p_name ELSE p_name || split_part(p_brand, '#', 1) END AS joined FROM part")
def with_branch(t):
    return t.part.select("p_partkey", X.with_branch("p_name", F.element_at(F.split("p_brand", "#"), 1)).alias("joined"))


@query(
    "n03_address_parse",
    """WITH a AS (SELECT o_orderkey, '서울특별시 ' || n_name || '구 ' || 'D' || (o_orderkey % 5) || '동 ' || CASE WHEN o_orderkey % 4 = 0 THEN '산' ELSE '' END || (1 + o_orderkey % 900) || CASE WHEN o_orderkey % 3 = 0 THEN '-' || (o_orderkey % 50 + 1) ELSE '' END AS addr, n_name, o_orderkey AS k FROM orders JOIN nation ON n_nationkey = o_orderkey % 25)
    SELECT o_orderkey, CASE WHEN k % 5 = 4 THEN 'no_area' ELSE 'ok' END AS parse_status, CASE WHEN k % 5 <> 4 THEN '1100' || lpad((k % 5)::VARCHAR, 6, '0') || CASE WHEN k % 4 = 0 THEN '2' ELSE '1' END || lpad((1 + k % 900)::VARCHAR, 4, '0') || lpad(CASE WHEN k % 3 = 0 THEN (k % 50 + 1)::VARCHAR ELSE '0' END, 4, '0') END AS pnu FROM a""",
)
def addresses(t):
    k = F.col("o_orderkey")
    s = lambda c: c.cast("string")
    joined = t.orders.join(t.nation, F.col("n_nationkey") == k % 25)
    addr = F.concat(F.lit("서울특별시 "), "n_name", F.lit("구 D"), s(k % 5), F.lit("동 "), F.when(k % 4 == 0, "산").otherwise(""), s(1 + k % 900), F.when(k % 3 == 0, F.concat(F.lit("-"), s(k % 50 + 1))).otherwise(""))
    rows = joined.select("o_orderkey", addr.alias("addr"))
    places = t.nation.crossJoin(t.spark.range(4)).select(F.concat("n_name", F.lit("구")).alias("gu"), F.concat(F.lit("D"), s(F.col("id")), F.lit("동")).alias("dong"), F.concat(F.lit("1100"), F.lpad(s(F.col("id")), 6, "0")).alias("code"))
    return X.parse_address(rows, "addr", places, "서울특별시").select("o_orderkey", "parse_status", "pnu")


@query("n08_match_keys", "SELECT p_partkey, lower(regexp_replace(p_brand || ' ' || p_name, '[^0-9a-zA-Z가-힣]', '', 'g')) AS match_key FROM part")
def match_keys(t):
    return t.part.select("p_partkey", X.match_key(F.concat_ws(" ", "p_brand", "p_name")).alias("match_key"))


@query("n09_either_contains", "SELECT count(*) AS n, count(*) FILTER (contains(a.p_name, b.w) OR contains(b.w, a.p_name)) AS n_match FROM part a JOIN (SELECT p_partkey + 1 AS k, split_part(p_name, ' ', 1) AS w FROM part) b ON a.p_partkey = b.k")
def either(t):
    b = t.part.select((F.col("p_partkey") + 1).alias("p_partkey"), F.element_at(F.split("p_name", " "), 1).alias("w"))
    return t.part.join(b, "p_partkey").agg(F.count("*").alias("n"), F.count_if(X.either_contains(F.col("p_name"), F.col("w"))).alias("n_match"))


@query("n12_without_tags", r"SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g'))) AS text_md5 FROM pages")
def tags(t):
    return t.pages.select("page_id", F.md5(X.without_tags("html")).alias("text_md5"))


@query("n13_keyword_texts", "SELECT lang, count(*) AS n, count(*) FILTER (regexp_matches(lower(text), 'license|rights|token')) AS n_hit FROM documents GROUP BY 1")
def keywords(t):
    return t.documents.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(X.mentions_any("text", ["license", "rights", "token"])).alias("n_hit"))


@query("n14_url_owner", r"SELECT page_id, nullif(regexp_extract(url, '^[a-z]+://[^/?#]+/([^/?#]+)', 1), '') AS owner FROM pages")
def owners(t):
    return t.pages.select("page_id", X.url_owner("url").alias("owner"))


@query("n15_compact_dates", r"SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso FROM orders")
def dates(t):
    return t.orders.select("o_orderkey", X.compact_date(F.date_format("o_orderdate", "yyyyMMdd")).alias("iso"))


@query("n16_search_keys", r"SELECT c_custkey, nullif(regexp_replace(upper(c_name), '[^가-힣A-Za-z0-9]', '', 'g'), '') AS key FROM customer")
def search_keys(t):
    return t.customer.select("c_custkey", X.search_key("c_name").alias("key"))


@query("n17_address_rank", r"SELECT c_custkey, (CASE WHEN regexp_matches(k, '1(?:[^0-9]|$)') THEN 0 WHEN contains(k, '1') THEN 1 END)::BIGINT AS rank FROM (SELECT c_custkey, regexp_replace(upper(c_name), '[^가-힣A-Z0-9|-]', '', 'g') AS k FROM customer)")
def address_rank(t):
    return t.customer.select("c_custkey", X.address_rank(X.address_key("c_name"), "1").alias("rank"))


@query("n18_particles", "SELECT p_partkey, p_name || '는' AS with_particle FROM part")
def particles(t):
    return t.part.select("p_partkey", X.particle("p_name", "은", "는").alias("with_particle"))


@query("n19_sentences", "SELECT text, count(*) AS n, text = 'unchanged at ' || regexp_extract(text, '[0-9]+$') AS is_same FROM (SELECT CASE WHEN a > b THEN 'up from ' || b || ' to ' || a WHEN a < b THEN 'down from ' || b || ' to ' || a ELSE 'unchanged at ' || a END AS text FROM (SELECT p_size % 5 AS a, p_partkey % 5 AS b FROM part)) GROUP BY 1")
def sentences(t):
    rows = t.part.select(X.count_change_text(F.col("p_size") % 5, (F.col("p_partkey") % 5).cast("int")).alias("text"))
    kind = X.classify_text(F.col("text"), [("same", r"unchanged at \d+"), ("up", r"up from \d+ to \d+"), ("down", r"down from \d+ to \d+")])
    return rows.withColumn("kind", kind).groupBy("text", (F.col("kind") == "same").alias("is_same")).agg(F.count("*").alias("n"))


RULES = {"email": r"[A-Za-z0-9.]+@[a-z0-9.]+\.[a-z]+", "address": r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"}


@query("n21_text_scan", r"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), h AS (SELECT doc_id, 'email' AS rule, unnest(regexp_extract_all(line, '[A-Za-z0-9.]+@[a-z0-9.]+\.[a-z]+')) AS found FROM l UNION ALL SELECT doc_id, 'address', unnest(regexp_extract_all(line, '\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b')) FROM l) SELECT rule, count(*) AS n, count(DISTINCT doc_id) AS n_docs, count(DISTINCT found) AS n_found FROM h GROUP BY 1")
def scan(t):
    return X.scan_text(t.documents, "doc_id", "text", RULES).groupBy("rule").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs"), F.count_distinct("found").alias("n_found"))


@query("n21_redacted", r"SELECT doc_id, md5(regexp_replace(regexp_replace(text, '[A-Za-z0-9.]+@[a-z0-9.]+\.[a-z]+', '[email]', 'g'), '\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b', '[address]', 'g')) AS redacted_md5 FROM documents")
def redacted(t):
    return t.documents.select("doc_id", F.md5(X.redacted("text", RULES)).alias("redacted_md5"))


@query("n22_identifier_search", "WITH w AS (SELECT DISTINCT conv_id, turn, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS word FROM conversations) SELECT count(*) AS n_hits, count(DISTINCT (conv_id, turn)) AS n_turns FROM w JOIN (SELECT DISTINCT split_part(p_name, ' ', 1) AS word FROM part) USING (word)")
def identifiers(t):
    w = t.conversations.select("conv_id", "turn", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), F.lit(1)))).alias("word"))
    hit = w.join(t.part.select(F.element_at(F.split("p_name", " "), 1).alias("word")).distinct(), "word")
    return hit.agg(F.count("*").alias("n_hits"), F.count_distinct("conv_id", "turn").alias("n_turns"))


@query("n24_name_search", "WITH e AS (SELECT p_partkey AS store_id, p_name AS name, upper(regexp_replace(p_name, '[^A-Za-z0-9]', '', 'g')) AS n FROM part), q AS (SELECT upper(regexp_replace(min(p_name), '[^A-Za-z0-9]', '', 'g'))[1:3] AS q FROM part) SELECT store_id, (CASE WHEN n = q THEN 0 WHEN starts_with(n, q) THEN 2 ELSE 3 END)::BIGINT AS stage FROM e, q WHERE contains(n, q)")
def search(t):
    e = t.part.select(F.col("p_partkey").alias("store_id"), F.col("p_name").alias("name"), X.search_key("p_name").alias("name_norm"), F.lit("1").alias("gu"), F.lit("1").alias("dong"))
    q = e.agg(F.min("name")).select(F.substring(X.search_key("min(name)"), 1, 3)).first()[0]
    return X.name_search(e, q, q).select("store_id", "stage")


@query("n25_quarter_codes", "SELECT DISTINCT year(o_orderdate) || 'Q' || quarter(o_orderdate) AS label FROM orders")
def codes(t):
    return t.orders.select(S.quarter_code_label(F.year("o_orderdate") * 10 + F.quarter("o_orderdate")).alias("label")).distinct()


@query("n26_error_kinds", "SELECT CASE event_id % 4 WHEN 0 THEN 'quota' WHEN 1 THEN 'auth' WHEN 2 THEN 'server' ELSE 'none' END AS kind, count(*) AS n FROM events GROUP BY 1")
def errors(t):
    code = F.element_at(F.array(F.lit("429"), F.lit("401"), F.lit("500"), F.lit(None).cast("string")), (F.col("event_id") % 4 + 1).cast("int"))
    body = F.to_json(F.struct(F.struct(code.alias("errorCode")).alias("error")))
    return t.events.groupBy(X.error_kind(body).alias("kind")).agg(F.count("*").alias("n"))


@query("d10_json_path", "SELECT event_id, (props->>'k')::BIGINT AS k FROM events")
def json_path(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query(
    "r01_master_chain",
    """SELECT p.store_id, p.origin, p.event_12m::BIGINT AS event_12m, s.qty, c.c_mktsegment AS segment FROM panel p LEFT JOIN series s ON s.dong = p.dong AND s.q = origin_no - 1 LEFT JOIN customer c ON c.c_custkey = p.pnu""",
)
def chain(t):
    series = t.series().select("dong", S.quarter_label("q").alias("quarter"), "qty")
    segments = t.customer.select(F.col("c_custkey").alias("pnu"), F.col("c_mktsegment").alias("segment"))
    steps = {"series": lambda df: J.lagged(df, series, ["dong"]), "segment": lambda df: J.attach(df, segments, ["pnu"], check=False)}
    out = MA.master(t.panel(), steps)
    return out.select("store_id", "origin", "event_12m", "qty", "segment")


@query("r01_chain_fingerprint", "SELECT count(*) AS n_rows, count(DISTINCT store_id) AS n_stores, 0::BIGINT AS n_duplicates, sum(event_12m)::BIGINT AS n_events, count(DISTINCT origin) AS n_origins FROM panel")
def fingerprint(t):
    return C.fingerprint(chain(t), ["store_id", "origin"], "event_12m").drop("label_hash")


@query("k01_stored_copy", "SELECT * FROM customer")
def stored(t):
    from tidemark.sources import writers

    df = t.customer
    return writers.staged(df, f"{writers.shared_folder(t.spark)}/customer-copy", lambda again: C.require(again, {"no_key": F.col("c_custkey").isNull()}))
