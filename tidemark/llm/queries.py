"""One query for each operator of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, fuzzy_lines, html_main, langid, license_scan, maglev, mixing, order_minhash, pivot_topk, revisit, scratch

SHARDS = [f"shard-{i:03d}" for i in range(64)]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_topk.top_k(read(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = langid.identify(docs)
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "margin")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")
    return decontaminate.digest(decontaminate.contamination(docs, items))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.near_duplicates(read(spark, sf_dir, "documents"))


def op5_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_lines.fuzzy_lines(read(spark, sf_dir, "documents"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    measured = mixing.measure(docs).drop("text")  # the text stays behind before anything is joined
    rated = scratch.table(mixing.label_weight(measured, read(spark, sf_dir, "labels")), "measured")
    return mixing.mix(rated).select("doc_id", "size", "source_size", "target", "taken")


def op7_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = revisit.resolve(revisit.captures(read(spark, sf_dir, "pages")))
    headers = F.array_join(F.transform("merged_headers", lambda h: F.concat(h["name"], F.lit(": "), h["value"])), "\n")
    return found.select("record_id", "canonical_url", "status", "outcome", "response_id", headers.alias("merged_headers"))


def op8_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maglev.shard(read(spark, sf_dir, "documents"), SHARDS).select("doc_id", "slot", "shard", "shard_name")


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_main.extract(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"), "n_blocks")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.digest(license_scan.scan(read(spark, sf_dir, "documents")))


QUERIES = {
    "op1_exact_topk": op1_exact_topk,
    "op2_language_id": op2_language_id,
    "op3_decontaminate": op3_decontaminate,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_fuzzy_lines": op5_fuzzy_lines,
    "op6_mix_sources": op6_mix_sources,
    "op7_revisits": op7_revisits,
    "op8_shard": op8_shard,
    "op9_main_text": op9_main_text,
    "op10_license_scan": op10_license_scan,
}

#: Words of a text, as op3 and op10 take them.
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL: dict[str, str] = {
    "op1_exact_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
        r AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s)
        SELECT * FROM r WHERE rank <= 10""",
    "op3_decontaminate": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
        win AS (SELECT DISTINCT item_id, w[k:k + 9] AS win, least(len(w), 10) AS n FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS k FROM b WHERE len(w) > 0)),
        pos AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d),
        f AS (SELECT DISTINCT n, win[1] AS first FROM win),
        may AS (SELECT pos.doc_id, p, f.n, w[p:p + f.n - 1] AS part FROM pos JOIN f ON w[p] = f.first),
        hit AS (SELECT DISTINCT may.doc_id, p, may.n, item_id FROM may JOIN win ON may.part = win.win AND may.n = win.n),
        cov AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS x FROM hit) GROUP BY doc_id),
        it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hit GROUP BY doc_id)
        SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
        FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN it USING (doc_id)""",
    "op7_revisits": r"""
        WITH p AS (SELECT *, TIMESTAMP '2024-01-01' + INTERVAL 1 MINUTE * (page_id % 40000) AS t0, md5(coalesce(html, ''))[1:16] AS tag, strftime(DATE '2024-01-01' + (page_id % 300)::INT, '%Y-%m-%d') AS day,
            regexp_replace(regexp_replace(url, '^http:', 'https:'), '[#].*$', '') AS u2 FROM pages),
        c AS (SELECT page_id * 2 AS record_id, url, t0 AS at, 200 AS status, strlen(coalesce(html, '')) AS size, CASE WHEN page_id % 5 <> 0 THEN '"' || tag || '"' END AS etag, day, NULL AS date FROM p
            UNION ALL SELECT page_id * 2 + 1, u2 || CASE WHEN contains(u2, '?') THEN '&' ELSE '?' END || 'utm_source=x', t0 + INTERVAL 30 DAY, 304, 0,
            CASE WHEN page_id % 11 = 0 THEN NULL WHEN page_id % 7 = 0 THEN '"0"' ELSE 'W/"' || tag || '"' END, CASE WHEN page_id % 11 <> 0 THEN day END, strftime(t0 + INTERVAL 30 DAY, '%Y-%m-%d') FROM p),
        b AS (SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.\-]*://', '') AS bare FROM c),
        h AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), '^[^@]*@', ''), ':(80|443)?$', ''), '^(www[0-9]*|m)\.([^.]+\.)', '\2') AS host,
            regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
            list_sort(list_filter(string_split(regexp_extract(bare, '^[^?]*\?(.*)$', 1), '&'), lambda q: q <> '' AND NOT regexp_matches(lower(q), '^(utm_[a-z]+|ref|fbclid|gclid|sessionid|sid|phpsessid|jsessionid)(=|$)'))) AS params FROM b),
        r AS (SELECT *, CASE WHEN host <> '' THEN host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END END AS canonical_url FROM h),
        f AS (SELECT v.record_id, max((s.at, s.record_id)) AS best FROM r v JOIN r s ON s.status = 200 AND s.canonical_url = v.canonical_url AND s.at < v.at WHERE v.status = 304 GROUP BY 1),
        j AS (SELECT v.*, s.record_id AS s_id, s.size AS s_size, s.etag AS s_etag, s.day AS s_day FROM r v LEFT JOIN f ON f.record_id = v.record_id LEFT JOIN r s ON s.record_id = struct_extract_at(f.best, 2)),
        o AS (SELECT *, CASE WHEN status = 200 THEN 'full' WHEN canonical_url IS NULL THEN 'no_url' WHEN s_id IS NULL THEN 'no_earlier_response'
            WHEN etag IS NOT NULL AND s_etag IS NOT NULL THEN CASE WHEN regexp_replace(etag, '^W/', '') = regexp_replace(s_etag, '^W/', '') THEN 'resolved' ELSE 'changed' END
            WHEN day IS NOT NULL AND s_day IS NOT NULL THEN CASE WHEN day = s_day THEN 'resolved' ELSE 'changed' END ELSE 'no_validator' END AS outcome FROM j)
        SELECT record_id, canonical_url, status, outcome, CASE outcome WHEN 'full' THEN record_id WHEN 'resolved' THEN s_id END AS response_id,
            CASE outcome WHEN 'full' THEN concat_ws(chr(10), 'cache-control: max-age=60', 'content-length: ' || size, 'content-type: text/html', 'etag: ' || etag, 'last-modified: ' || day)
            WHEN 'resolved' THEN concat_ws(chr(10), 'cache-control: max-age=3600', 'content-length: ' || s_size, 'content-type: text/html', 'date: ' || date, 'etag: ' || coalesce(etag, s_etag), 'last-modified: ' || coalesce(day, s_day)) END AS merged_headers FROM o""",
}
