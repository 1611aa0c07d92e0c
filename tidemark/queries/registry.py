"""Queries over the driver's tables, each with an SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import panel as P

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

FIRST, LAST = 1996 * 4, 2000 * 4 + 1  # the origins 1996Q1 to 2000Q2


def query(name: str, sql: str | None = None):
    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(Tables(spark, sf_dir))
            return df.select(*[F.col(f"`{c}`").cast("long").alias(c) if t in ("int", "smallint", "tinyint") else F.col(f"`{c}`") for c, t in df.dtypes])

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = with_tables(sql)
        return f

    return register


class Tables:
    """The driver's tables and what stands in for the entities of the panel."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(text)

    def stores(self) -> DataFrame:
        """An order is a store: opened on its date, closed by its first later shipment if its status is F."""
        o = self.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", F.col("o_orderdate").cast("date").alias("license_date"), "o_orderpriority")
        shipped = self.lineitem.select("l_orderkey", F.col("l_shipdate").cast("date").alias("day")).join(o.select("o_orderkey", "license_date"), F.col("l_orderkey") == F.col("o_orderkey"))
        closed = shipped.filter("day > license_date").groupBy("l_orderkey").agg(F.min("day").alias("day"))
        c = self.customer.join(self.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "c_nationkey", "n_regionkey")
        rows = o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left").join(closed, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        return rows.select(
            F.col("o_orderkey").alias("store_id"), F.col("o_orderpriority").alias("biz_type"), F.col("n_regionkey").alias("gu"), F.col("c_nationkey").alias("dong"), F.col("o_custkey").alias("pnu"),
            F.col("o_totalprice").alias("area"), "license_date", F.when(F.col("o_orderstatus") == "F", F.col("day")).alias("close_date"), F.col("o_orderstatus").alias("status"),
        )

    def panel(self) -> DataFrame:
        return P.long_panel(self.stores(), FIRST, LAST)

    def calendar(self) -> DataFrame:
        return P.calendar(self.spark, FIRST, LAST)

    def scored(self) -> DataFrame:
        """A line item is a scored row: returned or not, with a score of its discount and tax."""
        p = F.greatest(F.least(F.bround(F.col("l_discount") * 5 + F.col("l_tax"), 4), F.lit(0.999)), F.lit(0.001))
        d = F.col("l_shipdate").cast("date")
        return self.lineitem.select((F.col("l_returnflag") == "R").cast("int").alias("y"), p.alias("p"), F.col("l_suppkey").alias("cluster"), (F.year(d) * 4 + F.quarter(d) - 1).alias("origin_no"), "l_quantity", "l_linestatus")

    def series(self) -> DataFrame:
        """Sales of suppliers' nations by quarter."""
        d = F.col("l_shipdate").cast("date")
        rows = self.lineitem.join(self.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        rows = rows.select(F.col("s_nationkey").alias("dong"), (F.year(d) * 4 + F.quarter(d) - 1).alias("q"), F.col("l_quantity").cast("long").alias("n"))
        return rows.groupBy("dong", "q").agg(F.sum("n").alias("qty"), F.count("*").alias("lines"))

    def code_rows(self) -> tuple[DataFrame, DataFrame]:
        """(store rows, sales rows) of codes: part types by supplier's nation and quarter."""
        d = F.col("l_shipdate").cast("date")
        rows = self.lineitem.join(self.supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(self.part, F.col("l_partkey") == F.col("p_partkey"))
        rows = rows.select(F.col("s_nationkey").alias("dong"), (F.year(d) * 4 + F.quarter(d) - 1).alias("q"), F.col("p_type").alias("code"), F.col("l_quantity").cast("long").alias("n"), "l_returnflag")
        store = rows.filter("l_returnflag <> 'R'").groupBy("dong", "q", "code").agg(F.count("*").alias("total"), F.count_if(F.col("n") > 40).alias("opened"), F.count_if(F.col("n") < 5).alias("closed"))
        sales = rows.filter("l_returnflag <> 'A'").groupBy("dong", "q", "code").agg(F.sum("n").alias("sales"))
        return store, sales

    def snapshots(self) -> DataFrame:
        """Part numbers by quarter of shipment: a directory that was published seven times, as the one it stands for."""
        d = F.col("l_shipdate").cast("date")
        rows = self.lineitem.select(F.col("l_partkey").alias("id"), (F.year(d) * 4 + F.quarter(d) - 1).alias("snapshot")).filter("snapshot BETWEEN 7984 AND 7990").distinct()
        return rows.join(self.part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("block"), F.col("p_name").alias("name")), "id")

    def points(self) -> DataFrame:
        return self.embeddings.select(F.col("vec_id").alias("id"), F.bround(F.col("embedding")[0].cast("double") * 100, 3).alias("x"), F.bround(F.col("embedding")[1].cast("double") * 100, 3).alias("y"))

    def mentions(self) -> DataFrame:
        d = F.col("l_shipdate").cast("date")
        return self.lineitem.groupBy(F.col("l_partkey").alias("store_id"), (F.year(d) * 12 + F.month(d) - 1).alias("month_no")).agg(F.count("*").alias("mention_count"))


#: The same stand-ins in SQL; a twin names those it needs.
TABLES = {
    "closed": "SELECT l_orderkey, min(l_shipdate::DATE) AS day FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_shipdate::DATE > o_orderdate::DATE GROUP BY 1",
    "stores": """SELECT o_orderkey AS store_id, o_orderpriority AS biz_type, n_regionkey AS gu, c_nationkey AS dong, o_custkey AS pnu, o_totalprice AS area, o_orderdate::DATE AS license_date,
        CASE WHEN o_orderstatus = 'F' THEN day END AS close_date, o_orderstatus AS status FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN closed ON l_orderkey = o_orderkey""",
    "cal": "SELECT n AS origin_no, (n // 4) || 'Q' || (n % 4 + 1) AS origin, make_date(n // 4, n % 4 * 3 + 1, 1) AS origin_start, last_day(make_date(n // 4, n % 4 * 3 + 3, 1)) AS origin_end FROM range(7984, 8002) t(n)",
    "panel": """SELECT s.*, origin, origin_no, origin_end, CASE WHEN close_date <= (origin_end + INTERVAL 12 MONTH)::DATE THEN 1 ELSE 0 END AS event_12m,
        (year(origin_end) - year(license_date)) * 12 + month(origin_end) - month(license_date) AS age_months FROM stores s JOIN cal ON license_date <= origin_end AND (close_date IS NULL OR close_date > origin_end)""",
    "scored": """SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, greatest(least(round_even(l_discount * 5 + l_tax, 4), 0.999), 0.001)::DOUBLE AS p, l_suppkey AS cluster,
        year(l_shipdate) * 4 + quarter(l_shipdate) - 1 AS origin_no, l_quantity, l_linestatus FROM lineitem""",
    "series": "SELECT s_nationkey AS dong, year(l_shipdate) * 4 + quarter(l_shipdate) - 1 AS q, sum(l_quantity::BIGINT)::BIGINT AS qty, count(*) AS lines FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2",
    "code_base": """SELECT s_nationkey AS dong, year(l_shipdate) * 4 + quarter(l_shipdate) - 1 AS q, p_type AS code, l_quantity::BIGINT AS n, l_returnflag FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey""",
    "code_store": "SELECT dong, q, code, count(*) AS total, count(*) FILTER (n > 40) AS opened, count(*) FILTER (n < 5) AS closed FROM code_base WHERE l_returnflag <> 'R' GROUP BY 1, 2, 3",
    "code_sales": "SELECT dong, q, code, sum(n)::BIGINT AS sales FROM code_base WHERE l_returnflag <> 'A' GROUP BY 1, 2, 3",
    "code_grid": """SELECT d.dong, t.q, c.code, s.total, s.opened, s.closed, x.sales, s.total IS NOT NULL AS has_0, x.sales IS NOT NULL AS has_1 FROM (SELECT DISTINCT dong FROM code_base) d CROSS JOIN (SELECT DISTINCT q FROM code_base) t
        CROSS JOIN (SELECT DISTINCT code FROM code_base) c LEFT JOIN code_store s ON s.dong = d.dong AND s.q = t.q AND s.code = c.code LEFT JOIN code_sales x ON x.dong = d.dong AND x.q = t.q AND x.code = c.code""",
    "snapshots": """SELECT DISTINCT l_partkey AS id, year(l_shipdate) * 4 + quarter(l_shipdate) - 1 AS snapshot, p_brand AS block, p_name AS name FROM lineitem JOIN part ON p_partkey = l_partkey
        WHERE year(l_shipdate) * 4 + quarter(l_shipdate) - 1 BETWEEN 7984 AND 7990""",
    "points": "SELECT vec_id AS id, round_even(embedding[1]::DOUBLE * 100, 3) AS x, round_even(embedding[2]::DOUBLE * 100, 3) AS y FROM embeddings",
    "mentions": "SELECT l_partkey AS store_id, year(l_shipdate) * 12 + month(l_shipdate) - 1 AS month_no, count(*) AS mention_count FROM lineitem GROUP BY 1, 2",
}


def with_tables(sql: str) -> str:
    """The statement with those stand-ins in front that it, or one it needs, names."""
    import re

    text, chosen = sql, []
    for name in reversed(list(TABLES)):
        if re.search(rf"\b{name}\b", text):
            chosen.insert(0, name)
            text += " " + TABLES[name]
    head = ", ".join(f"{n} AS ({TABLES[n]})" for n in chosen)
    if not head:
        return sql
    body = sql.lstrip()
    if body.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head}, {body[15:]}"
    return f"WITH {head}, {body[5:]}" if body.startswith("WITH ") else f"WITH {head} {body}"
