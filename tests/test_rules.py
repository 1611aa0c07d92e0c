"""Boundary cases of the rules."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark import semantics as S
from tidemark.functions import text as X
from tidemark.operators import areas as A
from tidemark.operators import contracts as C
from tidemark.operators import geo as G
from tidemark.operators import joins as J
from tidemark.operators import metrics as M
from tidemark.operators import models as ML
from tidemark.operators import panel as P
from tidemark.operators import peers as E
from tidemark.operators import publish as U
from tidemark.operators import resolve as R
from tidemark.sources import readers, writers
from tidemark.streaming import mentions as ST

D = dt.date
STORE = "store_id string, license_date date, close_date date, biz_type string, pnu string, dong string"


def one(spark, expr):
    return spark.range(1).select(expr.alias("v")).first()[0]


def test_open_and_event_boundaries(spark):
    end = D(2021, 3, 31)
    rows = [("opens_on_end", end, None), ("closes_on_end", D(2020, 1, 1), end), ("closes_day_after", D(2020, 1, 1), D(2021, 4, 1)), ("closes_a_year_on", D(2020, 1, 1), D(2022, 3, 31)), ("closes_later", D(2020, 1, 1), D(2022, 4, 1)), ("opens_after", D(2021, 4, 1), None)]
    stores = spark.createDataFrame(rows, "store_id string, license_date date, close_date date")
    got = {r["store_id"]: r["event_12m"] for r in P.long_panel(stores, 2021 * 4, 2021 * 4).collect()}
    assert got == {"opens_on_end": 0, "closes_day_after": 1, "closes_a_year_on": 1, "closes_later": 0}


def test_the_panel_knows_nothing_of_the_future(spark):
    stores = spark.createDataFrame([("a", D(2020, 1, 1), D(2023, 1, 1)), ("b", D(2022, 1, 1), None)], "store_id string, license_date date, close_date date")
    known = {r["store_id"]: r["close_date"] for r in P.known_at(stores, F.lit("2021-06-30").cast("date")).collect()}
    assert known == {"a": None}


def test_calendar_arithmetic(spark):
    assert one(spark, S.quarter_label(F.lit(2021 * 4))) == "2021Q1" and one(spark, S.quarter_of_label(F.lit("2020Q4"))) == 2021 * 4 - 1
    assert one(spark, S.quarter_end(F.lit(2024 * 4))) == D(2024, 3, 31)
    assert one(spark, S.whole_months(F.lit("2020-01-31").cast("date"), F.lit("2020-02-01").cast("date"))) == 1
    assert one(spark, S.rounded(F.lit(2.5), 0)) == 2.0 and one(spark, S.rounded(F.lit(3.5), 0)) == 4.0


def test_missing_is_not_zero(spark):
    assert one(spark, S.ratio(F.lit(1.0), F.lit(0.0))) is None
    assert one(spark, S.parsed_number(F.lit(" 1,390.75 "))) == 1390.75 and one(spark, S.parsed_number(F.lit(" "))) is None
    grid = spark.createDataFrame([("a", 1, "x", None, None, None, None, False, False), ("b", 1, "x", 0, 1, 1, 5, True, True)], "area string, q int, code string, total long, opened long, closed long, sales long, has_0 boolean, has_1 boolean")
    got = {r["area"]: r for r in A.observed_partial(grid, ["area", "q"], F.lit(1)).collect()}
    assert got["a"]["store_total"] is None and got["b"]["open_rate"] is None and got["b"]["sales_per_store"] is None


def test_a_missing_value_after_a_missing_one_is_a_change(spark):
    rows = spark.createDataFrame([("a", q, v) for q, v in enumerate([5, 5, None, None, 5, 6, 6])], "k string, q int, v int")
    got = [r["c"] for r in rows.withColumn("c", A.last_change(rows, "v", ["k"], "q")).orderBy("q").collect()]
    assert got == [0, 0, 2, 3, 4, 5, 5]


def test_age_bands_differ_at_their_edges(spark):
    assert one(spark, S.age_band(F.lit(12))) == 1 and one(spark, S.age_band(F.lit(12), closed="right")) == 0 and one(spark, S.age_band(F.lit(None).cast("int"))) is None


def test_competition_counts_leave_out_the_store_itself(spark):
    rows = [("s1", D(2020, 1, 1), None, "k", "p1", "d1"), ("s2", D(2020, 5, 1), None, "k", "p1", "d1"), ("s3", D(2021, 3, 31), None, "k", "p2", "d1"), ("s4", D(2019, 1, 1), D(2021, 3, 31), "k", "p2", "d1"), ("s5", D(2020, 1, 1), None, "k", None, None)]
    stores = spark.createDataFrame(rows, STORE)
    panel = P.long_panel(stores, 2021 * 4, 2021 * 4)
    got = {r["store_id"]: r for r in A.competition(panel, stores, P.calendar(spark, 2021 * 4, 2021 * 4)).collect()}
    assert set(got) == {"s1", "s2", "s3", "s5"}
    assert (got["s1"]["pnu_cnt"], got["s1"]["dong_same_type_cnt"], got["s1"]["dong_open_4q"], got["s1"]["dong_close_4q"]) == (1, 2, 2, 1)
    assert got["s3"]["dong_open_4q"] == 1 and got["s5"]["pnu_cnt"] is None and got["s5"]["dong_close_4q"] is None


def test_mention_windows_and_cut_collections(spark):
    base = 2021 * 12
    panel = spark.createDataFrame([(s, "2021Q4", D(2021, 12, 31)) for s in "abcd"], "store_id string, origin string, origin_end date")
    monthly = spark.createDataFrame([("a", base + 11, 2), ("a", base + 8, 5), ("a", base - 5, 1), ("a", base + 12, 9), ("b", base + 10, 1), ("c", base + 1, 1)], "store_id string, month_no int, mention_count long")
    qa = spark.createDataFrame([("a", True, False, None), ("b", True, True, base + 6), ("c", True, True, base + 6)], "store_id string, ok boolean, truncated boolean, trunc_month_no int")
    got = {r["store_id"]: r for r in A.mentions(panel, monthly, qa).collect()}
    assert (got["a"]["cnt_3m"], got["a"]["cnt_12m"], got["a"]["months_since_last"], got["a"]["trend_6m"]) == (2, 7, 0, 7)
    assert (got["b"]["cnt_3m"], got["b"]["cnt_12m"], got["b"]["has_ever"]) == (1, None, 1)
    assert got["c"]["cnt_3m"] == 0 and got["c"]["has_ever"] is None and got["d"]["cnt_3m"] is None


def test_joins_refuse_what_would_change_rows(spark):
    left = spark.createDataFrame([(1, "a")], "k int, v string")
    with pytest.raises(C.ContractError):
        J.attach(left, spark.createDataFrame([(1, 1), (1, 2)], "k int, w int"), ["k"])
    with pytest.raises(C.ContractError):
        J.attach(left, spark.createDataFrame([(1, "b")], "k int, v string"), ["k"])
    with pytest.raises(C.ContractError):
        J.lagged(left, left, ["k"], lag=0)
    with pytest.raises(C.ContractError):
        rows = left.select("k", F.lit("o").alias("origin"), F.lit(1).alias("y"))
        C.require_same(rows, rows.withColumn("y", F.lit(2)), ["k", "origin"], "y")


def test_asof_takes_no_other_year_for_a_missing_price(spark):
    panel = spark.createDataFrame([("s", "p", D(2021, 6, 30)), ("s", "p", D(2021, 3, 31))], "store_id string, k string, origin_end date")
    published = spark.createDataFrame([(2020, D(2020, 4, 30)), (2021, D(2021, 4, 30))], "year int, available_at date")
    got = J.strict_asof(panel, spark.createDataFrame([("p", 2020, 1.0)], "k string, year int, price double"), published, "k").orderBy("origin_end").collect()
    assert [(r["year"], r["price"]) for r in got] == [(2020, 1.0), (2021, None)]


def test_tiers_keep_ambiguity(spark):
    left = spark.createDataFrame([("s1", "b", "x", "xx"), ("s2", "b", "y", "yy"), ("s3", "b", "z", "zz"), ("s4", None, "x", "xx")], "id string, block string, n1 string, n2 string")
    right = spark.createDataFrame([("e1", "b", "x", "q"), ("e2", "b", "y", "q"), ("e3", "b", "y", "yy"), ("e4", "b", "z", "q"), ("e5", "b", "z", "q")], "entity string, block string, n1 string, n2 string")
    got = {r["id"]: (r["matched"], r["tier"], r["entity"], r["candidates"]) for r in J.tiers(left, right, [(1, "n1", "n1"), (2, "n2", "n2")], "block", "id", "entity").collect()}
    assert got == {"s1": (True, 1, "e1", None), "s2": (True, 2, "e3", None), "s3": (False, 1, None, "e4|e5")}


def test_margin_and_crowd(spark):
    rows = spark.createDataFrame([("a", "e1", 0.9), ("a", "e1", 0.8), ("b", "e1", 0.9), ("b", "e2", 0.87), ("c", "e1", 0.5), ("d", "e1", 0.8), ("d", "e2", 0.1)], "id string, e string, s double")
    got = {r["id"]: (r["matched"], r["ambiguous"], r["reason"]) for r in J.best_with_margin(rows, "id", "e", "s", 0.75, 0.05, 1, 0.85).collect()}
    assert got == {"a": (True, False, None), "b": (False, True, "ambiguous"), "c": (False, False, "below_threshold"), "d": (False, True, "crowded_low_score")}


def test_names(spark):
    def parts(name):
        df = X.compatibility_form(spark.createDataFrame([(name,)], "n string"), ["n"])
        r = df.select(X.name_parts("n").alias("p")).first()[0]
        return r and tuple(r)

    assert parts("쥬씨 서울숲점") == ("쥬씨", "서울숲점") and parts("구멍가게상점") == ("구멍가게상점", None)
    assert parts("ＡＢＣ(강남점) 커피") == ("ABC커피", "강남점") and parts("가게(구 이름)") == ("가게", None)
    assert parts(" ") is None and parts(None) is None and parts("*** 본점") == ("본점", "본점")


def test_addresses(spark):
    places = spark.createDataFrame([("A구", "당산동", "1" * 10), ("A구", "당산동1가", "2" * 10)], "gu string, dong string, code string")
    rows = ["서울특별시 A구 당산동1가 산 12-3 x", "서울특별시 A구 당산동 7", "부산 A구 당산동 1", "서울특별시 A구 없는동 1", "서울특별시 A구 당산동", None, "서울특별시 어디"]
    df = spark.createDataFrame([(r,) for r in rows], "a string")
    got = {r["a"]: (r["parse_status"], r["pnu"]) for r in X.parse_address(df, "a", places, "서울특별시").collect()}
    assert got[rows[0]] == ("ok", "2" * 10 + "2" + "0012" + "0003") and got[rows[1]] == ("ok", "1" * 10 + "1" + "0007" + "0000")
    assert [got[r][0] for r in rows[2:]] == ["other_city", "no_area", "no_lot", "missing", "no_district"]


def test_sequence_similarity_is_not_symmetric_and_scored_once(spark):
    import difflib

    pairs = spark.createDataFrame([("abcd", "bcde"), ("abcd", "bcde"), ("x", None)], "a string, b string")
    got = X.sequence_ratio(pairs, "a", "b", "s").collect()
    assert [r["s"] for r in got if r["b"]] == [difflib.SequenceMatcher(None, "abcd", "bcde").ratio()] * 2 and [r["s"] for r in got if not r["b"]] == [None]


def test_points_on_a_boundary_are_not_within(spark):
    ring = spark.sql("SELECT 'a' AS code, array(named_struct('x', 0D, 'y', 0D), named_struct('x', 100D, 'y', 0D), named_struct('x', 100D, 'y', 100D), named_struct('x', 0D, 'y', 100D), named_struct('x', 0D, 'y', 0D)) AS ring")
    points = spark.createDataFrame([(1, 50.0, 50.0), (2, 0.0, 50.0), (3, 100.0, 100.0), (4, 150.0, 50.0)], "id int, x double, y double")
    inside = {r["id"]: r["n_areas"] for r in G.contained(points, ring, 40.0).collect()}
    touching = {r["id"]: r["n_areas"] for r in G.contained(points, ring, 40.0, boundary=True).collect()}
    assert inside == {1: 1, 2: 0, 3: 0, 4: 0} and touching == {1: 1, 2: 1, 3: 1, 4: 0}


def test_the_projection_at_its_origin(spark):
    x, y = G.transverse_mercator(F.lit(127.5), F.lit(38.0))
    assert abs(one(spark, x) - 1_000_000) < 1e-6 and abs(one(spark, y) - 2_000_000) < 1e-6
    x, y = G.transverse_mercator(F.lit(126.978), F.lit(37.5665))  # a known place: about 953.9 km, 1952.0 km
    assert abs(one(spark, x) - 953_901) < 30 and abs(one(spark, y) - 1_952_032) < 60


def test_reissued_ids_become_one_entity(spark):
    rows = [("i1", "202101", "p", "n"), ("i2", "202102", "p", "n"), ("i3", "202103", "p", "n"), ("j1", "202101", "q", "m"), ("j2", "202102", "q", "m"), ("j3", "202102", "q", "m"), ("k", "202101", "r", "o"), ("k", "202103", "r", "o"), ("stay", "202101", "z", "z"), ("stay", "202102", "z", "z"), ("stay", "202103", "z", "z")]
    panel = spark.createDataFrame(rows, "id string, snapshot string, pnu string, name string")
    links = R.reissue_links(panel, "id", "snapshot", ["pnu", "name"])
    assert {(r["old_id"], r["new_id"], r["ambiguous"]) for r in links.collect()} == {("i1", "i2", False), ("i2", "i3", False), ("j1", "j2", True), ("j1", "j3", True)}
    roots = R.chain_roots(links.filter("NOT ambiguous"), "old_id", "new_id", 3)
    assert {tuple(r) for r in roots.collect()} == {("i2", "i1"), ("i3", "i1")}
    got = {r["id"]: r for r in R.entities(panel, roots, "id", "snapshot", ["name"]).collect()}
    assert got["i3"]["entity_id"] == "i1" and got["i1"]["entity_size"] == 3 and got["k"]["has_gap"] and not got["stay"]["has_gap"]
    t = {r["to_snapshot"]: r for r in R.transitions(panel, "id", "snapshot").collect()}
    assert (t["202103"]["reappeared"], t["202102"]["lost"], t["202102"]["lost_forever"]) == (1, 3, 2)


def test_suppression_hides_a_second_cell(spark):
    rows = [("g", "d1", "a", 2), ("g", "d1", "b", 9), ("g", "d1", "c", 7), ("g", "d2", "a", 9), ("g", "d3", "a", 1), ("g", "d3", "b", 1), ("g", "d4", "a", 1), ("g", "d4", "b", 1), ("g", "d4", "c", 9)]
    got = {(r["dong"], r["biz"]): r["reason"] for r in U.suppressed(spark.createDataFrame(rows, "gu string, dong string, biz string, n long"), ["gu", "dong"], "biz", 5).collect()}
    assert got == {("d1", "a"): "small_cell", ("d1", "b"): None, ("d1", "c"): "complementary", ("d2", "a"): None, ("d3", "a"): "small_cell", ("d3", "b"): "small_cell", ("d4", "a"): "small_cell", ("d4", "b"): "small_cell", ("d4", "c"): None}


def test_projection_finds_what_it_must_not_publish(spark):
    df = spark.createDataFrame([('{"a":1,"p":0.5,"f":[{"p":1,"x":2}],"s":"q"}',)], "document string")
    r = U.projected(df, ["p"]).first()
    assert r["public"] == '{"a":1,"f":[{"x":2}],"s":"q"}' and not r["leaks"]


def test_policies(spark):
    stores = spark.createDataFrame([("s1", "g1", "b1", 24), ("s2", "g2", "b1", None), ("s3", None, "b2", 5)], "store_id string, gu string, biz string, tenure_months int")
    policies = spark.createDataFrame([("any", None, None, None, None, None), ("g1", ["g1"], None, 24, 30, None), ("long", None, None, 12, None, None), ("b2", None, ["b2"], None, None, ["x"])], "id string, gus array<string>, bizs array<string>, tenure_min int, tenure_max int, unverifiable array<string>")
    got = {(r["store_id"], r["id"], r["eligibility"]) for r in J.eligible(stores, policies, {"gu": "gus", "biz": "bizs"}).collect()}
    assert got == {("s1", "any", "matched"), ("s2", "any", "matched"), ("s3", "any", "matched"), ("s1", "g1", "matched"), ("s1", "long", "matched"), ("s2", "long", "check_required"), ("s3", "b2", "check_required")}


def test_shapley_values_are_exact_for_an_additive_model(spark):
    rows = spark.createDataFrame([(1, 1.0, 2.0, 3.0), (2, 0.0, 1.0, 1.0)], "id int, a double, b double, c double")
    background = spark.createDataFrame([(0.0, 0.0, 0.0), (1.0, 2.0, 0.0)], "a double, b double, c double")
    got = {(r["id"], r["factor"]): r for r in E.shapley(rows, background, {"x": ["a"], "y": ["b", "c"]}, lambda v: 2 * v["a"] + v["b"] - v["c"], "id").collect()}
    assert got[1, "x"]["contribution"] == pytest.approx(1.0) and got[1, "y"]["contribution"] == pytest.approx(-2.0)
    for r in (1, 2):
        assert got[r, "x"]["contribution"] + got[r, "y"]["contribution"] + got[r, "x"]["base"] == pytest.approx(got[r, "x"]["score"])


def test_embargo_and_roles():
    assert ML.rolling_folds(range(10, 20))[0] == ([10, 11, 12, 13], 18)
    with pytest.raises(C.ContractError):
        ML.check_predictors(["a"], {"a": "label"})


def test_bins_and_bands_at_their_edges(spark):
    scored = spark.createDataFrame([(0, 0.1)] * 5 + [(1, 0.5)] * 5, "y int, p double")
    table = {r["bin"]: (r["n"], r["obs_rate"]) for r in M.reliability(scored, 4).collect()}
    assert sum(n for n, _ in table.values()) == 10
    assert one(spark, M.band(F.lit(0.5), F.lit(0.2), F.lit(0.5))) == "high"
    r = M.ranking(scored).first()
    assert r["auc"] == 1.0 and r["ap"] == 1.0
    assert M.ranking(spark.createDataFrame([(0, 0.5), (1, 0.5)], "y int, p double")).first()["auc"] == 0.5


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "a_202101.csv").write_text('번호,이름\n 1 ,"가, 나"\n2,\n', encoding="cp949")
    raw = readers.csv_text(spark, str(tmp_path / "a_202101.csv"), ["번호", "이름"], "MS949")
    df = readers.renamed(raw, {"no": ["번호", "no"], "name": ["이름"]}, {"kind": "k"})
    assert [tuple(r) for r in df.collect()] == [("1", "가, 나", "k"), ("2", None, "k")]
    assert readers.replacement_counts(raw).first()["이름"] == 0
    with pytest.raises(C.ContractError):
        readers.renamed(raw, {"x": ["none"]})
    assert [r["store_id"] for r in readers.store_ids(df, "kind", "no", {"k": "r"}).collect()] == ["r_1", "r_2"]
    with pytest.raises(Exception):
        readers.store_ids(df, "kind", "no", {"other": "r"}).collect()
    snaps = readers.snapshots(spark, [str(tmp_path / "a_202101.csv")], ["번호", "이름"], "번호", encoding="MS949")
    assert {r["snapshot"] for r in snaps.collect()} == {"202101"}
    spark.range(5000).repartitionByRange(7, "id").sortWithinPartitions("id").write.csv(str(tmp_path / "n.csv"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")  # files in several splits
    scanned = readers.file_rows(spark.read.schema("id long").csv(str(tmp_path / "n.csv"))).collect()
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(scanned) == 5000 and all(r["row_id"] == r["id"] for r in scanned)
    (tmp_path / "r.jsonl").write_text('{"a":1}\nnot json\n{"a":2}\n')
    good, bad = readers.json_lines(spark, str(tmp_path / "r.jsonl"), "a int")
    assert (good.count(), bad.count()) == (2, 1)
    (tmp_path / "p.json").write_text('{"policies":[{"id":"x"},{"id":"y"}]}')
    assert readers.json_array(spark, str(tmp_path / "p.json"), "id:string", "policies").count() == 2
    out = writers.staged(spark.range(5), str(tmp_path / "t"))
    assert out.count() == 5 and writers.staged(spark.range(3), str(tmp_path / "t")).count() == 3

    def refuse(_):
        raise C.ContractError("no")

    with pytest.raises(C.ContractError):
        writers.staged(spark.range(9), str(tmp_path / "t"), refuse)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3
    documents = spark.createDataFrame([(1, '{"a":1}'), (2, '{"p":2}')], "id int, document string")
    assert writers.bundle(documents, "id", str(tmp_path / "b")).count() == 2
    with pytest.raises(C.ContractError):
        writers.bundle(documents, "id", str(tmp_path / "c"), '"p"')


def test_streams(spark, tmp_path):
    rows = [(1, dt.datetime(2024, 1, 1), "a", 1.0), (1, dt.datetime(2024, 1, 1), "a", 1.0), (2, dt.datetime(2024, 1, 9), "a", 2.0)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, event_type string, value double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("event_id long, ts timestamp, event_type string, value double").parquet(str(tmp_path / "in"))
    ST.into_table(ST.first_seen(stream, "event_id"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    q = ST.monthly_counts(stream, "event_type").writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("SELECT sum(n) FROM counts").first()[0] == 3


def test_permutation_keeps_columns_together(spark):
    rows = spark.createDataFrame([(i, i, i * 10) for i in range(200)], "k int, a int, b int")
    got = ML.permuted(rows, ["a", "b"], "k", 1).collect()
    assert sorted(r["a"] for r in got) == list(range(200)) and all(r["b"] == r["a"] * 10 for r in got) and any(r["a"] != r["k"] for r in got)
