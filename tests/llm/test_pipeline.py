import random

import corpus_pipeline
from tidemark.llm import scratch

PARTS = {"aa": ["the", "ing", "on", "er", "and"], "bb": ["der", "sch", "ung", "lich", "ein"]}


def corpus():
    rng = random.Random(6)
    say = lambda lang, n: " ".join("".join(rng.choice(PARTS[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))
    item = say("aa", 14)
    rows = [(i, say("aa" if i % 3 else "bb", rng.randint(30, 90)), "aa" if i % 3 else "bb", f"s{i % 4}") for i in range(120)]
    clean = {r[0] for r in rows}
    near = [(200 + i, rows[i][1] + " theer", rows[i][2], "s1") for i in range(20)] + [(300 + i, rows[5][1], "aa", "s2") for i in range(30)]
    dirty = [(400 + i, say("aa", 30) + " " + item + " " + say("aa", 30), "aa", "s3") for i in range(6)]
    letterless = [(500, "12 34", "aa", "s0"), (501, None, None, None), (502, "", "bb", "s1")]
    return rows + near + dirty + letterless, clean, [(1, item), (2, None)]


def test_what_each_stage_keeps(spark, tmp_path):
    rows, clean, items = corpus()
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    left = {r[0] for r in rows}
    for (name, stage), gone in zip(corpus_pipeline.STAGES[:3], ({500, 501, 502}, set(range(200, 220)) | set(range(300, 330)), set(range(400, 406))), strict=True):
        out = scratch.table(stage(spark, docs, str(tmp_path)), "test")
        assert out.columns == docs.columns
        left -= gone
        assert sorted(r["doc_id"] for r in out.select("doc_id").collect()) == sorted(left), name
        docs = out
    assert left == clean
    size = sum(len(r["text"].split()) for r in docs.collect())
    mix = scratch.table(corpus_pipeline.STAGES[3][1](spark, docs, str(tmp_path)), "test")
    assert mix.columns == docs.columns and abs(sum(len(r["text"].split()) for r in mix.collect()) - 1.5 * size) < 0.1 * size
    shards = corpus_pipeline.STAGES[4][1](spark, mix, str(tmp_path))
    assert shards.count() == mix.count() and {"shard", "slot"} <= set(shards.columns)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == mix.count()


def test_no_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_extra_columns_of_clashing_names_and_very_long_texts(spark, tmp_path):
    rows, _, items = corpus()
    long = " ".join(f"the{'ing' * (i % 7)} on{'er' * (i % 11)}and" for i in range(60_000))
    made = [(*r, len(r[1] or ""), 1.5, "x", 3, "y", 7) for r in [*rows, (900, long, "aa", "s1"), (901, long + " onthe", "aa", "s2"), (None, "the ing on er and the the", "aa", None)]]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string, size long, node string, target int"
    spark.createDataFrame(made, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = scratch.table(stage(spark, docs, str(tmp_path)), "test")
        assert out.columns == docs.columns, name
        docs = out
        ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert (900 in ids) and (901 in ids) == (name == "language ID"), name
    first = docs.filter("doc_id = 900").first()
    assert first["text"] == long and (first["score"], first["lang_pred"], first["size"], first["node"], first["target"]) == (1.5, "x", 3, "y", 7)
    assert {"shard", "slot"} <= set(corpus_pipeline.STAGES[4][1](spark, docs, str(tmp_path)).columns)
