import corpus_pipeline
from tallymark.llm import queries


def test_stages_shrink_and_keep_columns(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    # the table's own contaminated documents are few and fail the quality rules, so some that pass them are added
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() if len(r.text.split()) >= 12]
    prose = [r.text for r in docs.where("lang = 'en' AND n_chars BETWEEN 1000 AND 4000").orderBy("doc_id").collect()]
    planted = [(10**9 + i, f"{prose[i][:700]} {items[i]} {prose[-1 - i][:700]}", "en", "planted", 0) for i in range(8)]
    docs = docs.union(spark.createDataFrame(planted, docs.schema)).coalesce(4)
    columns, before, counts, there = docs.columns, docs.count(), [], []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        counts.append(docs.count())
        there.append(docs.where(f"doc_id >= {10**9}").count())
        if name != "sharding":
            assert docs.columns == columns
    assert before > counts[0] > counts[1] > counts[2] and counts[3] == counts[4] > 0
    assert there[1] > 0 and there[2:] == [0, 0, 0]
    assert docs.columns == [*columns, "size", "shard", "slot"]


def test_odd_tables_pass_through(spark, sf, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, size string, w int"
    rows = [(1, None, None, None, None, "a", 1), (None, "", "en", "s", 0, None, None), (3, "word " * 300, "en", "s", 1500, "b", 2)]
    for k, docs in enumerate((spark.createDataFrame(rows, schema), spark.createDataFrame([], schema))):
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, docs, sf).write.parquet(f"{tmp_path}/{k}/{name}")
            docs = spark.read.parquet(f"{tmp_path}/{k}/{name}")
    assert docs.count() == 0


def test_one_query_for_each_operator():
    assert sorted(int(q[2:].split("_")[0]) for q in queries.queries()) == list(range(1, 11))
    assert set(queries.oracle_sql()) <= set(queries.queries())
