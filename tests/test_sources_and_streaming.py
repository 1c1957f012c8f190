from datetime import datetime

import __spark_entry__ as entry
from quillrank.sources import current_rows, stage_table
from quillrank.streaming import ingest


def test_current_rows(spark):
    t = [datetime(2024, 1, d) for d in range(1, 5)]
    df = spark.createDataFrame([(1, "old", t[0]), (1, "new", t[2]), (1, "new", t[1]), (2, "only", None), (None, "lost", t[0])], "id int, x string, ingested_at timestamp")
    assert sorted(tuple(r) for r in current_rows(df, "id").collect()) == [(1, "new"), (2, "only")]
    assert current_rows(df.limit(0), "id").count() == 0
    assert current_rows(df.drop("ingested_at"), "id").count() == 4


def test_stage_table_starts_a_new_plan(spark):
    staged = stage_table(spark.range(10).selectExpr("id", "id % 3 as k"))
    assert staged.count() == 10 and "Range" not in staged._jdf.queryExecution().executedPlan().toString()


def test_stream_of_documents(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "id long, tokens array<string>, at timestamp"
    spark.createDataFrame([(1, ["a", "b"], datetime(2024, 1, 1)), (2, None, datetime(2024, 1, 1))], schema).write.parquet(source)
    stream = lambda: spark.readStream.schema(schema).parquet(source)
    ingest.start(stream(), folder, str(tmp_path / "cp")).awaitTermination()
    spark.createDataFrame([(3, ["c"], datetime(2024, 1, 2)), (1, ["z", "z", "z"], datetime(2024, 1, 3))], schema).write.mode("append").parquet(source)
    ingest.start(stream(), folder, str(tmp_path / "cp")).awaitTermination()
    assert {r.id: r.tokens for r in ingest.rows(spark, folder).collect()} == {1: ["z", "z", "z"], 2: None, 3: ["c"]}
    s = ingest.statistics(spark, folder).first()
    assert (s.n, s.avgdl) == (2, 2.0)  # the update of 1 takes the place of its first state
    q = ingest.arrivals(stream(), "at").writeStream.format("memory").queryName("arrivals").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.documents for r in spark.table("arrivals").collect()) == [1, 1, 2]


def test_entry_contract():
    names, sql = entry.queries(), entry.oracle_sql()
    assert names and set(sql) <= set(names)
