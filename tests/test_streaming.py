import os

from pyspark.sql import functions as F

from millrace.streaming import events


def test_windows_on_a_stream_equal_those_on_the_table(spark, sf, tmp_path):
    table = spark.read.parquet(os.path.join(sf, "events.parquet"))
    table.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    q = events.event_windows(stream, late="100 days").writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.start, r.event_type): r.n for r in spark.table("windows").collect()}
    assert got == {(r.start, r.event_type): r.n for r in events.event_windows(table.withColumn("ts", F.col("ts").cast("timestamp"))).collect()}


def test_gate_keeps_first_across_batches(spark, tmp_path):
    for k, texts in enumerate((["a", "b", "a"], ["b", "c"])):
        spark.createDataFrame([(10 * k + i, t) for i, t in enumerate(texts)], "id long, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("id long, text string").parquet(str(tmp_path / "in"))
        events.gate_batches(stream, "text", "id", str(tmp_path / "state"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 1, 11]


def test_distinct_texts_and_sessions(spark, sf):
    table = spark.read.parquet(os.path.join(sf, "events.parquet"))
    assert events.distinct_texts(table, "event_type", "ts").count() == table.select("event_type").distinct().count()
    assert events.sessions(table).agg(F.sum("n")).first()[0] == table.count()
