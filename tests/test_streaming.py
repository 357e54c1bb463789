from pyspark.sql import functions as F

from codexmill.operators.incremental import Ledger
from codexmill.streaming import ingest
from tests.test_sources import epub


def test_files_come_in_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    page = "<p>" + "Some words about channels and buffers. " * 10 + "</p>"
    (tmp_path / "in/a.epub").write_bytes(epub(a=page, b=page))
    ingest.ingest_files(spark, f"{tmp_path}/in", f"{tmp_path}/out")
    n = spark.read.parquet(f"{tmp_path}/out/chunks").count()
    ingest.ingest_files(spark, f"{tmp_path}/in", f"{tmp_path}/out")
    assert n and spark.read.parquet(f"{tmp_path}/out/chunks").count() == n
    (tmp_path / "in/b.epub").write_bytes(epub(a=page, b=page))
    ingest.ingest_files(spark, f"{tmp_path}/in", f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out/chunks").count() == 2 * n
    assert spark.read.parquet(f"{tmp_path}/out/postings").where("term = 'channels'").count() == 2 * n


def test_rows_are_processed_once(spark, tmp_path):
    source, root = f"{tmp_path}/rows", f"file://{tmp_path}/led"
    df = spark.range(5).select(F.col("id").alias("seq"), F.lit("x").alias("v"))
    df.write.parquet(source)
    ingest.ingest_rows(spark, source, df.schema, Ledger(spark, root), lambda d: d)
    df.unionAll(spark.createDataFrame([(9, "y")], df.schema)).write.mode("append").parquet(source)
    ingest.ingest_rows(spark, source, df.schema, Ledger(spark, root), lambda d: d)
    done = Ledger(spark, root)
    assert done.done == [(0, 4), (9, 9)] and done.output().count() == 6


def test_sessions_batch_equals_stream(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet")
    batch = {(r.user_id, r.begin, r.events) for r in ingest.sessions(events, "user_id", "ts", "4 hours").collect()}
    (tmp_path / "ev").mkdir()
    events.coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/ev")
    stream = ingest.sessions(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/ev"), "user_id", "ts", "4 hours")
    q = stream.writeStream.format("memory").queryName("s").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.user_id, r.begin, r.events) for r in spark.table("s").collect()} == batch
