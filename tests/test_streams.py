from pyspark.sql import functions as F

from tessera.operators.store import Store
from tessera.plans import model
from tessera.runtime import new_path
from tessera.streaming import ingest

SF = "/root/testdata/sf0.001"


def test_sweep_twice_adds_once(spark):
    rows = model.messages(spark, SF)
    path, store = new_path(spark, "messages"), Store(spark, new_path(spark, "store"))
    rows.repartition(2).write.parquet(path)
    for k in range(2):
        stream = ingest.message_stream(spark, path, rows.schema)
        ingest.sweep_into(stream, lambda d: store.add_drawers(d.select("id", "content", F.lit("sweep").alias("ingest_mode"))), new_path(spark, f"state{k}")).awaitTermination()
    want = rows.filter("role in ('user', 'assistant')").count()
    assert store.read("drawers").count() == want


def test_windowed_counts(spark):
    path = new_path(spark, "events")
    model.table(spark, SF, "events").write.parquet(path)
    stream = spark.readStream.schema(model.table(spark, SF, "events").schema).parquet(path)
    query = ingest.windowed_counts(stream, "1 day").writeStream.format("memory").queryName("w").outputMode("complete").option("checkpointLocation", new_path(spark, "w")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("w").agg(F.sum("n")).first()[0] == model.table(spark, SF, "events").count()


def test_save_triggers(spark):
    path = new_path(spark, "turns")
    spark.range(40).selectExpr("id % 2 as session", "id").repartition(3).write.parquet(path)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema("session long, id long").option("maxFilesPerTrigger", 1).parquet(path)
    query = ingest.save_triggers(stream, 5).writeStream.format("memory").queryName("s").option("checkpointLocation", new_path(spark, "s")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted((r.session, r.at) for r in spark.table("s").collect())
    assert got == [(k, n) for k in (0, 1) for n in (5, 10, 15, 20)]
