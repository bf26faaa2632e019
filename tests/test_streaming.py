from pyspark.sql import functions as F

from ebbflow.sources import lake
from ebbflow.streaming import bars


def test_windows_and_sessions_of_a_stream(spark, tmp_path):
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 3).alias("ticker"), "value")
    src = str(tmp_path / "in")
    ev.repartition(2).write.parquet(src)
    stream = spark.readStream.schema(ev.schema).parquet(src)
    for k, df in enumerate((bars.windowed(stream), bars.sessions(stream))):
        q = df.writeStream.format("memory").queryName(f"out{k}").outputMode("append").option("checkpointLocation", str(tmp_path / f"c{k}")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert spark.table(f"out{k}").count() > 0


def test_a_later_batch_replaces_a_bar(spark, tmp_path):
    kind = "ticker string, t long, o double, h double, l double, c double, v double, vw double"
    src, path, ck = (str(tmp_path / n) for n in ("in", "lake", "ck"))
    for c in (1.0, 2.0):
        spark.createDataFrame([("A", 0, c, c, c, c, 1.0, c)], kind).coalesce(1).write.mode("append").parquet(src)
        bars.upsert(spark.readStream.schema(kind).parquet(src), path, "1d", ck).start().awaitTermination(120)
    assert [r.c for r in lake.read(spark, path, "1d", 0, 10).collect()] == [2.0]
