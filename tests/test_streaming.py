"""The same windows over a stream as over a table."""

from siltstone.streaming import events

SF = "/root/testdata/sf0.001"


def test_stream_matches_batch(spark, tmp_path):
    table = spark.read.parquet(f"{SF}/events.parquet")
    table.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 10).parquet(f"{tmp_path}/in")
    q = events.tumbling(stream).writeStream.outputMode("complete").format("memory").queryName("tumbling").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(str, spark.table("tumbling").collect())) == sorted(map(str, events.tumbling(table).collect()))
