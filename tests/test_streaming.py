"""The row-local steps give the same rows on a stream as on a batch."""

from tesserae.streaming import place_instances

SCHEMA = "inst_id long, tile_row int, tile_col int, n_h int, n_w int, tile_x long, tile_y long, tile_x2 long, tile_y2 long, scale double, cx double, cy double, ring array<struct<x:double,y:double>>"


def test_stream_equals_batch(spark, tmp_path):
    rows = [(k, 1, 1, 3, 3, 512, 512, 1024, 1024, 1.0, float(k * 7), 100.0, [{"x": float(k * 7), "y": 90.0}, {"x": float(k * 7 + 9), "y": 110.0}]) for k in range(70)]
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(str(tmp_path / "in"))
    batch = place_instances(spark.read.parquet(str(tmp_path / "in")))
    stream = place_instances(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("placed").start()
    q.processAllAvailable()
    q.stop()
    want = sorted(r["inst_id"] for r in batch.collect())
    assert want and sorted(r["inst_id"] for r in spark.table("placed").collect()) == want
