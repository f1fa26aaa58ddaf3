from chronoweave.streaming.clean_stream import clean_stream
from tests.helpers import ts


def test_stream_matches_batch(spark, tmp_path):
    rows = [(ts(0), -327.679993), (ts(0), 50.0), (ts(10), -327.679993), (ts(20), 1.0)]
    src = tmp_path / "in"
    spark.createDataFrame(rows, "Timestamp timestamp_ntz, `MG-LV-MSB_Frequency` double").write.parquet(str(src))
    stream = spark.readStream.schema("Timestamp timestamp_ntz, `MG-LV-MSB_Frequency` double").parquet(str(src))
    q = (clean_stream(stream, watermark="10 minutes").writeStream.format("memory").queryName("cw_stream").outputMode("update")
         .option("checkpointLocation", str(tmp_path / "ck")).start())
    q.processAllAvailable()
    q.stop()
    got = {r.Timestamp: r["MG-LV-MSB_Frequency"] for r in spark.table("cw_stream").collect()}
    assert got[ts(10)] is None and got[ts(20)] == 1.0
    assert abs(got[ts(0)] - (50.0 - 327.679993) / 2) < 1e-9
