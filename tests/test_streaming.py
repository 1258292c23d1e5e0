"""The stream's closed days equal a batch over the same rows."""

import datetime

from arborspark.streaming import access

KIND = "ts timestamp, path string, op string, request_id string, bytes_out long, bytes_in long"


def test_daily_ops(spark, tmp_path):
    day = lambda d, h=0: datetime.datetime(2026, 7, d, h)
    rows = [(day(1), "a/b", "GET", "r1", 5, 1), (day(1, 2), "a/b", "GET", "r1", 5, 1), (day(1, 3), "a//c/", "GET", "r2", 7, 0), (day(2), None, "LIST", "r3", 1, 0)]
    spark.createDataFrame(rows, KIND).coalesce(1).write.parquet(f"{tmp_path}/in/1")
    spark.createDataFrame([(day(20), "z", "GET", "r9", 1, 1)], KIND).coalesce(1).write.parquet(f"{tmp_path}/in/2")
    stream = spark.readStream.schema(KIND).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = access.to_parquet(access.daily_ops(stream), f"{tmp_path}/out", f"{tmp_path}/cp")
    query.awaitTermination()
    got = {(r.day.day, r.path, r.op): (r.n_ops, r.bytes_out, r.bytes_in) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {
        (1, ".", "GET"): (2, 12, 1), (1, "a", "GET"): (2, 12, 1), (1, "a/b", "GET"): (1, 5, 1), (1, "a/c", "GET"): (1, 7, 0), (2, ".", "LIST"): (1, 1, 0),
    }


def test_ingest_csv(spark, tmp_path):
    head = "time_micros,c_ip,c_ip_type,c_ip_region,cs_method,cs_uri,sc_status,cs_bytes,sc_bytes,time_taken_micros,cs_host,cs_referer,cs_user_agent,s_request_id,cs_operation,cs_bucket,cs_object"
    line = '"1000000","1.1.1.1","1","","GET","/b/o","200","0","9","5","h","","ua","r1","","b","a/o"'
    (tmp_path / "in").mkdir()
    (tmp_path / "in/one.csv").write_text(f"{head}\n{line}\n{line}\n")
    access.ingest(access.read_raw(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert [(r.path, r.op, r.bytes_out) for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [("a/o", "GET", 9)]
