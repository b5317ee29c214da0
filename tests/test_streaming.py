import datetime


from weftgraph.operators import triangles
from weftgraph.streaming import edges as streaming


def test_edges_arrive(spark, tmp_path):
    source, table = f"{tmp_path}/in", f"{tmp_path}/edges"
    for k, rows in enumerate([[(1, 2), (2, 3)], [(3, 1), (2, 1), (4, 4)], [(3, 4), (1, 4)]]):
        spark.createDataFrame(rows, "src long, dst long").coalesce(1).write.mode("append").parquet(source)
        streaming.append_edges(streaming.edge_stream(spark, source, 1), table, f"{tmp_path}/at").awaitTermination()
        count = triangles.triangle_count(spark.read.parquet(table)).first()[0]
        assert count == [0, 1, 2][k]
    assert spark.read.parquet(table).count() == 10


def test_windows(spark, tmp_path):
    at = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    rows = [(1, 2, at(0)), (1, 3, at(4)), (1, 2, at(6)), (5, 5, at(7))]
    spark.createDataFrame(rows, "src long, dst long, ts timestamp").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("src long, dst long, ts timestamp").parquet(f"{tmp_path}/in")
    q = streaming.windowed_degrees(stream, "ts", "5 minutes", "1 minute").writeStream.outputMode("complete").format("memory").queryName("degrees").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r["m"], r["id"]): r["degree"] for r in spark.sql("SELECT minute(window.start) AS m, id, degree FROM degrees").collect()}
    assert got == {(0, 1): 2, (0, 2): 1, (0, 3): 1, (5, 1): 1, (5, 2): 1}
