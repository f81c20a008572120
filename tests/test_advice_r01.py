"""Cases of the review's first round, each one wrong before its change."""

from pyspark.sql import functions as F

from tessera.streaming import incremental


def test_stream_drops_documents_of_the_ledger(spark, tmp_path):
    schema, seen = "doc_id int, path string, mtime long, size long", []

    def land(rows, run):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(str(tmp_path / "in"))
        check = lambda d: d.select("doc_id", F.col("size").alias("found"))
        seen.clear()
        on_batch = lambda found, n: seen.extend(r.doc_id for r in found.collect())
        incremental.checked_stream(spark, str(tmp_path / "in"), schema, check, str(tmp_path / "out"), ["doc_id"], str(tmp_path / run), on_batch, str(tmp_path / "ledger")).start().awaitTermination(60)
        return sorted(seen)

    assert land([(1, "a", 5, 10), (2, "b", 5, 20)], "r1") == [1, 2]
    assert land([(1, "a", 5, 10), (2, "b", 6, 21), (3, "c", 5, 30)], "r1") == [2, 3]
    assert land([(4, "d", 5, 40)], "r2") == [4]  # a new checkpoint reads all files again
    assert sorted((r.doc_id, r.found) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, 10), (2, 21), (3, 30), (4, 40)]
