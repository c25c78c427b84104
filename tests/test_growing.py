"""A stream of growing files: lines once each, over restarts, half lines and partitions that cut lines."""

import json

from pyspark.sql import functions as F

from palaver.sources import growing, readers
from palaver.streaming import tagger


def test_growing_files(spark, tmp_path):
    growing.register(spark)
    folder, out = tmp_path / "log", str(tmp_path / "out")
    folder.mkdir()

    def run():
        stream = spark.readStream.format("growing_lines").option("path", str(folder)).option("partition_bytes", "7").load()
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "ckpt")).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        return sorted(tuple(r) for r in spark.read.parquet(out).collect())

    (folder / "a.log").write_bytes("one\nzwei ü\n\nhalf a".encode())
    (folder / "_hidden").write_text("no\n")
    assert run() == [("a.log", 0, "one"), ("a.log", 4, "zwei ü"), ("a.log", 12, "")]
    with open(folder / "a.log", "ab") as f:
        f.write(b" line\r\nlast, not complete")
    (folder / "b.log").write_text("x" * 50 + "\n" + "y\n")
    want = [("a.log", 0, "one"), ("a.log", 4, "zwei ü"), ("a.log", 12, ""), ("a.log", 13, "half a line"), ("b.log", 0, "x" * 50), ("b.log", 51, "y")]
    assert run() == want
    assert run() == want
    table = spark.read.format("growing_lines").option("path", str(folder)).load()
    assert sorted(tuple(r) for r in table.collect()) == want
    (tmp_path / "none").mkdir()
    assert spark.read.format("growing_lines").option("path", str(tmp_path / "none")).load().count() == 0


def test_recogniser_messages(spark, tmp_path):
    """Messages of a live log, numbered by the overlap rule as those of a table."""
    growing.register(spark)
    stamps = [[["hello", 0.0, 0.4]], [["hello", 0.0, 0.4], ["there", 0.4, 0.9]], [["their", 0.4, 0.9]], [["now", 1.0, 1.2]]]
    text = [json.dumps({"result_index": 0, "results": [{"alternatives": [{"timestamps": t}]}]}) for t in stamps]
    (tmp_path / "call.log").write_text("\n".join(text) + "\n")
    live = spark.read.format("growing_lines").option("path", str(tmp_path)).load().select(F.col("file").alias("user_id"), F.col("position").alias("n"), "value")
    table = spark.createDataFrame([("call.log", sum(len(t) + 1 for t in text[:i]), t) for i, t in enumerate(text)], "user_id string, n long, value string")
    ids = lambda df: [tuple(r) for r in tagger.hypothesis_ids(readers.asr_messages(df, key=["user_id", "n"]), "user_id", "n").collect()]
    assert ids(live) == ids(table) and ids(live)[0][1] == 5
