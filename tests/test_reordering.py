"""A shuffled and restarted stream gives the rows of the ordered replay."""

import random

import pytest
from pyspark.sql import functions as F
from test_operators import _session

from palaver.streaming import reordering, tagger

SCHEMA = "key string, update_no long, rollback int, words array<string>, at timestamp"


@pytest.fixture
def rocksdb(spark):
    before = spark.conf.get(reordering.STORE)
    reordering.use_rocksdb(spark)
    yield
    spark.conf.set(reordering.STORE, before)


def test_shuffled_stream_is_the_replay(spark, tmp_path, rocksdb):
    rng = random.Random(6)
    rows = [(k, n, 1 if n % 3 == 2 else 0, ["w" * (1 + (n * 5 + len(k)) % 4)], 1000 + 10 * n) for k in ("x", "yy") for n in range(12)]
    # an update arrives up to 25 seconds late; one file a batch
    arrived = sorted(rows, key=lambda r: r[4] + rng.uniform(0, 25))
    end = [("end", 0, 0, ["w"], 100_000)]
    df = lambda part: spark.createDataFrame(part, SCHEMA.replace("at timestamp", "s long")).select("key", "update_no", "rollback", "words", F.timestamp_seconds("s").alias("at"))
    files = [*(arrived[i : i + 6] for i in range(0, len(arrived), 6)), end, [("end", 1, 0, ["w"], 100_001)]]
    sink = str(tmp_path / "out")

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = reordering.tag_stream_in_order(stream, _session, "at", "30 seconds").writeStream.format("parquet").option("path", sink).option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start()
        try:
            assert query.awaitTermination(240)
        finally:
            query.stop()

    for i, part in enumerate(files):
        df(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if i in (1, len(files) - 1):  # stopped and begun again in between
            run()
    got = spark.read.parquet(sink).filter("key <> 'end'")
    want = tagger.replay(df(rows), _session)
    shown = lambda d: sorted(map(str, map(tuple, d.select(*tagger._COLUMNS).collect())))
    assert shown(got) == shown(want) and got.count() > 20
