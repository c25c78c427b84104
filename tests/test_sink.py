"""The sink of revocable rows: a query that dies between batches and is started again leaves what the replay gives."""

import pytest
from test_operators import _session

from palaver.streaming import sink, tagger

SCHEMA = "key string, update_no long, rollback int, words array<string>"


def test_restarts_and_compactions(spark, tmp_path, monkeypatch):
    rows = [(k, n, 1 if n % 3 == 2 else 0, ["w" * (1 + (n * 5 + len(k)) % 4)]) for k in ("x", "yy") for n in range(16)] + [("x", 16, 50, ["w"])]
    at, checkpoint = str(tmp_path / "rows"), str(tmp_path / "ckpt")
    for part in range(6):
        spark.createDataFrame([r for r in rows if r[1] // 3 == part], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run(fails_after=None):
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        drop = sink._numbers
        if fails_after is not None:  # the batch's rows are written, and then the query dies before it is committed
            def dying(session, path):
                found = drop(session, path)
                if path.endswith(sink.BATCHES) and fails_after in found:
                    raise RuntimeError("killed")
                return found

            monkeypatch.setattr(sink, "_numbers", dying)
        query = sink.write_rows(tagger.tag_stream(stream, _session), at, checkpoint, every=2).trigger(availableNow=True).start()
        try:
            if fails_after is None:
                assert query.awaitTermination(120)
            else:
                with pytest.raises(Exception, match="killed"):
                    query.awaitTermination(120)
        finally:
            query.stop()
            monkeypatch.setattr(sink, "_numbers", drop)

    run(fails_after=1)
    assert sink._numbers(spark, f"{at}/{sink.BATCHES}") == [0, 1] and not sink._numbers(spark, f"{at}/{sink.COMPACTED}")
    run(fails_after=3)
    run()
    want = tagger.replay(spark.createDataFrame(rows, SCHEMA), _session)
    shown = lambda df: sorted(map(str, map(tuple, df.collect())))
    assert shown(sink.read_standing(spark, at)) == shown(tagger.final_view(want))
    kept = sink.read_rows(spark, at)
    assert kept.count() == kept.distinct().count() < want.count()
    assert [r["version"] for r in tagger.faults(kept).collect()] == [16]
    assert sink._numbers(spark, f"{at}/{sink.COMPACTED}") == [3, 5] and min(sink._numbers(spark, f"{at}/{sink.BATCHES}")) > 1
    assert shown(tagger.final_view(sink.without_superseded(want))) == shown(tagger.final_view(want))
    assert sink.read_standing(spark, str(tmp_path / "nothing")).count() == 0
