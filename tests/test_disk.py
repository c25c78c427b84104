"""What queries shuffle for a word: joins are not broadcast, as those of large tables are not."""

import pytest

from palaver.queries import QUERIES

SF = "/root/testdata/sf0.001"


def _shuffled(spark, query):
    written = lambda: sum(spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(k).totalShuffleWrite() for k in range(1))
    before = written()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        QUERIES[query](spark, SF).write.format("noop").mode("overwrite").save()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    return (written() - before) / 1e6


@pytest.mark.parametrize(("query", "megabytes"), [("excision_features", 5.0), ("language_model_features", 5.0)])
def test_words_are_shuffled_as_narrow_rows(spark, query, megabytes):
    shuffled = _shuffled(spark, query)
    assert 0 < shuffled < megabytes
