"""The words that all queries stand on, over a table with repeated turns, null roles and null texts, against their SQL."""

from oracle import check, connect
from pyspark.sql import functions as F

from palaver.queries.base import TAGGED, WORDS, sql, tagged, words

ROWS = [(1, 0, "user", "a b, c"), (1, 0, "user", "a b, c"), (1, 0, "user", "d"), (1, 0, "assistant", "e f"), (1, 1, None, "g  h"), (1, 2, None, None), (1, 3, "user", "  ? "), (1, 4, "user", "i i"), (2, 0, None, ""), (None, 0, "user", "x"), (3, 5, "user", "ü Ö")]


def test_words_of_repeated_turns(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string").withColumn("n", F.lit("clash"))
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    con = connect("/root/testdata/sf0.001")
    con.execute(f"CREATE OR REPLACE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    got = words(spark, str(tmp_path))
    check(got, con, sql(WORDS, "SELECT * FROM words"))
    assert got.count() == 3 + 3 + 1 + 2 + 2 + 2 + 2
    assert sorted(r["pos"] for r in got.filter("conv_id = 1 and speaker = 'user'").collect()) == [0, 0, 0, 1, 1, 2, 2, 7, 8]
    assert tagged(spark, str(tmp_path)).count() == got.count()
    con.execute("CREATE OR REPLACE VIEW conversations AS SELECT * FROM '/root/testdata/sf0.001/conversations.parquet'")
    check(tagged(spark, "/root/testdata/sf0.001"), con, sql(TAGGED, "SELECT * FROM tagged"))
