"""What shows on large tables only, brought about on small ones by many partitions."""

import contextlib
import math
import random
import time

from pyspark.sql import functions as F

from palaver.llm import chats
from palaver.operators import alignment, joins, networks, repairs
from palaver.operators import language_model as lm
from palaver.operators import sequences as seq
from palaver.queries import QUERIES
from palaver.queries.base import words
from palaver.queries.live import make_session
from palaver.sources import readers, writers
from palaver.streaming import tagger

SF = "/root/testdata/sf0.001"


@contextlib.contextmanager
def many_partitions(spark):
    """Small shuffles keep their partitions, as those of large tables do."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        yield
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_updates_of_a_speaker_stand_in_one_file(spark):
    with many_partitions(spark):
        assert {r["format"]: r["n_new"] for r in QUERIES["format_round_trips"](spark, SF).collect()} == dict.fromkeys(("detection", "timed", "increco", "easy"), 0)


def test_ranks_do_not_depend_on_how_ranges_are_cut(spark):
    rows = spark.range(60_000).select(F.col("id").alias("key"), F.md5(F.col("id").cast("string")).alias("text"))
    with many_partitions(spark):
        placed = seq.seeded_order(rows, "key", 3)
        places = [r["place"] for r in placed.orderBy(F.md5(F.concat(F.lit("3:"), F.col("key").cast("string")))).select("place").collect()]
    assert places == list(range(60_000))


def test_means_over_intervals_without_pairs(spark):
    """Half a million points at ten places, under a thousand intervals that hold most of them: 400 million pairs."""
    points = spark.range(500_000).select(F.lit(1).alias("c"), (F.col("id") % 10 * 7).alias("at"), (F.col("id") % 100 / 4).alias("value"))
    points = points.unionByName(spark.createDataFrame([(1, 101, float("nan")), (1, 201, 1e300), (1, 301, 1e-9), (1, 401, None), (2, 5, 1.0)], "c int, at long, value double"))
    intervals = spark.range(1000).select(F.lit(1).alias("c"), F.col("id").alias("k"), (F.col("id") % 7 - 1).alias("start_ms"), (F.col("id") % 50 + 50).alias("end_ms"))
    more = [(1, 2000, 100, 101), (1, 2001, 200, 201), (1, 2002, 300, 301), (1, 2003, 400, 401), (1, 2004, 5, 5), (3, 2005, 0, 90), (1, 2006, 14, 21), (1, 2006, 14, 21), (None, 2007, 0, 90)]
    intervals = intervals.unionByName(spark.createDataFrame(more, "c int, k long, start_ms long, end_ms long"))
    began = time.time()
    got = {r["k"]: (r["mean_value"], r["n_points"]) for r in joins.mean_over(points, intervals, ["c"], ["c", "k"], "at", "value", 10).collect()}
    assert time.time() - began < 60
    by_place = {7 * i: [v / 4 for v in range(i, 100, 10)] for i in range(10)}
    for k in range(1000):
        held = [v for at, values in by_place.items() if k % 7 - 1 < at <= k % 50 + 50 for v in values]
        assert got[k] == (sum(held) / len(held), len(held) * 5000)
    assert math.isnan(got[2000][0]) and got[2000][1] == 1
    assert [got[k] for k in range(2001, 2008)] == [(1e300, 1), (1e-9, 1), (None, 0), (None, 0), (None, 0), (sum(by_place[21]) / 10, 100_000), (None, 0)]


def test_folds_are_not_counted_in_all_others(spark):
    """What is kept for ten folds grows with the n-grams, not with n-grams times folds."""
    rows = spark.range(400).select("id", F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: F.concat(F.lit("w"), (F.col("id") * 7 + i).cast("string"))).alias("tokens"))
    kept = []
    scored = lm.cross_validated(rows, "id", 10, keep=lambda df: kept.append(df.count()) or df)
    assert scored.select("fold").distinct().count() == 10
    assert sum(kept) <= 3 * 400 * 6


def test_feature_rows_of_one_speaker_are_written_by_many_tasks(spark, tmp_path):
    writers.matrices(spark.range(0, 8000, 1, 8).select(F.lit("a").alias("speaker"), F.array(F.col("id").cast("double")).alias("features")), str(tmp_path / "m"))
    assert len(list((tmp_path / "m" / "speaker=a").glob("*.parquet"))) == 8
    assert spark.read.parquet(str(tmp_path / "m")).count() == 8000


def test_chat_examples_have_one_form_at_any_size(spark):
    """A short conversation and one whose whole examples come to over 8 Mi characters."""
    conversations = spark.range(200).select((F.col("id") >= 4).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.repeat(F.lit("x"), 2000).alias("text"))
    examples = chats.expand_prefix_targets(conversations)
    assert [r["inline"] for r in examples.select("inline").distinct().collect()] == [False]
    digests = [sorted(map(tuple, chats.digest(chats.expand_prefix_targets(conversations, n)).collect())) for n in (0, 100_000, None)]
    assert digests[0] == digests[1] == digests[2]


def test_fluency_tags_of_a_long_utterance(spark, tmp_path):
    """A turn of twenty thousand words with a repair onset every fourth one: two hundred million pairs of words."""
    said = [f"a{i // 4}" if i % 4 < 2 else f"b{i}" for i in range(20_000)]
    spark.createDataFrame([(7, 0, "user", " ".join(said))], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    began = time.time()
    got = {r["idx"]: r["source_tag"] for r in QUERIES["source_model_tags"](spark, str(tmp_path)).collect()}
    assert time.time() - began < 60
    assert got == {i: "<e/>" if i % 4 == 0 else "<f/>" for i in range(20_000)}


def test_a_session_works_out_each_transition_once(spark):
    session, calls = make_session(), []
    state_of = session.lattice.state_of
    session.lattice.state_of = lambda *at: calls.append(at) or state_of(*at)
    for i in range(500):
        session.add(["ab", "abc", "abc", "b"][i % 4 : i % 4 + 1])
    assert session.length == 500 and len(calls) == len(set(calls))


def test_final_view_sorts_once(spark):
    rows = [("a", v, 0, n, i, w, t, f) for v, n, i, w, t, f in ((0, 2, 0, "x", "p", None), (0, 2, 1, "y", "q", None), (1, 1, 0, "z", "r", None), (2, 1, None, None, None, None), (3, 9, None, None, None, "fault"))]
    found = tagger.final_view(spark.createDataFrame(rows, tagger.OUTPUT.replace("long", "bigint")))
    assert [tuple(r) for r in found.collect()] == [("a", 0, 0, "z", "r")]
    assert "Aggregate" not in found._jdf.queryExecution().executedPlan().toString()


def test_word_vectors_are_trained_by_many_tasks(spark):
    """4,000 words, a thousand a task: the stages behind the deal of the sentences have four tasks, and all words have a vector."""
    rows = spark.range(400).select(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.concat(F.lit("w"), ((F.col("id") + i) % 50).cast("string"))).alias("tokens"))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("vectors", "word vectors")
    try:
        found = networks.word_vectors(rows, size=5, task_words=1000).collect()
        last = max(s for j in tracker.getJobIdsForGroup("vectors") for s in tracker.getJobInfo(j).stageIds if tracker.getStageInfo(s) and "Word2Vec" in tracker.getStageInfo(s).name and tracker.getStageInfo(s).numTasks == 4)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert last and sorted(r["word"] for r in found) == sorted(f"w{i}" for i in range(50))
    assert all(len(r["vector"]) == 5 for r in found)


def test_prefixes_are_not_shuffled_as_texts(spark):
    """Two lines of 2,000 tokens, equal up to the 1,000th: 3,000 prefixes of 30 million characters together, and the operators that shuffle see 32 characters of each."""
    line = lambda tail: F.transform(F.sequence(F.lit(1), F.lit(2000)), lambda i: F.concat(F.lit("token"), (i + F.when(i > 1000, tail).otherwise(0)).cast("string")))
    rows = spark.range(2).select(line(F.col("id") * 5000).alias("line")).unionByName(spark.createDataFrame([(["token1"],), ([],), (["token1", "token2", "b c"],)], "line array<string>"))
    found = seq.prefix_counts(rows)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(prefix" not in plan and "hashpartitioning(concat_ws" not in plan
    got = {r["prefix"]: r["n_prefixes"] for r in found.collect()}
    said = [[f"token{i + (5000 * k if i > 1000 else 0)}" for i in range(1, 2001)] for k in range(2)] + [["token1"], ["token1", "token2", "b c"]]
    want = {}
    for s in said:
        for k in range(1, len(s) + 1):
            want[" ".join(s[:k])] = want.get(" ".join(s[:k]), 0) + 1
    assert got == want


def test_runs_of_zero_length_words_are_shared_out_after_one_sort(spark):
    """Three lines over several batches, with runs that go on from batch to batch, against plain Python; the plan sorts once."""
    n = lambda m: F.pmod(F.xxhash64("id", F.lit(m)), F.lit(m))
    rows = spark.range(60_000).select((F.col("id") % 3).alias("c"), F.col("id").alias("pos"), F.lit("x").alias("word"), (F.col("id") * 10).alias("start_ms"), (F.col("id") * 10 + F.when((F.col("id") % 3 == 2) | (n(4) > 0) | (F.col("id") > 59_990), 0).otherwise(n(50) + 1)).alias("end_ms"))
    rows = rows.unionByName(spark.createDataFrame([(4, 0, "x", None, None), (4, 1, "x", 5, 9), (5, 0, "x", None, 3), (None, 1, "x", 1, 1), (None, 2, "x", 1, 8)], "c long, pos long, word string, start_ms long, end_ms long"))
    found = seq.spread_equal_times(rows, ["c"], ["pos"])
    assert [f.name for f in found.schema] == rows.columns
    got = {(r["c"], r["pos"]): (r["start_ms"], r["end_ms"]) for r in found.collect()}
    assert found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Sort [") == 1
    lines, want = {}, {(4, 0): (5, 7), (4, 1): (7, 9), (5, 0): (None, None), (None, 1): (1, 4), (None, 2): (4, 8)}
    for r in rows.filter("c < 4").orderBy("c", "pos").collect():
        lines.setdefault(r["c"], []).append(r)
    for c, line in lines.items():
        run = []
        for i, r in enumerate(line):
            run.append(r)
            if r["end_ms"] > r["start_ms"] or i == len(line) - 1:
                a, b = min(x["start_ms"] for x in run), max(x["end_ms"] for x in run)
                at = lambda j: a + j * (b - a) // len(run) if r["end_ms"] > r["start_ms"] else a + j * 300  # noqa: B023, E731
                want |= {(c, x["pos"]): (at(j), at(j + 1)) for j, x in enumerate(run)}
                run = []
    assert got == want


def test_first_alignments_of_many_pairs_at_once(monkeypatch):
    r = random.Random(5)
    side = lambda v: [r.choice("abCcDefgH"[: v + 1]) for _ in range(r.choice((0, 1, 2, 5, 12, 30)))]
    pairs = [(side(v), side(v)) for v in (1, 2, 3, 8) * 200]
    monkeypatch.setattr(alignment, "CELLS", 5000)
    for (source, goal), found in zip(pairs, alignment.first_alignments(pairs)):
        want = [-1] * len(goal)
        for i, j, op, _ in alignment.best_alignments(source, goal)[0]:
            if op in ("ID", "S_ARB"):
                want[j] = i
        assert found.tolist() == want


def test_error_rates_of_long_lines():
    """Sixty thousand tokens a side: 3.6 billion cells."""
    r = random.Random(7)
    a = [str(r.random() < 0.1) for _ in range(60_000)]
    began = time.time()
    assert alignment.token_distance(a, a[:100] + a[107:] + ["x"] * 3) in range(7, 11)
    assert time.time() - began < 15


def test_words_are_not_repeated_for_their_frames(spark):
    words = spark.createDataFrame([("a", 0, 0.03), ("a", 1, 0.07), ("b", 0, 0.5), ("a", 2, 0.071)], "speaker string, pos int, end double")
    frames = spark.createDataFrame([("a", f, float(f)) for f in (0, 2, 3, 5, 6, 7, 8)] + [("a", 4, None)], "speaker string, frame int, intensity double")
    found = readers.frame_window(words, frames, "intensity", ["speaker"], 5)
    assert "sequence(" not in found.select("pos")._jdf.queryExecution().optimizedPlan().toString()
    got = {(r["speaker"], r["pos"]): r["intensity_window"] for r in found.collect()}
    assert got == {("a", 0): [0.0, 0.0, 0.0, 2.0, 3.0], ("a", 1): [3.0, 0.0, 5.0, 6.0, 7.0], ("b", 0): [0.0] * 5, ("a", 2): [3.0, 0.0, 5.0, 6.0, 7.0]}


def test_lines_are_not_sorted_for_their_headers(spark, tmp_path):
    (tmp_path / "g").write_text("".join(f"name = t{i}\n" + "x\n" * 3 for i in range(20_000)))
    lines = readers.spread(readers.numbered_lines(spark, str(tmp_path / "g")), name=readers._header("name = "))
    assert "Window [last(__name" not in lines._jdf.queryExecution().optimizedPlan().toString()
    assert {r["count"] for r in lines.groupBy("name").count().collect()} == {4} and lines.select("name").distinct().count() == 20_000


def test_tags_are_turned_back_without_groups_of_pandas(spark):
    rows = spark.createDataFrame([(1, 0, 1, "a", "<rm-1/><rpEndSub/><ct/>"), (1, 0, 0, "a", "<f/><tc/>")], "conv_id long, utt long, idx int, word string, inc string")
    found = repairs.to_eval(rows)
    assert "FlatMapGroups" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r["idx"]: r["tag"] for r in found.collect()} == {0: '<rms id="1"/><tc/>', 1: '<rps id="1"/><rpnrep id="1"/><ct/>'}


def test_parts_are_loaded_with_one_sort(spark, tmp_path):
    """Speakers of two parts over many splits of their files; one of them comes back after another, with line ends of another kind."""
    said = [(part, f"{s}u", f"({i}:{i}:{i})", i / 10, i / 10 + 0.1, f"w{i % 7}", "NN", "<f/>") for part, n in (("train", 5), ("test", 3)) for s in range(n) for i in range(60 * s + 1)]
    said.append(("test", None, "(0:0:0)", 0.0, 0.1, "w0", "NN", "<f/>"))
    writers.write_timed_corpora(spark.createDataFrame(said, "part string, speaker string, ref string, start double, end double, word string, pos_tag string, tag string"), str(tmp_path), readers.PARTS)
    files = [f.read_text() for f in tmp_path.glob("part=train/*.txt")]
    assert sorted(line for f in files for line in f.split("\n") if line.startswith("Speaker")) == [f"Speaker: {s}u" for s in range(5)]
    (tmp_path / "part=test" / "more.txt").write_bytes(b"".join(b"Speaker: %s\r\n\r\n" % s + b"".join(b"(0:0:%d)\t%d.0\t%d.5\tx%d\tNN\t<f/>\r\n" % (i, i, i, i) for i in range(k, k + 20)) for k, s in ((0, b"a"), (20, b"b"), (40, b"a"))))
    vocabulary = spark.createDataFrame([(i, f"w{i}") for i in range(5)] + [(5, "<unk>")], "idx long, token string")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in old:
            spark.conf.set(k, "500")
        # no word is held out
        loaded = readers.trio(spark, {p: str(tmp_path / f"part={p}") for p in readers.PARTS}, vocabulary)
        plan = loaded._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Window [row_number() windowspecdefinition(part") == 1 and "lag(word" in plan and "regexp_replace" not in plan
        got = sorted((r["part"], r["speaker"], r["pos"], r["word"], r["previous_word"], r["word_idx"]) for r in loaded.collect())
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    want = [(p, s or "", i, w, f"w{(i - 1) % 7}" if i else "", min(i % 7, 5)) for p, s, _, t, _, w, _, _ in said for i in [round(t * 10)]]
    back = {"a": [*range(20), *range(40, 60)], "b": [*range(20, 40)]}
    want += [("test", s, i, f"x{n}", f"x{ns[i - 1]}" if i else "", 5) for s, ns in back.items() for i, n in enumerate(ns)]
    assert got == sorted(want)


def test_words_are_not_copied_with_the_arrays_of_their_turn(spark):
    plan = words(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    generated = next(line for line in plan.split("\n") if "Generate posexplode" in line)
    assert "said" not in generated.split("false")[0].rsplit("[", 1)[-1] and "transform(" not in plan
