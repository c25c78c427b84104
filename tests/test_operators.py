"""Examples, properties and brute-force comparisons of the dialogue operators."""

import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
import plain_source
from pyspark.sql import functions as F

from palaver.functions import numbers, tags, text
from palaver.operators import alignment, decoding, evaluation, joins, networks, repairs, sequences, source_model
from palaver.operators import language_model as lm
from palaver.queries.live import make_session
from palaver.sources import readers
from palaver.streaming import tagger


def test_context_windows(spark):
    df = spark.createDataFrame([(0, i, 10 * i) for i in range(1, 8)], "k int, at int, v int")
    back = df.select("at", sequences.context_backwards("v", ["k"], ["at"], 3).alias("c")).orderBy("at").collect()
    assert [r["c"] for r in back] == [[-1, -1, 10], [-1, 10, 20], *([10 * i, 10 * i + 10, 10 * i + 20] for i in range(1, 6))]
    both = df.select("at", sequences.context_symmetric("v", ["k"], ["at"], 3).alias("c")).orderBy("at").collect()
    assert both[0]["c"] == [-1, 10, 20] and both[-1]["c"] == [60, 70, -1]


def test_batches(spark):
    df = spark.createDataFrame([(0, i) for i in range(5)], "k int, v int")
    assert [r[0] for r in df.select(sequences.last_n("v", ["k"], ["v"], 2).alias("b"), "v").orderBy("v").collect()] == [[0], [0, 1], [1, 2], [2, 3], [3, 4]]
    ranges = df.select(*(c.alias(n) for c, n in zip(sequences.bptt_range(F.col("v"), 2), "ab")), "v").orderBy("v").collect()
    assert [(r["a"], r["b"]) for r in ranges] == [(0, 0), (0, 1), (1, 2), (2, 3), (3, 4)]


def test_edit_distance():
    assert alignment.token_distance("tea with milk please".split(), "tea with milk".split()) == 1
    assert alignment.token_distance("tea with milk please".split(), "more tea with oat milk".split()) == 3
    assert alignment.token_distance(["tea"], []) == 1 and alignment.token_distance([], []) == 0
    assert alignment.error_rate("tea with milk please".split(), "tea with milk".split()) == 25.0
    assert alignment.error_rate(["tea", "please"], []) == 100.0 == alignment.error_rate([], ["tea"])
    assert alignment.token_distance(["a"] * 300, ["b"] * 300) == 300


@given(st.lists(st.sampled_from("abc"), max_size=7), st.lists(st.sampled_from("abc"), max_size=7))
@settings(max_examples=80, deadline=None)
def test_edit_distance_is_recursive(a, b):
    def slow(x, y):
        if not x or not y:
            return len(x) + len(y)
        return min(slow(x[1:], y) + 1, slow(x, y[1:]) + 1, slow(x[1:], y[1:]) + (x[0] != y[0]))

    assert alignment.token_distance(a, b) == slow(a, b)
    (found,) = alignment.best_alignments(a, b)
    assert (found[-1][3] if found else 0) == sum({"ID": 0, "S_ARB": 2}.get(op, 1) for _, _, op, _ in found)


def _price(source, goal, costs):
    """The cheapest alignment by plain recursion."""
    if not source or not goal:
        return (len(source) + len(goal)) * costs.indel
    each = min(r.cost for r in costs.rules if r.applies(source[:1], goal[:1])[0, 0])
    return min(_price(source[1:], goal[1:], costs) + each, _price(source[1:], goal, costs) + costs.indel, _price(source, goal[1:], costs) + costs.indel)


_SAID = st.lists(st.tuples(st.sampled_from(["go", "g-", "going", "no", "n-"]), st.sampled_from(["VB", "VBG", "UH"])), max_size=4)


@given(_SAID, _SAID)
@settings(max_examples=80, deadline=None)
def test_repair_alignment_is_cheapest(a, b):
    for found in alignment.best_alignments(a, b, alignment.REPAIR, most=50):
        assert (found[-1][3] if found else 0) == _price(a, b, alignment.REPAIR)


def test_repair_alignment():
    found = alignment.best_alignments([("the", "DT"), ("re-", "JJ"), ("car", "NN")], [("the", "DT"), ("red", "JJ"), ("bus", "NN"), ("left", "VBD")], alignment.REPAIR)[0]
    assert [op for _, _, op, _ in found] == ["REP", "REP_complete", "SUB_POS", "INS"] and found[-1][3] == 7


def test_all_best_alignments():
    ranked = [" ".join(op for _, _, op, _ in f) for f in alignment.best_alignments(["a"], ["b"], most=9)]
    assert ranked == ["S_ARB", "INS DEL", "DEL INS"]
    every = alignment.best_alignments(list("aab"), list("ab"), most=99)
    assert len(every) == len({str(f) for f in every}) == 2 and all(f[-1][3] == 1 for f in every)
    assert alignment.best_alignments([], [], most=5) == [[]]


@given(st.lists(st.sampled_from("abc"), max_size=8), st.lists(st.sampled_from("abc"), max_size=8))
@settings(max_examples=150, deadline=None)
def test_match_blocks(a, b):
    def longest(x, y, i, j):
        best = max(((n, -s, -g) for s in range(len(x)) for g in range(len(y)) for n in range(1, min(len(x) - s, len(y) - g) + 1) if x[s : s + n] == y[g : g + n]), default=None)
        if best is None:
            return []
        n, s, g = best[0], -best[1], -best[2]
        return longest(x[:s], y[:g], i, j) + [(i + s, j + g, n)] + longest(x[s + n :], y[g + n :], i + s + n, j + g + n)

    assert alignment.match_blocks(a, b) == longest(a, b, 0, 0)


def test_shared_time(spark):
    df = spark.createDataFrame([(100, 200, ["it", "is", "so"]), (0, 10, ["abc"]), (5, 5, [])], "s int, e int, w array<string>")
    got = [r[0] for r in df.select(alignment.shared_time(F.col("s"), F.col("e"), F.col("w"))).collect()]
    assert [[(x["word"], x["start"], x["end"]) for x in g] for g in got] == [[("it", 100, 133), ("is", 133, 166), ("so", 166, 200)], [("abc", 0, 10)], []]


def test_round_trip_between_schemes(spark):
    words = "we went well drove to er drove home".split()
    gold = ['<f/>', '<rms id="3"/>', '<i id="3"/><e/>', '<rps id="3"/><rpnsub id="3"/>', "<f/>", "<e/>", "<f/>", "<f/>"]
    df = spark.createDataFrame([(0, 0, i, w, g) for i, (w, g) in enumerate(zip(words, gold))], "conv_id long, utt long, idx int, word string, gold string")
    inc = repairs.to_incremental(df)
    assert [r["inc"] for r in inc.orderBy("idx").collect()] == ["<f/>", "<f/>", "<e/>", "<rm-2/><rpEndSub/>", "<f/>", "<e/>", "<f/>", "<f/>"]
    back = [r["tag"] for r in repairs.to_eval(inc).orderBy("idx").collect()]
    assert back == gold


def test_verify_finds_each_fault(spark):
    lines = {
        0: ['<rms id="1"/>', '<rps id="1"/><rpnrep id="1"/>'],
        1: ["<f/>", '<rps id="1"/><rpnrep id="1"/>'],
        2: ['<rms id="1"/>', '<rps id="1"/>'],
        3: ['<rps id="1"/><rpnrep id="1"/>', '<rms id="1"/>'],
        4: ['<rms id="1"/>', '<rps id="1"/>', '<rm id="1"/><rpnsub id="1"/>'],
    }
    df = spark.createDataFrame([(0, u, i, "w", t) for u, ts in lines.items() for i, t in enumerate(ts)], "conv_id long, utt long, idx int, word string, tag string")
    found = {r["utt"]: r["reason"] for r in repairs.verify(df).collect()}
    assert found == {0: None, 1: "no reparandum start", 2: "no repair end", 3: "reparandum starts behind the repair", 4: "reparandum inside the repair"}


def test_rename_closes_open_repairs(spark):
    ts = ['<rms id="7"/>', '<rps id="7"/>', '<rp id="7"/>']
    df = spark.createDataFrame([(0, 0, i, "w", t) for i, t in enumerate(ts)], "conv_id long, utt long, idx int, word string, tag string")
    assert [r["tag"] for r in repairs.rename_repairs(df).orderBy("idx").collect()] == ['<rms id="1"/>', '<rps id="1"/>', '<rp id="1"/><rpnsub id="1"/>']


def test_full_states(spark):
    ts = ["<f/><tc/>", "<rm-1/><rpMid/><cc/>", "<f/><cc/>", "<e/><cc/>", "<rpEndSub/><ct/>"]
    df = spark.createDataFrame([(ts,)], "t array<string>")
    assert df.select(tags.full_states(F.col("t")).alias("s")).first()["s"] == ["f", "rpSM", "rpM", "e", "rpE"]
    assert df.select(tags.full_states(F.col("t"), True).alias("s")).first()["s"] == ["t_f_c", "c_rpSM_c", "c_rpM_c", "c_e_c", "c_rpE_t"]


def test_brackets(spark):
    line = "Ana ( took, + {F uh, } bought ) bread"
    out = spark.createDataFrame([(line,)], "l string").select(F.explode(readers.bracketed(F.col("l"))).alias("t")).select("t.word", "t.tag").collect()
    assert [(text_word.strip(","), tag) for text_word, tag in out] == [("Ana", "<f/>"), ("took", '<rms id="1"/>'), ("uh", '<i id="1"/><e/>'), ("bought", '<rps id="1"/>'), ("bread", "<f/>")]


def test_kneser_ney_mass_is_one(spark):
    s = spark.createDataFrame([("a b a b c".split(),), ("a c b".split(),), ("b a b".split(),)], "tokens array<string>")
    model = lm.train(s).cache()
    words = [r[0] for r in model.filter("order = 1").select("word").collect()]
    for context in ("<s> <s>", "a b", "b a", "x y", "x b"):
        grams = spark.createDataFrame([(context, w) for w in words], "context string, word string")
        assert abs(lm.probabilities(grams, model).agg(F.sum("p")).first()[0] - 1) < 1e-9, context


def test_source_model_agrees_with_table(spark):
    s = spark.createDataFrame([("a b a b c".split(),), ("a c b".split(),)], "tokens array<string>")
    model = lm.train(s).cache()
    rows = [tuple(r) for r in model.select("order", "context", "word", "num", "den", "nz").collect()]
    t = plain_source.Trigrams(rows)
    grams = spark.createDataFrame([("a b", "c"), ("<s> <s>", "a"), ("q q", "b"), ("a b", "z")], "context string, word string")
    for r in lm.probabilities(grams, model).collect():
        assert abs(t.p(r["context"].split(), r["word"]) - r["p"]) < 1e-12
    m = plain_source.SourceModel(t.p)
    for w in "a b c".split():
        m.add(w)
    first = m.score(("<s/>", "<f/>", "<e/>"))[0]
    m.rollback(1)
    m.add("c")
    assert m.score(("<s/>", "<f/>", "<e/>"))[0] == first
    best = m.best(1)[0]
    assert best[1] == max(m.score(c)[0] for c in itertools.product(("<f/>", "<e/>"), repeat=3))


@given(st.lists(st.lists(st.integers(-6, 0), min_size=11, max_size=11), min_size=1, max_size=4))
@settings(max_examples=30, deadline=None)
def test_lattice_is_brute_force(rows):
    weights, states = decoding.constraint_weights(), list(decoding.STATES)
    lattice = decoding.Lattice(states, weights, lambda _, s: s)
    for r in rows:
        lattice.step(r)
    path, score = lattice.best()
    best = -math.inf
    for p in itertools.product(range(len(states)), repeat=len(rows)):
        total, before = 0.0, "s"
        for i, r in zip(p, rows):
            w = weights.get((before, states[i]))
            if w is None:
                break
            total, before = total + w + r[i], states[i]
        else:
            best = max(best, total)
    assert score == pytest.approx(best) and len(path) == len(rows)


def test_viterbi_forms_agree(spark):
    r = np.random.default_rng(0)
    rows = [(i, r.integers(-9, 0, (n, 11)).astype(float).tolist()) for i, n in enumerate((1, 2, 9, 30))] + [(9, [])]
    df = spark.createDataFrame(rows, "id long, emissions array<array<double>>")
    args = list(decoding.STATES), decoding.constraint_weights()
    fast = decoding.viterbi(df, *args).orderBy("id").collect()
    slow = decoding.viterbi(df, *args, state_of=lambda _, s: s).orderBy("id").collect()
    assert [(a["path"], round(a["score"], 6)) for a in fast] == [(a["path"], round(a["score"], 6)) for a in slow]


def test_hypothesis_updates():
    def after(*new):
        h = tagger.Hypothesis()
        h.words = [("tea", 0, 2), ("with", 2, 3), ("milk", 4, 6)]
        return h.update(list(new)), h.words

    base = [("tea", 0, 2), ("with", 2, 3), ("milk", 4, 6)]
    assert after(("please", 6, 8)) == (([("please", 6, 8)], 0), [*base, ("please", 6, 8)])
    assert after(("without", 2, 3)) == (([("without", 2, 3)], 2), [base[0], ("without", 2, 3)])
    assert after(("with", 2, 3), ("silk", 4, 6)) == (([("silk", 4, 6)], 1), [*base[:2], ("silk", 4, 6)])
    assert after(("with", 2, 3)) == (([], 0), base) and after() == (([], 0), base)


def test_hypothesis_ids():
    ids = tagger.HypothesisIds()
    seen = [ids.see(*w) for w in (("tea", 0, 2), ("with", 2, 3), ("with", 2, 3), ("without", 1.5, 3), ("milk", 3, 5), ("oats", 3.5, 4.5), ("now", 5, 6))]
    assert seen == [0, 1, None, 0, 1, 1, 2]
    ids.commit(1)
    assert ids.see("please", 0, 1) == 3


_session = make_session


@given(st.lists(st.tuples(st.sampled_from(["a", "bb", "ccc", "a"]), st.booleans()), min_size=1, max_size=25))
@settings(max_examples=40, deadline=None)
def test_rollback_then_replay_is_a_fresh_run(steps):
    session, words = _session(), []
    for word, revoke in steps:
        if revoke and len(session.lattice.columns) > 1:
            session.add([word], 1)
            words[-1:] = [word]
        else:
            session.add([word])
            words.append(word)
    fresh = _session()
    for w in words:
        fresh.add([w])
    assert session.words == fresh.words == words
    if len(words) <= tagger.HISTORY:
        assert session.tags == fresh.tags


def test_dump_and_load():
    a, b = _session(), _session()
    a.add(["one", "two", "two"])
    b.load(a.dump())
    assert a.add(["two"], 1) == b.add(["two"], 1)


def test_stream_equals_batch(spark, tmp_path):
    rows = [(k, n, 1 if n % 3 == 2 else 0, ["w" * (1 + (n * 5 + len(k)) % 4)]) for k in ("x", "yy") for n in range(8)]
    schema = "key string, update_no long, rollback int, words array<string>"
    for part in range(2):
        spark.createDataFrame([r for r in rows if r[1] // 4 == part], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = tagger.tag_stream(stream, _session).writeStream.format("memory").queryName("tags_out").option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start()
    try:
        assert query.awaitTermination(120)
    finally:
        query.stop()
    got = {tuple(r) for r in tagger.final_view(spark.table("tags_out")).collect()}
    want = {tuple(r) for r in tagger.final_view(tagger.replay(spark.createDataFrame(rows, schema), _session)).collect()}
    assert got == want and want


def test_sessions_stay_small_and_refuse_what_they_cannot_do(spark):
    session = _session()
    for n in range(600):
        session.add(["w" * (1 + n % 7)])
    assert session.length == 600 and len(session.words) <= tagger.SETTLED + tagger.HISTORY + 1 and len(session.dump()) < 40_000
    with pytest.raises(ValueError):
        session.add(["x"], tagger.HISTORY + 1)
    assert session.length == 600
    session.commit()
    assert session.revocable() == 0 and session.length == 600
    rows = [("k", 0, 0, ["one"], None), ("k", 1, 5, ["two"], None), ("k", 2, 1, [], None), ("k", 3, 0, ["three"], "stop"), ("k", 4, 0, ["four"], None), ("k", 5, 0, ["five"], "commit"), ("k", 6, 2, ["six"], None), ("k", 7, 0, ["seven"], "reset")]
    out = tagger.replay(spark.createDataFrame(rows, "key string, update_no long, rollback int, words array<string>, control string"), _session)
    assert sorted(r["version"] for r in tagger.faults(out).collect()) == [1, 3, 6]
    assert sorted((r["part"], r["idx"], r["word"]) for r in tagger.final_view(out).collect()) == [(0, 0, "four"), (0, 1, "five"), (1, 0, "seven")]


def test_windowed_stream(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    events.coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = tagger.windowed_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "e")), "ts", "1 hour", ["event_type"], late="1 hour")
    query = stream.writeStream.outputMode("complete").format("memory").queryName("windows_out").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert {tuple(r) for r in spark.table("windows_out").collect()} == {tuple(r) for r in tagger.windowed_counts(events, "ts", "1 hour", ["event_type"]).collect()}


def test_interval_join_has_no_nested_loop(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), (F.col("id") * 10).alias("start_ms"), (F.col("id") * 10 + 35).alias("end_ms"))
    joined = joins.interval_join(df, df, ["k"], 50)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    rows = [(r["k"], r["start_ms"], r["end_ms"]) for r in df.collect()]
    assert joined.count() == sum(a[0] == b[0] and b[2] > a[1] and b[1] < a[2] for a in rows for b in rows)


def test_percentile(spark):
    df = spark.createDataFrame([([12.0, 16.0, 30.0, 44.0, 60.0],)], "v array<double>")
    got = [df.select(numbers.nist_percentile(F.col("v"), F.lit(p)).alias("p")).first()[0] for p in (0.0, 30.0, 40.0, 99.0)]
    assert got == [12.0, 14.0, 16.0, 60.0]
    counted = evaluation.percentiles(df.select(F.lit("a").alias("k"), F.explode("v").alias("v")), ["k"], "v", (0.0, 30.0, 40.0, 99.0)).first()
    assert list(counted)[1:] == got


def test_headers_carry_over_the_splits_of_a_file(spark, tmp_path):
    lines = [x for s in range(6) for x in (f"Speaker: {s}A", "", *(f"(1:1:{i})\t{i}.0\t{i}.2\tw{s}x{i}\tNN\t<f/>" for i in range(40 * s)))]
    (tmp_path / "one.text").write_text("\n".join(lines) + "\n")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in old:
            spark.conf.set(k, "700")
        assert readers.numbered_lines(spark, str(tmp_path)).select("block").distinct().count() > 10
        got = readers.timed_corpus(spark, str(tmp_path), limit=False).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sorted((r["speaker"], r["pos"], r["word"]) for r in got) == [(f"{s}A", i, f"w{s}x{i}") for s in range(6) for i in range(40 * s)]


def test_markup_and_tagged_lines(spark):
    df = spark.createDataFrame([("<?xml version='1.0'?>", True, False), ("  <bnc>", True, False), ("the/DT cat/NN ./.", False, True), ("the cat/NN", False, False), ("", False, False)], "line string, markup boolean, tagged boolean")
    assert df.filter((text.is_markup(F.col("line")) != F.col("markup")) | (text.is_tagged(F.col("line")) != F.col("tagged"))).isEmpty()


def test_networks_learn_and_run(spark):
    r = np.random.default_rng(1)
    data = [(x := r.normal(size=(6, 3)), (x[:, 0] > 0).astype(int)) for _ in range(20)]
    net = networks.random_elman(3, 8, 2, 1)
    losses = networks.fit_elman(net, data, rate=2.0, epochs=60)
    assert losses[-1] < 0.5 * losses[0]
    lstm = networks.random_lstm(3, 4, 2)
    assert np.allclose(networks.run_network(lstm, data[0][0]).sum(axis=1), 1)
    df = spark.createDataFrame([(0, data[0][0].tolist())], "id long, features array<array<double>>")
    assert np.allclose(networks.emissions(df, net, ["id"]).first()["emissions"], networks.run_network(net, data[0][0]))


def test_frames_and_files(spark, tmp_path):
    (tmp_path / "g.TextGrid").write_text('item [1]:\n name = "Hyp"\n xmin = 0\n xmax = 1.5\n text = "hi"\n xmin = 1.5\n xmax = 2\n text = ""\n')
    assert [tuple(r)[1:] for r in readers.textgrid(spark, str(tmp_path / "g.TextGrid")).collect()] == [("Hyp", 0.0, 1.5, "hi"), ("Hyp", 1.5, 2.0, "")]
    (tmp_path / "v.csv").write_text("0,a\n1,b,c\n2,<unk>\n")
    assert [tuple(r) for r in readers.vocabulary(spark, str(tmp_path / "v.csv")).collect()] == [(0, "a"), (1, "b,c"), (2, "<unk>")]
    (tmp_path / "m.csv").write_text(",f,e\nf,1,1\ns,1,\n")
    assert {tuple(r) for r in readers.transition_matrix(spark, str(tmp_path / "m.csv")).collect()} == {("f", "f", 1), ("f", "e", 1), ("s", "f", 1)}
    (tmp_path / "c.csv").write_text("exp,window,lr,pos,note\n001,2,0.05,True,\n002,3,0.1,False,x\n")
    assert readers.experiment_config(spark, str(tmp_path / "c.csv"), "2") == {"exp": 2, "window": 3, "lr": 0.1, "pos": False, "note": "x"}
    (tmp_path / "lm.text").write_text("77:B:3:qy,is tea ready\nPOS,VBZ NN JJ\n")
    row = readers.lm_corpus(spark, str(tmp_path / "lm.text")).first()
    assert (row["conv"], row["caller"], row["utt"], row["act"], row["tokens"], row["pos_tags"]) == ("77", "B", 3, "qy", ["is", "tea", "ready"], ["VBZ", "NN", "JJ"])
    (tmp_path / "x.xml").write_text('<s n="1"><w c5="AT0" hw="the">The </w><w c5="NN1">cat </w></s>\n')
    assert [(r["pos"], r["word"]) for r in readers.c5_xml(spark, str(tmp_path / "x.xml")).orderBy("at").collect()] == [("AT0", "The"), ("NN1", "cat")]
    frames = spark.createDataFrame([("a", f, float(f)) for f in range(5)], "speaker string, frame int, intensity double")
    words = spark.createDataFrame([("a", 0, 0.03)], "speaker string, pos int, end double")
    assert readers.frame_window(words, frames, "intensity", ["speaker"], 5).first()["intensity_window"] == [0.0, 0.0, 1.0, 2.0, 3.0]


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("c")).first()["c"]
    assert one(text.clean_asr_word(F.lit("%HESITATION"))) == "uh"
    assert one(text.collapse_act(F.lit("sd^e(^q), qy"))) == "sd"
    assert one(text.proper_prefix(F.lit("$unk$lo"), F.lit("love"))) is True
    assert one(text.standardise_word(F.lit("Ana's"), F.lit("NNP"))) == "$unc$anas"
    assert evaluation.with_prf(spark.createDataFrame([(0, 1, 1)], "tp long, fp long, fn long")).first()["f1"] == 0.0
    assert one(numbers.segmentation_error(F.lit(0), F.lit(0), F.lit(0))) == 0.0
