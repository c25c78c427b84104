import math

import plain_source
from pyspark.sql import functions as F

from palaver.operators import alignment
from palaver.queries import QUERIES
from palaver.queries.base import words
from palaver.queries.modelling import _model

SF = "/root/testdata/sf0.001"
UTT = ["conv_id", "utt"]


def test_network_emissions_and_alignments_cover_every_word(spark):
    w = words(spark, SF)
    length = {tuple(r)[:2]: r["n"] for r in w.groupBy(*UTT).agg(F.count(F.lit(1)).alias("n")).collect()}
    assert max(length.values()) > 40
    steps = QUERIES["network_emissions"](spark, SF).collect()
    assert len(steps) == 2 * len(length) and all(r["n_steps"] == length[r["conv_id"], r["utt"]] for r in steps)
    cost = {(r["conv_id"], r["utt"]): r["cost"] for r in QUERIES["word_alignments"](spark, SF).collect()}
    spoken: dict = {}
    for r in w.select(*UTT, "idx", "word").orderBy(*UTT, "idx").collect():
        t = chr(len(r["word"]) % 26 + 97)
        ref, hyp = spoken.setdefault((r["conv_id"], r["utt"]), ([], []))
        ref.append(t)
        if r["idx"] % 7 != 3:
            hyp.append("z" if r["idx"] % 5 == 1 else t)
    found = {tuple(r)[:2]: r["alignment"] for r in QUERIES["word_alignments"](spark, SF).collect()}
    assert set(found) == set(cost) == set(spoken)
    for k, (ref, hyp) in spoken.items():
        assert {int(step.split(">")[0]) for step in found[k].split()} == set(range(len(ref)))
        indel, price = alignment.PLAIN.indel, lambda x, y: 0 if x == y else 2
        row = [j * indel for j in range(len(hyp) + 1)]
        for x in ref:
            last, row = row, [row[0] + indel]
            for j, y in enumerate(hyp):
                row.append(min(last[j] + price(x, y), last[j + 1] + indel, row[j] + indel))
        assert cost[k] == row[-1]


def test_source_scores_and_excisions_cover_all_conversations(spark):
    w = words(spark, SF)
    rows = [tuple(r) for r in _model(spark, SF)[0].select("order", "context", "word", "num", "den", "nz").collect()]
    p = plain_source.Trigrams(rows).p
    said: dict = {}
    for r in w.orderBy(*UTT, "idx").collect():
        said.setdefault((r["conv_id"], r["utt"]), []).append(r["word"])
    got = {(r["conv_id"], r["utt"], r["idx"]): r["boost"] for r in QUERIES["excision_features"](spark, SF).collect()}
    assert set(got) == {(*k, i) for k, said_words in said.items() for i in range(len(said_words))}
    log2 = lambda x: math.log2(x) if x > 0 else 0.0
    for k, said_words in list(said.items())[:10]:
        padded = ["<s>", "<s>", *said_words]
        for i, word in enumerate(said_words):
            if i:
                best = max(log2(p(padded[i - c : i + 2 - c], word)) for c in range(1, min(8, i) + 1))
                assert abs(got[*k, i] - (best - log2(p(padded[i : i + 2], word)))) < 1e-5
    scored = {(r["conv_id"], r["utt"]) for r in QUERIES["source_scores"](spark, SF).collect()}
    assert scored == {tuple(r) for r in w.select(*UTT).distinct().collect()}


def test_source_model_scores_long_utterances():
    m = plain_source.SourceModel(lambda context, word: 0.5)
    for _ in range(3000):
        m.add("w")
    assert m.score(("<f/>",) * 3000)[0] == -3000.0
