"""Alignment of words with the leaves of trees, and the probabilities of correlations, against plain computation."""

import functools
import random

import pytest
from pyspark.sql import functions as F

from palaver.functions import numbers
from palaver.operators import leaf_maps

WORDS, LEAVES = "who string, utt long, idx int, word string", "who string, tree int, leaf int, token string, pos string"


def most_letters(words, leaves):
    """The most letters that any alignment in order can match that pairs equal ends."""
    ends = 0
    while words and leaves and words[0] == leaves[0]:
        ends, words, leaves = ends + len(words[0]), words[1:], leaves[1:]
    while words and leaves and words[-1] == leaves[-1]:
        ends, words, leaves = ends + len(words[-1]), words[:-1], leaves[:-1]

    @functools.cache
    def best(i, j):
        if i == len(words) or j == len(leaves):
            return 0
        options = [best(i + 1, j), best(i, j + 1)]
        for p, q in leaf_maps.TOGETHER:
            a, b = "".join(words[i : i + p]), "".join(leaves[j : j + q])
            if a == b and i + p <= len(words) and j + q <= len(leaves):
                options.append(len(a) + best(i + p, j + q))
        return max(options)

    return ends + best(0, 0)


@pytest.mark.parametrize("seed", range(300))
def test_align_matches_most_letters(seed):
    rng = random.Random(seed)
    words = [rng.choice(["a", "b", "ab", "ba", "abc", "c"]) for _ in range(rng.randrange(9))]
    leaves = [x for w in words if rng.random() < 0.8 for x in ([w[:1], w[1:]] if len(w) > 1 and rng.random() < 0.4 else [w])] + ["b"] * rng.randrange(2)
    found = leaf_maps.align(words, leaves)
    used = [k for ks in found for k in ks]
    assert used == sorted(used)
    matched = 0
    for i, ks in enumerate(found):
        if len(ks) > 1 or (ks and leaves[ks[0]] == words[i]):
            assert "".join(leaves[k] for k in ks) == words[i]
            matched += len(words[i])
        elif ks:
            assert words[i] in leaves[ks[0]]
            matched += len(words[i])
    assert matched == most_letters(words, leaves)


@pytest.mark.parametrize("words, leaves, want", [("x thand th and y", "X th and Y", [[], [], [1], [2], []]), ("x th and thand y", "X th and Y", [[], [1], [2], [], []]), ("x ab a b ab y", "X a b Y", [[], [], [1], [2], [], []])])
def test_a_word_without_leaf_does_not_take_those_of_its_parts(words, leaves, want):
    assert leaf_maps.align(words.split(), leaves.split()) == want


def test_leaf_map_over_turns_and_odd_rows(spark):
    said = {0: "I do n't know what".split(), 1: ["--", "you", None], 2: "don't you mean".split()}
    words = [("A", u, i, w) for u, ws in said.items() for i, w in enumerate(ws)] + [("A", None, 0, "x"), ("B", 0, 0, "alone"), (None, 0, 0, "nobody")]
    told = [("I", "PRP"), ("don't", "VB"), ("*T*", "-NONE-"), ("know", "VB"), (",", ","), ("what", "WP"), ("YOU", "PRP"), ("do", "VB"), ("n't", "RB"), ("mean", "VB")]
    leaves = [("A", k // 4, k % 4, t, p) for k, (t, p) in enumerate(told)] + [("A", 9, 0, None, "NN"), (None, 0, 0, "nobody", None), ("C", 0, 0, "other", "NN")]
    got = leaf_maps.leaf_map(spark.createDataFrame(words, WORDS), spark.createDataFrame(leaves, LEAVES), ["who"])
    nodes = {(r["who"], r["utt"], r["idx"]): [4 * n["tree"] + n["leaf"] for n in r["nodes"]] for r in got.collect()}
    assert nodes == {
        ("A", 0, 0): [0], ("A", 0, 1): [1], ("A", 0, 2): [1], ("A", 0, 3): [3], ("A", 0, 4): [5], ("A", 1, 0): [], ("A", 1, 1): [6], ("A", 1, 2): [],
        ("A", 2, 0): [7, 8], ("A", 2, 1): [], ("A", 2, 2): [9], ("B", 0, 0): [], (None, 0, 0): [0],
    }
    assert got.count() == len(nodes)
    assert leaf_maps.leaf_map(spark.createDataFrame([], WORDS), spark.createDataFrame(leaves, LEAVES), ["who"]).count() == 0
    assert leaf_maps.leaf_map(spark.createDataFrame(words[:3], WORDS), spark.createDataFrame([], LEAVES), ["who"]).count() == 3


@pytest.mark.parametrize("r, n, p", [(0.0, 10, 1.0), (1.0, 10, 0.0), (-0.5, 12, 0.0979445), (0.3, 40, 0.0600006), (0.9, 5, 0.0373861), (0.01, 10_000, 0.3173517), (0.5, 3, 0.6666667)])
def test_correlation_p(spark, r, n, p):
    """p of Student's t = r sqrt((n - 2) / (1 - r^2)), by quadrature."""
    got = spark.createDataFrame([(r, n)], "r double, n long").select(numbers.correlation_p(F.col("r"), F.col("n"))).first()[0]
    if 0 < abs(r) < 1:
        import numpy as np

        angle = np.arcsin(abs(r))
        t = (np.arange(400_000) + 0.5) / 400_000
        density = lambda a: (np.cos(a) ** (n - 3)).mean()
        want = (np.pi / 2 - angle) * density(angle + (np.pi / 2 - angle) * t) / (np.pi / 2 * density(np.pi / 2 * t))
        assert got == pytest.approx(want, abs=1e-6)
    else:
        assert got == pytest.approx(p, abs=1e-9)
    assert spark.createDataFrame([(r, 2)], "r double, n long").select(numbers.correlation_p(F.col("r"), F.col("n"))).first()[0] is None


def test_a_passage_said_twice_keeps_its_leaves(spark):
    """Behind the second one ends a turn, behind the first one a tree."""
    turn, tree, of = [], [], {}
    for line in range(60):
        a, b, t, u, y = (f"{c}{line * 7919 % 9973:04d}" for c in ("aa", "bb", "t", "u", "y"))
        spoken = [[a, b, t], [u, a, b], [y]]
        words = [(k, i, w) for k, ws in enumerate(spoken) for i, w in enumerate(ws)]
        for n, (k, i, w) in enumerate(words):
            leaf = (0, n) if n < 2 else (1, n - 2)
            turn.append((line, k, i, w))
            # one word has lost its leaf
            if w != u:
                tree.append((line, *leaf, w, "NN"))
            of[line, k, i] = [] if w == u else [leaf]
    got = leaf_maps.leaf_map(spark.createDataFrame(turn, "who int, utt int, idx int, word string"), spark.createDataFrame(tree, "who int, tree int, leaf int, token string, pos string"), ["who"])
    assert {(r["who"], r["utt"], r["idx"]): [(x["tree"], x["leaf"]) for x in r["nodes"]] for r in got.collect()} == of


def test_a_word_without_leaf_behind_those_it_is_made_of(spark):
    """What follows the words follows the longer one, too, in both streams: letters ahead alone would be an anchor at the wrong place."""
    turn, tree, of = [], [], {}
    for line in range(60):
        more = [f"{c}{line * 7919 % 9973:04d}" for c in "stuvwxyz"]
        spoken = [*more[:4], "bleed", "in", "bleedin", *more[4:]]
        turn += [(line, 0, i, w) for i, w in enumerate(spoken)]
        held = [i for i in range(len(spoken)) if i != 6]
        tree += [(line, 0, n, spoken[i], "NN") for n, i in enumerate(held)]
        of |= {(line, i): [held.index(i)] if i in held else [] for i in range(len(spoken))}
    got = leaf_maps.leaf_map(spark.createDataFrame(turn, "who int, utt int, idx int, word string"), spark.createDataFrame(tree, "who int, tree int, leaf int, token string, pos string"), ["who"])
    assert {(r["who"], r["idx"]): [x["leaf"] for x in r["nodes"]] for r in got.collect()} == of
