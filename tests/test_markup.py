"""Bracket markup against a stack machine in plain Python."""

import random

import pytest

from palaver.operators import markup

BY = ["conv_id", "speaker"]


def stack_machine(turns):
    """(conv_id, speaker, utt, mark, level, inside, first, point, repair, end, end_utt) of turns (conv_id, speaker, utt, text)."""
    out = []
    for line in {t[:2] for t in turns}:
        tokens = []
        for _, _, utt, text in sorted((t for t in turns if t[:2] == line), key=lambda t: t[2]):
            edit = False
            for i, token in enumerate((text or "").split()):
                edit = (edit or (token[0] == "{" and token[:2] != "{C")) and token != "}"
                spoken = token not in ("[", "+", "]", "}") and token[0] != "{"
                tokens.append((utt, i, token, spoken, spoken and not edit))
        stack, w = [], 0
        for k, (utt, i, token, spoken, _) in enumerate(tokens):
            if token == "[":
                inside = "" if not stack else "reparandum" if stack[-1][4] is None else "repair"
                stack.append([utt, i, inside, w, None, k])
            elif token == "+" and stack and stack[-1][4] is None:
                stack[-1][4:] = [w, k]
            elif token == "]" and stack:
                utt0, i0, inside, first, point, at = stack.pop()
                repair = None
                if point is not None:
                    behind = next((j for j in range(at + 1, len(tokens)) if tokens[j][4]), None)
                    repair = w if behind is None else min(w, sum(t[3] for t in tokens[:behind]))
                out.append((*line, utt0, i0, len(stack) + 1, inside, first, point, repair, w, utt))
            w += spoken
        out += [(*line, d[0], d[1], level, d[2], d[3], d[4], None, None, None) for level, d in enumerate(stack, 1)]
    return sorted(map(str, out))


@pytest.mark.parametrize("seed", range(3))
def test_markup_is_a_stack_machine(spark, seed):
    rng = random.Random(seed)
    pieces = ["[", "[", "+", "]", "]", "{F uh }", "{C and }", "{F uh um }", "a", "b", "c"]
    turns = [(c, rng.choice("AB"), u, rng.choice([None, "", " "]) if rng.random() < 0.1 else " ".join(rng.choice(pieces) for _ in range(rng.randrange(14)))) for c in range(4) for u in range(25)]
    df = spark.createDataFrame(turns, "conv_id long, speaker string, utt long, text string").repartition(6)
    assert sorted(str(tuple(r)) for r in markup.markup_repairs(df, BY).collect()) == stack_machine(turns)


def test_a_repair_over_three_turns(spark):
    turns = [(1, "A", 0, "[ I want"), (1, "B", 1, "yes ]"), (1, "A", 2, "+ {F uh }"), (1, "A", 4, "I [ need + want ] it ] today")]
    df = spark.createDataFrame(turns, "conv_id long, speaker string, utt long, text string")
    got = sorted(tuple(r)[2:] for r in markup.markup_repairs(df, BY).collect())
    assert got == [(0, 0, 1, "", 0, 2, 3, 7, 4), (4, 1, 2, "repair", 4, 5, 5, 6, 4)]
    assert markup.markup_repairs(df.limit(0), BY).count() == 0
