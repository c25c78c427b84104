"""Operators 11 to 13 against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palaver.llm import filters, pieces, registry, whitening

SF = "/root/testdata/sf0.001"


# --- 11: whitening -----------------------------------------------------------------------------------------------------------


def exact_whitening(x: np.ndarray, components: int = 16):
    """n, deviations, eigenvalue shares and whitened values by a dense decomposition."""
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    y = (n * fit - sums) / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(components, int((values > 1e-12 * max(values[0], 1e-300)).sum()))
    off = n * x - sums
    return n, (off * off).sum(axis=1), values[:k] / values.sum(), (off / n) @ (vectors[:, :k] / np.sqrt(values[:k]))


def test_op11(spark):
    rows = registry.QUERIES["op11_whitening"](spark, SF).collect()
    table = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    x = np.array([np.floor(np.array(r["embedding"], float) * 64).astype(np.int64) + 1_000_000 for r in table])
    n, deviations, shares, whitened = exact_whitening(x)
    assert len(rows) == len(table) * 16 and {r["n"] for r in rows} == {n}
    got = {(r["vec_id"], r["component"]): r for r in rows}
    for k in range(16):
        mine = np.array([got[r["vec_id"], k + 1]["whitened"] for r in table])
        sign = np.sign(mine @ whitened[:, k])
        np.testing.assert_allclose(mine * sign, whitened[:, k], atol=1e-9)
        assert got[table[0]["vec_id"], k + 1]["explained"] == pytest.approx(shares[k], rel=1e-9)
    assert [got[r["vec_id"], 1]["deviation"] for r in table] == deviations.tolist()
    assert 0 < rows[0]["identity_error"] < 1e-9


@pytest.mark.parametrize("kind", ["spread", "ties", "low rank", "zero", "one"])
def test_lanczos(kind):
    rng = np.random.default_rng(3)
    values = {"spread": np.linspace(1, 50, 300), "ties": np.repeat([7.0, 3.0, 1.0], 100), "low rank": np.r_[np.zeros(297), 1.0, 1.0, 2.0], "zero": np.zeros(300), "one": np.array([4.0])}[kind]
    d = len(values)
    q, _ = np.linalg.qr(rng.standard_normal((d, d)))
    a = (q * values) @ q.T
    found, vectors, passes = whitening.block_lanczos(lambda b: a @ b, d, 16, size=8, most=4)
    want = np.sort(values)[::-1][:16]
    np.testing.assert_allclose(found, want, atol=1e-10)
    np.testing.assert_allclose(vectors.T @ vectors, np.eye(len(want)), atol=1e-12)
    assert np.linalg.norm(a @ vectors - vectors * found) < 1e-10
    assert passes < {"spread": 300, "ties": 30, "low rank": 12, "zero": 12, "one": 3}[kind]


def test_odd_vectors(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [0.5, -1.0]), (2, None), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 0.0]), (6, [0.0, 3.0]), (7, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for c in ("x", "n", "k", "deviation", "whitened", "label"):
        df = df.withColumn(c, F.lit("clash"))
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    got = registry.QUERIES["op11_whitening"](spark, str(tmp_path)).collect()
    kept = [r for r in rows if r[0] in (1, None, 6, 7)]
    x = np.array([np.floor(np.array(v) * 64).astype(np.int64) + 1_000_000 for _, v in kept])
    n, deviations, shares, _ = exact_whitening(x)
    assert n == 3 and len(got) == 2 * len(kept)
    assert sorted((str(r["vec_id"]), r["deviation"]) for r in got if r["component"] == 1) == sorted((str(i), d) for (i, _), d in zip(kept, deviations.tolist(), strict=True))
    assert sorted({round(r["explained"], 9) for r in got}) == sorted(round(s, 9) for s in shares) and got[0]["identity_error"] < 1e-9
    # all columns of any name stay in the library's own form
    fit = df.filter(whitening.is_finite(F.col("embedding"))).withColumn("x", whitening.on_grid(F.col("embedding")))
    out = whitening.whiten(fit, "x", whitening.fit_whitening(fit, "x"))
    assert out.columns == [*fit.columns, "_deviation", "_whitened"] and out.count() == len(kept)
    with pytest.raises(ValueError):
        whitening.fit_whitening(spark.createDataFrame([([1],), ([1, 2],)], "x array<long>"), "x")
    for rows in ([], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, [])], [(1, None)]):
        folder = str(tmp_path / f"few-{hashlib.md5(str(rows).encode()).hexdigest()}")
        spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
        empty = registry.QUERIES["op11_whitening"](spark, folder)
        assert empty.count() == 0 and empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


# --- 12: filter audit --------------------------------------------------------------------------------------------------------


def exact_audit(docs: list[tuple], labels: list[tuple]) -> list[tuple]:
    """(part, order, step, figures) of documents (doc_id, text, source) by applying the filters one by one."""
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    good, toxic = ({i for i, *v in labels if v[k] == 1 and i is not None} for k in (0, 1))

    def fails(i, text) -> set[str]:
        words = [w for w in text.replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ") if w]
        out = {"A"} if len(words) < 50 else set()
        out |= {"B"} if 100 * len(set(words)) < 65 * len(words) else set()
        out |= {"C"} if 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text) else set()
        out |= {"D"} if set("#$%&*|") & set(text) else set()
        return out | ({"E"} if i is not None and i > least[text] else set())

    found = [(source or "", i, fails(i, text or "")) for i, text, source in docs]
    out = []
    for part in {p for p, _, _ in found}:
        removed_by, steps = dict.fromkeys("ABCDE", 0), []
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [(i, f) for p, i, f in found if p == part]
            gone = []
            for step, letter in enumerate(order, 1):
                here = [x for x in left if letter in x[1]]
                redundant = sum(letter in f for _, f in gone)
                left = [x for x in left if letter not in x[1]]
                gone += here
                removed_by[letter] += len(here)
                unique = sum(f == {letter} for p, _, f in found if p == part)
                steps.append((part, order, step, letter, len(left), len(here), redundant, unique, sum(i in good for i, _ in here), sum(i in toxic for i, _ in here)))
        out += [(*s[:3], *s[4:], removed_by[s[3]]) for s in steps]
    return sorted(out)


def odd_audit() -> tuple[list[tuple], list[tuple]]:
    rng = random.Random(5)
    long_text = " ".join(f"w{rng.randrange(10**6)}" for _ in range(30_000))
    docs = [(1, None, None), (2, "", "s"), (3, "one $", "s"), (None, long_text, "s"), (9, long_text, "t"), (4, long_text, "s"), (4, long_text, "s"), (10, long_text + "x", "s"), (11, long_text[:-1] + "\x01", "t")]
    docs += [(20, "AB " * 60, ""), (21, "AB " * 60, None), (21, "AB " * 60, None), (22, "ÄÖ " * 60, "s"), (None, "AB " * 60, "t")]
    docs += [(100 + i, " ".join(rng.choice("abcdefghijk") + str(rng.randrange(9)) for _ in range(rng.choice([3, 60]))), rng.choice("st")) for i in range(40)]
    docs += [(200 + i, rng.choice(docs)[1], rng.choice(["s", None])) for i in range(60)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(1, 260) if rng.random() < 0.6] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    return docs, labels


@pytest.mark.parametrize("bits", [64, 1, 0])
def test_audit(spark, bits):
    """With few bits in a block hash, unequal texts of a length meet in one class."""
    docs, labels = odd_audit()
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(5)
    for c in ("part", "mask", "n", "least", "blocks", "prefix", "texts"):
        df = df.withColumn(c, F.lit("clash"))
    label_rows = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("n", F.lit("clash"))
    got = filters.audit_filters(df, label_rows, F.col("source"), bits)
    assert sorted(tuple(r) for r in got.collect()) == exact_audit(docs, labels)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_audit_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filters.audit_filters(docs, labels, F.col("source")).count() == 0
    one = spark.createDataFrame([(1, "a", None)], docs.schema)
    assert filters.audit_filters(one, labels, F.col("source")).filter("step = 5").agg(F.sum("kept"), F.sum("removed"), F.count("part")).first()[:] == (0, 24, 120)


# --- 13: pieces --------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path(pieces.MODEL)
    vocabulary = pieces.read_vocabulary(path)
    return vocabulary, pieces.PrefixTable(vocabulary), sentencepiece.SentencePieceProcessor(model_file=path)


PARTS = ["a", "b", "the", "▁", " ", "  ", "    ", "é", "日", "本", "\n", "\t", "1", "2", "\x00", "ing", "tion", "\U0001f600", "́", "x", "Q", "<s>", "<0x41>", "�", "है", "привет", ".", "="]


@given(st.lists(st.sampled_from(PARTS) | st.characters(codec="utf-8"), max_size=40))
@settings(max_examples=400, deadline=None)
def test_encode_like_the_library(model, parts):
    _, table, library = model
    text = "".join(parts)
    ids = library.encode(text, add_bos=True, add_eos=True)
    assert table.encode(text).tolist() == ids
    assert table.decode(ids).decode() == library.decode(ids)


@given(st.lists(st.sampled_from([0, 1, 2, 259, 260, 29871]) | st.integers(3, 258) | st.integers(259, 31999), max_size=10))
@settings(max_examples=400, deadline=None)
def test_decode_like_the_library(model, ids):
    _, table, library = model
    assert table.decode(ids).decode() == library.decode(ids)


def test_op13(spark, model):
    _, _, library = model
    got = {r["doc_id"]: tuple(r)[1:] for r in registry.QUERIES["op13_pieces"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for i, text in docs:
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        assert got[i] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())


def test_odd_texts(spark, model):
    vocabulary, _, library = model
    rng = random.Random(2)
    unbroken = "".join(rng.choice("abcdefgh日éxyz") for _ in range(200_000))
    rows = [(1, None), (2, ""), (3, " "), (None, "no id"), (4, "same"), (4, "same"), (5, unbroken), (6, " " * 5000 + "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("n_tokens", F.lit("clash"))
    encoded = pieces.encode(df, vocabulary)
    key = lambda i, text: (str(i), text or "")
    want = sorted((str(i), library.encode(t or "", add_bos=True, add_eos=True)) for i, t in rows)
    assert sorted((str(r["doc_id"]), list(r["ids"])) for r in encoded.collect()) == want
    assert sorted(key(*r) for r in pieces.decode(encoded, vocabulary).collect()) == sorted(key(i, t) for i, t in rows)
    assert pieces.digests(df, vocabulary).filter("doc_id = 2").first()["n_tokens"] == 2
    assert pieces.digests(df.limit(0), vocabulary).count() == 0
    assert pieces.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), vocabulary).collect()[0]["text"] == ""


def test_models_that_are_refused(tmp_path):
    import public_tokenizers
    from sentencepiece import sentencepiece_model_pb2 as schema

    def changed(change) -> str:
        model = schema.ModelProto.FromString(open(public_tokenizers.path(pieces.MODEL), "rb").read())
        change(model)
        (tmp_path / "m").write_bytes(model.SerializeToString())
        return str(tmp_path / "m")

    for change in (lambda m: setattr(m.normalizer_spec, "remove_extra_whitespaces", True), lambda m: setattr(m.trainer_spec, "byte_fallback", False), lambda m: setattr(m.pieces[300], "type", 4)):
        with pytest.raises(ValueError):
            pieces.read_vocabulary(changed(change))


def test_vocabulary_with_blanks_inside_pieces(model):
    """Pieces that reach over a blank: texts are then no longer cut into words."""
    vocabulary = model[0]
    names, scores = ("▁", "a", "b", "▁a", "a▁", "a▁b", "ab", "b▁"), (-9.0, -9.0, -9.0, -3.0, -2.0, -1.0, -4.0, -5.0)
    own = pieces.Vocabulary(vocabulary.pieces[:259] + names, vocabulary.scores[:259] + scores, vocabulary.kinds[:259] + (1,) * len(names), 1, 2, "?")
    table = pieces.PrefixTable(own)
    known = dict(zip(names, scores, strict=True))
    for text in map("".join, itertools.product("ab c", repeat=5)):
        want = [own.pieces.index(p) if p in known else 3 + ord(p) for p in pieces.join_up(list("▁" + text.replace(" ", "▁")), known)]
        assert table.encode(text).tolist() == [1, *want, 2], text
