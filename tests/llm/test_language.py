"""Language identification: held-out accuracy, families, duels, odd rows."""

import os
import random

import numpy as np
import pytest
from conftest import rows

from tracewright.llm import language

DATA = "/root/testdata/sf0.01/documents.parquet"
SCHEMA = "doc_id long, text string, lang string, source string, score double"


def invented(lang, r):
    """Two families of two languages: families share letters, languages of one share most endings."""
    stems = {"a": "blor dran fesk gilt hulm".split(), "b": "quio zexa yova ixu peqa".split()}[lang[0]]
    ends = {"a1": ["en", "er", "ung", "ist"], "a2": ["en", "er", "ong", "ast"], "b1": ["a", "o", "xi", "ez"], "b2": ["a", "o", "xu", "oz"]}[lang]
    return " ".join(r.choice(stems) + r.choice(ends) for _ in range(r.randint(4, 40)))


def some_docs(n=400, seed=1):
    r = random.Random(seed)
    return [(i, invented(k := r.choice(["a1", "a2", "b1", "b2"]), r), k if r.random() < 0.9 else None, "s", 1.0) for i in range(n)], r


def test_families_and_duels(spark):
    docs, r = some_docs()
    df = spark.createDataFrame(docs, SCHEMA).repartition(5)
    model = language.learn(df)
    assert sorted(map(sorted, model.members)) == [["a1", "a2"], ["b1", "b2"]]
    assert [len(pairs) for pairs, *_ in model.duels] == [1, 1]
    texts = [(k, invented(k, r)) for k in ["a1", "a2", "b1", "b2"] * 50]
    got = model.predict([language.counts(t) for _, t in texts])
    assert sum(a == k for (a, _), (k, _) in zip(got, texts, strict=True)) >= 198
    assert all(0 <= s <= 1 for _, s in got)


def test_odd_rows_have_answers(spark):
    docs, _ = some_docs(150)
    odd = [(None, "blorung dranung", "a1", "s", 0.0), (1000, None, "a1", "s", 0.0), (1001, "", "a1", "s", 0.0), (1002, "12 -- 34\n", "a1", "s", 0.0), (1003, "blorung " * 300_000, None, "s", 0.0), (1004, "blorung " * 3, None, "s", 0.0), (1004, "blorung " * 3, None, "s", 0.0)]
    got = {}
    for g in language.identify(spark.createDataFrame(docs + odd, SCHEMA).repartition(4)).collect():
        got.setdefault(g.doc_id, []).append(g)
    assert sum(map(len, got.values())) == len(docs) + len(odd)
    assert [got[i][0].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1000][0].score == 0
    assert got[None][0].held_out is False and len(got[1004]) == 2 and got[1004][0] == got[1004][1]
    assert got[1003][0].lang_pred == got[1004][0].lang_pred == "a1"


def test_without_labels_and_rows(spark):
    assert rows(language.identify(spark.createDataFrame([], SCHEMA))) == []
    none = language.identify(spark.createDataFrame([(2, "some words", None, "s", 0.0), (3, None, "en", "s", 0.0)], SCHEMA)).collect()
    assert {(g.lang_pred, g.score) for g in none} == {("und", 0.0)}
    one = language.identify(spark.createDataFrame([(i, "some words", "en", "s", 0.0) for i in range(9)], SCHEMA)).collect()
    assert {g.lang_pred for g in one} == {"en"}


def test_held_out_rows_and_ids_teach_nothing(spark):
    docs, _ = some_docs(200)
    wrong = [(i, t, ("b2" if language_held(i) else k), "zz", 3.0) for i, t, k, *_ in docs]
    got = [rows(language.identify(spark.createDataFrame(d, SCHEMA)).select("doc_id", "lang_pred", "score")) for d in (docs, wrong)]
    assert got[0] == got[1]


def language_held(i):
    import zlib

    return zlib.crc32(str(i).encode()) % 3 == 1


def test_counts_of_slices_are_those_of_the_whole(monkeypatch):
    r = random.Random(3)
    text = "".join(r.choice("abcdé 12  .𝄞ÀŁ") for _ in range(5000))
    whole = language.counts(text)
    for size in (1, 2, 3, 7, 1000):
        monkeypatch.setattr(language, "SLICE", size)
        assert (language.counts(text) == whole).all()


def test_separator_is_the_best_one():
    """The dual solution satisfies the optimality conditions of the primal."""
    r = np.random.default_rng(2)
    rows_, signs = [], np.array([1.0, -1.0] * 30)
    for s in signs:
        v = r.standard_normal(6) + s
        rows_.append((np.arange(6), v / np.linalg.norm(v)))
    w, bias = language.separator(rows_, signs)
    slope = np.append(w[:6], bias)
    for (_, v), s in zip(rows_, signs, strict=True):
        slope -= 2 * language.PENALTY * max(0, 1 - s * (w[:6] @ v + bias)) * s * np.append(v, 1)
    assert np.abs(slope).max() < 1e-3 * 2 * language.PENALTY * len(rows_)


@pytest.mark.skipif(not os.path.exists(DATA), reason="needs the test tables")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(DATA)
    got = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out AND lang IS NOT NULL AND lang_pred <> 'und'").collect()
    assert sum(g.lang == g.lang_pred for g in got) / len(got) >= 0.97
