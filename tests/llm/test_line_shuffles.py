"""Texts of which nothing is deleted aren't dealt out."""

from __future__ import annotations

import pytest

from tracewright.llm import common, line_align

BLOCK = "\n".join(f"line {i} of a block that two documents share, word for word" for i in range(5))


@pytest.fixture
def docs(spark):
    rows = [(f"d{i:03}", f"words of text {i} alone\nand no more {i * i}") for i in range(200)]
    return spark.createDataFrame([*rows, ("e1", f"first\n{BLOCK}"), ("e2", f"{BLOCK}\nsecond"), (None, BLOCK), ("e3", None)], "doc_id string, text string")


def test_only_texts_that_are_cut_meet_a_join(spark, docs, monkeypatch):
    asked = []
    told = line_align.may_be_among

    def seen(ids, name):
        asked.append(ids.count())
        return told(ids, name)

    monkeypatch.setattr(line_align, "may_be_among", seen)
    got = line_align.dedup_lines(docs)
    assert {r["doc_id"]: (r["n_lines"], r["n_deleted"]) for r in got.filter("n_deleted > 0").collect()} == {"e2": (6, 5), None: (5, 5)}
    assert asked == [2]
    assert got.count() == 204
    assert {r["doc_id"]: r["text"] for r in got.collect() if r["n_deleted"]} == {"e2": "second", None: ""}


@pytest.mark.parametrize("bits", [1 << 26, 8])
def test_may_be_among_misses_none(spark, docs, monkeypatch, bits):
    monkeypatch.setattr(common, "BITS", bits)
    ids = docs.filter("text LIKE '%block%' OR text IS NULL").select("doc_id")
    got = {r["doc_id"] for r in docs.filter(common.may_be_among(ids, "doc_id")).collect()}
    assert got >= {"e1", "e2", "e3", None}
    assert bits == 8 or len(got) < 20
