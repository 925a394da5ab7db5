"""Operators on single texts, each against a plain version: 3, 6, 8, 9, 10."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pandas as pd
import public_tokenizers as P
import pytest
import tiktoken
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewright.llm import bpe, fertility, lengths, licenses, sharding
from tracewright.llm.words import repeated_words

MULTI, ENGLISH, PIECES = (P.path(x) for x in ("byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"))
TEXTS = [None, "", " ", "\n\n\n", "a", "Hello, world's  end\n\n now", "é́ ß 日本語 🇩🇪 x", "\x1c\x1d a\x1fb\x85c d", "word " * 300, "x" * 5000, "a\nb\na\nb\n\n", "　 x y"]


@pytest.fixture(scope="module")
def docs(spark):
    # other columns carry names that the operators compute
    data = [(i, t, ["en", None, "xx"][i % 3], "s", i, True) for i, t in enumerate(TEXTS)] + [(None, "no id", "en", "s", 1, True), (3, TEXTS[3], "en", "s", 1, True), (3, TEXTS[3], "en", "s", 1, True)]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_words long, kept boolean")


@pytest.fixture(scope="module")
def tok():
    return bpe.Tokenizer(MULTI, P.PATTERN)


@pytest.fixture(scope="module")
def other():
    v = bpe.Vocabulary.load(MULTI)
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=v.ranks, special_tokens={})


def test_bpe_table(spark, docs, other):
    got = bpe.encode_decode(docs, MULTI, P.PATTERN, with_ids=True).collect()
    assert len(got) == docs.count() and all(r.round_trip for r in got)
    for r, d in zip(sorted(got, key=repr), sorted(got, key=repr), strict=True):
        assert r == d
    by_id = {r.doc_id: r for r in got}
    for i, t in enumerate(TEXTS):
        ids = other.encode_ordinary(t or "")
        packed = b"".join(x.to_bytes(4, "little") for x in ids)
        assert (by_id[i].ids, by_id[i].n_tokens, by_id[i].ids_sha256) == (ids, len(ids), hashlib.sha256(packed).hexdigest())
        assert by_id[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.encode_decode(docs.limit(0), MULTI, P.PATTERN).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abethison  \n\t'sdlé1½,.!日　\x1c\x85​")), max_size=40))
def test_bpe_equals_library(tok, other, text):
    ids = other.encode_ordinary(text)
    assert tok.encode(text) == ids and tok.decode(ids) == text.encode()


def test_bpe_edits_equal_anew(tok):
    r = random.Random(5)
    alphabet = "abethison  \n's1é,"
    buf, text = bpe.TextBuffer(tok), ""
    for _ in range(120):
        i = r.randint(0, len(text))
        j = min(len(text), i + r.randint(0, 4))
        new = "".join(r.choice(alphabet) for _ in range(r.randint(0, 6)))
        text = text[:i] + new + text[j:]
        buf.edit(i, j, new)
        assert buf.text == text and buf.ids() == tok.encode(text)
    piece = bpe.PieceBuffer(tok.v, b"x" * 400)
    before = piece.steps
    piece.edit(10, 12, b"internationalisation")
    assert piece.steps - before < 120 and piece.ids() == tok.v.encode_piece(piece.data)
    piece.append(b"tion")
    assert piece.ids() == tok.v.encode_piece(piece.data)


def test_bpe_edit_is_local(tok):
    buf = bpe.TextBuffer(tok, "some words here " * 500)
    before = buf.steps
    buf.edit(4000, 4003, "zz")
    assert buf.steps - before < 12


def plain_quality(text):
    data = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", data) if w]
    seen, dup = set(), 0
    for line in data.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    wins = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {i + k for i in range(len(words) - 7) if wins[tuple(words[i : i + 8])] > 1 for k in range(8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", data)), dup, len(inside), len(words) < 20 or 100 * len(inside) > 30 * len(words)


def test_quality_base(spark, docs):
    r = random.Random(1)
    more = ["".join(r.choice(["ab ", "cd\n", "#", "é ", "x y z w v u t s ", "\n"]) for _ in range(r.randint(0, 60))) for _ in range(80)]
    d = spark.createDataFrame([(100 + i, t, "en") for i, t in enumerate(more)], "doc_id long, text string, lang string").unionByName(docs.select("doc_id", "text", "lang"))
    got = fertility.measure(d, PIECES, MULTI, P.PATTERN).collect()
    texts = {x.doc_id: x.text for x in d.collect()}
    assert len(got) == d.count()
    for x in got:
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) == plain_quality(texts[x.doc_id])
        assert not (x.base_failed and x.kept)
    assert fertility.measure(d.limit(0), PIECES, MULTI, P.PATTERN).count() == 0


def test_quality_tokens(spark):
    import math

    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    text = "The cat sat on the mat 日 and ☃ again the cat"
    ids = [t for w in text.split() for t in sp.encode(w)]
    n = Counter(ids)
    x = fertility.measure(spark.createDataFrame([(1, text, "en")], "doc_id long, text string, lang string"), PIECES, MULTI, P.PATTERN).first()
    assert x.n_tokens == len(ids) and x.fallback_share == pytest.approx(sum(sp.is_byte(t) for t in ids) / len(ids))
    assert x.token_entropy == pytest.approx(-sum(c / len(ids) * math.log2(c / len(ids)) for c in n.values()))
    assert x.chars_per_token == pytest.approx(len(text.replace(" ", "")) / len(ids))


def test_quality_keeps_good_and_rejects_noise(spark):
    sf = "/root/testdata/sf0.01"
    lab = spark.read.parquet(f"{sf}/labels.parquet")
    got = fertility.measure(spark.read.parquet(f"{sf}/documents.parquet"), PIECES, MULTI, P.PATTERN).join(lab, "doc_id").filter("NOT base_failed").toPandas()
    assert got[got.quality == 1].kept.mean() > 0.995 and got[got.quality == 0].kept.mean() < 0.4
    kept = fertility.select_kept(spark.read.parquet(f"{sf}/documents.parquet"), PIECES, MULTI, P.PATTERN)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_quality_without_a_known_language(spark):
    from pyspark.sql import functions as F

    sf = "/root/testdata/sf0.01"
    lab = spark.read.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet").join(lab, "doc_id")
    for lang in (F.lit(None).cast("string"), F.lit("xx"), F.concat(F.upper("lang"), F.lit("-US"))):
        got = fertility.measure(docs.withColumn("lang", lang), PIECES, MULTI, P.PATTERN, keep=("quality",)).filter("NOT base_failed").toPandas()
        assert got[got.quality == 1].kept.mean() > 0.995 and got[got.quality == 0].kept.mean() < 0.4
    band = lambda lang, text: fertility.band_of(fertility.BANDS, lang, text.encode())
    assert band("EN", "x") is band("en_GB", "日") is fertility.BANDS["en"]
    for text, script in {"これは日本のかなです": "kana", "это текст": "cyrillic", "昨天晚上 abc": "han", "Ça va très bien": "latin", "नई फिल्म": "indic", "새 영화": "hangul", "123 ::": "latin", "ሰላም": "other", "": "other"}.items():
        assert band(None, text) is band("xx", text) is fertility.BANDS[script], text


def plain_verdict(text, lang):
    """Base rules and bands, from the whole text by both libraries."""
    import math

    import sentencepiece

    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    if plain_quality(text)[-1]:
        return False
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    ids = [t for w in words for t in sp.encode(w)]
    ranks = bpe.Vocabulary.load(MULTI).ranks
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    band, chars, n = fertility.BANDS[lang], sum(map(len, words)), Counter(ids)
    entropy = -sum(c / len(ids) * math.log2(c / len(ids)) for c in n.values())
    at, floor = math.log2(len(ids)), band.floor
    least = floor[0][1] if at <= floor[0][0] else floor[-1][1]
    for (x, y), (z, w) in zip(floor, floor[1:], strict=False):
        if x < at <= z:
            least = y + (w - y) * (at - x) / (z - x)
    per, per_byte = chars / len(ids), chars / sum(len(enc.encode_ordinary(w)) for w in words)
    return band.min_chars <= per <= band.max_chars and band.byte_chars[0] <= per_byte <= band.byte_chars[1] and sum(map(sp.is_byte, ids)) / len(ids) <= band.max_fallback and entropy >= least


def test_quality_verdicts(spark):
    r = random.Random(2)
    vocabulary = [x.text for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40).collect() if x.text]
    texts = [t[: r.randint(100, 900)] for t in vocabulary] + [" ".join(r.choice(["☃", "#$", "ab1", "x"]) + str(r.randrange(k)) for _ in range(60)) for k in (2, 9, 99, 9999)]
    texts += [" ".join(r.choice("abc") for _ in range(n)) for n in (19, 20, 21, 63, 64, 65)] + [None, ""]
    data = [(i, t, ["en", "fr", "de", "es"][i % 4]) for i, t in enumerate(texts)]
    got = {x.doc_id: x.kept for x in fertility.measure(spark.createDataFrame(data, "doc_id long, text string, lang string"), PIECES, MULTI, P.PATTERN).collect()}
    want = {i: plain_verdict(t, lang) for i, t, lang in data}
    assert got == want and 10 < sum(want.values()) < len(want) - 10


def test_repeated_words_edges():
    import numpy as np

    assert repeated_words(np.array([], np.uint64), 8) == 0 and repeated_words(np.arange(8, dtype=np.uint64), 8) == 0
    assert repeated_words(np.array([7] * 9, np.uint64), 8) == 9


def plain_licenses(text):
    words = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    places = [(i, label) for p, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def plain_detections(text):
    """All rules tried on the joined words; what lies inside another of the same or a better tier goes."""
    words = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    plain = " " + " ".join(words) + " "
    found = [(m.start(), m.end(), r.tier, no, r.label) for no, r in enumerate(licenses.rules()) for m in re.finditer(f" (?:{r.pattern})(?= )", plain)]
    stand = [d for d in found if not any(e is not d and e[2] <= d[2] and e[0] <= d[0] and d[1] <= e[1] and ((e[0], e[1]) != (d[0], d[1]) or (e[2], e[3]) < (d[2], d[3])) for e in found)]
    return {x[4] for x in stand}


def sample(pattern):
    """A text that a rule's pattern matches: first alternatives, no optional parts."""
    from re import _parser

    def made(parts):
        out = ""
        for op, arg in parts:
            kind = str(op)
            if kind == "LITERAL":
                out += chr(arg)
            elif kind == "IN":
                out += chr(arg[0][1][0] if str(arg[0][0]) == "RANGE" else arg[0][1])
            elif kind == "BRANCH":
                out += made(arg[1][0])
            elif kind == "SUBPATTERN":
                out += made(arg[3])
            elif kind == "MAX_REPEAT":
                out += made(arg[2]) * arg[0]
        return out

    return made(_parser.parse(pattern))


def test_each_license_rule(spark):
    listed = licenses.rules()
    texts = [sample(r.pattern) for r in listed]
    for r, t in zip(listed, texts, strict=True):
        assert re.fullmatch(r.pattern, t), (r.pattern, t)
        assert any(f" {k} " in f" {t} " for k in r.keywords), (r.keywords, t)
    data = [(i, f"Some words; {t.title()}, and more.") for i, t in enumerate(texts)]
    got = {x.doc_id: x for x in licenses.scan(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    for i, r in enumerate(listed):
        mine = plain_detections(data[i][1])
        assert mine and mine <= set(got[i].labels.split(",")), (r.pattern, data[i][1])
        assert r.label in mine or any(x.tier <= r.tier for x in got[i].detections), r.pattern


def test_short_forms(spark):
    want = {"Released under GPLv3 or later.": "gpl-3.0", "LGPLv2.1": "lgpl-2.1", "licensed under the GPLv3": "gpl-3.0", "either version 2 of the License, or (at your option) any later version": "or-later-2", "MPLv2 file": "mpl-2.0"}
    got = licenses.scan(spark.createDataFrame(list(enumerate(want)), "doc_id long, text string")).orderBy("doc_id").collect()
    for x, label in zip(got, want.values(), strict=True):
        assert label in x.labels.split(","), x


def test_versions_suffixes_and_grants(spark):
    """Short versions, suffixes, bare names in grants, and versions inside grants: these labels and no vaguer ones beside the contract's."""
    want = {
        "GNU General Public License v3": "gpl,gpl-3.0",
        "GPL v2": "gpl-2.0",
        "LGPL v3": "lgpl-3.0",
        "Apache License v2": "apache-2.0",
        "Licensed under MIT": "mit",
        "GPL-3.0-or-later": "gpl-3.0-or-later",
        "SPDX-License-Identifier: LGPL-2.1-only": "lgpl-2.1-only",
        "licensed under the GPL version 2 or any later version": "gpl-2.0-or-later",
        "This work is licensed under a Creative Commons Attribution 4.0 International License": "cc-by-4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 3.0": "cc-by-nc-sa-3.0",
        "http://creativecommons.org/licenses/by-sa/4.0/": "cc-by-sa-4.0",
        "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3": "gfdl-1.3",
        "mit gutem Gruss": "",
    }
    got = licenses.scan(spark.createDataFrame(list(enumerate(want)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [x.labels for x in got] == list(want.values())


def test_licenses(spark, docs):
    written = len(licenses.WRITTEN) + len(licenses.OTHERS) + len(licenses.FAMILIES)
    assert written > 200 and len(licenses.rules()) > written
    r = random.Random(2)
    bits = ["CC BY", "CC-BY-NC 4.0.", "all rights reserved", "Licensed under the", "Apache License, Version 2.0", "GNU General Public License v3", "MIT License", "foo", "épl", "_cc_by_", "SPDX-License-Identifier: GPL-2.0", "public domain", "copyright 2020", "BSD 3-Clause", "\n", "GPL", "Released under the"]
    more = [" ".join(r.choice(bits) for _ in range(r.randint(1, 9))) for _ in range(60)] + ["All rights reserved. " * 1300]
    d = spark.createDataFrame([(100 + i, t) for i, t in enumerate(more)], "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    texts = {x.doc_id: x.text for x in d.collect()}
    got = licenses.scan(d).collect()
    assert len(got) == d.count()
    for x in got:
        n, places, first, last, labels = plain_licenses(texts[x.doc_id])
        assert (x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels) == (n, places, first, last, labels), texts[x.doc_id]
        assert 0 <= x.score <= 1
        if places < 1000:
            assert set(filter(None, x.labels.split(","))) == set(filter(None, labels.split(","))) | plain_detections(texts[x.doc_id]), texts[x.doc_id]
    assert licenses.scan(d.limit(0)).count() == 0


def test_lengths(spark, docs):
    v = bpe.Vocabulary.load(ENGLISH)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=v.ranks, special_tokens={})
    n = sorted(len(enc.encode_ordinary(x.text or "")) for x in docs.collect())
    h = lengths.histogram(docs, ENGLISH, P.PATTERN)
    for x in h.collect():
        assert (x.n_docs, x.docs_from, x.docs_upto) == (n.count(x.length), sum(k >= x.length for k in n), sum(k <= x.length for k in n))
        assert (x.n_tokens, x.tokens_from, x.truncated_total) == (x.length * x.n_docs, sum(k for k in n if k >= x.length), sum(min(k, x.length) for k in n))
    for limit in (0, 1, 7, 1000, 10**6):
        assert lengths.truncated_total(h, limit) == sum(min(k, limit) for k in n)
    assert lengths.quantile(h, 0.5) == n[(len(n) + 1) // 2 - 1] and lengths.quantile(h, 1.0) == n[-1]
    none = lengths.histogram(docs.limit(0), ENGLISH, P.PATTERN)
    assert none.count() == 0 and lengths.quantile(none, 0.5) is None and lengths.truncated_total(none, 5) == 0


def test_sharding(spark, docs, tmp_path):
    got = sharding.shard(docs, 4, str(tmp_path / "map"), n_slots=64).toPandas()
    assert len(got) == docs.count()
    texts = {x.doc_id: x.text for x in docs.collect()}
    for i, size, crc in zip(got.doc_id, got["size"], got.text_crc32, strict=True):
        data = (texts[None if pd.isna(i) else int(i)] or "").encode()
        assert (size, crc) == (len(data) + 16, zlib.crc32(data))
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    first, last = sharding.SlotMap.load(spark, str(tmp_path / "map"), 0), sharding.SlotMap.load(spark, str(tmp_path / "map"))
    assert first.version == 0 and last.version == 1 and first.shard[5] == 1
    assert (got.shard == got.virtual_slot.map(lambda s: last.shard[s])).all()
    assert sharding.shard(docs.limit(0), 4, n_slots=64).count() == 0


def test_maps_cut_short_are_passed_over(spark, docs, tmp_path):
    path = str(tmp_path / "map")
    sharding.shard(docs, 4, path, n_slots=64)
    left = tmp_path / "map" / "version=00000007"
    left.mkdir()
    (left / "part-00000.parquet").write_bytes(b"PAR1")
    assert sharding.versions(spark, path) == {0: True, 1: True, 7: False} and sharding.stored(spark, path).version == 1
    got = sharding.shard(docs, 5, path, n_slots=64).toPandas()
    assert set(got.map_version) == {8} and sharding.stored(spark, path).n_shards == 5 and len(got) == docs.count()
    empty = tmp_path / "none"
    (empty / "version=00000000").mkdir(parents=True)
    assert sharding.stored(spark, str(empty)) is None
    assert set(sharding.shard(docs, 4, str(empty), n_slots=64).toPandas().map_version) == {2}


def test_repeats_spread_joined_or_broadcast(spark, monkeypatch):
    """Rows of up to REPEATS copies share a slot, more are dealt over all, whichever way they are told."""
    few, many = [(1, "a")] * 16 + [(None, None)] * 16, [(2, "b")] * 400 + [(None, "c")] * 300
    d = spark.createDataFrame(few + many, "doc_id long, text string").repartition(3)
    for most in (sharding.MOST_BROADCAST, 0):
        monkeypatch.setattr(sharding, "MOST_BROADCAST", most)
        slots = {}
        for x in sharding.records(d, 64).collect():
            slots.setdefault((x.doc_id, x.text_crc32), []).append(x.virtual_slot)
        sizes = {k: (len(v), len(set(v))) for k, v in slots.items()}
        assert sizes[(1, zlib.crc32(b"a"))] == (16, 1) and sizes[(None, 0)] == (16, 1)
        assert sizes[(2, zlib.crc32(b"b"))][0] == 400 and sizes[(2, zlib.crc32(b"b"))][1] > 50
        assert sizes[(None, zlib.crc32(b"c"))][0] == 300 and sizes[(None, zlib.crc32(b"c"))][1] > 50


def test_rebalance():
    r = random.Random(3)
    weight = [r.randint(1, 10_000) for _ in range(2048)]
    m = sharding.SlotMap.first(2048, 40).rebalance(weight)
    load = [0] * 40
    for s, w in zip(m.shard, weight, strict=True):
        load[s] += w
    assert max(load) - min(load) < 0.001 * sum(load) / 40
    fewer = m.rebalance(weight, 39)
    assert set(fewer.shard) == set(range(39)) and fewer.version == 2
    assert sharding.SlotMap.first(8, 3).rebalance([0] * 8).shard == sharding.SlotMap.first(8, 3).shard


def test_shards_near_equal_on_documents(spark):
    from pyspark.sql import functions as F

    got = sharding.shard(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), 40)
    low, high = rows(got.groupBy("shard").agg(F.sum("size").alias("b")).agg(F.min("b"), F.max("b")))[0]
    assert high - low < 0.02 * high
