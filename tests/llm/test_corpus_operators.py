"""Operators over many texts, each against a plain version: 1, 2, 4, 5, 7, and the pipeline."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from conftest import rows

from tracewright.llm import chunks, line_align, mixing, ngram_join, ngram_lm
from tracewright.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, kept boolean, n long"


def frame(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, ["en", "fr", None][k % 3], ["a", "b", None, "a"][k % 4], True, 1) for k, (i, t) in enumerate(zip(ids, texts, strict=True))], SCHEMA)


def some_texts(seed, n=60):
    """Texts with copies, near copies, empty ones, short ones and shared passages."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    make = lambda k: [r.choice(words) for _ in range(k)]
    base = [make(r.randint(1, 90)) for _ in range(n // 2)]
    passage = make(40)
    out = []
    for b in base:
        out.append(" ".join(b))
        near = list(b)
        for _ in range(r.randint(0, 3)):
            near[r.randrange(len(near))] = r.choice(words)
        out.append(" ".join(near).title() if r.random() < 0.5 else " ".join(near + make(r.randint(0, 5))))
        if r.random() < 0.3:
            out.append(" ".join(make(10) + passage + make(10)))
    return out + [None, "", " \n", "one", "One", "two words", out[0], out[0]]


def plain_set(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    return {tuple(words)} if 0 < len(words) < 5 else {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def plain_classes(texts, ids):
    sets = [plain_set(t) for t in texts]
    of = list(range(len(sets)))

    def find(i):
        while of[i] != i:
            i = of[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                of[find(i)] = find(j)
    low = {}
    for i, x in enumerate(ids):
        if x is not None:
            low[find(i)] = min(low.get(find(i), x), x)
    return [(x, len(sets[i]), low.get(find(i))) for i, x in enumerate(ids)]


@pytest.mark.parametrize("seed", range(3))
def test_join_equals_all_pairs(spark, seed):
    texts = some_texts(seed)
    ids = list(range(len(texts)))
    random.Random(seed).shuffle(ids)
    ids[3] = None
    got = rows(ngram_join.join(frame(spark, texts, ids).repartition(3), most_frequent=[1 << 20, 8, 0][seed], name_bits=[64, 6, 64][seed]))
    assert got == sorted(plain_classes(texts, ids), key=repr)


def test_join_of_many_near_copies(spark):
    r = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(120):
        t = list(base)
        for _ in range(r.randint(1, 4)):
            t[r.randrange(120)] = f"x{r.randrange(10**6)}"
        texts.append(" ".join(t))
    want = sorted(plain_classes(texts, list(range(120))), key=repr)
    assert rows(ngram_join.join(frame(spark, texts))) == want
    assert rows(ngram_join.join(frame(spark, texts), hot=16)) == want


def edited(r, base, least, most):
    t = list(base)
    for _ in range(r.randint(least, most)):
        at = r.randrange(len(t))
        t[at : at + r.randint(0, 1)] = [f"x{r.randrange(10**6)}"] if r.random() < 0.8 else []
    return " ".join(t)


def test_join_of_copies_of_unequal_size_near_the_threshold(spark):
    for seed in range(2):
        r = random.Random(seed)
        base = [f"w{i}" for i in range(100)]
        texts = [edited(r, base, 1, 6) for _ in range(110)] + [" ".join(base[: r.randint(75, 99)]) for _ in range(10)]
        assert rows(ngram_join.join(frame(spark, texts))) == sorted(plain_classes(texts, list(range(120))), key=repr)


def test_pairs_of_a_group_of_near_copies_follow_the_group(spark):
    r = random.Random(3)
    base, made = [f"w{i}" for i in range(140)], []
    for n in (150, 300):
        texts = [edited(r, base, 1, 5) for _ in range(n)]
        sets = {k: ngram_join.shingles(t.encode()) for k, t in enumerate(texts)}
        first = min(sets)
        members = spark.createDataFrame([(first, len(sets[first]), k, len(x), k) for k, x in sets.items()], "r long, rn int, key long, n int, cls long")
        diffs = ngram_join._differences(members, spark.createDataFrame([(k, x.tobytes()) for k, x in sets.items()], "key long, set binary"))
        diffs = ngram_join._to_center(diffs, ngram_join._centers(diffs)).cache()
        linked = {x.key for x in diffs.collect() if len(x.rem) <= x.cn - ngram_join.least_overlap(x.n, x.cn)}
        classes = spark.createDataFrame([(k, min(linked)) for k in linked], "node long, label long")
        made.append(ngram_join._by_difference(ngram_join._reclassed(diffs, classes)).count())
    assert made[1] < 2.5 * max(made[0], n)


def test_halves_of_sets_settle_pairs(spark):
    r = random.Random(5)
    s = np.unique(np.array([r.getrandbits(64) for _ in range(70)], np.uint64))
    sets = [s, np.concatenate([s[:60], np.array([r.getrandbits(64) for _ in range(10)], np.uint64)]), s[:65], s[:40]]
    other = s.copy()
    other[:9] += np.uint64(1)  # the upper halves agree, the entries don't: 61 shared of 70, at the threshold
    third = s.copy()
    third[:11] += np.uint64(1)
    sets = [np.sort(x) for x in [*sets, other, third]]
    frame_of = spark.createDataFrame([(k, x.tobytes()) for k, x in enumerate(sets)], "key long, set binary")
    pairs = spark.createDataFrame([(0, k) for k in range(1, 6)], "a long, b long")
    judged = {x.b: x.sure for x in ngram_join._judged(pairs, ngram_join._halves(frame_of)).collect()}
    assert 3 not in judged and judged[2] and judged[1] is False
    assert ngram_join.doubt(10, 10) <= ngram_join.doubt(1000, 1000) <= 6
    assert sorted(tuple(x) for x in ngram_join._linked(pairs, frame_of).collect()) == [(0, k) for k in range(1, 6) if 4 * len(set(sets[0]) & set(sets[k])) >= 3 * len(set(sets[0]) | set(sets[k]))]


def test_join_edges(spark):
    assert ngram_join.join(frame(spark, [])).count() == 0
    assert rows(ngram_join.join(frame(spark, [None, "", None], [1, None, 1]))) == [(1, 0, 1), (1, 0, 1), (None, 0, None)]
    kept = ngram_join.representatives(frame(spark, ["a b", "A b", "a b", "c", "c", ""], [2, 1, 1, 5, 5, 7]))
    assert kept.columns == ["doc_id", "text", "lang", "source", "kept", "n"] and sorted(r.doc_id for r in kept.collect()) == [1, 5, 7]


def test_prefixes_and_sketches_are_safe():
    r = random.Random(4)
    for _ in range(300):
        n, m = r.randint(1, 60), r.randint(1, 60)
        need = ngram_join.least_overlap(n, m)
        assert 4 * need >= 3 * (n + m - need) and not (need > 0 and 4 * (need - 1) >= 3 * (n + m - need + 1))
        a = np.unique(np.array([r.getrandbits(64) for _ in range(n)], np.uint64))
        b = np.unique(np.concatenate([r.choice([a, a[:1]]), np.array([r.getrandbits(64) for _ in range(r.randint(0, 9))], np.uint64)]))
        apart = np.bitwise_count(np.frombuffer(ngram_join.sketch(a), np.uint8) ^ np.frombuffer(ngram_join.sketch(b), np.uint8)).sum()
        assert apart <= len(np.setxor1d(a, b))


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 7)]
    got = dict(rows(components(spark.createDataFrame(edges, "a long, b long"))))
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("bits", [64, 3])
def test_exact_dedup(spark, bits):
    r = random.Random(6)
    long = "".join(r.choice("abcdefgh \n") for _ in range(30_000))
    texts = [None, "", " ", "\t\n", "a b", "a\n\nb", " a b", "a b ", long, long.replace("\n", "  "), long[:-1] + "z", "x" * 9000, "x" * 9000, "y", None]
    ids = [5, 4, 3, 2, 9, 8, 7, 6, 20, 12, 13, 14, 15, None, 5]
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in texts]
    got = chunks.dedup(frame(spark, texts, ids).repartition(3), hash_bits=bits).collect()
    assert len(got) == len(texts)
    for x in got:
        text = next(norm[k] for k, i in enumerate(ids) if i == x.doc_id)
        mine = [ids[k] for k in range(len(texts)) if norm[k] == text]
        assert x.group_size == len(mine) and x.keep_id == min((i for i in mine if i is not None), default=None)
        assert x.text_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert sum(x.kept for x in got) == len(set(norm)) and all(x.doc_id == x.keep_id for x in got if x.kept)
    assert chunks.dedup(frame(spark, []), hash_bits=bits).count() == 0


def test_chunks_follow_content():
    r = random.Random(8)
    data = bytes(r.randrange(97, 123) for _ in range(60_000))
    a, b = (dict(chunks.chunk(x)) for x in (data, b"inserted here" + data))
    assert len(a.keys() & b.keys()) > 0.8 * len(a)
    for size in (0, 1, 511, 512, 513, 20_000):
        assert b"".join(p for _, p in chunks.chunk(data[:size])) == data[:size]
    assert all(512 <= len(p) <= 8192 for _, p in chunks.chunk(data)[:-1])


def bounds_of_line_dedup(texts, least=30):
    """Of texts in their order: lines that must go (in a common block with an earlier text, all of whose lines occur once
    in both), and lines that may (in any run of least words that an earlier text has too)."""
    lines = [(t or "").split("\n") for t in texts]
    words = [[len(x.split()) for x in ls] for ls in lines]
    plain = [[x if x.split() else "" for x in ls] for ls in lines]
    must, may = [set() for _ in texts], [set() for _ in texts]
    for d, own in enumerate(plain):
        for other in plain[:d]:
            for s in range(len(own)):
                for t in range(len(other)):
                    n = 0
                    while s + n < len(own) and t + n < len(other) and own[s + n] == other[t + n]:
                        n += 1
                    if sum(words[d][s : s + n]) >= least:
                        may[d] |= set(range(s, s + n))
            if all(own.count(x) == 1 == other.count(x) for x in set(own) & set(other)) and (both := [(k, other.index(x)) for k, x in enumerate(own) if x in other]) == sorted(both, key=lambda p: p[1]):
                for s, t in both:
                    n = 0
                    while (s + n, t + n) in both:
                        n += 1
                    if sum(words[d][s : s + n]) >= least:
                        must[d] |= set(range(s, s + n))
    return must, may


def test_line_dedup_against_common_runs(spark):
    r = random.Random(5)
    pool = [" ".join(f"w{i}x{k}" for k in range(r.choice([4, 9, 16, 31]))) for i in range(40)]
    texts = []
    for _ in range(120):
        s = r.randrange(len(pool) - 6)
        texts.append("\n".join([f"own {r.random()}"] * r.randint(0, 1) + pool[s : s + r.randint(1, 6)] + r.sample(pool, r.randint(0, 3))))
    must, may = bounds_of_line_dedup(texts)
    got = {x.doc_id: set(x.deleted) for x in line_align.dedup_lines(frame(spark, texts)).collect()}
    assert all(must[i] <= got[i] <= may[i] for i in got) and sum(map(bool, must)) > 40


def test_line_dedup_in_company(spark):
    """More documents never make less go: an eight-line block goes whatever else holds its lines."""
    block = [" ".join(f"b{i}w{k}" for k in range(10)) for i in range(8)]
    texts = ["\n".join(["first", *block]), *[f"short {k}\n{block[k % 8]}" for k in range(16)], "\n".join([*block, "last"])]
    got = {x.doc_id: x.deleted for x in line_align.dedup_lines(frame(spark, texts)).collect()}
    assert got[17] == list(range(8)) and not any(got[i] for i in range(17))


def plain_line_dedup(texts, ids, least=30):
    """All pairs aligned."""
    order = sorted(set(zip([i is None for i in ids], [i or 0 for i in ids], texts, strict=True)), key=lambda x: (x[0], x[1]))
    gone = all_pairs_line_dedup([t or "" for _, _, t in order], least)
    return {x: ("\n".join(y for k, y in enumerate((x[2] or "").split("\n")) if k not in gone[d]), gone[d]) for d, x in enumerate(order)}


def test_line_dedup(spark):
    r = random.Random(7)
    pool = [" ".join(r.choice("abcdefghij") + str(r.randrange(50)) for _ in range(r.randint(1, 14))) for _ in range(60)] + ["", " "]
    block = [pool[i] for i in range(12)]
    texts = []
    for k in range(50):
        own = [f"own {k} {i} " + r.choice(pool) for i in range(r.randint(0, 6))]
        ls = own + (block[r.randint(0, 4) :] if r.random() < 0.5 else []) + [r.choice(pool) for _ in range(r.randint(0, 6))]
        texts.append("\n".join(ls))
    texts += [None, "", texts[3], texts[3], "one " * 40, "one " * 40]
    ids = list(range(len(texts)))
    ids[-3] = 52
    want = plain_line_dedup(texts, ids)
    got = line_align.dedup_lines(frame(spark, texts, ids)).collect()
    assert len(got) == len(texts)
    for x in got:
        options = [v for (n, i, t), v in want.items() if i == x.doc_id]
        text, gone = next(v for v in options if v[1] == x.deleted)
        assert (x.text or "") == text and x.n_deleted == len(gone)
    assert any(x.n_deleted for x in got)
    assert line_align.dedup_lines(frame(spark, [])).count() == 0
    left = line_align.cleaned(frame(spark, ["a " * 40, "a " * 40, None, " "]))
    assert sorted(r.doc_id for r in left.collect()) == [0, 2, 3]


def test_line_dedup_of_frequent_passage(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [f"head {i} x y\n{passage}\ntail {i}" for i in range(90)]
    got = {r.doc_id: r for r in line_align.dedup_lines(frame(spark, texts)).collect()}
    assert got[0].n_deleted == 0 and all(got[i].deleted == [1] for i in range(1, 90))
    few = [f"head {i}\nshort line\ntail {i}" for i in range(9)]
    assert all(r.n_deleted == 0 for r in line_align.dedup_lines(frame(spark, few)).collect())


def all_pairs_line_dedup(texts, least=30):
    lines = [t.split("\n") for t in texts]
    code = {}
    hashed = [[code.setdefault(x, len(code) + 1) if x.split() else 0 for x in ls] for ls in lines]
    words = [[len(x.split()) for x in ls] for ls in lines]
    return [sorted({p for e in range(d) for a, b in line_align.common_blocks(hashed[d], words[d], hashed[e], least) for p in range(a, b)}) for d in range(len(texts))]


def test_line_dedup_finds_every_earlier_holder(spark):
    x, y = (" ".join(f"{c}{i}" for i in range(20)) for c in "xy")
    texts = [x, y, *[f"own text {i}\n{x}\n{y}" for i in range(69)]]
    got = {r.doc_id: r.deleted for r in line_align.dedup_lines(frame(spark, texts)).collect()}
    assert not got[0] and not got[1] and not got[2] and all(got[i] == [1, 2] for i in range(3, 71))


def test_line_dedup_equals_all_pairs(spark):
    r = random.Random(12)
    pool = [" ".join(f"w{i}x{k}" for k in range(r.choice([3, 8, 20, 31]))) for i in range(14)] + ["", " "]
    texts = ["\n".join(r.choice(pool) for _ in range(r.randint(1, 9))) for _ in range(160)]
    got = {x.doc_id: x.deleted for x in line_align.dedup_lines(frame(spark, texts)).collect()}
    want = all_pairs_line_dedup(texts)
    assert [got[i] for i in range(len(texts))] == want and sum(map(bool, want)) > 50


def test_long_runs_of_blank_lines_end():
    blank = [0] * 200_000
    words = lambda seq: [3 * (x > 0) for x in seq]
    a = [1, *blank, 2]
    assert line_align.common_blocks(a, words(a), [2, *blank, 1]) == []
    a = [1, *blank, *[2] * 40]
    (lo, hi), = line_align.common_blocks(a, words(a), [5, *[2] * 45, *blank])
    assert a[lo:hi].count(2) == 40
    a = [k % 10_000 == 0 for k in range(200_000)]  # words far apart, no line that occurs once
    assert line_align.common_blocks([*a, 7], words([*a, 7]), [8, *a]) != []


def test_patience():
    assert line_align.patience([1, 2, 3, 4], [1, 9, 3, 4]) == [(0, 0), (2, 2), (3, 3)]
    assert line_align.patience([5, 1, 2, 3], [1, 2, 3, 5]) in ([(1, 0), (2, 1), (3, 2)], [(0, 3)])
    assert line_align.patience([], [1]) == []
    assert line_align.patience([9, 1, 2, 1, 2, 8], [7, 1, 2, 1, 2, 6]) == [(k, k) for k in range(1, 5)]
    assert line_align.common_blocks([9, 1, 2, 1, 2, 8], [5, 9, 9, 9, 9, 5], [7, 1, 2, 1, 2, 6]) == [(1, 5)]
    r = random.Random(1)
    for _ in range(200):
        a, b = ([r.randrange(8) for _ in range(r.randrange(12))] for _ in range(2))
        got = line_align.patience(a, b)
        assert all(a[i] == b[j] for i, j in got) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:], strict=False))


def plain_scores(texts, target):
    split = lambda t: [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]
    pairs = lambda t: list(zip([None, *split(t)], split(t), strict=False))
    counts = [Counter(w for t in ts for w in split(t)) for ts in (target, texts)]
    listed = {w for c in counts for w in c if c[w] >= 2}

    def model(ts, word):
        c, total = Counter(p for t in ts for p in pairs(t)), sum(word.values())
        texts_with_words, unknown = sum(1 for t in ts if split(t)), sum(k for w, k in word.items() if w not in listed)

        def loss(a, b):
            single = ((word[b] if b in listed else unknown) + 0.5) / (total + 0.5 * (len(listed) + 1))
            before = texts_with_words if a is None else word[a]
            return -math.log(0.7 * c[a, b] / before + 0.3 * single if before and b in listed and (a is None or a in listed) else single)

        return loss

    t, b = model(target, counts[0]), model(texts, counts[1])
    out = []
    for x in texts:
        p = pairs(x)
        out.append((len(p), sum(t(*q) for q in p) / len(p), sum(b(*q) for q in p) / len(p)) if p else (0, None, None))
    return out


def test_cross_entropy_difference(spark):
    texts = some_texts(3, 20)
    for target in (texts[:15] + texts[:2], ["own words w1 w2 w1 w2", None], []):
        want = plain_scores(texts, target)
        got = {r.doc_id: r for r in ngram_lm.score(frame(spark, texts), frame(spark, target)).collect()}
        for i, (n, t, b) in enumerate(want):
            assert got[i].n_tokens == n
            if n:
                assert (got[i].target_loss, got[i].background_loss, got[i].ce_diff) == (pytest.approx(t), pytest.approx(b), pytest.approx(t - b))
            else:
                assert got[i].ce_diff is None
    assert ngram_lm.score(frame(spark, []), frame(spark, [])).count() == 0


def test_cross_entropy_over_buckets():
    r = random.Random(5)
    hashes = np.unique(np.array([r.getrandbits(64) for _ in range(500)], np.uint64))
    assert (ngram_lm.from_rising(ngram_lm.rising(hashes)) == hashes).all() and len(ngram_lm.from_rising(ngram_lm.rising(hashes[:0]))) == 0
    ends = ngram_lm._dealt(hashes, 7)
    assert [int(h) * 7 >> 64 for h in hashes] == [k for k in range(7) for _ in range(ends[k + 1] - ends[k])]


def test_cross_entropy_of_a_large_vocabulary(spark):
    r = random.Random(5)
    pool = [f"w{i}" for i in range(3000)]
    target = [" ".join(r.sample(pool, len(pool))) for _ in range(2)]
    common = " ".join(["w"] * 3)
    texts = [*target, f"{common} w2900 w2999 w2500", f"{common} w2900 w2999 never", "w2999", None]
    want = plain_scores(texts, target)
    got = {x.doc_id: x for x in ngram_lm.score(frame(spark, texts), frame(spark, target)).collect()}
    for i, (n, t, b) in enumerate(want[:-1]):
        assert (got[i].n_tokens, got[i].target_loss, got[i].background_loss) == (n, pytest.approx(t), pytest.approx(b))
    assert got[2].ce_diff != pytest.approx(got[3].ce_diff) and got[5].n_tokens == 0 and got[5].ce_diff is None


def test_score_tells_noise_from_good(spark):
    from tracewright.llm.queries import op1_cross_entropy_difference

    sf = "/root/testdata/sf0.01"
    got = op1_cross_entropy_difference(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("n_tokens > 30").toPandas()
    good = got[(got.quality == 1) & (got.toxic == 0)].ce_diff
    bad = got[(got.quality == 0) | (got.toxic == 1)].ce_diff
    assert (good.to_numpy()[:, None] < bad.to_numpy()[None, :]).mean() > 0.95


def test_rake_and_calibrate():
    tokens = np.array([100.0, 50.0, 0.0, 10.0, 40.0])
    codes = [np.array([0, 0, 1, 1, 1]), np.array([0, 1, 0, 1, 1])]
    targets = [np.array([0.5, 0.5]), np.array([0.6, 0.4])]
    share = mixing.rake(tokens, codes, [targets[0], np.array([0.3, 0.7])])
    assert np.bincount(codes[0], share) == pytest.approx([0.5, 0.5]) and np.bincount(codes[1], share) == pytest.approx([0.3, 0.7]) and share[2] == 0
    full = np.array([80.0, 20.0, 30.0, 10.0, 40.0])
    share = mixing.rake(full, codes, targets)
    for code, target in zip(codes, targets, strict=True):
        assert np.bincount(code, share) == pytest.approx(target, abs=1e-8)
    for part in (0.05, 0.4, 0.8, 0.99, 1.0):
        p = mixing.calibrate(full, share, part)
        assert (p * full).sum() == pytest.approx(part * full.sum()) and p.max() <= 1
    assert mixing.calibrate(np.zeros(2), np.zeros(2), 0.5).tolist() == [0, 0]


def test_raking_reports_no_convergence(spark):
    import inspect

    assert inspect.signature(mixing._fit_as_table).parameters["rounds"].default == mixing.ROUNDS
    tokens, codes = np.array([80.0, 20.0, 30.0]), [np.array([0, 0, 1]), np.array([0, 1, 0])]
    with pytest.warns(RuntimeWarning, match="after 2 rounds"):
        mixing.rake(tokens, codes, [np.array([0.5, 0.5]), np.array([0.6, 0.4])], rounds=2)
    cells = spark.createDataFrame([("a", "x", "p", 80), ("a", "y", "p", 20), ("b", "x", "p", 30)], "source string, lang string, topic string, tokens long")
    with pytest.warns(RuntimeWarning, match="after 2 rounds"):
        mixing._fit_as_table(cells, None, 0.5, rounds=2)


def test_mix(spark):
    r = random.Random(2)
    texts = [" ".join(["w"] * r.randint(1, 40)) for _ in range(400)] + [None, "", "mail a@b.c now", "licensed under x"]
    d = frame(spark, texts)
    got = mixing.mix(d, part=0.5).toPandas()
    assert len(got) == len(texts) and set(got.source) == {"a", "b", "(none)"} and set(got.lang) == {"en", "fr", "(none)"}
    assert got.n_tokens.tolist() == [len((t or "").split()) for t in (texts[i] for i in got.doc_id)]
    assert (got.p * got.n_tokens).sum() == pytest.approx(0.5 * got.n_tokens.sum())
    cells = got.drop_duplicates(["source", "lang", "topic"])
    for m, power in mixing.POWERS.items():
        own = mixing.tempered(got.groupby(m).n_tokens.sum().to_dict(), power)
        for k, v in cells.groupby(m).cell_share.sum().items():
            assert v == pytest.approx(own[k], abs=2e-3)
    again = mixing.mix(d.repartition(7), part=0.5, most_cells=1).toPandas().sort_values("doc_id")
    near = again.merge(got, on="doc_id")
    assert (near.p_x - near.p_y).abs().max() < 1e-6
    # plain raking of the cells' shares, and a plain search for the scale
    totals, shares = {}, {}
    for x in got.itertuples():
        totals[x.source, x.lang, x.topic] = totals.get((x.source, x.lang, x.topic), 0) + x.n_tokens
    shares = {c: n / sum(totals.values()) for c, n in totals.items()}
    for _ in range(3000):
        for k, m in enumerate(mixing.MARGINS):
            now = {}
            for c, v in shares.items():
                now[c[k]] = now.get(c[k], 0) + v
            own = mixing.tempered(got.groupby(m).n_tokens.sum().to_dict(), mixing.POWERS[m])
            live = sum(own[v] for v in now if now[v] > 0)
            shares = {c: v * own[c[k]] / live / now[c[k]] if now[c[k]] else 0.0 for c, v in shares.items()}
    scale = lambda c: sum(min(1.0, c * shares[x] / n) * n for x, n in totals.items() if n)
    low, high = 0.0, 1e9
    for _ in range(200):
        low, high = ((low + high) / 2, high) if scale((low + high) / 2) < 0.5 * sum(totals.values()) else (low, (low + high) / 2)
    for x in got.itertuples():
        c = x.source, x.lang, x.topic
        assert x.p == pytest.approx(min(1.0, high * shares[c] / totals[c]) if totals[c] else 0.0, abs=1e-5)
    assert mixing.mix(frame(spark, [])).count() == 0
    kept = mixing.sample(d, part=0.5)
    assert kept.columns == d.columns and {x.doc_id for x in kept.collect()} == set(got[got.kept].doc_id)
    odd = d.selectExpr("*", "1 AS mix_p", "'x' AS mix_source", "2 AS u", "3 AS p", "'y' AS topic", "5 AS tokens", "6 AS in_0")
    again = mixing.sample(odd, part=0.5)
    assert again.columns == odd.columns and {tuple(x) for x in again.select("doc_id", "mix_p", "u", "p", "in_0").collect()} == {(x.doc_id, 1, 2, 3, 6) for x in kept.collect()}
    given = mixing.mix(d, targets={"source": {"a": 1.0}}, part=0.2).toPandas()
    assert given[given.source != "a"].p.max() == 0


def test_pipeline(spark):
    """The stages against the operators' plain versions, over documents."""
    import corpus_pipeline as cp
    import tiktoken

    from tracewright.llm import bpe, fertility
    from tracewright.llm.queries import MULTI, PIECES

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in cp.STAGES] == ["quality rules", "line dedup", "n-gram Jaccard join", "mixing", "encoding"]
    good = {r.doc_id for r in fertility.measure(docs, P.path(PIECES), P.path(MULTI), P.PATTERN).filter("kept").collect()}
    left = [r for r in docs.orderBy("doc_id").collect() if r.doc_id in good]
    cut = plain_line_dedup([r.text for r in left], [r.doc_id for r in left])
    texts = {i: v[0] for (_, i, t), v in cut.items() if v[0].split() or not v[1]}
    classes = plain_classes([texts[i] for i in sorted(texts)], sorted(texts))
    texts = {i: texts[i] for i, n, c in classes if i == c or not n}
    again = spark.createDataFrame([(r.doc_id, texts[r.doc_id], r.lang, r.source, len(texts[r.doc_id])) for r in left if r.doc_id in texts], docs.schema)
    chosen = {r.doc_id for r in mixing.mix(again).filter("kept").collect()}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.Vocabulary.load(P.path(MULTI)).ranks, special_tokens={})
    want = {i: len(enc.encode_ordinary(texts[i])) for i in chosen}
    got = cp.run(spark, sf).collect()
    assert {r.doc_id: r.n_tokens for r in got} == want and all(r.round_trip for r in got)


def test_tables_are_released(spark):
    from tracewright.llm.common import release, written

    df = written(spark.range(3), "x")
    assert df.count() == 3
    release(spark)
    with pytest.raises(Exception, match="(?i)not.*exist|FileNotFound|NOT_FOUND"):
        df.collect()
