"""Language-model scoring by cross-entropy difference.

Two bigram models of the same kind share one vocabulary: one of the target texts, one of all texts.
A document's score is the mean, over its tokens, of the target's loss less the background's. Low
scores are more like the target.

The vocabulary is every word that occurs twice or more on either side, plus one token for all other
words; it and the table of pairs grow with the corpus. Texts are held in blocks of a few MB. A block
asks once for each of its words and pairs, dealt by their hashes over as many buckets as the corpus
needs; each bucket counts what all blocks ask it and answers them. So neither a task nor the driver
holds a model, and a frequent pair is one entry for each block that has it. Numbers travel as sorted
lists by byte planes, compressed.
"""

from __future__ import annotations

import numpy as np
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_runs, pick, small_batches, tidy, written
from .words import _ODD, mix, split

#: Weight of the pair's own frequency against the word's, and what is added to each word's count.
PAIR_WEIGHT, ADDED = 0.7, 0.5
#: Words occur so often on one of the sides to be listed.
LEAST = 2
#: Numbers within a block: the start of a text, then the block's words.
START, WORDS = 0, 1
#: Tokens of the corpus for each bucket that counts words and pairs.
PER_BUCKET = 1 << 20
#: Bytes of text in a block.
BLOCK_BYTES = 4 << 20
#: Bits of a pair's hash beyond those that number all tokens: of 2^EXTRA_BITS pairs about one is taken for another.
EXTRA_BITS = 24
KINDS = ("words", "pairs")


def planes(x: np.ndarray) -> bytes:
    """Numbers of one fixed width by planes of bytes, the first bytes of all first, compressed."""
    return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T).tobytes(), 3)


def from_planes(data: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(width, -1).T).view(kind).reshape(-1)


def rising(x: np.ndarray) -> bytes:
    """Rising unsigned numbers by their steps."""
    return planes(np.diff(x, prepend=np.uint64(0)))


def from_rising(data: bytes) -> np.ndarray:
    return np.cumsum(from_planes(data, "<u8"), dtype=np.uint64)


def _blocks(docs: DataFrame, id_col: str, text_col: str, target: bool) -> DataFrame:
    """One row for each block of texts: its ids (none for the target), words of each text, the number of each word within the block, the words' hashes."""

    def run(batches):
        import pyarrow as pa

        k, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            for at, texts in byte_runs(batch.column(1), BLOCK_BYTES):
                index: dict[bytes, int] = {}
                place = index.setdefault
                lens, toks = [], []
                for data in texts:
                    ws = split(data or b"")
                    lens.append(len(ws))
                    toks.append(np.fromiter((place(w, len(index)) for w in ws), np.uint32, len(ws)))
                flat = np.concatenate(toks)
                hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, index), np.uint64, len(index))
                # frequent words get small numbers
                order = np.argsort(-np.bincount(flat, minlength=len(hashes)), kind="stable")
                rank = np.empty(len(order), np.uint32)
                rank[order] = np.arange(WORDS, len(order) + WORDS, dtype=np.uint32)
                flat, hashes = rank[flat], hashes[order]
                ids = batch.column(0).slice(at, 0 if target else len(texts))
                lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (ids, pa.array(lens, pa.int32()))]
                cols = [pa.array([((part << 24) + k) * 2 + target]), pa.array([target]), pa.array([len(flat)], pa.int64()), pa.array([sum(n > 0 for n in lens)], pa.int64()), *lists]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([planes(flat)], pa.binary()), pa.array([hashes.tobytes()], pa.binary())], names=["block", "target", "tokens", "texts", "ids", "lens", "toks", "words"])
                k += 1

    kind = dict(docs.dtypes)[id_col]
    return pick(docs, id_col, text_col).mapInArrow(tidy(run), f"block long, target boolean, tokens long, texts long, ids array<{kind}>, lens array<int>, toks binary, words binary")


def _pairs(lens: np.ndarray, toks: np.ndarray, words: np.ndarray, bits: int) -> tuple[np.ndarray, ...]:
    """Of a block's distinct pairs, rising by hash: hash, first, second, how often; and the pair of each token."""
    before = np.empty(len(toks), np.int64)
    before[1:] = toks[:-1]
    before[(np.cumsum(lens) - lens)[lens > 0]] = START
    size = len(words) + WORDS
    code, of, n = np.unique(before * size + toks, return_inverse=True, return_counts=True)
    a, b = code // size, code % size
    names = np.concatenate([np.ones(WORDS, np.uint64), words])
    pair = mix(names[a] * _ODD + names[b]) >> np.uint64(64 - bits)
    order = np.argsort(pair)
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    return pair[order], a[order], b[order], n[order], back[of]


def _dealt(hashes: np.ndarray, buckets: int, bits: int = 64) -> np.ndarray:
    """Ends of each bucket's share of rising hashes of so many bits."""
    edges = (np.arange(1, buckets, dtype=object) * (1 << bits) // buckets).astype(np.uint64)
    return np.concatenate([[0], np.searchsorted(hashes, edges), [len(hashes)]])


def _asked(blocks: DataFrame, buckets: int, bits: int) -> DataFrame:
    """bucket, asker (a block), target, words, pairs (rising hashes) and their numbers in the block; only rows that ask for something."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k] for c in batch.schema.names}
                lens, words = row["lens"].values.to_numpy(zero_copy_only=False), np.frombuffer(row["words"].as_py(), np.uint64)
                toks = from_planes(row["toks"].as_py(), "<u4").astype(np.int64)
                pair, _, _, n, _ = _pairs(lens, toks, words, bits)
                order = np.argsort(words)
                both = [(words[order], np.bincount(toks, minlength=len(words) + WORDS)[WORDS:][order]), (pair, n)]
                ends = [_dealt(h, buckets, k) for (h, _), k in zip(both, (64, bits), strict=True)]
                some = np.flatnonzero((np.diff(ends[0]) > 0) | (np.diff(ends[1]) > 0))
                cols = [pa.array(some, pa.int32()), pa.array([row["block"].as_py()] * len(some), pa.int64()), pa.array([row["target"].as_py()] * len(some), pa.bool_())]
                for (h, m), e in zip(both, ends, strict=True):
                    cols += [pa.array([rising(h[e[x] : e[x + 1]]) for x in some], pa.binary()), pa.array([planes(m[e[x] : e[x + 1]].astype("<u4")) for x in some], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["bucket", "asker", "target", "words", "words_n", "pairs", "pairs_n"])

    return blocks.select("block", "target", "lens", "toks", "words").mapInArrow(tidy(run), "bucket int, asker long, target boolean, words binary, words_n binary, pairs binary, pairs_n binary")


def _answered(asked: DataFrame) -> DataFrame:
    """For each asking row of documents the counts on either side; besides, in one row for each bucket without an asker, the listed words and their sums."""
    names = ["words_t", "words_b", "pairs_t", "pairs_b"]

    def count(rows):
        import pyarrow as pa

        target = rows.column("target").to_numpy(zero_copy_only=False)
        ask = np.flatnonzero(~target)
        cols, listed = [], None
        for kind in KINDS:
            lists = [from_rising(x.as_py()) for x in rows.column(kind)]
            sizes = [len(x) for x in lists]
            values, of = np.unique(np.concatenate(lists), return_inverse=True)
            n = np.concatenate([from_planes(x.as_py(), "<u4") for x in rows.column(f"{kind}_n")])
            t = np.repeat(target, sizes)
            sides = [np.bincount(of[side], n[side], len(values)).astype(np.int64) for side in (t, ~t)]
            ends = np.cumsum(sizes)
            cols += [[planes(c[of[ends[i] - sizes[i] : ends[i]]].astype("<u8")) for i in ask] + [None] for c in sides]
            if kind == "words":
                known = (sides[0] >= LEAST) | (sides[1] >= LEAST)
                listed = [int(known.sum()), int(sides[0][known].sum()), int(sides[1][known].sum())]
        askers = rows.column("asker").to_numpy()[ask].tolist()
        bucket = rows.column("bucket")[0].as_py()
        first = [pa.array([bucket] * (len(ask) + 1), pa.int32()), pa.array([*askers, None], pa.int64())]
        return pa.Table.from_arrays([*first, *[pa.array(c, pa.binary()) for c in cols], *[pa.array([None] * len(ask) + [x], pa.int64()) for x in listed]], names=["bucket", "asker", *names, "listed", "listed_t", "listed_b"])

    return asked.groupBy("bucket").applyInArrow(count, "bucket int, asker long, words_t binary, words_b binary, pairs_t binary, pairs_b binary, listed long, listed_t long, listed_b long")


def score(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cross-entropy difference of each row of docs.

    target holds texts in the same column. A token's loss is -ln of PAIR_WEIGHT times the share of
    its pair among the occurrences of the word before it, plus the rest times the word's own share
    (ADDED to each count); of the word's share alone if one of the two isn't listed or the word
    before doesn't occur on that side. Returns id_col, n_tokens long, target_loss and background_loss
    (mean nats a token), ce_diff (their difference); the three are null for a text without words.
    Null text: no words; very long texts are a block of their own. Null ids and repeated rows are
    kept; each occurrence counts. Empty target: every word has the same share there. Empty docs: no
    rows. Columns not named are not read. Words are known by 64-bit hashes, pairs by as many bits as EXTRA_BITS says.
    """
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    of_target = target.select(F.lit(None).cast(kind).alias(id_col), text_col)
    blocks = written(_blocks(docs, id_col, text_col, False).unionByName(_blocks(of_target, id_col, text_col, True)), "blocks")
    sums = {r["target"]: r for r in blocks.groupBy("target").agg(F.sum("tokens").alias("tokens"), F.sum("texts").alias("texts")).collect()}
    total = {s: sums[s == "t"]["tokens"] if (s == "t") in sums else 0 for s in "tb"}
    texts = {s: sums[s == "t"]["texts"] if (s == "t") in sums else 0 for s in "tb"}
    buckets = max(1, -(-sum(total.values()) // PER_BUCKET))
    bits = min(64, EXTRA_BITS + sum(total.values()).bit_length())
    answers = written(_answered(_asked(blocks, buckets, bits)), "answers")
    known = answers.filter("asker IS NULL").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("listed", "listed_t", "listed_b")]).first()
    size = known["listed"] + 1
    unknown = {s: total[s] - known[f"listed_{s}"] for s in "tb"}

    def scored(block, answer):
        import pyarrow as pa

        lens = block.column("lens").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        words = np.frombuffer(block.column("words")[0].as_py(), np.uint64)
        toks = from_planes(block.column("toks")[0].as_py(), "<u4").astype(np.int64)
        _, a, b, _, of = _pairs(lens, toks, words, bits)
        order = np.argsort(answer.column("bucket").to_numpy())
        read = lambda c: np.concatenate([np.zeros(0, np.int64), *[from_planes(answer.column(c)[i].as_py(), "<u8").astype(np.int64) for i in order]])
        full = lens > 0
        from_ = (np.cumsum(lens) - lens)[full]
        own = {}
        for s in "tb":
            own[s] = np.zeros(len(words) + WORDS, np.int64)
            own[s][WORDS + np.argsort(words)] = read(f"words_{s}")
        listed = (own["t"] >= LEAST) | (own["b"] >= LEAST)
        listed[START] = True
        paired = listed[a] & listed[b]
        means = []
        for s in "tb":
            own[s][START] = texts[s]
            single = ((np.where(listed, own[s], unknown[s]) + ADDED) / (total[s] + ADDED * size))[b]
            lead = own[s][a].astype(float)
            has = paired & (lead > 0)
            share = np.divide(read(f"pairs_{s}"), lead, out=np.zeros(len(a)), where=has)
            loss = -np.log(np.where(has, PAIR_WEIGHT * share + (1 - PAIR_WEIGHT) * single, single))
            mean = np.zeros(len(lens))
            if len(from_):
                mean[full] = np.add.reduceat(loss[of], from_) / lens[full]
            means.append(mean)
        cols = [pa.array(x, pa.float64(), mask=~full) for x in (*means, means[0] - means[1])]
        return pa.Table.from_arrays([block.column("ids").combine_chunks().flatten(), pa.array(lens, pa.int64()), *cols], names=["id", "n_tokens", "target_loss", "background_loss", "ce_diff"])

    own = blocks.filter("NOT target").select("block", "ids", "lens", "toks", "words")
    given = answers.filter("asker IS NOT NULL").drop("listed", "listed_t", "listed_b")
    out = own.groupBy("block").cogroup(given.groupBy("asker")).applyInArrow(scored, f"id {kind}, n_tokens long, target_loss double, background_loss double, ce_diff double")
    return out.withColumnRenamed("id", id_col)
