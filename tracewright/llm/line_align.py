"""Line dedup by pairwise alignment.

Documents are paired by the hashes of runs of consecutive lines that just hold enough words for a
block: each with the first document that has the run and, for runs that this alignment leaves, with
every earlier one of another content. Each pair's lines are aligned by patience diff, and common
blocks of enough words are deleted from the later document: the result is that of aligning all
pairs. The earliest document of a block keeps it. Only hashes of lines move until the texts are cut.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_runs, may_be_among, may_have, small_batches, tidy, written
from .words import _ODD, mix

#: A block of fewer words stays.
BLOCK_WORDS = 30
_ODD_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def longest_rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of pairs by rising first number, the longest selection whose second numbers rise as well."""
    tops: list[int] = []
    at: list[int] = []
    before: list[int] = []
    for k, (_, j) in enumerate(pairs):
        p = bisect_left(tops, j)
        before.append(at[p - 1] if p else -1)
        if p == len(tops):
            tops.append(j)
            at.append(k)
        else:
            tops[p], at[p] = j, k
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def heavy_run(a: list, words: list[int], b: list, span: tuple[int, int, int, int], least: int) -> tuple[int, int, int] | None:
    """Places in a and b and the length of the first run of equal lines that holds `least` words, as long as it goes; span: ranges of a and b."""
    i, ie, j, je = span
    size = {x: words[k] for k, x in enumerate(a[i:ie], i)}

    def runs(seq, lo, hi):
        """Each run that just holds enough words and begins with a line of some, all its lines being lines of a; a line is in `least` runs at most."""
        e, held = lo, 0
        for s in range(lo, hi):
            if e < s:
                e, held = s, 0
            while e < hi and held < least and seq[e] in size:
                held += size[seq[e]]
                e += 1
            if held >= least and size[seq[s]]:
                yield tuple(seq[s:e]), s
            held -= size[seq[s]] if e > s else 0

    there = dict(reversed(list(runs(b, j, je))))
    if not there:
        return None
    for run, s in runs(a, i, ie):
        if run in there:
            t, n = there[run], len(run)
            while s > i and t > j and a[s - 1] == b[t - 1]:
                s, t, n = s - 1, t - 1, n + 1
            while s + n < ie and t + n < je and a[s + n] == b[t + n]:
                n += 1
            return s, t, n
    return None


def patience(a: list, b: list, words: list[int] | None = None, least: int = 1) -> list[tuple[int, int]]:
    """Aligned equal lines (place in a, place in b), rising in both.

    Within a range: equal lines at both ends are aligned; then the lines that occur once in either
    range, in their longest common order, and the ranges between these in the same way. Where no
    line occurs once in both, the first common run of `least` words (of a's lines; without words,
    each counts one) is aligned, and what lies on either side of it.
    """
    words = [1] * len(a) if words is None else words
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, ie, j, je = todo.pop()
        while i < ie and j < je and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < ie and j < je and a[ie - 1] == b[je - 1]:
            ie, je = ie - 1, je - 1
            out.append((ie, je))
        if i >= ie or j >= je:
            continue
        once: dict[object, list[int]] = {}
        for side, (seq, lo, hi) in enumerate(((a, i, ie), (b, j, je))):
            for k in range(lo, hi):
                x = once.setdefault(seq[k], [0, 0, 0, 0])
                x[side] += 1
                x[2 + side] = k
        anchors = longest_rising(sorted((p, q) for m, n, p, q in once.values() if m == 1 == n))
        if not anchors:
            run = heavy_run(a, words, b, (i, ie, j, je), least)
            anchors = [(run[0] + k, run[1] + k) for k in range(run[2])] if run else []
        if not anchors:
            continue
        at, to = i, j
        for p, q in anchors:
            todo.append((at, p, to, q))
            out.append((p, q))
            at, to = p + 1, q + 1
        todo.append((at, ie, to, je))
    return sorted(out)


def common_blocks(a: list, words: list[int], b: list, least: int = BLOCK_WORDS) -> list[tuple[int, int]]:
    """(start, end) in a of aligned runs without a gap on either side that hold `least` words or more."""
    out, run, held = [], [], 0
    for p, q in [*patience(a, b, words, least), (-2, -2)]:
        if run and (p, q) == (run[-1][0] + 1, run[-1][1] + 1):
            run.append((p, q))
            held += words[p]
            continue
        if run and held >= least:
            out.append((run[0][0], run[-1][0] + 1))
        run, held = [(p, q)], words[p] if p >= 0 else 0
    return out


def block_runs(lens: np.ndarray, hashes: np.ndarray, words: np.ndarray, least: int = BLOCK_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, 64-bit hash, start and end of each run of lines that no line can be taken from, at its end or at its start, if `least` words are to stay.

    The texts' lines follow each other in hashes and words. Every line of a common block lies in a
    run within the block: in one from its first line, or in one up to the line itself.
    """
    n = len(words)
    text = np.repeat(np.arange(len(lens)), lens)
    to = np.cumsum(lens)[text]
    held = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])
    ends = np.searchsorted(held, held[:-1] + least, "left")
    starts = np.searchsorted(held, held[1:] - least, "right") - 1
    forward, back = ends <= to, starts >= to - lens[text]
    s, e = np.divmod(np.unique(np.concatenate([np.flatnonzero(forward) * (n + 1) + ends[forward], starts[back] * (n + 1) + np.flatnonzero(back) + 1])), n + 1)
    powers = lambda x: np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, x, np.uint64))])
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes.view(np.uint64) * powers(_ODD)[:-1], dtype=np.uint64)])
    return text[s], mix((sums[e] - sums[s]) * powers(_ODD_INVERSE)[s] + mix((e - s).astype(np.uint64))).view(np.int64), s, e


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of a column's lists (0 for null), and all their values."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64), column.flatten().to_numpy(zero_copy_only=False)


def _lines(docs: DataFrame) -> DataFrame:
    """nul, id, fp and, for each line, both halves of its 128-bit hash (0: no word) and number of words; one row for each id and text.

    Runs are looked up by the first halves; lines are equal where both agree.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            hashes, others, words = [], [], []
            for _, texts in byte_runs(batch.column(3)):
                for data in texts:
                    lines = (data or b"").split(b"\n")
                    n = [len(x.split()) for x in lines]
                    words.append(n)
                    both = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x) if k else bytes(16) for x, k in zip(lines, n, strict=True)), "<i8")
                    hashes.append(both[::2])
                    others.append(both[1::2])
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (hashes, others)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *lists, pa.array(words, pa.list_(pa.int32()))], names=["nul", "id", "fp", "hashes", "others", "words"])

    kind = dict(docs.dtypes)["id"]
    return docs.mapInArrow(tidy(run), f"nul boolean, id {kind}, fp long, hashes array<long>, others array<long>, words array<int>")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).isNull().alias("nul"), F.coalesce(F.col(id_col), F.lit("0").cast(kind)).alias("id"), F.xxhash64(text_col).alias("fp"), F.col(text_col).alias("text"))


KEY = ["nul", "id", "fp"]


def _runs(recs: DataFrame, least: int) -> DataFrame:
    """doc, same (a hash of all its lines) and r, for each run of each document."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            lens, hashes = _flat(batch.column(1))
            of, r, _, _ = block_runs(lens, hashes, _flat(batch.column(2))[1], least)
            to = np.cumsum(lens)
            same = np.array([_signed(xxhash.xxh3_64_intdigest(hashes[a:b].tobytes())) for a, b in zip(to - lens, to, strict=True)], np.int64)
            for i in range(0, len(r), 1 << 16):
                part = slice(i, i + (1 << 16))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of[part])), pa.array(same[of[part]]), pa.array(r[part])], names=["doc", "same", "r"])

    side = recs.select(F.struct(*KEY).alias("doc"), "hashes", "words")
    return side.mapInArrow(tidy(run), f"doc {dict(side.dtypes)['doc']}, same long, r long")


def _aligned(pairs: DataFrame, recs: DataFrame, least: int) -> DataFrame:
    """doc and gone: the places of its lines that some of its pairs (doc, other) deletes."""
    pairs = written(pairs, "pairs")
    ids = written(pairs.select("doc").unionByName(pairs.select(F.col("other").alias("doc"))).distinct(), "paired")
    side = may_have(recs.select(F.struct(*KEY).alias("doc"), "hashes", "others", "words"), ids, "doc")
    pairs = pairs.join(side, "doc").join(side.select(F.col("doc").alias("other"), F.col("hashes").alias("theirs"), F.col("others").alias("their_others")), "other")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            keep, gone = [], []
            for k in range(batch.num_rows):
                lines = [list(zip(batch.column(c)[k].as_py(), batch.column(c + 1)[k].as_py(), strict=True)) for c in (1, 3)]
                blocks = common_blocks(lines[0], batch.column(5)[k].as_py(), lines[1], least)
                if blocks:
                    keep.append(k)
                    gone.append([x for a, b in blocks for x in range(a, b)])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int32())), pa.array(gone, pa.list_(pa.int32()))], names=["doc", "gone"])

    found = pairs.select("doc", "hashes", "others", "theirs", "their_others", "words").mapInArrow(tidy(run), f"doc {dict(pairs.dtypes)['doc']}, gone array<int>")
    return found.select("doc", F.explode("gone").alias("p")).distinct().groupBy("doc").agg(F.array_sort(F.collect_list("p")).alias("gone"))


def _left(shared: DataFrame, gone: DataFrame, recs: DataFrame, least: int) -> DataFrame:
    """doc and r of shared runs that are not deleted everywhere in the document."""
    ids = written(shared.select("doc").distinct(), "sharing")
    side = may_have(recs.select(F.struct(*KEY).alias("doc"), "hashes", "words"), ids, "doc")
    rows = shared.groupBy("doc").agg(F.collect_list("r").alias("rs")).join(side, "doc").join(gone, "doc", "left")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            lens, hashes = _flat(batch.column(1))
            of, r, s, e = block_runs(lens, hashes, _flat(batch.column(2))[1], least)
            n, gone = _flat(batch.column(4))
            deleted = np.zeros(len(hashes), np.int64)
            deleted[np.repeat(np.cumsum(lens) - lens, n) + gone] = 1
            held = np.concatenate([[0], np.cumsum(deleted)])
            n, asked = _flat(batch.column(3))
            key = lambda x, texts: mix(x.view(np.uint64) + mix(texts.astype(np.uint64)))
            some = (held[e] - held[s] < e - s) & np.isin(key(r, of), key(asked, np.repeat(np.arange(len(n)), n)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of[some])), pa.array(r[some])], names=["doc", "r"])

    return rows.select("doc", "hashes", "words", "rs", "gone").mapInArrow(tidy(run), f"doc {dict(side.dtypes)['doc']}, r long")


def deletions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """nul, id, fp (the document: id is null, id, hash of the text) and gone: places of its lines to delete, rising.

    Documents are in order of their ids, those without an id last; rows of the same id and text are
    one document, so repeated rows don't delete each other's lines.
    """
    small_batches(docs.sparkSession)
    recs = written(_lines(_keyed(docs, id_col, text_col)).dropDuplicates(KEY), "lines")
    runs = _runs(recs, block_words)
    firsts = runs.groupBy("r").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).filter("first != last").drop("last")
    held = written(runs.join(firsts, "r"), "runs")
    shared = held.filter("doc != first")
    gone = written(_aligned(shared.select("doc", F.col("first").alias("other")).distinct(), recs, block_words), "aligned")
    left = written(_left(shared, gone, recs, block_words), "left")
    if not left.isEmpty():
        # documents of the same lines align alike, so the first of them stands for all
        others = held.filter("doc != first").groupBy("r", "same").agg(F.min("doc").alias("other"))
        pairs = left.distinct().join(others, "r").filter("other < doc").select("doc", "other").distinct()
        more = _aligned(pairs, recs, block_words)
        gone = gone.unionByName(more).groupBy("doc").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("gone"))
    return gone.select("doc.*", "gone")


def _cut(docs: DataFrame, id_col: str, text_col: str, **how) -> DataFrame:
    """docs with nul, id, fp, gone (null: nothing) and left (the text without those lines)."""
    names = [f"in_{i}" for i in range(len(docs.columns))]
    at = {c: n for c, n in zip(docs.columns, names, strict=True)}
    kind = dict(docs.dtypes)[id_col]
    gone = written(deletions(docs, id_col, text_col, **how), "gone")
    rows = docs.toDF(*names).select("*", F.col(at[id_col]).isNull().alias("nul"), F.coalesce(F.col(at[id_col]), F.lit("0").cast(kind)).alias("id"), F.xxhash64(at[text_col]).alias("fp"))
    # texts of which nothing goes meet no join, so they aren't dealt out
    rows = rows.withColumn("doc", F.struct(*KEY))
    cut = may_be_among(written(gone.select(F.struct(*KEY).alias("doc")), "cut"), "doc")
    rows = rows.filter(cut).drop("doc").join(gone, KEY, "left").unionByName(rows.filter(~cut).drop("doc").withColumn("gone", F.lit(None).cast("array<int>")))
    lines = F.split(at[text_col], "\n")
    left = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("gone", i)), "\n")
    return rows.withColumn("left", F.when(F.col("gone").isNull(), F.col(at[text_col])).otherwise(left)), at


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """Each row of docs with what alignment deletes.

    Returns id_col, n_lines, n_deleted (long), text (what is left), deleted (array of line places).
    Null text stays null and has no lines; a text of one line is one block. Repeated rows of one id
    and text get the same result. Very long texts are aligned whole, by hashes of their lines. Empty
    table: no rows. Columns not named are not read, so their names don't clash.
    """
    rows, at = _cut(docs.select(id_col, text_col), id_col, text_col, block_words=block_words)
    size = F.coalesce(F.size(F.split(at[text_col], "\n")), F.lit(0))
    size = F.when(F.col(at[text_col]).isNull(), F.lit(0)).otherwise(size)
    none = F.array().cast("array<int>")
    return rows.select(F.col(at[id_col]).alias(id_col), size.cast("long").alias("n_lines"), F.size(F.coalesce("gone", none)).cast("long").alias("n_deleted"), F.col("left").alias(text_col), F.coalesce("gone", none).alias("deleted"))


def cleaned(docs: DataFrame) -> DataFrame:
    """docs with their own columns, whatever their names, and the texts that are left, n_chars adjusted; documents that lost all their words go.

    docs: doc_id, text and others. Null and empty texts, and texts without words from the start, stay as they are. Rows
    without an id are last in order. Repeated rows of one id and text get the same result. Very long texts are cut like
    others: only hashes of their lines are aligned. Empty table: no rows.
    """
    rows, at = _cut(docs, "doc_id", "text")
    rows = rows.filter(F.col("gone").isNull() | F.col("left").rlike(r"[^\x20\x09-\x0D]"))
    own = {"text": F.col("left")}
    if "n_chars" in at:
        own["n_chars"] = F.when(F.col("gone").isNull(), F.col(at["n_chars"])).otherwise(F.length("left").cast(dict(docs.dtypes)["n_chars"]))
    return rows.select(*[own.get(c, F.col(at[c])).alias(c) for c in docs.columns])
