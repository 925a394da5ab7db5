"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the only word separator of the word contracts.
BLANKS = b" \t\n\x0b\x0c\r"
BATCH_BYTES = 4 << 20
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session's spark.checkpoint.dir names it.

    Where that is unset, a temporary folder is made and set if the master is local; on a cluster it is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = spark.sparkContext.getCheckpointDir()
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """From now on rows come to this session's Python workers in batches of BATCH_BYTES; a batch is held a few times over."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def _tables(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tables/{spark.sparkContext.applicationId}"


def release(spark: SparkSession) -> None:
    """Delete what written() left for this application. Results not yet stored elsewhere can't be read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_tables(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors.

    What was shuffled for it is deleted once it is written.
    """
    spark = df.sparkSession
    path = f"{_tables(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra columns of the input can't clash with computed ones."""
    return df.select(*[F.col(n) for n in names])


#: Bits of the bitmap that tells ids; up to an eighth as many ids are told so.
BITS = 1 << 26


def may_have(rows: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """All rows whose column `name` is among the values of ids (a written table with this column), and few others.

    Up to BITS / 8 ids are told by a bitmap of fixed size, so that rows aren't shuffled; more by a
    join, which then is exact. Null equals null.
    """
    known = f"in_{name}_{uuid.uuid4().hex[:8]}"
    if ids.count() * 8 > BITS:
        return rows.join(ids.select(F.col(name).alias(known)), F.col(name).eqNullSafe(F.col(known)), "left_semi")
    shared = _bitmap(ids, name)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            h = batch.column(batch.num_columns - 1).to_numpy()
            yield batch.select(range(batch.num_columns - 1)).filter(pa.array((shared.value[h >> 3] >> (h & 7)) & 1 == 1))

    return rows.select("*", F.pmod(F.xxhash64(name), F.lit(BITS)).alias(known)).mapInArrow(run, rows.schema)


def _bitmap(ids: DataFrame, name: str):
    """A broadcast bitmap of the residues of the hashes of ids' values."""
    import numpy as np

    h = F.pmod(F.xxhash64(name), F.lit(BITS)) + 1  # both bitmap functions count from 1
    maps = ids.select(h.alias("h")).groupBy(F.bitmap_bucket_number("h").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("bits"))
    marks = np.zeros(BITS, bool)
    for part, bits in maps.collect():
        got = np.unpackbits(np.frombuffer(bytes(bits), np.uint8), bitorder="little")
        marks[(part - 1) * len(got) : part * len(got)] = got
    return ids.sparkSession.sparkContext.broadcast(np.packbits(marks, bitorder="little"))


def may_be_among(ids: DataFrame, name: str) -> Column:
    """Column: whether column `name` may be among the values of ids (see may_have); always true if ids are too many for the
    bitmap. Only hashes go to Python, the rows' other columns don't."""
    if ids.count() * 8 > BITS:
        return F.lit(True)
    shared = _bitmap(ids, name)

    @F.arrow_udf("boolean")
    def told(h):
        import pyarrow as pa

        at = h.to_numpy()
        return pa.array((shared.value[at >> 3] >> (at & 7)) & 1 == 1)

    return told(F.pmod(F.xxhash64(name), F.lit(BITS)))


def byte_runs(column, most: int = 4 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Slices of an Arrow text column as (first row, UTF-8 bytes of each row), each of about `most` bytes at most.

    A null is given as None. Bounds the Python objects alive at once, whatever the batch holds.
    """
    import pyarrow as pa

    col = column.cast(pa.large_binary())
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(col), 0).to_pylist()
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > most:
            yield start, col.slice(start, i - start).to_pylist()
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, col.slice(start, len(sizes) - start).to_pylist()


def trim() -> None:
    """Give memory that this worker process doesn't use any more back to the system, where its C library can."""
    import ctypes

    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library: nothing to do
        pass


def tidy(run):
    """run, a function of Arrow batches, followed by trim(): workers wait between stages and share an executor's memory."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return whole


_HELD: dict = {}


def held(key, make):
    """make(), kept in this worker process over tasks; a worker holds one such thing at a time, so stages don't add up."""
    if key not in _HELD:
        _HELD.clear()
        trim()
        _HELD[key] = make()
    return _HELD[key]


class TwoAges(dict):
    """A cache of about `most` bytes: when half is full, the younger half ages and the older one goes.

    Keys and values are text, bytes, numbers or lists of numbers.
    """

    def __init__(self, make, most: int, entry: int = 140):
        """entry: bytes that an entry takes besides the characters, bytes or numbers that it holds."""
        super().__init__()
        self.make, self.most, self.entry, self.old, self.held = make, most // 2, entry, {}, 0

    @staticmethod
    def size(x) -> int:
        return 8 * len(x) if isinstance(x, list) else len(x) if isinstance(x, (str, bytes)) else 0

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        # numbers have no size besides the entry's
        self.held += self.entry + (0 if type(key) is int else self.size(key)) + (0 if type(value) is bool else self.size(value))
        if self.held > self.most:
            self.old, self.held = dict(self), 0
            self.clear()
        self[key] = value
        return value
