"""Scans of several sources at once, each with a time limit: SRC-09, SRC-10.

Mandatory scans go first, in their order, and their failure is the caller's. Optional ones run at the
same time on threads of their own, each job under a tag: one that fails or takes too long is
interrupted by its tag, leaves a warning and an empty frame, and holds up no other.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from ..storage import written

AT_ONCE = 5
LIMIT_S = 20.0
ABSENT = ("PATH_NOT_FOUND", "TABLE_OR_VIEW_NOT_FOUND")


@dataclass(frozen=True)
class Scan:
    """A source by name: its schema as DDL, and how to read it."""

    name: str
    schema: str
    load: Callable[[], DataFrame]
    limit_s: float = LIMIT_S


@dataclass
class Found:
    """Frames by name, all with their schema, and warnings: name, kind (absent, failed or timed-out), message."""

    frames: dict[str, DataFrame]
    warnings: DataFrame


def _stored(scan: Scan) -> DataFrame:
    df = scan.load()
    return written(df.select(*[df[c.split()[0]].cast(c.split(None, 1)[1]).alias(c.split()[0]) for c in _columns(scan.schema)]), scan.name)


def _columns(schema: str) -> list[str]:
    """Columns of a DDL text of plain types."""
    return [c.strip() for c in schema.split(",")]


def fetch(spark: SparkSession, mandatory: Sequence[Scan], optional: Sequence[Scan], at_once: int = AT_ONCE) -> Found:
    """Run all scans to their end. A scan's rows are written once, in the shared folder, and read from there.

    A limit counts from when a scan begins, not while it waits for its turn. Any error of an optional
    scan is a warning with its first line; of a mandatory one it is raised.
    """
    context = spark.sparkContext
    frames = {s.name: _stored(s) for s in mandatory}
    run = uuid.uuid4().hex
    warnings: list[tuple[str, str, str]] = []
    noted = threading.Lock()

    def scan(s: Scan) -> DataFrame | None:
        tag, late = f"scan-{s.name}-{run}", threading.Event()

        def stop() -> None:
            # jobs that begin after an interrupt are caught by the next one
            late.set()
            while not done.wait(0.2):
                context.cancelJobsWithTag(tag)

        done = threading.Event()
        timer = threading.Timer(s.limit_s, stop)
        context.addJobTag(tag)
        context.setInterruptOnCancel(True)  # else its tasks go on and keep their slots
        timer.start()
        kind = message = None
        try:
            return _stored(s)
        except AnalysisException as e:
            kind, message = "absent" if e.getCondition() in ABSENT else "failed", str(e).splitlines()[0]
        except Exception as e:  # noqa: BLE001  a source is foreign: its failure is a warning
            kind, message = "failed", (str(e).splitlines() or [type(e).__name__])[0]
        finally:
            done.set()
            timer.cancel()
            context.removeJobTag(tag)
        if late.is_set():
            kind, message = "timed-out", f"no result within {s.limit_s:g} s"
        with noted:
            warnings.append((s.name, kind, message))
        return None

    with ThreadPoolExecutor(at_once) as pool:
        results = list(pool.map(inheritable_thread_target(spark)(scan) if optional else scan, optional))
    for s, df in zip(optional, results, strict=True):
        frames[s.name] = spark.createDataFrame([], s.schema) if df is None else df
    return Found(frames, spark.createDataFrame(sorted(warnings), "name string, kind string, message string"))

