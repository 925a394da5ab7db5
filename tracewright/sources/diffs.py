"""Changes as text: SRC-20 to SRC-24."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def changed_files(output: DataFrame, column: str = "value", keys: Sequence[str] = ()) -> DataFrame:
    """SRC-20: file and ord of each name in a listing of changed names; with keys, of each change's listing apart."""
    names = output.select(*keys, F.posexplode(F.split(column, "\r?\n")).alias("ord", "file")).select(*keys, F.trim("file").alias("file"), F.col("ord").cast("long").alias("ord"))
    return names.filter("file != ''").groupBy(*keys, "file").agg(F.min("ord").alias("ord"))


def snapshot_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """SRC-20 for two snapshots of (file, hash): files added, removed or changed."""
    b, a = before.select("file", F.col("hash").alias("h0")), after.select("file", F.col("hash").alias("h1"))
    return b.join(a, "file", "full").filter(~F.col("h0").eqNullSafe(F.col("h1"))).select("file")


_HUNK = re.compile(r"^@@ -\d+(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")


def _unquoted(name: str) -> str:
    name = name.split("\t")[0]
    if name.startswith('"') and name.endswith('"'):
        return name[1:-1].encode("latin-1", "replace").decode("unicode_escape").encode("latin-1", "replace").decode("utf-8", "replace")
    return name


def same_path(rest: str) -> str | None:
    """SRC-22: the path of a header a/x b/x whose halves agree."""
    half = (len(rest) - 1) // 2
    a, b = rest[:half], rest[half + 1 :]
    return a[2:] if a[:2] == "a/" and b[:2] == "b/" and a[2:] == b[2:] and rest[half : half + 1] == " " else None


def hunks(text: str) -> dict[str, list[tuple[int, int]]]:
    """SRC-21: new-side ranges of each file in a zero-context diff. A pure deletion behind line n is (n + 1, n). Hunk
    bodies are passed over by their counts, so a changed line may look like a header. Deleted files are left out."""
    out: dict[str, list[tuple[int, int]]] = {}
    file: str | None = None
    old = new = 0
    for line in text.splitlines():
        if old or new:
            if line.startswith("-"):
                old -= 1
            elif line.startswith("+"):
                new -= 1
            elif not line.startswith("\\"):
                old, new = max(0, old - 1), max(0, new - 1)
            continue
        if line.startswith("diff --git "):
            file = same_path(line[11:])
            if file is not None:
                out.setdefault(file, [])
        elif line.startswith("+++ "):
            name = _unquoted(line[4:])
            if name == "/dev/null":
                out.pop(file or "", None)
                file = None
            else:
                file = name[2:] if name.startswith("b/") else name
                out.setdefault(file, [])
        elif (m := _HUNK.match(line)) and file is not None:
            old, new, at = int(m[1] or 1), int(m[3] or 1), int(m[2])
            out[file].append((at, at + new - 1) if new else (at + 1, at))
    return out


def changed_lines(diffs: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """SRC-21 for a table of diffs: listed (file) and ranges (file, start, end)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(f, *r) for text in pdf.iloc[:, 0] for f, rs in hunks(text or "").items() for r in (rs or [(None, None)])]
            yield pd.DataFrame(rows, columns=["file", "start", "end"]).astype({"start": "Int32", "end": "Int32"})

    found = diffs.select(column).mapInPandas(run, "file string, start int, end int")
    return found.select("file").distinct(), found.filter("start IS NOT NULL")


def base_ref(known: list[str]) -> str | None:
    """SRC-24: the default branch among known refs: the remote's head, else main, else master."""
    return next((r for r in ("origin/HEAD", "main", "master") if r in known), None)


def carry(indexed_head: str | None, current_head: str | None) -> str:
    """SRC-23: whether an earlier answer may be kept."""
    return "keep" if indexed_head and indexed_head == current_head else "again"
