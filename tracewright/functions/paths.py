"""Path expressions: FLT-06 to FLT-15, FLT-19, FLT-24, FLT-33, FN-04, SRC-18."""

from __future__ import annotations

import posixpath
from collections.abc import Callable
from functools import reduce
from operator import add, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema as S


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def line_number(x: Column | str) -> Column:
    """FLT-06: a finite number of at least 1, else null."""
    d = _col(x).try_cast("double")
    return F.when((d >= 1) & (d < float("inf")), d)


def signal_value(x: Column | str) -> Column:
    """FLT-07: a finite number of at least 0, else null."""
    d = _col(x).try_cast("double")
    return F.when((d >= 0) & (d < float("inf")), d)


def flag(x: Column | str) -> Column:
    """FLT-08: true, 1, "true" and "1" in any case are true."""
    return F.coalesce(F.lower(F.trim(_col(x).cast("string"))).isin("true", "1"), F.lit(False))


def segments(file: Column | str) -> Column:
    """FLT-11: struct of the path's segments with . and .. resolved, and whether it stays inside the project."""
    f = _col(file)
    start = F.struct(F.array().cast("array<string>").alias("segments"), (~f.rlike(r"^([\\/]|[A-Za-z]:)")).alias("inside"))

    def step(s: Column, x: Column) -> Column:
        some = F.size(s["segments"]) > 0
        up = F.when(some, F.slice(s["segments"], 1, F.greatest(F.size(s["segments"]) - 1, F.lit(0)))).otherwise(s["segments"])
        skip, parent = (x == "") | (x == "."), x == ".."
        return F.struct(F.when(skip, s["segments"]).when(parent, up).otherwise(F.concat(s["segments"], F.array(x))).alias("segments"), (s["inside"] & (skip | ~parent | some)).alias("inside"))

    return F.aggregate(F.split(f, r"[\\/]+"), start, step)


def _with_parts(file: Column | str, use: Callable[[Column, Column, Column], Column]) -> Column:
    """use(base name, lower-cased directories, inside), with the path split once."""

    def told(p: Column) -> Column:
        n = F.size(p["segments"])
        return use(F.try_element_at(p["segments"], F.lit(-1)), F.transform(F.slice(p["segments"], 1, F.greatest(n - 1, F.lit(0))), F.lower), p["inside"])

    return F.element_at(F.transform(F.array(segments(file)), told), 1)


_SUPPORT = r"(?i)^(" + "|".join(s.replace(".", r"\.") for s in S.TEST_SUPPORT_STEMS) + r")\.[cm]?[jt]sx?$"


_NAMES = "|".join(f"(?:{p})" for p in (*S.TEST_FILE_PATTERNS, _SUPPORT))


def is_test_path(file: Column | str) -> Column:
    """FLT-12: test code by its file name; inside the project also by its directories."""

    def told(base: Column, directories: Column, inside: Column) -> Column:
        by_place = F.exists(directories, lambda d: d.isin(*S.TEST_DIRECTORIES) | d.endswith(".tests"))
        loader = F.array_contains(directories, "scripts") & base.rlike("(?i)test-?loader")
        return F.coalesce(base.rlike(_NAMES) | (inside & (by_place | loader)), F.lit(False))

    return F.coalesce(_with_parts(file, told), F.lit(False))


def is_test_support(file: Column | str) -> Column:
    """FLT-13: test code that isn't a test itself."""

    def told(base: Column, directories: Column, inside: Column) -> Column:
        by_place = F.array_contains(directories, "__mocks__") | (F.array_contains(directories, "scripts") & base.rlike("(?i)test-?loader"))
        return F.coalesce(base.rlike(_SUPPORT) | base.rlike(r"(?i)^conftest\.py$") | (inside & by_place), F.lit(False))

    return F.coalesce(_with_parts(file, told), F.lit(False))


def is_test_node(file: Column | str = "file", flagged: Column | str = "is_test") -> Column:
    """FLT-14."""
    return F.coalesce(_col(flagged), F.lit(False)) | is_test_path(file)


def is_evidence_source(file: Column | str, flagged: Column | str) -> Column:
    """FLT-15."""
    return is_test_node(file, flagged) & ~is_test_support(file)


def report_path(file: Column | str, root: str) -> Column:
    """SRC-18: slashes only, relative to the root where inside it, without a leading ./ ."""
    f = F.regexp_replace(_col(file), r"[\\/]+", "/")
    home = root.replace("\\", "/").rstrip("/") + "/"
    f = F.when(f.startswith(home), F.substring(f, len(home) + 1, 1 << 20)).otherwise(f)
    return F.regexp_replace(f, r"^(\./)+", "")


def project_relative(file: Column | str, root: str) -> Column:
    """FLT-09: an absolute path as seen from the root, with .. where it lies outside; any other path as it is. One slash
    between segments."""
    f = _col(file)
    home = [s for s in posixpath.normpath(root).split("/") if s]
    empty = F.array().cast("array<string>")
    up = lambda s: F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0)))
    parts = F.aggregate(F.split(f, "/"), empty, lambda s, x: F.when((x == "") | (x == "."), s).when(x == "..", up(s)).otherwise(F.concat(s, F.array(x))))
    shared = reduce(add, [(F.slice(parts, 1, k + 1) == F.array(*map(F.lit, home[: k + 1]))).cast("int") for k in range(len(home))], F.lit(0))
    seen = F.concat(F.array_repeat(F.lit(".."), F.lit(len(home)) - shared), F.slice(parts, shared + 1, F.greatest(F.size(parts), F.lit(1))))
    return F.regexp_replace(F.when(f.startswith("/"), F.array_join(seen, "/")).otherwise(f), r"[\\/]+", "/")


def safe_relative(file: Column | str, root: str | None) -> Column:
    """FLT-10: the same, and the path as it is where there is no root to see it from."""
    return project_relative(file, root) if root and root.startswith("/") else _col(file)


def module_line(file: Column | str) -> Column:
    """FN-04: the directory with its slash, null at the root; a leading ./ or / and slashes at the end don't count."""
    f = F.regexp_replace(F.replace(_col(file), F.lit("\\"), F.lit("/")), r"^(?:\./|/)+|/+$", "")
    cut = F.length(f) - F.length(base_name(f))
    return F.when(cut > 1, F.left(f, cut))


def base_name(file: Column | str) -> Column:
    return F.element_at(F.split(_col(file), "/"), -1)


def directory(file: Column | str) -> Column:
    """The part before the last slash; "." without one, or where it comes first."""
    f = _col(file)
    cut = F.length(f) - F.length(base_name(f)) - 1
    return F.when(cut > 0, F.substring(f, F.lit(1), cut)).otherwise(F.lit("."))


def in_entry(file: Column | str, entry: Column) -> Column:
    """FLT-19 for one scope entry: the entry itself or anything under it."""
    f = _col(file)
    return (f == entry) | F.startswith(f, F.concat(entry, F.lit("/")))


def in_scope(file: Column | str, scope: list[str]) -> Column:
    """FLT-19: an empty scope holds everything."""
    return reduce(or_, [in_entry(file, F.lit(p)) for p in scope]) if scope else F.lit(True)


def normal_scope(paths: Column | str) -> Column:
    """FLT-33: trimmed entries with single slashes and none at the end, no blanks, each once in order."""
    one = lambda p: F.regexp_replace(F.regexp_replace(F.trim(p), r"[\\/]+", "/"), "/$", "")
    return F.array_distinct(F.filter(F.transform(_col(paths), one), lambda p: p != ""))


def no_entry_file(file: Column | str) -> Column:
    """FLT-24: files whose name holds harness or fixture don't start an entry."""
    return F.element_at(F.split(_col(file), r"[\\/]"), -1).rlike("(?i)harness|fixture")
