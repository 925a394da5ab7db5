"""What an engine operation returns."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Result:
    """status says whether there is an answer; frames hold it. An empty frame alone never means "no answer"."""

    status: str
    message: str | None = None
    frames: dict[str, DataFrame] = field(default_factory=dict)
    facts: dict[str, object] = field(default_factory=dict)
