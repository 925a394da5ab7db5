"""Texts about nodes from a model or a client: UDF-04, UDF-05. What answers is made once in each worker process."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapsed

Answer = Callable[[str], str]
_MADE: dict[str, Answer] = {}


class AuthFailure(Exception):
    """The service doesn't take the key; it won't later in the run either."""


def _made(name: str, make: Callable[[], Answer]) -> Answer:
    if name not in _MADE:
        _MADE[name] = make()
    return _MADE[name]


def generated(prompts: DataFrame, name: str, make: Callable[[], Answer]) -> DataFrame:
    """UDF-04, UDF-05: id, kind and text for prompts (id, prompt; null where the source can't be read).

    make() gives the answering function, once for each worker and name. kind: success; degenerate (no
    text but white space); unreadable; failed (the call raised); skipped. After the first AuthFailure
    of a task no more calls are made in it: its other prompts are skipped.
    """
    kind = dict(prompts.dtypes)["id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        refused = False
        for batch in batches:
            kinds, texts = [], []
            for prompt in batch["prompt"]:
                what, told = "unreadable", None
                if prompt is not None and refused:
                    what = "skipped"
                elif prompt is not None:
                    try:
                        what, told = "success", _made(name, make)(prompt)
                    except AuthFailure:
                        what, refused = "failed", True
                    except Exception:
                        what = "failed"
                kinds.append(what)
                texts.append(told)
            yield pd.DataFrame({"id": batch["id"], "kind": kinds, "text": texts})

    out = prompts.select("id", "prompt").mapInPandas(run, f"id {kind}, kind string, text string").withColumn("text", collapsed("text"))
    empty = (F.col("kind") == "success") & (F.col("text") == "")
    return out.select("id", F.when(empty, "degenerate").otherwise(F.col("kind")).alias("kind"), F.when(~empty, F.col("text")).alias("text"))
