"""Entry candidates and their relations: TRV-12, TRV-13, TRV-25, JOIN-20, TOP-06, TOP-07, FLT-31."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.paths import no_entry_file
from ..storage import LARGE, written_rows
from . import traverse
from .ranked import top_k
from .reach import Layered, layered, sizes_of
from .traverse import cut


def clean_pins(pins: list) -> list[str]:
    """FLT-31."""
    return list(dict.fromkeys(p for p in pins if isinstance(p, str)))[: S.PINS_MAX]


#: Roots that are counted first, those of the largest bounds.
FIRST = 1024


def _widest(graph: Layered, able: DataFrame, k: int = S.ENTRY_MAX, least: int = S.ENTRY_MIN_REACH, first: int = FIRST) -> tuple[list[str], int]:
    """The k roots (ids) of the widest reach, equal ones by id, and how many reach `least` nodes or more.

    able: id, c, bound and least of roots. Only those are counted which their bounds leave open: first some
    of the largest bounds, then all whose bound isn't below the k-th of these. Where walks from so many could
    find more pairs than the graph has steps, all closures are counted.
    """
    sure, open_ = F.col("least") > least, (F.col("least") <= least) & (F.col("bound") > least)
    # one of so small a lower bound has no long way and few successors, so its closure is small
    unclear = graph.walked(able.filter(open_).select("c")).filter(F.col("reach") >= least).select("c")
    enough = written_rows(able.filter(sure).select("id", "c", "bound").unionByName(able.filter(open_).join(unclear, "c", "left_semi").select("id", "c", "bound")), "qualifying")
    total = enough.count()
    if not total:
        return [], 0
    best = lambda counted: counted.orderBy(F.desc("reach"), "id").limit(k)
    tried = cut(enough.orderBy(F.desc("bound"), "id").limit(first))
    found = cut(tried.join(graph.walked(tried.select("c")), "c").select("id", "reach"))
    top = best(found).collect()
    floor = top[k - 1]["reach"] if len(top) >= k else 0
    others = written_rows(enough.filter(F.col("bound") > floor).join(tried.select("id"), "id", "left_anti"), "others")
    n, work = others.agg(F.count(F.lit(1)), F.sum("bound")).first()
    if n:
        if work <= max(LARGE, graph.rows):
            more = others.join(graph.walked(others.select("c")), "c").select("id", "reach")
        else:
            more = others.join(sizes_of(graph).sizes, "c").select("id", (F.col("n") - 1).alias("reach"))
        top = best(found.unionByName(more)).collect()
    return [r["id"] for r in top], total


def candidates(nodes: DataFrame, edges: DataFrame, pins: list[str] | None = None, uses: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The candidates, and what each of them reaches (root, node).

    Candidates: id, name, file, start_line, end_line, reach, reason (pinned, or no-callers),
    loaded_by (see there; from uses (file, id) or else the column called_at_load_by, null without both), pinned, pos and
    total_qualifying. Pins come first in their order, then the roots of the widest reach. A root needs
    a reach of ENTRY_MIN_REACH; at most ENTRY_MAX are listed. No row: there is none.
    """
    pins = clean_pins(pins or [])
    spark = nodes.sparkSession
    shown = [c for c in ("id", "name", "file", "start_line", "end_line", "called_at_load_by") if c in nodes.columns]
    one = written_rows(nodes.select(*shown).dropDuplicates(["id"]), "nodes")
    graph = layered(one, traverse.caller_edges(edges))
    pinned = spark.createDataFrame([(p, i) for i, p in enumerate(pins)], "id string, pos long")
    free = one.filter(~no_entry_file("file")).join(F.broadcast(pinned), "id", "left_anti").select("id")
    best, qualifying = _widest(graph, written_rows(graph.roots().join(free, "id"), "able"))
    own = pinned.join(one.select("id"), "id", "left_semi")
    ranked = spark.createDataFrame([(i, S.PINS_MAX + k) for k, i in enumerate(best)], "id string, pos long")
    # at most ENTRY_MAX + PINS_MAX roots
    reached = written_rows(graph.of(own.select("id").unionByName(ranked.select("id"))), "reached")
    width = reached.groupBy(F.col("root").alias("id")).agg(F.count(F.lit(1)).alias("reach"))
    listed = own.withColumn("pinned", F.lit(True)).unionByName(ranked.withColumn("pinned", F.lit(False)))
    full = one.join(F.broadcast(listed), "id").join(F.broadcast(width), "id", "left")
    if uses is not None:
        loads = uses.join(F.broadcast(listed.select("id")), "id", "left_semi").groupBy("id").agg(F.collect_set("file").alias("called_at_load_by"))
        full = full.drop("called_at_load_by").join(loads, "id", "left")
    load = loaded_by() if "called_at_load_by" in full.columns else F.lit(None).cast("struct<first:array<string>,total:int>")
    out = full.select("id", "name", "file", "start_line", "end_line", F.coalesce("reach", F.lit(0).cast("long")).alias("reach"), F.when(F.col("pinned"), "pinned").otherwise("no-callers").alias("reason"), F.when(~F.col("pinned"), load).alias("loaded_by"), "pinned", "pos")
    # at most ENTRY_MAX + PINS_MAX rows
    return out.withColumns({"pos": F.row_number().over(Window.orderBy("pos")).cast("long"), "total_qualifying": F.lit(qualifying).cast("long") + F.count_if("pinned").over(Window.partitionBy())}), reached


def relations(reached: DataFrame, listed: DataFrame) -> DataFrame:
    """JOIN-20, SET-02: a < b and shared_reach for each two listed candidates that reach a common node.

    At most ENTRY_MAX + PINS_MAX candidates are listed, so a node meets a bounded number of roots.
    """
    r = reached.join(F.broadcast(listed.select(F.col("id").alias("root"))), "root", "left_semi")
    pairs = r.select("node", F.col("root").alias("a")).join(r.select("node", F.col("root").alias("b")), "node").filter("a < b")
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared_reach"))


def partners(related: DataFrame, one: str, k: int = S.REVEAL_RELATIONS) -> DataFrame:
    """TRV-25: those that share most with one candidate."""
    mine = related.filter((F.col("a") == one) | (F.col("b") == one)).select(F.when(F.col("a") == one, F.col("b")).otherwise(F.col("a")).alias("id"), "shared_reach")
    return top_k(mine, [], [F.desc("shared_reach"), "id"], k)


def agent_relations(related: DataFrame) -> DataFrame:
    """TOP-06."""
    return top_k(related, [], [F.desc("shared_reach"), "a", "b"], S.RELATIONS_MAX)


def loaded_by(callers: str = "called_at_load_by"):
    """TRV-13: struct of the first callers at load time and their number; null without any."""
    each = F.array_sort(F.array_distinct(callers))
    return F.when(F.size(each) > 0, F.struct(F.slice(each, 1, S.LOADED_BY_SHOWN).alias("first"), F.size(each).alias("total")))
