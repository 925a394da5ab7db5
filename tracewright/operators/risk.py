"""Risk signals, cuts and severity: AGG-12 to AGG-19, TOP-10, TOP-11, FLT-29, JOIN-28."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.paths import directory
from .ranked import top_k

#: Signals in the order in which they are listed, with the column that holds their value.
DETERMINISTIC = {"complexity": "complexity", "cognitive": "cognitive", "hotspot": "hotspot", "blast-radius": "blast_radius", "coverage-gap": "coverage_gap", "co-change": "co_change"}
PER_FILE = ("hotspot", "co-change")
FLOORS = {"blast-radius": S.BLAST_FLOOR, "hotspot": S.HOTSPOT_FLOOR, "co-change": S.CO_CHANGE_FLOOR}


def signals(measured: DataFrame) -> DataFrame:
    """AGG-12 in long form: node_id, file, ord, type, value of each measure that is there. measured: id, file and the
    columns of DETERMINISTIC (any may be missing or null)."""
    have = [(i, t, c) for i, (t, c) in enumerate(DETERMINISTIC.items()) if c in measured.columns]
    each = F.array(*[F.when(F.col(c).isNotNull(), F.struct(F.lit(i).alias("ord"), F.lit(t).alias("type"), F.col(c).cast("double").alias("value"))) for i, t, c in have])
    return measured.select(F.col("id").alias("node_id"), "file", F.inline(F.array_compact(each)))


def percentile_cut(values: DataFrame, by: str = "type", value: str = "value") -> DataFrame:
    """AGG-14: of each group, the value at rank ceil(n / 10) downwards, at least rank 1, among finite values.

    Values are counted first, so one row for each distinct value is ranked, not one for each node.
    """
    fine = values.filter(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")))
    counts = fine.groupBy(by, value).agg(F.count(F.lit(1)).alias("c"))
    down = Window.partitionBy(by).orderBy(F.desc(value))
    ranked = counts.select(by, value, F.sum("c").over(down).alias("upto"), F.sum("c").over(Window.partitionBy(by)).alias("n"))
    return ranked.filter("upto >= greatest(1, (n + 9) div 10)").groupBy(by).agg(F.max(value).alias("cut"))


def cuts(long: DataFrame) -> DataFrame:
    """AGG-15: type and cut for the signals with floors; hotspot and co-change count once for each file, by their largest value."""
    nodes = long.filter(F.col("type") == "blast-radius").select("type", "value")
    files = long.filter(F.col("type").isin(*PER_FILE)).groupBy("type", "file").agg(F.max("value").alias("value")).select("type", "value")
    return percentile_cut(nodes.unionByName(files))


def with_severity(long: DataFrame) -> DataFrame:
    """AGG-16: severity severe or normal. Fixed thresholds for both complexities; else at the cut or above and at the floor or above. Gaps have none."""
    floor = F.create_map(*[F.lit(x) for kv in FLOORS.items() for x in kv])[F.col("type")]
    severe = (
        F.when(F.col("type") == "complexity", F.col("value") >= S.SEVERE_COMPLEXITY)
        .when(F.col("type") == "cognitive", F.col("value") >= S.SEVERE_COGNITIVE)
        .when(F.col("type").isin(*FLOORS), (F.col("value") >= F.col("cut")) & (F.col("value") >= floor))
    )
    return long.join(F.broadcast(cuts(long)), "type", "left").withColumn("severity", F.when(severe, "severe").when(severe.isNotNull() | F.col("type").isin(*FLOORS), "normal")).drop("cut")


def record_signals(records: DataFrame) -> DataFrame:
    """AGG-13: judgment and ingested findings of the record store as signal rows. records: id, judgment, findings array."""
    told = records.filter(F.col("judgment").isNotNull()).select(F.col("id").alias("node_id"), F.lit(100).alias("ord"), F.lit("llm-judgment").alias("family"), F.col("judgment").alias("text"), F.lit(None).cast("string").alias("tool"), F.lit(None).cast("string").alias("severity"))
    found = records.select(F.col("id").alias("node_id"), F.posexplode("findings").alias("i", "x")).select("node_id", (F.col("i") + 101).alias("ord"), F.lit("ingested").alias("family"), F.col("x.finding").alias("text"), F.col("x.tool").alias("tool"), F.col("x.severity").alias("severity"))
    return told.unionByName(found)


def live(cached: DataFrame, records: DataFrame) -> DataFrame:
    """JOIN-28: the cached deterministic signals with record signals built anew."""
    return cached.filter("family = 'deterministic'").unionByName(record_signals(records), allowMissingColumns=True)


def risk_counts(nodes: DataFrame, long: DataFrame, judged: DataFrame | None = None) -> DataFrame:
    """AGG-17: nodes with risk_count: distinct deterministic types, and one for a judgment that isn't blank."""
    n = long.select("node_id", "type").distinct().groupBy(F.col("node_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    out = nodes.join(n, "id", "left")
    extra: Column = F.lit(0)
    if judged is not None:
        out = out.join(judged.filter(F.trim("text") != "").select(F.col("node_id").alias("id"), F.lit(1).alias("j")).distinct(), "id", "left")
        extra = F.coalesce("j", F.lit(0))
    return out.withColumn("risk_count", F.coalesce("n", F.lit(0).cast("long")) + extra).drop("n", "j")


def heat(count: Column | str) -> Column:
    """AGG-18."""
    c = F.col(count) if isinstance(count, str) else count
    return F.when(c <= 0, 0).when(c <= 2, 1).when(c <= 5, 2).otherwise(3)


def health(counted: DataFrame, clusters: int = S.HEALTH_CLUSTERS, members: int = S.HEALTH_MEMBERS) -> DataFrame:
    """AGG-19: one row for each member shown: directory, cluster_rank, heat, heat_count, total_risk, size,
    remaining_members, remaining_clusters, member_rank, id, name, risk_count."""
    rows = counted.select(directory("file").alias("directory"), "id", "name", "risk_count")
    groups = rows.groupBy("directory").agg(F.max("risk_count").alias("heat_count"), F.sum("risk_count").alias("total_risk"), F.count(F.lit(1)).alias("size"))
    top = top_k(groups, [], [F.desc("heat_count"), F.desc("total_risk"), "directory"], clusters, "cluster_rank", "n_clusters")
    shown = rows.join(F.broadcast(top), "directory")
    rank = F.row_number().over(Window.partitionBy("directory").orderBy(F.desc("risk_count"), "name", "id")).cast("long")
    shown = shown.withColumn("member_rank", rank).filter(F.col("member_rank") <= members)
    return shown.select("directory", "cluster_rank", heat("heat_count").alias("heat"), "heat_count", "total_risk", "size", F.greatest(F.lit(0).cast("long"), F.col("size") - members).alias("remaining_members"), F.greatest(F.lit(0).cast("long"), F.col("n_clusters") - clusters).alias("remaining_clusters"), "member_rank", "id", "name", "risk_count")


def severity_rank(severity: Column | str) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in S.SEVERITY_RANK.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, F.col(severity) if isinstance(severity, str) else severity), F.lit(len(S.SEVERITY_RANK)))


def visible(long: DataFrame, families: list[str]) -> tuple[DataFrame, DataFrame]:
    """FLT-29: signals of the families switched on, and how many are hidden for each node."""
    on = F.col("family").isin(*families)
    return long.filter(on), long.filter(~on).groupBy("node_id").agg(F.count(F.lit(1)).alias("hidden"))


def ingested_order(long: DataFrame) -> DataFrame:
    """TOP-10: findings by severity, in their own order within it."""
    return long.filter("family = 'ingested'").withColumn("place", F.row_number().over(Window.partitionBy("node_id").orderBy(severity_rank("severity"), "ord")))
