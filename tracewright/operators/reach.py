"""Exact reach of every node over the condensation, each component once: TRV-10, TRV-11, TRV-14.

Components get a layer, their longest way to a sink, and two bounds of their closure, its members: the
sum of the successors' bounds above, the longest way and the successors' number below. So a caller that
looks for the widest few counts those alone which the bounds leave open.

Where all is counted: a closure is its own members and the closures of its successors, layer by layer
from the sinks, so nothing is walked twice. A component whose bound is small has one array of numbers.
Others are kept by buckets of 32,768 node numbers: a bucket with few members as their places, one with
many as a bitmap of 4 KB. A closure is kept only where a component above it needs it; of the rest there
is a count.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..storage import apart, counted, dealt, fresh, side, written, written_rows
from .condense import components
from .neighbourhood import WIDTH
from .order import numbered

MOST_PLACES = 1024  # a bucket with more members is a bitmap
ARRAY = 4  # a closure whose bound is at most so many times MOST_PLACES is one array

PLACES = "c long, bucket long, places array<int>, bits binary"


def _size() -> Column:
    return F.when(F.col("bits").isNotNull(), F.bitmap_count("bits")).otherwise(F.size("places")).cast("long")


@dataclass
class Layered:
    """A graph's components by layers. members: id, number, c; steps: c, to (each once); layers: c, layer, size (its
    members), bound and least (of its closure's members, itself included), below (the layers its successors are in)."""

    members: DataFrame
    steps: DataFrame
    layers: DataFrame
    depth: int
    rows: int  # the steps' number
    nodes: int  # the members' number

    def roots(self) -> DataFrame:
        """id, c, bound and least of the nodes that no other leads to."""
        called = apart(self.steps.select(F.col("to").alias("c")).distinct())
        open_ = self.layers.filter("size = 1").join(called, "c", "left_anti").select("c", "bound", "least")
        return open_.join(self.members.select("id", "c"), "c").select("id", "c", "bound", "least")

    def _walk(self, starts: DataFrame) -> DataFrame:
        """root and node (components) for each of starts (c) and all that it leads to, itself too."""
        from .traverse import _hops

        own = starts.select(F.col("c").alias("root"), F.col("c").alias("node")).distinct()
        return _hops(self.steps.select(F.col("c").alias("src"), F.col("to").alias("dst")), own).select("root", "node").unionByName(own)

    def walked(self, starts: DataFrame) -> DataFrame:
        """c and reach (other nodes) of each of starts (c), by walks from them alone."""
        found = self._walk(starts).join(self.layers.select(F.col("c").alias("node"), "size"), "node")
        return found.groupBy(F.col("root").alias("c")).agg((F.sum("size") - 1).alias("reach"))

    def of(self, ids: DataFrame) -> DataFrame:
        """root and node: what each of the ids reaches, itself left out."""
        asked = written_rows(ids.select("id").distinct().join(self.members, "id").select(F.col("id").alias("root"), "c"), "asked")
        found = self._walk(asked.select("c")).withColumnRenamed("root", "c").join(asked, "c")
        return found.select("root", F.col("node").alias("c")).join(self.members.select("c", F.col("id").alias("node")), "c").filter("root <> node").select("root", "node")


def _layers(steps: DataFrame, sizes: DataFrame, nodes: int) -> tuple[DataFrame, int, DataFrame | None]:
    """Layered.layers of the components whose ways all end, the number of layers, and the components left over (on cycles or above them)."""
    none = F.array().cast("array<int>")
    left = steps.groupBy("c").agg(F.count(F.lit(1)).alias("left"))
    n_left = F.coalesce("left", F.lit(0).cast("long"))
    state, open_ = counted(sizes.join(left, "c", "left").select("c", "size", n_left.alias("left"), F.col("size").alias("bound"), (F.col("size") + n_left).alias("least"), none.alias("below")), "open")
    done, layer = [], 0
    while open_:
        here = F.lit(layer).alias("layer")
        ready, n = counted(state.filter("left = 0").select("c", here, "size", F.least("bound", F.lit(nodes)).alias("bound"), "least", "below"), "layer")
        if not n:
            return _whole(done, state), layer, state.select("c")
        done.append(ready)
        layer += 1
        if open_ == n:
            break
        tip = side(ready.select(F.col("c").alias("to"), F.col("bound").alias("more"), F.col("least").alias("deep")), n)
        came = steps.join(tip, "to").groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.sum("more").alias("more"), F.max("deep").alias("deep"))
        rest = state.filter("left > 0").join(came, "c", "left")
        less, more = F.coalesce("n", F.lit(0).cast("long")), F.coalesce("more", F.lit(0).cast("long"))
        state, open_ = counted(rest.select("c", "size", (F.col("left") - less).alias("left"), (F.col("bound") + more).alias("bound"), F.greatest("least", F.col("size") + F.col("deep")).alias("least"), F.when(F.col("n") > 0, F.array_append("below", F.lit(layer - 1))).otherwise(F.col("below")).alias("below")), "open")
    return _whole(done, state), layer, None


def _whole(done: list[DataFrame], state: DataFrame) -> DataFrame:
    whole = done[0] if done else state.select("c", F.lit(0).alias("layer"), "size", "bound", "least", "below").limit(0)
    for d in done[1:]:
        whole = whole.unionByName(d)
    return whole


def layered(nodes: DataFrame, edges: DataFrame) -> Layered:
    """Components and layers over edges (src, dst). Ends that aren't nodes, repeats and self-loops change nothing; no nodes give none.

    A round for each layer; only where nodes lie on cycles, components are found first.
    """
    members, n = numbered(nodes.select("id"))
    members = written_rows(members, "numbers").withColumn("c", F.col("number"))
    ends = edges.select("src", "dst").filter("src != dst")

    def steps_of(members: DataFrame) -> tuple[DataFrame, int]:
        key = lambda c, end: members.select(F.col("id").alias(end), F.col("c").alias(c))
        steps, rows = counted(ends.join(key("c", "src"), "src").join(key("to", "dst"), "dst").filter("c != to").select("c", "to").distinct(), "steps")
        return apart(steps), rows

    steps, rows = steps_of(members)
    layers, depth, rest = _layers(steps, members.select("c", F.lit(1).cast("long").alias("size")), n)
    if rest is not None:
        inner = steps.join(rest, "c", "left_semi").join(rest.select(F.col("c").alias("to")), "to", "left_semi").select(F.col("c").alias("src"), F.col("to").alias("dst"))
        groups = components(rest.select(F.col("c").alias("id")), inner).withColumnsRenamed({"id": "number", "component": "group"})
        members = written_rows(members.drop("c").join(groups, "number", "left").select("id", "number", F.coalesce("group", "number").alias("c")), "numbers")
        steps, rows = steps_of(members)
        layers, depth, _ = _layers(steps, members.groupBy("c").agg(F.count(F.lit(1)).alias("size")), n)
    return Layered(members, steps, written_rows(layers, "layers"), depth, rows, n)


def _as_bits(rows: DataFrame) -> DataFrame:
    """Buckets as bitmaps, for those given by places."""
    return rows.select("c", "bucket", F.explode("places").alias("place")).groupBy("c", "bucket").agg(F.bitmap_construct_agg(F.col("place").cast("long")).alias("bits"))


def _merged(places: DataFrame, bitmaps: DataFrame | None, most: int, first_look: int | None) -> DataFrame:
    """One row for each component and bucket. places: c, bucket, place; bitmaps: c, bucket, bits.

    first_look: the most places that any bucket has, where that is known.
    """
    few = places.groupBy("c", "bucket").agg(F.sort_array(F.collect_set("place")).alias("places"))
    none = F.lit(None)
    if bitmaps is None and first_look is not None and first_look <= most:
        return few.select("c", "bucket", "places", none.cast("binary").alias("bits"))
    few = written_rows(few, "few")
    full = _as_bits(few.filter(F.size("places") > most))
    if bitmaps is not None:
        dense = bitmaps.select("c", "bucket").distinct()
        full = full.unionByName(_as_bits(few.filter(F.size("places") <= most).join(dense, ["c", "bucket"], "left_semi"))).unionByName(bitmaps)
        full = full.groupBy("c", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
        few = few.join(dense, ["c", "bucket"], "left_anti")
    few = few.filter(F.size("places") <= most)
    return few.select("c", "bucket", "places", none.cast("binary").alias("bits")).unionByName(full.select("c", "bucket", none.cast("array<int>").alias("places"), "bits"))


@dataclass
class Reach:
    """How many members the closure of each component has: sizes (c, n)."""

    graph: Layered
    sizes: DataFrame

    def counts(self) -> DataFrame:
        """TRV-14: id and reach of every node, itself left out."""
        return self.graph.members.join(self.sizes, "c").select("id", (F.col("n") - 1).alias("reach"))

    def of(self, ids: DataFrame) -> DataFrame:
        """See Layered.of()."""
        return self.graph.of(ids)


def reach(nodes: DataFrame, edges: DataFrame, most_places: int = MOST_PLACES) -> Reach:
    """Sizes of the closures of all components; see layered()."""
    return sizes_of(layered(nodes, edges), most_places)


def sizes_of(g: Layered, most_places: int = MOST_PLACES) -> Reach:
    """A round for each layer, which reads the closures of the layers that its components lead to."""
    spark = g.members.sparkSession
    if not g.depth:
        return Reach(g, spark.createDataFrame([], "c long, n long"))
    small = F.col("bound") <= ARRAY * most_places
    told = g.layers.select("c", "layer", small.alias("small"))
    # a file's rows by layer, so that a round reads its own
    laid = written(g.steps.join(told, "c").select("c", "to", "layer", "small").sortWithinPartitions("layer", "small"), "laid")
    # a row for each layer: its components, and the layers that it leads to
    facts = g.layers.groupBy("layer").agg(F.count_if(small).alias("few"), F.count_if(~small).alias("many"), F.array_distinct(F.flatten(F.collect_set("below"))).alias("below")).collect()
    facts = {r["layer"]: r for r in facts}
    needed = {b for r in facts.values() for b in r["below"]}
    number = F.col("number").cast("int" if g.nodes < 1 << 31 else "long")
    own = g.members.groupBy("c").agg(F.collect_list(number).alias("nums")) if g.layers.filter("size > 1").limit(1).count() else g.members.select("c", F.array(number).alias("nums"))
    arrays: dict[int, DataFrame] = {}
    sizes: list[DataFrame] = []
    step_rows = {r["layer"]: r["n"] for r in laid.groupBy("layer").agg(F.count(F.lit(1)).alias("n")).collect()}
    for k in range(g.depth):
        if not facts[k]["few"]:
            continue
        here = apart(g.layers.filter(F.col("layer") == k).filter(small).select("c"))
        nums = here.join(own, "c").select("c", "nums")
        below = [arrays[b] for b in facts[k]["below"] if b in arrays]
        if below:
            came = laid.filter((F.col("layer") == k) & F.col("small")).join(apart(_union(below)).withColumnRenamed("c", "to"), "to").select("c", "nums")
            nums = dealt(came.unionByName(nums), step_rows.get(k, 0) + facts[k]["few"], "c").groupBy("c").agg(F.array_distinct(F.flatten(F.collect_list("nums"))).alias("nums"))
        if k in needed:
            arrays[k] = written(nums, f"closures-{k}")
            sizes.append(arrays[k].select("c", F.size("nums").cast("long").alias("n")))
        else:
            sizes.append(written(nums.select("c", F.size("nums").cast("long").alias("n")), f"sizes-{k}"))
    if any(r["many"] for r in facts.values()):
        sizes += _large(g, laid, small, arrays, most_places)
    return Reach(g, written_rows(_union(sizes), "sizes"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _large(g: Layered, laid: DataFrame, small: Column, arrays: dict[int, DataFrame], most_places: int) -> list[DataFrame]:
    """c and n of the components that have no array, layer by layer. A closure is written once for each layer that needs it."""
    spark = g.members.sparkSession
    wide = written_rows(g.layers.filter(~small).select("c", "layer", "below"), "wide")
    steps = written_rows(laid.filter("NOT small").select("c", "to", "layer"), "wide-steps")
    above = steps.groupBy(F.col("to").alias("c")).agg(F.collect_set("layer").alias("copies"))
    copies_of = written_rows(wide.select("c", "layer").join(above, "c").select("c", "layer", F.explode("copies").alias("copy")), "copies")
    place = (F.expr(f"number DIV {WIDTH}").alias("bucket"), (F.col("number") % WIDTH).cast("int").alias("place"))
    own = g.members.join(wide.select("c", "layer"), "c").select("c", "layer", *place)
    leads = {r["layer"]: r["below"] for r in wide.groupBy("layer").agg(F.array_distinct(F.flatten(F.collect_set("below"))).alias("below")).collect()}
    paths: list[str] = []
    sizes: list[DataFrame] = []
    dense = False
    for k in sorted(leads):
        mine = own.filter(F.col("layer") == k).select("c", "bucket", "place")
        to = steps.filter(F.col("layer") == k).select("c", F.col("to").alias("t"))
        below = [arrays[b] for b in leads[k] if b in arrays]
        if below:
            come = to.join(apart(_union(below)).withColumnRenamed("c", "t"), "t").select("c", F.explode("nums").alias("number"))
            mine = mine.unionByName(come.select("c", *place))
        bitmaps = None
        there = [f"{p}/copy={k}" for p in paths if _there(spark, f"{p}/copy={k}")]
        if there:
            came = to.join(spark.read.schema(PLACES).parquet(*there).withColumnRenamed("c", "t"), "t")
            mine = mine.unionByName(came.select("c", "bucket", F.explode("places").alias("place")))
            if dense:
                bitmaps = came.filter("bits IS NOT NULL").select("c", "bucket", "bits").groupBy("c", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
        closures, seen = fresh(spark, f"buckets-{k}"), Observation()
        _merged(mine, bitmaps, most_places, None if dense else most_places).observe(seen, F.max(F.size("places")).alias("most")).write.parquet(closures)
        if not dense and (seen.get["most"] or 0) > most_places:  # the first bitmaps: this layer again
            dense = True
            closures = fresh(spark, f"buckets-{k}")
            _merged(mine, bitmaps, most_places, None).write.parquet(closures)
        closures = spark.read.schema(PLACES).parquet(closures)
        sizes.append(written(closures.groupBy("c").agg(F.sum(_size()).alias("n")), f"sizes-{k}"))
        path = fresh(spark, f"copies-{k}")
        closures.join(copies_of.filter(F.col("layer") == k).select("c", "copy"), "c").write.partitionBy("copy").parquet(path)
        paths.append(path)
    return sizes


def _there(spark, path: str) -> bool:
    from ..storage import hadoop_path

    found, fs = hadoop_path(spark, path)
    return fs.exists(found)
