"""The standard tables seen as a code graph. Whole tables only.

Entities are nodes (parts are code of all kinds and files, orders and customers call them), orders
call or use their parts, customers call their orders, parts call the supplier of lowest number, and
suppliers, customers and nations use the nation or region they belong to.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SECTIONS = ["Brand#1", "Brand#1/ECONOMY", "Brand#17", "suppliers", "customers", "customers/BUILDING", "orders", "geo"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(prefix: str, column: str):
    return F.concat(F.lit(prefix + ":"), F.col(column).cast("string"))


def part_file():
    stem = F.concat_ws("/", "p_brand", "p_type", F.replace("p_name", F.lit(" "), F.lit("_")))
    return F.concat(stem, F.when(F.col("p_size") % 7 == 0, ".test.ts").otherwise(".ts"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, name, file, start_line, end_line, kind, is_test, complexity, cognitive, ord."""
    t = lambda n: table(spark, sf_dir, n)
    start = lambda c: (F.col(c) % 40 * 10 + 1).cast("int")
    none = F.lit(None).cast("double")
    kind = F.when(F.col("p_partkey") % 10 == 7, "Interface").when(F.col("p_partkey") % 10 == 8, "Type").when(F.col("p_partkey") % 10 == 9, "Module").otherwise("Function")
    rows = [
        t("part").select(_id("P", "p_partkey").alias("id"), F.col("p_name").alias("name"), part_file().alias("file"), start("p_partkey").alias("start_line"), kind.alias("kind"), F.col("p_size").cast("double").alias("complexity"), (F.col("p_size") % 18).cast("double").alias("cognitive"), F.col("p_partkey").alias("ord")),
        t("supplier").select(_id("S", "s_suppkey").alias("id"), F.col("s_name").alias("name"), F.concat(F.lit("suppliers/"), F.col("s_nationkey").cast("string"), F.lit("/api.ts")).alias("file"), start("s_suppkey").alias("start_line"), F.lit("Function").alias("kind"), none.alias("complexity"), none.alias("cognitive"), F.col("s_suppkey").alias("ord")),
        t("customer").select(_id("C", "c_custkey").alias("id"), F.col("c_name").alias("name"), F.concat(F.lit("customers/"), F.col("c_mktsegment"), F.lit("/"), F.col("c_nationkey").cast("string"), F.lit(".ts")).alias("file"), start("c_custkey").alias("start_line"), F.lit("Function").alias("kind"), none.alias("complexity"), none.alias("cognitive"), F.col("c_custkey").alias("ord")),
        t("orders").select(_id("O", "o_orderkey").alias("id"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("name"), F.concat(F.lit("orders/"), F.col("o_orderpriority"), F.lit("/"), (F.col("o_orderkey") % 50).cast("string"), F.when(F.col("o_orderstatus") == "P", ".test.ts").otherwise(".ts")).alias("file"), start("o_orderkey").alias("start_line"), F.lit("Function").alias("kind"), none.alias("complexity"), none.alias("cognitive"), F.col("o_orderkey").alias("ord")),
        t("nation").select(_id("N", "n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lit("geo/nation.ts").alias("file"), start("n_nationkey").alias("start_line"), F.lit("Function").alias("kind"), none.alias("complexity"), none.alias("cognitive"), F.col("n_nationkey").cast("long").alias("ord")),
        t("region").select(_id("R", "r_regionkey").alias("id"), F.col("r_name").alias("name"), F.lit("geo/region.ts").alias("file"), start("r_regionkey").alias("start_line"), F.lit("Function").alias("kind"), none.alias("complexity"), none.alias("cognitive"), F.col("r_regionkey").cast("long").alias("ord")),
    ]
    return reduce(DataFrame.unionByName, rows).select("id", "name", "file", "start_line", (F.col("start_line") + 8).alias("end_line"), "kind", F.lit(False).alias("is_test"), "complexity", "cognitive", "ord")


#: Line items of one task where they are grouped by order and part.
ITEMS = 1 << 20


def _sales(item: DataFrame) -> DataFrame:
    """l_orderkey, l_partkey and kind of each two that have line items.

    Nearly each line item is a pair of its own, so none is grouped before the exchange, and tasks are as many
    as keep one's groups at about ITEMS: its memory doesn't grow with the table. The largest flag is R if one
    is R and none is above; numbers for it can be hashed, strings would be sorted.
    """
    flag = F.col("l_returnflag")
    code = F.when(flag > "R", 2).when(flag == "R", 1).otherwise(0)
    rows = item.select("l_orderkey", "l_partkey", code.alias("code")).repartition(1 + item.count() // ITEMS, "l_orderkey", "l_partkey")
    return rows.groupBy("l_orderkey", "l_partkey").agg(F.when(F.max("code") == 1, "USAGE").otherwise("CALLS").alias("kind"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, kind, ord."""
    t = lambda n: table(spark, sf_dir, n)
    item = t("lineitem")
    rows = [
        _sales(item).select(_id("O", "l_orderkey").alias("src"), _id("P", "l_partkey").alias("dst"), "kind", (F.col("l_orderkey") * 10_000_000 + F.col("l_partkey")).alias("ord")),
        item.groupBy("l_partkey").agg(F.min("l_suppkey").alias("s")).select(_id("P", "l_partkey").alias("src"), _id("S", "s").alias("dst"), F.lit("CALLS").alias("kind"), F.col("l_partkey").alias("ord")),
        t("orders").select(_id("C", "o_custkey").alias("src"), _id("O", "o_orderkey").alias("dst"), F.lit("CALLS").alias("kind"), F.col("o_orderkey").alias("ord")),
        t("supplier").select(_id("S", "s_suppkey").alias("src"), _id("N", "s_nationkey").alias("dst"), F.lit("USAGE").alias("kind"), F.col("s_suppkey").alias("ord")),
        t("customer").select(_id("C", "c_custkey").alias("src"), _id("N", "c_nationkey").alias("dst"), F.lit("USAGE").alias("kind"), F.col("c_custkey").alias("ord")),
        t("nation").select(_id("N", "n_nationkey").alias("src"), _id("R", "n_regionkey").alias("dst"), F.lit("USAGE").alias("kind"), F.col("n_nationkey").cast("long").alias("ord")),
    ]
    return reduce(DataFrame.unionByName, rows)


def graph_rows(spark: SparkSession, sf_dir: str) -> int:
    """No fewer than the rows of nodes() and of edges(), from the numbers of the tables' rows alone."""
    return sum(table(spark, sf_dir, n).count() for n in ("part", "supplier", "customer", "orders", "lineitem", "nation", "region"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file, change_count, ord: a row for each part that was sold; files of several parts recur."""
    sold = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("change_count"))
    return table(spark, sf_dir, "part").join(sold, "p_partkey").select(part_file().alias("file"), "change_count", F.col("p_partkey").alias("ord"))


def co_change_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands bought in one order: file, partner, co_changes (orders with both), score (over the rarer one's orders), ord."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("b"))
    seen = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("p_partkey")).join(part, "p_partkey").select("l_orderkey", "b").distinct()
    n = seen.groupBy("b").agg(F.count(F.lit(1)).alias("n"))
    both = seen.join(seen.withColumnRenamed("b", "c"), "l_orderkey").filter("b < c").groupBy("b", "c").agg(F.count(F.lit(1)).alias("both"))
    out = both.join(n, "b").join(n.select(F.col("b").alias("c"), F.col("n").alias("m")), "c")
    return out.select(F.col("b").alias("file"), F.col("c").alias("partner"), F.col("both").alias("co_changes"), F.least(F.lit(1.0), F.col("both") * 5 / F.least("n", "m")).alias("score"), F.lit(0).cast("long").alias("ord"))


def test_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as calls from orders to parts: strategy by return flag, confidence by discount."""
    n = nodes(spark, sf_dir)
    src = n.select(F.col("id").alias("source"), F.col("name").alias("source_name"), F.col("file").alias("source_file"), F.col("start_line").alias("source_start"), F.col("end_line").alias("source_end"), F.col("kind").alias("source_kind"), F.col("is_test").alias("source_is_test"))
    strategy = F.when(F.col("l_returnflag") == "A", "import_map").when(F.col("l_returnflag") == "N", "lsp_ts_import").otherwise("suffix_match")
    calls = table(spark, sf_dir, "lineitem").select(_id("O", "l_orderkey").alias("source"), _id("P", "l_partkey").alias("target"), strategy.alias("strategy"), (1 - F.col("l_discount") * 2).alias("confidence"), F.col("l_linenumber").cast("int").alias("line"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("ord"))
    return calls.join(src, "source")


#: The largest difference of sizes that similar_enough() lets pass.
SIZES_APART = 5


def size_score(difference: Column) -> Column:
    return 1 - difference / 50


def sized_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the pairs below come from: id, group (brand and type) and size of each part."""
    group = F.when(F.col("p_brand").isNotNull() & F.col("p_type").isNotNull(), F.struct("p_brand", "p_type"))
    return table(spark, sf_dir, "part").select(_id("P", "p_partkey").alias("id"), group.alias("group"), F.col("p_size").cast("long").alias("size"))


def similar_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts sold by one supplier: a, b and a score from their sizes, for parts of one brand and type."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    q = p.toDF("q_partkey", "p_brand", "p_type", "q_size")
    score = size_score(F.abs(F.col("p_size") - F.col("q_size")))
    return p.join(q, ["p_brand", "p_type"]).filter("p_partkey < q_partkey").select(_id("P", "p_partkey").alias("a"), _id("P", "q_partkey").alias("b"), score.alias("score"), F.lit(False).alias("same_file"), F.lit(0).cast("long").alias("ord"))


def coverage(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Files of parts with lines covered by what was sold: listed, covered (file, line), functions, hits, stale."""
    part = table(spark, sf_dir, "part").select("p_partkey", part_file().alias("file"), "p_name", "p_brand")
    start = (F.col("p_partkey") % 40 * 10 + 1).cast("int")
    sold = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_linenumber", "l_returnflag").join(part, "p_partkey")
    name = _id("f", "p_partkey")
    return {
        "listed": part.select("file").distinct(),
        "covered": sold.filter("l_returnflag = 'A'").select("file", (start + F.col("l_linenumber")).cast("int").alias("line")).distinct(),
        "functions": part.select("file", name.alias("name"), start.alias("line")),
        "hits": sold.groupBy("file", name.alias("name")).agg(F.count_if(F.col("l_returnflag") == "A").alias("hits")),
        "stale": part.filter("p_brand = 'Brand#3'").select("file").distinct(),
    }


def change(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Parts of large sales as a change: changed (file, ord), listed (file), ranges (file, start, end)."""
    part = table(spark, sf_dir, "part").select("p_partkey", part_file().alias("file"), "p_brand")
    big = table(spark, sf_dir, "lineitem").filter("l_quantity >= 48").select(F.col("l_partkey").alias("p_partkey"), "l_linenumber").join(part, "p_partkey")
    start = (F.col("p_partkey") % 40 * 10 + F.col("l_linenumber")).cast("int")
    known = big.filter("p_brand != 'Brand#5'")
    return {
        "changed": big.groupBy("file").agg(F.min("p_partkey").alias("ord")),
        "listed": known.select("file").distinct(),
        "ranges": known.select("file", start.alias("start"), (start + 2).cast("int").alias("end")).distinct(),
    }
