"""Extras over the star schema: joins, grouping sets, windows and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.plans.catalogue import query, table

REVENUE = "l_extendedprice * (1 - l_discount)"


@query("""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(DISTINCT o_orderkey) AS orders FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def revenue_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partial sums by customer's nation; only the fixed table of nations is broadcast by hand."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.expr(REVENUE).alias("r"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    per_order = lines.groupBy("l_orderkey").agg(F.sum("r").alias("r"))
    j = per_order.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    n = j.groupBy("c_nationkey").agg(F.sum("r").alias("r"), F.count(F.lit(1)).alias("orders"))
    named = n.join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return named.select("n_name", F.round("r", 2).alias("revenue"), "orders")


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS quantity, round(sum(l_extendedprice), 2) AS price, grouping(l_returnflag, l_linestatus)::BIGINT AS level FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def rollup_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus")
    return r.agg(F.sum("l_quantity").alias("quantity"), F.round(F.sum("l_extendedprice"), 2).alias("price"), F.grouping_id().cast("long").alias("level"))


@query("""SELECT p_brand, p_partkey, rank FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY q DESC, p_partkey) AS rank
FROM (SELECT l_partkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1) JOIN part ON l_partkey = p_partkey) WHERE rank <= 5""")
def top_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("q"))
    j = q.join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    w = Window.partitionBy("p_brand").orderBy(F.desc("q"), "p_partkey")
    return j.withColumn("rank", F.row_number().over(w).cast("long")).filter("rank <= 5").select("p_brand", "p_partkey", "rank")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') AND c_custkey IN (SELECT o_custkey FROM orders)")
def customers_without_urgent(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return c.join(o, "c_custkey", "left_semi").join(o.filter("o_orderpriority = '1-URGENT'"), "c_custkey", "left_anti")


@query("(SELECT p_brand FROM part WHERE p_size > 45 INTERSECT SELECT p_brand FROM part WHERE p_size < 20) EXCEPT SELECT p_brand FROM part WHERE p_size = 33")
def brand_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    b = lambda where: p.filter(where).select("p_brand")
    return b("p_size > 45").intersect(b("p_size < 20")).subtract(b("p_size = 33"))


@query("""SELECT o_custkey, o_orderkey, o_totalprice, round(o_totalprice - lag(o_totalprice) OVER w, 2) AS change, ntile(4) OVER w AS quarter FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def order_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, sf_dir, "orders")
    return o.select("o_custkey", "o_orderkey", "o_totalprice", F.round(F.col("o_totalprice") - F.lag("o_totalprice").over(w), 2).alias("change"), F.ntile(4).over(w).cast("long").alias("quarter"))
