"""Set operations, with and without priority."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossarium.plans.registry import query
from glossarium.plans.tables import table


@query("set01_union_all", "SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT n_name FROM nation")
def union_all(spark, d):
    n = table(spark, d, "nation").select(F.col("n_name").alias("name"))
    return n.unionByName(table(spark, d, "region").select(F.col("r_name").alias("name"))).unionByName(n)


@query("set02_union_priority", "SELECT name, min(p) AS p FROM (SELECT c_nationkey AS name, 0 AS p FROM customer UNION ALL SELECT s_nationkey, 1 FROM supplier) GROUP BY name")
def union_priority(spark, d):
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("name"), F.lit(0).alias("p"))
    return c.unionByName(table(spark, d, "supplier").select(F.col("s_nationkey").alias("name"), F.lit(1).alias("p"))).groupBy("name").agg(F.min("p").alias("p"))


@query("set03_intersect", "SELECT l_suppkey AS k FROM lineitem INTERSECT SELECT s_suppkey FROM supplier")
def intersect(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k")).intersect(table(spark, d, "supplier").select(F.col("s_suppkey").alias("k")))


@query("set04_except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 200000")
def except_(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k")).join(table(spark, d, "orders").filter("o_totalprice > 200000").select(F.col("o_custkey").alias("k")), "k", "left_anti").distinct()


@query("set05_array_union", "SELECT p_partkey, array_to_string(list_sort(list_distinct(list_concat(string_split(p_name, ' '), [lower(p_type)]))), ' ') AS merged FROM part")
def array_union(spark, d):
    both = F.array_union(F.split("p_name", " "), F.array(F.lower("p_type")))
    return table(spark, d, "part").select("p_partkey", F.array_join(F.sort_array(both), " ").alias("merged"))


@query("set06_stage_merge", "SELECT p_partkey, min(stage) AS stage FROM (SELECT p_partkey, 0 AS stage FROM part WHERE p_name = 'hot gear' UNION ALL SELECT p_partkey, 1 FROM part WHERE starts_with(p_name, 'hot')) GROUP BY p_partkey")
def stage_merge(spark, d):
    p = table(spark, d, "part")
    a = p.filter("p_name = 'hot gear'").select("p_partkey", F.lit(0).alias("stage"))
    return a.unionByName(p.filter(F.col("p_name").startswith("hot")).select("p_partkey", F.lit(1).alias("stage"))).groupBy("p_partkey").agg(F.min("stage").alias("stage"))
