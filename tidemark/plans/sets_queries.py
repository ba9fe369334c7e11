"""Top-k and set queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.plans.registry import query


@query("t01_top_k_by_count", "SELECT user_id, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 20")
def t01(t):
    return t("events").groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id").limit(20)


@query("t02_k_per_group_both_ends", """
WITH r AS (SELECT o_orderpriority AS p, o_orderkey AS o, o_totalprice AS v, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice,
  o_orderkey) AS a, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS b FROM orders)
SELECT p, o, v, a <= 3 AS low
FROM r
WHERE a <= 3 OR b <= 3
""")
def t02(t):
    o = t("orders").select(F.col("o_orderpriority").alias("p"), F.col("o_orderkey").alias("o"), F.col("o_totalprice").alias("v"))
    w, r = Window.partitionBy("p"), F.row_number()
    # two limits, each of which leaves a task three rows of a group before the shuffle
    low = o.withColumn("r", r.over(w.orderBy("v", "o"))).where("r <= 3").select("p", "o", "v", F.lit(True).alias("low"))
    high = o.withColumn("r", r.over(w.orderBy(F.desc("v"), "o"))).where("r <= 3").select("p", "o", "v", F.lit(False).alias("low"))
    return low.union(high).groupBy("p", "o", "v").agg(F.bool_or("low").alias("low"))  # a row at both ends is one


@query("t03_worst_of", """
SELECT event_type, max(m) AS worst, min(m) AS best
FROM (SELECT event_type, user_id, CASE WHEN count(*) >= 5 THEN max(value) END AS m FROM events GROUP BY 1, 2)
GROUP BY 1
""")
def t03(t):
    m = t("events").groupBy("event_type", "user_id").agg(F.when(F.count("*") >= 5, F.max("value")).alias("m"))
    return m.groupBy("event_type").agg(F.max("m").alias("worst"), F.min("m").alias("best"))


@query("t04_union_of_annotators", """
SELECT DISTINCT user_id, event_type
FROM events
WHERE value > 100 UNION SELECT DISTINCT user_id, event_type
FROM events
WHERE CAST(props->>'$.k' AS INTEGER) > 90
""")
def t04(t):
    e = t("events")
    return e.where("value > 100").select("user_id", "event_type").unionByName(e.where(F.get_json_object("props", "$.k").cast("int") > 90).select("event_type", "user_id")).distinct()


@query("t05_intersection", "SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 0")
def t05(t):
    return t("customer").select(F.col("c_nationkey").alias("nation")).intersect(t("supplier").where("s_acctbal > 0").select("s_nationkey"))


@query("t06_difference", "SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45")
def t06(t):
    return t("part").select("p_partkey").subtract(t("lineitem").where("l_returnflag = 'R' and l_quantity > 45").select("l_partkey"))
