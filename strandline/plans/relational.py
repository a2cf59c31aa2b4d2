"""Relational queries over the star schema and the event table: the part of the SQL surface that the engine delegates to Spark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import asof, compare
from .inputs import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * l_discount AS saved FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01' AND l_shipdate < TIMESTAMP '1996-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24")
def sql_scan_filter(spark, d):
    t = table(spark, d, "lineitem").where("l_shipdate >= TIMESTAMP '1995-01-01' AND l_shipdate < TIMESTAMP '1996-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24")
    return t.select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") * F.col("l_discount")).alias("saved"))  # not rounded: engines differ at ties


@query("SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def sql_inner_join(spark, d):
    o, c, n = (table(spark, d, x) for x in ("orders", "customer", "nation"))
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return j.groupBy("n_name").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def sql_left_join(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("orders"))


@query("SELECT coalesce(c.n, 0) AS customers, coalesce(s.n, 0) AS suppliers, coalesce(c.k, s.k) AS nation FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal < 0 GROUP BY 1) c FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) s ON c.k = s.k")
def sql_full_join(spark, d):
    c = table(spark, d, "customer").where("c_acctbal < 0").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("customers"))
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("suppliers"))
    return c.join(s, "k", "full").withColumnRenamed("k", "nation").na.fill(0, ["customers", "suppliers"])


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def sql_semi_join(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders").where("o_totalprice > 200000")
    return c.join(o, c.c_custkey == o.o_custkey, "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)")
def sql_anti_join(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders").where("o_totalprice > 450000")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey", "c_name")


@query("SELECT b.name, count(*) AS parts, round(avg(p_retailprice), 4) AS price FROM part JOIN (VALUES ('small', 0, 10), ('medium', 10, 30), ('large', 30, 99)) AS b(name, lo, hi) ON p_size >= b.lo AND p_size < b.hi GROUP BY b.name")
def sql_range_join(spark, d):
    bands = spark.createDataFrame([("small", 0, 10), ("medium", 10, 30), ("large", 30, 99)], "name string, lo int, hi int")
    p = table(spark, d, "part")
    j = p.join(bands, (p.p_size >= bands.lo) & (p.p_size < bands.hi))  # three bands beside the parts
    return j.groupBy("name").agg(F.count(F.lit(1)).alias("parts"), F.round(F.avg("p_retailprice"), 4).alias("price"))


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS charge, round(avg(l_discount), 6) AS discount, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus")
def sql_pricing_summary(spark, d):
    t = table(spark, d, "lineitem").where("l_shipdate <= TIMESTAMP '1998-09-02'")
    charge = F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    return t.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.sum(charge), 2).alias("charge"), F.round(F.avg("l_discount"), 6).alias("discount"), F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderpriority, count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderstatus) AS states FROM orders GROUP BY o_orderpriority")
def sql_distinct_aggregates(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count_distinct("o_custkey").alias("customers"), F.count_distinct("o_orderstatus").alias("states"))


@query("SELECT r_name, n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance, CAST(grouping(r_name) + grouping(n_name) AS BIGINT) AS level FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def sql_rollup(spark, d):
    c, n, r = (table(spark, d, x) for x in ("customer", "nation", "region"))
    j = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.rollup("r_name", "n_name").agg(F.count(F.lit(1)).alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"), (F.grouping("r_name") + F.grouping("n_name")).cast("long").alias("level"))


@query("SELECT c_mktsegment, coalesce(c_nationkey, -1) AS c_nationkey, count(*) AS n FROM customer GROUP BY CUBE (c_mktsegment, c_nationkey)")
def sql_cube(spark, d):
    return table(spark, d, "customer").cube("c_mktsegment", "c_nationkey").agg(F.count(F.lit(1)).alias("n")).na.fill(-1, ["c_nationkey"])


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def sql_grouping_sets(spark, d):
    return spark.sql("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())", orders=table(spark, d, "orders"))


@query("SELECT * FROM (SELECT o_custkey, o_orderkey, CAST(row_number() OVER w AS BIGINT) AS rn, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS BIGINT) AS rk, CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS BIGINT) AS dr FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)) WHERE rn <= 3")
def sql_ranking_windows(spark, d):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    p = Window.partitionBy("o_custkey").orderBy("o_orderpriority")
    t = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).cast("long").alias("rn"), F.rank().over(p).cast("long").alias("rk"), F.dense_rank().over(p).cast("long").alias("dr"))
    return t.where("rn <= 3")


@query("SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS running, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS step, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS following FROM events")
def sql_analytic_windows(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("event_id", F.round(F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)), 4).alias("running"), F.round(F.col("value") - F.lag("value").over(w), 6).alias("step"), F.lead("event_type").over(w).alias("following"))


@query("SELECT p_partkey, p_name, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10")
def sql_top_k(spark, d):
    return table(spark, d, "part").orderBy(F.desc("p_retailprice"), "p_partkey").limit(10).select("p_partkey", "p_name", "p_retailprice")


@query("(SELECT c_nationkey AS k, 'both' AS kind FROM customer INTERSECT SELECT s_nationkey, 'both' FROM supplier) UNION ALL (SELECT n_nationkey, 'no supplier' FROM nation EXCEPT SELECT s_nationkey, 'no supplier' FROM supplier)")
def sql_set_operations(spark, d):
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("k"))
    s, n = table(spark, d, "supplier").select(F.col("s_nationkey").alias("k")), table(spark, d, "nation").select(F.col("n_nationkey").alias("k"))
    return c.intersect(s).withColumn("kind", F.lit("both")).union(n.exceptAll(n.join(s, "k", "left_semi")).distinct().withColumn("kind", F.lit("no supplier")))


_ABOVE = "WITH a AS (SELECT c_nationkey AS k, avg(c_acctbal) AS m FROM {customer} GROUP BY c_nationkey) SELECT c_custkey, c_nationkey FROM {customer} JOIN a ON c_nationkey = a.k WHERE c_acctbal > a.m AND c_acctbal > (SELECT avg(c_acctbal) FROM {customer})"


@query(_ABOVE.replace("{customer}", "customer"))
def sql_subqueries(spark, d):
    return spark.sql(_ABOVE, customer=table(spark, d, "customer"))


@query("SELECT p_partkey, upper(substr(p_name, 1, 8)) AS head, concat(p_brand, '-', p_type) AS label, length(p_name) AS n, CASE WHEN p_size > 25 THEN 'big' WHEN p_size > 10 THEN 'mid' ELSE 'small' END AS class, replace(p_type, ' ', '_') AS kind, round(sqrt(p_retailprice), 4) AS root, coalesce(nullif(p_size % 5, 0), -1) AS part_mod FROM part")
def sql_scalar_functions(spark, d):
    c = F.when(F.col("p_size") > 25, "big").when(F.col("p_size") > 10, "mid").otherwise("small")
    mod = F.coalesce(F.nullif(F.col("p_size") % 5, F.lit(0)), F.lit(-1))
    return table(spark, d, "part").select("p_partkey", F.upper(F.substring("p_name", 1, 8)).alias("head"), F.concat("p_brand", F.lit("-"), "p_type").alias("label"), F.length("p_name").cast("long").alias("n"), c.alias("class"), F.replace("p_type", F.lit(" "), F.lit("_")).alias("kind"), F.round(F.sqrt("p_retailprice"), 4).alias("root"), mod.alias("part_mod"))


@query("SELECT CAST(extract(year FROM o_orderdate) AS BIGINT) AS y, CAST(extract(month FROM o_orderdate) AS BIGINT) AS m, round(sum(o_totalprice), 2) AS revenue, CAST(max(date_diff('day', date_trunc('month', o_orderdate), o_orderdate)) AS BIGINT) AS last_day FROM orders GROUP BY 1, 2")
def sql_date_functions(spark, d):
    t = table(spark, d, "orders")
    day = F.datediff("o_orderdate", F.date_trunc("month", "o_orderdate"))
    return t.groupBy(F.year("o_orderdate").cast("long").alias("y"), F.month("o_orderdate").cast("long").alias("m")).agg(F.round(F.sum("o_totalprice"), 2).alias("revenue"), F.max(day).cast("long").alias("last_day"))


@query("SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY event_type")
def sql_json(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k"))


@query("SELECT label, count(*) AS n, CAST(max(len(embedding)) AS BIGINT) AS dims, round(CAST(max(list_max(embedding)) AS DOUBLE), 4) AS top FROM embeddings GROUP BY label")
def sql_arrays(spark, d):
    return table(spark, d, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).cast("long").alias("dims"), F.round(F.max(F.array_max("embedding")).cast("double"), 4).alias("top"))


@query("SELECT vec_id, CAST(i AS BIGINT) AS i, round(CAST(x AS DOUBLE), 5) AS x FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) WHERE i <= 4")
def sql_explode(spark, d):
    t = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x"))
    return t.where("i < 4").select("vec_id", (F.col("i") + 1).cast("long").alias("i"), F.round(F.col("x").cast("double"), 5).alias("x"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def sql_time_buckets(spark, d):
    t = table(spark, d, "events").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return t.select(F.col("window.start").alias("start"), "event_type", "n", "total")


@query("SELECT * FROM (PIVOT (SELECT o_orderpriority, o_orderstatus FROM orders) ON o_orderstatus IN ('F', 'O', 'P') USING count(*) GROUP BY o_orderpriority)")
def sql_pivot(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).na.fill(0)


@query("SELECT n_name, coalesce(c.n, 0) AS rich FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 9000 GROUP BY 1) c RIGHT JOIN nation ON c.k = n_nationkey")
def sql_right_join(spark, d):
    c = table(spark, d, "customer").where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    n = table(spark, d, "nation")
    return c.join(n, c.k == n.n_nationkey, "right").select("n_name", F.coalesce("n", F.lit(0)).alias("rich"))


@query("SELECT r_name, s.status, (SELECT count(*) FROM orders WHERE o_orderstatus = s.status) AS orders FROM region CROSS JOIN (VALUES ('F'), ('O'), ('P')) AS s(status)")
def sql_cross_join(spark, d):
    """Two dimension tables of a few rows each."""
    status = spark.createDataFrame([("F",), ("O",), ("P",)], "status string")
    n = table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("orders"))
    every = table(spark, d, "region").crossJoin(status)
    return every.join(n, every.status == n.o_orderstatus, "left").select("r_name", "status", F.coalesce("orders", F.lit(0)).alias("orders"))


@query("SELECT a.event_id, b.event_id AS last_id, b.value AS last_value FROM (SELECT * FROM events WHERE event_id % 3 = 0) a ASOF LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id DESC) AS n FROM events WHERE event_id % 3 = 1) WHERE n = 1) b ON a.user_id = b.user_id AND a.ts >= b.ts")
def sql_asof_join(spark, d):
    e = table(spark, d, "events")
    right = e.where("event_id % 3 = 1").select("user_id", "ts", F.col("event_id").alias("last_id"), F.col("value").alias("last_value"))
    return asof.asof_join(e.where("event_id % 3 = 0").select("event_id", "user_id", "ts"), right, "ts", ["user_id"], tie="last_id").select("event_id", "last_id", "last_value")


@query("SELECT o_orderpriority, true AS is_near FROM orders GROUP BY o_orderpriority")
def sql_approximate_distinct(spark, d):
    """Whether the sketch is within 15 % of the exact count (the engines' sketches differ)."""
    t = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.approx_count_distinct("o_custkey", 0.02).alias("a"), F.count_distinct("o_custkey").alias("n"))
    return t.select("o_orderpriority", (F.abs(F.col("a") - F.col("n")) <= 0.15 * F.col("n")).alias("is_near"))


@query("SELECT o_orderkey, CAST(ntile(4) OVER w AS BIGINT) AS quarter, first_value(o_orderkey) OVER w AS first_key, CAST(count(*) OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND CURRENT ROW) AS BIGINT) AS week FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey)")
def sql_window_frames(spark, d):
    w = Window.partitionBy("o_orderpriority").orderBy("o_totalprice", "o_orderkey")
    t = table(spark, d, "orders")
    week = F.expr("count(1) OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND CURRENT ROW)")
    return t.select("o_orderkey", F.ntile(4).over(w).cast("long").alias("quarter"), F.first_value("o_orderkey").over(w).alias("first_key"), week.alias("week"))


_OWN_MAX = "SELECT c_custkey, (SELECT max(o_totalprice) FROM {orders} o WHERE o.o_custkey = c.c_custkey) AS largest FROM {customer} c WHERE c_acctbal > (SELECT avg(c_acctbal) FROM {customer} x WHERE x.c_nationkey = c.c_nationkey)"


@query(_OWN_MAX.replace("{orders}", "orders").replace("{customer}", "customer"))
def sql_correlated_subquery(spark, d):
    return spark.sql(_OWN_MAX, orders=table(spark, d, "orders"), customer=table(spark, d, "customer"))


@query("SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n, max(sha256(CAST(event_id AS VARCHAR))) AS top FROM events GROUP BY 1, 2")
def sql_json_and_digests(spark, d):
    """JSON parsed to a struct and written back, and SHA-256."""
    t = table(spark, d, "events").withColumn("p", F.from_json(F.to_json(F.from_json("props", "k long")), "k long"))
    return t.groupBy("event_type", F.col("p.k").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.max(F.sha2(F.col("event_id").cast("string"), 256)).alias("top"))


@query("SELECT count(*) AS changed FROM customer WHERE c_custkey % 50 = 0")
def multiset_comparison(spark, d):
    """A table against a copy with other names for every fiftieth customer: two digests differ for each."""
    t = table(spark, d, "customer").select("c_custkey", "c_name")
    other = t.withColumn("c_name", F.when(F.col("c_custkey") % 50 == 0, F.concat("c_name", F.lit("?"))).otherwise(F.col("c_name")))
    return compare.multiset_difference(t, other, t.columns).agg((F.count(F.lit(1)) / 2).cast("long").alias("changed"))


@query("SELECT o_orderkey, p AS place, b AS before FROM (SELECT o_orderkey, p, lag(p) OVER (ORDER BY a) AS b FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS p, o_orderkey + CASE WHEN o_orderkey % 100 = 7 THEN 50 ELSE 0 END + CASE WHEN o_orderkey % 100 = 7 THEN 0.5 ELSE 0 END AS a FROM orders)) WHERE b > p")
def output_order(spark, d):
    """Orders with some moved down by fifty places, against their first order."""
    t = table(spark, d, "orders").select("o_orderkey")
    source = t.withColumn("idx", F.row_number().over(Window.orderBy("o_orderkey")).cast("long"))  # a small table of the check
    moved = t.withColumn("idx", F.col("o_orderkey") + F.when(F.col("o_orderkey") % 100 == 7, 50.5).otherwise(0.0))
    return compare.out_of_order(moved, source, "o_orderkey")
