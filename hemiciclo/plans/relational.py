"""Queries of the relational operators on the star schema: joins, windows, sets, reshaping, top-k."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hemiciclo.plans.registry import Registry
from hemiciclo.session import table

registry = Registry()
query = registry.query


@query("SELECT n_name, r_name, count(c_custkey) AS customers, round(sum(c_acctbal), 2) AS balance FROM nation LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name, r_name")
def left_join_star(spark, d):
    """Customers are counted per nation before they meet the dimensions."""
    per = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("c_custkey").alias("customers"), F.sum("c_acctbal").alias("balance"))
    nations = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return nations.join(per, F.col("n_nationkey") == F.col("c_nationkey"), "left").groupBy("n_name", "r_name").agg(F.coalesce(F.sum("customers"), F.lit(0)).alias("customers"), F.round(F.sum("balance"), 2).alias("balance"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS lines, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_discount FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def pricing_summary(spark, d):
    rows = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("lines"), F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_discount"))


@query("SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') GROUP BY o_orderpriority")
def semi_join(spark, d):
    returned = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").join(returned, "o_orderkey", "left_semi").groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL) GROUP BY c_mktsegment")
def anti_join(spark, d):
    placed = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(placed, "c_custkey", "left_anti").groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query("SELECT l_partkey % 5 AS shelf, p_brand, s_nationkey, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL")
def inner_join_two_keys(spark, d):
    rows = table(spark, d, "lineitem").select("l_partkey", "l_suppkey")
    joined = rows.join(table(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).join(table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.groupBy((F.col("l_partkey") % 5).alias("shelf"), "p_brand", "s_nationkey").agg(F.count("*").alias("n"))


@query("SELECT a.n_name AS nation_a, b.n_name AS nation_b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def self_pairs_lt(spark, d):
    n = table(spark, d, "nation")
    a, b = n.alias("a"), n.alias("b")
    return a.join(b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey"))).select(F.col("a.n_name").alias("nation_a"), F.col("b.n_name").alias("nation_b"))


@query("SELECT o_orderpriority, round(o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_orderpriority), 9) AS part, o_orderkey FROM orders")
def share_of_total(spark, d):
    """The totals are grouped and joined back: a window would sort each priority in one task."""
    o = table(spark, d, "orders").select("o_orderpriority", "o_totalprice", "o_orderkey")
    totals = o.groupBy("o_orderpriority").agg(F.sum("o_totalprice").alias("total"))
    return o.join(totals, "o_orderpriority").select("o_orderpriority", F.round(F.col("o_totalprice") / F.col("total"), 9).alias("part"), "o_orderkey")


@query("SELECT p_brand, round(median(p_retailprice), 6) AS median_price, round(quantile_cont(p_retailprice, 0.1), 6) AS p10, round(quantile_cont(p_retailprice, 0.75), 6) AS p75, round(stddev_samp(p_retailprice), 6) AS sd, round(corr(p_size, p_retailprice), 6) AS size_price_corr, count(DISTINCT p_type) AS types FROM part GROUP BY p_brand")
def quantiles_by_group(spark, d):
    p = table(spark, d, "part")
    return p.groupBy("p_brand").agg(F.round(F.median("p_retailprice"), 6).alias("median_price"), F.round(F.percentile("p_retailprice", 0.1), 6).alias("p10"), F.round(F.percentile("p_retailprice", 0.75), 6).alias("p75"), F.round(F.stddev_samp("p_retailprice"), 6).alias("sd"), F.round(F.corr("p_size", "p_retailprice"), 6).alias("size_price_corr"), F.count_distinct("p_type").alias("types"))


@query("WITH g AS (SELECT c_mktsegment, avg(c_acctbal) AS m, count(*) AS n FROM customer GROUP BY 1) SELECT c_mktsegment, n, round((m - avg(m) OVER ()) / stddev_samp(m) OVER (), 6) AS z FROM g")
def zscore_of_groups(spark, d):
    g = table(spark, d, "customer").groupBy("c_mktsegment").agg(F.avg("c_acctbal").alias("m"), F.count("*").alias("n"))
    whole = g.agg(F.avg("m").alias("mm"), F.stddev_samp("m").alias("sd"))  # one row
    return g.join(F.broadcast(whole), F.lit(True)).select("c_mktsegment", "n", F.round((F.col("m") - F.col("mm")) / F.col("sd"), 6).alias("z"))


@query("SELECT c_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) JOIN customer ON o_custkey = c_custkey WHERE n = 1")
def top_one_per_group(spark, d):
    """The best order by a combining aggregate, not a window: a customer with very many orders costs no more."""
    best = table(spark, d, "orders").groupBy("o_custkey").agg(F.min(F.struct((-F.col("o_totalprice")).alias("far"), "o_orderkey")).alias("b"))
    return best.join(table(spark, d, "customer").select("c_custkey"), F.col("o_custkey") == F.col("c_custkey")).select("c_custkey", "b.o_orderkey", (-F.col("b.far")).alias("o_totalprice"))


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier ORDER BY s_acctbal DESC NULLS LAST, s_suppkey LIMIT 15")
def top_k_report(spark, d):
    return table(spark, d, "supplier").orderBy(F.desc_nulls_last("s_acctbal"), "s_suppkey").limit(15).select("s_suppkey", "s_name", "s_acctbal")


@query("""WITH fresh AS (SELECT c_custkey, c_name, c_acctbal + 1000 AS c_acctbal, 2 AS src FROM customer WHERE c_nationkey = 3), b AS (SELECT c_custkey, c_name, c_acctbal, 1 AS src FROM customer)
    SELECT c_custkey, c_name, c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY src DESC) AS n FROM (SELECT * FROM b UNION ALL SELECT * FROM fresh)) WHERE n = 1""")
def upsert_last_wins(spark, d):
    from hemiciclo.sources.baseline import upserted

    base = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", "c_nationkey")
    fresh = base.where("c_nationkey = 3").withColumn("c_acctbal", F.col("c_acctbal") + 1000)
    return upserted(["c_custkey"], base, fresh).select("c_custkey", "c_name", "c_acctbal")


@query("SELECT 'customer' AS kind, c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_acctbal, NULL FROM supplier")
def union_fill(spark, d):
    c = table(spark, d, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, d, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    return c.unionByName(s, allowMissingColumns=True)


@query("SELECT o_custkey, min(o_orderkey) AS first_order FROM orders GROUP BY o_custkey")
def distinct_on_first(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("first_order"))


@query("SELECT o_orderstatus, " + ", ".join(f"count(*) FILTER (WHERE o_orderpriority = '{p}') AS \"{p}\"" for p in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-LOW", "5-LOW")) + " FROM orders GROUP BY o_orderstatus")
def pivot_wide(spark, d):
    """The columns are named, so that no pass is needed to find them."""
    return table(spark, d, "orders").groupBy("o_orderstatus").pivot("o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-LOW", "5-LOW"]).count().na.fill(0)


@query("SELECT l_orderkey, l_linenumber, 'discount' AS measure, l_discount AS value FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'tax', l_tax FROM lineitem")
def unpivot_long(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"))
    return rows.unpivot(["l_orderkey", "l_linenumber"], ["discount", "tax"], "measure", "value")


@query("SELECT n_nationkey AS k FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer) AND n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0)")
def set_operations(spark, d):
    nations = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"))
    return nations.intersect(table(spark, d, "customer").select(F.col("c_nationkey").alias("k"))).subtract(table(spark, d, "supplier").where("s_acctbal < 0").select(F.col("s_nationkey").alias("k")))


@query("SELECT 'orders' AS metric, count(*)::VARCHAR AS value FROM orders UNION ALL SELECT 'customers', count(DISTINCT o_custkey)::VARCHAR FROM orders UNION ALL SELECT 'first_day', min(o_orderdate)::DATE::VARCHAR FROM orders UNION ALL SELECT 'open', (count(*) FILTER (WHERE o_orderstatus = 'O'))::VARCHAR FROM orders")
def metric_value_table(spark, d):
    m = table(spark, d, "orders").agg(F.count("*").alias("orders"), F.count_distinct("o_custkey").alias("customers"), F.min("o_orderdate").cast("date").alias("first_day"), F.count_if(F.col("o_orderstatus") == "O").alias("open"))
    return m.select(*(F.col(c).cast("string").alias(c) for c in m.columns)).unpivot([], m.columns, "metric", "value")


@query("SELECT coalesce(c_mktsegment, 'all') AS segment, coalesce(n_name, 'all') AS nation, count(*) AS n, round(avg(c_acctbal), 6) AS mean FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY GROUPING SETS ((c_mktsegment, n_name), (c_mktsegment), ())")
def grouping_sets(spark, d):
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rolled = rows.rollup("c_mktsegment", "n_name").agg(F.count("*").alias("n"), F.round(F.avg("c_acctbal"), 6).alias("mean"))
    return rolled.select(F.coalesce("c_mktsegment", F.lit("all")).alias("segment"), F.coalesce("n_name", F.lit("all")).alias("nation"), "n", "mean")


@query("SELECT event_type, CAST(json_extract(props, '$.k') AS INT) % 10 AS k, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def json_fields(spark, d):
    e = table(spark, d, "events").withColumn("p", F.from_json("props", "k int"))
    return e.groupBy("event_type", (F.col("p.k") % 10).alias("k")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'filled' ELSE o_orderstatus END AS status FROM orders")
def recode_labels(spark, d):
    labels = F.create_map(F.lit("O"), F.lit("open"), F.lit("F"), F.lit("filled"))
    return table(spark, d, "orders").select("o_orderkey", F.coalesce(F.try_element_at(labels, F.col("o_orderstatus")), F.col("o_orderstatus")).alias("status"))


@query()
def sample_per_group(spark, d):
    """Six rows of each axis, the same ones at every run: those of smallest hash. The sample is the feature."""
    rows = table(spark, d, "propuestas").select("axis", "proposal_id").distinct().withColumn("h", F.xxhash64("proposal_id", F.lit(42)))
    return rows.withColumn("n", F.row_number().over(W.partitionBy("axis").orderBy("h", "proposal_id"))).where("n <= 6").select("axis", "proposal_id")


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def window_counts(spark, d):
    """The batch form of the streaming count; the stream itself is tested in tests/."""
    from hemiciclo.streaming.flows import windowed_counts

    return windowed_counts(table(spark, d, "events"), "ts", "event_type", "value")
