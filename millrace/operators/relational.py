"""Relational queries: scan, filter, join, aggregate, window, sort and set operators.

Definitions are this library's own. Ranked queries break ties by a unique column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.operators.registering import Queries
from millrace.sources.tables import table

query = Queries()


@query("""
SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem
JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name
""")
def revenue_by_nation(spark: SparkSession, d: str) -> DataFrame:
    joined = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    per = joined.groupBy("c_nationkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))
    return per.join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.round(F.sum("revenue"), 2).alias("revenue"))


@query("""
SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS n,
  round(stddev_samp(l_quantity), 6) AS sd, median(l_quantity) AS med, count(DISTINCT l_partkey) AS parts
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL
""")
def pricing_summary(spark, d):
    """The exact median comes from counts by value, which are added up before the shuffle, not from whole groups."""
    rows = table(spark, d, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    keys = ["l_returnflag", "l_linestatus"]
    sums = rows.groupBy(*keys).agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"), F.round(F.stddev_samp("l_quantity"), 6).alias("sd"))
    parts = rows.select(*keys, "l_partkey").distinct().groupBy(*keys).agg(F.count("l_partkey").alias("parts"))
    return join_alike(join_alike(sums, medians(rows, keys, "l_quantity"), keys), parts, keys)


def join_alike(left, right, keys):
    """A left join on equal keys, null equal to null, with one set of the key columns."""
    other = right.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return left.join(other, on, "left").drop(*[f"__{k}" for k in keys])


def medians(rows, keys, value):
    """Exact medians (`med`) of a column's values in groups: a grouped count by value, then the place of the middle in running counts."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*keys)
    upto = counts.withColumn("upto", F.sum("c").over(w.orderBy("v"))).withColumn("all", F.sum("c").over(w))
    # Of n values in order the middle ones are the ((n + 1) div 2)-th and the (n div 2 + 1)-th.
    place = lambda k: F.min(F.when(F.col("upto") >= k, F.col("v")))
    return upto.groupBy(*keys).agg(((place(F.expr("(all + 1) div 2")) + place(F.expr("all div 2 + 1"))) / 2).alias("med"))


@query("SELECT l_orderkey, l_quantity, l_extendedprice FROM lineitem WHERE l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24 AND l_returnflag IN ('A', 'R')")
def filtered_scan(spark, d):
    return table(spark, d, "lineitem").filter(F.col("l_discount").between(0.05, 0.07) & (F.col("l_quantity") < 24) & F.col("l_returnflag").isin("A", "R")).select("l_orderkey", "l_quantity", "l_extendedprice")


@query("SELECT c_custkey, c_name, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'low' ELSE 'high' END AS band, round(c_acctbal)::INT AS whole FROM customer WHERE c_name LIKE '%1'")
def projection_case_cast(spark, d):
    band = F.when(F.col("c_acctbal") < 0, "debt").when(F.col("c_acctbal") < 5000, "low").otherwise("high")
    return table(spark, d, "customer").filter(F.col("c_name").like("%1")).select("c_custkey", "c_name", band.alias("band"), F.round("c_acctbal").cast("int").alias("whole"))


def _joined(how, least=None):
    def run(spark, d):
        o = table(spark, d, "orders")
        o = (o if least is None else o.filter(F.col("o_totalprice") > least)).select("o_orderkey", "o_custkey")
        c = table(spark, d, "customer").select("c_custkey", "c_name")
        return c.join(o, F.col("c_custkey") == F.col("o_custkey"), how)

    return run


for _how, _sql in (("inner", "JOIN"), ("left", "LEFT JOIN"), ("right", "RIGHT JOIN"), ("full", "FULL JOIN")):
    query.queries[f"base_join_{_how}"] = _joined(_how)
    query.sql[f"base_join_{_how}"] = f"SELECT c_custkey, c_name, o_orderkey, o_custkey FROM customer {_sql} orders ON c_custkey = o_custkey"
for _how, _not in (("left_semi", ""), ("left_anti", "NOT ")):  # customers with, and without, an order of over 400,000
    query.queries[f"base_join_{_how}"] = _joined(_how, 400_000)
    query.sql[f"base_join_{_how}"] = f"SELECT c_custkey, c_name FROM customer WHERE {_not}EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)"


@query("SELECT s_suppkey, s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def join_broadcast(spark, d):
    """A hint, for a side of a checked size: over 10 MB of it the planner decides."""
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    small = n._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() <= 10 << 20
    return table(spark, d, "supplier").join(F.broadcast(n) if small else n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_name", "n_name")


@query("SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_name < b.n_name")
def join_theta(spark, d):
    n = table(spark, d, "nation")
    a, b = n.alias("a"), n.alias("b")
    return a.join(b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_name") < F.col("b.n_name"))).select(F.col("a.n_name").alias("a"), F.col("b.n_name").alias("b"))


@query("SELECT c_custkey, o_orderkey, o_totalprice FROM customer, LATERAL (SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) t")
def join_lateral(spark, d):
    c = table(spark, d, "customer").select("c_custkey")
    o = table(spark, d, "orders").filter(F.col("o_custkey") == F.col("c_custkey").outer()).orderBy(F.desc("o_totalprice"), "o_orderkey").limit(1).select("o_orderkey", "o_totalprice")
    return c.lateralJoin(o)


@query("SELECT p_partkey FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= 45) AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity <= 2)")
def exists_filters(spark, d):
    p, l = table(spark, d, "part").select("p_partkey"), table(spark, d, "lineitem").withColumnRenamed("l_partkey", "p_partkey")
    return p.join(l.filter("l_quantity >= 45"), "p_partkey", "left_semi").join(l.filter("l_quantity <= 2"), "p_partkey", "left_anti")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000 WHERE o_orderkey IS NULL OR o_orderkey IS NOT DISTINCT FROM c_custkey")
def null_tests(spark, d):
    o = table(spark, d, "orders").filter("o_totalprice > 300000")
    j = table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey")
    return j.filter(F.col("o_orderkey").isNull() | F.col("o_orderkey").eqNullSafe(F.col("c_custkey")))


@query("""
SELECT c_custkey, big, place FROM (SELECT c_custkey, big, row_number() OVER (ORDER BY big DESC NULLS FIRST, c_custkey) AS place FROM
  (SELECT c_custkey, max(o_totalprice) AS big FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey)) WHERE place <= 30
""")
def sort_null_placement(spark, d):
    big = table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.max("o_totalprice").alias("big"))
    order = [F.col("big").desc_nulls_first(), F.col("c_custkey").asc_nulls_last()]
    first = big.orderBy(*order).limit(30)
    return first.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long"))


@query("""
WITH e AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'view'), c AS (SELECT user_id, ts, max(event_id) AS click_id FROM events WHERE event_type = 'click' GROUP BY ALL)
SELECT e.event_id, c.click_id, c.ts AS click_ts FROM e ASOF LEFT JOIN c ON e.user_id = c.user_id AND e.ts >= c.ts
""")
def join_as_of(spark, d):
    """Each view's last click by the same user at or before it: one pass over a union ordered by time.

    Clicks without user or time match no view; a view without them, or without an id, is kept.
    """
    e = table(spark, d, "events")
    views = e.filter("event_type = 'view'").select("user_id", "ts", "event_id", F.lit(None).cast("long").alias("click_id"), F.lit(True).alias("is_view"))
    clicks = e.filter("event_type = 'click' and user_id is not null and ts is not null").groupBy("user_id", "ts").agg(F.max("event_id").alias("click_id")).select("user_id", "ts", F.lit(None).cast("long").alias("event_id"), "click_id", F.lit(False).alias("is_view"))
    click = F.when(~F.col("is_view"), F.struct("click_id", "ts"))
    w = Window.partitionBy("user_id").orderBy("ts", "is_view").rowsBetween(Window.unboundedPreceding, 0)
    return views.union(clicks).withColumn("c", F.last(click, ignorenulls=True).over(w)).filter("is_view").select("event_id", F.col("c.click_id").alias("click_id"), F.col("c.ts").alias("click_ts"))


@query("""
SELECT a.event_id AS click, b.event_id AS purchase FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'purchase'
  AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 1 DAY
""")
def join_interval(spark, d):
    e = table(spark, d, "events")
    a, b = e.filter("event_type = 'click'").alias("a"), e.filter("event_type = 'purchase'").alias("b")
    near = (F.col("a.user_id") == F.col("b.user_id")) & (F.col("b.ts") > F.col("a.ts")) & (F.col("b.ts") <= F.col("a.ts") + F.expr("interval 1 day"))
    return a.join(b, near).select(F.col("a.event_id").alias("click"), F.col("b.event_id").alias("purchase"))


@query("SELECT s_suppkey, p_partkey FROM supplier JOIN part ON p_retailprice BETWEEN abs(s_acctbal) - 5 AND abs(s_acctbal) + 5")
def join_range(spark, d):
    """A band join as an equi-join on buckets of the band's width, then the exact condition."""
    width = 10.0
    s = table(spark, d, "supplier").select("s_suppkey", F.abs("s_acctbal").alias("x"))
    s = s.withColumn("bucket", F.explode(F.sequence(F.floor((F.col("x") - 5) / width), F.floor((F.col("x") + 5) / width))))
    p = table(spark, d, "part").select("p_partkey", "p_retailprice", F.floor(F.col("p_retailprice") / width).alias("bucket"))
    return s.join(p, "bucket").filter(F.col("p_retailprice").between(F.col("x") - 5, F.col("x") + 5)).select("s_suppkey", "p_partkey")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2")
def top_per_group(spark, d):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders").withColumn("r", F.row_number().over(w)).filter("r <= 2").select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS qty, count(*) AS n, (grouping(l_returnflag) * 2 + grouping(l_linestatus))::BIGINT AS gid FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube(spark, d):
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("qty"), F.count("*").alias("n"), F.grouping_id().alias("gid"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def rollup(spark, d):
    return table(spark, d, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority))")
def grouping_sets(spark, d):
    o = table(spark, d, "orders")
    return o.groupingSets([[o.o_orderstatus], [o.o_orderpriority]], o.o_orderstatus, o.o_orderpriority).agg(F.count("*").alias("n"))


@query("SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view FROM events GROUP BY user_id")
def pivot(spark, d):
    return table(spark, d, "events").groupBy("user_id").pivot("event_type", ["click", "view"]).agg(F.count(F.lit(1))).fillna(0, ["click", "view"])


@query("SELECT p_partkey, unnest(['size', 'price']) AS name, unnest([p_size::DOUBLE, p_retailprice]) AS value FROM part")
def unpivot(spark, d):
    return table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price")).unpivot("p_partkey", ["size", "price"], "name", "value")


@query("""
SELECT o_orderkey, rank() OVER w AS rnk, dense_rank() OVER w AS dense, row_number() OVER u AS rn, ntile(4) OVER u AS quarter, round(percent_rank() OVER w, 9) AS pct, round(cume_dist() OVER w, 9) AS cume,
  lag(o_orderkey) OVER u AS before, lead(o_orderkey) OVER u AS after, first_value(o_orderkey) OVER u AS first, nth_value(o_orderkey, 2) OVER u AS second FROM orders
WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate), u AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
""")
def window_functions(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate")
    u = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    k = "o_orderkey"
    return table(spark, d, "orders").select(k, F.rank().over(w).alias("rnk"), F.dense_rank().over(w).alias("dense"), F.row_number().over(u).alias("rn"), F.ntile(4).over(u).alias("quarter"), F.round(F.percent_rank().over(w), 9).alias("pct"), F.round(F.cume_dist().over(w), 9).alias("cume"), F.lag(k).over(u).alias("before"), F.lead(k).over(u).alias("after"), F.first(k).over(u).alias("first"), F.nth_value(k, 2).over(u).alias("second"))


@query("""
SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS in_hour,
  round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS last3 FROM events
""")
def window_frames(spark, d):
    e = table(spark, d, "events")
    hour = F.expr("count(*) over (partition by user_id order by ts range between interval 1 hour preceding and current row)")
    rows = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-2, 0)
    return e.select("event_id", hour.alias("in_hour"), F.round(F.sum("value").over(rows), 6).alias("last3"))


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 5")
def top_k(spark, d):
    return table(spark, d, "customer").select("c_custkey", "c_acctbal").orderBy(F.desc("c_acctbal"), "c_custkey").offset(5).limit(20)


for _name, _op in (("union_all", "UNION ALL"), ("union", "UNION"), ("intersect", "INTERSECT"), ("intersect_all", "INTERSECT ALL"), ("except", "EXCEPT"), ("except_all", "EXCEPT ALL")):

    def _set(spark, d, name=_name):
        c, s = table(spark, d, "part").select(F.col("p_size").alias("k")), table(spark, d, "nation").select(F.col("n_nationkey").alias("k"))
        return {"union_all": lambda: c.union(s), "union": lambda: c.union(s).distinct(), "intersect": lambda: c.intersect(s), "intersect_all": lambda: c.intersectAll(s), "except": lambda: c.subtract(s), "except_all": lambda: c.exceptAll(s)}[name]()

    query.queries[f"base_set_{_name}"] = _set
    query.sql[f"base_set_{_name}"] = f"SELECT p_size AS k FROM part {_op} SELECT n_nationkey AS k FROM nation"


@query("SELECT text, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY text HAVING count(*) > 1")
def exact_copies(spark, d):
    """Texts are grouped by a 256-bit digest; the text is fetched for the first id of each group of copies only.

    Null texts are copies of one another; repeated and null ids give a group one row still.
    """
    docs = table(spark, d, "documents").select("doc_id", "text", F.sha2("text", 256).alias("digest"))
    groups = docs.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).filter("n > 1")
    return text_of(groups, docs, "first_id").select("text", "n", "first_id")


def text_of(groups, docs, first):
    """Groups, one row for each digest, with the text of a document that has the digest and the group's first id."""
    found = join_alike(groups, docs.withColumnRenamed("doc_id", first), ["digest", first])
    return found.groupBy("digest", *[c for c in groups.columns if c != "digest"]).agg(F.any_value("text").alias("text"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE ('0x' || substr(md5(o_orderkey::VARCHAR), 1, 4))::INT < 6554")
def hash_sample(spark, d):
    """A tenth of the rows, the same on every run and engine."""
    return table(spark, d, "orders").filter(F.conv(F.substring(F.md5(F.col("o_orderkey").cast("string")), 1, 4), 16, 10).cast("int") < 6554).select("o_orderkey", "o_totalprice")


@query("""
SELECT c_mktsegment, max_by(c_custkey, c_custkey * 1.0) AS last, count_if(c_acctbal > 0)::BIGINT AS pos, bool_and(c_acctbal > -1000) AS all_ok, round(corr(c_acctbal, c_custkey), 6) AS r,
  list_sort(list(DISTINCT c_nationkey)) AS nations, string_agg(DISTINCT c_nationkey::VARCHAR, ',' ORDER BY c_nationkey::VARCHAR) AS listed, quantile_cont(c_acctbal, 0.25) AS q1 FROM customer GROUP BY c_mktsegment
""")
def aggregates(spark, d):
    k = F.col("c_nationkey").cast("string")
    return table(spark, d, "customer").groupBy("c_mktsegment").agg(F.max_by("c_custkey", "c_custkey").alias("last"), F.count_if(F.col("c_acctbal") > 0).alias("pos"), F.bool_and(F.col("c_acctbal") > -1000).alias("all_ok"), F.round(F.corr("c_acctbal", "c_custkey"), 6).alias("r"), F.array_sort(F.collect_set("c_nationkey")).alias("nations"), F.array_join(F.array_sort(F.collect_set(k)), ",").alias("listed"), F.percentile("c_acctbal", 0.25).alias("q1"))


@query("""
SELECT l_returnflag, round(skewness(l_extendedprice), 6) AS skew, round(kurtosis_pop(l_extendedprice), 6) AS kurt, mode(l_linenumber) AS mode_line, round(covar_pop(l_quantity, l_extendedprice), 3) AS cov_p, round(covar_samp(l_quantity, l_extendedprice), 3) AS cov_s,
  min_by(l_orderkey, l_orderkey * 10 + l_linenumber) AS first_order, sum(DISTINCT l_quantity) AS distinct_qty, round(var_pop(l_quantity), 6) AS var_p, bool_or(l_discount > 0.09) AS any_high, bit_xor(l_orderkey) AS folded, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, string_agg(DISTINCT l_linestatus, '|' ORDER BY l_linestatus) AS listed
FROM lineitem GROUP BY l_returnflag
""")
def aggregates_more(spark, d):
    """skewness here is the population's, times the correction for a sample that the SQL twin has; kurtosis is the excess."""
    n, x = F.count("l_extendedprice"), F.col("l_extendedprice")
    lines = table(spark, d, "lineitem")
    return lines.groupBy("l_returnflag").agg(
        F.round(F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2), 6).alias("skew"), F.round(F.kurtosis(x), 6).alias("kurt"), F.mode("l_linenumber", deterministic=True).alias("mode_line"),
        F.round(F.covar_pop("l_quantity", x), 3).alias("cov_p"), F.round(F.covar_samp("l_quantity", x), 3).alias("cov_s"), F.min_by("l_orderkey", F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("first_order"),
        F.sum_distinct("l_quantity").alias("distinct_qty"), F.round(F.var_pop("l_quantity"), 6).alias("var_p"), F.bool_or(F.col("l_discount") > 0.09).alias("any_high"), F.bit_xor("l_orderkey").alias("folded"),
        F.round(F.regr_slope(x, F.col("l_quantity")), 4).alias("slope"), F.listagg_distinct("l_linestatus", F.lit("|")).alias("listed"),
    )


@query("SELECT o_orderpriority, count(*) AS n FROM orders WHERE ('0x' || substr(md5(o_orderkey::VARCHAR), 1, 4))::INT < CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 32768 ELSE 6554 END GROUP BY o_orderpriority")
def stratified_sample(spark, d):
    """Half of the pressing orders and a tenth of the others, the same on every run and engine."""
    u = F.conv(F.substring(F.md5(F.col("o_orderkey").cast("string")), 1, 4), 16, 10).cast("int")
    kept = table(spark, d, "orders").filter(u < F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), 32768).otherwise(6554))
    return kept.groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query()
def approximate(spark, d):
    """Sketches: no SQL twin, as engines differ; their error is tested."""
    lines = table(spark, d, "lineitem")
    return lines.agg(F.approx_count_distinct("l_partkey").alias("parts"), F.hll_sketch_estimate(F.hll_sketch_agg("l_partkey")).alias("hll"), F.percentile_approx("l_extendedprice", 0.5).alias("median"), F.theta_sketch_estimate(F.theta_sketch_agg("l_partkey")).alias("theta"), F.when(F.count("l_extendedprice") > 0, F.kll_sketch_get_quantile_double(F.kll_sketch_agg_double("l_extendedprice"), F.lit(0.5))).alias("kll_median"))


QUERIES, SQL = query.queries, query.sql
