"""Checks over related tables: sources and orphans, clashes, coverage, diffs of snapshots, layered values.

Each definition is this library's own reading of a one-sentence description.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.operators.registering import Queries
from millrace.operators.relational import text_of
from millrace.sources.tables import table

query = Queries("cat_")


@query("SELECT 'documents without label' AS kind, count(*) AS n FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) UNION ALL SELECT 'labels without document', count(*) FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE l.doc_id = d.doc_id)")
def orphans(spark, d):
    docs, labels = table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id")
    one = lambda a, b, name: a.join(b, "doc_id", "left_anti").agg(F.lit(name).alias("kind"), F.count("*").alias("n"))
    return one(docs, labels, "documents without label").union(one(labels, docs, "labels without document"))


@query("SELECT text, count(DISTINCT source) AS sources FROM documents GROUP BY text HAVING count(DISTINCT source) >= 3")
def patterns_in_three_domains(spark, d):
    """Grouped by a digest; the text is fetched for what is found only. Null texts are one group."""
    docs = table(spark, d, "documents").select("doc_id", "text", "source", F.sha2("text", 256).alias("digest"))
    found = docs.groupBy("digest").agg(F.count_distinct("source").alias("sources"), F.min("doc_id").alias("first_id")).filter("sources >= 3")
    return text_of(found, docs.drop("source"), "first_id").select("text", "sources")


@query("SELECT p_name AS name, count(*) AS n FROM part GROUP BY p_name HAVING count(*) > 1")
def name_clashes(spark, d):
    return table(spark, d, "part").groupBy(F.col("p_name").alias("name")).agg(F.count("*").alias("n")).filter("n > 1")


@query("SELECT lang, count(*) AS n, count(l.doc_id) AS covered, round(count(l.doc_id) / count(*), 6) AS ratio FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY lang")
def coverage(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", F.lit(1).alias("has")), "doc_id", "left")
    return rows.groupBy("lang").agg(F.count("*").alias("n"), F.count("has").alias("covered")).withColumn("ratio", F.round(F.col("covered") / F.col("n"), 6))


@query("""
WITH old AS (SELECT o_orderkey, o_orderstatus FROM orders), new AS (SELECT l_orderkey AS o_orderkey, CASE WHEN count(DISTINCT l_linestatus) > 1 THEN 'P' ELSE max(l_linestatus) END AS o_orderstatus FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey, o_orderstatus, 'gone' AS change FROM (SELECT * FROM old EXCEPT ALL SELECT * FROM new) UNION ALL SELECT o_orderkey, o_orderstatus, 'new' FROM (SELECT * FROM new EXCEPT ALL SELECT * FROM old)
""")
def snapshot_diff(spark, d):
    """Orders' status as stored, against what their lines say."""
    old = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    status = F.when(F.min("l_linestatus") != F.max("l_linestatus"), "P").otherwise(F.max("l_linestatus"))
    new = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(status.alias("o_orderstatus"))
    return old.exceptAll(new).withColumn("change", F.lit("gone")).union(new.exceptAll(old).withColumn("change", F.lit("new")))


@query("SELECT c_custkey, coalesce(CASE WHEN c_acctbal < 0 THEN 'blocked' END, CASE WHEN c_mktsegment = 'BUILDING' THEN 'priority' END, 'standard') AS setting FROM customer")
def layered_setting(spark, d):
    c = F.col
    return table(spark, d, "customer").select("c_custkey", F.coalesce(F.when(c("c_acctbal") < 0, "blocked"), F.when(c("c_mktsegment") == "BUILDING", "priority"), F.lit("standard")).alias("setting"))


@query("SELECT count_if(o_totalprice IS NULL)::BIGINT AS no_price, count_if(o_totalprice < 0)::BIGINT AS negative, count_if(o_orderstatus NOT IN ('O', 'F', 'P'))::BIGINT AS bad_status, count(*) AS n FROM orders")
def layer_validation(spark, d):
    c = F.col
    return table(spark, d, "orders").agg(F.count_if(c("o_totalprice").isNull()).alias("no_price"), F.count_if(c("o_totalprice") < 0).alias("negative"), F.count_if(~c("o_orderstatus").isin("O", "F", "P")).alias("bad_status"), F.count("*").alias("n"))


@query("SELECT event_id, try_cast(props AS INT) AS whole, try_cast((props ->> '$.k') AS INT) AS k FROM events")
def unknown_is_null(spark, d):
    return table(spark, d, "events").select("event_id", F.col("props").try_cast("int").alias("whole"), F.get_json_object("props", "$.k").try_cast("int").alias("k"))


@query("SELECT conv_id, role, sum(len(string_split(text, ' ')))::BIGINT AS tokens FROM conversations GROUP BY ALL")
def tokens_per_session(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id", "role").agg(F.sum(F.size(F.split("text", " "))).alias("tokens"))


@query("SELECT conv_id, turn FROM conversations WHERE contains(lower(text), 'the')")
def conversation_search(spark, d):
    return table(spark, d, "conversations").filter(F.contains(F.lower("text"), F.lit("the"))).select("conv_id", "turn")


@query("SELECT r_name, n_name, c_mktsegment, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name, c_mktsegment)")
def hierarchy_rollup(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return c.rollup("r_name", "n_name", "c_mktsegment").agg(F.count("*").alias("n"))


_ASKED = "SELECT unnest(['FRANCE', 'ASIA', 'nowhere', 'EUROPE', 'CHINA', 'NATION_3', 'REGION_1']) AS name"


@query(f"SELECT q.name, coalesce(n_nationkey, r_regionkey) AS key, CASE WHEN n_nationkey IS NOT NULL THEN 'nation' WHEN r_regionkey IS NOT NULL THEN 'region' END AS found FROM ({_ASKED}) q LEFT JOIN nation ON q.name = n_name LEFT JOIN region ON q.name = r_name")
def name_then_fallback(spark, d):
    asked = spark.createDataFrame([("FRANCE",), ("ASIA",), ("nowhere",), ("EUROPE",), ("CHINA",), ("NATION_3",), ("REGION_1",)], "name string")
    got = asked.join(table(spark, d, "nation"), F.col("name") == F.col("n_name"), "left").join(table(spark, d, "region"), F.col("name") == F.col("r_name"), "left")
    return got.select("name", F.coalesce("n_nationkey", "r_regionkey").alias("key"), F.when(F.col("n_nationkey").isNotNull(), "nation").when(F.col("r_regionkey").isNotNull(), "region").alias("found"))


@query("SELECT o_custkey, count(*) AS open_orders FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey HAVING count(*) > 1")
def at_most_one_active(spark, d):
    """Customers that break the rule of one open order."""
    return table(spark, d, "orders").filter("o_orderstatus = 'O'").groupBy("o_custkey").agg(F.count("*").alias("open_orders")).filter("open_orders > 1")


@query("SELECT unnest(['customers', 'orders', 'price', 'clerk']) AS field, unnest([count(*), count(o_orderkey), count(o_totalprice), 0]) AS known, unnest([0, count(*) - count(o_orderkey), count(*) - count(o_totalprice), count(*)]) AS missing FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000")
def missing_profile(spark, d):
    j = table(spark, d, "customer").join(table(spark, d, "orders").filter("o_totalprice > 400000"), F.col("c_custkey") == F.col("o_custkey"), "left").withColumn("clerk", F.lit(None).cast("string"))
    fields = {"customers": "c_custkey", "orders": "o_orderkey", "price": "o_totalprice", "clerk": "clerk"}
    one = j.agg(F.count("*").alias("all"), *[F.count("*" if k == "customers" else c).alias(k) for k, c in fields.items()])
    return one.unpivot("all", list(fields), "field", "known").select("field", "known", (F.col("all") - F.col("known")).alias("missing"))


@query("SELECT phase, o_orderkey FROM (SELECT o_orderpriority AS phase, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3")
def best_of_each_phase(spark, d):
    """row_number <= k becomes a limit per group before the shuffle."""
    r = F.row_number().over(Window.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return table(spark, d, "orders").withColumn("r", r).filter("r <= 3").select(F.col("o_orderpriority").alias("phase"), "o_orderkey")


@query("SELECT l_partkey, sum(l_quantity) AS quantity, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_suppkey) >= 2 ORDER BY quantity DESC, l_partkey LIMIT 10")
def popular_first(spark, d):
    per = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("quantity"), F.count_distinct("l_suppkey").alias("suppliers"))
    return per.filter("suppliers >= 2").orderBy(F.desc("quantity"), "l_partkey").limit(10)


@query("SELECT lang, count(DISTINCT source) AS sources, round(avg(quality), 6) AS rating, CASE WHEN count(DISTINCT source) >= 3 THEN 'high' WHEN count(DISTINCT source) = 2 THEN 'medium' ELSE 'low' END AS confidence FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def rated_sources(spark, d):
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    got = j.groupBy("lang").agg(F.count_distinct("source").alias("sources"), F.round(F.avg("quality"), 6).alias("rating"))
    return got.withColumn("confidence", F.when(F.col("sources") >= 3, "high").when(F.col("sources") == 2, "medium").otherwise("low"))


@query("SELECT word, count(DISTINCT conv_id) AS conversations FROM (SELECT conv_id, unnest(string_split(lower(text), ' ')) AS word FROM conversations) WHERE len(word) >= 6 GROUP BY word HAVING count(DISTINCT conv_id) >= 5")
def affinity(spark, d):
    words = table(spark, d, "conversations").select("conv_id", F.explode(F.split(F.lower("text"), " ")).alias("word")).filter(F.length("word") >= 6)
    return words.distinct().groupBy("word").agg(F.count("*").alias("conversations")).filter("conversations >= 5")


@query("SELECT segment, key, any_value(value ORDER BY layer DESC) AS value FROM (SELECT DISTINCT c_mktsegment AS segment, unnest(['color', 'limit']) AS key, unnest(['grey', '10']) AS value, 1 AS layer FROM customer UNION ALL SELECT DISTINCT c_mktsegment, 'limit', '20', 2 FROM customer WHERE c_mktsegment < 'F' UNION ALL SELECT DISTINCT c_mktsegment, 'color', 'red', 3 FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY segment, key")
def layered_maps(spark, d):
    """Settings of three layers, later ones overriding earlier ones key by key."""
    seg = table(spark, d, "customer").select(F.col("c_mktsegment").alias("segment")).distinct()
    base = F.map_from_arrays(F.array(F.lit("color"), F.lit("limit")), F.array(F.lit("grey"), F.lit("10")))
    over = F.when(F.col("segment") < "F", F.create_map(F.lit("limit"), F.lit("20")))
    top = F.when(F.col("segment") == "BUILDING", F.create_map(F.lit("color"), F.lit("red")))
    pick = lambda low, high: F.when(high.isNull(), low).otherwise(F.map_zip_with(low, high, lambda k, a, b: F.coalesce(b, a)))
    return seg.select("segment", F.explode(pick(pick(base, over), top)).alias("key", "value"))


@query("SELECT c_custkey, c_acctbal IS NOT NULL AS has_balance, c_acctbal >= -1000 AS balance_ok, len(c_name) > 0 AS has_name, c_nationkey BETWEEN 0 AND 24 AS nation_ok FROM customer")
def rules_by_row(spark, d):
    """One column for each rule."""
    c = F.col
    return table(spark, d, "customer").select("c_custkey", c("c_acctbal").isNotNull().alias("has_balance"), (c("c_acctbal") >= -1000).alias("balance_ok"), (F.length("c_name") > 0).alias("has_name"), c("c_nationkey").between(0, 24).alias("nation_ok"))


QUERIES, SQL = query.queries, query.sql
