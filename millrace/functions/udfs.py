"""One query for each kind of user-defined function.

They show the kinds; built-in functions would do the same work faster, and are what other queries use.
"""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from millrace.operators.registering import Queries
from millrace.sources.tables import table

query = Queries()


@query("SELECT p_partkey, p_retailprice * 1.2 AS gross FROM part")
def udf_pandas(spark, d):
    @F.pandas_udf("double")
    def gross(x: pd.Series) -> pd.Series:
        return x * 1.2

    return table(spark, d, "part").select("p_partkey", gross("p_retailprice").alias("gross"))


@query("SELECT l_returnflag, round(max(l_quantity) - min(l_quantity), 6) AS spread FROM lineitem GROUP BY l_returnflag")
def udaf_grouped(spark, d):
    @F.pandas_udf("double")
    def spread(x: pd.Series) -> float:
        return float(x.max() - x.min())

    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(spread("l_quantity"), 6).alias("spread"))


@query("SELECT o_custkey, o_orderkey, o_totalprice - min(o_totalprice) OVER (PARTITION BY o_custkey) AS above FROM orders")
def udf_grouped_map(spark, d):
    def above(g: pd.DataFrame) -> pd.DataFrame:
        return g.assign(above=g.o_totalprice - g.o_totalprice.min())[["o_custkey", "o_orderkey", "above"]]

    return table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice").groupBy("o_custkey").applyInPandas(above, "o_custkey long, o_orderkey long, above double")


@query("SELECT n_nationkey, unnest(range(n_regionkey::BIGINT))::INT AS k FROM nation")
def udtf_lateral(spark, d):
    @F.udtf(returnType="k int")
    class Upto:
        def eval(self, n: int):
            for k in range(n or 0):
                yield (k,)

    spark.udtf.register("millrace_upto", Upto)
    table(spark, d, "nation").createOrReplaceTempView("millrace_nation")
    return spark.sql("SELECT n_nationkey, k FROM millrace_nation, LATERAL millrace_upto(n_regionkey)")


@query("SELECT doc_id, len(text) AS chars FROM documents")
def udf_map_in_pandas(spark, d):
    def chars(frames):
        for f in frames:
            yield pd.DataFrame({"doc_id": f.doc_id, "chars": f.text.str.len()})

    return table(spark, d, "documents").select("doc_id", "text").mapInPandas(chars, "doc_id long, chars long")


@query("SELECT c_custkey, count(o_orderkey) AS orders, round(coalesce(sum(o_totalprice), 0), 2) AS total FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def udf_cogrouped_map(spark, d):
    def both(c: pd.DataFrame, o: pd.DataFrame) -> pd.DataFrame:
        n = len(c)  # repeated customers count an order each, as in a join
        got = {"c_custkey": c.c_custkey[:1], "orders": n * int(o.o_orderkey.notna().sum()), "total": round(n * float(o.o_totalprice.sum()), 2)}
        return pd.DataFrame(got)

    c, o = table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice").filter("o_custkey is not null")
    return c.groupBy("c_custkey").cogroup(o.groupBy("o_custkey")).applyInPandas(both, "c_custkey long, orders long, total double")


@query("SELECT n_nationkey, len(n_name) AS chars FROM nation")
def udf_arrow(spark, d):
    @F.arrow_udf("long")
    def chars(x: pa.Array) -> pa.Array:
        return pc.utf8_length(x).cast(pa.int64())

    return table(spark, d, "nation").select("n_nationkey", chars("n_name").alias("chars"))


QUERIES, SQL = query.queries, query.sql
