"""Sources and sinks: formats written to a scratch folder and read back, and a Python data source."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from millrace.operators.registering import Queries
from millrace.sources.scratch import fresh_path
from millrace.sources.tables import table

query = Queries()


def _scratch(spark) -> str:
    return fresh_path(spark, "io")


def _trip(fmt: str):
    def run(spark, d):
        path, df = _scratch(spark), table(spark, d, "supplier")
        writer = df.write.format(fmt)
        reader = spark.read.schema(df.schema).format(fmt)
        if fmt == "csv":
            writer, reader = writer.option("header", True), reader.option("header", True)
        if fmt == "xml":
            writer, reader = writer.option("rowTag", "row"), reader.option("rowTag", "row")
        writer.save(path)
        return reader.load(path)

    return run


for _fmt in ("csv", "json", "orc", "parquet", "xml"):
    query.queries[f"base_roundtrip_{_fmt}"] = _trip(_fmt)
    query.sql[f"base_roundtrip_{_fmt}"] = "SELECT * FROM supplier"


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def partitioned_sink(spark, d):
    path = _scratch(spark)
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    orders.write.partitionBy("o_orderstatus").parquet(path)
    return spark.read.schema(orders.schema).parquet(path).filter(F.col("o_orderstatus") == "F").select("o_orderkey", "o_custkey", "o_orderstatus")


@query("SELECT n_name AS value FROM nation")
def roundtrip_text(spark, d):
    path = _scratch(spark)
    table(spark, d, "nation").select("n_name").write.text(path)
    return spark.read.text(path)


@query("SELECT c_custkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey")
def bucketed_join(spark, d):
    """Both tables bucketed by the key: the join needs no exchange."""
    names = []
    for name, key in (("customer", "c_custkey"), ("orders", "o_custkey")):
        names.append(f"millrace_{name}_{uuid.uuid4().hex}")
        columns = [key] if name == "customer" else [key, "o_orderkey"]
        table(spark, d, name).select(*columns).write.bucketBy(8, key).sortBy(key).option("path", _scratch(spark)).saveAsTable(names[-1])
    c, o = (spark.table(n) for n in names)
    return c.join(o.hint("merge"), F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "o_orderkey")


@query("SELECT i::BIGINT AS id, (i * i)::BIGINT AS square FROM range(100) t(i)")
def python_source(spark, d):
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    class Squares(DataSource):
        @classmethod
        def name(cls):
            return "millrace_squares"

        def schema(self):
            return "id long, square long"

        def reader(self, schema):
            return Reader()

    class Reader(DataSourceReader):
        def partitions(self):
            return [InputPartition(k) for k in range(4)]

        def read(self, partition):
            for i in range(25 * partition.value, 25 * partition.value + 25):
                yield i, i * i

    spark.dataSource.register(Squares)
    return spark.read.format("millrace_squares").load()


QUERIES, SQL = query.queries, query.sql
