"""Shared pieces of the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.sources.scratch import fresh_path
from millrace.sources.tables import table  # noqa: F401  the operators' modules take it from here

#: A word is a maximal run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def drop_path(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


#: A batch of texts that goes to or from a Python worker holds so many bytes, unless the session sets its own bound.
_BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20)


def bound_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches in bytes: 10,000 rows, the default, may be any size. Operators that use Arrow call this."""
    key, most = _BATCH_BYTES
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(most))


#: Shuffle files of a finished write are of no further use: its result is in the shared folder.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut, and any executor can be lost."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("parquet.block.size", 32 << 20).parquet(path)  # a writer holds a row group in memory
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.millrace_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing will read again."""
    for t in tables:
        drop_path(t.sparkSession, t.millrace_path)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def id_residue(doc_id: Column, mod: int) -> Column:
    """crc32 of the id written as text, modulo mod; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod


def by_bytes(batches: Iterator[pa.RecordBatch], column: str, most: int = 2_000_000, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches whose values in a column hold about `most` bytes; a value is never split."""
    for batch in batches:
        at = batch.schema.get_field_index(column)
        values = batch.column(at)
        sizes = np.zeros(batch.num_rows, np.int64)
        if batch.num_rows and not pa.types.is_null(values.type):
            wide = pa.types.is_large_string(values.type) or pa.types.is_large_binary(values.type)
            offsets = np.frombuffer(values.buffers()[1], np.int64 if wide else np.int32)[values.offset : values.offset + batch.num_rows + 1]
            sizes = np.diff(offsets).astype(np.int64)
        ends = np.cumsum(sizes)
        lo = 0
        while lo < batch.num_rows:
            hi = int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right"))
            hi = min(max(lo + 1, hi), lo + rows, batch.num_rows)
            yield batch.slice(lo, hi - lo)
            lo = hi


def components(links: DataFrame) -> DataFrame:
    """node -> comp, the smallest node of its component, for every node that has a link (a, b).

    Alternating large- and small-star rounds, each written out; nodes are numbers or strings.
    """
    tidy = lambda a, b: (F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    edges = materialise(links.filter("a <> b").select(*tidy("a", "b")).distinct(), "cc-links")
    state = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v")
        edges = materialise(small.distinct(), "cc-edges")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
        state = now


def running(df: DataFrame, order: list, sums: dict[str, str]) -> DataFrame:
    """Adds, for each name -> column, the sum over all rows before it in `order`, and `n_before`, their number.

    Rows are dealt by ranges of the order; only one row for each range is added up in one task. The order must be total.
    """
    dealt = materialise(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "running")
    totals = dealt.groupBy("__part").agg(F.count("*").alias("__n"), *[F.sum(c).alias(f"__{n}") for n, c in sums.items()])
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    base = totals.select("__part", before("__n", earlier).alias("__n"), *[before(f"__{n}", earlier).alias(f"__{n}") for n in sums])
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    got = dealt.join(base, "__part")
    return got.select(*df.columns, (F.col("__n") + before(F.lit(1), inside)).alias("n_before"), *[(F.col(f"__{n}") + before(c, inside)).alias(n) for n, c in sums.items()])
