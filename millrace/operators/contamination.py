"""Benchmark contamination: documents that hold word runs of benchmark items, by an inverted join on n-grams.

Words are runs without white space, A-Z lower-cased; an n-gram is five of them. Each document's and
item's distinct n-grams meet in an equi-join, in which Spark broadcasts those of the benchmark while
they are small; beyond, adaptive execution splits an n-gram of very many documents. Only pairs that
share one are counted. Null, empty and shorter texts have no n-grams.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.registering import Queries
from millrace.sources.tables import table

query = Queries()
N = 5


def ngrams(df: DataFrame, id: str, n: int = N) -> DataFrame:
    """id and `g`, the distinct runs of n words of `text`. The words are a column of their own, so that they are split once."""
    plain = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = df.select(id, F.filter(F.split(plain, r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("w")).filter(F.size("w") >= n)
    last = F.greatest(F.size("w") - n + 1, F.lit(0))
    runs = F.slice("w", F.lit(1), last)
    for k in range(1, n):
        runs = F.zip_with(runs, F.slice("w", F.lit(1 + k), last), lambda a, b: F.concat(a, F.lit(" "), b))
    return words.select(id, F.array_distinct(runs).alias("g"))


def contaminated(docs: DataFrame, items: DataFrame, share: float = 0.5) -> DataFrame:
    """doc_id, item_id, common, item_grams: pairs where a document holds at least `share` of an item's n-grams."""
    grams = ngrams(items, "item_id").select("item_id", F.size("g").cast("long").alias("item_grams"), F.explode("g").alias("gram"))
    held = ngrams(docs, "doc_id").select("doc_id", F.explode("g").alias("gram")).join(grams, "gram")
    pairs = held.groupBy("doc_id", "item_id").agg(F.count("*").alias("common"), F.first("item_grams").alias("item_grams"))
    return pairs.filter(F.col("common") >= share * F.col("item_grams"))


@query(r"""
WITH d AS (SELECT doc_id AS id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
b AS (SELECT item_id AS id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
dg AS (SELECT id, unnest(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) AS gram FROM d WHERE len(w) >= 5),
bg AS (SELECT id, list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM b WHERE len(w) >= 5),
bu AS (SELECT id, len(g) AS item_grams, unnest(g) AS gram FROM bg)
SELECT dg.id AS doc_id, bu.id AS item_id, count(*) AS common, any_value(item_grams) AS item_grams FROM dg JOIN bu USING (gram) GROUP BY dg.id, bu.id HAVING count(*) >= 0.5 * any_value(item_grams)
""")
def contamination(spark, d):
    return contaminated(table(spark, d, "documents"), table(spark, d, "benchmark"))


QUERIES, SQL = query.queries, query.sql
