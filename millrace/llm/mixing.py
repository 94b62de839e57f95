"""Mixing sources to target weights by Pareto order sampling. DataFrame functions only.

Each source has a target in words. A document's expected number of copies is its source's
target over its source's size: the whole part is certain, the rest p is an inclusion
probability. p varies between the documents of a source (longer ones are likelier, by `tilt`)
while its size-weighted mean stays the rest. Documents are ranked by
(u / (1 - u)) / (p / (1 - p)), u being a hash of the id, and the lowest ranks are taken until the
words reach what the whole copies left open; the last document is taken if that ends nearer to it.

The cut is found without sorting a source: three rounds each split the one bucket of ranks in
which the cut lies into 256, from summed sizes; of the last bucket only its distinct (rank, id, size)
are ordered. Rows that are equal in these (a repeated id, null ids) are taken one by one in the order
of their row numbers, written once before anything is counted: the number of the last one is found
from counts per input partition, so that no task sorts more than one of them, however many are equal.
Sources are ordered and summed up by ranges, so that they may be as many as hosts are.

Null text: size 0. Null source: a source of its own, last in order. Null ids share one hash.
An empty table gives no rows. Columns besides the three that are read are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import materialise, running, table, word_count

LEVELS = (256, 256**2, 256**3)


def source_targets(sized: DataFrame, weights=(5, 2, 1), share=1.5, max_copies=2) -> DataFrame:
    """One row per source: key, source_size, target and the sums for p. As many rows as sources."""
    per = sized.groupBy("key").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("x")).alias("sx"), F.max(F.col("source").isNull()).alias("null_last"))
    per = running(per, ["null_last", "key"], {})
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("n_before") % len(weights)) + 1).cast("int"))
    per = per.withColumn("w", w).withColumn("cap", F.lit(float(max_copies)) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("w"))
    # Water level: sources are filled in the order of cap / weight; the level is the greatest that any prefix of full ones leaves.
    per = running(per.drop("n_before"), ["ratio", "null_last", "key"], {"full": "cap", "w_full": "w"})
    all_size, all_w = per.agg(F.sum("source_size"), F.sum("w")).first()
    level = (F.lit(float(share)) * F.lit(all_size) - F.col("full")) / (F.lit(all_w) - F.col("w_full"))
    top = per.agg(F.max(level)).first()[0]
    return per.select("key", "source_size", F.least("cap", F.col("w") * F.lit(top)).alias("target"), "sx")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("key", F.when(F.col("source").isNull(), F.lit("~")).otherwise(F.concat(F.lit("="), F.col("source").cast("string"))))


def _ranked(sized: DataFrame, per: DataFrame, tilt: float, half_size: int, seed: str) -> DataFrame:
    """Adds rank (null where nothing is left to chance) and y, the rank brought into (0, 1)."""
    digits = F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}"))), 1, 13)
    u = (F.conv(digits, 16, 10).cast("long").cast("double") + 0.5) / float(2**52)
    p = F.col("rest") + F.least("rest", 1.0 - F.col("rest")) * tilt * (_x(half_size) / 1024.0 - F.col("mean_x"))
    ranked = sized.join(per, "key").withColumn("u", u).withColumn("p", p)
    odds = (F.col("u") / (1.0 - F.col("u"))) / (F.col("p") / (1.0 - F.col("p")))
    ranked = ranked.withColumn("rank", F.when((F.col("p") > 0) & (F.col("p") < 1), odds))
    return ranked.withColumn("y", F.col("rank") / (1.0 + F.col("rank")))


def _x(half_size: int):
    return F.floor(1024 * F.col("size") / (F.col("size") + half_size)).cast("long")


def _bucket(n: int):
    return F.least(F.floor(F.col("y") * n), F.lit(n - 1)).cast("long")


def mixing_plan(sized: DataFrame, weights=(5, 2, 1), share=1.5, max_copies=2, tilt=0.5, half_size=200, seed="mix") -> DataFrame:
    """Per source its target and its cut, from doc_id, source, key, size and row (a number for each row)."""
    per = source_targets(sized.withColumn("x", _x(half_size)), weights, share, max_copies)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.nullif(F.col("source_size"), F.lit(0))).otherwise(F.lit(0.0))
    per = per.withColumn("whole", F.floor(rate)).withColumn("rest", rate - F.col("whole"))
    per = per.withColumn("mean_x", F.coalesce(F.col("sx") / F.nullif(1024.0 * F.col("source_size"), F.lit(0.0)), F.lit(0.0)))
    per = materialise(per.withColumn("open", F.col("target") - F.col("whole") * F.col("source_size")).drop("sx"), "mix-targets")
    # The cut: `edge` has, per source, the bucket in which it lies and the words of the buckets before it.
    edge = per.select("key", "open", F.lit(0).cast("long").alias("bucket"), F.lit(0).cast("long").alias("before"))
    inside, width = _ranked(sized, per, tilt, half_size, seed).filter("rank is not null").select("key", "doc_id", "size", "row", "rank", "y"), 1
    for n in LEVELS:
        at = inside.join(edge, "key").filter(_bucket(width) == F.col("bucket"))
        sums = at.groupBy("key", _bucket(n).alias("b")).agg(F.sum("size").alias("words"), F.first("before").alias("base"), F.first("open").alias("open"))
        upto = F.col("base") + F.sum("words").over(Window.partitionBy("key").orderBy("b"))
        sums = sums.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("words"))
        edge = materialise(sums.filter("before <= open and open < upto").select("key", "open", F.col("b").alias("bucket"), "before"), "mix-edge")
        width = n
    last = inside.join(edge, "key").filter(_bucket(width) == F.col("bucket"))
    alike = last.groupBy("key", "rank", "doc_id", "size").agg(F.count("*").alias("n"), F.first("before").alias("before"), F.first("open").alias("open"))
    order = Window.partitionBy("key").orderBy("rank", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    alike = alike.withColumn("ahead", F.col("before") + F.coalesce(F.sum(F.col("n") * F.col("size")).over(order), F.lit(0)))
    # The j-th of n equal rows, from 0, is taken if 2 (ahead + j size) + size <= 2 open.
    left = 2.0 * (F.col("open") - F.col("ahead")) - F.col("size")
    many = F.when(left < 0, 0).when(F.col("size") == 0, F.col("n")).otherwise(F.least(F.col("n"), F.floor(left / F.nullif(2 * F.col("size"), F.lit(0))) + 1))
    cut = alike.withColumn("takes", many.cast("long")).filter("takes > 0").groupBy("key").agg(F.max(F.struct("rank", "doc_id", "size", "n", "takes")).alias("c"))
    cut = materialise(cut.select("key", F.struct("c.rank", "c.doc_id", "c.size").alias("last"), F.col("c.n").alias("n"), F.col("c.takes").alias("takes")), "mix-cut")
    # Which of the equal rows: whole input partitions first, then within one.
    tied = inside.join(cut.filter("takes < n").select("key", "last", "takes"), "key").filter(F.struct("rank", "doc_id", "size") == F.col("last")).select("key", "takes", "row", F.shiftright("row", 33).alias("part"))
    tied = materialise(tied, "mix-tied")
    parts = tied.groupBy("key", "part").agg(F.count("*").alias("n"), F.first("takes").alias("takes"))
    parts = parts.withColumn("ahead", F.coalesce(F.sum("n").over(Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    parts = parts.filter("ahead < takes and takes <= ahead + n").select("key", "part", (F.col("takes") - F.col("ahead")).alias("nth"))
    nth = tied.join(parts, ["key", "part"]).withColumn("k", F.row_number().over(Window.partitionBy("key", "part").orderBy("row")))
    rows = nth.filter("k = nth").select("key", F.col("row").alias("last_row"))
    edge = edge.join(cut.select("key", "last"), "key", "left").join(rows, "key", "left").select("key", "bucket", "last", "last_row", F.lit(True).alias("edged"))
    return materialise(per.join(edge, "key", "left"), "mix-plan")


def with_copies(sized: DataFrame, plan: DataFrame, tilt=0.5, half_size=200, seed="mix") -> DataFrame:
    """Adds the plan's columns and `copies` to rows that have doc_id, key, size and row."""
    ranked, b = _ranked(sized, plan, tilt, half_size, seed), _bucket(LEVELS[-1])
    mine = F.struct("rank", "doc_id", "size")
    upto = F.when(mine == F.col("last"), F.coalesce(F.col("row") <= F.col("last_row"), F.lit(True))).otherwise(mine < F.col("last"))
    taken = F.when(F.col("rank").isNull(), False).when(F.col("edged").isNull(), F.col("open") > 0).when(b != F.col("bucket"), b < F.col("bucket"))
    taken = F.coalesce(taken.otherwise(upto), F.lit(False))
    return ranked.withColumn("copies", F.col("whole") + taken.cast("long"))


def pareto_mix(docs: DataFrame, **options) -> DataFrame:
    """Copies per document so that each source's words come near its target.

    Options as in mixing_plan: weights by sources in code-point order, repeating; share, words of
    the mix over all words; max_copies bounds a source's target over its size, and so the copies of
    any document. Returns doc_id, source, size, source_size, target, copies, taken, one row per input row.
    """
    sized = materialise(_keyed(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.monotonically_increasing_id().alias("row"))), "mix-sizes")
    chance = {k: v for k, v in options.items() if k in ("tilt", "half_size", "seed")}
    got = with_copies(sized, mixing_plan(sized, **options), **chance)
    return got.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of docs as many times as it has copies, with the columns of docs.

    The rows are written with their numbers first: which of equal rows are taken hangs on these.
    """
    own = docs.columns
    plain = docs.select("doc_id", "source", word_count(F.col("text").cast("string")).alias("size"), F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(f"`{c}`") for c in own]).alias("whole_row"))
    rows = materialise(_keyed(plain), "mix-rows")
    chance = {k: v for k, v in options.items() if k in ("tilt", "half_size", "seed")}
    got = with_copies(rows, mixing_plan(rows.drop("whole_row"), **options), **chance).filter("copies > 0")
    got = got.select("whole_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    return got.select(*[F.col("whole_row").getField(c).alias(c) for c in own])


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pareto_mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP1_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
e AS (SELECT *, floor(1024 * size / (size + 200.0))::BIGINT AS x FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size, sum(size * x)::BIGINT AS sx FROM e GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w, 2.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0.0::DOUBLE)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0.0::DOUBLE)) AS level
  FROM w WINDOW o AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, sx, least(cap, w * max(level) OVER ()) AS target FROM l),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END::DOUBLE AS rate FROM t),
q AS (SELECT *, floor(rate)::BIGINT AS whole, rate - floor(rate) AS rest, coalesce(sx / nullif(1024.0::DOUBLE * source_size, 0), 0) AS mean_x FROM r),
p AS (SELECT e.*, q.source_size, q.target, q.whole, q.target - q.whole * q.source_size AS opening,
  q.rest + least(q.rest, 1.0::DOUBLE - q.rest) * 0.5::DOUBLE * (x / 1024.0::DOUBLE - q.mean_x) AS p,
  (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':mix'), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM e JOIN q ON e.source IS NOT DISTINCT FROM q.source),
k AS (SELECT *, CASE WHEN p > 0 AND p < 1 THEN (u / (1.0::DOUBLE - u)) / (p / (1.0::DOUBLE - p)) END AS rnk FROM p),
c AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rnk NULLS LAST, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto FROM k)
SELECT doc_id, size, source_size, target, ((whole + CASE WHEN rnk IS NOT NULL AND 2.0::DOUBLE * upto - size <= 2.0::DOUBLE * opening THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM c
"""
