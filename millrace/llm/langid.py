"""Language identification by Bayesian fusion of evidence.

For each row the log posterior of language l is, up to a constant,
    damped log P(text | l)  +  log P(declared | l)  +  log P(address suffix | l)  +  log prior(l | host).

Text: hashed byte trigrams of letters (2^15 cells), one distribution per declared language learned
from all rows, and a uniform one, `und`, for what is no language. Neighbouring trigrams are not
independent, so the sum is damped to at most `weight` trigrams' worth.
Declared language and suffix: smoothed shares within the rows whose text alone points to l.
Host prior: shares of text decisions per host, smoothed towards its site (the host without its
first label, if it has over two), that towards the suffix, that towards the whole table. All are
grouped aggregations with partial sums; a host with a third of the rows is one row of the result.

Languages are all declared ones. The model, dense, has 2^15 cells for each, and each row one posterior.
A row is kept if a language other than `und` has a posterior of at least `least`. Null or
letterless text has no text evidence: it is `und` and not kept. Null declared, url or host values
carry no evidence. Repeated rows and null ids are judged row by row. An empty table, or one with
no declared language at all, gives `und`. Further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import bound_batches, by_bytes, materialise, table

CELLS = 1 << 15
CHUNK = 1 << 18  # bytes of text whose trigrams are held at once
UNDETERMINED = "und"
_LETTERS = np.array([b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)], np.uint8)


def trigrams(raw: bytes) -> np.ndarray:
    """Cells of the byte trigrams that hold a letter."""
    b = _LETTERS[np.frombuffer(raw, np.uint8)]
    if len(b) < 3:
        b = np.concatenate([b, np.full(3 - len(b), 32, np.uint8)])
    code = b[:-2].astype(np.uint32) << 16 | b[1:-1].astype(np.uint32) << 8 | b[2:]
    code = code[code != 0x202020]
    return (code * np.uint32(2654435761)) >> np.uint32(17)


def histogram(raw: bytes) -> np.ndarray:
    """Counts of a text's cells, chunk by chunk; neighbouring chunks overlap by two bytes."""
    total = np.zeros(CELLS, np.int64)
    for lo in range(0, max(1, len(raw) - 2), CHUNK):
        total += np.bincount(trigrams(raw[lo : lo + CHUNK + 2]), minlength=CELLS)
    return total


def _counts(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}  # only of languages met
    index = {n: i for i, n in enumerate(names)}
    for batch in by_bytes(batches, "text", CHUNK):
        parts: dict[int, list[bytes]] = {}
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("declared").to_pylist(), strict=True):
            if lang in index and text:
                parts.setdefault(index[lang], []).append(text.encode("utf-8", "replace"))
        for i, texts in parts.items():
            n = histogram(b"\n\n\n".join(texts))
            total[i] = total[i] + n if i in total else n
    for i, n in total.items():
        at = np.flatnonzero(n)
        yield pa.record_batch({"l": pa.array(np.full(len(at), i), pa.int32()), "cell": pa.array(at, pa.int32()), "n": pa.array(n[at], pa.int64())})


def _likelihoods(batches: Iterator[pa.RecordBatch], logs: np.ndarray, weight: float) -> Iterator[pa.RecordBatch]:
    """logs: (languages and und, cells)."""
    across = np.ascontiguousarray(logs.T)
    for batch in by_bytes(batches, "text", CHUNK):
        rows = []
        for text in batch.column("text").to_pylist():
            raw = (text or "").encode("utf-8", "replace")
            if len(raw) <= CELLS:
                cells = trigrams(raw) if raw else np.zeros(0, np.uint32)
                n, total = len(cells), across[cells].sum(axis=0, dtype=np.float64)
            else:
                counts = histogram(raw)
                n, total = int(counts.sum()), counts.astype(np.float64) @ across
            rows.append(((total * min(0.5, weight / max(1, n))).tolist(), n))
        yield pa.record_batch({**{c: batch.column(c) for c in batch.schema.names if c != "text"}, "likelihood": pa.array([r[0] for r in rows], pa.list_(pa.float64())), "n_trigrams": pa.array([r[1] for r in rows], pa.int64())})


def _code(c: Column) -> Column:
    """A declared language's primary subtag, or null."""
    primary = F.regexp_extract(F.lower(F.trim(c.cast("string"))), "^([a-z]{2,3})(?:[-_].*)?$", 1)
    return F.when(primary != "", primary)


def identify(rows: DataFrame, weight: float = 150.0, least: float = 0.5, smooth: float = 5.0) -> DataFrame:
    """rows: id, text, declared, host (null where there is none). Returns id, lang, posterior, keep, text_lang."""
    bound_batches(rows.sparkSession)
    rows = rows.select("id", "text", _code(F.col("declared")).alias("declared"), F.lower("host").alias("host"))
    named = F.col("host").contains(".")
    rows = rows.withColumn("suffix", F.when(named, F.substring_index("host", ".", -1)))
    rows = rows.withColumn("site", F.when(F.size(F.split("host", r"\.")) > 2, F.regexp_replace("host", r"^[^.]*\.", "")).otherwise(F.col("host")))
    names = [r["declared"] for r in rows.filter("declared is not null").select("declared").distinct().collect()]
    names = sorted(n for n in names if n != UNDETERMINED)
    counts = np.zeros((len(names) + 1, CELLS))
    if names:
        got = rows.select("text", "declared").mapInArrow(lambda it: _counts(it, names), "l int, cell int, n long").groupBy("l", "cell").agg(F.sum("n").alias("n")).toPandas()
        counts[got["l"], got["cell"]] = got["n"]
    logs = np.log((counts + 0.1) / (counts.sum(axis=1, keepdims=True) + 0.1 * CELLS)).astype(np.float32)
    logs[-1] = -math.log(26**3)
    classes, size = [*names, UNDETERMINED], len(names) + 1
    text = rows.mapInArrow(lambda it: _likelihoods(it, logs, weight), f"id {dict(rows.dtypes)['id']}, declared string, host string, suffix string, site string, likelihood array<double>, n_trigrams long")
    best = F.when(F.col("n_trigrams") == 0, F.lit(size - 1)).otherwise((F.array_position("likelihood", F.array_max("likelihood")) - 1).cast("int"))
    text = materialise(text.withColumn("t", best), "langid-text")
    # All statistics come from this table: one row for each combination met, far fewer than texts.
    cells = materialise(text.groupBy("declared", "suffix", "site", "host", "t").agg(F.count("*").alias("count")), "langid-cells")

    def shares(by: str, up: str | None = None) -> DataFrame:
        """Per value of a column: counts of text decisions, one for each language."""
        keys = [by] if up is None else [by, up]
        per = cells.filter(F.col(by).isNotNull()).groupBy(*keys, "t").agg(F.sum("count").alias("count")).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("t", "count"))).alias("m"))
        return per.select(*keys, F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0))).alias("n"))

    def numbers(xs: np.ndarray) -> Column:
        """A constant array, of one literal whatever its length."""
        return F.split(F.lit(",".join(repr(float(x)) for x in xs)), ",").cast("array<double>")

    whole = np.zeros(size)
    for r in cells.groupBy("t").agg(F.sum("count").alias("count")).collect():
        whole[r["t"]] = r["count"]
    root = numbers((whole + 1) / (whole.sum() + size))
    of_class = numbers(whole)

    def towards(n: Column, parent: Column) -> Column:
        total = F.aggregate(n, F.lit(0).cast("long"), lambda a, x: a + x)
        return F.zip_with(n, parent, lambda x, p: (x + smooth * p) / (total + smooth))

    def given(n: Column, kinds: int) -> Column:
        """log P(value | l), smoothed."""
        return F.when(n.isNotNull(), F.zip_with(n, of_class, lambda x, c: F.log((x + 0.5) / (c + 0.5 * (kinds + 1))))).otherwise(F.array_repeat(F.lit(0.0), size))

    suffixes = shares("suffix").select("suffix", F.col("n").alias("suffix_n"), towards(F.col("n"), root).alias("suffix_p"))
    sites = shares("site", up="suffix").join(suffixes.select("suffix", "suffix_p"), "suffix", "left")
    sites = sites.select("site", towards(F.col("n"), F.coalesce("suffix_p", root)).alias("site_p"))
    hosts = shares("host", up="site").join(sites, "site", "left").select("host", towards(F.col("n"), F.coalesce("site_p", root)).alias("host_p"))
    hosts = materialise(hosts, "langid-hosts")
    declared = shares("declared").select("declared", F.col("n").alias("declared_n"))
    kinds = cells.agg(*[F.count_distinct(F.coalesce(c, F.lit(""))) for c in ("declared", "suffix")]).first()
    full = text.join(declared, "declared", "left").join(suffixes.select("suffix", "suffix_n"), "suffix", "left").join(hosts, "host", "left")
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    prior = F.transform(F.coalesce("host_p", root), lambda p: F.log(p))
    logp = add(add("likelihood", prior), add(given(F.col("declared_n"), kinds[0]), given(F.col("suffix_n"), kinds[1])))
    full = full.withColumn("logp", logp).withColumn("top", F.array_max("logp"))
    best = (F.array_position("logp", F.col("top")) - 1).cast("int")
    norm = F.aggregate("logp", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    voiced = F.col("n_trigrams") > 0
    label = F.split(F.lit(",".join(classes)), ",")
    lang = F.when(voiced, F.element_at(label, best + 1)).otherwise(F.lit(UNDETERMINED))
    out = full.select("id", lang.alias("lang"), F.when(voiced, 1 / norm).otherwise(F.lit(1.0)).alias("posterior"), F.element_at(label, F.col("t") + 1).alias("text_lang"))
    return out.withColumn("keep", (F.col("lang") != UNDETERMINED) & (F.col("posterior") >= least))


def from_documents(docs: DataFrame, id: Column | None = None) -> DataFrame:
    """Documents declare a language and name a source, which stands for the host."""
    return docs.select((F.col("doc_id").cast("long") if id is None else id).alias("id"), F.col("text").cast("string").alias("text"), F.col("lang").alias("declared"), F.col("source").cast("string").alias("host"))


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with all their columns. Rows alike in what is judged are judged alike."""
    same = F.xxhash64("doc_id", "text", "lang", "source")
    judged = identify(from_documents(docs, same))
    rejected = materialise(judged.filter(~F.col("keep")).select(F.col("id").alias("__rejected")).distinct(), "langid-rejected")
    return docs.join(rejected, same == F.col("__rejected"), "left_anti")


def from_pages(pages: DataFrame) -> DataFrame:
    html = F.col("html").cast("string")
    text = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"<[^>]*>|&#?\w+;", " ")
    host = F.lower(F.regexp_extract(F.col("url").cast("string"), "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return pages.select(F.col("page_id").cast("long").alias("id"), text.alias("text"), F.regexp_extract(html, r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z_-]+)""", 1).alias("declared"), F.when(host != "", host).alias("host"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(from_documents(table(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")


def pages_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(from_pages(table(spark, sf_dir, "pages"))).withColumnRenamed("id", "page_id")
