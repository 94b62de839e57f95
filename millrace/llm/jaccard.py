"""N-gram Jaccard self-join with a token-group matrix.

A document's tokens are the distinct five-word shingles of its whole text, as 64-bit hashes. Two
documents link when 100 * common >= 80 * united; the result is the connected components.

1. Documents with equal sets are one class (128-bit digest of the set); only classes go on.
2. Prefixes: in any fixed order of tokens, linked sets of sizes a and b share at least min(k(a), k(b))
   of the first a - ceil(0.8 a) + k(a) and b - ceil(0.8 b) + k(b) tokens; k is a tenth of the size.
   The order is by hash, but tokens of many prefixes come last, so that passages shared by unlike
   documents don't select. They are known by a bitmap, filled from counts over all classes and sized
   from their number, up to 16 MB: beyond, more tokens count as hot, which changes an order, not a
   result. Tokens of one class only are dropped by a grouped count, and classes left with too few.
3. Groups: per shared token the smallest class leads; each class joins the leader with which it shares
   most, if enough, and is compared with it. Classes joined this way, linked or not, are a group of
   similar documents. Its largest linked part needs no further comparison within itself; the
   other classes of the group are asked against all of it.
4. Token-group matrix: the distinct (token, group) rows of prefixes, with the sizes of the classes that
   have the token. Tokens of one group only select nothing. A class keeps m others, of which any link
   between two groups shares min k; classes with fewer are out, in the matrix as well. Of the m, the
   m - min k + 1 that are in fewest groups must then hold a shared one: only these are joined, to groups
   with classes of a fitting size (the smaller group's classes are asked, which is enough).
   Groups are stored in blocks, each with the union of its members' tokens, built once and written;
   a block's members are read only for candidates that have ceil(0.8 a) tokens in the union, and all
   intersections in it are one product of 0/1 matrices. Only links that connect something new leave a
   block. (In step 3 a group is one class so far, which is its own union.)
5. Components over all links, by alternating large- and small-star rounds, each written out.

Blocks hold at most `block` members and candidates, however large a group is; all counts are
partial sums. What is joined on a token is written before, so that both sides of the join are plain
exchanges, which adaptive execution splits where a token has very many rows.

Null or empty text: no tokens, no links, component_id is its own id. Fewer than five words: one
token of the whole sequence. Repeated rows are copies. Rows of one id with different texts are one
node with both texts' links. Null ids: linked through their texts, never named as a component
unless it has no other id (null). An empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import bound_batches, by_bytes, components, materialise, release, table

WIDTH = 5
NUMERATOR, DENOMINATOR = 80, 100
BITS = (1 << 16, 1 << 27)  # least and most bits of a bitmap
HOT = 50
NAMELESS = 1 << 62  # ids of classes without any doc_id lie from here on


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    if n < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=n)], np.uint64)
    x = h[: n - width + 1].copy()
    for k in range(1, width):
        x *= np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x += h[k : n - width + 1 + k]
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return np.unique(x)


def least_common(n: int) -> int:
    """Tokens of a set of n that any linked set has: common >= 0.8 * united >= 0.8 n."""
    return -(-NUMERATOR * n // DENOMINATOR)


def spare(n: int) -> int:
    """k(n): prefix tokens that two linked sets of this size share at least."""
    return 1 + n // 10


def spare_needed(n):
    """Prefix tokens that a set shares with any linked one, whose size is at least ceil(0.8 n): a column."""
    return 1 + F.floor(F.ceil(n * NUMERATOR / DENOMINATOR) / 10)


def _key(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def is_hot(tokens: np.ndarray, bitmap: np.ndarray | None) -> np.ndarray:
    if bitmap is None:
        return np.zeros(len(tokens), bool)
    at = tokens & np.uint64(8 * len(bitmap) - 1)
    return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def prefix(tokens: np.ndarray, bitmap: np.ndarray | None = None) -> np.ndarray:
    """The first tokens in the order (hot, hash)."""
    n = len(tokens) - least_common(len(tokens)) + spare(len(tokens)) if len(tokens) else 0
    hot = is_hot(tokens, bitmap)
    return np.concatenate([tokens[~hot][:n], tokens[hot][: max(0, n - int((~hot).sum()))]]) if hot.any() else tokens[:n]


def _longs(arrays: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(arrays).view(np.int64) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(a) for a in arrays])], pa.int32()), pa.array(flat, pa.int64()))


def _first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches, "text"):
        sets = [shingles(t) for t in batch.column("text").to_pylist()]
        yield pa.record_batch({"doc_id": batch.column("doc_id"), "n": pa.array([len(s) for s in sets], pa.int64()), "key": pa.array([_key(s) for s in sets], pa.binary()), "prefix": _longs([prefix(s) for s in sets])})


def _again(batches: Iterator[pa.RecordBatch], bitmap: np.ndarray) -> Iterator[pa.RecordBatch]:
    """New prefixes of the sets whose first prefix has hot tokens."""
    for batch in by_bytes(batches, "text"):
        sets = [s for s in (shingles(t) for t in batch.column("text").to_pylist()) if is_hot(prefix(s), bitmap).any()]
        yield pa.record_batch({"key": pa.array([_key(s) for s in sets], pa.binary()), "prefix": _longs([prefix(s, bitmap) for s in sets])})


def _sets(batches: Iterator[pa.RecordBatch], wanted: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sets of classes that may be compared; the bitmap of their digests spares the others' shuffle."""
    mask = 8 * len(wanted) - 1
    for batch in by_bytes(batches, "text"):
        rows = []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            s = shingles(text)
            key = _key(s)
            at = int.from_bytes(key[:4], "little") & mask
            if len(s) and wanted[at >> 3] >> (at & 7) & 1:
                rows.append((doc_id, key, s.tobytes()))
        yield pa.record_batch({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "key": pa.array([r[1] for r in rows], pa.binary()), "tokens": pa.array([r[2] for r in rows], pa.binary())})


def bitmap_of(values: DataFrame) -> np.ndarray:
    """A bitmap of the low bits of a written table's long column `at`, 16 to 32 bits a row within BITS.

    At most a word for each row, or for 32 bits, comes to the driver.
    """
    bits = min(max(1 << (16 * max(1, values.count()) - 1).bit_length(), BITS[0]), BITS[1])
    at = values.select(F.col("at").bitwiseAND(bits - 1).alias("at"))
    words = at.groupBy(F.shiftright("at", 5).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 32 as int))")).alias("m")).toPandas()
    out = np.zeros(bits // 32, np.uint32)
    out[words["w"].to_numpy(np.int64)] = words["m"].to_numpy(np.int64).astype(np.uint32)
    return out.view(np.uint8)


def _common(left: list[np.ndarray], right: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of all intersections: products of 0/1 matrices over the tokens that both sides have."""
    tokens = np.intersect1d(np.unique(np.concatenate(left)), np.unique(np.concatenate(right)), assume_unique=True)
    total = np.zeros((len(left), len(right)), np.float32)

    def places(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        flat = np.concatenate(sets)
        at = np.minimum(np.searchsorted(tokens, flat), max(0, len(tokens) - 1))
        seen = tokens[at] == flat if len(tokens) else np.zeros(len(flat), bool)
        return np.repeat(np.arange(len(sets)), [len(s) for s in sets])[seen], at[seen]

    (lr, lt), (rr, rt) = places(left), places(right)
    for lo in range(0, len(tokens), width):
        blocks = []
        for rows, at, n in ((lr, lt, len(left)), (rr, rt, len(right))):
            here = (at >= lo) & (at < lo + width)
            m = np.zeros((n, min(width, len(tokens) - lo)), np.float32)
            m[rows[here], at[here] - lo] = 1
            blocks.append(m)
        total += blocks[0] @ blocks[1].T
    return total


def _overlaps(union: np.ndarray, asks: list[np.ndarray]) -> np.ndarray:
    """Which of the sets have as many tokens in the union as any linked set has in common with them."""
    flat, sizes = np.concatenate(asks), np.array([len(s) for s in asks])
    inside = union[np.minimum(np.searchsorted(union, flat), len(union) - 1)] == flat
    overlap = np.add.reduceat(inside, np.r_[0, np.cumsum(sizes)[:-1]], dtype=np.int64)
    return overlap >= [least_common(n) for n in sizes]


def _tokens(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(b, np.uint64) for b in column.to_pylist()]


def _union(members: pa.Table) -> pa.Table:
    """A block's union, with its group and number."""
    union = np.unique(np.concatenate(_tokens(members["tokens"])))
    return pa.table({"g": members["g"].slice(0, 1), "y": members["y"].slice(0, 1), "tokens": pa.array([union.tobytes()], pa.binary())})


def _bound(blocks: pa.Table, asked: pa.Table) -> pa.Table:
    """The candidates of a cell that the block's union lets in."""
    if not blocks.num_rows or not asked.num_rows:
        asked = asked.slice(0, 0)
    else:
        asked = asked.filter(pa.array(_overlaps(_tokens(blocks["tokens"])[0], _tokens(asked["asked_tokens"]))))
    return asked.select(["asked_g", "asked_x", "asked_y", "asked_rep"]).rename_columns(["g", "x", "y", "rep"])


def _open(members: pa.Table, asked: pa.Table) -> pa.Table:
    """Links that connect what is connected between the members of one block and its candidates."""
    found: list[tuple[int, int]] = []
    sets, asks = _tokens(members["tokens"]), _tokens(asked["asked_tokens"])
    mine, ids = members["rep"].to_numpy(), asked["asked_rep"].to_numpy()
    if sets and asks:
        sizes = np.array([len(s) for s in asks])
        common = _common(asks, sets)
        united = sizes[:, None] + np.array([len(s) for s in sets])[None, :] - common
        near = (DENOMINATOR * common >= NUMERATOR * united) & (ids[:, None] != mine[None, :])
        rest_m, rest_a = near.any(axis=0), near.any(axis=1)
        for start in range(len(asks)):
            if not rest_a[start]:
                continue
            rest_a[start] = False
            todo = [(True, start)]
            while todo:
                is_asked, k = todo.pop()
                rest = rest_m if is_asked else rest_a
                new = np.flatnonzero((near[k] if is_asked else near[:, k]) & rest)
                rest[new] = False
                found += [(k, n) if is_asked else (n, k) for n in new.tolist()]
                todo += [(not is_asked, n) for n in new.tolist()]
    return pa.table({"a": pa.array([int(ids[f[0]]) for f in found], pa.int64()), "b": pa.array([int(mine[f[1]]) for f in found], pa.int64())})


def open_groups(pairs: DataFrame, members: DataFrame, sets: DataFrame, block: int = 512, unions: bool = True) -> DataFrame:
    """Links (a, b) between candidates and a group's members: pairs (rep, g), members (rep, g), sets (rep, tokens).

    unions: store the blocks' unions and read members only where a candidate passes them.
    """
    size = lambda df, name: df.groupBy("g").agg(F.ceil(F.count("*") / block).cast("int").alias(name))
    cells = materialise(size(pairs, "n_asked").join(size(members, "n_blocks"), "g"), "jac-cells")
    deal = lambda n, seed: F.pmod(F.xxhash64("rep", F.lit(seed)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    key = ("g", "x", "y")
    placed = members.join(cells, "g").withColumn("y", deal("n_blocks", 2))
    asked = pairs.join(cells, "g").withColumn("x", deal("n_asked", 1)).withColumn("y", every("n_blocks")).select(*key, "rep")
    named = lambda df: df.select(*[F.col(c).alias(f"asked_{c}") for c in df.columns])
    meet = lambda left, right, f, out: left.groupBy(*key).cogroup(named(right.join(sets, "rep")).groupBy(*[f"asked_{c}" for c in key])).applyInArrow(f, out)
    if unions:
        placed = materialise(placed, "jac-placed")
        blocks = materialise(placed.select("g", "y", "rep").join(sets, "rep").groupBy("g", "y").applyInArrow(_union, "g long, y int, tokens binary"), "jac-unions")
        facing = blocks.join(placed.select("g", "n_asked").distinct(), "g").withColumn("x", every("n_asked")).select(*key, "tokens")
        asked = materialise(meet(facing, asked, _bound, "g long, x int, y int, rep long"), "jac-open")
        inside = placed.select("g", "y", "rep").join(asked.select(*key).distinct(), ["g", "y"])
    else:
        inside = placed.withColumn("x", every("n_asked"))
    return meet(inside.select(*key, "rep").join(sets, "rep"), asked, _open, "a long, b long")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for each row."""
    bound_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    wide = materialise(docs.mapInArrow(_first, "doc_id long, n long, key binary, prefix array<long>"), "jac-wide")
    first = materialise(wide.drop("prefix"), "jac-first")
    nameless = F.lit(NAMELESS) + F.pmod(F.xxhash64("key"), F.lit(1 << 61))
    classes = wide.filter("n > 0").groupBy("key").agg(F.min("doc_id").alias("d"), F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    classes = materialise(classes.select("key", F.coalesce("d", nameless).alias("rep"), "n", "prefix"), "jac-classes")
    release(wide)

    hot = materialise(classes.select(F.explode("prefix").alias("at")).groupBy("at").count().filter(F.col("count") > HOT).select("at"), "jac-hot")
    bitmap = bitmap_of(hot)
    if bitmap.any():
        new = docs.mapInArrow(lambda it: _again(it, bitmap), "key binary, prefix array<long>").groupBy("key").agg(F.first("prefix").alias("new"))
        first_classes = classes
        classes = materialise(classes.join(new, "key", "left").select("key", "rep", "n", F.coalesce("new", "prefix").alias("prefix")), "jac-ordered")
        release(first_classes)
    post = classes.select("rep", "n", F.explode("prefix").alias("t"))
    shared = materialise(post.groupBy("t").agg(F.count("*").alias("c")).filter("c > 1").drop("c"), "jac-tokens")
    post = materialise(post.join(shared, "t"), "jac-shared")
    named = materialise(classes.select("key", "rep"), "jac-named")
    release(classes, shared)
    able = post.groupBy("rep").agg(F.count("*").alias("c"), F.min("n").alias("n")).filter(F.col("c") >= spare_needed(F.col("n"))).select("rep")
    able = materialise(able, "jac-able")
    lead = post.join(able, "rep").groupBy("t").agg(F.min_by(F.struct("rep", "n"), "rep").alias("l"), F.count("*").alias("c")).filter("c > 1")
    lead = materialise(lead.select("t", F.col("l.rep").alias("lead"), F.col("l.n").alias("lead_n")), "jac-lead")
    posted = materialise(post.join(able, "rep").join(lead, "t"), "jac-postings")
    release(post, lead)

    little = F.concat(*[F.substring(F.hex("key"), k, 2) for k in (7, 5, 3, 1)])
    needed = named.join(able, "rep")
    needed = materialise(needed.withColumn("at", F.conv(little, 16, 10).cast("long")), "jac-needed")
    wanted = bitmap_of(needed.select("at"))
    own = docs.mapInArrow(lambda it: _sets(it, wanted), "doc_id long, key binary, tokens binary")
    # A class's set is taken from the row of its id, so that copies under other ids don't meet in one task.
    own = own.groupBy("key", F.coalesce("doc_id", nameless).alias("rep")).agg(F.first("tokens").alias("tokens"))
    sets = materialise(own.join(needed.select("key", "rep"), ["key", "rep"]).select("rep", "tokens"), "jac-sets")

    near = lambda a, b: NUMERATOR * F.greatest(a, b) <= DENOMINATOR * F.least(a, b)
    pairs = posted.filter((F.col("rep") != F.col("lead")) & near("n", "lead_n")).groupBy("rep", F.col("lead").alias("g")).agg(F.count("*").alias("c"), F.min("n").alias("n"))
    best = Window.partitionBy("rep").orderBy(F.desc("c"), "g")
    pairs = pairs.filter(F.col("c") >= spare_needed(F.col("n"))).withColumn("r", F.row_number().over(best)).filter("r = 1")
    pairs = materialise(pairs.select("rep", "g"), "jac-pairs")
    families = materialise(components(pairs.select(F.col("rep").alias("a"), F.col("g").alias("b"))).select(F.col("node").alias("rep"), F.col("comp").alias("g")), "jac-families")
    links = materialise(open_groups(pairs, pairs.select(F.col("g").alias("rep"), "g").distinct(), sets, unions=False), "jac-links")

    linked = families.join(components(links).withColumnRenamed("node", "rep"), "rep", "left").select("rep", "g", F.coalesce("comp", "rep").alias("comp"))
    counts = linked.groupBy("g", "comp").agg(F.count("*").alias("n")).groupBy("g").agg(F.max(F.struct("n", "comp")).alias("m"), F.count("*").alias("parts"))
    counts = materialise(counts.filter("parts > 1").select("g", F.col("m.comp").alias("main")), "jac-parts")
    strays = linked.join(counts, "g").filter("comp <> main").select("rep", "g")

    post = posted.select("rep", "n", "t").join(families, "rep", "left").select("t", "rep", "n", F.coalesce("g", "rep").alias("g"))
    mixed = materialise(post.groupBy("t").agg(F.min("g").alias("low"), F.max("g").alias("high")).filter("low < high").select("t"), "jac-between")
    sizes = materialise(families.groupBy("g").agg(F.count("*").alias("members")), "jac-sizes")
    post = materialise(post.join(mixed, "t").join(sizes, "g", "left").withColumn("members", F.coalesce("members", F.lit(1))), "jac-mixed")
    release(posted, mixed)
    need = spare_needed(F.col("n"))
    held = post.groupBy("rep").agg(F.count("*").alias("m"), F.min(need).alias("need")).filter("m >= need")
    held = materialise(post.join(held, "rep"), "jac-held")
    release(post)
    matrix = materialise(held.groupBy("t", "g", "members").agg(F.min("n").alias("low_n"), F.max("n").alias("high_n")), "jac-matrix")
    spread = materialise(matrix.groupBy("t").agg(F.count("*").alias("groups")), "jac-spread")
    rarest = F.row_number().over(Window.partitionBy("rep").orderBy("groups", "t"))
    mine = held.join(spread, "t").withColumn("r", rarest).filter(F.col("r") <= F.col("m") - F.col("need") + 1)
    mine = mine.select("t", "rep", "n", F.col("g").alias("own"), F.col("members").alias("own_members"))
    alike = (NUMERATOR * F.col("n") <= DENOMINATOR * F.col("high_n")) & (NUMERATOR * F.col("low_n") <= DENOMINATOR * F.col("n"))
    asked = mine.join(matrix, "t").filter((F.struct("own_members", "own") < F.struct("members", "g")) & alike).select("rep", "g").distinct()
    asked = materialise(asked.union(strays), "jac-asked")
    wide = asked.select("g").distinct().join(families, "g", "left").select("g", F.coalesce("rep", "g").alias("rep"))
    more = materialise(open_groups(asked, wide, sets), "jac-more")
    release(sets, held, matrix, spread)
    final = components(links.union(more))
    by_key = named.join(final.withColumnRenamed("node", "rep"), "rep", "left").select("key", F.coalesce("comp", "rep").alias("comp"))
    out = first.join(by_key, "key", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("comp") < NAMELESS, F.col("comp")).when(F.col("comp").isNull(), F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs of which one of each group stays (the smallest id), with all their columns.

    Documents without tokens all stay. Rows without an id can't be told apart by a group's name: they
    stay, but for repeated texts.
    """
    found = jaccard_components(docs)
    dropped = materialise(found.filter("doc_id is not null and component_id <> doc_id").select(F.col("doc_id").alias("__dropped")).distinct(), "jac-dropped")
    rows = docs.join(dropped, F.col("doc_id") == F.col("__dropped"), "left_anti")
    again = materialise(docs.groupBy(F.col("doc_id").alias("__again")).count().filter("count > 1").select("__again"), "jac-again")
    once = rows.join(again, F.col("doc_id").eqNullSafe(F.col("__again")), "left_anti")
    many = rows.join(again, F.col("doc_id").eqNullSafe(F.col("__again")), "left_semi")
    empty = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x09-\x0D]", " ")) == ""
    seen = F.row_number().over(Window.partitionBy("doc_id", F.xxhash64("text")).orderBy("source"))
    return once.unionByName(many.withColumn("__seen", seen).filter(empty | (F.col("__seen") == 1)).drop("__seen"))


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT row, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM w),
p AS (SELECT row, len(g) AS n, unnest(g) AS t FROM s),
c AS (SELECT a.row AS a, b.row AS b, any_value(a.n) + any_value(b.n) AS n, count(*) AS c FROM p a JOIN p b ON a.t = b.t AND a.row < b.row GROUP BY a.row, b.row),
l AS (SELECT x.doc_id AS a, y.doc_id AS b FROM c JOIN s x ON x.row = c.a JOIN s y ON y.row = c.b WHERE 100 * c >= 80 * (n - c)),
e AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(doc_id, reached) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.reached = e.a),
m AS (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id)
SELECT s.doc_id, len(g)::BIGINT AS n_shingles, component_id FROM s JOIN m ON s.doc_id = m.doc_id
"""
