"""Exact top-k inner products: ball-tree branch and bound per shard.

Components become integers floor(256 * x). Vectors are dealt to the nearest of some pivots (a bounded
sample of the vectors: one for every `per_pivot`, `pivots` at most) and there to shards by a hash of
their id; a pivot with the radius of its vectors is a ball. Each query first searches one shard of
the pivot with which its product is greatest. The kth score found there is shared: no query's final
kth score can be lower, so the query is sent only to shards of balls whose bound
q . centre + |q| * radius reaches it. Vectors are never copied; copies of queries are what bounds leave.

A task sorts its shards so that a shard's vectors come before its queries: it holds one shard, its
tree, and one batch of queries. The tree halves vectors by projection on the line between two far
points; nodes are visited in order of the same bound, and a node is opened only for queries whose
kth score it can reach.

Equal scores go to the smaller id, so nodes that can only tie are opened. Of equal vectors in a
shard only the k + 1 smallest distinct ids can be results, and k rows of each (a query's own id
gives none); the others are left out, repeated rows by a grouped count before any are dealt. Null
vectors, and those with null or non-finite components, take no part, nor do null ids. A shorter
vector counts as padded with zeros. Repeated rows of one id count as candidates each, but never
for their own query id. Scores are exact to 64 bits: where doubles would not be, integers are
multiplied; a score beyond 64 bits raises an error. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from millrace.llm.common import bound_batches, materialise, table

LEAF = 64
PLAIN = 2.0**20  # components under this give exact double products up to WIDE of them
WIDE = 1 << 13
NONE = np.iinfo(np.int64).min


class BallTree:
    def __init__(self, x: np.ndarray, ids: np.ndarray, k: int):
        """x: integer-valued float64 rows. Of equal rows keeps the k + 1 smallest distinct ids, k rows of each at most."""
        order = np.argsort(ids, kind="stable")
        x, ids = x[order], ids[order]
        _, inverse = np.unique(x, axis=0, return_inverse=True)
        inverse = inverse.ravel()
        by = np.argsort(inverse, kind="stable")
        if len(by):
            new_vec = np.r_[True, np.diff(inverse[by]) > 0]
            new_id = new_vec | np.r_[True, ids[by][1:] != ids[by][:-1]]
            since = lambda new, at: at - np.repeat(at[new], np.diff(np.r_[np.flatnonzero(new), len(by)]))
            nth_id, nth_row = since(new_vec, np.cumsum(new_id)), since(new_id, np.arange(len(by)))
            by = by[(nth_id <= k) & (nth_row < k)]
        keep = np.sort(by)
        self.x, self.ids = x[keep], ids[keep]
        self.nodes: list[tuple] = []  # (centre, radius, left, right, rows)
        if len(self.x):
            self.root = self._build(np.arange(len(self.x)))

    def _build(self, rows: np.ndarray) -> int:
        x = self.x[rows]
        centre = x.mean(axis=0)
        apart = np.sqrt(((x - centre) ** 2).sum(axis=1))
        me = len(self.nodes)
        self.nodes.append(())
        left = right = -1
        if len(rows) > LEAF and apart.max() > 0:
            far = x[apart.argmax()]
            other = x[((x - far) ** 2).sum(axis=1).argmax()]
            order = np.argsort(x @ (far - other), kind="stable")
            half = len(rows) // 2
            left, right = self._build(rows[order[:half]]), self._build(rows[order[half:]])
        self.nodes[me] = (centre, float(apart.max()) * (1 + 1e-9) + 1e-9 * float(np.abs(centre).sum()) + 1e-6, left, right, rows if left < 0 else None)
        return me

    def search(self, q: np.ndarray, own: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids, (queries, k), best first; -inf where there are fewer. floor: kth scores to start from."""
        n = len(q)
        best, names = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)
        if not len(self.x) or not n:
            return best, names
        norm = np.sqrt((q**2).sum(axis=1))

        def visit(me: int, who: np.ndarray) -> None:
            _, _, left, right, rows = self.nodes[me]
            if rows is not None:
                score = q[who] @ self.x[rows].T
                ids = np.broadcast_to(self.ids[rows], score.shape)
                score = np.where(ids == own[who, None], -np.inf, score)
                score, ids = np.concatenate([best[who], score], axis=1), np.concatenate([names[who], ids], axis=1)
                order = np.lexsort((ids, -score), axis=1)[:, :k]
                best[who], names[who] = np.take_along_axis(score, order, 1), np.take_along_axis(ids, order, 1)
                return
            on_left, on_right = (q[who] @ self.nodes[c][0] + norm[who] * self.nodes[c][1] for c in (left, right))
            nearer = on_left >= on_right  # each query goes to its better child first
            for child, bound, mine in ((left, on_left, nearer), (right, on_right, ~nearer), (right, on_right, nearer), (left, on_left, ~nearer)):
                at = who[mine]
                at = at[bound[mine] >= np.maximum(best[at, k - 1], floor[at])]
                if len(at):
                    visit(child, at)

        visit(self.root, np.arange(n))
        return best, names


def _matrix(lists: pa.Array) -> np.ndarray:
    """Rows floor(256 * x) of a list column, padded with zeros."""
    flat, sizes = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    if flat.size:
        flat = np.floor(256 * flat)
        if np.abs(flat).max() >= 2.0**63:
            raise OverflowError("a component is beyond 64 bits")
        out[np.repeat(np.arange(len(sizes)), sizes), np.arange(flat.size) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _fit(x: np.ndarray, width: int) -> np.ndarray:
    return x[:, :width] if x.shape[1] >= width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, ~score), axis=1)[:, :k]
    return np.take_along_axis(score, order, 1), np.take_along_axis(ids, order, 1)


class Shard:
    """A ball tree over the plain vectors of a shard; those with large components are multiplied as integers."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, k: int):
        plain = np.abs(x).max(axis=1, initial=0) < PLAIN
        if x.shape[1] > WIDE:
            plain[:] = False
        self.width, self.k = x.shape[1], k
        self.tree = BallTree(x[plain], ids[plain], k)
        self.large, self.large_ids = x[~plain], ids[~plain]

    def _whole(self, q: np.ndarray, own: np.ndarray, x: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact scores of all pairs, a few queries at a time."""
        got = []
        for lo in range(0, len(q), 64):
            part, mine = q[lo : lo + 64], own[lo : lo + 64]
            if (np.abs(part @ x.T) >= 2.0**63).any():
                raise OverflowError("a score is beyond 64 bits")
            score = part.astype(np.int64) @ x.astype(np.int64).T
            names = np.broadcast_to(ids, score.shape)
            got.append(_best(np.where(names == mine[:, None], NONE, score), names, self.k))
        return tuple(np.concatenate(c) for c in zip(*got, strict=True)) if got else (np.zeros((0, 0), np.int64),) * 2

    def search(self, q: np.ndarray, own: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores (NONE where there are fewer) and ids, best first."""
        q = _fit(q, self.width)
        plain = (np.abs(q).max(axis=1, initial=0) < PLAIN) & (self.width <= WIDE)
        score, ids = np.full((len(q), self.k), NONE), np.full((len(q), self.k), np.iinfo(np.int64).max)
        at = np.flatnonzero(plain)
        if len(at) and len(self.tree.ids):
            found, names = self.tree.search(q[at], own[at], np.nextafter(floor[at].astype(np.float64), -np.inf), self.k)
            real = np.isfinite(found)
            score[at], ids[at] = np.where(real, np.where(real, found, 0).astype(np.int64), NONE), names
        for at, x, names in ((np.arange(len(q)), self.large, self.large_ids), (np.flatnonzero(~plain), self.tree.x, self.tree.ids)):
            if len(at) and len(x):
                more, who = self._whole(q[at], own[at], x, names)
                score[at], ids[at] = _best(np.concatenate([score[at], more], axis=1), np.concatenate([ids[at], who], axis=1), self.k)
        return score, ids


def _distances(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Upper bounds of the distances to each pivot, and the products with them."""
    product = _fit(x, pivots.shape[1]) @ pivots.T
    both = (x**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1)[None, :]
    return np.sqrt(np.maximum(both - 2 * product, 0) + 1e-12 * both) + 1e-6, product


def _assign(batches: Iterator[pa.RecordBatch], pivots: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Adds the nearest pivot and the distance to it."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 2048):
            part = batch.slice(lo, 2048)
            apart, _ = _distances(_matrix(part.column("e")), pivots)
            near = apart.argmin(axis=1)
            yield pa.record_batch({**{c: part.column(c) for c in part.schema.names}, "p": pa.array(near, pa.int32()), "d": pa.array(apart[np.arange(len(near)), near])})


def _route(batches: Iterator[pa.RecordBatch], pivots: np.ndarray, radius: np.ndarray, seed: bool) -> Iterator[pa.RecordBatch]:
    """Adds `ps`: the pivot of the greatest product, or all whose ball can reach the floor."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 2048):
            part = batch.slice(lo, 2048)
            q = _matrix(part.column("e"))
            product = _fit(q, pivots.shape[1]) @ pivots.T
            if seed:
                ps = [[int(p)] for p in np.where(radius >= 0, product, -np.inf).argmax(axis=1)]
            else:
                norm = np.sqrt((q**2).sum(axis=1))[:, None]
                bound = product + norm * (radius + 1e-9 * np.sqrt((pivots**2).sum(axis=1)) + 1e-6)
                ps = [np.flatnonzero(r).tolist() for r in (bound >= part.column("floor").to_numpy().astype(np.float64)[:, None]) & (radius >= 0)]
            yield pa.record_batch({**{c: part.column(c) for c in part.schema.names}, "ps": pa.array(ps, pa.list_(pa.int32()))})


def _search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows in order of shard and kind: the vectors of a shard (0), then its queries (1)."""
    now, parts, names, shard = None, [], [], None
    for batch in batches:
        s, kind = batch.column("s").to_numpy(), batch.column("kind").to_numpy()
        edges = np.flatnonzero((np.diff(s) != 0) | (np.diff(kind) != 0)) + 1
        for lo, hi in zip([0, *edges], [*edges, len(s)], strict=True):
            if lo == hi:
                continue
            if s[lo] != now:
                now, parts, names, shard = s[lo], [], [], None
            x, ids = _matrix(batch.column("e").slice(lo, hi - lo)), batch.column("vec_id").to_numpy()[lo:hi]
            if kind[lo] == 0:
                parts.append(x)
                names.append(ids)
            elif parts:
                if shard is None:
                    width = max(p.shape[1] for p in parts)
                    shard, parts = Shard(np.concatenate([_fit(p, width) for p in parts]), np.concatenate(names), k), [np.zeros((0, 0))]
                floor, rows = (batch.column(c).slice(lo, hi - lo).to_numpy() for c in ("floor", "row"))
                score, who = shard.search(x, ids, floor)
                at = np.nonzero((score != NONE) & (score >= floor[:, None]))
                yield pa.record_batch({"row": rows[at[0]], "query_id": ids[at[0]], "vec_id": who[at], "score": score[at]})


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int = 5, shard: int = 1024, most: int = 65_536, pivots: int = 256, per_pivot: int = 2048) -> DataFrame:
    """The k best of `vectors` (vec_id, embedding) for each row of `queries` (same columns), but for its own id.

    shard, most: least and most rows of a shard; between them, as many as give each core two shards.
    Returns query_id, rank, vec_id, score.
    """

    def clean(df: DataFrame) -> DataFrame:
        fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
        return df.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("e"))

    spark = vectors.sparkSession
    bound_batches(spark)
    raw = clean(vectors)
    kind = dict(raw.dtypes)["e"]
    n = raw.count()
    wanted = max(1, min(pivots, n // per_pivot))
    order = F.xxhash64("vec_id", F.lit(7))
    # The pivots only decide how well bounds prune, so of an id with very many rows any few will do.
    sample = raw.filter(order / float(2**64) + 0.5 < (wanted + 8) / max(1, n)).select("e", order.alias("o")).limit(4 * (wanted + 8)).collect() or raw.select("e", order.alias("o")).limit(1).collect()
    centres = _matrix(pa.array([r["e"] for r in sorted(sample, key=lambda r: r["o"])[:wanted]], pa.list_(pa.float64())))
    once = raw.groupBy("vec_id", "e").agg(F.count("*").alias("n")).select("vec_id", "e", F.explode(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int"))).alias("copy")).drop("copy")
    v = materialise(once.mapInArrow(lambda it: _assign(it, centres), f"vec_id long, e {kind}, p int, d double") if n else once.withColumn("p", F.lit(0)).withColumn("d", F.lit(0.0)), "topk-vectors")
    rows = max(shard, min(most, -(-n // (2 * spark.sparkContext.defaultParallelism))))
    radius, subs = np.full(max(1, len(centres)), -1.0), np.zeros(max(1, len(centres)), np.int64)
    for r in v.groupBy("p").agg(F.max("d").alias("d"), F.count("*").alias("n")).collect():
        radius[r["p"]], subs[r["p"]] = r["d"], -(-r["n"] // rows)
    first = np.cumsum(subs) - subs
    numbers = lambda x: F.array(*[F.lit(int(i)) for i in x])  # noqa: E731  one for each pivot
    of = lambda x, p: F.element_at(numbers(x), p + 1)
    deal = lambda p, *c: (of(first, p) + F.pmod(F.xxhash64(*c), of(subs, p))).cast("int")
    nothing = F.lit(None).cast("long")
    v = v.select(deal(F.col("p"), "vec_id").alias("s"), F.lit(0).alias("kind"), "vec_id", "e", nothing.alias("row"), nothing.alias("floor"))
    q = materialise(clean(queries).withColumn("row", F.monotonically_increasing_id()), "topk-queries").withColumn("floor", F.lit(-(2**63) + 1).cast("long"))

    def routed(q: DataFrame, seed: bool) -> DataFrame:
        got = q.mapInArrow(lambda it: _route(it, centres, radius, seed), f"vec_id long, e {kind}, row long, floor long, ps array<int>") if n else q.withColumn("ps", F.array().cast("array<int>"))
        return got.withColumn("p", F.explode("ps"))

    def search(q: DataFrame) -> DataFrame:
        both = v.unionByName(q.select("s", F.lit(1).alias("kind"), "vec_id", "e", "row", "floor"))
        return both.repartition("s").sortWithinPartitions("s", "kind").mapInArrow(lambda it: _search(it, k), "row long, query_id long, vec_id long, score long")

    seeds = materialise(search(routed(q, True).withColumn("s", deal(F.col("p"), "row"))), "topk-seeds")
    floors = seeds.groupBy("row").agg(F.min("score").alias("kth"), F.count("*").alias("n")).filter(F.col("n") == k).select("row", "kth")
    q = q.join(floors, "row", "left").select("vec_id", "e", "row", F.coalesce("kth", "floor").alias("floor"))
    seeded = routed(q.select("vec_id", "e", "row", "floor"), False)
    seeded = seeded.withColumn("s", F.explode(F.sequence(of(first, F.col("p")).cast("int"), (of(first, F.col("p")) + of(subs, F.col("p")) - 1).cast("int"))))
    got = search(seeded)  # the shard that gave the floor as well: its results hold whatever the floor is
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    return got.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return exact_topk(v, v.filter("vec_id % 50 = 0"))


OP9_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
