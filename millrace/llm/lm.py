"""LM scoring: a log-bilinear neural model trained by noise-contrastive estimation in numpy.

Tokens are words (A-Z lower-cased) and one end per document. The model predicts a token's class
from the class before it (the start of a document has the end's class): the logit of class w after
h is r_h . C . q_w + b_w. The `own` most frequent tokens are classes of their own; every other
token, seen or not, belongs to a class given by its last letters and closing punctuation. Within a
class a token has the probability (c + 0.1) / (N_class + 0.1 (V_class + 1)), one share being left
for all unseen tokens, so that a text's score is a sum of normalised log probabilities.

Statistics come from all training documents: token counts (grouped, written to the shared
folder), and sparse counts of class pairs, written there too, which are all that training needs.
Both grow with the corpus: there are about `scale` * V^(1/3) own classes for V distinct tokens, so
that the matrix of pairs (V^(2/3)) grows slower than the table of tokens and stays a driver's work.
NCE compares each observed pair with `noise` draws from the unigram law; over pair counts the
expected objective and gradient are exact matrix products, made in blocks of contexts. One more
such product gives the logarithm of the sum over all classes after each context; scores are then
batched products of the two sides' vectors, of a size set by classes and `dim`, not their square.

Counts of the most frequent tokens go to the workers: `local` at most, cut by a histogram of the
counts, so that the driver gets no others. Occurrences of rarer ones are joined with the table of
counts, each of these keys being rare by construction.

Null text is empty: it has one token, its end. Repeated rows and null ids (crc32 of the empty text)
are scored row by row. Without training documents all counts are 0, and both scores follow
their formulas. An empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import bound_batches, by_bytes, id_residue, materialise, table

END = b"\n"  # no word holds white space
ENDINGS = 40  # classes of rare tokens: by ending, for each of three closings
MEMO = 200_000
BLOCK = 256  # contexts whose rows are held densely at once
CELLS = 4_000_000  # cells of the pair matrix whose counts are sent to the driver at once
_MODELS: dict = {}


def words_of(text: str | None) -> list[bytes]:
    """bytes.lower() and bytes.split() know only ASCII: exactly A-Z and the six white-space characters."""
    return (text or "").encode("utf-8", "replace").lower().split()


def word_runs(text: str | None, most: int = 1 << 20) -> Iterator[list[bytes]]:
    """The same words in runs of about `most` bytes."""
    raw, at = (text or "").encode("utf-8", "replace").lower(), 0
    while at < len(raw):
        end = raw.find(b" ", at + most)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


def rare_class(token: bytes) -> int:
    closing = 2 if token[-1:] in (b".", b"!", b"?") else 1 if token[-1:] in (b",", b";", b":") else 0
    tail = token.rstrip(b".,;:!?")[-2:]
    return (sum(b * 31**i for i, b in enumerate(tail)) % ENDINGS) * 3 + closing


class Classes(dict):
    """Token to class: own classes first, then those of rare tokens; remembers MEMO rare ones."""

    def __init__(self, own: dict[bytes, int]):
        super().__init__(own)
        self.base = len(own)

    def __missing__(self, token: bytes) -> int:
        c = self.base + rare_class(token)
        if len(self) < MEMO:
            self[token] = c
        return c


def _token_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def out() -> pa.RecordBatch:
        batch = pa.record_batch({"token": pa.array(list(counts.keys()), pa.binary()), "c": pa.array(list(counts.values()), pa.int64())})
        counts.clear()
        return batch

    for batch in by_bytes(batches, "text"):
        for text in batch.column("text").to_pylist():
            for words in word_runs(text):
                counts.update(words)
                if len(counts) > 400_000:
                    yield out()
            counts[END] += 1
    if counts:
        yield out()


def _class_ids(text: str | None, classes: Classes) -> np.ndarray:
    """Classes of a text's tokens, its end included."""
    parts = [np.fromiter(map(classes.__getitem__, words), np.int64, len(words)) for words in word_runs(text)]
    return np.concatenate([*parts, np.array([classes[END]], np.int64)])


def _pair_counts(batches: Iterator[pa.RecordBatch], own: dict[bytes, int], size: int) -> Iterator[pa.RecordBatch]:
    classes = Classes(own)
    end = classes[END]
    pair, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
    out = lambda: pa.record_batch({"pair": pa.array(pair, pa.int64()), "n": pa.array(n, pa.int64())})
    for batch in by_bytes(batches, "text"):
        run = np.concatenate([np.array([end], np.int64), *(_class_ids(t, classes) for t in batch.column("text").to_pylist())])
        more, times = np.unique(run[:-1] * size + run[1:], return_counts=True)
        pair, place = np.unique(np.concatenate([pair, more]), return_inverse=True)
        n = np.bincount(place, weights=np.concatenate([n, times])).astype(np.int64)
        if len(pair) > 1_000_000:
            yield out()
            pair, n = pair[:0], n[:0]
    yield out()


def _blocks(size: int) -> Iterator[slice]:
    return (slice(lo, min(lo + BLOCK, size)) for lo in range(0, size, BLOCK))


def train(pairs: np.ndarray, dim: int = 24, noise: int = 25, steps: int = 120, rate: float = 0.05, ridge: float = 10.0, seed: int = 1) -> dict[str, np.ndarray]:
    """NCE on a matrix of counts [before, token]. Parameters r, c, q, b.

    ridge: a penalty on r and q that weighs as much as so many observed pairs, whatever their number.
    """
    size, rng = len(pairs), np.random.default_rng(seed)
    whole = max(1.0, float(pairs.sum(dtype=np.float64)))
    n_before, n_token = (pairs.sum(axis=a, dtype=np.float64) for a in (1, 0))
    unigram = ((n_token + 0.5) / (n_token + 0.5).sum()).astype(np.float32)
    p = {"r": rng.normal(0, 0.3, (size, dim)), "c": np.eye(dim), "q": rng.normal(0, 0.3, (size, dim)), "b": np.log(unigram)}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    pull, n_before = np.float32(ridge / whole), (n_before / whole).astype(np.float32)
    for t in range(1, steps + 1):
        rc, offset = p["r"] @ p["c"], p["b"] - np.log(noise * unigram)
        grad = {"q": -pull * p["q"], "b": np.zeros_like(p["b"])}
        g_rc = np.empty_like(rc)
        for at in _blocks(size):
            odds = rc[at] @ p["q"].T
            odds += offset
            np.clip(odds, -30, 30, out=odds)
            np.negative(odds, out=odds)
            np.exp(odds, out=odds)
            odds += 1
            np.reciprocal(odds, out=odds)
            g = pairs[at] / np.float32(whole)
            g -= odds * (g + (noise * n_before[at])[:, None] * unigram)  # share (1 - odds) - contrast odds
            g_rc[at] = g @ p["q"]
            grad["q"] += g.T @ rc[at]
            grad["b"] += g.sum(axis=0)
        grad |= {"c": p["r"].T @ g_rc, "r": g_rc @ p["c"].T - pull * p["r"]}
        pace = rate * min(1.0, 3 * (1 - t / (steps + 1)))
        for k, d in grad.items():
            m[k] = 0.9 * m[k] + 0.1 * d
            v[k] = 0.99 * v[k] + 0.01 * d * d
            p[k] += pace * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-9)
    return p


class Scorer:
    """log10 P(class | class before) as products of vectors, less the normaliser of the class before."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.left, self.right, self.bias = p["r"] @ p["c"], p["q"], p["b"]
        self.norm = np.empty(len(self.bias))
        for at in _blocks(len(self.norm)):
            logit = (self.left[at] @ self.right.T + self.bias).astype(np.float64)
            top = logit.max(axis=1)
            self.norm[at] = top + np.log(np.exp(logit - top[:, None]).sum(axis=1))

    def __call__(self, before: np.ndarray, now: np.ndarray, most: int = 65_536) -> np.ndarray:
        out = np.empty(len(now))
        for lo in range(0, len(now), most):
            h, w = before[lo : lo + most], now[lo : lo + most]
            out[lo : lo + most] = np.einsum("ij,ij->i", self.left[h], self.right[w]) + self.bias[w] - self.norm[h]
        return out / math.log(10)


def _score(batches: Iterator[pa.RecordBatch], model: dict) -> Iterator[pa.RecordBatch]:
    got = _MODELS.get(model["key"])
    if got is None:
        _MODELS.clear()
        size = len(model["params"]["b"])
        in_class = np.zeros(size)  # log10 of the rest of a rare token's probability, but for its count
        in_class[len(model["own"]) :] = -np.log10(model["rare_n"] + 0.1 * (model["rare_v"] + 1))
        own = np.zeros(size)
        own[: len(model["own"])] = [math.log10(c + 0.1) for c in model["own_counts"]]
        known = np.zeros(size, bool)
        known[: len(model["own"])] = [c > 0 for c in model["own_counts"]]
        local = {t: math.log10(c + 0.1) for t, c in model["local"].items()}
        got = _MODELS[model["key"]] = (Scorer(model["params"]), in_class, own, known, local, Classes(model["own"]))
    scorer, in_class, own, known, local, classes = got
    n_own, end = len(model["own"]), classes[END]
    for batch in by_bytes(batches, "text"):
        out: dict = {k: [] for k in ("n_tokens", "n_known", "base", "score", "rare")}
        ids, inside = [], []
        for text in batch.column("text").to_pylist():
            parts, seen, rare = [], [], []
            for words in word_runs(text):
                part = np.fromiter(map(classes.__getitem__, words), np.int64, len(words))
                parts.append(part)
                for k in np.flatnonzero(part >= n_own).tolist():
                    c = local.get(words[k])
                    rare.append(words[k]) if c is None else seen.append(c)
            ids.append(np.concatenate([*parts, [end]]).astype(np.int64))
            inside.append(math.fsum(seen))
            out["n_tokens"].append(len(ids[-1]))
            out["n_known"].append(len(seen))
            out["rare"].append(rare)
        now = np.concatenate(ids)
        starts = np.cumsum([0, *out["n_tokens"][:-1]])
        before = np.roll(now, 1)
        before[0] = end  # all other texts follow an end as well
        sums = lambda x: np.add.reduceat(x, starts)
        inside = np.array(inside)
        yield pa.record_batch(
            {
                **{c: batch.column(c) for c in ("row", "doc_id", "held_out")},
                "n_tokens": pa.array(out["n_tokens"], pa.int64()),
                "n_known": pa.array(np.array(out["n_known"]) + sums(known[now].astype(np.int64)), pa.int64()),
                "base": pa.array(inside + sums(own[now]), pa.float64()),
                "score": pa.array(inside + sums(scorer(before, now) + in_class[now]), pa.float64()),
                "rare": pa.array(out["rare"], pa.list_(pa.binary())),
            }
        )


def score_texts(docs: DataFrame, held_out, own: int | None = None, local: int = 60_000, scale: float = 8.0) -> DataFrame:
    """Trains on the rows of docs (doc_id, text) where held_out is false, and scores all rows.

    own: classes of single tokens, scale * V^(1/3) if not given and at most `local`.
    """
    bound_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out.alias("held_out"))
    training = docs.filter(~F.col("held_out")).select("text")
    counts = materialise(training.mapInArrow(_token_counts, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c")), "lm-counts")
    level = F.floor(F.log2("c") * 8)  # a histogram of some hundred rows, whatever the corpus
    levels = sorted(((r["level"], r["v"], int(r["n"])) for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("v"), F.sum("c").alias("n")).collect()), reverse=True)
    n, v = sum(x[2] for x in levels), sum(x[1] for x in levels)
    kept, floor = 0, None
    for at, kinds, _ in levels:
        kept += kinds
        if kept > local:
            break
        floor = at
    top = [] if floor is None else sorted((-int(r["c"]), bytes(r["token"])) for r in counts.filter(level >= floor).collect())
    own = min(local, math.ceil(scale * v ** (1 / 3))) if own is None else own
    own_counts = {t: -c for c, t in top[:own]}
    if END not in own_counts:  # long texts: other tokens are more frequent than the end, whose count is one a text
        own_counts[END] = int(counts.filter(F.col("token") == F.lit(END)).agg(F.sum("c")).first()[0] or 0)
    names, rare = {t: i for i, t in enumerate(own_counts)}, 3 * ENDINGS
    size = len(names) + rare
    sparse = materialise(training.mapInArrow(lambda it: _pair_counts(it, names, size), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "lm-pairs")
    pairs, rows = np.zeros(size * size, np.float32), max(1, CELLS // size)
    for lo in range(0, size, rows):
        got = sparse.filter((F.col("pair") >= lo * size) & (F.col("pair") < (lo + rows) * size)).toPandas()
        pairs[got["pair"].to_numpy(np.int64)] = got["n"].to_numpy()
    pairs = pairs.reshape(size, size)
    model = {
        "key": uuid.uuid4().hex,
        "own": names,
        "own_counts": list(own_counts.values()),
        "local": {t: -c for c, t in top[own:] if t not in names},
        "rare_n": pairs.sum(axis=0, dtype=np.float64)[len(names) :],
        "rare_v": _rare_kinds(counts, names),
        "params": train(pairs),
    }
    scored = docs.withColumn("row", F.monotonically_increasing_id()).mapInArrow(lambda it: _score(it, model), "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, rare array<binary>")
    scored = materialise(scored, "lm-scored")
    # Counts of a document's rare tokens are added up in order of size, so reruns agree to the last bit.
    # Tokens outside `counts` are unseen; the frequent half of the table is left out of the join.
    table_ = counts if floor is None else counts.filter(level < floor)
    found = scored.select("row", F.explode("rare").alias("token")).join(table_, "token", "left").groupBy("row").agg(F.sort_array(F.collect_list(F.coalesce("c", F.lit(0)))).alias("cs"))
    found = found.select("row", F.aggregate("cs", F.lit(0.0), lambda a, c: a + F.log10(c + 0.1)).alias("more"), F.size(F.filter("cs", lambda c: c > 0)).cast("long").alias("kept"))
    both = scored.drop("rare").join(found, "row", "left")
    more, share = F.coalesce("more", F.lit(0.0)), math.log10(n + 0.1 * (v + 1))
    return both.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("kept", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), (F.col("base") + more - F.col("n_tokens") * share).alias("base_score"), (F.col("score") + more).alias("score"))


def _rare_kinds(counts: DataFrame, names: dict[bytes, int]) -> np.ndarray:
    """Distinct training tokens of each rare class."""

    def kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(3 * ENDINGS, np.int64)
        for batch in batches:
            for t in batch.column("token").to_pylist():
                if t not in names:
                    total[rare_class(t)] += 1
        yield pa.record_batch({"k": pa.array(np.arange(len(total)), pa.int64()), "n": pa.array(total, pa.int64())})

    got = counts.select("token").mapInArrow(kinds, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(3 * ENDINGS)
    out[got["k"].to_numpy(np.int64)] = got["n"].to_numpy()
    return out


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_texts(docs, id_residue(F.col("doc_id"), 10) == 0)
