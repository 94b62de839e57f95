"""Toxicity: significant passages by maximum-scoring segment search.

Words are runs between white space and ASCII punctuation, A-Z lower-cased. Tokens are words and
their beginnings of 4, 5 and 6 bytes, which hold inflected forms together. A token's log-odds
compare the toxic and clean training documents that contain it, under a Dirichlet prior of pooled
frequencies (`prior` times its own count). Where it is `sure` standard errors from 0, its score is
the log-odds shrunk by one standard error; a word scores as the best of its tokens, lowered by
`drift`, so that clean text has a negative expectation. Per document all maximal scoring segments
are found in linear time. A segment of score s in n words has the E-value K n exp(-lambda s):
lambda solves sum p exp(lambda score) = 1 over the scores of clean words (1 if none is positive), K
is the maximum-likelihood value over the clean training documents' best segments (a Gumbel law).
Passages with E <= `alpha` are significant. A document's score is a logistic function, fitted on
training documents, of its best and its summed significant evidence.

Learning takes about `per_class` labelled training documents of each class (a documented bound):
ids whose hash is under per_class / the class's size, all if there are fewer; class weights restore
the labels' shares. Their ids are few enough to broadcast, so texts are not shuffled, and the sample
is written once. All tokens that are sure take part. Scores use texts alone.

Null or empty text has no passages. Null labels and those other than 0 and 1 are left out; repeated
labels of an id count as toxic if one does. Without toxic or clean training documents every score
is the share of toxic labels (0 without labels). Repeated rows and null ids are scored row by row;
an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import bound_batches, by_bytes, id_residue, materialise, release, table

PER_CLASS = 8000
STEMS = (4, 5, 6)
MEMO = 200_000
_SPACES = bytes(32 if b < 33 or (b < 128 and not chr(b).isalnum()) else b + 32 if 65 <= b <= 90 else b for b in range(256))
PASSAGE = "array<struct<start:long,end:long,score:double,e_value:double>>"


def word_runs(text: str | None, most: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text in runs of about `most` bytes, so that a long text's words are never held at once."""
    raw, at = (text or "").encode("utf-8", "replace").translate(_SPACES), 0
    while at < len(raw):
        end = raw.find(b" ", at + most)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), end exclusive, in one pass."""
    found: list[tuple[int, int, float, float]] = []  # start, end, sum before it, sum with it
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        start, end, left, right = i, i + 1, before, total
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= left:
                j -= 1
            if j < 0 or found[j][3] >= right:
                break
            start, left = found[j][0], found[j][2]
            del found[j:]
        found.append((start, end, left, right))
    return [(a, b, r - x) for a, b, x, r in found]


def tokens_of(word: bytes) -> list[bytes]:
    """The word and its marked beginnings."""
    return [word, *[b"\0" + word[:n] for n in STEMS if len(word) >= n]]


class WordScores(dict):
    """Scores of words from those of tokens, remembered for the first MEMO words."""

    def __init__(self, tokens: dict[bytes, float], drift: float):
        super().__init__()
        self.tokens, self.drift = tokens, drift

    def __missing__(self, word: bytes) -> float:
        known = [x for x in map(self.tokens.get, tokens_of(word)) if x is not None]
        s = (max(known) if known else 0.0) - self.drift
        if len(self) < MEMO:
            self[word] = s
        return s

    def __reduce__(self):
        return WordScores, (self.tokens, self.drift)


class Model:
    """Word scores, the law of best segments in clean text, and the logistic function."""

    def __init__(self, share: float):
        self.share, self.scores = share, None
        self.rate, self.k, self.weights, self.alpha = 1.0, 1.0, None, 0.01

    def segments(self, text: str | None) -> tuple[int, float, list[tuple[int, int, float, float]]]:
        """Number of words, evidence of the best segment, and the significant ones with their E-values."""
        scored = (lambda w: 0.0) if self.scores is None else self.scores.__getitem__
        parts = [np.fromiter(map(scored, words), np.float64, len(words)) for words in word_runs(text)]
        s = np.concatenate(parts) if parts else np.zeros(0)
        n = len(s)
        if not n or self.scores is None:
            return n, 0.0, []
        run = np.concatenate([[0.0], np.cumsum(s)])
        best = float((run - np.minimum.accumulate(run)).max())
        scale = math.log(self.k * n)
        evidence = self.rate * best - scale
        if evidence < -math.log(self.alpha):
            return n, evidence, []
        every = ((a, b, x, scale - self.rate * x) for a, b, x in maximal_segments(s.tolist()))
        return n, evidence, [(a, b, x, math.exp(e)) for a, b, x, e in every if e <= math.log(self.alpha)]

    @staticmethod
    def features(n: int, evidence: float, found: list) -> tuple[float, ...]:
        total = sum(-math.log(max(e, 1e-300)) for *_, e in found)
        return (1.0, max(evidence, -10.0) / 10, math.log1p(len(found)), math.log1p(total), math.log1p(n) / 10)

    def score(self, n: int, evidence: float, found: list) -> float:
        if self.weights is None:
            return self.share
        z = float(np.dot(self.weights, self.features(n, evidence, found)))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = (Counter(), Counter())

    def out():
        every = list(counts[0].keys() | counts[1].keys())
        batch = pa.record_batch({"word": pa.array(every, pa.binary()), "clean": pa.array([counts[0][w] for w in every], pa.int64()), "toxic": pa.array([counts[1][w] for w in every], pa.int64())})
        counts[0].clear()
        counts[1].clear()
        return batch

    for batch in by_bytes(batches, "text"):
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            kinds = set().union(*map(set, word_runs(text)))
            counts[toxic].update({t for w in kinds for t in tokens_of(w)})
        if len(counts[0]) + len(counts[1]) > 300_000:
            yield out()
    yield out()


def _clean_scores(batches: Iterator[pa.RecordBatch], scores: WordScores) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches, "text"):
        seen = Counter(s for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True) if not toxic for words in word_runs(text) for s in map(scores.__getitem__, words))
        yield pa.record_batch({"s": pa.array(list(seen.keys()), pa.float64()), "n": pa.array(list(seen.values()), pa.int64())})


def _evidence(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches, "text"):
        rows = [model.segments(text) for text in batch.column("text").to_pylist()]
        yield pa.record_batch(
            {
                **{c: batch.column(c) for c in batch.schema.names if c != "text"},
                "n_words": pa.array([r[0] for r in rows], pa.int64()),
                "evidence": pa.array([r[1] for r in rows], pa.float64()),
                "passages": pa.array([[{"start": a, "end": b, "score": x, "e_value": e} for a, b, x, e in r[2]] for r in rows], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("e_value", pa.float64())]))),
                "score": pa.array([model.score(*r) for r in rows], pa.float64()),
            }
        )


def _root(p: np.ndarray, s: np.ndarray) -> float:
    """The positive solution of sum p exp(x s) = 1, for a negative mean of s."""
    lo, hi = 0.0, 1.0
    while hi < 64 and p @ np.exp(hi * s) < 1:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if p @ np.exp(mid * s) < 1 else (lo, mid)
    return max(hi, 1e-3)


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        penalty = ridge * np.r_[0.0, np.ones(x.shape[1] - 1)]
        g = x.T @ (w * (y - p)) - penalty * b
        h = (x * (w * p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9)
        step = np.linalg.solve(h, g)
        b += step
        if np.abs(step).max() < 1e-9:
            break
    return b


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, prior: float = 0.05, sure: float = 3.5, drift: float = 0.5, alpha: float = 0.01) -> Model:
    """Learns from labelled documents (doc_id, text; doc_id, toxic). All labels given are training labels."""
    bound_batches(docs.sparkSession)
    labels = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    size = {int(r["toxic"]): r["count"] for r in labels.groupBy("toxic").count().collect()}
    model = Model(size.get(1, 0) / max(1, sum(size.values())))
    model.alpha = alpha
    if not size.get(0) or not size.get(1):
        return model
    place = (F.xxhash64("doc_id") / float(2**64)) + 0.5  # in [0, 1]
    limit = F.when(F.col("toxic") == 1, F.lit(per_class / size[1])).otherwise(F.lit(per_class / size[0]))
    picked = F.broadcast(labels.filter((place < limit) | (limit >= 1)))
    sample = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(picked, "doc_id").select("text", "toxic"), "tox-sample")
    taken = {int(r["toxic"]): r["count"] for r in sample.groupBy("toxic").count().collect()}
    n0, n1 = taken.get(0, 0), taken.get(1, 0)
    if not n0 or not n1:
        return model
    counts = sample.mapInArrow(_count, "word binary, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    a = prior * (F.col("clean") + F.col("toxic"))
    odds = lambda c, n: F.log(c + a) - F.log(F.lit(float(n)))
    delta = odds(F.col("toxic"), n1) - odds(F.col("clean"), n0)
    error = F.sqrt(1 / (F.col("toxic") + a) + 1 / (F.col("clean") + a))
    scored = counts.select("word", delta.alias("delta"), error.alias("error")).filter(F.abs("delta") > sure * F.col("error"))
    top = scored.toPandas()  # tokens of the sample that are sure: their number follows the bound on documents
    if not len(top):
        return model
    shrunk = np.sign(top["delta"]) * (np.abs(top["delta"]) - top["error"])
    model.scores = WordScores({bytes(w): float(x) for w, x in zip(top["word"], np.clip(shrunk, -1.0, 12.0), strict=True)}, drift)
    scores = model.scores
    law = sample.mapInArrow(lambda it: _clean_scores(it, scores), "s double, n long").groupBy("s").agg(F.sum("n").alias("n")).orderBy("s").toPandas()
    p, s = law["n"].to_numpy(float), law["s"].to_numpy(float)
    model.rate = 1.0
    if len(p) and s.max() > 0:
        model.rate = _root(p / p.sum(), s) if p @ s < 0 else 0.05
    seen = sample.mapInArrow(lambda it: _evidence(it, model), f"toxic int, n_words long, evidence double, passages {PASSAGE}, score double").toPandas()
    clean = seen[(seen["toxic"] == 0) & (seen["n_words"] > 0)]
    # With k = 1 the evidence is rate * best - log(n), so n exp(-rate * best) is exp(-evidence).
    model.k = float(np.clip(len(clean) / max(1e-300, np.exp(-clean["evidence"].to_numpy()).sum()), 1e-6, 1e6))
    seen = sample.mapInArrow(lambda it: _evidence(it, model), f"toxic int, n_words long, evidence double, passages {PASSAGE}, score double").toPandas()
    x = np.array([Model.features(n, e, [tuple(q.values()) if isinstance(q, dict) else tuple(q) for q in f]) for n, e, f in zip(seen["n_words"], seen["evidence"], seen["passages"], strict=True)])
    y = seen["toxic"].to_numpy(float)
    share = {t: size[t] / max(1, int((y == t).sum())) for t in (0, 1)}
    release(sample)
    w = np.where(y == 1, share[1], share[0])
    model.weights = _logistic(x, y, w / w.mean())
    return model


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_words, evidence, passages, score for each row."""
    bound_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(lambda it: _evidence(it, model), f"doc_id long, n_words long, evidence double, passages {PASSAGE}, score double")


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that score below the threshold, with all their columns."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            fine = [model.score(*model.segments(text)) < threshold for text in batch.column("text").to_pylist()]
            yield batch.filter(pa.array(fine, pa.bool_()))

    bound_batches(docs.sparkSession)
    return docs.mapInArrow(keep, docs.schema)


def train_on(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Model:
    return fit(docs, table(spark, sf_dir, "labels").filter(id_residue(F.col("doc_id"), 5) != 0))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_toxicity(docs, train_on(spark, docs, sf_dir))
    return scored.select("doc_id", (id_residue(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").cast("long").alias("n_passages"))
