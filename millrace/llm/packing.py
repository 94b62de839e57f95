"""Packing: hierarchical multi-length packing of tokenised documents.

A document is its token ids and one end id. Whole windows of the longest tier are cut off first;
the tail is routed to the smallest context tier (128, 256, 512, 1024) that holds it. Tiers are
packed from the longest down: a tail opens a window of its tier, and the gap left in it is filled
with whole tails of shorter tiers, largest first, and at last with a cut piece of the shortest, so
that a window has no padding. When no shorter tail is left, open windows are merged end to end.
What stays at the end of a partition is under one longest window and is cut at powers of two.

Step groups have the same number of tokens whatever the tier: 8 windows of 1024, 16 of 512 ... A
group is given out when it is full; at the end of a partition the windows left over are put together
longest first, whatever their tiers, so that only the last group of a partition can hold fewer.

Packing is done within each input partition, so rows are not shuffled and memory is bounded by one
Arrow batch and `pool` tails. A lost task gives the same pieces again. Null text counts as empty
(only the end id); repeated rows and null ids are packed one by one; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.llm.common import bound_batches, by_bytes, table

TIERS = (1024, 512, 256, 128)
STEP_TOKENS = 8192
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long, row long"
# Fixed value: the published pre-tokenisation pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_TOKENIZERS: dict = {}


def byte_bpe(path: str):
    """The byte-level BPE of a tokenizers JSON file, run by tiktoken: the same ids (tested), several times faster; its added tokens and their pattern."""
    if path not in _TOKENIZERS:
        import json

        import tiktoken

        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model = whole["model"]
        # The public byte-to-character table of byte-level BPE: printable Latin-1 stands for itself, the rest follow from 256.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        chars = {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(sorted(set(range(256)) - set(plain)))}
        merged = {"".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]}
        ranks = {bytes(chars[c] for c in token): i for token, i in model["vocab"].items() if token in merged or len(token) == 1}
        added = {t["content"]: t["id"] for t in whole.get("added_tokens", [])}
        # Longer ones first, as tokenizers takes the leftmost and of these the longest.
        cut = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        _TOKENIZERS[path] = tiktoken.Encoding("byte-bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), added, cut
    return _TOKENIZERS[path]


def encode(texts: list[str], path: str) -> list[np.ndarray]:
    """Ids of whole texts, each with its end id 0. Added tokens found in a text have their own ids, as in tokenizers."""
    encoding, added, cut = byte_bpe(path)
    ordinary = encoding.encode_ordinary

    def ids_of(text: str) -> list[int]:
        if cut is None or not cut.search(text):
            return ordinary(text)
        return [i for part in cut.split(text) for i in ([added[part]] if part in added else ordinary(part))]

    return [np.frombuffer(struct.pack(f"<{len(ids) + 1}I", *ids, 0), dtype="<u4") for ids in map(ids_of, texts)]


class Packer:
    """Packs tails of one partition. An item is (doc row, start, length); ids are looked up at the end."""

    def __init__(self, tiers=TIERS):
        self.tiers = tiers
        self.tails: dict[int, list] = {t: [] for t in tiers}  # sorted by length
        self.held = 0
        self.done: list[tuple[int, list]] = []

    def add(self, doc, n: int) -> None:
        top = self.tiers[0]
        for start in range(0, n - n % top, top):
            self.done.append((top, [(doc, start, top)]))
        if tail := n % top:
            tier = min(t for t in self.tiers if t >= tail)
            bisect.insort(self.tails[tier], (tail, self.held, doc, n - tail))
            self.held += 1

    def _fill(self, gap: int, below: list[int]) -> list:
        """Pieces from shorter tiers that sum to gap, or to what there is."""
        got = []
        for t in below:
            while gap and (tails := self.tails[t]):
                k = bisect.bisect_right(tails, (gap, float("inf")))
                if not k:
                    break
                size, _, doc, start = tails.pop(k - 1)
                got.append((doc, start, size))
                gap -= size
        for t in reversed(below):
            if gap and self.tails[t]:
                size, order, doc, start = self.tails[t].pop(0)
                got.append((doc, start, gap))
                size, start, gap = size - gap, start + gap, 0
                tier = min(x for x in self.tiers if x >= size)
                bisect.insort(self.tails[tier], (size, order, doc, start))
        return got

    def pack(self, last: bool) -> None:
        """Empties the pool; without last, what fills no whole window stays in it."""
        open_: list = []
        for k, tier in enumerate(self.tiers):
            below = list(self.tiers[k + 1 :])
            while self.tails[tier]:
                size, _, doc, start = self.tails[tier].pop()
                got = [(doc, start, size), *self._fill(tier - size, below)]
                if sum(x[2] for x in got) == tier:
                    self.done.append((tier, got))
                else:
                    open_ += got
        top, at, window = self.tiers[0], 0, []
        for doc, start, size in open_:
            while size:
                take = min(size, top - at)
                window.append((doc, start, take))
                at, start, size = at + take, start + take, size - take
                if at == top:
                    self.done.append((top, window))
                    at, window = 0, []
        if not last:
            for n, (doc, start, size) in enumerate(window):
                tier = min(t for t in self.tiers if t >= size)
                bisect.insort(self.tails[tier], (size, -1 - n, doc, start))
            return
        while window:
            power, got, need = 1 << (at.bit_length() - 1), [], 1 << (at.bit_length() - 1)
            while need:
                doc, start, size = window[0]
                take = min(size, need)
                got.append((doc, start, take))
                need -= take
                window[:1] = [(doc, start + take, size - take)] if take < size else []
            self.done.append((power, got))
            at -= power


def _pack_partition(batches: Iterator[pa.RecordBatch], path: str, pool: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    schema = pa.schema([(n, pa.int32() if n == "tier" else pa.int64()) for n in (x.split()[0] for x in SCHEMA.split(", "))])
    base, packer = TaskContext.get().partitionId() << 40, Packer()
    held: dict[int, np.ndarray] = {}  # ids of rows that have pieces to come
    names: dict[int, tuple] = {}
    rows = sequences = 0
    waiting: dict[int, list] = {}  # tier -> windows of its open group: (size, rows of its pieces)
    next_group = 0

    def flush(last: bool) -> pa.RecordBatch:
        nonlocal sequences, next_group
        packer.pack(last)
        out: list[list] = [[] for _ in schema]

        def give(windows: list) -> None:
            nonlocal next_group
            for _, rows_ in windows:
                for values in rows_:
                    for column, v in zip(out, (*values[:-1], base + next_group, values[-1]), strict=True):
                        column.append(v)
            next_group += 1

        for tier, pieces in packer.done:
            at, rows_ = 0, []
            for row, start, size in pieces:
                doc_id, total = names[row]
                rows_.append((doc_id, start, size, zlib.crc32(held[row][start : start + size].tobytes()), total, base + sequences, at, tier, base + row))
                at += size
            sequences += 1
            group = waiting.setdefault(tier, [])
            group.append((at, rows_))
            if sum(w[0] for w in group) == STEP_TOKENS:
                give(waiting.pop(tier))
        packer.done = []
        if last:
            # Sizes are powers of two, so that taking the longest first fills each group exactly.
            group: list = []
            for window in sorted((w for g in waiting.values() for w in g), key=lambda w: -w[0]):
                group.append(window)
                if sum(w[0] for w in group) == STEP_TOKENS:
                    give(group)
                    group = []
            if group:
                give(group)
        for row in held.keys() - {x[2] for tails in packer.tails.values() for x in tails}:
            del held[row], names[row]
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    for batch in by_bytes(batches, "text"):
        for doc_id, got in zip(batch.column("doc_id").to_pylist(), encode([x or "" for x in batch.column("text").to_pylist()], path), strict=True):
            held[rows], names[rows] = got, (doc_id, len(got))
            packer.add(rows, len(got))
            rows += 1
        if packer.held >= pool or len(packer.done) >= pool:
            packer.held = 0
            yield flush(False)
    if rows:
        yield flush(True)


def pack(docs: DataFrame, path: str | None = None, pool: int = 4096) -> DataFrame:
    """Pieces of documents in sequences of at most 1024 tokens: the columns of SCHEMA."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    path = str(path)
    bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lambda it: _pack_partition(it, path, pool), StructType.fromDDL(SCHEMA))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
