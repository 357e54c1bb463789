"""Filling containers of fixed capacity with texts, whole unless larger than a container.

Method: space-filling-curve order. Each text becomes a hashed word vector, projected to a few dimensions and put on a
Hilbert curve; texts are range-sorted by their place on it, and neighbours along the curve are packed together. Within
a stretch of neighbours the fullest container that still has room takes the next largest text (best fit, decreasing);
containers with room left stay open for the stretches that follow.
"""

from __future__ import annotations

import base64
import os
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexmill.llm._words import slices, word_hashes
from codexmill.session import written

#: The tokenizer that measures texts: a file of public vocabulary, by path.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: how the public byte-level vocabularies part a text before they merge.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Dimensions and bits of the curve; neighbours that are packed together; containers that stay open beyond them.
DIMS, CURVE_BITS = 4, 8
STRETCH, OPEN = 8192, 512
#: Texts that one task packs, about; the number of tasks follows from that of the texts alone.
TASK = 4 * STRETCH

_encoders: dict[str, object] = {}


def encoder(path: str):
    """The tokenizer of a vocabulary file, read once a process."""
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _encoders[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def hilbert(x: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of points with whole coordinates of so many bits (rows: points)."""
    x = x.astype(np.uint64).copy()
    n = x.shape[1]
    q = np.uint64(1 << (bits - 1))
    while q > 1:  # undo the excess turns from the top bit down
        p = q - np.uint64(1)
        for i in range(n):
            set_ = (x[:, i] & q) > 0
            swap = np.where(set_, np.uint64(0), (x[:, 0] ^ x[:, i]) & p)
            x[:, 0] = np.where(set_, x[:, 0] ^ p, x[:, 0] ^ swap)
            x[:, i] ^= swap if i else np.uint64(0)
        q >>= np.uint64(1)
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    t, q = np.zeros(len(x), np.uint64), np.uint64(1 << (bits - 1))
    while q > 1:
        t ^= np.where((x[:, n - 1] & q) > 0, q - np.uint64(1), np.uint64(0))
        q >>= np.uint64(1)
    x ^= t[:, None]
    key = np.zeros(len(x), np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << np.uint64(1)) | ((x[:, i] >> np.uint64(b)) & np.uint64(1))
    return key


def _measure(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[pa.RecordBatch]:
    from pyspark import SparkFiles

    enc = encoder(SparkFiles.get(name))
    for batch in batches:
        texts = batch.column("text").to_pylist()
        tokens = [len(enc.encode_ordinary(x)) for x in texts]
        place = np.zeros(len(texts), np.int64)
        words = batch.column("words")
        for lo, hi in slices(words):
            h, row, _, _ = word_hashes(words.slice(lo, hi - lo))
            v = np.column_stack([np.bincount(row, 1.0 - 2.0 * ((h >> np.uint64(k)) & np.uint64(1)), hi - lo) for k in range(DIMS)])
            v /= np.sqrt(np.maximum(np.bincount(row, minlength=hi - lo), 1))[:, None]
            place[lo:hi] = hilbert(np.clip((v + 4) * 32, 0, 255).astype(np.int64), CURVE_BITS).astype(np.int64)
        yield pa.record_batch({"doc_id": batch.column("doc_id"), "tokens": pa.array(tokens, pa.int64()), "place": pa.array(place)})


class Packer:
    """Packs items in stretches into containers of one capacity; numbers containers from 0."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.count = capacity, 0
        self.room: list[tuple[int, int]] = []  # (room left, container), in order

    def pack(self, items: list[tuple[int, object]]) -> Iterator[tuple[int, object, int, int]]:
        """(container, item, piece, tokens) of (tokens, item); items above the capacity fill containers of their own
        with pieces, and what is left of them is packed like any other."""
        rest = []
        for size, item in items:
            piece = 0
            while size > self.capacity:
                yield self.count, item, piece, self.capacity
                self.count += 1
                piece, size = piece + 1, size - self.capacity
            rest.append((size, piece, item))
        rest.sort(key=lambda x: -x[0])
        for size, piece, item in rest:
            at = bisect_left(self.room, (size, -1))
            if at < len(self.room):
                left, where = self.room.pop(at)
            else:
                left, where = self.capacity, self.count
                self.count += 1
            if left > size:
                insort(self.room, (left - size, where))
            yield where, item, piece, size
        # those with the least room can hardly be filled any more
        del self.room[: max(0, len(self.room) - OPEN)]


def _pack(batches: Iterator[pa.RecordBatch], containers: list[tuple[str, int]]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    task = TaskContext.get().partitionId()
    packers = [(name, Packer(c)) for name, c in containers]
    held: list[tuple[int, int]] = []

    def flush() -> Iterator[pa.RecordBatch]:
        for name, p in packers:
            rows = list(p.pack(held))
            if rows:
                w, d, k, t = zip(*rows, strict=True)
                yield pa.record_batch({"container": pa.array([name] * len(rows)), "bin": pa.array(np.array(w, np.int64) + (task << 40)), "doc_id": pa.array(d, pa.int64()), "piece": pa.array(k, pa.int32()), "tokens": pa.array(t, pa.int64())})
        held.clear()

    for batch in batches:
        for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("tokens").to_pylist(), strict=True):
            held.append((t, d))
            if len(held) >= STRETCH:
                yield from flush()
    yield from flush()


def measured(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, tokens, place on the curve) of every document with a text of at least one token.

    The vocabulary is a file the driver can read; it is sent to the executors, which need not have it.
    """
    documents.sparkSession.sparkContext.addFile(vocabulary)
    rows = documents.where("doc_id is not null and text is not null and text <> ''").select("doc_id", "text", F.regexp_replace(F.lower("text"), "[^\\p{L}\\p{Nd}]+", " ").alias("words"))
    return rows.mapInArrow(lambda it: _measure(it, os.path.basename(vocabulary)), "doc_id long, tokens long, place long")


def packed(documents: DataFrame, containers: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(container, bin, doc_id, piece, tokens): for each kind of container, which of its bins holds which text.

    A text larger than the capacity comes in pieces 0, 1, ... of that many tokens each, but the last; any other is whole
    (piece 0). Null and empty texts are not packed; copies are packed like any text; repeated doc_id are packed as often as they come. Containers (a
    configuration table) with a null or not positive capacity are left out. Ranges of the curve are packed apart from
    each other, which leaves a few open bins a task.
    """
    kinds = [(r["container"], r["capacity"]) for r in containers.where("container is not null and capacity > 0").select("container", "capacity").distinct().orderBy("container").collect()]
    rows = written(measured(documents, vocabulary), "measured")  # the range sort reads it twice
    parts = rows.count() // TASK + 1
    ordered = rows.repartitionByRange(parts, "place", "doc_id").sortWithinPartitions("place", "doc_id")
    return ordered.mapInArrow(lambda it: _pack(it, kinds), "container string, bin long, doc_id long, piece int, tokens long")


def fill(packing: DataFrame, containers: DataFrame) -> DataFrame:
    """(container, capacity, bins, tokens, least_bins, filled): how well a packing uses its containers.

    least_bins is the number of bins that the tokens alone would need.
    """
    by_bin = packing.groupBy("container", "bin").agg(F.sum("tokens").alias("t"))
    sums = by_bin.groupBy("container").agg(F.count("*").alias("bins"), F.sum("t").alias("tokens"))
    least = F.ceil(F.col("tokens") / F.col("capacity"))
    return sums.join(containers.select("container", "capacity"), "container").select("container", "capacity", "bins", "tokens", least.alias("least_bins"), F.round(F.col("tokens") / (F.col("bins") * F.col("capacity")), 6).alias("filled"))
