"""Text to vector as a pluggable batch function, and embedding of what has no vector yet."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexmill.operators.maintain import uncovered
from codexmill.operators.search import quantised

#: texts -> one vector each, all of one length
Embedder = Callable[[list[str]], list[list[float]]]


def word_hashing(dim: int = 64) -> Embedder:
    """A deterministic embedder without a model: words hashed (FNV-1a) into so many places."""

    def hash_(word: str) -> int:
        h = 0xCBF29CE484222325
        for b in word.encode():
            h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
        return h

    def embed(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), dim))
        for i, t in enumerate(texts):
            for w in re.findall(r"[^\W_]+", t.lower()):
                h = hash_(w)
                out[i, h % dim] += 1.0 if h >> 63 else -1.0
        return out.tolist()

    return embed


def call(embedder: Embedder, texts: list[str], batch: int, retries: int = 3) -> list[list[float]]:
    """All vectors of texts; a batch that fails is tried again and then halved, down to one text."""
    out: list[list[float]] = []
    at, size = 0, max(1, batch)
    failures = 0
    while at < len(texts):
        part = texts[at : at + size]
        try:
            got = embedder(part)
            if len(got) != len(part):
                raise ValueError(f"{len(part)} texts, {len(got)} vectors")
        except Exception:
            failures += 1
            if size == 1 and failures > retries:
                raise
            size = max(1, size // 2)
            continue
        out += got
        at += len(part)
        failures = 0
    return out


def inputs(chunks: DataFrame, books: DataFrame) -> DataFrame:
    """(chunk_id, text): text under a head of book title and place; chunks without a book have no head."""
    b = books.select(F.col("id").alias("doc_id"), F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.element_at(F.split("path", "/"), -1)).alias("book"))
    head = F.when(F.col("book").isNotNull(), F.concat(F.col("book"), F.lit(" · p. "), F.col("unit_from").cast("string"), F.lit("\n"))).otherwise("")
    return chunks.join(b, "doc_id", "left").select("chunk_id", F.concat(head, F.coalesce("text", F.lit(""))).alias("text"))


def embed(texts: DataFrame, embedder: Embedder, model: str, batch: int = 64) -> DataFrame:
    """(chunk_id, model, dim, q): quantised vectors of (chunk_id, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"chunk_id": b["chunk_id"], "v": call(embedder, b["text"].fillna("").tolist(), batch)})

    v = texts.select("chunk_id", "text").mapInPandas(run, "chunk_id long, v array<double>")
    return v.select("chunk_id", F.lit(model).alias("model"), F.size("v").alias("dim"), quantised(F.col("v")).alias("q"))


def embed_missing(chunks: DataFrame, books: DataFrame, vectors: DataFrame, embedder: Embedder, model: str) -> DataFrame:
    """Vectors of the chunks that have none of this model yet: an interrupted run goes on where it stopped."""
    return embed(inputs(uncovered(chunks, vectors, model), books), embedder, model)


def coverage(chunks: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    """One row: total, covered, percent (whole, 0 without chunks)."""
    v = vectors.where(F.col("model") == model).select("chunk_id").distinct().withColumn("c", F.lit(1))
    n = chunks.select("chunk_id").distinct().join(v, "chunk_id", "left").agg(F.count("*").alias("total"), F.count("c").alias("covered"))
    return n.withColumn("percent", F.when(F.col("total") > 0, F.floor(F.col("covered") * 100 / F.col("total"))).otherwise(0))
