"""Frequency of every distinct term, and which terms are too rare or too common to help a search.

Method: recursive radix spilling. Terms are counted within each map task, the partial counts are partitioned by bits
of the term's hash (the spill is Spark's shuffle, which lives on disk), and each partition is aggregated out of core
by DuckDB, which splits a partition that is still too large by further hash bits before it aggregates each split.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexmill.llm import _filter
from codexmill.llm._words import mix
from codexmill.session import shared_dir, written
from codexmill.sources.tables import latest

#: Rows of partial counts that DuckDB aggregates at once; a larger partition is split by further hash bits.
SPLIT_ROWS = 250_000
#: Rows of partial counts that one task aggregates, about; the number of tasks follows from them.
TASK_ROWS = 1_000_000
#: Hash bits per split.
BITS = 4
#: DuckDB's memory per task. Where the shared folder is mounted it spills beyond that to a folder of its own there.
MEMORY = "256MB"

COUNTS = "term string, occurrences long, chunks long"
#: Partial counts, or a row that only the comparison with others of its chunk can settle.
FIRST = "term string, occurrences long, chunks long, chunk_id long, analyzed_at timestamp, terms array<string>"


def _chunk_hashes(batch: pa.RecordBatch) -> np.ndarray:
    return mix(batch.column("chunk_id").to_numpy().view(np.uint64))


class _Counter:
    """Counts of one task, merged whenever they grow to a bounded size."""

    def __init__(self, shortest: int, longest: int) -> None:
        self.between, self.parts, self.rows = (shortest, longest), [], 0

    def add(self, lists: pa.Array) -> None:
        flat = lists.flatten()
        there = pc.is_valid(flat)
        raw, of = flat.filter(there).dictionary_encode(), pc.list_parent_indices(lists).filter(there).to_numpy()
        # trimmed and in lower case once per distinct term
        named = pc.utf8_lower(pc.utf8_trim(raw.dictionary, " ")).dictionary_encode()
        names, n = named.dictionary, len(named.dictionary)
        if not n:
            return
        size = pc.utf8_length(names).to_numpy(zero_copy_only=False)
        code = named.indices.to_numpy().astype(np.int64)[raw.indices.to_numpy()]
        ok = ((size >= self.between[0]) & (size <= self.between[1]))[code]
        code, of = code[ok], of[ok]
        within = np.unique(of.astype(np.int64) * n + code) % n
        got = pa.table({"term": names, "occurrences": np.bincount(code, minlength=n), "chunks": np.bincount(within, minlength=n)})
        self.parts.append(got.filter(pc.greater(got["occurrences"], 0)))
        self.rows += n
        if self.rows > 1_000_000:
            self.parts = [self.total()]
            self.rows = self.parts[0].num_rows

    def total(self) -> pa.Table:
        got = pa.concat_tables(self.parts).group_by("term").aggregate([("occurrences", "sum"), ("chunks", "sum")])
        return pa.table({"term": got["term"], "occurrences": got["occurrences_sum"], "chunks": got["chunks_sum"]})

    def out(self) -> Iterator[pa.Table]:
        if self.parts:
            yield self.total()
            self.parts, self.rows = [], 0


def _partial(batches: Iterator[pa.RecordBatch], counter: _Counter) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counter.add(batch.column("terms"))
        if counter.rows > 500_000:
            for t in counter.out():
                yield from t.to_batches()
    for t in counter.out():
        yield from t.to_batches()


def _first(batches: Iterator[pa.RecordBatch], counter: _Counter, several: _filter.Filter) -> Iterator[pa.RecordBatch]:
    """Counts the rows whose chunk surely has no other row; gives the others out as they are."""

    def whole(**columns) -> list[pa.RecordBatch]:
        n = len(next(iter(columns.values())))
        kinds = {"term": pa.string(), "occurrences": pa.int64(), "chunks": pa.int64(), "chunk_id": pa.int64(), "analyzed_at": pa.timestamp("us", "UTC"), "terms": pa.list_(pa.string())}
        return pa.table({c: columns[c].cast(k) if c in columns else pa.nulls(n, k) for c, k in kinds.items()}).to_batches()

    for batch in batches:
        if not batch.num_rows:
            continue
        maybe = pa.array(several.maybe(_chunk_hashes(batch)))
        counter.add(batch.column("terms").filter(pc.invert(maybe)))
        rest = batch.filter(maybe)
        if rest.num_rows:
            yield from whole(**{c: rest.column(c) for c in ("chunk_id", "analyzed_at", "terms")})
        if counter.rows > 500_000:
            for t in counter.out():
                yield from whole(**{c: t[c] for c in t.column_names})
    for t in counter.out():
        yield from whole(**{c: t[c] for c in t.column_names})


def _radix(con, table: str, shift: int, rows: int) -> Iterator[pa.RecordBatch]:
    """Aggregates a table of partial counts, in splits by further hash bits where it is too large."""
    if rows <= SPLIT_ROWS or shift > 56:
        yield from con.sql(f"select term, sum(occurrences)::bigint occurrences, sum(chunks)::bigint chunks from {table} group by term").to_arrow_reader(50_000)
        return
    for k in range(1 << BITS):
        part = f"{table}_{k}"
        con.execute(f"create table {part} as select * from {table} where (hash(term) >> {shift}) & {(1 << BITS) - 1} = {k}")
        n = con.execute(f"select count(*) from {part}").fetchall()[0][0]
        if n:
            # one term alone can't be split; its partial rows are at most one per map task and flush
            yield from _radix(con, part, 64 if n == rows else shift + BITS, n)
        con.execute(f"drop table {part}")


def _aggregate(batches: Iterator[pa.RecordBatch], shared: str | None) -> Iterator[pa.RecordBatch]:
    """Final counts of one partition. shared: the folder to spill to; without one DuckDB keeps to its memory."""
    import duckdb

    folder = os.path.join(shared, f"radix-{uuid.uuid4().hex}") if shared else None
    try:
        if folder:
            os.makedirs(folder)
            con = duckdb.connect(os.path.join(folder, "spill.db"))
            con.execute(f"set memory_limit='{MEMORY}'; set temp_directory='{folder}/tmp'")
        else:
            con = duckdb.connect()  # TASK_ROWS bounds what a task holds
            con.execute(f"set memory_limit='{MEMORY}'")
        con.execute("set threads=1; set preserve_insertion_order=false")
        con.execute("create table partial (term varchar, occurrences bigint, chunks bigint)")
        rows = 0
        for batch in batches:
            con.register("b", pa.Table.from_batches([batch]))
            con.execute("insert into partial select term, occurrences, chunks from b")
            con.unregister("b")
            rows += batch.num_rows
        if rows:
            schema = pa.schema([("term", pa.string()), ("occurrences", pa.int64()), ("chunks", pa.int64())])
            for got in _radix(con, "partial", 0, rows):
                yield from pa.Table.from_batches([got]).cast(schema).to_batches()
        con.close()
    finally:
        if folder:
            shutil.rmtree(folder, ignore_errors=True)


def term_counts(tokens: DataFrame, shortest: int = 2, longest: int = 40) -> DataFrame:
    """(term, occurrences, chunks) of every distinct term of the current rows.

    Terms are trimmed and put in lower case; null terms and terms shorter or longer than the limits (characters)
    don't count. Rows with a null chunk_id don't count; null and empty lists have no terms. Repeated and older rows of
    a chunk count once. A term in a third of all chunks is one row per map task when it is shuffled.
    """
    counter = lambda: _Counter(shortest, longest)
    terms = F.coalesce(F.col("terms.term"), F.array().cast("array<string>"))
    rows = tokens.where("chunk_id is not null").select("chunk_id", F.col("analyzed_at").cast("timestamp").alias("analyzed_at"), terms.alias("terms"))
    # only the lists of chunks with several rows are shuffled, to find the current one
    several = _filter.make(rows.groupBy("chunk_id").agg(F.count("*").alias("n")).where("n > 1").select("chunk_id"), _chunk_hashes)
    sent = tokens.sparkSession.sparkContext.broadcast(several)
    first = written(rows.mapInArrow(lambda it: _first(it, counter(), sent.value), FIRST), "counted")
    current = latest(first.where("chunk_id is not null").select("chunk_id", "analyzed_at", "terms"), ["chunk_id"], "analyzed_at", "terms").select("terms")
    settled = written(current.mapInArrow(lambda it: _partial(it, counter()), COUNTS), "settled")
    partial = first.where("term is not null").select("term", "occurrences", "chunks").unionAll(settled)
    parts = partial.count() // TASK_ROWS + 1
    where = urlparse(shared_dir(tokens.sparkSession))
    shared = where.path if where.scheme in ("", "file") else None  # DuckDB spills to mounted folders only
    radix = F.pmod(F.xxhash64("term"), F.lit(1 << 32))
    return partial.repartition(max(parts, min(tokens.sparkSession.sparkContext.defaultParallelism, parts * 8)), radix).mapInArrow(lambda it: _aggregate(it, shared), COUNTS)


def marked_terms(tokens: DataFrame, rare_below: int = 3, common_above: float = 0.28) -> DataFrame:
    """term_counts() with mark: `rare` below so many chunks, `common` above that share of all chunks, else null.

    All chunks are the distinct chunk_id of tokens, those with empty lists included; without any, there are no rows.
    """
    total = tokens.agg(F.countDistinct("chunk_id").alias("total"))  # one row
    mark = F.when(F.col("chunks") < rare_below, "rare").when(F.col("chunks") > F.col("total") * common_above, "common")
    return term_counts(tokens).crossJoin(F.broadcast(total)).select("term", "occurrences", "chunks", mark.alias("mark"))
