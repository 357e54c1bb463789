"""Processing only new or changed records, with a ledger of processed sequence numbers.

Both parts keep what was processed as disjoint intervals of sequence numbers and subtract them from what is available
with one operator, outside():

* changed_since_success(): over a history of runs, the records of each run that no successful run before it had
  processed in that state. The sequence numbers are those of the runs, the intervals are kept per record and state.
* Ledger: the production form. It keeps the processed sequence numbers of a source as merged disjoint intervals,
  subtracts them from what is available, gives the gaps (late commits are simply gaps further back) and commits
  output and merged intervals together.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FOREVER = 2147483647
#: Intervals that a ledger file holds itself, the longest; they become a filter that reaches the scan.
HEAD = 64
#: Bits of a sequence number within one window of outside(): 2^WIDTH numbers are sorted together.
WIDTH = 20
#: Intervals and numbers that one task merges, about.
MERGE_ROWS = 1_000_000


def observations(listings: DataFrame) -> DataFrame:
    """One row per run and path: the latest seen_at holds; null run, path, size or mtime are ignored.

    Rows that tie on seen_at but disagree are settled by the larger (size, mtime), so the result is defined.
    """
    usable = listings.where("run_id is not null and path is not null and size is not null and mtime is not null")
    last = F.max(F.struct(F.col("seen_at").isNotNull().alias("h"), "seen_at", "size", "mtime"))
    return usable.groupBy("run_id", "path").agg(last.alias("m")).select("run_id", "path", F.col("m.size").alias("size"), F.col("m.mtime").alias("mtime"))


def outside(rows: DataFrame, intervals: DataFrame, seq: str, keys: tuple[str, ...] = (), width: int | None = WIDTH) -> DataFrame:
    """The rows whose sequence number lies in no interval [lo, hi] of the same keys; rows with a null number are dropped.

    Both sides are sorted together and the furthest end seen so far decides, so there is no product of rows and
    intervals. width parts the numbers into windows of 2^width, to which intervals are cut; without it the keys alone
    part the work. Overlapping, repeated and empty intervals are allowed.
    """
    at = F.col(seq).cast("long")
    some = intervals.where("lo <= hi").select(*keys, F.col("lo").cast("long").alias("__at"), F.col("hi").cast("long").alias("__hi"))
    mine = rows.where(F.col(seq).isNotNull()).withColumn("__at", at)
    parted = list(keys)
    if width is not None:
        size = F.lit(1 << width)
        block = F.explode(F.sequence(F.shiftright("__at", width), F.shiftright("__hi", width)))
        some = some.select("*", block.alias("__block")).withColumn("__at", F.greatest("__at", F.col("__block") * size)).withColumn("__hi", F.least("__hi", (F.col("__block") + 1) * size - 1))
        mine = mine.withColumn("__block", F.shiftright("__at", width))
        parted.append("__block")
    w = Window.partitionBy(*parted).orderBy("__at", F.col("__hi").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    both = mine.withColumn("__mine", F.lit(True)).unionByName(some, allowMissingColumns=True).withColumn("__end", F.max("__hi").over(w))
    return both.where("__mine and (__end is null or __end < __at)").select(*[F.col(f"`{c}`") for c in rows.columns])


def processed_intervals(seen: DataFrame) -> DataFrame:
    """Disjoint intervals [lo, hi] of run numbers in which a path counts as processed with one size and mtime.

    seen: run_id, path, size, mtime of successful runs. An observation holds from the run after its own up to the next
    successful observation of the path; adjoining intervals with the same state are merged.
    """
    w = Window.partitionBy("path").orderBy("run_id")
    same = F.col("size").eqNullSafe(F.lag("size").over(w)) & F.col("mtime").eqNullSafe(F.lag("mtime").over(w))
    marked = seen.withColumn("upto", F.coalesce(F.lead("run_id").over(w), F.lit(FOREVER))).withColumn("new", (~same).cast("int"))
    island = marked.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ends = island.groupBy("path", "island").agg((F.min("run_id") + 1).alias("lo"), F.max("upto").alias("hi"), F.first("size").alias("size"), F.first("mtime").alias("mtime"))
    return ends.select("path", "size", "mtime", "lo", "hi")


def changed_since_success(listings: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_id, path, size, mtime) of every run, new or changed since what earlier successful runs have seen.

    A run of any status gets its changes, so that a retry after a failed or canceled run repeats what was not
    committed, and nothing that was. Empty inputs give no rows; runs absent from `runs` give none either.
    Everything is partitioned by path; a path has at most one row per run, however often it was listed.
    """
    status = runs.where("run_id is not null").groupBy("run_id").agg(F.max((F.col("status") == "ok").cast("int")).alias("ok"))
    seen = observations(listings).join(status, "run_id").repartition("path")
    done = processed_intervals(seen.where("ok = 1").select("run_id", "path", "size", "mtime"))
    return outside(seen.select("run_id", "path", "size", "mtime"), done, "run_id", ("path", "size", "mtime"), width=None)


def merge(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Closed integer intervals, merged where they overlap or adjoin, in order."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted((a, b) for a, b in intervals if a <= b):
        if out and lo <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def subtract(available: list[tuple[int, int]], done: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The parts of `available` that lie in no interval of `done`."""
    gaps, taken = [], merge(done)
    for lo, hi in merge(available):
        for a, b in taken:
            if b < lo or a > hi:
                continue
            if a > lo:
                gaps.append((lo, a - 1))
            lo = b + 1
        if lo <= hi:
            gaps.append((lo, hi))
    return gaps


def _merge_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges intervals that come in order of lo; holds the last one open."""
    now: tuple[int, int] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        lo, hi = (batch.column(c).to_numpy() for c in ("lo", "hi"))
        if now:
            lo, hi = np.concatenate(([now[0]], lo)), np.concatenate(([now[1]], hi))
        reach = np.maximum.accumulate(hi)
        first = np.flatnonzero(np.concatenate(([True], lo[1:] - 1 > reach[:-1])))
        last = np.concatenate((first[1:] - 1, [len(lo) - 1]))
        now = int(lo[first[-1]]), int(reach[-1])
        if len(first) > 1:
            yield pa.record_batch({"lo": pa.array(lo[first[:-1]]), "hi": pa.array(reach[last[:-1]])})
    if now:
        yield pa.record_batch({"lo": pa.array([now[0]], pa.int64()), "hi": pa.array([now[1]], pa.int64())})


def merged(intervals: DataFrame, rows: int) -> DataFrame:
    """Intervals (lo, hi) merged where they overlap or adjoin, about MERGE_ROWS of the `rows` of them a task.

    Each range of numbers is merged by itself, so two that adjoin across a border of ranges stay two.
    """
    parts = max(1, rows // MERGE_ROWS)
    some = intervals.where("lo <= hi")
    ordered = (some.repartition(1) if parts == 1 else some.repartitionByRange(parts, "lo")).sortWithinPartitions("lo")
    return ordered.mapInArrow(_merge_sorted, "lo long, hi long")


class Conflict(RuntimeError):
    """Another writer committed first; nothing of this batch was kept."""


@dataclass
class Ledger:
    """Processed sequence numbers of one source, committed together with the output of each batch.

    A batch first copies the rows it takes to <root>/staged/<name>, so that everything later speaks of the same rows
    even if the source grows meanwhile. It writes its output to <root>/data/<name>, a folder no other writer knows, and
    commits by creating <root>/ledger/<number>.json, which names that folder and holds the merged intervals. Of several
    writers one can create a number; the others delete what they wrote and start again from the new state. Readers take
    only folders that a ledger file names, so what died before its commit is never seen and its numbers stay gaps.

    `done` holds the intervals, the HEAD longest if there are more; the others are in <root>/intervals/<name>.
    """

    spark: SparkSession
    root: str
    seq: str = "seq"
    batch: int = 0
    name: str = ""
    count: int = 0
    done: list[tuple[int, int]] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.load()

    def _path(self, *parts: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join((self.root.rstrip("/"), *parts)))

    def _fs(self):
        return self._path().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _delete(self, *parts: str) -> None:
        self._fs().delete(self._path(*parts), True)

    def _drop(self, name: str) -> None:
        self._delete("data", name)
        self._delete("intervals", name)

    def _read(self, path) -> str:
        stream = self._fs().open(path)
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _publish(self, name: str, text: str) -> bool:
        """Creates a ledger file whole, or gives False where another writer has: never a part of it, never over another."""
        fs, jvm = self._fs(), self.spark.sparkContext._jvm
        final, temp = self._path("ledger", name), self._path("ledger", f".{uuid.uuid4().hex}.tmp")
        scheme = fs.getUri().getScheme()
        named = scheme in ("file", "hdfs", "viewfs")  # the content first, then its name, which is given once
        # an object store shows an object when it is closed, and refuses a second one of its name
        try:
            out = fs.create(temp if named else final, False)
            out.write(bytearray(text.encode()))
            out.close()
            if scheme == "file":
                os.link(urlparse(temp.toUri().toString()).path, urlparse(final.toUri().toString()).path)
            elif named:
                context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
                context.rename(temp, final, self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
            return True
        except Exception:
            if not fs.exists(final):
                raise
            return self._read(final) == text  # the answer may have been lost after the file was made
        finally:
            if named:
                fs.delete(temp, False)

    def load(self) -> Ledger:
        """Read the newest committed state."""
        fs, folder = self._fs(), self._path("ledger")
        names = sorted(n for x in (fs.listStatus(folder) if fs.exists(folder) else ()) if (n := x.getPath().getName()).endswith(".json") and n[0] != ".")
        if names:
            state = json.loads(self._read(self._path("ledger", names[-1])))
            self.batch, self.name, self.count, self.done = state["batch"], state["name"], state["count"], [tuple(x) for x in state["done"]]
        return self

    def intervals(self) -> DataFrame:
        """(lo, hi): everything that is processed."""
        if self.count > len(self.done):
            return self.spark.read.parquet(f"{self.root}/intervals/{self.name}")
        return self.spark.createDataFrame(self.done, "lo long, hi long")

    def pending(self, source: DataFrame) -> DataFrame:
        """The rows of source whose sequence number no committed interval covers: new ones and late ones.

        The longest intervals are a filter at the scan; only what that leaves meets the other ones.
        """
        covered = F.lit(False)
        for lo, hi in self.done:
            covered = covered | F.col(self.seq).between(lo, hi)
        rest = source.where(F.col(self.seq).isNotNull() & ~covered)
        if self.count == len(self.done):
            return rest
        return outside(rest, self.intervals().where(~F.col("lo").isin([lo for lo, _ in self.done])), self.seq)

    def process(self, source: DataFrame, transform: Callable[[DataFrame], DataFrame] = lambda rows: rows, tries: int = 8, before_commit: Callable[[], None] | None = None) -> int | None:
        """Process what is pending in source and commit it. Gives the number of the batch, or None if nothing was pending.

        transform makes the output of the rows taken; it may drop rows, whose numbers count as processed all the same.
        If another writer commits first, what is pending is worked out anew, `tries` times. before_commit is called when
        all is written but nothing committed, for checks that may still refuse the batch.
        """
        for _ in range(tries):
            self.load()
            name = f"{time.time_ns():020d}-{uuid.uuid4().hex[:12]}"
            staged = f"{self.root}/staged/{name}"
            try:
                self.pending(source).write.parquet(staged)
                taken = self.spark.read.schema(source.schema).parquet(staged)
                if taken.isEmpty():
                    return None
                return self._commit(name, transform(taken), taken.select(F.col(self.seq).alias("lo")), before_commit)
            except Conflict:
                continue
            finally:
                self._delete("staged", name)
        raise Conflict(f"{self.root}: {tries} times another writer committed first")

    def commit(self, output: DataFrame) -> int:
        """Commit output that was worked out from pending(), by the sequence numbers that it carries."""
        name = f"{time.time_ns():020d}-{uuid.uuid4().hex[:12]}"
        return self._commit(name, output, None)

    def _commit(self, name: str, output: DataFrame, numbers: DataFrame | None, before: Callable[[], None] | None = None) -> int:
        try:
            output.write.parquet(f"{self.root}/data/{name}")
            if numbers is None:  # of what was written, as output may be another when it is worked out again
                numbers = self.spark.read.schema(output.schema).parquet(f"{self.root}/data/{name}").select(F.col(self.seq).alias("lo"))
            points = numbers.where("lo is not null").select(F.col("lo").cast("long"), F.col("lo").cast("long").alias("hi"))
            whole = merged(self.intervals().unionByName(points), self.count + points.count())
            done = [(r["lo"], r["hi"]) for r in whole.limit(HEAD + 1).collect()]
            count = len(done)
            if count > HEAD:
                whole.write.parquet(f"{self.root}/intervals/{name}")
                kept = self.spark.read.parquet(f"{self.root}/intervals/{name}")
                count = kept.count()
                done = [(r["lo"], r["hi"]) for r in kept.orderBy((F.col("hi") - F.col("lo")).desc(), "lo").limit(HEAD).collect()]
            done, batch = sorted(done), self.batch + 1
            if before:
                before()
        except BaseException:
            self._drop(name)
            raise
        # an error from here on leaves open whether the batch is committed: clean() sees later what is named
        if not self._publish(f"{batch:020d}.json", json.dumps({"batch": batch, "name": name, "count": count, "done": done})):
            self._drop(name)
            raise Conflict(f"batch {batch} of {self.root} was committed by another writer")
        self.batch, self.name, self.count, self.done = batch, name, count, done
        return batch

    def committed(self) -> DataFrame:
        """(batch, name) of every committed batch, from its ledger file."""
        return self.spark.read.schema("batch long, name string").json(f"{self.root}/ledger")

    def output(self) -> DataFrame | None:
        """All committed output rows; None before the first commit."""
        if not self.batch:
            return None
        names = [r["name"] for r in self.committed().select("name").collect()]  # one a batch
        return self.spark.read.parquet(*[f"{self.root}/data/{n}" for n in sorted(names)])

    def clean(self, older_than_s: float = 7 * 86400) -> list[str]:
        """Delete folders of batches that died, which no ledger file names and which are older than any batch takes."""
        fs = self._fs()
        kept = {r["name"] for r in self.committed().select("name").collect()} if self.batch else set()
        gone = []
        for part in ("data", "intervals", "staged"):
            folder = self._path(part)
            for x in fs.listStatus(folder) if fs.exists(folder) else ():
                name = x.getPath().getName()
                # intervals of older states are superseded; a reader of them reads the state anew
                wanted = name == self.name if part == "intervals" else name in kept
                if not wanted and x.getModificationTime() / 1000 < time.time() - older_than_s:
                    self._delete(part, name)
                    gone.append(f"{part}/{name}")
        return gone


def replayed(source: DataFrame, at: str, runs: DataFrame, root: str, seq: str = "seq") -> DataFrame:
    """(run_id, seq): which successful run committed each row of an append-only source, by a ledger under root.

    The runs are taken in order. A run sees the rows whose `at` (unix seconds) is no later than its end, its start
    where it did not end, and processes all that no run before it has committed: new rows, late ones with smaller
    numbers, and those of runs that failed. A run that is not ok writes its output and dies before its commit. Runs
    are a table of a few rows.
    """
    ledger = Ledger(source.sparkSession, root, seq)

    def die() -> None:
        raise InterruptedError("this run died before its commit")

    for r in runs.where("run_id is not null").select("run_id", "status", F.unix_seconds(F.coalesce("finished_at", "started_at")).alias("end")).orderBy("run_id").collect():
        seen = source.where(F.col(at) <= F.lit(r["end"]).cast("long")).select(seq)
        try:
            ledger.process(seen, lambda rows, run=r["run_id"]: rows.select(F.lit(run).cast("int").alias("run_id"), seq), before_commit=None if r["status"] == "ok" else die)
        except InterruptedError:
            pass
    out = ledger.output()
    return out if out is not None else source.sparkSession.createDataFrame([], f"run_id int, {seq} long")
