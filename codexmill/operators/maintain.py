"""The registry of a collection and its upkeep: last line wins, sync with disk, tombstones, compaction, reports.

Tables are versions: a directory <root>/v=<n> of Parquet tables and a pointer file that names the current one, so a
rewrite is seen whole or not at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codexmill.functions import text as T
from codexmill.sources.tables import latest

DEAD_PERCENT, SEGMENTS = 20, 8


def registry(books: DataFrame) -> DataFrame:
    """The current line of every path: the one with the highest seq."""
    return latest(books, ["path"], "seq")


def survivors(books: DataFrame, deleted: DataFrame) -> DataFrame:
    """Current lines of documents without a tombstone."""
    return registry(books).join(deleted.select("id").distinct(), "id", "left_anti")


def pending(books: DataFrame, disk: DataFrame) -> DataFrame:
    """(path, change): `new`, `changed` or `missing`, comparing current lines with (path, size, mtime) on disk.

    A path listed more than once on disk counts once, with its largest (mtime, size). Known failures that haven't
    changed are no change.
    """
    there = disk.where("path is not null").groupBy("path").agg(F.max(F.struct("mtime", "size")).alias("d"))
    known = registry(books).select("path", F.struct("mtime", "size").alias("k"))
    both = there.join(known, "path", "full_outer")
    change = F.when(F.col("k").isNull(), "new").when(F.col("d").isNull(), "missing").when(~F.col("d.size").eqNullSafe(F.col("k.size")) | ~F.col("d.mtime").eqNullSafe(F.col("k.mtime")), "changed")
    return both.select("path", change.alias("change")).where("change is not null")


def top_folder(path: Column, roots: list[str]) -> Column:
    """The first folder below the first root that holds the path, `.` for the root itself, else its parent folder."""
    out = F.element_at(F.split(path, "/"), -2)
    for root in reversed(roots):
        r = root.rstrip("/") + "/"
        rest = F.substring(path, F.lit(len(r) + 1), F.length(path))
        out = F.when(path.startswith(r), F.when(rest.contains("/"), F.element_at(F.split(rest, "/"), 1)).otherwise(".")).otherwise(out)
    return out


def breakdown(books: DataFrame, roots: list[str]) -> DataFrame:
    """(folder, books, chunks, failed) of current lines; most books first."""
    by = registry(books).withColumn("folder", top_folder(F.col("path"), roots)).groupBy("folder")
    return by.agg(F.count("*").alias("books"), F.coalesce(F.sum("chunks"), F.lit(0)).cast("long").alias("chunks"), F.count_if(F.col("kind") != "ok").alias("failed"))


def folder_report(folders: DataFrame, most: int = 12) -> DataFrame:
    """The largest folders, the rest summed up as one row with rank most + 1."""
    head = folders.orderBy(F.col("books").desc(), "folder").limit(most)
    w = Window.orderBy(F.col("books").desc(), "folder")  # over `most` rows
    named = head.withColumn("rank", F.row_number().over(w)).select("rank", "folder", F.lit(1).cast("long").alias("folders"), "books", "chunks")
    # those behind the last of the head, without a rank for each
    last = head.orderBy("books", F.col("folder").desc()).limit(1).select(F.col("books").alias("__b"), F.col("folder").alias("__f"))
    behind = (F.col("books") < F.col("__b")) | ((F.col("books") == F.col("__b")) & (F.col("folder") > F.col("__f")))
    rest = folders.crossJoin(F.broadcast(last)).where(behind).agg(F.count("*").alias("folders"), F.sum("books").alias("books"), F.sum("chunks").alias("chunks")).where("folders > 0")
    return named.unionAll(rest.select(F.lit(most + 1).alias("rank"), F.lit("(rest)").alias("folder"), "folders", "books", "chunks"))


def stats(books: DataFrame, chunks: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    """One row: documents by kind, chunks and bytes of text, chunks covered by vectors of the model, percent covered."""
    b = registry(books).agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("ok", "scan", "garbled", "broken", "gone", "skipped")])
    c = chunks.groupBy("chunk_id").agg(F.max_by(F.octet_length("text"), F.col("written_at")).alias("n"))
    v = vectors.where((F.col("model") == model) & F.col("q").isNotNull()).select("chunk_id").distinct().withColumn("covered", F.lit(1))
    c = c.join(v, "chunk_id", "left").agg(F.count("*").alias("chunks"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("bytes"), F.count("covered").alias("covered"))
    percent = F.when(F.col("chunks") > 0, F.floor(F.col("covered") * 100 / F.col("chunks"))).otherwise(0)
    return b.crossJoin(c).withColumn("percent", percent)


def doctor(books: DataFrame) -> DataFrame:
    """(check, n): what is wrong with a collection: kinds of failed documents and titles held more than once."""
    r = registry(books)
    kinds = r.where("kind <> 'ok'").groupBy(F.col("kind").alias("check")).agg(F.count("*").alias("n"))
    titles = r.select(T.normal_title(F.col("title")).alias("t")).where("t <> ''").groupBy("t").agg(F.count("*").alias("n")).where("n > 1")
    return kinds.unionAll(titles.agg(F.lit("titles held twice").alias("check"), F.count("*").alias("n")))


def title_duplicates(books: DataFrame) -> DataFrame:
    """(title, books, ids): current documents whose titles agree in letters; ids in order."""
    r = registry(books).select("id", T.normal_title(F.col("title")).alias("t")).where("t <> ''")
    return r.groupBy(F.col("t").alias("title")).agg(F.count("*").alias("books"), F.min("id").alias("first_id"), F.max("id").alias("last_id")).where("books > 1")


def needs_merge(total: int, dead: int, segments: int) -> str | None:
    """Why a collection should be compacted; None if it needn't."""
    if total and dead * 100 // total >= DEAD_PERCENT:
        return f"{dead * 100 // total}% of chunks are dead"
    return f"{segments} segments" if segments >= SEGMENTS else None


def live_chunks(chunks: DataFrame, deleted: DataFrame) -> DataFrame:
    """Chunks of documents without a tombstone (doc_id); a repeated tombstone counts once."""
    return chunks.join(deleted.select("doc_id").distinct(), "doc_id", "left_anti")


def carried_vectors(vectors: DataFrame, chunks: DataFrame) -> DataFrame:
    """Vectors of chunks that are still there, by their lasting id."""
    return vectors.join(chunks.select("chunk_id").distinct(), "chunk_id", "left_semi")


def uncovered(chunks: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    """Chunks without a vector of the model: what a resumed embedding still has to do."""
    return chunks.join(vectors.where(F.col("model") == model).select("chunk_id").distinct(), "chunk_id", "left_anti")


class Collection:
    """A versioned collection of tables under one directory."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        return jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def version(self) -> int:
        """The current version; 0 for a new collection. Directories that no pointer names are leftovers."""
        fs, path = self._fs()
        if not fs.exists(path(f"{self.root}/current")):
            return 0
        return max((int(x.getPath().getName()) for x in fs.listStatus(path(f"{self.root}/current")) if x.getPath().getName().isdigit()), default=0)

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/v={self.version()}/{table}")

    def publish(self, **tables: DataFrame) -> int:
        """Write all tables as the next version, then point to it."""
        v = self.version() + 1
        for name, df in tables.items():
            df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.root}/v={v}/{name}")
        fs, path = self._fs()
        fs.mkdirs(path(f"{self.root}/current"))
        fs.create(path(f"{self.root}/current/{v}"), True).close()
        return v

    def compact(self, deleted: DataFrame) -> int:
        """Publish the collection without the chunks, postings and vectors of deleted documents; ids stay."""
        chunks = live_chunks(self.read("chunks"), deleted)
        tables = {"chunks": chunks, "postings": self.read("postings").join(chunks.select("chunk_id"), "chunk_id", "left_semi").repartitionByRange("term").sortWithinPartitions("term", "chunk_id")}
        tables["vectors"] = carried_vectors(self.read("vectors"), chunks)
        return self.publish(**tables)

    def drop(self) -> None:
        fs, path = self._fs()
        fs.delete(path(self.root), True)


def books_matching(books: DataFrame, wanted: DataFrame) -> DataFrame:
    """(want, id): current good books whose title, author or path holds `want`, in any case.

    wanted: want, the texts that are asked for, a table of a few rows.
    """
    current = registry(books).where("kind = 'ok'")
    hay = F.lower(F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("author", F.lit("")), F.coalesce("path", F.lit(""))))
    asked = wanted.select("want").where("want is not null").distinct()
    return current.select("id", hay.alias("hay")).join(asked, F.col("hay").contains(F.lower("want"))).select("want", "id")


def books_named(books: DataFrame, wanted: DataFrame) -> DataFrame:
    """(want, id): the first current book whose path, or whose file name, is `want`; what forgetting a book by name deletes."""
    current = registry(books).where("kind <> 'gone'").select("id", "path")
    both = current.select("id", F.explode(F.array_distinct(F.array("path", F.element_at(F.split("path", "/"), -1)))).alias("want"))
    return both.join(wanted.select("want").distinct(), "want").groupBy("want").agg(F.min("id").alias("id"))
