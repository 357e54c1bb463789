"""Records in JSON and TOML: tolerant line files, saved sessions, task suites, and their checks."""

from __future__ import annotations

import tomllib
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BOOK = "seq long, id long, path string, size long, mtime long, kind string, title string, author string, format string, units int, unit_word string, chunks int, err string, at_sec long"
SESSION = "id string, saved_at timestamp, server string, model string, system string, messages array<struct<role:string,content:string,thinking:string,tool_calls:array<struct<id:string,name:string,arguments:map<string,string>>>>>"
TASK = "suite string, id string, level int, prompt string, scores array<double>, needs array<string>"


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a file of JSON lines; lines that are no record are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Saved sessions of a folder, one JSON document a file, newest first; unreadable ones are left out."""
    s = spark.read.schema(SESSION).option("multiLine", True).option("mode", "DROPMALFORMED").json(folder)
    return s.where("id is not null").orderBy(F.col("saved_at").desc(), "id")


def session(all_: DataFrame, id_: str = "") -> DataFrame:
    """One session by id; the newest one for an empty id."""
    return all_.where(F.col("id") == id_) if id_ else all_.orderBy(F.col("saved_at").desc(), "id").limit(1)


def save_sessions(messages: DataFrame, conv: str, seq: str, folder: str) -> None:
    """Messages as one JSON line per conversation, in order."""
    m = F.transform(F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), "role", "content"))), lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    messages.groupBy(F.col(conv).cast("string").alias("id")).agg(m.alias("messages")).write.mode("overwrite").json(folder)


def suites(spark: SparkSession, folder: str, names: list[str] | None = None) -> DataFrame:
    """Tasks of all suites (TOML files on the driver: configuration), of some by name."""
    rows = []
    for f in sorted(Path(folder).glob("*.toml")):
        data = tomllib.loads(f.read_text())
        if names is None or data.get("name", f.stem) in names:
            rows += [(data.get("name", f.stem), t.get("id"), t.get("level", 1), t.get("prompt"), [float(x) for x in t.get("scores", [])], t.get("needs", [])) for t in data.get("tasks", [])]
    return spark.createDataFrame(rows, TASK)


def suite_problems(tasks: DataFrame) -> DataFrame:
    """(suite, id, problem): tasks without id or prompt, repeated ids, positive scores that don't add up to 1."""
    good = F.aggregate(F.filter("scores", lambda x: x > 0), F.lit(0.0), lambda a, x: a + x)
    one = F.when(F.coalesce(F.trim("id"), F.lit("")) == "", "no id").when(F.coalesce(F.trim("prompt"), F.lit("")) == "", "no prompt").when((F.size("scores") > 0) & (F.abs(good - 1) > 0.001), "scores don't add up")
    own = tasks.select("suite", "id", one.alias("problem")).where("problem is not null")
    twice = tasks.where("id is not null").groupBy("suite", "id").agg(F.count("*").alias("n")).where("n > 1").select("suite", "id", F.lit("repeated id").alias("problem"))
    return own.unionAll(twice)


def eligible(models: DataFrame, exclude: list[str], only: list[str] | None = None) -> DataFrame:
    """Models (name, capabilities) with skipped, the first reason against each, empty if none; rows are kept."""
    skipped = F.when(F.col("name").isin(exclude), "excluded").when(~F.array_contains("capabilities", "completion"), "no completion")
    if only:
        skipped = skipped.when(~F.col("name").isin(only), "not asked for")
    return models.withColumn("skipped", F.coalesce(skipped, F.lit("")))


def missing_capability(capabilities: Column, needs: Column) -> Column:
    """The first need that isn't offered; null if all are."""
    return F.get(F.array_except(needs, capabilities), F.lit(0))
