"""Conversation history as rows (conv, seq, role, content): turns, answers, compaction, visible spans, rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codexmill.functions.text import glob_regex


def turns(messages: DataFrame, conv: str, seq: str) -> DataFrame:
    """Messages with turn, counted up by each user message; what comes before the first one is turn 0."""
    w = Window.partitionBy(conv).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    return messages.withColumn("turn", F.sum((F.col("role") == "user").cast("long")).over(w))


def answers(messages: DataFrame, conv: str, seq: str, glue: str = "\n\n") -> DataFrame:
    """(conv, turn, parts, answer): what is not blank of a turn's assistant messages, in order."""
    said = turns(messages, conv, seq).where((F.col("role") == "assistant") & (F.trim("content") != ""))
    parts = F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), F.col("content").alias("c"))))
    return said.groupBy(conv, "turn").agg(F.count("*").alias("parts"), F.array_join(F.transform(parts, lambda x: x["c"]), glue).alias("answer"))


def compact(messages: DataFrame, conv: str, seq: str, keep: int) -> DataFrame:
    """The last `keep` messages of each conversation, and those before them as long as the first kept one is a tool
    reply; none for keep <= 0."""
    if keep <= 0:
        return messages.limit(0)
    back = Window.partitionBy(conv).orderBy(F.col(seq).desc())
    r = messages.withColumn("__r", F.row_number().over(back))
    # the cut moves back to the last message at or before it that is no tool reply
    anchor = F.min(F.when((F.col("__r") >= keep) & (F.col("role") != "tool"), F.col("__r"))).over(Window.partitionBy(conv))
    return r.withColumn("__a", F.coalesce(anchor, F.max("__r").over(Window.partitionBy(conv)))).where("__r <= __a").drop("__r", "__a")


def char_totals(messages: DataFrame, conv: str) -> DataFrame:
    """(conv, messages, bytes) of content."""
    return messages.groupBy(conv).agg(F.count("*").alias("messages"), F.sum(F.octet_length("content")).cast("long").alias("bytes"))


def layout(blocks: DataFrame, conv: str, seq: str, lines: Column) -> DataFrame:
    """Blocks with first_line: running offsets with one line between blocks; blocks without lines take none."""
    w = Window.partitionBy(conv).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    b = blocks.withColumn("lines", lines).where("lines > 0")
    return b.withColumn("first_line", F.coalesce(F.sum(F.col("lines") + 1).over(w), F.lit(0)).cast("long"))


def visible(blocks: DataFrame, conv: str, seq: str, offset: int, height: int, role: str = "assistant") -> DataFrame:
    """(conv, seq, seen): the block of a role of which most lines lie in the window; the later one of equals."""
    seen = F.greatest(F.lit(0), F.least(F.col("first_line") + F.col("lines"), F.lit(offset + height)) - F.greatest(F.col("first_line"), F.lit(offset)))
    b = blocks.withColumn("seen", seen.cast("long")).where((F.col("seen") > 0) & (F.col("role") == role))
    w = Window.partitionBy(conv).orderBy(F.col("seen").desc(), F.col(seq).desc())
    return b.withColumn("r", F.row_number().over(w)).where("r = 1").select(conv, seq, "seen")


def difference(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, change): `added` or `removed`; nothing where there was no earlier list."""
    a, b = before.select(key).distinct(), after.select(key).distinct()
    some = a.agg((F.count("*") > 0).alias("some"))
    both = b.join(a, key, "left_anti").withColumn("change", F.lit("added")).unionAll(a.join(b, key, "left_anti").withColumn("change", F.lit("removed")))
    return both.crossJoin(F.broadcast(some)).where("some").select(key, "change")


def decisions(requests: DataFrame, rules: list[tuple[str, str, str]], column: str = "target") -> DataFrame:
    """Requests with decision: rules (decision, kind glob or prefix, pattern) are tried deny first, then allow, then
    ask; a request that no rule matches asks. Rules are configuration: a literal list, compiled to expressions."""
    out = F.lit("ask")
    for wanted in ("ask", "allow", "deny"):
        hit = F.lit(False)
        for decision, kind, pattern in rules:
            if decision == wanted:
                match = F.col(column).rlike(glob_regex(pattern)) if kind == "glob" else F.col(column).startswith(pattern)
                hit = hit | F.coalesce(match, F.lit(False))
        out = F.when(hit, wanted).otherwise(out)
    return requests.withColumn("decision", out)
