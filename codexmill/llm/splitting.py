"""Splitting oversized texts at natural boundaries, with overlap.

Method: a regular expression with bounded quantifiers takes up to `step` characters at a time; its alternatives are
ordered by boundary strength (paragraph, line, sentence, clause, word) and the last one falls back to single
characters. Each piece then looks back for its overlap. All of it is built-in column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexmill.sources.tables import latest


def effective_options(opts: DataFrame, default: str = "default") -> DataFrame:
    """(collection, chars, step, min_chars), usable: null or not positive chars take those of the default collection.

    A step that is null, not positive or above chars means no overlap; min_chars is kept within 0 and chars.
    """
    d = opts.where(F.col("collection") == default).agg(F.max("chars").alias("d_chars"), F.max("step").alias("d_step"), F.max("min_chars").alias("d_min"))
    o = opts.where("collection is not null").groupBy("collection").agg(F.max(F.struct("chars", "step", "min_chars")).alias("m")).select("collection", "m.*")
    own = F.col("chars") > 0
    return _sane(o.crossJoin(F.broadcast(d)).select("collection", F.when(own, F.col("chars")).otherwise(F.col("d_chars")).alias("chars"), F.when(own, F.col("step")).otherwise(F.col("d_step")).alias("step"), F.when(own, F.col("min_chars")).otherwise(F.col("d_min")).alias("min_chars")))


def _sane(o: DataFrame) -> DataFrame:
    step = F.when((F.col("step") > 0) & (F.col("step") <= F.col("chars")), F.col("step")).otherwise(F.col("chars"))
    least = F.greatest(F.lit(0), F.least(F.coalesce("min_chars", F.lit(0)), "chars"))
    return o.select("collection", "chars", step.alias("step"), least.alias("min_chars"))


def boundary_pattern(step: Column) -> Column:
    """The regular expression for pieces of at most `step` characters, stronger boundaries first.

    Each alternative but the last must take at least half of the limit, so that a boundary early in the piece doesn't
    make it tiny; possessive alternatives would be cheaper but couldn't give a boundary back.
    """
    n, half = step.cast("string"), F.greatest(F.lit(1), F.floor(step / 2)).cast("string")
    # lengths count the boundary itself: up to two characters of it may follow, so they are within n - 2
    body = lambda end: F.concat(F.lit("[\\s\\S]{"), half, F.lit(","), F.greatest(half.cast("int"), step - 2).cast("string"), F.lit("}" + end))
    tail = F.concat(F.lit("[\\s\\S]{1,"), n, F.lit("}\\z"))
    small = F.concat(F.lit("[\\s\\S]{1,"), n, F.lit("}"))
    strong = F.concat_ws("|", tail, body("\\n\\n"), body("(?<=\\n)"), body("[.!?…] "), body("[,;:] "), body("(?<=\\s)"), small)
    return F.when(step < 8, small).otherwise(strong)


#: Pieces whose ends are added up together; keeps the running sum of a long text from copying itself.
SUMS = 256


def _ends(cuts: Column) -> Column:
    """Running ends of the pieces: sums within blocks of SUMS pieces, then of the blocks."""
    last = lambda xs: F.coalesce(F.try_element_at(xs, F.lit(-1)), F.lit(0))
    run = lambda xs: F.aggregate(xs, F.array().cast("array<int>"), lambda acc, n: F.concat(acc, F.array(last(acc) + n)))
    sizes = F.transform(cuts, lambda s: F.length(s))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(cuts) - 1) / SUMS).cast("int")), lambda b: run(F.slice(sizes, b * SUMS + 1, F.lit(SUMS))))
    bases = F.slice(F.concat(F.array(F.lit(0)), run(F.transform(blocks, last))), F.lit(1), F.size(blocks))
    return F.flatten(F.zip_with(blocks, bases, lambda xs, base: F.transform(xs, lambda x: x + base)))


def _pieces(text: DataFrame) -> DataFrame:
    """text with cuts (the pieces without their overlap), their ends, and p, the pieces; needs chars, step, min_chars.

    Every cut is worked on with the few cuts before it that its overlap can reach, never from the start of the text.
    """
    cut = text.withColumn("cuts", F.regexp_extract_all("text", boundary_pattern(F.col("step")), F.lit(0))).drop("text").where(F.size("cuts") > 0)
    cut = cut.withColumn("ends", _ends(F.col("cuts")))
    want = F.col("chars") - F.col("step")
    # every cut but the last takes at least half a step, so this many hold `chars` characters
    reach = (F.ceil(F.col("chars") / F.greatest(F.lit(1), F.floor(F.col("step") / 2))) + 1).cast("int")

    # each step is a list of its own, so that nothing is worked out twice
    def look_back(body: Column, i: Column) -> Column:
        size, end = F.length(body), F.get("ends", i)
        # the lookback: the overlap, more of it where the piece would be under min_chars, never beyond chars or the start
        back = F.when(i == 0, F.lit(0)).otherwise(F.least(end - size, F.greatest(want, F.col("min_chars") - size), F.col("chars") - size))
        return F.struct(body.alias("body"), size.alias("size"), end.alias("end"), back.alias("back"))

    def see(x: Column, i: Column) -> Column:
        before = F.array_join(F.slice("cuts", F.greatest(i - reach + 1, F.lit(1)), F.least(reach, i)), "")
        return F.struct(*[x[c].alias(c) for c in ("body", "size", "end", "back")], F.when(x["back"] > 0, F.right(before, x["back"])).otherwise("").alias("seen"))

    def begin(x: Column) -> Column:
        # it starts at a word unless that would take most of it, or the piece under min_chars
        skip = F.length(F.regexp_extract(x["seen"], "^\\S*\\s+", 0))
        return F.struct(*[x[c].alias(c) for c in ("body", "size", "end", "back", "seen")], skip.alias("skip"))

    def piece(x: Column, i: Column) -> Column:
        left = x["end"] - x["size"] - x["back"]
        skip = F.when((x["skip"] * 2 <= x["back"]) & (x["size"] + x["back"] - x["skip"] >= F.col("min_chars")) & (left > 0), x["skip"]).otherwise(F.lit(0))
        return F.struct(i.cast("int").alias("piece_no"), (left + skip).cast("int").alias("start"), F.concat(F.substring(x["seen"], skip + 1, x["back"]), x["body"]).alias("text"))

    steps = F.transform(F.transform(F.transform("cuts", look_back), see), begin)
    return cut.withColumn("p", F.explode(F.transform(steps, piece)))


def current_sizes(chunks: DataFrame, opts: DataFrame, default: str = "default") -> DataFrame:
    """Current chunks longer than the chars of their collection, with these options; the text is measured as stored."""
    kept = chunks.select("chunk_id", "collection", "text", "written_at")
    o = effective_options(opts, default).withColumn("__c", F.col("collection")).drop("collection")
    # the few rows that could matter are found before the shuffle: a chunk whose every row is short needs no text
    d = effective_options(opts, default).where(F.col("collection") == default).select(*[F.col(c).alias(f"d_{c}") for c in ("chars", "step", "min_chars")])
    sized = kept.join(F.broadcast(o), F.col("collection") == F.col("__c"), "left").join(F.broadcast(d), F.lit(True), "left")
    sized = sized.select("chunk_id", "written_at", "text", *[F.coalesce(F.col(c), F.col(f"d_{c}")).alias(c) for c in ("chars", "step", "min_chars")])
    long = F.length("text") > F.col("chars")
    narrow = sized.withColumn("text", F.when(long, F.col("text")))
    return latest(narrow, ["chunk_id"], "written_at", "text").where("text is not null").select("chunk_id", "text", "chars", "step", "min_chars")


def split_oversized(chunks: DataFrame, opts: DataFrame, default: str = "default") -> DataFrame:
    """(chunk_id, piece_no, start, text, chars): the pieces of every current chunk longer than its collection allows.

    Pieces are at most chars characters (Unicode code points), none but a first is shorter than min_chars, neighbours
    share about chars - step characters, and the pieces without their overlap are the whole text in order. Null and
    short texts give no pieces, nor do null chunk_id; repeated rows count once; collections without options take those
    of the default collection, and where that is missing too, nothing is oversized. chunk_opts is a configuration
    table of one row per collection.
    """
    return _pieces(current_sizes(chunks, opts, default)).select("chunk_id", "p.piece_no", "p.start", "p.text", "chars")
