"""Pages of documents to chunks: furniture by repetition and page numbers, pieces, packing with overlap.

units: (doc_id, unit_no, text), one row per page or section. The relational parts are expressions and windows; the
fold into overlapping chunks follows the order of a document, as each chunk depends on where the last one ended.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codexmill.functions import text as T

#: A running header is no longer than this.
HEAD_LINE = 90
# Abbreviations whose full stop ends no sentence.
ABBREVIATIONS = frozenset(("т.д", "т.п", "т.е", "рис", "табл", "гл", "см", "стр", "др", "fig", "eq", "ex", "vs", "etc", "e.g", "i.e", "no", "vol", "ch"))


@dataclass(frozen=True)
class ChunkOptions:
    chars: int = 1200
    step: int = 900
    min_chars: int = 200


def lines(units: DataFrame) -> DataFrame:
    """(doc_id, unit_no, line_no, lines, line, edge): edge lines are the first two and the last two of a unit."""
    split = units.select("doc_id", "unit_no", F.split("text", "\n").alias("ls"))
    out = split.select("doc_id", "unit_no", F.size("ls").alias("lines"), F.posexplode("ls").alias("line_no", "line"))
    return out.withColumn("edge", (F.col("line_no") < 2) | (F.col("line_no") >= F.col("lines") - 2))


def repeated_lines(units: DataFrame) -> DataFrame:
    """(doc_id, line, units): edge lines, without digits and case, on at least 4 and a twentieth of a document's units.

    Documents of fewer than five units have none.
    """
    pages = units.groupBy("doc_id").agg(F.count("*").alias("pages")).where("pages >= 5")
    edge = lines(units).where("edge").withColumn("raw", F.trim(F.regexp_replace("line", r"^\s+|\s+$", ""))).where(F.length("raw") <= HEAD_LINE)
    counted = edge.select("doc_id", "unit_no", T.normal_line(F.col("raw")).alias("line")).where("line <> ''").distinct().groupBy("doc_id", "line").agg(F.count("*").alias("units"))
    return counted.join(pages, "doc_id").where(F.col("units") >= F.greatest(F.lit(4), F.floor(F.col("pages") / 20))).select("doc_id", "line", "units")


def page_offsets(units: DataFrame) -> DataFrame:
    """(doc_id, offset, votes): printed minus counted page number, voted by numbers at the ends of edge lines.

    At least ten units, and a quarter of them in favour; ties go to the smaller offset.
    """
    pages = units.groupBy("doc_id").agg(F.count("*").alias("pages")).where("pages >= 10")
    raw = F.trim(F.regexp_replace("line", r"\s+", " "))
    edge = lines(units).where("edge").select("doc_id", "unit_no", raw.alias("raw")).where("raw <> ''").where(F.length("raw") <= HEAD_LINE)
    fields = F.split("raw", " ")
    numbers = edge.select("doc_id", "unit_no", F.explode(F.array(F.element_at(fields, 1), F.element_at(fields, -1))).alias("f")).where(F.col("f").rlike("^[0-9]{1,4}$")).withColumn("n", F.col("f").cast("int")).where("n > 0")
    votes = numbers.groupBy("doc_id", (F.col("n") - F.col("unit_no")).alias("offset")).agg(F.count("*").alias("votes"))
    w = Window.partitionBy("doc_id").orderBy(F.col("votes").desc(), F.col("offset"))
    best = votes.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")
    return best.join(pages, "doc_id").where("votes * 4 >= pages").select("doc_id", "offset", "votes")


def toc_units(units: DataFrame) -> DataFrame:
    """(doc_id, unit_no, toc_lines): units with at least five lines of dots and a number are tables of contents."""
    n = F.size(F.filter(F.split("text", "\n"), lambda x: x.rlike(T.TOC_LINE)))
    return units.select("doc_id", "unit_no", n.alias("toc_lines")).where("toc_lines >= 5")


def sentences(text: str) -> list[str]:
    """Sentences end at . ! ? or … before white space and a capital or digit, but not after an abbreviation or initial."""
    out, start = [], 0
    for m in re.finditer(r"[.!?…](?=\s)\s+", text):
        nxt = text[m.end() : m.end() + 1]
        if nxt and not (nxt.isupper() or nxt.isdigit()):
            continue
        word = re.split(r"\s", text[: m.start()])[-1].rstrip(".").lower()
        if word in ABBREVIATIONS or (len(word) == 1 and word.isalpha()):
            continue
        out.append(text[start : m.end()].strip())
        start = m.end()
    rest = text[start:].strip()
    return [*out, rest] if rest else out


def _worth(text: str) -> bool:
    solid = [c for c in text if not c.isspace()]
    return len(solid) >= 12 and 3 * sum(c.isalpha() for c in solid) >= len(solid)


def _line_flags(line: str) -> int:
    bare = line.lstrip(" \t")
    signs = sum(bare.count(c) for c in "{};()=<>/*[]")
    code = bare != "" and (bare.startswith(T.CODE_STARTS) or (len(line) - len(bare) >= 2 and signs * 8 >= len(bare)))
    return (T.TABLE if " | " in line else 0) | (T.CODE if code else 0)


def _lang(text: str) -> int:
    return (T.RU if re.search("[а-яА-ЯёЁ]", text) else 0) | (T.EN if re.search("[a-zA-Z]", text) else 0)


Piece = tuple[str, int, int]  # text, unit, flags


def _pieces(kept: Iterable[tuple[int, str]], o: ChunkOptions) -> Iterator[Piece]:
    """Kept lines as paragraphs: blank lines, new units and turns between prose and code part them."""
    held: list[str] = []
    at, flags = 0, 0
    for unit, line in kept:
        f = _line_flags(line)
        blank = not line.strip()
        if held and (blank or unit != at or (flags ^ f) & T.CODE):
            yield from _cut("\n".join(held).strip(), at, flags, o)
            held, flags = [], 0
        if not blank:
            held.append(line)
            at, flags = unit, flags | f
    if held:
        yield from _cut("\n".join(held).strip(), at, flags, o)


def _cut(text: str, unit: int, flags: int, o: ChunkOptions) -> Iterator[Piece]:
    """A paragraph, if it is worth it; one of more than twice the size by lines (code, tables) or sentences."""
    if not _worth(text):
        return
    flags |= _lang(text)
    if len(text) <= 2 * o.chars:
        yield text, unit, flags
        return
    lined = flags & (T.CODE | T.TABLE)
    part: list[str] = []
    for s in [*(text.split("\n") if lined else sentences(text)), None]:
        if part and (s is None or sum(map(len, part)) + len(s) > o.chars):
            whole = ("\n" if lined else " ").join(part).strip()
            if _worth(whole):
                yield whole, unit, flags
            part = []
        if s is not None:
            part.append(s)


def _chunks(pieces: Iterable[Piece], o: ChunkOptions) -> Iterator[tuple[str, int, int, int]]:
    """(text, first unit, last unit, flags): pieces packed up to chars, each chunk taking up the tail of the last.

    Only the pieces of the chunk being filled are held, so a document may be of any length.
    """
    held: list[Piece] = []
    some = False

    def give() -> Iterator[tuple[str, int, int, int]]:
        nonlocal some
        if sum(len(p[0]) for p in held) >= o.min_chars or not some:
            some = True
            flags = 0
            for p in held:
                flags |= p[2]
            yield "\n\n".join(p[0] for p in held), held[0][1], held[-1][1], flags
        again, back = len(held), 0
        if o.chars > o.step:
            for k in range(len(held) - 1, 0, -1):
                back += len(held[k][0])
                if back >= o.chars - o.step:
                    again = k
                    break
        del held[:again]

    for p in pieces:
        while held and sum(len(x[0]) for x in held) + len(p[0]) > o.chars:
            yield from give()
        held.append(p)
    while held:
        yield from give()


def chunk(units: DataFrame, options: ChunkOptions = ChunkOptions()) -> DataFrame:
    """(doc_id, ord, unit_from, unit_to, flags, text): the chunks of every document.

    Running headers, contents and page numbers go first, as joins; what is left of a document streams
    through a task in order, which holds no more than a unit and a chunk of it. Null texts count as empty units; documents without a worthwhile line have no chunks.
    """
    all_lines = lines(units.withColumn("text", F.coalesce("text", F.lit(""))))
    normal = T.normal_line(F.trim(F.regexp_replace("line", r"^\s+|\s+$", "")))
    drop = repeated_lines(units).select("doc_id", F.col("line").alias("norm"))
    offs = page_offsets(units).select("doc_id", "offset")
    raw = F.trim(F.regexp_replace("line", r"\s+", " "))
    fields = F.split(raw, " ")
    printed = (F.col("unit_no") + F.col("offset")).cast("string")
    number = F.col("edge") & (F.col("unit_no") + F.col("offset") > 0) & (F.length(raw) <= HEAD_LINE) & ((F.element_at(fields, 1) == printed) | (F.element_at(fields, -1) == printed))
    kept = all_lines.withColumn("norm", normal).join(toc_units(units).select("doc_id", "unit_no"), ["doc_id", "unit_no"], "left_anti").join(drop.withColumn("head", F.lit(True)), ["doc_id", "norm"], "left").join(offs, "doc_id", "left")
    kept = kept.where(~(F.coalesce("head", F.lit(False)) & (F.trim("line") != ""))).where(~F.coalesce(number, F.lit(False))).where(~F.col("line").rlike(T.TOC_LINE))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (r for b in batches for r in zip(b["doc_id"], b["unit_no"], b["line"], strict=True))
        out = []
        for doc, of_doc in groupby(rows, key=itemgetter(0)):
            for k, (t, a, b, f) in enumerate(_chunks(_pieces(((u, x) for _, u, x in of_doc), options), options)):
                out.append((doc, k, a, b, f, t))
                if len(out) >= 1000:
                    yield pd.DataFrame(out, columns=["doc_id", "ord", "unit_from", "unit_to", "flags", "text"])
                    out = []
        if out:
            yield pd.DataFrame(out, columns=["doc_id", "ord", "unit_from", "unit_to", "flags", "text"])

    ordered = kept.select("doc_id", "unit_no", "line_no", "line").repartition("doc_id").sortWithinPartitions("doc_id", "unit_no", "line_no")
    return ordered.mapInPandas(fold, "doc_id long, ord int, unit_from int, unit_to int, flags int, text string")
