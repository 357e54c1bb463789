"""Bringing text that looks the same to one form of characters.

Method: compatibility normalisation in composed form, mapped white space, removal of default-ignorable characters and
one script for look-alike letters, worked out once per distinct value of a batch. Two departures, since texts that a
reader can tell apart must stay different: compatibility mapping applies to full-width and half-width forms only (a
circled one is no 1), and case is folded only on request (`fold`). A zero-width joiner between pictographs stays, as
without it other pictures are seen.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codexmill.session import written

# Letters that look like a Latin letter, pairwise in order. They apply to decomposed text.
CYRILLIC, CYRILLIC_AS = "аеорсухіѕјһԁԛԝӏАВЕКМНОРСТУХІЅЈԌԚԜӀ", "aeopcyxisjhdqwlABEKMHOPCTYXISJGQWI"
GREEK, GREEK_AS = "ονρϲϳΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ovpcjABEZHIKMNOPTYX"
# Spaces that don't break; default-ignorable characters but joiners and selectors; pictographs.
HARD_SPACES = "   "
IGNORABLE = "­͏؜ᅟᅠ឴឵᠋-᠏​‌‎‏‪-‮⁠-⁯ㅤ︀-︎﻿ﾠ\U000e0000-\U000e0fff"
PICTURE = "←-⯿\U0001f000-\U0001faff"

_table = {ord(a): b for a, b in [*zip(CYRILLIC, CYRILLIC_AS, strict=True), *zip(GREEK, GREEK_AS, strict=True)]} | {ord(c): " " for c in HARD_SPACES}
_wide = {c: unicodedata.normalize("NFKC", chr(c)) for c in range(0xFF01, 0xFFEF) if unicodedata.category(chr(c)) != "Cn" and c != 0xFFA0} | {0x3000: " "}
_any_wide = re.compile("[　！-￯]")
# a joiner or selector outside a picture goes as well
_ignored = re.compile(f"[{IGNORABLE}]|(?<![{PICTURE}️])‍|‍(?![{PICTURE}])|(?<![{PICTURE}])️")


def one_form(text: str | None, fold: bool = False) -> str | None:
    """The form that two texts share if they look the same; null stays null."""
    if text is None:
        return None
    if not text.isascii():
        t = text.translate(_wide) if _any_wide.search(text) else text
        t = unicodedata.normalize("NFD", _ignored.sub("", t) if _ignored.search(t) else t)  # marks may have been kept apart
        text = unicodedata.normalize("NFC", t.translate(_table))
    return text.casefold() if fold else text


#: Marks characters whose form is not one character or depends on their neighbours.
_OTHER = 0xFFFFFFFF


@cache
def _singles() -> np.ndarray:
    """By code point the form of a character that depends on no neighbour (letters, digits, punctuation), else _OTHER."""
    table = np.full(0x110000, _OTHER, np.uint32)
    table[:0x80] = np.arange(0x80)
    for begin, end in ((0x80, 0x250), (0x370, 0x530), (0x2010, 0x2028), (0x2030, 0x2060), (0x20A0, 0x20C1), (0x2100, 0x2150)):
        for c in map(chr, range(begin, end)):
            if unicodedata.category(c) not in ("Mn", "Mc", "Me", "Cf", "Cn", "Cc") and len(form := one_form(c)) == 1:
                table[ord(c)] = ord(form)
    return table


def forms(texts: list[str]) -> list[str]:
    """one_form() of many texts: those of ordinary characters by one table at once, the others one by one."""
    end = np.cumsum([len(x) for x in texts], dtype=np.int64)
    codes = _singles()[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)]
    other = np.flatnonzero(codes == _OTHER)
    codes[other] = 0
    joined = codes.tobytes().decode("utf-32-le", "surrogatepass")
    out = [joined[i:j] for i, j in zip(np.concatenate(([0], end[:-1])).tolist(), end.tolist(), strict=True)] if texts else []
    for k in np.unique(np.searchsorted(end, other, "right")).tolist():
        out[k] = one_form(texts[k])
    return out


def _forms(batches: Iterator[pa.RecordBatch], column: str, fold: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = batch.column(column).dictionary_encode()
        form = forms(got.dictionary.to_pylist())
        yield batch.append_column("form", pc.take(pa.array([x.casefold() for x in form] if fold else form, pa.string()), got.indices))


def with_form(df: DataFrame, column: str = "text", fold: bool = False) -> DataFrame:
    """df with a column form, the one form of its text. Null and empty texts stay as they are; other columns are kept.

    A column of that name is replaced.
    """
    df = df.drop("form")
    return df.mapInArrow(lambda it: _forms(it, column, fold), T.StructType([*df.schema.fields, T.StructField("form", T.StringType())]))


def _keyed(documents: DataFrame) -> DataFrame:
    """Two 64-bit hashes of the form and of the text as stored; nothing of documents without a letter or digit."""
    some = documents.select("doc_id", "text").where("doc_id is not null and text is not null")
    hashed = with_form(some).where(F.col("form").rlike("[\\p{L}\\p{Nd}]"))
    keyed = hashed.select("doc_id", F.xxhash64("form").alias("form_a"), F.xxhash64(F.lit(7), "form").alias("form_b"), F.xxhash64("text").alias("text_a"), F.xxhash64(F.lit(7), "text").alias("text_b"))
    return written(keyed, "forms")  # read several times; texts are worked through once


def form_classes(documents: DataFrame) -> DataFrame:
    """(doc_id, class_id, copies): documents whose forms are equal share class_id, the smallest doc_id among them.

    copies is the size of the class. Documents without a letter or digit, and null texts, are in none.
    """
    keyed = _keyed(documents).select("doc_id", "form_a", "form_b")
    ids = keyed.groupBy("form_a", "form_b").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies"))
    return keyed.join(ids, ["form_a", "form_b"]).select("doc_id", "class_id", "copies")


def look_alikes(documents: DataFrame) -> DataFrame:
    """(doc_a, doc_b), doc_a < doc_b: documents that look the same though their stored characters differ.

    Exact copies are no pair. Only hashes are shuffled. Classes of equal texts are paired first and their members then
    added, so a text copied many times costs no more than the pairs it is in.
    """
    keyed = _keyed(documents)
    form, text = ["form_a", "form_b"], ["text_a", "text_b"]
    texts = keyed.select(*form, *text).distinct()
    several = texts.groupBy(*form).agg(F.count("*").alias("n")).where("n > 1").select(*form)
    texts = texts.join(several, form, "left_semi")
    x = texts.select(*form, *[F.col(c).alias(f"{c}_x") for c in text])
    y = texts.select(*form, *[F.col(c).alias(f"{c}_y") for c in text])
    classes = x.join(y, form).where(F.struct("text_a_x", "text_b_x") < F.struct("text_a_y", "text_b_y")).drop(*form)
    members = keyed.select("doc_id", *text)
    for s in "xy":
        classes = classes.join(members.select(F.col("doc_id").alias(f"id_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in text]), [f"{c}_{s}" for c in text])
    return classes.where("id_x <> id_y").select(F.least("id_x", "id_y").alias("doc_a"), F.greatest("id_x", "id_y").alias("doc_b")).distinct()
