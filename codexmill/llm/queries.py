"""The registered queries of the operators in this subpackage; pN_ belongs to problem N of TESTDATA.md."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codexmill.llm import encoding, leakage, near_duplicates, nearest, one_form, packing, scanned, splitting, term_frequency
from codexmill.sources.tables import table, texts

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return term_frequency.marked_terms(texts(spark, d, "tokens")).where("mark is not null").select("term", "mark")


def p1_term_counts(spark: SparkSession, d: str) -> DataFrame:
    return term_frequency.term_counts(texts(spark, d, "tokens"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(table(spark, d, "chunks"), table(spark, d, "chunk_opts")).where("piece_no = 0").select("chunk_id")


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(table(spark, d, "chunks"), table(spark, d, "chunk_opts"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return scanned.noise(texts(spark, d, "chunks"), table(spark, d, "books"))


def p3_repaired(spark: SparkSession, d: str) -> DataFrame:
    return scanned.repaired(texts(spark, d, "chunks"), table(spark, d, "books"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, d, "books"), texts(spark, d, "chunks"))


def p5_documents(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.near_duplicate_documents(texts(spark, d, "documents"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return encoding.garbled(texts(spark, d, "chunks")).select("chunk_id")


def p6_repaired(spark: SparkSession, d: str) -> DataFrame:
    return encoding.garbled(texts(spark, d, "chunks"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return nearest.similar_pairs(table(spark, d, "vectors"))


def p7_most_similar(spark: SparkSession, d: str) -> DataFrame:
    return nearest.most_similar(table(spark, d, "vectors"))


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.packed(texts(spark, d, "documents"), table(spark, d, "containers"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(packing.packed(texts(spark, d, "documents"), table(spark, d, "containers")), table(spark, d, "containers"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(texts(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p9_spans(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_spans(texts(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_clean(spark: SparkSession, d: str) -> DataFrame:
    return leakage.without_leaks(texts(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return one_form.look_alikes(texts(spark, d, "documents"))


def p10_classes(spark: SparkSession, d: str) -> DataFrame:
    return one_form.form_classes(texts(spark, d, "documents"))


def queries() -> dict[str, Query]:
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1:].partition("_")[0].isdigit()}
