"""Lexical and vector search for many queries at once, and what turns hits into results.

Chunks are rows (chunk_id, doc_id, ord, text); queries are rows (query_id, text). The index is two tables: postings
(term, chunk_id, tf) and lengths (chunk_id, len). Frequent terms are pruned before their postings are joined, so a
query never drags the longest lists along unless it has nothing else.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codexmill.functions import text as T
from codexmill.functions.stem import stem, stem_udf
from codexmill.operators import scan
from codexmill.operators.scan import K1, MATCH_BONUS, B
from codexmill.session import tidy, written

RRF_K, CANDIDATES, HEAD = 20, 200, 12
#: Queries that are sent to every task at once; more of them are scanned in several passes.
QUERY_BLOCK = 10_000
EXACT_BOOST, SNIPPET = 1.5, 320


@dataclass(frozen=True)
class Options:
    top_k: int = 8
    max_per_doc: int = 3
    min_cosine: float = 0.0
    semantic_weight: float = 1.0


def analysed(df: DataFrame, key: str, text: str = "text", stems: bool = False) -> DataFrame:
    """(key, term), one row per occurrence: surface terms, or stems with identifiers whole and in parts.

    Stems are worked out once per distinct word and joined back, so Python sees the vocabulary, not the corpus.
    """
    if not stems:
        return df.where(F.col(key).isNotNull()).select(key, F.explode(T.terms(F.col(text))).alias("term"))
    words = df.where(F.col(key).isNotNull()).select(key, F.explode(T.raw_words(F.col(text))).alias("raw"))
    vocabulary = words.select("raw").distinct()
    norm = T.normal(F.col("raw"))
    parts = F.filter(F.split(norm, T.CONNECTORS), lambda p: T.fits(p) & (p != norm))
    emitted = F.when(T.is_identifier(F.col("raw")), F.concat(F.filter(F.array(norm), T.fits), F.when(norm.rlike(r"[\p{L}\p{Nd}]" + T.CONNECTORS + r"[\p{L}\p{Nd}]"), parts).otherwise(F.array().cast("array<string>"))))
    plain = vocabulary.select("raw", norm.alias("norm"), emitted.alias("emitted"))
    stemmed = plain.withColumn("stem", stem_udf("norm"))
    terms = F.coalesce("emitted", F.when(T.fits(F.col("norm")) & T.fits(F.col("stem")), F.array("stem")).otherwise(F.array().cast("array<string>")))
    return words.join(stemmed.select("raw", terms.alias("terms")), "raw").select(key, F.explode("terms").alias("term"))


def postings(chunks: DataFrame, stems: bool = False) -> DataFrame:
    """(term, chunk_id, tf)."""
    return analysed(chunks, "chunk_id", stems=stems).groupBy("term", "chunk_id").agg(F.count("*").alias("tf"))


def lengths(posting: DataFrame, chunks: DataFrame) -> DataFrame:
    """(chunk_id, len) in terms; chunks without a term have 0."""
    n = posting.groupBy("chunk_id").agg(F.sum("tf").alias("len"))
    return chunks.select("chunk_id").where("chunk_id is not null").distinct().join(n, "chunk_id", "left").select("chunk_id", F.coalesce("len", F.lit(0)).alias("len"))


def term_stats(posting: DataFrame) -> DataFrame:
    """(term, df, tf) over the collection."""
    return posting.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


def corpus_stats(length: DataFrame) -> DataFrame:
    """One row: n chunks and their mean length, at least 1."""
    return length.agg(F.count("*").alias("n"), F.greatest(F.coalesce(F.avg("len"), F.lit(0.0)), F.lit(1.0)).alias("avg_len"))


def query_terms(queries: DataFrame, stats: DataFrame, corpus: DataFrame, stems: bool = False) -> DataFrame:
    """(query_id, term, df): distinct terms; where some term is in at most a third of the chunks, more frequent ones go."""
    return _rarer(analysed(queries.select(F.col("query_id"), "text"), "query_id", stems=stems).distinct(), stats, corpus)


def _rarer(asked: DataFrame, stats: DataFrame, corpus: DataFrame) -> DataFrame:
    known = asked.join(stats.select("term", "df"), "term").crossJoin(F.broadcast(corpus.select(F.floor(F.col("n") / 3).alias("third"))))
    rare = F.max((F.col("df") <= F.col("third")).cast("int")).over(Window.partitionBy("query_id"))
    return known.withColumn("rare", rare).where("rare = 0 or df <= third").select("query_id", "term", "df")


def bm25(queries: DataFrame, posting: DataFrame, length: DataFrame, only: DataFrame | None = None, stems: bool = False) -> DataFrame:
    """(query_id, chunk_id, score, matched): summed term weights, with a bonus for every further term matched.

    only: chunk_ids that may come out; document frequencies stay those of the whole collection. Queries without a
    known term have no rows.
    """
    corpus = corpus_stats(length)
    terms = query_terms(queries, term_stats(posting), corpus, stems)
    lists = posting if only is None else posting.join(only.select("chunk_id").distinct(), "chunk_id", "left_semi")
    met = lists.join(terms, "term").join(length, "chunk_id").crossJoin(F.broadcast(corpus))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    scored = met.groupBy("query_id", "chunk_id").agg(F.sum(weight).alias("s"), F.count("*").alias("matched"))
    return scored.select("query_id", "chunk_id", F.round(F.col("s") * (1 + MATCH_BONUS * (F.col("matched") - 1)), 6).alias("score"), "matched")


def bm25_top(queries: DataFrame, posting: DataFrame, length: DataFrame, k: int, only: DataFrame | None = None, stems: bool = False) -> DataFrame:
    """(query_id, chunk_id, score, matched, rank): the k best of bm25() for every query, without its pairs of all matches.

    Lists of the query terms are dealt out by chunk, so no term is hot; each task scores its chunks for all queries,
    which travel to it in blocks of QUERY_BLOCK, and gives out what can be among the k best only.
    """
    spark = queries.sparkSession
    corpus = corpus_stats(length).first()
    n, mean = corpus["n"], float(corpus["avg_len"])
    terms = query_terms(queries, term_stats(posting), corpus_stats(length), stems)
    lists = posting if only is None else posting.join(only.select("chunk_id").distinct(), "chunk_id", "left_semi")
    found = None
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    if blocks > 1:
        terms = written(terms, "terms")  # read once a block
    for block in range(blocks):
        asked = terms.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).orderBy("query_id").toArrow()
        words = asked["term"].combine_chunks().dictionary_encode()
        code = words.indices.to_numpy()
        names, of = np.unique(asked["query_id"].to_numpy(), return_inverse=True)
        df = asked["df"].to_numpy().astype(float)
        order = np.argsort(code, kind="stable")
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))[order]
        begins = np.searchsorted(code[order], np.arange(len(words.dictionary) + 1))
        sent = spark.sparkContext.broadcast((names, of[order], idf, begins))
        vocabulary = spark.createDataFrame(list(enumerate(words.dictionary.to_pylist())), "code int, term string")
        met = lists.join(vocabulary, "term").join(length, "chunk_id").select("chunk_id", "code", "tf", "len").repartition("chunk_id")
        got = met.mapInArrow(lambda it, sent=sent: _score(it, *sent.value, k, mean), "query_id long, chunk_id long, score double, matched long")
        found = got if found is None else found.unionAll(got)
    return top(found.withColumn("score", F.round("score", 6)), k)


def _score(batches: Iterator[pa.RecordBatch], names: np.ndarray, of: np.ndarray, idf: np.ndarray, begins: np.ndarray, k: int, mean: float) -> Iterator[pa.RecordBatch]:
    """Scores of a task's chunks; all entries of a chunk are in one task. begins: by term the range of its queries in `of`."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    t = pa.Table.from_batches(held)
    chunk, code, tf, size = (t[c].to_numpy() for c in ("chunk_id", "code", "tf", "len"))
    order = np.lexsort((code, chunk))
    chunk, code, tf, size = chunk[order], code[order], tf[order].astype(float), size[order]
    weight = tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean))
    ids, first = np.unique(chunk, return_index=True)
    first = np.append(first, len(chunk))
    for c in range(0, len(ids), 4096):
        rows = slice(first[c], first[min(c + 4096, len(ids))])
        own = np.searchsorted(ids, chunk[rows]) - c
        by_code = np.argsort(code[rows], kind="stable")
        used, at = np.unique(code[rows][by_code], return_index=True)
        at = np.append(at, len(by_code))
        w, own = weight[rows][by_code], own[by_code]
        here = ids[c : c + 4096]
        for q in range(0, len(names), 256):
            score, matched = np.zeros((min(256, len(names) - q), len(here))), np.zeros((min(256, len(names) - q), len(here)), np.int32)
            for j, term in enumerate(used):
                asking = of[begins[term] : begins[term + 1]]
                lo, hi = np.searchsorted(asking, (q, q + 256))
                if lo < hi:
                    rows_, cols = asking[lo:hi] - q, own[at[j] : at[j + 1]]
                    score[rows_[:, None], cols] += idf[begins[term] + lo : begins[term] + hi, None] * w[at[j] : at[j + 1]]
                    matched[rows_[:, None], cols] += 1
            score *= 1 + MATCH_BONUS * (matched - 1)
            score[matched == 0] = -1
            least = np.partition(score, -k, axis=1)[:, -k] if score.shape[1] > k else np.full(len(score), -1.0)
            r, j = np.nonzero((matched > 0) & (score >= least[:, None] - 1e-6))  # ties are settled after rounding
            yield pa.record_batch({"query_id": pa.array(names[q + r]), "chunk_id": pa.array(here[j]), "score": pa.array(score[r, j]), "matched": pa.array(matched[r, j].astype(np.int64))})


def _blocks(terms: DataFrame, n: int, queries: int) -> Iterator[scan.Asked]:
    """(query_id, term, df) as blocks of at most about QUERY_BLOCK queries, in the form in which they are sent to tasks."""
    blocks = max(1, -(-queries // QUERY_BLOCK))
    if blocks > 1:
        terms = written(terms, "terms")  # read once a block
    for block in range(blocks):
        asked = terms.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).orderBy("query_id").toArrow()
        words = asked["term"].combine_chunks().dictionary_encode()
        code = words.indices.to_numpy()
        names, of = np.unique(asked["query_id"].to_numpy(), return_inverse=True)
        df = np.zeros(len(words.dictionary))
        df[code] = asked["df"].to_numpy()
        order = np.argsort(code, kind="stable")
        begins = np.searchsorted(code[order], np.arange(len(df) + 1))
        yield scan.Asked(names, of[order].astype(np.int32), np.log(1 + (n - df + 0.5) / (df + 0.5)), begins, words.dictionary.to_pylist())


def bm25_texts(queries: DataFrame, chunks: DataFrame, k: int, stems: bool = True) -> DataFrame:
    """As bm25_top(), for chunks of one row each: tasks read texts, once for frequencies and once a block of
    queries, so that no occurrence of a word is shuffled. chunks: read several times, so best a written table.
    """
    spark = queries.sparkSession
    texts = chunks.where("chunk_id is not null").select("chunk_id", "text")
    stats = written(texts.mapInArrow(lambda it: scan.frequencies(it, stems), "term string, df long, tf long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf")), "stats")
    total = stats.where("term is null").select("df", "tf").first()
    n, mean = (total["df"], max(1.0, total["tf"] / max(1, total["df"]))) if total else (0, 1.0)
    asked = queries.where("query_id is not null").select("query_id", "text").mapInArrow(lambda it: scan.occurrences(it, stems), "query_id long, term string").distinct()
    terms = _rarer(asked, stats.where("term is not null"), spark.range(1).select(F.lit(n).alias("n")))
    found = None
    for block in _blocks(terms, n, queries.count()):
        sent = spark.sparkContext.broadcast(block)
        got = shares(texts).mapInArrow(lambda it, sent=sent: sent.value.best(it, k, mean, stems), scan.HITS)
        found = got if found is None else found.unionAll(got)
    return top(found.withColumn("score", F.round("score", 6)), k)


def shares(df: DataFrame) -> DataFrame:
    """df in one share a core: every task gives out its best of each query, so fewer tasks shuffle less."""
    return df.coalesce(df.sparkSession.sparkContext.defaultParallelism)


def top(hits: DataFrame, k: int, score: str = "score") -> DataFrame:
    """The k best of each query with their rank from 1; ties go to the smaller chunk_id."""
    w = Window.partitionBy("query_id").orderBy(F.col(score).desc(), F.col("chunk_id"))
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def boost_exact(hits: DataFrame, chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """Hits whose text holds the whole query (3 characters or more, any case) score half as much again; four decimals, halves up."""
    phrase = F.lower(F.trim("q"))
    h = hits.join(chunks.select("chunk_id", "text"), "chunk_id").join(queries.select("query_id", F.col("text").alias("q")), "query_id")
    hit = (F.length(phrase) >= 3) & F.lower("text").contains(phrase)
    return h.select("query_id", "chunk_id", (F.floor(F.when(hit, F.col("score") * EXACT_BOOST).otherwise(F.col("score")) * 10_000 + 0.5) / 10_000).alias("score"), F.coalesce(hit, F.lit(False)).alias("exact"))


def quantised(vector: Column) -> Column:
    """A float vector scaled to length 1 and to whole numbers of -127 to 127, halves away from zero; zeros stay."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    whole = lambda x, n: F.when(n > 0, F.greatest(F.least(F.round(x.cast("double") / n * 127), F.lit(127.0)), F.lit(-127.0))).otherwise(F.lit(0.0)).cast("tinyint")
    return T.let(norm, lambda n: F.transform(vector, lambda x: whole(x, n)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two quantised vectors: whole-number product over 127 squared; 0 where lengths differ or are 0."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("int") * y.cast("int")), F.lit(0), lambda s, x: s + x)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), dot / F.lit(16129.0)).otherwise(F.lit(0.0))


def vector_hits(queries: DataFrame, vectors: DataFrame, k: int | None = CANDIDATES, min_cosine: float = 0.0, only: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id, cosine, rank): exact scan of all vectors for a stated set of queries.

    queries: query_id, q. The queries travel to the vectors in blocks of QUERY_BLOCK (NumPy products over Arrow
    batches); each task keeps its k best, and those are merged. Cosines below min_cosine don't count. Without a k all
    others come out, and no rank.
    """
    v = vectors if only is None else vectors.join(only.select("chunk_id").distinct(), "chunk_id", "left_semi")
    v = v.where("chunk_id is not null and q is not null").select("chunk_id", "q")
    spark = queries.sparkSession
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    if blocks > 1:
        v = written(v, "vectors")  # read once a block
    found = None
    for block in range(blocks):
        part = queries.where("q is not null").where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).select("query_id", "q").toArrow()
        q = np.array(part["q"].to_pylist(), np.float32).reshape(part.num_rows, -1)
        sent = spark.sparkContext.broadcast((part["query_id"].to_numpy(), q))
        got = shares(v).mapInArrow(lambda it, sent=sent: scan.cosines(it, *sent.value, k, min_cosine), "query_id long, chunk_id long, cosine double")
        found = got if found is None else found.unionAll(got)
    found = found.withColumn("cosine", F.round("cosine", 6))
    return found if k is None else top(found, k, "cosine")


def fuse(lists: list[tuple[DataFrame, float]]) -> DataFrame:
    """(query_id, chunk_id, score): reciprocal ranks of several ranked lists, weighted and summed."""
    parts = [df.select("query_id", "chunk_id", (F.lit(float(w)) / (RRF_K + F.col("rank"))).alias("s")) for df, w in lists]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionAll(p)
    return both.groupBy("query_id", "chunk_id").agg(F.round(F.sum("s"), 6).alias("score"))


_word = re.compile(T.WORD.replace(r"\p{L}\p{Nd}", r"^\W_"))
_run = re.compile(r"(?:[^\W_]|[._\-+#/])+")
_edges = re.compile(r"^[._\-+#/]+|[._\-/]+$")


@lru_cache(maxsize=200_000)
def _terms(text: str) -> frozenset[str]:
    """Terms of a query or of a word; words repeat within and across texts, so they are kept."""
    out = set()
    for w in _word.findall(text):
        t = _edges.sub("", w.lower().replace("ё", "е"))
        if T.SHORTEST <= len(t) <= T.LONGEST:
            ident = re.search(r"[^\W_][._\-+#/]|[a-zа-яё][A-ZА-ЯЁ]|[^\W\d_]\d|\d[^\W\d_]|[+#]$", w)
            out |= {t, *(p for p in re.split(T.CONNECTORS, t) if len(p) >= T.SHORTEST)} if ident else {stem(t)}
    return frozenset(out)


def snippet(text: str, query: str, most: int = SNIPPET) -> str:
    """The stretch of the text that holds most of the query's terms: it begins a little before a match, at a word."""
    if len(text) <= most:
        return text.strip()
    wanted = _terms(query)
    spans = [(m.start(), m.end(), _terms(m[0]) & wanted) for m in _run.finditer(text)]
    anchors = [a for a, _, hit in spans if hit]
    if not anchors:
        return text[:most].strip() + "…"
    windows = [max(0, a - most // 6) for a in anchors]
    hits = [x for x in spans if x[2]]
    best, n, lo, hi, inside = 0, 0, 0, 0, dict.fromkeys(wanted, 0)
    for s in windows:  # both ends only move on
        while hi < len(hits) and hits[hi][1] <= s + most:
            for t in hits[hi][2]:
                n += not inside[t]
                inside[t] += 1
            hi += 1
        while lo < hi and hits[lo][0] < s:
            for t in hits[lo][2]:
                inside[t] -= 1
                n -= not inside[t]
            lo += 1
        if n > best:
            best, start = n, s
    start = windows[0] if not best else start
    while start > 0 and text[start - 1].isalnum():
        start -= 1
    end = min(len(text), start + most)
    while end < len(text) and text[end].isalnum():
        end += 1
    return ("…" if start else "") + text[start:end].strip() + ("…" if end < len(text) else "")


def _runs_of_three(text: str) -> set[tuple[str, ...]]:
    w = text.lower().split()
    return set(zip(w, w[1:], w[2:], strict=False))


def refine(hits: DataFrame, chunks: DataFrame, queries: DataFrame, options: Options = Options()) -> DataFrame:
    """(query_id, rank, chunk_id, doc_id, score, snippet): varied results out of the best 12 x top_k hits of a query.

    Hits that hold the whole query move up; then hits are taken in order unless their document has its share, a
    neighbouring chunk was taken, or what would be shown repeats 70 % of what is. A skipped hit uses up nothing, so
    this is a fold over at most 12 x top_k rows a query, not a window.
    """
    head = top(hits.select("query_id", "chunk_id", "score"), options.top_k * HEAD)
    rows = head.join(chunks.select("chunk_id", "doc_id", "ord", "text"), "chunk_id").join(queries.select("query_id", F.col("text").alias("query")), "query_id")

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        phrase = group["query"].iloc[0].strip().lower()
        lifted = group["text"].str.lower().str.contains(phrase, regex=False) & (len(phrase) >= 3)
        group = group.assign(score=group["score"].where(~lifted, group["score"] * EXACT_BOOST)).sort_values(["score", "rank"], ascending=[False, True], kind="stable")
        taken: dict[int, list[int]] = {}
        shown: list[set] = []
        out = []
        for r in group.itertuples():
            ords = taken.setdefault(r.doc_id, [])
            if options.max_per_doc and len(ords) >= options.max_per_doc or any(abs(o - r.ord) <= 1 for o in ords):
                continue
            quote = snippet(r.text, r.query)
            runs = _runs_of_three(quote)
            if any(runs and s and len(runs & s) * 10 >= min(len(runs), len(s)) * 7 for s in shown):
                continue
            ords.append(r.ord)
            shown.append(runs)
            out.append((r.query_id, len(out) + 1, r.chunk_id, r.doc_id, round(r.score, 6), quote))
            if len(out) == options.top_k:
                break
        return pd.DataFrame(out, columns=["query_id", "rank", "chunk_id", "doc_id", "score", "snippet"])

    return rows.groupBy("query_id").applyInPandas(pick, "query_id long, rank int, chunk_id long, doc_id long, score double, snippet string")


def hybrid(queries: DataFrame, chunks: DataFrame, vectors: DataFrame | None = None, options: Options = Options(), stems: bool = True, deleted: DataFrame | None = None) -> DataFrame:
    """refine() of lexical and vector hits fused by rank; without vectors, or for queries without one, lexical only.

    queries may carry q, the quantised vector of the query. Chunks of deleted documents (doc_id) never come out.
    """
    live = chunks if deleted is None else chunks.join(deleted.select("doc_id").distinct(), "doc_id", "left_anti")
    with tidy(chunks.sparkSession):
        live = written(live, "live")  # both legs and the refinement read it
        queries = written(queries, "queries")
    lexical = bm25_texts(queries, live, CANDIDATES, stems)
    if vectors is None or "q" not in queries.columns:
        return refine(lexical, live, queries, options)
    near = vector_hits(queries.select("query_id", "q"), vectors, CANDIDATES, options.min_cosine, live)
    return refine(fuse([(lexical, 1.0), (near, options.semantic_weight)]), live, queries, options)


def around(chunks: DataFrame, asked: DataFrame, reach: int = 1) -> DataFrame:
    """(asked_id, chunk_id, doc_id, ord, text): chunks of the same document up to `reach` (0 to 5) places away."""
    reach = max(0, min(5, reach))
    at = chunks.join(asked.select(F.col("chunk_id").alias("asked_id")), F.col("chunk_id") == F.col("asked_id")).select("asked_id", F.col("doc_id").alias("d"), F.explode(F.sequence(F.col("ord") - reach, F.col("ord") + reach)).alias("o"))
    return chunks.join(at, (F.col("doc_id") == F.col("d")) & (F.col("ord") == F.col("o"))).select("asked_id", "chunk_id", "doc_id", "ord", "text")


def with_budget(results: DataFrame, entry: Column, budget: int, header: int = 0) -> DataFrame:
    """Results of each query while their entries fit a budget of bytes; the first always comes."""
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    used = F.sum(F.octet_length(entry)).over(w) + header
    return results.withColumn("used", used).where((F.col("used") <= budget) | (F.col("rank") == 1))


def citations(hits: DataFrame, books: DataFrame) -> DataFrame:
    """Hits with title (else file name) and place, joined to books by doc_id; hits without a book stay."""
    b = books.select(F.col("id").alias("doc_id"), "title", "path", "unit_word")
    name = F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.element_at(F.split("path", "/"), -1), F.concat(F.lit("document "), F.col("doc_id").cast("string")))
    span = F.when(F.col("unit_from") == F.col("unit_to"), F.col("unit_from").cast("string")).otherwise(F.concat_ws("-", F.col("unit_from").cast("string"), F.col("unit_to").cast("string")))
    return hits.join(b, "doc_id", "left").withColumn("book", name).withColumn("place", F.concat_ws(" ", F.coalesce("unit_word", F.lit("page")), span)).drop("title", "path", "unit_word")
