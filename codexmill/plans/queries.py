"""The registered queries of the core operators, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codexmill.functions import small
from codexmill.functions import text as T
from codexmill.functions.diff import diff_ops, diff_stat
from codexmill.functions.stem import stem_udf
from codexmill.operators import chunking, embedding, history, incremental, maintain, metrics, search
from codexmill.session import scratch, written
from codexmill.sources.tables import latest, table, texts
from codexmill.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(f: Query) -> Query:
    REGISTRY[f.__name__] = f
    return f


def corpus(spark: SparkSession, d: str) -> DataFrame:
    """Documents as chunks: one chunk a document."""
    return texts(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("chunk_id"), "doc_id", F.lit(0).alias("ord"), "text", "lang")


def items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_items").where("text is not null").select(F.col("item_id").alias("query_id"), "text")


def current(spark: SparkSession, d: str) -> DataFrame:
    return latest(table(spark, d, "chunks"), ["chunk_id"], "written_at", "text")


def units(spark: SparkSession, d: str) -> DataFrame:
    """Chunks as the pages of their document, numbered from 1."""
    return current(spark, d).where("text is not null").select("doc_id", (F.col("ord") + 1).cast("int").alias("unit_no"), "text").dropDuplicates(["doc_id", "unit_no"])


def index(spark: SparkSession, d: str, stems: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The corpus and its index; postings are built once and written, as every part of a search reads them."""
    c = corpus(spark, d)
    p = written(search.postings(c, stems), "postings")
    return c, p, search.lengths(p, c)


def messages(spark: SparkSession, d: str) -> DataFrame:
    """Events read as a conversation per user."""
    role = F.create_map(*[F.lit(x) for x in ("click", "user", "view", "assistant", "signup", "assistant", "purchase", "tool", "error", "system")])[F.col("event_type")]
    return table(spark, d, "events").select("user_id", "event_id", "ts", role.alias("role"), F.col("props").alias("content"))


@query
def tokens_per_doc(spark: SparkSession, d: str) -> DataFrame:
    t = T.terms(F.col("text"))
    return corpus(spark, d).select("doc_id", F.size(t).cast("long").alias("n_terms"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"))


@query
def term_stats(spark: SparkSession, d: str) -> DataFrame:
    return search.term_stats(search.postings(corpus(spark, d)))


@query
def postings_tf(spark: SparkSession, d: str) -> DataFrame:
    return search.postings(corpus(spark, d))


@query
def vocab_by_lang(spark: SparkSession, d: str) -> DataFrame:
    c = corpus(spark, d).select(F.coalesce("lang", F.lit("?")).alias("lang"), F.explode(F.array_distinct(T.terms(F.col("text")))).alias("term"))
    return c.distinct().groupBy("lang").agg(F.count("*").alias("terms"))


@query
def query_term_pruning(spark: SparkSession, d: str) -> DataFrame:
    _, p, n = index(spark, d)
    return search.query_terms(items(spark, d), search.term_stats(p), search.corpus_stats(n))


@query
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    _, p, n = index(spark, d)
    return search.bm25_top(items(spark, d), p, n, 8).select("query_id", "rank", "chunk_id", "score")


@query
def bm25_filtered(spark: SparkSession, d: str) -> DataFrame:
    c, p, n = index(spark, d)
    return search.bm25_top(items(spark, d), p, n, 8, c.where("lang = 'en'")).select("query_id", "rank", "chunk_id", "score")


@query
def bm25_phrase_boost(spark: SparkSession, d: str) -> DataFrame:
    c, p, n = index(spark, d)
    best = search.bm25_top(items(spark, d), p, n, 8 * search.HEAD).select("query_id", "chunk_id", "score")
    return search.top(search.boost_exact(best, c, items(spark, d)), 8).select("query_id", "rank", "chunk_id", "score", "exact")


@query
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    c, p, n = index(spark, d)
    all_, en = search.bm25_top(items(spark, d), p, n, 200), search.bm25_top(items(spark, d), p, n, 200, c.where("lang = 'en'"))
    return search.top(search.fuse([(all_, 1.0), (en, 0.5)]), 8).select("query_id", "rank", "chunk_id", "score")


@query
def vec_quantize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", search.quantised(F.col("embedding")).alias("q"))


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), search.quantised(F.col("embedding")).alias("q"))
    return v.where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), "q"), v


@query
def vec_topk_cosine(spark: SparkSession, d: str) -> DataFrame:
    return search.vector_hits(*_vectors(spark, d), k=8).select("query_id", "rank", "chunk_id", "cosine")


@query
def vec_min_cosine(spark: SparkSession, d: str) -> DataFrame:
    return search.vector_hits(*_vectors(spark, d), k=None, min_cosine=0.5).select("query_id", "chunk_id", "cosine")


@query
def vec_pair_cosine(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)[1]
    pairs = v.alias("a").join(v.alias("b"), F.col("b.chunk_id") == F.col("a.chunk_id") + 1)
    return pairs.select(F.col("a.chunk_id").alias("vec_id"), F.round(search.cosine(F.col("a.q"), F.col("b.q")), 6).alias("cosine"))


@query
def shingle_sets(spark: SparkSession, d: str) -> DataFrame:
    return corpus(spark, d).select("doc_id", F.size(T.shingles(F.col("text"))).cast("long").alias("shingles"))


@query
def stemmed_terms(spark: SparkSession, d: str) -> DataFrame:
    words = search.analysed(corpus(spark, d), "doc_id").select("term").distinct()
    return words.select("term", stem_udf("term").alias("stem"))


@query
def refined_search(spark: SparkSession, d: str) -> DataFrame:
    c, p, n = index(spark, d, stems=True)
    return search.refine(search.bm25_top(items(spark, d), p, n, 8 * search.HEAD, stems=True), c, items(spark, d))


@query
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """Chunks with their vectors; every chunk whose id is divisible by 100 asks with its text and vector."""
    c = current(spark, d).where("text is not null").select("chunk_id", "doc_id", "ord", "text")
    v = table(spark, d, "vectors").where("model = 'emb-multi-2' and size(q) = 64")
    v = latest(v, ["chunk_id"], "embedded_at").select("chunk_id", "q")
    asks = c.where("chunk_id % 100 = 0").join(v, "chunk_id", "left").select(F.col("chunk_id").alias("query_id"), "text", "q")
    gone = maintain.registry(table(spark, d, "books")).where("kind = 'gone'").select(F.col("id").alias("doc_id"))
    return search.hybrid(asks, c, v, deleted=gone)


@query
def neighbours_around(spark: SparkSession, d: str) -> DataFrame:
    c = current(spark, d).select("chunk_id", "doc_id", "ord", "text")
    return search.around(c, c.where("chunk_id % 100 = 0"), 1).select("asked_id", "chunk_id", "doc_id", "ord")


@query
def output_budget(spark: SparkSession, d: str) -> DataFrame:
    hits = table(spark, d, "documents").where("text is not null").select(F.dense_rank().over(_by_source()).cast("long").alias("rank"), F.col("source").alias("query_id"), "doc_id", "text")
    return search.with_budget(hits, F.col("text"), 4000, 100).select("query_id", "doc_id", "used")


def _by_source():
    from pyspark.sql import Window

    return Window.partitionBy("source").orderBy("doc_id")


@query
def citations(spark: SparkSession, d: str) -> DataFrame:
    books = maintain.registry(table(spark, d, "books"))
    return search.citations(current(spark, d).select("chunk_id", "doc_id", "unit_from", "unit_to"), books).select("chunk_id", "book", "place")


@query
def repeated_lines(spark: SparkSession, d: str) -> DataFrame:
    return chunking.repeated_lines(units(spark, d))


@query
def page_offsets(spark: SparkSession, d: str) -> DataFrame:
    return chunking.page_offsets(units(spark, d))


@query
def toc_units(spark: SparkSession, d: str) -> DataFrame:
    return chunking.toc_units(units(spark, d))


@query
def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk(units(spark, d))


@query
def junk_filter(spark: SparkSession, d: str) -> DataFrame:
    return current(spark, d).where("text is not null").select("chunk_id", T.worth_indexing(F.col("text")).alias("worth"))


@query
def line_flags(spark: SparkSession, d: str) -> DataFrame:
    ls = F.split("text", "\n")
    return current(spark, d).where("text is not null").select("chunk_id", F.size(F.filter(ls, T.looks_like_code)).cast("long").alias("code_lines"), F.size(F.filter(ls, lambda x: x.contains(" | "))).cast("long").alias("table_lines"))


@query
def lang_flags(spark: SparkSession, d: str) -> DataFrame:
    return corpus(spark, d).select("doc_id", T.lang_flags(F.col("text")).alias("flags"))


@query
def html_to_text(spark: SparkSession, d: str) -> DataFrame:
    html = F.concat(F.lit("<html><style>p {}</style><h1>"), F.col("title"), F.lit("</h1>\n<p>"), F.replace(F.col("text"), F.lit("\n"), F.lit("<br/>")), F.lit("</p><script>x = 1\n</script> &lt;end&gt;</html>"))
    return texts(spark, d, "documents").where("text is not null").select("doc_id", T.html_to_text(html).alias("text"))


@query
def grep_lines(spark: SparkSession, d: str) -> DataFrame:
    ls = corpus(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return ls.where(F.col("line").rlike("(?iu)recursive|рекурсивн")).select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.left("line", F.lit(400)).alias("line"))


@query
def read_lines(spark: SparkSession, d: str) -> DataFrame:
    ls = corpus(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return ls.where("line_no >= 1 and line_no < 4").select("doc_id", F.col("line_no").cast("long").alias("line_no"), "line")


@query
def text_measures(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return corpus(spark, d).select("doc_id", T.token_estimate(t).alias("tokens"), T.word_count(t).cast("long").alias("words"), T.mixed_script_words(t).cast("long").alias("mixed"), T.refused(t).alias("refused"))


@query
def small_formats(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select("p_partkey", T.snake(F.col("p_name")).alias("safe"), T.parse_tokens(F.concat(F.col("p_size").cast("string"), F.lit("k"))).alias("tokens"), T.error_kind(F.concat(F.lit("over size limit "), F.col("p_type"))).alias("kind"), T.normal_title(F.col("p_name")).alias("title"))


@query
def registry_last_wins(spark: SparkSession, d: str) -> DataFrame:
    return maintain.registry(table(spark, d, "books")).select("path", "seq", "id", "kind")


@query
def sync_pending(spark: SparkSession, d: str) -> DataFrame:
    return maintain.pending(table(spark, d, "books"), table(spark, d, "listings"))


@query
def folder_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return maintain.breakdown(table(spark, d, "books"), ["/lib"])


@query
def folder_report(spark: SparkSession, d: str) -> DataFrame:
    return maintain.folder_report(maintain.breakdown(table(spark, d, "books"), ["/lib"]), 4).select("rank", "folders", F.col("books").cast("long").alias("books"), F.col("chunks").cast("long").alias("chunks"))


@query
def collection_stats(spark: SparkSession, d: str) -> DataFrame:
    return maintain.stats(table(spark, d, "books"), table(spark, d, "chunks").where("chunk_id is not null"), table(spark, d, "vectors"), "emb-multi-2")


@query
def collection_doctor(spark: SparkSession, d: str) -> DataFrame:
    return maintain.doctor(table(spark, d, "books"))


@query
def title_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return maintain.title_duplicates(table(spark, d, "books"))


@query
def tombstones(spark: SparkSession, d: str) -> DataFrame:
    gone = maintain.registry(table(spark, d, "books")).where("kind = 'gone'").select(F.col("id").alias("doc_id"))
    return maintain.live_chunks(current(spark, d), gone).groupBy("collection").agg(F.count("*").alias("chunks"))


@query
def uncovered_chunks(spark: SparkSession, d: str) -> DataFrame:
    return maintain.uncovered(current(spark, d), table(spark, d, "vectors").where("q is not null"), "emb-multi-2").select("chunk_id")


def _failed() -> Column:
    return F.col("event_type") == "error"


@query
def evaluation_summary(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("rate", F.col("value") - 20)
    return metrics.summary(e, ["event_type"], "value", "rate", _failed())


def _fits(spark: SparkSession, d: str) -> DataFrame:
    return metrics.fit(table(spark, d, "lineitem"), "l_returnflag", "l_quantity", "l_extendedprice")


@query
def ols_fit(spark: SparkSession, d: str) -> DataFrame:
    return _fits(spark, d)


@query
def capacity_by_users(spark: SparkSession, d: str) -> DataFrame:
    return metrics.capacity(_fits(spark, d), "l_returnflag", 50_000_000.0, [1, 2, 4, 8], 262144)


@query
def capacity_pivot(spark: SparkSession, d: str) -> DataFrame:
    return metrics.pivot_users(capacity_by_users(spark, d), "l_returnflag", [1, 2, 4, 8])


@query
def idle_islands(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    return metrics.idle_islands(e, "user_id", "ts", ~_failed(), 8 * 3600).select("event_id", "idle_s")


@query
def failure_streaks(spark: SparkSession, d: str) -> DataFrame:
    return metrics.streaks(table(spark, d, "events"), "user_id", ["ts", "event_id"], _failed(), 2).select("event_id", F.col("run").cast("long").alias("run"))


@query
def first_free(spark: SparkSession, d: str) -> DataFrame:
    return metrics.first_free(table(spark, d, "events"), "user_id", ["ts", "event_id"], ~_failed(), 5).select("user_id", "event_id")


@query
def schedule_windows(spark: SparkSession, d: str) -> DataFrame:
    spans = {1: ["22:00-06:00"], 3: ["09:30-12:00", "20:00-23:30"], 6: ["00:00-08:00"]}
    return metrics.in_windows(table(spark, d, "events"), "ts", spans, 15).select("event_id", "window_begin", "window_deadline")


@query
def liveness(spark: SparkSession, d: str) -> DataFrame:
    return metrics.liveness(table(spark, d, "events"), "user_id", "ts", 12 * 3600).select("user_id", "beats", "alive")


@query
def attempt_worklist(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    models = e.select(F.col("event_type").alias("model")).distinct()
    tasks = table(spark, d, "region").select(F.col("r_name").alias("task"))
    done = models.crossJoin(F.broadcast(tasks)).where("length(model) > length(task)").withColumn("repeat", F.lit(1))
    return metrics.worklist(tasks, models, 3, done)


@query
def turn_numbers(spark: SparkSession, d: str) -> DataFrame:
    return history.turns(messages(spark, d), "user_id", "event_id").select("event_id", "turn")


@query
def turn_answers(spark: SparkSession, d: str) -> DataFrame:
    return history.answers(messages(spark, d), "user_id", "event_id")


@query
def compact_history(spark: SparkSession, d: str) -> DataFrame:
    return history.compact(messages(spark, d), "user_id", "event_id", 5).select("user_id", "event_id")


@query
def session_char_totals(spark: SparkSession, d: str) -> DataFrame:
    return history.char_totals(messages(spark, d), "user_id")


def _laid_out(spark: SparkSession, d: str) -> DataFrame:
    return history.layout(messages(spark, d), "user_id", "event_id", F.length("content") - 8)


@query
def block_layout(spark: SparkSession, d: str) -> DataFrame:
    return _laid_out(spark, d).select("event_id", F.col("lines").cast("long").alias("lines"), "first_line")


@query
def visible_answer(spark: SparkSession, d: str) -> DataFrame:
    return history.visible(_laid_out(spark, d), "user_id", "event_id", 10, 12)


@query
def listing_difference(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "listings").where("path is not null")
    return history.difference(x.where("run_id = 1"), x.where("run_id = 16"), "path")


@query
def permission_decisions(spark: SparkSession, d: str) -> DataFrame:
    rules = [("deny", "glob", "/lib/**/2019/*"), ("deny", "prefix", "/lib/legacy"), ("allow", "glob", "/lib/*/a/*.pdf"), ("allow", "prefix", "/lib/golang/")]
    paths = table(spark, d, "listings").where("path is not null").select(F.col("path").alias("target")).distinct()
    return history.decisions(paths, rules)


@query
def idle_sessions(spark: SparkSession, d: str) -> DataFrame:
    return ingest.sessions(table(spark, d, "events"), "user_id", "ts", "4 hours").select("user_id", F.unix_micros("begin").alias("begin_us"), "events")


@query
def daily_windows(spark: SparkSession, d: str) -> DataFrame:
    return ingest.windowed(table(spark, d, "events"), "ts", "1 day", "event_type").select(F.unix_micros("window_start").alias("start_us"), "event_type", "events", F.round("value_sum", 2).alias("value_sum"))


@query
def line_diff(spark: SparkSession, d: str) -> DataFrame:
    """Superseded texts of chunks against the current ones."""
    old = table(spark, d, "chunks").where("chunk_id is not null").groupBy("chunk_id").agg(F.min_by("text", F.struct("written_at", "text")).alias("old"))
    both = old.join(current(spark, d).select("chunk_id", F.col("text").alias("new")), "chunk_id").where(~F.col("old").eqNullSafe(F.col("new")))
    return both.select("chunk_id", diff_stat(diff_ops("old", "new")).alias("s")).select("chunk_id", "s.added", "s.removed")


@query
def embed_missing(spark: SparkSession, d: str) -> DataFrame:
    c, books = current(spark, d), maintain.registry(table(spark, d, "books"))
    vectors = table(spark, d, "vectors").where("q is not null")
    return embedding.embed_missing(c, books, vectors, embedding.word_hashing(64), "emb-multi-2")


@query
def books_matching(spark: SparkSession, d: str) -> DataFrame:
    wanted = spark.createDataFrame([("go",), ("систем",), ("/old/2019/",), ("nowhere",)], "want string")
    return maintain.books_matching(table(spark, d, "books"), wanted)


@query
def books_named(spark: SparkSession, d: str) -> DataFrame:
    """Every file name that a listing holds, looked up among the books."""
    wanted = table(spark, d, "listings").where("path is not null").select(F.element_at(F.split("path", "/"), -1).alias("want"))
    return maintain.books_named(table(spark, d, "books"), wanted)


@query
def chunk_refs(spark: SparkSession, d: str) -> DataFrame:
    c = current(spark, d).where("collection is not null and ord is not null")
    forms = F.array(F.concat("collection", F.lit("/"), "doc_id", F.lit("#"), "ord"), F.concat("doc_id", F.lit("#"), "ord"), F.concat(F.lit("attic/"), "doc_id", F.lit("#"), "ord"), F.concat("doc_id", F.lit("-"), "ord"))
    refs = c.select("chunk_id", "collection", F.posexplode(forms).alias("form", "ref"))
    return refs.select("chunk_id", F.col("form").cast("long").alias("form"), small.chunk_ref(F.col("ref"), F.col("collection")).alias("r")).select("chunk_id", "form", "r.doc_id", "r.ord", "r.error")


@query
def byte_cuts(spark: SparkSession, d: str) -> DataFrame:
    return corpus(spark, d).select("doc_id", small.cut_bytes(F.col("text"), 1024).alias("text"))


@query
def numbered_lines(spark: SparkSession, d: str) -> DataFrame:
    return corpus(spark, d).select("doc_id", small.numbered(F.col("text"), 2, 3).alias("text"))


@query
def common_indent(spark: SparkSession, d: str) -> DataFrame:
    indented = F.concat(F.lit("  "), F.replace("text", F.lit("\n"), F.lit("\n  ")))
    return current(spark, d).where("text is not null").select("chunk_id", small.without_common_indent(indented).alias("text"))


@query
def html_links(spark: SparkSession, d: str) -> DataFrame:
    html = F.concat(F.lit("<nav><a class='x' href='c"), "doc_id", F.lit(".html'>\n  <b>"), F.coalesce("title", F.lit("")), F.lit("</b> </a><a>none</a><a href=''>no place</a><A HREF=\"#top\">up &amp; away</A></nav>"))
    rows = texts(spark, d, "documents").select("doc_id", F.posexplode(small.links(html)).alias("place", "l"))
    return rows.select("doc_id", F.col("place").cast("long").alias("place"), "l.href", "l.text")


@query
def number_parsers(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_orderkey").cast("string").alias("k"), F.col("o_custkey").cast("string").alias("c"))
    page = F.when(F.col("o_custkey") % 2 == 1, F.concat("k", F.lit("-"), "c")).otherwise(F.col("k"))
    label, sizes = F.concat("c", F.lit("."), "k"), F.concat("k", F.lit("k,x,"), "c", F.lit("m,7"))
    got = o.select("o_orderkey", small.page_spec(page).alias("p"), small.figure_label(label).alias("f"), small.number_list(sizes).alias("n"), small.valid_name(F.concat("k", F.lit("_-"), "c")).alias("name_ok"))
    return got.select("o_orderkey", F.col("p.first").alias("first_page"), F.col("p.count").alias("pages"), "f.unit", "f.figure", F.array_join(F.transform("n", lambda x: x.cast("string")), " ").alias("sizes"), "name_ok")


@query
def context_meters(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem")
    used, most = F.col("l_partkey") + F.col("l_suppkey"), F.col("l_orderkey") - 100
    return l.select("l_orderkey", "l_linenumber", small.percent(used, most).alias("percent"), small.bar(used, most, 10).alias("bar"), F.round(small.per_second(F.col("l_partkey"), used * 1_000_000 - 1_000_000_000), 6).alias("rate"))


@query
def users_at_full_window(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "lineitem")
    return metrics.users_at_full(s, _fits(spark, d), "l_returnflag", "l_quantity", "l_extendedprice", 50_000_000.0, 1024, 40, F.col("l_extendedprice") > 80_000)


@query
def sample_points(spark: SparkSession, d: str) -> DataFrame:
    most = F.col("o_custkey") * 17 - 500
    got = table(spark, d, "orders").select("o_orderkey", metrics.sample_points(most).alias("p"), metrics.usable_budget(F.col("o_totalprice"), F.lit(1000.0), F.col("o_custkey") - 700.0, F.lit(250.0)).alias("usable"))
    return got.select("o_orderkey", F.array_join(F.transform("p", lambda x: x.cast("string")), " ").alias("points"), F.round("usable", 2).alias("usable"))


@query
def last_question(spark: SparkSession, d: str) -> DataFrame:
    return metrics.last_of_role(messages(spark, d), "user_id", "event_id", "user")


@query
def checklist_scores(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("weight", F.when(F.col("event_type") == "error", -F.col("value")).otherwise(F.col("value") / 8))
    return metrics.checklist(e, ["user_id"], "weight")


@query
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return incremental.changed_since_success(table(spark, d, "listings"), table(spark, d, "runs")).select("run_id", "path")


@query
def p4_ledger(spark: SparkSession, d: str) -> DataFrame:
    return incremental.replayed(table(spark, d, "books"), "at_sec", table(spark, d, "runs"), scratch(spark, "ledger"))


def queries() -> dict[str, Query]:
    return dict(REGISTRY)
