import math

import pytest
from pyspark.sql import functions as F

from codexmill.operators import chunking, history, maintain, metrics, search
from codexmill.plans import queries

CHUNK = "chunk_id long, doc_id long, ord int, text string"


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [(1, 1, 0, "goroutine channel buffer"), (2, 1, 1, "channel channel select"), (3, 2, 0, "канал и горутина"), (4, 3, 0, "mutex lock"), (5, 3, 1, ""), (6, 4, 0, "каналы каналов")]
    return spark.createDataFrame(rows, CHUNK)


def test_bm25_by_hand(spark, chunks):
    q = spark.createDataFrame([(1, "channel"), (2, "nothing here"), (3, None)], "query_id long, text string")
    p = search.postings(chunks)
    rows = {r.chunk_id: r for r in search.bm25(q, p, search.lengths(p, chunks)).collect()}
    assert set(rows) == {1, 2}
    avg, idf = (3 + 3 + 2 + 2 + 0 + 2) / 6, math.log(1 + (6 - 2 + 0.5) / 2.5)
    assert rows[2].score == pytest.approx(idf * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 3 / avg)), abs=1e-6)
    assert rows[2].score > rows[1].score


def test_phrase_boost_takes_whole_items_and_96_hits(spark, tmp_path):
    # the item has six words; documents with all of them in another order are shorter, so better by BM25
    item = "alpha beta gamma delta epsilon zeta"
    rows = [(i, "zeta epsilon delta gamma beta alpha") for i in range(70)] + [(70, item.title() + " tail"), (71, "alpha beta gamma delta tail")] + [(i, "filler words only") for i in range(100, 400)]
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' lang").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/eval_items.parquet")
    got = sorted(queries.queries()["bm25_phrase_boost"](spark, str(tmp_path)).collect(), key=lambda r: r.rank)
    c, p, n = queries.index(spark, str(tmp_path))
    scores = {r.chunk_id: r.score for r in search.bm25(queries.items(spark, str(tmp_path)), p, n).collect()}
    head = sorted(scores, key=lambda i: (-scores[i], i))[:96]
    assert 70 not in head[:50] and 70 in head
    texts = dict(rows)
    want = sorted(((-round(scores[i] * (1.5 if item in texts[i].lower() else 1), 4), i) for i in head))[:8]
    assert [(r.chunk_id, r.score, r.exact) for r in got] == [(i, -s, i == 70) for s, i in want] and got[0].chunk_id == 70


def test_stems_join_forms(spark, chunks):
    q = spark.createDataFrame([(1, "канала")], "query_id long, text string")
    got = search.hybrid(q, chunks).collect()
    assert {r.chunk_id for r in got} == {3, 6}
    gone = spark.createDataFrame([(4,)], "doc_id long")
    assert {r.chunk_id for r in search.hybrid(q, chunks, deleted=gone).collect()} == {3}


def test_refine_skips_neighbours_and_copies(spark):
    long = "alpha beta gamma delta epsilon zeta eta theta"
    rows = [(1, 1, 0, long), (2, 1, 1, "other words " + long), (3, 2, 0, long), (4, 3, 5, "alpha quite another text of its own")]
    c = spark.createDataFrame(rows, CHUNK)
    q = spark.createDataFrame([(1, "alpha")], "query_id long, text string")
    p = search.postings(c)
    got = search.refine(search.bm25(q, p, search.lengths(p, c)), c, q)
    assert sorted(r.chunk_id for r in got.collect()) in ([1, 4], [3, 4], [2, 4])


def test_vectors_and_fusion(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [0.0, 0.0]), (4, [-1.0, 0.0])], "chunk_id long, v array<float>").select("chunk_id", search.quantised(F.col("v")).alias("q"))
    assert {r.chunk_id: r.q for r in v.collect()} == {1: [127, 0], 2: [0, 127], 3: [0, 0], 4: [-127, 0]}
    hits = search.vector_hits(v.where("chunk_id = 1").select(F.lit(9).cast("long").alias("query_id"), "q"), v, k=3)
    assert [(r.chunk_id, r.cosine) for r in hits.orderBy("rank").collect()] == [(1, 1.0), (2, 0.0), (3, 0.0)]
    fused = search.fuse([(hits, 1.0), (hits.where("chunk_id = 2").withColumn("rank", F.lit(1)), 2.0)])
    assert {r.chunk_id: r.score for r in fused.collect()}[2] == pytest.approx(1 / 22 + 2 / 21, abs=1e-6)


def test_snippet_shows_the_match():
    text = "filler " * 100 + "the needle in question " + "filler " * 100
    s = search.snippet(text, "needle", 60)
    assert "needle" in s and s.startswith("…") and s.endswith("…") and len(s) < 80
    assert search.snippet("short", "x") == "short"


def test_around_and_budget(spark, chunks):
    got = search.around(chunks, chunks.where("chunk_id = 1"), 1).collect()
    assert sorted(r.chunk_id for r in got) == [1, 2]
    r = spark.createDataFrame([(1, 1, "x" * 50), (1, 2, "y" * 10)], "query_id long, rank int, t string")
    assert [x.rank for x in search.with_budget(r, F.col("t"), 20).collect()] == [1]


def test_chunker(spark):
    o = chunking.ChunkOptions(chars=100, step=60, min_chars=20)
    text = "\n\n".join(f"Paragraph number {i} says a thing of its own about it." for i in range(6))
    units = spark.createDataFrame([(1, 1, text), (2, 1, None), (3, 1, "12345")], "doc_id long, unit_no int, text string")
    got = chunking.chunk(units, o).orderBy("doc_id", "ord").collect()
    assert {r.doc_id for r in got} == {1} and [r.ord for r in got] == list(range(len(got)))
    assert all(a.text.split("\n\n")[-1] == b.text.split("\n\n")[0] or len(a.text) < 60 for a, b in zip(got, got[1:], strict=False))
    joined = " ".join(r.text for r in got)
    assert all(f"number {i}" in joined for i in range(6))


def test_running_heads_go(spark):
    units = spark.createDataFrame([(1, i, f"Chapter one {i}\nSome text of page {i} that is long enough to keep.\nmore") for i in range(1, 13)], "doc_id long, unit_no int, text string")
    assert {(r.line, r.units) for r in chunking.repeated_lines(units).collect()} >= {("chapter one", 12), ("more", 12)}
    assert [(r.offset, r.votes) for r in chunking.page_offsets(units).collect()] == [(0, 12)]
    assert not any("Chapter" in r.text for r in chunking.chunk(units).collect())


def test_registry_and_sync(spark, tmp_path):
    books = spark.createDataFrame([(1, 1, "a", 5, 5, "ok"), (2, 1, "a", 6, 6, "scan"), (3, 2, "b", None, None, "ok"), (4, 3, None, 1, 1, "ok")], "seq long, id long, path string, size long, mtime long, kind string")
    assert {(r.path, r.seq) for r in maintain.registry(books).collect()} == {("a", 2), ("b", 3)}
    disk = spark.createDataFrame([("a", 6, 7), ("c", 1, 1), ("c", 1, 1)], "path string, size long, mtime long")
    assert {tuple(r) for r in maintain.pending(books, disk).collect()} == {("a", "changed"), ("b", "missing"), ("c", "new")}
    assert maintain.needs_merge(100, 20, 1) and maintain.needs_merge(100, 1, 8) and not maintain.needs_merge(100, 19, 7)
    c = maintain.Collection(spark, f"file://{tmp_path}/lib")
    ch = spark.createDataFrame([(1, 1, "x y"), (2, 2, "z w")], "chunk_id long, doc_id long, text string")
    c.publish(chunks=ch, postings=search.postings(ch), vectors=ch.select("chunk_id"))
    c.compact(spark.createDataFrame([(2,), (2,)], "doc_id long"))
    assert c.version() == 2 and [r.chunk_id for r in c.read("chunks").collect()] == [1] and c.read("vectors").count() == 1


def test_metrics(spark):
    s = spark.createDataFrame([("m", float(x), 100.0 + 2 * x) for x in (1, 2, 4)] + [("flat", 1.0, 1.0), ("flat", 1.0, 2.0)], "g string, x double, y double")
    f = metrics.fit(s, "g", "x", "y").collect()
    assert [(r.g, r.base, r.slope, r.top_slope, r.deviation) for r in f] == [("m", 100.0, 2.0, 2.0, 0.0)]
    rows = spark.createDataFrame([(1, i, i in (2, 3, 5, 6, 7, 8)) for i in range(10)], "g int, i int, bad boolean")
    assert [(r.i, r.run) for r in metrics.streaks(rows, "g", ["i"], F.col("bad"), 2).orderBy("i").collect()] == [(3, 2), (6, 2), (8, 4)]
    assert metrics.summary(rows.limit(0).withColumn("s", F.lit(1.0)), ["g"], "s", "s", F.col("bad")).count() == 0


def test_history(spark):
    m = spark.createDataFrame([(1, i, r, f"c{i}") for i, r in enumerate(["system", "user", "assistant", "tool", "tool", "assistant", "user"])], "conv int, seq int, role string, content string")
    assert [r.turn for r in history.turns(m, "conv", "seq").orderBy("seq").collect()] == [0, 1, 1, 1, 1, 1, 2]
    assert sorted(r.seq for r in history.compact(m, "conv", "seq", 4).collect()) == [2, 3, 4, 5, 6]
    assert history.compact(m, "conv", "seq", 0).count() == 0
    assert [tuple(r) for r in history.answers(m, "conv", "seq").collect()] == [(1, 1, 2, "c2\n\nc5")]


def test_scan_gives_terms_and_scores_of_the_index(spark):
    from codexmill.operators import scan

    texts = ["net/http C++ fooBar x2 Ёлка ёлки", "state-of-the-art ab-ab c# ²x Ⅷ a_b_ running ran ИДУТ", None, "", "y " * 50 + "naïve é ½ tail", "q" * 41 + " qq-" + "w" * 45]
    c = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string")
    for stems in (False, True):
        want = sorted((r.chunk_id, r.term) for r in search.analysed(c, "chunk_id", stems=stems).collect())
        assert sorted((i, t) for i, x in enumerate(texts) for t in scan.terms(x, stems)) == want
    words = [f"w{chr(97 + i)}{'xyz'[i % 3]}" for i in range(26)]
    rows = [(i, " ".join(words[j] for j in range(26) for _ in range((i * (j + 3) + i // 7) % 11 // (1 + j // 4)))) for i in range(300)] + [(i, words[0] + " rest") for i in range(300, 340)]
    c = spark.createDataFrame(rows, "chunk_id long, text string")
    q = c.where("chunk_id % 10 = 0").selectExpr("chunk_id query_id", "text")
    p = search.postings(c, True)
    want = search.top(search.bm25(q, p, search.lengths(p, c), stems=True), 5).collect()
    got = search.bm25_texts(q, c, 5).collect()
    key = lambda rows: sorted((r.query_id, r["rank"], r.chunk_id, r.matched, pytest.approx(r.score, abs=2e-6)) for r in rows)
    assert len(want) > 100 and [x[:4] for x in key(got)] == [x[:4] for x in key(want)] and [x[4].expected for x in key(got)] == [x[4] for x in key(want)]


def test_tasks_give_out_the_best_only():
    import numpy as np
    import pyarrow as pa

    from codexmill.operators import scan

    rng = np.random.default_rng(0)
    texts = [" ".join(f"t{x}" for x in rng.integers(0, 60, 12)) for _ in range(12_000)]
    names, of, begins = np.arange(3), np.repeat([[0, 1, 2]], 60, axis=0).ravel(), np.arange(0, 181, 3)
    asked = scan.Asked(names, of, np.linspace(1, 3, 60), begins, [f"t{i}" for i in range(60)])
    batches = [pa.record_batch({"chunk_id": pa.array(range(a, a + 3000)), "text": pa.array(texts[a : a + 3000])}) for a in range(0, 12_000, 3000)]
    assert sum(b.num_rows for b in asked.best(iter(batches), 10, 12.0)) < 3 * 30  # not the best of every batch, let alone all
