import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codexmill.functions.diff import diff_ops, diff_stat, line_ops
from codexmill.operators import embedding
from codexmill.sources import records

lines = st.lists(st.sampled_from("abcd"), max_size=9).map("\n".join)


@settings(max_examples=200, deadline=None)
@given(lines, lines)
def test_diff_rebuilds_both_sides(a, b):
    ops = line_ops(a, b)
    assert "\n".join(x for o, x in ops if o != "+") == a and "\n".join(x for o, x in ops if o != "-") == b

    def lcs(x, y):
        t = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, p in enumerate(x):
            for j, q in enumerate(y):
                t[i + 1][j + 1] = t[i][j] + 1 if p == q else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    assert sum(o == " " for o, _ in ops) == lcs(a.split("\n"), b.split("\n"))


def test_diff_columns(spark):
    df = spark.createDataFrame([("a\nb", "a\nc\nd"), (None, "x")], "old string, new string")
    got = df.select(diff_stat(diff_ops("old", "new")).alias("s")).collect()
    assert [(r.s.added, r.s.removed) for r in got] == [(2, 1), (1, 1)]


def test_embedding_resumes_and_halves(spark):
    chunks = spark.createDataFrame([(1, 1, 3, "alpha beta"), (2, 9, 1, None), (3, 1, 4, "gamma")], "chunk_id long, doc_id long, unit_from int, text string")
    books = spark.createDataFrame([(1, "Title", "/x/y.pdf")], "id long, title string, path string")
    first = embedding.embed(embedding.inputs(chunks.where("chunk_id = 1"), books), embedding.word_hashing(8), "m")
    rest = embedding.embed_missing(chunks, books, first, embedding.word_hashing(8), "m")
    assert sorted(r.chunk_id for r in rest.collect()) == [2, 3]
    assert embedding.coverage(chunks, first, "m").first().percent == 33
    assert {r.chunk_id: r.text for r in embedding.inputs(chunks, books).collect()}[1] == "Title · p. 3\nalpha beta"
    sizes = []

    def picky(texts):
        sizes.append(len(texts))
        if len(texts) > 2:
            raise RuntimeError("too many")
        return [[1.0]] * len(texts)

    assert len(embedding.call(picky, ["x"] * 7, 8)) == 7 and max(sizes[2:]) == 2


def test_records(spark, tmp_path):
    (tmp_path / "reg.jsonl").write_text('{"seq": 1, "path": "a"}\nbroken {\n{"seq": 2, "path": "a"}\n')
    assert sorted(r.seq for r in records.json_lines(spark, str(tmp_path / "reg.jsonl"), records.BOOK).collect()) == [1, 2]
    (tmp_path / "s").mkdir()
    (tmp_path / "s/one.toml").write_text('name = "one"\n[[tasks]]\nid = "a"\nprompt = "p"\nscores = [0.5, 0.4]\n[[tasks]]\nid = "b"\nprompt = "q"\nscores = [1.0, -1.0]\n[[tasks]]\nid = "b"\nprompt = "q"\n')
    tasks = records.suites(spark, str(tmp_path / "s"))
    assert {(r.id, r.problem) for r in records.suite_problems(tasks).collect()} == {("a", "scores don't add up"), ("b", "repeated id")}
    models = spark.createDataFrame([("m1", ["completion", "tools"]), ("m2", ["embedding"]), ("m3", ["completion"])], "name string, capabilities array<string>")
    got = {r.name: r.skipped for r in records.eligible(models, ["m3"]).collect()}
    assert got == {"m1": "", "m2": "no completion", "m3": "excluded"}
    need = models.select("name", records.missing_capability(F.col("capabilities"), F.array(F.lit("completion"), F.lit("vision"))).alias("x"))
    assert {r.name: r.x for r in need.collect()} == {"m1": "vision", "m2": "completion", "m3": "vision"}
    m = spark.createDataFrame([(1, i, "user", f"c{i}") for i in random.Random(1).sample(range(5), 5)], "conv int, seq int, role string, content string")
    records.save_sessions(m, "conv", "seq", str(tmp_path / "out"))
    saved = records.json_lines(spark, str(tmp_path / "out"), records.SESSION).first()
    assert [x.content for x in saved.messages] == [f"c{i}" for i in range(5)]
