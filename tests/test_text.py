import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codexmill.functions import text as T
from codexmill.functions.stem import english, russian, stem
from codexmill.operators.chunking import sentences


@pytest.mark.parametrize("words", ["channel channels", "connect connected connecting connection connections", "relational relate", "hop hopped hopping", "happy happi", "buffer buffered buffers"])
def test_english_groups(words):
    assert len({english(w) for w in words.split()}) == 1


@pytest.mark.parametrize("words", ["канал каналы канала каналов", "сигнал сигналы сигналов", "книга книги книгу книгой", "быстрый быстрая быстрые быстрого", "индекс индексы индексов"])
def test_russian_groups(words):
    assert len({russian(w) for w in words.split()}) == 1


def test_stem_by_alphabet():
    assert stem("utf8") == "utf8" and stem("x") == "x" and stem("го") == "го"
    assert russian("данные") != "да"


@settings(max_examples=300, deadline=None)
@given(st.text("aeiouybcdsltrnz", max_size=14), st.text("аеиоуыябвнстльй", max_size=14))
def test_stems_never_grow_and_never_fail(a, b):
    assert len(english(a)) <= len(a) + 1
    assert b.startswith(russian(b)) or not b


def test_words(spark):
    texts = ["C++ and C# in v1.2, utf-8/koi8-r; HTTPClient x86_64", "Ёж и ёлка", "", None, "a" * 100]
    got = [r.t for r in spark.createDataFrame([(x,) for x in texts], "x string").select(T.terms(F.col("x")).alias("t")).collect()]
    assert got[0] == ["c++", "and", "c#", "in", "v1.2", "utf-8/koi8-r", "httpclient", "x86_64"]
    assert got[1] == ["еж", "елка"] and got[2:] == [[], [], []]


def test_columns(spark):
    rows = [("<p>a&amp;lt;b</p><script>x</script><br>c",), ("```py\nx\n```\n```go\nlonger\n```",), (None,)]
    df = spark.createDataFrame(rows, "x string")
    r = df.select(T.html_to_text(F.col("x")).alias("h"), T.longest_block(F.col("x"), "py").alias("b"), T.token_estimate(F.col("x")).alias("t"), T.mixed_script_words(F.col("x")).alias("m")).collect()
    assert r[0].h == "a&lt;b\n\nc" and r[1].b == "x\n" and r[2].h is None and r[2].t == 0 and r[2].m == 0
    sizes = spark.range(1).select(T.short_number(F.lit(1234)).alias("a"), T.human_size(F.lit(1536)).alias("b"), T.parse_tokens(F.lit("32к")).alias("c"), T.parse_tokens(F.lit("x")).alias("d")).first()
    assert tuple(sizes) == ("1.2k", "1.5 KiB", 32768, None)
    assert re.match(T.glob_regex("/a/**/*.pdf"), "/a/b/c/d.pdf") and not re.match(T.glob_regex("/a/*.pdf"), "/a/b/c.pdf")


def test_sentences():
    assert sentences("См. рис. 3. Далее текст. А. С. Пушкин писал! v1.2 is out. New one") == ["См. рис. 3.", "Далее текст.", "А. С. Пушкин писал! v1.2 is out.", "New one"]
    assert sentences("One. Two? three. Four") == ["One.", "Two? three.", "Four"]
    assert sentences("") == []


def test_small_parsers(spark):
    from pyspark.sql import functions as F

    from codexmill.functions import small

    rows = [("44", None), (" 40-60 ", "a/12#37"), ("", "12#37"), ("5-2", "b/1#1"), ("x", "12-37"), ("0", "a/99999999999#1"), (None, None)]
    df = spark.createDataFrame([(a, b, "a") for a, b in rows], "s string, r string, c string")
    got = df.select(small.page_spec(F.col("s")).alias("p"), small.chunk_ref(F.col("r"), F.col("c")).alias("k")).collect()
    assert [tuple(x.p) if x.p else None for x in got] == [(44, 1), (40, 21), (1, 0), None, None, None, None]
    assert [tuple(x.k) for x in got] == [(None, None, "malformed"), (12, 37, None), (12, 37, None), (None, None, "other collection"), (None, None, "malformed"), (None, None, "malformed"), (None, None, "malformed")]
    texts = spark.createDataFrame([("ёж" * 10,), ("ab",), (None,), ("  a\n\n    b\n",)], "t string")
    cut = [r[0] for r in texts.select(small.cut_bytes(F.col("t"), 7)).collect()]
    assert cut[0] == "ёжё\n\n[cut: 6 of 40 bytes]" and cut[1:3] == ["ab", None]
    assert [r[0] for r in texts.select(small.without_common_indent(F.col("t"))).collect()][3] == "a\n\n  b\n"
    names = spark.createDataFrame([("ok_Name-1",), ("",), ("has space",), ("я",), ("x" * 65,), (None,)], "n string")
    assert [r[0] for r in names.select(small.valid_name(F.col("n"))).collect()] == [True, False, False, False, False, False]
    assert spark.sql("select 1").select(small.bar(F.lit(5), F.lit(0), 3), small.bar(F.lit(5), F.lit(10), 4), small.percent(F.lit(30), F.lit(10)), small.per_second(F.lit(0), F.lit(1))).first() == ("░░░", "██░░", 100, 0.0)
    html = spark.createDataFrame([('<A HREF="x">a <b>b</b></A><a href="">no</a><a>no</a><abbr>z</abbr>',), (None,), ("",)], "h string")
    assert [[tuple(x) for x in r[0] or []] for r in html.select(small.links(F.col("h"))).collect()] == [[("x", "a b")], [], []]


def test_refusals_by_bytes(spark):
    from pyspark.sql import functions as F

    from codexmill.functions import text as T

    rows = ["I'm sorry, but I can't do that", "I'm sorry, but here it is", "Я не буду помогать", "ё" * 590 + "i cannot assist", "ё" * 600 + "i cannot assist", None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in rows], "a string").select(T.refused(F.col("a"))).collect()]
    assert got == [True, False, True, True, False, False]


def test_books_by_text_and_name(spark):
    from codexmill.operators import maintain

    books = spark.createDataFrame([(1, 1, "/l/A.pdf", "Go in Action", None, "ok"), (2, 2, "/l/b/A.pdf", None, "Gopher", "ok"), (3, 3, "/l/c.pdf", "go", None, "scan"), (4, 4, "/l/d.pdf", "x", None, "gone")], "seq long, id long, path string, title string, author string, kind string")
    want = spark.createDataFrame([("GO",), ("none",), (None,)], "want string")
    assert sorted(map(tuple, maintain.books_matching(books, want).collect())) == [("GO", 1), ("GO", 2)]
    names = spark.createDataFrame([("A.pdf",), ("/l/b/A.pdf",), ("d.pdf",)], "want string")
    assert sorted(map(tuple, maintain.books_named(books, names).collect())) == [("/l/b/A.pdf", 2), ("A.pdf", 1)]
