import io
import zipfile

import pytest

from codexmill.sources.extract import extract, kind_of, read_epub, read_html


def epub(**files) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("mimetype", "application/epub+zip", zipfile.ZIP_STORED)
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="O/c.opf"/></rootfiles></container>')
        z.writestr(
            "O/c.opf",
            '<package xmlns:dc="d"><metadata><dc:title>T</dc:title><dc:creator>A</dc:creator></metadata><manifest><item id="a" href="a.xhtml" media-type="application/xhtml+xml"/><item id="b" href="b.xhtml" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="b"/><itemref idref="a" linear="no"/></spine></package>',
        )
        for k, v in files.items():
            z.writestr(f"O/{k}.xhtml", v)
    return out.getvalue()


def test_html():
    p = read_html("<title>T</title><style>x</style><h1>H</h1><p>one  two<br>three</p><ul><li>a<li>b</ul><table><tr><td>1</td><td>2</td></tr></table><img alt='x'><a href='u'>the  link</a>")
    assert p.title == "T" and p.links == [("u", "the link")]
    assert "one two\nthree" in p.text() and "• a" in p.text() and "1 | 2" in p.text() and "[figure: x]" in p.text() and "\n\n\n" not in p.text()


def test_epub():
    title, author, parts = read_epub(epub(a="<p>left out</p>", b="<h1>First</h1><p>text</p>"))
    assert (title, author) == ("T", "A") and [t for t, _ in parts] == ["First"] and parts[0][1].endswith("text")
    with pytest.raises(ValueError):
        read_epub(b"PK\x03\x04 broken")


def test_extract_keeps_failures_as_rows(spark):
    files = spark.createDataFrame([("good", bytearray(epub(a="<p>x</p>", b="<p>y</p>"))), ("bad", bytearray(b"PK\x03\x04xx")), ("pdf", bytearray(b"%PDF-1.4")), ("empty", bytearray(b""))], "path string, content binary")
    got = {r.path: r for r in extract(files).collect()}
    assert got["good"].text == "y" and got["good"].error is None
    assert got["bad"].error and got["pdf"].error and got["empty"].error
    assert kind_of(b"<!DOCTYPE html><html>") == "html"


@pytest.mark.parametrize("seed", range(60))
def test_damaged_packages_never_crash(seed):
    import random

    rng = random.Random(seed)
    data = bytearray(epub(a="<p>x</p>", b="<p>y</p>"))
    for _ in range(8):
        data[rng.randrange(len(data))] = rng.randrange(256)
    try:
        read_epub(bytes(data))
    except ValueError:
        pass
