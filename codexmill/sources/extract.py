"""Text extraction from files: EPUB packages, PDF files and HTML pages to (path, unit_no, title, text, error) rows.

Files come through Spark's binaryFile source; the parsers run in Arrow batches, and a file that can't be read is a row
with an error, never a failed job.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexmill.sources.pdf import read_pdf

# Elements that part blocks, that end a line, and whose content is no text.
BLOCKS = frozenset("h1 h2 h3 h4 h5 h6 p div pre blockquote table ul ol section article".split())
BREAKS = frozenset("br tr li dt dd".split())
SILENT = frozenset("script style head title".split())
UNITS = "path string, kind string, book_title string, author string, unit_no int, title string, text string, error string"


class Page(HTMLParser):
    """Tolerant HTML to text: bullets, cells joined by bars, figures marked, blank lines between blocks."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.silent = 0
        self.pre = 0
        self.in_title = False
        self.title = ""
        self.cells = 0
        self.links: list[tuple[str, str]] = []
        self._href: str | None = None
        self._link = ""

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.in_title |= tag == "title"
        if tag in SILENT:
            self.silent += 1
        elif tag in BLOCKS:
            self.out.append("\n\n")
            self.pre += tag == "pre"
        elif tag in BREAKS:
            self.out.append("\n• " if tag == "li" else "\n")
            self.cells = 0
        elif tag in ("td", "th"):
            self.out.append(" | " if self.cells else "")
            self.cells += 1
        elif tag == "img":
            label = next((v for k, v in attrs if k == "alt" and v), "")
            self.out.append(f"[figure{': ' + label if label else ''}]")
        elif tag == "a":
            self._href, self._link = next((v for k, v in attrs if k == "href" and v), None), ""

    def handle_endtag(self, tag: str) -> None:
        if tag in SILENT:
            self.silent = max(0, self.silent - 1)
            self.in_title &= tag != "title"
        elif tag in BLOCKS:
            self.out.append("\n\n")
            self.pre = max(0, self.pre - (tag == "pre"))
        elif tag == "a" and self._href:
            if label := " ".join(self._link.split()):
                self.links.append((self._href, label))
            self._href = None

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title += data
        if not self.silent:
            self._link += data
            if self.pre:
                self.out.append(data)
                return
            said = re.sub(r"\s+", " ", data)
            if not self.out or re.search(r"\s$", self.out[-1]):
                said = said.lstrip()  # white space is shown once
            if said:
                self.out.append(said)

    def text(self) -> str:
        return tidy("".join(self.out))


def tidy(text: str) -> str:
    """No-break spaces as spaces, no blanks at line ends, one blank line at most."""
    lines = [x.rstrip() for x in text.replace("\xa0", " ").split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip("\n")


def first_heading(text: str) -> str:
    line = next((x.strip() for x in text.split("\n") if x.strip() and not x.strip().startswith("[figure")), "")
    return line[:80] + ("…" if len(line) > 80 else "")


def read_html(data: bytes | str) -> Page:
    page = Page()
    page.feed(data.decode("utf-8", "replace") if isinstance(data, bytes) else data)
    page.close()
    return page


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def read_epub(data: bytes) -> tuple[str, str, list[tuple[str, str]]]:
    """(title, author, [(section title, text)]) by the spine; sections out of the reading order are left out.

    Damaged packages raise ValueError.
    """
    try:
        z = zipfile.ZipFile(io.BytesIO(data))
        names = z.namelist()
        opf = None
        if "META-INF/container.xml" in names:
            root = ElementTree.fromstring(z.read("META-INF/container.xml"))
            opf = next((e.get("full-path") for e in root.iter() if _local(e.tag) == "rootfile"), None)
        if opf not in names:
            opf = next((n for n in names if n.endswith(".opf")), None)
        if opf is None:
            raise ValueError("no package file")
        base, package = posixpath.dirname(opf), ElementTree.fromstring(z.read(opf))
        meta = {_local(e.tag): (e.text or "").strip() for e in reversed(list(package.iter())) if _local(e.tag) in ("title", "creator")}
        items = {e.get("id"): e for e in package.iter() if _local(e.tag) == "item"}
        place = lambda href: posixpath.normpath(posixpath.join(base, unquote(href.split("#")[0])))
        spine = [e.get("idref") for e in package.iter() if _local(e.tag) == "itemref" and e.get("linear") != "no"]
        order = [items[i] for i in spine if i in items] or [e for e in items.values() if "html" in (e.get("media-type") or "")]
        labels: dict[str, str] = {}
        for e in items.values():
            where = place(e.get("href") or "")
            if where in names and ("dtbncx" in (e.get("media-type") or "") or "nav" in (e.get("properties") or "")):
                if "dtbncx" in (e.get("media-type") or ""):
                    for point in (p for p in ElementTree.fromstring(z.read(where)).iter() if _local(p.tag) == "navPoint"):
                        label = next((t.text for t in point.iter() if _local(t.tag) == "text"), None)
                        href = next((c.get("src") for c in point.iter() if _local(c.tag) == "content"), None)
                        if label and href:
                            labels.setdefault(posixpath.normpath(posixpath.join(posixpath.dirname(where), unquote(href.split("#")[0]))), label.strip())
                else:
                    for href, label in read_html(z.read(where)).links:
                        labels.setdefault(posixpath.normpath(posixpath.join(posixpath.dirname(where), unquote(href.split("#")[0]))), label)
        out = []
        for e in order:
            where = place(e.get("href") or "")
            if where in names:
                page = read_html(z.read(where))
                text = page.text()
                out.append((labels.get(where) or page.title.strip() or first_heading(text), text))
    except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, RuntimeError, EOFError, NotImplementedError) as x:
        raise ValueError(f"damaged package: {x}") from x
    return meta.get("title", ""), meta.get("creator", ""), out


def kind_of(head: bytes) -> str:
    """epub, pdf, zip, html or unknown, by content and never by name."""
    if head[:4] == b"PK\x03\x04":
        return "epub" if b"application/epub+zip" in head[:200] else "zip"
    if b"%PDF-" in head[:1024]:
        return "pdf"
    return "html" if re.match(rb"\s*(?:<\?xml[^>]*>\s*)?<(?:!doctype html|html)", head[:512], re.I) else "unknown"


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for path, data in zip(batch["path"], batch["content"], strict=True):
            kind = kind_of(bytes(data[:1024]))
            try:
                if kind in ("epub", "zip"):
                    title, author, parts = read_epub(bytes(data))
                    if not any(t.strip() for _, t in parts):
                        raise ValueError("no text in the document")
                    rows += [(path, kind, title, author, k, name, text, None) for k, (name, text) in enumerate(parts, 1)]
                elif kind == "html":
                    page = read_html(bytes(data))
                    rows.append((path, kind, page.title.strip(), "", 1, page.title.strip() or first_heading(page.text()), page.text(), None))
                elif kind == "pdf":
                    title, author, pages = read_pdf(bytes(data))
                    rows += [(path, kind, title, author, k, first_heading(text), text, None) for k, text in enumerate(pages, 1)]
                else:
                    raise ValueError(f"no reader for {kind}")
            except ValueError as x:
                rows.append((path, kind, None, None, 0, None, None, str(x)[:200]))
        yield pd.DataFrame(rows, columns=["path", "kind", "book_title", "author", "unit_no", "title", "text", "error"])


def extract(files: DataFrame) -> DataFrame:
    """Units of files (path, content): one row per section, or one row with an error."""
    return files.select("path", "content").mapInPandas(_extract, UNITS)


def files(spark: SparkSession, folder: str, known: DataFrame | None = None, most_bytes: int = 512 << 20, limit: int | None = None) -> DataFrame:
    """(path, length, modificationTime, content) of books under a folder, hidden folders apart; content is only read
    where it is used. Files in `known` (path, size, mtime in seconds) that haven't changed are left out before."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{[eE][pP][uU][bB],[pP][dD][fF],[hH][tT][mM][lL]}").load(folder)
    f = f.where(~F.col("path").rlike(r"/\.[^/]+/")).where(F.col("length") <= most_bytes)
    if known is not None:
        k = known.select(F.col("path").alias("__p"), F.col("size").alias("__s"), F.col("mtime").alias("__m"))
        f = f.join(k, (f["path"] == F.col("__p")) & (f["length"] == F.col("__s")) & (F.unix_seconds(f["modificationTime"]) == F.col("__m")), "left_anti")
    return f.orderBy("path").limit(limit) if limit else f
