"""Small parsers and renderings as column expressions: numbers of pages, references, meters, cuts by bytes, links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codexmill.functions import text as T


def valid_name(name: Column) -> Column:
    """A name of 1 to 64 Latin letters, digits, hyphens and underscores; null is none."""
    return F.coalesce(name.rlike(r"\A[A-Za-z0-9_-]{1,64}\z"), F.lit(False))


def chunk_ref(ref: Column, collection: Column) -> Column:
    """struct(doc_id, ord, error) of `collection/doc#ord` or `doc#ord`.

    error is null, or `other collection`, or `malformed`, where doc and ord are null too.
    """
    part = lambda k: F.regexp_extract(ref, r"\A(?:([^/]*)/)?(\d{1,10})#(\d{1,10})\z", k)
    most = F.lit(4294967295)
    doc, ord_ = part(2).try_cast("long"), part(3).try_cast("long")
    other = ref.contains("/") & (F.substring_index(ref, "/", 1) != collection)
    bad = doc.isNull() | ord_.isNull() | (doc > most) | (ord_ > most)
    error = F.when(ref.isNull(), "malformed").when(other, "other collection").when(bad, "malformed")
    return F.struct(F.when(error.isNull(), doc).alias("doc_id"), F.when(error.isNull(), ord_).alias("ord"), error.alias("error"))


def page_spec(spec: Column) -> Column:
    """struct(first, count) of `44` or `40-60`; the empty spec is (1, 0), all from the first; null where it is malformed."""
    s = F.trim(spec)
    part = lambda k: F.regexp_extract(s, r"\A(\d{1,9})\s*(?:-\s*(\d{1,9}))?\z", k).try_cast("long")
    first, last = part(1), part(2)
    one = F.struct(first.alias("first"), F.when(last.isNull(), F.lit(1).cast("long")).otherwise(last - first + 1).alias("count"))
    return F.when(s == "", F.struct(F.lit(1).cast("long").alias("first"), F.lit(0).cast("long").alias("count"))).when((first >= 1) & (last.isNull() | (last >= first)), one)


def figure_label(label: Column) -> Column:
    """struct(unit, figure) of `N.M` or `N`; a second part that is no number is 0; null unless N is positive."""
    s = F.trim(label)
    unit = F.trim(F.substring_index(s, ".", 1)).try_cast("int")
    rest = F.trim(F.substring(s, F.instr(s, ".") + 1, F.length(s))).try_cast("int")
    return F.when(unit > 0, F.struct(unit.alias("unit"), F.when(s.contains("."), F.coalesce(rest, F.lit(0))).otherwise(F.lit(0)).alias("figure")))


def number_list(text: Column) -> Column:
    """`32k,64k` as whole numbers, positive ones only, in order."""
    return F.filter(F.transform(F.split(text, ","), T.parse_tokens), lambda n: n > 0)


def cut_bytes(text: Column, limit: int) -> Column:
    """A text of at most `limit` bytes in UTF-8, never within a character, with a note where something was cut."""
    raw = F.encode(text, "UTF-8")
    heads = [F.substring(raw, 1, limit - k).cast("string") for k in range(4)]
    head = F.coalesce(*[F.when(F.is_valid_utf8(h), h) for h in heads])
    note = F.concat(F.lit("\n\n[cut: "), F.octet_length(head).cast("string"), F.lit(" of "), F.octet_length(text).cast("string"), F.lit(" bytes]"))
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.concat(head, note))


def numbered(text: Column, offset: int = 1, limit: int = 2000) -> Column:
    """Lines of a text from `offset` (from 1), at most `limit`, each with its number, and which of how many are shown."""
    offset, limit = max(1, offset), limit if limit > 0 else 2000
    lines = F.split(text, "\n")
    n = F.size(lines)
    shown = F.transform(F.slice(lines, offset, limit), lambda x, i: F.concat(F.lpad((i + offset).cast("string"), 6, " "), F.lit("\t"), x, F.lit("\n")))
    end = F.least(n, F.lit(offset - 1 + limit))
    note = F.when(end < n, F.concat(F.lit(f"\n[lines {offset}-"), end.cast("string"), F.lit(" of "), n.cast("string"), F.lit("]\n"))).otherwise(F.lit(""))
    return F.when(n < offset, F.concat(F.lit("["), n.cast("string"), F.lit(f" lines, none from {offset}]\n"))).otherwise(F.concat(F.array_join(shown, ""), note))


def without_common_indent(text: Column) -> Column:
    """A text without the blanks that all its lines begin with, blank lines not counted."""
    lines = F.split(text, "\n")
    indent = lambda x: F.length(x) - F.length(F.ltrim(x))
    least = F.array_min(F.transform(F.filter(lines, lambda x: F.trim(F.regexp_replace(x, r"\s", " ")) != ""), indent))
    cut = F.transform(lines, lambda x: F.when(F.length(x) >= least, F.substring(x, least + 1, F.length(x))).otherwise(x))
    return F.when(least > 0, F.array_join(cut, "\n")).otherwise(text)


def links(html: Column) -> Column:
    """array<struct(href, text)> of anchors that have both; white space in the text is collapsed."""
    anchors = F.regexp_extract_all(html, F.lit(r"(?is)<a\b[^>]*>.*?</a\s*>"), F.lit(0))
    href = lambda a: F.regexp_extract(a, r"(?is)\A<a\b[^>]*?\bhref\s*=\s*[\"']([^\"']*)[\"']", 1)
    body = lambda a: F.trim(F.regexp_replace(T.html_entities(F.regexp_replace(a, "(?s)<[^>]*>", "")), r"\s+", " "))
    return F.filter(F.transform(anchors, lambda a: F.struct(href(a).alias("href"), body(a).alias("text"))), lambda x: (x["href"] != "") & (x["text"] != ""))


def percent(used: Column, capacity: Column) -> Column:
    """How full a window is, in whole percent up to 100; -1 where the capacity isn't known."""
    return F.when(capacity > 0, F.least(F.floor(used * 100 / capacity), F.lit(100))).otherwise(F.lit(-1)).cast("int")


def bar(used: Column, capacity: Column, width: int) -> Column:
    """A bar of that many characters."""
    filled = F.least(F.floor(F.greatest(percent(used, capacity), F.lit(0)) * width / 100), F.lit(max(width, 0))).cast("int")
    return F.concat(F.repeat(F.lit("█"), filled), F.repeat(F.lit("░"), F.lit(max(width, 0)) - filled))


def per_second(count: Column, nanoseconds: Column) -> Column:
    """A rate; 0 where either isn't positive."""
    return F.when((count > 0) & (nanoseconds > 0), count / (nanoseconds / 1e9)).otherwise(F.lit(0.0))
