"""Text functions as column expressions: analysis, line classes, measures, and small formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A word is runs of letters and digits with connectors within, and + or # at its end.
WORD = r"[\p{L}\p{Nd}]+(?:[+#]*[._\-+#/][\p{L}\p{Nd}]+|[+#]+)*"
CONNECTORS = r"[._\-+#/]+"
SHORTEST, LONGEST = 2, 40
# Beginnings of lines of code and of shell sessions.
CODE_STARTS = ("func ", "class ", "def ", "package ", "import ", "#include", "public ", "private ", "var ", "const ", "let ", "return ", "if (", "for (", "while (", "$ ", "> ", "# ", "sudo ", "docker ", "kubectl ", "git ")
CODE, TABLE, RU, EN = 1, 2, 4, 8
# HTML entities that the rough conversion knows, the ampersand last.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&mdash;", "—"), ("&laquo;", "«"), ("&raquo;", "»"), ("&amp;", "&"))
TOC_LINE = r"[.·•․‧]{4,}\s*\d+\s*$"


def let(value: Column, body) -> Column:
    """body(value) with value worked out once, where body uses it within a lambda for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def raw_words(text: Column) -> Column:
    """Words as they stand in a text; null gives an empty array."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def normal(word: Column) -> Column:
    """Lower case, ё as е, without connectors at its ends (a trailing + or # stays)."""
    return F.regexp_replace(F.translate(F.lower(word), "ё", "е"), r"^[._\-+#/]+|[._\-/]+$", "")


def fits(term: Column) -> Column:
    return F.length(term).between(SHORTEST, LONGEST)


def terms(text: Column) -> Column:
    """Surface terms of a text in order: normalised words of 2 to 40 characters."""
    return F.filter(F.transform(raw_words(text), normal), fits)


def is_identifier(word: Column) -> Column:
    """Connectors within, a small letter before a capital, or letters mixed with digits: such a word isn't stemmed."""
    return word.rlike(r"[\p{L}\p{Nd}][._\-+#/]|\p{Ll}\p{Lu}|\p{L}\p{Nd}|\p{Nd}\p{L}|[+#]$")


def shingles(text: Column) -> Column:
    """Distinct runs of three words of a text in lower case, parted by white space; none under three words."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    runs = lambda w: F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.array_join(F.slice(w, i, 3), " ")))
    return let(words, lambda w: F.when(F.size(w) >= 3, runs(w)).otherwise(F.array().cast("array<string>")))


def has_cyrillic(text: Column) -> Column:
    return text.rlike("[а-яА-ЯёЁ]")


def has_latin(text: Column) -> Column:
    return text.rlike("[a-zA-Z]")


def lang_flags(text: Column) -> Column:
    return F.when(has_cyrillic(text), RU).otherwise(0) + F.when(has_latin(text), EN).otherwise(0)


def looks_like_code(line: Column) -> Column:
    """A code beginning, or an indent of two with many signs of programs."""
    bare = F.regexp_replace(line, r"^[ \t]+", "")
    starts = F.lit(False)
    for p in CODE_STARTS:
        starts = starts | bare.startswith(p)
    signs = F.length(bare) - F.length(F.regexp_replace(bare, r"[{};()=<>/*\[\]]", ""))
    return (bare != "") & (starts | ((F.length(line) - F.length(bare) >= 2) & (signs * 8 >= F.length(bare))))


def line_flags(line: Column) -> Column:
    return F.when(line.contains(" | "), TABLE).otherwise(0) + F.when(looks_like_code(line), CODE).otherwise(0)


def worth_indexing(text: Column) -> Column:
    """At least 12 characters beside white space, a third of them letters."""
    solid = F.length(F.regexp_replace(text, r"[\s\p{Z}]", ""))
    return (solid >= 12) & (F.length(F.regexp_replace(text, r"[^\p{L}]", "")) * 3 >= solid)


def normal_line(line: Column) -> Column:
    """A line without digits, in lower case, with single blanks: the same for a running header of every page."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(line, r"\p{Nd}", "")), r"\s+", " "))


def normal_title(title: Column) -> Column:
    """Letters and blanks only, in lower case; digits and ё are dropped."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(title), "[^a-zа-я ]", ""), " +", " "))


def html_entities(text: Column) -> Column:
    """Named entities as the characters they stand for."""
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def html_to_text(html: Column) -> Column:
    """Rough text of HTML: scripts and styles dropped, some tags as line breaks, entities in one pass, lines trimmed."""
    t = F.regexp_replace(html, r"(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>", "")
    t = F.regexp_replace(t, r"(?i)<br ?/?>|</(?:p|div|h1|h2|h3|h4|li|tr)>", "\n")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", "")
    t = html_entities(t)
    lines = F.array_join(F.transform(F.split(t, "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", ""))), "\n")
    return F.regexp_replace(F.regexp_replace(lines, "\n{3,}", "\n\n"), r"^\n+|\n+$", "")


def mixed_script_words(text: Column) -> Column:
    """How many words hold both Cyrillic and Latin letters."""
    words = F.regexp_extract_all(text, F.lit("[а-яА-ЯёЁa-zA-Z0-9_']+"), F.lit(0))
    return F.coalesce(F.size(F.filter(words, lambda w: has_cyrillic(w) & has_latin(w))), F.lit(0))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[\p{L}\p{Nd}_\-]+")), F.lit(0))


def token_estimate(text: Column) -> Column:
    """Tokens guessed from bytes: a third of them, rounded."""
    return F.floor((F.coalesce(F.octet_length(text), F.lit(0)) + 2) / 3)


# How a refusal is worded.
REFUSALS = (
    "не могу помочь", "не могу предоставить", "не буду помогать", "это может быть незаконн",
    "i can'?t help", "i cannot assist", "i'?m sorry,? but i can'?t",
)


def refused(answer: Column) -> Column:
    """An answer that begins as a refusal, by its first 1200 bytes in UTF-8; null is none."""
    head = F.make_valid_utf8(F.substring(F.encode(answer, "UTF-8"), 1, 1200).cast("string"))
    return F.coalesce(head.rlike("(?iu)" + "|".join(REFUSALS)), F.lit(False))


def longest_block(answer: Column, lang: str) -> Column:
    """The longest fenced block of a language, else the longest of all; null without one."""
    fence = "```"
    blocks = lambda tag: F.regexp_extract_all(answer, F.lit(f"(?s){fence}{tag}[ \\t]*\\n(.*?){fence}"), F.lit(1))
    longest = lambda a: F.get(F.transform(F.array_sort(F.transform(a, lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x")))), lambda s: s["x"]), F.lit(0))
    return F.coalesce(longest(blocks(lang)), longest(blocks(r"[^\n`]*")))


def snake(name: Column) -> Column:
    """A name safe for files: colon, slash and blank become an underscore."""
    return F.translate(name, ":/ ", "___")


def short_number(n: Column) -> Column:
    """999, 1.2k, 3.4M."""
    return F.when(n < 1000, n.cast("string")).when(n < 1_000_000, F.format_string("%.1fk", n / 1000.0)).otherwise(F.format_string("%.1fM", n / 1_000_000.0))


def human_size(n: Column) -> Column:
    """Bytes as B, KiB, MiB or GiB."""
    return F.when(n < 1 << 10, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, F.format_string("%.1f KiB", n / 1024.0)).when(n < 1 << 30, F.format_string("%.1f MiB", n / 1048576.0)).otherwise(F.format_string("%.1f GiB", n / 1073741824.0))


def parse_tokens(text: Column) -> Column:
    """32k, 1m, with Latin or Cyrillic suffix and binary multiples; null if it is no such number."""
    n = F.try_to_number(F.nullif(F.regexp_extract(F.lower(F.trim(text)), r"^(\d{1,9})([kкmм]?)$", 1), F.lit("")), F.lit("999999999")).cast("long")
    unit = F.regexp_extract(F.lower(F.trim(text)), r"^(\d{1,9})([kкmм]?)$", 2)
    return n * F.when(unit.isin("k", "к"), 1024).when(unit.isin("m", "м"), 1048576).otherwise(1)


def glob_regex(glob: str) -> str:
    """A path glob as a regular expression: ** crosses folders, * and ? don't."""
    import re

    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(glob[i], re.escape(glob[i]))
            i += 1
    return f"^{out}$"


def error_kind(message: Column) -> Column:
    """What kind of failure an extraction error is."""
    m = F.lower(message)
    return F.when(m.contains("no text"), "scan").when(m.contains("encoding") | m.contains("unmapped"), "garbled").when(m.contains("limit"), "skipped").when(m.isNotNull(), "broken")

