"""Text that was decoded with the wrong character encoding: find it and restore the original.

Method: round-trip repair. A segment (sentence or line) is re-encoded under candidate legacy encodings, its bytes are
decoded strictly as an intended encoding, and the result is kept when a garbling cost drops; that is repeated for
nested layers. A cheap pattern in the JVM keeps texts without any suspect character away from Python.
"""

from __future__ import annotations

import codecs
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Encodings a text may have been read in by mistake, and those it may have been written in.
READ_AS = ("cp1252", "cp1251", "koi8_r", "cp866", "cp437", "latin_1", "iso8859_5", "cp850")
WRITTEN_AS = ("cp1251", "koi8_r", "cp866", "cp1252")  # and UTF-8, which is tried first
#: Characters beyond ASCII from which on single bytes can tell one encoding from another; below, only loan words and quotes may come out.
FEW = 4
#: Nested layers that are undone at most.
LAYERS = 4

# How often each letter occurs in Russian text, per 10,000 letters.
RUSSIAN = dict(zip("оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъё", (1097, 845, 801, 735, 670, 626, 547, 473, 454, 440, 349, 321, 298, 281, 262, 201, 190, 174, 170, 165, 159, 144, 121, 97, 94, 73, 64, 48, 36, 32, 26, 4, 40), strict=True))
# Characters that belong to normal text beside ASCII and Russian letters, and accented letters of loan words.
TYPOGRAPHY = "“”‘’—–…«»№•"
ACCENTED = "áâàäçéèêëíîïñóôöúûü"

#: A division mark before a line end is no sign of a wrong encoding.
ODD = f"[^\\x00-\\x7Fа-яА-ЯёЁ{TYPOGRAPHY}{ACCENTED}¬\\xad]|[¬\\xad](?! *(?:\n|$))|[À-ÿ]{{2}}|[a-zA-Z][а-яёА-ЯЁ]|[а-яёА-ЯЁ][a-zA-Z]|[а-яё][А-ЯЁ]|[А-ЯЁ]{{2}}|(?:^| )[А-Яа-яЁё] [a-z]|[a-z] [А-Яа-яЁё](?: |$)"
_odd = re.compile(ODD)
_strange = re.compile(f"[^\\x00-\\x7Fа-яА-ЯёЁ{TYPOGRAPHY}{ACCENTED}]")
_foreign = re.compile(f"[^\\x00-\\x7F{TYPOGRAPHY}{ACCENTED}]")
#: Segments end at sentence ends and line ends; only the ASCII space and line feed part them, as others may be debris.
_parts = re.compile("((?<=[.?!]) +|\n+)")
_mixed = re.compile("[a-zA-Z](?=[а-яёА-ЯЁ])|[а-яёА-ЯЁ](?=[a-zA-Z])")
_camel = re.compile("[а-яё](?=[А-ЯЁ])")
_pairs = re.compile("[À-ɏ](?=[À-ɏ])")
_alone = re.compile("(?:(?<=[a-z] )|^)[А-Яа-яЁё](?= [a-z])")


def _char_cost(o: int) -> float:
    c = chr(o)
    if o < 0x20 and c not in "\t\n\r" or 0x7F <= o < 0xA0:
        return 5.0
    if o < 0x80:
        return 1.0
    if (low := c.lower()) in RUSSIAN:
        return 0.22 * -math.log2(RUSSIAN[low] / 10_000)
    if c in TYPOGRAPHY:
        return 1.0
    if c in ACCENTED:
        return 1.6
    if 0xC0 <= o < 0x250 and c not in "×÷":
        return 2.2
    if 0x400 <= o < 0x530 or 0x370 <= o < 0x400:
        return 3.0
    if o == 0xFFFD or 0xE000 <= o < 0xF900:
        return 6.0
    if 0x2500 <= o < 0x25A0 or 0x2320 <= o < 0x2322:
        return 4.0
    if o == 0xA0:
        return 1.5
    return 3.0


_costs = [_char_cost(o) for o in range(0x10000)]


def cost(text: str) -> float:
    """How garbled a text looks: the sum over its characters and over impossible neighbourhoods."""
    total = sum([_costs[ord(c)] if c < "\U00010000" else 2.0 for c in text])
    if not text.isascii():
        total += 4.0 * len(_mixed.findall(text)) + 2.0 * len(_camel.findall(text)) + 1.5 * len(_pairs.findall(text)) + 2.0 * len(_alone.findall(text))
    return total


def _map(encoding: str):
    """Characters to bytes; bytes that the encoding doesn't define may have been shown as control characters."""
    shown = [bytes([k]).decode(encoding, "ignore") or chr(k) for k in range(256)]
    return codecs.charmap_build("".join(shown))


_maps = {e: _map(e) for e in READ_AS}


def _bytes(text: str, encoding: str) -> bytes | None:
    """The bytes that `encoding` shows as text."""
    try:
        return codecs.charmap_encode(text, "strict", _maps[encoding])[0]
    except UnicodeEncodeError:
        return None


def _essence(text: str) -> str:
    """What the choice of encodings rests on: the words with characters beyond ASCII, all words where these are many."""
    words = [w for w in text.split(" ") if not w.isascii()]
    if sum(map(len, words)) * 4 > len(text) or any(len(w) == 1 for w in words):
        return text
    return " ".join(words)


def _step(text: str) -> tuple[str, str] | None:
    """The best way to undo one layer, if any lowers the cost by enough: text and encodings."""
    part = _essence(text)
    raws: dict[bytes, str] = {}
    for read in READ_AS:
        if (raw := _bytes(part, read)) is not None:
            raws.setdefault(raw, read)
    if not raws:
        return None
    was = cost(part)
    need = max(1.2, 0.01 * was)
    best = was - need, "", ""
    for raw, read in raws.items():
        try:
            got = raw.decode("utf_8")  # a strict decoding of several bytes a character is no accident
        except UnicodeDecodeError:
            continue
        if got != part and (now := cost(got)) < best[0]:
            best = now, "utf_8", read
    if not best[1]:
        for raw, read in raws.items():
            for written in WRITTEN_AS:
                if written != read:
                    try:
                        got = raw.decode(written)
                    except UnicodeDecodeError:
                        continue
                    if (now := cost(got)) < best[0] and (sum(c > "\x7f" for c in part) >= FEW or not _foreign.search(got)):
                        best = now, written, read
    if not best[1]:
        return None
    try:
        return _bytes(text, best[2]).decode(best[1]), f"{best[1]}>{best[2]}"
    except (AttributeError, UnicodeDecodeError):
        return None


def _lossy(text: str, was: float) -> str | None:
    """A layer that can't be undone wholly since bytes are missing: the encodings, if what remains of it is clearly text."""
    for read in ("cp1251", "cp1252", "latin_1", "koi8_r", "cp866", "cp437"):
        raw, lost = bytearray(), 0
        for c in text:
            b = _bytes(c, read)
            if b is None:
                lost += 1
            else:
                raw += b
        got = raw.decode("utf_8", "replace")
        broken = got.count("�")
        multi = sum(1 for c in got if ord(c) > 127 and c != "�")
        if multi >= 3 and broken + lost <= 0.6 * multi and cost(got.replace("�", "")) < 0.75 * was:
            return f"utf_8>{read}"
    return None


def repair_segment(text: str) -> tuple[str, str, bool] | None:
    """(restored text, encodings by layer, lost) of a garbled segment; None if it isn't garbled."""
    if not _odd.search(text):
        return None
    if "�" in text:
        return text, "", True
    now, how = text, []
    for _ in range(LAYERS):
        got = _step(now)
        if got is None:
            break
        now, layer = got
        how.append(layer)
        if not _odd.search(now):
            break
    if how:
        return now, " ".join(how), False
    if len(_strange.findall(text)) >= 4 and (layer := _lossy(text, cost(text))):
        return text, layer, True
    return None


def repair_text(text: str) -> tuple[str, str, bool] | None:
    """As repair_segment(), over the segments of a whole text; the separators stay as they are."""
    parts, how, lost, any_ = _parts.split(text), [], False, False
    for k in range(0, len(parts), 2):
        got = repair_segment(parts[k])
        if got:
            any_ = True
            parts[k], lost = got[0], lost or got[2]
            if got[1]:
                how.append(got[1])
    return ("".join(parts), ", ".join(dict.fromkeys(how)), lost) if any_ else None


_SCHEMA = "chunk_id long, written_at timestamp, restored string, encodings string, lost boolean"


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        restored, how, lost = [None] * n, [None] * n, [None] * n
        text = batch.column("suspect")
        for i in range(n) if text.null_count < n else ():
            if text[i].is_valid and (got := repair_text(text[i].as_py())):
                restored[i], how[i], lost[i] = got
        yield pa.record_batch({"chunk_id": batch.column("chunk_id"), "written_at": batch.column("written_at"), "restored": pa.array(restored, pa.string()), "encodings": pa.array(how, pa.string()), "lost": pa.array(lost, pa.bool_())})


def garbled(chunks: DataFrame) -> DataFrame:
    """(chunk_id, restored, encodings, lost) of every current chunk with a garbled sentence.

    restored is the text with all restorable sentences put right; lost says that at least one could not be. encodings
    names what was undone, written>read, one per layer. Null texts and null chunk_id give nothing, texts of any length
    are worked through whole, repeated rows count once. Rows are repaired where they are read: only keys and the few
    restored texts are shuffled to find the current row of a chunk.
    """
    suspect = chunks.select("chunk_id", "written_at", F.when(F.col("text").rlike(ODD), F.col("text")).alias("suspect")).where("chunk_id is not null")
    done = suspect.mapInArrow(_repair, _SCHEMA)
    last = F.max(F.struct(F.col("written_at").isNotNull().alias("h"), "written_at", "restored", "encodings", "lost"))
    return done.groupBy("chunk_id").agg(last.alias("m")).where("m.restored is not null").select("chunk_id", "m.restored", "m.encodings", "m.lost")
