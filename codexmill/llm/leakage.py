"""Evaluation texts that leaked into training texts.

Method: suffix arrays of the training words. Each shard (a bounded stretch of documents) is a sequence of word numbers
whose suffixes are sorted by prefix doubling; every suffix of every evaluation text is looked up in every shard by
binary search, which gives ranges of the array. Within a range the places are ordered by the word before them, so
only those where a match begins are taken out of it. Matches are extended to their full verbatim length by ranks of
doubled lengths and reported with their place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexmill.llm._words import slices, word_hashes
from codexmill.session import written

#: Evaluation words that are sent to every task at once; more of them are searched in several passes (bytes: 16 each).
BLOCK_WORDS = 2_000_000

SPANS = "doc_id long, item_id long, words long, doc_word long, item_word long"
#: A shard: ids and first words of its documents, its distinct words, and by place the number of the word and the
#: order of the suffixes, with the class that each shares with those of the same first words.
SHARDS = "docs binary, begins binary, names binary, numbers binary, suffixes binary, classes binary"


def normalised(column: str):
    """Words as a text parted by single spaces: runs of letters and digits in lower case."""
    return F.trim(F.regexp_replace(F.lower(column), "[^\\p{L}\\p{Nd}]+", " "))


def _doubled(rank: np.ndarray, step: int) -> np.ndarray:
    """Ranks of twice the length (or `step` more words), from 1; beyond the end stands 0."""
    nxt = np.zeros_like(rank)
    nxt[: len(rank) - step] = rank[step:] if step < len(rank) else 0
    return np.unique(rank * (int(rank.max(initial=0)) + 1) + nxt, return_inverse=True)[1].astype(np.int64) + 1


def suffix_order(numbers: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array by the first `depth` words, class of each suffix): equal first words make one class, in order."""
    rank, done = np.unique(numbers, return_inverse=True)[1].astype(np.int64) + 1, 1
    while done < depth:
        step = min(done, depth - done)
        rank = _doubled(rank, step)
        done += step
    return np.argsort(rank, kind="stable"), rank


class Shard:
    """Documents as one sequence of word numbers with its suffix array; the end of each has a number of its own."""

    def __init__(self, numbers: np.ndarray, names: np.ndarray, suffixes: np.ndarray, classes: np.ndarray, depth: int) -> None:
        self.numbers, self.names, self.suffixes, self.classes, self.depth = numbers, names, suffixes, classes, depth

    @classmethod
    def of(cls, words: np.ndarray, row: np.ndarray, depth: int) -> Shard:
        names, number = np.unique(words, return_inverse=True)
        ends = np.flatnonzero(np.concatenate((row[1:] != row[:-1], [True]))) + 1 if len(words) else np.zeros(0, np.int64)
        numbers = np.insert(number.astype(np.int64), ends, len(names) + np.arange(len(ends)))
        return cls(numbers, names, *suffix_order(numbers, depth), depth)

    def _find(self, test: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first, last + 1) in the suffix array of the suffixes that begin as test does at each place, by binary search."""
        first = np.flatnonzero(np.concatenate(([True], np.diff(self.classes[self.suffixes]) > 0)))
        heads = self.suffixes[first]  # one suffix of each class
        lo, hi = np.zeros(len(places), np.int64), np.full(len(places), len(heads))
        text = np.concatenate((self.numbers, np.full(self.depth, -1)))
        while True:
            live = np.flatnonzero(lo < hi)
            if not len(live):
                break
            mid = (lo[live] + hi[live]) // 2
            less, same = np.zeros(len(live), bool), np.ones(len(live), bool)
            for k in range(self.depth):
                at = np.flatnonzero(same)
                if not len(at):
                    break
                a, b = text[heads[mid[at]] + k], test[places[live[at]] + k]
                less[at], same[at] = a < b, a == b
            lo[live] = np.where(less, mid + 1, lo[live])
            hi[live] = np.where(less, hi[live], mid)
        at = np.minimum(lo, max(len(heads) - 1, 0))
        found = lo < len(heads)
        for k in range(self.depth):
            found &= text[heads[at] + k] == test[places + k]
        after = np.concatenate((first, [len(self.suffixes)]))
        return np.where(found, after[at], 0), np.where(found, after[at + 1], 0)

    def search(self, test: np.ndarray, test_row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place here, place in test, words): the maximal common runs of at least `depth` words."""
        none = (np.zeros(0, np.int64),) * 3
        n = len(test) - self.depth + 1
        if n <= 0 or not len(self.names) or len(self.numbers) < self.depth:
            return none
        at = np.minimum(np.searchsorted(self.names, test), len(self.names) - 1)
        known = self.names[at] == test
        beyond = int(self.numbers.max()) + 1
        numbers = np.where(known, at, beyond + np.arange(len(test)))  # words that are not here equal nothing
        count = np.concatenate(([0], np.cumsum(known)))
        places = np.flatnonzero((count[self.depth :] - count[: -self.depth] == self.depth) & (test_row[:n] == test_row[self.depth - 1 :]))
        if not len(places):
            return none
        lo, hi = self._find(numbers, places)
        hit = hi > lo
        places, lo, hi = places[hit], lo[hit], hi[hit]
        if not len(places):
            return none
        # a match begins where the words before differ: within a range, all places but those with the word before this one
        before = np.where(self.suffixes > 0, self.numbers[np.maximum(self.suffixes - 1, 0)], -1)
        order = np.lexsort((before, self.classes[self.suffixes]))
        suffixes, before = self.suffixes[order], before[order]
        own = np.where((places > 0) & (test_row[np.maximum(places - 1, 0)] == test_row[places]), numbers[np.maximum(places - 1, 0)], -2)
        key = self.classes[suffixes] * (beyond + 3) + before + 2
        asked = self.classes[suffixes[lo]] * (beyond + 3) + np.minimum(own, beyond) + 2
        skip_lo, skip_hi = np.searchsorted(key, asked, "left"), np.searchsorted(key, asked, "right")
        a, b = [], []
        for x, y in ((lo, np.maximum(skip_lo, lo)), (np.minimum(skip_hi, hi), hi)):
            many = np.maximum(y - x, 0)
            b.append(np.repeat(places, many))
            a.append(suffixes[np.repeat(x, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)])
        a, b = np.concatenate(a), np.concatenate(b)
        return a, b, self._lengths(a, b, numbers, test_row)

    def _lengths(self, a: np.ndarray, b: np.ndarray, numbers: np.ndarray, test_row: np.ndarray) -> np.ndarray:
        length = np.full(len(a), self.depth)
        live = np.arange(len(a))
        ends = np.append(np.flatnonzero(test_row[1:] != test_row[:-1]) + 1, len(test_row))
        end = ends[np.searchsorted(ends, b, "right")]
        text = np.concatenate((self.numbers, [-1]))
        for _ in range(64):  # most end soon, word by word
            x, y = a[live] + length[live], b[live] + length[live]
            ok = y < end[live]
            ok[ok] = text[np.minimum(x[ok], len(text) - 1)] == numbers[y[ok]]
            live = live[ok]
            if not len(live):
                return length
            length[live] += 1
        # the others by ranks of doubled lengths over both sequences, up while they match and down again
        stops = np.flatnonzero(test_row[1:] != test_row[:-1]) + 1
        shift = np.zeros(len(numbers) + 1, np.int64)
        np.add.at(shift, stops, 1)
        shift = np.cumsum(shift)
        top = int(max(self.numbers.max(), numbers.max())) + 1
        tests = np.insert(numbers, stops, top + np.arange(len(stops)))
        joint = np.concatenate((self.numbers, [top + len(stops)], tests))
        here, there = a[live], len(self.numbers) + 1 + b[live] + shift[b[live]]
        ranks = [np.unique(joint, return_inverse=True)[1].astype(np.int64) + 1]
        got = length[live]

        def step(level: int, rows: np.ndarray) -> np.ndarray:
            x, y = here[rows] + got[rows], there[rows] + got[rows]
            ok = (x + (1 << level) <= len(self.numbers)) & (y + (1 << level) <= len(joint))
            ok[ok] = ranks[level][x[ok]] == ranks[level][y[ok]]
            got[rows[ok]] += 1 << level
            return rows[ok]

        rows, level = np.arange(len(live)), 0
        while len(rows := step(level, rows)):
            ranks.append(_doubled(ranks[level], 1 << level))
            level += 1
        for level in range(level, -1, -1):
            step(level, np.arange(len(live)))
        length[live] = got
        return length


def _build(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    """Shards of about a slice of text each."""
    for batch in batches:
        text, doc = batch.column("text"), batch.column("doc_id").to_numpy()
        for lo, hi in slices(text):
            h, row, _, _ = word_hashes(text.slice(lo, hi - lo))
            if not len(h):
                continue
            used, first = np.unique(row, return_index=True)
            s = Shard.of(h, row, depth)
            columns = doc[lo + used], first + np.arange(len(used)), s.names, s.numbers.astype(np.int32), s.suffixes.astype(np.int32), s.classes.astype(np.int32)
            yield pa.record_batch({c.split()[0]: pa.array([x.tobytes()], pa.binary()) for c, x in zip(SHARDS.split(", "), columns, strict=True)})


def _search(batches: Iterator[pa.RecordBatch], test: np.ndarray, test_row: np.ndarray, ids: np.ndarray, depth: int) -> Iterator[pa.RecordBatch]:
    starts = np.searchsorted(test_row, np.arange(len(ids)), "left")
    for batch in batches:
        for i in range(batch.num_rows):
            docs, begins, names, numbers, suffixes, classes = (np.frombuffer(batch.column(c)[i].as_buffer(), k) for c, k in zip(batch.schema.names, (np.int64, np.int64, np.uint64, np.int32, np.int32, np.int32), strict=True))
            shard = Shard(numbers.astype(np.int64), names, suffixes.astype(np.int64), classes.astype(np.int64), depth)
            a, b, words = shard.search(test, test_row)
            for at in range(0, len(a), 100_000):
                x, y = a[at : at + 100_000], b[at : at + 100_000]
                d, t = np.searchsorted(begins, x, "right") - 1, test_row[y]
                yield pa.record_batch({"doc_id": pa.array(docs[d]), "item_id": pa.array(ids[t]), "words": pa.array(words[at : at + 100_000]), "doc_word": pa.array(x - begins[d]), "item_word": pa.array(y - starts[t])})


def leaked_spans(documents: DataFrame, items: DataFrame, least: int = 12) -> DataFrame:
    """(doc_id, item_id, words, doc_word, item_word): every maximal verbatim run of at least `least` words.

    Words are runs of letters and digits in lower case. doc_word and item_word are the places of its first word,
    from 0. Null texts, ids and texts of fewer words give nothing; repeated items are each reported. The items are
    the stated set of evaluation texts: they are sent to the tasks in blocks of BLOCK_WORDS words, each searched
    against all shards, so their number is not bounded by memory. With several blocks the shards are written once.
    """
    spark = documents.sparkSession
    tests = items.where("item_id is not null and text is not null").select("item_id", normalised("text").alias("text")).orderBy("item_id")
    docs = documents.where("doc_id is not null and text is not null").select("doc_id", normalised("text").alias("text"))
    shards = docs.mapInArrow(lambda it: _build(it, least), SHARDS)
    blocks = _blocks(tests)
    one, more = next(blocks, None), next(blocks, None)
    if one is None:
        return docs.limit(0).selectExpr("doc_id", "0L item_id", "0L words", "0L doc_word", "0L item_word")

    def found(block: tuple[list[str], list[int]]) -> tuple[DataFrame, object]:
        w, r, _, _ = word_hashes(pa.array(block[0], pa.string()))
        sent = spark.sparkContext.broadcast((w, r, np.array(block[1], np.int64)))
        return shards.mapInArrow(lambda it: _search(it, *sent.value, least), SPANS), sent

    if more is None:
        return found(one)[0]
    shards = written(shards, "shards")
    out = None
    while one:
        spans, sent = found(one)
        spans = written(spans, "spans")
        sent.unpersist()
        out = spans if out is None else out.unionAll(spans)
        one, more = more, next(blocks, None)
    return out


def _blocks(tests: DataFrame) -> Iterator[tuple[list[str], list[int]]]:
    """Texts and ids of evaluation items, about BLOCK_WORDS words at a time."""
    held, ids, size = [], [], 0
    for item, text in tests.toLocalIterator():
        held.append(text)
        ids.append(item)
        size += text.count(" ") + 1
        if size >= BLOCK_WORDS:
            yield held, ids
            held, ids, size = [], [], 0
    if held:
        yield held, ids


def leaks(documents: DataFrame, items: DataFrame, least: int = 12) -> DataFrame:
    """(doc_id, item_id, spans, longest): documents that hold a passage of an item, with the longest run of words."""
    return leaked_spans(documents, items, least).groupBy("doc_id", "item_id").agg(F.count("*").alias("spans"), F.max("words").alias("longest"))


def without_leaks(documents: DataFrame, items: DataFrame, least: int = 12) -> DataFrame:
    """The documents that hold no passage of any item; documents with a null id or text are kept."""
    bad = leaked_spans(documents, items, least).select(F.col("doc_id").alias("__leaked")).distinct()
    return documents.join(bad, F.col("doc_id") == F.col("__leaked"), "left_anti")
