"""What a task of a search does with its chunks: words and their stems, scores for all queries, the best of each query.

Nothing that grows with chunks times queries is kept: a task holds the best so far of every query and goes on with the
least score that can still enter them.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from codexmill.functions import text as T
from codexmill.functions.stem import stem

K1, B, MATCH_BONUS = 1.2, 0.75, 0.15
#: A term is a row of that product from this share of queries on; chunks of a product. Neither changes a result.
FREQUENT, HELD = 0.03, 128
#: What single precision may lose.
LOOSE = 1 - 1e-4
#: Terms of a query whose sums of least weights are held.
DEPTH = 64
#: Words that a worker remembers with their terms.
WORDS = 500_000
HITS = "query_id long, chunk_id long, score double, matched long"


@lru_cache(maxsize=1)
def _word() -> re.Pattern:
    """T.WORD with its classes spelled out, as this module's regular expressions don't know them."""
    ok = [unicodedata.category(chr(c)) in ("Lu", "Ll", "Lt", "Lm", "Lo", "Nd") for c in range(0x110000)]
    edges = np.flatnonzero(np.diff(np.array([False, *ok, False], np.int8)))
    return re.compile(T.WORD.replace(r"\p{L}\p{Nd}", "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in edges.reshape(-1, 2))))


def _is_identifier(word: str) -> bool:
    kinds = [unicodedata.category(c) for c in word]
    solid = [k[0] == "L" or k == "Nd" for k in kinds]
    pairs = zip(kinds, kinds[1:], solid, solid[1:], word[1:], strict=False)
    return word[-1] in "+#" or any((sa and c in "._-+#/") or (a == "Ll" and b == "Lu") or (sa and sb and (a == "Nd") != (b == "Nd")) for a, b, sa, sb, c in pairs)


def _terms_of(word: str, stems: bool) -> list[str]:
    """What one word gives: itself, or its stem and of an identifier the whole and its parts. As search.analysed()."""
    norm = re.sub(r"^[._\-+#/]+|[._\-/]+$", "", word.lower().replace("ё", "е"))
    fits = lambda t: T.SHORTEST <= len(t) <= T.LONGEST
    if not stems:
        return [norm] if fits(norm) else []
    if not _is_identifier(word):
        s = stem(norm) if fits(norm) else ""
        return [s] if fits(s) else []
    return [t for t in (norm, *(p for p in re.split(T.CONNECTORS, norm) if p != norm)) if fits(t)]


_known: tuple[dict[str, tuple[str, ...]], ...] = {}, {}


def terms(text: str | None, stems: bool = True) -> list[str]:
    """Terms of a text, one for every occurrence. No word holds white space, so its pieces between blanks are remembered."""
    out, known = [], _known[stems]
    for piece in (text or "").split():
        got = known.get(piece)
        if got is None:
            if len(known) >= WORDS:
                known.clear()
            got = known[piece] = tuple(t for w in _word().findall(piece) for t in _terms_of(w, stems))
        out += got
    return out


def occurrences(batches: Iterator[pa.RecordBatch], stems: bool) -> Iterator[pa.RecordBatch]:
    """(id, text) -> (query_id, term), one row per distinct term."""
    for b in batches:
        rows = [(i, t) for i, text in zip(b[0].to_pylist(), b[1].to_pylist(), strict=True) for t in set(terms(text, stems))]
        yield pa.record_batch({"query_id": pa.array([i for i, _ in rows], pa.int64()), "term": pa.array([t for _, t in rows], pa.string())})


def frequencies(batches: Iterator[pa.RecordBatch], stems: bool) -> Iterator[pa.RecordBatch]:
    """(chunk_id, text) -> (term, df, tf) of parts of a task; under the null term the number of chunks and of all terms."""
    df, tf, n = Counter(), Counter(), 0

    def part() -> pa.RecordBatch:
        return pa.record_batch({"term": pa.array([*df, None], pa.string()), "df": pa.array([*df.values(), n], pa.int64()), "tf": pa.array([*(tf[t] for t in df), tf.total()], pa.int64())})

    for b in batches:
        for text in b[1].to_pylist():
            got = terms(text, stems)
            df.update(set(got))
            tf.update(got)
            n += 1
        if len(df) >= WORDS:
            yield part()
            df, tf, n = Counter(), Counter(), 0
    yield part()


class Best:
    """The k best chunks of each of n queries, ties of the last one included."""

    def __init__(self, n: int, k: int, least: float = -np.inf):
        self.n, self.k = n, k
        self.least = np.full(n, least)  #: by query, what a score must reach to count
        self.kept: list[tuple[np.ndarray, ...]] = []
        self.held = self.settled = self.turns = 0

    def add(self, query: np.ndarray, chunk: np.ndarray, score: np.ndarray, matched: np.ndarray) -> None:
        self.kept.append((query, chunk, score, matched))
        self.held += len(query)
        if self.held > self.settled + max(self.n * self.k, 1 << 18):
            self.settle()

    def settle(self) -> tuple[np.ndarray, ...]:
        if not self.kept:
            return tuple(np.zeros(0, t) for t in (np.int64, np.int64, float, np.int64))
        query, chunk, score, matched = (np.concatenate(x) for x in zip(*self.kept, strict=True))
        whole = np.floor(score * 1e6 + 0.5).astype(np.int64)  # as they are rounded in the end: ties are those of the result
        key = (query.astype(np.int64) << 47) + ((1 << 46) - whole)
        order = np.argsort(key)
        key, by = key[order], query[order]
        begin = np.searchsorted(by, np.arange(self.n + 1))
        last = begin[:-1] + self.k - 1
        full = np.flatnonzero(last < begin[1:])
        limit = np.full(self.n, np.iinfo(np.int64).max)
        limit[full] = key[last[full]]
        order = order[key <= limit[by]]
        if len(order) > 1.5 * self.n * self.k:  # many ties: of those the smaller chunk_ids
            order = np.lexsort((chunk, -whole, query))
            order = order[np.arange(len(order)) - begin[query[order]] < self.k]
        worst = (1 << 46) - (limit[full] - (full << 47))
        self.least[full] = np.maximum(self.least[full], worst / 1e6 - 1e-6)
        self.kept = [tuple(x[order] for x in (query, chunk, score, matched))]
        self.held = self.settled = len(order)
        self.turns += 1
        return self.kept[0]

    def rows(self, names: np.ndarray) -> Iterator[pa.RecordBatch]:
        query, chunk, score, matched = self.settle()
        for i in range(0, len(query), 1 << 16):
            s = slice(i, i + (1 << 16))
            yield pa.record_batch({"query_id": pa.array(names[query[s]], pa.int64()), "chunk_id": pa.array(chunk[s], pa.int64()), "score": pa.array(score[s], pa.float64()), "matched": pa.array(matched[s].astype(np.int64))})


class Asked:
    """A block of queries by term: of[begins[t]:begins[t + 1]] are those that ask for term t, idf[t] is its weight."""

    def __init__(self, names: np.ndarray, of: np.ndarray, idf: np.ndarray, begins: np.ndarray, words: list[str]):
        self.names, self.of, self.idf, self.begins, self.words = names, of, idf, begins, words

    def best(self, batches: Iterator[pa.RecordBatch], k: int, mean: float, stems: bool = True) -> Iterator[pa.RecordBatch]:
        """Rows (chunk_id, text), one a chunk, against all queries: HITS, those that can be among the k best."""
        code, scores = {t: i for i, t in enumerate(self.words)}, _Scores(self, k)
        for b in batches:
            for i, text in zip(b[0].to_pylist(), b[1].to_pylist(), strict=True):
                got, counts = terms(text, stems), {}
                for t in got:
                    c = code.get(t)
                    if c is not None:
                        counts[c] = counts.get(c, 0) + 1
                if counts:
                    scores.add(i, counts, K1 * (1 - B + B * len(got) / mean))
        scores.flush()
        yield from scores.found.rows(self.names)


class _Scores:
    """Scores of one chunk after another for a block of queries.

    Weights are added up first, by a product of matrices in single precision. A sum I of weights can come from m terms only if it
    is at least that of the m least weights of the query, so that a score, I times 1 + MATCH_BONUS (m - 1), needs a least
    I. Where that is reached, which is rarely so, the score is worked out exactly.
    """

    def __init__(self, asked: Asked, k: int):
        n, begins = len(asked.names), asked.begins
        self.n, self.found, self.idf = n, Best(n, k), asked.idf
        of = asked.of.astype(np.intp)
        self.lists = [of[a:b] for a, b in zip(begins, begins[1:], strict=False)]
        wide = np.flatnonzero(np.diff(begins) >= max(1, FREQUENT * n))
        row = np.full(len(asked.idf), -1)
        row[wide] = np.arange(len(wide))
        self.row = row.tolist()
        weight = np.repeat(asked.idf, np.diff(begins))
        count = np.bincount(of, minlength=n)
        self.asks = np.zeros((n, len(wide)), np.uint8)
        for j, t in enumerate(wide):
            self.asks[self.lists[t], j] = 1
        self.asking = np.ascontiguousarray(self.asks.T, np.float32)
        self.held: list[tuple[int, dict[int, int], float]] = []
        self.rare, self.more = np.zeros(n), np.zeros(n, np.int32)
        order = np.lexsort((weight, of))
        by, weight = of[order], weight[order]
        at = np.arange(len(by)) - np.searchsorted(by, np.arange(n))[by]
        inside = at < DEPTH
        least = np.full((n, DEPTH), np.inf)
        least[by[inside], at[inside]] = weight[inside]
        self.lightest = np.cumsum(least, axis=1).astype(np.float32)  # infinite where a query has fewer terms
        self.long = np.flatnonzero(count > DEPTH)
        self.bonus = (1 + MATCH_BONUS * np.arange(DEPTH)).astype(np.float32)
        self.levels: dict[int, np.ndarray] = {}
        self.turn = 0

    def needed(self, level: int) -> np.ndarray:
        """By query, the least sum with which a chunk counts whose terms weigh 2 ** (level / 16) of their idf, or up to the next level."""
        one = 2 ** (level / 16)
        least = (np.maximum(self.found.least, 0) / one).astype(np.float32)
        need = np.maximum(self.lightest, (least * np.float32(2 ** (-1 / 16)))[:, None] / self.bonus).min(axis=1)
        need[self.long] = np.minimum(need[self.long], self.lightest[self.long, -1])
        return np.maximum(need * np.float32(LOOSE), np.float32(1e-6))

    def add(self, chunk: int, counts: dict[int, int], norm: float) -> None:
        """A chunk with its asked terms; one that occurs once weighs (K1 + 1) / (1 + norm) times its idf, others more."""
        self.held.append((chunk, counts, norm))
        if len(self.held) == HELD:
            self.flush()

    def flush(self) -> None:
        weights = np.zeros((len(self.held), len(self.asking)), np.float32)
        for i, (_, counts, norm) in enumerate(self.held):
            at = [(self.row[c], self.idf[c] * tf * (1 + norm) / (tf + norm)) for c, tf in counts.items() if self.row[c] >= 0]
            if at:
                j, w = zip(*at, strict=True)
                weights[i, list(j)] = w
        sums = weights @ self.asking
        for i, one in enumerate(self.held):
            self.settle(*one, sums[i])
        self.held = []

    def settle(self, chunk: int, counts: dict[int, int], norm: float, sums: np.ndarray) -> None:
        """sums: by query, those of the terms with a row, as multiples of the weight of a term that occurs once."""
        row, lists = self.row, self.lists
        for c, tf in counts.items():
            if row[c] < 0:
                sums[lists[c]] += np.float32(self.idf[c] * tf * (1 + norm) / (tf + norm))
        if self.turn != self.found.turns:  # more is needed than before
            self.turn, self.levels = self.found.turns, {}
        one = (K1 + 1) / (1 + norm)
        level = math.floor(math.log2(one) * 16)
        if level not in self.levels:
            self.levels[level] = self.needed(level)
        need = self.levels[level]
        query = np.flatnonzero(sums >= need)
        if not len(query):
            return
        weight = lambda c: self.idf[c] * counts[c] * (K1 + 1) / (counts[c] + norm)
        score, matched = np.zeros(len(query)), np.zeros(len(query), np.int32)
        wide, few = [c for c in counts if row[c] >= 0], [c for c in counts if row[c] < 0]
        if wide:
            at = np.array([row[c] for c in wide])
            met = self.asks[query[:, None], at]
            score += met @ np.array([weight(c) for c in wide])
            matched += met.sum(axis=1, dtype=np.int32)
        if few:
            for c in few:
                self.rare[lists[c]] += weight(c)
                self.more[lists[c]] += 1
            score += self.rare[query]
            matched += self.more[query]
            for c in few:
                self.rare[lists[c]] = 0
                self.more[lists[c]] = 0
        score *= 1 - MATCH_BONUS + MATCH_BONUS * matched
        hit = np.flatnonzero(score >= self.found.least[query])
        self.found.add(query[hit].astype(np.int32), np.full(len(hit), chunk), score[hit], matched[hit])


def cosines(batches: Iterator[pa.RecordBatch], ids: np.ndarray, q: np.ndarray, k: int | None, min_cosine: float) -> Iterator[pa.RecordBatch]:
    """Rows (chunk_id, q) against queries ids with vectors q: the k best of each, or all, whose cosine is at least min_cosine."""
    if not len(ids):
        return
    least = min_cosine * 16129.0
    best = Best(len(ids), k or 1, least / 16129.0)
    floor = np.full(len(ids), least, np.float32)
    for b in batches:
        lists = b["q"]
        lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
        rows = np.flatnonzero(np.nan_to_num(lengths.astype(float), nan=-1) == q.shape[1])
        lists = lists.take(pa.array(rows))
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(rows), -1)
        chunk = b["chunk_id"].to_numpy()[rows]
        known = ~np.isnan(flat).any(axis=1)
        flat, chunk = flat[known], chunk[known]
        for at in range(0, len(chunk), 256):
            dots = flat[at : at + 256] @ q.T
            hit = np.flatnonzero(dots >= floor)
            if not len(hit):
                continue
            row, query = np.divmod(hit, len(ids))
            score, chunks = dots.ravel()[hit].astype(float) / 16129.0, chunk[at : at + 256][row]
            if k is None:
                yield pa.record_batch({"query_id": pa.array(ids[query], pa.int64()), "chunk_id": pa.array(chunks, pa.int64()), "cosine": pa.array(score)})
                continue
            best.add(query, chunks, score, np.ones(len(hit), np.int8))
            floor = np.nextafter(np.maximum(least, best.least * 16129.0).astype(np.float32), np.float32(-np.inf)) if best.settled else floor
    if k is not None:
        for b in best.rows(ids):
            yield pa.record_batch({"query_id": b["query_id"], "chunk_id": b["chunk_id"], "cosine": b["score"]})
