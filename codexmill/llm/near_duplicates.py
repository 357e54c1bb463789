"""Near-duplicate records: all pairs of sets whose Jaccard similarity reaches a limit, without comparing all pairs.

Method: a size-aware heavy-light join. Elements are put in one global order, rarer first. Two similar sets share at
least k of the first |x| - ceil(t|x|) + k elements of each (their prefixes). The inverted list of an element holds the
sets that have it in their prefix for k = 2; the element is light if that list is short.

* Pairs that share a light element of these prefixes meet in its list. An element is light by a second sketch, of the
  lengths of lists, so that no list is shuffled to be measured.
* Other pairs share at least two heavy elements: sets up to a boundary size enumerate their fixed-size subsets (pairs
  of heavy prefix elements), and equal subsets meet.
* Beyond the boundary subsets would be too many: these sets, and those large enough to be their partners, scan the
  inverted lists of their heavy elements.
* A list of a subset or of a heavy element that is long is dealt to blocks, and each pair of blocks meets by itself.

Prefixes are written once. In a collection of few words most elements are heavy, and the subsets take many times the
space of the texts; so keys are made from the prefixes in rounds, each for a share of the elements, and the files of a
round go before the next begins. Their number follows from the counted keys, so the disk in use keeps in proportion to
the prefixes at any size.

The boundary is chosen by cost from the lengths of lists. Meetings are thinned by size, by position and by a bit
signature, none of which loses a pair, and what remains is checked exactly. Sets that are equal are one class
throughout, so copies cost one set per task. The order comes from counts over all records in a sketch of fixed size, on
a scale of powers, so that it tells frequent from rare elements at any size of the collection; both sketches steer the
cost and never the result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexmill.llm import _filter
from codexmill.llm._words import distinct_per_row, grams, mix, slices, word_hashes
from codexmill.session import erase, scratch, tidy, written
from codexmill.sources.tables import latest

#: Buckets of the count sketch: 2^BUCKETS bytes are broadcast; it is put together in so many ranges.
BUCKETS, RANGES = 24, 64
#: A list of up to so many sets is light.
LIGHT = 200
#: Sets whose keys one task holds, about, if all of them are of elements; KEYS elements of a set are in its prefix, about.
SETS, KEYS = 50_000, 30
#: Bytes of keys that one round shuffles, about: so many times those of the prefixes, or ROUND where that is more.
SHARE, ROUND = 1.5, 256_000_000
#: Pairs that are worked out at once in a task.
BLOCK = 2_000_000
#: Entries of a long list in one block.
DEAL = 2000
#: Records of a class that one task pairs at once with those of its own or a similar class.
PART = 200

Maker = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]


def word_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(element, row): distinct runs of three words of texts whose words are parted by white space."""
    h, row, _, _ = word_hashes(column)
    return distinct_per_row(*grams(h, row, 3))


def char_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(element, row): distinct substrings of three characters."""
    texts = [x or "" for x in column.to_pylist()]
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    row = np.repeat(np.arange(len(texts)), [len(x) for x in texts])
    if len(code) < 3:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    ok = row[:-2] == row[2:]
    g = (code[:-2] << np.uint64(42)) | (code[1:-1] << np.uint64(21)) | code[2:]
    return distinct_per_row(mix(g[ok]), row[:-2][ok])


@dataclass(frozen=True)
class Plan:
    """What all tasks need to agree on."""

    make: Maker
    num: int  # the limit is num / den
    den: int
    smallest: int
    light: int = LIGHT
    deal: int = DEAL
    boundary: int = 0  # sets up to this size enumerate subsets of heavy elements
    parts: int = 8

    def need(self, size: np.ndarray) -> np.ndarray:
        """Elements that a set shares at least with a similar one."""
        return -(-self.num * size // self.den)

    def overlap(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Elements that two sets of these sizes share at least if they are similar."""
        return -(-self.num * (x + y) // (self.num + self.den))


def _sets(batch: pa.RecordBatch, plan: Plan) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By slice: its first row, the elements and their rows (in order), and size and fingerprint by row (size 0: too small)."""
    text = batch.column("text")
    for lo, hi in slices(text):
        g, row = plan.make(text.slice(lo, hi - lo))
        size = np.bincount(row, minlength=hi - lo)
        keep = size[row] >= plan.smallest
        g, row = g[keep], row[keep]
        size = np.where(size >= plan.smallest, size, 0)
        fp = np.zeros(hi - lo, np.uint64)
        if len(g):
            begin = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
            with np.errstate(over="ignore"):
                fp[row[begin]] = mix(np.add.reduceat(mix(g + np.uint64(1)), begin) + size[row[begin]].astype(np.uint64))
        yield lo, g, row, size, fp


def _bucket(g: np.ndarray) -> np.ndarray:
    return (g >> np.uint64(64 - BUCKETS)).astype(np.int64)


def _sketch(elements: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Counts of elements by bucket, in ranges, of one task."""
    counts = np.zeros(1 << BUCKETS, np.int32)
    for g in elements:
        at, n = np.unique(_bucket(g), return_counts=True)
        counts[at] += n.astype(np.int32)
    step = len(counts) // RANGES
    for r in range(RANGES):
        part = counts[r * step : (r + 1) * step]
        some = np.flatnonzero(part).astype(np.int32)
        if not len(some):
            continue
        # few counts as pairs of place and count, many as they lie
        blob = part.tobytes() if len(some) > step // 4 else np.concatenate((some, part[some])).tobytes()
        yield pa.record_batch({"r": pa.array([r], pa.int32()), "counts": pa.array([blob], pa.binary())})


def _scaled(counts: np.ndarray) -> np.ndarray:
    """Counts in a byte: themselves up to 64, beyond that eight steps for each doubling."""
    return np.where(counts <= 64, counts, np.minimum(255, 64 + 8 * np.log2(np.maximum(counts, 64) / 64))).astype(np.uint8)


def _unscaled(scaled: np.ndarray) -> np.ndarray:
    return np.where(scaled <= 64, scaled, 64 * 2.0 ** ((scaled.astype(float) - 64) / 8))


def _merge_sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for r, c in zip(batch.column("r").to_pylist(), batch.column("counts"), strict=True):
            got, step = np.frombuffer(c.as_buffer(), np.int32), (1 << BUCKETS) // RANGES
            total = held.setdefault(r, np.zeros(step, np.int64))
            if len(got) == step:
                total += got
            else:
                some, n = got.reshape(2, -1)
                total[some] += n
    for r, part in held.items():
        yield pa.record_batch({"r": pa.array([r], pa.int32()), "counts": pa.array([_scaled(part).tobytes()], pa.binary())})


SKETCH = "r int, counts binary"


def _count(sketches: DataFrame) -> np.ndarray:
    """The scaled count sketch put together of those of tasks; the driver gets 2^BUCKETS bytes."""
    spark = sketches.sparkSession
    path = scratch(spark, "sketch")
    got = written(sketches.repartition(16, "r").mapInArrow(_merge_sketches, SKETCH), "sketch", path)
    total, step = np.zeros(1 << BUCKETS, np.uint8), (1 << BUCKETS) // RANGES
    for r in got.toLocalIterator():
        total[r["r"] * step : (r["r"] + 1) * step] = np.frombuffer(r["counts"], np.uint8)
    erase(spark, path)
    return total


PACKED = "part int, sets binary, sizes binary, keys binary, refs binary, places binary"


def _pack(fp: np.ndarray, bits: np.ndarray, size: np.ndarray, key: np.ndarray, ref: np.ndarray, place: np.ndarray, parts: int) -> pa.RecordBatch:
    """Entries (key, set, place) and the sets they speak of, one row for each part of the keys."""
    part = (mix(key) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    cut = np.searchsorted(part[order], np.arange(parts + 1))
    rows: dict[str, list] = {k.split()[0]: [] for k in PACKED.split(", ")}
    for q in np.flatnonzero(np.diff(cut)):
        o = order[cut[q] : cut[q + 1]]
        used, local = np.unique(ref[o], return_inverse=True)
        rows["part"].append(int(q))
        rows["sets"].append(np.column_stack((fp[used], bits[used])).astype(np.uint64).tobytes())
        rows["sizes"].append(size[used].astype(np.uint32).tobytes())
        rows["keys"].append(key[o].tobytes())
        rows["refs"].append(local.astype(np.uint32).tobytes())
        rows["places"].append(place[o].astype(np.int32).tobytes())
    return pa.record_batch({k: pa.array(v, pa.int32() if k == "part" else pa.binary()) for k, v in rows.items()})


#: A set: its class, signature and size; of the elements of its prefix that other sets may have, their first place and hashes.
PREFIX = "a long, s long, t long, size int, skip int, elements binary"


def _signatures(batches: Iterator[pa.RecordBatch], plan: Plan, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The prefix elements under which similar sets can meet, one row a set; each class of equal sets once a task."""
    seen = np.zeros(0, np.uint64)
    for batch in batches:
        for _, g, row, size, fp in _sets(batch, plan):
            _, first = np.unique(fp, return_index=True)
            fresh = np.zeros(len(fp), bool)
            fresh[first] = True
            fresh &= (size > 0) & ~np.isin(fp, seen)
            seen = np.union1d(seen, fp[fresh])
            keep = fresh[row]
            g, row = g[keep], row[keep]
            if not len(g):
                continue
            c = counts[_bucket(g)]
            at = np.lexsort((g, c, row))
            g, row, c = g[at], row[at], c[at]
            begin = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
            ref = np.cumsum(np.concatenate(([0], (row[1:] != row[:-1]).astype(np.int64))))
            many = size[row[begin]]
            pos = np.arange(len(g)) - begin[ref]
            # a signature of 128 bits: element counts modulo 2 are no more apart than the sets are
            par = np.zeros(len(begin) * 128, np.uint8)
            np.bitwise_xor.at(par, ref * 128 + (g & np.uint64(127)).astype(np.int64), np.uint8(1))
            bits = np.packbits(par.reshape(-1, 128), axis=1).view(np.uint64).reshape(-1, 2)
            # an element with a count of one is in no other set; those come first, so the others follow each other
            used = np.flatnonzero((c > 1) & (pos < many[ref] - plan.need(many)[ref] + 2))
            if len(used):
                head = used[np.flatnonzero(np.concatenate(([True], ref[used[1:]] != ref[used[:-1]])))]
                sets = ref[head]
                ends = np.append(np.searchsorted(used, head), len(used)).astype(np.int32) * 8
                elements = pa.Array.from_buffers(pa.binary(), len(sets), [None, pa.py_buffer(ends), pa.py_buffer(g[used].tobytes())])
                a, s, t = (pa.array(x.view(np.int64)) for x in (fp[row[begin]][sets], np.ascontiguousarray(bits[sets, 0]), np.ascontiguousarray(bits[sets, 1])))
                yield pa.record_batch({"a": a, "s": s, "t": t, "size": pa.array(many[sets].astype(np.int32)), "skip": pa.array(pos[head].astype(np.int32)), "elements": elements})


@dataclass
class Prefixes:
    """Rows of PREFIX: by set, size; by element its set, place and hash."""

    size: np.ndarray
    ref: np.ndarray
    pos: np.ndarray
    g: np.ndarray

    @staticmethod
    def of(batch: pa.RecordBatch) -> Prefixes:
        size, skip = (batch.column(c).to_numpy().astype(np.int64) for c in ("size", "skip"))
        column = batch.column("elements")
        ends = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
        g = np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(np.uint64)
        n = np.diff(ends).astype(np.int64) // 8
        ref = np.repeat(np.arange(len(n)), n)
        return Prefixes(size, ref, np.arange(len(g)) - np.repeat(np.cumsum(n) - n, n) + skip[ref], g)

    def heavy(self, plan: Plan, lengths: np.ndarray) -> np.ndarray:
        """Of elements: whether their list is longer than those of light ones; the same for all sets."""
        return lengths[_bucket(self.g)] > _scaled(np.array([plan.light]))[0]

    def first(self, plan: Plan) -> np.ndarray:
        """Of elements: whether they are among those that similar sets share one of."""
        return self.pos < (self.size - plan.need(self.size) + 1)[self.ref]


COSTS = ("sets", "elements", "light", "subsets", "lists", "firsts")


def _costs(batches: Iterator[pa.RecordBatch], plan: Plan, lengths: np.ndarray) -> Iterator[pa.RecordBatch]:
    """What sets of a size (up to 4096) come to: elements, light ones, subsets of heavy ones, entries met in the lists of heavy ones, heavy ones to meet one of."""
    total = np.zeros((4097, len(COSTS)))
    for batch in batches:
        if not batch.num_rows:
            continue
        p = Prefixes.of(batch)
        heavy, n = p.heavy(plan, lengths), len(p.size)
        h = np.bincount(p.ref[heavy], minlength=n)
        each = (np.ones(n), np.bincount(p.ref, minlength=n), np.bincount(p.ref[~heavy], minlength=n), h * (h - 1) / 2, np.bincount(p.ref[heavy], _unscaled(lengths[_bucket(p.g[heavy])]), n), np.bincount(p.ref[heavy & p.first(plan)], minlength=n))
        for k, x in enumerate(each):
            total[:, k] += np.bincount(np.minimum(p.size, 4096), x, 4097)
    some = np.flatnonzero(total[:, 0])
    yield pa.record_batch({"size": pa.array(some.astype(np.int32))} | {c: pa.array(total[some, k]) for k, c in enumerate(COSTS)})


#: The highest bits of a key: of a subset of two (the highest isn't set), of a light element, of a heavy one.
SUBSET, LIGHT_ONE, HEAVY_ONE = 0, 1 << 63, 3 << 62


def _kinds(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By key: how many common elements may come before the one met at; whether it is of a heavy element."""
    top = key >> np.uint64(62)
    return (top == 2).astype(np.int64), top == 3


#: What comes of a meeting: a pair (a, b) of sets and the sum of their sizes, or, where n > 0, set a in the long list of key b, which holds n sets.
MET = "a long, b long, n long, size int, place int, s long, t long"


def _met(a, b, n=None, size=None, place=None, s=None, t=None) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(a), 100_000):
        cut = lambda x, kind: pa.array(np.zeros(len(a[i : i + 100_000]), kind) if x is None else x[i : i + 100_000].astype(kind, copy=False))  # noqa: B023, E731
        yield pa.record_batch({"a": cut(a.view(np.int64), np.int64), "b": cut(b.view(np.int64), np.int64), "n": cut(n, np.int64), "size": cut(size, np.int32), "place": cut(place, np.int32), "s": cut(None if s is None else s.view(np.int64), np.int64), "t": cut(None if t is None else t.view(np.int64), np.int64)})


@dataclass
class Sets:
    """Fingerprints with two words of signature (n x 3), and sizes."""

    s: np.ndarray
    size: np.ndarray

    def alike(self, plan: Plan, x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Which of the pairs x, y can be similar by size, by the places where they meet under key, and by signature."""
        slack, alone = _kinds(key)
        sx, sy = self.size[x], self.size[y]
        need = plan.overlap(sx, sy)
        ok = (np.minimum(sx, sy) * plan.den >= np.maximum(sx, sy) * plan.num) & (np.minimum(sx - px, sy - py) + slack >= need)
        ok &= ~alone | (np.maximum(sx, sy) > plan.boundary)
        at = np.flatnonzero(ok)
        x, y = x[at], y[at]
        differ = np.bitwise_count(self.s[x, 1] ^ self.s[y, 1]).astype(np.int64) + np.bitwise_count(self.s[x, 2] ^ self.s[y, 2])
        return at[(differ <= (sx + sy - 2 * need)[at]) & (self.s[x, 0] != self.s[y, 0])]

    def pairs(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        fa, fb = self.s[x, 0], self.s[y, 0]
        return np.unique(np.column_stack((np.minimum(fa, fb), np.maximum(fa, fb), (self.size[x] + self.size[y]).astype(np.uint64))), axis=0)


def _meet(batches: Iterator[pa.RecordBatch], plan: Plan) -> Iterator[pa.RecordBatch]:
    """Pairs of sets that meet in lists of up to plan.deal sets, and the entries of longer lists."""
    columns: dict[str, list] = {k: [] for k in ("sets", "sizes", "keys", "refs", "places")}
    kinds = {"sets": np.uint64, "sizes": np.uint32, "keys": np.uint64, "refs": np.uint32, "places": np.int32}
    base = 0
    for batch in batches:
        for r in batch.to_pylist():
            got = {k: np.frombuffer(r[k], t) for k, t in kinds.items()}
            got["refs"] = got["refs"].astype(np.int64) + base
            base += len(got["sizes"])
            for k, v in got.items():
                columns[k].append(v)
    if not base:
        return
    raw = np.concatenate(columns["sets"]).reshape(-1, 3)
    _, first, named = np.unique(raw[:, 0], return_index=True, return_inverse=True)  # tasks may have sent equal sets
    sets = Sets(raw[first], np.concatenate(columns["sizes"]).astype(np.int64)[first])
    key, ref, place = np.concatenate(columns["keys"]), named[np.concatenate(columns["refs"])], np.concatenate(columns["places"]).astype(np.int64)
    del columns, raw
    order = np.lexsort((ref, key))
    key, ref, place = key[order], ref[order], place[order]
    once = np.concatenate(([True], (key[1:] != key[:-1]) | (ref[1:] != ref[:-1])))
    key, ref, place = key[once], ref[once], place[once]
    begins = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    sizes = np.diff(np.append(begins, len(key)))
    held = np.repeat(sizes, sizes)
    long = held > plan.deal
    if long.any():
        r = ref[long]
        yield from _met(sets.s[r, 0], key[long], held[long], sets.size[r], place[long], sets.s[r, 1], sets.s[r, 2])
    k = np.where(long, 0, np.arange(len(key)) - np.repeat(begins, sizes))  # each entry meets the k before it in its list
    done = np.cumsum(k)
    out, count, lo = [], 0, 0
    while lo < len(key):
        hi = max(lo + 1, int(np.searchsorted(done, (done[lo - 1] if lo else 0) + BLOCK, "right")))
        kk = k[lo:hi]
        y = np.repeat(np.arange(lo, hi), kk)
        x = y - np.repeat(kk, kk) + np.arange(len(y)) - np.repeat(np.cumsum(kk) - kk, kk)
        ok = sets.alike(plan, ref[x], ref[y], place[x], place[y], key[y])
        if len(ok):
            out.append(sets.pairs(ref[x[ok]], ref[y[ok]]))
            count += len(out[-1])
        lo = hi
        if count > BLOCK or (lo >= len(key) and out):
            p = np.unique(np.concatenate(out), axis=0)
            yield from _met(np.ascontiguousarray(p[:, 0]), np.ascontiguousarray(p[:, 1]), size=p[:, 2])
            out, count = [], 0


def _keys(batches: Iterator[pa.RecordBatch], plan: Plan, lengths: np.ndarray, turn: int, rounds: int) -> Iterator[pa.RecordBatch]:
    """Keys of a round: light elements, subsets of two heavy ones of sets up to the boundary, the heavy ones alone beyond."""
    for batch in batches:
        if not batch.num_rows:
            continue
        p = Prefixes.of(batch)
        bits, fp = np.column_stack([batch.column(c).to_numpy().view(np.uint64) for c in ("s", "t")]), batch.column("a").to_numpy().view(np.uint64)
        heavy, size, hashed = p.heavy(plan, lengths), p.size, mix(p.g)
        now = hashed % np.uint64(rounds) == turn if rounds > 1 else np.ones(len(p.g), bool)  # a subset goes with its first element
        alone = heavy & (size * plan.den >= plan.num * plan.boundary)[p.ref] & p.first(plan)
        at = np.flatnonzero(now & (~heavy | alone))
        if len(at):
            kind = np.where(heavy[at], np.uint64(HEAVY_ONE), np.uint64(LIGHT_ONE))
            yield _pack(fp, bits, size, hashed[at] >> np.uint64(2) | kind, p.ref[at], p.pos[at], plan.parts)
        small = np.flatnonzero(heavy & (size <= plan.boundary)[p.ref])
        if not len(small):
            continue
        ref, pos, g = p.ref[small], p.pos[small], p.g[small]
        k = np.where(now[small], np.searchsorted(ref, ref, "right") - np.arange(len(ref)) - 1, 0)  # an entry makes a subset with each behind it
        done, lo = np.cumsum(k), 0
        while lo < len(k):
            hi = max(lo + 1, int(np.searchsorted(done, (done[lo - 1] if lo else 0) + BLOCK // 2, "right")))
            kk = k[lo:hi]
            x = np.repeat(np.arange(lo, hi), kk)
            y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(kk) - kk, kk)
            lo = hi
            if len(x):
                with np.errstate(over="ignore"):
                    key = mix(g[x] * np.uint64(0x9E3779B97F4A7C15) + g[y]) >> np.uint64(1)
                yield _pack(fp, bits, size, key, ref[y], pos[y] - 1, plan.parts)


def choose(by_size: np.ndarray, t: float) -> int:
    """The boundary of the least cost; by_size: rows of (size, subsets, entries met in lists) over the sets of a size.

    A subset is shuffled, which costs about as much as six meetings in a list.
    """
    options = [(6 * by_size[by_size[:, 0] <= b, 1].sum() + by_size[by_size[:, 0] > t * b, 2].sum(), b) for b in np.concatenate(([0], by_size[:, 0]))]
    return int(min(options)[1])


def _blocks(batches: Iterator[pa.RecordBatch], plan: Plan) -> Iterator[pa.RecordBatch]:
    """Pairs of two blocks of a list; the entries of one pair of blocks follow each other."""

    def flush(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(parts)
        s = np.column_stack([t[c].to_numpy().view(np.uint64) for c in ("a", "s", "t")])
        sets, place, own = Sets(s, t["size"].to_numpy().astype(np.int64)), t["place"].to_numpy().astype(np.int64), t["own"].to_numpy()
        i, j = t["i"][0].as_py(), t["j"][0].as_py()
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        out = []
        for lo in range(0, len(left), 500):
            x = np.repeat(left[lo : lo + 500], len(right))
            y = np.tile(right, len(left[lo : lo + 500]))
            if i == j:
                x, y = x[x < y], y[x < y]
            ok = sets.alike(plan, x, y, place[x], place[y], np.full(len(x), t["b"][0].as_py(), np.int64).view(np.uint64))
            if len(ok):
                out.append(sets.pairs(x[ok], y[ok]))
        if out:
            p = np.unique(np.concatenate(out), axis=0)
            yield from _met(np.ascontiguousarray(p[:, 0]), np.ascontiguousarray(p[:, 1]), size=p[:, 2])

    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.column_stack([batch.column(c).to_numpy() for c in ("b", "i", "j")]).astype(np.int64)
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1), batch.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if held and tuple(key[lo]) != now:
                yield from flush(held)
                held = []
            now = tuple(key[lo])
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield from flush(held)


def _members(batches: Iterator[pa.RecordBatch], plan: Plan, wanted: _filter.Filter) -> Iterator[pa.RecordBatch]:
    """(id, at, class) of every record, and of classes that are in a candidate pair their elements, once a task."""
    seen: set[int] = set()
    for batch in batches:
        n = batch.num_rows
        cls, elements = np.zeros(n, np.int64), [None] * n
        for lo, g, row, size, fp in _sets(batch, plan):
            cls[lo : lo + len(fp)] = fp.view(np.int64)
            for r in np.flatnonzero((size > 0) & wanted.maybe(fp)):
                if int(fp[r]) not in seen:
                    seen.add(int(fp[r]))
                    a, b = np.searchsorted(row, (r, r + 1))
                    elements[lo + r] = g[a:b].tobytes()
        yield pa.record_batch({"id": batch.column("id"), "at": batch.column("at"), "class": pa.array(cls, pa.int64()), "elements": pa.array(elements, pa.binary())})


def _class_hashes(batch: pa.RecordBatch) -> np.ndarray:
    return np.concatenate([batch.column(c).to_numpy() for c in ("a", "b")]).view(np.uint64)


def _verify(batches: Iterator[pa.RecordBatch], plan: Plan) -> Iterator[pa.RecordBatch]:
    """Exact similarity of pairs whose elements are at hand."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        xs, ys = ([np.frombuffer(v.as_buffer(), np.uint64) for v in batch.column(c)] for c in ("x", "y"))
        nx, ny = np.array([len(v) for v in xs]), np.array([len(v) for v in ys])
        g = np.concatenate(xs + ys)
        at = np.concatenate((np.repeat(np.arange(n), nx), np.repeat(np.arange(n), ny)))
        order = np.lexsort((g, at))
        g, at = g[order], at[order]
        both = np.bincount(at[1:][(g[1:] == g[:-1]) & (at[1:] == at[:-1])], minlength=n)
        ok = both * plan.den >= plan.num * (nx + ny - both)
        sim = both / np.maximum(nx + ny - both, 1)
        yield pa.record_batch({"a": batch.column("a"), "b": batch.column("b"), "similarity": pa.array(sim)}).filter(pa.array(ok))


def _rounds(entries: float, sets: float, elements: float, least: int) -> tuple[int, int]:
    """(rounds, parts of each) for so many keys: 16 bytes for each, 28 for a set in every part that it is in."""
    most = max(ROUND, SHARE * (8 * elements + 40 * sets))
    parts = lambda n: int(max(least, entries / n // (SETS * KEYS)))
    size = lambda n: 16 * entries / n + 28 * min(entries / n, sets * parts(n))
    rounds = 1
    while size(rounds) > most:
        rounds = max(rounds + 1, int(rounds * min(2.0, size(rounds) / most)))
    return rounds, parts(rounds)


def _dealt(long: DataFrame, plan: Plan) -> DataFrame:
    """Pairs that meet in long lists, by pairs of blocks."""
    blocks = F.ceil(F.col("n") / plan.deal).cast("int")
    dealt = long.withColumn("own", F.pmod(F.xxhash64("a"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    return dealt.repartition("b", "i", "j").sortWithinPartitions("b", "i", "j").mapInArrow(lambda it: _blocks(it, plan), MET)


def _candidates(prepared: DataFrame, plan: Plan) -> DataFrame:
    """(a, b, size): classes of sets that may be similar and the sum of their sizes, written."""
    spark = prepared.sparkSession
    with tidy(spark):
        table = spark.sparkContext.broadcast(_count(prepared.mapInArrow(lambda it: _sketch(g for batch in it for _, g, _, _, _ in _sets(batch, plan)), SKETCH)))  # 2^BUCKETS bytes
        kept = scratch(spark, "prefixes")
        prefixes = written(prepared.select("text").mapInArrow(lambda it: _signatures(it, plan, table.value), PREFIX), "prefixes", kept)
        table.destroy()  # its copies are files as well
        lengths = spark.sparkContext.broadcast(_count(prefixes.select("size", "skip", "elements").mapInArrow(lambda it: _sketch(Prefixes.of(b).g for b in it if b.num_rows), SKETCH)))
        costs = prefixes.select("size", "skip", "elements").mapInArrow(lambda it: _costs(it, plan, lengths.value), "size int, " + ", ".join(f"{c} double" for c in COSTS))
        by = np.array(costs.groupBy("size").agg(*(F.sum(c) for c in COSTS)).collect(), float).reshape(-1, 1 + len(COSTS))  # one row a size
        size, sets, elements, light, subsets, lists, firsts = by.T
        heavy = lists > 0
        if heavy.any():
            plan = replace(plan, boundary=choose(np.column_stack((size, subsets, lists))[heavy], plan.num / plan.den))
        entries = light.sum() + subsets[size <= plan.boundary].sum() + firsts[size * plan.den >= plan.num * plan.boundary].sum()
        rounds, parts = _rounds(entries, sets.sum(), elements.sum(), spark.sparkContext.defaultParallelism)
        plan = replace(plan, parts=parts)
        paths = []
        for turn in range(rounds):
            keys = prefixes.mapInArrow(lambda it, turn=turn, plan=plan: _keys(it, plan, lengths.value, turn, rounds), PACKED)
            path = scratch(spark, "met")
            met = written(keys.repartition(parts, "part").mapInArrow(lambda it, plan=plan: _meet(it, plan), MET), "met", path)
            found = met.where("n = 0").unionAll(_dealt(met.where("n > 0"), plan))
            paths.append(scratch(spark, "candidates"))
            candidates = written(found.select("a", "b", "size").distinct(), "candidates", paths[-1])
            erase(spark, path)
        lengths.destroy()
        erase(spark, kept)
        if rounds > 1:  # a pair is met in several
            candidates = written(spark.read.schema(candidates.schema).parquet(*paths).distinct(), "candidates")
            for path in paths:
                erase(spark, path)
        return candidates


SIMILAR = "a long, b long, similarity double"


def _similar(found: DataFrame, sets: DataFrame, plan: Plan, records: int) -> DataFrame:
    """(a, b, similarity) of the candidates that reach the limit, in rounds where their elements are many times the prefixes."""

    def verified(found: DataFrame, x: DataFrame) -> DataFrame:
        both = found.join(x.select(F.col("class").alias("a"), F.col("elements").alias("x")), "a").join(sets.select(F.col("class").alias("b"), F.col("elements").alias("y")), "b")
        return both.mapInArrow(lambda it: _verify(it, plan), SIMILAR)

    moved = 4 * (found.agg(F.sum("size")).first()[0] or 0)  # the elements of one set of each pair
    rounds = -(-moved // max(int(ROUND), int(SHARE * 8 * KEYS * records)))
    if rounds <= 1:
        return verified(found, sets)
    spark, paths = found.sparkSession, []
    with tidy(spark):
        sets = written(sets, "sets")
        for q in range(rounds):
            of = lambda c: F.pmod(F.xxhash64(c), F.lit(rounds)) == q  # noqa: B023, E731
            paths.append(scratch(spark, "similar"))
            written(verified(found.where(of("a")), sets.where(of("class"))), "similar", paths[-1])
        return spark.read.schema(SIMILAR).parquet(*paths)


def _classes(prepared: DataFrame, plan: Plan) -> tuple[DataFrame, DataFrame]:
    """(members: id, class), (similar: class a, class b, similarity) of prepared: id, at, text."""
    found = _candidates(prepared, plan)
    wanted = prepared.sparkSession.sparkContext.broadcast(_filter.make(found, _class_hashes))
    rows = written(prepared.mapInArrow(lambda it: _members(it, plan, wanted.value), "id long, at timestamp, class long, elements binary"), "members")
    sets = rows.where("elements is not null").select("class", "elements").dropDuplicates(["class"])
    similar = _similar(found, sets, plan, rows.count())
    last = F.max(F.struct(F.col("at").isNotNull().alias("h"), "at", "class"))
    members = rows.groupBy("id").agg(last.alias("m")).select("id", F.col("m.class").alias("class")).where("class <> 0")
    return members, similar


def prepare_chunks(chunks: DataFrame) -> DataFrame:
    """id, at, text of every row of chunks: in lower case, with only letters, digits, space, tab and line feed."""
    text = F.regexp_replace(F.lower("text"), "[^\\p{L}\\p{Nd} \\t\\n]+", "")
    return chunks.where("chunk_id is not null").select(F.col("chunk_id").alias("id"), F.col("written_at").cast("timestamp").alias("at"), text.alias("text"))


def prepare_books(books: DataFrame) -> DataFrame:
    """id, at, text of current books lines with a title: title and author, letters and digits only, in lower case."""
    current = latest(books.select("path", "seq", "id", "title", "author"), ["path"], "seq").where("id is not null and title is not null and title <> ''")
    text = F.trim(F.regexp_replace(F.lower(F.concat("title", F.lit(" "), F.coalesce("author", F.lit("")))), "[^\\p{L}\\p{Nd}]+", " "))
    return current.select("id", F.lit(None).cast("timestamp").alias("at"), text.alias("text"))


def _pairs(members: DataFrame, similar: DataFrame) -> DataFrame:
    """(id_a, id_b): all pairs of records of one class or of similar classes.

    The records of a class are dealt to parts of about PART, so that no task has all pairs of a large class.
    """
    sized = members.groupBy("class").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / PART))
    known = members.join(sized, "class").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    every = F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)
    several, usable = known.where("n > 1"), known.select("class", "id", "part")
    left = several.select("class", F.explode(every).alias("part"), F.col("id").alias("id_a"))
    equal = left.join(several.select("class", "part", F.col("id").alias("id_b")), ["class", "part"]).where("id_a < id_b").select("id_a", "id_b")
    spread = similar.join(sized.select(F.col("class").alias("b"), "parts"), "b").select("a", "b", F.explode(every).alias("part"))
    x = spread.join(usable.select(F.col("class").alias("a"), F.col("id").alias("i")), "a").join(usable.select(F.col("class").alias("b"), "part", F.col("id").alias("j")), ["b", "part"])
    return equal.unionAll(x.where("i <> j").select(F.least("i", "j").alias("id_a"), F.greatest("i", "j").alias("id_b")))


CHUNKS = Plan(word_sets, 3, 5, 25)
BOOKS = Plan(char_sets, 7, 10, 1)


def near_duplicate_chunks(chunks: DataFrame, limit: tuple[int, int] = (3, 5), smallest: int = 25) -> DataFrame:
    """(id_a, id_b), id_a < id_b: current chunks whose sets of three consecutive words reach the limit (a fraction).

    Null and short texts are in no pair; texts of any length are taken whole; repeated and superseded rows don't
    count; an empty table gives no rows. Chunks with equal sets are all paired, so n of them give n (n - 1) / 2 rows.
    """
    return _pairs(*_classes(prepare_chunks(chunks), Plan(word_sets, *limit, smallest)))


def near_duplicate_books(books: DataFrame, limit: tuple[int, int] = (7, 10)) -> DataFrame:
    """(id_a, id_b), id_a < id_b: current books whose title and author reach the limit by 3-character substrings."""
    return _pairs(*_classes(prepare_books(books), Plan(char_sets, *limit, 1)))


def near_duplicate_documents(documents: DataFrame, limit: tuple[int, int] = (4, 5), words: int = 5) -> DataFrame:
    """(doc_id, class_id, links): documents by runs of five words at a similarity of 0.8.

    class_id is the smallest doc_id of the documents with the same set of runs, links the number of other classes it
    is similar to. Documents of fewer words than a run have a class by their normalised text, those without a word one
    of their own, and no links.
    """

    def make(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        h, row, _, _ = word_hashes(column)
        return distinct_per_row(*grams(h, row, words))

    text = F.trim(F.regexp_replace(F.lower("text"), "[^\\p{L}\\p{Nd}]+", " "))
    rows = documents.where("doc_id is not null").select(F.col("doc_id").alias("id"), F.lit(None).cast("timestamp").alias("at"), text.alias("text"))
    members, similar = _classes(rows, Plan(make, *limit, 1))
    links = similar.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count("*").alias("links"))
    heads = members.groupBy("class").agg(F.min("id").alias("class_id"))
    found = members.join(heads, "class").join(links, "class", "left").select(F.col("id").alias("doc_id"), "class_id", F.coalesce("links", F.lit(0)).alias("links"))
    short = rows.join(members.select("id"), "id", "left_anti").groupBy("id").agg(F.coalesce(F.max("text"), F.lit("")).alias("text"))
    same = short.where("text <> ''").groupBy("text").agg(F.min("id").alias("class_id"))
    return found.unionAll(short.join(same, "text", "left").select(F.col("id").alias("doc_id"), F.coalesce("class_id", "id").alias("class_id"), F.lit(0).cast("long").alias("links")))


def near_duplicates(books: DataFrame, chunks: DataFrame) -> DataFrame:
    """(kind, id_a, id_b) of books and chunks."""
    return near_duplicate_books(books).select(F.lit("book").alias("kind"), "id_a", "id_b").unionAll(near_duplicate_chunks(chunks).select(F.lit("chunk").alias("kind"), "id_a", "id_b"))
