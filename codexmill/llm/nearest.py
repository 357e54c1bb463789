"""Most similar vectors for every vector.

Method: balanced posting lists. Centroids are fitted on a bounded sample; every vector is stored in the list of its
nearest centroid and, near a boundary, in those of a few more. Centroids are searched through an in-memory graph of
neighbouring centroids: a search enters at the nearest of a few entry points and follows the edges from there; vectors
that enter at the same point are searched together, so that this is arithmetic on matrices. A vector is looked up in
the lists whose centroid is not much farther than the nearest one (distance-ratio pruning). How many lists and which
ratio that takes is measured: for a sample of vectors the true neighbours are found by a scan of all, and the cheapest
setting is taken that reaches the wanted share of them.

Neighbouring lists form groups, and a vector goes once to each group that it is stored or looked up in, with the
numbers of the lists. Large groups are worked on as a grid: those who ask are dealt to its rows, what is stored to its
columns, so no task holds all of either.

Equal vectors are one class throughout: only its smallest ids can be among the most similar of anything.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codexmill.session import written

#: Vectors that the centroids are fitted on, at most, and per list (a sample by hash of the id).
SAMPLE, PER_LIST = 1 << 20, 32
#: Vectors per list, as wished; lists, at most (their centroids are broadcast: 256 bytes each at 64 values, 32 MB).
LIST, LISTS = 512, 1 << 17
#: Centroids that are fitted at once; more are fitted in two levels.
FLAT = 2048
#: Lists that store a vector at most, and how much farther than the nearest a centroid may be for it.
REPLICAS, STORE_RATIO = 2, 1.15
#: Vectors that the recall is measured on, and lists a vector is looked up in at most.
MEASURED, PROBES = 1024, 256
#: Neighbours of a centroid in the graph, entry points of a search and hops from there.
DEGREE, ENTRIES, HOPS = 24, 4, 2
#: Lists of a group, about; vectors that a task of a group stores or looks up, about.
GROUP, GRID = 64, 1 << 16
#: Vectors of a list that are compared at once.
BLOCK = 4096


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


class Centroids:
    """Centroids with a graph over them, searched for many vectors at once."""

    def __init__(self, sample: np.ndarray, lists: int, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        x = unit(sample.astype(np.float32))
        self.c = self._centroids(x, min(lists, len(x)), rng)
        self.probes, self.ratio = PROBES, 1.25
        # entry points: centroids of the centroids, each standing for its nearest centroid
        top = self._fit(self.c, max(1, int(len(self.c) ** 0.5)), rng)
        self.entry = np.unique(self._nearest(top, self.c, 1)[:, 0])
        self.graph = self._nearest(self.c, self.c, min(DEGREE + 1, len(self.c)))
        self.groups = 1
        self.group = np.zeros(len(self.c), np.int64)
        self.reach = []
        for e in self.entry:
            seen = np.array([e])
            for _ in range(HOPS):
                seen = np.unique(np.concatenate((seen, self.graph[seen].ravel())))
            self.reach.append(seen)

    def grouped(self, groups: int, seed: int = 2) -> Centroids:
        """Puts neighbouring lists together in so many groups."""
        top = self._fit(self.c, min(groups, len(self.c)), np.random.default_rng(seed))
        self.group = np.unique(self._nearest(self.c, top, 1)[:, 0], return_inverse=True)[1]
        self.groups = int(self.group.max()) + 1
        return self

    def _centroids(self, x: np.ndarray, k: int, rng) -> np.ndarray:
        if k <= FLAT:
            return self._fit(x, k, rng)
        # two levels: each cell of the first gets centroids by its share of the sample
        top = self._fit(x, int(k**0.5), rng)
        cell = self._nearest(x, top, 1)[:, 0]
        out = []
        for j in range(len(top)):
            own = x[cell == j]
            if len(own):
                out.append(self._fit(own, min(len(own), max(1, round(k * len(own) / len(x)))), rng))
        return np.concatenate(out)

    @staticmethod
    def _nearest(q: np.ndarray, c: np.ndarray, k: int) -> np.ndarray:
        out = []
        for i in range(0, len(q), 2048):
            s = q[i : i + 2048] @ c.T
            top = np.argpartition(-s, k - 1, axis=1)[:, :k] if k < s.shape[1] else np.tile(np.arange(s.shape[1]), (len(s), 1))
            out.append(np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, 1), axis=1, kind="stable"), 1))
        return np.concatenate(out) if out else np.zeros((0, k), np.int64)

    def _fit(self, x: np.ndarray, k: int, rng, rounds: int = 4) -> np.ndarray:
        """Spherical k-means; a centroid that attracts too much is replaced by some of its own vectors, for balance."""
        c = x[rng.choice(len(x), k, replace=False)]
        for _ in range(rounds):
            near = self._nearest(x, c, 1)[:, 0]
            count = np.bincount(near, minlength=k)
            total = np.zeros_like(c)
            np.add.at(total, near, x)
            keep = count > 0
            c = np.where(keep[:, None], total / np.maximum(count, 1)[:, None], c)
            empty, crowded = np.flatnonzero(~keep), np.flatnonzero(count > 4 * max(1, len(x) // k))
            if len(empty) and len(crowded):
                pool = np.flatnonzero(np.isin(near, crowded))
                c[empty] = x[rng.choice(pool, len(empty))]
            c = unit(c)
        return c

    def search(self, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(centroids, cosines) of the k nearest found, nearest first; fewer than k are filled with cosine -3."""
        n, k = len(x), min(k, len(self.c))
        enter = self._nearest(x, self.c[self.entry], min(ENTRIES, len(self.entry)))
        ids, sims = np.zeros((n, 0), np.int64), np.zeros((n, 0), np.float32)
        for j in range(enter.shape[1]):
            new_ids, new_sims = np.zeros((n, k), np.int64), np.full((n, k), -3, np.float32)
            order = np.argsort(enter[:, j], kind="stable")
            cuts = np.searchsorted(enter[order, j], np.arange(len(self.entry) + 1))
            for e in np.unique(enter[:, j]):
                rows, reach = order[cuts[e] : cuts[e + 1]], self.reach[e]
                s = x[rows] @ self.c[reach].T
                m = min(k, len(reach))
                top = np.argpartition(-s, m - 1, axis=1)[:, :m] if m < s.shape[1] else np.tile(np.arange(m), (len(rows), 1))
                new_ids[rows, :m], new_sims[rows, :m] = reach[top], np.take_along_axis(s, top, 1)
            ids, sims = np.concatenate((ids, new_ids), 1), np.concatenate((sims, new_sims), 1)
            order = np.lexsort((-sims, ids))
            ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
            sims[:, 1:][ids[:, 1:] == ids[:, :-1]] = -3  # a centroid found again counts once
            order = np.argsort(-sims, axis=1, kind="stable")[:, :k]
            ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        return ids, sims

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, list, asked, stored) of unit vectors: lists to look a vector up in, and those that store it."""
        ids, sims = self.search(x, max(self.probes, REPLICAS))
        far = np.sqrt(np.maximum(0, 2 - 2 * sims))
        near = np.maximum(far[:, :1], 1e-6)
        asked = (far <= self.ratio * near) & (sims > -2)
        asked[:, self.probes :] = False
        asked[:, 0] = True
        stored = (far <= STORE_RATIO * near) & (sims > -2)
        stored[:, REPLICAS:] = False
        stored[:, 0] = True
        r, j = np.nonzero(asked | stored)
        return r, ids[r, j], asked[r, j], stored[r, j]

    def tune(self, asking: np.ndarray, found: list[np.ndarray], recall: float) -> Centroids:
        """Chooses probes and ratio: the fewest lists that hold the share `recall` of the vectors found for each of the asking ones."""
        ids, sims = self.search(unit(asking.astype(np.float32)), PROBES)
        far = np.sqrt(np.maximum(0, 2 - 2 * sims))
        ratio = np.where(sims > -2, far / np.maximum(far[:, :1], 1e-6), np.inf)
        rank, beyond = [], []
        for i, v in enumerate(found):
            if not len(v):
                continue
            own, own_sims = self.search(unit(v.astype(np.float32)), REPLICAS)
            own_far = np.sqrt(np.maximum(0, 2 - 2 * own_sims))
            held = (own_far <= STORE_RATIO * np.maximum(own_far[:, :1], 1e-6)) | (np.arange(own.shape[1]) == 0)
            at = np.where(held[:, :, None], own[:, :, None] == ids[i][None, None, :], False).any(axis=1)  # neighbour x probe
            hit = at.any(axis=1)
            first = at.argmax(axis=1)
            rank.append(np.where(hit, first, PROBES + 1))
            beyond.append(np.where(hit, ratio[i][first], np.inf))
        if not rank:
            return self
        rank, beyond = np.concatenate(rank), np.concatenate(beyond)
        options = []
        for p in (2, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256):
            for r in (1.02, 1.05, 1.1, 1.15, 1.2, 1.3, 1.4, 1.6, 2.0, 1e9):
                share = ((rank < p) & (beyond <= r)).mean()
                options.append((share < recall, 0.0 if share >= recall else -share, (ratio[:, :p] <= r).sum() / len(ratio), p, r))
        self.probes, self.ratio = min(options)[3:]
        return self


def usable(vectors: DataFrame, model: str, dim: int) -> DataFrame:
    """(id, q): per chunk the latest usable row of the model; q of `dim` values without nulls, not all zero."""
    ok = (F.col("model") == model) & (F.size("q") == dim) & F.exists("q", lambda x: x != 0) & ~F.exists("q", lambda x: x.isNull())
    last = F.max_by("q", F.struct(F.col("embedded_at").isNotNull(), "embedded_at", "q"))
    return vectors.where(ok & F.col("chunk_id").isNotNull()).groupBy(F.col("chunk_id").alias("id")).agg(last.alias("q"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(column.flatten().buffers()[1], np.int8, len(column) * dim, column.flatten().offset).reshape(-1, dim)


ENTRIES_SCHEMA = "group int, row int, col int, asks binary, stores binary, id long, q binary"


def _assign(batches: Iterator[pa.RecordBatch], centroids: Centroids, grid: np.ndarray, dim: int) -> Iterator[pa.RecordBatch]:
    """A row for each vector and group, with the lists it is looked up in and those that store it.

    grid: by group the number of rows, and of columns, that it is dealt to.
    """
    for batch in batches:
        for lo in range(0, batch.num_rows, 1024):
            part = batch.slice(lo, 1024)
            q, ids = _matrix(part.column("q"), dim), part.column("id").to_numpy()
            r, lists, asked, stored = centroids.assign(unit(q.astype(np.float32)))
            group = centroids.group[lists]
            order = np.lexsort((lists, group, r))
            r, lists, asked, stored, group = r[order], lists[order].astype(np.int32), asked[order], stored[order], group[order]
            begin = np.flatnonzero(np.concatenate(([True], (r[1:] != r[:-1]) | (group[1:] != group[:-1]))))
            rows: dict[str, list] = {c.split()[0]: [] for c in ENTRIES_SCHEMA.split(", ")}
            raw = q.tobytes()
            for x, y in zip(begin, [*begin[1:], len(r)], strict=True):
                g, i, n = int(group[x]), int(r[x]), int(grid[group[x]])
                asks, stores = lists[x:y][asked[x:y]].tobytes(), lists[x:y][stored[x:y]].tobytes()
                own = int(ids[i]) * 0x9E3779B97F4A7C15 % (1 << 64) >> 32
                if n == 1:
                    places = [(0, 0, asks, stores)]
                else:
                    places = [(own % n, c, asks, b"") for c in range(n) if asks] + [(w, own % n, b"", stores) for w in range(n) if stores]
                for w, c, ask, store in places:
                    for k, v in zip(rows, (g, w, c, ask, store, int(ids[i]), raw[i * dim : (i + 1) * dim]), strict=True):
                        rows[k].append(v)
            kinds = {"group": pa.int32(), "row": pa.int32(), "col": pa.int32(), "id": pa.int64()}
            yield pa.record_batch({k: pa.array(v, kinds.get(k, pa.binary())) for k, v in rows.items()})


def _first(a: np.ndarray, k: int) -> np.ndarray:
    """Which are among the first k of their value in a sorted array."""
    head = np.maximum.accumulate(np.where(np.concatenate(([True], a[1:] != a[:-1])), np.arange(len(a)), 0)) if len(a) else a
    return np.arange(len(a)) - head < k


def _best(a: np.ndarray, b: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best (a, b, cosine) of each a, each b once."""
    order = np.lexsort((b, -c, a))
    a, b, c = a[order], b[order], c[order]
    once = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1]))) if len(a) else np.zeros(0, bool)
    a, b, c = a[once], b[once], c[once]
    ok = _first(a, k)
    return a[ok], b[ok], c[ok]


def _top(ids: np.ndarray, x: np.ndarray, asked: np.ndarray, stored: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one list: for each vector asked about, its k best among those stored. Whole numbers, so cosines are exact."""
    qi, si = np.flatnonzero(asked), np.flatnonzero(stored)
    whole = x.astype(np.float64)
    norm = (whole**2).sum(1)
    u = unit(x.astype(np.float32))
    out = []
    for lo in range(0, len(qi) if len(si) else 0, 512):
        q = qi[lo : lo + 512]
        best: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for at in range(0, len(si), BLOCK):
            s = si[at : at + BLOCK]
            about = u[q] @ u[s].T  # in single precision, to choose; chosen ones are worked out exactly
            if least > -1:
                a, b = np.nonzero(about >= least - 1e-4)
            elif about.shape[1] <= k + 4:
                a, b = np.nonzero(about > -2)
            else:
                a, b = np.repeat(np.arange(len(q)), k + 4), np.argpartition(-about, k + 3, axis=1)[:, : k + 4].ravel()
            a, b = q[a], s[b]
            a, b = a[ids[a] != ids[b]], b[ids[a] != ids[b]]
            cos = np.einsum("nd,nd->n", whole[a], whole[b]) / np.sqrt(norm[a] * norm[b])
            ok = cos >= least
            best.append((ids[a[ok]], ids[b[ok]], cos[ok]))
        out.append(_best(*(np.concatenate(v) for v in zip(*best, strict=True)), k))
    return tuple(np.concatenate(v) for v in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


class Best:
    """The best found so far for each of n vectors, in single precision; a meeting has to beat the last of them."""

    def __init__(self, n: int, size: int, least: float) -> None:
        self.value, self.who = np.full((n, size), -2, np.float32), np.full((n, size), -1, np.int64)
        self.size, self.least = size, least - 1e-4 if least > -1 else -2.0

    def meet(self, u: np.ndarray, asking: np.ndarray, stored: np.ndarray) -> None:
        for lo in range(0, len(asking), 512):
            a = asking[lo : lo + 512]
            for at in range(0, len(stored), BLOCK):
                self._add(a, stored[at : at + BLOCK], u[a] @ u[stored[at : at + BLOCK]].T)

    def _add(self, a: np.ndarray, s: np.ndarray, about: np.ndarray) -> None:
        size = self.size
        beats = about >= np.maximum(self.value[a].min(axis=1), self.least)[:, None]
        many = np.flatnonzero(np.count_nonzero(beats, axis=1) > 4 * size)
        if len(many):  # of those the best alone, and itself
            top = np.argpartition(-about[many], size, axis=1)[:, : size + 1]
            beats[many] = False
            beats[many[:, None], top] = True
        r, c = np.nonzero(beats)
        fresh = (a[r] != s[c]) & ~(self.who[a[r]] == s[c][:, None]).any(axis=1)  # itself, or met in another list
        r, c = r[fresh], c[fresh]
        if not len(r):
            return
        v = about[r, c]
        order = np.lexsort((-v, r))
        r, c, v = r[order], c[order], v[order]
        ok = _first(r, size)
        r, c, v = r[ok], c[ok], v[ok]
        rows, begin, row = np.unique(r, return_index=True, return_inverse=True)
        place = np.arange(len(r)) - begin[row]
        value, who = np.full((len(rows), size), -2, np.float32), np.full((len(rows), size), -1, np.int64)
        value[row, place], who[row, place] = v, s[c]
        at = a[rows]
        value, who = np.concatenate((self.value[at], value), 1), np.concatenate((self.who[at], who), 1)
        keep = np.argpartition(-value, size - 1, axis=1)[:, :size]
        self.value[at], self.who[at] = np.take_along_axis(value, keep, 1), np.take_along_axis(who, keep, 1)


def _scan(batches: Iterator[pa.RecordBatch], dim: int, k: int, least: float) -> Iterator[pa.RecordBatch]:
    """Places of the grid of a group come in order; one at a time is held."""

    def flush(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(parts).combine_chunks()
        ids = t["id"].to_numpy()
        x = np.frombuffer(b"".join(t["q"].to_pylist()), np.int8).reshape(-1, dim)

        def lists(column: str) -> tuple[np.ndarray, np.ndarray]:
            raw = t[column].to_pylist()
            which, of = np.frombuffer(b"".join(raw), np.int32), np.repeat(np.arange(len(ids)), [len(v) // 4 for v in raw])
            order = np.argsort(which, kind="stable")
            return which[order], of[order]

        asked, who = lists("asks")
        stored, what = lists("stores")
        best, u = Best(len(ids), k + 4, least), unit(x.astype(np.float32))
        for one in np.intersect1d(asked, stored):
            best.meet(u, who[slice(*np.searchsorted(asked, (one, one + 1)))], what[slice(*np.searchsorted(stored, (one, one + 1)))])
        for lo in range(0, len(ids), 20_000):
            a, j = np.nonzero(best.who[lo : lo + 20_000] >= 0)
            a += lo
            b = best.who[a, j]
            va, vb = x[a].astype(np.float64), x[b].astype(np.float64)  # whole numbers, so cosines are exact
            cos = np.einsum("nd,nd->n", va, vb) / np.sqrt(np.einsum("nd,nd->n", va, va) * np.einsum("nd,nd->n", vb, vb))
            ok = (cos >= least) & (ids[a] != ids[b])
            a, b, cos = _best(ids[a[ok]], ids[b[ok]], cos[ok], k)
            if len(a):
                yield pa.record_batch({"id": pa.array(a), "other": pa.array(b), "cosine": pa.array(cos)})

    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.column_stack([batch.column(c).to_numpy() for c in ("group", "row", "col")])
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1), batch.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if held and tuple(key[lo]) != now:
                yield from flush(held)
                held = []
            now = tuple(key[lo])
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield from flush(held)


def _exact(batches: Iterator[pa.RecordBatch], ids: np.ndarray, asking: np.ndarray, dim: int, k: int, least: float) -> Iterator[pa.RecordBatch]:
    """The k best of a task for each of the asking vectors, by comparison with all."""
    best = None
    for batch in batches:
        for lo in range(0, batch.num_rows, BLOCK):
            part = batch.slice(lo, BLOCK)
            own, q = part.column("id").to_numpy(), _matrix(part.column("q"), dim)
            both, mark = np.concatenate((asking, q)), np.arange(len(ids) + len(own)) < len(ids)
            a, b, c = _top(np.concatenate((ids, own)), both, mark, ~mark, k, least)
            where = np.argsort(own, kind="stable")
            v = q[where[np.searchsorted(own[where], b)]]
            got = (a, b, c, v) if best is None else tuple(np.concatenate(z) for z in zip(best, (a, b, c, v), strict=True))
            order = np.lexsort((got[1], -got[2], got[0]))
            got = tuple(z[order] for z in got)
            best = tuple(z[_first(got[0], k)] for z in got)
    if best is not None and len(best[0]):
        yield pa.record_batch({"id": pa.array(best[0]), "other": pa.array(best[1]), "cosine": pa.array(best[2]), "q": pa.array([x.tobytes() for x in best[3]], pa.binary())})


def _neighbours(distinct: DataFrame, dim: int, k: int, least: float, recall: float) -> DataFrame:
    """(id, other, cosine): up to k most similar for every id; vectors must differ."""
    spark: SparkSession = distinct.sparkSession
    n = distinct.count()
    lists = max(1, min(LISTS, n // LIST))
    bucket = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    part = lambda size: distinct.where(bucket < int((1 << 30) * min(1.0, size / max(n, 1))) + 1)
    sample = part(min(SAMPLE, max(8192, PER_LIST * lists))).select("q").toArrow()["q"].combine_chunks()
    if not len(sample):
        sample = distinct.limit(1).select("q").toArrow()["q"].combine_chunks()
    if not len(sample):
        return spark.createDataFrame([], "id long, other long, cosine double")
    sample = _matrix(sample, dim)
    centroids = Centroids(sample, lists)
    cores = spark.sparkContext.defaultParallelism
    centroids.grouped(max(1, min(lists // 4, max(lists // GROUP, 2 * cores))))
    if lists > 1:
        some = part(MEASURED).select("id", "q").limit(4 * MEASURED).toArrow()
        if some.num_rows:
            ids, asking = some["id"].to_numpy(), _matrix(some["q"].combine_chunks(), dim)
            true = distinct.select("id", "q").mapInArrow(lambda it: _exact(it, ids, asking, dim, k, least), "id long, other long, cosine double, q binary")
            w = Window.partitionBy("id").orderBy(F.col("cosine").desc(), "other")
            true = true.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select("id", "q").toArrow()
            of, found = true["id"].to_numpy(), np.frombuffer(b"".join(true["q"].to_pylist()), np.int8).reshape(-1, dim)
            centroids.tune(asking, [found[of == i] for i in ids], recall)
    # the size of a group is estimated from the sample; it decides over the grid only
    some = unit(sample[: 1 << 14].astype(np.float32))
    row, near, _, _ = centroids.assign(some)
    entered = np.unique(row * centroids.groups + centroids.group[near]) % centroids.groups
    share = np.bincount(entered, minlength=centroids.groups) / len(some) * n
    grid = np.ceil(share / (2 * GRID)).astype(np.int64).clip(1)
    sent = spark.sparkContext.broadcast((centroids, grid))
    entries = distinct.mapInArrow(lambda it: _assign(it, *sent.value, dim), ENTRIES_SCHEMA)
    parts = max(int((grid**2).sum()), 1)
    found = entries.repartition(parts, "group", "row", "col").sortWithinPartitions("group", "row", "col").mapInArrow(lambda it: _scan(it, dim, k, least), "id long, other long, cosine double")
    w = Window.partitionBy("id").orderBy(F.col("cosine").desc(), F.col("other"))
    return found.distinct().withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r")


def most_similar(vectors: DataFrame, k: int = 5, least: float = -1.0, model: str = "emb-multi-2", dim: int = 64, recall: float = 0.96) -> DataFrame:
    """(chunk_id, other_id, cosine, rank): for every chunk with a usable vector its k most similar chunks.

    Equal cosines: the smaller chunk_id first. least > -1 leaves out pairs below that cosine. Unusable rows (null,
    cut off or all-zero q, another model) give nothing and are nobody's neighbours; repeated and older rows don't
    count; an empty table gives no rows. The search is approximate in which vectors it compares, exact in their
    cosines; recall is the share of the true neighbours, measured on a sample, that the lists looked up must hold.
    """
    current = written(usable(vectors, model, dim), "vectors")
    by_class = Window.partitionBy("q").orderBy("id")
    heads = current.withColumn("r", F.row_number().over(by_class)).where(F.col("r") <= k + 1)
    classes = written(heads.groupBy("q").agg(F.min("id").alias("id"), F.sort_array(F.collect_list("id")).alias("ids")), "classes")  # k + 1 ids at most
    near = _neighbours(classes.select("id", "q"), dim, k, least, recall)
    # candidates of a class: its own smallest ids, and those of its neighbours
    own = classes.select(F.col("id").alias("c"), F.explode("ids").alias("other"), F.lit(1.0).alias("cosine"))
    others = near.join(classes.select(F.col("id").alias("other"), "ids"), "other").select(F.col("id").alias("c"), F.explode("ids").alias("other"), "cosine")
    w = Window.partitionBy("c").orderBy(F.col("cosine").desc(), F.col("other"))
    best = own.unionAll(others).withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1)
    best = best.groupBy("c").agg(F.collect_list(F.struct("r", "other", "cosine")).alias("best")).where(F.size("best") > 1)
    named = classes.select(F.col("id").alias("c"), "q").join(best, "c").select("q", "best")
    members = current.join(named, "q").select("id", F.explode("best").alias("b")).where("b.other <> id")
    w = Window.partitionBy("id").orderBy("b.r")
    return members.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(F.col("id").alias("chunk_id"), F.col("b.other").alias("other_id"), F.col("b.cosine").alias("cosine"), "rank")


def similar_pairs(vectors: DataFrame, k: int = 5, least: float = 0.9, recall: float = 0.997) -> DataFrame:
    """(chunk_a, chunk_b), chunk_a < chunk_b: pairs of at least that cosine, one among the k most similar of the other."""
    top = most_similar(vectors, k, least, recall=recall)
    return top.select(F.least("chunk_id", "other_id").alias("chunk_a"), F.greatest("chunk_id", "other_id").alias("chunk_b")).distinct()
