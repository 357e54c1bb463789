"""Every operator against brute force on small tables: nulls, empty and long texts, ties, repeats, clashing columns."""

import random
import re
import time
from pathlib import Path
import unicodedata
from collections import Counter
from dataclasses import replace
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codexmill.llm import _words, encoding, leakage, near_duplicates, nearest, one_form, packing, scanned, splitting, term_frequency

T0 = datetime(2025, 1, 1)
CHUNKS = "chunk_id long, collection string, doc_id long, ord long, unit_from int, unit_to int, flags int, tokens int, text string, written_at timestamp, form string, part int"
BOOKS = "seq long, id long, path string, title string, author string, kind string"


def chunk(i, text, at=0, collection="default", doc=1, flags=8):
    return (i, collection, doc, i or 0, 1, 1, flags, None, text, T0 + timedelta(seconds=at), "clash", 1)


@pytest.fixture(scope="module")
def words():
    rng = random.Random(3)
    return ["".join(rng.choice("bdgklmnprstvz") + rng.choice("aeiou") for _ in range(rng.randint(2, 4))) for _ in range(400)]


# --- words


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("ab é\n\tж", max_size=12)), max_size=6))
def test_word_hashes_tell_words_apart(texts):
    h, row, start, end = _words.word_hashes(pa.array(texts, pa.string()))
    want = [(i, w) for i, t in enumerate(texts) for w in re.findall(r"[^ \n\t]+", t or "")]
    assert row.tolist() == [i for i, _ in want]
    names = {}
    for (_, w), x in zip(want, h.tolist(), strict=True):
        assert names.setdefault(w, x) == x
    assert len(set(names.values())) == len(names)


# --- problem 1


def test_term_counts(spark):
    rng = random.Random(1)
    rows = []
    for i in range(60):
        for at in range(rng.choice((1, 1, 2))):
            terms = rng.choice([None, [], [("Alpha", 1), (" beta ", 2), ("x", 3), (None, 4), ("y" * 41, 5), ("beta", 6)], [(rng.choice("abc") * 2, 1)] * 3])
            rows.append((i, terms, T0 + timedelta(seconds=at), "clash"))
    rows += [rows[0], (None, [("lost", 1)], T0, "x")]
    df = spark.createDataFrame(rows, "chunk_id long, terms array<struct<term:string,pos:int>>, analyzed_at timestamp, occurrences string")
    last = {}
    for i, t, at, _ in rows:
        if i is not None and (i not in last or at >= last[i][0]):
            last[i] = (at, t)
    occ, chunks = Counter(), Counter()
    for _, t in last.values():
        good = [w for w in ((x[0] or "").strip().lower() for x in t or []) if 2 <= len(w) <= 40]
        occ.update(good)
        chunks.update(set(good))
    got = {r.term: (r.occurrences, r.chunks) for r in term_frequency.term_counts(df).collect()}
    assert got == {w: (occ[w], chunks[w]) for w in occ}
    marks = {r.term: r.mark for r in term_frequency.marked_terms(df).collect()}
    assert marks == {w: "rare" if n < 3 else "common" if n > 0.28 * len(last) else None for w, n in chunks.items()}
    assert term_frequency.marked_terms(df.limit(0)).count() == 0


def test_radix_splits_give_the_same(spark, monkeypatch):
    import duckdb

    monkeypatch.setattr(term_frequency, "SPLIT_ROWS", 10)
    con = duckdb.connect()
    con.execute("create table partial as select 'w' || (i % 37) term, 1::bigint occurrences, 1::bigint chunks from range(500) t(i) union all select 'hot', 1, 1 from range(100)")
    rows = [r for b in term_frequency._radix(con, "partial", 0, 600) for r in b.to_pylist()]
    assert len(rows) == 38 and sum(r["occurrences"] for r in rows) == 600


# --- problem 2


def test_pieces(spark):
    rng = random.Random(2)
    texts = ["x" * 95, "word " * 60, "One sentence here. " * 12 + "\n\n" + "Next paragraph, long. " * 9, "\n" * 50, "ёж 🙂 " * 30, " " * 80, "short", "", None, "a b\n" * 4000]
    opts = spark.createDataFrame([("default", 40, 30, 10, "x"), ("tiny", 5, 5, 9, "x"), ("null", None, 3, 3, "x"), ("far", 30, 90, None, "x"), (None, 1, 1, 1, "x")], "collection string, chars int, step int, min_chars int, text string")
    o = {"default": (40, 30, 10), "tiny": (5, 5, 5), "null": (40, 30, 10), "far": (30, 30, 0), "none": (40, 30, 10)}
    rows = [chunk(k * 10 + j, t, collection=c) for k, t in enumerate(texts) for j, c in enumerate(o)]
    rows += [chunk(1000, "long " * 20, 0), chunk(1000, "now short", 5), rows[0], chunk(None, "z" * 99)]
    got = {}
    for r in splitting.split_oversized(spark.createDataFrame(rows, CHUNKS), opts).collect():
        got.setdefault(r.chunk_id, []).append((r.piece_no, r.start, r.text))
    want = {r[0] for r in rows if r[0] not in (None, 1000) and len(r[8] or "") > o[r[1]][0]}
    assert set(got) == want
    for r in rows:
        if r[0] in want:
            chars, step, least = o[r[1]]
            end, ps = 0, sorted(got[r[0]])
            assert [p[0] for p in ps] == list(range(len(ps)))
            for n, start, t in ps:
                assert len(t) <= chars and r[8][start : start + len(t)] == t and start <= end
                assert n == 0 or len(t) >= least
                end = start + len(t)
            assert end == len(r[8])
    none = splitting.split_oversized(spark.createDataFrame(rows, CHUNKS), opts.where("collection = 'tiny'"))
    assert {r.chunk_id for r in none.collect()} <= {r[0] for r in rows if r[1] == "tiny"}
    del rng


# --- problem 3


def scan_tables(spark, words, seed=1):
    """Books with clean and scanned chunks, and what was done to each."""
    rng, rows, truth, clean = random.Random(seed), [], set(), {}
    lex = [w for w in words if len(w) > 4][:120]
    books = [(b, b, f"/b{b}", f"{rng.choice(lex).title()} And The {rng.choice(lex).title()} {rng.choice(lex).title()}", None, "scan") for b in range(1, 9)]
    for i in range(600):
        flow = " ".join(rng.choice(lex) for _ in range(40)).capitalize() + "."
        book = books[i % 8]
        if i % 3:
            rows.append(chunk(i, flow, doc=book[1]))
            continue
        lines, line = [], ""
        for w in flow.split():
            if len(line) + len(w) > 40:
                lines.append(line.strip())
                line = ""
            line += w + " "
        lines.append(line.strip())
        lines = [x for x in lines if x]
        clean[i] = flow
        kind = i % 4
        if kind == 1:
            w = lines[1].split()[0]
            lines[0], lines[1] = lines[0] + " " + w[:2] + "-", w[2:] + lines[1][len(w) :]
            truth.add((i, "hyphen"))
        elif kind == 2:
            lines.insert(0, f"{book[3]}   {i + 1}")
            truth.add((i, "header"))
        elif kind == 3:
            lines.append(f"- {i + 1} -")
            truth.add((i, "pageno"))
        elif any("o" in w for w in lines[1].split()):
            w = next(w for w in lines[1].split() if "o" in w)
            lines[1] = lines[1].replace(w, w.replace("o", "0", 1), 1)
            truth.add((i, "chars"))
        rows.append(chunk(i, "\n".join(lines), doc=book[1]))
    rows += [chunk(9000, None), chunk(9001, ""), chunk(9002, "if x {\n12\n}", flags=9), rows[0], chunk(None, "- 3 -\nabc")]
    return spark.createDataFrame(rows, CHUNKS), spark.createDataFrame(books, BOOKS), truth, clean


def test_noise_is_found_and_repaired(spark, words):
    chunks, books, truth, clean = scan_tables(spark, words)
    got = {tuple(r) for r in scanned.noise(chunks, books).collect()}
    assert len(truth - got) <= 0.03 * len(truth) and len(got - truth) <= 0.03 * len(truth), (list(truth - got)[:5], list(got - truth)[:5])
    fixed = {r.chunk_id: r.text for r in scanned.repaired(chunks, books).collect()}
    right = sum(fixed.get(i) == clean[i] for i, _ in truth)
    assert right >= 0.95 * len(truth)
    assert scanned.noise(chunks.limit(0), books.limit(0)).count() == 0


def test_misreadings():
    assert scanned.misreadings("modern", "rnodern") == 1 and scanned.misreadings("cloud", "c1oucl") == 2
    assert scanned.misreadings("cat", "dog") is None and scanned.misreadings("same", "same") == 0


def test_both_sides_of_a_misreading_have_one_shape():
    forms = scanned.shapes(scanned.MISREAD)
    for a, b in scanned.MISREAD:
        assert "".join(forms[c] for c in a) == "".join(forms[c] for c in b)


def test_all_double_misreadings_are_candidates(spark):
    def once(w):
        return {w[: m.start()] + b + w[m.end() :] for a, b in scanned.MISREAD for m in re.finditer(re.escape(a), w)}

    printed = ["deletes", "channel", "vermont", "modul", "table", "index", "windows", "buffers", "goroutine", "dictionaries", "канал", "цикл", "поток", "функция", "рекурсия", "множество", "переменная", "vemexiti"]
    pairs = {(r, w) for w in printed for x in once(w) for r in {x} | once(x) if r != w and r not in printed}
    limit = lambda w: 2 if len(w) < 6 else 3 if len(w) < 9 else 4
    want = {(r, w) for r, w in pairs if scanned.distance(r, w) <= limit(w) and abs(len(r) - len(w)) <= 2}
    words = spark.createDataFrame([(w, 1000) for w in printed] + [(r, 1) for r in {r for r, _ in pairs}], "word string, n long")
    got = {(r.read, r.printed) for r in scanned.candidates(words).collect()}
    assert ("dclctes", "deletes") in want and len(want) > 500
    assert want <= got, (len(want - got), sorted(want - got)[:5])


# --- problem 5


def sets_of(text):
    w = re.sub(r"[^\w \t\n]|_", "", text.lower()).split()
    return frozenset(zip(w, w[1:], w[2:], strict=False))


def jaccard_pairs(sets, num, den):
    ids = sorted(sets)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (n := len(sets[a] & sets[b])) * den >= num * (len(sets[a]) + len(sets[b]) - n)}


@pytest.mark.parametrize("light,boundary", [(None, None), (1, 4096), (2, 32), (250, 64)])
def test_near_duplicates_are_complete(spark, words, monkeypatch, light, boundary):
    rng, rows = random.Random(4), []
    small = words[:40]  # few words, so elements are shared by many sets
    for i in range(0, 240, 3):
        t = [rng.choice(small) for _ in range(rng.choice((30, 45, 60, 400 if i % 30 == 0 else 50)))]
        rows.append(chunk(i, " ".join(t)))
        for k in (1, 2):
            v = list(t)
            for _ in range(rng.randint(0, 4)):
                v[rng.randrange(len(v))] = rng.choice(small)
            rows.append(chunk(i + k, ", ".join(v).upper() if k == 2 else " ".join(v)))
    rows += [chunk(1000, "too short"), chunk(1001, None), chunk(1002, ""), chunk(3, rows[0][8], -5), rows[5], chunk(None, rows[0][8])]
    if light:
        monkeypatch.setattr(near_duplicates, "choose", lambda *a: boundary)
    plan = near_duplicates.Plan(near_duplicates.word_sets, 3, 5, 25, light=light or near_duplicates.LIGHT, deal=10)
    got = {tuple(r) for r in near_duplicates._pairs(*near_duplicates._classes(near_duplicates.prepare_chunks(spark.createDataFrame(rows, CHUNKS)), plan)).collect()}
    if not light:
        assert got == {tuple(r) for r in near_duplicates.near_duplicate_chunks(spark.createDataFrame(rows, CHUNKS)).collect()}
    now = {r[0]: r[8] for r in rows if r[0] is not None and r[9] >= T0 and r[8]}
    want = jaccard_pairs({i: s for i, t in now.items() if len(s := sets_of(t)) >= 25}, 3, 5)
    assert got == want and want


def test_books_and_copies(spark):
    rows = [(i, i, f"/p{i}", "The Same Book of Channels", "A. Author", "ok") for i in range(1, 10)] + [(20, 20, "/q", "The Same Book of Channel", None, "ok"), (21, 21, "/r", None, "x", "ok"), (22, 22, "/s", "", "x", "ok"), (23, 23, "/t", "Ab", None, "ok"), (24, 24, "/u", "Ab", None, "ok")]
    got = {tuple(r) for r in near_duplicates.near_duplicate_books(spark.createDataFrame(rows, BOOKS)).collect()}
    assert got == {(a, b) for a in range(1, 10) for b in range(a + 1, 10)}
    assert near_duplicates.near_duplicate_books(spark.createDataFrame([], BOOKS)).count() == 0


def test_documents_without_a_run_have_a_class(spark):
    long = "one two three four five six"
    rows = [(1, "Two words"), (2, "two, WORDS!"), (3, "other words"), (4, None), (5, ""), (6, " .\n"), (7, long), (8, long.upper()), (None, "two words"), (9, " two words two words ")]
    got = sorted(tuple(r) for r in near_duplicates.near_duplicate_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 1, 0), (2, 1, 0), (3, 3, 0), (4, 4, 0), (5, 5, 0), (6, 6, 0), (7, 7, 0), (8, 7, 0), (9, 9, 0)]


def test_large_classes_are_paired_in_full(spark, words):
    # equal sets of differently stored titles, more than 200 of them, and similar ones beside them
    spelled = ["The Same Book of Channels", "THE SAME BOOK OF CHANNELS!", "the same, book of: channels"]
    rows = [(i, i, f"/p{i}", spelled[i % 3], "A. Author", "ok") for i in range(1, 231)] + [(i, i, f"/q{i}", "The Same Book of Channel", "A. Author", "ok") for i in range(300, 303)]
    rows.append((400, 400, "/r", "Another Title", None, "ok"))
    got = [tuple(r) for r in near_duplicates.near_duplicate_books(spark.createDataFrame(rows, BOOKS)).collect()]
    near = [*range(1, 231), *range(300, 303)]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for k, a in enumerate(near) for b in near[k + 1 :]}
    text = " ".join(words[:40])
    rows = [chunk(i, text.upper() if i % 2 else text) for i in range(210)] + [chunk(500, text + " " + words[50])]
    got = [tuple(r) for r in near_duplicates.near_duplicate_chunks(spark.createDataFrame(rows, CHUNKS)).collect()]
    near = [*range(210), 500]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for k, a in enumerate(near) for b in near[k + 1 :]}


# --- problem 6

WORKS = ["Библиотека открывает сегмент и хранит частичный планировщик.", "После обновления “façade” показал — résumé готово."]


@pytest.mark.parametrize("read", ["cp1251", "cp1252", "latin_1", "koi8_r", "cp866", "cp437"])
def test_round_trip_utf8(read):
    for text in WORKS[:1] + ["The naïve façade shows a “señal” — at once."]:
        raw = text.encode()
        shown = "".join(bytes([b]).decode(read, "ignore") or chr(b) for b in raw)
        got = encoding.repair_segment(shown)
        assert got and got[0] == text and not got[2], (read, text, got)


@pytest.mark.parametrize("read,written", [("cp1252", "cp1251"), ("koi8_r", "cp1251"), ("cp1251", "koi8_r"), ("cp1251", "cp866")])
def test_round_trip_single_bytes(read, written):
    shown = "".join(bytes([b]).decode(read, "ignore") or chr(b) for b in WORKS[0].encode(written))
    assert encoding.repair_segment(shown)[0] == WORKS[0]


def test_clean_text_stays():
    for text in [*WORKS, "ПРАКТИКА NOVORAKI: ЗАШИФРОВАННЫЙ КУРСОР", "The naïve señal, über-fast résumé — “déjà-vu”.", "С пакетом Denemeri 🙂 можно № 5", "x == y && z", "wor­\nkers", ""]:
        assert encoding.repair_text(text) is None, text


def test_garbled_rows(spark):
    bad = "Clean one. " + "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in WORKS[0].encode())
    rows = [chunk(1, bad), chunk(2, "fine"), chunk(3, bad), chunk(3, "fine now", 9), chunk(4, "lost �� bytes"), chunk(5, None), chunk(1, bad), chunk(None, bad), chunk(6, "a. " * 5000 + bad)]
    got = {r.chunk_id: r for r in encoding.garbled(spark.createDataFrame(rows, CHUNKS)).collect()}
    assert set(got) == {1, 4, 6} and got[1].restored == "Clean one. " + WORKS[0] and not got[1].lost and got[4].lost
    assert encoding.garbled(spark.createDataFrame([], CHUNKS)).count() == 0


# --- problem 7

VECTORS = "chunk_id long, model string, dim int, q array<tinyint>, embedded_at timestamp, list string"


def test_nearest_recall(spark, monkeypatch):
    monkeypatch.setattr(nearest, "LIST", 64)
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(60, 64))
    x = np.clip(np.rint((centers[rng.integers(0, 60, 1500)] + 0.6 * rng.normal(size=(1500, 64))) * 40), -127, 127).astype(int)
    x[700:720] = x[0]  # copies
    rows = [(i, "emb-multi-2", 64, v.tolist(), T0, "x") for i, v in enumerate(x)]
    rows += [(1, "emb-multi-2", 64, x[5].tolist(), T0 - timedelta(1), "x"), (2000, "emb-multi-2", 64, [0] * 64, T0, "x"), (2001, "emb-multi-2", 64, None, T0, "x"), (2002, "emb-multi-2", 64, [1] * 40, T0, "x"), (2003, "other", 64, [1] * 64, T0, "x"), rows[3]]
    df = spark.createDataFrame(rows, VECTORS)
    n = np.sqrt((x.astype(float) ** 2).sum(1))
    cos = (x @ x.T) / n[:, None] / n
    np.fill_diagonal(cos, -2)
    best = np.argsort(-cos, axis=1, kind="stable")[:, :5]
    got = {}
    for r in nearest.most_similar(df).collect():
        got.setdefault(r.chunk_id, {})[r.rank] = (r.other_id, r.cosine)
    hits = sum(len({o for o, _ in got.get(i, {}).values()} & set(best[i].tolist())) for i in range(1500))
    assert hits >= 0.9 * 7500
    assert [got[705][k][0] for k in range(1, 6)] == [0, 700, 701, 702, 703]  # ties: smaller ids first
    pairs = {tuple(r) for r in nearest.similar_pairs(df).collect()}
    want = {(min(i, j), max(i, j)) for i in range(1500) for j in best[i].tolist() if cos[i, j] >= 0.9}
    assert pairs <= want and len(pairs) >= 0.95 * len(want)
    assert nearest.similar_pairs(df.limit(0)).count() == 0


# --- problem 8


def test_hilbert_neighbours():
    g = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    key = packing.hilbert(g, 3)
    assert sorted(key.tolist()) == list(range(512))
    assert set(np.abs(np.diff(g[np.argsort(key)], axis=0)).sum(1).tolist()) == {1}


def test_packing(spark, words):
    rng = random.Random(7)
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.choice((1, 5, 20, 60, 300)))), "x") for i in range(400)] + [(500, None, "x"), (501, "", "x"), (502, "  ", "x")]
    kinds = spark.createDataFrame([("small", 64), ("large", 512), ("bad", 0), (None, 5)], "container string, capacity int")
    df = spark.createDataFrame(docs, "doc_id long, text string, tokens string")
    p = packing.packed(df, kinds)
    enc = packing.encoder(packing.VOCABULARY)
    size = {i: len(enc.encode_ordinary(t)) for i, t, _ in docs if t}
    for name, cap in (("small", 64), ("large", 512)):
        rows = p.where(F.col("container") == name).collect()
        used, whole, pieces = Counter(), Counter(), Counter()
        for r in rows:
            used[r.bin] += r.tokens
            whole[r.doc_id] += r.tokens
            pieces[r.doc_id] += 1
        assert whole == Counter(size) and max(used.values()) <= cap
        assert all(pieces[i] == max(1, -(-n // cap)) for i, n in size.items())
        assert len(used) <= 1.03 * sum(size.values()) / cap + 2
    assert {r.container for r in packing.fill(p, kinds).collect()} == {"small", "large"}
    assert packing.packed(df.limit(0), kinds).count() == 0


# --- problem 9


def test_leaks(spark, words, monkeypatch):
    rng = random.Random(9)
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice((5, 12, 30)))), "x") for i in range(40)]
    items += [(100, None, "x"), (101, "", "x"), (102, items[3][1], "x"), (None, items[3][1], "x")]
    docs = []
    for i in range(300):
        t = [rng.choice(words) for _ in range(rng.choice((3, 40, 120)))]
        if i % 4 == 0:
            w = items[i % 40][1].split()
            k = rng.randint(0, len(w) - 1)
            at = rng.randint(0, len(t))
            t[at:at] = w[k : k + rng.randint(8, 20)]
        docs.append((i, (", " if i % 3 else "\n").join(t).upper(), "clash"))
    docs += [(900, None, "x"), (901, "", "x"), (902, " ".join(x[1] or "" for x in items), "x")]
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    e = spark.createDataFrame(items, "item_id long, text string, doc_id string")
    split = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    twelve = lambda t: {tuple(w[k : k + 12]) for w in [split(t)] for k in range(len(w) - 11)}
    want = {(i, j) for i, t, _ in docs for j, u, _ in items if j is not None and twelve(t) & twelve(u)}
    got = {(r.doc_id, r.item_id): r for r in leakage.leaks(d, e).collect()}
    assert set(got) == want and want
    for s in leakage.leaked_spans(d, e).collect():
        w, v = split(docs[s.doc_id][1] if s.doc_id < 300 else docs[-1][1]), split(dict((a, b) for a, b, _ in items)[s.item_id])
        a, b, n = s.doc_word, s.item_word, s.words
        assert w[a : a + n] == v[b : b + n] and n >= 12
        assert a + n == len(w) or b + n == len(v) or w[a + n] != v[b + n]
    monkeypatch.setattr(leakage, "BLOCK_WORDS", 50)
    assert {(r.doc_id, r.item_id) for r in leakage.leaks(d, e).collect()} == want
    kept = {r.doc_id for r in leakage.without_leaks(d, e).collect()}
    assert kept == {i for i, *_ in docs} - {i for i, _ in want}
    assert leakage.leaks(d, e.limit(0)).count() == 0 and leakage.leaks(d.limit(0), e).count() == 0


# --- problem 10


def test_forms():
    same = [("ａｂｃ１，", "abc1,"), ("й", "й"), ("ё", "ë"), ("сор", "cop"), ("a​b­c", "abc"), ("a b c", "a b c"), ("Αlpha", "Alpha"), ("é‍", "é")]
    for a, b in same:
        assert one_form.one_form(a) == one_form.one_form(b), (a, b)
    apart = [("①", "1"), ("½", "1/2"), ("A", "a"), ("e", "é"), ("a  b", "a b"), ("a\nb", "a b"), ("👩‍💻", "👩💻"), ("кот", "kot"), ("5×3", "5x3"), ("…", "..")]
    for a, b in apart:
        assert one_form.one_form(a) != one_form.one_form(b), (a, b)
    assert one_form.one_form("Straße", fold=True) == one_form.one_form("STRASSE", fold=True) and one_form.one_form(None) is None


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=30))
def test_form_is_stable(text):
    once = one_form.one_form(text)
    assert one_form.one_form(once) == once and unicodedata.is_normalized("NFC", once)


def test_look_alikes(spark):
    rows = [(1, "same text"), (2, "sаme text"), (3, "same text"), (4, "same​ text"), (5, "Same text"), (6, None), (7, "—"), (8, "​—"), (9, ""), (10, "x" * 50000), (11, "х" * 50000)]
    df = spark.createDataFrame([(*r, "clash") for r in [*rows, rows[1]]], "doc_id long, text string, form string")
    got = {tuple(r) for r in one_form.look_alikes(df).collect()}
    assert got == {(1, 2), (1, 4), (2, 3), (2, 4), (3, 4), (10, 11)}
    classes = {r.doc_id: r.class_id for r in one_form.form_classes(df).collect()}
    assert classes[4] == 1 and classes[5] == 5 and 7 not in classes and 9 not in classes
    assert one_form.look_alikes(df.limit(0)).count() == 0


def test_suffix_arrays_against_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(150):
        k, (n, m), least = rng.integers(1, 4), rng.integers(0, 40, 2), int(rng.integers(1, 5))
        w, row = rng.integers(0, k, n).astype(np.uint64), np.sort(rng.integers(0, 4, n))
        t, tests = rng.integers(0, k, m).astype(np.uint64), np.sort(rng.integers(0, 3, m))
        a, b, words = leakage.Shard.of(w, row, least).search(t, tests)
        used, first = np.unique(row, return_index=True)
        begins = first + np.arange(len(used))
        got = sorted(zip((a - np.searchsorted(begins, a, "right") + 1).tolist(), b.tolist(), words.tolist(), strict=True))
        want = []
        for i in range(n):
            for j in range(m):
                if i and j and row[i - 1] == row[i] and tests[j - 1] == tests[j] and w[i - 1] == t[j - 1]:
                    continue
                size = 0
                while i + size < n and j + size < m and row[i + size] == row[i] and tests[j + size] == tests[j] and w[i + size] == t[j + size]:
                    size += 1
                if size >= least:
                    want.append((i, j, size))
        assert got == sorted(want)


def test_equal_words_give_their_maximal_runs_only():
    words, row = np.full(100_000, 7, np.uint64), np.zeros(100_000, np.int64)
    began = time.time()
    a, b, size = leakage.Shard.of(words, row, 12).search(words, row)
    assert len(a) == 2 * (100_000 - 11) - 1 and size.max() == 100_000 and (size >= 12).all() and not (np.minimum(a, b) > 0).any()
    assert time.time() - began < 5


def test_evaluation_texts_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(leakage, "BLOCK_WORDS", 15)
    items = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(14))) for i in range(5)], "item_id long, text string")
    docs = spark.createDataFrame([(i, "before " + " ".join(f"w{i}x{k}" for k in range(1, 14)) + " after") for i in range(4)], "doc_id long, text string")
    assert sorted(map(tuple, leakage.leaked_spans(docs, items).collect())) == [(i, i, 13, 1, 1) for i in range(4)]


def test_long_texts_are_split_in_proportion(spark):
    rng = random.Random(3)
    took = []
    opts = spark.createDataFrame([("default", 900, 700, 50)], "collection string, chars int, step int, min_chars int")
    for n in (400_000, 1_600_000):
        text = "".join(rng.choice("абвгд еж. зи\n") for _ in range(n))
        df = spark.createDataFrame([(1, "default", text, None)], "chunk_id long, collection string, text string, written_at timestamp")
        began = time.time()
        rows = sorted(splitting.split_oversized(df, opts).collect(), key=lambda r: r.piece_no)
        took.append(time.time() - began)
        assert all(text[r.start : r.start + len(r.text)] == r.text and len(r.text) <= 900 for r in rows)
        ends = [r.start + len(r.text) for r in rows]
        assert ends[-1] == n and all(b.start <= a for a, b in zip(ends, rows[1:], strict=False))
    assert took[1] < 12 * took[0] + 5


def test_terms_of_tied_and_older_rows_count_once(spark):
    t = lambda *ws: [(w, i) for i, w in enumerate(ws)]
    rows = [
        (1, T0, t("old", "aa")), (1, T0 + timedelta(1), t("aa", "aa", "a\x1fb")), (1, T0 + timedelta(1), t("aa", "aa", "a\x1fb")),
        (2, T0, t("aa", None, " BB ")), (3, None, None), (4, T0, []), (None, T0, t("aa")),
    ]
    df = spark.createDataFrame(rows, "chunk_id long, analyzed_at timestamp, terms array<struct<term string, pos int>>")
    got = {r.term: (r.occurrences, r.chunks) for r in term_frequency.term_counts(df).collect()}
    assert got == {"aa": (3, 2), "bb": (1, 1), "a\x1fb": (1, 1)}


def test_forms_of_many_texts_at_once(spark):
    rng = random.Random(2)
    pool = "abc XYZ абвёй АВЕ ονρ éà №–… \t\n" + " ​­ｆ０́̈ﬁ①ª²"
    rows = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 6))) for _ in range(2000)] + [chr(c) for c in range(0x80, 0x2200)] + [None, ""]
    for fold in (False, True):
        got = one_form.with_form(spark.createDataFrame([(x,) for x in rows], "text string"), fold=fold).collect()
        assert all(r.form == one_form.one_form(r.text, fold) for r in got)


def test_tasks_of_packing_follow_from_the_texts(spark, monkeypatch):
    monkeypatch.setattr(packing, "TASK", 50)
    df = spark.createDataFrame([(i, f"some words of text {i}") for i in range(1000)], "doc_id long, text string")
    kinds = spark.createDataFrame([("c", 64)], "container string, capacity int")
    p = packing.packed(df, kinds)
    assert len({r.bin >> 40 for r in p.collect()}) > 15 and p.select("doc_id").distinct().count() == 1000


def _shared(words, n, size=200):
    """n texts of their own words that share one run of three words, and a near copy of every 500th."""
    rng = random.Random(9)
    texts = [" ".join([f"{rng.choice(words)}{i}x{k}" for k in range(size)] + ["all of them"]) for i in range(n)]
    return texts + [t.replace("x7 ", "y7 ", 1) for t in texts[::500]]


def test_a_heavy_element_makes_no_pairs_of_all(spark, words):
    texts = _shared(words, 10_000)
    df = spark.createDataFrame([(i, None, t) for i, t in enumerate(texts)], "id long, at timestamp, text string").repartition(4)
    plan = near_duplicates.Plan(near_duplicates.word_sets, 3, 5, 25)
    began = time.time()
    found = near_duplicates._candidates(df, plan)
    assert found.count() == 20 and time.time() - began < 60


def test_keys_of_few_words_are_met_in_rounds(spark, monkeypatch):
    """Subsets take many times the space of the texts; their files go with each round."""
    monkeypatch.setattr(near_duplicates, "ROUND", 2_000_000, raising=False)
    monkeypatch.setattr(near_duplicates, "choose", lambda *a: 10_000)
    rng = random.Random(6)
    texts = [" ".join(rng.choices("abcdefgh", k=60)) for _ in range(1500)]
    texts += [t[:-1] + "z" for t in texts[::100]]
    jvm, seen = spark.sparkContext._jvm, []
    spark.sparkContext._jvm.System.gc()
    local = list(jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    used = lambda: sum(p.stat().st_size for d in local for p in Path(d).rglob("shuffle_*") if p.exists())
    written, before = near_duplicates.written, used()

    def watched(*args):
        out = written(*args)
        seen.append(used() - before)
        return out

    monkeypatch.setattr(near_duplicates, "written", watched)
    df = spark.createDataFrame([(i, None, t) for i, t in enumerate(texts)], "id long, at timestamp, text string")
    found = near_duplicates._candidates(df, near_duplicates.Plan(near_duplicates.word_sets, 3, 5, 25, light=5)).collect()
    assert len(found) >= 15 and len(set(found)) == len(found)
    assert len(seen) > 6 and max(seen) < 4_000_000


def test_candidates_are_verified_in_rounds(spark, words, monkeypatch):
    monkeypatch.setattr(near_duplicates, "ROUND", 10_000, raising=False)
    monkeypatch.setattr(near_duplicates, "SHARE", 0.01, raising=False)
    rng, rows, made, written = random.Random(4), [], [], near_duplicates.written
    for i in range(0, 200, 2):
        t = [rng.choice(words[:200]) for _ in range(60)]
        rows += [chunk(i, " ".join(t)), chunk(i + 1, " ".join([*t[:-2], "x"]))]
    monkeypatch.setattr(near_duplicates, "written", lambda df, what, *path: made.append(what) or written(df, what, *path))
    got = [tuple(r) for r in near_duplicates.near_duplicate_chunks(spark.createDataFrame(rows, CHUNKS)).collect()]
    want = jaccard_pairs({r[0]: s for r in rows if len(s := sets_of(r[8])) >= 25}, 3, 5)
    assert len(got) == len(want) and set(got) == want and made.count("similar") > 2


@pytest.mark.parametrize("boundary", [0, 10_000])
def test_long_lists_meet_in_blocks(spark, words, boundary, monkeypatch):
    """Sets made of a few heavy elements only: every list is long, of elements and of subsets."""
    monkeypatch.setattr(near_duplicates, "choose", lambda by_size, t: boundary)
    rng = random.Random(4)
    texts = [" ".join(rng.sample([f"w{k}" for k in range(8)], 6)) for _ in range(400)]
    df = spark.createDataFrame([(i, None, t) for i, t in enumerate(texts)], "id long, at timestamp, text string")
    plan = near_duplicates.Plan(near_duplicates.char_sets, 7, 10, 1, light=5, deal=20)
    members, similar = near_duplicates._classes(df, plan)
    got = set(map(tuple, near_duplicates._pairs(members, similar).collect()))
    sets = [{t[i : i + 3] for i in range(len(t) - 2)} for t in texts]
    assert got == {(a, b) for a in range(400) for b in range(a + 1, 400) if len(sets[a] & sets[b]) * 10 >= 7 * len(sets[a] | sets[b])}


def test_keys_hardly_grow_with_the_collection(words):
    """Bytes of keys per byte of text with the counts of these texts and with those of a collection 100,000 times as large."""
    rng = random.Random(5)
    texts = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(3000)]
    batch = pa.record_batch({"text": pa.array(texts)})
    plan = near_duplicates.Plan(near_duplicates.word_sets, 3, 5, 25)
    own = np.zeros(1 << near_duplicates.BUCKETS, np.int64)
    for _, g, _, _, _ in near_duplicates._sets(batch, plan):
        np.add.at(own, (g >> np.uint64(64 - near_duplicates.BUCKETS)).astype(np.int64), 1)
    huge = near_duplicates._scaled(own * 100_000 + np.random.default_rng(1).poisson(300, len(own)))
    some = {n: sum(b.nbytes for b in near_duplicates._signatures(iter([batch]), replace(plan, parts=n), huge)) / sum(map(len, texts)) for n in (8, 200)}
    # all of the prefix, 0.4 of the elements, at 16 bytes each, and at most 28 for the set in each part that it is in
    assert some[8] < 1.9 and some[200] < 3.5
    # the order still tells frequent elements from rare ones
    assert len(np.unique(huge[own == 0])) > 1 and huge[own > 1].min() > huge[own == 0].max()


@pytest.mark.parametrize("n", [30_000, 120_000])
def test_recall_of_the_five_nearest(spark, tmp_path, n):
    rng = np.random.default_rng(n)
    centres = rng.normal(size=(n // 500 + 1, 64))
    x = centres[rng.integers(0, len(centres), n)] + rng.normal(size=(n, 64)) * 0.9
    x = np.clip(np.round(x * 25), -127, 127).astype(np.int8)
    q = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 64).cast(pa.list_(pa.int8()))
    pq.write_table(pa.table({"id": np.arange(n), "q": q}), f"{tmp_path}/v.parquet")
    found = nearest._neighbours(spark.read.parquet(f"{tmp_path}/v.parquet").repartition(4), 64, 5, -1.0, 0.96)
    ask = rng.choice(n, 150, replace=False)
    got = {(r.id, r.other) for r in found.where(F.col("id").isin(ask.tolist())).collect()}
    u = x / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = set()
    for i in ask:
        s = u @ u[i]
        s[i] = -2
        want |= {(i, j) for j in np.argsort(-s)[:5]}
    assert len(got & want) >= 0.95 * len(want) and len(got) == len(want)


def test_a_crowded_group_is_worked_on_as_a_grid(spark, monkeypatch):
    monkeypatch.setattr(nearest, "GRID", 40)
    rng = np.random.default_rng(3)
    x = rng.integers(-90, 90, (1500, 8)).astype(np.int8)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, q array<byte>")
    got = {(r.id, r.other) for r in nearest._neighbours(df, 8, 3, -1.0, 1.0).collect()}
    u = x / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = {(i, int(j)) for i in range(1500) for j in np.argsort(-s[i])[:3]}
    assert len(got & want) > 0.97 * len(want)


def test_confusions_are_learnt_from_the_collection(spark):
    """Misreadings that no table names: q read as g, v read as ш, and two for one, tt read as N."""
    rng = random.Random(8)
    heads, tails = ["qui", "va", "otto", "squa", "vexi", "bitto", "quo", "revo", "attu", "piqui"], ["ck", "lue", "ndet", "re", "sten", "miru", "lopa", "renti", "zu", "kade", "folu"]
    frequent = {h + t: rng.randint(60, 400) for h in heads for t in tails}
    learnt = (("q", "g"), ("v", "ш"), ("tt", "n"))
    read = {}
    for w in frequent:
        for a, b in learnt:
            if a in w and rng.random() < 0.5:
                read[w.replace(a, b, 1)] = w
    read = {r: w for r, w in read.items() if r not in frequent}
    rows = [(w, n) for w, n in frequent.items()] + [(r, 1) for r in read] + [("unseen", 1), ("vexilopu", 2)]
    words = spark.createDataFrame(rows, "word string, n long")
    table = scanned.confusions(scanned.aligned(words))
    assert {("q", "g"), ("v", "ш")} <= set(table) and set(table) <= set(scanned.MISREAD) | set(learnt)
    got = {r.read: r.printed for r in scanned.corrections(words).collect()}
    right = sum(got.get(r) == w for r, w in read.items())
    assert right >= 0.95 * len(read) and not {"unseen", "vexilopu"} & set(got)


def test_titles_as_headers_of_any_form(spark):
    body = "\n".join(["Some words of a text that goes on and on here", "and then it goes on again to its very end."] * 3)
    titles = ["Guide to Go, 2nd ed.", "ab", "What is it?", "x" * 150]
    rows = [chunk(i, f"{t}\n{body}", doc=i) for i, t in enumerate(titles)] + [chunk(9, body, doc=0)]
    books = spark.createDataFrame([(i, i, f"p{i}", t, None, "ok") for i, t in enumerate(titles)], BOOKS)
    got = {tuple(r) for r in scanned.noise(spark.createDataFrame(rows, CHUNKS), books).collect()}
    assert {(i, "header") for i in range(4)} <= got and not any(i == 9 for i, _ in got)


def test_words_of_any_length_are_corrected(spark):
    long = "abcdefghik" * 30
    words = spark.createDataFrame([(long, 900), (long.replace("b", "6", 1), 1), (long[:150], 800), ("z" * 200_000, 70), ("z" * 200_000 + "0", 1)], "word string, n long")
    got = {r.read: r.printed for r in scanned.corrections(words).collect()}
    assert got.get(long.replace("b", "6", 1)) == long
