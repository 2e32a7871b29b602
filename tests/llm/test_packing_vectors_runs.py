"""Packing, vector codes and periodic runs: brute force, edge cases, invariants."""

import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from marketloom.llm import packing, runs, vectors
from marketloom.llm.tokens import vocabulary_path
from tests.llm.test_operators import docs, edge, words_of

# 11 packing


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path("word_bpe_49k.json"))


def pieces_of(tokenizer, rows, capacity, end_id=1):
    out = []
    for i, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, end_id], "<u4")
        out += [(i, k // capacity, k, len(ids[k : k + capacity]), zlib.crc32(ids[k : k + capacity].tobytes())) for k in range(0, len(ids), capacity)]
    return out


def check_places(rows, capacity):
    """Sequences are gapless and no longer than capacity; gives how many there are."""
    held = {}
    for r in rows:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in held.values():
        end = 0
        for at, n in sorted(places):
            assert at == end
            end += n
        assert end <= capacity
    return len(held)


@pytest.mark.parametrize("capacity", [1, 2, 7, 64, 4096])
def test_packing_edges(spark, tokenizer, capacity):
    rules = packing.PackingRules(capacity=capacity)
    got = packing.pack(edge(spark), rules).collect()
    want = pieces_of(tokenizer, [(r.doc_id, r.text) for r in edge(spark).collect()], capacity)
    key = lambda r: tuple(-9 if x is None else x for x in r)
    assert sorted((key(tuple(r)[:5]) for r in got)) == sorted(map(key, want))
    n, total = check_places(got, capacity), sum(r[3] for r in want)
    assert n == -(-total // capacity)
    assert packing.pack(docs(spark, []), rules).count() == 0


def test_packing_query(spark, sf, tokenizer):
    got = packing.query(spark, sf).collect()
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = pieces_of(tokenizer, rows, 4096)
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)
    assert check_places(got, 4096) <= 1 + -(-sum(r[3] for r in want) // 4096)


def test_packed_sequences_hold_the_ids(spark, tokenizer):
    rows = [(i, " ".join(random.Random(i).choices(["cat", "sat", "on", "the", "Mat"], k=i % 23))) for i in range(300)]
    rules = packing.PackingRules(capacity=16)
    got = [(tuple(r.ids[a : a + n])) for r in packing.sequences(docs(spark, rows), rules).collect() for a, n in zip(np.cumsum([0, *r.lengths[:-1]]).tolist(), r.lengths)]
    ids = [[*tokenizer.encode(t, add_special_tokens=False).ids, 1] for _, t in rows]
    assert sorted(got) == sorted(tuple(x[k : k + 16]) for x in ids for k in range(0, len(x), 16))


def test_packing_takes_the_same_slots_on_both_paths(spark):
    rows = [(i, "word " * (i % 40)) for i in range(400)]
    for most in (0, 1000):
        got = packing.pack(docs(spark, rows), packing.PackingRules(capacity=64, most_slots=most)).collect()
        assert len(got) == 400
        check_places(got, 64)


def first_fit_by_document(lengths, capacity):
    """Best fit in descending order, one piece after the other."""
    rooms = []
    for x in sorted(lengths, reverse=True):
        fit = [k for k, r in enumerate(rooms) if r >= x]
        if fit:
            rooms[min(fit, key=lambda k: rooms[k])] -= x
        else:
            rooms.append(capacity - x)
    return sorted(rooms)


def test_plan_equals_best_fit_by_document():
    rng = random.Random(11)
    for _ in range(150):
        capacity = rng.choice([1, 5, 10, 30, 100])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randrange(0, 120))]
        counts = {x: lengths.count(x) for x in set(lengths)}
        slots, n = packing.plan(counts, capacity)
        used, ranks = {}, {}
        for length, first, many, sequence, each, at in slots:
            assert first == ranks.get(length, 0)
            ranks[length] = first + many
            for k in range(many):
                s, place = sequence + k // each, at + k % each * length
                assert used.get(s, 0) == place
                used[s] = place + length
        assert ranks == counts
        assert sorted(capacity - x for x in used.values()) == first_fit_by_document(lengths, capacity) and len(used) == n


def test_plan_does_not_grow_with_the_counts():
    rng = random.Random(12)
    counts = {x: rng.randrange(1, 50) for x in range(1, 4097)}
    few, _ = packing.plan(counts, 4096)
    many, _ = packing.plan({x: n * 100_000 for x, n in counts.items()}, 4096)
    assert len(many) < 2 * len(few) < 100_000


# 12 vector codes

VECTORS = "vec_id long, embedding array<float>, label int, code string, error string, v string"


def table_of(spark, rows):
    return spark.createDataFrame([(i, v, g, "a", "b", "c") for i, v, g in rows], VECTORS)


def codes_by_hand(rows, parts=4, entries=256, rounds=4):
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v], g) for i, v, g in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v, _ in kept), default=1) // parts) * parts
    kept = [(i, v + [0] * (width - len(v)), g) for i, v, g in kept]
    size = width // parts
    cut = lambda v, p: v[p * size : (p + 1) * size]
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[cut(v, p) for _, v, _ in order] for p in range(parts)]
    apart = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y))

    def assigned(p):
        return [min((apart(cut(v, p), e), k) for k, e in enumerate(books[p])) for _, v, _ in kept]

    for _ in range(rounds):
        for p in range(parts):
            held = {}
            for (_, k), (_, v, _) in zip(assigned(p), kept):
                held.setdefault(k, []).append(cut(v, p))
            for k, xs in held.items():
                books[p][k] = [sum(c) // len(xs) for c in zip(*xs)]
    last = [assigned(p) for p in range(parts)]
    text = ",".join(str(c) for b in books for e in b for c in e)
    return [(i, g, tuple(last[p][r][1] for p in range(parts)), sum(last[p][r][0] for p in range(parts))) for r, (i, _, g) in enumerate(kept)], hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("entries", [2, 7, 256])
def test_codes_equal_those_by_hand(spark, entries):
    rng = random.Random(entries)
    for width in (4, 10, 16):
        rows = [(rng.choice([None, *range(40)]), [rng.choice([0.0, -0.25, 0.5, rng.gauss(0, 1)]) for _ in range(width)], rng.choice([None, 1, 2])) for _ in range(60)]
        rows += [(70, None, 1), (71, [0.0, None] * (width // 2), 1), (72, [float("nan")] * width, 2), (73, [float("-inf")] + [0.0] * (width - 1), 2), (74, [0.5] * (width - 1), 3), (1, rows[0][1], None), (75, [], 2)]
        got, books = vectors.encode(table_of(spark, rows), vectors.VectorRules(entries=entries))
        want, digest = codes_by_hand(rows, entries=entries)
        key = lambda r: tuple(-1 if x is None else x for x in r)
        assert sorted(key((r.vec_id, r.label, tuple(r.code), r.error)) for r in got.collect()) == sorted(map(key, want))
        assert vectors.digest(books) == digest


def test_codes_of_no_vectors_and_of_too_large_ones(spark):
    got, books = vectors.encode(table_of(spark, [(1, None, 1), (2, [float("nan")], None)]))
    assert got.count() == 0 and books.size == 0
    with pytest.raises(ValueError):
        vectors.encode(table_of(spark, [(1, [3e38, 0.0, 0.0, 0.0], 1)]))


def test_nearest_takes_the_lowest_of_equal_entries():
    rng = np.random.default_rng(3)
    for width in (1, 3, 8, 20):
        x, book = rng.integers(-3, 3, (500, width)), rng.integers(-3, 3, (40, width))
        codes, errors = vectors.nearest(x, book, 64)
        all_ = ((x[:, None] - book[None]) ** 2).sum(2)
        assert (codes == all_.argmin(1)).all() and (errors == all_.min(1)).all()


def test_codes_query(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    names = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    want = con.execute(f"SELECT {', '.join(names)} FROM ({vectors.ORACLE})").fetchall()
    assert want and sorted(map(tuple, vectors.query(spark, sf).select(*names).collect())) == sorted(want)


# 13 periodic runs


def runs_by_hand(w, least=12):
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i + q - s >= max(least, 2 * q):
                found.setdefault((s, i + q), q)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def periodic(rng, n, k):
    w = [rng.randrange(k) for _ in range(n)]
    for _ in range(rng.randrange(0, 4) if n else 0):
        a, p = rng.randrange(n), rng.randrange(1, 30)
        for i in range(a, rng.randrange(a, n) + 1):
            w[i] = w[a + (i - a) % p]
    return w


def test_runs_equal_those_by_hand():
    rng, n = random.Random(13), 0
    for _ in range(400):
        least = rng.choice([12, 12, 2, 3, 5, 20])
        texts = [periodic(rng, rng.randrange(0, 200), rng.choice([1, 2, 3, 5])) for _ in range(rng.randrange(1, 4))]
        bounds = np.cumsum([0, *map(len, texts)])
        got = runs.find(np.array([x for w in texts for x in w], np.int64), bounds, runs.RunRules(least=least, automaton_words=rng.choice([4, 1 << 18]), key_words=rng.choice([4, 64])))
        want = [(s + b, s + b + n, q) for w, b in zip(texts, bounds.tolist()) for s, n, q in runs_by_hand(w, least)]
        assert sorted(zip(got.starts.tolist(), got.ends.tolist(), got.periods.tolist())) == sorted(want)
        n += len(want)
    assert n > 3000


@pytest.mark.parametrize("words", [[0] * 400_000, [0] * 200_000 + [1] + [0] * 200_000, ([0] * 3000 + [1]) * 100, [0, 1] * 5000 + [1, 0] * 5000], ids=["one", "broken", "blocks", "turned"])
def test_runs_of_long_repeats_end_in_time(words):
    import time

    at = time.monotonic()
    found = runs.find(np.array(words), np.array([0, len(words)]))
    assert len(found.starts) and time.monotonic() - at < 30


def test_scales_cover_every_period_once():
    for least in (1, 2, 12, 33):
        for n in (0, 1, 2, 25, 1000):
            spans = list(runs.scales(n, least))
            assert [q for _, a, b in spans for q in range(a, b + 1)] == list(range(1, n // 2 + 1))
            assert all(2 * block - 1 <= max(q, least - q) for block, a, b in spans for q in range(a, b + 1))


def test_collapse_edges(spark):
    got = {r.doc_id: r for r in runs.collapse(edge(spark)).collect()}
    assert got[1].n_words == 0 and got[1].runs == [] and got[1].collapsed == "" and got[2].collapsed == "" and got[3].collapsed == ""
    assert [tuple(x) for x in got[4].runs] == [(0, 60000, 3)] and got[4].collapsed == "a b c"
    assert got[None].collapsed == "no id" and got[5].collapsed == "same text"
    assert runs.collapse(edge(spark)).count() == 9 and runs.collapse(docs(spark, [])).count() == 0


def test_collapse_tells_case_marks_and_hashes_apart(spark, monkeypatch):
    text = "a A á á\x0b" * 9 + " x " * 12 + " x"
    w = words_of(text)
    assert [tuple(x) for x in runs.collapse(docs(spark, [(1, text)])).first().runs] == runs_by_hand(w) != []
    starts, ends = np.array([0, 2, 4]), np.array([1, 3, 5])
    assert runs.word_numbers(np.frombuffer(b"a b a", np.uint8), starts, ends, np.zeros(3, np.uint64)).tolist() == [0, 1, 0]


def contract(doc_id, text):
    w = words_of(text)
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = runs_by_hand(w)
    dropped = {i for s, m, q in found for i in range(s + q, s + m)}
    best = min(((-m, s, q) for s, m, q in found), default=None)
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in found)
    first = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return doc_id, len(found), *first, sha(lines), sha(" ".join(x for i, x in enumerate(w) if i not in dropped))


def test_runs_query_follows_its_contract(spark, tmp_path):
    rng = random.Random(14)
    rows = [(i, " ".join(f"w{x}" for x in periodic(rng, rng.randrange(0, 250), rng.choice([1, 2, 4, 30])))) for i in range(300)] + [(1000, None), (1001, ""), (1002, "\n")]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = runs.query(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(contract(i, t) for i, t in rows)
    assert pa.array([r.n_runs for r in got]).to_numpy().sum() > 300


def test_runs_query_on_documents(spark, sf):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if len(r.text or "") < 6000}
    got = [tuple(r) for r in runs.query(spark, sf).collect() if r.doc_id in rows]
    assert sorted(got) == sorted(contract(i, t) for i, t in rows.items())
