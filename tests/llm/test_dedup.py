"""Exact, near, line and passage dedup against brute force, and their defined results."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textmill.llm import exact_dedup, line_dedup, simhash, suffix_dedup
from textmill.llm.common import column_bytes

WORDS = [a + b for a in "ba ce di fo gu ha ki lo mu ne".split() for b in "ra se ti vo xu".split()]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice("abcdefgh") for _ in range(n))


# exact dedup


def brute_copies(rows):
    out, seen = [], {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        if t is None:
            continue
        if t in seen:
            out.append((i, seen[t]))
        else:
            seen[t] = i
    return sorted(out, key=str)


ODD = [(5, "a"), (2, "a"), (9, "a"), (3, ""), (4, ""), (6, None), (7, None), (None, "a"), (None, "b"), (None, "b"), (2, "a"), (1, "é" * 300_000), (8, "é" * 300_000), (10, "a ")]


def test_exact_copies(documents):
    got = sorted(map(tuple, exact_dedup.exact_copies(documents(ODD)).collect()), key=str)
    assert got == brute_copies(ODD)


def test_exact_drop(documents):
    kept = exact_dedup.drop_copies(documents(ODD))
    assert kept.columns == ["doc_id", "text", "n", "digest"]
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    assert sorted(rows, key=str) == sorted([(2, "a"), (3, ""), (6, None), (7, None), (None, "b"), (1, "é" * 300_000), (10, "a ")], key=str)


def test_exact_empty(documents):
    assert exact_dedup.exact_copies(documents([])).count() == 0
    assert exact_dedup.drop_copies(documents([])).count() == 0


def test_exact_with_digests_that_clash(documents, monkeypatch):
    """Texts of one length share a digest here: only the bytes tell them apart."""
    monkeypatch.setattr(exact_dedup, "digest", lambda text: F.unhex(F.sha2(F.length(text).cast("string"), 256)))
    rows = ODD + [(20, "b"), (21, "c"), (22, "c"), (22, "c")]
    assert sorted(map(tuple, exact_dedup.exact_copies(documents(rows)).collect()), key=str) == brute_copies(rows)
    kept = [(r.doc_id, r.text) for r in exact_dedup.drop_copies(documents(rows)).collect()]
    assert sorted(kept, key=str) == sorted([(2, "a"), (3, ""), (6, None), (7, None), (20, "b"), (1, "é" * 300_000), (10, "a "), (21, "c")], key=str)


@pytest.mark.parametrize("limit", [8_000_000, 0])
def test_exact_against_brute_force(documents, monkeypatch, limit):
    """With the filter, and with the join that takes its place beyond its size."""
    monkeypatch.setattr(exact_dedup, "MAX_FILTER_BYTES", limit)
    rng = random.Random(7)
    rows = [(rng.randrange(400), rng.choice(["hot text", f"text {rng.randrange(200)}", f"own {i}"])) for i in range(700)]
    assert sorted(map(tuple, exact_dedup.exact_copies(documents(rows)).collect()), key=str) == brute_copies(rows)
    kept = [(r.doc_id, r.text) for r in exact_dedup.drop_copies(documents(rows)).collect()]
    want = {}
    for i, t in rows:
        want[t] = min(i, want.get(t, i))
    assert sorted(kept) == sorted((i, t) for t, i in want.items())


def test_runs_and_filters(documents):
    rng = random.Random(1)
    rows = [(i, f"text {rng.randrange(60)}") for i in range(200)]
    first, index = exact_dedup.build_index(documents(rows).coalesce(1), memtable=20)
    runs = []
    for r in exact_dedup.runs(documents(rows).coalesce(1), memtable=20).collect():
        if r["filter"] is not None:
            runs.append([])
        runs[-1].append(r)
    assert len(runs) == 10 and first.count() == 200
    other = np.frombuffer(rng.randbytes(8 * 2000), np.uint64)
    for run in runs:
        keys = [bytes(r.digest) for r in run]
        assert keys == sorted(keys)
        assert exact_dedup.may_contain(bytes(run[0]["filter"]), np.frombuffer(b"".join(k[:8] for k in keys), np.uint64)).all()
        assert exact_dedup.may_contain(bytes(run[0]["filter"]), other).mean() < 0.1
    assert index.count() == len({t for _, t in rows}) and index.agg(F.sum("copies")).first()[0] == 200


@pytest.mark.parametrize("limit", [8_000_000, 0])
def test_probe_with_a_later_batch(documents, monkeypatch, limit):
    monkeypatch.setattr(exact_dedup, "MAX_FILTER_BYTES", limit)
    old = documents([(i, f"text {i % 50}") for i in range(200)] + [(300, None), (None, "no id")])
    _, index = exact_dedup.build_index(old)
    new = documents([(1000, "text 7"), (1001, "text 50"), (1002, None), (1003, "text 49"), (1004, "no id")])
    got = sorted(map(tuple, exact_dedup.probe(index, old, new).collect()))
    assert got == [(1000, 7), (1003, 49), (1004, None)]
    assert exact_dedup.probe(index, old, documents([])).count() == 0


# near dedup


def fingerprint(text):
    raw = text.lower().encode()
    low, high, n = simhash.fingerprints_of(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    return int(low[0]) | int(high[0]) << 64 if n[0] else None


def brute_groups(rows, distance):
    """Smallest id of each id's group."""
    prints = [(i, fingerprint(t)) for i, t in rows if i is not None and t is not None]
    prints = [(i, p) for i, p in prints if p is not None]
    root = {i: i for i, _ in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, p) in enumerate(prints):
        for j, q in prints[:k]:
            if (p ^ q).bit_count() <= distance and find(i) != find(j):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in root if find(i) != i}


def near_corpus():
    rng = random.Random(5)
    rows = []
    for k in range(60):
        words = prose(rng, 150).split()
        rows.append((len(rows), " ".join(words)))
        for _ in range(k % 3):
            copy = list(words)
            for at in rng.sample(range(150), rng.randrange(0, 8)):
                copy[at] = "new" + rng.choice(WORDS)
            rows.append((len(rows), " ".join(copy)))
    return rows


def test_near_copies(documents):
    rows = near_corpus() + [(900, None), (901, ""), (902, "?!"), (None, "x y z"), (0, None), (903, "w " * 200_000)]
    want = brute_groups(rows, 24)
    got = {r.doc_id: r.kept_doc_id for r in simhash.near_copies(documents(rows)).collect()}
    assert want and got == want  # one small list is compared by brute force


def brute_near(low, high, distance):
    """All pairs within the distance, row by row."""
    out = set()
    for i in range(len(low)):
        d = np.bitwise_count(low[:i] ^ low[i]) + np.bitwise_count(high[:i] ^ high[i])
        out |= {(i, int(j)) for j in np.flatnonzero(d <= distance)}
    return out


def test_near_recall(spark):
    """Two steps of recursion over many fingerprints find as many pairs at the full distance as they should."""
    rng = np.random.default_rng(2)
    n, settings = 8000, simhash.Settings(leaf=32, list_size=400)
    low, high = (rng.integers(0, 1 << 64, n, dtype=np.uint64) for _ in range(2))
    for k in range(1500):
        flip = rng.choice(128, settings.distance, replace=False)
        i, j = n // 2 + k, k
        low[i] = low[j] ^ np.uint64(sum(1 << int(x) for x in flip if x < 64))
        high[i] = high[j] ^ np.uint64(sum(1 << int(x) - 64 for x in flip if x >= 64))
    want = brute_near(low, high, settings.distance)
    nodes = spark.createDataFrame([(i, int(a), int(b)) for i, (a, b) in enumerate(zip(low.view(np.int64), high.view(np.int64)))], "id bigint, low bigint, high bigint")
    assert simhash.first_step(n, settings)[0] > 2
    found = {(max(e), min(e)) for e in map(tuple, simhash.near_edges(nodes, settings).collect())}
    assert len(want) >= 1500 and found <= want
    # the pairs are disjoint, so each is an edge of its own; three standard deviations below the promise
    assert len(found) >= (settings.recall - 0.017) * len(want)


@pytest.mark.parametrize("size", [3000, 9000])
def test_near_dense_lists(size):
    """Lists that strips hardly part: groups as by brute force, none lost to a size."""
    rng = np.random.default_rng(size)
    centres = rng.integers(0, 1 << 64, (4, 2), dtype=np.uint64)
    own = rng.integers(0, 4, size)
    low, high = centres[own, 0].copy(), centres[own, 1].copy()
    for _ in range(9):
        low ^= np.uint64(1) << rng.integers(0, 64, size).astype(np.uint64)
    low[-500:], high[-500:] = rng.integers(0, 1 << 64, (2, 500), dtype=np.uint64)
    ids = np.arange(size)
    edges = [(a, b) for x in simhash.solve(ids, low, high, simhash.Settings(leaf=256)) for a, b in zip(*x)]
    assert all(int(low[a] ^ low[b]).bit_count() + int(high[a] ^ high[b]).bit_count() <= 24 for a, b in edges)
    left, right = (np.array(x, np.int64) for x in zip(*edges))
    pairs = brute_near(low, high, 24)
    a, b = (np.array(x, np.int64) for x in zip(*pairs))
    assert (simhash.roots(size, left, right) == simhash.roots(size, a, b)).mean() > 0.999


def test_near_lists_of_equal_repetitions():
    """Steps and repetitions have strips of their own, and no level of a long path is lost."""
    s = simhash.Settings()
    assert len({str(simhash.strips(x, 4, s)) for x in [(0,), (1,), (1000,), (0, 0), (0, 1000), (1, 0), (0, 0, 0)]}) == 7
    low = np.array([0, 1 << 63], np.uint64)
    masks, _, _ = simhash.strips((5,), 60, s)
    first = next(k for k, (a, b) in enumerate(masks) if a >> 63)
    flips = simhash.paths(low, np.zeros(2, np.uint64), (5,), 60, s)
    assert flips[0] != flips[1] and first < 60


def test_near_drop(documents):
    kept = simhash.drop_near_copies(documents([(3, "one two three four"), (1, "one two three four"), (None, "one two three four"), (7, None)]))
    assert kept.columns == ["doc_id", "text", "n", "digest"]
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 7, None]
    assert simhash.drop_near_copies(documents([])).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (103, 101)]
    got = dict(map(tuple, simhash.components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()))
    assert got == {i: 0 for i in range(1, 41)} | {101: 100, 103: 100}


# passages


def brute_spans(rows, n):
    by_doc = {}
    for i, t in rows:
        if i is not None and t is not None:
            by_doc.setdefault(i, []).append([w for w in re.split(r"[\t\n\v\f\r\x1c-\x1f ]+", t) if w])
    where = {}
    for i, texts in by_doc.items():
        for words in texts:
            for k in range(len(words) - n + 1):
                where.setdefault(tuple(words[k : k + n]), set()).add(i)
    out = set()
    for i, texts in by_doc.items():
        marked = sorted({k for words in texts for k in range(len(words) - n + 1) if len(where[tuple(words[k : k + n])]) > 1})
        while marked:
            first = last = marked.pop(0)
            while marked and marked[0] <= last + n:
                last = marked.pop(0)
            out.add((i, first, last + n, last + n - first))
    return sorted(out)


def passages_corpus(seed):
    rng = random.Random(seed)
    shared = [prose(rng, rng.choice([49, 50, 51, 80, 130])) for _ in range(6)]
    rows = []
    for i in range(40):
        parts = [prose(rng, rng.randrange(0, 60))]
        for _ in range(rng.randrange(3)):
            parts += [rng.choice(shared), prose(rng, rng.randrange(0, 3))]
        rows.append((i, rng.choice([" ", "\n", "  "]).join(parts)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize(("crowd", "limit"), [(100_000, 32_000_000), (2, 32_000_000), (3, 0)])
def test_passages(documents, seed, crowd, limit):
    rows = passages_corpus(seed) + [(50, None), (51, ""), (None, prose(random.Random(9), 90)), (52, "w " * 5000), (53, "w " * 70)]
    got = suffix_dedup.repeated_spans(documents(rows), suffix_dedup.Settings(crowd=crowd, max_filter_bytes=limit))
    assert got.columns == ["doc_id", "start_word", "end_word", "n_words"]
    want = brute_spans(rows, 50)
    assert len(want) > 10 and sorted(map(tuple, got.collect())) == want


def test_passages_empty_and_within(documents):
    once = prose(random.Random(3), 60)
    assert suffix_dedup.repeated_spans(documents([])).count() == 0
    assert suffix_dedup.repeated_spans(documents([(1, once + " x " + once)])).count() == 0
    assert suffix_dedup.repeated_spans(documents([(1, once), (1, once)])).count() == 0


# lines


def within_one(a, b):
    if a == b:
        return True
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    k = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def brute_lines(rows, least=8):
    lines = {}
    for i, t in rows:
        if i is not None and t is not None:
            split = t.split("\n")
            for k, line in enumerate(split):
                if any(ord(c) > 32 for c in line):
                    lines[i, k] = line
    out = []
    for at, line in lines.items():
        reach = [b for b, other in lines.items() if b < at and (other == line or len(line) >= least and len(other) >= least and within_one(line, other))]
        if reach:
            out.append((*at, *min(reach)))
    return sorted(out)


def lines_corpus(seed):
    rng = random.Random(seed)
    known = [prose(rng, rng.randrange(1, 9)) for _ in range(15)] + ["short", "shert", "été à la mer", "abcdefgh", "abcdefg"]
    rows = []
    for i in range(25):
        out = []
        for _ in range(rng.randrange(0, 9)):
            line = list(rng.choice(known))
            edit, at = rng.randrange(5), rng.randrange(len(line))
            if edit == 0:
                line[at] = rng.choice("zé日")
            elif edit == 1:
                del line[at]
            elif edit == 2:
                line.insert(at, rng.choice("zé日"))
            out.append("".join(line))
        rows.append((i, "\n".join(out)))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_lines(documents, seed):
    rows = lines_corpus(seed) + [(100, None), (101, ""), (102, "\n\n \n"), (103, "x" * 30_000), (104, "x" * 30_001 + "\n" + "x" * 30_002)]
    got = line_dedup.repeated_lines(documents(rows))
    want = brute_lines(rows)
    assert len(want) > 20 and sorted(map(tuple, got.collect())) == want


def test_lines_repeated_rows_and_drop(documents):
    docs = documents([(1, "a line of text\nother words"), (1, "a line of text\nother words"), (2, "a line of test\nlast"), (3, None), (None, "last")])
    found = line_dedup.repeated_lines(docs)
    assert list(map(tuple, found.collect())) == [(2, 0, 1, 0)]
    kept = line_dedup.drop_lines(docs, found)
    assert kept.columns == ["doc_id", "text", "n", "digest"]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(1, "a line of text\nother words")] * 2 + [(2, "last"), (3, None), (None, "last")], key=str)
    assert line_dedup.repeated_lines(documents([])).count() == 0


def test_column_bytes_of_slices():
    column = pa.array(["ab", None, "", "é"]).slice(1)
    data, offsets = column_bytes(column)
    assert data.tobytes() == "é".encode() and offsets.tolist() == [0, 0, 0, 2]


def test_lines_that_polynomials_modulo_powers_of_two_confuse(documents):
    """Thue-Morse lines of 4,096 characters differ in every one and stay apart; copies of them don't."""
    bits = np.array([k.bit_count() & 1 for k in range(4096)])
    one, other = ("".join("ab"[x] for x in (bits ^ flip)) for flip in (0, 1))
    near = "c" + one[1:]
    got = line_dedup.repeated_lines(documents([(1, one), (2, other), (3, f"{one}\n{near}")]))
    assert sorted(map(tuple, got.collect())) == [(3, 0, 1, 0), (3, 1, 1, 0)]


def test_lines_of_rows_that_share_an_id(documents):
    rows = [(1, "first of two rows\nsecond line"), (1, "another row's line\nsecond lime"), (2, "another row's lines")]
    got = sorted(map(tuple, line_dedup.repeated_lines(documents(rows)).collect()))
    assert (2, 0, 1, 0) in got
