import hashlib
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from dirloom.llm import columnar as C
from dirloom.llm import periodic


def plain_runs(w):
    """All runs by their definition: every period, every maximal stretch, smallest period."""
    found = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if length >= max(6, 4 * q) and not any(all(w[k] == w[k + r] for k in range(i, i + length - r)) for r in range(1, q)):
                found.append((i, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def found_runs(texts):
    buf, off = C.utf8(pa.array(texts, pa.string()))
    ids, at, kinds, *_ = periodic._word_ids(buf, off)
    runs = periodic.find_runs(ids, at, kinds)
    out = [[] for _ in texts]
    for s, n, q in runs.tolist():
        k = int(np.searchsorted(at, s, "right")) - 1
        out[k].append((s - int(at[k]), n, q))
    return out


WORDS = st.lists(st.sampled_from("ab"), max_size=60)


@settings(max_examples=300, deadline=None)
@given(st.lists(WORDS, max_size=4))
def test_runs_of_few_letters_equal_plain_search(texts):
    assert found_runs([" ".join(t) for t in texts]) == [plain_runs(t) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from("abc"), min_size=1, max_size=19), st.integers(1, 7), st.integers(0, 18)), max_size=5))
def test_runs_of_powers_equal_plain_search(parts):
    words = [w for unit, times, more in parts for w in (unit * (times + 1))[: len(unit) * times + more % len(unit)]]
    assert found_runs([" ".join(words)]) == [plain_runs(words)]


def test_every_period_and_place(monkeypatch):
    monkeypatch.setattr(periodic, "SLAB", 64)  # more slabs than one
    rng = np.random.default_rng(5)
    texts = []
    for q in range(1, 70):
        unit = [f"w{k}" for k in rng.integers(0, 40, q)]
        for length in (4 * q - 1, 4 * q, 6 * q + 1):
            before = [f"x{k}" for k in range(int(rng.integers(0, 40)))]
            texts.append(before + (unit * 8)[: max(length, 6)] + [f"y{k}" for k in range(int(rng.integers(0, 30)))])
    assert found_runs([" ".join(t) for t in texts]) == [plain_runs(t) for t in texts]


@pytest.mark.parametrize("primes", [1, 2, 3])
def test_squared_differences_are_exact(primes):
    rng = np.random.default_rng(primes)
    for b in (1, 2, 8, 64):
        blocks = rng.integers(1, 3, (12, b)).astype(np.uint64)
        blocks[4:9] = blocks[3]
        flat = np.concatenate([blocks.ravel(), np.zeros(2 * b, np.uint64)])
        got = periodic._zeros(blocks, np.ones(12, bool), primes)
        want = [[bool((flat[r * b : r * b + b] == flat[r * b + b + s : r * b + 2 * b + s]).all()) for r in range(12)] for s in range(b)]
        assert got.tolist() == want


def test_many_ids_need_more_primes():
    rng = np.random.default_rng(3)
    words = [f"{k:x}" for k in rng.permutation(30000)]
    words[5000:9000] = (words[5000:6000] * 4)[:4000]
    assert found_runs([" ".join(words)]) == [[(5000, 4000, 1000)]]


def test_long_repetitive_texts_stay_cheap():
    n = 120_000
    began = time.time()
    fib = ["a", "ab"]
    while len(fib[-1]) < n:
        fib.append(fib[-1] + fib[-2])
    thue = ["abba"]
    while len(thue[-1]) < n:
        thue.append(thue[-1] + thue[-1].translate(str.maketrans("ab", "ba")))
    same, square, none = found_runs([" ".join("a" * n), " ".join("ab" * (n // 2) + "c"), " ".join(thue[-1])])
    assert same == [(0, n, 1)] and square == [(0, n, 2)] and none == []
    assert found_runs([" ".join(fib[-1])]) == [[]]  # no fourth power in the Fibonacci word
    assert time.time() - began < 60


ODD = [None, "", " \n\t ", "one", "é é é é é é", "a b " * 40, "x" * 70000, "no no no no no no yes", "A a " * 3, "u v w " * 4 + "z"]


def report(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_report_equals_plain_computation(spark):
    rng = np.random.default_rng(11)
    texts = ODD * 4 + [" ".join(rng.choice(list("abcdefgh"), int(rng.integers(1, 90)))) for _ in range(120)]
    rows = [(k, t, "x", 1) for k, t in enumerate(texts)] + [(None, "p q " * 9, "x", 1), (3, "again", "x", 1), (3, "again", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, best string, runs int")
    got = [tuple(r) for r in periodic.run_report(docs).collect()]
    assert sorted(got, key=str) == sorted((report(k, t) for k, t, *_ in rows), key=str)
    assert sum(zlib.crc32(str(k).encode()) % 10 == 0 for k, *_ in rows) > 5
    assert periodic.run_report(docs.limit(0)).count() == 0


def test_collapsed_text_and_places(spark):
    docs = spark.createDataFrame([("k", "go  on \n" + "and on " * 5 + "end")], "name string, body string")
    r = periodic.collapse_runs(docs, "name", "body").first()
    assert r["text"] == "go on and end" and [tuple(x) for x in r["runs"]] == [(1, 11, 2)] and r["n_words"] == 13
