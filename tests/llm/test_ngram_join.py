import re

import numpy as np
import pyarrow as pa
import pytest

from dirloom.llm import ngram_join as J


def brute(rows, n=3, num=90):
    """doc_id -> (set size, component) by comparing all pairs."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        return i if root[i] == i else find(root[i])

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def corpus():
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(400)]
    rows = [(900, None), (901, ""), (902, " \t "), (903, "One two"), (904, "one  two"), (905, "one")]
    doc = 0
    for size in (8, 13, 22, 25, 60, 200):
        for _ in range(4):
            base = list(rng.choice(words, size))
            for _ in range(int(rng.integers(2, 9))):
                copy = list(base)
                for _ in range(int(rng.integers(0, 3))):
                    copy[int(rng.integers(0, size))] = str(rng.choice(words))
                if rng.random() < 0.3:
                    copy += list(rng.choice(words, 2))
                rows.append((doc, " ".join(copy).title() if rng.random() < 0.5 else " ".join(copy)))
                doc += 1
    shared = " ".join(rng.choice(words, 50))
    rows += [(500 + k, " ".join(rng.choice(words, 20)) + " " + shared) for k in range(12)]
    return rows


@pytest.mark.parametrize(("n", "num"), [(3, 90), (5, 80)])
def test_components_equal_brute_force(spark, n, num):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.jaccard_components(spark, docs, n, J.Threshold(num)).collect()}
    assert got == brute(rows, n, num)


def test_small_sets_share_deciding_subsets():
    t = J.Threshold()
    assert [t.largest(k) for k in (0, 1, 2)] == [9, 19, 29] and [J.Threshold(80).largest(k) for k in (0, 1)] == [4, 9]
    b = pa.RecordBatch.from_pydict({"rep": [1], "n": [10], "small": [list(range(10))]})
    out = next(J._subsets(t)(iter([b])))
    assert out.num_rows == 11 and set(out.column("c").to_pylist()) == {9, 10}


@pytest.mark.parametrize(("n", "num"), [(3, 90), (5, 80)])
def test_sets_of_every_size_meet(spark, n, num):
    """Of each size up to 40: a set, one that lacks its last words, one with a changed
    last word; linked or not, none is lost between small and large."""
    rows = []
    for size in range(1, 41):
        words = [f"{size}w{k}" for k in range(size + n - 1)]
        for less in (0, 1, 2, 4, 6, 9):
            if less < size:
                rows.append((1000 * size + less, " ".join(words[: len(words) - less])))
        rows.append((1000 * size + 500, " ".join([*words[:-1], "other"])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.jaccard_components(spark, docs, n, J.Threshold(num)).collect()}
    assert got == brute(rows, n, num)


def test_nine_and_ten_shingles_link(spark):
    words = [f"w{k}" for k in range(12)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:11]))], "doc_id long, text string")
    assert {r["component_id"] for r in J.jaccard_components(spark, docs).collect()} == {1}


def test_star_of_copies_and_hot_list(spark):
    """Copies around one text, each with its own edits, and a passage in every text."""
    rng = np.random.default_rng(8)
    base = [f"b{k}" for k in range(150)]
    rows = []
    for d in range(60):
        copy = list(base)
        for k in rng.choice(150, int(rng.integers(0, 5)), replace=False):
            copy[k] = f"e{d}x{k}"
        rows.append((d, " ".join(copy)))
    passage = " ".join(base[:40])
    rows += [(100 + d, passage + " " + " ".join(f"o{d}y{k}" for k in range(60))) for d in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.jaccard_components(spark, docs).collect()}
    assert got == brute(rows)


def test_edge_rows(spark):
    text = " ".join(f"w{k}" for k in range(30))
    rows = [(1, text, 0), (1, text, 1), (None, text, 2), (2, None, 3), (3, "", 4), (4, text.upper(), 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    got = sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in J.jaccard_components(spark, docs).collect())
    assert got == [("1", 28, 1), ("1", 28, 1), ("2", 0, 2), ("3", 0, 3), ("4", 28, 1), ("None", 28, None)]
    assert J.jaccard_components(spark, docs.limit(0)).count() == 0


def test_keep_one_has_free_column_names(spark):
    text = " ".join(f"w{k}" for k in range(30))
    rows = [(d, text, d, d, "x") for d in (3, 4, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row long, _gone long, component_id string")
    kept = J.keep_one(spark, docs)
    assert kept.columns == docs.columns and [r["doc_id"] for r in kept.collect()] == [3]


def test_pairs_left_across_components(spark, monkeypatch):
    """Without further pivots: what the first leaves is compared pair by pair, each pair once."""
    monkeypatch.setattr(J, "FEW_PAIRS", 10**9)
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.jaccard_components(spark, docs, 3, J.Threshold(90)).collect()}
    assert got == brute(rows)
