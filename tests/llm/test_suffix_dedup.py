import collections
import hashlib

import numpy as np
import pyarrow as pa

from dirloom.llm import suffix_dedup as S
from dirloom.llm.suffix_dedup import bwt_lcp, repeat_report, remove_repeats, repeated_windows


def test_transform_and_prefixes():
    rng = np.random.default_rng(1)
    for _ in range(80):
        strings = [rng.integers(1, 1 + rng.integers(1, 4), rng.integers(0, 12)).astype(np.uint16) for _ in range(rng.integers(1, 7))]
        size = np.array([len(s) for s in strings])
        sid, start, lcp = bwt_lcp(np.concatenate(strings), size)
        got = [strings[i][k:].tolist() for i, k in zip(sid, start)]
        assert got == sorted((s[k:].tolist() for s in strings for k in range(len(s) + 1)))
        for a, b, n in zip(got, got[1:], lcp[1:]):
            assert n == next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_windows_equal_brute_force():
    rng = np.random.default_rng(2)
    base = rng.integers(97, 100, 900).astype(np.uint8)
    segments = [base[k : k + int(rng.integers(200, 360))].tobytes() for k in rng.integers(0, 600, 30)]
    count = collections.Counter(s[k : k + 200] for s in segments for k in range(len(s) - 199))
    want = {(i, k) for i, s in enumerate(segments) for k in range(len(s) - 199) if count[s[k : k + 200]] > 1}
    seg, at = repeated_windows(segments, 200)
    assert set(zip(seg.tolist(), at.tolist())) == want


def brute(rows, length=200):
    data = {i: (t or "").encode() for i, t in rows}
    count = collections.Counter(b[k : k + length] for b in data.values() for k in range(len(b) - length + 1))
    out = {}
    for i, b in data.items():
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                gone[k : k + length] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = int((gone[1:] < gone[:-1]).sum())
        out[i] = (len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


def rows():
    rng = np.random.default_rng(4)
    text = lambda n: "".join(rng.choice(list("abcdé \n"), n))
    passage, long = text(260), text(3000)
    out = [(0, None), (1, ""), (2, "x" * 199), (3, "y" * 450), (4, long), (5, long), (6, long[:1400] + "#" + long[1400:])]
    out += [(10 + k, text(150) + passage + text(90)) for k in range(6)]
    out += [(20, passage + text(30) + passage), (21, text(500)), (None, text(300))]
    return out


def test_report_equals_brute_force(spark):
    data = rows()
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeat_report(spark, docs).collect()}
    assert got == brute(data)


def test_removal_keeps_columns_and_whole_characters(spark):
    data = [(i, t, "k", len(t or "")) for i, t in rows()]
    docs = spark.createDataFrame(data, "doc_id long, text string, tid string, n_chars long")
    out = remove_repeats(spark, docs)
    assert out.columns == docs.columns
    got = {r["doc_id"]: r for r in out.collect()}
    assert len(got) == len(data) and got[4]["text"] == "" and got[0]["text"] is None
    assert got[21]["text"] == data[-2][1] and all(r["n_chars"] == len(r["text"]) for r in got.values() if r["text"] is not None)


def thue_morse(n, flip=0):
    return "".join("ab"[bin(k).count("1") + flip & 1] for k in range(n))


def test_texts_whose_polynomial_hashes_collide(spark):
    """Thue-Morse strings and their complements, for which any polynomial modulo 2 ** 64 agrees."""
    data = [(1, thue_morse(2048)), (2, thue_morse(2048, 1)), (3, thue_morse(4096)), (4, thue_morse(4096, 1)), (5, thue_morse(1024))]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeat_report(spark, docs).collect()}
    assert got == brute(data)
    assert repeat_report(spark, docs).count() == 5


def test_anchor_of_many_kinds_is_counted_by_windows(spark):
    rng = np.random.default_rng(5)
    text = lambda n: "".join(rng.choice(list("abcdefgh"), n))
    passage = text(230)
    data = [(k, text(80) + passage[k % 9 :] + text(80)) for k in range(30)] + [(99, passage)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    for kinds in (3, 4096):
        got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeat_report(spark, docs, most_kinds=kinds).collect()}
        assert got == brute(data)


def test_long_texts_are_cut_into_the_same_segments(monkeypatch):
    rng = np.random.default_rng(6)
    batch = pa.RecordBatch.from_pydict({"text": ["".join(rng.choice(list("abcd"), 30_000)) + "x" * 5000]})
    whole = pa.Table.from_batches(S._segments(200)(iter([batch]))).to_pylist()
    monkeypatch.setattr(S, "_CHUNK", 3000)
    assert pa.Table.from_batches(S._segments(200)(iter([batch]))).to_pylist() == whole


def test_clashing_columns_nulls_and_repeats(spark):
    text = "".join(np.random.default_rng(7).choice(list("abcdefgh"), 300))
    data = [(1, text, 1, 2, "s"), (1, text, 1, 2, "s"), (None, text, 3, 4, "t"), (2, "short", 5, 6, "u"), (3, None, 7, 8, "v")]
    docs = spark.createDataFrame(data, "doc_id long, text string, _tid long, t2 long, _spans string")
    out = remove_repeats(spark, docs)
    assert out.columns == docs.columns and sorted(str(r["text"]) for r in out.collect()) == ["", "", "", "None", "short"]
    assert remove_repeats(spark, docs.limit(0)).count() == 0 == repeat_report(spark, docs.limit(0)).count()
