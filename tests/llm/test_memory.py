"""What a Python worker of the pipeline holds: an executor has 3000 MB, its JVM takes up to 2350 of them."""

import tracemalloc

import numpy as np
import pyarrow as pa

from dirloom.llm import columnar as C
from dirloom.llm import ngram_join, spm, suffix_dedup
from dirloom.llm.segments import SegmentIds


def _spans(words):
    ends = np.cumsum([len(w) for w in words])
    return np.frombuffer(b"".join(words), np.uint8), ends - np.diff(ends, prepend=0), ends


def test_known_segments_are_small():
    words = [b"%d" % k for k in range(100_000)]
    table = SegmentIds(lambda texts: [[int(x) % 30_000, 1] for x in texts], spm.CACHE)
    ids, before = table.ids(*_spans(words))
    assert ids.dtype == np.int32 and ids.tolist() == [i for k in range(100_000) for i in (k % 30_000, 1)]
    assert np.diff(before).tolist() == [2] * 100_000
    assert sum(v.nbytes for v in vars(table).values() if isinstance(v, np.ndarray)) < 40 * len(words)
    assert spm.CACHE * 40 <= 40_000_000


def test_segments_with_few_many_and_large_ids_and_after_forgetting():
    rng = np.random.default_rng(5)
    met = []

    def encode(texts):
        met.extend(texts)
        return [[int(x)] * (int(x) % 4) for x in texts]

    table = SegmentIds(encode, 30_000)
    for top in (9, 20_000, 70_000, 300_000, 20_000):  # ids over 16 bits from the third on; the fourth is forgotten
        for _ in range(3):
            n = rng.integers(0, top, 12_000).tolist()
            ids, before = table.ids(*_spans([b"%d" % k for k in n]))
            want = [[k] * (k % 4) for k in n]
            assert ids.tolist() == sum(want, []) and np.diff(before).tolist() == [len(x) for x in want]
            assert len(table.hashes) <= 42_000
    assert len(met) > len(set(met))


def test_powers_of_the_prime():
    for table, base in zip(C._powers31(10), (1_234_567_891, pow(1_234_567_891, -1, C._PRIME)), strict=True):
        assert len(table) == C._BLOCK + 1
        assert [int(table[k]) for k in (0, 1, 2, 1000, C._BLOCK)] == [pow(base, k, C._PRIME) for k in (0, 1, 2, 1000, C._BLOCK)]


def test_temporaries_of_a_batch_are_bounded():
    rng = np.random.default_rng(6)
    letters = rng.integers(97, 123, (1000, 4000)).astype(np.uint8)
    letters[rng.random(letters.shape) < 0.17] = 32
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(1000)), "text": [x.tobytes().decode() for x in letters]})
    for run, most in ((suffix_dedup._segments(200), 90), (ngram_join._identities(5), 35)):
        tracemalloc.start()
        assert sum(b.num_rows for b in run(iter([batch]))) >= 1000
        peak = tracemalloc.get_traced_memory()[1] / 1e6
        tracemalloc.stop()
        assert peak < most
