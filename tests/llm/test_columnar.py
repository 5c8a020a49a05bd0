import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from dirloom.llm import columnar as C

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aé \n\tB.", max_size=30)), max_size=8)


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_words_and_ngrams(texts):
    buf, off = C.utf8(pa.array(texts, pa.string()))
    starts, ends, at = C.words(buf, off)
    want = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    got = [[bytes(buf[s:e]).decode() for s, e in zip(starts[a:b], ends[a:b])] for a, b in zip(at[:-1], at[1:])]
    assert got == want
    h = C.hash_spans(buf, starts, ends)
    flat = [w for ws in want for w in ws]
    assert len(set(zip(flat, h.tolist()))) == len(set(flat)) == len(set(h.tolist()))
    grams, first = C.ngrams(h, at, 2)
    assert len(grams) == sum(max(len(w) - 1, 0) for w in want) and (np.diff(first) > 0).all()


def test_pieces_cut_by_bytes_and_keep_long_rows():
    b = pa.RecordBatch.from_pydict({"text": ["a" * 10, "b" * 100, None, "c"]})
    got = [p.column("text").to_pylist() for p in C.pieces(iter([b]), most=20)]
    assert sum(got, []) == ["a" * 10, "b" * 100, None, "c"] and ["b" * 100] in got
