"""Word spans and hashes against plain Python."""

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from loomgraph.llm import words as w

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aB é\n\t x漢", max_size=40)), max_size=6)


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_spans(texts):
    data, offs = w.flat(pa.array(texts, pa.string()))
    starts, ends, first = w.spans(w.is_space_free(data), offs)
    for i, text in enumerate(texts):
        found = [data[a:b].tobytes().decode() for a, b in zip(starts[first[i] : first[i + 1]], ends[first[i] : first[i + 1]], strict=True)]
        assert found == re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_equal_words_have_equal_hashes_across_blocks():
    text = "word " * 300_000 + "x" * 5000 + " word " + "x" * 5000
    data, offs = w.flat(pa.array([text]))
    starts, ends, _ = w.spans(w.is_space_free(data), offs)
    h = w.hashes(data, starts, ends)
    assert len(set(h.tolist())) == 2 and h[-1] == h[300_000] and h[-2] == h[0]


def test_windows_are_polynomials():
    v = np.arange(1, 60, dtype=np.uint64)
    base = 0xD1342543DE82EF95
    for k in (1, 2, 3, 5, 35, 50):
        assert w.windows(v, k).tolist() == [sum(int(v[i + j]) * pow(base, j, 1 << 64) for j in range(k)) % (1 << 64) for i in range(len(v) - k + 1)]


def test_slices_keep_every_row():
    batch = pa.RecordBatch.from_pydict({"t": pa.array(["a" * n for n in (5, 0, 50, 3)] + [None])})
    parts = list(w.slices(batch, "t", 10))
    assert sum(p.num_rows for p in parts) == 5 and [x for p in parts for x in p["t"].to_pylist()] == batch["t"].to_pylist()
