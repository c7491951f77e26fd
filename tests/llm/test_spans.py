"""Spans of a whole batch at once, against each byte by itself."""

import numpy as np
import pyarrow as pa

from lexigrain.llm import suffixes


def test_spans_of_a_batch_cover_what_each_row_by_itself_does():
    rng = np.random.default_rng(4)
    rows = [(int(rng.integers(0, 6)), int(rng.integers(0, 90)), [(int(rng.integers(0, 40)), int(rng.integers(1, 9)), int(rng.integers(0, 6))) for _ in range(rng.integers(0, 12))]) for _ in range(60)]
    cols = {"doc_id": pa.array([r[0] for r in rows]), "start": pa.array([r[1] for r in rows])}
    cols |= {c: pa.array([[x[i] for x in r[2]] for r in rows], pa.list_(t)) for i, (c, t) in enumerate((("starts", pa.int32()), ("sizes", pa.int32()), ("lows", pa.int64())))}
    cut = {c: v.slice(3) for c, v in cols.items()}
    got = suffixes.marked_spans(cut).to_pylist()
    for (doc_id, start, each), spans in zip(rows[3:], got, strict=True):
        want = {start + i for at, size, low in each if low < doc_id for i in range(at, at + size)}
        assert {i for x, y in zip(spans[::2], spans[1::2]) for i in range(x, y)} == want
        assert all(y < x for y, x in zip(spans[1::2], spans[2::2]))
