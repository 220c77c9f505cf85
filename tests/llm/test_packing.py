import random
from bisect import bisect_left, insort

import numpy as np
import pytest

from gristmill.llm import packing

from .helpers import awkward

WIDTH = 64


def plain_best_fit(lengths, width):
    """Rows by a sorted list of free places."""
    free, rows = [], []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        at = bisect_left(free, (lengths[i], -1))
        if at < len(free):
            places, row = free.pop(at)
        else:
            places, row = width, len(rows)
            rows.append([])
        rows[row].append(i)
        if places > lengths[i]:
            insort(free, (places - lengths[i], row))
    return rows


def test_best_fit_uses_as_few_rows_as_a_search_of_all():
    rng = random.Random(2)
    for _ in range(50):
        lengths = [rng.randint(1, WIDTH) for _ in range(rng.randint(1, 200))]
        rows = packing.best_fit(lengths, WIDTH)
        assert sorted(i for row in rows for i in row) == list(range(len(lengths)))
        assert all(sum(lengths[i] for i in row) <= WIDTH for row in rows)
        plain = plain_best_fit(lengths, WIDTH)
        # Which of two rows with equal room is taken is free; what is in them is not.
        assert sorted(sum(lengths[i] for i in row) for row in rows) == sorted(sum(lengths[i] for i in row) for row in plain)


def documents_of(rows):
    parts = {}
    for r in rows:
        ids, positions = np.frombuffer(r.ids, "<u2"), np.frombuffer(r.positions, "<u2")
        assert len(ids) == len(positions) == WIDTH and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.used
        assert (ids[r.used :] == 50256).all() and (positions[r.used :] == 0).all()
        for i, (doc, start) in enumerate(zip(r.doc_ids, r.doc_starts, strict=True)):
            part = slice(r.cu_seqlens[i], r.cu_seqlens[i + 1])
            assert positions[part].tolist() == list(range(part.stop - part.start))
            parts.setdefault(doc, []).append((start, ids[part].tolist()))
    return parts


@pytest.mark.parametrize("window", [1 << 20, 300])
def test_round_trip(spark, window):
    docs = awkward(spark)
    texts = docs.select("doc_id", "text").collect()
    rows = packing.pack_documents(docs.repartition(3), width=WIDTH, window_tokens=window).collect()
    assert len({(r.shard, r.row) for r in rows}) == len(rows)
    parts = documents_of(rows)
    encoding = packing._encoding(tuple(packing.load_ranks().items()))
    for doc_id in {t.doc_id for t in texts}:
        same = [t.text for t in texts if t.doc_id == doc_id]
        found = sorted(parts.get(doc_id, []))
        ids = [i for start, part in found[:: len(same)] for i in part]
        assert encoding.decode(ids) == (same[0] or "")
    assert packing.pack_documents(docs.limit(0)).count() == 0


@pytest.mark.parametrize("space", [" ", "\n", "\t", "\u3000", " \n"])
@pytest.mark.parametrize("times", [1_000, 1 << 16, 1_000_000, 10_000_000])
def test_long_white_space(space, times):
    text = "a" + (space * times)[:times] + "b" + space * 3 + "c"
    ranks = packing.load_ranks()
    ids = packing.Encoder(ranks).ids(text).tolist()
    encoding = packing._encoding(tuple(ranks.items()))
    assert encoding.decode(ids) == text
    if times < packing.SPACE_AT_ONCE:
        assert ids == encoding.encode_ordinary(text)
